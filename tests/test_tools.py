import pytest
from pyspark.sql import functions as F

from gridwright.operators import INTENDED
from gridwright.plans.registry import RESERVED, TOOLS, run
from gridwright.sources.grid import Grid

BLANK = " "


def out(grid, tool, mode="literal", **params):
    return run(grid, tool, params, mode)


def test_every_tool_is_there():
    assert len(TOOLS) == 24


def test_dispatch_refuses(text_grid):
    grid = text_grid(a=["x"])
    with pytest.raises(KeyError):
        run(grid, "no-such-tool")
    with pytest.raises(KeyError):
        run(grid, "text-ops", {}, tier="nothing")
    with pytest.raises(ValueError):
        run(grid, "text-ops", {"column": "a"}, "other")
    for tier in RESERVED:
        with pytest.raises(NotImplementedError):
            run(grid, "text-ops", {}, tier=tier)


def test_remove_duplicates(text_grid, cells):
    grid = text_grid(k=["x", "y", "x", None, ""], v=["1", "2", "1", "3", "3"])
    assert cells(out(grid, "remove-duplicates").grid) == [("x", "1"), ("y", "2"), (None, "3")]
    last = out(grid, "remove-duplicates", keep="last")
    assert cells(last.grid) == [("y", "2"), ("x", "1"), ("", "3")]
    assert last.stats() == {"rows": 5, "duplicates_removed": 2, "remaining": 3, "pct_removed": "40.0%"}
    one = out(grid, "remove-duplicates", mode="literal", **{"column": "v"}).grid
    assert len(cells(one)) == 3


def test_remove_duplicates_of_nothing(text_grid):
    empty = text_grid(k=["x"]).filter(F.lit(False))
    assert out(empty, "remove-duplicates").stats()["pct_removed"] == "NaN%"


def test_duplicate_keys(text_grid, cells):
    grid = text_grid(k=["a", "b", "a", "c", "a"])
    report = out(grid, "detect-dup-key", key_columns="k")
    assert report.stats() == {"rows": 5, "duplicate_rows": 2, "unique_keys": 3, "action": "report"}
    assert not report.writes
    flagged = out(grid, "detect-dup-key", key_columns="k", action="flag").grid
    assert cells(flagged, "is_duplicate_key") == [0, 0, 1, 0, 1]
    assert cells(out(grid, "detect-dup-key", key_columns="k", action="remove_all").grid) == ["b", "c"]
    assert cells(out(grid, "detect-dup-key", key_columns="k", action="keep_first").grid) == ["a", "b", "c"]
    assert len(cells(out(grid, "detect-dup-key", key_columns="k", action="keep_last").grid)) == 5
    assert cells(out(grid, "detect-dup-key", INTENDED, key_columns="k", action="keep_last").grid) == ["b", "c", "a"]


def test_duplicate_keys_over_columns(text_grid, cells):
    grid = text_grid(a=["x", "x", None], b=["1", "2", ""])
    assert cells(out(grid, "detect-dup-key", INTENDED, key_columns=["a", "b"], action="flag").grid, "is_duplicate_key") == [0, 0, 0]
    assert cells(out(text_grid(a=[None, ""]), "detect-dup-key", key_columns="a", action="flag").grid, "is_duplicate_key") == [0, 1]


def test_fill_numbers_in_text(text_grid, cells):
    grid = text_grid(x=["", "2", BLANK, "4", ""])
    assert cells(out(grid, "fill-missing", column="x").grid) == ["2", "2", "2", "4", "2"]
    assert cells(out(grid, "fill-missing", column="x", method="median").grid) == ["2", "2", "2", "4", "2"]
    assert cells(out(grid, "fill-missing", INTENDED, column="x").grid) == ["3", "2", "3", "4", "3"]
    filled = out(grid, "fill-missing", column="x", method="ffill")
    assert cells(filled.grid) == ["", "2", "2", "4", "4"]
    assert filled.stats()["cells_filled"] == 2
    assert cells(out(grid, "fill-missing", column="x", method="bfill").grid) == ["2", "2", "4", "4", ""]
    assert out(grid, "fill-missing", column="x").stats() == {"cells_filled": 3, "method": "mean", "columns_processed": 1}


def test_fill_everything(text_grid, cells):
    grid = text_grid(s=["a", None, "b"])
    assert cells(out(grid, "fill-missing").grid) == ["a", "0", "b"]
    assert cells(out(grid, "fill-missing", INTENDED).grid) == ["a", None, "b"]
    assert cells(out(grid, "fill-missing", method="value", fill_value="?").grid) == ["a", "?", "b"]
    with pytest.raises(ValueError):
        out(grid, "fill-missing", method="guess")


def test_missing_strategies(text_grid, cells):
    grid = text_grid(x=["", "2", BLANK, "4", ""])
    go = lambda strategy, mode="literal", **p: cells(out(grid, "missing-strategy", mode, strategy=strategy, column="x", **p).grid)
    assert go("forward_fill") == [None, "2", "2", "4", "4"]
    assert go("backward_fill") == ["2", "2", "4", "4", ""]
    assert go("interpolate") == ["0", "2", "0", "4", "0"]
    assert go("interpolate", INTENDED) == ["", "2", "3", "4", ""]
    assert go("drop_rows") == ["2", "4"]
    assert go("constant", constant_value="z") == ["z", "2", "z", "4", "z"]
    assert go("mean") == ["2", "2", "2", "4", "2"]


def test_mode_ties(text_grid, cells):
    grid = text_grid(s=["10", "b", "b", "10", "2", "2", None, "a", "a"])
    assert cells(out(grid, "missing-strategy", strategy="mode", column="s").grid)[6] == "2"
    assert cells(out(grid, "missing-strategy", INTENDED, strategy="mode", column="s").grid)[6] == "10"


def test_drop_columns(text_grid):
    grid = text_grid(a=["1", "2", "3"], b=["", "", "x"])
    assert out(grid, "missing-strategy", strategy="drop_cols", column="a").grid.headers == ("a",)
    assert out(grid, "missing-strategy", INTENDED, strategy="drop_cols", column="a").grid.headers == ("a", "b")


def test_outliers(spark, cells):
    grid = Grid.of(spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0), (3, 10.0), (4, 100.0), (5, None), (6, float("nan"))], "i long, x double"), "i")
    result = out(grid, "remove-outliers", column="x")
    assert cells(result.grid, "i") == [0, 1, 2, 3, 5, 6]
    assert result.stats() == {"method": "iqr", "lower": "-10.00", "upper": "22.00", "removed": 1, "remaining": 6}
    assert out(grid, "remove-outliers", column="x", method="zscore").stats()["removed"] == 1
    assert out(grid, "remove-outliers", column="x", method="modified").stats() == {**out(grid, "remove-outliers", column="x", method="zscore").stats(), "method": "modified"}
    assert out(grid, "remove-outliers", INTENDED, column="x", method="modified", threshold=3.5).stats()["removed"] == 1


def test_outliers_without_numbers(text_grid, cells):
    grid = text_grid(x=["a", None])
    for method in ("iqr", "zscore"):
        assert len(cells(out(grid, "remove-outliers", column="x", method=method).grid)) == 2
    with pytest.raises(ValueError):
        out(grid, "remove-outliers", column="x", method="other")


def test_convert(text_grid, cells):
    grid = text_grid(v=["1,234", "", "abc", "true", "(100)", "1-2", None])
    assert cells(out(grid, "convert-type", column="v").grid) == [1234.0, 0.0, None, None, None, None, None]
    money = out(grid, "convert-type", column="v", target_type="currency")
    assert cells(money.grid) == [1234.0, 0.0, 0.0, 0.0, 100.0, None, 0.0]
    assert money.stats() == {"column": "v", "target_type": "currency", "converted": 6, "failed": 1}
    assert cells(out(grid, "convert-type", INTENDED, column="v", target_type="currency").grid) == [1234.0, None, None, None, 100.0, None, None]
    assert cells(out(grid, "convert-type", column="v", target_type="boolean").grid) == [False, False, False, True, False, False, False]
    assert cells(out(grid, "convert-type", column="v", target_type="text").grid)[-1] == ""
    assert cells(out(grid, "convert-type", column="v", target_type="date").grid)[-1] == "1970-01-01"
    assert cells(out(grid, "convert-type", INTENDED, column="v", target_type="date").grid)[-1] is None


def test_convert_persian_words(text_grid, cells):
    yes = "\N{ARABIC LETTER BEH}\N{ARABIC LETTER LAM}\N{ARABIC LETTER HEH}"
    assert cells(out(text_grid(v=[yes, " YES ", "\N{EXTENDED ARABIC-INDIC DIGIT ONE}"]), "convert-type", column="v", target_type="boolean").grid) == [True, True, False]


def test_text_ops(text_grid, cells):
    e, digits = "\N{LATIN SMALL LETTER E WITH ACUTE}", "\N{EXTENDED ARABIC-INDIC DIGIT ONE}\N{EXTENDED ARABIC-INDIC DIGIT TWO}-3"
    grid = text_grid(s=[" o'neil x_1 ", f"{e}a", digits, ""])
    go = lambda op: cells(out(grid, "text-ops", column="s", operation=op).grid)
    assert go("title_case") == [" O'Neil X_1 ", f"{e}A", digits, ""]
    assert go("trim")[0] == "o'neil x_1"
    assert go("remove_numbers")[2] == "-"
    assert go("extract_numbers")[1:3] == ["", digits]
    assert go("remove_special")[0] == " oneil x1 "
    assert go("remove_spaces")[0] == "o'neilx_1"
    assert out(grid, "text-ops", column="s", operation="uppercase").stats() == {"operation": "uppercase", "rows": 4, "changed": 2, "unchanged": 2}
    with pytest.raises(ValueError):
        go("reverse")


def test_split_and_merge(text_grid, spark, cells):
    grid = text_grid(s=["a,b,c", "a", None, " a ,"])
    assert cells(out(grid, "split-column", column="s").grid, "s_1", "s_2") == [("a", "b"), ("a", ""), ("", ""), ("a", "")]
    assert cells(out(text_grid(s=["a.b\\Ec"]), "split-column", column="s", delimiter="\\E").grid, "s_2") == ["c"]
    mixed = Grid.of(spark.createDataFrame([(0, 1.0, "x"), (1, None, "y")], "i long, a double, b string"), "i")
    assert cells(out(mixed, "merge-columns", col1="a", col2="b").grid, "merged") == ["1 x", " y"]
    assert cells(out(mixed, "merge-columns", col1="a", col2="b", separator="", new_name="a").grid, "a_2") == ["1x", "y"]


def test_errors(text_grid, cells):
    grid = text_grid(a=["#N/A", " #div/0! ", "ok"], b=["1", "2", None])
    assert cells(out(grid, "handle-errors").grid, "a") == ["0", "0", "ok"]
    assert out(grid, "handle-errors").stats()["errors_found"] == 2
    assert cells(out(grid, "handle-errors", strategy="drop_rows").grid) == []
    assert cells(out(grid, "handle-errors", INTENDED, strategy="drop_rows").grid) == [("ok", None)]
    assert cells(out(grid, "handle-errors", strategy="flag_column").grid) == [(None, "1", 1), (None, "2", 1), ("ok", None, 0)]
    assert cells(out(grid, "handle-errors", strategy="isolate").grid, "a") == [None, None, "ok"]


def test_dates(text_grid, cells):
    grid = text_grid(d=["2024-01-05", "", "not-a-date", None])
    assert cells(out(grid, "date-ops", column="d").grid, "year") == [2024, None, None, 1970]
    assert cells(out(grid, "date-ops", INTENDED, column="d").grid, "year") == [2024, None, None, None]
    assert cells(out(grid, "date-ops", column="d", operation="extract_weekday").grid, "weekday") == ["Fri", "", "", "Thu"]
    assert cells(out(grid, "date-ops", column="d", operation="add_days", days="x").grid, "add days")[0] == "2024-01-05"
    assert cells(out(grid, "date-ops", column="d", operation="add_days", days=-5).grid, "add days")[0] == "2023-12-31"
    std = lambda **p: cells(out(grid, "date-standardize", column="d", **p).grid)
    assert std(handle_errors="error") == ["2024-01-05", "#DATE_ERROR", "#DATE_ERROR", "1970-01-01"]
    assert std(handle_errors="original", output_format="%d/%m/%Y") == ["05/01/2024", "", "not-a-date", "01/01/1970"]
    assert std(output_format="unix") == [1704412800, None, None, 0]
    assert out(grid, "date-standardize", column="d").stats() == {"format": "ISO8601", "converted": 2, "errors": 2}


def test_unix_time_is_floored(text_grid, cells):
    assert cells(out(text_grid(d=["1969-12-31 23:59:59.5"]), "date-standardize", column="d", output_format="unix").grid) == [-1]


def test_normalize(text_grid, cells):
    grid = text_grid(s=["\N{LATIN SMALL LIGATURE FI}\N{CIRCLED DIGIT ONE}", "\N{LATIN SMALL LETTER E WITH ACUTE}", None])
    go = lambda ops: cells(out(grid, "normalize-text", column="s", operations=ops).grid)
    assert go("nfkc") == ["fi1", "\N{LATIN SMALL LETTER E WITH ACUTE}", None]
    assert go("remove_accents")[1] == "e"
    assert go("nfd")[1] == "e\N{COMBINING ACUTE ACCENT}"
    assert go("all")[:2] == ["fi1", "e"]
    assert go("nothing") == cells(grid)


def test_empty_rows_and_columns(text_grid, cells):
    grid = text_grid(a=["1", ""], b=["", ""], c=[BLANK, ""], d=[None, ""])
    assert len(cells(out(grid, "remove-empty-rows").grid)) == 1
    assert len(cells(out(grid, "remove-empty-rows", threshold=75).grid)) == 0
    assert out(grid, "remove-empty-cols").grid.headers == ("a",)
    assert out(grid, "remove-empty-cols", INTENDED, consider_whitespace=False).grid.headers == ("a", "c")
    assert out(grid, "remove-empty-cols", threshold=1).grid.headers == ()


def test_regex_replace(text_grid, cells):
    grid = text_grid(s=["ab12", "AB", ""])
    assert cells(out(grid, "regex-replace", column="s", pattern="[a-z]+", replacement="<$&>").grid) == ["<ab>12", "AB", ""]
    assert cells(out(grid, "regex-replace", column="s", pattern="[a-z]+", replacement="<$&>", flags="case_insensitive").grid) == ["<ab>12", "<AB>", ""]
    with pytest.raises(ValueError):
        out(grid, "regex-replace", column="s")


def test_emails(text_grid, cells):
    grid = text_grid(s=["a@b.co", "a b@c.de", "a@b.c", " x@y.zz ", ""])
    assert cells(out(grid, "validate-email", column="s").grid, "email_valid") == [1, 0, 0, 1, 0]
    assert cells(out(grid, "validate-email", column="s", action="extract_valid").grid) == ["a@b.co", " x@y.zz "]
    assert out(grid, "validate-email", column="s").stats()["invalid"] == 3


def test_phones(text_grid, cells):
    grid = text_grid(s=["09123456789", "+1 2125551234", "212-555-1234"])
    flags = lambda region: cells(out(grid, "validate-phone", column="s", region=region).grid, "phone_valid")
    assert flags("IR") == [1, 0, 0]
    assert flags("US") == [0, 1, 0]
    assert flags("auto") == flags("nowhere") == [1, 1, 1]
    assert cells(out(grid, "validate-phone", column="s", action="normalize").grid) == ["09123456789", "+12125551234", "2125551234"]


@pytest.mark.parametrize(
    ("url", "valid"),
    [
        ("http://a.example/x", True), (" https://a.example ", True), ("http:a.example", True), ("http:///a.example", True), ("http://", False), ("http://a b/", False), ("http://a:99999/", False),
        ("http://a:80/", True), ("http://u:p@a/", True), ("http://1.2.3.4/", True), ("http://1.2.3.999/", False), ("http://[::1]/", True), ("http://[::1", False), ("http://a%20b/", False),
        ("//a.example", False), ("nope", False), ("", False), (None, False), ("http://?x", False), ("http://a<b/", False),
    ],
)
def test_urls(text_grid, cells, url, valid):
    assert cells(out(text_grid(u=[url]), "validate-url", column="u").grid, "url_valid") == [int(valid)]


def test_url_schemes(text_grid, cells):
    grid = text_grid(u=["http://a.example/x", "mailto:x@y.z", "nope", None, "file:///tmp/x"])
    assert cells(out(grid, "validate-url", column="u").grid, "url_valid") == [1, 0, 0, 0, 0]
    assert cells(out(grid, "validate-url", column="u", check_scheme="false").grid, "url_valid") == [1, 1, 0, 0, 1]
    assert cells(out(grid, "validate-url", INTENDED, column="u", check_scheme=False).grid, "url_valid") == [1, 1, 0, 0, 1]


def test_encoding(text_grid, cells):
    broken = "caf\N{REPLACEMENT CHARACTER}"
    age = "\N{LATIN CAPITAL LETTER A WITH CIRCUMFLEX}ge"
    grid = text_grid(s=["ok", broken, age])
    assert out(grid, "detect-encoding").stats()["suspicious_cells"] == 2
    assert out(grid, "detect-encoding", INTENDED).stats()["suspicious_cells"] == 1
    fixed = out(grid, "detect-encoding", fix_encoding="true")
    assert cells(fixed.grid) == ["ok", "caf?", age] and fixed.writes
    assert not out(grid, "detect-encoding", fix_encoding=True).writes


def test_units(text_grid, cells):
    grid = text_grid(x=["1", "", "abc"])
    assert cells(out(grid, "unit-convert", column="x").grid, "x_ft") == [3.28084, None, None]
    kelvin = dict(column="x", category="temperature", from_unit="K", to_unit="F")
    assert cells(out(grid, "unit-convert", **kelvin).grid, "x_F")[0] == 1.0
    assert cells(out(grid, "unit-convert", INTENDED, **kelvin).grid, "x_F")[0] == -457.87
    assert cells(out(grid, "unit-convert", column="x", from_unit="parsec", to_unit="km").grid, "x_km")[0] == 0.001
    with pytest.raises(ValueError):
        out(grid, "unit-convert", INTENDED, column="x", from_unit="parsec", to_unit="km")


def test_currency(text_grid, cells):
    grid = text_grid(x=["10", "abc"])
    result = out(grid, "currency-convert", column="x", manual_rate="0.92")
    assert cells(result.grid, "x_EUR") == [9.2, None]
    assert result.stats() == {"rate": "0.920000", "new_column": "x_EUR", "rows": 2}
    assert cells(out(grid, "currency-convert", column="x", rate_source="live", from_currency="EUR").grid, "x_EUR")[0] == 10.028
    assert cells(out(grid, "currency-convert", INTENDED, column="x", rate_source="live", from_currency="EUR").grid, "x_EUR")[0] == 10.0
    assert cells(out(grid, "currency-convert", column="x", rate_source="live", rates={"EUR": 0.5}).grid, "x_EUR")[0] == 5.0


def test_constants(text_grid, cells):
    grid = text_grid(a=["x", "x", "x"], b=[None, "", "z"])
    assert cells(out(grid, "detect-constant").grid) == [("a", 1)]
    assert sorted(cells(out(grid, "detect-constant", threshold="2").grid)) == [("a", 1), ("b", 2)]
    assert out(grid, "detect-constant").stats()["variable"] == 1


def test_rules(text_grid, cells):
    grid = text_grid(x=["5", "", BLANK, "20", "abc"])
    flags = lambda **p: cells(out(grid, "invalid-values", column="x", **p).grid, "is_invalid")
    assert flags(min_val="0", max_val="10") == [0, 1, 0, 1, 1]
    assert flags(min_val="", max_val=None) == [0, 1, 0, 0, 1]
    assert flags(rule_type="allowed_list", allowed_list="5, 20") == [0, 1, 1, 0, 1]
    assert flags(rule_type="allowed_list") == [1, 0, 0, 1, 1]
    assert flags(rule_type="regex", regex_pattern="\\d") == [0, 1, 1, 0, 1]
    assert flags(rule_type="regex", regex_pattern="(") == [1] * 5
    assert flags(rule_type="regex") == [0] * 5
    assert flags(rule_type="not_null") == [0, 1, 1, 0, 0]
    assert cells(out(grid, "invalid-values", column="x", min_val=0, max_val=10, action="remove").grid) == ["5", BLANK]
    assert cells(out(text_grid(x=["1", None]), "invalid-values", INTENDED, column="x", rule_type="regex", regex_pattern="", action="remove").grid) == ["1", None]


def test_constants_of_any_type(spark):
    rows = [(i, i % 3, float(i % 2) if i else -0.0, None if i % 2 else "x", bytes([i % 4, 255])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, three int, d double, s string, b binary").selectExpr("*", "timestamp_micros(id % 7) AS t", "cast('NaN' AS double) AS n")
    found = run(Grid.of(df), "detect-constant", {"threshold": "7"})
    assert {r["column"]: r["unique_values"] for r in found.df.collect()} == {"three": 3, "d": 2, "s": 2, "b": 4, "t": 7, "n": 1}
    assert run(Grid.of(df.filter("false")), "detect-constant", {"threshold": 3}).stats()["constant"] == 7


def test_broken_patterns_and_other_failures(text_grid, cells, monkeypatch):
    from gridwright.operators import validate

    grid = text_grid(a=["x", "1"])
    for pattern in ("(", "[z-a]", "a{2,1}"):
        assert cells(out(grid, "invalid-values", column="a", rule_type="regex", regex_pattern=pattern).grid, "is_invalid") == [1, 1]
    assert cells(out(grid, "invalid-values", column="a", rule_type="regex", regex_pattern="[0-9]").grid, "is_invalid") == [1, 0]

    def lost(_):
        raise RuntimeError("no session")

    monkeypatch.setattr(validate, "Pattern", lost)
    with pytest.raises(RuntimeError):
        out(grid, "invalid-values", column="a", rule_type="regex", regex_pattern="a")


def test_hosts_beyond_ascii(text_grid, cells):
    urls = ["http://bücher.example/x", "http://ＧＯ.com", "http://a／b.com/", "http://日本.jp", "http://%E6%97%A5.jp", "http://a℀b.com/"]
    got = cells(out(text_grid(u=urls), "validate-url", column="u").grid, "url_valid")
    assert got == [1, 1, 0, 1, 1, 0]
