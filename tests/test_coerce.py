import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.coerce import is_empty, number_text, text_number, to_fixed, to_instant, to_number, to_text, trimmed

S, D = T.StringType(), T.DoubleType()
NBSP, BOM, WIDE = "\N{NO-BREAK SPACE}", "\N{ZERO WIDTH NO-BREAK SPACE}", "\N{IDEOGRAPHIC SPACE}"


def mapped(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_trimmed_takes_all_unicode_blanks(spark):
    assert mapped(spark, [f" {NBSP}a b{BOM}\n", f"{WIDE}", "a"], "string", trimmed) == ["a b", "", "a"]


def test_empty(spark):
    assert mapped(spark, [None, "", f" {NBSP}", "0", "#N/A"], "string", lambda c: is_empty(c, S)) == [True, True, True, False, False]
    assert mapped(spark, [None, float("nan"), 0.0], "double", lambda c: is_empty(c, D)) == [True, True, False]


@pytest.mark.parametrize(
    ("text", "number"),
    [("", None), (None, None), (" ", 0.0), (" 12 ", 12.0), ("1d", None), ("inf", None), ("Infinity", float("inf")), ("0x10", 16.0), ("0b11", 3.0), ("0o17", 15.0), ("1,000", None), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("true", None), ("1e400", float("inf"))],
)
def test_number(spark, text, number):
    assert mapped(spark, [text], "string", lambda c: to_number(c, S)) == [number]


def test_blank_is_no_number_when_asked(spark):
    assert mapped(spark, [" ", "1"], "string", lambda c: to_number(c, S, blank_is_zero=False)) == [None, 1.0]


def test_other_types_as_numbers(spark):
    assert mapped(spark, [True, False, None], "boolean", lambda c: to_number(c, T.BooleanType())) == [1.0, 0.0, None]
    assert mapped(spark, [float("nan"), 1.5], "double", lambda c: to_number(c, D)) == [None, 1.5]
    assert mapped(spark, ["\n"], "string", text_number) == [0.0]


def test_number_text(spark):
    given = [0.0, -0.0, 1.0, -1.5, 0.1, 1e20, 1e21, 123456789012345680000.0, 12345678.9, 1e-6, 1e-7, 1.23e-7, float("nan"), float("inf"), -1e22, 1 / 3]
    want = ["0", "0", "1", "-1.5", "0.1", "100000000000000000000", "1e+21", "123456789012345680000", "12345678.9", "0.000001", "1e-7", "1.23e-7", "NaN", "Infinity", "-1e+22", "0.3333333333333333"]
    assert mapped(spark, given, "double", number_text) == want


def test_text(spark):
    assert mapped(spark, [None, 3], "long", lambda c: to_text(c, T.LongType())) == ["", "3"]
    assert mapped(spark, [None], "long", lambda c: to_text(c, T.LongType(), "null")) == ["null"]


def test_to_fixed_rounds_the_binary_value(spark):
    rng = random.Random(1)
    values = [1.005, 0.03125, -0.03125, 1.45, 8.345, 2.5, -2.5, 1e20, 1.0000005] + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [rng.randrange(10**7) / 1e5 for _ in range(500)]
    for places in (0, 2, 4, 6):
        want = [float(Decimal(v).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP)) if abs(v) < 1e15 else v for v in values]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
        assert [r.f for r in to_fixed(df, "f", F.col("x"), places).orderBy("i").collect()] == want


def test_instants(spark):
    day = lambda c: F.date_format(to_instant(c, S), "yyyy-MM-dd HH:mm:ss")
    given = ["2024-01-05", "2024-01-05T10:11:12Z", "2024-01-05T10:11:12+02:00", "2024/1/5", "1/5/2024", "Jan 5, 2024", "5 January 2024", "2024", "not-a-date", "", "2024-13-05", None]
    want = ["2024-01-05 00:00:00", "2024-01-05 10:11:12", "2024-01-05 08:11:12", *["2024-01-05 00:00:00"] * 4, "2024-01-01 00:00:00", None, None, None, None]
    assert mapped(spark, given, "string", day) == want
    assert mapped(spark, [None], "string", lambda c: F.unix_millis(to_instant(c, S, True))) == [0]
    assert mapped(spark, [86_400_000], "long", lambda c: F.date_format(to_instant(c, T.LongType()), "yyyy-MM-dd")) == ["1970-01-02"]
