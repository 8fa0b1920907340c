"""Registered queries: each tool option on the driver's tables, with its SQL.

A case prepares columns with SQL that Spark and DuckDB both read, runs one tool
and, where sums of doubles are involved, rounds. Its oracle is SQL over the same
prepared columns, called t.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.operators import INTENDED, LITERAL
from gridwright.plans.registry import chain, run
from gridwright.sources import grid as g
from gridwright.sources.grid import Grid
from gridwright.sources.shared import discard, shared_dir, written


@dataclass
class Case:
    table: str
    columns: str
    tool: str
    params: dict[str, Any]
    oracle: str | None
    order: str | None = None
    post: str | None = None
    mode: str = LITERAL
    more: list[tuple[str, dict[str, Any]]] = field(default_factory=list)
    unique: bool = True

    def grid(self, spark: SparkSession, sf_dir: str) -> Grid:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return Grid.of(df.selectExpr(*split_list(self.columns)), self.order, unique=self.unique)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(self.grid(spark, sf_dir), self.tool, self.params, self.mode).grid
        df = chain(out, self.more, self.mode).frame()
        return df.selectExpr(*split_list(self.post)) if self.post else df

    @property
    def sql(self) -> str:
        inner = self.oracle if self.post is None else f"SELECT {self.post} FROM ({self.oracle})"
        return f"WITH t AS (SELECT {self.columns} FROM {self.table}) {inner}"


def split_list(text: str) -> list[str]:
    """The items of a select list: commas outside parentheses and quotes."""
    out, depth, quote, item = [], 0, "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "," and not depth:
            out.append(item.strip())
            item = ""
            continue
        item += ch
    return [*out, item.strip()]


GAPS = "event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v"
RUNS = "event_id, CASE WHEN event_id % 10 < 4 THEN NULL ELSE value END AS v"
NAMED = "o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS p"
BROKEN = "o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '#N/A' WHEN o_orderkey % 10 = 1 THEN ' #div/0! ' ELSE o_orderstatus END AS s"
MESSY = "p_partkey, concat('  ', p_name, ' (', CAST(p_size AS VARCHAR(10)), '-', p_brand, ')!  ') AS s"
MONEY = "c_custkey, concat('$', CAST(c_custkey AS VARCHAR(20)), ',00', CAST(c_custkey % 7 AS VARCHAR(2)), '.5') AS s"
SPARSE = "c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS a, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment END AS b, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS d"
MAILS = "c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com') WHEN c_custkey % 4 = 1 THEN concat('user ', CAST(c_custkey AS VARCHAR(20)), '@example.com') WHEN c_custkey % 4 = 2 THEN 'a@b.c' ELSE ' x@y.zz ' END AS s"
CALLS = "c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat('+1 212', CAST(2000000 + c_custkey AS VARCHAR(20))) WHEN c_custkey % 4 = 1 THEN concat('0912', CAST(1000000 + c_custkey AS VARCHAR(20))) WHEN c_custkey % 4 = 2 THEN '212-555-1234' ELSE 'none' END AS s"
DAYS = "o_orderkey, o_orderdate AS d"
DAY_TEXT = "o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'not-a-date' WHEN o_orderkey % 5 = 1 THEN '' WHEN o_orderkey % 5 = 2 THEN NULL WHEN o_orderkey % 5 = 3 THEN concat(CAST(1990 + o_orderkey % 30 AS VARCHAR(4)), '/', CAST(1 + o_orderkey % 12 AS VARCHAR(2)), '/', CAST(1 + o_orderkey % 28 AS VARCHAR(2))) ELSE '2024-02-29' END AS d"
PRICES = "o_orderkey, o_totalprice AS x"
BLANKS = "doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(text, ' caf', '\N{REPLACEMENT CHARACTER}', ' ', text) WHEN doc_id % 5 = 1 THEN concat(chr(194), 'ge ', text) ELSE text END AS s"
REGIONS = "c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat('+49 30', CAST(1000000 + c_custkey AS VARCHAR(20))) WHEN c_custkey % 4 = 1 THEN concat('01', CAST(20000000 + c_custkey AS VARCHAR(20))) WHEN c_custkey % 4 = 2 THEN concat('+44 20', CAST(70000000 + c_custkey AS VARCHAR(20))) ELSE concat('138', CAST(10000000 + c_custkey AS VARCHAR(20))) END AS s"
ACCENTS = "c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat('\N{LATIN SMALL LIGATURE FI}n \N{CIRCLED DIGIT ONE} \N{LATIN SMALL LETTER E WITH ACUTE}A ', c_name) WHEN c_custkey % 3 = 1 THEN concat('e\N{COMBINING ACUTE ACCENT} ', c_name) ELSE c_name END AS s"
LINES = "p_partkey, concat(p_name, chr(10), p_brand, chr(10), p_type) AS s"

_TITLE = "list_transform(regexp_extract_all(s, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z0-9_]') THEN upper(r[1]) || r[2:] ELSE r END)"
_NUM = "CASE WHEN s IS NULL THEN NULL WHEN trim(s) = '' THEN 0 ELSE try_cast(trim(s) AS DOUBLE) END"
_EMAIL = "CAST(regexp_matches(trim(s), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]{2,}$') AS INT)"
_DATE = "CASE WHEN d IS NULL THEN TIMESTAMP '1970-01-01' WHEN d LIKE '%/%' THEN strptime(d, '%Y/%m/%d') ELSE try_cast(d AS TIMESTAMP) END"


def _first(over: str, by: str, order: str = "ASC") -> str:
    return f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {over} ORDER BY {by} {order}) AS rn FROM t) WHERE rn = 1"


CASES: dict[str, Case] = {
    "dedupe_first": Case("documents", "doc_id, text", "remove-duplicates", {"mode": "selected", "column": "text"}, _first("coalesce(text, '')", "doc_id"), "doc_id"),
    "dedupe_last": Case("documents", "doc_id, text", "remove-duplicates", {"mode": "selected", "column": "text", "keep": "last"}, _first("coalesce(text, '')", "doc_id", "DESC"), "doc_id"),
    "dedupe_all": Case("orders", "o_orderstatus, o_orderpriority", "remove-duplicates", {}, "SELECT DISTINCT * FROM t"),
    "dedupe_lineitem_all": Case("lineitem", "l_orderkey, l_linenumber, l_returnflag, l_linestatus", "remove-duplicates", {}, "SELECT DISTINCT * FROM t"),
    "fill_mean": Case("events", GAPS, "fill-missing", {"method": "mean", "column": "v"}, "SELECT event_id, coalesce(v, avg(v) OVER ()) AS v FROM t", post="event_id, round(v, 6) AS v"),
    "fill_median": Case("events", GAPS, "fill-missing", {"method": "median", "column": "v"}, "SELECT event_id, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM t)) AS v FROM t", post="event_id, round(v, 6) AS v"),
    "fill_zero": Case("events", GAPS, "fill-missing", {"method": "zero", "column": "v"}, "SELECT event_id, coalesce(v, 0) AS v FROM t"),
    "fill_value": Case("orders", NAMED, "fill-missing", {"method": "value", "column": "p", "fill_value": "none"}, "SELECT o_orderkey, coalesce(p, 'none') AS p FROM t"),
    "fill_all_columns": Case("events", "event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS e", "fill-missing", {}, "SELECT event_id, coalesce(v, avg(v) OVER ()) AS v, coalesce(e, '0') AS e FROM t", post="CAST(event_id AS BIGINT) AS event_id, round(v, 6) AS v, e"),
    "fill_forward": Case("events", RUNS, "fill-missing", {"method": "ffill", "column": "v"}, "SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v) AS v FROM t", "event_id"),
    "fill_backward": Case("events", RUNS, "fill-missing", {"method": "bfill", "column": "v"}, "SELECT event_id, coalesce(first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), v) AS v FROM t", "event_id"),
    "outliers_iqr": Case("lineitem", "l_orderkey, l_extendedprice", "remove-outliers", {"column": "l_extendedprice", "threshold": "0.5"}, "SELECT t.* FROM t, (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM t) WHERE l_extendedprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)"),
    "outliers_zscore": Case("events", GAPS, "remove-outliers", {"column": "v", "method": "zscore"}, "SELECT t.* FROM t, (SELECT avg(v) AS m, stddev_pop(v) AS s FROM t) WHERE v IS NULL OR abs(v - m) <= 1.5 * s"),
    "outliers_modified": Case("events", GAPS, "remove-outliers", {"column": "v", "method": "modified", "threshold": 1}, "SELECT t.* FROM t, (SELECT avg(v) AS m, stddev_pop(v) AS s FROM t) WHERE v IS NULL OR abs(v - m) <= s"),
    "outliers_mad": Case("events", GAPS, "remove-outliers", {"column": "v", "method": "modified", "threshold": 1}, "SELECT t.* FROM t, (SELECT median(v) AS m FROM t), (SELECT median(abs(v - (SELECT median(v) FROM t))) AS d FROM t) WHERE v IS NULL OR abs(v - m) <= d / 0.6745", mode=INTENDED),
    "convert_number": Case("customer", "c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat(CAST(c_custkey AS VARCHAR(20)), ',500') WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 4 = 2 THEN 'abc' ELSE NULL END AS s", "convert-type", {"column": "s", "target_type": "number"}, "SELECT c_custkey, CASE WHEN s = '' THEN 0 ELSE try_cast(replace(s, ',', '') AS DOUBLE) END AS s FROM t"),
    "convert_currency": Case("customer", MONEY, "convert-type", {"column": "s", "target_type": "currency"}, "SELECT c_custkey, CAST(regexp_replace(s, '[^0-9.-]', '', 'g') AS DOUBLE) AS s FROM t"),
    "convert_text": Case("customer", "c_custkey, c_nationkey AS s", "convert-type", {"column": "s", "target_type": "text"}, "SELECT c_custkey, CAST(s AS VARCHAR) AS s FROM t"),
    "convert_boolean": Case("customer", "c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' Yes ' WHEN c_custkey % 3 = 1 THEN '1' ELSE 'no' END AS s", "convert-type", {"column": "s", "target_type": "boolean"}, "SELECT c_custkey, lower(trim(s)) IN ('true', '1', 'yes') AS s FROM t"),
    "convert_date": Case("orders", DAYS, "convert-type", {"column": "d", "target_type": "date"}, "SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS d FROM t"),
    "text_trim": Case("part", MESSY, "text-ops", {"column": "s"}, "SELECT p_partkey, trim(s) AS s FROM t"),
    "text_uppercase": Case("part", MESSY, "text-ops", {"column": "s", "operation": "uppercase"}, "SELECT p_partkey, upper(s) AS s FROM t"),
    "text_lowercase": Case("part", MESSY, "text-ops", {"column": "s", "operation": "lowercase"}, "SELECT p_partkey, lower(s) AS s FROM t"),
    "text_title_case": Case("part", MESSY, "text-ops", {"column": "s", "operation": "title_case"}, f"SELECT p_partkey, array_to_string({_TITLE}, '') AS s FROM t"),
    "text_remove_special": Case("part", MESSY, "text-ops", {"column": "s", "operation": "remove_special"}, "SELECT p_partkey, regexp_replace(s, '[^a-zA-Z0-9\\s]', '', 'g') AS s FROM t"),
    "text_remove_numbers": Case("part", MESSY, "text-ops", {"column": "s", "operation": "remove_numbers"}, "SELECT p_partkey, regexp_replace(s, '[0-9]', '', 'g') AS s FROM t"),
    "text_remove_spaces": Case("part", MESSY, "text-ops", {"column": "s", "operation": "remove_spaces"}, "SELECT p_partkey, regexp_replace(s, '\\s+', '', 'g') AS s FROM t"),
    "text_extract_numbers": Case("part", MESSY, "text-ops", {"column": "s", "operation": "extract_numbers"}, "SELECT p_partkey, array_to_string(regexp_extract_all(s, '[0-9.,-]+'), ' ') AS s FROM t"),
    "split": Case("customer", "c_custkey, c_name", "split-column", {"column": "c_name", "delimiter": "#", "max_splits": 3}, "SELECT *, coalesce(trim(string_split(c_name, '#')[1]), '') AS c_name_1, coalesce(trim(string_split(c_name, '#')[2]), '') AS c_name_2, coalesce(trim(string_split(c_name, '#')[3]), '') AS c_name_3 FROM t"),
    "merge": Case("part", "p_partkey, p_brand, p_size", "merge-columns", {"col1": "p_brand", "col2": "p_size", "separator": "/", "new_name": "label"}, "SELECT *, p_brand || '/' || p_size AS label FROM t"),
    "errors_fill_default": Case("orders", BROKEN, "handle-errors", {"column": "s"}, "SELECT o_orderkey, CASE WHEN upper(trim(s)) IN ('#N/A', '#DIV/0!') THEN '0' ELSE s END AS s FROM t"),
    "errors_flag_column": Case("orders", BROKEN, "handle-errors", {"strategy": "flag_column"}, "SELECT o_orderkey, CASE WHEN upper(trim(s)) NOT IN ('#N/A', '#DIV/0!') THEN s END AS s, CAST(upper(trim(s)) IN ('#N/A', '#DIV/0!') AS INT) AS _has_error FROM t"),
    "errors_drop_rows": Case("orders", BROKEN, "handle-errors", {"strategy": "drop_rows"}, "SELECT * FROM t WHERE upper(trim(s)) NOT IN ('#N/A', '#DIV/0!')"),
    "errors_isolate": Case("orders", BROKEN, "handle-errors", {"strategy": "isolate"}, "SELECT o_orderkey, CASE WHEN upper(trim(s)) NOT IN ('#N/A', '#DIV/0!') THEN s END AS s FROM t"),
    "date_year": Case("orders", DAYS, "date-ops", {"column": "d"}, "SELECT *, year(d) AS year FROM t"),
    "date_month": Case("orders", DAYS, "date-ops", {"column": "d", "operation": "extract_month"}, "SELECT *, month(d) AS month FROM t"),
    "date_day": Case("orders", DAYS, "date-ops", {"column": "d", "operation": "extract_day"}, "SELECT *, day(d) AS day FROM t"),
    "date_weekday": Case("orders", DAYS, "date-ops", {"column": "d", "operation": "extract_weekday"}, "SELECT *, strftime(d, '%a') AS weekday FROM t"),
    "date_add_days": Case("orders", DAYS, "date-ops", {"column": "d", "operation": "add_days", "days": "45"}, "SELECT *, strftime(d + INTERVAL 45 DAY, '%Y-%m-%d') AS \"add days\" FROM t"),
    "date_format": Case("orders", DAYS, "date-ops", {"column": "d", "operation": "format"}, "SELECT *, strftime(d, '%Y-%m-%d') AS format FROM t"),
    "date_std_iso": Case("events", "event_id, ts", "date-standardize", {"column": "ts"}, "SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts FROM t"),
    "date_std_dmy": Case("events", "event_id, ts", "date-standardize", {"column": "ts", "output_format": "%d/%m/%Y"}, "SELECT event_id, strftime(ts, '%d/%m/%Y') AS ts FROM t"),
    "date_std_mdy": Case("events", "event_id, ts", "date-standardize", {"column": "ts", "output_format": "%m/%d/%Y"}, "SELECT event_id, strftime(ts, '%m/%d/%Y') AS ts FROM t"),
    "date_std_ymd": Case("events", "event_id, ts", "date-standardize", {"column": "ts", "output_format": "%Y/%m/%d"}, "SELECT event_id, strftime(ts, '%Y/%m/%d') AS ts FROM t"),
    "date_std_unix": Case("events", "event_id, ts", "date-standardize", {"column": "ts", "output_format": "unix"}, "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM t"),
    "date_std_errors": Case("orders", DAY_TEXT, "date-standardize", {"column": "d", "handle_errors": "error"}, f"SELECT o_orderkey, coalesce(strftime({_DATE}, '%Y-%m-%d'), '#DATE_ERROR') AS d FROM t"),
    "date_std_original": Case("orders", DAY_TEXT, "date-standardize", {"column": "d", "handle_errors": "original", "output_format": "%d/%m/%Y"}, f"SELECT o_orderkey, coalesce(strftime({_DATE}, '%d/%m/%Y'), d) AS d FROM t"),
    "normalize_nfkc": Case("documents", "doc_id, text", "normalize-text", {"column": "text"}, None),
    "normalize_nfc": Case("documents", "doc_id, text", "normalize-text", {"column": "text", "operations": "nfc"}, "SELECT doc_id, nfc_normalize(text) AS text FROM t"),
    "normalize_remove_accents": Case("documents", "doc_id, text", "normalize-text", {"column": "text", "operations": "remove_accents"}, "SELECT doc_id, strip_accents(text) AS text FROM t"),
    "normalize_lowercase": Case("documents", "doc_id, text", "normalize-text", {"column": "text", "operations": "lowercase"}, "SELECT doc_id, lower(text) AS text FROM t"),
    "normalize_nfkc_text": Case("customer", ACCENTS, "normalize-text", {"column": "s", "operations": "nfkc"}, "SELECT c_custkey, nfc_normalize(replace(replace(s, '\N{LATIN SMALL LIGATURE FI}', 'fi'), '\N{CIRCLED DIGIT ONE}', '1')) AS s FROM t"),
    "normalize_nfd": Case("customer", ACCENTS, "normalize-text", {"column": "s", "operations": "nfd"}, "SELECT c_custkey, replace(s, '\N{LATIN SMALL LETTER E WITH ACUTE}', 'e\N{COMBINING ACUTE ACCENT}') AS s FROM t"),
    "normalize_all": Case("customer", ACCENTS, "normalize-text", {"column": "s", "operations": "all"}, "SELECT c_custkey, lower(strip_accents(replace(replace(s, '\N{LATIN SMALL LIGATURE FI}', 'fi'), '\N{CIRCLED DIGIT ONE}', '1'))) AS s FROM t"),
    "empty_rows": Case("customer", SPARSE, "remove-empty-rows", {"threshold": "50"}, "SELECT * FROM t WHERE 100.0 * ((a IS NULL)::INT + (trim(coalesce(b, '')) = '')::INT + (d IS NULL)::INT) / 4 < 50"),
    "empty_cols": Case("customer", SPARSE, "remove-empty-cols", {"threshold": "40"}, "SELECT c_custkey, a, d FROM t"),
    "regex_replace": Case("customer", "c_custkey, c_name", "regex-replace", {"column": "c_name", "pattern": "([a-z]+)#(\\d)", "replacement": "$2<$1>$$"}, "SELECT c_custkey, regexp_replace(c_name, '([a-z]+)#([0-9])', '\\2<\\1>$', 'g') AS c_name FROM t"),
    "regex_replace_ignore_case": Case("customer", "c_custkey, c_name", "regex-replace", {"column": "c_name", "pattern": "CUST", "replacement": "[$&]", "flags": "case_insensitive"}, "SELECT c_custkey, regexp_replace(c_name, 'CUST', '[\\0]', 'gi') AS c_name FROM t"),
    "regex_replace_multiline": Case("part", LINES, "regex-replace", {"column": "s", "pattern": "^.", "replacement": "<$&>", "flags": "multiline"}, "SELECT p_partkey, regexp_replace(s, '(?m)^.', '<\\0>', 'g') AS s FROM t"),
    "regex_replace_dotall": Case("part", LINES, "regex-replace", {"column": "s", "pattern": "#.*$", "replacement": "!", "flags": "dotall"}, "SELECT p_partkey, regexp_replace(s, '(?s)#.*$', '!') AS s FROM t"),
    "email_flag": Case("customer", MAILS, "validate-email", {"column": "s"}, f"SELECT *, {_EMAIL} AS email_valid FROM t"),
    "email_remove": Case("customer", MAILS, "validate-email", {"column": "s", "action": "remove_invalid"}, f"SELECT c_custkey, CASE WHEN {_EMAIL} = 1 THEN s END AS s FROM t"),
    "email_extract": Case("customer", MAILS, "validate-email", {"column": "s", "action": "extract_valid"}, f"SELECT * FROM t WHERE {_EMAIL} = 1"),
    "phone_flag_auto": Case("customer", CALLS, "validate-phone", {"column": "s"}, "SELECT *, CAST(regexp_full_match(replace(s, ' ', ''), '[+0-9()-]{7,20}') AS INT) AS phone_valid FROM t"),
    "phone_flag_us": Case("customer", CALLS, "validate-phone", {"column": "s", "region": "US"}, "SELECT *, CAST(regexp_full_match(replace(s, ' ', ''), '([+]1)?[2-9][0-9]{2}[2-9][0-9]{6}') AS INT) AS phone_valid FROM t"),
    "phone_remove_ir": Case("customer", CALLS, "validate-phone", {"column": "s", "region": "IR", "action": "remove_invalid"}, "SELECT c_custkey, CASE WHEN regexp_full_match(replace(s, ' ', ''), '([+]98|0098|0)?9[0-9]{9}') THEN s END AS s FROM t"),
    "phone_flag_de": Case("customer", REGIONS, "validate-phone", {"column": "s", "region": "DE"}, "SELECT *, CAST(regexp_full_match(replace(s, ' ', ''), '([+]49)?[1-9][0-9]{9,11}') AS INT) AS phone_valid FROM t"),
    "phone_flag_fr": Case("customer", REGIONS, "validate-phone", {"column": "s", "region": "FR"}, "SELECT *, CAST(regexp_full_match(replace(s, ' ', ''), '([+]33|0)[1-9][0-9]{8}') AS INT) AS phone_valid FROM t"),
    "phone_flag_gb": Case("customer", REGIONS, "validate-phone", {"column": "s", "region": "GB"}, "SELECT *, CAST(regexp_full_match(replace(s, ' ', ''), '([+]44|0)[1-9][0-9]{9}') AS INT) AS phone_valid FROM t"),
    "phone_flag_cn": Case("customer", REGIONS, "validate-phone", {"column": "s", "region": "CN"}, "SELECT *, CAST(regexp_full_match(replace(s, ' ', ''), '([+]86)?1[3-9][0-9]{9}') AS INT) AS phone_valid FROM t"),
    "phone_normalize": Case("customer", CALLS, "validate-phone", {"column": "s", "action": "normalize"}, "SELECT c_custkey, CASE WHEN regexp_full_match(replace(s, ' ', ''), '[+0-9()-]{7,20}') THEN regexp_replace(s, '[^0-9+]', '', 'g') ELSE s END AS s FROM t"),
    "url_flag": Case("pages", "page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '://', ':// ') WHEN page_id % 3 = 1 THEN replace(url, 'http', 'ftp') ELSE url END AS u", "validate-url", {"column": "u"}, "SELECT *, CAST(regexp_matches(u, '^https?://[^ /?#]') AS INT) AS url_valid FROM t"),
    "url_remove_any_scheme": Case("pages", "page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '://', ' ') WHEN page_id % 3 = 1 THEN concat('mailto:', CAST(page_id AS VARCHAR(9))) ELSE url END AS u", "validate-url", {"column": "u", "action": "remove_invalid", "check_scheme": "false"}, "SELECT page_id, CASE WHEN page_id % 3 > 0 THEN u END AS u FROM t"),
    "encoding_fix": Case("documents", BLANKS, "detect-encoding", {"column": "s", "fix_encoding": "true"}, "SELECT doc_id, replace(s, '\N{REPLACEMENT CHARACTER}', '?') AS s FROM t"),
    "currency_manual": Case("orders", PRICES, "currency-convert", {"column": "x", "manual_rate": "0.92"}, "SELECT *, round(x * 0.92, 4) AS \"x_EUR\" FROM t"),
    "currency_static": Case("orders", PRICES, "currency-convert", {"column": "x", "rate_source": "live", "to_currency": "IRR", "from_currency": "CNY"}, "SELECT *, round(x * (CAST(0.138 AS DOUBLE) * CAST(42000 AS DOUBLE)), 4) AS \"x_IRR\" FROM t"),
    "currency_rates": Case("orders", PRICES, "currency-convert", {"column": "x", "rate_source": "live", "to_currency": "GBP", "rates": {"GBP": 0.75}}, "SELECT *, round(x * 0.75, 4) AS \"x_GBP\" FROM t"),
    "unit_length": Case("lineitem", "l_orderkey, l_quantity AS x", "unit-convert", {"column": "x", "from_unit": "mi", "to_unit": "km"}, "SELECT *, round(x * 1609.344 / 1000, 6) AS x_km FROM t"),
    "unit_mass": Case("lineitem", "l_orderkey, l_quantity AS x", "unit-convert", {"column": "x", "category": "mass", "from_unit": "lb", "to_unit": "g"}, "SELECT *, round(x * 0.453592 / 0.001, 6) AS x_g FROM t"),
    "unit_temperature": Case("lineitem", "l_orderkey, l_quantity AS x", "unit-convert", {"column": "x", "category": "temperature", "from_unit": "F", "to_unit": "C"}, "SELECT *, round((x - 32) * 5 / 9, 6) AS \"x_C\" FROM t"),
    "unit_area": Case("lineitem", "l_orderkey, l_quantity AS x", "unit-convert", {"column": "x", "category": "area", "from_unit": "ha", "to_unit": "m2"}, "SELECT *, round(x * 10000, 6) AS x_m2 FROM t"),
    "unit_volume": Case("lineitem", "l_orderkey, l_quantity AS x", "unit-convert", {"column": "x", "category": "volume", "from_unit": "cup", "to_unit": "ml"}, "SELECT *, round(x * 0.000237 / 0.000001, 6) AS x_ml FROM t"),
    "unit_speed": Case("lineitem", "l_orderkey, l_quantity AS x", "unit-convert", {"column": "x", "category": "speed", "from_unit": "kmh", "to_unit": "ms"}, "SELECT *, round(x * 0.27778, 6) AS x_ms FROM t"),
    "unit_pressure": Case("lineitem", "l_orderkey, l_quantity AS x", "unit-convert", {"column": "x", "category": "pressure", "from_unit": "psi", "to_unit": "kpa"}, "SELECT *, round(x * 6894.76 / 1000, 6) AS x_kpa FROM t"),
    "dup_flag": Case("orders", "o_orderkey, o_custkey", "detect-dup-key", {"key_columns": "o_custkey", "action": "flag"}, "SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS INT) AS is_duplicate_key FROM t", "o_orderkey"),
    "dup_flag_lineitem": Case("lineitem", "l_orderkey", "detect-dup-key", {"key_columns": "l_orderkey", "action": "flag"}, "SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey) > 1 AS INT) AS is_duplicate_key FROM t", "l_orderkey", unique=False),
    "dup_remove_all_lineitem": Case("lineitem", "l_orderkey, l_quantity", "detect-dup-key", {"key_columns": "l_orderkey", "action": "remove_all"}, "SELECT l_orderkey, l_quantity FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM t) WHERE n = 1", "l_orderkey", unique=False),
    "dup_remove_all": Case("documents", "doc_id, text", "detect-dup-key", {"key_columns": "text", "action": "remove_all"}, "SELECT doc_id, text FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM t) WHERE n = 1", "doc_id"),
    "dup_keep_first": Case("orders", "o_orderkey, o_custkey", "detect-dup-key", {"key_columns": "o_custkey", "action": "keep_first"}, _first("o_custkey", "o_orderkey"), "o_orderkey"),
    "dup_keep_last": Case("orders", "o_orderkey, o_custkey", "detect-dup-key", {"key_columns": "o_custkey", "action": "keep_last"}, _first("o_custkey", "o_orderkey", "DESC"), "o_orderkey", mode=INTENDED),
    "dup_keep_last_literal": Case("orders", "o_orderkey, o_custkey", "detect-dup-key", {"key_columns": "o_custkey", "action": "keep_last"}, "SELECT * FROM t", "o_orderkey"),
    "constant_columns": Case("nation", "n_nationkey, n_regionkey, n_nationkey * 0 AS zero, concat('a', CAST(n_nationkey * 0 AS VARCHAR(3))) AS word", "detect-constant", {}, "SELECT * FROM (VALUES ('zero', 1), ('word', 1)) AS v(\"column\", unique_values)"),
    "constant_columns_5": Case("orders", "o_orderkey, o_orderstatus, o_orderpriority", "detect-constant", {"threshold": "5"}, "SELECT 'o_orderstatus' AS \"column\", count(DISTINCT o_orderstatus)::INT AS unique_values FROM t UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority)::INT FROM t"),
    "invalid_range": Case("lineitem", "l_orderkey, l_quantity", "invalid-values", {"column": "l_quantity", "min_val": "10", "max_val": "40"}, "SELECT *, CAST(l_quantity < 10 OR l_quantity > 40 AS INT) AS is_invalid FROM t"),
    "invalid_list": Case("orders", "o_orderkey, o_orderstatus", "invalid-values", {"column": "o_orderstatus", "rule_type": "allowed_list", "allowed_list": "F, O", "action": "replace_null"}, "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS o_orderstatus FROM t"),
    "invalid_regex": Case("part", "p_partkey, p_brand", "invalid-values", {"column": "p_brand", "rule_type": "regex", "regex_pattern": "[13]\\d?$", "action": "remove"}, "SELECT * FROM t WHERE regexp_matches(p_brand, '[13][0-9]?$')"),
    "invalid_not_null": Case("events", GAPS, "invalid-values", {"column": "v", "rule_type": "not_null"}, "SELECT *, CAST(v IS NULL AS INT) AS is_invalid FROM t"),
    "missing_mean": Case("events", GAPS, "missing-strategy", {"column": "v"}, "SELECT event_id, coalesce(v, avg(v) OVER ()) AS v FROM t", post="event_id, round(v, 6) AS v"),
    "missing_median": Case("events", GAPS, "missing-strategy", {"column": "v", "strategy": "median"}, "SELECT event_id, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM t)) AS v FROM t", post="event_id, round(v, 6) AS v"),
    "missing_mode": Case("orders", NAMED, "missing-strategy", {"column": "p", "strategy": "mode"}, "SELECT o_orderkey, coalesce(p, (SELECT p FROM t WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1)) AS p FROM t", "o_orderkey"),
    "missing_mode_all": Case("orders", "o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS q", "missing-strategy", {"strategy": "mode"}, "SELECT o_orderkey, coalesce(p, (SELECT p FROM t WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1)) AS p, coalesce(q, (SELECT q FROM t WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1)) AS q FROM t", "o_orderkey"),
    "missing_median_all": Case("lineitem", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS a, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS b, l_discount AS c", "missing-strategy", {"strategy": "median"}, "SELECT coalesce(a, (SELECT quantile_cont(a, 0.5) FROM t)) AS a, coalesce(b, (SELECT quantile_cont(b, 0.5) FROM t)) AS b, c FROM t", post="round(a, 6) AS a, round(b, 6) AS b, c"),
    "missing_constant": Case("events", GAPS, "missing-strategy", {"column": "v", "strategy": "constant", "constant_value": -1}, "SELECT event_id, coalesce(v, -1) AS v FROM t"),
    "missing_forward_fill": Case("events", RUNS, "missing-strategy", {"column": "v", "strategy": "forward_fill"}, "SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM t", "event_id"),
    "missing_backward_fill": Case("events", RUNS, "missing-strategy", {"column": "v", "strategy": "backward_fill"}, "SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM t", "event_id"),
    "missing_interpolate": Case("events", GAPS, "missing-strategy", {"column": "v", "strategy": "interpolate"}, "SELECT event_id, coalesce(v, 0) AS v FROM t", "event_id"),
    "missing_interpolate_linear": Case("events", RUNS, "missing-strategy", {"column": "v", "strategy": "interpolate"}, "SELECT event_id, coalesce(v, ay + (bv - ay) * (event_id - ax) / (bx - ax)) AS v FROM (SELECT *, last_value(v IGNORE NULLS) OVER a AS ay, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER a AS ax, first_value(v IGNORE NULLS) OVER b AS bv, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS bx FROM t WINDOW a AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", "event_id", post="event_id, round(v, 6) AS v", mode=INTENDED),
    "missing_drop_rows": Case("events", GAPS, "missing-strategy", {"strategy": "drop_rows"}, "SELECT * FROM t WHERE v IS NOT NULL"),
    "missing_drop_cols": Case("customer", SPARSE, "missing-strategy", {"strategy": "drop_cols", "threshold": 40}, "SELECT c_custkey, a, d FROM t"),
    "chain_clean": Case("part", MESSY, "text-ops", {"column": "s"}, "SELECT p_partkey, replace(upper(trim(s)), '#', '') AS s, length(trim(s)) > 0 AS ok FROM t", more=[("text-ops", {"column": "s", "operation": "uppercase"}), ("regex-replace", {"column": "s", "pattern": "#"})], post="p_partkey, s, length(s) > 0 AS ok"),
}
CASES["chain_clean"].oracle = "SELECT p_partkey, replace(upper(trim(s)), '#', '') AS s FROM t"


def _report(case: Case, names: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    """A tool's statistics as one row."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stats = run(case.grid(spark, sf_dir), case.tool, case.params, case.mode).stats()
        return spark.createDataFrame([tuple(stats[n] for n in names)], ", ".join(f"{n} {t}" for n, t in names.items()))

    return query


REPORTS: dict[str, tuple[Case, dict[str, str]]] = {
    "dup_report": (Case("orders", "o_orderkey, o_custkey", "detect-dup-key", {"key_columns": "o_custkey"}, "SELECT count(*) AS rows, count(*) - count(DISTINCT o_custkey) AS duplicate_rows, count(DISTINCT o_custkey) AS unique_keys FROM t"), {"rows": "long", "duplicate_rows": "long", "unique_keys": "long"}),
    "encoding_report": (Case("documents", BLANKS, "detect-encoding", {}, "SELECT count(*) FILTER (WHERE regexp_matches(s, concat('[', '\N{REPLACEMENT CHARACTER}', chr(195), chr(194), chr(226), chr(128), ']'))) AS suspicious_cells FROM t"), {"suspicious_cells": "long"}),
    "dedupe_report": (Case("documents", "doc_id, text", "remove-duplicates", {"mode": "selected", "column": "text"}, "SELECT count(*) AS rows, count(*) - count(DISTINCT text) AS duplicates_removed, count(DISTINCT text) AS remaining, printf('%.1f%%', 100.0 * (count(*) - count(DISTINCT text)) / count(*)) AS pct_removed FROM t", "doc_id"), {"rows": "long", "duplicates_removed": "long", "remaining": "long", "pct_removed": "string"}),
    "text_report": (Case("part", "p_partkey, p_name AS s", "text-ops", {"column": "s", "operation": "title_case"}, f"SELECT count(*) AS rows, count(*) FILTER (WHERE array_to_string({_TITLE}, '') <> s) AS changed FROM t"), {"rows": "long", "changed": "long"}),
}


def _grid_of(spark: SparkSession, sf_dir: str, table: str, columns: list[str], order: str) -> Grid:
    return Grid.of(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns), order, unique=True)


def _sheet_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = Grid.of(spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "CASE WHEN c_custkey = 5 THEN 'key' ELSE CAST(c_custkey AS STRING) END AS a", "CASE WHEN c_custkey = 5 THEN 'name' ELSE c_name END AS b"), "c_custkey", unique=True)
    return g.read_range(grid, [1, 2], 5, 25).frame()


def _delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _grid_of(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"], "o_orderkey")
    late = grid.df.filter("o_orderstatus = 'F'").select("o_orderkey")
    return g.delete_rows(grid, late).frame()


def _delete_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.delete_rows(_grid_of(spark, sf_dir, "nation", ["n_nationkey", "n_name"], "n_nationkey"), [3, 3, 7, 24, 99]).frame()


def _sheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet written, listed, read by name, and its columns named."""
    name = f"sheet_{uuid.uuid4().hex}"
    g.add_sheet(_grid_of(spark, sf_dir, "supplier", ["s_suppkey", "s_name"], "s_suppkey"), name)
    assert name in g.sheet_names(spark)
    back = g.read_sheet(spark, name, "s_suppkey")
    out, path = written(back.frame().select(*g.column_names(back)), "sheet")
    spark.sql(f"DROP TABLE {name}")
    return out


def _files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid written as CSV and read again, all cells as text."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = g.write_files(_grid_of(spark, sf_dir, "customer", ["c_custkey", "c_name"], "c_custkey"), path, "csv", header=True)
    out, _ = written(g.read_files(spark, path, "csv").frame().withColumn("rows", F.lit(rows).cast("long")), "csv-read")
    discard(spark, path)
    return out


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = Grid.of(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])
    return grid.df.select("o_orderkey", grid.position.alias("position"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **CASES,
    **{name: _report(case, columns) for name, (case, columns) in REPORTS.items()},
    "sheet_range": _sheet_range,
    "sheet_delete_rows": _delete_rows,
    "sheet_delete_listed": _delete_listed,
    "sheet_round_trip": _sheet_round_trip,
    "sheet_files": _files_round_trip,
    "sheet_from_records": lambda s, d: g.from_records(s, [{"name": f"n{i}", "half": i / 2, "odd": None if i % 2 else "x"} for i in range(6)]).frame(),
    "sheet_column_values": lambda s, d: g.column_values(_grid_of(s, d, "part", ["p_partkey", "p_name"], "p_partkey"), 1),
    "sheet_positions": _numbered,
    "sheet_add_column": lambda s, d: g.add_column(_grid_of(s, d, "nation", ["n_nationkey", "n_name"], "n_nationkey"), "rank", list(range(100, 125))).frame(),
    "sheet_update_column": lambda s, d: g.update_column(_grid_of(s, d, "nation", ["n_nationkey", "n_name"], "n_nationkey"), "n_name", [f"n{i}" for i in range(20)]).frame(),
    "sheet_delete_columns": lambda s, d: g.delete_columns(_grid_of(s, d, "nation", ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey"), [1]).frame(),
    "sheet_records": lambda s, d: g.to_records(_grid_of(s, d, "region", ["r_regionkey", "r_name"], "r_regionkey")),
}

ORACLE_SQL: dict[str, str] = {
    **{name: case.sql for name, case in CASES.items() if case.oracle},
    **{name: case.sql for name, (case, _) in REPORTS.items()},
    "sheet_range": 'SELECT CAST(c_custkey AS VARCHAR) AS "key", c_name AS name FROM customer WHERE c_custkey BETWEEN 6 AND 25',
    "sheet_delete_rows": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
    "sheet_delete_listed": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (3, 7, 24)",
    "sheet_round_trip": "SELECT s_suppkey, s_name FROM supplier",
    "sheet_files": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, (SELECT count(*) FROM customer) AS rows FROM customer",
    "sheet_from_records": "SELECT 'n' || i AS name, i / 2.0 AS half, CASE WHEN i % 2 = 0 THEN 'x' ELSE '' END AS odd FROM range(6) AS r(i)",
    "sheet_column_values": "SELECT p_name FROM part",
    "sheet_positions": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders",
    "sheet_add_column": "SELECT n_nationkey, n_name, 100 + n_nationkey AS rank FROM nation",
    "sheet_update_column": "SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN 'n' || n_nationkey END AS n_name FROM nation",
    "sheet_delete_columns": "SELECT n_nationkey, n_regionkey FROM nation",
    "sheet_records": "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS record FROM region",
}
