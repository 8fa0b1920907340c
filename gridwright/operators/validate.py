"""Validation of e-mail addresses, phone numbers, URLs and general rules."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.coerce import BLANK, is_empty, to_number, trimmed
from gridwright.functions.params import choice, leading_float, text_or
from gridwright.functions.patterns import Pattern
from gridwright.operators import LITERAL
from gridwright.sources.grid import Grid, ToolResult

# Shapes of phone numbers, without white space.
PHONES = {
    "IR": r"^(?:\+98|0098|0)?9[0-9]{9}\z",
    "US": r"^(?:\+1)?[2-9][0-9]{2}[2-9][0-9]{6}\z",
    "DE": r"^(?:\+49)?[1-9][0-9]{9,11}\z",
    "FR": r"^(?:\+33|0)[1-9][0-9]{8}\z",
    "GB": r"^(?:\+44|0)[1-9][0-9]{9}\z",
    "CN": r"^(?:\+86)?1[3-9][0-9]{9}\z",
    "auto": r"^[+0-9()-]{7,20}\z",
}
EMAIL = rf"^[^{BLANK}@]+@[^{BLANK}@]+\.[^{BLANK}@]{{2,}}\z"


def _reported(title: str, grid: Grid, out: Grid, valid: Column, **more: Any) -> ToolResult:
    def measures() -> dict[str, Any]:
        rows, good = grid.df.agg(F.count(F.lit(1)), F.count_if(valid)).first()
        return {"total": rows, "valid": good, "invalid": rows - good, **more}

    return ToolResult(title, out, measures)


def validate_email(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """action: flag_invalid (email_valid), remove_invalid (null) or extract_valid (filter)."""
    action = choice(params, "action", "flag_invalid", {"flag_invalid", "remove_invalid", "extract_valid"})
    i = grid.index(params["column"])
    valid = trimmed(grid.text(i)).rlike(EMAIL)
    if action == "flag_invalid":
        out = grid.add([("email_valid", valid.cast("int"))])
    else:
        out = grid.set({i: F.when(valid, grid.col(i))}) if action == "remove_invalid" else grid.filter(valid)
    return _reported(f"Validate e-mail: {params['column']}", grid, out, valid, action=action)


def validate_phone(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """action: flag_invalid (phone_valid), remove_invalid (null) or normalize
    (digits and plus); region: a key of PHONES, any other is auto."""
    action = choice(params, "action", "flag_invalid", {"flag_invalid", "remove_invalid", "normalize"})
    i = grid.index(params["column"])
    compact = F.regexp_replace(grid.text(i), f"[{BLANK}]", "")
    valid = compact.rlike(PHONES.get(params.get("region") or "auto", PHONES["auto"]))
    if action == "flag_invalid":
        out = grid.add([("phone_valid", valid.cast("int"))])
    elif action == "remove_invalid":
        out = grid.set({i: F.when(valid, grid.col(i))})
    else:
        out = grid.set({i: F.when(valid, F.regexp_replace(compact, "[^0-9+]", "")).otherwise(F.when(grid.col(i).isNotNull(), grid.text(i)))})
    return _reported(f"Validate phone: {params['column']}", grid, out, valid)


#: What a host may not contain, once percent escapes are decoded.
_BAD_HOST = r"[\x00-\x20#/<>?@\\\[\]^|%\x7f]"
_PART = r"(?:0[xX][0-9a-fA-F]*|[0-9]+)"


_BYTE = r"^(?:0[xX]0*[0-9a-fA-F]{0,2}|0[0-3]?[0-7]{0,2}|[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"


def check_urls(df: DataFrame, s: Column, valid: str, scheme: str) -> DataFrame:
    """df with two columns: whether a text is an absolute URL by the living
    standard's parser, and its scheme. Covers schemes, user info, ports, IPv4 and
    bracketed IPv6 hosts, forbidden host characters, and opaque paths. Names beyond
    ASCII are mapped by IDNA (RFC 3490), as the Java runtime does. Steps are columns
    of their own, as each is used often."""
    c = {k: F.col(f"__url_{k}") for k in ("s", "rest", "host_port", "host", "tail", "decoded", "numbers")}
    sch = F.col(scheme)
    df = df.withColumn("__url_s", F.regexp_replace(trimmed(s), r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]", ""))
    df = df.withColumn(scheme, F.lower(F.regexp_extract(c["s"], r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))
    df = df.withColumn("__url_rest", F.substring(c["s"], F.length(sch) + 2, F.length(c["s"])))
    special = sch.isin("http", "https", "ws", "wss", "ftp")
    authority = F.when(special, F.regexp_extract(c["rest"], r"^[/\\]*([^/\\?#]*)", 1)).otherwise(F.regexp_extract(c["rest"], r"^//([^/?#]*)", 1))
    df = df.withColumn("__url_host_port", F.regexp_replace(authority, r"^.*@", ""))
    bracketed = c["host_port"].startswith("[")
    df = df.withColumn("__url_host", F.when(bracketed, F.regexp_extract(c["host_port"], r"^(\[[^\]]*\])", 1)).otherwise(F.regexp_extract(c["host_port"], r"^([^:]*)", 1)))
    decoded = F.when(c["host"].contains("%"), F.coalesce(F.try_url_decode(F.replace(c["host"], F.lit("+"), F.lit("%2B"))), F.lit("%"))).otherwise(c["host"])
    # What cannot be mapped becomes a forbidden character.
    mapped = F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), decoded), F.lit("%"))
    decoded = F.when(decoded.rlike(r"[^\x00-\x7f]"), mapped).otherwise(decoded)
    df = df.withColumns({"__url_tail": F.substring(c["host_port"], F.length(c["host"]) + 1, F.length(c["host_port"])), "__url_decoded": decoded})
    df = df.withColumn("__url_numbers", F.split(F.regexp_replace(c["decoded"], r"\.\z", ""), r"\.", -1))
    port = F.regexp_extract(c["tail"], r"^:([0-9]*)\z", 1)
    port_ok = (c["tail"] == "") | (c["tail"].rlike(r"^:[0-9]*\z") & (F.coalesce(port.try_cast("int"), F.when(port == "", 0)) <= 65535))
    numbers, n = c["numbers"], F.size(c["numbers"])
    last = F.element_at(numbers, -1)
    ipv4 = (
        (n <= 4)
        & F.forall(numbers, lambda p: p.rlike(r"^(?:[0-9]+|0[xX][0-9a-fA-F]*)\z"))
        & F.forall(F.slice(numbers, 1, F.greatest(n - 1, F.lit(0))), lambda p: p.rlike(_BYTE))
        & F.when(n == 4, last.rlike(_BYTE)).otherwise(F.length(last) <= 10)
    )
    ipv6 = c["host"].rlike(r"^\[(?:[0-9a-fA-F]{0,4}:){2,7}(?:[0-9a-fA-F]{0,4}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})\]\z") & ~c["host"].rlike(r":::|::.*::")
    named = (c["decoded"] != "") & ~c["decoded"].rlike(_BAD_HOST) & F.when(c["decoded"].rlike(rf"(?:^|\.){_PART}\.?\z"), ipv4).otherwise(True)
    plain = ~c["host"].rlike(r"[\x00\t\n\r #/<>?@\\\[\]^|]") & ~((c["host"] == "") & (c["tail"] != ""))
    ok = (
        F.when(sch == "", False)
        .when(special, port_ok & F.when(bracketed, ipv6).otherwise(named))
        .when((sch == "file") | ~c["rest"].startswith("//"), True)
        .otherwise(port_ok & F.when(bracketed, ipv6).otherwise(plain))
    )
    return df.withColumn(valid, F.coalesce(ok, F.lit(False))).drop(*[f"__url_{k}" for k in c])


def validate_url(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """action: flag_invalid (url_valid) or remove_invalid (null). Only http and
    https count unless check_scheme is 'false' (or, as intended, False)."""
    action = choice(params, "action", "flag_invalid", {"flag_invalid", "remove_invalid"})
    check = params.get("check_scheme") != "false" and not (mode != LITERAL and params.get("check_scheme") is False)
    i = grid.index(params["column"])
    def checked(df: DataFrame) -> DataFrame:
        df = check_urls(df, grid.text(i, null="null"), "__valid", "__scheme")
        good = F.col("__valid") & F.col("__scheme").isin("http", "https") if check else F.col("__valid")
        return df.withColumn("__valid", good).drop("__scheme")

    if action == "flag_invalid":
        out = grid.add_with("url_valid", lambda df, name: checked(df).withColumn(name, F.col("__valid").cast("int")).drop("__valid"))
    else:
        judged = replace(grid, df=checked(grid.df)).set({i: F.when(F.col("__valid"), grid.col(i))})
        out = replace(judged, df=judged.df.drop("__valid"))

    def measures() -> dict[str, Any]:
        rows, good = checked(grid.df).agg(F.count(F.lit(1)), F.count_if("__valid")).first()
        return {"total": rows, "valid": good, "invalid": rows - good}

    return ToolResult(f"Validate URL: {params['column']}", out, measures)


def _bound(params: dict[str, Any], name: str) -> float | None:
    return None if params.get(name) == "" else leading_float(params.get(name))


def _compiled(grid: Grid, source: str) -> str | None:
    """The pattern for Java; None if it is broken. Any other failure is raised."""
    try:
        java = Pattern(source).java
    except ValueError:
        return None
    try:
        grid.spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except IllegalArgumentException:  # a syntax exception is one
        return None
    return java


def invalid_values(grid: Grid, params: dict[str, Any], mode: str = LITERAL) -> ToolResult:
    """rule_type: not_null, range (min_val, max_val), allowed_list or regex
    (regex_pattern); action: flag (is_invalid), replace_null or remove. Literally,
    remove also drops rows that were null before."""
    rule = choice(params, "rule_type", "range", {"not_null", "range", "allowed_list", "regex"})
    action = choice(params, "action", "flag", {"flag", "replace_null", "remove"})
    i = grid.index(params["column"])
    c, t = grid.col(i), grid.type(i)
    if rule == "not_null":
        bad = is_empty(c, t)
    elif rule == "range":
        n = to_number(c, t, blank_is_zero=mode == LITERAL)
        low, high = _bound(params, "min_val"), _bound(params, "max_val")
        bad = n.isNull()
        bad = bad if low is None else bad | (n < low)
        bad = F.coalesce(bad if high is None else bad | (n > high), F.lit(False))
    elif rule == "allowed_list":
        allowed = [s.strip() for s in text_or(params, "allowed_list", "").split(",")]
        bad = ~trimmed(grid.text(i)).isin(allowed)
    else:
        java = _compiled(grid, text_or(params, "regex_pattern", ""))
        bad = F.lit(True) if java is None else ~grid.text(i).rlike(java)  # a broken pattern matches nothing
    if action == "flag":
        out = grid.add([("is_invalid", bad.cast("int"))])
    elif action == "replace_null":
        out = grid.set({i: F.when(~bad, c)})
    else:
        out = grid.filter(~bad & c.isNotNull() if mode == LITERAL else ~bad)

    def measures() -> dict[str, Any]:
        rows, wrong = grid.df.agg(F.count(F.lit(1)), F.count_if(bad)).first()
        return {"rule": rule, "violations": wrong, "valid": rows - wrong}

    return ToolResult(f"Invalid values: {params['column']}", out, measures)
