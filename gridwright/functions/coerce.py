"""Cell coercions: emptiness, numbers, text, dates and exact rounding.

Cells of a grid are loosely typed; these functions say once what each rule means
for a column of a given Spark type. All are Column -> Column and stay inside
generated code, apart from a few higher-order functions on rare branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the rules understand it (fixed value): more than ASCII, and the byte order mark.
BLANK = r"\t-\r\x20\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.VarcharType, T.CharType))


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, _NUMERIC)


def trimmed(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^[{BLANK}]+|[{BLANK}]+\z", "")


def is_empty(c: Column, t: T.DataType) -> Column:
    """Null, blank text or NaN; 0 and false are values."""
    if is_text(t):
        return c.isNull() | ~c.rlike(f"[^{BLANK}]")
    if isinstance(t, _FRACTIONAL):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _radix(digits: Column, base: int) -> Column:
    place = lambda ch: F.instr(F.lit("0123456789abcdef"), ch) - 1
    return F.aggregate(F.split(F.lower(digits), ""), F.lit(0.0), lambda acc, ch: F.when(ch == "", acc).otherwise(acc * base + place(ch)))


def text_number(c: Column) -> Column:
    """The number a text spells, after trimming: decimal, with exponent, Infinity,
    or with a 0x, 0o or 0b prefix; blank is 0; anything else null."""
    s = trimmed(c)
    plain = s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z|^[+-]?Infinity\z")
    return (
        F.when(s == "", F.lit(0.0))
        .when(plain, s.try_cast("double"))
        .when(s.rlike(r"^0[xX][0-9a-fA-F]+\z"), _radix(F.substring(s, 3, 1 << 30), 16))
        .when(s.rlike(r"^0[oO][0-7]+\z"), _radix(F.substring(s, 3, 1 << 30), 8))
        .when(s.rlike(r"^0[bB][01]+\z"), _radix(F.substring(s, 3, 1 << 30), 2))
    )


def to_number(c: Column, t: T.DataType, blank_is_zero: bool = True) -> Column:
    """As a double; null for nulls, empty text and what is no number.

    blank_is_zero: text of white space only counts as 0 (the literal rule) or
    as nothing.
    """
    if is_text(t):
        n = F.when(c != "", text_number(c))
        return n if blank_is_zero else F.when(~is_empty(c, t), n)
    if isinstance(t, _FRACTIONAL):
        return F.when(~F.isnan(c), c.cast("double"))
    if is_numeric(t):
        return c.cast("double")
    if isinstance(t, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(t, T.DateType):
        return F.unix_millis(c.cast("timestamp")).cast("double")
    if isinstance(t, _TIMES):
        return F.unix_millis(c.cast("timestamp")).cast("double")
    return F.lit(None).cast("double")


def number_text(x: Column) -> Column:
    """A double in its shortest usual notation: no trailing .0, exponents from
    1e21 up and below 1e-6."""
    s = x.cast("string")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    digits = F.concat(F.regexp_extract(s, r"^-?([0-9])\.", 1), F.regexp_replace(F.regexp_extract(s, r"\.([0-9]+)E", 1), "0+$", ""))
    exponent = F.coalesce(F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    n = F.length(digits)
    large = F.when(n <= exponent + 1, F.rpad(digits, exponent + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    spread = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(exponent > 0, "+").otherwise(""), exponent.cast("string"))
    laid = F.when((exponent >= 0) & (exponent < 21), large).when((exponent < 0) & (exponent >= -6), small).otherwise(spread)
    return F.when(x == 0, "0").when(~s.contains("E"), F.regexp_replace(s, r"\.0$", "")).otherwise(F.concat(sign, laid))


def to_text(c: Column, t: T.DataType, null: str = "") -> Column:
    """As text; nulls become ``null``."""
    if is_text(t):
        s = c
    elif isinstance(t, _FRACTIONAL):
        s = number_text(c.cast("double"))
    elif isinstance(t, T.DecimalType):
        s = number_text(c.cast("double"))
    elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        s = F.to_json(c)
    else:
        s = c.cast("string")
    return F.coalesce(s, F.lit(null))


def to_fixed(df: DataFrame, name: str, x: Column, places: int) -> DataFrame:
    """df with a column: x rounded to ``places`` decimals by its exact binary
    value, halves away from zero.

    x times the power of ten is kept as a product and its rounding error (both
    exact, by splitting the factors into halves of their bits), so that 1.005
    to two places is 1.0, as its binary value lies below the half. The error only
    matters next to a half. Steps are columns of their own: each is used several
    times, and as nested expressions they would be written out each time.
    """
    scale, split = float(10**places), float(2**27 + 1)
    bh = scale * split - (scale * split - scale)
    bl = scale - bh
    x_, a, p, n, ah = (f"__{name}_{part}" for part in ("x", "a", "p", "n", "ah"))
    c = {part: F.col(quoted(part)) for part in (x_, a, p, n, ah)}
    df = df.withColumn(x_, x).withColumn(a, F.abs(c[x_]))
    df = df.withColumns({p: c[a] * scale, ah: c[a] * split - (c[a] * split - c[a])}).withColumn(n, F.floor(c[p]).cast("double"))
    part, al = c[p] - c[n], c[a] - c[ah]
    error = al * bl - (((c[p] - c[ah] * bh) - al * bh) - c[ah] * bl)
    far = (c[p] < float(2**40)) & (F.abs(part - 0.5) > 2.0**-12)
    up = F.when(far, part > 0.5).otherwise(part + error >= 0.5)
    rounded = (c[n] + up.cast("double")) / scale
    value = F.when(c[p] < float(2**53), F.when(c[x_] < 0, -rounded).otherwise(rounded)).otherwise(c[x_])
    return df.withColumn(name, value).drop(x_, a, p, n, ah)


#: Forms of dates that text may have, most usual first.
_FORMS = [
    (r"^\d{4}-\d{2}-\d{2}\z", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}\z", "yyyy-MM"),
    (r"^\d{4}\z", "yyyy"),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}\z", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\z", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\.\d{1,9}\z", "yyyy-MM-dd HH:mm:ss.[SSSSSSSSS][SSSSSS][SSS][SS][S]"),
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})\z", None),
    (r"^\d{4}/\d{1,2}/\d{1,2}\z", "yyyy/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}\z", "yyyy/M/d H:mm"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}\z", "yyyy/M/d H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4}\z", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}\z", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}\z", "M/d/yyyy H:mm:ss"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}\z", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}\z", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}\z", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}\z", "d MMMM yyyy"),
]


def to_instant(c: Column, t: T.DataType, null_is_epoch: bool = False) -> Column:
    """As a timestamp; null if it is no date. Numbers are milliseconds since 1970.

    Text must have one of the forms listed above; those without a zone are in the
    session's time zone (UTC is the zone to use). null_is_epoch: nulls are the
    first of January 1970 (the literal rule).
    """
    if is_text(t):
        s = trimmed(c)
        out = F.lit(None).cast("timestamp")
        for shape, form in reversed(_FORMS):
            read = s.try_cast("timestamp") if form is None else F.try_to_timestamp(F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2})T", "$1 "), F.lit(form))
            out = F.when(s.rlike(shape), read).otherwise(out)
    elif isinstance(t, _TIMES):
        out = c.cast("timestamp")
    elif is_numeric(t) or isinstance(t, T.BooleanType):
        n = to_number(c, t)
        out = F.when(F.abs(n) <= 8.64e15, F.timestamp_millis(n.cast("long")))
    else:
        out = F.lit(None).cast("timestamp")
    return F.coalesce(out, F.when(c.isNull(), F.timestamp_millis(F.lit(0)))) if null_is_epoch else out


def put(c: Column, t: T.DataType, where: Column, value: Column, value_type: T.DataType) -> Column:
    """c with value where the condition holds. Columns keep their type if the
    value fits; numbers meet as doubles, anything else as text."""
    if value_type == T.NullType() or value_type == t:
        return F.when(where, value.cast(t)).otherwise(c)
    if is_numeric(t) and is_numeric(value_type):
        return F.when(where, value.cast("double")).otherwise(c.cast("double"))
    text = F.when(where, to_text(value, value_type)).otherwise(to_text(c, t))
    return F.when(~where & c.isNull(), F.lit(None)).otherwise(text)
