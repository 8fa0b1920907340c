import pytest
from pyspark.sql import functions as F

from gridwright.functions.patterns import Pattern


def replaced(spark, source, replacement, text, flags=""):
    p = Pattern(source, flags)
    return spark.createDataFrame([(text,)], "s string").select(F.regexp_replace("s", F.lit(p.java), F.lit(p.replacement(replacement)))).first()[0]


@pytest.mark.parametrize(
    ("source", "replacement", "text", "flags", "want"),
    [
        ("[a-z]+", "<$&>", "ab12", "", "<ab>12"),
        ("b$", "x", "ab\n", "", "ab\n"),
        ("b$", "x", "ab\nb", "m", "ax\nx"),
        ("^b", "x", "ab\nb", "m", "ab\nx"),
        ("a.c", "x", "a\nc abc", "", "a\nc x"),
        ("a.c", "x", "a\nc abc", "s", "x x"),
        (r"\s", "_", "a\N{NO-BREAK SPACE}b", "", "a_b"),
        (r"[\s,]+", "_", "a ,\N{NO-BREAK SPACE}b", "", "a_b"),
        (r"\b\w", "x", "\N{LATIN SMALL LETTER E WITH ACUTE}a", "", "\N{LATIN SMALL LETTER E WITH ACUTE}x"),
        ("(a)(b)", "$2$1$$", "ab", "", "ba$"),
        ("(a)", "$10", "a", "", "a0"),
        ("(a)", "$2", "a", "", "$2"),
        ("(?<n>a)", "$<n>$<n>", "a", "", "aa"),
        ("a", "\\1", "a", "", "\\1"),
        ("[[&&]", "x", "[&a", "", "xxa"),
        ("[^]", "x", "a\n", "", "xx"),
        ("a{2}", "x", "aaa", "", "xa"),
        ("a}", "x", "a}", "", "x"),
        ("A", "x", "aA", "i", "xx"),
        (r"\/\-", "x", "/-", "", "x"),
    ],
)
def test_dialect(spark, source, replacement, text, flags, want):
    assert replaced(spark, source, replacement, text, flags) == want


def test_text_around_a_match_is_refused():
    with pytest.raises(ValueError, match="not supported"):
        Pattern("a").replacement("$`")


@pytest.mark.parametrize("source", ["[a", "a\\", "a++"])
def test_broken_patterns(source):
    with pytest.raises(ValueError):
        Pattern(source)
