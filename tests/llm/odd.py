"""Documents that stretch every rule, with columns named like operators' own."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, slot int, score double, hits string, lang_pred string, component_id long, rank int, target double, base string, packets int, id string, n int, __h int, __p int, __best int, __i int, __s int, __n int, __gone int, __hash int, gone int, hashed int, times int, of int, words int, text_hash int, node int, `from` int, copy int, kept int"

LONG = " ".join(f"word{i % 977} of the {i}" for i in range(40_000))
EN = "The thing that they were reading in the other house is not the one that was for them. " * 4
FR = "\N{LATIN CAPITAL LETTER E WITH ACUTE}tre la chose que les autres avec une maison pour les enfants dans le pays. " * 4


def rows():
    texts = [
        None, "", "   \n\t", "a", "A b", "1234 !!", EN, EN, EN.upper(), EN + "and one more word", FR, FR + " fin", LONG, LONG + " end", "x" * 20_000, "9" * 5_000, "a." * 2_000 + "@" + "b." * 2_000 + "c",
        "mail me: someone.else@mail.example.com or +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.255", "Released under the MIT License.\n\nSome words here.", "\N{MUSICAL SYMBOL G CLEF} \N{LATIN SMALL LETTER E WITH ACUTE}",
    ]
    out = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", ""][i % 4]) for i, t in enumerate(texts)]
    out += [(7, EN, "en", "s1"), (7, EN, "en", "s1"), (7, FR, "fr", "s1"), (None, EN, "en", "s1"), (None, None, None, None), (2**60 + 1, EN, "en", None)]
    return [(*r, None, 5, 1, 2, 0.5, "h", "zz", 9, 3, 1.5, "b", 4, "i", 6, *range(18)) for r in out]


def odd_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def lean(df):
    return df.select("doc_id", "text", "lang", "source")


def collected(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def count_if(df, condition):
    return df.filter(F.expr(condition)).count()
