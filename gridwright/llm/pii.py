"""Personal data by weak supervision: labelers vote, expectation-maximisation
weighs the votes, and a classifier trained on the outcome decides about spans.

Every text is read once. Patterns propose spans: the strict base patterns of
four kinds, and looser ones (phone numbers without a plus, spelled-out e-mail
addresses, identity numbers, opaque runs that may be keys). Five labelers vote
yes or no, or abstain: the form of the value, a gazetteer of prefixes and endings,
the words before, the marks on either side, and the length. The votes of all spans
are counted by pattern of votes; EM on those counts (at most 3^5 per kind, whatever
the corpus) estimates how far to trust each labeler, and gives each pattern a
probability. A naive Bayes classifier over bucketed features of the span and its
surroundings is then trained with these probabilities as soft labels, from counts
that are again bounded, and combined with them it decides. Valid base matches
are always reported; matches of base patterns that fail their check never are, and
only teach. A loose proposal that touches a valid base match is none.

DataFrame functions only; nothing but bounded counts is shuffled. Patterns have
no repeated groups and start only where a match can start. Offsets are prefix sums
over groups of 64 lengths, and a span's value and surroundings come from the pieces
that its pattern cuts the text into, never from the text itself: the work grows
with the text's length and with the number of spans, not with their product.

Defined results: null texts count as empty, with no spans; very long texts are read
whole; the context of a span reaches back 32 characters, at most to the match before
it; loose proposals of several kinds may overlap; equal texts and repeated rows get
equal spans; an empty table gives an empty result and learns nothing; extra columns
are carried along, but for those named like results (proposed, base, spans), which
are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import table, written

KINDS = ["email", "ip", "card", "phone", "id", "secret"]

# Private-use characters stand for a dot or blank that joins two parts, so that
# one character class can take a whole address or number.
_JOIN, _OTHER = "", ""

_LOCAL = rf"A-Za-z0-9._%+\-{_JOIN}"
_EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]+@[A-Za-z0-9-]+{_JOIN}[A-Za-z0-9\-{_JOIN}]+"
_IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
_CARD = rf"[0-9][0-9{_JOIN}]+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BARE_PHONE = r"(?<![A-Za-z0-9+.(-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9]|[.-][0-9])"
_SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]\x20?[aA][tT]\x20?[)\]]\x20?[A-Za-z0-9-]{1,63}\x20?(?:[(\[]\x20?[dD][oO][tT]\x20?[)\]]|\.)\x20?[A-Za-z]{2,24}(?![A-Za-z0-9])"
_IDENTITY = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
_OPAQUE = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}"

#: Words that announce personal data, and words that announce other numbers.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|from|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|contact)\b",
    "id": r"(?i)\b(?:ssn|social|security|identity|taxpayer)\b",
    "secret": r"(?i)(?:\b|_)(?:token|secret|password|passwd|pwd|credentials?|api_?key|access_?key|private_?key|auth|bearer)(?:\b|_)",
}
AGAINST = {
    **dict.fromkeys(KINDS, r"(?i)\b(?:version|ver|isbn|issn|doi|page|pages|section|chapter|figure|order|invoice|part|model|serial|build|rfc)\b"),
    "secret": r"(?i)\b(?:commit|revision|sha-?[0-9]*|md5|hash|checksum|digest|etag|uuid|guid|version|isbn|doi|https?)\b",
}

#: Endings, prefixes and ranges that speak for a kind.
KNOWN = {
    "email": r"(?i)[.)\]\x20](?:com|net|org|edu|gov|info|io|co|de|fr|es|it|nl|uk|us|eu|ch|at|be|pl|ru|cn|jp|br|in)$",
    "ip": r"^(?!0+\.|127\.|255\.|10\.|192\.168\.)[0-9.]+$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6011|65)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
    "id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "secret": r"^(?:AKIA|ASIA|AIza|gh[opsu]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|eyJ|SG\.|npm_|pypi-)",
}

#: What speaks against a kind: reserved, private, made up or other things.
UNLIKELY = {
    "email": r"(?i)(?:^|[.@])(?:noreply|no-reply|invalid|localhost)(?:[.@]|$)|[.)\]\x20][0-9][^.@]*$",
    "ip": r"^(?:0+|127|255|22[4-9]|23[0-9])\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$",
    "card": r"^(?:0|1|7|9)",
    "phone": r"^\(?[01]|^\+0",
    "id": r"^(?:000|666|9)|-00-|-0000$",
    "secret": r"^[A-Za-z/+-]+$|^[0-9/_+-]+$|//|-{3}|_{3}",
}

#: Lengths of which a kind mostly is, and lengths it hardly has.
LENGTHS = {"email": (6, 40, 64), "ip": (7, 15, 15), "card": (16, 23, 37), "phone": (10, 18, 24), "id": (11, 11, 11), "secret": (24, 96, 256)}

_SPAN = "struct<start:int,end:int,text:string,left:string,right:string>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _up_to(n: Column) -> Column:
    """0 to n - 1; nothing if n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(_none("int"))


_GROUP = 64


def _grouped(values: Column) -> Column:
    """Sums of groups of 64 values."""
    groups = _up_to(F.ceil(F.size(values) / F.lit(_GROUP)).cast("int"))
    return F.transform(groups, lambda g: F.aggregate(F.slice(values, g * _GROUP + 1, F.lit(_GROUP)), F.lit(0), lambda a, v: a + v))


def _sum_before(levels: list[Column], i: Column) -> Column:
    """The sum of the first i values: a part of a group on each level."""
    out, rest = F.lit(0), i
    for k, level in enumerate(levels):
        whole = F.floor(rest / F.lit(_GROUP)).cast("int") if k + 1 < len(levels) else F.lit(0)
        out = out + F.aggregate(F.slice(level, whole * _GROUP + 1, rest - whole * _GROUP), F.lit(0), lambda a, v: a + v)
        rest = whole
    return out


def _matches(df: DataFrame, wanted: dict[str, tuple[Column, str, Column, str | None]]) -> DataFrame:
    """df with a column for each name: the matches of a pattern in a column to read,
    with start and end (code points, end exclusive), the text, up to 32 characters
    before it and one behind it; empty where a condition is false. The last of the
    four is what joined characters stand for.

    The pieces between matches and the matches themselves alternate, so the sums
    of their lengths are the offsets. Steps are columns of their own, as each is used
    several times; one step is made for all patterns together, as each copies the row."""
    part = {n: {x: f"{n}_{x}" for x in ("text", "m", "p", "gaps", "one", "two", "three")} for n in wanted}
    df = df.withColumns({part[n]["text"]: F.when(only, read) for n, (read, _, only, _) in wanted.items()})
    df = df.withColumns({c["m"]: F.when(F.col(c["text"]).isNotNull(), F.regexp_extract_all(c["text"], F.lit(wanted[n][1]), F.lit(0))).otherwise(_none("string")) for n, c in part.items()})
    df = df.withColumns({c["p"]: F.when(F.size(c["m"]) > 0, F.split(c["text"], wanted[n][1], -1)).otherwise(_none("string")) for n, c in part.items()})

    def gaps(c: dict[str, str]) -> Column:
        """Of each match the distance between its start and the start of the one before."""
        at = lambda i: F.length(F.get(c["p"], i)) + F.when(i > 0, F.length(F.get(c["m"], i - 1))).otherwise(0)
        return F.transform(_up_to(F.size(c["m"])), at)

    df = df.withColumns({c["gaps"]: gaps(c) for c in part.values()})
    for low, high in (("gaps", "one"), ("one", "two"), ("two", "three")):
        df = df.withColumns({c[high]: _grouped(F.col(c[low])) for c in part.values()})

    def spans(c: dict[str, str], back: str | None) -> Column:
        m, p, levels = c["m"], c["p"], [F.col(c[x]) for x in ("gaps", "one", "two", "three")]
        plain = (lambda x: F.replace(x, F.lit(_JOIN), F.lit(back))) if back else lambda x: x

        def span(i: Column) -> Column:
            start, text = _sum_before(levels, i + 1), F.get(m, i)
            before, behind = F.get(p, i), F.get(p, i + 1)
            left = F.when(before != "", F.right(before, F.lit(32))).when(i > 0, F.right(F.get(m, i - 1), F.lit(1))).otherwise("")
            right = F.when(behind != "", F.left(behind, F.lit(1))).otherwise(F.left(F.coalesce(F.get(m, i + 1), F.lit("")), F.lit(1)))
            return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), plain(text).alias("text"), plain(left).alias("left"), plain(right).alias("right"))

        return F.transform(_up_to(F.size(m)), span)

    return df.withColumns({n: spans(c, wanted[n][3]) for n, c in part.items()}).drop(*[x for c in part.values() for x in c.values()])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).try_cast("int") * (F.lit(1) + i % 2)
        return acc + F.coalesce(F.when(d > 9, d - 9).otherwise(d), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    """The checks of base matches."""
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        d = _digits(text)
        return F.length(d).between(16, 19) & F.when(F.length(d) <= 19, _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _form(kind: str, base: bool, text: Column) -> tuple[Column, Column]:
    """Whether a value has the form of its kind, and whether it can't be one."""
    if base:
        valid = _valid(kind, text)
        return (text.rlike(r"[A-Za-z]{2,24}$") if kind == "email" else valid), ~valid
    if kind == "phone":
        d = F.right(_digits(text), F.lit(10))
        return d.rlike("^[2-9][0-9]{2}[2-9]"), d.rlike("^[01]|^[0-9]{3}[01]")
    if kind == "id":
        return text.rlike(KNOWN["id"]), ~text.rlike(KNOWN["id"])
    if kind == "secret":
        # Hexadecimal digits alone may as well be a checksum.
        d, n = F.length(_digits(text)), F.length(text)
        return text.rlike("[a-z]") & text.rlike("[A-Z]") & (d * 10 >= n), d * 20 < n
    return text.rlike(r"[A-Za-z]{2,6}$"), text.rlike(r"[0-9]$")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, "-").when(yes, "+").otherwise("0")


def _mark(c: Column) -> Column:
    return F.when(c == "", "none").when(c.rlike(r"^\s"), "blank").when(c.rlike("^[A-Za-z0-9]"), "word").otherwise("mark")


def _judged(spans: str, kind: str, base: bool) -> Column:
    """Each span with its kind, whether it is a valid base match, its votes and features."""
    low, usual, most = LENGTHS[kind]
    # A key is quoted or assigned; other values stand between blanks as well.
    opens, closes = (r"[\"'=:`]", r"^$|[\s\"'`,;)]") if kind == "secret" else (r"^$|[\s\"'(:,;<\[]", r"^$|[\s\"'),.:;!?>\]]")
    joins = r"[./#@]" if kind == "secret" else r"[A-Za-z0-9$#/_=.-]"

    def one(s: Column) -> Column:
        value, left = s["text"], s["left"]
        before, after, n = F.right(left, F.lit(1)), s["right"], F.length(value)
        good, bad = _form(kind, base, value)
        valid = _valid(kind, value) if base else F.lit(False)
        votes = F.concat(
            _vote(good, bad),
            _vote(value.rlike(KNOWN[kind]), value.rlike(UNLIKELY[kind])),
            _vote(left.rlike(CUES[kind]), left.rlike(AGAINST[kind])),
            _vote(before.rlike(opens) & after.rlike(closes), before.rlike(joins) | after.rlike("[A-Za-z0-9$#/_=@-]")),
            _vote(n.between(low, usual), (n < low) | (n > most)),
        )
        marks = F.length(F.regexp_replace(value, "[A-Za-z0-9]", ""))
        features = F.array(
            F.concat(F.lit("len:"), F.least(F.floor(n / 4), F.lit(20)).cast("string")),
            F.concat(F.lit("digits:"), F.least(F.length(_digits(value)), F.lit(20)).cast("string")),
            F.concat(F.lit("marks:"), F.least(marks, F.lit(8)).cast("string")),
            F.concat(F.lit("before:"), _mark(before)),
            F.concat(F.lit("after:"), _mark(after)),
            F.concat(F.lit("cue:"), F.when(left.rlike(CUES[kind]), "yes").when(left.rlike(AGAINST[kind]), "no").otherwise("none")),
        )
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), valid.alias("base"), F.lit(not base).alias("loose"), votes.alias("votes"), features.alias("features"))

    return F.transform(spans, one)


def _apart(spans: Column, base: Column) -> Column:
    """Spans that touch none of base, whose spans are in order and apart from one
    another: the last of them that begins before a span's end tells, and halving
    finds it."""

    def last_before(x: Column) -> Column:
        whole = F.struct(F.lit(0).alias("a"), F.size(base).alias("b"))
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(base) + F.lit(1))).cast("int"))

        def halve(acc: Column, _: Column) -> Column:
            middle = F.floor((acc["a"] + acc["b"]) / 2).cast("int")
            less = (acc["a"] < acc["b"]) & F.coalesce(F.get(base, middle)["start"] < x, F.lit(False))
            return F.struct(F.when(less, middle + 1).otherwise(acc["a"]).alias("a"), F.when(less | (acc["a"] >= acc["b"]), acc["b"]).otherwise(middle).alias("b"))

        return F.aggregate(steps, whole, halve, lambda acc: acc["a"]) - 1

    free = lambda s: F.coalesce(F.get(base, F.nullif(last_before(s["end"]), F.lit(-1)))["end"] <= s["start"], F.lit(True))
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), F.filter(spans, free)).otherwise(spans)


def propose(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text and with ``proposed``: all spans that any pattern finds.
    Columns named like results (proposed, base, spans) are replaced."""
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != text_col and c.lower() not in ("proposed", "base", "spans")]
    # Names that begin alike, so that the steps' own, which go on from them, are free as well.
    free = "found"
    while any(c.lower().startswith(free) for c in docs.columns):
        free = f"_{free}"
    text, *names = (f"{free}_{x}" for x in ("text", "email", "ip", "card", "phone", "spelled", "bare", "identity", "opaque"))
    strict, loose = dict(zip(names[:4], KINDS)), dict(zip(names[4:], ("email", "phone", "id", "secret")))
    t = F.col(text)
    clean = F.replace(t, F.lit(_JOIN), F.lit(_OTHER))
    dotted = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _JOIN)
    joined = F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", _JOIN)
    number, digits = t.rlike("[0-9]"), t.rlike(r"[0-9][0-9().\x20-]{7}")
    df = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    df = _matches(df, dict(zip(names, (
        (dotted, _EMAIL, F.instr(t, "@") > 0, "."),
        (t, _IP, t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), None),
        (joined, _CARD, t.rlike(r"[0-9][0-9\x20-]{14}"), " "),
        (t, _PHONE, F.instr(t, "+") > 0, None),
        (t, _SPELLED, t.rlike(r"[(\[]\x20?[aA][tT]\x20?[)\]]"), None),
        (t, _BARE_PHONE, digits, None),
        (t, _IDENTITY, digits, None),
        (t, _OPAQUE, number & t.rlike(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20}"), None),
    )))).drop(text)
    _, _, card, _, *_, opaque = names
    # Runs of fewer than 16 digits are ordinary numbers, not proposals; words and
    # numbers alone are no keys: letters and digits have to meet.
    df = df.withColumns({card: F.filter(card, lambda s: F.length(_digits(s["text"])) >= 16), opaque: F.filter(opaque, lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]"))})
    df = df.withColumns({n: _judged(n, kind, True) for n, kind in strict.items()})
    # Columns of their own: they are looked into for every loose proposal.
    sure = {n: f"{n}_sure" for n in strict}
    df = df.withColumns({valid: F.filter(n, lambda s: s["base"]) for n, valid in sure.items()})
    for valid in sure.values():
        df = df.withColumns({n: _apart(F.col(n), F.col(valid)) for n in loose})
    df = df.withColumns({n: _judged(n, kind, False) for n, kind in loose.items()})
    return df.select(*kept, F.concat(*[F.col(n) for n in names]).alias("proposed"))


def estimate(counts: dict[str, float], rounds: int = 50, mass: float = 250.0, votes: float = 6.0, spans: float = 25.0) -> tuple[dict[str, float], float]:
    """Dawid-Skene EM on counts of vote patterns (strings of + - 0, one character
    for each labeler; 0, an abstention, tells nothing): the probability that a span
    with that pattern is true, and the share of true spans.

    Starts from the majority of votes. Counts are taken as shares of ``mass`` spans,
    so that what is known beforehand weighs the same in a corpus of any size: that
    a vote is right four times of five (``votes`` times five of each labeler in
    either class), and that there are true spans and others (``spans`` of each)."""
    whole = sum(counts.values())
    counts = {p: n * mass / whole for p, n in sorted(counts.items())}
    q = {p: (1 + p.count("+")) / (2 + p.count("+") + p.count("-")) for p in counts}
    share = 0.5
    for _ in range(rounds):
        share = (spans + sum(n * q[p] for p, n in counts.items())) / (2 * spans + mass)
        odds = []  # of each labeler, the log-odds of a vote between the classes
        for j in range(len(next(iter(counts), ""))):
            yes, no = {"+": 4 * votes, "-": votes}, {"+": votes, "-": 4 * votes}
            for p, n in counts.items():
                if p[j] != "0":
                    yes[p[j]] += n * q[p]
                    no[p[j]] += n * (1 - q[p])
            a, b = sum(yes.values()), sum(no.values())
            odds.append({"0": 0.0, **{v: math.log(yes[v] / a) - math.log(no[v] / b) for v in "+-"}})
        for p in counts:
            x = math.log(share / (1 - share)) + sum(odds[j][v] for j, v in enumerate(p))
            q[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))
    return q, share


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])[key], F.lit(default))


def decide(proposed: DataFrame, threshold: float = 0.9) -> DataFrame:
    """proposed with ``base`` and ``spans``: arrays of (order, start, end, kind),
    by kind and start; spans adds to base what the trained classifier accepts.

    threshold: how probable an added span must be by its votes (EM), and by votes
    and classifier together: the odds of the votes times those of each feature.
    """
    each = proposed.select(F.explode("proposed").alias("s")).select("s.*")
    counts: dict[str, dict[str, float]] = {}
    for kind, votes, n in each.groupBy("kind", "votes").count().collect():  # 3^5 for each kind at most
        counts.setdefault(kind, {})[votes] = float(n)
    trust = {f"{kind}|{v}": p for kind, by_votes in counts.items() for v, p in estimate(by_votes)[0].items()}
    # Votes alone never make a span more certain than a thousand to one.
    odds = {k: max(-7.0, min(7.0, math.log(max(p, 1e-12)) - math.log(max(1 - p, 1e-12)))) for k, p in trust.items()}
    p = _lookup(trust, F.concat_ws("|", "kind", "votes"), 0.0)
    soft = each.select("kind", F.explode("features").alias("feature"), p.alias("p"))
    weights: dict[str, float] = {}
    seen = [tuple(r) for r in soft.groupBy("kind", "feature").agg(F.sum("p"), F.sum(1 - F.col("p"))).collect()]  # buckets: bounded
    for kind in counts:
        groups: dict[str, list[tuple[str, float, float]]] = {}
        for k, f, yes, no in seen:
            if k == kind:
                groups.setdefault(f.split(":")[0], []).append((f, yes, no))
        for rows in groups.values():
            # Either class is mixed with a tenth of all spans, so that a rare feature tells nothing without a difference.
            a, b = sum(r[1] for r in rows), sum(r[2] for r in rows)
            for f, yes, no in rows:
                weights[f"{kind}|{f}"] = math.log((yes + (yes + no) / 10) / (a + (a + b) / 10)) - math.log((no + (yes + no) / 10) / (b + (a + b) / 10))

    least = math.log(threshold / (1 - threshold))

    def probable(s: Column) -> Column:
        votes = _lookup(odds, F.concat_ws("|", s["kind"], s["votes"]), -7.0)
        score = F.aggregate(s["features"], votes, lambda acc, f: acc + _lookup(weights, F.concat_ws("|", s["kind"], f), 0.0))
        return (votes >= least) & (score >= least)

    def keyed(spans: Column) -> Column:
        order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
        return F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    spans = F.filter("proposed", lambda s: s["base"] | (s["loose"] & probable(s)))
    return proposed.withColumns({"base": keyed(F.filter("proposed", lambda s: s["base"])), "spans": keyed(spans)}).drop("proposed")


def find_personal_data(docs: DataFrame, text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """docs without the text and with base and spans (see decide)."""
    proposed, _ = written(propose(docs, text_col), "pii-proposed")  # counted, and read again for the result
    return decide(proposed, threshold)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    numbers = [_count(k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *numbers, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
