"""Preference formatting: a prompt rendered once, and two masked completions.

A pair is a chosen and a rejected conversation under one pair_id. The turns of
both sides are brought together by (pair, turn) in one aggregate, which also
combines repeated rows before the shuffle; a turn that is the same on both sides
travels once. The smallest turn at which the sides differ ends the common
prefix: turns before it are the prompt, the rest of each side its completion.
Only what an assistant says (with the mark that ends it) is trained on: the
masks list those character ranges, end exclusive, of each completion.

A pair's strings are put together in parts of ``turns_per_part`` turn numbers,
so memory is bounded by a part: a longer conversation fills several rows, whose
strings in part order make up the whole. Ordinary ones have part 0 only. Lines are
dealt by (pair, part), so the parts of one pair go to many tasks; where the prefix
ends is found from a number for each part, and joined to the parts.

Defined results: repeated rows for one pair, side and turn count once (of several
the least role and text); very long texts are kept whole; a null role is
``unknown``; null texts are empty; rows with a null pair or turn belong to no
conversation; a side that has no turns is an empty completion; equal sides are all
prompt; ``<|`` in a text is written ``< |``, so that no text can open or close a
turn; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.common import table, written

# Fixed values of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _tidy(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _head(said: Column) -> Column:
    return F.concat(F.lit(OPEN), _tidy(said["role"]), F.lit("\n"))


def _body(said: Column) -> Column:
    return F.concat(_tidy(said["text"]), F.lit(CLOSE))


def _joined(said: Column) -> Column:
    return F.array_join(F.transform(said, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _mask(said: Column) -> Column:
    """Ranges start:end of the assistant's bodies in the joined string, by comma."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def more(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(_body(t))
        span = F.concat(F.when(acc["out"] == "", "").otherwise(","), begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(said, start, more, lambda acc: acc["out"])


def format_sides(turns: DataFrame, turns_per_part: int = 4096) -> DataFrame:
    """As format_preferences, from one table of pair_id, turn, side, role, text;
    side is chosen, rejected, or both for turns that the sides share."""
    said = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = turns.filter("pair_id is not null and turn is not null").groupBy("pair_id", "turn")
    sides = one.agg(F.min(F.when(F.col("side") != "rejected", said)).alias("c"), F.min(F.when(F.col("side") != "chosen", said)).alias("r"))
    differs = ~F.col("c").eqNullSafe(F.col("r"))
    part = F.floor(F.col("turn") / F.lit(turns_per_part)).cast("long").alias("part")
    lines = sides.select("pair_id", part, "turn", "c", F.when(differs, F.col("r")).alias("r"), differs.alias("differs"))
    # Read twice: once for where the sides differ, without their texts.
    lines, _ = written(lines, "pair-lines")
    here = lines.groupBy("pair_id", "part").agg(F.min(F.when(F.col("differs"), F.col("turn"))).alias("here"))
    upto = Window.partitionBy("of_pair").orderBy("of_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = here.select(F.col("pair_id").alias("of_pair"), F.col("part").alias("of_part"), "here").withColumn("cut", F.min("here").over(upto)).drop("here")
    parts = lines.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "c", "r", "differs"))).alias("lines"))
    parts = parts.join(cuts, (F.col("pair_id") == F.col("of_pair")) & (F.col("part") == F.col("of_part")))
    common, rest = F.filter("lines", _before), F.filter("lines", lambda t: ~_before(t))
    prompt = F.transform(common, lambda t: t["c"])
    chosen = F.filter(F.transform(rest, lambda t: t["c"]), lambda t: t.isNotNull())
    rejected = F.filter(F.transform(rest, lambda t: F.when(t["differs"], t["r"]).otherwise(t["c"])), lambda t: t.isNotNull())
    return parts.select(
        "pair_id", "part", F.size(prompt).alias("prompt_turns"), _joined(prompt).alias("prompt"), _joined(chosen).alias("chosen"), _joined(rejected).alias("rejected"),
        _mask(chosen).alias("chosen_mask"), _mask(rejected).alias("rejected_mask"),
    )


def _before(line: Column) -> Column:
    return F.coalesce(line["turn"] < F.col("cut"), F.lit(True))


def format_preferences(chosen: DataFrame, rejected: DataFrame, turns_per_part: int = 4096) -> DataFrame:
    """pair_id, part, prompt_turns, prompt, chosen, rejected, chosen_mask and
    rejected_mask from two tables of pair_id, turn, role, text."""
    names = ["pair_id", "turn", "role", "text"]
    both = chosen.select(*names, F.lit("chosen").alias("side")).union(rejected.select(*names, F.lit("rejected").alias("side")))
    return format_sides(both, turns_per_part)


def swapped_reply_turns(conversations: DataFrame) -> DataFrame:
    """Pairs for training where no rated ones exist, as format_sides reads them:
    chosen is each conversation up to its last assistant turn (what follows it is
    no part of the pair); rejected ends with the last reply of its neighbour
    (conv_id with the last bit flipped) instead, or an empty one. Of several replies
    in that turn the greatest text counts. A conversation without a reply is all
    prompt, with empty completions."""
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").filter("pair_id is not null and turn is not null")
    replies = turns.filter("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("l"))
    # Without its text: the conversations are joined with numbers only.
    last = turns.groupBy("pair_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_turn"))
    kept = turns.join(last, "pair_id").filter("last_turn is null or turn <= last_turn")
    own = kept.select("pair_id", "turn", "role", "text", F.when(F.col("turn") == F.col("last_turn"), "chosen").otherwise("both").alias("side"))
    wrong = last.filter("last_turn is not null").join(replies.select(F.expr("pair_id ^ 1").alias("pair_id"), "l.text"), "pair_id", "left")
    return own.union(wrong.select("pair_id", F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit("rejected").alias("side")))


def op7_preference_format(spark, sf_dir: str) -> DataFrame:
    return format_sides(swapped_reply_turns(table(spark, sf_dir, "conversations")))
