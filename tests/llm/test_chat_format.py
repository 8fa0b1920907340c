from gridwright.llm.chat_format import CLOSE, OPEN, format_preferences, op7_preference_format
from tests.llm.odd import collected

TURNS = "pair_id long, turn long, role string, text string, prompt string, part int"


def brute(chosen, rejected):
    """Two lists of (turn, role, text) in order."""
    show = lambda role, text: (f"{OPEN}{role.replace('<|', '< |')}\n", f"{text.replace('<|', '< |')}{CLOSE}")
    c, r = {t: (a, b) for t, a, b in chosen}, {t: (a, b) for t, a, b in rejected}
    cut = min((t for t in {*c, *r} if c.get(t) != r.get(t)), default=None)
    out = {"prompt": "", "n": 0}
    for t in sorted(c):
        if cut is None or t < cut:
            out["prompt"] += "".join(show(*c[t])) + "\n"
            out["n"] += 1
    for name, side in (("chosen", c), ("rejected", r)):
        s, mask = "", []
        for t in sorted(side):
            if cut is not None and t >= cut:
                head, body = show(*side[t])
                if side[t][0] == "assistant":
                    mask.append(f"{len(s) + len(head)}:{len(s) + len(head) + len(body)}")
                s += head + body + "\n"
        out[name], out[name + "_mask"] = s, ",".join(mask)
    return out


def test_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet").collect()
    turns = {}
    for r in rows:
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    last = {c: max((t for t in ts if t[1] == "assistant"), default=None) for c, ts in turns.items()}
    want = {}
    for c, ts in turns.items():
        if last[c]:
            chosen = [t for t in ts if t[0] <= last[c][0]]
            wrong = last.get(c ^ 1)
            want[c] = brute(chosen, [(t, a, (wrong[2] if wrong else "") if t == last[c][0] else x) for t, a, x in chosen])
        else:
            want[c] = brute(ts, ts)
    got = op7_preference_format(spark, data).collect()
    assert {r.pair_id for r in got} == set(want)
    for r in got:
        w = want[r.pair_id]
        assert (r.part, r.prompt_turns, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) == (0, w["n"], w["prompt"], w["chosen"], w["rejected"], w["chosen_mask"], w["rejected_mask"])


def test_odd_rows(spark):
    a = [(1, 0, "user", "hi", "p", 9), (1, 1, "assistant", "yes", "p", 9), (1, 2, "user", "<|im_end|>", "p", 9), (1, 2, "user", "<|im_end|>", "p", 9), (2, 0, None, None, "p", 9), (None, 0, "user", "x", "p", 9), (4, None, "user", "x", "p", 9), (5, 0, "user", "same", "p", 9)]
    b = [(1, 0, "user", "hi", "p", 9), (1, 1, "assistant", "no", "p", 9), (3, 0, "assistant", "alone", "p", 9), (5, 0, "user", "same", "p", 9)]
    got = {r.pair_id: r for r in format_preferences(spark.createDataFrame(a, TURNS), spark.createDataFrame(b, TURNS)).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert got[1].prompt == f"{OPEN}user\nhi{CLOSE}\n" and got[1].prompt_turns == 1
    assert got[1].chosen.count(CLOSE) == 2 and "< |im_end|>" in got[1].chosen
    begin, end = map(int, got[1].chosen_mask.split(":"))
    assert got[1].chosen[begin:end] == f"yes{CLOSE}"
    assert got[2].chosen == f"{OPEN}unknown\n{CLOSE}\n" and got[2].chosen_mask == "" and got[2].rejected == ""
    assert got[3].chosen == "" and got[3].rejected_mask
    assert got[5].chosen == got[5].rejected == "" and got[5].prompt_turns == 1
    empty = spark.createDataFrame([], TURNS)
    assert collected(format_preferences(empty, empty)) == []


def test_long_conversations_fill_parts(spark):
    turns = [(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(50)]
    other = [(p, t, r, x if t < 30 else x + "!") for p, t, r, x in turns]
    schema = "pair_id long, turn long, role string, text string"
    a, b = spark.createDataFrame(turns, schema), spark.createDataFrame(other, schema)
    whole = format_preferences(a, b).first()
    parts = sorted(format_preferences(a, b, turns_per_part=7).collect(), key=lambda r: r.part)
    assert len(parts) == 8
    for name in ("prompt", "chosen", "rejected"):
        assert "".join(r[name] for r in parts) == whole[name]


def test_one_pair_fills_many_tasks(spark):
    """The parts of a pair meet in no window or task; the cut holds for all of them."""
    from pyspark.sql import functions as F

    turns = spark.range(0, 3000).select(F.lit(1).cast("long").alias("pair_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    other = turns.withColumn("text", F.when(F.col("turn") < 1701, F.col("text")).otherwise("else"))
    df = format_preferences(turns, other, turns_per_part=50)
    rows = {r.part: r for r in df.collect()}
    assert sorted(rows) == list(range(60)) and sum(r.prompt_turns for r in rows.values()) == 1701
    assert rows[33].chosen == "" and rows[34].prompt_turns == 1 and rows[35].prompt == ""
    tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1 or int(spark.conf.get("spark.sql.shuffle.partitions")) == 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_a_conversation_without_a_reply_is_all_prompt(spark):
    from gridwright.llm.chat_format import format_sides, swapped_reply_turns

    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "thanks")]
    got = {r.pair_id: r for r in format_sides(swapped_reply_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert (got[1].prompt_turns, got[1].chosen, got[1].rejected) == (2, "", "")
    assert got[2].prompt_turns == 1 and "thanks" not in got[2].prompt + got[2].chosen and got[2].rejected.endswith(f"{OPEN}assistant\n{CLOSE}\n")
