import random
from collections import Counter

from gridwright.llm.license_scan import TEMPLATES, Templates, dice, scan_licenses, scan_text, words_of
from tests.llm.odd import collected

KNOWN = Templates(TEMPLATES, 0.8)


def best_of_all(text):
    """Dice against every template, without any bound."""
    grams = lambda t: Counter(zip(words_of(t), words_of(t)[1:]))
    scored = [(dice(grams(text), grams(t)), name) for name, t in TEMPLATES]
    top = max(s for s, _ in scored)
    return (top, min(n for s, n in scored if s == top)) if top >= 0.8 else None


def test_bounds_lose_nothing(documents):
    lines = [line for r in documents.collect() for line in r.text.split("\n")][:1500] + [t for _, t in TEMPLATES]
    lines += [t.replace("the", "a") for _, t in TEMPLATES] + [t + " and more words after it" for _, t in TEMPLATES]
    for line in lines:
        w = words_of(line)
        got = KNOWN.best(w, int(KNOWN.hits(w).sum())) if len(w) > 1 else None
        assert got == best_of_all(line), line


def test_every_template_is_found_inside_a_text():
    for name, text in TEMPLATES:
        got = scan_text(f"Some words stand here first.\n\nCopyright (c) 2020 Someone\n{text}\n\nThen others follow, quite unlike.", KNOWN)
        assert [g[0] for g in got] == [name] and got[0][1] > 0.95, (name, got)


def test_lines_of_notices():
    text = "One line.\nReleased under the MIT License.\nanother line of words\nLicensed under CC BY-NC 4.0.\nend"
    assert scan_text(text, KNOWN) == [("MIT", 1.0, 1, 1), ("CC-BY-NC-4.0", 1.0, 3, 3)]
    assert scan_text("the licence of the author is the text of the work", KNOWN) == []


def test_very_many_notices():
    text = "\n".join(["Released under the MIT License.", "and so on with others"] * 20_000)
    got = scan_text(text, KNOWN)
    assert len(got) == 20_000 and got[7] == ("MIT", 1.0, 14, 14)


def test_odd_rows(odd, none, spark):
    got = collected(scan_licenses(odd), "doc_id", "license", "dice", "first_line", "last_line")
    assert got == [(18, "MIT", 1.0, 0, 0)]
    assert scan_licenses(none).count() == 0
    own = scan_licenses(odd, templates=[("own", "some words here"), ("empty", ""), ("one", "word")])
    assert collected(own, "doc_id", "license", "first_line") == [(18, "own", 2)]
    assert scan_licenses(odd, templates=[]).count() == 0


def whole(name):
    return next(t for n, t in TEMPLATES if n == name)


def test_licences_one_after_another():
    """Under two holders, of two kinds, and run together on one line."""
    mit, bsd = whole("MIT"), whole("BSD-2-Clause")
    assert scan_text(f"Copyright (c) 2020 A\n\n{mit}\n\nCopyright (c) 2021 B\n\n{mit}", KNOWN) == [("MIT", 1.0, 2, 6), ("MIT", 1.0, 10, 14)]
    assert [g[:2] for g in scan_text(f"{mit}\n\n{bsd}", KNOWN)] == [("MIT", 1.0), ("BSD-2-Clause", 1.0)]
    line = " ".join(f"some words {mit} others {bsd} and a third {mit} at the end".split())
    assert scan_text(line, KNOWN) == [("MIT", 1.0, 0, 0), ("BSD-2-Clause", 1.0, 0, 0), ("MIT", 1.0, 0, 0)]


def test_one_word_lines_do_not_end_a_licence():
    w = whole("MIT").split()
    for cut in (40, 80, 120):
        text = "\n".join([" ".join(w[:cut]), w[cut], "", " ".join(w[cut + 1 :])])
        assert scan_text(text, KNOWN) == [("MIT", 1.0, 0, 3)]


def test_notices_inside_a_line():
    text = "This page, with others, is released under the MIT License. The photographs are licensed under CC BY-SA 4.0 and stay with their authors."
    assert scan_text(text, KNOWN) == [("MIT", 1.0, 0, 0), ("CC-BY-SA-4.0", 1.0, 0, 0)]
    assert scan_text("Note that this work is licensed under the following terms, which nobody else has.", KNOWN) == []


def test_altered_licence_stays_whole():
    text = whole("Apache-2.0").replace("governing", "ruling").replace("distributed on", "given out on")
    assert [(g[0], g[2], g[3]) for g in scan_text(text, KNOWN)] == [("Apache-2.0", 0, 4)]


def test_units_against_all_runs_of_words():
    """A text has a match where any run of words has one, and only there."""
    rng = random.Random(3)
    for threshold in (0.6, 0.8):
        own = [(f"t{i}", " ".join(rng.choice("abcd") for _ in range(n))) for i, n in enumerate((3, 5, 8, 12))]
        known, hits = Templates(own, threshold), 0
        for _ in range(1500):
            parts = [[rng.choice("abcdxyz") for _ in range(rng.randrange(1, 7))] for _ in range(rng.randrange(1, 5))]
            text = "".join(" ".join(p) + rng.choice([".\n", "\n", ". ", "\n\n"]) for p in parts)
            words = [w for p in parts for w in p]
            ends = [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
            opens = {0, *ends}
            want = False
            for a in range(len(words)):
                for b in range(a + 2, len(words) + 1):
                    run = Counter(zip(words[a:b], words[a + 1 : b]))
                    for _, t in own:
                        grams = Counter(zip(t.split(), t.split()[1:]))
                        if b - a >= len(t.split()) or (a in opens and b in ends):
                            want |= dice(run, grams) >= threshold - 1e-9
            got = scan_text(text, known)
            assert bool(got) == want, text
            hits += want
        assert 20 < hits < 1480


def test_copyright_lines_keep_the_rest():
    mit, bsd = whole("MIT"), whole("BSD-3-Clause")
    assert scan_text("Copyright 2020 X. Released under the MIT License.", KNOWN) == [("MIT", 1.0, 0, 0)]
    assert scan_text("Copyright 2020 X Released under the MIT License.", KNOWN) == [("MIT", 1.0, 0, 0)]
    assert scan_text(" ".join(f"Copyright (c) 2020 X {mit}".split()), KNOWN) == [("MIT", 1.0, 0, 0)]
    long = "Copyright \xa9 2019-2021, 2023 by Someone & Others, Inc. All rights reserved. Copyright 2001 Y. All rights reserved."
    assert scan_text(" ".join(f"{long} {bsd}".split()), KNOWN) == [("BSD-3-Clause", 1.0, 0, 0)]
    # A holder without an end: a bounded number of words is left out.
    altered = "Copyright 2020 X Hereby permission " + mit.split(" ", 1)[1]
    assert scan_text(" ".join(altered.split()), KNOWN)[0][0] == "MIT"
    # Statements alone on a line don't count, wherever they stand.
    first, _, rest = mit.partition("\n\n")
    assert scan_text(f"{first}\n  Copyright (c) 2020 Someone Of That Name\n* Copyright 2021 Others. All rights reserved.\n{rest}", KNOWN) == [("MIT", 1.0, 0, 5)]


def test_a_line_wrapped_before_copyright():
    w = whole("MIT").split()
    assert scan_text("\n".join(w), KNOWN) == [("MIT", 1.0, 0, len(w) - 1)]
    text = whole("BSD-3-Clause").replace(" copyright ", "\ncopyright ").replace(" COPYRIGHT ", "\nCOPYRIGHT ")
    assert [g[:2] for g in scan_text(text, KNOWN)] == [("BSD-3-Clause", 1.0)]


def test_statements_that_begin_with_a_sign():
    first, _, rest = whole("MIT").partition("\n\n")
    for line in ("(c) 2020 Someone Of That Name", "\xa9 2019-2021 Others Of Another Name And Company", "  * (C) 2020, 2022 by X. All rights reserved."):
        assert scan_text(f"{first}\n{line}\n{rest}", KNOWN) == [("MIT", 1.0, 0, 4)], line
    assert scan_text("(c) 2021 X. Released under the MIT License.", KNOWN) == [("MIT", 1.0, 0, 0)]


def test_adjacent_and_nested_notices():
    mit, isc, bsd = whole("MIT"), whole("ISC"), whole("BSD-3-Clause")
    names = lambda text: [g[0] for g in scan_text(text, KNOWN)]
    assert names(f"{mit}\nCopyright (c) 2020 X\n{isc}") == ["MIT", "ISC"]
    assert names(f"{mit}\n\n{bsd}\n\n{isc}") == ["MIT", "BSD-3-Clause", "ISC"]
    assert names(f"Licensed under CC BY 4.0.\n{mit}") == ["CC-BY-4.0", "MIT"]
    assert names("Two: Released under the MIT License. Licensed under CC BY 4.0.") == ["MIT", "CC-BY-4.0"]


def test_kinds_of_one_family_are_told_apart():
    for name, text in TEMPLATES:
        if name.startswith("CC-") or name in ("Unlicense", "Zlib", "BSL-1.0", "CC0-1.0"):
            assert [(g[0], g[1]) for g in scan_text(f"Words before.\n{text}\nWords after.", KNOWN)] == [(name, 1.0)], text
