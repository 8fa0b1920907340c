import json

import pytest

from gridwright.plans.workbook import Workbook
from gridwright.sources.grid import add_sheet, read_sheet


def test_calls_change_the_active_sheet(spark, text_grid, cells):
    book = Workbook(spark, "book_a")
    book._write(text_grid(k=["b", "a", "b"], v=[" 1", "2 ", "3"]), "book_a")
    report = book.call("clean", "text-ops", {"column": "v"})
    assert report["stats"]["changed"] == 2
    assert book.call("clean", "remove-duplicates", {"mode": "one", "column": "k"})["stats"]["remaining"] == 2
    assert cells(book.grid()) == [("b", "1"), ("a", "2")]
    assert book.call("clean", "detect-dup-key", {"key_columns": "k"})["stats"]["duplicate_rows"] == 0
    assert cells(book.grid()) == [("b", "1"), ("a", "2")]
    with pytest.raises(NotImplementedError):
        book.call("ml", "anything")


def test_a_failed_call_leaves_the_sheet(spark, text_grid, cells):
    book = Workbook(spark, "book_b")
    book._write(text_grid(v=["1", "9"]), "book_b")
    with pytest.raises(ValueError):
        book.call("clean", "remove-outliers", {"column": "v", "method": "none"})
    assert cells(book.grid()) == ["1", "9"]


def test_backend(spark, text_grid, cells):
    asked = []

    def backend(tier, message):
        asked.append((tier, json.loads(message)))
        if tier == "viz":
            return json.dumps({"new_sheet": {"name": "book_d", "headers": ["n"], "rows": [[1], [2]]}, "summary": "made"})
        if tier == "ai":
            raise RuntimeError("down")
        return json.dumps({"headers": ["x"], "rows": [["y"]], "summary": {"ok": 1}})

    book = Workbook(spark, "book_c", backend=backend)
    book._write(text_grid(v=["1", None]), "book_c")
    assert book.call("viz", "chart", {"a": 1}) == "made"
    assert asked[0][1]["rows"] == [["1"], [None]] and asked[0][1]["params"] == {"a": 1}
    assert read_sheet(spark, "book_d").df.count() == 2
    assert book.call("clean", "text-ops") == {"ok": 1}
    assert cells(book.grid()) == ["y"] and book.grid().headers == ("x",)
    with pytest.raises(RuntimeError):
        book.call("ai", "x")
    with pytest.raises(KeyError):
        book.call("nothing", "x")


def test_a_sheet_can_replace_what_it_reads(spark, text_grid):
    add_sheet(text_grid(a=["1", "2"]), "book_e")
    add_sheet(read_sheet(spark, "book_e"), "book_e")
    assert read_sheet(spark, "book_e").df.count() == 2


def test_marks_stay_with_a_sheet(spark, text_grid):
    from gridwright.sources.grid import highlighted

    grid = highlighted(highlighted(text_grid(a=["1"]), "A1:B2", "#ff0"), "C'3", 'r"e\\d')
    add_sheet(grid, "book_f")
    assert read_sheet(spark, "book_f").marks == (("A1:B2", "#ff0"), ("C'3", 'r"e\\d'))
    assert highlighted(grid, "A1:B2", "#00f").marks == (("C'3", 'r"e\\d'), ("A1:B2", "#00f"))
    book = Workbook(spark, "book_f")
    book._write(grid, "book_f")
    book.call("clean", "text-ops", {"column": "a"})
    assert book.grid().marks == grid.marks


def test_a_sheet_beside_others_of_like_names(spark, text_grid):
    add_sheet(text_grid(a=["1"]), "book_g__new")
    add_sheet(text_grid(a=["1", "2"]), "book_g")
    add_sheet(text_grid(a=["1", "2", "3"]), "book_g")
    assert read_sheet(spark, "book_g__new").df.count() == 1 and read_sheet(spark, "book_g").df.count() == 3
    assert not [t for t in (x.name for x in spark.catalog.listTables()) if t.startswith("book_g__new_") or t.startswith("book_g__old_")]


def test_large_grids_go_as_files(spark, text_grid, cells, tmp_path):
    def backend(tier, message):
        body = json.loads(message)
        assert "rows" not in body
        lines = [json.loads(line) for f in sorted((tmp_path / "x").glob("request-*/part-*")) for line in open(f)]
        assert sorted((x["position"], x["c0"], x["c1"]) for x in lines) == [(i, str(i), None if i % 2 else "y") for i in range(50)]
        (tmp_path / "answer.json").write_text("".join(json.dumps({**x, "c0": x["c0"] + "!"}) + "\n" for x in reversed(lines)))
        return json.dumps({"headers": body["headers"], "files": str(tmp_path / "answer.json"), "summary": "done"})

    grid = text_grid(a=[str(i) for i in range(50)], b=[None if i % 2 else "y" for i in range(50)])
    book = Workbook(spark, "book_h", backend=backend, exchange=str(tmp_path / "x"), most_rows=20)
    book._write(grid, "book_h")
    assert book.call("ml", "some") == "done"
    assert cells(book.grid()) == [(f"{i}!", None if i % 2 else "y") for i in range(50)]
