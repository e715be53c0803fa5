"""Cells of many pages at once against the search page by page; and which pages that search is left."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from quire.kernels import aligned, grid
from quire.operators.udf import word_rows

WORDS = pa.list_(pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")] + [("text", pa.string())]))
CELLS = pa.list_(pa.struct([(c, pa.string() if c == "text" else pa.int32()) for c in grid.Cell._fields]))


def _page(r: random.Random, columns: int, rows: int, pitch: float, loose: float, height: float):
    own = []
    for i in range(rows):
        for j in range(columns):
            if loose and r.random() < 0.05:
                continue
            text = r.choice(["1", "23", "4567", "x9", "y"]) * r.choice([1, 1, 1, 3]) if r.random() > 0.001 else r.choice(["", " a", "b　", "あ", None])
            x, y = 40 + pitch * j + r.random() * loose, 12 * i + (r.random() if loose == 1 else 0.0)
            own.append({"x0": x, "y0": y, "x1": x + 6 * len(text or ""), "y1": y + height, "text": text})
    if r.random() < 0.9:
        own.sort(key=lambda w: (w["y0"], w["x0"]))
    return own


def _searched(page):
    found = grid.best_for_page(word_rows(page))
    return None if found is None else [c._asdict() for c in found.cells]


@pytest.mark.parametrize("at_once", [300, aligned.WORDS_AT_ONCE])
def test_cells_are_those_of_the_search(monkeypatch, at_once):
    r = random.Random(at_once)
    monkeypatch.setattr(aligned, "WORDS_AT_ONCE", at_once)
    pick = lambda: (r.randint(1, 8), r.choice([0, 3, 8, 9, 20]), r.choice([20, 40, 60, 90, 160.3]), r.choice([0, 0, 0, 1, 8, 40]), r.choice([10, 10, 4, 30]))
    pages = [None if r.random() < 0.05 else _page(r, *pick()) for _ in range(400)]
    want = [_searched(p) for p in pages]
    rows = pa.array(pages, WORDS)
    assert aligned.page_cells(rows, CELLS, word_rows).to_pylist() == want and sum(w is not None for w in want) > 50
    assert aligned.page_cells(rows.slice(7, 300), CELLS, word_rows).to_pylist() == want[7:307]
    assert aligned.page_cells(rows.slice(0, 0), CELLS, word_rows).to_pylist() == []


def test_printed_pages_need_no_search(monkeypatch):
    r = random.Random(2)
    pages = [_page(r, columns, 20, 160, 0, 10) for columns in (3, 4, 5, 6)] * 5
    pages = [[w | {"text": "7", "x1": w["x0"] + 6} for w in p] for p in pages]
    want = [_searched(p) for p in pages]
    monkeypatch.setattr(aligned.grid, "best_for_page", lambda words: pytest.fail("a page was searched alone"))
    assert aligned.page_cells(pa.array(pages, WORDS), CELLS, word_rows).to_pylist() == want and None not in want
