"""The cells of many pages' tables at once, in numpy.

A page whose rows all have the same number of words, each in a column of its own, has a faultless grid, which ends the search of grid.best_for_page;
it is found here by the same steps on arrays of all pages. Every other page goes to that function, so results are the same for all.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.functions.text import SPACE
from quire.kernels import grid

MOST_COLUMNS = 6  # as best_for_page tries
WORDS_AT_ONCE = 1 << 16
_RAGGED = rf"^$|^[{SPACE}]|[{SPACE}]$"


class Words(NamedTuple):
    """Words of pages: where each page's words begin (and the end), and the words' boxes."""

    begin: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.begin)

    def pages(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), self.counts())

    def of(self, pages: np.ndarray) -> tuple[Words, np.ndarray]:
        """The words of some pages, given by a mask, and their places here."""
        at = np.flatnonzero(np.repeat(pages, self.counts()))
        return Words(_begins(self.counts()[pages]), *(c[at] for c in self[1:])), at


def _begins(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns differs from the word before; the first word is a change."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _any(flags: np.ndarray, pages: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(pages[flags], minlength=n) > 0


def _medians(values: np.ndarray, pages: np.ndarray, w: Words) -> np.ndarray:
    own, n = values[np.lexsort((values, pages))], w.counts()
    return (own[w.begin[:-1] + (n - 1) // 2] + own[w.begin[:-1] + n // 2]) / 2


def likely(w: Words, digits: np.ndarray, least: float = 0.75) -> np.ndarray:
    """Pages whose grid.likelihood is at least that; words in reading order."""
    pages, n = w.pages(), len(w.begin) - 1
    begins = _changes(pages, np.rint(w.y0 / 5.0))
    row = np.cumsum(begins) - 1
    of_row = pages[begins]
    rows = np.bincount(of_row, minlength=n)
    several = np.bincount(of_row[np.bincount(row, minlength=len(of_row)) >= 3], minlength=n)
    bins = np.rint(w.x0 / 20.0)
    order = np.lexsort((bins, pages))  # stable: a bin's words stay in rows' order
    p, b, r = pages[order], bins[order], row[order]
    starts = _changes(p, b)
    number = np.bincount((np.cumsum(starts) - 1)[_changes(p, b, r)], minlength=int(starts.sum()))
    of_bin = p[starts]
    aligned = np.bincount(of_bin[number >= np.maximum(3, np.rint(0.35 * rows))[of_bin]], minlength=n)
    words = w.counts()
    enough = (words >= 12) & (rows >= 6)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = 0.55 * np.minimum(1.0, aligned / 3) + 0.30 * (several / rows) + 0.15 * (np.bincount(pages[digits], minlength=n) / words)
        return enough & (np.maximum(0.0, np.minimum(1.0, score)) >= least)


@lru_cache(4096)
def _search(anchors: bytes, columns: int) -> tuple[list[float], list[float]]:
    """From the most columns down to that number: the least distance of centres; and that number's cutoffs. Pages of one form share their anchors."""
    points, apart, centers = np.frombuffer(anchors).tolist(), [], []
    for k in range(MOST_COLUMNS, columns - 1, -1):
        centers = sorted(grid.clusters(points, k) or ())
        apart.append(min((b - a for a, b in zip(centers, centers[1:], strict=False)), default=0.0))
    return apart, [(a + b) / 2 for a, b in zip(centers, centers[1:], strict=False)]


def _faultless(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of likely pages: which have too few rows for a table, which have a faultless grid, and the words in its order with their rows and columns."""
    pages, n = w.pages(), len(w.begin) - 1
    height, width = _medians(np.maximum(0.0, w.y1 - w.y0), pages, w), _medians(np.maximum(0.0, w.x1 - w.x0), pages, w)
    key = np.rint((w.y0 + w.y1) / 2 / np.maximum(4.0, 0.75 * height)[pages])
    order = np.lexsort((w.x0, key, pages))
    key, x0, x1 = key[order], w.x0[order], w.x1[order]
    begins = _changes(pages, key)
    starts, row = np.flatnonzero(begins), np.cumsum(begins) - 1
    rows = np.bincount(pages[begins], minlength=n)
    few = rows < grid.LEAST_ROWS
    columns = w.counts() // rows
    good = ~few & (columns >= 2) & (columns <= MOST_COLUMNS)
    good &= ~_any((np.bincount(row) != columns[pages[begins]]), pages[begins], n)
    near = np.zeros(len(x0), bool)
    near[1:] = ~begins[1:] & (x0[1:] - x1[:-1] <= np.maximum(12.0, 1.2 * height)[pages[1:]])
    good &= ~_any(near, pages, n)  # a group of several words
    anchors = w.x0[np.lexsort((w.x0, pages))]
    span = np.maximum(1e-6, np.maximum.reduceat(w.x1, w.begin[:-1]) - np.minimum.reduceat(w.x0, w.begin[:-1]))
    cuts = np.full((n, MOST_COLUMNS), np.inf)  # nothing ends the last column
    for i in np.flatnonzero(good):
        apart, own = _search(anchors[w.begin[i] : w.begin[i + 1]].tobytes(), int(columns[i]))
        *more, last = (a >= max(6.0, min(1.5 * width[i], 0.65 * span[i] / k)) for a, k in zip(apart, range(MOST_COLUMNS, 0, -1), strict=False))
        good[i] = last and not any(more) and apart[-1] / max(1.0, 3.0 * width[i]) >= 1
        cuts[i, : len(own)] = own
    col = np.arange(len(x0)) - starts[row]
    at = np.minimum(col, MOST_COLUMNS - 1)
    stands = (x0 < cuts[pages, at]) & (x1 < cuts[pages, at]) & ((col == 0) | (x0 >= cuts[pages, np.maximum(0, at - 1)]))
    good &= ~_any(~stands, pages, n)
    return few, good, order, row - _begins(rows)[pages], col


def _part(w: Words, digits: np.ndarray, ragged: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pages left to the kernel, pages with a faultless grid, and the latter's words by page, row and column with their rows and columns."""
    pages, n = w.pages(), len(w.begin) - 1
    odd = ragged.copy()
    for c in w[1:]:
        odd |= ~np.isfinite(c)
    y, x = w.y0, w.x0
    odd[1:] |= (pages[1:] == pages[:-1]) & ~((y[1:] > y[:-1]) | ((y[1:] == y[:-1]) & (x[1:] > x[:-1])))
    left = _any(odd, pages, n)
    even, at = w.of(~left)
    found = np.zeros(n, bool)
    found[~left] = likely(even, digits[at])
    if not found.any():
        return left, found, *(np.zeros(0, int) for _ in range(3))
    own, at = w.of(found)
    few, good, order, row, col = _faultless(own)
    kept = np.repeat(good, own.counts())
    which = np.flatnonzero(found)
    left[which[~few & ~good]] = True
    found[which[~good]] = False
    return left, found, at[order][kept], row[kept], col[kept]


def _record(kind: pa.DataType, row, col, text, colspan, rowspan) -> pa.StructArray:
    columns = {"row": row, "col": col, "text": text, "colspan": colspan, "rowspan": rowspan}
    return pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in kind], fields=list(kind))


def page_cells(words: pa.ListArray, kind: pa.DataType, rows_of) -> pa.ListArray:
    """The cells (list of kind) of each page that is surely a table, else null; rows_of makes a page's words what the kernel takes."""
    n, begin = len(words), words.offsets.to_numpy().astype(np.int64)
    values = words.values.slice(begin[0], begin[-1] - begin[0])
    begin -= begin[0]
    columns = dict(zip((f.name for f in values.type), values.flatten(), strict=True))
    box = [c.to_numpy(zero_copy_only=False).astype(float) for c in (columns[x] for x in ("x0", "y0", "x1", "y1"))]  # null: NaN
    text = columns["text"]
    flags = lambda pattern, null: pc.fill_null(pc.match_substring_regex(text, pattern), null).to_numpy(zero_copy_only=False)
    digits, ragged = flags("[0-9]", False), flags(_RAGGED, True)
    left, found = np.zeros(n, bool), np.zeros(n, bool)
    parts, lo = [], 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + WORDS_AT_ONCE, "right")) - 1)
        a, b = begin[lo], begin[hi]
        left[lo:hi], found[lo:hi], at, row, col = _part(Words(begin[lo : hi + 1] - a, *(c[a:b] for c in box)), digits[a:b], ragged[a:b])
        parts.append((at + a, row, col))
        lo = hi
    if words.null_count:
        null = words.is_null().to_numpy(zero_copy_only=False)
        left, found = left & ~null, found & ~null
    at, row, col = (np.concatenate([p[i] for p in parts] or [np.zeros(0, int)]) for i in range(3))
    one = np.ones(len(at), int)
    cells = _record(kind.value_type, row, col, text.take(pa.array(at)), one, one)
    sizes = np.where(found, np.diff(begin), 0)
    if left.any():
        made = {int(i): g.cells for i in np.flatnonzero(left) if (g := grid.best_for_page(rows_of(words[int(i)].as_py()))) is not None}
        starts = _begins(sizes)[:-1]
        at_end = len(cells)
        cells = pa.concat_arrays([cells, pa.array([c._asdict() for own in made.values() for c in own], kind.value_type)])
        for i, own in made.items():
            starts[i], sizes[i], found[i] = at_end, len(own), True
            at_end += len(own)
        cells = cells.take(pa.array(np.repeat(starts - _begins(sizes)[:-1], sizes) + np.arange(sizes.sum())))
    return pa.ListArray.from_arrays(pa.array(_begins(sizes), pa.int32()), cells, type=kind, mask=pa.array(~found))
