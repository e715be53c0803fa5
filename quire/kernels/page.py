"""Spans of many pages at a time as arrays: placed in a fixed pitch, assigned to regions and joined to texts.

Spans of pages lie one after another: `page` numbers each span's page, which is not less than that of the span before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.kernels import order

LEAST_COVER = 0.05
LOOSE = -1  # the place of spans without a region
TOGETHER = 1 << 18  # spans or characters that are worked on at a time


@dataclass
class Spans:
    page: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    size: np.ndarray
    text: list[str]


def runs(costs: np.ndarray, most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Neighbouring rows whose costs add up to about most."""
    group = np.cumsum(costs) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(costs)]
    return ((a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def offsets(lists: pa.ListArray) -> np.ndarray:
    """Where the values of each list begin and end in lists.flatten(); a null list is empty."""
    return np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))])


def spans_of_lines(lines: pa.ListArray, sizes: pa.ListArray, width: float, pitch: float, height: float) -> Spans:
    """The words of pages of lines (a page's lines, the first at the top, and the font size of each)."""
    line_page = np.repeat(np.arange(len(lines)), np.diff(offsets(lines)))
    line_no = np.arange(len(line_page)) - offsets(lines)[line_page]
    words = pc.split_pattern(lines.flatten(), " ")
    cut = offsets(words)
    flat = words.flatten()
    n = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    line = np.repeat(np.arange(len(words)), np.diff(cut))
    ends = np.cumsum(n + 1)
    at = ends - n - 1  # before each word in all lines
    at -= at[cut[:-1]][line] if len(line) else 0
    some = n > 0
    at, n, line = at[some], n[some], line[some]
    x0, y0 = (width * at).astype(np.float64), (pitch * line_no[line]).astype(np.float64)
    return Spans(line_page[line], x0, y0, x0 + width * n, y0 + height, sizes.flatten().to_numpy(zero_copy_only=False)[line], flat.filter(pa.array(some)).to_pylist())


def spans_of_structs(spans: pa.ListArray) -> Spans:
    """Spans from an array of structs a page."""
    flat = spans.flatten()
    number = lambda c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64)
    page = np.repeat(np.arange(len(spans)), np.diff(offsets(spans)))
    return Spans(page, *(number(c) for c in ("x0", "y0", "x1", "y1", "size")), [t or "" for t in flat.field("text").to_pylist()])


def medians(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """The median of each group's values above zero, NaN where there is none."""
    good = values > 0
    group, values = group[good], values[good]
    values = values[np.lexsort((values, group))]
    n = np.bincount(group, minlength=groups)
    begin = np.cumsum(n) - n
    out = np.full(groups, np.nan)
    some = n > 0
    out[some] = (values[(begin + (n - 1) // 2)[some]] + values[(begin + n // 2)[some]]) / 2
    return out


def assign(spans: Spans, regions: list[tuple], sizes: np.ndarray) -> np.ndarray:
    """For each span the place in its page's list of the smallest region around its centre, else of the one that covers most of it, else LOOSE.

    regions: a page's (x0, y0, x1, y1, label, order, number) in shares of the page; sizes: width and height by page.
    """
    places = [sorted(range(len(own)), key=lambda i: _tie(own[i])) for own in regions]
    width, height = sizes[spans.page].T if len(spans.page) else (np.zeros(0), np.zeros(0))
    ax, ay, bx, by = spans.x0 / width, spans.y0 / height, spans.x1 / width, spans.y1 / height
    cx, cy = (ax + bx) / 2, (ay + by) / 2
    own_area = np.maximum(1e-6, np.maximum(0.0, bx - ax) * np.maximum(0.0, by - ay))
    best, score = np.full(len(ax), LOOSE), np.full(len(ax), np.inf)
    for j in range(max(map(len, places), default=0)):
        # the j-th region of each page by ties: an earlier one stays where both fit alike
        box = np.array([regions[p][own[j]][:4] if j < len(own) else (np.nan,) * 4 for p, own in enumerate(places)], np.float64)
        place = np.array([own[j] if j < len(own) else LOOSE for own in places])
        x0, y0, x1, y1 = box[spans.page].T
        inside = (cx >= x0) & (cx <= x1) & (cy >= y0) & (cy <= y1)
        covered = np.maximum(0.0, np.minimum(bx, x1) - np.maximum(ax, x0)) * np.maximum(0.0, np.minimum(by, y1) - np.maximum(ay, y0)) / own_area
        # inside comes before covered, more before less
        now = np.where(inside, -np.inf, np.where(covered >= LEAST_COVER, -np.round(covered, 9), np.inf))
        better = now < score
        best[better], score[better] = place[spans.page[better]], now[better]
    return best


def _tie(r: tuple) -> tuple:
    area = max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    return area, r[1], r[0], r[3], r[2], r[4] is not None, r[4] or "", r[6]


def region_texts(spans: Spans, group: np.ndarray, groups: int) -> list[str]:
    """kernel.region_text of each group's spans."""
    if not len(group):
        return [""] * groups
    tall = spans.y1 - spans.y0
    high = medians(group, tall, groups)
    row_bin = np.maximum(2.0, 0.75 * np.where(np.isnan(high), 10.0, high))
    row = np.rint((spans.y0 + spans.y1) / 2 / row_bin[group])
    at = np.lexsort((spans.x1, spans.x0, row, group))
    g, r, x0, x1 = group[at], row[at], spans.x0[at], spans.x1[at]
    new = np.append(True, (g[1:] != g[:-1]) | (r[1:] != r[:-1]))
    equal = np.append(False, ~new[1:] & (x0[1:] == x0[:-1]) & (x1[1:] == x1[:-1]))
    if equal.any():  # spans at one place go by their texts
        begins = np.flatnonzero(~equal)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(at)], strict=True):
            if b > a + 1:
                at[a:b] = sorted(at[a:b].tolist(), key=lambda i: spans.text[i])
    text = [spans.text[i] for i in at.tolist()]
    line = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    lines = len(begin)
    line_tall = medians(line, tall[at], lines)
    gap = np.maximum(1.0, 0.25 * np.where(np.isnan(line_tall), 10.0, line_tall))
    filled = np.flatnonzero(np.array([bool(t) for t in text], bool))
    blank = np.zeros(len(at), bool)
    if len(filled):
        same = line[filled[1:]] == line[filled[:-1]]
        blank[filled[1:]] = same & (x0[filled[1:]] - x1[filled[:-1]] >= gap[line[filled[1:]]])
    pieces = [" " + t if b else t for t, b in zip(text, blank.tolist(), strict=True)]
    ends = [*begin[1:].tolist(), len(at)]
    made = ["".join(pieces[a:b]).strip() for a, b in zip(begin.tolist(), ends, strict=True)]
    top, bottom = np.minimum.reduceat(spans.y0[at], begin), np.maximum.reduceat(spans.y1[at], begin)
    line_group = g[begin]
    kept = np.array([bool(m) for m in made], bool)
    step = medians(line_group[kept], (bottom - top)[kept], groups)
    wide = np.maximum(6.0, 1.8 * np.where(np.isnan(step), 10.0, step)).tolist()
    out = [""] * groups
    last: list[float | None] = [None] * groups
    for i, k, a, b in zip(np.flatnonzero(kept).tolist(), line_group[kept].tolist(), top[kept].tolist(), bottom[kept].tolist(), strict=True):
        own, now = out[k], made[i]
        if last[k] is None:
            out[k] = now
        elif a - last[k] >= wide[k]:
            out[k] = own + "\n" + now
        elif own.endswith("-") and now[0].isalpha():
            out[k] = own[:-1] + now
        else:
            out[k] = own + " " + now
        last[k] = b
    return [t.strip() for t in out]


@lru_cache(1024)
def _positions(regions: tuple[tuple, ...]) -> dict[int, int]:
    """The position in reading order of each place of a page's regions; pages often share their regions."""
    of = {r[6]: i for i, r in enumerate(regions)}
    return {of[r[6]]: n for n, r in enumerate(order.reading_order(list(regions)))}


def blocks(spans: Spans, regions: list[tuple[tuple, ...]], sizes: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """Each page's median font size, 0 where none is known, and its regions with text in reading order: label, place, text, size, and spans of tables.

    Spans without a region are a last one.
    """
    pages = len(regions)
    most = max(map(len, regions), default=0) + 1
    place = assign(spans, regions, sizes)
    group, of = np.unique(spans.page * most + np.where(place == LOOSE, most - 1, place), return_inverse=True)
    of = of.reshape(-1)
    texts = region_texts(spans, of, len(group))
    size = medians(of, spans.size, len(group))
    by_page = np.nan_to_num(medians(spans.page, spans.size, pages))
    at = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[at], np.arange(len(group) + 1))
    out: list[list[dict]] = [[] for _ in range(pages)]
    for k, (p, i) in enumerate(zip((group // most).tolist(), (group % most).tolist(), strict=True)):
        if not texts[k]:
            continue
        loose = i == most - 1
        label = None if loose else regions[p][i][4]
        row = {"loose": loose, "label": label, "position": len(regions[p]) if loose else _positions(regions[p])[i], "text": texts[k], "size": None if np.isnan(size[k]) else float(size[k]), "spans": None}
        if (label or "").strip().lower() == "table":
            own = at[cut[k] : cut[k + 1]]
            names = ("x0", "y0", "x1", "y1")
            row["spans"] = [dict(zip(names, b, strict=True)) | {"text": spans.text[j]} for j, b in zip(own.tolist(), zip(*(getattr(spans, c)[own].tolist() for c in names), strict=True), strict=True)]
        out[p].append(row)
    for rows in out:
        rows.sort(key=lambda r: r["position"])
    return by_page, out
