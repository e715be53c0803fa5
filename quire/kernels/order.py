"""Reading order of page regions and the text of spans, in plain Python.

A region is (x0, y0, x1, y1, label, order) in shares of the page, a span (x0, y0, x1, y1, text, size).
"""

from __future__ import annotations

import heapq
import statistics

MOST_DEPTH, LEAST_GAP, TOUCH = 10, 0.03, 0.005


def _key(r):
    return r[1], r[0], r[3], r[2], r[4]


def cut(regions, axis: int):
    """The widest empty strip across an axis (0: x, 1: y): (width, before, behind), None if there is none."""
    rows = sorted(regions, key=lambda r: (r[axis], r[axis + 2], r[1 - axis], r[3 - axis], r[4]))
    best, end = None, float("-inf")
    for i, (r, following) in enumerate(zip(rows, rows[1:], strict=False), 1):
        end = max(end, r[axis + 2])
        gap = following[axis] - end
        if gap > (best[0] if best else 0.0):
            best = gap, rows[:i], rows[i:]
    return best


def columns(regions):
    """Left and right halves of regions that stand in two columns, else None."""
    widths = [max(0.0, r[2] - r[0]) for r in regions]
    if len(regions) < 4 or max(widths) > 0.75:
        return None
    middle = lambda r: (r[0] + r[2]) / 2
    rows = sorted(regions, key=lambda r: (middle(r), r[1], r[0]))
    left, right = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    apart = statistics.median(map(middle, right)) - statistics.median(map(middle, left))
    wide = [w for w in widths if w > 0]
    needed = max(0.15, 0.55 * (statistics.median(wide) if wide else 0.0))
    return (left, right) if apart >= needed and middle(left[-1]) < middle(right[0]) else None


def before(a, b) -> bool:
    """Is a read before b: above it with a shared column, or left of it with a shared band?"""

    def share(axis: int) -> float:
        both = max(0.0, min(a[axis + 2], b[axis + 2]) - max(a[axis], b[axis]))
        return both / min(max(1e-6, a[axis + 2] - a[axis]), max(1e-6, b[axis + 2] - b[axis]))

    return any(share(axis) >= 0.15 and a[3 - axis] <= b[1 - axis] + TOUCH for axis in (0, 1))


def sorted_by_precedence(regions):
    """A topological order of before(), the topmost first among those that may come; plain order if it has cycles."""
    rows = sorted(regions, key=_key)
    n = len(rows)
    later = [[j for j in range(n) if j != i and before(rows[i], rows[j])] for i in range(n)]
    waits = [0] * n
    for own in later:
        for j in own:
            waits[j] += 1
    ready = [i for i in range(n) if not waits[i]]  # numbers are in plain order, so a heap of them breaks ties
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)
        out.append(rows[i])
        for j in later[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, j)
    return out if len(out) == n else rows


def cut_order(regions, depth: int = 0):
    """Regions cut at the wider of the two widest empty strips again and again; two columns are read one by one."""
    if len(regions) <= 1:
        return list(regions)
    across, down = cut(regions, 0), cut(regions, 1)
    x, y = (c[0] if c and c[0] >= LEAST_GAP else 0.0 for c in (across, down))
    parts = None
    if depth < MOST_DEPTH and (x or y):
        parts = (columns(regions) if y and not x else None) or (across if x > y else down)[-2:]
    if not parts:
        return sorted_by_precedence(regions)
    return [r for part in parts for r in cut_order(part, depth + 1)]


def reading_order(regions):
    """Regions with an order of their own first, then the others as they are cut."""
    own = sorted((r for r in regions if r[5] is not None), key=lambda r: (r[5], *_key(r)))
    return own + cut_order(sorted((r for r in regions if r[5] is None), key=_key))


def median_of_positive(values, default: float) -> float:
    good = [v for v in values if v is not None and v > 0]
    return float(statistics.median(good)) if good else default


def line_text(spans) -> str:
    """Spans left to right; a blank where they are a quarter of a line apart."""
    gap = max(1.0, 0.25 * median_of_positive([s[3] - s[1] for s in spans], 10.0))
    text, end = "", None
    for s in sorted(spans, key=lambda s: (s[0], s[2], s[4])):
        if s[4]:
            text += (" " if end is not None and s[0] - end >= gap else "") + s[4]
            end = s[2]
    return text.strip()


def region_text(spans) -> str:
    """Spans as lines, wrapped lines joined by a blank (or the hyphen dropped), a newline before a wide gap."""
    if not spans:
        return ""
    row_bin = max(2.0, 0.75 * median_of_positive([s[3] - s[1] for s in spans], 10.0))
    rows: dict[int, list] = {}
    for s in sorted(spans, key=lambda s: (s[1], s[0], s[3], s[2], s[4])):
        rows.setdefault(round((s[1] + s[3]) / 2 / row_bin), []).append(s)
    made = [(min(s[1] for s in rows[k]), max(s[3] for s in rows[k]), line_text(rows[k])) for k in sorted(rows)]
    made = [m for m in made if m[2]]
    wide = max(6.0, 1.8 * median_of_positive([b - a for a, b, _ in made], 10.0))
    text, last = "", None
    for top, bottom, line in made:
        if last is None:
            text = line
        elif top - last >= wide:
            text += "\n" + line
        elif text.endswith("-") and line[0].isalpha():
            text = text[:-1] + line
        else:
            text += " " + line
        last = bottom
    return text.strip()
