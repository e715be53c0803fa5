"""Correcting a page's blocks against its text layer, in plain Python.

Candidates are windows of neighbouring lines of the layer. A block takes single Japanese characters from the
candidate that is most like it, or the whole candidate if both are alike enough for their length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from quire.kernels.blocks import Block, page_blocks, table_block
from quire.kernels.grid import Cell, best_for_page, build
from quire.kernels.merge import merge_cell, safe_cell
from quire.kernels.words import NUMBERS, close_japanese, compact, edits, has_letter, is_japanese, normalize, similarity, similarity_bound, text_similarity, token_overlap

TEXTS = ("paragraph", "heading", "unknown")
#: Characters that are compared at most.
MATCHED, CELL_MATCHED, CHECKED = 1200, 600, 3000
#: Terms that are always put right, and readings that are put right if the layer has the right one.
TERMS = (("前四期発表予想比", "前回発表予想比"), ("前四発表予想比", "前回発表予想比"))
ARTEFACTS = (
    ("潜在在読読商戸", "潜在株式調整後"), ("中間絶緯利益", "中間純利益"), ("中間絶絡利益", "中間純利益"),
    ("当期絶絡利益", "当期純利益"), ("環境規制間述引当金", "環境規制関連引当金"), ("円 種", "円 銭"),
)
_CONTENTS_ITEM, _LEADER = re.compile(r"[（(]\s*[0-9０-９]+\s*[)）]"), re.compile(r"(?:…|\.|．){4,}")
_MARKUP = re.compile(r"\*\*|__|```|[<>\t]|^\s{0,3}#{1,6}\s|^\s*\|.*\|\s*$", re.M)
_NUMBER = re.compile(r"\d+(?:,\d+)?(?:\.\d+)?")
_WIDE = "0-9０-９"
_BAR = "|｜"


def windows(lines, most: int, separator: str = " ") -> list[str]:
    """Every run of 1 to most neighbouring lines, by their first line and then their number, each text once."""
    runs = (separator.join(lines[i : i + n]).strip() for i in range(len(lines)) for n in range(1, min(most, len(lines) - i) + 1))
    return list(dict.fromkeys(r for r in runs if r))


def best_reference(source: str, candidates) -> tuple[str | None, float]:
    """The candidate most like source, and how much. Among those within 0.04 of the best the nearest in length is taken,
    then the more alike, then (within 0.01) the longer.

    Only candidates whose bound lets them matter are compared in full, the highest bounds first.
    """
    own = compact(source)
    rows = [(n, text, other) for n, text in enumerate(candidates if own else ()) if (other := compact(text))]
    bounds = sorted(((similarity_bound(own[:MATCHED], other[:MATCHED]), -n, text, other) for n, text, other in rows), reverse=True)
    scored, top = [], 0.0
    for bound, n, text, other in bounds:
        if bound < top - 0.04:
            break
        score = similarity(own[:MATCHED], other[:MATCHED])
        top = max(top, score)
        scored.append((-n, text, score, len(other)))
    scored.sort()
    best = next((s for s in scored if s[2] == top), None) if top > 0 else None
    if best is None:
        return None, 0.0
    off = lambda s: abs(s[3] - len(own))
    for s in scored:
        if s[2] < max(0.0, top - 0.04):
            continue
        if off(s) < off(best) or (off(s) == off(best) and (s[2] > best[2] or (abs(s[2] - best[2]) <= 0.01 and s[3] > best[3]))):
            best = s
    return best[1], best[2]


def local_changes(source: str, reference: str, ratio: float = 0.18, most: int = 12) -> str:
    """source with single Japanese characters (or for such) as in reference, if they are few."""
    out, changed = [], 0
    for kind, a, b, c, d in edits(source, reference):
        if kind == "replace" and b - a == d - c:
            for x, y in zip(source[a:b], reference[c:d], strict=True):
                swap = x != y and (is_japanese(x) or is_japanese(y))
                changed += swap
                out.append(y if swap else x)
        elif kind != "insert":
            out.append(source[a:b])
    made = "".join(out)
    allowed = min(most, max(2, int(len("".join(source.split())) * ratio)))
    return made if 0 < changed <= allowed and similarity(source[:CHECKED], made[:CHECKED]) >= 0.85 else source


#: By the source's length: length ratios, match, shared tokens and likeness that a whole replacement needs.
_TIERS = ((9, 0.50, 1.80, 0.72, 0.25, 0.45), (64, 0.75, 1.45, 0.55, 0.30, 0.55), (None, 0.85, 1.20, 0.72, 0.55, 0.68))


def may_replace(source: str, reference: str, score: float) -> bool:
    """Are a block and its reference alike enough to take the reference as a whole?"""
    a, b = normalize(source).strip(), normalize(reference).strip()
    n, m = len("".join(a.split())), len("".join(b.split()))
    if min(n, m) < 4 or "\t" in a or _MARKUP.search(b):
        return False
    most, low, high, match, shared, alike = next(t for t in _TIERS if t[0] is None or n <= t[0])
    if not low <= m / n <= high or score < match or token_overlap(a, b) < shared or text_similarity(a, b) < alike:
        return False
    return most is not None or any(map(is_japanese, a))


def is_contents(text: str) -> bool:
    t = normalize(text).strip()
    return "\n" not in t and len(_CONTENTS_ITEM.findall(t)) >= 2 and bool(_LEADER.search(t))


def split_contents(text: str) -> str:
    made = _CONTENTS_ITEM.sub(lambda m: "\n" + m[0], normalize(text).strip()).strip() if is_contents(text) else ""
    return made if "\n" in made else text


def correct_text(source: str, short, long, least: float = 0.32, ratio: float = 0.18, most: int = 12) -> str:
    """A text block corrected against windows of the layer (short: joined by blanks, long: by newlines)."""
    contents = is_contents(source)
    candidates = [*long, *short] if contents else [*short, *long] if len(compact(source)) >= 96 else short
    reference, score = best_reference(source, candidates)
    if contents and reference is not None and "\n" not in reference:
        other, own = best_reference(source, long)
        if other is not None and "\n" in other and own >= max(least, score - 0.03):
            reference, score = other, own
    if reference is None or score < least:
        return split_contents(source)
    made = local_changes(source, reference, ratio, most)
    if may_replace(source, reference, score) and (made == source or text_similarity(made, reference) < 0.94):
        made = reference
    return split_contents(made)


def is_data_line(line: str, marks: str = "△▲") -> bool:
    return bool(re.search(r"\d{1,3}(?:,\d{3})+|%", line) or re.search(rf"[{marks}]\s*\d", line)) or len(re.findall(r"\d+", line)) >= 4


def preface(layer: str) -> list[str]:
    """The layer's lines before the first that looks like a table's row, 40 at most."""
    out: list[str] = []
    for line in filter(None, map(str.strip, layer.splitlines())):
        if is_data_line(line) or len(out) == 40:
            break
        out.append(line)
    return out


def correct_preface(blocks: list[Block], layer: str) -> list[Block]:
    """Text blocks before the first table with a grid, corrected against the layer's preface."""
    first = next((i for i, b in enumerate(blocks) if b.kind == "table" and b.grid is not None), 0)
    candidates = windows(preface(layer), 8) if first else []
    out = list(blocks)
    for i in range(first if candidates else 0):
        b, source = blocks[i], blocks[i].text.strip()
        if b.kind not in TEXTS or not source:
            continue
        reference, score = best_reference(source, candidates)
        if reference is None or score < 0.30:
            continue
        made = local_changes(source, reference)
        made = reference if made == source and may_replace(source, reference, score) else made
        out[i] = b._replace(text=made) if made != source else b
    return out


def correct_texts(blocks: list[Block], layer: str, least: float = 0.32, ratio: float = 0.18, most: int = 12) -> list[Block]:
    lines = [x.strip() for x in layer.splitlines() if x.strip()]
    short, long = windows(lines, 8), windows(lines, 20, "\n")
    out = []
    for b in blocks:
        source = b.text.strip()
        made = correct_text(source, short, long, least, ratio, most) if short and source and b.kind in TEXTS else source
        out.append(b if made == source else b._replace(text=made))
    return out


# Tables


def cell_candidates(layer: str, most: int = 3) -> list[str]:
    """Windows of 1 to 3 lines that may be a cell: 2 to 48 characters, with a letter, no url, few digits; each once."""
    lines = [t for x in layer.splitlines() if (t := normalize(x).strip())]
    out: dict[str, str] = {}
    for text in windows(lines, most):
        own = compact(text)
        digits = sum(map(str.isdigit, own))
        if 2 <= len(own) <= 48 and not re.search("https?://", text.lower()) and has_letter(own) and digits <= 0.55 * len(own):
            out.setdefault(own, normalize(text).strip())
    return list(out.values())


def may_replace_cell(source: str, reference: str, score: float) -> bool:
    a, b = compact(source), compact(reference)
    if min(len(a), len(b)) < 2 or {"\n", "\r"} & set(source + reference):
        return False
    if len(a) <= 4:
        return len(a) == len(b) and score >= 0.45
    numbers = [_NUMBER.findall(t.translate(NUMBERS)) for t in (source, reference)]
    return 0.85 <= len(b) / len(a) <= 1.45 and score >= 0.55 and token_overlap(a, b) >= 0.20 and not (all(numbers) and numbers[0] != numbers[1])


def correct_cell(cell: str, candidates, others=frozenset()) -> str:
    """A cell corrected from candidates; those that other cells of its row have are left to them."""
    source = normalize(cell).strip()
    for wrong, right in TERMS:
        source = source.replace(wrong, right)
    own = compact(source)
    if not source or not candidates:
        return source
    known = {compact(c).translate(NUMBERS) for c in candidates}
    for wrong, right in ARTEFACTS:
        if wrong in source:
            made = close_japanese(source.replace(wrong, right))
            if any(compact(made).translate(NUMBERS) in k for k in known):
                return made
    if not 2 <= len(own) <= 64 or not has_letter(own):
        return source
    best, top = None, 0.0
    for text in candidates:
        other = compact(text)
        if (other in others and other != own) or not 0.75 <= len(other) / len(own) <= 1.45:
            continue
        a, b = own[:CELL_MATCHED], other[:CELL_MATCHED]
        if similarity_bound(a, b) > top and (score := similarity(a, b)) > top:
            best, top = text, score
    if best is None:
        return source
    best = close_japanese(best)
    if top < (0.45 if len(own) <= 4 else 0.55) or (len(own) > 4 and token_overlap(own, compact(best)) < 0.20):
        return source
    made = local_changes(source, best, 0.45, 40)
    safe = may_replace_cell(source, best, top)
    if made != source:
        return best if len(own) >= 12 and top >= 0.60 and safe else made
    return best if safe else source


def synced(cells, grid):
    """Cells with the texts that a changed grid has at their places."""
    inside = lambda c: 0 <= c.row < len(grid) and 0 <= c.col < len(grid[c.row])
    return tuple(c._replace(text=grid[c.row][c.col]) if inside(c) else c for c in cells) if cells else None


def clipped(cells, columns: int, first_row: int = 0):
    """Cells that begin within so many columns, with spans that end there."""
    return tuple(c._replace(colspan=max(1, min(c.colspan, columns - c.col))) for c in cells or () if 0 <= c.col < columns and c.row >= first_row)


def trimmed(grid, cells):
    """Without empty columns at the right, one column at least."""
    width = max(map(len, grid), default=0)
    used = max((k + 1 for r in grid for k, v in enumerate(r) if normalize(v).strip()), default=1)
    if width <= 1 or used >= width:
        return grid, cells
    return tuple(tuple(r[:used]) for r in grid), clipped(cells, used) if cells else cells


def forecast_head(grid, cells):
    """The two-row head of a comparison of forecasts put in order: five columns, of which the last two share a title."""
    width = max(map(len, grid), default=0)
    if len(grid) < 3 or width < 5:
        return grid, cells
    rows = [[normalize(v).strip() for v in r] + [""] * (width - len(r)) for r in grid]
    titles = ("前回発表予想比", *(wrong for wrong, _ in TERMS))
    top, sub = rows[0], rows[1]
    amount = "増減額" if "増減額" in sub else "増減"
    body = any(w in r[0] for r in rows[2:] for w in ("売上高", "営業利益", "経常利益", "為替レート")) or any(w in r[1] for r in rows[2:] for w in ("ＵＳドル", "ユーロ"))
    if not ("通期" in top and any("前期比" in v for v in top) and any(t in v for v in top for t in titles) and "増減率" in sub and amount in sub and body):
        return grid, cells
    head = [Cell(0, 0, "", 1, 2), Cell(0, 1, "通期", 1, 2), Cell(0, 2, "前期比", 1, 2), Cell(0, 3, "前回発表予想比", 2, 1), Cell(1, 3, amount), Cell(1, 4, "増減率")]
    made = [[""] * 5, [""] * 5] + [(list(r) + [""] * 5)[:5] for r in grid[2:]]
    for c in head:
        made[c.row][c.col] = c.text
    return tuple(map(tuple, made)), (*head, *clipped(cells, 5, 2))


def correct_tables(blocks: list[Block], layer: str, words, least_confidence: float = 0.30) -> list[Block]:
    """Tables corrected cell by cell: against a grid of the page's words with as many rows, else against windows of the layer."""
    candidates = cell_candidates(layer)
    references: dict[int, list | None] = {}
    out = []
    for b in blocks:
        if b.kind != "table" or not b.grid or not (words or candidates):
            out.append(b)
            continue
        grid, cells = trimmed(b.grid, b.cells)
        width = max(map(len, grid))
        if width not in references:
            g = build(words, width) if words else None
            references[width] = g.rows if g and not g.reason and g.confidence >= least_confidence else None
        reference = references[width] if references[width] and len(references[width]) == len(grid) else None
        made = []
        for r, row in enumerate(grid):
            row = [*row, *[""] * (width - len(row))]
            plain = [normalize(v).strip() for v in row]
            new = list(row)
            for c, own in enumerate(plain):
                other = normalize(reference[r][c]).strip() if reference else ""
                got = merge_cell(own, other).text if own and other else own
                if own and got == own:
                    got = correct_cell(own, candidates, {compact(v) for k, v in enumerate(plain) if k != c and v})
                if own and got != own and safe_cell(own, got):
                    new[c] = got
            made.append(tuple(new))
        grid, cells = forecast_head(tuple(made), synced(cells, made))
        same = tuple(map(tuple, b.grid)) == grid
        out.append(b if same and cells == b.cells else table_block(grid, cells))
    return out


def add_page_table(blocks: list[Block], layer: str, words) -> list[Block]:
    """A page's table from its words, where the transcription has none or a much shorter one."""
    g = best_for_page(words) if words else None
    if g is None:
        return blocks
    table = table_block(g.rows, g.cells)
    sizes = [(len(b.grid), -i) for i, b in enumerate(blocks) if b.kind == "table" and b.grid is not None]
    before = page_blocks("\n".join(preface(layer)))
    if not sizes:
        before = [b for b in before if b.kind in ("heading", "paragraph")]
        return [*(before or blocks), table]
    most, at = max(sizes)
    if len(g.rows) < max(most + 5, int(most * 1.25)):
        return blocks
    return [*before, table] if before else [*blocks[:-at], table, *blocks[1 - at :]]


# Clean-up rules


def _page_number(text: str, number: int) -> bool:
    m = re.fullmatch(rf"\s*[-‐‑‒–—―－−]?\s*([{_WIDE}]{{1,3}})\s*[-‐‑‒–—―－−]?\s*", normalize(text).strip())
    return bool(m) and int(m[1].translate(NUMBERS)) == number


def without_number(text: str, number: int) -> str:
    t = normalize(text).strip()
    m = re.match(rf"([{_WIDE}]{{1,3}})\s+(.+)", t, re.S)
    return m[2].lstrip() if m and int(m[1].translate(NUMBERS)) == number and m[2].lstrip()[:1] not in _BAR else t


def promoted(text: str, number: int, overview: str = "事業概要", business: str = "事業") -> tuple[str, str | None] | None:
    """The heading and the text behind it of a section title with a bar."""
    t = without_number(text, number)
    if m := re.fullmatch(rf"([{_WIDE}]{{2}})\s*[|｜]\s*(\S.*)", t, re.S):
        return f"{m[1]} | {m[2].strip()}", None
    m = re.fullmatch(rf"{overview}\s*[|｜]\s*(\S.*)", t, re.S)
    if not m:
        return None
    title, tail = m[1].strip(), None
    if note := re.search(rf"\s+(?=\*[{_WIDE}]+|注[{_WIDE}]+)", title):
        title, tail = title[: note.start()].strip(), title[note.start() :].strip() or None
    elif (split := re.match(rf"(.{{1,80}}?{business})\s+(.+)$", title, re.S)) and (set("。、") & set(split[2]) or len(split[2].strip()) >= 24):
        title, tail = split[1].strip(), split[2].strip()
    return (f"{overview}｜{title}", tail) if title and (tail or len(title) <= 80) else None


def _fragment(line: str) -> bool:
    """May a line be a piece of a heading?"""
    own, low = compact(line), line.lower()
    tags = "br />" in low or "br/>" in low or low.endswith("<br")
    return 0 < len(own) <= 20 and not tags and line[:1] not in "*・-•※" and not re.search(rf"[{_WIDE}]{{3,}}", line) and has_letter(own)


def _cluster(lines, at: int) -> int | None:
    """The end of 2 to 4 heading fragments from a line on, the first with a comma, 8 to 48 characters together."""
    end = at
    while end < min(len(lines), at + 4) and _fragment(lines[end]):
        end += 1
    return end if end - at >= 2 and "、" in lines[at] and 8 <= len(compact("".join(lines[at:end]))) <= 48 else None


def split_issue(text: str) -> list[Block] | None:
    """A paragraph of a numbered issue as heading, footnotes, body and headings of its own; None if it isn't one."""
    lines = [normalize(x).strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
    circled = re.compile("[①-⑳]")
    if len(lines) < 6 or not any(map(circled.search, lines)) or max(len(compact(x)) for x in lines) < 24:
        return None
    out: list[Block] = []
    at = 0
    if circled.search(lines[0]) and len(compact(lines[0])) <= 40:
        out.append(Block("heading", lines[0], 2))
        at = 1
    for belongs in (lambda i: lines[i].startswith("*"), lambda i: _cluster(lines, i) is None):
        start = at
        while at < len(lines) and belongs(at):
            at += 1
        if at > start:
            out.append(Block("paragraph", "\n".join(lines[start:at])))
    while at < len(lines):
        end = _cluster(lines, at)
        out.append(Block("heading", "".join(lines[at:end]), 2) if end else Block("paragraph", lines[at]))
        at = end or at + 1
    return out if len(out) > 1 else None


def clean_up(blocks: list[Block], number: int, footer: str | None = None) -> list[Block]:
    """Page numbers off the first two texts, section titles among the first three promoted, issues split, number and footer blocks dropped."""
    out: list[Block] = []
    texts = 0
    for b in blocks:
        texts += b.kind in TEXTS
        own = without_number(b.text.strip(), number) if b.kind in TEXTS and texts <= 2 and b.text.strip() else None
        out.append(b if own in (None, b.text.strip()) else b._replace(text=own))
    blocks, out, texts = out, [], 0
    for b in blocks:
        plain = b.kind in ("paragraph", "unknown")
        texts += plain
        found = promoted(b.text.strip(), number) if plain and texts <= 3 and b.text.strip() else None
        if found:
            out.append(Block("heading", found[0], 2))
            out += [Block("paragraph", found[1])] if found[1] else []
        else:
            out.append(b)
    out = [x for b in out for x in ((split_issue(b.text.strip()) if b.kind in ("paragraph", "unknown") and b.text.strip() else None) or [b])]
    n = len(out)
    is_footer = lambda i, t: footer is not None and re.fullmatch(footer, t, re.I) and (i <= 1 or i >= n - 2)
    return [b for i, b in enumerate(out) if b.kind not in TEXTS or not b.text.strip() or not (_page_number(b.text.strip(), number) or is_footer(i, b.text.strip()))]


@dataclass(frozen=True)
class PostProcess:
    """mode: full, light (tables only on pages that have or may have one) or off (clean-up only)."""

    mode: str = "light"
    table_threshold: float = 0.60
    footer: str | None = None

    def __call__(self, blocks: list[Block], number: int, layer: str, words, likelihood: float) -> list[Block]:
        light = self.mode == "light"
        steps = []
        if light:
            blocks = correct_texts(blocks, layer, 0.45)
            if likelihood < self.table_threshold and not any(b.kind == "table" for b in blocks):
                return clean_up(blocks, number, self.footer)
            steps = [lambda b: correct_preface(b, layer)]
        elif self.mode != "off":
            steps = [lambda b: correct_preface(b, layer), lambda b: correct_texts(b, layer)]
        if steps:
            tables = lambda b: correct_tables(b, layer, words)
            steps += [tables, lambda b: add_page_table(b, layer, words), tables]
        for step in steps:
            blocks = step(blocks)
        return clean_up(blocks, number, self.footer)
