"""Markdown pipe tables, in plain Python: a conservative reader, everything else stays text."""

from __future__ import annotations

import re
from typing import NamedTuple

_FENCE = "```"
_SEPARATOR = re.compile(r":?-{3,}:?")
#: A bar that isn't kept by a backslash: backslashes in pairs before it don't count.
_CELL = re.compile(r"(?:[^|\\]|\\.|\\\Z)*", re.S)
_BAR = re.compile(r"(\\*)\|")
MARKS = {(False, False): ("none", "---"), (True, False): ("left", ":---"), (False, True): ("right", "---:"), (True, True): ("center", ":---:")}
_MARK_OF = dict(MARKS.values())


class Text(NamedTuple):
    lines: tuple[str, ...]


class Table(NamedTuple):
    header: tuple[str, ...]
    align: tuple[str, ...]
    rows: tuple[tuple[str, ...], ...]


def cells(line: str) -> list[str] | None:
    """The cells of a row, None for a line without a bar."""
    t = line.strip()
    if "|" not in t:
        return None
    out, at = [], 0
    while True:
        m = _CELL.match(t, at)
        out.append(m[0])
        if m.end() >= len(t):
            break
        at = m.end() + 1
    if t[0] == "|":
        out = out[1:]
    if t[-1] == "|" and out and not out[-1]:
        out = out[:-1]
    return [c.strip().replace("\\|", "|") for c in out] or None


def alignments(line: str, columns: int) -> tuple[str, ...] | None:
    own = cells(line)
    if own is None or len(own) != columns:
        return None
    own = [c.replace(" ", "") for c in own]
    return tuple(MARKS[c.startswith(":"), c.endswith(":")][0] for c in own) if all(map(_SEPARATOR.fullmatch, own)) else None


def parse(markdown: str) -> list[Text | Table]:
    """Text and tables in order. A table is a row of cells, a separator of as many, and rows of at most as many; fenced lines are text."""
    lines = markdown.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    fence = lambda s: s.lstrip().startswith(_FENCE)
    out: list[Text | Table] = []
    text: list[str] = []
    fenced, at = False, 0
    while at < len(lines):
        line = lines[at]
        fenced ^= fence(line)
        header = None if fenced or fence(line) else cells(line)
        align = alignments(lines[at + 1], len(header)) if header and at + 1 < len(lines) else None
        at += 1
        if not align:
            text.append(line)
            continue
        at += 1
        rows = []
        while at < len(lines) and not fence(lines[at]) and (row := cells(lines[at])) is not None and len(row) <= len(header):
            rows.append(tuple(row + [""] * (len(header) - len(row))))
            at += 1
        if text:
            out.append(Text(tuple(text)))
            text = []
        out.append(Table(tuple(header), align, tuple(rows)))
    if text:
        out.append(Text(tuple(text)))
    return out


def escaped(cell: str) -> str:
    t = cell.replace("\r\n", "\n").replace("\r", "\n").replace("\n", "<br>")
    return _BAR.sub(lambda m: m[1] + ("\\|" if len(m[1]) % 2 == 0 else "|"), t)


def table_lines(table: Table) -> list[str]:
    if len(table.align) != len(table.header) or any(len(r) != len(table.header) for r in table.rows):
        raise ValueError("the rows of a table have as many cells as its header")
    row = lambda own: "| " + " | ".join(map(escaped, own)) + " |"
    return [row(r) for r in (table.header, [_MARK_OF[a] for a in table.align], *table.rows)] if table.header else []


def render(blocks) -> str:
    return "\n".join(line for b in blocks for line in (table_lines(b) if isinstance(b, Table) else b.lines))
