"""Repair and cleaning of model transcriptions, in plain Python.

One scan finds where tables begin and end; whether one is open, where, and which are whole follow from its events.
"""

from __future__ import annotations

import html
import re
from os.path import commonprefix
from typing import NamedTuple

from quire.functions.markup import NOTE_HINTS, TABLE_TAGS

_TAGS = "|".join(TABLE_TAGS)
#: The edges of tables, as tags and as escaped ones; the first group tells a beginning.
_EDGE = re.compile(r"<(?:\s*(table)\b|/\s*table\s*>)", re.I)
_ESCAPED_EDGE = re.compile(r"&lt;\s*(?:(table)\b|/\s*table\s*&gt;)", re.I)
_ELEMENT = re.compile(r"<\s*(/?)\s*([a-zA-Z0-9]+)(?:\s+[^>]*)?>")
#: A line that is no text of the page: a fence, a rule, a tag that isn't a table's and doesn't end, a remark on the image.
_NO_TEXT = re.compile(
    rf"""\s*(?: ``` | (?:-{{3,}}|\*{{3,}}|_{{3,}})\s*\Z
    | <(?![^>]*>)/?\s*(?!(?:{_TAGS})[:-]*(?![a-zA-Z0-9:-]))[a-zA-Z][a-zA-Z0-9:-]*\b
    | \**\s*\*?\s*(?: this\ transcription\s+is\b | note\s*:(?=.*(?:{"|".join(map(re.escape, ("image", *NOTE_HINTS)))})) ) )""",
    re.I | re.S | re.X,
)
_NOTE = re.compile(r"\s*\**\s*\*?\s*(?:this transcription\s+is\b|note\s*:)", re.I)
_DECORATION = re.compile(r"!\[[^\]]*\]\([^)]+\)"), re.compile(r"\*\*"), re.compile("__")
_TABLE_HINT = re.compile(f"</?(?:{_TAGS})", re.I)
_NO_MARKUP = (re.compile(r"<\s*br\s*/?\s*>", re.I), "\n"), (re.compile(r"<!--.*?-->"), ""), (re.compile(r"</?[a-zA-Z][^>]*>"), "")
WINDOW, REPEATS, KEPT, TAIL_LINE = 3, 5, 2, 48


class Edge(NamedTuple):
    at: int
    end: int
    begins: bool


def edges(text: str, escaped: bool = False) -> list[Edge]:
    return [Edge(m.start(), m.end(), bool(m[1])) for m in (_ESCAPED_EDGE if escaped else _EDGE).finditer(text)]


def has_open_table(text: str) -> bool:
    return sum(1 if e.begins else -1 for e in edges(html.unescape(text))) > 0


def open_table_at(text: str) -> int | None:
    """Where the last table begins, if no table's end follows; tags before escaped ones."""
    last = (found[-1] for found in (edges(text), edges(text, True)) if found)
    return next((e.at for e in last if e.begins), None)


def whole_tables(text: str) -> list[tuple[int, int]]:
    """Each table from a beginning to the next end; escaped ones where there are no others."""
    for escaped in (False, True):
        spans, begun = [], None
        for e in edges(text, escaped):
            if e.begins and begun is None:
                begun = e.at
            elif not e.begins and begun is not None:
                spans.append((begun, e.end))
                begun = None
        if spans:
            return spans
    return []


def tail_like(text: str, broken: str) -> str | None:
    """The text from that whole table on that begins most like the broken one; white space and escapes don't count."""
    bare = lambda t: "".join(html.unescape(t).split())
    own = bare(broken)
    alike = [(len(commonprefix([own, bare(text[a:b])])), -a) for a, b in whole_tables(text)]
    return text[-max(alike)[1] :].strip() if alike else None


def splice(text: str, second: str | None) -> str:
    """A transcription that breaks off within a table, with that table from a second one."""
    if not second or not has_open_table(text):
        return text
    at = open_table_at(text) or 0
    before, tail = text[:at].rstrip(), tail_like(second, text[at:])
    made = f"{before}\n\n{tail}".strip()
    return made if before and tail and not has_open_table(made) else text


def close_tables(text: str) -> str:
    """With the missing end tags of table elements on a line of their own. An end closes all within it, or everything where it ends nothing."""
    if not has_open_table(text):
        return text
    open_: list[str] = []
    for m in _ELEMENT.finditer(text):
        name = m[2].lower()
        if name not in TABLE_TAGS:
            continue
        if m[1]:
            del open_[max((i for i, other in enumerate(open_) if other == name), default=0) :]
        else:
            open_.append(name)
    missing = "".join(f"</{name}>" for name in reversed(open_))
    return f"{text.rstrip()}\n{missing}" if missing else text


def is_note(line: str) -> bool:
    return bool(_NOTE.match(line)) and bool(_NO_TEXT.match(line))


def without_tags(line: str) -> str:
    if {"<", ">"} <= set(line) and not _TABLE_HINT.search(line):
        for pattern, put in _NO_MARKUP:
            line = pattern.sub(put, line)
    return line


def short_tail(lines: list[str]) -> list[str]:
    """Lines whose end repeats a few short lines over and over, with the repetition cut to two."""
    short = next((i for i, x in enumerate(reversed(lines[-WINDOW:])) if not 0 < len(x.strip()) <= TAIL_LINE), WINDOW)
    for n in range(1, min(short, len(lines)) + 1):
        # a period of n lines: how many lines at the end equal those n before them
        same = next((i for i, (a, b) in enumerate(zip(reversed(lines), reversed(lines[:-n]), strict=False)) if a != b), len(lines) - n)
        times = same // n + 1
        if times >= REPEATS:
            return lines[: len(lines) - (times - KEPT) * n]
    return lines


def sanitize(text: str | None) -> str:
    """A transcription without images, emphasis, fences, rules, remarks, other tags than tables', repeated ends and runs of empty lines."""
    plain = [html.unescape(x) for x in re.split(r"\r\n|\r|\n", text or "")]
    for pattern in _DECORATION:
        plain = [pattern.sub("", x) for x in plain]
    lines = [part.rstrip() for x in plain if not _NO_TEXT.match(x) for part in without_tags(x).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(short_tail(lines))).strip()
