"""Benchmark decontamination by winnowing.

The least hash of every W neighbouring k-grams is a fingerprint of a text. Any span of
W + k - 1 words has W k-grams, and its least one is a fingerprint of both texts that hold
the span, so with W + k - 1 = WINDOW words no shared window is missed. Fingerprints of the
benchmark and the documents are joined, and around each match the windows themselves
are compared, first by hash, then word by word.

An item of fewer words than WINDOW is one window of its own; such items are looked up by
their length, with k equal to it.

The benchmark is a stated query set. It is read in blocks of at most BLOCK characters, each
of which is sent to all tasks and joined with all documents where they lie, without
moving them. One block is the usual case; with more, the spans found with each
are merged for each document.

Cases: null and wordless texts have no words and no hits; wordless items are ignored;
equal items are each counted; windows of equal words are ties, and all their items are named; extra columns stay as they are; repeated rows give repeated results; very long texts are done
in pieces that overlap by a window less one word; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import chunks, unused

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1  # k-grams in a window
BLOCK = 16 << 20  # characters of benchmark text that one task holds at a time
PIECE = 2 << 20
#: A-Z lower-cased; whatever isn't a letter, a digit or beyond ASCII becomes a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_tables: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of data, in which a blank separates words."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(_tables[0]) <= len(b):
        _tables[:] = _powers(_BASE, len(b) + 1), _powers(_INVERSE, len(b) + 1)
    on = np.concatenate(([False], b != 32, [False]))
    edge = np.flatnonzero(on[1:] != on[:-1])
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b.astype(np.uint64) * _tables[0][: len(b)], out=total[1:])
    return starts, ends, _mix((total[ends] - total[starts]) * _tables[1][starts])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbouring words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _STEP + hashes[i : n + i]
    return _mix(out)


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbouring hashes."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = g[:n].copy()
    for i in range(1, w):
        np.minimum(out, g[i : n + i], out=out)
    return out


def clean(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_WORDS)


@dataclass
class Index:
    """The windows of a block of items as arrays: the fingerprints, and by length of windows their sorted hashes, items and places in the joined texts."""

    fingerprints: np.ndarray
    hashes: dict[int, np.ndarray]
    items: dict[int, np.ndarray]
    places: dict[int, tuple[np.ndarray, np.ndarray]]  # first byte and the byte behind
    text: bytes
    names: list = field(default_factory=list)

    def holding(self, size: int, h: int, words: bytes) -> set[int]:
        """The items that hold a window with this hash and these words."""
        a, b = np.searchsorted(self.hashes[size], np.array([h], np.uint64), "left")[0], np.searchsorted(self.hashes[size], np.array([h], np.uint64), "right")[0]
        begin, end = self.places[size]
        return {int(self.items[size][i]) for i in range(a, b) if self.text[begin[i] : end[i]] == words}


def index(items: list[tuple[object, str | None]]) -> Index:
    found: dict[int, list[tuple[np.ndarray, ...]]] = {}
    prints, names, texts, at = [], [], [], 0
    for number, (name, text) in enumerate(items):
        names.append(name)
        data = b" ".join(clean(text).split())
        starts, ends, h = word_hashes(data)
        if not len(h):
            continue
        size = min(WINDOW, len(h))
        if size == WINDOW:
            prints.append(winnow(grams(h, GRAM), SPAN))
        g = grams(h, size)
        _, first = np.unique(g, return_index=True)  # an item's window once
        found.setdefault(size, []).append((g[first], np.full(len(first), number, np.int32), starts[first] + at, ends[first + size - 1] + at))
        texts.append(data)
        at += len(data)
    hashes, numbers, places = {}, {}, {}
    for size, parts in found.items():
        h, number, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        hashes[size], numbers[size], places[size] = h[order], number[order], (begin[order].astype(np.int32), end[order].astype(np.int32))
    return Index(np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64), hashes, numbers, places, b"".join(texts), names)


def _in(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_) or not len(values):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


class Matcher:
    """Finds the windows of an index in texts. A table by the hashes' top bits sorts out most hashes before the exact search."""

    def __init__(self, of: Index):
        self.of = of
        self.sieve = {k: self._sieve(v) for k, v in {0: of.fingerprints, **of.hashes}.items()}

    @staticmethod
    def _sieve(values: np.ndarray) -> np.ndarray:
        on = np.zeros(1 << 20, bool)
        on[(values >> np.uint64(44)).astype(np.int64)] = True
        return on

    def places(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """By window length, the words at which a window may begin."""
        out = {}
        for size, hashes in self.of.hashes.items():
            if size == WINDOW:
                least = winnow(g := grams(h, GRAM), SPAN)
                maybe = np.flatnonzero(self.sieve[0][(least >> np.uint64(44)).astype(np.int64)])
                maybe = maybe[_in(least[maybe], self.of.fingerprints)]
                if len(maybe):  # extend the match: hash the windows of these spans
                    whole = np.zeros(len(maybe), np.uint64)
                    for i in range(WINDOW):
                        whole = whole * _STEP + h[maybe + i]
                    maybe = maybe[_in(_mix(whole), hashes)]
                del g
            else:
                g = grams(h, size)
                maybe = np.flatnonzero(self.sieve[size][(g >> np.uint64(44)).astype(np.int64)])
                maybe = maybe[_in(g[maybe], hashes)]
            if len(maybe):
                out[size] = maybe
        return out

    def spans(self, data: bytes, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, places: dict[int, np.ndarray]) -> tuple[list[tuple[int, int]], set[int]]:
        """(first word, words) of each window that occurs, compared word by word, and the items whose windows occur."""
        spans, items = [], set()
        for size, at in places.items():
            for i in at.tolist():
                whole = int(grams(h[i : i + size], size)[0])
                words = b" ".join(data[int(starts[i]) : int(ends[i + size - 1])].split())
                hit = self.of.holding(size, whole, words)
                if hit:
                    spans.append((i, size))
                    items |= hit
        return spans, items

    def text(self, data: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """The number of words of one text, its hit spans in words, and its items."""
        if len(data) <= PIECE:
            starts, ends, h = word_hashes(data)
            return len(h), *self.spans(data, starts, ends, h, self.places(h))
        n, spans, items, at = 0, [], set(), 0
        while at < len(data):  # n words lie before `at`; a piece ends behind a blank and is read on for a window less one word
            cut = data.find(b" ", at + PIECE)
            cut = len(data) if cut < 0 else cut
            own = len(word_hashes(data[at:cut])[2])
            end = cut
            for _ in range(WINDOW - 1):
                while end < len(data) and data[end] == 32:
                    end += 1
                end = data.find(b" ", end) if end < len(data) else end
                end = len(data) if end < 0 else end
            starts, ends, h = word_hashes(data[at:end])
            s, i = self.spans(data[at:end], starts, ends, h, self.places(h))
            spans += [(n + a, k) for a, k in s]
            items |= i
            n, at = n + own, cut
        return n, spans, items

    def batch(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """text() for many texts at once: they are hashed together, and only those with a possible window are looked at alone."""
        cleaned = [clean(t) for t in texts]
        for a, b in chunks([len(c) for c in cleaned], PIECE):
            if b - a == 1:
                yield self.text(cleaned[a])
                continue
            data = b" ".join(cleaned[a:b])
            starts, ends, h = word_hashes(data)
            begin = np.cumsum([0] + [len(c) + 1 for c in cleaned[a:b]])
            first = np.searchsorted(starts, begin)
            maybe = [p for p in self.places(h).values()]
            hit = np.unique(np.searchsorted(first, np.concatenate(maybe), "right") - 1) if maybe else np.zeros(0, int)
            hit = set(hit.tolist())
            for i in range(b - a):
                yield self.text(cleaned[a + i]) if i in hit else (int(first[i + 1] - first[i]), [], set())


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any of the spans."""
    total, end = 0, 0
    for a, k in sorted(spans):
        total += max(0, a + k - max(a, end))
        end = max(end, a + k)
    return total


def names_of(items: set, names: list) -> list[str]:
    return sorted({str(names[i]) for i in items})


_SCHEMA = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,words:bigint>>"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of at most BLOCK characters, one block at the driver at a time."""
    block, size = [], 0
    for r in benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        if block and size + len(r["text"]) > BLOCK:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield block


def matcher(spark: SparkSession, items: list[tuple[object, str | None]]) -> Callable:
    """A column function from text to struct<n_words, n_hit, items, spans> for one block of items."""
    shared = spark.sparkContext.broadcast(index(items))  # of at most BLOCK characters of items

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':', 1) for x in _SCHEMA.split(', '))}>")
    def run(texts: pa.Array) -> pa.Array:
        m = Matcher(shared.value)
        out = []
        for n, spans, items in m.batch(texts.to_pylist()):
            out.append({"n_words": n, "n_hit": covered(spans), "items": names_of(items, m.of.names), "spans": [{"start": a, "words": k} for a, k in sorted(set(spans))]})
        span = pa.struct([("start", pa.int64()), ("words", pa.int64())])
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span))]))

    return lambda text: run(text.cast("string"))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "leak") -> DataFrame:
    """docs with a struct column (into; with underscores where docs has a column of that name): n_words, n_hit, items (ids as strings, sorted) and spans of benchmark windows.

    docs may have any columns; benchmark has item_id and text.
    """
    out, into = None, unused(into, docs.columns)
    for number, block in enumerate(_blocks(benchmark)):
        column = matcher(docs.sparkSession, block)(F.col(text))
        out = docs.withColumn(into, column) if number == 0 else out.withColumn(into, _merged(F.col(into), column))
    return out


def _merged(a, b):
    """Two blocks' findings for the same text as one."""
    spans = F.array_sort(F.array_distinct(F.concat(a["spans"], b["spans"])))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("end"))
    n_hit = F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(
            (s["total"] + F.greatest(F.lit(0), x["start"] + x["words"] - F.greatest(x["start"], s["end"]))).cast("bigint").alias("total"),
            F.greatest(s["end"], x["start"] + x["words"]).alias("end"),
        ),
        lambda s: s["total"],
    )
    items = F.array_sort(F.array_distinct(F.concat(a["items"], b["items"])))
    return F.struct(a["n_words"].alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), spans.alias("spans"))

