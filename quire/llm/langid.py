"""Language identification with a bit-sliced Bloom filter of n-grams.

Every slot of the filter holds one bit per language, so looking up an n-gram's slots and
and-ing them gives, at once, all languages that may contain it. A text's n-grams are
looked up, the hits of each language counted, and each count is corrected for the share
of lookups that a language's filter answers by chance. The language with the largest
corrected count wins; the score is its share of the n-grams times its lead.

A language contains an n-gram if its training text has it at RATE or more of the rate of
the language that has it most, at least LEAST times: else quotations in other languages would
fill every filter with everything.

N-grams are runs of SIZE characters over lower-cased letters, with one blank for whatever lies
between words; only those that hold a letter count. Training reads at most FIT_ROWS rows of each language, the first in the order of
a hash, as long as their whole texts fit into FIT_CHARS.

Cases: null, empty and letterless texts get `und` and score 0; ties go to the language
first in order; letters without any known n-gram go to the commonest language with score 0; very long texts are read in pieces that carry the last
letters on, with the result of reading them at once; repeated rows come back as often; an empty table has nothing to learn from; extra columns are
no input; with no training rows all is `und`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import chunks

SIZE = 4
FIT_ROWS = 2_000  # training rows of a language
FIT_CHARS = 16 << 20  # and characters of them
RATE, LEAST = 0.2, 3
HASHES = 3
BITS_PER_GRAM = 12
PIECE = 1 << 20
UNKNOWN = "und"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as numbers, and the place where each text's begin (one more at the end)."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    lowered = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in lowered])
    letter = _is_letter()[code]
    # blanks in a row become one: a blank stays only before a letter or at a text's start
    before = np.append(False, letter[:-1])
    keep = letter | before
    keep[np.append(0, ends[:-1])] = True
    code = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
    ends = np.cumsum(keep)[ends - 1]
    if len(code) < SIZE:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    n = len(code) - SIZE + 1
    out = np.zeros(n, np.uint64)
    for i in range(SIZE):
        out = (out << np.uint64(16)) ^ code[i : n + i]  # astral letters overlap a little; that is only a hash
    # drop what crosses from one text into the next
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - SIZE + 1) : e] = False
    begins = np.append(0, np.cumsum(inside)[np.clip(np.minimum(ends, n) - 1, 0, None)])
    return out[inside], begins.astype(np.int64)


def long_grams(text: str, piece: int = PIECE) -> Iterator[np.ndarray]:
    """What grams gives for one text, a piece of it at a time: the last SIZE - 1 characters of a piece, and whether it ends within a word, are carried on."""
    carried, inside = np.array([32], np.uint64), False
    for at in range(0, len(text) + 1, piece):
        part = text[at : at + piece].lower()
        last = at + piece >= len(text) + 1
        code = np.frombuffer((part + " " if last else part).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[code]
        keep = letter | np.append(inside, letter[:-1])[: len(letter)]
        inside = bool(letter[-1]) if len(letter) else inside
        code = np.concatenate([carried, np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)])
        n = max(0, len(code) - SIZE + 1)
        out = np.zeros(n, np.uint64)
        for i in range(SIZE):
            out = (out << np.uint64(16)) ^ code[i : n + i]
        yield out
        carried = code[-(SIZE - 1) :]


def _slots(g: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """HASHES slots of each n-gram among 2**bits, from two hashes that share no bits."""
    h = g * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    h ^= h >> np.uint64(32)
    first, step = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for i in range(HASHES):
        yield (first + np.uint64(i) * step) & np.uint64((1 << bits) - 1)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    bits: int
    filter: np.ndarray  # 2**bits rows of whole 64-bit words, one bit a language
    chance: np.ndarray  # how often a language's filter holds an n-gram that was never put in
    default: int  # the language of letters that no filter knows

    def hits(self, g: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For each text (row) and language, the n-grams that the language may contain."""
        out = np.zeros((len(begins) - 1, len(self.languages)), np.int64)
        for word in range(self.filter.shape[1]):
            column = self.filter[:, word]
            mask = None
            for s in _slots(g, self.bits):
                mask = column[s] if mask is None else mask & column[s]
            for j in range(64 * word, min(len(self.languages), 64 * word + 64)):
                total = np.append(0, np.cumsum((mask >> np.uint64(j % 64)) & np.uint64(1)))
                out[:, j] = total[begins[1:]] - total[begins[:-1]]
        return out

    def decide(self, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each text's language (-1 for none) and its score."""
        n = np.maximum(n, 1)[:, None]
        corrected = np.clip((hits - n * self.chance) / (1 - self.chance), 0, None)
        best = np.where(corrected.max(1) > 0, corrected.argmax(1), self.default)
        top = corrected[np.arange(len(best)), best]
        rest = corrected.copy()
        rest[np.arange(len(best)), best] = 0
        second = rest.max(1) if corrected.shape[1] > 1 else np.zeros(len(best))
        score = np.sqrt(np.clip(top / n[:, 0], 0, 1) * (top / np.maximum(top + second, 1e-9)))
        return best, np.clip(score, 0, 1)


def fit(samples: dict[str, list[str]], default: str | None = None) -> LanguageModel | None:
    """A model of the languages in samples; default: the one for texts that say nothing."""
    names = tuple(sorted(k for k, v in samples.items() if v))
    counted, totals = [], []
    for name in names:
        parts = []
        for a, b in chunks([len(t) for t in samples[name]], 4 * PIECE):
            parts.append(np.unique(grams(samples[name][a:b])[0], return_counts=True))
        g = np.concatenate([p[0] for p in parts])
        order = np.argsort(g, kind="stable")
        g, c = g[order], np.concatenate([p[1] for p in parts])[order]
        new = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
        counted.append((g[new], np.add.reduceat(c, new) if len(new) else c))
        totals.append(max(1, int(c.sum())))
    if not names:
        return None
    every = np.unique(np.concatenate([g for g, _ in counted]))
    if not len(every):
        return None
    rate = np.zeros((len(names), len(every)))
    count = np.zeros((len(names), len(every)), np.int64)
    for j, (g, c) in enumerate(counted):
        at = np.searchsorted(every, g)
        count[j, at], rate[j, at] = c, c / totals[j]
    member = (rate >= RATE * rate.max(0)) & (count >= LEAST)
    bits = max(10, int(np.ceil(np.log2(BITS_PER_GRAM * max(1, member.sum(1).max())))))
    table = np.zeros((1 << bits, (len(names) + 63) // 64), np.uint64)
    for j in range(len(names)):
        for s in _slots(every[member[j]], bits):
            np.bitwise_or.at(table[:, j // 64], s, np.uint64(1) << np.uint64(j % 64))
    filled = np.array([((table[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(names))])
    return LanguageModel(names, bits, table, filled**HASHES, names.index(default) if default in names else 0)


def fit_from_rows(docs: DataFrame, keep: Column | None = None) -> LanguageModel | None:
    """Fit on at most FIT_ROWS rows of each language, chosen by a hash of doc_id; docs: doc_id, text, lang."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if keep is not None:
        known = known.where(keep)
    order = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    share = known.groupBy("lang").count()
    # of each language, the hash below which some FIT_ROWS rows and half as many lie; then the exact first ones of these few
    bound = share.withColumn("most", F.least(F.lit(1.0), F.lit(1.5 * FIT_ROWS) / F.col("count"))).drop("count")
    near = known.join(F.broadcast(bound), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) <= F.col("most") * float(1 << 53))
    picked = near.select("lang", order.alias("o"), F.col("text").alias("part"))
    first = Window.partitionBy("lang").orderBy("o", "part")
    ranked = picked.withColumns({"r": F.row_number().over(first), "so_far": F.sum(F.char_length("part").cast("bigint")).over(first.rowsBetween(Window.unboundedPreceding, 0))})
    rows = ranked.where((F.col("r") <= FIT_ROWS) & (F.col("so_far") <= FIT_CHARS)).select("lang", "o", "part").toArrow()
    samples: dict[str, list[str]] = {}
    for lang, _, text in sorted(zip(rows["lang"].to_pylist(), [(x["h"], x["doc_id"]) for x in rows["o"].to_pylist()], rows["part"].to_pylist(), strict=True)):
        samples.setdefault(lang, []).append(text)
    first = share.orderBy(F.desc("count"), "lang").first()
    return fit(samples, first["lang"] if first else None)


def identify(texts: list[str], model: LanguageModel | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, scores
    for a, b in chunks([len(t) for t in texts], PIECE):
        hits, n = np.zeros((b - a, len(model.languages)), np.int64), np.zeros(b - a, np.int64)
        if b - a == 1 and len(texts[a]) > PIECE:
            for g in long_grams(texts[a]):
                hits += model.hits(g, np.array([0, len(g)]))
                n += len(g)
        else:
            g, begins = grams(texts[a:b])
            hits += model.hits(g, begins)
            n += np.diff(begins)
        best, score = model.decide(hits, n)
        for i in range(b - a):
            if n[i] or any(map(str.isalpha, texts[a + i])):
                names[a + i], scores[a + i] = model.languages[best[i]], score[i]
    return names, scores


def identifier(spark: SparkSession, model: LanguageModel | None) -> Callable[[Column], Column]:
    """A column function from text to struct<lang:string, score:double>."""
    shared = spark.sparkContext.broadcast(model)  # bounded by FIT_CHARS n-grams a language, in practice a few MB

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        names, scores = identify([t or "" for t in texts.to_pylist()], shared.value)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])

    return lambda text: run(text.cast("string"))
