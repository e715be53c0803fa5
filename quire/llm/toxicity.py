"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text
is cut into short overlapping byte windows; every window is compressed against both
dictionaries, and its gain is the number of bytes that the toxic dictionary saves over
the ordinary one. Windows above thresholds count by how much they exceed the rates that are calibrated on
ordinary training text, and a logistic curve over these, the largest gains and the length
gives the document's score.

Labels belong to whole documents, so most toxic training text is ordinary. The samples that train the
toxic dictionary are therefore the strings of toxic texts made of n-grams that these hold in far more
surroundings than ordinary texts do. The ordinary dictionary is trained on windows of ordinary text; the toxic one begins with the
same content and ends with its own, and the ordinary one is filled up to that length, so that a match costs both the same
bytes. Distinctive strings are taken out of the common part, or they would be no gain. The length is
one of the curve's features because the largest gains grow with the number of windows: its weight is negative.

Cases: null and empty texts have no windows and get the curve's value at zero evidence;
a text shorter than a window is one window; very long texts are scored whole, in pieces, and are learnt from whole or not at all; ties
among equal texts give equal scores; an empty table has no scores and nothing to learn from; extra columns pass through and the
score's column gets underscores where its name is taken; repeated rows get equal scores; without labelled rows of both classes the score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import trim, unused

WINDOW, STEP = 40, 20
SEARCH = dict(window_log=16, hash_log=14, chain_log=14, search_log=6, min_match=4, target_length=32, strategy=5)
SHARED_BYTES, OWN_BYTES = 8_192, 2_048
FILLER = b"\xff"  # a byte that no text has
FIT_ROWS = 2_500  # labelled rows of each class that fitting reads at most
FIT_BYTES = 32 << 20  # and bytes of them: the first rows in the order of a hash, as long as their whole texts fit
GRAM = 6
TRAIN_STEP = 20  # one window in so many trains the shared content
TOGETHER = 4  # distinctive strings in a training sample: the trainer takes no short ones
FOLDS = 3
WRONG = 0.02  # of ordinary rows may be marked at most, as far as the folds tell
LEVELS = (2, 3, 5)  # gains whose windows are counted
EVIDENCE, ODDS = 4.0, 6.0  # how much oftener one side holds a distinctive gram: in standard errors, and times
PIECE = 1 << 22


def window_offsets(n: int) -> np.ndarray:
    """Starts of the windows that cover n bytes; the last one ends with the text."""
    if n <= 0:
        return np.zeros(0, np.uint64)
    last = max(0, n - WINDOW)
    starts = np.arange(0, last + 1, STEP, dtype=np.uint64)
    return starts if int(starts[-1]) == last else np.append(starts, np.uint64(last))


class _Lengths:
    """Compressed lengths of windows under one dictionary."""

    def __init__(self, dictionary: bytes):
        self.compressor = zstandard.ZstdCompressor(
            compression_params=zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False),
            dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        )

    def __call__(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        view, one = memoryview(data), self.compressor.compress
        return np.fromiter((len(one(view[a : a + n])) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)), np.int16, len(starts))


@lru_cache(4)
def _lengths(dictionary: bytes) -> _Lengths:
    return _Lengths(dictionary)


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    rates: tuple[float, ...]
    weights: tuple[float, ...]

    def gains(self, data: bytes) -> np.ndarray:
        return _gains(_Lengths(self.toxic), _Lengths(self.ordinary), data)


def _gains(toxic: _Lengths, ordinary: _Lengths, data: bytes) -> np.ndarray:
    """Gain of each window of a text; long texts are done in pieces of whole steps."""
    starts = window_offsets(len(data))
    sizes = np.minimum(len(data) - starts.astype(np.int64), WINDOW)
    parts = []
    per = PIECE // STEP
    for i in range(0, len(starts), per):
        s, z = starts[i : i + per], sizes[i : i + per]
        low = int(s[0])
        piece = data[low : int(s[-1]) + WINDOW]
        s = s - np.uint64(low)
        parts.append(ordinary(piece, s, z) - toxic(piece, s, z))
    return np.concatenate(parts) if parts else np.zeros(0, np.int16)


def _features(gains: np.ndarray, rates: tuple[float, ...]) -> list[float]:
    """What the curve sees: the largest gains, by how much the windows above each of LEVELS exceed the ordinary rates, and the length."""
    if not len(gains):
        return [1.0] + [0.0] * (3 + len(LEVELS))
    n = len(gains)
    top = np.sort(gains)[-3:][::-1].astype(float)
    top = np.maximum(0, np.pad(top, (0, 3 - len(top))))
    surplus = [math.asinh((float((gains >= t).sum()) - n * r) / math.sqrt(n * r + 0.25)) for t, r in zip(LEVELS, rates, strict=True)]
    return [1.0, top[0] / 4, top[1:].mean() / 4, *surplus, math.log1p(n) / 2]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; column 0 is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _train(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on the samples; too little text for training serves as it is."""
    samples = [s for s in samples if s]
    joined = b"".join(samples)
    if len(samples) >= 64 and len(joined) > 4 * size:
        try:
            return zstandard.train_dictionary(size + 512, samples, k=WINDOW, d=GRAM).as_bytes()[-size:]
        except zstandard.ZstdError:
            pass
    return joined[-size:] or b" " * 8


def _grams(text: bytes) -> np.ndarray:
    """The GRAM-byte strings of a text as numbers, by place."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(b) < GRAM:
        return b[:0]
    out = np.zeros(len(b) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        out = (out << np.uint64(8)) | b[i : len(b) - GRAM + 1 + i]
    return out


def _shares(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each gram and the number of different surroundings it is found in, so that copies of a passage count once."""
    keys = []
    for t in texts:
        g = _grams(b" " * GRAM + t + b" " * GRAM)
        if len(g) > 2 * GRAM:
            around = (g[: -2 * GRAM] * np.uint64(0x9E3779B97F4A7C15) ^ g[2 * GRAM :]) * np.uint64(0xBF58476D1CE4E5B9)
            keys.append(g[GRAM:-GRAM] << np.uint64(16) | around >> np.uint64(48))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every = np.sort(np.concatenate(keys))
    every = every[np.append(True, every[1:] != every[:-1])] >> np.uint64(16)
    begin = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[begin], np.diff(np.append(begin, len(every)))


def _distinctive(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """The sorted grams that toxic texts hold in far more surroundings than ordinary ones do."""
    grams, n = _shares(toxic)
    other, m = _shares(ordinary)
    size_t, size_o = sum(map(len, toxic)) + 1, sum(map(len, ordinary)) + 1
    at = np.searchsorted(other, grams)
    found = (at < len(other)) & (other[np.minimum(at, max(0, len(other) - 1))] == grams) if len(other) else np.zeros(len(grams), bool)
    in_ordinary = np.zeros(len(grams))
    in_ordinary[found] = m[at[found]]
    expected = in_ordinary * size_t / size_o
    surplus = 2 * (np.sqrt(n + 0.375) - np.sqrt(expected + 0.375))  # in standard errors of a Poisson count
    return np.sort(grams[(surplus >= EVIDENCE) & (n >= ODDS * expected)])


def _runs(text: bytes, marked: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of marked grams begin and end."""
    g = _grams(text)
    if not len(marked) or not len(g):
        return []
    hits = np.flatnonzero(marked[np.minimum(np.searchsorted(marked, g), len(marked) - 1)] == g)
    if not len(hits):
        return []
    cut = np.flatnonzero(np.diff(hits) > GRAM)  # runs that touch are one
    return list(zip(hits[np.append(0, cut + 1)].tolist(), (hits[np.append(cut, len(hits) - 1)] + GRAM).tolist(), strict=True))


def _without(content: bytes, marked: np.ndarray) -> bytes:
    """A dictionary's content without its marked strings."""
    out, at = [], 0
    for a, b in _runs(content, marked):
        out.append(content[at:a])
        at = b
    return b"".join([*out, content[at:]])


def _different(texts: list[bytes]) -> list[bytes]:
    """The texts without near copies of earlier ones: those that share half of their eight least hashes of three grams in a row."""
    seen: set[int] = set()
    out = []
    for t in texts:
        g = _grams(t)
        g = (g[: -2 * GRAM] * np.uint64(0x9E3779B97F4A7C15) ^ g[GRAM:-GRAM]) * np.uint64(0xBF58476D1CE4E5B9) ^ g[2 * GRAM :]
        least = np.unique(g ^ (g >> np.uint64(29)))[:8].tolist()
        if sum(x in seen for x in least) * 2 < max(1, len(least)):
            out.append(t)
        seen.update(least)
    return out


def _dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    marked = _distinctive(toxic, ordinary)
    shared = _without(_train([t[int(s) : int(s) + WINDOW] for t in ordinary for s in window_offsets(len(t))[::TRAIN_STEP]], SHARED_BYTES), marked)
    strings = [t[a:b] for t in toxic for a, b in _runs(t, marked)]
    own = _train([b"".join(strings[i : i + TOGETHER]) for i in range(0, len(strings), TOGETHER)], OWN_BYTES)
    return shared + own, shared + FILLER * len(own)


def _threshold(logits: np.ndarray, y: np.ndarray, prior: float) -> float:
    """The bound with the best balance of precision and recall (F1) where a share `prior` is toxic, but none that more than WRONG of the ordinary rows pass."""
    order = np.argsort(-logits, kind="stable")
    caught = np.cumsum(y[order]) / y.sum() * prior
    wrong = np.cumsum(1 - y[order]) / (1 - y).sum() * (1 - prior)
    best = int(np.argmax(2 * caught / (caught + wrong + prior)))
    below = logits[order[min(best + 1, len(order) - 1)]]
    return float(max((logits[order[best]] + below) / 2, np.quantile(logits[y == 0], 1 - WRONG)))


def fit(toxic: list[bytes], ordinary: list[bytes], prior: float) -> ToxicityModel:
    """Dictionaries, rates and curve from labelled texts; prior is the share of toxic rows.

    Rates and curve come from texts that the dictionaries at hand were not trained on,
    FOLDS times over; the final dictionaries are trained on all.
    """
    toxic, ordinary = _different(toxic), _different(ordinary)
    held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for k in range(FOLDS):
        rest = [[t for i, t in enumerate(side) if i % FOLDS != k] for side in (toxic, ordinary)]
        a, b = map(_Lengths, _dictionaries(*rest))
        for into, side in zip(held, (toxic, ordinary), strict=True):
            into.extend(_gains(a, b, t) for t in side[k::FOLDS])
    ordinary_gains = np.concatenate(held[1] + [np.zeros(1)])
    rates = tuple(float((ordinary_gains >= t).mean()) for t in LEVELS)
    x = np.array([_features(g, rates) for side in held for g in side])
    y = np.array([1.0] * len(held[0]) + [0.0] * len(held[1]))
    w = _logistic(x, y)
    w[0] -= _threshold(x @ w, y, prior)
    return ToxicityModel(*_dictionaries(toxic, ordinary), rates, tuple(map(float, w)))


def fit_from_labels(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> ToxicityModel | None:
    """Fit on at most FIT_ROWS labelled rows of each class; docs: doc_id, text; labels: doc_id, toxic.

    keep: a condition on doc_id for rows that may be learnt from. Rows are chosen by a hash of
    doc_id; of a document with several labels the largest counts. None if a class is empty.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n == n_toxic:
        return None
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(*order).limit(FIT_ROWS)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.encode("text", "UTF-8").alias("part")).join(F.broadcast(picked), "doc_id")  # at most 2 * FIT_ROWS ids
    rows = rows.dropDuplicates(["doc_id"])
    so_far = F.sum(F.length("part").cast("bigint")).over(Window.partitionBy("toxic").orderBy(*order))  # of at most FIT_ROWS rows a class
    rows = rows.withColumn("bytes", so_far).where(F.col("bytes") <= FIT_BYTES).select("doc_id", "toxic", "part").toArrow().sort_by("doc_id")
    texts = ([], [])
    for y, part in zip(rows["toxic"].to_pylist(), rows["part"].to_pylist(), strict=True):
        texts[y].append(part)
    if min(map(len, texts)) < 4:
        return None
    del rows
    model = fit(texts[1], texts[0], n_toxic / n)
    trim()  # the driver goes on with other work
    return model


def scorer(spark: SparkSession, model: ToxicityModel | None) -> Callable[[Column], Column]:
    """A column function from text to score (0 to 1)."""
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of at most SHARED_BYTES + OWN_BYTES

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m = shared.value
        if m is None:
            return pa.array(np.zeros(len(texts)))
        toxic, ordinary, w = _lengths(m.toxic), _lengths(m.ordinary), np.array(m.weights)
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            x = np.array(_features(_gains(toxic, ordinary, (t.as_py() or "").encode("utf-8", "replace")), m.rates))
            out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ w)))))
        return pa.array(out)

    return lambda text: score(text.cast("string"))


def score_documents(docs: DataFrame, model: ToxicityModel | None, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a column of toxicity scores behind the others, named into, or that with underscores where docs has such a column."""
    return docs.withColumn(unused(into, docs.columns), scorer(docs.sparkSession, model)(F.col(text)))
