"""Document quality by hierarchical empirical Bayes.

Two kinds of evidence meet. A document classifier, a logistic curve over simple properties of the text, gives
the odds that a text is good. Sites give odds of their own: each host, and each path below it, has
a posterior for the share of good documents, from the labels of its documents and, with a
smaller weight, from the classifier's view of its unlabelled ones. The posteriors are
beta distributions; a path's prior is centred on its host's posterior mean, a host's on the global
share, and how strongly sparse ones are drawn there is estimated from how much hosts (paths) differ beyond
chance, by moments. The score is the classifier's odds times how far the site's odds are from the
global ones; a document's own label or classifier's view doesn't count in the site's odds that it meets.

Sites are counted by grouped aggregation; a site's rows are summed where they are before they meet, and the
counts, one row a path, come back by a join that Spark may broadcast or split.

Cases: null and empty texts have the properties of an empty text; a null source is a site of its own; a source with
slashes is host and path, without any the path is empty; rows with several labels count by their mean; repeated rows count
and come back as often; without labels of both classes the score is the global share, 0.5 with none at all.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

FIT_ROWS = 20_000  # labelled rows that the classifier is fitted on at most; they are rows of a dozen numbers
SOFT = 0.2  # the weight of an unlabelled document against a labelled one in its site
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e6  # pseudo-documents of a prior
_WORD = re.compile(r"\S+")
NAMES = ("bias", "log_words", "letters", "upper", "signs", "digits", "distinct", "top_word", "repeats", "endings", "bars", "length", "dull")


def properties(text: str | None) -> list[float]:
    """The numbers that the classifier sees, of the whole text."""
    t = text or ""
    words = t.split()
    n, size = len(words), max(1, len(t))
    if not n:
        return [1.0] + [0.0] * (len(NAMES) - 1)
    blanks = size - sum(map(len, words))
    letters = sum(map(str.isalpha, t)) if not t.isascii() else len(t.translate(_ASCII_LETTERS))
    upper = len(_UPPER.findall(t))
    digits = len(_DIGIT.findall(t))
    signs = size - blanks - letters - digits
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    tails = sum(not w[-1].isalnum() for w in words)
    return [
        1.0,
        math.log1p(n) / 5,
        letters / size,
        upper / max(1, letters),
        signs / size,
        digits / size,
        len(counts) / n,
        max(counts.values()) / n,
        repeats / n,
        tails / n,
        counts.get("|", 0) / n,
        (size - blanks) / n / 10,
        sum(c for c in counts.values() if c > 1) / n,
    ]


_ASCII_LETTERS = {i: None for i in range(128) if not chr(i).isalpha()}
_UPPER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d")


def _bends(x: np.ndarray) -> np.ndarray:
    """Properties with their squares, so that a curve may favour the middle."""
    return np.concatenate([x, x[:, 1:] ** 2], 1)


@dataclass(frozen=True)
class Classifier:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    share: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (_bends(x) - np.array(self.mean)) / np.array(self.scale)
        z[:, 0] = 1
        return np.clip(z @ np.array(self.weights), -12, 12)


def fit(x: np.ndarray, y: np.ndarray) -> Classifier | None:
    """A ridge-penalised logistic curve by Newton's method; None without both classes."""
    if not len(y) or y.min() == y.max():
        return None
    b = _bends(x)
    mean, scale = b.mean(0), b.std(0)
    scale[scale < 1e-9] = 1
    z = (b - mean) / scale
    z[:, 0] = 1
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return Classifier(tuple(mean), tuple(scale), tuple(w), float(y.mean()))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, path and properties `x` for docs (doc_id, text, source)."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([properties(t.as_py()) for t in texts], pa.list_(pa.float64()))

    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select("doc_id", F.substring_index(source, "/", 1).alias("host"), source.alias("path"), run(F.col("text").cast("string")).alias("x"))


def _strength(sites: DataFrame, outer: Column) -> float:
    """How many pseudo-documents the prior is worth, from how much the sites' shares (good / n) scatter around outer, by moments.

    Under a beta prior of that strength s the expected square of a site's deviation is v / n + v (n - 1) / (n (s + 1)), v = outer (1 - outer).
    """
    v = outer * (1 - outer)
    d = F.col("good") / F.col("n") - outer
    n = F.col("n")
    row = sites.where(n > 1).agg(F.sum(n * d * d).alias("found"), F.sum(v).alias("chance"), F.sum(v * (n - 1)).alias("spread")).first()
    if row is None or not row["spread"]:
        return MOST_STRENGTH
    beyond = (row["found"] - row["chance"]) / row["spread"]
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / beyond - 1))) if beyond > 0 else MOST_STRENGTH


def score(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """doc_id, train, score, doc_score, host_share and path_share for docs (doc_id, text, source); labels: doc_id, quality.

    train: a condition on doc_id for labels that may be learnt from; other labels are never looked at.
    """
    spark = docs.sparkSession
    seen = written(measured(docs).withColumn("train", train), "properties")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    marked = seen.join(known.where(train), "doc_id", "left")
    marked = written(marked.select("doc_id", "host", "path", "train", "x", "quality"), "marked")
    some = marked.where(F.col("quality").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("x", "quality").toArrow()
    x = np.array(some["x"].to_pylist()).reshape(-1, len(NAMES))
    quality = some["quality"].to_numpy()
    model = fit(x, (quality >= 0.5).astype(float)) if len(quality) else None
    share = float(quality.mean()) if len(quality) else 0.5
    shared = spark.sparkContext.broadcast(model)  # two dozen numbers

    @F.arrow_udf("double")
    def logit(x: pa.Array) -> pa.Array:
        m = shared.value
        if m is None:
            return pa.array(np.full(len(x), math.log((share + 1e-6) / (1 - share + 1e-6))))
        return pa.array(m.logit(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))))

    judged = written(marked.select("doc_id", "host", "path", "train", "quality", logit("x").alias("logit")), "judged")
    p = 1 / (1 + F.exp(-F.col("logit")))
    weight = F.when(F.col("quality").isNotNull(), 1.0).otherwise(SOFT)
    paths = judged.groupBy("host", "path").agg(F.sum(weight).alias("n"), F.sum(weight * F.coalesce("quality", p)).alias("good"))
    paths = written(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    centre = (float(total[1]) + 0.5) / (float(total[0]) + 1.0) if total[0] else 0.5
    strength = _strength(hosts, F.lit(centre))
    share_of = (F.col("good") + strength * centre) / (F.col("n") + strength)
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), share_of.alias("outer"))
    both = paths.join(hosts, "host")
    below = _strength(both, F.col("outer"))
    # a document's own evidence is taken out of its site's before the two meet
    own, mark = weight, weight * F.coalesce("quality", p)
    host = (F.col("host_good") - mark + strength * centre) / (F.col("host_n") - own + strength)
    path = (F.col("good") - mark + below * F.col("host_share")) / (F.col("n") - own + below)
    combined = judged.join(both, ["host", "path"]).withColumn("host_share", host).withColumn("path_share", path)
    odds = F.ln(F.col("path_share") / (1 - F.col("path_share"))) - math.log(centre / (1 - centre))
    return combined.select(
        "doc_id", "train", (1 / (1 + F.exp(-(F.col("logit") + odds)))).alias("score"), p.alias("doc_score"), "host_share", "path_share"
    )
