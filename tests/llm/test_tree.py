"""The suffix tree against one of plain dictionaries, in chunks and shards of all sizes."""

from __future__ import annotations

import math
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import suffixtree


class Plain:
    """The tree over lists of words, each ended by None; what comes before a text is False."""

    def __init__(self, texts: list[list], train: list[bool]):
        learnt = [t for t, y in zip(texts, train, strict=True) if y]
        self.c = Counter(w for t in learnt for w in t)
        self.n = sum(self.c.values())
        self.unseen = (sum(x == 1 for x in self.c.values()) + 0.5) / (self.n + 1)
        self.levels: list[tuple[dict, set]] = []  # successors of the contexts looked at, and those kept
        while len(self.levels) < suffixtree.DEEPEST:
            k = len(self.levels) + 1
            found = defaultdict(Counter)
            for t in learnt:
                for i, w in enumerate(t):
                    context = self.context(t, i, k)
                    if context and self.looked_at(context, len(learnt)):
                        found[context][w] += 1
            if not found:
                break
            kept = set()
            for context, after in found.items():
                n, free = sum(after.values()), max(1, len(after) - 1)
                ratio = 2 * sum(m * math.log(m / n / self.chance(context[1:], w)) for w, m in after.items())
                if ratio > free + suffixtree.DEVIATIONS * math.sqrt(2 * free):
                    kept.add(context)
            self.levels.append((found, kept))

    @staticmethod
    def context(t: list, i: int, k: int) -> tuple:
        return tuple([False, *t][i + 1 - k : i + 1]) if i + 1 >= k else ()

    def looked_at(self, context: tuple, begins: int) -> bool:
        if len(context) == 1:
            return (begins if context[0] is False else self.c[context[0]]) >= suffixtree.LEAST
        found, kept = self.levels[len(context) - 2]
        return context[1:] in kept and found.get(context[:-1], {}).get(context[-1], 0) >= suffixtree.LEAST

    def chance(self, context: tuple, w) -> float:
        p = (1 - self.unseen) * self.c[w] / max(1, self.n) if self.c[w] else self.unseen
        for k in range(1, len(context) + 1):
            own = context[len(context) - k :]
            if k > len(self.levels) or own not in self.levels[k - 1][1]:
                return p
            after = self.levels[k - 1][0][own]
            p = (after.get(w, 0) + len(after) * p) / (sum(after.values()) + len(after))
        return p


@pytest.fixture(scope="module")
def plain(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(10_000 + i, "to be or not to be that is the question " * (1 + i % 5)) for i in range(30)] + [(20_000, None), (20_001, ""), (20_002, "unheard of")]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    texts = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for _, t in docs]
    return docs, texts, Plain(texts, [i % 7 != 2 for i, _ in docs])


@pytest.mark.parametrize(("chunk", "per_shard", "hot"), [(1 << 20, 1 << 21, 1 << 20), (3_000, 5_000, 20), (200, 100_000, 1 << 20)])
def test_scores(spark, plain, chunk, per_shard, hot):
    docs, texts, tree = plain
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    out = {r["doc_id"]: r for r in suffixtree.score(table, F.col("doc_id") % 7 != 2, chunk, per_shard, hot).collect()}
    assert len(out) == len(docs) and len(tree.levels) >= 4
    total, distinct = tree.n, len(tree.c)
    for (i, _), t in zip(docs, texts, strict=True):
        want = sum(math.log10(tree.chance(tuple([False, *t][max(0, k + 1 - 16) : k + 1]), w)) for k, w in enumerate(t))
        base = sum(math.log10((tree.c[w] + 1) / (total + distinct + 1)) for w in t)
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(tree.c[w] > 0 for w in t), total)
        assert abs(r["score"] - want) < 1e-6 * abs(want) and abs(r["base_score"] - base) < 1e-6 * abs(base)


def test_distributions_add_up(plain):
    _, texts, tree = plain
    contexts = [c for _, kept in tree.levels for c in sorted(kept, key=str)[:40]] + [(), ("unheard",)]
    for context in contexts:
        assert abs(sum(tree.chance(context, w) for w in [*tree.c, "a word that is not there"]) - 1) < 1e-9


def test_more_text_keeps_more(spark):
    """What is kept grows with the corpus: both bounds are absolute."""
    sizes = []
    for n in (20, 200):
        texts = [[*f"w{i % 9} then w{i % 9} then v{i % 5} and x{i % (n // 10)} again".split(), None] for i in range(n)]
        tree = Plain(texts, [True] * n)
        sizes.append(sum(len(kept) for _, kept in tree.levels))
    assert sizes[1] > 2 * sizes[0]


def shard_of_questions(messages: int, size: int) -> list[dict]:
    """A shard's messages, each of size pairs of some contexts and words."""
    rng = np.random.RandomState(1)
    names = [f.split(" ")[0] for f in suffixtree._QUESTION.split(", ")]
    rows = []
    for chunk in range(messages):
        context_keys, word_keys = (np.sort(rng.randint(0, 1 << 62, size // n, np.int64).astype(np.uint64) * np.uint64(4)) for n in (10, 20))
        shared = np.uint64(4) * np.arange(size // 10, dtype=np.uint64) << np.uint64(32)  # half of the contexts are in every message
        context_keys[::2] = shared[::2]
        pairs = suffixtree._Pairs(
            rng.randint(0, len(context_keys), size), rng.randint(0, len(word_keys), size), np.full(size, 0.1), np.ones(size, bool),
            context_keys, np.full(len(context_keys), 50), word_keys, 1, 20,
        )
        rows += [dict(zip(names, q, strict=True)) for q in pairs.questions(chunk)]
    return rows


def test_a_shard_is_counted_in_ranges(monkeypatch):
    rows = shard_of_questions(4, 250_000)
    whole = suffixtree._count_pairs(rows, 1, 1 << 40)
    tracemalloc.start()
    parts = suffixtree._count_pairs(rows, 1, 1 << 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[5] or 0))
    for a, b in zip(order(whole), order(parts), strict=True):
        assert a[:8] == b[:8] and (a[0] is not None or np.allclose(a[8:], b[8:]))
    assert most < 60 * 1_000_000  # in one piece, a million questions take more than 100 MB


def test_a_state_is_stored_in_few_bytes():
    """A probability stands once for each (context, word); what is read back is the state."""
    rng = np.random.RandomState(2)
    n = 200_000
    contexts, words = rng.randint(0, 200, n).astype(np.int32), rng.randint(0, 50, n).astype(np.int32)
    sizes = suffixtree._packed(np.array([2 * n], np.int32))
    texts = suffixtree._Texts({"sizes": sizes, "lead": suffixtree._packed(np.zeros(1, np.int32)), "train": [True]})
    open_ = {"at": np.sort(rng.choice(2 * n, n, replace=False)), "contexts": contexts, "words": words, "chance": rng.rand(200, 50)[contexts, words]}
    open_ |= {"context_keys": rng.randint(0, 1 << 62, 200).astype(np.uint64), "context_n": np.full(200, 9), "word_keys": np.arange(50, dtype=np.uint64)}
    row = suffixtree._stored(suffixtree._State(texts, 1, **open_))
    back = suffixtree._read({**row, "sizes": sizes, "lead": suffixtree._packed(np.zeros(1, np.int32)), "train": [True], "chunk": 1})
    for c in suffixtree._OPEN:
        assert np.allclose(getattr(back, c).astype(float), open_[c].astype(float), rtol=1e-10, atol=0), c
    assert sum(map(len, row.values())) < 4 * n  # all columns by token took more than twice that


def test_written_tables_leave_no_shuffle_files(spark):
    from quire.llm.common import bucketed

    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = blocks()
    bucketed(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count(), "few", "k", 2)
    assert blocks() <= before


def test_a_state_is_read_from_its_chunk():
    """Contexts, words and their keys aren't stored: a chunk's tokens tell them."""
    rng = np.random.RandomState(3)
    n = 300_000
    sizes = np.array([1, 7, n - 8], np.int32)
    tokens, keys = rng.randint(0, 500, n).astype(np.int32) * rng.randint(0, 2, n).astype(np.int32), np.sort(rng.randint(0, 1 << 62, 500)).astype(np.uint64)
    row = {"chunk": 1, "train": [True] * 3, "sizes": suffixtree._packed(sizes), "lead": suffixtree._packed(np.zeros(3, np.int32)), "tokens": suffixtree._packed(tokens), "keys": suffixtree._steps(keys)}
    texts = suffixtree._Texts(row)
    # contexts of two words, with what is before a text as one: those of all tokens but a text's first
    at = np.setdiff1d(np.arange(n), texts.begins).astype(np.int32)
    last = np.where(np.isin(at - 1, texts.begins), 500, tokens[at - 2])
    code, contexts = np.unique(last * 500 + tokens[at - 1], return_inverse=True)
    context_keys = suffixtree._mixed(np.append(keys, suffixtree._START)[code // 500] * suffixtree._ODD + keys[code % 500])
    chance = rng.rand(len(code), 500)[contexts, tokens[at]]
    state = suffixtree._State(texts, 1, at=at, contexts=contexts, words=tokens[at], chance=chance, context_keys=context_keys, context_n=code + 9, word_keys=keys)
    stored = suffixtree._stored(state, deduced=True)
    back = suffixtree._read({**row, **stored}, 2)
    assert np.array_equal(back.context_keys[back.contexts], context_keys[contexts]) and np.array_equal(back.context_n[back.contexts], code[contexts] + 9)
    assert np.array_equal(back.word_keys[back.words], keys[tokens[at]]) and np.array_equal(back.at, at) and np.allclose(back.chance, chance, rtol=1e-10, atol=0)
    assert sum(map(len, stored.values())) < 0.6 * sum(map(len, suffixtree._stored(state).values()))
