"""Language-model scores from a probabilistic suffix tree over words.

Tree. Contexts are runs of words before a symbol, of any length up to DEEPEST. A context is looked at if it occurs LEAST times or
more in training rows, its longest proper suffix is kept and its longest proper prefix was looked at; it is kept if its next-word distribution
diverges from that suffix's by more than chance: twice the log-likelihood ratio must pass its expectation by DEVIATIONS
standard deviations. Both bounds are absolute, so a larger corpus keeps more and longer contexts; the
depth grows until no context is left to look at. A kept context's distribution is smoothed
with its suffix's by the number of its distinct successors (Witten and Bell), and the empty
context gives known words their share and one unknown word the share of the words seen once. So the distribution
after any context sums to one over the training words and the unknown one. A token is scored in the state of its longest kept context.

Distribution. Nothing of the corpus is sent to all tasks but what is said below. Documents become chunks of at most CHUNK word numbers, bucketed
by chunk. For each depth a chunk asks once for each distinct (context, word) that it holds, with its
training count. Questions are dealt by the hash of the context, those of a context with HOT
occurrences or more by the word's as well; a shard adds up, tests and answers, and the answers, which are counts in the
order of the questions, go back to the chunk. Numbers travel as compressed arrays. Chunks stay where they are; tokens whose
context can't grow leave the state with their probability. A state only holds what a chunk's tokens don't tell: contexts, words and their
keys are made from these again. The sums of the hot contexts are all that is broadcast: as contexts of one
depth share the training tokens and HOT is a 2**20th of these at least, there are 2**20 at most.

Words are told apart by 64 bits of a hash, contexts too, successors of a context by 40.

Cases: null and empty texts are the end symbol alone; with no training rows all is unknown with probability one half;
null ids count as the empty text for the fold; repeated rows count and come back as often; a text
beyond a chunk is cut into parts that begin with DEEPEST words of the part before, which only serve as context; an
empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bucketed, release, trim, written

LEAST = 8  # occurrences of a context
DEVIATIONS = 4.0
DEEPEST = 16  # words of a context
CHUNK = 1 << 20  # tokens; a worker takes some 200 bytes for each, and smaller chunks ask more
IN_BUCKET, BYTES_A_TOKEN = 4, 5
PER_SHARD = 2 << 20  # questions that a shard answers on average
TOGETHER = 1 << 19  # questions that a shard counts at a time
HOT = 1 << 20
GRAIN = float(1 << 20)  # a chunk rounds its sums of logarithms to parts of this size
END = b" "  # the end symbol, which is no word
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_START = np.uint64(0x9E3779B97F4A7C15)  # the key of the context before a text
_ODD = np.uint64(0xD6E8FEB86659FD93)
_PIECE = 4 << 20  # bytes of a text that are split at a time


def words(text: str | None) -> Iterator[list[bytes]]:
    """A-Z lower-cased words between ASCII white space, piece by piece, then the end symbol."""
    data = (text or "").encode("utf-8", "replace").translate(_LOWER)
    at = 0
    while len(data) - at > _PIECE:
        end = at + _PIECE
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].split()
        at = end
    yield [*data[at:].split(), END]


def _packed(a: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _summed(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_CHUNK = "chunk bigint, ids array<{id}>, rows array<bigint>, train array<boolean>, parts array<boolean>, sizes binary, lead binary, tokens binary, keys binary, words bigint, size bigint"


def _chunked(docs: DataFrame, train: Column, chunk: int) -> DataFrame:
    """Documents as chunks of word numbers; keys: the sorted hashes of a chunk's words, which tokens number.

    lead: how many of a part's first tokens belong to the part before; parts: whether a row is one of several of its text.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        vocabulary, meta, tokens = _Vocabulary(), [], []
        count = row = total = 0
        id_arrow = None

        def add(own: list[bytes]) -> None:
            nonlocal total
            tokens.append(np.fromiter(map(vocabulary.__getitem__, own), np.int32, len(own)))
            total += len(own)

        def close() -> pa.RecordBatch:
            nonlocal vocabulary, meta, tokens, count, total
            keys = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in vocabulary), np.uint64, len(vocabulary))
            order = np.argsort(keys)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            ids, rows, trains, parts, sizes, lead = zip(*meta, strict=True)
            out = [
                pa.array([task << 32 | count], pa.int64()),
                pa.array([list(ids)], pa.list_(id_arrow)),
                pa.array([list(rows)], pa.list_(pa.int64())),
                pa.array([list(trains)], pa.list_(pa.bool_())),
                pa.array([list(parts)], pa.list_(pa.bool_())),
                pa.array([_packed(np.array(sizes, np.int32))], pa.binary()),
                pa.array([_packed(np.array(lead, np.int32))], pa.binary()),
                pa.array([_packed(rank[np.concatenate(tokens)])], pa.binary()),
                pa.array([_steps(keys[order])], pa.binary()),
                pa.array([len(keys)], pa.int64()),
                pa.array([total], pa.int64()),
            ]
            vocabulary, meta, tokens, total = _Vocabulary(), [], [], 0
            count += 1
            return pa.RecordBatch.from_arrays(out, [f.split(" ")[0] for f in _CHUNK.split(", ")])

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for doc_id, text, is_train in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row += 1
                n = lead = 0  # of this text, in the chunk at hand
                tail: list[bytes] = []
                several = False
                for piece in words(text):
                    for at in range(0, len(piece), max(1, chunk - DEEPEST)):
                        own = piece[at : at + max(1, chunk - DEEPEST)]
                        if n + len(own) > chunk and n > lead:  # the text goes on in a part of its own
                            several = True
                            meta.append((doc_id, task << 32 | row, bool(is_train), True, n, lead))
                            yield close()
                            add(tail)
                            n = lead = len(tail)
                        add(own)
                        n += len(own)
                        tail = [*tail, *own][-DEEPEST:]
                meta.append((doc_id, task << 32 | row, bool(is_train), several, n, lead))
                if total >= chunk:
                    yield close()
        if meta:
            yield close()
        trim()

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), train.alias("train")).mapInArrow(run, _CHUNK.format(id=id_type))


_QUESTION = "shard int, chunk bigint, contexts binary, kinds binary, theirs binary, words binary, counts binary"
_ANSWER = "chunk bigint, depth int, shard int, kinds binary, counts binary, key bigint, n bigint, sorts bigint, own double, theirs double"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


class _Texts:
    """What a chunk's row says of its texts; `own`: tokens that count, not those that a part repeats; `learnt`: those of training rows."""

    def __init__(self, row: dict):
        self.sizes, self.lead = _unpacked(row["sizes"], np.int32).astype(np.int64), _unpacked(row["lead"], np.int32).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.train = np.array(row["train"], bool)

    def own(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = np.searchsorted(self.ends, at, "right")
        return text, at - self.begins[text] >= self.lead[text]


def _ask_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's words with their training counts."""
    for batch in batches:
        for row in batch.to_pylist():
            texts, keys, tokens = _Texts(row), _summed(row["keys"]), _unpacked(row["tokens"], np.int32)
            text, own = texts.own(np.arange(len(tokens)))
            n = np.bincount(tokens[own & texts.train[text]], minlength=len(keys))
            cut = np.searchsorted(_shard(keys, shards), np.arange(shards + 1))
            yield _batch([(s, row["chunk"], _steps(keys[a:b]), b"", b"", b"", _packed(n[a:b])) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a], _QUESTION)


def _by_shard(batches: Iterator[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
    """A partition's rows are those of one shard, or come sorted by shard; answer gets those of one."""
    at, waiting = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["shard"] != at and waiting:
                yield _batch(answer(waiting), _ANSWER)
                waiting = []
                trim()
            at = row["shard"]
            waiting.append(row)
    if waiting:
        yield _batch(answer(waiting), _ANSWER)
        del waiting
        trim()


def _count_words(rows: list[dict]) -> list[tuple]:
    """How often a shard's words occur; and, for all of them, tokens, words, words seen once and end symbols."""
    keys, n = [_summed(r["contexts"]) for r in rows], [_unpacked(r["counts"], np.int64) for r in rows]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(n)).astype(np.int64)
    cut = np.cumsum([0] + [len(k) for k in keys])
    out = [(r["chunk"], 0, r["shard"], b"", _packed(total[inverse[a:b]]), None, None, None, None, None) for r, a, b in zip(rows, cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    ends = total[distinct == np.uint64(xxhash.xxh64_intdigest(END, SEED))].sum()
    return [*out, (None, 0, rows[0]["shard"], None, None, None, int(total.sum()), int((total > 0).sum()), float((total == 1).sum()), float(ends))]


class _Pairs:
    """The distinct (context, word) of a chunk's open tokens, in the order in which they are asked."""

    def __init__(self, context: np.ndarray, word: np.ndarray, chance: np.ndarray, learnt: np.ndarray, context_keys: np.ndarray, context_n: np.ndarray, word_keys: np.ndarray, shards: int, hot: int):
        code, self.of = np.unique(context.astype(np.int64) * len(word_keys) + word, return_inverse=True)
        c, w = (code // max(1, len(word_keys))).astype(np.int32), (code % max(1, len(word_keys))).astype(np.int32)
        self.of = self.of.astype(np.int32)
        n = np.bincount(self.of[learnt], minlength=len(code))
        parent = np.zeros(len(code))
        del code
        parent[self.of] = chance
        short = word_keys[w] >> np.uint64(24)
        splits = np.maximum(1, context_n[c] // hot)
        place = np.where(splits > 1, _mixed(context_keys[c] + (short % splits.astype(np.uint64)) * _ODD), context_keys[c])
        shard = _shard(place, shards).astype(np.int32)
        del splits, place
        # contexts by the rank of their keys: one number orders pairs within a shard
        order = np.argsort(context_keys, kind="stable")
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        order = np.argsort(rank[c] << np.uint64(40) | short)  # pairs that are equal here are one for their shard
        order = order[np.argsort(shard[order], kind="stable")]
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.of = back[self.of]
        self.shard, self.context, self.word, self.short, self.n, self.parent = shard[order], c[order], w[order], short[order], n[order], parent[order]
        new = np.append(True, (self.context[1:] != self.context[:-1]) | (self.shard[1:] != self.shard[:-1])) if len(order) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)  # of each run of one context
        self.run = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.context_keys, self.context_n, self.word_keys, self.hot = context_keys, context_n, word_keys, hot

    def questions(self, chunk: int) -> list[tuple]:
        sizes = np.diff(np.append(self.first, len(self.n)))
        theirs = np.bincount(self.run, self.n * np.log(np.maximum(self.parent, 1e-300)), minlength=len(self.first))
        theirs = np.rint(-theirs * GRAIN).astype(np.int64)  # small numbers, as most contexts are rare in a chunk: their planes are mostly zeros
        keys = self.context_keys[self.context[self.first]]
        split = self.context_n[self.context[self.first]] >= 2 * self.hot
        step = np.diff(self.short, prepend=np.uint64(0))
        step[self.first] = self.short[self.first]
        out = []
        starts = np.append(np.flatnonzero(np.diff(self.shard[self.first], prepend=-1)), len(self.first))
        ends = np.append(self.first, len(self.n))
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            a, b = int(ends[i]), int(ends[j])
            # a run's size, and whether its context is split over shards
            kinds = sizes[i:j] * 2 + split[i:j]
            out.append((int(self.shard[a]), chunk, _steps(keys[i:j]), _packed(kinds), _packed(theirs[i:j]), _packed(step[a:b]), _packed(self.n[a:b])))
        return out


def _kept(n: np.ndarray, kinds: np.ndarray, own: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """The divergence test; own: the sum of n ln n over a context's successors, theirs: that of n ln(the suffix's probability)."""
    ratio = 2 * (own - n * np.log(np.maximum(n, 1)) - theirs)
    free = np.maximum(kinds - 1, 1.0)  # the ratio is about chi-squared with a degree of freedom for each further successor
    return ratio > free + DEVIATIONS * np.sqrt(2 * free)


def _count_pairs(rows: list[dict], depth: int, together: int = TOGETHER) -> list[tuple]:
    """How often each word follows its context, and each context's number of successors, 0 where it isn't kept.

    A shard's questions are counted by ranges of context keys with about `together` questions each, as counting takes many times their own memory.
    """
    sizes = [_unpacked(r["kinds"], np.int64) >> 1 for r in rows]
    keys = [_summed(r["contexts"]) for r in rows]
    every = np.concatenate(keys)
    order = np.argsort(every)
    cut = np.cumsum(np.concatenate(sizes)[order])
    # a context's questions stay together: a range begins at a key
    begins = np.unique(every[order][np.searchsorted(cut, np.arange(together, int(cut[-1]), together), "right")])
    del every, order, cut
    # a message's contexts come in the order of their keys, so its answers are those of the ranges one after another
    runs = [np.concatenate([[0], np.searchsorted(k, begins), [len(k)]]) for k in keys]
    kinds: list[list[np.ndarray]] = [[] for _ in rows]
    counts: list[list[np.ndarray]] = [[] for _ in rows]
    sums: list[tuple] = []
    for i in range(len(begins) + 1):
        some = [j for j in range(len(rows)) if runs[j][i + 1] > runs[j][i]]
        if not some:
            continue
        answers, pairs, parted = _count_range([(rows[j], keys[j], int(runs[j][i]), int(runs[j][i + 1])) for j in some])
        for j, a, n in zip(some, answers, pairs, strict=True):
            kinds[j].append(a)
            counts[j].append(n)
        sums += [(None, depth, None, None, None, *x) for x in parted]
    joined = lambda parts: _packed(np.concatenate(parts).astype(np.int64))
    return [(r["chunk"], depth, r["shard"], joined(kinds[j]), joined(counts[j]), None, None, None, None, None) for j, r in enumerate(rows)] + sums


def _small(n: np.ndarray) -> np.ndarray:
    return n.astype(np.int32) if not len(n) or n.max() < 1 << 31 else n


def _count_range(rows: list[tuple[dict, np.ndarray, int, int]]) -> tuple[list[np.ndarray], list[np.ndarray], list[tuple]]:
    """_count_pairs for the contexts begin to end of each (message, its keys, begin, end): by message the contexts' answers and the pairs' counts, and the sums of split contexts."""
    kinds, theirs, steps, ns = [], [], [], []
    for r, _, a, b in rows:
        own = _unpacked(r["kinds"], np.int64)
        c, d = int((own[:a] >> 1).sum()), int((own[:b] >> 1).sum())
        kinds.append(own[a:b])
        theirs.append(_unpacked(r["theirs"], np.int64)[a:b] / -GRAIN)
        steps.append(_unpacked(r["words"], np.uint64)[c:d].copy())
        ns.append(_small(_unpacked(r["counts"], np.int64)[c:d]))
    context_cut = np.cumsum([0, *map(len, kinds)])
    kinds, step, n = np.concatenate(kinds), np.concatenate(steps), np.concatenate(ns)
    del steps, ns
    sizes, split = kinds >> 1, (kinds & 1).astype(bool)
    first = np.cumsum(sizes) - sizes
    total = np.cumsum(step, dtype=np.uint64)
    total -= np.repeat(total[first] - step[first], sizes)
    del step
    contexts, inverse = np.unique(np.concatenate([k[a:b] for _, k, a, b in rows]), return_inverse=True)
    total |= np.repeat(inverse, sizes).astype(np.uint64) << np.uint64(40)
    codes, pair = np.unique(total, return_inverse=True)
    del total
    of = (codes >> np.uint64(40)).astype(np.int64)
    n = np.bincount(pair, n)
    sums = lambda x: np.bincount(of, x, minlength=len(contexts))
    all_n, sorts, own = sums(n), sums(n > 0), sums(n * np.log(np.maximum(n, 1)))
    their = np.bincount(inverse, np.concatenate(theirs), minlength=len(contexts))
    parted = np.zeros(len(contexts), bool)
    parted[inverse] = split
    answer = np.where(_kept(all_n, sorts, own, their) | parted, sorts, 0).astype(np.int64)
    pair_cut = np.cumsum([0, *sizes])[context_cut]
    n = _small(n.astype(np.int64))
    answers = [_small(answer[inverse[a:b]]) for a, b in zip(context_cut[:-1].tolist(), context_cut[1:].tolist(), strict=True)]
    pairs = [n[pair[c:d]] for c, d in zip(pair_cut[:-1].tolist(), pair_cut[1:].tolist(), strict=True)]
    hot = [(int(contexts[i].view(np.int64)), int(all_n[i]), int(sorts[i]), float(own[i]), float(their[i])) for i in np.flatnonzero(parted).tolist()]
    return answers, pairs, hot


_STATE = "chunk bigint, known binary, base binary, done binary, at binary, chance binary, context_n binary, open bigint"
_OF_CHUNK = ("train", "sizes", "lead", "tokens", "keys")  # what reading a state takes from its chunk
_OPEN = {"at": np.int32, "contexts": np.int32, "words": np.int32, "chance": np.float64, "context_keys": np.uint64, "context_n": np.int64, "word_keys": np.uint64}


class _State:
    """A chunk's open tokens: where they are, their context and word by number, and their probability after the suffixes so far."""

    def __init__(self, texts: _Texts, chunk: int, **open_: np.ndarray):
        self.texts, self.chunk = texts, chunk
        self.at, self.contexts, self.words, self.chance, self.context_keys, self.context_n, self.word_keys = (open_[k] for k in _OPEN)
        self.text, self.own = texts.own(self.at)

    def pairs(self, shards: int, hot: int) -> _Pairs:
        learnt = self.own & self.texts.train[self.text]
        return _Pairs(self.contexts, self.words, self.chance, learnt, self.context_keys, self.context_n, self.word_keys, shards, hot)

    def less(self, stay: np.ndarray) -> tuple[_State, np.ndarray]:
        """The tokens that stay, and for each text the sum of log10 of the other tokens' probabilities."""
        out = self.own & ~stay
        done = np.bincount(self.text[out], np.log10(np.maximum(self.chance[out], 1e-300)), minlength=len(self.texts.sizes))
        used = np.zeros(len(self.context_keys), bool)
        used[self.contexts[stay]] = True
        number = np.cumsum(used, dtype=np.int32) - np.int32(1)
        kept = _State(
            self.texts, self.chunk, at=self.at[stay], contexts=number[self.contexts[stay]], words=self.words[stay], chance=self.chance[stay],
            context_keys=self.context_keys[used], context_n=self.context_n[used], word_keys=self.word_keys,
        )
        return kept, done

    def longer(self, answers: list[dict], shards: int, hot: int, sums: tuple[np.ndarray, np.ndarray]) -> tuple[_State, np.ndarray]:
        """The state one word deeper, by the answers to pairs().questions(); and less()'s sums."""
        if not len(self.at):
            return self.less(np.zeros(0, bool))
        p = self.pairs(shards, hot)
        answers = sorted(answers, key=lambda r: r["shard"])
        kinds, n = (np.concatenate([_unpacked(r[c], np.int64) for r in answers]) for c in ("kinds", "counts"))
        split = np.flatnonzero(p.context_n[p.context[p.first]] >= 2 * hot)
        kinds[split] = sums[1][np.searchsorted(sums[0], p.context_keys[p.context[p.first[split]]])]
        k = kinds[p.run]
        chance = np.where(k > 0, (n + k * p.parent) / np.maximum(p.context_n[p.context] + k, 1), p.parent)
        before = np.searchsorted(self.at, self.at - 1)
        there = (self.at[before] == self.at - 1) & (self.at != self.texts.begins[self.text])
        stay = there & (k[p.of] > 0) & (n[p.of[before]] >= LEAST)
        keys = _mixed(p.context_keys[p.context] * _ODD + p.word_keys[p.word])
        return _State(self.texts, self.chunk, at=self.at, contexts=p.of[before], words=self.words, chance=chance[p.of], context_keys=keys, context_n=n, word_keys=self.word_keys).less(stay)


def _codes(contexts: np.ndarray, words_: np.ndarray, n_words: int) -> np.ndarray:
    return contexts.astype(np.int64) * n_words + words_


def _context_keys(texts: _Texts, tokens: np.ndarray, keys: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The keys of the contexts of so many words before the tokens at these places, as longer() makes them."""
    first = at - length
    before = first < texts.begins[texts.own(at)[0]]
    made = np.where(before, _START, keys[tokens[np.maximum(first, 0)]])
    for i in range(1, length):
        made = _mixed(made * _ODD + keys[tokens[first + i]])
    return made


def _stored(state: _State, deduced: bool = False) -> dict[str, bytes]:
    """The columns of a state: places by their differences, and probabilities, to 36 bits, once for each (context, word), which they depend on.

    deduced: without what the chunk's tokens tell, with contexts in the order of their keys.
    """
    open_ = {c: np.asarray(getattr(state, c), t) for c, t in _OPEN.items()}
    if deduced:
        keys, number = np.unique(open_["context_keys"], return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        n[number] = open_["context_n"]
        open_["contexts"], open_["context_n"] = number.astype(np.int32)[open_["contexts"]], n
    codes = _codes(open_["contexts"], open_["words"], len(open_["word_keys"]))
    order = np.argsort(codes)
    first = order[np.diff(codes[order], prepend=-1) != 0]
    open_["at"] = np.diff(open_["at"], prepend=np.int32(0))
    open_["chance"] = ((open_["chance"][first].view(np.uint64) + np.uint64(1 << 15)) >> np.uint64(16) << np.uint64(16)).view(np.float64)
    return {c: _packed(x) for c, x in open_.items() if not deduced or c in ("at", "chance", "context_n")}


def _read(row: dict, length: int | None = None) -> _State:
    """The state of stored columns; length: that of its contexts, where the row has the chunk's columns instead of what is deduced from them."""
    open_ = {k: _unpacked(row[k], t) for k, t in _OPEN.items() if k in row}
    open_["at"] = at = np.cumsum(open_["at"], dtype=np.int32)
    texts = _Texts(row)
    if length is not None:
        tokens, keys = _unpacked(row["tokens"], np.int32), _summed(row["keys"])
        context_keys, contexts = np.unique(_context_keys(texts, tokens, keys, at, length), return_inverse=True)
        open_ |= {"contexts": contexts.astype(np.int32), "words": tokens[at], "context_keys": context_keys, "word_keys": keys}
    open_["chance"] = open_["chance"][np.unique(_codes(open_["contexts"], open_["words"], len(open_["word_keys"])), return_inverse=True)[1]]
    return _State(texts, row["chunk"], **open_)


def _opened(row: dict, answers: list[dict], total: int, once: float, begins: int) -> tuple[_State, np.ndarray, np.ndarray, np.ndarray]:
    """The state after the empty context; and for each text its known tokens, the sum of log10(c + 1), and less()'s sums."""
    texts, keys, tokens = _Texts(row), _summed(row["keys"]), _unpacked(row["tokens"], np.int32)
    answers = sorted(answers, key=lambda r: r["shard"])
    c = np.concatenate([_unpacked(r["counts"], np.int64) for r in answers])
    text, own = texts.own(np.arange(len(tokens)))
    sums = lambda per: np.bincount(text[own], per[tokens[own]], minlength=len(texts.sizes))
    unseen = (once + 0.5) / (total + 1)
    chance = np.where(c > 0, (1 - unseen) * c / max(1, total), unseen)
    contexts = np.append(np.int32(len(keys)), tokens[:-1])
    contexts[texts.begins] = len(keys)
    every = _State(
        texts, row["chunk"], at=np.arange(len(tokens), dtype=np.int32), contexts=contexts, words=tokens, chance=chance[tokens],
        context_keys=np.append(keys, _START), context_n=np.append(c, begins), word_keys=keys,
    )
    state, done = every.less(every.context_n[contexts] >= LEAST)
    return state, sums(c > 0), sums(np.log10(c + 1.0)), done


def _row(state: _State, known: np.ndarray, base: np.ndarray, done: np.ndarray) -> pa.Table:
    """A chunk's row of the next state."""
    own = {c: _packed(np.asarray(x, np.float64)) for c, x in (("known", known), ("base", base), ("done", done))}
    columns = {c: pa.array([x], pa.binary()) for c, x in {**own, **_stored(state, deduced=True)}.items()}
    return pa.table({"chunk": pa.array([state.chunk], pa.int64()), **columns, "open": pa.array([len(state.at)], pa.int64())})


def _with_chunk(state: DataFrame, chunks: DataFrame, *more: str) -> DataFrame:
    """A state beside its chunks' columns; both are bucketed alike, so that no row moves."""
    return chunks.select("chunk", *more, *_OF_CHUNK).join(state.hint("merge"), "chunk")


def _answered(questions: DataFrame, shards: int, answer) -> DataFrame:
    dealt = questions.repartitionById(shards, "shard")  # one shard a partition: hashing would put several into one
    return written(dealt.mapInArrow(partial(_by_shard, answer=answer), _ANSWER), "answers")


def _hot_sums(answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the split contexts (at most 2**20) and their numbers of successors, 0 where they aren't kept."""
    rows = answers.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("n").alias("n"), F.sum("sorts").alias("sorts"), F.sum("own").alias("own"), F.sum("theirs").alias("theirs")).toArrow()
    keys, n, sorts, own, theirs = (rows[c].to_numpy() for c in ("key", "n", "sorts", "own", "theirs"))
    keys = np.ascontiguousarray(keys, np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.where(_kept(n, sorts, own, theirs), sorts, 0)[order].astype(np.int64)


def score(docs: DataFrame, train: Column, chunk: int = CHUNK, per_shard: int = PER_SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score for docs (doc_id, text); train: the rows to learn from."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # a bucket is read and grouped at once, so it gets some IN_BUCKET chunks however large the partitions are
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(1, min(max(docs.rdd.getNumPartitions(), n_bytes // (chunk * BYTES_A_TOKEN * IN_BUCKET)), 50_000))
    chunks = bucketed(_chunked(docs, train, chunk), "chunks", "chunk", buckets)
    n_words, size = (int(x or 0) for x in chunks.agg(F.sum("words"), F.sum("size")).first())
    shards = max(1, -(-n_words // per_shard))
    counted = _answered(chunks.mapInArrow(partial(_ask_words, shards=shards), _QUESTION), shards, _count_words)
    sums = counted.where(F.col("chunk").isNull()).agg(F.sum("n"), F.sum("sorts"), F.sum("own"), F.sum("theirs")).first()
    total, distinct, once, begins = (int(x or 0) for x in sums)  # every text that ends begins
    hot = max(hot, total >> 20)

    shards = max(1, -(-size // per_shard))

    def ask_first(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        row = left.to_pylist()[0]
        state = _opened(row, right.to_pylist(), total, once, begins)[0]
        return pa.Table.from_batches([_batch(state.pairs(shards, hot).questions(row["chunk"]) if len(state.at) else [], _QUESTION)])

    of_chunk = lambda answers: answers.where(F.col("chunk").isNotNull()).select("chunk", "depth", "shard", "kinds", "counts").groupBy("chunk")
    first = _answered(chunks.groupBy("chunk").cogroup(of_chunk(counted)).applyInArrow(ask_first, _QUESTION), shards, partial(_count_pairs, depth=1))
    shared = spark.sparkContext.broadcast(_hot_sums(first))  # at most 2**20 pairs of numbers

    def open_first(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        row, answers = left.to_pylist()[0], right.to_pylist()
        state, known, base, done = _opened(row, [a for a in answers if not a["depth"]], total, once, begins)
        state, more = state.longer([a for a in answers if a["depth"]], shards, hot, shared.value)
        return _row(state, known, base, done + more)

    both = of_chunk(counted.unionByName(first))
    state = bucketed(chunks.groupBy("chunk").cogroup(both).applyInArrow(open_first, _STATE), "tokens", "chunk", buckets)
    for table in (counted, first):
        release(table)
    for depth in range(2, DEEPEST + 1):
        size = int(state.agg(F.sum("open")).first()[0] or 0)
        if not size:
            break
        state = _deeper(state, chunks, depth, max(1, -(-size // per_shard)), hot, buckets, of_chunk)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                at = row.to_pylist()[0]
                state = _read(at, DEEPEST + 1)  # only the last depth leaves open tokens
                done = _unpacked(at["done"], np.float64) + state.less(np.zeros(len(state.at), bool))[1]
                t, known, base = state.texts, _unpacked(at["known"], np.float64), _unpacked(at["base"], np.float64)
                flat = [row[c].flatten() for c in ("ids", "rows", "train", "parts")]
                yield pa.RecordBatch.from_arrays(
                    [*flat, pa.array(t.sizes - t.lead), pa.array(known.astype(np.int64)), pa.array(base), pa.array(done)], ["doc_id", "row", "train", "part", "n_tokens", "n_known", "base", "score"]
                )

    scored = _with_chunk(state, chunks, "ids", "rows", "parts").mapInArrow(finish, f"doc_id {id_type}, row bigint, train boolean, part boolean, n_tokens bigint, n_known bigint, base double, score double")
    numbers = ["n_tokens", "n_known", "base", "score"]
    cut = scored.where("part").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("train").alias("train"), *(F.sum(c).alias(c) for c in numbers))
    whole = scored.where(~F.col("part")).select("doc_id", "train", *numbers).unionByName(cut.select("doc_id", "train", *numbers))
    base = F.col("base") - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    return whole.select("doc_id", "train", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def _deeper(state: DataFrame, chunks: DataFrame, depth: int, shards: int, hot: int, buckets: int, of_chunk) -> DataFrame:
    """The state one word deeper; the state before, whose contexts have depth words, is released."""
    both = _with_chunk(state, chunks)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["open"]:
                    yield _batch(_read(row, depth).pairs(shards, hot).questions(row["chunk"]), _QUESTION)
                    trim()

    answers = _answered(both.mapInArrow(ask, _QUESTION), shards, partial(_count_pairs, depth=depth))
    shared = state.sparkSession.sparkContext.broadcast(_hot_sums(answers))  # at most 2**20 pairs of numbers

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        row = left.to_pylist()[0]
        after, more = _read(row, depth).longer(right.to_pylist(), shards, hot, shared.value)
        known, base, done = (_unpacked(row[c], np.float64) for c in ("known", "base", "done"))
        return _row(after, known, base, done + more)

    out = bucketed(both.groupBy("chunk").cogroup(of_chunk(answers)).applyInArrow(step, _STATE), "tokens", "chunk", buckets)
    release(state)
    release(answers)
    return out
