"""Best-fit packing of token sequences by a configuration linear program.

Documents become token ids with a closing id, and longer ones than a sequence are cut into
whole sequences and a rest. Only the histogram of piece lengths, at most `size` numbers,
reaches the driver. There a configuration is a multiset of lengths that fits a sequence; the
program asks for the fewest configurations that cover all pieces. Multiplicative weights
solve it: every length has a price that falls as it gets covered, and the configurations worth
most, one with each length, are found by knapsack dynamic programming over the capacity. Rounds go on until the
cover is within GAP of the bound that the prices prove, or for as many rounds as there are lengths. The configurations found are
rounded: they are used, best filled first, as often as the program says and the pieces that are left allow, and what
then remains is packed best-fit decreasing, in the histogram again. The last of them are given up where that takes fewer sequences.

The plan is a table of runs: pieces of length l with ranks r .. r + n - 1 go to sequences
s .. s + n - 1 at a fixed offset. Its rows are bounded by the number of lengths whatever the input's size. A
piece's rank among those of its length is its rank among those of its length and salt plus the count
of smaller salts, so no length gathers in one task.

Cases: null and empty texts are one piece of the closing id; equal texts and repeated rows are
packed as often as they come; ids may be null; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written

SIZE = 2048
ROUNDS = 120  # of the weights method at most, or as many as there are lengths
EPSILON = 0.25
GAP = 0.1  # the program's cover has so many more sequences than the least at most
WORTHLESS = 8.0  # a length that far ahead of the last, in EPSILON, has no price
DAMPED = 12
CONFIGURATIONS = 8  # for each length, in a plan
KEPT = (1, 0.95, 0.9, 0.75, 0.5, 0.25, 0)  # shares of the rounded configurations to choose from
SALTS = 64
CACHED = 400_000  # parts whose ids one worker keeps


#: Letters and digits among the characters up to U+00FF, in lower case; other texts are left to the tokenizer as a whole.
_L, _N = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
_BEYOND = re.compile("[\x1c-\x1f\u0100-\U0010ffff]")


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next free one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class WordTokens(dict):
    """Ids of the parts (words, digits, runs of signs) that the tokenizer cuts a text into, as bytes, asked from its model once each."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = _byte_characters()

    def __missing__(self, part: str) -> bytes:
        name = part if part.isascii() and part.isprintable() else "".join(self.characters[b] for b in part.encode())
        ids = np.array([t.id for t in self.model.tokenize(name)], "<u4").tobytes()
        if len(part) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """All ids of a text, four bytes each, little-endian."""
        if "<|" in text or _BEYOND.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _PARTS.findall(text.lower())))


_worker: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _worker:
        _worker[path] = WordTokens(path)
    return _worker[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for docs (doc_id, text); tokenizer: the path of its file on every machine."""
    closing = np.array([end], "<u4").tobytes()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    id_type = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        for batch in batches:
            row, part, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                data = tokens.ids(t.as_py() or "") + closing
                for p, at in enumerate(range(0, len(data), 4 * size)):
                    piece = data[at : at + 4 * size]
                    row.append(i)
                    part.append(p)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(part, pa.int32()), *(pa.array(x, id_type) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _knapsack(price: np.ndarray, lengths: np.ndarray, need: np.ndarray, size: int) -> np.ndarray:
    """For each length, how often (columns) a configuration with that length that is worth most has each length; none oftener than it is needed."""
    m = len(lengths)
    worth, used, column = np.zeros(size + 1), np.zeros((size + 1, m), np.int16), np.arange(m)
    for c in range(1, size + 1):
        worth[c], used[c] = worth[c - 1], used[c - 1]
        n = int(np.searchsorted(lengths, c, "right"))
        if n:
            before = c - lengths[:n]
            got = np.where(used[before, column[:n]] < need[:n], worth[before] + price[:n], -1.0)
            k = int(got.argmax())
            if got[k] > worth[c]:
                worth[c], used[c] = got[k], used[before[k]]
                used[c, k] += 1
    rows = used[size - lengths]
    rows[column, column] += rows[column, column] < need
    return rows


def _bound(price: np.ndarray, lengths: np.ndarray, need: np.ndarray, size: int) -> float:
    """Sequences that any cover needs at these prices: what all is worth by what the best configuration is worth."""
    worth = np.zeros(size + 1)
    for c in range(1, size + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        worth[c] = max(worth[c - 1], (worth[c - lengths[:n]] + price[:n]).max()) if n else worth[c - 1]
    return float(need @ price) / worth[size]


def program(lengths: np.ndarray, need: np.ndarray, size: int, rounds: int) -> tuple[list[tuple], float]:
    """A fractional cover of need by configurations, and its sequences by the least that any cover has.

    The cover comes as (columns, counts, ends of rows, times) for each round. A price falls with the share of its length that is covered. A round
    takes the best configuration with each length, and damps those that ask for a length together too often. It
    goes on until the gap is at most GAP, for `rounds` or as many rounds as there are lengths.
    """
    m = len(lengths)
    cover, total, least, gap = np.zeros(m), 0.0, float(need @ lengths) / size, np.inf
    found = []
    for t in range(1, max(rounds, m) + 1):
        behind = (cover / need - (cover / need).min()) / EPSILON
        price = np.where(behind > WORTHLESS, 0.0, lengths * np.exp(-behind))
        rows = _knapsack(price, lengths, need, size)
        value = rows @ price
        rows = rows[value >= 0.9 * value.max()]
        row, column = np.nonzero(rows)
        count = rows[row, column]
        begin = np.searchsorted(row, np.arange(len(rows)))
        step = np.minimum.reduceat(need[column] / count, begin)
        for _ in range(DAMPED):
            over = np.maximum(np.bincount(column, step[row] * count, m) / need / EPSILON, 1)
            step /= np.sqrt(np.maximum.reduceat(over[column], begin))
        got = np.bincount(column, step[row] * count, m)
        shrink = min(1.0, EPSILON / (got / need).max())
        cover += shrink * got
        total += shrink * step.sum()
        found.append((column.astype(np.int16), count, np.append(begin[1:], len(row)), shrink * step))
        if t % 10 == 0 or t == max(rounds, m):
            least = max(least, _bound(price, lengths, need, size))
            share = (cover / need).min()
            gap = total / share / least if share > 0 else np.inf
            if gap <= 1 + GAP:
                break
    share = max((cover / need).min(), 1e-12)
    return [(*f[:3], f[3] / share) for f in found], gap


def rounded(left: dict[int, int], size: int, rounds: int) -> list[tuple[Counter, int]]:
    """The program's configurations in whole sequences, fullest first; takes their pieces from left.

    At most CONFIGURATIONS a length are used: where the program has more, each stands for as many as there are to one of these.
    """
    lengths = np.array(sorted(left), np.int64)
    found, _ = program(lengths, np.array([left[k] for k in lengths.tolist()], float), size, rounds)
    rest = np.array([left[k] for k in lengths.tolist()], np.int64)
    full = [np.add.reduceat(lengths[c] * n, np.append(0, e[:-1])) for c, n, e, _ in found]
    number, at = (np.concatenate(x) for x in zip(*((np.full(len(f), i), np.arange(len(f))) for i, f in enumerate(full)), strict=True))
    times = np.concatenate([f[3] for f in found])
    most = CONFIGURATIONS * len(lengths)
    times = np.ceil(times * max(1.0, len(times) / most)).astype(np.int64)
    out: list[tuple[Counter, int]] = []
    for k in np.lexsort((-times, -np.concatenate(full))).tolist():
        column, count, ends, _ = found[number[k]]
        i = int(at[k])
        own = slice(int(ends[i - 1]) if i else 0, int(ends[i]))
        c, n = column[own], count[own].astype(np.int64)
        uses = min(int((rest[c] // n).min()), int(times[k]))
        if uses > 0:
            rest[c] -= uses * n
            out.append((Counter(dict(zip(lengths[c].tolist(), n.tolist(), strict=True))), uses))
            if len(out) == most:
                break
    left.update(zip(lengths.tolist(), rest.tolist(), strict=True))
    return out


def _best_fit(left: dict[int, int], size: int) -> list[tuple[Counter, int]]:
    """Configurations and their numbers by best-fit decreasing: many equal sequences are filled at once."""
    rooms: dict[int, list[list]] = {}  # by room left: [configuration, number]
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = next((r for r in range(length, size + 1) if rooms.get(r)), None)
            if room is None:  # open new sequences, each with as many as fit
                each = min(size // length, n)
                count = max(1, n // each)
                rooms.setdefault(size - each * length, []).append([Counter({length: each}), count])
                n -= each * count
                continue
            config, count = rooms[room].pop()
            each = min(room // length, n)
            used = min(count, max(1, n // each))
            if count > used:
                rooms[room].append([config, count - used])
            rooms.setdefault(room - each * length, []).append([config + Counter({length: each}), used])
            n -= each * used
    return [(c, k) for r in rooms.values() for c, k in r]


def solve(histogram: dict[int, int], size: int = SIZE, rounds: int = ROUNDS) -> list[tuple[Counter, int]]:
    """Configurations and how many sequences have each; all pieces of the histogram are in exactly one."""
    left = {k: n for k, n in histogram.items() if n}
    out: list[tuple[Counter, int]] = []
    if left.get(size):
        out.append((Counter({size: 1}), left.pop(size)))
    if not left:
        return out
    placed = rounded(left, size, rounds)
    plans = []
    for kept in KEPT:  # few pieces leave rounding little choice: the last configurations may strand pieces that best fit places
        n = round(len(placed) * kept)
        rest = Counter(left)
        for config, times in placed[n:]:
            rest.update({k: c * times for k, c in config.items()})
        plans.append(placed[:n] + _best_fit({k: n for k, n in rest.items() if n}, size))
    return out + min(plans, key=lambda plan: sum(times for _, times in plan))


def runs(plan: list[tuple[Counter, int]]) -> np.ndarray:
    """Columns length, first rank, first sequence, offset, sequences: pieces fill one place of all of a configuration's sequences, then the next."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for config, times in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            rows.append((length, used[length], sequence, offset, times))
            used[length] += config[length] * times
            offset += length * config[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = 0) -> DataFrame:
    """pieces() of docs with sequence_id and offset; docs: doc_id, text."""
    spark = docs.sparkSession
    made = written(pieces(docs, tokenizer, size, end), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    salted = made.withColumn("salt", salt)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))  # at most size * SALTS rows
    table = counts.toArrow().to_pydict()
    histogram: Counter = Counter()
    for length, n in zip(table["length"], table["n"], strict=True):
        histogram[length] += n
    before, seen = {}, Counter()
    for length, s, n in sorted(zip(table["length"], table["salt"], table["n"], strict=True)):
        before[length * SALTS + s] = seen[length]
        seen[length] += n
    keys = np.array(sorted(before), np.int64)
    base = np.array([before[k] for k in keys.tolist()], np.int64)
    plan = runs(solve(dict(histogram), size))
    shared = spark.sparkContext.broadcast((keys, base, plan))  # at most size * SALTS pairs and the plan
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, plan = shared.value
        first = (plan[:, 0] << 40) + plan[:, 1] if len(plan) else np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch["length"].to_numpy()
            at = base[np.searchsorted(keys, length * SALTS + batch["salt"].to_numpy())] + batch["rank"].to_numpy() - 1
            run = np.searchsorted(first, (length << 40) + at, "right") - 1
            _, start, sequence, offset, times = plan[run].T
            step, which = np.divmod(at - start, times)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(sequence + which), pa.array(offset + step * length)], [*names, "sequence_id", "offset"])

    schema = f"doc_id {made.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return salted.withColumn("rank", rank).mapInArrow(place, schema)
