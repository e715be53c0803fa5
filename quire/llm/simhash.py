"""SimHash near duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64
hashes of the text's word shingles. Two fingerprints are linked if they differ in at most
RADIUS bits; classes are the connected components of links.

Candidates come from a covering family: every bit position gets a non-zero vector of
RADIUS + 1 bits, and each of the 2**(RADIUS + 1) - 1 non-zero vectors v makes one table,
whose key keeps the positions with an odd inner product with v. The positions in
which a pair within the radius differs span at most RADIUS dimensions, so some v is
orthogonal to all of them, and the pair collides in v's table with certainty.

Texts with equal fingerprints are one node from the start. A bucket is searched in place and
emits a spanning forest of its links instead of all pairs: a breadth-first search compares
each reached fingerprint with those not reached yet. A bucket beyond BLOCK fingerprints is
cut into blocks and every pair of blocks searched on its own, which loses no link and
bounds each search. Components are then found over the forest edges by repeated hooking
to the smallest neighbour, with each round written to the shared folder, until every node is joined
to the smallest of its component.

Cases: null and wordless texts have fingerprint zero and are linked like any other; a text
shorter than a shingle has one shingle of all its words; a null id is its own document and
never a class's smallest id unless it is alone; repeated rows stay as many rows; extra columns are left out.

one_of_each, the pipeline's stage, takes the classes of fingerprints as candidates and compares their texts exactly. At shingle
similarity 0.8 fingerprints differ in ten bits and more, which no covering family of bearable size reaches, so
MinHash keys add the candidates that fingerprints miss.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import minhash
from quire.llm.common import written

RADIUS, BITS, SEED = 4, 64, 42
BLOCK = 4096
BLOCK_BYTES, BLOCK_TEXTS = 4 << 20, 1024  # of the texts that one_of_each compares at a time
CELL = 512  # keys that fall into a cell on average when large buckets are looked for
FINGERPRINTS = 1 << 15  # hashes that are counted at a time
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with one row of each class of near copies, the one with the smallest doc_id and then text; all columns as they are.

    Classes are the components of links of shingle similarity minhash.LEAST or more, whatever the ids: rows of one id may be in
    several classes, and a row without an id stays only if its class has no other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a text's class depends on the text alone, which its digest stands for
    digest = [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]
    marks = docs.select("doc_id", *digest, F.octet_length(text).alias("bytes"), sketches(words)(F.col("text")).alias("s"))
    marks = written(marks.select("doc_id", "t1", "t2", "bytes", "s.node", "s.keys", "s.print"), "sketches")
    nodes = written(marks.select("node", "keys").dropDuplicates(["node"]), "nodes")
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where(F.col("head") < F.col("last")).select("key", "head")
    sketched = keyed.join(heads, "key").select(F.col("head").alias("a"), F.col("node").alias("b"))
    candidates = written(_rooted(components(_by_print(marks).unionByName(sketched))), "candidates")
    # one text of each node goes to its candidates; those of many are cut into blocks, and every pair of blocks is searched
    chosen = marks.join(candidates, "node").groupBy("node", "root").agg(F.min(F.struct("t1", "t2", "bytes")).alias("t"))
    chosen = written(chosen.select("node", "root", "t.*"), "chosen")
    sizes = chosen.groupBy("root").agg(F.greatest(F.ceil(F.sum("bytes") / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int").alias("blocks"))
    block, blocks = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.col("blocks")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda j: (j != block) | (blocks == 1))
    parts = F.transform(others, lambda j: F.least(block, j) * blocks + F.greatest(block, j))
    dealt = chosen.join(sizes, "root").select("t1", "t2", "node", "root", parts.alias("parts"))
    texts = docs.select(text.alias("text"), *digest).join(dealt, ["t1", "t2"]).dropDuplicates(["node"])
    dealt = texts.select("root", F.explode("parts").alias("part"), "node", "text")
    found = dealt.repartition("root", "part").sortWithinPartitions("root", "part").mapInArrow(partial(_search_texts, words=words), "a bigint, b bigint")
    linked = _rooted(components(found)).withColumnRenamed("root", "class")
    classed = marks.join(linked, "node", "left").select("doc_id", "t1", "t2", F.coalesce("class", "node").alias("class"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t1", "t2")
    kept = classed.groupBy("class").agg(F.min(order).alias("k")).select("k.doc_id", "k.t1", "k.t2")
    kept = written(kept, "kept")
    inner = docs.withColumns({"__t1": digest[0], "__t2": digest[1]})
    same = inner["doc_id"].eqNullSafe(kept["doc_id"]) & (inner["__t1"] == kept["t1"]) & (inner["__t2"] == kept["t2"])
    out = inner.join(kept, same, "left_semi")
    rows = marks.alias("m").join(kept.alias("k"), F.expr("m.doc_id <=> k.doc_id and m.t1 = k.t1 and m.t2 = k.t2")).groupBy("m.doc_id", "m.t1", "m.t2").count()
    if not rows.where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "__t1", "__t2"])
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def _by_print(marks: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the nodes of each class of fingerprints: those of one fingerprint, and one of each two that are linked."""
    nodes = written(marks.select("print", "node").distinct(), "prints")
    heads = written(nodes.groupBy("print").agg(F.min("node").alias("a"), F.max("node").alias("last")), "print-heads")
    same = nodes.join(heads.where(F.col("a") < F.col("last")).select("print", "a"), "print").select("a", F.col("node").alias("b"))
    end = lambda print_, head: heads.select(F.col("print").alias(print_), F.col("a").alias(head))
    linked = links(heads.select("print")).select(F.col("a").alias("p"), F.col("b").alias("q"))
    return same.unionByName(linked.join(end("p", "a"), "p").join(end("q", "b"), "q").select("a", "b"))


def sketches(words: int):
    """A column function from text to its node, sketch keys (minhash) and fingerprint."""

    @F.arrow_udf("struct<node: bigint, keys: array<bigint>, print: bigint>")
    def run(texts: pa.Array) -> pa.Array:
        own = [minhash.shingles(t.as_py(), words) for t in texts]
        keys = [minhash.keys(s).view(np.int64) for s in own]
        nodes = np.array([minhash.node(s) for s in own], np.uint64).view(np.int64)
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        prints = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(nodes), lists, pa.array(prints)], ["node", "keys", "print"])

    return lambda text: run(text.cast("string"))


def _search_texts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Forest edges among the texts of each root and part, which come sorted by them."""
    at, nodes, sets = None, [], []

    def edges() -> Iterator[pa.RecordBatch]:
        found = minhash.search(sets)
        if found:
            a, b = (pa.array([nodes[x] for x in side], pa.int64()) for side in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    for batch in batches:
        for root, part, node, text in zip(*(batch[c].to_pylist() for c in ("root", "part", "node", "text")), strict=True):
            if at != (root, part):
                yield from edges()
                at, nodes, sets = (root, part), [], []
            nodes.append(node)
            sets.append(minhash.shingles(text, words))
    yield from edges()


def _rooted(tree: DataFrame) -> DataFrame:
    """components() with a row for the roots as well."""
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a text's word shingles, A-Z lower-cased, words between ASCII white space."""
    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return 0
    data = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(data, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    view, digest = memoryview(data), xxhash.xxh64_intdigest
    n = len(w) - words + 1
    ones = np.zeros(BITS, np.int64)
    from_, to = starts[:n].tolist(), ends[words - 1 :].tolist()
    for at in range(0, n, FINGERPRINTS):
        h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(from_[at : at + FINGERPRINTS], to[at : at + FINGERPRINTS], strict=True)), np.uint64, min(FINGERPRINTS, n - at))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(words: int):
    """A column function from text to fingerprint (bigint, the same 64 bits)."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64))

    return lambda text: run(text.cast("string"))


def masks(radius: int = RADIUS) -> list[int]:
    """The covering family's masks: position i has the vector 1 + i mod (2**(radius + 1) - 1), so each vector is used about equally."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if (v & (1 + i % n)).bit_count() % 2) for v in range(1, n + 1)]


def forest(prints: np.ndarray, other: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (index pairs) of a spanning forest of the links among prints.

    With other: of the links between prints and other only, whose indices follow those of prints.
    """
    edges: list[tuple[int, int]] = []
    if other is None:
        rest = np.arange(len(prints))
        while len(rest):
            reached, rest = [int(rest[0])], rest[1:]
            while reached and len(rest):
                i = reached.pop()
                near = np.bitwise_count(prints[rest] ^ prints[i]) <= radius
                found = rest[near].tolist()
                edges.extend((i, j) for j in found)
                reached.extend(found)
                rest = rest[~near]
        return edges
    left, right = np.arange(len(prints)), np.arange(len(other))
    while len(left) and len(right):
        queue, left = [(0, int(left[0]))], left[1:]
        while queue:
            side, i = queue.pop()
            pool, values, own = (right, other, prints) if side == 0 else (left, prints, other)
            near = np.bitwise_count(values[pool] ^ own[i]) <= radius
            for j in pool[near].tolist():
                edges.append((i, len(prints) + j) if side == 0 else (j, len(prints) + i))
                queue.append((1 - side, j))
            if side == 0:
                right = pool[~near]
            else:
                left = pool[~near]
    return edges


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Forest edges of the buckets of one partition, whose rows come sorted by bucket; the last bucket of a batch waits for the next."""
    kept: pa.Table | None = None

    def edges(t: pa.Table) -> Iterator[pa.RecordBatch]:
        table, key, part, side = (t[c].to_numpy() for c in ("mask_no", "bucket", "part", "side"))
        prints = np.frombuffer(np.ascontiguousarray(t["print"].to_numpy()), np.uint64)
        if not len(prints):
            return
        new = np.append(0, np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1)
        ends = np.append(new[1:], len(prints))
        a, b = [], []
        for i, j in zip(new[ends - new > 1].tolist(), ends[ends - new > 1].tolist(), strict=True):
            p, s = prints[i:j], side[i:j]
            if s.any() and not s.all():
                order = np.argsort(s, kind="stable")
                p, cut = p[order], int((s == 0).sum())
                found = forest(p[:cut], p[cut:], radius)
            elif s.any():
                continue
            else:
                found = forest(p, None, radius)
            a.extend(p[x] for x, _ in found)
            b.extend(p[y] for _, y in found)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([kept, t]) if kept is not None else t
        last = [t[c][-1].as_py() for c in ("mask_no", "bucket", "part")]
        same = np.ones(t.num_rows, bool)
        for c, v in zip(("mask_no", "bucket", "part"), last, strict=True):
            same &= t[c].to_numpy() == v
        cut = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
        yield from edges(t.slice(0, cut))
        kept = t.slice(cut).combine_chunks()
    if kept is not None:
        yield from edges(kept)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Forest edges (a, b) among the distinct values of column `print` (bigint) that differ in at most radius bits."""
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks(radius)]
    family = F.array(*[F.struct(F.lit(i).alias("mask_no"), F.lit(m).cast("bigint").alias("mask")) for i, m in enumerate(signed)])
    keyed = prints.select("print", F.explode(family).alias("m")).select(
        F.col("m.mask_no").alias("mask_no"), F.col("print").bitwiseAND(F.col("m.mask")).alias("bucket"), "print"
    )
    # a bucket can only be large if its cell is: cells are few, so they are counted almost without moving rows
    cells = max(1 << 12, prints.count() * len(signed) // CELL)
    cell = F.pmod(F.xxhash64("mask_no", "bucket"), F.lit(cells)).alias("cell")
    heavy = written(keyed.groupBy(cell).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("cell"), "heavy-cells")
    inside = keyed.select("mask_no", "bucket", cell).join(heavy, "cell", "left_semi")
    sized = inside.groupBy("mask_no", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = written(sized if not heavy.isEmpty() else sized.limit(0), "large-buckets")
    none = F.lit(0)
    if large.isEmpty():
        dealt = keyed.select("mask_no", "bucket", none.alias("part"), none.alias("side"), "print")
    else:
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        block = F.pmod(F.xxhash64("print"), blocks).cast("int")
        every = F.sequence(none, blocks - 1)
        # block i meets block j once, in part lower * blocks + upper; side tells them apart
        parts = F.transform(every, lambda j: F.struct((F.least(block, j) * blocks + F.greatest(block, j)).alias("part"), (block > j).cast("int").alias("side")))
        joined = keyed.join(large, ["mask_no", "bucket"], "left")
        one = F.array(F.struct(none.alias("part"), none.alias("side")))
        dealt = joined.select("mask_no", "bucket", F.explode(F.when(F.col("n").isNull(), one).otherwise(parts)).alias("p"), "print").select(
            "mask_no", "bucket", "p.part", "p.side", "print"
        )
    by = ["mask_no", "bucket", "part"]
    found = dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(partial(_search, radius=radius), "a bigint, b bigint")
    return found.distinct()


def _stars(edges: DataFrame) -> bool:
    """Do distinct edges (a, b) with a < b join every node to the smallest of its component: is no b below two nodes or above another?"""
    low, high = (edges.select(F.col(c).alias("node"), F.lit(int(c == "b")).alias("below"), F.lit(c == "a").alias("above")) for c in "ba")
    ends = low.unionByName(high).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.where((F.col("below") > 1) | (F.col("below") == 1) & F.col("above")).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node of its component.

    Every node keeps the smallest node known to be reachable. A round hooks each node's root to the
    smallest root among its neighbours and then shortens the paths; long chains halve with each round.
    """
    star = written(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not _stars(star):
        # large star, then small star: each connects a node's neighbours to the smallest of them
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        next_ = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        star = written(next_.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct(), "star")
    return star.select(F.col("b").alias("node"), F.col("a").alias("root"))


def classes(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text)."""
    prints = written(docs.select("doc_id", fingerprints(words)(F.col("text")).alias("print")), "fingerprints")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    nodes = written(nodes, "distinct-fingerprints")
    tree = components(links(nodes.select("print"), radius))
    # the smallest id of each component, by its root; a component's nodes are counted before they meet
    rooted = tree.join(nodes, tree["node"] == nodes["print"]).select("node", "root", "least")
    own = tree.select(F.col("root").alias("node"), "root").distinct().join(nodes, F.col("node") == F.col("print")).select("node", "root", "least")
    members = written(rooted.unionByName(own), "members")
    smallest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.join(smallest, "root").select(F.col("node").alias("print"), F.col("component_id").alias("linked"))
    named = nodes.join(linked, "print", "left").select("print", F.coalesce("linked", "least").alias("component_id"))
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
