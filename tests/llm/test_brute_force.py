"""Operators against plain brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import math
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import common, langid, packing, quality, simhash, toxicity, warc, webp, winnow
from quire.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_simhash(spark, docs):
    prints = {}
    for i, r in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(r["text"]))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4 and least[j] < least[i]:
                    least[i], changed = least[j], True
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(spark, "op8_simhash")} == {(i, f"{p:016x}", least[i]) for i, p in prints.items()}


def test_covering_masks_collide_for_every_pair_in_the_radius():
    family = simhash.masks()
    assert len(family) == 31
    rng = random.Random(1)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        assert any(x & m == y & m for m in family)


def components_of(n, edges):
    least = list(range(n))
    find = lambda i: i if least[i] == i else find(least[i])
    for a, b in edges:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), unique=True, max_size=40), st.integers(0, 40))
def test_forests_have_the_links_components(values, cut):
    p = np.array(values, np.uint64)
    links = [(i, j) for i in range(len(p)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 1]
    assert components_of(len(p), simhash.forest(p, None, 1)) == components_of(len(p), links)
    cut = min(cut, len(p))
    across = [(i, j) for i, j in links if (i < cut) != (j < cut)]
    made = simhash.forest(p[:cut], p[cut:], 1)
    assert components_of(len(p), made) == components_of(len(p), across)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 120:  # a chain of near fingerprints, and others
        near = rng.choice(sorted(values))
        for b in rng.sample(range(64), 3):
            near ^= 1 << b
        values.add(near)
        values.add(rng.getrandbits(64))
    own = np.array(sorted(values), np.uint64)
    table = spark.createDataFrame([(int(v),) for v in own.view(np.int64)], "print bigint")
    at = {int(v): i for i, v in enumerate(own.view(np.int64))}
    edges = [(at[r["a"]], at[r["b"]]) for r in simhash.links(table).collect()]
    assert all((int(own[a]) ^ int(own[b])).bit_count() <= 4 for a, b in edges)
    every = [(i, j) for i in range(len(own)) for j in range(i) if (int(own[i]) ^ int(own[j])).bit_count() <= 4]
    assert components_of(len(own), edges) == components_of(len(own), every)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {105: 100, 103: 100}


def brute_windows(items):
    out: dict = {}
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            out.setdefault(k, {}).setdefault(tuple(w[a : a + k]), set()).add(i)
    return out


def brute_hits(windows, text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    hit, items = set(), set()
    for k, own in windows.items():
        for a in range(len(w) - k + 1):
            if tuple(w[a : a + k]) in own:
                items |= own[tuple(w[a : a + k])]
                hit |= set(range(a, a + k))
    return len(w), len(hit), sorted(map(str, items))


def test_winnowing(spark, docs, monkeypatch):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = brute_windows(items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in rows(spark, "op5_decontamination")}
    want = {i: brute_hits(windows, r["text"]) for i, r in docs.items()}
    assert got == {i: (n, h, len(x)) for i, (n, h, x) in want.items()} and any(h for _, h, _ in want.values())
    # in blocks, the same
    monkeypatch.setattr(winnow, "BLOCK", 2_000)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    again = winnow.find(table, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id", "leak.*").collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in again} == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c dd é".split()), max_size=25), max_size=4), st.lists(st.lists(st.sampled_from("a b c dd é".split()), max_size=60), max_size=4), st.booleans())
def test_winnowing_any_texts(items, texts, pieces):
    items = [(i, " ".join(t)) for i, t in enumerate(items)]
    own = [" ".join(t) for t in texts]
    m = winnow.Matcher(winnow.index(items))
    before, winnow.PIECE = winnow.PIECE, 16 if pieces else winnow.PIECE
    try:
        got = [(n, winnow.covered(s), winnow.names_of(x, m.of.names)) for n, s, x in m.batch(own)]
    finally:
        winnow.PIECE = before
    windows = brute_windows(items)
    assert got == [brute_hits(windows, t) for t in own]


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = {}
    for i, r in docs.items():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at : at + 2048]
            want[i, p] = (at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))
    out = rows(spark, "op4_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want
    ends = Counter()
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(n for _, n, _ in want.values()) // 2048) + 1


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_packing_plans(histogram):
    plan = packing.solve(histogram, 64, 40)
    placed = Counter()
    for config, n in plan:
        assert n > 0 and sum(k * m for k, m in config.items()) <= 64
        placed.update({k: m * n for k, m in config.items()})
    assert placed == Counter(histogram)
    bins = sum(n for _, n in plan)
    large = sum(n for k, n in histogram.items() if k > 32)
    bound = max(-(-sum(k * n for k, n in histogram.items()) // 64), large)
    assert bins <= 1.5 * bound + 2
    table = packing.runs(plan).tolist()
    ends = {i: (table[i + 1][1] if i + 1 < len(table) and table[i + 1][0] == r[0] else histogram[r[0]]) for i, r in enumerate(table)}
    room: dict[int, list] = {}
    for i, (length, first, sequence, offset, n) in enumerate(table):
        for k in range(ends[i] - first):
            room.setdefault(sequence + k % n, []).append((offset + k // n * length, length))
    assert len(room) == bins
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_tokens_of_odd_texts():
    own, tokenizer = packing.WordTokens(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for t in ("<|endoftext|> a", "ΑΣ ΟΔΟΣ", "İx", "a\x1cb", "é É", "a　b", "don't WE'LL '", "½ x²", "\x85a\xa0b\xadc", "\x00\x7f", "x" * 300, "Àß÷×"):
        assert own.ids(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_suffix_tree(spark, docs):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lowered(r["text"])) + [None] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i in docs if not held[i] for w in words[i])
    total, distinct = sum(c.values()), len(c)
    out = rows(spark, "op7_suffix_tree")
    for r in out:
        own = words[r["doc_id"]]
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(c[w] > 0 for w in own), total)
        assert abs(base - r["base_score"]) < 1e-6 * abs(base)
    of = lambda k: sum(r[k] for r in out if r["held_out"])
    assert of("score") > of("base_score")


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    clean = [r for r in out if labels.get(r["doc_id"]) == 0]
    assert sum(r["predicted"] for r in clean) < 0.05 * len(clean)
    score = {y: [r["score"] for r in out if r["held_out"] and labels.get(r["doc_id"]) == y] for y in (0, 1)}
    assert np.mean([a > b for a in score[1] for b in score[0]]) > 0.6


def test_toxicity_recall(spark):
    """Held-out rows of the larger table, of which some 450 toxic ones are labelled."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").collect()
    marked = [labels.get(r["doc_id"]) for r in out if r["predicted"] and r["doc_id"] in labels]
    toxic = sum(labels.get(r["doc_id"]) == 1 for r in out)
    assert sum(marked) > 0.7 * toxic and sum(marked) > 0.88 * len(marked)


def test_toxicity_scores(spark):
    """The scores of a fitted model, window by window, with a compressor of its own for each."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    ordinary = [prose(60).encode() for _ in range(200)]
    toxic = [f"{prose(20)} wretched gorgon {prose(20)} vile wretched muckraker {prose(9)}".encode() for _ in range(60)]
    model = toxicity.fit(toxic, ordinary, 0.2)
    params = zstandard.ZstdCompressionParameters(**toxicity.SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    compressed = lambda content, window: len(
        zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(window)
    )
    texts = [*(t.decode() for t in toxic[:3] + ordinary[:3]), prose(30), f"{prose(30)} you wretched gorgon {prose(30)} vile muckraker, wretched", "short", "", None, "é" * 45]
    want = []
    for t in texts:
        raw = (t or "").encode()
        starts = sorted({*range(0, max(1, len(raw) - toxicity.WINDOW + 1), toxicity.STEP), max(0, len(raw) - toxicity.WINDOW)}) if raw else []
        gains = sorted((compressed(model.ordinary, w) - compressed(model.toxic, w) for w in (raw[s : s + toxicity.WINDOW] for s in starts)), reverse=True)
        n, top = len(gains), [max(0, g) for g in (gains + [0, 0, 0])[:3]]
        surplus = [math.asinh((sum(g >= level for g in gains) - n * rate) / math.sqrt(n * rate + 0.25)) if n else 0 for level, rate in zip(toxicity.LEVELS, model.rates, strict=True)]
        x = [1, top[0] / 4, (top[1] + top[2]) / 8, *surplus, math.log1p(n) / 2]
        want.append(1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=True)))))))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["toxicity"] for r in toxicity.score_documents(table, model).orderBy("doc_id").collect()]
    assert np.allclose(got, want, atol=1e-9) and min(got[:3]) > 0.5 > max(got[3:7])


def test_window_offsets_cover_texts():
    for n in (0, 1, 39, 40, 41, 60, 61, 1000):
        seen = set()
        for s in toxicity.window_offsets(n).tolist():
            seen |= set(range(s, min(n, s + toxicity.WINDOW)))
        assert seen == set(range(n))


def _plain_grams(t: str) -> Counter:
    runs = re.findall(r"[^\W\d_]+", t.lower())
    own = " " + " ".join(runs) + (" " if runs else "")
    return Counter(own[i : i + 4] for i in range(len(own) - 3))


def test_language_scores():
    """Members, chance hits, counts and scores against sets of strings; the filters may only add what chance explains."""
    samples = {"aa": ["the cat and the dog and the hat"] * 3, "bb": ["die katze und der hund und der hut"] * 3, "cc": ["le chat et le chien et le chapeau"] * 3}
    model = langid.fit(samples, "aa")
    counts = {k: sum((_plain_grams(t) for t in v), Counter()) for k, v in samples.items()}
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    most = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    members = {k: {g for g, n in c.items() if n >= langid.LEAST and rate[k][g] >= langid.RATE * most[g]} for k, c in counts.items()}
    for text in ("the dog", "der hund und die katze", "le chien, et le chat!", "the hund et le cat", "zzzz qqqq", "Katze"):
        own = _plain_grams(text)
        n = sum(own.values())
        g, begins = langid.grams([text])
        hits = model.hits(g, begins)[0]
        exact = [sum(m for x, m in own.items() if x in members[k]) for k in model.languages]
        assert len(g) == n and all(h >= e for h, e in zip(hits, exact, strict=True)) and sum(hits) - sum(exact) <= 2
        corrected = [max(0, (h - n * c) / (1 - c)) for h, c in zip(hits, model.chance, strict=True)]
        best = max(range(3), key=lambda i: (corrected[i], -i))
        second = max(x for i, x in enumerate(corrected) if i != best)
        score = math.sqrt(min(1, corrected[best] / n) * corrected[best] / max(corrected[best] + second, 1e-9))
        names, scores = langid.identify([text], model)
        assert names == [model.languages[best]] and abs(scores[0] - score) < 1e-9


def test_language_of_pieces(monkeypatch):
    model = langid.fit({"aa": ["the cat and the dog"] * 3, "bb": ["die katze und der hund"] * 3}, "aa")
    texts = ["the dog, and " * 40 + "die katze", "ß" * 300, "1234 " * 90 + "der", "the " + "…" * 200 + "hund"]
    whole = langid.identify(texts, model)
    for piece in (64, 17, 5):
        monkeypatch.setattr(langid, "PIECE", piece)
        monkeypatch.setattr(langid.long_grams, "__defaults__", (piece,))
        cut = langid.identify(texts, model)
        assert cut[0] == whole[0] and np.allclose(cut[1], whole[1])


def test_filters_hold_chance():
    """Of strings that were never put in, a language's filter holds about as many as its chance says."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60_000))] * 3
    model = langid.fit({"aa": texts}, "aa")
    other = "".join(rng.choices("αβγδεζηθικλμνξοπρστυφχψω", k=60_000))
    g, begins = langid.grams([other])
    assert abs(model.hits(g, begins)[0][0] / len(g) - model.chance[0]) < 0.1 * model.chance[0] + 0.001


def test_names_that_are_taken(spark):
    """Columns of the caller stay as they are; the result's own name gets underscores."""
    docs = spark.createDataFrame([(1, "ten words of a benchmark item that stand here too", "mine")], "doc_id bigint, text string, leak string")
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    r = winnow.find(docs, items).first()
    assert r["leak"] == "mine" and r["leak_"]["n_hit"] == 10 and r["leak_"]["items"] == ["1"]
    r = toxicity.score_documents(docs.withColumnRenamed("leak", "TOXICITY"), None).first()
    assert r["TOXICITY"] == "mine" and r["toxicity_"] == 0
    r = webp.store(docs.withColumnRenamed("leak", "image")).first()
    assert r["image"] == "mine" and r["image_"]["n_bytes"] == 49


def test_index_of_a_whole_block():
    """Sixteen megabytes of benchmark take far less than a gigabyte."""
    rng = np.random.RandomState(0)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(20_000)])
    items = [(i, " ".join(words[rng.randint(0, 20_000, 200)])) for i in range(3_000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    found = winnow.index(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pickle.dumps(found)) < 8 * size and peak * winnow.BLOCK / size < 1 << 30


def test_language_held_out(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = [r for r in QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in out) > 0.97 * len(out)


@given(st.lists(st.text(max_size=30), max_size=6))
@settings(max_examples=80, deadline=None)
def test_grams_are_cut_at_texts(texts):
    together, begins = langid.grams(texts)
    alone = [langid.grams([t])[0] for t in texts]
    assert [together[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == [a.tolist() for a in alone]


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = [r for r in QUERIES["op10_quality"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in out) > 0.95 * len(out)


def test_sparse_sites_are_drawn_to_the_global_share(spark):
    rows = [(i, "some plain words here", "big.org/a" if i < 400 else "small.org/b" if i < 402 else f"mid{i % 9}.org/c") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    rng = random.Random(5)
    labels = spark.createDataFrame([(i, int(i >= 402 and rng.random() < 0.2 + (i % 9) / 12)) for i in range(600)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["path_share"] for r in quality.score(docs, labels, F.lit(True)).collect()}
    assert got[0] < 0.05 and got[0] < got[400] < 0.3


def test_warc_round_trip():
    records = [warc.Record(i, f"http://x/{i}\n", "response", (f"<p>{i}</p>" * (i % 7)).encode(), 0, "") for i in range(300)]
    records = [warc.Record(r.page_id, r.url, r.kind, r.payload, len(r.payload), warc.digest(r.payload)) for r in records]
    data = warc.encode_archive([warc.encode_record(r) for r in records])
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    back = [warc.decode_record(x) for x in warc.decode_archive(data)]
    assert [(r.page_id, r.payload, r.digest) for r in back] == [(r.page_id, r.payload, r.digest) for r in records]
    with pytest.raises(ValueError):
        list(warc.decode_archive(data[:-5]))


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=600))
def test_webp_round_trip(text):
    payload, n = webp.padded(text)
    assert n == len(text.encode()) and webp.samples(webp.encode(payload)).tobytes() == payload


def test_webp_repeated_lines_and_many_rows(monkeypatch):
    text = "a line of text that comes again and again\n" * 300 + "".join(map(chr, range(32, 200))) * 9
    payload = webp.padded(text)[0]
    assert len(webp.encode(payload)) < len(payload) / 3
    monkeypatch.setattr(webp, "MOST_ROWS", 7)
    media = webp.encode(payload)
    assert media.count(b"RIFF") > 1 and webp.samples(media).tobytes() == payload


def test_every_query_is_there():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert common.chunks([5, 1, 1, 9, 2], 6) == [(0, 2), (2, 3), (3, 4), (4, 5)]
