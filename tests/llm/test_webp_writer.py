"""What the writer stores is read back, and is what it should be: prefix codes by frequency, predictors where they pay, copies."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import webp


def back(text: str | None) -> int:
    payload, _ = webp.padded(text)
    media = webp.encode(payload)
    assert webp.samples(media).tobytes() == payload
    return len(media)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=1500) | st.text("ab\n", max_size=3000) | st.lists(st.text("etaoin \n", min_size=20, max_size=60), max_size=40).map("\n".join))
def test_round_trip(text):
    back(text)


def test_documents_are_smaller():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    sizes = [(len(webp.padded(t)[0]), back(t)) for t in texts]
    assert sum(b for _, b in sizes) < 0.58 * sum(a for a, _ in sizes)


def test_predictor_where_it_pays():
    rng = np.random.RandomState(0)
    above = "".join("".join(chr(int(x)) for x in 40 + (row + i) % 80) for i, row in enumerate([rng.randint(40, 90, webp.ROW)] * 100))
    left = "".join(chr(33 + int(x) % 90) for x in np.cumsum(rng.randint(0, 2, 192 * 60)))
    noise = "".join(map(chr, rng.randint(33, 123, 192 * 60)))
    for text, modes in ((above, {2}), (left, {1}), (noise, set())):
        seen = set()
        real = webp._unpredict
        webp._unpredict = lambda argb, width, height, image, step: seen.update(((image >> np.uint32(8)) & np.uint32(15)).tolist()) or real(argb, width, height, image, step)  # noqa: B023
        try:
            assert back(text) < len(text)
        finally:
            webp._unpredict = real
        assert seen == modes


@pytest.mark.parametrize("counts", [[1, 1], [5, 1, 1, 1], [2**i for i in range(30)], list(range(1, 281)), [0, 7, 0]])
def test_codes_are_complete(counts):
    lengths = webp._frequent(np.array(counts + [0] * (280 - len(counts))))
    used = lengths[lengths > 0]
    assert used.max() <= webp.LONGEST and (len(used) == 1 or sum(2.0 ** -used) == 1)
    order = sorted(i for i, c in enumerate(counts) if c)
    assert all(lengths[i] >= lengths[j] for i in order for j in order if counts[i] < counts[j])


def test_long_and_copied():
    line = "this line is long enough to be copied from far above\n"
    assert back(line * 2000) < 20_000
    back("".join(f"{line}{i}\n" for i in range(3000)))
    back("é" * 300_000)
    back("".join(chr(33 + i * i % 500) for i in range(webp.ROW * webp.MOST_ROWS // 2)))
