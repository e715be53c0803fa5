"""The configuration program converges and places the pieces itself."""

from __future__ import annotations

import random

import numpy as np

from quire.llm import packing


def test_the_program_covers_and_places():
    r = random.Random(1)
    histogram = {k: r.randrange(1, 40) for k in r.sample(range(1, 256), 150)}
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[k] for k in lengths.tolist()], float)
    found, gap = packing.program(lengths, need, 256, packing.ROUNDS)
    cover = sum(np.bincount(c, np.repeat(x, np.diff(np.append(0, e))) * n, len(lengths)) for c, n, e, x in found)
    assert gap <= 1 + packing.GAP and (cover >= need * (1 - 1e-9)).all()
    left = dict(histogram)
    packing.rounded(left, 256, packing.ROUNDS)
    assert sum(left.values()) <= 0.3 * sum(histogram.values())
