"""The reader against streams with every feature of the format, made by a small writer of their own."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pytest

from quire.llm import webp

ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


class Bits:
    def __init__(self):
        self.out = []

    def put(self, v, n):
        self.out += [(v >> i) & 1 for i in range(n)]

    def code(self, v, n):
        self.out += [(v >> i) & 1 for i in reversed(range(n))]

    def data(self):
        return np.packbits(self.out, bitorder="little").tobytes()


def lengths_of(counts, size):
    out = [0] * size
    heap = [(n, s, (s,)) for s, n in counts.items()]
    heapq.heapify(heap)
    if len(heap) == 1:
        out[heap[0][1]] = 1
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return out


def codes_of(lengths):
    codes, code, last = {}, 0, 0
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    for n, s in used:
        code <<= n - last
        codes[s] = (code, n) if len(used) > 1 else (0, 0)
        code, last = code + 1, n
    return codes


def put_code(bits, lengths):
    bits.put(0, 1)
    bits.put(15, 4)
    for s in ORDER:
        bits.put(4 if s < 16 else 0, 3)
    bits.put(0, 1)
    for n in lengths:
        bits.code(n, 4)


def prefix(v):
    if v <= 4:
        return v - 1, 0, 0
    n = (v - 1).bit_length() - 2
    return 2 * (n + 1) + ((v - 1) >> n & 1), (v - 1) & ((1 << n) - 1), n


def put_image(bits, pixels, width, cache_bits=0, blocks=0, main=False):
    """Entropy-coded pixels with colour cache, back-references and, in blocks of 2**blocks pixels, two groups of codes."""
    size, table, symbols, at = len(pixels), {}, [], 0
    key = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < size:
        run, back = 0, 0
        for d in (1, width, width + 1, 7):
            n = 0
            while d <= at and at + n < size and n < 4096 and pixels[at + n] == pixels[at + n - d]:
                n += 1
            run, back = max((run, back), (n, d))
        if run >= 3:
            symbols.append((at, "copy", run, {width: 1, 1: 2, width + 1: 3}.get(back, back + 120)))
            step = run
        elif cache_bits and table.get(key(pixels[at])) == pixels[at]:
            symbols.append((at, "cache", key(pixels[at]), 0))
            step = 1
        else:
            symbols.append((at, "pixel", pixels[at], 0))
            step = 1
        for p in pixels[at : at + step]:
            if cache_bits:
                table[key(p)] = p
        at += step
    across = -(-width >> blocks) if blocks else 0
    group = lambda i: ((i // width >> blocks) + (i % width >> blocks)) % 2 if blocks else 0
    counts = [[{}, {}, {}, {}, {}] for _ in range(2 if blocks else 1)]
    for i, kind, a, b in symbols:
        own = counts[group(i)]
        add = lambda k, s, own=own: own[k].__setitem__(s, own[k].get(s, 0) + 1)
        if kind == "pixel":
            for k, s in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                add(k, s)
        elif kind == "cache":
            add(0, 280 + a)
        else:
            add(0, 256 + prefix(a)[0])
            add(4, prefix(b)[0])
    bits.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        bits.put(1 if blocks else 0, 1)
        if blocks:
            bits.put(blocks - 2, 3)
            height = -(-(size // width) >> blocks)
            put_image(bits, [((y + x) % 2) << 8 for y in range(height) for x in range(across)], across)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = []
    for own in counts:
        made = [lengths_of(c or {0: 1}, n) for c, n in zip(own, sizes, strict=True)]
        for m in made:
            put_code(bits, m)
        codes.append([codes_of(m) for m in made])
    for i, kind, a, b in symbols:
        own = codes[group(i)]
        if kind == "pixel":
            for k, s in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                bits.code(*own[k][s])
        elif kind == "cache":
            bits.code(*own[0][280 + a])
        else:
            for k, base, v in ((0, 256, a), (4, 0, b)):
                s, extra, n = prefix(v)
                bits.code(*own[k][base + s])
                bits.put(extra, n)


def file(width, height, put):
    bits = Bits()
    bits.put(width - 1 | (height - 1) << 14, 32)
    put(bits)
    body = b"\x2f" + bits.data()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def split(p):
    return [p >> n & 255 for n in (24, 16, 8, 0)]


def join(c):
    return sum((v & 255) << n for v, n in zip(c, (24, 16, 8, 0), strict=True))


def signed(v):
    return v - 256 if v & 128 else v


def predicted(mode, left, top, right, corner):
    """By the letter, channel by channel."""
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        guess = [a + b - c for a, b, c in zip(left, top, corner, strict=True)]
        away = lambda o: sum(abs(g - v) for g, v in zip(guess, o, strict=True))
        return left if away(left) < away(top) else top
    if mode == 12:
        return [clip(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clip(m + int((m - c) / 2)) for m, c in zip(avg(left, top), corner, strict=True)]
    return [
        lambda: [255, 0, 0, 0], lambda: left, lambda: top, lambda: right, lambda: corner, lambda: avg(avg(left, right), top), lambda: avg(left, corner),
        lambda: avg(left, top), lambda: avg(corner, top), lambda: avg(top, right), lambda: avg(avg(left, corner), avg(top, right)),
    ][mode]()


def picture(width, height, seed):
    rng = random.Random(seed)
    some = [rng.getrandbits(32) for _ in range(20)]
    out = []
    for i in range(width * height):
        out.append(out[i - width] if i >= width and rng.random() < 0.4 else rng.choice(some) if rng.random() < 0.7 else rng.getrandbits(32))
    return out


def check(pixels, width, height, put):
    got = webp.decode(file(width, height, put))
    assert got.shape == (height, width, 4) and got.reshape(-1, 4).tolist() == [split(p) for p in pixels]


@pytest.mark.parametrize("cache, blocks", [(0, 0), (4, 0), (0, 2), (10, 3)])
def test_codes_copies_cache_and_groups(cache, blocks):
    pixels = picture(23, 17, cache + blocks)
    check(pixels, 23, 17, lambda b: (b.put(0, 1), put_image(b, pixels, 23, cache, blocks, True)))


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height, step = 13, 11, 2
    pixels = picture(width, height, mode)
    c = [split(p) for p in pixels]
    rest = []
    for i, own in enumerate(c):
        y, x = divmod(i, width)
        if i == 0:
            guess = [255, 0, 0, 0]
        elif y == 0:
            guess = c[i - 1]
        elif x == 0:
            guess = c[i - width]
        else:
            guess = predicted(mode, c[i - 1], c[i - width], c[i - width + 1], c[i - width - 1])
        rest.append(join([a - b for a, b in zip(own, guess, strict=True)]))
    across, down = -(-width >> step), -(-height >> step)

    def put(b):
        b.put(1 | 0 << 1 | (step - 2) << 3, 6)
        put_image(b, [mode << 8] * (across * down), across)
        b.put(0, 1)
        put_image(b, rest, width, 0, 0, True)

    check(pixels, width, height, put)


def test_cross_colour_and_green():
    width, height, step = 14, 9, 3
    pixels = picture(width, height, 5)
    rng = random.Random(9)
    across, down = -(-width >> step), -(-height >> step)
    elements = [[255, *(rng.randrange(256) for _ in range(3))] for _ in range(across * down)]
    rest = []
    for i, p in enumerate(pixels):
        a, r, g, b = split(p)
        _, rb, gb, gr = elements[(i // width >> step) * across + (i % width >> step)]
        delta = lambda t, v: (signed(t) * signed(v)) >> 5
        nr, nb = (r - delta(gr, g)) & 255, (b - delta(gb, g) - delta(rb, r)) & 255
        rest.append(join([a, nr - g, g, nb - g]))

    def put(b):
        b.put(1 | 1 << 1 | (step - 2) << 3, 6)
        put_image(b, [join(e) for e in elements], across)
        b.put(1 | 2 << 1, 3)
        b.put(0, 1)
        put_image(b, rest, width, 3, 0, True)

    check(pixels, width, height, put)


@pytest.mark.parametrize("size", [2, 3, 16, 17, 200])
def test_palettes(size):
    width, height = 11, 6
    rng = random.Random(size)
    colours = [rng.getrandbits(32) for _ in range(size)]
    index = [rng.randrange(size) for _ in range(width * height)]
    each = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
    packed = -(-width >> each)
    rows = []
    for y in range(height):
        for x in range(packed):
            own = index[y * width + (x << each) : y * width + min(width, (x + 1) << each)]
            rows.append(0xFF000000 | sum(v << (k * (8 >> each)) for k, v in enumerate(own)) << 8)
    steps = [join([a - b for a, b in zip(split(p), split(q), strict=True)]) for p, q in zip(colours, [0, *colours], strict=False)]

    def put(b):
        b.put(1 | 3 << 1 | (size - 1) << 3, 11)
        put_image(b, steps, size)
        b.put(0, 1)
        put_image(b, rows, packed, 0, 0, True)

    check([colours[i] for i in index], width, height, put)


def test_damaged_files():
    good = webp.encode(webp.padded("some text " * 40)[0])
    for bad in (b"", good[:30], good[:-9], b"X" + good[1:], good[:20] + b"\x00" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
