"""Lossless WebP: a writer for byte payloads and a reader of the whole format.

`decode` reads any lossless (VP8L) image: canonical prefix codes, simple and coded by code
lengths, meta prefix images, back-references with their distance map, the colour cache, and the
inverse predictor, cross-colour, subtract-green and palette transforms. Where all of a
group's group's literals take bits in one channel only and there is no cache, runs of literals are read as one array: the symbol and the length of the code that would
begin at each bit are looked up at once, and only the chain from code to code is followed one by one.

`encode` stores a payload as an image of one sample a pixel. The distinct bytes become a palette,
up to 16 of them are bundled several to a pixel, lines seen before become back-references, and
literals, lengths and distances get prefix codes by their frequencies, of one length only where that is smaller. The
predictor of the left or the upper sample is used where it makes the samples' entropy smaller. A colour cache is
never written: a pixel is one green symbol here, and a cache symbol in its place is as long; cross-colour
has nothing to work on with one channel. A payload beyond an image's size becomes several images one behind the other.

Cases: null and empty texts are stored as one row of blanks; equal texts give equal bytes; texts of
any length are stored; damaged files raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import unused

ROW = 192  # bytes of a payload are a multiple of this, and an image's width
MOST_ROWS = 16_384  # of an image
LEAST_COPY, MOST_COPY, FARTHEST = 24, 4096, 65_536 - 120
RUN = 1 << 16  # literals read at a time
AHEAD = 1 << 17  # bits that are looked up at a time
LONGEST = 12  # bits of a code that is written
#: Fixed value of the format: the order in which lengths of code length codes are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
PREDICT, CROSS, GREEN, PALETTE = range(4)

#: (x to the left, y up) of distance codes 1 to 120: the nearest places first, of equally near ones first those straight above.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class _Bits:
    """A reader of little-endian bit fields."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = bytes(data), 0, 8 * len(data)
        self.padded = self.data + bytes(16)

    def peek(self) -> int:
        b = self.at >> 3
        return int.from_bytes(self.padded[b : b + 8], "little") >> (self.at & 7)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends too early")

    def read(self, n: int) -> int:
        v = self.peek() & ((1 << n) - 1)
        self.skip(n)
        return v

    def fields(self, n: int, widths: list[int]) -> list[np.ndarray]:
        """The next n groups of codes of these widths, each with its most significant bit first; not skipped."""
        first, width = self.at >> 3, sum(widths)
        raw = np.frombuffer(self.data, np.uint8, min(len(self.data) - first, (n * width + 15) // 8), first)
        bits = np.unpackbits(raw, bitorder="little")[self.at & 7 :][: n * width].reshape(n, width)
        out, at = [], 0
        for w in widths:
            field = np.zeros(n, np.uint16)
            for i in range(at, at + w):
                field = (field << np.uint16(1)) | bits[:, i]
            out.append(field)
            at += w
        return out


_TURNED = np.packbits(np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, ::-1], axis=1).view(">u2").reshape(-1).tolist()


def _reverse(code: int, n: int) -> int:
    """The n (at most 16) bits of a code in reverse order."""
    return _TURNED[code] >> (16 - n)


class _Code:
    """A canonical prefix code. A code of one symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.single = used[0][1] if len(used) == 1 else None
        self.width, self.uniform = 0, None
        if self.single is not None:
            return
        if not used:
            raise ValueError("a prefix code has no symbols")
        if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
            raise ValueError("a prefix code is not complete")
        self.width = max(n for n, _ in used)
        used.sort()
        if used[0][0] == self.width:
            self.uniform = np.array([s for _, s in used], np.uint16)
        else:
            self.symbols, self.sizes = self._table(used)
            self.slow: list[tuple[int, int]] | None = None

    def _table(self, used: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length by the next `width` bits."""
        symbols, sizes = np.zeros(1 << self.width, np.uint16), np.zeros(1 << self.width, np.uint8)
        code, last = 0, 0
        for n, s in used:
            code <<= n - last
            x = _reverse(code, n)
            symbols[x :: 1 << n] = s
            sizes[x :: 1 << n] = n
            code, last = code + 1, n
        return symbols, sizes

    def read(self, bits: _Bits) -> int:
        if self.single is not None:
            return self.single
        ahead = bits.peek() & ((1 << self.width) - 1)
        if self.uniform is not None:
            bits.skip(self.width)
            return int(self.uniform[_reverse(ahead, self.width)])
        if self.slow is None:
            self.slow = list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))
        symbol, n = self.slow[ahead]
        bits.skip(n)
        return symbol


class _Ahead:
    """What a code would read at each of the next bits."""

    def __init__(self, bits: _Bits, code: _Code):
        self.begin = bits.at & ~7
        self.end = min(bits.end, self.begin + AHEAD)
        raw = np.frombuffer(bits.padded, np.uint8, (self.end - self.begin + 7) // 8 + 3, self.begin >> 3).astype(np.uint32)
        word = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
        place = np.empty((len(word), 8), np.uint32)
        for i in range(8):
            np.right_shift(word, np.uint32(i), out=place[:, i])
        self.place = place.reshape(-1) & np.uint32((1 << code.width) - 1)
        # how far one code reaches from each bit, and eight in a row
        self.step = np.zeros(len(self.place) + 9 * 16, np.uint8)
        code.sizes.take(self.place, out=self.step[: len(self.place)])
        places, far = np.arange(len(self.place), dtype=np.int32), self.step
        for _ in range(3):
            more = far.copy()
            more[: len(places)] += far.take(places + far[: len(places)])
            far = more
        self.eight = far.tobytes()
        self.code = code

    def literals(self, at: int, most: int) -> tuple[np.ndarray, int]:
        """The symbols from bit `at` on, most at most and all literals, and the bit behind them."""
        eight, i, end, found = self.eight, at - self.begin, self.end - self.begin, []
        add = found.append
        for _ in range(-(-most // 8)):
            if i >= end:
                break
            add(i)
            i += eight[i]
        where = np.empty((len(found), 8), np.int64)
        where[:, 0] = found
        for k in range(1, 8):
            where[:, k] = where[:, k - 1] + self.step[where[:, k - 1]]
        where = where.reshape(-1)[:most]
        behind = where + self.step[where]
        fits = behind <= end  # a code that ends beyond is read with the next bits
        if not fits.all() or (where >= end).any():
            n = int(np.argmin(fits & (where < end)))
            where, behind = where[:n], behind[:n]
        symbols = self.code.symbols[self.place[where]]
        other = np.flatnonzero(symbols >= LITERALS)
        if len(other):
            return symbols[: other[0]], self.begin + int(where[other[0]])
        return symbols, self.begin + (int(behind[-1]) if len(behind) else at - self.begin)


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        some = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if len(some) == 1 and some[0] < alphabet:
            return _lone(some[0])
        lengths = [0] * alphabet
        for s in some:
            if s >= alphabet:
                raise ValueError("a symbol is not in its alphabet")
            lengths[s] = 1
        return _code_of(tuple(lengths))
    lengths = [0] * alphabet
    own = [0] * len(LENGTH_ORDER)
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    table, mask = _length_table(tuple(own))
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last, place, data = 0, 8, bits.at, bits.padded
    while at < alphabet and most and place <= bits.end:
        most -= 1
        ahead = int.from_bytes(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
        n, size = table[ahead & mask]
        place += size
        if n < 16:
            lengths[at] = n
            at += 1
            last = n or last
            continue
        extra, least = ((2, 3), (3, 3), (7, 11))[n - 16]
        times = least + ((ahead >> size) & ((1 << extra) - 1))
        place += extra
        if at + times > alphabet:
            raise ValueError("code lengths run over the alphabet")
        if n == 16:
            lengths[at : at + times] = [last] * times
        at += times
    bits.skip(place - bits.at)
    return _code_of(tuple(lengths))


@lru_cache(256)
def _length_table(lengths: tuple[int, ...]) -> tuple[list[tuple[int, int]], int]:
    """Symbol and length of a code of code lengths by the next bits, and their mask."""
    code = _Code(list(lengths))
    if code.single is not None:
        return [(code.single, 0)], 0
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    return list(zip(*(x.tolist() for x in code._table(used)), strict=True)), (1 << code.width) - 1


@lru_cache(256)
def _lone(symbol: int) -> _Code:
    return _Code([0] * symbol + [1])


@lru_cache(64)
def _code_of(lengths: tuple[int, ...]) -> _Code:
    return _Code(list(lengths))


def _value(bits: _Bits, symbol: int) -> int:
    """The length or distance that a prefix symbol and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: _Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image as a flat array of ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, step = None, 0
    if main and bits.read(1):
        step = bits.read(3) + 2
        across = -(-width >> step)
        meta = (_read_image(bits, across, -(-height >> step)) >> np.uint32(8)) & np.uint32(0xFFFF)
    sizes = (LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES)
    groups = [[_read_code(bits, n) for n in sizes] for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    out = np.zeros(width * height, np.uint32)
    cache, cached = [0] * (1 << cache_bits), 0
    at, total = 0, width * height
    green, red, blue, alpha, distance = groups[0]
    others = (red, blue, alpha)
    fast = meta is None and not cache_bits
    same = fast and all(c.single is not None or c.uniform is not None for c in (green, *others)) and green.single is None  # pixels of one width
    fast = same or (fast and green.single is None and None not in (red.single, blue.single, alpha.single))
    window: _Ahead | None = None
    while at < total:
        if fast:
            if same:
                width = green.width + red.width + blue.width + alpha.width
                n = min(total - at, RUN, (bits.end - bits.at) // width)
                first, *rest = bits.fields(n, [green.width, red.width, blue.width, alpha.width])
                symbols = green.uniform[first]
                literal = symbols < LITERALS
                n = n if literal.all() else int(np.argmin(literal))
                argb = symbols[:n].astype(np.uint32) << np.uint32(8)
                for code, field, shift in zip(others, rest, (16, 0, 24), strict=True):
                    argb |= (np.uint32(code.single) if code.single is not None else code.uniform[field[:n]].astype(np.uint32)) << np.uint32(shift)
                behind = bits.at + n * width
            else:
                if window is None or bits.at + green.width > window.end:
                    window = _Ahead(bits, green)
                symbols, behind = window.literals(bits.at, total - at)
                argb = (symbols.astype(np.uint32) << np.uint32(8)) | np.uint32(alpha.single << 24 | red.single << 16 | blue.single)
            if len(argb):
                out[at : at + len(argb)] = argb
                bits.skip(behind - bits.at)
                at += len(argb)
                continue
        elif meta is not None:
            green, red, blue, alpha, distance = groups[int(meta[(at // width >> step) * across + (at % width >> step)])]
        s = green.read(bits)
        if s < LITERALS:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < LITERALS + LENGTHS:
            n, code = _value(bits, s - LITERALS), _value(bits, distance.read(bits))
            if code > len(NEAR):
                back = code - len(NEAR)
            else:
                x, y = NEAR[code - 1]
                back = max(1, x + y * width)
            if back > at or n > total - at:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + n, back):
                m = min(back, at + n - i)
                out[i : i + m] = out[at - back : at - back + m]
            at += n
        else:
            while cached < at:
                c = int(out[cached])
                cache[(0x1E35A7BD * c & 0xFFFFFFFF) >> (32 - cache_bits)] = c
                cached += 1
            out[at] = cache[s - LITERALS - LENGTHS]
            at += 1
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue as the last axis."""
    return np.stack([(argb >> np.uint32(n)) & np.uint32(255) for n in (24, 16, 8, 0)], -1).astype(np.int32)


def _together(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _prediction(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The predicted channels from the left, top, top right and top left pixels; the first axis may hold many pixels."""
    if mode in (0, 14, 15):
        return np.broadcast_to(np.array([255, 0, 0, 0], np.int32), top.shape)
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return (((left + right) >> 1) + top) >> 1
    if mode < 10:
        a, b = {6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}[mode]
        return (a + b) >> 1
    if mode == 10:
        return (((left + corner) >> 1) + ((top + right) >> 1)) >> 1
    if mode == 11:  # the nearer of left and top to left + top - corner
        nearer = np.abs(top - corner).sum(-1) < np.abs(left - corner).sum(-1)
        return np.where(nearer[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = (left + top) >> 1
    half = mean - corner
    return np.clip(mean + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)


def _unpredict(argb: np.ndarray, width: int, height: int, modes: np.ndarray, step: int) -> np.ndarray:
    """Add predictions. Rows whose modes don't look left are done whole, others pixel by pixel."""
    c = _channels(argb).reshape(height, width, 4)
    modes = ((modes >> np.uint32(8)) & np.uint32(15)).astype(np.int64).reshape(-(-height >> step), -(-width >> step))
    c[0, 0, 0] += 255
    c[0] = np.cumsum(c[0], 0) & 255
    for y in range(1, height):
        above, row = c[y - 1], c[y]
        row[0] = (row[0] + above[0]) & 255
        for block in range(modes.shape[1]):
            mode = int(modes[y >> step, block])
            a, b = max(1, block << step), min(width, (block + 1) << step)
            if a >= b:
                continue
            if mode in (0, 2, 3, 4, 8, 9, 14, 15):
                right = above[a + 1 : b + 1]
                if len(right) < b - a:  # right of the last pixel above comes this row's first
                    right = np.concatenate([right, row[:1]])
                row[a:b] = (row[a:b] + _prediction(mode, above[a:b], above[a:b], right, above[a - 1 : b - 1])) & 255
            elif mode == 1:
                row[a:b] = (row[a - 1] + np.cumsum(row[a:b], 0)) & 255
            else:
                for x in range(a, b):
                    right = above[x + 1] if x + 1 < width else row[0]
                    row[x] = (row[x] + _prediction(mode, row[x - 1], above[x], right, above[x - 1])) & 255
    return _together(c).reshape(-1)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255) - ((x & 128) << 1)


def _uncross(argb: np.ndarray, width: int, height: int, elements: np.ndarray, step: int) -> np.ndarray:
    c = _channels(argb).reshape(height, width, 4)
    e = _channels(elements).reshape(-(-height >> step), -(-width >> step), 4)
    e = e[np.arange(height)[:, None] >> step, np.arange(width)[None, :] >> step]
    red_blue, green_blue, green_red = (_signed(e[..., i]) for i in (1, 2, 3))
    green = _signed(c[..., 2])
    c[..., 1] = (c[..., 1] + (green_red * green >> 5)) & 255
    c[..., 3] = (c[..., 3] + (green_blue * green >> 5) + (red_blue * _signed(c[..., 1]) >> 5)) & 255
    return _together(c).reshape(-1)


def _unbundle(argb: np.ndarray, packed: int, width: int, height: int, palette: np.ndarray, each: int) -> np.ndarray:
    """Palette indices, 2**each of them to a pixel's green, as colours."""
    index = (argb >> np.uint32(8)) & np.uint32(255)
    if each:
        bits = 8 >> each
        index = (index.reshape(height, packed, 1) >> (np.arange(1 << each, dtype=np.uint32) * np.uint32(bits))) & np.uint32((1 << bits) - 1)
        index = index.reshape(height, packed << each)[:, :width].reshape(-1)
    whole = np.zeros(256, np.uint32)
    whole[: len(palette)] = palette
    return whole[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: uint8, height x width x (alpha, red, green, blue)."""
    return _channels(decode_argb(data)).astype(np.uint8)


def decode_argb(data: bytes) -> np.ndarray:
    """The pixels as rows of ARGB numbers."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    n = int.from_bytes(data[16:20], "little")
    if len(data) < 20 + n or n < 5:
        raise ValueError("the file ends too early")
    bits = _Bits(data[21 : 20 + n])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICT, CROSS):
            step = bits.read(3) + 2
            undo.append((kind, now, step, _read_image(bits, -(-now >> step), -(-height >> step))))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            colours = _together(np.cumsum(_channels(_read_image(bits, size, 1)), 0))
            each = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, now, each, colours))
            now = -(-now >> each)
        else:
            undo.append((kind, now, 0, None))
    argb = _read_image(bits, now, height, True)
    for kind, before, step, image in reversed(undo):
        if kind == PREDICT:
            argb = _unpredict(argb, before, height, image, step)
        elif kind == CROSS:
            argb = _uncross(argb, before, height, image, step)
        elif kind == PALETTE:
            argb = _unbundle(argb, -(-before >> step), before, height, image, step)
        else:
            c = _channels(argb)
            c[:, 1] += c[:, 2]
            c[:, 3] += c[:, 2]
            argb = _together(c)
    return argb.reshape(height, width)


class _Writer:
    """Bits, first ones first."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append(_bits_of(value, n))

    def data(self) -> bytes:
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


@lru_cache(4096)
def _bits_of(value: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(value.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number for a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    extra = v.bit_length() - 2
    return 2 * (extra + 1) + ((v >> extra) & 1), v & ((1 << extra) - 1), extra


def _frequent(counts: np.ndarray) -> np.ndarray:
    """Code lengths for symbols that occur so often, LONGEST at most: a Huffman code, of flatter counts until it fits. At least one occurs."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(c, i) for i, c in enumerate(weights)]
        heapify(heap)
        above: list[int] = [0] * (2 * len(weights) - 1)
        for node in range(len(weights), len(above)):
            a, i = heappop(heap)
            b, j = heap[0]
            above[i] = above[j] = node
            heapreplace(heap, (a + b, node))
        depth = [0] * len(above)
        for i in range(len(above) - 2, -1, -1):
            depth[i] = depth[above[i]] + 1
        sizes = depth[: len(weights)]
        if max(sizes) <= LONGEST:
            out[used] = sizes
            return out
        weights = [(c + 1) // 2 for c in weights]


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, most significant bit first."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    code, last = 0, 0
    for s in used[np.argsort(lengths[used], kind="stable")].tolist():
        n = int(lengths[s])
        code <<= n - last
        out[s], last = code, n
        code += 1
    return out


@lru_cache(1024)
def _same_bits(alphabet: int, runs: tuple[tuple[int, int], ...]) -> np.ndarray:
    """A code whose symbols in the runs (first, behind the last) all have one length: their number is a power of two."""
    return _code_bits(_same(alphabet, runs))


def _same(alphabet: int, runs: tuple[tuple[int, int], ...]) -> np.ndarray:
    flat = np.zeros(alphabet, np.int64)
    for a, b in runs:
        flat[a:b] = max(1, sum(b - a for a, b in runs).bit_length() - 1)
    return flat


def _code_bits(lengths: np.ndarray) -> np.ndarray:
    """How a code is stored: a lone symbol as such, else the code lengths, with runs of equal ones shortened."""
    used = np.flatnonzero(lengths)
    if len(used) == 1 and used[0] < 256:
        return _bits_of(1 | 0 << 1 | 1 << 2 | int(used[0]) << 3, 11)
    items: list[tuple[int, int, int]] = []  # code length symbol, extra bits, their number
    edges = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
    for a, b, size in zip(edges[:-1], edges[1:], lengths[edges[:-1]].tolist(), strict=True):
        n = b - a
        if size:
            items.append((size, 0, 0))
            n -= 1
        while n:
            if not size and n >= 11:
                m = min(n, 138)
                items.append((18, m - 11, 7))
            elif not size and n >= 3:
                m = min(n, 10)
                items.append((17, m - 3, 3))
            elif size and n >= 3:
                m = min(n, 6)
                items.append((16, m - 3, 2))
            else:
                m = 1
                items.append((size, 0, 0))
            n -= m
    counts = [0] * len(LENGTH_ORDER)
    for kind, _, _ in items:
        counts[kind] += 1
    kinds = sorted((s for s, n in enumerate(counts) if n), key=lambda s: -counts[s])
    longest = (len(kinds) - 1).bit_length()
    short = (1 << longest) - len(kinds)  # the commonest have codes of one bit less
    own = np.zeros(len(LENGTH_ORDER), np.int64)
    for k, s in enumerate(kinds):
        own[s] = 1 if len(kinds) == 1 else longest - 1 if k < short else longest
    sizes = own.tolist()
    codes = [_reverse(c, n) for c, n in zip(_codes(own).tolist(), sizes, strict=True)]
    many = max(4, max(LENGTH_ORDER.index(s) for s in kinds) + 1)
    value, at = (many - 4) << 1, 5  # bits as one number, first ones lowest
    for s in LENGTH_ORDER[:many]:
        value |= sizes[s] << at
        at += 3
    at += 1
    for s, extra, n in items:
        if len(kinds) > 1:
            value |= codes[s] << at
            at += sizes[s]
        if n:
            value |= extra << at
            at += n
    return np.unpackbits(np.frombuffer(value.to_bytes(at // 8 + 1, "little"), np.uint8), bitorder="little")[:at]


def _copies(data: bytes) -> list[tuple[int, int, int]]:
    """(place, length, distance) of lines that came before, in order and without overlap."""
    out, at, seen = [], 0, {}
    for line in data.split(b"\n"):
        n = len(line) + 1
        if n >= LEAST_COPY and at + n <= len(data):
            before = seen.get(line)
            if before is not None and at - before <= FARTHEST:
                out.extend((i, min(MOST_COPY, at + n - i), at - before) for i in range(at, at + n, MOST_COPY))
            seen[line] = at
        at += n
    return out


def _entropy(values: np.ndarray) -> float:
    """Bits that the values take by themselves."""
    n = np.bincount(values)
    n = n[n > 0]
    return float((n * np.log2(len(values) / n)).sum())


def _residuals(symbols: np.ndarray, mode: int) -> np.ndarray:
    """What the predictor leaves of the symbols: 1 predicts from the left, 2 from above; the first row is always by the left, the first column by above."""
    rows = symbols.reshape(-1, ROW).astype(np.int16)
    out = np.empty_like(rows)
    out[0] = np.diff(rows[0], prepend=np.int16(0))
    out[1:, 0] = rows[1:, 0] - rows[:-1, 0]
    out[1:, 1:] = rows[1:, 1:] - (rows[1:, :-1] if mode == 1 else rows[:-1, 1:])
    return (out & 255).astype(np.uint16).reshape(-1)


def _coded(symbols: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The bits of the symbols' codes."""
    n = lengths[symbols]
    if not len(n) or (n[0] == n).all():
        width = int(n[0]) if len(n) else 0
        c = codes[symbols]
        return np.stack([(c >> (width - 1 - i)) & 1 for i in range(width)], 1).astype(np.uint8).reshape(-1) if width else np.zeros(0, np.uint8)
    ends = np.cumsum(n)
    left = np.repeat(ends, n) - np.arange(1, int(ends[-1]) + 1)  # bits of its code behind each bit
    return ((np.repeat(codes[symbols], n) >> left) & 1).astype(np.uint8)


def _encode_one(samples: np.ndarray) -> bytes:
    """Samples of whole rows as one file."""
    height = len(samples) // ROW
    values = np.flatnonzero(np.bincount(samples, minlength=256))
    size = len(values)
    index = np.zeros(256, np.uint16)
    index[values] = np.arange(size)
    each = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
    symbols = index[samples]
    if each:
        bits = 8 >> each
        symbols = (symbols.reshape(-1, 1 << each) << (np.arange(1 << each, dtype=np.uint16) * np.uint16(bits))).sum(1).astype(np.uint16)
    copies = [] if each else _copies(samples.tobytes())
    mode = 0
    if not each and not copies:
        plain = _entropy(symbols)
        least, by = min((_entropy(_residuals(symbols, m)), m) for m in (1, 2))
        if least < 0.95 * plain - 512:
            mode, symbols = by, _residuals(symbols, by)
    w = _Writer()
    w.put(ROW - 1 | (height - 1) << 14, 28)
    w.put(0, 4)  # no alpha; version 0
    w.put(1 | PALETTE << 1 | (size - 1) << 3, 11)
    w.put(0, 1)  # the palette's image: no colour cache; greens of 8 bits, one red and blue, and alpha of 255 and then 0
    one = _same_bits(256, ((0, 1),))
    w.parts += [_same_bits(LITERALS + LENGTHS, ((0, 256),)), one, one]
    w.put(1 | 1 << 1 | 0 << 2 | 0 << 3 | 255 << 4, 12)
    w.parts.append(_same_bits(DISTANCES, ((0, 1),)))
    steps = np.diff(values, prepend=0)
    greens = np.stack([(steps >> (7 - i)) & 1 for i in range(8)] + [np.arange(size) == 0], 1).astype(np.uint8)
    w.parts.append(greens.reshape(-1))
    if mode:  # an image of the mode in the largest blocks: codes of one symbol, so its pixels take no bits
        w.put(1 | PREDICT << 1 | 7 << 3 | 0 << 6, 7)
        w.parts += [_same_bits(LITERALS + LENGTHS, ((mode, mode + 1),)), one, one, one, _same_bits(DISTANCES, ((0, 1),))]
    w.put(0, 3)  # no further transform, no colour cache, one group of codes
    # literals between the copies, and the symbols and extra bits of each copy
    counts = np.bincount(symbols, minlength=LITERALS + LENGTHS)
    far = np.zeros(DISTANCES, np.int64)
    tokens = []
    for place, n, back in copies:
        counts[:LITERALS] -= np.bincount(symbols[place : place + n], minlength=LITERALS)
        long_, distance = _prefix(n), _prefix(back + len(NEAR))
        counts[LITERALS + long_[0]] += 1
        far[distance[0]] += 1
        tokens.append((place, place + n, long_, distance))
    literals = 256 if each or mode else size
    width = max(1, (literals + (LENGTHS if copies else 0) - 1).bit_length())
    same = _same(LITERALS + LENGTHS, ((0, min(LITERALS, (1 << width) - (LENGTHS if copies else 0))), *([(LITERALS, LITERALS + LENGTHS)] if copies else [])))
    lengths = _frequent(counts)
    header = _code_bits(lengths)
    if (1 << width) - (LENGTHS if copies else 0) <= LITERALS:
        plain_header = _code_bits(same)
        if counts.sum() * width + len(plain_header) < (counts * lengths).sum() + len(header):
            lengths, header = same, plain_header
    if (lengths > 0).sum() == 1:
        lengths = np.where(lengths > 0, 0, lengths)  # a lone symbol takes no bits
    codes = _codes(lengths)
    distances = _frequent(far) if copies else _same(DISTANCES, ((0, 1),))
    w.parts += [header, one, one, one, _code_bits(distances)]
    far_codes = _codes(distances)
    if (distances > 0).sum() == 1:
        distances = distances * 0
    at = 0
    for place, end, (s, extra, m), (d, far_extra, k) in tokens:
        w.parts.append(_coded(symbols[at:place], lengths, codes))
        n = int(lengths[LITERALS + s])
        w.put(_reverse(int(codes[LITERALS + s]), n) | extra << n, n + m)
        n = int(distances[d])
        w.put(_reverse(int(far_codes[d]), n) | far_extra << n, n + k)
        at = end
    w.parts.append(_coded(symbols[at:], lengths, codes))
    body = b"\x2f" + w.data()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload of a text, UTF-8 with blanks up to a positive multiple of ROW, and its length without them."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b" " * (-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def encode(payload: bytes) -> bytes:
    """A payload of whole rows as one or more WebP files, one behind the other."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"a payload is a positive multiple of {ROW} bytes")
    samples = np.frombuffer(payload, np.uint8)
    return b"".join(_encode_one(samples[i : i + ROW * MOST_ROWS]) for i in range(0, len(samples), ROW * MOST_ROWS))


def images(media: bytes) -> Iterator[np.ndarray]:
    """The images of stored media as rows of ARGB numbers."""
    at = 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield decode_argb(media[at : at + n])
        at += n


def samples(media: bytes) -> np.ndarray:
    """Stored media as rows of 8-bit samples, which are the pixels' greens."""
    return np.concatenate([(x >> np.uint32(8)).astype(np.uint8) for x in images(media)])


def feature(pixels: np.ndarray) -> str:
    """64 bits as hex: is the mean of each 64th of the samples above the mean of all? Fewer than 64 samples can't be."""
    flat = pixels.reshape(-1).astype(np.int64)
    cut = np.arange(64) * len(flat) // 64
    sums, sizes = np.add.reduceat(flat, cut), np.diff(np.append(cut, len(flat)))
    return f"{int.from_bytes(np.packbits(sums * len(flat) > flat.sum() * sizes).tobytes(), 'big'):016x}"


_READ = pa.struct(
    [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def stored(text: Column) -> Column:
    """struct<media, n_bytes>: a text as lossless WebP."""

    @F.arrow_udf("struct<media:binary,n_bytes:bigint>")
    def run(texts: pa.Array) -> pa.Array:
        media, sizes = [], []
        for t in texts:
            payload, n = padded(t.as_py())
            media.append(encode(payload))
            sizes.append(n)
        return pa.StructArray.from_arrays([pa.array(media, pa.binary()), pa.array(sizes, pa.int64())], ["media", "n_bytes"])

    return run(text.cast("string"))


def described(media: Column) -> Column:
    """Sizes, checksums and the feature of stored media, read back; null where there are none."""

    @F.arrow_udf("struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>")
    def run(media: pa.Array) -> pa.Array:
        out = []
        for m in media.to_pylist():
            if m is None:
                out.append(None)
                continue
            read = samples(m)
            raw = read.tobytes()
            own = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(read))
            out.append(dict(zip(_READ.names, own, strict=True)))
        return pa.array(out, _READ)

    return run(media)


def pixels(media: Column) -> Column:
    """struct<height, width, samples>: the pixel array of stored media."""

    @F.arrow_udf("struct<height:int,width:int,samples:binary>")
    def run(media: pa.Array) -> pa.Array:
        out = []
        for m in media.to_pylist():
            p = None if m is None else samples(m)
            out.append(None if p is None else {"height": p.shape[0], "width": p.shape[1], "samples": p.tobytes()})
        return pa.array(out, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("samples", pa.binary())]))

    return run(media)


def store(docs: DataFrame, text: str = "text", into: str = "image") -> DataFrame:
    """docs with a column struct<media, n_bytes>, named into, or that with underscores where docs has such a column."""
    return docs.withColumn(unused(into, docs.columns), stored(F.col(text)))
