"""Media columns: lossless WebP, written and read back as pixel arrays.

decode() reads any lossless image of the format: prefix codes (simple and normal, with meta codes), back-references
with the distance map, the colour cache, and the four transforms, which it inverts in reverse order: predictor,
cross-colour, subtract-green and palette (with packed pixels). decode_many() reads many images side by side if they have
a palette of over 16 colours, one group of codes of at most MOST bits and no cache: in each step all of them take one
pixel or back-reference, then copies are made, and palette and subtract-green are inverted; any other image goes through
decode(). encode() writes any pixels with one prefix code for each channel; encode_grey() writes grey samples as indexes
of a palette of their values, with back-references.

store_grey() puts a text's bytes, padded with spaces to a multiple of 192, into grey images 192 pixels wide and of at
most GREY_ROWS rows, one file after the other. store() writes the older form: red, green and blue samples of images 64
pixels wide. load_many() reads both back. A column of such files has a row's whole payload in it. Null texts count as
empty; an empty text has one row of spaces; equal texts are stored alike.
"""

import heapq
import struct
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import slices

WIDTH, ROW, ROWS, GREY_ROWS = 64, 192, 128, 32
#: Fixed values of the format: order of the code length codes, neighbours for short distances.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
MULTIPLIER = 0x1E35A7BD
#: Lengths of the code that encode() writes code lengths with: 13 symbols of 4 bits, 6 of 5.
_LENGTH_BITS = tuple(5 if s in (11, 12, 13, 14, 15, 16) else 4 for s in range(19))
#: Back-references of encode_grey(): bytes compared, shortest and longest; longest codes that are read side by side.
SAME, SHORT, LONG, MOST = 6, 12, 4096, 10


class Bits:
    """Bits of a byte string, lowest first; zeros follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.word, self.have = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.have < n:
            part = self.data[self.at : self.at + 64]
            self.at += 64
            self.word |= int.from_bytes(part, "little") << self.have
            self.have += 512
        return self.word & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.word >>= n
        self.have -= n
        return out

    def place(self) -> int:
        return self.at * 8 - self.have


def canonical(lengths) -> dict:
    """(length, code read highest bit first) -> symbol."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code = (code + 1 if out else 0) << (n - before)
        before = n
        out[(n, code)] = s
    return out


@lru_cache(256)
def _short_table(lengths: tuple) -> list:
    """(symbol, length) by the next bits, as many as the longest code of a short code has."""
    most = max(lengths)
    out = [None] * (1 << most)
    for (n, code), s in canonical(lengths).items():
        first = int(f"{code:0{n}b}"[::-1], 2)
        out[first :: 1 << n] = [(s, n)] * (1 << (most - n))
    return out


class Code:
    """A prefix code: lengths by symbol, or one symbol of no bits."""

    def __init__(self, lengths, used=None):
        self.lengths = lengths
        used = [s for s, x in enumerate(lengths) if x] if used is None else used
        self.single = used[0] if len(used) == 1 else None if used else 0
        self.table = None

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        if self.table is None:
            self.short = max(self.lengths) if max(self.lengths) <= 7 else 0
            self.table = _short_table(tuple(self.lengths)) if self.short else canonical(self.lengths)
        if self.short:
            found = self.table[bits.peek(self.short)]
            if found is None:
                raise ValueError("not a code")
            bits.word >>= found[1]
            bits.have -= found[1]
            return found[0]
        code, get = 0, self.table.get
        for n in range(1, 16):
            code = code << 1 | bits.read(1)
            found = get((n, code))
            if found is not None:
                return found
        raise ValueError("not a code")


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths = [0] * max(size, 256)
        used = [bits.read(8 if wide else 1)]
        if two:
            used.append(bits.read(8))
        for s in used:
            lengths[s] = 1
        return Code(lengths[:size] if size >= 256 else lengths, sorted(set(used)))
    first = [0] * 19
    for k in range(4 + bits.read(4)):
        first[ORDER[k]] = bits.read(3)
    code = Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, last = [], 8
    read = code.read
    while len(lengths) < size and left > 0:
        left -= 1
        s = read(bits)
        if s < 16:
            lengths.append(s)
            last = s or last
        else:
            value, bit, base = ((last, 2, 3), (0, 3, 3), (0, 7, 11))[s - 16]
            lengths += [value] * (base + bits.read(bit))
    return Code((lengths + [0] * size)[:size])


def _prefixed(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB pixels of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache, groups, meta, shift = [0] * (1 << cache_bits), 1, None, 0
    if top and bits.read(1):
        shift = bits.read(3) + 2
        step = 1 << shift
        meta = (_image(bits, -(-width // step), -(-height // step), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (256 + 24 + (len(cache) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    out, n, total = [], 0, width * height
    group = codes[0]
    while n < total:
        if meta is not None:
            group = codes[int(meta[(n // width) >> shift, (n % width) >> shift])]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = _prefixed(s - 256, bits)
            d = _prefixed(group[4].read(bits), bits)
            if d > 120:
                back = d - 120
            else:
                dx, dy = NEAR[d - 1]
                back = max(1, dx + dy * width)
            new = []
            for k in range(min(length, total - n)):
                at = n + k - back
                new.append(out[at] if at < n else new[at - n])
        else:
            new = [cache[s - 280]]
        out += new
        n += len(new)
        if cache_bits:
            for p in new:
                cache[((MULTIPLIER * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, dtype=np.int64).reshape(height, width)


def _channels(x):
    return x >> 24 & 255, x >> 16 & 255, x >> 8 & 255, x & 255


def _joined(a, r, g, b):
    return (a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | (b & 255)


def _average(x, y):
    return (((x ^ y) & 0xFEFEFEFE) >> 1) + (x & y)


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """Predicted pixel from its left, top, top-right and top-left neighbours."""
    simple = {0: 0xFF000000, 1: left, 2: top, 3: right, 4: corner}
    if mode in simple:
        return simple[mode]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7, 8, 9):
        return _average(*{6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}[mode])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    l, t, c = _channels(left), _channels(top), _channels(corner)  # noqa: E741
    if mode == 11:
        by_left = sum(abs(y - z) for y, z in zip(t, c, strict=True))
        by_top = sum(abs(x - z) for x, z in zip(l, c, strict=True))
        return left if by_left < by_top else top
    clamp = lambda v: min(255, max(0, v))
    if mode == 12:
        return _joined(*[clamp(x + y - z) for x, y, z in zip(l, t, c, strict=True)])
    if mode == 13:
        mean = _channels(_average(left, top))
        return _joined(*[clamp(m + int((m - z) / 2)) for m, z in zip(mean, c, strict=True)])
    return 0xFF000000


def add_predictions(x: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Inverts the predictor transform."""
    height, width = x.shape
    out = [0] * (height * width)
    flat = x.ravel().tolist()
    for y in range(height):
        for k in range(width):
            i = y * width + k
            if not y:
                p = out[i - 1] if k else 0xFF000000
            elif not k:
                p = out[i - width]
            else:
                p = predicted(int(modes[y >> shift, k >> shift]), out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
            v = flat[i]
            out[i] = ((v & 0xFF00FF00) + (p & 0xFF00FF00)) & 0xFF00FF00 | ((v & 0x00FF00FF) + (p & 0x00FF00FF)) & 0x00FF00FF
    return np.array(out, dtype=np.int64).reshape(height, width)


def add_cross_colour(x: np.ndarray, table: np.ndarray, shift: int) -> np.ndarray:
    """Inverts the cross-colour transform."""
    a, r, g, b = _channels(x)
    rows, columns = np.indices(x.shape)
    _, red_blue, green_blue, green_red = _channels(table[rows >> shift, columns >> shift])
    signed = lambda v: v - ((v & 128) << 1)
    delta = lambda t, c: signed(t) * signed(c) >> 5
    red = r + delta(green_red, g) & 255
    blue = b + delta(green_blue, g) + delta(red_blue, red) & 255
    return _joined(a, red, g, blue)


def _vp8l(data: bytes) -> Bits:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless image")
    return Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 array (alpha, red, green, blue) of a lossless image."""
    bits = _vp8l(data)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    opaque = not bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            shift = bits.read(3) + 2
            transforms.append((kind, shift, _image(bits, -(-wide // (1 << shift)), -(-height // (1 << shift)), False), wide))
        elif kind == 2:
            transforms.append((kind, 0, None, wide))
        else:
            size = bits.read(8) + 1
            colours = _image(bits, size, 1, False)[0].tolist()
            for k in range(1, size):  # each differs from the one before
                colours[k] = _joined(*[x + y for x, y in zip(_channels(colours[k]), _channels(colours[k - 1]), strict=True)])
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((kind, pack, np.array(colours + [0] * (256 - size), dtype=np.int64), wide))
            wide = -(-wide // (1 << pack))
    x = _image(bits, wide, height, True)
    for kind, shift, table, own in reversed(transforms):
        if kind == 0:
            x = add_predictions(x, table >> 8 & 15, shift)
        elif kind == 1:
            x = add_cross_colour(x, table, shift)
        elif kind == 2:
            a, r, g, b = _channels(x)
            x = _joined(a, r + g, g, b + g)
        else:
            each = 8 >> shift
            columns = np.arange(own)
            index = (x >> 8 & 255)[:, columns >> shift] >> (columns % (1 << shift)) * each
            x = table[index & ((1 << each) - 1)]
    a, r, g, b = _channels(x)
    return np.stack([np.full_like(a, 255) if opaque else a, r, g, b], axis=-1).astype(np.uint8)


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Prefix code lengths of a histogram, at most `most` bits; small counts are raised until they fit."""
    used = np.flatnonzero(counts).tolist()
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    floor, n = 1, len(used)
    counts = counts[used].tolist()
    while True:
        heap = [(max(floor, c), k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, node = [0] * (2 * n - 1), n
        while len(heap) > 1:
            x, i = heapq.heappop(heap)
            y, j = heap[0]
            parent[i] = parent[j] = node
            heapq.heapreplace(heap, (x + y, node))
            node += 1
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            out[used] = depth[:n]
            return out
        floor *= 2


def _reversed(lengths):
    """Codes by symbol, first bit lowest."""
    codes = np.zeros(len(lengths), np.int64)
    for (n, code), s in canonical(lengths.tolist() if isinstance(lengths, np.ndarray) else lengths).items():
        codes[s] = int(f"{code:0{n}b}"[::-1], 2)
    return codes


class Writer:
    """Bits, lowest first."""

    def __init__(self, word: int = 0, have: int = 0):
        self.word, self.have = word, have

    def put(self, value: int, n: int) -> None:
        self.word |= value << self.have
        self.have += n


_LENGTH_CODES = _reversed(_LENGTH_BITS).tolist()


def write_code(out: Writer, lengths) -> None:
    """A code of at most 15 bits; codes of one symbol below 256 take the simple form."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1 and (not used or used[0] < 256):
        out.put(1, 1), out.put(0, 1), out.put(1, 1), out.put(used[0] if used else 0, 8)
        return
    out.put(0, 1), out.put(15, 4)
    for s in ORDER:
        out.put(_LENGTH_BITS[s], 3)
    stop, steps, k, low = used[-1] + 1, [], 0, np.asarray(lengths).tolist()
    while k < stop:
        run = 0
        while low[k + run] == 0 and run < 138:
            run += 1
        if run >= 11:
            steps.append((18, run - 11, 7))
        elif run >= 3:
            steps.append((17, run - 3, 3))
        else:
            run = 1
            steps.append((low[k], 0, 0))
        k += run
    if len(steps) < 2:
        steps.append((0, 0, 0))
    n = len(steps) - 2
    size = max(1, -(-max(n, 1).bit_length() // 2))
    out.put(1, 1), out.put(size - 1, 3), out.put(n, 2 * size)
    for s, extra, bit in steps:
        out.put(_LENGTH_CODES[s], _LENGTH_BITS[s])
        if bit:
            out.put(extra, bit)


def _file(out: Writer, value: np.ndarray, n: np.ndarray) -> bytes:
    """A file of the bits so far and of values of n bits each, at most 32."""
    at = out.have + np.cumsum(n) - n
    total = out.have + int(n.sum())
    # codes do not overlap, so each 32-bit word is the sum of what its codes put there; sums stay exact in doubles
    word, value = at >> 5, value << (at & 31)
    words = np.bincount(word, weights=value & 0xFFFFFFFF, minlength=(total >> 5) + 2) + np.bincount(word + 1, weights=value >> 32, minlength=(total >> 5) + 2)
    head = np.frombuffer(out.word.to_bytes(4 * (-(-out.have // 32)), "little"), "<u4")
    words[: len(head)] += head
    body = words.astype("<u4").tobytes()[: -(-total // 8)]
    data = b"\x2f" + body
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


def encode(rgb: np.ndarray) -> bytes:
    """A lossless image of height x width x 3 samples, without transforms, one code for each channel."""
    height, width, _ = rgb.shape
    out = Writer()
    out.put(width - 1, 14), out.put(height - 1, 14), out.put(0, 1), out.put(0, 3)
    out.put(0, 1), out.put(0, 1), out.put(0, 1)  # no transform, no cache, no meta codes
    lengths = [code_lengths(np.bincount(rgb[..., c].ravel(), minlength=256)) for c in (1, 0, 2)]
    for k, x in enumerate(lengths):
        write_code(out, np.concatenate([x, np.zeros(24, np.int64)]) if not k else x)
    alpha = np.zeros(256, np.int64)
    alpha[255] = 1
    write_code(out, alpha)
    write_code(out, np.zeros(40, np.int64))
    code, size = np.zeros((3, 256), np.int64), np.zeros((3, 256), np.int64)
    for k, x in enumerate(lengths):
        if np.count_nonzero(x) > 1:
            code[k], size[k] = _reversed(x), x
    samples = rgb[..., [1, 0, 2]].reshape(-1, 3)
    which = np.arange(3)
    value, n = code[which, samples].ravel(), size[which, samples].ravel()
    return _file(out, value, n)


#: Extra bits and smallest value of the symbols of lengths and distances.
_EXTRA = np.array([max(0, (k - 2) >> 1) for k in range(40)], np.int64)
_BASE = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)], np.int64)


_NONE, _OPAQUE = np.zeros(256, np.int64), np.zeros(256, np.int64)
_OPAQUE[255] = 1


def _palette_codes(low: int, size: int):
    """Lengths of the codes of a palette's pixels: `low`, 1 and a back-reference in green, 255 and 0 in alpha."""
    green, alpha, far = np.zeros(280, np.int64), _OPAQUE.copy(), np.zeros(40, np.int64)
    green[sorted({low, 1, 256 + size})] = (1, 1) if low == 1 else (1, 2, 2)
    alpha[0] = far[1] = 1
    return green, _NONE, _NONE, alpha, far


def _copies(x: np.ndarray):
    """Places, distances and lengths of back-references: from each place on that repeats the SAME bytes last seen at a
    distance, as far as the places after it repeat at the same one, if these are SHORT bytes or more."""
    n = max(0, len(x) - SAME + 1)
    whole = x.tobytes() + bytes(8)
    key = np.ndarray(n, ">u8", whole, strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * SAME)
    key = np.sort(key << np.uint64(15) | np.arange(n, dtype=np.uint64))
    place = (key & np.uint64(0x7FFF)).astype(np.int64)
    same = np.flatnonzero(key[1:] >> np.uint64(15) == key[:-1] >> np.uint64(15))
    back = np.zeros(n + 1, np.int64)
    back[place[same + 1]] = place[same + 1] - place[same]
    first = np.flatnonzero(np.diff(back, prepend=0))
    last = np.append(first, n)[1:]
    used = (back[first] > 0) & (last - first > SHORT - SAME)
    places, backs, sizes, free = [], [], [], 0
    for start, end, d in zip(first[used].tolist(), last[used].tolist(), back[first[used]].tolist(), strict=True):
        start = max(start, free)
        while end - start > SHORT - SAME:
            size = min(end - start + SAME - 1, LONG)
            places.append(start), backs.append(d), sizes.append(size)
            start = free = start + size
    return np.array(places, np.int64), np.array(backs, np.int64), np.array(sizes, np.int64)


@lru_cache(maxsize=8192)
def _head(width: int, height: int, low: int, colours: int) -> tuple[int, int]:
    """The bits of a grey file up to its codes, and their number: size, subtract-green and the palette."""
    out = Writer()
    out.put(width - 1, 14), out.put(height - 1, 14), out.put(0, 1), out.put(0, 3)
    out.put(1, 1), out.put(2, 2)
    out.put(1, 1), out.put(3, 2), out.put(colours - 1, 8)
    out.put(0, 1)  # the palette has no cache; a colour is its difference to the one before: low, 1 and copies of that
    size = int(np.searchsorted(_BASE, colours - 2, side="right")) - 1
    for lengths in _palette_codes(low, size):
        write_code(out, lengths)
    first, second, third = np.argsort(np.argsort([low, 1, 256 + size])).tolist() if low != 1 else (0, 0, 1)
    for k, step in enumerate((first, second, third)):
        out.put(*(step, 1) if low == 1 else ((0, 1), (1, 2), (3, 2))[step])
        if k < 2:
            out.put(1 - k, 1)  # alpha 255, then a difference of 0
    out.put(colours - 2 - int(_BASE[size]), int(_EXTRA[size]))  # the distance, one pixel, takes no bits
    out.put(0, 1), out.put(0, 1), out.put(0, 1)  # no further transform, no cache, no meta codes
    return out.word, out.have


@lru_cache(maxsize=1)
def _plain_codes() -> tuple[int, int]:
    """The bits of the codes of red, blue and alpha, which have one symbol each, and their number."""
    out = Writer()
    for lengths in (_NONE, _NONE, _OPAQUE):
        write_code(out, lengths)
    return out.word, out.have


def encode_grey(grey: np.ndarray) -> bytes:
    """A lossless image of height x width grey samples, at most 2^15: subtract-green, a palette of the values (their
    greens; over 16 entries, so that pixels are not packed), back-references and prefix codes."""
    height, width = grey.shape
    x = grey.ravel()
    low = min(int(x.min()), 239)
    out = Writer(*_head(width, height, low, max(17, int(x.max()) - low + 1)))
    places, backs, sizes = _copies(x)
    covered = np.zeros(len(x) + 1, np.int8)
    covered[places] += 1
    covered[places + sizes] -= 1
    plain = np.cumsum(covered[:-1], dtype=np.int8) == 0
    symbol = x.astype(np.int64) - low
    of_size = np.searchsorted(_BASE, sizes, side="right") - 1
    of_back = np.searchsorted(_BASE, backs + 120, side="right") - 1
    symbol[places] = 256 + of_size
    plain[places] = True
    symbol = symbol[plain]
    green = code_lengths(np.bincount(symbol, minlength=280), MOST)
    far = code_lengths(np.bincount(of_back, minlength=40), MOST)
    write_code(out, green)
    out.put(*_plain_codes())
    write_code(out, far)
    value, n = np.zeros((2, len(symbol)), np.int64)
    if np.count_nonzero(green) > 1:
        value, n = _reversed(green)[symbol], green[symbol]
    if len(places):
        at = np.flatnonzero(symbol >= 256)
        value[at] |= (sizes - _BASE[of_size]) << n[at]
        n[at] += _EXTRA[of_size]
        more, bits = np.zeros((2, len(at)), np.int64)
        if np.count_nonzero(far) > 1:
            more, bits = _reversed(far)[of_back], far[of_back]
        more |= (backs + 120 - _BASE[of_back]) << bits
        value, n = np.insert(value, at + 1, more), np.insert(n, at + 1, bits + _EXTRA[of_back])
    return _file(out, value, n)


_FLIP = np.array([int(f"{b:08b}"[::-1], 2) for b in range(256)], np.uint8)
_FLIP15 = np.array([int(f"{b:015b}"[::-1], 2) for b in range(1 << 15)], np.int64)
_NEAR = np.array([(121, 0), *NEAR], np.int64)


def _table(code: Code) -> np.ndarray | None:
    """16 * symbol + length by the next MOST bits; None if the code is longer or incomplete."""
    if code.single is not None:
        return np.full(1 << MOST, code.single << 4, np.int32)
    lengths = np.array(code.lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))[np.count_nonzero(lengths == 0) :]
    sizes = lengths[order]
    if sizes[-1] > MOST or int((1 << (MOST - sizes)).sum()) != 1 << MOST:
        return None
    return np.repeat((order << 4 | sizes).astype(np.int32), 1 << (MOST - sizes))


def _plan(data: bytes):
    """Width, height, red-green-blue palette, tables of both codes and place of the first pixel, or None."""
    bits = _vp8l(data)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if bits.read(4):
        return None
    green = bits.peek(3) == 5  # a transform, subtract-green
    if green:
        bits.read(3)
    if bits.read(1) == 0 or bits.read(2) != 3:
        return None
    size = bits.read(8) + 1
    if size <= 16:
        return None
    _, r, g, b = _channels(_image(bits, size, 1, False)[0])
    palette = np.zeros((256, 3), np.uint8)
    palette[:size] = np.cumsum(np.stack([r, g, b], axis=1), axis=0)
    if green:
        palette[:, [0, 2]] += palette[:, [1]]
    if bits.read(1) or bits.read(1) or bits.read(1):
        return None
    codes = [read_code(bits, n) for n in (280, 256, 256, 256, 40)]
    if any(c.single is None for c in codes[1:4]) or any(codes[4].lengths[34:]):
        return None
    tables = _table(codes[0]), _table(codes[4])
    return None if tables[0] is None or tables[1] is None else (width, height, palette, *tables, bits.place() + 8 * 21)


def decode_many(images: list[bytes]) -> list[np.ndarray]:
    """height x width x 3 samples of each image; those with a palette and one group of codes are read side by side."""
    plans = [_plan(data) for data in images]
    out: list = [None if plan else decode(data)[..., 1:] for plan, data in zip(plans, images, strict=True)]
    which = [k for k, plan in enumerate(plans) if plan]
    if not which:
        return out
    green, far = (np.concatenate([plans[k][c] for k in which]) for c in (3, 4))
    starts = np.cumsum([0] + [len(images[k]) for k in which])
    raw = _FLIP[np.frombuffer(b"".join(images[k] for k in which) + bytes(512), np.uint8)].astype(np.int64)
    wide = raw[:-7] << 56
    for k in range(1, 8):
        wide |= raw[k : len(raw) - 7 + k] << 8 * (7 - k)
    del raw
    top = lambda x, n: x >> (64 - n) & (1 << n) - 1
    count = np.array([plans[k][0] * plans[k][1] for k in which], np.int64)
    own, left = np.arange(len(which)), count.copy()
    place = np.array([plans[k][5] for k in which], np.int64) + 8 * starts[:-1]
    steps = []
    while len(own):
        base = own << MOST
        for _ in range(32):  # an image that has ended reads on until it is left out; what it reads is not used
            window = wide.take(place >> 3) << (place & 7)  # 57 bits; a pixel or back-reference has at most 43
            entry = green.take(base + top(window, MOST))
            symbol, bit = entry >> 4, entry & 15
            size = np.ones(len(own), np.int32)
            hits = np.flatnonzero(symbol >= 256)
            if len(hits):
                s, n, window = symbol[hits] - 256, bit[hits], window[hits]
                window <<= n
                size[hits] = _BASE[s] + (_FLIP15[top(window, 15)] & (1 << _EXTRA[s]) - 1)
                window <<= _EXTRA[s]
                entry = far.take(base[hits] + top(window, MOST))
                n += _EXTRA[s] + (entry & 15)
                window <<= entry & 15
                s = entry >> 4
                symbol[hits] = 255 + _BASE[s] + (_FLIP15[top(window, 15)] & (1 << _EXTRA[s]) - 1)
                bit[hits] = n + _EXTRA[s]
            place = place + bit
            steps.append((own.astype(np.uint16) if len(which) < 1 << 16 else own, symbol, size))
            left = left - size
        keep = left > 0
        own, left, place = own[keep], left[keep], place[keep]
    order = np.argsort(np.concatenate([x[0] for x in steps]), kind="stable")
    image, symbol, size = (np.concatenate([x[c] for x in steps])[order] for c in range(3))
    at = np.cumsum(size) - size
    first = np.searchsorted(image, np.arange(len(which)))
    at -= at[first][image]
    used = np.flatnonzero(at < count[image])
    image, symbol, size, at = image[used], symbol[used], size[used], at[used]
    size = np.minimum(size, count[image] - at)
    begin = np.cumsum(count) - count
    at += begin[image]
    flat = bytearray(int(count.sum()))
    plain = symbol < 256
    np.frombuffer(flat, np.uint8)[at[plain]] = symbol[plain]
    copy = ~plain
    code = symbol[copy] - 255
    width = np.array([plans[k][0] for k in which], np.int64)[image[copy]]
    near = _NEAR[np.where(code > 120, 0, code)]
    back = np.where(code > 120, code - 120, np.maximum(1, near[:, 0] + near[:, 1] * width))
    for p, d, k in zip(at[copy].tolist(), back.tolist(), size[copy].tolist(), strict=True):
        if d >= k:
            flat[p : p + k] = flat[p - d : p - d + k]
        else:
            flat[p : p + k] = (flat[p - d : p] * (k // d + 1))[:k]
    for i, k in enumerate(which):
        w, h, palette = plans[k][:3]
        part = flat[begin[i] : begin[i] + w * h]
        if (palette == palette[:, :1]).all():
            grey = np.frombuffer(part.translate(palette[:, 0].tobytes()), np.uint8).reshape(h, w)
            out[k] = np.broadcast_to(grey[..., None], (h, w, 3))
        else:
            out[k] = palette[np.frombuffer(part, np.uint8)].reshape(h, w, 3)
    return out


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW or (0 if text else ROW))


def store(payload: bytes) -> bytes:
    """A payload, a multiple of 192 bytes, as image files one after the other."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return b"".join(encode(samples[k : k + ROWS]) for k in range(0, len(samples), ROWS))


def store_grey(payload: bytes) -> bytes:
    """A payload, a multiple of 192 bytes, as grey image files one after the other."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return b"".join(encode_grey(samples[k : k + GREY_ROWS]) for k in range(0, len(samples), GREY_ROWS))


def files_of(stored: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(stored):
        end = at + 8 + struct.unpack("<I", stored[at + 4 : at + 8])[0]
        out.append(stored[at:end])
        at = end
    return out


def load_many(stored: list[bytes]) -> list[bytes]:
    """Payloads of many stored columns: all samples of images WIDTH wide, one of three of grey ones."""
    files = [files_of(s) for s in stored]
    pixels = iter(decode_many([f for own in files for f in own]))
    return [b"".join((x if x.shape[1] == WIDTH else x[..., 0]).tobytes() for x in islice(pixels, len(own))) for own in files]


def feature(payload: bytes) -> str:
    """Means of the three channels and the Shannon entropy of the samples, in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    means = [int(x[c::3].sum()) * 1000 // (len(x) // 3) for c in range(3)]
    return ":".join(map(str, [*means, round(float(-(p * np.log2(p)).sum()) * 1000)]))


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary), and from the bytes read back: payload, feature. docs: doc_id, text."""
    schema = "doc_id long, n_bytes long, media binary, payload binary, feature string"

    def run(batches):
        for batch in batches:
            for first, last in slices(batch.column(1), 4 << 20):
                texts = [t.encode() for t in batch.column(1).slice(first, last - first).to_pylist()]
                stored = [store_grey(payload_of(t)) for t in texts]
                back = load_many(stored)
                arrays = [batch.column(0).slice(first, last - first), pa.array([len(t) for t in texts], pa.int64()), pa.array(stored, pa.binary()), pa.array(back, pa.binary()), pa.array([feature(p) for p in back], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "media", "payload", "feature"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
