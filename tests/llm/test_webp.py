"""Lossless images: every feature of the format is written here and read back."""

import random

import numpy as np

from sparkweave.llm import webp as w


def _prefix(value):
    """Symbol, extra bits and their number of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _entropy(out, pixels, width, cache_bits=0, repeats=False, meta=False, top=True):
    """Writes pixels (list of ARGB) as an entropy-coded image with one group, or two equal ones."""
    cache, steps, k = [0] * (1 << cache_bits), [], 0
    hashed = lambda p: ((w.MULTIPLIER * p) & 0xFFFFFFFF) >> (32 - cache_bits)
    while k < len(pixels):
        run = 0
        if repeats and k:
            while k + run < len(pixels) and run < 4000 and pixels[k + run] == pixels[k + run - 1]:
                run += 1
        if run > 2:
            steps.append(("back", run))
            new = pixels[k : k + run]
        elif cache_bits and cache[hashed(pixels[k])] == pixels[k]:
            steps.append(("cache", hashed(pixels[k])))
            new = pixels[k : k + 1]
        else:
            steps.append(("pixel", pixels[k]))
            new = pixels[k : k + 1]
        for p in new:
            if cache_bits:
                cache[hashed(p)] = p
        k += len(new)
    counts = [np.zeros(n, np.int64) for n in (280 + (len(cache) if cache_bits else 0), 256, 256, 256, 40)]
    for kind, v in steps:
        if kind == "pixel":
            for c, x in zip((0, 1, 2, 3), (v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24), strict=True):
                counts[c][x] += 1
        elif kind == "back":
            counts[0][256 + _prefix(v)[0]] += 1
            counts[4][_prefix(2)[0]] += 1
        else:
            counts[0][280 + v] += 1
    lengths = [w.code_lengths(c) for c in counts]
    codes = [w._reversed(x) if np.count_nonzero(x) > 1 else None for x in lengths]
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(1 if meta else 0, 1)
        if meta:
            out.put(0, 3)
            blocks = [0xFF000000 | (k % 2) << 8 for k in range(-(-width // 4) * -(-(len(pixels) // width) // 4))]
            _entropy(out, blocks, -(-width // 4), top=False)
    for _ in range(2 if meta and len(pixels) > 16 else 1):
        for x in lengths:
            w.write_code(out, x)
    put = lambda c, s: out.put(int(codes[c][s]), int(lengths[c][s])) if codes[c] is not None else None
    for kind, v in steps:
        if kind == "pixel":
            put(0, v >> 8 & 255), put(1, v >> 16 & 255), put(2, v & 255), put(3, v >> 24)
        elif kind == "back":
            s, extra, n = _prefix(v)
            put(0, 256 + s), out.put(extra, n)
            put(4, _prefix(2)[0])  # distance code 2: the pixel to the left
        else:
            put(0, 280 + v)


def _file(out):
    data = b"\x2f" + out.word.to_bytes(-(-out.have // 8), "little")
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + w.struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + w.struct.pack("<I", len(data)) + data + pad


def _head(width, height, alpha=1):
    out = w.Writer()
    out.put(width - 1, 14), out.put(height - 1, 14), out.put(alpha, 1), out.put(0, 3)
    return out


def _argb(x):
    return [int(v) for v in w._joined(*(x[..., c].astype(np.int64) for c in range(4))).ravel()]


def _picture(seed, height=9, width=11, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        some = rng.integers(0, 256, (colours, 4))
        return some[rng.integers(0, colours, (height, width))].astype(np.uint8)
    x = rng.integers(0, 256, (height, width, 4)).astype(np.uint8)
    x[2:5] = x[2, 0]
    return x


def test_codes_cache_and_back_references():
    for seed, (cache, repeats, meta) in enumerate(((0, False, False), (4, False, False), (0, True, False), (6, True, False), (5, True, True))):
        x = _picture(seed)
        out = _head(11, 9)
        out.put(0, 1)
        _entropy(out, _argb(x), 11, cache, repeats, meta)
        assert (w.decode(_file(out)) == x).all()


def test_transforms():
    x = _picture(3)
    height, width, _ = x.shape
    flat = _argb(x)
    # subtract green, then predictor of each mode: the residual is what the decoder's own prediction leaves
    for mode in range(14):
        out = _head(width, height)
        out.put(1, 1), out.put(0, 2), out.put(0, 3)
        _entropy(out, [0xFF000000 | mode << 8] * (3 * 3), 3, top=False)
        out.put(1, 1), out.put(2, 2), out.put(0, 1)
        rest = []
        for k, p in enumerate(flat):
            y, c = divmod(k, width)
            if not y:
                q = flat[k - 1] if c else 0xFF000000
            elif not c:
                q = flat[k - width]
            else:
                q = w.predicted(mode, flat[k - 1], flat[k - width], flat[k - width + 1], flat[k - width - 1])
            a, r, g, b = (u - v & 255 for u, v in zip(w._channels(p), w._channels(q), strict=True))
            rest.append(w._joined(a, r - g, g, b - g))
        _entropy(out, rest, width)
        assert (w.decode(_file(out)) == x).all(), mode
    # cross colour with constant multipliers
    out = _head(width, height)
    out.put(1, 1), out.put(1, 2), out.put(0, 3)
    multipliers = (200, 17, 90)  # red to blue, green to blue, green to red
    _entropy(out, [0xFF000000 | multipliers[0] << 16 | multipliers[1] << 8 | multipliers[2]] * 9, 3, top=False)
    out.put(0, 1)
    signed = lambda v: v - 256 if v > 127 else v
    rest = []
    for p in flat:
        a, r, g, b = w._channels(p)
        blue = b - (signed(multipliers[1]) * signed(g) >> 5) - (signed(multipliers[0]) * signed(r) >> 5)
        rest.append(w._joined(a, r - (signed(multipliers[2]) * signed(g) >> 5), g, blue))
    _entropy(out, rest, width)
    assert (w.decode(_file(out)) == x).all()


def test_palettes():
    for colours in (2, 3, 13, 60):
        x = _picture(colours, colours=colours)
        flat = _argb(x)
        table = sorted(set(flat))
        pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        out = _head(11, 9)
        out.put(1, 1), out.put(3, 2), out.put(len(table) - 1, 8)
        steps = [table[0]] + [w._joined(*(u - v for u, v in zip(w._channels(b), w._channels(a), strict=True))) for a, b in zip(table[:-1], table[1:], strict=True)]
        _entropy(out, steps, len(table), top=False)
        out.put(0, 1)
        packed = []
        for y in range(9):
            row = [table.index(p) for p in flat[11 * y : 11 * y + 11]]
            for k in range(0, 11, 1 << pack):
                packed.append(0xFF000000 | sum(v << (j * (8 >> pack)) for j, v in enumerate(row[k : k + (1 << pack)])) << 8)
        _entropy(out, packed, -(-11 // (1 << pack)))
        assert (w.decode(_file(out)) == x).all()


def test_payloads_side_by_side():
    rng = random.Random(4)
    texts = [b"", b" ", b"a", b"ab" * 96, bytes(range(256)) * 3, rng.randbytes(70_000), b"x" * 40_000] + [rng.choice([b"hello ", rng.randbytes(3)]) * rng.randint(0, 200) for _ in range(40)]
    payloads = [w.payload_of(t) for t in texts]
    stored = [w.store(p) for p in payloads]
    assert w.load_many(stored) == payloads
    assert [b"".join(w.decode(f)[..., 1:].tobytes() for f in w.files_of(s)) for s in stored] == payloads


def test_skewed_histogram_stays_within_fifteen_bits():
    counts = np.array([1, 1] + [2**k for k in range(1, 30)])
    lengths = w.code_lengths(counts)
    assert lengths.max() <= 15 and sum(2.0**-n for n in lengths) == 1


def test_column(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "é" * 500, "x"), (4, "é" * 500, None)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in w.media(df).collect()}
    assert got[1].payload == got[2].payload == b" " * 192 and got[1].n_bytes == 0
    assert bytes(got[3].payload).rstrip(b" ").decode() == "é" * 500
    assert got[3].media == got[4].media and got[3].feature == got[4].feature
    assert w.media(df.limit(0)).count() == 0


def test_grey_files_use_palette_and_references_and_both_decoders_agree():
    rng = np.random.default_rng(5)
    text = b"the same licence text in every file, with a few words of its own. "
    shapes = [(1, 192), (32, 192), (3, 64), (1, 1), (1, 5)]
    samples = [np.full(n, v, np.uint8) for n in (192,) for v in (0, 1, 32, 239, 240, 255)]
    samples += [np.frombuffer((text * 200)[: 32 * 192], np.uint8), np.arange(192, dtype=np.uint8), rng.integers(0, 256, 6144, dtype=np.uint8)]
    samples += [np.tile(rng.integers(1, 4, 7, dtype=np.uint8), 900)[:6144], rng.integers(1, 20, 3 * 64, dtype=np.uint8)]
    greys = [x.reshape(-1, 192) for x in samples] + [rng.integers(90, 120, s, dtype=np.uint8) for s in shapes]
    files = [w.encode_grey(g) for g in greys]
    assert all(w._plan(f) is not None for f in files)
    for grey, data, many in zip(greys, files, w.decode_many(files), strict=True):
        assert (w.decode(data)[..., 1:] == grey[..., None]).all() and (many == grey[..., None]).all()
    assert len(files[6]) < 400  # 6,144 bytes, nearly all of them references
    places, backs, sizes = w._copies(greys[6].ravel())
    assert len(places) and sizes.max() <= w.LONG and (places[1:] >= (places + sizes)[:-1]).all()
    for p, d, k in zip(places, backs, sizes, strict=True):
        assert all(greys[6].ravel()[p + j] == greys[6].ravel()[p + j - d] for j in range(k))


def test_payloads_as_grey_images():
    rng = random.Random(8)
    payloads = [w.payload_of(t) for t in (b"", b"a", b"ab" * 96, bytes(range(256)) * 3, rng.randbytes(20_000), b"x" * 40_000, "été 你好 ".encode() * 900)]
    stored = [w.store_grey(p) for p in payloads]
    assert w.load_many([*stored, w.store(payloads[3])]) == [*payloads, payloads[3]]
    assert [b"".join(w.decode(f)[..., 1].tobytes() for f in w.files_of(s)) for s in stored] == payloads
    assert w.store_grey(payloads[4]) == stored[4]


def test_files_of_other_forms_are_read_with_them():
    rng = np.random.default_rng(6)
    rgb = rng.integers(0, 256, (5, 9, 3), dtype=np.uint8)
    grey = rng.integers(60, 99, (2, 192), dtype=np.uint8)
    back = w.decode_many([w.encode(rgb), w.encode_grey(grey), w.encode(rgb)])
    assert (back[0] == rgb).all() and (back[1][..., 1] == grey).all() and (back[2] == rgb).all()
    assert w.decode_many([]) == []


def test_heads_of_like_files_are_made_once():
    w._head.cache_clear()
    texts = [(f"some words of text number {k} " * 40).encode() for k in range(20)]
    stored = [w.store_grey(w.payload_of(t)) for t in texts]
    assert w.load_many(stored) == [w.payload_of(t) for t in texts]
    assert w._head.cache_info().misses < 20 <= w._head.cache_info().hits + w._head.cache_info().misses
