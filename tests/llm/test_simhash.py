"""SimHash classes against all pairs of plain fingerprints."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkweave.llm import simhash
from sparkweave.llm.tables import Scratch

SCHEMA = "doc_id long, text string, mark string, root int, component_id string"


def plain_mark(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(marks):
    root = {m: m for m in marks}

    def top(m):
        while root[m] != m:
            m = root[m]
        return m

    marks = sorted(root)
    for i, a in enumerate(marks):
        for b in marks[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {m: top(m) for m in marks}


def plain(rows):
    marks = [plain_mark(t) for _, t in rows]
    root, least = plain_roots(set(marks)), {}
    for (i, _), m in zip(rows, marks, strict=True):
        if i is not None:
            least[root[m]] = min(least.get(root[m], i), i)
    return sorted(((i, f"{m:016x}", least.get(root[m])) for (i, _), m in zip(rows, marks, strict=True)), key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    got = simhash.classes(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_texts(spark):
    rng = random.Random(3)
    words = ["Wort", "and", "été", "x y", "ÄRGER", "zwölf", "\x1cq", "lorem"] + [f"w{i}" for i in range(200)]
    base = [rng.choices(words, k=rng.choice([1, 2, 3, 40, 200, 1500])) for _ in range(60)]
    rows = []
    for i in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i * 7 % 1000, rng.choice([" ", "\n", "\t \r"]).join(w)))
    rows += [(5, ""), (6, None), (None, " \x0b\x0c "), (None, "only here once"), (7, "A B"), (7, "a b"), (9, "a b"), (10, " ".join(words * 200))]
    check(spark, rows)


def test_null_ids_and_empty(spark):
    check(spark, [])
    check(spark, [(None, "one two three four"), (None, "ONE two three four"), (4, None)])


@pytest.mark.parametrize("spread", [2, 6, 12])
def test_links_of_fingerprints(spark, spread):
    """Dense groups, chains and far strangers: components as of all pairs."""
    rng = random.Random(spread)
    marks = {0, (1 << 64) - 1, 1 << 63, 7, 15, 0x100000000}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            m = centre
            for b in rng.sample(range(64), rng.randint(0, spread)):
                m ^= 1 << b
            marks.add(m)
    m = rng.getrandbits(64)
    for _ in range(40):  # a chain of steps of three bits
        marks.add(m)
        for b in rng.sample(range(64), 3):
            m ^= 1 << b
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(m),) for m in marks], "mark long")
    got = {r.mark: r.root for r in simhash.linked(df, Scratch(spark, "test")).collect()}
    want = plain_roots(marks)
    groups, expected = {}, {}
    for m in marks:
        groups.setdefault(got.get(signed(m), signed(m)), set()).add(m)
        expected.setdefault(want[m], set()).add(m)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_linked_fingerprints_share_a_key(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for x in rng.sample(range(64), 3):
            b ^= 1 << x
        pairs.append((a - (1 << 63), b - (1 << 63)))
    df = spark.createDataFrame(pairs, "a long, b long")
    shared = F.array_intersect(simhash._keys(F.col("a")), simhash._keys(F.col("b")))
    pieces = F.exists(shared, lambda k: F.arrays_overlap(simhash._pieces(k, F.col("a")), simhash._pieces(k, F.col("b"))))
    assert df.where(pieces).count() == len(pairs)
