"""Centroid clustering against a plain version with Python integers."""

import hashlib
import math
import random

from sparkweave.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, key string, cluster string, n int"


def plain(rows, k, rounds, dims, scale=1024):
    kept = [(i, tuple(math.floor(x * scale) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:k]
    now = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        of = [[] for _ in now]
        for _, v in kept:
            of[near(v)[1]].append(v)
        now = [tuple(sum(x) // len(vs) for x in zip(*vs, strict=True)) if vs else c for c, vs in zip(now, of, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    each = [sum(d for _, c, d in out if c == j) for j in range(len(now))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    top = centroids.TOP
    return sorted(((i, c, min(top, d), min(top, each[c]), min(top, sum(each)), sha[c]) for i, c, d in out), key=str)


def check(spark, rows, k=3, rounds=10, dims=4):
    df = spark.createDataFrame([(i, v, "a", "b", 1) for i, v in rows], SCHEMA)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]  # as floats of 32 bits
    got = centroids.cluster(df, k=k, rounds=rounds, dims=dims)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == plain(rows, k, rounds, dims)
    return got


def test_against_plain_integers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(m := rng.choice([-1, 0, 2]), 0.3), rng.gauss(m, 0.3), rng.random(), -rng.random()]) for i in range(300)]
    rows += [(1000 + i, [0.25, 0.5, -0.125, 0.0]) for i in range(400)]  # one vector of many copies
    rows += [(0, [1.0, 1.0, 1.0, 1.0]), (0, [1.0, 1.0, 1.0, 1.0]), (None, [0.1, 0.2, 0.3, 0.4])]  # repeated and null ids
    got = check(spark, rows, k=8)
    assert got.where("n_copies = 400").count() == 400
    check(spark, rows, k=3, rounds=1)


def test_what_is_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 3.0, 4.0, 5.0]), (5, [1.0, None, 0.0, 0.0]), (6, [nan, 0.0, 0.0, 0.0]), (7, [0.0, -inf, 0.0, 0.0])]
    assert check(spark, rows).count() == 0
    assert check(spark, []).count() == 0
    assert check(spark, [*rows, (8, [0.5, 0.5, 0.5, 0.5])]).count() == 1


def test_ties_empty_centroids_and_wide_values(spark):
    # equal first centroids: the smaller number takes all, the other stays as it is
    check(spark, [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(5)] + [(9, [0.0, 0.0, 0.0, 0.0])], k=4)
    # a vector in the middle of two
    check(spark, [(1, [0.0] * 4), (2, [2.0] * 4), (3, [1.0] * 4), (4, [-1e-9] * 4)], k=2, rounds=0)
    # beyond 16 bits, beyond what doubles hold, and beyond a long's squares
    check(spark, [(1, [40.0, 0.0, 0.0, 0.0]), (2, [1e5, -1e5, 3.0, 0.0]), (3, [1e9, 0.0, 0.0, -1e9]), (4, [1e14, 1.0, 1.0, 1.0]), (5, [0.0] * 4)], k=3)
