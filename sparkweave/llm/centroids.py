"""Centroid clustering of quantised vectors: Lloyd's rounds over distinct vectors with multiplicities.

A vector of exactly `dims` components, none null or non-finite, becomes integers floor(scale * x). Equal integer vectors
are one row with the number of their copies, so a vector that a third of the table repeats costs as much as any other.
The first centroids are the vectors of smallest sha256 of "<seed>:<id>". Each round assigns every distinct vector to the
nearest centroid (squared distance, ties to the smaller number) and replaces each centroid that has vectors by the floor
of their weighted mean, all in exact integers; the driver gets one row for each centroid and component. At the end the
assignments of the distinct vectors are joined back to the ids.

Left out: vectors that are null, of another length, with a null or non-finite component, or with a component beyond
2**62 after scaling. A null id is kept as an id; its hash is that of "<seed>:". Repeated ids are rows of their own;
equal hashes stand in the order of the vectors' bytes. With fewer vectors than k there are as many centroids as vectors;
an empty table gives no rows. Distances over 2**63 - 1 are given as that. Other columns are not read.
"""

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch

TOP = (1 << 63) - 1
EXACT = 1 << 22  # below it, squared distances of up to 512 components are exact as doubles
_KINDS = ((2, "<i2"), (4, "<i4"), (8, "<i8"))


def _quantised(dims: int, scale: int):
    def run(batches):
        for batch in batches:
            column = batch.column(1)
            rows = np.flatnonzero((column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims))
            flat = column.take(pa.array(rows)).flatten()
            value = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null becomes NaN
            with np.errstate(over="ignore", invalid="ignore"):
                value = np.floor(value * scale)
                good = (np.abs(value) < float(1 << 62)).all(axis=1)
            value = value[good].astype(np.int64)
            yield pa.record_batch([batch.column(0).take(pa.array(rows[good])), pa.array(_packed(value), pa.binary())], ["id", "key"])

    return run


def _packed(value: np.ndarray) -> list[bytes]:
    """Each row's bytes, little-endian, at the smallest width that holds all its components; equal rows, equal bytes."""
    out: list = [None] * len(value)
    least, most = value.min(axis=1, initial=0), value.max(axis=1, initial=0)
    left = np.ones(len(value), bool)
    for width, kind in _KINDS:
        end = 1 << (8 * width - 1)
        fits = np.flatnonzero(left & (least >= -end) & (most <= end - 1))
        left[fits] = False
        for i, row in zip(fits, value[fits].astype(kind), strict=True):
            out[i] = row.tobytes()
    return out


def _unpacked(keys: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(keys), dims), np.int64)
    for width, kind in _KINDS:
        rows = [i for i, k in enumerate(keys) if len(k) == width * dims]
        if rows:
            out[rows] = np.frombuffer(b"".join([keys[i] for i in rows]), kind).reshape(-1, dims)
    return out


def _nearest(value: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and the exact squared distance (object integers if it may be large)."""
    if max(int(np.abs(value).max(initial=0)), int(np.abs(centroids).max(initial=0))) < EXACT and value.shape[1] <= 512:
        v, c = value.astype(float), centroids.astype(float)
        apart = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
        near = apart.argmin(axis=1)
        return near, apart[np.arange(len(near)), near].astype(np.int64)
    v, c = value.astype(object), centroids.astype(object)
    apart = np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1)
    near = np.array([min(range(len(c)), key=row.__getitem__) for row in apart], dtype=np.int64)
    return near, apart[np.arange(len(near)), near]


def _sums(centroids: np.ndarray):
    """cluster, part, total: sums of the components of a task's vectors by cluster; the part after them is their number."""
    k, dims = centroids.shape

    def run(batches):
        total = np.zeros((k, dims + 1), dtype=object)
        for batch in batches:
            value, n = _unpacked(batch.column(0).to_pylist(), dims), batch.column(1).to_numpy()
            near, _ = _nearest(value, centroids)
            small = int(np.abs(value).max(initial=0)) * int(n.sum()) < 1 << 62
            value, n = (value, n) if small else (value.astype(object), n.astype(object))
            for c in np.unique(near):
                mine = near == c
                total[c, :dims] += (value[mine] * n[mine][:, None]).sum(axis=0).astype(object)
                total[c, dims] += int(n[mine].sum())
        rows = [(c, i, Decimal(int(total[c, i]))) for c in range(k) if total[c, dims] for i in range(dims + 1)]
        c, i, t = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(t, pa.decimal128(38, 0))], ["cluster", "part", "total"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            near, apart = _nearest(_unpacked(batch.column(0).to_pylist(), centroids.shape[1]), centroids)
            apart = np.array([min(TOP, int(x)) for x in apart], np.int64) if apart.dtype == object else apart
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(apart)], ["key", "n", "cluster", "distance"])

    return run


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64, scale: int = 1024, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """ident, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_copies of every vector that is kept."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "centroids")
    kind = df.schema[ident].dataType.simpleString()
    ids = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    ids = scratch.put(ids.mapInArrow(_quantised(dims, scale), f"id {kind}, key binary"), "ids")
    distinct = scratch.put(ids.groupBy("key").agg(F.count("*").alias("n")), "distinct")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [bytes(r.key) for r in ids.select(start.alias("h"), "key").orderBy("h", "key").limit(k).collect()]  # k rows
    out = f"{ident} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_copies long"
    if not first:
        return spark.createDataFrame([], out)
    now = _unpacked(first, dims)
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(now), "cluster int, part int, total decimal(38,0)").groupBy("cluster", "part").agg(F.sum("total").alias("total"))
        total = {(r.cluster, r.part): int(r.total) for r in sums.collect()}  # at most k * (dims + 1) rows
        following = np.array([[total[c, i] // total[c, dims] for i in range(dims)] if (c, dims) in total else now[c] for c in range(len(now))], np.int64)
        if (following == now).all():  # later rounds would change nothing
            break
        now = following
    found = scratch.put(distinct.mapInArrow(_assigned(now), "key binary, n long, cluster int, distance long"), "assigned")
    each = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).alias("total")).collect()}
    facts = [(c, min(TOP, t), min(TOP, sum(each.values())), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for c, t in each.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    # a hot vector stands on one row of the right side and on many of the left, which adaptive execution splits
    joined = ids.join(found, "key").join(F.broadcast(facts), "cluster")
    return joined.select(F.col("id").alias(ident), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", F.col("n").alias("n_copies"))
