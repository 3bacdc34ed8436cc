"""All-pairs correlation in blocks, focus rows, and listed pairs.

Features are dealt into blocks of bounded size; each pair of blocks is one group of two blocks at most, whose
correlations are one matrix product. Nothing is broadcast, and a task's memory is set by the block size alone.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.ranks import average_rank

BLOCK, MOST, STRIP = 512, 8192, 512  # fewest and most features in a block, rows of a block at a time
LARGE, ROWS, COLUMNS = 32768, 256, 2048  # most features in a block whose pairs are mostly left out; rows and columns of a product that fits the processor's cache


def rank_vectors(long: DataFrame, gene: str = "gene", sample: str = "sample", value: str = "value") -> DataFrame:
    """gene, z: z-scored average ranks in sample order. Features with nulls or without spread have null z."""
    ranked = long.withColumn("__r", average_rank(value, gene))
    packed = ranked.groupBy(gene).agg(F.array_sort(F.collect_list(F.struct(sample, "__r"))).alias("__a"), F.count("*").alias("__n"), F.count("__r").alias("__k"), F.avg("__r").alias("__m"), F.stddev_samp("__r").alias("__s"))
    good = (F.col("__n") == F.col("__k")) & (F.col("__s") > 0)
    z = F.transform("__a", lambda x: (x["__r"] - F.col("__m")) / F.col("__s"))
    return packed.select(F.col(gene).alias("gene"), F.when(good, z).alias("z"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def block_size(count: int) -> int:
    """Features in a block: 16 blocks while they stay between BLOCK and MOST, so that copies of a feature do not grow with their number."""
    return min(MOST, max(BLOCK, -(-count // 16)))


def jobs(vectors: DataFrame, work, schema: str, block: int | None = None) -> DataFrame:
    """work(r, i, j, more_i, more_j, same) of every two blocks, in strips of rows, as rows of a schema.

    vectors: gene, z and any numbers; i, j are the features of a strip's rows and columns, more_i and more_j dictionaries of
    their other columns. Each pair of features comes once, or, if both sides are one block (same), in both orders and with itself.
    """
    vectors = vectors.where("z is not null")
    count = vectors.count()
    blocks = max(1, -(-count // (block or block_size(count))))
    keyed = vectors.withColumn("b", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int"))
    more = [c for c in vectors.columns if c not in ("gene", "z")]
    dealt = keyed.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("gene", "z", *more, "b", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"))
    fields = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}

    def run(key, table):
        lo, hi = (k.as_py() for k in key)
        parts = []
        ids, b = table.column("gene").to_numpy(), table.column("b").to_numpy()
        one, two = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        if len(one) and len(two):
            z = table.column("z").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            rest = {c: table.column(c).to_numpy() for c in more}
            right, scale = np.ascontiguousarray(z[two].T), z.shape[1] - 1
            for k in range(0, len(one), STRIP):
                at = one[k : k + STRIP]
                parts.append(work(z[at] @ right / scale, ids[at], ids[two], {c: x[at] for c, x in rest.items()}, {c: x[two] for c, x in rest.items()}, lo == hi))
        joined = [pa.concat_arrays([pa.array(p[k], kinds[t]) if not isinstance(p[k], pa.Array) else p[k] for p in parts]) if parts else pa.array([], kinds[t]) for k, (_, t) in enumerate(fields)]
        return pa.Table.from_arrays(joined, names=[n for n, _ in fields])

    return dealt.groupBy("lo", "hi").applyInArrow(run, schema)


class Ranked(NamedTuple):
    """Rows of vectors: rank vectors as whole numbers x (twice the centred ranks) with their sums of squares, other ones as they are."""

    x: np.ndarray
    norm: np.ndarray | None

    def take(self, at) -> "Ranked":
        return Ranked(np.ascontiguousarray(self.x[at]), None if self.norm is None else self.norm[at])


def _whole(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the centred average ranks of each row, and which rows are z-scores of them."""
    n = z.shape[1]
    order = np.argsort(z, axis=1, kind="stable")
    s = np.take_along_axis(z, order, axis=1)
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] - s[:, :-1] > 1e-9
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    last = np.minimum.accumulate(np.where(np.concatenate([new[:, 1:], np.ones((len(z), 1), bool)], axis=1), at, n - 1)[:, ::-1], axis=1)[:, ::-1]
    x = np.empty(s.shape, np.int16)
    np.put_along_axis(x, order, (first + last + 1 - n).astype(np.int16), axis=1)
    norm = (x.astype(float) ** 2).sum(axis=1)
    scaled = x * np.sqrt((n - 1) / np.where(norm > 0, norm, 1))[:, None]
    return x, (norm > 0) & (np.abs(scaled - z).max(axis=1) < 1e-9)


def packed(vectors: DataFrame) -> DataFrame:
    """vectors with q, the whole ranks as 16-bit numbers, in the place of z where z are z-scored ranks; z is null there."""
    rest = [c for c in vectors.columns if c != "z"]
    schema = T.StructType([*[vectors.schema[c] for c in rest], T.StructField("q", T.BinaryType()), T.StructField("z", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("z")
            z = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x, good = _whole(z) if z.shape[1] <= 4096 else (np.zeros((len(z), 1), np.int16), np.zeros(len(z), bool))
            data = [row.tobytes() if on else None for row, on in zip(x, good, strict=True)]
            left = pa.nulls(len(z), column.type) if good.all() else pa.array([None if on else row for row, on in zip(z, good, strict=True)], column.type)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(data, pa.binary()), left], names=[*rest, "q", "z"])

    return vectors.select(*rest, "z").mapInArrow(run, schema)


def unpacked(table: pa.Table) -> Ranked:
    """The rows of a table of packed vectors."""
    q, z = table.column("q").combine_chunks(), table.column("z").combine_chunks()
    if q.null_count == 0 and len(q):
        x = np.frombuffer(b"".join(q.to_pylist()), np.int16).reshape(len(q), -1)
        n = x.shape[1]
        kind = np.float32 if n * (n * n - 1) // 3 < 2**24 else np.float64  # in which sums of products are exact
        x = x.astype(kind)
        return Ranked(x, np.einsum("ij,ij->i", x, x, dtype=np.float64))
    rows = []
    for a, b in zip(q.to_pylist(), z.to_pylist(), strict=True):
        if a is not None:
            a = np.frombuffer(a, np.int16).astype(float)
            b = a * np.sqrt((len(a) - 1) / (a @ a))
        rows.append(np.array(b, dtype=float))
    return Ranked(np.array(rows).reshape(len(rows), -1), None)


def links(one: Ranked, two: Ranked, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of one, row of two and r of the pairs with |r| >= least, in the order of the rows of one.

    Products of whole ranks are exact, so r is a quotient of whole numbers whatever the order of the sums.
    """
    found, n = [], one.x.shape[1]
    for k in range(0, len(one.x), ROWS):
        a = one.x[k : k + ROWS]
        if one.norm is not None:
            root = np.sqrt(one.norm[k : k + ROWS])[:, None] * ((least - 1e-6) * 0.999999)
        parts = []
        for m in range(0, len(two.x), COLUMNS):
            b = two.x[m : m + COLUMNS]
            dot = a @ b.T
            if one.norm is None:
                at = np.flatnonzero(np.abs(dot) >= (least - 1e-9) * (n - 1))
                i, j = np.divmod(at, len(b))
                r = dot.ravel()[at] / (n - 1)
            else:
                at = np.flatnonzero(np.abs(dot) >= (root * np.sqrt(two.norm[m : m + COLUMNS].min())).astype(dot.dtype))
                i, j = np.divmod(at, len(b))
                r = dot.ravel()[at] / np.sqrt(one.norm[k + i] * two.norm[m + j])
            ok = np.abs(r) >= least
            parts.append((i[ok] + k, j[ok] + m, np.clip(r[ok], -1, 1)))
        i, j, r = (np.concatenate(c) for c in zip(*parts, strict=True))
        found.append((i, j, r))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def linked_sums(vectors: DataFrame, least: float, terms, names: list[str], block: int | None = None) -> DataFrame:
    """gene and, over all features with |r| >= least, the sums of terms(r, mine, other), as doubles.

    mine and other are dictionaries of the vectors' other columns at both ends of the pairs; terms gives an array for each name.
    A pair of blocks gives a row for each of its features. vectors may be packed already.
    """
    if "q" not in vectors.columns:
        vectors = packed(vectors.where("z is not null"))
    count = vectors.select("gene").count()
    blocks = max(1, -(-count // (block or min(LARGE, max(BLOCK, -(-count // 16))))))
    keyed = vectors.withColumn("b", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int"))
    more = [c for c in vectors.columns if c not in ("gene", "q", "z")]
    dealt = keyed.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("gene", "q", "z", *more, "b", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"))

    def run(key, table):
        lo, hi = (k.as_py() for k in key)
        ids, b = table.column("gene").to_numpy(), table.column("b").to_numpy()
        rest, every = {c: table.column(c).to_numpy() for c in more}, unpacked(table)
        sums = np.zeros((len(names), len(ids)))
        one, two = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        right = every.take(two)
        for k in range(0, len(one) if len(two) else 0, ROWS):
            at = one[k : k + ROWS]
            i, j, r = links(every.take(at), right, least)
            i, j = at[i], two[j]
            if lo == hi:
                i, j, r = (c[i != j] for c in (i, j, r))
            for mine, other in ((i, j),) if lo == hi else ((i, j), (j, i)):
                parts = terms(r, {c: x[mine] for c, x in rest.items()}, {c: x[other] for c, x in rest.items()})
                for total, part in zip(sums, parts, strict=True):
                    total += np.bincount(mine, weights=part, minlength=len(ids))
        return pa.table([pa.array(ids), *[pa.array(x) for x in sums]], names=["gene", *names])

    got = dealt.groupBy("lo", "hi").applyInArrow(run, ", ".join(["gene long", *[f"{c} double" for c in names]]))
    return got.groupBy("gene").agg(*[F.sum(c).alias(c) for c in names])


def all_pairs(vectors: DataFrame, block: int | None = None, least: float | None = None) -> DataFrame:
    """gene_i < gene_j, r for every pair of features with vectors (gene long, z array<double>), or those with |r| >= least.

    Pairs below `least` never leave the block in which they are computed.
    """

    def work(r, i, j, more_i, more_j, same):
        on = np.ones(r.shape, bool) if least is None else np.abs(r) >= least
        if same:
            on &= i[:, None] < j[None, :]
        a, b = np.nonzero(on)
        x, y = i[a], j[b]
        return np.minimum(x, y), np.maximum(x, y), np.clip(r[a, b], -1, 1)

    return jobs(vectors.select("gene", "z"), work, "gene_i long, gene_j long, r double", block)


def all_pairs_of_two(vectors: DataFrame, measure, columns: str, block: int = BLOCK) -> DataFrame:
    """gene_i < gene_j and what `measure` makes of the pair's two correlations; vectors: gene long, z and z2.

    Both correlations of a pair come from the same group of blocks, so no table of pairs is ever joined. measure takes
    and returns arrays (as many as `columns` names); ids come back to the order gene_i < gene_j.
    """
    count = vectors.count()
    blocks = max(1, -(-count // block))
    keyed = vectors.withColumn("b", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int"))
    dealt = keyed.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("gene", "z", "z2", "b", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(key, table):
        lo, hi = (k.as_py() for k in key)
        ids, b = table.column("gene").to_numpy(), table.column("b").to_numpy()
        one, two = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        i, j = np.broadcast_arrays(ids[one][:, None], ids[two][None, :])
        pick = i < j if lo == hi else np.ones(i.shape, bool)
        got = []
        for c in ("z", "z2"):
            z = table.column(c).combine_chunks()
            z = z.flatten().to_numpy().reshape(len(ids), -1)
            got.append(np.clip(z[one] @ z[two].T / (z.shape[1] - 1), -1, 1)[pick])
        i, j = i[pick], j[pick]
        arrays = [pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), *map(pa.array, measure(*got))]
        return pa.Table.from_arrays(arrays, names=["gene_i", "gene_j", *names])

    return dealt.groupBy("lo", "hi").applyInArrow(run, f"gene_i long, gene_j long, {columns}")


def focus_row(vectors: DataFrame, focus: int) -> DataFrame:
    """gene, r with one feature; its single row is broadcast."""
    one = vectors.where(F.col("gene") == focus).select(F.col("z").alias("__f"))
    return vectors.where(F.col("gene") != focus).crossJoin(F.broadcast(one)).select("gene", (dot(F.col("z"), F.col("__f")) / (F.size("z") - 1)).alias("r"))


def listed(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """edges (gene_i, gene_j, ...) with r, computed for these pairs only; keys of vectors that edges share join as well."""
    keys = [c for c in vectors.columns if c not in ("gene", "z")]
    left = vectors.select(*keys, F.col("gene").alias("gene_i"), F.col("z").alias("__x"))
    right = vectors.select(*keys, F.col("gene").alias("gene_j"), F.col("z").alias("__y"))
    shared = [k for k in keys if k in edges.columns]
    both = edges.join(left, [*shared, "gene_i"]).join(right, [*keys, "gene_j"])
    return both.withColumn("r", dot(F.col("__x"), F.col("__y")) / (F.size("__x") - 1)).drop("__x", "__y")
