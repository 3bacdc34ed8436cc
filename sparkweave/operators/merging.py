"""Joins, sets and index arithmetic over feature tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_all(frames: list[DataFrame], key: str, how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, how), frames)


def side_by_side(one: DataFrame, two: DataFrame, key: str, suffixes: tuple[str, str] = ("_ctrl", "_treat")) -> DataFrame:
    """Full outer join; the other columns take the suffix of their side."""
    named = [df.select(key, *[F.col(c).alias(c + s) for c in df.columns if c != key]) for df, s in zip((one, two), suffixes, strict=True)]
    return named[0].join(named[1], key, "full")


def positional(arrays: DataFrame, array: str, rows: DataFrame, order: str) -> DataFrame:
    """Element i of each array beside row i (in `order`) of a table of samples; lengths must agree.

    rows: one for each sample, a table that a driver holds; numbered by sorting it.
    """
    names = [r[0] for r in rows.select(order).orderBy(order).collect()]
    bad = arrays.where(F.size(array) != len(names)).limit(1).count()
    if bad:
        raise ValueError(f"{array} and the table of samples differ in length")
    place = rows.join(F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(names)), f"__pos int, {order} {rows.schema[order].dataType.simpleString()}")), order)
    long = arrays.select(*[c for c in arrays.columns if c != array], F.posexplode(array).alias("__pos", "value"))
    return long.join(F.broadcast(place), "__pos").drop("__pos")


def index_mismatches(one: DataFrame, two: DataFrame, keys: list[str], by: str) -> DataFrame:
    """by and the number of keys that only one of two tables has: 0 everywhere means that stored indices agree."""
    a, b = one.select(*keys).distinct().withColumn("__a", F.lit(1)), two.select(*keys).distinct().withColumn("__b", F.lit(1))
    return a.join(b, keys, "full").groupBy(by).agg(F.sum((F.col("__a").isNull() | F.col("__b").isNull()).cast("long")).alias("mismatches"))


def lookup_first(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left rows with the first matching right row by `order`; unmatched ones keep nulls."""
    from .rules import first_of

    return left.join(first_of(right, [key], order), key, "left")


def members_of(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Rows whose column is among names (name), without regard to case."""
    return df.join(names.select(F.upper("name").alias("__u")).distinct(), F.upper(F.col(column)) == F.col("__u"), "left_semi")


def square(edges: DataFrame, nodes: DataFrame, weight: str = "r", diagonal: float = 1.0) -> DataFrame:
    """row, col, value: both directions of each edge and the diagonal, the long form of the full matrix."""
    one = edges.select(F.col("gene_i").alias("row"), F.col("gene_j").alias("col"), F.col(weight).alias("value"))
    return one.union(one.select("col", "row", "value")).union(nodes.select("gene", "gene", F.lit(diagonal)))


def upper(matrix: DataFrame) -> DataFrame:
    """key, gene_i, gene_j, value of the upper triangle of a full matrix (row, col, value); key joins the two names."""
    low, high = F.least("row", "col"), F.greatest("row", "col")
    return matrix.where("row < col").select(F.concat_ws("_", low.cast("string"), high.cast("string")).alias("key"), low.alias("gene_i"), high.alias("gene_j"), "value")


def triangle_index(i: Column, j: Column, n: int) -> Column:
    """Place of the pair i < j (from 0) in the flat upper triangle of n rows."""
    return i * n - F.floor(i * (i + 1) / 2) + (j - i - 1)


def triangle_pair(k: Column, n: int) -> tuple[Column, Column]:
    """(i, j) of a place in the flat triangle; the root is corrected by one either way, so it is exact for whole numbers."""
    guess = F.floor((2 * n - 1 - F.sqrt((2.0 * n - 1) * (2.0 * n - 1) - 8.0 * k)) / 2).cast("long")
    start = lambda i: i * n - F.floor(i * (i + 1) / 2)
    i = F.when(start(guess) > k, guess - 1).when(start(guess + 1) <= k, guess + 1).otherwise(guess)
    return i, k - start(i) + i + 1


def stacked(frames: dict[str, DataFrame], name: str = "source") -> DataFrame:
    """Rows of all frames with their name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in frames.items()])
