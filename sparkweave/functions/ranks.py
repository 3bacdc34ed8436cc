"""Ranks, robust spread and seeded arithmetic hashes as column expressions."""

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def average_rank(value: str, *by: str, descending: bool = False) -> Column:
    """Rank with ties averaged; null values rank null and count for nothing."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    ties = F.count("*").over(W.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(W.partitionBy(*by).orderBy(order)) + (ties - 1) / 2)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation; null where either side has no spread (the built-in one fails there in ANSI mode)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def z_score(value: Column | str, *by: str) -> Column:
    """(x - mean) / sd with n - 1; null if the spread is 0."""
    v = F.col(value) if isinstance(value, str) else value
    w = W.partitionBy(*by)
    sd = F.stddev_samp(v).over(w)
    return F.when(sd > 0, (v - F.avg(v).over(w)) / sd)


def mad(values: Column) -> Column:
    """Scaled median absolute deviation of an array of numbers."""
    def median(a):
        s = F.array_sort(a)
        n = F.size(s)
        low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
        return (low + high) / 2

    middle = median(values)
    return MAD_SCALE * median(F.transform(values, lambda x: F.abs(x - middle)))


def drawn(seed: int, *keys: Column) -> Column:
    """Whole number below 2**31 - 1 from integer keys: plain arithmetic, so that any engine can repeat it.

    The square keeps orders by this number from being rotations of each other.
    """
    h = F.lit(seed % 2147483647).cast("long")
    for k in keys:
        h = (h * 48271 + k.cast("long") * 16807 + 12345) % 2147483647
        h = (h * h + h * 69621) % 2147483647
    return h


def drawn_sql(seed: int, *keys: str) -> str:
    """drawn() as SQL text."""
    h = f"({seed % 2147483647})::BIGINT"
    for k in keys:
        h = f"(({h} * 48271 + ({k})::BIGINT * 16807 + 12345) % 2147483647)"
        h = f"(({h} * {h} + {h} * 69621) % 2147483647)"
    return f"({h})"
