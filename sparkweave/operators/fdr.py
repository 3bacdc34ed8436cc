"""False-discovery control over any number of rows without a single-task window."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 1024  # of equal width over [1 / CELLS, 1]; below, each halving has FINE cells, so that small p spread as well
FINE = 16


def benjamini_hochberg(df: DataFrame, p: str, q: str, *by: str, total: str | None = None) -> DataFrame:
    """df with q values; null p stay null and do not count. total: a column with the number of tests, where df has the
    rows of smallest p only; q below that of the rows left out is then as over all rows.

    p is cut into cells (at most CELLS + 1074 * FINE of them, and one for 0). Counts of the cells before give each row its rank, the least p * m / rank of
    the cells behind and of the row's own cell from the row on gives its q: two tiny tables join what each cell knows.
    """
    cell, by = "__cell", list(by)
    wide, small = F.least(F.floor(F.col(p) * CELLS), F.lit(CELLS - 1)), F.floor(F.log2(p) * FINE)
    rows = df.withColumn(cell, F.when(F.col(p) >= 1 / CELLS, wide).when(F.col(p) > 0, small).when(F.col(p) == 0, -1100 * FINE).cast("int"))
    keyed = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    counts = rows.where(F.col(p).isNotNull()).groupBy(*by, cell).agg(F.count("*").alias("__n"), F.max(total if total else F.lit(0)).alias("__t"))
    counts = counts.select(*by, cell, (F.max("__t") if total else F.sum("__n")).over(keyed).alias("__m"), (F.sum("__n").over(keyed.orderBy(cell).rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    rows = rows.withColumn("__part", F.when(F.col(p) == 0, F.pmod(F.monotonically_increasing_id(), F.lit(CELLS))).otherwise(0))  # q of p = 0 is 0 at any rank
    own = W.partitionBy(*by, cell, "__part")
    joined = rows.join(F.broadcast(counts) if not by else counts, [*by, cell], "left")
    ranked = joined.withColumn("__rank", F.col("__before") + F.row_number().over(own.orderBy(p)))
    ranked = ranked.withColumn("__raw", F.col(p) * F.col("__m") / F.col("__rank"))
    ranked = ranked.withColumn("__here", F.min("__raw").over(own.orderBy(F.desc(p), F.desc("__rank")).rowsBetween(W.unboundedPreceding, 0)))
    least = ranked.where(F.col(p).isNotNull()).groupBy(*by, cell).agg(F.min("__raw").alias("__least"))
    behind = least.select(*by, cell, F.min("__least").over(keyed.orderBy(F.desc(cell)).rowsBetween(W.unboundedPreceding, -1)).alias("__behind"))
    out = ranked.join(F.broadcast(behind) if not by else behind, [*by, cell], "left")
    value = F.least(F.lit(1.0), F.col("__here"), F.coalesce("__behind", F.lit(1.0)))
    return out.withColumn(q, F.when(F.col(p).isNotNull(), value)).select(*df.columns, q)


def bonferroni(df: DataFrame, p: str, out: str, *by: str) -> DataFrame:
    """df with p times the number of p that are not null (of the key), at most 1."""
    counts = df.groupBy(*by).agg(F.count(p).alias("__k"))
    joined = df.join(counts, list(by)) if by else df.crossJoin(F.broadcast(counts))
    return joined.withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("__k"))).drop("__k")
