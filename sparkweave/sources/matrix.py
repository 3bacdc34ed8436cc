"""Numeric feature-by-sample matrices: readers into long form and writers out of it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, label, sample, value: one row for each number of the embeddings table."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    long = df.select(F.col("vec_id").alias("gene"), "label", F.posexplode("embedding").alias("sample", "v"))
    value = F.col("v").cast("double")
    return long.select("gene", "label", "sample", F.when(~F.isnan(value), value).alias("value"))


def read_wide(spark: SparkSession, path: str, sep: str = "\t", offset_header: bool = False) -> DataFrame:
    """gene_id, sample_id, value of a delimited matrix whose first column is the feature id.

    offset_header: the header names the samples only and so has one field less than the body. An empty or unnamed first
    header field is taken as the id. Values that are no numbers, and NaN, become null. The first line of each file is its
    header, so a row may be called like it; sample names must differ.
    """
    first = spark.read.text(path).first()
    header = (first[0] if first else "").split(sep)
    names = ["gene_id", *(header if offset_header else header[1:])]
    schema = T.StructType([T.StructField(n or f"V{k}", T.StringType()) for k, n in enumerate(names)])
    if len(set(names)) < len(names):
        raise ValueError("sample names are repeated")
    body = spark.read.option("sep", sep).option("header", True).schema(schema).csv(path)
    samples = names[1:]
    value = F.expr("try_cast(raw as double)")
    long = body.unpivot("gene_id", samples, "sample_id", "raw") if samples else spark.createDataFrame([], "gene_id string, sample_id string, raw string")
    return long.select("gene_id", "sample_id", F.when(~F.isnan(value), value).alias("value"))


def check_shape(long: DataFrame, genes: int | None = None, samples: int | None = None) -> DataFrame:
    """The matrix (gene_id, sample_id, value) if each feature has one value or null a sample; else an error that says what is off.

    genes, samples: the counts to be met, where they are known.
    """
    per = long.groupBy("gene_id").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("k"))
    s = per.agg(F.count("*").alias("genes"), F.min("k").alias("least"), F.max("k").alias("most"), F.max(F.col("n") - F.col("k")).alias("twice")).first()
    found = long.agg(F.count_distinct("sample_id")).first()[0]
    if s.genes and (s.twice or s.least != s.most or s.most != found):
        raise ValueError(f"features have {s.least} to {s.most} of {found} samples, and up to {s.twice} repeated values")
    if genes not in (None, s.genes) or samples not in (None, found):
        raise ValueError(f"{s.genes} features and {found} samples found, {genes} and {samples} expected")
    return long


def sample_names(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """Sample names from the header alone."""
    first = spark.read.text(path).first()
    return first[0].split(sep)[1:] if first else []


def bind(*parts: DataFrame) -> DataFrame:
    """Several long matrices as one, by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, order: list[str] | None = None, digits: int = 4, compression: str = "none", replace: bool = False) -> None:
    """Tab-separated text with fixed decimals, sorted descending with nulls last; refuses to overwrite unless told so."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    keys = [F.col(c).desc_nulls_last() for c in (order or [])]
    out = (df.orderBy(*keys) if keys else df).select(*[F.format_string(f"%.{digits}f", c).alias(c) if c in numbers else F.col(c) for c in df.columns])
    out.write.mode("overwrite" if replace else "errorifexists").option("sep", "\t").option("header", True).option("compression", compression).csv(path)


def write_by_reference(df: DataFrame, path: str, key: str = "ref_gene") -> None:
    """Parquet with one folder for each reference feature, so that readers open only what they filter for."""
    df.write.mode("errorifexists").partitionBy(key).option("compression", "zstd").parquet(path)


def read_references(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """All references of such a folder in one read; unreadable files are an error or, if so wished, left out with a warning."""
    return spark.read.option("ignoreCorruptFiles", skip_unreadable).parquet(path)


def read_reference(spark: SparkSession, path: str, value, key: str = "ref_gene") -> DataFrame:
    """The rows of one reference; only its folder is opened. A reference that is not there is an error."""
    own = read_references(spark, path).where(F.col(key) == F.lit(value))
    if own.isEmpty():
        raise ValueError(f"no {key} {value!r} in {path}")
    return own


def to_wide(df: DataFrame, gene: str = "gene_id", sample: str = "sample_id", value: str = "value") -> DataFrame:
    return df.groupBy(gene).pivot(sample).agg(F.first(value))


def simulate(spark: SparkSession, genes: int, samples: int, seed: int = 1) -> DataFrame:
    """Standard normal values in long form."""
    grid = spark.range(genes).select(F.col("id").cast("int").alias("gene")).crossJoin(spark.range(samples).select(F.col("id").cast("int").alias("sample")))
    return grid.select("gene", "sample", F.randn(seed).alias("value"))
