"""Cutting lineage by tables in the folder that the cluster names for checkpoints."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set on the context; a folder of this machine only on a local master, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder or found.isDefined():
        return (folder or found.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sparkweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _drop(at: str) -> None:
    try:
        sc = _FOLDERS[at].sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have gone
        pass


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that later plans start from files whose size is known.

    The tables of an application go when its Python process ends.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/sparkweave-{spark.sparkContext.applicationId}"
    if at not in _FOLDERS:
        _FOLDERS[at] = spark
        atexit.register(_drop, at)
    path = f"{at}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
