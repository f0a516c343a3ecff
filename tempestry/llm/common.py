"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where a local session has none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tempestry-")  # one machine holds the driver and all tasks
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of `df` but `names`, which Spark compares without case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def whole_row(df: DataFrame, name: str = "row"):
    """All columns of `df` as one struct, so that columns made beside it meet none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def fields(columns: list[str], of: str = "row") -> list:
    """The named columns again out of a `whole_row`."""
    return [F.col(of)[c].alias(c) for c in columns]


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced, before the next phase
    writes its own.  It acts when the driver collects garbage, so this asks for that; where it comes later, more disk
    is used until then and nothing else changes.  Not for Spark Connect, whose driver is elsewhere."""
    for _ in range(2):  # the first frees Python's handles of the plans, the second what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def bounded_sample(df: DataFrame, column: str, n: int) -> list:
    """At most `n` distinct values of a text column, chosen by their hash: the same ones however rows are dealt.

    Only hashes are ranked; then the values of the n smallest hashes are fetched.
    """
    h = F.xxhash64(column)
    rows = df.filter(F.col(column).isNotNull())
    least = [r.h for r in rows.select(h.alias("h")).distinct().orderBy("h").limit(n).collect()]
    if not least:
        return []
    return sorted(r.v for r in rows.filter(h.isin(least)).groupBy(h.alias("h")).agg(F.any_value(column).alias("v")).collect())
