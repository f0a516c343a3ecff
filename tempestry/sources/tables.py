"""Stored tables: climatology artifact, incidents, and streaming ingest of landed readings."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempestry.operators.lineage import cut

READING = "id long, station string, t long, temperature_2m double, apparent_temperature double, dew_point_2m double, precipitation double, wind_speed_10m double, wind_gusts_10m double, pressure_msl double, surface_pressure double, weather_code int"


def write_climatology(tables: dict[str, DataFrame], path: str) -> None:
    """Every level of the artifact as a Parquet table below `path`."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_climatology(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_events(incidents: DataFrame, path: str, batch: int | None = None) -> None:
    """Upsert by incident (event_id): known ones are replaced, others stay.

    An incident's day of onset never changes, so only the days at hand are read, merged and written, aside from the data
    that readers see; a commit file, made by one rename, then says where every day lies.  A `batch` at or before the last
    committed one changes nothing, as after a restart; what a writer left behind before its commit is never read.  Of
    several versions of an incident among `incidents` the one that lasted longest counts.
    """
    spark = incidents.sparkSession
    number, last = _last_commit(spark, path)
    if batch is not None and last["batch"] is not None and batch <= last["batch"]:
        return
    newest = Window.partitionBy("event_id").orderBy(F.desc("last_t"), F.desc_nulls_last("resolved_t"))
    rows = incidents.withColumn("event_date", F.to_date(F.timestamp_seconds("onset_t")).cast("string")).withColumn("_k", F.row_number().over(newest)).filter("_k = 1").drop("_k")
    rows = cut(rows)
    days = [r.event_date for r in rows.select("event_date").distinct().collect()]  # a row a day
    before = [last["days"][d] for d in days if d in last["days"]]
    if before:
        stay = _days(spark, before).join(rows.select("event_id").hint("merge"), "event_id", "left_anti")
        rows = rows.unionByName(stay, allowMissingColumns=True)
    at = f"data/{number + 1}-{uuid.uuid4().hex}"
    if days:
        rows.withColumn("day", F.col("event_date")).write.partitionBy("day").parquet(f"{path}/{at}")
    placed = last["days"] | {d: f"{path}/{at}/day={d}" for d in days}
    publish(spark, path, number + 1, {"batch": last["batch"] if batch is None else batch, "days": placed})


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The table of events as of its last commit."""
    _, last = _last_commit(spark, path)
    if not last["days"]:
        raise ValueError(f"no events have been committed below {path}")
    return _days(spark, list(last["days"].values()))


def _days(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _last_commit(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, content) of the newest commit file; 0 and nothing before the first."""
    number = last_version(spark, path)
    return number, committed(spark, path, number) if number else {"batch": None, "days": {}}


def last_version(spark: SparkSession, path: str) -> int:
    """The number of the newest commit file below `path`, 0 before the first."""
    fs, at = _fs(spark, f"{path}/commits")
    return max([int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")], default=0) if fs.exists(at) else 0


def committed(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """What commit `number`, or the newest, says."""
    number = last_version(spark, path) if number is None else number
    if number < 1:
        raise ValueError(f"nothing has been committed below {path}")
    return json.loads(spark.read.text(f"{path}/commits/{number}.json", wholetext=True).first()[0])


def publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Make commit `number` visible at once; fails if another writer was first."""
    fs, to = _fs(spark, f"{path}/commits/{number}.json")
    _, aside = _fs(spark, f"{path}/commits/_{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(json.dumps(content).encode())
    out.close()
    if fs.exists(to) or not fs.rename(aside, to):
        raise RuntimeError(f"commit {number} of {path} was made by another writer")


def stream_readings(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Landed JSON readings as a stream, first arrival per station and time within the watermark."""
    rows = spark.readStream.schema(READING).option("maxFilesPerTrigger", files_per_batch).json(path)
    rows = rows.withColumn("observed_at", F.timestamp_seconds("t")).withWatermark("observed_at", "1 day")
    return rows.dropDuplicatesWithinWatermark(["station", "t"])
