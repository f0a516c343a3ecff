"""Detection on arrival: each micro-batch runs the batch operators over its rows and the recent history that was stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.profile import Profile
from tempestry.sources.tables import _fs


@dataclass(frozen=True)
class Batches:
    """A table that grows by one folder a micro-batch, split by day; a batch that runs again replaces its own folder."""

    spark: SparkSession
    path: str
    schema: str

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.withColumn("day", F.floor(F.col("t") / 86400)).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/batch={batch}")

    def of(self, batch: int) -> DataFrame:
        columns = self.spark.createDataFrame([], self.schema).columns
        return self.spark.read.schema(f"{self.schema}, day long").parquet(f"{self.path}/batch={batch}").select(*columns)

    def before(self, batch: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """Rows of the batches before one, with times from `start` to `end`; folders out of these spans aren't read."""
        fs, at = _fs(self.spark, self.path)
        if not fs.exists(at):
            return self.spark.createDataFrame([], self.schema)
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = self.spark.read.schema(f"{self.schema}, batch long, day long").option("basePath", self.path).parquet(self.path)
        if batch is not None:
            rows = rows.filter(F.col("batch") < batch)
        if start is not None:
            rows = rows.filter((F.col("day") >= start // 86400) & (F.col("t") >= start))
        if end is not None:
            rows = rows.filter((F.col("day") <= end // 86400) & (F.col("t") <= end))
        return rows.select(*columns)


def kept_new(readings: Batches, batch: DataFrame, number: int) -> DataFrame | None:
    """Store the readings of a micro-batch whose (station, t) is not stored yet, of several at once the first by id;
    gives them as stored, or none if the micro-batch is empty."""
    span = batch.agg(F.min("t").alias("a"), F.max("t").alias("z")).first()
    if span.a is None:
        return None
    columns = readings.spark.createDataFrame([], readings.schema).columns
    known = readings.before(number, span.a, span.z).select("station", "t")
    first = batch.groupBy("station", "t").agg(F.min_by(F.struct(*columns), "id").alias("x")).select("x.*")
    readings.write(first.join(known.hint("merge"), ["station", "t"], "left_anti"), number)
    return readings.of(number)


def on_arrival(
    readings: Batches,
    found: Batches,
    detect: Callable[..., DataFrame],
    p: Profile = Profile(),
    forecasts: Batches | None = None,
    offered: Callable[[DataFrame], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over readings.

    New readings are stored, and with them the forecasts that came along (`offered` gives those of new readings): a
    forecast is kept only if its reading was new.  `detect(rows, new, said)` gives candidates for the new readings from
    them, the stored history of all stations and the stored forecasts; they are stored too.  A batch that runs again sees
    the same history and replaces what it wrote.
    """

    def run(batch: DataFrame, number: int) -> None:
        mine = kept_new(readings, batch, number)
        span = None if mine is None else mine.agg(F.min("t").alias("a"), F.max("t").alias("z")).first()
        if span is None or span.a is None:
            return
        start = span.a - p.history_hours * 3600
        said = None
        if forecasts is not None and offered is not None:
            forecasts.write(offered(mine).withColumn("t", F.col("target_t")), number)
            said = forecasts.before(number + 1, start, span.z)
        history = readings.before(number, start, span.z)
        found.write(detect(history.unionByName(mine), mine.select("station", "t"), said), number)

    return run
