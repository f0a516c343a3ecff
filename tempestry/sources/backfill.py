"""Backfill of an archive in chunks of days, in order, resumable after a stop at any point."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.operators import lifecycle
from tempestry.profile import Profile
from tempestry.sources import tables
from tempestry.streaming.detection import Batches


def chunks(first_day: int, last_day: int, days: int) -> list[tuple[int, int]]:
    """Inclusive spans of epoch days."""
    if days < 1:
        raise ValueError("a chunk has one day at least")
    return [(k, min(k + days - 1, last_day)) for k in range(first_day, last_day + 1, days)]


@dataclass(frozen=True)
class Backfill:
    """Where a backfill keeps its tables: readings, candidates, the events, and the ledger of chunks.

    `load(first_day, last_day)` reads a chunk's archive, `detect(rows, new)` gives candidates of the new readings from
    them and their history.  A chunk replaces its own folders and is then entered in the ledger; one that is entered is
    skipped.  Events are folded after each chunk from where the oldest incident that may still change began.
    """

    spark: SparkSession
    path: str
    readings_schema: str
    candidates_schema: str
    load: Callable[[int, int], DataFrame]
    detect: Callable[[DataFrame, DataFrame], DataFrame]
    p: Profile = Profile()

    @property
    def readings(self) -> Batches:
        return Batches(self.spark, f"{self.path}/readings", self.readings_schema)

    @property
    def candidates(self) -> Batches:
        return Batches(self.spark, f"{self.path}/candidates", self.candidates_schema)

    def committed(self) -> dict[int, int | None]:
        """By first day of the chunks that are done, the time from which the next one has to fold."""
        fs, at = tables._fs(self.spark, f"{self.path}/ledger")
        if not fs.exists(at) or not fs.listStatus(at):
            return {}
        return {r.first_day: r.fold_from for r in self.spark.read.schema("first_day long, fold_from long").json(f"{self.path}/ledger").collect()}

    def run(self, first_day: int, last_day: int, days: int, stop_before: int | None = None) -> list[int]:
        """Do the chunks that are not committed, in order; gives their first days.  `stop_before` ends ahead of a chunk."""
        done, fold_from, made = self.committed(), None, []
        for a, z in chunks(first_day, last_day, days):
            if a in done:
                fold_from = done[a]
                continue
            if stop_before is not None and a >= stop_before:
                break
            fold_from = self._chunk(a, z, fold_from)
            made.append(a)
        return made

    def _chunk(self, a: int, z: int, fold_from: int | None) -> int | None:
        start, end = a * 86400, (z + 1) * 86400 - 1
        rows = self.load(a, z).filter(F.col("t").between(start, end))
        columns = self.spark.createDataFrame([], self.readings_schema).columns
        # the first of repeated readings stays; chunks don't overlap, so earlier ones hold none of these
        self.readings.write(rows.groupBy("station", "t").agg(F.min_by(F.struct(*columns), "id").alias("x")).select("x.*"), a)
        new = self.readings.of(a)
        history = self.readings.before(a, start - self.p.history_hours * 3600, end)
        self.candidates.write(self.detect(history.unionByName(new), new.select("station", "t")), a)
        since = start if fold_from is None else fold_from
        found = self.candidates.before(a + 1, since, end)
        seen = self.readings.before(a + 1, since, end).select("station", "t")
        tables.write_events(lifecycle.incidents(found, seen, self.p), f"{self.path}/events", batch=a)
        after = self._alive(found, seen)
        self.spark.createDataFrame([(a, after)], "first_day long, fold_from long").coalesce(1).write.mode("append").json(f"{self.path}/ledger")
        return after

    def _alive(self, found: DataFrame, seen: DataFrame) -> int | None:
        """When the oldest run of hits began that the next reading may go on with; null: the next chunk begins anew."""
        last = lifecycle.sequenced(seen).groupBy("station").agg(F.max("seq").alias("end"))
        islands = lifecycle.islands(found, seen, self.p).groupBy("station", "dedupe_key", "island").agg(F.min("t").alias("t"), F.max("seq").alias("seq"))
        return islands.join(last.hint("merge"), "station").filter(F.col("end") - F.col("seq") < self.p.k_off).agg(F.min("t")).first()[0]

    def events(self) -> DataFrame:
        return tables.read_events(self.spark, f"{self.path}/events")
