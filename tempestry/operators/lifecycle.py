"""Incidents from candidates: hysteresis as gaps and islands over each station's sequence of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.functions.scalars import severity
from tempestry.profile import Profile


def best_per_key(candidates: DataFrame) -> DataFrame:
    """Per reading and key the highest score; of equal ones the later detector."""
    w = Window.partitionBy("dedupe_key", "t").orderBy(F.desc("score"), F.desc("detector_order"))
    return candidates.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def sequenced(readings: DataFrame) -> DataFrame:
    """(station, t, seq): each station's readings by number."""
    return readings.select("station", "t").withColumn("seq", F.row_number().over(Window.partitionBy("station").orderBy("t")))


def islands(candidates: DataFrame, readings: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Sustaining hits with their island and, from its opening run on, `opened` (the seq of the onset)."""
    hits = best_per_key(candidates).filter(F.col("strength") >= p.z_off).join(sequenced(readings).hint("merge"), ["station", "t"])
    w = Window.partitionBy("dedupe_key").orderBy("seq")
    gap = F.col("seq") - F.lag("seq").over(w)
    hits = hits.withColumn("_new", (gap.isNull() | (gap - 1 >= p.k_off)).cast("int")).withColumn("island", F.sum("_new").over(w))
    inside = Window.partitionBy("dedupe_key", "island").orderBy("seq")
    strong = F.col("strength") >= p.z_on
    hits = hits.withColumn("_strong", strong).withColumn("_run", F.col("seq") - F.sum(F.col("_strong").cast("int")).over(inside))
    run = Window.partitionBy("dedupe_key", "island", "_run", "_strong")
    opens = F.when(F.col("_strong") & (F.count("*").over(run) >= p.k_on), F.min("seq").over(run))
    hits = hits.withColumn("_opens", opens)
    return hits.withColumn("opened", F.min("_opens").over(Window.partitionBy("dedupe_key", "island"))).drop("_new", "_strong", "_run", "_opens")


def incidents(candidates: DataFrame, readings: DataFrame, p: Profile = Profile(), representative: str = "strength") -> DataFrame:
    """One row per incident; the peak row is that of the largest `representative` (strength, or score for replays).

    The k_on readings that open an incident are pending ones: of equal peaks among them the last counts, and the score
    is the peak's.  After them only a larger value moves the peak, and the largest score counts.  resolved_t is the
    time of the k_off-th reading after the last hit, null while open or ongoing.
    """
    hits = islands(candidates, readings, p).filter(F.col("seq") >= F.col("opened"))
    pending = F.col("seq") < F.col("opened") + p.k_on
    opening = F.col("seq") == F.col("opened") + p.k_on - 1
    ids = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "supporting_ids"))), lambda x: x.supporting_ids)))
    told = [F.col(representative).alias("by"), "t", "strength", "score", *[c for c in ("signals", "notes", "reason") if c in candidates.columns]]
    out = hits.groupBy("station", "detector", "metric", "dedupe_key", "island").agg(
        F.min("t").alias("onset_t"), F.max("t").alias("last_t"), F.max("seq").alias("last_seq"), F.count("*").alias("hits"),
        F.max_by(F.struct(*told), F.when(pending, F.struct(F.col(representative), F.col("seq")))).alias("before"),
        F.max_by(F.struct(*told), F.when(~pending, F.struct(F.col(representative), -F.col("seq")))).alias("after"),
        F.max("strength").alias("peak_strength"), F.max(F.when(~pending, F.col("score"))).alias("later_score"),
        F.max(F.when(~pending | opening, F.col("confidence"))).alias("confidence"), ids.alias("supporting_ids"),
    )
    peak = F.when(F.col("after.by") > F.col("before.by"), F.col("after")).otherwise(F.col("before"))
    out = out.withColumn("peak", peak).withColumn("priority_score", F.greatest("before.score", "later_score"))
    out = out.withColumns({"peak_t": F.col("peak.t"), **{c: F.col("peak")[c] for c in ("signals", "notes", "reason") if c in candidates.columns}}).drop("before", "after", "later_score", "peak")
    after = sequenced(readings).select("station", F.col("t").alias("resolved_t"), (F.col("seq") - p.k_off).alias("last_seq"))
    out = out.join(after.hint("merge"), ["station", "last_seq"], "left")
    status = F.when(F.col("resolved_t").isNotNull(), "resolved").when(F.col("hits") > p.k_on, "ongoing").otherwise("open")
    event_id = F.xxhash64("dedupe_key", "onset_t")
    return out.withColumn("status", status).withColumn("severity", severity(F.col("priority_score"))).withColumn("event_id", event_id).drop("last_seq", "island")
