"""Features of a reading from its own history, its peers and its forecast.

All windows share one specification, partition by station and order by time, so Spark plans one shuffle and
one sort for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.profile import FORECAST_METRICS, Profile


def by_station():
    return Window.partitionBy("station").orderBy("t")


def history_frame(p: Profile = Profile()):
    return by_station().rowsBetween(-p.history_hours, -1) if p.history_rows else by_station().rangeBetween(-p.history_hours * 3600, -1)


def history_n(p: Profile = Profile()) -> Column:
    """Readings in the history before this one."""
    return F.count("*").over(history_frame(p)).cast("long")


def k_hour_delta(metric: str, p: Profile = Profile()) -> tuple[Column, Column]:
    """(change against the reading nearest to k hours ago within the tolerance, that reading's id)."""
    k, tol = p.delta_hours * 3600, p.delta_tolerance_s
    near = F.collect_list(F.when(F.col(metric).isNotNull(), F.struct("t", F.col(metric).alias("v"), "id"))).over(by_station().rangeBetween(-k - tol, -k + tol))
    ranked = F.transform(near, lambda x: F.struct(F.abs(x.t - (F.col("t") - k)).alias("off"), (-x.t).alias("late"), x.v.alias("v"), x.id.alias("id")))
    best = F.array_min(ranked)
    return F.col(metric) - best.v, F.when(F.col(metric).isNotNull(), best.id)


def accumulation_6h() -> Column:
    """This amount and those strictly within six hours before; nulls count nothing."""
    return F.sum(F.coalesce("precipitation", F.lit(0.0))).over(by_station().rangeBetween(-6 * 3600 + 1, 0))


def with_history(readings: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Adds history_n, the deltas, accumulation_6h and p05_delta with its count."""
    pressure = F.coalesce("pressure_msl", "surface_pressure")
    deltas = {m: k_hour_delta(m, p) for m in ("temperature_2m", "pressure", "wind_gusts_10m", "wind_speed_10m")}
    made = {f"{m}_delta{part}": c for m, pair in deltas.items() for part, c in zip(("", "_id"), pair)}
    df = readings.withColumn("pressure", pressure).withColumns({"history_n": history_n(p), "accumulation_6h": accumulation_6h(), **made})
    # a delta counts only if the earlier reading lies in the history too
    own = by_station().rangeBetween(-(p.history_hours - p.delta_hours) * 3600, -1)
    return df.withColumns({"p05_delta": F.percentile("pressure_delta", F.lit(0.05)).over(own), "n_deltas": F.count("pressure_delta").over(own).cast("long")})


SLICE_S = 86400


def peer_facts(readings: DataFrame, stations: DataFrame, columns: list[str], asks: DataFrame | None = None, max_staleness_s: int | None = None, slice_s: int = SLICE_S) -> DataFrame:
    """(peer_group, t, peer, peer_t, columns): the latest row of every station of a group at or before each time at
    which one of the group asks (by default, whenever one has a reading).

    Time is cut into slices.  A station's last row of every slice is found first and carried to the slices after it, one
    row a slice; then questions meet the rows of their own slice and the carried one.  No window holds a station's whole
    history, and a row that is too old is not carried.
    """
    groups = stations.select("station", "peer_group")
    times = (readings if asks is None else asks).select("station", "t").join(groups, "station").select("peer_group", "t").distinct()
    number = F.floor(F.col("t") / slice_s)
    who = groups.select("peer_group", F.col("station").alias("who"))
    wanted = times.join(who, "peer_group").select("who", number.alias("slice"), "t", F.lit(1).alias("ask"), "peer_group")
    fact = F.struct(F.col("t").alias("peer_t"), *columns).alias("fact")
    facts = readings.select(F.col("station").alias("who"), number.alias("slice"), "t", F.lit(0).alias("ask"), fact)

    ends = facts.groupBy("who", "slice").agg(F.max_by("fact", "t").alias("fact"))
    asked = wanted.select("who", "slice").distinct().withColumn("asked", F.lit(True))
    upto = Window.partitionBy("who").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.join(ends.hint("merge"), ["who", "slice"], "full").withColumn("fact", F.last("fact", ignorenulls=True).over(upto)).filter("asked AND fact IS NOT NULL")
    if max_staleness_s is not None:
        carried = carried.filter(F.col("slice") * slice_s - F.col("fact.peer_t") <= max_staleness_s)
    carried = carried.select("who", "slice", (F.col("slice") * slice_s - 1).alias("t"), F.lit(0).alias("ask"), "fact", F.lit(None).cast("string").alias("peer_group"))

    nobody = F.lit(None).cast(stations.schema["peer_group"].dataType)
    rows = facts.withColumn("peer_group", nobody).unionByName(carried.withColumn("peer_group", nobody)).unionByName(wanted, allowMissingColumns=True)
    inside = Window.partitionBy("who", "slice").orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("fact", F.last("fact", ignorenulls=True).over(inside)).filter("ask = 1 AND fact IS NOT NULL")
    out = out.select("peer_group", "t", F.col("who").alias("peer"), "fact.*")
    return out if max_staleness_s is None else out.filter(F.col("t") - F.col("peer_t") <= max_staleness_s)


def latest_peers(readings: DataFrame, stations: DataFrame, columns: list[str], max_staleness_s: int | None = None, slice_s: int = SLICE_S) -> DataFrame:
    """(station, t, peer, peer_t, columns): the latest row of every other station of the group at or before t."""
    facts = peer_facts(readings, stations, columns, None, max_staleness_s, slice_s)
    asks = readings.select("station", "t").join(stations.select("station", "peer_group"), "station")
    return asks.join(facts.hint("merge"), ["peer_group", "t"]).filter("station <> peer").drop("peer_group")


def with_peer_lists(df: DataFrame, stations: DataFrame, columns: list[str], asks: DataFrame | None = None) -> DataFrame:
    """The rows of df (those of `asks`, if given) with `peers`, the latest rows of the others by name; null without any.

    A group's rows at a time are gathered once, whoever asks for them.
    """
    facts = peer_facts(df.select("station", "t", *columns), stations, columns, asks)
    lists = facts.groupBy("peer_group", "t").agg(F.sort_array(F.collect_list(F.struct("peer", *columns))).alias("peers"))
    rows = df if asks is None else df.join(asks.select("station", "t").hint("merge"), ["station", "t"], "left_semi")
    rows = rows.join(stations.select("station", "peer_group"), "station", "left").join(lists.hint("merge"), ["peer_group", "t"], "left").drop("peer_group")
    others = F.filter("peers", lambda x: x.peer != F.col("station"))
    return rows.withColumn("peers", F.when(F.size(others) > 0, others))


def matching_forecast(readings: DataFrame, forecasts: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Adds the admissible forecast for the reading's own time, fcst_<metric> and lead_hours; left outer."""
    f = forecasts.filter(F.col("lead_hours").between(p.lead_min, p.lead_max))
    f = f.select("station", F.col("target_t").alias("t"), "lead_hours", *[F.col(m).alias(f"fcst_{m}") for m in FORECAST_METRICS], F.col("weather_code").alias("fcst_weather_code"))
    return readings.join(f, ["station", "t"], "left")


def forecast_pairs(readings: DataFrame, forecasts: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Readings with an admissible forecast."""
    return matching_forecast(readings, forecasts, p).filter(F.col("lead_hours").isNotNull())


def rolling_mae(readings: DataFrame, pairs: DataFrame, p: Profile = Profile()) -> DataFrame:
    """(t, <metric>_mae, <metric>_pairs) at every time, over the newest pairs of the days before, all stations.

    Global by definition, so in two levels.  Of every day its newest `pair_limit` pairs go, as one list, to the
    `pair_days` days after it, where such lists merge into one of the same length; inside a day running counts tell
    which times of its own each time has to look back to.  Nothing is larger than a day's times or a list.
    """
    day = F.floor(F.col("t") / 86400)
    errors = F.struct((-F.col("t")).alias("late"), "station", *[F.abs(F.col(m) - F.col(f"fcst_{m}")).alias(m) for m in FORECAST_METRICS])
    rank = F.row_number().over(Window.partitionBy("t").orderBy("station"))
    kept = pairs.select("t", errors.alias("e"), rank.alias("k")).filter(F.col("k") <= p.pair_limit)
    held = kept.groupBy("t").agg(F.sort_array(F.collect_list("e")).alias("e"))

    newest = Window.partitionBy("day").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    ends = held.withColumn("day", day).withColumn("newer", F.coalesce(F.sum(F.size("e")).over(newest), F.lit(0))).filter(F.col("newer") < p.pair_limit)
    ends = ends.groupBy("day").agg(F.slice(F.sort_array(F.flatten(F.collect_list("e"))), 1, p.pair_limit).alias("e"))
    ahead = ends.select(F.explode(F.sequence(F.col("day") + 1, F.col("day") + p.pair_days)).alias("day"), "e")
    carried = ahead.groupBy("day").agg(F.slice(F.sort_array(F.flatten(F.collect_list("e"))), 1, p.pair_limit).alias("older"))

    counts = readings.select("t").distinct().join(held.select("t", F.size("e").alias("n")).hint("merge"), "t", "left").select("t", day.alias("day"), F.coalesce("n", F.lit(0)).alias("n"))
    earlier = Window.partitionBy("day").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    own = F.collect_list(F.when(F.col("n") > 0, F.struct("t", (F.col("before") + F.col("n")).alias("upto")))).over(earlier)
    asks = counts.withColumn("back", F.filter(own, lambda x: F.col("before") - x.upto < p.pair_limit)).select(F.col("t").alias("at"), "day", F.explode_outer("back.t").alias("t"))
    found = asks.join(held.hint("merge"), "t", "left").groupBy("at", "day").agg(F.sort_array(F.flatten(F.collect_list("e"))).alias("e"))
    found = found.join(carried.hint("merge"), "day", "left")
    seen = F.filter(F.concat("e", F.coalesce("older", F.array().cast(held.schema["e"].dataType))), lambda x: -x.late >= F.col("at") - p.pair_days * 86400)
    found = found.select(F.col("at").alias("t"), F.slice(seen, 1, p.pair_limit).alias("e"))
    made = {}
    for m, (floor, _) in FORECAST_METRICS.items():
        known = F.expr(f"filter(e.{m}, x -> x IS NOT NULL)")
        mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
        made[f"{m}_mae"] = F.when(F.size(known) > 0, F.greatest(mean, F.lit(floor))).otherwise(floor)
        made[f"{m}_pairs"] = F.coalesce(F.size(known), F.lit(0)).cast("long")
    return found.select("t", *[c.alias(n) for n, c in made.items()])


def previous(column: str) -> Column:
    return F.lag(column).over(by_station())


def previous_known(column: str) -> Column:
    """The last non-null value before."""
    return F.last(column, ignorenulls=True).over(by_station().rowsBetween(Window.unboundedPreceding, -1))
