"""The ten detectors: features in, candidates out, one schema for all.

A detector is a function (features, Profile) -> candidates; `detect` runs an ordered tuple of them.  The ten built-in
ones are rules, columns that are a candidate or null, so any number of them takes one pass over the features.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.functions import scalars as S
from tempestry.operators import climatology, features
from tempestry.profile import DETECTORS, FORECAST_METRICS, SCORE_WEIGHTS, WET_PERCENTILES, Profile

Z_METRICS = ("temperature_2m", "wind_gusts_10m", "pressure_msl")


def enriched(readings: DataFrame, stations: DataFrame, clim: dict, p: Profile = Profile()) -> DataFrame:
    """Readings with history features, baseline lookups, z scores, gates and tail anchors.

    `clim` holds levels and wet (statistics per level) and gates (literal columns).
    """
    return with_baseline(with_past(readings, stations, p), clim, p)


def with_past(readings: DataFrame, stations: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Readings with local time and history features: what profiles of the same history share."""
    return features.with_history(climatology.with_local(readings, stations), p)


def with_baseline(df: DataFrame, clim: dict, p: Profile = Profile()) -> DataFrame:
    """Rows of `with_past` with lookups, z scores, gates and tail anchors."""
    df = climatology.lookup(df, clim["levels"], Z_METRICS, p)
    df = climatology.wet_lookup(df, clim["wet"], p)
    df = df.withColumns({f"{m}_z": S.robust_z(F.col(m), F.col(f"{m}_median"), F.col(f"{m}_scale"), m) for m in Z_METRICS})
    df = df.withColumns({f"{m}_conf": F.when(F.col(f"{m}_z").isNull(), 0.0).otherwise(S.bucket_confidence(F.col(f"{m}_bucket"), F.col(f"{m}_n"), p.min_bucket_n)) for m in Z_METRICS})
    return df.withColumns(clim["gates"])


def gates(threshold: DataFrame, tail: DataFrame) -> dict:
    """Literal columns: gate per metric and side, rain quantile, and anchors.

    threshold: (metric, upper_z, lower_z, ...), tail: (metric, kind, k, v, p), both incl. metrics rain and rain_6h;
    a row per metric and 16 anchors each, whatever the readings.
    """
    at = {r.metric: r for r in threshold.collect()}
    out = {f"gate_{m}_{side}": F.lit(getattr(at.get(m), f"{side}_z", None)).cast("double") for m in Z_METRICS for side in ("upper", "lower")}
    out["wet_p995"] = F.lit(getattr(at.get("rain"), "upper_z", None)).cast("double")
    points: dict = {}
    for r in tail.collect():
        points.setdefault((r.metric, r.kind), []).append((abs(r.v), r.v, r.p))
    for m in (*Z_METRICS, "rain", "rain_6h"):
        for kind in ("upper", "lower") if m in Z_METRICS else ("upper",):
            rows = [F.struct(F.lit(v).alias("v"), F.lit(p).alias("p")) for _, v, p in sorted(points.get((m, kind), []))]
            out[f"{m}_{kind}"] = F.array(*rows) if rows else F.array().cast("array<struct<v:double,p:double>>")
    return out


# The sentences of the headlines.
HEADLINES = {
    "temperature_shock": "{station} saw a {direction} temperature shock: {value}C is {z} sigma from the local-hour baseline and changed {delta}C in {hours}h.",
    "pressure_plunge": "{station} shows storm-onset signals: {metric} fell {fall} hPa in {hours}h while {wind_metric} rose {rise} km/h.",
    "spell": "{station} is in a {tail} temperature spell: {value}C is {z} sigma from the local-hour baseline.",
    "heavy_rain_burst": "{station} has a heavy rain burst: {amount} mm this hour and {total} mm over {hours}h exceeds the wet-hour threshold of {gate} mm.",
    "wind_gust_burst": "{station} has an unusual gust burst: {value} km/h is {z} sigma above the local-hour baseline.",
    "heat_stress": "{station} has heat stress conditions: Humidex {humidex} from {temperature}C air and {dew}C dew point.",
    "cold_stress": "{station} has cold stress conditions: wind chill {chill}C with {temperature}C air and {wind} km/h wind.",
    "forecast_bust": "{station}'s {metric} missed the stored forecast by {error}, {norm}x the recent global MAE.",
    "spatial_anomaly": "{station}'s {metric} anomaly differs from peers by {gap} sigma in climatology-normalized space.",
}
# Where the threshold of wet hours comes from.
RAIN_SOURCES = ("training_wet_hour_upper_quantile_with_hazard_floor", "fixed_wet_p95_floor", "fixed_wet_p95_fallback")


def one(x: Column) -> Column:
    """A number to one place, as text."""
    return climatology.places(x.cast("double"), 1).cast("string")


def _headline(kind: str, **parts: Column) -> Column:
    out, parts = [], {"station": F.col("station"), **parts}
    for text, name, *_ in string.Formatter().parse(HEADLINES[kind]):
        out += [F.lit(text)] + ([parts[name]] if name else [])
    return F.concat(*out)


class Detector:
    """A built-in detector from its rules: a function Profile -> list of candidate columns, null where nothing fires."""

    def __init__(self, rules: Callable[[Profile], list[Column]]):
        self.rules = lru_cache(rules)  # columns depend on the profile alone and are slow to build
        self.__name__, self.__doc__ = rules.__name__, rules.__doc__

    def __call__(self, df: DataFrame, p: Profile = Profile()) -> DataFrame:
        return _fired(df, self.rules(p))


def _fired(df: DataFrame, rules: list[Column]) -> DataFrame:
    """The candidates of rules; what all of them share is computed for those that fired alone."""
    c = F.col("c")
    rows = df.select("station", "t", "id", F.explode(F.array_compact(F.array(*rules))).alias("c"))
    rows = rows.withColumn("score", S.priority_score(**{name: c["inputs"][name] for name in SCORE_WEIGHTS}))
    return rows.select(
        "station", "t", "id", "c.detector", F.element_at(F.create_map(*[F.lit(x) for k, d in enumerate(DETECTORS) for x in (d, k)]), c["detector"]).alias("detector_order"),
        "c.metric", climatology.places(c["strength"], 3).alias("strength"), "score", S.severity(F.col("score")).alias("severity"),
        F.round(S.clamp01(c["inputs"]["confidence"]), 3).alias("confidence"), F.transform_values(c["signals"], lambda _, v: climatology.places(v, 3)).alias("signals"), "c.notes", "c.reason", "c.supporting_ids",
        S.dedupe_key(F.col("station"), c["detector"], c["metric"]).alias("dedupe_key"),
    )


def _candidate(p: Profile, fired: Column, kind: str, metric: Column, strength: Column, confidence: Column, inputs: dict, signals: dict, headline: Column, notes: dict | None = None, supporting: Column | None = None) -> Column:
    parts = {**inputs, "confidence": confidence}
    named = [x for n, c in signals.items() for x in (F.lit(n), c.cast("double"))]
    texts = [x for n, c in (notes or {"detector": F.lit(kind)}).items() for x in (F.lit(n), c)]
    ids = F.array(F.col("id")) if supporting is None else F.array_compact(F.concat(F.array(F.col("id")), supporting))
    row = F.struct(
        F.lit(kind).alias("detector"), metric.alias("metric"), strength.cast("double").alias("strength"), F.struct(*[parts.get(n, F.lit(0.0)).cast("double").alias(n) for n in SCORE_WEIGHTS]).alias("inputs"),
        F.create_map(*named).alias("signals"), F.create_map(*texts).alias("notes"), headline.alias("reason"), ids.alias("supporting_ids"),
    )
    return F.when((F.col("history_n") >= p.min_history) & fired, row)


def _gate(p: Profile, metric: str, side: str, fallback: float) -> Column:
    return F.coalesce(F.col(f"gate_{metric}_{side}"), F.lit(fallback)) if p.quantile_gates else F.lit(fallback)


def _source(p: Profile, metric: str, side: str) -> Column:
    known = F.col(f"gate_{metric}_{side}").isNotNull() if p.quantile_gates else F.lit(False)
    return F.when(known, "quantile").otherwise("fixed")


def _rarity(p: Profile, name: str, x: Column) -> Column:
    return S.rarity(F.col(name), x, F.abs(x) / 4) if p.surprisal else S.clamp01(F.abs(x) / 4)


@Detector
def temperature_shock(p):
    z, delta = F.col("temperature_2m_z"), F.col("temperature_2m_delta")
    up = z >= 0
    gate = F.abs(F.when(up, _gate(p, "temperature_2m", "upper", p.shock_z)).otherwise(_gate(p, "temperature_2m", "lower", -p.shock_z)))
    tail = F.when(up, _rarity(p, "temperature_2m_upper", z)).otherwise(_rarity(p, "temperature_2m_lower", z))
    direction = F.when(delta > 0, "warming").otherwise("cooling")
    inputs = {"rarity": tail, "magnitude": F.abs(delta) / p.shock_anchor_c, "compound": F.lit(0.5)}
    signals = {
        "value": F.col("temperature_2m"), "median": F.col("temperature_2m_median"), "scale": F.col("temperature_2m_scale"), "z_score": F.abs(z), "signed_z_score": z,
        "threshold_z": gate, "delta_c": delta, "delta_hours": F.lit(p.delta_hours), "baseline_n": F.col("temperature_2m_n"),
    }
    headline = _headline("temperature_shock", direction=direction, value=one(F.col("temperature_2m")), z=one(F.abs(z)), delta=F.concat(F.when(delta >= 0, "+").otherwise(""), one(delta)), hours=F.lit(str(p.delta_hours)))
    notes = {"threshold_source": F.when(up, _source(p, "temperature_2m", "upper")).otherwise(_source(p, "temperature_2m", "lower")), "direction": direction, "baseline_bucket": F.col("temperature_2m_bucket")}
    fired = (F.abs(z) >= gate) & (F.abs(delta) >= p.shock_delta_c)
    return [_candidate(p, fired, "temperature_shock", F.lit("temperature_2m"), F.abs(z), F.col("temperature_2m_conf"), inputs, signals, headline, notes, F.array("temperature_2m_delta_id"))]


@Detector
def pressure_plunge(p):
    fall = -F.col("pressure_delta")
    required = F.greatest(F.lit(p.fall_hpa), F.abs(F.least(F.lit(0.0), F.col("p05_delta"))))
    gusts = F.col("wind_gusts_10m_delta").isNotNull()
    rise = F.when(gusts, F.col("wind_gusts_10m_delta")).otherwise(F.col("wind_speed_10m_delta"))
    wind = F.when(gusts, F.col("wind_gusts_10m")).when(F.col("wind_speed_10m_delta").isNotNull(), F.col("wind_speed_10m"))
    wind_metric = F.when(gusts, "wind_gusts_10m").otherwise("wind_speed_10m")
    confirmed = (rise >= p.wind_rise_kmh) | (wind >= p.confirming_gust_kmh)
    metric = F.when(F.col("pressure_msl").isNotNull(), "pressure_msl").otherwise("surface_pressure")
    inputs = {"rarity": fall / required, "magnitude": fall / p.fall_anchor_hpa, "compound": F.lit(1.0)}
    signals = {
        "pressure_fall_hpa": fall, "difference": fall, "pressure_delta_hpa": F.col("pressure_delta"), "delta_hours": F.lit(p.delta_hours), "p05_delta_hpa": F.col("p05_delta"),
        "required_fall_hpa": required, "wind_rise_kmh": rise, "current_wind_kmh": wind,
    }
    headline = _headline("pressure_plunge", metric=metric, fall=one(fall), hours=F.lit(str(p.delta_hours)), wind_metric=wind_metric, rise=one(rise))
    fired = (fall > 0) & (F.col("n_deltas") >= 6) & (fall >= required) & confirmed
    return [_candidate(p, fired, "pressure_plunge", metric, fall, F.lit(1.0), inputs, signals, headline, {"wind_metric": wind_metric}, F.array("pressure_delta_id"))]


def _spell(p: Profile, kind: str, side: str) -> list[Column]:
    z = F.col("temperature_2m_z")
    gate = _gate(p, "temperature_2m", side, p.spell_z if side == "upper" else -p.spell_z)
    away = F.abs(F.col("temperature_2m") - F.col("temperature_2m_median"))
    magnitude = away / p.spell_anchor_c if p.surprisal else F.abs(z) / 6
    tail = "warm" if side == "upper" else "cold"
    inputs = {"rarity": _rarity(p, f"temperature_2m_{side}", z), "magnitude": magnitude, "persistence": F.abs(z) / 4}
    signals = {
        "value": F.col("temperature_2m"), "median": F.col("temperature_2m_median"), "departure_c": away, "z_score": F.abs(z), "signed_z_score": z, "threshold_z": F.abs(gate),
        "signed_threshold_z": gate, "baseline_n": F.col("temperature_2m_n"),
    }
    headline = _headline("spell", tail=F.lit(tail), value=one(F.col("temperature_2m")), z=one(F.abs(z)))
    notes = {"threshold_source": _source(p, "temperature_2m", side), "tail": F.lit(tail), "baseline_bucket": F.col("temperature_2m_bucket")}
    fired = z >= gate if side == "upper" else z <= gate
    return [_candidate(p, fired, kind, F.lit("temperature_2m"), F.abs(z), F.col("temperature_2m_conf"), inputs, signals, headline, notes)]


@Detector
def warm_spell(p):
    return _spell(p, "warm_spell", "upper")


@Detector
def cold_spell(p):
    return _spell(p, "cold_spell", "lower")


@Detector
def heavy_rain_burst(p):
    amount, total = F.coalesce("precipitation", F.lit(0.0)), F.col("accumulation_6h")
    # the training quantile, else the 95th percentile of the bucket's wet hours; without either nothing fires
    quantile, p95 = F.col("wet_p995") if p.quantile_gates else F.lit(None).cast("double"), F.col("wet_p95")
    known = F.coalesce(quantile, p95)
    hour_gate = F.when(known.isNotNull(), F.greatest(known, F.lit(p.rain_mm)))
    total_gate = F.when(known.isNotNull(), F.greatest(hour_gate, F.lit(p.rain_6h_mm)))
    by_total = total >= total_gate
    if p.surprisal:
        rarity = F.greatest(S.rarity(F.col("rain_upper"), amount, F.lit(1.0)), S.rarity(F.col("rain_6h_upper"), total, F.lit(1.0)))
        magnitude = F.greatest(amount / p.rain_anchor_mm, total / p.rain_6h_anchor_mm)
    else:
        rarity, magnitude = F.lit(1.0), F.greatest(amount, total) / 20
    inputs = {"rarity": rarity, "magnitude": magnitude, "persistence": total / 15, "compound": F.when(by_total, 1.0).otherwise(0.5)}
    trigger = F.when(amount >= hour_gate, "hourly").otherwise("accumulation")
    marks = F.array(*[F.struct(F.col(f"wet_p{m}").alias("v"), F.lit(m).alias("p")) for m in WET_PERCENTILES])
    signals = {
        "amount_mm": amount, "accumulation_mm": total, "difference": F.greatest(amount, total), "wet_hour_p95_mm": p95, "wet_hour_quantile_mm": known, "absolute_hazard_floor_mm": F.lit(p.rain_mm),
        "threshold_mm": hour_gate, "threshold_quantile": F.lit(99.5), "accumulation_hours": F.lit(6), "accumulation_threshold_mm": total_gate,
        "wet_amount_percentile": F.when(p95.isNotNull(), S.wet_bucket(amount, marks)), "wet_count": F.coalesce("wet_count", F.lit(0)), "total_count": F.coalesce("total_count", F.lit(0)),
    }
    headline = _headline("heavy_rain_burst", amount=one(amount), total=one(total), hours=F.lit("6"), gate=one(hour_gate))
    source = F.when(quantile.isNotNull(), RAIN_SOURCES[0]).otherwise(RAIN_SOURCES[2 if p.quantile_gates else 1])
    notes = {"threshold_source": source, "trigger": trigger, "baseline_bucket": F.coalesce("wet_bucket", F.lit("missing"))}
    fired = (amount >= p.wet_mm) & ((amount >= hour_gate) | by_total)
    confidence = F.greatest(S.bucket_confidence(F.col("wet_bucket"), F.col("wet_count"), p.min_bucket_n), F.lit(0.8))
    return [_candidate(p, fired, "heavy_rain_burst", F.lit("precipitation"), F.greatest(amount, total), confidence, inputs, signals, headline, notes)]


@Detector
def wind_gust_burst(p):
    z, gust = F.col("wind_gusts_10m_z"), F.col("wind_gusts_10m")
    gate = _gate(p, "wind_gusts_10m", "upper", p.gust_z)
    high = F.greatest(z, F.lit(0.0))
    inputs = {"rarity": _rarity(p, "wind_gusts_10m_upper", high), "magnitude": gust / p.gust_kmh}
    signals = {"value": gust, "median": F.col("wind_gusts_10m_median"), "z_score": high, "threshold_z": gate, "gust_kmh": gust, "anchor_kmh": F.lit(p.gust_kmh), "baseline_n": F.col("wind_gusts_10m_n")}
    headline = _headline("wind_gust_burst", value=one(gust), z=one(z))
    notes = {"threshold_source": _source(p, "wind_gusts_10m", "upper"), "baseline_bucket": F.col("wind_gusts_10m_bucket")}
    fired = z.isNotNull() & ((z >= gate) | (gust >= p.gust_kmh))
    return [_candidate(p, fired, "wind_gust_burst", F.lit("wind_gusts_10m"), high, F.col("wind_gusts_10m_conf"), inputs, signals, headline, notes)]


@Detector
def heat_stress(p):
    t, dew, z = F.col("temperature_2m"), F.col("dew_point_2m"), F.col("temperature_2m_z")
    h = S.humidex(t, dew)
    high = F.when(z.isNotNull(), F.greatest(z, F.lit(0.0)))
    inputs = {"rarity": F.when(z.isNotNull(), _rarity(p, "temperature_2m_upper", high)).otherwise(0.0), "magnitude": (h - p.humidex) / (p.humidex_strong - p.humidex), "compound": F.lit(1.0), "persistence": F.lit(0.5)}
    signals = {"humidex": h, "gap": h - p.humidex, "temperature_2m": t, "dew_point_2m": dew, "z_score": high}
    headline = _headline("heat_stress", humidex=one(h), temperature=one(t), dew=one(dew))
    return [_candidate(p, h >= p.humidex, "heat_stress", F.lit("humidex"), F.coalesce(high, h - p.humidex), F.col("temperature_2m_conf"), inputs, signals, headline, {"baseline_bucket": F.col("temperature_2m_bucket")})]


@Detector
def cold_stress(p):
    t, wind, z = F.col("temperature_2m"), F.col("wind_speed_10m"), F.col("temperature_2m_z")
    c = S.wind_chill(t, wind)
    strength = F.coalesce(F.abs(z), F.lit(0.0))
    rare = F.when(z.isNotNull(), _rarity(p, "temperature_2m_lower", F.least(z, F.lit(0.0)))).otherwise(0.0)
    inputs = {"rarity": rare, "magnitude": (p.wind_chill - c) / (p.wind_chill - p.wind_chill_strong), "compound": F.lit(1.0), "persistence": F.lit(0.5)}
    signals = {"wind_chill": c, "gap": p.wind_chill - c, "temperature_2m": t, "wind_speed_10m": wind, "z_score": strength, "signed_z_score": z}
    headline = _headline("cold_stress", chill=one(c), temperature=one(t), wind=one(wind))
    return [_candidate(p, c <= p.wind_chill, "cold_stress", F.lit("wind_chill"), strength, F.col("temperature_2m_conf"), inputs, signals, headline, {"baseline_bucket": F.col("temperature_2m_bucket")})]


@Detector
def forecast_bust(p):
    """Needs fcst_<metric>, lead_hours, <metric>_mae and <metric>_pairs; a candidate per metric."""
    out = []
    for m, (_, anchor) in FORECAST_METRICS.items():
        observed, said, mae, pairs = F.col(m), F.col(f"fcst_{m}"), F.col(f"{m}_mae"), F.col(f"{m}_pairs")
        error = F.abs(observed - said)
        norm = error / mae
        inputs = {"forecast_surprise": norm / 4, "magnitude": error / anchor}
        signals = {"observed": observed, "forecast": said, "residual": observed - said, "abs_error": error, "rolling_mae": mae, "normalized_error": norm, "comparison_count": pairs, "lead_hours": F.col("lead_hours")}
        headline = _headline("forecast_bust", metric=F.lit(m), error=one(error), norm=one(norm))
        out.append(_candidate(p, (pairs >= p.bust_pairs) & (norm >= p.bust_k), "forecast_bust", F.lit(m), error, F.lit(1.0), inputs, signals, headline))
    return out


def _usable(metric: str) -> Column:
    """z of the peers that have one with some confidence."""
    trusted = F.filter("peers", lambda x: x[f"{metric}_z"].isNotNull() & (x[f"{metric}_conf"] > 0))
    return F.transform(trusted, lambda x: x[f"{metric}_z"])


@Detector
def spatial_anomaly(p):
    """Needs peers: array<struct<id, z per metric, conf per metric>>, the latest row of every peer; null without any."""
    out = []
    for m in Z_METRICS:
        z = F.col(f"{m}_z")
        sorted_z = F.sort_array(_usable(m))
        n = F.size(sorted_z)
        middle = (F.get(sorted_z, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_z, F.floor(n / 2).cast("int"))) / 2
        upper, lower = _gate(p, m, "upper", p.gust_z if m == "wind_gusts_10m" else p.spatial_z), _gate(p, m, "lower", -p.spatial_z)
        if m == "wind_gusts_10m":
            own, limit = z >= upper, upper
            tail = _rarity(p, f"{m}_upper", F.greatest(z, F.lit(0.0)))
        else:
            own, limit = F.when(z >= 0, z >= upper).otherwise(z <= lower), F.abs(F.when(z >= 0, upper).otherwise(lower))
            tail = F.when(z >= 0, _rarity(p, f"{m}_upper", z)).otherwise(_rarity(p, f"{m}_lower", z))
        gap = F.abs(z - middle)
        inputs = {"spatial": gap / 5, "rarity": tail}
        signals = {"z_score": F.abs(z), "signed_z_score": z, "threshold_z": limit, "peer_median_z": middle, "difference": gap, "peer_count": n}
        headline = _headline("spatial_anomaly", metric=F.lit(m), gap=one(gap))
        ids = F.transform("peers", lambda x: x.id)
        notes = {"threshold_source": _source(p, m, "upper"), "baseline_bucket": F.col(f"{m}_bucket")}
        out.append(_candidate(p, (n > 0) & own & (gap >= p.spatial_gap), "spatial_anomaly", F.lit(m), F.abs(z), F.col(f"{m}_conf"), inputs, signals, headline, notes, ids))
    return out


REGISTRY: tuple[Callable, ...] = (temperature_shock, pressure_plunge, warm_spell, cold_spell, heavy_rain_burst, wind_gust_burst, heat_stress, cold_stress, forecast_bust, spatial_anomaly)


def detect(df: DataFrame, p: Profile = Profile(), detectors: Sequence[Callable] = REGISTRY) -> DataFrame:
    """The candidates of all detectors, own ones included; the built-in ones in one pass."""
    rules = [rule for d in detectors if isinstance(d, Detector) for rule in d.rules(p)]
    parts = [_fired(df, rules)] if rules else []
    parts += [d(df, p) for d in detectors if not isinstance(d, Detector)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
