"""Exact percentiles of groups of any size, by narrowing: no group is ever in one task.

Every rank asked for lies in an interval of values, at first the whole group.  A round counts, by partial aggregation,
how many rows fall into each of `bins` parts of the intervals, and each rank goes on with the part that holds it, cut to
the values found in it.  When the rows in all intervals are few, or all equal, they are counted by value and the ranks
read off.  The driver sees a row a bin of each interval; how many intervals there are depends on the ranks alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempestry.operators.lineage import cut


@dataclass
class Interval:
    """`n` values from low to high, `below` of the group being smaller; the ranks that are looked for among them."""

    low: float
    high: float
    below: int
    n: int
    ranks: frozenset


def percentiles(rows: DataFrame, marks: dict[str, list[float]], bins: int = 256, rest: int = 1 << 20) -> tuple[dict[str, int], dict[tuple[str, float], float]]:
    """(values per key, interpolated percentile per key and share) of the non-null values of rows (key, v).

    `marks` gives the shares asked for, per key.  An empty group has neither.
    """
    rows = cut(rows.select("key", F.col("v").cast("double").alias("v")).filter(F.col("v").isNotNull() & F.col("key").isin(list(marks))))
    whole = {r.key: r for r in rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    sizes = {k: r.n for k, r in whole.items()}
    found: dict[tuple[str, int], float] = {}
    open_: list[tuple[str, Interval]] = []
    for key, r in whole.items():
        ranks = frozenset(k for q in marks[key] for k in _ends(q, r.n))
        open_.append((key, Interval(r.low, r.high, 0, r.n, ranks)))
    open_ = _settled(open_, found)
    while sum(i.n for _, i in open_) > rest:
        open_ = _settled(_narrowed(rows, open_, bins), found)
    if open_:
        found |= _read_off(rows, open_)
    out = {}
    for key, n in sizes.items():
        for q in marks[key]:
            a, b = _ends(q, n)
            out[key, q] = found[key, a] + (q * (n - 1) - a) * (found[key, b] - found[key, a])
    return sizes, out


def _ends(q: float, n: int) -> tuple[int, int]:
    """The ranks between which a share lies."""
    at = q * (n - 1)
    return int(at), min(int(at) + (at > int(at)), n - 1)


def _settled(open_: list, found: dict) -> list:
    """The intervals of more than one value; the ranks of the others are found."""
    for key, i in open_:
        if i.low == i.high:
            found.update({(key, k): i.low for k in i.ranks})
    return [(key, i) for key, i in open_ if i.low < i.high]


def _among(rows: DataFrame, open_: list) -> DataFrame:
    """Rows that lie in an interval, with its number and ends.  Intervals are as few as the ranks: they are broadcast."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(key, k, i.low, i.high) for k, (key, i) in enumerate(open_)], "key string, interval int, low double, high double")
    return rows.join(F.broadcast(table), "key").filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))


def _narrowed(rows: DataFrame, open_: list, bins: int) -> list:
    # halves before the difference, so that it can't overflow
    share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    part = F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")
    counted = _among(rows, open_).groupBy("interval", part).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    parts: dict[int, list] = {}
    for r in counted.collect():
        parts.setdefault(r.interval, []).append(r)
    out = []
    for k, (key, i) in enumerate(open_):
        below = i.below
        for r in sorted(parts[k], key=lambda r: r.bin):
            ranks = frozenset(x for x in i.ranks if below <= x < below + r.n)
            if ranks:
                out.append((key, Interval(r.low, r.high, below, r.n, ranks)))
            below += r.n
    return out


def _read_off(rows: DataFrame, open_: list) -> dict:
    counts = _among(rows, open_).groupBy("interval", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("interval").orderBy("v"))
    spark = rows.sparkSession
    asked = spark.createDataFrame([(k, x - i.below, x) for k, (_, i) in enumerate(open_) for x in i.ranks], "interval int, place long, rank long")
    ranged = counts.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
    hits = ranged.join(F.broadcast(asked), "interval").filter((F.col("place") >= F.col("from")) & (F.col("place") < F.col("upto")))
    return {(open_[r.interval][0], r["rank"]): r.v for r in hits.select("interval", "rank", "v").collect()}
