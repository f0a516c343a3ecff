"""Length-bucketed packing with optimal bucket boundaries.

1. The global length histogram: one partial aggregation, every length exact.  Different lengths are few (their
   sum can't exceed the corpus: n of them take n * n / 2 tokens), so its rows are what the driver may fetch.
2. Dynamic programming over that histogram chooses the `buckets` upper bounds that minimise total padding
   (every document padded to the bound of its bucket).  The cost satisfies the quadrangle inequality, so
   each layer takes O(n log n) by divide and conquer.
3. Inside a bucket, a batch holds floor(token_budget / bound) documents (one, if a single document is
   longer).  A bucket is dealt by a hash of the id (of the row's number where it is null) into shards of about
   `shard_docs` documents, as many as its histogram count asks for, and batches are formed inside shards by a
   running number: no task ever holds a whole bucket, and only the last batch of a shard may be short.

Defined results: a null or empty text has length 0 and is packed like any other; ties in length share a
bucket; repeated rows and rows without an id get separate places; an empty table gives an empty result; further
columns, whatever their names, pass through and those named like the new ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm.common import fields, others, stored, whole_row

PLACES = ["n_tokens", "bucket", "padded_to", "shard", "batch", "place"]


@dataclass(frozen=True)
class PackingParams:
    buckets: int = 16
    token_budget: int = 65536
    shard_docs: int = 16384


def n_tokens(text: str = "text") -> Column:
    """Length in words: runs of characters that are not white space."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(length, documents, total tokens) in order of the length."""
    return sorted((r.n_tokens, r.docs, r.n_tokens * r.docs) for r in lengths.groupBy("n_tokens").agg(F.count("*").alias("docs")).collect())


def optimal_bounds(hist: list[tuple[int, int, int]], buckets: int) -> tuple[list[int], int]:
    """Upper bounds that minimise sum(bound - length), and that minimum."""
    if not hist:
        return [], 0
    upper = np.array([h[0] for h in hist], dtype=np.int64)
    docs = np.concatenate([[0], np.cumsum([h[1] for h in hist])])
    tokens = np.concatenate([[0], np.cumsum([h[2] for h in hist])])
    n = len(hist)

    def cost(i, j):  # bins i..j-1 padded to the upper end of j-1
        return upper[j - 1] * (docs[j] - docs[i]) - (tokens[j] - tokens[i])

    best = np.array([0] + [cost(0, j) for j in range(1, n + 1)], dtype=np.int64)
    choice = [np.zeros(n + 1, dtype=np.int64)]
    for k in range(2, min(buckets, n) + 1):
        new = best.copy()
        pick = np.zeros(n + 1, dtype=np.int64)
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            total = best[i] + cost(i, mid)
            at = int(np.argmin(total))
            new[mid], pick[mid] = total[at], i[at]
            todo += [(lo, mid - 1, a, int(i[at])), (mid + 1, hi, int(i[at]), b)]
        best = new
        choice.append(pick)
    bounds, j = [], n
    for pick in reversed(choice):
        bounds.append(int(upper[j - 1]))
        j = int(pick[j])
    return bounds[::-1], int(best[n])


def packed(docs: DataFrame, p: PackingParams = PackingParams(), drop_text: bool = False) -> DataFrame:
    """`docs` (with text, or with n_tokens alone; without text if `drop_text`) with n_tokens, bucket, padded_to, shard,
    batch and place (from 1) in the batch.

    (bucket, shard, batch) names a batch; its documents times padded_to stay within the token budget,
    unless it is a single longer document.
    """
    length = n_tokens() if "text" in docs.columns else F.col("n_tokens").cast("long")
    own = docs.drop("text") if drop_text else docs
    # words are counted once; the row's number is fixed by writing it
    rows = stored(docs.select(whole_row(own), "doc_id", length.alias("n_tokens"), F.monotonically_increasing_id().alias("number")))
    hist = histogram(rows)
    bounds, _ = optimal_bounds(hist, p.buckets)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    counts = [sum(h[1] for h in hist if (bounds[i - 1] if i else -1) < h[0] <= b) for i, b in enumerate(bounds)]
    shards = F.array(*[F.lit(max(1, math.ceil(c / p.shard_docs))) for c in counts]) if counts else F.array(F.lit(1))
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("n_tokens")))).withColumn("padded_to", F.get(edges, "bucket"))
    spread = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("number"))
    rows = rows.withColumn("shard", F.pmod(spread, F.get(shards, "bucket").cast("long")).cast("int"))
    at = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "number")) - 1
    size = F.greatest(F.lit(1), F.floor(F.lit(p.token_budget) / F.greatest(F.col("padded_to"), F.lit(1)))).cast("int")
    rows = rows.withColumn("at", at).withColumn("batch", F.floor(F.col("at") / size).cast("long")).withColumn("place", (F.col("at") % size + 1).cast("int"))
    return rows.select(*fields(others(own, *PLACES)), *PLACES)
