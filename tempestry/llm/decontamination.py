"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits in lower case; of scripts written without spaces, every letter is a token.
Seeds are windows of `min_match` tokens under a Karp-Rabin hash; an item shorter than that is a single window of all
its tokens, looked for at its own size.

1. A bitmap of the benchmark's seed hashes is shipped to the tasks and drops almost all windows of clean text.
   It has 64 bits a seed or more, up to `bitmap_bits`; a larger benchmark fills it more and only more windows go on.
2. Which pairs can reach the coverage: tiles have `min_match` tokens at least, so a document that covers the share
   `coverage` of an item of n tokens holds ceil(coverage * n / min_match) of its seeds or more, and hence one
   of the rest when that many less one, those in most documents, are left aside.  Pairs come from these rarer
   seeds alone, so that a common phrase never joins all its documents with all its items.
3. Of each pair the document's places and the item's places meet as two lists, each bounded by its own text.
   Karp-Rabin matches are tiled: again and again the longest match that touches no marked token is marked, longer
   ones cut at marked tokens, until none of `min_match` tokens is left.  The share of the item's tokens that is
   marked is its coverage, which reordered passages do not lower.

Defined results: a null or empty text has no seeds, nor has an item without letters and digits; null ids are carried
like others; repeated rows of documents or items give one row per (doc_id, item_id) with the highest coverage; empty
tables give an empty result; further columns are ignored, or kept by `clean`, whatever their names.  Of documents
with one id, or none, `clean` drops those whose own text holds an item.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.llm import tokens
from tempestry.llm.bitmaps import bitmap, has_bit, sieve
from tempestry.llm.common import fields, stored, whole_row

#: Scripts written without spaces between words.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"


@dataclass(frozen=True)
class TilingParams:
    min_match: int = 5
    coverage: float = 0.6
    bitmap_bits: int = 1 << 28

    def least_seeds(self, n: int) -> int:
        """The fewest seeds of an item of n tokens in a document that reaches the coverage."""
        return max(1, math.ceil(self.coverage * n / self.min_match - 1e-9))


def plain(text: pa.Array) -> pa.Array:
    """Tokens between single spaces."""
    flat = tokens.plain(text)
    data = flat.buffers()[-1]
    if data is not None and (np.frombuffer(data, np.uint8) >= 0xE0).any():  # all those scripts lie above U+0800
        flat = pc.replace_substring_regex(flat, pattern=UNSPACED, replacement=r" \1 ")
    return flat


def _seeds(rows: DataFrame, p: TilingParams, sizes: tuple[int, ...] = (), known=None) -> DataFrame:
    """(h, id, print, at, n_tokens) of the windows of `rows` (id, text): those of min_match tokens, and either those of
    the shorter `sizes` or, with none given, a shorter text as a whole; with a bitmap `known`, only where the bit is set."""
    kind = rows.schema["id"].dataType.simpleString()
    k = p.min_match

    def windows(h: np.ndarray, starts: np.ndarray) -> tuple:
        parts = [tokens.windows(h, starts, k)]
        for s in range(1, k) if known is None else sizes:
            w, owner, place = tokens.windows(h, starts, s)
            if known is None:  # only texts of this size
                own = np.diff(starts)[owner] == s
                w, owner, place = w[own], owner[own], place[own]
            parts.append((tokens.mixed(w + np.uint64(s)), owner, place))
        return tuple(np.concatenate(c) for c in zip(*parts))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for batch in batches for piece in tokens.pieces(batch)):
            starts, words = tokens.split_words(plain(tokens.text_array(batch.column("text"))))
            h, owner, place = windows(tokens.word_hashes(words), starts)
            if known is not None:
                at = np.flatnonzero(has_bit(h, *known.value))
                h, owner, place = h[at], owner[at], place[at]
            take = pa.array(owner)
            columns = [
                pa.array(h.view(np.int64)),
                batch.column("id").take(take),
                batch.column("print").take(take),
                pa.array(place.astype(np.int32)),
                pa.array(np.diff(starts)[owner].astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "id", "print", "at", "n_tokens"])

    source = rows.select("id", "text", F.xxhash64("text").alias("print"))
    return source.mapInArrow(found, f"h long, id {kind}, print long, at int, n_tokens int")


def matches(h_doc: np.ndarray, at_doc: np.ndarray, h_item: np.ndarray, at_item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (place in the document, place in the item) with equal seeds."""
    order = np.argsort(h_item, kind="stable")
    h_item, at_item = h_item[order], at_item[order]
    a, b = np.searchsorted(h_item, h_doc), np.searchsorted(h_item, h_doc, side="right")
    size = b - a
    i = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.repeat(at_doc, size), at_item[i]


def tiles(at_doc: np.ndarray, at_item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (start in the document, start in the item, length in tokens)."""
    order = np.lexsort((at_doc, at_doc - at_item))
    d, i = at_doc[order], at_item[order]
    cut = np.flatnonzero((np.diff(d) != 1) | (np.diff(d - i) != 0)) + 1
    heap = [(-(len(run) + k - 1), int(run[0]), int(item[0])) for run, item in zip(np.split(d, cut), np.split(i, cut)) if len(run)]
    heapq.heapify(heap)
    marked_doc, marked_item, out = set(), set(), []
    while heap:
        size, a, b = heapq.heappop(heap)
        free = [a + j not in marked_doc and b + j not in marked_item for j in range(-size)]
        if all(free):
            out.append((a, b, -size))
            marked_doc.update(range(a, a - size))
            marked_item.update(range(b, b - size))
            continue
        j = 0
        while j < len(free):
            run = j
            while run < len(free) and free[run]:
                run += 1
            if run - j >= k:
                heapq.heappush(heap, (-(run - j), a + j, b + j))
            j = run + 1
    return out


def _covered(docs: DataFrame, benchmark: DataFrame, p: TilingParams) -> DataFrame:
    """(doc_id, print, item_id, n_tiles, n_matched, n_item_tokens, coverage) of the pairs that can reach the coverage."""
    items = stored(_seeds(benchmark.select(F.col("item_id").alias("id"), "text"), p).distinct())
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap(items, p.bitmap_bits))
    short = tuple(sorted(r.n_tokens for r in items.filter(F.col("n_tokens") < p.min_match).select("n_tokens").distinct().collect()))
    seeds = stored(_seeds(docs.select(F.col("doc_id").alias("id"), "text"), p, short, shipped).distinct())

    # the rarer seeds of every item: all but the most frequent ones, as many as a match may miss
    known = items.select(F.col("id").alias("item"), F.col("print").alias("item_print"), F.col("n_tokens").alias("n"), "h")
    spread = seeds.groupBy("h").agg(F.count("*").alias("often"))
    known = known.distinct().join(spread.hint("merge"), "h")
    kinds = known.groupBy("item", "item_print", "n").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("s"))
    # an item's own seeds: bounded by its text; equal windows count once, so fewer than least_seeds may be there
    total = items.groupBy(F.col("id").alias("i"), F.col("print").alias("ip")).agg(F.count_distinct("h").alias("own"), F.count("*").alias("all"))
    kinds = kinds.join(total.hint("merge"), F.col("item").eqNullSafe(F.col("i")) & (F.col("item_print") == F.col("ip")))
    least = F.greatest(F.lit(1), F.ceil(F.lit(p.coverage) * F.col("n") / p.min_match - 1e-9))
    # a repeated seed stands for several places: without all - own of them
    spare = F.greatest(F.lit(0), least - 1 - (F.col("all") - F.col("own")))
    absent = F.col("own") - F.size("s")  # seeds in no document are the rarest of all
    rare = F.slice("s", F.lit(1), F.greatest(F.lit(0), F.col("own") - spare - absent).cast("int"))
    rare = stored(kinds.select("item", "item_print", F.explode(F.transform(rare, lambda x: x.h)).alias("h")))
    pairs = seeds.join(rare.hint("merge"), "h").select("id", "print", "item", "item_print").distinct()

    # of each pair: the document's places of the item's seeds, then the item's own list
    pairs = stored(pairs)
    mine = seeds.select(F.col("id").alias("d"), F.col("print").alias("dp"), "h", "at")
    both = pairs.join(mine.hint("merge"), F.col("id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("dp")))
    theirs = items.select(F.col("id").alias("i"), F.col("print").alias("ip"), F.col("h").alias("ih")).distinct()
    both = both.join(theirs.hint("merge"), (F.col("h") == F.col("ih")) & F.col("item").eqNullSafe(F.col("i")) & (F.col("item_print") == F.col("ip")), "left_semi")
    both = both.groupBy("id", "print", "item", "item_print").agg(F.collect_list(F.struct("h", "at")).alias("m"))
    lists = items.groupBy(F.col("id").alias("i"), F.col("print").alias("ip")).agg(F.max("n_tokens").alias("n_item_tokens"), F.collect_list(F.struct("h", "at")).alias("l"))
    both = both.join(stored(lists).hint("merge"), F.col("item").eqNullSafe(F.col("i")) & (F.col("item_print") == F.col("ip")))
    k = p.min_match

    @F.pandas_udf("struct<n_tiles:int,n_matched:int>")
    def tiled(document: pd.Series, item: pd.Series, size: pd.Series) -> pd.DataFrame:
        rows = []
        for m, own, n in zip(document, item, size):
            at, at_item = matches(*(np.array([x[c] for x in side], np.int64) for side in (m, own) for c in ("h", "at")))
            found = tiles(at, at_item, min(k, int(n)))
            rows.append((len(found), sum(t[2] for t in found)))
        return pd.DataFrame(rows, columns=["n_tiles", "n_matched"])

    both = both.withColumn("t", tiled("m", "l", "n_item_tokens"))
    return both.select(
        F.col("id").alias("doc_id"), "print", F.col("item").alias("item_id"), "t.n_tiles", "t.n_matched", "n_item_tokens", (F.col("t.n_matched") / F.col("n_item_tokens")).alias("coverage")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, p: TilingParams = TilingParams()) -> DataFrame:
    """(doc_id, item_id, n_tiles, n_matched, n_item_tokens, coverage) of the pairs whose coverage reaches the threshold."""
    found = _covered(docs, benchmark, p).filter(F.col("coverage") >= p.coverage)
    best = F.max_by(F.struct("n_tiles", "n_matched", "n_item_tokens", "coverage"), F.struct("coverage", "n_matched", "n_item_tokens"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, p: TilingParams = TilingParams()) -> DataFrame:
    """`docs` without those that hold a benchmark item."""
    leaks = _covered(docs, benchmark, p).filter(F.col("coverage") >= p.coverage).select(F.col("doc_id").alias("leak"), F.col("print").alias("leak_print")).distinct()
    leaks = stored(leaks)
    rows = docs.select(whole_row(docs), "doc_id", F.xxhash64("text").alias("print"))
    # rows that hold no item for certain aren't shuffled
    may = sieve(leaks.select(F.col("leak_print").alias("h")))(F.col("print"))
    kept = rows.filter(may).join(leaks.hint("merge"), F.col("doc_id").eqNullSafe(F.col("leak")) & (F.col("print") == F.col("leak_print")), "left_anti")
    return kept.select("row").unionByName(rows.filter(~may).select("row")).select(*fields(docs.columns))
