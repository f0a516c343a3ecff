"""Near-duplicate documents: n-gram Jaccard join with Bayesian candidate pruning.

Equal texts are one node, by digest.  Nodes that agree in one of `bands` MinHash bands are joined into
coarse clusters (connected components of star edges, one per band bucket and member).  A cluster is dealt by
hash into blocks of about `block` nodes, and a task compares the nodes of one pair of blocks: pairs that
share a band are candidates; their MinHash values are compared in steps, and a pair is dropped as soon as
the posterior probability (uniform prior) that its similarity reaches the threshold falls below `tolerance`;
the similarity of the rest is computed exactly from the shingle sets.  A task gives, per node, its number of
links and a spanning forest of them, never the pairs, so what leaves a task is linear in its input even for
thousands of near copies.  The final classes are the components of the forests.  Texts are shuffled only where a
bitmap of the cluster's, or the links', digests (32 MB at most) doesn't rule them out.

Words are runs without ASCII white space; shingles are sets of `words` words (a shorter text is one shingle).

Defined results: a null or wordless text is alone in its class and has no links, whatever copies it has;
equal texts are linked; a null doc_id is carried, and does not name a class unless all ids in it are null;
repeated rows are documents of their own; an empty table gives an empty result; `deduplicated` keeps, of
each class, the row of the smallest doc_id (of equal ones any one), with all its columns; further columns, whatever
their names, pass through, and `classes` replaces those named like the ones it adds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.llm import tokens
from tempestry.llm.bitmaps import sieve
from tempestry.llm.common import cut, fields, others, release, stored, whole_row
from tempestry.llm.components import components


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5
    threshold: float = 0.8
    bands: int = 20
    band_rows: int = 4
    step: int = 16
    tolerance: float = 1e-6
    block: int = 256
    seed: int = 5


def shingles(text: pa.Array, p: JaccardParams) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, sorted within a text; where each text starts)."""
    starts, words = tokens.split_words(text)
    h, owner, _ = tokens.windows(tokens.word_hashes(words), starts, p.words, whole_if_short=True)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(text) + 1))


def signatures(h: np.ndarray, starts: np.ndarray, p: JaccardParams) -> np.ndarray:
    """MinHash values, one row a text; texts without shingles have none to agree on."""
    rng = np.random.RandomState(p.seed)
    n = p.bands * p.band_rows
    factor = rng.randint(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.randint(0, 2**31, n).astype(np.uint32)
    out = np.zeros((len(starts) - 1, n), np.uint32)
    full = np.flatnonzero(np.diff(starts) > 0)
    x = (h >> np.uint64(32)).astype(np.uint32)
    if len(full):
        for j in range(n):
            out[full, j] = np.minimum.reduceat(x * factor[j] + shift[j], starts[full])
    return out


def band_keys(sig: np.ndarray, p: JaccardParams) -> np.ndarray:
    """A 64-bit key for every text and band."""
    grouped = sig.reshape(len(sig), p.bands, p.band_rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for r in range(p.band_rows):
        key = tokens.mixed(key * tokens.BASE + grouped[:, :, r])
    return key


def least_matches(p: JaccardParams) -> list[int]:
    """For 1 step, 2 steps, ...: the fewest agreeing MinHash values at which a pair may still be similar.

    With m of n agreeing and a uniform prior the similarity is Beta(m + 1, n - m + 1); its upper tail at the
    threshold is a binomial sum.
    """
    t, out = p.threshold, []
    for n in range(p.step, p.bands * p.band_rows + 1, p.step):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= p.tolerance:
                out.append(m)
                break
    return out


def candidate_pairs(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of one group that agree in a band key, each once."""
    n, found = len(keys), np.zeros(0, np.int64)
    mixed_group = tokens.mixed(group.astype(np.uint64) + np.uint64(1))
    for column in keys.T:
        key = column ^ mixed_group
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        codes = [found]
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                members = np.sort(order[a:b])
                i, j = np.triu_indices(b - a, 1)
                codes.append(members[i] * n + members[j])
        if len(codes) > 1:
            found = np.unique(np.concatenate(codes))
    return np.divmod(found, max(n, 1))


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, p: JaccardParams) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no step of the Bayesian comparison drops."""
    agree = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches(p)):
        part = slice(k * p.step, (k + 1) * p.step)
        for a in range(0, len(i), 65536):
            cutout = slice(a, a + 65536)
            agree[cutout] += (sig[i[cutout], part] == sig[j[cutout], part]).sum(1, dtype=np.int32)
        ok = agree >= least
        i, j, agree = i[ok], j[ok], agree[ok]
    return i, j


def overlap(h: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray, wide: int = 8192) -> np.ndarray:
    """Exact sizes of the intersections of sets i and j."""
    members = np.unique(np.concatenate([i, j]))
    if len(i) < 4 * len(members):
        return np.array([np.intersect1d(h[starts[a] : starts[a + 1]], h[starts[b] : starts[b + 1]], assume_unique=True).size for a, b in zip(i, j)], np.int64)
    # many pairs among few sets: products of 0/1 matrices, over slices of the shingles that two sets share
    size = starts[members + 1] - starts[members]
    row = np.repeat(np.arange(len(members)), size)
    at = np.repeat(starts[members] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    _, column, count = np.unique(h[at], return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(members), len(members)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [first, first + wide])
        part = np.zeros((len(members), wide), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        both += part @ part.T
    return both[np.searchsorted(members, i), np.searchsorted(members, j)].astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root = root[root]
        if (root == before).all():
            return root


def _first_of_each(rows: pa.Table) -> pa.Array:
    """Places of the first row of each group and node; rows are sorted by both."""
    g, node = rows.column("g").to_numpy(), rows.column("node").to_pylist()
    return pa.array([k for k in range(len(g)) if not k or g[k] != g[k - 1] or node[k] != node[k - 1]], pa.int64())


def _compare(rows: pa.Table, p: JaccardParams) -> pa.RecordBatch:
    """Links and forest edges of whole groups (comp, a, b): block a of a component against block b."""
    keep = _first_of_each(rows)
    rows = rows.take(keep) if len(keep) < rows.num_rows else rows
    group = rows.column("g").to_numpy()
    sides = rows.column("side").to_numpy()
    copies = rows.column("copies").to_numpy()
    nodes = rows.column("node").combine_chunks()
    _, group = np.unique(group, return_inverse=True)
    h, starts = shingles(tokens.text_array(rows.column("text")), p)
    sig = signatures(h, starts, p)
    i, j = candidate_pairs(band_keys(sig, p), group)
    ok = (sides[i] != sides[j]) | (sides[i] == 2)  # 2: a block against itself
    i, j = surviving(sig, i[ok], j[ok], p)
    n = len(group)
    both = np.zeros(len(i), np.int64)
    order = np.argsort(group[i], kind="stable")
    i, j = i[order], j[order]
    for pick in np.split(np.arange(len(i)), np.flatnonzero(np.diff(group[i])) + 1) if len(i) else []:
        both[pick] = overlap(h, starts, i[pick], j[pick])
    size = np.diff(starts)
    good = both >= p.threshold * (size[i] + size[j] - both) - 1e-9
    i, j = i[good], j[good]
    links = np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
    root = _roots(n, i, j)
    at = pa.array(np.flatnonzero(links > 0))
    return pa.RecordBatch.from_arrays([nodes.take(at), pa.array(links).take(at), nodes.take(pa.array(root)).take(at)], names=["node", "links", "root"])


def _in_groups(p: JaccardParams, limit: int = 16 << 20):
    """Rows sorted by g in; whole groups compared, several at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in (piece for batch in batches for piece in tokens.pieces(batch)):
            held.append(batch)
            size += batch.nbytes
            g = batch.column("g").to_numpy(zero_copy_only=False)
            if size >= limit and (len(held) > 1 or g[0] != g[-1]):
                rows = pa.Table.from_batches(held)
                g = rows.column("g").to_numpy()
                last = int(np.flatnonzero(g == g[-1])[0])
                if last:
                    yield _compare(rows.slice(0, last), p)
                    held, size = rows.slice(last).combine_chunks().to_batches(), rows.slice(last).nbytes
        if held:
            yield _compare(pa.Table.from_batches(held), p)

    return run


def links(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """(node, class, n_links, n_copies, first) of every distinct text that has a link.

    node and class are text digests, class the smallest of its class; first is the smallest doc_id in the class.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for batch in batches for piece in tokens.pieces(batch)):
            h, starts = shingles(tokens.text_array(batch.column("text")), p)
            full = np.flatnonzero(np.diff(starts) > 0)
            keys = band_keys(signatures(h, starts, p), p)[full].view(np.int64)
            take = pa.array(full)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(full) * p.bands + 1, p.bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("node").take(take), lists], names=["doc_id", "node", "bands"])

    named = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("node"))
    found = named.mapInArrow(banded, f"doc_id {kind}, node binary, bands array<long>")
    # copies of a text agree in everything: partial aggregation leaves one row a task of each
    nodes = stored(found.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")))

    members = nodes.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("key", "a")
    edges = members.join(buckets.hint("merge"), "key").select("a", F.col("node").alias("b"))
    coarse = cut(components(edges))

    # Only clusters of several blocks need their size.  It is computed before the join, whose left side, a row a node,
    # adaptive execution then splits where one cluster holds a large share of all nodes.
    sizes = coarse.groupBy("root").agg(F.ceil(F.count("*") / F.lit(p.block)).cast("int").alias("m"))
    sizes = cut(sizes.filter("m > 1"))
    placed = coarse.join(sizes.hint("merge"), "root", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    placed = placed.join(nodes.select("node", "doc_id", "copies").hint("merge"), "node")
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("m").cast("long")).cast("int"))
    # only texts that may lie in a cluster are shuffled
    text = named.filter(sieve(coarse.select(F.xxhash64("node").alias("h")))(F.xxhash64("node"))).withColumnsRenamed({"doc_id": "_doc", "node": "_node"})
    # One copy of each text goes on; repeated rows of it meet in the block and are dropped there by digest.
    placed = text.join(placed.hint("merge"), (F.col("_node") == F.col("node")) & F.col("_doc").eqNullSafe(F.col("doc_id")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    work = placed.select(
        F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), side.cast("int").alias("side"), "node", F.col("copies").cast("long").alias("copies"), "text"
    )
    work = work.repartition("g").sortWithinPartitions("g", "node")
    got = cut(work.mapInArrow(_in_groups(p), "node binary, links long, root binary"))

    del members, buckets, edges, coarse, sizes, placed, text, work
    release(docs.sparkSession)  # the shuffles of bands and texts have done their work
    classes = components(got.select(F.col("root").alias("a"), F.col("node").alias("b")))
    counted = got.groupBy("node").agg(F.sum("links").alias("links"))
    out = nodes.select("node", "doc_id", "copies").join(counted.hint("merge"), "node", "left").join(classes.hint("merge"), "node", "left")
    out = out.filter("copies > 1 OR root IS NOT NULL")
    out = cut(out.select("node", F.coalesce("root", "node").alias("class"), "doc_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    first = cut(out.groupBy("class").agg(F.min("doc_id").alias("first")))
    return out.join(first.hint("merge"), "class").select("node", "class", "n_links", F.col("copies").alias("n_copies"), "first")


def _matched(docs: DataFrame, p: JaccardParams) -> DataFrame:
    """(row, doc_id, and of texts with a link: class, n_links, n_copies, first) of every row of `docs`."""
    known = cut(links(docs.select("doc_id", "text"), p))
    rows = docs.select(whole_row(docs), "doc_id", F.unhex(F.md5("text")).alias("node"))
    # rows that have no link for certain aren't shuffled
    may = sieve(known.select(F.xxhash64("node").alias("h")))(F.xxhash64("node"))
    return rows.filter(may).join(known.hint("merge"), "node", "left").unionByName(rows.filter(~may), allowMissingColumns=True)


def classes(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """`docs` with class_id (the smallest doc_id of its class), n_links and n_copies."""
    return _matched(docs, p).select(
        *fields(others(docs, "class_id", "n_links", "n_copies")),
        F.coalesce("first", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def deduplicated(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """One row of each class."""
    rows = _matched(docs, p)
    alone = rows.filter(F.col("class").isNull()).select("row")
    kept = rows.filter(F.col("class").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first")))
    # the same id, or none, may come with several rows of a class: one stays
    kept = kept.groupBy("class").agg(F.first("row").alias("row")).select("row")
    return alone.unionByName(kept).select(*fields(docs.columns))
