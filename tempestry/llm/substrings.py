"""Exact removal of repeated byte strings by bucket-pointer refinement over a sparse suffix array.

Which positions.  Every window of `length` bytes names one position, its smallest q-gram (the leftmost of
equal ones).  Equal windows name the same position relative to themselves, so only named positions (about
two in length - q) have to be sorted, and the windows of a position form one stretch of text, its segment.

Which order.  Positions start in buckets of equal q-grams.  The identifier of a bucket of depth 2d comes from
the identifiers of the buckets of depth d at a position and at the later offset d, beginning with the bytes
themselves up to depth 8; it serves at all offsets and in all later rounds.  Round one splits buckets by the identifiers over the whole segment: equal
segments meet, the one in the smallest document stands for them, and the others are removed.  Round two splits
by the identifiers next to the q-gram on either side, which drops buckets that agree in little more than it.
Round three splits what is left by the identifiers of the windows themselves.  Buckets of a single document drop
out after each round.  Identifiers need no global numbering: they are pairs of 64-bit hashes of two families, which
together tell any two strings of 16 bytes apart and are independent beyond.  Round one compares 80 bits of them
within a bucket of the q-gram (24 bits more), round three 96; bytes aren't compared afterwards.  In a bucket of
10^9 different segments, a wrong removal has a probability of 4e-7.

How it scales.  A task ships its positions as one packed row per bucket range, equal segments of one slice of
text already merged to the smallest document, so a passage that a third of all documents share is one entry a
slice; undecided windows are merged likewise.  What one task holds is a bucket range; at the edge of a passage that
many documents share, segments differ in every document, and their q-gram's bucket has an entry of each of these
documents in one range.  Texts are shuffled once to meet their spans; only texts with stretches undecided after round two go on.

Defined results: a null text is empty; a null doc_id counts as larger than all others (but for 2^63 - 1, its equal);
rows of the same doc_id, or of none, are no smaller documents to one another, and are told apart by a hash of their
text (96 bits where the id is null, else 32); strings repeated only inside one document stay; texts shorter than
`length` stay; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.llm import tokens
from tempestry.llm.common import release, stored

LAST = np.iinfo(np.int64).max
U = np.uint64
OTHER = U(0xD6E8FEB86659FD92)


@dataclass(frozen=True)
class SubstringParams:
    length: int = 50
    ranges: int = 2  # bucket ranges for each shuffle partition
    slice_bytes: int = 2 << 20

    @property
    def gram(self) -> int:
        return 16

    @property
    def beside(self) -> int:
        """Bytes on one side of the q-gram that every window holds on that side or the other."""
        return (self.length - self.gram) // 2


def identifiers(x: np.ndarray) -> dict[str, np.ndarray]:
    """Bucket identifiers at every position: a16, and a32 and b32 of two families, each from pairs of the depth before."""

    def later(h: np.ndarray, d: int) -> np.ndarray:
        out = np.zeros_like(h)
        out[: max(len(h) - d, 0)] = h[d:]
        return out

    h = x.astype(U)
    for d in (1, 2, 4):  # the eight bytes themselves
        h |= later(h, d) << U(8 * d)
    next8 = later(h, 8)
    a16 = tokens.mixed(h * tokens.BASE + next8)
    # BASE is odd and OTHER even, so both values agree only where all sixteen bytes do
    b16 = tokens.mixed(h * OTHER + next8)
    return {"a16": a16, "a32": tokens.mixed(a16 * tokens.BASE + later(a16, 16)), "b32": tokens.mixed(b16 * tokens.MIX + later(b16, 16))}


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    r, d = a.copy(), 1
    while d < w:
        step = min(d, w - d)
        r[: max(len(r) - step, 0)] = np.minimum(r[: max(len(r) - step, 0)], r[step:])
        d += step
    return r


@dataclass
class Slice:
    """Named positions of a slice of texts: at, first and number of windows, document, identifiers."""

    ids: dict
    starts: np.ndarray
    at: np.ndarray
    first: np.ndarray
    count: np.ndarray
    owner: np.ndarray


def positions(texts: list[bytes], p: SubstringParams) -> Slice:
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    x = np.frombuffer(b"".join(texts), np.uint8)
    ids = identifiers(x)
    gram = ids["a16"]
    least = _sliding_min((gram & ~U(0xFFFFFFFF)) | np.arange(len(x), dtype=U), p.length - p.gram + 1)
    parts = [np.arange(a, b - p.length + 1) for a, b in zip(starts[:-1], starts[1:]) if b - a >= p.length]
    window = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    at = (least[window] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = at[1:] != at[:-1]
    k = np.flatnonzero(new)
    first = window[k]
    return Slice(ids, starts, at[k], first, np.diff(np.append(k, len(window))), np.searchsorted(starts, first, side="right") - 1)


def _keys(s: Slice, p: SubstringParams) -> tuple[np.ndarray, ...]:
    """(q-gram bucket, two identifiers of the segment, those of the bytes before and of the bytes after)."""
    i16 = s.ids["a16"]
    n = len(i16) - 1
    last = s.first + s.count - 1
    whole = []
    for i32 in (s.ids["a32"], s.ids["b32"]):
        h = i32[s.first]
        for k in (s.first + p.length - 32, last, last + p.length - 32):
            h = tokens.mixed(h * tokens.BASE + i32[k])
        whole.append(tokens.mixed(h * tokens.BASE + (s.at - s.first).astype(U) * U(64) + s.count.astype(U)))
    a = np.maximum(s.at - p.beside, 0)
    before = tokens.mixed(i16[a] * tokens.BASE + i16[a + p.beside - p.gram])
    b = np.minimum(s.at + p.gram, n)
    after = tokens.mixed(i16[b] * tokens.BASE + i16[np.minimum(b + p.beside - p.gram, n)])
    return i16[s.at], *whole, before, after


KEYS = ["doc_id", "lost", "print"]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Ids (of rows without one a hash of the text), whether there is none, prints."""
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in KEYS)


def _rank(ids: np.ndarray, lost: np.ndarray) -> np.ndarray:
    return np.where(lost, LAST, ids)


def _opened(body: bytes, size: int) -> bytes:
    return pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one for the way to their spans."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        bodies = pa.array([pa.compress(t, codec="zstd", asbytes=True) if t else b"" for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), pa.array([len(t) for t in texts], pa.int64()), bodies], names=[*KEYS, "n_bytes", "body"])


PACKED = "p int, n int, docs binary, lost binary, prints binary, doc binary, first binary, at binary, count binary, key binary, a binary, b binary"


def _squeezed(v: np.ndarray) -> bytes:
    """Small steps between neighbours, byte planes apart, compressed."""
    steps = np.diff(v.astype("<i8"), prepend=0)
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _loosened(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8")[:, 0])


def _short(v: np.ndarray, size: int) -> bytes:
    """The lowest `size` bytes of every value."""
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _long(b: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(b) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(b, np.uint8).reshape(-1, size)
    return out.view("<u8")[:, 0]


def _pack(ids, lost, prints, part, doc, first, at, count, key, a, b, sizes) -> Iterator[pa.RecordBatch]:
    """Entries dealt by range into one row each, column by column; sizes: bytes kept of key, a and b."""
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0, [True]])) if len(order) else []
    rows = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        k = order[lo:hi]
        used, local = np.unique(doc[k], return_inverse=True)
        hashes = [_short(v[k], size) if size else b"" for v, size in zip((key, a, b), sizes)]
        rows.append((int(part[k[0]]), len(k), _squeezed(ids[used]), _squeezed(lost[used]), prints[used].tobytes(), *map(_squeezed, (local, first[k], at[k], count[k])), *hashes))
    if rows:
        names = [c.split()[0] for c in PACKED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j < 2 else pa.binary()) for j, c in enumerate(zip(*rows))], names=names)


def _unpack(rows: list[dict], sizes) -> list:
    """(doc_id, lost, print), first, at, count, key, a, b of all entries of a range."""
    cols: list[list] = [[] for _ in range(9)]
    for r in rows:
        local = _loosened(r["doc"], r["n"])
        prints = np.frombuffer(r["prints"], np.int32)
        cols[0].append(_loosened(r["docs"], len(prints))[local])
        cols[1].append(_loosened(r["lost"], len(prints))[local] > 0)
        cols[2].append(prints[local])
        for c, name in zip(cols[3:6], ("first", "at", "count")):
            c.append(_loosened(r[name], r["n"]))
        for c, name, size in zip(cols[6:], ("key", "a", "b"), sizes):
            c.append(_long(r[name], size) if size else np.zeros(r["n"], U))
    flat = [np.concatenate(c) for c in cols]
    return [tuple(flat[:3]), *flat[3:]]


def _by_range(batches: Iterator[pa.RecordBatch], work) -> Iterator[tuple]:
    """`work` over the rows of each range; they come sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["p"] != held[0]["p"]:
                yield from work(held)
                held = []
            held.append(row)
    if held:
        yield from work(held)


SPANS = "doc_id long, lost boolean, print int, spans binary"
SPAN = np.dtype([("start", "<u4"), ("size", "<u4"), ("kind", "u1")])


#: Bytes kept in rounds one and two of the q-gram's identifier, the segment's first, and its second (two) with one each
#: of its neighbours'; in round three of the windows'.
ROUND_ONE, ROUND_THREE = (3, 8, 4), (0, 8, 4)
REMOVED, OPEN = 1, 2


def _spans(text: tuple, k: np.ndarray, start, stop, kind) -> tuple:
    out = np.zeros(len(k), SPAN)
    out["start"], out["size"], out["kind"] = start, stop - start, kind
    return *(c[k] for c in text), out


def _by_text(found: Iterator[tuple], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Spans of many ranges put together, one row a text."""
    held, n = [], 0
    for part in found:
        held.append(part)
        n += len(part[0])
        if n >= limit:
            yield _text_rows(held)
            held, n = [], 0
    if n:
        yield _text_rows(held)


def _text_rows(held: list[tuple]) -> pa.RecordBatch:
    *text, spans = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((spans["start"], *reversed(text)))
    text, spans = [c[order] for c in text], spans[order]
    first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in text], axis=0)]))
    rows = [spans[a:b].tobytes() for a, b in zip(first, [*first[1:], len(spans)])]
    doc, lost, prints = (c[first] for c in text)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lost), pa.array(prints.astype(np.int32)), pa.array(rows, pa.binary())], names=[*KEYS, "spans"])


def _read_spans(lists: list[bytes] | None) -> np.ndarray:
    """(start, stop, kind) rows."""
    got = np.frombuffer(b"".join(lists or []), SPAN)
    start = got["start"].astype(np.int64)
    return np.stack([start, start + got["size"], got["kind"]], 1)


def _smallest(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For every entry, the smallest document among those with equal keys."""
    order = np.lexsort((doc, *keys))
    new = np.zeros(len(doc), bool)
    if len(doc):
        new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
    out = np.empty_like(doc)
    out[order] = least
    return out


def _shared(mask: np.ndarray, whole: tuple, *keys: np.ndarray) -> np.ndarray:
    """Among entries of the mask: whether equal keys come with different segments."""
    out = np.zeros(len(mask), bool)
    k = np.flatnonzero(mask)
    if not len(k):
        return out
    order = k[np.lexsort((*[x[k] for x in whole], *[x[k] for x in keys]))]
    same = np.ones(len(order) - 1, bool)
    for x in keys:
        same &= x[order][1:] == x[order][:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    other = np.any([x[order][1:] != x[order][:-1] for x in whole], axis=0)
    differs = np.bincount(group[1:], same & other, group[-1] + 1) > 0
    out[order] = differs[group]
    return out


def _round_one(p: SubstringParams, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for batch in batches for piece in tokens.pieces(batch, limit=p.slice_bytes)):
            ids, lost, prints = _columns(batch)
            s = positions(batch.column("text").cast(pa.binary()).to_pylist(), p)
            key, whole, more, before, after = _keys(s, p)
            rank = _rank(ids, lost)[s.owner]
            stays = rank <= _smallest(rank, whole, more, key)  # merged within the slice: others are removed here
            b = (more >> U(48) << U(16)) | (before >> U(56) << U(8)) | (after >> U(56))
            part = ((key & U(0xFFFFFFFF)) % U(ranges)).astype(np.int64)
            key = key >> U(40)
            first, at = s.first - s.starts[s.owner], s.at - s.first
            k = np.flatnonzero(stays)
            yield from _pack(ids, lost, prints, part[k], s.owner[k], first[k], at[k], s.count[k], key[k], whole[k], b[k], ROUND_ONE)
            # known spans ride along under a negative range
            k = np.flatnonzero(~stays)
            yield from _pack(ids, lost, prints, -1 - part[k], s.owner[k], first[k], at[k], s.count[k], key[k], whole[k], b[k], (0, 0, 0))

    return run


def _round_two(p: SubstringParams):
    def work(rows: list[dict]) -> Iterator[tuple]:
        known = rows[0]["p"] < 0
        text, first, offset, count, key, whole, b = _unpack(rows, (0, 0, 0) if known else ROUND_ONE)
        whole = (whole, b >> U(16))
        rank = _rank(*text[:2])
        removed = np.ones(len(rank), bool) if known else rank > _smallest(rank, *whole, key)
        k = np.flatnonzero(removed)
        yield _spans(text, k, first[k], first[k] + count[k] + p.length - 1, REMOVED)
        if known:
            return
        # the smallest ones of different segments in a bucket may still share windows
        rest = ~removed
        low = offset - count + 1  # the q-gram's offset in the last window; it falls by one a window
        left = _shared(rest & (offset >= p.beside), whole, key, (b >> U(8)) & U(0xFF))
        right = _shared(rest & (low <= p.length - p.gram - p.beside), whole, key, b & U(0xFF))
        k = np.flatnonzero(left | right)
        # windows whose q-gram stands at `beside` or later hold the bytes before it, the others those after
        until = np.where(right, count, np.minimum(count, offset - p.beside + 1))[k]
        since = np.where(left, 0, np.maximum(0, offset - (p.length - p.gram - p.beside)))[k]
        yield _spans(text, k, first[k] + since, first[k] + until, OPEN)

    return lambda batches: _by_text(_by_range(batches, work))


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


def _kept(text: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[int, int, str]:
    parts, at = [], 0
    for a, b in zip(start.tolist(), stop.tolist()):
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    kept = b"".join(parts)
    return len(text) - len(kept), len(start), hashlib.sha256(kept).hexdigest()


DONE = "doc_id long, lost boolean, print int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, body binary, spans binary, open binary"


def _settle(p: SubstringParams):
    """Texts with their spans: rows without undecided stretches are done, others keep text and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for batch in batches for piece in tokens.pieces(batch, "body", p.slice_bytes)):
            out = []
            for *text, size, body, spans in zip(*(batch.column(c).to_pylist() for c in (*KEYS, "n_bytes", "body", "spans"))):
                data = _opened(body, size)
                got = _read_spans(spans)
                sure = got[:, 2] == REMOVED
                start, stop = _merged(got[sure, 0], got[sure, 1])
                known = np.stack([start, stop], 1)
                wait = got[~sure, :2]
                removed, n, digest = _kept(data, start, stop) if not len(wait) else (None, None, None)
                out.append((*text, len(data), removed, n, digest, body if len(wait) else None, known.astype("<i4").tobytes(), wait.astype("<i4").tobytes()))
            kinds = [pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * 3, pa.string(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in DONE.split(", ")])

    return run


def _windows(p: SubstringParams, ranges: int):
    """Round three: the undecided windows of every text, dealt by their q-gram bucket, so that neighbours mostly meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for batch in batches for piece in tokens.pieces(batch, "body", p.slice_bytes // 4)):
            ids, lost, prints = _columns(batch)
            texts = [_opened(b, n) for b, n in zip(batch.column("body").to_pylist(), batch.column("n_bytes").to_pylist())]
            s = positions(texts, p)
            i32, starts = s.ids, s.starts
            open_ = [np.frombuffer(b, "<i4").reshape(-1, 2) for b in batch.column("open").to_pylist()]
            doc = np.repeat(np.arange(len(texts)), [len(o) for o in open_])
            o = np.concatenate(open_).astype(np.int64)
            size = o[:, 1] - o[:, 0]
            at = np.repeat(o[:, 0] + starts[doc] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            doc = np.repeat(doc, size)
            a = tokens.mixed(i32["a32"][at] * tokens.BASE + i32["a32"][at + p.length - 32])
            b = tokens.mixed(i32["b32"][at] * tokens.BASE + i32["b32"][at + p.length - 32]) >> U(32)
            key = i32["a16"][s.at[np.searchsorted(s.first, at, side="right") - 1]]
            part = ((key & U(0xFFFFFFFF)) % U(ranges)).astype(np.int64)
            at, none = at - starts[doc], np.zeros(len(at), np.int64)
            rank = _rank(ids, lost)[doc]
            stays = rank <= _smallest(rank, a, b)  # merged within the slice
            for k, p_of, sizes in ((np.flatnonzero(stays), part, ROUND_THREE), (np.flatnonzero(~stays), -1 - part, (0, 0, 0))):
                yield from _pack(ids, lost, prints, p_of[k], doc[k], at[k], none[k], none[k], a[k], a[k], b[k], sizes)

    return run


def _round_three(p: SubstringParams):
    def work(rows: list[dict]) -> Iterator[tuple]:
        known = rows[0]["p"] < 0
        text, at, _, _, _, a, b = _unpack(rows, (0, 0, 0) if known else ROUND_THREE)
        rank = _rank(*text[:2])
        k = np.arange(len(at)) if known else np.flatnonzero(rank > _smallest(rank, a, b))
        k = k[np.lexsort((at[k], *(c[k] for c in reversed(text))))]
        new = np.ones(len(k), bool)
        new[1:] = np.any([c[k][1:] != c[k][:-1] for c in text], axis=0) | (at[k][1:] > at[k][:-1] + 1)
        i = np.flatnonzero(new)
        last = np.append(i[1:], len(k)) - 1
        yield _spans(text, k[i], at[k[i]], at[k[last]] + p.length if len(k) else at[k[i]], REMOVED)

    return lambda batches: _by_text(_by_range(batches, work))


def _final(p: SubstringParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for batch in batches for piece in tokens.pieces(batch, "body", p.slice_bytes)):
            out = []
            for doc, lost, n, body, known, more in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lost", "n_bytes", "body", "spans", "more"))):
                spans = np.concatenate([np.frombuffer(known, "<i4").reshape(-1, 2).astype(np.int64), _read_spans(more)[:, :2]])
                out.append((doc, lost, n, *_kept(_opened(body, n), *_merged(spans[:, 0], spans[:, 1]))))
            kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "lost", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated(docs: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = partitions * p.ranges
    text = F.coalesce("text", F.lit(""))
    number = F.col("doc_id").cast("long")
    named = docs.select(
        F.coalesce(number, F.xxhash64(text)).alias("doc_id"), number.isNull().alias("lost"), F.hash(text, F.length(text)).alias("print"), text.alias("text")
    )

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(partitions, "p").sortWithinPartitions("p")

    spans = dealt(named.mapInArrow(_round_one(p, ranges), PACKED)).mapInArrow(_round_two(p), SPANS)
    lists = spans.groupBy(*KEYS).agg(F.collect_list("spans").alias("spans"))
    bodies = named.mapInArrow(_bodies, "doc_id long, lost boolean, print int, n_bytes long, body binary")
    met = bodies.join(lists.hint("merge"), KEYS, "left").select(*KEYS, "n_bytes", "body", "spans")
    settled = stored(met.mapInArrow(_settle(p), DONE))
    del spans, lists, met
    release(spark)  # the shuffles of rounds one and two have done their work

    waiting = settled.filter(F.col("body").isNotNull())
    more = dealt(waiting.mapInArrow(_windows(p, ranges), PACKED)).mapInArrow(_round_three(p), SPANS)
    more = more.groupBy(*KEYS).agg(F.collect_list("spans").alias("more"))
    late = waiting.join(more.hint("merge"), KEYS, "left").select("doc_id", "lost", "n_bytes", "body", "spans", "more")
    late = late.mapInArrow(_final(p), "doc_id long, lost boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    done = settled.filter(F.col("body").isNull()).select("doc_id", "lost", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.unionByName(late).withColumn("doc_id", F.when(~F.col("lost"), F.col("doc_id"))).drop("lost")
