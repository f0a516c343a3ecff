"""Fill-in-the-middle transformation, with cuts located in memoized content-defined chunks.

1. A text's UTF-8 bytes are chunked where a rolling hash of the last 32 bytes meets a mask, so that a passage which
   many documents share falls into the same chunks wherever it stands.
2. Every chunk has a summary: its bytes, its code points, its first and last bytes, whether it holds a sentinel.
   Summaries combine, so what stands at a chunk's boundary is judged without either chunk's inside.  Each task keeps
   them in a content cache; a hit counts only if the cached bytes are those of the chunk.
3. Running sums of the chunks' code points say in which chunk each cut falls; only there are places looked up.

Which units a document's cuts take, and its form, come from the hash of its id, so that every run and every task
agrees.  Nothing is shuffled: one narrow pass over the rows, whatever groups of copies they hold.

Defined results: a null text is empty; an empty text, or one with a sentinel of the given ones, stays plain; a null
doc_id hashes as an empty one; repeated rows are transformed alike; equal cuts leave an empty middle; a very long text
is chunked in segments of `segment` bytes, so that beside the row itself memory is bounded, and the cache holds
`cache_bytes` at most; an empty table gives an empty result; other columns stay, ahead of the made ones, but for those
of the same names (case aside), which are replaced.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tempestry.llm import tokens
from tempestry.llm.common import others


@dataclass(frozen=True)
class MiddleParams:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 1
    moved_percent: int = 90  # of the texts that may be cut
    spm_percent: int = 20  # of those
    mask: int = 0x1FF  # a boundary every 512 bytes or so
    least: int = 64
    most: int = 8192
    segment: int = 1 << 20
    cache_bytes: int = 32 << 20


MADE = "n long, form string, prefix_chars long, middle_chars long, output string"
#: Bytes that the rolling hash sees, its shift per byte being one bit of 32.
WINDOW = 32
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the 32 bytes up to each place: the sum of gear[byte] << distance, in 32 bits, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunk_ends(data: bytes, p: MiddleParams = MiddleParams()) -> list[int]:
    """Ends of the chunks of a text, of `least` to `most` bytes each but the last."""
    ends, start, n = [], 0, len(data)
    for a in range(0, n, p.segment):
        from_ = max(0, a - WINDOW + 1)
        h = rolling(np.frombuffer(data, np.uint8, min(a + p.segment, n) - from_, from_))[a - from_ :]
        for end in (np.flatnonzero((h & p.mask) == 0) + a + 1).tolist():
            while end - start > p.most:
                start += p.most
                ends.append(start)
            if end - start >= p.least:
                ends.append(end)
                start = end
    while n - start > p.most:
        start += p.most
        ends.append(start)
    if n > start:
        ends.append(n)
    return ends


class Chunks:
    """Summaries of chunks by content, the least recently used ones forgotten beyond a number of bytes."""

    def __init__(self, sentinels: tuple[bytes, ...], limit: int):
        self.sentinels, self.limit = sentinels, limit
        self.reach = max(map(len, sentinels)) - 1  # bytes that an occurrence may leave on either side of a boundary
        self.held: OrderedDict[int, tuple] = OrderedDict()
        self.bytes = self.hits = 0

    def summary(self, chunk: bytes) -> tuple:
        """(chunk, code points that begin in it, has a sentinel, first bytes, last bytes)."""
        key = hash(chunk)
        found = self.held.get(key)
        if found is not None and found[0] == chunk:  # the same content, not the same hash
            self.held.move_to_end(key)
            self.hits += 1
            return found
        made = (chunk, leads(chunk), any(s in chunk for s in self.sentinels), chunk[: self.reach], chunk[-self.reach :])
        if found is not None:
            self.bytes -= len(found[0])
        self.held[key] = made
        self.bytes += len(chunk)
        while self.bytes > self.limit:
            self.bytes -= len(self.held.popitem(last=False)[1][0])
        return made

    def of(self, data: bytes, p: MiddleParams) -> tuple[list[int], np.ndarray, bool]:
        """(chunk starts, code points before each chunk and in all, whether any sentinel stands in the text)."""
        starts, counts, special, last, a = [], [0], False, b"", 0
        for b in chunk_ends(data, p):
            chunk, n, inside, first, end = self.summary(data[a:b])
            special = special or inside or any(s in last + first for s in self.sentinels)
            last = (last + end)[-self.reach :]  # of all so far: a chunk may be shorter than the reach
            starts.append(a)
            counts.append(counts[-1] + n)
            a = b
        return starts, np.array(counts, np.int64), special


def leads(chunk: bytes) -> int:
    """Code points that begin in a piece of UTF-8."""
    return int(np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80))


def place(data: bytes, starts: list[int], counts: np.ndarray, unit: int) -> int:
    """The byte at which code point `unit` begins; only the chunk that holds it is looked into."""
    if unit >= counts[-1]:
        return len(data)
    k = int(np.searchsorted(counts, unit, side="right")) - 1
    end = starts[k + 1] if k + 1 < len(starts) else len(data)
    inside = np.frombuffer(data, np.uint8, end - starts[k], starts[k])
    return starts[k] + int(np.flatnonzero((inside & 0xC0) != 0x80)[unit - int(counts[k])])


def transform(data: bytes, doc_id, chunks: Chunks, p: MiddleParams) -> tuple:
    """(code points, form, code points of the prefix, of the middle, output) of one text."""
    digest = hashlib.sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    starts, counts, special = chunks.of(data, p)
    n = int(counts[-1])
    if not n or special or h[2] % 100 >= p.moved_percent:
        return n, "plain", None, None, data
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = place(data, starts, counts, first), place(data, starts, counts, second)
    P, S, M = p.prefix.encode(), p.suffix.encode(), p.middle.encode()
    head, middle, rest = data[:a], data[a:b], data[b:]
    if h[3] % 100 < p.spm_percent:
        return n, "spm", first, second - first, S + rest + P + head + M + middle
    return n, "psm", first, second - first, P + head + S + rest + M + middle


def transformed(docs: DataFrame, p: MiddleParams = MiddleParams()) -> DataFrame:
    """Every row of `docs` (doc_id, text, ...) with n, form, prefix_chars, middle_chars and output, the text left out."""
    schema = StructType.fromDDL(MADE)
    keep = others(docs, *schema.names, "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], "text")
    out = StructType([*rows.drop("text").schema.fields, *schema.fields])
    arrow = to_arrow_schema(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(tuple(s.encode() for s in (p.prefix, p.suffix, p.middle)), p.cache_bytes)
        for batch in batches:
            for piece in tokens.pieces(batch):
                ids = piece.column(keep.index("doc_id")).to_pylist()
                texts = tokens.text_array(piece.column(len(keep))).cast(pa.large_binary())
                made = [transform(t.as_py(), i, chunks, p) for t, i in zip(texts, ids)]
                n, form, before, inside, output = zip(*made)
                columns = [pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([piece.column(k).cast(arrow[k].type) for k in range(len(keep))] + columns, schema=arrow)

    return rows.mapInArrow(work, out)


def restored(output: Column, form: Column, p: MiddleParams = MiddleParams()) -> Column:
    """The text again, from output and form alone.  No text that was moved holds a sentinel, so the first ones are ours."""
    ends = {"psm": (p.prefix, p.suffix), "spm": (p.suffix, p.prefix)}

    def parts(kind: str) -> list[Column]:
        lead, mark = ends[kind]
        rest = F.substring(output, F.lit(len(lead) + 1), F.length(output))
        cut = F.instr(rest, mark)
        second = F.substring(rest, cut + len(mark), F.length(rest))
        last = F.instr(second, p.middle)
        return [F.substring(rest, F.lit(1), cut - 1), F.substring(second, F.lit(1), last - 1), F.substring(second, last + len(p.middle), F.length(second))]

    psm, spm = parts("psm"), parts("spm")
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)
