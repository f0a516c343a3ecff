"""Columnar tokenisation and hashing of text batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the polynomial window hash and its mixing step.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def text_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A text column as one array with 64-bit offsets, nulls as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of about `limit` bytes of text, whole rows each, so that long texts don't add up."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def split_words(text: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(first word of each text and the total at the end, all words as a dictionary array).

    Words are runs of characters that are not ASCII white space.
    """
    flat = pc.replace_substring_regex(text, pattern="[\\x09-\\x0D]", replacement=" ")
    lists = pc.split_pattern(flat, pattern=" ")
    words = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    keep = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(keep)])
    starts = ends[np.concatenate([[0], np.cumsum(sizes)])]
    return starts.astype(np.int64), words.filter(pa.array(keep)).dictionary_encode()


def plain(text: pa.Array) -> pa.Array:
    """Lower case, with everything but letters and digits as single spaces."""
    return pc.replace_substring_regex(pc.utf8_lower(text), pattern="[^\\pL\\pN]+", replacement=" ")


def word_hashes(words: pa.DictionaryArray) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    distinct = pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return distinct[words.indices.to_numpy(zero_copy_only=False)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def windows(hashes: np.ndarray, starts: np.ndarray, k: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place in the text) of every window of k words that lies within one text.

    With `whole_if_short`, a text of 1 to k-1 words is one window.
    """
    n = len(hashes)
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) - starts[:-1][owner] if n else np.zeros(0, np.int64)
    full = np.zeros(n, np.uint64)
    rest = sizes[owner] - place if n else place
    for j in range(k):
        step = np.zeros(n, np.uint64)
        if n > j:
            step[: n - j] = hashes[j:]
        if whole_if_short:
            step[rest <= j] = 0
        full = full * BASE + step
    ok = rest >= k
    if whole_if_short:
        ok |= (place == 0) & (rest < k)
    return mixed(full[ok]), owner[ok], place[ok]
