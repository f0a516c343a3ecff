"""Toxicity of obfuscated text: noisy-channel restoration, then a linear score.

1. A character trigram model is counted over all documents (a table of 64^3 counts at most, whatever the
   corpus, summed by partial aggregation).
2. Suspicious stretches (digits, symbols or separators among or after letters, letters repeated, letters spaced
   out), whatever their length, become a lattice: every written character offers the letters it may stand for, a
   run may be one, two or all of its letters, a separator nothing.  Viterbi decoding under the trigram model picks
   the likeliest reading.
3. Words of the restored text and their beginnings are hashed to `buckets` features.  From the labelled rows
   of the training folds, every bucket gets the lower confidence limit of its log odds (support shrinks it).
4. A text's evidence is the sum of its three strongest buckets; it becomes a probability by a logistic curve
   fitted to a histogram of evidence on the training folds, each row scored without its own counts.

Only text decides a score: label, language, source and id are no inputs.

Defined results: a null or empty text has no evidence and gets the score of none; a document with several
label rows counts as toxic if one of them says so; null labels don't count; repeated document rows are scored
one by one; an empty table gives an empty result; without a training label the score is near 0; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.llm import tokens
from tempestry.llm.common import stored

#: The alphabet of the character model; 0 is anything that is no letter, the last code any other letter.
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
N = 64
#: Letters that a written character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
#: A token worth decoding: symbols or digits beside a letter, letters set apart, or a letter twice.
SUSPECT = r"[0-9@$!|+€(]\pL|\pL[0-9@$!|+€(]|\pL[._*-]+[\pL\pN]|[\pL\pN][._*-]+\pL|(?:[\pL\pN][._*-]){2}[\pL\pN]|" + "|".join(f"(?i:{c * 2})" for c in ALPHABET)
EDGES = ".,;:?\"'*#%&-_)]}"
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityParams:
    buckets: int = 1 << 20
    threshold: float = 0.7
    confidence: float = 1.0


@lru_cache(1)
def codes() -> np.ndarray:
    """The code of every character of the basic plane; the last entry stands for all beyond it."""
    table = np.zeros(0x10000, np.uint8)
    for c in range(len(table)):
        if chr(c).isalpha():
            table[c] = N - 1
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i + 1
    return table


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(g, n): counts of character trigrams over all texts, case folded, words bounded by 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        table = codes()
        for batch in batches:
            for piece in tokens.pieces(batch, limit=1 << 20):
                text = " ".join(t for t in piece.column("text").to_pylist() if t).lower()
                c = table[np.minimum(np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32), len(table) - 1)].astype(np.int32)
                total += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3)
        g = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(total[g])], names=["g", "n"])

    return docs.select("text").mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of c after a, b, smoothed with the bigram ones; collects 64^3 rows at most."""
    n = np.zeros(N**3)
    for r in trigram_counts(docs).collect():
        n[r.g] = r.n
    n = n.reshape(N, N, N)
    two = n.sum(0) + 0.1
    two /= two.sum(1, keepdims=True)
    return np.log((n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5)).astype(np.float32)


def lattice(stretch: str) -> list[list[tuple[str, int, float]]]:
    """The arcs of each written unit of a stretch: (letter, times, cost)."""
    s = stretch.lower()
    spaced = len(s) > 4 and all(not c.isalpha() for c in s[1::2]) and all(c.isalnum() for c in s[0::2])
    runs: list[tuple[str, int, int]] = []  # (character, place, length)
    i = 0
    while i < len(s):
        run = 1
        while i + run < len(s) and s[i + run] == s[i]:
            run += 1
        runs.append((s[i], i, run))
        i += run
    doubled = len(runs) > 1 and all(run > 1 for _, _, run in runs)  # every letter of the word is repeated
    steps: list[list[tuple[str, int, float]]] = []
    for c, i, run in runs:
        if c.isalpha():
            arcs = [(c, run, 0.0 if run < 3 else 6.0)]
            if run > 1:
                arcs += [(c, 1, 0.5 if run > 2 or doubled else 3.0)]
            if run > 2:
                arcs += [(c, 2, 1.5)]
        elif c in LEET and not (spaced and i % 2 and c not in "0123456789@$"):
            arcs = [(letter, min(run, 2), 0.5) for letter in LEET[c]] + [(" ", 1, 8.0)]
            if run > 1:
                arcs += [(letter, 1, 1.0 if run > 2 or doubled else 3.0) for letter in LEET[c]]
            if i + run == len(s) and c in "!|+(€":  # more often a mark after the word
                arcs += [(" ", 1, 0.0)]
        elif spaced or c in "._*-":
            arcs = [("", 0, 0.2), (" ", 1, 3.0)]
        else:
            arcs = [(" ", 1, 0.0)]
        steps.append(arcs)
    return steps


def cheapest(steps: list[list[tuple[str, int, float]]], model: np.ndarray) -> tuple[float, str]:
    """The cost and letters of the likeliest path through a lattice, up to the end of its word, by Viterbi over pairs of
    letters with back-pointers; time and memory are linear in the number of steps."""
    table = codes()
    steps = [*steps, [(" ", 1, 0.0)]]
    best = {(0, 0): 0.0}
    back: list[dict] = []  # per step: state -> (state before, arc)
    for arcs in steps:
        new: dict = {}
        came: dict = {}
        coded = [(k, int(table[min(ord(arc[0]), len(table) - 1)]) if arc[1] else 0, arc[1], arc[2]) for k, arc in enumerate(arcs)]
        for (a, b), cost in best.items():
            for k, z, times, price in coded:
                if times == 0:
                    state, total = (a, b), cost + price
                elif times == 1:
                    state, total = (b, z), cost + price - model.item(a, b, z)
                else:
                    state, total = (z, z), cost + price - model.item(a, b, z) - model.item(b, z, z) - (times - 2) * model.item(z, z, z)
                if state not in new or total < new[state]:
                    new[state], came[state] = total, ((a, b), k)
        best = new
        back.append(came)
    state, read = min(best, key=lambda x: (best[x], x)), []
    cost = best[state]
    for arcs, came in zip(reversed(steps), reversed(back)):
        state, k = came[state]
        read.append(arcs[k][0] * arcs[k][1])
    return cost, "".join(reversed(read))


def restore(stretch: str, model: np.ndarray) -> str:
    """The likeliest reading of a suspicious stretch."""
    return cheapest(lattice(stretch), model)[1].strip()


def readings(token: str, model: np.ndarray, memo: dict) -> list[str]:
    """The words of a suspicious token as restored, and those of three letters or more that stand in it as they
    are (two words joined by a mark); `memo` holds what was read before."""
    if token not in memo:
        if len(memo) >= 1 << 17:
            memo.clear()
        found = _WORD.findall(restore(token, model))
        memo[token] = found + [w for w in _WORD.findall(token) if len(w) > 2 and w not in found]
    return memo[token]


def _known_hashes(words: pa.Array) -> np.ndarray:
    words = words.dictionary_encode()
    return pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False), categorize=False)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)


def word_features(words: pa.Array, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every word: the word itself, and its beginnings of 4, 5 and 6 characters."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    at, found = [np.arange(len(words))], [_known_hashes(words)]
    for n in (4, 5, 6):
        k = np.flatnonzero(size > n)
        at.append(k)
        found.append(tokens.mixed(_known_hashes(pc.utf8_slice_codeunits(words.take(pa.array(k)), 0, n)) + np.uint64(n)))
    return np.concatenate(at), (np.concatenate(found) % np.uint64(p.buckets)).astype(np.int64)


def read_tokens(distinct: pa.Array, model: np.ndarray, memo: dict) -> tuple[np.ndarray, list[pa.Array]]:
    """(token, word) pairs as they read: plain words as they are in lower case, suspicious tokens through the
    channel, others by the words in them."""
    trimmed = pc.utf8_trim(distinct, characters=EDGES)
    low = pc.utf8_lower(trimmed)
    suspect = pc.match_substring_regex(trimmed, SUSPECT).to_numpy(zero_copy_only=False)
    plain = pc.match_substring_regex(low, r"^\pL+$").to_numpy(zero_copy_only=False) & ~suspect
    k = np.flatnonzero(plain)
    owners, words = [k], [low.take(pa.array(k))]
    rest = np.flatnonzero(~plain)
    more, names = [], []
    for code, token, odd in zip(rest.tolist(), low.take(pa.array(rest)).to_pylist(), suspect[rest]):
        found = readings(token, model, memo) if odd else _WORD.findall(token)
        names += found
        more += [code] * len(found)
    return np.concatenate([*owners, np.array(more, np.int64)]), [*words, pa.array(names, low.type)]


def _features(texts: pa.Array, model: np.ndarray, p: ToxicityParams, memo: dict) -> list[bytes]:
    """The distinct buckets of every text; each distinct token is read once."""
    starts, tokenized = tokens.split_words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    code = tokenized.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = tokenized.dictionary
    word_of, words = read_tokens(distinct, model, memo)
    # three or more single characters in a row are one word written apart
    single = pc.match_substring_regex(distinct, r"^[\pL\pN]$").to_numpy(zero_copy_only=False).astype(bool)
    alone = np.concatenate([[False], single[code], [False]]) if len(code) else np.zeros(2, bool)
    inside = np.concatenate([[False], owner[1:] == owner[:-1], [False]])
    first = np.flatnonzero(alone[1:-1] & ~(alone[:-2] & inside[:-1]))
    last = np.flatnonzero(alone[1:-1] & ~(alone[2:] & inside[1:]))
    n = len(distinct)
    apart: dict[str, int] = {}
    more_owner, more_code, names, name_of = [], [], [], []
    for a, b in zip(first, last):
        if b - a >= 2:
            written = " ".join(distinct[int(c)].as_py() for c in code[a : b + 1])
            if written not in apart:
                apart[written] = n + len(apart)
                found = _WORD.findall(restore(written, model))
                names += found
                name_of += [apart[written]] * len(found)
            more_owner.append(owner[a])
            more_code.append(apart[written])
    words = pa.concat_arrays([*words, pa.array(names, distinct.type)]).dictionary_encode()
    word_of = np.concatenate([word_of, np.array(name_of, np.int64)])
    at, bucket = word_features(words.dictionary, p)
    # text -> token -> word -> bucket, each step by sorted lists
    token = _expand(np.concatenate([owner, np.array(more_owner, np.int64)]), np.concatenate([code, np.array(more_code, np.int64)]))
    token = _follow(*token, word_of, words.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    owner, bucket = _follow(*token, at, bucket)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    bucket = bucket.astype("<i4")
    return [bucket[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]


def _expand(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order."""
    if not len(left):
        return left, right
    wide = np.int64(right.max()) + 1
    both = np.sort(left * wide + right)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return np.divmod(both, wide)


def _follow(left: np.ndarray, via: np.ndarray, of: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (left, right) for which `right` belongs to `via`."""
    order = np.argsort(of, kind="stable")
    of, right = of[order], right[order]
    a, b = np.searchsorted(of, via), np.searchsorted(of, via, side="right")
    size = b - a
    at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(via) else via
    return _expand(np.repeat(left, size), right[at])


def with_features(labelled: DataFrame, model: np.ndarray, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """(features, toxic) from (text, toxic): the distinct feature buckets of the restored text as little-endian
    32-bit integers."""
    shipped = labelled.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for piece in (piece for batch in batches for piece in tokens.pieces(batch)):
            blobs = _features(tokens.text_array(piece.column("text")), shipped.value, p, memo)
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), piece.column("toxic")], names=["features", "toxic"])

    return labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(found, "features binary, toxic int")


def bucket_counts(labelled: DataFrame, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Documents per bucket among toxic and other rows; collects one row a bucket at most."""
    buckets = p.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for blob, toxic in zip(batch.column("features").to_pylist(), batch.column("toxic").to_pylist()):
                total[int(toxic > 0)][np.frombuffer(blob, "<i4")] += 1
        b = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(total[0][b]), pa.array(total[1][b])], names=["b", "clean", "toxic"])

    rows = labelled.select("features", "toxic").mapInArrow(count, "b int, clean long, toxic long")
    got = rows.groupBy("b").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    toxic, clean = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    toxic[got.b], clean[got.b] = got.toxic, got.clean
    return toxic, clean


def _weights(t, c, n_toxic, n_clean, confidence):
    t, c = np.maximum(t, 0) + 0.5, np.maximum(c, 0) + 0.5
    return np.log(t / (n_toxic + 1)) - np.log(c / (n_clean + 1)) - confidence * np.sqrt(1 / t + 1 / c)


def _top3(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(np.sort(w)[-3:].sum()) if len(w) else 0.0


def fit(labelled: DataFrame, p: ToxicityParams = ToxicityParams()) -> dict:
    """Weights and calibration from rows (features, toxic)."""
    spark = labelled.sparkSession
    sizes = {r.toxic > 0: r.n for r in labelled.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    toxic, clean = bucket_counts(labelled, p)
    shipped = spark.sparkContext.broadcast((toxic, clean))
    confidence = p.confidence

    @F.pandas_udf("int")
    def evidence(features: pd.Series, label: pd.Series) -> pd.Series:
        t, c = shipped.value
        out = []
        for blob, y in zip(features, label):
            b = np.frombuffer(blob, "<i4")
            own = int(y > 0)  # without the row's own counts
            out.append(int(_top3(_weights(t[b] - own, c[b] - (1 - own), max(n_toxic - own, 0), max(n_clean - 1 + own, 0), confidence)) * 10))
        return pd.Series(out, dtype="int32")

    hist = labelled.groupBy(evidence("features", "toxic").alias("e"), (F.col("toxic") > 0).alias("y")).agg(F.count("*").alias("n")).collect()
    e, y, n = (np.array([float(r[k]) for r in hist]) for k in ("e", "y", "n"))
    a, b = _logistic(e / 10, y, n) if n_toxic and n_clean else (0.0, -50.0)
    return {"weights": _weights(toxic, clean, n_toxic, n_clean, confidence).astype(np.float32), "slope": a, "shift": b}


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of the weighted logistic curve, with a small ridge, by Newton steps."""
    theta = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        grad = z.T @ (n * (y - p)) - 1e-2 * theta
        hess = (z * (n * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


def scored(docs: DataFrame, language: np.ndarray, model: dict, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """(doc_id, score, predicted) of every row of `docs`."""
    shipped = docs.sparkSession.sparkContext.broadcast((language, model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for piece in (piece for batch in batches for piece in tokens.pieces(batch)):
            language, m = shipped.value
            blobs = _features(tokens.text_array(piece.column("text")), language, p, memo)
            e = np.array([_top3(m["weights"][np.frombuffer(b, "<i4")]) for b in blobs])
            scores = 1 / (1 + np.exp(-np.clip(m["slope"] * e + m["shift"], -500, 500)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, training, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """(doc_id, score, predicted) of every row of `docs`; `training` is a condition on doc_id."""
    language = language_model(docs)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = docs.select("doc_id", "text").filter(training).join(known.filter(training).hint("merge"), "doc_id")
    model = fit(stored(with_features(labelled, language, p)), p)
    return scored(docs, language, model, p)
