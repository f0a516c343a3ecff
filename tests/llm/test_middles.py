"""Fill-in-the-middle against a plain version over code points."""

import hashlib
import random

from tempestry.llm import middles
from tempestry.llm.middles import Chunks, MiddleParams
from pyspark.sql import functions as F

#: Chunks of a few bytes, segments of a few chunks, a cache of a few texts.
SMALL = MiddleParams(mask=0x3, least=2, most=11, segment=37, cache_bytes=300)


def plain(doc_id, text):
    t = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def texts():
    rng = random.Random(3)
    out = [None, "", "a", "<", "<P", "<P>", "x<S", "<M>y", "é", "日本語" * 30, "a" * 5000, "<S<<P<M" * 40]
    for _ in range(150):
        out.append("".join(rng.choice("ab<P>SM é日🙂\n") for _ in range(rng.randrange(0, 60))))
    shared = "".join(rng.choice("abcdefgh ") for _ in range(400))
    return [*out, *[f"{k}{shared}{k % 3}" for k in range(20)], *["copy of a text" for _ in range(10)]]


def test_every_text_against_code_points():
    for p in (SMALL, MiddleParams()):
        chunks = Chunks((b"<P>", b"<S>", b"<M>"), p.cache_bytes)
        for k, t in enumerate(texts()):
            *rest, out = middles.transform((t or "").encode(), k, chunks, p)
            assert (*rest, out.decode()) == plain(k, t), (k, t)
        assert chunks.hits and chunks.bytes <= p.cache_bytes and chunks.bytes == sum(len(c[0]) for c in chunks.held.values())


def test_chunks_follow_content_and_cover_the_text():
    rng = random.Random(5)
    shared = bytes(rng.randrange(97, 123) for _ in range(20000))
    ends = [middles.chunk_ends(x, MiddleParams(segment=1000)) for x in (b"one" + shared, b"another beginning" + shared)]
    cut = [{e - n for e in es} for es, n in zip(ends, (3, 17))]
    assert len(cut[0] & cut[1]) > 0.8 * len(cut[0])
    data = b"one" + shared
    assert ends[0] == middles.chunk_ends(data) and ends[0][-1] == len(data) and max(b - a for a, b in zip([0, *ends[0]], ends[0])) <= 8192


def test_same_hash_other_content_is_no_hit():
    chunks = Chunks((b"<P>",), 1000)
    chunks.summary("éé".encode())
    key = next(iter(chunks.held))
    chunks.held[key] = (b"other", 99, True, b"ot", b"er")
    assert chunks.summary("éé".encode())[1:3] == (2, False)


def test_rows_and_the_way_back(spark):
    rows = [(k if k % 7 else None, t, "mine", k) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Form string, extra int").repartition(3)
    for p in (SMALL, MiddleParams()):
        out = middles.transformed(docs, p)
        assert out.columns == ["doc_id", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = {r.extra: r for r in out.withColumn("back", middles.restored(F.col("output"), F.col("form"), p)).collect()}
        for i, t, _, k in rows:
            r = got[k]
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(i, t), (i, t)
            assert r.back == (t or "")
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}
    assert middles.transformed(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    t = "Straße <ab> " * 200_000
    r = middles.transformed(spark.createDataFrame([(5, t)], "doc_id long, text string")).first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(5, t)
