"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing.  A record is one row of text; the writer's line separator is the blank line that ends a WARC
record, so the files are plain WARC 1.1 (gzipped by default) on any file system that Spark can reach.

Reading.  The reader cuts the files (in parallel blocks, if not compressed) at the version line, wherever it stands, so a payload that holds
such a line is cut too.  Every piece is a candidate record: its offset is the running sum of the sizes
before it, its successor its offset plus what its own header announces.  Whether a candidate is a record is
decided by reachability from the start of its file alone.  Candidates whose successor is the next candidate
form runs (cut where some candidate jumps to); pointer jumping doubles the reach over runs until every run
is known to be reachable or not.  Pieces that are not reachable are given back to the payload they lie in.

Defined results: a null html is an empty payload; pages with equal payloads of at least `revisit_from`
bytes are one response and revisits of it; repeated page_ids are records of their own, all of them responses
if theirs is the smallest of the payload; a null page_id is written as an empty field and read back as null,
and is never the response of a group that has another; a null url is an empty target; an empty table gives an empty result; further columns are not archived.  A file
that does not start with a record has no reachable one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempestry.llm.common import cut, shared_dir

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_FROM = 100


def write(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, compression: str = "gzip", records_per_file: int = 50_000) -> None:
    """One record per row of page_id, url, html; files hold `records_per_file` at most, since a compressed file is read
    by one task; with compression "none" they can be split on reading."""
    html = F.coalesce(F.col("html"), F.lit(""))
    digest, size = F.sha2(html, 256), F.octet_length(html)
    named = pages.select("page_id", digest.alias("digest"), size.alias("size")).filter(F.col("size") >= revisit_from)
    # partial aggregation: a payload that a third of all pages share is one row a task
    groups = named.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    # the join carries digests only; a hot digest is a skewed left side, which adaptive execution splits
    later = named.join(groups.hint("merge"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first")
    later = later.distinct().withColumnsRenamed({"page_id": "_page", "digest": "_digest"})
    rows = pages.select("page_id", "url", html.alias("html"), digest.alias("digest"), size.cast("long").alias("size"))
    rows = rows.join(later.hint("merge"), rows["page_id"].eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.withColumnRenamed("first", "refers_to")
    revisit = F.col("refers_to").isNotNull()
    header = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), _uuid(F.concat_ws("/", "page_id", "url", "digest")),
        F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", ""),
        F.lit("\r\nX-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nX-Refers-To: "), F.coalesce(F.col("refers_to").cast("string"), F.lit("")),
        F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string")),
        F.lit(END),
    )
    rows.select(F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def _uuid(name: Column) -> Column:
    h = F.sha2(name, 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _field(name: str) -> Column:
    return F.regexp_extract(F.substring_index("piece", END, 1), f"(?:^|\\r\\n){name}: ?([^\\r]*)", 1)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, piece): what lies between version lines, in order of (block, row) in a file."""
    return spark.read.option("lineSep", VERSION).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("piece"),
    )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, next, size, type, ...) of every version line; the payload digest where the piece holds all of it."""
    p = _pieces(spark, path)
    head = F.octet_length(F.substring_index("piece", END, 1)).cast("long") + len(END)
    length = _field("Content-Length").try_cast("long")
    p = p.select(
        "file", "block", "row",
        F.octet_length("piece").cast("long").alias("bytes"),
        F.when(F.instr("piece", END) > 0, head).alias("head"),
        length.alias("length"),
        *[_field(n).alias(c) for n, c in (("WARC-Type", "record_type"), ("WARC-Target-URI", "url"), ("X-Page-Id", "page_id"), ("X-Refers-To", "refers_to"), ("X-Payload-Length", "payload_length"), ("WARC-Payload-Digest", "said_digest"))],
        "piece",
    )
    whole = F.col("bytes") == F.col("head") + F.col("length") + len(END)
    # the payload ends the piece but for the blank line; it starts after the first blank line
    payload = F.expr("substring(CAST(piece AS BINARY), CAST(head + 1 AS INT), CAST(length AS INT))")
    p = p.withColumn("digest", F.when(whole, F.sha2(payload, 256))).drop("piece")
    # A file's candidates, `records_per_file` and what its payloads hold, are one ordered group of narrow rows.
    order = Window.partitionBy("file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, -1)
    mark = len(VERSION.encode())
    p = p.withColumn("at", F.coalesce(F.sum(F.col("bytes") + mark).over(order), F.lit(0)) - mark)
    # what precedes the first version line is no candidate
    return p.filter("at >= 0").withColumn("next", F.when(F.col("head").isNotNull(), F.col("at") + mark + F.col("head") + F.col("length") + len(END)))


def reachable(found: DataFrame) -> DataFrame:
    """Candidates with `real`: whether successors lead to them from the start of their file."""
    order = Window.partitionBy("file").orderBy("at")
    rows = found.select("file", "at", "next").withColumn("follows", F.coalesce(F.lag("next").over(order) == F.col("at"), F.lit(False)))
    odd = rows.withColumn("jumps", ~F.coalesce(F.col("next") == F.lead("at").over(order), F.lit(False)))
    landed = odd.filter("jumps").select("file", F.col("next").alias("at")).distinct().withColumn("landed", F.lit(True))
    heads = odd.join(landed.hint("merge"), ["file", "at"], "left")
    head = ~F.col("follows") | F.coalesce(F.col("landed"), F.lit(False))
    heads = heads.withColumn("run", F.max(F.when(head, F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    heads = cut(heads.select("file", "at", "run", "next", F.when(F.col("jumps"), F.col("next")).alias("exit")))
    # A run leads on from its last candidate: by its jump, or into the next run where that was cut by a landing.
    ends = Window.partitionBy("file", "run").orderBy(F.desc("at"))
    last = heads.withColumn("k", F.row_number().over(ends)).filter("k = 1").select("file", "run", F.col("next").alias("to"))
    longest = last.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    known = last.select("file", "run", (F.col("run") == 0).alias("real"), "to")
    reach = 1
    while reach < longest:
        jump = known.select("file", F.col("run").alias("to"), F.col("to").alias("far"))
        seen = known.filter("real").select("file", F.col("to").alias("run")).distinct().withColumn("hit", F.lit(True))
        known = (
            known.join(jump.hint("merge"), ["file", "to"], "left")
            .join(seen.hint("merge"), ["file", "run"], "left")
            .select("file", "run", (F.col("real") | F.coalesce("hit", F.lit(False))).alias("real"), F.col("far").alias("to"))
        )
        known = cut(known)
        reach *= 2
    verdict = heads.select("file", "at", "run").join(known.select("file", "run", "real").hint("merge"), ["file", "run"]).select("file", "at", "real")
    return found.join(verdict.hint("merge"), ["file", "at"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest."""
    found = cut(reachable(candidates(spark, path)))
    records = found.filter("real")
    torn = records.filter("length > 0 AND digest IS NULL").select("file", "at", F.col("next").alias("until"))
    if not torn.isEmpty():
        records = _mended(spark, path, found, records)
    revisit = F.col("record_type") == "revisit"
    return records.select(
        F.col("page_id").try_cast("long").alias("page_id"),
        "url",
        "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
        F.when(revisit, F.col("payload_length").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("said_digest", ":", -1)).otherwise(F.coalesce("digest", F.sha2(F.lit(""), 256))).alias("payload_digest"),
    )


def _mended(spark: SparkSession, path: str, found: DataFrame, records: DataFrame) -> DataFrame:
    """`records` with the digests of payloads that hold version lines: their pieces are read again and joined."""
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owner = found.select("file", "block", "row", "at", F.max(F.when(F.col("real"), F.col("at"))).over(order).alias("owner"))
    torn = records.filter("length > 0 AND digest IS NULL").select("file", F.col("at").alias("owner"), "head", "length")
    wanted = owner.join(torn.hint("merge"), ["file", "owner"])
    parts = _pieces(spark, path).join(wanted.hint("merge"), ["file", "block", "row"])
    parts = parts.groupBy("file", "owner", "head", "length").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda x: x.piece), VERSION)
    parts = parts.withColumn("whole", whole.cast("binary"))
    parts = parts.select("file", F.col("owner").alias("at"), F.expr("sha2(substring(whole, CAST(head + 1 AS INT), CAST(length AS INT)), 256)").alias("mended"))
    return records.join(parts.hint("merge"), ["file", "at"], "left").withColumn("digest", F.coalesce("digest", "mended"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` to archives in the shared folder and read the records back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return read(spark, path)
