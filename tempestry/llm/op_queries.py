"""One query per training-data operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.llm import archives, chats, decontamination, extraction, jaccard, language, middles, packing, privacy, quality, repairs, substrings, toxicity
from tempestry.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # the text has done its work once the counts are there
    return quality.with_verdict(docs, drop_text=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archives.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = privacy.with_spans(docs, privacy.fit(docs)).select("doc_id", "spans")
    joined = "array_join(transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in privacy.KINDS],
        F.sha2(F.expr(joined.format("filter(spans, s -> s.base)")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.classes(docs).select("doc_id", "class_id", "n_links", "n_copies")


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extracted(pages, extraction.fit(pages)).select("page_id", "url", "text", "n_chars")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)


def op9_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.rendered(table(spark, sf_dir, "conversations"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    scores = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 1)
    return scores.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middles.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = middles.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language.scored(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2)


def op13_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.repaired(repairs.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_archives": op2_archives,
    "op3_privacy": op3_privacy,
    "op4_substrings": op4_substrings,
    "op5_jaccard": op5_jaccard,
    "op6_extraction": op6_extraction,
    "op7_decontamination": op7_decontamination,
    "op8_packing": op8_packing,
    "op9_chats": op9_chats,
    "op10_toxicity": op10_toxicity,
    "op11_middles": op11_middles,
    "op12_language": op12_language,
    "op13_repairs": op13_repairs,
}
