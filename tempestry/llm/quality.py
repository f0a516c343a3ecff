"""Quality rules with adaptive thresholds.

Each rule has a metric; its fences are taken from the documents of the same language and source.  The upper
fence is ``q50 + fence * max(q50 - q25, grain)``: junk above the median, even in half of a source's documents,
does not widen it.  The lower fence (word length only; no document is worse for few symbols or repeats) is
``q50 - fence * max(q75 - q50, grain)``.  The grain keeps documents of a source that all agree from rejecting one
another: it is the trace that the smallest occurrence (`occurrence` of the rule, say one symbol) leaves in
a document of the source's median size, so it too follows the source.

The quantiles come from a mergeable sketch: a histogram over logarithmic buckets of a stated relative error
(the construction of DDSketch), kept as rows ``(lang, source, rule, bucket, n)``.  Two sketches merge by adding
the counts of equal buckets, so the language-wide and corpus-wide sketches are sums of the source ones, and
Spark's partial aggregation merges them before any shuffle.  A source with fewer than `least_docs` documents uses
the fences of its language, a language with fewer those of the corpus.

Only DataFrame and SQL functions run here.

Defined results: a null text has no words and fails the base rule, like an empty one; a null language or
source is a group of its own; repeated rows are judged one by one and count in the sketches one by one;
an empty table gives an empty result; further columns, whatever their names, pass through `with_verdict`; one that
bears the name of a column added there is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.llm.common import fields, others, stored, whole_row

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: Sketched besides the rules, for the grain.
SIZES = {"symbols": "words", "dup_lines": "lines", "repeats": "words", "word_length": "words"}


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_pct: int = 50
    relative_error: float = 0.01
    fence: float = 8.0
    least_docs: int = 50
    #: rule -> its smallest occurrence in a document: one symbol, half a line (a pair of equal lines shared out),
    #: the six words of a repeated window, twenty characters
    occurrence: dict = field(default_factory=lambda: {"symbols": 1.0, "dup_lines": 0.5, "repeats": 6.0, "word_length": 20.0})
    #: fences of more groups than this are not broadcast
    broadcast_groups: int = 100_000

    @property
    def gamma(self) -> float:
        return (1 + self.relative_error) / (1 - self.relative_error)

    @property
    def fences(self) -> list[str]:
        return [*(f"fence_{rule}" for rule in self.occurrence), "fence_word_length_low"]


def _counted(rows: DataFrame, p: QualityParams) -> DataFrame:
    """`rows` (any private columns, and text) with the counts and n_lines, without the text."""
    df = rows.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn("_w", F.filter(F.split("_t", SPACES), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn(
        "_h",
        F.expr("""CASE WHEN n_words > 3 THEN transform(slice(_w, 1, CAST(n_words AS INT) - 2),
                  (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2))) END"""),
    )
    # only where two windows agree: (hash of the window, its start), sorted, so that equal windows are neighbours
    df = df.withColumn(
        "_g", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i))) END")
    )
    df = df.withColumn(
        "_r",
        F.expr("filter(_g, (g, j) -> coalesce(g.h = get(_g, j - 1).h, false) OR coalesce(g.h = get(_g, j + 1).h, false))"),
    )
    df = df.withColumn(
        "n_repeat_words",
        F.expr("coalesce(size(array_distinct(flatten(transform(_r, g -> array(g.i, g.i + 1, g.i + 2))))), 0)").cast("long"),
    )
    df = df.withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0)))
    df = df.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"))
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    bare = F.col("_t")
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    df = df.withColumn("n_symbols", (F.length("_t") - F.length(bare)).cast("long"))
    df = df.withColumn(
        "base_failed",
        (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_pct * F.col("n_words")),
    )
    df = df.withColumn("n_lines", F.size("_l").cast("long"))
    return df.drop("text", "_t", "_w", "_h", "_g", "_r", "_l")


def with_counts(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    rows = _counted(docs.select(whole_row(docs), "text"), p)
    return rows.select(*fields(others(docs, *COUNTS)), *COUNTS)


def rule_metrics() -> dict[str, Column]:
    """The value of every rule from the counts."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeats": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def sketches(counts: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """Mergeable sketch rows (lang, source, rule, bucket, n) of the documents that pass the base rule; besides the
    rules, words and lines.

    The lowest bucket holds values below 1e-6; bucket b otherwise holds (gamma^(b-1), gamma^b].
    """
    metrics = {**rule_metrics(), "words": F.col("n_words").cast("double"), "lines": F.greatest(F.col("n_lines"), F.lit(1)).cast("double")}
    values = F.array(*[F.struct(F.lit(rule).alias("rule"), value.alias("value")) for rule, value in metrics.items()])
    rows = counts.filter(~F.col("base_failed")).select("lang", "source", F.explode(values).alias("m"))
    bucket = F.when(F.col("m.value") < 1e-6, F.lit(-100000)).otherwise(F.ceil(F.log("m.value") / F.log(F.lit(p.gamma))).cast("int"))
    return rows.groupBy("lang", "source", F.col("m.rule").alias("rule"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], p: QualityParams) -> DataFrame:
    """One row per group of `keys`: its number of documents and its fences."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    # A group has a bounded number of buckets (a few hundred at 1 % error), so its list is small whatever its rows.
    lists = merged.groupBy(*keys, "rule").agg(F.sum("n").alias("docs"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"))
    lists = lists.withColumn(
        "c", F.expr("aggregate(b, array(struct(0 AS bucket, 0L AS upto)), (a, x) -> concat(a, array(struct(x.bucket AS bucket, element_at(a, -1).upto + x.n AS upto))))")
    )

    def quantile(q: float) -> Column:
        at = F.expr(f"element_at(filter(slice(c, 2, size(b)), x -> x.upto >= {q}D * docs), 1).bucket")
        return F.when(at == -100000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(p.gamma), at) / (p.gamma + 1))

    lists = lists.select(*keys, "rule", "docs", F.struct(quantile(0.25).alias("low"), quantile(0.5).alias("mid"), quantile(0.75).alias("high")).alias("q"))
    names = [*p.occurrence, "words", "lines"]
    wide = lists.groupBy(*keys).agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("rule") == n, F.col("q"))).alias(f"_{n}") for n in names])

    def grain(rule: str) -> Column:
        return F.lit(p.occurrence[rule]) / F.col(f"_{SIZES[rule]}")["mid"]

    upper = [(F.col(f"_{r}")["mid"] + p.fence * F.greatest(F.col(f"_{r}")["mid"] - F.col(f"_{r}")["low"], grain(r))).alias(f"fence_{r}") for r in p.occurrence]
    word = F.col("_word_length")
    lower = (word["mid"] - p.fence * F.greatest(word["high"] - word["mid"], grain("word_length"))).alias("fence_word_length_low")
    return wide.select(*keys, "docs", *upper, lower)


def thresholds(sketch: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """(lang, source, its fences) with the fallback from source to language to corpus."""

    def packed(df: DataFrame, name: str, enough: int) -> DataFrame:
        keys = [c for c in df.columns if c not in (*p.fences, "docs")]
        return df.select(*keys, F.when(F.col("docs") >= enough, F.struct(*p.fences)).alias(name))

    by_source = packed(_fences(sketch, ["lang", "source"], p), "s", p.least_docs)
    by_lang = packed(_fences(sketch, ["lang"], p), "l", p.least_docs).withColumnRenamed("lang", "_lang")
    corpus = packed(_fences(sketch.withColumn("_all", F.lit(1)), ["_all"], p), "c", 0)
    joined = by_source.join(by_lang.hint("merge"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    joined = joined.withColumn("_all", F.lit(1)).join(F.broadcast(corpus), "_all", "left")  # one row
    best = F.coalesce("s", "l", "c")
    return joined.select("lang", "source", *[best[f].alias(f) for f in p.fences])


def _judged(docs: DataFrame, p: QualityParams, own: DataFrame) -> DataFrame:
    """row (the columns of `own`), the counts, the fences of its group, and kept."""
    counts = stored(_counted(docs.select(whole_row(own), "text", "lang", "source"), p))
    limits = stored(thresholds(sketches(counts, p), p)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    # One row a group: broadcast up to a checked number of groups, so that texts aren't shuffled by a few hot sources;
    # beyond it, a hot source is a skewed left side, which adaptive execution splits.
    small = limits.count() <= p.broadcast_groups
    judged = counts.join(
        limits.hint("broadcast" if small else "merge"),
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
        "left",
    )
    metrics = rule_metrics()
    inside = metrics["word_length"] >= F.coalesce(F.col("fence_word_length_low"), F.lit(0.0))
    for rule, value in metrics.items():
        inside = inside & F.coalesce(value <= F.col(f"fence_{rule}"), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside)


def with_verdict(docs: DataFrame, p: QualityParams = QualityParams(), drop_text: bool = False) -> DataFrame:
    """`docs` (without text if `drop_text`) with the counts, the fences of its group, and kept."""
    own = docs.drop("text") if drop_text else docs
    made = [*COUNTS, *p.fences, "kept"]
    return _judged(docs, p, own).select(*fields(others(own, *made)), *made)


def passing(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns."""
    return _judged(docs, p, docs).filter("kept").select(*fields(docs.columns))
