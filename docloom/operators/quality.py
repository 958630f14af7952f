"""Quality scores, retry planning, content typing and parser plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx

WEIGHTS = {"text": 0.4, "structure": 0.3, "ocr": 0.2, "completeness": 0.1}


def text_quality(df: DataFrame, column: str = "text") -> DataFrame:
    """Add the text quality struct ``tq``: score, counts, garbage ratio and issues.

    Non-ASCII characters count as garbage, so texts in other languages score low by definition.
    """
    t = F.col(column)
    n = F.length(t)
    n_words = F.size(tx.whitespace_tokens(t))
    garbage = tx.ratio(
        F.regexp_count(t, F.lit(r"[\x00-\x08\x0b-\x0c\x0e-\x1f]")) + F.regexp_count(t, F.lit(r"[^\x00-\x7F]")), n)
    plain = F.filter(F.regexp_extract_all(t, F.lit(tx.WORD), F.lit(0)), lambda w: w.rlike("^[a-zA-Z]{2,}$"))
    mean_word = tx.ratio(F.aggregate(plain, F.lit(0), lambda a, w: a + F.length(w)), F.size(plain))
    parts = df.withColumn("_n", n).withColumn("_w", n_words).withColumn("_g", garbage).withColumn("_m", mean_word)
    repeated = t.rlike(r"([^\n])\1{10,}")
    dense = (F.col("_w") > 0) & (F.col("_w") / F.size(F.split(t, "\n")) > 50)
    short, long_words = F.col("_n") < 100, F.col("_m") > 15
    cost = lambda flag, amount: F.when(flag, amount).otherwise(0.0)
    score = 1.0 - F.col("_g") * 2 - cost(short, 0.3) - cost(long_words, 0.2) - cost(repeated, 0.3) - cost(dense, 0.1)
    issue = lambda flag, name: F.when(flag, F.lit(name))
    issues = F.array_compact(F.array(
        issue(short, "very_short"), issue(long_words, "long_words"), issue(repeated, "repeated_characters"), issue(dense, "dense_text")))
    empty = t.isNull() | (t == "")
    tq = F.struct(
        F.when(empty, 0.0).otherwise(tx.clamp(score, 0.0, 1.0)).alias("score"),
        F.coalesce("_n", F.lit(0)).alias("char_count"),
        F.when(empty, 0).otherwise(F.col("_w")).alias("word_count"),
        F.col("_m").alias("mean_word_length"),
        F.when(empty, 1.0).otherwise(F.col("_g")).alias("garbage_ratio"),
        F.when(empty, F.array(F.lit("no_text"))).otherwise(issues).alias("issues"),
    )
    return parts.withColumn("tq", tq).drop("_n", "_w", "_g", "_m")


def structure_quality(df: DataFrame, pages: str = "pages", has_metadata: str = "has_metadata") -> DataFrame:
    """Add ``sq``: penalty for near-empty pages and for missing metadata, length-variance issue."""
    lengths = F.transform(F.col(pages), lambda p: F.length(p))
    n = F.size(pages)
    near_empty = F.size(F.filter(lengths, lambda x: x < 10))
    longest, shortest = F.array_max(lengths), F.array_min(lengths)
    score = 1.0 - tx.ratio(near_empty, n) * 0.3 - F.when(F.col(has_metadata), 0.0).otherwise(0.1)
    sq = F.struct(
        tx.clamp(score, 0.0, 1.0).alias("score"),
        F.greatest(n, F.lit(0)).alias("page_count"),
        near_empty.alias("empty_pages"),
        tx.ratio(F.aggregate(lengths, F.lit(0), lambda a, x: a + x), n).alias("mean_page_length"),
        ((longest > 0) & (shortest / F.nullif(longest, F.lit(0)) < 0.1)).alias("uneven_pages"),
    )
    return df.withColumn("sq", sq)


def assess(df: DataFrame, pages: str = "pages", confidence: str = "confidence", success: Column | None = None) -> DataFrame:
    """Weighted overall score, pass and retry flags and recommendations over ``tq`` and ``sq``."""
    filled = F.size(F.filter(F.col(pages), lambda p: F.length(F.regexp_replace(p, r"^\s+|\s+$", "")) > 10))
    base = F.when(F.col("tq.word_count") < 10, 0.7).otherwise(1.0)
    with_pages = F.when(F.col("sq.page_count") > 0, base * 0.5 + tx.ratio(filled, F.col("sq.page_count")) * 0.5).otherwise(base)
    completeness = F.when(F.col("tq.char_count") == 0, 0.0).otherwise(tx.clamp(with_pages, 0.0, 1.0))
    out = df.withColumn("completeness", completeness)
    overall = (
        F.col("tq.score") * WEIGHTS["text"] + F.col("sq.score") * WEIGHTS["structure"]
        + F.col(confidence) * WEIGHTS["ocr"] + F.col("completeness") * WEIGHTS["completeness"]
    )
    ok = F.lit(True) if success is None else success
    out = out.withColumn("overall", F.when(ok, overall).otherwise(0.0))
    say = lambda flag, name: F.when(flag, F.lit(name))
    found = F.array_compact(F.array(
        say(F.col("overall") < 0.5, "retry_with_fallback"),
        say(F.col("tq.garbage_ratio") > 0.1, "high_garbage_ratio"),
        say(F.col("tq.mean_word_length") > 15, "concatenated_words"),
        say(F.col("sq.empty_pages") > 0, "empty_pages"),
        say(F.col(confidence) < 0.7, "low_confidence"),
    ))
    minor = F.when((F.size(found) == 0) & (F.col("overall") < 0.9), F.array(F.lit("minor_issues"))).otherwise(found)
    return (
        out.withColumn("recommendations", F.when(ok, minor).otherwise(F.array(F.lit("retry_with_fallback"))))
        .withColumn("passed", F.col("overall") >= 0.7).withColumn("needs_retry", F.col("overall") < 0.5)
    )


def plan_retries(
    df: DataFrame, ocr_parser: str = "ocr", min_score: float = 0.7, max_retries: int = 3,
) -> DataFrame:
    """Whether to retry and how, from ``overall``, ``text_score``, ``confidence``, ``attempt``,
    ``parser`` and ``tried_fallback``; ``rule_strategy`` is the score-only rule."""
    retry = (F.col("attempt") < max_retries) & (F.col("overall") < min_score)
    strategy = F.when((F.col("text_score") < 0.3) & (F.col("parser") != ocr_parser), "fallback_parser").when(
        F.col("confidence") < 0.5, "fallback_parser").otherwise("same_parser")
    rule = (
        F.when(F.col("overall") < 0.3, "fallback_parser")
        .when((F.col("overall") < 0.5) & ~F.col("tried_fallback"), "fallback_parser")
        .when(F.col("overall") < 0.5, "same_parser").otherwise("none")
    )
    return df.withColumn("should_retry", retry).withColumn("strategy", F.when(retry, strategy).otherwise("none")).withColumn("rule_strategy", rule)


def classify_page(df: DataFrame) -> DataFrame:
    """Page type and confidence from ``text_ratio`` and ``image_ratio``."""
    text, image = F.col("text_ratio"), F.col("image_ratio")
    kind = F.when(text > 0.85, "text").when((text < 0.05) & (image > 0.90), "scanned").otherwise("mixed")
    sure = F.when(text > 0.85, F.least(F.lit(1.0), text)).when(
        (text < 0.05) & (image > 0.90), F.least(F.lit(1.0), image)).otherwise(0.5 + F.abs(text - 0.5))
    return df.withColumn("page_type", kind).withColumn("page_confidence", sure)


def classify_document(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Document type by share of pages with text and with images, with a confidence.

    ``pages(doc_id, char_count, image_count)``.
    """
    has_text, has_images = F.col("char_count") > 0, F.col("image_count") > 0
    d = pages.groupBy(key).agg(
        F.count("*").alias("n_pages"),
        F.avg(has_text.cast("double")).alias("text_share"), F.avg(has_images.cast("double")).alias("image_share"),
        F.sum("char_count").alias("n_chars"), F.sum("image_count").alias("n_images"),
    )
    t, i = F.col("text_share"), F.col("image_share")
    kind = (
        F.when(t > 0.95, "text").when((t < 0.05) & (i > 0.90), "scanned").when((t > 0) & (i > 0), "mixed")
        .when(F.col("n_chars") > 0, "text").when(F.col("n_images") > 0, "scanned").otherwise("unknown")
    )
    mixed_signals = (t > 0.1) & (t < 0.9) & (i > 0.1) & (i < 0.9)
    sure = 0.9 - F.when(F.col("n_pages") < 3, 0.1).otherwise(0.0) - F.when(mixed_signals, 0.15).otherwise(0.0) - F.when(
        F.col("n_chars") < 100, 0.1).otherwise(0.0)
    return d.withColumn("doc_type", kind).withColumn("confidence", tx.clamp(sure, 0.5, 1.0))


# Cost in dollars and seconds per page, and what a fallback adds.
PARSER_RATES = [("layout", 0.001, 1.0), ("ocr", 0.01, 5.0)]
FALLBACK_COST = {"ocr": 0.005, "layout": 0.0005}
FALLBACK_SECONDS = 0.5

# Megabytes per second by parser and file type; .5 where not listed.
SPEED = [("layout", "pdf", 0.5), ("layout", "docx", 1.0), ("layout", "pptx", 0.3), ("layout", "xlsx", 2.0), ("ocr", "pdf", 0.2), ("ocr", "image", 0.1)]


def parser_plan(docs: DataFrame) -> DataFrame:
    """Primary and fallback parser with cost and time, from ``doc_type``, ``confidence``, ``n_pages``.

    A confidence under .7 always takes the cautious layout-first plan.
    """
    rates = F.broadcast(docs.sparkSession.createDataFrame(PARSER_RATES, "primary string, cost_rate double, seconds_rate double"))
    ocr_first = (F.col("confidence") >= 0.7) & (F.col("doc_type") == "scanned")
    planned = docs.withColumn("primary", F.when(ocr_first, "ocr").otherwise("layout")).withColumn(
        "fallback", F.when(ocr_first, "layout").otherwise("ocr"))
    extra = F.when(F.col("fallback") == "ocr", FALLBACK_COST["ocr"]).otherwise(FALLBACK_COST["layout"])
    return planned.join(rates, "primary").select(
        *planned.columns,
        (F.col("n_pages") * F.col("cost_rate") + F.col("n_pages") * extra).alias("cost"),
        (F.col("n_pages") * F.col("seconds_rate") + F.col("n_pages") * FALLBACK_SECONDS).alias("seconds"),
    )


def time_by_size(files: DataFrame) -> DataFrame:
    """Seconds from ``size_bytes`` at the parser's speed for the file type, plus half a second."""
    speed = F.broadcast(files.sparkSession.createDataFrame(SPEED, "parser string, file_type string, mb_per_s double"))
    rate = F.coalesce("mb_per_s", F.lit(0.5))
    return files.join(speed, ["parser", "file_type"], "left").withColumn(
        "seconds", F.greatest(F.col("size_bytes") / 1048576.0 / rate + 0.5, F.lit(0.1))).drop("mb_per_s")
