"""Deterministic enrichment: sentiment, topics, keywords, language, readability, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx

# Sentiment lexicon.
POSITIVE = [
    "good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "happy", "best",
    "beautiful", "perfect", "awesome", "positive", "success", "win", "winning", "joy", "pleased",
    "satisfied", "recommend", "impressive", "outstanding",
]
NEGATIVE = [
    "bad", "terrible", "awful", "horrible", "hate", "worst", "poor", "disappointing", "failed",
    "failure", "problem", "issue", "error", "wrong", "negative", "angry", "sad", "disappointed",
    "frustrated", "unhappy", "regret",
]

# Topic keywords; categories are ranked in this order on equal scores.
TOPICS = {
    "technology": ["software", "hardware", "AI", "cloud", "data"],
    "business": ["finance", "marketing", "sales", "strategy", "operations"],
    "science": ["research", "biology", "physics", "chemistry", "medicine"],
    "health": ["healthcare", "wellness", "fitness", "nutrition", "mental health"],
    "politics": ["government", "policy", "elections", "law", "diplomacy"],
    "entertainment": ["movies", "music", "games", "sports", "arts"],
    "education": ["learning", "teaching", "research", "academia", "training"],
}

# Words that are never keywords.
KEYWORD_STOP_WORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "day", "get",
    "has", "him", "his", "how", "its", "may", "new", "now", "old", "see", "two", "who", "boy", "did", "she", "use", "way",
    "many", "oil", "sit", "set", "run", "eat", "far", "sea", "eye", "ask", "own", "say", "too", "any", "try", "three",
    "also", "after", "back", "other", "than", "them", "these", "would", "there", "their", "what", "said", "each", "which",
    "will", "about", "could", "this", "with", "from", "they", "been", "have", "were", "more", "very", "when", "come",
    "made", "find", "part", "over", "such", "take", "only", "think", "know", "just", "first",
]

# Marker words per language; languages win in this order on equal counts.
LANGUAGE_MARKERS = {
    "en": ["the", "and", "for", "are", "but", "not", "with", "have", "this"],
    "es": ["el", "la", "de", "que", "en", "un", "ser", "se", "no"],
    "fr": ["le", "de", "et", "à", "un", "il", "être", "par", "pour"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit"],
}


def sentiment(df: DataFrame, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> DataFrame:
    """Add ``pos``, ``neg``, ``sentiment`` (−1…1), ``label`` and ``sentiment_confidence``."""
    count_in = lambda lexicon: F.size(F.filter(F.col("_w"), lambda w: w.isin(list(lexicon))))
    counted = df.withColumn("_w", tx.words(F.col("text"))).withColumn("pos", count_in(positive)).withColumn("neg", count_in(negative))
    total = F.col("pos") + F.col("neg")
    score = F.when(total == 0, 0.0).otherwise(tx.clamp((F.col("pos") - F.col("neg")) / F.greatest(total, F.lit(10)), -1.0, 1.0))
    s = F.col("sentiment")
    label = (
        F.when(s > 0.6, "very_positive").when(s > 0.2, "positive").when(s < -0.6, "very_negative").when(s < -0.2, "negative").otherwise("neutral")
    )
    sure = F.when(total == 0, 0.5).otherwise(F.least(total / 20.0, F.lit(0.9)))
    return counted.withColumn("sentiment", score).withColumn("label", label).withColumn("sentiment_confidence", sure).drop("_w")


def topics(df: DataFrame, categories: Mapping[str, Sequence[str]] = TOPICS) -> DataFrame:
    """Add ``topic``, ``topic_confidence`` and up to three ``topics``; ``general`` without a hit."""
    low = F.lower("text")
    scored = F.array(*[
        F.struct(
            sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keys), F.lit(0)).alias("score"),
            F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (name, keys) in enumerate(categories.items())
    ])
    out = df.withColumn("_t", F.reverse(F.array_sort(F.filter(scored, lambda s: s["score"] > 0))))
    found = F.size("_t") > 0
    first = F.try_element_at("_t", F.lit(1))
    return (
        out.withColumn("topic", F.when(found, first["name"]).otherwise("general"))
        .withColumn("topic_confidence", F.when(found, F.least(first["score"] / 3.0, F.lit(0.95))).otherwise(0.3))
        .withColumn("topics", F.when(found, F.slice(F.transform("_t", lambda s: s["name"]), 1, 3)).otherwise(F.array(F.lit("general"))))
        .drop("_t")
    )


def keywords(docs: DataFrame, top: int = 10, stop_words: Sequence[str] = KEYWORD_STOP_WORDS) -> DataFrame:
    """Best ``top`` words per document: frequency, half as much again for words that occur in
    the first fifth of the text; ties by word.

    The early flag is tested where the text is, so only (document, word) pairs move.
    """
    early = F.left(F.lower("text"), F.floor(F.length("text") / 5).cast("int"))
    ws = F.filter(tx.words(F.col("text")), lambda w: w.rlike("^[a-z]{4,}$") & ~w.isin(list(stop_words)))
    tagged = docs.select("doc_id", early.alias("early"), ws.alias("ws")).select(
        "doc_id",
        F.explode(F.concat(
            F.transform("ws", lambda w: F.struct(w.alias("word"), F.lit(1).alias("n"), F.lit(False).alias("early"))),
            F.transform(F.array_distinct("ws"), lambda w: F.struct(w.alias("word"), F.lit(0).alias("n"), F.contains(F.col("early"), w).alias("early"))),
        )).alias("x"),
    )
    counts = tagged.groupBy("doc_id", F.col("x.word").alias("word")).agg(F.sum("x.n").alias("freq"), F.bool_or("x.early").alias("early"))
    scored = counts.withColumn("score", F.col("freq") * F.when(F.col("early"), 1.5).otherwise(1.0))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def guess_language(text: Column, markers: Mapping[str, Sequence[str]] = LANGUAGE_MARKERS) -> Column:
    """The language with most distinct marker words, the first on ties, ``unknown`` without any."""
    ws = tx.words(text)
    scored = F.array(*[
        F.struct(F.size(F.array_intersect(ws, F.array(*[F.lit(m) for m in ms]))).alias("score"), F.lit(-i).alias("order"), F.lit(lang).alias("lang"))
        for i, (lang, ms) in enumerate(markers.items())
    ])
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["lang"]).otherwise("unknown")


def reading_level(df: DataFrame) -> DataFrame:
    """Add ``flesch`` and its band; ``unknown`` for texts without words or sentences."""
    out = df.withColumn("_w", tx.words(F.col("text"))).withColumn("_s", F.size(tx.sentences(F.col("text"))))
    groups = lambda w: F.regexp_count(w, F.lit("[aeiouy]+"))
    syllables = F.aggregate(
        F.transform("_w", lambda w: F.greatest(F.lit(1), groups(w) - (w.endswith("e") & (groups(w) > 1)).cast("int"))),
        F.lit(0), lambda a, x: a + x)
    n = F.size("_w")
    flesch = 206.835 - 1.015 * F.try_divide(n, F.col("_s")) - 84.6 * F.try_divide(syllables, n)
    f = F.col("flesch")
    band = (
        F.when(f.isNull(), "unknown").when(f >= 90, "elementary").when(f >= 70, "middle_school").when(f >= 50, "high_school")
        .when(f >= 30, "college").otherwise("graduate")
    )
    return out.withColumn("flesch", flesch).withColumn("reading_level", band).drop("_w", "_s")


def summaries(docs: DataFrame, max_words: int = 100, best: int = 5) -> DataFrame:
    """Extractive summary: the best sentences by mean document frequency of their words, in a
    word budget, in text order. Texts of at most three sentences are their own summary.

    Texts are dealt by document once; words, frequencies and scores are made and stay where their text lies.
    """
    sents = docs.select("doc_id", "text", tx.sentences(F.col("text")).alias("ss"))
    short = sents.where(F.size("ss") <= 3).select("doc_id", F.col("text").alias("summary"), F.size("ss").alias("n_sentences"))
    dealt = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", tx.sentences(F.col("text")).alias("ss")).where(F.size("ss") > 3)
    rows = dealt.select("doc_id", F.posexplode("ss").alias("pos", "sentence"))
    # Sentences without words stay as rows of a null word, so the scores of a document are an array by place.
    per_sentence = rows.select("doc_id", "pos", F.explode_outer(tx.words(F.col("sentence"))).alias("w")).groupBy("doc_id", "pos", "w").agg(F.count("w").alias("n"))
    freq = F.sum(F.when(F.length("w") > 3, F.col("n")).otherwise(0)).over(Window.partitionBy("doc_id", "w"))
    scored = per_sentence.withColumn("freq", freq).groupBy("doc_id", "pos").agg(
        F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("freq")), F.sum("n")), F.lit(0.0)).alias("score"))
    listed = scored.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "score"))), lambda x: x["score"]).alias("scores"))
    ranked = dealt.join(listed, "doc_id", "left").select("doc_id", F.posexplode("ss").alias("pos", "sentence"), "scores").select(
        "doc_id", "pos", "sentence", F.coalesce(F.get("scores", F.col("pos")), F.lit(0.0)).alias("score"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    top = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= best)
    item = F.struct("r", "pos", "sentence", F.size(tx.whitespace_tokens(F.col("sentence"))).alias("words"))
    listed = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.array().cast("array<struct<pos:int,sentence:string>>").alias("kept"), F.lit(0).alias("words"))
    chosen = F.aggregate(
        "items", start,
        lambda acc, x: F.when(
            acc["words"] + x["words"] <= max_words,
            F.struct(
                F.array_append(acc["kept"], F.struct(x["pos"].alias("pos"), x["sentence"].alias("sentence"))).alias("kept"),
                (acc["words"] + x["words"]).alias("words"))).otherwise(acc),
        lambda acc: F.array_sort(acc["kept"]))
    long = listed.withColumn("kept", chosen).select(
        "doc_id", F.array_join(F.transform("kept", lambda x: x["sentence"]), " ").alias("summary"), F.size("kept").alias("n_sentences"))
    return short.unionByName(long)
