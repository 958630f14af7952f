"""Toxicity by a weighted grammar over clauses: insults, threats, targets, negation and reported speech.

A text becomes words, words become classes, and small transducers run one after another over the
classes of a clause, each rewriting the weights that the one before it gave. What scores is a clause
as a whole: an insult aimed at somebody weighs more, one that is denied or quoted weighs less.
Insults aimed at nobody count by how dense they are, so a long clean text does not add up to a toxic one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import base

#: Labelled rows that insults are learned from, chosen by a hash of the text; this is all that depends on labels.
TRAINING_ROWS = 20_000
#: Entries of the learned lexicon, strongest first; each needs so many different surroundings in toxic texts.
LEXICON, SUPPORT = 4096, 4
#: How sure the log odds must be (standard errors below the estimate), and what must then be left of them.
SURE, LEAST_ODDS = 2.3, 1.5
#: No learned word reaches the usual threshold of 0.7 alone: 1 - exp(-1.15) is below it.
MOST_LEARNED = 1.15
PREFIXES = (3, 4, 5, 6, 7, 8)

INSULT, LOOSE, THREAT, TARGET, NEGATION, REPORT, INTENT, CLAIM, OTHER = "ILTYNRFC."

# Fixed words of the grammar, English, German, French and Spanish.
INSULTS = ["idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
           "filth", "vermin", "imbecile", "dumm", "dreckig", "abschaum", "trottel", "idiota", "estúpido", "estúpida", "imbécil", "basura", "stupide", "ordure", "minable"]
THREATS = ["kill", "hurt", "destroy", "burn", "beat", "shoot", "stab", "töten", "umbringen", "schlagen", "matar", "golpear", "tuer", "frapper"]
TARGETS = ["you", "your", "yours", "u", "they", "them", "he", "him", "she", "her", "du", "dich", "dir", "ihr", "euch", "sie", "tu", "te", "toi", "vous", "usted", "ustedes", "ellos", "ils", "elles"]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "wasn't", "don't", "doesn't", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "jamás"]
REPORTS = ["said", "says", "wrote", "writes", "called", "quoted", "quote", "reported", "claimed", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"]
INTENTS = ["will", "shall", "gonna", "going", "should", "werde", "wirst", "vais", "va", "voy", "vamos"]
CLAIMS = ["is", "are", "am", "bist", "ist", "sind", "es", "eres", "son", "est", "êtes", "sont"]
CLASS_OF = {w: c for c, words in ((CLAIM, CLAIMS), (INTENT, INTENTS), (TARGET, TARGETS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (THREAT, THREATS), (INSULT, INSULTS)) for w in words}

#: What the transducers multiply by.
AIMED, DENIED, REPORTED, ASSERTED = 1.5, 0.5, 0.6, 1.1
BASE_INSULT, THREAT_WEIGHT = 1.1, 1.6
#: Words that a denial reaches, and words between an insult and whom it is aimed at.
REACH = 3
#: Beyond so many clauses loose insults weigh by their share of them; so many words of one clause count as a further one.
LONG_TEXT, LONG_CLAUSE = 32, 16

_CLAUSE = re.compile(r"[^.!?;:\n]+[.!?;:\n]?")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")


@dataclass
class Lexicon:
    """Learned weights of whole words and of word beginnings; 0 marks a beginning that is known to be clean.

    Bounded by a few times LEXICON entries.
    """

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def insult(self, word: str) -> float:
        """The largest weight on the way from the word to its shorter beginnings, up to one known as clean."""
        weight = BASE_INSULT if CLASS_OF.get(word) == INSULT else 0.0
        known = self.words.get(word)
        if known is not None:
            return max(weight, known)
        for n in reversed(PREFIXES):
            if len(word) > n:
                known = self.stems.get(word[:n])
                if known == 0:
                    break
                weight = max(weight, known or 0.0)
        return weight


def label_words(words: list[str], lexicon: Lexicon) -> list[tuple[str, float]]:
    """The lexical transducer: each word to its class and weight. Quotation marks stand for themselves."""
    out = []
    for w in words:
        weight = lexicon.insult(w)
        if weight:
            out.append((INSULT, weight))
        elif w in CLASS_OF:
            out.append((CLASS_OF[w], THREAT_WEIGHT if CLASS_OF[w] == THREAT else 0.0))
        else:
            out.append(('"' if w in "\"“”«»" else OTHER, 0.0))
    return out


def threat(tape):
    """A threat word weighs only after an intent and beside a target; alone it is an ordinary verb."""
    intent, out = False, []
    classes = [c for c, _ in tape]
    for i, (c, w) in enumerate(tape):
        intent = intent or c == INTENT
        out.append((c, w if c != THREAT or (intent and TARGET in classes[i + 1:i + 1 + REACH]) else 0.0))
    return out


def target(tape):
    """An insult near a target, or asserted of one, weighs more; any other one is loose."""
    classes = [c for c, _ in tape]
    out = []
    for i, (c, w) in enumerate(tape):
        if c == INSULT:
            near = classes[max(0, i - REACH):i + REACH + 1]
            by = AIMED if TARGET in near else ASSERTED if CLAIM in classes[max(0, i - REACH):i] else None
            c, w = (c, w * by) if by else (LOOSE, w)
        out.append((c, w))
    return out


def negation(tape):
    """A denial lessens what follows within its reach."""
    left, out = 0, []
    for c, w in tape:
        out.append((c, w * DENIED if left > 0 else w))
        left = REACH if c == NEGATION else left - 1
    return out


def reported(tape):
    """What stands in quotation marks or after a word of reporting is somebody else's."""
    quoted = told = False
    out = []
    for c, w in tape:
        out.append((c, w * REPORTED if quoted or told else w))
        quoted ^= c == '"'
        told = told or c == REPORT
    return out


GRAMMAR = (threat, target, negation, reported)


def clause_weight(words: list[str], lexicon: Lexicon) -> tuple[float, float]:
    """What threats and aimed or asserted insults weigh, and what loose ones do."""
    tape = label_words(words, lexicon)
    for transducer in GRAMMAR:
        tape = transducer(tape)
    return sum(w for c, w in tape if c != LOOSE), sum(w for c, w in tape if c == LOOSE)


def can_match(lexicon: Lexicon) -> dict:
    """Whether a word can give a clause any weight, remembered."""
    return base.Remembered(lambda w: CLASS_OF.get(w) == THREAT or lexicon.insult(w) > 0)


def text_score(text: str, lexicon: Lexicon, weighs: dict | None = None) -> tuple[float, int]:
    """(score, clauses that matched). Clauses add up: score = 1 - exp(-sum of clause weights).

    Beyond LONG_TEXT clauses the sum of loose insults is lessened in proportion; a text of few clauses
    and all threats and aimed insults keep their full weight.
    """
    lowered = text.lower()
    weighs = can_match(lexicon) if weighs is None else weighs
    if not any(map(weighs.__getitem__, _WORD.findall(lowered))):
        return 0.0, 0  # no clause can match
    clauses = [_WORD.findall(c) for c in _CLAUSE.findall(lowered)]
    weights = [x for x in (clause_weight(c, lexicon) for c in clauses) if sum(x) > 0]
    length = sum(1 + len(c) // LONG_CLAUSE for c in clauses)
    total = sum(firm for firm, _ in weights) + sum(loose for _, loose in weights) * min(1.0, LONG_TEXT / length)
    return 1 - math.exp(-total), len(weights)


def _features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


def _contexts(batch):
    """Features of toxic texts with each of their surroundings; of clean texts their number, summed per batch."""
    clean: Counter = Counter()
    for text, label in zip(batch["_text"], batch["label"], strict=True):
        words = [w for w in _WORD.findall(text.lower()) if w[0].isalpha()]
        if label:
            around = {(f, f"{a} {b}") for a, w, b in zip(["", *words], words, [*words[1:], ""]) for f in _features(w)}
            yield {"feature": [f for f, _ in around], "context": [c for _, c in around], "clean": [0] * len(around)}
        else:
            clean.update(words)
    counts: Counter = Counter()
    for w, n in clean.items():
        for f in _features(w):
            counts[f] += n
    yield {"feature": list(counts), "context": [None] * len(counts), "clean": list(counts.values())}


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str = "text", label: str = "label", rows: int = TRAINING_ROWS) -> Lexicon:
    """Insults from the texts of ``docs`` that ``labels`` (``key``, ``label`` 0 or 1; others are left out) cover.

    At most about ``rows`` labels, taken by a hash of the key, so only a bounded table is sent to
    the texts. A word, or a beginning of words, is learned if toxic texts hold it in at least SUPPORT
    different surroundings and, as far as counts so small can tell, far more often than clean ones. Surroundings are counted rather than texts,
    because copies of one toxic text repeat all of its rare words, though always in the same place.
    Without labels of both kinds nothing is learned and the fixed words alone decide.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("_key").isNotNull())
    grain = 1_000_000
    share = max(1, min(grain, rows * grain // max(1, known.count())))
    chosen = known.where(F.pmod(F.xxhash64("_key"), F.lit(grain)) < share).groupBy("_key").agg(F.max("label").alias("label")).limit(2 * rows)
    part = docs.select(F.col(key).alias("_key"), base.whole(F.col(text)).alias("_text")).join(F.broadcast(chosen), "_key").select("_text", "label")
    features = base.stored(base.per_batch(part, _contexts, "feature STRING, context STRING, clean LONG"), "features")
    toxic = base.stored(features.where("context IS NOT NULL").select("feature", "context").distinct().groupBy("feature").agg(F.count("*").alias("toxic")), "toxic")
    clean = features.where("context IS NULL").groupBy("feature").agg(F.sum("clean").alias("clean"))
    whole_words = F.col("feature").startswith("=")
    of_toxic = toxic.where(whole_words).agg(F.sum("toxic")).first()[0] or 1
    of_clean = features.where(whole_words).agg(F.sum("clean")).first()[0] or 1
    # A beginning is judged without its commonest word: that word alone shows nothing about others.
    word = F.substr("feature", F.lit(2))
    commonest = (toxic.where(whole_words).select("toxic", F.explode(F.array(*[F.when(F.length(word) > n, F.left(word, F.lit(n))) for n in PREFIXES])).alias("feature"))
                 .groupBy("feature").agg(F.max("toxic").alias("top")))
    both = (toxic.join(clean, "feature", "full").join(commonest, "feature", "left")
            .select("feature", (F.coalesce("toxic", F.lit(0)) - F.coalesce("top", F.lit(0))).alias("t"), F.coalesce("clean", F.lit(0)).alias("c")))
    # The log odds of standing in a toxic text, and their lower end, given how often each side was seen.
    odds = F.log((F.col("t") + 0.5) / (F.col("c") + 0.5) * of_clean / of_toxic)
    judged = base.stored(both.withColumn("odds", odds).withColumn("sure", odds - SURE * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))), "judged")
    words, stems = {}, {}
    for r in judged.where((F.col("t") >= SUPPORT) & (F.col("sure") > LEAST_ODDS)).orderBy(F.desc("sure"), "feature").limit(LEXICON).collect():
        (words if r.feature[0] == "=" else stems)[r.feature.lstrip("=")] = min(MOST_LEARNED, 0.3 + 0.2 * r.sure)
    # What begins like a learned stem but is mostly clean is marked so.
    above = F.array(*[F.left(F.ltrim("feature", F.lit("=")), F.lit(n)) for n in PREFIXES])
    learned = F.array(*[F.lit(x) for x in sorted(stems)]) if stems else F.array().cast("array<string>")
    for r in judged.where((F.col("c") >= 2) & (F.col("odds") < LEAST_ODDS) & F.arrays_overlap(above, learned)).orderBy(F.desc("c"), "feature").limit(4 * LEXICON).collect():
        (words if r.feature[0] == "=" else stems).setdefault(r.feature.lstrip("="), 0.0)
    return Lexicon(words, stems)


def score(df: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    """Per row ``keep``, ``score`` (0 to 1) and ``clauses`` (matched clauses).

    Texts are scored whole and where they lie, without a shuffle. Null and empty texts score 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # a few times LEXICON entries at most

    def run(texts):
        weighs = can_match(shared.value)
        scored = [text_score(t or "", shared.value, weighs) for t in texts]
        return {"score": [s for s, _ in scored], "clauses": [n for _, n in scored]}

    return base.with_columns(df, [text], run, "score DOUBLE, clauses INT", keep)
