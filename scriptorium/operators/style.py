"""Style statistics of documents, of a corpus and of a writer's samples, and what they calibrate."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import arrays as A
from scriptorium.functions import segment as S
from scriptorium.operators import measures as M
from scriptorium.operators.ranking import ranked

BLANKS = re.compile(r"[ \t\n\r\f]+")
#: What the style statistics count.
SHORTENED = re.compile(r"\w+'(?:t|s|re|ve|ll|d|m)\b", re.IGNORECASE | re.ASCII)
PASSIVES = (re.compile(r"\b(?:is|are|was|were|been|being)\s+\w+ed\b", re.IGNORECASE | re.ASCII), re.compile(r"\b(?:is|are|was|were|been|being)\s+\w+en\b", re.IGNORECASE | re.ASCII))
OWN = re.compile(r"\b(?:I|me|my|we|us|our|mine|ours)\b", re.IGNORECASE | re.ASCII)
NOT_CLEAN = re.compile(r"[^A-Za-z0-9_ \t\n\r\f'-]")
ASIDE = re.compile(r"\([^)]{5,}\)")
FIRST_WORDS, SECOND_WORDS = re.compile(r"(?:I|me|my|we|us|our)\Z", re.IGNORECASE), re.compile(r"your?\Z", re.IGNORECASE)
CONJUNCTIONS = ("and", "but", "so", "because", "also", "plus", "or", "well", "ok", "hey")
#: Samples that a voice profile takes.
LEAST_SAMPLES, MOST_SAMPLES = 3, 10


@dataclass(frozen=True)
class StyleRules:
    """Word lists of the style statistics: transitions and phrases by frequency, hedges in all."""

    transitions: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    hedges: tuple[str, ...] = ()


def clean_words(text: str) -> list[str]:
    """T14 of one text."""
    return NOT_CLEAN.sub("", text.lower()).split()


def sentences_quoted(text: str, short: Sequence[str], guard: bool) -> list[str]:
    """T3, T6 of one text."""
    known, out, start = tuple(f"{w}." for w in short), [], 0
    for m in re.finditer(r"[.!?]", text):
        i = m.start()
        inside = guard and text[i] == "." and text[max(i - 1, 0) : i].isascii() and text[max(i - 1, 0) : i].isalnum() and text[i + 1 : i + 2].isascii() and text[i + 1 : i + 2].isalnum()
        if inside or text[max(0, i - 5) : i + 1].endswith(known):
            continue
        end = i + 1 + (text[i + 1 : i + 2] in ('"', "'") and i + 1 < len(text))
        out.append(text[start:end].strip(M.BLANKS))
        start = end
    out.append(text[start:].strip(M.BLANKS))
    return [x for x in out if x]


def percentile(ordered: Sequence[float], share: float) -> float:
    """By linear interpolation."""
    at = share * (len(ordered) - 1)
    low = int(at)
    high = min(low + (at > low), len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


def starter(sentence: str) -> str:
    return re.sub(r"[^a-z'-]", "", BLANKS.split(sentence)[0].lower())


STYLE_COUNTS = ("word_count", "sentence_count", "paragraph_count")
STYLE = (
    "length_mean", "length_median", "length_sd", "length_min", "length_max", "length_p10", "length_p25", "length_p75", "length_p90", "burstiness", "vocabulary_diversity", "starter_diversity", "contractions", "passive_percent",
    "paragraph_words", "paragraph_sd", "em_dashes", "semicolons", "exclamations", "first_person", "hedging",
)
#: Decimal places of STYLE.
PLACES = (1, 1, 1, 0, 0, 1, 1, 1, 1, 3, 3, 3, 2, 1, 1, 1, 2, 2, 2, 2, 2)


def measured_style(text: str, rules: StyleRules) -> tuple:
    """One document's STYLE_COUNTS and STYLE."""
    sentences = sentences_quoted(text, S.MODEL_SHORT, False)
    parts = [len(clean_words(p)) for p in re.split(r"\n[ \t\n\r\f]*\n", text) if p.strip(M.BLANKS)]
    words, low = clean_words(text), text.lower()
    lengths = [len(clean_words(x)) for x in sentences]
    ordered, n, s = sorted(lengths), len(words), len(sentences)
    sd, middle = (M.deviation(lengths) if s > 1 else 0.0), M.mean(lengths)
    long_words = [w for w in words if len(w) > 2]
    per = lambda k: k / max(n, 1) * 1000
    starters = {starter(x) for x in sentences} - {""}
    return (
        n, s, len(parts),
        middle, percentile(ordered, 0.5) if s else 0.0, sd, ordered[0] if s else 0, ordered[-1] if s else 0, *(percentile(ordered, q) if s else 0.0 for q in (0.1, 0.25, 0.75, 0.9)),
        sd / middle if s >= 3 and middle else 0.0, len(set(long_words)) / len(long_words) if len(long_words) >= 10 else 0.0, len(starters) / s if s else 0.0, per(len(SHORTENED.findall(text))),
        sum(len(p.findall(x)) for x in sentences for p in PASSIVES) / s * 100 if s else 0.0, M.mean(parts), M.deviation(parts) if len(parts) > 1 else 0.0,
        per(text.count("—") + text.count("–")), per(text.count(";")), per(text.count("!")), per(len(OWN.findall(text))), per(sum(len(re.findall(rf"\b{re.escape(h)}\b", low, re.ASCII)) for h in rules.hedges if h in low)),
    )


def per_thousand(low: Column, n: Column, phrases: Sequence[str], digits: int, whole: bool) -> Column:
    """of the phrases that occur, how often per thousand words, as a map; whole words only, or anywhere."""
    front, back = (S.STARTS, S.ENDS) if whole else ("", "")
    rows = [(p, F.regexp_count(low, F.lit(f"{front}{re.escape(p)}{back}"))) for p in phrases]
    entries = [F.when(k > 0, F.struct(F.lit(p).alias("key"), F.round(k / F.greatest(n, F.lit(1)) * 1000, digits).alias("value"))) for p, k in rows]
    return F.map_from_entries(F.array_compact(F.array(*entries))) if entries else F.expr("cast(map() as map<string, double>)")


def style_stats(docs: DataFrame, rules: StyleRules, text_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """The 14 groups of style statistics of each document; null counts as empty. One Arrow map, and phrase maps by expressions."""
    rows = M.mapped(docs.select(id_col, *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text")), STYLE, STYLE_COUNTS, lambda t: measured_style(t, rules), F.col("_text"))
    low = F.lower("_text")
    return rows.select(
        id_col, *keep, *(F.col(f"_m.{c}").alias(c) for c in STYLE_COUNTS), *(F.round(f"_m.{c}", d).alias(c) for c, d in zip(STYLE, PLACES, strict=True)),
        per_thousand(low, F.col("_m.word_count"), rules.transitions, 2, True).alias("transitions"), per_thousand(low, F.col("_m.word_count"), rules.phrases, 3, False).alias("phrases"),
    )


#: Means of a model, and the decimal places they are given with.
MODEL_MEANS = {"length_mean": 1, "burstiness": 3, "vocabulary_diversity": 3, "contractions": 2, "passive_percent": 1, "first_person": 2, "hedging": 2, "paragraph_words": 1}


def style_model(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A corpus' model, one row (or one per group): number of documents, means and deviations, range of vocabularies; sums of maps before the shuffle."""
    spread = ("length_mean", "burstiness", "contractions", "passive_percent", "em_dashes", "semicolons", "exclamations")
    return stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), *(F.round(F.avg(c), d).alias(f"{c}_mean") for c, d in MODEL_MEANS.items()), *(F.round(F.stddev_pop(c), 3).alias(f"{c}_sd") for c in spread),
        *(F.round(F.avg(c), 2).alias(f"{c}_mean") for c in ("em_dashes", "semicolons", "exclamations")), F.min("vocabulary_diversity").alias("vocabulary_least"), F.max("vocabulary_diversity").alias("vocabulary_most"),
    )


def sentence_lengths(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Mean, range and percentiles of all sentences' lengths. Distinct lengths are summed up first: they are few."""
    rows = docs.select(F.explode(F.transform(S.sentences_model(F.col(text_col)), lambda x: F.size(S.clean_words(x)))).alias("n"))
    shares = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    return rows.agg(F.round(F.avg("n"), 1).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), *(F.round(F.percentile("n", F.lit(q)), 1).alias(k) for k, q in shares.items()))


def top_starters(docs: DataFrame, k: int = 100, text_col: str = "text") -> DataFrame:
    """The k most frequent first words of sentences, ties by word, with their share of all sentences in percent."""
    firsts = docs.select(F.explode(S.sentences_model(F.col(text_col))).alias("s")).select(F.regexp_replace(F.lower(F.split("s", r"[ \t\n\r\f]+", 2)[0]), "[^a-z'-]", "").alias("word"))
    counts = firsts.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))  # one row
    return counts.filter("word != ''").orderBy(F.desc("n"), "word").limit(k).crossJoin(F.broadcast(whole)).select("word", "n", F.round(F.col("n") / F.col("_all") * 100, 2).alias("percent"))


def example_sentences(docs: DataFrame, k: int = 50, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``k`` sentences of 5 to 40 words, at equal steps through all such sentences in the documents' order."""
    rows = docs.select(id_col, F.posexplode(S.sentences_model(F.col(text_col))).alias("pos", "sentence")).filter(F.size(F.split("sentence", r"[ \t\n\r\f]+")).between(5, 40))
    placed = ranked(rows, [F.col(id_col), F.col("pos")], "_rank", "_all")
    step = F.floor(F.col("_all") / k)
    taken = placed.filter((step > 0) & (F.col("_rank") % F.greatest(step, F.lit(1)) == 0) & (F.col("_rank") < step * k) | (step == 0) & (F.col("_rank") == 0))
    return taken.select(id_col, "pos", "sentence")


def map_means(stats: DataFrame, map_col: str, digits: int) -> DataFrame:
    """Mean of each key of a map over all documents, missing ones as 0."""
    sums = stats.select(F.explode(map_col).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("_sum"))
    return sums.crossJoin(F.broadcast(stats.agg(F.count(F.lit(1)).alias("_n")))).select("key", F.round(F.col("_sum") / F.col("_n"), digits).alias("mean"))


def calibrated(model: DataFrame, transitions: DataFrame) -> DataFrame:
    """Thresholds from a one-row model and its mean transition frequencies."""
    total = transitions.agg(F.coalesce(F.sum("mean"), F.lit(0.0)).alias("_t"))
    up = lambda x: F.floor(F.round(x, 9) + 0.5).cast("bigint")
    return model.crossJoin(F.broadcast(total)).select(up(F.col("burstiness_mean") * 50).alias("burstiness_floor"), up(F.col("vocabulary_diversity_mean") * 85).alias("vocabulary_floor"), up(F.col("_t") * 200).alias("transition_ceiling"))


#: By place in the pattern, by how many deviations a target is off the mean. Fixed values.
LENGTH_PATTERN, MEAN_LENGTH, LEAST_LENGTH = (1.5, -0.5, -1.0, 0.0, 0.5), 18, 2


def length_targets(n: Column, deviation: Column) -> Column:
    """The sequence of target lengths for n sentences."""
    off = A.literal(LENGTH_PATTERN)
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(LEAST_LENGTH), F.floor(MEAN_LENGTH + deviation * F.get(off, i % len(LENGTH_PATTERN)) + 0.5).cast("int")))
    return F.when(n > 0, made).otherwise(F.array().cast("array<int>"))


# Voices and attribution

VOICE_COUNTS = ("n_sentences", "n_words")
VOICE = (
    "sentence_length", "sentence_sd", "type_token_ratio", "word_length", "contractions", "em_dashes", "semicolons", "asides", "exclamations", "passive_ratio", "first_person", "second_person", "hedging", "conjunction_starts",
    "paragraph_sentences", "paragraph_sd", "clause_length",
)


def measured_voice(text: str, hedges: Sequence[str]) -> tuple:
    """VOICE_COUNTS and VOICE of some samples; chr(0) stands between them."""
    samples = text.split("\0")
    whole = "\n\n".join(samples)
    cut = lambda t: sentences_quoted(t, S.MODEL_SHORT, True)
    sentences, words = [x for t in samples for x in cut(t)], whole.split()
    lengths = [len(BLANKS.split(x)) for x in sentences]
    clean = [c for c in (re.sub(r"[^A-Za-z0-9_']", "", w.lower()) for w in words) if len(c) > 2]
    paragraphs = [len(cut(p)) for p in re.split(r"\n\n+", whole) if p]
    starters = [c for c in (re.sub("[^a-z]", "", BLANKS.split(x)[0].lower()) for x in sentences) if c]
    n, s, low = len(words), len(sentences), whole.lower()
    per = lambda k, by: M.ratio(k, n) * by
    middle = M.mean(lengths)
    return (
        s, n, middle, M.deviation(lengths) if s > 1 else 0.0, len(set(clean)) / len(clean) if clean else 0.0, M.mean([len(c) for c in clean]), per(len(SHORTENED.findall(whole)), 100), per(whole.count("—"), 1000), per(whole.count(";"), 1000),
        per(len(ASIDE.findall(whole)), 1000), per(whole.count("!"), 1000), M.ratio(sum(len(p.findall(x)) for x in sentences for p in PASSIVES), s), per(sum(bool(FIRST_WORDS.match(w)) for w in words), 1000),
        per(sum(bool(SECOND_WORDS.match(w)) for w in words), 1000), M.ratio(sum(h in low for h in hedges), s) * 1000, M.ratio(sum(x in CONJUNCTIONS for x in starters), len(starters)),
        M.mean(paragraphs), M.deviation(paragraphs) if len(paragraphs) > 1 else 0.0, middle * 0.6,
    )


def voice_profiles(docs: DataFrame, by: str, hedges: Sequence[str] = (), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A profile's style from its 3 to 10 samples, taken as one text; profiles of fewer or more samples have none.

    Profiles are counted first, so that only the texts of at most ten samples ever meet.
    """
    few = docs.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("samples")).filter(F.col("samples").between(LEAST_SAMPLES, MOST_SAMPLES))
    texts = docs.select(by, id_col, F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\0", "").alias("_text")).join(few, by)
    whole = texts.groupBy(by, "samples").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col("_text").alias("t")))), lambda x: x["t"]), "\0").alias("_all"))
    rows = M.mapped(whole, VOICE, VOICE_COUNTS, lambda t: measured_voice(t, hedges), F.col("_all"))
    return rows.select(by, "samples", *(F.col(f"_m.{c}") for c in VOICE_COUNTS), *(F.round(f"_m.{c}", 6).alias(c) for c in VOICE))


#: Patterns of the features of attribution.
HEDGED = re.compile(r"\b(?:it could be|might be|possibly|perhaps|it seems|arguably)\b", re.IGNORECASE | re.ASCII)
ATTRIBUTION = ("sentence_length", "hedging", "passive", "contractions", "asides", "phrases")


def measured_attribution(text: str, phrases: re.Pattern) -> tuple:
    """One document's ATTRIBUTION features."""
    words, sentences = len(BLANKS.split(text)), [x for x in (p.strip(M.BLANKS) for p in re.findall(r"[^.!?]*[.!?]|[^.!?]+\Z", text)) if x]
    s = len(sentences)
    return words / s if s else 0.0, len(HEDGED.findall(text)) / words * 1000, sum(bool(PASSIVES[0].search(x)) for x in sentences) / s if s else 0.0, len(SHORTENED.findall(text)) / words * 100, len(ASIDE.findall(text)) / words * 1000, len(phrases.findall(text)) / words * 1000


def attribution_features(docs: DataFrame, phrases: Sequence[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The six features that fingerprints have ranges of; null counts as empty."""
    known = re.compile(rf"\b(?:{'|'.join(map(re.escape, phrases))})\b" if phrases else r"(?!)", re.IGNORECASE | re.ASCII)
    rows = M.mapped(docs.select(id_col, text_col), ATTRIBUTION, (), lambda t: measured_attribution(t, known), F.col(text_col))
    return rows.select(id_col, *(F.round(f"_m.{c}", 9).alias(c) for c in ATTRIBUTION))


# Issues

TRIPLET = r"(?i)\b\w+[ \t\n\r\f]*,[ \t\n\r\f]*\w+[ \t\n\r\f]*,?[ \t\n\r\f]*and[ \t\n\r\f]+\w+\b"
PASSIVE_KINDS = r"(?i)\b(?:is|are|was|were|been|being)[ \t\n\r\f]+\w+ed\b|(?i)\b(?:is|are|was|were)[ \t\n\r\f]+\w+en\b|\bIt[ \t\n\r\f]+(?:is|was)[ \t\n\r\f]+(?:shown|demonstrated|observed|noted|found)\b"


#: TRIPLET for Java, whose \b takes all letters for a word's where \w takes ASCII ones; the long s and the Kelvin sign count as s and k without case.
_EDGE, _LETTER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"[\wſ\u212A]"
#: Blanks before "and" are taken in one way only, as Java tries them all: a long run took time with its square.
_BEFORE_AND = r"[ \t\n\r\f]*,?[ \t\n\r\f]*and"
TRIPLET_JAVA = TRIPLET.replace(_BEFORE_AND, r"[ \t\n\r\f]*(?:,[ \t\n\r\f]*)?and").replace(r"\w", _LETTER).replace(r"\b", _EDGE)


def triplets(text: Column) -> Column:
    """How many runs of the form ``a, b, and c`` there are. Words are of ASCII letters, and end at any other."""
    return F.regexp_count(text, F.lit(TRIPLET_JAVA))


def style_issues(docs: DataFrame, rules: Sequence[tuple[str, str, str]], text_col: str = "text", id_col: str = "doc_id", run: int = 3, share: float = 0.6) -> DataFrame:
    """A row per issue: listed phrases (pattern, category, severity) with their counts, places where ``run`` sentences start with one word, and too many passives."""
    from scriptorium.operators.corpus import hits_of

    parts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_s", F.split("_text", r"(?<=[.!?])[ \t\n\r\f]+(?=[A-Z])"))
    firsts = F.transform("_s", lambda x: F.lower(F.regexp_extract(x, r"[^ \t\n\r\f]+", 0)))
    places = F.when(F.size("_f") >= run, F.sequence(F.lit(0), F.size("_f") - run)).otherwise(F.array().cast("array<int>"))
    repeats = F.filter(F.transform(places, lambda i: F.slice("_f", i + 1, run)), lambda w: (F.size(F.array_distinct(F.filter(w, lambda x: x != ""))) == 1))
    passive = F.size(F.filter("_s", lambda x: x.rlike(PASSIVE_KINDS)))
    row = lambda kind, severity, what, n: F.struct(F.lit(kind).alias("type"), severity.alias("severity"), what.alias("what"), n.cast("bigint").alias("n"))
    found = F.transform(hits_of(F.lower("_text"), rules), lambda h: row("phrase", h["severity"], h["pattern"], h["n"]))
    starts = F.transform("_r", lambda w: row("repeated start", F.lit("should_fix"), F.filter(w, lambda x: x != "")[0], F.lit(run)))
    passives = F.when(F.col("_p") > share * F.size("_s"), F.array(row("passive", F.lit("cosmetic"), F.lit(""), F.col("_p")))).otherwise(F.array().cast("array<struct<type:string,severity:string,what:string,n:bigint>>"))
    return parts.withColumn("_f", firsts).withColumn("_r", repeats).withColumn("_p", passive).select(id_col, F.inline(F.concat(found, starts, passives)))
