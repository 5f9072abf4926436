"""The second sentence score, its classes, and reports on documents made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import arrays as A
from scriptorium.functions import segment as S
from scriptorium.functions import text as X
from scriptorium.operators.scoring import Lexicon


#: Fixed values of D13: where a sentence starts, points of words, phrases and marks, bounds of length.
START = 35.0
FORMAL = rf"(?i){S.STARTS}(utilize|implement|facilitate|leverage|foster|cultivate|empower){S.ENDS}"
PASSIVE = rf"(?i){S.STARTS}(is|are|was|were|been|being)[ \t\n\r\f]+\w+ed{S.ENDS}"
SHORTENED = rf"(?i)[a-z]{{1,15}}'(?:t|s|re|ve|ll|d|m){S.ENDS}"
FIRST_PERSON, SECOND_PERSON = rf"(?i){S.STARTS}(I|me|my|we|us|our){S.ENDS}", rf"(?i){S.STARTS}you{S.ENDS}"
OPENING = rf"(?i)^(and|but|so|because|also|plus|or|well|ok|hey){S.ENDS}"
ARABIC = r"[\x{0600}-\x{06FF}]"


def score(part: Column, lexicon: Lexicon) -> Column:
    """From 35, less for listed phrases and openers, length, formal words, passives, hedges and even structure; more for signs of a voice.

    Sentences with Arabic letters are scored by the Arabic lists alone.
    """
    low, n = F.lower(part), F.size(F.split(part, r"[ \t\n\r\f]+"))
    even = n.between(10, 25) & part.rlike(r"^(?:[\w,.!?]+[ \t\n\r\f]+)*[\w,.!?]+\z") & part.rlike(r"[.!?]\z")

    def when(test: Column, points: float) -> Column:
        return F.when(test, F.lit(float(points))).otherwise(F.lit(0.0))

    def count(text: Column, phrases: tuple[str, ...], points: float) -> Column:
        return A.contained(text, A.literal(phrases)) * F.lit(float(points))

    def opened(text: Column, phrases: tuple[str, ...], points: float) -> Column:
        return F.size(F.filter(A.literal(phrases), lambda p: F.startswith(text, p))) * F.lit(float(points))

    total = (
        F.lit(START) + count(low, lexicon.phrases, -22) + opened(low, lexicon.starters, -12) + when(n > 35, -18) + when(n > 25, -8) + when(n.between(2, 5), 5) + when(part.rlike(FORMAL), -15) + when(part.rlike(PASSIVE), -8)
        + count(low, lexicon.hedges, -10) + count(low, lexicon.quantifiers, -6) + count(low, lexicon.indicators, 0.5) + F.regexp_count(part, F.lit(SHORTENED)) * F.lit(0.5) + when(part.rlike(FIRST_PERSON), 1) + when(part.rlike(SECOND_PERSON), 0.5)
        + when(F.endswith(part, F.lit("?")), 1) + when(F.endswith(part, F.lit("!")), 1) + when(F.contains(part, F.lit("—")) | F.contains(part, F.lit(" - ")), 1) + when(F.contains(part, F.lit("(")) & F.contains(part, F.lit(")")), 1)
        + when(part.rlike(OPENING), 1) + when(even, -18)
    )
    arabic = F.lit(START) + count(part, lexicon.arabic_phrases, -22) + opened(part, lexicon.arabic_starters, -12) + count(part, lexicon.arabic_transitions, -5) + count(part, lexicon.arabic_indicators, 5)
    return X.clamp(F.when(part.rlike(ARABIC), arabic).otherwise(total))


def classed(x: Column, floor: float = 55.0) -> Column:
    """Human from the floor on, maybe from 20 below it (20 at least); the floor is a parameter and no state."""
    return F.when(x >= floor, "human").when(x >= max(20.0, floor - 20), "maybe").otherwise("ai")


def sentence_rows(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", id_col: str = "doc_id", floor: float = 55.0) -> DataFrame:
    """A row per sentence with score and class."""
    rows = docs.select(id_col, F.posexplode(S.sentences_linear(F.col(text_col))).alias("pos", "part"))
    return rows.withColumn("score", score(F.col("part"), lexicon)).withColumn("class", classed(F.col("score"), floor))


def intervals(rows: DataFrame, id_col: str = "doc_id", floor: float = 55.0) -> DataFrame:
    """Mean, verdict, and an interval that widens with the scores' spread and for few sentences."""
    own = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"), F.var_pop("score").alias("v"))
    spread = F.sqrt(F.when(F.col("n") > 1, F.col("v")).otherwise(F.lit(400.0)))
    margin = F.least(F.lit(15.0), F.floor(F.round(spread * 0.6, 9) + F.when(F.col("n") < 5, 6.0).otherwise(2.0) + 0.5))
    low, high = (F.floor(F.round(x, 9) + 0.5) for x in (F.col("m") - margin, F.col("m") + margin))
    m = F.round("m", 9)
    return own.select(id_col, "n", F.round("m", 6).alias("score"), F.greatest(F.lit(0), low).cast("bigint").alias("lower"), F.least(F.lit(100), high).cast("bigint").alias("upper"), F.when(m >= floor, "human").when(m >= max(20.0, floor - 20), "mixed").otherwise("ai").alias("verdict"))


def extremes(rows: DataFrame, k: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The k lowest and k highest sentences of each document; ties by position."""
    low = F.row_number().over(W.partitionBy(id_col).orderBy("score", "pos"))
    high = F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("score"), "pos"))
    return rows.withColumn("lowest", low).withColumn("highest", high).filter((F.col("lowest") <= k) | (F.col("highest") <= k)).select(id_col, "pos", "score", F.when(F.col("lowest") <= k, F.col("lowest")).alias("lowest"), F.when(F.col("highest") <= k, F.col("highest")).alias("highest"))


def flagged(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sentences not classed as human by document, their share, and whether half or more are."""
    own = rows.groupBy(id_col).agg(F.count_if(F.col("class") != "human").alias("flagged"), F.count(F.lit(1)).alias("n"))
    return own.select(id_col, "flagged", "n", F.round(F.col("flagged") / F.col("n"), 6).alias("share"), (2 * F.col("flagged") >= F.col("n")).alias("escalate"))


def issues(part: Column, lexicon: Lexicon) -> Column:
    """The kinds of findings of a sentence, in the order in which they are scored."""
    low, n = F.lower(part), F.size(F.split(part, r"[ \t\n\r\f]+"))
    tests = {
        "phrase": A.contained(low, A.literal(lexicon.phrases)) > 0, "opener": F.exists(A.literal(lexicon.starters), lambda p: F.startswith(low, p)), "very long": n > 35, "long": n > 25,
        "formal": part.rlike(FORMAL), "passive": part.rlike(PASSIVE), "hedging": A.contained(low, A.literal(lexicon.hedges)) > 0,
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def report(rows: DataFrame, lexicon: Lexicon, id_col: str = "doc_id") -> DataFrame:
    """Per document the listed phrases found, how many sentences have which finding, and what follows from the score."""
    marked = rows.withColumn("issues", issues(F.col("part"), lexicon)).withColumn("found", F.filter(A.literal(lexicon.phrases), lambda p: F.contains(F.lower("part"), p)))
    names = ("phrase", "opener", "very long", "long", "formal", "passive", "hedging")
    own = marked.groupBy(id_col).agg(
        F.round(F.avg("score"), 6).alias("score"), *(F.count_if(F.array_contains("issues", name)).alias(name.replace(" ", "_")) for name in names),
        *(F.max(F.array_contains("found", p)).alias(f"_p{i}") for i, p in enumerate(lexicon.phrases)),
    )
    phrases = F.array_compact(F.array(*[F.when(F.col(f"_p{i}"), F.lit(p)) for i, p in enumerate(lexicon.phrases)])) if lexicon.phrases else F.array().cast("array<string>")
    return own.select(id_col, "score", *(name.replace(" ", "_") for name in names), F.array_join(phrases, ",").alias("phrases"), F.when(F.col("score") >= 55, "human").when(F.col("score") >= 35, "mixed").otherwise("ai").alias("verdict"))
