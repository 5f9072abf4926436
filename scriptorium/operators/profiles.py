"""Voice profiles, attribution, ensembles, structure, reviews, citations and bibliographic records."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import arrays as A
from scriptorium.functions import segment as S
from scriptorium.functions import text as X

#: Bounds of the deviation of grade levels with score and verdict; weights of the ensemble; acceptance bands.
CONSISTENCY = ((5.0, 90, "natural"), (3.0, 65, "natural"), (1.5, 45, "suspicious"), (0.0, 20, "very_suspicious"))
ENSEMBLE = {"built_in": 0.50, "slop": 0.25, "consistency": 0.15, "attribution": 0.10}
ACCEPTANCE = ((8.0, 0.75), (7.0, 0.50), (6.0, 0.30), (5.0, 0.15))

Fingerprint = tuple[str, str, float, float]


def profile_differences(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Of two one-row profiles, a row per feature with both values and their distance."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a.{c}").cast("double").alias("first"), F.col(f"b.{c}").cast("double").alias("second"), F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")).cast("double").alias("distance")) for c in columns])
    return a.alias("a").crossJoin(F.broadcast(b.limit(1)).alias("b")).select(F.inline(rows))


def lower(text: Column) -> Column:
    """Lower case, where a dotted capital I has i as in SQL, without a mark behind."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def consistency(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_words: int = 10) -> DataFrame:
    """Deviation of the grade level over paragraphs of ``least_words`` or more; 75 with less than two such."""
    paragraphs = F.filter(S.paragraphs(F.col("text"), "lines"), lambda p: F.size(S.blank_words(p)) >= least_words)
    parts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(id_col, F.posexplode_outer(paragraphs).alias("pos", "p"))
    words = F.regexp_extract_all(lower(F.col("p")), F.lit("[a-z]+"), F.lit(0))
    counted = parts.withColumn("w", words).withColumn("n", F.size("w")).withColumn("s", S.sentence_count(F.col("p"))).withColumn("y", A.total(F.transform("w", X.syllables)))
    grade = F.when(F.col("n") > 0, 0.39 * F.try_divide("n", "s") + 11.8 * F.try_divide("y", "n") - 15.59).otherwise(F.lit(0.0))
    own = counted.withColumn("g", F.when(F.col("p").isNotNull(), grade)).groupBy(id_col).agg(F.count("g").alias("paragraphs"), F.coalesce(F.stddev_pop("g"), F.lit(0.0)).alias("d"))
    few, score, verdict = F.col("paragraphs") < 2, F.lit(None), F.lit(None)
    score, verdict = F.when(few, 75), F.when(few, "natural")
    for bound, points, name in CONSISTENCY:
        score, verdict = score.when(F.round("d", 9) >= bound, points), verdict.when(F.round("d", 9) >= bound, name)
    return own.select(id_col, "paragraphs", F.round("d", 6).alias("deviation"), score.alias("score"), verdict.alias("verdict"))


def attribution(features: DataFrame, fingerprints: Sequence[Fingerprint], id_col: str = "doc_id") -> DataFrame:
    """The fingerprint with the highest mean of triangular scores, ties by name; and that mean.

    Fingerprints (name, feature, low, high) are a rule table of some rows and become literals.
    """
    names = sorted({f[0] for f in fingerprints})

    def mean(name: str) -> Column:
        own = [F.greatest(F.lit(0.0), 1 - F.abs(F.col(c) - (low + high) / 2) / ((high - low) / 2 * 3)) for n, c, low, high in fingerprints if n == name]
        return sum(own, F.lit(0.0)) / len(own)

    ranked = F.array_sort(F.array(*[F.struct((-F.round(mean(n), 9)).alias("r"), F.lit(n).alias("name")) for n in names]))
    return features.select(id_col, ranked[0]["name"].alias("model"), (-ranked[0]["r"]).alias("confidence"))


def ensemble(scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Weighted score of the columns of ENSEMBLE (0 to 100), rounded half up, and verdict."""
    score = F.floor(F.round(sum((F.col(k) * w for k, w in ENSEMBLE.items()), F.lit(0.0)), 9) + 0.5)
    return scores.select(id_col, score.cast("bigint").alias("score"), X.verdict(score).alias("verdict"))


def radar(scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per part of the ensemble: axis, value from 0 to 100, and its weight."""
    rows = F.array(*[F.struct(F.lit(k).alias("axis"), F.least(F.greatest(F.col(k).cast("double"), F.lit(0.0)), F.lit(100.0)).alias("value"), F.lit(w).alias("weight")) for k, w in ENSEMBLE.items()])
    return scores.select(id_col, F.inline(rows))


def detector_mean(scores: Sequence[Column]) -> Column:
    """The mean of the detectors that have a score; null without any."""
    known = F.array_compact(F.array(*[c.cast("double") for c in scores]))
    return F.when(F.size(known) > 0, F.try_divide(X.sum_of(known), F.size(known)))


def local_probability(score: Column) -> Column:
    """What stands in for an external detector: the complement of the local score."""
    return F.round(1 - score / 100, 4)


def slop_score(text: Column, words: Sequence[str]) -> dict[str, Column]:
    """listed words, how many there are per thousand words, and 100 less 15 for each of those; all words count, whatever their severity. A null text has a score of 0."""
    n = F.size(F.split(text, r"[ \t\n\r\f]+"))
    hits = F.regexp_count(lower(text), F.lit(rf"{S.STARTS}(?:{'|'.join(re.escape(w) for w in words)}){S.ENDS}"))
    density = F.when(text.isNotNull(), X.ratio(hits * 1000.0, n))
    return {"n": hits.cast("bigint"), "density": F.round(density, 2), "slop": F.floor(X.clamp(100.0 - 15.0 * density) + 0.5).cast("bigint")}


def slop_hits(docs: DataFrame, rules: Sequence[tuple[str, str, str]], text_col: str, id_col: str) -> DataFrame:
    """a row per listed word (word, replacement, severity) and place in the lower-case text."""
    known = [(w, by, severity, re.compile(rf"\b{re.escape(w)}\b", re.ASCII)) for w, by, severity in rules]

    @F.pandas_udf("array<struct<word: string, replacement: string, severity: string, position: int>>")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [(w, by, severity, m.start()) for w, by, severity, p in known for m in p.finditer(t.lower())])

    return docs.select(id_col, F.inline(scan(text_col)))


def balance(sections: DataFrame, by: str, length: str) -> DataFrame:
    """Each section's share of its document in percent, and whether it is more than half."""
    share = F.try_divide(100.0 * F.col(length), F.greatest(F.sum(length).over(W.partitionBy(by)), F.lit(1)))
    return sections.withColumn("share", F.round(share, 1)).withColumn("dominant", share > 50)


def reviews(scores: DataFrame, by: str, score: str, weight: str) -> DataFrame:
    """Weighted mean of reviewers' scores and the chance of acceptance of its band."""
    mean = F.try_divide(F.sum(F.col(score) * F.col(weight)), F.sum(weight))
    chance = None
    for bound, p in ACCEPTANCE:
        chance = F.when(F.col("overall") >= bound, p) if chance is None else chance.when(F.col("overall") >= bound, p)
    return scores.groupBy(by).agg(F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("overall")).withColumn("acceptance", chance.otherwise(0.05))


def recommended(scores: DataFrame, rules: DataFrame, domain: str, score: str) -> DataFrame:
    """Rows of the rule table (low, high, domain or null, journal, match) whose band has the score; a null domain is for all that have no rule of their own.

    A rule table of some rows, broadcast by the planner.
    """
    own = rules.filter("rule_domain IS NOT NULL").select("rule_domain").distinct().withColumnRenamed("rule_domain", "_known")
    marked = scores.join(own, F.col(domain) == F.col("_known"), "left").withColumn("_d", F.col("_known")).drop("_known")
    return marked.join(rules, (F.col(score) >= F.col("low")) & (F.col(score) < F.col("high")) & F.col("_d").eqNullSafe(F.col("rule_domain"))).drop("_d", "rule_domain", "low", "high")


def claims(docs: DataFrame, text_col: str, id_col: str, pattern: str) -> DataFrame:
    """A row per (sentence, cited key); searched in the markup, where citations still are."""
    from scriptorium.operators.extract import keys

    rows = docs.select(id_col, F.posexplode(S.sentences_at_blank(F.col(text_col))).alias("pos", "claim"))
    return rows.withColumn("cite_key", F.explode(keys(F.col("claim"), pattern)))


def supported(claim_rows: DataFrame, abstracts: DataFrame, key: str = "cite_key", abstract: str = "abstract", least: float = 0.25) -> DataFrame:
    """Claims with their source's abstract, likeness and support; unknown where there is no abstract."""
    joined = claim_rows.join(abstracts, key, "left")
    like = X.jaccard(S.words(F.col("claim")), S.words(F.col(abstract)))
    return joined.withColumn("similarity", F.when(F.col(abstract).isNotNull(), F.round(like, 9))).withColumn("supported", F.col("similarity") >= least).drop(abstract)


def verified_ratio(claim_rows: DataFrame, known: DataFrame, by: str, key: str = "cite_key") -> DataFrame:
    """Share of a document's distinct keys that are in a table of known works."""
    keys = claim_rows.select(by, key).distinct().join(known.select(key).distinct().withColumn("_known", F.lit(1)), key, "left")
    return keys.groupBy(by).agg(F.count(F.lit(1)).alias("cited"), F.count("_known").alias("verified"), F.round(F.count("_known") / F.count(F.lit(1)), 6).alias("ratio"))


BIB_ITEM = r"\\bibitem(?:\[[^\]]*\])?\{([^}]*)\}\s*([^\\]*)"


def bibliography(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Key and title of each entry of a bibliography: what stands behind the key up to the next command."""
    entries = F.regexp_extract_all(text_col, F.lit(BIB_ITEM), F.lit(0))
    rows = docs.select(id_col, F.explode(entries).alias("_e"))
    return rows.select(id_col, F.regexp_extract("_e", BIB_ITEM, 1).alias("cite_key"), F.trim(F.regexp_extract("_e", BIB_ITEM, 2)).alias("title"))


def inverted_index_text(index: Column) -> Column:
    """The text of a map from token to its positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["t"]), " ")


def work_records(works: DataFrame) -> DataFrame:
    """Bibliographic works (nested) as flat records; at most ten authors; licence before access colour."""
    authors = F.transform("authorships", lambda a: a["author"]["display_name"])
    return works.select(
        "id", X.normal_doi(F.col("doi")).alias("doi"), "title", inverted_index_text(F.col("abstract_inverted_index")).alias("abstract"), F.slice(authors, 1, 10).alias("authors"), F.get(authors, F.lit(0)).alias("first_author"),
        F.coalesce(F.col("open_access.license"), F.col("open_access.oa_status")).alias("license"), F.col("open_access.is_oa").alias("is_open_access"), F.col("primary_location.source.display_name").alias("journal"),
        F.col("publication_year").alias("year"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by"),
    )


FENCED = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.IGNORECASE)
JSON_MARKS = re.compile(r'\\[\s\S]?|["{}]')


def refused(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def scan_json(text: str) -> str | None:
    """The object from the first brace to the one that closes it, of a fenced block if there is one; braces in strings don't count."""
    fenced = FENCED.search(text)
    text = (fenced[1] if fenced else "") or text
    start, depth, inside = text.find("{"), 0, False
    for m in JSON_MARKS.finditer(text, start) if start >= 0 else ():
        if m[0] == '"':
            inside = not inside
        elif not inside and m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if not depth:
                try:
                    json.loads(text[start : m.end()], parse_constant=refused)
                except (ValueError, RecursionError):
                    return None
                return text[start : m.end()]
    return None


def first_json(text: Column) -> Column:
    """The first JSON object in a text, as it stands there; null without one."""

    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else scan_json(t))

    return scan(text)


def listed(text: Column) -> Column:
    """The items of a JSON array of strings, or else the lines without bullets and numbers."""
    lines = F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda x: x != "")
    return F.coalesce(F.from_json(F.when(F.trim(text).startswith("["), F.trim(text)), "array<string>", {"mode": "PERMISSIVE"}), lines)


def review_scores(text: Column, names: Sequence[str]) -> dict[str, Column]:
    """A score from 1 to 10 behind each name, 5 without one."""

    def score(name: str) -> Column:
        found = F.regexp_extract(text, rf"(?i){name}\s*[:=-]?\s*(\d+(?:\.\d+)?)", 1)
        return F.when(found != "", F.least(F.greatest(found.try_cast("double"), F.lit(1.0)), F.lit(10.0))).otherwise(F.lit(5.0))

    return {n: score(n) for n in names}


def version_report(scores: DataFrame, a: str = "before", b: str = "after", hits_a: str = "hits_before", hits_b: str = "hits_after") -> DataFrame:
    """Change of score, share of patterns removed (0 without any), and readiness."""
    removed = F.when(F.col(hits_a) > 0, F.try_divide((F.col(hits_a) - F.col(hits_b)) * 100.0, F.col(hits_a))).otherwise(F.lit(0.0))
    return scores.withColumn("delta", F.round(F.col(b) - F.col(a), 6)).withColumn("removed_percent", F.round(removed, 6)).withColumn("readiness", F.round(0.5 * F.col(b) + 0.3 * X.clamp(removed) + 0.2 * X.clamp(50 + F.col(b) - F.col(a)), 6))
