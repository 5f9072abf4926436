"""Checks of manuscripts and of rewritten versions, and the report that sums them up."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import segment as S
from scriptorium.functions import text as X
from scriptorium.operators import extract

#: Phrases of compliance statements.
COMPLIANCE = {
    "data_availability": ("data availability", "data are available", "data is available", "available at"),
    "ethics": ("ethics", "irb", "institutional review", "ethical approval", "consent"),
    "conflict": ("conflict of interest", "competing interest", "no conflict"),
    "contributions": ("author contribution", "contributions:", "conceived", "designed the study"),
}
#: A work's field by the first pattern that holds.
FIELDS = (
    (r"computer|software|algorithm|neural|machine learning|deep learning|ai\b|nlp|data science", "Computer Science"), (r"medical|clinical|health|disease|patient|cancer|treatment|drug|hospital", "Medicine"),
    (r"physics|quantum|energy|material|chemistry|molecular|chemical", "Physical Sciences"), (r"biology|gene|cell|protein|evolution|ecology|organism", "Life Sciences"),
    (r"math|statistic|probability|equation|theorem", "Mathematics"), (r"engineer|mechanical|electrical|civil|structural|design", "Engineering"),
    (r"psychology|cognitive|behavior|mental|social|sociology", "Social Sciences"), (r"economic|finance|market|business|management", "Economics & Business"),
    (r"environment|climate|sustain|ecology|earth", "Environmental Science"), (r"education|learn|teach|student|curriculum", "Education"),
)
OTHER_FIELD = "Multidisciplinary"


def compliance(text: Column) -> dict[str, Column]:
    """whether each kind of compliance statement is in the text."""
    low = F.lower(text)
    return {k: F.greatest(*[F.contains(low, F.lit(p)) for p in phrases]) for k, phrases in COMPLIANCE.items()}


def field_of(text: Column) -> Column:
    """F14"""
    low, out = F.lower(text), None
    for pattern, name in FIELDS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(OTHER_FIELD)


@dataclass(frozen=True)
class RecordRules:
    """What a bibliographic record must have. The values are fixed ones."""

    languages: tuple[str, ...] = ("en",)
    licenses: tuple[str, ...] = ("cc-by", "cc-by-sa", "cc0", "cc-by-nc", "cc-by-nc-sa", "cc-by-nd", "cc-by-nc-nd")
    least_abstract: int = 400
    least_title: int = 12
    least_cited: int = 0
    years: tuple[int, int] = (2010, 2100)
    doi: bool = True
    article: bool = True
    open_access: bool = True


def record_checks(rules: RecordRules) -> dict[str, Column]:
    """the nine predicates on columns title, abstract, is_open_access, doi, type, license, cited_by, year, language."""
    c = F.col
    plain = lambda name: F.lower(F.trim(F.coalesce(c(name), F.lit(""))))
    sample = F.trim(F.concat(F.coalesce(c("title"), F.lit("")), F.lit(" "), F.coalesce(c("abstract"), F.lit(""))))
    english = (F.regexp_count(sample, F.lit("[A-Za-z]")) >= 50) & (F.regexp_count(sample, F.lit(r"[^\x00-\x7F]")) / F.greatest(F.char_length(sample), F.lit(1)) < 0.08)
    known = plain("language") != ""
    checks = {
        "missing_or_short_title": F.char_length(F.trim(c("title"))) >= rules.least_title, "short_abstract": F.char_length("abstract") >= max(rules.least_abstract, 1), "not_open_access": c("is_open_access") if rules.open_access else F.lit(True),
        "missing_doi": F.coalesce(c("doi"), F.lit("")) != "" if rules.doi else F.lit(True), "not_journal_article": plain("type") == "journal-article" if rules.article else F.lit(True), "license_not_allowlisted": plain("license").isin(*rules.licenses),
        "low_citation_count": c("cited_by").isNull() | (c("cited_by") >= rules.least_cited), "publication_year_out_of_range": c("year").isNull() | c("year").between(*rules.years), "language_not_allowlisted": ~known | plain("language").isin(*rules.languages),
    }
    return checks | ({"language_detection_failed": known | english} if "en" in rules.languages else {})


# Facts of versions


def kept_fact(value: str, low: str) -> bool:
    """E4 of one fact: as it stands, or else all of its numbers with one of its words, or without numbers half of its words."""
    value = value.lower()
    if value in low:
        return True
    numbers, words = re.findall(r"\d+\.?\d*", value), [w for w in re.findall(r"[a-z]+", value) if len(w) > 2]
    if numbers:
        return all(n in low for n in numbers) and (not words or any(w in low for w in words))
    return bool(words) and sum(w in low for w in words) >= max(1, len(words) * 0.5)


def facts_kept(pairs: DataFrame, a: str = "original", b: str = "rewritten") -> DataFrame:
    """Adds n_facts of the original, those lost in the rewritten text (kind and value), the share kept (1 without facts) and passed."""

    @F.pandas_udf("struct<n: int, lost: array<string>>")
    def compare(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y, strict=True):
            found, low = extract.scan_facts(p or ""), (q or "").lower()
            rows.append((len(found), [f"({kind}) {value}" for kind, value, *_ in found if not kept_fact(value, low)]))
        return pd.DataFrame(rows, columns=["n", "lost"])

    out = pairs.withColumn("_f", compare(a, b))
    n, lost = F.col("_f.n"), F.col("_f.lost")
    return out.select(*pairs.columns, n.alias("n_facts"), lost.alias("lost_facts"), F.round(F.when(n > 0, 1 - F.size(lost) / n).otherwise(F.lit(1.0)), 6).alias("fact_score"), (F.size(lost) == 0).alias("facts_passed"))


def preserved(pairs: DataFrame, a: str = "original", b: str = "rewritten") -> DataFrame:
    """Accepted if facts are kept and the markup's keys are the same on both sides."""
    both = extract.integrity(facts_kept(pairs, a, b), a, b)
    return both.withColumn("verdict", F.when(F.col("facts_passed") & F.col("valid"), "accepted").otherwise("rejected"))


# Structure


def order_issues(found: Column, expected: Sequence[str] = extract.EXPECTED_ORDER) -> Column:
    """Position, expected and found of each place at which the kinds present differ from the expected order."""
    known = F.array(*map(F.lit, expected))
    present = F.array_distinct(F.filter(found, lambda x: F.array_contains(known, x)))
    wanted = F.filter(known, lambda x: F.array_contains(present, x))
    rows = F.zip_with(F.sequence(F.lit(1), F.size(wanted)), F.arrays_zip(wanted.alias("expected"), present.alias("found")), lambda i, z: F.struct(i.alias("position"), z["expected"].alias("expected"), z["found"].alias("found")))
    return F.when(F.size(wanted) > 0, F.filter(rows, lambda r: r["expected"] != r["found"])).otherwise(F.array().cast("array<struct<position:int,expected:string,found:string>>"))


def structure(section_rows: DataFrame, text: Column, id_col: str = "doc_id") -> DataFrame:
    """Per document sections, words, missing and misplaced sections, how many are more than half of it, and its paragraphs' lengths.

    ``text`` is the content of a row's section. Paragraphs of more than five words count; long ones have over 200, short ones under 30.
    """
    own = section_rows.withColumn("_n", F.size(S.blank_words(text))).withColumn("_l", F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.size(S.blank_words(p))), lambda n: n > 5))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("position", "kind"))), lambda x: x["kind"])  # the sections of one document
    docs = own.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_sections"), F.sum("_n").alias("n_words"), F.max("_n").alias("_most"), kinds.alias("_kinds"), F.flatten(F.collect_list("_l")).alias("_p"))
    found = F.filter("_kinds", lambda x: x != "unknown")
    n = F.size("_p")
    return docs.withColumn("_o", order_issues(found)).select(
        id_col, "n_sections", "n_words", F.array_sort(F.array_except(F.array(*map(F.lit, extract.NEEDED_SECTIONS)), found)).alias("missing"),
        F.transform("_o", lambda r: F.concat(r["position"].cast("string"), F.lit(":"), r["expected"], F.lit("/"), r["found"])).alias("order_issues"), (F.size("_o") == 0).alias("in_order"),
        F.round(F.try_divide(100.0 * F.col("_most"), F.greatest("n_words", F.lit(1))), 1).alias("largest_percent"), n.alias("n_paragraphs"),
        F.round(F.try_divide(X.sum_of(F.col("_p")), F.greatest(n, F.lit(1))), 1).alias("paragraph_words"), F.size(F.filter("_p", lambda x: x > 200)).alias("long_paragraphs"), F.size(F.filter("_p", lambda x: x < 30)).alias("short_paragraphs"),
    )


@dataclass(frozen=True)
class Journal:
    """What a journal asks for."""

    name: str
    abstract_words: int | None = None
    order: tuple[str, ...] = ()
    keywords: bool = False


def journal_checks(section_rows: DataFrame, text: Column, journal: Journal, id_col: str = "doc_id") -> DataFrame:
    """Per document the words of its abstract, issues (abstract_length, section_order, keywords) and whether none of the first two is there."""
    rows = section_rows.withColumn("_n", F.when(F.col("kind") == "abstract", F.size(S.blank_words(text))))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("position", "kind"))), lambda x: x["kind"])
    docs = rows.groupBy(id_col).agg(F.min_by("_n", F.when(F.col("_n").isNotNull(), F.col("position"))).alias("abstract_words"), kinds.alias("_kinds"))
    wanted = F.array(*map(F.lit, journal.order)) if journal.order else F.array().cast("array<string>")
    places = F.filter(F.transform(F.array_distinct("_kinds"), lambda x: F.array_position(wanted, x)), lambda i: i > 0)
    long = F.coalesce(F.col("abstract_words") > journal.abstract_words, F.lit(False)) if journal.abstract_words else F.lit(False)
    out_of_order = places != F.array_sort(places)
    issues = F.array_compact(F.array(F.when(long, "abstract_length"), F.when(out_of_order, "section_order"), F.when(F.lit(journal.keywords), "keywords")))
    return docs.select(id_col, "abstract_words", issues.alias("issues"), (~long & ~out_of_order).alias("compliant"))


def quality_report(checks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Status, compliance, grades of argument and method, and recommendations.

    ``checks`` has per document kinds (of its sections), risk, markers (grave phrases that occur), missing_compliance, cited and verified.
    """
    required = F.array(*map(F.lit, extract.REQUIRED_SECTIONS))
    missing = F.array_except(required, F.col("kinds"))
    whole = F.size(missing) == 0
    warnings = F.concat(
        F.array_compact(F.array(F.when(F.col("risk") == "high", "risk high"), F.when(F.col("risk") == "medium", "risk medium"), F.when(F.size("markers") > 0, F.concat(F.lit("markers: "), F.array_join(F.slice("markers", 1, 5), ", "))))),
        F.slice(missing, 1, 3),
    )
    return checks.select(
        id_col, F.when(whole, "success").otherwise("warnings").alias("status"), (whole & (F.col("risk") != "high") & (F.col("missing_compliance") == 0)).alias("compliant"), F.array_intersect(required, "kinds").alias("complete"), missing.alias("missing"),
        F.when(whole, "strong").otherwise("adequate").alias("argumentation"), F.when(F.array_contains("kinds", "methodology"), "strong").otherwise("weak").alias("methodology"), "cited", "verified", warnings.alias("recommendations"),
    )


# Caches and lookups


def cache_totals(entries: DataFrame, hits: str = "hits", cost: str = "cost") -> DataFrame:
    """Entries, hits, and what the hits saved."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(hits), F.lit(0)).alias("hits"), F.round(F.coalesce(F.sum(F.col(hits) * F.col(cost)), F.lit(0.0)), 6).alias("saved"))


def path_or_zero(column: str) -> Column:
    """A nested value, 0 if it or what it stands in is missing."""
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))
