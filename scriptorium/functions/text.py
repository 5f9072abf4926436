"""Scalar functions on text, numbers and arrays."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.segment import strip


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole > 0, F.try_divide(part, whole)).otherwise(F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def normalized(text: Column) -> Column:
    """X1 without Unicode composition: soft hyphens, words broken at line ends, line breaks, control characters, blanks, blank lines."""
    steps = (("­", ""), (r"([A-Za-z])-\r?\n([A-Za-z])", "$1$2"), (r"\r\n?", "\n"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "), (r"\t", " "), (r" {2,}", " "), (r"\n{3,}", "\n\n"))
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, for which there is no built-in function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def strip_html(html: Column) -> Column:
    """Scripts, styles, comments and tags become blanks, the common entities their characters."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for name, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(by))
    return strip(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def hash31(text: Column) -> Column:
    """31-multiplier hash of the UTF-16 units, wrapped to 32 bits, as eight hex digits."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        powers = np.ones(1, np.uint32)

        def one(t: str | None) -> str | None:
            nonlocal powers
            if t is None:
                return None
            units = np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32)
            if len(units) > len(powers):
                powers = np.cumprod(np.r_[1, np.full(2 * len(units), 31)], dtype=np.uint32)
            return f"{int((units * powers[: len(units)][::-1]).sum(dtype=np.uint32)):08x}"

        return texts.map(one)

    return fold(text)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over characters; the texts of a batch advance together, character by character."""

    @F.pandas_udf("bigint")
    def fold(texts: pd.Series) -> pd.Series:
        points = [code_points(t) for t in texts if t is not None]
        sizes = np.array([len(p) for p in points], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([np.zeros(0, np.uint32), *(points[i] for i in order)])
        lengths = sizes[order]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
        state = np.full(len(points), 2166136261, np.uint32)
        live = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")  # texts longer than i
        for i, n in enumerate(live.tolist()):
            state[:n] = (state[:n] ^ flat[starts[:n] + i]) * np.uint32(16777619)
        out = np.empty(len(points), np.int64)
        out[order] = state
        found = iter(out.tolist())
        return pd.Series([None if t is None else next(found) for t in texts], dtype="Int64")

    return fold(text)


def trigram_fingerprint(text: Column, size: int = 64) -> Column:
    """Character trigrams hashed to ``size`` counts, scaled to length 1."""

    @F.pandas_udf("array<double>")
    def count(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float] | None:
            if t is None:
                return None
            c = code_points(t.lower())
            h = (c[:-2] * np.uint32(31) + c[1:-1]) * np.uint32(31) + c[2:] if len(c) > 2 else c[:0]
            out = np.bincount((h % np.uint32(size)).astype(np.int64), minlength=size).astype(float)
            norm = np.sqrt((out * out).sum())
            return (out / norm if norm else out).tolist()

        return texts.map(one)

    return count(text)


def normal_doi(doi: Column) -> Column:
    """Lower case, without resolver and prefix; null if empty."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(https?://)?(dx\.)?(doi\.org/)?(doi:)?", "")
    return F.when(bare != "", bare)


def normal_title(title: Column) -> Column:
    """Lower case, anything but letters and digits of ASCII one blank."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " "))


def identity_key(doi: Column, title: Column, year: Column) -> Column:
    """By DOI, or else by title and year."""
    return F.coalesce(F.concat(F.lit("doi:"), normal_doi(doi)), F.concat(F.lit("title:"), normal_title(title), F.lit("|"), F.coalesce(year.cast("string"), F.lit(""))))


def sigmoid(z: Column) -> Column:
    """X8"""
    return 1 / (1 + F.exp(-z))


def dot(a: Column, b: Column) -> Column:
    """Of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def term_cosine(a: Column, b: Column) -> Column:
    """Of the term counts of two token arrays; 0 if either is empty. Linear in their lengths."""

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: Sequence[str] | None, q: Sequence[str] | None) -> float:
            m, n = Counter(p if p is not None else ()), Counter(q if q is not None else ())
            whole = math.sqrt(sum(v * v for v in m.values())) * math.sqrt(sum(v * v for v in n.values()))
            return sum(v * n[k] for k, v in m.items()) / whole if whole else 0.0

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return similarity(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """X11: of the distinct elements of two arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def recall(wanted: Column, found: Column) -> Column:
    """Share of ``wanted``, duplicates counted, that is in ``found`` in any case; 1 if nothing is wanted."""
    low = F.transform(found, F.lower)
    hits = F.size(F.filter(wanted, lambda x: F.array_contains(low, F.lower(x))))
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(hits / F.size(wanted))


def band(x: Column, bounds: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first bound that x reaches."""
    out = None
    for least, name in bounds:
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    return out.otherwise(rest)


#: Bounds of grades and verdicts.
GRADES = ((95, "A+"), (88, "A"), (80, "B+"), (72, "B"), (60, "C"), (45, "D"))
VERDICTS = ((55, "human"), (35, "mixed"))


def grade(score: Column) -> Column:
    """X13"""
    return band(score, GRADES, "F")


def verdict(score: Column) -> Column:
    """X14"""
    return band(score, VERDICTS, "ai")


#: Silent endings, and groups of vowels.
SILENT, VOWELS = "(?:[^laeiouy]es|ed|[^laeiouy]e)$", "[aeiouy]{1,2}"


def syllables(word: Column) -> Column:
    """Groups of vowels of a lower-case word, without a silent ending; one at least."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    core = F.regexp_replace(F.regexp_replace(letters, SILENT, ""), "^y", "")
    groups = F.regexp_count(core, F.lit(VOWELS))
    return F.when(F.char_length(letters) <= 3, F.lit(1)).otherwise(F.greatest(groups, F.lit(1)))


def sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def readability(n_chars: Column, n_words: Column, n_sentences: Column, n_syllables: Column, n_complex: Column) -> dict[str, Column]:
    """The published formulas, from counts; 0 without words."""
    d = F.try_divide  # a formula may be evaluated before its guard
    wps, spw = d(n_words, n_sentences), d(n_syllables, n_words)
    per100 = d(F.lit(100.0), n_words)
    made = {
        "flesch": 206.835 - 1.015 * wps - 84.6 * spw,
        "flesch_kincaid": 0.39 * wps + 11.8 * spw - 15.59,
        "coleman_liau": 0.0588 * n_chars * per100 - 0.296 * n_sentences * per100 - 15.8,
        "fog": 0.4 * (wps + d(100.0 * n_complex, n_words)),
        "ari": d(4.71 * n_chars, n_words) + 0.5 * wps - 21.43,
        "smog": 1.043 * F.sqrt(d(30.0 * n_complex, n_sentences)) + 3.1291,
        "words_per_sentence": wps,
        "syllables_per_word": spw,
    }
    out = {k: F.when(n_words > 0, F.round(v, 10)).otherwise(F.lit(0.0)) for k, v in made.items()}
    return out | {"reading_minutes": F.ceil(n_words / 225.0).cast("bigint")}


def dale_chall(words: Column, n_sentences: Column, easy: Column) -> Column:
    """The published formula, from the share of words that aren't among the easy ones (an open list, a parameter); 0 without words."""
    n = F.size(words)
    hard = F.try_divide(100.0 * F.size(F.filter(words, lambda w: ~F.array_contains(easy, w))), n)
    score = 0.1579 * hard + 0.0496 * F.try_divide(n, n_sentences)
    return F.when(n > 0, F.round(score + F.when(hard > 5, 3.6365).otherwise(0.0), 10)).otherwise(F.lit(0.0))


def stage_range(text: str) -> list[int]:
    """``2-5`` or ``1,3-4`` as whole numbers in their order."""
    out: list[int] = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        low, _, high = part.partition("-")
        out += range(int(low), int(high or low) + 1)
    return sorted(set(out))


def stamped(ts: Column) -> dict[str, Column]:
    """A time as a date, as a stamp for file names, and in ISO form; UTC."""
    return {"date": F.date_format(ts, "yyyy-MM-dd"), "stamp": F.date_format(ts, "yyyyMMdd-HHmmss"), "iso": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")}


def mapped_value(key: Column, table: dict[str, str], usual: str) -> Column:
    """The value of a small table, or the usual one."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(usual)) if table else F.lit(usual)


#: Lower bounds of Flesch reading ease.
EASE = ((90, "very easy"), (80, "easy"), (70, "fairly easy"), (60, "standard"), (50, "fairly difficult"), (30, "difficult"))


def ease_label(flesch: Column) -> Column:
    """X18"""
    return band(flesch, EASE, "very difficult")


def run_cost(words: Column, provider: Column, rates: dict[str, float], usual: float, digits: int = 5) -> Column:
    """Words times 1.35 tokens, per thousand at the provider's rate."""
    rate = F.coalesce(F.create_map([F.lit(x) for kv in rates.items() for x in kv])[provider], F.lit(usual)) if rates else F.lit(usual)
    return F.round(F.ceil(words * 1.35) / 1000.0 * rate, digits)


def confidence(score: Column) -> tuple[Column, Column]:
    """Distance from 50, doubled, and its band."""
    sure = F.abs(score - 50) * 2
    return sure, F.when(sure >= 75, "high").when(sure >= 45, "medium").otherwise("low")


def preserve_case(word: Column, by: Column) -> Column:
    """The replacement in the case of the word it stands for."""
    first = F.substring(word, 1, 1)
    return F.when((word == F.upper(word)) & (F.char_length(word) > 1), F.upper(by)).when(first == F.upper(first), F.concat(F.upper(F.substring(by, 1, 1)), F.expr("''"), F.substr(by, F.lit(2)))).otherwise(by)


def naturalness(n_distinct: Column, n_words: Column, variance: Column) -> Column:
    """0.6 of the distinct share, and up to 0.4 by variance of sentence length."""
    return 0.6 * ratio(n_distinct, n_words) + F.least(variance / 10, F.lit(0.4))


def with_ending(text: Column, model: Column) -> Column:
    """The text with the closing mark of the model sentence."""
    mark = F.regexp_extract(F.trim(model), r"([.!?]+)$", 1)
    return F.concat(F.regexp_replace(F.trim(text), r"[.!?]+$", ""), F.when(mark == "", F.lit(".")).otherwise(mark))


def capitalized(text: Column) -> Column:
    """X27"""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))
