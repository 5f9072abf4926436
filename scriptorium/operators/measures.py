"""Measures of whole documents that need many looks at the same tokens: one Arrow map that segments a text once.

The Column functions of :mod:`scriptorium.functions` are the same rules one by one; here a text is cut into tokens
and sentences once, tokens are counted once, and all measures come from those counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import groupby

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import segment as S

BLANKS = " \t\n\r\f"
LETTER_TOKEN = r"\p{L}+(?:['’-]\p{L}+)?"
TOKEN = regex.compile(LETTER_TOKEN)
WORD = regex.compile(r"[\p{L}\p{N}_]+")
#: Letters, digits and underscores of Unicode 15.0, whose tables SQL's patterns have: without CJK extension I.
LETTER_150 = r"[^\W\U0002EBF0-\U0002EE5D]"
WORD_150 = re.compile(LETTER_150 + "+")
#: From the first place of a letter that came after Unicode 15.0.
LATE = re.compile("[\u0558-\U0010FFFF]")
#: U+0001 cuts too, as SQL marks its cuts by it.
CAPITAL_END = re.compile(r"(?<=[.!?])[ \t\n\r\f]+(?=[A-Z])|\x01")
PAPERS_END = re.compile(r"[.!?](?=\Z|[ \t\n\r\f\"')\]])")
#: The long s counts as s without case.
PAPERS_SHORT = re.compile(rf"(?:\A|[ \t\n\r\f()\[\]\"])(?:{S.either(S.PAPERS_SHORT).replace('s', '[sſ]')})[.!?]{{1,9}}\Z", re.IGNORECASE | re.ASCII)
#: Characters that an abbreviation with its marks and what stands before take.
LOOK_BACK = max(map(len, S.PAPERS_SHORT)) + 10


def lower(text: str) -> str:
    """Lower case letter by letter, as SQL has it: Python makes two of a dotted capital I, and another sigma at ends of words."""
    return text.replace("\u0130", "i").replace("Σ", "σ").lower()


@cache
def token_150() -> tuple[re.Pattern, regex.Pattern]:
    """Letters that came after Unicode 15.0, and tokens without them."""
    letters = regex.findall(r"\p{L}", "".join(map(chr, range(0x558, 0x40000))))
    newer = [ord(c) for c in letters if unicodedata.category(c)[0] != "L" or "\U0002EBF0" <= c <= "\U0002EE5D"]
    runs = [[x for _, x in run] for _, run in groupby(enumerate(newer), lambda e: e[1] - e[0])]
    known = "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs) or "\U0002EBF0-\U0002EE5D"
    return re.compile(f"[{known}]"), regex.compile(LETTER_TOKEN.replace(r"\p{L}", rf"(?:(?![{known}])\p{{L}})"))


def letter_tokens(*texts: str) -> list[list[str]]:
    """T12 of parts of one text in lower case, the whole first, by the letters of Unicode 15.0."""
    found = TOKEN
    if LATE.search(texts[0]):
        newer, known = token_150()
        found = known if newer.search(texts[0]) else TOKEN
    return [found.findall(x) for x in texts]


def sentences_papers(text: str) -> list[str]:
    """T4 of one text; U+0001 cuts too and U+0002 goes, as SQL marks by them."""
    out, start = [], 0
    for m in PAPERS_END.finditer(text):
        end = m.end()
        if not PAPERS_SHORT.search(text[max(0, end - LOOK_BACK) : end]):
            out.append(text[start:end])
            start = end
    out.append(text[start:])
    return [x for x in (p.replace("\x02", "").strip(BLANKS) for o in out for p in o.split("\x01")) if x]


def sentences_before_capital(text: str) -> list[str]:
    """T1 of one text."""
    return [x for x in (p.strip(BLANKS) for p in CAPITAL_END.split(text)) if x]


def paragraphs(text: str) -> list[str]:
    """T10 of one text."""
    return [x for x in (p.strip(BLANKS) for p in re.split(r"\n{2,}", text)) if x]


def mean(values: Sequence[float]) -> float:
    return sum(values) / len(values) if values else 0.0


def deviation(values: Sequence[float]) -> float:
    """Of the population, from the sums of values and squares."""
    if not values:
        return 0.0
    middle = mean(values)
    return max(sum(x * x for x in values) / len(values) - middle * middle, 0.0) ** 0.5


def stepwise_deviation(values: Sequence[float]) -> float:
    """Of the population, by Welford's steps, as DuckDB has it: at a half of the last digit the last bit counts."""
    middle = squares = 0.0
    for k, x in enumerate(values, 1):
        before, middle = middle, middle + (x - middle) / k
        squares += (x - middle) * (x - before)
    return (squares / len(values)) ** 0.5 if values else 0.0


def ratio(part: float, whole: float) -> float:
    return part / whole if whole > 0 else 0.0


def members(counts: Counter, known: Sequence[str]) -> int:
    return sum(counts[x] for x in set(known))


def distinct_share(parts: Sequence) -> float:
    return ratio(len(set(parts)), len(parts))


def grams(tokens: Sequence[str], n: int) -> list[tuple[str, ...]]:
    return list(zip(*(tokens[k:] for k in range(n)), strict=False)) if len(tokens) >= n else []


def mapped(docs: DataFrame, names: Sequence[str], counts: Sequence[str], measure: Callable[..., tuple], *inputs: Column) -> DataFrame:
    """The rows with struct _m of ``counts`` (whole numbers) and ``names`` (floating), measured batch by batch."""
    kind = ", ".join([*(f"{c}: bigint" for c in counts), *(f"{n}: double" for n in names)])

    @F.pandas_udf(f"struct<{kind}>")
    def measured(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)  # one input comes as it is
            yield pd.DataFrame([measure(*(x or "" for x in row)) for row in zip(*columns, strict=True)], columns=[*counts, *names])

    return docs.select("*", measured(*inputs).alias("_m"))


def recalled(wanted: Column, found: Column) -> Column:
    """Share of ``wanted``, duplicates counted, that is in ``found``; 1 if nothing is wanted. Linear in their lengths."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: Sequence[str] | None, q: Sequence[str] | None) -> float:
            if p is None or not len(p):
                return 1.0
            known = set(q if q is not None else ())
            return sum(v in known for v in p) / len(p)

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return share(wanted, found)
