"""Sentence, paragraph and word segmentation as Column functions; each variant is a rule of its own."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\r\f]"
#: Abbreviations of T3, T4 and T6.
UNIFIED_SHORT = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "etc", "vs", "i.e", "e.g", "Inc", "Ltd", "Co", "Corp", "Rev", "Gen", "Sen", "Rep", "Pres", "Hon", "al")
PAPERS_SHORT = ("mr", "mrs", "ms", "dr", "prof", "fig", "eq", "al", "etc", "e.g", "i.e", "vs", "no", "st", "jr", "sr")
MODEL_SHORT = ("Mr", "Mrs", "Dr", "Prof", "Inc", "Ltd", "etc", "e.g", "i.e", "vs", "al")


#: Where a word of ASCII letters, digits and underscores starts and ends; the usual boundary takes other letters for parts of words, too.
STARTS, ENDS = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def strip(c: Column) -> Column:
    """Without blanks and line breaks at either end."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+\z", "")


def stripped_parts(parts: Column) -> Column:
    """Parts without outer blanks, empty ones left out."""
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def sentences_before_capital(text: Column) -> Column:
    """Ends at . ! ? if blanks and a capital letter A-Z follow."""
    return stripped_parts(F.split(text, rf"(?<=[.!?]){BLANK}+(?=[A-Z])"))


def sentences_at_blank(text: Column) -> Column:
    """Ends at . ! ? if blanks follow."""
    return F.filter(F.split(text, rf"(?<=[.!?]){BLANK}+"), lambda x: x != "")


def sentences_linear(text: Column) -> Column:
    """T5: ends at . ! ? before the end, a blank, a quote or a closing bracket; no abbreviations."""
    return stripped_parts(F.split(text, r"(?<=[.!?])(?=\z|[ \t\n\r\f\"')\]])"))


def sentences_matched(text: Column) -> Column:
    """Runs up to and with . ! ? and the blanks behind; an unterminated tail is lost, text without any is one sentence."""
    found = F.regexp_extract_all(text, F.lit(rf"\G[^.!?]*+[.!?]++{BLANK}*+"), F.lit(0))  # contiguous: no second look at an unterminated tail
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def sentences_naive(text: Column) -> Column:
    """Ends at every . ! ?"""
    return F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]|[^.!?]+\z"), F.lit(0))


def sentence_count(text: Column) -> Column:
    """Parts between runs of . ! ? that aren't blank; one at least."""
    return F.greatest(F.size(stripped_parts(F.split(text, r"[.!?]+"))), F.lit(1))


def either(words: Sequence[str]) -> str:
    """A pattern for one of the words as they are."""
    return "|".join(w.replace(".", r"\.") for w in words)


def sentences_quoted(text: Column, short: Sequence[str], guard: bool) -> Column:
    """Ends at every . ! ? but the stop of an abbreviation, which may end a longer word; a quote behind the mark belongs to the sentence.

    ``guard``: no end at a stop between two ASCII letters or digits, as identifiers have it.
    """
    known = either(short)
    inside = r"(?<![A-Za-z0-9]\.(?=[A-Za-z0-9]))" if guard else ""
    return stripped_parts(F.split(text, rf"""(?<=[.!?])(?<!(?:{known})\.){inside}(?!["'])|(?<=[.!?]["'])(?<!(?:{known})\.["'])"""))


def sentences_unified(text: Column) -> Column:
    """Abbreviations, identifiers stay whole, a closing quote is absorbed."""
    return sentences_quoted(text, UNIFIED_SHORT, True)


def sentences_papers(text: Column) -> Column:
    """T4: the mark must be followed by the end, a blank, a quote or a closing bracket, and the word before be no abbreviation."""
    return stripped_parts(F.split(text, rf"""(?i)(?<=[.!?])(?<!(?:\A|[ \t\n\r\f()\[\]"])(?:{either(PAPERS_SHORT)})[.!?]{{1,9}})(?=\z|[ \t\n\r\f"')\]])"""))


def sentences_model(text: Column) -> Column:
    """Abbreviations, a closing quote is absorbed."""
    return sentences_quoted(text, MODEL_SHORT, False)


def paragraphs(text: Column, rule: str = "lines") -> Column:
    """Parts between blank lines; ``lines``: two line breaks or more, ``blank``: blanks may stand between them, ``pair``: at each two."""
    pattern = {"lines": r"\n{2,}", "blank": rf"\n{BLANK}*\n", "pair": r"\n\n"}[rule]
    return stripped_parts(F.split(text, pattern))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def letter_tokens(text: Column) -> Column:
    """Lower-case runs of letters, with one apostrophe or hyphen inside at most."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+(?:['’-]\p{L}+)?"), F.lit(0))


def blank_words(text: Column, keep_edges: bool = False) -> Column:
    """Parts between blanks; with ``keep_edges`` the empty parts at either end count, as some callers have it."""
    parts = F.split(text, rf"{BLANK}+")
    return parts if keep_edges else F.filter(parts, lambda x: x != "")


def clean_words(text: Column) -> Column:
    """Lower case, all but ASCII word characters, blanks, apostrophes and hyphens removed, parts between blanks."""
    return blank_words(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_ \t\n\r\f'-]", ""))


def content_tokens(text: Column, stopwords: Column) -> Column:
    """Letters and digits, longer than two, not among the stop words; apostrophes removed before."""
    found = F.regexp_extract_all(F.regexp_replace(F.lower(text), r"['’]", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda x: (F.char_length(x) > 2) & ~F.array_contains(stopwords, x))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a space; none if there are fewer."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def pack(lengths: list[int], most: int) -> list[int]:
    """Greedy packing in order: the pack of each item; a pack holds at most ``most``, or a single larger item."""
    out, used, k = [], 0, 0
    for n in lengths:
        if used and used + n > most:
            k, used = k + 1, 0
        out.append(k)
        used += n
    return out


def packs(lengths: Column, most: int) -> Column:
    """The pack of each item of an array of lengths."""

    @F.pandas_udf("array<int>")
    def assign(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else pack([int(n) for n in x], most))

    return assign(lengths)


def budget_chunks(text: str, most: int) -> list[str]:
    """Chunks of ``most`` words; a chunk whose last . ! ? is past half of its characters ends there instead."""
    words, out, at = re.split(r"\s+", text), [], 0
    if len(words) <= most:
        return [text]
    while len(words) - at >= most:
        part = words[at : at + most]
        last = next((k for k in range(most - 1, -1, -1) if part[k].rstrip(".!?") != part[k] or any(m in part[k] for m in ".!?")), None)
        end = -1 if last is None else sum(map(len, part[:last])) + last + max(part[last].rfind(m) for m in ".!?")
        whole = " ".join(part)
        if end > len(whole) * 0.5:
            out.append(whole[: end + 1])
            rest = whole[end + 1 : end + 1 + len(part[last])].split(" ")[0]  # what stands behind the mark in its word
            at += last if rest else last + 1
            if rest:
                words[at] = rest
        else:
            out.append(whole)
            at += most
    return out + [" ".join(words[at:])] if at < len(words) else out


def paragraph_chunks(text: str, most: int = 500) -> list[str]:
    """Paragraphs packed in order up to ``most`` words; a larger one counts by lines, and a larger line is cut into runs of words."""
    paragraphs = [p for p in (x.strip() for x in text.split("\n\n")) if p]
    parts = [x for p in paragraphs for x in ([p] if len(p.split()) <= most else [y for y in (line.strip() for line in p.split("\n")) if y])]
    out, held, used = [], [], 0

    def close() -> None:
        nonlocal held, used
        if held:
            out.append("\n".join(held))
        held, used = [], 0

    for part in parts:
        words = part.split()
        if len(words) > most:
            close()
            out += [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
            continue
        if used + len(words) > most:
            close()
        held.append(part)
        used += len(words)
    close()
    return out or [text]


SENTENCE_GAP = re.compile(r"(?<=[.!?。！？])\s+")


def sentence_chunks(text: str, most: int = 4500) -> list[str]:
    """Sentences packed in order, with a blank between them, up to ``most`` characters; a longer one stands alone."""
    out, held = [], ""
    for part in SENTENCE_GAP.split(text):
        if len(held) + len(part) + 1 > most:
            out += [held] if held else []
            held = part
        else:
            held = f"{held} {part}".strip()
    return (out + [held] if held else out) or [text]


def chunked(text: Column, cut: Callable[[str, int], list[str]], most: int) -> Column:
    """The chunks of each text by one of the functions above."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut(t, most))

    return split(text)


