"""Markup structure, citations, facts and checks of sections."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.segment import strip

CITE = r"\\cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}"
REF = r"\\(?:ref|eqref|autoref|cref|Cref|pageref)\{([^}]*)\}"
LABEL = r"\\label\{([^}]*)\}"
BIB_ENTRY = r"\\bibitem(?:\[[^\]]*\])?\{([^}]*)\}"
HEADING = r"\\((?:sub){0,2})section\*?\{([^}]*)\}"
#: A section's kind by the first of these that its title contains.
SECTION_KINDS = (
    ("abstract", "abstract"), ("introduction", "introduction"), ("related work", "related_work"), ("literature review", "literature_review"), ("literature", "literature_review"), ("background", "related_work"),
    ("prior work", "related_work"), ("methodology", "methodology"), ("method", "methodology"), ("methods", "methodology"), ("proposed method", "methodology"), ("approach", "methodology"), ("system design", "methodology"),
    ("experimental setup", "experiments"), ("experiments", "experiments"), ("experiment", "experiments"), ("evaluation", "experiments"), ("results", "results"), ("result", "results"), ("findings", "results"),
    ("discussion", "discussion"), ("analysis", "discussion"), ("conclusion", "conclusion"), ("conclusions", "conclusion"), ("concluding remarks", "conclusion"), ("summary", "conclusion"), ("future work", "conclusion"),
    ("acknowledgment", "acknowledgments"), ("acknowledgments", "acknowledgments"), ("acknowledgements", "acknowledgments"), ("appendix", "appendix"),
)
NUMBERING = r"(?i)^[0-9ivx]+\.\s*"
#: The order of sections, those that structure checks and final checks want, the role and rank of a section's text.
EXPECTED_ORDER = ("abstract", "introduction", "related_work", "literature_review", "methodology", "experiments", "results", "discussion", "conclusion", "acknowledgments", "appendix")
NEEDED_SECTIONS = ("abstract", "introduction", "conclusion")
REQUIRED_SECTIONS = ("abstract", "introduction", "methodology", "results", "discussion", "conclusion")
ROLES = {"abstract": "summary", "introduction": "claim", "related_work": "evidence", "literature_review": "evidence", "methodology": "evidence", "experiments": "evidence", "results": "analysis", "discussion": "analysis", "conclusion": "summary"}
RANKS = {"abstract": 5, "introduction": 5, "methodology": 4, "results": 5, "discussion": 5, "conclusion": 4, "related_work": 3, "literature_review": 3}
#: What is kept as it is, in the order in which a region's kind is chosen.
PROTECTED = (
    ("equation", r"\\begin\{(equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?|displaymath|flalign\*?|split)\}.*?\\end\{\1\}"), ("equation", r"\\\[.*?\\\]"), ("equation", r"\$\$.*?\$\$"),
    ("inline_math", r"(?<!\$)\$(?!\$)(?:[^$\\]|\\.)+?\$(?!\$)"), ("table", r"\\begin\{(table\*?|tabular\*?|longtable|tabularx)\}.*?\\end\{\1\}"), ("figure", r"\\begin\{(figure\*?)\}.*?\\end\{\1\}"),
    ("environment", r"\\begin\{(algorithm\*?|algorithmic|lstlisting|verbatim|minted|tikzpicture|pgfpicture)\}.*?\\end\{\1\}"), ("comment", r"(?m)^[ \t]*%.*?$"),
)
#: P11's regions of markup, and P12's of Markdown, in their order.
MARKUP_REGIONS = (
    r"\\begin\{(?:equation|align|gather|multline|eqnarray)\*?\}.*?\\end\{(?:equation|align|gather|multline|eqnarray)\*?\}", r"\\\[.*?\\\]", r"\$\$.*?\$\$", r"\$[^\$\n]+?\$", r"\\cite[tp]?\{[^}]+\}",
    r"\\(?:ref|label|eqref|autoref)\{[^}]+\}", r"\\begin\{(?:figure|table|algorithm|lstlisting|verbatim)\*?\}.*?\\end\{(?:figure|table|algorithm|lstlisting|verbatim)\*?\}", r"\\(?:textbf|textit|emph|texttt|textrm|text)\{[^}]+\}",
)
MARKDOWN_REGIONS = (
    r"(?m)^>[^\n]*$", r"```.*?```", r"`[^`\n]+`", r"!\[[^\]]*\]\([^)]+\)", r"\[[^\]]+\]\([^)]+\)", r"""https?://[^\s<>)\]"']+?(?=[.,!?;:]?(?:[\s<>)\]"']|\Z))""", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"(?<![a-zA-Z0-9_])@[a-zA-Z0-9_]+", r"(?<![a-zA-Z0-9_])#[a-zA-Z][a-zA-Z0-9_]*",
)
#: The forms of placeholders of P10, P11 and P12.
PLACEHOLDER, MARKUP_PLACEHOLDER, MARKDOWN_PLACEHOLDER = "⟦PROTECTED_{}⟧", "__P_{}__", "__PROTECT_{}__"
#: In the order of the results; the last two give a name by its group.
FACTS = tuple((kind, re.compile(p, flags)) for kind, p, flags in (
    ("percentage", r"\d+\.?\d*\s*\\?%", 0), ("p_value", r"p\s*[<>=≤≥]\s*(?:\d+\.?\d*|\.\d+)", re.I),
    ("confidence_interval", r"\d+\.?\d*\s*\\?%?\s*CI\s*[\[(]\s*\d+\.?\d*\s*[,;]\s*\d+\.?\d*\s*[\])]", re.I),
    ("effect_size", r"(?:Cohen['’]?s?\s+)?d\s*=\s*\d+\.?\d*", re.I), ("correlation", r"r\s*=\s*[−-]?\s*\d+\.?\d*", re.I), ("sample_size", r"[nN]\s*=\s*\d+", 0),
    ("metric", r"(?:F1(?:-score)?|accuracy|precision|recall|AUC|BLEU|ROUGE|mAP|IoU|RMSE|MAE|MSE|R²|perplexity)\s*(?:of|=|:)?\s*\d+\.?\d*%?", re.I),
    ("measurement", r"\d+\.?\d*\s*(?:ms|μs|ns|s|min|hours?|days?|MB|GB|TB|KB|GHz|MHz|kHz|Hz|mm|cm|m|km|μm|nm|mg|g|kg|μg|mL|L|μL|°C|°F|K)\b", 0),
    ("date", r"\d{4}-\d{2}-\d{2}", 0), ("number", r"\d+(?:[.,]\d+)*", 0),
    ("method", r"(?:use|using|employ|based on|propose|implement|apply|train|fine-tune)\s+([A-Z][A-Za-z0-9-]+(?:\s+[A-Z][A-Za-z0-9-]+)*)", re.I),
    ("dataset", r"(?:dataset|benchmark|corpus|trained on|evaluated on|tested on)\s+([A-Z][A-Za-z0-9-]+(?:\s+[A-Z][A-Za-z0-9-]+)*)", re.I),
))
#: Where none of these is in the lower-case text, the pattern can't match and isn't tried.
NEEDED = {
    "percentage": ("%",), "p_value": tuple("<>=≤≥"), "confidence_interval": ("ci",), "effect_size": ("=",), "correlation": ("=",), "sample_size": ("=",), "date": ("-",),
    "metric": ("f1", "accuracy", "precision", "recall", "auc", "bleu", "rouge", "map", "iou", "rmse", "mae", "mse", "r²", "perplexity"),
    "method": ("use", "using", "employ", "based on", "propose", "implement", "apply", "train", "fine-tune"), "dataset": ("dataset", "benchmark", "corpus", "trained on", "evaluated on", "tested on"),
}
DIGIT = re.compile(r"\d")
#: A name of a method or dataset has so many characters at least.
LEAST_NAME = 3


def keys(text: Column, pattern: str) -> Column:
    """The comma-separated keys of a command in order, each once."""
    lists = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != ""))


def body_spans(text: Column) -> dict[str, Column]:
    """Preamble, body and bibliography by start and end (0-based, end exclusive, in characters)."""
    n = F.char_length(text)
    begin, end = F.locate("\\begin{document}", text), F.locate("\\end{document}", text)
    start = F.when(begin > 0, begin - 1 + 16).otherwise(0)
    stop = F.when(end > 0, end - 1).otherwise(n)
    bib = F.locate("\\begin{thebibliography}", text)
    return {"preamble_end": start, "body_start": start, "body_end": stop, "bibliography_start": F.when(bib > 0, bib - 1)}


def plain(text: Column) -> Column:
    """Text of markup by rules: comments, environments' marks, formatting commands, citations, remaining commands."""
    steps = ((r"(?<!\\)%[^\n]*", ""), (r"\\(?:begin|end)\{[^}]*\}", " "), (r"\\(?:textbf|textit|emph|underline|text)\{([^}]*)\}", "$1"), (CITE, "[CITATION]"), (REF, "[REF]"), (LABEL, ""), (r"\$[^$]*\$", "[MATH]"), (r"\\([%&_#$])", "$1"), (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])*(?:\{([^}]*)\})?", "$1"), (r"[{}~]", " "), (r"[ \t\n\r\f]+", " "))
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def comparable(text: Column) -> Column:
    """Text of markup for comparison: formulas, tables, figures, citations and references are their names in brackets, other commands go."""
    closed = lambda names: rf"(?s)\\begin\{{({names})\}}.*?\\end\{{({names})\}}"
    steps = (
        (closed(r"equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?|displaymath"), "[EQUATION]"), (r"(?s)\\\[.*?\\\]", "[EQUATION]"), (r"(?s)\$\$.*?\$\$", "[EQUATION]"), (r"\$[^$\n]+\$", "[MATH]"),
        (closed(r"table\*?|tabular\*?|longtable"), "[TABLE]"), (closed(r"figure\*?"), "[FIGURE]"), (r"\\(?:cite|citep|citet|citeauthor|citeyear|autocite|parencite|textcite)\*?\{[^}]+\}", "[CITATION]"),
        (r"\\(?:ref|eqref|pageref|autoref|cref|Cref|nameref)\{[^}]+\}", "[REF]"), (r"\\label\{[^}]+\}", ""), (r"\\(?:textbf|textit|emph|underline|textsc|textrm|textsf|texttt|textup)\{([^}]*)\}", "$1"),
        (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})*", ""), (r"[{}]", ""), (r"\n{3,}", "\n\n"), (r"[ \t]+", " "),
    )
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def section_kind(title: Column) -> Column:
    """P6"""
    low = F.regexp_replace(F.lower(F.trim(title)), NUMBERING, "")
    out = F.when(F.lit(False), "")
    for part, kind in SECTION_KINDS:
        out = out.when(F.contains(low, F.lit(part)), kind)
    return out.otherwise("unknown")


def scan_sections(text: str) -> list[tuple[int, str, int, int, int, int, int]]:
    """P5: position, title, level, start, end, and where the content starts and ends: the abstract's environment, then headed parts of the body.

    A part ends where the next begins, the last at the bibliography or the body's end. Without any, the body is one part.
    """
    begin, end = text.find("\\begin{document}"), text.find("\\end{document}")
    begin, end = (begin + 16 if begin >= 0 else 0), (end if end >= 0 else len(text))
    found = []
    if m := re.search(r"\\begin\{abstract\}(.*?)\\end\{abstract\}", text[begin:end], re.DOTALL):
        found.append(("Abstract", 1, begin + m.start(), begin + m.end(), begin + m.start(1), begin + m.end(1)))
    heads = [(begin + m.start(), begin + m.end(), m[2].strip(), 1 + m[1].count("sub")) for m in re.finditer(HEADING, text[begin:end])]
    bib = text.find("\\begin{thebibliography}")
    stops = [*(h[0] for h in heads[1:]), bib if bib >= 0 else end]
    found += [(title, level, a, stop, b, stop) for (a, b, title, level), stop in zip(heads, stops, strict=False)]
    return [(i, *x) for i, x in enumerate(found or [("", 1, begin, end, begin, end)])]


def sections(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """A row per section."""

    @F.pandas_udf("array<struct<position: int, title: string, level: int, start: int, end: int, content_start: int, content_end: int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [] if t is None else scan_sections(t))

    return docs.select(id_col, F.inline(scan(text_col))).withColumn("kind", section_kind(F.col("title")))


def scan_blocks(text: str, at: int = 0, stop: int | None = None) -> list[tuple[int, str, int, int]]:
    """Protected regions, the longest first where several start, without overlaps; the gaps are text. They tile the source, or its part from ``at`` to ``stop``."""
    part = text[at:stop]
    regions = sorted(((m.start(), m.end(), kind) for kind, p in PROTECTED for m in re.finditer(p, part, re.DOTALL)), key=lambda r: (r[0], -r[1]))
    out, done = [], 0
    for start, end, kind in regions:
        if start < done or end == start:
            continue
        if start > done:
            out.append(("text", at + done, at + start))
        out.append((kind, at + start, at + end))
        done = end
    if done < len(part):
        out.append(("text", at + done, at + len(part)))
    return [(i, *x) for i, x in enumerate(out)]


def complexity(source: Column) -> Column:
    """By the number of words."""
    n = F.size(F.filter(F.split(source, r"\s+"), lambda x: x != ""))
    return F.when(n > 80, "high").when(n > 30, "medium").otherwise("low")


def blocks(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """A row per block with its source."""

    @F.pandas_udf("array<struct<position: int, kind: string, start: int, end: int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [] if t is None else scan_blocks(t))

    rows = docs.select(id_col, text_col, F.inline(scan(text_col)))
    source = F.substr(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.withColumn("source", source).withColumn("complexity", complexity(F.col("source"))).drop(text_col)


def tagged_blocks(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """A row per block of each section's content, with the section's kind, and for text its role, rank and complexity."""

    @F.pandas_udf("array<struct<section: int, title: string, position: int, block: string, start: int, end: int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [] if t is None else [(i, title, *b) for i, title, _, _, _, a, z in scan_sections(t) for b in scan_blocks(t, a, z)])

    rows = docs.select(id_col, text_col, F.inline(scan(text_col))).withColumn("kind", section_kind(F.col("title")))
    source = F.substr(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start"))
    text = F.col("block") == "text"
    named = lambda table, usual: F.when(text, F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("kind")), F.lit(usual)))
    return rows.select(id_col, "section", "kind", "position", "block", "start", "end", named(ROLES, "analysis").alias("role"), named(RANKS, 3).alias("rank"), F.when(text, complexity(source)).alias("complexity"))


def rebuilt(block_rows: DataFrame, id_col: str, rewritten: str | None = None) -> DataFrame:
    """The source again from its blocks in order, text blocks by their rewritten form where they have one."""
    part = F.col("source") if rewritten is None else F.when(F.col("kind") == "text", F.coalesce(rewritten, "source")).otherwise(F.col("source"))
    ordered = F.array_sort(F.collect_list(F.struct("position", part.alias("part"))))  # the blocks of one document
    return block_rows.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("text"))


def lead(form: str) -> str:
    """What a placeholder has before its number."""
    return form.partition("{}")[0]


def marks(form: str) -> re.Pattern:
    """Placeholders of the form, with their number as group."""
    return re.compile(re.escape(form).replace(r"\{\}", "([0-9]+)"))


def masked(text: str, patterns: Sequence[str], form: str = PLACEHOLDER) -> tuple[str, list[str]]:
    """Protected spans by numbered placeholders, patterns in order; and what they stand for.

    Where the text itself has what could be taken for one of these, starts of placeholders are spans, too.
    """

    def hidden(patterns: Sequence[str]) -> tuple[str, list[str]]:
        out, kept = text, []

        def hide(m: re.Match) -> str:
            kept.append(m[0])
            return form.format(len(kept) - 1)

        for p in patterns:
            out = re.sub(p, hide, out, flags=re.DOTALL)
        return out, kept

    out, kept = hidden(patterns)
    if lead(form) in text and lead(form) in marks(form).sub(lambda m: "\n" if len(m[1]) < 19 and int(m[1]) >= len(kept) else m[0], text):
        out, kept = hidden([re.escape(lead(form)), *patterns])
    return out, kept


def unmasked(text: str, kept: Sequence[str], form: str = PLACEHOLDER) -> str:
    """Puts spans back, also those inside of others; linear in the text. A placeholder without a span stays."""
    mark = marks(form)

    def back(m: re.Match) -> str:
        return mark.sub(back, kept[int(m[1])]) if int(m[1]) < len(kept) else m[0]

    return mark.sub(back, text)


def protect(docs: DataFrame, patterns: Sequence[str], text_col: str, id_col: str, form: str = PLACEHOLDER) -> DataFrame:
    """Masked text and kept spans."""

    @F.pandas_udf("struct<masked: string, kept: array<string>>")
    def hide(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([masked(t or "", patterns, form) for t in texts], columns=["masked", "kept"])

    return docs.select(id_col, hide(text_col).alias("_m")).select(id_col, "_m.masked", "_m.kept")


def restore(rows: DataFrame, id_col: str, form: str = PLACEHOLDER) -> DataFrame:
    """Undoes :func:`protect`."""

    @F.pandas_udf("string")
    def show(texts: pd.Series, kept: pd.Series) -> pd.Series:
        return pd.Series([unmasked(t, list(k), form) for t, k in zip(texts, kept, strict=True)], dtype=object)

    return rows.select(id_col, show("masked", "kept").alias("text"))


def scan_facts(text: str) -> list[tuple[str, str, int, int, str]]:
    """Typed values with their place and sentence, each pattern over the whole text; repeats of a value of a kind go."""
    out, seen = [], set()
    low = text.lower().replace("ſ", "s").replace("ı", "i").replace("\u0307", "")  # what a pattern without case takes for these letters
    digits = DIGIT.search(text)
    for kind, p in FACTS:
        if not (digits or p.groups) or kind in NEEDED and not any(x in low for x in NEEDED[kind]):
            continue
        for m in p.finditer(text):
            value, (start, end) = m[p.groups], m.span(p.groups)
            if (value, kind) not in seen and (not p.groups or len(value) >= LEAST_NAME):
                seen.add((value, kind))
                a, b = text.rfind(".", 0, m.start()) + 1, text.find(".", m.end())
                out.append((kind, value, start, end, text[a : b + 1 if b >= 0 else len(text)].strip()))
    return out


def facts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """A row per fact of each document."""

    @F.pandas_udf("array<struct<kind: string, value: string, start: int, end: int, context: string>>")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else scan_facts(t))

    return docs.select(id_col, F.inline(scan(text_col)))


#: Patterns of numeric claims.
NUMERIC_CLAIMS = {
    "percentages": r"\d+\.?\d*\s*%", "p_values": r"(?i)p\s*[<>=≤≥]\s*\d+\.?\d*", "confidence_intervals": r"(?i)\d+\.?\d*\s*%?\s*(?:CI|confidence interval)", "decimals": r"(?<![\p{L}\p{N}_])\d+\.\d+(?![\p{L}\p{N}_])",
    "effect_sizes": r"(?i)(?:Cohen['’]?s?\s+)?d\s*=\s*\d+\.?\d*", "correlations": r"(?i)r\s*=\s*[−-]?\d+\.?\d*", "sample_sizes": r"[Nn]\s*=\s*\d+",
}


def numeric_claims(text: Column) -> dict[str, Column]:
    """The lists of claims by kind, and their number in total."""
    lists = {k: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in NUMERIC_CLAIMS.items()}
    return lists | {"total": sum((F.size(x) for x in lists.values()), F.lit(0))}


def integrity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """For citations, references, labels and formulas the keys lost and added; valid if none."""
    out = pairs
    for name, pattern in (("cites", CITE), ("refs", REF), ("labels", LABEL), ("math", r"(\$[^$]+\$)")):
        x, y = keys(F.col(a), pattern), keys(F.col(b), pattern)
        out = out.withColumn(f"{name}_lost", F.array_except(x, y)).withColumn(f"{name}_added", F.array_except(y, x))
    sides = [f"{n}_{s}" for n in ("cites", "refs", "labels", "math") for s in ("lost", "added")]
    return out.withColumn("valid", F.forall(F.array(*[F.size(c) == 0 for c in sides]), lambda x: x))


def order_issues(found: Column, expected: Sequence[str]) -> dict[str, Column]:
    """Sections missing, and whether those present come in the expected order."""
    wanted = F.array(*map(F.lit, expected))
    places = F.filter(F.transform(found, lambda x: F.array_position(wanted, x)), lambda i: i > 0)
    return {"missing": F.array_except(wanted, found), "in_order": places == F.array_sort(places)}


def checked(rows: DataFrame, schema: dict[str, dict]) -> DataFrame:
    """Errors of each row against a subset of JSON Schema: required, enum, minimum, maximum, minLength."""
    errors = []
    for name, rule in schema.items():
        c = F.col(name)
        tests = {
            "required": c.isNull() if rule.get("required") else None, "enum": ~c.isin(*rule["enum"]) if "enum" in rule else None, "minimum": c < rule["minimum"] if "minimum" in rule else None,
            "maximum": c > rule["maximum"] if "maximum" in rule else None, "minLength": F.char_length(c) < rule["minLength"] if "minLength" in rule else None,
        }
        errors += [F.when(t, F.lit(f"{name}:{k}")) for k, t in tests.items() if t is not None]
    return rows.withColumn("errors", F.array_compact(F.array(*errors)))
