"""Queries on style statistics, voices, versions, records and manuscripts' structure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import arrays as A
from scriptorium.functions import segment as S
from scriptorium.operators import corpus, edit, extract, reports, style
from scriptorium.plans import corpora as C
from scriptorium.plans import documents as D
from scriptorium.plans.documents import SENT6, B, _quoted_sql, q, spread, stripped, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


RULES = style.StyleRules(transitions=("and", "und", "que"), phrases=("of the", "de la"), hedges=("to", "der"))


def clean(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^A-Za-z0-9_ \t\n\r\f''-]', '', 'g'), '{B}+'), lambda w: w <> '')"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


SHORTENED = r"(?i)\w+''(?:t|s|re|ve|ll|d|m)\b"
PASSIVES = r"list_sum(list_transform({}, lambda x: len(regexp_extract_all(x, '(?i)\b(?:is|are|was|were|been|being)\s+\w+ed\b')) + len(regexp_extract_all(x, '(?i)\b(?:is|are|was|were|been|being)\s+\w+en\b'))))"
STARTER = rf"regexp_replace(lower(regexp_split_to_array({{}}, '{B}+')[1]), '[^a-z''-]', '', 'g')"


def _per(k: str) -> str:
    return f"({k})::DOUBLE / greatest(n, 1) * 1000"


def _map_sql(phrases, digits: int, edge: str) -> str:
    rows = ", ".join(f"CASE WHEN {count('low', edge + p + edge)} > 0 THEN '{p}=' || printf('%.{digits}f', round({_per(count('low', edge + p + edge))}, {digits})) END" for p in phrases)
    return f"array_to_string(list_filter([{rows}], lambda x: x IS NOT NULL), ',')"


_STYLE = rf"""WITH p AS (SELECT doc_id, lang, text, lower(text) AS low, {SENT6} AS s, {clean('text')} AS w, {stripped("regexp_split_to_array(text, '\n[ \t\n\r\f]*\n')")} AS ps FROM documents),
l AS (SELECT *, len(w) AS n, len(s) AS k, list_transform(s, lambda x: len({clean('x')})) AS ls, list_filter(w, lambda x: length(x) > 2) AS long, list_transform(ps, lambda x: len({clean('x')})) AS pl FROM p)
SELECT doc_id, lang, CAST(n AS BIGINT) AS word_count, CAST(k AS BIGINT) AS sentence_count, CAST(len(ps) AS BIGINT) AS paragraph_count, round(coalesce(list_avg(ls), 0.0), 1) AS length_mean,
{', '.join(f"round(coalesce(list_aggregate(ls, 'quantile_cont', {x}), 0.0), 1) AS length_{c}" for c, x in (('median', 0.5), ('p10', 0.1), ('p25', 0.25), ('p75', 0.75), ('p90', 0.9)))},
round(CASE WHEN k > 1 THEN list_stddev_pop(ls) ELSE 0.0 END, 1) AS length_sd, CAST(coalesce(list_min(ls), 0) AS DOUBLE) AS length_min, CAST(coalesce(list_max(ls), 0) AS DOUBLE) AS length_max,
round(CASE WHEN k >= 3 AND list_avg(ls) > 0 THEN list_stddev_pop(ls) / list_avg(ls) ELSE 0.0 END, 3) AS burstiness, round(CASE WHEN len(long) >= 10 THEN len(list_distinct(long))::DOUBLE / len(long) ELSE 0.0 END, 3) AS vocabulary_diversity,
round({ratio("len(list_filter(list_distinct(list_transform(s, lambda x: " + STARTER.format('x') + ")), lambda x: x <> ''))", 'k')}, 3) AS starter_diversity, round({_per(count('text', SHORTENED))}, 2) AS contractions,
round(100 * {ratio('coalesce(' + PASSIVES.format('s') + ', 0)', 'k')}, 1) AS passive_percent, round(coalesce(list_avg(pl), 0.0), 1) AS paragraph_words, round(CASE WHEN len(pl) > 1 THEN list_stddev_pop(pl) ELSE 0.0 END, 1) AS paragraph_sd,
round({_per(count('text', '—|–'))}, 2) AS em_dashes, round({_per(count('text', ';'))}, 2) AS semicolons, round({_per(count('text', '!'))}, 2) AS exclamations, round({_per(count('text', r'(?i)\b(?:I|me|my|we|us|our|mine|ours)\b'))}, 2) AS first_person,
round({_per(' + '.join(count('low', rf'\b{h}\b') for h in RULES.hedges))}, 2) AS hedging, {_map_sql(RULES.transitions, 2, chr(92) + 'b')} AS transitions, {_map_sql(RULES.phrases, 3, '')} AS phrases FROM l"""


def stats(spark, sf_dir) -> DataFrame:
    return style.style_stats(table(spark, sf_dir, "documents"), RULES, keep=("lang",))


def _shown(column: str, keys, digits: int):
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(column)[k].isNotNull(), F.concat(F.lit(f"{k}="), F.format_string(f"%.{digits}f", F.col(column)[k]))) for k in keys])), ",").alias(column)


@query(_STYLE)
def d20_style_stats(spark, sf_dir):
    rows = stats(spark, sf_dir)
    return rows.select("doc_id", "lang", *style.STYLE_COUNTS, *(F.col(c).cast("double").alias(c) for c in style.STYLE), _shown("transitions", RULES.transitions, 2), _shown("phrases", RULES.phrases, 3))


def _model_sql(by: str = "") -> str:
    g = f"{by}, " if by else ""
    spread_of = ("length_mean", "burstiness", "contractions", "passive_percent", "em_dashes", "semicolons", "exclamations")
    means = style.MODEL_MEANS | dict.fromkeys(("em_dashes", "semicolons", "exclamations"), 2)
    return f"""SELECT {g}count(*) AS documents, {', '.join(f'round(avg({c}), {d}) AS {c}_mean' for c, d in means.items())}, {', '.join(f'round(stddev_pop({c}), 3) AS {c}_sd' for c in spread_of)},
min(vocabulary_diversity) AS vocabulary_least, max(vocabulary_diversity) AS vocabulary_most FROM ({_STYLE}) {'GROUP BY ' + by if by else ''}"""


@query(_model_sql())
def a8_style_model(spark, sf_dir):
    return style.style_model(stats(spark, sf_dir))


@query(_model_sql("lang"))
def a8_style_model_by_language(spark, sf_dir):
    return style.style_model(stats(spark, sf_dir), ["lang"])


_ALL_SENTENCES = f"SELECT doc_id, {spread('s')} FROM (SELECT doc_id, {SENT6} AS s FROM documents)"


@query(f"SELECT round(avg(n), 1) AS mean, CAST(min(n) AS INTEGER) AS least, CAST(max(n) AS INTEGER) AS most, {', '.join(f'round(quantile_cont(n, {x}), 1) AS {c}' for c, x in (('p10', 0.1), ('p25', 0.25), ('median', 0.5), ('p75', 0.75), ('p90', 0.9)))} FROM (SELECT len({clean('part')}) AS n FROM ({_ALL_SENTENCES}))")
def a8_sentence_lengths(spark, sf_dir):
    return style.sentence_lengths(table(spark, sf_dir, "documents"))


@query(
    f"WITH f AS (SELECT {STARTER.format('part')} AS word FROM ({_ALL_SENTENCES})), c AS (SELECT word, count(*) AS n FROM f GROUP BY word), t AS (SELECT CAST(sum(n) AS BIGINT) AS a FROM c) "
    "SELECT word, n, round(n::DOUBLE / a * 100, 2) AS percent FROM c, t WHERE word <> '' ORDER BY n DESC, word LIMIT 100"
)
def a8_starters(spark, sf_dir):
    return style.top_starters(table(spark, sf_dir, "documents"))


@query(
    f"WITH s AS (SELECT doc_id, pos, part, row_number() OVER (ORDER BY doc_id, pos) - 1 AS r, count(*) OVER () AS a FROM ({_ALL_SENTENCES}) WHERE len(regexp_split_to_array(part, '{B}+')) BETWEEN 5 AND 40) "
    "SELECT doc_id, CAST(pos AS INTEGER) AS pos, part AS sentence FROM s WHERE CASE WHEN a // 50 > 0 THEN r % (a // 50) = 0 AND r < (a // 50) * 50 ELSE r = 0 END"
)
def a8_examples(spark, sf_dir):
    return style.example_sentences(table(spark, sf_dir, "documents"))


_TRANSITION_MEANS = f"SELECT key, round(sum(value) / (SELECT count(*) FROM documents), 2) AS mean FROM (" + " UNION ALL ".join(
    f"SELECT '{p}' AS key, round(1000.0 * {count('lower(text)', chr(92) + 'b' + p + chr(92) + 'b')}::DOUBLE / greatest(len({clean('text')}), 1), 2) AS value FROM documents WHERE {count('lower(text)', chr(92) + 'b' + p + chr(92) + 'b')} > 0" for p in RULES.transitions
) + ") GROUP BY key"


@query(_TRANSITION_MEANS)
def a8_transition_means(spark, sf_dir):
    return style.map_means(stats(spark, sf_dir), "transitions", 2)


@query(f"WITH m AS ({_model_sql()}), t AS (SELECT coalesce(sum(mean), 0.0) AS t FROM ({_TRANSITION_MEANS})) SELECT CAST(floor(round(burstiness_mean * 50, 9) + 0.5) AS BIGINT) AS burstiness_floor, CAST(floor(round(vocabulary_diversity_mean * 85, 9) + 0.5) AS BIGINT) AS vocabulary_floor, CAST(floor(round(t * 200, 9) + 0.5) AS BIGINT) AS transition_ceiling FROM m, t")
def m10_thresholds(spark, sf_dir):
    rows = stats(spark, sf_dir)
    return style.calibrated(style.style_model(rows), style.map_means(rows, "transitions", 2))


@query("SELECT doc_id, array_to_string(list_transform(range(0, doc_id % 9), lambda i: greatest(2, CAST(floor(18 + (n_chars % 13) * [1.5, -0.5, -1.0, 0.0, 0.5][i % 5 + 1] + 0.5) AS INTEGER))), ',') AS targets FROM documents")
def m11_length_targets(spark, sf_dir):
    made = style.length_targets((F.col("doc_id") % 9).cast("int"), F.col("n_chars") % 13)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(made.cast("array<string>"), ",").alias("targets"))


VOICE_HEDGES = ("of the", "de la")
_CUT = lambda x: _quoted_sql(x, S.MODEL_SHORT, True)
_VOICE = rf"""WITH d AS (SELECT doc_id // 7 AS profile, doc_id, text, {_CUT('text')} AS s FROM documents), g AS (SELECT profile, count(*) AS samples, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t, flatten(list(s ORDER BY doc_id)) AS s FROM d GROUP BY profile HAVING count(*) BETWEEN 3 AND 10),
l AS (SELECT *, lower(t) AS low, list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '') AS w, list_transform(s, lambda x: len(regexp_split_to_array(x, '{B}+'))) AS ls, list_filter(list_transform(s, lambda x: regexp_replace(lower(regexp_split_to_array(x, '{B}+')[1]), '[^a-z]', '', 'g')), lambda x: x <> '') AS st,
      list_transform(list_filter(regexp_split_to_array(t, '\n\n+'), lambda p: p <> ''), lambda p: len({_CUT('p')})) AS pl FROM g),
c AS (SELECT *, len(w) AS n, len(s) AS k, list_filter(list_transform(w, lambda x: regexp_replace(lower(x), '[^A-Za-z0-9_'']', '', 'g')), lambda x: length(x) > 2) AS cw FROM l)
SELECT profile, samples, CAST(k AS BIGINT) AS n_sentences, CAST(n AS BIGINT) AS n_words, round(coalesce(list_avg(ls), 0.0), 6) AS sentence_length, round(CASE WHEN k > 1 THEN list_stddev_pop(ls) ELSE 0.0 END, 6) AS sentence_sd, round({ratio('len(list_distinct(cw))', 'len(cw)')}, 6) AS type_token_ratio,
round(coalesce(list_avg(list_transform(cw, lambda x: length(x))), 0.0), 6) AS word_length, round(100 * {ratio(count('t', SHORTENED), 'n')}, 6) AS contractions, {', '.join(f"round(1000 * {ratio(count('t', p), 'n')}, 6) AS {c}" for c, p in (('em_dashes', '—'), ('semicolons', ';'), ('asides', r'\([^)]{5,}\)'), ('exclamations', '!')))},
round({ratio('coalesce(' + PASSIVES.format('s') + ', 0)', 'k')}, 6) AS passive_ratio, round(1000 * {ratio("len(list_filter(w, lambda x: regexp_matches(x, '^(?i)(I|me|my|we|us|our)$')))", 'n')}, 6) AS first_person, round(1000 * {ratio("len(list_filter(w, lambda x: regexp_matches(x, '^(?i)your?$')))", 'n')}, 6) AS second_person,
round(1000 * {ratio(f'len(list_filter({q(VOICE_HEDGES)}, lambda h: contains(low, h)))', 'k')}, 6) AS hedging, round({ratio(f'len(list_filter(st, lambda x: list_contains({q(style.CONJUNCTIONS)}, x)))', 'len(st)')}, 6) AS conjunction_starts,
round(coalesce(list_avg(pl), 0.0), 6) AS paragraph_sentences, round(CASE WHEN len(pl) > 1 THEN list_stddev_pop(pl) ELSE 0.0 END, 6) AS paragraph_sd, round(coalesce(list_avg(ls), 0.0) * 0.6, 6) AS clause_length FROM c"""


@query(_VOICE)
def d22_voice_profiles(spark, sf_dir):
    """Seven documents in a row are a profile's samples."""
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id DIV 7").alias("profile"), "doc_id", "text")
    return style.voice_profiles(docs, "profile", VOICE_HEDGES)


ATTRIBUTED = ("the", "und", "que")


@query(
    rf"""WITH p AS (SELECT doc_id, text, len(regexp_split_to_array(text, '{B}+')) AS n, {stripped("regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+" + chr(92) + "z')")} AS s FROM documents)
SELECT doc_id, round({ratio('n', 'len(s)')}, 9) AS sentence_length, round({count('text', r'(?i)\b(?:it could be|might be|possibly|perhaps|it seems|arguably)\b')}::DOUBLE / n * 1000, 9) AS hedging,
round({ratio(r"len(list_filter(s, lambda x: regexp_matches(x, '(?i)\b(?:is|are|was|were|been|being)\s+\w+ed\b')))", 'len(s)')}, 9) AS passive, round({count('text', SHORTENED)}::DOUBLE / n * 100, 9) AS contractions,
round({count('text', r'\([^)]{5,}\)')}::DOUBLE / n * 1000, 9) AS asides, round({count('text', r'(?i)\b(?:' + '|'.join(ATTRIBUTED) + r')\b')}::DOUBLE / n * 1000, 9) AS phrases FROM p"""
)
def d28_attribution_features(spark, sf_dir):
    return style.attribution_features(table(spark, sf_dir, "documents"), ATTRIBUTED)


_TRIPLET = style.TRIPLET
_LISTED = "text || ' We use a, b, and c or x, y and z.'"


@query(f"SELECT doc_id, CAST({count('(' + _LISTED + ')', _TRIPLET)} AS BIGINT) AS triplets FROM documents")
def d32_triplets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", style.triplets(F.concat("text", F.lit(" We use a, b, and c or x, y and z."))).cast("bigint").alias("triplets"))


_SPLIT1 = rf"string_split(regexp_replace(text, '([.!?]){B}+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
_FIRSTS = rf"list_transform(s, lambda x: lower(regexp_extract(x, '[^ \t\n\r\f]+', 0)))"
_PASSIVE_KINDS = r"(?i)\b(?:is|are|was|were|been|being)[ \t\n\r\f]+\w+ed\b|\b(?:is|are|was|were)[ \t\n\r\f]+\w+en\b"


@query(
    f"WITH l(what, category, severity) AS (VALUES " + ", ".join(str(x) for x in D.HITS) + f"), d AS (SELECT doc_id, text, {_SPLIT1} AS s FROM documents), f AS (SELECT *, {_FIRSTS} AS f FROM d), "
    "r AS (SELECT doc_id, unnest(list_filter(list_transform(range(1, len(f) - 1), lambda i: list_distinct(list_filter(f[i:i+2], lambda x: x <> ''))), lambda w: len(w) = 1)) AS w FROM f), "
    f"p AS (SELECT doc_id, len(s) AS k, len(list_filter(s, lambda x: regexp_matches(x, '{_PASSIVE_KINDS}') OR regexp_matches(x, '\\bIt[ \\t\\n\\r\\f]+(?:is|was)[ \\t\\n\\r\\f]+(?:shown|demonstrated|observed|noted|found)\\b'))) AS n FROM d) "
    "SELECT doc_id, 'phrase' AS type, severity, what, CAST((length(lower(text)) - length(replace(lower(text), what, ''))) // length(what) AS BIGINT) AS n FROM documents, l WHERE contains(lower(text), what) "
    "UNION ALL SELECT doc_id, 'repeated start', 'should_fix', w[1], 3 FROM r UNION ALL SELECT doc_id, 'passive', 'cosmetic', '', n FROM p WHERE n > 0.6 * k"
)
def d33_style_issues(spark, sf_dir):
    return style.style_issues(table(spark, sf_dir, "documents"), D.HITS)


# Corpus summaries

_LABELLED = ("lexical_density", "type_token_ratio", "lead_diversity", "transition_ratio", "trigram_repetition", "template_lead_ratio")


@query("WITH x AS (" + D.ORACLE_SQL["document_features"] + ") SELECT quality AS label, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _LABELLED) + " FROM x JOIN labels USING (doc_id) GROUP BY quality")
def a5_signals_by_label(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    known = D.features_of(table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi"))
    return labels.join(known, "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in _LABELLED))


@query(
    "WITH r AS (SELECT 'lang' AS kind, coalesce(lang, 'unknown') AS value FROM documents UNION ALL SELECT 'source', coalesce(source, 'unknown') FROM documents UNION ALL SELECT 'length', CAST(n_chars // 1000 AS VARCHAR) FROM documents), c AS (SELECT kind, value, count(*) AS n FROM r GROUP BY kind, value) "
    "SELECT kind, value, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS place FROM c) WHERE place <= 30"
)
def a2_histograms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kinds = {"lang": F.coalesce("lang", F.lit("unknown")), "source": F.coalesce("source", F.lit("unknown")), "length": F.floor(F.col("n_chars") / 1000).cast("string")}
    return corpus.top_values(docs, kinds, 30)


# Records, versions, structure

_RECORDS = """SELECT doc_id, substr(text, 1, CAST(doc_id % 30 AS INTEGER)) AS title, text AS abstract, doc_id % 5 <> 0 AS is_open_access, CASE WHEN doc_id % 7 <> 0 THEN '10.1/' || doc_id END AS doi, CASE WHEN doc_id % 11 <> 0 THEN 'Journal-Article ' ELSE 'book' END AS type,
['cc-by', 'CC0', 'closed', NULL][doc_id % 4 + 1] AS license, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 9 END AS cited_by, CASE WHEN doc_id % 13 <> 0 THEN 2000 + doc_id % 30 END AS year, CASE WHEN doc_id % 2 = 0 THEN lang END AS language FROM documents"""
_SAMPLE = "trim(coalesce(title, '') || ' ' || coalesce(abstract, ''))"
_RECORD_TESTS = {
    "missing_or_short_title": "length(trim(title)) >= 12", "short_abstract": "length(abstract) >= 400", "not_open_access": "is_open_access", "missing_doi": "coalesce(doi, '') <> ''", "not_journal_article": "lower(trim(coalesce(type, ''))) = 'journal-article'",
    "license_not_allowlisted": f"list_contains({q(reports.RecordRules.licenses)}, lower(trim(coalesce(license, ''))))", "low_citation_count": "cited_by IS NULL OR cited_by >= 2", "publication_year_out_of_range": "year IS NULL OR year BETWEEN 2010 AND 2100",
    "language_not_allowlisted": "lower(trim(coalesce(language, ''))) IN ('', 'en')",
    "language_detection_failed": rf"lower(trim(coalesce(language, ''))) <> '' OR (len(regexp_extract_all({_SAMPLE}, '[A-Za-z]')) >= 50 AND len(regexp_extract_all({_SAMPLE}, '[^\x00-\x7F]'))::DOUBLE / greatest(length({_SAMPLE}), 1) < 0.08)",
}


def records(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i, F.substring("text", F.lit(1), (i % 30).cast("int")).alias("title"), F.col("text").alias("abstract"), (i % 5 != 0).alias("is_open_access"), F.when(i % 7 != 0, F.concat(F.lit("10.1/"), i.cast("string"))).alias("doi"),
        F.when(i % 11 != 0, "Journal-Article ").otherwise("book").alias("type"), F.get(F.array(F.lit("cc-by"), F.lit("CC0"), F.lit("closed"), F.lit(None)), (i % 4).cast("int")).alias("license"), F.when(i % 3 != 0, i % 9).alias("cited_by"),
        F.when(i % 13 != 0, 2000 + i % 30).alias("year"), F.when(i % 2 == 0, F.col("lang")).alias("language"),
    )


@query(f"WITH r AS ({_RECORDS}) SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({t}, false) THEN '{k}' END" for k, t in _RECORD_TESTS.items()) + "], lambda x: x IS NOT NULL), ',') AS failures FROM r")
def f6_record_gates(spark, sf_dir):
    rows = corpus.gates(records(spark, sf_dir), reports.record_checks(reports.RecordRules(least_cited=2)))
    return rows.select("doc_id", F.array_join("failures", ",").alias("failures"))


_STATED = "text || CASE WHEN doc_id % 3 = 0 THEN ' Data are available at x. No conflict.' ELSE ' Informed consent.' END"


@query(f"WITH d AS (SELECT doc_id, lower({_STATED}) AS low FROM documents) SELECT doc_id, " + ", ".join("(" + " OR ".join(f"contains(low, '{p}')" for p in ps) + f") AS {k}" for k, ps in reports.COMPLIANCE.items()) + " FROM d")
def f13_compliance(spark, sf_dir):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Data are available at x. No conflict.").otherwise(" Informed consent."))
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in reports.compliance(text).items()))


_TOPICS = ("quantum chemistry", "a clinical trial", "markets", "the AI", "ecology of earth", "a theorem", "teaching", "nothing")


@query(f"WITH d AS (SELECT doc_id, lower({q(_TOPICS)}[doc_id % 8 + 1] || ' ' || lang) AS low FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{n}'" for p, n in reports.FIELDS) + f" ELSE '{reports.OTHER_FIELD}' END AS field FROM d")
def f14_fields(spark, sf_dir):
    topic = F.get(A.literal(_TOPICS), (F.col("doc_id") % 8).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", reports.field_of(F.concat(topic, F.lit(" "), "lang")).alias("field"))


@query(
    f"SELECT doc_id, score >= 0 AND score < 80 AND (sentence_avg < 60 OR burstiness < 60) AS needs_work FROM (SELECT doc_id, sentence_avg, burstiness, 0.0::DOUBLE + {D._SCORE} AS score FROM ({D._DIMENSIONS}))"
)
def f11_needs_work(spark, sf_dir):
    return corpus.needs_work(D.scoring.dimensions(table(spark, sf_dir, "documents"), D.LEXICON), ("sentence_avg", "burstiness"))


@query()
def e4_facts_kept(spark, sf_dir):
    return reports.facts_kept(C.pairs(spark, sf_dir)).drop("original", "rewritten")


@query()
def e7_preserved(spark, sf_dir):
    """Manuscripts against a version with other references in every third."""
    rows = D.markup(spark, sf_dir).select("doc_id", F.col("source").alias("original"), F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("source", r"\\ref\{fig:", r"\\ref{tab:")).otherwise(F.col("source")).alias("rewritten"))
    return reports.preserved(rows).drop("original", "rewritten")


_PAIRED = rf"""WITH m AS ({D.MARKUP_SQL}), p AS (SELECT doc_id, source AS a, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(source, '\\ref\{{fig:', '\\ref{{tab:', 'g') ELSE source END AS b FROM m)"""
_KEYS = {"cites": extract.CITE, "refs": extract.REF, "labels": extract.LABEL, "math": r"(\$[^$]+\$)"}


def _keys_sql(text: str, pattern: str) -> str:
    return f"list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all({text}, '{pattern}', 1), lambda x: string_split(x, ','))), lambda x: trim(x)), lambda x: x <> ''))"


@query(
    _PAIRED
    + ", k AS (SELECT doc_id, "
    + ", ".join(f"{_keys_sql(s, p)} AS {n}_{s}" for n, p in _KEYS.items() for s in "ab")
    + " FROM p) SELECT doc_id, "
    + ", ".join(f"array_to_string(list_sort(list_filter({n}_{x}, lambda v: NOT list_contains({n}_{y}, v))), ',') AS {n}_{w}" for n in _KEYS for x, y, w in (("a", "b", "lost"), ("b", "a", "added")))
    + ", "
    + " AND ".join(f"len(list_filter({n}_{x}, lambda v: NOT list_contains({n}_{y}, v))) = 0" for n in _KEYS for x, y in (("a", "b"), ("b", "a")))
    + " AS valid FROM k"
)
def e5_integrity(spark, sf_dir):
    rows = D.markup(spark, sf_dir).select("doc_id", F.col("source").alias("a"), F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("source", r"\\ref\{fig:", r"\\ref{tab:")).otherwise(F.col("source")).alias("b"))
    out = extract.integrity(rows, "a", "b")
    return out.select("doc_id", *(F.array_join(F.array_sort(c), ",").alias(c) for c in out.columns if c.endswith(("_lost", "_added"))), "valid")


def section_texts(spark, sf_dir) -> DataFrame:
    rows = extract.sections(D.markup(spark, sf_dir), "source", "doc_id").join(D.markup(spark, sf_dir), "doc_id")
    return rows.withColumn("content", F.substr("source", F.col("content_start") + 1, F.col("content_end") - F.col("content_start")))


_SECTIONS = f"SELECT *, substr(source, x + 1, y - x) AS content FROM ({D._SECTION_ROWS})"
_ORDER = "['" + "', '".join(extract.EXPECTED_ORDER) + "']"
_N = rf"len(list_filter(regexp_split_to_array({{}}, '{B}+'), lambda w: w <> ''))"


@query(
    f"""WITH s AS ({_SECTIONS}), g AS (SELECT doc_id, count(*) AS n_sections, CAST(sum({_N.format('content')}) AS BIGINT) AS n_words, max({_N.format('content')}) AS most, list(kind ORDER BY position) AS kinds,
flatten(list(list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda p: {_N.format('p')}), lambda n: n > 5))) AS pl FROM s GROUP BY doc_id),
k AS (SELECT *, list_filter({_ORDER}, lambda x: list_contains(kinds, x)) AS wanted, list_transform(list_filter(list_transform(range(1, len(kinds) + 1), lambda i: {{'k': kinds[i], 'f': list_position(kinds, kinds[i]) = i}}), lambda z: z.f AND list_contains({_ORDER}, z.k)), lambda z: z.k) AS present FROM g),
o AS (SELECT *, list_filter(list_transform(range(1, len(wanted) + 1), lambda i: CASE WHEN wanted[i] <> present[i] THEN i || ':' || wanted[i] || '/' || present[i] END), lambda x: x IS NOT NULL) AS issues FROM k)
SELECT doc_id, n_sections, n_words, array_to_string(list_sort(list_filter(['abstract', 'introduction', 'conclusion'], lambda x: NOT list_contains(kinds, x))), ',') AS missing, array_to_string(issues, ',') AS order_issues, len(issues) = 0 AS in_order, round(100.0::DOUBLE * most / greatest(n_words, 1), 1) AS largest_percent,
CAST(len(pl) AS INTEGER) AS n_paragraphs, round(coalesce(list_sum(pl), 0)::DOUBLE / greatest(len(pl), 1), 1) AS paragraph_words, CAST(len(list_filter(pl, lambda x: x > 200)) AS INTEGER) AS long_paragraphs, CAST(len(list_filter(pl, lambda x: x < 30)) AS INTEGER) AS short_paragraphs FROM o"""
)
def e13_structure(spark, sf_dir):
    out = reports.structure(section_texts(spark, sf_dir), F.col("content"))
    return out.withColumn("missing", F.array_join("missing", ",")).withColumn("order_issues", F.array_join("order_issues", ","))


JOURNAL = reports.Journal("A", 2, ("introduction", "methodology", "results", "related_work"), True)


@query(
    f"""WITH s AS ({_SECTIONS}), g AS (SELECT doc_id, min(CASE WHEN kind = 'abstract' THEN {_N.format('content')} END) AS abstract_words, list(kind ORDER BY position) AS kinds FROM s GROUP BY doc_id),
p AS (SELECT *, list_filter(list_transform(list_filter(list_transform(range(1, len(kinds) + 1), lambda i: {{'k': kinds[i], 'f': list_position(kinds, kinds[i]) = i}}), lambda z: z.f), lambda z: coalesce(list_position({q(JOURNAL.order)}, z.k), 0)), lambda i: i > 0) AS spots FROM g)
SELECT doc_id, CAST(abstract_words AS INTEGER) AS abstract_words, array_to_string(list_filter([CASE WHEN abstract_words > 2 THEN 'abstract_length' END, CASE WHEN spots <> list_sort(spots) THEN 'section_order' END, 'keywords'], lambda x: x IS NOT NULL), ',') AS issues, NOT coalesce(abstract_words > 2, false) AND spots = list_sort(spots) AS compliant FROM p"""
)
def e14_journal(spark, sf_dir):
    rows = reports.journal_checks(section_texts(spark, sf_dir), F.col("content"), JOURNAL)
    return rows.withColumn("issues", F.array_join("issues", ","))


def _checks(spark, sf_dir) -> DataFrame:
    """What the report sums up: sections, risk by the document's length, grave phrases, statements, citations."""
    kinds = extract.sections(D.markup(spark, sf_dir), "source", "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    i, n = F.col("doc_id"), F.col("n_chars")
    docs = table(spark, sf_dir, "documents")
    markers = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(p)), F.lit(p)) for p, _, s in D.HITS if s == "must_fix"]))
    stated = reports.compliance(F.col("text"))
    missing = sum(((~c).cast("int") for c in stated.values()), F.lit(0))
    own = docs.select(i, F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low").alias("risk"), markers.alias("markers"), F.when(i % 2 == 0, 0).otherwise(missing).alias("missing_compliance"), (i % 9).alias("cited"), (i % 4).alias("verified"))
    return own.join(kinds, "doc_id")


_MARKERS = ", ".join(f"CASE WHEN contains(lower(text), '{p}') THEN '{p}' END" for p, _, s in D.HITS if s == "must_fix")
_MISSING = " + ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in ps) + " THEN 0 ELSE 1 END" for ps in reports.COMPLIANCE.values())
_REQUIRED = q(extract.REQUIRED_SECTIONS)


@query(
    f"""WITH s AS (SELECT doc_id, list(DISTINCT kind) AS kinds FROM ({D._SECTION_ROWS}) GROUP BY doc_id), d AS (SELECT doc_id, ['high', 'medium', 'low'][n_chars % 3 + 1] AS risk, list_filter([{_MARKERS}], lambda x: x IS NOT NULL) AS markers, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE {_MISSING} END AS lacking, doc_id % 9 AS cited, doc_id % 4 AS verified FROM documents),
j AS (SELECT *, list_filter({_REQUIRED}, lambda x: NOT list_contains(kinds, x)) AS missing FROM d JOIN s USING (doc_id))
SELECT doc_id, CASE WHEN len(missing) = 0 THEN 'success' ELSE 'warnings' END AS status, len(missing) = 0 AND risk <> 'high' AND lacking = 0 AS compliant, array_to_string(list_filter({_REQUIRED}, lambda x: list_contains(kinds, x)), ',') AS complete, array_to_string(missing, ',') AS missing,
CASE WHEN len(missing) = 0 THEN 'strong' ELSE 'adequate' END AS argumentation, CASE WHEN list_contains(kinds, 'methodology') THEN 'strong' ELSE 'weak' END AS methodology, cited, verified,
array_to_string(list_concat(list_filter([CASE WHEN risk = 'high' THEN 'risk high' END, CASE WHEN risk = 'medium' THEN 'risk medium' END, CASE WHEN len(markers) > 0 THEN 'markers: ' || array_to_string(markers[1:5], ', ') END], lambda x: x IS NOT NULL), missing[1:3]), '|') AS recommendations FROM j"""
)
def e17_quality_report(spark, sf_dir):
    rows = reports.quality_report(_checks(spark, sf_dir))
    return rows.select("doc_id", "status", "compliant", F.array_join("complete", ",").alias("complete"), F.array_join("missing", ",").alias("missing"), "argumentation", "methodology", "cited", "verified", F.array_join("recommendations", "|").alias("recommendations"))


@query("SELECT event_type, count(*) AS entries, CAST(sum(user_id % 5) AS BIGINT) AS hits, round(sum((user_id % 5) * value), 6) AS saved FROM events GROUP BY event_type".replace("event_type, ", "", 1).replace(" GROUP BY event_type", ""))
def a15_cache_totals(spark, sf_dir):
    return reports.cache_totals(table(spark, sf_dir, "events").withColumn("hits", F.col("user_id") % 5), "hits", "value")


STAGES = ((1, "Deconstruction"), (2, "Scrub"), (3, "Rhythm"), (4, "Voice"))


@query("WITH s(stage, name) AS (VALUES " + ", ".join(map(str, STAGES)) + ") SELECT event_id, user_id % 6 AS stage, name FROM events LEFT JOIN s ON user_id % 6 = stage")
def j10_stage_names(spark, sf_dir):
    names = spark.createDataFrame(STAGES, "stage bigint, name string")  # a rule table of some rows
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 6).alias("stage")).join(F.broadcast(names), "stage", "left")


# Grammar

_GRAMMAR_TEXT = r"text || ' beofre we is here , i think;ok due to the fact that'"


def _grammar_sql() -> str:
    text = _GRAMMAR_TEXT
    for _, pattern, by, cased in edit.GRAMMAR:
        if not cased or by in ("I", "before", "because"):
            text = rf"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    parts = rf"string_split(regexp_replace({text}, '(^|[.!?][ \t\n\r\f\v]+)([a-z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    capital = f"list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN i = 1 THEN ps[1] ELSE upper(ps[i][1]) || ps[i][2:] END)"
    return rf"SELECT doc_id, CASE WHEN regexp_matches(x, '[.!?]$') THEN t ELSE x || '.' END AS text FROM (SELECT doc_id, t, regexp_replace(t, '[ \t\n\r\f\v]+$', '') AS x FROM (SELECT doc_id, array_to_string({capital}, '') AS t FROM (SELECT doc_id, {parts} AS ps FROM documents)))"


@query(_grammar_sql())
def e21_grammar(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" beofre we is here , i think;ok due to the fact that")).alias("text"))
    return edit.grammar(rows, "text", "doc_id").select("doc_id", "text")
