"""Queries on profiles, attribution, structure, citations and versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import segment as S
from scriptorium.operators import extract
from scriptorium.operators import profiles as P
from scriptorium.operators import sentences as N
from scriptorium.plans import documents as D
from scriptorium.plans.documents import LEXICON, SENT1, SENT5, WORDS, B, _contained, q, spread, stripped, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _r(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / {b} ELSE 0.0 END"


_SYL = "CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all(regexp_replace(regexp_replace(x, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{1,2}')), 1) END"
_CONSISTENCY = rf"""WITH p AS (SELECT doc_id, unnest(ps) AS p FROM (SELECT doc_id, list_filter({stripped("regexp_split_to_array(text, '\n{2,}')")}, lambda x: len(list_filter(regexp_split_to_array(x, '{B}+'), lambda w: w <> '')) >= 10) AS ps FROM documents)),
c AS (SELECT doc_id, regexp_extract_all(lower(p), '[a-z]+') AS w, greatest(len({stripped("regexp_split_to_array(p, '[.!?]+')")}), 1) AS s FROM p),
g AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN 0.39 * (len(w)::DOUBLE / s) + 11.8 * (list_sum(list_transform(w, lambda x: {_SYL}))::DOUBLE / len(w)) - 15.59 ELSE 0.0 END AS g FROM c),
o AS (SELECT d.doc_id, count(g) AS paragraphs, coalesce(stddev_pop(g), 0.0) AS d FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, paragraphs, round(d, 6) AS deviation, CASE WHEN paragraphs < 2 THEN 75 WHEN d >= 5 THEN 90 WHEN d >= 3 THEN 65 WHEN d >= 1.5 THEN 45 ELSE 20 END AS score,
CASE WHEN paragraphs < 2 THEN 'natural' WHEN d >= 3 THEN 'natural' WHEN d >= 1.5 THEN 'suspicious' ELSE 'very_suspicious' END AS verdict FROM o"""


@query(_CONSISTENCY)
def d27_consistency(spark, sf_dir):
    return P.consistency(table(spark, sf_dir, "documents"))


FINGERPRINTS = (("long", "avg_sentence_tokens", 10.0, 30.0), ("long", "type_token_ratio", 0.3, 0.7), ("short", "avg_sentence_tokens", 2.0, 12.0), ("short", "type_token_ratio", 0.6, 1.0), ("mixed", "avg_sentence_tokens", 6.0, 16.0), ("mixed", "type_token_ratio", 0.4, 0.9))


def _attribution_sql() -> str:
    means = []
    for name in sorted({f[0] for f in FINGERPRINTS}):
        own = [f"greatest(0.0::DOUBLE, 1 - abs({c} - {(a + b) / 2}::DOUBLE) / {(b - a) / 2 * 3}::DOUBLE)" for n, c, a, b in FINGERPRINTS if n == name]
        means.append(f"{{'r': -round(({' + '.join(own)}) / {len(own)}, 9), 'n': '{name}'}}")
    return f"WITH x AS ({D.ORACLE_SQL['document_features']}), b AS (SELECT doc_id, list_sort([{', '.join(means)}])[1] AS b FROM x) SELECT doc_id, b.n AS model, -b.r AS confidence FROM b"


@query(_attribution_sql())
def d28_attribution(spark, sf_dir):
    return P.attribution(D.document_features(spark, sf_dir), FINGERPRINTS)


SLOP = (("the", "a", "low"), ("with", "by", "high"), ("and", "or", "medium"))
_SLOP_N = f"len(regexp_split_to_array(text, '{B}+'))"
_SLOP_HITS = rf"len(regexp_extract_all(lower(text), '\b(?:{'|'.join(w for w, _, _ in SLOP)})\b'))"
_SLOP = f"CAST(floor(least(greatest(100.0::DOUBLE - 15.0 * ({_SLOP_HITS} * 1000.0::DOUBLE / {_SLOP_N}), 0.0), 100.0) + 0.5) AS BIGINT)"


@query(f"SELECT doc_id, CAST({_SLOP_HITS} AS BIGINT) AS n, round({_SLOP_HITS} * 1000.0::DOUBLE / {_SLOP_N}, 2) AS density, {_SLOP} AS slop FROM documents")
def f5_slop(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in P.slop_score(F.col("text"), [w for w, _, _ in SLOP]).items()))


@query(
    " UNION ALL ".join(
        rf"SELECT doc_id, '{w}' AS word, '{by}' AS replacement, '{severity}' AS severity, CAST(list_sum(list_transform(ps[1:k], lambda x: length(x))) + (k - 1) * {len(w)} AS INTEGER) AS position FROM (SELECT doc_id, ps, unnest(range(1, len(ps))) AS k FROM (SELECT doc_id, string_split(regexp_replace(lower(text), '\b{w}\b', chr(1), 'g'), chr(1)) AS ps FROM documents))"
        for w, by, severity in SLOP
    )
)
def f5_slop_hits(spark, sf_dir):
    return P.slop_hits(table(spark, sf_dir, "documents"), SLOP, "text", "doc_id")


@query(
    f"""WITH a AS ({D.ORACLE_SQL['d12_d16_composite']}), b AS (SELECT doc_id, {_SLOP} AS slop FROM documents), c AS ({_CONSISTENCY}), d AS ({_attribution_sql()}),
s AS (SELECT doc_id, floor(round(human_score * 0.5::DOUBLE + slop * 0.25::DOUBLE + c.score * 0.15::DOUBLE + round((1 - confidence) * 100) * 0.1::DOUBLE, 9) + 0.5) AS score FROM a JOIN b USING (doc_id) JOIN c USING (doc_id) JOIN d USING (doc_id))
SELECT doc_id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 55 THEN 'human' WHEN score >= 35 THEN 'mixed' ELSE 'ai' END AS verdict FROM s"""
)
def d29_ensemble(spark, sf_dir):
    return P.ensemble(ensemble_parts(spark, sf_dir))


def ensemble_parts(spark, sf_dir) -> DataFrame:
    """Four scores per document, joined by id."""
    a = D.d12_d16_composite(spark, sf_dir).select("doc_id", F.col("human_score").alias("built_in"))
    c = d27_consistency(spark, sf_dir).select("doc_id", F.col("score").alias("consistency"))
    d = d28_attribution(spark, sf_dir).select("doc_id", F.round((1 - F.col("confidence")) * 100).alias("attribution"))
    return a.join(f5_slop(spark, sf_dir).select("doc_id", "slop"), "doc_id").join(c, "doc_id").join(d, "doc_id")


@query(
    f"""WITH s AS (SELECT doc_id, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS pos FROM (SELECT doc_id, {stripped("string_split(text, chr(10))")} AS ps FROM documents)), n AS (SELECT doc_id, pos, len({WORDS.format('part')}) AS n FROM s),
t AS (SELECT *, 100.0::DOUBLE * n / greatest(sum(n) OVER (PARTITION BY doc_id), 1) AS share FROM n) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(n AS INTEGER) AS n, round(share, 1) AS share, share > 50 AS dominant FROM t"""
)
def e13_balance(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.stripped_parts(F.split("text", "\n"))).alias("pos", "part"))
    return P.balance(rows.select("doc_id", "pos", F.size(S.words(F.col("part"))).alias("n")), "doc_id", "n")


@query(
    """WITH r AS (SELECT conv_id, 1 + (length(text) % 10) AS score, CASE role WHEN 'user' THEN 0.3::DOUBLE WHEN 'assistant' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS weight FROM conversations), m AS (SELECT conv_id, round(sum(score * weight) / sum(weight), 6) AS overall FROM r GROUP BY conv_id)
SELECT conv_id, overall, CASE WHEN overall >= 8 THEN 0.75 WHEN overall >= 7 THEN 0.5 WHEN overall >= 6 THEN 0.3 WHEN overall >= 5 THEN 0.15 ELSE 0.05 END::DOUBLE AS acceptance FROM m"""
)
def e18_reviews(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", (1 + F.char_length("text") % 10).alias("score"), F.when(F.col("role") == "user", 0.3).when(F.col("role") == "assistant", 0.5).otherwise(0.2).alias("weight"))
    return P.reviews(rows, "conv_id", "score", "weight")


JOURNALS = ((8.5, 1e9, "en", "A", 0.95), (8.5, 1e9, None, "B", 0.85), (7.0, 8.5, "en", "C", 0.88), (7.0, 8.5, None, "D", 0.80), (-1e9, 7.0, "en", "E", 0.75), (-1e9, 7.0, None, "E", 0.75))


@query(
    "WITH j(low, high, d, journal, match) AS (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {'NULL' if d is None else repr(d)}, '{n}', {m}::DOUBLE)" for a, b, d, n, m in JOURNALS) + "), s AS (SELECT doc_id, lang, (n_chars % 100) / 10.0::DOUBLE AS score FROM documents) "
    "SELECT doc_id, lang, score, journal, match FROM s JOIN j ON score >= low AND score < high AND (CASE WHEN lang = 'en' THEN 'en' END) IS NOT DISTINCT FROM d"
)
def e15_journals(spark, sf_dir):
    scores = table(spark, sf_dir, "documents").select("doc_id", "lang", ((F.col("n_chars") % 100) / 10.0).alias("score"))
    rules = spark.createDataFrame(JOURNALS, "low double, high double, rule_domain string, journal string, match double")
    return P.recommended(scores, rules, "lang", "score")


@query(
    "WITH k AS (SELECT DISTINCT doc_id, unnest([source, 'a' || (doc_id % 7)]) AS cite_key FROM documents), w AS (SELECT DISTINCT source AS cite_key, 1 AS known FROM documents WHERE doc_id % 3 = 0) "
    "SELECT doc_id, count(*) AS cited, count(known) AS verified, round(count(known)::DOUBLE / count(*), 6) AS ratio FROM k LEFT JOIN w USING (cite_key) GROUP BY doc_id"
)
def e19_verified(spark, sf_dir):
    claims = P.claims(D.markup(spark, sf_dir), "source", "doc_id", extract.CITE)
    known = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.col("source").alias("cite_key"))
    return P.verified_ratio(claims, known, "doc_id")


_T2 = f"list_filter({D.split_at('source', rf'([.!?]){B}+', chr(39) + chr(92) + '1' + chr(39) + ' || chr(1)')}, lambda s: s <> '')"
_LIKE = f"{WORDS.format('claim')}, {WORDS.format('abstract')}"


@query(
    rf"""WITH s AS (SELECT doc_id, {spread('x')} FROM (SELECT doc_id, {_T2} AS x FROM ({D.MARKUP_SQL}))),
k AS (SELECT doc_id, pos, part AS claim, unnest(list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(part, '{extract.CITE}', 1), lambda x: string_split(x, ','))), lambda x: trim(x)), lambda x: x <> ''))) AS cite_key FROM s),
a AS (SELECT source AS cite_key, arg_min(text, doc_id) AS abstract FROM documents GROUP BY source),
w AS (SELECT k.*, abstract, list_distinct({WORDS.format('claim')}) AS p, list_distinct({WORDS.format('abstract')}) AS q FROM k LEFT JOIN a USING (cite_key)),
j AS (SELECT *, CASE WHEN abstract IS NOT NULL THEN round(CASE WHEN len(p) + len(q) = 0 THEN 1.0 ELSE len(list_intersect(p, q))::DOUBLE / len(list_distinct(list_concat(p, q))) END, 9) END AS similarity FROM w)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, claim, cite_key, similarity, similarity >= 0.25 AS supported FROM j"""
)
def e8_claims(spark, sf_dir):
    claims = P.claims(D.markup(spark, sf_dir), "source", "doc_id", extract.CITE)
    abstracts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("cite_key")).agg(F.min_by("text", "doc_id").alias("abstract"))
    return P.supported(claims, abstracts)


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '{B}+'), lambda w: w <> ''), ' ') AS text FROM documents")
def s20_inverted_index(spark, sf_dir):
    """Each document as an inverted index, and decoded again."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(S.blank_words(F.col("text"))).alias("pos", "token"))
    lists = words.groupBy("doc_id", "token").agg(F.collect_list("pos").alias("at"))  # positions of one word in one document
    entries = lists.groupBy("doc_id").agg(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("token", "at"))).alias("e"))
    return entries.select("doc_id", P.inverted_index_text(F.map_from_entries("e")).alias("text"))


@query(
    "WITH s AS (SELECT doc_id, n_chars % 101 AS before, (n_chars * 7) % 101 AS after, len(regexp_extract_all(text, 'the')) AS hits_before, len(regexp_extract_all(text, 'the ')) AS hits_after FROM documents), r AS (SELECT *, CASE WHEN hits_before > 0 THEN (hits_before - hits_after) * 100.0::DOUBLE / hits_before ELSE 0.0 END AS x FROM s) "
    "SELECT doc_id, before, after, CAST(hits_before AS INTEGER) AS hits_before, CAST(hits_after AS INTEGER) AS hits_after, after - before AS delta, round(x, 6) AS removed_percent, round(0.5::DOUBLE * after + 0.3::DOUBLE * least(greatest(x, 0), 100) + 0.2::DOUBLE * least(greatest(50 + after - before, 0), 100), 6) AS readiness FROM r"
)
def d35_version_report(spark, sf_dir):
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select("doc_id", (n % 101).alias("before"), ((n * 7) % 101).alias("after"), F.regexp_count("text", F.lit("the")).alias("hits_before"), F.regexp_count("text", F.lit("the ")).alias("hits_after"))
    return P.version_report(rows)


@query("SELECT event_id, props AS json, CAST(4 AS INTEGER) AS items, 7.5::DOUBLE AS clarity, 10.0::DOUBLE AS novelty, 5.0::DOUBLE AS rigour FROM events")
def p15_p17_parsers(spark, sf_dir):
    props = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Reply: "), F.col("props"), F.lit("\n- one\n2) two\nclarity: 7.5 novelty 12")).alias("t"))
    scores = P.review_scores(F.col("t"), ("clarity", "novelty", "rigour"))
    return props.select("event_id", P.first_json(F.col("t")).alias("json"), F.size(P.listed(F.col("t"))).alias("items"), *(v.alias(k) for k, v in scores.items()))


_EDGE = _FRONT = r"\b"


def _if(test: str, points: float) -> str:
    return f" + CASE WHEN {test} THEN {points}::DOUBLE ELSE 0 END"


def _tests() -> dict[str, str]:
    return {
        "phrase": f"{_contained('lower(part)', LEXICON.phrases)} > 0", "opener": f"len(list_filter({q(LEXICON.starters)}, lambda p: starts_with(lower(part), p))) > 0", "very long": "w > 35", "long": "w > 25",
        "formal": f"regexp_matches(part, '(?i){_FRONT}(utilize|implement|facilitate|leverage|foster|cultivate|empower){_EDGE}')", "passive": rf"regexp_matches(part, '(?i){_FRONT}(is|are|was|were|been|being)[ \t\n\r\f]+\w+ed{_EDGE}')",
        "hedging": f"{_contained('lower(part)', LEXICON.hedges)} > 0",
    }


_T = _tests()
_LATIN = (
    f"35.0::DOUBLE - 22.0 * {_contained('lower(part)', LEXICON.phrases)} - 12.0 * len(list_filter({q(LEXICON.starters)}, lambda p: starts_with(lower(part), p)))"
    + _if("w > 35", -18) + _if("w > 25", -8) + _if("w BETWEEN 2 AND 5", 5) + _if(_T["formal"], -15) + _if(_T["passive"], -8)
    + f" - 10.0 * {_contained('lower(part)', LEXICON.hedges)} - 6.0 * {_contained('lower(part)', LEXICON.quantifiers)} + 0.5 * {_contained('lower(part)', LEXICON.indicators)} + 0.5 * len(regexp_extract_all(part, '(?i)[a-z]{{1,15}}''(?:t|s|re|ve|ll|d|m)\\b'))"
    + _if(f"regexp_matches(part, '(?i){_FRONT}(I|me|my|we|us|our){_EDGE}')", 1) + _if(f"regexp_matches(part, '(?i){_FRONT}you{_EDGE}')", 0.5) + _if("ends_with(part, '?')", 1) + _if("ends_with(part, '!')", 1)
    + _if("contains(part, '—') OR contains(part, ' - ')", 1) + _if("contains(part, '(') AND contains(part, ')')", 1) + _if(f"regexp_matches(part, '(?i)^(and|but|so|because|also|plus|or|well|ok|hey){_EDGE}')", 1)
    + _if(r"w BETWEEN 10 AND 25 AND regexp_matches(part, '^(?:[\w,.!?]+[ \t\n\r\f]+)*[\w,.!?]+\z') AND regexp_matches(part, '[.!?]\z')", -18)
)
_ARABIC = (
    f"35.0::DOUBLE - 22.0 * {_contained('part', LEXICON.arabic_phrases)} - 12.0 * len(list_filter({q(LEXICON.arabic_starters)}, lambda p: starts_with(part, p))) - 5.0 * {_contained('part', LEXICON.arabic_transitions)} + 5.0 * {_contained('part', LEXICON.arabic_indicators)}"
)
_V2 = rf"least(greatest(CASE WHEN regexp_matches(part, '[\x{{0600}}-\x{{06FF}}]') THEN {_ARABIC} ELSE {_LATIN} END, 0.0::DOUBLE), 100.0::DOUBLE)"
_ROWS = f"""SELECT doc_id, pos, part, score, CASE WHEN score >= 55 THEN 'human' WHEN score >= 35 THEN 'maybe' ELSE 'ai' END AS class FROM (SELECT doc_id, CAST(pos AS INTEGER) AS pos, part, {_V2} AS score
FROM (SELECT *, len(regexp_split_to_array(part, '{B}+')) AS w FROM (SELECT doc_id, {spread('x')} FROM (SELECT doc_id, {SENT5} AS x FROM documents))))"""


def _sentences(spark, sf_dir) -> DataFrame:
    return N.sentence_rows(table(spark, sf_dir, "documents"), LEXICON)


@query(_ROWS)
def d13_sentence_classes(spark, sf_dir):
    return _sentences(spark, sf_dir)


@query(
    f"""WITH o AS (SELECT doc_id, count(*) AS n, avg(score) AS m, var_pop(score) AS v FROM ({_ROWS}) GROUP BY doc_id), g AS (SELECT *, least(15.0::DOUBLE, floor(round(sqrt(CASE WHEN n > 1 THEN v ELSE 400.0 END) * 0.6::DOUBLE, 9) + CASE WHEN n < 5 THEN 6.0 ELSE 2.0 END + 0.5)) AS g FROM o)
SELECT doc_id, n, round(m, 6) AS score, CAST(greatest(0, floor(round(m - g, 9) + 0.5)) AS BIGINT) AS lower, CAST(least(100, floor(round(m + g, 9) + 0.5)) AS BIGINT) AS upper, CASE WHEN round(m, 9) >= 55 THEN 'human' WHEN round(m, 9) >= 35 THEN 'mixed' ELSE 'ai' END AS verdict FROM g"""
)
def d14_intervals(spark, sf_dir):
    return N.intervals(_sentences(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score, pos) AS INTEGER) AS a, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS INTEGER) AS b FROM ({_ROWS}))
SELECT doc_id, pos, score, CASE WHEN a <= 5 THEN a END AS lowest, CASE WHEN b <= 5 THEN b END AS highest FROM r WHERE a <= 5 OR b <= 5"""
)
def d15_extremes(spark, sf_dir):
    return N.extremes(_sentences(spark, sf_dir))


@query(f"WITH o AS (SELECT doc_id, count(CASE WHEN class <> 'human' THEN 1 END) AS flagged, count(*) AS n FROM ({_ROWS}) GROUP BY doc_id) SELECT doc_id, flagged, n, round(flagged::DOUBLE / n, 6) AS share, 2 * flagged >= n AS escalate FROM o")
def d36_flagged(spark, sf_dir):
    return N.flagged(_sentences(spark, sf_dir))


_FOUND = ", ".join(f"CASE WHEN bool_or(contains(lower(part), '{p}')) THEN '{p}' END" for p in LEXICON.phrases)


@query(
    f"SELECT doc_id, round(avg(score), 6) AS score, {', '.join(f'count(CASE WHEN {t} THEN 1 END) AS {n.replace(chr(32), chr(95))}' for n, t in _T.items())}, array_to_string(list_filter([{_FOUND}], lambda x: x IS NOT NULL), ',') AS phrases, "
    f"CASE WHEN avg(score) >= 55 THEN 'human' WHEN avg(score) >= 35 THEN 'mixed' ELSE 'ai' END AS verdict FROM (SELECT *, len(regexp_split_to_array(part, '{B}+')) AS w FROM ({_ROWS})) GROUP BY doc_id"
)
def d15_reports(spark, sf_dir):
    return N.report(_sentences(spark, sf_dir), LEXICON)


@query(
    f"""WITH a AS ({D.ORACLE_SQL['d12_d16_composite']}), b AS (SELECT doc_id, {_SLOP} AS slop FROM documents), c AS ({_CONSISTENCY}), d AS ({_attribution_sql()}),
p AS (SELECT doc_id, human_score AS built_in, slop, c.score AS consistency, round((1 - confidence) * 100) AS attribution FROM a JOIN b USING (doc_id) JOIN c USING (doc_id) JOIN d USING (doc_id))
"""
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS axis, least(greatest(CAST({k} AS DOUBLE), 0.0), 100.0) AS value, {w}::DOUBLE AS weight FROM p" for k, w in P.ENSEMBLE.items())
)
def d29_radar(spark, sf_dir):
    return P.radar(ensemble_parts(spark, sf_dir))


@query(f"SELECT doc_id, round(1 - human_score / 100, 4) AS probability FROM ({D.ORACLE_SQL['d12_d16_composite']})")
def s23_local_probability(spark, sf_dir):
    return D.d12_d16_composite(spark, sf_dir).select("doc_id", P.local_probability(F.col("human_score")).alias("probability"))


@query("SELECT doc_id, round(list_avg(list_filter([n_chars % 7, CASE WHEN doc_id % 2 = 0 THEN 3.5 END, CASE WHEN doc_id % 5 = 0 THEN 1.0 END], lambda x: x IS NOT NULL)), 6) AS mean FROM documents")
def d26_detector_mean(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(P.detector_mean([F.col("n_chars") % 7, F.when(i % 2 == 0, 3.5), F.when(i % 5 == 0, 1.0)]), 6).alias("mean"))


@query("SELECT doc_id, source AS cite_key, 'T.' AS title FROM documents")
def e9_bibliography(spark, sf_dir):
    return P.bibliography(D.markup(spark, sf_dir), "source", "doc_id")


@query(f"WITH r AS ({_ROWS}) SELECT doc_id, pos, part FROM r WHERE EXISTS (SELECT 1 FROM r f WHERE f.doc_id = r.doc_id AND f.pos = r.pos AND f.class <> 'human')")
def j4_flagged_sentences(spark, sf_dir):
    """The sentences of a text that a table of flagged ones has."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.sentences_linear(F.col("text"))).alias("pos", "part"))
    return rows.join(_sentences(spark, sf_dir).filter("class != 'human'").select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")
