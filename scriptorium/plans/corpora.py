"""Queries on corpora, versions, vectors and relational tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import segment as S
from scriptorium.functions import text as X
from scriptorium.operators import compare, corpus, extract, ranking
from scriptorium.plans import documents as D
from scriptorium.plans.documents import SENT1, WORDS, B, stripped, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Gates, duplicates, identity

_GATES = f"""SELECT doc_id, text, source, list_filter([CASE WHEN NOT coalesce(n_chars >= 400, false) THEN 'short_text' END, CASE WHEN NOT coalesce(lang IN ('en', 'de'), false) THEN 'language_not_allowed' END,
CASE WHEN NOT coalesce(len(list_filter(regexp_split_to_array(text, '{B}+'), lambda w: w <> '')) BETWEEN 50 AND 5000, false) THEN 'word_count' END,
CASE WHEN NOT coalesce(NOT regexp_matches(text, '(?i)idiot|moron|clown'), false) THEN 'denied' END, CASE WHEN NOT coalesce(NOT contains(text, '!!'), false) THEN 'shouting' END], lambda x: x IS NOT NULL) AS failures FROM documents"""


def gated(spark, sf_dir) -> DataFrame:
    n = F.size(S.blank_words(F.col("text")))
    checks = {
        "short_text": F.col("n_chars") >= 400, "language_not_allowed": F.col("lang").isin("en", "de"), "word_count": n.between(50, 5000),
        "denied": ~F.col("text").rlike("(?i)idiot|moron|clown"), "shouting": ~F.contains("text", F.lit("!!")),
    }
    return corpus.gates(table(spark, sf_dir, "documents"), checks)


@query(f"SELECT doc_id, array_to_string(failures, ',') AS failures, len(failures) = 0 AS passed FROM ({_GATES})")
def f6_gates(spark, sf_dir):
    return gated(spark, sf_dir).select("doc_id", F.array_join("failures", ",").alias("failures"), "passed")


@query(f"SELECT failures, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(failures) AS failures FROM ({_GATES})) GROUP BY failures")
def a6_failure_histogram(spark, sf_dir):
    return corpus.histogram(gated(spark, sf_dir).select("failures"), "failures")


@query("SELECT sha256(text) AS key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, CAST(count(*) - 1 AS BIGINT) AS n_duplicates FROM documents GROUP BY sha256(text)")
def u3_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("key", F.sha2("text", 256))
    return corpus.keep_first(rows, ["key"], ["doc_id"], ["doc_id", "source"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doi:10.1/' || doc_id ELSE 'title:' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || '|' || (2000 + doc_id % 20) END AS key FROM documents")
def x6_identity_keys(spark, sf_dir):
    doi = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", X.identity_key(doi, F.col("text"), 2000 + F.col("doc_id") % 20).alias("key"))


# Summaries

_NUM = ("n_tokens", "n_sentences", "n_paragraphs", "type_token_ratio", "lexical_density", "sentence_sd", "passive_ratio", "contraction_ratio", "transition_ratio", "question_ratio", "exclamation_ratio")


@query("WITH x AS (" + D.ORACLE_SQL["document_features"] + ") " + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(count({c}) AS BIGINT) AS n, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd FROM x" for c in _NUM))
def a1_a2_distributions(spark, sf_dir):
    return corpus.describe(D.document_features(spark, sf_dir), _NUM)


@query("SELECT lang, 'n_chars' AS feature, CAST(count(n_chars) AS BIGINT) AS n, CAST(min(n_chars) AS DOUBLE) AS low, CAST(max(n_chars) AS DOUBLE) AS high, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS sd FROM documents GROUP BY lang")
def a7_by_language(spark, sf_dir):
    return corpus.describe(table(spark, sf_dir, "documents"), ["n_chars"], ["lang"])


_TOK = f"SELECT doc_id, lang, unnest({WORDS.format('text')}) AS token FROM documents"


def tokens(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(S.words(F.col("text"))).alias("token"))


@query(f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM ({_TOK}) GROUP BY token ORDER BY n DESC, token LIMIT 100")
def a3_top_tokens(spark, sf_dir):
    return corpus.top_tokens(tokens(spark, sf_dir), 100)


@query(f"SELECT * FROM (SELECT lang, token, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, token) AS INTEGER) AS place FROM ({_TOK}) GROUP BY lang, token) WHERE place <= 20")
def a3_top_tokens_by_language(spark, sf_dir):
    return corpus.top_tokens(tokens(spark, sf_dir), 20, ["lang"])


@query(
    f"""WITH t AS (SELECT doc_id, token, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, token) AS place FROM ({_TOK}) GROUP BY doc_id, token)
SELECT token, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS docs FROM t WHERE place <= 30 GROUP BY token"""
)
def a4_keyword_totals(spark, sf_dir):
    """Sums of each document's 30 most frequent tokens only, as the reference defines it."""
    return corpus.top_tokens(tokens(spark, sf_dir), 30, ["doc_id"]).groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(f"WITH c AS (SELECT doc_id, token, count(*) AS n FROM ({_TOK}) GROUP BY doc_id, token) SELECT doc_id, CAST(count(*) AS BIGINT) AS distinct_tokens, CAST(count(CASE WHEN n = 1 THEN 1 END) AS BIGINT) AS hapax, CAST(max(n) AS BIGINT) AS most, round(avg(n), 6) AS average FROM c GROUP BY doc_id")
def a21_frequencies(spark, sf_dir):
    counts = tokens(spark, sf_dir).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("distinct_tokens"), F.count_if(F.col("n") == 1).alias("hapax"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("average"))


_LEN = f"SELECT doc_id, lang, len({WORDS.format('part')}) AS n FROM (SELECT doc_id, lang, unnest(s) AS part FROM (SELECT doc_id, lang, {SENT1} AS s FROM documents))"


@query(f"SELECT lang, {', '.join(f'round(quantile_cont(n, {q / 100}), 6) AS p{q}' for q in (10, 25, 50, 75, 90))} FROM ({_LEN}) GROUP BY lang")
def a8_sentence_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(F.transform(S.sentences_before_capital(F.col("text")), lambda x: F.size(S.words(x)))).alias("n"))
    return corpus.percentiles(rows, "n", (0.1, 0.25, 0.5, 0.75, 0.9), ["lang"])


_PHRASES = ("the", "and", "der", "que")
_FREQ = "UNION ALL ".join(f"SELECT doc_id, '{p}' AS key, 1000.0 * len(list_filter(w, lambda x: x = '{p}')) / len(w) AS value FROM d WHERE list_contains(w, '{p}') " for p in _PHRASES)


@query(f"WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), f AS ({_FREQ}) SELECT key, round(sum(value) / (SELECT count(*) FROM documents), 9) AS mean FROM f GROUP BY key")
def a9_map_average(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(S.words(F.col("text")).alias("w"))

    def entry(p: str):
        return F.when(F.array_contains("w", p), F.struct(F.lit(p).alias("key"), (1000.0 * F.size(F.filter("w", lambda x: x == p)) / F.size("w")).alias("value")))

    entries = F.array_compact(F.array(*map(entry, _PHRASES)))
    rows = docs.select(F.map_from_entries(entries).alias("m"))
    return corpus.map_average(rows, "m", docs.agg(F.count(F.lit(1)).alias("n")))


@query("WITH x AS (" + D.ORACLE_SQL["document_features"] + "), m AS (SELECT avg(avg_sentence_tokens) AS l, avg(type_token_ratio) AS t FROM x) SELECT doc_id, 50 + CASE WHEN abs(avg_sentence_tokens - l) <= 0.25 * l THEN 15 ELSE -15 END + CASE WHEN abs(type_token_ratio - t) <= 0.25 * t THEN 15 ELSE -15 END AS match FROM x, m")
def d21_corpus_match(spark, sf_dir):
    """Documents against the one-row model of their corpus."""
    rows = D.document_features(spark, sf_dir).select("doc_id", "avg_sentence_tokens", "type_token_ratio")
    model = rows.agg(F.avg("avg_sentence_tokens").alias("l"), F.avg("type_token_ratio").alias("t"))

    def near(x: str, m: str):
        return F.when(F.abs(F.col(x) - F.col(m)) <= 0.25 * F.col(m), 15).otherwise(-15)

    return rows.crossJoin(F.broadcast(model)).select("doc_id", (50 + near("avg_sentence_tokens", "l") + near("type_token_ratio", "t")).alias("match"))


# Splits, models, metrics

_BUCKET = "(('0x' || substr(sha256('s1|' || doc_id), 1, 8))::BIGINT % 100)"
_SPLIT = f"CASE WHEN {_BUCKET} < 70 THEN 'train' WHEN {_BUCKET} < 85 THEN 'validation' ELSE 'test' END"


@query(f"SELECT doc_id, {_SPLIT} AS split FROM documents")
def m2_hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", corpus.split_of(F.col("doc_id"), "s1").alias("split"))


@query("WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::DOUBLE / count(*) OVER () AS x FROM documents) SELECT doc_id, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.85 THEN 'validation' ELSE 'test' END AS split FROM r")
def m3_positional_split(spark, sf_dir):
    return corpus.positional_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


_SCORED = f"SELECT l.doc_id, d.lang, l.quality AS label, p.probability, p.prediction FROM labels l JOIN documents d USING (doc_id) JOIN ({D.LOGISTIC_SQL}) p USING (doc_id)"


def scored(spark, sf_dir) -> DataFrame:
    """Labelled documents only are measured: the join with the narrow labels comes before the features."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents")
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    return labels.join(docs.select("doc_id", "lang"), "doc_id").join(D.logistic_of(known), "doc_id")


def _confusion_sql(by: str = "") -> str:
    p, r = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END", "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END"
    g = f"{by}, " if by else ""
    return f"""WITH x AS ({_SCORED}), c AS (SELECT {g}count(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) AS tp, count(CASE WHEN label = 0 AND prediction = 1 THEN 1 END) AS fp, count(CASE WHEN label = 0 AND prediction = 0 THEN 1 END) AS tn,
    count(CASE WHEN label = 1 AND prediction = 0 THEN 1 END) AS fn, round(avg((probability - label) * (probability - label)), 9) AS brier FROM x {'GROUP BY ' + by if by else ''})
    SELECT {g}tp, fp, tn, fn, brier, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 9) AS accuracy, round({p}, 9) AS precision, round({r}, 9) AS recall, round(CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END, 9) AS f1 FROM c"""


@query(_confusion_sql())
def a16_confusion(spark, sf_dir):
    return corpus.confusion(scored(spark, sf_dir))


@query(_confusion_sql("lang"))
def a19_by_domain(spark, sf_dir):
    return corpus.confusion(scored(spark, sf_dir), by=["lang"])


_AUROC = f"""WITH x AS ({_SCORED}), s AS (SELECT probability AS p, sum(label) AS pos, sum(1 - label) AS neg FROM x GROUP BY probability),
r AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM s)
SELECT round(sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)), 9) AS auroc FROM r"""


@query(_AUROC)
def a17_auroc(spark, sf_dir):
    return corpus.auroc(scored(spark, sf_dir))


@query(f"WITH x AS ({_SCORED}), b AS (SELECT least(floor(probability * 10), 9) AS bin, count(*) AS n, avg(probability) AS p, avg(CAST(prediction = label AS INTEGER)) AS r FROM x GROUP BY 1) SELECT round(sum(n * abs(p - r)) / sum(n), 9) AS ece FROM b")
def a18_calibration(spark, sf_dir):
    return corpus.calibration(scored(spark, sf_dir))


@query(f"WITH m AS ({_confusion_sql()}), r AS ({_AUROC}) SELECT accuracy, f1, auroc, accuracy >= 0.55 AS accuracy_ok, f1 >= 0.55 AS f1_ok, auroc >= 0.6 AS auroc_ok, accuracy >= 0.55 AND f1 >= 0.55 AND auroc >= 0.6 AS passed FROM m, r")
def m8_quality_gate(spark, sf_dir):
    rows = scored(spark, sf_dir)
    metrics = corpus.confusion(rows).crossJoin(corpus.auroc(rows))  # one row each
    return corpus.quality_gate(metrics, {"accuracy": 0.55, "f1": 0.55, "auroc": 0.6})


@query()
def m5_logistic_training(spark, sf_dir):
    """M1, M5: a logistic regression over the feature vector, and its score per labelled document."""
    from scriptorium.operators import training

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    known = table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = D.features_of(known).join(labels, "doc_id")
    return training.fit_and_score(rows)


@query()
def m6_losses(spark, sf_dir):
    """M6: the loss of each training step on the labelled documents."""
    from scriptorium.operators import training

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    known = table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    return training.losses(D.features_of(known).join(labels, "doc_id"))


# Pairs and versions

_EDIT = "regexp_replace(regexp_replace(text, ' the ', ' this ', 'g'), '\\.', CASE WHEN doc_id % 2 = 0 THEN '.' ELSE ',' END, 'g')"


def pairs(spark, sf_dir) -> DataFrame:
    """Each document and an edited version of it."""
    mark = F.when(F.col("doc_id") % 2 == 0, F.lit(".")).otherwise(F.lit(","))
    edited = F.replace(F.regexp_replace("text", " the ", " this "), F.lit("."), mark)
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("original"), edited.alias("rewritten"))


_W = WORDS.format
_J = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
_G = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i+1])"


@query(
    f"""WITH p AS (SELECT doc_id, text AS original, {_EDIT} AS rewritten FROM documents), w AS (SELECT *, {_W('original')} AS x, {_W('rewritten')} AS y FROM p), g AS (SELECT *, {_G.format('x')} AS gx, {_G.format('y')} AS gy FROM w),
s AS (SELECT *, round({_J.format(a='x', b='y')}, 9) AS tokens, round({_J.format(a='gx', b='gy')}, 9) AS bigrams, round(CASE WHEN greatest(len(x), len(y)) > 0 THEN least(len(x), len(y))::DOUBLE / greatest(len(x), len(y)) ELSE 1.0 END, 9) AS length FROM g),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN tokens < 0.95 THEN 'tokens' END, CASE WHEN bigrams < 0.95 THEN 'bigrams' END, CASE WHEN length < 0.95 THEN 'length' END], lambda v: v IS NOT NULL), '+') AS reasons FROM s)
SELECT doc_id, tokens, bigrams, length, reasons, md5(CASE WHEN reasons = '' THEN rewritten ELSE original END) AS chosen FROM r"""
)
def e11_retention(spark, sf_dir):
    return compare.retention(pairs(spark, sf_dir), least=0.95).drop("original", "rewritten").withColumn("chosen", F.md5("chosen"))


@query()
def e10_fidelity(spark, sf_dir):
    return compare.fidelity(pairs(spark, sf_dir)).drop("original", "rewritten")


def _positions(parts: str, name: str) -> str:
    return f"SELECT doc_id, unnest({parts}) AS {name}, generate_subscripts({parts}, 1) - 1 AS pos"


@query(
    f"""WITH a AS (SELECT doc_id, unnest(s) AS before, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, {SENT1} AS s FROM documents)),
e AS (SELECT doc_id, {_EDIT} AS text FROM documents), b AS (SELECT doc_id, unnest(s) AS after, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, {SENT1} AS s FROM e))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CAST(coalesce(a.pos, b.pos) AS INTEGER) AS pos, before, after FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.pos = b.pos"""
)
def j3_aligned_sentences(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return compare.aligned_sentences(rows.select("doc_id", F.col("original").alias("text")), rows.select("doc_id", F.col("rewritten").alias("text")), "doc_id")


@query("WITH n AS (SELECT doc_id, 'new' AS source, lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 1000000, 'new', NULL FROM documents WHERE doc_id % 7 = 0), o AS (SELECT doc_id, source, lang FROM documents) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.source, o.source) AS source, coalesce(n.lang, o.lang) AS lang FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def j12_merged(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    new = old.filter("doc_id % 3 = 0").withColumn("source", F.lit("new")).unionByName(old.filter("doc_id % 7 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("source"), F.lit(None).cast("string").alias("lang")))
    return compare.merged(old, new, "doc_id")


@query("SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'labelled' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j1_left_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), "quality")
    return table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("l"), "left").select("doc_id", "quality", F.when(F.col("l").isNull(), "unlabelled").otherwise("labelled").alias("state"))


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def j4_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j5_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


_PAIRED = "SELECT doc_id // 2 AS pair_id, CASE WHEN doc_id % 2 = 0 THEN 'human' ELSE 'changed' END AS label, sha256(text) AS text_hash FROM documents"


@query(
    f"""WITH r AS ({_PAIRED}), p AS (SELECT pair_id, count(DISTINCT label) AS kinds, count(*) AS n FROM r GROUP BY pair_id), l AS (SELECT text_hash, count(DISTINCT pair_id) AS pairs FROM r GROUP BY text_hash)
SELECT (SELECT count(*) FROM p WHERE kinds < 2) AS incomplete_pairs, (SELECT count(*) FROM p WHERE n > kinds) AS duplicate_labels, (SELECT count(*) FROM l WHERE pairs > 1) AS leaked_texts,
(SELECT count(*) FROM r WHERE label NOT IN ('human', 'changed')) AS unknown_labels, (SELECT round(count(CASE WHEN label = 'human' THEN 1 END)::DOUBLE / count(*), 6) FROM r) AS balance"""
)
def a20_validate_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id DIV 2").alias("pair_id"), F.when(F.col("doc_id") % 2 == 0, "human").otherwise("changed").alias("label"), F.sha2("text", 256).alias("text_hash"))
    return corpus.validate_pairs(rows, ("human", "changed"))


@query("SELECT * FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n % 10 = 0".replace("SELECT *", "SELECT lang, doc_id", 1))
def w7_every_tenth(spark, sf_dir):
    return ranking.every_kth(table(spark, sf_dir, "documents").select("lang", "doc_id"), "doc_id", 10, ["lang"])


@query(
    f"""WITH s AS (SELECT doc_id, unnest(x) AS part, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, {SENT1} AS x FROM documents)), f AS (SELECT doc_id, pos, {_W('part')}[1] AS w FROM s),
l AS (SELECT *, lag(w, 1) OVER o AS a, lag(w, 2) OVER o AS b FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, CAST(count(CASE WHEN w = a AND w = b THEN 1 END) AS BIGINT) AS runs FROM l GROUP BY doc_id"""
)
def d30_parallel_starts(spark, sf_dir):
    """Places where three sentences in a row start with the same word."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.sentences_before_capital(F.col("text"))).alias("pos", "part")).select("doc_id", "pos", F.get(S.words(F.col("part")), F.lit(0)).alias("w"))
    o = W.partitionBy("doc_id").orderBy("pos")
    return rows.withColumn("a", F.lag("w", 1).over(o)).withColumn("b", F.lag("w", 2).over(o)).groupBy("doc_id").agg(F.count_if((F.col("w") == F.col("a")) & (F.col("w") == F.col("b"))).alias("runs"))


@query(
    f"""WITH p AS (SELECT doc_id, {stripped("regexp_split_to_array(text, '\n{1,}')")} AS ps FROM documents), l AS (SELECT doc_id, list_transform(ps, lambda x: len({_W('x')})) AS n FROM p)
SELECT doc_id, coalesce(list_stddev_pop(n), 0.0) < 15 AND coalesce(list_avg(n), 0.0) > 40 AS uniform FROM l"""
)
def d31_uniform_paragraphs(spark, sf_dir):
    from scriptorium.functions import arrays as A

    n = F.transform(S.stripped_parts(F.split("text", r"\n{1,}")), lambda x: F.size(S.words(x)))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", ((A.deviation(F.col("n")) < 15) & (A.mean(F.col("n")) > 40)).alias("uniform"))


# Vectors

_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(
    f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS item, round({_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}), 9) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query, item, similarity, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS place FROM p) WHERE place <= 5"""
)
def j7_nearest(spark, sf_dir):
    """Every 20th vector, the stated query set, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return compare.nearest(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 5)


@query(f"SELECT a.vec_id, a.label, round({_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}), 9) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def x9_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.filter("vec_id = 0").select(F.col("embedding").alias("other")).limit(1)
    return vectors.crossJoin(F.broadcast(one)).select("vec_id", "label", F.round(X.cosine(F.col("embedding"), F.col("other")), 9).alias("similarity"))


# Schema checks


@query(
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN source IS NULL THEN 'source:required' END, CASE WHEN NOT lang IN ('en', 'de', 'fr') THEN 'lang:enum' END, CASE WHEN n_chars < 50 THEN 'n_chars:minimum' END, CASE WHEN n_chars > 20000 THEN 'n_chars:maximum' END, CASE WHEN length(text) < 100 THEN 'text:minLength' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents"""
)
def e20_schema_errors(spark, sf_dir):
    schema = {"source": {"required": True}, "lang": {"enum": ["en", "de", "fr"]}, "n_chars": {"minimum": 50, "maximum": 20000}, "text": {"minLength": 100}}
    return extract.checked(table(spark, sf_dir, "documents"), schema).select("doc_id", F.array_join("errors", ",").alias("errors"))


# Relational coverage

_PRICE = F"l_extendedprice * (1 - l_discount)"


@query(f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum({_PRICE}), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.expr(_PRICE)), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n")
    )


@query(f"SELECT n_name, round(sum({_PRICE}), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.sum(F.expr(_PRICE)).alias("r")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))
