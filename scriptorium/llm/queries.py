"""The queries op1 to op10 and pipeline, each over its whole table, and oracle SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import exact_dedup, language, media, mixing, ngram_join, pieces, quality, secrets, substrings, warc
from scriptorium.work import evenly


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return evenly(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def piece_model() -> str:
    """The model file of the public tokenizers package; other models are a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(table(spark, sf_dir, "documents"), piece_model())


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_secrets, op3_language, op4_media, op5_quality, op6_exact_dedup, op7_ngram_join, op8_pieces, op9_substrings, op10_mixing, pipeline)
}

#: Words of a text, as all contracts have them.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, url, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, url,
       CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g""",
    "op6_exact_dedup": f"""
WITH t AS (SELECT doc_id, {LOWERED} AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)""",
    "op7_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                               ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) END AS g FROM w),
     c AS (SELECT min(doc_id) AS doc_id, list_sort(g) AS g FROM s GROUP BY list_sort(g)),
     e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM c),
     links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
               GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
     reach AS (SELECT doc_id AS a, doc_id AS b FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
     comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE comp.component_id END AS component_id
FROM s JOIN c ON list_sort(s.g) = c.g JOIN comp ON comp.doc_id = c.doc_id""",
    "op9_substrings": f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
     t AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w),
     v AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS x FROM t),
     r AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM v),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM r WHERE first < doc_id),
     l AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, k: n IS NULL OR NOT list_contains(ks, k)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN l ON l.doc_id = w.doc_id""",
    "op10_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
     g AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
     s AS (SELECT source, CAST(n AS BIGINT) AS n, k, (k - 1) % 3 + 1 AS w FROM g),
     r AS (SELECT source, n, k, w, 0 AS round, false AS fixed,
                  CAST(sum(n) OVER () * w AS DOUBLE) / CAST(sum(w) OVER () AS DOUBLE) AS share FROM s
           UNION ALL
           SELECT source, n, k, w, round + 1, fixed OR share > 3 * n,
                  CASE WHEN fixed OR share > 3 * n THEN CAST(3 * n AS DOUBLE)
                       ELSE CAST((sum(n) OVER () - sum(CASE WHEN fixed OR share > 3 * n THEN 3 * n ELSE 0 END) OVER ()) * w AS DOUBLE)
                            / CAST(sum(CASE WHEN fixed OR share > 3 * n THEN 0 ELSE w END) OVER () AS DOUBLE) END
           FROM r WHERE round <= (SELECT count(*) FROM s)),
     p AS (SELECT source, n, share FROM r WHERE round = (SELECT count(*) FROM s)),
     o AS (SELECT d.doc_id, d.size, p.n, p.share, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS k,
                  CASE WHEN p.n > 0 THEN p.share / p.n ELSE 0.0 END AS rate,
                  CAST(('0x' || substr(md5(coalesce(d.source, '')), 1, 8)) AS BIGINT) / 4294967296.0 AS u
           FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
     c AS (SELECT *, CAST(least(floor((k + 1) * rate + u) - floor(k * rate + u), 3) AS BIGINT) AS copies FROM o)
SELECT doc_id, size, n AS source_size, share AS target, copies * size AS taken, copies FROM c""",
}
