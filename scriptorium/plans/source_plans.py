"""Queries that write tables or files and read them back, and lookups in tables that stand in for services."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import arrays as A
from scriptorium.functions import segment as S
from scriptorium.functions import text as X
from scriptorium.operators import compare, corpus, edit, profiles, ranking, training
from scriptorium.plans.corpora import _DOT, _NORM
from scriptorium.plans.documents import table
from scriptorium.sources import files
from scriptorium.streaming import streams
from scriptorium.work import WorkFolder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT doc_id, text, lang, n_chars FROM documents")
def s3_s8_json_lines(spark, sf_dir):
    """Written as JSON lines, the second half appended, and read by schema."""
    path = f"{WorkFolder(spark, 'lines').path}/documents"
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    files.write_json_lines(rows.filter("doc_id % 2 = 0"), path)
    files.write_json_lines(rows.filter("doc_id % 2 = 1"), path, append=True)
    return files.read_json_lines(spark, path, rows.schema)


@query("SELECT upper(lang) AS text, count(*) AS n FROM documents GROUP BY lang")
def s2_text_lines(spark, sf_dir):
    path = f"{WorkFolder(spark, 'texts').path}/langs"
    files.write_texts(table(spark, sf_dir, "documents").select(F.upper("lang").alias("text")), path)
    return spark.read.text(path).groupBy(F.col("value").alias("text")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0")
def s10_s11_current_version(spark, sf_dir):
    """Version v9, then v10, then v9 again with other rows: the manifest's last one is current."""
    path = f"{WorkFolder(spark, 'versions').path}/documents"
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    for version, part in (("v9", "doc_id % 2 = 0"), ("v10", "doc_id % 2 = 1"), ("v9", "doc_id % 3 <> 0")):
        files.snapshot(rows.filter(part), path, version, "doc_id")
    return files.current(spark, path)


@query("SELECT doc_id, regexp_replace(text, '[^ -~\\n]', '?', 'g') AS text FROM documents")
def s14_s28_docx(spark, sf_dir):
    """Texts as DOCX files, read back."""
    plain = F.regexp_replace("text", r"[^ -~\n]", "?")
    return table(spark, sf_dir, "documents").select("doc_id", files.from_docx(files.to_docx(plain)).alias("text"))


@query("SELECT doc_id, '# ' || source || chr(10) || chr(10) || '- lang: ' || coalesce(lang, '-') || chr(10) || '- n_chars: ' || n_chars || chr(10) || chr(10) || text || chr(10) AS page FROM documents")
def s28_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", files.to_markdown(F.col("source"), F.col("text"), {"lang": F.col("lang"), "n_chars": F.col("n_chars")}).alias("page"))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND length(text) >= 200 THEN text WHEN length(coalesce(html, '')) >= 300 THEN html WHEN length(text) + 8 >= 200 THEN 'inline: ' || text END AS text, CASE WHEN doc_id % 3 = 0 AND length(text) >= 200 THEN 'local' WHEN length(coalesce(html, '')) >= 200 THEN 'url' WHEN length(text) + 8 >= 200 THEN 'inline' END AS source_kind "
    "FROM documents LEFT JOIN pages ON doc_id = page_id".replace("300", "200")
)
def s16_fallbacks(spark, sf_dir):
    """Local text, else the fetched page, else the inline text, each of 200 characters or more."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html"), "doc_id", "left")
    found = files.first_text({"local": F.when(F.col("doc_id") % 3 == 0, F.col("text")), "url": F.col("html"), "inline": F.concat(F.lit("inline: "), "text")}, 200)
    return docs.select("doc_id", found["text"].alias("text"), found["source_kind"].alias("source_kind"))


@query("SELECT doc_id, source FROM documents d WHERE n_chars >= 500 AND lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 40")
def s21_taken(spark, sf_dir):
    docs, seen = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    checks = {"short": F.col("n_chars") >= 500, "language": F.col("lang") == "en"}
    return corpus.taken_records(docs.unionByName(docs), seen, checks, "doc_id", [F.col("doc_id")], 40).select("doc_id", "source")


@query(
    "WITH w AS (SELECT 'doi:10.1/' || doc_id AS key, min(n_chars) AS year, min(source) AS venue FROM documents WHERE doc_id % 3 = 0 GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'doi:10.1/' || doc_id ELSE 'title:t|' END AS key, year, venue, w.key IS NOT NULL AS found FROM documents d LEFT JOIN w ON w.key = CASE WHEN doc_id % 2 = 0 THEN 'doi:10.1/' || doc_id ELSE 'title:t|' END"
)
def s22_looked_up(spark, sf_dir):
    """Citations by DOI, or else title, against a table of known works."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    doi = F.concat(F.lit("https://doi.org/10.1/"), i.cast("string"))
    works = docs.filter("doc_id % 3 = 0").select(X.identity_key(doi, F.lit("t"), F.lit(None)).alias("key"), F.col("n_chars").alias("year"), F.col("source").alias("venue"))
    rows = docs.select("doc_id", X.identity_key(F.when(i % 2 == 0, doi), F.lit("T!"), F.lit(None).cast("int")).alias("key"))
    return corpus.looked_up(rows, works, "key", ["year", "venue"])


_WORDS29 = ("stone", "river", "moon", "light")


@query("SELECT count(*) AS n, 40 AS words, true AS same, true AS known FROM range(500)")
def s29_mock_corpus(spark, sf_dir):
    """Made twice: as many documents as asked for, the same ones, of the given words alone."""
    one, two = (files.mock_corpus(spark, 500, _WORDS29, 7).withColumnRenamed("text", f"t{k}") for k in (1, 2))
    words = S.blank_words(F.regexp_replace("t1", r"\.$", ""))
    known = F.forall(words, lambda w: F.array_contains(A.literal(_WORDS29), w))
    return one.join(two, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(words)).alias("words"), F.bool_and(F.col("t1") == F.col("t2")).alias("same"), F.bool_and(known).alias("known"))


_EASY = ("the", "of", "and", "to", "in")


@query(
    "WITH p AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w, greatest(len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')), lambda s: s <> '')), 1) AS s FROM documents), "
    f"h AS (SELECT *, 100.0::DOUBLE * len(list_filter(w, lambda x: NOT list_contains({list(_EASY)}, x))) / len(w) AS hard FROM p) SELECT doc_id, CASE WHEN len(w) > 0 THEN round(0.1579 * hard + 0.0496 * (len(w)::DOUBLE / s) + CASE WHEN hard > 5 THEN 3.6365 ELSE 0.0 END, 10) ELSE 0.0 END AS dale_chall FROM h"
)
def x17_dale_chall(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", X.dale_chall(words, S.sentence_count(F.col("text")), A.literal(_EASY)).alias("dale_chall"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, CASE event_type WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' ELSE 'o' END AS short FROM events")
def x23_x25_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(k) for k, c in X.stamped(F.col("ts")).items()), X.mapped_value(F.col("event_type"), {"click": "c", "purchase": "p"}, "o").alias("short"))


@query(
    "WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), s AS (SELECT vec_id, list_sum(list_transform(list_zip(x, y), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(x, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform(y, lambda z: z::DOUBLE * z::DOUBLE)))) AS c FROM p) "
    "SELECT vec_id, round(0.6 * c + 0.4 * c, 9) AS similarity, round(0.6 * c + 0.4 * c, 9) >= 0.85 AS passed FROM s"
)
def e6_semantic(spark, sf_dir):
    """Each vector against the next one, as both kinds of similarity."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    like = X.cosine(F.col("x"), F.col("y"))
    return compare.semantic(pairs, like, like).select("vec_id", "similarity", "passed")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY lang, source, n_chars DESC, doc_id) - 1 AS BIGINT) AS place FROM documents")
def o1_places(spark, sf_dir):
    """O1: places in an order of several keys, without a task that sorts all rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return ranking.ranked(rows, [F.col("lang").asc_nulls_last(), F.col("source").asc_nulls_last(), F.desc("n_chars"), F.col("doc_id")], "place").select("doc_id", "place")


_A, _B = "list_distinct(regexp_extract_all(lower(substr(text, 1, 200)), '[a-z]{4,}'))", "list_distinct(regexp_extract_all(lower(right(text, 200)), '[a-z]{4,}'))"


@query(f"WITH d AS (SELECT doc_id, {_A} AS a, {_B} AS b FROM documents) SELECT doc_id, len(list_distinct(list_concat(a, b))) AS n_union, len(list_filter(a, lambda x: list_contains(b, x))) AS n_common, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_lost, len(list_filter(a, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(a, x))) AS n_differing FROM d")
def u2_set_operations(spark, sf_dir):
    """Words at a text's start against words at its end."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z]{4,}"), F.lit(0)))
    rows = table(spark, sf_dir, "documents").select("doc_id", words(F.substring("text", 1, 200)).alias("a"), words(F.right("text", F.lit(200))).alias("b"))
    a, b = F.col("a"), F.col("b")
    counts = {"n_union": F.array_union(a, b), "n_common": F.array_intersect(a, b), "n_lost": F.array_except(a, b)}
    return rows.select("doc_id", *(F.size(c).cast("bigint").alias(k) for k, c in counts.items()), (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).cast("bigint").alias("n_differing"))


@query("SELECT 'document' AS kind, doc_id AS id, lang AS name FROM documents UNION ALL SELECT 'page', page_id, url FROM pages UNION ALL SELECT 'item', item_id, NULL FROM benchmark")
def u1_union(spark, sf_dir):
    docs, pages, items = (table(spark, sf_dir, t) for t in ("documents", "pages", "benchmark"))
    one = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("lang").alias("name"))
    two = pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("name"))
    return one.unionByName(two).unionByName(items.select(F.lit("item").alias("kind"), F.col("item_id").alias("id")), allowMissingColumns=True)


_TIDY = ((r"[ \t]*—[ \t]*", ", "), ("–", "-"), (r"[ \t]{2,}", " "), (r"[ \t]+([,.;:!?])", r"\1"), (r",\s*,", ","))


def _tidy_sql(text: str) -> str:
    for pattern, by in _TIDY:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return f"trim({text})"


_DASHED = "text || ' a — b –  c , d,, e  . '"


@query(f"SELECT doc_id, {_tidy_sql(_DASHED)} AS text FROM documents")
def r2_tidied(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", edit.tidy(F.concat("text", F.lit(" a — b –  c , d,, e  . "))).alias("text"))


_SHORT = (("can't", "cannot"), ("won't", "will not"), ("it's", "it is"))


def _short_sql() -> str:
    text, n = "text || ' It''s here, we can''t and won''t.'", "0"
    for a, b in _SHORT:
        p = f"(?i)\\b{a}\\b".replace("'", "''")
        n, text = f"{n} + len(regexp_extract_all({text}, '{p}'))", f"regexp_replace({text}, '{p}', '{b}', 'g')"
    return f"SELECT doc_id, {text} AS text, CAST({n} AS BIGINT) AS n_changes FROM documents"


@query(_short_sql())
def r6_expanded(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" It's here, we can't and won't.")).alias("text"))
    return edit.replaced(rows, _SHORT, "text", "doc_id")


@query(
    f"WITH v AS (SELECT vec_id, embedding, label FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS entry, round({_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}), 9) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND b.vec_id % 10 > 5) "
    "SELECT query, entry, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, entry) AS n FROM p WHERE similarity >= 0.3) WHERE n = 1"
)
def j7_cached(spark, sf_dir):
    """Every 20th vector against the unexpired ones with its label."""
    vectors = table(spark, sf_dir, "embeddings")
    entries = vectors.withColumn("expires", F.col("vec_id") % 10)
    return compare.cached_answers(vectors.filter("vec_id % 20 = 0"), entries, "vec_id", "embedding", ["label"], F.lit(5), 0.3)


@query("SELECT run, sha256('{\"bias\": ' || bias || '}') AS digest, '{\"f1\": ' || f1 || '}' AS metrics FROM (VALUES ('one', '0.5', '0.75'), ('two', '-1.25', '0.5')) t(run, bias, f1)")
def m9_lineage(spark, sf_dir):
    """Two runs appended to one log, and read again."""
    path = f"{WorkFolder(spark, 'lineage').path}/runs"
    none = spark.createDataFrame([], "x int")
    for run, bias, f1 in (("one", 0.5, 0.75), ("two", -1.25, 0.5)):
        training.append_lineage(none, path, {"bias": bias}, {"f1": f1}, run)
    return spark.read.json(path).select(F.col("at").alias("run"), "digest", "metrics")


# Single functions


_FOUR = "regexp_extract_all({}, '[A-Za-z]{{4,}}')"
_WANTED, _FOUND = _FOUR.format("substr(text, 1, 150)"), _FOUR.format("right(text, 400)")


@query(f"SELECT doc_id, round(CASE WHEN len({_WANTED}) = 0 THEN 1.0 ELSE len(list_filter({_WANTED}, lambda x: list_contains(list_transform({_FOUND}, lambda y: lower(y)), lower(x))))::DOUBLE / len({_WANTED}) END, 9) AS recall FROM documents")
def x12_recall(spark, sf_dir):
    words = lambda t: F.regexp_extract_all(t, F.lit("[A-Za-z]{4,}"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.recall(words(F.substring("text", 1, 150)), words(F.right("text", F.lit(400)))), 9).alias("recall"))


_FIRST = "regexp_extract(text, '[A-Za-z]+', 0)"


@query(f"SELECT doc_id, CASE WHEN {_FIRST} = upper({_FIRST}) AND length({_FIRST}) > 1 THEN 'WORD' WHEN substr({_FIRST}, 1, 1) = upper(substr({_FIRST}, 1, 1)) THEN 'Word' ELSE 'word' END AS word FROM documents WHERE regexp_matches(text, '[A-Za-z]')")
def x22_case(spark, sf_dir):
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike("[A-Za-z]")).select("doc_id", X.preserve_case(word, F.lit("word")).alias("word"))


_MARK = "regexp_extract(trim(text), '([.!?]+)$', 1)"


@query(f"SELECT doc_id, upper(lang[1]) || lang[2:] || CASE WHEN {_MARK} = '' THEN '.' ELSE {_MARK} END AS text FROM documents WHERE lang IS NOT NULL")
def x27_endings(spark, sf_dir):
    """A word with the capital and the mark of a sentence."""
    rows = table(spark, sf_dir, "documents").filter(F.col("lang").isNotNull())
    return rows.select("doc_id", X.with_ending(X.capitalized(F.concat("lang", F.lit("?!"))), F.col("text")).alias("text"))


_PROFILE = "SELECT round(avg(n_chars), 6) AS length, CAST(count(*) AS DOUBLE) AS documents, CAST(min(n_chars) AS DOUBLE) AS shortest FROM documents WHERE lang = '{}'"


@query(f"WITH a AS ({_PROFILE.format('en')}), b AS ({_PROFILE.format('de')}) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, a.{c} AS first, b.{c} AS second, round(abs(a.{c} - b.{c}), 6) AS distance FROM a, b" for c in ("length", "documents", "shortest")))
def d23_d38_differences(spark, sf_dir):
    """Two languages' profiles side by side."""
    docs = table(spark, sf_dir, "documents")
    one, two = (docs.filter(F.col("lang") == x).agg(F.round(F.avg("n_chars"), 6).alias("length"), F.count(F.lit(1)).cast("double").alias("documents"), F.min("n_chars").cast("double").alias("shortest")) for x in ("en", "de"))
    return profiles.profile_differences(one, two, ["length", "documents", "shortest"]).withColumn("distance", F.round("distance", 6))


_PATH = "'f' || doc_id || ['.pdf', '.docx', '.txt', '.exe'][doc_id % 4 + 1]"


@query(
    f"WITH f AS (SELECT {_PATH} AS path, doc_id, n_chars AS length FROM documents) SELECT path, length, array_to_string(list_filter([CASE WHEN length > 3000 THEN 'too_large' END, CASE WHEN length = 0 THEN 'empty' END, CASE WHEN doc_id % 4 = 3 THEN 'unknown_type' END, "
    "CASE WHEN doc_id % 4 = 0 AND doc_id % 3 > 0 OR doc_id % 4 = 1 THEN 'wrong_content' END], lambda x: x IS NOT NULL), ',') AS errors FROM f"
)
def s17_uploads(spark, sf_dir):
    """Files of four kinds: every third PDF has a PDF's start, no DOCX has a ZIP's."""
    i = F.col("doc_id")
    ending = F.get(F.array(*map(F.lit, (".pdf", ".docx", ".txt", ".exe"))), (i % 4).cast("int"))
    content = F.when((i % 4 == 0) & (i % 3 == 0), F.lit("%PDF-1.7")).otherwise(F.lit("plain"))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), i.cast("string"), ending).alias("path"), F.col("n_chars").alias("length"), content.cast("binary").alias("content"))
    return files.upload_errors(rows, 3000).withColumn("errors", F.array_join("errors", ","))


@query(
    "SELECT 'w' || doc_id AS id, CASE WHEN doc_id % 3 > 0 THEN '10.1/x' || doc_id END AS doi, source AS title, 'one two one' AS abstract, CAST(least(doc_id % 14, 10) AS INTEGER) AS n_authors, CASE WHEN doc_id % 14 > 0 THEN 'a0' END AS first_author, "
    "CASE WHEN doc_id % 2 = 0 THEN 'cc-by' ELSE 'gold' END AS license, true AS is_open_access, lang AS journal, CAST(2000 + doc_id % 9 AS INTEGER) AS year, CAST(0 AS INTEGER) AS cited_by FROM documents"
)
def s19_work_records(spark, sf_dir):
    i = F.col("doc_id")
    author = lambda k: F.struct(F.struct(F.concat(F.lit("a"), k.cast("string")).alias("display_name")).alias("author"))
    authors = F.when(i % 14 > 0, F.transform(F.sequence(F.lit(0), (i % 14).cast("int") - 1), author)).otherwise(F.array().cast("array<struct<author:struct<display_name:string>>>"))
    works = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("w"), i.cast("string")).alias("id"), F.when(i % 3 > 0, F.concat(F.lit("https://doi.org/10.1/X"), i.cast("string"))).alias("doi"), F.col("source").alias("title"),
        F.create_map(F.lit("two"), F.array(F.lit(1)), F.lit("one"), F.array(F.lit(2), F.lit(0))).alias("abstract_inverted_index"), authors.alias("authorships"),
        F.struct(F.lit(True).alias("is_oa"), F.lit("gold").alias("oa_status"), F.when(i % 2 == 0, "cc-by").alias("license")).alias("open_access"), F.struct(F.struct(F.col("lang").alias("display_name")).alias("source")).alias("primary_location"),
        (2000 + i % 9).cast("int").alias("publication_year"), F.lit(None).cast("int").alias("cited_by_count"),
    )
    return profiles.work_records(works).withColumn("n_authors", F.size("authors")).drop("authors")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, unnest(string_split(text, chr(10))[:-2]) AS frame FROM (SELECT doc_id, regexp_replace(text, '\\n+', chr(10), 'g') AS text FROM documents)")
def z6_frames(spark, sf_dir):
    """Texts as a stream of pieces whose lines are frames: all but what no mark ends."""
    path = f"{WorkFolder(spark, 'pieces').path}/rows"
    table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\n+", "\n\n").alias("text")).write.parquet(path)
    return streams.run_to_end(streams.frames(streams.read_table(spark, path), "doc_id", "text"), "append")
