"""The pipeline against a brute-force version of its stages, and its oracle-backed queries on the smallest tables."""

import hashlib
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import language, mixing, ngram_join, queries
from tests.conftest import DATA
from tests.test_catalogue import duck, plain  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_oracle(spark, duck, name):  # noqa: F811
    found = queries.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    relation = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in places) for r in relation.fetchall())


@pytest.fixture(scope="module")
def result(spark):
    return corpus_pipeline.run(spark, DATA).collect()


def test_run_matches_brute_force(spark, result):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    train = [r for r in rows if language.crc(r["doc_id"]) % 3 != 1 and r["lang"] and r["text"] is not None]
    import numpy as np
    import sentencepiece

    langs = sorted({r["lang"] for r in train})
    sums = language.bundle([r["text"] for r in train], np.array([langs.index(r["lang"]) for r in train]), len(langs), language.DIMENSIONS).astype(float)
    profiles = language.Profiles.of(dict(zip(langs, sums, strict=True)), language.DIMENSIONS)
    predicted, scores = profiles.predict([r["text"] or "" for r in rows])
    docs = [r for r, p, s in zip(rows, predicted, scores, strict=True) if p != "und" and s >= corpus_pipeline.LEAST_LIKENESS]
    last = {}
    for r in docs:
        key = (r["text"] or "").translate(LOWER)
        last[key] = max(last.get(key, r["doc_id"]), r["doc_id"])
    docs = [r for r in docs if last[(r["text"] or "").translate(LOWER)] == r["doc_id"]]

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {r["doc_id"]: shingles(r["text"]) for r in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = [r for r in docs if find(r["doc_id"]) == r["doc_id"]]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(spark.createDataFrame(docs, rows_schema(spark))).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    want = []
    for r in docs:
        own = model.encode(r["text"] or "", add_eos=True)
        want += [(r["doc_id"], len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(model.decode(own).encode()).hexdigest())] * copies[r["doc_id"]]
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result) == sorted(want)


def rows_schema(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").schema


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, DATA).count()
    assert kept >= 0.99 * docs.count()


def test_language_stage_keeps_all_labelled_and_short_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").select("doc_id")
    rows = docs.join(clean, "doc_id", "left_semi").select(docs.columns).collect()
    wanted = {r["doc_id"] for r in rows}
    short = [(10_000_000 + i, t, "es", "s", len(t)) for i, t in enumerate(["Osrañ.", "Osiebo | armici. |", "Von.", "That it.", "Osrañ. " * 50, "a"])]
    more = spark.createDataFrame(short, docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more), DATA).collect()}
    assert wanted and wanted | {r[0] for r in short} <= kept


def test_language_stage_rejects_what_was_not_learned(spark):
    rng = random.Random(5)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scripts = ["абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת", "كتابمرحبسلامعشقنور"]
    texts = [" ".join("".join(rng.choices(scripts[i % 4], k=rng.randrange(2, 9))) for _ in range(rng.randrange(12, 60))) for i in range(300)]
    other = spark.createDataFrame([(10_000_000 + i, t, None, "s", len(t)) for i, t in enumerate(texts)], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.unionByName(other), DATA)
    assert kept.filter("doc_id >= 10000000").count() == 0


def outcome(rows):
    return sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)


def test_a_shard_loaded_twice_changes_nothing(spark, result, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.union(docs).write.parquet(f"{tmp_path}/documents.parquet")
    assert outcome(corpus_pipeline.run(spark, str(tmp_path)).collect()) == outcome(result)


def test_rows_without_ids_are_told_apart(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bare = docs.filter("doc_id % 2 = 0").withColumn("doc_id", F.lit(None).cast("bigint"))
    bare.union(bare).union(docs.filter("doc_id % 2 = 1")).write.parquet(f"{tmp_path}/documents.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = given.select(lower.alias("t")).distinct().count()
    assert corpus_pipeline.exact_duplicates(spark, given, DATA).count() == texts
    components = ngram_join.jaccard_components(docs, length=5, percent=80).select("component_id").distinct().count()
    empty = docs.filter(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) == 0).count()
    assert not empty and corpus_pipeline.near_duplicates(spark, given, DATA).count() == components
    copies = mixing.mix_sources(given).agg(F.sum("copies")).first()[0]
    assert corpus_pipeline.source_mix(spark, given, DATA).count() == copies
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and max(Counter(r["ids_sha256"] for r in rows).values()) <= 3  # the most copies of a row


def clashing(docs):
    """Columns with names that the stages use inside."""
    return docs.withColumns({c: F.lit("clash") for c in ("_row", "row", "_times", "id", "key", "group", "best", "_kept", "_id", "_copy", "copies", "keep_id")})


def test_stages_take_clashing_names_nulls_and_repeats(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (7, " \t ", None, "s", 3), (7, "word " * 30_000, "en", None, 0), (7, "word " * 30_000, "en", None, 0)], docs.schema)
    rows = clashing(docs.unionByName(docs).unionByName(odd)).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, rows, DATA)
        assert found.dtypes == rows.dtypes, name
        kept = found.collect()
        assert kept and all(r["_row"] == "clash" for r in kept), name
    last = corpus_pipeline.piece_ids(spark, rows, DATA)
    assert last.count() == rows.count()
    exact = corpus_pipeline.exact_duplicates(spark, rows, DATA).collect()
    texts = [(r["text"] or "").translate(LOWER) for r in exact]
    assert len(texts) == len(set(texts))


def test_stages_take_an_empty_table(spark):
    none = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name
