"""Every query of the catalogue that has an oracle, against DuckDB on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

from scriptorium.plans import catalogue
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_its_oracle(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    relation = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in places) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_oracle_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_all_aligned_sentences_match_brute_force(spark, tmp_path):
    texts = ["One is here. On the way. Two", "A b.  C the d! E", "", "no end the x", "It is. the y. Z", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def parts(t):
        return [x for x in (y.strip(" \t\n\r\f") for y in re.split(r"(?<=[.!?])[ \t\n\r\f]+(?=[A-Z])", t)) if x]

    want = []
    for i, t in enumerate(texts):
        if t is not None:
            a, b = parts(t), parts(t.replace(" the ", " this ").replace(".", "," if i % 2 else "."))
            want += [(i, k, a[k] if k < len(a) else None, b[k] if k < len(b) else None) for k in range(max(len(a), len(b)))]
    found = catalogue.QUERIES["j3_aligned_sentences"](spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["pos"], r["before"], r["after"]) for r in found), key=str) == sorted(want, key=str)
    assert {0, 2, 4} & {r["doc_id"] for r in found}
