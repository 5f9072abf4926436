"""Queries with an oracle against DuckDB on texts where libraries' rules for letters, case and rounding differ."""

import duckdb
import pytest

from scriptorium.plans import catalogue
from tests.test_catalogue import plain

TEXTS = [
    "Onthsh rent edble and therndha.",  # a score of 70.45: 100 less that is rounded up
    "One is here. So ßis given now.", "We go. It waſ walked. It is walſed. It is Ked.",  # words of ASCII letters end at others
    "éa, b and c. Ka, ſ, and K, d and e", "ü x1,y , and zß",
    "", " ", "a `b`", "me@x.org",
]
#: Lower case letter by letter, and letters that came after Unicode 15.0.
LETTERS = ["ΑΣ ΟΔΟΣ the. ΑΣ be. ΑΣ we. ΟΔΟΣ x", "İf İt is. İon the ing of İ. A b", "One 𮯰us Ɤ. Two Ᲊ we. Three 𮯰 x"]
#: Sentences of so many words, whose lengths deviate by 0.75 or by the number next to it, as one adds.
HALVES = " ".join("A" + " b" * (n - 1) + "." for n in (1, 2, 2, 3, 3, 2, 1, 3, 3, 1, 3, 2, 3, 2, 3, 2))


def differing(spark, folder, name, texts):
    """Rows that only the query has, and that only its SQL has."""
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found, wanted = catalogue.QUERIES[name](spark, str(folder)), con.sql(catalogue.ORACLE_SQL[name])
    mine = {tuple(plain(r[c]) for c in wanted.columns) for r in found.collect()}
    theirs = {tuple(map(plain, r)) for r in wanted.fetchall()}
    return mine - theirs, theirs - mine


@pytest.mark.parametrize("name", ["d12_d16_composite", "d29_ensemble", "d29_radar", "d2_d11_dimensions", "d32_triplets", "f12_dimension_rows", "p12_markdown_regions"])
def test_odd_texts_give_what_sql_gives(spark, tmp_path, name):
    assert differing(spark, tmp_path, name, TEXTS) == (set(), set())


@pytest.mark.parametrize("name", ["d12_d16_composite", "d2_d11_dimensions", "f12_dimension_rows"])
def test_letters_of_other_rules_give_what_sql_gives(spark, tmp_path, name):
    assert differing(spark, tmp_path, name, LETTERS) == (set(), set())


def test_deviations_at_a_half_give_what_sql_gives(spark, tmp_path):
    assert differing(spark, tmp_path, "d2_d11_dimensions", [HALVES]) == (set(), set())
