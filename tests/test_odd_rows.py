"""Queries with an oracle against DuckDB on rows without text, on control characters and on letters of odd rules."""

import time

import duckdb
import pytest

from scriptorium.plans import catalogue
from tests.test_catalogue import plain

#: U+0345 is a letter beside words sought without case; SQL marks its cuts by U+0001.
MARKED = ["We go. usͅ x. It is ͅour a. Andͅ b c.", "One is a\x01two was b. the\x01\x01 And c. d", "\x01", "a.\x01 B c. \x01D e"]


def differing(spark, folder, name, texts):
    """Rows that only the query has, and that only its SQL has."""
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found, wanted = catalogue.QUERIES[name](spark, str(folder)), con.sql(catalogue.ORACLE_SQL[name])
    mine = {tuple(plain(r[c]) for c in wanted.columns) for r in found.collect()}
    theirs = {tuple(map(plain, r)) for r in wanted.fetchall()}
    return mine - theirs, theirs - mine


@pytest.mark.parametrize("name", ["d12_d16_composite"])
def test_marks_and_control_characters_give_what_sql_gives(spark, tmp_path, name):
    assert differing(spark, tmp_path, name, MARKED) == (set(), set())


@pytest.mark.parametrize("name", ["d12_d16_composite", "d2_d11_dimensions", "f12_dimension_rows"])
def test_null_texts_give_what_sql_gives(spark, tmp_path, name):
    assert differing(spark, tmp_path, name, [None, "", "The a. The b", None]) == (set(), set())


@pytest.mark.parametrize("name", ["d29_radar", "d29_ensemble", "f5_slop"])
def test_slop_of_null_texts_and_dotted_capitals_gives_what_sql_gives(spark, tmp_path, name):
    assert differing(spark, tmp_path, name, ["wİth the wİth. And İt", None, "\n\n".join(["Onomatopoeia İİ ionia area idea oasis. A e i o u a e İ"] * 2)]) == (set(), set())


#: Letters newer than Unicode 15.0, a long s in an abbreviation, marks of SQL's cuts, a dotted capital I, a blank before a line separator.
ENSEMBLE = [
    *MARKED, "a՘b the c. d՘ e f", "mrſ. A b. vſ. c d. e", "A b.\x02 c. D\x01e\x02f. g h", "wİth the wİth. And İt", None,
    "\n\n".join(["abc def İf ghi jkl mnop qrs tu vw xy z. A b c", "a b c d e f g h i  ", "Onomatopoeia İİ ionia area idea oasis. A e i o u a e İ"]),
]


@pytest.mark.parametrize("name", ["d29_ensemble", "d29_radar"])
def test_odd_rows_of_the_ensemble_give_what_sql_gives(spark, tmp_path, name):
    assert differing(spark, tmp_path, name, ENSEMBLE) == (set(), set())


def test_long_blanks_between_triplets_take_little_time(spark, tmp_path):
    start = time.monotonic()
    assert differing(spark, tmp_path, "d32_triplets", ["a, b" + " " * 60_000 + x for x in ("c", "and c", ", and c", ",, and c")]) == (set(), set())
    assert time.monotonic() - start < 25
