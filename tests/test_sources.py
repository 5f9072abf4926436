import json
import zipfile

from pyspark.sql import functions as F

from scriptorium.operators import profiles
from scriptorium.sources import files, paged


def test_paged_source(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"results": [{"id": f"{k}-{i}", "title": f"t{i}", "more": 1} for i in range(2)]}))
    paged.register(spark)
    rows = spark.read.format("paged_json").option("path", str(tmp_path)).load()
    assert sorted(r["id"] for r in rows.collect()) == ["0-0", "0-1", "1-0", "1-1", "2-0", "2-1"]
    assert spark.read.format("paged_json").option("path", str(tmp_path)).option("most", "1").load().count() == 2


def test_work_records(spark):
    schema = """id string, doi string, title string, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>,
    open_access struct<is_oa:boolean,oa_status:string,license:string>, primary_location struct<source:struct<display_name:string>>, publication_year int, cited_by_count int"""
    work = ("w1", "https://doi.org/10.1/AB", "T", {"again": [1, 3], "once": [0], "and": [2]}, [((f"a{i}",),) for i in range(12)], (True, "gold", "cc-by"), (("J",),), 2020, None)
    row = profiles.work_records(spark.createDataFrame([work], schema)).first()
    assert row["abstract"] == "once again and again" and row["doi"] == "10.1/ab" and len(row["authors"]) == 10
    assert (row["license"], row["journal"], row["cited_by"], row["first_author"]) == ("cc-by", "J", 0, "a0")


def test_docx_and_uploads(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(b"no zip")
    found = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_docx(spark, str(tmp_path)).collect()}
    assert found == {"a.docx": "One\nTwo", "b.docx": None}
    uploads = files.upload_errors(spark.read.format("binaryFile").load(str(tmp_path)))
    assert {r["path"].rsplit("/", 1)[1]: r["errors"] for r in uploads.collect()} == {"a.docx": [], "b.docx": ["wrong_content"]}


def test_profile_differences(spark):
    a, b = spark.createDataFrame([(1.0, 2.0)], "x double, y double"), spark.createDataFrame([(1.5, 2.0)], "x double, y double")
    assert {r["feature"]: r["distance"] for r in profiles.profile_differences(a, b, ["x", "y"]).collect()} == {"x": 0.5, "y": 0.0}


def test_claims_keep_unknown_support(spark):
    docs = spark.createDataFrame([(1, r"We saw blue stars \cite{a,b}. No claim here.")], "doc_id int, source string")
    from scriptorium.operators.extract import CITE

    claims = profiles.claims(docs, "source", "doc_id", CITE)
    known = spark.createDataFrame([("a", "we saw blue stars cite")], "cite_key string, abstract string")
    found = {r["cite_key"]: r["supported"] for r in profiles.supported(claims, known).collect()}
    assert found == {"a": True, "b": None}


def test_parsers(spark):
    row = spark.range(1).select(profiles.first_json(F.lit('x {"a": {"b": 1}} y')).alias("j"), profiles.listed(F.lit("- one\n2) two\n\n")).alias("l"), profiles.listed(F.lit('["p", "q"]')).alias("m")).first()
    assert row["j"] == '{"a": {"b": 1}}' and row["l"] == ["one", "two"] and row["m"] == ["p", "q"]


def test_first_json_of_any_depth_and_with_braces_in_strings(spark):
    deep = '{"a": ' * 6 + "1" + "}" * 6
    cases = {f"x {deep} y": deep, 'r {"a": "}", "b": "\\"{"} {"c": 1}': '{"a": "}", "b": "\\"{"}', "see {x}\n```json\n{\"k\": 2}\n```": '{"k": 2}', "{not json} {}": None, "{": None, "none": None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    found = {r["t"]: r["j"] for r in rows.select("t", profiles.first_json(F.col("t")).alias("j")).collect()}
    assert found == cases
