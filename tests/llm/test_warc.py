import hashlib
import zipfile

import pytest

from scriptorium.llm import warc
from scriptorium.llm.common import BlobReader, WorkFolder

BIG = "<p>" + "body é " * 400 + "</p>"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a/3", "small"), (4, "http://a/4", "small"), (5, None, None), (6, "http://a/ü?q=1\r\n2", ""), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 1000), (10, "u", "y" * 1000)]


def test_round_trip(spark):
    rows = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    found = {r["page_id"]: r for r in warc.archive_round_trip(rows).collect()}
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "").encode() == data]
        r = found[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        revisit = len(data) >= 1000 and i != max(same)
        assert (r["record_type"], r["refers_to"]) == (("revisit", max(same)) if revisit else ("response", None))
    assert len(found) == len(PAGES)
    assert {i: found[i]["url"] for i, *_ in PAGES} == {i: url for i, url, _ in PAGES}


def test_ids_and_urls_come_back_as_they_were(spark):
    odd = ["a b", "a%20b", "None", "", "ü>\r\n<", None, "x/y?z#é", "id="]
    rows = spark.createDataFrame([(x, x, BIG if k % 2 else f"small {k}") for k, x in enumerate(odd)], "page_id string, url string, html string")
    found = warc.archive_round_trip(rows).collect()
    assert sorted(map(str, (r["page_id"] for r in found))) == sorted(map(str, odd)) and sum(r["page_id"] is None for r in found) == 1
    assert all(r["page_id"] == r["url"] for r in found)
    big = max(x for k, x in enumerate(odd) if k % 2 and x is not None)
    assert all(r["refers_to"] == big for r in found if r["record_type"] == "revisit") and sum(r["record_type"] == "revisit" for r in found) == 3


def test_empty_table_and_odd_rows(spark):
    schema = "page_id bigint, url string, html string, record_type string, path string, _key string"
    assert warc.archive_round_trip(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "u", BIG, "x", "y", "z"), (1, "u", BIG, "x", "y", "z"), (1, "u", BIG, "x", "y", "z")]
    found = warc.archive_round_trip(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in found) == [(0, "revisit", 1), (1, "response", 0), (1, "response", 0)]


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(spark, tmp_path, zip64):
    work = WorkFolder(spark, "test-warc")
    writer = warc.PackageWriter(work.folder("p"), zip64)
    for i, url, html in PAGES:
        writer.add(warc.record("response", i, url, (html or "").encode()), i, url)
    writer.close()
    reader = BlobReader(writer.uri)
    members = warc.directory(reader)
    path = writer.uri.removeprefix("file://")
    with zipfile.ZipFile(path) as z:  # an independent reader agrees, extra fields and all
        assert z.testzip() is None
        assert {i.filename: (i.compress_type, i.file_size) for i in z.infolist()} == {k: (m.method, m.size) for k, m in members.items()}
    payloads = []
    for start, entries in warc.blocks(reader):
        for e in entries:
            payloads.append(warc.parse_record(reader.read(start, e["length"])).payload.decode())
            start += e["length"]
    assert payloads == [h or "" for _, _, h in PAGES]


def test_damage_is_noticed():
    member = warc.record("response", 1, "u", b"payload")
    assert warc.parse_record(member).payload == b"payload"
    with pytest.raises(Exception):
        warc.parse_record(member[:-3])
