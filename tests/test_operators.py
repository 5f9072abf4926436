import datetime as dt

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import compare, corpus, events, extract, scoring
from scriptorium.sources import files
from scriptorium.streaming import streams

LEXICON = scoring.Lexicon(cliches=("delve into", "a myriad of"), starters=("moreover",), hedges=("perhaps",), quantifiers=("various",), transitions=("moreover",), phrases=("delve into", "a myriad of", "in conclusion"))
AI = "Moreover, we delve into a myriad of things. " * 6
HUMAN = "We ran it twice. Why did it fail? The second disk (an old one) was full, so nothing was written and we lost a day. But the fix was easy. I moved the logs. It has worked since then, mostly."


def test_scores_are_ordered_and_bounded(spark):
    docs = spark.createDataFrame([(1, AI), (2, AI + HUMAN), (3, HUMAN), (4, ""), (5, None)], "doc_id int, text string")
    scores = scoring.dimensions(docs, LEXICON)
    rows = {r["doc_id"]: r for r in scores.collect()}
    for r in rows.values():
        assert all(0 <= r[n] <= 100 for n, _, _ in scoring.DIMENSIONS if r[n] is not None)
    total = {r["doc_id"]: r["human_score"] for r in scoring.composite(scores).collect()}
    assert total[1] < total[2] < total[3]


def test_polarity_turns_risk_around(spark):
    docs = spark.createDataFrame([(1, AI)], "doc_id int, text string")
    rows = {r["name"]: r for r in scoring.dimension_rows(scoring.dimensions(docs, LEXICON)).collect()}
    risk = rows["phrase_density"]
    assert risk["contribution"] == pytest.approx(100 - risk["score"])
    assert rows["vocab_diversity"]["contribution"] == pytest.approx(rows["vocab_diversity"]["score"])


def test_fidelity_flags_what_is_lost(spark):
    rows = spark.createDataFrame(
        [(1, "The model was not trained on 45 samples at https://x.org/a today.", "The model was trained on 54 samples today."), (2, "Results improved for all patients in Berlin.", "Results improved for all patients in Berlin.")],
        "id int, original string, rewritten string",
    )
    found = {r["id"]: r for r in compare.fidelity(rows).collect()}
    assert {"numbers", "negation", "urls"} <= set(found[1]["warnings"])
    assert found[2]["score"] >= 74 and found[2]["verdict"] == "preserved" and not found[2]["warnings"]


def test_integrity(spark):
    rows = spark.createDataFrame([(r"a \cite{x,y} $m$", r"a \cite{y} $m$")], "a string, b string")
    found = extract.integrity(rows, "a", "b").first()
    assert found["cites_lost"] == ["x"] and found["math_lost"] == [] and not found["valid"]


def test_tied_scores_share_the_area(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, probability double")
    assert corpus.auroc(rows).first()["auroc"] == pytest.approx(0.875)
    closed = rows.withColumn("prediction", F.lit(1)).withColumn("probability", F.lit(1.0))
    assert corpus.calibration(closed).first()["ece"] == pytest.approx(0.5)


def test_gates_count_unknown_as_failed(spark):
    rows = spark.createDataFrame([("a", None), ("b", 5)], "k string, n int")
    found = {r["k"]: r["failures"] for r in corpus.gates(rows, {"small": F.col("n") > 3}).collect()}
    assert found == {"a": ["small"], "b": []}


def test_keep_first_is_idempotent(spark):
    rows = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 3, "c")], "k string, id int, v string")
    once = corpus.keep_first(rows, ["k"], ["id"], ["id", "v"])
    assert {(r["k"], r["v"], r["n_duplicates"]) for r in once.collect()} == {("x", "a", 1), ("y", "c", 0)}
    assert corpus.keep_first(once, ["k"], ["id"], ["id", "v"]).agg(F.sum(F.col("n_duplicates").cast("int"))).first()[0] == 0


def test_rate_limit_window_starts_with_the_first_event(spark):
    start = dt.datetime(2024, 1, 1)
    times = [0, 10, 20, 59, 61, 70]
    rows = spark.createDataFrame([("a", i, start + dt.timedelta(seconds=t)) for i, t in enumerate(times)] + [("b", 9, start)], "key string, id int, ts timestamp")
    found = {(r["key"], r["id"]): (r["allowed"], r["remaining"]) for r in events.limited(rows, "key", "ts", "id", 2, 60_000).collect()}
    assert [found["a", i][0] for i in range(6)] == [True, True, False, False, True, True]
    assert found["b", 9] == (True, 1)


def test_streaming_rate_limit_and_frames(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("a", start + dt.timedelta(seconds=t)) for t in (0, 1, 2, 70)], "key string, ts timestamp").write.parquet(str(tmp_path / "e"))
    stream = streams.limited(streams.read_table(spark, str(tmp_path / "e")), "key", "ts", 2, 60_000)
    assert sorted(r["allowed"] for r in streams.run_to_end(stream, "append").collect()) == [False, True, True, True]
    spark.createDataFrame([("k", "one\n\ntwo\n\nthr")], "key string, text string").write.parquet(str(tmp_path / "f"))
    found = streams.run_to_end(streams.frames(streams.read_table(spark, str(tmp_path / "f")), "key", "text"), "append")
    assert [r["frame"] for r in found.collect()] == ["one", "two"]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tex").write_text("x\ny")
    assert files.read_texts(spark, str(tmp_path / "in")).first()["text"] == "x\ny"
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\nnonsense\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int", tolerant=True).collect()) == [1, 2]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    first = files.snapshot(rows, str(tmp_path / "t"), "v1", "id").first()
    second = files.snapshot(rows.orderBy(F.desc("id")), str(tmp_path / "t"), "v2", "id").first()
    assert first["fingerprint"] == second["fingerprint"] and files.current(spark, str(tmp_path / "t")).count() == 2


def test_first_text_names_its_source(spark):
    rows = spark.createDataFrame([(None, "long enough text", "x"), ("ab", None, None)], "a string, b string, c string")
    made = files.first_text({c: F.col(c) for c in "abc"}, 5)
    found = rows.select(*(v.alias(k) for k, v in made.items())).collect()
    assert found[0]["source_kind"] == "b" and found[0]["errors"][0] == "a:missing" and found[1]["status"] == "failed"
