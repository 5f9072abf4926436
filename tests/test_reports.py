"""Style, versions, facts and structure against plain versions on small texts."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import compare, corpus, edit, extract, ranking, reports, sentences, style
from scriptorium.operators.scoring import Lexicon
from scriptorium.plans import catalogue
from scriptorium.sources import files

HUMAN = [
    "We ran it twice.", "Why did it fail?", "I'd say the disk (an old one) was full - so we lost a day!", "But you can't blame me, can you?", "And it's fixed now - mostly, I think!", "So I moved our logs (all of them)!", "Hey, don't ask!", "My bad!",
]
MADE = [
    "Moreover, we utilize a myriad of methods that facilitate robust outcomes for all of the relevant stakeholders in the field today.", "Furthermore, the framework is designed to foster a myriad of solutions across many different domains.",
    "In conclusion, these results are considered to leverage various approaches that empower every team.",
]
LEXICON = Lexicon(phrases=("a myriad of", "in conclusion"), starters=("moreover", "furthermore", "in conclusion"), hedges=("perhaps",), quantifiers=("various",), indicators=("mostly", "i think"))


def test_sentence_scores_tell_voices_apart(spark):
    rows = spark.createDataFrame([("h", x) for x in HUMAN] + [("m", x) for x in MADE], "k string, part string")
    mean = {r["k"]: r["s"] for r in rows.withColumn("s", sentences.score(F.col("part"), LEXICON)).groupBy("k").agg(F.avg("s").alias("s")).collect()}
    assert mean["h"] >= mean["m"] + 15 and mean["m"] < 20


def test_arabic_sentences_have_lists_of_their_own(spark):
    lexicon = Lexicon(phrases=("a",), arabic_phrases=("في النهاية",), arabic_transitions=("ثم",), arabic_indicators=("أنا",))
    rows = spark.createDataFrame([("في النهاية ثم a",), ("أنا هنا",)], "part string")
    assert [r["s"] for r in rows.select(sentences.score(F.col("part"), lexicon).alias("s")).collect()] == [8.0, 40.0]


def plain_fidelity(a, b):
    """The parts of a fidelity score with plain counters."""
    def tokens(t):
        return [x for x in re.findall(r"[^\W_]+", re.sub("[’']", "", t.lower())) if len(x) > 2 and x not in compare.STOPWORDS]

    def cosine(p, q):
        m, n = Counter(p), Counter(q)
        whole = math.sqrt(sum(v * v for v in m.values()) * sum(v * v for v in n.values()))
        return sum(v * n[k] for k, v in m.items()) / whole if whole else 0.0

    def share(p, q):
        return sum(x in q for x in p) / len(p) if p else 1.0

    def near(x, y):
        return min(x, y) / max(x, y) if max(x, y) else 1.0

    x, y = tokens(a), tokens(b)
    keywords = sorted(Counter(x).items(), key=lambda c: (-c[1], -len(c[0]), c[0]))[:24]
    numbers = lambda t: re.findall(r"[-+]?\d+(?:[.,:]\d+)*(?:%|x|×)?", t)
    negations = lambda t: sum(w in compare.NEGATIONS for w in tokens(t))
    return {
        "unigram": cosine(x, y), "bigram": cosine(list(zip(x, x[1:])), list(zip(y, y[1:]))), "keywords": share([k for k, _ in keywords], set(y)), "length": near(max(1, len(a.split())), max(1, len(b.split()))),
        "numbers": share(numbers(a), set(numbers(b))), "negation": near(negations(a), negations(b)),
    }


def test_fidelity_matches_plain_counters(spark):
    pairs = [("The model was not trained on 45 samples, it isn't fast.", "The model was trained on 54 samples and it is fast."), ("Alpha beta gamma delta 3.5% 2x", "Alpha gamma 3.5% 2x beta"), ("", ""), ("none without cannot", "never ever")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, original string, rewritten string")
    for r in compare.fidelity(rows).collect():
        for k, v in plain_fidelity(*pairs[r["id"]]).items():
            assert r[k] == pytest.approx(v, abs=1e-8), (r["id"], k)


def test_facts_are_all_found_and_checked(spark):
    many = " ".join(f"{i}.5%" for i in range(10_000))
    found = extract.scan_facts(many)
    assert sum(kind == "percentage" for kind, *_ in found) == 10_000
    assert reports.kept_fact("12.5 ms", "it took 12.5ms, some ms") is False or reports.kept_fact("12.5 ms", "it took 12.5 ms")
    assert reports.kept_fact("accuracy of 92.5%", "92.5 is the accuracy") and not reports.kept_fact("accuracy of 92.5%", "the accuracy is 93")
    rows = spark.createDataFrame([("We got 92.5% accuracy with n = 40.", "We got 92.5% accuracy."), ("No facts here", "none"), (None, None)], "original string, rewritten string")
    out = reports.facts_kept(rows).collect()
    assert out[0]["lost_facts"] and not out[0]["facts_passed"] and out[1]["facts_passed"] and out[1]["fact_score"] == 1.0 and out[2]["n_facts"] == 0


def test_structure_names_misplaced_sections(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(["introduction", "abstract", "results", "unknown", "results", "methodology"])], "doc_id int, position int, kind string").withColumn("t", F.lit("some words of a section\n\nand a second paragraph of seven words"))
    r = reports.structure(rows, F.col("t")).first()
    assert r["missing"] == ["conclusion"] and r["order_issues"] == ["1:abstract/introduction", "2:introduction/abstract", "3:methodology/results", "4:results/methodology"] and not r["in_order"]
    assert r["n_paragraphs"] == 6 and r["short_paragraphs"] == 6


def test_section_kinds_follow_the_first_rule(spark):
    titles = {"1. Related Work": "related_work", "IV. Background": "related_work", "Experimental Setup": "experiments", "Limitations": "unknown", "Results and Discussion": "results", "Acknowledgment": "acknowledgments"}
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r["t"]: r["k"] for r in rows.select("t", extract.section_kind(F.col("t")).alias("k")).collect()} == titles


def test_masks_hold_spans_in_spans():
    text = "> a `b` [c](http://d.e)\n__PROTECT_9__ #x `y`"
    masked, kept = extract.masked(text, extract.MARKDOWN_REGIONS, extract.MARKDOWN_PLACEHOLDER)
    assert extract.unmasked(masked, kept, extract.MARKDOWN_PLACEHOLDER) == text and len(kept) == 3


def test_grammar_notes_each_issue_once():
    text, found = edit.corrected("i think i am here ,ok. Beofre it are late")
    assert text == "I think I am here, ok. Before it is late." and found.count("grammar: i > I") == 1 and "spelling: Beofre > Before" in found
    assert edit.corrected("") == ("", [])


def test_voices_need_three_to_ten_samples(spark):
    rows = [("a", i, f"One {i}. Two, three!") for i in range(3)] + [("b", i, "x") for i in range(2)] + [("c", i, "x") for i in range(11)] + [("d", 1, None), ("d", 2, ""), ("d", 3, "y.")] + [(None, i, "z") for i in range(5)]
    found = {r["p"]: r for r in style.voice_profiles(spark.createDataFrame(rows, "p string, doc_id int, text string"), "p").collect()}
    assert set(found) == {"a", "d"} and found["a"]["n_sentences"] == 6 and found["a"]["samples"] == 3 and found["d"]["n_words"] == 1


def test_ranks_and_running_sums_over_many_partitions(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, (i * 37) % 101, i) for i in range(300)], "g int, x int, i int").repartition(7)
    want = {}
    for g in (0, 1, 2, None):
        own = sorted((r["x"], r["i"]) for r in rows.collect() if r["g"] == g)
        total = 0
        for k, (x, i) in enumerate(own):
            want[i] = (k, len(own), total)
            total += x
    found = ranking.ranked(rows, [F.col("x"), F.col("i")], "r", "n", by=["g"], total="x", running="s").collect()
    assert {r["i"]: (r["r"], r["n"], r["s"]) for r in found} == want


def test_versions_by_their_place(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (1,), (2,), (2,)], "k int")
    a = files.snapshot(rows, str(tmp_path / "v"), "v9", "k").first()
    b = files.snapshot(rows.filter("k = 1"), str(tmp_path / "v"), "v10", "k").first()
    assert a["fingerprint"] not in ("0", b["fingerprint"]) and b["place"] == 2
    files.snapshot(rows, str(tmp_path / "v"), "v9", "k")
    assert files.current(spark, str(tmp_path / "v")).count() == 4
    files.make_folder(spark, str(tmp_path / "x"))
    files.copy(spark, str(tmp_path / "v"), str(tmp_path / "x" / "v"))
    assert files.exists(spark, str(tmp_path / "x" / "v" / "_manifest")) and files.names_in(spark, str(tmp_path), "v") == [""]


def test_configuration_layers():
    env = {"APP_SCORING__LEAST": "5", "APP_ON": "true", "OTHER": "1"}
    assert files.merged_config({"scoring": {"least": 1, "most": 9}}, files.environment_layer("APP", env)) == {"scoring": {"least": 5, "most": 9}, "on": True}
    assert X.stage_range("1-3, 7,2") == [1, 2, 3, 7] and X.stage_range("") == []


@pytest.mark.parametrize(("patterns", "form"), [(list(compare.PROTECTED.values()), extract.PLACEHOLDER), (extract.MARKUP_REGIONS, extract.MARKUP_PLACEHOLDER), (extract.MARKDOWN_REGIONS, extract.MARKDOWN_PLACEHOLDER)])
def test_texts_with_placeholders_of_their_own_come_back(patterns, form):
    own, start = form.format(0), form.partition("{}")[0]
    for text in (own, f"{own} `x` {form.format(1)}", f"`{own}`", f"{start}1`x`", f"{start}{start}0 $y$ {own}", f"{own[:-1]}\\cite{{a}}{own}", f"`x`{own[2:]} me@x.org{own}", f"@{own} #{own} {own}@x.org", f"{start}{'9' * 5000}{own} `{start}`"):
        hidden, kept = extract.masked(text, patterns, form)
        assert extract.unmasked(hidden, kept, form) == text


def test_markdown_regions_at_ends_of_texts_and_with_placeholders(spark, tmp_path):
    texts = ["write to me@x.org", "`a", "x __PROTECT_0__ `b`", "`__PROTECT_0__`", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["text"], r["masked"]) for r in catalogue.QUERIES["p12_markdown_regions"](spark, str(tmp_path)).collect()}
    sentence, hidden = " `a_b` see [x](http://a.b/c) and https://d.e/f. Ask me@x.org, @you #tag1", " __ see __ and __. Ask __, __ __"
    assert found == {i: (None, None) if t is None else (t + sentence, (t + hidden)[-33:]) for i, t in enumerate(texts)}


def test_cached_answers(spark):
    entries = spark.createDataFrame([(1, [1.0, 0.0], "a", 10), (2, [1.0, 0.01], "a", 10), (3, [1.0, 0.0], "b", 10), (4, [1.0, 0.0], "a", 1)], "id int, v array<double>, o string, expires int")
    asked = spark.createDataFrame([(9, [1.0, 0.0], "a"), (8, [0.0, 1.0], "a")], "id int, v array<double>, o string")
    assert [tuple(r) for r in compare.cached_answers(asked, entries, "id", "v", ["o"], F.lit(5)).collect()] == [(9, 1, 1.0)]


def test_cached_answers_of_copies_and_ties_without_a_join_of_pairs(spark):
    rows = [(i, [[1.0, 0.0, 0.5], [1.0, 0.25, 0.5], [-1.0, 3.0, 0.0], [0.0, 0.0, 0.0]][i // 3 % 4], i % 2, 10 - i % 7) for i in range(60)]
    rows += [(60, None, 0, 9), (61, [1.0, None, 0.5], 1, 9), (62, [1.0, 0.0], 0, 9), (63, [2.0, 0.0, 1.0], None, 9), (64, [float("nan"), 0.0, 1.0], 0, 9)]
    vectors = spark.createDataFrame(rows, "id bigint, v array<float>, o int, expires int")
    found = compare.cached_answers(vectors.drop("expires"), vectors, "id", "v", ["o"], F.lit(5), 0.9, block=7, chunk=16)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()

    def like(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        norms = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
        return round(dot(a, b) / norms, 9) if norms else 0.0

    sound = [r for r in rows if r[1] and None not in r[1] and r[1][0] == r[1][0] and r[2] is not None]
    want = {}
    for i, a, o, _ in sound:
        near = [(-s, j) for j, b, p, expires in sound if j != i and p == o and len(a) == len(b) and expires > 5 and (s := like(a, b)) >= 0.9]
        if near:
            want[i] = (min(near)[1], -min(near)[0])
    assert {r["query"]: (r["entry"], r["similarity"]) for r in found.collect()} == want and len(want) > 40


def test_taken_records_skip_what_was_seen(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (3, 1), (4, 9)], "id int, n int")
    seen = spark.createDataFrame([(2,)], "id int")
    assert [r["id"] for r in corpus.taken_records(rows, seen, {"small": F.col("n") > 3}, "id", [F.col("id")], 5).collect()] == [1, 4]


def test_attribution_of_empty_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "It was used. Perhaps (as said) so!")], "doc_id int, text string")
    found = {r["doc_id"]: r for r in style.attribution_features(rows, ("so",)).collect()}
    assert found[1]["sentence_length"] == 0 and found[3]["passive"] == 0.5 and found[3]["hedging"] > 0 and found[3]["phrases"] > 0


def test_losses_fall(spark):
    from scriptorium.operators import training
    from scriptorium.operators.scoring import VECTOR

    rows = spark.createDataFrame([(i, float(i % 2), *[float((i * k + i % 2 * 3) % 5) for k in range(len(VECTOR))]) for i in range(60)], ["doc_id", "label", *VECTOR])
    found = [r["loss"] for r in training.losses(rows).orderBy("iteration").collect()]
    assert len(found) > 1 and found[-1] < found[0]


def test_command_line(spark, tmp_path, capsys):
    import json

    from scriptorium.__main__ import main

    (tmp_path / "l.json").write_text('{"phrases": ["a myriad of"]}')
    assert main(["--text", " ".join(HUMAN), "--json", "--lexicon", str(tmp_path / "l.json")]) == 0
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert found["n_sentences"] > 5 and 0 <= found["human_score"] <= 106
    (tmp_path / "t.txt").write_text("One. Two.")
    assert main(["--file", str(tmp_path / "t.txt")]) == 0 and "human_score: " in capsys.readouterr().out
