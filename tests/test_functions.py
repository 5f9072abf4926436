import math

from pyspark.sql import functions as F

from scriptorium.functions import arrays as A
from scriptorium.functions import segment as S
from scriptorium.functions import text as X
from scriptorium.operators import edit, extract, measures, style
from scriptorium.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sentence_variants(spark):
    text = F.lit('Dr. Smith met A. Jones at 5.30 p.m. today. "Fine!" she said. No end')
    assert one(spark, S.sentences_before_capital(text))[-1] == "No end"
    assert one(spark, S.sentences_matched(F.lit("no end here"))) == ["no end here"]
    assert one(spark, S.sentences_matched(F.lit("One. Two! tail"))) == ["One. ", "Two! "]
    assert one(spark, S.sentences_naive(F.lit("a.b tail"))) == ["a.", "b tail"]
    assert one(spark, S.sentence_count(F.lit("..."))) == 1


CUT = ['Dr. Li saw node.js. It ran.', 'He said "go." Then left', "", "Wait... what?! 'No.' 1.2.3 x.5.", "See Fig. 2 (etc.) and vs. it. al.", 'Mr. "A." B', "e.g. this, i.e. that. final. Gen. end", "a.b.c d.\n\nMrs. X", "Ünal. é.è. Ok", "no! (yes.) \"q.\" [z.] end"]


def quoted(text, short, guard):
    """T3, T6 character by character."""
    out, held, i = [], "", 0
    while i < len(text):
        held += text[i]
        if text[i] in ".!?":
            near = lambda k: 0 <= k < len(text) and text[k].isascii() and text[k].isalnum()
            if not (guard and text[i] == "." and near(i - 1) and near(i + 1)) and not any(held.endswith(f"{w}.") or text[: i + 1].endswith(f"{w}.") for w in short):
                if i + 1 < len(text) and text[i + 1] in "\"'":
                    i += 1
                    held += text[i]
                out.append(held.strip())
                held = ""
        i += 1
    return [x for x in [*out, held.strip()] if x]


def test_quoted_splitters_match_a_walk_over_characters(spark):
    rows = spark.createDataFrame([(t,) for t in CUT], "t string")
    for split, short, guard in ((S.sentences_unified, S.UNIFIED_SHORT, True), (S.sentences_model, S.MODEL_SHORT, False)):
        found = {r["t"]: r["x"] for r in rows.select("t", split(F.col("t")).alias("x")).collect()}
        assert found == {t: quoted(t, short, guard) for t in CUT}
        assert found == {t: style.sentences_quoted(t, short, guard) for t in CUT}


def test_paper_splitter_keeps_abbreviations(spark):
    rows = spark.createDataFrame([(t,) for t in CUT], "t string")
    found = {r["t"]: r["x"] for r in rows.select("t", S.sentences_papers(F.col("t")).alias("x")).collect()}
    assert found == {t: measures.sentences_papers(t) for t in CUT}
    assert found[CUT[0]] == ["Dr. Li saw node.js.", "It ran."] and found[CUT[4]] == ["See Fig. 2 (etc.) and vs. it.", "al."] or found[CUT[4]][0].startswith("See Fig. 2 (etc.)")


def test_chunks_hold_all_words_and_their_bounds():
    text = "One two three. " * 40 + "x " * 30 + "\n\n" + "long line " * 70 + "\nshort\n\n\nEnd."
    for most in (7, 20, 1000):
        words, paragraphs = S.budget_chunks(text, most), S.paragraph_chunks(text, most)
        assert " ".join(words).split() == text.split() == " ".join(paragraphs).split()
        assert all(len(c.split()) <= most for c in (*words[:-1], *paragraphs))
    assert S.budget_chunks("a b. c d e f", 4) == ["a b. c d", "e f"] and S.budget_chunks("a b c. d e f", 4) == ["a b c.", "d e f"]
    assert S.budget_chunks("aaaa bbbb cc.dd e f g", 3) == ["aaaa bbbb cc.", "dd e f", "g"]
    assert S.sentence_chunks("Aa. Bb. Cc.", 8) == ["Aa. Bb.", "Cc."] and S.sentence_chunks("", 9) == [""]


def test_ngrams_of_short_arrays(spark):
    assert one(spark, S.ngrams(F.array(F.lit("a")), 2)) == []
    assert one(spark, S.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)) == ["a b", "b c"]


def test_packing_and_chunks():
    assert S.pack([3, 3, 3, 10, 1], 6) == [0, 0, 1, 2, 3]
    text = " ".join(["w"] * 6 + ["end."] + ["w"] * 6)
    assert [len(c.split()) for c in S.budget_chunks(text, 10)] == [7, 6]  # the mark is past the chunk's half
    assert " ".join(S.budget_chunks(text, 10)) == text


def test_words_are_unicode(spark):
    assert one(spark, S.words(F.lit("Élan vital_1"))) == ["élan", "vital_1"]


def test_statistics(spark):
    values = F.array(*map(F.lit, (2, 4, 4, 4, 5, 5, 7, 9)))
    assert one(spark, A.deviation(values)) == 2.0
    assert one(spark, A.deviation(F.array().cast("array<int>"))) == 0.0
    runs = one(spark, A.runs(F.array(*map(F.lit, "abcab"))))
    assert (runs["most"], runs["once"]) == (2, 1)


def test_similarities(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    none = F.array().cast("array<string>")
    assert math.isclose(one(spark, X.jaccard(a, b)), 1 / 3)
    assert one(spark, X.jaccard(none, none)) == 1.0
    assert math.isclose(one(spark, X.term_cosine(a, b)), 0.5)
    assert one(spark, X.recall(none, a)) == 1.0
    assert one(spark, X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_hashes(spark):
    assert one(spark, X.fnv1a(F.lit("a"))) == 0xE40C292C
    assert one(spark, X.hash31(F.lit("ab"))) == f"{ord('a') * 31 + ord('b'):08x}"


def test_syllables(spark):
    words = ["cat", "table", "reading", "idea"]
    assert [one(spark, X.syllables(F.lit(w))) for w in words] == [1, 2, 2, 2]


def test_blocks_tile_the_source():
    text = "A $$x$$ b \\begin{figure}f\\end{figure} c % note\nend"
    found = extract.scan_blocks(text)
    assert "".join(text[a:b] for _, _, a, b in found) == text
    assert [k for _, k, _, _ in found].count("figure") == 1


def test_masking_round_trip():
    text = "see https://x.org/a and `code` and a@b.org"
    hidden, kept = extract.masked(text, [r"https?://\S+", r"`[^`]+`", r"\S+@\S+"])
    assert "https" not in hidden and extract.unmasked(hidden, kept) == text


def test_facts_have_places_and_contexts():
    text = "We saw 12.5% growth. Then n = 40 people."
    facts = extract.scan_facts(text)
    assert ("percentage", "12.5%") in [(k, v) for k, v, *_ in facts]
    assert all(text[a:b] == v for _, v, a, b, _ in facts)


def test_fingerprints_take_whole_texts(spark, tmp_path):
    from scriptorium.plans import catalogue

    texts = ["x" * 64 + "a", "x" * 64 + "b", "é𝒳" * 3000, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["hash31"] for r in catalogue.QUERIES["x3_x4_hashes"](spark, str(tmp_path)).select("doc_id", "hash31").collect()}
    for i, t in enumerate(texts):
        h, units = 0, (t or "").encode("utf-16-le")
        for k in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[k : k + 2], "little")) & 0xFFFFFFFF
        assert found[i] == (None if t is None else f"{h:08x}")


def test_facts_of_long_texts_are_those_of_short_ones():
    lines = [f"value {i}.5% here" for i in range(300)]
    kinds = lambda text: {(k, v) for k, v, *_ in extract.scan_facts(text)}
    assert kinds("; ".join(lines)) == set().union(*map(kinds, lines))


def test_facts_of_each_kind():
    text = "CI: 95% CI [1.2, 3.4], Cohen's d = 0.8, r = -0.3, N = 150, p ≤ 0.01, BLEU 31.2, RMSE = 0.4, took 3.2ms on 2024-05-01, we use BERT Large; evaluated on SQuAD, seen 7"
    found = extract.scan_facts(text)
    assert all(text[a:b] == v for _, v, a, b, _ in found)
    wanted = {("confidence_interval", "95% CI [1.2, 3.4]"), ("effect_size", "Cohen's d = 0.8"), ("correlation", "r = -0.3"), ("sample_size", "N = 150"), ("p_value", "p ≤ 0.01"), ("metric", "BLEU 31.2"), ("metric", "RMSE = 0.4")}
    wanted |= {("measurement", "3.2ms"), ("date", "2024-05-01"), ("method", "BERT Large"), ("dataset", "SQuAD"), ("number", "7"), ("percentage", "95%")}
    assert wanted <= {(k, v) for k, v, *_ in found}


def test_edits():
    assert edit.split_long("short one.") == ["short one."]
    long = " ".join(["word"] * 20) + "; " + " ".join(["more"] * 20) + "."
    assert len(edit.split_long(long)) == 2
    assert edit.thinned(["However, a.", "However, b.", "c."], ["however"]) == ["However, a.", "B.", "c."]


def test_config_layers():
    assert files.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert [files.config_value(x) for x in ("true", "3", "2.5", "x")] == [True, 3, 2.5, "x"]
