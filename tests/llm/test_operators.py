"""Each training-data operator against a brute-force version on small tables with all odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chunks, common, exact_dedup, language, media, mixing, ngram_join, pieces, quality, secrets, substrings
from scriptorium.llm.queries import piece_model

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "wood", "stone", "Ärger", "river", "Moon", "x", "ça", "light,", "and", "fall."]
    rows = []
    shared = " ".join(rng.choice(words) for _ in range(25))
    base = [rng.choice(words) + str(rng.randrange(9)) for _ in range(120)]
    for i in range(60):
        text = " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 90)))
        if i % 4 == 0:
            text = f"{text} {shared} tail{i}"
        if i % 5 == 0:
            copy = list(base)
            copy[rng.randrange(120)] = f"changed{i}"
            text = " ".join(copy)
        rows.append((i, text, "en" if i % 2 else "de", f"s{i % 3}" if i % 7 else None, len(text)))
    rows += [(100, "Same Text here", "en", "s0", 14), (101, "same text HERE", "en", "s0", 14), (102, "Same Text here", None, "s1", 14)]
    rows += [(103, None, None, None, None), (104, "", "en", "s2", 0), (105, " \t\n ", "en", "s2", 4), (106, "one", "en", "s0", 3), (107, "one two", "fr", "s0", 7), (108, "ONE two", "fr", "s0", 7)]
    rows += [(109, " ".join(["very"] * 60_000), "en", "s1", 0), (110, "1234 !!", "en", "s1", 7)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with names the operators use inside
    extra = {c: F.lit("clash") for c in ("_id", "_text", "digest", "keep_id", "chunk", "pid", "score", "kept", "size", "a", "b", "rep", "path", "_salt", "target", "ref")}
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).withColumns(extra).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "exact_dedup": exact_dedup.exact_dedup,
    "mixing": mixing.mix_sources,
    "ngram_join": ngram_join.jaccard_components,
    "substrings": substrings.remove_repeats,
    "media": media.media_features,
    "secrets": secrets.scan_documents,
    "language": language.identify,
    "pieces": lambda d: pieces.token_digests(d, piece_model()),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


LABELS = "doc_id bigint, quality int, toxic int"


def test_quality_of_odd_tables(spark, empty, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, None, 0), (None, 1, 0), (4, 1, 1)], LABELS)
    assert quality.quality_scores(empty, labels).count() == 0 and quality.quality_scores(empty, labels.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d", "en", "s", 7), (None, None, None, None, None), (1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "w " * 60_000, None, None, 3)], SCHEMA)
    found = quality.quality_scores(rows, labels).collect()
    assert len(found) == 5 and len({r["score"] for r in found if r["doc_id"] == 1}) == 1 and all(0 <= r["score"] <= 1 for r in found)
    clash = quality.quality_scores(docs, labels.withColumn("score", F.lit("clash")).withColumn("text", F.lit("x")))
    assert {r["doc_id"] for r in clash.collect()} == {r[0] for r in ROWS}


@pytest.mark.parametrize("name", ["secrets", "language"])
def test_maps_of_clashing_columns_and_long_texts(docs, name):
    found = OPERATORS[name](docs).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_null_ids_and_repeated_rows(spark, name):
    rows = spark.createDataFrame([(None, "a b c d", "en", "s", 7), (None, None, None, None, None), (1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "e f", None, None, 3)], SCHEMA)
    assert OPERATORS[name](rows).count() == 5


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, text, *_ in ROWS:
        groups[(text or "").translate(LOWER)].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    found = exact_dedup.exact_dedup(docs, salts=3).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found} == want
    assert len(found) == len(ROWS)


def shingles(text, n=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


@pytest.mark.parametrize(("length", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_ngram_join(docs, length, percent):
    sets = {i: shingles(t, length) for i, t, *_ in ROWS}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i: (len(sets[i]), find(i)) for i in ids}
    found = ngram_join.jaccard_components(docs, length=length, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def test_pairs_at_the_threshold_keep_a_common_tile():
    """Whatever the order of the tiles by frequency is."""
    import numpy as np

    rng = np.random.default_rng(5)
    for percent in (80, 90):
        for n in (*range(5, 40), 100, 333, 1000):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            for _ in range(4):
                lost = next(k for k in range(n, -1, -1) if 100 * (n - k) >= percent * (n + k))  # k elements of each side differ
                b = np.unique(np.concatenate([rng.permutation(a)[: n - lost], rng.integers(0, 2**63, lost, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
                if lost and ngram_join.linked(a, b, percent):
                    tiles = ngram_join.Tiles([a, b], percent)
                    ranks = {k: int(rng.integers(0, 9)) for k in tiles.key.tolist()}
                    kept = tiles.kept(np.array([ranks[k] for k in tiles.key.tolist()]))
                    both = [set(tiles.key[kept & (tiles.set == i)].tolist()) for i in (0, 1)]
                    assert both[0] & both[1] and len(both[0]) < (tiles.set == 0).sum()


def test_bitmaps_bound_the_overlap_from_above():
    import numpy as np

    rng = np.random.default_rng(8)
    for n, lost in ((3, 1), (40, 6), (500, 60), (500, 300), (3000, 100)):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - lost], rng.integers(0, 2**64, lost + n // 5, dtype=np.uint64)]))
        x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
        words = min(len(x), len(y))
        differing = int(np.bitwise_count(ngram_join.folded(x, words) ^ ngram_join.folded(y, words)).sum())
        assert differing <= len(np.setxor1d(a, b))
        assert all(ngram_join.within(len(a), len(b), differing, p) for p in range(1, 100) if ngram_join.linked(a, b, p))


@pytest.mark.parametrize("two", [False, True])
def test_blocks_are_compared_between_components(two):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 60 - k % 5], rng.integers(0, 2**64, k % 4, dtype=np.uint64)])) for k in range(24)]
    comp, mine = np.array([0 if k < 12 else k % 5 for k in range(24)]), np.array([not two or k % 3 > 0 for k in range(24)])
    table = pa.table({"rep": pa.array(range(24), pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "comp": pa.array(comp, pa.int64()), "mine": pa.array(mine), "bits": pa.array([ngram_join.bitmap(s).tobytes() for s in sets], pa.binary())})
    table = table.append_column("tile", pa.array([5] * 24, pa.int64())).append_column("i", pa.array([0] * 24, pa.int32())).append_column("j", pa.array([int(two)] * 24, pa.int32()))
    other = table.set_column(table.column_names.index("tile"), "tile", pa.array([-1] * 24, pa.int64())).set_column(table.column_names.index("rep"), "rep", pa.array(range(100, 124), pa.int64()))
    rows = pa.concat_tables([table, other]).take(rng.permutation(48))  # two tiles in one call
    found = [r for r in ngram_join.all_across(rows, 80).to_pylist() if r["a"] < 100 and r["b"] < 100]
    assert 2 * len(found) == ngram_join.all_across(rows, 80).num_rows
    pairs = {(i, j) for i in range(24) for j in range(i + 1, 24) if comp[i] != comp[j] and (not two or mine[i] != mine[j])}
    got = [(r["a"], r["b"]) for r in found]
    assert len(got) == len(set(got)) and set(got) <= pairs
    assert {p for p in pairs if ngram_join.linked(sets[p[0]], sets[p[1]], 80)} <= set(got)


def test_tiles_are_sums_of_buckets():
    import numpy as np

    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 3, 40, 41, 200)]
    tiles, own = ngram_join.Tiles(sets, 80), ngram_join.bands(80)
    want = []
    for i, s in enumerate(sets):
        for level in own.levels(len(s)):
            m = own.slack(level) + own.spare(level)
            for k in range(m):
                inside = [x for x in s.tolist() if (x >> 32) * m >> 32 == k]
                total = sum(int(chunks.mixed(np.array([x], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0]) for x in inside) % 2**64
                want.append((i, int(chunks.mixed(np.array([total], np.uint64) ^ chunks.mixed(np.array([k + (level << 32)], np.uint64)))[0])))
    assert list(zip(tiles.set.tolist(), tiles.key.tolist(), strict=True)) == want


def test_substrings(docs):
    words = {i: WORD.findall(t or "") for i, t, *_ in ROWS}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    want = {}
    for i, own in words.items():
        gone = {j for k in range(len(own) - 12) if first[tuple(own[k : k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(w for j, w in enumerate(own) if j not in gone)
        want[i] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    found = substrings.remove_repeats(docs, with_text=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in found} == want
    assert any(r["n_removed"] for r in found)


@pytest.mark.parametrize("salts", [1, 2, 5])
def test_exchange_by_salts(spark, tmp_path, salts):
    import numpy as np

    from scriptorium.llm.common import WorkFolder

    rng = np.random.default_rng(7)
    sent = {f"c{i}": np.unique(rng.integers(0, 40, 25).astype(np.uint64) * np.uint64(2**58)) for i in range(9)} | {"empty": np.zeros(0, np.uint64)}
    values = {c: rng.integers(0, 1000, len(k)) for c, k in sent.items()}
    rows = [r for c, k in sent.items() for r in chunks.key_blocks(k, c, 6, np.zeros(len(k), np.uint32), values[c]).to_pylist()]
    blocks = spark.createDataFrame([(r["pid"], r["chunk"], bytearray(r["data"])) for r in rows], chunks.BLOCK_SCHEMA)
    found = chunks.answer(blocks, ["<u8", "<u4", "<i8"], substrings.least_ids, WorkFolder(spark, "test"), salts).toArrow()
    for c, k in sent.items():
        want = [min(v for d in sent for x, v in zip(sent[d], values[d], strict=True) if x == key) for key in k]
        assert chunks.replies(found.filter([x == c for x in found.column("chunk").to_pylist()]), "<i8").tolist() == want
    only = spark.createDataFrame([(r["pid"], r["chunk"], bytearray(r["data"])) for c, k in sent.items() for r in chunks.key_blocks(k, c, 6).to_pylist()], chunks.BLOCK_SCHEMA)
    flags = chunks.answer(only, ["<u8"], chunks.repeated, WorkFolder(spark, "test"), salts).toArrow()
    for c, k in sent.items():
        assert chunks.replies(flags.filter([x == c for x in flags.column("chunk").to_pylist()]), "?").tolist() == [sum(key in sent[d] for d in sent) > 1 for key in k]


def test_cover_has_a_shift_for_any_two_positions():
    p, cover = substrings.PERIOD, substrings.COVER
    assert all(any((i + d) % p in cover and (j + d) % p in cover for d in range(p)) for i in range(p) for j in range(p))


def test_pieces(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for i, text, *_ in ROWS:
        ids = model.encode(text or "", add_eos=True)
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.token_digests(docs, piece_model()).collect()} == want
    assert all(r["decoded"] == (next(t for i, t, *_ in ROWS if i == r["doc_id"]) or "") for r in pieces.encode_documents(docs, piece_model()).collect())


@pytest.mark.parametrize("alphabet", ["ab the▁ \n\té中𝔘\x00<0>/s ﬁ  ́‍", "ab e\n", "abc thing\n  "])
def test_pieces_of_random_texts(spark, alphabet):
    import sentencepiece

    rng = random.Random(1)
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    rows = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    found = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.encode_documents(rows, piece_model(), chunk_bytes=2000).collect()}
    want = {f"d{i}": model.encode(t, add_eos=True) for i, t in enumerate(texts)}
    assert found == {i: (ids, model.decode(ids)) for i, ids in want.items()}


def test_each_distinct_word_is_segmented_once():
    model, asked = pieces.Model(piece_model()), []
    segment = model.segment
    model.segment = lambda keys: (asked.extend(keys), segment(keys))[1]
    import pyarrow as pa

    blocks = [pieces.pack(*pieces.parts_of(pa.array(x))) for x in (["ab", "the", "x"], ["the", "zz"], ["ab", "x", "zz"])]
    assert len(pieces.segmented(blocks, model)) == 3
    assert sorted(asked) == ["ab", "the", "x", "zz"]


def test_a_model_that_changes_texts_is_refused():
    assert dict(pieces.fields(bytes([8, 150, 1, 18, 2, 104, 105]))) == {1: 150, 2: b"hi"}


def test_mixing(docs):
    found = mixing.mix_sources(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in ROWS}
    assert {r["doc_id"]: r["size"] for r in found} == size
    by = defaultdict(list)
    of = {i: s for i, _, _, s, _ in ROWS}
    for r in found:
        by[of[r["doc_id"]]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    total = sum(size.values())
    share = mixing.targets([sum(size[r["doc_id"]] for r in by[s]) for s in order], [(1, 2, 3)[k % 3] for k in range(len(order))], 3)
    for s, target in zip(order, share, strict=True):
        rows = by[s]
        own = sum(r["size"] for r in rows)
        assert all(r["target"] == target and r["source_size"] == own for r in rows) and target <= 3 * own
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows)
    assert sum(share) == pytest.approx(min(total, 3 * total))
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in found}


def test_mixing_targets_reshare_the_excess():
    assert mixing.targets([10, 10, 1000], [1, 2, 3], 3) == [30.0, 30.0, 960.0]
    assert mixing.targets([0, 0], [1, 2], 3) == [0.0, 0.0]
    assert mixing.targets([], [], 3) == []


def test_target_tables_match_the_plain_form(spark):
    for sizes in ([10, 10, 1000], [0, 0], [], [5, 1, 900, 2, 40, 7, 7], [3] * 20):
        rows = spark.createDataFrame([(f"s{i:02}" if i else None, n) for i, n in enumerate(sizes)], "_source string, size bigint")
        order = [*range(1, len(sizes)), *([0] if sizes else [])]  # null last
        want = dict(zip(order, mixing.targets([sizes[i] for i in order], [(1, 2, 3)[k % 3] for k in range(len(order))], 3), strict=True))
        found = {r["_source"]: r["target"] for r in mixing.target_table(rows, (1, 2, 3), 3).collect()}
        assert found == {f"s{i:02}" if i else None: t for i, t in want.items()}


def plain_png(payload):
    """A grey image of 64 bytes a line, put together from the format's description."""
    import struct

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + payload[i : i + 64] for i in range(0, len(payload), 64))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">II5B", 64, len(payload) // 64, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines, 1)) + part(b"IEND", b"")


def test_media(docs):
    found = {r["doc_id"]: r for r in media.media_features(docs).collect()}
    assert len(found) == len(ROWS)
    by_text = {}
    for i, text, *_ in ROWS:
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64) or bytes(64)
        image = plain_png(padded)
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(padded[-64:]), len(image), hashlib.sha256(image).hexdigest())
        assert by_text.setdefault(text or "", r["feature"]) == r["feature"]
        assert f"mean={sum(padded) / len(padded):.4f} " in r["feature"] and f"64x{len(padded) // 64} " in r["feature"]
        assert media.from_png(image).tobytes() == padded


def test_sequences_keep_order_and_captions(spark):
    page = '<p>One &amp; two</p><img src="a.png" alt="plain"><figure><img src="b.png" alt="x"><figcaption>The <b>second</b></figcaption></figure>tail<script>no()</script>'
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    found = {r["page_id"]: r["sequence"] for r in media.parse_sequences(rows).collect()}
    assert [(x["position"], x["kind"], x["text"], x["ref"], x["caption"]) for x in found[1]] == [
        (0, "text", "One & two", None, None), (1, "image", None, "a.png", "plain"), (2, "image", None, "b.png", "The second"), (3, "text", "tail", None, None),
    ]
    assert found[2] == [] and found[3] == []


def test_language_held_out_accuracy(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "tion", "er", "sh"], "de": ["sch", "ung", "der", "ei", "ß"], "fr": ["eau", "é", "que", "oi", "ç"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(40)), lang, "s", 0) for i, lang in enumerate(["en", "de", "fr"] * 100)]
    rows += [(1000, None, "en", "s", 0), (1001, "12 !", "en", "s", 0), (1002, "the thing", None, "s", 0)]
    found = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    held = [(found[i]["lang_pred"], lang) for i, _, lang, *_ in rows[:300] if found[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert found[1000]["lang_pred"] == found[1001]["lang_pred"] == "und" and found[1002]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in found.values())


def plain_language(rows, dimensions):
    """Hyperdimensional language profiles letter by letter, with plain numbers."""
    vectors = {}

    def vector(c):
        if c not in vectors:
            vectors[c] = [int(x) for x in language.letter_vector(int(language.letters()[0][ord(c)]), dimensions)] if c != " " else [int(x) for x in language.letter_vector(0, dimensions)]
        return vectors[c]

    def bundle(text):
        t = " " + "".join(c.lower() if len(c.lower()) == 1 else c for c in text) + " "
        t = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t))
        grams = Counter(t[i : i + 3] for i in range(len(t) - 2))
        total = [0] * dimensions
        for g, n in grams.items():
            a, b, c = map(vector, g)
            for k in range(dimensions):
                total[k] += n * a[k - 2] * b[k - 1] * c[k]  # rotated by two, one and no places
        return total, sum(n * n for n in grams.values())

    sums = defaultdict(lambda: [0] * dimensions)
    for i, text, lang, *_ in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            sums[lang] = [x + y for x, y in zip(sums[lang], bundle(text)[0], strict=True)]
    out = {}
    for i, text, *_ in rows:
        if not any(map(str.isalpha, text or "")):
            out[i] = ("und", 0.0)
            continue
        own, squares = bundle(text)
        likes = [(-sum(x * y for x, y in zip(own, s, strict=True)) / (sum(y * y for y in s) ** 0.5 * (dimensions * squares) ** 0.5), lang) for lang, s in sums.items()]
        out[i] = (min(likes)[1], min(max(-min(likes)[0], 0.0), 1.0))
    return out


def test_language_matches_plain_arithmetic(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("The thing is here", "en"), (" der Hund und die Katze", "de"), ("Ça va bien, é!", "fr"), ("a", "en"), ("Ö", "de"), ("it", None), ("..", "en"), (None, "en"), ("und und", "de")] * 4)]
    learned = language.learn(spark.createDataFrame(rows, SCHEMA), "text", "lang", language.remainder(F.col("doc_id"), 3) != 1, dimensions=256)
    want = plain_language(rows, 256)
    labels, scores = learned.predict([r[1] or "" for r in rows])
    for (i, *_), label, score in zip(rows, labels, scores, strict=True):
        assert label == want[i][0] and score == pytest.approx(want[i][1], abs=1e-4)


def test_language_does_not_depend_on_partitions(docs):
    blank = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  "), F.col("text"))).otherwise(F.col("text")))
    one, many = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(blank.repartition(n)).collect()} for n in (1, 7))
    assert one == many
    same = language.identify(docs.withColumn("text", F.lit(" Same text, everywhere ")))
    assert same.select("score").distinct().count() == 1


def test_language_refuses_a_label_column_without_bound(spark):
    rows = spark.createDataFrame([(3 * i, "some text", f"l{i}", "s", 0) for i in range(30)], SCHEMA)
    with pytest.raises(ValueError, match="more than 5"):
        language.learn(rows, "text", "lang", F.lit(True), most=5)


def test_gram_vectors_bind_rotated_letters():
    import numpy as np

    ids = language.letters()[0]
    a, b, c = (int(ids[ord(x)]) for x in "abc")
    code = np.array([(a << 36) | (b << 18) | c], np.uint64)
    want = np.roll(language.letter_vector(a, 64), 2) * np.roll(language.letter_vector(b, 64), 1) * language.letter_vector(c, 64)
    assert (language.gram_vectors(code, 64)[0] == want).all()


def test_quality_held_out(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(50)]
        text = " ".join(words) + "." if good else "!! ".join(w.upper() for w in words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    rows += [(1000, None, None, None, None), (1001, "", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r for r in quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert len(found) == len(rows) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(found[i]["predicted"], y) for i, y, _ in labels if found[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}


def plain_features(text):
    """The features of one text, counted one character at a time."""
    import math
    from collections import Counter as Count

    kinds = Count()
    for c in text:
        marks = {"#$%&*@^~<>{}[]\\=_+/": "mark", "!?": "exclaim", "|": "bar", ".,;:": "stop"}
        kind = next((k for m, k in marks.items() if c in m), None)
        if c.isalpha():
            kind = ("upper" if c.isupper() else "lower") if ord(c) < 128 else "high"
        elif "0" <= c <= "9":
            kind = "digit"
        elif c in " \t\x0b\x0c\r":
            kind = "space"
        elif c == "\n":
            kind = "line"
        kinds[kind or "rest"] += 1
    words, lines, n = text.split(), text.split("\n"), len(text)
    letters, some, chars = max(kinds["upper"] + kinds["lower"] + kinds["high"], 1), max(len(words), 1), max(n, 1)
    marked = "#$%&*@^~<>{}[]\\=_+/!?"
    again = sum(a == b and a in marked for a, b in zip(text, text[1:]))
    return [
        math.log1p(n), math.log1p(len(words)), (n - kinds["space"] - kinds["line"]) / some, kinds["upper"] / letters, kinds["digit"] / chars, kinds["mark"] / some, kinds["exclaim"] / some, kinds["bar"] / some, kinds["stop"] / some,
        n / len(lines), len(set(words)) / some, len(set(lines)) / len(lines), kinds["high"] / letters, kinds["rest"] / chars, again / some,
    ]


def test_quality_features_and_scores_match_plain_loops():
    import math

    import numpy as np

    texts = ["", "a", "Good text, with words.\nAnd lines.\nAnd lines.", "!!! BUY | NOW ### $$$ é ü 123\t\x0b«»", "x " * 500, "日本語 テキスト!!"]
    x = quality.features(texts)
    assert x.tolist() == [pytest.approx(plain_features(t)) for t in texts]
    rng = np.random.default_rng(1)
    rows = rng.random((300, len(quality.FEATURES)))
    model = quality.fit(rows, (rows[:, 0] + rows[:, 1] * rows[:, 2] > 0.8).astype(float))
    for row, score in zip(rows[:40], model.score(rows[:40]), strict=True):
        bins = [sum(v > e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        raw = model.intercept + sum(t[b] for t, b in zip(model.single, bins, strict=True)) + sum(t[bins[i]][bins[j]] for (i, j), t in model.pairs.items())
        assert score == pytest.approx(1 / (1 + math.exp(-raw)))


def test_pairs_learn_what_single_features_cannot():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.zeros((2000, len(quality.FEATURES)))
    x[:, 0], x[:, 1] = rng.random(2000), rng.random(2000)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_lookups_and_components_do_not_go_through_the_driver(spark, tmp_path):
    """Files of some kilobytes, whose rows a lookup repeats 32 times: joined by shuffle, whatever the planner makes of them."""
    spark.range(2000).selectExpr("id % 500 AS k", "id").write.parquet(f"{tmp_path}/rows")
    spark.range(500).selectExpr("id AS k", "id * 3 AS x").write.parquet(f"{tmp_path}/entries")
    rows, entries = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("rows", "entries"))
    found = common.salted_lookup(rows, entries, ["k"], F.col("id"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.select("id", "x").collect()) == [(i, i % 500 * 3) for i in range(2000)]
    sets = spark.createDataFrame([(1, 2, b"\0" * 32), (2, 2, b"\0" * 32)], "rep bigint, n bigint, bits binary")
    pairs = ngram_join.possible(spark.createDataFrame([(1, 2)], "a bigint, b bigint"), sets, 90)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
