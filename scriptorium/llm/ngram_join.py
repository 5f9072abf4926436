"""Jaccard join of word n-gram sets: size-banded tiles, bitmap bounds, exact intersections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import chunks as C
from scriptorium.llm.common import WorkFolder, lean, partitions, relax, salted_lookup
from scriptorium.llm.components import components

#: 64-bit words of the smallest bitmap; a set has the least power of two of them that gives so many bits an element.
BITMAP_WORDS, BITS = 4, 4
#: Rounds in which a tile's members are compared with one or two of them, before all that is left is.
ROUNDS = 3
#: Members of a tile that are compared with each other at a time; rows of blocks that a task's call takes on average.
BLOCK, BATCH_ROWS = 256, 8192
#: Bytes of tile keys per byte of text: at thresholds of 0.8 or more a set has tiles for three quarters of its elements at most.
KEY_SHARE = 1.2


class Bands:
    """Bands of set sizes for a threshold of ``percent``, and the buckets of each level.

    A set that links with one of size n in band i is in band i or i + 1. Level i is for the pairs whose smaller
    set is in band i; their sets differ in at most ``slack(i)`` elements. The hash range is cut into
    slack + spare buckets at that level, so that at least ``spare`` buckets of the one set are just those of the other.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]

    def reach(self, level: int) -> None:
        while len(self.starts) < level + 2:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)

    def band(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.reach(len(self.starts) - 1)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def slack(self, level: int) -> int:
        self.reach(level)
        small = self.starts[level + 1] - 1
        # J >= p/100 means |A ^ B| <= (|A| + |B|) (100 - p) / (100 + p).
        return (small + small * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def spare(self, level: int) -> int:
        return 2 + self.slack(level) // 2

    def levels(self, n: int) -> list[int]:
        """Levels at which a set of n elements can have a partner that isn't equal to it."""
        band = self.band(n)
        return [x for x in (band - 1, band) if n and x >= 0 and self.slack(x)]


@lru_cache(maxsize=8)
def bands(percent: int) -> Bands:
    return Bands(percent)


class Tiles:
    """The tiles of some sets: a key of each bucket's content at each of a set's levels, empty buckets too.

    Two sets that link have ``spare`` tiles of a level in common at least. In one order of all tiles, by how many sets
    have them, each set may therefore leave out its last spare - 1 tiles of the level: of the tiles that two sets have
    in common, neither leaves out the first. So passages, lines or empty buckets that very many sets share bring
    nothing together that doesn't link, and no link is lost.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        own = bands(percent)
        places = [(i, level) for i, s in enumerate(sets) for level in own.levels(len(s))]
        set_of, level_of = (np.array([p[k] for p in places], np.int64) for k in (0, 1))
        buckets = np.array([own.slack(x) + own.spare(x) for x in level_of.tolist()], np.int64)
        starts = np.concatenate([[0], np.cumsum(buckets)])
        sums = np.zeros(starts[-1], np.uint64)
        if len(places):
            elements = np.concatenate([sets[i] for i in set_of.tolist()])
            sizes = np.array([len(sets[i]) for i in set_of.tolist()], np.int64)
            # the hash range cut into equal buckets: elements are sorted, so that those of a bucket stand together
            at = (((elements >> np.uint64(32)) * np.repeat(buckets.astype(np.uint64), sizes)) >> np.uint64(32)).astype(np.int64) + np.repeat(starts[:-1], sizes)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums[at[first]] = np.add.reduceat(C.mixed(elements + np.uint64(0x9E3779B97F4A7C15)), first)
        #: By tile: its set, the group of its set and level, its key.
        self.group = np.repeat(np.arange(len(places)), buckets)
        self.set = set_of[self.group] if len(places) else np.zeros(0, np.int64)
        names = np.arange(starts[-1]) - starts[:-1][self.group] + (level_of[self.group] << 32) if len(places) else np.zeros(0, np.int64)
        self.key = C.mixed(sums ^ C.mixed(names.astype(np.uint64)))
        self.spare = np.array([own.spare(x) for x in level_of.tolist()], np.int64)
        self.starts = starts

    def kept(self, rank: np.ndarray) -> np.ndarray:
        """Which tiles stay, by a rank of each tile's key among all, the same for all sets."""
        order = np.lexsort((self.key, rank, self.group))
        from_last = self.starts[1:][self.group] - 1 - np.arange(len(order))  # groups stand as they did
        out = np.empty(len(order), bool)
        out[order] = from_last >= (self.spare[self.group] - 1)
        return out


def counted(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """For C.answer(): how many sets have a key."""
    own, back = np.unique(keys, return_inverse=True)
    return back, (own, np.bincount(back, sets, len(own)).astype(np.uint32))


def frequency(keys: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """A byte that grows with the number of sets: 0 for one, 8 for two, 8 more whenever it doubles."""
    return np.minimum(8 * np.log2(np.maximum(sets, 1)), 255).astype(np.uint8)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of elements hash to it: what two sets have in common cancels out when their maps are compared."""
    n = BITMAP_WORDS * 64
    while n < BITS * len(shingles):
        n *= 2
    bits = np.bincount((C.mixed(shingles) % np.uint64(n)).astype(np.int64), minlength=n) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The set's bitmap of a smaller size."""
    return bits if len(bits) == words else np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


class Sets:
    """The n-gram sets of a chunk's documents, as sorted hashes."""

    def __init__(self, uri: str, length: int, rows: list[int] | None = None):
        table = C.read_chunk(uri)
        if rows is not None:
            table = table.take(rows)
        self.ids = table.column("doc_id").to_numpy()
        words = C.Words(pc.ascii_lower(table.column("text")))
        full = words.windows(length, 0)
        self.sets = []
        for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
            if b - a >= length:
                self.sets.append(np.unique(full[a : b - length + 1]))
            elif b > a:  # fewer words: the whole sequence, told apart from longer ones by its length
                whole = np.array([b - a], np.uint64)
                for k in range(a, b):
                    whole = C.mixed(whole ^ words.hashes[k, :1]) * C.WORD_SEEDS[:1]
                self.sets.append(whole)
            else:
                self.sets.append(np.zeros(0, np.uint64))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that tell sets apart."""
        out = np.zeros((len(self.sets), 2), np.uint64)
        for i, s in enumerate(self.sets):
            out[i] = C.mixed(s).sum(dtype=np.uint64), C.mixed(s ^ C.WORD_SEEDS[1]).sum(dtype=np.uint64)
        return out[:, 0].view(np.int64), out[:, 1].view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on sorted arrays: percent of the union at least is common."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def within(n: np.ndarray | int, m: np.ndarray | int, differing: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether sets of n and m elements can link if their bitmaps differ in so many bits.

    Each such bit takes an element of one set only at least, so that at most (n + m - differing) / 2 are common.
    """
    common = (n + m - differing) // 2
    return 100 * common >= percent * (n + m - common)


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bit counts allow to link."""
    one = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))
            keep = []
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)
                words = min(len(p), len(q))
                keep.append(within(n[i], m[i], int(np.bitwise_count(folded(p, words) ^ folded(q, words)).sum()), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").mapInArrow(bound, "a bigint, b bigint")


def verify(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection."""
    one, two = (full.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in ("a", "b"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sets], pa.bool_()))

    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").mapInArrow(test, "a bigint, b bigint")


def across(n: np.ndarray, comp: np.ndarray, rep: np.ndarray, mine: np.ndarray, maps: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Of one block of a tile, or between two: the pairs of different components that sizes and bitmaps allow.

    Of such a pair one member at least is not in the component that most members are in, so that only the others are
    compared with all.
    """
    names, place, sizes = np.unique(comp, return_inverse=True, return_counts=True)
    if len(names) == 1:
        return
    most, whole, words = place == sizes.argmax(), mine.all(), min(map(len, maps))
    bits = np.stack([folded(x, words) for x in maps])
    for i in np.flatnonzero(~most):
        # between blocks: the other block; within one: those of the large component, and of the rest those behind
        others = most | (rep > rep[i]) if whole else (mine != mine[i]) & (most | mine[i])
        some = np.flatnonzero(others & (comp != comp[i]))
        differing = np.bitwise_count(bits[some] ^ bits[i]).sum(axis=1, dtype=np.int64)
        yield from ((int(min(rep[i], r)), int(max(rep[i], r))) for r in rep[some[within(n[some], n[i], differing, percent)]])


def all_across(table: pa.Table, percent: int) -> pa.Table:
    """Of many blocks (tile, i, j) at a time, each by itself: the distinct pairs."""
    tile, i, j, n, comp, rep = (table.column(c).to_numpy() for c in ("tile", "i", "j", "n", "comp", "rep"))
    mine = table.column("mine").to_numpy(zero_copy_only=False).astype(bool)
    bits = table.column("bits").to_pylist()
    order = np.lexsort((j, i, tile))
    new = np.flatnonzero(np.concatenate([[True], (tile[order][1:] != tile[order][:-1]) | (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1])]))
    found: set[tuple[int, int]] = set()
    for own in np.split(order, new[1:]):
        found.update(across(n[own], comp[own], rep[own], mine[own], [np.frombuffer(bits[k], np.uint64) for k in own.tolist()], percent))
    relax()
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Texts are lower-cased (A-Z); a text's set are its distinct ``length``-word shingles, or its whole sequence if
    shorter. Documents link when 100 * intersection >= percent * union; component_id is the least id reachable.

    1. Documents with equal sets form a class; only the class's least id goes on.
    2. A tile is a level (band of sizes) with the content of one bucket of the hash range. Two sets that link
       share tiles, see :class:`Bands`. Chunks ask how many sets have each of their tiles; those that occur twice, but
       for the most frequent ones of each set, become rows, see :class:`Tiles`. A class in no such tile links with
       nothing.
    3. In rounds, each member of a tile is compared with the member of the greatest weight, then with members of the
       first and last component in it: bitmaps bound the overlap, then sorted arrays are intersected. Components of
       these links soon hold nearly all groups of near copies, in a few comparisons per member.
    4. What is left are tiles whose members are in different components. They are dealt out in pairs of blocks of
       bounded size, in which all pairs of different components are bounded by bitmaps; those that may link are
       verified. So no link between components is lost, and no tile is ever in one task as a whole.

    All joins are by shuffle, as all tables grow with the documents: the planner goes by the size of files, of which the
    rows in memory may be ten times, and would broadcast them through the driver.

    Ids are whole numbers below 2^63 - 1; a null id stands behind all others and rows that repeat an id are one node. Null texts
    and texts without words have an empty set and link with nothing. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    work = WorkFolder(spark, "ngram-join")
    tasks = partitions(spark)
    written = work.table(C.write_chunks(docs, work.folder("chunks"), id_col, text_col), "manifest")
    manifest, deal = written.select("chunk"), C.exchange(written, KEY_SHARE)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("chunk").to_pylist():
                own = Sets(uri, length)
                n = [len(s) for s in own.sets]
                yield pa.RecordBatch.from_arrays([pa.array(own.ids, pa.int64()), pa.array([uri] * len(n), pa.string()), pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64()), *(pa.array(k, pa.int64()) for k in own.keys())], ["doc_id", "chunk", "row", "n", "k1", "k2"])

    members = work.table(manifest.repartition(tasks).mapInArrow(lean(describe), "doc_id bigint, chunk string, row int, n bigint, k1 bigint, k2 bigint"), "members")
    keys = ["k1", "k2", "n"]
    classes = members.filter("n > 0").groupBy(*keys).agg(F.min(F.struct("doc_id", "chunk", "row")).alias("first"), F.count(F.lit(1)).alias("size"))
    classes = work.table(classes.select(*keys, F.col("first.doc_id").alias("rep"), "first.chunk", "first.row", "size"), "classes")
    reps = classes.select("chunk", "row")  # few bytes, much work: dealt out by number, or adaptive execution would join them to a few tasks

    def chosen(table: pa.Table) -> tuple[str, Sets, list[int]]:
        uri = table.column("chunk")[0].as_py()
        own = Sets(uri, length)
        return uri, own, sorted(r for r in table.column("row").to_pylist() if r is not None)

    def ask(table: pa.Table) -> pa.Table:
        uri, own, rows = chosen(table)
        keys, count = np.unique(Tiles([own.sets[r] for r in rows], percent).key, return_counts=True)
        relax()
        return pa.Table.from_batches([C.key_blocks(keys, uri, deal.ranges, np.minimum(count, 255).astype(np.uint8))])

    def involved(table: pa.Table) -> pa.Table:
        uri, own, rows = chosen(table)
        tiles = Tiles([own.sets[r] for r in rows], percent)
        _, back, _ = C.unique_keys(tiles.key)
        often = C.replies(table.filter(pc.is_valid(table.column("pid"))), "u1")[back]
        stay = tiles.kept(often) & (often > 0)
        keys, of = tiles.key[stay].view(np.int64), tiles.set[stay]
        cuts = np.searchsorted(of, np.arange(len(rows) + 1))
        some = [(r, keys[a:b]) for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True) if b > a]
        relax()
        return pa.table({
            "rep": pa.array([int(own.ids[r]) for r, _ in some], pa.int64()), "chunk": pa.array([uri] * len(some), pa.string()), "row": pa.array([r for r, _ in some], pa.int32()),
            "n": pa.array([len(own.sets[r]) for r, _ in some], pa.int64()), "bits": pa.array([bitmap(own.sets[r]).tobytes() for r, _ in some], pa.binary()),
            "tiles": pa.array([x.tolist() for _, x in some], pa.list_(pa.int64())),
        })

    asked = reps.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(ask, C.BLOCK_SCHEMA)
    flags = work.table(C.answer(asked, ["<u8", "u1"], counted, work, deal.salts, frequency), "flags")
    none = F.lit(None)
    told = reps.select("chunk", "row", none.cast("int").alias("pid"), none.cast("binary").alias("data")).unionByName(flags.select("chunk", none.cast("int").alias("row"), "pid", "data"))
    sets = work.table(told.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(involved, "rep bigint, chunk string, row int, n bigint, bits binary, tiles array<bigint>"), "sets")
    work.drop("flags", "manifest")

    def fetch(table: pa.Table) -> pa.Table:
        rows = sorted(set(table.column("row").to_pylist()))
        own = Sets(table.column("chunk")[0].as_py(), length, rows)
        relax()
        return pa.table({"rep": pa.array(own.ids, pa.int64()), "shingles": pa.array([x.tobytes() for x in own.sets], pa.binary())})

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        """Bounds by bitmaps, then fetches the sets of what is left alone, then intersects them."""
        left = work.table(pairs, f"{name}-pairs")
        ids = left.select(F.col("a").alias("rep")).union(left.select("b")).distinct()
        places = sets.select("rep", "chunk", "row").join(ids.hint("merge"), "rep", "left_semi").repartition(tasks, "chunk")
        full = work.table(places.groupBy("chunk").applyInArrow(fetch, "rep bigint, shingles binary"), f"{name}-sets")
        links = work.table(verify(left, full, percent), name)
        work.drop(f"{name}-pairs", f"{name}-sets")
        return links

    # A set's weight is how many others it meets in its tiles. Of near copies of one text, that text itself, or the
    # copy least changed, has the most; as leader it links with the most others.
    every = sets.select("rep", F.explode("tiles").alias("tile"))
    sizes = every.groupBy("tile").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    weights = work.table(every.join(sizes.hint("merge"), "tile").groupBy("rep").agg(F.sum("size").alias("weight")), "weights")
    tiles = work.table(sets.join(weights.hint("merge"), "rep").select("rep", "n", "weight", F.explode("tiles").alias("tile")), "tiles")
    placed, links = tiles.withColumn("comp", F.col("rep")), None
    for k in range(ROUNDS):
        members_of = placed.groupBy("tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by("rep", "weight").alias("first"), F.min_by("rep", "comp").alias("one"), F.max_by("rep", "comp").alias("two")).filter("low != high")
        if k:
            leaders = members_of.select("tile", F.inline(F.array(F.struct(F.col("one").alias("b"), F.col("low").alias("own")), F.struct(F.col("two").alias("b"), F.col("high").alias("own")))))
        else:
            leaders = members_of.select("tile", F.col("first").alias("b"), F.col("first").alias("own"))
        pairs = placed.join(leaders.hint("merge"), "tile").filter("comp != own").select(F.col("rep").alias("a"), "b").distinct()
        new = links_of(possible(pairs, sets, percent), f"links-{k}")
        links = new if links is None else links.unionByName(new)
        roots = components(links, work, f"roots-{k}")
        placed = work.table(tiles.join(roots.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("tile", "rep", "n", "weight", F.coalesce("root", "rep").alias("comp")), f"placed-{k}")
    open_ = placed.groupBy("tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")).filter("low != high")
    left = placed.join(open_.select("tile", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")).hint("merge"), "tile").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "tile", "rep", "n", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("mine")
    )
    # Most blocks are small: a task's call takes some thousand rows, as many blocks as that may be.
    rows = open_.agg(F.sum(F.col("size") * F.ceil(F.col("size") / BLOCK))).first()[0] or 0
    batch = F.pmod(F.xxhash64("tile", "i", "j"), F.lit(max(tasks, -(-rows // BATCH_ROWS))))
    dealt = dealt.join(sets.select("rep", "bits").hint("merge"), "rep").withColumn("batch", batch)
    more = dealt.groupBy("batch").applyInArrow(lambda t: all_across(t, percent), "a bigint, b bigint").distinct()
    links = links.unionByName(links_of(more, "more-links"))
    final = work.table(components(links, work, "final"), "components")

    joined = classes.join(final.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").filter("size > 1 OR root IS NOT NULL")
    named = work.table(joined.select(*keys, F.coalesce("root", "rep").alias("component")), "named")
    found = salted_lookup(members.select("doc_id", *keys), named, keys, F.col("doc_id"))
    result = work.table(found.select(F.nullif("doc_id", F.lit(int(C.LAST))).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "doc_id"), F.lit(int(C.LAST))).alias("component_id")), "result")
    work.drop("chunks", "members", "classes", "sets", "weights", "tiles", "more-links", "components", "named", *(f"{x}-{k}" for x in ("links", "placed") for k in range(ROUNDS)))
    return result

