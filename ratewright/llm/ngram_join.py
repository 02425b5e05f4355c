"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.8.

Sets are in one global order: shingles that many documents have come last, else by hash. Two
similar sets share a shingle of their prefixes, which gives candidate pairs; each set first
meets one hub of its shingle's group, and only what is still in different components then meets
pair by pair. Candidates of one document are stored as a prefix tree: its sets in lexicographic
order with the length each shares with the one before. The tree is walked with the document's
set; the overlap of a shared path is counted once, and a subtree is left when what remains of
either set cannot reach the overlap needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import byte_texts, fresh, land, pieces, small, text_key
from ratewright.llm.components import components

WORDS = 5
#: A shingle of at least so many documents comes last in the global order.
FREQUENT = 64
#: Two maps of a fixed size tell the shingles of several documents and the frequent ones. What
#: falls on another's bit is only ordered later or not left out; results do not change. Prefixes
#: hold a fifth of a set, nearly all from the first quarter of the hashes, so that quarter has 2 **
#: MAP_BITS bits, and the rest of the hashes a quarter of its density. The map of the frequent
#: has one bit for two of these.
MAP_BITS = 26
SHARED_GRAIN, FREQUENT_GRAIN = 0, 1
CHUNK_BYTES = 4_000_000
#: What a worker holds at once, as executors share their memory with two or more of them: shingles
#: that wait to be counted (some 30 bytes each while they are dealt), words and set keys remembered.
FLUSH = 500_000
WORDS_REMEMBERED, REMEMBERED = 100_000, 500_000
#: Counting looks at the first 48 bits of a shingle's hash: shingles equal in these are counted
#: together, which again only moves them in the order. Sorted bytes of one place stand together
#: and compress.
COUNTED_BYTES, COUNTED_SHIFT = 6, 16
#: Hubs of a shingle's group: the first set of each of so many shares of it, other ones each turn.
HUBS, HUB_TURNS = 8, 1
#: Words of 64 bits of a set's parity sketch, and of the folded one that prefixes carry.
SKETCH, FOLDED = 16, 4
#: Sets of one prefix tree, and rows that may be broadcast after counting.
TREE, PLACES = 256, 100_000

#: Odd multipliers.
PLACE = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64
)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0x9E3779B97F4A7C15)


class Shingler(dict):
    """Hash of a word, remembered; and the shingle set of a text."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= WORDS_REMEMBERED:
            self.clear()
        self[word] = h
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct shingles. Words lie between ASCII white space; A-Z are lower-cased."""
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if len(w) < WORDS:
            h = np.uint64(len(w))
            for i in range(len(w)):
                h = mixed(h + w[i : i + 1] * PLACE[i])[0]
            return np.array([h], np.uint64)
        last = len(w) - WORDS + 1
        h = w[:last] * PLACE[0]
        for i in range(1, WORDS):
            h = h + w[i : i + last] * PLACE[i]
        return np.unique(mixed(h))


def class_key(shingles: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the number of shingles that fall on i. Two sketches differ in no
    more bits than the sets differ in shingles."""
    odd = np.bincount((shingles & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differing(one: Column, two: Column, words: int) -> Column:
    bits = [F.bit_count(F.get(one, F.lit(i)).bitwiseXOR(F.get(two, F.lit(i)))) for i in range(words)]
    return sum(bits[1:], bits[0])


def folded(sketch: Column) -> Column:
    """A shorter sketch of the same kind."""
    words = []
    for i in range(FOLDED):
        word = F.get(sketch, F.lit(i))
        for j in range(i + FOLDED, SKETCH, FOLDED):
            word = word.bitwiseXOR(F.get(sketch, F.lit(j)))
        words.append(word)
    return F.array(*words)


def least_overlap(n: int, m: int) -> int:
    """The overlap from which sets of these sizes have a similarity of 0.8."""
    return -(-4 * (n + m) // 9)


class Order:
    """The global order: whether a shingle is in several documents, and whether in many."""

    def __init__(self, shared: np.ndarray, frequent: np.ndarray):
        self.shared, self.frequent = shared, frequent

    @staticmethod
    def place(shingles: np.ndarray, grain: int) -> np.ndarray:
        """The bit of a shingle; it never falls as the hash grows."""
        quarter = np.uint64(1 << 62)
        early = shingles >> np.uint64(62 - MAP_BITS)
        late = (shingles - quarter) >> np.uint64(64 - MAP_BITS)
        return np.where(shingles < quarter, early, late + np.uint64(1 << MAP_BITS)).astype(np.int64) >> grain

    @staticmethod
    def has(bits: np.ndarray, shingles: np.ndarray, grain: int) -> np.ndarray:
        at = Order.place(shingles, grain)
        return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    def in_several(self, shingles: np.ndarray) -> np.ndarray:
        return self.has(self.shared, shingles, SHARED_GRAIN)

    def common(self, shingles: np.ndarray) -> np.ndarray:
        """The shingles of several documents, in order."""
        return self.arrange(shingles[self.in_several(shingles)])

    def arrange(self, shingles: np.ndarray) -> np.ndarray:
        late = self.has(self.frequent, shingles, FREQUENT_GRAIN)
        return np.concatenate([shingles[~late], shingles[late]]) if late.any() else shingles


def by_part(held: list[np.ndarray], part_bits: int) -> pa.RecordBatch:
    """``part, shingles``: of each part of the hash range the shingles, sorted, their bytes by place."""
    every, parts = np.sort(np.concatenate(held)), 1 << part_bits
    cuts = np.searchsorted(every, np.arange(parts, dtype=np.uint64) << np.uint64(64 - part_bits))
    ends = [*cuts[1:], len(every)]
    planes = (every >> np.uint64(COUNTED_SHIFT)).view(np.uint8).reshape(-1, 8)
    blobs = [planes[a:b, :COUNTED_BYTES].T.tobytes() for a, b in zip(cuts, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "shingles"]
    )


def global_order(docs: DataFrame) -> Order:
    """Count the documents of every shingle, equal sets of a task once. A part of the hash range is counted at a time; each
    gives back its slice of the two maps, 21 MiB in all whatever the input."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part_bits = min(16, max(6, int(np.ceil(np.log2(4 * partitions)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size, seen = Shingler(), [], 0, set()

        with np.errstate(over="ignore"):
            for batch in pieces(batches, CHUNK_BYTES, "text"):
                for text in byte_texts(batch.column(0)):
                    shingles = shingler.of(text)
                    key = class_key(shingles)
                    if key in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    held.append(shingles)
                    size += len(shingles)
                    if size >= FLUSH:
                        yield by_part(held, part_bits)
                        held, size = [], 0
        if size:
            yield by_part(held, part_bits)

    def count(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [np.frombuffer(x.as_buffer(), np.uint8) for b in batches for x in b.column(1)]
        planes = np.concatenate([b.reshape(COUNTED_BYTES, -1).T for b in blobs])
        every = np.zeros((len(planes), 8), np.uint8)
        every[:, :COUNTED_BYTES] = planes
        every = np.sort(every.view(np.uint64).reshape(-1)) << np.uint64(COUNTED_SHIFT)
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))[: len(every)]
        times = np.diff(np.append(first, len(every)))
        part = keys[0].as_py()
        ends = np.array([part << (64 - part_bits), ((part + 1) << (64 - part_bits)) - 1], np.uint64)
        maps = []
        for least, grain in ((2, SHARED_GRAIN), (FREQUENT, FREQUENT_GRAIN)):
            start, last = Order.place(ends, grain)
            bits = np.zeros(last - start + 1, bool)
            bits[Order.place(every[first[times >= least]], grain) - start] = True
            maps.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), *(pa.array([m], pa.binary()) for m in maps)], names=["part", "shared", "frequent"]
        )

    counted = (
        docs.where("text IS NOT NULL")
        .select("text")
        .mapInArrow(run, "part int, shingles binary")
        .groupBy("part")
        .applyInArrow(count, "part int, shared binary, frequent binary")
    )
    whole = Order.place(np.array([(1 << 64) - 1], np.uint64), 0)[0] + 1
    shared, frequent = (np.zeros((whole >> grain) // 8, np.uint8) for grain in (SHARED_GRAIN, FREQUENT_GRAIN))
    for row in counted.collect():  # of a fixed size, and one job
        start = np.array([row["part"] << (64 - part_bits)], np.uint64)
        for bits, grain, blob in ((shared, SHARED_GRAIN, row["shared"]), (frequent, FREQUENT_GRAIN, row["frequent"])):
            at = Order.place(start, grain)[0] // 8
            bits[at : at + len(blob)] = np.frombuffer(blob, np.uint8)
    return Order(shared, frequent)


def digests(docs: DataFrame, order) -> DataFrame:
    """``doc_id, text_key, n, s1, s2, sketch, prefix, places`` of each row: size and sketch of its
    set, the key of its class, and the shingles of its prefix less those no other set has, with
    their places. A task gives the prefix of equal sets once; elsewhere the list is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), set()
        nothing = np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            for batch in pieces(batches, CHUNK_BYTES, "text"):
                sizes, keys, sketches, shown, places = [], [], [], [], []
                for text in byte_texts(batch.column(2)):
                    shingles = shingler.of(text)
                    n = len(shingles)
                    key = class_key(shingles) if n else (None, None)
                    sizes.append(n)
                    keys.append(key)
                    sketches.append(sketch_of(shingles))
                    if not n or key in seen:
                        shown.append(nothing)
                        places.append(nothing)
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    prefix = order.value.arrange(shingles)[: n - (4 * n + 4) // 5 + 1]
                    at = np.flatnonzero(order.value.in_several(prefix))
                    shown.append(prefix[at].view(np.int64))
                    places.append(at)
                ends = pa.array(np.append(0, np.cumsum([len(x) for x in shown])).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(sizes, pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array(sketches, pa.list_(pa.int64())),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([nothing, *shown]))),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([nothing, *places]))),
                    ],
                    names=["doc_id", "text_key", "n", "s1", "s2", "sketch", "prefix", "places"],
                )

    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, text_key long, n long, s1 long, s2 long, sketch array<long>,"
        " prefix array<long>, places array<long>",
    )


def possible(n: Column, at: Column, m: Column, other_at: Column) -> Column:
    """Necessary for a similarity of 0.8 of sets that first meet at these places."""
    return (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (F.least(n - at, m - other_at) * 9 >= (n + m) * 4)


class Tree:
    """A prefix tree of sets in global order, as its leaves in lexicographic order with the
    length of the path each shares with the leaf before. Sets come without the shingles that no
    other document has; ``sizes`` are the sizes of the whole sets."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        keys = [s.byteswap().tobytes() for s in sets]
        self.leaves = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets, self.sizes = sets, sizes
        self.shared = [0] * len(sets)
        for i in range(1, len(sets)):
            one, two = sets[self.leaves[i - 1]], sets[self.leaves[i]]
            n = min(len(one), len(two))
            differ = np.flatnonzero(one[:n] != two[:n])
            self.shared[i] = int(differ[0]) if len(differ) else n

    def similar(self, probe: np.ndarray, size: int) -> list[int]:
        """Which sets overlap ``probe`` (in global order) enough for a similarity of 0.8."""
        if not len(probe):
            return []
        rank = np.argsort(probe)
        values = probe[rank]
        path = np.zeros(1, np.int64)  # overlap of the current path's first k shingles
        found = []
        for leaf, shared in zip(self.leaves, self.shared):
            member = self.sets[leaf]
            n, need = len(member), least_overlap(self.sizes[leaf], size)
            path = path[: shared + 1]
            depth, overlap = len(path) - 1, int(path[-1])
            grown, used = [path], 0
            while depth < n:
                if overlap + min(n - depth, len(probe) - used) < need:
                    break
                step = member[depth : depth + 128]
                place = np.minimum(np.searchsorted(values, step), len(values) - 1)
                hit = values[place] == step
                grown.append(overlap + np.cumsum(hit))
                overlap, depth = int(grown[-1][-1]), depth + len(step)
                if hit.any():  # what the probe has before the last shared shingle cannot come again
                    used = int(rank[place[hit]].max()) + 1
            path = np.concatenate(grown)
            if depth == n and overlap >= need:
                found.append(leaf)
        return found


def sets_of(docs: DataFrame, order, places: DataFrame) -> DataFrame:
    """``s1, s2, size, items`` of the classes in ``places`` (``s1, s2, doc_id``): the size of the
    set, and those of its shingles that other documents have. A class may come more than once,
    where a doc_id is repeated."""
    ids = places.select(F.col("doc_id").alias("at_doc")).distinct()
    wanted = docs.select("doc_id", "text").join(
        small(ids, PLACES), F.col("doc_id").eqNullSafe(F.col("at_doc")), "left_semi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        with np.errstate(over="ignore"):
            for batch in pieces(batches, CHUNK_BYTES, "text"):
                sets = [s for t in byte_texts(batch.column(0)) if len(s := shingler.of(t))]
                keys = [class_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([order.value.common(s).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["s1", "s2", "size", "items"],
                )

    found = wanted.select("text").where("text IS NOT NULL").mapInArrow(run, "s1 long, s2 long, size long, items binary")
    keys = places.select(F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    return found.join(small(keys, PLACES), (F.col("s1") == F.col("p1")) & (F.col("s2") == F.col("p2")), "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, order) -> DataFrame:
    """Of the rows ``a1, a2, b1, b2`` those whose sets are similar."""
    ends = pairs.select(F.col("a1").alias("s1"), F.col("a2").alias("s2")).union(pairs.select("b1", "b2")).distinct()
    places = land(classes.join(small(ends, PLACES), ["s1", "s2"]).select("s1", "s2", "doc_id"), "set-places")
    trees = pairs.groupBy("b1", "b2").agg(F.ceil(F.count("*") / TREE).alias("trees"))
    salted = land(
        pairs.join(small(trees), ["b1", "b2"]).withColumn("tree", F.pmod(F.xxhash64("a1", "a2"), "trees")).drop("trees"),
        "tree-places",
    )
    none = F.lit(None).cast("long")
    wanted = salted.select("a1", "a2", "b1", "b2", "tree", F.col("a1").alias("s1"), F.col("a2").alias("s2")).union(
        salted.select(none, none, "b1", "b2", "tree", F.col("b1"), F.col("b2")).distinct()
    )
    rows = sets_of(docs, order, places).join(wanted, ["s1", "s2"]).select("b1", "b2", "tree", "a1", "a2", "size", "items")
    # a probe comes before its members; equal trees stand together
    dealt = rows.repartition("b1", "b2", "tree").sortWithinPartitions("b1", "b2", "tree", F.asc_nulls_first("a1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, size, key, keys, members, sizes = None, 0, None, [], [], []

        def settle() -> pa.RecordBatch:
            good = Tree(members, sizes).similar(probe, size) if members else []
            columns = [[keys[i][0] for i in good], [keys[i][1] for i in good], [key[0]] * len(good), [key[1]] * len(good)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a1", "a2", "b1", "b2"])

        for batch in pieces(batches, CHUNK_BYTES, "items"):
            b1, b2, tree, a1, a2, n = (batch.column(i).to_pylist() for i in range(6))
            for i, items in enumerate(batch.column(6)):
                row = np.frombuffer(items.as_buffer(), np.uint64)
                if (b1[i], b2[i], tree[i]) != key:
                    if key is not None:
                        yield settle()
                    key, probe, size, keys, members, sizes = (b1[i], b2[i], tree[i]), row, n[i], [], [], []
                elif a1[i] is not None:  # else the probe once more
                    keys.append((a1[i], a2[i]))
                    members.append(row)
                    sizes.append(n[i])
        if key is not None:
            yield settle()

    return dealt.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def edges(good: DataFrame) -> DataFrame:
    return good.select(
        F.struct(F.col("a1").alias("s1"), F.col("a2").alias("s2")).alias("a"),
        F.struct(F.col("b1").alias("s1"), F.col("b2").alias("s2")).alias("b"),
    )


def with_component(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the component of their class after ``links``, itself if it has none."""
    known = land(
        components(links).select(F.col("node.s1").alias("s1"), F.col("node.s2").alias("s2"), "component"), "components"
    )
    placed = rows.drop("component").join(small(known), ["s1", "s2"], "left")
    return placed.withColumn("component", F.coalesce("component", F.struct("s1", "s2")))


def undecided(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of those groups of ``keys`` that have more than one component."""
    groups = rows.groupBy(*keys).agg(F.min("component").alias("least"), F.max("component").alias("most"))
    some = land(groups.where("least < most").select(*keys), "undecided")
    return land(rows.join(small(some, PLACES), keys, "left_semi"), "undecided-prefixes")


def pairs_of(met: DataFrame, done: DataFrame | None, classes: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller class as ``a``, less those of ``done`` and those whose
    sketches differ in more bits than similar sets differ in shingles: a ninth of both sizes."""
    pairs = met.select(
        F.col("s1_a").alias("a1"), F.col("s2_a").alias("a2"), F.col("s1_b").alias("b1"), F.col("s2_b").alias("b2")
    ).distinct()
    if done is not None:
        pairs = pairs.join(done, ["a1", "a2", "b1", "b2"], "left_anti")
    known = classes.select("s1", "s2", "n", "sketch")
    return (
        pairs.join(known.toDF("a1", "a2", "n_a", "sketch_a"), ["a1", "a2"])
        .join(known.toDF("b1", "b2", "n_b", "sketch_b"), ["b1", "b2"])
        .where(differing(F.col("sketch_a"), F.col("sketch_b"), SKETCH) * 9 <= F.col("n_a") + F.col("n_b"))
        .select("a1", "a2", "b1", "b2")
    )


def linked_classes(docs: DataFrame, found: DataFrame, classes: DataFrame, order) -> DataFrame:
    """``s1, s2, component`` of all classes that are similar to another. ``found`` are the landed
    digests of ``docs``."""
    prefixes = found.select(
        F.inline(F.arrays_zip(F.col("prefix").alias("shingle"), F.col("places").alias("at"))), "s1", "s2", "n"
    )
    # a shingle in the prefixes of one class only makes no pair
    rows = undecided(prefixes.withColumn("component", F.struct("s1", "s2")), ["shingle"])
    columns = ("s1", "s2", "n", "at", "component")
    smaller = F.struct("s1_a", "s2_a") < F.struct("s1_b", "s2_b")
    may_link = (F.col("component_a") != F.col("component_b")) & possible(
        F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b")
    )

    def side(of: DataFrame, name: str) -> DataFrame:
        return of.select("shingle", *(F.col(c).alias(f"{c}_{name}") for c in columns))

    links = done = None
    for turn in range(HUB_TURNS):
        # sizes of similar sets are in the same or in neighbouring bands
        open_rows = undecided(
            rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))), ["shingle", "band"]
        )
        spread = F.xxhash64("s1", "s2", F.lit(turn))
        hubs = open_rows.groupBy("shingle", "band", F.pmod(spread, F.lit(HUBS)).alias("share")).agg(
            F.min(F.struct(spread.alias("spread"), *columns)).alias("hub")
        )
        hubs = hubs.select("band", "shingle", *(F.col(f"hub.{c}").alias(f"{c}_b") for c in columns))
        met = side(open_rows, "a").withColumn("band", F.floor(F.log(F.col("n_a").cast("double")) / F.log(F.lit(1.25)))).join(
            hubs, ["shingle", "band"]
        )
        # a pair of two hubs is met from both sides; either way the smaller class comes first
        straight = met.where(may_link & smaller)
        turned = met.where(may_link & ~smaller).toDF(
            *(c[:-1] + "ab"[c.endswith("_a")] if c.endswith(("_a", "_b")) else c for c in met.columns)
        )
        pairs = land(pairs_of(straight.unionByName(turned), done, classes), "hub-pairs")
        done = pairs if done is None else done.union(pairs)
        good = land(edges(verified(pairs, docs, classes, order)), "hub-links")
        links = good if links is None else links.union(good)
        rows = with_component(rows, links)
    short = classes.select("s1", "s2", folded(F.col("sketch")).alias("sketch"))
    open_rows = undecided(rows, ["shingle"]).join(short, ["s1", "s2"])
    columns = (*columns, "sketch")
    alike = differing(F.col("sketch_a"), F.col("sketch_b"), FOLDED) * 9 <= F.col("n_a") + F.col("n_b")
    met = side(open_rows, "a").join(side(open_rows, "b"), "shingle").where(smaller & may_link & alike)
    pairs = land(pairs_of(met, done, classes), "open-pairs")
    links = links.union(edges(verified(pairs, docs, classes, order)))
    return components(links).select(F.col("node.s1").alias("s1"), F.col("node.s2").alias("s2"), "component")


def groups_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n, s1, s2, component``, a row for each row of ``docs``; the last three
    are null without words, ``component`` is the smallest class key reachable."""
    docs = docs.select("doc_id", "text")
    order = docs.sparkSession.sparkContext.broadcast(global_order(docs))
    rows = land(digests(docs, order), "shingle-classes")
    classes = land(
        rows.where("n > 0")
        .groupBy("s1", "s2")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "classes",
    )
    linked = linked_classes(docs, rows, classes, order)
    order.unpersist()  # the components are landed
    return rows.join(linked, ["s1", "s2"], "left").select(
        "doc_id",
        "text_key",
        "n",
        "s1",
        "s2",
        F.when(F.col("n") > 0, F.coalesce("component", F.struct("s1", "s2"))).alias("component"),
    )


def group(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row for each row of ``docs`` (``doc_id, text``).

    A text of fewer than five words has its whole sequence as one shingle; a null, empty or blank
    text has none, links with nothing and is its own component. Texts with equal sets, repeated
    rows among them, are one class. A component is named by its smallest doc_id; null ids are
    left out of that, and the name is null if there is no other. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = land(groups_of(docs), "shingle-groups")
    names = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "component", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but one of each group, all columns as they are.

    The document of the smallest doc_id stays (ids that are not null come first, then the text
    key); of its repeated rows one stays. Texts without words all stay.
    """
    rows = land(groups_of(docs).where("n > 0"), "shingle-groups")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    keepers = rows.groupBy("component").agg(F.min(place).alias("keeper"))
    states = rows.groupBy("component", "doc_id", "text_key").count().join(keepers, "component")
    doc, key = fresh("doc"), fresh("key")
    losers = states.where(place != F.col("keeper")).select("doc_id", "text_key").toDF(doc, key)
    repeated = land(
        states.where((place == F.col("keeper")) & (F.col("count") > 1)).select("doc_id", "text_key").toDF(doc, key), "repeated"
    )

    def same(other: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(other[doc]) & (text_key(docs["text"]) == other[key])

    kept = docs.join(small(losers, PLACES), same(losers), "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(small(repeated, PLACES), same(repeated), "left_semi")
    mark = fresh("mark")
    once = once.withColumn(mark, text_key(F.col("text"))).dropDuplicates(["doc_id", mark]).drop(mark)
    return kept.join(small(repeated, PLACES), same(repeated), "left_anti").unionByName(once)
