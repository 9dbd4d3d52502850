"""Near copies: texts whose sets of five-word shingles have a Jaccard likeness of at least 4/5, found exactly.

Texts with equal sets are one node. Nodes whose SimHash fingerprints (of the five-word shingles) link by pigeonring filtering
are compared first; that finds most copies. A fingerprint can't promise a likeness, so what it misses comes from a prefix
filter: all shingles have one order, rare ones first; of two sets of likeness 4/5 or more, each has a shingle of the other
among its first n - ceil(4 n / 5) + 1 (n: its size). Sets are filed under these with the shingle's place in the order. Two
sets that meet under their first common shingle have no more in common than the rest of either from there on, so pairs
whose rests are too short go, and sets that have too many rarer shingles before it aren't begun with at all. The others are
compared in full unless other links connect them already.

The order comes from all rows: a count-min sketch of fixed size, to which each task adds what it has counted. Whatever the
size of the corpus, a passage that many texts share ranks behind what they don't, so it files them together only if they
have little else.

Where many sets meet, the most central one (that with the largest share of its shingles filed with others) is compared with
all of them first, so a cloud of copies around a text costs as many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, maybe_among, slices, texts_of, written
from tickloom.llm.graph import components
from tickloom.llm.simhash import _LOWER, SEED, first_rows, links, numbered

WORDS = 5
#: Cells of the sketch of how many rows have a shingle (a power of two), and parts in which it is added up.
CELLS, PARTS = 1 << 21, 256
#: Sets under a shingle up to which no central set is sought.
FEW = 16
#: Pairs that a task emits at a time.
EMIT = 100_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def grams(text: str) -> np.ndarray:
    """Hashes of the text's distinct five-word shingles, ascending; fewer words are one shingle, no words are none."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    hashed = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return np.array([hashed(b" ".join(words), SEED)] if words else [], np.uint64)
    h = np.fromiter((hashed(w, SEED) for w in words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    g = np.zeros(n, np.uint64)
    for i in range(WORDS):
        g = (g ^ h[i : i + n]) * _ODD[i]
        g ^= g >> np.uint64(29)
    return np.unique(g)


def cells(g: np.ndarray) -> np.ndarray:
    """The cell of the sketch in which each shingle is counted."""
    return (g >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def first_grams(g: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those of a set's shingles under which it is filed, rare ones first; counts is the sketch."""
    n = len(g)
    return g[np.lexsort((g, counts[cells(g)]))[: n - -(-4 * n // 5) + 1]] if n else g


def bits_of(g: np.ndarray) -> int:
    """SimHash of a set of shingles: the bits that over half of them have; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(g), 4096):
        ones += np.unpackbits(g[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(g), bitorder="little").view("<u8")[0])


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _sketch(rows: DataFrame) -> np.ndarray:
    """How many rows have a shingle of each cell, over all rows. Each task counts in an array; the arrays are added up in parts."""
    width = CELLS // PARTS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        for batch in slices(batches):
            for t in texts_of(batch).to_pylist():
                np.add.at(counts, cells(grams(t)), 1)
        parts = counts.reshape(PARTS, width)
        some = np.flatnonzero(parts.any(1))
        for at in range(0, len(some), 32):
            part = some[at : at + 32]
            # Most counts of a task fit a byte.
            cells_of = [(x if x.max() > 255 else x.astype(np.uint8)).tobytes() for x in parts[part]]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(cells_of, pa.binary())], ["part", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = sums.setdefault(part, np.zeros(width, np.uint64))
                held += np.frombuffer(raw, np.uint8 if len(raw) == width else np.uint32)
        kept = [np.minimum(x, np.iinfo(np.uint32).max).astype(np.uint32).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(kept, pa.binary())], ["part", "counts"])

    kind = "part int, counts binary"
    texts = rows.select(F.col("text").cast("string").alias("text"))
    out = np.zeros((PARTS, width), np.uint32)
    for r in texts.mapInArrow(counted, kind).repartition("part").mapInArrow(added, kind).collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def _sets(rows: DataFrame) -> DataFrame:
    """row, node (hash of the set), fp (its SimHash), n (its size) and filed (shingles under which it is filed) of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(_sketch(rows))  # CELLS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in slices(batches):
            found = [grams(t) for t in texts_of(batch).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(g.tobytes(), SEED) for g in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(node), pa.array(np.array([bits_of(g) for g in found], np.uint64).view(np.int64)),
                    pa.array([len(g) for g in found], pa.int32()),
                    _lists([first_grams(g, counts) for g in found]),
                ],
                ["row", "node", "fp", "n", "filed"],
            )

    return rows.select("row", F.col("text").cast("string").alias("text")).mapInArrow(
        work, "row long, node long, fp long, n int, filed array<long>"
    )


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows (first the key), cut where a key ends: a batch's last key waits for the next batch."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        whole = int(np.searchsorted(held[0], held[0][-1]))
        if whole:
            yield [c[:whole] for c in held]
            held = [c[whole:] for c in held]
    if held is not None:
        yield held


def _shared(nodes: DataFrame) -> DataFrame:
    """key, node, n, place (of the key in the set's order) and size (sets under the key) of all shingles under which two or more are filed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, place in _whole_keys(batches):
            _, at, size = np.unique(key, return_inverse=True, return_counts=True)
            size = size[at]
            keep = size > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[keep]), pa.array(node[keep]), pa.array(n[keep]), pa.array(place[keep]), pa.array(size[keep], pa.int64())],
                ["key", "node", "n", "place", "size"],
            )

    entries = nodes.select(F.posexplode("filed").alias("place", "key"), "node", "n").select("key", "node", "n", "place")
    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(work, "key long, node long, n int, place int, size long")


def _all_pairs(entries: DataFrame) -> DataFrame:
    """a and b: the pairs of sets under a key that may be alike, by their sizes and places, and aren't connected (label) yet."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(parts: list[np.ndarray]) -> pa.RecordBatch:
            found = np.unique(np.concatenate(parts, axis=1), axis=1) if parts else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        parts: list[np.ndarray] = []
        held = 0
        for key, node, n, place, label in _whole_keys(batches):
            # Sorted by size within a key, so the partners of a set are the rows up to the last one that is small enough. The
            # smaller of two sets must have 8/9 of its shingles from the key on.
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            begin = 0
            for end in ends.tolist():
                size, who, group = n[begin:end].astype(np.int64), node[begin:end], label[begin:end]
                last = np.searchsorted(size, 5 * size // 4, side="right")
                rest = size - place[begin:end]
                for i in np.flatnonzero(9 * rest >= 8 * size)[: end - begin - 1].tolist():
                    others = slice(i + 1, int(last[i]))
                    apart = (group[others] != group[i]) & (9 * np.minimum(rest[others], rest[i]) >= 4 * (size[others] + size[i]))
                    b = who[others][apart]
                    if len(b):
                        a = np.full(len(b), who[i])
                        parts.append(np.stack((np.minimum(a, b), np.maximum(a, b))))
                        held += len(b)
                        if held >= EMIT:
                            yield batch(parts)
                            parts, held = [], 0
                begin = end
        yield batch(parts)

    rows = entries.select("key", "node", "n", "place", "label").repartition("key").sortWithinPartitions("key", "n")
    return rows.mapInArrow(work, "a long, b long").distinct()


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose likeness is 4/5 or more, by all shingles of both."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    # Copies of a set are combined before they meet what is asked for.
    asked = sets.groupBy("node").agg(F.min("row").alias("row")).join(asked, "node", "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _lists([grams(t) for t in texts_of(batch).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("node"), found], ["node", "grams"])

    asked = cut(asked.select("node", "row"))
    some = rows.select("row", F.col("text").cast("string").alias("text")).where(maybe_among(asked, "row")(F.col("row")))
    texts = some.join(asked, "row").select("node", "text")
    full = written(texts.mapInArrow(work, "node long, grams array<long>"))
    left = full.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = full.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return both.where(9 * F.col("both") >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _simhash_pairs(sets: DataFrame) -> DataFrame:
    """a and b: pairs of nodes that have one fingerprint or whose fingerprints link (a spanning forest of them)."""
    of_fp = cut(sets.select("fp", "node").distinct())
    first = cut(of_fp.groupBy("fp").agg(F.min("node").alias("a")))
    same = of_fp.join(first, "fp").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))
    met = links(first, contract=False).distinct()
    left = first.select(F.col("fp").alias("a"), F.col("a").alias("x"))
    right = first.select(F.col("fp").alias("b"), F.col("a").alias("y"))
    met = met.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.union(met.where("a <> b")).distinct()


def near_components(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """node and root of the sets that are connected to others, but for the roots (see graph.components).

    rows: row and text; sets: what _sets() gives for them.
    """
    nodes = sets.groupBy("node").agg(F.first("n").alias("n"), F.first("filed").alias("filed"))
    entries = cut(_shared(nodes))
    central = entries.groupBy("node").agg((F.count("*") / F.max(F.col("n") - F.ceil(4 * F.col("n") / 5) + 1)).alias("central"))
    entries = cut(entries.join(central, "node"))
    # First the pairs by fingerprints, and those of central sets; then all pairs that these leave unconnected.
    many = entries.where(F.col("size") > FEW)
    top = cut(many.groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("central", "node")).alias("top")))
    met = many.join(top, "key").where(
        (F.col("node") != F.col("top.node")) & (5 * F.col("n") >= 4 * F.col("top.n")) & (4 * F.col("n") <= 5 * F.col("top.n"))
    )
    around = met.select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b"))
    found = cut(_verified(cut(_simhash_pairs(sets).union(around).distinct()), rows, sets))
    hung = components(found)
    labelled = entries.join(hung, "node", "left").withColumn("label", F.coalesce("root", "node"))
    pairs = cut(_all_pairs(labelled))
    if pairs.isEmpty():
        return hung
    # What is connected already comes as stars, which are few steps deep.
    return components(hung.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_verified(pairs, rows, sets)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near copies, whatever its doc_id: that of the smallest doc_id (null last).

    Words are what ASCII white space separates, ASCII letters in lower case. Rows without words (null, empty) are one
    component; equal texts are. An empty table stays empty; all columns stay, whatever their names. Whole texts count.
    """
    whole, name = numbered(docs)
    rows = whole.select(F.col(name).alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    sets = written(_sets(rows))
    hung = near_components(rows, sets)
    placed = sets.select("row", "node").join(rows.select("row", "doc_id"), "row")
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    # Copies are combined before the join, so a text in a third of all rows is small.
    firsts = placed.groupBy("node").agg(F.min(place).alias("first")).select("node", "first.doc_id", "first.row")
    found = firsts.join(hung, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("component"))
    return first_rows(whole, name, found)
