"""Document fingerprints by locally consistent parsing.

A text's symbols get labels by deterministic coin tossing: each symbol is compared with its left neighbour, and the
lowest bit in which they differ, with its value, is the label; after a few rounds few labels are left and neighbours
still differ. Blocks begin at local maxima of the labels. A block's name is a hash of its symbols, and the names are
parsed in the same way, level by level. Whether a block begins somewhere depends on a few neighbours only, so equal
substrings have equal names inside, wherever they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import slices, texts_of

#: Slots of a fingerprint, four hex digits each; EMPTY marks a slot that no name fell into.
SLOTS, EMPTY = 64, 0xFFFF
#: Names from this level on make the fingerprint; of texts that end earlier, the last name.
LEVEL = 2
TOSSES = 4
#: Bytes of text that are parsed at a time: the parse holds some sixty bytes for each character.
SLICE = 1 << 20
#: Documents of a range that one task reads in order, ranges at most, and rows that are sampled for each to find its bounds.
RANGE_ROWS, RANGES, SAMPLED = 1000, 65536, 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels from the lowest bit in which a symbol differs from its left neighbour; a text's first symbol has none."""
    one = x.dtype.type(1)
    apart = x.copy()
    apart[1:] ^= x[:-1]
    apart[first] = one
    low = np.bitwise_count((apart & (~apart + one)) - one)
    return (low << np.uint8(1)) | ((x >> low.astype(x.dtype)) & one).astype(np.uint8)


def signatures(texts: list[str]) -> np.ndarray:
    """One row of SLOTS values for each text; each depends on its own text only."""
    out = np.full(len(texts) * SLOTS, EMPTY, np.uint16)
    name = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    level = 0
    while len(name):
        # A run of a symbol is one symbol.
        first = np.concatenate(([True], text[1:] != text[:-1]))
        begins = np.flatnonzero(first | np.concatenate(([True], name[1:] != name[:-1])))
        if len(begins) < len(name):
            length = np.diff(np.append(begins, len(name)))
            name, text, first = name[begins], text[begins], first[begins]
            runs = np.flatnonzero(length > 1)
            name[runs] = _mixed(name[runs] * np.uint64(2) + _mixed(length[runs].astype(np.uint64)))
        label = _toss(name, first)
        for _ in range(TOSSES - 1):
            label = _toss(label, first)
        # Blocks begin at a text's first symbol and at local maxima.
        last = np.append(first[1:], True)
        higher = np.ones(len(name), bool)
        higher[1:] = label[1:] > label[:-1]
        falls = np.ones(len(name), bool)
        falls[:-1] = (label[:-1] > label[1:]) | last[:-1]
        starts = np.flatnonzero(first | (higher & falls))
        place = np.arange(len(name)) - np.repeat(starts, np.diff(np.append(starts, len(name))))
        summed = np.add.reduceat(_mixed(name + place.astype(np.uint64) * _M2), starts)
        name, text = _mixed(summed), text[starts]
        level += 1
        # A text of one block is done; its name counts at any level.
        single = np.concatenate(([True], text[1:] != text[:-1])) & np.append(text[1:] != text[:-1], True)
        value, owner = (name, text) if level >= LEVEL else (name[single], text[single])
        slot = owner * SLOTS + (value & np.uint64(SLOTS - 1)).astype(np.int64)
        np.minimum.at(out, slot, ((value >> np.uint64(6)) % np.uint64(EMPTY)).astype(np.uint16))
        name, text = name[~single], text[~single]
    return out.reshape(len(texts), SLOTS)


def shown(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either has filled; 1 if both are empty."""
    some = (a != EMPTY) | (b != EMPTY)
    same = (a == b) & some
    filled = some.sum(1)
    return np.where(filled, same.sum(1) / np.maximum(filled, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _keyed(docs: DataFrame) -> DataFrame:
    """key, tie, salt, doc_id and text: rows are in the order of the first two, and salt parts rows that both leave equal."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    salt = F.xxhash64(F.monotonically_increasing_id())
    return docs.select(key.alias("key"), F.xxhash64(text).alias("tie"), salt.alias("salt"), "doc_id", text.alias("text"))


def _bounds(rows: DataFrame) -> np.ndarray:
    """Bounds (key, tie, salt) of ranges with about RANGE_ROWS rows each, from a sample of SAMPLED rows for each range."""
    total = rows.count()
    count = min(RANGES, max(1, total // RANGE_ROWS))
    if count == 1:
        return np.zeros((0, 3), np.int64)
    some = rows.select("key", "tie", "salt").sample(min(1.0, SAMPLED * count / total), 5).toArrow()
    found = np.stack([some.column(c).to_numpy() for c in ("key", "tie", "salt")], axis=1)
    found = found[np.lexsort(found.T[::-1])]
    return np.unique(found[(np.arange(1, count) * len(found)) // count], axis=0) if len(found) else np.zeros((0, 3), np.int64)


def _ranges(bounds: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """The range of each row: how many bounds aren't above it."""
    key, tie, salt = (batch.column(c).to_numpy() for c in ("key", "tie", "salt"))
    low, high = (np.searchsorted(bounds[:, 0], key, side=side) for side in ("left", "right"))
    for i in np.flatnonzero(low < high).tolist():  # a bound within the rows of this key
        part = bounds[low[i] : high[i]]
        a, b = (int(np.searchsorted(part[:, 1], tie[i], side=side)) for side in ("left", "right"))
        high[i] = low[i] + a + int(np.searchsorted(part[a:b, 2], salt[i], side="right"))
    return high.astype(np.int32)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    The next document is the next one by doc_id (null ids first; ties by a hash of the text, so repeated rows follow each
    other), after the last the first; a single row is its own next. Null texts are empty: their fingerprints have no filled
    slot and are alike. An empty table gives no rows; whole texts count; columns other than doc_id and text aren't used.

    Texts are shuffled once, by ranges of doc_id, hash and, for repeated rows, a number, so that no id or text with a large
    share of all rows lies in one range; the first row of each range goes to the end of the range before as well, so each
    task reads its rows in order, a slice at a time. The driver holds the bounds of the ranges and the ids and hashes of
    their first rows, at most RANGES, and a sample of SAMPLED times as many numbers.
    """
    rows = _keyed(docs)
    bounds = _bounds(rows)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_ranges(bounds, batch)), batch.column("key"), batch.column("tie")], ["range", "key", "tie"])

    heads = rows.select("key", "tie", "salt").mapInArrow(located, "range int, key long, tie long").groupBy("range").agg(F.min(F.struct("key", "tie")).alias("first"))
    heads = sorted((r["range"], (r["first"]["key"], r["first"]["tie"])) for r in heads.collect())
    # The ranges after which a first row comes: all from the last one with rows on, should numbers of equal rows come out otherwise.
    before: dict[tuple[int, int], list[int]] = {}
    for i, (at, first) in enumerate(heads):
        since = range(heads[i - 1][0], at) if i else [*range(heads[-1][0], len(bounds) + 1), *range(at)]
        before.setdefault(first, []).extend(since)

    names = ["range", "tail", *rows.columns]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = _ranges(bounds, batch), batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(n, np.int32)), *batch.columns], names)
            firsts: dict[tuple[int, int], int] = {}
            for i, first in enumerate(zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist(), strict=True)):
                if first in before:
                    firsts.setdefault(first, i)
            for first, i in firsts.items():
                one = batch.take(pa.array(np.full(len(before[first]), i)))
                yield pa.RecordBatch.from_arrays([pa.array(before[first], pa.int32()), pa.array(np.ones(len(one), np.int32)), *one.columns], names)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches, limit=SLICE):
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if batch.num_rows > 1:
                yield _described(batch)
            held = batch.slice(batch.num_rows - 1)

    sorted_rows = rows.mapInArrow(dealt, "range int, tail int, key long, tie long, salt long, doc_id long, text string").drop("salt")
    sorted_rows = sorted_rows.repartition("range").sortWithinPartitions("range", "tail", "key", "tie", "text")
    return sorted_rows.mapInArrow(
        paired,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _described(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of all but the last row of the batch, each with the one after it; copies of first rows aren't described."""
    texts = texts_of(batch).to_pylist()
    real = np.flatnonzero(batch.column("tail").to_numpy()[:-1] == 0)
    changed = [edited(texts[i], texts[i + 1]) for i in real.tolist()]
    own, new = signatures(texts), signatures(changed)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(pa.array(real)),
            pa.array([len(texts[i]) for i in real.tolist()], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(shown(own[real]), pa.string()),
            pa.array(shown(new), pa.string()),
            pa.array(likeness(own[real], new), pa.float64()),
            pa.array(likeness(own[real], own[real + 1]), pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
