"""Best-fit packing with certified bin counts.

Token pieces are dealt into groups of bounded size and each group is packed by best-fit decreasing. Lower bounds from
dual-feasible functions tell whether a group's bin count is proved minimal. Groups with a gap release their emptiest
bins, groups without one only the emptiest; what is released is exchanged between groups and packed anew, until the rest
fits into one small group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bpe import KNOWN_BYTES, SLICE, WORD_BPE, chunk_encoder, encoded_chunks
from tickloom.llm.common import cut, slices, texts_of

CAPACITY = 4096
#: Pieces of a group in the first and in the later exchanges; a rest of LAST pieces makes one group.
FIRST, LATER, LAST = 4000, 400, 280
#: Exchanges at most; what the last one packs stays.
ROUNDS = 8


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The bins that these lengths need at least."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of several dual-feasible bounds on the bins that count[n] pieces of each length n need.

    Rounding by a threshold a: lengths over capacity - a count as a whole bin, those under a as nothing, others as they
    are (a = 0: the plain volume). Stepping by k: a length counts as floor((k + 1) length / capacity) / k of a bin,
    unless (k + 1) length / capacity is whole.
    """
    volume = count * np.arange(capacity + 1)
    many, much = np.cumsum(count), np.cumsum(volume)
    a = np.arange(capacity // 2 + 1)
    below = np.concatenate(([0], much))[a]
    rounded = (much[capacity - a] - below) + capacity * (many[-1] - many[capacity - a])
    best = -(-int(rounded.max()) // capacity)
    x = np.arange(capacity + 1)
    for k in range(1, 33):
        steps, odd = np.divmod((k + 1) * x, capacity)
        weight = np.where(odd == 0, k * x, steps * capacity)
        best = max(best, -(-int((count * weight).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece (ties by position), and the room left in each bin."""
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    rooms: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = some >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                some ^= 1 << room
        else:
            room, at = capacity, len(rooms)
            rooms.append(capacity)
        bins[i], offsets[i] = at, capacity - room
        room -= n
        rooms[at] = room
        by_room[room].append(at)
        some |= 1 << room
    return bins, offsets, np.array(rooms, np.int64)


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = 1, name: str = WORD_BPE, slice_bytes: int = SLICE, known_bytes: int = KNOWN_BYTES
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the token pieces of each row.

    slice_bytes and known_bytes bound the memory of a worker: the text that it encodes at a time, and the words that it
    remembers.

    A row's ids are those of its text (null: empty) and end_id; only rows longer than the capacity are cut.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(name)
        encoder.limit = known_bytes
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in slices(batches, limit=slice_bytes):
            numbers, distinct = encoded_chunks(texts_of(batch), encoder)
            row, piece, start, length, crc = [], [], [], [], []
            for i, at in enumerate(numbers):
                ids = b"".join([distinct[k] for k in at]) + end
                for k, b in enumerate(range(0, len(ids), step)):
                    part = ids[b : b + step]
                    row.append(i)
                    piece.append(k)
                    start.append(b // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def _pack_group(capacity: int, exchange: int, last: bool):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["number", "piece"], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, rooms = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        gap = len(rooms) - bound
        order = np.argsort(-rooms, kind="stable")
        release = order[: 1 + 4 * gap]
        open_bins = np.zeros(len(rooms), bool)
        if not last:
            open_bins[release[rooms[release] > 0]] = True
        group["open"] = open_bins[bins]
        group["sequence_id"] = (exchange << 58) + (int(group["share"].iloc[0]) << 16) + bins
        group["offset"] = offsets
        group["group_bins"], group["group_bound"] = len(rooms), bound
        return group

    return work


def pack(
    docs: DataFrame, capacity: int = CAPACITY, seed: int = 23, name: str = WORD_BPE, slice_bytes: int = SLICE, known_bytes: int = KNOWN_BYTES
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row, and its group's certificate.

    group_bins and group_bound are the bins of the group in which a piece found its place (those that it released for the
    next exchange included) and the bins that its pieces need at least; equal ones prove the group's count minimal.
        Null and empty texts still have their end id and are packed; repeated rows are packed one by one; an empty table
    gives no rows. Pieces are dealt by their place in the input, so equal keys or texts don't meet in one task. No group
    exceeds a few thousand pieces, whatever the input. Each exchange is written to the checkpoint folder.
    """
    cells = "doc_id long, piece int, start long, length long, ids_crc32 long, number long"
    out = f"{cells}, share long, open boolean, sequence_id long, offset long, group_bins int, group_bound int"
    names = [c.split()[0] for c in cells.split(", ")]
    pool = cut(pieces(docs, capacity, name=name, slice_bytes=slice_bytes, known_bytes=known_bytes).withColumn("number", F.monotonically_increasing_id()))
    left, settled = pool.count(), []
    for exchange in range(ROUNDS):
        size = LAST if left <= LAST else FIRST if not exchange else LATER
        last = left <= LAST or exchange == ROUNDS - 1
        share = F.pmod(F.xxhash64(F.lit(seed + exchange), "number", "piece"), F.lit(max(1, -(-left // size))))
        packed = pool.select(*names).withColumn("share", share)
        packed = cut(packed.groupBy("share").applyInPandas(_pack_group(capacity, exchange, last), out))
        settled.append(packed.filter(~F.col("open")))
        pool = packed.filter("open")
        if last or not (left := pool.count()):
            break
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "group_bins", "group_bound")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for a whole packing: sequences, bound (the sequences that its pieces need at least) and gap.

    The bound comes from the counts of pieces by length, so at most capacity rows reach the driver. A gap of 0 proves that
    no packing has fewer sequences. An empty packing has 0, 0 and 0.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():
        count[length] = n
    bound = bound_of_counts(count, capacity)
    used = packed.agg(F.countDistinct("sequence_id").alias("sequences"))
    return used.select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).alias("gap"))
