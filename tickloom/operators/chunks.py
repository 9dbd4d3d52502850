"""Ordered work inside one symbol on many tasks.

A window over a symbol's whole history is one task, however long the history. Here rows are numbered in two passes (counts of
time buckets, then rows inside their bucket), cut into chunks of so many rows, and each chunk is worked on alone: with the
rows of a halo before it, with the last value that earlier chunks carry to it, or, for automata, with the state that the
composed maps of earlier chunks give. What passes between chunks is a row for each chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, IntegralType, StructField, StructType
from pyspark.sql.window import Window

KEY, TIME = "symbol", "opentime"
#: Rows of a chunk, seconds of a bucket of times, and the span of a bucket of numbers.
CHUNK, BUCKET_SECONDS, BUCKET_SPAN = 1 << 15, 86_400, 1 << 14


def bucket(at: Column, kind: DataType) -> Column:
    """Number of the bucket that a time or an integer lies in; buckets are in the order of the values."""
    if isinstance(kind, IntegralType):
        return F.floor(at / BUCKET_SPAN)
    return F.floor(F.unix_seconds(at.cast("timestamp")) / BUCKET_SECONDS)


def numbered(df: DataFrame, keys: Sequence[str] = (KEY,), by: str = TIME, name: str = "rn") -> DataFrame:
    """df with the rows of each key numbered from 1 by time. No task gets more than a bucket of a key."""
    # One key for a bucket, so that window, counts and join find the rows where one exchange put them; in a struct nulls are equal.
    whole = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], bucket(F.col(by), df.schema[by].dataType).alias("b"))
    rows = df.drop(name).withColumn("_bucket_key", whole).repartition("_bucket_key")
    counts = rows.groupBy("_bucket_key").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*[F.col(f"_bucket_key.k{i}") for i in range(len(keys))]).orderBy("_bucket_key.b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_bucket_key", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"))
    rows = rows.withColumn("_inside", F.row_number().over(Window.partitionBy("_bucket_key").orderBy(by)))
    kept = [F.col(c) for c in df.columns if c != name]
    return rows.join(counts, "_bucket_key").select(*kept, (F.col("_inside") + F.col("_rows_before")).cast("int").alias(name))


def _schema(df: DataFrame, *more: tuple[str, DataType], without: Sequence[str] = ()) -> StructType:
    names = {n for n, _ in more}
    return StructType([f for f in df.schema if f.name not in names and f.name not in without] + [StructField(n, k) for n, k in more])


def with_halo(
    df: DataFrame, halo: int, work: Callable[[pa.Table], dict[str, pa.Array]], kinds: Sequence[tuple[str, DataType]],
    keys: Sequence[str] = (KEY,), by: str = TIME,
) -> DataFrame:
    """df with the columns that work computes for each row from it and the halo rows before it.

    work gets the rows of a chunk in order, those of the halo first (fewer at the start of a key), and gives as many
    values of each column; those of the halo rows are dropped. A chunk has CHUNK rows, and at least as many as the halo,
    so a row goes to two chunks at most.
    """
    size = max(CHUNK, halo)
    rows = numbered(df, keys, by, "_row")
    chunk, last = F.floor((F.col("_row") - 1) / size), F.floor((F.col("_row") - 1 + halo) / size)
    rows = rows.withColumn("_own", chunk).withColumn("_chunk", F.explode(F.sequence(chunk, last)))
    schema = _schema(df, *kinds)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        columns = work(table)
        own = pa.array(table.column("_own").to_numpy() == table.column("_chunk").to_numpy())
        out = [columns[f.name] if f.name in columns else table.column(f.name) for f in schema]
        return pa.Table.from_arrays(out, [f.name for f in schema]).filter(own)

    return rows.groupBy(*keys, "_chunk").applyInArrow(run, schema)


# ---------------------------------------------------------------- carried values


def carried(rows: DataFrame, key: str, at: str, tie: Sequence[Column], values: dict[str, tuple[str, bool]]) -> DataFrame:
    """rows with, for each name, the last value of its source column at or before the row that isn't null (forward: the first at or after).

    values: name to (source column, forward). Rows are in the order of at, then tie. Each bucket of a key is one window;
    the last and first values of buckets are carried over the buckets, which are few, and joined to their rows. To look ahead,
    rows are passed in the opposite order: Spark goes through a frame up to the end anew for each row, a running one once.
    """
    names = list(rows.columns)
    whole = F.struct(F.col(key).alias("k"), bucket(F.col(at), rows.schema[at].dataType).alias("b"))
    rows = rows.withColumn("_bucket", whole).repartition("_bucket")
    inside = Window.partitionBy("_bucket").orderBy(at, *tie)
    against = Window.partitionBy("_bucket").orderBy(F.desc(at), *[t.desc() for t in tie])
    some, ends = {}, {}
    order = F.struct(F.col(at), *[t.alias(f"t{i}") for i, t in enumerate(tie)])
    for name, (source, forward) in values.items():
        some[name] = F.last(source, ignorenulls=True).over((against if forward else inside).rowsBetween(Window.unboundedPreceding, 0))
        place = F.when(F.col(source).isNotNull(), order)
        ends[name] = (F.min_by if forward else F.max_by)(F.col(source), place)
    over = rows.groupBy("_bucket").agg(*[v.alias(f"_e_{n}") for n, v in ends.items()])
    for name, (_, forward) in values.items():
        buckets = Window.partitionBy("_bucket.k").orderBy(F.desc("_bucket.b") if forward else F.asc("_bucket.b"))
        over = over.withColumn(f"_c_{name}", F.last(f"_e_{name}", ignorenulls=True).over(buckets.rowsBetween(Window.unboundedPreceding, -1)))
    found = rows.withColumns(some).join(over.select("_bucket", *[f"_c_{n}" for n in values]), "_bucket")
    return found.select(*[c for c in names if c not in values], *[F.coalesce(n, f"_c_{n}").alias(n) for n in values])


# ---------------------------------------------------------------- automata


def composed(maps: np.ndarray) -> np.ndarray:
    """The map of all rows' maps one after another: state before the first row to state after the last."""
    n, states = maps.shape
    now = maps
    while len(now) > 1:
        if len(now) % 2:
            now = np.concatenate((now, np.arange(states, dtype=now.dtype)[None]))
        now = np.take_along_axis(now[1::2], now[0::2].astype(np.int64), axis=1)
    return now[0] if n else np.arange(states, dtype=maps.dtype)


def walked(maps: np.ndarray, entry: int) -> np.ndarray:
    """The state before each row. Blocks of rows are passed side by side, first for their exits, then with their entries."""
    n, states = maps.shape
    if not n:
        return np.zeros(0, maps.dtype)
    length = max(1, int(n**0.5))
    count = -(-n // length)
    padded = np.concatenate((maps, np.broadcast_to(np.arange(states, dtype=maps.dtype), (count * length - n, states)))).reshape(count, length, states)
    exits = np.broadcast_to(np.arange(states), (count, states))
    for j in range(length):
        exits = np.take_along_axis(padded[:, j], exits, axis=1).astype(np.int64)
    entries = np.empty(count, np.int64)
    for i in range(count):
        entries[i] = entry
        entry = int(exits[i, entry])
    out = np.empty((count, length), maps.dtype)
    at, row = entries, np.arange(count)
    for j in range(length):
        out[:, j] = at
        at = padded[row, j, at].astype(np.int64)
    return out.ravel()[:n]


Rule = Callable[[pa.Table, int], np.ndarray]


def automata(
    df: DataFrame, lanes: int, states: int, rule: Rule, emit: Callable[[pa.Table, int, np.ndarray], pa.Table], schema: StructType,
    keys: Sequence[str] = (KEY,), by: str = TIME,
) -> DataFrame:
    """What emit gives for each lane and chunk from its rows in order and the state before each of them.

    rule gives, for rows and a lane, the state after each row by the state before it (rows x states, small integers); a lane
    begins in state 0. Lanes (configurations of one rule) share the rows, which are shuffled once, however many there are.
    Each chunk of a key gives the map of all its rows; the maps are composed in order, a row for each chunk; then chunks are
    walked through side by side, each from its own entry.
    """
    rows = (df if "_row" in df.columns else numbered(df, keys, by, "_row")).withColumn("_chunk", F.floor((F.col("_row") - 1) / CHUNK))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    parts = [*keys, "_chunk"]

    def exits(table: pa.Table) -> pa.Table:
        rows_in_order = table.sort_by("_row")
        whole = np.concatenate([composed(rule(rows_in_order, lane)) for lane in range(lanes)]).astype(np.uint8)
        first = [table.column(c).slice(0, 1).combine_chunks() for c in parts]
        return pa.Table.from_arrays([*first, pa.array([whole.tobytes()])], [*parts, "exits"])

    def entered(table: pa.Table) -> pa.Table:
        table, now, found = table.sort_by("_chunk"), np.zeros(lanes, np.int64), []
        for raw in table.column("exits").to_pylist():
            found.append(now.astype(np.uint8).tobytes())
            now = np.frombuffer(raw, np.uint8).reshape(lanes, states)[np.arange(lanes), now].astype(np.int64)
        return pa.Table.from_arrays([*[table.column(c) for c in parts], pa.array(found)], [*parts, "entry"])

    def walk(table: pa.Table, entry: pa.Table) -> pa.Table:
        table, first = table.sort_by("_row"), np.frombuffer(entry.column("entry")[0].as_py(), np.uint8)
        return pa.concat_tables([emit(table, lane, walked(rule(table, lane), int(first[lane]))) for lane in range(lanes)])

    entries = rows.groupBy(*parts).applyInArrow(exits, f"{kinds}, _chunk long, exits binary")
    entries = entries.groupBy(*keys).applyInArrow(entered, f"{kinds}, _chunk long, entry binary")
    return rows.groupBy(*parts).cogroup(entries.groupBy(*parts)).applyInArrow(walk, schema)


def with_output(
    df: DataFrame, states: int, rule: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], name: str, keys: Sequence[str] = (KEY,), by: str = TIME
) -> DataFrame:
    """df with the output of an automaton at each row: rule gives the state after and the output (an integer) by row and state before."""
    schema = _schema(df, (name, IntegerType()))

    def emit(table: pa.Table, lane: int, state: np.ndarray) -> pa.Table:
        out = rule(table)[1][np.arange(table.num_rows), state]
        cells = [pa.array(out.astype(np.int32)) if f.name == name else table.column(f.name) for f in schema]
        return pa.Table.from_arrays(cells, [f.name for f in schema])

    return automata(df, 1, states, lambda table, lane: rule(table)[0], emit, schema, keys, by)


# ---------------------------------------------------------------- order statistics


class Ranks:
    """Order statistics of all windows of a sequence: its values' ranks in one bit plane for each digit, highest first.

    The rows of a window that have a zero in the highest bit are one stretch of the next plane, those that have a one are
    another, so the k-th smallest of a window takes as many steps as a rank has bits, for all windows at once.
    """

    def __init__(self, values: np.ndarray):
        self.values, n = np.sort(values, kind="stable"), len(values)
        rank = np.empty(n, np.int64)
        rank[np.argsort(values, kind="stable")] = np.arange(n)
        self.bits = max(1, (n - 1).bit_length())
        self.zeros, self.count = [], []
        for b in range(self.bits - 1, -1, -1):
            zero = (rank >> b) & 1 == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(zero))))
            self.count.append(int(zero.sum()))
            rank = np.concatenate((rank[zero], rank[~zero]))

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th (from 0) smallest value of the places low to high - 1, for each window."""
        low, high, k = low.copy(), high.copy(), k.copy()
        rank = np.zeros(len(low), np.int64)
        for i, (zeros, count) in enumerate(zip(self.zeros, self.count, strict=True)):
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            rank |= one.astype(np.int64) << (self.bits - 1 - i)
            low, high = np.where(one, count + low - a, a), np.where(one, count + high - b, b)
        return self.values[rank]


def medians(values: np.ndarray, w: int) -> np.ndarray:
    """Median of the last w values (fewer at the start) that aren't missing (NaN); NaN without any."""
    known = ~np.isnan(values)
    upto = np.concatenate(([0], np.cumsum(known)))
    low, high = upto[np.maximum(np.arange(len(values)) + 1 - w, 0)], upto[1:]
    out, some = np.full(len(values), np.nan), high > low
    if some.any():
        ranks, n = Ranks(values[known]), (high - low)[some]
        a, b = ranks.smallest(low[some], high[some], (n - 1) // 2), ranks.smallest(low[some], high[some], n // 2)
        out[some] = a + (b - a) * 0.5
    return out
