"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows lie in input partitions. How many rows of each partition go to each shard is drawn from the multivariate
   hypergeometric law with the partition counts and the exact shard sizes as margins: the law that a uniform shuffle of
   all rows would give.
2. Each partition permutes its rows where they lie and deals them out by these counts.
3. Each shard permutes what it received and numbers it (the one exchange of rows). A shard is permuted in blocks, so that
   no task holds a shard: a row's block and place in it come from the same random key.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import cut

#: Cells of the matrix, which the driver draws and broadcasts; an input of more partitions is read in fewer.
CELLS = 1 << 22
#: numpy draws from populations below this. Beyond it log_hypergeometric() keeps the digits that numpy's formula loses.
NUMPY_BELOW = 1_000_000_000


def exact_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def _stirling_error(n: int) -> float:
    """log n! less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    x = 1 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - x / 1188) * x) * x) * x) / n


def _deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation near the mean."""
    d = x - mean
    if abs(d) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x if x else mean
    v = d / (x + mean)
    total, term, k = d * v, 2 * x * v, 1
    while True:
        term *= v * v
        k += 2
        if total + term / k == total:
            return total
        total += term / k


def _log_binomial(x: int, n: int, p: float) -> float:
    """log of the binomial probability by the saddle point, right to the last digits for any n."""
    if x == 0 or x == n:
        return n * (math.log1p(-p) if x == 0 else math.log(p)) if n else 0.0
    rest = n - x
    return (
        _stirling_error(n) - _stirling_error(x) - _stirling_error(rest) - _deviance(x, n * p) - _deviance(rest, n * (1 - p))
        + 0.5 * math.log(n / (2 * math.pi * x) / rest)
    )


def log_hypergeometric(x: int, good: int, bad: int, taken: int) -> float:
    """log of the probability of x good ones among those taken."""
    p = taken / (good + bad)
    return _log_binomial(x, good, p) + _log_binomial(taken - x, bad, p) - _log_binomial(taken, good + bad, p)


def draw(rng: np.random.Generator, good: int, bad: int, taken: int, numpy_below: int = NUMPY_BELOW) -> int:
    """Good ones among those taken from good and bad ones: the same law for any numbers.

    Large populations are drawn by the ratio of uniforms: points of a box are accepted that lie under the law's curve.
    """
    low, high = max(0, taken - bad), min(good, taken)
    if low == high:
        return low
    n = good + bad
    if n < numpy_below:
        return int(rng.hypergeometric(good, bad, taken))
    mode = min(high, max(low, (taken + 1) * (good + 1) // (n + 2)))
    top = log_hypergeometric(mode, good, bad, taken)
    center = taken * (good / n) + 0.5
    spread = math.sqrt(taken * (good / n) * (bad / n) * ((n - taken) / (n - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(center + width * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= log_hypergeometric(x, good, bad, taken) - top:
            return x


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows: partitions, columns: shards; row sums are counts, column sums are sizes."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = [int(x) for x in sizes]
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, count in enumerate(counts):
        rest = sum(left)
        for s, size in enumerate(left):
            rest -= size
            out[p, s] = n = draw(rng, size, rest, count)
            left[s] -= n
            count -= n
    return out


def shard(docs: DataFrame, shards: int = 40, seed: int = 17, blocks: int = 64) -> DataFrame:
    """All columns of docs, shard (int) and slot (long, gapless from 0 in each shard).

    Every row is placed, repeated rows and rows with null columns too: a row is known by its place in the input, not by
    its values, so a hot key, a long text or ties have no effect. Shard sizes differ by one at most; an empty table gives
    none. The row numbers are written to the checkpoint folder before anything is drawn from them, so a lost executor
    can't change a place. Columns of docs named shard or slot are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).coalesce(max(1, CELLS // shards))
    # Sorted by a random key within its partition, a row's number in it is its place in the local permutation.
    rows = rows.withColumn("number", F.monotonically_increasing_id())
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "number")).sortWithinPartitions("key", "number")
    place = F.monotonically_increasing_id()
    rows = cut(rows.select("row", "number", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("rank")))
    counted = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counted)
    matrix = communication_matrix([counted[p] for p in parts], exact_sizes(sum(counted.values()), shards), seed)
    cuts = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(m)]) for p, m in zip(parts, matrix, strict=True)], "part int, cuts array<long>"
    )
    placed = cut(
        rows.join(F.broadcast(cuts), "part")  # at most CELLS numbers
        .withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("rank"))))
        .withColumn("key", F.xxhash64(F.lit(seed + 1), "number"))
        .withColumn("block", F.pmod(F.col("key"), F.lit(blocks)).cast("int"))
        .select("row", "number", "shard", "block", "key")
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "block")
        .agg(F.count("*").alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "block").orderBy("key", "number")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "block"])  # shards x blocks rows
        .select("row.*", F.col("shard").cast("int"), (F.col("start") + F.col("place")).cast("long").alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """shard() for documents, with the size and checksum of the text instead of the text (null text: empty)."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = docs.select("doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
