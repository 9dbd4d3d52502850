"""Training tables: partitions into sets, sequences, buckets, weights, predictions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import cycle, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.joins import in_some_range, with_range
from tickloom.operators.windows import KEY, TIME


def partition_size(rows: int, pattern: Sequence[str], size: int, least: int, most: int) -> int:
    """Size adapted to the rows that whole patterns leave over."""
    k = len(pattern)
    whole = size * k + sum(pattern[i] != pattern[(i + 1) % k] for i in range(k))
    over = round(rows % whole / k)
    return max(over - 1, least) if rows < whole else min(size + over, most)


def partition_plan(rows: int, pattern: Sequence[str], size: int, gap: int, least: int, most: int) -> list[tuple[str, int, int]]:
    """(set, first, last) of 1-based row ranges; none if the rows don't hold the pattern once.

    The pattern repeats; neighbours of one set, also across its ends, are one range; a gap lies before each other one.
    A partition isn't begun for the very last row alone.
    """
    if rows < size * len(pattern):
        return []
    use = partition_size(rows, pattern, size, least, most)
    out: list[tuple[str, int, int]] = []
    end = 0
    for name, run in groupby(cycle(pattern)):
        first = end + 1 + (gap if out else 0)
        if end + 1 >= rows or first > rows:
            return out
        last, end = first, first - 1
        for _ in run:  # endless if there is one set only
            if end >= first and end + 1 >= rows:
                break
            end += use
            last = min(end, rows)
        out.append((name, first, last))
    return out


def shared_plan(rows: int, shares: Sequence[tuple[str, float]], relative: float, gap: int) -> list[tuple[str, int, int]]:
    """The older form: sets in turn, their sizes in proportion to their shares, the smallest one about relative of all
    rows; gaps are at most a third of that."""
    if relative * rows <= 2 * gap:
        gap = int(relative * rows / 3)
    least = min(share for _, share in shares)
    scale = [relative * share / least for _, share in shares]
    spread = rows - gap * int(len(scale) / sum(scale))
    out: list[tuple[str, int, int]] = []
    for (name, _), part in cycle(list(zip(shares, scale, strict=True))):
        first = out[-1][2] + 1 + gap if out else 1
        if first > rows:
            return out
        out.append((name, first, min(rows, first + max(1, round(spread * part)) - 1)))
    return out


def _assigned(df: DataFrame, plan, keys: Sequence[str]) -> DataFrame:
    """Rows (numbered by rn in their keys) with set and rangeid; rows in gaps are dropped. One small row for each range."""
    lengths = df.groupBy(*keys).agg(F.max("rn").alias("n"))

    def work(batches):
        for pdf in batches:
            made = [(*[getattr(r, k) for k in keys], s, a, b, i) for r in pdf.itertuples() for i, (s, a, b) in enumerate(plan(int(r.n)), 1)]
            yield pd.DataFrame(made, columns=[*keys, "set", "_a", "_b", "rangeid"])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", set string, _a int, _b int, rangeid int"
    ranges = lengths.mapInPandas(work, schema)
    return with_range(df.drop("set", "rangeid"), ranges, keys, "rn", "_a", "_b", ["set", "rangeid"]).where(F.col("set").isNotNull())


def assign_partitions(df: DataFrame, pattern: Sequence[str], size: int, gap: int, least: int, most: int, keys: Sequence[str] = (KEY,)) -> DataFrame:
    return _assigned(df, lambda n: partition_plan(n, pattern, size, gap, least, most), keys)


def assign_partitions_relative(df: DataFrame, shares: Sequence[tuple[str, float]], relative: float, gap: int, keys: Sequence[str] = (KEY,)) -> DataFrame:
    return _assigned(df, lambda n: shared_plan(n, shares, relative, gap), keys)


def concat_coin_tables(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with weight 1 / (classes * share of the row's class). The class table has a row for each label."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(weights, label)


def subset_rows(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows inside the listed ranges (symbol, a, b); ranges may overlap."""
    return in_some_range(df, ranges, [KEY], "rn", "a", "b")


def sequence_windows(df: DataFrame, columns: Sequence[str], n: int, keys: Sequence[str] = (KEY,), by: str = TIME) -> DataFrame:
    """seq: the columns of the last n rows in one range, oldest first; rows with fewer are dropped."""
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(-(n - 1), 0)
    return df.withColumn("seq", F.collect_list(F.array(*columns)).over(w)).where(F.size("seq") == n)


def bucket_means(df: DataFrame, columns: Sequence[str], n: int, target: str, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Means of n consecutive rows of a range, the target of the last one; an incomplete last bucket is dropped."""
    rows = df.withColumn("bucket", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(TIME)) - 1) / n))
    out = rows.groupBy(*keys, "bucket").agg(
        *[F.avg(c).alias(c) for c in columns], F.max_by(target, TIME).alias(target), F.max(TIME).alias(TIME), F.count("*").alias("_n")
    )
    return out.where(F.col("_n") == n).drop("_n")


def broadcast_bucket_scores(df: DataFrame, buckets: DataFrame, n: int, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Rows with the score of their bucket (symbol, bucket, score); rows without a bucket are dropped."""
    rows = df.withColumn("bucket", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(TIME)) - 1) / n))
    return rows.join(buckets, [*keys, "bucket"])


def undersample(df: DataFrame, label: str, keys: Sequence[str], seed: int = 7) -> DataFrame:
    """Every class cut to exactly the size of the smallest one: the rows with the smallest seeded hashes of their keys.

    Rows are counted by class and slot of the hash. Whole slots stay up to the one in which the size is reached; only that
    slot's rows, a small share of the class, are put in order. Rows with equal keys are told apart by chance.
    """
    rows = df.withColumn("_hash", F.xxhash64(F.lit(seed), *keys)).withColumn("_slot", F.shiftright("_hash", 50))
    slots = rows.groupBy(label, "_slot").agg(F.count("*").alias("_n"))
    smallest = slots.groupBy(label).agg(F.sum("_n").alias("_n")).agg(F.min("_n").alias("_size"))
    before = Window.partitionBy(label).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).crossJoin(F.broadcast(smallest))
    slots = slots.where(F.col("_before") < F.col("_size")).select(label, "_slot", F.least("_n", F.col("_size") - F.col("_before")).alias("_take"), "_n")
    found = rows.join(slots, [label, "_slot"])
    whole = found.where(F.col("_take") == F.col("_n"))
    last = found.where(F.col("_take") < F.col("_n"))
    place = F.row_number().over(Window.partitionBy(label, "_slot").orderBy("_hash"))
    last = last.withColumn("_place", place).where(F.col("_place") <= F.col("_take")).drop("_place")
    return whole.unionByName(last).select(*[F.col(f"`{c}`") for c in df.columns])


def prediction_table(predictions: DataFrame, partitions: DataFrame) -> DataFrame:
    """Predictions with the set of their partition (symbol, set, a, b: rows), "unused" outside."""
    found = with_range(predictions, partitions, [KEY], "rn", "a", "b", ["set"])
    return found.withColumn("set", F.coalesce("set", F.lit("unused")))


def max_prediction(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Best label and score of score columns named like the labels; the first one on ties."""
    best = F.greatest(*labels)
    label = F.lit(None)
    for name in reversed(labels):
        label = F.when(F.col(name) == F.col("score"), name).otherwise(label)
    return df.withColumn("score", best).withColumn("label", label)


def binary_predictions(df: DataFrame, labels: Sequence[str], label: str) -> DataFrame:
    """score of one label and whether it is the best; 0 and false if there is no such column."""
    if label not in labels:
        return df.withColumn("binary_score", F.lit(0.0)).withColumn("is_best", F.lit(False))
    best = max_prediction(df, labels)
    return best.withColumn("binary_score", F.col(label)).withColumn("is_best", F.col("label") == label).drop("score", "label")


def prediction_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))
