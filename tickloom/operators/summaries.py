"""Summaries of large tables that are kept and merged: digests to compare tables by, and sketches of distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketches; their ranks are off by less than ERROR with a certainty of 99 percent.
SKETCH_K, ERROR = 1600, 0.0021


# ---------------------------------------------------------------- digests


def _digest(fields: Sequence[str]) -> list[Column]:
    """Order-free: the number of rows, the exclusive or of their hashes and the sum of other hashes of them (repeated rows count)."""
    values = [F.col(f) for f in fields]
    return [
        F.count("*").alias("n"), F.bit_xor(F.xxhash64(*values)).alias("mixed"), F.sum(F.xxhash64(F.lit(1), *values).cast("decimal(38,0)")).alias("summed"),
    ]


def digest_tree(df: DataFrame, fields: Sequence[str], symbol: str = "symbol", at: str = "opentime") -> DataFrame:
    """Digests of the rows of each symbol and day (level 1), of each symbol (level 0): level, symbol, day, n, mixed, summed.

    fields are what counts of a row, its keys too. The table is small, can be kept with the data, and digests of a symbol
    follow from those of its days, so a day that changes costs its own rows only.
    """
    days = df.groupBy(F.col(symbol).alias("symbol"), F.to_date(at).alias("day")).agg(*_digest(fields))
    whole = days.groupBy("symbol").agg(F.sum("n").alias("n"), F.bit_xor("mixed").alias("mixed"), F.sum("summed").alias("summed"))
    kept = ["level", "symbol", "day", "n", "mixed", "summed"]
    return days.withColumn("level", F.lit(1)).select(kept).unionByName(whole.withColumn("level", F.lit(0)).withColumn("day", F.lit(None).cast("date")).select(kept))


def unequal_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """symbol, day, n_a and n_b of the days whose digests (of two digest_tree() tables) differ; days of equal symbols aren't joined."""

    sides = []
    for df, side in ((a, "a"), (b, "b")):
        kept = [F.col(c).alias(f"{c}_{side}") for c in ("symbol", "day", "n", "mixed", "summed")]
        sides.append([df.where(F.col("level") == which).select(*kept) for which in (0, 1)])
    differ, same = F.lit(False), lambda k: F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b"))
    for c in ("n", "mixed", "summed"):
        differ = differ | ~same(c)
    (whole_a, days_a), (whole_b, days_b) = sides
    symbols = whole_a.join(whole_b, same("symbol"), "full_outer").where(differ).select(F.coalesce("symbol_a", "symbol_b").alias("_symbol"))
    days_a, days_b = (d.join(symbols, F.col(f"symbol_{s}").eqNullSafe(F.col("_symbol")), "left_semi") for d, s in ((days_a, "a"), (days_b, "b")))
    found = days_a.join(days_b, same("symbol") & same("day"), "full_outer").where(differ)
    names = [F.coalesce(f"{k}_a", f"{k}_b").alias(k) for k in ("symbol", "day")]
    return found.select(*names, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def table_differences(
    a: DataFrame, b: DataFrame, fields: Sequence[str], atol: float = 1e-6, symbol: str = "symbol", at: str = "opentime",
    digests: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The rows (symbol, time) that are on one side only or differ in a field, with <field>_eq and match_all as compare_trade_tables() has them.

    Rows meet only where the digests of their symbol and day differ, so of equal tables nothing but digests is shuffled.
    Two rows that both have no symbol or no time are compared as the others are. digests: those of both sides, if kept.
    """
    from tickloom.operators.joins import compare_trade_tables

    x, y = digests or tuple(digest_tree(d, [symbol, at, *fields], symbol, at) for d in (a, b))
    cells = unequal_cells(x, y).select(F.col("symbol").alias("_symbol"), F.col("day").alias("_day"))

    def some(df: DataFrame) -> DataFrame:
        return df.join(cells, F.col(symbol).eqNullSafe(F.col("_symbol")) & F.to_date(at).eqNullSafe(F.col("_day")), "left_semi")

    return compare_trade_tables(some(a), some(b), [symbol, at], fields, atol).where("not match_all")


# ---------------------------------------------------------------- sketches


def gain_sketches(trades: DataFrame, by: Sequence[str] = ("coin", "cfgid"), at: str | None = None) -> DataFrame:
    """What kpi_of_sketches() needs of the trades of each key (and day, if at names a time): counts, sums and a quantile sketch.

    The rows are of bounded size, whatever the number of trades, and can be kept, appended and merged in any grouping.
    """
    keys = [*by, *([F.to_date(at).alias("day")] if at else [])]
    gain = F.col("gain").cast("double")
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("gain").alias("n_gain"), F.sum(gain).alias("sum_gain"), F.min(gain).alias("min_gain"), F.max(gain).alias("max_gain"),
        F.count("minutes").alias("n_minutes"), F.sum("minutes").alias("sum_minutes"), F.count_if(F.col("trend") == "up").alias("n_long"),
        F.kll_sketch_agg_double(gain, SKETCH_K).alias("sketch"),
    )


def kpi_of_sketches(sketches: DataFrame, by: Sequence[str] = ("coin", "cfgid")) -> DataFrame:
    """kpi_overview() from kept sketches. All columns are exact but median_gain, a gain whose rank is within ERROR of a half.

    The median of an even number of gains is one of the two in the middle here, not their mean.
    """
    total = lambda c: F.sum(c)
    found = sketches.groupBy(*by).agg(
        (total("sum_gain") / total("n_gain")).alias("mean_gain"), F.kll_merge_agg_double("sketch").alias("_sketch"), total("sum_gain").alias("sum_gain"),
        F.min("min_gain").alias("min_gain"), F.max("max_gain").alias("max_gain"), total("n").alias("n"), (total("sum_minutes") / total("n_minutes")).alias("mean_minutes"),
        total("n_long").alias("n_long"), total("n_gain").alias("_known"),
    )
    median = F.when(F.col("_known") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(0.5)))
    names = ["mean_gain", "median_gain", "sum_gain", "min_gain", "max_gain", "n", "mean_minutes", "n_long"]
    return found.withColumn("median_gain", median).select(*by, *names)


def kpi_overview_at_scale(trades: DataFrame, by: Sequence[str] = ("coin", "cfgid")) -> DataFrame:
    """kpi_overview() in one pass with memory of a fixed size for each key; its median is off as kpi_of_sketches() says."""
    return kpi_of_sketches(gain_sketches(trades, by), by)
