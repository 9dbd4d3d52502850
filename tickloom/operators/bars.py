"""Bars: resampling, repair, merging, quality and liquidity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.joins import with_range
from tickloom.operators.windows import latch, number_rows, ordered, with_islands, with_sliding_sum
from tickloom.sources.bars import epoch_minute, floor_time, from_minute, pivot_price

VALUES = ("open", "high", "low", "close", "basevolume", "pivot")


def add_pivot(df: DataFrame) -> DataFrame:
    return df.withColumn("pivot", pivot_price())


def resample(df: DataFrame, minutes: int) -> DataFrame:
    """Larger bars on floor boundaries; an incomplete first bucket stays."""
    bucket = floor_time(F.col("opentime"), minutes)
    out = df.groupBy("symbol", bucket.alias("_bucket")).agg(
        F.min_by("open", "opentime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "opentime").alias("close"), F.sum("basevolume").alias("basevolume"),
    )
    return add_pivot(out.withColumnRenamed("_bucket", "opentime"))


def fill_gaps(df: DataFrame, minutes: int) -> DataFrame:
    """Bars in every interval between a symbol's first and last: the previous bar with volume 0."""
    minute = epoch_minute(F.col("opentime"))
    rows = df.withColumn("_from", minute).withColumn("_next", F.lead("_from").over(ordered()))
    last = F.greatest(F.coalesce(F.col("_next") - minutes, F.col("_from")), F.col("_from"))
    rows = rows.withColumn("_minute", F.explode(F.sequence("_from", last, F.lit(minutes).cast("bigint"))))
    volume = F.when(F.col("_minute") == F.col("_from"), F.col("basevolume")).otherwise(0.0)
    return rows.withColumn("basevolume", volume).withColumn("opentime", from_minute(F.col("_minute"))).drop("_from", "_next", "_minute")


def detect_interval_issues(df: DataFrame, minutes: int) -> DataFrame:
    """Bars closer to their predecessor than the interval, with the distance in seconds (0: the same time)."""
    before = F.lag("opentime").over(ordered())
    rows = df.withColumn("seconds", F.timestamp_diff("SECOND", before, F.col("opentime")))
    return rows.where(F.col("seconds") < 60 * minutes).select("symbol", "opentime", "seconds")


def check_bars(df: DataFrame, minutes: int = 1) -> DataFrame:
    """Defects: symbol, rn, column, category (invalid, out_of_range, out_of_sequence)."""
    rows = number_rows(df).withColumn("_after", F.lead("opentime").over(ordered())).withColumn("_before", F.lag("opentime").over(ordered()))
    value = lambda c: F.when(F.col(c).isNull() | F.isnan(c), "invalid").when((F.abs(F.col(c)) == float("inf")) | (F.col(c) < 0), "out_of_range")
    step = lambda a, b: F.coalesce(F.timestamp_diff("SECOND", F.col(a), F.col(b)) != 60 * minutes, F.lit(False))
    order = F.when(step("_before", "opentime") | step("opentime", "_after"), "out_of_sequence")
    found = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("category")) for c in VALUES],
                    F.struct(F.lit("opentime").alias("column"), order.alias("category")))
    rows = rows.select("symbol", "rn", F.explode(found).alias("d"))
    return rows.where("d.category is not null").select("symbol", "rn", "d.column", "d.category")


def cure_bars(df: DataFrame) -> DataFrame:
    """Times floored to the minute; of bars with the same minute the first with a volume stays, else the last."""
    rows = df.withColumn("_at", F.col("opentime")).withColumn("opentime", floor_time(F.col("opentime"), 1))
    empty = F.col("basevolume") == 0
    order = [empty.asc(), F.when(empty, -F.unix_micros(F.col("_at").cast("timestamp"))).otherwise(F.unix_micros(F.col("_at").cast("timestamp")))]
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "opentime").orderBy(*order)))
    return rows.where("_n = 1").drop("_n", "_at")


def merge_bars(a: DataFrame, b: DataFrame, policy: str = "newer") -> DataFrame:
    """Both; where they overlap b wins. policy keep_inside: a symbol's b that lies strictly inside a is left out."""
    if policy == "keep_inside":
        span = lambda df, n: df.groupBy("symbol").agg(F.min("opentime").alias(f"{n}0"), F.max("opentime").alias(f"{n}1"))
        inside = span(a, "a").join(span(b, "b"), "symbol").where("a0 < b0 and b1 < a1").select("symbol")
        b = b.join(inside, "symbol", "left_anti")
    rows = a.withColumn("_rank", F.lit(1)).unionByName(b.select(*a.columns).withColumn("_rank", F.lit(0)))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "opentime").orderBy("_rank")))
    return rows.where("_n = 1").drop("_n", "_rank")


def merge_gaps(a: DataFrame, b: DataFrame, minutes: int = 1) -> DataFrame:
    """Symbols whose two series neither overlap nor touch, with the gap in minutes; merging these is an error."""
    span = lambda df, n: df.groupBy("symbol").agg(F.min("opentime").alias(f"{n}0"), F.max("opentime").alias(f"{n}1"))
    apart = lambda x, y: F.timestamp_diff("MINUTE", F.col(x), F.col(y))
    rows = span(a, "a").join(span(b, "b"), "symbol").withColumn("gap", F.greatest(apart("a1", "b0"), apart("b1", "a0")))
    return rows.where(F.col("gap") > minutes).select("symbol", "gap")


def upsert_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bars of both, each with fetched (a time); of two with the same time, the later fetched one stays."""
    rows = old.unionByName(new)
    newest = Window.partitionBy("symbol", "opentime").orderBy(F.desc("fetched"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def quote_volume(by: str = "pivot") -> Column:
    return F.col(by) * F.col("basevolume")


def _ranges(rows: DataFrame, island: str) -> DataFrame:
    """First and last row of each island of open rows."""
    return rows.where("open").groupBy("symbol", island).agg(
        F.min("rn").alias("start_rn"), F.max("rn").alias("end_rn"), F.min("opentime").alias("start_ts"), F.max("opentime").alias("end_ts")
    ).drop(island)


def liquid_ranges(
    df: DataFrame, minquotevol: float, accumulate: int, checkperiod: int, startthreshold: float, stopthreshold: float,
    minliquidminutes: int, startdistance: int = 0,
) -> DataFrame:
    """Row ranges of each symbol in which quote volume stays sufficient.

    A row isn't ok if the volume of the last accumulate rows is below the minimum; rows before the data count as not ok.
    A range opens when fewer than startthreshold * checkperiod of the last checkperiod rows aren't ok and closes when
    more than stopthreshold * checkperiod aren't.
    """
    rows = number_rows(df.withColumn("_qv", quote_volume()))
    rows = with_sliding_sum(rows, F.col("_qv"), accumulate, "volume").drop("_qv")
    bad = (F.round(F.col("volume"), 6) < minquotevol).cast("int")
    rows = with_sliding_sum(rows, bad, checkperiod, "bad")
    rows = rows.withColumn("bad", F.col("bad") + F.greatest(F.lit(0), checkperiod - F.col("rn")))
    rows = rows.withColumn("open", latch(F.col("bad") < startthreshold * checkperiod, F.col("bad") > stopthreshold * checkperiod))
    ranges = _ranges(with_islands(rows, F.col("open"), "island"), "island")
    ranges = ranges.where(F.col("end_rn") - F.col("start_rn") + 1 >= minliquidminutes)
    return ranges.where(F.col("end_rn") > startdistance).withColumn("start_rn", F.greatest("start_rn", F.lit(startdistance + 1)))


def liquid_symbols(ranges: DataFrame) -> DataFrame:
    """Symbols with their ranges as an array by start."""
    return ranges.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("start_rn", "end_rn"))).alias("ranges"))


def daily_min_quote_volume(minquotevol: float, accumulate: int, checkperiod: int) -> float:
    return 2 * checkperiod * minquotevol / accumulate


def volume_segments(df: DataFrame, start: float, window: int, stop: float, mintime: int) -> DataFrame:
    """Segments with a large volume of the last window rows: they open at start, beginning with the window's first row,
    close at stop, and last at least mintime minutes."""
    rows = with_sliding_sum(number_rows(df), F.col("basevolume"), window, "volume")
    volume = F.round(F.col("volume"), 6)
    rows = rows.withColumn("open", latch((volume >= start) & (F.col("rn") >= window), volume <= stop))
    first = F.lag("opentime", window - 1).over(ordered())
    rows = with_islands(rows.withColumn("_first", first), F.col("open"), "island")
    out = rows.where("open").groupBy("symbol", "island").agg(
        (F.min("rn") - (window - 1)).alias("start_rn"), F.max("rn").alias("end_rn"),
        F.min("_first").alias("start_ts"), F.max("opentime").alias("end_ts"),
    ).drop("island")
    return out.where(F.timestamp_diff("MINUTE", F.col("start_ts"), F.col("end_ts")) >= mintime)


def slice_ranges(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bars inside the ranges (symbol, rangeid, start_ts, end_ts), which don't overlap, with the rangeid (or what else names them)."""
    values = [c for c in ranges.columns if c not in ("symbol", "start_ts", "end_ts")]
    return with_range(df, ranges, ["symbol"], "opentime", "start_ts", "end_ts", values).where(F.col(values[0]).isNotNull())
