"""Sources and sinks: bars, ticks, candles of venues, result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
BAR_SCHEMA = "symbol string, opentime timestamp_ntz, open double, high double, low double, close double, basevolume double"


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def pivot_price() -> Column:
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def epoch_minute(ts: Column) -> Column:
    """Whole minutes since 1970 of a time without zone."""
    return F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) / 60)


def from_minute(minute: Column) -> Column:
    return F.timestamp_add("MINUTE", minute.cast("int"), F.lit("1970-01-01").cast("timestamp_ntz"))


def floor_time(ts: Column, minutes: int) -> Column:
    """ts floored to a multiple of minutes since 1970, without a zone. Multi-day buckets count from 1970-01-01."""
    minute = epoch_minute(ts)
    return from_minute(minute - F.pmod(minute, F.lit(minutes)))


def bars_from_ticks(
    ticks: DataFrame, minutes: int, price: str, volume: str | None = None, symbol: str = "symbol", ts: str = "ts", tie: Sequence[str] = ()
) -> DataFrame:
    """One bar for each symbol and bucket: first, highest, lowest and last price, summed volume (count without one).

    Partial aggregates are combined before the shuffle, so a hot symbol costs a row for each task and bucket.
    """
    order = F.struct(F.col(ts), *[F.col(c) for c in tie])
    size = F.lit(1.0) if volume is None else F.col(volume).cast("double")
    p = F.col(price).cast("double")
    rows = ticks.select(
        F.col(symbol).alias("symbol"), floor_time(F.col(ts), minutes).alias("opentime"), order.alias("o"), p.alias("p"), size.alias("v")
    ).where(F.col("p").isNotNull())
    return (
        rows.groupBy("symbol", "opentime")
        .agg(
            F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
            F.max_by("p", "o").alias("close"), F.sum("v").alias("basevolume"),
        )
        .withColumn("pivot", pivot_price())
    )


def event_bars(spark: SparkSession, path: str, minutes: int = 60) -> DataFrame:
    events = read_table(spark, path, "events")
    return bars_from_ticks(events, minutes, "value", symbol="event_type", tie=["event_id"])


def lineitem_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars of unit prices by brand."""
    items, parts = read_table(spark, path, "lineitem"), read_table(spark, path, "part")
    ticks = items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("price"), F.col("l_quantity").alias("quantity"),
    )
    return bars_from_ticks(ticks, 1440, "price", "quantity", tie=["l_orderkey", "l_linenumber"])


def read_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored bars (partitioned by symbol) with pivot; symbol and time conditions reach the scan."""
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(*symbols))
    if start is not None:
        df = df.where(F.col("opentime") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("opentime") <= F.lit(end).cast("timestamp_ntz"))
    return df.withColumn("pivot", pivot_price())


def newer_rows(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows later than the symbol's last stored one."""
    last = stored.groupBy("symbol").agg(F.max("opentime").alias("_last"))
    joined = df.join(last, "symbol", "left")
    return joined.where(F.col("_last").isNull() | (F.col("opentime") > F.col("_last"))).select(*df.columns)


def write_bars(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write bars by symbol, sorted by time; append adds only rows later than what a symbol has."""
    rows = df.drop("pivot")
    if mode == "append":
        try:
            rows = newer_rows(rows, df.sparkSession.read.parquet(path))
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    rows.sortWithinPartitions("symbol", "opentime").write.partitionBy("symbol").mode(mode).parquet(path)


def store_bars(df: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Bars as a table of the catalog in buckets by symbol, sorted by symbol and time in each.

    Windows by symbol over stored_bars() read them in place. Joins by symbol and time do too if the session has
    spark.sql.requireAllClusterKeysForCoPartition off, which else asks for an exchange by both keys.
    """
    df.drop("pivot").repartition(buckets, "symbol").write.mode(mode).bucketBy(buckets, "symbol").sortBy("symbol", "opentime").saveAsTable(table)


def stored_bars(spark: SparkSession, table: str) -> DataFrame:
    """Bars of store_bars() with pivot."""
    return spark.table(table).withColumn("pivot", pivot_price())


def scan_all_bars(spark: SparkSession, path: str) -> DataFrame:
    """All stored pairs: folders named BASE-QUOTE become the columns symbol and quote."""
    df = spark.read.parquet(f"{path}/*").withColumn("_file", F.col("_metadata.file_path"))
    pair = F.split(F.element_at(F.split(F.regexp_replace("_file", "/[^/]*$", ""), "/"), -1), "-")
    return df.select(pair[0].alias("symbol"), pair[1].alias("quote"), *[c for c in df.columns if c not in ("_file", "symbol", "quote")])


def read_ohlcv_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the time as y-m-d H:M:s+z and six numbers."""
    schema = "timestamp string, open double, high double, low double, close double, volume double, pivot double"
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumn("opentime", F.to_timestamp("timestamp", "yyyy-MM-dd HH:mm:ssXXX").cast("timestamp_ntz")).select(
        "opentime", "open", "high", "low", "close", F.col("volume").alias("basevolume"), "pivot"
    )


def normalize_klines(df: DataFrame, venue: str) -> DataFrame:
    """Candles of a venue (symbol, and raw: JSON of a list of candles) as bars, by time.

    spot: [seconds, open, high, low, close, vwap, volume, ...]; linear: [milliseconds, open, high, low, close, volume, ...];
    futures: objects with time in milliseconds or as ISO text.
    """
    if venue == "futures":
        kind = "array<struct<time:string,open:string,high:string,low:string,close:string,volume:string>>"
        rows = df.select("symbol", F.explode(F.from_json("raw", kind)).alias("k"))
        ms = F.expr("try_cast(k.time AS bigint)")
        time = F.coalesce(F.timestamp_millis(ms), F.expr("try_cast(k.time AS timestamp)"))
        value = lambda name: F.col(f"k.{name}").cast("double")
        parts = [value(n) for n in ("open", "high", "low", "close", "volume")]
    else:
        rows = df.select("symbol", F.explode(F.from_json("raw", "array<array<string>>")).alias("k"))
        unit, volume = (F.timestamp_seconds, 6) if venue == "spot" else (F.timestamp_millis, 5)
        time = unit(F.get("k", F.lit(0)).cast("bigint"))
        parts = [F.get("k", F.lit(i)).cast("double") for i in (1, 2, 3, 4, volume)]
    names = (*PRICES, "basevolume")
    bars = rows.select("symbol", time.cast("timestamp_ntz").alias("opentime"), *[p.alias(n) for p, n in zip(parts, names, strict=True)])
    return bars.withColumn("pivot", pivot_price())


# How venues name the four states of an order.
ORDER_STATES = {
    "linear": {"New": "submitted", "PartiallyFilled": "submitted", "Untriggered": "submitted", "Filled": "closed", "Cancelled": "canceled",
               "PartiallyFilledCanceled": "canceled", "Deactivated": "canceled", "Rejected": "rejected"},
    "spot": {"pending": "submitted", "open": "submitted", "closed": "closed", "canceled": "canceled", "expired": "canceled"},
    "tpch": {"O": "submitted", "P": "submitted", "F": "closed"},
}


def normalize_order_status(status: Column, venue: str) -> Column:
    """submitted, closed, canceled or rejected; unknown states are rejected."""
    out = F.lit("rejected")
    for name, state in ORDER_STATES[venue].items():
        out = F.when(status == name, state).otherwise(out)
    return out


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(f"{root}/{name}")


def read_result(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def save_trades_by_coin(df: DataFrame, path: str) -> None:
    """One folder for each coin; reading the whole path gives the aggregate."""
    df.write.mode("overwrite").partitionBy("coin").parquet(path)


def decimal_comma(df: DataFrame) -> DataFrame:
    """Floating-point columns as text with a decimal comma."""
    kinds = dict(df.dtypes)
    return df.select(*[F.regexp_replace(F.col(c).cast("string"), "\\.", ",").alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def export_kpi_csv(df: DataFrame, path: str) -> None:
    decimal_comma(df).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def reconcile_tables(src: DataFrame, dst: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either side, keys on one side only, and whether the tables agree, in one row."""
    a = src.groupBy(*keys).agg(F.count("*").alias("n_src"))
    b = dst.groupBy(*keys).agg(F.count("*").alias("n_dst"))
    both = a.join(b, list(keys), "full_outer")
    out = both.agg(
        F.coalesce(F.sum("n_src"), F.lit(0)).alias("rows_src"), F.coalesce(F.sum("n_dst"), F.lit(0)).alias("rows_dst"),
        F.count_if(F.col("n_dst").isNull()).alias("missing"), F.count_if(F.col("n_src").isNull()).alias("extra"),
        F.count_if(F.col("n_src") != F.col("n_dst")).alias("uneven"),
    )
    same_columns = sorted(src.columns) == sorted(dst.columns)
    ok = F.lit(same_columns) & (F.col("missing") + F.col("extra") + F.col("uneven") == 0)
    return out.withColumn("same_columns", F.lit(same_columns)).withColumn("ok", ok)


def missing_feature_windows(df: DataFrame, windows: Sequence[int]) -> list[int]:
    """Windows of which regry, grad or std is missing."""
    return [w for w in windows if not {f"regry_{w}", f"grad_{w}", f"std_{w}"} <= set(df.columns)]


def sine_bars(spark: SparkSession, n: int, period: int = 250, overlay: int | None = None, symbol: str = "SINE", start: str = "2025-01-02 01:11:00") -> DataFrame:
    """n one-minute bars on a sine of amplitude 7 % around 2, with a second, slower sine on top if overlay is given."""
    x = F.col("id").cast("double")
    wave = lambda t, p: F.sin(t * 2 * F.pi() / p)
    price = lambda t: 2 * (1 + 0.07 * (wave(t, period) if overlay is None else (wave(t, period) + wave(t, overlay)) / 2))
    first, last = price(x), price(x + 1)
    return spark.range(n).select(
        F.lit(symbol).alias("symbol"),
        (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("opentime"),
        first.alias("open"), F.greatest(first, last).alias("high"), F.least(first, last).alias("low"), last.alias("close"),
        (10 + 5 * F.abs(F.cos(x * 2 * F.pi() / period))).alias("basevolume"),
    ).withColumn("pivot", pivot_price())


def append_if_new(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing and those rows of new whose key it lacks."""
    return existing.unionByName(new.join(existing.select(*keys), list(keys), "left_anti"))
