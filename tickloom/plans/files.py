"""Queries through files and streams: what is written is read again and must equal the bars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import features as G
from tickloom.operators.windows import number_rows
from tickloom.plans.bars import NUM, OHLCV, ntz
from tickloom.plans.registry import HOURS, hours, line_sql, query, table
from tickloom.sources import bars as S
from tickloom.streaming import bars as L

BARS = f"{HOURS} SELECT {OHLCV} FROM bars"


def folder(spark: SparkSession) -> str:
    """A new folder that all executors see: beside the session's checkpoints."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root}/tables-{uuid.uuid4().hex}"


@query("s1_read_bars", f"{HOURS} SELECT {OHLCV} FROM bars WHERE symbol IN ('click', 'view') AND opentime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'", NUM)
def _(spark, d):
    path = folder(spark)
    S.write_bars(hours(spark, d), path, "overwrite")
    return S.read_bars(spark, path, ["click", "view"], "2024-01-05", "2024-01-12").select(*OHLCV.split(", "))


@query("s2_write_bars_append", BARS, NUM)
def _(spark, d):
    path, df = folder(spark), hours(spark, d)
    S.write_bars(df.where(F.col("opentime") < ntz("2024-01-15")), path)
    S.write_bars(df, path)
    return S.read_bars(spark, path).select(*OHLCV.split(", "))


@query("s3_scan_all_bars", f"{HOURS} SELECT symbol, 'USDT' AS quote, opentime, close FROM bars", "close")
def _(spark, d):
    path, df = folder(spark), hours(spark, d).cache()
    for symbol in [r["symbol"] for r in df.select("symbol").distinct().collect()]:
        df.where(F.col("symbol") == symbol).drop("symbol").write.parquet(f"{path}/{symbol}-USDT")
    df.unpersist()
    return S.scan_all_bars(spark, path).select("symbol", "quote", "opentime", "close")


@query("s4_read_ohlcv_csv", f"{HOURS} SELECT opentime, open, high, low, close, basevolume, pivot FROM bars WHERE symbol = 'view'", NUM)
def _(spark, d):
    path = folder(spark)
    at = F.concat(F.date_format("opentime", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")).alias("timestamp")
    rows = hours(spark, d).where("symbol = 'view'").select(at, "open", "high", "low", "close", F.col("basevolume").alias("volume"), "pivot")
    rows.write.option("header", True).csv(path)
    return S.read_ohlcv_csv(spark, path)


@query("s7_result_tables", BARS, NUM)
def _(spark, d):
    path = folder(spark)
    S.write_table(hours(spark, d), path, "results")
    return S.read_result(spark, path, "results").select(*OHLCV.split(", "))


@query("s8_trades_by_coin", "SELECT o_orderpriority AS coin, o_orderkey, o_totalprice::DOUBLE AS gain FROM orders", "gain")
def _(spark, d):
    path = folder(spark)
    S.save_trades_by_coin(table(spark, d, "orders").select(F.col("o_orderpriority").alias("coin"), "o_orderkey", F.col("o_totalprice").cast("double").alias("gain")), path)
    return spark.read.parquet(path).select(F.col("coin").cast("string"), "o_orderkey", "gain")


@query("s9_export_kpi_csv", "SELECT c_custkey, c_acctbal::DOUBLE AS balance FROM customer", "balance")
def _(spark, d):
    path = folder(spark)
    S.export_kpi_csv(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("balance")), path)
    read = spark.read.option("sep", ";").option("header", True).schema("c_custkey bigint, balance string").csv(path)
    return read.select("c_custkey", F.regexp_replace("balance", ",", ".").cast("double").alias("balance"))


@query("s11_missing_feature_windows", f"{HOURS} SELECT symbol, count(*) FILTER (rn < 60) AS missing_60 FROM bars GROUP BY symbol")
def _(spark, d):
    rows = number_rows(G.rolling_regression(hours(spark, d), "pivot", [60], ["pivot"]))
    partial = rows.withColumn("regry_60", F.when(F.col("rn") >= 60, F.col("regry_60")))
    lacking = S.missing_feature_windows(partial, [60, 240])
    if lacking != [240]:
        raise ValueError(f"window 240 alone is missing, found {lacking}")
    return partial.groupBy("symbol").agg(F.count_if(F.col("regry_60").isNull()).alias("missing_60"))


def _bars_stream(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Bars of the first and of the second half of the month as a stream of two batches."""
    for i, part in enumerate((F.col("opentime") < ntz("2024-01-15"), F.col("opentime") >= ntz("2024-01-15"))):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in/part={i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/in/part=*")


def _drain(writer, path: str) -> None:
    writer.option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start().awaitTermination()


@query("l2_upsert_closed_candles", BARS, NUM)
def _(spark, d):
    path, df = folder(spark), hours(spark, d)
    _drain(L.upsert_closed_candles(_bars_stream(spark, df, path), f"{path}/table"), path)
    return L.current(spark, f"{path}/table").select(*OHLCV.split(", "))


@query("l3_stream_features", f"{HOURS}, {line_sql(24)} SELECT symbol, opentime, regry AS regry_24, grad AS grad_24 FROM line", "regry_24 grad_24")
def _(spark, d):
    path, df = folder(spark), hours(spark, d)
    work = lambda x: G.rolling_regression(x, "pivot", [24])
    _drain(L.stream_features(_bars_stream(spark, df, path), f"{path}/f", work, 23), path)
    return spark.read.parquet(f"{path}/f/features").select("symbol", "opentime", "regry_24", "grad_24")
