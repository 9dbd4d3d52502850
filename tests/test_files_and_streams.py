"""Files written and read again, and streams against batches."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.test_golden import series
from tickloom.functions import scalar
from tickloom.operators.bars import merge_bars
from tickloom.operators.features import rolling_regression
from tickloom.operators.windows import number_rows
from tickloom.sources import bars as S
from tickloom.streaming import bars as L


def test_bars_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "bars")
    first = series(spark, [1, 2, 3])
    S.write_bars(first, path)
    S.write_bars(series(spark, [1, 2, 3, 4, 5]).unionByName(series(spark, [7], symbol="B")), path)
    out = S.read_bars(spark, path)
    assert out.count() == 6 and out.where("symbol = 'A'").agg(F.max("close")).first()[0] == 5
    assert S.read_bars(spark, path, ["A"], "2022-01-02 22:55:00", "2022-01-02 22:56:00").count() == 2
    assert {r["pivot"] for r in out.where("symbol = 'B'").collect()} == {7.0}


def test_pairs_from_folder_names(spark, tmp_path):
    for pair in ("BTC-USDT", "ETH-EUR"):
        series(spark, [1, 2]).drop("symbol").write.parquet(f"{tmp_path}/{pair}")
    out = S.scan_all_bars(spark, str(tmp_path))
    assert {(r["symbol"], r["quote"]) for r in out.collect()} == {("BTC", "USDT"), ("ETH", "EUR")}


def test_csv_with_zones(spark, tmp_path):
    (tmp_path / "x.csv").write_text("timestamp,open,high,low,close,volume,pivot\n2022-01-01 12:00:00+02:00,1,2,0.5,1.5,10,1.25\n")
    row = S.read_ohlcv_csv(spark, str(tmp_path / "x.csv")).first()
    assert row["opentime"] == dt.datetime(2022, 1, 1, 10) and row["basevolume"] == 10


@pytest.mark.parametrize(
    ("venue", "raw"),
    [
        ("linear", [["1641164040000", "1", "3", "0.5", "2", "7"]]),
        ("spot", [[1641164040, "1", "3", "0.5", "2", "1.7", "7", 4]]),
        ("futures", [{"time": 1641164040000, "open": "1", "high": "3", "low": "0.5", "close": "2", "volume": 7}]),
        ("futures", [{"time": "2022-01-02T22:54:00Z", "open": "1", "high": "3", "low": "0.5", "close": "2", "volume": 7}]),
    ],
)
def test_candles_of_venues(spark, venue, raw):
    df = spark.createDataFrame([("A", json.dumps(raw))], "symbol string, raw string")
    r = S.normalize_klines(df, venue).first()
    assert r["opentime"] == dt.datetime(2022, 1, 2, 22, 54) and (r["open"], r["high"], r["low"], r["close"], r["basevolume"]) == (1, 3, 0.5, 2, 7)


def test_tables_by_coin_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("BTC", 1.5), ("ETH", -0.25)], "coin string, gain double")
    S.save_trades_by_coin(df, f"{tmp_path}/trades")
    assert spark.read.parquet(f"{tmp_path}/trades").count() == 2 and spark.read.parquet(f"{tmp_path}/trades/coin=BTC").count() == 1
    S.write_table(df, str(tmp_path), "t")
    assert S.read_result(spark, str(tmp_path), "t").count() == 2
    S.export_kpi_csv(df, f"{tmp_path}/csv")
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert "BTC;1,5" in text and "ETH;-0,25" in text


def test_small_helpers(spark):
    assert [scalar.period_label(m) for m in (1, 60, 240, 1440, 10080, 40320)] == ["1m", "1h", "4h", "1d", "1w", "1M"]
    df = spark.createDataFrame([(1,)], "regry_5 int").selectExpr("regry_5", "1 grad_5", "1 std_5", "1 regry_9")
    assert S.missing_feature_windows(df, [5, 9]) == [9]
    with pytest.raises(ValueError, match="opentime"):
        scalar.canonical_time_column(df)
    tokens = spark.createDataFrame([("BTC/USDT",), ("BTCUSDT",), ("btc",), ("USDT",), ("",)], "t string")
    assert [r[0] for r in tokens.select(scalar.base_token(F.col("t"), "USDT")).collect()] == ["BTC", "BTC", "BTC", None, None]
    sine = S.sine_bars(spark, 100, 50)
    assert sine.count() == 100 and sine.where("low > high or high > 2.15 or low < 1.85").count() == 0


def ticks(spark, n=400):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=37 * i), "ab"[i % 2], float((i * 7919) % 101)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")


def stream(spark, df, path, parts):
    """df as a stream of files in the order of parts (a column)."""
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{path}/{i}")
    import os
    import shutil

    os.makedirs(f"{path}/in")
    for i in range(parts):
        name = next(f for f in os.listdir(f"{path}/{i}") if f.endswith(".parquet"))
        shutil.copy(f"{path}/{i}/{name}", f"{path}/in/{i:03d}.parquet")
        os.utime(f"{path}/in/{i:03d}.parquet", (1e9 + i, 1e9 + i))
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(writer, path):
    q = writer.option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start()
    q.awaitTermination()


def same(a, b):
    names = sorted(a.columns)
    return sorted(map(tuple, a.select(names).collect())) == sorted(map(tuple, b.select(names).collect()))


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    df = ticks(spark).withColumn("part", F.floor(F.col("event_id") / 100))
    live = L.stream_bars(stream(spark, df, tmp_path, 4), 10, "1 minute")
    run(live.writeStream.format("parquet").option("path", f"{tmp_path}/out"), tmp_path)
    batch = S.bars_from_ticks(df, 10, "value", symbol="event_type", tie=["event_id"])
    out = spark.read.parquet(f"{tmp_path}/out")
    last = out.agg(F.max("opentime")).first()[0]
    assert out.count() > 20 and same(out, batch.where(F.col("opentime") <= F.lit(last).cast("timestamp_ntz")))


def test_candles_are_replaced_by_later_ones(spark, tmp_path):
    a = series(spark, [1, 2, 3]).withColumn("part", F.lit(0))
    b = series(spark, [9, 4], start=dt.datetime(2022, 1, 2, 22, 56)).withColumn("part", F.lit(1))
    candles = stream(spark, a.unionByName(b), tmp_path, 2)
    run(L.upsert_closed_candles(candles, f"{tmp_path}/table"), tmp_path)
    assert same(L.current(spark, f"{tmp_path}/table"), merge_bars(a.drop("part"), b.drop("part")))


def test_batches_touch_their_days_and_can_be_repeated(spark, tmp_path):
    path = f"{tmp_path}/table"
    apply = L.into_table(path, lambda old, new: merge_bars(old, new))
    a, b = series(spark, [1, 2, 3]), series(spark, [7, 8], start=dt.datetime(2022, 1, 3, 0, 0))
    c = series(spark, [9], start=dt.datetime(2022, 1, 3, 0, 1))
    apply(a, 0)
    for number, batch in ((1, b), (2, c), (2, c), (3, c.limit(0))):
        apply(batch, number)
    assert same(L.current(spark, path), merge_bars(merge_bars(a, b), c))
    written = {(str(r[0]), r[1]) for r in spark.read.parquet(path).select(L.DAY, L.VERSION).distinct().collect()}
    assert written == {("2022-01-02", 0), ("2022-01-03", 1), ("2022-01-03", 2)}


def test_features_need_the_halo_only(spark, tmp_path):
    df = number_rows(S.sine_bars(spark, 120, 50)).withColumn("part", F.floor((F.col("rn") - 1) / 40)).drop("rn")
    run(L.stream_features(stream(spark, df, tmp_path, 3), f"{tmp_path}/f", lambda x: rolling_regression(x, "pivot", [20]), 19), tmp_path)
    assert [spark.read.parquet(f"{tmp_path}/f/halo/{i}").count() for i in (0, 1)] == [19, 19]


def test_streamed_features_equal_batch_features(spark, tmp_path):
    df = number_rows(S.sine_bars(spark, 120, 50)).withColumn("part", F.floor((F.col("rn") - 1) / 40)).drop("rn")
    work = lambda x: rolling_regression(x, "pivot", [20])
    run(L.stream_features(stream(spark, df, tmp_path, 3), f"{tmp_path}/f", work, 19), tmp_path)
    out = spark.read.parquet(f"{tmp_path}/f/features")
    joined = out.join(work(df.drop("part")).select("opentime", F.col("grad_20").alias("g")), "opentime")
    assert joined.count() == 120 and joined.where("abs(grad_20 - g) > 1e-10").count() == 0


def test_gate_keeps_its_state(spark, tmp_path):
    rows = [("A", float(i), 100.0 + (5 if i == 4 else 0), i // 3) for i in range(9)]
    df = spark.createDataFrame(rows, "symbol string, minute double, close double, part int")
    live = L.gate_classification(stream(spark, df, tmp_path, 3), 3, 0.04)
    run(live.writeStream.format("parquet").option("path", f"{tmp_path}/out"), tmp_path)
    out = {r["minute"]: r["classify"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert [m for m in sorted(out) if out[m]] == [0, 3, 4, 5, 8]
