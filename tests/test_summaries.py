"""Kept summaries, stored buckets and live features against whole tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_chunks import START, walk
from tests.test_files_and_streams import run, stream
from tickloom.operators import evaluate, features, joins, summaries
from tickloom.operators.features import rolling_regression
from tickloom.plans.pipelines import PRESETS, features_targets
from tickloom.sources import bars as S
from tickloom.streaming import bars as L


def bars(spark, seed=31, sizes=(("A", 300), ("B", 60)), minutes=60):
    r = np.random.default_rng(seed)
    rows = []
    for s, n in sizes:
        close = 50 + np.cumsum(r.normal(0, 1, n))
        for i, c in enumerate(close.tolist()):
            o = close[i - 1] if i else c
            rows.append((s, START + dt.timedelta(minutes=minutes * i), float(o), float(max(o, c) + 0.3), float(min(o, c) - 0.2), c, float(r.integers(0, 9))))
    df = spark.createDataFrame(rows, "symbol string, opentime timestamp_ntz, open double, high double, low double, close double, basevolume double")
    return df.withColumn("pivot", S.pivot_price())


def test_differences_are_those_of_a_whole_comparison(spark):
    a = bars(spark)
    change = F.when((F.col("symbol") == "A") & (F.col("opentime") == F.lit(START + dt.timedelta(hours=50)).cast("timestamp_ntz")), F.col("close") + 1).otherwise(F.col("close"))
    b = a.withColumn("close", change).where("not (symbol = 'B' and hour(opentime) = 3)")
    b = b.unionByName(a.limit(1).withColumn("symbol", F.lit("C")))
    got = summaries.table_differences(a, b, ["close", "basevolume"])
    want = joins.compare_trade_tables(a, b, ["symbol", "opentime"], ["close", "basevolume"]).where("not match_all")
    rows = lambda x: sorted(map(tuple, x.select("symbol", "opentime", "close_eq", "basevolume_eq").collect()))
    assert rows(got) == rows(want) and len(rows(got)) == 5
    near = a.withColumn("close", F.col("close") + 1e-9)
    assert summaries.table_differences(a, near, ["close"]).count() == 0


def test_equal_tables_compare_no_rows(spark):
    a = bars(spark)
    trees = [summaries.digest_tree(x, ["symbol", "opentime", "close"]) for x in (a, a.repartition(7))]
    assert summaries.unequal_cells(*trees).count() == 0
    twice = summaries.digest_tree(a.unionByName(a.limit(2)), ["symbol", "opentime", "close"])
    assert sum(r["n_b"] - r["n_a"] for r in summaries.unequal_cells(trees[0], twice).collect()) == 2


def test_kept_sketches_merge_to_the_overview(spark):
    r = random.Random(3)
    rows = [("c" + str(i % 2), i % 3, START + dt.timedelta(hours=i % 200), None if i % 50 == 0 else r.gauss(0, 1), i % 90, "up" if i % 3 else "down") for i in range(20_000)]
    trades = spark.createDataFrame(rows, "coin string, cfgid int, enddt timestamp_ntz, gain double, minutes int, trend string")
    kept = summaries.gain_sketches(trades, at="enddt")
    assert kept.count() > 40 and kept.agg(F.max(F.length("sketch"))).first()[0] < 40_000
    want = {(x["coin"], x["cfgid"]): x for x in evaluate.kpi_overview(trades).collect()}
    gains = {}
    for c, k, _, g, _, _ in rows:
        if g is not None:
            gains.setdefault((c, k), []).append(g)
    for found in (summaries.kpi_of_sketches(kept), summaries.kpi_overview_at_scale(trades)):
        rows_found = found.collect()
        assert len(rows_found) == len(want)
        for x in rows_found:
            w, mine = want[x["coin"], x["cfgid"]], sorted(gains[x["coin"], x["cfgid"]])
            assert (x["n"], x["n_long"], x["min_gain"], x["max_gain"], x["mean_minutes"]) == (w["n"], w["n_long"], w["min_gain"], w["max_gain"], w["mean_minutes"])
            assert abs(x["mean_gain"] - w["mean_gain"]) < 1e-12 and abs(x["sum_gain"] - w["sum_gain"]) < 1e-9
            assert abs(np.searchsorted(mine, x["median_gain"]) / len(mine) - 0.5) < 2 * summaries.ERROR
    assert summaries.kpi_overview_at_scale(trades.limit(0)).count() == 0


def test_stored_bars_need_no_exchange(spark):
    spark.sql("DROP TABLE IF EXISTS kept_bars")
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = bars(spark)
        S.store_bars(df, "kept_bars", 4)
        kept = S.stored_bars(spark, "kept_bars")
        line = rolling_regression(kept, "pivot", [24])
        both = joins.align_features_prices(line.select("symbol", "opentime", "grad_24"), kept.select("symbol", "opentime", "close"))
        for found in (line, both):
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        want = {(r["symbol"], r["opentime"]): r["grad_24"] for r in rolling_regression(df, "pivot", [24]).collect()}
        assert all(abs(want[r["symbol"], r["opentime"]] - r["grad_24"]) < 1e-12 for r in both.collect()) and both.count() == len(want)
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS kept_bars")


def test_training_table_joins_no_rows_with_themselves(spark):
    df = bars(spark)
    rows = features_targets(df.withColumn("basevolume", F.lit(1000.0)))
    assert rows.count() > 200 and "grad_24" not in rows.columns and {"pivot", "gain", "label", "set", "rv_3_24"} <= set(rows.columns)
    assert len(rows.columns) == len(set(rows.columns)) and PRESETS["hourly"].window == 24


@pytest.mark.parametrize("late", [0, 5])
def test_live_features_equal_batch_features(spark, tmp_path, late):
    specs, volumes = [("ry", 12, 0), ("rg", 12, 3), ("rs", 12, 0), ("rs", 24, 1), ("mind", 24, 2), ("maxd", 12, 0)], [(3, 12)]
    df = bars(spark, 33, (("A", 70), ("B", 60)), 1)
    r = random.Random(1)
    place = {x: x + r.randint(0, late) for x in range(80)}
    order = F.create_map(*[F.lit(v) for kv in place.items() for v in kv])
    at = F.timestamp_diff("MINUTE", F.lit(START).cast("timestamp_ntz"), F.col("opentime")).cast("int")
    parts = df.withColumn("part", F.least(F.floor(order[at] / 20), F.lit(3)))
    live = L.live_features(stream(spark, parts, tmp_path, 4), specs, volumes, "10 minutes")
    run(live.writeStream.format("parquet").option("path", f"{tmp_path}/out"), tmp_path)
    got = {(x["symbol"], x["opentime"]): x for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = features.feature_set_v6(df, specs, volumes).where(F.col("opentime") <= F.lit(START + dt.timedelta(minutes=59)).cast("timestamp_ntz")).collect()
    assert len(got) == len(want) == 120
    for w in want:
        g = got[w["symbol"], w["opentime"]]
        for c in w.asDict():
            if c not in ("symbol", "opentime"):
                assert (g[c] is None or np.isnan(g[c])) if w[c] is None else abs(g[c] - w[c]) < 1e-9, (c, w["opentime"])


def test_limits_in_order_equal_one_pass(spark, tmp_path):
    r = random.Random(9)
    rows = [("AB"[i % 2], START + dt.timedelta(minutes=i), r.choice(["longopen", "shortopen", "allclose"]), r.random(), 100.0 + i) for i in range(80)]
    late = sorted(rows, key=lambda x: x[1] + dt.timedelta(minutes=r.randint(0, 6)))
    df = spark.createDataFrame([(*x, i // 20) for i, x in enumerate(late)], "symbol string, opentime timestamp, label string, score double, close double, part int")
    live = L.limits_in_order(stream(spark, df, tmp_path, 4), 0.01, 0.05, 0.4, "10 minutes")
    run(live.writeStream.format("parquet").option("path", f"{tmp_path}/out"), tmp_path)
    got = {(x["symbol"], x["opentime"]): (x["lo"], x["lc"], x["so"], x["sc"]) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for s in "AB":
        now = dict(L.NO_LIMITS)
        for x in (x for x in rows if x[0] == s):
            now = L.advised(now, *x[2:], 0.01, 0.05, 0.4)
            want[s, x[1]] = tuple(now[k] for k in ("lo", "lc", "so", "sc"))
    until = rows[-1][1] - dt.timedelta(minutes=10)
    assert got == {k: v for k, v in want.items() if k[1] <= until}


@pytest.mark.parametrize("delay", [None, "10 minutes"])
def test_limits_of_batches_equal_one_pass(spark, tmp_path, delay):
    """In pieces of seven rows; rows of equal time go by their id."""
    r = random.Random(19)
    rows = [("AB"[i % 2], START + dt.timedelta(minutes=i - i % 4), r.choice(["longopen", "shortopen", "allclose"]), r.random(), 100.0 + i, i) for i in range(80)]
    df = spark.createDataFrame([(*x, i // 20) for i, x in enumerate(rows)], "symbol string, opentime timestamp, label string, score double, close double, event_id int, part int")
    df = df.withColumn("minute", F.unix_micros("opentime") / 6e7).orderBy(F.desc("event_id"))
    at = "minute" if delay is None else "opentime"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        run(L.advice_batches(stream(spark, df, tmp_path, 4), f"{tmp_path}/out", 0.01, 0.05, 0.4, at, delay, ["event_id"]), tmp_path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, until = [], rows[-1][1] - dt.timedelta(minutes=10)
    for s in "AB":
        now = dict(L.NO_LIMITS)
        for x in (x for x in rows if x[0] == s):
            now = L.advised(now, *x[2:5], 0.01, 0.05, 0.4)
            if delay is None or x[1] <= until:
                want.append((s, x[1].timestamp() / 60 if delay is None else x[1], *(now[k] for k in ("lo", "lc", "so", "sc"))))
    assert sorted(map(tuple, L.ordered_rows(spark, f"{tmp_path}/out", L.advice_schema(at)).collect())) == sorted(want)


def test_walks_are_the_same_for_all(spark):
    frame, df = walk(spark)
    assert len(frame) == df.count()
