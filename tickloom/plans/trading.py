"""Queries: rules, replay, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import ml
from tickloom.operators import replay as P
from tickloom.operators import rules as R
from tickloom.operators.targets import bounds_target
from tickloom.operators.windows import number_rows
from tickloom.plans.files import folder
from tickloom.plans.pipelines import feature_columns, features_targets
from tickloom.plans.registry import HOURS, W, hours, line_sql, lined, query, table
from tickloom.plans.targets import PRED, recursive, scored
from tickloom.streaming import bars as L

KEYS = "symbol, opentime"
BAND = R.Band(buy=-0.1, sell=0.1, volatility_long=-0.01, volatility_short=0.01, trend_long=0.2, trend_short=-0.2)


def _band_sql(y: str, g: str, hold: bool) -> str:
    tail = f"WHEN {g} >= -0.01 THEN 'longhold' WHEN {g} <= 0.01 THEN 'shorthold' ELSE 'allclose'" if hold else "ELSE 'shorthold'"
    return f"""CASE WHEN (pivot < {y} * 0.9 AND {g} >= -0.01) OR {g} >= 0.2 THEN 'longopen' WHEN before >= {y} * 1.1 AND {g} < 0.2 THEN 'longclose'
    WHEN (pivot > {y} * 1.1 AND {g} <= 0.01) OR {g} <= -0.2 THEN 'shortopen' WHEN before <= {y} * 0.9 AND {g} > -0.2 THEN 'shortclose' {tail} END"""


GAIN24 = "(grad * 23) / regry"
RULE = f"{HOURS}, {line_sql(24)}, ru AS (SELECT *, lag(pivot) OVER ({W}) AS before, {GAIN24} AS g FROM line)"


@query("r1_rule_advice_band", f"{RULE} SELECT {KEYS}, {_band_sql('regry', 'g', True)} AS label FROM ru")
def _(spark, d):
    return R.rule_advice_band(lined(spark, d), 24, BAND).select("symbol", "opentime", "label")


SIX = line_sql(6).replace("line AS", "l0 AS")
TOUCH = f"""{HOURS}, {line_sql(24)}, {SIX}, l6 AS (SELECT symbol AS s6, rn AS rn6, grad AS g6, regry AS y6 FROM l0),
  two AS (SELECT line.*, y6, g6, sign(round(pivot - regry, 9)) AS d24, sign(round(pivot - y6, 9)) AS d6 FROM line JOIN l6 ON s6 = symbol AND rn6 = rn),
  cr AS (SELECT *, coalesce((d24 * lag(d24) OVER ({W}) <= 0)::INT, 0) AS c24, coalesce((d6 * lag(d6) OVER ({W}) <= 0)::INT, 0) AS c6 FROM two),
  nr AS (SELECT *, sum(c24) OVER w AS n24, sum(c6) OVER w AS n6 FROM cr WINDOW w AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
  touched AS (SELECT *, CASE WHEN rn < 24 THEN true ELSE n24 > 0 AND coalesce(lag(n24, 12) OVER ({W}), 0) > 0 END AS t24,
    CASE WHEN rn < 24 THEN false ELSE n6 > 0 AND coalesce(lag(n6, 12) OVER ({W}), 0) > 0 END AS t6, lag(pivot) OVER ({W}) AS before FROM nr)"""


def steady_lines(spark, d):
    """Lines whose distances of noise size from the price are zero, as in the SQL."""
    df = lined(spark, d, (6, 24))
    for w in (6, 24):
        gap = F.col("pivot") - F.col(f"regry_{w}")
        df = df.withColumn(f"regry_{w}", F.when(F.round(gap, 9) == 0, F.col("pivot")).otherwise(F.col(f"regry_{w}")))
    return df


@query("r2_regression_touched", f"{TOUCH} SELECT {KEYS}, t6 AS touched_6, t24 AS touched_24 FROM touched")
def _(spark, d):
    return R.regression_touched(steady_lines(spark, d), [6, 24], 24).select("symbol", "opentime", "touched_6", "touched_24")


@query("r3_rule_advice_switch", f"{TOUCH}, sw AS (SELECT *, CASE WHEN t6 THEN y6 ELSE regry END AS y, CASE WHEN t6 THEN g6 * 5 / y6 ELSE grad * 23 / regry END AS g FROM touched) SELECT {KEYS}, {_band_sql('y', 'g', False)} AS label FROM sw")
def _(spark, d):
    return R.rule_advice_switch(steady_lines(spark, d), [6, 24], 24, BAND).select("symbol", "opentime", "label")


FOCUS = f"""{recursive(HOURS)}, {line_sql(24)}, {SIX}, l6 AS (SELECT symbol AS s6, rn AS rn6, grad AS g6, regry AS y6 FROM l0),
  two AS (SELECT symbol, rn, opentime, pivot, y6, regry AS y24, 1 - (y6 - g6 * 5) / y6 AS k6, 1 - (regry - grad * 23) / regry AS k24 FROM line JOIN l6 ON s6 = symbol AND rn6 = rn)"""


def _focus_step(source: str) -> str:
    """One row further: the label from the open side and its window, then the side and window from the label."""
    held = """CASE WHEN side = 1 THEN CASE WHEN k < 0.15 AND pivot >= y * 1.05 THEN 'longclose' ELSE 'longhold' END
      WHEN side = -1 THEN CASE WHEN k > -0.15 AND pivot <= y * 0.95 THEN 'shortclose' ELSE 'shorthold' END ELSE 'allclose' END"""
    return f"""SELECT symbol, rn, opentime, label, CASE label WHEN 'longopen' THEN 1 WHEN 'longhold' THEN 1 WHEN 'shortopen' THEN -1 WHEN 'shorthold' THEN -1 ELSE 0 END AS side,
      CASE WHEN abs(k6) >= 0.3 THEN 6 WHEN label IN ('longopen', 'shortopen') THEN 24 ELSE focus END AS focus
      FROM (SELECT *, CASE WHEN k6 >= 0.3 THEN 'longopen' WHEN k6 <= -0.3 THEN 'shortopen' WHEN side <> 0 AND focus = 6 THEN {held}
        WHEN k24 >= 0.3 THEN 'longopen' WHEN k24 <= -0.3 THEN 'shortopen' ELSE {held} END AS label
      FROM (SELECT *, CASE WHEN focus = 6 THEN k6 ELSE k24 END AS k, CASE WHEN focus = 6 THEN y6 ELSE y24 END AS y FROM ({source})))"""


@query(
    "r4_rule_advice_focus",
    f"""{FOCUS}, walk AS ({_focus_step("SELECT *, 0 AS side, 0 AS focus FROM two WHERE rn = 1")}
    UNION ALL {_focus_step("SELECT two.*, walk.side, walk.focus FROM walk JOIN two ON two.symbol = walk.symbol AND two.rn = walk.rn + 1")})
    SELECT {KEYS}, label, CASE WHEN side = 0 THEN 0 ELSE focus END AS regrwindow FROM walk""",
)
def _(spark, d):
    return R.rule_advice_focus(lined(spark, d, (6, 24)), [6, 24], 0.3, -0.3, 0.5, 0.05).select("symbol", "opentime", "label", "regrwindow")


def _simulated(keys: str, source: str) -> str:
    """CTEs and select of trades from labelled rows lab (keys, rn, opentime, pivot, label): one open at a time."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    cols = ", ".join(f"l.{k}" for k in keys.split(", "))
    return f"""{source}, walk AS (SELECT {keys}, rn, CASE label WHEN 'longopen' THEN 1 WHEN 'shortopen' THEN -1 ELSE 0 END AS side FROM lab WHERE rn = 1
      UNION ALL SELECT {cols}, l.rn, CASE WHEN w.side = 1 THEN CASE WHEN l.label = 'longclose' THEN 0 ELSE 1 END WHEN w.side = -1 THEN CASE WHEN l.label = 'shortclose' THEN 0 ELSE -1 END
        WHEN l.label = 'longopen' THEN 1 WHEN l.label = 'shortopen' THEN -1 ELSE 0 END FROM walk w JOIN lab l ON {on("l", "w")} AND l.rn = w.rn + 1),
    m AS (SELECT *, lag(side) OVER (PARTITION BY {keys} ORDER BY rn) AS before, max(rn) OVER (PARTITION BY {keys}) AS n FROM walk),
    o AS (SELECT {keys}, rn AS s, side, n FROM m WHERE side <> 0 AND coalesce(before, 0) = 0),
    e AS (SELECT {", ".join("o." + k for k in keys.split(", "))}, o.s, o.side, coalesce(min(m.rn), any_value(o.n)) AS e FROM o LEFT JOIN m ON {on("o", "m")} AND m.rn > o.s AND m.side = 0 GROUP BY ALL)
    SELECT {", ".join("e." + k for k in keys.split(", "))}, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS trade, a.opentime AS buydt, b.opentime AS selldt, date_diff('minute', a.opentime, b.opentime) AS minutes,
    a.pivot AS buyprice, b.pivot AS sellprice, CASE WHEN side > 0 THEN (b.pivot * 0.999 - a.pivot * 1.001) / (a.pivot * 1.001) ELSE (a.pivot * 0.999 - b.pivot * 1.001) / (a.pivot * 0.999) END AS gain,
    (a.pivot + b.pivot) * 0.001 AS fee FROM e JOIN lab a ON {on("a", "e")} AND a.rn = e.s JOIN lab b ON {on("b", "e")} AND b.rn = e.e"""


@query("r5_simulate_rule", _simulated("symbol", f"{recursive(RULE)}, lab AS (SELECT symbol, rn, opentime, pivot, {_band_sql('regry', 'g', True)} AS label FROM ru)"), "buyprice sellprice gain fee")
def _(spark, d):
    return R.simulate_rule(R.rule_advice_band(lined(spark, d), 24, BAND), 0.001)


GRID = "grid AS (SELECT range::INT AS cfgid, -0.05 - range * 0.02 AS buy, 0.05 + range * 0.02 AS sell FROM range(6))"
SWEEP = """CASE WHEN (pivot < regry * (1 + buy) AND g >= -0.01) OR g >= 0.2 THEN 'longopen' WHEN before >= regry * (1 + sell) AND g < 0.2 THEN 'longclose'
    WHEN (pivot > regry * (1 + sell) AND g <= 0.01) OR g <= -0.2 THEN 'shortopen' WHEN before <= regry * (1 + buy) AND g > -0.2 THEN 'shortclose' ELSE 'allclose' END"""


@query("r6_sweep_configs", _simulated("symbol, cfgid", f"{recursive(RULE)}, {GRID}, lab AS (SELECT symbol, cfgid, rn, opentime, pivot, {SWEEP} AS label FROM ru, grid)"), "buyprice sellprice gain fee")
def _(spark, d):
    grid = spark.range(6).select(
        F.col("id").cast("int").alias("cfgid"), (-0.05 - F.col("id") * 0.02).alias("buy"), (0.05 + F.col("id") * 0.02).alias("sell"), F.lit(-0.01).alias("volatility_long"),
        F.lit(0.01).alias("volatility_short"), F.lit(0.2).alias("trend_long"), F.lit(-0.2).alias("trend_short"),
    )
    return R.sweep_configs(lined(spark, d), 24, grid, 0.001)


@query("r7_multi_position_replay")
def _(spark, d):
    return R.multi_position_replay(lined(spark, d), 24, 0.1, 0.1, 2, 2, most=3, trendrows=48)


LIMITS = P.LimitConfig(openthreshold=0.3, buygain=0.02, sellgain=0.1, maxwindow=24)


def grouped(spark, d):
    return scored(spark, d).withColumn("rangeid", F.lit(1))


@query("r8_limit_reversal_replay")
def _(spark, d):
    return P.limit_reversal_replay(grouped(spark, d), LIMITS)


@query("r8_limit_reversal_rows")
def _(spark, d):
    return P.limit_reversal_rows(grouped(spark, d), LIMITS)


@query("r9_open_close_limits", f"{HOURS}, l AS (SELECT *, CASE rn % 3 WHEN 0 THEN 'longopen' WHEN 1 THEN 'shortopen' ELSE 'allclose' END AS label FROM bars) SELECT {KEYS}, CASE WHEN rn % 3 = 0 THEN close * 0.98 END AS lo, CASE WHEN rn % 3 = 0 THEN close * 1.1 END AS lc, CASE WHEN rn % 3 = 1 THEN close * 1.02 END AS so, CASE WHEN rn % 3 = 1 THEN close * 0.9 END AS sc FROM l", "lo lc so sc")
def _(spark, d):
    df = number_rows(hours(spark, d))
    label = F.when(F.col("rn") % 3 == 0, "longopen").when(F.col("rn") % 3 == 1, "shortopen").otherwise("allclose")
    limits = P.open_close_limits(label, F.col("close"), LIMITS)
    return df.select("symbol", "opentime", *[x.alias(n) for x, n in zip(limits, ("lo", "lc", "so", "sc"), strict=True)])


@query("r10_check_trade_rows")
def _(spark, d):
    return P.check_trade_rows(P.limit_reversal_rows(grouped(spark, d), LIMITS))


# Trade rows with planted faults: amounts, prices, limits and times by the row's number.
FAULTS = {
    "lp_amount": ("rn % 5 < 2", 100.0), "sp_amount": ("rn % 7 IN (1, 2)", 100.0), "l_pavg": ("rn % 11 <> 0", 9.5), "s_pavg": ("rn % 13 <> 1", 9.5),
    "lc_limit": ("rn % 6 <> 5", 10.5), "sc_limit": ("rn % 8 <> 2", 8.5),
}


@query(
    "r10_faults_of_trade_rows",
    f"""{HOURS}, t AS (SELECT symbol, rn, {", ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END AS {k}" for k, (c, v) in FAULTS.items())}, CASE WHEN rn % 3 = 0 THEN opentime END AS lastopentrade FROM bars),
    r AS (SELECT symbol, rn::INT AS rn, CASE WHEN lp_amount > 0 AND sp_amount > 0 THEN 'long_and_short' WHEN lp_amount > 0 AND l_pavg <= 0 THEN 'long_without_price' WHEN sp_amount > 0 AND s_pavg <= 0 THEN 'short_without_price'
      WHEN lp_amount + sp_amount = 0 AND lastopentrade IS NOT NULL THEN 'flat_with_time' WHEN lp_amount > 0 AND lc_limit <= 0 THEN 'long_without_close' WHEN sp_amount > 0 AND sc_limit <= 0 THEN 'short_without_close' END AS rule FROM t)
    SELECT * FROM r WHERE rule IS NOT NULL""",
)
def _(spark, d):
    rows = number_rows(hours(spark, d))
    rows = rows.withColumns({k: F.when(F.expr(c), F.lit(v)).otherwise(0.0) for k, (c, v) in FAULTS.items()})
    return P.check_trade_rows(rows.withColumn("lastopentrade", F.when(F.col("rn") % 3 == 0, F.col("opentime")))).select("symbol", "rn", "rule")


@query("r11_true_vs_predicted_gains")
def _(spark, d):
    return P.true_vs_predicted_gains(grouped(spark, d), LIMITS)


TRIPS = """f AS (SELECT l_suppkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_shipdate, l_orderkey * 8 + l_linenumber AS fill_id, l_extendedprice::DOUBLE / l_quantity::DOUBLE AS price, l_quantity::DOUBLE AS quantity FROM lineitem),
  n AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY l_shipdate, fill_id) AS n FROM f),
  trips AS (SELECT b.symbol, b.n::INT AS n, least(b.quantity, s.quantity) AS quantity, 100 * (s.price - b.price) / b.price AS gain_pct, (s.price - b.price) * least(b.quantity, s.quantity) AS gain_amount, s.price > b.price AS win
  FROM n b JOIN n s ON b.symbol = s.symbol AND b.n = s.n AND b.side = 'buy' AND s.side = 'sell')"""


def trips(spark, d):
    fills = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fill_id"), (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("price"), F.col("l_quantity").cast("double").alias("quantity"),
    )
    return P.round_trips(fills)


@query("r12_round_trips", f"WITH {TRIPS} SELECT * FROM trips", "quantity gain_pct gain_amount")
def _(spark, d):
    return trips(spark, d)


@query("r13_backtest_report", f"WITH {TRIPS} SELECT symbol, count(*) AS trips, avg(win::INT::DOUBLE) AS win_rate, avg(gain_pct) AS mean_gain_pct, sum(gain_amount) AS total FROM trips GROUP BY ROLLUP (symbol)", "win_rate mean_gain_pct total")
def _(spark, d):
    return P.backtest_report(trips(spark, d))


@query(
    "r14_allocate_budget",
    f"""{recursive(PRED)}, sig AS (SELECT opentime, symbol, label, close, CASE WHEN rn % 4 = 0 THEN 1 ELSE 0 END::DOUBLE AS position, label IN ('longopen', 'shortopen') AS opens,
      row_number() OVER (PARTITION BY opentime ORDER BY symbol) AS i FROM best),
    step AS (SELECT opentime, least(500 + sum(position * close), 600) AS capped, count(*) FILTER (opens) AS n FROM sig GROUP BY opentime),
    ord AS (SELECT *, least(floor(capped / 50), n)::INT AS orders FROM step),
    walk AS (SELECT opentime, 0::BIGINT AS i, capped AS rest, capped / nullif(orders, 0) AS share, 0::DOUBLE AS amount, '' AS reason FROM ord
      UNION ALL SELECT opentime, i, CASE WHEN bought THEN rest - want * close ELSE rest END, share, CASE WHEN bought THEN want ELSE 0 END,
        CASE WHEN NOT opens THEN 'no open' WHEN bought THEN 'open' WHEN goes THEN 'full position' ELSE 'insufficient quote' END
      FROM (SELECT *, goes AND want * close >= 50 AS bought FROM (SELECT s.*, w.rest, w.share, s.opens AND w.rest >= 50 AND w.share IS NOT NULL AS goes,
        least(greatest(w.share / s.close - s.position, 0), w.rest / s.close) AS want FROM walk w JOIN sig s ON s.opentime = w.opentime AND s.i = w.i + 1)))
    SELECT sig.opentime, symbol, label, amount, reason FROM walk JOIN sig USING (opentime, i)""",
    "amount",
)
def _(spark, d):
    df = scored(spark, d).withColumn("position", F.when(F.col("rn") % 4 == 0, 1.0).otherwise(0.0)).withColumn("freequote", F.lit(500.0)).withColumn("equity", F.lit(800.0))
    return P.allocate_budget(df.select("opentime", "symbol", "label", "close", "position", "freequote", "equity"), 50.0, 600.0)


POSITION = f"""{HOURS}, p AS (SELECT *, CASE WHEN (rn // 7) % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS position FROM bars), n AS (SELECT *, ((position > 0) IS DISTINCT FROM (lag(position) OVER ({W}) > 0))::INT AS fresh FROM p),
  i AS (SELECT *, sum(fresh) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM n)"""


@query("r15_last_open_trade", f"{POSITION} SELECT {KEYS}, CASE WHEN position > 0 THEN min(opentime) OVER (PARTITION BY symbol, island) END AS lastopentrade FROM i")
def _(spark, d):
    df = number_rows(hours(spark, d)).withColumn("position", F.when(F.floor(F.col("rn") / 7) % 3 == 1, 1.0).otherwise(0.0))
    return P.last_open_trade(df).select("symbol", "opentime", "lastopentrade")


@query(
    "r16_carry_order_lane",
    f"""{HOURS}, e AS (SELECT *, CASE WHEN rn % 9 = 1 THEN 'submitted' WHEN rn % 9 = 6 THEN 'closed' END AS st, CASE WHEN rn % 9 = 1 THEN symbol || '-' || rn END AS id FROM bars)
    SELECT {KEYS}, last_value(st IGNORE NULLS) OVER w AS lo_status_now, CASE WHEN last_value(st IGNORE NULLS) OVER w = 'submitted' THEN last_value(id IGNORE NULLS) OVER w END AS lo_id_now FROM e
    WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    r = F.col("rn") % 9
    df = number_rows(hours(spark, d)).withColumn("lo_status", F.when(r == 1, "submitted").when(r == 6, "closed"))
    df = df.withColumn("lo_id", F.when(r == 1, F.concat_ws("-", "symbol", "rn"))).withColumn("lo_filled", F.when(r == 1, 0.0).when(r == 6, 1.0))
    return P.carry_order_lane(df, "lo").select("symbol", "opentime", "lo_status_now", "lo_id_now")


@query("r17_flip_plan", f"{HOURS} SELECT {KEYS}, CASE rn % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END::DOUBLE AS flip_quantity, CASE rn % 3 WHEN 0 THEN close * 0.99 WHEN 1 THEN close * 1.01 END AS flip_limit FROM bars", "flip_quantity flip_limit")
def _(spark, d):
    r = F.col("rn") % 3
    df = number_rows(hours(spark, d)).withColumn("label", F.when(r == 0, "longopen").when(r == 1, "shortopen").otherwise("allclose"))
    df = df.withColumn("sp_amount", F.lit(2.0)).withColumn("lp_amount", F.lit(3.0)).withColumn("lo_limit", F.col("close") * 0.99).withColumn("so_limit", F.col("close") * 1.01)
    return P.flip_plan(df).select("symbol", "opentime", "flip_quantity", "flip_limit")


@query(
    "r18_apply_order_fills",
    """SELECT c_custkey AS symbol, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DOUBLE END, 0) + 1 AS lp_amount, coalesce(o_totalprice::DOUBLE, 0) AS lo_filled, CASE WHEN o_orderstatus <> 'F' THEN c_custkey END AS lo_id
    FROM customer LEFT JOIN orders ON o_orderkey = c_custkey""",
    "lp_amount lo_filled",
)
def _(spark, d):
    key = F.col("c_custkey")
    none = F.lit(None).cast("bigint")
    rows = table(spark, d, "customer").select(key.alias("symbol"), key.alias("lo_id"), none.alias("lc_id"), none.alias("so_id"), none.alias("sc_id"), F.lit(1.0).alias("lp_amount"), F.lit(0.0).alias("sp_amount"))
    status = F.when(F.col("o_orderstatus") == "F", "closed").otherwise("submitted")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderid"), status.alias("status"), F.col("o_totalprice").cast("double").alias("executedqty"), F.lit(1.0).alias("avgprice"))
    return P.apply_order_fills(rows, orders).select("symbol", "lp_amount", "lo_filled", "lo_id")


# ------------------------------------------------------------------ models


@query("c11_fit_trend_classifier")
def _(spark, d):
    rows = features_targets(hours(spark, d)).dropna().persist()
    train = rows.where("set = 'train'")
    model = ml.fit_trend_classifier(train, feature_columns())
    out = ml.predict(model, rows.withColumnRenamed("label", "target"))
    return out.groupBy("set", "label", "target").agg(F.count("*").alias("n"))


@query("c12_fit_bounds_regressor")
def _(spark, d):
    rows = features_targets(hours(spark, d)).dropna()
    bounds = bounds_target(hours(spark, d), 10, relative=True, forward=True).select("symbol", "opentime", "center", "width")
    rows = rows.join(bounds, ["symbol", "opentime"]).persist()
    models = ml.fit_bounds_regressor(rows.where("set = 'train'"), feature_columns())
    return ml.predict_bounds(models, rows).groupBy("set").agg(F.avg(F.abs(F.col("centerpred") - F.col("center"))).alias("mae_center"), F.avg(F.abs(F.col("widthpred") - F.col("width"))).alias("mae_width"))


@query("c13_predict")
def _(spark, d):
    rows = features_targets(hours(spark, d)).dropna()
    model = ml.fit_trend_classifier(rows.where("set = 'train'"), feature_columns(), balance=False)
    return ml.predict(model, rows).select("symbol", "opentime", "label", "score")


# ------------------------------------------------------------------ streams


def _events(spark, d):
    """The events table as a stream of its file."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


def _drained(spark, df, mode: str):
    """All rows that a stream gives, by a folder sink beside the session's checkpoints."""
    name = folder(spark)
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{name}/out").option("checkpointLocation", f"{name}/at").trigger(availableNow=True).start()
    else:
        save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{name}/out")
        q = df.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{name}/at").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{name}/out")


def _ordered(spark, writer, schema: str):
    """All rows that batches in order give; writer is made from the folder for them."""
    name = folder(spark)
    writer(f"{name}/out").option("checkpointLocation", f"{name}/at").trigger(availableNow=True).start().awaitTermination()
    return L.ordered_rows(spark, f"{name}/out", schema)


@query(
    "l1_stream_bars",
    f"""{HOURS} SELECT symbol, opentime, open, high, low, close, basevolume, pivot FROM bars
    WHERE opentime + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "open high low close basevolume pivot",
)
def _(spark, d):
    return _drained(spark, L.stream_bars(_events(spark, d), 60, "10 minutes"), "append")


GATE = "e.minute - w.m >= 60 OR abs(e.close - w.c) / greatest(abs(w.c), 1e-6) >= 0.5"


@query(
    "l4_gate_classification",
    f"""WITH RECURSIVE e AS (SELECT event_type AS symbol, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 6e7::DOUBLE AS minute, value AS close,
      row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events WHERE value IS NOT NULL),
    walk AS (SELECT *, true AS classify, minute AS m, close AS c FROM e WHERE rn = 1
      UNION ALL SELECT e.*, {GATE}, CASE WHEN {GATE} THEN e.minute ELSE w.m END, CASE WHEN {GATE} THEN e.close ELSE w.c END FROM walk w JOIN e ON e.symbol = w.symbol AND e.rn = w.rn + 1)
    SELECT symbol, minute, close, classify FROM walk""",
    "minute close",
)
def _(spark, d):
    rows = _events(spark, d).where("value is not null").select(F.col("event_type").alias("symbol"), _minute().alias("minute"), F.col("value").alias("close"), "event_id")
    return _ordered(spark, lambda path: L.gate_batches(rows, path, 60.0, 0.5, tie=["event_id"]), L.gate_schema("minute"))


def _minute():
    """Minutes since 2024 with their fraction, so that events have an order."""
    return F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 6e7


@query(
    "l4_gate_in_order",
    f"""WITH RECURSIVE e AS (SELECT event_type AS symbol, ts, date_diff('microsecond', TIMESTAMP '1970-01-01', ts) / 6e7::DOUBLE AS minute, value AS close,
      row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events WHERE value IS NOT NULL),
    walk AS (SELECT *, true AS classify, minute AS m, close AS c FROM e WHERE rn = 1
      UNION ALL SELECT e.*, {GATE}, CASE WHEN {GATE} THEN e.minute ELSE w.m END, CASE WHEN {GATE} THEN e.close ELSE w.c END FROM walk w JOIN e ON e.symbol = w.symbol AND e.rn = w.rn + 1)
    SELECT symbol, ts AS opentime, close, classify FROM walk WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) FROM e) - INTERVAL 10 MINUTE""",
    "close",
)
def _(spark, d):
    rows = _events(spark, d).where("value is not null").select(F.col("event_type").alias("symbol"), F.col("ts").alias("opentime"), F.col("value").alias("close"), "event_id")
    found = _ordered(spark, lambda path: L.gate_batches(rows, path, 60.0, 0.5, "opentime", "10 minutes", ["event_id"]), L.gate_schema("opentime"))
    return found.withColumn("opentime", F.col("opentime").cast("timestamp_ntz"))


@query(
    "l5_stream_advice",
    """WITH l AS (SELECT event_type AS symbol, ts, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 6e7::DOUBLE AS minute, value AS close, event_id % 7 = 0 AS long, event_id % 7 = 3 AS short FROM events WHERE value IS NOT NULL)
    SELECT symbol, minute, CASE WHEN long THEN close * 0.99 ELSE 0 END::DOUBLE AS lo, coalesce(last_value(CASE WHEN long THEN close END IGNORE NULLS) OVER w, 0) * 1.05 AS lc,
    CASE WHEN short THEN close * 1.01 ELSE 0 END::DOUBLE AS so, coalesce(last_value(CASE WHEN short THEN close END IGNORE NULLS) OVER w, 0) * 0.95 AS sc FROM l
    WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "minute lo lc so sc",
)
def _(spark, d):
    label = F.when(F.col("event_id") % 7 == 0, "longopen").when(F.col("event_id") % 7 == 3, "shortopen").otherwise("allclose")
    rows = _events(spark, d).where("value is not null").select(
        F.col("event_type").alias("symbol"), _minute().alias("minute"), label.alias("label"), F.lit(0.9).alias("score"), F.col("value").alias("close"), "event_id"
    )
    return _ordered(spark, lambda path: L.advice_batches(rows, path, 0.01, 0.05, 0.5, tie=["event_id"]), L.advice_schema("minute"))


@query("l6_feed_heartbeats", "SELECT event_type AS symbol, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return _drained(spark, L.feed_heartbeats(_events(spark, d)), "update")


@query(
    "l6_stale_feeds",
    "SELECT event_type AS symbol, max(ts) AS last_ts, true AS stale FROM events GROUP BY event_type HAVING epoch_ms(max(ts)) + 300000 <= (SELECT epoch_ms(max(ts)) FROM events) - 600000",
)
def _(spark, d):
    found = _drained(spark, L.stale_feeds(_events(spark, d), 5, "10 minutes"), "append")
    return found.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))
