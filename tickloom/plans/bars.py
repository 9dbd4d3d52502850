"""Queries: sources, column functions, bars and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import scalar
from tickloom.operators import bars as B
from tickloom.operators import joins as J
from tickloom.operators import summaries as Z
from tickloom.operators.windows import number_rows
from tickloom.plans.registry import DAYS, HOURS, MINUTES, W, days, hours, line_sql, lined, minutes, query, table
from tickloom.sources import bars as S

OHLCV = "symbol, opentime, open, high, low, close, basevolume, pivot"
NUM = "open high low close basevolume pivot"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("s13_event_bars_1h", f"{HOURS} SELECT {OHLCV} FROM bars", NUM)
def _(spark, d):
    return hours(spark, d)


@query("s13_event_bars_1m", f"{MINUTES} SELECT {OHLCV} FROM bars", NUM)
def _(spark, d):
    return minutes(spark, d)


@query("s13_lineitem_bars_1d", f"{DAYS} SELECT {OHLCV} FROM bars", NUM)
def _(spark, d):
    return days(spark, d)


@query("s1_time_cut_bars", f"{HOURS} SELECT {OHLCV} FROM bars WHERE symbol IN ('click', 'view') AND opentime >= TIMESTAMP '2024-01-05' AND opentime <= TIMESTAMP '2024-01-12'", NUM)
def _(spark, d):
    return scalar.time_cut(hours(spark, d).where(F.col("symbol").isin("click", "view")), "2024-01-05", "2024-01-12")


@query(
    "s2_newer_rows",
    f"""{HOURS}, old AS (SELECT symbol, max(opentime) AS last FROM bars WHERE opentime < TIMESTAMP '2024-01-15' AND symbol <> 'view' GROUP BY symbol)
    SELECT {", ".join("bars." + c for c in OHLCV.split(", "))} FROM bars LEFT JOIN old USING (symbol) WHERE last IS NULL OR opentime > last""",
    NUM,
)
def _(spark, d):
    df = hours(spark, d)
    return S.newer_rows(df, df.where((F.col("opentime") < ntz("2024-01-15")) & (F.col("symbol") != "view")))


def _klines(spark, d):
    """Candles of each day as the venues' JSON, made from the hourly bars."""
    rows = hours(spark, d).withColumn("m", S.epoch_minute(F.col("opentime")))
    text = lambda c: F.col(c).cast("string")
    linear = F.array((F.col("m") * 60000).cast("string"), *[text(c) for c in ("open", "high", "low", "close", "basevolume")])
    day = F.floor(F.col("m") / 1440)
    return rows.groupBy("symbol", day.alias("day")).agg(F.to_json(F.collect_list(linear)).alias("raw"))


@query("s5_normalize_klines", f"{HOURS} SELECT {OHLCV} FROM bars", NUM)
def _(spark, d):
    return S.normalize_klines(_klines(spark, d), "linear")


@query("s6_order_status", "SELECT CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'submitted' END AS status, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    status = S.normalize_order_status(F.col("o_orderstatus"), "tpch").alias("status")
    return table(spark, d, "orders").groupBy(status).agg(F.count("*").alias("n"))


@query(
    "s9_decimal_comma",
    "SELECT c_custkey, replace(round(c_acctbal, 2)::DECIMAL(12, 2)::VARCHAR, '.', ',') AS balance FROM customer",
)
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).cast("decimal(12,2)").cast("string").alias("balance"))
    return rows.withColumn("balance", F.regexp_replace("balance", "\\.", ","))


@query(
    "s10_reconcile_tables",
    f"""{HOURS}, s AS (SELECT symbol, count(*) AS a FROM bars GROUP BY symbol), t AS (SELECT symbol, count(*) AS b FROM bars
    WHERE opentime < TIMESTAMP '2024-01-20' AND symbol <> 'view' GROUP BY symbol)
    SELECT coalesce(sum(a), 0)::BIGINT AS rows_src, coalesce(sum(b), 0)::BIGINT AS rows_dst, count(*) FILTER (b IS NULL) AS missing,
    count(*) FILTER (a IS NULL) AS extra, count(*) FILTER (a <> b) AS uneven, true AS same_columns,
    count(*) FILTER (b IS NULL OR a IS NULL OR a <> b) = 0 AS ok FROM s FULL JOIN t USING (symbol)""",
)
def _(spark, d):
    df = hours(spark, d)
    return S.reconcile_tables(df, df.where((F.col("opentime") < ntz("2024-01-20")) & (F.col("symbol") != "view")), ["symbol"])


@query(
    "s14_append_if_new",
    "SELECT o_orderkey, o_totalprice::DOUBLE AS value FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 0.0::DOUBLE FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0",
    "value",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    old = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_totalprice").cast("double").alias("value"))
    return S.append_if_new(old, orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(0.0).alias("value")), ["o_orderkey"])


# ------------------------------------------------------------------ column functions


@query("p1_pivot", f"{HOURS} SELECT symbol, opentime, pivot FROM bars", "pivot")
def _(spark, d):
    return B.add_pivot(hours(spark, d).drop("pivot")).select("symbol", "opentime", "pivot")


@query("p2_normalize_to_last", f"{HOURS} SELECT symbol, opentime, (close / last_value(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - 1) * 100 AS normalized FROM bars", "normalized")
def _(spark, d):
    return scalar.normalize_to_last(hours(spark, d), "close", percent=True).select("symbol", "opentime", "normalized")


@query(
    "p4_relative_gain",
    f"""{HOURS} SELECT symbol, opentime, (close * 0.999 - open * 1.001) / (open * 1.001) AS forward, (close * 0.999 - open * 1.001) / (close * 0.999) AS backward,
    (close - open) / abs(open) AS between_gain FROM bars WHERE open > 0 AND close > 0""",
    "forward backward between_gain",
)
def _(spark, d):
    df, o, c = hours(spark, d).where("open > 0 and close > 0"), F.col("open"), F.col("close")
    return df.select(
        "symbol", "opentime", scalar.relative_gain(o, c, 0.001).alias("forward"), scalar.relative_gain(o, c, 0.001, False).alias("backward"),
        scalar.gain_between(o, c).alias("between_gain"),
    )


@query("p3_time_cut", f"{HOURS} SELECT symbol, opentime, close FROM bars WHERE opentime BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04 12:00:00'", "close")
def _(spark, d):
    return scalar.time_cut(hours(spark, d), "2024-01-03", "2024-01-04 12:00:00").select("symbol", "opentime", "close")


@query("p5_relative_gain_regr", f"{HOURS}, {line_sql(24)} SELECT symbol, opentime, grad * 23 / (regry - grad * 23) AS forward, grad * 23 / regry AS backward FROM line", "forward backward")
def _(spark, d):
    y, g = F.col("regry_24"), F.col("grad_24")
    return lined(spark, d).select("symbol", "opentime", scalar.relative_gain_regr(y, g, 24).alias("forward"), scalar.relative_gain_regr(y, g, 24, forward=False).alias("backward"))


@query("p6_gain_between", f"{HOURS} SELECT symbol, opentime, (close - open) / abs(open) AS gain FROM bars", "gain")
def _(spark, d):
    return hours(spark, d).select("symbol", "opentime", scalar.gain_between(F.col("open"), F.col("close")).alias("gain"))


@query("p13_select_features", f"{HOURS} SELECT symbol, opentime, high, low FROM bars", "high low")
def _(spark, d):
    return hours(spark, d).select("symbol", "opentime", *["high", "low"])


@query(
    "p7_relative_time",
    "SELECT event_id, round_even((hour(ts) * 60 + minute(ts)) / 1440.0::DOUBLE, 4) AS rel_day, round_even(isodow(ts) / 7.0::DOUBLE, 4) AS rel_week, round_even(dayofyear(ts) / 365.0::DOUBLE, 4) AS rel_year FROM events",
    "rel_day rel_week rel_year",
)
def _(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", *[scalar.relative_time(ts, k).alias(f"rel_{k}") for k in ("day", "week", "year")])


@query(
    "p9_split_pair",
    r"SELECT p_partkey, nullif(regexp_extract(p_brand || p_type, '^(.+)(ECONOMY|STANDARD)$', 1), '') AS base, nullif(regexp_extract(p_brand || p_type, '^(.+)(ECONOMY|STANDARD)$', 2), '') AS quote FROM part",
)
def _(spark, d):
    base, quote = scalar.split_pair(F.concat("p_brand", "p_type"), ["ECONOMY", "STANDARD"])
    return table(spark, d, "part").select("p_partkey", base.alias("base"), quote.alias("quote"))


@query(
    "p10_base_token",
    "SELECT event_id, CASE WHEN upper(event_type) IN ('VIEW', '') THEN NULL ELSE upper(event_type) END AS base FROM events",
)
def _(spark, d):
    kind = F.col("event_type")
    token = F.when(F.col("event_id") % 3 == 0, F.concat(kind, F.lit("/view"))).when(F.col("event_id") % 3 == 1, F.concat(F.upper(kind), F.lit("VIEW"))).otherwise(kind)
    token = F.when(F.upper(kind) == "VIEW", kind).otherwise(token)
    return table(spark, d, "events").select("event_id", scalar.base_token(token, "VIEW").alias("base"))


@query(
    "p11_parse_label",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'longopen' WHEN 1 THEN 'shortclose' WHEN 2 THEN 'allclose' WHEN 3 THEN 'longhold' ELSE 'ignore' END AS label,
    CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN -2 WHEN 2 THEN 0 WHEN 3 THEN 3 ELSE 9 END::INT AS code FROM events""",
)
def _(spark, d):
    names = F.array(*[F.lit(x) for x in ("LongBuy", "shortsell", "other", "longhold", "ignore")])
    label = scalar.parse_label(F.get(names, (F.col("event_id") % 5).cast("int")))
    return table(spark, d, "events").select("event_id", label.alias("label"), scalar.label_code(label).alias("code"))


@query(
    "p12_label_codes",
    "SELECT event_type AS symbol, count(*) FILTER (value > 50) AS longs FROM events GROUP BY ALL",
)
def _(spark, d):
    label = scalar.label_from_code(F.when(F.col("value") > 50, 4).otherwise(0))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.count_if(label == "longopen").alias("longs"))


@query("p14_polynomial_features", f'{HOURS} SELECT symbol, opentime, open, high, low, open * high AS "open*high", open * low AS "open*low", high * low AS "high*low", open * high * low AS "open*high*low" FROM bars', 'open high low "open*high" "open*low" "high*low" "open*high*low"')
def _(spark, d):
    return scalar.polynomial_features(hours(spark, d).select("symbol", "opentime", "open", "high", "low"), ["open", "high", "low"], 3)


@query("p15_score_bins", f"{HOURS}, s AS (SELECT symbol, (close - low) / nullif(high - low, 0) AS score FROM bars) SELECT least(greatest(floor(score * 10) + 1, 1), 10)::INT AS bin, count(*) AS n FROM s GROUP BY ALL")
def _(spark, d):
    score = (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return hours(spark, d).groupBy(scalar.score_bin(score, 10).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "p16_center_width",
    f"{HOURS} SELECT symbol, opentime, ((low + high) / 2 - pivot) / pivot AS center, (high - low) / pivot AS width, low, high FROM bars WHERE pivot > 0 AND low >= 0",
    "center width low high",
)
def _(spark, d):
    df = hours(spark, d).where("pivot > 0 and low >= 0")
    c, w = scalar.low_high_to_center_width(F.col("low"), F.col("high"), F.col("pivot"))
    df = df.select("symbol", "opentime", "pivot", c.alias("center"), w.alias("width"))
    low, high = scalar.center_width_to_low_high(F.col("center"), F.col("width"), F.col("pivot"))
    return df.select("symbol", "opentime", "center", "width", low.alias("low"), high.alias("high"))


@query(
    "p17_ratio_targets",
    f"{HOURS} SELECT symbol, opentime, CASE WHEN pivot > 0 THEN (close - pivot) / pivot END AS center, CASE WHEN pivot > 0 THEN (high - low) / pivot END AS width FROM bars",
    "center width",
)
def _(spark, d):
    c, w = scalar.ratio_targets(F.col("close"), F.col("high") - F.col("low"), F.col("pivot"))
    return hours(spark, d).select("symbol", "opentime", c.alias("center"), w.alias("width"))


@query(
    "p18_validate_scores",
    f"{HOURS}, bad AS (SELECT symbol, opentime, 'range' AS reason FROM bars WHERE pivot / 60 > 1 OR pivot < 0) SELECT symbol, min(opentime) AS opentime, first(reason ORDER BY opentime) AS reason FROM bad GROUP BY symbol",
)
def _(spark, d):
    return scalar.validate_scores(hours(spark, d).withColumn("score", F.col("pivot") / 60))


@query("p19_canonical_time", "SELECT event_type AS symbol, ts AS opentime, value FROM events", "value")
def _(spark, d):
    return scalar.canonical_time_column(table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp"), "value"))


@query(
    "p20_should_update_price",
    f"{HOURS}, p AS (SELECT symbol, opentime, close, lag(close) OVER ({W}) AS before FROM bars) SELECT symbol, opentime, CASE WHEN before IS NULL THEN true ELSE abs(close - before) / greatest(abs(before), 1e-6) >= 0.1 END AS changed FROM p",
)
def _(spark, d):
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("opentime"))
    df = hours(spark, d).withColumn("before", before)
    return df.select("symbol", "opentime", scalar.should_update_price(F.col("before"), F.col("close"), 0.1).alias("changed"))


@query("p21_center_width_features", f"{HOURS} SELECT symbol, opentime, pivot - (high - low) / 2 AS lower, pivot + (high - low) / 2 AS upper FROM bars", "lower upper")
def _(spark, d):
    df = hours(spark, d).withColumn("w", F.col("high") - F.col("low"))
    return scalar.center_width_features(df, "pivot", "w").select("symbol", "opentime", "lower", "upper")


@query("p22_encode_tokens", "SELECT event_id, dense_rank() OVER (ORDER BY event_type)::INT AS token_id FROM events")
def _(spark, d):
    return scalar.encode_tokens(table(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", "token_id")


def lanes(spark, d):
    """Trade rows from line items: lane by return flag and line status."""
    items = table(spark, d, "lineitem")
    lane = F.when(F.col("l_returnflag") == "R", "lo").when(F.col("l_returnflag") == "A", "lc").when(F.col("l_linestatus") == "O", "so").otherwise("sc")
    rows = items.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("opentime"), lane.alias("lane"),
        F.when(F.col("l_linenumber") == 1, "submitted").otherwise("closed").alias("status"), F.col("l_quantity").cast("double").alias("q"),
        (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("p"),
    )
    for k in ("lo", "lc", "so", "sc"):
        own = F.col("lane") == k
        rows = rows.withColumn(f"{k}_status", F.when(own, F.col("status"))).withColumn(f"{k}_filled", F.when(own, F.col("q")).otherwise(0.0))
        rows = rows.withColumn(f"{k}_pavg", F.when(own, F.col("p")).otherwise(0.0))
    return rows.drop("lane", "status", "q", "p")


LANES = """lanes AS (SELECT 'S' || l_suppkey AS symbol, l_shipdate::TIMESTAMP AS opentime, CASE WHEN l_returnflag = 'R' THEN 'lo' WHEN l_returnflag = 'A' THEN 'lc'
  WHEN l_linestatus = 'O' THEN 'so' ELSE 'sc' END AS lane, l_linenumber, l_quantity::DOUBLE AS filled, l_extendedprice::DOUBLE / l_quantity::DOUBLE AS price FROM lineitem)"""


@query(
    "p23_decode_order_lanes",
    f"WITH {LANES} SELECT symbol, opentime, lane, CASE WHEN lane IN ('lo', 'sc') THEN 'buy' ELSE 'sell' END AS side, filled, price FROM lanes WHERE l_linenumber <> 1",
    "filled price",
)
def _(spark, d):
    return scalar.decode_order_lanes(lanes(spark, d))


# ------------------------------------------------------------------ bars


@query(
    "b1_resample_4h",
    f"""{HOURS} SELECT symbol, time_bucket(INTERVAL '4 hours', opentime) AS opentime, first(open ORDER BY opentime) AS open, max(high) AS high, min(low) AS low,
    last(close ORDER BY opentime) AS close, sum(basevolume) AS basevolume, (first(open ORDER BY opentime) + max(high) + min(low) + last(close ORDER BY opentime)) / 4 AS pivot
    FROM bars GROUP BY symbol, time_bucket(INTERVAL '4 hours', bars.opentime)""",
    NUM,
)
def _(spark, d):
    return B.resample(hours(spark, d), 240)


FILLED = f"""filled AS (SELECT symbol, unnest(generate_series(opentime, greatest(opentime, coalesce(next - INTERVAL 1 HOUR, opentime)), INTERVAL 1 HOUR)) AS t, * EXCLUDE (symbol, rn)
  FROM (SELECT *, lead(opentime) OVER ({W}) AS next FROM bars))"""


@query("b2_fill_gaps", f"{HOURS}, {FILLED} SELECT symbol, t AS opentime, open, high, low, close, CASE WHEN t = opentime THEN basevolume ELSE 0 END AS basevolume, pivot FROM filled", NUM)
def _(spark, d):
    return B.fill_gaps(hours(spark, d), 60).select("symbol", "opentime", "open", "high", "low", "close", "basevolume", "pivot")


@query(
    "b3_interval_issues",
    f"""{HOURS}, t AS (SELECT symbol, opentime, date_diff('second', lag(opentime) OVER ({W}), opentime) AS seconds FROM bars)
    SELECT * FROM t WHERE seconds < 7200""",
)
def _(spark, d):
    return B.detect_interval_issues(hours(spark, d), 120)


@query(
    "b4_check_bars",
    f"""{HOURS}, t AS (SELECT symbol, rn::INT AS rn, date_diff('second', lag(opentime) OVER ({W}), opentime) AS back, date_diff('second', opentime, lead(opentime) OVER ({W})) AS ahead,
      open, high, low, close, pivot FROM bars),
    c AS (SELECT symbol, rn, 'opentime' AS "column", 'out_of_sequence' AS category FROM t WHERE back <> 3600 OR ahead <> 3600
      UNION ALL SELECT symbol, rn, 'open', 'out_of_range' FROM t WHERE open < 0 UNION ALL SELECT symbol, rn, 'high', 'out_of_range' FROM t WHERE high < 0
      UNION ALL SELECT symbol, rn, 'low', 'out_of_range' FROM t WHERE low < 0 UNION ALL SELECT symbol, rn, 'close', 'out_of_range' FROM t WHERE close < 0
      UNION ALL SELECT symbol, rn, 'pivot', 'out_of_range' FROM t WHERE pivot < 0) SELECT * FROM c""",
)
def _(spark, d):
    return B.check_bars(hours(spark, d), 60)


def _ticks_as_bars(spark, d):
    e = table(spark, d, "events").where("value is not null")
    v = F.col("value")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").alias("opentime"), v.alias("close"), (F.col("event_id") % 2).cast("double").alias("basevolume"), "event_id")


@query(
    "b5_cure_bars",
    """WITH t AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS opentime, value AS close, (event_id % 2)::DOUBLE AS basevolume, event_id,
      row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY (event_id % 2) = 0, CASE WHEN event_id % 2 = 0 THEN -epoch_us(ts) ELSE epoch_us(ts) END) AS n
      FROM events WHERE value IS NOT NULL) SELECT symbol, opentime, close, basevolume, event_id FROM t WHERE n = 1""",
    "close basevolume",
)
def _(spark, d):
    return B.cure_bars(_ticks_as_bars(spark, d))


AB = f"""{HOURS}, a AS (SELECT symbol, opentime, close FROM bars WHERE opentime < TIMESTAMP '2024-01-20'),
  b AS (SELECT symbol, opentime, close + 1 AS close FROM bars WHERE opentime >= TIMESTAMP '2024-01-10')"""


def _ab(spark, d, start="2024-01-10"):
    df = hours(spark, d).select("symbol", "opentime", "close")
    return df.where(F.col("opentime") < ntz("2024-01-20")), df.where(F.col("opentime") >= ntz(start)).withColumn("close", F.col("close") + 1)


@query("b6_merge_bars", f"{AB} SELECT coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.opentime, a.opentime) AS opentime, coalesce(b.close, a.close) AS close FROM a FULL JOIN b ON a.symbol = b.symbol AND a.opentime = b.opentime", "close")
def _(spark, d):
    return B.merge_bars(*_ab(spark, d))


@query(
    "b6_merge_gaps",
    f"""{HOURS}, a AS (SELECT symbol, max(opentime) AS a1 FROM bars WHERE opentime < TIMESTAMP '2024-01-10' GROUP BY symbol),
    b AS (SELECT symbol, min(opentime) AS b0 FROM bars WHERE opentime >= TIMESTAMP '2024-01-11' GROUP BY symbol)
    SELECT symbol, date_diff('minute', a1, b0) AS gap FROM a JOIN b USING (symbol) WHERE date_diff('minute', a1, b0) > 60""",
)
def _(spark, d):
    df = hours(spark, d)
    return B.merge_gaps(df.where(F.col("opentime") < ntz("2024-01-10")), df.where(F.col("opentime") >= ntz("2024-01-11")), 60)


@query("b7_upsert_history", f"{AB} SELECT coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.opentime, a.opentime) AS opentime, coalesce(b.close, a.close) AS close FROM a FULL JOIN b ON a.symbol = b.symbol AND a.opentime = b.opentime", "close")
def _(spark, d):
    a, b = _ab(spark, d)
    return B.upsert_history(a.withColumn("fetched", ntz("2024-02-01")), b.withColumn("fetched", ntz("2024-02-02"))).drop("fetched")


@query("b8_quote_volume", f"{HOURS} SELECT symbol, opentime, pivot * basevolume AS by_pivot, close * basevolume AS by_close FROM bars", "by_pivot by_close")
def _(spark, d):
    return hours(spark, d).select("symbol", "opentime", B.quote_volume().alias("by_pivot"), B.quote_volume("close").alias("by_close"))


LIQUID = dict(minquotevol=600.0, accumulate=4, checkperiod=24, startthreshold=0.3, stopthreshold=0.6, minliquidminutes=6)
LIQUID_SQL = f"""{HOURS}, v AS (SELECT *, (round(sum(pivot * basevolume) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) < 600)::INT AS notok FROM bars),
  c AS (SELECT *, sum(notok) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) + greatest(0, 24 - rn) AS bad FROM v),
  e AS (SELECT *, CASE WHEN bad < 0.3 * 24 THEN 1 WHEN bad > 0.6 * 24 THEN 0 END AS event FROM c),
  o AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS isopen FROM e),
  i AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, isopen ORDER BY opentime) AS island FROM o),
  ranges AS (SELECT symbol, min(rn)::INT AS start_rn, max(rn)::INT AS end_rn, min(opentime) AS start_ts, max(opentime) AS end_ts FROM i WHERE isopen = 1
    GROUP BY symbol, island HAVING max(rn) - min(rn) + 1 >= 6)"""


@query("b9_liquid_ranges", f"{LIQUID_SQL} SELECT * FROM ranges")
def _(spark, d):
    return B.liquid_ranges(hours(spark, d), **LIQUID).select("symbol", F.col("start_rn").cast("int"), F.col("end_rn").cast("int"), "start_ts", "end_ts")


@query("b10_liquid_symbols", f"{LIQUID_SQL} SELECT symbol, string_agg(start_rn || '-' || end_rn, ',' ORDER BY start_rn) AS ranges FROM ranges GROUP BY symbol")
def _(spark, d):
    df = B.liquid_symbols(B.liquid_ranges(hours(spark, d), **LIQUID))
    return df.select("symbol", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start_rn"], r["end_rn"])), ",").alias("ranges"))


@query(
    "b12_volume_segments",
    f"""{HOURS}, v AS (SELECT *, round(sum(basevolume) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS volume, lag(opentime, 3) OVER ({W}) AS first FROM bars),
    e AS (SELECT *, CASE WHEN volume >= 14 AND rn >= 4 THEN 1 WHEN volume <= 8 THEN 0 END AS event FROM v),
    o AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS isopen FROM e),
    i AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, isopen ORDER BY opentime) AS island FROM o)
    SELECT symbol, (min(rn) - 3)::INT AS start_rn, max(rn)::INT AS end_rn, min(first) AS start_ts, max(opentime) AS end_ts FROM i WHERE isopen = 1
    GROUP BY symbol, island HAVING date_diff('minute', min(first), max(opentime)) >= 300""",
)
def _(spark, d):
    return B.volume_segments(hours(spark, d), 14, 4, 8, 300).select("symbol", F.col("start_rn").cast("int"), F.col("end_rn").cast("int"), "start_ts", "end_ts")


@query(
    "b13_slice_ranges",
    f"{LIQUID_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_rn)::INT AS rangeid FROM ranges) SELECT b.symbol, b.opentime, b.close, r.rangeid FROM bars b JOIN r ON b.symbol = r.symbol AND b.opentime BETWEEN r.start_ts AND r.end_ts",
    "close",
)
def _(spark, d):
    df = hours(spark, d)
    ranges = B.liquid_ranges(df, **LIQUID).withColumn("rangeid", F.row_number().over(Window.partitionBy("symbol").orderBy("start_rn")))
    return B.slice_ranges(df.select("symbol", "opentime", "close"), ranges.select("symbol", "rangeid", "start_ts", "end_ts"))


# ------------------------------------------------------------------ joins


def _ticks(spark, d):
    return table(spark, d, "events").where("value is not null").select(F.col("event_type").alias("symbol"), F.col("ts").alias("opentime"), "event_id")


@query("j1_asof_lookup", f"{HOURS} SELECT symbol, max(opentime) AS opentime, last(close ORDER BY opentime) AS close FROM bars WHERE opentime <= TIMESTAMP '2024-01-15 12:30:00' GROUP BY symbol", "close")
def _(spark, d):
    return J.asof_lookup(hours(spark, d), "2024-01-15 12:30:00").select("symbol", "opentime", "close")


@query("j2_asof_join", f"{HOURS}, r AS (SELECT * FROM bars WHERE rn % 3 = 0) SELECT t.event_id, t.event_type AS symbol, t.ts AS opentime, r.opentime AS opentime_r, r.close AS close_r FROM events t ASOF LEFT JOIN r ON t.event_type = r.symbol AND t.ts >= r.opentime WHERE t.value IS NOT NULL", "close_r")
def _(spark, d):
    right = number_rows(hours(spark, d)).where("rn % 3 = 0").select("symbol", "opentime", "close")
    return J.asof_join(_ticks(spark, d), right)


@query(
    "j3_nearest_row",
    f"""{HOURS}, r AS (SELECT * FROM bars WHERE rn % 3 = 0), f AS (SELECT symbol, min(opentime) AS o, first(close ORDER BY opentime) AS c FROM r GROUP BY symbol)
    SELECT t.event_id, coalesce(r.opentime, f.o) AS opentime_r, coalesce(r.close, f.c) AS close_r FROM events t ASOF LEFT JOIN r ON t.event_type = r.symbol AND t.ts >= r.opentime
    JOIN f ON f.symbol = t.event_type WHERE t.value IS NOT NULL""",
    "close_r",
)
def _(spark, d):
    right = number_rows(hours(spark, d)).where("rn % 3 = 0").select("symbol", "opentime", "close")
    return J.nearest_row(_ticks(spark, d), right).select("event_id", "opentime_r", "close_r")


@query("j4_align_features_prices", f"{HOURS} SELECT symbol, opentime, high - low AS spread, close FROM bars WHERE rn % 2 = 0", "spread close")
def _(spark, d):
    df = hours(spark, d)
    features = number_rows(df).where("rn % 2 = 0").select("symbol", "opentime", (F.col("high") - F.col("low")).alias("spread"))
    return J.align_features_prices(features, df.select("symbol", "opentime", "close"))


@query("j5_merge_feature_columns", f"{AB} SELECT coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.opentime, a.opentime) AS opentime, coalesce(b.close, a.close) AS close, b.close * 2 AS twice FROM a FULL JOIN b ON a.symbol = b.symbol AND a.opentime = b.opentime", "close twice")
def _(spark, d):
    a, b = _ab(spark, d)
    return J.merge_feature_columns(a, b.withColumn("twice", F.col("close") * 2))


@query(
    "j6_compare_trade_tables",
    f"{AB} SELECT coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.opentime, a.opentime) AS opentime, false AS close_eq, false AS match_all FROM a FULL JOIN b ON a.symbol = b.symbol AND a.opentime = b.opentime",
)
def _(spark, d):
    return J.compare_trade_tables(*_ab(spark, d), ["symbol", "opentime"], ["close"], 0.5)


CHANGED = f"""{HOURS}, a AS (SELECT symbol, opentime, close, basevolume FROM bars), b AS (SELECT symbol, opentime, CASE WHEN symbol = 'view' AND hour(opentime) = 3 THEN close + 1 ELSE close END AS close, basevolume
  FROM bars WHERE NOT (symbol = 'click' AND day(opentime) = 5))"""


@query(
    "j6_table_differences",
    f"""{CHANGED}, j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.opentime, b.opentime) AS opentime, coalesce(a.close = b.close, false) AS close_eq, coalesce(a.basevolume = b.basevolume, false) AS basevolume_eq
      FROM a FULL JOIN b ON a.symbol = b.symbol AND a.opentime = b.opentime)
    SELECT *, close_eq AND basevolume_eq AS match_all FROM j WHERE NOT (close_eq AND basevolume_eq)""",
)
def _(spark, d):
    a = hours(spark, d).select("symbol", "opentime", "close", "basevolume")
    more = (F.col("symbol") == "view") & (F.hour("opentime") == 3)
    b = a.withColumn("close", F.when(more, F.col("close") + 1).otherwise(F.col("close"))).where("not (symbol = 'click' and day(opentime) = 5)")
    return Z.table_differences(a, b, ["close", "basevolume"])


@query(
    "s10_unequal_days",
    f"""{CHANGED}, x AS (SELECT symbol, opentime::DATE AS day, count(*) AS n, list(close ORDER BY opentime) AS v FROM a GROUP BY ALL), y AS (SELECT symbol, opentime::DATE AS day, count(*) AS n, list(close ORDER BY opentime) AS v FROM b GROUP BY ALL)
    SELECT coalesce(x.symbol, y.symbol) AS symbol, coalesce(x.day, y.day)::TIMESTAMP AS day, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b FROM x FULL JOIN y ON x.symbol = y.symbol AND x.day = y.day WHERE x.v IS DISTINCT FROM y.v""",
)
def _(spark, d):
    a = hours(spark, d).select("symbol", "opentime", "close")
    more = (F.col("symbol") == "view") & (F.hour("opentime") == 3)
    b = a.withColumn("close", F.when(more, F.col("close") + 1).otherwise(F.col("close"))).where("not (symbol = 'click' and day(opentime) = 5)")
    found = Z.unequal_cells(*[Z.digest_tree(x, ["symbol", "opentime", "close"]) for x in (a, b)])
    return found.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "j7_portfolio_value",
    "SELECT c.c_nationkey AS coin, c.c_custkey AS account, c_acctbal::DOUBLE * coalesce(n.price, 1) AS value FROM customer c LEFT JOIN (SELECT n_nationkey, n_regionkey + 0.5::DOUBLE AS price FROM nation WHERE n_nationkey % 2 = 0) n ON n.n_nationkey = c.c_nationkey WHERE abs(c_acctbal::DOUBLE * coalesce(n.price, 1)) >= 100",
    "value",
)
def _(spark, d):
    balances = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("coin"), F.col("c_custkey").alias("account"), F.col("c_acctbal").cast("double").alias("free"), F.lit(0.0).alias("locked"), F.lit(0.0).alias("borrowed")
    )
    prices = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("coin"), (F.col("n_regionkey") + 0.5).cast("double").alias("lastprice"))
    return J.portfolio_value(balances, prices, 100.0).select("coin", "account", "value")


@query(
    "j8_missing_close_orders",
    """WITH b AS (SELECT c_custkey AS coin, c_acctbal::DOUBLE AS held FROM customer), o AS (SELECT o_custkey AS coin, sum(o_totalprice::DOUBLE / 1000) AS ordered FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY ALL)
    SELECT coin, held, coalesce(ordered, 0) AS ordered, held - coalesce(ordered, 0) AS gap FROM b LEFT JOIN o USING (coin) WHERE held - coalesce(ordered, 0) >= 50""",
    "held ordered gap",
)
def _(spark, d):
    balances = table(spark, d, "customer").select(F.col("c_custkey").alias("coin"), F.col("c_acctbal").cast("double").alias("free"))
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("coin"), (F.col("o_totalprice").cast("double") / 1000).alias("quantity"), S.normalize_order_status(F.col("o_orderstatus"), "tpch").alias("status")
    )
    return J.missing_close_orders(balances, orders, 50.0)


@query("j9_join_config", "SELECT o_orderkey, o_custkey % 7 AS cfgid, n_name AS name FROM orders LEFT JOIN (SELECT n_nationkey AS cfgid, n_name FROM nation WHERE n_nationkey < 5) c ON c.cfgid = o_custkey % 7")
def _(spark, d):
    kpi = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("cfgid"))
    return J.join_config(kpi, table(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("cfgid"), F.col("n_name").alias("name")))


@query(
    "j10_register_configs",
    """WITH e AS (SELECT (row_number() OVER (ORDER BY n_regionkey))::INT AS cfgid, n_regionkey::INT AS a, round(n_regionkey / 7.0::DOUBLE, 6) AS b FROM (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey < 2)),
    f AS (SELECT DISTINCT n_regionkey::INT AS a, round(n_regionkey / 7.0::DOUBLE, 6) AS b FROM nation WHERE n_regionkey >= 2)
    SELECT * FROM e UNION ALL SELECT (2 + row_number() OVER (ORDER BY a, b))::INT, a, b FROM f""",
    "b",
)
def _(spark, d):
    every = table(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("a"), (F.col("n_regionkey") / F.lit(7.0)).alias("b")).distinct()
    existing = every.where("a < 2").withColumn("cfgid", F.row_number().over(Window.orderBy("a")))
    return J.register_configs(existing, every, ["a", "b"])


@query("j11_exclude_symbols", "SELECT p_partkey FROM part WHERE NOT (p_partkey % 3 = 0 AND p_partkey % 2 <> 0)")
def _(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"))
    return J.exclude_symbols(parts, parts.where("symbol % 3 = 0"), parts.where("symbol % 2 = 0")).select(F.col("symbol").alias("p_partkey"))


@query(
    "j12_target_overlay",
    f"""{HOURS} SELECT symbol, opentime, close, CASE WHEN rn % 2 = 0 THEN high + 1 END AS upper, CASE WHEN rn % 5 = 0 THEN high END AS target FROM bars
    WHERE opentime BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-12'""",
    "close upper target",
)
def _(spark, d):
    df = number_rows(hours(spark, d))
    bounds = df.where("rn % 2 = 0").select("symbol", "opentime", (F.col("high") + 1).alias("upper"))
    targets = df.where("rn % 5 = 0").select("symbol", "opentime", F.col("high").alias("target"))
    return J.target_overlay(bounds, df.select("symbol", "opentime", "close"), targets, "2024-01-08", "2024-01-12")


@query("j13_reattach_prices", f"{HOURS} SELECT symbol, opentime, close AS score, CASE WHEN rn % 2 = 0 THEN -1 ELSE pivot END AS pivot FROM bars", "score pivot")
def _(spark, d):
    df = number_rows(hours(spark, d))
    stored = df.select("symbol", "opentime", F.col("close").alias("score"), F.when(F.col("rn") % 2 == 0, -1.0).alias("pivot"))
    return J.reattach_prices(stored, df)
