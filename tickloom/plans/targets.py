"""Queries: targets, training tables and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators import dataset as C
from tickloom.operators import evaluate as E
from tickloom.operators import summaries
from tickloom.operators import targets as T
from tickloom.operators.windows import number_rows, ordered, running
from tickloom.plans.bars import LIQUID_SQL
from tickloom.plans.features import L24, ZIGZAG, lined
from tickloom.plans.registry import HOURS, W, hours, line_sql, query, table

KEYS = "symbol, opentime"
THRES = T.Thresholds(longopen=0.3, longhold=0.05, shorthold=-0.05, shortopen=-0.3)


@query("t1_relative_distance", f"{HOURS} SELECT {KEYS}, (lead(pivot, 5) OVER ({W}) - pivot) / pivot AS fore, (lead(pivot, 5) OVER ({W}) - pivot) / lead(pivot, 5) OVER ({W}) AS back FROM bars", "fore back")
def _(spark, d):
    ahead = F.lead("pivot", 5).over(Window.partitionBy("symbol").orderBy("opentime"))
    df = hours(spark, d).withColumn("t", ahead)
    return df.select("symbol", "opentime", T.relative_distance(F.col("pivot"), F.col("t")).alias("fore"), T.relative_distance(F.col("pivot"), F.col("t"), True).alias("back"))


# Labels of the rows dd by their dist.
BY_DIST = f"""raw AS (SELECT *, CASE WHEN dist >= 0.3 THEN 'longopen' WHEN dist <= -0.3 THEN 'shortopen' WHEN dist >= 0.05 THEN 'longhold' WHEN dist <= -0.05 THEN 'shorthold' ELSE 'close' END AS r FROM dd),
  la AS (SELECT *, coalesce(last_value(CASE WHEN r = 'longopen' THEN true WHEN r IN ('shortopen', 'shorthold') THEN false END IGNORE NULLS) OVER w, false) AS inlong,
    coalesce(last_value(CASE WHEN r = 'shortopen' THEN true WHEN r IN ('longopen', 'longhold') THEN false END IGNORE NULLS) OVER w, false) AS inshort FROM raw
    WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  labelled AS (SELECT symbol, opentime, rn, open, high, low, close, pivot, dist, CASE WHEN r IN ('longopen', 'shortopen') THEN r WHEN r = 'longhold' AND inlong THEN r WHEN r = 'shorthold' AND inshort THEN r
    WHEN r = 'close' AND inlong THEN 'longclose' WHEN r = 'close' AND inshort THEN 'shortclose' ELSE 'ignore' END AS label FROM la)"""
LABELS = f"""{HOURS}, dd AS (SELECT *, coalesce(round((lead(pivot, 5) OVER ({W}) - pivot) / pivot, 9), 0) AS dist FROM bars), {BY_DIST}"""


def labelled(spark, d):
    ahead = F.lead("pivot", 5).over(Window.partitionBy("symbol").orderBy("opentime"))
    df = number_rows(hours(spark, d)).withColumn("dist", F.coalesce(F.round((ahead - F.col("pivot")) / F.col("pivot"), 9), F.lit(0.0)))
    return T.threshold_labels(df, "dist", THRES)


@query("t2_threshold_labels", f"{LABELS} SELECT {KEYS}, label FROM labelled")
def _(spark, d):
    return labelled(spark, d).select("symbol", "opentime", "label")


@query(
    "t3_continuous_distance_labels",
    f"""{ZIGZAG}, dd AS (SELECT *, distance / pivot AS dist FROM peaks), {BY_DIST.replace("open, high, low, close, pivot, dist,", "distance,")} SELECT {KEYS}, distance, label FROM labelled""",
    "distance",
)
def _(spark, d):
    from tickloom.operators.extremes import continuous_distance_labels

    return continuous_distance_labels(hours(spark, d), 0.3, -0.3, THRES).select("symbol", "opentime", "distance", "label")


GAIN = f"""{HOURS}, a AS (SELECT *, max(pivot) OVER w AS mx, min(pivot) OVER w AS mn FROM bars WINDOW w AS ({W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
  g AS (SELECT symbol, opentime, rn, coalesce((mx - pivot) / pivot, 0) AS maxreldiff, coalesce((mn - pivot) / pivot, 0) AS minreldiff, mx, mn FROM a),
  ix AS (SELECT g.symbol, g.rn, min(b.rn) FILTER (b.pivot = mx) AS maxix, min(b.rn) FILTER (b.pivot = mn) AS minix FROM g JOIN bars b ON b.symbol = g.symbol AND b.rn BETWEEN g.rn + 1 AND g.rn + 10 GROUP BY ALL),
  fdg AS (SELECT g.*, coalesce(maxix, g.rn)::INT AS maxix, coalesce(minix, g.rn)::INT AS minix FROM g LEFT JOIN ix USING (symbol, rn))"""


@query("t4_fixed_distance_gain", f"{GAIN} SELECT {KEYS}, maxreldiff, minreldiff, maxix, minix, maxreldiff >= 0.3 AS longopen, minreldiff >= 0.05 AS longhold, minreldiff <= -0.3 AS shortopen, maxreldiff <= -0.05 AS shorthold FROM fdg", "maxreldiff minreldiff")
def _(spark, d):
    out = T.fixed_distance_gain(hours(spark, d), 10, THRES)
    return out.select("symbol", "opentime", "maxreldiff", "minreldiff", "maxix", "minix", "longopen", "longhold", "shortopen", "shorthold")


FIRST = """CASE WHEN f.maxix < f.minix OR f.maxreldiff > 0 THEN CASE WHEN f.maxreldiff >= 0.3 THEN 'longopen' WHEN before IN ('longopen', 'longhold') THEN
  CASE WHEN f.minreldiff >= 0.05 THEN 'longhold' ELSE 'longclose' END ELSE 'ignore' END ELSE 'ignore' END"""
THEN = f"""CASE WHEN f.maxix > f.minix OR f.minreldiff < 0 THEN CASE WHEN f.minreldiff <= -0.3 THEN 'shortopen' WHEN before IN ('shortopen', 'shorthold') THEN
  CASE WHEN f.maxreldiff <= -0.05 THEN 'shorthold' ELSE 'shortclose' END ELSE {FIRST} END ELSE {FIRST} END"""


def recursive(sql: str) -> str:
    return sql.replace("WITH bars0", "WITH RECURSIVE bars0", 1)


@query(
    "t5_fixed_distance_label",
    f"""{recursive(GAIN)}, walk AS (SELECT f.symbol, f.rn, f.opentime, {THEN} AS label FROM (SELECT *, 'ignore' AS before FROM fdg WHERE rn = 1) f
    UNION ALL SELECT f.symbol, f.rn, f.opentime, {THEN} FROM (SELECT fdg.*, walk.label AS before FROM walk JOIN fdg ON fdg.symbol = walk.symbol AND fdg.rn = walk.rn + 1) f)
    SELECT {KEYS}, label FROM walk""",
)
def _(spark, d):
    return T.fixed_distance_labels(hours(spark, d), 10, THRES).select("symbol", "opentime", "label")


TREND = f"""{HOURS}, {L24}, ah AS (SELECT *, max(rn) OVER (PARTITION BY symbol) AS n, coalesce(lead(regry, 23) OVER ({W}), last_value(regry) OVER p) AS y, coalesce(lead(grad, 23) OVER ({W}), last_value(grad) OVER p) AS g FROM line
  WINDOW p AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  tr AS (SELECT *, CASE WHEN rn = n THEN 0 ELSE (y - (y - g * 23)) / (y - g * 23) END AS gain FROM ah),
  target AS (SELECT symbol, opentime, rn, pivot, high, low, close, gain, CASE WHEN gain >= 0.05 THEN 'longopen' WHEN gain <= -0.05 THEN 'shortopen' ELSE 'allclose' END AS label FROM tr)"""


def trend(spark, d):
    return T.trend_regression_target(hours(spark, d), 24, 0.05, -0.05)


@query("t6_trend_regression_target", f"{TREND} SELECT {KEYS}, gain, label FROM target", "gain")
def _(spark, d):
    return trend(spark, d).select("symbol", "opentime", "gain", "label")


@query("flagship_label_shares", f"{TREND} SELECT symbol, label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY symbol), 1) AS percent FROM target GROUP BY symbol, label", "percent")
def _(spark, d):
    return T.label_distribution(trend(spark, d))


TL = T.Thresholds(longopen=0.1, longhold=0.03, shorthold=-0.03, shortopen=-0.1)


def smooth(spark, d):
    """Trend labels of the regression line as the price, which has trends."""
    df = lined(spark, d).select("symbol", "opentime", F.col("regry_24").alias("pivot"))
    return T.trend_labels(df, 3, 48, TL)


@query("t7_trend_labels")
def _(spark, d):
    return smooth(spark, d)


@query("t7_long_trend_labels")
def _(spark, d):
    df = lined(spark, d).select("symbol", "opentime", F.col("regry_24").alias("pivot"))
    return T.long_trend_labels(df, 3, 48, TL)


@query("t16_trend_rule_trials")
def _(spark, d):
    df = lined(spark, d).select("symbol", "opentime", F.col("regry_24").alias("pivot"))
    return T.trend_rule_trials(df, 3, 48, TL)


@query("t8_check_trend_labels")
def _(spark, d):
    return T.check_trend_labels(smooth(spark, d), TL, 3, maxwindow=48)


# The target of T6 as trend labels that refer to the first row of their run: many runs are too short, too flat or beyond their ends.
RUNS = f"""{TREND}, nw AS (SELECT *, (label IS DISTINCT FROM lag(label) OVER ({W}))::INT AS fresh, lead(pivot) OVER ({W}) AS later FROM target), ru AS (SELECT *, sum(fresh) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM nw),
  sd AS (SELECT *, CASE label WHEN 'longopen' THEN 1 WHEN 'shortopen' THEN -1 END AS side, first_value(pivot) OVER r AS p0, last_value(pivot) OVER r AS p1 FROM ru WINDOW r AS (PARTITION BY symbol, run ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  out AS (SELECT *, side * pivot < side * p0 AS under, side * pivot > side * p1 AS over FROM sd WHERE side IS NOT NULL),
  beyond AS (SELECT symbol, run, max(c) AS most FROM (SELECT symbol, run, count(*) AS c FROM (SELECT symbol, run, rn - row_number() OVER (PARTITION BY symbol, run ORDER BY rn) AS g FROM out WHERE under) GROUP BY symbol, run, g
    UNION ALL SELECT symbol, run, count(*) FROM (SELECT symbol, run, rn - row_number() OVER (PARTITION BY symbol, run ORDER BY rn) AS g FROM out WHERE over) GROUP BY symbol, run, g) GROUP BY ALL),
  seg AS (SELECT symbol, run, label, side, p0, p1, min(rn) AS a, max(rn) AS b, arg_max(later, rn) AS p2 FROM out GROUP BY ALL),
  far AS (SELECT seg.*, coalesce(most, 0) AS most, coalesce(side * p2 > side * p1, false) AS further FROM seg LEFT JOIN beyond USING (symbol, run)),
  bad AS (SELECT *, CASE WHEN b - a + 1 + further::INT < 6 THEN 'span' WHEN side * ((CASE WHEN further THEN p2 ELSE p1 END) - p0) / p0 < 0.1 - 1e-9 THEN 'threshold' WHEN most >= 6 THEN 'extremes' END AS issue FROM far)"""


@query("t8_check_of_runs", f"{RUNS} SELECT symbol, a::INT AS start_rn, b::INT AS end_rn, label, issue FROM bad WHERE issue IS NOT NULL")
def _(spark, d):
    df = number_rows(trend(spark, d).select("symbol", "opentime", "pivot", "label"))
    new = ~F.col("label").eqNullSafe(F.lag("label").over(ordered()))
    df = df.withColumn("_new", new).withColumn("relix", F.max(F.when(F.col("_new"), F.col("rn"))).over(running())).drop("_new")
    return T.check_trend_labels(df, TL, 6)


@query("t9_trend_relative_gain")
def _(spark, d):
    return T.trend_relative_gain(smooth(spark, d)).select("symbol", "opentime", "relative_gain")


@query(
    "t9_gain_since_label_began",
    f"""{TREND}, s AS (SELECT *, (label IS DISTINCT FROM lag(label) OVER ({W}))::INT AS new FROM target), r AS (SELECT *, max(CASE WHEN new = 1 THEN rn END) OVER ({W}) AS relix FROM s)
    SELECT a.symbol, a.opentime, a.relix, (a.pivot - b.pivot) / nullif(b.pivot, 0) AS relative_gain FROM r a JOIN r b ON a.symbol = b.symbol AND a.relix = b.rn""",
    "relative_gain",
)
def _(spark, d):
    df = number_rows(trend(spark, d))
    new = ~F.col("label").eqNullSafe(F.lag("label").over(ordered()))
    df = df.withColumn("_new", new).withColumn("relix", F.max(F.when(F.col("_new"), F.col("rn"))).over(running()))
    return T.trend_relative_gain(df).select("symbol", "opentime", "relix", "relative_gain")


@query("t10_trend_phase", f"{LABELS} SELECT {KEYS}, CASE WHEN label IN ('longopen', 'longhold') THEN 'up' WHEN label IN ('shortopen', 'shorthold') THEN 'down' ELSE 'flat' END AS phase FROM labelled")
def _(spark, d):
    return labelled(spark, d).select("symbol", "opentime", T.trend_phase(F.col("label")).alias("phase"))


BOUNDS = f"min(low) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS lowtarget, max(high) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS hightarget"


@query("t11_bounds_target", f"{HOURS}, b AS (SELECT *, {BOUNDS} FROM bars) SELECT {KEYS}, lowtarget, hightarget, ((lowtarget + hightarget) / 2 - pivot) / pivot AS center, (hightarget - lowtarget) / pivot AS width FROM b", "lowtarget hightarget center width")
def _(spark, d):
    return T.bounds_target(hours(spark, d), 10, relative=True).select("symbol", "opentime", "lowtarget", "hightarget", "center", "width")


@query("t11_bounds_forward", f"{HOURS} SELECT {KEYS}, coalesce(min(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), low) AS lowtarget, coalesce(max(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), high) AS hightarget FROM bars", "lowtarget hightarget")
def _(spark, d):
    return T.bounds_target(hours(spark, d), 10, forward=True).select("symbol", "opentime", "lowtarget", "hightarget")


@query("t12_label_gain", f"{TREND} SELECT {KEYS}, label = 'longopen' AS flag, CASE WHEN label = 'longopen' THEN gain ELSE 0 END AS label_gain FROM target", "label_gain")
def _(spark, d):
    return T.label_gain(T.label_binary(trend(spark, d), "longopen"), "longopen").select("symbol", "opentime", "flag", "label_gain")


@query("t13_label_distribution", f"{LABELS} SELECT symbol, label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY symbol), 1) AS percent FROM labelled GROUP BY symbol, label", "percent")
def _(spark, d):
    return T.label_distribution(labelled(spark, d))


@query(
    "t14_check_label_sequence",
    f"""{HOURS}, l AS (SELECT *, CASE rn % 7 WHEN 0 THEN 'longopen' WHEN 2 THEN 'longhold' WHEN 3 THEN 'shortclose' WHEN 5 THEN 'longclose' ELSE 'ignore' END AS label FROM bars),
    o AS (SELECT *, last_value(CASE WHEN label = 'longopen' THEN 'long' END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened FROM l)
    SELECT {KEYS}, label FROM o WHERE label IN ('longhold', 'shortclose', 'longclose') AND left(label, 4) IS DISTINCT FROM opened""",
)
def _(spark, d):
    r = F.col("rn") % 7
    label = F.when(r == 0, "longopen").when(r == 2, "longhold").when(r == 3, "shortclose").when(r == 5, "longclose").otherwise("ignore")
    return T.check_label_sequence(number_rows(hours(spark, d)).withColumn("label", label)).select("symbol", "opentime", "label")


@query("t15_relative_gain_extremes", f"{GAIN} SELECT {KEYS}, maxreldiff AS relativegain, minreldiff AS relativeloss FROM fdg WHERE opentime <= TIMESTAMP '2024-01-10'", "relativegain relativeloss")
def _(spark, d):
    from tickloom.functions.scalar import time_cut

    out = time_cut(T.fixed_distance_gain(hours(spark, d), 10, THRES), None, "2024-01-10")
    return out.select("symbol", "opentime", F.col("maxreldiff").alias("relativegain"), F.col("minreldiff").alias("relativeloss"))


@query("t16_trend_rule_counts")
def _(spark, d):
    return T.trend_rule_counts(smooth(spark, d))


# ------------------------------------------------------------------ training tables


def parts(spark, d):
    df = number_rows(trend(spark, d))
    return C.assign_partitions(df, ["train", "test", "train", "train", "eval", "train"], 40, 5, 20, 100)


@query(
    "c1_assign_partitions",
    f"""{recursive(HOURS)}, n AS (SELECT symbol, max(rn) AS n FROM bars GROUP BY symbol),
    u AS (SELECT symbol, n, CASE WHEN n < 244 THEN greatest(round_even((n % 244) / 6::DOUBLE, 0) - 1, 20) ELSE least(40 + round_even((n % 244) / 6::DOUBLE, 0), 100) END::BIGINT AS size FROM n WHERE n >= 240),
    walk AS (SELECT symbol, n, size, 0 AS i, 1::BIGINT AS a, size AS b FROM u
      UNION ALL SELECT symbol, n, size, i + 1, b + 6, b + 5 + size * CASE WHEN i % 2 = 1 AND b + 6 + size < n THEN 2 ELSE 1 END FROM walk WHERE b + 1 < n AND b + 6 <= n)
    SELECT symbol, CASE i % 4 WHEN 1 THEN 'test' WHEN 3 THEN 'eval' ELSE 'train' END AS set, i + 1 AS rangeid, a::INT AS a, least(b, n)::INT AS b FROM walk""",
)
def _(spark, d):
    return parts(spark, d).groupBy("symbol", "set", "rangeid").agg(F.min("rn").alias("a"), F.max("rn").alias("b"))


@query(
    "c2_assign_partitions_relative",
    f"""{recursive(HOURS)}, n AS (SELECT symbol, max(rn) AS n FROM bars GROUP BY symbol),
    g AS (SELECT symbol, n, CASE WHEN 0.1::DOUBLE * n <= 4 THEN floor(0.1::DOUBLE * n / 3) ELSE 2 END::BIGINT AS gap, [0.1::DOUBLE * 0.6::DOUBLE / 0.2::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE] AS part FROM n),
    u AS (SELECT *, n - gap * floor(3 / list_sum(part))::BIGINT AS spread FROM g),
    walk AS (SELECT symbol, n, gap, part, spread, 0 AS i, 1::BIGINT AS a, least(n, greatest(1, round_even(spread * part[1], 0))::BIGINT) AS b FROM u
      UNION ALL SELECT symbol, n, gap, part, spread, i + 1, b + 1 + gap, least(n, b + gap + greatest(1, round_even(spread * part[1 + (i + 1) % 3], 0))::BIGINT) FROM walk WHERE b + 1 + gap <= n)
    SELECT symbol, CASE i % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'eval' END AS set, i + 1 AS rangeid, a::INT AS a, b::INT AS b FROM walk""",
)
def _(spark, d):
    df = number_rows(hours(spark, d))
    out = C.assign_partitions_relative(df, [("train", 0.6), ("test", 0.2), ("eval", 0.2)], 0.1, 2)
    return out.groupBy("symbol", "set", "rangeid").agg(F.min("rn").alias("a"), F.max("rn").alias("b"))


@query("c3_features_targets")
def _(spark, d):
    from tickloom.plans.pipelines import features_targets

    return features_targets(hours(spark, d))


def training_sql() -> str:
    """All steps of features_targets() with the hourly preset: regressions, deviation, extremes, volumes, target, ranges, sets."""
    frame = f"OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    liquid = recursive(LIQUID_SQL).replace("HAVING max(rn) - min(rn) + 1 >= 6", "HAVING max(rn) - min(rn) + 1 >= 48")
    return f"""{liquid}, {L24}, {line_sql(6).replace("line AS", "line6 AS")},
  res AS (SELECT l.symbol, l.opentime, [b.open, b.high, b.low, b.close] AS p, l.regry - l.grad * (l.rn - b.rn) AS y FROM line l JOIN bars b ON l.symbol = b.symbol AND b.rn BETWEEN l.rn - 23 AND l.rn),
  dev AS (SELECT symbol, opentime, coalesce(stddev_samp(v), 0) AS rs24_0 FROM (SELECT symbol, opentime, unnest(p) - y AS v FROM res) GROUP BY ALL),
  ex AS (SELECT symbol, opentime, (pivot - min(low) {frame}) / pivot AS mind24_0, (pivot - max(high) {frame}) / pivot AS maxd24_0,
    median(basevolume) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / median(basevolume) {frame} AS rv_3_24 FROM bars),
  {TREND[TREND.index("ah AS"):]},
  every AS (SELECT line.symbol, line.opentime, line.rn AS bar, (line.pivot - line.regry) / line.pivot AS ry24_0, line.grad AS rg24_0, rs24_0, mind24_0, maxd24_0, line6.grad AS rg6_0, rv_3_24, target.gain, target.label
    FROM line JOIN line6 USING (symbol, opentime) JOIN dev USING (symbol, opentime) JOIN ex USING (symbol, opentime) JOIN target USING (symbol, opentime)),
  liq AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_rn) AS liquidid FROM ranges),
  held AS (SELECT e.*, liquidid, row_number() OVER (PARTITION BY e.symbol, liquidid ORDER BY opentime) AS rn FROM every e JOIN liq ON e.symbol = liq.symbol AND bar BETWEEN start_rn AND end_rn),
  sizes AS (SELECT symbol, liquidid, max(rn) AS n FROM held GROUP BY ALL),
  use AS (SELECT *, CASE WHEN n < 124 THEN greatest(round_even((n % 124) / 6::DOUBLE, 0) - 1, 10) ELSE least(20 + round_even((n % 124) / 6::DOUBLE, 0), 40) END::BIGINT AS size FROM sizes WHERE n >= 120),
  walk AS (SELECT symbol, liquidid, n, size, 0 AS i, 1::BIGINT AS a, size AS b FROM use
    UNION ALL SELECT symbol, liquidid, n, size, i + 1, b + 5, b + 4 + size * CASE WHEN i % 2 = 1 AND b + 5 + size < n THEN 2 ELSE 1 END FROM walk WHERE b + 1 < n AND b + 5 <= n)
  SELECT h.symbol, opentime, h.liquidid::INT AS liquidid, rn::INT AS rn, CASE i % 4 WHEN 1 THEN 'test' WHEN 3 THEN 'eval' ELSE 'train' END AS set, (i + 1)::INT AS rangeid,
    ry24_0, rg24_0, rs24_0, mind24_0, maxd24_0, rg6_0, rv_3_24, gain, label FROM held h JOIN walk w ON h.symbol = w.symbol AND h.liquidid = w.liquidid AND rn BETWEEN a AND b"""


@query("c3_training_rows", training_sql(), "ry24_0 rg24_0 rs24_0 mind24_0 maxd24_0 rg6_0 rv_3_24 gain")
def _(spark, d):
    from tickloom.plans.pipelines import features_targets

    names = ["symbol", "opentime", "liquidid", "rn", "set", "rangeid", "ry24_0", "rg24_0", "rs24_0", "mind24_0", "maxd24_0", "rg6_0", "rv_3_24", "gain", "label"]
    return features_targets(hours(spark, d)).select(*names)


@query("c4_target_issues")
def _(spark, d):
    from tickloom.operators.bars import liquid_ranges, slice_ranges
    from tickloom.plans.bars import LIQUID

    df = hours(spark, d)
    ranges = liquid_ranges(df, **LIQUID).withColumn("rangeid", F.row_number().over(Window.partitionBy("symbol").orderBy("start_rn")))
    keys = ("symbol", "rangeid")
    rows = slice_ranges(df.select("symbol", "opentime", "pivot"), ranges.select("symbol", "rangeid", "start_ts", "end_ts"))
    return T.check_trend_labels(T.trend_labels(rows, 3, 24, TL, keys=keys), TL, 3, keys, 24)


@query("c5_concat_coin_tables", f"{HOURS} SELECT {KEYS}, close, CASE WHEN symbol < 'd' THEN high END AS extra FROM bars", "close extra")
def _(spark, d):
    df = hours(spark, d).select("symbol", "opentime", "close", F.col("high").alias("extra"))
    return C.concat_coin_tables([df.where("symbol < 'd'"), df.where("symbol >= 'd'").drop("extra")])


@query("c6_class_weights", f"{LABELS}, c AS (SELECT label, count(*) AS n FROM labelled GROUP BY label) SELECT {KEYS}, label, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM labelled JOIN c USING (label)", "weight")
def _(spark, d):
    return C.class_weights(labelled(spark, d)).select("symbol", "opentime", "label", "weight")


@query("c7_subset_rows", f"{HOURS} SELECT {KEYS} FROM bars WHERE rn BETWEEN 10 AND 20 OR rn BETWEEN 15 AND 40")
def _(spark, d):
    df = number_rows(hours(spark, d))
    first = df.where("rn = 1").select("symbol")
    ranges = first.select("symbol", F.lit(10).alias("a"), F.lit(20).alias("b")).unionByName(first.select("symbol", F.lit(15).alias("a"), F.lit(40).alias("b")))
    return C.subset_rows(df, ranges).select("symbol", "opentime")


@query(
    "c8_sequence_windows",
    f"{HOURS}, s AS (SELECT {KEYS}, rn, lag(close, 4) OVER ({W}) AS first_close, sum(basevolume) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS total FROM bars) SELECT {KEYS}, first_close, total FROM s WHERE rn >= 5",
    "first_close total",
)
def _(spark, d):
    out = C.sequence_windows(hours(spark, d), ["close", "basevolume"], 5)
    total = F.aggregate("seq", F.lit(0.0), lambda a, x: a + x[1])
    return out.select("symbol", "opentime", F.col("seq")[0][0].alias("first_close"), total.alias("total"))


@query("c9_bucket_means", f"{HOURS} SELECT symbol, (rn - 1) // 6 AS bucket, avg(close) AS close, avg(basevolume) AS basevolume, last(high ORDER BY opentime) AS high, max(opentime) AS opentime FROM bars GROUP BY symbol, (rn - 1) // 6 HAVING count(*) = 6", "close basevolume high")
def _(spark, d):
    return C.bucket_means(hours(spark, d), ["close", "basevolume"], 6, "high")


@query("c10_broadcast_bucket_scores", f"{HOURS}, b AS (SELECT symbol, (rn - 1) // 6 AS bucket, avg(close) AS score FROM bars GROUP BY ALL HAVING count(*) = 6) SELECT bars.symbol, bars.opentime, score FROM bars JOIN b ON b.symbol = bars.symbol AND b.bucket = (bars.rn - 1) // 6", "score")
def _(spark, d):
    df = hours(spark, d)
    buckets = C.bucket_means(df, ["close"], 6, "high").select("symbol", "bucket", F.col("close").alias("score"))
    return C.broadcast_bucket_scores(df, buckets, 6).select("symbol", "opentime", "score")


@query("c17_undersample")
def _(spark, d):
    return C.undersample(labelled(spark, d), "label", ["symbol", "opentime"]).select("symbol", "opentime", "label")


@query("c17_class_sizes", f"{LABELS}, n AS (SELECT label, count(*) AS n FROM labelled GROUP BY label) SELECT label, (SELECT min(n) FROM n)::BIGINT AS n FROM n")
def _(spark, d):
    return C.undersample(labelled(spark, d), "label", ["symbol", "opentime"]).groupBy("label").agg(F.count("*").alias("n"))


@query("c18_prediction_table", f"{HOURS} SELECT {KEYS}, close AS score, CASE WHEN rn BETWEEN 1 AND 100 THEN 'train' WHEN rn BETWEEN 121 AND 200 THEN 'test' ELSE 'unused' END AS set FROM bars", "score")
def _(spark, d):
    df = number_rows(hours(spark, d))
    first = df.where("rn = 1").select("symbol")
    ranges = first.select("symbol", F.lit("train").alias("set"), F.lit(1).alias("a"), F.lit(100).alias("b")).unionByName(first.select("symbol", F.lit("test").alias("set"), F.lit(121).alias("a"), F.lit(200).alias("b")))
    return C.prediction_table(df.select("symbol", "opentime", "rn", F.col("close").alias("score")), ranges).select("symbol", "opentime", "score", "set")


# Predictions: scores of three labels from the bar's shape, the truth from the regression target.
PRED = f"""{TREND}, sc AS (SELECT *, round((high - close) / nullif(high + low, 0), 9) AS allclose, round((close - low) / nullif(high + low, 0), 9) AS longopen, round(low / nullif(high + low, 0), 9) AS shortopen FROM target),
  pred AS (SELECT symbol, opentime, rn, pivot, high, low, close, label AS target, CASE WHEN rn % 3 = 0 THEN 'test' ELSE 'train' END AS set, allclose, longopen, shortopen, greatest(allclose, longopen, shortopen) AS score FROM sc WHERE high + low > 0),
  best AS (SELECT *, CASE WHEN allclose = score THEN 'allclose' WHEN longopen = score THEN 'longopen' ELSE 'shortopen' END AS label FROM pred)"""
NAMES = ["allclose", "longopen", "shortopen"]


def scored(spark, d):
    df = number_rows(trend(spark, d)).withColumnRenamed("label", "target").where("high + low > 0")
    total = F.col("high") + F.col("low")
    share = lambda c: F.round(c / total, 9)
    df = df.withColumn("allclose", share(F.col("high") - F.col("close"))).withColumn("longopen", share(F.col("close") - F.col("low"))).withColumn("shortopen", share(F.col("low")))
    return C.max_prediction(df.withColumn("set", F.when(F.col("rn") % 3 == 0, "test").otherwise("train")), NAMES)


@query("c14_max_prediction", f"{PRED} SELECT {KEYS}, score, label FROM best", "score")
def _(spark, d):
    return scored(spark, d).select("symbol", "opentime", "score", "label")


@query("c15_binary_predictions", f"{PRED} SELECT {KEYS}, longopen AS binary_score, label = 'longopen' AS is_best FROM best", "binary_score")
def _(spark, d):
    return C.binary_predictions(scored(spark, d).drop("label", "score"), NAMES, "longopen").select("symbol", "opentime", "binary_score", "is_best")


@query("c16_prediction_distribution", f"{PRED} SELECT label, count(*) AS n FROM best GROUP BY label")
def _(spark, d):
    return C.prediction_distribution(scored(spark, d))


# ------------------------------------------------------------------ evaluation

COUNTS = ", ".join(f"count(*) FILTER (target = '{x}') AS true_{x}" for x in NAMES)


@query("e1_confusion_matrix", f"{PRED} SELECT set, label, {COUNTS}, count(*) AS total, count(*) FILTER (label = target) AS hits, round(100.0::DOUBLE * count(*) FILTER (label = target) / count(*), 2) AS ppv FROM best GROUP BY set, label", "ppv")
def _(spark, d):
    return E.confusion_matrix(scored(spark, d), NAMES)


@query("e2_confusion_matrix_pct", f"{PRED} SELECT set, label, count(*) AS total, {', '.join(f'''round(100.0::DOUBLE * count(*) FILTER (target = '{x}') / count(*), 2) AS pct_{x}''' for x in NAMES)} FROM best GROUP BY set, label", "pct_allclose pct_longopen pct_shortopen")
def _(spark, d):
    return E.confusion_matrix_pct(scored(spark, d), NAMES)


@query(
    "e3_binned_confusion",
    f"""{PRED}, b AS (SELECT set, label, least(greatest(floor(score * 10) + 1, 1), 10)::INT AS bin, (label = target)::INT AS hit FROM best), n AS (SELECT set, label, bin, sum(hit) AS t, count(*) - sum(hit) AS f FROM b GROUP BY ALL),
    g AS (SELECT set, label, unnest(range(1, 11))::INT AS bin FROM (SELECT DISTINCT set, label FROM b)), x AS (SELECT g.*, coalesce(t, 0) AS t, coalesce(f, 0) AS f FROM g LEFT JOIN n USING (set, label, bin)),
    c AS (SELECT set, label, bin, sum(t) OVER up AS tp, sum(f) OVER up AS fp, coalesce(sum(t) OVER down, 0) AS fn, coalesce(sum(f) OVER down, 0) AS tn FROM x
    WINDOW up AS (PARTITION BY set, label ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), down AS (PARTITION BY set, label ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT set, label, bin, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS tpr, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS ppv, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) END AS npv FROM c""",
    "tpr fpr ppv npv",
)
def _(spark, d):
    return E.binned_confusion(scored(spark, d), 10)


def truth(spark, d):
    return scored(spark, d).withColumn("truth", F.col("target") == "longopen")


@query(
    "e4_roc_curve",
    f"""{PRED}, b AS (SELECT set, round(floor(longopen * 1000) / 1000, 6) AS threshold, target = 'longopen' AS truth FROM best), n AS (SELECT set, threshold, count(*) FILTER (truth) AS t, count(*) FILTER (NOT truth) AS f FROM b GROUP BY ALL)
    SELECT set, threshold, CASE WHEN sum(t) OVER (PARTITION BY set) > 0 THEN sum(t) OVER w / sum(t) OVER (PARTITION BY set) ELSE 0 END AS tpr, CASE WHEN sum(f) OVER (PARTITION BY set) > 0 THEN sum(f) OVER w / sum(f) OVER (PARTITION BY set) ELSE 0 END AS fpr FROM n
    WINDOW w AS (PARTITION BY set ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "threshold tpr fpr",
)
def _(spark, d):
    return E.roc_curve(truth(spark, d), "longopen", "truth")


@query(
    "e4_auc",
    f"""{PRED}, n AS (SELECT set, longopen, count(*) FILTER (target = 'longopen') AS t, count(*) FILTER (target <> 'longopen') AS f FROM best GROUP BY ALL),
    w AS (SELECT *, t * (coalesce(sum(f) OVER (PARTITION BY set ORDER BY longopen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + f / 2) AS wins FROM n)
    SELECT set, CASE WHEN sum(t) * sum(f) > 0 THEN sum(wins) / (sum(t) * sum(f)) ELSE 0 END AS auc FROM w GROUP BY set""",
    "auc",
)
def _(spark, d):
    return E.auc(truth(spark, d), "longopen", "truth")


def trades(spark, d):
    return E.prediction_trades(scored(spark, d), 0.3, 0.4)


@query(
    "e5_prediction_trades",
    f"""{recursive(PRED)}, num AS (SELECT symbol, set, opentime, pivot, row_number() OVER (PARTITION BY symbol, set ORDER BY opentime) AS i, count(*) OVER (PARTITION BY symbol, set) AS n,
      CASE WHEN score >= 0.3 THEN CASE label WHEN 'longopen' THEN 1 WHEN 'shortopen' THEN -1 ELSE 0 END ELSE 0 END AS want, label = 'allclose' AND score >= 0.4 AS shut FROM best),
    walk AS (SELECT symbol, set, i, CASE WHEN i < n THEN want ELSE 0 END AS side, false AS ended, i < n AND want <> 0 AS started FROM num WHERE i = 1
      UNION ALL SELECT x.symbol, x.set, x.i, CASE WHEN want <> 0 AND (NOT open OR ends) AND x.i < x.n THEN want WHEN ends THEN 0 ELSE before END, ends, want <> 0 AND (NOT open OR ends) AND x.i < x.n
      FROM (SELECT num.*, w.side AS before, w.side <> 0 AS open, w.side <> 0 AND ((want <> 0 AND want <> w.side) OR shut OR num.i = num.n) AS ends
        FROM walk w JOIN num ON num.symbol = w.symbol AND num.set = w.set AND num.i = w.i + 1) x),
    pairs AS (SELECT a.symbol, a.set, a.side, a.i AS s, min(b.i) AS e FROM walk a JOIN walk b ON a.symbol = b.symbol AND a.set = b.set AND b.i > a.i AND b.ended WHERE a.started GROUP BY ALL)
    SELECT p.symbol, p.set, CASE WHEN p.side > 0 THEN 'long' ELSE 'short' END AS trend, a.opentime AS opened, b.opentime AS closed, 100 * p.side * (b.pivot - a.pivot) / a.pivot AS gain
    FROM pairs p JOIN num a ON a.symbol = p.symbol AND a.set = p.set AND a.i = p.s JOIN num b ON b.symbol = p.symbol AND b.set = p.set AND b.i = p.e""",
    "gain",
)
def _(spark, d):
    return trades(spark, d)


FILLS = """fills AS (SELECT o_orderpriority AS set, CASE WHEN o_orderstatus = 'F' THEN 'up' ELSE 'down' END AS trend, o_orderkey, o_custkey, o_orderdate, (o_totalprice::DOUBLE % 1000) / 1000 - 0.4 AS gain FROM orders)"""


def fills(spark, d):
    """Closed trades from orders: set by priority, trend by status, gain from the price."""
    gain = (F.col("o_totalprice").cast("double") % 1000) / 1000 - 0.4
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("set"), F.when(F.col("o_orderstatus") == "F", "up").otherwise("down").alias("trend"), "o_orderkey", "o_custkey",
        F.col("o_orderdate").cast("timestamp_ntz").alias("startdt"), gain.alias("gain"),
    )


@query("e6_trade_performance", f"WITH {FILLS} SELECT set, trend, sum(gain) AS sum_gain, count(*) AS n, avg(gain) AS mean_gain FROM fills GROUP BY GROUPING SETS ((set, trend), (set))", "sum_gain mean_gain")
def _(spark, d):
    return E.trade_performance(fills(spark, d))


@query("e7_gain_summary", f"WITH {FILLS} SELECT set, trend, o_orderkey % 2 = 0 AS predicted, avg(gain) AS mean_gain, avg(o_custkey)::DOUBLE AS mean_samples, count(*) AS n, sum(gain) AS sum_gain, sum(gain - 0.003) AS sum_gainfee FROM fills GROUP BY ALL", "mean_gain mean_samples sum_gain sum_gainfee")
def _(spark, d):
    df = fills(spark, d).withColumn("predicted", F.col("o_orderkey") % 2 == 0).withColumn("samplecount", F.col("o_custkey")).withColumn("gainfee", F.col("gain") - 0.003)
    return E.gain_summary(df)


SEG = """seg AS (SELECT o_custkey % 20 AS coin, CASE WHEN o_orderstatus = 'F' THEN 'up' ELSE 'down' END AS trend, o_orderkey % 2 = 0 AS predicted, o_orderdate::TIMESTAMP + INTERVAL 1 MINUTE * (o_orderkey % 1440) AS startdt,
  o_orderdate::TIMESTAMP + INTERVAL 1 MINUTE * (o_orderkey % 1440 + o_orderkey % 977) AS enddt, o_orderkey FROM orders)"""


def segments(spark, d):
    start = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    return table(spark, d, "orders").select(
        (F.col("o_custkey") % 20).alias("coin"), F.when(F.col("o_orderstatus") == "F", "up").otherwise("down").alias("trend"), (F.col("o_orderkey") % 2 == 0).alias("predicted"),
        start.alias("startdt"), (start + F.make_dt_interval(mins=(F.col("o_orderkey") % 977).cast("int"))).alias("enddt"), "o_orderkey",
    )


@query(
    "e8_segment_distances",
    f"""WITH {SEG}, t AS (SELECT coin, trend, enddt AS te, min(startdt) AS ts FROM seg WHERE NOT predicted GROUP BY ALL), p AS (SELECT *, lead(startdt) OVER (PARTITION BY coin, trend ORDER BY startdt, enddt) AS nx FROM seg WHERE predicted)
    SELECT p.coin, p.trend, p.startdt, p.enddt, date_diff('minute', p.enddt, nx) AS next_minutes, date_diff('minute', p.startdt, ts) AS start_minutes, date_diff('minute', p.enddt, te) AS end_minutes, ts <= p.enddt AS true_positive
    FROM p ASOF LEFT JOIN t ON p.coin = t.coin AND p.trend = t.trend AND p.startdt <= t.te""",
)
def _(spark, d):
    return E.segment_distances(segments(spark, d))


BQ = f"""{HOURS}, b AS (SELECT *, {BOUNDS}, CASE WHEN rn % 3 = 0 THEN 'test' ELSE 'train' END AS set, (rn - 1) // 250 AS rangeid FROM bars), q AS (SELECT *, pivot * 1.2 AS upper, pivot * 0.8 AS lower FROM b),
  hit AS (SELECT q.symbol, q.rn, min(x.rn - q.rn) FILTER (x.high >= q.upper) AS up, min(x.rn - q.rn) FILTER (x.low <= q.lower) AS down FROM q JOIN b x ON x.symbol = q.symbol AND x.rangeid = q.rangeid AND x.rn BETWEEN q.rn + 1 AND q.rn + 10 GROUP BY ALL),
  late AS (SELECT q.symbol, q.rn, min(x.rn - q.rn) FILTER (x.high >= q.upper) AS upl, min(x.rn - q.rn) FILTER (x.low <= q.lower) AS downl FROM q JOIN b x ON x.symbol = q.symbol AND x.rangeid = q.rangeid AND x.rn > q.rn GROUP BY ALL)"""


def bounds(spark, d):
    df = T.bounds_target(number_rows(hours(spark, d)), 10)
    df = df.withColumn("centerpred", F.col("pivot")).withColumn("widthpred", 0.4 * F.col("pivot")).withColumnRenamed("center", "centertarget").withColumnRenamed("width", "widthtarget")
    return df.withColumn("upper", F.col("pivot") * 1.2).withColumn("lower", F.col("pivot") * 0.8).withColumn("set", F.when(F.col("rn") % 3 == 0, "test").otherwise("train")).withColumn("rangeid", F.floor((F.col("rn") - 1) / 250))


@query(
    "e9_bounds_quality",
    f"""{BQ} SELECT set, round(avg(abs(pivot - (lowtarget + hightarget) / 2)), 6) AS mae_center, round(avg(abs(0.4 * pivot - (hightarget - lowtarget))), 6) AS mae_width, round(100.0 * avg((up IS NOT NULL)::INT::DOUBLE), 4) AS upper_pct,
    round(100.0 * avg((down IS NOT NULL)::INT::DOUBLE), 4) AS lower_pct, round(avg(up), 6) AS upper_rows, round(avg(down), 6) AS lower_rows, round(avg(100.0 * (upper - close) / close), 6) AS upper_dist_pct,
    round(avg(100.0 * (close - lower) / close), 6) AS lower_dist_pct, round(100.0 * avg((up IS NULL AND upl IS NOT NULL)::INT::DOUBLE), 4) AS upper_late_pct,
    round(100.0 * avg((down IS NULL AND downl IS NOT NULL)::INT::DOUBLE), 4) AS lower_late_pct, round(avg(upl) FILTER (up IS NULL), 6) AS upper_late_rows, round(avg(downl) FILTER (down IS NULL), 6) AS lower_late_rows
    FROM q LEFT JOIN hit USING (symbol, rn) LEFT JOIN late USING (symbol, rn) GROUP BY set""",
    "mae_center mae_width upper_pct lower_pct upper_rows lower_rows upper_dist_pct lower_dist_pct upper_late_pct lower_late_pct upper_late_rows lower_late_rows",
)
def _(spark, d):
    return E.bounds_quality(bounds(spark, d), 10, ("symbol", "rangeid"))


STATUS = f"""{BQ}, s AS (SELECT q.symbol, q.opentime, up, down, upl, downl FROM q LEFT JOIN hit USING (symbol, rn) LEFT JOIN late USING (symbol, rn)),
  st AS (SELECT symbol, opentime, 'upper' AS side, CASE WHEN up IS NOT NULL THEN 'within' WHEN down IS NOT NULL THEN 'opposite' WHEN upl IS NOT NULL THEN 'late' ELSE 'pending' END AS status, coalesce(up, upl) AS delay FROM s
  UNION ALL SELECT symbol, opentime, 'lower', CASE WHEN down IS NOT NULL THEN 'within' WHEN up IS NOT NULL THEN 'opposite' WHEN downl IS NOT NULL THEN 'late' ELSE 'pending' END, coalesce(down, downl) FROM s)"""


def statuses(spark, d):
    df = bounds(spark, d).select("symbol", "rangeid", "opentime", "high", "low", "upper", "lower")
    return E.bound_status(df, 10, ("symbol", "rangeid"))


@query("e10_bound_status", f"{STATUS} SELECT * FROM st")
def _(spark, d):
    return statuses(spark, d)


@query("e11_duplicate_segments", f"WITH {SEG} SELECT coin, trend, predicted, date_trunc('month', startdt)::TIMESTAMP AS month, count(*) AS n FROM seg GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    month = F.date_trunc("month", "startdt").cast("timestamp_ntz")
    return E.duplicate_segments(segments(spark, d).withColumn("month", month), ["coin", "trend", "predicted", "month"])


@query("e12_missing_coins", "SELECT c_custkey AS coin FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)")
def _(spark, d):
    return E.missing_coins(table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("coin")), table(spark, d, "customer").select(F.col("c_custkey").alias("coin")))


@query(
    "e13_kpi_overview",
    f"WITH {FILLS} SELECT set AS coin, o_custkey % 5 AS cfgid, avg(gain) AS mean_gain, median(gain) AS median_gain, sum(gain) AS sum_gain, min(gain) AS min_gain, max(gain) AS max_gain, count(*) AS n, avg(o_orderkey % 500)::DOUBLE AS mean_minutes, count(*) FILTER (trend = 'up') AS n_long FROM fills GROUP BY ALL",
    "mean_gain median_gain sum_gain min_gain max_gain mean_minutes",
)
def _(spark, d):
    df = fills(spark, d).withColumnRenamed("set", "coin").withColumn("cfgid", F.col("o_custkey") % 5).withColumn("minutes", F.col("o_orderkey") % 500)
    return E.kpi_overview(df)


@query(
    "e13_kpi_of_sketches",
    f"WITH {FILLS} SELECT set AS coin, o_custkey % 5 AS cfgid, avg(gain) AS mean_gain, quantile_disc(gain, 0.5) AS median_gain, sum(gain) AS sum_gain, min(gain) AS min_gain, max(gain) AS max_gain, count(*) AS n, avg(o_orderkey % 500)::DOUBLE AS mean_minutes, count(*) FILTER (trend = 'up') AS n_long FROM fills GROUP BY ALL",
    "mean_gain median_gain sum_gain min_gain max_gain mean_minutes",
)
def _(spark, d):
    # Sketches of parts of the table, merged: below their size they hold all values, so the median is exact.
    df = fills(spark, d).withColumnRenamed("set", "coin").withColumn("cfgid", F.col("o_custkey") % 5).withColumn("minutes", F.col("o_orderkey") % 500)
    parts = summaries.gain_sketches(df.withColumn("part", F.col("o_orderkey") % 3), ("coin", "cfgid", "part"))
    return summaries.kpi_of_sketches(parts)


@query(
    "e14_cumulative_gain_range",
    f"WITH {FILLS}, r AS (SELECT set, sum(gain) OVER (PARTITION BY set ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM fills) SELECT set AS coin, greatest(max(run), 0) AS max_cumulative, least(min(run), 0) AS min_cumulative FROM r GROUP BY set",
    "max_cumulative min_cumulative",
)
def _(spark, d):
    return E.cumulative_gain_range(fills(spark, d).withColumnRenamed("set", "coin"), "o_orderkey")


@query("e15_describe_table", f"{HOURS} SELECT symbol, count(*) AS n, true AS ascending, avg(close) AS mean_close, min(close) AS min_close, max(close) AS max_close FROM bars GROUP BY symbol", "mean_close min_close max_close")
def _(spark, d):
    return E.describe_table(hours(spark, d), ["close"])


@query("e16_status_counts", f"{STATUS} SELECT side, status, count(*) AS n FROM st GROUP BY side, status")
def _(spark, d):
    return E.status_counts(statuses(spark, d))

