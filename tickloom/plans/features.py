"""Queries: features, extremes and market view."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators import bars as B
from tickloom.operators import extremes as X
from tickloom.operators import features as G
from tickloom.operators import market as M
from tickloom.operators.targets import Thresholds
from tickloom.operators.windows import in_chunks, number_rows
from tickloom.plans.bars import FILLED
from tickloom.plans.registry import HOURS, W, hours, line_sql, lined, query, table

L24, L6 = line_sql(24), line_sql(6)
KEYS = "symbol, opentime"


@query("f1_rolling_regression_24", f"{HOURS}, {L24} SELECT {KEYS}, regry AS regry_24, grad AS grad_24 FROM line", "regry_24 grad_24")
def _(spark, d):
    return G.rolling_regression(hours(spark, d), "pivot", [24]).select("symbol", "opentime", "regry_24", "grad_24")


@query("f1_rolling_regression_200", f"{HOURS}, {line_sql(200)} SELECT {KEYS}, regry AS regry_200, grad AS grad_200 FROM line", "regry_200 grad_200")
def _(spark, d):
    return G.rolling_regression(hours(spark, d), "pivot", [200]).select("symbol", "opentime", "regry_200", "grad_200")


@query(
    "f1_regression_in_chunks",
    f"""{HOURS}, {FILLED}, g AS (SELECT symbol, t AS opentime, pivot, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM filled), {line_sql(24, "g")}
    SELECT {KEYS}, regry AS regry_24, grad AS grad_24 FROM line WHERE rn >= 24""",
    "regry_24 grad_24",
)
def _(spark, d):
    full = B.fill_gaps(hours(spark, d), 60)
    rows = number_rows(full, name="n")
    work = lambda df: G.rolling_regression(df, "pivot", [24], keys=("symbol", "chunk"))
    out = in_chunks(rows, work, minutes=5 * 1440, halo_minutes=24 * 60)
    return out.where("n >= 24").select("symbol", "opentime", "regry_24", "grad_24")


@query("f2_norm_rolling_regression", f"{HOURS}, {L24} SELECT {KEYS}, regry / pivot AS regry_24, grad / pivot AS grad_24 FROM line WHERE pivot > 0", "regry_24 grad_24")
def _(spark, d):
    return G.norm_rolling_regression(hours(spark, d), "pivot", [24]).where("pivot > 0").select("symbol", "opentime", "regry_24", "grad_24")


STD = f"""{HOURS}, {L24}, pairs AS (SELECT l.symbol, l.opentime, l.rn, l.regry, l.grad, b.pivot - (l.regry - l.grad * (l.rn - b.rn)) AS r1,
  b.high - (l.regry - l.grad * (l.rn - b.rn)) AS r2, b.rn AS brn FROM line l JOIN bars b ON l.symbol = b.symbol AND b.rn BETWEEN l.rn - 23 AND l.rn)"""


@query("f3_regression_std", f"{STD} SELECT {KEYS}, coalesce(stddev_samp(r1), 0) AS std_24 FROM pairs GROUP BY ALL", "std_24")
def _(spark, d):
    return lined(spark, d).select("symbol", "opentime", "std_24")


@query("f3_regression_std_mv", f"{STD}, two AS (SELECT {KEYS}, r1 AS r FROM pairs UNION ALL SELECT {KEYS}, r2 FROM pairs) SELECT {KEYS}, stddev_samp(r) AS std_24 FROM two GROUP BY ALL", "std_24")
def _(spark, d):
    return G.rolling_regression(hours(spark, d), "pivot", [24], ["pivot", "high"]).select("symbol", "opentime", "std_24")


@query("f4_regression_mean_dist", f"{STD} SELECT {KEYS}, avg(r2) AS mean_24, max(r2) FILTER (brn = rn) AS last_24 FROM pairs GROUP BY ALL", "mean_24 last_24")
def _(spark, d):
    return G.rolling_regression(hours(spark, d), "pivot", [24], ["high"]).select("symbol", "opentime", "mean_24", "last_24")


@query("f5_rolling_extremes", f"{HOURS} SELECT {KEYS}, max(high) OVER ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS high_100, min(low) OVER ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS low_100, max(high) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS high_12 FROM bars", "high_100 low_100 high_12")
def _(spark, d):
    from tickloom.operators.windows import with_sliding_extreme as extreme

    df = extreme(extreme(extreme(hours(spark, d), "high", 100, "high_100", True), "low", 100, "low_100", False), "high", 12, "high_12", True)
    return df.select("symbol", "opentime", "high_100", "low_100", "high_12")


@query("f6_rolling_median", f"{HOURS} SELECT {KEYS}, median(basevolume) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS median_12 FROM bars", "median_12")
def _(spark, d):
    return G.rolling_median(hours(spark, d), "basevolume", 12, "median_12").select("symbol", "opentime", "median_12")


@query("f7_relative_volume", f"{HOURS} SELECT {KEYS}, median(basevolume) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / median(basevolume) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rv_3_24 FROM bars", "rv_3_24")
def _(spark, d):
    return G.relative_volume(hours(spark, d), 3, 24).select("symbol", "opentime", "rv_3_24")


def _dist(offset: int, base: str, low: str, high: str) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {23 + offset} PRECEDING AND {offset} PRECEDING)" if offset else f"OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    lo, hi = f"min({low}) {frame}", f"max({high}) {frame}"
    return f"(pivot - {lo}) / {base or lo} AS mind24_{offset}, (pivot - {hi}) / {base or hi} AS maxd24_{offset}"


@query("f8_extreme_distances", f"{HOURS} SELECT {KEYS}, {_dist(3, 'pivot', 'low', 'high')} FROM bars WHERE true", "mind24_3 maxd24_3")
def _(spark, d):
    return G.extreme_distances(hours(spark, d), 24, 3).select("symbol", "opentime", "mind24_3", "maxd24_3")


@query("f9_mm_dist_v5", f"{HOURS} SELECT {KEYS}, {_dist(0, '', 'pivot', 'pivot')} FROM bars", "mind24_0 maxd24_0")
def _(spark, d):
    return G.extreme_distances(hours(spark, d), 24, 0, of_extreme=True).select("symbol", "opentime", "mind24_0", "maxd24_0")


@query("f10_regression_features", f"{HOURS}, {L24} SELECT {KEYS}, (pivot - regry) / pivot AS ry24_0, lag(grad, 3) OVER ({W}) AS rg24_3 FROM line", "ry24_0 rg24_3")
def _(spark, d):
    return G.regression_features(hours(spark, d), [("ry", 24, 0), ("rg", 24, 3)]).select("symbol", "opentime", "ry24_0", "rg24_3")


@query("f11_feature_set_v4", f"{HOURS}, {L24} SELECT {KEYS}, regry AS regry_24, grad AS grad_24 FROM line WHERE rn >= 60", "regry_24 grad_24")
def _(spark, d):
    return G.feature_set_v4(hours(spark, d), (24, 60)).select("symbol", "opentime", "regry_24", "grad_24")


@query("f12_feature_set_v5", f"{HOURS}, {L24} SELECT {KEYS}, lag(grad, 3) OVER ({W}) AS rw_24_grad_3, (pivot - min(pivot) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) / min(pivot) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS mm_24_mindist, (pivot - max(pivot) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) / max(pivot) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS mm_24_maxdist FROM line", "rw_24_grad_3 mm_24_mindist mm_24_maxdist")
def _(spark, d):
    return G.feature_set_v5(hours(spark, d), ["rw_24_grad_3", "mm_24"])


@query("f13_feature_set_v6", f"{HOURS}, {L24} SELECT {KEYS}, (pivot - regry) / pivot AS ry24_0, {_dist(0, 'pivot', 'low', 'high')}, median(basevolume) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / median(basevolume) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rv_3_24 FROM line", "ry24_0 mind24_0 maxd24_0 rv_3_24")
def _(spark, d):
    return G.feature_set_v6(hours(spark, d), [("ry", 24, 0), ("mind", 24, 0), ("maxd", 24, 0)], [(3, 24)])


TURN = f"""{HOURS}, {L24}, dirs AS (SELECT *, coalesce(last_value(CASE WHEN round(grad, 9) <> 0 THEN sign(grad) END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS dir FROM line),
  turned AS (SELECT *, CASE WHEN dir > 0 AND lead(dir) OVER ({W}) < 0 THEN 1 WHEN dir < 0 AND lead(dir) OVER ({W}) > 0 THEN -1 ELSE 0 END AS turn FROM dirs)"""


def steady(spark, d):
    """The regression with slopes of noise size set to zero, as the SQL does."""
    df = lined(spark, d)
    return df.withColumn("grad_24", F.when(F.round("grad_24", 9) != 0, F.col("grad_24")).otherwise(0.0))


@query("f14_feature_set_v2", f"{TURN} SELECT {KEYS}, regry AS regry_24, grad AS grad_24, turn::INT AS turn_24 FROM turned", "regry_24 grad_24")
def _(spark, d):
    return G.feature_set_v2(hours(spark, d), [24], [(1, 6)]).select("symbol", "opentime", "regry_24", "grad_24", "turn_24")


@query("f15_lookback", f"{HOURS} SELECT {KEYS}, coalesce(lag(close, 5) OVER ({W}), first_value(close) OVER ({W})) AS close05, coalesce(lag(high, 3) OVER ({W}), 0) AS high03 FROM bars", "close05 high03")
def _(spark, d):
    return G.lookback(G.lookback(hours(spark, d), "close", 5), "high", 3, 0.0).select("symbol", "opentime", "close05", "high03")


@query("f16_delta_ohlc", f"{HOURS} SELECT {KEYS}, (high - pivot) / pivot AS high00, coalesce(lag(high - pivot, 1) OVER ({W}), 0) / pivot AS high01, coalesce(lag(close - pivot, 2) OVER ({W}), 0) / pivot AS close02 FROM bars", "high00 high01 close02")
def _(spark, d):
    return G.delta_ohlc(hours(spark, d), 3).select("symbol", "opentime", "high00", "high01", "close02")


@query("f17_regression_lookbacks", f"{HOURS}, {L24} SELECT {KEYS}, grad / pivot AS grad24_00, lag(grad, 24) OVER ({W}) / pivot AS grad24_01, lag(pivot - regry, 48) OVER ({W}) / pivot AS disty24_02 FROM line", "grad24_00 grad24_01 disty24_02")
def _(spark, d):
    return G.regression_lookbacks(hours(spark, d), [24], 3).select("symbol", "opentime", "grad24_00", "grad24_01", "disty24_02")


@query("f18_feature_vector_12x", f"{HOURS}, {L24} SELECT {KEYS}, lag(grad, 24) OVER ({W}) / pivot AS grad24_01, round_even(hour(opentime) / 24.0::DOUBLE, 4) AS rel_day FROM line", "grad24_01 rel_day")
def _(spark, d):
    return G.feature_vector_12x(hours(spark, d), 24, [6], (1, 12)).select("symbol", "opentime", "grad24_01", "rel_day")


@query(
    "f19_regression_acceleration",
    f"""{HOURS}, {L24}, c AS (SELECT {KEYS}, rn, round(coalesce(grad - lag(grad) OVER ({W}), 0), 9) AS change FROM line), s AS (SELECT *, sign(change) AS sg FROM c),
    n AS (SELECT *, (sg IS DISTINCT FROM lag(sg) OVER ({W}))::INT AS fresh FROM s), i AS (SELECT *, sum(fresh) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM n)
    SELECT {KEYS}, sum(change) OVER (PARTITION BY symbol, island ORDER BY opentime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acceleration FROM i""",
    "acceleration",
)
def _(spark, d):
    df = lined(spark, d).withColumn("grad_24", F.round("grad_24", 15))
    change = F.round(F.coalesce(F.col("grad_24") - F.lag("grad_24").over(Window.partitionBy("symbol").orderBy("opentime")), F.lit(0.0)), 9)
    # Slopes summed up from changes of nine digits, as in the SQL.
    df = df.withColumn("steps", F.sum(change).over(Window.partitionBy("symbol").orderBy("opentime")))
    df = df.withColumn("steps", F.round("steps", 9))
    return G.regression_acceleration(df, "steps").select("symbol", "opentime", "acceleration")


@query(
    "f20_last_extreme_distance",
    f"""{TURN}, t AS (SELECT *, last_value(CASE WHEN turn = 1 THEN rn END IGNORE NULLS) OVER w AS mx, last_value(CASE WHEN turn = 1 THEN regry END IGNORE NULLS) OVER w AS mp,
    last_value(CASE WHEN turn = -1 THEN rn END IGNORE NULLS) OVER w AS nx, last_value(CASE WHEN turn = -1 THEN regry END IGNORE NULLS) OVER w AS np FROM turned
    WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT {KEYS}, (rn - mx)::INT AS rows_since_max, (mp - regry) / regry AS dist_max, (rn - nx)::INT AS rows_since_min, (np - regry) / regry AS dist_min FROM t""",
    "dist_max dist_min",
)
def _(spark, d):
    df = G.last_extreme_distance(steady(spark, d), "grad_24", "regry_24")
    return df.select("symbol", "opentime", "rows_since_max", "dist_max", "rows_since_min", "dist_min")


@query(
    "f21_last_gain_loss",
    f"""{TURN}, b AS (SELECT *, last_value(CASE WHEN turn <> 0 THEN regry END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turned),
    s AS (SELECT *, CASE WHEN turn <> 0 THEN (regry - before) / before END AS swing FROM b)
    SELECT {KEYS}, last_value(CASE WHEN turn = 1 THEN swing END IGNORE NULLS) OVER w AS last_gain, last_value(CASE WHEN turn = -1 THEN swing END IGNORE NULLS) OVER w AS last_loss FROM s
    WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "last_gain last_loss",
)
def _(spark, d):
    return G.last_gain_loss(steady(spark, d), "grad_24", "regry_24").select("symbol", "opentime", "last_gain", "last_loss")


@query("f22_supplement", f"{HOURS}, {L24} SELECT {KEYS}, regry AS regry_24, grad AS grad_24 FROM line WHERE opentime >= TIMESTAMP '2024-01-20'", "regry_24 grad_24")
def _(spark, d):
    df = hours(spark, d)
    stored = df.where(F.col("opentime") < F.lit("2024-01-20").cast("timestamp_ntz"))
    out = G.supplement(df, stored, lambda x: G.rolling_regression(x, "pivot", [24]), halo=23)
    return out.select("symbol", "opentime", "regry_24", "grad_24")


@query("f24_regression_bands", f"{STD} SELECT {KEYS}, any_value(regry) AS regry, any_value(regry) + 2 * coalesce(stddev_samp(r1), 0) AS upper2, any_value(regry) - coalesce(stddev_samp(r1), 0) AS lower1 FROM pairs GROUP BY ALL", "regry upper2 lower1")
def _(spark, d):
    return G.regression_bands(hours(spark, d), 24).select("symbol", "opentime", "regry", "upper2", "lower1")


@query("f25_regression_line", f"{HOURS} SELECT symbol, regr_intercept(pivot, rn) + regr_slope(pivot, rn) AS start_y, regr_intercept(pivot, rn) + regr_slope(pivot, rn) * max(rn) AS end_y FROM bars GROUP BY symbol", "start_y end_y")
def _(spark, d):
    return G.regression_line(hours(spark, d))


# ------------------------------------------------------------------ extremes


@query("x1_regression_extremes", f"{TURN} SELECT symbol, opentime, rn::INT AS rn, CASE WHEN rn = max(rn) OVER (PARTITION BY symbol) THEN dir ELSE turn END::INT AS kind FROM turned QUALIFY rn = max(rn) OVER (PARTITION BY symbol) OR turn <> 0")
def _(spark, d):
    return X.regression_extremes(steady(spark, d), "grad_24")


@query(
    "x2_neighbour_extremes",
    f"{TURN} SELECT symbol, rn::INT AS rn, last_value(CASE WHEN turn <> 0 THEN rn END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::INT AS prev_extreme, first_value(CASE WHEN turn <> 0 THEN rn END IGNORE NULLS) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)::INT AS next_extreme FROM turned",
)
def _(spark, d):
    return X.neighbour_extremes(steady(spark, d), "grad_24").select("symbol", "rn", "prev_extreme", "next_extreme")


PEAKS = f"""{TURN}, ex AS (SELECT symbol, rn, CASE WHEN rn = max(rn) OVER (PARTITION BY symbol) THEN dir ELSE turn END AS kind, max(rn) OVER (PARTITION BY symbol) AS n, turn FROM turned),
  e2 AS (SELECT symbol, rn AS a, coalesce(lag(rn) OVER (PARTITION BY symbol ORDER BY rn), 1) AS b, kind FROM ex WHERE (rn = n OR turn <> 0) AND kind <> 0),
  cand AS (SELECT e2.*, bars.rn AS r, row_number() OVER (PARTITION BY e2.symbol, a ORDER BY -kind * pivot, abs(bars.rn - b)) AS k FROM e2 JOIN bars ON bars.symbol = e2.symbol AND bars.rn BETWEEN b AND a)"""


@query("x3_price_extreme_between", f"{PEAKS} SELECT symbol, a::INT AS a, b::INT AS b, kind::INT AS kind, r::INT AS extreme_rn FROM cand WHERE k = 1")
def _(spark, d):
    df = steady(spark, d)
    found = X.regression_extremes(df, "grad_24").where("kind <> 0")
    before = F.coalesce(F.lag("rn").over(Window.partitionBy("symbol").orderBy("rn")), F.lit(1))
    return X.price_extreme_between(df, found.select("symbol", F.col("rn").alias("a"), before.alias("b"), "kind"))


@query(
    "x4_next_local_extreme",
    f"""{HOURS}, s AS (SELECT symbol, opentime, rn, sign(lead(pivot) OVER ({W}) - pivot) AS step FROM bars), n AS (SELECT *, (step IS DISTINCT FROM lag(step) OVER ({W}))::INT AS fresh FROM s),
    i AS (SELECT *, sum(fresh) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM n)
    SELECT symbol, rn::INT AS rn, (max(rn) OVER (PARTITION BY symbol, run) + (step IS NOT NULL)::INT)::INT AS extreme_rn FROM i""",
)
def _(spark, d):
    return X.next_local_extreme(hours(spark, d)).select("symbol", "rn", "extreme_rn")


# The last extremes (rn and price), the direction and the peak that a row confirms, row by row; then each row's next peak.
_STEP = """CASE WHEN up AND hi < rn AND (pivot - ph) / abs(ph) <= -0.3 THEN -1 WHEN down AND lo < rn AND (pivot - pl) / abs(pl) >= 0.3 THEN 1 ELSE 0 END"""
ZIGZAG = f"""{HOURS.replace("WITH", "WITH RECURSIVE", 1)}, zz AS (SELECT symbol, rn, rn AS hi, pivot AS ph, rn AS lo, pivot AS pl, 0 AS dir, NULL::BIGINT AS peak FROM bars WHERE rn = 1
    UNION ALL SELECT symbol, rn, CASE WHEN turn = 1 THEN rn ELSE hi END, CASE WHEN turn = 1 THEN pivot ELSE ph END, CASE WHEN turn = -1 THEN rn ELSE lo END, CASE WHEN turn = -1 THEN pivot ELSE pl END,
      CASE WHEN turn = 0 THEN dir ELSE turn END, CASE turn WHEN -1 THEN hi WHEN 1 THEN lo END
    FROM (SELECT *, {_STEP} AS turn FROM (SELECT b.symbol, b.rn, b.pivot, z.dir, z.dir >= 0 AS up, z.dir <= 0 AS down,
      CASE WHEN z.dir >= 0 AND b.pivot > z.ph THEN b.rn ELSE z.hi END AS hi, CASE WHEN z.dir >= 0 AND b.pivot > z.ph THEN b.pivot ELSE z.ph END AS ph,
      CASE WHEN z.dir <= 0 AND b.pivot < z.pl THEN b.rn ELSE z.lo END AS lo, CASE WHEN z.dir <= 0 AND b.pivot < z.pl THEN b.pivot ELSE z.pl END AS pl
      FROM zz z JOIN bars b ON b.symbol = z.symbol AND b.rn = z.rn + 1))),
  tops AS (SELECT symbol, peak FROM zz WHERE peak IS NOT NULL UNION SELECT symbol, CASE WHEN arg_max(dir, rn) > 0 THEN arg_max(hi, rn) ELSE arg_max(lo, rn) END FROM zz GROUP BY symbol HAVING arg_max(dir, rn) <> 0),
  nextpeak AS (SELECT b.*, coalesce(t.peak, 0)::INT AS peak_rn FROM bars b ASOF LEFT JOIN tops t ON b.symbol = t.symbol AND b.rn < t.peak),
  peaks AS (SELECT a.*, coalesce(b.pivot - a.pivot, 0) AS distance FROM nextpeak a LEFT JOIN bars b ON b.symbol = a.symbol AND b.rn = a.peak_rn)"""


@query("x5_significant_peaks", f"{ZIGZAG} SELECT symbol, opentime, peak_rn, distance FROM peaks", "distance")
def _(spark, d):
    return X.significant_peaks(hours(spark, d), 0.3, -0.3).select("symbol", "opentime", "peak_rn", "distance")


# From the last row backwards: the highest and lowest rows since the newest turning point (with both prices of each, since one
# becomes the other at a turn), and the turning points so far. m: the row's own update; t: the turn that it makes.
AMPLITUDE = 0.5
SWING = f"""{HOURS.replace("WITH", "WITH RECURSIVE", 1)}, back AS (SELECT symbol, rn, high, low, max(rn) OVER (PARTITION BY symbol) AS n FROM bars),
  sw AS (SELECT symbol, n, rn, rn AS top, high AS th, low AS tl, rn AS bot, high AS bh, low AS bl, 0::BIGINT AS last, []::BIGINT[] AS out FROM back WHERE rn = n
    UNION ALL SELECT symbol, n, rn,
      CASE WHEN again THEN rn WHEN turn = -2 THEN bot ELSE top END, CASE WHEN again THEN high WHEN turn = -2 THEN bh ELSE th END, CASE WHEN again THEN low WHEN turn = -2 THEN bl ELSE tl END,
      CASE WHEN again THEN rn WHEN turn = 2 THEN top ELSE bot END, CASE WHEN again THEN high WHEN turn = 2 THEN th ELSE bh END, CASE WHEN again THEN low WHEN turn = 2 THEN tl ELSE bl END,
      CASE WHEN again THEN sign(newest) * rn ELSE newest END::BIGINT, CASE WHEN again THEN list_append(made[:-2], (sign(newest) * rn)::BIGINT) ELSE made END
    FROM (SELECT *, coalesce(made[-1], 0) AS newest, CASE WHEN made[-1] > 0 THEN high > (CASE WHEN made[-1] = top THEN th ELSE bh END) WHEN made[-1] < 0 THEN low < (CASE WHEN -made[-1] = bot THEN bl ELSE tl END) ELSE false END AS again
      FROM (SELECT *, CASE turn WHEN 1 THEN CASE WHEN top >= bot THEN [top, -bot] ELSE [-bot, top] END WHEN 2 THEN list_append(out, top) WHEN -2 THEN list_append(out, -bot) ELSE out END AS made
        FROM (SELECT *, CASE WHEN (th - bl) / bl < {AMPLITUDE} THEN 0 WHEN last = 0 THEN 1 WHEN last < 0 AND top < -last THEN 2 WHEN last > 0 AND bot < last THEN -2 ELSE 0 END AS turn
          FROM (SELECT b.symbol, b.n, b.rn, b.high, b.low, s.last, s.out,
              CASE WHEN up THEN b.rn ELSE s.top END AS top, CASE WHEN up THEN b.high ELSE s.th END AS th, CASE WHEN up THEN b.low ELSE s.tl END AS tl,
              CASE WHEN down THEN b.rn ELSE s.bot END AS bot, CASE WHEN down THEN b.high ELSE s.bh END AS bh, CASE WHEN down THEN b.low ELSE s.bl END AS bl
            FROM (SELECT s.*, s.last <= 0 AND b.high > s.th AS up, s.last >= 0 AND b.low < s.bl AS down FROM sw s JOIN back b ON b.symbol = s.symbol AND b.rn = s.rn - 1) s
            JOIN back b ON b.symbol = s.symbol AND b.rn = s.rn - 1)))))"""


@query("x6_amplitude_extremes", f"{SWING} SELECT symbol, array_to_string(list_filter(out, lambda p: abs(p) < n)[:20], ',') AS extremes FROM sw WHERE rn = 1")
def _(spark, d):
    found = X.amplitude_extremes(hours(spark, d), AMPLITUDE, 20)
    return found.withColumn("extremes", F.array_join(F.col("extremes").cast("array<string>"), ","))


@query("x7_smooth_distance", f"{HOURS} SELECT symbol, opentime, (rn + 10) * 2.0 - (pivot + ((rn + 10) * 2.0 - pivot) * 5 / 10) AS smooth FROM bars", "smooth")
def _(spark, d):
    df, rn = number_rows(hours(spark, d)), F.col("rn")
    return df.select("symbol", "opentime", X.smooth_distance(F.col("pivot"), rn, rn + 5, (rn + 10) * 2.0, rn + 10).alias("smooth"))


@query("x8_regression_price_peaks", f"{PEAKS} SELECT symbol, r::INT AS rn, kind::INT AS kind, a::INT AS regression_rn FROM cand WHERE k = 1")
def _(spark, d):
    return X.regression_price_peaks(steady(spark, d), "grad_24")


def paths(spark, d):
    df = lined(spark, d, (6, 24))
    return df, X.best_peak_path(df, X.windows_peaks(df, [6, 24]), Thresholds())


@query("x9_best_peak_path")
def _(spark, d):
    return paths(spark, d)[1]


@query("x10_peak_labels")
def _(spark, d):
    df, found = paths(spark, d)
    return X.peak_labels(df.select("symbol", "opentime", "pivot"), found, Thresholds()).select("symbol", "opentime", "peak_rn", "distance", "label")


# ------------------------------------------------------------------ market


@query("m1_quote_volume_24h", f"{HOURS} SELECT {KEYS}, sum(close * basevolume) OVER ({W} RANGE BETWEEN INTERVAL 1439 MINUTES PRECEDING AND CURRENT ROW) AS quotevolume24h FROM bars", "quotevolume24h")
def _(spark, d):
    return M.rolling_quote_volume_24h(hours(spark, d)).select("symbol", "opentime", "quotevolume24h")


CHANGE = f"first_value(close) OVER ({W} RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"


@query("m2_price_change_24h", f"{HOURS}, f AS (SELECT *, {CHANGE} AS fc FROM bars) SELECT {KEYS}, CASE WHEN fc > 0 THEN (close - fc) / fc * 100 ELSE 0 END AS pricechangepercent FROM f", "pricechangepercent")
def _(spark, d):
    return M.price_change_24h(hours(spark, d)).select("symbol", "opentime", "pricechangepercent")


SNAP = f"""{HOURS}, f AS (SELECT *, {CHANGE} AS fc, sum(close * basevolume) OVER ({W} RANGE BETWEEN INTERVAL 1439 MINUTES PRECEDING AND CURRENT ROW) AS qv FROM bars),
  snap AS (SELECT symbol, qv AS quotevolume24h, CASE WHEN fc > 0 THEN (close - fc) / fc * 100 ELSE 0 END AS pricechangepercent, close AS lastprice FROM f
  WHERE opentime <= TIMESTAMP '2024-01-15 12:30:00' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY opentime DESC) = 1)"""


@query("m3_market_snapshot", f"{SNAP} SELECT * FROM snap", "quotevolume24h pricechangepercent lastprice")
def _(spark, d):
    return M.market_snapshot(hours(spark, d), "2024-01-15 12:30:00")


@query(
    "m4_continuous_liquidity",
    f"""{HOURS}, v AS (SELECT *, round(sum(pivot * basevolume) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS volume, row_number() OVER (PARTITION BY symbol ORDER BY opentime DESC) AS back
    FROM bars WHERE opentime <= TIMESTAMP '2024-01-15'), l AS (SELECT symbol, count(*) FILTER (volume < 600) + 24 - count(*) AS bad FROM v WHERE back <= 24 GROUP BY symbol)
    SELECT symbol, bad, bad < 0.5 * 24 AS liquid FROM l""",
)
def _(spark, d):
    return M.continuous_liquidity_now(hours(spark, d), "2024-01-15", 600.0, 4, 24, 0.5)


@query(
    "m5_trade_selection",
    f"""{SNAP}, s AS (SELECT *, symbol < 'd' AS inportfolio, symbol = 'view' AS blacklisted, symbol <> 'click' AS accepted, round(quotevolume24h, 6) >= 3000 AS minquotevol FROM snap)
    SELECT symbol, inportfolio, blacklisted, accepted, minquotevol, minquotevol AND accepted AND NOT blacklisted AS openenabled, inportfolio AS closeenabled FROM s""",
)
def _(spark, d):
    snap = M.market_snapshot(hours(spark, d), "2024-01-15 12:30:00").withColumn("quotevolume24h", F.round("quotevolume24h", 6))
    out = M.trade_selection(snap, snap.where("symbol < 'd'"), snap.where("symbol = 'view'"), snap.where("symbol <> 'click'"), 3000.0)
    return out.select("symbol", "inportfolio", "blacklisted", "accepted", "minquotevol", "openenabled", "closeenabled")


@query(
    "m6_screen_market",
    """SELECT p_partkey, p_brand || '#' AS base, 'ECONOMY' AS quote, p_retailprice::DOUBLE AS quotevolume24h FROM part
    WHERE p_type = 'ECONOMY' AND p_retailprice >= 950 AND p_brand <> 'Brand#11'""",
    "quotevolume24h",
)
def _(spark, d):
    parts = table(spark, d, "part")
    tickers = parts.select("p_partkey", F.concat("p_brand", F.lit("#"), "p_type").alias("pair"), F.col("p_retailprice").cast("double").alias("quotevolume24h"))
    ignored = parts.where("p_brand = 'Brand#11'").select(F.concat("p_brand", F.lit("#")).alias("base")).distinct()
    out = M.screen_market(tickers, ["ECONOMY", "STANDARD", "PROMO"], "ECONOMY", 950.0, ignored)
    return out.select("p_partkey", "base", "quote", "quotevolume24h")


def _balances(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_nationkey").alias("account"), F.col("c_mktsegment").alias("coin"), F.col("c_acctbal").cast("double").alias("free"), F.lit(1.0).alias("locked"),
        F.lit(0.5).alias("borrowed"), (F.col("c_acctbal").cast("double") - 10).alias("available"), F.lit(2.0).alias("price"),
    )


@query("m7_portfolio_total", "SELECT c_nationkey AS account, sum(c_acctbal::DOUBLE) AS total, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal::DOUBLE + 0.5 ELSE 0 END) AS quote_value FROM customer GROUP BY ALL", "total quote_value")
def _(spark, d):
    b = _balances(spark, d)
    return M.portfolio_total(b.withColumn("value", F.col("free"))).join(M.quote_value(b, "BUILDING"), "account")


@query(
    "m11_net_positions",
    """SELECT l_suppkey AS coin, sum(CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'N' AND l_linenumber = 1) THEN 0 ELSE l_quantity::DOUBLE END) AS long,
    sum(CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'N' AND l_linenumber = 1) THEN l_quantity::DOUBLE ELSE 0 END) AS short FROM lineitem GROUP BY ALL""",
    "long short",
)
def _(spark, d):
    items, q = table(spark, d, "lineitem"), F.col("l_quantity").cast("double")
    side = F.when(F.col("l_returnflag") == "R", "Sell").when(F.col("l_returnflag") == "A", "Buy")
    size = F.when(F.col("l_linenumber") == 1, -q).otherwise(q)
    return M.net_positions(items.select(F.col("l_suppkey").alias("coin"), side.alias("side"), size.alias("size")))


@query(
    "m12_account_capacity",
    """WITH a AS (SELECT c_nationkey AS account, sum((c_acctbal::DOUBLE + 0.5) * 2) AS equity, coalesce(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal::DOUBLE - 10 END), 0) AS fq FROM customer GROUP BY ALL)
    SELECT account, equity, greatest(fq, 0) AS freequote, greatest(least(fq, equity), 0) AS long_capacity, greatest(least(fq * 3, equity * 3), 0) AS short_capacity FROM a""",
    "equity freequote long_capacity short_capacity",
)
def _(spark, d):
    return M.account_capacity(_balances(spark, d), "BUILDING", 3.0)


@query(
    "m8_sync_trades_rows",
    f"""{HOURS}, p AS (SELECT *, CASE WHEN (rn // 10) % 2 = 0 THEN 1 ELSE 0 END AS position FROM bars), n AS (SELECT *, (position IS DISTINCT FROM lag(position) OVER ({W}))::INT AS fresh FROM p),
    i AS (SELECT *, sum(fresh) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM n), o AS (SELECT *, min(opentime) OVER (PARTITION BY symbol, island) AS opened FROM i)
    SELECT symbol, opentime, close, position::DOUBLE AS position, CASE WHEN position > 0 THEN opened END AS lastopentrade FROM o QUALIFY rn = max(rn) OVER (PARTITION BY symbol)""",
    "close position",
)
def _(spark, d):
    df = number_rows(hours(spark, d))
    balances = df.select("symbol", "opentime", F.when(F.floor(F.col("rn") / 10) % 2 == 0, 1.0).otherwise(0.0).alias("position"))
    orders = df.select("symbol", F.when(F.col("rn") % 2 == 0, "lo").otherwise("lc").alias("lane"), F.lit("submitted").alias("status"), F.col("close").alias("limitprice"))
    return M.sync_trades_rows(df, orders, balances).select("symbol", "opentime", "close", "position", "lastopentrade")


@query("m9_collect_trades", f"{HOURS} SELECT symbol AS coin, opentime, 'train' AS set, 1 AS rangeid, close, CASE WHEN symbol < 'd' THEN high END AS extra FROM bars", "close extra")
def _(spark, d):
    df = hours(spark, d).select(F.col("symbol").alias("coin"), "opentime", F.lit("train").alias("set"), F.lit(1).alias("rangeid"), "close", F.col("high").alias("extra"))
    return M.collect_trades([df.where("coin < 'd'"), df.where("coin >= 'd'").drop("extra")])


@query("m10_trades_schema", f"{HOURS} SELECT symbol, opentime, CASE WHEN rn % 2 = 0 THEN close ELSE 0 END AS lo, 'ignore' AS label, 0.0::DOUBLE AS position FROM bars", "lo position")
def _(spark, d):
    df = number_rows(hours(spark, d)).select("symbol", "opentime", F.when(F.col("rn") % 2 == 0, F.col("close")).alias("lo"))
    return M.trades_schema(df).select("symbol", "opentime", "lo", "label", "position")
