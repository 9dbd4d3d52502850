"""Evaluation of predictions, bounds and trades."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.joins import asof_join
from tickloom.operators.windows import KEY, TIME, number_rows, ordered


def confusion_matrix(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per set and predicted label: rows of each true label (column target), total, hits and their percent."""
    counts = [F.count_if(F.col("target") == x).alias(f"true_{x}") for x in labels]
    out = df.groupBy("set", "label").agg(*counts, F.count("*").alias("total"), F.count_if(F.col("label") == F.col("target")).alias("hits"))
    return out.withColumn("ppv", F.round(100.0 * F.col("hits") / F.col("total"), 2))


def confusion_matrix_pct(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    out = confusion_matrix(df, labels)
    return out.select("set", "label", "total", *[F.round(100.0 * F.col(f"true_{x}") / F.col("total"), 2).alias(f"pct_{x}") for x in labels])


def binned_confusion(df: DataFrame, bins: int) -> DataFrame:
    """Per set, label and score bin: tp and fp at or above the bin, fn and tn below it (true and false ones among the
    scores below), and shares of these. Bins without scores are there as well: the grid is small by construction."""
    hit = (F.col("label") == F.col("target")).cast("bigint")
    b = F.least(F.greatest(F.floor(F.col("score") * bins) + 1, F.lit(1)), F.lit(bins)).cast("int")
    counts = df.groupBy("set", "label", b.alias("bin")).agg(F.sum(hit).alias("t"), F.sum(1 - hit).alias("f"))
    grid = df.select("set", "label").distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    full = grid.join(counts, ["set", "label", "bin"], "left").fillna(0, ["t", "f"])
    w = Window.partitionBy("set", "label").orderBy("bin")
    above, below = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    out = full.select(
        "set", "label", "bin", F.sum("t").over(above).alias("tp"), F.sum("f").over(above).alias("fp"),
        F.coalesce(F.sum("t").over(below), F.lit(0)).alias("fn"), F.coalesce(F.sum("f").over(below), F.lit(0)).alias("tn"),
    )
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.round(F.col(a) / (F.col(a) + F.col(b)), 6))
    return out.select("*", share("tp", "fn").alias("tpr"), share("fp", "tn").alias("fpr"), share("tp", "fp").alias("ppv"), share("tn", "fn").alias("npv"))


def roc_curve(df: DataFrame, score: str, truth: str, by: str = "set", steps: int = 1000) -> DataFrame:
    """Points of the curve: threshold, tpr, fpr. Scores are rounded to 1 / steps, so the curve is small for any input."""
    counts = df.withColumn("threshold", F.round(F.floor(F.col(score) * steps) / steps, 6)).groupBy(by, "threshold").agg(
        F.count_if(F.col(truth)).alias("t"), F.count_if(~F.col(truth)).alias("f")
    )
    w = Window.partitionBy(by)
    down = w.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    rate = lambda c: F.when(F.sum(c).over(w) > 0, F.sum(c).over(down) / F.sum(c).over(w)).otherwise(0.0)
    return counts.select(by, "threshold", rate("t").alias("tpr"), rate("f").alias("fpr"))


def auc(df: DataFrame, score: str, truth: str, by: str = "set") -> DataFrame:
    """Chance that a true row scores above a false one (ties half), from counts by score; 0 with one class only."""
    counts = df.groupBy(by, score).agg(F.count_if(F.col(truth)).alias("t"), F.count_if(~F.col(truth)).alias("f"))
    below = Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("wins", F.col("t") * (F.coalesce(F.sum("f").over(below), F.lit(0)) + F.col("f") / 2))
    out = counts.groupBy(by).agg(F.sum("wins").alias("w"), F.sum("t").alias("t"), F.sum("f").alias("f"))
    return out.select(by, F.when(F.col("t") * F.col("f") > 0, F.col("w") / (F.col("t") * F.col("f"))).otherwise(0.0).alias("auc"))


def prediction_trades(df: DataFrame, open_threshold: float, close_threshold: float) -> DataFrame:
    """Trades of best labels: opened by an open label over its threshold, closed by one of the other side or a close over
    its own, or at the end of the set; gain in percent. One pass over each symbol and set."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME).reset_index(drop=True)
        out, start = [], None
        side = 0
        for i, r in enumerate(pdf.itertuples()):
            want = {"longopen": 1, "shortopen": -1}.get(r.label, 0) if r.score >= open_threshold else 0
            ends = side and ((want and want != side) or (r.label in ("allclose", "longclose", "shortclose") and r.score >= close_threshold))
            if side and (ends or i == len(pdf) - 1):
                a = pdf.iloc[start]
                out.append((a[KEY], a["set"], "long" if side > 0 else "short", a[TIME], r.opentime, 100 * side * (r.pivot - a.pivot) / a.pivot))
                side = 0
            if want and not side and i < len(pdf) - 1:
                side, start = want, i
        return pd.DataFrame(out, columns=[KEY, "set", "trend", "opened", "closed", "gain"])

    return df.groupBy(KEY, "set").applyInPandas(walk, f"{KEY} string, set string, trend string, opened timestamp_ntz, closed timestamp_ntz, gain double")


def trade_performance(trades: DataFrame) -> DataFrame:
    """Sum, count and mean gain by set and trend, and a total row (trend null) for each set."""
    grouped = trades.groupingSets([[F.col("set"), F.col("trend")], [F.col("set")]], F.col("set"), F.col("trend"))
    return grouped.agg(F.sum("gain").alias("sum_gain"), F.count("*").alias("n"), F.avg("gain").alias("mean_gain"))


def gain_summary(gains: DataFrame) -> DataFrame:
    return gains.groupBy("set", "trend", "predicted").agg(
        F.avg("gain").alias("mean_gain"), F.avg("samplecount").alias("mean_samples"), F.count("*").alias("n"),
        F.sum("gain").alias("sum_gain"), F.sum("gainfee").alias("sum_gainfee"),
    )


def segment_distances(gains: DataFrame) -> DataFrame:
    """For each predicted segment the first true one of its coin and trend that ends at or after its start: minutes to
    the true start and end, whether they overlap, and minutes to the next predicted segment."""
    key = F.concat_ws("|", "coin", "trend")
    predicted = gains.where("predicted").withColumn("_k", key).withColumn("_t", F.col("startdt"))
    true = gains.where("not predicted").select(key.alias("_k"), F.col("enddt").alias("_t"), F.col("startdt").alias("true_start"), F.col("enddt").alias("true_end"))
    # Of several true segments with the same end, the earliest start.
    true = true.groupBy("_k", "_t", "true_end").agg(F.min("true_start").alias("true_start"))
    joined = asof_join(predicted, true, on="_t", by="_k", forward=True, suffix="_r")
    after = F.lead("startdt").over(Window.partitionBy("coin", "trend").orderBy("startdt", "enddt"))
    minutes = lambda a, b: F.timestamp_diff("MINUTE", a, b)
    return joined.withColumn("next_minutes", minutes(F.col("enddt"), after)).select(
        "coin", "trend", "startdt", "enddt", "next_minutes",
        minutes(F.col("startdt"), F.col("true_start_r")).alias("start_minutes"), minutes(F.col("enddt"), F.col("true_end_r")).alias("end_minutes"),
        (F.col("true_start_r") <= F.col("enddt")).alias("true_positive"),
    )


def first_hits(df: DataFrame, w: int, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """late_hits(), and upper_hit and lower_hit: the same within the next w rows, else null."""
    rows = late_hits(df, keys)
    return rows.withColumns({f"{s}_hit": F.when(F.col(f"{s}_late") <= w, F.col(f"{s}_late")) for s in ("upper", "lower")})


def late_hits(df: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Rows until the bounds are first reached at any later row of the keys (symbol, or symbol and range); null if never.

    Rows wait on a heap of unreached bounds, so each symbol (and range) is one pass over its rows.
    """

    def until(bound: np.ndarray, price: np.ndarray) -> np.ndarray:
        import heapq

        out = np.full(len(bound), np.nan)
        waiting: list[tuple[float, int]] = []
        for i, p in enumerate(price):
            while waiting and waiting[0][0] <= p:
                _, k = heapq.heappop(waiting)
                out[k] = i - k
            heapq.heappush(waiting, (float(bound[i]), i))
        return out

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME).reset_index(drop=True)
        return pdf.assign(
            upper_late=pd.array(until(pdf["upper"].to_numpy(), pdf["high"].to_numpy()), "Float64").astype("Int64"),
            lower_late=pd.array(until(-pdf["lower"].to_numpy(), -pdf["low"].to_numpy()), "Float64").astype("Int64"),
        )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(*keys).applyInPandas(walk, f"{kinds}, upper_late bigint, lower_late bigint")


def bounds_quality(df: DataFrame, w: int, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Per set: mean absolute errors of centre and width, percent of rows whose bounds are reached in the next w rows, and
    only later, mean rows until then, and mean distance of the close to the bounds in percent."""
    rows = first_hits(df, w, keys)
    pct = lambda c: F.round(100.0 * F.avg(F.col(c).isNotNull().cast("double")), 4)
    late = lambda s: F.when(F.col(f"{s}_hit").isNull(), F.col(f"{s}_late"))
    rows = rows.withColumn("_up", late("upper")).withColumn("_low", late("lower"))
    return rows.groupBy("set").agg(
        F.round(F.avg(F.abs(F.col("centerpred") - F.col("centertarget"))), 6).alias("mae_center"),
        F.round(F.avg(F.abs(F.col("widthpred") - F.col("widthtarget"))), 6).alias("mae_width"),
        pct("upper_hit").alias("upper_pct"), pct("lower_hit").alias("lower_pct"),
        F.round(F.avg("upper_hit"), 6).alias("upper_rows"), F.round(F.avg("lower_hit"), 6).alias("lower_rows"),
        pct("_up").alias("upper_late_pct"), pct("_low").alias("lower_late_pct"),
        F.round(F.avg("_up"), 6).alias("upper_late_rows"), F.round(F.avg("_low"), 6).alias("lower_late_rows"),
        F.round(F.avg(100.0 * (F.col("upper") - F.col("close")) / F.col("close")), 6).alias("upper_dist_pct"),
        F.round(F.avg(100.0 * (F.col("close") - F.col("lower")) / F.col("close")), 6).alias("lower_dist_pct"),
    )


def bound_status(df: DataFrame, w: int, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Per row and side: within (reached in the next w rows), opposite (only the other bound is), late or pending, with
    the rows until then."""
    rows = first_hits(df, w, keys)

    def status(side: str, other: str) -> Column:
        return (
            F.when(F.col(f"{side}_hit").isNotNull(), "within").when(F.col(f"{other}_hit").isNotNull(), "opposite")
            .when(F.col(f"{side}_late").isNotNull(), "late").otherwise("pending")
        )

    sides = [F.struct(F.lit(s).alias("side"), status(s, o).alias("status"), F.col(f"{s}_late").alias("delay"))
             for s, o in (("upper", "lower"), ("lower", "upper"))]
    return rows.select(KEY, TIME, F.explode(F.array(*sides)).alias("s")).select(KEY, TIME, "s.side", "s.status", "s.delay")


def duplicate_segments(gains: DataFrame, keys: Sequence[str]) -> DataFrame:
    return gains.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_coins(gains: DataFrame, coins: DataFrame) -> DataFrame:
    return coins.join(gains.select("coin"), "coin", "left_anti")


def kpi_overview(trades: DataFrame, by: Sequence[str] = ("coin", "cfgid")) -> DataFrame:
    return trades.groupBy(*by).agg(
        F.avg("gain").alias("mean_gain"), F.median("gain").alias("median_gain"), F.sum("gain").alias("sum_gain"), F.min("gain").alias("min_gain"),
        F.max("gain").alias("max_gain"), F.count("*").alias("n"), F.avg("minutes").alias("mean_minutes"), F.count_if(F.col("trend") == "up").alias("n_long"),
    )


def cumulative_gain_range(trades: DataFrame, order: str = "closeix", by: str = "coin") -> DataFrame:
    """Highest and lowest running gain, not below and not above 0."""
    run = F.sum("gain").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = trades.withColumn("_run", run).groupBy(by).agg(F.max("_run").alias("a"), F.min("_run").alias("b"))
    return out.select(by, F.greatest("a", F.lit(0.0)).alias("max_cumulative"), F.least("b", F.lit(0.0)).alias("min_cumulative"))


def describe_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per symbol: rows, whether times ascend, and mean, least and largest value of the columns."""
    rows = number_rows(df).withColumn("_up", F.coalesce(F.col(TIME) > F.lag(TIME).over(ordered()), F.lit(True)))
    aggregates = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return rows.groupBy(KEY).agg(F.count("*").alias("n"), F.min("_up").alias("ascending"), *aggregates)


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("side", "status").agg(F.count("*").alias("n"))
