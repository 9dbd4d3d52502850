"""Results fixed by examples: small inputs with known outputs."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalar
from tickloom.operators import bars as B
from tickloom.operators import dataset as C
from tickloom.operators import evaluate as E
from tickloom.operators import extremes as X
from tickloom.operators import features as G
from tickloom.operators import joins as J
from tickloom.operators import market as M
from tickloom.operators import replay as P
from tickloom.operators import rules as R
from tickloom.operators import targets as T
from tickloom.operators import windows as W
from tickloom.sources import bars as S

START = dt.datetime(2022, 1, 2, 22, 54)


def series(spark, close, symbol="A", start=START, minutes=1, volume=None, high=None, low=None):
    rows = []
    for i, c in enumerate(close):
        h, lo = (high[i] if high else c), (low[i] if low else c)
        rows.append((symbol, start + dt.timedelta(minutes=i * minutes), float(c), float(h), float(lo), float(c), float(volume[i] if volume else 1), float(c)))
    kinds = "symbol string, opentime timestamp_ntz, open double, high double, low double, close double, basevolume double, pivot double"
    return spark.createDataFrame(rows, kinds)


def column(df, name, by="opentime"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_volume_segments(spark):
    volume = [2, 4, 4, 4, 2, 4, 4, 4, 4, 2]
    out = B.volume_segments(series(spark, [2] * 10, volume=volume), 16, 5, 14, 2).orderBy("start_rn").collect()
    rolling = [sum(volume[max(0, i - 4) : i + 1]) for i in range(10)]
    assert [r["start_rn"] for r in out] == [1] and rolling[4] == 16
    two = B.volume_segments(series(spark, [2] * 10, volume=volume), 12, 3, 10, 2).orderBy("start_rn").collect()
    assert [(r["start_rn"], r["end_rn"]) for r in two] == [(2, 4), (6, 9)]


def test_resample_keeps_an_incomplete_first_bucket(spark):
    out = B.resample(series(spark, range(1, 10)), 5).orderBy("opentime").collect()
    assert [r["opentime"].minute for r in out] == [50, 55, 0]
    assert [(r["open"], r["close"], r["basevolume"]) for r in out] == [(1, 1, 1), (2, 6, 5), (7, 9, 3)]
    assert len(B.resample(series(spark, range(1, 10)), 3).collect()) == 3


@pytest.mark.parametrize(("offset", "rows"), [(-3, 6), (-4, 7), (-5, 8), (2, 7), (3, 8)])
def test_merge_lengths(spark, offset, rows):
    a = series(spark, [1, 1, 1])
    b = series(spark, [2] * 5, start=START + dt.timedelta(minutes=offset))
    out = B.merge_bars(a, b)
    assert out.count() == rows and out.where("close = 2").count() == 5
    assert B.merge_gaps(a, b).count() == 0
    assert B.merge_gaps(a, series(spark, [2], start=START + dt.timedelta(minutes=9))).first()["gap"] == 7


def test_merge_inside_by_policy(spark):
    a, b = series(spark, [1] * 6), series(spark, [2, 2], start=START + dt.timedelta(minutes=2))
    assert B.merge_bars(a, b).where("close = 2").count() == 2
    assert B.merge_bars(a, b, "keep_inside").where("close = 2").count() == 0


def test_nearest_row(spark):
    right = series(spark, range(9)).select("symbol", "opentime", "close")
    left = spark.createDataFrame([("A", START + dt.timedelta(seconds=s)) for s in (-100, 10, 130, 9000)], "symbol string, opentime timestamp_ntz")
    assert column(J.nearest_row(left, right), "close_r") == [0, 0, 2, 8]


def test_rolling_regression_and_deviation(spark):
    y = [2.9, 3.1, 3.6, 3.8, 4, 4.1, 5]
    out = G.rolling_regression(series(spark, y), "pivot", [7, 3], ["pivot"]).orderBy("opentime").collect()
    assert abs(out[-1]["grad_7"] - 0.310714) < 1e-6 and abs(out[-1]["regry_7"] - 4.717857) < 1e-6
    assert out[0]["regry_7"] == y[0] and out[0]["grad_7"] == 0 and out[0]["std_7"] == 0
    for i in range(1, 7):
        part = np.array(y[max(0, i - 2) : i + 1])
        slope, base = np.polyfit(np.arange(len(part)), part, 1)
        residual = part - (base + slope * np.arange(len(part)))
        assert abs(out[i]["grad_3"] - slope) < 1e-9 and abs(out[i]["std_3"] - statistics.stdev(residual)) < 1e-9


def test_long_windows_keep_their_digits(spark):
    rng = np.random.default_rng(5)
    y = 100_000 + np.cumsum(rng.normal(0, 5, 3000))
    out = G.rolling_regression(series(spark, y.tolist()), "pivot", [1440], ["pivot"]).orderBy("opentime").collect()
    for i in (1500, 2222, 2999):
        part = y[i - 1439 : i + 1]
        slope, base = np.polyfit(np.arange(1440), part - part.mean(), 1)
        assert abs(out[i]["grad_1440"] - slope) < 1e-8
        residual = part - part.mean() - base - slope * np.arange(1440)
        assert abs(out[i]["std_1440"] - residual.std(ddof=1)) < 1e-6


def test_rolling_extremes(spark):
    up = series(spark, range(2, 12))
    assert column(W.with_sliding_extreme(up, "close", 3, "x", True), "x") == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert column(W.with_sliding_extreme(up, "close", 3, "x", False), "x") == [2, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    values = [random.Random(3).random() for _ in range(200)]
    out = column(W.with_sliding_extreme(series(spark, values), "close", 40, "x", True), "x")
    assert out == [max(values[max(0, i - 39) : i + 1]) for i in range(200)]


def test_relative_volume(spark):
    out = column(G.relative_volume(series(spark, [1] * 7, volume=range(7)), 2, 3), "rv_2_3")
    medians = [(statistics.median(range(max(0, i - 1), i + 1)), statistics.median(range(max(0, i - 2), i + 1))) for i in range(7)]
    assert out == pytest.approx([a / (b or G.EPS) for a, b in medians])
    with pytest.raises(Exception, match="negative volume"):
        G.relative_volume(series(spark, [1, 1], volume=[1, -1]), 2, 3).collect()


def test_lookback(spark):
    df = series(spark, [1, 2, 3, 4])
    assert column(G.lookback(df, "close", 2), "close02") == [1, 1, 1, 2]
    assert column(G.lookback(df, "close", 2, 9.0), "close02") == [9, 9, 1, 2]


def test_amplitude_extremes():
    high, low = [100.0, 100.4, 100.7, 100.5, 100.4], [99.8, 100.0, 100.2, 100.1, 100.0]
    assert X.backward_extremes(high, low, 0.006, 8) == [3, -1]
    assert X.backward_extremes(high, low, 0.010, 8) == []


def test_zigzag_finds_the_peaks_of_a_sine():
    price = np.array([2 + 0.5 * math.sin(2 * math.pi * i / 20) for i in range(80)])
    peak = X.zigzag(price, 0.2, -0.2)
    assert sorted(set(peak.tolist()) - {-1}) == [5, 15, 25, 35, 45, 55, 65, 75, 79]  # the last rise suffices
    assert peak[4] == 5 and peak[5] == 15 and peak[79] == -1
    assert (X.zigzag(np.ones(9), 0.1, -0.1) == -1).all()


def test_best_path_takes_the_larger_gains():
    price = np.array([1.0, 1.5, 1.2, 2.0, 1.0, 3.0])
    t = T.Thresholds(longopen=0.1, shortopen=-0.1)
    fine, coarse = [-1, 2, -3, 4, -5, 6], [-1, 4, -5, 6]
    assert X.best_path(price, {5: fine, 15: coarse}, t) == fine
    assert X.best_path(price, {15: coarse}, t) == coarse
    high = T.Thresholds(longopen=0.6, shortopen=-0.45)
    assert X.best_path(price, {5: fine, 15: coarse}, high)[-4:] == [-1, 4, -5, 6]


def test_rows_follow_the_best_path(spark):
    # Prices, gradients of two windows and the peak that each row refers to.
    price = [1, 1.2, 1, 1.29, 1.1, 1.1, 0.8, 0.9, 1, 1.1, 1, 1.31, 1, 1.2, 0.91, 1.182, 1, 1.1, 1.2, 1.3]
    short = [0.2, 0.2, 0.2, 0.1, 0.05, -0.1, -0.2, -0.2, -0.1, 0, 0.1, 0.1, 0.1, 0.2, -0.1, -0.2, -0.2, 0.2, 0.2, 0]
    long = [0.2, 0.1, -0.1, -0.1, 0, 0.1, -0.2, 0.2, -0.1, -0.2, 0.1, 0.1, -0.1, -0.2, -0.1, 0.2, -0.2, 0.2, -0.2, 0]
    want = [2, 3, 4, 7, 7, 7, 12, 12, 12, 12, 12, 15, 15, 15, 20, 20, 20, 20, 20, 20]
    rows = [("A", START + dt.timedelta(minutes=i), float(p), float(a), float(b)) for i, (p, a, b) in enumerate(zip(price, short, long, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, opentime timestamp_ntz, pivot double, grad_5 double, grad_10 double")
    t = T.Thresholds(longopen=0.3, longhold=0.05, shorthold=-0.05, shortopen=-0.3)
    paths = X.best_peak_path(df, X.windows_peaks(df, [5, 10]), t)
    assert paths.first()["path"] == [2, -3, 4, -7, 12, -15, 20]
    assert column(X.peak_labels(df.select("symbol", "opentime", "pivot"), paths, t), "peak_rn") == want


def test_trend_regression_target(spark):
    up = T.trend_regression_target(series(spark, [100, 105, 110, 115, 120]), 3, 0.04, -0.04)
    assert column(up, "label") == ["longopen"] * 4 + ["allclose"] and column(up, "gain")[-1] == 0
    down = T.trend_regression_target(series(spark, [120, 115, 110, 105, 100]), 3, 0.04, -0.04)
    assert column(down, "label") == ["shortopen"] * 4 + ["allclose"]


def test_trend_phase(spark):
    labels = ["longopen", "longhold", "longhold", "longopen", "longhold", "allclose", "shortopen", "shorthold", "shorthold", "shortopen"]
    df = series(spark, range(1, 11)).withColumn("label", F.element_at(F.array(*map(F.lit, labels)), F.minute("opentime") - 53 + F.when(F.minute("opentime") < 50, 60).otherwise(0)))
    assert column(df.withColumn("p", T.trend_phase(F.col("label"))), "p") == ["up"] * 5 + ["flat"] + ["down"] * 4


@pytest.mark.parametrize("mode", ["within_maxwindow", "beyond_maxwindow", "no_hold"])
@pytest.mark.parametrize("anchor", ["last_buy_anchor", "entry_anchor"])
def test_trend_labels_pass_their_check(spark, mode, anchor):
    t = T.Thresholds(longopen=0.03, longhold=0.01, shorthold=-0.01, shortopen=-0.03)
    sine = S.sine_bars(spark, 200, 50)
    out = T.trend_labels(sine, 4, 60, t, anchor, mode)
    found = {r["label"] for r in out.select("label").distinct().collect()}
    assert {"longopen", "shortopen"} <= found
    assert T.check_trend_labels(out, t, 4).count() == 0
    rng = np.random.default_rng(4)
    walk = T.trend_labels(series(spark, (100 * np.exp(np.cumsum(rng.normal(0, 0.01, 400)))).tolist()), 4, 60, t, anchor, mode)
    assert T.check_trend_labels(walk, t, 4).count() == 0
    assert T.trend_relative_gain(walk).count() == 400
    assert walk.where("label = 'longopen' and rn = relix").count() > 0


def walked(prices, low, high, thresholds, anchor="last_buy_anchor", mode="within_maxwindow"):
    w = T.TrendWalk(np.array(prices, float), low, high, T.Thresholds(*thresholds), anchor, mode)
    w.run()
    return w.label.tolist(), (w.at + 1).tolist()


def test_trend_holds_are_measured_from_their_anchor():
    prices = [100.0, 104.031, 99.91, 105.402, 106.31, 108.852, 107.052, 106.409, 107.576]
    for anchor, sixth in (("entry_anchor", 0), ("last_buy_anchor", 2)):
        label, _ = walked(prices, 1, 5, (0.04, 0.02, -0.01, -0.04), anchor)
        assert (label[2], label[5]) == (2, sixth)
    prices = [100.0, 99.886, 98.557, 97.65, 101.708, 104.445, 107.335]
    for mode, last in (("within_maxwindow", 0), ("beyond_maxwindow", 2), ("no_hold", 0)):
        label, at = walked(prices, 2, 3, (0.06, 0.02, -0.01, -0.06), mode=mode)
        assert label[6] == last and (not last or at[6] == 6)  # a hold refers to the open row


def test_trend_cases():
    t = (0.025, 0.01, -0.01, -0.025)
    assert walked([100.0, 103.0, 105.0, 106.0, 106.5], 2, 10, t)[0] == [1] * 5
    assert walked([106.0, 103.0, 101.0, 100.0, 99.5], 2, 10, t)[0] == [-1] * 5
    label, at = walked([100.0, 95.0, 100.0, 106.0, 112.0], 2, 10, (0.03, 0.005, -0.005, -0.03))
    assert label == [0, 1, 1, 1, 1] and at[1] == 2  # from the local low
    label, _ = walked([4631.0, 4632.0, 4610.0, 4590.0, 4558.94, 4558.94], 2, 10, (0.01, 0.005, -0.005, -0.01))
    assert -2 not in label or -1 in label
    label, _ = walked([3819.6, 3816.3, 3890.0, 3890.0, 3885.0, 3850.0, 3804.8, 3779.2, 3754.7, 3754.7, 3751.4, 3758.0, 3758.0, 3830.7], 10, 240, (0.03, 0.005, -0.005, -0.03))
    assert -1 not in label  # no ten rows from a high to a low


def test_trend_labels_equal_a_plain_walk():
    """The same rules row by row, without views of the arrays."""
    rng = np.random.default_rng(8)
    for anchor, mode in (("last_buy_anchor", "within_maxwindow"), ("last_buy_anchor", "beyond_maxwindow"), ("entry_anchor", "within_maxwindow")):
        prices = (100 * np.exp(np.cumsum(rng.normal(0, 0.02, 250)))).round(2).tolist()
        assert walked(prices, 3, 20, (0.05, 0.02, -0.02, -0.05), anchor, mode) == plain_trend(prices, 3, 20, (0.05, 0.02, -0.02, -0.05), anchor, mode)


def plain_trend(p, low, high, t, anchor_mode, mode):
    n, far, near = len(p), {1: t[0], -1: -t[3]}, {1: t[1], -1: -t[2]}
    label, at = [0] * n, list(range(n))
    rise = lambda a, e, s: s * (p[e] - p[a]) / p[a]
    top = lambda a, e, s: all(s * p[e] >= s * x for x in p[a : e + 1])
    bottom = lambda a, e, s: all(s * p[a] <= s * x for x in p[a : e + 1])
    segment = lambda a, e, s: low <= e - a + 1 <= high and rise(a, e, s) >= far[s] and bottom(a, e, s) and top(a, e, s)
    held = lambda a, e, s: low <= e - a + 1 and (e - a + 1 <= high or mode == "beyond_maxwindow") and rise(a, e, s) >= near[s] and top(a, e, s)

    def give(e, first, lab, ref):
        same = label[e - 1] == lab and at[e - 1] == ref
        for k in [e] if same else range(first, e + 1):
            label[k], at[k] = lab, ref

    for e in range(1, n):
        closed, i = [], e - 1
        while i >= max(0, e - high + 1) and not label[i]:
            if e - i + 1 >= low:
                closed.append(i)
            i -= 1
        if i >= max(0, e - high + 1):
            s = 1 if label[i] > 0 else -1
            is_open = abs(label[i]) == 1
            opened = i if is_open else at[i]
            a = at[i] if is_open or anchor_mode != "entry_anchor" else at[at[i]]
            hold = lambda: give(e, max(opened + (label[opened] != 2 * s), e - high + 1), 2 * s, opened)  # noqa: B023, E731
            trim_to = None
            if rise(i, e, s) < 0:
                m = max(range(opened, e + 1), key=lambda k: (s * p[k], -k))  # noqa: B023
                if held(a, e, s):
                    hold()
                elif e - m + 1 >= low and rise(m, e, -s) >= far[-s] and top(m, e, -s):
                    trim_to = m - 1
            elif is_open and segment(a, e, s):
                give(e, a, s, a)
            elif not is_open and segment(a, e, s) and segment(m := min(range(i, e + 1), key=lambda k: (s * p[k], k)), e, s):  # noqa: B023
                give(e, m, s, m)
            elif held(a, e, s):
                hold()
            else:
                trim_to = e - 1 if is_open else None
                give(e, i + 1, 0, i + 1)
            if trim_to is not None:
                good = [k for k in range(a, trim_to + 1) if segment(a, k, s)]
                for k in range(good[-1] + 1 if good else a, trim_to + 1):
                    if label[k] * s > 0:
                        label[k], at[k] = 0, good[-1] if good else a
                if rise(i, e, s) < 0:
                    give(e, m, -s, m)
                else:
                    give(e, i + 1, 0, i + 1)
        if not label[e]:
            at[e] = closed[-1] if closed else e
            best = {}
            for s in (1, -1):
                k = max(closed, key=lambda k: (rise(k, e, s), k), default=e)  # noqa: B023
                if k < e and rise(k, e, s) > 0 and rise(k, e, s) >= far[s] and bottom(k, e, s):
                    best[s] = k
            s = 1 if 1 in best and (-1 not in best or rise(best[1], e, 1) >= rise(best[-1], e, -1)) else -1
            if s in best and top(best[s], e, s):
                give(e, best[s], s, best[s])
    return label, [x + 1 for x in at]


def test_trend_check_finds_faults(spark):
    t = T.Thresholds(longopen=0.03, longhold=0.01, shorthold=-0.01, shortopen=-0.03)
    df = series(spark, [100, 101, 100, 101, 100, 101]).withColumn("rn", F.row_number().over(W.ordered())).withColumn("relix", F.lit(1))
    assert T.check_trend_labels(df.withColumn("label", F.lit("longopen")), t, 3).first()["issue"] == "threshold"
    assert T.check_trend_labels(df.withColumn("label", F.lit("longhold")), t, 3).first()["issue"] == "hold_without_open"
    assert T.check_trend_labels(df.withColumn("label", F.lit("odd")), t, 3).first()["issue"] == "unknown_label"


SETS = ["train", "test", "train", "eval", "train"]


@pytest.mark.parametrize(
    ("n", "size", "least", "most", "want"),
    [
        (21, 2, 2, 2, [("train", 1, 2), ("test", 4, 5), ("train", 7, 8), ("eval", 10, 11), ("train", 13, 16), ("test", 18, 19), ("train", 21, 21)]),
        (38, 3, 1, 6, [("train", 1, 3), ("test", 5, 7), ("train", 9, 11), ("eval", 13, 15), ("train", 17, 22), ("test", 24, 26), ("train", 28, 30), ("eval", 32, 34), ("train", 36, 38)]),
        (45, 3, 1, 6, [("train", 1, 4), ("test", 6, 9), ("train", 11, 14), ("eval", 16, 19), ("train", 21, 28), ("test", 30, 33), ("train", 35, 38), ("eval", 40, 43), ("train", 45, 45)]),
        (37, 3, 1, 6, [("train", 1, 6), ("test", 8, 13), ("train", 15, 20), ("eval", 22, 27), ("train", 29, 37)]),
        (18, 3, 1, 6, [("train", 1, 3), ("test", 5, 7), ("train", 9, 11), ("eval", 13, 15), ("train", 17, 18)]),
        (14, 3, 1, 6, []),
    ],
)
def test_partition_plans(n, size, least, most, want):
    assert C.partition_plan(n, SETS, size, 1, least, most) == want


def test_older_partition_plan():
    out = C.shared_plan(49, [("base", 1 / 3), ("test", 1 / 6), ("combi", 1 / 3), ("eval", 1 / 6)], 3 / 50, 1)
    by = {}
    for name, a, b in out:
        by.setdefault(name, []).append((a, b))
    assert by == {"base": [(1, 5), (19, 23), (37, 41)], "test": [(7, 8), (25, 26), (43, 44)], "combi": [(10, 14), (28, 32), (46, 49)], "eval": [(16, 17), (34, 35)]}


def test_bounds_quality(spark):
    df = series(spark, [100, 100, 100, 110, 102], high=[100, 106, 103, 104, 106], low=[100, 100, 96, 96, 94])
    df = df.withColumn("set", F.when(F.col("opentime") < F.lit(START + dt.timedelta(minutes=3)).cast("timestamp_ntz"), "train").otherwise("test"))
    for c, v in (("centerpred", 0.0), ("centertarget", 0.0), ("widthpred", 0.1), ("widthtarget", 0.1), ("upper", 105.0), ("lower", 95.0)):
        df = df.withColumn(c, F.lit(v))
    out = {r["set"]: r for r in E.bounds_quality(df, 2).collect()}
    assert out["train"]["mae_center"] == 0 and round(out["train"]["upper_pct"], 2) == 66.67 and out["train"]["upper_rows"] == 1.5
    assert round(out["train"]["lower_pct"], 2) == 33.33 and out["train"]["lower_rows"] == 2.0
    assert out["test"]["upper_pct"] == 50 and out["test"]["lower_pct"] == 50
    assert round(out["train"]["lower_late_pct"], 2) == 66.67 and out["train"]["lower_late_rows"] == 3.5 and out["train"]["upper_late_rows"] == 3.0
    halves = df.withColumn("rangeid", F.when(F.minute("opentime") == 57, 2).otherwise(1))
    assert E.bound_status(halves, 2, ("symbol", "rangeid")).where("status = 'pending' and side = 'upper'").count() > 0
    late = {(r["opentime"].minute, r["side"]): (r["status"], r["delay"]) for r in E.bound_status(df, 2).collect()}
    assert late[(54, "upper")] == ("within", 1) and late[(54, "lower")] == ("opposite", 4) and late[(55, "lower")] == ("late", 3)


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "label string")
    out = {r["label"]: r["weight"] for r in C.class_weights(df).distinct().collect()}
    assert out == {"a": pytest.approx(8 / 12), "b": pytest.approx(2.0)}


def test_market_snapshot(spark):
    df = series(spark, [100, 110], volume=[2, 3], minutes=60)
    r = M.market_snapshot(df, "2022-01-03 01:00:00").first()
    assert (r["quotevolume24h"], round(r["pricechangepercent"], 9), r["lastprice"]) == (530, 10, 110)


def test_ratios_reject_non_positive_pivots(spark):
    df = spark.createDataFrame([(11.0, 2.0, 10.0), (11.0, 2.0, 0.0)], "c double, w double, p double")
    c, w = scalar.ratio_targets(F.col("c"), F.col("w"), F.col("p"))
    assert [tuple(r) for r in df.select(c, w).collect()] == [(pytest.approx(0.1), pytest.approx(0.2)), (None, None)]


CFG = P.LimitConfig(openthreshold=0.5, buygain=0.01, sellgain=0.05, makerfee=0.001)


def replayed(spark, close, labels, high=None, low=None, score=1.0):
    df = series(spark, close, high=high, low=low)
    label = F.element_at(F.array(*map(F.lit, labels)), F.row_number().over(W.ordered()))
    df = df.withColumn("label", label).withColumn("score", F.lit(score)).withColumn("set", F.lit("test")).withColumn("rangeid", F.lit(1))
    return P.limit_reversal_replay(df, CFG).collect(), P.limit_reversal_rows(df, CFG).orderBy("opentime").collect(), df


def test_long_trade_opens_in_the_next_row_and_closes_at_its_limit(spark):
    gains, rows, df = replayed(spark, [100, 100, 104, 106, 106], ["longopen", "longhold", "longhold", "longhold", "longhold"], high=[100, 100, 104, 106, 106], low=[98, 100, 104, 106, 106])
    assert rows[0]["lo_limit"] == pytest.approx(99) and rows[0]["lp_amount"] == 0 and rows[1]["lp_amount"] == 100
    assert rows[1]["l_pavg"] == pytest.approx(99) and rows[0]["lc_limit"] == pytest.approx(105)
    (g,) = gains
    assert (g["trend"], g["startix"], g["endix"], g["samplecount"], g["minutes"]) == ("up", 2, 4, 3, 3)
    assert g["gain"] == pytest.approx((105 - 99) / 99) and g["gainfee"] == pytest.approx(g["gain"] - 0.002)
    assert P.check_trade_rows(P.limit_reversal_rows(df, CFG)).count() == 0


def test_short_trade_is_closed_in_the_last_row(spark):
    gains, rows, _ = replayed(spark, [100, 100, 98, 97], ["shortopen", "shorthold", "shorthold", "shorthold"], high=[102, 100, 98, 97], low=[100, 100, 98, 97])
    assert rows[1]["sp_amount"] == 100 and rows[-1]["sp_amount"] == 0
    (g,) = gains
    assert g["trend"] == "down" and g["gain"] == pytest.approx((101 - 97) / 101)


def test_low_scores_only_hold(spark):
    gains, rows, _ = replayed(spark, [100, 90, 100], ["longopen"] * 3, low=[80, 80, 80], score=0.1)
    assert not gains and rows[0]["label"] == "longhold" and rows[0]["lo_limit"] == 0


def test_reversal_closes_the_other_side_with_the_open(spark):
    gains, rows, _ = replayed(spark, [100, 100, 100, 100, 100], ["longopen", "longhold", "shortopen", "shorthold", "shorthold"], high=[100, 100, 100, 102, 100], low=[98, 100, 100, 100, 100])
    assert rows[2]["lc_limit"] == pytest.approx(rows[2]["so_limit"]) == pytest.approx(101)
    assert gains[0]["trend"] == "up" and gains[0]["endix"] == 4


def test_simulated_rule(spark):
    labels = ["longopen", "longhold", "longclose", "shortopen", "allclose"]
    df = series(spark, [100, 105, 110, 110, 99]).withColumn("label", F.element_at(F.array(*map(F.lit, labels)), F.row_number().over(W.ordered())))
    out = R.simulate_rule(df, 0.01).orderBy("buydt").collect()
    assert [(r["trade"], r["minutes"]) for r in out] == [("long", 2), ("short", 1)]
    assert out[0]["gain"] == pytest.approx((110 * 0.99 - 101) / 101) and out[1]["gain"] == pytest.approx((110 * 0.99 - 99 * 1.01) / (110 * 0.99))


def test_latches_equal_a_loop(spark):
    rng = random.Random(2)
    events = [rng.choice([1, 0, None, None]) for _ in range(60)]
    want, now = [], False
    for e in events:
        now = now if e is None else bool(e)
        want.append(now)
    df = series(spark, range(60)).withColumn("e", F.element_at(F.array(*map(F.lit, [-1 if e is None else e for e in events])), F.row_number().over(W.ordered())))
    assert column(df.withColumn("x", W.latch(F.col("e") == 1, F.col("e") == 0)), "x") == want


def test_chunks_equal_the_whole(spark):
    df = S.sine_bars(spark, 3000, 250, 77)
    numbered = W.number_rows(df, name="n")
    work = lambda x: G.rolling_regression(x, "pivot", [60], keys=("symbol", "chunk"))
    parts = W.in_chunks(numbered, work, 500, 60).where("n >= 60")
    whole = G.rolling_regression(numbered, "pivot", [60]).where("n >= 60")
    both = parts.join(whole.select("n", F.col("grad_60").alias("g"), F.col("regry_60").alias("y")), "n")
    assert both.count() == 3000 - 59
    assert both.where("abs(grad_60 - g) > 1e-10 or abs(regry_60 - y) > 1e-10").count() == 0


def test_supplement_equals_the_whole(spark):
    df = S.sine_bars(spark, 300, 50)
    stored = W.number_rows(df).where("rn <= 200").drop("rn")
    new = G.supplement(df, stored, lambda x: G.rolling_regression(x, "pivot", [30]), 29)
    whole = G.rolling_regression(W.number_rows(df), "pivot", [30]).where("rn > 200")
    assert new.count() == 100
    joined = new.join(whole.select("opentime", F.col("grad_30").alias("g")), "opentime")
    assert joined.where("abs(grad_30 - g) > 1e-10").count() == 0


def test_extensions(spark):
    from tickloom.plans.protocols import ExternalScorer, replay_strategy

    df = series(spark, [1, 2, 3])
    scorer = ExternalScorer(lambda: lambda pdf: pdf.assign(up=pdf["close"] / 10), ["up"])
    assert column(scorer.transform(df), "up") == pytest.approx([0.1, 0.2, 0.3])
    out = replay_strategy(df, lambda now, row: {"total": now["total"] + row["close"]}, {"total": 0.0}, ["total"])
    assert column(out, "total") == [1, 3, 6]


def lined(spark, price, line=100.0, grad=0.0, std=1.0, w=5):
    df = series(spark, price)
    return df.withColumn(f"regry_{w}", F.lit(line)).withColumn(f"grad_{w}", F.lit(grad)).withColumn(f"std_{w}", F.lit(std))


def test_several_positions_close_first_in_first_out(spark):
    price = [95, 95, 95, 106, 106, 100]
    out = R.multi_position_replay(lined(spark, price), 5, 0.04, 0.05, 1, 1, most=2).orderBy("closeix", "openix").collect()
    longs = [(r["openix"], r["closeix"], r["tradelen"]) for r in out if r["longshort"] == "long"]
    assert longs == [(1, 4, 3), (2, 5, 3)]  # two at most, each close takes the oldest
    assert all(r["gain"] == pytest.approx((106 - 95) / 95) for r in out if r["longshort"] == "long")
    few = R.multi_position_replay(lined(spark, price), 5, 0.04, 0.05, 3, 1).where("longshort = 'long'").count()
    assert few == 1  # opens at least three rows apart
    assert R.multi_position_replay(lined(spark, price, std=1.0), 5, 0.04, 0.05, 1, 1, stdcheck=True).count() == 0


def test_focus_rule_opens_by_the_shortest_window_and_holds(spark):
    df = lined(spark, [100, 100, 100, 107], w=3).withColumn("regry_9", F.lit(100.0))
    grad = F.when(F.row_number().over(W.ordered()) == 1, 5.0).otherwise(0.0)
    df = df.withColumn("grad_3", grad).withColumn("grad_9", F.lit(0.0))
    out = R.rule_advice_focus(df, [3, 9], 0.08, -0.08, 0.5, 0.05).orderBy("opentime").collect()
    assert [r["label"] for r in out] == ["longopen", "longhold", "longhold", "longclose"]
    assert [r["regrwindow"] for r in out] == [3, 3, 3, 0]


def test_budget_is_shared_until_it_is_used(spark):
    rows = [(START, s, label, 10.0, held, 100.0, 1000.0) for s, label, held in (("A", "longopen", 0.0), ("B", "shortopen", 5.0), ("C", "allclose", 0.0), ("D", "longopen", 0.0))]
    df = spark.createDataFrame(rows, "opentime timestamp_ntz, symbol string, label string, close double, position double, freequote double, equity double")
    out = {r["symbol"]: (r["amount"], r["reason"]) for r in P.allocate_budget(df, 20.0, 120.0).collect()}
    assert out == {"A": (4.0, "open"), "B": (0.0, "full position"), "C": (0.0, "no open"), "D": (4.0, "open")}
    short = {r["symbol"]: r["reason"] for r in P.allocate_budget(df, 200.0, 120.0).collect()}
    assert short["A"] == "insufficient quote"


def test_trade_tables_compare_with_tolerance(spark):
    a = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "k string, n int, v double")
    b = spark.createDataFrame([("A", 1, 1.0000001), ("C", 1, 2.0)], "k string, n int, v double")
    out = {r["k"]: (r["v_eq"], r["match_all"]) for r in J.compare_trade_tables(a, b, ["k"], ["v", "n"]).collect()}
    assert out == {"A": (True, True), "B": (False, False), "C": (False, False)}


def test_undersampling_evens_the_classes(spark):
    df = spark.range(5000).withColumn("label", F.when(F.col("id") % 10 == 0, "rare").otherwise("common"))
    counts = {r["label"]: r["count"] for r in C.undersample(df, "label", ["id"]).groupBy("label").count().collect()}
    assert counts == {"rare": 500, "common": 500}
    few = spark.createDataFrame([(1, "a")] * 3 + [(2, "b")] * 7 + [(3, "b")], "id int, label string")
    assert {r["label"]: r["count"] for r in C.undersample(few, "label", ["id"]).groupBy("label").count().collect()} == {"a": 3, "b": 3}


def test_rows_with_missing_features_are_predicted_as_null(spark):
    from tickloom.operators import ml

    df = spark.range(400).select(F.when(F.col("id") % 50 != 7, F.col("id") % 10 / 10).alias("x"), F.when(F.col("id") % 10 < 3, "low").otherwise("high").alias("label"), "id")
    for hidden in ((), (4,)):
        out = ml.predict(ml.fit_trend_classifier(df, ["x"], hidden=hidden), df)
        assert out.count() == 400 and out.where("x is null and label is null and score is null").count() == 8
        assert out.where("x is not null and score is not null").count() == 392
        assert out.where("x < 0.25 and label = 'low' or x > 0.35 and label = 'high'").count() > 300


def test_ranges_meet_their_rows(spark):
    rows = spark.range(1, 31).select(F.lit("A").alias("symbol"), F.col("id").alias("rn"))
    ranges = spark.createDataFrame([("A", 3, 5, "x"), ("A", 6, 6, "y"), ("B", 1, 30, "z"), ("A", 20, 40, "w")], "symbol string, a long, b long, name string")
    out = {r["rn"]: r["name"] for r in J.with_range(rows, ranges, ["symbol"], "rn", "a", "b", ["name"]).collect()}
    assert out == {i: "x" if 3 <= i <= 5 else "y" if i == 6 else "w" if i >= 20 else None for i in range(1, 31)}
    over = spark.createDataFrame([("A", 1, 10), ("A", 2, 3), ("A", 9, 12)], "symbol string, a long, b long")
    assert sorted(r["rn"] for r in J.in_some_range(rows, over, ["symbol"], "rn", "a", "b").collect()) == list(range(1, 13))


def test_short_windows_keep_their_digits_on_long_histories(spark):
    n, windows = 2_000_000, (5, 24, 60)
    price = lambda i: 100 + 30 * np.sin(i / 90_000.0) + ((i * i) % 1009) / 1009.0
    i = F.col("id")
    df = spark.range(n).select(F.lit("A").alias("symbol"), i.alias("opentime"), (100 + 30 * F.sin(i / 90_000.0) + ((i * i) % 1009) / 1009.0).alias("pivot"))
    got = G.rolling_regression(df, "pivot", windows, ["pivot"]).where(F.col("opentime") >= n - 500).toPandas()
    for r in got.iloc[::25].itertuples():
        for w in windows:
            y = price(np.arange(r.opentime - w + 1, r.opentime + 1).astype(np.longdouble))
            k = np.arange(w) - (w - 1) / 2
            slope = (k * (y - y.mean())).sum() / (k * k).sum()
            rest = y - y.mean() - slope * k
            want = (slope, y.mean() + slope * k[-1], np.sqrt((rest * rest).sum() / (w - 1)))
            have = [getattr(r, f"{c}_{w}") for c in ("grad", "regry", "std")]
            assert all(abs(a - b) <= 1e-6 * abs(b) for a, b in zip(have, want, strict=True)), (r.opentime, w)
