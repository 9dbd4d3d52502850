"""Turning points of regression lines and prices, and swings between them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.chunks import numbered
from tickloom.operators.features import turns
from tickloom.operators.joins import asof_join
from tickloom.operators.targets import Thresholds, relative_distance, threshold_labels
from tickloom.operators.windows import KEY, TIME, number_rows, ordered, with_islands


def regression_extremes(df: DataFrame, grad: str) -> DataFrame:
    """symbol, rn and kind (1 maximum, -1 minimum) of the turning rows of a slope, and the last row of each symbol."""
    rows = number_rows(turns(df, grad))
    last = F.col("rn") == F.count("*").over(Window.partitionBy(KEY))
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    heading = F.coalesce(F.last(F.when(F.col(grad) != 0, F.signum(grad)), ignorenulls=True).over(w), F.lit(0.0)).cast("int")
    rows = rows.withColumn("kind", F.when(last, heading).otherwise(F.col("turn"))).withColumn("_last", last)
    return rows.where(F.col("_last") | (F.col("kind") != 0)).select(KEY, TIME, "rn", "kind")


def neighbour_extremes(df: DataFrame, grad: str) -> DataFrame:
    """Row numbers of the turning rows before and after each row."""
    rows = number_rows(turns(df, grad))
    at = F.when(F.col("turn") != 0, F.col("rn"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prev_extreme", F.last(at, ignorenulls=True).over(earlier(ordered())))
    # Ahead is earlier in the opposite order: a frame up to the end would be gone through anew for each row.
    return rows.withColumn("next_extreme", F.last(at, ignorenulls=True).over(earlier(Window.partitionBy(KEY).orderBy(F.desc(TIME))))).drop("turn")


#: Rows of a block of the table of extremes.
BLOCK = 256
#: The four ways to look for an extreme: highest or lowest, and of equal ones the last or the first row.
WAYS = ((1, 1), (1, -1), (-1, 1), (-1, -1))


def _better(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Elementwise the larger of (value, signed row)."""
    take = (b[0] > a[0]) | ((b[0] == a[0]) & (b[1] > a[1]))
    return np.where(take, b[0], a[0]), np.where(take, b[1], a[1])


def block_extremes(rows: DataFrame) -> DataFrame:
    """A sparse table over blocks of rows (symbol, rn, pivot): symbol, level, block and, for each way, the best value and its row
    of the 2 ** level blocks from block on. A symbol's summaries of blocks, one for BLOCK rows, are one group."""
    best = [F.max(F.struct((F.col("pivot") * kind).alias("v"), (F.col("rn") * last).cast("long").alias("r"))).alias(f"w{i}") for i, (kind, last) in enumerate(WAYS)]
    blocks = rows.groupBy(KEY, F.floor((F.col("rn") - 1) / BLOCK).alias("block")).agg(*best)
    flat = blocks.select(KEY, "block", *[F.col(f"w{i}.{x}").alias(f"{x}{i}") for i in range(len(WAYS)) for x in "vr"])
    names = [f"{x}{i}" for i in range(len(WAYS)) for x in "vr"]

    def doubled(table: pa.Table) -> pa.Table:
        key, at = table.column(KEY)[0].as_py(), table.column("block").to_numpy()
        block = np.arange(at.max() + 1)
        now = []
        for i in range(len(WAYS)):  # blocks without a value lose against all others
            value, row = np.full(len(block), -np.inf), np.zeros(len(block), np.int64)
            value[at], row[at] = table.column(f"v{i}").to_numpy(), table.column(f"r{i}").to_numpy()
            now.append((value, row))
        parts, level = [], 0
        while True:
            n = len(now[0][0])
            parts.append([pa.array([key] * n, pa.string()), pa.array(np.full(n, level, np.int32)), pa.array(block[:n]), *[pa.array(x) for way in now for x in way]])
            if n <= 1 << level:
                return pa.concat_tables([pa.Table.from_arrays(x, [KEY, "level", "block", *names]) for x in parts])
            step = 1 << level
            now = [_better((v[:-step], r[:-step]), (v[step:], r[step:])) for v, r in now]
            level += 1

    kinds = ", ".join(f"{n} {'double' if n[0] == 'v' else 'long'}" for n in names)
    return flat.groupBy(KEY).applyInArrow(doubled, f"{KEY} string, level int, block long, {kinds}")


def price_extreme_between(df: DataFrame, spans: DataFrame) -> DataFrame:
    """For each span (symbol, a, b, kind) the row of the highest (kind 1) or lowest price between a and b, ties to b.

    Prices without a value don't count; spans without a row give none, spans that reach beyond the rows are cut. A span is
    two parts of blocks at its ends and two entries of the sparse table between them, each found by its place: time in
    proportion to rows plus spans, and no row meets a span that doesn't end in its block.
    """
    rows = numbered(df.select(KEY, TIME, F.col("pivot").cast("double").alias("pivot")))
    rows = rows.where("pivot is not null and not isnan(pivot)").select(KEY, "rn", "pivot")
    asked = spans.select(KEY, "a", "b", "kind").distinct().join(rows.groupBy(KEY).agg(F.max("rn").alias("_most")), KEY)
    lo, hi = F.greatest(F.least("a", "b"), F.lit(1)), F.least(F.greatest("a", "b"), F.col("_most"))
    asked = asked.withColumn("_lo", lo.cast("long")).withColumn("_hi", hi.cast("long")).where("_lo <= _hi").withColumn("_last", F.when(F.col("b") >= F.col("a"), 1).otherwise(-1))
    asked = asked.withColumn("_first", F.floor((F.col("_lo") - 1) / BLOCK)).withColumn("_final", F.floor((F.col("_hi") - 1) / BLOCK))
    spanned = [KEY, "a", "b", "kind", "_last"]
    # The parts of blocks: rows of a block in an array, of which each span takes a slice.
    held = rows.groupBy(KEY, F.floor((F.col("rn") - 1) / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rn", "pivot"))).alias("rows"))
    ends = asked.select(*spanned, "_lo", "_hi", F.explode(F.array_distinct(F.array("_first", "_final"))).alias("block"))
    ends = ends.join(held, [KEY, "block"])
    inside = F.filter("rows", lambda r: (r["rn"] >= F.col("_lo")) & (r["rn"] <= F.col("_hi")))
    value = lambda r: F.struct((r["pivot"] * F.col("kind")).alias("v"), (r["rn"] * F.col("_last")).cast("long").alias("r"))
    of_ends = ends.select(*spanned, F.array_max(F.transform(inside, value)).alias("best"))
    # The whole blocks between them: two runs of 2 ** level blocks cover them.
    between = asked.where(F.col("_final") - F.col("_first") > 1).withColumn("_n", F.col("_final") - F.col("_first") - 1)
    between = between.withColumn("level", F.floor(F.log2(F.col("_n"))).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level")).cast("long")
    looked = between.select(*spanned, "level", F.explode(F.array_distinct(F.array(F.col("_first") + 1, F.col("_final") - size))).alias("block"))
    found = looked.join(block_extremes(rows), [KEY, "level", "block"])
    picked = F.coalesce(*[F.when((F.col("kind") == kind) & (F.col("_last") == last), F.struct(F.col(f"v{i}").alias("v"), F.col(f"r{i}").alias("r"))) for i, (kind, last) in enumerate(WAYS)])
    best = of_ends.unionByName(found.select(*spanned, picked.alias("best"))).groupBy(*spanned).agg(F.max("best").alias("m"))
    return best.where("m.r <> 0").select(KEY, "a", "b", "kind", F.abs("m.r").cast("int").alias("extreme_rn"))


def next_local_extreme(df: DataFrame) -> DataFrame:
    """Row number of the end of the monotone run of pivots that each row is in."""
    rows = number_rows(df)
    step = F.signum(F.lead("pivot").over(ordered()) - F.col("pivot"))
    rows = with_islands(rows.withColumn("_step", step), F.col("_step"), "_run")
    return rows.withColumn("extreme_rn", F.max("rn").over(Window.partitionBy(KEY, "_run")) + F.when(F.col("_step").isNull(), 0).otherwise(1)).drop("_step", "_run")


def zigzag(prices: np.ndarray, mingain: float, minloss: float) -> np.ndarray:
    """For each row the (0-based) row of the next significant peak, -1 if there is none.

    A maximum is significant if it exceeds the last significant minimum by mingain, a minimum if it falls below the last
    significant maximum by minloss (negative), relative to the former.
    """
    n = len(prices)
    out = np.full(n, -1)
    low = high = 0  # extremes since the last significant one
    direction = 0
    peaks: list[int] = []
    for i in range(1, n):
        if prices[i] > prices[high] and direction >= 0:
            high = i
        if prices[i] < prices[low] and direction <= 0:
            low = i
        if direction >= 0 and high < i and (prices[i] - prices[high]) / abs(prices[high]) <= minloss:
            peaks.append(high)
            direction, low = -1, i
        elif direction <= 0 and low < i and (prices[i] - prices[low]) / abs(prices[low]) >= mingain:
            peaks.append(low)
            direction, high = 1, i
    if direction > 0:
        peaks.append(high)
    elif direction < 0:
        peaks.append(low)
    start = 0
    for p in peaks:
        out[start:p] = p
        start = max(start, p)
    return out


def significant_peaks(df: DataFrame, mingain: float, minloss: float) -> DataFrame:
    """peak_rn (0 without one) and distance to its price: a recurrence, one pass for each symbol."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME).reset_index(drop=True)
        price = pdf["pivot"].to_numpy(float)
        peak = zigzag(price, mingain, minloss)
        return pdf.assign(peak_rn=peak + 1, distance=np.where(peak >= 0, price[peak] - price, 0.0))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(KEY).applyInPandas(walk, f"{kinds}, peak_rn int, distance double")


def backward_extremes(high: np.ndarray, low: np.ndarray, amplitude: float, most: int) -> list[int]:
    """Signed 1-based rows of turning points at least amplitude apart, newest first: highs positive, lows negative.

    The amplitude is the swing over its low, whichever comes first. The last row is no turning point.
    """
    out: list[int] = []
    top = bottom = len(high) - 1
    for i in range(len(high) - 2, -1, -1):
        if not out or out[-1] < 0:
            if high[i] > high[top]:
                top = i
        if not out or out[-1] > 0:
            if low[i] < low[bottom]:
                bottom = i
        swing = (high[top] - low[bottom]) / low[bottom]
        if swing >= amplitude:
            if not out:
                newest, older = (top, bottom) if top > bottom else (bottom, top)
                out += [newest + 1, -(older + 1)] if newest == top else [-(newest + 1), older + 1]
            elif out[-1] < 0 and top < -out[-1] - 1:
                out.append(top + 1)
                bottom = top
            elif out[-1] > 0 and bottom < out[-1] - 1:
                out.append(-(bottom + 1))
                top = bottom
        if out and out[-1] > 0 and high[i] > high[out[-1] - 1]:
            out[-1] = i + 1  # the same swing goes further back
            bottom = top = i
        elif out and out[-1] < 0 and low[i] < low[-out[-1] - 1]:
            out[-1] = -(i + 1)
            bottom = top = i
    return [p for p in out if abs(p) < len(high)][:most]


def amplitude_extremes(df: DataFrame, amplitude: float, most: int = 100) -> DataFrame:
    """symbol and extremes: backward_extremes() of all rows of a symbol."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        found = backward_extremes(pdf["high"].to_numpy(float), pdf["low"].to_numpy(float), amplitude, most)
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "extremes": [found]})

    return df.groupBy(KEY).applyInPandas(walk, f"{KEY} string, extremes array<int>")


def smooth_distance(last_price: Column, last_rn: Column, rn: Column, next_price: Column, next_rn: Column) -> Column:
    """Distance to the next peak's price from the straight line between the last and the next peak."""
    line = last_price + (next_price - last_price) * (rn - last_rn) / (next_rn - last_rn)
    return F.when(next_rn > last_rn, next_price - line).otherwise(0.0)


def regression_price_peaks(df: DataFrame, grad: str) -> DataFrame:
    """For each regression extreme the price extreme between it and the one before (from row 1 for the first)."""
    found = regression_extremes(df, grad).where("kind <> 0")
    before = F.coalesce(F.lag("rn").over(Window.partitionBy(KEY).orderBy("rn")), F.lit(1))
    spans = found.select(KEY, F.col("rn").alias("a"), before.alias("b"), "kind")
    return price_extreme_between(df, spans).select(KEY, F.col("extreme_rn").alias("rn"), "kind", F.col("a").alias("regression_rn"))


def best_path(price: Sequence[float] | dict[int, float], peaks: dict[int, list[int]], t: Thresholds) -> list[int]:
    """Signed 1-based peaks of the path with the highest sum of qualified gains.

    peaks: for each window its signed peaks in order. An edge leads from a peak to the next peak of the other kind of
    each window; its gain counts if it reaches the opening threshold. Peaks are in the order of their rows, so one
    pass over them gives the longest path.
    """
    nodes = sorted({p for ps in peaks.values() for p in ps}, key=lambda p: (abs(p), -p))
    if not nodes:
        return []
    best, came = dict.fromkeys(nodes, 0.0), dict.fromkeys(nodes, 0)
    # Of each window its highs and lows, and how many of them the nodes have passed.
    kinds = [{high: [q for q in ps if (q > 0) == high] for high in (True, False)} for ps in peaks.values()]
    passed = [{True: 0, False: 0} for _ in kinds]
    for node in nodes:
        for of, at in zip(kinds, passed, strict=True):
            high = node < 0
            while at[high] < len(of[high]) and abs(of[high][at[high]]) <= abs(node):
                at[high] += 1
            if at[high] == len(of[high]):
                continue
            nxt = of[high][at[high]]
            gain = (price[abs(nxt) - 1] - price[abs(node) - 1]) / price[abs(node) - 1]
            worth = gain if gain >= t.longopen else -gain if gain <= t.shortopen else 0.0
            if best[node] + worth > best[nxt] or (came[nxt] == 0 and best[node] + worth == best[nxt]):
                best[nxt], came[nxt] = best[node] + worth, node
    at = max(nodes, key=lambda p: (best[p], abs(p)))
    path = [at]
    while came[at]:
        at = came[at]
        path.append(at)
    return path[::-1]


def best_peak_path(df: DataFrame, peaks: DataFrame, t: Thresholds) -> DataFrame:
    """symbol, path (array of signed rows) and gain of the best path over the peaks (symbol, window, rn, kind)."""
    priced = peaks.select(KEY, "window", "rn", "kind").join(number_rows(df).select(KEY, "rn", "pivot"), [KEY, "rn"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["window", "rn", "kind"])
        signed = pdf["rn"].astype(int) * pdf["kind"].astype(int)
        by = {w: ps.tolist() for w, ps in signed.groupby(pdf["window"])}
        price = dict(zip((pdf["rn"].astype(int) - 1).tolist(), pdf["pivot"].astype(float).tolist(), strict=True))
        path = best_path(price, by, t)
        steps = [(price[abs(b) - 1] - price[abs(a) - 1]) / price[abs(a) - 1] for a, b in zip(path, path[1:], strict=False)]
        gain = sum(abs(g) for g in steps if g >= t.longopen or g <= t.shortopen)
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "path": [path], "gain": [gain]})

    return priced.groupBy(KEY).applyInPandas(walk, f"{KEY} string, path array<int>, gain double")


def peak_labels(df: DataFrame, paths: DataFrame, t: Thresholds) -> DataFrame:
    """Next peak of the path (peak_rn), relative distance to it and label of each row. A peak's own row refers to the one
    after it, the last peak's to itself; rows after the last peak refer to the last row."""
    exploded = paths.select(KEY, F.size("path").alias("_n"), F.posexplode("path").alias("_i", "signed"))
    peak = F.abs("signed")
    peaks = exploded.select(KEY, (peak - (F.col("_i") < F.col("_n") - 1).cast("int")).alias("rn"), peak.alias("peak"))
    rows = number_rows(df)
    rows = asof_join(rows, peaks, on="rn", forward=True).drop("rn_r").withColumnRenamed("peak_r", "peak_rn")
    rows = rows.withColumn("peak_rn", F.coalesce("peak_rn", F.max("rn").over(Window.partitionBy(KEY))))
    target = rows.select(KEY, F.col("rn").alias("peak_rn"), F.col("pivot").alias("_target"))
    rows = rows.join(target, [KEY, "peak_rn"]).withColumn("distance", relative_distance(F.col("pivot"), F.col("_target")))
    return threshold_labels(rows.drop("_target"), "distance", t)


def continuous_distance_labels(df: DataFrame, mingain: float, minloss: float, t: Thresholds) -> DataFrame:
    """Labels by the distance to the next significant peak."""
    rows = significant_peaks(df, mingain, minloss).withColumn("reldistance", F.col("distance") / F.col("pivot"))
    return threshold_labels(rows, "reldistance", t)


def windows_peaks(df: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Price peaks of the regressions (grad_w columns) of several windows: symbol, window, rn, kind."""
    out = None
    for w in windows:
        one = regression_price_peaks(df, f"grad_{w}").select(KEY, F.lit(w).alias("window"), "rn", "kind")
        out = one if out is None else out.unionByName(one)
    return out
