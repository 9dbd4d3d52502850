"""Trading rules on regression bands, and their replay over history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from tickloom.functions.scalar import relative_gain_regr
from tickloom.operators.chunks import automata, with_output
from tickloom.operators.windows import KEY, TIME, ordered, with_sliding_sum


@dataclass(frozen=True)
class Band:
    """Thresholds of the band rules; the column names of a parameter grid are the same."""

    buy: float = -0.01
    sell: float = 0.01
    volatility_long: float = 0.0
    volatility_short: float = 0.0
    trend_long: float = 0.04
    trend_short: float = -0.04

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(v) for k, v in self.__dict__.items()}


def band_label(regry: Column, gain: Column, p: dict[str, Column], hold_by_gain: bool = True) -> Column:
    """Opens below (above) the band in a rising (falling) trend or in a strong one, closes after the other side was
    reached; otherwise holds by the trend's gain, or is shorthold in the form without that."""
    now, before = F.col("pivot"), F.lag("pivot").over(ordered())
    down, up = regry * (1 + p["buy"]), regry * (1 + p["sell"])
    label = (
        F.when(((now < down) & (gain >= p["volatility_long"])) | (gain >= p["trend_long"]), "longopen")
        .when((before >= up) & (gain < p["trend_long"]), "longclose")
        .when(((now > up) & (gain <= p["volatility_short"])) | (gain <= p["trend_short"]), "shortopen")
        .when((before <= down) & (gain > p["trend_short"]), "shortclose")
    )
    if hold_by_gain:
        return label.when(gain >= p["volatility_long"], "longhold").when(gain <= p["volatility_short"], "shorthold").otherwise("allclose")
    return label.otherwise("shorthold")


def rule_advice_band(df: DataFrame, w: int, p: Band, hold_by_gain: bool = True) -> DataFrame:
    """Label of each row by the regression of window w (columns regry_w, grad_w)."""
    gain = relative_gain_regr(F.col(f"regry_{w}"), F.col(f"grad_{w}"), w, forward=False)
    return df.withColumn("label", band_label(F.col(f"regry_{w}"), gain, p.columns(), hold_by_gain))


def regression_touched(df: DataFrame, windows: Sequence[int], rows: int) -> DataFrame:
    """touched_w: the price crossed the line in both halves of the last rows; without that history only the longest."""
    from tickloom.operators.windows import number_rows

    df = number_rows(df, name="_rn")
    half = rows // 2
    for w in windows:
        d = F.signum(F.col("pivot") - F.col(f"regry_{w}"))
        before = F.lag(d).over(ordered())
        df = df.withColumn("_cross", F.coalesce((d * before <= 0).cast("int"), F.lit(0)))
        df = with_sliding_sum(df, F.col("_cross"), half, "_near")
        far = F.coalesce(F.lag("_near", half).over(ordered()), F.lit(0))
        df = df.withColumn("_far", far)
        known = (F.col("_near") > 0) & (F.col("_far") > 0)
        df = df.withColumn(f"touched_{w}", F.when(F.col("_rn") < rows, F.lit(w == max(windows))).otherwise(known)).drop("_cross", "_near", "_far")
    return df.drop("_rn")


def rule_advice_switch(df: DataFrame, windows: Sequence[int], rows: int, p: Band) -> DataFrame:
    """The band rule with the shortest touched window, the longest one if none is."""
    df = regression_touched(df, windows, rows)
    pick = F.coalesce(*[F.when(F.col(f"touched_{w}"), w) for w in sorted(windows)], F.lit(max(windows)))
    df = df.withColumn("regrwindow", pick)
    by = lambda of: F.coalesce(*[F.when(F.col("regrwindow") == w, of(w)) for w in windows])
    gain = by(lambda w: relative_gain_regr(F.col(f"regry_{w}"), F.col(f"grad_{w}"), w, forward=False))
    df = df.withColumn("_gain", gain).withColumn("_regry", by(lambda w: F.col(f"regry_{w}")))
    return df.withColumn("label", band_label(F.col("_regry"), F.col("_gain"), p.columns(), False)).drop("_gain", "_regry")


def rule_advice_focus(df: DataFrame, windows: Sequence[int], long_gain: float, short_gain: float, close_factor: float, sell_share: float) -> DataFrame:
    """Opens with the shortest window whose gain reaches its threshold. While a trade is open, longer windows are left
    out, and it closes when the trend of its window has weakened and the price is beyond its line.

    An automaton of one state without a trade and two for each window, walked through in chunks side by side."""
    windows = sorted(windows)
    labels = ("allclose", "longopen", "shortopen", "longhold", "shorthold", "longclose", "shortclose")
    count = len(windows)

    def rule(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """States: 0 none, 1 + 2 i long and 2 + 2 i short with window i. Output: label and state after it."""
        column = lambda c: table.column(c).to_numpy()
        price, n = column("pivot"), table.num_rows
        line = [column(f"regry_{w}") for w in windows]
        gain = [1 - (y - column(f"grad_{w}") * (w - 1)) / y for y, w in zip(line, windows, strict=True)]
        opens = np.full((count, n), -1)  # the first window up to each that opens
        for i in range(count):
            here = np.where((gain[i] >= long_gain) | (gain[i] <= short_gain), i, -1)
            opens[i] = here if i == 0 else np.where(opens[i - 1] >= 0, opens[i - 1], here)
        is_long = np.array(gain) >= long_gain
        after, label = np.zeros((n, 1 + 2 * count), np.int64), np.zeros((n, 1 + 2 * count), np.int64)
        rows = np.arange(n)
        for state in range(1 + 2 * count):
            focus = (state - 1) // 2
            if state == 0:
                kept, told = np.zeros(n, np.int64), np.zeros(n, np.int64)
            elif state % 2:
                ends = (gain[focus] < long_gain * close_factor) & (price >= line[focus] * (1 + sell_share))
                kept, told = np.where(ends, 0, state), np.where(ends, 5, 3)
            else:
                ends = (gain[focus] > short_gain * close_factor) & (price <= line[focus] * (1 - sell_share))
                kept, told = np.where(ends, 0, state), np.where(ends, 6, 4)
            to = opens[focus if state else count - 1]
            long = is_long[np.maximum(to, 0), rows]
            after[:, state] = np.where(to >= 0, np.where(long, 1 + 2 * to, 2 + 2 * to), kept)
            label[:, state] = np.where(to >= 0, np.where(long, 1, 2), told)
        return after, label * (1 + 2 * count) + after

    rows = with_output(df, 1 + 2 * count, rule, "_out")
    known, used = F.array(*[F.lit(x) for x in labels]), F.array(F.lit(0), *[F.lit(w) for w in windows for _ in range(2)])
    label = F.get(known, F.floor(F.col("_out") / (1 + 2 * count)).cast("int"))
    return rows.withColumn("label", label).withColumn("regrwindow", F.get(used, F.col("_out") % (1 + 2 * count))).drop("_out")


SIM = "trade string, buydt timestamp_ntz, selldt timestamp_ntz, minutes bigint, buyprice double, sellprice double, gain double, fee double"
#: State after a label by the state before it (none, long, short); other labels change nothing.
SIDES = {"longopen": (1, 1, 2), "shortopen": (2, 1, 2), "longclose": (0, 0, 2), "shortclose": (0, 1, 0)}


def _side_maps(label: np.ndarray) -> np.ndarray:
    out = np.tile(np.arange(3, dtype=np.uint8), (len(label), 1))
    for name, to in SIDES.items():
        out[label == name] = to
    return out


def _trades(events: DataFrame, last: DataFrame, fee: float, keys: Sequence[str]) -> DataFrame:
    """Trades from the rows (keys, opentime, pivot, side: 1, 2 or, at closes, 0) at which one opens or closes, in turn."""
    w = Window.partitionBy(*keys).orderBy(TIME)
    pairs = events.withColumns({"selldt": F.lead(TIME).over(w), "sellprice": F.lead("pivot").over(w)}).where("side <> 0").join(last, list(keys))
    pairs = pairs.select(
        *keys, "side", F.col(TIME).alias("buydt"), F.coalesce("selldt", F.col("_last").getField(TIME)).alias("selldt"),
        F.col("pivot").alias("a"), F.when(F.col("selldt").isNull(), F.col("_last.pivot")).otherwise(F.col("sellprice")).alias("b"),
    )
    a, b, long = F.col("a"), F.col("b"), F.col("side") == 1
    gain = F.when(long, (b * (1 - fee) - a * (1 + fee)) / (a * (1 + fee))).otherwise((a * (1 - fee) - b * (1 + fee)) / (a * (1 - fee)))
    return pairs.select(
        *keys, F.when(long, "long").otherwise("short").alias("trade"), "buydt", "selldt", F.expr("timestampdiff(MINUTE, buydt, selldt)").alias("minutes"),
        a.alias("buyprice"), b.alias("sellprice"), gain.alias("gain"), ((a + b) * fee).alias("fee"),
    )


def simulate_rule(df: DataFrame, fee: float, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Trades of the labels: one open at a time, long or short, with fees; an open one is closed in the last row.

    The side is an automaton of three states, so a symbol's history is walked through in chunks side by side; only the rows
    at which a trade opens or closes meet by symbol.
    """

    def rule(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        after = _side_maps(table.column("label").to_numpy(zero_copy_only=False))
        return after, np.where(after != np.arange(3), after, 3)

    rows = df.select(*keys, TIME, F.col("pivot").cast("double").alias("pivot"), "label")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(TIME, "pivot"), TIME).alias("_last"))
    return _trades(with_output(rows, 3, rule, "side", keys).where("side <> 3"), last, fee, keys)


def sweep_configs(df: DataFrame, w: int, grid: DataFrame, fee: float) -> DataFrame:
    """The band rule simulated for all symbols and all rows of a parameter grid (cfgid and the fields of Band).

    The configurations are lanes of one automaton: a symbol's rows are shuffled once for all of them. The grid, a table of
    parameters, goes to the driver and with the function to the tasks; memory of a task grows by one lane's states.
    """
    names = list(Band().__dict__)
    configs = grid.select("cfgid", *names).collect()
    gain = relative_gain_regr(F.col(f"regry_{w}"), F.col(f"grad_{w}"), w, forward=False)
    rows = df.select(
        KEY, TIME, F.col("pivot").cast("double").alias("pivot"), F.lag(F.col("pivot").cast("double")).over(ordered()).alias("_before"),
        F.col(f"regry_{w}").alias("_regry"), gain.alias("_gain"),
    )

    def rule(table: pa.Table, lane: int) -> np.ndarray:
        p = configs[lane]
        now, before, line, g = (table.column(c).to_numpy() for c in ("pivot", "_before", "_regry", "_gain"))
        down, up = line * (1 + p["buy"]), line * (1 + p["sell"])
        conditions = [
            ((now < down) & (g >= p["volatility_long"])) | (g >= p["trend_long"]), (before >= up) & (g < p["trend_long"]),
            ((now > up) & (g <= p["volatility_short"])) | (g <= p["trend_short"]), (before <= down) & (g > p["trend_short"]),
        ]
        label = np.select(conditions, [0, 1, 2, 3], 4)
        return np.array([SIDES["longopen"], SIDES["longclose"], SIDES["shortopen"], SIDES["shortclose"], (0, 1, 2)], np.uint8)[label]

    id_type = grid.schema["cfgid"].dataType
    schema = StructType([rows.schema[KEY], StructField("cfgid", id_type), rows.schema[TIME], rows.schema["pivot"], StructField("side", IntegerType())])

    def emit(table: pa.Table, lane: int, state: np.ndarray) -> pa.Table:
        after = rule(table, lane)[np.arange(table.num_rows), state]
        at = pa.array(np.flatnonzero(after != state))
        some = table.take(at)
        cfgid = pa.array([configs[lane]["cfgid"]] * len(at), to_arrow_type(id_type))
        side = pa.array(after[after != state].astype(np.int32))
        return pa.Table.from_arrays([some.column(KEY), cfgid, some.column(TIME), some.column("pivot"), side], [f.name for f in schema])

    last = rows.groupBy(KEY).agg(F.max_by(F.struct(TIME, "pivot"), TIME).alias("_last"))
    last = last.crossJoin(F.broadcast(grid.select("cfgid")))  # a row for each symbol and configuration
    if not configs:
        return _trades(rows.limit(0).select(KEY, F.lit(None).cast(id_type).alias("cfgid"), TIME, "pivot", F.lit(0).alias("side")), last, fee, (KEY, "cfgid"))
    return _trades(automata(rows, len(configs), 3, rule, emit, schema), last, fee, (KEY, "cfgid"))


def multi_position_replay(
    df: DataFrame, w: int, buy: float, sell: float, buygap: int, sellgap: int, most: int = 0, selfmonitor: float = -1e9,
    stdcheck: bool = False, trendrows: int = 0, drawdownrows: int = 43200, fee: float = 0.0,
) -> DataFrame:
    """Trades around a regression line, several at a time: closed first in, first out, with gaps between opens and between
    closes, at most so many open, no opens after a last gain below selfmonitor, or against the rolling gain of the
    other side. Columns: longshort, openix, closeix, tradelen, gain, drawdown (gains of the last drawdownrows)."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME).reset_index(drop=True)
        price, line, std = pdf["pivot"].to_numpy(), pdf[f"regry_{w}"].to_numpy(), pdf[f"std_{w}"].to_numpy()
        opened: dict[int, list[int]] = {1: [], -1: []}
        closed, good = {1: -(10**9), -1: -(10**9)}, {1: True, -1: True}
        history: dict[int, list[tuple[int, float]]] = {1: [], -1: []}
        out = []
        recent = lambda s, i, rows: sum(g for at, g in history[s] if at > i - rows)

        def gain(a: int, b: int, side: int) -> float:
            x, y = price[a] * (1 + fee), price[b] * (1 - fee)
            return side * (y - x) / x

        for i in range(len(price)):
            for side in (1, -1):
                beyond = side * (price[i] - line[i] * (1 + side * sell)) > 0
                ready = beyond if sell >= 0 else bool(opened[side]) and gain(opened[side][0], i, side) >= -sell
                if ready and i - closed[side] >= sellgap:
                    while opened[side]:
                        g = gain(opened[side][0], i, side)
                        good[side] = g >= selfmonitor
                        history[side].append((i, g))
                        a = opened[side].pop(0)
                        out.append((pdf[KEY].iloc[0], "long" if side > 0 else "short", a + 1, i + 1, i - a, g, recent(side, i, drawdownrows)))
                        if good[side]:
                            break  # the rest is closed too only after a bad one
                    closed[side] = i
                other = -side  # beyond the line on this side opens the other one
                if side * (price[i] - line[i] * (1 + side * buy)) > 0 and good[other] and (not trendrows or side * recent(side, i, trendrows) < buy):
                    free = not opened[other] or i - opened[other][-1] >= buygap
                    if (not stdcheck or std[i] / line[i] > buy) and free and (not most or len(opened[other]) < most):
                        opened[other].append(i)
        return pd.DataFrame(out, columns=[KEY, "longshort", "openix", "closeix", "tradelen", "gain", "drawdown"])

    kinds = f"{KEY} string, longshort string, openix int, closeix int, tradelen int, gain double, drawdown double"
    return df.groupBy(KEY).applyInPandas(walk, kinds)
