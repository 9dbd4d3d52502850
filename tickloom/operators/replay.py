"""Replay of limit orders over history, fills, budgets and order lanes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.windows import KEY, TIME, running, with_islands


@dataclass(frozen=True)
class LimitConfig:
    openthreshold: float = 0.6
    buygain: float = 0.001
    sellgain: float = 0.01
    limitreduction: float = 0.00001
    maxwindow: int = 240
    makerfee: float = 0.0015
    minupdate: float = 0.0


def open_close_limits(label: Column, close: Column, cfg: LimitConfig) -> tuple[Column, Column, Column, Column]:
    """Limits that an open label sets: long open, long close, short open, short close."""
    long, short = label == "longopen", label == "shortopen"
    return (
        F.when(long, close * (1 - cfg.buygain)), F.when(long, close * (1 + cfg.sellgain)),
        F.when(short, close * (1 + cfg.buygain)), F.when(short, close * (1 - cfg.sellgain)),
    )


GAINS = (
    "trend string, samplecount int, minutes int, gain double, gainfee double, startdt timestamp_ntz, enddt timestamp_ntz, startix int, endix int"
)
TRADES = (
    "opentime timestamp_ntz, label string, score double, high double, low double, close double, lo_limit double, lc_limit double, "
    "so_limit double, sc_limit double, lp_amount double, sp_amount double, l_pavg double, s_pavg double, lastopentrade timestamp_ntz"
)


class LimitReplay:
    """One pass over the rows of a group. In each row, in this order: close what the row reaches, apply the open that the
    row before reached, set limits from label and score, and note what the row's range opens for the next row."""

    AMOUNT = 100.0

    def __init__(self, pdf: pd.DataFrame, cfg: LimitConfig):
        self.cfg = cfg
        self.at = pdf[TIME].to_numpy()
        self.label, self.score = pdf["label"].to_numpy(object).copy(), pdf["score"].to_numpy(float)
        self.high, self.low, self.close = (pdf[c].to_numpy(float) for c in ("high", "low", "close"))
        self.limit = {"lo": 0.0, "lc": 0.0, "so": 0.0, "sc": 0.0}
        self.amount, self.average = {1: 0.0, -1: 0.0}, {1: 0.0, -1: 0.0}
        self.since: int | None = None
        self.pending: tuple[int, float] | None = None
        self.gains: list[tuple] = []
        self.rows: list[tuple] = []

    def book(self, side: int, price: float, i: int) -> None:
        start = self.since if self.since is not None else i
        gain = side * (price - self.average[side]) / self.average[side]
        minutes = int((self.at[i] - self.at[start]) / np.timedelta64(1, "m")) + 1
        trend = "up" if side > 0 else "down"
        self.gains.append((trend, i - start + 1, minutes, gain, gain - 2 * self.cfg.makerfee, self.at[start], self.at[i], start + 1, i + 1))
        self.amount[side] = self.average[side] = 0.0
        if not self.amount[-side]:
            self.since = None

    def closes(self, i: int) -> None:
        last = i == len(self.at) - 1
        if self.amount[1]:
            if self.limit["lc"] and self.limit["lc"] <= self.high[i]:
                self.book(1, self.limit["lc"], i)
            elif last:
                self.book(1, self.close[i], i)
        if self.amount[-1]:
            if self.limit["sc"] and self.low[i] <= self.limit["sc"]:
                self.book(-1, self.limit["sc"], i)
            elif last:
                self.book(-1, self.close[i], i)

    def opens(self, i: int) -> None:
        if self.pending and i < len(self.at) - 1:
            side, price = self.pending
            if not self.amount[-side]:
                whole = self.amount[side] + self.AMOUNT
                self.average[side] = (self.average[side] * self.amount[side] + price * self.AMOUNT) / whole
                self.amount[side] = whole
                self.since = i if self.since is None else self.since
        self.pending = None

    def limits(self, i: int) -> None:
        cfg, c, now = self.cfg, self.close[i], self.limit
        side = {"longopen": 1, "shortopen": -1}.get(self.label[i], 0)
        if side and self.score[i] >= cfg.openthreshold:
            own, other = ("lo", "lc"), ("so", "sc")
            if side < 0:
                own, other = other, own
            wanted = (c * (1 - side * cfg.buygain), c * (1 + side * cfg.sellgain))
            for lane, price in zip(own, wanted, strict=True):
                if not now[lane] or abs(price - now[lane]) / max(abs(now[lane]), 1e-6) >= cfg.minupdate:
                    now[lane] = price
            now[other[0]] = 0.0
            if self.amount[-side]:
                now[other[1]] = now[own[0]]  # the other position closes no later than this one opens
        elif side:
            self.label[i] = "longhold" if side > 0 else "shorthold"
            now["lo"] = now["so"] = 0.0
        else:
            now["lo"] = now["so"] = 0.0
        if self.since is not None:
            over = i - self.since - cfg.maxwindow
            if over > 0:
                now["lc"] *= 1 - cfg.limitreduction * (self.amount[1] > 0)
                now["sc"] *= 1 + cfg.limitreduction * (self.amount[-1] > 0)

    def note(self, i: int) -> None:
        if self.label[i] == "longopen" and self.limit["lo"] and self.low[i] <= self.limit["lo"]:
            self.pending = (1, self.limit["lo"])
        elif self.label[i] == "shortopen" and self.limit["so"] and self.limit["so"] <= self.high[i]:
            self.pending = (-1, self.limit["so"])

    def run(self) -> None:
        for i in range(len(self.at)):
            self.closes(i)
            self.opens(i)
            self.limits(i)
            self.note(i)
            since = self.at[self.since] if self.since is not None else None
            self.rows.append((
                self.at[i], self.label[i], self.score[i], self.high[i], self.low[i], self.close[i], *(self.limit[k] for k in ("lo", "lc", "so", "sc")),
                self.amount[1], self.amount[-1], self.average[1], self.average[-1], since,
            ))


def _replayed(df: DataFrame, cfg: LimitConfig, keys: Sequence[str], of: str, schema: str) -> DataFrame:
    kinds = dict(df.dtypes)

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        replay = LimitReplay(pdf.sort_values(TIME).reset_index(drop=True), cfg)
        replay.run()
        return pd.DataFrame([(*key, *r) for r in getattr(replay, of)], columns=[*keys, *[c.split()[0] for c in schema.split(", ")]])

    return df.groupBy(*keys).applyInPandas(walk, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {schema}")


def limit_reversal_replay(df: DataFrame, cfg: LimitConfig, keys: Sequence[str] = (KEY, "set", "rangeid")) -> DataFrame:
    """Gains of closed trades, from labelled rows with score, high, low and close. Groups run side by side."""
    return _replayed(df, cfg, keys, "gains", GAINS)


def limit_reversal_rows(df: DataFrame, cfg: LimitConfig, keys: Sequence[str] = (KEY, "set", "rangeid")) -> DataFrame:
    """The trade rows of the same replay."""
    return _replayed(df, cfg, keys, "rows", TRADES)


def check_trade_rows(df: DataFrame) -> DataFrame:
    """Rows that break a rule, with the rule."""
    both = (F.col("lp_amount") > 0) & (F.col("sp_amount") > 0)
    rule = (
        F.when(both, "long_and_short").when((F.col("lp_amount") > 0) & (F.col("l_pavg") <= 0), "long_without_price")
        .when((F.col("sp_amount") > 0) & (F.col("s_pavg") <= 0), "short_without_price")
        .when((F.col("lp_amount") + F.col("sp_amount") == 0) & F.col("lastopentrade").isNotNull(), "flat_with_time")
        .when((F.col("lp_amount") > 0) & (F.col("lc_limit") <= 0), "long_without_close")
        .when((F.col("sp_amount") > 0) & (F.col("sc_limit") <= 0), "short_without_close")
    )
    return df.withColumn("rule", rule).where(F.col("rule").isNotNull())


def true_vs_predicted_gains(df: DataFrame, cfg: LimitConfig, keys: Sequence[str] = (KEY, "set", "rangeid")) -> DataFrame:
    """The replay of predicted labels, and of target labels with score 1, tagged by predicted."""
    predicted = limit_reversal_replay(df, cfg, keys).withColumn("predicted", F.lit(True))
    true = df.withColumn("label", F.col("target")).withColumn("score", F.lit(1.0))
    return predicted.unionByName(limit_reversal_replay(true, cfg, keys).withColumn("predicted", F.lit(False)))


def round_trips(fills: DataFrame) -> DataFrame:
    """The i-th buy with the i-th sell of each symbol: quantity, gain percent and amount, win."""
    rows = fills.withColumn("n", F.row_number().over(Window.partitionBy("symbol", "side").orderBy("ts", "fill_id")))
    side = lambda s: rows.where(F.col("side") == s).select("symbol", "n", F.col("price").alias(f"{s}_price"), F.col("quantity").alias(f"{s}_q"))
    both = side("buy").join(side("sell"), ["symbol", "n"]).withColumn("quantity", F.least("buy_q", "sell_q"))
    gain = F.col("sell_price") - F.col("buy_price")
    return both.select(
        "symbol", "n", "quantity", (100 * gain / F.col("buy_price")).alias("gain_pct"), (gain * F.col("quantity")).alias("gain_amount"), (gain > 0).alias("win")
    )


def backtest_report(trips: DataFrame) -> DataFrame:
    """Trips, win rate, mean gain and amount per symbol and overall (symbol null)."""
    return trips.rollup("symbol").agg(
        F.count("*").alias("trips"), F.avg(F.col("win").cast("double")).alias("win_rate"), F.avg("gain_pct").alias("mean_gain_pct"), F.sum("gain_amount").alias("total")
    )


def allocate_budget(signals: DataFrame, minorder: float, maxbudget: float) -> DataFrame:
    """Amount and reason for each signal (opentime, symbol, label, close, position, freequote, equity).

    Each time step shares the capped quote equally over its open signals, by symbol; one that would get less than the
    smallest order is skipped, and each order reduces the rest. A time step has as many rows as there are symbols.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(KEY).reset_index(drop=True)
        opens = pdf["label"].isin(["longopen", "shortopen"])
        held = (pdf["position"] * pdf["close"]).sum()
        capped = min(pdf["freequote"].iloc[0] + held, pdf["equity"].iloc[0], maxbudget)
        orders = min(int(capped // minorder), int(opens.sum()))
        share = capped / orders if orders else 0.0
        amounts, reasons = [], []
        for r, is_open in zip(pdf.itertuples(), opens, strict=True):
            amount, reason = 0.0, "no open"
            if is_open and capped >= minorder and orders:
                amount = min(max(share / r.close - r.position, 0.0), capped / r.close)
                if amount * r.close >= minorder:
                    capped -= amount * r.close
                    reason = "open"
                else:
                    amount, reason = 0.0, "full position"
            elif is_open:
                reason = "insufficient quote"
            amounts.append(amount)
            reasons.append(reason)
        return pdf[[TIME, KEY, "label"]].assign(amount=amounts, reason=reasons)

    return signals.groupBy(TIME).applyInPandas(walk, f"{TIME} timestamp_ntz, {KEY} string, label string, amount double, reason string")


def last_open_trade(df: DataFrame, position: str = "position") -> DataFrame:
    """Time of the row at which the current position was opened; null while there is none."""
    rows = with_islands(df, F.col(position) > 0, "_island")
    opened = F.min(TIME).over(Window.partitionBy(KEY, "_island"))
    return rows.withColumn("lastopentrade", F.when(F.col(position) > 0, opened)).drop("_island")


def carry_order_lane(df: DataFrame, lane: str) -> DataFrame:
    """Lane id and fill carried from the last event while its status is submitted; a finished order clears them."""
    w = running()
    status = F.last(f"{lane}_status", ignorenulls=True).over(w)
    df = df.withColumn("_status", status)
    carried = [F.when(F.col("_status") == "submitted", F.last(f"{lane}_{c}", ignorenulls=True).over(w)).alias(f"{lane}_{c}_now") for c in ("id", "filled")]
    return df.select("*", *carried, F.col("_status").alias(f"{lane}_status_now")).drop("_status")


def flip_plan(df: DataFrame) -> DataFrame:
    """Quantity and limit that close the opposite position before an open."""
    long, short = F.col("label") == "longopen", F.col("label") == "shortopen"
    quantity = F.when(long, F.col("sp_amount")).when(short, F.col("lp_amount")).otherwise(0.0)
    limit = F.when(long, F.col("lo_limit")).when(short, F.col("so_limit"))
    return df.withColumn("flip_quantity", quantity).withColumn("flip_limit", F.when(quantity > 0, limit))


def apply_order_fills(rows: DataFrame, orders: DataFrame, lanes: Sequence[str] = ("lo", "lc", "so", "sc")) -> DataFrame:
    """Lanes with filled amount and average price of their order (orderid, status, executedqty, avgprice); positions move
    by closed orders, not below 0; lanes of finished orders lose their id."""
    for lane in lanes:
        o = orders.select(F.col("orderid").alias(f"{lane}_id"), F.col("status").alias("_st"), F.col("executedqty").alias("_q"), F.col("avgprice").alias("_p"))
        rows = rows.join(o, f"{lane}_id", "left")
        rows = rows.withColumn(f"{lane}_filled", F.coalesce("_q", F.lit(0.0))).withColumn(f"{lane}_pavg", F.coalesce("_p", F.lit(0.0)))
        rows = rows.withColumn(f"{lane}_status", F.col("_st")).drop("_st", "_q", "_p")
    done = lambda lane: F.when(F.col(f"{lane}_status") == "closed", F.col(f"{lane}_filled")).otherwise(0.0)
    rows = rows.withColumn("lp_amount", F.greatest(F.col("lp_amount") + done("lo") - done("lc"), F.lit(0.0)))
    rows = rows.withColumn("sp_amount", F.greatest(F.col("sp_amount") + done("so") - done("sc"), F.lit(0.0)))
    for lane in lanes:
        rows = rows.withColumn(f"{lane}_id", F.when(F.col(f"{lane}_status") == "submitted", F.col(f"{lane}_id")))
    return rows


