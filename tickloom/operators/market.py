"""Market view, selection of symbols, portfolio and account."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.scalar import split_pair
from tickloom.operators.bars import quote_volume
from tickloom.operators.dataset import concat_coin_tables
from tickloom.operators.joins import asof_join, asof_lookup
from tickloom.operators.replay import last_open_trade
from tickloom.operators.windows import KEY, TIME, number_rows, with_sliding_sum
from tickloom.sources.bars import epoch_minute

DAY = 1440


def rolling_quote_volume_24h(df: DataFrame) -> DataFrame:
    """Quote volume (close times volume) of the 24 hours up to each row, the row 24 hours ago left out.

    The running sum less the running sum of that time, which is its largest value so far as volumes aren't negative; so
    dense bars cost no more for each row than sparse ones.
    """
    w = Window.partitionBy(KEY).orderBy("_minute")
    rows = df.withColumn("_minute", epoch_minute(F.col(TIME)))
    rows = rows.withColumn("_sum", F.sum(quote_volume("close")).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    before = F.max("_sum").over(w.rangeBetween(Window.unboundedPreceding, -DAY))
    return rows.withColumn("quotevolume24h", F.col("_sum") - F.coalesce(before, F.lit(0.0))).drop("_minute", "_sum")


def price_change_24h(df: DataFrame) -> DataFrame:
    """Percent change against the first close at or after 24 hours ago, found by one lookup; 0 if that isn't positive."""
    minute = epoch_minute(F.col(TIME))
    then = df.select(KEY, minute.alias("_then"), F.col("close").alias("_first"))
    rows = asof_join(df.withColumn("_then", minute - DAY), then, on="_then", forward=True, suffix="_ago")
    first = F.col("_first_ago")
    change = F.when(first > 0, (F.col("close") - first) / first * 100).otherwise(0.0)
    return rows.withColumn("pricechangepercent", change).drop("_then", "_then_ago", "_first_ago")


def market_snapshot(df: DataFrame, ts: str) -> DataFrame:
    """Per symbol the 24-hour volume and change and the last close at a time. Only the last day's rows are read on."""
    at = F.lit(ts).cast("timestamp_ntz")
    recent = df.where((F.col(TIME) <= at) & (F.col(TIME) >= at - F.expr("INTERVAL 2 DAYS")))
    rows = price_change_24h(rolling_quote_volume_24h(recent))
    return asof_lookup(rows, ts).select(KEY, "quotevolume24h", "pricechangepercent", F.col("close").alias("lastprice"))


def continuous_liquidity_now(df: DataFrame, ts: str, minquotevol: float, accumulate: int, checkperiod: int, limit: float) -> DataFrame:
    """Whether fewer than limit * checkperiod of a symbol's last checkperiod rows lack volume."""
    at = F.lit(ts).cast("timestamp_ntz")
    rows = number_rows(df.where(F.col(TIME) <= at))
    rows = with_sliding_sum(rows.withColumn("_qv", quote_volume()), F.col("_qv"), accumulate, "volume")
    last = F.col("_n") - F.col("rn") < checkperiod
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(KEY)))
    bad = rows.where(last).groupBy(KEY).agg(F.count_if(F.round("volume", 6) < minquotevol).alias("bad"), F.count("*").alias("n"))
    return bad.select(KEY, (F.col("bad") + checkperiod - F.col("n")).alias("bad"), ((F.col("bad") + checkperiod - F.col("n")) < limit * checkperiod).alias("liquid"))


def trade_selection(snapshot: DataFrame, holdings: DataFrame, blacklist: DataFrame, accepted: DataFrame, minquotevolume: float) -> DataFrame:
    """Flags of each symbol, and whether opening and closing is enabled."""
    flag = lambda df, name: df.select(KEY).distinct().withColumn(name, F.lit(True))
    out = snapshot
    for df, name in ((holdings, "inportfolio"), (blacklist, "blacklisted"), (accepted, "accepted")):
        out = out.join(flag(df, name), KEY, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    out = out.withColumn("minquotevol", F.col("quotevolume24h") >= minquotevolume)
    opened = F.col("minquotevol") & F.col("accepted") & ~F.col("blacklisted")
    return out.withColumn("openenabled", opened).withColumn("closeenabled", F.col("inportfolio"))


def screen_market(tickers: DataFrame, quotes: Sequence[str], quote: str, minvolume: float, ignored: DataFrame) -> DataFrame:
    """Pairs of a quote coin with enough volume, without ignored bases."""
    base, q = split_pair(F.col("pair"), quotes)
    rows = tickers.withColumn("base", base).withColumn("quote", q)
    rows = rows.where((F.col("quote") == quote) & (F.col("quotevolume24h") >= minvolume))
    return rows.join(ignored.select("base"), "base", "left_anti")


def portfolio_total(assets: DataFrame) -> DataFrame:
    return assets.groupBy("account").agg(F.sum("value").alias("total"))


def quote_value(balances: DataFrame, quote: str) -> DataFrame:
    amount = F.col("free") + F.col("locked") - F.col("borrowed")
    return balances.groupBy("account").agg(F.sum(F.when(F.col("coin") == quote, amount).otherwise(0.0)).alias("quote_value"))


def sync_trades_rows(bars: DataFrame, orders: DataFrame, balances: DataFrame) -> DataFrame:
    """Latest row of each symbol with its position, its open orders by lane, and when the position was opened."""
    rows = bars.join(balances.select(KEY, TIME, "position"), [KEY, TIME], "left").fillna(0.0, ["position"])
    rows = last_open_trade(rows)
    latest = rows.groupBy(KEY).agg(F.max_by(F.struct(TIME, "high", "low", "close", "position", "lastopentrade"), TIME).alias("r")).select(KEY, "r.*")
    lanes = orders.where("status = 'submitted'").groupBy(KEY).pivot("lane", ["lo", "lc", "so", "sc"]).agg(F.max("limitprice"))
    return latest.join(lanes, KEY, "left")


def collect_trades(tables: Sequence[DataFrame]) -> DataFrame:
    return concat_coin_tables(tables).orderBy("coin", "set", "rangeid", "opentime")


TRADE_DEFAULTS = {"lo": 0.0, "lc": 0.0, "so": 0.0, "sc": 0.0, "position": 0.0, "score": 0.0, "label": "ignore"}


def trades_schema(df: DataFrame) -> DataFrame:
    """Missing columns of a trades table with their defaults; nulls in them too."""
    for name, default in TRADE_DEFAULTS.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default))
    return df


def net_positions(positions: DataFrame) -> DataFrame:
    """Long and short quantity of each coin from raw rows: side as text, or the sign of the size."""
    short = (F.lower("side") == "sell") | (F.lower("side") == "short") | (F.col("side").isNull() & (F.col("size") < 0))
    size = F.abs("size")
    return positions.groupBy("coin").agg(F.sum(F.when(short, 0.0).otherwise(size)).alias("long"), F.sum(F.when(short, size).otherwise(0.0)).alias("short"))


def merge_borrowed(balances: DataFrame, positions: DataFrame) -> DataFrame:
    """Balances with short quantities counted as borrowed; coins of either table."""
    joined = balances.join(net_positions(positions), "coin", "full_outer")
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.select("coin", value("free").alias("free"), (value("borrowed") + value("short")).alias("borrowed"), value("long").alias("long"))


def account_capacity(balances: DataFrame, quote: str, leverage: float = 1.0) -> DataFrame:
    """Equity, free quote, and capacity for long and short orders of each account, none below 0."""
    amount = F.col("free") + F.col("locked") - F.col("borrowed")
    free = F.when(F.col("coin") == quote, F.least(F.col("free"), F.col("available")))
    out = balances.groupBy("account").agg(F.sum(amount * F.col("price")).alias("equity"), F.coalesce(F.sum(free), F.lit(0.0)).alias("freequote"))
    floor = lambda c: F.greatest(c, F.lit(0.0))
    return out.select(
        "account", "equity", floor(F.col("freequote")).alias("freequote"), floor(F.least("freequote", "equity")).alias("long_capacity"),
        floor(F.least(F.col("freequote") * leverage, F.col("equity") * leverage)).alias("short_capacity"),
    )
