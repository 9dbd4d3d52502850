"""Column functions on prices, times, labels and scores."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Trade labels and their codes.
LABEL_CODES = {
    "shortstrongopen": -5, "shortopen": -4, "shorthold": -3, "shortclose": -2, "shortstrongclose": -1, "allclose": 0,
    "longstrongclose": 1, "longclose": 2, "longhold": 3, "longopen": 4, "longstrongopen": 5, "ignore": 9,
}
PHASES = {"down": -1, "flat": 0, "up": 1, "choppy": 2}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column, b: Column) -> Column:
    """a over b; null where b is 0."""
    return F.try_divide(a, b)


def normalize_to_last(df: DataFrame, column: str, percent: bool = False, out: str = "normalized") -> DataFrame:
    """Value over the symbol's last value, less 1."""
    last = df.groupBy("symbol").agg(F.max_by(column, "opentime").alias("_last"))
    share = ratio(col(column), F.col("_last")) - 1
    return df.join(last, "symbol").withColumn(out, share * 100 if percent else share).drop("_last")


def time_cut(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "opentime") -> DataFrame:
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))


def relative_gain(start: Column, end: Column, fee: float = 0.0, forward: bool = True) -> Column:
    start, end = start * (1 + fee), end * (1 - fee)
    return ratio(end - start, start if forward else end)


def relative_gain_regr(regry: Column, grad: Column, window: int, fee: float = 0.0, forward: bool = True) -> Column:
    return relative_gain(regry - grad * (window - 1), regry, fee, forward)


def gain_between(base: Column, test: Column) -> Column:
    """Difference over the size of the base price."""
    return ratio(test - base, F.abs(base))


def relative_time(ts: Column, kind: str) -> Column:
    """Share of the day, of the week (Monday 1/7) or of the year, rounded half-even to four digits; times by the minute."""
    if kind == "day":
        return F.bround((F.hour(ts) * 60 + F.minute(ts)) / F.lit(1440.0), 4)
    if kind == "week":
        return F.bround((F.weekday(ts) + 1) / F.lit(7.0), 4)
    return F.bround(F.dayofyear(ts) / F.lit(365.0), 4)


def period_label(minutes: int) -> str:
    for size, unit in ((40320, "M"), (10080, "w"), (1440, "d"), (60, "h")):
        if minutes % size == 0:
            return f"{minutes // size}{unit}"
    return f"{minutes}m"


def split_pair(symbol: Column, quotes: Sequence[str]) -> tuple[Column, Column]:
    """Base and quote of a concatenated pair; null if it ends with none of the quotes."""
    pattern = f"^(.+)({'|'.join(sorted(quotes, key=len, reverse=True))})$"
    part = lambda i: F.nullif(F.regexp_extract(symbol, pattern, i), F.lit(""))
    return part(1), part(2)


def base_token(token: Column, quote: str) -> Column:
    """BTC of BTC/USDT, BTCUSDT, BTC-USDT or btc; null for an empty token and for the quote itself."""
    t = F.upper(F.trim(token))
    t = F.split(F.split(t, "/")[0], "-")[0]
    t = F.when(t.endswith(quote) & (F.length(t) > len(quote)), F.regexp_replace(t, f"{quote}$", "")).otherwise(t)
    return F.when((t == "") | (t == quote), None).otherwise(t)


def parse_label(text: Column) -> Column:
    """A known label in lower case; buy and sell in older names mean open and close; anything else is allclose."""
    t = F.lower(F.trim(text))
    t = F.regexp_replace(F.regexp_replace(t, "buy$", "open"), "sell$", "close")
    return F.when(t.isin(*LABEL_CODES), t).otherwise("allclose")


def label_code(label: Column) -> Column:
    return F.create_map(*[x for k, v in LABEL_CODES.items() for x in (F.lit(k), F.lit(v))])[label]


def label_from_code(code: Column) -> Column:
    return F.create_map(*[x for k, v in LABEL_CODES.items() for x in (F.lit(v), F.lit(k))])[code]


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int) -> DataFrame:
    """Products of all combinations of 2 to degree columns, named a*b."""
    return df.select("*", *[_product(c).alias("*".join(c)) for n in range(2, degree + 1) for c in combinations(columns, n)])


def _product(columns: Sequence[str]) -> Column:
    out = F.col(columns[0])
    for c in columns[1:]:
        out = out * F.col(c)
    return out


def score_bin(score: Column, bins: int) -> Column:
    """1 to bins; null for null and NaN."""
    return F.when(~F.isnan(score), F.least(F.greatest(F.floor(score * bins) + 1, F.lit(1)), F.lit(bins)).cast("int"))


def bin_bounds(bin_number: Column, bins: int) -> tuple[Column, Column]:
    return (bin_number - 1) / F.lit(float(bins)), bin_number / F.lit(float(bins))


def low_high_to_center_width(low: Column, high: Column, base: Column | None = None) -> tuple[Column, Column]:
    """Centre and width; relative to base if one is given."""
    center, width = (low + high) / 2, high - low
    return (center, width) if base is None else (ratio(center - base, base), ratio(width, base))


def center_width_to_low_high(center: Column, width: Column, base: Column | None = None) -> tuple[Column, Column]:
    """Inverse; lows are at least 0."""
    if base is not None:
        center, width = base * (1 + center), base * width
    return F.greatest(center - width / 2, F.lit(0.0)), center + width / 2


def ratio_targets(center: Column, width: Column, pivot: Column) -> tuple[Column, Column]:
    """Relative to pivot; null where pivot isn't positive."""
    ok = pivot > 0
    return F.when(ok, (center - pivot) / pivot), F.when(ok, width / pivot)


def denormalize_bounds(center: Column, width: Column, pivot: Column) -> tuple[Column, Column]:
    ok = pivot > 0
    return F.when(ok, pivot * (1 + center)), F.when(ok, pivot * width)


def invalid_reason(score: Column) -> Column:
    """Why a score can't be one; null if it can."""
    return (
        F.when(score.isNull(), "missing").when(F.isnan(score), "nan").when(F.abs(score) == float("inf"), "infinite")
        .when((score < 0) | (score > 1), "range")
    )


def validate_scores(df: DataFrame, score: str = "score") -> DataFrame:
    """The first invalid score of each symbol with its reason."""
    bad = df.withColumn("reason", invalid_reason(F.col(score))).where(F.col("reason").isNotNull())
    return bad.groupBy("symbol").agg(F.min("opentime").alias("opentime"), F.min_by("reason", "opentime").alias("reason"))


TIME_NAMES = ("opentime", "open_time", "timestamp", "time", "datetime")


def canonical_time_column(df: DataFrame) -> DataFrame:
    found = next((c for c in TIME_NAMES if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {', '.join(TIME_NAMES)} is a column")
    return df.withColumnRenamed(found, "opentime")


def relative_price_delta(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-6))


def should_update_price(current: Column, wanted: Column, share: float) -> Column:
    return F.when(current.isNull(), True).otherwise(relative_price_delta(wanted, current) >= share)


def center_width_features(df: DataFrame, center: str, width: str) -> DataFrame:
    return df.withColumn("lower", F.col(center) - F.col(width) / 2).withColumn("upper", F.col(center) + F.col(width) / 2)


def encode_tokens(df: DataFrame, column: str, out: str = "token_id") -> DataFrame:
    """Ids from 1 in the order of the distinct tokens; the vocabulary is a table, joined by token."""
    vocab = df.select(column).distinct().withColumn(out, F.row_number().over(Window.orderBy(column)))
    return df.join(vocab, column)


def decode_order_lanes(trades: DataFrame) -> DataFrame:
    """Fills of the four lanes of each row: closed orders with a filled amount and an average price."""
    lanes = {"lo": "buy", "lc": "sell", "so": "sell", "sc": "buy"}
    kinds = [
        F.struct(F.lit(k).alias("lane"), F.lit(side).alias("side"), F.col(f"{k}_status").alias("status"),
                 F.col(f"{k}_filled").alias("filled"), F.col(f"{k}_pavg").alias("price"))
        for k, side in lanes.items()
    ]
    rows = trades.select("symbol", "opentime", F.explode(F.array(*kinds)).alias("f")).select("symbol", "opentime", "f.*")
    return rows.where((F.col("status") == "closed") & (F.col("filled") > 0) & (F.col("price") > 0)).drop("status")
