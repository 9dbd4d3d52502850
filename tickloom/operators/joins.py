"""Lookups and joins in time, and comparisons of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.chunks import carried


def asof_lookup(df: DataFrame, ts: str) -> DataFrame:
    """Last row of each symbol at or before a time."""
    names = [c for c in df.columns if c != "symbol"]
    rows = df.where(F.col("opentime") <= F.lit(ts).cast("timestamp_ntz"))
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*names), "opentime").alias("r")).select("symbol", "r.*")


def asof_join(left: DataFrame, right: DataFrame, on: str = "opentime", by: str = "symbol", forward: bool = False, suffix: str = "_r") -> DataFrame:
    """left with the columns of the last row of right at or before its time (forward: first at or after).

    Both sides are united and sorted inside buckets of time of each key; what a bucket ends (begins) with is carried over the
    buckets, so nothing is multiplied and a key with a large share of all rows is spread over its buckets. right's columns
    get the suffix; they are null where right has no such row.
    """
    values = [c for c in right.columns if c != by]
    found = _united(left, right, on, by, suffix, {"_r": ("_right", forward)}, forward)
    return found.select("_l.*", *[F.col(f"_r.{c}{suffix}").alias(f"{c}{suffix}") for c in values])


def _united(left: DataFrame, right: DataFrame, on: str, by: str, suffix: str, carry: dict[str, tuple[str, bool]], left_first: bool) -> DataFrame:
    """The rows of left (_l) with what is carried to them from right's rows (column _right)."""
    values = [c for c in right.columns if c != by]
    lrow = F.struct(*[F.col(c) for c in left.columns])
    rrow = F.struct(*[F.col(c).alias(f"{c}{suffix}") for c in values])
    ltype, rtype = left.select(lrow.alias("x")).schema["x"].dataType, right.select(rrow.alias("x")).schema["x"].dataType
    both = left.select(F.col(by).alias("_k"), F.col(on).alias("_t"), F.lit(1).alias("_s"), lrow.alias("_l"), F.lit(None).cast(rtype).alias("_right"))
    both = both.unionByName(right.select(F.col(by).alias("_k"), F.col(on).alias("_t"), F.lit(0).alias("_s"), F.lit(None).cast(ltype).alias("_l"), rrow.alias("_right")))
    # Among equal times right rows come first, or, to be found ahead, last.
    return carried(both, "_k", "_t", [-F.col("_s") if left_first else F.col("_s")], carry).where("_s = 1")


def nearest_row(left: DataFrame, right: DataFrame, on: str = "opentime", by: str = "symbol") -> DataFrame:
    """At or before; before the first row of right, the first one. Both directions are carried in one pass."""
    found = _united(left, right, on, by, "", {"_b": ("_right", False), "_f": ("_right", True)}, False)
    values = [c for c in right.columns if c != by]
    some = F.col("_b").isNotNull()
    return found.select("_l.*", *[F.when(some, F.col(f"_b.{c}")).otherwise(F.col(f"_f.{c}")).alias(f"{c}_r") for c in values])


def with_range(df: DataFrame, ranges: DataFrame, by: Sequence[str], on: str, start: str, end: str, values: Sequence[str]) -> DataFrame:
    """df with the values of the range (start to end, both included) of its keys that holds the row's on; null outside.

    The ranges of a key don't overlap. Rows and ranges are united and shuffled once, and the last range that began is
    carried along, so a row meets one range only, however many there are.
    """
    found, held = _last_range(df, ranges, by, on, start, F.struct(F.col(end).alias("end"), *values), lambda c, w: F.last(c, ignorenulls=True).over(w))
    inside = F.col(f"{held}.end") >= F.col("_t")
    return found.select("_l.*", *[F.when(inside, F.col(f"{held}.{v}")).alias(v) for v in values])


def in_some_range(df: DataFrame, ranges: DataFrame, by: Sequence[str], on: str, start: str, end: str) -> DataFrame:
    """Rows whose on lies in a range of its keys; ranges may overlap: the latest end of those that began decides."""
    found, held = _last_range(df, ranges, by, on, start, F.struct(F.col(end).alias("end")), lambda c, w: F.max(c).over(w))
    return found.where(F.col(f"{held}.end") >= F.col("_t")).select("_l.*")


def _last_range(df: DataFrame, ranges: DataFrame, by: Sequence[str], on: str, start: str, value: Column, carried) -> tuple[DataFrame, str]:
    row = F.struct(*[F.col(c) for c in df.columns])
    rows_type, range_type = df.select(row.alias("x")).schema["x"].dataType, ranges.select(value.alias("x")).schema["x"].dataType
    keys = [f"_k{i}" for i in range(len(by))]
    names = lambda t: [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)] + [t.alias("_t")]
    both = df.select(*names(F.col(on)), F.lit(1).alias("_s"), row.alias("_l"), F.lit(None).cast(range_type).alias("_r"))
    both = both.unionByName(ranges.select(*names(F.col(start)), F.lit(0).alias("_s"), F.lit(None).cast(rows_type).alias("_l"), value.alias("_r")))
    w = Window.partitionBy(*keys).orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_r", carried(F.col("_r"), w)).where("_s = 1"), "_r"


def align_features_prices(features: DataFrame, bars: DataFrame) -> DataFrame:
    return features.join(bars, ["symbol", "opentime"])


def merge_feature_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows and columns of both; where new has a value, it wins."""
    keys = ["symbol", "opentime"]
    names = list(dict.fromkeys([*old.columns, *new.columns]))
    renamed = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys])
    joined = old.join(renamed, keys, "full_outer")
    pick = lambda c: F.coalesce(*[F.col(x) for x in (f"_new_{c}", c) if x in joined.columns]).alias(c)
    return joined.select(*keys, *[pick(c) for c in names if c not in keys])


def compare_trade_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str], atol: float = 1e-6) -> DataFrame:
    """Keys of either side with <field>_eq for each field and match_all."""
    kinds = dict(a.dtypes)
    left = a.select(*keys, *[F.col(f).alias(f"{f}_a") for f in fields], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(f).alias(f"{f}_b") for f in fields], F.lit(True).alias("_b"))
    joined = left.join(right, list(keys), "full_outer")

    def equal(f: str) -> Column:
        x, y = F.col(f"{f}_a"), F.col(f"{f}_b")
        near = x.eqNullSafe(y)
        if kinds[f] in ("double", "float"):
            near = near | F.coalesce(F.abs(x - y) <= atol, F.lit(False))
        return near & F.col("_a").isNotNull() & F.col("_b").isNotNull()

    joined = joined.select(*keys, *[equal(f).alias(f"{f}_eq") for f in fields])
    everything = F.lit(True)
    for f in fields:
        everything = everything & F.col(f"{f}_eq")
    return joined.withColumn("match_all", everything)


def portfolio_value(balances: DataFrame, prices: DataFrame, min_value: float = 0.0) -> DataFrame:
    """Value of each balance (free + locked - borrowed) at the coin's last price; coins without price count 1 to 1."""
    joined = balances.join(prices.select("coin", "lastprice"), "coin", "left")
    amount = F.col("free") + F.col("locked") - F.col("borrowed")
    out = joined.withColumn("value", amount * F.coalesce("lastprice", F.lit(1.0)))
    return out.where(F.abs("value") >= min_value)


def missing_close_orders(balances: DataFrame, orders: DataFrame, min_quantity: float) -> DataFrame:
    """Holdings that open closing orders don't cover: coin, held, ordered and gap."""
    open_orders = orders.where(F.col("status") == "submitted").groupBy("coin").agg(F.sum("quantity").alias("ordered"))
    joined = balances.groupBy("coin").agg(F.sum("free").alias("held")).join(open_orders, "coin", "left")
    joined = joined.withColumn("ordered", F.coalesce("ordered", F.lit(0.0))).withColumn("gap", F.col("held") - F.col("ordered"))
    return joined.where(F.col("gap") >= min_quantity)


def join_config(kpi: DataFrame, configs: DataFrame) -> DataFrame:
    return kpi.join(configs, "cfgid", "left")


def register_configs(existing: DataFrame, new: DataFrame, parameters: Sequence[str], digits: int = 6) -> DataFrame:
    """existing and the configurations that it lacks, these with ids after the largest one.

    The configurations are a parameter grid: few rows, whatever the data.
    """
    kinds = dict(new.dtypes)
    rounded = [F.round(F.col(p), digits).alias(p) if kinds[p] in ("double", "float") else F.col(p) for p in parameters]
    known = existing.select(*rounded)
    fresh = new.select(*rounded).distinct().join(known, list(parameters), "left_anti")
    top = existing.agg(F.coalesce(F.max("cfgid"), F.lit(0)).alias("_top"))
    number = F.row_number().over(Window.orderBy(*parameters))
    added = fresh.withColumn("_n", number).join(F.broadcast(top)).withColumn("cfgid", (F.col("_top") + F.col("_n")).cast("int"))
    return existing.select("cfgid", *rounded).unionByName(added.select("cfgid", *parameters))


def exclude_symbols(df: DataFrame, blacklist: DataFrame, holdings: DataFrame) -> DataFrame:
    """Without blacklisted symbols, unless they are held."""
    return df.join(blacklist.join(holdings, "symbol", "left_anti"), "symbol", "left_anti")


def target_overlay(bounds: DataFrame, bars: DataFrame, targets: DataFrame, start: str, end: str) -> DataFrame:
    """Bars of a time slice with predicted bounds and targets where there are any."""
    at = F.col("opentime")
    cut = bars.where((at >= F.lit(start).cast("timestamp_ntz")) & (at <= F.lit(end).cast("timestamp_ntz")))
    return cut.join(bounds, ["symbol", "opentime"], "left").join(targets, ["symbol", "opentime"], "left")


def reattach_prices(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Missing pivots of stored predictions from the bars."""
    prices = bars.select("symbol", "opentime", F.col("pivot").alias("_pivot"))
    joined = predictions.join(prices, ["symbol", "opentime"], "left")
    return joined.withColumn("pivot", F.coalesce("pivot", "_pivot")).drop("_pivot")
