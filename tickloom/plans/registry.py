"""Register of queries with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.features import rolling_regression
from tickloom.sources.bars import event_bars, lineitem_bars, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


#: Moves ties of the last digit up before rounding, so that sums in another order round alike.
TIE = 1e-4


def whole(x: Column) -> Column:
    """The nearest whole number, of two the one away from zero as in DuckDB (rint takes the even one)."""
    near = F.rint(x)
    return near + F.when((x > 0) & (x - near == 0.5), 1.0).when((x < 0) & (x - near == -0.5), -1.0).otherwise(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS digits, without negative zeros. From 2**40 on, TIE is too small to move a number off the middle."""
    digits = lambda c: whole(F.col(f"`{c}`") * 10.0**DIGITS + TIE) / 10.0**DIGITS + F.lit(0.0)
    return df.select(*[digits(c).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query; doubles names the columns that the SQL has to round like rounded()."""

    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            names = doubles.split()
            # pivot is a keyword of DuckDB.
            text = re.sub(r"""(?<!["'\w])pivot(?!["'\w])""", '"pivot"', sql)
            names = ['"pivot"' if n == "pivot" else n for n in names]
            parts = ", ".join(f"round({c}::DOUBLE * 1e{DIGITS}::DOUBLE + {TIE}::DOUBLE) / 1e{DIGITS}::DOUBLE + 0.0::DOUBLE AS {c}" for c in names)
            SQL[name] = f"SELECT * REPLACE ({parts}) FROM ({text})" if names else text
        return f

    return register


def _ticks(bucket: str) -> str:
    return f"""bars0 AS (SELECT event_type AS symbol, {bucket} AS opentime, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
  min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS basevolume FROM events WHERE value IS NOT NULL GROUP BY ALL),
bars AS (SELECT *, (open + high + low + close) / 4 AS pivot, row_number() OVER (PARTITION BY symbol ORDER BY opentime) AS rn FROM bars0)"""


HOURS = "WITH " + _ticks("date_trunc('hour', ts)")
MINUTES = "WITH " + _ticks("date_trunc('minute', ts)")
DAYS = """WITH ticks AS (SELECT p_brand AS symbol, l_shipdate::TIMESTAMP AS ts, l_orderkey, l_linenumber, l_extendedprice::DOUBLE / l_quantity::DOUBLE AS price,
  l_quantity::DOUBLE AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
bars0 AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS opentime, first(price ORDER BY ts, l_orderkey, l_linenumber) AS open, max(price) AS high,
  min(price) AS low, last(price ORDER BY ts, l_orderkey, l_linenumber) AS close, sum(quantity) AS basevolume FROM ticks GROUP BY ALL),
bars AS (SELECT *, (open + high + low + close) / 4 AS pivot, row_number() OVER (PARTITION BY symbol ORDER BY opentime) AS rn FROM bars0)"""
W = "PARTITION BY symbol ORDER BY opentime"


def line_sql(w: int, source: str = "bars") -> str:
    """CTE line: regry and grad of the last w rows by DuckDB's regression aggregates."""
    frame = f"OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"""line AS (SELECT *, CASE WHEN rn = 1 THEN 0 ELSE regr_slope(pivot, rn) {frame} END AS grad,
  CASE WHEN rn = 1 THEN pivot ELSE regr_slope(pivot, rn) {frame} * rn + regr_intercept(pivot, rn) {frame} END AS regry FROM {source})"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir, 60)


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir, 1)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_bars(spark, sf_dir)


def lined(spark: SparkSession, sf_dir: str, windows: tuple[int, ...] = (24,)) -> DataFrame:
    return rolling_regression(hours(spark, sf_dir), "pivot", windows, ["pivot"])


table = read_table
