"""Every registered query against its SQL, or for the others that it gives rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, connection, differences
from tickloom.plans.registry import DIGITS, QUERIES, SQL, TIE, rounded

#: Checkers that find nothing in right results.
MAY_BE_EMPTY = {"t8_check_trend_labels", "c4_target_issues", "r10_check_trade_rows"}


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert len(theirs) or name in MAY_BE_EMPTY
    assert differences(ours, theirs) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, name):
    rows = QUERIES[name](spark, DATA).count()
    assert rows == 0 if name in {"t8_check_trend_labels", "c4_target_issues", "r10_check_trade_rows"} else rows > 0


def test_rounding_equals_that_of_the_sql(spark, con):
    """Minutes of events more than two years on, of which one in sixty lies in the middle of two sixth digits."""
    micros = [n * k for n in (-1, 1) for k in (*range(0, 600, 5), *range(102_000_000_000_000, 102_000_000_003_000, 5))]
    ours = rounded(spark.createDataFrame([(m, m / 6e7) for m in micros], "micros long, minute double")).toPandas()
    theirs = con.execute(f"SELECT micros, round(micros / 6e7::DOUBLE * 1e{DIGITS}::DOUBLE + {TIE}::DOUBLE) / 1e{DIGITS}::DOUBLE + 0.0::DOUBLE AS minute FROM (SELECT unnest(?) AS micros)", [micros]).df()
    assert ours.sort_values("micros")["minute"].tolist() == theirs.sort_values("micros")["minute"].tolist()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
