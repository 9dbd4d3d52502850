"""Window primitives: prefix sums, block extremes, latches, islands, halo chunks.

Spark evaluates a sliding frame of w rows anew for each row. Sums over long frames therefore come from running sums and
their value w rows back, extremes from running extremes of blocks of w rows; both cost the same for any w.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tickloom.sources.bars import epoch_minute

KEY, TIME = "symbol", "opentime"


def ordered(*keys: str, by: Sequence[str] = (TIME,)) -> WindowSpec:
    return Window.partitionBy(*(keys or (KEY,))).orderBy(*by)


def running(*keys: str, by: Sequence[str] = (TIME,)) -> WindowSpec:
    return ordered(*keys, by=by).rowsBetween(Window.unboundedPreceding, 0)


def number_rows(df: DataFrame, *keys: str, name: str = "rn", by: Sequence[str] = (TIME,)) -> DataFrame:
    return df.withColumn(name, F.row_number().over(ordered(*keys, by=by)))


def sliding_sum(column: Column, w: int, *keys: str, by: Sequence[str] = (TIME,)) -> tuple[Column, Callable[[str], Column]]:
    """Two steps: the running sum (to be added as a column), and from its name the sum of the last w rows."""
    return F.sum(column).over(running(*keys, by=by)), lambda name: F.col(name) - F.coalesce(F.lag(name, w).over(ordered(*keys, by=by)), F.lit(0))


def with_sliding_sum(df: DataFrame, column: Column, w: int, out: str, *keys: str) -> DataFrame:
    total, difference = sliding_sum(column, w, *keys)
    return df.withColumn(f"_{out}", total).withColumn(out, difference(f"_{out}")).drop(f"_{out}")


def with_sliding_extreme(df: DataFrame, column: str, w: int, out: str, largest: bool, *keys: str, ahead: bool = False) -> DataFrame:
    """Largest or smallest value of the last w rows (fewer at the start); with ahead, of the row and the w - 1 after it.

    Rows are cut into blocks of w. A frame is the end of one block and the start of the next, so its extreme is that of
    the next block's running extreme and the previous block's extreme from the frame's start on.
    """
    keys = keys or (KEY,)
    pick = F.max if largest else F.min
    both = F.greatest if largest else F.least
    if w <= 32:
        frame = ordered(*keys).rowsBetween(0, w - 1) if ahead else ordered(*keys).rowsBetween(-(w - 1), 0)
        return df.withColumn(out, pick(column).over(frame))
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(TIME))) if ahead else F.row_number().over(ordered(*keys))
    df = df.withColumn("_rn", row).withColumn("_block", F.floor((F.col("_rn") - 1) / w))
    inside = Window.partitionBy(*keys, "_block").orderBy("_rn")
    df = df.withColumn("_head", pick(column).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    against = Window.partitionBy(*keys, "_block").orderBy(F.desc("_rn"))
    df = df.withColumn("_tail", pick(column).over(against.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn(out, both("_head", F.lag("_tail", w - 1).over(Window.partitionBy(*keys).orderBy("_rn"))))
    return df.drop("_rn", "_block", "_head", "_tail")


def latch(set_when: Column, reset_when: Column, *keys: str, by: Sequence[str] = (TIME,)) -> Column:
    """True from a row that sets until a row that resets; setting wins in a row that does both."""
    event = F.when(set_when, True).when(reset_when, False)
    return F.coalesce(F.last(event, ignorenulls=True).over(running(*keys, by=by)), F.lit(False))


def with_islands(df: DataFrame, state: Column, out: str, *keys: str, by: Sequence[str] = (TIME,)) -> DataFrame:
    """Number of the run of equal states that the row is in."""
    before = F.lag("_state").over(ordered(*keys, by=by))
    df = df.withColumn("_state", state).withColumn("_new", (~F.col("_state").eqNullSafe(before)).cast("int"))
    return df.withColumn(out, F.sum("_new").over(running(*keys, by=by))).drop("_state", "_new")


def in_chunks(df: DataFrame, work: Callable[[DataFrame], DataFrame], minutes: int, halo_minutes: int) -> DataFrame:
    """work on chunks of time in parallel, each with the rows of halo_minutes before it; halo rows are dropped.

    For operators whose frames reach back at most halo_minutes on bars without gaps. work gets the column chunk beside
    symbol and must partition its windows by both. One symbol then keeps many tasks busy.
    """
    minute = epoch_minute(F.col(TIME))
    chunk, last = F.floor(minute / minutes), F.floor((minute + halo_minutes) / minutes)
    spread = df.withColumn("_own", chunk).withColumn("chunk", F.explode(F.sequence(chunk, last)))
    return work(spread).where(F.col("chunk") == F.col("_own")).drop("chunk", "_own")
