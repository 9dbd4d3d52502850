"""Features of bars: rolling regression, deviation, extremes, volumes, lookbacks."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tickloom.functions.scalar import ratio, relative_time
from tickloom.operators.chunks import medians, with_halo
from tickloom.operators.windows import KEY, TIME, number_rows, ordered, running, with_islands, with_sliding_extreme

EPS = 1.1920929e-07  # of single precision: stands for a long-window volume of zero


#: Windows up to so many times smaller share the blocks of the largest one. Smallest blocks: small ones cost time, and sums
#: over some hundred rows still have their digits.
SHARED, SMALLEST = 64, 512


def _sums(df: DataFrame, columns: Sequence[str], keys: tuple[str, ...], size: int) -> DataFrame:
    """Sums of y, k * y and y * y of each column from the start of the row's block (_s, _x, _q) and to its end (_es, _ex, _eq).

    Blocks have size rows; k counts from 1 in each, and y is less the first value of the first column in the block (_0).
    Sums that begin anew in each block stay small, so their differences keep their digits on histories of any length.
    """
    inside = Window.partitionBy(*keys, "_b").orderBy("_i")
    so_far, whole = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("_b", F.floor((F.col("_i") - 1) / size)).withColumn("_k", (F.col("_i") - F.col("_b") * size).cast("double"))
    df = df.withColumn("_0", F.first(columns[0]).over(so_far))
    sums = {}
    for c in columns:
        y = F.col(c) - F.col("_0")
        sums |= {f"_y_{c}": y, f"_s_{c}": F.sum(y).over(so_far), f"_x_{c}": F.sum(F.col("_k") * y).over(so_far), f"_q_{c}": F.sum(y * y).over(so_far)}
    df = df.withColumns(sums)
    return df.withColumns({f"_e{k}_{c}": F.last(f"_{k}_{c}").over(whole) - F.col(f"_{k}_{c}") for k in "sxq" for c in columns})


def _in_window(columns: Sequence[str], keys: tuple[str, ...], w: int, size: int) -> dict[str, Column]:
    """Sums over the last w rows: y, p * y (p counts from 1 in the window) and y * y, y less the _0 of the last row.

    The window's rows lie in the row's block or in that one and the block before.
    """
    back = Window.partitionBy(*keys).orderBy("_b", "_i")
    k = F.col("_k")
    n = F.least(F.col("_i"), F.lit(w)).cast("double")
    inside, across = F.coalesce(k > w, F.lit(False)), (k < w) & (F.col("_i") > w)
    d = F.lag("_0", w).over(back) - F.col("_0")
    m = n - k  # rows of the block before
    out = {}
    for c in columns:
        now, old = ({name: F.lag(f"_{name}_{c}", w).over(back) for name in names} for names in (("s", "x", "q"), ("es", "ex", "eq")))
        s, x, q = (F.col(f"_{name}_{c}") - F.when(inside, now[name]).otherwise(0.0) for name in "sxq")
        out[f"s_{c}"] = s + F.when(across, old["es"] + m * d).otherwise(0.0)
        shifted = old["ex"] - (k - n + size) * old["es"] + d * m * (m + 1) / 2
        out[f"x_{c}"] = x - (k - n) * s + F.when(across, shifted).otherwise(0.0)
        out[f"q_{c}"] = q + F.when(across, old["eq"] + 2 * d * old["es"] + m * d * d).otherwise(0.0)
    return out


def rolling_regression(
    df: DataFrame, column: str, windows: Sequence[int], std_of: Sequence[str] | None = None, keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """regry_w and grad_w for each window: end value and slope of the least-squares line over the last w rows.

    At the start the line goes through all rows so far; the first row has its own value and slope 0. std_of adds std_w,
    the sample deviation of these columns from the line, with mean_w and last_w of the residuals. Everything comes from
    sums that begin anew in blocks of the window's size or a few times more, so neither the cost depends on the window
    nor the digits on the length of the history.
    """
    keys = tuple(keys)
    columns = list(dict.fromkeys([column, *(std_of or ())]))
    out, names = number_rows(df, *keys, name="_i"), list(df.columns)
    left = sorted(set(windows), reverse=True)
    while left:
        size = max(left[0], SMALLEST)
        shared = [w for w in left if w * SHARED > size or w == left[0] or size == SMALLEST]
        left = [w for w in left if w not in shared]
        out = _sums(out, columns, keys, size)
        for w in shared:
            out = _line(out, column, columns, std_of, keys, w, size)
            names += [f"regry_{w}", f"grad_{w}", *([f"std_{w}", f"mean_{w}", f"last_{w}"] if std_of else [])]
            out = out.select(*dict.fromkeys([*names, *(c for c in out.columns if c.startswith("_"))]))
        out = out.select(*names, "_i")
    order = [f"{kind}_{w}" for w in windows for kind in (("regry", "grad", "std", "mean", "last") if std_of else ("regry", "grad"))]
    return out.select(*df.columns, *dict.fromkeys(order))


def _line(
    df: DataFrame, column: str, columns: Sequence[str], std_of: Sequence[str] | None, keys: tuple[str, ...], w: int, size: int
) -> DataFrame:
    """The columns of rolling_regression() for one window."""
    part = {name: f"_w{name}" for k in "sxq" for name in (f"{k}_{c}" for c in columns)}
    df = df.withColumns({part[name]: value for name, value in _in_window(columns, keys, w, size).items()})
    n = F.least(F.col("_i"), F.lit(w)).cast("double")
    sy, sky = F.col(part[f"s_{column}"]), F.col(part[f"x_{column}"])
    slope = (sky - (n + 1) / 2 * sy) / (n * (n * n - 1) / 12)
    df = df.withColumn(f"grad_{w}", F.when(n > 1, slope).otherwise(0.0))
    b = F.col(f"grad_{w}")
    df = df.withColumn("_line", sy / n + b * (n - 1) / 2).withColumn(f"regry_{w}", F.col("_0") + F.col("_line"))
    if not std_of:
        return df
    # Residuals r = y - (a + b p), p = 1 to n: their sum and sum of squares.
    a = F.col("_line") - b * n
    total = count = square = F.lit(0.0)
    sp, spp = n * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 6
    for c in std_of:
        sy, sky, syy = (F.col(part[f"{k}_{c}"]) for k in "sxq")
        total = total + sy - a * n - b * sp
        square = square + syy - 2 * a * sy - 2 * b * sky + a * a * n + 2 * a * b * sp + b * b * spp
        count = count + n
    variance = F.greatest(square - total * total / count, F.lit(0.0)) / (count - 1)
    return df.withColumns({
        f"std_{w}": F.when(count > 1, F.sqrt(variance)).otherwise(0.0), f"mean_{w}": total / count,
        f"last_{w}": F.col(f"_y_{std_of[-1]}") - F.col("_line"),
    })


def norm_rolling_regression(df: DataFrame, column: str, windows: Sequence[int]) -> DataFrame:
    out = rolling_regression(df, column, windows)
    for w in windows:
        out = out.withColumn(f"regry_{w}", ratio(F.col(f"regry_{w}"), F.col(column))).withColumn(f"grad_{w}", ratio(F.col(f"grad_{w}"), F.col(column)))
    return out


def rolling_medians(df: DataFrame, column: str, windows: dict[str, int], keys: Sequence[str] = (KEY,)) -> DataFrame:
    """For each name the median of the last so many rows, fewer at the start; rows without a value don't count.

    Chunks of rows, with a halo of the longest window, are worked on side by side, and a chunk's medians come from the ranks
    of its values in steps that don't depend on the window (chunks.Ranks).
    """

    def work(table: pa.Table) -> dict[str, pa.Array]:
        values = table.column("_median_of").to_numpy()
        return {name: pa.array(medians(values, w), from_pandas=True) for name, w in windows.items()}

    rows = df.withColumn("_median_of", F.coalesce(F.col(column).cast("double"), F.lit(float("nan"))))
    return with_halo(rows, max(windows.values()) - 1, work, [(n, DoubleType()) for n in windows], keys).drop("_median_of")


def rolling_median(df: DataFrame, column: str, w: int, out: str, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Median of the last w rows, fewer at the start."""
    return rolling_medians(df, column, {out: w}, keys)


def relative_volume(df: DataFrame, short: int, long: int, out: str | None = None) -> DataFrame:
    """Median volume of the short window over that of the long one; a zero below counts as EPS; negative volumes fail."""
    volume = F.when(F.col("basevolume") < 0, F.raise_error(F.lit("negative volume"))).otherwise(F.col("basevolume"))
    df = rolling_medians(df.withColumn("_v", volume), "_v", {"_short": short, "_long": long})
    share = F.col("_short") / F.when(F.col("_long") == 0, F.lit(EPS)).otherwise(F.col("_long"))
    return df.withColumn(out or f"rv_{short}_{long}", share).drop("_v", "_short", "_long")


def extreme_distances(df: DataFrame, w: int, offset: int = 0, of_extreme: bool = False) -> DataFrame:
    """mind and maxd: distance of pivot to the lowest low and highest high of the window that ended offset rows ago.

    Relative to pivot; with of_extreme to the lowest and highest pivot themselves (the older form).
    """
    low, high = ("pivot", "pivot") if of_extreme else ("low", "high")
    df = with_sliding_extreme(with_sliding_extreme(df, low, w, "_low", False), high, w, "_high", True)
    back = lambda c: F.lag(c, offset).over(ordered()) if offset else F.col(c)
    df = df.withColumn("_low", back("_low")).withColumn("_high", back("_high"))
    base = lambda c: F.col(c) if of_extreme else F.col("pivot")
    df = df.withColumn(f"mind{w}_{offset}", ratio(F.col("pivot") - F.col("_low"), base("_low")))
    return df.withColumn(f"maxd{w}_{offset}", ratio(F.col("pivot") - F.col("_high"), base("_high"))).drop("_low", "_high")


def regression_features(df: DataFrame, specs: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Columns <kind><window>_<offset>: ry (distance of pivot to the line over pivot), rg (slope), rs (deviation)."""
    windows = sorted({w for _, w, _ in specs})
    out = rolling_regression(df, "pivot", windows, ["open", "high", "low", "close"])
    source = {"ry": lambda w: ratio(F.col("pivot") - F.col(f"regry_{w}"), F.col("pivot")), "rg": lambda w: F.col(f"grad_{w}"), "rs": lambda w: F.col(f"std_{w}")}
    for kind, w, _ in specs:
        out = out.withColumn(f"_{kind}{w}", source[kind](w))
    shifted = [(F.lag(f"_{k}{w}", o).over(ordered()) if o else F.col(f"_{k}{w}")).alias(f"{k}{w}_{o}") for k, w, o in specs]
    return out.select(*df.columns, *shifted)


def lookback(df: DataFrame, column: str, n: int, fill: float | None = None) -> DataFrame:
    """Value n rows earlier; before the first row the fill value, or the first one. Name: column and two digits."""
    first = F.first(column).over(running()) if fill is None else F.lit(fill)
    return df.withColumn(f"{column}{n:02d}", F.coalesce(F.lag(column, n).over(ordered()), first))


def delta_ohlc(df: DataFrame, lookbacks: int) -> DataFrame:
    """Distances of open, high, low and close from the bar's pivot, 0 to lookbacks - 1 rows back, over the current pivot."""
    w = ordered()
    made = []
    for k in range(lookbacks):
        for c in ("open", "high", "low", "close"):
            delta = F.col(c) - F.col("pivot")
            made.append(ratio(F.coalesce(F.lag(delta, k).over(w), F.lit(0.0)), F.col("pivot")).alias(f"{c}{k:02d}"))
    return df.select(*df.columns, *made)


def regression_lookbacks(df: DataFrame, windows: Sequence[int], n: int) -> DataFrame:
    """Slope and distance from the line of each window, at steps of the window's length, over the current pivot."""
    out = rolling_regression(df, "pivot", windows)
    made = []
    for w in windows:
        for k in range(n):
            at = lambda c, k=k, w=w: F.lag(c, k * w).over(ordered())
            made.append(ratio(at(F.col(f"grad_{w}")), F.col("pivot")).alias(f"grad{w}_{k:02d}"))
            made.append(ratio(at(F.col("pivot") - F.col(f"regry_{w}")), F.col("pivot")).alias(f"disty{w}_{k:02d}"))
    return out.select(*df.columns, *made)


def regression_acceleration(df: DataFrame, grad: str, out: str = "acceleration") -> DataFrame:
    """Change of the slope, summed up since its direction last turned; 0 where it doesn't change."""
    change = F.coalesce(F.col(grad) - F.lag(grad).over(ordered()), F.lit(0.0))
    df = df.withColumn("_change", change).withColumn("_sign", F.signum("_change"))
    df = with_islands(df, F.col("_sign"), "_island")
    inside = Window.partitionBy(KEY, "_island").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum("_change").over(inside)).drop("_change", "_sign", "_island")


def turns(df: DataFrame, grad: str) -> DataFrame:
    """turn: 1 in the last row before the slope falls, -1 before it rises, else 0. A zero slope keeps the direction."""
    sign = F.last(F.when(F.col(grad) != 0, F.signum(grad)), ignorenulls=True).over(running())
    df = df.withColumn("_dir", F.coalesce(sign, F.lit(0.0)))
    after = F.lead("_dir").over(ordered())
    turn = F.when((F.col("_dir") > 0) & (after < 0), 1).when((F.col("_dir") < 0) & (after > 0), -1).otherwise(0)
    return df.withColumn("turn", turn).drop("_dir")


def last_extreme_distance(df: DataFrame, grad: str, price: str) -> DataFrame:
    """Relative price and rows since the last maximum and the last minimum before the row; null before the first."""
    df = number_rows(turns(df, grad), name="_rn")
    w = ordered().rowsBetween(Window.unboundedPreceding, -1)
    for name, sign in (("max", 1), ("min", -1)):
        seen = F.last(F.when(F.col("turn") == sign, F.struct("_rn", F.col(price).alias("p"))), ignorenulls=True).over(w)
        df = df.withColumn("_seen", seen)
        df = df.withColumn(f"rows_since_{name}", F.col("_rn") - F.col("_seen._rn"))
        df = df.withColumn(f"dist_{name}", ratio(F.col("_seen.p") - F.col(price), F.col(price))).drop("_seen")
    return df.drop("_rn", "turn")


def last_gain_loss(df: DataFrame, grad: str, price: str) -> DataFrame:
    """Relative change of the last finished rise and of the last finished fall."""
    df = turns(df, grad)
    w = ordered().rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("turn") != 0, F.col(price)), ignorenulls=True).over(w)
    df = df.withColumn("_swing", F.when(F.col("turn") != 0, ratio(F.col(price) - before, before)))
    for name, sign in (("last_gain", 1), ("last_loss", -1)):
        df = df.withColumn(name, F.last(F.when(F.col("turn") == sign, F.col("_swing")), ignorenulls=True).over(running()))
    return df.drop("_swing", "turn")


def regression_bands(df: DataFrame, w: int) -> DataFrame:
    out = rolling_regression(df, "pivot", [w], ["pivot"]).select(*df.columns, F.col(f"regry_{w}").alias("regry"), F.col(f"std_{w}").alias("std"))
    for k in (1, 2):
        out = out.withColumn(f"upper{k}", F.col("regry") + k * F.col("std")).withColumn(f"lower{k}", F.col("regry") - k * F.col("std"))
    return out


def regression_line(df: DataFrame, price: str = "pivot") -> DataFrame:
    """Start and end of the least-squares line through all rows of a symbol."""
    rows = number_rows(df)
    out = rows.groupBy(KEY).agg(
        F.regr_slope(price, "rn").alias("slope"), F.regr_intercept(price, "rn").alias("b"), F.max("rn").alias("n")
    )
    return out.select(KEY, (F.col("b") + F.col("slope")).alias("start_y"), (F.col("b") + F.col("slope") * F.col("n")).alias("end_y"))


def required_minutes(specs: Sequence[tuple[str, int, int]]) -> int:
    return max(w + o for _, w, o in specs)


def feature_set_v4(df: DataFrame, windows: Sequence[int] = (60, 240, 720, 1440, 4320, 14400)) -> DataFrame:
    """regry, grad and std of all windows, from the row on at which the largest is complete."""
    out = rolling_regression(df, "pivot", windows, ["open", "high", "low", "close"])
    names = [f"{k}_{w}" for w in windows for k in ("regry", "grad", "std")]
    return number_rows(out, name="_rn").where(F.col("_rn") >= max(windows)).select(KEY, TIME, *names)


def parse_specs(texts: Sequence[str]) -> list[tuple[str, tuple[int, ...], int]]:
    """rw_60_grad_3, mm_60_3, rv_5_60 as kind, windows and offset."""
    out = []
    for text in texts:
        parts = text.split("_")
        numbers = [int(p) for p in parts[1:] if p.isdigit()]
        if parts[0] == "rw":
            out.append((f"rw_{parts[2]}", (numbers[0],), numbers[1] if len(numbers) > 1 else 0))
        elif parts[0] == "mm":
            out.append(("mm", (numbers[0],), numbers[1] if len(numbers) > 1 else 0))
        elif parts[0] == "rv":
            out.append(("rv", tuple(numbers[:2]), numbers[2] if len(numbers) > 2 else 0))
        else:
            raise ValueError(f"unknown feature {text}")
    return out


def feature_set_v5(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Columns by text specs; relative volumes use the volume."""
    specs = parse_specs(texts)
    windows = sorted({w[0] for k, w, _ in specs if k.startswith("rw")})
    out = rolling_regression(df, "pivot", windows, ["open", "high", "low", "close"]) if windows else df
    made = []
    for text, (kind, w, o) in zip(texts, specs, strict=True):
        if kind.startswith("rw"):
            source = {"rw_regry": f"regry_{w[0]}", "rw_grad": f"grad_{w[0]}", "rw_std": f"std_{w[0]}"}[kind]
            made.append((F.lag(source, o).over(ordered()) if o else F.col(source)).alias(text))
        elif kind == "mm":
            out = extreme_distances(out, w[0], o, of_extreme=True)
            made += [F.col(f"mind{w[0]}_{o}").alias(f"{text}_mindist"), F.col(f"maxd{w[0]}_{o}").alias(f"{text}_maxdist")]
        else:
            out = relative_volume(out, w[0], w[1], f"_{text}")
            made.append((F.lag(f"_{text}", o).over(ordered()) if o else F.col(f"_{text}")).alias(text))
    return out.select(KEY, TIME, *made)


def feature_set_v6(df: DataFrame, specs: Sequence[tuple[str, int, int]], volumes: Sequence[tuple[int, int]] = (), kept: Sequence[str] = (KEY, TIME)) -> DataFrame:
    """ry, rg, rs, mind and maxd specs (kind, window, offset), and relative volumes (short, long), behind the columns kept."""
    lines = [s for s in specs if s[0] in ("ry", "rg", "rs")]
    out = regression_features(df, lines) if lines else df
    for w, o in sorted({(w, o) for k, w, o in specs if k in ("mind", "maxd")}):
        out = extreme_distances(out, w, o)
    for s, long in volumes:
        out = relative_volume(out, s, long)
    return out.select(*kept, *[f"{k}{w}_{o}" for k, w, o in specs], *[f"rv_{s}_{long}" for s, long in volumes])


def feature_set_v2(df: DataFrame, windows: Sequence[int], volumes: Sequence[tuple[int, int]] = ((1, 60), (5, 240))) -> DataFrame:
    """regry, grad and std of many windows, turning rows of each slope, and relative volumes."""
    out = rolling_regression(df, "pivot", windows, ["open", "high", "low", "close"])
    for w in windows:
        out = turns(out, f"grad_{w}").withColumnRenamed("turn", f"turn_{w}")
    for s, long in volumes:
        out = relative_volume(out, s, long)
    names = [f"{k}_{w}" for w in windows for k in ("regry", "grad", "std", "turn")]
    return out.select(KEY, TIME, *names, *[f"rv_{s}_{long}" for s, long in volumes])


def feature_vector_12x(df: DataFrame, focus: int, others: Sequence[int], volume: tuple[int, int]) -> DataFrame:
    """12 lookbacks of the focus window, single ones of the others, price deltas, relative volume and times."""
    out = delta_ohlc(df, 12) if focus == 1 else regression_lookbacks(df, [focus], 12)
    out = regression_lookbacks(out, list(others), 1)
    out = relative_volume(out, *volume)
    for kind in ("day", "week"):
        out = out.withColumn(f"rel_{kind}", relative_time(F.col(TIME), kind))
    return out


def supplement(bars: DataFrame, stored: DataFrame, work, halo: int) -> DataFrame:
    """work's rows that are newer than each symbol's stored ones, computed from these and halo rows before them."""
    last = stored.groupBy(KEY).agg(F.max(TIME).alias("_last"))
    rows = bars.join(last, KEY, "left")
    new = F.col("_last").isNull() | (F.col(TIME) > F.col("_last"))
    rows = rows.withColumn("_new", new).withColumn("_after", F.sum(F.col("_new").cast("int")).over(running()))
    total = F.count("*").over(Window.partitionBy(KEY))
    rows = number_rows(rows, name="_rn").withColumn("_fresh", F.sum(F.col("_new").cast("int")).over(Window.partitionBy(KEY)))
    rows = rows.withColumn("_n", total).where(F.col("_rn") > F.col("_n") - F.col("_fresh") - halo)
    made = work(rows.select(*bars.columns))
    return made.join(last, KEY, "left").where(new).drop("_last")


