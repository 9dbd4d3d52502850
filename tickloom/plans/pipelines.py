"""Whole pipelines and presets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.bars import liquid_ranges, slice_ranges
from tickloom.operators.dataset import assign_partitions
from tickloom.operators.features import feature_set_v6
from tickloom.operators.targets import Thresholds, trend_regression_target
from tickloom.operators.windows import number_rows


@dataclass(frozen=True)
class TrendPreset:
    """What a training table is made from."""

    features: tuple[tuple[str, int, int], ...] = (("ry", 24, 0), ("rg", 24, 0), ("rs", 24, 0), ("mind", 24, 0), ("maxd", 24, 0), ("rg", 6, 0))
    volumes: tuple[tuple[int, int], ...] = ((3, 24),)
    window: int = 24
    thresholds: Thresholds = Thresholds(longopen=0.05, shortopen=-0.05)
    minquotevol: float = 600.0
    accumulate: int = 4
    checkperiod: int = 24
    startthreshold: float = 0.3
    stopthreshold: float = 0.6
    minliquidrows: int = 48
    pattern: tuple[str, ...] = ("train", "test", "train", "train", "eval", "train")
    size: int = 20
    gap: int = 4


PRESETS = {
    "hourly": TrendPreset(),
    "hourly_wide": TrendPreset(features=(("ry", 24, 0), ("rg", 24, 0), ("rg", 24, 24), ("rs", 24, 0), ("rg", 72, 0)), window=48),
    "minute": TrendPreset(
        features=(("ry", 60, 0), ("rg", 60, 0), ("rg", 240, 0), ("rs", 240, 0), ("mind", 1440, 0), ("maxd", 1440, 0)), volumes=((5, 240),), window=60,
        checkperiod=1440, minliquidrows=10080, size=1440, gap=60,
    ),
}


def features_targets(bars: DataFrame, preset: TrendPreset = PRESETS["hourly"]) -> DataFrame:
    """The training table: liquid ranges, features, regression target and sets of each symbol.

    Features and target are computed in one chain on all bars of a symbol, so that no row is joined with the one it came from,
    then cut to its liquid ranges.
    """
    ranges = liquid_ranges(bars, preset.minquotevol, preset.accumulate, preset.checkperiod, preset.startthreshold, preset.stopthreshold, preset.minliquidrows)
    ranges = ranges.withColumn("rangeid", F.row_number().over(Window.partitionBy("symbol").orderBy("start_rn")))
    rows = feature_set_v6(bars, preset.features, preset.volumes, kept=bars.columns)
    names = [c for c in rows.columns if c not in bars.columns]
    rows = trend_regression_target(rows, preset.window, preset.thresholds.longopen, preset.thresholds.shortopen)
    rows = rows.select("symbol", "opentime", *names, *[c for c in rows.columns if c not in ("symbol", "opentime", *names)])
    rows = slice_ranges(rows, ranges.select("symbol", F.col("rangeid").alias("liquidid"), "start_ts", "end_ts"))
    rows = number_rows(rows, "symbol", "liquidid")
    return assign_partitions(rows, preset.pattern, preset.size, preset.gap, preset.size // 2, 2 * preset.size, ("symbol", "liquidid"))


def feature_columns(preset: TrendPreset = PRESETS["hourly"]) -> list[str]:
    return [f"{k}{w}_{o}" for k, w, o in preset.features] + [f"rv_{s}_{long}" for s, long in preset.volumes]
