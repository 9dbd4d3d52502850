"""What an extension has to offer: feature sets, targets, scorers and row strategies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from tickloom.operators.windows import KEY, TIME


class FeatureSet(Protocol):
    """Columns from bars; required_rows is the history that a row's columns need."""

    required_rows: int

    def columns(self, bars: DataFrame) -> DataFrame: ...


class Target(Protocol):
    """A label or value column from bars."""

    def apply(self, bars: DataFrame) -> DataFrame: ...


class Scorer(Protocol):
    """Score columns from feature columns."""

    def transform(self, features: DataFrame) -> DataFrame: ...


class ExternalScorer:
    """A scorer whose model lives outside Spark: load gives a function from a pandas frame of features to scores.

    load runs once in each task, and the rows pass through it in Arrow batches.
    """

    def __init__(self, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], names: list[str]):
        self.load, self.names = load, names

    def transform(self, features: DataFrame) -> DataFrame:
        load, names = self.load, self.names

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for pdf in batches:
                yield pd.concat([pdf, model(pdf)[names]], axis=1)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema)
        return features.mapInPandas(work, kinds + "".join(f", `{n}` double" for n in names))


def replay_strategy(df: DataFrame, strategy: Callable[[dict, dict], dict], state: dict, names: list[str], keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """A strategy over the rows of each group: it gets the state and a row and gives the next state, whose fields names
    are the row's output."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME).reset_index(drop=True)
        now, out = dict(state), []
        for row in pdf.to_dict("records"):
            now = strategy(now, row)
            out.append([float(now[n]) for n in names])
        return pd.concat([pdf, pd.DataFrame(out, columns=names)], axis=1)

    return df.groupBy(*keys).applyInPandas(walk, kinds + "".join(f", `{n}` double" for n in names))
