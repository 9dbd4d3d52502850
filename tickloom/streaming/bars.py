"""Live forms: bars from ticks, closed candles, features, gates and advice on streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tickloom.operators.bars import merge_bars
from tickloom.operators.features import EPS, supplement
from tickloom.sources.bars import pivot_price


def stream_bars(ticks: DataFrame, minutes: int, watermark: str, price: str = "value", symbol: str = "event_type", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Bars of tumbling windows; a bar is final when the watermark has passed it, later ticks are dropped."""
    at = F.col(ts).cast("timestamp")
    order = F.struct(F.col("_at"), F.col(tie))
    rows = ticks.withColumn("_at", at).withWatermark("_at", watermark)
    out = rows.groupBy(F.window("_at", f"{minutes} minutes"), F.col(symbol).alias("symbol")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.count(price).cast("double").alias("basevolume"),
    )
    out = out.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("opentime"), "open", "high", "low", "close", "basevolume")
    return out.withColumn("pivot", pivot_price())


#: Partition columns of a table that batches are merged into.
DAY, VERSION = "bar_day", "bar_version"


def _newest(rows: DataFrame) -> DataFrame:
    """The rows of each day's newest version. One row for each day is broadcast, some thousands in ten years."""
    newest = rows.groupBy(DAY).agg(F.max(VERSION).alias(VERSION))
    return rows.join(F.broadcast(newest), [DAY, VERSION], "left_semi").drop(DAY, VERSION)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table at path as the batches so far have left it."""
    return _newest(spark.read.parquet(path))


def into_table(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into the table; read it with current().

    The table lies in folders by day and version, the number of the batch that wrote it. A batch reads and writes the days
    that it has bars of, so its cost doesn't grow with the history; a repeated batch starts from the versions before it and
    writes its own again, so nothing is applied twice and nothing is deleted while it is read. Bars without a time are left
    out. Superseded versions stay until they are cleared away.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates().where(F.col("opentime").isNotNull())
        day = F.to_date("opentime")
        stored = batch.limit(0)
        if number:
            days = [r[0] for r in batch.select(day).distinct().collect()]
            layout = StructType([*batch.schema.fields, StructField(DAY, DateType()), StructField(VERSION, LongType())])
            stored = _newest(spark.read.schema(layout).parquet(path).where(F.col(DAY).isin(days) & (F.col(VERSION) < number)))
        merged = merge(stored, batch).withColumn(DAY, day).withColumn(VERSION, F.lit(number).cast("long"))
        # One task writes a day unless it is large.
        out = merged.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(DAY, VERSION).parquet(path)

    return apply


def upsert_closed_candles(candles: DataFrame, path: str) -> DataStreamWriter:
    """Keep one row for each symbol and minute; the candle of the latest batch wins."""
    return candles.writeStream.foreachBatch(into_table(path, lambda old, new: merge_bars(old, new)))


def stream_features(bars: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], halo: int) -> DataStreamWriter:
    """Append work's rows for new bars; of the history only the last halo rows of each symbol are kept and read.

    They lie in two folders in turn: a batch reads the one before's and writes its own, so a repeated batch finds what it
    started from.
    """
    last = Window.partitionBy("symbol").orderBy(F.desc("opentime"))

    def apply(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/halo/{(number - 1) % 2}") if number else batch.limit(0)
        rows = old.unionByName(batch)
        supplement(rows, old, work, halo).write.mode("overwrite").parquet(f"{path}/features/batch={number}")
        kept = rows.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= max(halo, 1)).drop("_n")
        kept.write.mode("overwrite").parquet(f"{path}/halo/{number % 2}")

    return bars.writeStream.foreachBatch(apply)


def gate(rows: pd.DataFrame, last: tuple[float, float] | None, minutes: float, delta: float) -> tuple[list[bool], tuple[float, float] | None]:
    """Which rows (minute, close) classify anew: enough minutes since the last, or the close moved by a share."""
    out = []
    for r in rows.itertuples():
        go = last is None or r.minute - last[0] >= minutes or abs(r.close - last[1]) / max(abs(last[1]), 1e-6) >= delta
        if go:
            last = (float(r.minute), float(r.close))
        out.append(go)
    return out, last


def gate_classification(bars: DataFrame, minutes: float, delta: float) -> DataFrame:
    """symbol, minute, close and classify; the state of a symbol is the last close and time that classified.

    A symbol's rows of a batch are in the memory of one task; gate_batches() takes batches of any size.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("minute")
        go, last = gate(rows, last, minutes, delta)
        state.update(last)
        yield rows.assign(classify=go)[["symbol", "minute", "close", "classify"]]

    return bars.select("symbol", "minute", "close").groupBy("symbol").applyInPandasWithState(
        step, "symbol string, minute double, close double, classify boolean", "minute double, close double", "append", GroupStateTimeout.NoTimeout
    )


NO_LIMITS = {"lo": 0.0, "lc": 0.0, "so": 0.0, "sc": 0.0}


def advised(now: dict[str, float], label: str, score: float, close: float, buygain: float, sellgain: float, openthreshold: float) -> dict[str, float]:
    """The limits after a row, given those before it."""
    side = {"longopen": 1, "shortopen": -1}.get(label, 0) if score >= openthreshold else 0
    if side > 0:
        return now | {"lo": close * (1 - buygain), "lc": close * (1 + sellgain), "so": 0.0}
    if side < 0:
        return now | {"so": close * (1 + buygain), "sc": close * (1 - sellgain), "lo": 0.0}
    return now | {"lo": 0.0, "so": 0.0}


def stream_advice(features: DataFrame, buygain: float, sellgain: float, openthreshold: float) -> DataFrame:
    """Limits from labels and scores (symbol, minute, label, score, close), carried until an open label sets them anew.

    A symbol's rows of a batch are in the memory of one task; advice_batches() takes batches of any size.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else dict(NO_LIMITS)
        rows = pd.concat(list(frames)).sort_values("minute")
        out = []
        for minute, label, score, close in zip(rows["minute"], rows["label"], rows["score"], rows["close"], strict=True):
            now = advised(now, label, score, close, buygain, sellgain, openthreshold)
            out.append((key[0], minute, now["lo"], now["lc"], now["so"], now["sc"]))
        state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=["symbol", "minute", "lo", "lc", "so", "sc"])

    return features.groupBy("symbol").applyInPandasWithState(
        step, "symbol string, minute double, lo double, lc double, so double, sc double", "limits string", "append", GroupStateTimeout.NoTimeout
    )


def feed_heartbeats(events: DataFrame, symbol: str = "event_type", ts: str = "ts") -> DataFrame:
    """Last event time and count of each symbol, for update mode."""
    return events.groupBy(F.col(symbol).alias("symbol")).agg(F.max(ts).alias("last_ts"), F.count("*").alias("n"))


# ---------------------------------------------------------------- order and silence

Step = Callable[[tuple, pd.DataFrame, "str | None"], "tuple[pd.DataFrame, str]"]


def in_order(rows: DataFrame, at: str, delay: str, step: Step, schema: str, key: str = "symbol") -> DataFrame:
    """What step gives for each key's rows in the order of their times, however the batches bring them.

    A row waits in the key's state until the watermark (delay behind the latest time of all keys) has passed it, so rows
    that come late by less than the delay take their place, and later ones are dropped. A timer at the oldest waiting row
    calls on keys that get no new rows. step gets the key, its rows in order and what it returned to remember (a string).
    The rows that wait are in the memory of one task; batches_in_order() keeps them in files, for batches of any size.
    """
    whole = rows.withWatermark(at, delay)
    names = [f.name for f in rows.schema if f.name != at]

    def run(found: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, memory = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], None)
        for frame in frames:
            if len(frame):
                micros = frame[at].astype("datetime64[us]").astype("int64").tolist()
                cells = [[None if v is None or v != v else v for v in frame[c].tolist()] for c in names]
                waiting += [[t, *row] for t, row in zip(micros, zip(*cells, strict=True), strict=True)]
        passed = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda r: (r[0], json.dumps(r)))
        ready = [r for r in waiting if r[0] <= passed * 1000]
        waiting = waiting[len(ready) :]
        if ready:
            frame = pd.DataFrame(ready, columns=[at, *names])
            frame[at] = pd.to_datetime(frame[at], unit="us")
            out, memory = step(found, frame, memory)
            yield out
        state.update((json.dumps(waiting), memory))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, passed + 1))

    return whole.groupBy(key).applyInPandasWithState(run, schema, "waiting string, memory string", "append", GroupStateTimeout.EventTimeTimeout)


#: Column of the rows that keep what a key's step remembers, among the rows that a batch gives.
MEMORY = "_memory"


def batches_in_order(rows: DataFrame, path: str, step: Step, schema: str, at: str, delay: str | None = None, tie: Sequence[str] = (), key: str = "symbol") -> DataStreamWriter:
    """Write what step gives for each key's rows in the order of their times, then tie, for batches of any size; read it with ordered_rows().

    Spark sorts a batch and a task goes through a key's rows some thousands at a time, so step gets a key's rows in pieces, one
    after another, and no task holds a key. Without a delay the rows of a batch are all passed; with one (at is a timestamp)
    a row waits until the latest time of all keys is that much later, and a row that comes later than that is dropped.
    Rows that wait lie in two folders in turn, and what step remembers lies with the rows of each batch: a batch reads
    those of the one before, so a repeated batch finds what it started from.
    """
    layout = StructType([*StructType.fromDDL(schema).fields, StructField(MEMORY, StringType())])
    names = layout.names
    wait = None if delay is None else pd.Timedelta(delay).value // 1000

    def remembered(found: tuple, memory: str) -> pd.DataFrame:
        return pd.DataFrame([[None] * len(names)], columns=names, dtype=object).assign(**{key: found[0], MEMORY: memory})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, memory = None, None
        for frame in frames:
            codes, _ = pd.factorize(frame[key])
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(frame)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                piece = frame.iloc[a:b]
                found = (None if codes[a] < 0 else piece[key].iloc[0],)
                if now is not None and found != now:
                    yield remembered(now, memory)
                if found != now:
                    now, memory = found, None
                kept = piece[MEMORY].notna()
                if kept.any():
                    memory = piece.loc[kept, MEMORY].iloc[0]
                    piece = piece[~kept]
                if len(piece):
                    out, memory = step(now, piece.drop(columns=MEMORY), memory)
                    yield out.assign(**{MEMORY: None})[names]
        if now is not None:
            yield remembered(now, memory)

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = lambda name: f"{path}/{name}/{(number - 1) % 2}"
        ready = batch
        if wait is not None:
            micros = F.unix_micros(at)
            before = spark.read.schema("mark long").parquet(old("mark")).first()[0] if number else None
            top = F.floor(F.max(micros) / 1000) * 1000 - wait
            mark = batch.agg(F.greatest(top, F.lit(before).cast("long")).cast("long").alias("mark")).first()[0]
            every = batch if before is None else batch.where(micros > before)
            if number:
                every = every.unionByName(spark.read.schema(batch.schema).parquet(old("waiting")))
            ready = every.where(micros <= F.lit(mark).cast("long"))
            every.where(micros > F.lit(mark).cast("long")).write.mode("overwrite").parquet(f"{path}/waiting/{number % 2}")
            spark.range(0, 1, 1, 1).select(F.lit(mark).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{path}/mark/{number % 2}")
        ready = ready.withColumn(MEMORY, F.lit(None).cast("string"))
        if number:
            last = spark.read.schema(layout).parquet(f"{path}/rows/batch={number - 1}").where(F.col(MEMORY).isNotNull())
            ready = ready.unionByName(last.select(key, MEMORY), allowMissingColumns=True)
        # What a key remembers comes before its rows.
        ordered = ready.repartition(key).sortWithinPartitions(key, F.col(MEMORY).isNull(), F.asc_nulls_last(at), *tie)
        ordered.mapInPandas(run, layout).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return rows.writeStream.foreachBatch(apply)


def ordered_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that the batches of batches_in_order() have given so far."""
    layout = StructType([*StructType.fromDDL(schema).fields, StructField(MEMORY, StringType())])
    return spark.read.schema(layout).parquet(f"{path}/rows").where(F.col(MEMORY).isNull()).drop(MEMORY, "batch")


def gate_schema(at: str) -> str:
    return f"symbol string, {at} {'double' if at == 'minute' else 'timestamp'}, close double, classify boolean"


def gate_batches(bars: DataFrame, path: str, minutes: float, delta: float, at: str = "minute", delay: str | None = None, tie: Sequence[str] = ()) -> DataStreamWriter:
    """gate_classification() (at is minute) or gate_in_order() (a timestamp, with a delay), as batches_in_order() of gate_schema()."""

    def step(key: tuple, frame: pd.DataFrame, memory: str | None) -> tuple[pd.DataFrame, str]:
        rows = pd.DataFrame({"minute": frame["_minute"].to_numpy(), "close": frame["close"].to_numpy()})
        go, last = gate(rows, tuple(json.loads(memory)) if memory else None, minutes, delta)
        return frame.assign(symbol=key[0], classify=go)[["symbol", at, "close", "classify"]], json.dumps(last)

    time = F.col(at) if at == "minute" else F.col(at).cast("timestamp")
    minute = time if at == "minute" else F.unix_micros(time) / 6e7
    rows = bars.select("symbol", time.alias(at), minute.alias("_minute"), F.col("close").cast("double").alias("close"), *tie)
    return batches_in_order(rows, path, step, gate_schema(at), at, delay, tie)


def advice_schema(at: str) -> str:
    return f"symbol string, {at} {'double' if at == 'minute' else 'timestamp'}, lo double, lc double, so double, sc double"


def advice_batches(
    features: DataFrame, path: str, buygain: float, sellgain: float, openthreshold: float, at: str = "minute", delay: str | None = None, tie: Sequence[str] = ()
) -> DataStreamWriter:
    """stream_advice() (at is minute) or limits_in_order() (a timestamp, with a delay), as batches_in_order() of advice_schema()."""

    def step(key: tuple, frame: pd.DataFrame, memory: str | None) -> tuple[pd.DataFrame, str]:
        now, out = json.loads(memory) if memory else dict(NO_LIMITS), []
        for label, score, close in zip(frame["label"], frame["score"], frame["close"], strict=True):
            now = advised(now, label, score, close, buygain, sellgain, openthreshold)
            out.append((now["lo"], now["lc"], now["so"], now["sc"]))
        found = pd.DataFrame(out, columns=["lo", "lc", "so", "sc"], index=frame.index)
        return found.assign(symbol=key[0], **{at: frame[at]}), json.dumps(now)

    time = F.col(at) if at == "minute" else F.col(at).cast("timestamp")
    rows = features.select("symbol", time.alias(at), "label", F.col("score").cast("double").alias("score"), F.col("close").cast("double").alias("close"), *tie)
    return batches_in_order(rows, path, step, advice_schema(at), at, delay, tie)


def gate_in_order(bars: DataFrame, minutes: float, delta: float, delay: str, at: str = "opentime") -> DataFrame:
    """gate_classification() by time: symbol, opentime, close and classify, as a pass over all bars in order gives them."""

    def step(key: tuple, frame: pd.DataFrame, memory: str | None) -> tuple[pd.DataFrame, str]:
        last = tuple(json.loads(memory)) if memory else None
        rows = frame.assign(minute=frame[at].astype("datetime64[us]").astype("int64") / 60e6)
        go, last = gate(rows, last, minutes, delta)
        return frame.assign(symbol=key[0], classify=go)[["symbol", at, "close", "classify"]], json.dumps(last)

    rows = bars.select("symbol", F.col(at).cast("timestamp").alias(at), F.col("close").cast("double").alias("close"))
    return in_order(rows, at, delay, step, f"symbol string, {at} timestamp, close double, classify boolean")


def stale_feeds(events: DataFrame, minutes: float, delay: str, symbol: str = "event_type", ts: str = "ts") -> DataFrame:
    """symbol, last_ts and stale: a row when a symbol has had no event for so many minutes of event time, and when it is back.

    A silent symbol sends no row, so a timer reports it, once the events of the others have taken the watermark that far.
    """
    limit = int(minutes * 60_000)
    rows = events.select(F.col(symbol).alias("symbol"), F.col(ts).cast("timestamp").alias("_at")).where("_at is not null").withWatermark("_at", delay)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (0, False)
        before, out = last, []
        for frame in frames:
            if len(frame):
                last = max(last, int(frame["_at"].astype("datetime64[us]").astype("int64").max()))
        if told and last > before:
            out.append((key[0], last, False))
            told = False
        due = last // 1000 + limit
        if not told and due <= state.getCurrentWatermarkMs():
            out.append((key[0], last, True))
            told = True
        state.update((last, told))
        if not told:
            state.setTimeoutTimestamp(due)
        if out:
            found = pd.DataFrame(out, columns=["symbol", "last_ts", "stale"])
            yield found.assign(last_ts=pd.to_datetime(found["last_ts"], unit="us"))

    return rows.groupBy("symbol").applyInPandasWithState(
        run, "symbol string, last_ts timestamp, stale boolean", "last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


class Ring:
    """The last bars of a symbol, and the features of feature_set_v6() of each bar that is added.

    Sums are taken over the bars of each window as they stand in the ring, so a bar costs as much as its longest window and
    nothing is stored but the ring.
    """

    FIELDS = ("open", "high", "low", "close", "pivot", "basevolume")

    def __init__(self, specs: Sequence[tuple[str, int, int]], volumes: Sequence[tuple[int, int]], rows: list[list[float]] | None = None):
        self.specs, self.volumes, self.rows = specs, volumes, rows or []
        self.size = max([w + o for _, w, o in specs] + [long for _, long in volumes])

    def add(self, bar: Sequence[float]) -> list[float | None]:
        self.rows = [*self.rows, list(bar)][-self.size :]
        held = np.array(self.rows, float)
        return [self._feature(held, *s) for s in self.specs] + [self._volume(held, *v) for v in self.volumes]

    def _feature(self, held: np.ndarray, kind: str, w: int, offset: int) -> float | None:
        pivot = held[-1, 4]
        if kind in ("mind", "maxd"):
            part = held[: max(len(held) - offset, 0)][-w:]
            if not len(part):
                return None
            edge = part[:, 2].min() if kind == "mind" else part[:, 1].max()
            return _share(pivot - edge, pivot)
        past = held[: max(len(held) - offset, 0)][-w:]
        if not len(past):
            return None
        slope, last = _line(past[:, 4])
        if kind == "ry":
            return _share(past[-1, 4] - last, past[-1, 4])
        if kind == "rg":
            return slope
        n = len(past)
        line = last + slope * (np.arange(n) - (n - 1))
        residual = (past[:, :4] - line[:, None]).ravel()
        return float(residual.std(ddof=1)) if residual.size > 1 else 0.0

    def _volume(self, held: np.ndarray, short: int, long: int) -> float:
        below = float(np.median(held[-long:, 5]))
        return float(np.median(held[-short:, 5])) / (below if below else EPS)


def _share(a: float, b: float) -> float | None:
    return float(a / b) if b else None


def _line(y: np.ndarray) -> tuple[float, float]:
    """Slope of the regression line of y over its places, and its value at the last one."""
    n = len(y)
    if n == 1:
        return 0.0, float(y[0])
    x = np.arange(n) - (n - 1) / 2
    slope = float((x * (y - y[-1])).sum() / (x * x).sum())
    return slope, float(y.mean() + slope * (n - 1) / 2)


def live_features(bars: DataFrame, specs: Sequence[tuple[str, int, int]], volumes: Sequence[tuple[int, int]], delay: str) -> DataFrame:
    """feature_set_v6() of a stream of bars, in their order of time, by symbol: the state is a ring of the last bars.

    Nothing is written but the state that the stream's checkpoint keeps, so a restart goes on where it was; bars that are
    late by less than delay take their place, later ones are dropped. A bar's features come once the watermark has passed it.
    """
    names = [f"{k}{w}_{o}" for k, w, o in specs] + [f"rv_{s}_{long}" for s, long in volumes]

    def step(key: tuple, frame: pd.DataFrame, memory: str | None) -> tuple[pd.DataFrame, str]:
        ring = Ring(specs, volumes, json.loads(memory) if memory else None)
        cells = [ring.add(row) for row in frame[list(Ring.FIELDS)].to_numpy(float).tolist()]
        out = pd.DataFrame(cells, columns=names, dtype=float)
        out.insert(0, "opentime", frame["opentime"].to_numpy())
        out.insert(0, "symbol", key[0])
        return out, json.dumps(ring.rows)

    rows = bars.select("symbol", F.col("opentime").cast("timestamp").alias("opentime"), *[F.col(c).cast("double").alias(c) for c in Ring.FIELDS])
    return in_order(rows, "opentime", delay, step, "symbol string, opentime timestamp, " + ", ".join(f"{n} double" for n in names))


def limits_in_order(rows: DataFrame, buygain: float, sellgain: float, openthreshold: float, delay: str, at: str = "opentime") -> DataFrame:
    """stream_advice() by time: limits from labels and scores (symbol, opentime, label, score, close), as one pass over all rows gives them."""

    def step(key: tuple, frame: pd.DataFrame, memory: str | None) -> tuple[pd.DataFrame, str]:
        now = json.loads(memory) if memory else dict(NO_LIMITS)
        out = []
        for t, label, score, close in zip(frame[at], frame["label"], frame["score"], frame["close"], strict=True):
            now = advised(now, label, score, close, buygain, sellgain, openthreshold)
            out.append((key[0], t, now["lo"], now["lc"], now["so"], now["sc"]))
        return pd.DataFrame(out, columns=["symbol", at, "lo", "lc", "so", "sc"]), json.dumps(now)

    some = rows.select("symbol", F.col(at).cast("timestamp").alias(at), "label", F.col("score").cast("double").alias("score"), F.col("close").cast("double").alias("close"))
    return in_order(some, at, delay, step, f"symbol string, {at} timestamp, lo double, lc double, so double, sc double")
