"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 4 << 20
#: ASCII white space as the operators define it: blank and \x09 to \x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder, the one that the session names in spark.checkpoint.dir, and go on from there."""
    _folder(df.sparkSession)
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the checkpoint folder that nothing else uses."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """As cut, but as Parquet: smaller for rows with texts, and later steps read only the columns that they use."""
    path = new_folder(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of about limit bytes of the column; a longer single row is a piece of its own."""
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
            start = held = 0
            for i, size in enumerate(sizes):
                if held and held + size > limit:
                    yield batch.slice(start, i - start)
                    start, held = i, 0
                held += size
            if len(sizes) > start:
                yield batch.slice(start)
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system. A worker stays for the tasks of later stages, which need theirs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Bits of the map of marked rows, for each of them and at most (16 MB).
MARK_BITS, MOST_BITS = 16, 1 << 27
_BUCKET = 32768


def maybe_among(ids: DataFrame, name: str) -> Callable[[Column], Column]:
    """A condition on an id that holds for all of ids (column name) and for few others, to sift rows before a join decides.

    The ids are marked in a map of bits of a bounded size, which is broadcast. With more ids than the map has room for, more
    rows pass; none of ids ever fails.
    """
    count = ids.count()
    bits = min(MOST_BITS, 1 << max(16, (MARK_BITS * count).bit_length()))
    place = F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(bits))
    marks = ids.groupBy(F.floor(place / _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg((place % _BUCKET).cast("long")).alias("bits")).collect()
    held = np.zeros((bits // _BUCKET, _BUCKET // 8), np.uint8)
    for r in marks:
        held[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(held.ravel())

    @F.arrow_udf("boolean")
    def marked(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda id: marked(F.pmod(F.xxhash64(id.cast("long")), F.lit(bits)).cast("long"))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from these that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Words of a text: maximal runs outside ASCII white space. Null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")
