"""Periodic runs of words, found by block convolution.

A run is a stretch of words that repeats with a period of q words, at least twice, as long as it lasts. At dyadic scales
the words are cut into blocks of B words. A run whose period is of that scale contains a whole block that recurs q words
later, so each block is compared with all places of the window of words that follows it: the sum of squared differences
at every place comes from one number-theoretic transform, exact in integers, and is zero where the block recurs. The
distances of these places are the seeds, which are extended word by word to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tickloom.llm.common import fresh, slices, texts_of, words

#: Words of the shortest run that is reported, and periods that it must hold.
SHORTEST, PERIODS = 12, 2
#: Bytes of text that are searched at a time.
SLICE = 1 << 20
#: Block of the smallest scale, and the periods which it serves: stretches of SHORTEST - 6 equal words hold such a block.
FIRST_BLOCK, FIRST_PERIODS = 2, (1, 6)
#: A prime 15 * 2^27 + 1 with a generator: transforms of up to 2^27 places, products within 64 bits.
PRIME, GENERATOR = np.uint64(2013265921), 31
#: Places of the transforms that are worked on together.
TOGETHER = 1 << 18
RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


@lru_cache(maxsize=64)
def _powers(half: int, inverse: bool) -> np.ndarray:
    """The first half powers of a root of unity of order 2 * half."""
    p = int(PRIME)
    root = pow(GENERATOR, (p - 1) // (2 * half), p)
    root = pow(root, p - 2, p) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < half:
        out = np.concatenate((out, out * np.uint64(pow(root, len(out), p)) % PRIME))
    return out


def transform(a: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two of places); the results are in bit-reversed order."""
    rows, n = a.shape
    half = n // 2
    while half:
        x = a.reshape(rows, -1, 2, half)
        u, v = x[:, :, 0], x[:, :, 1]
        y = np.empty_like(x)
        y[:, :, 0] = (u + v) % PRIME
        y[:, :, 1] = (u + (PRIME - v)) % PRIME * _powers(half, False) % PRIME
        a, half = y, half // 2
    return a.reshape(rows, n)


def inverse(a: np.ndarray) -> np.ndarray:
    """The rows of which these are the transforms."""
    rows, n = a.shape
    half = 1
    while half < n:
        x = a.reshape(rows, -1, 2, half)
        u, v = x[:, :, 0], x[:, :, 1] * _powers(half, True) % PRIME
        y = np.empty_like(x)
        y[:, :, 0] = (u + v) % PRIME
        y[:, :, 1] = (u + (PRIME - v)) % PRIME
        a, half = y, 2 * half
    return a.reshape(rows, n) * np.uint64(pow(n, int(PRIME) - 2, int(PRIME))) % PRIME


def recurrences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each row, the places of its window at which its block begins again.

    The sum of squared differences is taken in the prime's field: no place with a zero sum is lost, and one whose sum is a
    multiple of the prime by chance doesn't outlive the comparison word by word that follows.
    """
    rows, width = blocks.shape
    places = windows.shape[1] - width + 1
    n = 1 << int(windows.shape[1] + width - 2).bit_length()
    a, b = (np.zeros((rows, n), np.uint64) for _ in range(2))
    a[:, :width], b[:, : windows.shape[1]] = blocks[:, ::-1], windows
    products = inverse(transform(a) * transform(b) % PRIME)[:, width - 1 : width - 1 + places]
    squares = np.concatenate((np.zeros((rows, 1), np.uint64), np.cumsum(b[:, : windows.shape[1]] ** 2 % PRIME, axis=1)), axis=1)
    own = (a[:, :width] ** 2 % PRIME).sum(1)[:, None]
    there = squares[:, width : width + places] - squares[:, :places]
    return (own + there) % PRIME == 2 * products % PRIME


def _reach(codes: np.ndarray, at: int, d: int, step: int) -> int:
    """Equal words from at on (step 1) or before it (step -1) at distance d, compared in pieces of growing size."""
    size, done = 8, 0
    while True:
        if step > 0:
            size = min(size, len(codes) - d - at - done)
            a = codes[at + done : at + done + size] != codes[at + done + d : at + done + d + size]
        else:
            size = min(size, at - done)
            a = (codes[at - done - size : at - done] != codes[at - done - size + d : at - done + d])[::-1]
        if size <= 0:
            return done
        if a.any():
            return done + int(a.argmax())
        done, size = done + size, 2 * size


class _Search:
    """Runs of one sequence of word numbers, in which numbers that occur once part the texts."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.codes, self.longest, n = codes, longest, len(codes)
        order = np.argsort(codes, kind="stable")
        self.span = np.int64(8 * n + 64)
        self.keys = codes[order] * self.span + order
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.gap = np.full(n, np.iinfo(np.int64).max)
        same = codes[order[1:]] == codes[order[:-1]]
        self.gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
        self.runs: list[tuple[int, int, int]] = []

    def found(self) -> list[tuple[int, int, int]]:
        """(start, end, period) of all runs, each with its smallest period."""
        block, (low, high) = FIRST_BLOCK, FIRST_PERIODS
        while PERIODS * low <= self.longest:
            self._scale(block, low, high)
            block *= 2
            low, high = 2 * block - 1, 4 * block - 2
        smallest: dict[tuple[int, int], int] = {}
        for s, e, q in self.runs:
            smallest[s, e] = min(q, smallest.get((s, e), q))
        return sorted((s, e, q) for (s, e), q in smallest.items())

    def _blocks(self, block: int, low: int, high: int) -> np.ndarray:
        """Starts of the blocks all of whose words recur low to high words later, the others can't recur as a whole."""
        m = len(self.codes) // block
        alive = self.gap[: m * block].reshape(m, block).max(1) <= high
        for s, e, q in self.runs:  # within a run of a shorter period a block recurs at its multiples only, which say nothing new
            if q <= block:
                alive[-(-s // block) : max(0, (e - high - block) // block + 1)] = False
        starts = np.flatnonzero(alive) * block
        if not len(starts):
            return starts
        places = starts[:, None] + np.arange(block)
        wanted = self.keys[self.rank[places]] + low
        after = np.searchsorted(self.keys, wanted)
        inside = self.keys[np.minimum(after, len(self.keys) - 1)] <= wanted + (high - low)
        return starts[(inside & (after < len(self.keys))).all(1)]

    def _scale(self, block: int, low: int, high: int) -> None:
        starts = self._blocks(block, low, high)
        if not len(starts):
            return
        width = high - low + block
        padded = np.concatenate((self.codes, np.full(high + block, self.codes.max() + 1))).astype(np.uint64)
        windows = np.lib.stride_tricks.sliding_window_view(padded, width)
        blocks = np.lib.stride_tricks.sliding_window_view(padded, block)
        step = max(1, TOGETHER // (4 * block))
        seeds, distances = [], []
        for i in range(0, len(starts), step):
            some = starts[i : i + step]
            row, place = np.nonzero(recurrences(blocks[some], windows[some + low]))
            seeds.append(some[row])
            distances.append(place + low)
        self._extend(np.concatenate(seeds), np.concatenate(distances), block)

    def _extend(self, at: np.ndarray, d: np.ndarray, block: int) -> None:
        """Shorter distances first: what a run explains (multiples of its period inside it) isn't extended again."""
        alive = np.ones(len(at), bool)

        def explain(s: int, e: int, q: int) -> None:
            i, j = np.searchsorted(at, [s, e])
            alive[i:j] &= (d[i:j] % q != 0) | (at[i:j] + d[i:j] + block > e)

        for run in self.runs:
            explain(*run)
        for k in np.lexsort((at, d)).tolist():
            if not alive[k]:
                continue
            i, q = int(at[k]), int(d[k])
            right = _reach(self.codes, i, q, 1)
            if right < block:
                continue  # a sum of differences that the prime divides
            s, e = i - _reach(self.codes, i, q, -1), i + right + q
            if e - s >= max(SHORTEST, PERIODS * q):
                self.runs.append((s, e, q))
                explain(s, e, q)
            else:  # the same short stretch, by a later block of it
                j = np.searchsorted(at, e - q)
                alive[k + 1 : j] &= d[k + 1 : j] != q


def search(texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
    """The runs of each text, by start and period, and the text with one period of each run (words joined by one blank)."""
    split = pc.ascii_split_whitespace(texts)
    flat, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    flat, owner = flat.filter(pa.array(real)), owner[real]
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))
    numbers = pc.dictionary_encode(flat)
    codes = np.asarray(numbers.indices).astype(np.int64)
    # A number of its own after each text, so nothing recurs beyond it.
    codes = np.insert(codes, first[1:], len(numbers.dictionary) + np.arange(len(texts)))
    begins = first[:-1] + np.arange(len(texts))
    runs = _Search(codes, int(counts.max(initial=0))).found() if len(flat) else []
    s, e, q = np.array(runs, np.int64).reshape(-1, 3).T
    text = np.searchsorted(begins, s, side="right") - 1
    order = np.lexsort((q, s))
    s, e, q, text = s[order], e[order], q[order], text[order]
    fields = [pa.array(x, pa.int64()) for x in (s - begins[text], e - s, q)]
    ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts)))))
    of_texts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, s + q, 1)
    np.add.at(change, e, -1)
    kept = np.delete(np.cumsum(change[:-1]) == 0, first[1:] + np.arange(len(texts)))
    left = np.concatenate(([0], np.cumsum(np.bincount(owner[kept], minlength=len(texts)))))
    lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept)))
    return of_texts, pc.binary_join(lists, " ")


def find_runs(docs: DataFrame) -> DataFrame:
    """docs with runs (start, length and period in words, by start and period) and collapsed (text with one period of each).

    Words are maximal runs outside ASCII white space. A run has at least 12 words and two periods of its smallest period, and
    no neighbouring word extends it. Collapsed drops a word if any run contains it after that run's first period; its words
    are joined by one blank. Null and empty texts have no runs and an empty collapsed text; repeated rows each get the same;
    an empty table gives no rows. Whole texts are searched, however long, and nothing is shuffled. Other columns pass through;
    columns named runs or collapsed are replaced.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("runs", "collapsed")])
    (whole,) = fresh(rows, "whole")
    rows = rows.withColumn(whole, F.col("text").cast("string"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=whole, limit=SLICE):
            found, collapsed = search(texts_of(batch, whole))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            del columns[whole]
            yield pa.RecordBatch.from_pydict({**columns, "runs": found, "collapsed": collapsed})

    kept = StructType([f for f in rows.schema if f.name != whole])
    return rows.mapInArrow(searched, StructType([*kept, StructField("runs", RUNS), StructField("collapsed", StringType())]))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a periodic tail in a tenth of the documents, chosen by doc_id (null: as it is); others as they are."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def tail(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        shape = lambda x: F.transform(ws, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(ws, (x["a"] + (i - x["a"]) % x["p"]).cast("int"))))
        return F.when(n == 0, text).otherwise(F.array_join(_let(F.struct(a.alias("a"), p.alias("p")), shape), " "))

    return F.when(h % 10 == 0, _let(words(text), tail)).otherwise(text)


def document_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and digests of all runs and of the collapsed text, for each row of documents.

    A tenth of the texts gets a periodic tail first (planted). Null texts have no words: no runs, four nulls, digests of
    empty strings. Columns other than doc_id and text aren't used.
    """
    text = F.col("text").cast("string")
    found = find_runs(docs.select("doc_id", planted(F.col("doc_id"), text).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.withColumn("best", best)
    n, q = F.col("best.n"), -F.col("best.q")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), n.alias("length"), q.alias("period"),
        ((1000 * n - (1000 * n) % q) / q).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode(F.col("collapsed"), "UTF-8"), 256).alias("collapsed_sha256"),
    )
