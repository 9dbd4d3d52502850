"""Document quality by a linear-chain conditional random field over lines.

Each line of a text is good or bad. Features of the line and of its neighbours give its log-odds, transitions couple
adjacent lines, and forward and backward passes give every line's marginal probability of being good; their mean, weighted
by the lines' lengths, is the quality of the document. For learning, the lines of a labelled document bear its label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fresh, slices, texts_of, written

#: Labelled documents that the fit reads at most, a seeded draw by doc_id; all of them if there are fewer.
FIT_ROWS = 8_000
#: Evaluations of the likelihood at most, the change of it at which the search ends, the weight of the squares of all
#: parameters, and the steps that the search remembers.
EVALUATIONS, TOLERANCE, PENALTY, MEMORY = 30, 1e-3, 0.3, 8
#: Bytes of text whose features are held at a time.
SLICE = 1 << 20
#: Bits of the classes of bytes: letter (all of UTF-8 beyond ASCII too), upper case, digit, symbol, sentence mark.
_CLASSES = 5
OWN = (
    "letters", "upper", "digits", "symbols", "many_symbols", "marks", "length", "words", "short", "word_length", "distinct", "adjacent", "again",
    "much_again", "duplicate", "ends", "starts_upper",
)
#: Own features of the line, of the one before it and of the one after it, whether there are such, and one.
WIDTH = 3 * len(OWN) + 3


def _class_table() -> np.ndarray:
    out = np.zeros((_CLASSES, 256), np.int64)
    for c in range(256):
        x = chr(c)
        out[:, c] = (c > 127 or x.isalpha(), c < 128 and x.isupper(), c < 128 and x.isdigit(), x in "#*$%&|<>", x in ".!?,;:")
    return out


_TABLE = _class_table()


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[offsets])


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line that has a word (WIDTH columns), its bytes, and the number of lines of each text."""
    split = pc.split_pattern(texts, "\n")
    lines, text = split.flatten(), pc.list_parent_indices(split).to_numpy()
    parts = pc.ascii_split_whitespace(lines)
    words, line = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    words, line = words.filter(pa.array(real)), line[real]
    n_words = np.bincount(line, minlength=len(lines)) if len(line) else np.zeros(len(lines), np.int64)
    kept = n_words > 0
    number = np.cumsum(kept) - 1
    lines, text, n_words, line = lines.filter(pa.array(kept)), text[kept], n_words[kept], number[line]
    n = len(lines)
    per_text = np.bincount(text, minlength=len(texts)) if n else np.zeros(len(texts), np.int64)
    if not n:
        return np.zeros((0, WIDTH)), np.zeros(0), per_text
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + n + 1].astype(np.int64)
    data = np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    letters, upper, digits, symbols, marks = (_sums(t[data], offsets) for t in _TABLE)
    code = np.asarray(pc.dictionary_encode(words).indices).astype(np.int64)
    base = np.int64(code.max() + 1)
    distinct = np.bincount(np.unique(line * base + code) // base, minlength=n)
    same = (code[1:] == code[:-1]) & (line[1:] == line[:-1])
    adjacent = np.bincount(line[1:][same], minlength=n)
    # Pairs of words that the text has had before.
    of_text = text[line]
    joined = of_text[1:] == of_text[:-1]
    pairs = ((code[:-1] * base + code[1:]) * np.int64(len(texts)) + of_text[1:] if base * base < (1 << 62) // len(texts) else _mixed(code, base, of_text))[joined]
    again = np.ones(len(pairs), bool)
    again[np.unique(pairs, return_index=True)[1]] = False
    again = np.bincount(line[1:][joined][again], minlength=n)
    whole = np.asarray(pc.dictionary_encode(lines).indices).astype(np.int64) + text * np.int64(n)
    duplicate = np.ones(n, bool)
    duplicate[np.unique(whole, return_index=True)[1]] = False
    spaces = np.isin(data, np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8))
    seen = np.maximum.accumulate(np.where(spaces, 0, np.arange(1, len(data) + 1)))  # place of the last other byte so far
    last = data[seen[offsets[1:] - 1] - 1]
    first = data[np.minimum(offsets[:-1], len(data) - 1)]
    solid = np.maximum(size - _sums(spaces.astype(np.int64), offsets), 1)
    own = np.column_stack([
        letters / solid, upper / np.maximum(letters, 1), digits / solid, symbols / solid, np.minimum(20 * symbols / solid, 1), marks / solid,
        np.log1p(size) / 10, np.log1p(n_words) / 5, n_words < 4, np.minimum(letters / n_words, 20) / 10, distinct / n_words, adjacent / n_words,
        again / n_words, again > 0.2 * n_words, duplicate, np.isin(last, np.frombuffer(b".!?", np.uint8)), (first >= 65) & (first <= 90),
    ]).astype(float)
    out = np.zeros((n, WIDTH))
    k = len(OWN)
    out[:, :k] = own
    after = text[1:] == text[:-1]
    out[1:, k : 2 * k] = own[:-1] * after[:, None]
    out[:-1, 2 * k : 3 * k] = own[1:] * after[:, None]
    out[1:, 3 * k], out[:-1, 3 * k + 1], out[:, 3 * k + 2] = after, after, 1.0
    return out, size.astype(float), per_text


def _mixed(code: np.ndarray, base: np.int64, text: np.ndarray) -> np.ndarray:
    """As the exact numbers of pairs, for vocabularies whose squares don't fit: their 64-bit hashes."""
    with np.errstate(over="ignore"):
        return ((code[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + code[1:].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) + text[1:].astype(np.uint64)).view(np.int64)


@dataclass(frozen=True)
class Model:
    """weights: log-odds of good by feature; ties[y, z]: weight of a line of class z after one of class y; prior: share of good."""

    weights: np.ndarray
    ties: np.ndarray
    prior: float


def _passed(m: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Log-odds of a line by those of its neighbour, through the ties (from the neighbour's class to the line's)."""
    return np.logaddexp(ties[1, 1] + m, ties[0, 1]) - np.logaddexp(ties[1, 0] + m, ties[0, 0])


def passes(odds: np.ndarray, counts: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward log-odds, backward log-odds and the sum of the logarithms of the normalising sums, for chains one after another."""
    ends = np.cumsum(counts)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    begins, lengths = (ends - counts)[order], counts[order]
    ahead, back, total = np.array(odds), np.zeros(len(odds)), 0.0
    longest = int(lengths[0]) if len(order) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains with more than t lines
    for t in range(1, longest):
        at = begins[: active[t]] + t
        before = ahead[at - 1]
        ahead[at] += _passed(before, ties)
        total += float(np.logaddexp(ties[0, 0], ties[1, 0] + before).sum())
    for t in range(longest - 1, 0, -1):
        at = begins[: active[t]] + t
        back[at - 1] = _passed(odds[at] + back[at], ties.T)
    return ahead, back, total + float(np.logaddexp(0, ahead[begins + lengths - 1]).sum()) if len(order) else 0.0


def likelihood(theta: np.ndarray, features: np.ndarray, counts: np.ndarray, good: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of chains whose lines all bear their document's label, and its gradient by weights and ties."""
    weights, ties = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    odds = features @ weights
    ahead, back, total = passes(odds, counts, ties)
    label = np.repeat(good, counts)
    p = _sigmoid(ahead + back)
    inner = np.ones(len(odds), bool)
    inner[(np.cumsum(counts) - counts)[counts > 0]] = False
    at = np.flatnonzero(inner)
    score = np.empty((2, 2, len(at)))
    for y in (0, 1):
        for z in (0, 1):
            score[y, z] = ties[y, z] + y * ahead[at - 1] + z * (odds[at] + back[at])
    score -= score.max((0, 1))
    expected = np.exp(score)
    expected = (expected / expected.sum((0, 1))).sum(2)
    observed = np.zeros((2, 2))
    observed[1, 1], observed[0, 0] = label[at].sum(), (1 - label[at]).sum()
    value = float((odds * label).sum() + (observed * ties).sum() - total)
    return value, np.concatenate((features.T @ (label - p), (observed - expected).ravel()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def maximise(evaluate, start: np.ndarray) -> np.ndarray:
    """Limited-memory quasi-Newton search for the largest value; evaluate gives value and gradient."""
    x, steps = start, []
    value, slope = evaluate(x)
    for _ in range(EVALUATIONS):
        direction, kept = np.array(slope), []
        for s, y, r in reversed(steps):
            a = r * (s @ direction)
            direction = direction - a * y
            kept.append(a)
        direction *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.abs(slope).max()))
        for (s, y, r), a in zip(steps, reversed(kept), strict=True):
            direction = direction + (a - r * (y @ direction)) * s
        rate = 1.0
        while True:
            new = x + rate * direction
            new_value, new_slope = evaluate(new)
            if new_value >= value + 1e-4 * rate * (slope @ direction) or rate < 1e-3:
                break
            rate /= 4
        s, y = new - x, slope - new_slope  # of the negative value, which is convex
        if s @ y > 1e-12:
            steps = [*steps[1 - MEMORY :], (s, y, 1 / (s @ y))]
        gained = new_value - value
        if new_value > value:
            x, value, slope = new, new_value, new_slope
        if gained < TOLERANCE * (1 + abs(value)):
            break
    return x


def fit(rows: DataFrame) -> Model:
    """A model from rows of text and good (0 or 1, or null: left out). Each evaluation of the likelihood is one job over their features.

    The driver sees sums of WIDTH + 6 numbers of each task. No labelled rows give a model that finds every text as
    likely good as bad.
    """
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("good").cast("int").alias("good")).where("good is not null")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            features, _, counts = line_features(texts_of(batch))
            ends = np.concatenate(([0], np.cumsum(counts)))
            cells = [features[a:b].astype(np.float32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(cells, pa.binary())], ["good", "features"])

    chains = written(rows.mapInArrow(featured, "good int, features binary"))
    counted = chains.agg(F.count("*").alias("n"), F.avg("good").alias("share")).first()
    if not counted["n"]:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), 0.5)

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(WIDTH + 5)
            for batch in slices(batches, column="features", limit=8 * SLICE):
                held = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in batch.column("features").to_pylist()]
                value, slope = likelihood(theta, np.concatenate(held).astype(float), np.array([len(x) for x in held]), batch.column("good").to_numpy().astype(float))
                total += np.concatenate(([value], slope))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        parts = np.array(sorted(r["sums"] for r in chains.mapInArrow(summed, "sums array<double>").collect()))
        total = parts.sum(0)
        return float(total[0] - PENALTY * theta @ theta), total[1:] - 2 * PENALTY * theta

    theta = maximise(evaluate, np.zeros(WIDTH + 4))
    return Model(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), float(counted["share"]))


def marginals(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of being good of each line with a word, its bytes, and the number of such lines of each text."""
    features, size, counts = line_features(texts)
    odds = np.round(features @ model.weights, 9)  # equal texts get equal odds, wherever their lines lie in the matrix
    ahead, back, _ = passes(odds, counts, model.ties)
    return _sigmoid(ahead + back), size, counts


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1), predicted (1 from 0.5 on) and line_scores (probability and bytes of each line with a word).

    Null and empty texts and texts without a word have no lines; their score is the share of good documents that was
    learned from. Repeated rows get equal scores, an empty table gives no rows, whole texts are read, however long. The
    prediction sees the text only; other columns pass through (earlier score, predicted and line_scores are replaced).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted", "line_scores")]

    @F.arrow_udf("score double, line_scores array<struct<good: double, bytes: long>>")
    def scored(texts: pa.Array) -> pa.Array:
        known, scores, cells = shared.value, [], []
        kind = pa.list_(pa.struct([("good", pa.float64()), ("bytes", pa.int64())]))
        for batch in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), limit=SLICE):
            p, size, counts = marginals(known, texts_of(batch))
            ends = np.concatenate(([0], np.cumsum(counts)))
            text = np.repeat(np.arange(len(counts)), counts)
            over, length = (np.bincount(text, x, len(counts)) for x in (p * size, size))
            scores.append(np.clip(np.where(counts > 0, over / np.maximum(length, 1), known.prior), 0, 1))
            fields = pa.StructArray.from_arrays([pa.array(p), pa.array(size.astype(np.int64))], ["good", "bytes"])
            cells.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields).cast(kind))
        whole = pa.array(np.concatenate(scores) if scores else [], pa.float64())
        return pa.StructArray.from_arrays([whole, pa.concat_arrays(cells) if cells else pa.array([], kind)], ["score", "line_scores"])

    (found,) = fresh(docs, "found_")
    rows = docs.withColumn(found, scored(F.col("text").cast("string")))
    score = F.col(f"{found}.score")
    return rows.select(*[F.col(f"`{c}`") for c in names], score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col(f"{found}.line_scores").alias("line_scores"))


def held_out() -> F.Column:
    """True for the documents that are never learned from."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """text and good of the labelled documents that aren't held out, fit_rows at most, the first ones by a hash of doc_id.

    A doc_id whose labels differ is left out; of rows that share a doc_id the smallest text counts.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("quality").alias("most")).where("good = most and good in (0, 1)")
    drawn = marks.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(fit_rows).select("doc_id", "good")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    return texts.groupBy("doc_id", "good").agg(F.min("text").alias("text")).select("text", "good")


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of documents; learned from labelled ones that aren't held out."""
    model = fit(labelled(docs, labels))
    return predict(docs.select("doc_id", held_out().alias("held_out"), F.col("text").alias("text")), model).select("doc_id", "held_out", "score", "predicted")
