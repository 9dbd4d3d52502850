"""Language identification with a bit-sliced Bloom filter of character n-grams.

One filter serves all languages: each of its slots is a bitmask with a bit per language. The bitwise and of an n-gram's
slots gives all languages that contain it. A text's n-grams are looked up together; each language's count of set bits is
corrected for the share that its filter would accept by chance, and the highest corrected share decides.

Any number of languages is learned: the filter is kept in groups of GROUP languages, which are made and looked up one
after another, so the driver and a task hold one group at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fresh, slices, texts_of, written

NGRAM = 3
#: Slots of the filter (a power of two) and slots per n-gram.
SLOTS, PROBES = 1 << 20, 3
#: An n-gram belongs to a language if it makes up this share of the language's n-grams, so at most 1 / SHARE do.
SHARE = 2e-5
#: Labelled rows of a language that the fit reads, up to chance; of more, each is taken with the same probability.
FIT_ROWS = 10_000
#: Languages of a group, a multiple of 64: a group's masks take GROUP / 64 words for each slot.
GROUP = 256
UNKNOWN = "und"
#: Bytes of text that are looked up at a time: the lookup holds some hundred bytes for each character.
SLICE = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass(frozen=True)
class Model:
    """The filter of one group of languages (ascending), and those of the groups after it."""

    languages: tuple[str, ...]
    #: masks[w, slot]: bits of languages 64 w to 64 w + 63
    masks: np.ndarray
    rest: tuple[Broadcast, ...] = ()

    def chance(self) -> np.ndarray:
        """Share of unknown n-grams that each language's filter accepts."""
        full = [((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.minimum(np.array(full) ** PROBES, 0.999)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True at the code points that are letters (a category that begins with L)."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, the text that each belongs to, and which texts have a letter.

    Texts are lower-cased, runs of other characters than letters become one blank, and a blank stands at both ends.
    """
    joined = "\0".join(texts).lower()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    split = code == 0
    if int(split.sum()) != len(texts) - 1:  # a text holds the separator itself
        return ngrams([t.replace("\0", " ") for t in texts])
    keep = letter | split | np.concatenate(([False], letter[:-1]))
    code, letter, split = code[keep], letter[keep], split[keep]
    text = np.cumsum(split) if len(texts) > 1 else np.zeros(len(code), np.int64)
    has = np.zeros(len(texts), bool)
    has[np.unique(text[letter])] = True
    # Blank instead of anything but letters; the separator is a blank of both neighbours.
    value = np.where(letter, code, 32).astype(np.uint64)
    value = np.concatenate(([np.uint64(32)], value, [np.uint64(32)]))
    alpha = np.concatenate(([False], letter, [False]))
    owner = np.concatenate((text[:1], text, text[-1:])) if len(text) else np.zeros(2, np.int64)
    n = len(value) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    key = np.zeros(n, np.uint64)
    for i in range(NGRAM):
        key = (key << np.uint64(21)) | value[i : i + n]
    middle = alpha[NGRAM // 2 : NGRAM // 2 + n]  # n-grams around a letter, so none spans two texts
    return key[middle], owner[NGRAM // 2 : NGRAM // 2 + n][middle], has


def slots(keys: np.ndarray, probe: int) -> np.ndarray:
    return ((keys * _MIX[probe]) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def filters(languages: tuple[str, ...], number: np.ndarray, grams: np.ndarray) -> Model:
    """The filter of a group from the n-grams of its languages (number: place of each n-gram's language)."""
    masks = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
    order = np.argsort(number, kind="stable")
    ends = np.searchsorted(number[order], np.arange(len(languages) + 1))
    for i in range(len(languages)):
        own = grams[order[ends[i] : ends[i + 1]]]
        for probe in range(PROBES):
            masks[i // 64, slots(own, probe)] |= np.uint64(1 << (i % 64))
    return Model(languages, masks)


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, share: float = SHARE) -> Model:
    """A model from labelled rows (columns text and lang; rows with a null in either are left out).

    The fit reads about fit_rows rows of each language, chosen by a seeded draw, all of them if there are fewer, so rare
    languages are learned from any size of input; the n-grams of all languages are counted in one job. The driver gets the
    languages' names and counts and, for one group of GROUP languages after another, at most 1 / share n-grams of each, as
    numbers. No labelled rows give a model without languages. Repeated rows count each.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counted = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    languages = tuple(lang for lang, _ in counted)
    if not languages:
        return Model((), np.zeros((1, SLOTS), np.uint64))
    rates = spark.createDataFrame([(lang, i, fit_rows / n) for i, (lang, n) in enumerate(counted)], "lang string, number int, rate double")
    rows = rows.join(F.broadcast(rates), "lang").where(F.rand(7) < F.col("rate")).select("text", "number")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            spoken, code = np.unique(batch.column("number").to_numpy(), return_inverse=True)
            keys, owner, _ = ngrams(batch.column("text").to_pylist())
            code = code[owner]
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(spoken) + 1))
            for i, number in enumerate(spoken.tolist()):
                found, n = np.unique(keys[order[ends[i] : ends[i + 1]]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), number, np.int32)), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["number", "gram", "n"]
                )

    counts = rows.mapInArrow(work, "number int, gram long, n long").groupBy("number", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("number").agg(F.sum("n").alias("all"))
    kept = counts.join(totals, "number").where(F.col("n") >= F.lit(share) * F.col("all")).select("number", "gram")
    groups = []
    if len(languages) > GROUP:
        kept = written(kept)
    for at in range(0, len(languages), GROUP):
        some = kept.where(F.col("number").between(at, at + GROUP - 1)).toArrow()
        one = filters(languages[at : at + GROUP], some.column("number").to_numpy() - at, some.column("gram").to_numpy().view(np.uint64))
        groups.append(spark.sparkContext.broadcast(one) if at else one)
    return replace(groups[0], rest=tuple(groups[1:]))


def scores(model: Model, texts: list[str], chance: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language (number, ties to the first), its corrected share of n-grams, and which texts have a letter."""
    chance = model.chance() if chance is None else chance
    keys, owner, has = ngrams(texts)
    n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    at = [slots(keys, p) for p in range(PROBES)]
    found = np.zeros((len(model.languages), len(texts)))
    for w in range(len(model.masks)):
        mask = model.masks[w][at[0]]
        for a in at[1:]:
            mask &= model.masks[w][a]
        for i in range(64 * w, min(len(model.languages), 64 * w + 64)):
            bit = ((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.float64)
            found[i] = np.bincount(owner, bit, len(texts))
    corrected = np.clip((found / n - chance[:, None]) / (1 - chance[:, None]), 0, 1)
    best = corrected.argmax(0) if len(model.languages) else np.zeros(len(texts), np.int64)
    top = corrected[best, np.arange(len(texts))] if len(model.languages) else np.zeros(len(texts))
    return best, top, has


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score. Null texts and texts without a letter are 'und' with score 0.

    The prediction sees the text only; other columns pass through (earlier lang_pred and score are replaced). Repeated rows
    get equal languages, an empty table gives no rows; whole texts are looked up, a slice at a time. Each broadcast is of
    a fixed size (SLOTS words for 64 languages, GROUP languages at most). Of several groups a task holds one at a time.
    """
    shared = (docs.sparkSession.sparkContext.broadcast(replace(model, rest=())), *model.rest)
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]

    # Only the text goes to Python; the other columns wait in the JVM.
    @F.arrow_udf("lang string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        pieces = [texts_of(b).to_pylist() for b in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), limit=SLICE)]
        langs = [[UNKNOWN] * len(p) for p in pieces]
        tops = [np.full(len(p), -1.0) for p in pieces]
        for one in shared:
            group = one.value
            chance = group.chance()
            for piece, lang, top in zip(pieces, langs, tops, strict=True):
                best, found, has = scores(group, piece, chance)
                has &= bool(group.languages)
                for i in np.flatnonzero(has & (found > top)).tolist():  # of equal shares the first language's counts
                    lang[i], top[i] = group.languages[best[i]], found[i]
            if len(shared) > 1:
                del group
                one.__dict__.pop("_value", None)  # read again from the worker's disk for the next batch
        scored = np.maximum(np.concatenate(tops), 0.0) if tops else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array([x for p in langs for x in p], pa.string()), pa.array(scored, pa.float64())], ["lang", "score"])

    (found,) = fresh(docs, "found_")
    rows = docs.withColumn(found, predicted(F.col("text").cast("string")))
    return rows.select(*[F.col(f"`{c}`") for c in names], F.col(f"{found}.lang").alias("lang_pred"), F.col(f"{found}.score").alias("score"))


def held_out() -> F.Column:
    """True for the documents that are never learned from."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def document_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of documents; learned from those that aren't held out.

    Null texts and texts without a letter are 'und' with score 0, null doc_ids aren't held out, repeated rows each get the same,
    an empty table gives no rows; texts count as a whole. Columns other than doc_id, text and (for learning) lang aren't used.
    """
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")), model).drop("text")
