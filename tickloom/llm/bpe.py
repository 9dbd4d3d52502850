"""Byte-pair encoding and decoding with a pair occurrence index.

All distinct words of a slice of a partition are laid out as one array of symbols. An index maps each pair of
neighbouring symbols that has a merge rank to all its positions. The lowest active rank is applied to all its positions
at once; the pairs that arise beside the merged positions join the index, those that vanish are recognised when their
turn comes. Words are independent of each other, so taking the lowest rank over all of them takes the lowest rank of
each one, which is what byte-pair encoding asks for.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import slices, texts_of

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
#: Bytes of words and their encodings that a Python worker remembers (about); beyond it the memory starts anew.
KNOWN_BYTES = 64 << 20
#: Bytes of text that are encoded at a time: the index holds some thirty bytes for each byte of a new word.
SLICE = 4 << 20
#: What an entry takes besides its word and ids, and the longest word that is remembered.
ENTRY, LONGEST = 160, 256
#: Positions whose pairs are looked up at a time.
BLOCK = 1 << 18
#: Up to so many positions, a pair is merged one position at a time.
FEW = 24
#: Characters for which Python's regex classes and lower() surely agree with the library's.
PLAIN = re.compile("[!-~À-ɏ]*")


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class PairIndex:
    """Merge table of a vocabulary file and the encoder that works through the index of pair positions."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = (self.left << 32) | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.rules = list(zip(self.left.tolist(), self.right.tolist(), self.made.tolist(), strict=True))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 for none."""
        want = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the count of ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), lengths
        ends = np.cumsum(lengths)
        full = lengths > 0
        firsts, lasts = (ends - lengths)[full], ends[full] - 1
        symbol = self.inner[data]
        symbol[lasts] = self.final[data[lasts]]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[lasts] = -1
        before[firsts] = -1

        found = []
        for low in range(0, n, BLOCK):
            at = low + np.flatnonzero(after[low : low + BLOCK] >= 0)
            rank = self.ranks(symbol[at], symbol[at + 1])
            found.append((at[rank >= 0].astype(np.int32), rank[rank >= 0].astype(np.int32)))
        at, rank = map(np.concatenate, zip(*found, strict=True))
        del found
        by_rank = np.argsort(rank, kind="stable")
        at, rank = at[by_rank], rank[by_rank]
        del by_rank
        starts = np.flatnonzero(np.diff(rank, prepend=-1))
        present = dict(zip(rank[starts].tolist(), np.split(at, starts[1:]), strict=True)) if len(at) else {}
        arisen: dict[int, list[int]] = {}
        active = sorted(present)
        cells = memoryview(symbol), memoryview(after), memoryview(before)
        while active:
            r = heapq.heappop(active)
            old, new = present.pop(r, None), arisen.pop(r, None)
            if old is None and new is None:
                continue
            if (0 if old is None else len(old)) + len(new or ()) <= FEW:
                places = sorted({*(() if old is None else old.tolist()), *(new or ())})
                fresh = self._merge_few(r, places, *cells)
            else:
                at = old if new is None else np.unique(np.array(new) if old is None else np.concatenate((old, new)))
                fresh = self._merge_many(r, at, symbol, after, before)
            for q, p in fresh:
                if q in arisen:
                    arisen[q].append(p)
                else:
                    arisen[q] = [p]
                    if q not in present:
                        heapq.heappush(active, q)
        alive = symbol >= 0
        counts = np.zeros(len(words), np.int64)
        counts[full] = np.add.reduceat(alive, firsts, dtype=np.int64)
        return symbol[alive].astype(np.uint32), counts

    def _merge_many(self, r, at, symbol, after, before):
        """Apply rank r at all its positions that still hold the pair; gives rank and position of pairs that arise."""
        a, b, c = self.rules[r]
        at = at[symbol[at] == a]
        following = after[at]
        valid = (following >= 0) & (symbol[following] == b)
        at, following = at[valid], following[valid]
        if a == b and len(at) > 1:
            at = self._apart(at, following)
            following = after[at]
        symbol[at] = c
        symbol[following] = -1
        beyond = after[following]
        after[at] = beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        ahead = before[at]
        near = np.concatenate((ahead[ahead >= 0], at[beyond >= 0]))
        made = self.ranks(symbol[near], symbol[after[near]])
        return zip(made[made >= 0].tolist(), near[made >= 0].tolist(), strict=True)

    def _merge_few(self, r, places, symbol, after, before):
        """The same for a handful of positions, in ascending order."""
        a, b, c = self.rules[r]
        rank_of, fresh = self.rank_of, []
        for p in places:
            q = after[p]
            if symbol[p] != a or q < 0 or symbol[q] != b:
                continue
            symbol[p], symbol[q] = c, -1
            after[p] = beyond = after[q]
            if beyond >= 0:
                before[beyond] = p
                if (made := rank_of.get(c << 32 | symbol[beyond])) is not None:
                    fresh.append((made, p))
            if (ahead := before[p]) >= 0 and (made := rank_of.get(symbol[ahead] << 32 | c)) is not None:
                fresh.append((made, ahead))
        return fresh

    @staticmethod
    def _apart(at: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Of overlapping positions of a pair of equal symbols, those that merging from the left takes."""
        taken, used = [], -1
        for p, q in zip(at.tolist(), following.tolist(), strict=True):
            if p != used:
                taken.append(p)
                used = q
        return np.array(taken)


class ChunkEncoder:
    """Encodes chunks between ASCII white space exactly as the library does with the word-end vocabulary.

    White space never lies inside a token there, so a text's ids are those of its chunks, one after the other.
    """

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, name: str = WORD_BPE):
        from tokenizers import Tokenizer

        self.index = PairIndex(public_tokenizers.path(name))
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.bytes_of = {c: b for b, c in enumerate(byte_characters())}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.index.special)) + ")")
        self.known: dict[str | int, bytes] = {}
        self.limit = KNOWN_BYTES
        self.forget()

    def words(self, chunk: str) -> list[str | int]:
        """The words of a chunk; a special string is its id."""
        if chunk.isascii() or PLAIN.fullmatch(chunk):
            low = chunk.lower()
            if low.isalpha():
                return [low]
            if low[-1:] in (".", ",", "!") and low[:-1].isalpha():
                return [low[:-1], low[-1]]
            if "<|" not in low and PLAIN.fullmatch(chunk):
                return self.WORDS.findall(low)
        found = []
        for part in self.marks.split(chunk):
            if part in self.index.special:
                found.append(self.index.special[part])
            elif part:
                part = self.library.normalizer.normalize_str(part)
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                    found.append(bytes(map(self.bytes_of.__getitem__, word)).decode())
        return found

    def encode(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as little-endian 32-bit integers."""
        split = [self.words(c) for c in chunks]
        known = self.known
        fresh = list({w for ws in split for w in ws if w not in known})
        raw = [w.encode() for w in fresh]
        ids, counts = self.index.encode(raw)
        coded, at = ids.astype("<u4").tobytes(), 0
        for w, end in zip(fresh, (4 * np.cumsum(counts)).tolist(), strict=True):
            known[w] = coded[at:end]
            at = end
        out = [known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for ws in split]
        for w, r, n in zip(fresh, raw, counts.tolist(), strict=True):
            if len(r) > LONGEST:
                del known[w]
            else:
                self.held += ENTRY + 2 * len(r) + 4 * n
        if self.held > self.limit:
            self.forget()
        return out

    def forget(self) -> None:
        """Remember the special strings only."""
        self.held = 0
        self.known = {i: np.array([i], "<u4").tobytes() for i in self.index.special.values()}

    def decode(self, ids: bytes) -> str:
        """As the library decodes these ids, special tokens kept: token strings joined by blanks."""
        tokens = self.index.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def chunk_encoder(name: str = WORD_BPE) -> ChunkEncoder:
    return ChunkEncoder(name)


def encoded_chunks(texts: pa.Array, encoder: ChunkEncoder) -> tuple[list[list[int]], list[bytes]]:
    """For each text the numbers of its chunks, and the ids of each distinct chunk."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist()
    distinct = encoder.encode(coded.dictionary.to_pylist())
    return [numbers[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)], distinct


def encode(docs: DataFrame, name: str = WORD_BPE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """ids (array of int) and the decoded text of each row; a null or empty text has no ids and decodes to ''.

    Rows stay where they are: no shuffle; a worker holds a slice of a batch and KNOWN_BYTES of remembered words, or a
    single longer text. Repeated rows and ids give a row each, an empty table none; other columns aren't returned.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, decoded in _coded(batches, name):
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            flat = np.frombuffer(b"".join(ids), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded)], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_column)


def digests(docs: DataFrame, name: str = WORD_BPE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of documents, computed where the row lies.

    Nulls, empty and long texts, repeated rows, empty tables and other columns as in encode().
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, decoded in _coded(batches, name):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _coded(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[str]]]:
    encoder = chunk_encoder(name)
    for batch in slices(batches, limit=SLICE):
        numbers, distinct = encoded_chunks(texts_of(batch), encoder)
        shown = [encoder.decode(x) for x in distinct]
        ids = [b"".join([distinct[i] for i in at]) for at in numbers]
        decoded = [" ".join([shown[i] for i in at if distinct[i]]) for at in numbers]
        yield batch, ids, decoded
