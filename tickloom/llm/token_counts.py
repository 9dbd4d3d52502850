"""Token counts with a whole-token shortcut.

Offline, each vocabulary string that encodes alone as one token is proved to do so by running the merges on it. In a
text, pre-tokens among these count as one; only the rest is merged.
"""

from __future__ import annotations

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

from tickloom.llm.bpe import BYTE_BPE, ENTRY, KNOWN_BYTES, LONGEST, PairIndex, byte_characters
from tickloom.llm.common import slices, texts_of

#: Characters for which Python's regex classes surely agree with the library's.
PLAIN = re.compile("[\t\n\r -~À-ɏ]*")
#: Two ASCII white-space characters side by side.
RUN = "[ \\t\\n\\x0b\\x0c\\r][ \\t\\n\\x0b\\x0c\\r]"
#: White space outside ASCII; a run of white space that holds one isn't cut.
WIDE = re.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+\Z")


class TokenCounter:
    PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, name: str = BYTE_BPE):
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        self.index, self.library = PairIndex(path), Tokenizer.from_file(path)
        self.bytes_of = {c: b for b, c in enumerate(byte_characters())}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.index.special)) + ")")
        self.whole = self.prove()
        self.known: dict[str, int] = {}
        self.held = 0

    def prove(self) -> frozenset[str]:
        """Vocabulary strings that are valid text and come out of the merges as one token."""
        raw = [bytes(map(self.bytes_of.__getitem__, t)) for t in self.index.tokens if t not in self.index.special]
        _, counts = self.index.encode(raw)
        whole = set()
        for text, n in zip(raw, counts.tolist(), strict=True):
            if n == 1:
                try:
                    whole.add(text.decode())
                except UnicodeDecodeError:
                    pass  # part of a character, never a pre-token
        return frozenset(whole)

    def pretokens(self, unit: str) -> list[str]:
        if PLAIN.fullmatch(unit):
            return self.PRETOKENS.findall(unit)
        found = self.library.pre_tokenizer.pre_tokenize_str(unit)
        return [bytes(map(self.bytes_of.__getitem__, word)).decode() for word, _ in found]

    def counts(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit: text between special strings, cut before white space only."""
        split = [self.pretokens(u) for u in units]
        whole, known = self.whole, self.known
        fresh = list({w for ws in split for w in ws if w not in whole and w not in known})
        raw = [w.encode() for w in fresh]
        _, counts = self.index.encode(raw)
        known.update(zip(fresh, counts.tolist(), strict=True))
        out = np.array([sum([1 if w in whole else known[w] for w in ws]) for ws in split], np.int64)
        for w, r in zip(fresh, raw, strict=True):
            if len(r) > LONGEST:
                del known[w]
            else:
                self.held += ENTRY + 2 * len(r)
        if self.held > KNOWN_BYTES:
            known.clear()
            self.held = 0
        return out

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. Texts without special strings and runs of white space are cut by Arrow at blanks."""
        odd = pc.match_substring_regex(texts, RUN)
        for mark in self.index.special:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        pieces = coded.dictionary.to_pylist()
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        used = np.ones(len(numbers), bool)
        wide = {i for i, p in enumerate(pieces) if not p.isascii() and WIDE.search(p)}
        if wide:
            hit = np.isin(numbers, list(wide))
            odd = np.union1d(odd, np.searchsorted(ends, np.flatnonzero(hit), side="right"))
        for i in odd.tolist():
            used[starts[i] : ends[i]] = False
        begins = np.zeros(len(numbers), bool)
        begins[starts] = True
        keep = np.zeros(len(pieces), bool)
        keep[numbers[used & ~begins]] = True
        spaced = np.zeros(len(pieces), np.int64)
        at = np.flatnonzero(keep)
        spaced[at] = self.counts([" " + pieces[i] for i in at.tolist()])
        tokens = np.where(used, spaced[numbers], 0)
        opening = np.flatnonzero(used & begins)
        tokens[opening] = self.counts([pieces[i] for i in numbers[opening].tolist()])
        out = np.add.reduceat(tokens, starts) if len(starts) else np.zeros(0, np.int64)
        for i in odd.tolist():
            out[i] = self.whole_text(texts[i].as_py())
        return out

    def whole_text(self, text: str) -> int:
        total = 0
        for part in self.marks.split(text):
            if part in self.index.special:
                total += 1
            elif part:
                units = [part] if WIDE.search(part) else UNIT.findall(part)
                total += int(self.counts(units).sum())
        return total


@lru_cache(maxsize=1)
def counter(name: str = BYTE_BPE) -> TokenCounter:
    return TokenCounter(name)


def count_tokens(docs: DataFrame, limit: int = 1024, name: str = BYTE_BPE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row; a null text counts as empty.

    Rows are counted where they lie, without a shuffle; a worker holds a slice of a batch (or a single longer text) and
    KNOWN_BYTES of words that it remembers. Repeated rows and null ids give a row each, an empty table none; other columns
    aren't returned.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        for batch in slices(batches):
            texts = texts_of(batch)
            tokens = pa.array(count.texts(texts), pa.int64())
            size = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
