"""Near-duplicate documents by SimHash and pigeonring filtering.

64-bit fingerprints link if at most DISTANCE bits differ. The bits lie on a ring of SEGMENTS segments. If two
fingerprints differ in at most DISTANCE bits, then from some segment on every chain of l segments differs in at most
l * DISTANCE / SEGMENTS bits. The first CHAIN segments of such a chain make a key: each fingerprint is filed under its own
key at every segment, and asks under all keys that the budgets of the chain allow. What meets under a key is tested on
the longer chains, then on all bits.

Links of a key's members are emitted as a spanning forest, never as all pairs: a member is compared with those that are
not reached yet only, so a cloud of copies costs as many links as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, fresh, maybe_among, slices, texts_of, written
from tickloom.llm.graph import components, contracted

WORDS, SEED = 4, 42
DISTANCE = 4
SEGMENTS, CHAIN = 5, 2
#: Members of a key up to which all pairs are tested side by side, and from which on it is split by its chain's next segment.
FEW, MANY = 6, 4096
#: Rows of a split key that are held at a time.
HELD = 1 << 21
#: Parts that a component's nodes are dealt into when they get its name.
SALTS = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SALT = 0x9E3779B97F4A7C15


def fingerprint(text: str) -> int:
    """SimHash of the text's word shingles; zero without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) < WORDS:
        return hashed(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - WORDS].tolist()]
    keys = [hashed(joined[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist(), strict=True)]
    raw = np.array(keys, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 4096):
        ones += np.unpackbits(raw[at : at + 4096], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(keys), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of each row; null and empty texts have fp 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t) for t in texts_of(batch).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, fp long")


def segments(count: int = SEGMENTS) -> list[list[int]]:
    """The bits of each segment."""
    return [list(range(64 * i // count, 64 * (i + 1) // count)) for i in range(count)]


def key_masks(distance: int = DISTANCE, count: int = SEGMENTS, chain: int = CHAIN) -> list[tuple[int, list[int]]]:
    """For each segment, the mask of the key that starts there and the bit patterns by which asked keys may differ."""
    bits = segments(count)
    out = []
    for first in range(count):
        parts = [bits[(first + i) % count] for i in range(chain)]
        patterns = [(0, 0)]
        for length, part in enumerate(parts, 1):
            budget = length * distance // count
            patterns = [
                (pattern | sum(1 << b for b in flipped), used + n)
                for pattern, used in patterns
                for n in range(budget - used + 1)
                for flipped in combinations(part, n)
            ]
        out.append((sum(1 << b for part in parts for b in part), [p for p, _ in patterns]))
    return out


def filed(fps: DataFrame, distance: int = DISTANCE, count: int = SEGMENTS, chain: int = CHAIN) -> DataFrame:
    """key and fp: every fingerprint under its own keys and the keys that it asks for."""
    masks = key_masks(distance, count, chain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(at, 20_000).to_numpy().view(np.uint64)
                for i, (mask, patterns) in enumerate(masks):
                    own = fp & np.uint64(mask)
                    keys = (own[None, :] ^ np.array(patterns, np.uint64)[:, None]).ravel() ^ np.uint64(_SALT * (i + 1) % (1 << 64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(np.tile(fp, len(patterns)).view(np.int64))], ["key", "fp"]
                    )

    return fps.select("fp").mapInArrow(work, "key long, fp long")


def _near(a: np.ndarray, b: np.ndarray, distance: int, chains: list[np.ndarray], budgets: list[int]) -> np.ndarray:
    """Pairs that pass the chain budgets from some segment on, and then the full distance."""
    x = a ^ b
    passed = np.ones(len(x), bool) if not chains else np.zeros(len(x), bool)
    if chains:
        for first in range(len(chains[0])):
            ok = np.ones(len(x), bool)
            for masks, budget in zip(chains, budgets, strict=True):
                ok &= np.bitwise_count(x & masks[first]) <= budget
            passed |= ok
    passed[passed] = np.bitwise_count(x[passed]) <= distance
    return passed


def _chains(distance: int, count: int) -> tuple[list[np.ndarray], list[int]]:
    bits = [sum(1 << b for b in part) for part in segments(count)]
    chains, budgets = [], []
    for length in range(1, count):
        chains.append(np.array([sum(bits[(i + k) % count] for k in range(length)) for i in range(count)], np.uint64))
        budgets.append(length * distance // count)
    return chains, budgets


def flips(bits: list[int], most: int) -> list[tuple[int, int]]:
    """Patterns that flip up to so many of these bits, and how many each flips."""
    return [(sum(1 << b for b in some), n) for n in range(most + 1) for some in combinations(bits, n)]


def split_key(key: int, fp: np.ndarray, distance: int, count: int, chain: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A large key's members under keys of a chain that is longer by a segment, a bounded number of rows at a time.

    Two members that are linked from the key's segment on meet under one of the longer keys, as under the key itself; links
    from other segments on meet under other keys.
    """
    bits = segments(count)
    for first in range(count):
        mask = sum(1 << b for k in range(chain) for b in bits[(first + k) % count])
        value = (key ^ (_SALT * (first + 1))) % (1 << 64)
        if value & ~mask:
            continue
        used = np.bitwise_count((fp ^ np.uint64(value)) & np.uint64(mask))
        following = bits[(first + chain) % count]
        budget = (chain + 1) * distance // count
        part = np.uint64(sum(1 << b for b in following))
        patterns = np.array([(p, n) for p, n in flips(following, budget)], np.uint64)
        # In rounds by the first bits of the new segment, so that few rows are held at a time.
        top = min(len(following), max(0, (len(fp) * len(patterns) // HELD).bit_length()))
        head = np.uint64(sum(1 << b for b in following[:top]))
        for some in range(1 << top):
            wanted = np.uint64(sum(1 << b for k, b in enumerate(following[:top]) if some >> k & 1))
            keys, members = [], []
            for pattern, n in patterns:
                longer = (fp & part) ^ pattern
                ok = (used + np.uint8(n) <= budget) & ((longer & head) == wanted)
                keys.append(longer[ok])
                members.append(fp[ok])
            keys, members = np.concatenate(keys), np.concatenate(members)
            order = np.argsort(keys, kind="stable")
            yield keys[order], members[order]


def bucket_links(
    key: np.ndarray, fp: np.ndarray, distance: int, count: int, chain: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked under each key; key is sorted, fp unsigned. With chain (the segments that the keys
    are made of), large keys are split."""
    chains, budgets = _chains(distance, count)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    small = np.repeat(sizes <= FEW, sizes)
    for step in range(1, FEW):
        at = np.flatnonzero((key[:-step] == key[step:]) & small[:-step]) if step < len(key) else np.zeros(0, np.int64)
        if not len(at):
            break
        a, b = fp[at], fp[at + step]
        ok = _near(a, b, distance, chains, budgets)
        yield a[ok].view(np.int64), b[ok].view(np.int64)
    for s, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        waiting = np.unique(fp[s : s + n])
        if chain is not None and chain < count - 1 and len(waiting) > MANY:
            # Most of a cloud of copies is reached from one of them; only what isn't is split.
            ok = _near(np.full(len(waiting), waiting[0]), waiting, distance, chains, budgets)
            yield np.full(int(ok.sum()), waiting[0]).view(np.int64), waiting[ok].view(np.int64)
            for keys, members in split_key(int(key[s]) % (1 << 64), waiting, distance, count, chain):
                if len(keys):
                    yield from bucket_links(keys.view(np.int64), members, distance, count)
            continue
        reached: list[int] = []
        while len(waiting) or reached:
            if not reached:
                reached.append(int(waiting[0]))
                waiting = waiting[1:]
            x = np.uint64(reached.pop())
            ok = _near(np.full(len(waiting), x), waiting, distance, chains, budgets)
            new = waiting[ok]
            if len(new):
                yield np.full(len(new), x).view(np.int64), new.view(np.int64)
                reached += new.tolist()
                waiting = waiting[~ok]


def links(fps: DataFrame, distance: int = DISTANCE, count: int = SEGMENTS, chain: int = CHAIN, contract: bool = True) -> DataFrame:
    """Pairs a, b of distinct fingerprints (column fp, no repeats) whose components are those of all links.

    No link between two components of the result is missed: any two linked fingerprints meet under some key, and the
    links of a key's members connect all of its members that links connect. Without contract, each pair is itself a link
    (and may repeat).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            # A key's rows follow each other; the last key of a batch waits for the batches that go on with it.
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
                whole = int(np.searchsorted(key, key[-1]))
                if held and (whole or held[-1][0][-1] != key[0]):
                    held.append((key[:whole], fp[:whole]))
                    yield from bucket_links(*map(np.concatenate, zip(*held, strict=True)), distance, count, chain)
                    held = []
                elif whole:
                    yield from bucket_links(key[:whole], fp[:whole], distance, count, chain)
                held.append((key[whole:], fp[whole:]))
            if held:
                yield from bucket_links(*map(np.concatenate, zip(*held, strict=True)), distance, count, chain)

        def plain() -> Iterator[pa.RecordBatch]:
            for a, b in pairs():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        yield from contracted(pairs()) if contract else plain()

    sorted_rows = filed(fps, distance, count, chain).repartition("key").sortWithinPartitions("key")
    return sorted_rows.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, count: int = SEGMENTS, chain: int = CHAIN) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id of the component) of each row.

    Equal fingerprints are one node, however many rows have them; rows without words have fingerprint 0 and link like
    any other. A component whose doc_ids are all null has a null id. Repeated rows are in one component. With more
    than some 10**8 documents, a longer chain keeps keys selective; the result is the same for any count and chain.
    """
    marked = cut(fingerprints(docs))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    hung = components(links(nodes, distance, count, chain)).withColumnRenamed("node", "fp")
    # Only components of several fingerprints need a name of their own. Their nodes are dealt into SALTS parts, so that no
    # task gets all nodes of one.
    joint = cut(hung.union(hung.select("root", "root").distinct()))
    names = joint.join(nodes, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    names = cut(names).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    joint = joint.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    named = joint.join(names, ["root", "salt"]).select("fp", "component_id", F.lit(True).alias("joint"))
    named = cut(nodes.join(named, "fp", "left").select("fp", F.when(F.col("joint"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def document_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of each row of documents; nulls, repeats and empties as in near_duplicates()."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row, written so that every later read sees the same numbers and texts, and its name."""
    (name,) = fresh(docs, "row_")
    return written(docs.withColumn(name, F.monotonically_increasing_id())), name


def first_rows(rows: DataFrame, name: str, found: DataFrame) -> DataFrame:
    """One of the numbered rows for each component: the smallest by doc_id (null last), then by number.

    found: row, doc_id and component of every row, or of those that may be the smallest. Rows that surely stay aren't
    shuffled: what may go is sifted by a map of bits first.
    """
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    kept = cut(found.groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.row").alias(name)))
    gone = cut(rows.select(name).join(kept, name, "left_anti"))
    goes = maybe_among(gone, name)(F.col(name))
    return rows.where(~goes).unionByName(rows.where(goes).join(gone, name, "left_anti")).drop(name)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, whatever its doc_id: that of the smallest doc_id (null last).

    Rows are told apart by number, so rows without a doc_id or with a repeated one only go if their text is a near copy.
    """
    rows, name = numbered(docs)
    found = near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    return first_rows(rows, name, found.join(rows.select(F.col(name).alias("row"), "doc_id"), "row"))
