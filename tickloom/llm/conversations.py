"""Cheapest repair of conversation structure with Four-Russians block tables.

The turns of a conversation become symbols: the role's initial and whether the turn is sound, truncated or has to go. A
repair gives roles that the automaton of `(s?(ua)+)?` accepts. The cost of repairing what follows a turn, for each state of the
automaton, is a vector; less its smallest entry it is one of a few. So for all vectors and all blocks of BLOCK symbols the
vector before the block is computed once, and a pass over a conversation, from its end, is one lookup for each block. Then
the blocks are expanded from the start, with known costs of the rest: of equally cheap edits the one with the least letter
is taken, which gives the least sequence.

Conversations may be of any length: turns are sorted into ranges over all conversations, and what a range makes of any
vector and any state is composed over ranges, so a conversation is worked on by as many tasks as it has ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut

#: Symbols of a block.
BLOCK = 4
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after s, after u, after a. Where an initial leads, the role that may be inserted, what may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ADDED = ("u", "u", "a", "u")
ENDS = (0, 3)
#: Costs after the last turn by state.
FINAL = (0, 6, 3, 0)
#: Symbols: initials of sound turns, the same of truncated ones, turns to delete, and padding before a short block.
INITIALS = ("s", "u", "a", "")
GONE, PAD = 8, 9
SYMBOLS = 10
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"


def _moves(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done with a turn, and of an insertion before it (letter I), in letter order."""
    yield "D", DELETE, state
    yield "I", INSERT, NEXT[state][ADDED[state]]
    if symbol != GONE:
        extra = TRUNCATED * (symbol >= 4)
        if (kept := NEXT[state].get(INITIALS[symbol % 4])) is not None:
            yield "K", extra, kept
        yield "R", REROLE + extra, NEXT[state][ADDED[state]]


def before(symbol: int, rest: tuple[int, ...]) -> tuple[int, ...]:
    """Costs by state before a turn, given those after it."""
    costs = [min(c + rest[to] for letter, c, to in _moves(symbol, q) if letter != "I") for q in range(4)]
    for _ in range(2):
        costs = [min(costs[q], INSERT + costs[NEXT[q][ADDED[q]]]) for q in range(4)]
    return tuple(costs)


def edit(symbol: int, rest: tuple[int, ...], state: int) -> tuple[int, str, str]:
    """State after a turn, the letters of the least cheapest edits up to and with the turn, and the roles that they give (- for others)."""
    costs, letters, roles = before(symbol, rest), "", ""
    while True:
        for letter, cost, to in _moves(symbol, state):
            if cost + (costs if letter == "I" else rest)[to] == costs[state]:
                break
        letters += letter
        roles += ADDED[state] if letter in "IR" else "-"
        state = to
        if letter != "I":
            return state, letters, roles


class Tables:
    """Normalised vectors, and for each block and vector after it the vector before it and the state after it by state before it."""

    def __init__(self) -> None:
        self.vectors, number = [FINAL], {FINAL: 0}
        step: list[list[int]] = []
        for v in self.vectors:  # grows until no symbol gives a new vector
            found = []
            for symbol in range(PAD):
                costs = before(symbol, v)
                costs = tuple(c - min(costs) for c in costs)
                if costs not in number:
                    number[costs] = len(self.vectors)
                    self.vectors.append(costs)
                found.append(number[costs])
            step.append([*found, number[v]])
        n = len(self.vectors)
        self.one = np.array(step, np.uint8).T
        self.one_exit = np.array([[[edit(s, v, q)[0] if s != PAD else q for q in range(4)] for v in self.vectors] for s in range(SYMBOLS)], np.uint8)
        self.before, self.exit = self.one, self.one_exit
        for _ in range(BLOCK - 1):  # a symbol in front of shorter blocks
            rest, states = self.before, self.exit
            self.before = self.one[:, rest].reshape(-1, n)
            first = self.one_exit[:, rest]  # symbol, shorter block, vector after, state before the symbol
            self.exit = np.take_along_axis(np.broadcast_to(states, first.shape), first.astype(np.int64), axis=3).reshape(-1, n, 4)
        self.expanded: dict[tuple[int, int, int], tuple[int, list[tuple[str, str]]]] = {}

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of the blocks, the first one padded in front."""
        padded = np.concatenate((np.full(-len(symbols) % BLOCK, PAD), symbols)).reshape(-1, BLOCK).astype(np.int64)
        return padded @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)

    def expand(self, block: int, after: int, state: int) -> tuple[int, list[tuple[str, str]]]:
        """State after the block and the edits of each of its turns."""
        key = (block, after, state)
        if (known := self.expanded.get(key)) is None:
            symbols = [block // SYMBOLS**k % SYMBOLS for k in range(BLOCK - 1, -1, -1)]
            rest = [after]
            for s in reversed(symbols[1:]):
                rest.append(int(self.one[s, rest[-1]]))
            edits = []
            for s, v in zip(symbols, reversed(rest), strict=True):
                if s != PAD:
                    state, letters, roles = edit(s, self.vectors[v], state)
                    edits.append((letters, roles))
            known = self.expanded[key] = (state, edits)
        return known

    def trace(self, symbols: np.ndarray, after: int, state: int) -> tuple[int, list[tuple[str, str]]]:
        """State after the turns and the edits of each, given the vector after and the state before them."""
        blocks = self.blocks(symbols).tolist()
        rest = [after] if blocks else []
        for b in reversed(blocks[1:]):
            rest.append(int(self.before[b, rest[-1]]))
        edits: list[tuple[str, str]] = []
        for b, v in zip(blocks, reversed(rest), strict=True):
            state, some = self.expand(b, v, state)
            edits += some
        return state, edits

    def maps(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector after these turns: the vector before them, and the state after them by the state before them."""
        blocks, lanes = self.blocks(symbols), np.arange(len(self.vectors))
        rest = np.empty((len(blocks), len(lanes)), np.uint8)
        now = lanes.astype(np.uint8)
        for i in range(len(blocks) - 1, -1, -1):
            rest[i] = now
            now = self.before[blocks[i], now]
        states = np.tile(np.arange(4, dtype=np.uint8), (len(lanes), 1))
        for i, b in enumerate(blocks):
            states = self.exit[b, rest[i][:, None], states]
        return now, states


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def closing(state: int) -> str:
    """Roles to insert after the last turn."""
    roles = ""
    while state not in ENDS:
        roles += ADDED[state]
        state = NEXT[state][ADDED[state]]
    return roles


# ---------------------------------------------------------------- turns in order


def turns(rows: DataFrame) -> DataFrame:
    """Distinct turns (conv_id, turn, role, text's digest) with their number of copies n, faults, and whether they come first.

    Counts combine before they are shuffled, and the first turn of a text meets its rows by all of their keys, so neither a
    text nor a conversation with a large share of all rows gathers in one task. Texts themselves aren't shuffled here.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    faults = F.when(bare == "", F.lit("blank")).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))
    keys = ["conv_id", "turn", "role", "digest"]
    some = rows.select("conv_id", "turn", "role", digest().alias("digest"), faults.alias("fault"))
    counted = some.groupBy(*keys, "fault").agg(F.count("*").alias("n")).withColumn("first", F.lit(False))
    earliest = counted.groupBy("conv_id", "role", "digest", "fault").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("at"))
    earliest = earliest.select("conv_id", F.col("at.turn").alias("turn"), "role", "digest", "fault", F.lit(0).cast("long").alias("n"), F.lit(True).alias("first"))
    return counted.unionByName(earliest).groupBy(*keys, "fault").agg(F.sum("n").alias("n"), F.max("first").alias("first"))


def digest() -> Column:
    return F.unhex(F.sha2(F.encode(F.col("text"), "UTF-8"), 256))


def _symbols(role: np.ndarray, fault: np.ndarray, first: np.ndarray) -> np.ndarray:
    """role: number of the initial in INITIALS."""
    return np.where((fault == "blank") | ~first, GONE, role + 4 * (fault == "truncated")).astype(np.uint8)


class _Range:
    """The turns of one range as arrays."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.table = pa.Table.from_batches(batches)
        numbers = self.table.column("conv_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        self.role = self.table.column("role").combine_chunks()
        initial = pc.utf8_slice_codeunits(self.role, 0, 1).to_numpy(zero_copy_only=False)
        self.initial = np.select([initial == x for x in INITIALS[:3]], [0, 1, 2], 3)
        self.fault = self.table.column("fault").to_numpy()
        self.first = self.table.column("first").to_numpy()
        self.turn = np.array([np.nan if t is None else t for t in self.table.column("turn").to_pylist()], object)
        self.symbols = _symbols(self.initial, self.fault, self.first)
        self.begins = np.concatenate(([0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]))


def _collected(batches: Iterator[pa.RecordBatch]) -> _Range | None:
    held = [b for b in batches if b.num_rows]
    return _Range(held) if held else None


def _summaries(ordered: DataFrame) -> list:
    """One row for each range that has turns: its first and last conversation and what its parts of them make of vectors and states."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _collected(batches)
        if r is None:
            return
        ids, ends = r.table.column("conv_id"), [slice(r.begins[0], r.begins[1]), slice(r.begins[-2], r.begins[-1])]
        (vector, _), (last_vector, last_exit) = (tables().maps(r.symbols[x]) for x in ends)
        turn = r.table.column("turn")[-1].as_py()
        cells = {
            "part": pa.array([r.table.column("part")[0].as_py()], pa.int32()), "head": pa.array([ids[0].as_py()], ids.type), "tail": pa.array([ids[-1].as_py()], ids.type),
            "single": pa.array([len(r.begins) == 2]), "head_vector": pa.array([vector.tobytes()]), "tail_vector": pa.array([last_vector.tobytes()]), "tail_exit": pa.array([last_exit.tobytes()]),
            "turn": pa.array([turn], pa.int64()), "initial": pa.array([int(r.initial[-1])], pa.int32()),
        }
        yield pa.RecordBatch.from_pydict(cells)

    kind = ordered.schema["conv_id"].dataType.simpleString()
    schema = f"part int, head {kind}, tail {kind}, single boolean, head_vector binary, tail_vector binary, tail_exit binary, turn long, initial int"
    return sorted(ordered.mapInArrow(work, schema).collect(), key=lambda x: x["part"])


def _joints(found: list) -> dict[int, tuple[int, int, bool, tuple | None]]:
    """By range: vector after its last turn, state before its first, whether its last conversation goes on, and turn and initial before it."""
    n = len(found)
    goes_on = [i + 1 < n and found[i]["tail"] == found[i + 1]["head"] for i in range(n)]
    after = [0] * n
    for i in range(n - 2, -1, -1):
        if goes_on[i]:
            after[i] = found[i + 1]["head_vector"][after[i + 1] if found[i + 1]["single"] else 0]
    out, state = {}, 0
    for i, x in enumerate(found):
        came = found[i - 1] if i and goes_on[i - 1] else None
        entry = state if came else 0
        out[x["part"]] = (after[i], entry, goes_on[i], (came["turn"], came["initial"]) if came else None)
        state = x["tail_exit"][4 * after[i] + (entry if x["single"] else 0)]
    return out


EDITS = "turn long, role string, digest binary, n long, letters string, roles string, ending string, cost long, blank long, duplicate long, truncated long, illegal long, new_turn long"


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each distinct turn of the conversations, with faults and costs.

    rows: conv_id, turn (long), role, text; null roles and texts count as one blank, turns are taken by turn (nulls first),
    then role and text's digest. letters are those of the edits up to and with the turn (its further copies, n - 1, are
    deleted after it), roles the initials that they give, ending the roles to insert after the conversation's last turn.
    """
    ordered = turns(rows).repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    ordered = cut(ordered.withColumn("part", F.spark_partition_id()))
    joints = _joints(_summaries(ordered))  # a few numbers for each range
    names = [x.split()[0] for x in EDITS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _collected(batches)
        if r is None:
            return
        known = tables()
        after, entry, goes_on, came = joints[r.table.column("part")[0].as_py()]
        done: list[tuple[str, str]] = []
        ending = [""] * len(r.symbols)
        last = len(r.begins) - 2
        for i, (a, b) in enumerate(zip(r.begins[:-1].tolist(), r.begins[1:].tolist(), strict=True)):
            state, some = known.trace(r.symbols[a:b], after if i == last else 0, entry if i == 0 else 0)
            done += some
            if i < last or not goes_on:
                ending[b - 1] = closing(state)
        n = r.table.column("n").to_numpy()
        inserts = np.array([len(x) - 1 for x, _ in done])
        own = np.array([x[-1] for x, _ in done])
        extra = TRUNCATED * ((r.symbols >= 4) & (r.symbols < GONE))
        cost = INSERT * (inserts + np.array([len(x) for x in ending])) + np.select([own == "D", own == "K"], [DELETE, extra], REROLE + extra) + DELETE * (n - 1)
        blank = r.fault == "blank"
        # Neighbours of the first turn in the range are in the range before.
        starts = np.zeros(len(n), bool)
        starts[r.begins[:-1]] = True
        left = np.concatenate(([-1], r.initial[:-1]))
        turn = [None if t != t else t for t in r.turn]
        turn_before = [None, *turn[:-1]]
        if came:
            starts[0], left[0], turn_before[0] = False, came[1], came[0]
        legal = np.isin(4 * left + r.initial, [4 * 0 + 1, 4 * 1 + 2, 4 * 2 + 1])
        new = [t is not None and (bool(s) or t != u) for t, u, s in zip(turn, turn_before, starts, strict=True)]
        values = {
            "turn": r.table.column("turn"), "role": r.role, "digest": r.table.column("digest"), "n": n, "letters": [x for x, _ in done], "roles": [x for _, x in done], "ending": ending,
            "cost": cost, "blank": n * blank, "duplicate": np.where(blank, 0, n - r.first), "truncated": ((r.fault == "truncated") & r.first), "illegal": (~legal & ~starts) + n - 1, "new_turn": np.array(new),
        }
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in EDITS.split(", ")]
        cells = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v if isinstance(v, pa.Array) else pa.array(v.astype(np.int64) if isinstance(v, np.ndarray) else v, k) for v, k in zip((values[c] for c in names), kinds, strict=True)]
        whole = pa.RecordBatch.from_arrays([r.table.column("conv_id").combine_chunks(), *cells], ["conv_id", *names])
        for i in range(0, whole.num_rows, 10_000):
            yield whole.slice(i, 10_000)

    kind = ordered.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(work, f"conv_id {kind}, {EDITS}")


def _sorted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids (kind 0), edits (1) and texts (2), those of a conversation together and in order; a sort that spills, not a group in memory."""
    texts = rows.where(F.rtrim(F.col("text"), F.lit(BLANKS)) != "").select("conv_id", F.lit(2).alias("kind"), "turn", "role", digest().alias("digest"), "text")
    marks = ids.select("conv_id").distinct().withColumn("kind", F.lit(0))
    whole = edits(rows).withColumn("kind", F.lit(1)).unionByName(texts, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    return whole.repartition("conv_id").sortWithinPartitions("conv_id", F.col("kind") > 0, "turn", "role", "digest", "kind")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("conversation", id, None), ("edits", row, text) and so on, in order; a turn's text is None if it isn't kept."""
    waiting = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 2:
                if waiting and (waiting["turn"], waiting["role"], waiting["digest"]) == (row["turn"], row["role"], row["digest"]):
                    yield "edits", waiting, row["text"]
                    waiting = None
                continue
            if waiting:
                yield "edits", waiting, None
            waiting = row if row["kind"] else None
            if not row["kind"]:
                yield "conversation", row, None
    if waiting:
        yield "edits", waiting, None


def _results(row: dict, text: str | None) -> Iterator[tuple[str, str | None, str | None]]:
    """Letter, role and text of each edit of a row, in order; deleted turns have neither."""
    for letter, role in zip(row["letters"], row["roles"], strict=True):
        if letter == "I":
            yield letter, ROLES[role], ""
        else:
            yield (letter, None, None) if letter == "D" else (letter, ROLES.get(role, row["role"]), text)
    for _ in range(row["n"] - 1):
        yield "D", None, None
    for role in row["ending"]:
        yield "I", ROLES[role], ""


def _filled(rows: DataFrame) -> DataFrame:
    """The four columns; null roles and texts are one blank."""
    some = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *some)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (long, from 0), edit (letter), role and text of each turn that stays or is inserted.

    rows: conv_id, turn, role, text; other columns aren't used. Null conv_ids are one conversation, null roles and texts one
    blank, turns without number come first; repeated rows are duplicates and go, as blank turns do. A conversation whose
    turns all go gives no rows; neither does an empty table.
    """
    rows = _filled(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = 0, []
        for what, row, text in _told(batches):
            if what == "conversation":
                place = 0
                continue
            for letter, role, content in _results(row, text):
                if letter != "D":
                    held.append({"conv_id": row["conv_id"], "place": place, "edit": letter, "role": role, "text": content})
                    place += 1
            if len(held) >= 2000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(id_type)), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _sorted(rows, rows).mapInArrow(work, f"conv_id {id_type.simpleString()}, place long, edit string, role string, text string")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: faults, gaps in its turns, cost and letters of the cheapest repair, digest of the repaired text.

    ids: a table whose conv_ids all get a row, those without rows zeros, an empty audit and the digest of an empty text (default:
    rows). Nulls and the rest as in repair. The digest of one text needs its turns one after another, so a conversation's kept
    turns pass through one task, as a sorted stream that isn't held in memory; all other work on it is spread.
    """
    rows = _filled(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        now: dict | None = None
        for what, row, text in _told(batches):
            if what == "conversation":
                if now:
                    held.append(_closed(now))
                    if len(held) >= 2000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                now = {"conv_id": row["conv_id"], "sums": [0] * 6, "low": None, "high": None, "letters": [], "hash": hashlib.sha256(), "any": False}
                continue
            now["sums"] = [a + row[c] for a, c in zip(now["sums"], ("blank", "duplicate", "truncated", "illegal", "cost", "new_turn"), strict=True)]
            if row["turn"] is not None:
                now["low"], now["high"] = min(row["turn"], row["turn"] if now["low"] is None else now["low"]), max(row["turn"], row["turn"] if now["high"] is None else now["high"])
            for letter, role, content in _results(row, text):
                now["letters"].append(letter)
                if letter != "D":
                    now["hash"].update((("\n" if now["any"] else "") + f"{role}:{content}").encode("utf-8", "surrogatepass"))
                    now["any"] = True
        if now:
            held.append(_closed(now))
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = rows.schema["conv_id"].dataType
    columns = [x.split() for x in REPORT.split(", ")]
    schema = pa.schema([("conv_id", to_arrow_type(id_type)), *[(c, pa.int64() if k == "long" else pa.string()) for c, k in columns]])
    return _sorted(rows, rows if ids is None else ids).mapInArrow(work, f"conv_id {id_type.simpleString()}, {REPORT}")


def _closed(now: dict) -> dict:
    blank, duplicate, truncated, illegal, cost, distinct = now["sums"]
    gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - distinct
    counts = {"gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "cost": cost}
    return {"conv_id": now["conv_id"], **counts, "audit": "".join(now["letters"]), "repaired_sha256": now["hash"].hexdigest()}


def damaged(rows: DataFrame) -> DataFrame:
    """rows with planted faults, by crc32 of conv_id:turn (nulls: one blank) modulo 20: 0 drops the row, 1 empties its text, 2 takes its
    sentence ends, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    chosen = _filled(rows).withColumn("_chosen", F.crc32(F.encode(key, "UTF-8")) % 20).where("_chosen != 0")
    text = F.when(F.col("_chosen") == 1, F.lit("")).when(F.col("_chosen") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_chosen") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("_chosen") == 3, 2).otherwise(1).cast("int"))
    return chosen.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """The report on the damaged conversations, for every conv_id of the table."""
    return report(damaged(rows), rows)
