"""Periodic runs, conversation repair and line quality against brute force on small tables."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.documents import documents, empty, texts
from tests.oracle import DATA
from tickloom.llm import conversations, line_crf, queries, runs

# ---------------------------------------------------------------- 11


def plain_runs(w):
    """All runs by comparing the words with themselves at each distance, and the words that stay."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    some = sorted((s, e - s, q) for (s, e), q in found.items())
    gone = {i for s, length, q in some for i in range(s + q, s + length)}
    return some, " ".join(x for i, x in enumerate(w) if i not in gone)


def words_of(text):
    return [x.decode() for x in (text or "").encode().split()]  # bytes split at ASCII white space only


def periodic_texts():
    r = random.Random(3)
    out = []
    for _ in range(150):
        k, n = r.choice([1, 2, 2, 3, 5, 50]), r.randint(0, 200)
        w = [f"w{r.randint(0, k)}" for _ in range(n)]
        if n and r.random() < 0.6:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(2, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if r.random() < 0.3:
                w[r.randrange(n)] = "other"
        out.append(r.choice([" ", "\n ", "\t"]).join(w))
    a, b = "x", "x y"
    for _ in range(9):  # a Fibonacci word, rich in overlapping runs
        a, b = b, f"{b} {a}"
    return out + ["a " * 700 + "b " + "a " * 300, "a b " * 400 + "c " + "a b " * 333, "a a b " * 300, b, "é\x1c " * 12, "\0 \x85 " * 6, "one two\x0bthree " * 4]


def test_runs_equal_brute_force():
    many = periodic_texts()
    found, collapsed = runs.search(pa.array(many))
    for text, got, left in zip(many, found.to_pylist(), collapsed.to_pylist(), strict=True):
        want, kept = plain_runs(words_of(text))
        assert [(x["start"], x["length"], x["period"]) for x in got] == want and left == kept


def test_transforms_are_exact():
    r = np.random.default_rng(1)
    a = r.integers(0, int(runs.PRIME), (3, 64)).astype(np.uint64)
    assert (runs.inverse(runs.transform(a)) == a).all()
    blocks, windows = r.integers(0, 3, (50, 4)).astype(np.uint64), r.integers(0, 3, (50, 11)).astype(np.uint64)
    want = [[(b == w[i : i + 4]).all() for i in range(8)] for b, w in zip(blocks, windows, strict=True)]
    assert (runs.recurrences(blocks, windows) == np.array(want)).all()


def test_long_periods_and_long_texts():
    some = [f"w{i}" for i in range(30_000)]
    got = runs.search(pa.array([" ".join(some * 3), "a " * 300_000]))
    assert got[0].to_pylist() == [[{"start": 0, "length": 90_000, "period": 30_000}], [{"start": 0, "length": 300_000, "period": 1}]]
    assert got[1].to_pylist() == [" ".join(some), "a"]


def expected_runs(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    some, kept = plain_runs(w)
    best = min(some, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in some).encode()).hexdigest()
    return (len(some), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], digest, hashlib.sha256(kept.encode()).hexdigest())


FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_document_runs_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts() + periodic_texts())] + [(None, "a b " * 9), (3, "x " * 40), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("runs", F.lit("x")).withColumn("found_", F.lit(1)).withColumn("best", F.lit(1))
    got = sorted((str(r["doc_id"]), *[str(r[c]) for c in FIELDS]) for r in runs.document_runs(docs).collect())
    assert got == sorted((str(i), *[str(x) for x in expected_runs(i, t)]) for i, t in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows[:-3]) > 10
    assert runs.document_runs(empty(spark)).count() == 0


def test_runs_of_the_given_documents(spark):
    got = {r["doc_id"]: tuple(r[c] for c in FIELDS) for r in queries.op11_block_convolution_runs(spark, DATA).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, t in rows:
        if len(t or "") < 4000:
            assert got[i] == expected_runs(i, t)


def test_other_columns_pass_through(spark):
    out = runs.find_runs(documents(spark, extra=True))
    assert set(documents(spark, extra=True).columns) <= set(out.columns) and {"runs", "collapsed"} <= set(out.columns)


# ---------------------------------------------------------------- 12


def plain_repair(rows):
    """rows: (role, text) in order. Cost, letters and repaired lines by keeping the best (cost, letters) of each state from the end."""
    close = lambda f: [min(f[q], (f[n][0] + 3, "I" + f[n][1])) for q, n in enumerate((2, 2, 3, 2))]
    best = close(close([(0, ""), (99, ""), (99, ""), (0, "")]))
    faults, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    to = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    for (role, _), fault in reversed(list(zip(rows, faults, strict=True))):
        new = []
        for q in range(4):
            options = [(4 + best[q][0], "D" + best[q][1])]
            if fault in ("", "truncated"):
                extra = 3 * (fault == "truncated")
                if role[:1] in to[q]:
                    n = to[q][role[:1]]
                    options.append((extra + best[n][0], "K" + best[n][1]))
                n = (2, 2, 3, 2)[q]
                options.append((3 + extra + best[n][0], "R" + best[n][1]))
            new.append(min(options))
        best = close(close(new))
    cost, letters = best[0]
    state, out, left = 0, [], list(rows)
    for letter in letters:
        role, text = ("", "") if letter == "I" else left.pop(0)
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if state == 2 else "user"
        state = to[state][role[0]]
        out.append(f"{role}:{text}")
    legal = {"su", "ua", "au"}
    illegal = sum(a[0][:1] + b[0][:1] not in legal for a, b in itertools.pairwise(rows))
    return cost, letters, "\n".join(out), [faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal


def plain_reports(table):
    """The contract row by row: damage, order, report."""
    groups = {}
    for conv, turn, role, text in table:
        held = groups.setdefault(conv, [])
        blank = lambda x: " " if x is None else x
        c = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if c == 1:
            text = ""
        if c == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        if c == 4:
            role = "user"
        held += [(turn, role, text)] * ((c != 0) + (c == 3))
    out = []
    for conv, held in groups.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        numbers = [x[0] for x in held if x[0] is not None]
        cost, letters, whole, faults, illegal = plain_repair([x[1:] for x in held])
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((conv, gaps, *faults, illegal, cost, letters, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reports(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def odd_turns():
    r = random.Random(6)
    out = [(1, 0, "system", "Hi."), (2, None, None, None), (2, 5, "user", "What?"), (2, None, "user", "x"), (None, 1, "user", "a."), (None, None, "tool", " \n"), (5, 1, "", "no role."), (7, 3, "agent", "é?\x0b\n")]
    out += [(4, 1, "user", "same."), (4, 1, "user", "same."), (4, 1, "user", "same."), (4, 2, "assistant", "long. " * 60_000)]
    for conv in range(100, 400):
        for turn in range(r.randint(1, 12)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "other"])
            out.append((conv, turn if r.random() < 0.9 else None, role, r.choice(["Yes.", "No", "", "Well!", " ", f"text {r.random()}?"])))
    out += [(9, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Hot.", "so", f"t{t}."])) for t in range(1500)]  # one conversation over several ranges
    return out


def test_repairs_equal_brute_force(spark):
    rows = odd_turns()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    table = table.withColumn("digest", F.lit("x")).withColumn("kind", F.lit(7)).withColumn("n", F.lit("y"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = reports(conversations.repaired_conversations(table))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_reports(rows)


def test_repaired_turns_are_those_of_the_digest(spark):
    rows = [x for x in odd_turns() if x[0] is not None]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    whole = {}
    for r in sorted(conversations.repair(table).collect(), key=lambda x: (x["conv_id"], x["place"])):
        whole.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    want = {r["conv_id"]: r["repaired_sha256"] for r in conversations.report(table).collect()}
    assert {c: hashlib.sha256("\n".join(whole.get(c, [])).encode()).hexdigest() for c in want} == want


def test_block_tables_equal_single_steps():
    known, r = conversations.tables(), random.Random(2)
    assert len(known.vectors) < 64 and all(max(v) <= 7 for v in known.vectors)
    for _ in range(500):
        symbols = np.array([r.randint(0, 8) for _ in range(r.randint(1, 14))], np.uint8)
        after, state = r.randrange(len(known.vectors)), r.randrange(4)
        vector, want, letters = known.vectors[after], state, []
        rest = [vector]
        for s in symbols[:0:-1].tolist():
            rest.append(conversations.before(s, rest[-1]))
        for s, v in zip(symbols.tolist(), reversed(rest), strict=True):
            want, x, y = conversations.edit(s, v, want)
            letters.append((x, y))
        assert known.trace(symbols, after, state) == (want, letters)
        before, states = known.maps(symbols)
        first = conversations.before(int(symbols[0]), rest[-1])
        assert known.vectors[before[after]] == tuple(x - min(first) for x in first) and states[after, state] == want


def test_conversations_that_lose_all_turns_and_empty_tables(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(lost, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    assert reports(conversations.repaired_conversations(table)) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repaired_conversations(table.limit(0)).count() == 0 and conversations.repair(table.limit(0)).count() == 0


def test_reports_of_the_given_conversations(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{DATA}/conversations.parquet'").fetchall()
    assert reports(queries.op12_four_russians_repair(spark, DATA)) == plain_reports(rows)


# ---------------------------------------------------------------- 13


def test_passes_equal_brute_force():
    r = np.random.default_rng(4)
    features, counts, good = r.normal(size=(12, line_crf.WIDTH)), np.array([3, 0, 5, 1, 3]), np.array([1.0, 0, 0, 1, 1])
    theta = 0.3 * r.normal(size=line_crf.WIDTH + 4)
    odds, ties = features @ theta[: line_crf.WIDTH], theta[line_crf.WIDTH :].reshape(2, 2)
    ahead, back, total = line_crf.passes(odds, counts, ties)
    want, whole, value = np.zeros(12), 0.0, 0.0
    for a, b, y in zip(np.cumsum(counts) - counts, np.cumsum(counts), good, strict=True):
        weights = {}
        for labels in itertools.product((0, 1), repeat=int(b - a)):
            weights[labels] = np.exp(odds[a:b] @ np.array(labels) + sum(ties[u, v] for u, v in itertools.pairwise(labels))) if labels else 1.0
        z = sum(weights.values())
        whole += np.log(z)
        value += np.log(weights[(int(y),) * int(b - a)] / z)
        for labels, w in weights.items():
            want[a:b] += w / z * np.array(labels)
    assert np.allclose(1 / (1 + np.exp(-(ahead + back))), want) and abs(total - whole) < 1e-9
    got, slope = line_crf.likelihood(theta, features, counts, good)
    assert abs(got - value) < 1e-9
    step = 1e-5
    for i in range(0, len(theta), 7):
        e = np.eye(len(theta))[i] * step
        rise = line_crf.likelihood(theta + e, features, counts, good)[0] - line_crf.likelihood(theta - e, features, counts, good)[0]
        assert abs(rise / (2 * step) - slope[i]) < 1e-6


def test_features_of_lines():
    cells, size, counts = line_crf.line_features(pa.array(["One two two .\n\n  \nAB 12 #$\nOne two two .", "", "é é"]))
    names = line_crf.OWN
    assert counts.tolist() == [3, 0, 1] and size.tolist() == [13, 8, 13, 5]
    at = lambda i, c, part=0: cells[i, part * len(names) + names.index(c)]
    assert [at(i, "duplicate") for i in range(4)] == [0, 0, 1, 0] and [at(i, "ends") for i in range(4)] == [1, 0, 1, 0]
    assert at(0, "adjacent") == 1 / 4 and at(1, "symbols") == 2 / 6 and at(1, "upper") == 1 and at(1, "digits") == 2 / 6
    assert at(1, "ends", 1) == 1 and at(1, "duplicate", 2) == 1 and at(0, "ends", 1) == 0 and at(2, "symbols", 1) == 2 / 6 and at(3, "letters") == 1


def test_held_out_quality(spark):
    out = {r["doc_id"]: r for r in queries.op13_line_field_quality(spark, DATA).collect()}
    marks = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall())
    assert len(out) == len(duckdb.sql(f"SELECT doc_id FROM '{DATA}/documents.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in out.items())
    pairs = [(out[i]["predicted"], q) for i, q in marks.items() if i in out and out[i]["held_out"]]
    assert len(pairs) > 50 and sum(a == b for a, b in pairs) >= 0.95 * len(pairs)


def test_scores_of_odd_texts(spark):
    docs = documents(spark, extra=True).withColumn("text", F.when(F.col("doc_id") == 8, F.expr("repeat('Good line.\n', 20000)")).otherwise(F.col("text")))
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(20)] + [(2, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = line_crf.document_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1 and len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1
    assert {r["score"] for r in line_crf.document_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert line_crf.document_quality(empty(spark), labels).count() == 0
    kept = line_crf.labelled(docs, labels, fit_rows=3)
    assert kept.count() <= 3
    # What isn't the text or a label of the learned ones changes nothing.
    again = {r["doc_id"]: r["score"] for r in line_crf.document_quality(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz")), labels).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}


def test_maximise_finds_the_top():
    target = np.arange(5.0)
    got = line_crf.maximise(lambda x: (-float(((x - target) ** 2) @ np.array([1, 10, 3, 0.5, 2])), -2 * (x - target) * np.array([1, 10, 3, 0.5, 2])), np.zeros(5))
    assert np.allclose(got, target, atol=0.1)
