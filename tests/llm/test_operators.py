"""The corpus operators against brute force on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.documents import documents, empty, texts
from tests.oracle import DATA, connection, differences
from tickloom.llm import bpe, common, langid, line_templates, packing, phrases, quality, queries, secrets, sharding, simhash, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def rows_by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


# ---------------------------------------------------------------- 1


def test_shards_are_exact_and_gapless(spark, docs):
    out = sharding.shard(docs.withColumnRenamed("lang", "shard"), 5).collect()
    assert len(out) == docs.count()
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))


def test_shards_of_documents(docs):
    out = sharding.shard_documents(docs).collect()
    text = dict(enumerate(texts()))
    for r in out:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_matrix_has_its_margins_and_law():
    counts, sizes = [5, 0, 7, 3], sharding.exact_sizes(15, 4)
    m = sharding.communication_matrix(counts, sizes, 1)
    assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes.tolist()
    draws = [sharding.communication_matrix([10, 10], np.array([10, 10]), s)[0, 0] for s in range(400)]
    assert abs(np.mean(draws) - 5) < 0.3 and abs(np.var(draws) - 10 * 10 * 10 * 10 / (20 * 20 * 19)) < 0.4
    # A large population by its own method, and small ones by both.
    rng = np.random.Generator(np.random.PCG64(4))
    for good, bad, taken in ((30, 50, 20), (1000, 3000, 500), (25 * 10**9, 975 * 10**9, 10**9)):
        n = good + bad
        found = np.array([sharding.draw(rng, good, bad, taken, 0) for _ in range(4000)])
        variance = taken * good / n * bad / n * (n - taken) / (n - 1)
        assert abs(found.mean() - taken * good / n) < 4 * (variance / 4000) ** 0.5 and abs(found.var() / variance - 1) < 0.12
    from math import comb, log

    for x in range(21):
        want = log(comb(30, x) * comb(50, 20 - x)) - log(comb(80, 20))
        assert abs(sharding.log_hypergeometric(x, 30, 50, 20) - want) < 1e-9
    big = sharding.communication_matrix([6 * 10**9, 4 * 10**9], np.array([5 * 10**9, 5 * 10**9]), 3)
    assert big.sum(1).tolist() == [6 * 10**9, 4 * 10**9] and (big >= 0).all()


# ---------------------------------------------------------------- 2, 9


def test_token_counts_equal_the_library(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = rows_by_id(token_counts.count_tokens(docs))
    for i, t in enumerate(texts()):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (out[i]["n_tokens"], out[i]["n_bytes"], out[i]["over_limit"]) == (n, len((t or "").encode()), n > 1024), repr(t)[:80]


#: Pieces of which the odd texts below are made.
ODD = ["\0", "!", "y", "x ", "\x01", "\x1f", "\x7f", "\x85", "\xa0", "\u0301", "é", "e\u0301", "İ", "ﬁ", "Σς", "<|endoftext|>", "<|startoftext|>", "<|"]
ODD += ["|>", "'s", "'LL", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "12", "½", "日本", "👍🏽", "\u200d", "\u2028", "\ufeff", "a.", "ẞ", "\0\0", "\x007", "ǅ", "A", "token"]


def test_odd_texts_are_encoded_as_by_the_library():
    import random

    r = random.Random(5)
    odd = ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["x\0!y", "\0!!!", "\0" + "5", "a" * 5000, "\0" * 300]
    words, counts = (Tokenizer.from_file(public_tokenizers.path(f"{n}.json")) for n in ("word_bpe_49k", "byte_bpe_50k"))
    encoder = bpe.chunk_encoder()
    for at in range(0, len(odd), 500):
        batch = pa.array(odd[at : at + 500])
        numbers, distinct = bpe.encoded_chunks(batch, encoder)
        n_tokens = token_counts.counter().texts(batch)
        for i, t in enumerate(batch.to_pylist()):
            ids = words.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(b"".join([distinct[k] for k in numbers[i]]), "<u4").tolist() == ids, repr(t)
            assert " ".join([encoder.decode(distinct[k]) for k in numbers[i] if distinct[k]]) == words.decode(ids, skip_special_tokens=False)
            assert n_tokens[i] == len(counts.encode(t, add_special_tokens=False).ids), repr(t)


def test_memory_of_words_is_bounded():
    encoder = bpe.ChunkEncoder()
    encoder.limit = 20_000
    want = bpe.chunk_encoder().encode(["abc", "x" * 1000, "<|endoftext|>"])
    for i in range(5):
        assert encoder.encode(["abc", "x" * 1000, "<|endoftext|>"]) == want
        encoder.encode([f"word{i}{k}" for k in range(300)])
        assert encoder.held <= 20_000 and "x" * 1000 not in encoder.known


def test_whole_tokens_are_proved():
    counter = token_counts.counter()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = sorted(counter.whole)[::997]
    for t in some:
        assert len(library.encode(t, add_special_tokens=False).ids) == 1


def test_codec_equals_the_library(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, full = rows_by_id(bpe.digests(docs)), rows_by_id(bpe.encode(docs))
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        assert full[i]["ids"] == ids and full[i]["decoded"] == shown, repr(t)[:80]
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(shown.encode()).hexdigest()


def test_few_and_many_positions_merge_alike(monkeypatch):
    index = bpe.chunk_encoder().index
    from tests.llm.documents import words

    sample = [w.encode() for w in words(9, 3000, "abcdeinort")] + [b"a" * 7, b"aaab", b""]
    ids, counts = index.encode(sample)
    monkeypatch.setattr(bpe, "FEW", 0)
    again, counts_again = index.encode(sample)
    assert (ids == again).all() and (counts == counts_again).all()


# ---------------------------------------------------------------- 3


def test_base_counts(docs):
    out = rows_by_id(quality.score(docs))
    for i, t in enumerate(texts()):
        t = t or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(out[i][c] for c in quality.BASE) == want, repr(t)[:80]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert out[i]["base_failed"] == failed and not (failed and out[i]["kept"])


def test_estimates_equal_brute_force(spark):
    rules = ["a", "b", "c"]
    rows = [([1, 1, None], 50), ([0, 0, 1], 9), ([1, 0, 0], 7), ([None, None, None], 4), ([0, 1, 1], 3)]
    got = quality.estimate(spark.createDataFrame(rows, "votes array<int>, n long"), rules)
    right = {k: v[0] for k, v in quality.PRIORS.items()}
    both = {k: sum(v) for k, v in quality.PRIORS.items()}
    now = {"share": right["share"] / both["share"], **{(r, k): right[k] / both[k] for r in range(3) for k in ("good", "bad")}}
    for _ in range(quality.ITERATIONS):
        ps = []
        for v, _n in rows:
            g, b = now["share"], 1 - now["share"]
            for r, x in enumerate(v):
                if x is not None:
                    g *= now[r, "good"] if x else 1 - now[r, "good"]
                    b *= 1 - now[r, "bad"] if x else now[r, "bad"]
            ps.append(g / (g + b))
        new = {"share": (sum(n * p for (_, n), p in zip(rows, ps, strict=True)) + right["share"]) / (sum(n for _, n in rows) + both["share"])}
        for r in range(3):
            for k, want in (("good", 1), ("bad", 0)):
                weight = [n * (p if k == "good" else 1 - p) for (_, n), p in zip(rows, ps, strict=True)]
                hit = sum(w for (v, _), w in zip(rows, weight, strict=True) if v[r] == want)
                every = sum(w for (v, _), w in zip(rows, weight, strict=True) if v[r] is not None)
                new[r, k] = (hit + right[k]) / (every + both[k])
        now = new
    assert abs(got["good"] - now["share"]) < 1e-3
    for r, name in enumerate(rules):
        assert abs(got[f"{name}_good"] - now[r, "good"]) < 1e-3 and abs(got[f"{name}_bad"] - now[r, "bad"]) < 1e-3


# ---------------------------------------------------------------- 4


def test_recurring_templates_go_but_from_the_first_document(docs):
    out = rows_by_id(line_templates.drop_recurring(docs))
    held = [i for i, t in enumerate(texts()) if t and t.startswith("Copyright")]
    assert out[held[0]]["n_dropped"] == 0
    for i in held[1:]:
        assert out[i]["n_dropped"] == 1 and not out[i]["text"].startswith("Copyright") and out[i]["text"].startswith("unique")
    untouched = [i for i in out if i not in held]
    assert all(out[i]["n_dropped"] == 0 and out[i]["text"] == texts()[i] for i in untouched)
    assert out[0]["text"] is None and out[0]["n_lines"] == 0


def test_line_templates_equal_their_sql(spark, docs):
    ours = queries.op4_line_templates(spark, DATA).toPandas()
    assert differences(ours, connection().execute(line_templates.SQL).df()) == ""
    con = connection()
    con.execute("DROP VIEW documents")
    frame = docs.dropDuplicates(["doc_id"]).toPandas()
    con.register("documents", frame)
    found = line_templates.drop_recurring(docs.dropDuplicates(["doc_id"])).select("doc_id", "n_lines", "n_dropped", "text").toPandas()
    assert differences(found, con.execute(line_templates.SQL).df()) == ""


def dropped(spark, rows, **settings):
    df = spark.createDataFrame(list(enumerate(rows)) if isinstance(rows[0], str) else rows, "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(df, **settings).collect()}


def test_passages_inside_longer_lines_go(spark):
    from tests.llm.documents import words

    passage = " ".join(" ".join(words(600 + i, 12)).capitalize() + "." for i in range(5))
    own = [" ".join(words(700 + i, 14)) + "." for i in range(8)]
    rows = [f"{a} {passage} {b}\nlast of {a}" for a, b in zip(own[:4], own[4:], strict=True)]
    got = dropped(spark, rows)
    assert got[0] == rows[0] and [got[i] for i in (1, 2, 3)] == [f"{own[i]} {own[4 + i]}\nlast of {own[i]}" for i in (1, 2, 3)]


@pytest.mark.parametrize("n", [60, 3000])
def test_fields_are_fields_in_small_and_large_leaves(spark, n):
    rows = [f"Posted by user name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} in section {'abcdefghijklmnopqrstuvwxyz'[i % 20] * 3} of the old board\nown line {chr(97 + i % 26)} {i}x" for i in range(n)]
    got = dropped(spark, rows)
    assert got[0] == rows[0] and all(not got[i].startswith("Posted") for i in range(1, n))


def test_one_text_does_not_make_a_token_recur(spark):
    rows = [" is here to stay\n".join(f"alpha beta gamma {w}" for w in ("one", "two", "three")) + " is here to stay", "alpha beta gamma four was not here to go", "other"]
    assert dropped(spark, rows) == dict(enumerate(rows))


def test_documents_of_very_many_recurring_lines(spark):
    import time

    lines = [f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)} of the very long list of words" for i in range(100_000)]
    start = time.time()
    got = dropped(spark, ["\n".join([f"own {i}z", *lines]) for i in "abcd"])
    assert [len(got[i]) < 20 for i in range(4)] == [False, True, True, True] and time.time() - start < 120


def test_rows_without_or_with_repeated_ids(spark):
    line = "a line that all of these rows do have"
    rows = [(None, f"{line}\nx"), (None, f"{line}\ny"), (5, f"{line}\nz"), (5, f"{line}\nw"), (7, f"{line}\nv"), (7, f"{line}\nv"), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in line_templates.drop_recurring(df).collect()), key=str)
    assert got == sorted([(None, "x"), (None, "y"), (5, f"{line}\nz"), (5, f"{line}\nw"), (7, "v"), (7, "v"), (8, None), (9, "")], key=str)


# ---------------------------------------------------------------- 5


def test_fingerprints_follow_the_next_document(docs):
    out = rows_by_id(phrases.fingerprint(docs.dropDuplicates(["doc_id"])))
    every = [t or "" for t in texts()]
    sign = phrases.signatures(every)
    for i, t in enumerate(every):
        following = every[(i + 1) % len(every)]
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        assert out[i]["n_chars"] == len(t) and out[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert out[i]["fingerprint"] == phrases.shown(sign[i : i + 1])[0]
        assert out[i]["edited_fingerprint"] == phrases.shown(phrases.signatures([changed]))[0]
    assert out[4]["fingerprint"] == out[5]["fingerprint"] != out[7]["fingerprint"]
    assert out[7]["near_edited"] > 0.4 > 0.1 > out[7]["near_next"]
    assert phrases.fingerprint(docs).count() == docs.count()


def brute_names(text):
    """The sketch of one text, symbol by symbol."""
    full = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    out, level = [0xFFFF] * 64, 0
    names = [ord(c) + 1 for c in text]
    while names:
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if n == 1 else mixed((x * 2 + mixed(n)) & full) for x, n in runs]
        labels = names
        for _ in range(4):
            new = []
            for i, x in enumerate(labels):
                low = 0 if not i else (x ^ labels[i - 1] & full).bit_length() and ((x ^ labels[i - 1]) & -(x ^ labels[i - 1])).bit_length() - 1
                new.append(2 * low + (x >> low & 1))
            labels = new
        blocks = []
        for i, x in enumerate(names):
            top = i and labels[i] > labels[i - 1] and (i + 1 == len(names) or labels[i] > labels[i + 1])
            if not i or top:
                blocks.append(0)
                place = 0
            blocks[-1] = (blocks[-1] + mixed((x + place * 0x94D049BB133111EB) & full)) & full
            place += 1
        names = [mixed(b) for b in blocks]
        level += 1
        if level >= 2 or len(names) == 1:
            for x in names:
                out[x % 64] = min(out[x % 64], (x >> 6) % 0xFFFF)
        if len(names) == 1:
            break
    return out


def test_fingerprints_equal_brute_force():
    from tests.llm.documents import words

    every = [t or "" for t in texts()] + ["a" * 3000, "ab" * 500, " ".join(words(77, 300)), "\0\0x", "日本" * 40]
    got = phrases.signatures(every)
    for i, t in enumerate(every):
        assert got[i].tolist() == brute_names(t), repr(t)[:60]


def test_rows_of_one_id_follow_each_other(spark):
    rows = [(None, "ab cd"), (None, "abc"), (3, "x y z"), (3, "x y z"), (3, "x a b"), (9, None)]
    got = phrases.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == sorted((i or -1, len(t or "")) for i, t in rows)
    a = next(r for r in got if r["doc_id"] == 9)
    assert a["edited_sha256"] == hashlib.sha256(b"").hexdigest()


def test_equal_substrings_share_names_at_any_offset():
    from tests.llm.documents import words

    body = " ".join(words(5, 800))
    a, b, c = phrases.signatures([body, "other beginning " + body[3:], " ".join(words(6, 800))])
    assert phrases.likeness(a[None], b[None])[0] > 0.85 and phrases.likeness(a[None], c[None])[0] < 0.1


# ---------------------------------------------------------------- 6


def test_packing_is_whole_and_tight(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack(docs).collect()
    want = Counter()
    for i, t in enumerate([*texts(), texts()[5], texts()[5]]):
        i = i if i < len(texts()) else 5
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k, b in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[b : b + packing.CAPACITY]
            want[(i, k, b, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    bound = packing.lower_bound(np.array([r["length"] for r in out]))
    assert len(by) == bound
    # A small table is one group, so its certificate is that of the whole packing.
    assert {(r["group_bins"], r["group_bound"]) for r in out} == {(len(by), bound)}


def test_certificate_of_a_whole_packing(spark):
    rows = spark.createDataFrame([(2100, 1), (2100, 2), (2100, 3), (1900, 3)], "length long, sequence_id long")
    assert tuple(packing.certificate(rows).first()) == (3, 3, 0)
    assert tuple(packing.certificate(rows.where("length = 1900").union(rows.where("sequence_id = 1"))).first()) == (2, 1, 1)
    assert tuple(packing.certificate(rows.limit(0)).first()) == (0, 0, 0)


def test_lower_bounds_hold_and_beat_the_volume():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 4097, 200)
        _, offsets, rooms = packing.best_fit(lengths)
        bound = packing.lower_bound(lengths)
        assert -(-int(lengths.sum()) // 4096) <= bound <= len(rooms)
        assert (offsets + lengths <= 4096).all()
    assert packing.lower_bound(np.full(10, 2100)) == 10  # halves that don't pair up
    assert packing.lower_bound(np.full(9, 1400)) == 5  # two to a bin


# ---------------------------------------------------------------- 7


def test_languages_are_told_apart(spark):
    from tests.llm.documents import words

    kinds = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = [(i, " ".join(words(i, 60, alphabet)), lang) for i, (lang, alphabet) in enumerate(list(kinds.items()) * 20)]
    df = spark.createDataFrame([*rows, (90, None, "aa"), (91, "123 !", "bb"), (92, "", None)], "doc_id long, text string, lang string")
    out = rows_by_id(langid.document_languages(df))
    for i, _, lang in rows:
        assert out[i]["lang_pred"] == lang and 0.5 < out[i]["score"] <= 1
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (90, 91, 92))


def test_scores_equal_exact_ngram_sets(spark):
    """A filter that is nearly empty answers as sets of n-grams do."""
    from tests.llm.documents import words

    def grams(text):
        flat = "".join(c if c.isalpha() else " " for c in text.lower())
        flat = " " + re.sub(" +", " ", flat) + " "
        flat = re.sub(" +", " ", flat)
        return [flat[i : i + 3] for i in range(len(flat) - 2) if flat[i + 1] != " "]

    kinds = {"aa": "abcdef", "bb": "defghi", "cc": "ghijkl"}
    rows = [(i, " ".join(words(i, 40, alphabet)), lang) for i, (lang, alphabet) in enumerate(list(kinds.items()) * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    known = {lang: {g for _, t, k in rows if k == lang for g in grams(t)} for lang in kinds}
    asked = [" ".join(words(900 + i, 30, "abcdefghijkl"[i % 7 : i % 7 + 5])) + ", 12 " for i in range(20)] + ["zzz", "a", "é ab"]
    best, top, has = langid.scores(model, asked)
    for i, t in enumerate(asked):
        shares = {lang: sum(g in known[lang] for g in grams(t)) / len(grams(t)) for lang in kinds}
        assert abs(top[i] - max(shares.values())) < 1e-3 and has[i], t
        assert shares[model.languages[best[i]]] >= max(shares.values()) - 1e-3


def test_ties_repeats_and_rare_languages(spark):
    rows = [(1, "abc abc", "bb"), (1, "abc abc", "bb"), (2, "abc abc", "aa"), (3, "xyz xyz", "cc"), (4, None, "aa"), (None, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in langid.predict(df, model).collect())
    assert model.languages == ("aa", "bb", "cc")
    assert got == [(0, "aa"), (1, "aa"), (1, "aa"), (2, "aa"), (3, "cc"), (4, "und")]  # ties go to the first language


def test_filter_has_no_false_negatives_and_known_chance():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 62, 20_000).astype(np.uint64)
    masks = np.zeros((1, langid.SLOTS), np.uint64)
    for p in range(langid.PROBES):
        masks[0, langid.slots(keys, p)] |= np.uint64(1)
    model = langid.Model(("aa",), masks)
    hit = lambda ks: np.bitwise_and.reduce([masks[0][langid.slots(ks, p)] for p in range(langid.PROBES)]) & np.uint64(1)
    assert hit(keys).all()
    other = rng.integers(1, 1 << 62, 200_000).astype(np.uint64)
    assert abs(hit(other).mean() - model.chance()[0]) < 3e-4


def test_no_labelled_rows_give_no_language(spark, docs):
    model = langid.fit(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, model).collect()} == {"und"}


# ---------------------------------------------------------------- 8

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute_secrets(t):
    found = [("assign", m.start(), m.end()) for m in re.finditer(ASSIGN, t, re.ASCII) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_secrets_equal_brute_force(docs):
    out = rows_by_id(secrets.document_findings(docs))
    for i, t in enumerate(texts()):
        base = brute_secrets(t or "")
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert out[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest(), repr(t)[:80]
        assert [out[i][f"n_{k}"] for k in secrets.BASE] == [sum(x[0] == k for x in base) for k in secrets.BASE]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(out[i]["spans"].split(",")) | {""}
    kinds = {s.split(":")[0] for r in out.values() for s in r["spans"].split(",") if s}
    assert kinds >= {"assign", "access", "hex", "vendor", "url_login", "private_key"}


def test_only_unseen_blobs_are_scanned(spark, docs):
    ledger = secrets.scan(docs).cache()
    assert ledger.count() == docs.select("text").fillna("").distinct().count()
    more = docs.unionByName(spark.createDataFrame([(99, "token = abcdefgh", "en", "s", 16)], docs.schema))
    new = secrets.scan(more, ledger)
    assert new.count() == 1
    assert secrets.scan(docs, ledger, rule_version=2).count() == ledger.count()
    assert secrets.document_findings(more, ledger).count() == more.count()


def test_a_ledger_outlives_a_run(spark, docs, tmp_path):
    path = f"{tmp_path}/ledger"
    first = docs.where("doc_id < 12")
    n = secrets.update(first, path).count()
    assert n == first.select("text").fillna("").distinct().count()
    both = secrets.update(docs, path)
    assert both.count() == docs.select("text").fillna("").distinct().count() == secrets.update(docs, path).count()
    assert secrets.update(docs.where("doc_id < 4"), path, rule_version=2).where("rule_version = 2").count() == 3
    got = secrets.findings(docs, spark.read.schema(secrets.LEDGER).parquet(path))
    assert rows_by_id(secrets.digest(got)) == rows_by_id(secrets.document_findings(docs))
    assert rows_by_id(secrets.ledger_findings(docs, f"{tmp_path}/other")) == rows_by_id(secrets.document_findings(docs))


def test_long_hostile_texts_are_scanned_once():
    import time

    start = time.time()
    for t in ("eyJ" * 2_000_000, "token " * 500_000, "a" * 5_000_000, "ghp_" * 800_000, "x://" * 800_000, "-----BEGIN " * 200_000, "AKIA" * 4):
        secrets.find(t)
    assert time.time() - start < 40
    whole = "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh_-1"
    assert [x for x in secrets.find(f"a={whole} x{whole}") if x[0] == "jwt"] == [("jwt", 2, 2 + len(whole)), ("jwt", 4 + len(whole), 4 + 2 * len(whole))]


def test_redaction_covers_what_was_found(docs):
    out = rows_by_id(secrets.redact(docs))
    for i, t in enumerate(texts()):
        if t is None or not secrets.find(t):
            assert out[i]["text"] == t
        else:
            assert out[i]["text"] != t and not brute_secrets(out[i]["text"])


# ---------------------------------------------------------------- 10


def brute_fingerprint(t):
    w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: dict[int, int], distance: int = 4) -> dict[int, int]:
    up = {i: i for i in fps}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in fps.items():
        for j, b in fps.items():
            if i < j and (a ^ b).bit_count() <= distance:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in fps}


def test_simhash_equals_brute_force(docs):
    out = rows_by_id(simhash.document_components(docs))
    fps = {i: brute_fingerprint(t or "") for i, t in enumerate(texts())}
    want = brute_components(fps)
    for i in fps:
        assert (out[i]["fingerprint"], out[i]["component_id"]) == (f"{fps[i]:016x}", want[i])


@pytest.mark.parametrize(("distance", "count", "chain"), [(4, 5, 2), (4, 5, 1), (4, 5, 3), (3, 4, 2), (4, 3, 2)])
def test_no_link_is_lost(spark, distance, count, chain):
    rng = np.random.default_rng(distance * count)
    fps = {}
    for _ in range(40):
        fp = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(int(rng.integers(1, 12))):
            fps[len(fps)] = fp
            for b in rng.choice(64, int(rng.integers(0, distance + 2)), replace=False).tolist():
                fp ^= 1 << b
    signed = {i: f - (1 << 64) if f >= 1 << 63 else f for i, f in fps.items()}
    nodes = spark.createDataFrame([(f,) for f in set(signed.values())], "fp long")
    from tickloom.llm.graph import components

    hung = {r["node"]: r["root"] for r in components(simhash.links(nodes, distance, count, chain)).collect()}
    want, got = {}, {}
    for i, c in brute_components(fps, distance).items():
        want.setdefault(c, set()).add(signed[i])
    for f in set(signed.values()):
        got.setdefault(hung.get(f, f), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize(("distance", "count", "chain"), [(4, 5, 2), (4, 5, 1), (3, 4, 1)])
def test_split_keys_lose_no_link(monkeypatch, distance, count, chain):
    from tickloom.llm.graph import Forest

    monkeypatch.setattr(simhash, "MANY", 10)
    monkeypatch.setattr(simhash, "HELD", 500)
    rng = np.random.default_rng(chain)
    # All share the first two segments but for a bit or so, so their keys are hot.
    fps = set()
    for _ in range(150):
        fp = int(rng.integers(0, 1 << 38)) << 26
        for _ in range(3):
            fps.add(fp)
            for b in rng.choice(64, int(rng.integers(1, distance + 1)), replace=False).tolist():
                fp ^= 1 << b
    filed = [(((f & m) ^ p) ^ (simhash._SALT * (i + 1) % (1 << 64)), f) for f in fps for i, (m, ps) in enumerate(simhash.key_masks(distance, count, chain)) for p in ps]
    filed = np.array(filed, np.uint64)
    filed = filed[np.argsort(filed[:, 0].view(np.int64), kind="stable")]
    forest = Forest()
    for a, b in simhash.bucket_links(filed[:, 0].view(np.int64).copy(), filed[:, 1].copy(), distance, count, chain):
        for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True):
            assert (x ^ y).bit_count() <= distance
            forest.join(x, y)
    want = brute_components({f: f for f in sorted(fps)}, distance)
    assert all(forest.root(f) == want[f] for f in fps) and len(set(want.values())) < len(fps)


def test_components_of_chains_and_stars(spark):
    from tickloom.llm.graph import components

    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 201)) and all(found[1001 + i] == 1000 for i in range(300)) and 5000 not in found


def test_one_document_of_each_component_stays(docs):
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    want = brute_components({i: brute_fingerprint(t or "") for i, t in enumerate(texts())})
    assert sorted(kept) == sorted(set(want.values()))


# ---------------------------------------------------------------- all


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_and_clashing_columns(spark, tmp_path, name):
    for folder, docs in (("none", empty(spark)), ("extra", documents(spark, extra=True))):
        docs.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        docs.withColumn("quality", F.col("doc_id") % 2).write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        talks = docs.withColumn("conv_id", F.col("doc_id")).withColumn("turn", F.col("n_chars")).withColumn("role", F.lit("user"))
        talks.write.parquet(f"{tmp_path}/{folder}/conversations.parquet")
    assert queries.QUERIES[name](spark, f"{tmp_path}/none").count() == 0
    assert queries.QUERIES[name](spark, f"{tmp_path}/extra").count() >= len(texts())


def test_operators_keep_clashing_columns_and_null_ids(spark):
    df = documents(spark, extra=True)
    loose = spark.createDataFrame([(None, "kilo lima mike"), (None, "four five six seven")], "doc_id long, text string")
    df = df.unionByName(loose, allowMissingColumns=True).cache()
    n = df.count()
    returned = {
        "drop": (line_templates.drop_recurring(df), {"n_lines", "n_dropped"}), "redact": (secrets.redact(df), set()),
        "findings": (secrets.findings(df, secrets.scan(df)), {"spans"}), "shard": (sharding.shard(df, 3), {"shard", "slot"}),
        "predict": (langid.predict(df, langid.fit(df)), {"lang_pred", "score"}),
    }
    for name, (out, new) in returned.items():
        assert out.count() == n and set(out.columns) == set(df.columns) | new, name
        for c in set(df.columns) - new - {"text", "doc_id", "lang", "source", "n_chars"}:
            assert {r[0] for r in out.select(F.col(f"`{c}`")).distinct().collect()} == {"x", None}, (name, c)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.where("doc_id is null").count() == 2
    for f in (token_counts.count_tokens, bpe.digests, quality.score, phrases.fingerprint, simhash.document_components, secrets.document_findings):
        assert f(df).where("doc_id is null").count() == 2, f
    assert packing.pack(df).where("doc_id is null").count() == 2


def test_a_long_text_of_each_kind(spark):
    """One line, one word, one repeated character, more bytes than a slice holds."""
    from tests.llm.documents import words

    rows = [" ".join(words(1, 40)) + " " + " ".join(["abc def ghi"] * 800_000), "y" * 300_000, "no. " * 100_000, "ok"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(1)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = rows_by_id(token_counts.count_tokens(df))
    assert out[0]["n_bytes"] > common.SLICE_BYTES and out[2]["n_tokens"] == len(library.encode(rows[2], add_special_tokens=False).ids)
    for f in (bpe.digests, simhash.document_components, secrets.document_findings, phrases.fingerprint, quality.score, line_templates.drop_recurring, packing.pack):
        assert f(df).select("doc_id").distinct().count() == 4, f
    assert langid.predict(df, langid.fit(df.withColumn("lang", F.lit("aa")))).count() == 4
