"""The corpus pipeline on a small table."""

import corpus_pipeline
from tests.llm.documents import documents, empty
from tickloom.llm import secrets


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "language_id":
            assert docs.where("text is null or not text rlike '\\\\p{L}'").count() == 0 and docs.count() < before.count()
        elif name == "near_dedup":
            assert docs.count() == docs.select("doc_id").distinct().count() < before.count()
        elif name == "secret_scan":
            assert docs.count() == before.count() and not any(secrets.find(r["text"]) for r in docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert docs.select("doc_id").distinct().count() == before.count()


def test_run_equals_its_stages(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_rows_without_or_with_repeated_ids_stay_unless_they_are_copies(spark):
    from tests.llm.documents import SCHEMA, words
    from tickloom.llm import simhash

    a, b, c, d, e = (" ".join(words(seed, 80)) for seed in range(50, 55))
    rows = [(None, a), (None, b), (None, a), (7, c), (7, d), (3, d), (None, e), (9, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    want = sorted([(None, a), (None, b), (7, c), (3, d), (9, e)], key=str)
    for kept in (simhash.keep_one(docs), corpus_pipeline.near_dedup(spark, docs, "")):
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == want


def test_near_dedup_equals_brute_force(spark, monkeypatch):
    """Planted copies with one to a dozen replaced words, a cloud of copies around one text, and texts that share a passage."""
    import random

    from tests.llm.documents import SCHEMA, words
    from tickloom.llm import near_copies

    monkeypatch.setattr(near_copies, "FEW", 4)
    r = random.Random(9)
    found = []
    for seed, (size, copies, most) in enumerate([(100, 30, 3), (60, 3, 2), (200, 4, 12), (150, 6, 5), (12, 4, 1), (7, 4, 1), (3, 3, 0)]):
        base = words(200 + seed, size)
        found.append(base)
        for _ in range(copies):
            copy = [*(r.choice(found[-3:]) if seed == 3 and len(found) > 40 else base)]
            for at in r.sample(range(size), r.randint(0, most)):
                copy[at] = f"new{r.randint(0, 10**9)}"
            found.append(copy)
    passage = words(300, 30)
    found += [words(400 + i, 20) + passage for i in range(12)] + [[], []]
    r.shuffle(found)
    docs = [" ".join(w) for w in found]

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, up = [shingles(t) for t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    want = sorted(set(up))
    assert 12 + 7 < len(want) < len(docs) - 20
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(docs)], SCHEMA).repartition(3)
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, frame, "").collect()) == want


def test_lines_that_only_begin_alike_stay(spark):
    from tests.llm.documents import SCHEMA

    tails = ["red fox", "blue sky", "old car", "wet day"]
    lines = [f"We went there {t}\nPage {i} of {i + 3} pages\nEnd of the list here {i}" for i, t in enumerate(tails)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(lines)], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {0: lines[0]} | {i: f"We went there {t}\n" for i, t in enumerate(tails) if i}


def test_short_lines_recur_too(spark):
    from tests.llm.documents import SCHEMA

    lines = [f"All rights reserved.\nonly {w} here\nLes.\nPage {i}\n12 13\n\n{w}" for i, w in enumerate(["ab", "cd", "ef", "gh"])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([*lines, "Twice\nx", "Twice\ny"])], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    later = {i: f"only {w} here\n12 13\n\n{w}" for i, w in enumerate(["ab", "cd", "ef", "gh"]) if i}
    assert got == {0: lines[0], 4: "Twice\nx", 5: "Twice\ny"} | later


def test_stages_with_null_ids_clashing_columns_and_an_empty_table(spark, tmp_path):
    docs = documents(spark, extra=True)
    loose = spark.createDataFrame([(None, "one two three four five six", "en", "s", 27), (None, "a b c d e f g h", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(loose, allowMissingColumns=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty(spark), "").count() == 0
        docs = stage(spark, docs, "")
        docs.write.parquet(f"{tmp_path}/{stage.__name__}")
        docs = spark.read.parquet(f"{tmp_path}/{stage.__name__}")
        assert {r["text"] for r in docs.where("doc_id is null").collect()} == {r["text"] for r in loose.collect()}, stage.__name__
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("doc_id is null").count() == 2


def test_texts_without_learned_ngrams_keep_their_language(spark):
    from tests.llm.documents import SCHEMA

    rows = [(i, "abc abd abe abf " * 5, "aa", "s", 80) for i in range(20)] + [(50, "日本語", "ja", "s", 3), (51, "123", "ja", "s", 3)]
    held = [r for r in rows if r[0] != 50] + [(50, "日本語", "ja", "s", 3)]
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, spark.createDataFrame(held, SCHEMA), "").collect()}
    assert got[0] == "aa" and got[50] == "ja" and 51 not in got
