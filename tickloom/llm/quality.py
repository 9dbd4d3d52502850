"""Document quality by weak supervision, in DataFrame operations only.

Rules vote good or bad on a document or abstain. Expectation-maximisation over the counts of vote patterns estimates how
often each rule is right about good and about bad documents, and how many documents are good; the posterior probability
of being good decides, instead of a filter that all rules must pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACE_CLASS, cut, words

WINDOW = 5
#: Iterations at most, and the change of the estimates at which they end.
ITERATIONS, TOLERANCE = 20, 1e-5
#: Pseudo-votes, right and wrong, behind the estimates on good and on bad documents, which also start the iteration: a
#: rule seldom finds fault with a good document, and a bad one has some of the faults only. The third is for the share.
PRIORS = {"good": (9.8, 0.2), "bad": (5.0, 5.0), "share": (8.0, 2.0)}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(w: Column) -> Column:
    """Words that lie in windows of five words which the text has twice or more (windows are compared by hash)."""

    def count(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            at = F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
            return F.aggregate(at, start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(placed, covered))

    def windows(ws: Column) -> Column:
        spans = F.sequence(F.lit(0), F.size(ws) - WINDOW)
        return _let(F.transform(spans, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)])), count)

    return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(windows(w))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the counts that the rules use, for each row; a null text has no words.

    A row's counts come from the row alone; nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:-1]}]"))
    less = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    wide = docs.select("doc_id", "text", words(F.col("text")).alias("w"), lines.alias("lines"))
    return wide.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        bare(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length(text) - bare("#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        less(r"\p{L}+").cast("long").alias("n_letters"),
        less(r"\p{Lu}+").cast("long").alias("n_upper"),
        F.size(F.filter("lines", lambda x: x.rlike("[.!?\"')]\\s*$"))).cast("long").alias("n_ended"),
    )


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, 0 bad, null where it abstains. No rule votes on a document without words."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    # A ratio to nothing is null, and its rule abstains.
    mean, symbols, repeats = (F.try_divide(x, n) for x in (chars, F.col("n_symbols"), F.col("n_repeat_words")))
    letters, upper = F.try_divide("n_letters", chars), F.try_divide("n_upper", "n_letters")
    vote = lambda good, bad: F.when(n == 0, None).when(good, 1).when(bad, 0)
    return {
        "length": vote(n >= 40, n < 15),
        "word_length": vote((mean >= 3.5) & (mean <= 9), (mean < 2.5) | (mean > 12)),
        "symbols": vote(symbols <= 0.02, symbols > 0.1),
        "same_lines": vote((lines >= 3) & (F.col("n_dup_lines") == 0), F.col("n_dup_lines") > 0.3 * lines),
        "repeats": vote(repeats <= 0.02, repeats > 0.15),
        "letters": vote(letters >= 0.85, letters < 0.7),
        "upper_case": vote(upper <= 0.2, upper > 0.5),
        "endings": vote(F.col("n_ended") >= 0.6 * lines, (F.col("n_ended") < 0.1 * lines) & (lines >= 2)),
    }


def _odds(estimate: dict[str, float]) -> tuple[float, list[float], list[float]]:
    """Log odds of a good document without votes, and what a vote for good or for bad of each rule adds."""
    rules = [k.removesuffix("_good") for k in estimate if k.endswith("_good")]
    good = [math.log(estimate[f"{r}_good"] / (1 - estimate[f"{r}_bad"])) for r in rules]
    bad = [math.log((1 - estimate[f"{r}_good"]) / estimate[f"{r}_bad"]) for r in rules]
    return math.log(estimate["good"] / (1 - estimate["good"])), good, bad


def posterior(estimate: dict[str, float]) -> Column:
    """Probability of a good document from its votes (array votes, in the order of the rules)."""
    prior, good, bad = _odds(estimate)
    added = lambda v, i: F.when(v == 1, F.get(F.lit(good), i)).when(v == 0, F.get(F.lit(bad), i)).otherwise(0.0)
    odds = F.aggregate(F.transform("votes", added), F.lit(prior), lambda a, x: a + x)
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rules: list[str]) -> dict[str, float]:
    """Maximum a posteriori estimates from the counts n of vote patterns (at most 3 ** rules rows).

    good: share of good documents; rule_good and rule_bad: chance that the rule, if it votes, is right on a good or on a
    bad document. One small aggregation for each iteration; only its sums, three for each rule, reach the driver.
    """
    mean = lambda kind, right=0.0, every=0.0: (right + PRIORS[kind][0]) / (every + sum(PRIORS[kind]))
    now = {"good": mean("share")} | {f"{r}_{kind}": mean(kind) for r in rules for kind in ("good", "bad")}
    for _ in range(ITERATIONS):
        weighed = patterns.select("n", posterior(now).alias("p"), F.posexplode("votes").alias("rule", "vote"))
        sums = weighed.groupBy("rule", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("g"), F.sum(F.col("n") * (1 - F.col("p"))).alias("b"))
        at = {(r["rule"], r["vote"]): (r["g"], r["b"]) for r in sums.collect()}
        of = lambda i, votes, k, at=at: sum(at.get((i, v), (0.0, 0.0))[k] for v in votes)
        all_good, all_bad = of(0, (0, 1, None), 0), of(0, (0, 1, None), 1)
        new = {"good": mean("share", all_good, all_good + all_bad)}
        for i, r in enumerate(rules):
            new[f"{r}_good"] = mean("good", of(i, (1,), 0), of(i, (0, 1), 0))
            new[f"{r}_bad"] = mean("bad", of(i, (0,), 1), of(i, (0, 1), 1))
        change = max(abs(new[k] - now[k]) for k in new)
        now = new
        if change < TOLERANCE:
            break
    return now


def score(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, p_good and kept of each row of docs.

    A document without words fails the base test. Repeated rows count as documents of their own; an empty table gives no
    rows. Counts and votes are written to the checkpoint folder once; patterns are counted over all documents, before
    the shuffle first.
    """
    rules = votes()
    voted = cut(features(docs).select("doc_id", *BASE, F.array(*[v.cast("int") for v in rules.values()]).alias("votes")))
    patterns = cut(voted.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1))
    found = estimate(patterns, list(rules))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.select("doc_id", *BASE, failed.alias("base_failed"), posterior(found).alias("p_good"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
