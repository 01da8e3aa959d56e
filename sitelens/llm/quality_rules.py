"""Quality rules under weak supervision (DataFrame functions only).

Each rule votes good (1) or bad (-1) on a document, or abstains (0). Expectation maximisation
over the counts of vote patterns (at most 3 ** rules rows, whatever the corpus holds) estimates
how each rule votes on good and on bad documents; a document's verdict is its posterior
probability of being good, in place of passing every rule.

Defined results: a null or empty text has no words, so its base fails; ids may repeat or be
null, every row is judged alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, table, white_words

MIN_WORDS = 10
#: A document is kept from this posterior on.
KEEP_FROM = 0.5
#: Pseudo-documents as a share of all, and how rules vote on them: on good ones, on bad ones.
PRIOR_SHARE = 0.01
PRIOR = {1: (0.4, 0.2), 0: (0.4, 0.4), -1: (0.2, 0.4)}
ROUNDS = 50
SYMBOLS = "[^#*$%&|<>]+"


def statistics(docs: DataFrame) -> DataFrame:
    """The counts that rules look at, one row per row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text")).withColumn("words", white_words(F.col("text")))
    windows = F.when(
        F.size("words") >= 5,
        F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.xxhash64(F.slice("words", i, 5))),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{WHITE}]"))
    df = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"[{WHITE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("text", "[^!]+", "")).cast("long").alias("n_exclaims"),
        lines.alias("lines"),
        windows.alias("windows"),
    )
    # Only texts in which a window repeats sort theirs, by hash and place.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(repeats, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "placed": placed,
    }).drop("lines", "windows")
    twice = F.filter("placed", lambda x, k: (F.get("placed", k - 1)["h"] == x["h"]) | (F.get("placed", k + 1)["h"] == x["h"]))
    df = df.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(5), s - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("placed", "starts")


def rules() -> dict[str, Column]:
    """The votes, as columns over statistics(). Passing a test for junk is no sign of quality, so
    such rules abstain on what they don't condemn; plain text is what speaks for a document."""
    c, n = F.col, F.col("n_words")
    some = n >= MIN_WORDS
    bad = {
        "length": n < MIN_WORDS,
        "repeats": some & (100 * c("n_repeat_words") > 20 * n),
        "symbols": some & (100 * c("n_symbols") > 15 * n),
        "lines": some & (10 * c("n_dup_lines") > 3 * c("n_lines")),
        "word_length": some & ((2 * c("word_chars") < 3 * n) | (c("word_chars") > 25 * n)),
        "capitals": some & (2 * c("n_capitals") > c("word_chars")),
        "exclaims": some & (3 * c("n_exclaims") > n),
    }
    plain = (
        some & (100 * c("n_symbols") <= 5 * n) & (10 * c("n_exclaims") <= n) & (4 * c("n_capitals") <= c("word_chars"))
        & (c("word_chars") >= 2 * n) & (c("word_chars") <= 20 * n) & (100 * c("n_repeat_words") <= 20 * n)
    )
    return {k: F.when(x, -1).otherwise(0) for k, x in bad.items()} | {"plain": F.when(plain, 1).otherwise(0)}


def maximise(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict]]:
    """The share of good documents, and per rule the log-likelihood ratio (good to bad) of each vote.

    patterns: the votes of all rules, and how many documents have them. A rule is described by how
    often it votes good, votes bad and abstains on documents of either class, as a rule that seldom
    abstains on good documents says something by abstaining. The first guess is the majority vote.
    """
    total = sum(n for _, n in patterns)
    m = len(patterns[0][0]) if patterns else 0
    alike = max(1.0, PRIOR_SHARE * total)
    share, ratios = 0.8, [{1: 2.0, 0: 0.0, -1: -2.0}] * m
    for _ in range(rounds):
        good = bad = 0.0
        counts = [{v: [alike * PRIOR[v][0], alike * PRIOR[v][1]] for v in PRIOR} for _ in range(m)]
        for votes, n in patterns:
            p = posterior(votes, share, ratios)
            good, bad = good + n * p, bad + n * (1 - p)
            for by_vote, v in zip(counts, votes):
                by_vote[v][0] += n * p
                by_vote[v][1] += n * (1 - p)
        share = (good + 0.8 * alike) / (total + alike)
        ratios = [{v: math.log(g / (good + alike)) - math.log(b / (bad + alike)) for v, (g, b) in x.items()} for x in counts]
    return share, ratios


def posterior(votes: tuple[int, ...], share: float, ratios: list[dict]) -> float:
    odds = math.log(share / (1 - share)) + sum(r[v] for r, v in zip(ratios, votes))
    return 1 / (1 + math.exp(-odds)) if odds > -500 else 0.0


def judge(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """statistics() of docs with the votes, base_failed, quality (the posterior) and kept."""
    votes = rules()
    df = cut(statistics(docs.select("doc_id", "text")).withColumns({f"vote_{k}": v for k, v in votes.items()}))
    names = [f"vote_{k}" for k in votes]
    patterns = [(tuple(r[:-1]), r[-1]) for r in df.groupBy(*names).count().collect()]
    share, ratios = maximise(sorted(patterns)) if patterns else (0.8, [])
    total = F.lit(math.log(share / (1 - share)))
    for name, by_vote in zip(names, ratios):
        total = total + F.when(F.col(name) > 0, by_vote[1]).when(F.col(name) < 0, by_vote[-1]).otherwise(by_vote[0])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = df.withColumns({"base_failed": failed, "quality": 1 / (1 + F.exp(-total))})
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
