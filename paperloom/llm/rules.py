"""Quality rules under weak supervision, with built-in functions only: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import checkpointed

SPACE = " \t\n\x0b\f\r"
SIGNS = "#*$%&|<>"  # fixed values of the contract
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8


def without(text: Column, signs: str) -> Column:
    return F.char_length(F.translate(text, signs, ""))


def pairs(a: Column, b: Column, step: int, n: Column) -> Column:
    """Hash of each value of ``a`` with the one ``step`` places on in ``b``."""
    return F.zip_with(a, F.slice(b, step + 1, n), lambda x, y: F.xxhash64(x, y))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each text: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and what the rules look at.

    Windows of eight words are hashed by doubling (one word, two, four, eight) and compared inside the row: nothing is exploded
    or shuffled, so a very long text costs n log n in its own row. Two different windows are taken for equal with a chance of
    about n^2 / 2^65. A null text counts as empty; rows are kept as they are, repeated or with a null key.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("w", F.filter(F.split("t", "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != ""))
    d = d.withColumn("l", F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACE, "") != ""))
    d = d.select(
        "doc_id", F.size("w").alias("n"), without(F.col("t"), SPACE).alias("word_chars"), (F.char_length("t") - without(F.col("t"), SIGNS)).alias("n_symbols"),
        (F.char_length("t") - without(F.col("t"), CAPITALS)).alias("capitals"), (F.char_length("t") - without(F.col("t"), "!")).alias("shouts"),
        F.size("l").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"), F.size(F.array_distinct("w")).alias("n_distinct"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h1"))
    d = d.withColumn("same", F.size(F.filter(F.zip_with("h1", F.slice("h1", 2, F.col("n")), lambda x, y: x == y), lambda x: x)))
    d = d.withColumn("h2", pairs(F.col("h1"), F.col("h1"), 1, F.col("n"))).drop("h1")
    d = d.withColumn("h4", pairs(F.col("h2"), F.col("h2"), 2, F.col("n"))).drop("h2")
    d = d.withColumn("h8", F.slice(pairs(F.col("h4"), F.col("h4"), 4, F.col("n")), 1, F.greatest(F.col("n") - (WINDOW - 1), F.lit(0)))).drop("h4")
    again = F.size(F.array_distinct("h8")) < F.size("h8")
    d = d.withColumn("s", F.when(again, F.sort_array(F.transform("h8", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h8")
    at = lambda k: F.get("s", k)
    twice = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda k: (at(k)["h"] == at(k - 1)["h"]) | (at(k)["h"] == at(k + 1)["h"]))
    d = d.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(twice, lambda k: at(k)["i"])))).drop("s")
    covered = F.aggregate("p", F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n")), lambda a, p: F.struct((p + WINDOW).alias("stop"), (a["n"] + WINDOW - F.greatest(a["stop"] - p, F.lit(0))).alias("n")))["n"]
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("p")


def votes() -> list[Column]:
    """Vote of each rule: -1 against, 1 for, 0 abstains. A text without words gets abstentions only.

    A kind of junk breaks one rule and passes the others, so passing is no vote: the rules against abstain otherwise, and
    one rule for speaks only where a text is clear of every sign of junk.
    """
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n", "word_chars", "n_lines"))
    length = F.col("word_chars") / n
    signs, again, same, capitals, shouts = F.col("n_symbols") / chars, F.col("n_repeat_words") / n, F.col("same") / n, F.col("capitals") / chars, F.col("shouts") / n
    against = lambda bad: F.when((F.col("n") > 0) & bad, -1).otherwise(0)
    clean = (signs <= 0.02) & (again <= 0.30) & (same <= 0.05) & (capitals <= 0.20) & (shouts <= 0.05) & length.between(2.5, 12)
    return [
        against(signs > 0.08),  # signs among the characters
        against(again > 0.30),  # words in repeated windows
        against(F.col("n_dup_lines") / lines > 0.50),  # repeated lines
        against(same > 0.25),  # a word said again at once
        against(capitals > 0.50),  # capitals
        against(shouts > 0.30),  # exclamation marks
        against((length > 15) | (length < 2)),  # word length
        against(F.col("n_distinct") / n < 0.10),  # few different words
        F.when((F.col("n") >= 20) & clean, 1).otherwise(0),
    ]


def log_odds(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def learned(rows: DataFrame, balance: float = 0.5, rounds: int = 25) -> list[float]:
    """Accuracy of each rule where it votes, by expectation-maximisation over the patterns of votes.

    The patterns are folded to at most 3 to the power of the number of rules, which sit in one row; all rounds are one
    expression over it. ``balance`` is the share of good texts that is assumed before any vote. Accuracies start at 0.9, with
    ten votes' weight, and stay between 0.5 and 0.99. An empty table keeps the start.
    """
    k = len(votes())
    patterns = rows.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("m")).agg(F.collect_list(F.struct("votes", "m")).alias("patterns"))
    at = lambda a, j: F.get(a, F.lit(j))

    def good(q: Column, accuracy: Column) -> Column:
        odds = F.lit(math.log(balance / (1 - balance)))
        for j in range(k):
            odds = odds + at(q["votes"], j) * log_odds(at(accuracy, j))
        return 1 / (1 + F.exp(-odds))

    def turn(accuracy: Column) -> Column:
        seen = F.transform("patterns", lambda q: F.struct(q["votes"].alias("votes"), q["m"].alias("m"), good(q, accuracy).alias("p")))

        def again(e):
            def share(j):
                vote = lambda q: at(q["votes"], j)
                right = F.aggregate(e, F.lit(9.0), lambda a, q: a + F.when(vote(q) == 1, q["m"] * q["p"]).when(vote(q) == -1, q["m"] * (1 - q["p"])).otherwise(0.0))
                cast = F.aggregate(e, F.lit(10.0), lambda a, q: a + F.when(vote(q) != 0, q["m"]).otherwise(0.0))
                return F.least(F.greatest(right / cast, F.lit(0.5)), F.lit(0.99))

            return F.array(*[share(j) for j in range(k)])

        return F.get(F.transform(F.array(seen), again), F.lit(0))

    state = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*[F.lit(0.9)] * k), lambda a, _: turn(a))
    return list(patterns.select(state.alias("accuracy")).first().accuracy)


def posterior(accuracy: list[float], balance: float = 0.5) -> Column:
    """Probability that a text with these ``votes`` is good."""
    odds = F.lit(math.log(balance / (1 - balance)))
    for j, a in enumerate(accuracy):
        odds = odds + F.get("votes", F.lit(j)) * F.lit(math.log(a / (1 - a)))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, keep: float = 0.5, min_words: int = 20, most_repeat: int = 30, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``quality`` (posterior) and ``kept`` for each row: kept if the base passes and quality >= ``keep``."""
    rows = checkpointed(measures(docs, key, text).withColumn("votes", F.array(*[v.cast("int") for v in votes()])))
    failed = (F.col("n") < min_words) | (100 * F.col("n_repeat_words").cast("long") > most_repeat * F.col("n").cast("long"))
    out = rows.withColumn("base_failed", failed).withColumn("quality", posterior(learned(rows)))
    longs = [F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select(F.col("doc_id").alias(key), F.col("n").cast("long").alias("n_words"), *longs, "base_failed", "votes", "quality", (~F.col("base_failed") & (F.col("quality") >= keep)).alias("kept"))
