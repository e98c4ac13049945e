"""Abbreviations of a collection, found without a list: words that nearly always end in a period.

A word's counts with and without a final period are weighed by a log-likelihood ratio: the hypothesis that it
takes periods as often as words at large against the one that it takes them almost always (99 of 100 times).
The ratio is scaled as in unsupervised sentence-boundary detection: short words are likelier
abbreviations, inner periods speak for one, and each occurrence without a final period speaks against it,
the more the longer the word. Two aggregations give all counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The share of its occurrences in which an abbreviation has its period, and the score from which a word is one.
ALMOST_ALWAYS, ENOUGH = 0.99, 0.3


def _words(content: str) -> Column:
    """Tokens between white space, in lower case, without marks around them but a period after; those with a letter."""
    bare = F.transform(F.split(F.lower(F.col(content)), r"\s+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", ""))
    return F.filter(bare, lambda t: t.rlike(r"\p{L}"))


def scores(docs: DataFrame, content: str = "content") -> DataFrame:
    """(word, with_period, without, score) of every word that has a final period somewhere."""
    tokens = docs.select(F.explode(_words(content)).alias("t"))
    period = F.endswith("t", F.lit("."))
    counted = tokens.groupBy(F.regexp_replace("t", r"\.$", "").alias("word")).agg(F.count_if(period).alias("with_period"), F.count_if(~period).alias("without"))
    totals = counted.agg(F.sum("with_period").alias("_b"), F.sum(F.col("with_period") + F.col("without")).alias("_n"))
    rows = counted.where("with_period > 0").crossJoin(F.broadcast(totals))  # one row
    p, a, b = F.col("_b") / F.col("_n"), F.col("with_period"), F.col("without")
    at_large = a * F.log(p) + F.when(b > 0, b * F.log(1 - p)).otherwise(0.0)
    always = a * F.log(F.lit(ALMOST_ALWAYS)) + b * F.log(F.lit(1 - ALMOST_ALWAYS))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    score = -2 * (at_large - always) * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -b.cast("double"))
    return rows.select("word", "with_period", "without", score.alias("score"))


def found(docs: DataFrame, content: str = "content", least: float = ENOUGH, most: int = 2000) -> list[str]:
    """The abbreviations of a collection without their final periods, at most ``most``, the best first; a list for :func:`not_ends`."""
    rows = scores(docs, content).where(F.col("score") >= least).orderBy(F.col("score").desc(), "word").limit(most)
    return [r["word"] for r in rows.collect()]


def not_ends(words: list[str]) -> str:
    """A pattern of the words with their periods and a blank after, for sentence splitting; initials count with them."""
    known = "|".join(sorted(map(re.escape, words), key=len, reverse=True))
    return rf"(?<![\p{{L}}\p{{N}}_])((?i:{known})|[A-Z])\.\s" if words else r"(?<![\p{L}\p{N}_])([A-Z])\.\s"
