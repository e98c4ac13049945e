"""Approximate matching of names: cheap bounds in SQL functions first, the scorer only for what passes.

The score of two strings is the best of plain, token-sorted and token-set similarity, 0 to
100. Whatever the parts, a similarity of two strings needs them to be within an edit distance
that follows from the score asked for, so pairs beyond it are left out by lengths, then by
Levenshtein distance with that bound, without a Python worker. What passes is scored exactly.

:func:`near_join` finds pairs of near strings of two tables: strings within k edits share one of their
k * q + 1 rarest q-grams, so only pairs that meet in one of those are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.constants import FUZZY_SCORE
from rostra.functions import text as X


_PAIRS = "array<struct<pos:int,sentence:string,names:array<string>>>"


def ratio(a: str, b: str) -> int:
    return round(100 * SequenceMatcher(None, a, b, autojunk=False).ratio())


def _norm(s: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in s).lower().split())


def weighted_ratio(a: str, b: str) -> int:
    """The best of plain, token-sorted and token-set similarity, 0 to 100, for strings of like length.

    With lengths that differ by half or more, only scores of 90 or less are possible, so
    those pairs are given 0.
    """
    a, b = _norm(a), _norm(b)
    if not a or not b or max(len(a), len(b)) >= 1.5 * min(len(a), len(b)):
        return 0
    ta, tb = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(ta & tb)), " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    token_set = max(ratio(both, one) if both else 0, ratio(both, two) if both else 0, ratio(one, two))
    return max(ratio(a, b), round(0.95 * ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))), round(0.95 * token_set))


def normal(c: Column | str) -> Column:
    """Letters and digits in lower case, everything else as single blanks."""
    return F.btrim(F.regexp_replace(F.lower(X.col(c)), r"[^\p{L}\p{N}]+", " "))


def _tokens(c: Column) -> Column:
    return F.split(c, " ")


def within(a: Column, b: Column, edits: Column) -> Column:
    """Whether the Levenshtein distance is at most ``edits``; it is not computed further than that."""
    return F.call_function("levenshtein", a, b, edits) >= 0


def could_score(a: Column, b: Column, least: int = FUZZY_SCORE) -> Column:
    """Whether normal strings a and b may score above ``least``; false for no pair that does.

    A similarity of r per cent of strings with T characters together leaves at most T (1 - r / 100)
    unmatched, and so as many edits. Rounding gives half a per cent, the factor of the
    token scores a higher r. Token sets of which one holds the other match as a whole.
    """
    plain, weighted = least + 0.5, ceil((least + 0.5) / 0.95) - 0.5
    edits = lambda x, y, r: F.floor((F.length(x) + F.length(y)) * (100 - r) / 100 + 1e-9).cast("int")
    likely = (F.length(a) < 1.5 * F.length(b)) & (F.length(b) < 1.5 * F.length(a)) & (F.length(a) > 0)
    joined = lambda t: F.array_join(F.sort_array(t), " ")

    def by_tokens(x: Column) -> Column:
        both = F.array_intersect(x["a"], x["b"])
        common = F.length(joined(both))
        alike = lambda side: (common > 0) & (200 * common >= weighted * (common + F.length(joined(F.array_distinct(side)))))
        one = lambda side: F.btrim(F.concat_ws(" ", joined(both), joined(F.array_except(side, both))))
        sorted_ = within(joined(x["a"]), joined(x["b"]), edits(a, b, weighted))
        return sorted_ | alike(x["a"]) | alike(x["b"]) | X.let(F.struct(one(x["a"]).alias("a"), one(x["b"]).alias("b")), lambda y: within(y["a"], y["b"], edits(y["a"], y["b"], weighted)))

    return likely & (within(a, b, edits(a, b, plain)) | X.let(F.struct(_tokens(a).alias("a"), _tokens(b).alias("b")), by_tokens))


def fuzzy_options(names: Column) -> Column:
    """Names with their normal form, computed once for all sentences that they are compared with."""
    return F.transform(names, lambda n: F.struct(n.alias("name"), normal(n).alias("normal")))


def open_pairs(sentence: Column, pos: Column, options: Column, least: int) -> Column:
    """(pos, sentence, names): the options that a sentence could be like."""
    near = X.let(normal(sentence), lambda s: F.transform(F.filter(options, lambda o: could_score(s, o["normal"], least)), lambda o: o["name"]))
    return F.struct(pos.alias("pos"), sentence.alias("sentence"), near.alias("names"))


def _best(sentence: str, names: list[str], least: int) -> str | None:
    top = max(((weighted_ratio(sentence, c), -i, c) for i, c in enumerate(names)), default=(0, 0, None))
    return top[2] if top[0] > least else None


def with_best(df: DataFrame, pairs: Column, out: str, least: int = FUZZY_SCORE) -> DataFrame:
    """``df`` with (pos, name) of those of its :func:`open_pairs` that have a match, scored in Python."""

    @F.pandas_udf("array<struct<pos:int,name:string>>")
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, batch in batches:
            found = []
            for n, pairs_ in zip(sizes, batch, strict=True):
                named = ((p["pos"], _best(p["sentence"], list(p["names"]), least)) for p in (pairs_ if n > 0 else []))
                found.append([{"pos": i, "name": c} for i, c in named if c is not None])
            yield pd.Series(found, dtype=object)

    # named twice, so that the bounds stay in a projection of their own, below the worker
    held = df.withColumn("_open", F.coalesce(pairs, F.array().cast(_PAIRS)))
    return held.withColumn(out, best(F.size("_open"), F.col("_open"))).drop("_open")


def fuzzy_match(df: DataFrame, sentence: str, options: str, out: str, least: int = FUZZY_SCORE) -> DataFrame:
    """``df`` with the best option whose score is above ``least``, the first of equals, or null."""
    pairs = F.when(F.col(sentence).isNotNull() & F.col(options).isNotNull(), open_pairs(F.col(sentence), F.lit(0), fuzzy_options(F.col(options)), least))
    held = F.filter(F.array(pairs), lambda p: F.size(p["names"]) > 0)
    return with_best(df, held, "_best", least).withColumn(out, F.get("_best", F.lit(0))["name"]).drop("_best")


# -- near strings of two tables ------------------------------------------------------------


def qgrams(c: Column, q: int) -> Column:
    """The q-grams of a string; the second of equal ones is another than the first, and so on."""
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda i: F.substring(c, i, q))
    numbered = X.let(F.sort_array(F.when(F.length(c) >= q, grams).otherwise(F.array().cast("array<string>"))), lambda g: F.transform(g, lambda x, i: F.concat_ws(":", x, i - F.array_position(g, x) + 1)))
    return numbered


def near_join(left: DataFrame, right: DataFrame, a: str, b: str, least: int = FUZZY_SCORE, q: int = 2) -> DataFrame:
    """(a, b, score) of the distinct strings of two columns whose Levenshtein similarity is above ``least``.

    The score is 100 less the edits in per cent of the longer string, cut down to a whole number. Each string looks among
    its rarest q-grams, one more than the edits allowed can spoil; strings too short for that many also meet by
    length. Equal strings are one, so repeated values cost nothing; nulls match nothing.
    """
    sides = [df.select(X.col(c).alias("s")).where("s IS NOT NULL").distinct() for df, c in ((left, a), (right, b))]
    # a partner has at most 100 / least the length, and edits at most the rest of it
    most = lambda s: F.floor(F.length(s) * (100 - least) / least + 1e-9).cast("int")
    held = [s.select("s", most(F.col("s")).alias("edits"), qgrams(F.col("s"), q).alias("grams")) for s in sides]
    both = reduce(DataFrame.unionByName, [h.select(F.explode("grams").alias("gram")) for h in held])
    rarity = both.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def keys(h: DataFrame) -> DataFrame:
        grams = h.select("s", "edits", F.explode("grams").alias("gram")).join(rarity, "gram")
        rarest = grams.groupBy("s", "edits").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
        by_gram = rarest.where(F.size("g") > F.col("edits") * q).select("s", F.explode(F.transform(F.slice("g", F.lit(1), F.col("edits") * q + 1), lambda x: x["gram"])).alias("key"))
        return by_gram

    short = lambda h: h.where(F.size("grams") <= F.col("edits") * q)
    met = keys(held[0]).withColumnRenamed("s", "a").join(keys(held[1]).withColumnRenamed("s", "b"), "key").select("a", "b")
    # one of a pair is too short to share a gram for certain: its partners are of near length
    lengths = lambda h, name: h.select(F.col("s").alias(name), F.explode(F.sequence(F.length("s") - F.col("edits"), F.length("s") + F.col("edits"))).alias("n"))
    sizes = lambda h, name: h.select(F.col("s").alias(name), F.length("s").alias("n"))
    met = met.unionByName(lengths(short(held[0]), "a").join(sizes(held[1], "b"), "n").select("a", "b"))
    met = met.unionByName(lengths(short(held[1]), "b").join(sizes(held[0], "a"), "n").select("a", "b")).distinct()
    longer = F.greatest(F.length("a"), F.length("b"))
    edits = F.floor(longer * (100 - least) / 100 + 1e-9).cast("int")
    found = met.withColumn("_d", F.when(F.abs(F.length("a") - F.length("b")) <= edits, F.call_function("levenshtein", F.col("a"), F.col("b"), edits)))
    scored = found.where("_d >= 0").select("a", "b", F.when(longer == 0, 100).otherwise(F.floor(100 - 100 * F.col("_d") / longer)).cast("int").alias("score"))
    return scored.where(F.col("score") > least)
