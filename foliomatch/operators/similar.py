"""The ladder of similarity between two vocabularies, as joins keyed by pair.

A word of one side is scored against words of the other by the first rung that holds: 1.0 equal, 0.95
normal forms equal, 0.93 equal but for tone marks, 0.85 one contains the other, 0.83 the same but for
tone marks, else the ratio 2 LCS / (sum of lengths) from a threshold on.

Containment: a word that contains another has all its trigrams. Trigrams are counted over the vocabularies; the shorter
word is looked up by its rarest one only, and not at all if one of them is nowhere.

Ratio: words as alike as the threshold asks share so many characters, repeats counted, that they share one of the first few
of both in any fixed order of characters (``first_characters``); later repeats come first in the order, being rarer. A pair of words
that meets by several is taken by the first of them. A bound from the characters present comes before that, and only then the longest
common subsequence. No rung compares all words with all, nor all words of like lengths.

Mostly few words are looked up (a) among very many (b). Only b's words of pairs that a has are looked at, and a's side is broadcast if it was
counted and is small enough, so that b's words aren't shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomatch.functions import numbers
from foliomatch.sources.intermediate import NARROW_ROWS, bounded, written


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel longest common subsequence, for any length."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], int] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = lcs_length(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="int32")


def present(s: Column) -> Column:
    """Which characters occur, as 64 bits by code point modulo 64."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))
    return F.aggregate(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(bit(c)))


#: Width of a bin of logarithms: over ten times the relative distance within which numbers are equal.
NUMBER_BIN = 1.5e-5


def equal_numbers(own: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b: numbers of own (by, a) and of other (by, b) with the same `by` that ``numbers.numbers_equal`` takes for equal.

    Equal numbers have the same sign, and logarithms that are at most a millionth apart: they are in the same bin of the
    logarithmic scale or in neighbouring ones. A number is looked up in its own bin and both neighbours; zero has a bin of its own."""
    value = lambda c: numbers.decimal_value(F.col(c)).cast("double")
    sign = lambda c: F.signum(value(c)).cast("int").alias("sign")
    bin_ = lambda c: F.when(value(c) == 0, 0).otherwise(F.floor(F.log(F.abs(value(c))) / NUMBER_BIN)).cast("long")
    mine = own.filter(value("a").isNotNull()).select(*by, "a", sign("a"), F.explode(F.array(*[bin_("a") + i for i in (-1, 0, 1)])).alias("bin"))
    theirs = other.filter(value("b").isNotNull()).select(*by, "b", sign("b"), bin_("b").alias("bin"))
    return mine.join(theirs, [*by, "sign", "bin"]).filter(numbers.numbers_equal(F.col("a"), F.col("b"))).select(*by, "a", "b")


def _trigrams(s: Column) -> Column:
    n = F.length(s)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))


def rarest_grams(short: DataFrame, long: DataFrame) -> DataFrame:
    """form, gram: for each distinct form of short (form) the trigram that the fewest distinct forms of long have. Forms
    with a trigram that none of long has are left out: nothing there contains them."""
    counts = long.select("form").distinct().select(F.explode(_trigrams(F.col("form"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
    each = short.select("form").distinct().select("form", F.explode(_trigrams(F.col("form"))).alias("gram"), F.size(_trigrams(F.col("form"))).alias("n"))
    met = each.join(counts, "gram").groupBy("form", "n").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("k", "gram")).alias("least"))
    return met.filter("found = n").select("form", F.col("least.gram").alias("gram"))


def of_pairs_in(b: DataFrame, a: DataFrame) -> DataFrame:
    """The rows of b whose pair a has."""
    return b.join(bounded(written(a.select("pair").distinct(), "ladder-pairs"), NARROW_ROWS), "pair", "left_semi")


def held(b: DataFrame, a: DataFrame, key: str) -> DataFrame:
    """pair and key, once each, of a that b has too. a, with its few words, is what is sent to b's."""
    return written(b.select("pair", key).join(bounded(a.select("pair", key), NARROW_ROWS), ["pair", key], "left_semi").distinct(), "ladder-held")


def contained(a: DataFrame, b: DataFrame, form: str) -> DataFrame:
    """pair, a, b for which one word's form contains the other's, both of three characters at least."""
    of = lambda df, c: df.filter(F.length(form) >= 3).select("pair", F.col("clean").alias(c), F.col(form).alias("form"))
    a = of(a, "a")
    b = of_pairs_in(of(b, "b"), a)

    def within(short: DataFrame, long: DataFrame) -> DataFrame:
        grams = written(rarest_grams(short, long), "ladder-grams")
        keyed = short.join(bounded(grams, NARROW_ROWS), "form")
        # of the trigrams of all words only those that one is looked up by go further
        wholes = long.withColumnRenamed("form", "whole").withColumn("gram", F.explode(_trigrams(F.col("whole"))))
        wholes = wholes.join(bounded(grams.select("gram").distinct(), NARROW_ROWS), "gram", "left_semi")
        keyed, wholes = (bounded(keyed, NARROW_ROWS), wholes) if short is a else (keyed, bounded(wholes, NARROW_ROWS))
        return keyed.join(wholes, ["pair", "gram"]).filter(F.contains("whole", "form")).select("pair", "a", "b")

    return within(a, b).union(within(b, a))


def first_characters(s: Column) -> Column:
    """A word's characters as numbers, the rare ones first: the second of a kind before all first ones, and so on, then by code
    point, the highest first. Two words' common numbers count their common characters."""
    sorted_ = F.sort_array(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)))
    turn = lambda cs: F.transform(cs, lambda c, i: (i - F.array_position(cs, c) + 1) * (1 << 21) + F.ascii(c))
    return F.reverse(F.sort_array(F.flatten(F.transform(F.array(sorted_), turn))))


def _at_least(la: Column, lb: Column, threshold: float) -> Column:
    """The least common subsequence of words of these lengths for the ratio to reach the threshold."""
    return F.ceil((la + lb) * (threshold / 2) - 1e-9).cast("int")


def candidates(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """pair, a, b, la, lb, once each, of words that are close enough in length and may be alike enough."""
    la, lb = F.col("la"), F.col("lb")
    a = a.select("pair", F.col("clean").alias("a"), F.col("len").alias("la"), present(F.col("clean")).alias("ma"), first_characters(F.col("clean")).alias("ca"))
    b = b.select("pair", F.col("clean").alias("b"), F.col("len").alias("lb"), present(F.col("clean")).alias("mb"), first_characters(F.col("clean")).alias("cb"))
    low = F.ceil(la * threshold / (2 - threshold) - 1e-9).cast("int")
    high = F.floor(F.least(la * (2 - threshold) / threshold + 1e-9, la + F.greatest(la * 0.5, F.lit(3.0)))).cast("int")
    low = F.greatest(low, F.ceil(la - F.greatest(la * 0.5, F.lit(3.0))).cast("int"), F.lit(1))
    a = a.withColumn("lb", F.explode(F.when(low <= high, F.sequence(low, high))))
    first = lambda c, n, least: F.slice(c, 1, F.greatest(n - least + 1, F.lit(0)))
    a = a.withColumn("ca", first("ca", la, _at_least(la, lb, threshold)))
    # the shortest word that may match asks for the fewest common characters
    shortest = F.ceil(lb * threshold / (2 - threshold) - 1e-9).cast("int")
    b = b.withColumn("cb", first("cb", lb, _at_least(shortest, lb, threshold)))
    a = bounded(a.withColumn("c", F.explode("ca")), NARROW_ROWS)
    met = a.join(b.withColumn("c", F.explode("cb")), ["pair", "lb", "c"])
    missing = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    least = (la + lb) * (threshold / 2) - 1e-9
    # the bound first: it costs a hundredth of the other
    met = met.filter((la - missing("ma", "mb") >= least) & (lb - missing("mb", "ma") >= least))
    return met.filter(F.col("c") == F.array_max(F.array_intersect("ca", "cb"))).select("pair", "a", "b", "la", "lb")


def alike(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """pair, a, b, score for which the ratio reaches the threshold and the lengths are close enough."""
    met = candidates(a, b, threshold).withColumn("score", 2 * lcs(F.col("a"), F.col("b")) / (F.col("la") + F.col("lb")).cast("double"))
    return met.filter(F.col("score") >= threshold).select("pair", "a", "b", "score")


def ladder(a: DataFrame, b: DataFrame, threshold: float, full: bool = True) -> DataFrame:
    """pair, a, b, score of all matches of a's words among b's. full: with the rungs for equal words and
    for containment but for tone marks, which comparison with the catalog leaves out. A word that b has
    itself gets that match only."""
    # both sides are read by every rung: they are written once
    left = written(a.select("pair", "clean", "norm", "norm_nt", "len"), "ladder-own")
    right = written(of_pairs_in(b.select("pair", "clean", "norm", "norm_nt", "len"), left), "ladder-other")
    other = right.select("pair", F.col("clean").alias("b"), F.col("norm").alias("nb"), F.col("norm_nt").alias("tb"))
    rungs = []
    if full:
        equal_words = held(right, left, "clean")
        left = left.join(bounded(equal_words, NARROW_ROWS), ["pair", "clean"], "left_anti")
        rungs.append(equal_words.select("pair", F.col("clean").alias("a"), F.col("clean").alias("b"), F.lit(1.0).alias("score")))
    mine = bounded(left, NARROW_ROWS).select("pair", F.col("clean").alias("a"), F.col("norm").alias("na"), F.col("norm_nt").alias("ta"))
    equal = lambda x, y: (mine["pair"] == other["pair"]) & (mine[x] == other[y])
    pick = lambda df, s: df.select(mine["pair"], "a", "b", F.lit(s).alias("score"))
    rungs += [pick(mine.join(other, equal("na", "nb")), 0.95), pick(mine.join(other, equal("ta", "tb")), 0.93)]
    rungs.append(contained(left, right, "norm").withColumn("score", F.lit(0.85)))
    if full:
        # without tone marks on either side this is the rung before
        toned = F.col("norm") != F.col("norm_nt")
        found = contained(left.filter(toned), right, "norm_nt").union(contained(left.filter(~toned), right.filter(toned), "norm_nt"))
        rungs.append(found.withColumn("score", F.lit(0.83)))
    rungs.append(alike(left, right, threshold).withColumn("ratio", F.col("score")).withColumn("score", F.lit(0.0)))
    out = rungs[-1]
    for r in rungs[:-1]:
        out = out.unionByName(r.withColumn("ratio", F.lit(None).cast("double")))
    best = out.groupBy("pair", "a", "b").agg(F.max("score").alias("rung"), F.max("ratio").alias("ratio"))
    return best.select("pair", "a", "b", F.when(F.col("rung") > 0, F.col("rung")).otherwise(F.col("ratio")).alias("score"))
