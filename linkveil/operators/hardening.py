"""Hardening of filters held as sorted position sets."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkveil.functions.columns import grams_in_order, let, salted


def permutation(n: int, seed: int) -> list[int]:
    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


def moved(pos: Column, to: list[int]) -> Column:
    """Every position p becomes to[p]."""
    table = F.array(*map(F.lit, to))
    return F.sort_array(F.transform(pos, lambda p: F.get(table, p)))


def exclusive(a: Column, b: Column) -> Column:
    """Sorted elements of one of two sets alone."""
    return F.sort_array(F.array_except(F.array_union(a, b), F.array_intersect(a, b)))


def balance(pos: Column, bf_len: int, seed: int | None = None) -> Column:
    """The filter and its complement one after the other: length doubles, weight is bf_len; permuted if a seed is given."""
    every = F.sequence(F.lit(0), F.lit(bf_len - 1))
    both = let(pos, lambda x: F.concat(x, F.transform(F.array_except(every, x), lambda p: p + bf_len)))
    return F.sort_array(both) if seed is None else moved(both, permutation(2 * bf_len, seed))


def fold(pos: Column, bf_len: int) -> Column:
    """XOR of the two halves; the length must be even."""
    if bf_len % 2:
        raise ValueError("only a filter of even length folds")
    half = bf_len // 2

    def halves(x: Column) -> Column:
        low, high = F.filter(x, lambda p: p < half), F.transform(F.filter(x, lambda p: p >= half), lambda p: p - half)
        return F.array(low, high)

    return let(let(pos, halves), lambda h: exclusive(h[0], h[1]))


def rule_90(pos: Column, bf_len: int) -> Column:
    """Every bit becomes the XOR of its neighbours, around the ends."""
    moved_by = lambda x, d: F.transform(x, lambda p: F.pmod(p + d, F.lit(bf_len)))
    return let(let(pos, lambda x: F.array(moved_by(x, -1), moved_by(x, 1))), lambda s: exclusive(s[0], s[1]))


def transitions(df: DataFrame, value: str, q: int, padded: bool = False) -> DataFrame:
    """(g1, g2, n, prob): adjacent q-grams in order, repeats included. Pairs form inside each array, without a shuffle."""
    grams = grams_in_order(F.col(value), q, padded)
    pairs = F.zip_with(grams, F.slice(grams, 2, F.greatest(F.size(grams), F.lit(1))), lambda a, b: F.struct(a.alias("g1"), b.alias("g2")))
    counts = df.select(F.explode(pairs).alias("p")).where("p.g2 is not null").groupBy("p.g1", "p.g2").agg(F.count("*").alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("g1")))


def markov_extras(model: DataFrame, chain_len: int, mode: str = "freq", seed: int = 42) -> DataFrame:
    """(g1, extra): the chain_len q-grams that each q-gram brings along: the most probable, or drawn by probability.

    Drawing without replacement: the smallest exponential keys -ln(u) / p, u a hash of the pair and the seed.
    """
    if mode == "freq":
        order = [F.desc("prob"), F.asc("g2")]
    elif mode == "prob":
        u = (F.pmod(F.xxhash64("g1", "g2", F.lit(seed)), F.lit(1 << 40)) + 1) / float(1 << 40)
        order = [F.asc(-F.ln(u) / F.col("prob")), F.asc("g2")]
    else:
        raise ValueError("mode is freq or prob")
    ranked = model.withColumn("r", F.row_number().over(Window.partitionBy("g1").orderBy(*order))).where(F.col("r") <= chain_len)
    return ranked.groupBy("g1").agg(F.array_sort(F.collect_list("g2")).alias("extra"))


def expand_grams(df: DataFrame, grams: str, extras: DataFrame, key: str) -> DataFrame:
    """df with the extra q-grams of every q-gram added to its set."""
    each = df.select(F.col(key).alias("__k"), F.explode(grams).alias("__g"))
    more = each.join(extras, F.col("__g") == F.col("g1")).groupBy("__k").agg(F.array_distinct(F.flatten(F.collect_list("extra"))).alias("__more"))
    joined = df.join(more, F.col(key) == F.col("__k"), "left")
    wide = F.array_union(F.col(grams), F.coalesce("__more", F.array().cast("array<string>")))
    return joined.select(*[wide.alias(c) if c == grams else F.col(c) for c in df.columns])


salt_grams = salted
