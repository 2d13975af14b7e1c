"""Counting operators (A3-A17): dictionaries, support graph, language model, transitions, histograms."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gram_values(records: DataFrame) -> DataFrame:
    """A3: (gram, value), distinct: the values that hold each q-gram, a row each, for a common q-gram is in most of them."""
    return records.select(F.explode("grams").alias("gram"), "value").distinct()


def value_index(records: DataFrame) -> DataFrame:
    """A3: (value, n, n_ids, grams); n counts every row, n_ids distinct ids. The ids themselves: value_id_pairs."""
    pairs = records.groupBy("value", "rec_id").agg(F.count("*").alias("m"), F.first("grams").alias("grams"))
    return pairs.groupBy("value").agg(F.sum("m").alias("n"), F.count("*").alias("n_ids"), F.first("grams").alias("grams"))


def value_id_pairs(records: DataFrame) -> DataFrame:
    """A3: (value, rec_id), distinct."""
    return records.select("value", "rec_id").distinct()


def unique_grams(records: DataFrame) -> DataFrame:
    return records.select(F.explode("grams").alias("gram")).distinct()


def support_graph(records: DataFrame, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """A4: nodes (gram, n) and directed pairs (g1, g2, n, prob = n / n(g1)), both of at least `least` of all records.

    Pairs form inside each record's array: nothing is joined to make them.
    """
    total = records.count() if least else 0
    nodes = records.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least * total)
    pairs = F.flatten(
        F.transform("grams", lambda a: F.transform(F.filter("grams", lambda b: b != a), lambda b: F.struct(a.alias("g1"), b.alias("g2"))))
    )
    counts = records.select(F.explode(pairs).alias("p")).groupBy("p.g1", "p.g2").agg(F.count("*").alias("n")).where(F.col("n") >= least * total)
    own = nodes.select(F.col("gram").alias("g1"), F.col("n").alias("n1"))
    return nodes, counts.join(own, "g1").select("g1", "g2", "n", (F.col("n") / F.col("n1")).alias("prob"))


def frequency_of_frequency(df: DataFrame, key: Column) -> DataFrame:
    """A5: (frequency, n): how many values occur that often."""
    return df.groupBy(key.alias("k")).agg(F.count("*").alias("frequency")).groupBy("frequency").agg(F.count("*").alias("n"))


def column_patterns(encoded: DataFrame, key: str = "rec_id", bits: str = "bits") -> DataFrame:
    """A5 for bit columns: a column's pattern is the set of rows that have it, told apart by two sums of row hashes."""
    rows = encoded.select(F.col(key), F.explode(bits).alias("pos"))
    columns = rows.groupBy("pos").agg(F.bit_xor(F.xxhash64(key)).alias("x"), F.bit_xor(F.xxhash64(key, F.lit(1))).alias("y"), F.count("*").alias("w"))
    return frequency_of_frequency(columns, F.struct("x", "y", "w"))


def sampled_positions(bf_len: int, size: int, samples: int, seed: int) -> list[list[int]]:
    draw = random.Random(seed)
    return [sorted(draw.sample(range(bf_len), size)) for _ in range(samples)]


def sampled_weights(encoded: DataFrame, bf_len: int, size: int = 2, samples: int = 100, seed: int = 42, count: str | None = None) -> DataFrame:
    """(and_mean, and_std, xor_mean, xor_std) of the Hamming weights of random pairs or triples of bit columns.

    count: how many records a row stands for. A row's 1-bits are looked up once each: the samples that hold a position are fields of
    64-bit words, and the words' sum counts how many of its positions each sample meets.
    """
    combos = sampled_positions(bf_len, size, samples, seed)
    width = size.bit_length()
    fields = 63 // width
    words = [[0] * bf_len for _ in range(-(-samples // fields))]
    for c, positions in enumerate(combos):
        for p in positions:
            words[c // fields][p] += 1 << width * (c % fields)

    def met(table: list[int]) -> Column:
        fixed = F.from_json(F.lit(json.dumps(table)), "array<bigint>")
        return F.aggregate("bits", F.lit(0).cast("long"), lambda s, p: s + F.coalesce(F.get(fixed, p), F.lit(0).cast("long")))

    summed = encoded.select(*[met(t).alias(f"w{i}") for i, t in enumerate(words)], (F.col(count) if count else F.lit(1)).cast("long").alias("n"))
    hits = F.array(*[F.shiftrightunsigned(f"w{c // fields}", width * (c % fields)).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for c in range(samples)])
    one = summed.select("n", F.posexplode(hits).alias("c", "h"))
    each = one.groupBy("c").agg(F.sum(F.when(F.col("h") == size, F.col("n")).otherwise(0)).alias("a"), F.sum(F.col("h") % 2 * F.col("n")).alias("x"))
    return each.agg(F.avg("a").alias("and_mean"), F.stddev_pop("a").alias("and_std"), F.avg("x").alias("xor_mean"), F.stddev_pop("x").alias("xor_std"))


def other_grams(records: DataFrame, must: list[str] = (), must_not: list[str] = ()) -> DataFrame:
    """(gram, n) of the q-grams next to `must` in records with all of must and none of must_not, most frequent first."""
    rows = records
    for g in must:
        rows = rows.where(F.array_contains("grams", g))
    for g in must_not:
        rows = rows.where(~F.array_contains("grams", g))
    counts = rows.select(F.explode("grams").alias("gram")).where(~F.col("gram").isin(list(must) or [""])).groupBy("gram").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "gram")


def subsets(grams: Column) -> Column:
    """All subsets of at least two of an array's elements, in the array's order."""
    none = F.array(F.array().cast("array<string>"))
    power = F.aggregate(grams, none, lambda acc, g: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, g))))
    return F.filter(power, lambda s: F.size(s) >= 2)


def language_model(records: DataFrame, frequent: list[str], mode: str = "single", least: int = 1, most_frequent_per_record: int = 16) -> DataFrame:
    """(included, excluded, n, gram, n_gram): keys of frequent q-grams, how often each occurs, and with which others.

    single: one frequent q-gram; tuple: every subset of two or more; all: the included and the excluded ones together.
    A record with more frequent q-grams than most_frequent_per_record has too many subsets and is refused, not cut.
    """
    known = F.array(*map(F.lit, sorted(frequent)))
    own = F.filter(known, lambda g: F.array_contains("grams", g))
    rest = F.array_except(F.col("grams"), known)
    empty = F.array().cast("array<string>")
    rows = records.select(own.alias("own"), rest.alias("rest"))
    if mode == "single":
        keys = F.transform("own", lambda g: F.struct(F.array(g).alias("i"), empty.alias("e")))
    elif mode == "tuple":
        checked = F.when(F.size("own") <= most_frequent_per_record, F.col("own")).otherwise(
            F.raise_error(F.lit("a record has too many frequent q-grams for subsets")).cast("array<string>")
        )
        keys = F.transform(subsets(checked), lambda s: F.struct(s.alias("i"), empty.alias("e")))
    elif mode == "all":
        keys = F.when(F.size("own") > 0, F.array(F.struct(F.col("own").alias("i"), F.array_except(known, "own").alias("e"))))
    else:
        raise ValueError("mode is single, tuple or all")
    each = rows.select(F.explode(keys).alias("k"), "rest").select(F.col("k.i").alias("included"), F.col("k.e").alias("excluded"), "rest")
    counts = each.groupBy("included", "excluded").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    grams = each.select("included", "excluded", F.explode("rest").alias("gram")).groupBy("included", "excluded", "gram").agg(F.count("*").alias("n_gram"))
    return counts.join(grams.where(F.col("n_gram") >= least), ["included", "excluded"])


def weight_summary(weights: DataFrame, column: str) -> DataFrame:
    """A10: least, mean, standard deviation and most."""
    c = F.col(column)
    return weights.agg(F.min(c).alias("least"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.max(c).alias("most"))


def row_weights(encoded: DataFrame, bits: str = "bits") -> DataFrame:
    return encoded.select(F.size(bits).alias("weight"))


def column_weights(encoded: DataFrame, bits: str = "bits") -> DataFrame:
    return encoded.select(F.explode(bits).alias("pos")).groupBy("pos").agg(F.count("*").alias("weight"))


def smallest_mode(df: DataFrame, column: str) -> int | None:
    """The most common value, the smallest of several."""
    row = df.groupBy(column).count().orderBy(F.desc("count"), F.asc(column)).first()
    return None if row is None else row[0]


def similarity_gaps(plain: DataFrame, encoded: DataFrame, width: float = 0.05) -> DataFrame:
    """(high, mean, n) of encoded minus plain similarity by interval (high - width, high] of the plain one.

    Both: src, dst, sim. Empty intervals above the first full one are left out; later ones have mean 0 and n 0.
    """
    steps = round(1 / width)
    joined = plain.select("src", "dst", F.col("sim").alias("p")).join(encoded.select("src", "dst", F.col("sim").alias("e")), ["src", "dst"])
    at = F.least(F.floor(F.round((1.0 - F.col("p")) / width, 9)), F.lit(steps - 1)).cast("int")
    got = joined.groupBy(at.alias("step")).agg(F.avg(F.col("e") - F.col("p")).alias("mean"), F.count("*").alias("n"))
    every = plain.sparkSession.range(steps).select(F.col("id").cast("int").alias("step"))
    first = got.agg(F.min("step").alias("first"))
    return (
        every.crossJoin(F.broadcast(first)).where("step >= first").join(got, "step", "left")
        .select(F.round(1.0 - F.col("step") * width, 4).alias("high"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    )


def uniqueness(features: DataFrame, column: str = "features") -> DataFrame:
    """Share of distinct feature vectors."""
    return features.agg((F.count_distinct(column) / F.count("*")).alias("uniqueness"))


def without_frequent(features: DataFrame, most: int, column: str = "features") -> DataFrame:
    """Rows whose vector occurs at most `most` times; counts come from an aggregation, not a window over a hot vector."""
    often = features.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    return features.join(often, F.col(column) == F.col("__v"), "left_anti")


def ranked_accuracy(matches: DataFrame, score: str, correct: str, key: list[str], tops: tuple[int, ...] = (10, 20, 50, 100, 200, 500, 1000)) -> DataFrame:
    """(top, n, right): correct matches among the best `top`, and among all (top null)."""
    best = matches.orderBy(F.desc(score), *key).limit(max(tops)).withColumn("r", F.row_number().over(Window.orderBy(F.desc(score), *key)))
    some = best.select(F.explode(F.array(*map(F.lit, tops))).alias("top"), "r", correct).where("r <= top")
    heads = some.groupBy("top").agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("right"))
    whole = matches.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(correct).cast("long")), F.lit(0)).alias("right"))
    return heads.unionByName(whole.select(F.lit(None).cast("int").alias("top"), "n", "right"))


def measure_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(measure, least, mean, most, share_one) of recall, precision and the like."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("measure").agg(F.min("v").alias("least"), F.avg("v").alias("mean"), F.max("v").alias("most"), (100.0 * F.count(F.when(F.col("v") == 1, 1)) / (F.count("*") + 0.0001)).alias("share_one"))


def block_summary(blocks: DataFrame, key: str = "block") -> DataFrame:
    """Sizes of blocks and the pairs they make."""
    sizes = blocks.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.min("n").alias("least"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"),
        F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"),
    )


def common_share(a: DataFrame, b: DataFrame, column: str) -> float:
    """200 common / (a + b) over distinct values."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    n, m, both = x.count(), y.count(), x.intersect(y).count()
    return 200.0 * both / (n + m) if n + m else math.nan
