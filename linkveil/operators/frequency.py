"""Frequency alignment (A1, A2, J1-J3, V6): which values frequent filters probably encode, and what that gives away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkveil.functions.columns import gram_set
from linkveil.session import materialize

#: Values that reconstruct() may be asked to try; the candidates are a stated top-N.
MOST_CANDIDATES = 10_000


def pattern(bits: Column) -> Column:
    """Sorted positions as one string, a groupable key."""
    return F.array_join(bits, ",")


def frequencies(df: DataFrame, value: Column | str, name: str, least: int = 1) -> DataFrame:
    """(name, n): how often each value occurs, if at least `least` times."""
    col = F.col(value) if isinstance(value, str) else value
    return df.groupBy(col.alias(name)).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def ranked(freq: DataFrame, name: str) -> DataFrame:
    """(rank from 0, name, n, tied: the next has the same n). Ties by value.

    Only the head up to the first tie matters. A tie needs a frequency that two values share, so values rarer than the
    most frequent tie are dropped before the rank: what is ranked in one task is a list of distinct numbers.
    """
    doubled = freq.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").agg(F.max("n").alias("tie"))
    head = freq.crossJoin(F.broadcast(doubled)).where(F.col("tie").isNull() | (F.col("n") > F.col("tie")))
    first_tied = freq.crossJoin(F.broadcast(doubled)).where(F.col("n") == F.col("tie")).agg(F.min(name).alias(name), F.max("n").alias("n"))
    rows = head.select(name, "n", F.lit(False).alias("tied")).unionByName(
        first_tied.where("n is not null").select(name, "n", F.lit(True).alias("tied"))
    )
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(name))) - 1)


def align(filters: DataFrame, values: DataFrame, least: int = 1) -> DataFrame:
    """(rank, bits, bf_n, value, value_n) while the frequencies of both sides are unique.

    filters: a column bits (pattern); values: a column value. With one rank in all the pair is taken as it is.
    """
    own = materialize(frequencies(filters, "bits", "bits", least), "filter-frequencies")  # read several times each
    other = materialize(frequencies(values, "value", "value", least), "value-frequencies")
    single = own.limit(2).count() == 1 or other.limit(2).count() == 1
    left = ranked(own, "bits").select("rank", "bits", F.col("n").alias("bf_n"), F.col("tied").alias("lt"))
    right = ranked(other, "value").select("rank", "value", F.col("n").alias("value_n"), F.col("tied").alias("rt"))
    clear = ~F.col("lt") & ~F.col("rt") | (F.col("rank") == 0 if single else F.lit(False))
    return left.join(right, "rank").where(clear).select("rank", "bits", "bf_n", "value", "value_n")


def position_weights(aligned: DataFrame, bf_len: int, q: int) -> DataFrame:
    """(pos, gram, weight) of q-grams that may be encoded at a position: seen with a 1-bit there, never with a 0-bit."""
    own = aligned.select(
        F.transform(F.split("bits", ","), lambda p: p.cast("int")).alias("ones"), gram_set(F.col("value"), q).alias("grams")
    ).where(F.size("grams") > 0)
    every = F.sequence(F.lit(0), F.lit(bf_len - 1))
    one = own.select("grams", (1.0 / F.size("grams")).alias("w"), F.explode("ones").alias("pos"))
    zero = own.select("grams", F.explode(F.array_except(every, "ones")).alias("pos"))
    likely = one.select("pos", "w", F.explode("grams").alias("gram")).groupBy("pos", "gram").agg(F.sum("w").alias("weight"))
    never = zero.select("pos", F.explode("grams").alias("gram")).distinct()
    return likely.join(never, ["pos", "gram"], "left_anti")


def reconstruct(encoded: DataFrame, weights: DataFrame, values: DataFrame, top: int) -> DataFrame:
    """(enc_id, true_value, guesses): for every encoded record, which of the top most frequent values its bits allow.

    encoded: enc_id, bits (array), true_value; only records whose true value is a candidate and the first record of each
    value are judged, as in V6. A candidate goes if at some 1-bit with guesses it contains none of the guessed q-grams.
    """
    if top > MOST_CANDIDATES:
        raise ValueError(f"at most {MOST_CANDIDATES} candidates")
    candidates = frequencies(values, "value", "value").orderBy(F.desc("n"), "value").limit(top).select("value")
    guess = weights.groupBy("pos").agg(F.collect_set("gram").alias("grams"))
    # for each (position, candidate): does the position allow it? at most positions x top rows
    barred = (
        guess.crossJoin(F.broadcast(candidates))
        .where(~F.exists("grams", lambda g: F.contains(F.col("value"), g)))
        .groupBy("pos")
        .agg(F.collect_set("value").alias("barred"))
    )
    first = (
        encoded.join(F.broadcast(candidates), F.col("true_value") == F.col("value"), "left_semi")
        .groupBy("true_value")
        .agg(F.min_by("bits", "enc_id").alias("bits"), F.min("enc_id").alias("enc_id"))
    )
    out = (
        first.select("enc_id", "true_value", F.explode_outer("bits").alias("pos"))
        .join(barred, "pos", "left")
        .groupBy("enc_id", "true_value")
        .agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("barred", F.array().cast("array<string>"))))).alias("barred"))
    )
    every = candidates.agg(F.array_sort(F.collect_list("value")).alias("all"))  # `top` values
    return out.crossJoin(F.broadcast(every)).select("enc_id", "true_value", F.array_except("all", "barred").alias("guesses"))


def guess_counts(reconstructed: DataFrame) -> DataFrame:
    """V6: exact (the one guess is right), correct (one of several is right), wrong, none."""
    n, right = F.size("guesses"), F.array_contains("guesses", F.col("true_value"))
    return reconstructed.agg(
        F.count(F.when((n == 1) & right, 1)).alias("exact"),
        F.count(F.when((n > 1) & right, 1)).alias("correct"),
        F.count(F.when((n > 0) & ~right, 1)).alias("wrong"),
        F.count(F.when(n == 0, 1)).alias("no_guess"),
    )
