"""Scalar and array functions as Column expressions (F1-F18): normalising, q-grams, similarities, estimates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# -- F1: normalising


def normal(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def record_id(value: Column) -> Column:
    """Trimmed and lower-cased; of an id with dashes, the second part."""
    clean = normal(value)
    return F.when(F.contains(clean, F.lit("-")), F.trim(F.get(F.split(clean, "-"), F.lit(1)))).otherwise(clean)


def record_value(*attributes: Column) -> Column:
    return F.concat_ws(" ", *[normal(a) for a in attributes])


# -- F2 to F6: q-grams


def grams_in_order(value: Column, q: int, padded: bool = False) -> Column:
    """All q-grams of a string from left to right, repeats included; none if it is shorter than q."""
    text = F.coalesce(value, F.lit(""))
    if padded:
        text = F.concat(F.lit(PAD * (q - 1)), text, F.lit(PAD * (q - 1)))
    n = F.char_length(text) - (q - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(q)))).otherwise(
        F.array().cast("array<string>")
    )


def grams_of_long(value: Column, q: int) -> Column:
    """grams_in_order for long texts: from an array of the characters, for substring counts from the text's start each time."""
    text = F.coalesce(value, F.lit(""))
    at = lambda chars: F.transform(F.sequence(F.lit(0), F.size(chars) - q), lambda i: F.concat(*[F.get(chars, i + k) for k in range(q)]))
    return F.when(F.char_length(text) >= q, let(F.split(text, ""), at)).otherwise(F.array().cast("array<string>"))


def gram_set(value: Column, q: int, padded: bool = False) -> Column:
    return F.array_distinct(grams_in_order(value, q, padded))


def record_grams(attributes: list[Column], q: int, padded: bool = False) -> Column:
    """The union of the attributes' q-gram sets."""
    return F.array_distinct(F.flatten(F.array(*[grams_in_order(a, q, padded) for a in attributes])))


def salted(grams: Column, salt: Column) -> Column:
    extra = F.coalesce(salt.cast("string"), F.lit(""))
    return F.transform(grams, lambda g: F.concat(g, extra))


def optimal_k(bf_len: int, average_grams: float) -> int:
    """The number of hash functions that fills about half the bits; halves round to even."""
    return round(math.log(2) * bf_len / average_grams)


# -- F7, F9, F10: similarities


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def dice(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both > 0, 2.0 * common(a, b) / both).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(a) + F.size(b) - common(a, b)
    return F.when(union > 0, common(a, b) / union).otherwise(F.lit(0.0))


def hamming(a: Column, b: Column, bf_len: int) -> Column:
    """1 - differing bits / length, of two position sets."""
    return 1.0 - (F.size(a) + F.size(b) - 2 * common(a, b)) / F.lit(float(bf_len))


SIMILARITIES = {"dice": dice, "jaccard": jaccard}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def angle_similarity(a: Column, b: Column) -> Column:
    return 1.0 - F.acos(F.least(cosine(a, b), F.lit(1.0))) / math.pi


def euclidean(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def sorted_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of the largest values in order; missing ones count as 0."""
    gap = F.zip_with(
        F.sort_array(a, False), F.sort_array(b, False), lambda x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    )
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.size(b), F.lit(1))


# -- F8: soundex variant

#: The digit of each letter that has one.
SOUNDEX_DIGITS = {
    "b": "1", "f": "1", "p": "1", "v": "1", "c": "2", "g": "2", "j": "2", "k": "2", "q": "2", "s": "2", "x": "2", "z": "2",
    "d": "3", "t": "3", "l": "4", "m": "5", "n": "5", "r": "6",
}


def soundex(value: Column) -> Column:
    """First letter as it is, then digits of the coded letters after it; a digit equal to the one before it is dropped,
    even across vowels; four characters; z000 for an empty value."""
    text = normal(value)
    tail = F.translate(
        F.regexp_replace(F.substring(text, F.lit(2), F.char_length(text)), "[^bcdfgjklmnpqrstvxz]", ""),
        "".join(SOUNDEX_DIGITS),
        "".join(SOUNDEX_DIGITS.values()),
    )
    code = F.concat(F.substring(text, 1, 1), F.regexp_replace(tail, r"(.)\1+", "$1"))
    return F.when(text == "", F.lit("z000")).otherwise(F.rpad(code, 4, "0"))


# -- F11 to F18


def similarity_class(sim: Column) -> Column:
    """The upper bound in tenths of the bucket (low, high] of width 0.1; null at or below 0."""
    return F.when(sim > 0, F.ceil(F.round(sim * 10, 9)).cast("int"))


def sim_hash_bits(vector: Column, planes: list[list[float]]) -> Column:
    """One bit per plane: 1 where the dot product is not negative."""
    return F.array(*[F.when(dot(vector, F.array(*map(F.lit, p))) >= 0, 1).otherwise(0) for p in planes])


def gram_count_bounds(weight: Column, bf_len: int, k: int) -> tuple[Column, Column, Column]:
    """Lower bound, estimate and upper bound of the number of q-grams in a filter of that Hamming weight."""
    w = F.least(weight.cast("double"), F.lit(bf_len - 0.5))
    estimate = F.ln(1 - w / bf_len) / math.log(1 - 1 / bf_len) / k
    lower = F.floor(weight / k).cast("long")
    return lower, estimate, 2 * estimate - lower


def gram_count_check(weight: Column, bf_len: int, k: int) -> Column:
    """The second formula for the same estimate."""
    w = F.least(weight.cast("double"), F.lit(bf_len - 0.5))
    return -(bf_len / k) * F.ln(1 - w / bf_len)


def distinct_columns_probability(bf_len: int, k: int) -> float:
    """That two q-grams share no position, if their 2k positions are drawn at random."""
    return math.prod(1 - i / bf_len for i in range(2 * k))


def token_overlap(true: Column, guess: Column) -> Column:
    a = F.array_distinct(F.split(true, r"\s+"))
    return F.size(F.array_intersect(a, F.split(guess, r"\s+"))) / F.size(a)


def contains_any(value: Column, grams: Column) -> Column:
    return F.exists(grams, lambda g: F.contains(value, g))


def contains_all(value: Column, grams: Column) -> Column:
    return F.forall(grams, lambda g: F.contains(value, g))


def suspicion(matches: Column, population: int) -> Column:
    """((1/f) - (1/N)) / (1 - (1/N))."""
    return (1 / matches - 1 / population) / (1 - 1 / population)
