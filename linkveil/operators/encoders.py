"""Encoders (E1-E7): attribute-level, record-level and combined Bloom filters as sorted position sets."""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkveil.functions import hashing
from linkveil.functions.columns import gram_set, optimal_k, salted
from linkveil.operators import hardening


@dataclass(frozen=True)
class Encoding:
    """How records become filters. k may hold one number per attribute (CLK-RBF); rbf: bits that each attribute gives."""

    attributes: tuple[str, ...]
    q: int = 2
    padded: bool = False
    bf_len: int = 1000
    k: int | tuple[int, ...] = 10
    scheme: str = "dh"
    kind: str = "clk"  # abf | clk | clkrbf | rbf
    salt: str | None = None
    harden: str = "none"  # none | balance | fold | rule90 | markov
    seed: int = 42

    @property
    def length(self) -> int:
        """The length after hardening."""
        return {"balance": 2 * self.bf_len, "fold": self.bf_len // 2}.get(self.harden, self.bf_len)


def attribute_grams(e: Encoding, attribute: str) -> Column:
    grams = gram_set(F.col(attribute), e.q, e.padded)
    return salted(grams, F.col(e.salt)) if e.salt else grams


#: Distinct q-grams whose positions go with the plan (some 60 bytes each); beyond that every row hashes its own.
MOST_GRAMS = 20_000
#: Positions of a set of q-grams: (q-grams, length, k) -> sorted set.
Hash = Callable[[Column, int, int], Column]


def in_row(e: Encoding) -> Hash:
    return lambda grams, bf_len, k: hashing.positions(grams, bf_len, k, e.scheme)


def from_dictionary(df: DataFrame, e: Encoding) -> Hash:
    """Hashes every distinct q-gram of the attributes once and looks positions up in the rows; in_row where there are too many.

    The dictionary is a literal of buckets, found by the q-gram's CRC-32, so that a lookup does not grow with it.
    """
    each = df.select(F.explode(F.flatten(F.array(*[attribute_grams(e, a) for a in e.attributes]))).alias("gram")).distinct()
    known = [r["gram"] for r in each.limit(MOST_GRAMS + 1).collect()]
    if len(known) > MOST_GRAMS or not known:
        return in_row(e)
    own = df.sparkSession.createDataFrame([(g,) for g in known], "gram string")

    def positions(grams: Column, bf_len: int, k: int) -> Column:
        n = 1 << (len(known) // 2).bit_length()
        buckets: list[dict[str, list[int]]] = [{} for _ in range(n)]
        for r in own.select("gram", hashing.positions(F.array("gram"), bf_len, k, e.scheme).alias("p")).collect():
            buckets[zlib.crc32(r["gram"].encode()) % n][r["gram"]] = list(r["p"])
        table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,array<int>>>")
        look = lambda g: F.element_at(F.get(table, F.pmod(F.crc32(g.cast("binary")), F.lit(n)).cast("int")), g)
        return F.sort_array(F.array_distinct(F.flatten(F.transform(grams, look))))

    return positions


def attribute_filter(e: Encoding, attribute: str, k: int, bf_len: int | None = None, how: Hash | None = None) -> Column:
    return (how or in_row(e))(attribute_grams(e, attribute), bf_len or e.bf_len, k)


def abf(e: Encoding, how: Hash | None = None) -> Column:
    """The first attribute alone."""
    return attribute_filter(e, e.attributes[0], e.k if isinstance(e.k, int) else e.k[0], how=how)


def clk(e: Encoding, how: Hash | None = None) -> Column:
    """The OR of all attributes' filters, with one k or one for each."""
    ks = (e.k,) * len(e.attributes) if isinstance(e.k, int) else e.k
    if len(ks) != len(e.attributes):
        raise ValueError("one number of hash functions for each attribute")
    return F.sort_array(F.array_distinct(F.flatten(F.array(*[attribute_filter(e, a, k, how=how) for a, k in zip(e.attributes, ks, strict=True)]))))


def rbf_map(lengths: list[int], shares: list[float], bf_len: int, seed: int = 42) -> list[list[int]]:
    """For every attribute a list of (filter bit, record bit) pairs, flattened by attribute.

    Attribute a gives int(share * bf_len) bits drawn with its number as seed, laid side by side and then permuted with the
    given seed. A filter with fewer bits than that gives each once, and the rest with repeats.
    """
    drawn: list[tuple[int, int]] = []
    for number, (length, share) in enumerate(zip(lengths, shares, strict=True)):
        want, draw = int(share * bf_len), random.Random(number)
        bits = draw.sample(range(length), want) if want <= length else list(range(length)) + [draw.randrange(length) for _ in range(want - length)]
        drawn += [(number, b) for b in bits]
    to = hardening.permutation(len(drawn), seed)
    return [[number, bit, to[at]] for at, (number, bit) in enumerate(drawn)]


def apply_rbf_map(filters: list[Column], table: list[list[int]]) -> Column:
    """The record filter: record bits whose attribute bit is set. The map is a literal, by filter bit: work grows with the 1-bits."""

    def part(number: int, pos: Column) -> Column:
        to: list[list[int]] = [[] for _ in range(1 + max((b for n, b, _ in table if n == number), default=0))]
        for n, b, r in table:
            if n == number:
                to[b].append(r)
        by_bit = F.from_json(F.lit(json.dumps(to)), "array<array<int>>")
        return F.flatten(F.transform(pos, lambda p: F.coalesce(F.get(by_bit, p), F.array().cast("array<int>"))))

    return F.sort_array(F.flatten(F.array(*[part(n, pos) for n, pos in enumerate(filters)])))


def dynamic_length(share: float, k: int, average_grams: float) -> int:
    """E5: the length at which an attribute filter of that many q-grams is filled to about 1 - share."""
    return int(round(1 / (1 - share ** (1 / (k * average_grams)))))


def average_grams(df: DataFrame, e: Encoding) -> dict[str, float]:
    """F5 for every attribute: one pass."""
    row = df.agg(*[F.avg(F.size(attribute_grams(e, a))).alias(a) for a in e.attributes]).first()
    return {a: float(row[a] or 0) for a in e.attributes}


def with_optimal_k(df: DataFrame, e: Encoding) -> Encoding:
    """e with the k that fills half the bits of an average record."""
    row = df.agg(F.avg(F.size(F.array_distinct(F.flatten(F.array(*[attribute_grams(e, a) for a in e.attributes]))))).alias("n")).first()
    return Encoding(**{**e.__dict__, "k": max(1, optimal_k(e.bf_len, row["n"]))})


def rbf(df: DataFrame, e: Encoding, shares: list[float], dynamic: bool = False, fill: float = 0.5, how: Hash | None = None) -> Column:
    """E4 and E5. Lengths of attribute filters are bf_len, or follow the average number of q-grams."""
    k = e.k if isinstance(e.k, int) else e.k[0]
    lengths = [e.bf_len] * len(e.attributes)
    if dynamic:
        grams = average_grams(df, e)
        lengths = [dynamic_length(fill, k, max(grams[a], 1.0)) for a in e.attributes]
    filters = [attribute_filter(e, a, k, n, how) for a, n in zip(e.attributes, lengths, strict=True)]
    return apply_rbf_map(filters, rbf_map(lengths, shares, e.bf_len, e.seed))


def harden(pos: Column, e: Encoding) -> Column:
    if e.harden == "balance":
        return hardening.balance(pos, e.bf_len, e.seed)
    if e.harden == "fold":
        return hardening.fold(pos, e.bf_len)
    if e.harden == "rule90":
        return hardening.rule_90(pos, e.bf_len)
    return pos


def encode(df: DataFrame, e: Encoding, shares: list[float] | None = None, out: str = "bits", chain_len: int = 2, dictionary: bool = True) -> DataFrame:
    """Df with a column of sorted 1-bits. One projection, whatever the size, but for Markov chains, which join their model.

    With dictionary (not on streams) a first job gathers the distinct q-grams, which are then hashed once each.
    """
    if e.harden == "markov":
        value = df.withColumn("__value", F.concat_ws(" ", *[F.coalesce(F.col(a), F.lit("")) for a in e.attributes])).withColumn("__row", F.monotonically_increasing_id())
        grams = value.withColumn("__grams", F.array_distinct(F.flatten(F.array(*[attribute_grams(e, a) for a in e.attributes]))))
        extras = hardening.markov_extras(hardening.transitions(value, "__value", e.q, e.padded), chain_len, seed=e.seed)
        from linkveil.session import materialize

        wide = hardening.expand_grams(materialize(grams, "markov-grams"), "__grams", extras, "__row")
        k = e.k if isinstance(e.k, int) else e.k[0]
        return wide.withColumn(out, hashing.positions(F.col("__grams"), e.bf_len, k, e.scheme)).drop("__value", "__row", "__grams")
    how = from_dictionary(df, e) if dictionary and not df.isStreaming and e.scheme != "rh" else in_row(e)
    even = [1 / len(e.attributes)] * len(e.attributes)
    pos = {"abf": lambda: abf(e, how), "clk": lambda: clk(e, how), "clkrbf": lambda: clk(e, how)}.get(e.kind, lambda: rbf(df, e, shares or even, how=how))()
    return df.withColumn(out, harden(pos, e))


#: Distinct values whose results go to every task (a balanced filter of 1,000 bits is some 5 KB as a string); beyond that each row is worked out.
MOST_VALUES = 5_000


def per_value(df: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame], most: int = MOST_VALUES) -> DataFrame:
    """df with the columns that make adds to rows from their keys alone: made once for each distinct value, where there are few."""
    values = df.select(*keys).distinct()
    if values.limit(most + 1).count() > most:
        return make(df)
    done = make(values).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(F.broadcast(done), same).drop(*[f"__{k}" for k in keys])


def true_positions(df: DataFrame, e: Encoding) -> DataFrame:
    """(gram, pos): the truth that evaluations hold guesses against; each distinct q-gram is hashed once.

    Balancing and folding move positions; rule 90 mixes them, so that no truth exists.
    """
    if e.harden == "rule90":
        raise ValueError("rule 90 leaves no position of a single q-gram")
    grams = df.select(F.explode(F.flatten(F.array(*[attribute_grams(e, a) for a in e.attributes]))).alias("gram")).distinct()
    k = e.k if isinstance(e.k, int) else max(e.k)
    pos = F.explode(hashing.positions(F.array("gram"), e.bf_len, k, e.scheme))
    out = grams.select("gram", pos.alias("pos"))
    if e.harden == "balance":
        to = F.array(*map(F.lit, hardening.permutation(2 * e.bf_len, e.seed)))
        return out.select("gram", F.get(to, F.col("pos")).alias("pos"))
    if e.harden == "fold":
        return out.select("gram", F.pmod("pos", F.lit(e.bf_len // 2)).alias("pos")).distinct()
    return out


def packed(pos: Column, bf_len: int) -> Column:
    """The filter as 64-bit words, lowest position first."""
    words = -(-bf_len // 64)
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(words - 1)),
        lambda w: F.aggregate(
            F.filter(pos, lambda p: F.floor(p / 64) == w), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(bit(p))
        ),
    )
