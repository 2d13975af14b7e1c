"""Bloom-filter hashing (H1-H5): the positions of q-grams as sorted sets of ints.

Digests are folded to a remainder in chunks of eight hex digits, so every product stays below 2 ** 63. All but the
Mersenne Twister scheme run inside the JVM without a shuffle.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkveil.functions.columns import let


def digest_mod(hex_digest: Column, digits: int, modulus: int) -> Column:
    """The hex number of that many digits (a multiple of 8) modulo modulus."""
    if not 0 < modulus < 2**31:
        raise ValueError("the length of a filter must be below 2 ** 31")

    def fold(digest: Column) -> Column:
        out = F.lit(0).cast("long")
        for at in range(1, digits, 8):
            chunk = F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
            out = F.pmod(out * F.lit(1 << 32) + chunk, F.lit(modulus).cast("long"))
        return out

    return let(hex_digest, fold)


def _sha1(g: Column, n: int) -> Column:
    return digest_mod(F.sha1(g.cast("binary")), 40, n)


def _md5(g: Column, n: int) -> Column:
    return digest_mod(F.md5(g.cast("binary")), 32, n)


def _sha224(g: Column, n: int) -> Column:
    return digest_mod(F.sha2(g.cast("binary"), 224), 56, n)


def _series(base: Column, terms: Callable[[int], Column], k: int, bf_len: int) -> Column:
    return F.array(*[F.pmod(base + terms(i), F.lit(bf_len).cast("long")).cast("int") for i in range(1, k + 1)])


def double_hash(g: Column, bf_len: int, k: int) -> Column:
    """(SHA-1 + i MD5) mod length, i = 1..k."""
    return let(
        F.struct(_sha1(g, bf_len).alias("a"), _md5(g, bf_len).alias("b")), lambda h: _series(h["a"], lambda i: h["b"] * i, k, bf_len)
    )


def enhanced_double_hash(g: Column, bf_len: int, k: int) -> Column:
    """Double hashing with (i^3 - i) / 6 added."""
    return let(
        F.struct(_sha1(g, bf_len).alias("a"), _md5(g, bf_len).alias("b")),
        lambda h: _series(h["a"], lambda i: h["b"] * i + (i**3 - i) // 6, k, bf_len),
    )


def triple_hash(g: Column, bf_len: int, k: int) -> Column:
    """Double hashing with i (i - 1) / 2 times SHA-224 added."""
    return let(
        F.struct(_sha1(g, bf_len).alias("a"), _md5(g, bf_len).alias("b"), _sha224(g, bf_len).alias("c")),
        lambda h: _series(h["a"], lambda i: h["b"] * i + h["c"] * (i * (i - 1) // 2), k, bf_len),
    )


def counter_hash(g: Column, bf_len: int, k: int) -> Column:
    """Random hashing inside the JVM: position i is SHA-1 of the q-gram and i. Other positions than random_hash."""
    return F.array(*[digest_mod(F.sha1(F.concat(g, F.lit(f"#{i}")).cast("binary")), 40, bf_len).cast("int") for i in range(1, k + 1)])


#: Schemes over one q-gram, in the JVM.
SCHEMES = {"dh": double_hash, "edh": enhanced_double_hash, "th": triple_hash, "counter": counter_hash}


def twister_positions(gram: str, bf_len: int, k: int) -> list[int]:
    """k draws of a Mersenne Twister seeded by the q-gram's SHA-1 (Python's random)."""
    draw = random.Random(int(hashlib.sha1(gram.encode()).hexdigest(), 16)).randint
    return [draw(0, bf_len - 1) for _ in range(k)]


def random_hash(bf_len: int, k: int) -> Callable[[Column], Column]:
    """Positions of an array of q-grams under the Twister scheme, by an Arrow-batched function with a small memory."""

    @F.pandas_udf("array<int>")
    def positions(grams: pd.Series) -> pd.Series:
        known: dict[str, list[int]] = {}

        def of(values) -> list[int]:
            out: set[int] = set()
            for g in values if values is not None else ():
                if g not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[g] = twister_positions(g, bf_len, k)
                out.update(known[g])
            return sorted(out)

        return grams.map(of)

    return positions


def positions(grams: Column, bf_len: int, k: int, scheme: str = "dh") -> Column:
    """The sorted set of 1-bits of a q-gram set."""
    if scheme == "rh":
        return random_hash(bf_len, k)(grams)
    each = SCHEMES[scheme]
    return F.sort_array(F.array_distinct(F.flatten(F.transform(grams, lambda g: each(g, bf_len, k)))))  # array_sort compares by an interpreted lambda
