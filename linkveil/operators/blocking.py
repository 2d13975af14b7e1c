"""Candidate generation and similarity joins.

Blocks are tables of (block, id); pairs form by an equi-join on the block, which AQE may split where a block is hot.
Give distinct values, not records: copies then do not multiply.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkveil.functions.columns import let, soundex
from linkveil.session import materialize

#: The prime above 2 ** 32 that MinHash values are taken by.
PRIME = 4294967311


def minhash_coefficients(n: int, seed: int = 17) -> list[tuple[int, int]]:
    draw = random.Random(seed)
    a, b = (sorted(draw.sample(range(2**31), n)) for _ in range(2))
    return list(zip(a, b, strict=True))


def minhash_signature(grams: Column, n: int, seed: int = 17) -> Column:
    """n minima of (a x + b) mod PRIME over the CRC-32 of the q-grams."""
    pairs = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in minhash_coefficients(n, seed)])
    return let(
        F.transform(grams, lambda g: F.crc32(g.cast("binary"))),
        lambda xs: F.transform(pairs, lambda c: F.array_min(F.transform(xs, lambda x: (c["a"] * x + c["b"]) % PRIME))),
    )


def minhash_blocks(df: DataFrame, key: str, grams: str, rows: int = 4, bands: int = 50, seed: int = 17) -> DataFrame:
    """(block, key): one block per band of the signature; the band's number is part of the block."""
    signed = df.where(F.size(grams) > 0).select(key, minhash_signature(F.col(grams), rows * bands, seed).alias("s"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.concat_ws(":", b, F.array_join(F.slice("s", b * rows + 1, rows), "-")))
    return signed.select(key, F.explode(keys).alias("block")).select("block", key)


def band_probability(similarity: float, rows: int, bands: int) -> float:
    """That a pair of that Jaccard similarity shares a block."""
    return 1 - (1 - similarity**rows) ** bands


def hamming_samples(n_bits: int, samples: int, size: int, seed: int = 42) -> list[list[int]]:
    draw = random.Random(seed)
    return [sorted(draw.sample(range(n_bits), size)) for _ in range(samples)]


def hamming_blocks(df: DataFrame, key: str, bits: str, n_bits: int, samples: int, size: int, seed: int = 42) -> DataFrame:
    """(block, key): for every sample of positions, its number and which of them are set."""
    chosen = F.array(*[F.struct(F.lit(s).alias("s"), F.array(*map(F.lit, p)).alias("p")) for s, p in enumerate(hamming_samples(n_bits, samples, size, seed))])
    keys = F.transform(chosen, lambda c: F.concat_ws(":", c["s"], F.array_join(F.array_intersect(c["p"], F.col(bits)), "-")))
    return df.select(key, F.explode(keys).alias("block")).select("block", key)


def soundex_blocks(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """(block, key): the codes of the attributes together."""
    return df.select(F.concat_ws("-", *[soundex(F.col(a)) for a in attributes]).alias("block"), key)


def one_block(df: DataFrame, key: str, most: int = 5_000) -> DataFrame:
    """Everything in one block: for sets of at most `most` rows, which are compared in whole; larger ones are refused."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"one block compares every pair; it takes at most {most} rows")
    return df.select(F.lit("all").alias("block"), key)


def shared_blocks(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows in blocks that have rows on both sides."""
    return a.join(b.select("block").distinct(), "block", "left_semi"), b.join(a.select("block").distinct(), "block", "left_semi")


def prefix_blocks(df: DataFrame, key: str, features: str, least: float) -> DataFrame:
    """(block, key): a lossless set of blocks for pairs of at least that Dice similarity, without comparing all pairs.

    Two sets of that similarity share at least n t / (2 - t) elements of either set's n, so that they meet in the n - that + 1
    rarest elements of both. Blocks are rare elements; common ones make none.
    """
    each = df.select(key, F.explode(features).alias("block"))
    often = each.groupBy("block").agg(F.count("*").alias("f"))
    rare = each.join(often, "block").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("f", "block"))).alias("all"))
    shared = F.ceil(F.round(F.size("all") * (least / (2 - least)), 9)).cast("int")
    return rare.select(key, F.explode(F.slice("all", F.lit(1), F.size("all") - shared + 1)).alias("x")).select(F.col("x.block").alias("block"), key)


def candidate_pairs(blocks: DataFrame, key: str) -> DataFrame:
    """(src, dst), src < dst: every pair that shares a block, once."""
    left, right = blocks.select("block", F.col(key).alias("src")), blocks.select("block", F.col(key).alias("dst"))
    return left.join(right, "block").where("src < dst").select("src", "dst").distinct()


#: Words of a set's sketch.
SKETCH_WORDS = 4


def sketch(features: Column, words: int = SKETCH_WORDS) -> Column:
    """64-bit words whose bits are the parities of the elements that hash to them: two sketches differ in at most as many bits as
    the sets in elements."""
    hashes = F.transform(F.array_distinct(features), lambda x: F.xxhash64(x))
    flip = lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int")))
    of = lambda hs, w: F.aggregate(F.filter(hs, lambda h: F.pmod(h, F.lit(words)) == w), F.lit(0).cast("long"), flip)
    return let(hashes, lambda hs: F.array(*[of(hs, w) for w in range(words)]))


def dice_candidates(df: DataFrame, key: str, features: str, least: float, block_rows: int = 1_000) -> DataFrame:
    """(src, dst), src < dst, once: all pairs of at least that Dice similarity among a few others.

    Pairs meet in prefix_blocks; inside the join, before anything is shuffled, go those whose sizes or sketches differ
    by more than the similarity allows: (|A| + |B|) (1 - least) elements. A block is cut into parts of about block_rows rows on
    one side, each with the whole block on the other, so that a frequent element's block is shared out among tasks.
    """
    drawn = df.select(F.col(key).alias("__k"), F.size(features).alias("n"), sketch(F.col(features)).alias("s"))
    words = [F.col("s")[w].alias(f"s{w}") for w in range(SKETCH_WORDS)]
    blocks = prefix_blocks(df, key, features, least).join(drawn, F.col(key) == F.col("__k"))
    blocks = materialize(blocks.select("block", F.col(key).alias("k"), "n", *words), "sketched-blocks")
    parts = F.ceil(F.count("*") / block_rows).cast("int").alias("parts")
    cut = blocks.join(blocks.groupBy("block").agg(parts), "block")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, for few bytes make much work here and AQE would merge them
    a = cut.withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).repartition(tasks, "block", "part").alias("a")
    b = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    allowed = (F.col("a.n") + F.col("b.n")) * (1 - least) + 1e-9
    apart = sum((F.bit_count(F.col(f"a.s{w}").bitwiseXOR(F.col(f"b.s{w}"))) for w in range(SKETCH_WORDS)), F.lit(0))
    near = (F.col("a.block") == F.col("b.block")) & (F.col("a.part") == F.col("b.part")) & (F.abs(F.col("a.n") - F.col("b.n")) <= allowed) & (apart <= allowed) & (F.col("a.k") < F.col("b.k"))
    return a.join(b, near).select(F.col("a.k").alias("src"), F.col("b.k").alias("dst")).distinct()


def cross_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """(plain, enc): every pair across two sides that shares a block, once."""
    left, right = a.select("block", F.col(key_a).alias("plain")), b.select("block", F.col(key_b).alias("enc"))
    return left.join(right, "block").select("plain", "enc").distinct()


def similarity_join(pairs: DataFrame, df: DataFrame, key: str, features: str, similarity: Callable[[Column, Column], Column], least: float) -> DataFrame:
    """(src, dst, sim) of candidate pairs with a similarity of at least `least`."""
    left = df.select(F.col(key).alias("src"), F.col(features).alias("__a"))
    right = df.select(F.col(key).alias("dst"), F.col(features).alias("__b"))
    return pairs.join(left, "src").join(right, "dst").select("src", "dst", similarity(F.col("__a"), F.col("__b")).alias("sim")).where(F.col("sim") >= least)


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two 0/1 arrays."""
    return 1.0 - F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x) / F.size(a)


def packed_signature(signature: Column) -> Column:
    """A 0/1 array as 64-bit words."""
    words = F.sequence(F.lit(0), F.ceil(F.size(signature) / 64).cast("int") - 1)
    push = lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long"))
    return F.transform(words, lambda w: F.aggregate(F.slice(signature, w * 64 + 1, 64), F.lit(0).cast("long"), push))


def cross_join_signatures(plain: DataFrame, enc: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(plain, enc, sim) of candidate pairs by their signatures, compared 64 bits at a time. plain, enc: node, signature."""
    a = plain.select(F.col("node").alias("plain"), packed_signature(F.col("signature")).alias("__a"), F.size("signature").alias("__n"))
    b = enc.select(F.col("node").alias("enc"), packed_signature(F.col("signature")).alias("__b"))
    apart = F.aggregate(F.zip_with("__a", "__b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "plain").join(b, "enc").select("plain", "enc", (1.0 - apart / F.col("__n")).alias("sim")).where(F.col("sim") >= least)


def edge_profile(edges: DataFrame, least: float) -> DataFrame:
    """(node, top, n_all, n_high): largest similarity, edges, and edges of at least `least` + 0.05."""
    both = edges.select(F.col("src").alias("node"), "sim").unionByName(edges.select(F.col("dst").alias("node"), "sim"))
    return both.groupBy("node").agg(F.max("sim").alias("top"), F.count("*").alias("n_all"), F.count(F.when(F.col("sim") >= least + 0.05, 1)).alias("n_high"))


def edge_tolerant(pairs: DataFrame, plain_edges: DataFrame, enc_edges: DataFrame, least: float, low: float = 0.01, up: float = 0.25) -> DataFrame:
    """Candidate pairs whose largest edges differ by -low to up and whose numbers of edges are compatible."""
    p, e = edge_profile(plain_edges, least), edge_profile(enc_edges, least)
    p = p.select(F.col("node").alias("plain"), F.col("top").alias("pt"), F.col("n_all").alias("pa"), F.col("n_high").alias("ph"))
    e = e.select(F.col("node").alias("enc"), F.col("top").alias("et"), F.col("n_all").alias("ea"), F.col("n_high").alias("eh"))
    gap = F.round(F.col("et") - F.col("pt"), 9)
    return pairs.join(p, "plain").join(e, "enc").where(gap.between(-low, up) & (F.col("ea") >= F.col("ph")) & (F.col("pa") >= F.col("eh"))).select("plain", "enc")


def edge_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst, sim_a, sim_b, side): edges of both graphs, or of one alone. Keys are made from both ends."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("sim").alias(name))

    both = keyed(a, "sim_a").join(keyed(b, "sim_b"), ["src", "dst"], "full_outer")
    side = F.when(F.col("sim_b").isNull(), "a").when(F.col("sim_a").isNull(), "b").otherwise("both")
    return both.withColumn("side", side)


def match_histogram(true_pairs: DataFrame, plain: DataFrame, enc: DataFrame, similarity: Callable[[Column, Column], Column], column: str, seed: int = 42) -> DataFrame:
    """(kind, bucket, n): similarities of true matches and of as many random non-matches, by 0.05.

    Random pairs: both sides numbered by a hash, equal numbers meet.
    """
    a = plain.select(F.col("node").alias("plain"), F.col(column).alias("__a"))
    b = enc.select(F.col("node").alias("enc"), F.col(column).alias("__b"))
    n = max(1, true_pairs.count())
    slot = lambda c, k: F.pmod(F.xxhash64(F.col(c), F.lit(seed + k)), F.lit(n))
    x = true_pairs.select("plain").distinct().select("plain", slot("plain", 0).alias("s"))
    y = true_pairs.select("enc").distinct().select("enc", slot("enc", 1).alias("s")).groupBy("s").agg(F.min("enc").alias("enc"))
    other = x.join(y, "s").select("plain", "enc").join(true_pairs, ["plain", "enc"], "left_anti")
    kinds = true_pairs.select("plain", "enc", F.lit("match").alias("kind")).unionByName(other.select("plain", "enc", F.lit("non-match").alias("kind")))
    sims = kinds.join(a, "plain").join(b, "enc").select("kind", similarity(F.col("__a"), F.col("__b")).alias("sim"))
    return sims.groupBy("kind", (F.floor(F.col("sim") * 20) / 20).alias("bucket")).agg(F.count("*").alias("n"))
