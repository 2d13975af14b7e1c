"""SimHash near-duplicates by bit-sliced comparison (operator 1).

Fingerprints: 64 bits; a bit is set where over half the XXH64 hashes of the text's word shingles have it set.
Distinct fingerprints link at a Hamming distance of at most `radius`. A pair within 3 bits agrees on at least two
of five bit blocks, so ten tables of 25-26 key bits hold every such pair in a common bucket. Buckets with one
fingerprint go before anything is compared; a bucket over `block` fingerprints is cut into blocks, and each pair of
blocks is a cell of its own, so no task holds more than two blocks at a time. Inside a cell, bit planes lie
vertically, one bit per row in 64-bit words; for each shift s the planes are XORed with themselves shifted by s
rows, all distances grow at once in carry-save counters, and words whose lanes are all beyond the radius are
abandoned after every eight planes. A cell emits a spanning forest of its links (lanes that are already joined are
dead), never all pairs. Components come from the engine's connected-components operator.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; equal texts and repeated
rows share a fingerprint; a null doc_id is carried along and never names a component unless all its members are
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkveil.llm.common import small_batches, table
from linkveil.operators.components import connected_components
from linkveil.session import materialize

RADIUS = 3
BLOCK = 4096
SEED = 42
#: (first bit, bits) of the five blocks.
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
ROWS_AT_ONCE = 16_384


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()  # of bytes: A-Z alone, and the blanks \x20 \x09-\x0D alone
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
    hash_ = xxhash.xxh64_intdigest
    h = np.fromiter((hash_(s, SEED) for s in shingles), dtype="<u8", count=max(1, len(words) - width + 1))
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_280):
        part = h[at : at + 65_280]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        # sums of 255 rows fit a byte, and adding bytes is the fastest there is
        total += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp long) of every whole text."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(per_batch, f"`{key}` {kind}, fp bigint")


def table_keys(fp: Column) -> Column:
    """The ten table keys: table number above the bits of two blocks."""
    part = lambda k: F.shiftrightunsigned(fp, PARTS[k][0]).bitwiseAND((1 << PARTS[k][1]) - 1)
    return F.array(*[
        F.lit(t << 26) + F.shiftleft(part(i), 13) + part(j) for t, (i, j) in enumerate(combinations(range(5), 2))
    ])


def cells(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, x, y, fp): the rows of each cell. Buckets of one are gone; larger ones than block come as pairs of blocks."""
    keyed = fps.select("fp", F.explode(table_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    return (
        keyed.join(sizes, F.col("key") == F.col("k"))
        .select("key", "fp", parts.alias("parts"))
        .select("key", "fp", mine.alias("m"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
        .select("key", F.least("m", "o").alias("x"), F.greatest("m", "o").alias("y"), "fp")
    )


def _planes(fp: np.ndarray, pad: int) -> np.ndarray:
    """(64, words + pad): plane p holds bit p of every row."""
    words = -(-len(fp) // 64)
    bits = np.zeros((64, (words + pad) * 64), np.uint8)
    bits[:, : len(fp)] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def near_lanes(planes: np.ndarray, valid: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Rows i for which valid holds and rows i and i + shift differ in at most radius bits."""
    words = -(-len(valid) // 64)
    lanes = np.zeros(words * 64, np.uint8)
    lanes[: len(valid)] = valid
    live = np.packbits(lanes, bitorder="little").view("<u8")
    at = np.flatnonzero(live)
    if not len(at):
        return at
    live, (up, r) = live[at], divmod(shift, 64)
    other = planes[:, at + up] >> np.uint64(r)
    if r:
        other |= planes[:, at + up + 1] << np.uint64(64 - r)
    other ^= planes[:, at]
    depth = max(1, radius.bit_length())
    start = (1 << depth) - 1 - radius  # so that the counter runs over just beyond the radius
    counter = [np.full(len(at), ~np.uint64(0) if start >> k & 1 else np.uint64(0)) for k in range(depth)]
    over = np.zeros(len(at), np.uint64)
    for first in range(0, 64, 8):
        for p in range(first, first + 8):
            carry = other[p]
            for k in range(depth):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
        live &= ~over
        some = live != 0
        n = int(some.sum())
        if not n:
            return np.empty(0, np.int64)
        if n < 0.6 * len(some):  # abandon the blocks of 64 lanes that hold no pair any more
            at, live, over, other = at[some], live[some], over[some], other[:, some]
            counter = [c[some] for c in counter]
    hit = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    return (at[:, None] * 64 + np.arange(64))[hit]


def forest(fp: np.ndarray, end: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows grouped in cells (end: where the row's cell ends), the first row of the linked set that each row is in."""
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label
    left = end - np.arange(n)
    longest = int(left.max()) - 1
    planes = _planes(fp, longest // 64 + 2)
    parent = label.copy()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for s in range(1, longest + 1):
        valid = (left[: n - s] > s) & (label[: n - s] != label[s:])
        if not valid.any():
            if not (left > s).any() or not (label != label[np.maximum(end - 1, 0)]).any():
                break
            continue
        joined = False
        for i in near_lanes(planes, valid, s, radius):
            a, b = root(int(label[i])), root(int(label[i + s]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                joined = True
        if joined:
            while not np.array_equal(up := parent[parent], parent):
                parent[:] = up
            label = parent[label]
    return label


def links(cell_rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst): a spanning forest of the links in every cell. Rows of a cell must lie together in a partition."""

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, x, y, fp = cols
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        sizes = np.diff(np.r_[new, len(key)])
        label = forest(fp.view(np.uint64), np.repeat(new + sizes, sizes), radius)
        own = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(fp[label[own]]), pa.array(fp[own])], names=["src", "dst"])

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            rows += b.num_rows
            if rows < ROWS_AT_ONCE:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.argmax(same))  # the last cell may go on in the next batch
            if cut:
                yield solve([c[:cut] for c in cols])
            held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if rows:
            yield solve([np.concatenate(c) for c in zip(*held, strict=True)])

    dealt = cell_rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(per_partition, "src bigint, dst bigint")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable by links, the row's own included."""
    if not 0 <= radius <= 3:
        raise ValueError("the ten tables are complete up to a radius of 3")
    with small_batches(docs.sparkSession):
        marked = materialize(fingerprints(docs, key, text, width), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min(key).alias("__first"), F.count("*").alias("__rows")), "distinct-fingerprints")
    found = materialize(links(cells(fps.select("fp"), block), radius), "links")
    comps = materialize(connected_components(found), "components")
    members = fps.join(comps, F.col("fp") == F.col("node")).select("fp", "component", "__first")
    firsts = members.groupBy(F.col("component").alias("__c")).agg(F.min("__first").alias("__least"))
    mapped = members.join(firsts, F.col("component") == F.col("__c")).select(F.col("fp").alias("__fp"), "__least")
    least = F.when(F.col("__fp").isNull(), F.col("__first")).otherwise(F.col("__least"))
    named = fps.join(mapped, F.col("fp") == F.col("__fp"), "left").select(F.col("fp").alias("__f"), least.alias("component_id"), "__rows")
    named = materialize(named, "named-fingerprints")
    # fingerprints of over a thousandth of all rows are fewer than a thousand: they are broadcast, and no task gets one of them whole
    many = marked.count() / 1000
    hot = F.broadcast(named.where(F.col("__rows") > many))
    of_hot = marked.join(hot, F.col("fp") == F.col("__f"))
    rest = marked.join(hot.select("__f"), F.col("fp") == F.col("__f"), "left_anti").join(named.where(F.col("__rows") <= many), F.col("fp") == F.col("__f"), "left")
    return of_hot.select(key, "fp", "component_id").unionByName(rest.select(key, "fp", "component_id"))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that with the smallest doc_id; of repeated rows of it, or of rows without an id, one."""
    groups = materialize(near_duplicates(docs), "near-duplicates")
    odd = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    names = docs.columns
    if odd.isEmpty():
        gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
        return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti").select(*names)
    # an id of several rows names several components, or none: rows are told apart by a number of their own
    rows = materialize(docs.select(*names, F.monotonically_increasing_id().alias("__n")), "numbered-rows")
    of = near_duplicates(rows.select("__n", "text"), key="__n").select(F.col("__n").alias("__m"), "fp", "component_id")
    own = rows.select("__n", "doc_id").join(of, F.col("__n") == F.col("__m"))
    first = own.groupBy("component_id").agg(F.min_by("__n", F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "__n")).alias("__first"))
    return rows.join(first, F.col("__n") == F.col("__first"), "left_semi").select(*names)
