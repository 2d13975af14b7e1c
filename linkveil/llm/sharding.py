"""Sharding by k-d tree partitioning (operator 2), DataFrame functions only.

A node that must yield k shards is cut along its widest metadata dimension (the one on which its rows span the
largest part of the whole table's range; ties go to the first) at the weighted quantile floor(k/2)/k, a median for
even k, with sizes as weights. Quantiles are exact: distributed histograms of 4096 bins narrow down on the value until
one row is left in its bin. A value's low 40 bits are a hash of the document, so ties (a source that holds a third of all
rows) are cut too. All nodes of a level share each pass; the tree ends at 16 leaves or where leaves reach the target.

A cut is off by at most half the size of the one row at it, so a shard of 16 (four cuts) differs from the even share by
less than the largest document. Equal texts are no groups to a k-d tree: the contract's "groups: equal texts" names what a
method that keeps groups together would keep. Here copies are rows like any others and may part, so that a group of copies
that holds a third of all rows is spread over shards as near to equal as any.

Edge cases: null texts have no bytes (size 1); null metadata is a value of its own; null ids are told apart by row;
repeated rows (equal id and text) fall into one shard; tied values part by the hash; a very long text is one row of its
size; with fewer rows than shards some shards stay empty; an empty table gives an empty result; other columns are ignored
by `assign`; `write_shards` writes every row once, repeated ids or null ones too, and its own columns `shard` and `slot`:
columns of docs of these names get `doc_` before theirs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkveil.llm.common import gapless, spread, table
from linkveil.session import materialize

TIE_BITS = 40
BINS = 4096


@dataclass
class Node:
    """A node of the tree: shards first .. first + k - 1; cut at value of dimension (<= goes left) unless it is a leaf."""

    first: int
    k: int
    dimension: str | None = None
    value: int = 0
    left: Node | None = None
    right: Node | None = None

    def shard(self) -> Column:
        if self.dimension is None:
            return F.lit(self.first)
        return F.when(F.col(self.dimension) <= F.lit(self.value), self.left.shard()).otherwise(self.right.shard())

    def leaves(self) -> list[Node]:
        return [self] if self.dimension is None else self.left.leaves() + self.right.leaves()


def metadata(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(key, keep columns, size, text_crc32, one long per dimension): the value's 20 bits above 40 bits of hash."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    row = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    tie = spread(TIE_BITS, F.col(key).cast("string"), crc, row)
    by = {f"d_{c}": spread(20, F.col(c)) for c in ("source", "lang") if c in docs.columns}
    by["d_length"] = F.least(F.floor(F.log2(size.cast("double")) * 32768), F.lit((1 << 20) - 1)).cast("long")
    dims = {n: F.shiftleft(v, TIE_BITS) + tie for n, v in by.items()}
    return docs.select(key, *keep, size.alias("size"), crc.alias("text_crc32"), *[v.alias(n) for n, v in dims.items()]), list(dims)


def _quantiles(rows: DataFrame, want: dict[int, tuple[str, float, int, int]]) -> dict[int, int]:
    """By node (its first shard): the value at which the weight up to it is nearest to the weight wanted.

    want: dimension, weight, least and largest value. rows: __node, size and the dimensions.
    """
    open_, done = {n: [d, w, lo, hi, 0] for n, (d, w, lo, hi) in want.items()}, {}
    while open_:
        step = {n: max(1, -(-(hi - lo + 1) // BINS)) for n, (_, _, lo, hi, _) in open_.items()}
        bins = F.lit(None).cast("long")
        for n, (d, _, lo, hi, _) in open_.items():
            inside = (F.col("__node") == n) & F.col(d).between(lo, hi)
            bins = F.when(inside, F.expr(f"(`{d}` - {lo}L) div {step[n]}L")).otherwise(bins)
        got = (
            rows.select("__node", "size", bins.alias("__bin"))
            .where("__bin is not null")
            .groupBy("__node", "__bin")
            .agg(F.sum("size").alias("w"), F.count("*").alias("n"))
            .collect()
        )
        for n, (d, w, lo, hi, before) in list(open_.items()):
            mine = sorted((r["__bin"], r["w"], r["n"]) for r in got if r["__node"] == n)
            for b, weight, count in mine:
                if before + weight >= w or b == mine[-1][0]:
                    start = lo + b * step[n]
                    end = min(hi, start + step[n] - 1)
                    if count == 1 or step[n] == 1:
                        # the last row goes to the side that it brings nearer to what is wanted
                        done[n] = end if abs(before + weight - w) <= abs(w - before) else start - 1
                        del open_[n]
                    else:
                        open_[n] = [d, w, start, end, before]
                    break
                before += weight
            else:
                done[n] = lo
                del open_[n]
    return done


def grow(rows: DataFrame, dims: list[str], n_shards: int) -> Node:
    """The tree over a table of metadata."""
    root = Node(0, n_shards)
    whole: dict[str, int] = {}
    while front := [x for x in root.leaves() if x.k > 1]:
        marked = rows.withColumn("__node", root.shard())
        stats = {
            r["__node"]: r
            for r in marked.groupBy("__node")
            .agg(F.sum("size").alias("w"), *[f(d).alias(f"{p}{d}") for d in dims for p, f in (("lo_", F.min), ("hi_", F.max))])
            .collect()
        }
        if not whole:
            r = stats.get(0)
            whole = {d: max(1, (r[f"hi_{d}"] >> TIE_BITS) - (r[f"lo_{d}"] >> TIE_BITS)) if r else 1 for d in dims}
        want = {}
        for x in front:
            if r := stats.get(x.first):
                wide = {d: ((r[f"hi_{d}"] >> TIE_BITS) - (r[f"lo_{d}"] >> TIE_BITS)) / whole[d] for d in dims}
                d = max(dims, key=lambda d: wide[d])
                want[x.first] = (d, r["w"] * (x.k // 2) / x.k, r[f"lo_{d}"], r[f"hi_{d}"])
        at = _quantiles(marked, want)
        for x in front:
            x.dimension = want[x.first][0] if x.first in want else dims[0]
            x.value = at.get(x.first, 0)
            x.left, x.right = Node(x.first, x.k // 2), Node(x.first + x.k // 2, x.k - x.k // 2)
    return root


def assign(
    docs: DataFrame, n_shards: int | None = 16, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, keep columns, size, text_crc32, shard, slot): into n_shards shards, or as many as leaves of target_bytes take."""
    rows, dims = metadata(docs, key, text, keep)
    rows = materialize(rows, "metadata")
    if target_bytes:
        n_shards = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    tree = grow(rows, dims, n_shards)
    # the low bits of any dimension are the document's hash; they order slots
    placed = rows.select(key, *keep, "size", "text_crc32", tree.shard().cast("int").alias("shard"), F.shiftleft(F.col(dims[0]), 64 - TIE_BITS).alias("__o"))
    return gapless(placed, ["shard"], F.col("__o"), [key, "text_crc32"]).drop("__o")


def write_shards(
    docs: DataFrame, path: str, n_shards: int | None = 16, target_bytes: int | None = None, key: str = "doc_id", text: str = "text"
) -> None:
    """Writes docs as Parquet, a folder per shard, rows in slot order within each file."""
    names = {c: c for c in docs.columns}
    for c in ("shard", "slot"):
        if c in names:
            while names[c] in docs.columns:
                names[c] = f"doc_{names[c]}"
    # rows are told apart by a number of their own, fixed by a table: ids may repeat or be null
    rows = materialize(docs.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("__doc"), F.monotonically_increasing_id().alias("__row")), "numbered-rows")
    fields = [F.col("__doc")[names[c]].alias(c) for c in dict.fromkeys((key, text, *[c for c in ("source", "lang") if c in names]))]
    at = assign(rows.select("__row", *fields), n_shards, target_bytes, key, text, keep=("__row",)).select(F.col("__row").alias("__at"), "shard", "slot")
    placed = rows.join(at, F.col("__row") == F.col("__at")).select("__doc.*", "shard", "slot")
    placed.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
