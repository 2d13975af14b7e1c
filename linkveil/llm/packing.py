"""Packing into optimal length buckets (operator 6).

Texts are measured in tokens (with the end id); longer ones than max_len go in pieces of max_len. One global histogram
of piece lengths (at most max_len entries) goes to the driver, where dynamic programming over it chooses the bucket
boundaries with the least padding. Inside a bucket of length b, batches of floor(budget / b) pieces form, in the order
of a hash of the document, numbered without gathering a bucket in one task.

Edge cases: null and empty texts are one piece of one token (the end id); repeated rows are pieces of their own; null
ids are carried along and ordered by a row number; equal hashes are ordered by id and piece; a very long text is cut into
pieces like any other; fewer distinct lengths than buckets give fewer buckets; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkveil.llm.common import gapless, small_batches, table
from linkveil.llm.tokens import encoder, tokenizer_path
from linkveil.session import materialize

MAX_LEN = 4096
BUCKETS = 12
BUDGET = 65_536
#: Pieces and words that a worker keeps: few, for workers live on through the stages of a pipeline.
KEPT = 400_000


def token_counts(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", kept: int = KEPT) -> DataFrame:
    """(key, n_tokens) of whole texts, the end id included."""
    at = tokenizer or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(at, kept).encode
        for b in batches:
            n = np.fromiter((len(encode(t.as_py())) // 4 + 1 for t in b.column(1)), dtype=np.int64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=[key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(count, f"`{key}` {kind}, n_tokens bigint")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The at most `buckets` lengths to pad to, ascending, with the least padding over the histogram (lengths ascending)."""
    n = len(lengths)
    if not n:
        return []
    size = np.array(lengths, dtype=np.int64)
    count = np.r_[0, np.cumsum(np.array(counts, dtype=np.int64))]
    total = np.r_[0, np.cumsum(size * np.array(counts, dtype=np.int64))]
    far = np.iinfo(np.int64).max // 4
    cost = np.full(n + 1, far)  # cost[j]: least padding of the first j lengths with the buckets so far
    cost[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            pad = cost[:j] + size[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
            cut[j] = i = int(np.argmin(pad))
            new[j] = pad[i]
        cost = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        out.append(int(size[j - 1]))
        j = int(cut[j])
        if not j:
            break
    return out[::-1]


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, kept: int = KEPT,
) -> DataFrame:
    """(key, piece, n_tokens, bucket_len, batch, place, padding): every piece's batch in its bucket and place in that batch."""
    whole = token_counts(docs, tokenizer, key, text, kept)
    starts = F.sequence(F.lit(0), (F.col("n_tokens") - 1).cast("int"), F.lit(max_len))
    cut = whole.select(key, "n_tokens", F.posexplode(starts).alias("piece", "at"))
    length = F.least(F.col("n_tokens") - F.col("at"), F.lit(max_len)).cast("int")
    with small_batches(docs.sparkSession):
        # rows without an id are told apart by a number, or all of one length would share a hash and a cell
        row = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("__row")
        pieces = materialize(cut.select(key, "piece", length.alias("n_tokens"), row), "pieces")
    histogram = sorted((r["n_tokens"], r["count"]) for r in pieces.groupBy("n_tokens").count().collect())  # max_len rows at most
    bounds = best_boundaries([x for x, _ in histogram], [c for _, c in histogram], buckets)
    to = F.lit(max_len)
    for b in reversed(bounds):
        to = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(to)
    placed = gapless(
        pieces.withColumn("bucket_len", to), ["bucket_len"], F.xxhash64(F.col(key).cast("string"), "piece", "n_tokens", "__row"), [key, "piece", "__row"], "__slot"
    )
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("long")
    return placed.select(
        key,
        "piece",
        "n_tokens",
        "bucket_len",
        F.expr("__slot").alias("__slot"),
        each.alias("__each"),
    ).select(
        key,
        "piece",
        "n_tokens",
        "bucket_len",
        F.expr("__slot div __each").alias("batch"),
        (F.col("__slot") % F.col("__each")).alias("place"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes; pieces tell batches of the training run."""
    return pack(docs)
