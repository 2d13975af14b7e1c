"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 3).

P(grade <= k | text) = sigmoid(t_k - w . x) with one weight vector shared by all grades and ordered thresholds
t_0 < t_1 < ...; x marks the hashed words of the text and hashed buckets of its shape (blanks, signs, repeats). The
expected grade is the sum of the tail probabilities P(grade >= k); documents whose top-grade tail probability reaches
`least` are kept. Grades of `labels`: 0 toxic, 1 low quality, 2 good.

The model is fitted on the driver from at most about max_fit labelled texts, taken by a hash of the id (a documented
bound); every whole text is scored in one pass without a shuffle.

Edge cases: null and empty texts have their shape alone; a very long text is read whole and counts like any other, for a
feature is there or not; a tail probability equal to `least` keeps; rows of equal features are fitted in any order; null ratings are not learned from; the lowest of several grades
of an id counts; without ratings every document has the expected grade 0, tail probability 0 and is kept; repeated
rows and null ids are scored like any others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkveil.llm.common import small_batches, table

BITS = 18
MAX_FIT = 12_000
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
CAPITALS = bytes(range(65, 91))


@dataclass
class Model:
    """thresholds (ascending) and weights of 2 ** BITS hashed features."""

    thresholds: np.ndarray
    weights: np.ndarray

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... by column."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -30, 30)))


def features(text: bytes | None) -> np.ndarray:
    """The distinct hashed features of a UTF-8 text."""
    raw = text or b""
    words = WORD.findall(raw.lower())
    kinds = set(words)
    n = max(1, len(raw.split()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = len(raw) - len(raw.translate(None, CAPITALS))
    shape = {
        "words": math.log2(n),
        "kinds": 10 * len(kinds) / max(1, len(words)),
        "signs": 4 * min(2.0, sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">"))) / n),
        "bars": 8 * min(1.0, raw.count(b"|") / n),
        "shouts": 8 * min(1.0, raw.count(b"!") / n),
        "upper": 4 * min(2.0, upper / n),
        "lines": 8 * (len(lines) - len(set(lines))) / max(1, len(lines)),
        "length": min(12.0, len(raw) / n),
    }
    crc, mask = zlib.crc32, (1 << BITS) - 1
    out = {crc(w) & mask for w in kinds}
    out.update({crc(w, 2) & mask for w in {w[:6] for w in kinds}})  # beginnings, for words of many endings
    out.update(crc(f"{k}={math.ceil(v)}".encode(), 1) & mask for k, v in shape.items())
    return np.fromiter(out, dtype=np.int32, count=len(out))


def bounds_of(t: np.ndarray) -> np.ndarray:
    """Thresholds from a first one and the logarithms of the gaps, so that they keep their order."""
    return np.r_[t[0], t[0] + np.cumsum(np.exp(t[1:]))]


def loss_and_gradient(w: np.ndarray, t: np.ndarray, of: np.ndarray, column: np.ndarray, grades: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Mean of -log P(grade) plus the penalty on w, and its gradient by w and t. Text of[i] has feature column[i]."""
    n, top, rows = len(grades), len(t), np.arange(len(grades))
    margin = np.bincount(of, weights=w[column], minlength=n)
    below = 1 / (1 + np.exp(np.clip(margin[:, None] - bounds_of(t)[None, :], -30, 30)))  # P(grade <= k)
    full = np.c_[np.zeros(n), below, np.ones(n)]
    p = np.maximum(full[rows, grades + 1] - full[rows, grades], 1e-9)
    slope = full * (1 - full)
    high, low = slope[rows, grades + 1], slope[rows, grades]
    pull = (high - low) / p  # derivative of -log p by the margin
    g_w = np.bincount(column, weights=pull[of], minlength=len(w)) / n + penalty * w
    g_b = np.array([-(np.sum(high[grades == k] / p[grades == k]) - np.sum(low[grades == k + 1] / p[grades == k + 1])) / n for k in range(top)])
    later = np.cumsum(g_b[::-1])[::-1]
    return float(-np.log(p).mean() + penalty * (w @ w) / 2), np.r_[g_w, later[0], later[1:] * np.exp(t[1:])]


def fit_model(lists: list[np.ndarray], grades: np.ndarray, rounds: int = 120, penalty: float = 1e-3, least_texts: int = 6) -> Model:
    """Maximum likelihood with an L2 penalty by Adam over the whole sample; features of fewer than least_texts texts stay 0."""
    top = int(grades.max()) if len(grades) else 0
    weights = np.zeros(1 << BITS, np.float32)
    if not top:
        return Model(np.zeros(0), weights)
    flat = np.concatenate(lists)
    sizes = np.array([len(x) for x in lists])
    seen = np.bincount(flat, minlength=1 << BITS)
    known = np.flatnonzero(seen >= least_texts)
    to = np.full(1 << BITS, -1, np.int32)
    to[known] = np.arange(len(known), dtype=np.int32)
    of = np.repeat(np.arange(len(lists), dtype=np.int32), sizes)
    column = to[flat]
    of, column = of[column >= 0], column[column >= 0]
    w = np.zeros(len(known))
    share = np.array([np.mean(grades <= k) for k in range(top)])
    start = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    t = np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    step, m, v = 0.05, np.zeros(len(w) + top), np.zeros(len(w) + top)
    for i in range(1, rounds + 1):
        _, g = loss_and_gradient(w, t, of, column, grades, penalty)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        w, t = w - move[: len(w)], t - move[len(w) :]
    weights[known] = w
    return Model(bounds_of(t), weights)


def graded(labels: DataFrame, max_fit: int) -> DataFrame:
    """(__id, __grade) of at most about max_fit rated ids."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2)
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min(grade).alias("__grade"))
    n = rated.count()
    if n > max_fit:
        rated = rated.where(F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1_000_000)) < int(1e6 * max_fit / n))
    return rated


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """A model from the texts of rated ids."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [features(t.as_py()) for t in b.column(1)]
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32))
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["grade", "features"])

    rated = graded(labels, max_fit)  # max_fit bounds it
    few = docs.select("doc_id", "text").join(F.broadcast(rated), F.col("doc_id") == F.col("__id"))
    with small_batches(docs.sparkSession):
        got = few.select("__grade", F.col("text").cast("binary")).mapInArrow(extract, "grade int, features array<int>").toArrow()
    if not got.num_rows:
        return Model(np.zeros(0), np.zeros(1 << BITS, np.float32))
    grades = got.column("grade").to_numpy().astype(np.int64)
    lists = [x for chunk in got.column("features").chunks for x in np.split(chunk.flatten().to_numpy(), (chunk.offsets.to_numpy() - chunk.offsets[0].as_py())[1:-1])]
    order = np.lexsort([[len(x) for x in lists], [int(x.sum()) for x in lists], grades])  # rows come in any order
    return fit_model([lists[i] for i in order], grades[order])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, expected_grade, p_top, kept) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB at any input size

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            margin = np.fromiter((m.weights[features(t.as_py())].sum(dtype=np.float64) for t in b.column(1)), dtype=float, count=b.num_rows)
            tails = m.tails(margin)
            p = tails[:, -1] if tails.shape[1] else np.zeros(len(margin))
            kept = p >= least if tails.shape[1] else np.ones(len(margin), bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(p), pa.array(kept)], names=[key, "expected_grade", "p_top", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(per_batch, f"`{key}` {kind}, expected_grade double, p_top double, kept boolean")


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
