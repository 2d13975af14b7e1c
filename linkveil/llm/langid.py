"""Language identification by bit-sliced Bloom filters over n-grams (operator 7).

Training gathers, from labelled texts, how many texts of each language hold each hashed character n-gram. An n-gram is
put into the filters of the languages for which it is characteristic: its share of that language's texts is at least
`floor`, and at least `near` of its share in the language where it is most common. The filters of all languages lie in one
table, sliced by bits: entry p is a bitmask of the languages whose filter has bit p set, so that the AND of k entries
gives all languages that (probably) contain an n-gram at once; beyond 64 languages an entry has a word for every 64. The table
is as large as the fullest language's n-grams need for a false-positive rate of at most `false_rate`; every n-gram that
passes is put in. A text's n-grams are looked up, hits are counted per language, each count is corrected for that
filter's false positives, and the language with the most hits is taken.

Edge cases: a null text or one without a letter is `und` with score 0; null languages are not learned from; ties go to
the first language by name; a text whose n-grams are all unknown gets the most common language with score 0; without
training rows everything is `und`; repeated rows and null ids are predicted like any others; an empty table gives an
empty result; a very long text is predicted as a whole; lang, source and ids are never inputs of a prediction; other
columns are ignored. Whether a text has a letter is asked of Unicode's class L; n-grams run over WORDS, which hold number
signs such as fractions too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkveil.llm.common import small_batches, table
from linkveil.session import materialize

ORDERS = (1, 2, 3, 4)
#: Training texts that are taken at most, by a hash of the text (documented bound); all are taken below it.
MAX_TRAIN = 12_000
#: The table has at least 2 ** 20 entries (a megabyte for up to eight languages).
LEAST_BITS = 20
HASHES = 3
LETTER = regex.compile(r"\p{L}")
WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass
class Params:
    floor: float = 0.01
    near: float = 0.5
    false_rate: float = 0.01
    orders: tuple[int, ...] = ORDERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def cleaned(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts in a row, runs of non-letters read as one blank, and where each text starts."""
    clean = [" " + " ".join(WORDS.findall(t.lower())) + " " for t in texts]
    code = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return code, np.r_[0, np.cumsum([len(c) for c in clean])]


def hashed(code: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each order n, hashes of the n-grams from every position on; the last n - 1 of a text run over its end."""
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(orders) + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(1)
        if n in orders:
            yield n, mix(h ^ np.uint64(n << 56))


def text_grams(text: str, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Hashes of a text's n-grams, repeats included."""
    code, _ = cleaned([text])
    return np.concatenate([h for _, h in hashed(code, tuple(n for n in orders if n <= len(code)))])


def table_bits(n_grams: int, false_rate: float) -> int:
    """The bits of an entry's number: a filter of that many n-grams then reports others at false_rate at most."""
    fill = false_rate ** (1 / HASHES)
    return max(LEAST_BITS, math.ceil(math.log2(max(1.0, HASHES * n_grams / -math.log(1 - fill)))))


def entries(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The HASHES entries of n-grams in a table of 2 ** bits: slices of the hash, or multiples of its upper half added to it."""
    low = np.uint64((1 << bits) - 1)
    for k in range(HASHES):
        yield ((h >> np.uint64(k * bits)) if HASHES * bits <= 64 else h + np.uint64(k) * (h >> np.uint64(32) | np.uint64(1))) & low


@dataclass
class Filters:
    """The bit-sliced table and what it takes to read it."""

    languages: list[str]
    sliced: np.ndarray  # 2 ** bits masks of languages; (words, 2 ** bits) beyond 64 languages
    false: np.ndarray  # per language: the chance that an n-gram outside is reported
    common: int = 0  # the most common language
    orders: tuple[int, ...] = field(default=ORDERS)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that its k bits have in common."""
        out = None
        for at in entries(h, self.sliced.shape[-1].bit_length() - 1):
            found = self.sliced[..., at]
            out = found if out is None else out & found
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not known:
            return names, score
        code, starts = cleaned([texts[i] for i in known])
        hits, n_grams = np.zeros((len(known), len(self.languages))), np.zeros(len(known))
        for n, h in hashed(code, self.orders):
            masks = np.zeros((*self.sliced.shape[:-1], len(code)), self.sliced.dtype)
            masks[..., : len(h)] = self.masks(h)
            for back in range(1, n):
                masks[..., starts[1:] - back] = 0  # these would cross into the next text
            n_grams += np.maximum(np.diff(starts) - n + 1, 0)
            words = np.atleast_2d(masks)
            for k in range(len(self.languages)):
                own = (words[k // 64] >> masks.dtype.type(k % 64)) & masks.dtype.type(1)
                hits[:, k] += np.add.reduceat(own, starts[:-1], dtype=np.int64)
        true = np.maximum(hits - n_grams[:, None] * self.false, 0) / (1 - self.false)
        best = np.where(true.max(axis=1) > 0, true.argmax(axis=1), self.common)
        total = true.sum(axis=1)
        for row, i in enumerate(known):
            names[i] = self.languages[best[row]]
            score[i] = true[row, best[row]] / total[row] if total[row] else 0.0
        return names, np.clip(score, 0, 1)


def _text_counts(rows: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """(lang, gram, n): texts of the language with the n-gram; n-grams are counted once a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).to_pylist()
            for name in sorted(set(langs)):
                own = [np.unique(text_grams(t, orders)) for t, x in zip(b.column(1).to_pylist(), langs, strict=True) if x == name]
                gram, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
                )

    return rows.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, params: Params | None = None, max_train: int = MAX_TRAIN) -> Filters:
    """Filters learned from (text, lang) of docs; at most about max_train texts, taken by a hash of the text.

    Every language that is not null is learned: the bound is shared out evenly, and at least one text of each is taken.
    """
    params = params or Params()
    rows = docs.select("lang", "text").where("lang is not null and text is not null")
    order = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_000))
    kinds = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(order).alias("least")).collect()
    if not kinds:
        return Filters([], np.zeros(1, np.uint64), np.zeros(0))
    sizes = {r["lang"]: r["n"] for r in kinds}
    # the bound is shared out evenly: rare languages are taken whole
    each = max(1, max_train // len(sizes))
    below = [(r["lang"], max(min(1.0, each / r["n"]) * 1e6, r["least"] + 1.0)) for r in kinds]
    shares = docs.sparkSession.createDataFrame(below, "lang string, below double")
    taken = rows.join(F.broadcast(shares), "lang").where(order < F.col("below")).select("lang", "text").dropDuplicates(["lang", "text"])
    languages = sorted(sizes)
    with small_batches(docs.sparkSession):
        counts = materialize(_text_counts(taken, params.orders), "gram-counts")
    # every text with a letter holds the blank, so the largest count of a language is its number of texts
    totals = counts.groupBy("lang").agg(F.max("n").alias("total"))
    rated = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("p"))
    tops = rated.where(F.col("p") >= params.floor).groupBy("gram").agg(F.collect_list(F.struct("lang", "p")).alias("of"), F.max("p").alias("top"))
    # n-grams at home everywhere tell nothing; the rest is bounded by the texts that were taken
    telling = tops.select("gram", F.filter("of", lambda x: x["p"] >= params.near * F.col("top"))["lang"].alias("langs")).where(
        F.size("langs") < F.greatest(F.lit(2), F.lit(len(languages)))
    )
    chosen = telling.collect()
    kind = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
    words = -(-len(languages) // 64)
    at_word = {name: (k // 64, kind(1 << k % 64)) for k, name in enumerate(languages)}
    h = np.array([r["gram"] for r in chosen], dtype=np.int64).view(np.uint64)
    mask, held = np.zeros((words, len(chosen)), kind), dict.fromkeys(languages, 0)
    for i, r in enumerate(chosen):
        for x in r["langs"]:
            word, bit = at_word[x]
            mask[word, i] |= bit
            held[x] += 1
    bits = table_bits(max(held.values()), params.false_rate)
    sliced = np.zeros((words, 1 << bits), kind)  # as narrow as the languages allow: it should stay in a core's cache
    for at in entries(h, bits):
        for word in range(words):
            np.bitwise_or.at(sliced[word], at, mask[word])
    filled = np.array([np.mean((sliced[k // 64] >> kind(k % 64)) & kind(1)) for k in range(len(languages))])
    sliced = sliced if words > 1 else sliced[0]
    common = languages.index(max(sizes, key=lambda x: (sizes[x], x)))
    return Filters(languages, sliced, filled**HASHES, common, params.orders)


def identify(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # sized by the bounded training texts: 8 MB for every 64 languages and 80,000 n-grams of one
    names = list(keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            langs, score = [], []
            for first in range(0, len(texts), 100):
                got = shared.value.predict(texts[first : first + 100])
                langs += got[0]
                score.append(got[1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(names)], pa.array(langs, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))],
                names=[*names, "lang_pred", "score"],
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, text).mapInArrow(predict, f"{kinds}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, filters, ("doc_id", "held_out"))
