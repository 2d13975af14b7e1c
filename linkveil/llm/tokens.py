"""Token-id output as ORC (operator 5), and the tokenizer that packing shares.

Documents are dealt by ranges of doc_id, encoded after that shuffle (text moves, not ids), and written by Spark's ORC
writer: id lists run-length encoded as integers, a row index for every `stride` rows, Bloom filters on doc_id, one
file per range in ascending order. Each row also holds the ids before it in its file, so a reader needs one sum per
file to know any document's place; stripes are read in parallel and pruned by doc_id.

A tokenizer whose file says that it drops white space and never joins across it gives a text the ids of its words in a
row; words repeat, and their ids are kept in a bounded cache. That is read from the tokenizer's file; any other tokenizer
gets whole texts.

Edge cases: null texts count as empty and hold the end id alone; null ids come first; rows with equal ids keep the
order of their file; a very long text is one row and one list of ids; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkveil.llm.common import sized, small_batches, table
from linkveil.session import materialize, new_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


#: Texts of these characters alone are normalised by lower-casing: ASCII without controls but blanks, and the Latin-1 letters.
PLAIN = re.compile("[\x09-\x0d\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: What the tokenizer splits such a text into, once it is lower-cased (a fixed value of its file).
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: The byte alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = [chr(b) if b in SHOWN else chr(256 + sum(x not in SHOWN for x in range(b))) for b in range(256)]


#: What a tokenizer's file must say for the two lines above to hold (fixed values of the file).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(file: dict) -> bool:
    """Does a tokenizer's file say that ids are those of blank-separated pieces, split and lower-cased as stated here?

    Added tokens that take blanks around them, or match normalised text or single words alone, could reach across pieces.
    """
    plain = not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or re.search(r"\s", t["content"]) for t in file["added_tokens"])
    idle = not any(file.get(k) for k in ("truncation", "padding", "post_processor"))
    return file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == PRE_TOKENIZER and plain and idle and not file["model"].get("dropout")


class Words(dict):
    """The ids of a lower-cased word, from the tokenizer's model where they are not yet known."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize

    def __missing__(self, word: str) -> bytes:
        tokens = self.tokenize(word if word.isascii() else "".join(ALPHABET[b] for b in word.encode()))
        found = self[word] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return found


class PieceEncoder:
    """encode(text): its ids as little-endian 32-bit bytes.

    Ids are looked up by blank-separated piece, in a cache of at most `most` pieces of up to 64 bytes. A new piece of plain
    characters is put together from its words, which the tokenizer's model gives once each while they are in a second
    cache of that size; other new pieces go through the whole tokenizer. A tokenizer that does not work by words encodes whole
    texts.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.pieces = Tokenizer.from_file(path), most, {}
        self.whole = not by_words(json.loads(self.tokenizer.to_str()))
        self.words, self.marks = Words(self.tokenizer.model), [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: bytes | None) -> bytes:
        if self.whole:
            ids = self.tokenizer.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        parts = (text or b"").split()
        got = list(map(self.pieces.get, parts))
        if None in got:
            ids = self._new({p for p, x in zip(parts, got, strict=True) if x is None})
            got = [ids[p] if x is None else x for p, x in zip(parts, got, strict=True)]
            if len(self.pieces) + len(ids) > self.most:
                self.pieces.clear()
            self.pieces.update((p, x) for p, x in ids.items() if len(p) <= 64)
        return b"".join(got)

    def _new(self, parts: set[bytes]) -> dict[bytes, bytes]:
        order = list(parts)
        text = b" ".join(order).decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and not any(m in text for m in self.marks):
            return self._plain(order, text)
        plain = [p for p in order if PLAIN.fullmatch(t := p.decode("utf-8", "replace")) and not any(m in t for m in self.marks)]
        return self._plain(plain, b" ".join(plain).decode()) | self._encode(parts.difference(plain))

    def _plain(self, parts: list[bytes], text: str) -> dict[bytes, bytes]:
        of, words = self.words.__getitem__, SPLIT.findall
        if len(self.words) > self.most:
            self.words.clear()
        return {p: b"".join(map(of, words(t))) for p, t in zip(parts, text.lower().split(" "), strict=True)} if parts else {}

    def _encode(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Each piece's ids: all go through the tokenizer as one text, and offsets tell whose each id is."""
        if not pieces:
            return {}
        new = list(pieces)
        text = [p.decode("utf-8", "replace") for p in new]
        done = self.tokenizer.encode(" ".join(text), add_special_tokens=False)
        start = np.cumsum([0] + [len(t) + 1 for t in text])
        at = np.fromiter((a for a, _ in done.offsets), dtype=np.int64, count=len(done.ids))
        cuts = np.searchsorted(at, start) * 4
        flat = np.array(done.ids, dtype="<u4").tobytes()
        return {p: flat[i:j] for p, i, j in zip(new, cuts[:-1], cuts[1:], strict=True)}


@functools.cache
def encoder(path: str, most: int = 1_000_000) -> PieceEncoder:
    """One per worker process and size."""
    return PieceEncoder(path, most)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_orc(
    docs: DataFrame, path: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID, stride: int = 1000
) -> None:
    """Writes (key, before, ids): the document's ids with the end id, and how many ids stand before it in its file."""
    at = tokenizer or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(at).encode, 0
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                ids = [encode(t.as_py()) + end for t in part.column(1)]
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])]
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(before + offsets[:-1]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
                    names=[key, "before", "ids"],
                )
                before += int(offsets[-1])

    kind = docs.schema[key].dataType.simpleString()
    dealt = docs.select(key, F.col(text).cast("binary")).repartitionByRange(key).sortWithinPartitions(key)
    rows = dealt.mapInArrow(per_partition, f"`{key}` {kind}, before bigint, ids array<int>")
    bloom = {"orc.bloom.filter.columns": key, "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(stride)}
    with small_batches(docs.sparkSession):
        # one file for each range, whatever the session says: `before` counts from the start of its file
        rows.write.options(**bloom, compression="zstd", maxRecordsPerFile=0).orc(path)


def read_orc(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files; a filter on key prunes stripes."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["file", key, "before", "n_tokens", "ids_crc32"],
            )

    files = spark.read.orc(path)
    kind = files.schema[key].dataType.simpleString()
    rows = files.select(F.col("_metadata.file_name").alias("file"), key, "before", "ids").mapInArrow(
        digest, f"file string, `{key}` {kind}, before bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return rows


def file_starts(files: DataFrame) -> DataFrame:
    """(f, base): how many ids the files before hold. files: f, n and least, the least key of the range (null ids come first).

    Ranges do not overlap, so their least keys put files in order, whatever their names. One row per file.
    """
    earlier = Window.orderBy(F.asc_nulls_first("least")).rowsBetween(Window.unboundedPreceding, -1)
    return files.select("f", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))


def token_table(docs: DataFrame, path: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs as ORC at path and returns (key, start, n_tokens, ids_crc32) as read back."""
    spark = docs.sparkSession
    write_orc(docs, path, tokenizer, key, text)
    with small_batches(spark):
        rows = materialize(read_orc(spark, path, key), "token-rows")
    least = F.when(F.count("*") == F.count(key), F.min(key))  # null where the file holds null ids
    bases = file_starts(rows.groupBy(F.col("file").alias("f")).agg(F.sum("n_tokens").alias("n"), least.alias("least")))
    joined = rows.join(sized(bases, 100_000), F.col("file") == F.col("f"))
    return joined.select(key, (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"), new_path(spark, "tokens-orc"))
