import zlib

import numpy as np
import pytest

from linkveil.llm import tokens as q
from linkveil.session import new_path
from tests.llm import common as c

tokenizers = pytest.importorskip("tokenizers")


def direct(name=q.TOKENIZER):
    return tokenizers.Tokenizer.from_file(q.tokenizer_path(name))


def check(spark, docs, name=q.TOKENIZER):
    t, want, start = direct(name), [], 0
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = q.token_table(docs, new_path(spark, "t"), q.tokenizer_path(name)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_documents_round_trip(spark):
    check(spark, c.documents(spark))


def test_awkward_rows(spark):
    docs = c.awkward(spark)
    check(spark, docs)
    assert q.token_table(c.empty(spark), new_path(spark, "t")).count() == 0


def test_pieces_give_the_ids_of_whole_texts():
    e, t = q.PieceEncoder(q.tokenizer_path(), most=50), direct()
    docs = [r[0] for r in __import__("duckdb").sql(f"SELECT text FROM read_parquet('{c.SF}/documents.parquet')").fetchall()]
    every = "".join(map(chr, range(1, 256)))
    for text in [
        *docs, every, every[8:], " ".join(every), "-".join(every), every[31:126] + every[191:], "'S it's 'RE we'RE'ved 'lld", "don't<|endoftext|>x", "n<|x",
        "It's DON'T we'll  x y z　w", "<|endoftext|>a <|startoftext|> <|endoftext|", "é ́x cafés", "İstanbul ΣΑΣ ß ﬁ", "a" * 500 + " 12345,67!?",
        "tab\tnew\nline\x0bvt\x0cff\x1cfs\x85nel", "🎉👨‍👩‍👧 zwj‍x", "", "   ", "﻿bom", *[r[1] or "" for r in c.awkward_rows()],
    ]:
        assert np.frombuffer(e.encode(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:80]


def test_files_have_the_named_format(spark):
    from pyarrow import orc

    path = new_path(spark, "t")
    q.write_orc(c.documents(spark), path)
    names = [r.file for r in spark.read.format("binaryFile").load(path + "/*.orc").selectExpr("path as file").collect()]
    assert names
    found = [orc.ORCFile(n.removeprefix("file:")) for n in names]
    assert all(f.row_index_stride == 1000 for f in found)
    assert spark.read.orc(path).where("doc_id = 17").count() == 1


def test_a_tokenizer_that_keeps_blanks_encodes_whole_texts(spark):
    check(spark, c.documents(spark), "byte_bpe_50k.json")
    assert q.PieceEncoder(q.tokenizer_path("byte_bpe_50k.json")).whole and not q.PieceEncoder(q.tokenizer_path()).whole


def test_records_per_file_do_not_cut_ranges(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "20")
    try:
        check(spark, c.documents(spark))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_files_are_ordered_by_range_not_by_name(spark):
    n = 100_020  # Spark pads part numbers to five digits
    files = spark.range(n).selectExpr("concat('part-', lpad(id, greatest(5, length(id)), '0'), '-x.orc') as f", "id % 7 as n", "if(id = 0, null, id) as least")
    got = {r.f: r.base for r in q.file_starts(files).collect()}
    start = 0
    for k in range(n):
        if k > 99_990 or k < 9:
            assert got[f"part-{k:05d}-x.orc"] == start
        start += k % 7
