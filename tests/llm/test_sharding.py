import zlib
from collections import Counter

from linkveil.llm import sharding as q
from tests.llm import common as c


def check(rows, docs, n=16):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs
    )
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_documents_near_equal_bytes(spark):
    rows = q.op2_kd_shards(spark, "/root/testdata/sf0.01").collect()
    check(rows, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    most = max(r.size for r in rows)
    assert max(size.values()) - min(size.values()) <= 2 * most


def test_awkward_and_empty(spark):
    docs = c.awkward(spark)
    check(q.assign(docs).collect(), docs.collect())
    assert q.assign(c.empty(spark)).count() == 0
    assert {r.shard for r in q.assign(docs, 1).collect()} == {0}


def test_uneven_counts_and_target_bytes(spark):
    docs = c.documents(spark)
    rows = q.assign(docs, 5).collect()
    check(rows, docs.collect(), 5)
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 3 * max(r.size for r in rows)
    total = sum(size.values())
    assert len({r.shard for r in q.assign(docs, target_bytes=total // 7 + 1).collect()}) == 7


def test_cut_is_the_weighted_median(spark):
    docs = c.documents(spark)
    rows, dims = q.metadata(docs)
    rows = q.materialize(rows, "t")
    tree = q.grow(rows, dims, 2)
    got = [(r[tree.dimension], r["size"]) for r in rows.collect()]
    left = sum(s for v, s in got if v <= tree.value)
    best = min(abs(sum(s for v, s in got if v <= at) - sum(s for _, s in got) / 2) for at, _ in got)
    assert abs(left - sum(s for _, s in got) / 2) == best


def test_every_cut_is_off_by_half_a_row_at_most(spark):
    docs = c.documents(spark)
    rows, dims = q.metadata(docs)
    rows = q.materialize(rows, "t")
    tree = q.grow(rows, dims, 16)
    got = rows.collect()

    def walk(node, own):
        if node.dimension is None:
            return
        left = [r for r in own if r[node.dimension] <= node.value]
        right = [r for r in own if r[node.dimension] > node.value]
        total = sum(r["size"] for r in own)
        assert 2 * abs(sum(r["size"] for r in left) - total * (node.k // 2) / node.k) <= max(r["size"] for r in own)
        walk(node.left, left)
        walk(node.right, right)

    walk(tree, got)
    most, share = max(r["size"] for r in got), sum(r["size"] for r in got) / 16
    for leaf in tree.leaves():
        mine = sum(r["size"] for r in rows.withColumn("s", tree.shard()).where(f"s = {leaf.first}").select("size").collect())
        assert abs(mine - share) < most


def test_copies_part_where_they_must(spark):
    docs = spark.createDataFrame([(i, "a copy of one text" if i % 3 else f"text {i}") for i in range(600)], "doc_id long, text string")
    rows = q.assign(docs).collect()
    check(rows, docs.collect())
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) < 2 * max(r.size for r in rows)


def test_rows_are_written_once(spark, tmp_path):
    rows = [(1, "same", "x", 7, 8), (1, "same", "x", 7, 8), (1, "same", "x", 7, 8), (None, "a", "y", 9, None), (None, "b", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, doc_slot int")
    q.write_shards(docs, str(tmp_path / "s"), 2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {"doc_id", "text", "source", "doc_shard", "doc_slot", "slot", "shard"}
    assert Counter(tuple(r) for r in back.select("doc_id", "text", "source", "doc_shard", "doc_slot").collect()) == Counter(rows)


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = c.documents(spark)
    q.write_shards(docs, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and {r.shard for r in back.collect()} == set(range(16))
