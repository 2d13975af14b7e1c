import hashlib
import re

import duckdb

from linkveil.llm import decontaminate as q
from tests.llm import common as c

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, width=13):
    wins = {}
    for i, t in items:
        w = WORD.findall(c.lower(t))
        for s in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[s : s + width]), set()).add(i)
    lens = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w = WORD.findall(c.lower(t))
        hit, ids = set(), set()
        for n in lens:
            for s in range(len(w) - n + 1):
                if got := wins.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    ids |= got
        names = sorted(str(x) for x in ids if x is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(docs, bench):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = q.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    return want


def test_documents_match_brute_force(spark):
    want = check(c.documents(spark), spark.read.parquet(f"{c.SF}/benchmark.parquet"))
    assert any(r[5] for r in want)


def test_awkward_rows_and_items(spark):
    items = [
        (1, "a b c d e f g h i j k l m n o"), (2, "one"), (3, None), (4, "..."), (5, "A B c d E f g h i j k l M"), (5, "A B c d E f g h i j k l M"),
        (None, "one two"), (6, "a a a a a a a a a a a a a a a"), (7, "nowhere to be found in any text of this table at all ever"), (8, "éa word1 éa"),
        (9, "ÀÉ 🎉🎉 emoji"), (10, "a b c d e " * 5),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    check(c.awkward(spark), bench)
    check(c.awkward(spark), bench.limit(0))
    assert q.contamination(c.empty(spark), bench).count() == 0


def test_oracle_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{c.SF}/{t}.parquet')")
    got = q.op4_decontamination(spark, c.SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, db.execute(q.ORACLE).fetchall()), key=str)


def test_one_word_item_in_a_very_long_text(spark):
    long = " ".join("hot" if i % 2 else f"w{i % 501}" for i in range(40_000))
    docs = spark.createDataFrame([(1, long), (2, "hot hot cold"), (None, "hot")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "hot"), (2, "hot cold"), (3, "hot w1 hot")], "item_id long, text string")
    assert check(docs, bench)[0][2] > 20_000


def test_postings_of_every_term_give_the_same(spark):
    docs, bench = c.documents(spark), spark.read.parquet(f"{c.SF}/benchmark.parquet")
    few, all_ = (sorted((tuple(r) for r in q.contamination(docs, bench, every_term=x).collect()), key=str) for x in (False, True))
    assert few == all_
    index = q.positional_index(docs)
    assert index.count() == sum(len(WORD.findall(c.lower(r.text))) + 1 for r in docs.collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "beta x x x x x x alpha gamma"), (3, None)], "doc_id long, text string")
    index = q.positional_index(docs)
    queries = spark.createDataFrame([("q", ["alpha", "beta", "gamma"]), ("p", ["alpha", "gamma"])], "query string, terms array<string>")
    queries = queries.withColumn("terms", q.F.transform("terms", lambda w: q.F.xxhash64(w)))
    got = q.proximity_matches(index, queries, 5).join(q.documents_of(index), "row").collect()
    assert {(r["query"], r["key"], r["pos"]) for r in got} == {("q", 1, 0), ("p", 1, 0), ("p", 2, 7)}


def test_n_near_against_brute_force(spark):
    docs, bench = c.documents(spark).collect(), spark.read.parquet(f"{c.SF}/benchmark.parquet").collect()
    words = {d.doc_id: WORD.findall(c.lower(d.text)) for d in docs}
    tf = {}
    for w in words.values():
        for x in w:
            tf[x] = tf.get(x, 0) + 1
    want = dict.fromkeys(words, 0)
    for b in bench:
        rare = sorted(set(WORD.findall(c.lower(b.text))), key=lambda x: (tf.get(x, 0), x.encode()))[:3]
        for d, w in words.items():
            at = [p for p, x in enumerate(w) if x in rare]
            want[d] += any({w[p] for p in at if a <= p <= a + 13} == set(rare) for a in at) if rare else 0
    assert {r.doc_id: r.n_near for r in q.op4_decontamination(spark, c.SF).collect()} == want and any(want.values())


def test_stage(spark):
    docs = c.documents(spark)
    out = q.stage(spark, docs, c.SF)
    bad = {r.doc_id for r in q.op4_decontamination(spark, c.SF).collect() if r.contaminated}
    assert out.columns == docs.columns
    clash = docs.withColumnsRenamed({"lang": "k1", "source": "term"}).withColumn("row", q.F.lit(1))
    assert q.stage(spark, clash, c.SF).columns == clash.columns and q.stage(spark, clash, c.SF).count() == out.count()
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
