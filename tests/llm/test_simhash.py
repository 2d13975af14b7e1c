import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from linkveil.llm import simhash as q
from tests.llm import common as c


def slow_fingerprint(t):
    w = c.words(c.lower(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_labels(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def check(docs):
    rows = docs.collect()
    got = q.near_duplicates(docs).collect()
    fps = sorted({slow_fingerprint(r.text) for r in rows})
    label = dict(zip(fps, slow_labels(fps), strict=True))
    least = {}
    for r in rows:
        if r.doc_id is not None:
            k = label[slow_fingerprint(r.text)]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted((r.doc_id is None, r.doc_id or 0, slow_fingerprint(r.text), least.get(label[slow_fingerprint(r.text)]) or 0) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component_id or 0) for r in got) == want


def test_awkward_rows(spark):
    check(c.awkward(spark))
    assert q.near_duplicates(c.empty(spark)).count() == 0


def test_documents_match_all_pairs(spark):
    check(c.documents(spark))


def test_small_blocks_lose_no_link(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 4)
    fps = {int(x) for x in centre}
    while len(fps) < 700:
        x = int(rng.choice(list(fps)))
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = q.links(q.cells(table, block=16)).collect()
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for e in edges:
        a, b = root(e.src), root(e.dst)
        label[max(a, b)] = min(a, b)
    want = slow_labels([x % 2**64 for x in fps])
    assert [fps.index(root(x)) for x in fps] == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=150), st.integers(0, 3), st.integers(1, 20))
def test_forest_matches_all_pairs(values, radius, cell):
    fp = np.array([v >> 58 if i % 2 else v for i, v in enumerate(values)], dtype=np.uint64)
    at = np.arange(len(fp))
    end = np.minimum((at // cell + 1) * cell, len(fp))
    got = q.forest(fp, end, radius)
    want = list(range(len(fp)))
    for i in at:
        for j in range(i + 1, end[i]):
            if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius:
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    assert list(got) == want


def test_stage_keeps_one_of_each_group(spark):
    docs = c.documents(spark)
    groups = q.near_duplicates(docs).collect()
    out = q.stage(spark, docs, c.SF)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({r.component_id for r in groups})
    odd = q.stage(spark, c.awkward(spark), c.SF)
    ids = [r.doc_id for r in odd.collect()]
    assert len(ids) == len(set(ids)) and 5 in ids and 6 not in ids and None in ids
    assert q.stage(spark, c.empty(spark), c.SF).count() == 0


def test_stage_keeps_one_of_each_group_where_ids_repeat(spark):
    a, b, d, e = ("".join(f"{x}{i} " for i in range(40)) for x in "abde")
    rows = [(1, a), (1, b), (2, b), (3, b), (3, d), (4, d), (4, d), (5, a), (None, e), (None, e), (None, d)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    out = q.stage(spark, docs, c.SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, a), (1, b), (3, d), (0, e)])
