from collections import Counter, defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkveil.llm import packing as q
from linkveil.llm.tokens import tokenizer_path
from tests.llm import common as c


tokenizers = pytest.importorskip("tokenizers")
TOKENIZER = tokenizers.Tokenizer.from_file(tokenizer_path())


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, k):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]
    got = q.best_boundaries(lengths, counts, k)
    assert len(got) <= k and got[-1] == lengths[-1] and got == sorted(set(got))
    best = min(padding(lengths, counts, (*x, lengths[-1])) for r in range(min(k, len(lengths))) for x in combinations(lengths[:-1], r))
    assert padding(lengths, counts, got) == best


def check(docs, **params):
    rows = q.pack(docs, **params).collect()
    budget, most = params.get("budget", q.BUDGET), params.get("max_len", q.MAX_LEN)
    want = Counter()
    for r in docs.collect():
        n = len(TOKENIZER.encode(r.text or "", add_special_tokens=False).ids) + 1
        for piece, at in enumerate(range(0, n, most)):
            want[r.doc_id, piece, min(most, n - at)] += 1
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in rows) == want
    batches = defaultdict(list)
    for r in rows:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket_len, r.batch].append(r.place)
    for (length, batch), places in batches.items():
        assert sorted(places) == list(range(len(places)))
        full = max(1, budget // length)
        assert len(places) == full or (len(places) < full and batch == max(b for x, b in batches if x == length))
    return rows


def test_documents(spark):
    assert len({r.bucket_len for r in check(c.documents(spark), budget=4000, max_len=512)}) == q.BUCKETS


def test_awkward_rows(spark):
    check(c.awkward(spark), budget=5000, max_len=1000)
    assert q.pack(c.empty(spark)).count() == 0


def test_rows_without_an_id_are_dealt_out(spark):
    docs = spark.createDataFrame([(None, "one two three")] * 300, "doc_id long, text string")
    rows = q.pack(docs, budget=40).collect()
    batches = Counter(r.batch for r in rows)
    assert sum(batches.values()) == 300 and set(batches.values()) <= {10} and len(batches) == 30
