import numpy as np

from linkveil.llm import ordinal as q
from tests.llm import common as c


def test_held_out_selection(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    unseen = "pmod(xxhash64(doc_id), 4) = 0"
    rows = q.score(docs, q.fit(docs, labels.where(f"not ({unseen})"))).join(labels.where(unseen), "doc_id").collect()
    kept = lambda f: np.mean([r.kept for r in rows if f(r)])
    assert kept(lambda r: r.toxic == 1) <= 0.25
    assert kept(lambda r: r.quality == 0) <= 0.4
    assert kept(lambda r: r.quality == 1 and r.toxic == 0) >= 0.96
    grade = lambda f: np.mean([r.expected_grade for r in rows if f(r)])
    assert grade(lambda r: r.toxic == 1) < grade(lambda r: r.toxic == 0 and r.quality == 0) < grade(lambda r: r.toxic == 0 and r.quality == 1)


def test_likelihood_gradient_recovers_order():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 600)
    lists = [np.array([10 + g, 99] if rng.random() < 0.9 else [99], dtype=np.int32) for g in grades]
    m = q.fit_model(lists, grades, rounds=300, least_texts=1)
    assert (np.diff(m.thresholds) > 0).all() and (np.diff(m.weights[10:14]) > 0).all()
    tails = m.tails(np.array([m.weights[x].sum() for x in lists]))
    assert (np.diff(tails, axis=1) <= 0).all() and ((tails >= 0) & (tails <= 1)).all()


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    for model in (q.fit(c.awkward(spark), labels), q.fit(c.awkward(spark), labels.limit(0)), q.fit(c.documents(spark), spark.read.parquet(f"{c.SF}/labels.parquet"))):
        assert q.score(c.awkward(spark), model).count() == len(c.awkward_rows())
        assert q.score(c.empty(spark), model).count() == 0


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(2)
    n, k = 40, 6
    of = np.repeat(np.arange(n), 3)
    column, grades = rng.integers(0, k, 3 * n), rng.integers(0, 4, n)
    x = np.r_[rng.normal(size=k), -0.7, rng.normal(size=2) / 3]
    f = lambda x: q.loss_and_gradient(x[:k], x[k:], of, column, grades, 0.1)
    for i, g in enumerate(f(x)[1]):
        e = np.eye(len(x))[i] * 1e-5
        assert abs((f(x + e)[0] - f(x - e)[0]) / 2e-5 - g) < 1e-7


def slow_features(raw):
    """The features of a text one by one, counted in plain loops."""
    import math
    import zlib

    text = raw or b""
    words, word = [], b""
    for b in [*text.lower(), 32]:
        if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128:
            word += bytes([b])
        elif word:
            words.append(word)
            word = b""
    n = max(1, len(text.split()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = lambda s: sum(chr(b) in s for b in text)
    shape = {
        "words": math.log2(n), "kinds": 10 * len(set(words)) / max(1, len(words)), "signs": 4 * min(2.0, count("#*$%&<>") / n), "bars": 8 * min(1.0, count("|") / n),
        "shouts": 8 * min(1.0, count("!") / n), "upper": 4 * min(2.0, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n), "lines": 8 * (len(lines) - len(set(lines))) / max(1, len(lines)), "length": min(12.0, len(text) / n),
    }
    out = {zlib.crc32(w) for w in words} | {zlib.crc32(w[:6], 2) for w in words} | {zlib.crc32(f"{k}={math.ceil(v)}".encode(), 1) for k, v in shape.items()}
    return {x % (1 << q.BITS) for x in out}


def test_scores_are_those_of_a_slow_scorer(spark):
    import math

    docs = c.documents(spark).limit(60).unionByName(c.awkward(spark).select(c.documents(spark).columns))
    model = q.fit(c.documents(spark), spark.read.parquet(f"{c.SF}/labels.parquet"))
    want = []
    for r in docs.collect():
        margin = sum(float(model.weights[f]) for f in slow_features(None if r.text is None else r.text.encode()))
        tails = [1 / (1 + math.exp(t - margin)) for t in model.thresholds]
        want.append((str(r.doc_id), round(sum(tails), 9), round(tails[-1], 9), tails[-1] >= 0.5))
    got = [(str(r.doc_id), round(r.expected_grade, 9), round(r.p_top, 9), r.kept) for r in q.score(docs, model).collect()]
    assert sorted(got) == sorted(want)


def test_a_tail_equal_to_the_bound_keeps(spark):
    model = q.Model(np.array([0.0, 0.0]), np.zeros(1 << q.BITS, np.float32))
    assert all(r.kept and r.p_top == 0.5 for r in q.score(c.awkward(spark), model).collect())
