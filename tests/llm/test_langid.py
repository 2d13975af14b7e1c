import zlib

import numpy as np

from linkveil.llm import langid as q
from tests.llm import common as c


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = q.op7_langid(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    unseen = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in unseen]) >= 0.98


def test_awkward_rows(spark):
    filters = q.fit(c.documents(spark))
    got = q.identify(c.awkward(spark), filters).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(c.awkward_rows())
    assert all(by[i].lang_pred == q.UNKNOWN and by[i].score == 0 for i in (0, 1, 2))
    assert all(r.lang_pred in {*filters.languages, q.UNKNOWN} for r in got)
    assert q.identify(c.empty(spark), filters).count() == 0
    nothing = q.fit(c.empty(spark))
    assert {r.lang_pred for r in q.identify(c.awkward(spark), nothing).collect()} == {q.UNKNOWN}
    q.fit(c.awkward(spark))


def test_letters_decide_on_und(spark):
    filters = q.fit(c.documents(spark))
    assert filters.predict(["123 ½ ² !?", "_", "🎉", "ж", "1a"])[0][:3] == [q.UNKNOWN] * 3
    assert q.UNKNOWN not in filters.predict(["ж", "1a"])[0]


def test_masks_hold_every_language_of_a_gram(spark):
    filters = q.fit(c.documents(spark))
    assert filters.languages == ["de", "en", "es", "fr"] and filters.sliced.dtype == np.uint8
    assert (filters.false <= q.Params().false_rate).all()


def test_a_batch_predicts_like_its_texts_alone(spark):
    filters = q.fit(c.documents(spark))
    texts = [r.text for r in c.documents(spark).limit(60).collect()] + ["a", None, "", "12", "é x", "the"]
    names, score = filters.predict(texts)
    for t, name, s in zip(texts, names, score, strict=True):
        (one,), (alone,) = filters.predict([t])
        assert one == name and abs(alone - s) < 1e-12
    # and like a count of its n-grams one by one
    for t in texts[:10]:
        h = q.text_grams(t)
        masks = filters.masks(h)
        hits = np.array([np.sum(masks >> np.uint8(k) & np.uint8(1)) for k in range(4)])
        true = np.maximum(hits - len(h) * filters.false, 0) / (1 - filters.false)
        (name,), (s,) = filters.predict([t])
        assert filters.languages[int(true.argmax())] == name and abs(true.max() / true.sum() - s) < 1e-9


def test_more_languages_than_bits_of_a_word(spark):
    alphabets = {f"l{k:03d}": [chr(0x4E00 + 20 * k + i) for i in range(20)] for k in range(140)}
    texts = {x: ["".join(a[(i * s + 3 * s) % 20] for i in range(30)) for s in range(1, 4)] for x, a in alphabets.items()}
    rows = [(t, x) for x, own in texts.items() for t in own for _ in range(1 + (x < "l100"))] + [("abc", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    filters = q.fit(docs)
    assert filters.languages == sorted(alphabets) and filters.sliced.shape == (3, 1 << q.LEAST_BITS)
    for x, own in texts.items():
        assert filters.predict(own)[0] == [x] * 3
    # a bound of one text for each leaves none out
    small = q.fit(docs, max_train=1)
    assert small.languages == sorted(alphabets) and (small.false > 0).all()


def exact_sets(rows, params):
    """By language the n-grams that are characteristic, in plain Python."""
    texts = {}
    for lang, t in {(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None}:
        texts.setdefault(lang, []).append(set(q.text_grams(t).tolist()))
    blank = set(q.text_grams("").tolist())
    share = {}
    for lang, sets in texts.items():
        for g in set().union(*sets):
            share.setdefault(g, {})[lang] = sum(g in s for s in sets) / len(sets)
    out = {lang: set() for lang in texts}
    for g, by in share.items():
        top = max(by.values())
        home = [x for x, p in by.items() if p >= params.floor and p >= params.near * top] if top >= params.floor else []
        if len(home) < max(2, len(texts)):
            for x in home:
                out[x].add(g)
    return out, blank


def test_filters_hold_the_exact_sets_and_little_else(spark):
    docs, params = c.documents(spark), q.Params()
    filters = q.fit(docs, params)
    want, _ = exact_sets(docs.collect(), params)
    others = q.mix(np.arange(200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k, x in enumerate(filters.languages):
        own = np.array(sorted(want[x]), dtype=np.uint64)
        assert len(own) > 1000 and (filters.masks(own) >> np.uint8(k) & np.uint8(1)).all()
        wrong = np.mean(filters.masks(others) >> np.uint8(k) & np.uint8(1))
        assert wrong <= params.false_rate and abs(wrong - filters.false[k]) < 0.002


def test_every_n_gram_of_a_large_vocabulary_is_kept(spark):
    rng = np.random.default_rng(1)
    word = lambda lo: "".join(map(chr, rng.integers(lo, lo + 900, 6)))
    rows = [(" ".join(word(lo) for _ in range(4000)), lang) for lang, lo in (("a", 0x4E00), ("b", 0x6000)) for _ in range(12)]
    filters = q.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert filters.sliced.shape[-1] > 1 << q.LEAST_BITS and (filters.false <= 0.011).all()
    for t, lang in rows:
        h = np.unique(q.text_grams(t))
        assert np.mean(filters.masks(h) >> np.uint8(filters.languages.index(lang)) & np.uint8(1)) > 0.99


def test_table_bits():
    assert q.table_bits(10, 0.01) == q.LEAST_BITS
    for n in (100_000, 1_000_000, 30_000_000):
        bits = q.table_bits(n, 0.01)
        assert (1 - np.exp(-q.HASHES * n / 2**bits)) ** q.HASHES <= 0.01
        at = list(q.entries(q.mix(np.arange(1000, dtype=np.uint64)), bits))
        assert len(at) == q.HASHES and all(a.max() < 1 << bits for a in at)
