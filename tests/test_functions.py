"""Golden micro-fixtures of functions, hashing, hardening and length bounds."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from linkveil.functions import columns as c
from linkveil.functions import hashing
from linkveil.operators import encoders, hardening


def one(spark, col, value="anna"):
    return spark.createDataFrame([(value,)], "v string").select(col.alias("x")).first()["x"]


def test_grams(spark):
    assert one(spark, c.grams_in_order(F.col("v"), 2)) == ["an", "nn", "na"]
    assert one(spark, c.grams_in_order(F.col("v"), 2, True)) == ["\x01a", "an", "nn", "na", "a\x01"]
    assert one(spark, c.gram_set(F.col("v"), 2), "a") == []
    assert one(spark, c.gram_set(F.col("v"), 2), None) == []
    assert one(spark, c.gram_set(F.col("v"), 3), "aaaa") == ["aaa"]
    assert one(spark, c.record_grams([F.col("v"), F.lit("ann")], 2)) == ["an", "nn", "na"]
    assert one(spark, c.salted(c.gram_set(F.col("v"), 2), F.lit(7))) == ["an7", "nn7", "na7"]


@pytest.mark.parametrize(
    ("scheme", "want"),
    [("dh", [4, 14, 16, 24, 30]), ("edh", [4, 15, 16, 25, 31]), ("th", [0, 3, 4, 16, 18]), ("rh", [2, 20, 21, 22, 31])],
)
def test_hashing_golden(spark, scheme, want):
    assert one(spark, hashing.positions(c.gram_set(F.col("v"), 2), 32, 2, scheme)) == want


def test_digests_fold_exactly(spark):
    for n in (2, 1000, 2**31 - 1):
        for g in ("an", "é", "", "🎉x"):
            a, b, d = (int(h(g.encode()).hexdigest(), 16) for h in (hashlib.sha1, hashlib.md5, hashlib.sha224))
            got = one(spark, F.array(hashing._sha1(F.col("v"), n), hashing._md5(F.col("v"), n), hashing._sha224(F.col("v"), n)), g)
            assert got == [a % n, b % n, d % n]


def test_hardening_golden(spark):
    pos = hashing.positions(c.gram_set(F.col("v"), 2), 32, 2, "dh")
    assert one(spark, hardening.fold(pos, 32)) == [0, 4, 8]
    assert one(spark, hardening.rule_90(pos, 32)) == [3, 5, 13, 17, 23, 25, 29, 31]
    balanced = one(spark, hardening.balance(pos, 32))
    assert len(balanced) == 32 and balanced[:12] == [4, 14, 16, 24, 30, 32, 33, 34, 35, 37, 38, 39]
    permuted = one(spark, hardening.balance(pos, 32, seed=42))
    to = hardening.permutation(64, 42)
    assert permuted == sorted(to[p] for p in balanced)
    assert one(spark, hardening.fold(hardening.fold(pos, 32), 16)) == [p for p in (0, 4) if [0, 4, 8].count(p) != [0, 4, 8].count(p + 8)]
    with pytest.raises(ValueError):
        hardening.fold(pos, 31)


def test_markov_golden(spark):
    df = spark.createDataFrame([("anna anna ann",)], "v string")
    got = {(r.g1, r.g2): r.n for r in hardening.transitions(df, "v", 2).collect()}
    assert got == {("an", "nn"): 3, ("nn", "na"): 2, ("na", "a "): 2, ("a ", " a"): 2, (" a", "an"): 2}
    model = hardening.transitions(df, "v", 2)
    assert {r.g1: r.extra for r in hardening.markov_extras(model, 1).collect()}["an"] == ["nn"]
    drawn = hardening.markov_extras(model, 5, "prob").collect()
    assert {r.g1 for r in drawn} == {g for g, _ in got}


def test_soundex_variant(spark):
    for name, code in {"pfister": "p123", "sasas": "s200", "tutor": "t360", "gauss": "g200", "": "z000", "a": "a000", None: "z000"}.items():
        assert one(spark, c.soundex(F.col("v")), name) == code


def test_length_bounds(spark):
    lower, estimate, upper = c.gram_count_bounds(F.lit(150), 1000, 10)
    row = spark.range(1).select(lower.alias("l"), estimate.alias("e"), upper.alias("u"), c.gram_count_check(F.lit(150), 1000, 10).alias("k")).first()
    assert (row.l, round(row.e, 6), round(row.u, 6)) == (15, 16.243766, 17.487531)
    assert row.k == pytest.approx(row.e, rel=1e-3)
    full = spark.range(1).select(c.gram_count_bounds(F.lit(1000), 1000, 10)[1].alias("e")).first().e
    assert math.isfinite(full)


def test_similarities(spark):
    a, b = F.array(*map(F.lit, ["x", "y", "z"])), F.array(*map(F.lit, ["y", "z", "w", "v"]))
    row = spark.range(1).select(c.dice(a, b).alias("d"), c.jaccard(a, b).alias("j")).first()
    assert (round(row.d, 6), row.j) == (round(4 / 7, 6), 0.4)
    none = F.array().cast("array<string>")
    assert spark.range(1).select(c.dice(none, none).alias("d"), c.jaccard(none, none).alias("j")).first() == (0.0, 0.0)
    p, q = F.array(F.lit(1), F.lit(3)), F.array(F.lit(3), F.lit(4))
    assert spark.range(1).select(c.hamming(p, q, 10).alias("h")).first().h == 0.8
    u, v = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    row = spark.range(1).select(c.cosine(u, v).alias("c"), c.angle_similarity(u, v).alias("a"), c.euclidean(u, v).alias("e"), c.sorted_difference(u, v).alias("s")).first()
    assert row.c == pytest.approx(2**-0.5) and row.a == pytest.approx(0.75) and row.e == 1.0 and row.s == 0.5


def test_small_scalars(spark):
    assert c.optimal_k(1000, 15) == round(math.log(2) * 1000 / 15)
    assert [one(spark, c.similarity_class(F.lit(x))) for x in (0.0, 0.05, 0.1, 0.11, 1.0)] == [None, 1, 1, 2, 10]
    assert c.distinct_columns_probability(1000, 2) == pytest.approx((1 - 1 / 1000) * (1 - 2 / 1000) * (1 - 3 / 1000))
    assert one(spark, c.token_overlap(F.lit("a b c"), F.lit("b c d"))) == pytest.approx(2 / 3)
    assert [one(spark, c.record_id(F.lit(x))) for x in (" AB ", "rec-7-org", "a- B ")] == ["ab", "7", "b"]
    assert one(spark, c.suspicion(F.lit(2), 100)) == pytest.approx(0.494949, abs=1e-6)


def test_encoders_agree(spark):
    df = spark.createDataFrame([("anna", "smith"), ("bo", "x"), ("", None)], "a string, b string")
    e = encoders.Encoding(("a", "b"), 2, False, 64, 3)
    rows = encoders.encode(df, e).collect()
    each = df.select(encoders.attribute_filter(e, "a", 3).alias("a"), encoders.attribute_filter(e, "b", 3).alias("b")).collect()
    assert [r.bits for r in rows] == [sorted(set(x.a) | set(x.b)) for x in each]
    words = encoders.encode(df, e).select(encoders.packed(F.col("bits"), 64).alias("w")).collect()
    assert [r.w[0] % 2**64 for r in words] == [sum(1 << p for p in r.bits) for r in rows]
    truth = {(r.gram, r.pos) for r in encoders.true_positions(df, e).collect()}
    assert {p for _, p in truth} == {p for r in rows for p in r.bits}
    assert encoders.with_optimal_k(df, e).k == round(math.log(2) * 64 / ((7 + 1 + 0) / 3))
    markov = encoders.encode(df, encoders.Encoding(("a", "b"), 2, False, 64, 3, harden="markov")).collect()
    assert all(set(r.bits) >= set(x.bits) for r, x in zip(sorted(markov, key=lambda r: r.a), sorted(rows, key=lambda r: r.a), strict=True))


def test_rbf_gives_each_attribute_its_share(spark):
    table = encoders.rbf_map([64, 8], [0.25, 0.75], 64)
    assert [sum(n == a for n, _, _ in table) for a in (0, 1)] == [16, 48] and sorted(r for _, _, r in table) == list(range(64))
    assert encoders.rbf_map([64, 8], [0.25, 0.75], 64) == table
    df = spark.createDataFrame([("anna", "smith")], "a string, b string")
    e = encoders.Encoding(("a", "b"), 2, False, 64, 3, kind="rbf")
    got = encoders.encode(df, e, [0.25, 0.75]).first().bits
    full = df.select(encoders.attribute_filter(e, "a", 3).alias("a"), encoders.attribute_filter(e, "b", 3).alias("b")).first()
    assert got == sorted(r for n, b, r in encoders.rbf_map([64, 64], [0.25, 0.75], 64) if b in (full.a, full.b)[n])


def test_rbf_keeps_every_bit_of_a_short_filter():
    table = encoders.rbf_map([64, 8], [0.25, 0.75], 64)
    assert {b for n, b, _ in table if n == 1} == set(range(8))
    assert all({b for n, b, _ in encoders.rbf_map([117, 73], [0.5, 0.5], 1000) if n == a} == set(range(size)) for a, size in enumerate((117, 73)))


def test_the_dictionary_gives_the_positions_of_the_rows(spark, monkeypatch):
    df = spark.createDataFrame([("anna", "smith", "x"), ("", None, "y"), ("jo é", "o'neil", None)], "a string, b string, s string")
    for e in (
        encoders.Encoding(("a", "b"), 2, True, 97, 4), encoders.Encoding(("a", "b"), 2, False, 64, (3, 5), kind="clkrbf"), encoders.Encoding(("a", "b"), 2, False, 64, 3, "th", "rbf"),
        encoders.Encoding(("a",), 3, True, 64, 3, "counter", salt="s", harden="fold"),
    ):
        rows = lambda **kw: sorted(map(str, encoders.encode(df, e, **kw).collect()))  # noqa: B023, E731
        with_, without = rows(), rows(dictionary=False)
        assert with_ == without
    monkeypatch.setattr(encoders, "MOST_GRAMS", 2)
    assert rows() == without


def test_grams_in_order_of_any_text(spark):
    texts = [None, "", "a", "ab", "anna", "a\U0001f600b\U0001f600", "\u00e9e\u0301 \n\t x", "abc" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for q in (1, 2, 3):
        for padded in (False, True):
            got = {r.i: r.g for r in df.select("i", c.grams_in_order(F.col("t"), q, padded).alias("g")).collect()}
            for i, t in enumerate(texts):
                full = c.PAD * (q - 1) * padded + (t or "") + c.PAD * (q - 1) * padded
                assert got[i] == [full[k : k + q] for k in range(len(full) - q + 1)], (q, padded, i)
        for r in df.select("t", c.grams_of_long(F.col("t"), q).alias("g")).collect():
            assert r.g == [(r.t or "")[k : k + q] for k in range(len(r.t or "") - q + 1)], (q, r.t)
