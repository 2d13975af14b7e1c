import re
from collections import Counter

from linkveil.llm import quality_rules as q
from tests.llm import common as c


def brute(t):
    t = t or ""
    w = c.words(t)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, cover = Counter(wins), set()
    for i, x in enumerate(wins):
        if n[x] > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if c.words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


def check(docs):
    want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    got = Counter(tuple(r) for r in q.text_statistics(docs).select("doc_id", *q.BASE).collect())
    assert got == want


def test_statistics_match_brute_force(spark):
    check(c.awkward(spark))
    check(c.documents(spark))


def test_without_labels_the_base_rules_decide(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out, rules = q.judge(c.awkward(spark), labels)
    assert rules == []
    assert all(r.kept == (not r.base_failed) for r in out.collect())
    assert q.judge(c.empty(spark), labels)[0].count() == 0


def test_learned_list_rejects_what_the_labels_reject(spark):
    out = q.op9_quality_rules(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    bad = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert sum(r.kept for r in good) >= 0.99 * len(good)


def test_rules_read_as_conditions(spark):
    rule = q.Rule([("s_symbols", ">", 0.5), ("s_words", "<=", 10.0)])
    assert str(rule) == "s_symbols > 0.5 and s_words <= 10"
    rows = spark.createDataFrame([(1.0, 5.0), (1.0, 20.0), (0.0, 5.0)], "s_symbols double, s_words double")
    assert [r[0] for r in rows.select(rule.column()).collect()] == [True, False, False]


def test_stage_keeps_columns_and_clean_documents(spark):
    docs = c.documents(spark)
    out = q.stage(spark, docs, c.SF)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept < {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in docs.collect() if brute(r.text)[0] >= 10 and brute(r.text)[4] == 0 and brute(r.text)[2] == 0} <= kept
    assert q.stage(spark, c.empty(spark), c.SF).count() == 0
    assert q.stage(spark, c.awkward(spark), c.SF).columns == c.awkward(spark).columns


def slow_list(rows, cuts, params):
    """Sequential covering over rows, one predicate at a time."""
    import math

    def meets(r, cond):
        name, op, at = cond
        return r[name] <= at if op == "<=" else r[name] > at

    def count(own, part):
        some = [r for r in own if r["grow"] == part]
        bad = sum(r["bad"] for r in some)
        return bad, len(some) - bad

    left, rules = list(rows), []
    while len(rules) < params.max_rules and count(left, True)[0] >= params.min_cover:
        conds, inside, steps = [], left, []
        while len(conds) < params.max_conditions and count(inside, True)[1] > 0:
            p0, n0 = count(inside, True)
            best = None
            for name in q.STATISTICS:
                for at in cuts[name]:
                    for op in ("<=", ">"):
                        p, n = count([r for r in inside if meets(r, (name, op, at))], True)
                        if p < params.min_cover or p + n == p0 + n0:
                            continue
                        gain = p * (math.log2((p + 1) / (p + n + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2)))
                        if best is None or gain > best[0]:
                            best = (gain, (name, op, at))
            if best is None or best[0] <= 0:
                break
            conds.append(best[1])
            inside = [r for r in inside if meets(r, best[1])]
            steps.append((count(inside, True), count(inside, False)))
        if not steps:
            break
        worth = [round((p + 1) / (p + n + 2), 4) for _, (p, n) in steps]
        k = worth.index(max(worth))
        grow, prune = steps[k]
        if prune[0] < params.min_prune or any(p < params.min_precision * (p + n) for p, n in (grow, prune)):
            break
        rules.append(conds[: k + 1])
        left = [r for r in left if not all(meets(r, x) for x in conds[: k + 1])]
    return rules


def test_the_learned_list_is_that_of_a_slow_learner(spark):
    import random

    draw, rows = random.Random(5), []
    for _ in range(500):
        r = {s: float(draw.randrange(9)) for s in q.STATISTICS}
        noise = draw.random() < 0.01
        r["bad"] = ((r["s_words"] > 5 and r["s_upper"] <= 3) or r["s_bars"] > 7) != noise
        r["grow"] = draw.random() < 0.67
        rows.append(r)
    labelled = spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))
    params = q.RuleParams(quantiles=10, min_precision=0.9)
    got = q.learn_rules(labelled, params)
    assert len(got) >= 2
    assert [r.conditions for r in got] == slow_list(rows, q.cuts_of(labelled, params.quantiles), params)
