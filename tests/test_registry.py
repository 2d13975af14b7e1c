"""Registered queries that have no SQL, against what their names promise."""

from linkveil.plans import registry

SF = "/root/testdata/sf0.001"


def test_matchers_are_offered_both_ways_and_the_truth(spark):
    values = {r.node for r in registry.name_values(spark, SF).select("node").collect()}
    edges = {(r.src, r.dst) for r in registry.bit_edges(spark, SF).where("sim >= 0.8").collect()}
    got = [(r.plain, r.enc) for r in registry.scored_both_ways(spark, SF).collect()]
    assert edges and len(got) == len(set(got)) and set(got) == edges | {(b, a) for a, b in edges} | {(v, v) for v in values}
    assert {(r.plain, r.enc) for r in registry.match_greedy(spark, SF).collect()} == {(v, v) for v in values}
    best = registry.match_hungarian(spark, SF).first()
    assert (best.n, best.score) == (len(values), len(values))
    pairs = [(r.plain, r.enc) for r in registry.match_random(spark, SF).collect()]
    assert {p for p, _ in pairs} | {e for _, e in pairs} == values


def test_hlsh_block_takes_twenty_samples(spark):
    records = spark.read.parquet(f"{SF}/part.parquet").count()
    assert sum(r.n for r in registry.hlsh_block(spark, SF).collect()) == 20 * records
