"""Operators against hand-made cases and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkveil.operators import blocking, encoders, evaluate, frequency, graph, matching, mining, statistics
from linkveil.operators.components import connected_components
from linkveil.sources import tables


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(500, 500), (None, 3), (700, None)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in label}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_component_classes_golden(spark):
    edges = {1: [1, 3], 2: [1, 2], 3: [7], 4: [8, 4], 5: [5], 6: [6], 7: [7], 8: [10], 9: [6, 9], 10: [7], 11: [10], 12: [9], 13: [15]}
    rows = [(str(e), str(p), str(e)) for e, ps in edges.items() for p in ps]
    df = spark.createDataFrame(rows, "enc string, plain string, truth string")
    classes = evaluate.component_classes(df)
    assert {r["class"]: r.components for r in evaluate.class_counts(classes).collect()} == {"m-m": 1, "m-m-p": 1, "m-1-p": 1, "m-1-w": 1, "1-m": 1, "1-1": 1, "1-1-w": 1}
    assert {r.type: r["items"] for r in evaluate.item_counts(classes).collect()} == {"m-m": 4, "m-1": 1, "1-m": 1, "1-1": 1, "wrong": 6}
    s = evaluate.suspicion_summary(df, 100).first()
    assert (s["values"], s.most, round(s.least, 6), round(s["mean"], 4), round(s.median, 6), s.certain) == (7, 1.0, 0.494949, 0.7114, 0.494949, 3)


def test_alignment_golden(spark):
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    even, every = part.where("p_partkey % 2 = 0").select(F.lower("p_name").alias("bits")), part.select(F.lower("p_name").alias("value"))
    got = frequency.align(even, every).orderBy("rank").collect()
    assert [(r.bits, r.bf_n, r.value, r.value_n) for r in got] == [("red plate", 28, "red plate", 46), ("old ring", 25, "small widget", 44)]


def test_alignment_edges(spark):
    def align(a, b):
        x = spark.createDataFrame([(v,) for v, n in a for _ in range(n)], "bits string")
        y = spark.createDataFrame([(v,) for v, n in b for _ in range(n)], "value string")
        return [(r.bits, r.value) for r in frequency.align(x, y).orderBy("rank").collect()]

    assert align([("a", 3)], [("x", 2), ("y", 2)]) == [("a", "x")]  # one rank in all
    assert align([("a", 3), ("b", 2)], [("x", 2), ("y", 2)]) == []
    assert align([("a", 3), ("b", 2), ("c", 1)], [("x", 9), ("y", 8), ("z", 8)]) == [("a", "x")]
    assert align([("a", 3), ("b", 2)], [("x", 9), ("y", 8)]) == [("a", "x"), ("b", "y")]
    assert align([], [("x", 9)]) == []


@pytest.mark.parametrize("seed", range(4))
def test_miners_agree_with_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    table = rng.random((200, 9)) < rng.uniform(0.3, 0.9, 9)
    df = spark.createDataFrame([(i, [int(p) for p in np.flatnonzero(r)]) for i, r in enumerate(table)], "rec_id long, bits array<int>")
    least, excluded = 40, [3]
    best = {}
    for n in range(9, 0, -1):
        best = {t: s for t in itertools.combinations([p for p in range(9) if p not in excluded], n) if (s := int(table[:, list(t)].all(axis=1).sum())) >= least}
        if best:
            break
    for method in ("maximal", "apriori", "fpgrowth"):
        assert mining.longest_tuples(df, least, excluded, method=method) == best


@pytest.mark.parametrize("method", ("maximal", "apriori"))
def test_miners_go_on_beyond_the_bound(spark, monkeypatch, method):
    rng = np.random.default_rng(7)
    table = rng.random((150, 12)) < rng.uniform(0.5, 0.9, 12)
    df = spark.createDataFrame([(i, [int(p) for p in np.flatnonzero(r)]) for i, r in enumerate(table)], "rec_id long, bits array<int>")
    want = mining.longest_tuples(df, 40)
    assert max(map(len, want)) >= 4
    monkeypatch.setattr(mining, "MOST_PATTERNS", 20)
    assert mining.longest_tuples(df, 40, method=method) == want
    # longer than 64, with each level but the first beyond the bound
    long = spark.createDataFrame([(i, [*range(70), 70 + i]) for i in range(30)], "rec_id long, bits array<int>")
    assert mining.longest_tuples(long, 30, method=method) == {tuple(range(70)): 30}


def test_maximal_only(spark):
    sets = spark.createDataFrame([([1],), ([2],), ([1, 2],), ([3],), ([2, 4],), ([4],)], "items array<int>")
    assert sorted(r["items"] for r in mining.maximal_only(sets).collect()) == [[1, 2], [2, 4], [3]]


def test_partition_search_finds_true_positions(spark):
    from linkveil.operators import encoders

    rng = random.Random(1)
    words = ["ab", "cd", "ef", "gh"]
    rows = [(i, "".join(w for w, p in zip(words, (0.9, 0.6, 0.4, 0.2), strict=True) if rng.random() < p) or "zz") for i in range(400)]
    df = spark.createDataFrame(rows, "rec_id long, value string")
    from linkveil.functions.columns import gram_set

    e = encoders.Encoding(("value",), 2, False, 256, 4)
    plain = df.select("rec_id", gram_set(F.col("value"), 2).alias("grams"))
    enc = encoders.encode(df, e).select("rec_id", "bits")
    found = mining.partition_search(plain, enc, 1.0, 20)
    truth = {}
    for r in encoders.true_positions(df, e).collect():
        truth.setdefault(r.gram, set()).add(r.pos)
    assert found.tuples and found.positions["ab"] <= truth["ab"] and len(found.positions["ab"]) >= 3
    more = mining.expand(found, plain, enc, least=2)
    assert more.stop_reason in ("done", "nothing to add")


def test_rounds_that_end_early_say_so(spark):
    from linkveil.operators import encoders

    rng = random.Random(1)
    df = spark.createDataFrame([(i, "".join(w for w, p in (("ab", 0.9), ("cd", 0.6), ("ef", 0.4)) if rng.random() < p) or "zz") for i in range(300)], "rec_id long, value string")
    from linkveil.functions.columns import gram_set

    plain = df.select("rec_id", gram_set(F.col("value"), 2).alias("grams"))
    enc = encoders.encode(df, encoders.Encoding(("value",), 2, False, 256, 4)).select("rec_id", "bits")
    assert mining.partition_search(plain, enc, 1.0, 20, most_rounds=1).stop_reason == "partitions left after 1 rounds"
    matches = spark.createDataFrame([("p1", "e1", 0.9), ("p2", "e1", 0.5), ("p2", "e2", 0.1)], "plain string, enc string, score double")
    with pytest.raises(RuntimeError):
        matching.confident_removal(matches, 1)
    assert {(r.plain, r.enc) for r in matching.confident_removal(matches).collect()} == {("p1", "e1"), ("p2", "e2")}


def test_relational_division(spark):
    assigned = spark.createDataFrame([(1, ["ab", "cd"], ["ef"]), (2, ["ab"], []), (3, [], ["ab"])], "rec_id long, must array<string>, cannot array<string>")
    values = spark.createDataFrame([("abcd", ["ab", "bc", "cd"]), ("abcdef", ["ab", "bc", "cd", "de", "ef"]), ("xab", ["xa", "ab"])], "value string, grams array<string>")
    got = {(r.rec_id, r.value) for r in mining.set_intersection(assigned, values).collect()}
    assert got == {(1, "abcd"), (2, "abcd"), (2, "abcdef"), (2, "xab")}


def test_tuple_match(spark):
    positions = {"ab": [1], "bc": [2], "cd": [3]}
    assigned = spark.createDataFrame([(1, ["ab", "bc", "cd"]), (2, ["ab"]), (3, ["ab"]), (4, ["bc"])], "rec_id long, must array<string>")
    values = spark.createDataFrame([("abcd", ["ab", "bc", "cd"]), ("xbc", ["xb", "bc"]), ("zab", ["za", "ab"])], "value string, grams array<string>")
    got = {("|".join(r.key), r.rec_id, r.value) for r in mining.tuple_match(assigned, positions, values, 3).collect()}
    assert got == {("ab|bc|cd", 1, "abcd"), ("bc", 4, "xbc")}  # [ab] has two filters and is short


def test_matchers_have_unique_keys_and_agree(spark):
    rng = random.Random(3)
    rows = [(f"p{i}", f"e{j}", round(rng.random(), 3)) for i in range(25) for j in range(20) if rng.random() < 0.3]
    df = spark.createDataFrame(rows, "plain string, enc string, score double")
    used, want = set(), set()
    for p, e, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if p not in used and e not in used:
            want.add((p, e))
            used |= {p, e}
    greedy = {(r.plain, r.enc) for r in matching.greedy(df).collect()}
    assert greedy == want
    assert {(r.plain, r.enc) for r in matching.symmetric(df).collect()} <= greedy
    for f in (matching.hungarian, matching.random_matching, matching.confident_removal):
        got = f(df).collect()
        assert len({r.plain for r in got}) == len(got) == len({r.enc for r in got})
    assert {(r.plain, r.enc) for r in matching.stable(df).collect()} == greedy


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (2, 4), (4, 4), (5, 6)):
        cost = rng.random((n, m))
        got = matching.assignment(cost)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert len(set(got)) == n and sum(cost[i, j] for i, j in enumerate(got)) == pytest.approx(best)


def test_sparse_matching_is_optimal():
    """Against the dense solver: ties, missing edges, either side larger."""
    rng = np.random.default_rng(1)
    for t in range(300):
        n, m = rng.integers(1, 9, 2)
        weight = np.where(rng.random((n, m)) < rng.choice([0.2, 0.5, 1]), rng.integers(1, 5, (n, m)) / 7 if t % 2 else rng.random((n, m)), 0)
        i, j = np.nonzero(weight)
        mate = matching.sparse_matching(i, j, weight[i, j], n, m)
        rows = np.flatnonzero(mate >= 0)
        cost = 1 - (weight if n <= m else weight.T)
        assert len(set(mate[rows])) == len(rows) and (weight[rows, mate[rows]] > 0).all()
        assert weight[rows, mate[rows]].sum() == pytest.approx(sum(1 - cost[a, b] for a, b in enumerate(matching.assignment(cost))))


def test_hungarian_takes_large_components(spark, monkeypatch):
    """A component beyond the dense solver's bound; free ends of its two sides are paired off; scores below 0 still need the matrix."""
    monkeypatch.setattr(matching, "MOST_IN_COMPONENT", 4)
    rows = [(f"p{i}", f"e{i}", 1.0) for i in range(12)] + [(f"p{i}", f"e{i + 1}", 0.9) for i in range(11)] + [("p12", "e0", 0.5), ("p0", "e13", 0.3)]
    df = spark.createDataFrame(rows, "plain string, enc string, score double")
    got = {(r.plain, r.enc): r.score for r in matching.hungarian(df).collect()}
    assert got == {(f"p{i}", f"e{i}"): 1.0 for i in range(12)} | {("p12", "e13"): 0.1}
    with pytest.raises(ValueError):
        matching.hungarian(df.withColumn("score", F.col("score") - 0.4))
    monkeypatch.setattr(matching, "MOST_PAIRS", 10)
    with pytest.raises(ValueError):
        matching.hungarian(df)


def test_threshold_search(spark):
    rows = [(f"p{i}", f"e{j}", 0.5 + 0.01 * ((i * 7 + j) % 50)) for i in range(12) for j in range(i, min(i + 3, 12))]
    df = spark.createDataFrame(rows, "plain string, enc string, score double")
    t = matching.threshold_search(df, 4, 8)
    assert 0 <= matching.largest_component(df, t) <= 8


def test_graph_features(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.5), ("b", "c", 0.7), ("c", "d", 0.95)], "src string, dst string, sim double")
    nodes = spark.createDataFrame([(x, [x]) for x in "abcde"], "node string, entities array<string>")
    f = {r.node: r for r in graph.basic_features(nodes, edges, [0.6]).collect()}
    assert f["a"]["degree_60"] == 1 and f["a"].max_sim == 0.9 and f["e"]["degree_60"] == 0 and f["e"].max_sim == 0
    ego = {r.node: (r.egonet_degree, round(r.egonet_density, 6)) for r in graph.egonets(edges).collect()}
    assert ego["a"] == (1, 1.0) and ego["d"] == (2, 1.0) and ego["c"] == (0, round(4 / 6, 6))
    assert {r.node for r in graph.without_singletons(nodes, edges).collect()} == set("abcd")
    assert graph.large_components(edges, 4).count() == 0 and graph.large_components(edges, 3).count() == 4
    rank = graph.pagerank(edges, tolerance=1e-3).collect()
    assert sum(r.pagerank for r in rank) == pytest.approx(1.0) and max(rank, key=lambda r: r.pagerank).node == "c"
    eigen = graph.eigenvector(edges).collect()
    assert max(eigen, key=lambda r: r.eigenvector).node == "c"
    central = {r.node: r for r in graph.path_centralities(edges).collect()}
    assert central["c"].closeness == pytest.approx(1.0) and central["c"].betweenness == pytest.approx(2 * 2 / (3 * 2)) and central["a"].betweenness == 0
    assert central["c"].degree_centrality == 2.0 and central["a"].degree_centrality == pytest.approx(4 / 3)
    with pytest.raises(RuntimeError):
        graph.pagerank(edges, rounds=3)
    star = spark.createDataFrame([("h", x, 0.9) for x in "pqrs"], "src string, dst string, sim double")
    score = {r.node: r.eigenvector for r in graph.eigenvector(star, tolerance=1e-3).collect()}
    assert score["h"] == pytest.approx(2**-0.5, abs=2e-3) and score["p"] == pytest.approx(8**-0.5, abs=2e-3)
    near = {r.node: r.pagerank for r in graph.pagerank(star, tolerance=0.05).collect()}
    assert near["h"] == pytest.approx(0.475676, abs=0.05)  # 0.03 + 0.85 * 4 l, l = 0.03 + 0.85 h / 4
    wide = {r.node: r for r in graph.node_features(nodes, edges, [0.0, 0.6], kinds=("basic", "histograms", "egonets", "paths")).collect()}
    assert wide["a"].egonet_degree_0 == 1 and wide["a"].degree_histo1_1_0 == 2 and wide["a"].degree_histo2_0_0 == 1 and wide["e"].closeness == 0
    assert wide["c"].betweenness == central["c"].betweenness and len(wide) == 5
    row = graph.characteristics(nodes, edges, [0.6, 0.99]).orderBy("threshold").collect()
    assert [(r.edges, r.singletons, r.components, r.largest) for r in row] == [(3, 1, 2, 4), (0, 5, 5, 1)]


def test_dice_candidates(spark):
    """No pair of the similarity is lost, whatever the parts of a block; sets of repeated elements and empty sets do not harm."""
    draw = random.Random(4)
    sets = {f"k{i}": [draw.choice("abcdefghijkl") for _ in range(draw.randint(0, 9))] for i in range(60)}
    sets["k60"], sets["k61"], sets["k62"] = sets["k3"], sets["k3"], [None, "a"]
    df = spark.createDataFrame(list(sets.items()), "node string, items array<string>")
    want = set()
    for (x, a), (y, b) in itertools.combinations(sets.items(), 2):
        if a and b and 2 * len(set(a) & set(b)) / (len(a) + len(b)) >= 0.7:
            want.add((min(x, y), max(x, y)))
    assert len(want) > 5
    for rows in (1_000, 3):
        got = [(r.src, r.dst) for r in blocking.dice_candidates(df, "node", "items", 0.7, rows).collect()]
        assert want <= set(got) and len(got) == len(set(got)) < 60 * 61 / 2 and all(x < y for x, y in got)
    words = df.select("node", F.array_distinct("items").alias("items"), blocking.sketch(F.col("items")).alias("s")).collect()
    for a, b in itertools.combinations(words, 2):
        assert sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) + 2**64).bit_count() for x, y in zip(a.s, b.s, strict=True)) <= len(set(a["items"]) ^ set(b["items"]))
    assert blocking.dice_candidates(df.limit(0), "node", "items", 0.7).count() == 0


def test_path_centralities_by_levels(spark):
    """Components beyond most_nodes, in one or several blocks of sources, against the solver of small ones."""
    rows = [(a, b) for a in range(14) for b in range(a + 1, 14) if b == a + 1 or (a % 3 == 0 and b == a + 4)] + [(20, 21), (21, 22), (22, 23), (23, 24), (30, 31)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 0.5) for a, b in rows], "src string, dst string, sim double")
    columns = ("closeness", "betweenness", "degree_centrality")
    want = {r.node: [r[c] for c in columns] for r in graph.path_centralities(edges).collect()}
    assert sum(w[1] > 0 for w in want.values()) > 5
    for state_rows in (1_000, 60):
        got = {r.node: [r[c] for c in columns] for r in graph.path_centralities(edges, most_nodes=3, state_rows=state_rows).collect()}
        assert got.keys() == want.keys()
        for node, values in got.items():
            assert values == pytest.approx(want[node]), node


def test_path_centralities_by_sources(spark, monkeypatch):
    """Components beyond most_nodes have their sources dealt out while most_edges allows; all three plans agree, loops and an edge named twice too."""
    draw = random.Random(5)
    rows = [(a, b) for a in range(40) for b in range(a + 1, 40) if draw.random() < 0.07 or b == a + 1] + [(50, 51), (60, 61), (61, 62), (70, 70), (0, 1)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 0.5) for a, b in rows], "src string, dst string, sim double")
    columns = ("closeness", "betweenness", "degree_centrality")
    got = lambda **k: {r.node: [r[c] for c in columns] for r in graph.path_centralities(edges, **k).collect()}
    want, joined = got(), got(most_nodes=3, most_edges=0, state_rows=5_000)
    monkeypatch.setattr(graph, "_paths_by_levels", None)
    dealt = got(most_nodes=2)
    assert want.keys() == joined.keys() == dealt.keys()
    for node, values in want.items():
        assert joined[node] == pytest.approx(values) and dealt[node] == pytest.approx(values), node


def test_neighbourhoods_in_numbers(spark):
    """Degree histograms and egonets in tasks that have the graph, against joins, nodes without a near neighbour and several blocks too."""
    draw = random.Random(6)
    rows = [(f"n{a}", f"n{b}", round(draw.random(), 2)) for a, b in itertools.combinations(range(10, 50), 2) if draw.random() < 0.12] + [("x", "y", 0.1)]
    edges = spark.createDataFrame(rows, "src string, dst string, sim double")
    g = graph.numbered(graph.both_ways(edges))
    for t in (0.0, 0.6):
        for f in (graph.degree_histograms, graph.egonets):
            want, got = (sorted(tuple(r) for r in f(edges, t, x).collect()) for x in (None, g))
            assert want and len(got) == len(want)
            for x, y in zip(got, want, strict=True):
                assert x[:-1] == y[:-1] and x[-1] == pytest.approx(y[-1])


def test_degree_centrality_needs_no_paths(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.5), ("b", "c", 0.7), ("c", "d", 0.95)], "src string, dst string, sim double")
    want = {r.node: r.degree_centrality for r in graph.path_centralities(edges).collect()}
    assert {r.node: r.degree_centrality for r in graph.degree_centrality(edges).collect()} == pytest.approx(want)
    assert graph.degree_centrality(edges.limit(0)).count() == 0
    monkeypatch.setattr(graph, "path_centralities", None)
    assert __import__("__spark_entry__").queries()["degree_centrality"](spark, "/root/testdata/sf0.001").count() > 0


def test_walks_and_vectors(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.7), ("c", "a", 0.8)], "src string, dst string, sim double")
    walks = graph.random_walks(edges, walks=3, length=5).collect()
    assert len(walks) == 9 and all(len(r.path) == 5 and all(x != y for x, y in itertools.pairwise(r.path)) for r in walks)
    assert graph.node_vectors(edges, size=4, walks=2, length=4).count() == 3


def test_features_choice_and_hashes(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 1.0, 7.0)], "node string, x double, y double")
    assert graph.chosen_features(df, ["x", "y"], "nonzero") == ["y"] and graph.chosen_features(df, ["x", "y"], "top", 1) == ["y"] and graph.chosen_features(df, ["x", "y"], "least", 1.0) == ["y"]
    signed = graph.sim_hashes(graph.vector(df, ["x", "y"]), 2, 16).collect()
    assert all(len(r.signature) == 16 for r in signed)
    same = spark.createDataFrame([([0, 1, 1, 0], [0, 1, 0, 0])], "a array<int>, b array<int>").select(blocking.signature_similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert same.s == 0.75


def test_minhash_blocks(spark):
    assert round(blocking.band_probability(0.5, 4, 50), 5) == 0.96032 and round(blocking.band_probability(0.6, 4, 50), 5) == 0.99903
    df = spark.createDataFrame([("a", ["xy", "yz", "zw"]), ("b", ["xy", "yz", "zw"]), ("c", []), ("d", ["qq"])], "node string, grams array<string>")
    blocks = blocking.minhash_blocks(df, "node", "grams")
    assert blocks.count() == 150
    pairs = {(r.src, r.dst) for r in blocking.candidate_pairs(blocks, "node").collect()}
    assert ("a", "b") in pairs and not any("c" in p for p in pairs)
    import zlib

    coefficients = blocking.minhash_coefficients(8)
    want = [min((a * zlib.crc32(g.encode()) + b) % blocking.PRIME for g in ("xy", "yz", "zw")) for a, b in coefficients]
    assert df.select(blocking.minhash_signature(F.col("grams"), 8).alias("s")).first().s == want


def test_statistics(spark):
    df = spark.createDataFrame([("p1", "e1", 0.5, True), ("p2", "e2", 0.9, False), ("p3", "e3", 0.7, True)], "plain string, enc string, score double, ok boolean")
    got = {r.top: (r.n, r.right) for r in statistics.ranked_accuracy(df, "score", "ok", ["plain", "enc"], (1, 2)).collect()}
    assert got == {1: (1, 0), 2: (2, 1), None: (3, 2)}
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["c"],)], "grams array<string>")
    model = {tuple(r.included): (r.n, r.gram, r.n_gram) for r in statistics.language_model(rows, ["a", "b"], "tuple").collect()}
    assert model == {("a", "b"): (2, "c", 1)}
    assert statistics.smallest_mode(spark.createDataFrame([(3,), (2,), (3,), (2,), (5,)], "k int"), "k") == 2
    blocks = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 4)], "block string, id int")
    r = statistics.block_summary(blocks).first()
    assert (r.least, r.most, r.pairs) == (1, 3, 3)
    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [2.0])], "node int, features array<double>")
    assert [r.node for r in statistics.without_frequent(vectors, 1).collect()] == [3]
    assert statistics.uniqueness(vectors).first()[0] == pytest.approx(2 / 3)
    assert statistics.common_share(rows.select(F.explode("grams").alias("g")), spark.createDataFrame([("a",), ("z",)], "g string"), "g") == 40.0
    m = statistics.measure_summary(spark.createDataFrame([(1.0,), (0.5,)], "recall double"), ["recall"]).first()
    assert (m.least, m["mean"], m.most) == (0.5, 0.75, 1.0) and m.share_one == pytest.approx(50.0, abs=0.01)


def test_balanced_filters_are_made_once_a_value(spark):
    rows = [(str(i), ("anna", "bo", "", None, "carla")[i % 5]) for i in range(40)]
    df = spark.createDataFrame(rows, "rec_id string, a string")
    e = encoders.Encoding(("a",), 2, False, 64, 3, harden="balance")
    seen = []

    def make(x):
        seen.append(x.count())
        return encoders.encode(x, e)

    want = {r.rec_id: r.bits for r in encoders.encode(df, e).collect()}
    assert all(b == sorted(set(b)) and len(b) == 64 for b in want.values())
    for most in (100, 3):  # beyond the bound each row is worked out
        got = encoders.per_value(df, ["a"], make, most)
        assert got.columns == ["rec_id", "a", "bits"] and {r.rec_id: r.bits for r in got.collect()} == want
    assert seen == [5, 40]


def test_sampled_weights(spark):
    """Against counting, by row and by value with the number of its records; more samples than a word holds, pairs and triples."""
    rng = random.Random(8)
    rows = [(sorted(rng.sample(range(30), rng.randint(0, 25))), rng.randint(1, 4)) for _ in range(40)]
    df = spark.createDataFrame(rows, "bits array<int>, n long")
    each = df.select("bits", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    for size in (2, 3):
        hits = [[(len(set(c) & set(b)), n) for b, n in rows] for c in statistics.sampled_positions(30, size, 50, 42)]
        both, odd = ([sum(n for h, n in of if ok(h)) for of in hits] for ok in (lambda h: h == size, lambda h: h % 2))
        want = [np.mean(both), np.std(both), np.mean(odd), np.std(odd)]
        assert list(statistics.sampled_weights(each, 30, size, 50).first()) == pytest.approx(want)
        assert list(statistics.sampled_weights(df, 30, size, 50, count="n").first()) == pytest.approx(want)


def test_guess_accuracy(spark):
    rows = [(1, "a b", "a b", 3, 1, 9), (2, "a b", "a c", 3, 1, 9), (2, "a b", "x", 30, 1, 9), (3, "q", None, None, 1, 9)]
    df = spark.createDataFrame(rows, "rec_id int, true_value string, value string, n_grams int, lower int, upper int")
    got = {(r["filter"], r.outcome): r.n for r in evaluate.guess_accuracy(df).collect()}
    assert got == {("all", "1-1 exact"): 1, ("all", "1-m partial"): 1, ("all", "no_guess"): 1, ("length", "1-1 exact"): 1, ("length", "1-1 partial"): 1, ("length", "no_guess"): 1}
    assert evaluate.reduction_ratio(df).first()[0] == 0.25


def test_sources(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("id;name;city\nr-1-x; Anna ;Rome\nr-2-x;removed;Oslo\nr-3-x;Bo;\nr-1-x;Ann;Rome\n")
    df = tables.read_delimited(spark, str(tmp_path / "a.csv.gz"), "';'")
    recs = tables.records(df, 0, [1, "city"], salt=2)
    assert sorted((r.rec_id, r.rec_val, r.salt) for r in recs.collect()) == [("1", "ann rome", "rome"), ("1", "anna rome", "rome"), ("3", "bo ", "")]
    assert tables.last_of_each_id(recs).count() == 2
    assert tables.graph_records(df, 0, [1], [1], limit=2).count() == 2
    (tmp_path / "t.txt").write_text("a b a\n\n c  d \n")
    assert sorted(tuple(sorted(r["items"])) for r in tables.transactions(spark, str(tmp_path / "t.txt")).collect()) == [("a", "b"), ("c", "d")]
    for x in (recs, recs):
        tables.append_csv(x, str(tmp_path / "out"))
    assert tables.read_delimited(spark, str(tmp_path / "out")).count() == 6
    assert [tables.delimiter(x) for x in ("tab", ",", "'|'")] == ["\t", ",", "|"]
    with pytest.raises(ValueError):
        tables.delimiter("ab")
    sets = tables.Datasets(spark)
    sets.add("people", str(tmp_path / "a.csv.gz"), ";", ["id", "name"])
    assert sets.names() == ["people"] and spark.table("people").columns == ["id", "name"]
    sets.drop("people")
    assert tables.status_row(spark, "mining", "no tuple", k=3).first().stop_reason == "no tuple"
    f = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "node string, x double")
    tables.write_features(f, str(tmp_path / "f"))
    assert tables.read_features(spark, str(tmp_path / "f"))[1] == {"x": (1.0, 3.0)}
    tables.write_graph(f, f, str(tmp_path), "g")
    assert tables.read_graph(spark, str(tmp_path), "g")[0].count() == 2


def test_bit_columns(spark):
    df = spark.createDataFrame([(f"r{i:03d}", [i % 3, 5]) for i in range(50)], "rec_id string, bits array<int>")
    got = {r.pos: r.n for r in tables.bit_columns(df).select("pos", F.expr("bitmap_count(bitmap)").alias("n")).collect()}
    assert got == {0: 17, 1: 17, 2: 16, 5: 50}
    rows = tables.numbered(df, "rec_id").collect()
    assert {r.rec_id: r.row for r in rows} == {f"r{i:03d}": i for i in range(50)}


def test_stream_encodes_like_a_table(spark, tmp_path):
    from linkveil.operators.encoders import Encoding, encode
    from linkveil.streaming.encode import encode_stream

    df = spark.createDataFrame([("1", "anna"), ("2", "bo")], "rec_id string, a string")
    df.write.parquet(str(tmp_path / "in"))
    e = Encoding(("a",), 2, False, 64, 3)
    q = encode_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), e, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(encode(df, e).collect())


def test_calibration(spark):
    rng = random.Random(2)
    rows = [(x := rng.random(), rng.randrange(5, 30), 0.8 * x + 0.1) for _ in range(300)]
    df = spark.createDataFrame(rows, "plain_sim double, union_size int, enc_sim double")
    for kind in ("linear", "isotonic", "poly"):
        _, metrics = graph.calibration(df, kind)
        assert metrics.first().r2 > 0.99
