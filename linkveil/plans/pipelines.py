"""The three analyses as pipelines (P8-P10): encode, analyse, score."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkveil.functions import columns as c
from linkveil.operators import blocking, encoders, evaluate, frequency, graph, matching, mining
from linkveil.operators.statistics import ranked_accuracy
from linkveil.session import materialize
from linkveil.sources.tables import status_row


@dataclass(frozen=True)
class FrequencyParams:
    encoding: encoders.Encoding
    least: int = 100
    tops: tuple[int, ...] = (100, 50, 20, 10)


def frequency_analysis(encoded: DataFrame, plain: DataFrame, p: FrequencyParams) -> DataFrame:
    """(top, aligned, exact, correct, wrong, no_guess) for every N of values tried. Both sides: rec_id, value and the attributes."""
    bits = materialize(encoders.encode(encoded, p.encoding).select("rec_id", "value", "bits"), "encoded")
    aligned = materialize(frequency.align(bits.select(frequency.pattern(F.col("bits")).alias("bits")), plain.select("value"), p.least), "aligned")
    n = aligned.count()
    if not n:
        return status_row(plain.sparkSession, "frequency", "no alignment", least=p.least)
    weights = materialize(frequency.position_weights(aligned, p.encoding.length, p.encoding.q), "weights")
    out = None
    for top in p.tops:
        # the list of alignments is cut to the first `top` ranks anew for every N
        own = weights if n <= top else frequency.position_weights(aligned.where(F.col("rank") < top), p.encoding.length, p.encoding.q)
        got = frequency.guess_counts(frequency.reconstruct(bits.select(F.col("rec_id").alias("enc_id"), "bits", F.col("value").alias("true_value")), own, plain.select("value"), top))
        one = got.select(F.lit(top).alias("top"), F.lit(min(n, top)).alias("aligned"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class MiningParams:
    encoding: encoders.Encoding
    stop_percent: float = 1.0
    stop_percent_model: float = 5.0
    least_part: int = 10_000
    most_many: int = 10
    model: str = "single"
    model_least: int = 5
    method: str = "maximal"
    reident: tuple[str, ...] = ("bf_tuple", "set_inter")


def mining_analysis(encoded: DataFrame, plain: DataFrame, p: MiningParams) -> dict[str, DataFrame | mining.Found]:
    """What partition search and language-model expansion find, scored by the truth and by re-identification."""
    e = p.encoding
    grams = F.array_distinct(F.flatten(F.array(*[encoders.attribute_grams(e, a) for a in e.attributes])))
    known = materialize(plain.select("rec_id", "value", grams.alias("grams")), "plain-grams")
    bits = materialize(encoders.encode(encoded, e).select("rec_id", "value", "bits"), "encoded")
    found = mining.partition_search(known, bits, p.stop_percent, p.least_part, method=p.method)
    spark = plain.sparkSession
    if not found.tuples:
        return {"found": found, "status": status_row(spark, "mining", found.stop_reason)}
    more = mining.expand(found, known, bits, p.model, p.stop_percent_model, p.model_least, p.method)
    positions = {g: set(s) for g, s in found.positions.items()}
    for g, s in more.positions.items():
        positions.setdefault(g, set()).update(s)
    truth = encoders.true_positions(plain, e) if e.harden != "rule90" else None
    out: dict[str, DataFrame | mining.Found] = {"found": found, "expanded": more}
    if truth is not None:
        guessed = spark.createDataFrame([(g, int(x)) for g, s in positions.items() for x in s], "gram string, pos int")
        hits = guessed.join(truth.withColumn("hit", F.lit(True)), ["gram", "pos"], "left")
        real = truth.groupBy("gram").agg(F.count("*").alias("true_n"))
        out["positions"] = hits.groupBy("gram").agg(F.count("*").alias("n"), F.count("hit").alias("right")).join(real, "gram", "left").select(
            "gram", (F.col("right") / F.col("n")).alias("precision"), (F.col("right") / F.col("true_n")).alias("recall")
        )
    assigned = materialize(mining.assignments(bits, positions), "assigned")
    lower, estimate, upper = c.gram_count_bounds(F.size("bits"), e.length, mining.estimated_k(found))
    bounds = bits.select("rec_id", F.col("value").alias("true_value"), lower.alias("lower"), upper.alias("upper"))
    values = known.groupBy("value").agg(F.first("grams").alias("grams"))
    for method in p.reident:
        got = mining.set_intersection(assigned, values) if method == "set_inter" else mining.tuple_match(assigned, positions, values).select("rec_id", "value")
        sized = values.select("value", F.size("grams").alias("n_grams"))
        guesses = bounds.join(got, "rec_id", "left").join(sized, "value", "left")
        out[method] = evaluate.guess_accuracy(guesses, p.most_many)
        out[f"{method}_reduction"] = evaluate.reduction_ratio(guesses.where("value is not null"))
    return out


@dataclass(frozen=True)
class GraphParams:
    """A profile of the graph analysis; profiles differ by data set."""

    encoding: encoders.Encoding
    min_sim: float = 0.2
    thresholds: tuple[float, ...] = (0.3, 0.6)
    min_degree: int = 5
    sim_hash_bits: int = 500
    samples: int = 20
    sample_size: int = 50
    least_cosine: float = 0.9
    tolerance: tuple[float, float] = (0.01, 0.25)
    matchers: tuple[str, ...] = ("symmetric", "greedy")
    weights: tuple[tuple[float, float, float], ...] = graph.WEIGHT_SETS
    blocking: str = "grams"  # grams: by the true q-grams, as an evaluator knows them; bits: by the filters alone
    similarity: str = "dice"
    features: tuple[str, ...] = ("basic", "histograms", "egonets")
    calibrate: str = "none"  # none | linear | poly | isotonic
    seed: int = 42
    at_once: int = 8  # matchers that run side by side


#: Profiles by kind of data set: the least degree and the length of signatures.
PROFILES = {"passenger": (5, 500), "titanic": (3, 500), "voter": (5, 1000), "euro": (20, 500)}


def _side(df: DataFrame, p: GraphParams, encoded: bool) -> tuple[DataFrame, DataFrame]:
    e = p.encoding
    grams = F.array_distinct(F.flatten(F.array(*[encoders.attribute_grams(e, a) for a in e.attributes])))
    rows = encoders.encode(df, e).withColumn("grams", grams).where(F.size("grams") > 0)
    key = frequency.pattern(F.col("bits")) if encoded else F.array_join(F.array_sort("grams"), "|")
    keyed = rows.select(F.sha2(key, 256).alias("node"), "rec_id", "value", "grams", "bits")
    nodes = materialize(keyed.groupBy("node").agg(F.array_sort(F.collect_set("rec_id")).alias("entities"), F.array_sort(F.collect_set("value")).alias("values"), F.first("grams").alias("grams"), F.first("bits").alias("bits")), "nodes")
    blocks = blocking.minhash_blocks(nodes, "node", "grams") if p.blocking == "grams" or not encoded else blocking.hamming_blocks(nodes, "node", "bits", e.length, p.samples, p.sample_size, p.seed)
    pairs = blocking.candidate_pairs(materialize(blocks, "blocks"), "node")
    edges = blocking.similarity_join(pairs, nodes, "node", "bits" if encoded else "grams", c.SIMILARITIES[p.similarity], p.min_sim)
    return nodes, materialize(edges, "edges")


def calibrated(nodes: DataFrame, edges: DataFrame, p: GraphParams) -> DataFrame:
    """Plain edges with the similarity that their filters are expected to have; those below min_sim go.

    nodes have the q-grams and the filters of the plain values, which the analyst can encode.
    """
    a = nodes.select(F.col("node").alias("src"), F.col("grams").alias("ga"), F.col("bits").alias("ba"))
    b = nodes.select(F.col("node").alias("dst"), F.col("grams").alias("gb"), F.col("bits").alias("bb"))
    pairs = edges.join(a, "src").join(b, "dst").select(
        "src", "dst", F.col("sim").alias("plain_sim"), F.size(F.array_union("ga", "gb")).cast("double").alias("union_size"), c.SIMILARITIES[p.similarity](F.col("ba"), F.col("bb")).alias("enc_sim")
    )
    pairs = materialize(pairs, "calibration-pairs")
    model, _ = graph.calibration(pairs, p.calibrate, seed=p.seed)
    guess = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("guess")))
    return model.transform(graph.calibration_features(pairs, p.calibrate)).select("src", "dst", guess.alias("sim")).where(F.col("sim") >= p.min_sim)


def graph_analysis(encoded: DataFrame, plain: DataFrame, p: GraphParams) -> DataFrame:
    """P10: (matcher, weights, top, n, right) of matching the nodes of the two similarity graphs by their features."""
    nodes_p, edges_p = _side(plain, p, False)
    nodes_e, edges_e = _side(encoded, p, True)
    if p.calibrate != "none":
        edges_p = materialize(calibrated(nodes_p, edges_p, p), "calibrated")
    edges_p, edges_e = (materialize(graph.large_components(x, p.min_degree), "large") for x in (edges_p, edges_e))
    buckets = graph.bucket_count(edges_p, edges_e)
    f_p, f_e = (graph.node_features(n, x, list(p.thresholds), p.min_degree, p.features, buckets) for n, x in ((nodes_p, edges_p), (nodes_e, edges_e)))
    names = [x for x in f_p.columns if x != "node"]
    f_p, f_e = (materialize(x, "features") for x in graph.normalised(materialize(f_p, "raw"), materialize(f_e, "raw"), names))
    names = graph.chosen_features(f_p.unionByName(f_e), names, "nonzero")
    if not names:
        return status_row(plain.sparkSession, "graph", "no feature tells nodes apart")
    v_p, v_e = graph.vector(f_p, names), graph.vector(f_e, names)
    s_p, s_e = (materialize(graph.sim_hashes(v, len(names), p.sim_hash_bits, p.seed), "signatures") for v in (v_p, v_e))
    b_p, b_e = (blocking.hamming_blocks(s.select("node", graph.set_bits(F.col("signature")).alias("set")), "node", "set", p.sim_hash_bits, p.samples, p.sample_size, p.seed) for s in (s_p, s_e))
    pairs = blocking.edge_tolerant(blocking.cross_pairs(b_p, b_e, "node", "node"), edges_p, edges_e, p.min_sim, *p.tolerance)
    pairs = materialize(blocking.cross_join_signatures(s_p, s_e, pairs, 0.5).select("plain", "enc"), "pairs")
    a, b = v_p.select(F.col("node").alias("plain"), F.col("features").alias("x")), v_e.select(F.col("node").alias("enc"), F.col("features").alias("y"))
    cosines = pairs.join(a, "plain").join(b, "enc").select("plain", "enc", c.angle_similarity(F.col("x"), F.col("y")).alias("cos")).where(F.col("cos") >= p.least_cosine)
    cosines = materialize(cosines, "cosines")
    scored = {w: materialize(graph.confidences(cosines, w), "scored").select("plain", "enc", "score") for w in p.weights}

    def run(weights: tuple[float, ...], name: str) -> DataFrame:
        got = materialize(matching.MATCHERS[name](scored[weights]), "matches")
        judged = evaluate.match_truth(got, nodes_p, nodes_e)
        return ranked_accuracy(judged, "score", "same", ["plain", "enc"]).select(F.lit(name).alias("matcher"), F.lit(str(weights)).alias("weights"), "top", "n", "right")

    # matchers wait for many small jobs one after another: those of several run side by side
    with ThreadPoolExecutor(max_workers=p.at_once) as pool:
        parts = list(pool.map(run, *zip(*[(w, m) for w in p.weights for m in p.matchers], strict=True)))
    return reduce(DataFrame.unionByName, parts)
