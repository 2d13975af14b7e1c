"""Queries of the operators that linkveil.plans.registry does not reach, registered there under names of their own.

Sinks and sources are written and read back; where that holds a table that a query of the registry returns too, its SQL is the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linkveil.functions import columns as c
from linkveil.operators import blocking, encoders, evaluate, graph, matching, mining, statistics
from linkveil.plans import pipelines
from linkveil.plans import registry as r
from linkveil.plans.registry import K, L, ORACLE, P, Q, QUERIES, RG, flagship, query, r6  # noqa: F401
from linkveil.session import materialize, new_path
from linkveil.sources import tables

# -- sources and sinks


@query("graph_loader", f"WITH {P} SELECT rec_id, a0 || ' ' || a2 || ' ' || a1 AS rec_val, {r.soundex_sql('a0')} AS code FROM p")
def graph_loader(spark, d):
    """S2, F8."""
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    return tables.graph_records(part, 0, ["p_name", "p_brand", "p_type"], ["p_name"]).select("rec_id", "rec_val", "code")


@query("csv_round_trip", f"WITH {P} SELECT rec_id, a0, salt FROM p")
def csv_round_trip(spark, d):
    """Two appends of delimited text, read with a quoted delimiter."""
    path, rows = new_path(spark, "csv"), r.plain(spark, d).select("rec_id", "a0", "salt")
    for half in (0, 1):
        tables.append_csv(rows.where(f"cast(rec_id as long) % 2 = {half}"), path)
    return tables.read_delimited(spark, path, "','")


@query("parquet_round_trip", f"WITH {P} SELECT rec_id, a0, salt FROM p")
def parquet_round_trip(spark, d):
    """S4."""
    path, rows = new_path(spark, "parquet"), r.plain(spark, d).select("rec_id", "a0", "salt")
    for half in (0, 1):
        tables.append_parquet(rows.where(f"cast(rec_id as long) % 2 = {half}"), path)
    return spark.read.parquet(path)


@query("stop_reasons", "SELECT * FROM (VALUES ('frequency', 'no alignment'), ('mining', 'no rows')) t(analysis, stop_reason)")
def stop_reasons(spark, d):
    """What analyses return that find nothing."""
    none = pipelines.frequency_analysis(r.encoded(spark, d), r.plain(spark, d), pipelines.FrequencyParams(r.E_NAME, 1 << 30))
    empty = pipelines.mining_analysis(r.encoded(spark, d).limit(0), r.plain(spark, d), pipelines.MiningParams(r.E_NAME))["status"]
    return none.select("analysis", "stop_reason").unionByName(empty.select("analysis", "stop_reason"))


@query("graph_round_trip", f"WITH {r.SIMS} SELECT src, dst, round(sim, 6) AS sim FROM ed WHERE src IN (SELECT node FROM nv)")
def graph_round_trip(spark, d):
    """S7."""
    folder = new_path(spark, "graphs")
    tables.write_graph(r.name_values(spark, d), r.name_edges(spark, d), folder, "dice-75")
    nodes, edges = tables.read_graph(spark, folder, "dice-75")
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst", r6("sim").alias("sim"))


@query("features_round_trip", f"WITH {r.BOTH}, f AS (SELECT node, max(sim) AS m, count(*) AS d FROM bw GROUP BY node) SELECT kind, count(*) AS n, round(min(m), 6) AS m0, round(max(m), 6) AS m1, CAST(min(d) AS DOUBLE) AS d0, CAST(max(d) AS DOUBLE) AS d1 FROM f, (SELECT unnest(['parquet', 'csv']) AS kind) GROUP BY kind")
def features_round_trip(spark, d):
    """Parquet and delimited text, with ranges computed anew."""
    f = graph.both_ways(r.name_edges(spark, d)).groupBy("node").agg(F.max("sim").alias("m"), F.count("*").cast("double").alias("d"))
    a, b = new_path(spark, "features"), new_path(spark, "features-csv")
    tables.write_features(f, a)
    tables.write_features_csv(f, b)
    df, span = tables.read_features(spark, a)
    back = tables.read_features_csv(spark, b, ["m", "d"])
    rows = [("parquet", df.count(), *(round(float(x), 6) for x in (*span["m"], *span["d"])))]
    one = back.agg(F.count("*").alias("n"), *[r6(f(x)).alias(f"{x}{k}") for x in ("m", "d") for k, f in ((0, F.min), (1, F.max))])
    return spark.createDataFrame(rows, "kind string, n long, m0 double, m1 double, d0 double, d1 double").unionByName(one.select(F.lit("csv").alias("kind"), "n", "m0", "m1", "d0", "d1"))


@query("model_round_trip", f"WITH {r.bits_sql(['a0'])}, y AS (SELECT rec_id, count(*) AS y FROM b GROUP BY rec_id), xy AS (SELECT CAST(length(a0) AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM p JOIN y USING (rec_id)) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS start FROM xy")
def model_round_trip(spark, d):
    """A saved and loaded regression of a filter's 1-bits on its value's length."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = encoders.encode(r.plain(spark, d), r.E_NAME).select(F.char_length("a0").cast("double").alias("l"), F.size("bits").cast("double").alias("y"))
    rows = VectorAssembler(inputCols=["l"], outputCol="x").transform(materialize(rows, "sizes"))
    path = new_path(spark, "model")
    tables.save_model(LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(rows), path)
    model = tables.load_model("linear", path)
    return spark.createDataFrame([(round(float(model.coefficients[0]), 6), round(float(model.intercept), 6))], "slope double, start double")


@query("transactions", f"WITH {RG} SELECT items, count(*) AS n FROM (SELECT rec_id, string_agg(gram, ' ' ORDER BY gram) AS items FROM g WHERE NOT contains(gram, ' ') GROUP BY rec_id) GROUP BY items")
def transactions(spark, d):
    """Q-gram sets as lines of text."""
    path = new_path(spark, "transactions")
    lines = r.with_grams(r.plain(spark, d)).select(F.array_join(F.filter(F.array_sort("grams"), lambda g: ~F.contains(g, F.lit(" "))), " ").alias("value"))
    lines.write.text(path)
    return tables.transactions(spark, path).groupBy(F.array_join(F.array_sort("items"), " ").alias("items")).agg(F.count("*").alias("n"))


@query("edge_histogram", f"WITH {r.SIMS} SELECT round(sim, 2) AS value, count(*) AS n FROM ed GROUP BY 1")
def edge_histogram(spark, d):
    """S11."""
    return tables.histogram(r.name_edges(spark, d), "sim", 2)


@query("edge_density", f"WITH {r.SIMS}, h AS (SELECT round(sim, 2) AS v, count(*) AS n FROM ed GROUP BY 1) SELECT a AS at, round(sum(n * exp(-pow((a - v) / 0.05, 2) / 2) / (0.05 * sqrt(2 * pi()))) / sum(n), 6) AS density FROM h, (SELECT CAST(unnest([0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]) AS DOUBLE) AS a) GROUP BY a")
def edge_density(spark, d):
    """The kernel estimate that a density plot draws."""
    return tables.density(r.name_edges(spark, d), "sim", [0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0], 0.05, 2).withColumn("density", r6("density"))


@query("regression_points", f"WITH {r.BITS} SELECT round(ed.sim, 2) AS x, round(fe.sim, 2) AS y, count(*) AS n FROM ed JOIN fe USING (src, dst) GROUP BY 1, 2")
def regression_points(spark, d):
    """Plain against encoded similarity."""
    both = blocking.edge_overlap(r.name_edges(spark, d), r.bit_edges(spark, d)).where("side = 'both'")
    return tables.regression_points(both, "sim_a", "sim_b", 2)


@query("datasets", "SELECT 'parts' AS name, p_type AS value, count(*) AS n FROM part GROUP BY p_type")
def datasets(spark, d):
    """A table that a user brings in, chooses columns of, and asks in SQL."""
    path, sets = new_path(spark, "dataset"), tables.Datasets(spark)
    tables.append_csv(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type"), path)
    sets.add("linkveil_parts", path, columns=["p_type"])
    sets.add("linkveil_other", path)
    sets.drop("linkveil_other")
    (name,) = sets.names()
    return spark.sql(f"SELECT substring('{name}', 10) AS name, p_type AS value, count(*) AS n FROM {name} GROUP BY p_type")


# -- functions


@query("record_grams", f"WITH {P}, g AS (SELECT DISTINCT rec_id, gram FROM (SELECT rec_id, unnest({r.grams_sql('a0')}) AS gram FROM p UNION ALL SELECT rec_id, unnest({r.grams_sql('a1')}) FROM p)) SELECT rec_id, string_agg(gram, '|' ORDER BY gram) AS grams FROM g GROUP BY rec_id")
def record_grams(spark, d):
    """F3, P2."""
    rows = r.plain(spark, d).select("rec_id", c.record_grams([F.col("a0"), F.col("a1")], Q).alias("grams")).where(F.size("grams") > 0)
    return rows.select("rec_id", F.array_join(F.array_sort("grams"), "|").alias("grams"))


@query("pair_similarities", f"WITH {r.BITS} SELECT ed.src AS src, ed.dst AS dst, round(cm.m / (x.n + y.n - cm.m), 6) AS jaccard, round(1 - (u.n + v.n - 2 * fm.m) / {L}.0, 6) AS hamming, CAST(ceil(round(ed.sim * 10, 9)) AS INTEGER) AS class FROM ed JOIN cm USING (src, dst) JOIN nn x ON x.node = src JOIN nn y ON y.node = dst JOIN fm USING (src, dst) JOIN fn u ON u.node = src JOIN fn v ON v.node = dst")
def pair_similarities(spark, d):
    """F7, F11."""
    n = materialize(encoders.encode(r.name_values(spark, d), encoders.Encoding(("v",), Q, False, L, 4)).select("node", "grams", "bits"), "values")
    a = n.select(F.col("node").alias("src"), F.col("grams").alias("ga"), F.col("bits").alias("ba"))
    b = n.select(F.col("node").alias("dst"), F.col("grams").alias("gb"), F.col("bits").alias("bb"))
    both = r.name_edges(spark, d).join(a, "src").join(b, "dst")
    return both.select("src", "dst", r6(c.jaccard(F.col("ga"), F.col("gb"))).alias("jaccard"), r6(c.hamming(F.col("ba"), F.col("bb"), L)).alias("hamming"), c.similarity_class(F.col("sim")).alias("class"))


VECTORS = f"{r.BOTH}, vc AS (SELECT node, max(sim) AS x, min(sim) AS y, avg(sim) AS z FROM bw GROUP BY node)"


def node_vectors(spark, d):
    f = graph.both_ways(r.name_edges(spark, d)).groupBy("node").agg(F.max("sim").alias("x"), F.min("sim").alias("y"), F.avg("sim").alias("z"))
    return materialize(graph.vector(f, ["x", "y", "z"]), "vectors")


@query("vector_similarities", f"WITH {VECTORS}, pr AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz, src, dst FROM ed JOIN vc a ON a.node = src JOIN vc b ON b.node = dst), cs AS (SELECT *, (ax * bx + ay * b_y + az * bz) / (sqrt(ax * ax + ay * ay + az * az) * sqrt(bx * bx + b_y * b_y + bz * bz)) AS co FROM pr) SELECT src, dst, round(co, 6) AS cosine, round(1 - acos(least(co, 1)) / pi(), 5) AS angle, round(sqrt(pow(ax - bx, 2) + pow(ay - b_y, 2) + pow(az - bz, 2)), 6) AS euclid, round((abs(ax - bx) + abs(ay - b_y) + abs(az - bz)) / 3, 6) AS sorted FROM cs")
def vector_similarities(spark, d):
    """F9, F10; the vector's parts are in descending order but for the mean, which is compared in its place."""
    v = node_vectors(spark, d)
    a, b = v.select(F.col("node").alias("src"), F.col("features").alias("a")), v.select(F.col("node").alias("dst"), F.col("features").alias("b"))
    x, y = F.col("a"), F.col("b")
    both = r.name_edges(spark, d).join(a, "src").join(b, "dst")
    return both.select("src", "dst", r6(c.cosine(x, y)).alias("cosine"), F.round(c.angle_similarity(x, y), 5).alias("angle"), r6(c.euclidean(x, y)).alias("euclid"), r6(c.sorted_difference(x, y)).alias("sorted"))


def _planes() -> str:
    import numpy as np

    planes = np.random.RandomState(42).randn(24, 3)
    return ", ".join(f"({i}, {', '.join(repr(float(x)) for x in p)})" for i, p in enumerate(planes))


@query("sim_hash", f"WITH {VECTORS}, pl(i, p, q, s) AS (VALUES {_planes()}) SELECT node, string_agg(CASE WHEN CAST(p AS DOUBLE) * x + CAST(q AS DOUBLE) * y + CAST(s AS DOUBLE) * z >= 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS signature FROM vc, pl GROUP BY node")
def sim_hash(spark, d):
    """F12, P3."""
    return graph.sim_hashes(node_vectors(spark, d), 3, 24).select("node", F.array_join("signature", "").alias("signature"))


@query("signature_pairs", f"WITH {VECTORS}, pl(i, p, q, s) AS (VALUES {_planes()}), sb AS (SELECT node, i, CAST(p AS DOUBLE) * x + CAST(q AS DOUBLE) * y + CAST(s AS DOUBLE) * z >= 0 AS b FROM vc, pl) SELECT a.node AS plain, b.node AS enc, round(1 - count(*) FILTER (a.b <> b.b) / 24.0, 6) AS sim FROM sb a JOIN sb b ON a.i = b.i JOIN ed ON ed.src = a.node AND ed.dst = b.node GROUP BY 1, 2 HAVING count(*) FILTER (a.b <> b.b) <= 2")
def signature_pairs(spark, d):
    """J14 over the pairs of an edge list."""
    s = graph.sim_hashes(node_vectors(spark, d), 3, 24)
    pairs = r.name_edges(spark, d).select(F.col("src").alias("plain"), F.col("dst").alias("enc"))
    return blocking.cross_join_signatures(s, s, pairs, 22 / 24 - 1e-9).withColumn("sim", r6("sim"))


@query("distinct_columns", f"SELECT {K} AS k, round(list_product(list_transform(range({2 * K}), lambda i: 1 - i / {L}.0)), 9) AS probability")
def distinct_columns(spark, d):
    """F14."""
    return spark.createDataFrame([(K, round(c.distinct_columns_probability(L, K), 9))], "k int, probability double")


@query("token_overlap", f"WITH {P} SELECT rec_id, round(len(list_intersect(string_split(rec_val, ' '), string_split(a0 || ' promo', ' '))) / len(list_distinct(string_split(rec_val, ' '))), 6) AS share FROM p")
def token_overlap(spark, d):
    """F15."""
    return r.plain(spark, d).select("rec_id", r6(c.token_overlap(F.col("rec_val"), F.concat("a0", F.lit(" promo")))).alias("share"))


# -- counting


@query("gram_count_mode", f"WITH {RG}, n AS (SELECT rec_id, count(*) AS n FROM g GROUP BY rec_id) SELECT CAST(n AS INTEGER) AS mode FROM n GROUP BY n ORDER BY count(*) DESC, n LIMIT 1")
def gram_count_mode(spark, d):
    """A11."""
    rows = r.with_grams(r.plain(spark, d)).select(F.size("grams").alias("n"))
    return spark.createDataFrame([(statistics.smallest_mode(rows, "n"),)], "mode int")


LENGTHS = f"{P}, lv AS (SELECT rec_id, length(a0) AS x, length(a1) AS y FROM p)"


def length_vectors(spark, d):
    return r.plain(spark, d).select("rec_id", F.array(F.char_length("a0"), F.char_length("a1")).alias("features"))


@query("uniqueness", f"WITH {LENGTHS} SELECT round(count(DISTINCT (x, y)) / count(*), 6) AS uniqueness FROM lv")
def uniqueness(spark, d):
    """A13."""
    return statistics.uniqueness(length_vectors(spark, d)).select(r6("uniqueness").alias("uniqueness"))


@query("rare_vectors", f"WITH {LENGTHS}, n AS (SELECT x, y FROM lv GROUP BY x, y HAVING count(*) <= 20) SELECT rec_id FROM lv JOIN n USING (x, y)")
def rare_vectors(spark, d):
    """A13."""
    return statistics.without_frequent(length_vectors(spark, d), 20).select("rec_id")


@query("measure_summary", f"WITH {P}, m AS (SELECT length(a1) / length(rec_val) AS v, 'recall' AS measure FROM p UNION ALL SELECT least(1, length(a0) / 10), 'precision' FROM p) SELECT measure, round(min(v), 6) AS least, round(avg(v), 6) AS mean, round(max(v), 6) AS most, round(100.0 * count(*) FILTER (v = 1) / (count(*) + 0.0001), 6) AS share_one FROM m GROUP BY measure")
def measure_summary(spark, d):
    """A15."""
    rows = r.plain(spark, d).select((F.char_length("a1") / F.char_length("rec_val")).alias("recall"), F.least(F.lit(1.0), F.char_length("a0") / 10).alias("precision"))
    got = statistics.measure_summary(rows, ["recall", "precision"])
    return got.select("measure", *[r6(x).alias(x) for x in ("least", "mean", "most", "share_one")])


@query("common_share", f"WITH {P}, {r.EN} SELECT round(200.0 * (SELECT count(*) FROM (SELECT DISTINCT rec_val FROM p INTERSECT SELECT DISTINCT rec_val FROM e)) / ((SELECT count(DISTINCT rec_val) FROM p) + (SELECT count(DISTINCT rec_val) FROM e)), 6) AS share")
def common_share(spark, d):
    """A17."""
    return spark.createDataFrame([(round(statistics.common_share(r.plain(spark, d), r.encoded(spark, d), "rec_val"), 6),)], "share double")


# -- candidates


@query("one_block", f"WITH {P}, v AS (SELECT DISTINCT a0 FROM p) SELECT x.a0 AS src, y.a0 AS dst FROM v x JOIN v y ON x.a0 < y.a0")
def one_block(spark, d):
    """Every pair of the names."""
    return blocking.candidate_pairs(blocking.one_block(r.plain(spark, d).select("a0").distinct(), "a0"), "a0")


@query("shared_blocks", f"WITH {P}, {r.EN} SELECT 'plain' AS side, count(*) AS n FROM p WHERE {r.soundex_sql('a0')} || salt IN (SELECT {r.soundex_sql('a0')} || salt FROM e) UNION ALL SELECT 'encoded', count(*) FROM e")
def shared_blocks(spark, d):
    """Blocks that have rows on both sides."""
    a, b = (x.select("rec_id", F.concat(c.soundex(F.col("a0")), "salt").alias("block")) for x in (r.plain(spark, d), r.encoded(spark, d)))
    x, y = blocking.shared_blocks(a, b)
    return x.agg(F.count("*").alias("n")).select(F.lit("plain").alias("side"), "n").unionByName(y.agg(F.count("*").alias("n")).select(F.lit("encoded").alias("side"), "n"))


@query("match_histogram")
def match_histogram(spark, d):
    """True matches are pairs of a value with itself; non-matches are drawn by a hash."""
    n = r.name_values(spark, d)
    true = n.select(F.col("node").alias("plain"), F.col("node").alias("enc"))
    return blocking.match_histogram(true, n, n, c.dice, "grams")


# -- mining


@query("maximal_sets", f"WITH RECURSIVE {r.SETS} SELECT array_to_string(items, ',') AS items, n FROM it WHERE NOT EXISTS (SELECT 1 FROM it z WHERE len(z.items) = len(it.items) + 1 AND list_has_all(z.items, it.items))")
def maximal_sets(spark, d):
    """M5: item sets of FP-growth that no other contains."""
    e = materialize(encoders.encode(r.plain(spark, d), r.E_SMALL).select("rec_id", "bits"), "small")
    found = mining.fp_growth(e, max(1, int(e.count() * 0.6)))
    return mining.maximal_only(materialize(found, "item-sets")).select(F.array_join(F.array_sort("items"), ",").alias("items"), F.col("freq").alias("n"))


@query("miners_agree", f"WITH RECURSIVE {r.SETS} SELECT array_to_string(items, ',') AS items, n, CAST(3 AS BIGINT) AS methods FROM it WHERE len(items) = (SELECT max(len(items)) FROM it)")
def miners_agree(spark, d):
    """M7: how many of the three searches (Apriori, maximal depth first, FP-growth) return each longest tuple with that support."""
    e = materialize(encoders.encode(r.plain(spark, d), r.E_SMALL).select("rec_id", "bits"), "small")
    least = max(1, int(e.count() * 0.6))
    rows = [(",".join(map(str, t)), int(n)) for m in ("apriori", "maximal", "fpgrowth") for t, n in mining.longest_tuples(e, least, method=m).items()]
    return spark.createDataFrame(rows, "items string, n long").groupBy("items", "n").agg(F.count("*").alias("methods"))


@query("position_scores")
def position_scores(spark, d):
    """Precision and recall of the positions that the mining analysis gave each q-gram."""
    p = pipelines.MiningParams(encoders.Encoding(("a0", "a1"), Q, False, L, 4), least_part=max(20, int(r.plain(spark, d).count() * 0.1)), model_least=2)
    got = pipelines.mining_analysis(r.encoded(spark, d), r.plain(spark, d), p)
    return got["positions"] if "positions" in got else got["status"].select(F.lit(None).cast("string").alias("gram"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"))


@query("bit_columns", f"WITH {r.bits_sql(['a0'])} SELECT pos, count(*) AS n FROM b GROUP BY pos")
def bit_columns(spark, d):
    """The 1-bits of each column's bitmaps."""
    got = tables.bit_columns(encoders.encode(r.plain(spark, d), r.E_NAME).select("rec_id", "bits"))
    return got.groupBy("pos").agg(F.sum(F.expr("bitmap_count(bitmap)")).alias("n"))


# -- graphs


@query("graph_nodes", f"WITH {P} SELECT a0 AS node, count(DISTINCT rec_id) AS entities, count(DISTINCT rec_val) AS values, min(rec_id) AS first FROM p GROUP BY a0")
def graph_nodes(spark, d):
    """G1, P5."""
    n = graph.nodes_of(r.plain(spark, d), "a0", "rec_id", "rec_val")
    return n.select("node", F.size("entities").cast("long").alias("entities"), F.size("values").cast("long").alias("values"), F.get("entities", F.lit(0)).alias("first"))


@query("graph_edges", f"WITH {r.BITS} SELECT src, dst, round(max(sim), 6) AS sim FROM (SELECT * FROM ed UNION ALL SELECT src, dst, sim FROM fe) GROUP BY 1, 2")
def graph_edges(spark, d):
    """Edges of two graphs, those of one from the other end."""
    turned = r.bit_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")
    return graph.edges_of(r.name_edges(spark, d).select("src", "dst", "sim").unionByName(turned)).withColumn("sim", r6("sim"))


@query("no_singletons", f"WITH {r.BOTH} SELECT DISTINCT node FROM bw WHERE sim >= 0.9")
def no_singletons(spark, d):
    """G4."""
    return graph.without_singletons(r.name_values(spark, d).select("node"), r.name_edges(spark, d).where("sim >= 0.9"))


@query("large_components", f"WITH RECURSIVE {r.BOTH}, hi AS (SELECT * FROM bw WHERE sim >= 0.9), cc AS (SELECT node, node AS reach FROM hi UNION SELECT cc.node, hi.other FROM cc JOIN hi ON hi.node = cc.reach), co AS (SELECT node, min(reach) AS k FROM cc GROUP BY node), bg AS (SELECT k FROM co GROUP BY k HAVING count(*) >= 4) SELECT src, dst FROM ed JOIN co ON co.node = src JOIN bg USING (k) WHERE sim >= 0.9")
def large_components(spark, d):
    """G5."""
    return graph.large_components(r.name_edges(spark, d).where("sim >= 0.9"), 3).select("src", "dst")


@query("chosen_features", f"WITH {VECTORS}, sd AS (SELECT stddev_pop(x) AS x, stddev_pop(y) AS y, stddev_pop(z) AS z FROM vc), al AS (SELECT unnest(['x', 'y', 'z']) AS name, unnest([x, y, z]) AS s FROM sd) SELECT 'nonzero' AS how, name FROM al WHERE s > 0 UNION ALL SELECT 'top', name FROM (SELECT name FROM al ORDER BY s DESC, name LIMIT 2) UNION ALL SELECT 'least', name FROM al WHERE s >= 0.03 UNION ALL SELECT 'all', name FROM al")
def chosen_features(spark, d):
    """G13."""
    f = node_vectors(spark, d).select(*[F.col("features")[i].alias(n) for i, n in enumerate("xyz")])
    rows = [(how, n) for how, v in (("nonzero", 0), ("top", 2), ("least", 0.03), ("all", 0)) for n in graph.chosen_features(f, list("xyz"), how, v)]
    return spark.createDataFrame(rows, "how string, name string")


def _eigen_sql(rounds: int) -> str:
    out = "v0 AS (SELECT DISTINCT node, 1.0 AS x FROM bw)"
    for k in range(rounds):
        out += f", u{k} AS MATERIALIZED (SELECT a.node AS node, a.x + s AS y FROM v{k} a JOIN (SELECT other AS node, sum(x) AS s FROM bw JOIN v{k} USING (node) GROUP BY other) USING (node)), v{k + 1} AS MATERIALIZED (SELECT node, y / (SELECT sqrt(sum(y * y)) FROM u{k}) AS x FROM u{k})"
    return out


@query("eigenvector", f"WITH {r.BOTH}, {_eigen_sql(8)} SELECT node, round(x, 6) AS eigenvector FROM v8")
def eigenvector(spark, d):
    """The first steps; with a tolerance they go on until the scores settle."""
    return graph.eigenvector(r.name_edges(spark, d), rounds=8, tolerance=0).withColumn("eigenvector", r6("eigenvector"))


@query("degree_centrality", f"WITH {r.BOTH}, dg AS (SELECT node, count(*) AS d FROM bw GROUP BY node) SELECT node, round(2.0 * d / ((SELECT count(*) FROM dg) - 1), 6) AS degree_centrality FROM dg")
def degree_centrality(spark, d):
    """G10."""
    return graph.degree_centrality(r.name_edges(spark, d)).withColumn("degree_centrality", r6("degree_centrality"))


@query("closeness", f"WITH RECURSIVE {r.BOTH}, hi AS (SELECT node, other FROM bw WHERE sim >= 0.95), ds AS (SELECT node, node AS far, 0 AS dist FROM (SELECT DISTINCT node FROM hi) UNION SELECT ds.node, hi.other, dist + 1 FROM ds JOIN hi ON hi.node = ds.far WHERE dist < 60), sh AS (SELECT node, far, min(dist) AS dist FROM ds GROUP BY 1, 2), cl AS (SELECT node, count(*) AS n, sum(dist) AS s FROM sh GROUP BY node) SELECT node, round((n - 1) / s * (n - 1) / ((SELECT count(*) FROM cl) - 1), 6) AS closeness FROM cl")
def closeness(spark, d):
    """G10 on the graph cut at 0.95."""
    return graph.path_centralities(r.name_edges(spark, d).where("sim >= 0.95")).select("node", r6("closeness").alias("closeness"))


@query("walk_vectors")
def walk_vectors(spark, d):
    """G11, on the graph cut at 0.95."""
    from pyspark.ml.functions import vector_to_array

    return graph.node_vectors(r.name_edges(spark, d).where("sim >= 0.95"), size=8, walks=2, length=5).select("node", F.size(vector_to_array("vector")).alias("n"))


@query("all_features", f"WITH {r.BOTH}, fd AS (SELECT node AS other, CAST(floor(log2(count(*)) + 1e-12) AS INTEGER) AS bucket FROM bw GROUP BY node), nr AS (SELECT node, other FROM bw WHERE sim >= 0.85), h2 AS (SELECT DISTINCT a.node, b.other FROM nr a JOIN nr b ON b.node = a.other WHERE a.node <> b.other EXCEPT SELECT node, other FROM nr), st AS (SELECT nr.node, count(*) AS o FROM nr JOIN bw ON bw.node = nr.other LEFT JOIN nr x ON x.node = nr.node AND x.other = bw.other WHERE bw.other <> nr.node AND x.other IS NULL GROUP BY 1), a AS (SELECT node, max(sim) AS m, count(*) FILTER (sim >= 0.85) AS d FROM bw GROUP BY node), h AS (SELECT node, count(*) FILTER (bucket = 1) AS h1 FROM nr JOIN fd USING (other) GROUP BY node), g AS (SELECT node, count(*) FILTER (bucket = 2) AS h2 FROM h2 JOIN fd USING (other) GROUP BY node) SELECT nv.node AS node, round(coalesce(m, 0), 6) AS max_sim, coalesce(d, 0) AS degree, coalesce(h1, 0) AS histo1_1, coalesce(h2, 0) AS histo2_2, coalesce(o, 0) AS egonet FROM nv LEFT JOIN a USING (node) LEFT JOIN h USING (node) LEFT JOIN g USING (node) LEFT JOIN st USING (node)")
def all_features(spark, d):
    """Basic features, degree histograms and egonets in one row of each node."""
    nodes = r.name_values(spark, d).select("node", F.array("node").alias("entities"))
    f = graph.node_features(nodes, r.name_edges(spark, d), [0.85])
    return f.select("node", r6("max_sim").alias("max_sim"), F.col("degree_85").alias("degree"), F.col("degree_histo1_1_85").alias("histo1_1"), F.col("degree_histo2_2_85").alias("histo2_2"), F.col("egonet_degree_85").alias("egonet"))


# -- matching


@query("match_stable", ORACLE["match_greedy"])
def match_stable(spark, d):
    """G18."""
    return matching.stable(r.scored_both_ways(spark, d)).select("plain", "enc")


@query("match_confident")
def match_confident(spark, d):
    """G21."""
    return matching.confident_removal(r.scored_both_ways(spark, d)).select("plain", "enc")


@query("threshold_search", "SELECT TRUE AS inside")
def threshold_search(spark, d):
    """At the score found, the largest component has a wanted number of nodes."""
    m = materialize(r.scored(spark, d), "scores")
    n = matching.largest_component(m, 0.0)
    low, high = n // 8, 3 * n // 4
    at = matching.threshold_search(m, low, high, 0.8, 1.0)
    return spark.createDataFrame([(matching.largest_component(m, at) <= high,)], "inside boolean")


# -- evaluation

CLASSES = "lk{n} AS (SELECT 'e' || enc AS a, 'p' || plain AS b FROM {t} UNION SELECT 'p' || plain, 'e' || enc FROM {t}), cc{n} AS (SELECT a AS node, a AS reach FROM lk{n} UNION SELECT cc{n}.node, lk{n}.b FROM cc{n} JOIN lk{n} ON lk{n}.a = cc{n}.reach), co{n} AS (SELECT node, min(reach) AS k FROM cc{n} GROUP BY node), pl{n} AS (SELECT DISTINCT k, plain, enc, truth FROM {t} JOIN co{n} ON co{n}.node = 'e' || enc), rt{n} AS (SELECT k, enc, bool_or(truth IN (SELECT plain FROM pl{n} z WHERE z.k = pl{n}.k)) AS ok FROM pl{n} GROUP BY k, enc), sz{n} AS (SELECT k, count(DISTINCT enc) AS e, count(DISTINCT plain) AS p FROM pl{n} GROUP BY k), ty{n} AS (SELECT k, CASE WHEN e = 1 THEN '1' ELSE 'm' END || '-' || CASE WHEN p = 1 THEN '1' ELSE 'm' END AS t FROM sz{n}), gd{n} AS (SELECT k, count(*) AS n, count(*) FILTER (ok) AS c FROM rt{n} GROUP BY k)"
COUNTS = "SELECT '{v}_classes' AS part, t || CASE WHEN c = n THEN '' WHEN c > 0 THEN '-p' ELSE '-w' END AS name, count(*) AS n FROM ty{n} JOIN gd{n} USING (k) GROUP BY 2 UNION ALL SELECT '{v}_items', CASE WHEN ok THEN t ELSE 'wrong' END, count(*) FROM rt{n} JOIN ty{n} USING (k) GROUP BY 2"


@query("reident_summary", f"WITH RECURSIVE {r.JD}, vd AS (SELECT DISTINCT truth AS enc, plain, truth FROM jd), {CLASSES.format(n=1, t='jd')}, {CLASSES.format(n=2, t='vd')} {COUNTS.format(n=1, v='entity')} UNION ALL {COUNTS.format(n=2, v='value')}")
def reident_summary(spark, d):
    """V1, V2: components and items by class, of records and of their values."""
    j = r.judged(spark, d)
    got = evaluate.summary(j, j.select(F.col("truth").alias("enc"), "plain", "truth").distinct(), 100)
    out = None
    for view in ("entity", "value"):
        for part, name, n in (("classes", "class", "components"), ("items", "type", "items")):
            one = got[f"{view}_{part}"].select(F.lit(f"{view}_{part}").alias("part"), F.col(name).alias("name"), F.col(n).alias("n"))
            out = one if out is None else out.unionByName(one)
    return out


@query("most_confident", f"WITH {P}, x AS (SELECT a0 AS enc_id, a1 AS plain_id, salt AS enc_val, a2 AS true_val, rec_id AS plain_val, length(rec_val) AS conf FROM p) SELECT enc_id, plain_id, enc_val, true_val, plain_val, conf FROM (SELECT *, row_number() OVER (PARTITION BY enc_id, plain_id ORDER BY conf DESC, plain_val DESC) AS r FROM x) WHERE r = 1")
def most_confident(spark, d):
    """V3."""
    rows = r.plain(spark, d).select(F.col("a0").alias("enc_id"), F.col("a1").alias("plain_id"), F.col("salt").alias("enc_val"), F.col("a2").alias("true_val"), F.col("rec_id").alias("plain_val"), F.char_length("rec_val").cast("long").alias("conf"))
    return evaluate.most_confident(rows)


@query("reduction_ratio", f"WITH {r.ASSIGNED}, {r.GUESS_ROWS[: r.GUESS_ROWS.index(', tk AS')]}, rr AS (SELECT rec_id, count(DISTINCT value) AS n, count(DISTINCT value) FILTER (inside) AS m FROM gr GROUP BY rec_id) SELECT round(avg(1 - m / n), 6) AS reduction FROM rr WHERE n > 0")
def reduction_ratio(spark, d):
    """V5."""
    return evaluate.reduction_ratio(r._guess_rows(spark, d)).select(r6("reduction").alias("reduction"))


@query("match_truth", f"WITH {r.MT} SELECT plain, enc, plain = enc AS same, m / (x.n + y.n - m) >= 0.8 AS alike FROM mt JOIN cm ON cm.src = plain AND cm.dst = enc JOIN nn x ON x.node = plain JOIN nn y ON y.node = enc")
def match_truth(spark, d):
    """V7."""
    n = materialize(r.name_values(spark, d).select("node", F.array("node").alias("values"), "grams"), "nodes")
    return evaluate.match_truth(r.bipartite(spark, d).select("plain", "enc"), n, n, 0.8)


@query("mining_parts")
def mining_parts(spark, d):
    """Guess accuracy of both re-identification methods."""
    p = pipelines.MiningParams(encoders.Encoding(("a0", "a1"), Q, False, L, 4), least_part=max(20, int(r.plain(spark, d).count() * 0.1)), model_least=2)
    got = pipelines.mining_analysis(r.encoded(spark, d), r.plain(spark, d), p)
    out = None
    for method in p.reident:
        if method in got:
            one = got[method].select(F.lit(method).alias("method"), "filter", "outcome", "n", r6("accuracy").alias("accuracy"))
            out = one if out is None else out.unionByName(one)
    return out if out is not None else got["status"].select("analysis", "stop_reason")
