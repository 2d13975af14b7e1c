"""Similarity graphs and node features (G1-G15, P2-P5). Nodes: (node, ...); edges: (src, dst, sim), src < dst."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkveil.functions.columns import dot
from linkveil.operators.components import connected_components
from linkveil.session import drop_made, made, materialize


def nodes_of(records: DataFrame, key: str, entity: str, value: str) -> DataFrame:
    """G1: one node per key with the entities and original values it stands for."""
    return records.groupBy(F.col(key).alias("node")).agg(F.array_sort(F.collect_set(entity)).alias("entities"), F.array_sort(F.collect_set(value)).alias("values"))


def edges_of(pairs: DataFrame) -> DataFrame:
    """One edge per pair of ends, the largest similarity of several."""
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "sim").where("src <> dst").groupBy("src", "dst").agg(F.max("sim").alias("sim"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, sim): every edge from either end."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "sim").unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "sim")
    )


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


def characteristics(nodes: DataFrame, edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, nodes, edges, singletons, components, largest) of the graph cut at each similarity."""
    out = None
    n = nodes.count()
    for t in thresholds:
        cut = edges.where(F.col("sim") >= t)
        comps = connected_components(cut).groupBy("component").agg(F.count("*").alias("s"))
        row = comps.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("in"), F.count("*").alias("c"), F.coalesce(F.max("s"), F.lit(1)).alias("m"))
        one = row.crossJoin(cut.agg(F.count("*").alias("e"))).select(
            F.lit(t).alias("threshold"), F.lit(n).cast("long").alias("nodes"), F.col("e").alias("edges"), (F.lit(n) - F.col("in")).alias("singletons"), (F.col("c") + F.lit(n) - F.col("in")).alias("components"), F.col("m").alias("largest")
        )
        out = one if out is None else out.unionByName(one)
    return out


def without_singletons(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G4."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(ends, "node", "left_semi")


def large_components(edges: DataFrame, min_degree: int) -> DataFrame:
    """Edges inside components of at least min_degree + 1 nodes."""
    comps = connected_components(edges)
    big = comps.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_degree + 1)
    keep = comps.join(big, "component", "left_semi").select(F.col("node").alias("src"))
    return edges.join(keep, "src", "left_semi")


def basic_features(nodes: DataFrame, edges: DataFrame, thresholds: list[float] = (0.0,), min_degree: int = 0) -> DataFrame:
    """node_freq, max_sim, and per threshold min_sim, sim_avr, sim_std (population) and degree; 0 where there is no neighbour.

    Names end in the threshold in hundredths."""
    aggs = [F.max("sim").alias("max_sim"), F.count("sim").alias("__all")]
    for t in thresholds:
        s, x = F.when(F.col("sim") >= t, F.col("sim")), round(100 * t)
        aggs += [F.min(s).alias(f"min_sim_{x}"), F.avg(s).alias(f"sim_avr_{x}"), F.stddev_pop(s).alias(f"sim_std_{x}"), F.count(s).alias(f"degree_{x}")]
    got = both_ways(edges).groupBy("node").agg(*aggs)
    joined = nodes.select("node", F.size("entities").alias("node_freq")).join(got, "node", "left")
    zero = {c: 0 for c in joined.columns if c not in ("node", "node_freq")}
    return joined.na.fill(zero).where(F.col("__all") >= min_degree).drop("__all")


@dataclass(frozen=True)
class Numbered:
    """A graph as integers, for plans that give it to every task: at (node, i), and both ends and the similarity of every edge, either way."""

    at: DataFrame
    n: int
    a: np.ndarray
    b: np.ndarray
    sim: np.ndarray

    def near(self, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ends, to): neighbours of i, by an edge of at least the threshold, are to[ends[i]:ends[i + 1]]."""
        keep = slice(None) if threshold is None else self.sim >= threshold
        a, b = self.a[keep], self.b[keep]
        return np.concatenate(([0], np.cumsum(np.bincount(a, minlength=self.n)))), b[np.argsort(a, kind="stable")]


#: Edges of a graph that goes to every task (32 bytes each on the driver); larger ones take joins.
MOST_EDGES = 5_000_000


def numbered(near: DataFrame) -> Numbered:
    """near: (node, other, sim), every edge from either end."""
    spark, kind = near.sparkSession, near.schema["node"].dataType.simpleString()
    names = sorted(r["node"] for r in near.select("node").where("node is not null").distinct().collect())
    at = spark.createDataFrame(pd.DataFrame({"node": names, "i": np.arange(len(names), dtype=np.int32)}), f"node {kind}, i int")
    ends = near.join(at, "node").select(F.col("i").alias("a"), "other", "sim").join(at.select(F.col("node").alias("other"), F.col("i").alias("b")), "other").where("a <> b").select("a", "b", "sim").toArrow()
    return Numbered(at, len(names), *(ends[c].to_numpy() for c in ("a", "b", "sim")))


def _deal_out(g: Numbered, solve: Callable, fields: str, block: int = 16) -> DataFrame:
    """Rows that solve(sources) gives as a data frame for blocks of numbers 0 to n."""
    spark, n = g.at.sparkSession, g.n
    blocks = -(-n // block)
    own = lambda batches: (solve(np.arange(x, min(n, x + block))) for pdf in batches for x in pdf["first"])
    return spark.range(0, blocks, 1, max(1, min(blocks, 2 * spark.sparkContext.defaultParallelism))).select((F.col("id") * block).alias("first")).mapInPandas(own, fields)


def log_bucket(degree: Column) -> Column:
    return F.floor(F.log2(degree.cast("double")) + 1e-12).cast("int")


def degree_histograms(edges: DataFrame, threshold: float = 0.0, g: Numbered | None = None) -> DataFrame:
    """(node, hop, bucket, n): neighbours (hop 1) and nodes two edges away (hop 2) by the log2 of their full degree.

    With g, edges as integers, neighbourhoods are worked out in tasks that have the whole graph; else by joins.
    """
    if g is not None:
        full = np.bincount(g.a, minlength=g.n)
        bucket = np.floor(np.log2(np.maximum(full, 1)) + 1e-12).astype(np.int64)
        own = g.at.sparkSession.sparkContext.broadcast((*g.near(threshold), bucket))

        def solve(sources: np.ndarray) -> pd.DataFrame:
            ends, to, kinds = own.value
            cells, rows, out = np.zeros((len(kinds), len(sources))), np.flatnonzero(np.diff(ends)), []
            for c, x in enumerate(sources):
                cells[to[ends[x] : ends[x + 1]], c] = 1.0
            far = np.zeros(cells.shape, bool)
            far[rows] = _pull(ends, to, cells, rows) > 0
            far &= cells == 0
            far[sources, np.arange(len(sources))] = False
            for c, x in enumerate(sources):
                for hop, met in ((1, cells[:, c] > 0), (2, far[:, c])):
                    counts = np.bincount(kinds[met])
                    out += [(int(x), hop, int(b), int(counts[b])) for b in np.flatnonzero(counts)]
            return pd.DataFrame(out, columns=["i", "hop", "bucket", "n"])

        return _deal_out(g, solve, "i int, hop int, bucket int, n long").join(g.at, "i").select("node", "hop", "bucket", "n")
    full = degrees(edges).select(F.col("node").alias("other"), log_bucket(F.col("degree")).alias("bucket"))
    near = both_ways(edges.where(F.col("sim") >= threshold)).select("node", "other")
    first = near.join(full, "other").groupBy("node", "bucket").agg(F.count("*").alias("n")).withColumn("hop", F.lit(1))
    step = near.select(F.col("node").alias("other"), F.col("other").alias("far"))
    two = near.join(step, "other").select("node", F.col("far").alias("other")).where("node <> other").distinct().join(near, ["node", "other"], "left_anti")
    second = two.join(full, "other").groupBy("node", "bucket").agg(F.count("*").alias("n")).withColumn("hop", F.lit(2))
    return first.unionByName(second).select("node", "hop", "bucket", "n")


def egonets(edges: DataFrame, threshold: float = 0.0, g: Numbered | None = None) -> DataFrame:
    """(node, egonet_degree, egonet_density) over neighbours of at least the threshold.

    egonet_degree: edges from a neighbour to outside the egonet, at any similarity; density: edges inside it by n (n + 1) / 2
    for n neighbours. With g as in degree_histograms.
    """
    if g is not None:
        own = g.at.sparkSession.sparkContext.broadcast((*g.near(threshold), *g.near()))

        def solve(sources: np.ndarray) -> pd.DataFrame:
            ends, to, all_ends, all_to = own.value
            cells, rows = np.zeros((len(ends) - 1, len(sources))), np.flatnonzero(np.diff(all_ends))
            for c, x in enumerate(sources):
                cells[to[ends[x] : ends[x + 1]], c] = 1.0
            steps = np.zeros(cells.shape)
            steps[rows] = _pull(all_ends, all_to, cells, rows)
            steps[sources, np.arange(len(sources))] = 0.0
            size, twice = cells.sum(axis=0), (steps * cells).sum(axis=0)
            density = (size + twice / 2) / np.maximum(size * (size + 1) / 2, 1)
            return pd.DataFrame({"i": sources, "egonet_degree": (steps.sum(axis=0) - twice).astype(np.int64), "egonet_density": density})[size > 0]

        return _deal_out(g, solve, "i int, egonet_degree long, egonet_density double").join(g.at, "i").select("node", "egonet_degree", "egonet_density")
    near = both_ways(edges.where(F.col("sim") >= threshold)).select("node", "other")
    every = both_ways(edges).select(F.col("node").alias("other"), F.col("other").alias("far"))
    steps = near.join(every, "other").where("far <> node")
    inside = near.select("node", F.col("other").alias("far"), F.lit(True).alias("in"))
    marked = steps.join(inside, ["node", "far"], "left")
    sizes = near.groupBy("node").agg(F.count("*").alias("n"))
    got = marked.groupBy("node").agg(F.count(F.when(F.col("in").isNull(), 1)).alias("out"), F.count("in").alias("twice"))
    return sizes.join(got, "node", "left").select(
        "node",
        F.coalesce("out", F.lit(0)).cast("long").alias("egonet_degree"),
        ((F.col("n") + F.coalesce("twice", F.lit(0)) / 2) / (F.col("n") * (F.col("n") + 1) / 2)).alias("egonet_density"),
    )


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-8) -> DataFrame:
    """(node, pagerank), by `similarity`-blind power steps until all ranks together move by at most tolerance.

    Each round is written to the shared folder. With tolerance 0 exactly `rounds` steps are taken; else it raises if they
    do not suffice.
    """
    near = materialize(both_ways(edges).select("node", "other"), "adjacent")
    out = materialize(near.groupBy("node").agg(F.count("*").alias("d")), "degrees")
    n = max(1, out.count())
    rank = out.select("node", F.lit(1.0 / n).alias("r"))
    rank = materialize(rank, "rank")
    for _ in range(rounds):
        given = rank.join(out, "node").select("node", (F.col("r") / F.col("d")).alias("g"))
        got = near.join(given, "node").groupBy(F.col("other").alias("node")).agg(F.sum("g").alias("s"))
        new = got.join(rank, "node").select("node", (F.lit((1 - damping) / n) + damping * F.col("s")).alias("r"), F.col("r").alias("old"))
        new = materialize(new, "rank")
        rank = new.select("node", "r")
        if tolerance and (new.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] or 0.0) <= tolerance:
            break
    else:
        if tolerance:
            raise RuntimeError(f"ranks have not settled to {tolerance} in {rounds} rounds")
    return rank.select("node", F.col("r").alias("pagerank"))


def eigenvector(edges: DataFrame, rounds: int = 500, tolerance: float = 1e-6) -> DataFrame:
    """(node, eigenvector) by power steps with A + I, normalised, until no node moves by more than tolerance.

    With tolerance 0 exactly `rounds` steps are taken; else it raises if they do not suffice.
    """
    near = materialize(both_ways(edges).select("node", "other"), "adjacent")
    score = near.select("node").distinct().withColumn("x", F.lit(1.0))
    for _ in range(rounds):
        got = near.join(score, "node").groupBy("other").agg(F.sum("x").alias("s")).select(F.col("other").alias("node"), "s")
        added = materialize(score.join(got, "node").select("node", (F.col("x") + F.col("s")).alias("x"), F.col("x").alias("old")), "eigen")
        norm = added.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        score = added.select("node", (F.col("x") / norm).alias("x"))
        if tolerance and (added.agg(F.max(F.abs(F.col("x") / norm - F.col("old")))).first()[0] or 0.0) <= tolerance:
            break
    else:
        if tolerance:
            raise RuntimeError(f"scores have not settled to {tolerance} in {rounds} rounds")
    return score.select("node", F.col("x").alias("eigenvector"))


def _paths_by_levels(near: DataFrame, nodes: DataFrame, state_rows: int) -> DataFrame:
    """(node, reach, between): the sum of distances from each node, and the shares of shortest paths through it, by frontier joins.

    near: (node, other), every edge from either end, once. nodes: (node, n) with the size of the node's component. Sources
    go in blocks of at most about state_rows (source, node) pairs. A block's breadth-first levels are tables, one join
    each; neighbours of a level lie in it or in those beside it, so only two levels are taken off a new one. Shares then
    flow back from the deepest level.
    """
    spark = near.sparkSession
    pairs = nodes.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-pairs // state_rows))
    done = None
    for block in range(blocks):
        since = made(spark) - (done is not None)
        own = nodes.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block)
        level = materialize(own.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")), "paths-level")
        levels = [level]
        while True:
            step = level.join(near, "node").groupBy("source", F.col("other").alias("node")).agg(F.sum("paths").alias("paths"))
            for before in levels[-2:]:
                step = step.join(before.select("source", "node"), ["source", "node"], "left_anti")
            level = materialize(step, "paths-level")
            if level.isEmpty():
                break
            levels.append(level)
        zero = F.lit(0.0)
        parts = [lv.groupBy(F.col("source").alias("node")).agg((F.count("*") * depth).cast("long").alias("reach")).withColumn("between", zero) for depth, lv in enumerate(levels)]
        here = levels[-1].withColumn("lean", zero)
        for before in reversed(levels[1:-1]):
            share = here.select("source", "node", ((1 + F.col("lean")) / F.col("paths")).alias("share"))
            given = share.join(near, "node").groupBy("source", F.col("other").alias("node")).agg(F.sum("share").alias("given"))
            lean = F.col("paths") * F.coalesce("given", zero)
            here = materialize(before.join(given, ["source", "node"], "left").select("source", "node", "paths", lean.alias("lean")), "paths-lean")
            parts.append(here.groupBy("node").agg(F.sum("lean").alias("between")).select("node", F.lit(0).cast("long").alias("reach"), "between"))
        rows = done
        for part in parts:
            rows = part if rows is None else rows.unionByName(part)
        done = materialize(rows.groupBy("node").agg(F.sum("reach").alias("reach"), F.sum("between").alias("between")), "paths-done")
        drop_made(spark, since, keep=1)
    return done


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree_centrality): every edge counted at both of its directions, in and out, by all other nodes. One aggregation, no paths."""
    got = both_ways(edges.where("src is not null and dst is not null")).groupBy("node").agg(F.count_distinct("other").alias("d"))
    return got.crossJoin(F.broadcast(got.agg(F.greatest(F.lit(1), F.count("*") - 1).alias("rest")))).select("node", (2 * F.col("d") / F.col("rest")).alias("degree_centrality"))


def _pull(ends: np.ndarray, to: np.ndarray, cells: np.ndarray, rows: np.ndarray, most_cells: int = 1 << 17) -> np.ndarray:
    """For each row (a node with neighbours to[ends[i]:ends[i + 1]]) the sum over its neighbours' cells, most_cells at a time."""
    out, first = np.empty((len(rows), cells.shape[1])), 0
    most, sizes = max(1, most_cells // cells.shape[1]), ends[rows + 1] - ends[rows]
    past = np.cumsum(sizes)
    while first < len(rows):
        base = past[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(past, base + most, "right")))
        starts = np.concatenate(([0], past[first : last - 1] - base))
        near = to[np.repeat(ends[rows[first:last]] - starts, sizes[first:last]) + np.arange(past[last - 1] - base)]
        np.add.reduceat(cells[near], starts, axis=0, out=out[first:last])
        first = last
    return out


def _sweep(ends: np.ndarray, to: np.ndarray, sources: np.ndarray, between: np.ndarray, most_cells: int = 1 << 17) -> np.ndarray:
    """The sum of distances from each of the sources; between gets the shares of their shortest paths through every node.

    ends, to: neighbours of node i are to[ends[i]:ends[i + 1]]. All sources go level by level at once, (node, source) cells; a level
    touches the neighbours of the last one alone, most_cells cells at a time.
    """
    n, wide = len(ends) - 1, len(sources)
    sizes = np.diff(ends)
    pull = lambda cells, rows: _pull(ends, to, cells, rows, most_cells)
    dist = np.full((n, wide), -1, np.int32)
    paths, cells = np.zeros((n, wide)), np.zeros((n, wide))
    columns = np.arange(wide)
    dist[sources, columns], paths[sources, columns], cells[sources, columns] = 0, 1.0, 1.0
    levels = [np.unique(sources)]
    while True:
        mark = np.zeros(n, bool)
        for x in np.array_split(levels[-1], -(-int(sizes[levels[-1]].sum()) // most_cells) or 1):
            own = sizes[x]
            mark[to[np.repeat(ends[x] - (np.cumsum(own) - own), own) + np.arange(own.sum())]] = True
        rows = np.flatnonzero(mark)
        rows = rows[(dist[rows] < 0).any(axis=1)]
        step = pull(cells, rows)
        step[dist[rows] >= 0] = 0.0
        cells[levels[-1]] = 0.0
        some = (step > 0).any(axis=1)
        rows, step = rows[some], step[some]
        if not len(rows):
            break
        new = step > 0
        dist[rows] = np.where(new, len(levels), dist[rows])
        paths[rows] = np.where(new, step, paths[rows])
        cells[rows] = step
        levels.append(rows)
    lean = np.zeros((n, wide))
    for level in range(len(levels) - 1, 0, -1):
        rows, before = levels[level], levels[level - 1]
        cells[rows] = np.divide(1 + lean[rows], paths[rows], out=np.zeros((len(rows), wide)), where=dist[rows] == level)
        lean[before] += np.where(dist[before] == level - 1, paths[before] * pull(cells, before), 0.0)
        cells[rows] = 0.0
    lean[sources, columns] = 0.0
    between += lean.sum(axis=1)
    return np.maximum(dist, 0).sum(axis=0)


def _paths_by_sources(near: DataFrame, block: int = 16) -> DataFrame:
    """(node, reach, between) like _paths_by_levels: the adjacency goes to every task as integers, and blocks of sources are dealt out."""
    g = numbered(near.withColumn("sim", F.lit(1.0)))
    n, spark = g.n, near.sparkSession
    own = spark.sparkContext.broadcast(g.near())

    def solve(batches):
        starts, to = own.value
        between, some = np.zeros(n), False
        for pdf in batches:
            for first in pdf["first"]:
                some, sources = True, np.arange(first, min(n, first + block))
                yield pd.DataFrame({"i": sources, "reach": _sweep(starts, to, sources, between), "between": 0.0})
        if some:
            yield pd.DataFrame({"i": np.arange(n), "reach": 0, "between": between})

    blocks = -(-n // block)
    tasks = min(blocks, 2 * spark.sparkContext.defaultParallelism)
    parts = spark.range(0, blocks, 1, tasks).select((F.col("id") * block).alias("first")).mapInPandas(solve, "i int, reach long, between double")
    out = parts.groupBy("i").agg(F.sum("reach").alias("reach"), F.sum("between").alias("between")).join(g.at, "i").select("node", "reach", "between")
    out = materialize(out, "paths-done")
    own.destroy()
    return out


def path_centralities(edges: DataFrame, most_nodes: int = 1_000, state_rows: int = 50_000_000, most_edges: int = MOST_EDGES) -> DataFrame:
    """(node, closeness, betweenness, degree_centrality), exact breadth-first counts within each component.

    degree_centrality counts every edge at both of its directions, in and out. A component of at most most_nodes nodes is
    solved in one task, all sources of a block at once, level by level. Larger ones, if they have at most most_edges edges in all, go
    to every task as integers and their sources are dealt out; beyond that they are solved by joins, state_rows (source, node)
    pairs at a time: nothing is gathered. The work is nodes times edges of the component either way.
    """
    comps = materialize(connected_components(edges), "components")
    sizes = comps.groupBy("component").agg(F.count("*").alias("n"))
    total = comps.count()
    placed = materialize(comps.join(sizes, "component"), "nodes-by-component")
    inside = edges.join(placed.select(F.col("node").alias("src"), "component", "n"), "src").select("component", "n", "src", "dst")
    kind = edges.schema["src"].dataType.simpleString()
    scale = (total - 1) * (total - 2)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["src"]) | set(pdf["dst"]))
        at = {x: i for i, x in enumerate(names)}
        n = len(names)
        i, j = pdf["src"].map(at).to_numpy(), pdf["dst"].map(at).to_numpy()
        linked = np.unique(np.concatenate((i * n + j, j * n + i)))
        degree = np.bincount(linked // n, minlength=n)
        linked = linked[linked // n != linked % n]
        ends = np.concatenate(([0], np.cumsum(np.bincount(linked // n, minlength=n))))
        close, between = np.zeros(n), np.zeros(n)
        for first in range(0, n, 16):
            block = np.arange(first, min(n, first + 16))
            reach = _sweep(ends, linked % n, block, between)
            close[block] = np.where(reach > 0, (n - 1) / np.maximum(reach, 1) * (n - 1) / max(1, total - 1), 0.0)
        return pd.DataFrame({"node": names, "closeness": close, "betweenness": between / scale if scale > 0 else 0.0, "degree_centrality": 2.0 * degree / max(1, total - 1)})

    small = inside.where(F.col("n") <= most_nodes).groupBy("component")
    out = small.applyInPandas(solve, f"node {kind}, closeness double, betweenness double, degree_centrality double")
    nodes = placed.where(F.col("n") > most_nodes).select("node", "n")
    if nodes.isEmpty():
        return out
    far = inside.where(F.col("n") > most_nodes).withColumn("sim", F.lit(1.0))
    near = materialize(both_ways(far).select("node", "other").distinct(), "adjacent")
    rest = max(1, total - 1)
    paths = _paths_by_sources(near) if near.count() <= 2 * most_edges else _paths_by_levels(near, nodes, state_rows)
    found = paths.join(nodes, "node").join(near.groupBy("node").agg(F.count("*").alias("d")), "node")
    close = (F.col("n") - 1) / F.col("reach") * ((F.col("n") - 1) / rest)
    between = F.col("between") / scale if scale > 0 else F.lit(0.0)
    return out.unionByName(found.select("node", close.alias("closeness"), between.alias("betweenness"), (2 * F.col("d") / rest).alias("degree_centrality")))


def bucket_count(*edges: DataFrame) -> int:
    """The buckets that the degrees of these graphs take together."""
    return max(histogram_length(degrees(e).agg(F.max("degree")).first()[0] or 0) for e in edges)


def node_features(
    nodes: DataFrame, edges: DataFrame, thresholds: list[float] = (0.0,), min_degree: int = 0, kinds: tuple[str, ...] = ("basic", "histograms", "egonets"), buckets: int | None = None
) -> DataFrame:
    """(node, features...): G7 and, by kind, G8 (buckets of either hop), G9 and the centralities of G10 (pagerank, eigenvector, paths).

    All are joined by node to the basic ones; a feature that a node lacks is 0. Names end in the threshold in hundredths.
    """
    out = basic_features(nodes, edges, list(thresholds), min_degree)
    more = []
    g = numbered(both_ways(edges)) if {"histograms", "egonets"} & set(kinds) and edges.count() <= MOST_EDGES else None
    n = (bucket_count(edges) if buckets is None else buckets) if "histograms" in kinds else 0
    for t in thresholds:
        x = round(100 * t)
        if n:
            each = [F.coalesce(F.sum(F.when((F.col("hop") == h) & (F.col("bucket") == b), F.col("n"))), F.lit(0).cast("long")).alias(f"degree_histo{h}_{b}_{x}") for h in (1, 2) for b in range(n)]
            more.append(degree_histograms(edges, t, g).groupBy("node").agg(*each))
        if "egonets" in kinds:
            more.append(egonets(edges, t, g).withColumnsRenamed({c: f"{c}_{x}" for c in ("egonet_degree", "egonet_density")}))
    more += [f(edges) for kind, f in (("pagerank", pagerank), ("eigenvector", eigenvector), ("paths", path_centralities)) if kind in kinds]
    for one in more:
        out = out.join(materialize(one, "features-of-a-kind"), "node", "left")
    return out.na.fill(0, [c for c in out.columns if c != "node"])


def random_walks(edges: DataFrame, walks: int = 20, length: int = 30, p: float = 0.9, q: float = 2.0, seed: int = 42) -> DataFrame:
    """(walk, path): second-order biased walks. Each step draws the smallest exponential key among the neighbours."""
    near = materialize(both_ways(edges).select("node", "other", "sim"), "adjacent")
    start = near.select("node").distinct()
    now = start.select(F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("w"), "node").select(
        F.concat_ws("#", "node", "w").alias("walk"), F.lit(None).cast(near.schema["node"].dataType).alias("before"), F.col("node").alias("at"), F.array("node").alias("path")
    )
    linked = near.select(F.col("node").alias("before"), F.col("other").alias("next"), F.lit(True).alias("tied"))
    for step in range(length - 1):
        options = now.join(near.select(F.col("node").alias("at"), F.col("other").alias("next"), "sim"), "at").join(linked, ["before", "next"], "left")
        bias = F.when(F.col("next").eqNullSafe(F.col("before")), 1 / p).when(F.col("tied") | F.col("before").isNull(), 1.0).otherwise(1 / q)
        u = (F.pmod(F.xxhash64("walk", "next", F.lit(seed + step)), F.lit(1 << 40)) + 1) / float(1 << 40)
        keyed = options.select("walk", "at", "path", "next", (-F.ln(u) / (F.col("sim") * bias)).alias("k"))
        now = keyed.groupBy("walk").agg(F.min_by(F.struct("at", "path", "next"), F.struct("k", "next")).alias("b")).select(
            "walk", F.col("b.at").alias("before"), F.col("b.next").alias("at"), F.array_append("b.path", F.col("b.next")).alias("path")
        )
        now = materialize(now, "walks")
    return now.select("walk", "path")


def node_vectors(edges: DataFrame, size: int = 30, seed: int = 42, **walk) -> DataFrame:
    """(node, vector): skip-gram vectors of the walks by MLlib's Word2Vec."""
    from pyspark.ml.feature import Word2Vec

    paths = random_walks(edges, seed=seed, **walk).select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    model = Word2Vec(vectorSize=size, minCount=0, seed=seed, windowSize=5, inputCol="path", outputCol="v").fit(paths)
    return model.getVectors().select(F.col("word").alias("node"), "vector")


def normalised(a: DataFrame, b: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both graphs' features scaled by their common range; the least starts at 1 and the most at 0; no range gives 0."""
    each = [x.agg(*[f(c).alias(f"{p}{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))]).first() for x in (a, b)]
    lo = {c: min([1.0, *(float(r[f"lo{c}"]) for r in each if r[f"lo{c}"] is not None)]) for c in columns}
    hi = {c: max([0.0, *(float(r[f"hi{c}"]) for r in each if r[f"hi{c}"] is not None)]) for c in columns}
    scale = lambda c: ((F.col(c) - lo[c]) / (hi[c] - lo[c])).alias(c) if hi[c] > lo[c] else F.lit(0.0).alias(c)
    return tuple(x.select(*[scale(c) if c in columns else F.col(c) for c in x.columns]) for x in (a, b))


def chosen_features(df: DataFrame, columns: list[str], how: str = "all", value: float = 0.0) -> list[str]:
    """All, nonzero (standard deviation above 0), top (the `value` largest), least (at least `value`)."""
    if how == "all" or not columns:
        return list(columns)
    row = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    std = {c: row[c] or 0.0 for c in columns}
    if how == "nonzero":
        return [c for c in columns if std[c] > 0]
    if how == "top":
        best = sorted(columns, key=lambda c: (-std[c], c))[: int(value)]
        return [c for c in columns if c in best]
    if how == "least":
        return [c for c in columns if std[c] >= value]
    raise ValueError("how is all, nonzero, top or least")


def vector(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("node", F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))


def sim_hashes(vectors: DataFrame, dimensions: int, n_bits: int, seed: int = 42) -> DataFrame:
    """(node, signature): one bit per seeded Gaussian plane."""
    planes = np.random.RandomState(seed).randn(n_bits, dimensions)
    table = F.array(*[F.array(*map(F.lit, map(float, p))) for p in planes])
    return vectors.select("node", F.transform(table, lambda p: F.when(dot(F.col("features"), p) >= 0, 1).otherwise(0)).alias("signature"))


def set_bits(signature: Column) -> Column:
    return F.filter(F.transform(signature, lambda b, i: F.when(b == 1, i)), lambda x: x.isNotNull())


def calibration_features(df: DataFrame, kind: str) -> DataFrame:
    """df with the vector `x` that a calibration of that kind takes."""
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler

    flat = ["plain_sim"] if kind == "isotonic" else ["plain_sim", "union_size"]
    data = VectorAssembler(inputCols=flat, outputCol="x0").transform(df)
    return PolynomialExpansion(degree=2, inputCol="x0", outputCol="x").transform(data) if kind == "poly" else data.withColumnRenamed("x0", "x")


def calibration(pairs: DataFrame, kind: str = "linear", per_class: int = 500, seed: int = 42):
    """A regression of the encoded on the plain similarity and the size of the union, and its errors on a quarter.

    pairs: plain_sim, union_size, enc_sim. At most per_class rows of each tenth of plain_sim are fitted (a stated bound), by a hash.
    Returns (model, metrics): model.transform needs a column `x` of features.
    """
    from pyspark.ml.regression import IsotonicRegression, LinearRegression

    from linkveil.functions.columns import similarity_class

    own = pairs.withColumn("c", similarity_class(F.col("plain_sim"))).where("c is not null")
    order = F.xxhash64("plain_sim", "union_size", "enc_sim", F.lit(seed))
    some = own.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(order))).where(F.col("r") <= per_class)
    data = calibration_features(some.select(*[F.col(c).cast("double") for c in ("plain_sim", "union_size", "enc_sim")], "r"), kind)
    data = materialize(data, "calibration")
    train, test = data.where("r % 4 <> 0"), data.where("r % 4 = 0")
    make = IsotonicRegression if kind == "isotonic" else LinearRegression
    model = make(featuresCol="x", labelCol="enc_sim", predictionCol="guess").fit(train)
    return model, regression_metrics(model.transform(test), "enc_sim", "guess")


def regression_metrics(df: DataFrame, label: str, guess: str) -> DataFrame:
    """Explained variance, least, most, mean and standard deviation of the absolute error, squared errors and R2, of guesses above 0."""
    y, p = F.col(label), F.col(guess)
    good = df.where(p > 0)
    e = F.abs(y - p)
    return good.agg(
        (1 - F.var_pop(y - p) / F.var_pop(y)).alias("explained_variance"), F.min(e).alias("min_error"), F.max(e).alias("max_error"), F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error"),
        F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.pow(F.log1p(y) - F.log1p(p), 2)).alias("msle"), (1 - F.avg((y - p) * (y - p)) / F.var_pop(y)).alias("r2"),
    )


def confidences(matches: DataFrame, weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> DataFrame:
    """(plain, enc, cos, sim_conf, degree_conf, score) of a bipartite graph of matches (plain, enc, cos).

    sim_conf: cos by the mean of all other edges at either end, or cos / (least cos - 0.1) where there is none;
    degree_conf: 1 / (other edges + 1). Both are scaled to 0..1 over all pairs.
    """
    a = matches.groupBy("plain").agg(F.sum("cos").alias("ps"), F.count("*").alias("pn"))
    b = matches.groupBy("enc").agg(F.sum("cos").alias("es"), F.count("*").alias("en"))
    least = matches.agg(F.min("cos").alias("least"))
    others = F.col("pn") + F.col("en") - 2
    raw = matches.join(a, "plain").join(b, "enc").crossJoin(F.broadcast(least)).select(
        "plain", "enc", "cos",
        F.when(others > 0, F.col("cos") / ((F.col("ps") + F.col("es") - 2 * F.col("cos")) / others)).otherwise(F.col("cos") / (F.col("least") - 0.1)).alias("s"),
        (1.0 / (others + 1)).alias("d"),
    )
    bounds = raw.agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    scale = lambda x: F.when(F.col(f"{x}1") > F.col(f"{x}0"), (F.col(x) - F.col(f"{x}0")) / (F.col(f"{x}1") - F.col(f"{x}0"))).otherwise(0.0)
    out = raw.crossJoin(F.broadcast(bounds)).select("plain", "enc", "cos", scale("s").alias("sim_conf"), scale("d").alias("degree_conf"))
    w = [F.lit(float(x)) for x in weights]
    return out.withColumn("score", w[0] * F.col("cos") + w[1] * F.col("sim_conf") + w[2] * F.col("degree_conf"))


#: The weights of (cos, sim_conf, degree_conf) that are tried.
WEIGHT_SETS = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.6, 0.3, 0.1))


def histogram_length(max_degree: int) -> int:
    return int(math.log2(max_degree)) + 1 if max_degree else 0
