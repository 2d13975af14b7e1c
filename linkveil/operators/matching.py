"""One-to-one matching of a bipartite graph (G16-G22). Matches: plain, enc, score. Ties: plain, then enc, ascending."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkveil.operators.components import connected_components
from linkveil.session import materialize

#: Nodes of one side that the dense assignment solver takes in one component; only scores below 0 need it.
MOST_IN_COMPONENT = 3_000
#: Pairs of one component that go to one task (some 200 bytes each there).
MOST_PAIRS = 5_000_000


def best_for_both(matches: DataFrame) -> DataFrame:
    """Pairs that are the best of either end. Best partners are aggregated map-side; nothing is sorted."""
    order = lambda: F.struct((-F.col("score")).alias("s"), "plain", "enc")
    a = matches.groupBy("plain").agg(F.min(order()).alias("a"))
    b = matches.groupBy("enc").agg(F.min(order()).alias("b"))
    left = a.select("plain", F.col("a.enc").alias("enc"), (-F.col("a.s")).alias("score"))
    right = b.select("enc", F.col("b.plain").alias("p"))
    return left.join(right, "enc").where("plain = p").select("plain", "enc", "score")


def symmetric(matches: DataFrame) -> DataFrame:
    """Mutual best matches."""
    return best_for_both(matches)


def greedy(matches: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Pairs in order of score, taken if both ends are free: rounds of mutual best pairs give the same result."""
    left = materialize(matches.select("plain", "enc", F.col("score").cast("double").alias("score")), "open-matches")
    done = None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        now = materialize(best_for_both(left), "matched")
        done = now if done is None else done.unionByName(now)
        left = materialize(
            left.join(now.select("plain"), "plain", "left_anti").join(now.select("enc"), "enc", "left_anti").select("plain", "enc", "score"), "open-matches"
        )
    else:
        raise RuntimeError(f"not settled in {most_rounds} rounds")
    return done if done is not None else left


def stable(matches: DataFrame) -> DataFrame:
    """With one score for both sides the stable matching is the greedy one."""
    return greedy(matches)


def random_matching(matches: DataFrame, seed: int = 42) -> DataFrame:
    """A full matching in a seeded random order."""
    return greedy(matches.select("plain", "enc", (F.pmod(F.xxhash64("plain", "enc", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)).alias("score")))


def assignment(cost: np.ndarray) -> list[int]:
    """For every row its column, each used once, with the least total cost (rows <= columns); shortest augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        best, came, used = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            gap = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            closer = ~used[1:] & (gap < best[1:])
            best[1:][closer], came[1:][closer] = gap[closer], j0
            free = np.where(used, np.inf, best)
            free[0] = np.inf
            j1 = int(np.argmin(free))
            step = free[j1]
            u[owner[used]] += step
            v[used] -= step
            best[1:][~used[1:]] -= step
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0], j0 = owner[came[j0]], int(came[j0])
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _settle(starts: np.ndarray, ends: np.ndarray, to: np.ndarray, weight: np.ndarray, u: np.ndarray, v: np.ndarray, mate: np.ndarray, mated: np.ndarray) -> None:
    """Shortest augmenting paths from every free row whose price u is above 0, until it is matched or a row of price 0 is free.

    Edges of row i are to[ends[i]:ends[i + 1]]. Prices stay at u + v >= weight with equality on matched edges. mate: the column of each
    row, mated: the row of each column, -1 if free. All arrays are changed in place.
    """
    dist, came = np.full(len(v), np.inf), np.zeros(len(v), np.int64)
    for start in starts:
        heap, touched, rows, columns = [], [], [(int(start), 0.0)], []
        least, last, at = u[start], int(start), -1  # the cheapest end so far: row `last` goes free, or column `at` is free
        done, row, d = set(), int(start), 0.0
        while True:
            edges = slice(ends[row], ends[row + 1])
            near = to[edges]
            new = d + np.maximum(u[row] + v[near] - weight[edges], 0.0)
            better = (new < dist[near]) & (new < least)
            near, new = near[better], new[better]
            dist[near], came[near] = new, row
            touched.append(near)
            for x, j in zip(new.tolist(), near.tolist(), strict=True):
                heapq.heappush(heap, (x, j))
            while heap and heap[0][1] in done:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= least:
                break
            d, j = heapq.heappop(heap)
            done.add(j)
            if mated[j] < 0:
                least, at = d, j
                break
            columns.append((j, d))
            row = int(mated[j])
            rows.append((row, d))
            if d + u[row] < least:
                least, last = d + u[row], row
        for i, x in rows:
            u[i] = max(0.0, u[i] - max(0.0, least - x))
        for j, x in columns:
            v[j] += max(0.0, least - x)
        if at < 0:  # the path ends where row `last` gives up its column
            at, mate[last] = int(mate[last]) if last != start else -1, -1
        while at >= 0:
            i = int(came[at])
            mated[at], mate[i], at = i, at, int(mate[i])
            if i == start:
                break
        for x in touched:
            dist[x] = np.inf


def sparse_matching(rows: np.ndarray, columns: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """For each of n rows its column or -1: a matching of the largest total weight (all above 0), by prices of both sides.

    Prices start at half the largest weight of either end, where mutual best pairs are already settled; then rows and columns that
    are free at a price above 0 are settled in turn. At the end free ones cost 0, which proves the matching best.
    """
    u, v = np.zeros(n), np.zeros(m)
    np.maximum.at(u, rows, weight / 2)
    np.maximum.at(v, columns, weight / 2)
    mate, mated = np.full(n, -1), np.full(m, -1)
    tight = np.flatnonzero(u[rows] + v[columns] - weight <= 1e-15)
    choice = np.bincount(rows[tight], minlength=n)[rows[tight]] + np.bincount(columns[tight], minlength=m)[columns[tight]]
    for e in tight[np.argsort(choice, kind="stable")]:
        i, j = rows[e], columns[e]
        if mate[i] < 0 and mated[j] < 0:
            mate[i], mated[j] = j, i
    for a, b, k, x, y, f, g in ((rows, columns, n, u, v, mate, mated), (columns, rows, m, v, u, mated, mate)):
        order = np.argsort(a, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=k))))
        _settle(np.flatnonzero((f < 0) & (x > 0)), ends, b[order], weight[order], x, y, f, g)
    return mate


def with_components(matches: DataFrame) -> DataFrame:
    """matches with the component that each pair lies in."""
    ends = matches.select(F.concat(F.lit("p:"), F.col("plain").cast("string")).alias("src"), F.concat(F.lit("e:"), F.col("enc").cast("string")).alias("dst"))
    comps = materialize(connected_components(ends), "match-components")
    return matches.join(comps, F.concat(F.lit("p:"), F.col("plain").cast("string")) == F.col("node")).drop("node")


def hungarian(matches: DataFrame) -> DataFrame:
    """Per component the assignment of least cost 1 - score, 1 where there is no edge (such pairs have the score 0.1).

    A component goes to one task with its edges. Edges above 0 are matched to the largest total score; what is free then is paired off
    without an edge. Scores below 0 need the whole cost matrix. A component that is too large is refused with its size (raise a
    threshold with threshold_search), not cut.
    """
    own = materialize(with_components(matches), "matches-by-component")
    sizes = own.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("plain").alias("p"), F.count_distinct("enc").alias("e"), F.min("score").alias("least"))
    row = sizes.agg(F.max("n").alias("pairs"), F.max(F.when(F.col("least") < 0, F.greatest("p", "e"))).alias("dense")).first()
    if (row["pairs"] or 0) > MOST_PAIRS:
        raise ValueError(f"a component has {row['pairs']} pairs; the bound is {MOST_PAIRS}")
    if (row["dense"] or 0) > MOST_IN_COMPONENT:
        raise ValueError(f"a component with scores below 0 has {row['dense']} nodes on a side; the bound is {MOST_IN_COMPONENT}")
    kinds = {c: own.schema[c].dataType.simpleString() for c in ("plain", "enc")}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        p, e = np.array(sorted(pdf["plain"].unique()), object), np.array(sorted(pdf["enc"].unique()), object)
        pi, ei = ({x: i for i, x in enumerate(names)} for names in (p, e))
        last = pd.DataFrame({"i": pdf["plain"].map(pi), "j": pdf["enc"].map(ei), "s": pdf["score"].astype(float)}).drop_duplicates(["i", "j"], keep="last")
        i, j, s = (last[c].to_numpy() for c in "ijs")
        if (s < 0).any():
            cost = np.ones((len(p), len(e)))
            cost[i, j] = 1 - s
            turned = len(p) > len(e)
            got = assignment(cost.T if turned else cost)
            pairs = [(b, a) if turned else (a, b) for a, b in enumerate(got)]
        else:
            some = s > 0
            mate = sparse_matching(i[some], j[some], s[some], len(p), len(e))
            free = np.setdiff1d(np.arange(len(e)), mate)
            pairs = [(int(a), int(mate[a])) for a in np.flatnonzero(mate >= 0)] + list(zip(np.flatnonzero(mate < 0).tolist(), free.tolist(), strict=False))
        edge = dict(zip(zip(i.tolist(), j.tolist(), strict=True), s.tolist(), strict=True))
        return pd.DataFrame({"plain": [p[a] for a, _ in pairs], "enc": [e[b] for _, b in pairs], "score": [edge.get(x, 0.1) for x in pairs]})

    return own.groupBy("component").applyInPandas(solve, f"plain {kinds['plain']}, enc {kinds['enc']}, score double")


def confident_removal(matches: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Mutual best pairs in rounds, where every accepted pair also removes all other edges of its ends, scores rising.

    The score of a pair is taken by the mean of what else its ends have left, so it changes from round to round.
    """
    left, done = materialize(matches.select("plain", "enc", F.col("score").cast("double").alias("raw")), "open-matches"), None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        a = left.groupBy("plain").agg(F.avg("raw").alias("pm"))
        b = left.groupBy("enc").agg(F.avg("raw").alias("em"))
        scored = left.join(a, "plain").join(b, "enc").select("plain", "enc", (2 * F.col("raw") / (F.col("pm") + F.col("em"))).alias("score"))
        now = materialize(best_for_both(scored), "matched")
        done = now if done is None else done.unionByName(now)
        left = materialize(left.join(now.select("plain"), "plain", "left_anti").join(now.select("enc"), "enc", "left_anti").select("plain", "enc", "raw"), "open-matches")
    else:
        if not left.isEmpty():
            raise RuntimeError(f"not settled in {most_rounds} rounds")
    return done if done is not None else left.withColumnRenamed("raw", "score")


MATCHERS = {"symmetric": symmetric, "greedy": greedy, "stable": stable, "hungarian": hungarian, "random": random_matching}


def largest_component(matches: DataFrame, threshold: float) -> int:
    ends = matches.where(F.col("score") >= threshold).select(
        F.concat(F.lit("p:"), F.col("plain").cast("string")).alias("src"), F.concat(F.lit("e:"), F.col("enc").cast("string")).alias("dst")
    )
    return connected_components(ends).groupBy("component").count().agg(F.max("count")).first()[0] or 0


def threshold_search(matches: DataFrame, low: int = 2000, high: int = 2100, start: float = 0.0, end: float = 1.0, most_rounds: int = 25) -> float:
    """The score at which the largest component has between low and high nodes, by interpolation."""
    size_lo = largest_component(matches, start)
    if size_lo <= high:
        return start
    size_hi = largest_component(matches, end)
    last = None
    for _ in range(most_rounds):
        t = start + (high - size_lo) / (size_hi - size_lo) * (end - start) if size_hi != size_lo else (start + end) / 2
        t = min(end, t + 0.01) if last is not None and abs(t - last) < 1e-9 else t
        last, size = t, largest_component(matches, t)
        if low <= size <= high:
            return t
        if size > high:
            start, size_lo = t, size
        else:
            end, size_hi = t, size
        if end - start < 1e-9:
            break
    return end
