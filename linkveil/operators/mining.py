"""Frequent bit positions and what they reveal (M1-M9, J4-J8, F13 in use).

Apriori runs level by level as DataFrames. The maximal search packs the distinct filters, restricted to frequent
positions, into weighted patterns on the driver and walks them depth first with bit vectors; the number of patterns is
checked first. Beyond the bounds of either, supports are counted by DataFrame jobs, depth first, until the rows of a
head are few enough patterns for the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkveil.operators import statistics
from linkveil.session import materialize

#: Distinct restricted patterns, and item sets of a level, that the driver takes at most.
MOST_PATTERNS = 200_000


def with_all(bits: Column, positions: Iterable[int]) -> Column:
    """Rows whose bits are all 1 at positions."""
    out = F.lit(True)
    for p in positions:
        out = out & F.array_contains(bits, int(p))
    return out


def frequent_positions(encoded: DataFrame, least: int, excluded: Iterable[int] = (), bits: str = "bits") -> DataFrame:
    """(pos, n) of single positions with at least `least` rows."""
    rows = encoded.select(F.explode(F.array_except(bits, F.array(*map(F.lit, excluded)).cast("array<int>"))).alias("pos"))
    return rows.groupBy("pos").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def apriori(encoded: DataFrame, least: int, excluded: Iterable[int] = (), bits: str = "bits") -> DataFrame:
    """M1, M2: (items, n): every longest frequent position tuple with its support.

    Candidates of a level join on their common prefix and are counted with one broadcast of the candidates; the table of
    restricted filters is read once per level. A level with more candidates than MOST_PATTERNS goes to deep_search.
    """
    spark = encoded.sparkSession
    singles = [(r["pos"], r["n"]) for r in frequent_positions(encoded, least, excluded, bits).collect()]  # at most the filter's length
    if not singles:
        return spark.createDataFrame([], "items array<int>, n long")
    known = sorted(p for p, _ in singles)
    rows = restricted(encoded, known, bits)
    level = {(p,): n for p, n in singles}
    while level:
        size = len(next(iter(level)))
        items = sorted(level)
        new = []
        for i, a in enumerate(items):
            for b in items[i + 1 :]:
                if a[:-1] != b[:-1] or len(new) > MOST_PATTERNS:
                    break
                c = (*a, b[-1])
                if all(c[:k] + c[k + 1 :] in level for k in range(size - 1)):
                    new.append(c)
        if not new:
            break
        if len(new) > MOST_PATTERNS:
            level = deep_search(rows, known, least)
            break
        table = spark.createDataFrame([(list(c), c[0]) for c in new], "items array<int>, head int")
        got = (
            rows.select("own", "w", F.explode("own").alias("head"))
            .join(F.broadcast(table), "head")
            .where(F.size(F.array_intersect("own", "items")) == size + 1)
            .groupBy("items")
            .agg(F.sum("w").alias("n"))
            .where(F.col("n") >= least)
            .collect()
        )
        if not got:
            break
        level = {tuple(r["items"]): r["n"] for r in got}
    return spark.createDataFrame([(list(k), int(v)) for k, v in sorted(level.items())], "items array<int>, n long")


def restricted(encoded: DataFrame, positions: list[int], bits: str = "bits") -> DataFrame:
    """(own, w): the distinct filters restricted to positions, with the number of their rows, as a table."""
    own = F.array_intersect(F.array_sort(bits), F.array(*map(F.lit, positions)))
    return materialize(encoded.select(own.alias("own")).where(F.size("own") > 0).groupBy("own").agg(F.count("*").alias("w")), "restricted")


def deep_search(rows: DataFrame, positions: list[int], least: int) -> dict[tuple[int, ...], int]:
    """Every longest frequent tuple of (own, w) rows, depth first, at any number of patterns and any length.

    A head's supports are counted by jobs over the rows that hold it; once these are at most MOST_PATTERNS patterns, the
    driver walks them. Heads that cannot reach the longest length found are left out.
    """
    found: dict[tuple[int, ...], int] = {}

    def add(items: list[int], n: int) -> None:
        most = max(map(len, found), default=0)
        if len(items) > most:
            found.clear()
        if len(items) >= most:
            found[tuple(sorted(items))] = n

    def walk(head: list[int], n: int, tail: list[int]) -> None:
        held = rows.where(with_all(F.col("own"), head))
        counts = held.select(F.explode(F.array_intersect("own", F.array(*map(F.lit, tail)).cast("array<int>"))).alias("pos"), "w").groupBy("pos").agg(F.sum("w").alias("n"))
        inside = sorted((r["n"], r["pos"]) for r in counts.where(F.col("n") >= least).collect())  # at most the filter's length
        rest = [p for _, p in inside]
        if len(head) + len(rest) < max(map(len, found), default=0):
            return
        if not rest:
            if head:
                add(head, n)
            return
        own = held.select(F.array_intersect("own", F.array(*map(F.lit, rest))).alias("own"), "w").where(F.size("own") > 0)
        whole = own.where(F.size("own") == len(rest)).agg(F.sum("w")).first()[0] or 0
        if whole >= least:
            add(head + rest, whole)
            return
        try:
            table, weight = packed(own.groupBy("own").agg(F.sum("w").alias("w")), rest)
        except OverflowError:
            for k, (m, p) in enumerate(inside):
                if len(head) + len(rest) - k >= max(map(len, found), default=0):
                    walk([*head, p], m, rest[k + 1 :])
        else:
            for items, m in maximal_tuples(table, weight, rest, least).items():
                add([*head, *items], m)

    walk([], 0, positions)
    return found


def patterns_of(encoded: DataFrame, positions: list[int], bits: str = "bits") -> tuple[np.ndarray, np.ndarray]:
    """Distinct filters restricted to positions: (positions x patterns) bits and the weight of each pattern."""
    own = F.array_intersect(F.array_sort(bits), F.array(*map(F.lit, positions)))
    return packed(encoded.select(own.alias("own")).groupBy("own").agg(F.count("*").alias("w")), positions)


def packed(patterns: DataFrame, positions: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (own, w) as (positions x patterns) bits and the weight of each pattern."""
    got = patterns.limit(MOST_PATTERNS + 1).collect()
    if len(got) > MOST_PATTERNS:
        raise OverflowError("too many distinct patterns for the driver")
    at = {p: k for k, p in enumerate(positions)}
    table = np.zeros((len(positions), len(got)), bool)
    for j, r in enumerate(got):
        for p in r["own"]:
            table[at[p], j] = True
    return table, np.array([r["w"] for r in got], dtype=np.int64)


def maximal_tuples(table: np.ndarray, weight: np.ndarray, positions: list[int], least: int) -> dict[tuple[int, ...], int]:
    """M3-M5: all maximal frequent tuples by depth-first search: rarest positions first, the rest tried as a whole first."""
    support = lambda rows: int(weight[rows].sum())
    order = sorted((i for i in range(len(positions)) if support(table[i]) >= least), key=lambda i: (support(table[i]), i))
    found: list[frozenset[int]] = []
    out: dict[tuple[int, ...], int] = {}

    def walk(head: list[int], rows: np.ndarray, tail: list[int]) -> None:
        inside = [(n, i) for i in tail if (n := support(rows & table[i])) >= least]
        if any(set(head) | {i for _, i in inside} <= s for s in found):
            return
        if inside:
            whole = rows & np.logical_and.reduce([table[i] for _, i in inside])
            if support(whole) >= least:
                add(head + [i for _, i in inside], whole)
                return
            inside.sort()
            rest = [i for _, i in inside]
            for k, i in enumerate(rest):
                walk([*head, i], rows & table[i], rest[k + 1 :])
        elif head:
            add(head, rows)

    def add(items: list[int], rows: np.ndarray) -> None:
        s = frozenset(items)
        if not any(s <= x for x in found):
            found.append(s)
            out[tuple(sorted(positions[i] for i in items))] = support(rows)

    walk([], np.ones(len(weight), bool), order)
    return out


def longest_tuples(encoded: DataFrame, least: int, excluded: Iterable[int] = (), bits: str = "bits", method: str = "maximal") -> dict[tuple[int, ...], int]:
    """Every longest frequent tuple with its support: by apriori, maximal search or fpgrowth (M1-M6); all agree (M7)."""
    if method == "apriori":
        return {tuple(r["items"]): r["n"] for r in apriori(encoded, least, excluded, bits).collect()}
    if method == "fpgrowth":
        found = fp_growth(encoded, least, excluded, bits)
        return {tuple(sorted(r["items"])): r["freq"] for r in found.where(F.size("items") == found.agg(F.max(F.size("items"))).first()[0]).collect()} if not found.isEmpty() else {}
    if method != "maximal":
        raise ValueError("method is apriori, maximal or fpgrowth")
    positions = sorted(r["pos"] for r in frequent_positions(encoded, least, excluded, bits).collect())
    try:
        table, weight = patterns_of(encoded, positions, bits)
    except OverflowError:
        return deep_search(restricted(encoded, positions, bits), positions, least)
    found = maximal_tuples(table, weight, positions, least)
    most = max(map(len, found), default=0)
    return {k: n for k, n in found.items() if len(k) == most}


def fp_growth(encoded: DataFrame, least: int, excluded: Iterable[int] = (), bits: str = "bits") -> DataFrame:
    """M6: all frequent position sets by MLlib's FP-growth; for filters with few frequent positions."""
    from pyspark.ml.fpm import FPGrowth

    rows = encoded.select(F.array_except(bits, F.array(*map(F.lit, excluded)).cast("array<int>")).alias("items"))
    n = max(1, rows.count())
    return FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n), minConfidence=1.0).fit(rows).freqItemsets


def maximal_only(itemsets: DataFrame) -> DataFrame:
    """M5: the item sets that no other contains; each is compared with those one longer that hold it."""
    longer = itemsets.select(F.explode("items").alias("drop"), "items").select(F.array_sort(F.array_remove("items", F.col("drop"))).alias("sub")).distinct()
    return itemsets.withColumn("key", F.array_sort("items")).join(longer, F.col("key") == F.col("sub"), "left_anti").drop("key")


def frequent_pairs(encoded: DataFrame, least: int, bits: str = "bits", positions: list[int] | None = None) -> DataFrame:
    """M1's second level: (p1, p2, n)."""
    own = F.array_sort(bits) if positions is None else F.array_intersect(F.array_sort(bits), F.array(*map(F.lit, positions)))
    pairs = F.flatten(F.transform(own, lambda a: F.transform(F.filter(own, lambda b: b > a), lambda b: F.struct(a.alias("p1"), b.alias("p2")))))
    return encoded.select(F.explode(pairs).alias("p")).groupBy("p.p1", "p.p2").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# -- M8: recursive partition search


@dataclass
class Found:
    """Positions that each q-gram was given, in the order found."""

    positions: dict[str, set[int]] = field(default_factory=dict)
    tuples: list[tuple[str, tuple[int, ...], int]] = field(default_factory=list)
    stop_reason: str = "done"


def difference_percent(n1: int, n2: int) -> float:
    mean = (n1 + n2) / 2
    return 100.0 * (n1 - n2) / mean if mean else 0.0


def partition_search(plain: DataFrame, encoded: DataFrame, stop_percent: float = 1.0, least_part: int = 100, most_rounds: int | None = None, method: str = "maximal") -> Found:
    """M8. plain: rec_id, grams; encoded: rec_id, bits. Rows of a partition are a predicate on bits, so a round reads the one table.

    It ends when no partition is left: a round that adds any takes a q-gram not taken before. Where most_rounds ends it before, stop_reason says so.
    """
    encoded = materialize(encoded.select("rec_id", "bits"), "encoded")
    plain = materialize(plain.select("grams"), "plain")
    plain_n, whole = plain.count(), encoded.count()
    out = Found()
    if not plain_n or not whole:
        out.stop_reason = "no rows"
        return out
    queue, rounds = [(whole, frozenset(), F.lit(True), [], [])], 0
    while queue and rounds != most_rounds:
        rounds += 1
        queue.sort(key=lambda x: -x[0])
        size, excluded, mask, must, must_not = queue.pop(0)
        top = statistics.other_grams(plain, must, must_not).limit(2).collect()
        if len(top) < 2 or top[0]["gram"] in out.positions:
            continue
        n1, n2 = top[0]["n"], top[1]["n"]
        if difference_percent(n1, n2) < stop_percent:
            continue
        least = int((n1 + n2) / 2 / plain_n * whole)
        if least < 1:
            continue
        got = sorted(longest_tuples(encoded.where(mask), least, excluded, method=method).items(), key=lambda x: (-x[1], x[0]))
        if not got or (len(got) > 1 and difference_percent(got[0][1], got[1][1]) < stop_percent):
            continue
        items, support = got[0]
        earlier = [len(t) for _, t, _ in out.tuples]
        mean = sum(earlier) / len(earlier) if earlier else 0
        if len(items) + 0.2 * mean < mean:
            continue
        gram = top[0]["gram"]
        out.positions.setdefault(gram, set()).update(items)
        out.tuples.append((gram, items, support))
        ones = with_all(F.col("bits"), items)
        for keep, more, less in ((mask & ones, [*must, gram], must_not), (mask & ~ones, must, [*must_not, gram])):
            n = encoded.where(keep).count()
            if n >= least_part:
                queue.append((n, excluded | set(items), keep, more, less))
    if queue:
        out.stop_reason = f"partitions left after {rounds} rounds"
    elif not out.tuples:
        out.stop_reason = "no frequent tuple is unique"
    return out


def assignments(encoded: DataFrame, positions: dict[str, Iterable[int]]) -> DataFrame:
    """(rec_id, must, cannot): q-grams whose positions are all 1 in the filter, and those of which one is 0."""
    none = F.array().cast("array<string>")
    must, cannot = none, none
    for g, p in sorted(positions.items()):
        ones = with_all(F.col("bits"), sorted(p))
        must = F.concat(must, F.when(ones, F.array(F.lit(g))).otherwise(none))
        cannot = F.concat(cannot, F.when(~ones, F.array(F.lit(g))).otherwise(none))
    return encoded.select("rec_id", "bits", must.alias("must"), cannot.alias("cannot"))


def estimated_k(found: Found) -> int:
    """A11 over the tuples found."""
    sizes = [len(t) for _, t, _ in found.tuples]
    return min(set(sizes), key=lambda s: (-sizes.count(s), s)) if sizes else 0


def expand(found: Found, plain: DataFrame, encoded: DataFrame, mode: str = "single", stop_percent: float = 5.0, least: int = 5, method: str = "maximal") -> Found:
    """M9: a second set of q-grams from the language model of those found: per key its most probable other q-gram."""
    k, more = estimated_k(found), Found()
    if not found.tuples:
        more.stop_reason = found.stop_reason
        return more
    model = materialize(statistics.language_model(plain, sorted(found.positions), mode, least), "language-model")
    best = model.withColumn("r", F.row_number().over(Window.partitionBy("included", "excluded").orderBy(F.desc("n_gram"), "gram"))).where("r <= 2")
    keys = best.groupBy("included", "excluded", "n").agg(F.array_sort(F.collect_list(F.struct("r", "gram", "n_gram"))).alias("top")).orderBy(F.desc("n"), "included", "excluded")
    for row in keys.collect():  # as many as the model has keys of the found q-grams
        top = row["top"]
        if len(top) == 2 and difference_percent(top[0]["n_gram"], top[1]["n_gram"]) < stop_percent:
            continue
        gram = top[0]["gram"]
        if gram in found.positions:
            continue
        share = (sum(x["n_gram"] for x in top) / len(top)) / row["n"]
        mask = with_all(F.col("bits"), sorted({p for g in row["included"] for p in found.positions[g]}))
        for g in row["excluded"]:
            mask = mask & ~with_all(F.col("bits"), sorted(found.positions[g]))
        rows = encoded.where(mask)
        least_rows = int(share * rows.count())
        if least_rows < 1:
            continue
        taken = {p for g in row["included"] for p in found.positions[g]}
        got = sorted(longest_tuples(rows, least_rows, taken, method=method).items(), key=lambda x: (-x[1], x[0]))
        if not got or len(got[0][0]) > k or (len(got) > 1 and difference_percent(got[0][1], got[1][1]) < stop_percent):
            continue
        more.positions.setdefault(gram, set()).update(got[0][0])
        more.tuples.append((gram, *got[0]))
    if not more.tuples:
        more.stop_reason = "nothing to add"
    return more


# -- re-identification


def set_intersection(assigned: DataFrame, values: DataFrame) -> DataFrame:
    """(rec_id, value): values that hold all of a filter's must q-grams and none of its cannot q-grams.

    Relational division: filters with equal sets are one profile; profiles meet values on their rarest must q-gram, and
    substrings are tested on those pairs alone.
    """
    profiles = assigned.where(F.size("must") > 0).select("must", "cannot").distinct()
    grams = values.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    rare = (
        profiles.select("must", "cannot", F.explode("must").alias("g"))
        .join(grams, "g", "left")
        .groupBy("must", "cannot")
        .agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    )
    own = values.select("value", F.explode("grams").alias("g"))
    fits = rare.join(own, "g").where(
        F.forall("must", lambda x: F.contains(F.col("value"), x)) & ~F.exists("cannot", lambda x: F.contains(F.col("value"), x))
    )
    return assigned.select("rec_id", "must", "cannot").join(fits.select("must", "cannot", "value"), ["must", "cannot"]).select("rec_id", "value")


def positions_of_grams(assigned: DataFrame, positions: dict[str, Iterable[int]], truth: DataFrame, only_correct: bool = False) -> DataFrame:
    """(pos, grams): which q-grams each position was given; with only_correct those that the truth has too."""
    rows = [(g, int(p)) for g, ps in positions.items() for p in ps]
    guessed = truth.sparkSession.createDataFrame(rows, "gram string, pos int")
    if only_correct:
        guessed = guessed.join(truth, ["gram", "pos"], "left_semi")
    return guessed.groupBy("pos").agg(F.array_sort(F.collect_set("gram")).alias("grams"))


def tuple_match(assigned: DataFrame, positions: dict[str, Iterable[int]], values: DataFrame, least: int = 3) -> DataFrame:
    """(key, rec_id, value): filters and values under the same set of q-grams.

    A filter's key is every known q-gram whose positions are all 1. Keys of fewer than `least` q-grams with more than one
    filter go; a value belongs to the longest key that it holds, if the next is shorter.
    """
    known = F.array_sort(F.array(*map(F.lit, sorted(positions))) if positions else F.array().cast("array<string>"))
    key = F.filter(known, lambda g: F.array_contains("must", g))
    filters = assigned.select("rec_id", key.alias("key")).where(F.size("key") > 0)
    keys = filters.groupBy("key").agg(F.count("*").alias("n")).where((F.size("key") >= least) | (F.col("n") == 1)).select("key")
    # keys meet values on the key's first q-gram; the rest is tested there
    heads = keys.select("key", F.get("key", F.lit(0)).alias("g"))
    held = values.select("value", "grams", F.explode("grams").alias("g")).join(heads, "g").where(F.size(F.array_except("key", "grams")) == 0)
    best = held.groupBy("value").agg(F.max(F.size("key")).alias("most"))
    only = held.join(best, "value").where(F.size("key") == F.col("most")).groupBy("value").agg(F.first("key").alias("key"), F.count("*").alias("n")).where("n = 1")
    return only.select("key", "value").join(filters, "key").select("key", "rec_id", "value")
