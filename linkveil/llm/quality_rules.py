"""Quality rules: learned decision lists over native text statistics (operator 9).

Sequential covering: each rule starts empty and takes the threshold condition with the best FOIL gain on the
growing part of the labelled rows; it is pruned on the other part; rows that it covers leave, and the next rule
starts. Every step is one aggregation of counts by (statistic, bin, label), so labels may be of any number; the
bins are quantiles of the labelled rows. The list is emitted as one ordered CASE expression.

Edge cases: null and empty texts have no words (n_words 0, so base_failed); a statistic over no words is 0; null
labels are not used; without labels, or when nothing meets the precision asked for, the list is empty and the base
rules alone decide; repeated rows and tied values are treated alike; of equal gains the first statistic, its least
threshold and `<=` win; of heads equally precise the shortest stays; a very long text is counted in whole, in time that
grows with its words; an empty table gives an empty result; other columns are ignored, a stage keeps them (names that
begin with two underscores are the operator's own).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkveil.llm.common import SPACED_WORD, count_of, find_all, let, table
from linkveil.session import materialize

#: Statistics that conditions may use, by name.
STATISTICS = (
    "s_words", "s_word_len", "s_symbols", "s_dup_lines", "s_repeats", "s_distinct", "s_upper", "s_digits", "s_bars", "s_marks",
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class RuleParams:
    max_rules: int = 8
    max_conditions: int = 4
    quantiles: int = 40
    min_precision: float = 0.97
    #: rejected rows that a condition must leave in the growing part, and a rule in the pruning part, at least
    min_cover: int = 5
    min_prune: int = 2
    #: rows that the list is fitted on at most, taken by a hash of the id
    max_fit_rows: int = 40_000


@dataclass
class Rule:
    """A conjunction of (statistic, '<=' or '>', threshold); documents that meet it are rejected."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        out = F.lit(True)
        for name, op, at in self.conditions:
            out = out & (of(name) > F.lit(at) if op == ">" else of(name) <= F.lit(at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {o} {t:g}" for n, o, t in self.conditions)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of width words found twice or more in the same text."""

    def covered(wins: Column) -> Column:
        def by_sort(s: Column) -> Column:
            same = F.filter(
                s,
                lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]),
            )
            at = F.array_sort(F.transform(same, lambda e: e["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            total = F.aggregate(
                at,
                start,
                lambda acc, p: F.struct(
                    (acc["n"] + p + width - F.greatest(p, acc["end"])).alias("n"), (p + width).alias("end")
                ),
            )
            return total["n"].cast("long")

        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), by_sort)
        )

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - width),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]),
        )

    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), covered))
    )


def statistics_of(text: Column) -> Column:
    """A struct of the BASE counts and STATISTICS of a text. It is one expression in which nothing is evaluated twice, however
    often the optimizer copies a reference to a part of it."""

    def derived(c: Column) -> Column:
        per_word = lambda x: F.when(c["n_words"] > 0, c[x] / c["n_words"]).otherwise(F.lit(0.0))
        of = {
            "s_words": c["n_words"].cast("double"), "s_word_len": per_word("word_chars"), "s_symbols": per_word("n_symbols"), "s_dup_lines": per_word("n_dup_lines"),
            "s_repeats": per_word("n_repeat_words"), "s_distinct": per_word("distinct"), "s_upper": per_word("upper"), "s_digits": per_word("digits"),
            "s_bars": per_word("bars"), "s_marks": per_word("marks"),
        }
        return F.struct(*[c[n].alias(n) for n in BASE], *[of[n].alias(n) for n in STATISTICS])

    def counted(t: Column, w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(SPACED_WORD))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            count_of(t, r"[#*$%&|<>]").alias("n_symbols"),
            let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).alias("distinct"),
            count_of(t, r"[A-Z]").alias("upper"),
            count_of(t, r"[0-9]").alias("digits"),
            count_of(t, r"[|]").alias("bars"),
            count_of(t, r"[!?.,;:]").alias("marks"),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(find_all(t, SPACED_WORD), lambda w: let(counted(t, w), derived)))


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, the BASE counts and STATISTICS of every whole text."""
    return docs.select(*keep, statistics_of(F.col(text)).alias("__s")).select(*keep, *[F.col("__s")[n].alias(n) for n in (*BASE, *STATISTICS)])


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    return (of("n_words") < 10) | (100 * of("n_repeat_words") > 20 * of("n_words"))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of a refinement that covers p bad and n good rows, of p0 and n0."""
    if not p:
        return float("-inf")
    return p * (math.log2((p + 1) / (p + n + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2)))


def bin_of(name: str, cuts: list[float]) -> Column:
    """How many cuts the statistic lies above."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: F.col(name) > t)) if cuts else F.lit(0)


def cuts_of(labelled: DataFrame, quantiles: int) -> dict[str, list[float]]:
    """The thresholds that conditions may use: quantiles of each statistic over all rows and over the bad ones."""
    probs = [i / quantiles for i in range(quantiles + 1)]
    found = labelled.select(
        *[
            F.array_sort(F.array_distinct(F.concat(*[
                F.coalesce(F.percentile_approx(F.when(side, F.col(s)), probs, 20_000), F.array().cast("array<double>")) for side in (F.lit(True), F.col("bad"))
            ]))).alias(s)
            for s in STATISTICS
        ]
    ).first()
    return {s: list(found[s] or []) for s in STATISTICS}


def learn_rules(labelled: DataFrame, params: RuleParams | None = None) -> list[Rule]:
    """A decision list from labelled rows: STATISTICS, a boolean `bad`, a boolean `grow` (else: prune)."""
    params = params or RuleParams()
    cuts = cuts_of(labelled, params.quantiles)
    if not any(cuts.values()):
        return []
    bins = labelled.select(
        "bad",
        "grow",
        *STATISTICS,
        F.array(*[
            bin_of(s, cuts[s]) for s in STATISTICS
        ]).alias("bins"),
    )
    bins = materialize(bins, "rule-bins")

    def counts(rows: DataFrame) -> dict[tuple[int, int], list[int]]:
        """By (statistic, bin): bad and good rows of the growing part, then of the pruning part."""
        got = (
            rows.select("bad", "grow", F.posexplode("bins").alias("s", "bin"))
            .groupBy("s", "bin")
            .agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (
                ("gb", F.expr("grow and bad")), ("gg", F.expr("grow and not bad")), ("pb", F.expr("not grow and bad")), ("pg", F.expr("not grow and not bad")))])
        )
        return {(r["s"], r["bin"]): [r["gb"], r["gg"], r["pb"], r["pg"]] for r in got.collect()}

    rules: list[Rule] = []
    left = bins
    for _ in range(params.max_rules):
        rule, inside, path = Rule(), left, []
        table_ = counts(inside)
        whole = [sum(v[k] for (s, _), v in table_.items() if s == 0) for k in range(4)]
        if whole[0] < params.min_cover:
            break
        path.append(whole)
        while len(rule.conditions) < params.max_conditions and path[-1][1] > 0:
            best = None
            for s, name in enumerate(STATISTICS):
                below = [0, 0, 0, 0]
                for b in range(len(cuts[name])):
                    below = [x + y for x, y in zip(below, table_.get((s, b), [0] * 4), strict=True)]
                    above = [x - y for x, y in zip(path[-1], below, strict=True)]
                    for op, c in (("<=", below), (">", above)):
                        if c[0] < params.min_cover or sum(c[:2]) == sum(path[-1][:2]):
                            continue
                        g = _gain(c[0], c[1], path[-1][0], path[-1][1])
                        if best is None or g > best[0]:
                            best = (g, name, op, cuts[name][b], c)
            if best is None or best[0] <= 0:
                break
            rule.conditions.append(best[1:4])
            path.append(best[4])
            inside = left.where(rule.column())
            table_ = counts(inside)
        # prune: the shortest head of the conjunction whose precision on the pruning part is best
        worth = lambda c: (c[2] + 1) / (c[2] + c[3] + 2)
        keep = max(range(1, len(path)), key=lambda k: (round(worth(path[k]), 4), -k), default=0)
        if not keep or path[keep][2] < params.min_prune or any(path[keep][k] < params.min_precision * sum(path[keep][k : k + 2]) for k in (0, 2)):
            break
        rule.conditions = rule.conditions[:keep]
        rules.append(rule)
        left = left.where(~rule.column())
    return rules


def verdict(rules: list[Rule], of: Callable[[str], Column] = F.col) -> Column:
    """The list as an ordered CASE expression over statistics: true where the document stays."""
    out = F.when(base_failed(of), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(of), F.lit(False))
    return out.otherwise(F.lit(True))


def rated_rows(labels: DataFrame, params: RuleParams) -> DataFrame:
    """(__id, __q) of at most about max_fit_rows rated ids, taken by a hash of the id; the lowest rating where there are several."""
    rated = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__q"))
    n = rated.count()
    if n > params.max_fit_rows:
        rated = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(1e6 * params.max_fit_rows / n))
    return rated.withColumnRenamed("doc_id", "__id")


def fit_rules(stats: DataFrame, params: RuleParams | None = None) -> list[Rule]:
    """Learns from statistics with their rating __q, of documents that pass the base rules."""
    rows = stats.where(~base_failed()).select(
        *STATISTICS,
        (F.col("__q") <= 0).alias("bad"),
        (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) > 0).alias("grow"),
    )
    return learn_rules(rows, params)


def judge(docs: DataFrame, labels: DataFrame, params: RuleParams | None = None) -> tuple[DataFrame, list[Rule]]:
    """doc_id, the BASE counts, base_failed and kept of every document, and the list that decided."""
    stats = materialize(text_statistics(docs), "text-statistics")
    rated = rated_rows(labels, params or RuleParams())
    rules = fit_rules(stats.join(rated, F.col("doc_id") == F.col("__id")), params)
    out = stats.select("doc_id", *BASE, base_failed().alias("base_failed"), verdict(rules).alias("kept"), *STATISTICS)
    return out, rules


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *BASE, "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep, with the columns of docs."""
    rated = rated_rows(table(spark, sf_dir, "labels"), RuleParams())
    few = docs.select("doc_id", "text").join(F.broadcast(rated), F.col("doc_id") == F.col("__id"))  # max_fit_rows bounds it
    rules = fit_rules(materialize(text_statistics(few, keep=("doc_id", "__q")), "rated-statistics"))
    return docs.where(let(statistics_of(F.col("text")), lambda s: verdict(rules, lambda name: s[name])))
