"""Re-identification accuracy (V1-V7): how many values and entities an analysis has given away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkveil.functions.columns import jaccard, suspicion, token_overlap
from linkveil.operators.components import connected_components
from linkveil.session import materialize


def component_classes(edges: DataFrame, truth: Column | str = "truth") -> DataFrame:
    """V2: one row per encoded item: (enc, component, class, correct).

    edges: enc, plain, and the true plain item of enc. Components are classed by 1 or m items on either side; -p: some encoded
    items are wrong, -w: all are. An item is correct if its truth is among the plain items of its component.
    """
    true = F.col(truth) if isinstance(truth, str) else truth
    own = materialize(edges.select(F.col("enc").cast("string").alias("enc"), F.col("plain").cast("string").alias("plain"), true.cast("string").alias("truth")).distinct(), "match-edges")
    ends = own.select(F.concat(F.lit("e:"), "enc").alias("src"), F.concat(F.lit("p:"), "plain").alias("dst"))
    comps = materialize(connected_components(ends), "match-components")
    placed = own.join(comps, F.concat(F.lit("e:"), "enc") == F.col("node")).select("enc", "plain", "truth", "component")
    plains = placed.select("component", F.col("plain").alias("truth")).distinct().withColumn("hit", F.lit(True))
    truths = placed.select("component", "enc", "truth").distinct()
    right = truths.join(plains, ["component", "truth"], "left").groupBy("component", "enc").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("correct"))
    sizes = placed.groupBy("component").agg(F.count_distinct("enc").alias("e"), F.count_distinct("plain").alias("p"))
    good = right.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("c"))
    one = lambda c: F.when(F.col(c) == 1, "1").otherwise("m")
    mark = F.when(F.col("c") == F.col("n"), "").when(F.col("c") > 0, "-p").otherwise("-w")
    classed = sizes.join(good, "component").select("component", F.concat(one("e"), F.lit("-"), one("p")).alias("type"), mark.alias("mark"))
    return right.join(classed, "component").select("enc", "component", "type", F.concat("type", "mark").alias("class"), "correct")


def class_counts(classes: DataFrame) -> DataFrame:
    """(class, components)."""
    return classes.select("component", "class").distinct().groupBy("class").agg(F.count("*").alias("components"))


def item_counts(classes: DataFrame) -> DataFrame:
    """(type, items): correct items by type, and wrong ones."""
    return classes.groupBy(F.when(F.col("correct"), F.col("type")).otherwise("wrong").alias("type")).agg(F.count("*").alias("items"))


def suspicion_summary(edges: DataFrame, population: int) -> DataFrame:
    """V4: (values, most, least, mean, median, certain) of the suspicion of the encoded items that are met by their truth.

    edges: enc, plain, truth. f is the number of plain items that the encoded item is matched with; zeros without any.
    """
    f = edges.groupBy("enc").agg(F.count_distinct("plain").alias("f"), F.bool_or(F.col("plain") == F.col("truth")).alias("ok")).where("ok")
    s = f.select(suspicion(F.col("f"), population).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return s.agg(
        F.count("*").alias("values"), zero(F.max("s")).alias("most"), zero(F.min("s")).alias("least"), zero(F.avg("s")).alias("mean"), zero(F.percentile("s", F.lit(0.5))).alias("median"),
        F.count(F.when(F.col("s") == 1, 1)).alias("certain"),
    )


def summary(entity_edges: DataFrame, value_edges: DataFrame, population: int) -> dict[str, DataFrame]:
    """V1: both views of a result: entities and attribute values."""
    out = {}
    for name, edges in (("entity", entity_edges), ("value", value_edges)):
        classes = component_classes(edges)
        out |= {f"{name}_classes": class_counts(classes), f"{name}_items": item_counts(classes), f"{name}_suspicion": suspicion_summary(edges, population)}
    return out


def most_confident(results: DataFrame) -> DataFrame:
    """V3: the most confident row of every (enc_id, plain_id)."""
    return results.groupBy("enc_id", "plain_id").agg(F.max_by(F.struct("enc_val", "true_val", "plain_val", "conf"), F.struct("conf", "plain_val")).alias("b")).select("enc_id", "plain_id", "b.*")


def guess_accuracy(guesses: DataFrame, most_many: int = 10) -> DataFrame:
    """V5: (filter, outcome, n, accuracy) of candidate values per filter, without and with the length filter.

    guesses: rec_id, true_value, value, n_grams (of value), lower, upper. Outcomes: no_guess, 1-1 or 1-m exact and partial (by the
    largest share of common tokens), too_many.
    """
    out = None
    for name, keep in (("all", F.lit(True)), ("length", F.col("n_grams").between(F.col("lower"), F.col("upper")))):
        value = F.when(keep, F.col("value"))
        each = guesses.groupBy("rec_id", "true_value").agg(
            F.count_distinct(value).alias("n"), F.coalesce(F.bool_or(value == F.col("true_value")), F.lit(False)).alias("exact"), F.coalesce(F.max(token_overlap(F.col("true_value"), value)), F.lit(0.0)).alias("part")
        )
        kind = F.when(F.col("n") == 0, "no_guess").when(F.col("n") > most_many, "too_many")
        shape = F.when(F.col("n") == 1, "1-1").otherwise("1-m")
        outcome = kind.otherwise(F.concat(shape, F.when(F.col("exact"), " exact").when(F.col("part") > 0, " partial").otherwise(" wrong")))
        one = each.select(F.lit(name).alias("filter"), outcome.alias("outcome"), F.when(F.col("exact"), 1.0).otherwise(F.col("part")).alias("a"))
        got = one.groupBy("filter", "outcome").agg(F.count("*").alias("n"), F.avg("a").alias("accuracy"))
        out = got if out is None else out.unionByName(got)
    return out


def reduction_ratio(guesses: DataFrame) -> DataFrame:
    """V5: mean of 1 - candidates within the length bounds / all candidates."""
    inside = F.when(F.col("n_grams").between(F.col("lower"), F.col("upper")), F.col("value"))
    each = guesses.groupBy("rec_id").agg(F.count_distinct("value").alias("n"), F.count_distinct(inside).alias("m"))
    return each.where("n > 0").agg(F.avg(1 - F.col("m") / F.col("n")).alias("reduction"))


def match_truth(matches: DataFrame, plain: DataFrame, enc: DataFrame, least: float = 1.0) -> DataFrame:
    """V7: matches with same (the nodes share an original value) and alike (their q-gram sets have at least that Jaccard similarity)."""
    a = plain.select(F.col("node").alias("plain"), F.col("values").alias("__v"), F.col("grams").alias("__g"))
    b = enc.select(F.col("node").alias("enc"), F.col("values").alias("__w"), F.col("grams").alias("__h"))
    return matches.join(a, "plain").join(b, "enc").select(
        *matches.columns, F.arrays_overlap("__v", "__w").alias("same"), (jaccard(F.col("__g"), F.col("__h")) >= least).alias("alike")
    )
