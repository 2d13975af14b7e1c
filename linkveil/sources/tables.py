"""Sources and sinks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkveil.functions.columns import normal, record_id, record_value, soundex

#: A row with such a cell, as it is written, is left out.
EXCLUDED = ("removed", "confidential")


def delimiter(option: str) -> str:
    """S3: `tab`, one character, or one character in quotes."""
    if option.lower() == "tab":
        return "\t"
    if len(option) == 3 and option[0] == option[2] and option[0] in "'\"":
        return option[1]
    if len(option) == 1:
        return option
    raise ValueError("a delimiter is one character, quoted or not, or tab")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited text file, gzipped or not; every cell is a string, absent ones are empty."""
    df = spark.read.csv(path, sep=delimiter(sep), header=header, inferSchema=False)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def resolved(df: DataFrame, columns: list[int | str]) -> list[str]:
    """Names of columns given by name or index."""
    return [df.columns[c] if isinstance(c, int) else c for c in columns]


def included(df: DataFrame) -> Column:
    cell = lambda c: F.col(f"`{c}`").cast("string")
    return ~reduce(lambda a, b: a | b, [F.coalesce(cell(c).isin(*EXCLUDED), F.lit(False)) for c in df.columns])


def records(df: DataFrame, id_column: int | str, attributes: list[int | str], salt: int | str | None = None) -> DataFrame:
    """(rec_id, a0, a1, ..., rec_val, salt) of rows without an excluded cell."""
    (key,), names = resolved(df, [id_column]), resolved(df, attributes)
    salt_column = normal(F.col(f"`{resolved(df, [salt])[0]}`").cast("string")) if salt is not None else F.lit(None).cast("string")
    text = [F.col(f"`{n}`").cast("string") for n in names]
    in_order = [F.col(f"`{c}`").cast("string") for c in df.columns if c in names]
    return df.where(included(df)).select(
        record_id(F.col(f"`{key}`").cast("string")).alias("rec_id"), *[normal(t).alias(f"a{i}") for i, t in enumerate(text)], record_value(*in_order).alias("rec_val"), salt_column.alias("salt")
    )


def last_of_each_id(recs: DataFrame, order: str | None = None) -> DataFrame:
    """One record per id, the last by `order`; value frequencies count every row and use records() as it is."""
    by = F.col(order) if order else F.struct(*[c for c in recs.columns if c != "rec_id"])
    return recs.groupBy("rec_id").agg(F.max_by(F.struct(*[c for c in recs.columns if c != "rec_id"]), by).alias("r")).select("rec_id", "r.*")


def value_ids(recs: DataFrame) -> DataFrame:
    """(rec_val, n, n_ids, first_id): rows and distinct ids of each value; a common value's ids do not meet in one row."""
    pairs = recs.groupBy("rec_val", "rec_id").agg(F.count("*").alias("m"))
    return pairs.groupBy("rec_val").agg(F.sum("m").alias("n"), F.count("*").alias("n_ids"), F.min("rec_id").alias("first_id"))


def graph_records(df: DataFrame, id_column: int | str, attributes: list[int | str], soundex_columns: list[int | str] = (), limit: int = -1) -> DataFrame:
    """(rec_id, a0, ..., rec_val, code): at most `limit` rows (a feature of the loader; -1: all), without rows whose attributes are all empty."""
    rows = df if limit < 0 else df.limit(limit)
    (key,), names, coded = resolved(df, [id_column]), resolved(df, attributes), resolved(df, list(soundex_columns))
    values = [normal(F.col(f"`{n}`").cast("string")) for n in names]
    code = F.concat_ws("-", *[soundex(F.col(f"`{n}`").cast("string")) for n in coded]) if coded else F.lit("")
    out = rows.select(record_id(F.col(f"`{key}`").cast("string")).alias("rec_id"), *[v.alias(f"a{i}") for i, v in enumerate(values)], F.concat_ws(" ", *values).alias("rec_val"), code.alias("code"))
    return out.where(F.trim("rec_val") != "")


def append_csv(df: DataFrame, path: str) -> None:
    """Rows after those that are there, with a header in each file."""
    df.write.mode("append").option("header", True).csv(path)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def status_row(spark: SparkSession, analysis: str, reason: str, **parameters) -> DataFrame:
    """A row that says why an analysis has no result."""
    return spark.createDataFrame([(analysis, reason, {k: str(v) for k, v in parameters.items()})], "analysis string, stop_reason string, parameters map<string,string>")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, name: str) -> None:
    """A graph under the name of its parameters."""
    nodes.write.mode("overwrite").parquet(f"{folder}/{name}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/{name}/edges")


def read_graph(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/{name}/nodes"), spark.read.parquet(f"{folder}/{name}/edges")


def write_features(features: DataFrame, path: str) -> None:
    """S8."""
    features.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Features with the least and largest value of each column, computed anew."""
    df = spark.read.parquet(path)
    names = columns or [c for c in df.columns if c != "node"]
    row = df.agg(*[f(c).alias(f"{p}{c}") for c in names for p, f in (("lo", F.min), ("hi", F.max))]).first()
    return df, {c: (row[f"lo{c}"], row[f"hi{c}"]) for c in names}


def save_model(model, path: str) -> None:
    """S9."""
    model.write().overwrite().save(path)


def load_model(kind: str, path: str):
    from pyspark.ml.regression import IsotonicRegressionModel, LinearRegressionModel

    return (IsotonicRegressionModel if kind == "isotonic" else LinearRegressionModel).load(path)


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """(items): one set of blank-separated items per line."""
    return spark.read.text(path).select(F.array_distinct(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")).alias("items")).where(F.size("items") > 0)


def histogram(df: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """What a plot of the column would show: (value rounded, n)."""
    return df.groupBy(F.round(column, digits).alias("value")).agg(F.count("*").alias("n"))


def density(df: DataFrame, column: str, points: list[float], bandwidth: float, digits: int = 3) -> DataFrame:
    """(at, density): a Gaussian kernel estimate at points, from the histogram of the rounded column."""
    bins = histogram(df, column, digits).where("value is not null")
    each = bins.select("n", F.explode(F.array(*map(F.lit, points))).alias("at"), "value")
    kernel = F.exp(-F.pow((F.col("at") - F.col("value")) / bandwidth, 2) / 2) / (bandwidth * math.sqrt(2 * math.pi))
    return each.groupBy("at").agg((F.sum(F.col("n") * kernel) / F.sum("n")).alias("density"))


def regression_points(df: DataFrame, x: str, y: str, digits: int = 2) -> DataFrame:
    """(x, y, n): a scatter plot's points, rounded and counted."""
    return df.groupBy(F.round(x, digits).alias("x"), F.round(y, digits).alias("y")).agg(F.count("*").alias("n"))


def write_features_csv(features: DataFrame, path: str) -> None:
    """S8 as delimited text with a header."""
    features.write.mode("overwrite").option("header", True).csv(path)


def read_features_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Node as text, columns as doubles."""
    return spark.read.schema("node string, " + ", ".join(f"`{c}` double" for c in columns)).option("header", True).csv(path)


class Datasets:
    """Named tables that a user has brought in."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def add(self, name: str, path: str, sep: str = ",", columns: list[int | str] | None = None) -> DataFrame:
        df = read_delimited(self.spark, path, sep)
        df = df.select(*[f"`{c}`" for c in resolved(df, columns)]) if columns else df
        df.createOrReplaceTempView(name)
        self.paths[name] = path
        return df

    def names(self) -> list[str]:
        return sorted(self.paths)

    def drop(self, name: str) -> None:
        self.paths.pop(name)
        self.spark.catalog.dropTempView(name)


def numbered(df: DataFrame, order: str, name: str = "row") -> DataFrame:
    """P1's dense row numbers, in pieces: numbers start where the range partitions before end."""
    parts = df.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id())
    from linkveil.session import materialize

    parts = materialize(parts, "ranges")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    inside = Window.partitionBy("__p").orderBy(order)
    out = parts.withColumn("__k", F.row_number().over(inside)).join(F.broadcast(starts), F.col("__p") == F.col("__q"))  # one row per partition
    return out.select(*df.columns, (F.col("__from") + F.col("__k") - 1).alias(name))


def bit_columns(encoded: DataFrame, key: str = "rec_id", bits: str = "bits") -> DataFrame:
    """(pos, chunk, bitmap): each bit column as bitmaps of 32,768 rows, rows ordered by id."""
    rows = numbered(encoded.select(key, bits), key)
    each = rows.select(F.explode(bits).alias("pos"), "row")
    return each.groupBy("pos", F.expr("bitmap_bucket_number(row + 1)").alias("chunk")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(row + 1))").alias("bitmap"))
