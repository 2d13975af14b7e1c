"""Small column helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In Java, where \s is \x20 and \x09-\x0D alone. (The same class written out and negated is several times slower.)
SPACED_WORD = r"\S+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: inside a lambda an inlined expression would run once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(word: Column) -> Column:
    """Lower-cases A-Z alone. lower() is right and fast for pure ASCII; other words go through a character map."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, upper, small))


def spread(n_bits: int, *cols: Column) -> Column:
    """A uniform number of n_bits bits from cols."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - n_bits)


#: Bytes that a broadcast side of rows without a fixed width may have.
MOST_BYTES = 32 << 20


def sized(df: DataFrame, most: int, row_bytes: Column | None = None) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows; else as it is, for a shuffled join that AQE may split.

    Rows that hold strings or arrays of any length need row_bytes, their size: they may have MOST_BYTES together.
    """
    if row_bytes is None:
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if row["n"] <= most and row["b"] <= MOST_BYTES else df


def before(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For every int of an array, `add` (associative) over the ints before it, from zero on.

    Appending to an array copies it, so the array is cut into blocks of the square root of its size: a running total over
    n ints copies n ** 1.5 of them, not n ** 2.
    """
    none = F.array().cast("array<int>")

    def run(xs: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(add(acc["at"], x).cast("int").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(xs, F.struct(start.cast("int").alias("at"), none.alias("out")), step)["out"]

    def blocks(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / width).cast("int") - 1), lambda k: F.slice(xs, k * width + 1, width))
        total = lambda x: F.aggregate(x, zero.cast("int"), lambda a, v: add(a, v).cast("int"))
        return let(cut, lambda c: F.flatten(F.zip_with(c, run(F.transform(c, total), zero), run)))

    return let(values, lambda xs: F.when(F.size(xs) == 0, none).otherwise(blocks(xs)))


def gapless(df: DataFrame, group: list[str], order: Column, ties: list[str], name: str = "slot", cell_rows: int = 50_000) -> DataFrame:
    """df with a number from 0 without gaps inside each group, by the 64-bit hash `order`, then ties.

    df must be a table (it is read twice); names that begin with two underscores are the function's own. Groups are cut into cells by the top bits of the hash, about cell_rows
    rows each at any size; cells are numbered on their own and start where the cells before them end, so no group
    is gathered in one task.
    """
    from pyspark.sql import Window

    bits = max(4, (df.count() // cell_rows).bit_length())
    rows = df.withColumn("__h", order).withColumn("__cell", F.shiftrightunsigned("__h", 64 - bits))
    sizes = rows.groupBy(*group, "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)],
        F.col("__cell").alias("__c"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"),
    )
    on = F.col("__cell") == F.col("__c")
    for k, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    inside = Window.partitionBy(*group, "__cell").orderBy("__h", *ties)
    numbered = rows.withColumn("__k", F.row_number().over(inside))
    return numbered.join(sized(starts, 100_000), on).select(*df.columns, (F.col("__from") + F.col("__k") - 1).alias(name))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of few rows while texts go to Python, so that neither side holds many texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)
