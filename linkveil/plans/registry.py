"""Queries of the engine's own operators on the test tables, with their DuckDB SQL where SQL can express them.

Plain records: all of `part`, values from p_name and p_type, salt p_size; encoded ones: those with an even p_partkey.
Results hold scalar columns; sets are joined strings; floats are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkveil.functions import columns as c
from linkveil.functions import hashing
from linkveil.operators import blocking, encoders, evaluate, frequency, graph, hardening, matching, mining, statistics
from linkveil.operators.components import connected_components
from linkveil.plans import pipelines
from linkveil.session import materialize
from linkveil.sources import tables

L, K, Q = 1000, 10, 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


# -- inputs


def plain(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return tables.records(part, "p_partkey", ["p_name", "p_type", "p_brand"], salt="p_size").withColumn("rec_val", F.concat_ws(" ", "a0", "a1")).withColumn("value", F.col("a0"))


def encoded(spark: SparkSession, d: str) -> DataFrame:
    """The half of the records with an even number."""
    return plain(spark, d).where("cast(rec_id as long) % 2 = 0")


def with_grams(df: DataFrame, value: str = "rec_val") -> DataFrame:
    return df.select("rec_id", F.col(value).alias("value"), c.gram_set(F.col(value), Q).alias("grams"))


E_NAME = encoders.Encoding(("a0",), Q, False, L, K)
E_BOTH = encoders.Encoding(("a0", "a1"), Q, False, L, K)
E_SMALL = encoders.Encoding(("a0", "a1"), Q, False, 64, 2)


def joined(col):
    return F.array_join(F.sort_array(col), ",")


def as_bits(df: DataFrame, e: encoders.Encoding, **kw) -> DataFrame:
    return encoders.encode(df, e, **kw).select("rec_id", joined("bits").alias("bits"), F.size("bits").cast("long").alias("n_bits"))


def r6(col):
    return F.round(col, 6)


# -- SQL pieces

P = "p AS (SELECT CAST(p_partkey AS VARCHAR) AS rec_id, lower(trim(p_name)) AS a0, lower(trim(p_type)) AS a1, lower(trim(p_brand)) AS a2, lower(trim(p_name)) || ' ' || lower(trim(p_type)) AS rec_val, CAST(p_size AS VARCHAR) AS salt, p_partkey FROM part)"
EN = "e AS (SELECT * FROM p WHERE p_partkey % 2 = 0)"


def grams_sql(v: str, q: int = Q) -> str:
    return f"list_transform(range(1, length({v}) - {q} + 2), lambda i: substr({v}, i, {q}))"


def fold_sql(h: str, n: int | str) -> str:
    return f"list_reduce(list_transform(range(1, length({h}) + 1), lambda i: CAST(strpos('0123456789abcdef', substr({h}, i, 1)) - 1 AS BIGINT)), lambda a, b: (a * 16 + b) % {n})"


def gram_hash_sql(attributes: list[str], n: int, salt: str = "''") -> str:
    """rg (rec_id, attr, gram), gx (gram, h1, h2)."""
    each = " UNION ALL ".join(f"SELECT rec_id, {i} AS attr, unnest({grams_sql(a)}) || {salt} AS gram FROM s" for i, a in enumerate(attributes))
    return f"rg AS (SELECT DISTINCT * FROM ({each})), gx AS (SELECT gram, {fold_sql('sha1(gram)', n)} AS h1, {fold_sql('md5(gram)', n)} AS h2 FROM (SELECT DISTINCT gram FROM rg))"


def bits_sql(attributes: list[str], n: int = L, k: int = K, extra: str = "0", source: str = "p", salt: str = "''") -> str:
    """b (rec_id, pos): the 1-bits."""
    return (
        f"{P}, {EN}, s AS (SELECT * FROM {source}), {gram_hash_sql(attributes, n, salt)}, b AS (SELECT DISTINCT rec_id, CAST((h1 + i * h2 + {extra}) % {n} AS INTEGER) AS pos FROM rg JOIN gx USING (gram), (SELECT unnest(range(1, {k + 1})) AS i))"
    )


JOINED = "SELECT rec_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS bits, count(*) AS n_bits FROM {} GROUP BY rec_id"
RG = f"{P}, {EN}, g AS (SELECT rec_id, rec_val, unnest(list_distinct({grams_sql('rec_val')})) AS gram FROM p)"


# -- sources, tokens


@query("load_filter", f"WITH {P} SELECT rec_id, rec_val FROM p")
def load_filter(spark, d):
    return plain(spark, d).select("rec_id", "rec_val")


@query("value_ids", f"WITH {P} SELECT rec_val, count(*) AS n, count(DISTINCT rec_id) AS n_ids, min(rec_id) AS first_id FROM p GROUP BY rec_val")
def value_ids(spark, d):
    return tables.value_ids(plain(spark, d))


@query("qgram_sets", f"WITH {RG} SELECT rec_id, string_agg(gram, '|' ORDER BY gram) AS grams, count(*) AS n FROM g GROUP BY rec_id")
def qgram_sets(spark, d):
    return with_grams(plain(spark, d)).select("rec_id", F.array_join(F.array_sort("grams"), "|").alias("grams"), F.size("grams").cast("long").alias("n"))


@query("avg_qgrams", f"WITH {RG} SELECT round(avg(n), 6) AS avg_grams FROM (SELECT count(*) AS n FROM g GROUP BY rec_id)")
def avg_qgrams(spark, d):
    return with_grams(plain(spark, d)).agg(r6(F.avg(F.size("grams"))).alias("avg_grams"))


@query("opt_k", f"WITH {RG} SELECT CAST(round(ln(2) * {L} / avg(n)) AS BIGINT) AS k FROM (SELECT count(*) AS n FROM g GROUP BY rec_id)")
def opt_k(spark, d):
    rows = plain(spark, d)
    e = encoders.with_optimal_k(rows, encoders.Encoding(("rec_val",), Q, False, L))
    return spark.createDataFrame([(e.k,)], "k long")


@query("freq_of_freq_values", f"WITH {P} SELECT f AS frequency, count(*) AS n FROM (SELECT count(*) AS f FROM p GROUP BY rec_val) GROUP BY f")
def freq_of_freq_values(spark, d):
    return statistics.frequency_of_frequency(plain(spark, d), F.col("rec_val"))


# -- hashing, encoding, hardening


@query("bf_dh", f"WITH {bits_sql(['a0'])} {JOINED.format('b')}")
def bf_dh(spark, d):
    return as_bits(plain(spark, d), E_NAME)


@query("bf_edh", f"WITH {bits_sql(['a0'], extra='(i * i * i - i) // 6')} {JOINED.format('b')}")
def bf_edh(spark, d):
    return as_bits(plain(spark, d), encoders.Encoding(("a0",), Q, False, L, K, "edh"))


#: Pairs of the characters that names have.
PAIRS = [a + b for a in "abcdefghijklmnopqrstuvwxyz " for b in "abcdefghijklmnopqrstuvwxyz "]


def _sha224_sql() -> str:
    import hashlib

    return ", ".join(f"('{g}', {int(hashlib.sha224(g.encode()).hexdigest(), 16) % L})" for g in PAIRS)


@query("bf_th", f"WITH {P}, s AS (SELECT * FROM p), {gram_hash_sql(['a0'], L)}, sh(gram, h3) AS (VALUES {_sha224_sql()}), b AS (SELECT DISTINCT rec_id, CAST((h1 + i * h2 + (i * (i - 1) // 2) * h3) % {L} AS INTEGER) AS pos FROM rg JOIN gx USING (gram) JOIN sh USING (gram), (SELECT unnest(range(1, {K + 1})) AS i)) {JOINED.format('b')}")
def bf_th(spark, d):
    return as_bits(plain(spark, d), encoders.Encoding(("a0",), Q, False, L, K, "th"))


def _twister_sql() -> str:
    return ", ".join(f"('{g}', {p})" for g in PAIRS for p in sorted(set(hashing.twister_positions(g, L, K))))


@query("bf_rh", f"WITH {P}, g AS (SELECT DISTINCT rec_id, unnest({grams_sql('a0')}) AS gram FROM p), tw(gram, pos) AS (VALUES {_twister_sql()}), b AS (SELECT DISTINCT rec_id, pos FROM g JOIN tw USING (gram)) {JOINED.format('b')}")
def bf_rh(spark, d):
    return as_bits(plain(spark, d), encoders.Encoding(("a0",), Q, False, L, K, "rh"))


@query(
    "bf_counter",
    f"WITH {P}, g AS (SELECT DISTINCT rec_id, unnest({grams_sql('a0')}) AS gram FROM p), x AS (SELECT DISTINCT gram, j, {fold_sql('''sha1(gram || '#' || CAST(j AS VARCHAR))''', L)} AS pos FROM (SELECT DISTINCT gram FROM g), (SELECT unnest(range(1, {K + 1})) AS j)), b AS (SELECT DISTINCT rec_id, CAST(pos AS INTEGER) AS pos FROM g JOIN x USING (gram)) {JOINED.format('b')}",
)
def bf_counter(spark, d):
    return as_bits(plain(spark, d), encoders.Encoding(("a0",), Q, False, L, K, "counter"))


@query("enc_abf", f"WITH {bits_sql(['a1'])} {JOINED.format('b')}")
def enc_abf(spark, d):
    return as_bits(plain(spark, d), encoders.Encoding(("a1",), Q, False, L, K, kind="abf"))


@query("enc_clk", f"WITH {bits_sql(['a0', 'a1'])} {JOINED.format('b')}")
def enc_clk(spark, d):
    return as_bits(plain(spark, d), E_BOTH)


@query(
    "enc_clkrbf",
    f"WITH {P}, s AS (SELECT * FROM p), {gram_hash_sql(['a0', 'a1'], L)}, b AS (SELECT DISTINCT rec_id, CAST((h1 + i * h2) % {L} AS INTEGER) AS pos FROM rg JOIN gx USING (gram), (SELECT unnest(range(1, 13)) AS i) WHERE i <= CASE WHEN attr = 0 THEN 12 ELSE 5 END) {JOINED.format('b')}",
)
def enc_clkrbf(spark, d):
    return as_bits(plain(spark, d), encoders.Encoding(("a0", "a1"), Q, False, L, (12, 5), kind="clkrbf"))


RBF_MAP = encoders.rbf_map([L, L], [0.5, 0.5], L)


@query(
    "enc_rbf",
    f"WITH {P}, s AS (SELECT * FROM p), {gram_hash_sql(['a0', 'a1'], L)}, ab AS (SELECT DISTINCT rec_id, attr, CAST((h1 + i * h2) % {L} AS INTEGER) AS bit FROM rg JOIN gx USING (gram), (SELECT unnest(range(1, {K + 1})) AS i)), m(attr, bit, pos) AS (VALUES {', '.join(f'({a}, {b}, {r})' for a, b, r in RBF_MAP)}), b AS (SELECT DISTINCT rec_id, pos FROM ab JOIN m USING (attr, bit)) {JOINED.format('b')}",
)
def enc_rbf(spark, d):
    return as_bits(plain(spark, d), encoders.Encoding(("a0", "a1"), Q, False, L, K, kind="rbf")).where("n_bits > 0")


def _dynamic_maps() -> str:
    """Record bits by attribute and filter length, over lengths about those that these tables give."""
    rows = []
    for l0, l1 in zip(range(110, 126), range(65, 81), strict=True):
        rows += [(a, (l0, l1)[a], b, r) for a, b, r in encoders.rbf_map([l0, l1], [0.5, 0.5], L)]
    return ", ".join(f"({a}, {n}, {b}, {r})" for a, n, b, r in rows)


DYN = f"n AS (SELECT CAST(round(1 / (1 - pow(0.5, 1 / ({K} * avg(len(list_distinct({grams_sql('a0')})))))) ) AS BIGINT) AS l0, CAST(round(1 / (1 - pow(0.5, 1 / ({K} * avg(len(list_distinct({grams_sql('a1')})))))) ) AS BIGINT) AS l1 FROM p)"


@query(
    "enc_rbf_dyn",
    f"WITH {P}, {DYN}, rg AS (SELECT DISTINCT * FROM (SELECT rec_id, 0 AS attr, unnest({grams_sql('a0')}) AS gram FROM p UNION ALL SELECT rec_id, 1, unnest({grams_sql('a1')}) FROM p)), gx AS (SELECT attr, gram, l, {fold_sql('sha1(gram)', 'l')} AS h1, {fold_sql('md5(gram)', 'l')} AS h2 FROM (SELECT DISTINCT attr, gram, CASE WHEN attr = 0 THEN l0 ELSE l1 END AS l FROM rg, n)), ab AS (SELECT DISTINCT rec_id, attr, l, (h1 + i * h2) % l AS bit FROM rg JOIN gx USING (attr, gram), (SELECT unnest(range(1, {K + 1})) AS i)), m(attr, l, bit, pos) AS (VALUES {_dynamic_maps()}), b AS (SELECT DISTINCT rec_id, pos FROM ab JOIN m USING (attr, l, bit)) SELECT rec_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS bits FROM b GROUP BY rec_id",
)
def enc_rbf_dyn(spark, d):
    p = plain(spark, d)
    e = encoders.Encoding(("a0", "a1"), Q, False, L, K, kind="rbf")
    x = encoders.rbf(p, e, [0.5, 0.5], dynamic=True, how=encoders.from_dictionary(p, e))
    return p.select("rec_id", x.alias("x")).select("rec_id", joined("x").alias("bits"))


@query(
    "enc_rbf_dyn_len",
    f"WITH {P}, n AS (SELECT avg(len(list_distinct({grams_sql('a0')}))) AS g0, avg(len(list_distinct({grams_sql('a1')}))) AS g1 FROM p) SELECT CAST(round(1 / (1 - pow(0.5, 1 / ({K} * g0)))) AS BIGINT) AS l0, CAST(round(1 / (1 - pow(0.5, 1 / ({K} * g1)))) AS BIGINT) AS l1 FROM n",
)
def enc_rbf_dyn_len(spark, d):
    g = encoders.average_grams(plain(spark, d), E_BOTH)
    return spark.createDataFrame([tuple(encoders.dynamic_length(0.5, K, g[a]) for a in ("a0", "a1"))], "l0 long, l1 long")


@query("salted", f"WITH {bits_sql(['a0'], salt='salt')} {JOINED.format('b')}")
def salted(spark, d):
    return as_bits(plain(spark, d), encoders.Encoding(("a0",), Q, False, L, K, salt="salt"))


BALANCED = "x AS (SELECT rec_id, pos FROM b UNION ALL SELECT rec_id, CAST(q + 1000 AS INTEGER) FROM (SELECT rec_id, CAST(q AS INTEGER) AS q FROM (SELECT DISTINCT rec_id FROM b), (SELECT unnest(range(1000)) AS q) EXCEPT SELECT rec_id, pos FROM b))"


@query("hard_balance", f"WITH {bits_sql(['a0'])}, {BALANCED} SELECT rec_id, count(*) AS n_bits, CAST(sum(pos) AS BIGINT) AS s, min(pos) AS lo, max(pos) AS hi FROM x GROUP BY rec_id")
def hard_balance(spark, d):
    e = encoders.encode(plain(spark, d), E_NAME)
    both = e.select("rec_id", hardening.balance(F.col("bits"), L).alias("x"))
    return both.select("rec_id", F.size("x").cast("long").alias("n_bits"), F.aggregate("x", F.lit(0).cast("long"), lambda s, p: s + p).alias("s"), F.array_min("x").alias("lo"), F.array_max("x").alias("hi"))


@query("hard_balance_permuted", f"WITH {bits_sql(['a0'])}, {BALANCED}, pm(q, pos) AS (VALUES {', '.join(f'({q}, {r})' for q, r in enumerate(hardening.permutation(2 * L, 42)))}), y AS (SELECT rec_id, pm.pos AS pos FROM x JOIN pm ON pm.q = x.pos) {JOINED.format('y')}")
def hard_balance_permuted(spark, d):
    e = encoders.Encoding(("a0",), Q, False, L, K, harden="balance")
    made = lambda df: encoders.encode(df, e).select(*df.columns, joined("bits").alias("bits"), F.size("bits").cast("long").alias("n_bits"))
    return encoders.per_value(plain(spark, d).select("rec_id", "a0"), ["a0"], made)[["rec_id", "bits", "n_bits"]]


@query("hard_fold", f"WITH {bits_sql(['a0'])}, x AS (SELECT rec_id, pos % {L // 2} AS pos FROM b GROUP BY rec_id, pos % {L // 2} HAVING count(*) = 1) {JOINED.format('x')}")
def hard_fold(spark, d):
    return as_bits(plain(spark, d), encoders.Encoding(("a0",), Q, False, L, K, harden="fold"))


@query(
    "hard_rule90",
    f"WITH {bits_sql(['a0'])}, y AS (SELECT rec_id, (pos + 1) % {L} AS pos FROM b UNION ALL SELECT rec_id, (pos + {L - 1}) % {L} FROM b), x AS (SELECT rec_id, pos FROM y GROUP BY rec_id, pos HAVING count(*) = 1) {JOINED.format('x')}",
)
def hard_rule90(spark, d):
    return as_bits(plain(spark, d), encoders.Encoding(("a0",), Q, False, L, K, harden="rule90"))


MARKOV = f"{P}, o AS (SELECT rec_id, rec_val, unnest(range(1, length(rec_val) - 1)) AS i FROM p), t AS (SELECT substr(rec_val, i, 2) AS g1, substr(rec_val, i + 1, 2) AS g2, count(*) AS n FROM o WHERE i + 2 <= length(rec_val) GROUP BY 1, 2), m AS (SELECT g1, g2, n, n / sum(n) OVER (PARTITION BY g1) AS prob FROM t)"


@query("markov_trans", f"WITH {MARKOV} SELECT g1, g2, n, round(prob, 6) AS prob FROM m")
def markov_trans(spark, d):
    return hardening.transitions(plain(spark, d), "rec_val", Q).select("g1", "g2", "n", r6("prob").alias("prob"))


@query("markov_freq", f"WITH {MARKOV} SELECT g1, string_agg(g2, '|' ORDER BY g2) AS extra FROM (SELECT *, row_number() OVER (PARTITION BY g1 ORDER BY prob DESC, g2) AS r FROM m) WHERE r <= 3 GROUP BY g1")
def markov_freq(spark, d):
    model = hardening.transitions(plain(spark, d), "rec_val", Q)
    return hardening.markov_extras(model, 3).select("g1", F.array_join("extra", "|").alias("extra"))


@query("markov_prob")
def markov_prob(spark, d):
    model = hardening.transitions(plain(spark, d), "rec_val", Q)
    return hardening.markov_extras(model, 3, "prob").select("g1", F.array_join("extra", "|").alias("extra"))


@query("hard_markov", f"WITH {MARKOV}, ex AS (SELECT g1, g2 FROM (SELECT *, row_number() OVER (PARTITION BY g1 ORDER BY prob DESC, g2) AS r FROM m) WHERE r <= 2), g AS (SELECT DISTINCT rec_id, gram FROM (SELECT rec_id, unnest({grams_sql('a0')}) AS gram FROM p UNION ALL SELECT rec_id, unnest({grams_sql('a1')}) FROM p)), rg AS (SELECT rec_id, gram FROM g UNION SELECT rec_id, g2 FROM g JOIN ex ON g1 = gram), gx AS (SELECT gram, {fold_sql('sha1(gram)', L)} AS h1, {fold_sql('md5(gram)', L)} AS h2 FROM (SELECT DISTINCT gram FROM rg)), b AS (SELECT DISTINCT rec_id, CAST((h1 + i * h2) % {L} AS INTEGER) AS pos FROM rg JOIN gx USING (gram), (SELECT unnest(range(1, {K + 1})) AS i)) {JOINED.format('b')}")
def hard_markov(spark, d):
    return as_bits(plain(spark, d), encoders.Encoding(("a0", "a1"), Q, False, L, K, harden="markov"))


# -- counting


@query("bf_freq", f"WITH {bits_sql(['a0'])} SELECT bits, count(*) AS n FROM ({JOINED.format('b')}) GROUP BY bits")
def bf_freq(spark, d):
    return frequency.frequencies(encoders.encode(plain(spark, d), E_NAME), frequency.pattern(F.col("bits")), "bits")


@query("val_freq", f"WITH {P} SELECT a0 AS value, count(*) AS n FROM p GROUP BY a0 HAVING count(*) >= 2")
def val_freq(spark, d):
    return frequency.frequencies(plain(spark, d), "a0", "value", 2)


@query("gram_values", f"WITH {RG} SELECT gram, count(DISTINCT rec_val) AS n_values, min(rec_val) AS first_value FROM g GROUP BY gram")
def gram_values(spark, d):
    return statistics.gram_values(with_grams(plain(spark, d))).groupBy("gram").agg(F.count("*").alias("n_values"), F.min("value").alias("first_value"))


@query(
    "gram_support",
    f"WITH {RG}, n AS (SELECT gram, count(*) AS n FROM g GROUP BY gram), ee AS (SELECT a.gram AS g1, b.gram AS g2, count(*) AS n FROM g a JOIN g b ON a.rec_id = b.rec_id AND a.gram <> b.gram GROUP BY 1, 2) SELECT g1, g2, ee.n AS n, round(ee.n / n.n, 6) AS prob FROM ee JOIN n ON n.gram = ee.g1",
)
def gram_support(spark, d):
    return statistics.support_graph(with_grams(plain(spark, d)))[1].select("g1", "g2", "n", r6("prob").alias("prob"))


@query("freq_of_freq", f"WITH {bits_sql(['a0'])} SELECT f AS frequency, count(*) AS n FROM (SELECT count(*) AS f FROM ({JOINED.format('b')}) GROUP BY bits) GROUP BY f")
def freq_of_freq(spark, d):
    return statistics.frequency_of_frequency(encoders.encode(plain(spark, d), E_NAME), frequency.pattern(F.col("bits")))


@query("column_freq_of_freq", f"WITH {bits_sql(['a0'])}, c AS (SELECT string_agg(rec_id, ',' ORDER BY rec_id) AS rows FROM b GROUP BY pos) SELECT f AS frequency, count(*) AS n FROM (SELECT count(*) AS f FROM c GROUP BY rows) GROUP BY f")
def column_freq_of_freq(spark, d):
    return statistics.column_patterns(encoders.encode(plain(spark, d), E_NAME))


@query("column_weights", f"WITH {bits_sql(['a0', 'a1'])} SELECT min(w) AS least, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, max(w) AS most FROM (SELECT count(*) AS w FROM b GROUP BY pos)")
def column_weights(spark, d):
    w = statistics.column_weights(encoders.encode(plain(spark, d), E_BOTH))
    return statistics.weight_summary(w, "weight").select("least", r6("mean").alias("mean"), r6("std").alias("std"), "most")


@query("row_weights", f"WITH {bits_sql(['a0', 'a1'])} SELECT min(w) AS least, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, max(w) AS most FROM (SELECT CAST(count(*) AS INTEGER) AS w FROM b GROUP BY rec_id)")
def row_weights(spark, d):
    w = statistics.row_weights(encoders.encode(plain(spark, d), E_BOTH))
    return statistics.weight_summary(w, "weight").select("least", r6("mean").alias("mean"), r6("std").alias("std"), "most")


COMBOS = ", ".join(f"({c}, {p})" for c, ps in enumerate(statistics.sampled_positions(L, 2, 100, 42)) for p in ps)


@query("sampled_weights", f"WITH {bits_sql(['a0', 'a1'])}, co(c, pos) AS (VALUES {COMBOS}), h AS (SELECT c, rec_id, count(b.pos) AS h FROM co JOIN b USING (pos) GROUP BY c, rec_id), w AS (SELECT co.c AS c, count(h.h) FILTER (h.h = 2) AS a, count(h.h) FILTER (h.h = 1) AS x FROM (SELECT DISTINCT c FROM co) co LEFT JOIN h ON h.c = co.c GROUP BY co.c) SELECT round(avg(a), 6) AS and_mean, round(stddev_pop(a), 6) AS and_std, round(avg(x), 6) AS xor_mean, round(stddev_pop(x), 6) AS xor_std FROM w")
def sampled_weights(spark, d):
    alike = plain(spark, d).groupBy(*E_BOTH.attributes).agg(F.count("*").alias("n"))  # records of the same values have the same filter
    got = statistics.sampled_weights(encoders.encode(alike, E_BOTH), L, count="n")
    return got.select(*[r6(c).alias(c) for c in got.columns])


@query("other_grams", f"WITH {RG}, m AS (SELECT rec_id FROM g GROUP BY rec_id HAVING bool_or(gram = 're') AND NOT bool_or(gram = 'ro')) SELECT gram, count(*) AS n FROM g JOIN m USING (rec_id) WHERE gram <> 're' GROUP BY gram")
def other_grams(spark, d):
    return statistics.other_grams(with_grams(plain(spark, d)), ["re"], ["ro"])


FREQUENT = ["re", "ed", "la"]


@query("lang_single", f"WITH {RG}, k AS (SELECT rec_id, gram AS key FROM g WHERE gram IN ('re', 'ed', 'la')), n AS (SELECT key, count(*) AS n FROM k GROUP BY key HAVING count(*) >= 2), x AS (SELECT key, g.gram AS gram, count(*) AS n_gram FROM k JOIN g USING (rec_id) WHERE g.gram NOT IN ('re', 'ed', 'la') GROUP BY 1, 2 HAVING count(*) >= 2) SELECT key, n, gram, n_gram FROM n JOIN x USING (key)")
def lang_single(spark, d):
    m = statistics.language_model(with_grams(plain(spark, d)), FREQUENT, "single", 2)
    return m.select(F.array_join("included", "|").alias("key"), "n", "gram", "n_gram")


@query("lang_all", f"WITH {RG}, k AS (SELECT rec_id, string_agg(gram, '|' ORDER BY gram) AS key FROM g WHERE gram IN ('re', 'ed', 'la') GROUP BY rec_id), n AS (SELECT key, count(*) AS n FROM k GROUP BY key), x AS (SELECT key, g.gram AS gram, count(*) AS n_gram FROM k JOIN g USING (rec_id) WHERE g.gram NOT IN ('re', 'ed', 'la') GROUP BY 1, 2) SELECT key, n, gram, n_gram FROM n JOIN x USING (key)")
def lang_all(spark, d):
    m = statistics.language_model(with_grams(plain(spark, d)), FREQUENT, "all")
    return m.select(F.array_join("included", "|").alias("key"), "n", "gram", "n_gram")


@query("lang_tuple", f"WITH {RG}, o AS (SELECT rec_id, list(gram ORDER BY gram) AS own FROM g WHERE gram IN ('re', 'ed', 'la') GROUP BY rec_id), ss(key, need) AS (VALUES ('ed|la', ['ed', 'la']), ('ed|re', ['ed', 're']), ('la|re', ['la', 're']), ('ed|la|re', ['ed', 'la', 're'])), k AS (SELECT rec_id, key FROM o, ss WHERE list_has_all(own, need)), n AS (SELECT key, count(*) AS n FROM k GROUP BY key), x AS (SELECT key, g.gram AS gram, count(*) AS n_gram FROM k JOIN g USING (rec_id) WHERE g.gram NOT IN ('re', 'ed', 'la') GROUP BY 1, 2) SELECT key, n, gram, n_gram FROM n JOIN x USING (key)")
def lang_tuple(spark, d):
    m = statistics.language_model(with_grams(plain(spark, d)), FREQUENT, "tuple")
    return m.select(F.array_join("included", "|").alias("key"), "n", "gram", "n_gram")


# -- frequency analysis

ALIGN = f"{bits_sql(['a0'], source='e')}, bf AS (SELECT bits, count(*) AS n FROM ({JOINED.format('b')}) GROUP BY bits), vf AS (SELECT a0 AS value, count(*) AS n FROM p GROUP BY a0), br AS (SELECT bits, n, row_number() OVER (ORDER BY n DESC, bits) - 1 AS rank, lead(n) OVER (ORDER BY n DESC, bits) AS nn FROM bf), vr AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) - 1 AS rank, lead(n) OVER (ORDER BY n DESC, value) AS nn FROM vf), j AS (SELECT rank, bits, br.n AS bf_n, value, vr.n AS value_n, bool_or(coalesce(br.nn = br.n, FALSE) OR coalesce(vr.nn = vr.n, FALSE)) OVER (ORDER BY rank) AS tied FROM br JOIN vr USING (rank)), al AS (SELECT rank, bits, bf_n, value, value_n FROM j WHERE NOT tied)"


def aligned(spark, d) -> DataFrame:
    left = encoders.encode(encoded(spark, d), E_NAME).select(frequency.pattern(F.col("bits")).alias("bits"))
    return frequency.align(left, plain(spark, d).select("value"))


@query("align", f"WITH {ALIGN} SELECT CAST(rank AS INTEGER) AS rank, bits, bf_n, value, value_n FROM al")
def align(spark, d):
    return aligned(spark, d)


POSSIBLE = f"{ALIGN}, ag AS (SELECT rank, bits, unnest(list_distinct({grams_sql('value')})) AS gram, len(list_distinct({grams_sql('value')})) AS ng FROM al), one AS (SELECT rank, CAST(unnest(string_split(bits, ',')) AS INTEGER) AS pos FROM al), zero AS (SELECT rank, CAST(p AS INTEGER) AS pos FROM al, (SELECT unnest(range({L})) AS p) EXCEPT SELECT rank, pos FROM one), pw AS (SELECT pos, gram, sum(1.0 / ng) AS weight FROM one JOIN ag USING (rank) GROUP BY 1, 2), w AS (SELECT * FROM pw WHERE NOT EXISTS (SELECT 1 FROM zero JOIN ag USING (rank) WHERE zero.pos = pw.pos AND ag.gram = pw.gram))"


@query("pos_possible", f"WITH {POSSIBLE} SELECT pos, gram, round(weight, 6) AS weight FROM w")
def pos_possible(spark, d):
    return frequency.position_weights(aligned(spark, d), L, Q).select("pos", "gram", r6("weight").alias("weight"))


def guesses(spark, d) -> DataFrame:
    weights = materialize(frequency.position_weights(materialize(aligned(spark, d), "aligned"), L, Q), "weights")
    enc = encoders.encode(encoded(spark, d), E_NAME).select(F.col("rec_id").alias("enc_id"), "bits", F.col("value").alias("true_value"))
    return frequency.reconstruct(enc, weights, plain(spark, d).select("value"), 20)


def guesses_sql(top: int, ranks: int = 1 << 30) -> str:
    """rc (enc_id, true_value, gs): guesses among the top values, from the alignments of the first ranks."""
    possible = POSSIBLE.replace(" WHERE NOT tied)", f" WHERE NOT tied AND rank < {ranks})")
    return (
        f"{possible}, ca AS (SELECT value FROM vf ORDER BY n DESC, value LIMIT {top}), fi AS (SELECT a0 AS true_value, min(rec_id) AS enc_id FROM e WHERE a0 IN (SELECT value FROM ca) GROUP BY a0), gp AS (SELECT pos, list(gram) AS gs FROM w GROUP BY pos), "
        "bad AS (SELECT DISTINCT pos, value FROM gp, ca WHERE len(list_filter(gs, lambda x: contains(value, x))) = 0), ok AS (SELECT enc_id, true_value, value FROM fi, ca WHERE NOT EXISTS (SELECT 1 FROM b JOIN bad ON b.pos = bad.pos WHERE b.rec_id = fi.enc_id AND bad.value = ca.value)), "
        "rc AS (SELECT enc_id, true_value, list(value) FILTER (value IS NOT NULL) AS gs FROM fi LEFT JOIN ok USING (enc_id, true_value) GROUP BY 1, 2)"
    )


GUESSES = guesses_sql(20)
COUNTED = "count(*) FILTER (len(gs) = 1 AND list_contains(gs, true_value)) AS exact, count(*) FILTER (len(gs) > 1 AND list_contains(gs, true_value)) AS correct, count(*) FILTER (len(gs) > 0 AND NOT list_contains(gs, true_value)) AS wrong, count(*) FILTER (coalesce(len(gs), 0) = 0) AS no_guess"


@query("reconstruct", f"WITH {POSSIBLE}, ca AS (SELECT value FROM vf ORDER BY n DESC, value LIMIT 20), fi AS (SELECT a0 AS true_value, min(rec_id) AS enc_id FROM e WHERE a0 IN (SELECT value FROM ca) GROUP BY a0), gp AS (SELECT pos, list(gram) AS gs FROM w GROUP BY pos), bad AS (SELECT DISTINCT pos, value FROM gp, ca WHERE len(list_filter(gs, lambda x: contains(value, x))) = 0), ok AS (SELECT enc_id, true_value, value FROM fi, ca WHERE NOT EXISTS (SELECT 1 FROM b JOIN bad ON b.pos = bad.pos WHERE b.rec_id = fi.enc_id AND bad.value = ca.value)) SELECT enc_id, true_value, coalesce(string_agg(value, '|' ORDER BY value), '') AS guesses FROM fi LEFT JOIN ok USING (enc_id, true_value) GROUP BY 1, 2")
def reconstruct(spark, d):
    return guesses(spark, d).select("enc_id", "true_value", F.array_join(F.array_sort("guesses"), "|").alias("guesses"))


@query("guess_counts", f"WITH {GUESSES} SELECT {COUNTED} FROM rc")
def guess_counts(spark, d):
    return frequency.guess_counts(guesses(spark, d))


@query("frequency_analysis", " UNION ALL ".join(f"SELECT * FROM (WITH {guesses_sql(t, t)} SELECT {t} AS top, least({t}, (SELECT count(*) FROM al)) AS aligned, {COUNTED} FROM rc HAVING (SELECT count(*) FROM al) > 0)" for t in (50, 20, 10)))
def frequency_analysis(spark, d):
    p = pipelines.FrequencyParams(E_NAME, 1, (50, 20, 10))
    got = pipelines.frequency_analysis(encoded(spark, d), plain(spark, d), p)
    if "stop_reason" in got.columns:  # nothing aligned: no rows
        got = spark.createDataFrame([], "top int, aligned long, exact long, correct long, wrong long, no_guess long")
    return got.withColumn("aligned", F.col("aligned").cast("long"))


# -- mining


@query("freq_pos_pairs", f"WITH {bits_sql(['a0'], 64, 2)}, n AS (SELECT count(DISTINCT rec_id) AS n FROM b) SELECT x.pos AS p1, y.pos AS p2, count(*) AS n FROM b x JOIN b y ON x.rec_id = y.rec_id AND x.pos < y.pos GROUP BY 1, 2 HAVING count(*) >= 20")
def freq_pos_pairs(spark, d):
    e = encoders.encode(plain(spark, d), encoders.Encoding(("a0",), Q, False, 64, 2))
    return mining.frequent_pairs(e, 20)


#: Every frequent set of positions with its rows as bits, grown by its largest position.
SETS = f"{bits_sql(['a0', 'a1'], 64, 2)}, rn AS (SELECT rec_id, CAST(row_number() OVER (ORDER BY rec_id) AS INTEGER) AS r FROM (SELECT DISTINCT rec_id FROM b)), lt AS (SELECT greatest(1, CAST(floor(count(*) * 0.6) AS BIGINT)) AS least FROM p), sp AS (SELECT pos, bitstring_agg(r, 0, 32767) AS rows FROM b JOIN rn USING (rec_id) GROUP BY pos HAVING count(*) >= (SELECT least FROM lt)), fs AS (SELECT [pos] AS items, rows FROM sp UNION ALL SELECT list_append(fs.items, sp.pos), fs.rows & sp.rows FROM fs JOIN sp ON sp.pos > fs.items[-1], lt WHERE bit_count(fs.rows & sp.rows) >= least), it AS (SELECT items, bit_count(rows) AS n FROM fs)"
LONGEST = f"WITH RECURSIVE {SETS} SELECT array_to_string(items, ',') AS items, n FROM it WHERE len(items) = (SELECT max(len(items)) FROM it)"


def _longest(spark, d, method):
    e = encoders.encode(plain(spark, d), E_SMALL)
    rows = materialize(e.select("rec_id", "bits"), "small")
    got = mining.longest_tuples(rows, max(1, int(rows.count() * 0.6)), method=method)
    return spark.createDataFrame([(",".join(map(str, k)), n) for k, n in sorted(got.items())], "items string, n long")


@query("longest_tuple", LONGEST)
def longest_tuple(spark, d):
    return _longest(spark, d, "maximal")


@query("longest_tuple_apriori", LONGEST)
def longest_tuple_apriori(spark, d):
    return _longest(spark, d, "apriori")


@query("longest_tuple_fpgrowth", LONGEST)
def longest_tuple_fpgrowth(spark, d):
    return _longest(spark, d, "fpgrowth")


@query("length_bound", f"WITH {bits_sql(['a0', 'a1'])}, w AS (SELECT rec_id, count(*) AS hw FROM b GROUP BY rec_id) SELECT rec_id, CAST(floor(hw / {K}) AS BIGINT) AS lower, round(ln(1 - hw / {L}.0) / ln(1 - 1 / {L}.0) / {K}, 6) AS estimate, round(2 * ln(1 - hw / {L}.0) / ln(1 - 1 / {L}.0) / {K} - floor(hw / {K}), 6) AS upper FROM w")
def length_bound(spark, d):
    lower, estimate, upper = c.gram_count_bounds(F.size("bits"), L, K)
    return encoders.encode(plain(spark, d), E_BOTH).select("rec_id", lower.alias("lower"), r6(estimate).alias("estimate"), r6(upper).alias("upper"))


KNOWN = {"re": [], "ed": [], "ro": [], "un": []}


def known_positions() -> dict[str, list[int]]:
    """The true positions of a few q-grams, as an analysis would have found them."""
    import hashlib

    out = {}
    for g in KNOWN:
        a, b = (int(h(g.encode()).hexdigest(), 16) for h in (hashlib.sha1, hashlib.md5))
        out[g] = sorted({(a + i * b) % L for i in range(1, K + 1)})
    return out


ASSIGNED = f"{bits_sql(['a0'], source='e')}, kp(gram, pos) AS (VALUES {', '.join(f'({g!r}, {p})' for g, ps in known_positions().items() for p in ps)}), kn AS (SELECT gram, count(*) AS n FROM kp GROUP BY gram), hit AS (SELECT rec_id, gram FROM b JOIN kp USING (pos) JOIN kn USING (gram) GROUP BY rec_id, gram, n HAVING count(*) = n), va AS (SELECT DISTINCT a0 AS value FROM p)"


def assigned(spark, d) -> DataFrame:
    return materialize(mining.assignments(encoders.encode(encoded(spark, d), E_NAME), known_positions()), "assigned")


def distinct_values(spark, d) -> DataFrame:
    return plain(spark, d).select("value").distinct().withColumn("grams", c.gram_set(F.col("value"), Q))


@query("assignments", f"WITH {ASSIGNED} SELECT e.rec_id, coalesce(string_agg(gram, '|' ORDER BY gram), '') AS must FROM e LEFT JOIN hit USING (rec_id) GROUP BY e.rec_id")
def assignments(spark, d):
    return assigned(spark, d).select("rec_id", joined("must").alias("must")).withColumn("must", F.translate("must", ",", "|"))


@query("setinter", f"WITH {ASSIGNED}, ok AS (SELECT h.rec_id, value FROM (SELECT DISTINCT rec_id FROM hit) h, va WHERE NOT EXISTS (SELECT 1 FROM kn WHERE contains(value, kn.gram) <> EXISTS (SELECT 1 FROM hit WHERE hit.rec_id = h.rec_id AND hit.gram = kn.gram))) SELECT rec_id, value FROM ok")
def setinter(spark, d):
    return mining.set_intersection(assigned(spark, d), distinct_values(spark, d))


@query("bf_tuple", f"WITH {ASSIGNED}, fk AS (SELECT rec_id, string_agg(gram, '|' ORDER BY gram) AS key FROM hit GROUP BY rec_id), ky AS (SELECT DISTINCT key FROM fk), hv AS (SELECT value, key, len(string_split(key, '|')) AS n FROM va, ky WHERE len(list_filter(string_split(key, '|'), lambda x: NOT contains(value, x))) = 0), tp AS (SELECT value, max(key) AS key FROM (SELECT *, rank() OVER (PARTITION BY value ORDER BY n DESC) AS r FROM hv) WHERE r = 1 GROUP BY value HAVING count(*) = 1) SELECT key, rec_id, value FROM tp JOIN fk USING (key)")
def bf_tuple(spark, d):
    return mining.tuple_match(assigned(spark, d), known_positions(), distinct_values(spark, d), 1).select(F.array_join("key", "|").alias("key"), "rec_id", "value")


@query("positions_of_grams", f"SELECT pos, string_agg(gram, '|' ORDER BY gram) AS grams FROM (VALUES {', '.join(f'({g!r}, {p})' for g, ps in known_positions().items() for p in ps)}) t(gram, pos) GROUP BY pos")
def positions_of_grams(spark, d):
    truth = encoders.true_positions(plain(spark, d), E_NAME)
    return mining.positions_of_grams(assigned(spark, d), known_positions(), truth).select("pos", F.array_join("grams", "|").alias("grams"))


def _guess_rows(spark, d) -> DataFrame:
    lower, _, upper = c.gram_count_bounds(F.size("bits"), L, K)
    enc = encoders.encode(encoded(spark, d), E_NAME).select("rec_id", F.col("value").alias("true_value"), lower.alias("lower"), upper.alias("upper"))
    got = mining.set_intersection(assigned(spark, d), distinct_values(spark, d))
    return enc.join(got, "rec_id", "left").withColumn("n_grams", F.size(c.gram_set(F.col("value"), Q)))


GUESS_ROWS = (
    f"si AS (SELECT h.rec_id, value FROM (SELECT DISTINCT rec_id FROM hit) h, va WHERE NOT EXISTS (SELECT 1 FROM kn WHERE contains(value, kn.gram) <> EXISTS (SELECT 1 FROM hit WHERE hit.rec_id = h.rec_id AND hit.gram = kn.gram))), "
    f"hw AS (SELECT rec_id, count(*) AS hw FROM b GROUP BY rec_id), lb AS (SELECT rec_id, floor(hw / {K}) AS lo, 2 * ln(1 - hw / {L}.0) / ln(1 - 1 / {L}.0) / {K} - floor(hw / {K}) AS hi FROM hw), "
    f"gr AS (SELECT e.rec_id, a0 AS t, value, len(list_distinct({grams_sql('value')})) BETWEEN lo AND hi AS inside FROM e JOIN lb USING (rec_id) LEFT JOIN si USING (rec_id)), "
    "tk AS (SELECT *, len(list_intersect(string_split(t, ' '), string_split(value, ' '))) / len(list_distinct(string_split(t, ' '))) AS part FROM gr), "
    "each AS (SELECT f AS filter, rec_id, count(DISTINCT value) FILTER (f = 'all' OR inside) AS n, coalesce(bool_or(value = t) FILTER (f = 'all' OR inside), FALSE) AS exact, coalesce(max(part) FILTER (f = 'all' OR inside), 0) AS part FROM tk, (SELECT unnest(['all', 'length']) AS f) GROUP BY f, rec_id) "
    "SELECT filter, outcome, count(*) AS n, round(avg(CASE WHEN exact THEN 1.0 ELSE part END), 6) AS accuracy FROM (SELECT *, CASE WHEN n = 0 THEN 'no_guess' WHEN n > 10 THEN 'too_many' ELSE CASE WHEN n = 1 THEN '1-1' ELSE '1-m' END || CASE WHEN exact THEN ' exact' WHEN part > 0 THEN ' partial' ELSE ' wrong' END END AS outcome FROM each) GROUP BY 1, 2"
)


@query("guess_accuracy", f"WITH {ASSIGNED}, {GUESS_ROWS}")
def guess_accuracy(spark, d):
    return evaluate.guess_accuracy(_guess_rows(spark, d)).withColumn("accuracy", r6("accuracy"))


@query("mining_analysis")
def mining_analysis(spark, d):
    p = pipelines.MiningParams(encoders.Encoding(("a0", "a1"), Q, False, L, 4), least_part=max(20, int(plain(spark, d).count() * 0.1)), model_least=2)
    got = pipelines.mining_analysis(encoded(spark, d), plain(spark, d), p)
    return got["bf_tuple"] if "bf_tuple" in got else got["status"].select("analysis", "stop_reason")


# -- blocking, graphs


def name_values(spark, d) -> DataFrame:
    """Distinct values of a name, a brand and a type, with their q-grams."""
    v = plain(spark, d).select(F.concat_ws(" ", "a0", "a2", "a1").alias("v")).distinct()
    return v.select("v", F.col("v").alias("node"), c.gram_set(F.col("v"), Q).alias("grams"))


def soundex_sql(text: str) -> str:
    """The code of a lower-cased value; a digit equal to the one before it goes."""
    digits = f"string_split(translate(regexp_replace(substr({text}, 2), '[^{''.join(sorted(c.SOUNDEX_DIGITS))}]', '', 'g'), '{''.join(c.SOUNDEX_DIGITS)}', '{''.join(c.SOUNDEX_DIGITS.values())}'), '')"
    return f"CASE WHEN {text} = '' THEN 'z000' ELSE rpad(substr({text}, 1, 1) || list_aggregate(list_filter({digits}, lambda x, i: i = 1 OR x <> {digits}[i - 1]), 'string_agg', ''), 4, '0') END"


@query("soundex_block", f"WITH {P} SELECT {soundex_sql('a0')} || '-' || {soundex_sql('a1')} AS block, count(*) AS n FROM p GROUP BY 1")
def soundex_block(spark, d):
    return blocking.soundex_blocks(plain(spark, d), "rec_id", ["a0", "a1"]).groupBy("block").agg(F.count("*").alias("n"))


def minhash_sql() -> str:
    """Signatures over a table of the CRC-32 of every pair of the characters that values have."""
    import zlib

    letters = "abcdefghijklmnopqrstuvwxyz0123456789 #"
    crcs = ", ".join(f"('{a}{b}', {zlib.crc32((a + b).encode())})" for a in letters for b in letters)
    rows = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(blocking.minhash_coefficients(200)))
    return f"{NV}, cr(gram, x) AS (VALUES {crcs}), cf(i, a, b) AS (VALUES {rows}), sg AS (SELECT node, i, min((CAST(a AS HUGEINT) * x + b) % {blocking.PRIME}) AS m FROM ng JOIN cr USING (gram), cf GROUP BY node, i), bk AS (SELECT i // 4 AS band, node, string_agg(CAST(m AS VARCHAR), '-' ORDER BY i) AS k FROM sg GROUP BY 1, 2), bs AS (SELECT count(*) AS n FROM bk GROUP BY band, k)"


@query("minhash_block")
def minhash_block(spark, d):
    blocks = blocking.minhash_blocks(name_values(spark, d), "node", "grams")
    return statistics.block_summary(blocks)


SAMPLES = ", ".join(f"({s}, {p})" for s, ps in enumerate(blocking.hamming_samples(L, 20, L // 10)) for p in ps)


@query("hlsh_block", f"WITH {bits_sql(['a0'])}, sm(s, pos) AS (VALUES {SAMPLES}), bk AS (SELECT r.rec_id, k.s AS s, coalesce(string_agg(CAST(b.pos AS VARCHAR), '-' ORDER BY b.pos), '') AS key FROM (SELECT DISTINCT rec_id FROM p) r CROSS JOIN (SELECT DISTINCT s FROM sm) k LEFT JOIN (SELECT b.rec_id, sm.s, b.pos FROM b JOIN sm USING (pos)) b ON b.rec_id = r.rec_id AND b.s = k.s GROUP BY 1, 2) SELECT s || ':' || key AS block, count(*) AS n FROM bk GROUP BY 1")
def hlsh_block(spark, d):
    e = encoders.encode(plain(spark, d), E_NAME)
    return blocking.hamming_blocks(e, "rec_id", "bits", L, 20, L // 10).groupBy("block").agg(F.count("*").alias("n"))


NV = f"{P}, nv AS (SELECT DISTINCT a0 || ' ' || a2 || ' ' || a1 AS node FROM p), ng AS (SELECT node, unnest(list_distinct({grams_sql('node')})) AS gram FROM nv), nn AS (SELECT node, count(*) AS n FROM ng GROUP BY node)"
ORACLE["minhash_block"] = f"WITH {minhash_sql()} SELECT min(n) AS least, avg(n) AS mean, quantile_cont(n, 0.5) AS median, max(n) AS most, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pairs FROM bs"
SIMS = f"{NV}, cm AS (SELECT a.node AS src, b.node AS dst, count(*) AS m FROM ng a JOIN ng b ON a.gram = b.gram AND a.node < b.node GROUP BY 1, 2), ed AS (SELECT src, dst, 2.0 * m / (x.n + y.n) AS sim FROM cm JOIN nn x ON x.node = src JOIN nn y ON y.node = dst WHERE 2.0 * m / (x.n + y.n) >= 0.75)"


def name_edges(spark, d) -> DataFrame:
    """Dice edges of at least 0.75 among the values; candidates meet in rare q-grams."""
    nodes = materialize(name_values(spark, d), "name-values")
    pairs = blocking.dice_candidates(nodes, "node", "grams", 0.75)
    return materialize(blocking.similarity_join(pairs, nodes, "node", "grams", c.dice, 0.75), "name-edges")


@query("sim_join", f"WITH {SIMS} SELECT src, dst, round(sim, 6) AS sim FROM ed")
def sim_join(spark, d):
    return name_edges(spark, d).withColumn("sim", r6("sim"))


BOTH = f"{SIMS}, bw AS (SELECT src AS node, dst AS other, sim FROM ed UNION ALL SELECT dst, src, sim FROM ed)"


@query("components", f"WITH RECURSIVE {BOTH}, cc AS (SELECT node, node AS reach FROM bw UNION SELECT cc.node, bw.other FROM cc JOIN bw ON bw.node = cc.reach) SELECT node, min(reach) AS component FROM cc GROUP BY node")
def components(spark, d):
    return connected_components(name_edges(spark, d))


@query("node_features", f"WITH {BOTH} SELECT node, round(max(sim), 6) AS max_sim, round(coalesce(min(sim) FILTER (sim >= 0.85), 0), 6) AS min_sim, round(coalesce(avg(sim) FILTER (sim >= 0.85), 0), 6) AS sim_avr, round(coalesce(stddev_pop(sim) FILTER (sim >= 0.85), 0), 6) AS sim_std, count(*) FILTER (sim >= 0.85) AS degree FROM bw GROUP BY node")
def node_features(spark, d):
    nodes = name_values(spark, d).select("node", F.array("node").alias("entities"))
    f = graph.basic_features(nodes, name_edges(spark, d), [0.85], 1)
    return f.select("node", r6("max_sim").alias("max_sim"), *[r6(f"{n}_85").alias(n) for n in ("min_sim", "sim_avr", "sim_std")], F.col("degree_85").alias("degree"))


@query("degree_histo", f"WITH {BOTH}, fd AS (SELECT node AS other, CAST(floor(log2(count(*)) + 1e-12) AS INTEGER) AS bucket FROM bw GROUP BY node), nr AS (SELECT node, other FROM bw WHERE sim >= 0.85), h2 AS (SELECT DISTINCT a.node, b.other FROM nr a JOIN nr b ON b.node = a.other WHERE a.node <> b.other EXCEPT SELECT node, other FROM nr), u AS (SELECT node, other, 1 AS hop FROM nr UNION ALL SELECT node, other, 2 FROM h2) SELECT node, hop, bucket, count(*) AS n FROM u JOIN fd USING (other) GROUP BY 1, 2, 3")
def degree_histo(spark, d):
    return graph.degree_histograms(name_edges(spark, d), 0.85)


@query("egonet", f"WITH {BOTH}, nr AS (SELECT node, other FROM bw WHERE sim >= 0.85), st AS (SELECT nr.node, nr.other, bw.other AS far, x.other IS NOT NULL AS inside FROM nr JOIN bw ON bw.node = nr.other LEFT JOIN nr x ON x.node = nr.node AND x.other = bw.other WHERE bw.other <> nr.node), sz AS (SELECT node, count(*) AS n FROM nr GROUP BY node), ag AS (SELECT node, count(*) FILTER (NOT inside) AS o, count(*) FILTER (inside) AS tw FROM st GROUP BY node) SELECT node, coalesce(o, 0) AS egonet_degree, round((n + coalesce(tw, 0) / 2) / (n * (n + 1) / 2), 6) AS egonet_density FROM sz LEFT JOIN ag USING (node)")
def egonet(spark, d):
    return graph.egonets(name_edges(spark, d), 0.85).withColumn("egonet_density", r6("egonet_density"))


@query("graph_characteristics", "WITH RECURSIVE " + BOTH + ", th AS (SELECT unnest([0.75, 0.85, 0.95]) AS t), cc AS (SELECT t, node, node AS reach FROM bw, th WHERE sim >= t UNION SELECT cc.t, cc.node, bw.other FROM cc JOIN bw ON bw.node = cc.reach AND bw.sim >= cc.t), co AS (SELECT t, node, min(reach) AS c FROM cc GROUP BY 1, 2), sz AS (SELECT t, c, count(*) AS s FROM co GROUP BY 1, 2), ag AS (SELECT t, sum(s) AS ins, count(*) AS c, max(s) AS m FROM sz GROUP BY t), tn AS (SELECT count(*) AS n FROM nv) SELECT CAST(t AS DOUBLE) AS threshold, n AS nodes, (SELECT count(*) FROM ed WHERE sim >= t) AS edges, CAST(n - coalesce(ins, 0) AS BIGINT) AS singletons, CAST(coalesce(c, 0) + n - coalesce(ins, 0) AS BIGINT) AS components, coalesce(m, 1) AS largest FROM th LEFT JOIN ag USING (t), tn")
def graph_characteristics(spark, d):
    return graph.characteristics(name_values(spark, d), name_edges(spark, d), [0.75, 0.85, 0.95])


def _rank_sql(rounds: int) -> str:
    """Power steps, one table each."""
    out = "dg AS (SELECT node, count(*) AS d FROM bw GROUP BY node), sz AS (SELECT count(*) AS n FROM dg), r0 AS (SELECT node, 1.0 / n AS r FROM dg, sz)"
    for k in range(rounds):
        out += f", r{k + 1} AS MATERIALIZED (SELECT other AS node, 0.15 / any_value(n) + 0.85 * sum(r / d) AS r FROM bw JOIN r{k} USING (node) JOIN dg USING (node), sz GROUP BY other)"
    return out


@query("pagerank", f"WITH {BOTH}, {_rank_sql(10)} SELECT node, round(r, 6) AS pagerank FROM r10")
def pagerank(spark, d):
    return graph.pagerank(name_edges(spark, d), rounds=10, tolerance=0).withColumn("pagerank", r6("pagerank"))


@query("centralities")
def centralities(spark, d):
    return graph.path_centralities(name_edges(spark, d))


def bit_edges(spark, d) -> DataFrame:
    """The same pairs by the similarity of their filters."""
    nodes = encoders.encode(name_values(spark, d), encoders.Encoding(("v",), Q, False, L, 4)).select("node", "bits")
    nodes = materialize(nodes, "name-filters")
    pairs = blocking.dice_candidates(nodes, "node", "bits", 0.75)
    return materialize(blocking.similarity_join(pairs, nodes, "node", "bits", c.dice, 0.75), "filter-edges")


BITS = f"{SIMS}, vs AS (SELECT node AS rec_id, node AS v FROM nv), s AS (SELECT * FROM vs), {gram_hash_sql(['v'], L)}, fb AS (SELECT DISTINCT rec_id AS node, (h1 + i * h2) % {L} AS pos FROM rg JOIN gx USING (gram), (SELECT unnest(range(1, 5)) AS i)), fn AS (SELECT node, count(*) AS n FROM fb GROUP BY node), fm AS (SELECT a.node AS src, b.node AS dst, count(*) AS m FROM fb a JOIN fb b ON a.pos = b.pos AND a.node < b.node GROUP BY 1, 2), fe AS (SELECT src, dst, 2.0 * m / (x.n + y.n) AS sim FROM fm JOIN fn x ON x.node = src JOIN fn y ON y.node = dst WHERE 2.0 * m / (x.n + y.n) >= 0.75)"


@query("edge_overlap", f"WITH {BITS} SELECT CASE WHEN fe.sim IS NULL THEN 'a' WHEN ed.sim IS NULL THEN 'b' ELSE 'both' END AS side, count(*) AS n, round(sum(coalesce(ed.sim, 0)), 4) AS sa, round(sum(coalesce(fe.sim, 0)), 4) AS sb FROM ed FULL JOIN fe USING (src, dst) GROUP BY 1")
def edge_overlap(spark, d):
    both = blocking.edge_overlap(name_edges(spark, d), bit_edges(spark, d))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("sim_a", F.lit(0.0))), 4).alias("sa"), F.round(F.sum(F.coalesce("sim_b", F.lit(0.0))), 4).alias("sb"))


@query("sim_interval_diff", f"WITH {BITS}, j AS (SELECT CAST(least(floor(round((1 - ed.sim) / 0.05, 9)), 19) AS INTEGER) AS st, fe.sim - ed.sim AS gap FROM ed JOIN fe USING (src, dst)), a AS (SELECT st, avg(gap) AS mean, count(*) AS n FROM j GROUP BY st) SELECT round(1 - t * 0.05, 4) AS high, round(coalesce(mean, 0), 6) AS mean, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(20)) AS INTEGER) AS t) LEFT JOIN a ON a.st = t WHERE t >= (SELECT min(st) FROM a)")
def sim_interval_diff(spark, d):
    return statistics.similarity_gaps(name_edges(spark, d), bit_edges(spark, d)).withColumn("mean", r6("mean"))


@query("cross_sim_tol", f"WITH {BITS}, pp AS (SELECT node, max(sim) AS t, count(*) AS a, count(*) FILTER (sim >= 0.80) AS h FROM (SELECT src AS node, sim FROM ed UNION ALL SELECT dst, sim FROM ed) GROUP BY node), ep AS (SELECT node, max(sim) AS t, count(*) AS a, count(*) FILTER (sim >= 0.80) AS h FROM (SELECT src AS node, sim FROM fe UNION ALL SELECT dst, sim FROM fe) GROUP BY node) SELECT pp.node AS plain, count(*) AS n FROM pp, ep WHERE split_part(pp.node, ' ', -1) = split_part(ep.node, ' ', -1) AND round(ep.t - pp.t, 9) BETWEEN -0.01 AND 0.25 AND ep.a >= pp.h AND pp.a >= ep.h GROUP BY 1")
def cross_sim_tol(spark, d):
    p, e = name_edges(spark, d), bit_edges(spark, d)
    nodes = name_values(spark, d).select(F.element_at(F.split("node", " "), -1).alias("block"), "node")  # by type
    pairs = blocking.cross_pairs(nodes, nodes, "node", "node")
    return blocking.edge_tolerant(pairs, p, e, 0.75).groupBy("plain").agg(F.count("*").alias("n"))


@query("norm01", f"WITH {BOTH}, f AS (SELECT node, max(sim) AS m, CAST(count(*) AS DOUBLE) AS d FROM bw GROUP BY node), r AS (SELECT least(1, min(m)) AS ml, greatest(0, max(m)) AS mh, least(1, min(d)) AS dl, greatest(0, max(d)) AS dh FROM f) SELECT node, round((m - ml) / (mh - ml), 6) AS m, round((d - dl) / (dh - dl), 6) AS d FROM f, r")
def norm01(spark, d):
    f = graph.both_ways(name_edges(spark, d)).groupBy("node").agg(F.max("sim").alias("m"), F.count("*").cast("double").alias("d"))
    a, _ = graph.normalised(f, f, ["m", "d"])
    return a.select("node", r6("m").alias("m"), r6("d").alias("d"))


def bipartite(spark, d) -> DataFrame:
    """Matches between the names and their filters as in MT: every edge of the filters, from its first value to its second alone."""
    e = bit_edges(spark, d)
    return e.where("sim >= 0.8").select(F.col("src").alias("plain"), F.col("dst").alias("enc"), F.col("sim").alias("cos"))


def scored_both_ways(spark, d) -> DataFrame:
    """All matches between the names and their filters: every edge of the filters, either way, and each value with itself."""
    one = scored(spark, d)
    back = one.select(F.col("enc").alias("plain"), F.col("plain").alias("enc"), "score")
    same = name_values(spark, d).select(F.col("node").alias("plain"), F.col("node").alias("enc"), F.lit(1.0).alias("score"))
    return one.unionByName(back).unionByName(same)


M2 = "m2 AS (SELECT plain, enc, round(cos, 9) AS score FROM mt UNION ALL SELECT enc, plain, round(cos, 9) FROM mt UNION ALL SELECT node, node, 1.0 FROM nv)"


def _greedy_sql(rounds: int) -> str:
    """Rounds of mutual best pairs, enough of them for these tables; each takes what the rounds before have left."""
    out, took = "l0 AS (SELECT * FROM m2)", []
    for k in range(rounds):
        out += (
            f", t{k} AS MATERIALIZED (SELECT plain, enc FROM (SELECT plain, enc, row_number() OVER (PARTITION BY plain ORDER BY score DESC, plain, enc) AS a, row_number() OVER (PARTITION BY enc ORDER BY score DESC, plain, enc) AS b FROM l{k}) WHERE a = 1 AND b = 1)"
            f", l{k + 1} AS MATERIALIZED (SELECT * FROM l{k} WHERE plain NOT IN (SELECT plain FROM t{k}) AND enc NOT IN (SELECT enc FROM t{k}))"
        )
        took.append(f"SELECT plain, enc FROM t{k}")
    return f"{out} {' UNION ALL '.join(took)}"


MT = f"{BITS}, mt AS (SELECT src AS plain, dst AS enc, sim AS cos FROM fe WHERE sim >= 0.8)"
CF = f"{MT}, pa AS (SELECT plain, sum(cos) AS ps, count(*) AS pn FROM mt GROUP BY plain), ea AS (SELECT enc, sum(cos) AS es, count(*) AS en FROM mt GROUP BY enc), rw AS (SELECT plain, enc, cos, CASE WHEN pn + en > 2 THEN cos / ((ps + es - 2 * cos) / (pn + en - 2)) ELSE cos / ((SELECT min(cos) FROM mt) - 0.1) END AS s, 1.0 / (pn + en - 1) AS d FROM mt JOIN pa USING (plain) JOIN ea USING (enc)), bd AS (SELECT min(s) AS s0, max(s) AS s1, min(d) AS d0, max(d) AS d1 FROM rw)"


@query("confidence", f"WITH {CF} SELECT plain, enc, round(cos, 6) AS cos, round((s - s0) / (s1 - s0), 6) AS sim_conf, round((d - d0) / (d1 - d0), 6) AS degree_conf FROM rw, bd")
def confidence(spark, d):
    got = graph.confidences(bipartite(spark, d))
    return got.select("plain", "enc", *[r6(x).alias(x) for x in ("cos", "sim_conf", "degree_conf")])


def scored(spark, d) -> DataFrame:
    return bipartite(spark, d).select("plain", "enc", F.round("cos", 9).alias("score"))


@query("match_symmetric", f"WITH {MT}, r AS (SELECT plain, enc, row_number() OVER (PARTITION BY plain ORDER BY round(cos, 9) DESC, plain, enc) AS a, row_number() OVER (PARTITION BY enc ORDER BY round(cos, 9) DESC, plain, enc) AS b FROM mt) SELECT plain, enc FROM r WHERE a = 1 AND b = 1")
def match_symmetric(spark, d):
    return matching.symmetric(scored(spark, d)).select("plain", "enc")


@query("match_greedy", f"WITH {MT}, {M2}, {_greedy_sql(4)}")
def match_greedy(spark, d):
    return matching.greedy(scored_both_ways(spark, d)).select("plain", "enc")


@query("match_hungarian", f"WITH {NV} SELECT count(*) AS n, CAST(count(*) AS DOUBLE) AS score FROM nv")
def match_hungarian(spark, d):
    return matching.hungarian(scored_both_ways(spark, d)).agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query("match_random")
def match_random(spark, d):
    return matching.random_matching(scored_both_ways(spark, d)).select("plain", "enc")


# -- evaluation


def judged(spark, d) -> DataFrame:
    """Every record matched with the most frequent names (all of several) of its brand that share its first word; the truth is its own name."""
    p = plain(spark, d).select("rec_id", "a0", "a2", F.split("a0", " ")[0].alias("w"))
    names = p.groupBy("w", "a2", "a0").agg(F.count("*").alias("n"))
    most = names.groupBy("w", "a2").agg(F.max("n").alias("n"))
    guess = names.join(most, ["w", "a2", "n"]).select("w", "a2", F.concat_ws("/", "a0", "a2").alias("plain"))
    return p.join(guess, ["w", "a2"]).select(F.col("rec_id").alias("enc"), "plain", F.concat_ws("/", "a0", "a2").alias("truth"))


JD = f"{P}, px AS (SELECT *, split_part(a0, ' ', 1) AS w FROM p), gs AS (SELECT a0, a2, w FROM (SELECT a0, a2, w, rank() OVER (PARTITION BY w, a2 ORDER BY count(*) DESC) AS r FROM px GROUP BY a0, a2, w) WHERE r = 1), jd AS (SELECT x.rec_id AS enc, y.a0 || '/' || y.a2 AS plain, x.a0 || '/' || x.a2 AS truth FROM px x JOIN gs y ON x.w = y.w AND x.a2 = y.a2)"


@query("reident_classes", f"WITH RECURSIVE {JD}, lk AS (SELECT 'e' || enc AS a, 'p' || plain AS b FROM jd UNION SELECT 'p' || plain, 'e' || enc FROM jd), cc AS (SELECT a AS node, a AS reach FROM lk UNION SELECT cc.node, lk.b FROM cc JOIN lk ON lk.a = cc.reach), co AS (SELECT node, min(reach) AS k FROM cc GROUP BY node), pl AS (SELECT DISTINCT k, plain, enc, truth FROM jd JOIN co ON co.node = 'e' || enc), rt AS (SELECT k, enc, bool_or(truth IN (SELECT plain FROM pl z WHERE z.k = pl.k)) AS ok FROM pl GROUP BY k, enc), sz AS (SELECT k, count(DISTINCT enc) AS e, count(DISTINCT plain) AS p FROM pl GROUP BY k), gd AS (SELECT k, count(*) AS n, count(*) FILTER (ok) AS c FROM rt GROUP BY k) SELECT CASE WHEN e = 1 THEN '1' ELSE 'm' END || '-' || CASE WHEN p = 1 THEN '1' ELSE 'm' END || CASE WHEN c = n THEN '' WHEN c > 0 THEN '-p' ELSE '-w' END AS class, count(*) AS components FROM sz JOIN gd USING (k) GROUP BY 1")
def reident_classes(spark, d):
    return evaluate.class_counts(evaluate.component_classes(judged(spark, d)))


@query("suspicion", f"WITH {JD}, f AS (SELECT enc, count(DISTINCT plain) AS f FROM jd GROUP BY enc HAVING bool_or(plain = truth)), s AS (SELECT (1.0 / f - 1.0 / 100) / (1 - 1.0 / 100) AS s FROM f) SELECT count(*) AS n, round(coalesce(max(s), 0), 6) AS most, round(coalesce(min(s), 0), 6) AS least, round(coalesce(avg(s), 0), 6) AS mean, round(coalesce(quantile_cont(s, 0.5), 0), 6) AS median, count(*) FILTER (round(s, 9) = 1) AS certain FROM s")
def suspicion(spark, d):
    got = evaluate.suspicion_summary(judged(spark, d), 100)
    return got.select(F.col("values").alias("n"), *[r6(x).alias(x) for x in ("most", "least", "mean", "median")], "certain")


@query("topk_accuracy", f"WITH {JD}, r AS (SELECT plain = truth AS ok, row_number() OVER (ORDER BY length(plain) DESC, enc, plain) AS r FROM jd) SELECT t AS top, count(*) AS n, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS \"right\" FROM r, (SELECT unnest([10, 20, 50, 100, 200, 500, 1000]) AS t) WHERE r <= t GROUP BY t UNION ALL SELECT NULL, count(*), CAST(coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END), 0) AS BIGINT) FROM r")
def topk_accuracy(spark, d):
    m = judged(spark, d).distinct().withColumn("score", F.char_length("plain")).withColumn("ok", F.col("plain") == F.col("truth"))
    return statistics.ranked_accuracy(m, "score", "ok", ["enc", "plain"])


@query("regression_calib")
def regression_calib(spark, d):
    pairs = name_edges(spark, d).select("src", "dst", F.col("sim").alias("plain_sim")).join(bit_edges(spark, d).select("src", "dst", F.col("sim").alias("enc_sim")), ["src", "dst"])
    pairs = pairs.withColumn("union_size", F.char_length("src") + F.char_length("dst"))
    return graph.calibration(pairs)[1]


@query("graph_analysis")
def graph_analysis(spark, d):
    """The graph pipeline over names, brands and types, the encoded side half of them: every matcher under every set of weights."""
    value = F.concat_ws(" ", "a0", "a2", "a1")
    e = encoders.Encoding(("a0", "a2", "a1"), Q, False, L, 4)
    p = pipelines.GraphParams(e, 0.75, (0.8, 0.9), 3, 500, 20, 50, 0.95, matchers=("symmetric", "greedy", "hungarian", "random"), calibrate="linear", tolerance=(0.05, 0.05))
    return pipelines.graph_analysis(encoded(spark, d).withColumn("value", value), plain(spark, d).withColumn("value", value), p)


# -- scale


@query("encode_lineitem", f"WITH q AS (SELECT l_orderkey, l_linenumber, lower(trim(p_name)) AS a0 FROM lineitem JOIN part ON l_partkey = p_partkey), p AS (SELECT DISTINCT a0 AS rec_id, a0 FROM q), s AS (SELECT * FROM p), {gram_hash_sql(['a0'], L)}, b AS (SELECT DISTINCT rec_id, CAST((h1 + i * h2) % {L} AS INTEGER) AS pos FROM rg JOIN gx USING (gram), (SELECT unnest(range(1, {K + 1})) AS i)), t AS ({JOINED.format('b')}) SELECT bits, count(*) AS n FROM q JOIN t ON t.rec_id = q.a0 GROUP BY bits")
def encode_lineitem(spark, d):
    """Names of all line items; each distinct value is encoded once and joined back."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey")
    names = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", c.normal(F.col("p_name")).alias("a0"))
    rows = items.join(names, F.col("l_partkey") == F.col("p_partkey")).groupBy("a0").agg(F.count("*").alias("n"))
    return encoders.encode(rows, E_NAME).select(frequency.pattern(F.col("bits")).alias("bits"), "n").groupBy("bits").agg(F.sum("n").alias("n"))


@query("document_grams", "WITH g AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS gram FROM documents WHERE length(text) >= 3) SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY gram")
def document_grams(spark, d):
    """q-grams over long texts."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    each = docs.select("doc_id", F.explode(c.grams_of_long(F.col("text"), 3)).alias("gram"))
    return each.groupBy("gram", "doc_id").agg(F.count("*").alias("m")).groupBy("gram").agg(F.sum("m").alias("n"), F.count("*").alias("docs"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of the names and how often each occurs."""
    return bf_freq(spark, sf_dir)
