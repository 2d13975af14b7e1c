"""Benchmark decontamination over a distributed positional inverted index (operator 4), DataFrame functions only.

1. One pass over the corpus stores its postings (document, term, position), sorted by term in each file. Terms are 64-bit
   hashes of lower-cased words. Postings of the benchmark's terms are stored while these are few enough to be broadcast;
   beyond that, or where asked for, every token's, an index that serves any benchmark. An end posting per document holds
   its number of words and its id. The texts are not read again.
2. Counts of the benchmark's terms come from the index. Of every window of `width` consecutive item words the two rarest
   terms are anchors; a window with a term that never occurs goes.
3. A posting at position p of the anchor at item position i votes for the alignment p - i. Alignments on which two anchors
   meet (one, for items of one word) are the intersection of the offset-adjusted lists.
4. At those alignments the postings of all the item's terms are intersected too; runs of `width` of them in a row are exact
   phrases. Items of one or two words are settled by their anchors.
5. Proximity: the (up to) three rarest terms of an item, all within `width` words from one of them on.

Edge cases: a null or empty text has no words and is never contaminated; an item without words has no window; items
of fewer than `width` words are one window; repeated rows are documents of their own and get the same result each; null
item ids are matched but not named; equal items count by distinct item_id; of equally rare terms the first in the item
(for proximity the first by name) is taken; a very long text is many postings, no row grows with it but the list of its
hits; empty tables give empty results; other columns are ignored, a stage keeps them (names that begin with two
underscores are the operator's own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkveil.llm.common import find_all, lower_ascii, sized, table
from linkveil.session import materialize

#: Word characters: digits, letters and all beyond ASCII. (A negated class of many ranges is several times slower in Java.)
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: The term of end postings; no word has a blank.
END = " "
#: Rows of a few longs (terms, anchors, documents) that may be broadcast: some 30 MB.
MOST = 1_000_000
RAREST = 3


def end_term() -> Column:
    return F.xxhash64(F.lit(END))


def items_of(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id string, words, terms): distinct items that have words; terms are the words' hashes."""
    words = F.transform(find_all(F.col(text), WORD), lower_ascii)
    return (
        benchmark.select(F.col(item).cast("string").alias("item_id"), words.alias("words"))
        .where(F.size("words") > 0)
        .distinct()
        .withColumn("item", F.xxhash64("item_id", "words"))
        .withColumn("terms", F.transform("words", lambda w: F.xxhash64(w)))
    )


def positional_index(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (row, term, pos, key, k1, k2) of terms (a column `term` of hashes), or of all tokens.

    row numbers the documents. End postings have the document's words as pos, and key, k1, k2: its id and two hashes that
    equal rows share and others do not. Others have nulls there.
    """
    words = F.array_append(find_all(F.col("__text"), WORD), F.lit(END))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("__key"), F.col(text).alias("__text"), F.xxhash64(F.col(key)).alias("__k1"), F.xxhash64(F.col(text)).alias("__k2")
    )
    split = rows.select("row", "__key", "__k1", "__k2", F.posexplode(words).alias("pos", "__raw"))
    tokens = split.select("row", F.xxhash64(lower_ascii(F.col("__raw"))).alias("term"), "pos", "__key", "__k1", "__k2")
    if terms is not None:
        wanted = terms.select("term").unionByName(docs.sparkSession.range(1).select(end_term().alias("term"))).distinct()
        if wanted.limit(MOST + 1).count() <= MOST:
            tokens = tokens.join(F.broadcast(wanted), "term", "left_semi")
    at_end = lambda c: F.when(F.col("term") == end_term(), F.col(c))
    out = tokens.select("row", "term", "pos", at_end("__key").alias("key"), at_end("__k1").alias("k1"), at_end("__k2").alias("k2"))
    return materialize(out.sortWithinPartitions("term", "row", "pos"), "postings")


def documents_of(index: DataFrame) -> DataFrame:
    """(row, key, k1, k2, n_words) of every document."""
    return index.where(F.col("term") == end_term()).select("row", "key", "k1", "k2", F.col("pos").cast("long").alias("n_words"))


def term_counts(index: DataFrame, items: DataFrame) -> DataFrame:
    """(term, word, tf): how often each of the items' words occurs in the corpus."""
    own = items.select(F.explode(F.arrays_zip("terms", "words")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.words").alias("word")).distinct()
    counts = index.groupBy("term").agg(F.count("*").alias("tf"))
    return own.join(counts, "term", "left").select("term", "word", F.coalesce("tf", F.lit(0).cast("long")).alias("tf"))


def anchors_of(items: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """(term, item, at, need): for every window that can occur, its two rarest positions in the item."""
    n = F.size("terms")
    windows = items.select(
        "item", "terms", F.explode(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))).alias("start")
    ).select("item", "start", n.alias("n"), F.posexplode(F.slice("terms", F.col("start") + 1, width)).alias("k", "term"))
    rated = windows.join(counts.select("term", "tf"), "term").select("item", "start", "n", "term", (F.col("start") + F.col("k")).alias("at"), "tf")
    two = rated.groupBy("item", "start", "n").agg(
        F.min("tf").alias("least"), F.slice(F.array_sort(F.collect_list(F.struct("tf", "at", "term"))), 1, 2).alias("two")
    )
    return (
        two.where("least > 0")
        .select("item", F.least(F.lit(2), "n").alias("need"), F.explode("two").alias("a"))
        .select(F.col("a.term").alias("term"), "item", F.col("a.at").alias("at"), "need")
        .distinct()
    )


def alignments(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(row, item, delta) where as many anchors as are needed meet."""
    return (
        index.select("row", "term", "pos").join(sized(anchors, MOST), "term")
        .groupBy("row", "item", (F.col("pos") - F.col("at")).alias("delta"))
        .agg(F.count("*").alias("n"), F.min("need").alias("need"))
        .where("n >= need")
        .select("row", "item", "delta")
    )


def phrase_hits(index: DataFrame, items: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """(row, item, start, span): positions in the document where windows of the item occur in whole. found: a table of alignments."""
    own = sized(items.select("item", "terms"), MOST, 40 + 8 * F.size("terms"))
    placed = found.join(own, "item")
    n = F.size("terms")
    short = placed.where(n <= 2).select("row", "item", F.col("delta").alias("start"), n.alias("span"))
    wanted = placed.where(n > 2).select("row", "item", "delta", n.alias("n"), F.posexplode("terms").alias("j", "term"))
    wanted = wanted.withColumn("pos", F.col("delta") + F.col("j")).where("pos >= 0")
    # postings of documents with an alignment alone go on; one posting meets each (row, term, pos), so no key is hot
    near = index.select("row", "term", "pos").join(sized(materialize(found.select("row").distinct(), "aligned-rows"), MOST), "row", "left_semi")
    met = wanted.join(near, ["row", "term", "pos"]).groupBy("row", "item", "delta", "n").agg(F.array_sort(F.collect_set("j")).alias("js"))
    span = F.least("n", F.lit(width))
    begin = F.filter("js", lambda j, i: F.get(F.col("js"), i + F.col("span") - 1) == j + F.col("span") - 1)
    whole = met.withColumn("span", span).select("row", "item", "delta", "span", F.explode(begin).alias("j"))
    return whole.select("row", "item", (F.col("delta") + F.col("j")).alias("start"), "span").unionByName(short)


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(query, row, pos): places from which all of a query's terms lie within slop words. queries: (query, terms array of hashes)."""
    own = queries.select("query", F.array_distinct("terms").alias("terms")).where(F.size("terms") > 0)
    each = own.select("query", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    near = Window.partitionBy("query", "row").orderBy("pos").rangeBetween(0, slop)
    return (
        index.select("row", "term", "pos").join(sized(each, MOST), "term")
        .withColumn("got", F.size(F.collect_set("term").over(near)))
        .where("got = n")
        .select("query", "row", "pos")
        .distinct()
    )


def rarest_terms(items: DataFrame, counts: DataFrame, most: int = RAREST) -> DataFrame:
    """(query, terms): the item and its rarest different terms, at most `most`; equally rare ones by name."""
    each = items.select("item", F.explode(F.array_distinct("terms")).alias("term")).join(counts, "term")
    least = F.slice(F.array_sort(F.collect_list(F.struct("tf", "word", "term"))), 1, most)
    return each.groupBy(F.col("item").alias("query")).agg(F.transform(least, lambda x: x["term"]).alias("terms"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13, share: int = 20, every_term: bool = False
) -> DataFrame:
    """(key, k1, k2, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of every document.

    n_near: distinct items (by item_id) of which the rarest terms lie within width words. every_term: index all tokens.
    """
    items = materialize(items_of(benchmark), "benchmark-items")
    index = positional_index(docs, None if every_term else items.select(F.explode("terms").alias("term")).distinct(), key, text)
    counts = materialize(term_counts(index, items), "term-counts")
    anchors = materialize(anchors_of(items, counts, width), "anchors")
    found = materialize(alignments(index, anchors), "alignments")
    hits = phrase_hits(index, items, found, width)
    near = proximity_matches(index, materialize(rarest_terms(items, counts), "rarest-terms"), width).select("row", F.col("query").alias("item")).distinct()
    names = sized(items.select("item", "item_id"), MOST, 40 + F.coalesce(F.octet_length("item_id"), F.lit(0)))

    def covered(spans: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["s"] + x["l"] - F.greatest(x["s"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], x["s"] + x["l"]).alias("end"),
        )
        return F.aggregate(spans, zero, step)["n"].cast("long")

    per_doc = (
        hits.join(names, "item").groupBy(F.col("row").alias("r1"))
        .agg(F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), F.col("span").alias("l")))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("ids"))
        .select("r1", covered(F.col("spans")).alias("hit"), "ids")
    )
    near_doc = near.join(names, "item").groupBy(F.col("row").alias("r2")).agg(F.count_distinct("item_id").alias("near"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    none = F.lit(0).cast("long")
    judged = documents_of(index).join(per_doc, F.col("row") == F.col("r1"), "left").join(near_doc, F.col("row") == F.col("r2"), "left")
    out = judged.select(
        F.col("key").alias(key), "k1", "k2", "n_words", F.coalesce("hit", none).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.coalesce("near", none).alias("n_near"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, with the columns of docs."""
    names = docs.columns
    judged = contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = materialize(judged.where("contaminated").select(F.col("k1").alias("__b1"), F.col("k2").alias("__b2")).distinct(), "contaminated")
    own = (F.xxhash64(docs["doc_id"]) == F.col("__b1")) & (F.xxhash64(docs["text"]) == F.col("__b2"))
    return docs.join(sized(bad, MOST), own, "left_anti").select(*[docs[f"`{n}`"] for n in names])


#: The same result in DuckDB: windows are joined by their words as one string.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
b AS (SELECT item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT doc_id, l, s, array_to_string(w[s + 1 : s + l], ' ') AS win
       FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM d, ls WHERE len(w) >= l)),
h AS (SELECT doc_id, s, dw.l AS l, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.l = iw.l),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY doc_id),
tf AS (SELECT term, count(*) AS tf FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
nt AS (SELECT item_id, w, term, row_number() OVER (PARTITION BY item_id, w ORDER BY coalesce(tf, 0), term) AS k, least(3, count(*) OVER (PARTITION BY item_id, w)) AS need
       FROM (SELECT DISTINCT item_id, w, unnest(w) AS term FROM b WHERE len(w) > 0) LEFT JOIN tf USING (term)),
dp AS (SELECT doc_id, term, pos, item_id, nt.w AS w, need FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d) JOIN nt USING (term) WHERE k <= 3),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
         SELECT x.doc_id, x.item_id FROM dp x JOIN dp y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.w = y.w AND y.pos BETWEEN x.pos AND x.pos + 13
         GROUP BY x.doc_id, x.item_id, x.w, x.pos, x.need HAVING count(DISTINCT y.term) = x.need) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id LEFT JOIN nr ON nr.doc_id = d.doc_id
"""
