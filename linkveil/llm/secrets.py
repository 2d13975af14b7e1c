"""Secret scans through an incremental blob ledger (operator 8), DataFrame functions only.

Every version of a text is a blob, addressed by the SHA-256 of its content. The ledger has two tables, both appended to:
`blobs`, one row for each blob and rule version that has been scanned, with what was found (mostly nothing), and `paths`,
one row for each blob that a path (a document's id) has ever held, with the number of the scan that saw it first. A scan
takes the blobs of its input that lack a row for some rule version, scans each once with those rules only, appends the
rows, and joins the findings of all its blobs back to every path that holds them, or has held them (`history`). Scanning
the same input again reads the ledger alone; a new version of one rule scans for that rule alone.

Spans are code points, end exclusive: a rule's matches and the stretches between them (split by the same pattern)
have lengths that add up to positions.

Edge cases: null texts count as empty and share the empty blob; copies share a blob and get the same spans; a null
doc_id is carried along, as a path without a name; equal spans of two rules stay two spans, in the rules' order; a text of
very many findings costs their number to the power of 1.5 at most; an empty table gives an empty result and leaves the
blobs as they were; other columns are ignored (a stage keeps them; names that begin with two underscores are the
operator's own).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkveil.llm.common import before, let, sized, spread, table
from linkveil.session import materialize, new_path

#: Rows of a side that may be broadcast; findings, of any length, are bound by their bytes too.
MOST = 200_000
FINDING_BYTES = 64
SPAN = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; of those, the ones whose `group` has at least `least` characters count."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three are the base rules, in their order; the others are the method's own.
BASE_RULES = (
    Rule(
        "assign",
        r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=1,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),  # a maximal run of 16 or more is what `[0-9a-f]+` finds and keeps
)
OWN_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + OWN_RULES


def spans_of(text: Column, rule: Rule) -> Column:
    """The spans (start, end) of a rule in a text that is not null."""

    def place(found: Column) -> Column:
        def at(between: Column) -> Column:
            gap = lambda i: F.char_length(F.get(between, i))
            steps = F.transform(found, lambda m, i: gap(i) + F.char_length(m))

            def span(starts: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    begin = F.get(starts, i) + gap(i)
                    both = F.struct(begin.cast("int").alias("start"), (begin + F.char_length(m)).cast("int").alias("end"))
                    return F.when(F.char_length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least, both) if rule.least > 1 else both

                return F.filter(F.transform(found, one), lambda x: x.isNotNull())

            return let(before(steps, F.lit(0), lambda a, x: a + x), span)

        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, rule.pattern, -1), at).cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), place)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Ledger:
    """Parquet tables in a shared folder, appended to, never rewritten: blobs (blob, rule, spans) and paths (path, version, blob)."""

    schema = f"blob binary, rule string, spans {SPAN}"
    path_schema = "path string, version long, blob binary"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "blob-ledger")

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        """(blob, rule, spans) of every scanned pair."""
        return self._read("blobs", self.schema)

    def paths(self) -> DataFrame:
        """(path, version, blob): the scan that first saw the blob at the path."""
        return self._read("paths", self.path_schema)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/blobs")

    def note(self, docs: DataFrame, key: str, text: str) -> None:
        """Appends what the paths of docs hold now, where they have not held it before."""
        old = self.paths()
        version = (old.agg(F.max("version")).first()[0] or 0) + 1
        now = docs.select(F.col(key).cast("string").alias("path"), F.lit(version).cast("long").alias("version"), blob_of(F.col(text)).alias("blob")).distinct()
        if version > 1:
            held = old.select(F.col("path").alias("__p"), F.col("blob").alias("__b"))
            now = now.join(held, F.col("path").eqNullSafe(F.col("__p")) & (F.col("blob") == F.col("__b")), "left_anti")
        now.write.mode("append").parquet(f"{self.path}/paths")

    @property
    def empty(self) -> bool:
        return self.read().isEmpty()


def unseen(docs: DataFrame, ledger: Ledger, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, __t, seen): one text for each blob that lacks a row for some rule version, with the versions it has.

    Which blobs to scan is settled on addresses and keys; texts stay where they are while that table is small, as
    it is for a run that brings few new blobs, and for a first run (an empty ledger), where only copies need it.
    """
    rows = docs.select(F.col(key).alias("__key"), blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    none = F.array().cast("array<string>")
    keys = rows.groupBy(F.col("blob").alias("__b")).agg(F.min("__key").alias("__first"), F.count("*").alias("__n"))
    mine = F.col("blob") == F.col("__b")
    if ledger.empty:
        copied = sized(materialize(keys.where("__n > 1"), "copied-blobs"), MOST)
        chosen = rows.join(copied, mine, "left").where(F.col("__b").isNull() | F.col("__key").eqNullSafe(F.col("__first")))
        return chosen.select("blob", "__t", none.alias("seen"))
    tags = [r.tag for r in rules]
    known = ledger.read().where(F.col("rule").isin(tags)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    lacking = keys.join(known, mine, "left").where(F.col("seen").isNull() | (F.size("seen") < len(tags)))
    todo = sized(materialize(lacking.select("__b", "__first", F.coalesce("seen", none).alias("seen")), "unseen-blobs"), MOST)
    return rows.join(todo, mine).where(F.col("__key").eqNullSafe(F.col("__first"))).select("blob", "__t", "seen")


def scan(docs: DataFrame, ledger: Ledger, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the unseen (blob, rule version) pairs of docs, and appends them and the paths of docs to the ledger."""
    todo = unseen(docs, ledger, key, text, rules)
    found = F.array(*[
        F.when(
            ~F.array_contains("seen", r.tag), F.struct(F.lit(r.tag).alias("rule"), spans_of(F.col("__t"), r).alias("spans"))
        )
        for r in rules
    ])
    rows = todo.select("blob", F.explode(found).alias("f")).where("f is not null").select("blob", "f.rule", "f.spans")
    ledger.append(rows)
    ledger.note(docs, key, text)


def findings(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found: array of (start, rank, kind, end), sorted): blobs in which something was found."""
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.tag, k)])
    kind = F.substring_index("rule", "@", 1)
    rows = ledger.read().where(F.col("rule").isin([r.tag for r in rules]) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule"])
    each = rows.select(
        "blob",
        F.transform(
            "spans",
            lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, F.col("rule")).alias("rank"), kind.alias("kind"), s["end"].alias("end")),
        ).alias("s"),
    )
    return each.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("found"))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def small(found: DataFrame) -> DataFrame:
    """A table of findings, marked for broadcast if its bytes allow it."""
    return sized(found, MOST, FINDING_BYTES * (1 + F.size("found")))


def history(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, version, blob, found) of every version of every path in which something was found."""
    return ledger.paths().join(small(materialize(findings(ledger, rules), "findings")), "blob").select("path", "version", "blob", "found")


def scan_documents(docs: DataFrame, ledger: Ledger, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, blob, found) of every document, after scanning what the ledger lacks."""
    scan(docs, ledger, key, text, rules)
    hits = small(materialize(findings(ledger, rules), "findings")).withColumnRenamed("blob", "__b")
    paths = docs.select(key, blob_of(F.col(text)).alias("blob"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return paths.join(hits, F.col("blob") == F.col("__b"), "left").select(key, "blob", F.coalesce("found", none).alias("found"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans on one ledger: an earlier state of the corpus, in which a sixteenth of the documents was not there yet, and
    the whole table, of which only the blobs that the first has not seen are scanned."""
    docs, ledger = table(spark, sf_dir, "documents"), Ledger(spark)
    scan(docs.where(spread(4, F.col("doc_id")) > 0), ledger)
    out = scan_documents(docs, ledger)
    of = lambda k: F.size(F.filter("found", lambda s: s["rank"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[of(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)],
        F.sha2(as_text(F.filter("found", lambda s: s["rank"] < len(BASE_RULES))), 256).alias("base_sha256"),
        as_text(F.col("found")).alias("spans"),
    )


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """text with every span replaced by mark; spans that overlap become one."""

    def put(raw: Column) -> Column:
        """raw: UTF-32, where a stretch of code points is a stretch of bytes."""
        cut = lambda a, b: F.decode(F.substring(raw, 4 * a + 1, 4 * (b - a)), "UTF-32")

        def pieces(past: Column) -> Column:
            """past: where the spans before each end."""
            first = lambda s, i: F.when(s["start"] >= F.get(past, i), F.concat(cut(F.get(past, i), s["start"]), F.lit(mark))).otherwise(F.lit(""))
            last = F.array_max(F.transform(found, lambda s: s["end"]))
            return F.concat(F.array_join(F.transform(found, first), ""), cut(last, F.char_length(text)))

        return let(before(F.transform(found, lambda s: s["end"]), F.lit(0), F.greatest), pieces)

    return F.when(F.size(found) == 0, text).otherwise(let(F.encode(text, "UTF-32"), put))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark in text, and n_chars of texts that changed."""
    ledger = Ledger(spark)
    scan(docs, ledger)
    found = small(materialize(findings(ledger), "findings"))
    hits = found.select(F.col("blob").alias("__b"), F.col("found").alias("__found"))
    names = docs.columns
    rows = docs.select(*names, blob_of(F.col("text")).alias("__blob"))
    joined = rows.join(hits, F.col("__blob") == F.col("__b"), "left")
    clean = F.when(F.col("__found").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("__found")))
    changed = {"text": F.col("__clean"), "n_chars": F.when(F.col("__found").isNull(), F.col("n_chars")).otherwise(F.char_length("__clean").cast("long"))}
    return joined.select(*names, "__found", clean.alias("__clean")).select(
        *[(changed[c] if c in changed else F.col(c)).alias(c) for c in names]
    )


def _spans_sql(rank: int, rule: Rule) -> str:
    """One rule's spans in DuckDB, from the lengths of its matches and of what lies between them."""
    p = rule.pattern.replace("'", "''")
    return (
        f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, s + len(g) AS a, s + len(g) + len(m) AS b, len(regexp_extract(m, '{p}', {rule.group})) AS n, {rule.least} AS least FROM ("
        f"SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(list_transform(range(len(ms)), lambda i: CAST(coalesce(list_sum(list_transform(gs[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:i], lambda x: len(x))), 0) AS BIGINT))) AS s "
        f"FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d))"
    )


#: The same rows in DuckDB (doc_id must be unique there).
ORACLE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), every AS ("
    + " UNION ALL ".join(_spans_sql(k, r) for k, r in enumerate(RULES))
    + "), f AS (SELECT *, kind || ':' || a || ':' || b AS s FROM every WHERE n >= least) "
    + "SELECT d.doc_id, "
    + ", ".join(f"count(*) FILTER (rank = {k}) AS n_{r.kind}" for k, r in enumerate(BASE_RULES))
    + f", sha256(coalesce(string_agg(s, ',' ORDER BY a, rank) FILTER (rank < {len(BASE_RULES)}), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, rank), '') AS spans "
    + "FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"
)
