"""Every registered query against its DuckDB SQL, the way the driver compares: columns by name, rows in any order."""

import os
import re
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v + 0.0:.5f}" if v == v else "nan"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    ran = db.execute(SQL[name])
    names = [x[0] for x in ran.description]
    want = rows(names, ran.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want


#: What must hold of the rows of queries that SQL cannot express.
HOLDS = {
    "markov_prob": lambda rows: rows and all(1 <= len(r.extra.split("|")) <= 3 and all(g[0] == r.g1[1] for g in r.extra.split("|")) for r in rows),
    "match_random": lambda rows: rows and len({r.plain for r in rows}) == len({r.enc for r in rows}) == len(rows),
    "match_confident": lambda rows: rows and len({r.plain for r in rows}) == len({r.enc for r in rows}) == len(rows),
    "match_histogram": lambda rows: {r.kind for r in rows} == {"match", "non-match"} and all(r.bucket == 1 for r in rows if r.kind == "match"),
    "regression_calib": lambda rows: len(rows) == 1 and rows[0].r2 <= 1 and 0 <= rows[0].mean_error < 0.2,
    "centralities": lambda rows: rows and all(0 <= r.closeness <= 1 and 0 <= r.betweenness <= 1 and 0 < r.degree_centrality <= 2 for r in rows) and max(r.betweenness for r in rows) > 0,
    "position_scores": lambda rows: rows and all(0 <= r.precision <= 1 and 0 <= r.recall <= 1 for r in rows),
    "mining_analysis": lambda rows: rows and all(r["n"] > 0 and 0 <= r.accuracy <= 1 for r in rows),
    "mining_parts": lambda rows: {r.method for r in rows} == {"bf_tuple", "set_inter"} and all(r["n"] > 0 and 0 <= r.accuracy <= 1 for r in rows),
    "graph_analysis": lambda rows: len({(r.matcher, r.weights) for r in rows}) == 16 and all(0 <= r.right <= r["n"] for r in rows if r["n"]),
    "walk_vectors": lambda rows: rows and all(r["n"] == 8 for r in rows),
}


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not re.match(r"op\d+_", n) and n != "pipeline"))
def test_holds(spark, name):
    assert HOLDS[name](QUERIES[name](spark, SF).collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
