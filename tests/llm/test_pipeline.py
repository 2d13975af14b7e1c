"""The pipeline against the stages' own rules, and the registry of this subpackage."""

import __spark_entry__ as entry
import corpus_pipeline
from linkveil.llm import packing, quality_rules, queries, simhash
from linkveil.session import materialize
from tests.llm import common as c


def test_registry_has_one_query_for_each_operator():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert names["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_stages_chain_and_keep_columns(spark):
    docs = c.documents(spark)
    names, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, c.SF), name)
        assert docs.columns == names
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) == docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, c.SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    ran = corpus_pipeline.run(spark, c.SF)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, packed.collect()))


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (c.awkward(spark), c.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, docs, c.SF), name)
            assert out.columns == docs.columns
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        assert packing.stage(spark, docs, c.SF).count() >= docs.count()
    assert quality_rules.stage(spark, c.awkward(spark), c.SF).count() > 0
