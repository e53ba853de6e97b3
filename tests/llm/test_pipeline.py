from collections import Counter

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from checks.run import compare, connect
from strandline.llm import common, jaccard, quality, secrets
from strandline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    status, *_, note = compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert status == "ok", note


def test_registered():
    assert [sum(q.startswith(f"op{n}_") for q in entry_points.queries()) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in entry_points.queries()


def test_stages_take_effect(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, seen[-1], sf_dir), "test-stage")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        seen.append(out)
    raw, good, single, safe, mixed = seen
    kept = {r.doc_id for r in quality.screen(raw, "doc_id", "source", "text").where("kept").collect()}
    assert Counter(r.doc_id for r in good.collect()) == Counter(kept)
    of = {r.doc_id: r.class_id for r in jaccard.join(good, "doc_id", "text").collect()}
    assert {r.doc_id for r in single.collect()} == set(of.values())
    assert {r.doc_id for r in safe.collect()} == {r.doc_id for r in single.collect()}
    assert secrets.scan(safe, "text").where("size(__base) + size(__added) > 0").count() == 0
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in safe.collect()} and mixed.count() > safe.count()
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, sf_dir)
    assert last.count() == mixed.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == mixed.count()
