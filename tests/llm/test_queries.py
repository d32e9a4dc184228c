"""Registered queries: SQL where it can say them, and the pipeline as a whole."""

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from docloom.llm.common import stage, table
from docloom.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm.conftest import ROWS
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(E.queries())
    assert set(LLM_QUERIES) <= names and {n.split("_")[0] for n in LLM_QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, name):
    r = compare(spark, name, LLM_QUERIES[name], LLM_ORACLES[name], SF, duck(SF))
    assert r["ok"], r["diff"]


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SF, "documents")
    rows = {}
    for name, apply in P.STAGES:
        out = stage(apply(spark, docs, SF), name)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        rows[name] = out.collect()
        docs = out
    assert len(rows["near_dedup"]) < len(rows["toxicity"])
    assert len(rows["decontamination"]) < len(rows["near_dedup"])
    assert len(rows["secret_scan"]) == len(rows["decontamination"])
    assert all(r.taken == r.copies * r.size and 1 <= r.copies <= 2 for r in rows["source_mixing"])
    final = sorted(map(tuple, E.queries()["pipeline"](spark, SF).collect()), key=repr)
    assert final == sorted(map(tuple, rows["source_mixing"]), key=repr)


def test_pipeline_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    docs = stage(odd_docs, "odd")
    for _, apply in P.STAGES[:4]:
        docs = stage(apply(spark, docs, SF), "odd")
        assert docs.columns == odd_docs.columns
    assert docs.count() == len(ROWS) - 3                   # one of four rows of one text stays, nothing else goes
    assert P.STAGES[4][1](spark, docs, SF).count() > 0
    for _, apply in P.STAGES:
        assert apply(spark, no_docs, SF).count() == 0
