"""The driver's contract."""

import pytest

import __spark_entry__ as entry
from corpuscle.plans import queries as plans


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {n for n in plans.QUERIES if n not in plans.SQL} == {"leiden_communities"}


@pytest.mark.parametrize("name", ["chunk_documents", "document_parse", "vector_topk_batch", "reduce_context", "eval_summary", "claim_comparison", "cost_estimate"])
def test_same_as_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark", "orders"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = plans.QUERIES[name](spark, sf)
    want = c.sql(plans.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    shown = lambda rows: sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert shown(df.select(*columns).collect()) == shown(want.select(*(f'"{x}"' for x in columns)).fetchall())


def test_plans(spark, sf):
    plan = lambda df: df._jdf.queryExecution().toString()
    for name in ("relationship_edges", "criterion_results", "gleaning_merge", "pending_chunks"):
        shown = plan(plans.QUERIES[name](spark, sf))
        assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown
    pruned = plan(plans.QUERIES["chat_message_tokens"](spark, sf))
    assert "ReadSchema: struct<conv_id:bigint,role:string,text:string>" in pruned
