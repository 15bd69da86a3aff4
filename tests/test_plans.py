"""Physical-plan properties that matter at scale (checked on sf0.001 plans)."""

import re

import pytest

from conftest import SF001


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def Q():
    import __spark_entry__ as E
    return E.queries()


def test_chunking_never_shuffles(spark, Q):
    for name in ("chunk_words", "chunk_chars", "chunk_summary", "ingest_rejects"):
        assert "Exchange" not in plan_of(Q[name](spark, SF001)), name


def test_bm25_no_term_shuffle_and_partial_topk(spark, Q):
    p = plan_of(Q["bm25_topk"](spark, SF001))
    # postings never move by term: exchanges by term only carry pre-aggregated
    # query-side rows (distinct query terms, partial df counts)
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\(term", line):
            assert "HashAggregate(keys=[term" in lines[i + 1], lines[i:i + 2]
    assert not re.search(r"hashpartitioning\(qid#\d+L?, doc_id", p)  # no shuffle of matched pairs
    assert p.count("WindowGroupLimit") >= 2                     # partial limit before the qid shuffle


def test_dense_is_blockwise(spark, Q):
    p = plan_of(Q["dense_topk"](spark, SF001))
    assert "MapInArrow" in p and "WindowGroupLimit" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_metrics_partial_aggregation(spark, Q):
    for name in ("metric_counters", "metric_histogram", "latency_percentiles"):
        p = plan_of(Q[name](spark, SF001))
        assert re.search(r"partial_(count|sum|percentile)", p), name


def test_last_messages_limited_before_shuffle(spark, Q):
    assert plan_of(Q["history_last10"](spark, SF001)).count("WindowGroupLimit") >= 2
