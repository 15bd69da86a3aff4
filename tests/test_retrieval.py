"""BM25, dense, min-max, fusion: golden values of the three-document fixture."""

import math

import pytest

from sprank.operators import bm25, dense, fusion
from sprank.operators.fusion import HybridIndex

DOCS = [(1, "machine learning is awesome"),
        (2, "artificial intelligence and deep learning"),
        (3, "natural language processing with transformers")]
VECS = [(1, [0.1, 0.2]), (2, [0.3, 0.4]), (3, [0.5, 0.6])]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return bm25.build_bm25(docs)


def queries(spark, vec=(0.1, 0.2), text="machine learning"):
    return spark.createDataFrame([(0, text, list(vec))], "qid long, query string, q_emb array<float>")


def test_bm25_stats_and_idf(index):
    assert index.stats["n"] == 3
    assert index.stats["avgdl"] == pytest.approx(4.666666666666667)
    terms = {r.term: r.idf for r in index.terms.collect()}
    assert terms["machine"] == pytest.approx(0.5108256237659907)
    assert terms["learning"] == pytest.approx(0.10805926656588266)  # raw negative, replaced
    assert index.stats["avg_idf"] == pytest.approx(0.43223706626353064)


def test_bm25_scores_and_padding(spark, index):
    top = bm25.bm25_topk(index, queries(spark), 5).orderBy("rank").collect()
    assert [r.doc_id for r in top] == [1, 2, 3]
    assert top[0].score == pytest.approx(0.6614036995913151)
    assert top[1].score == pytest.approx(0.10469409909497285)
    assert top[2].score == 0.0


def test_negative_idf_corpus(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")
    idx = bm25.build_bm25(docs)
    assert idx.stats["eps"] < 0
    terms = {r.term: r.idf for r in idx.terms.collect()}
    assert terms["a"] == pytest.approx(-0.13411982603617503)
    assert terms["b"] == 0.0
    top = bm25.bm25_topk(idx, queries(spark, text="a b"), 5).collect()
    assert sorted(r.score for r in top) == pytest.approx([-0.13411982603617503] * 2)


@pytest.mark.parametrize("vec,alpha,want", [
    ((0.1, 0.2), 0.0, {1: 1.0, 2: 0.158291, 3: 0.0}),
    ((0.1, 0.2), 0.6, {1: 1.0, 2: 0.299245, 3: 0.0}),
    ((0.6, 0.5), 0.6, {1: 0.4, 2: 0.569679, 3: 0.6}),
    ((0.6, 0.5), 1.0, {1: 0.0, 2: 0.843938, 3: 1.0}),
])
def test_fused_scores(spark, index, vec, alpha, want):
    vecs = spark.createDataFrame(VECS, "vec_id long, embedding array<float>")
    h = HybridIndex(index, vecs)
    lists = fusion.normalized_lists(h, queries(spark, vec), 10)
    got = {r.doc_id: r.score for r in fusion.fuse(lists, alpha).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-6)


def test_tie_order(spark, index):
    vecs = spark.createDataFrame(VECS, "vec_id long, embedding array<float>")
    res = fusion.hybrid_search(HybridIndex(index, vecs), queries(spark, (0.6, 0.5)), 3, 0.5)
    assert [r.doc_id for r in res.orderBy("rank").collect()] == [2, 1, 3]


def test_zero_query_vector(spark, index):
    vecs = spark.createDataFrame(VECS, "vec_id long, embedding array<float>")
    assert dense.dense_topk(vecs, queries(spark, (0.0, 0.0)), 5).count() == 0
    lists = fusion.normalized_lists(HybridIndex(index, vecs), queries(spark, (0.0, 0.0)), 10)
    got = {r.doc_id: r.score for r in fusion.fuse(lists, 0.5).collect()}
    assert got[1] == pytest.approx(0.5)  # (1 - alpha) * keyword


def test_one_document_corpus(spark):
    docs = spark.createDataFrame([(7, "just one doc")], "doc_id long, text string")
    vecs = spark.createDataFrame([(7, [1.0, 0.0])], "vec_id long, embedding array<float>")
    lists = fusion.normalized_lists(HybridIndex(bm25.build_bm25(docs), vecs),
                                    queries(spark, (1.0, 0.0), "one"), 10)
    assert all(r.norm == 0.0 for r in lists.collect())


def _brute(vecs, qs, k):
    import numpy as np
    v = np.array([x for _, x in vecs], np.float32).astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
    out = set()
    for qid, q in qs:
        q = np.array(q, np.float32).astype(float)
        sc = [(-round(float(s), 9), i) for s, (i, _) in zip(v @ (q / np.linalg.norm(q)), vecs)]
        out |= {(qid, i, r + 1, -s) for r, (s, i) in enumerate(sorted(sc)[:k])}
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("dealt", [False, True])
def test_dense_topk_exact(spark, monkeypatch, kind, dealt):
    """Numeric and string ids, with ties, broadcast queries and (forced) dealt-out blocks."""
    import random
    rnd = random.Random(3)
    rows = [(i if kind == "long" else f"d_{i}", [float(rnd.randint(-2, 2)) for _ in range(4)]) for i in range(300)]
    qs = [(j, [rnd.uniform(-1, 1) for _ in range(4)]) for j in range(30)]
    vecs = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<float>")
    q = spark.createDataFrame([(j, "", v) for j, v in qs] + [(99, "", None), (98, "", [0.0] * 4)], "qid long, query string, q_emb array<float>")
    if dealt:
        monkeypatch.setattr(dense, "MAX_QUERY_FLOATS", 12)
        monkeypatch.setattr(dense, "SLOT_ROWS", 70)
        monkeypatch.setattr(dense, "GROUP_QUERIES", 8)
    got = dense.dense_topk(vecs, q, 7)
    assert dict(got.dtypes)["doc_id"] == dict(vecs.dtypes)["vec_id"]
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.qid, r.doc_id, r["rank"], round(r.score, 9)) for r in got.collect()} == _brute(rows, qs, 7)
    assert dense.dense_scores(vecs, q).count() == 300 * 30


def test_append_equals_rebuild(spark):
    from sprank.operators.index import append_postings
    docs = spark.createDataFrame(DOCS + [(4, "deep learning again"), (1, "machine learning is awesome")],
                                 "doc_id long, text string").dropDuplicates(["doc_id"])
    a = bm25.build_postings(docs.where("doc_id <= 2"))
    b = bm25.build_postings(docs.where("doc_id > 2"))
    full = bm25.build_bm25(docs)
    app = bm25.index_from_postings(append_postings(a, b))
    assert app.stats == pytest.approx(full.stats)
    assert sorted(app.terms.collect()) == sorted(full.terms.collect())


def test_saved_index_matches_and_needs_no_exchange(spark, index, tmp_path):
    from sprank.operators import store
    path = str(tmp_path / "idx")
    store.save_index(index, path, buckets=4)
    loaded = store.load_index(spark, path)
    assert loaded.stats == pytest.approx(index.stats)
    q = queries(spark)
    a = sorted(tuple(r) for r in bm25.bm25_topk(index, q, 5).collect())
    b = sorted(tuple(r) for r in bm25.bm25_topk(loaded, q, 5).collect())
    assert a == b
    plan = bm25.bm25_scores(loaded, q)._jdf.queryExecution().executedPlan().toString()
    # exchanges only on the small query side; none keyed by doc_id (postings
    # are read bucketed, and the (qid, doc_id) sum runs inside the buckets)
    import re
    assert not re.search(r"hashpartitioning\((qid#\d+L?, )?doc_id", plan)


def test_negative_eps_corpus_of_templates(spark, monkeypatch):
    """Mean idf below zero: unmatched ids rank above negative scores, found slot by slot."""
    import rank_reference
    monkeypatch.setattr(bm25, "SLOT_DOCS", 7)
    docs = [(i, f"This document is about big data topic {'alpha beta gamma'.split()[i % 3]}") for i in range(40)] + [(40, "other words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    idx = bm25.build_bm25(df)
    assert idx.stats["eps"] < 0
    texts = ["big data", "This document", "alpha", "none", "other"]
    q = spark.createDataFrame(list(enumerate(texts)), "qid long, query string")
    top = bm25.bm25_topk(idx, q, 6)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    want = rank_reference.topk(docs, {r.qid: r.query for r in q.collect()}, 6)
    got = {}
    for r in top.collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.doc_id, round(r.score, 9))
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == want


def test_query_blocks_give_the_same_scores(spark, index, monkeypatch):
    q = queries(spark)
    whole = sorted(tuple(r) for r in bm25.bm25_topk(index, q, 5).collect())
    monkeypatch.setattr(bm25, "MAX_BLOCK_BYTES", 40)
    assert sorted(tuple(r) for r in bm25.bm25_topk(index, q, 5).collect()) == whole


def test_stored_index_is_pruned_by_term(spark, tmp_path):
    from sprank.operators import store
    docs = spark.createDataFrame([(f"d_{i}", f"word{i} common word{i % 7}") for i in range(60)], "doc_id string, text string")
    built = bm25.build_bm25(docs)
    store.save_index(built, str(tmp_path / "i"), buckets=3, term_parts=4)
    loaded = store.load_index(spark, str(tmp_path / "i"))
    assert dict(loaded.postings.dtypes)["doc_id"] == "string"
    q = spark.createDataFrame([(0, "word3"), (1, "nothing")], "qid long, query string")
    assert sorted(tuple(r) for r in bm25.bm25_topk(loaded, q, 5).collect()) == sorted(tuple(r) for r in bm25.bm25_topk(built, q, 5).collect())
    plan = bm25.bm25_scores(loaded, q)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "postings" in x]
    assert len(scans) == 1 and "PartitionFilters: [" in scans[0] and "tb" in scans[0] and "In(term" in scans[0].replace("EqualTo(term", "In(term")


def test_append_to_stored_index(spark, tmp_path):
    """Ids in both batches are replaced; string ids; the result equals a rebuild."""
    from sprank.operators import store
    old = [(f"d_{i}", f"old text {i} shared") for i in range(12)]
    new = [(f"d_{i}", f"new words {i} shared fresh") for i in range(8, 15)]
    schema = "doc_id string, text string"
    path = str(tmp_path / "i")
    store.save_index(bm25.build_bm25(spark.createDataFrame(old, schema)), path, buckets=2, term_parts=2)
    got = store.append_index(spark, path, spark.createDataFrame(new, schema))
    want = bm25.build_bm25(spark.createDataFrame(old[:8] + new, schema))
    assert got.stats == pytest.approx(want.stats)
    counts = [sorted(tuple(r) for r in x.terms.select("term", "df").collect()) for x in (got, want)]
    assert counts[0] == counts[1]
    assert sorted(r.doc_id for r in got.doc_ids.collect()) == sorted(r.doc_id for r in want.doc_ids.collect())


def test_shared_dir_needs_a_setting_on_clusters():
    from types import SimpleNamespace

    from sprank.session import shared_dir
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(fake)


def test_build_or_load_reuses_and_invalidates(spark, tmp_path):
    import os
    import time
    from sprank.operators import store
    src = tmp_path / "docs"
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(src))
    calls = []

    def build(buckets):
        calls.append(1)
        return bm25.build_postings(spark.read.parquet(str(src)), num_partitions=buckets)
    root = str(tmp_path / "indexes")
    a = store.build_or_load(spark, root, str(src), build, buckets=2)
    b = store.build_or_load(spark, root, str(src), build, buckets=2)
    assert len(calls) == 1 and a.stats == b.stats
    time.sleep(1.1)  # a changed input (new mtime and size) gets a new index
    spark.createDataFrame([(9, "extra doc")], "doc_id long, text string").write.mode("append").parquet(str(src))
    c = store.build_or_load(spark, root, str(src), build, buckets=2)
    assert len(calls) == 2 and c.stats["n"] == 4
    assert len(os.listdir(root)) == 2
