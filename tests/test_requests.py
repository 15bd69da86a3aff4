"""Mixed requests in one job equal one job per request, with filters before the cut and their own lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sprank.operators import bm25, dense, requests, search
from sprank.operators.fusion import HybridIndex

REQUESTS = "qid long, query string, q_emb array<float>, top_k int, alpha double, rerank boolean, filters map<string,string>"


@pytest.fixture(scope="module", params=[False, True], ids=["rare", "frequent"])
def corpus(request, spark):
    """A corpus whose mean idf is positive, and one of templates, where it is negative."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4 if request.param else 40)]
    docs = [(i, " ".join(rng.choices(words, k=12 if request.param else rng.randint(0, 12))), "en" if i % 3 else "fr", f"s{i % 4}" if i % 5 else None,
             [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, content string, lang string, source string, v array<float>").persist()
    index = HybridIndex(bm25.build_bm25(df, "doc_id", "content"), df.select(F.col("doc_id").alias("vec_id"), F.col("v").alias("embedding")))
    assert (index.bm25.stats["eps"] < 0) == request.param
    return df, index


def rows(df):
    return sorted((r.qid, r.rank, r.doc_id, round(r.score, 9), None if r.rerank_score is None else round(r.rerank_score, 9), r.content) for r in df.collect())


def test_mixed_equal_single(spark, corpus):
    df, index = corpus
    content, attributes = df.select("doc_id", "content"), df.select("doc_id", "lang", "source")
    v = [0.5, -0.5, 0.1, 0.9]
    mixed = [(0, "w1 w2 w2", v, None, None, None, None), (1, "w1 w3", v, 3, 0.0, False, {}), (2, "w0 w2", None, 2, 1.0, True, {"lang": "fr"}),
             (3, "w3 absent", v, 4, 0.3, False, {"lang": "en", "source": "s1"}), (4, "w1", v, 1, 0.5, True, {"lang": "fr"}),
             (5, "w2", v, 0, None, None, None), (6, "", v, 9, 0.7, True, {"source": "s3"}), (7, "w1", [0.0] * 4, 2, 0.7, None, {"lang": "nowhere"}),
             (8, "w1 w2", v, 20, 0.2, False, {"colour": "red"})]
    got = rows(requests.search_requests(index, spark.createDataFrame(mixed, REQUESTS), content, attributes))
    assert {x[0] for x in got} == {0, 1, 2, 3, 4, 6}
    for r in mixed[:2]:  # without filters: what search gives
        q = spark.createDataFrame([r], REQUESTS)
        assert [x for x in got if x[0] == r[0]] == rows(search.search(
            index, q, content, r[3] or 5, 0.6 if r[4] is None else r[4], r[5] is not False))
    singles = [rows(requests.search_requests(index, spark.createDataFrame([r], REQUESTS), content, attributes)) for r in (mixed[2], mixed[3], mixed[6])]
    assert [x for x in got if x[0] in (2, 3, 6)] == [x for s in singles for x in s]
    with pytest.raises(ValueError):
        requests.search_requests(index, spark.createDataFrame(mixed, REQUESTS), content)


def test_filters_come_before_the_cut(spark, corpus):
    """Filtered lists are the head of the whole ranking of matching documents, filled with the smallest of them."""
    df, index = corpus
    v = [0.5, -0.5, 0.1, 0.9]
    asked = requests.prepared(spark.createDataFrame([(1, "w1 w2", v, 3, 0.5, True, {"lang": "fr"}), (2, "w3", v, 3, 0.5, True, {"lang": "en", "source": "s1"})], REQUESTS))
    members = requests.memberships(asked, df.select("doc_id", "lang", "source"))
    allowed = {1: {r.doc_id for r in df.where("lang = 'fr'").collect()}, 2: {r.doc_id for r in df.where("lang = 'en' and source = 's1'").collect()}}
    scores = {(r.qid, r.doc_id): r.score for r in bm25.bm25_scores(index.bm25, asked).collect()}
    near = {(r.qid, r.doc_id): r.score for r in dense.dense_scores(index.vectors, asked).collect()}
    for k in (4, 100):
        for lists, of in ((requests.keyword_lists(index.bm25, asked, members, k), lambda q, d: scores.get((q, d), 0.0)),
                          (requests.dense_lists(index.vectors, asked, members, k, "vec_id", "embedding"), lambda q, d: near[q, d])):
            got = {q: [r.doc_id for r in sorted(lists.where(F.col("qid") == q).collect(), key=lambda r: r.list_rank)] for q in (1, 2)}
            want = {q: sorted(allowed[q], key=lambda d: (-round(of(q, d), 9), d))[:k] for q in (1, 2)}
            assert got == want
