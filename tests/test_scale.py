"""What a task holds does not grow with the corpus: layouts by size, top-k in blocks."""

import re

import numpy as np
import pytest

from sprank.functions.ranking import rank_topk
from sprank.operators import bm25, segments, store


def rows(df):
    return sorted((str(r[0]), str(r[1]), round(r.score, 9)) for r in df.select("qid", "doc_id", "score").collect())


@pytest.mark.parametrize("cells", [bm25.MAX_CELLS, 40])
def test_block_best_is_the_top_of_all_scores(spark, monkeypatch, cells):
    monkeypatch.setattr(bm25, "MAX_CELLS", cells)
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.5, n) % 60)
    docs = [(i if i else None, word(int(rng.integers(0, 30)))) for i in range(150)] + [(i, word(9)) for i in range(5)] + [(None, "w1 w2 w3")]
    docs += [(1000 + i, "same words of copies w1") for i in range(30)]
    asked = [(i if i else None, word(6)) for i in range(12)] + [(3, "w1 w1 w2"), (90, "unknown"), (91, ""), (92, None), (93, "copies of")]
    index = bm25.build_bm25(spark.createDataFrame(docs, "doc_id long, text string"))
    q = spark.createDataFrame(asked, "qid long, query string")
    qt = bm25.query_terms(q)
    for k in (1, 7, 500):
        want = rank_topk(bm25.bm25_scores(index, q), "qid", "score", "doc_id", k)
        got = bm25._block_best(index, *bm25._weighted_terms(index, qt), k)
        assert rows(rank_topk(got, "qid", "score", "doc_id", k)) == rows(want)


def test_top_search_joins_a_posting_once(spark):
    """A posting that many queries ask for is one row, not one a query."""
    index = bm25.build_bm25(spark.createDataFrame([(i, "common words") for i in range(50)], "doc_id long, text string"))
    q = spark.createDataFrame([(i, "common words") for i in range(40)], "qid long, query string")
    top = bm25.bm25_topk(index, q, 3)
    assert [r.doc_id for r in top.where("qid = 7").orderBy("rank").collect()] == [0, 1, 2]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert not re.search(r"keys=\[qid#\d+L?, doc_id#\d+L?\], functions=\[(partial_)?sum", plan)


def test_layout_follows_the_texts(spark, tmp_path, monkeypatch):
    """Texts that compress to next to nothing count in full, in a stored index and in every appended batch."""
    monkeypatch.setattr(store, "BYTES_PER_BUCKET", 40_000)
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(500)], "doc_id long, text string")
    path = str(tmp_path / "docs")
    docs.coalesce(1).write.parquet(path)
    assert store.input_size(spark, path)[0] < 40_000
    least = 500 * 1000 // 40_000
    index = store.build_or_load(spark, str(tmp_path / "root"), path, lambda n: bm25.build_postings(docs, num_partitions=n), texts=docs)
    assert index.partitions > least
    assert segments.append(spark, str(tmp_path / "s"), docs).segments[0].partitions > least
    assert store.text_size(spark.createDataFrame([(1, None), (2, "é")], "doc_id long, text string")) == 2 * store.BYTES_PER_DOC + 2


def test_chunk_index_follows_the_chunks(spark, monkeypatch):
    from sprank.plans import inputs
    monkeypatch.setattr(store, "BYTES_PER_BUCKET", 20_000)
    chunks = spark.createDataFrame([(f"{i}_0", f"word w{i % 7}") for i in range(800)], "chunk_id string, chunk string")
    index = inputs.new_chunk_index(spark, chunks, store.text_size(chunks, "chunk"))
    assert index.partitions >= 800 * 512 // 20_000
    top = bm25.bm25_topk(index, spark.createDataFrame([(1, "w3")], "qid long, query string"), 2).orderBy("rank").collect()
    assert [r.doc_id for r in top] == ["101_0", "108_0"]


def test_blocks_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """Postings of blocks lie in as many files as the corpus asks for, whatever the session's shuffle partitions are."""
    from sprank.operators import blockmax
    monkeypatch.setattr(store, "BYTES_PER_BUCKET", 20_000)
    docs = spark.createDataFrame([(i, f"word w{i % 7} w{i % 11}") for i in range(700)], "doc_id long, text string")
    index = bm25.build_bm25(docs)
    blocked = blockmax.build(index, str(tmp_path / "b"), block_docs=4)
    assert blocked.parts >= 700 * 512 // 20_000 > 8
    assert len(blocked.postings.inputFiles()) > 8
    q = spark.createDataFrame([(1, "w1 w2 word"), (2, "w3"), (3, "none")], "qid long, query string")
    assert rows(blockmax.topk(blocked, q, 9)) == rows(bm25.bm25_topk(index, q, 9))
