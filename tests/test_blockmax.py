"""Block-max top-k equals the exhaustive one and reads less where terms are frequent."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sprank.operators import blockmax, bm25

Q = [(0, "common rare3"), (1, "common"), (2, "rare1 rare1 common absent"), (3, ""), (4, "absent"), (5, "t1 t2 t3"), (6, "rare2")]


def rows(df):
    return sorted((r.qid, r.rank, r.doc_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("kind", ["rare", "templates", "few"])
def test_equal_to_exhaustive(spark, tmp_path, kind):
    """Corpora of rare and of frequent terms (negative idf), and one of fewer documents than k."""
    rng = random.Random(6)
    words = [f"t{i}" for i in range(5 if kind == "templates" else 80)]
    docs = [(f"d{i:04d}", " ".join(["common"] * rng.randint(1 if kind == "templates" else 0, 3) + rng.choices(words, k=rng.randint(8 if kind == "templates" else 0, 20)) + (
        [f"rare{i % 7}"] if i % 41 == 0 and kind != "templates" else []))) for i in range(6 if kind == "few" else 500)]
    index = bm25.build_bm25(spark.createDataFrame(docs, "doc_id string, text string"))
    assert (index.stats["eps"] < 0) == (kind == "templates") or kind == "few"
    q = spark.createDataFrame(Q, "qid long, query string")
    blocked = blockmax.build(index, str(tmp_path / "b"), 16)
    for k in (1, 10):
        assert rows(blockmax.topk(blocked, q, k)) == rows(bm25.bm25_topk(index, q, k))


def test_frequent_terms_are_skipped(spark, tmp_path):
    """A frequent term beside a rare one is read in few blocks only."""
    n = 8000
    rare = F.when(F.col("id").between(4000, 4020), F.lit(" rare rare rare")).otherwise(F.lit(""))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 3 > 0, F.lit("common ")).otherwise(F.lit("")), F.lit("w"),
                                                                         F.pmod(F.xxhash64("id"), F.lit(3000)).cast("string"), rare).alias("text"))
    blocked = blockmax.build(bm25.build_bm25(docs), str(tmp_path / "b"))
    q = spark.createDataFrame([(0, "common rare")], "qid long, query string")
    terms = bm25._weighted_terms(blocked.index, bm25.query_terms(q))[0]
    found, chosen = [x.agg(F.count("block"), F.sum("n")).first() for x in blockmax.chosen_blocks(blocked, terms, 10)]
    assert found[0] > 60 and found[1] > 5000 and chosen[0] <= 2 and chosen[1] < found[1] / 20
    assert rows(blockmax.topk(blocked, q, 10)) == rows(bm25.bm25_topk(blocked.index, q, 10))
