"""The search request pipeline for a table of queries.

queries (qid, query, q_emb) -> hybrid candidates -> content -> rerank or cut
-> per-query response. The service's single request becomes a batch: every
step is a DataFrame operator, and only queries x k rows move between steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprank.functions.ranking import OUT_DIGITS
from sprank.operators import rerank as rr
from sprank.operators.fusion import HybridIndex, hybrid_search
from sprank.plans.sizing import checked_broadcast
from sprank.session import checkpoint_small


# Up to so many ids are also pushed into the scan of the large side.
MAX_PUSHED_IDS = 1000


def _rows_of(frame: DataFrame, hits: DataFrame, id_col: str) -> DataFrame:
    """Rows of a large table whose id occurs in the (bounded) hits: the ids are
    broadcast behind a size check; few ids also go into the scan, so that row
    groups without them are not read."""
    ids = hits.select(id_col).distinct()
    few = [r[0] for r in ids.limit(MAX_PUSHED_IDS + 1).collect()]
    if len(few) <= MAX_PUSHED_IDS:
        frame = frame.where(F.col(id_col).isin(few))
    return frame.join(checked_broadcast(ids, what="hit ids")[0], id_col)


def with_content(hits: DataFrame, content: DataFrame, id_col: str = "doc_id",
                 content_col: str = "content") -> DataFrame:
    """Attach content by id; unknown ids get ''. The corpus streams past the hit
    ids, and the few matched rows are joined back to the hits; these are used
    twice, so they are checkpointed once (they are bounded by queries x k)."""
    hits = checkpoint_small(hits)
    found = _rows_of(content.select(F.col(id_col), F.col(content_col).alias("content")), hits, id_col)
    return (hits.join(found, id_col, "left")
                .withColumn("content", F.coalesce(F.col("content"), F.lit(""))))


def with_title(hits: DataFrame, titles: DataFrame, id_col: str = "doc_id",
               title_col: str = "title") -> DataFrame:
    """Attach a title by source id; falls back to the id itself."""
    hits = checkpoint_small(hits)
    found = _rows_of(titles.select(F.col(id_col), F.col(title_col).alias("title")), hits, id_col)
    return (hits.join(found, id_col, "left")
                .withColumn("title", F.coalesce(F.col("title"), F.col(id_col).cast("string"))))


def in_pool(hits: DataFrame, pool: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Keep hits whose id is in ``pool``: the pool, which may be as large as the
    corpus, streams past the hit ids."""
    hits = checkpoint_small(hits)
    found = _rows_of(pool.select(id_col), hits, id_col).distinct()
    return hits.join(found, id_col, "left_semi")


def candidates(index: HybridIndex, queries: DataFrame, content: DataFrame, top_k: int = 5,
               alpha: float = 0.6) -> DataFrame:
    """What the service reranks: hybrid search for 2 * top_k (lists of 4 * top_k),
    with content and the query text. Columns (qid, rank, doc_id, score, content, query)."""
    hits = hybrid_search(index, queries, 2 * top_k, alpha)
    hits = with_content(hits, content)
    return hits.join(queries.select("qid", "query"), "qid")


def search(index: HybridIndex, queries: DataFrame, content: DataFrame, top_k: int = 5,
           alpha: float = 0.6, rerank: bool = True, scorer: str = "overlap") -> DataFrame:
    """Results (qid, rank, doc_id, content, score, rerank_score) per query."""
    c = candidates(index, queries, content, top_k, alpha)
    if rerank:
        r = rr.rerank(c, top_k, scorer)
        return r.select("qid", F.col("rerank_rank").alias("rank"), "doc_id", "content",
                        "score", "rerank_score", "query")
    return (c.where(F.col("rank") <= top_k)
             .select("qid", "rank", "doc_id", "content", "score",
                     F.lit(None).cast("double").alias("rerank_score"), "query"))


def effective_score():
    """Rerank score when present, else the hybrid score."""
    return F.coalesce(F.col("rerank_score"), F.col("score"))


def score_percent(results: DataFrame) -> DataFrame:
    """Bar width: min(100, s / max(max s of the result set, 0.001) * 100), 1 decimal."""
    from pyspark.sql import Window
    mx = F.greatest(F.max(effective_score()).over(Window.partitionBy("qid")), F.lit(0.001))
    return results.withColumn(
        "pct", F.round(F.least(F.lit(100.0), effective_score() / mx * 100.0), 1))


def response(results: DataFrame) -> DataFrame:
    """One row per query: ordered results, total count, top hit, id list."""
    r = F.sort_array(F.collect_list(F.struct(
        "rank", "doc_id", F.round("score", OUT_DIGITS).alias("score"),
        F.round("rerank_score", OUT_DIGITS).alias("rerank_score"))))
    out = results.groupBy("qid").agg(r.alias("results"), F.count(F.lit(1)).alias("total_results"))
    return out.select(
        "qid", "results", "total_results",
        F.col("results")[0]["doc_id"].alias("top_doc_id"),
        F.array_join(F.transform("results", lambda x: x["doc_id"].cast("string")), ",").alias("doc_ids"))
