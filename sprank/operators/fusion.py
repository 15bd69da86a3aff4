"""Hybrid retrieval: min-max normalisation and weighted fusion of a keyword
list and a dense list per query.

Both lists are small (queries x 2k rows), so the full outer join that unions
their ids is cheap whatever the corpus size; all corpus-sized work happens in
the list builders (``bm25.bm25_topk``, ``dense.dense_topk``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprank.functions.ranking import minmax, rank_topk
from sprank.functions.text import mode_label
from sprank.operators import bm25 as bm25_ops
from sprank.operators import dense as dense_ops

# Defaults of the reference's search call and its alpha sweep.
DEFAULT_TOP_K = 10
DEFAULT_ALPHA = 0.5
SWEEP_ALPHAS = (0.0, 0.3, 0.5, 0.7, 1.0)


@dataclass
class HybridIndex:
    """Keyword index over (doc_id, text) plus dense vectors (vec_id, embedding)."""
    bm25: bm25_ops.BM25Index
    vectors: DataFrame | None
    vec_id: str = "vec_id"
    vec_col: str = "embedding"


def normalized_lists(index: HybridIndex, queries: DataFrame, k_list: int,
                     qid_col: str = "qid", query_col: str = "query",
                     qvec_col: str = "q_emb") -> DataFrame:
    """(qid, list, doc_id, raw, norm, list_rank) for the 'dense' and 'sparse' lists
    of length ``min(k_list, N)``, each min-max normalised per query."""
    sparse = (bm25_ops.bm25_topk(index.bm25, queries, k_list, qid_col, query_col, "list_rank")
              .select("qid", "doc_id", F.col("score").alias("raw"), "list_rank")
              .withColumn("list", F.lit("sparse")))
    parts = [sparse]
    if index.vectors is not None:
        dense = (dense_ops.dense_topk(index.vectors, queries, k_list, index.vec_id, index.vec_col,
                                      qid_col, qvec_col, "list_rank")
                 .select("qid", "doc_id", F.col("score").alias("raw"), "list_rank")
                 .withColumn("list", F.lit("dense")))
        parts.append(dense)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return minmax(both, ["qid", "list"], "raw", "norm")


def fuse(lists: DataFrame, alpha) -> DataFrame:
    """(qid, doc_id, dense, sparse, score): id union of both lists, a missing
    side counts 0, score = alpha * dense + (1 - alpha) * sparse.
    ``alpha`` is a number or a column of ``lists`` (alpha sweep)."""
    a = F.col(alpha) if isinstance(alpha, str) else F.lit(float(alpha))
    keys = ["qid", "doc_id"] + ([alpha] if isinstance(alpha, str) else [])
    # Pivot instead of a self full-outer join: one small shuffle by key.
    wide = lists.groupBy(*keys).agg(
        F.max(F.when(F.col("list") == "dense", F.col("norm"))).alias("dense"),
        F.max(F.when(F.col("list") == "sparse", F.col("norm"))).alias("sparse"))
    wide = (wide.withColumn("dense", F.coalesce(F.col("dense"), F.lit(0.0)))
                .withColumn("sparse", F.coalesce(F.col("sparse"), F.lit(0.0))))
    return wide.withColumn("score", a * F.col("dense") + (F.lit(1.0) - a) * F.col("sparse"))


def hybrid_search(index: HybridIndex, queries: DataFrame, top_k: int = DEFAULT_TOP_K,
                  alpha: float = DEFAULT_ALPHA, qid_col: str = "qid", query_col: str = "query",
                  qvec_col: str = "q_emb") -> DataFrame:
    """First ``top_k`` fused hits per query; each list has ``2 * top_k`` entries.
    Output (qid, rank, doc_id, score, dense, sparse)."""
    if top_k < 0:
        raise ValueError("top_k must be >= 0")
    lists = normalized_lists(index, queries, 2 * top_k, qid_col, query_col, qvec_col)
    fused = fuse(lists, alpha)
    return rank_topk(fused, "qid", "score", "doc_id", top_k)


def alpha_sweep(index: HybridIndex, queries: DataFrame, top_k: int = 5,
                alphas=SWEEP_ALPHAS, qid_col: str = "qid", query_col: str = "query",
                qvec_col: str = "q_emb") -> DataFrame:
    """Top hit per (query, alpha); the two lists are computed once and each row
    is repeated for the few alpha values by ``explode`` (no join)."""
    lists = normalized_lists(index, queries, 2 * top_k, qid_col, query_col, qvec_col)
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    fused = fuse(lists.withColumn("alpha", F.explode(grid)), "alpha")
    top = rank_topk(fused, ["qid", "alpha"], "score", "doc_id", 1)
    return top.select("qid", "alpha", "doc_id", "score", mode_label("alpha").alias("mode"))
