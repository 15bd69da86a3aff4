"""Inputs of the registered queries, derived from the given tables only.

Conventions (the same in the oracle SQL):

* corpus: ``documents`` (doc_id, text), every row, whole texts;
* queries: every ``benchmark`` row, qid = item_id, query = the whole text,
  query vector = ``embeddings`` row with vec_id = item_id (NULL if none,
  which gives an empty dense list);
* dense corpus: every ``embeddings`` row (vec_id = doc_id by convention);
* conversations: conv_id = qid.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprank.operators import bm25
from sprank.operators.fusion import HybridIndex
from sprank.plans.sizing import checked_broadcast

# Fixed parameters of the registered search queries.
TOP_K = 5
ALPHA = 0.6
LIST_K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def query_table(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    q = b.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    # Queries are the small side: stream the vectors through a broadcast of the
    # query ids, then attach the few found vectors (NULL when absent).
    ids, _ = checked_broadcast(q.select(F.col("qid").alias("vec_id")), what="query ids")
    e = (table(spark, sf_dir, "embeddings").join(ids, "vec_id")
         .select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_emb")))
    # Bounded (its ids passed the size check) and read by several branches of
    # every search plan: materialise it once.
    from sprank.session import checkpoint_small
    return checkpoint_small(q.join(e, "qid", "left"))


def content_table(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))


def bm25_index(spark, sf_dir) -> bm25.BM25Index:
    """Keyword index of the documents for searching: built once per input
    (path, size, mtime) and parameters, and stored under the shared folder;
    later searches load it, as a search service keeps its index."""
    from sprank.operators import store
    from sprank.session import shared_dir
    root = os.path.join(shared_dir(spark), "sprank-index")
    src = f"{sf_dir.rstrip('/')}/documents.parquet"
    return store.build_or_load(spark, root, src, lambda buckets: bm25.build_postings(
        documents(spark, sf_dir), "doc_id", "text", num_partitions=buckets), texts=documents(spark, sf_dir))


def new_chunk_index(spark, chunks: DataFrame, size: int) -> bm25.BM25Index:
    """An index of ``chunks`` (chunk_id, chunk), whose texts have about ``size`` bytes, stored in a fresh folder."""
    from sprank.operators import store
    from sprank.session import scratch_path
    path = scratch_path(spark, "chunk-index")
    buckets, parts = store.layout_for(spark, size)
    store.save_postings(bm25.build_postings(chunks.select("chunk_id", "chunk"), "chunk_id", "chunk", num_partitions=buckets), path, buckets, parts)
    return store.load_index(spark, path)


def new_bm25_index(spark, sf_dir, docs: DataFrame) -> tuple[bm25.BM25Index, str]:
    """An index of ``docs`` stored in a fresh folder, and that folder."""
    from sprank.operators import store
    from sprank.session import scratch_path
    path = scratch_path(spark, "index")
    buckets, parts = store.layout_for(spark, store.text_size(docs))
    store.save_postings(bm25.build_postings(docs, "doc_id", "text", num_partitions=buckets), path, buckets, parts)
    return store.load_index(spark, path), path


def new_segmented_index(spark, sf_dir, batches: list[DataFrame]):
    """An index to which the batches (doc_id, text) are appended one after the other, in a fresh folder."""
    from sprank.operators import segments, store
    from sprank.session import scratch_path
    path = scratch_path(spark, "segments")
    # Parts are the same for all segments; buckets follow the size of each batch.
    _, parts = store.layout_for(spark, store.text_size(documents(spark, sf_dir)))
    for docs in batches:
        index = segments.append(spark, path, docs, term_parts=parts)
    return index


def hybrid_index(spark, sf_dir) -> HybridIndex:
    return HybridIndex(bm25=bm25_index(spark, sf_dir),
                       vectors=table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
