"""Keyword top-k that reads only document blocks whose best possible score can enter the list.

Documents are cut into blocks of BLOCK_DOCS neighbours by id. For every term and
block the index keeps the greatest tf and the least length, which bound what
the term can add to any document of the block whatever the corpus averages are
(a negative idf can add at most 0, to a document without the term). A search
adds the bounds up per query and block, scores the FIRST_BLOCKS most promising
blocks of each query in full, and takes its k-th score as threshold; then it
scores the blocks whose bound reaches the threshold, and no others. A query
that finds fewer than k documents above 0 at first has no threshold: all of its
blocks are scored, as documents at or below 0 may be in its list.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sprank.functions.ranking import rank_topk
from sprank.operators import bm25, store
from sprank.operators.bm25 import BM25Index
from sprank.plans.sizing import checked_broadcast
from sprank.session import scratch_path

BLOCK_DOCS = 128   # documents of a block; divides 2^33, so blocks don't cross partitions
WORD_BYTES = 8     # of a word of text, about
FIRST_BLOCKS = 8   # blocks of a query that are scored for its threshold
ROUNDING = 1e-8    # of sums of bounds and of scores ranked by nine places


@dataclass
class BlockIndex:
    """A keyword index whose postings lie by block, with the bounds of every (term, block)."""
    index: BM25Index
    postings: DataFrame  # block, term, doc_id, tf, dl
    bounds: DataFrame    # term, block, most, least, n
    parts: int           # of the work over all postings, by their number


def build(index: BM25Index, path: str, block_docs: int = BLOCK_DOCS) -> BlockIndex:
    """Lay the postings of an index out by document block under ``path``."""
    spark = index.postings.sparkSession
    size = index.stats["n"] * (WORD_BYTES * index.stats["avgdl"] + store.BYTES_PER_DOC)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), store.layout_for(spark, int(size))[0])
    first = index.postings.where(F.col("first")).select("doc_id")
    (first.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
     .withColumn("block", F.floor(F.monotonically_increasing_id() / block_docs).cast("long")).write.parquet(os.path.join(path, "blocks")))
    blocks = spark.read.parquet(os.path.join(path, "blocks"))
    rows = index.postings.where(~F.col("first")).select("doc_id", "term", "tf", "dl").join(blocks, "doc_id")
    rows.repartition(parts, "block").sortWithinPartitions("term", "block").write.parquet(os.path.join(path, "postings"))
    postings = spark.read.parquet(os.path.join(path, "postings"))
    # Dealt by hand: the number of partitions that Spark would choose does not follow the corpus.
    dealt = postings.select("term", "block", "tf", "dl").repartition(parts, "term", "block")
    bounds = dealt.groupBy("term", "block").agg(F.max("tf").alias("most"), F.min("dl").alias("least"), F.count(F.lit(1)).alias("n"))
    bounds.sortWithinPartitions("term").write.parquet(os.path.join(path, "bounds"))
    return BlockIndex(index, postings, spark.read.parquet(os.path.join(path, "bounds")), parts)


def _share(index: BM25Index, tf: str, dl: str):
    """What tf occurrences in a document of dl tokens are worth, times idf."""
    norm = F.lit(index.k1) * (F.lit(1 - index.b) + F.lit(index.b) * F.col(dl) / F.col("avgdl"))
    return F.col(tf) * F.lit(index.k1 + 1) / (F.col(tf) + norm)


def _scored(blocked: BlockIndex, terms: DataFrame, chosen: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of the documents in the chosen (qid, block)."""
    asked = terms.select("qid", "term", "qtf", "idf", "avgdl").join(chosen.select("qid", "block"), "qid")
    asked, _ = checked_broadcast(asked, what="terms of blocks")
    hits = blocked.postings.join(asked, ["term", "block"])
    return hits.select("qid", "doc_id", (F.col("qtf") * F.col("idf") * _share(blocked.index, "tf", "dl")).alias("c")) \
        .groupBy("qid", "doc_id").agg(F.sum("c").alias("score"))


def _best(blocked: BlockIndex, terms: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score): the ``k`` best documents of each query in its chosen (qid, block).

    A posting is dealt by its block, once, whatever number of queries chose that block.
    """
    shared, words, queries = bm25._shared_terms(terms)
    asked = chosen.join(F.broadcast(queries), "qid").groupBy("block").agg(F.collect_list("q").alias("asked"))
    hits = blocked.postings.join(F.broadcast(words), "term").select("block", "doc_id", "t", "tf", "dl")
    docs = hits.repartition(blocked.parts, "block").groupBy("block", "doc_id").agg(bm25._hits())
    docs = docs.join(asked.repartition(blocked.parts, "block"), "block").select("doc_id", "hits", "asked")
    best = bm25._best_documents(docs, blocked.index, shared, terms.schema["qid"], max(k, 1))
    return rank_topk(best, "qid", "score", "doc_id", k, "_r").drop("_r")


def chosen_blocks(blocked: BlockIndex, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((qid, block, bound, n) of all blocks with a term of the query, those that can hold one of its k best)."""
    spark = blocked.postings.sparkSession
    add = F.greatest(F.col("qtf") * F.col("idf"), F.lit(0.0)) * _share(blocked.index, "most", "least")
    found = (blocked.bounds.join(checked_broadcast(terms, what="query terms")[0], "term")
             .groupBy("qid", "block").agg(F.sum(add).alias("bound"), F.sum("n").alias("n")))
    path = scratch_path(spark, "bounds")  # read three times; grows with queries x blocks
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    w = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
    first = found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= FIRST_BLOCKS)
    best = _best(blocked, terms, first, k).where("score > 0")
    least = best.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    least, _ = checked_broadcast(least, what="thresholds")
    chosen = found.join(least, "qid", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - ROUNDING))
    return found, chosen.select("qid", "block", "bound", "n")


def topk(blocked: BlockIndex, queries: DataFrame, k: int, qid_col: str = "qid", query_col: str = "query", rank_col: str = "rank") -> DataFrame:
    """The rows of ``bm25_topk``: documents that match nothing score 0 and fill a short list, the smallest ids first."""
    if k < 0:
        raise ValueError("k must be >= 0")
    index = blocked.index
    qids = queries.select(F.col(qid_col).alias("qid")).distinct()
    tops, matched = [], []
    for qt in bm25._query_blocks(queries, qid_col, query_col):
        terms = bm25._weighted_terms(index, qt)[0].select("qid", "term", "qtf", "idf", "avgdl")
        chosen = chosen_blocks(blocked, terms, max(k, 1))[1]
        tops.append(_best(blocked, terms, chosen, k))
        if index.stats["eps"] < 0:
            matched.append(_scored(blocked, terms, chosen).select("qid", "doc_id"))
    # A query with a threshold has k documents above 0, which what fills the list can't displace.
    fill = bm25._unmatched(index, qids, bm25._union(matched) if matched else None, k).select("qid", "doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("m"))
    best = bm25._union(tops).withColumn("m", F.lit(True)).unionByName(fill).groupBy("qid", "doc_id").agg(F.max_by("score", "m").alias("score"))
    return rank_topk(best, "qid", "score", "doc_id", k, rank_col)
