"""Registered queries: one per operator of the inventory, each reading the
given tables (whole tables, whole texts) and returning a DataFrame.

Every callable takes (spark, sf_dir). Column names equal those of the
matching SQL in ``sprank.plans.oracle``; floating outputs are rounded to 6
places after ranking on values rounded to 9.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprank.functions import text as tx
from sprank.functions.ranking import OUT_DIGITS
from sprank.operators import blockmax, bm25, cells, chunking, context, dense, fusion, metrics, requests, rerank, store
from sprank.operators import search as srch
from sprank.plans import inputs as I
from sprank.session import scratch_path
from sprank.sources import files

Query = Callable[[SparkSession, str], DataFrame]
R = OUT_DIGITS


def _r(c, name=None):
    return F.round(F.col(c), R).alias(name or c)


# ---------------------------------------------------------------- projections

def doc_word_count(spark, d):
    return I.documents(spark, d).select("doc_id", tx.word_count("text").cast("bigint").alias("word_count"))


def doc_char_count(spark, d):
    return I.documents(spark, d).select("doc_id", tx.char_count("text").cast("bigint").alias("char_count"))


def doc_clean(spark, d):
    return I.documents(spark, d).select("doc_id", tx.clean("text").alias("clean"))


def doc_sentence_count(spark, d):
    return I.documents(spark, d).select(
        "doc_id", tx.sentence_count(tx.clean("text")).cast("bigint").alias("sentence_count"))


def doc_snippet(spark, d):
    return I.documents(spark, d).select("doc_id", tx.snippet("text", 260).alias("snippet"))


def doc_avg_stats(spark, d):
    return I.documents(spark, d).groupBy("doc_id").agg(F.avg(tx.word_count("text")).alias("avg_words"),
                                                       F.avg(tx.char_count("text")).alias("avg_chars"))


# ---------------------------------------------------------------- chunking

def chunk_words(spark, d):
    return chunking.word_chunks(I.documents(spark, d)).select(
        "doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk_id", "chunk")


def chunk_chars(spark, d):
    return chunking.char_chunks(I.documents(spark, d)).select(
        "doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk_id", "chunk")


def chunk_raw_words(spark, d):
    """Word windows of the text as it is (neither lower-cased nor collapsed), ids in the `_c` style."""
    return chunking.word_chunks(I.documents(spark, d), lower_clean=False, id_style="c").select(
        "doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk_id", "chunk")


def clean_counts(spark, d):
    docs = I.documents(spark, d).withColumn("clean", tx.clean("text"))
    return docs.select("doc_id", tx.word_count("clean").cast("bigint").alias("word_count"),
                       tx.char_count("clean").cast("bigint").alias("char_count"))


def upload_check(spark, d):
    """Uploads named by the pages' URLs, accepted by extension."""
    pages = I.table(spark, d, "pages").select("page_id", F.col("url").alias("filename"))
    return chunking.accept_by_extension(pages, ext="/").select("page_id", "accepted", "reason")


def upload_check_pdf(spark, d):
    """Uploads of documents by the service's own rule: files named .pdf, in any case."""
    ext = F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "fr", ".PDF").otherwise(".txt")
    files = I.documents(spark, d).select("doc_id", F.concat_ws("", "source", F.lit("-"), F.col("doc_id").cast("string"), ext).alias("filename"))
    return chunking.accept_by_extension(files).select("doc_id", "filename", "accepted", "reason")


def chunk_summary(spark, d):
    return chunking.chunk_summary(I.documents(spark, d))


def chunk_source_id(spark, d):
    return chunking.word_chunks(I.documents(spark, d)).select(
        "chunk_id", tx.source_doc_id("chunk_id").alias("source_id"))


def ingest_rejects(spark, d):
    return chunking.ingest_rejects(I.documents(spark, d))


# ---------------------------------------------------------------- vectors

def vec_normalize(spark, d):
    v = dense.vector_stats(I.table(spark, d, "embeddings"))
    return v.select("vec_id", _r("norm"), F.col("dim").cast("bigint").alias("dim"),
                    _r("unit_sum"), _r("unit_sq"))


def dense_scores(spark, d):
    top = dense.dense_scores(I.table(spark, d, "embeddings"), I.query_table(spark, d))
    return top.select("qid", "doc_id", _r("score"))


def dense_topk(spark, d):
    top = dense.dense_topk(I.table(spark, d, "embeddings"), I.query_table(spark, d), I.LIST_K)
    return top.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", _r("score"))


def dense_topk_cells(spark, d):
    """The dense top 10 from a stored index by cells, whose vectors came in two batches with ids in common."""
    path, vecs = scratch_path(spark, "cells"), I.table(spark, d, "embeddings").select("vec_id", "embedding")
    for part in _batches(vecs, "vec_id", "embedding", F.reverse("embedding")):
        cells.append(spark, path, part)
    top = cells.topk(spark, path, I.query_table(spark, d), I.LIST_K)
    return top.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", _r("score"))


# ---------------------------------------------------------------- keyword

def bm25_index(spark, d):
    idx, _ = I.new_bm25_index(spark, d, I.documents(spark, d))
    return idx.terms.select("term", F.col("df").cast("bigint").alias("df"), _r("idf"))


def bm25_scores(spark, d):
    idx = I.bm25_index(spark, d)
    return bm25.bm25_scores(idx, I.query_table(spark, d)).select("qid", "doc_id", _r("score"))


def bm25_topk(spark, d):
    idx = I.bm25_index(spark, d)
    top = bm25.bm25_topk(idx, I.query_table(spark, d), I.LIST_K)
    return top.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", _r("score"))


def bm25_topk_blocks(spark, d):
    """The keyword top 10 from the blocks of documents that can hold it."""
    blocked = blockmax.build(I.bm25_index(spark, d), scratch_path(spark, "blocks"))
    top = blockmax.topk(blocked, I.query_table(spark, d), I.LIST_K)
    return top.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", _r("score"))


def chunk_bm25_topk(spark, d):
    """The reference's own unit of retrieval: BM25 over the word chunks of the
    documents (chunk ids as keys), top 10 per benchmark query."""
    chunks = files.parquet_roundtrip(chunking.word_chunks(I.documents(spark, d)).select("chunk_id", "chunk"), scratch_path(spark, "chunks"))[0]
    top = bm25.bm25_topk(I.new_chunk_index(spark, chunks, store.text_size(chunks, "chunk")), I.query_table(spark, d), I.LIST_K)
    return top.select("qid", F.col("rank").cast("bigint").alias("rank"),
                      F.col("doc_id").alias("chunk_id"), _r("score"))


def _batches(rows, key, body, stale):
    """Two ingest batches with ids in common: the first holds older bodies of every fifth row."""
    old = F.pmod(F.col(key), F.lit(5)) == 0
    first = rows.where(old | (F.pmod(F.col(key), F.lit(2)) == 0)).withColumn(body, F.when(old, stale).otherwise(F.col(body)))
    return first, rows.where(old | (F.pmod(F.col(key), F.lit(2)) != 0))


def index_append(spark, d):
    """A segmented index of a first batch, to which a second one is appended: a
    fifth of the ids occur in both, the later text counts. Equals the index of
    the whole corpus."""
    first, second = _batches(I.documents(spark, d).select("doc_id", "text"), "doc_id", "text",
                             F.concat(F.lit("outdated "), F.col("text")))
    idx = I.new_segmented_index(spark, d, [first, second])
    return idx.terms.select("term", F.col("df").cast("bigint").alias("df"), _r("idf"))


def append_search(spark, d):
    """Keyword top 10 over the segments of two batches."""
    first, second = _batches(I.documents(spark, d).select("doc_id", "text"), "doc_id", "text",
                             F.concat(F.lit("outdated "), F.col("text")))
    top = bm25.bm25_topk(I.new_segmented_index(spark, d, [first, second]), I.query_table(spark, d), I.LIST_K)
    return top.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", _r("score"))


def vectors_append(spark, d):
    """Vectors of a first batch, to which a second one with ids in common is
    appended; top 10 over the result."""
    from sprank.operators.index import append_vectors
    vecs = I.table(spark, d, "embeddings").select("vec_id", "embedding")
    first, second = _batches(vecs, "vec_id", "embedding", F.reverse("embedding"))
    top = dense.dense_topk(append_vectors(first, second), I.query_table(spark, d), I.LIST_K)
    return top.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", _r("score"))


# ---------------------------------------------------------------- hybrid

def minmax_scores(spark, d):
    lists = fusion.normalized_lists(I.hybrid_index(spark, d), I.query_table(spark, d), I.LIST_K)
    return lists.select("qid", "list", F.col("list_rank").cast("bigint").alias("list_rank"),
                        "doc_id", _r("raw"), _r("norm"))


def hybrid_fuse(spark, d):
    lists = fusion.normalized_lists(I.hybrid_index(spark, d), I.query_table(spark, d), I.LIST_K)
    f = fusion.fuse(lists, I.ALPHA)
    return f.select("qid", "doc_id", _r("dense"), _r("sparse"), _r("score"))


def hybrid_search(spark, d):
    h = fusion.hybrid_search(I.hybrid_index(spark, d), I.query_table(spark, d), I.TOP_K, I.ALPHA)
    return h.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", _r("score"))


def search_no_rerank(spark, d):
    res = srch.search(I.hybrid_index(spark, d), I.query_table(spark, d), I.content_table(spark, d),
                      I.TOP_K, I.ALPHA, rerank=False)
    return res.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", _r("score"))


def hits_with_content(spark, d):
    h = fusion.hybrid_search(I.hybrid_index(spark, d), I.query_table(spark, d), I.TOP_K, I.ALPHA)
    h = srch.with_content(h, I.content_table(spark, d))
    return h.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", "content")


def hits_with_title(spark, d):
    h = fusion.hybrid_search(I.hybrid_index(spark, d), I.query_table(spark, d), I.TOP_K, I.ALPHA)
    titles = I.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("title"))
    h = srch.with_title(h, titles)
    return h.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", "title")


def pool_semi(spark, d):
    h = fusion.hybrid_search(I.hybrid_index(spark, d), I.query_table(spark, d), I.TOP_K, I.ALPHA)
    pool = I.table(spark, d, "labels").select("doc_id")
    h = srch.in_pool(h, pool)
    return h.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", _r("score"))


def alpha_sweep(spark, d):
    s = fusion.alpha_sweep(I.hybrid_index(spark, d), I.query_table(spark, d), I.TOP_K)
    return s.select("qid", "alpha", "doc_id", _r("score"), "mode")


def _reranked(spark, d):
    return srch.search(I.hybrid_index(spark, d), I.query_table(spark, d), I.content_table(spark, d),
                       I.TOP_K, I.ALPHA, rerank=True)


def rerank_topk(spark, d):
    r = _reranked(spark, d)
    return r.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", _r("score"),
                    _r("rerank_score"))


def rerank_threshold(spark, d):
    c = srch.candidates(I.hybrid_index(spark, d), I.query_table(spark, d), I.content_table(spark, d),
                        I.TOP_K, I.ALPHA)
    r = rerank.rerank_threshold(c)
    return r.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", _r("score"),
                    _r("rerank_score"))


def score_percent(spark, d):
    r = srch.score_percent(_reranked(spark, d))
    return r.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", "pct")


def search_response(spark, d):
    r = srch.response(_reranked(spark, d))
    return r.select("qid", F.col("total_results").cast("bigint").alias("total_results"),
                    "top_doc_id", "doc_ids")


def request_table(spark, d):
    """Benchmark texts as requests that differ in top_k, alpha, rerank and filters."""
    q = I.query_table(spark, d)
    lang, source = F.lit("lang"), F.lit("source")
    return q.select("qid", "query", "q_emb", F.when(F.col("qid") % 7 > 0, 2 + F.col("qid") % 4).alias("top_k"),
                    F.when(F.col("qid") % 5 > 0, F.col("qid") % 5 / 4).alias("alpha"), F.when(F.col("qid") % 11 > 0, F.col("qid") % 2 == 0).alias("rerank"),
                    F.when(F.col("qid") % 3 == 1, F.create_map(lang, F.lit("en"))).when(
                        F.col("qid") % 3 == 2, F.create_map(lang, F.lit("fr"), source, F.lit("src3"))).alias("filters"))


def search_requests(spark, d):
    res = requests.search_requests(I.hybrid_index(spark, d), request_table(spark, d), I.content_table(spark, d),
                                   I.documents(spark, d).select("doc_id", "lang", "source"))
    return res.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", _r("score"), _r("rerank_score"))


# ---------------------------------------------------------------- context

def context_block(spark, d):
    return context.context_block(_reranked(spark, d))


def context_short(spark, d):
    return context.context_short(I.query_table(spark, d), _reranked(spark, d))


def history_last10(spark, d):
    conv = I.table(spark, d, "conversations")
    return context.last_messages(conv).select("conv_id", "turn", "role", "text")


def history_filtered(spark, d):
    conv = I.table(spark, d, "conversations")
    return context.history(conv).select("conv_id", "turn", "role", "text")


def prompt_messages(spark, d):
    conv = I.table(spark, d, "conversations")
    return context.prompt_messages(I.query_table(spark, d), _reranked(spark, d), conv)


API_VERSION = ("version", "2023-05-31")


def prompt_json(spark, d):
    conv = I.table(spark, d, "conversations")
    return context.prompt_json(context.prompt_messages(I.query_table(spark, d), _reranked(spark, d), conv), version=API_VERSION)


def prompt_json_short(spark, d):
    q = I.query_table(spark, d)
    return context.prompt_json_short(q, context.context_short(q, _reranked(spark, d)), version=API_VERSION)


def conversation_turns(spark, d):
    t = context.conversation_turns(I.table(spark, d, "conversations"))
    return t.select("conv_id", F.col("n_messages").cast("bigint").alias("n_messages"),
                    F.col("kept").cast("bigint").alias("kept"), "turns")


# ---------------------------------------------------------------- metrics

def _events(spark, d):
    return I.table(spark, d, "events")


def metric_counters(spark, d):
    return metrics.counters(_events(spark, d))


def metric_histogram(spark, d):
    h = metrics.histogram(_events(spark, d))
    return h.select("endpoint", "le", "bucket_count", _r("sum"), F.col("count").cast("bigint").alias("count"))


def metric_gauge(spark, d):
    g = metrics.gauge_latest(_events(spark, d))
    return g.select("endpoint", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"),
                    "last_value")


def index_size(spark, d):
    return metrics.index_size(I.documents(spark, d))


def _w(df):
    return df.withColumn("minute", F.date_format("w", "yyyy-MM-dd HH:mm:ss")).drop("w")


def latency_percentiles(spark, d):
    p = _w(metrics.latency_percentiles(_events(spark, d)))
    return p.select("minute", "endpoint", "n", _r("p50"), _r("p95"), _r("p99"))


def requests_per_minute(spark, d):
    p = _w(metrics.per_minute(_events(spark, d)))
    return p.select("minute", "endpoint", "requests", _r("total"))


def avg_per_minute(spark, d):
    p = _w(metrics.per_minute(_events(spark, d)))
    return p.select("minute", "endpoint", _r("avg"))


def errors_per_minute(spark, d):
    return _w(metrics.errors_per_minute(_events(spark, d)))


def run_speedup(spark, d):
    s = metrics.run_speedup(_events(spark, d), "view", "click")
    return s.select("n_a", _r("time_a"), "n_b", _r("time_b"), _r("throughput_a"),
                    _r("throughput_b"), _r("speedup"))


def log_tail(spark, d):
    t = metrics.log_tail(_events(spark, d))
    return t.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                    "event_type", "value")


def log_enrich(spark, d):
    e = metrics.log_enrich(_events(spark, d))
    return e.select("event_id", F.col("query_length").cast("bigint").alias("query_length"),
                    "doc_count", _r("duration_seconds"), _r("throughput"))


# ---------------------------------------------------------------- registry

def _registry() -> dict[str, Query]:
    from sprank.plans import extra
    q: dict[str, Query] = {
        "doc_word_count": doc_word_count,
        "doc_char_count": doc_char_count,
        "doc_clean": doc_clean,
        "doc_sentence_count": doc_sentence_count,
        "doc_snippet": doc_snippet,
        "doc_avg_stats": doc_avg_stats,
        "chunk_words": chunk_words,
        "chunk_chars": chunk_chars,
        "chunk_raw_words": chunk_raw_words,
        "clean_counts": clean_counts,
        "upload_check": upload_check,
        "upload_check_pdf": upload_check_pdf,
        "chunk_summary": chunk_summary,
        "chunk_source_id": chunk_source_id,
        "ingest_rejects": ingest_rejects,
        "vec_normalize": vec_normalize,
        "dense_scores": dense_scores,
        "dense_topk": dense_topk,
        "dense_topk_cells": dense_topk_cells,
        "bm25_index": bm25_index,
        "bm25_scores": bm25_scores,
        "bm25_topk": bm25_topk,
        "bm25_topk_blocks": bm25_topk_blocks,
        "index_append": index_append,
        "append_search": append_search,
        "vectors_append": vectors_append,
        "chunk_bm25_topk": chunk_bm25_topk,
        "minmax_scores": minmax_scores,
        "hybrid_fuse": hybrid_fuse,
        "hybrid_search": hybrid_search,
        "search_no_rerank": search_no_rerank,
        "hits_with_content": hits_with_content,
        "hits_with_title": hits_with_title,
        "pool_semi": pool_semi,
        "alpha_sweep": alpha_sweep,
        "rerank_topk": rerank_topk,
        "rerank_threshold": rerank_threshold,
        "score_percent": score_percent,
        "search_response": search_response,
        "search_requests": search_requests,
        "context_block": context_block,
        "context_short": context_short,
        "history_last10": history_last10,
        "history_filtered": history_filtered,
        "prompt_messages": prompt_messages,
        "prompt_json": prompt_json,
        "prompt_json_short": prompt_json_short,
        "conversation_turns": conversation_turns,
        "metric_counters": metric_counters,
        "metric_histogram": metric_histogram,
        "metric_gauge": metric_gauge,
        "index_size": index_size,
        "latency_percentiles": latency_percentiles,
        "requests_per_minute": requests_per_minute,
        "avg_per_minute": avg_per_minute,
        "errors_per_minute": errors_per_minute,
        "run_speedup": run_speedup,
        "log_tail": log_tail,
        "log_enrich": log_enrich,
    }
    q.update(extra.queries())
    return q


def queries() -> dict[str, Query]:
    return _registry()
