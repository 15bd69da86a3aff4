"""Registered queries for sinks/sources, embedding, generators and streams.

Round trips write into a fresh folder under the shared folder
(``spark.checkpoint.dir``) and read it back, so the result is the re-read data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sprank.functions import text as tx
from sprank.operators import chunking, context, dense, embedding, fusion, store
from sprank.operators import search as srch
from sprank.plans import inputs as I
from sprank.plans.oracle import CHUNK_CHARS, CHUNK_WORDS
from sprank.session import scratch_path
from sprank.sources import files
from sprank.streaming import jobs


def parquet_roundtrip(spark, d):
    chunks = chunking.word_chunks(I.documents(spark, d)).select(
        "doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk_id", "chunk")
    back, _ = files.parquet_roundtrip(chunks, scratch_path(spark, "parquet-roundtrip"))
    return back


def parquet_schema(spark, d):
    """The columns of the written chunks as their schema says on reading back, and their values."""
    chunks = chunking.word_chunks(I.documents(spark, d)).select(
        "doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk_id", "chunk")
    return files.column_counts(*files.parquet_roundtrip(chunks, scratch_path(spark, "parquet-schema")))


def json_roundtrip(spark, d):
    path = scratch_path(spark, "json-roundtrip")
    files.write_json(files.as_sample_documents(I.documents(spark, d)), path)
    return files.flatten_sample(files.read_json(spark, path))


def csv_roundtrip(spark, d):
    path = scratch_path(spark, "csv-roundtrip")
    files.write_csv(files.as_sample_documents(I.documents(spark, d)), path)
    return files.flatten_sample(files.read_csv(spark, path))


def _vectors(df, key):
    return df.select(key, F.size("embedding").cast("bigint").alias("dim"), "embedding")


def embed_chunks(spark, d):
    return _vectors(embedding.embed(chunking.char_chunks(I.documents(spark, d)), "chunk"), "chunk_id")


def embed_queries(spark, d):
    q = I.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text"))
    return _vectors(embedding.embed(q, "text"), "qid")


def embed_queries_model(spark, d):
    """The same vectors through a registered encoder in the iterator UDF."""
    q = I.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text"))
    return _vectors(embedding.embed(q, "text", model="hashed-bow-model"), "qid")


def zero_fallback(spark, d):
    """Dense top 10 where every seventh vector is missing and counts as zeros."""
    v = I.table(spark, d, "embeddings")
    v = v.select("vec_id", embedding.zero_fallback(F.when(F.col("vec_id") % 7 != 0, F.col("embedding")), 64).alias("embedding"))
    top = dense.dense_topk(v, I.query_table(spark, d), I.LIST_K)
    return top.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


def chunk_hybrid_search(spark, d):
    """The whole flow: documents -> word chunks -> vectors -> hybrid search over
    chunk ids -> content by chunk id -> source document."""
    hits = _chunk_hits(spark, d)
    return hits.select("qid", F.col("rank").cast("bigint").alias("rank"), F.col("doc_id").alias("chunk_id"),
                       F.round("score", 6).alias("score"), "content", "title")


def _chunk_hits(spark, d):
    chunks = files.parquet_roundtrip(
        embedding.embed(chunking.word_chunks(I.documents(spark, d)), "chunk").select("chunk_id", "chunk", "embedding"),
        scratch_path(spark, "chunk-vectors"))[0]
    index = fusion.HybridIndex(I.new_chunk_index(spark, chunks, store.text_size(chunks, "chunk")), chunks.select(F.col("chunk_id").alias("vec_id"), "embedding"))
    q = embedding.embed(I.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")), "query", "q_emb")
    hits = fusion.hybrid_search(index, q, I.TOP_K, I.ALPHA)
    hits = srch.with_content(hits, chunks.select(F.col("chunk_id").alias("doc_id"), F.col("chunk").alias("content")))
    titles = I.documents(spark, d).select(F.col("doc_id").cast("string").alias("source_id"),
                                          F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("title"))
    hits = hits.withColumn("source_id", tx.source_doc_id("doc_id"))
    return srch.with_title(hits, titles, "source_id")


def chunk_context_block(spark, d):
    return context.context_block(_chunk_hits(spark, d))


def rerank_udf(spark, d):
    """The rerank of ``rerank_topk`` through the pair-scorer UDF."""
    r = srch.search(I.hybrid_index(spark, d), I.query_table(spark, d), I.content_table(spark, d), I.TOP_K, I.ALPHA, scorer="overlap-py")
    return r.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 6).alias("score"),
                    F.round("rerank_score", 6).alias("rerank_score"))


def _dated_files(frames, path):
    """One write after the other, so that later parts have later file times."""
    for f in frames:
        f.write.mode("append").parquet(path)
    return path


def _incoming(spark, d):
    """Documents in four writes; each but the last also brings older texts of
    documents that come again in the next. The newest version counts."""
    docs = I.documents(spark, d).select("doc_id", "text")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    old = F.expr("substring(text, 1, cast(length(text) * 0.6 as int))")
    frames = [docs.where(part == i).unionByName(docs.where(part == i + 1).withColumn("text", F.concat(F.lit("older "), old))) for i in range(4)]
    return _dated_files(frames, scratch_path(spark, "incoming"))


def stream_ingest(spark, d):
    """The chunks of documents that arrive in four writes."""
    out = jobs.ingest(spark, _incoming(spark, d), scratch_path(spark, "ingested"), scratch_path(spark, "ingest-checkpoint"), max_files=8, index=False)
    return jobs.ingested_chunks(spark, out).select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk_id", "chunk")


def stream_search(spark, d):
    """Hybrid search over the index that a stream of documents keeps: segments of
    postings and vectors, one for each micro-batch, replaced documents left out."""
    out = jobs.ingest(spark, _incoming(spark, d), scratch_path(spark, "ingested"), scratch_path(spark, "ingest-checkpoint"), max_files=8)
    q = embedding.embed(I.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")), "query", "q_emb")
    hits = fusion.hybrid_search(jobs.ingested_hybrid(spark, out), q, I.TOP_K, I.ALPHA)
    return hits.select("qid", F.col("rank").cast("bigint").alias("rank"), F.col("doc_id").alias("chunk_id"), F.round("score", 6).alias("score"))


def _timed_events(spark, d):
    """Events in four writes, in order of time; those without a time come with the first."""
    ev = I.table(spark, d, "events").withColumn("__t", F.col("ts").cast("timestamp").cast("double"))
    cuts = [float("-inf"), *ev.approxQuantile("__t", [0.25, 0.5, 0.75], 0.01), float("inf")]
    t = F.coalesce("__t", F.lit(cuts[0]))
    return _dated_files([ev.where((t >= a) & (t < b)).drop("__t") for a, b in zip(cuts, cuts[1:])],
                        scratch_path(spark, "events"))


def stream_requests(spark, d):
    m = jobs.request_metrics(spark, _timed_events(spark, d), scratch_path(spark, "requests"), scratch_path(spark, "requests-checkpoint"), max_files=64)
    return m.select(F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("minute"), "endpoint", "requests",
                    F.round("total", 6).alias("total"), F.round("avg", 6).alias("avg"))


def stream_counters(spark, d):
    return jobs.running_counters(spark, _timed_events(spark, d), scratch_path(spark, "counters"), scratch_path(spark, "counters-checkpoint"), max_files=64)


def stream_percentiles(spark, d):
    p = jobs.request_percentiles(spark, _timed_events(spark, d), scratch_path(spark, "latency"), scratch_path(spark, "latency-checkpoint"), max_files=64)
    return p.select(F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("minute"), "endpoint", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def queries():
    return {
        "parquet_roundtrip": parquet_roundtrip,
        "parquet_schema": parquet_schema,
        "json_roundtrip": json_roundtrip,
        "csv_roundtrip": csv_roundtrip,
        "embed_chunks": embed_chunks,
        "embed_queries": embed_queries,
        "embed_queries_model": embed_queries_model,
        "zero_fallback": zero_fallback,
        "chunk_hybrid_search": chunk_hybrid_search,
        "chunk_context_block": chunk_context_block,
        "rerank_udf": rerank_udf,
        "stream_ingest": stream_ingest,
        "stream_search": stream_search,
        "stream_requests": stream_requests,
        "stream_counters": stream_counters,
        "stream_percentiles": stream_percentiles,
    }


_SAMPLE_SQL = """
SELECT doc_id, text, CASE WHEN lang = source THEN lang ELSE concat_ws(',', lang, source) END AS topics,
       length(text)::BIGINT AS length, source, lang, n_chars
FROM documents"""


def oracle_sql():
    return {
        "parquet_roundtrip": CHUNK_WORDS,
        "parquet_schema": " UNION ALL ".join(
            f"SELECT '{c}' AS name, '{t}' AS type, count({c})::BIGINT AS n FROM ({CHUNK_WORDS})"
            for c, t in (("doc_id", "bigint"), ("chunk_idx", "bigint"), ("chunk_id", "string"), ("chunk", "string"))),
        "json_roundtrip": _SAMPLE_SQL,
        "csv_roundtrip": _SAMPLE_SQL,
        "stream_ingest": CHUNK_CHARS,
        "stream_requests": """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, event_type AS endpoint,
       count(*)::BIGINT AS requests, round(sum(value), 6) AS total, round(avg(value), 6) AS avg
FROM events GROUP BY ALL""",
        "stream_counters": """
SELECT event_type AS endpoint, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
       count(*)::BIGINT AS requests
FROM events GROUP BY ALL""",
    }
