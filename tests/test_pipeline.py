"""Context, history, metrics, streams and the driver contract."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from sprank.operators import context, metrics


def test_history_last10_then_filter(spark):
    roles = ["user", "assistant"] * 6
    roles[3] = roles[6] = roles[9] = "system"   # 3 of the last 10 are system
    conv = spark.createDataFrame([(0, i, r, f"m{i}") for i, r in enumerate(roles)],
                                 "conv_id long, turn long, role string, text string")
    assert context.last_messages(conv).count() == 10
    assert context.history(conv).count() == 7


def test_context_block_format(spark):
    res = spark.createDataFrame([(0, 2, 20, "second"), (0, 1, 10, "first")],
                                "qid long, rank int, doc_id long, content string")
    got = context.context_block(res).first().context
    assert got == "[Chunk 1 — 10]\nfirst\n\n[Chunk 2 — 20]\nsecond"


def test_histogram_cumulative(spark):
    ev = spark.createDataFrame([("a", 4.0), ("a", 60.0), ("a", 20000.0)], "event_type string, value double")
    rows = {r.le: r.bucket_count for r in metrics.histogram(ev).collect()}
    assert rows["0.005"] == 1 and rows["0.075"] == 2 and rows["10.0"] == 2 and rows["+Inf"] == 3


def test_percentiles_exact(spark):
    import numpy as np
    vals = [float(v) for v in range(1, 102)]
    ev = spark.createDataFrame([("2024-01-01 00:00:10", "a", v) for v in vals],
                               "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    r = metrics.latency_percentiles(ev).first()
    assert r.p95 == pytest.approx(np.percentile(vals, 95))


def _ingest(spark, src, root, **kw):
    from sprank.streaming import jobs
    return jobs.ingest(spark, str(src), str(root / "out"), str(root / "checkpoint"), **kw)


def test_stream_equals_batch(spark, tmp_path):
    from sprank.operators import chunking
    from sprank.streaming import jobs
    out = _ingest(spark, f"{SF001}/documents.parquet", tmp_path, index=False, embed=False)
    s = jobs.ingested_chunks(spark, out)
    b = chunking.char_chunks(spark.read.parquet(f"{SF001}/documents.parquet"))
    cols = ["doc_id", "chunk_idx", "chunk_id", "chunk"]
    assert s.select(*cols).exceptAll(b.select(*cols)).count() == 0
    assert s.count() == b.count()


def test_stream_counters_count_events_without_time(spark, monkeypatch):
    from sprank.plans import extra
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).cast("timestamp_ntz")
    ev = spark.range(400).repartition(2).select(F.when(F.col("id") % 50 > 0, t).alias("ts"), F.when(F.col("id") % 3 == 0, "error").otherwise("view").alias("event_type"),
                                                F.col("id").cast("double").alias("value"))
    monkeypatch.setattr(extra.I, "table", lambda spark, d, name: ev)
    got = {(r.endpoint, r.status): r.requests for r in extra.stream_counters(spark, "").collect()}
    assert got == {("error", "error"): 134, ("view", "ok"): 266}


def test_stream_resumes_and_replaces_documents(spark, tmp_path):
    """A second run reads only new files; a document that shrinks loses its old chunks, also its last one."""
    import os

    from sprank.operators import bm25, chunking
    from sprank.streaming import jobs
    src, schema = tmp_path / "in", "doc_id long, text string"
    long = " ".join(f"word{i}" for i in range(300))
    first = [(1, long), (2, "second document " * 4), (3, "third document " * 5)]
    spark.createDataFrame(first, schema).write.parquet(str(src))
    out = _ingest(spark, src, tmp_path)
    assert jobs.ingested_chunks(spark, out).where("doc_id = 1").count() > 3
    before = set(os.listdir(f"{out}/chunks"))
    second = [(1, "now a short text of the first document"), (3, "gone")]
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(str(src))
    _ingest(spark, src, tmp_path)
    new = set(os.listdir(f"{out}/versions")) - before
    assert len(new) == 1
    assert spark.read.parquet(f"{out}/versions/{new.pop()}").count() == 2
    now = chunking.char_chunks(spark.createDataFrame([second[0], first[1], second[1]], schema))
    got = jobs.ingested_chunks(spark, out)
    assert sorted(r.chunk_id for r in got.collect()) == sorted(r.chunk_id for r in now.collect())
    assert all(len(r.embedding) == 384 for r in got.collect())
    want = bm25.build_bm25(now, "chunk_id", "chunk")
    assert jobs.ingested_index(spark, out).stats == pytest.approx(want.stats)


def test_contract(spark):
    import __spark_entry__ as E
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["qid", "rank", "doc_id", "score"]


def test_embedding_paths_agree(spark):
    import numpy as np
    from sprank.operators import embedding
    df = spark.createDataFrame([(1, "Hello world hello"), (2, ""), (3, "ñandú  Über\tstraße")],
                               "id long, text string")
    fast = {r.id: np.array(r.embedding) for r in embedding.embed(df, "text").collect()}
    py = embedding.hashed_bow()
    for r in df.collect():
        want = py([r.text])[0]
        assert np.allclose(fast[r.id], want, atol=1e-6)
    assert len(fast[1]) == 384 and np.isclose(np.linalg.norm(fast[1]), 1.0)
    assert not fast[2].any()
    # the generic registry path (model UDF) gives the same vectors
    embedding.register_model("bow-test", lambda: embedding.hashed_bow())
    slow = {r.id: np.array(r.embedding) for r in embedding.embed(df, "text", model="bow-test").collect()}
    assert all(np.allclose(slow[k], fast[k], atol=1e-6) for k in fast)


def test_text_source_and_fallback(spark, tmp_path):
    from sprank.sources import files
    (tmp_path / "b.txt").write_text("  second\r\nfile \n", encoding="utf-8")
    (tmp_path / "a.txt").write_text("first", encoding="utf-8")
    (tmp_path / "skip.md").write_text("no", encoding="utf-8")
    got = {r.doc_id: r.content for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert got == {"a": "first", "b": "second\nfile"}
    fb = files.load_documents(spark, str(tmp_path / "missing"))
    assert fb.count() == 3


def test_json_csv_roundtrip(spark, tmp_path):
    from sprank.sources import files
    docs = spark.createDataFrame([(1, 'he said "hi",\nthen left', "en", "src1", 22)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    s = files.as_sample_documents(docs)
    files.write_json(s, str(tmp_path / "j"))
    files.write_csv(s, str(tmp_path / "c"))
    a = files.flatten_sample(files.read_json(spark, str(tmp_path / "j"))).collect()
    b = files.flatten_sample(files.read_csv(spark, str(tmp_path / "c"))).collect()
    assert a == b and a[0].text == 'he said "hi",\nthen left' and a[0].topics == "en,src1"


def test_bounded_files(spark, tmp_path):
    from sprank.sources import files
    docs = spark.createDataFrame([(i, f"line\n{i}", "en", "s", 6) for i in range(25)], "doc_id long, text string, lang string, source string, n_chars long")
    s = files.as_sample_documents(docs.coalesce(1))
    for write, read in ((files.write_json, files.read_json), (files.write_csv, files.read_csv)):
        path = str(tmp_path / write.__name__)
        write(s, path, rows_per_file=10)
        per_file = read(spark, path).groupBy(F.input_file_name()).count().collect()
        assert sorted(r["count"] for r in per_file) == [5, 10, 10]


def test_udf_scorer_equals_native(spark):
    from sprank.operators import rerank
    df = spark.createDataFrame([(0, 1, 1, "a b c", "b c d e", 1.0), (0, 2, 2, "", "x", 0.5),
                                (1, 1, 3, "x x y", "y z", 0.2)],
                               "qid long, rank int, doc_id long, query string, content string, score double")
    nat = {r.doc_id: r.rerank_score for r in rerank.score_pairs(df).collect()}
    py = {r.doc_id: r.rerank_score for r in rerank.score_pairs(df, scorer="overlap-py").collect()}
    assert nat == pytest.approx(py) and nat[1] == pytest.approx(2 / 3) and nat[2] == 0.0


def test_stream_index_equals_batch_index(spark, tmp_path):
    from sprank.operators import bm25, chunking
    from sprank.streaming import jobs
    idx = jobs.ingested_index(spark, _ingest(spark, f"{SF001}/documents.parquet", tmp_path, embed=False))
    chunks = chunking.char_chunks(spark.read.parquet(f"{SF001}/documents.parquet"))
    full = bm25.build_bm25(chunks, "chunk_id", "chunk")
    assert idx.stats == pytest.approx(full.stats)
    q = spark.createDataFrame([(0, "the of and zebra")], "qid long, query string")
    a = sorted((r.qid, r.doc_id, round(r.score, 9), r.rank) for r in bm25.bm25_topk(idx, q, 5).collect())
    b = sorted((r.qid, r.doc_id, round(r.score, 9), r.rank) for r in bm25.bm25_topk(full, q, 5).collect())
    assert a == b


def test_encoder_failures(spark):
    """A failing encoder fails the job; zero vectors only on request, and counted."""
    from sprank.operators import embedding

    def broken():
        def encode(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no vector")
            return embedding.hashed_bow()(texts)
        return encode
    embedding.register_model("broken", broken)
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, text string").coalesce(1)
    with pytest.raises(Exception, match="no vector"):
        embedding.embed(df, "text", model="broken").collect()
    failed = spark.sparkContext.accumulator(0)
    rows = embedding.embed(df, "text", model="broken", batch_size=1, on_error="zeros", failed=failed).collect()
    assert failed.value == 1 and [any(r.embedding) for r in sorted(rows)] == [True, False]


def test_extension_predicate(spark):
    from sprank.operators import chunking
    files = spark.createDataFrame([("a.PDF",), ("b.pdf",), ("c.txt",)], "filename string")
    got = {r.filename: (r.accepted, r.reason) for r in chunking.accept_by_extension(files).collect()}
    assert got == {"a.PDF": (True, None), "b.pdf": (True, None), "c.txt": (False, "unsupported_type")}


def test_generators(spark):
    from sprank.sources import generators
    docs = generators.topic_documents(spark.range(200)).collect()
    assert len(docs) == 200 and docs[0].id == "doc_0000"
    for d in docs:
        assert 1 <= len(d.topics) <= 3 and len(set(d.topics)) == len(d.topics)
        assert set(d.topics) <= set(generators.TOPICS)
        assert d.length == len(d.content) and 1 <= int(d.metadata.author.split("_")[1]) <= 10
    arts = generators.template_articles(spark.range(5), {"x": ["alpha", "beta"], "y": ["gamma"]},
                                        ["About %s.", "More on %s."], paragraphs=3).collect()
    assert len(arts) == 5 and all(a.content.count("\n\n") == 2 for a in arts)
