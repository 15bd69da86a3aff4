"""Persisted keyword index: build once, search many query batches.

Postings are a Parquet table partitioned by term hash (``tb``; part -1 holds
one row per document) and bucketed by ``doc_id``, the rows of each file sorted
by term. A search reads only the parts and row groups that can hold its terms,
and the known hash partitioning by ``doc_id`` saves the exchange of the per
(query, document) sum. The vocabulary (term, df) is stored beside it, and the
corpus statistics with the layout in a small JSON file that is written last.
The number of buckets and parts follows the measured size of the texts, so what a
task holds does not grow with the corpus.

Every save goes to a folder of its own, so builders never overwrite each other
and readers of an older state keep their files; the JSON file names the folder
that counts.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprank.operators import bm25
from sprank.operators.bm25 import BM25Index

LAYOUT = 2                    # of the files; another layout is another index
BYTES_PER_BUCKET = 8 << 20    # of input text, about; a task builds, sorts and searches one bucket
BYTES_PER_DOC = 512           # that a document counts beside its text, for its rows and scores
BYTES_PER_PART = 1 << 30
MAX_BUCKETS, MAX_PARTS = 100_000, 64


def _table_name(path: str) -> str:
    return "sprank_postings_" + hashlib.sha1(path.encode()).hexdigest()


def layout_for(spark: SparkSession, size: int) -> tuple[int, int]:
    """(doc_id buckets, term parts) for texts of so many bytes; a bucket per core at least."""
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(size / BYTES_PER_BUCKET))
    return min(buckets, MAX_BUCKETS), min(max(1, math.ceil(size / BYTES_PER_PART)), MAX_PARTS)


def measured(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(what the texts of ``docs`` count for ``layout_for``, their number): files say little about texts that compress well."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + BYTES_PER_DOC
    total, n = docs.agg(F.sum(size), F.count(F.lit(1))).first()
    return total or 0, n


def text_size(docs: DataFrame, text_col: str = "text") -> int:
    return measured(docs, text_col)[0]


def save_index(index: BM25Index, path: str, buckets: int | None = None, term_parts: int | None = None) -> None:
    save_postings(index.postings, path, buckets, term_parts, index.k1, index.b, index.epsilon)


def save_postings(postings: DataFrame, path: str, buckets: int | None = None, term_parts: int | None = None,
                  k1: float = bm25.K1, b: float = bm25.B, epsilon: float = bm25.EPSILON) -> None:
    """Write postings once; vocabulary and statistics are derived from what was written."""
    spark = postings.sparkSession
    buckets = buckets or spark.sparkContext.defaultParallelism
    term_parts = term_parts or 1
    data = os.path.join(path, f"data-{uuid.uuid4().hex[:12]}")
    name = _table_name(data)
    rows = postings.select("doc_id", "term", "tf", "dl", "first").withColumn(
        "tb", F.when(F.col("first"), -1).otherwise(bm25.term_part("term", term_parts)))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    # One task per bucket: each writes one file per part.
    (rows.repartition(buckets, "doc_id").write.partitionBy("tb").bucketBy(buckets, "doc_id").sortBy("term")
     .option("path", os.path.join(data, "postings")).saveAsTable(name))
    stored = spark.table(name)
    terms = (stored.where("tb >= 0").groupBy("tb", "term").agg(F.count(F.lit(1)).alias("df")))
    terms.sortWithinPartitions("tb", "term").write.partitionBy("tb").parquet(os.path.join(data, "terms"))
    saved = _terms(spark, data, ddl)
    n, avgdl = stored.where("tb = -1").agg(F.count(F.lit(1)), F.avg("dl")).first()
    stats = bm25.stats_from_terms(saved, n, avgdl, epsilon)
    meta = {"stats": stats, "k1": k1, "b": b, "epsilon": epsilon, "buckets": buckets,
            "term_parts": term_parts, "data": os.path.basename(data), "ddl": ddl}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(path, "meta"))


def _terms(spark: SparkSession, data: str, ddl: str) -> DataFrame:
    return spark.read.schema("term string, df bigint, tb int").parquet(os.path.join(data, "terms"))


def load_index(spark: SparkSession, path: str) -> BM25Index:
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    data = os.path.join(path, meta["data"])
    name = _table_name(data)
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({meta['ddl']}) USING parquet PARTITIONED BY (tb) "
                  f"CLUSTERED BY (doc_id) SORTED BY (term) INTO {meta['buckets']} BUCKETS "
                  f"LOCATION '{os.path.join(data, 'postings')}'")
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return BM25Index(postings=spark.table(name), stats=meta["stats"], k1=meta["k1"], b=meta["b"],
                     epsilon=meta["epsilon"], partitions=meta["buckets"], term_parts=meta["term_parts"],
                     stored_terms=_terms(spark, data, meta["ddl"]))


def append_index(spark: SparkSession, path: str, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> BM25Index:
    """Add a batch of documents to the stored index; a document seen before is replaced.

    The batch is tokenised once; old postings are neither tokenised nor
    shuffled again (the anti join is co-located by ``doc_id`` bucket).
    """
    from sprank.operators.index import append_postings
    from sprank.session import scratch_path
    old = load_index(spark, path)
    new = bm25.build_postings(corpus, id_col, text_col, num_partitions=old.partitions)
    staged = scratch_path(spark, "append")
    new.write.parquet(staged)
    merged = append_postings(old.postings.drop("tb"), spark.read.schema(new.schema).parquet(staged))
    save_postings(merged, path, old.partitions, old.term_parts, old.k1, old.b, old.epsilon)
    return load_index(spark, path)


def _status(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _status(spark, path)
    return bool(fs.exists(p))


def input_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, latest modification time) of an input file or folder."""
    fs, p = _status(spark, path)
    it = fs.listFiles(p, True)
    size, mtime = 0, 0
    while it.hasNext():
        st = it.next()
        size += st.getLen()
        mtime = max(mtime, st.getModificationTime())
    return size, mtime


def input_key(spark: SparkSession, path: str, **params) -> str:
    """Identity of an index: input path, size and time, scoring parameters, tokens and layout.
    A changed input, parameter or layout gets a new key, so a stale index is never reused."""
    fs, p = _status(spark, path)
    from sprank.functions.text import PY_WS
    raw = json.dumps([fs.makeQualified(p).toString(), *input_size(spark, path), LAYOUT, PY_WS, sorted(params.items())])
    return hashlib.sha1(raw.encode()).hexdigest()[:20]


def build_or_load(spark: SparkSession, root: str, source_path: str, build, buckets: int | None = None,
                  tag: str = "bm25", texts: DataFrame | None = None) -> BM25Index:
    """The index of ``source_path``: loaded from ``root`` when a complete one
    for the same input exists, else its postings are made by ``build(buckets)``
    and saved there (the metadata is written last and checked by its success
    marker, so a partial save is never loaded). The layout follows the size of
    ``texts`` (column text), or of the input files."""
    key = input_key(spark, source_path, k1=bm25.K1, b=bm25.B, epsilon=bm25.EPSILON)
    loc = os.path.join(root, f"{tag}-{key}")
    if not exists(spark, os.path.join(loc, "meta", "_SUCCESS")):
        auto, parts = layout_for(spark, input_size(spark, source_path)[0] if texts is None else text_size(texts))
        save_postings(build(buckets or auto), loc, buckets or auto, parts)
    return load_index(spark, loc)
