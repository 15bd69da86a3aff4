"""Document sources and sinks: whole-file text, Parquet, JSON, CSV.

All reads and writes are distributed Spark I/O; nothing is read on the driver
(the reference reads files on the driver and calls createDataFrame).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprank.functions.text import PY_WS

# The three built-in documents used when no input folder exists.
FALLBACK_DOCS = [
    ("ml-intro", "Machine learning enables systems to learn from data without explicit programming."),
    ("ai-basics", "Artificial intelligence encompasses machine learning, NLP, and computer vision."),
    ("nlp-transformers", "Transformers revolutionised NLP via self-attention; BERT and GPT are key examples."),
]

# Python str.strip() equivalent: strip Unicode whitespace at both ends.
_STRIP = f"^{PY_WS}+|{PY_WS}+$"


def read_text_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Every file matching ``pattern`` under ``path`` as one row (doc_id, content):
    doc_id = file name without extension, content read whole, CRLF and
    lone CR -> LF, stripped like Python ``str.strip()``."""
    # text()'s own wholetext argument (default False) overrides a reader option.
    df = (spark.read.option("pathGlobFilter", pattern)
          .text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name")))
    return df.select(
        F.regexp_replace("name", r"\.[^.]*$", "").alias("doc_id"),
        F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), _STRIP, "").alias("content"))


def has_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> bool:
    """Whether ``path`` holds at least one matching file (a listing, no data read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return False
    st = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/" + pattern))
    return st is not None and len(st) > 0


def load_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Text documents from ``path``, or the three built-in ones if it is absent or empty."""
    if has_files(spark, path, pattern):
        return read_text_documents(spark, path, pattern)
    return spark.createDataFrame(FALLBACK_DOCS, "doc_id string, content string")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def parquet_roundtrip(df: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Write, read back; returns (re-read frame, schema string)."""
    write_parquet(df, path)
    back = df.sparkSession.read.parquet(path)
    return back, back.schema.simpleString()


def column_counts(df: DataFrame, schema: str) -> DataFrame:
    """(name, type, n): the columns of a schema string and how many rows of the frame have a value in each."""
    fields = T._parse_datatype_string(schema).fields
    counts = df.agg(*[F.count(F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = [F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"c{i}").alias("n"))
            for i, f in enumerate(fields)]
    return counts.select(F.inline(F.array(*rows)))


# Nested sample-document layout (id, content, topics, length, metadata).
SAMPLE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("content", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("length", T.IntegerType()),
    T.StructField("metadata", T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ])),
])
META_SCHEMA = SAMPLE_SCHEMA["metadata"].dataType


def as_sample_documents(docs: DataFrame) -> DataFrame:
    """documents -> nested records; topics = distinct (lang, source) tags."""
    return docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"),
        F.array_distinct(F.array(F.col("lang"), F.col("source"))).alias("topics"),
        F.length("text").alias("length"),
        F.struct("source", "lang", "n_chars").alias("metadata"))


# Documents of a JSON or CSV file: a CSV file with line breaks in its texts is read by one task.
ROWS_PER_FILE = 20_000


def write_json(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """JSON lines, one nested document per line (read back without multiLine)."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType = SAMPLE_SCHEMA,
              multiline: bool = False) -> DataFrame:
    """Reads JSON lines, or (``multiline``) files holding one JSON array each."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def to_csv_layout(df: DataFrame) -> DataFrame:
    """topics joined with ',', metadata as a JSON string."""
    return df.select("id", "content", F.concat_ws(",", "topics").alias("topics"), "length",
                     F.to_json("metadata").alias("metadata"))


def write_csv(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    # Double quotes are escaped by doubling (the csv-module convention), not by
    # backslash, so files exchange cleanly with Python's csv writer.
    (to_csv_layout(df).write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file)
     .option("quote", '"').option("escape", '"').csv(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Back to the nested layout; multiLine because texts hold newlines."""
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("quote", '"').option("escape", '"')
           .schema("id long, content string, topics string, length int, metadata string").csv(path))
    return raw.select("id", "content",
                      F.when(F.col("topics") == "", F.array().cast("array<string>"))
                       .otherwise(F.split("topics", ",")).alias("topics"),
                      "length", F.from_json("metadata", META_SCHEMA).alias("metadata"))


def flatten_sample(df: DataFrame) -> DataFrame:
    """Scalar columns for comparison."""
    return df.select(F.col("id").alias("doc_id"), F.col("content").alias("text"),
                     F.array_join("topics", ",").alias("topics"), F.col("length").cast("bigint").alias("length"),
                     F.col("metadata.source").alias("source"), F.col("metadata.lang").alias("lang"),
                     F.col("metadata.n_chars").alias("n_chars"))
