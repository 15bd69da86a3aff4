"""Shared helpers of the training-data operators.

Tables, written intermediates, vectorised word hashing, distributed prefix
sums, and the split of hot groups into pairs of bounded chunks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sprank.session import scratch_path

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under the cluster's shared folder and read it back.

    Cuts lineage; survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame, per_core: int = 1) -> int:
    """Number of partitions of work tables: the session's own shuffle setting."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))) * per_core


# --- Arrow columns as flat byte arrays --------------------------------------

def flat_utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """(first row, last row + 1) of consecutive rows holding about ``limit`` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# --- vectorised hashing ------------------------------------------------------
# Fixed odd multipliers of a polynomial hash modulo 2^64; any odd values do.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93
_TAB = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_pows: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (kept between calls)."""
    if len(_pows[0]) < n:
        m = max(n, 1 << 19)
        for k, b in enumerate((_BASE, _BASE_INV)):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _pows[k] = np.multiply.accumulate(x)
    return _pows[0][:n], _pows[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the high-order structure of a product over all 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of tab[byte] * base^position over buf[i:j]."""
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TAB[buf] * p[:len(buf)], out=out[1:])
    return out


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal contents."""
    _, inv = powers(len(s))
    return mix((s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_WORDISH = np.zeros(256, bool)
_WORDISH[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NON_WORD = ~_WORDISH


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    up = (buf >= 65) & (buf <= 90)
    return buf + (up * np.uint8(32)).astype(np.uint8)


def word_spans(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each row): maximal runs of non-separator bytes inside rows."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~sep[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def gram_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words inside rows, and their row bounds.

    A row of 1 to n - 1 words has one gram, its whole sequence; a row of none has none.
    """
    count = np.diff(bounds)
    grams = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(grams)])
    total = int(out_bounds[-1])
    row = np.repeat(np.arange(len(count)), grams)
    at = bounds[row] + np.arange(total) - out_bounds[row]
    length = np.minimum(count[row], n)
    h = np.zeros(total, np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for j in range(n):
        h = np.where(j < length, h * np.uint64(_GRAM) + padded[at + j], h)
    return mix(h + length.astype(np.uint64)), out_bounds


# --- distributed order statistics --------------------------------------------

def running_totals(df: DataFrame, order: list[str], totals: dict[str, Column], within: list[str] = (),
                   buckets: int = 64) -> DataFrame:
    """Adds, for each name in ``totals``, the sum over the rows before this one.

    Rows are ordered by (bucket of their order columns, order columns) inside
    each ``within`` group; the order is arbitrary but fixed by the values. Two
    levels: a window inside each (group, bucket), then a window over the bucket
    totals only, so no task holds a whole group.
    """
    b = "__bucket"
    df = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*within, b]
    for name, col in totals.items():
        df = df.withColumn(f"__v_{name}", col.cast("long"))
    sums = df.groupBy(*keys).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in totals])
    w = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(b).rowsBetween(
        Window.unboundedPreceding, -1)
    sums = sums.select(*keys, *[F.coalesce(F.sum(f"__s_{n}").over(w), F.lit(0)).alias(f"__o_{n}") for n in totals])
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *[F.coalesce(F.sum(f"__v_{n}").over(local), F.lit(0)).alias(f"__l_{n}") for n in totals])
    out = out.join(sums, keys)
    return out.select(*[c for c in df.columns if not c.startswith("__")],
                      *[(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in totals])


def split_hot(df: DataFrame, key: str, spread: str, chunk: int) -> DataFrame:
    """Adds ``part``: rows of a key meet in groups (key, part) of bounded size, every pair at least once.

    A key of up to ``chunk`` rows is one group. A larger key is dealt by the
    hash of ``spread`` into c chunks; a row goes to the groups of its chunk with
    each other chunk, so any two rows of the key share a group.
    """
    hot = (df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > chunk)
           .select(key, F.ceil(F.col("__n") * 2 / F.lit(chunk)).cast("int").alias("__c")))
    mine = F.pmod(F.xxhash64(spread, F.lit(11)), F.col("__c")).cast("int")
    other = F.sequence(F.lit(0), F.col("__c") - 1)
    parts = F.transform(other, lambda j: F.least(mine, j) * F.col("__c") + F.greatest(mine, j))
    return (df.join(hot, key, "left")
            .withColumn("part", F.explode(F.when(F.col("__c").isNull(), F.array(F.lit(0))).otherwise(parts)))
            .drop("__c"))


def buckets_for(rows: int, per_bucket: int = 10_000) -> int:
    return max(1, math.ceil(rows / per_bucket))
