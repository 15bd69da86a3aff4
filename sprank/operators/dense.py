"""Exact dense (cosine) retrieval.

Vectors are L2-normalised with the norm floored at 1e-10, so cosine is a dot
product. Ids keep the type of the input (numbers or strings).

* ``dense_topk`` meets queries and vectors block by block: one matrix product
  per block, then a vectorised cut to the k best per query under the global
  order (rounded score desc, id asc); a final ``row_number`` picks the global
  top-k. A query set of checked size (MAX_QUERY_FLOATS) is broadcast and the
  vectors stay where they are; a larger one is dealt into groups, the vectors
  into slots, and each pair of a group and a slot is one bounded task.
* ``dense_scores`` gives every (query, vector) score batch by batch, unranked.

A query whose norm is below 1e-10 has an empty list; a zero corpus vector
scores 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprank.functions.ranking import RANK_DIGITS, rank_topk

NORM_FLOOR = 1e-10
# Query sets of up to this many floats (64 MB) are broadcast.
MAX_QUERY_FLOATS = 8_000_000
# Cells of one score matrix (rows x queries), about: 32 MB.
MAX_CELLS = 4_000_000
# Rows of a slot and queries of a group when both sides are dealt out.
SLOT_ROWS, GROUP_QUERIES = 100_000, 10_000


def _vec(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_vec(v), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v) -> Column:
    """``v / max(||v||, 1e-10)`` as array<double>."""
    n = F.greatest(l2_norm(v), F.lit(NORM_FLOOR))
    return F.transform(_vec(v), lambda x: x.cast("double") / n)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_vec(a), _vec(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _matrix(col: pa.Array) -> np.ndarray:
    """Unit rows of a list column, without per-row objects; a NULL vector counts
    as a zero vector (score 0), short vectors are filled with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.if_else(pc.is_null(col), pa.scalar([], type=col.type), col)
    lens = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = int(lens.max(initial=0))
    if len(lens) and lens.min() != dim:
        mat = np.zeros((len(lens), dim))
        mat[np.arange(dim)[None, :] < lens[:, None]] = flat
    else:
        mat = flat.reshape(len(lens), dim)
    return mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), NORM_FLOOR)


def _scores(unit: np.ndarray, qmat: np.ndarray) -> np.ndarray:
    d = min(unit.shape[1], qmat.shape[1])
    return unit[:, :d] @ qmat[:, :d].T


class _Best:
    """The k best (id, score) of every query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids, self.q, self.score = None, np.zeros(0, np.int64), np.zeros(0)
        self.limit = max(MAX_CELLS // 4, 4 * queries * k)

    def add(self, ids: np.ndarray, sc: np.ndarray) -> None:
        n, k = sc.shape[0], self.k
        r = np.round(sc, RANK_DIGITS)
        hit = r >= np.partition(r, n - k, axis=0)[n - k] if n > k else np.ones(r.shape, bool)
        row, q = np.nonzero(hit)
        self.ids = ids[row] if self.ids is None else np.concatenate([self.ids, ids[row]])
        self.q = np.concatenate([self.q, q])
        self.score = np.concatenate([self.score, sc[row, q]])
        if len(self.q) > self.limit:
            self.cut()

    def cut(self) -> None:
        if self.ids is None or not len(self.q):
            return
        place = np.unique(self.ids, return_inverse=True)[1]  # order of ids of any type
        order = np.lexsort((place, -np.round(self.score, RANK_DIGITS), self.q))
        q = self.q[order]
        first = np.searchsorted(q, q)
        keep = order[np.arange(len(q)) - first < self.k]
        self.ids, self.q, self.score = self.ids[keep], self.q[keep], self.score[keep]


def _ids(col) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False) if isinstance(col, pa.Array) else col.to_numpy()


def _blocks(rows: int, queries: int):
    """Row ranges whose score matrix stays within MAX_CELLS."""
    step = max(1, MAX_CELLS // max(queries, 1))
    return [(i, min(i + step, rows)) for i in range(0, rows, step)]


def _schema(vectors: DataFrame, queries: DataFrame, id_col: str, qid_col: str) -> T.StructType:
    return T.StructType([T.StructField("qid", queries.schema[qid_col].dataType),
                         T.StructField("doc_id", vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())])


def _usable(queries: DataFrame, qid_col: str, qvec_col: str) -> DataFrame:
    q = queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("qv"))
    return q.where(F.col("qv").isNotNull() & (l2_norm("qv") >= NORM_FLOOR))


def _arrow(schema: T.StructType, qids, ids, score) -> list:
    from pyspark.sql.pandas.types import to_arrow_type
    return [pa.array(qids, to_arrow_type(schema["qid"].dataType)), pa.array(ids, to_arrow_type(schema["doc_id"].dataType)),
            pa.array(score, pa.float64())]


def _fits(usable: DataFrame) -> tuple[int, bool]:
    n, floats = usable.agg(F.count(F.lit(1)), F.sum(F.size("qv"))).first()
    return n, (floats or 0) <= MAX_QUERY_FLOATS


def _query_matrix(spark, usable: DataFrame):
    table = usable.toArrow()  # of checked size
    return spark.sparkContext.broadcast((_ids(table["qid"]), _matrix(table["qv"])))


def _dealt(vectors: DataFrame, usable: DataFrame, n: int, id_col: str, vec_col: str):
    """Vectors in slots and queries in groups; every pair of them meets in one cogroup."""
    groups = max(1, math.ceil(n / GROUP_QUERIES))
    slots = max(1, math.ceil(vectors.count() / SLOT_ROWS))
    left = (vectors.select(F.pmod(F.xxhash64(id_col), F.lit(slots)).alias("slot"), F.col(id_col).alias("doc_id"), F.col(vec_col).alias("v"))
            .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    right = (usable.withColumn("grp", F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int"))
             .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))))
    return left.groupBy("slot", "grp").cogroup(right.groupBy("slot", "grp"))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id",
               vec_col: str = "embedding", qid_col: str = "qid", qvec_col: str = "q_emb",
               rank_col: str = "rank") -> DataFrame:
    """Top ``min(k, N)`` vectors per query by cosine, (rounded score desc, id asc)."""
    if k < 0:
        raise ValueError("k must be >= 0")
    spark, schema = vectors.sparkSession, _schema(vectors, queries, id_col, qid_col)
    if k == 0:
        return rank_topk(spark.createDataFrame([], schema), "qid", "score", "doc_id", k, rank_col)
    usable = _usable(queries, qid_col, qvec_col)
    n, small = _fits(usable)

    def best_of(parts, qids, qmat):
        best = _Best(len(qids), k)
        for ids, unit in parts:
            for i, j in _blocks(len(ids), len(qids)):
                best.add(ids[i:j], _scores(unit[i:j], qmat))
        best.cut()
        return _arrow(schema, qids[best.q], best.ids if best.ids is not None else [], best.score)

    if small:
        shared = _query_matrix(spark, usable)

        def run(batches):
            qids, qmat = shared.value
            if len(qids):
                yield pa.RecordBatch.from_arrays(
                    best_of(((_ids(b.column(0)), _matrix(b.column(1))) for b in batches if b.num_rows), qids, qmat), schema.names)
        local = vectors.select(id_col, vec_col).mapInArrow(run, schema)
    else:
        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not (left.num_rows and right.num_rows):
                return pa.Table.from_arrays(_arrow(schema, [], [], []), names=schema.names)
            return pa.Table.from_arrays(best_of([(_ids(left["doc_id"]), _matrix(left["v"]))], _ids(right["qid"]), _matrix(right["qv"])),
                                        names=schema.names)
        local = _dealt(vectors, usable, n, id_col, vec_col).applyInArrow(meet, schema)
    return rank_topk(local, "qid", "score", "doc_id", k, rank_col)


def dense_scores(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 qid_col: str = "qid", qvec_col: str = "q_emb") -> DataFrame:
    """Every (qid, doc_id, score): the operator's full output, one row per pair, in no order.

    Rows leave each task block by block; nothing is ranked or held.
    """
    schema = _schema(vectors, queries, id_col, qid_col)
    usable = _usable(queries, qid_col, qvec_col)
    n, small = _fits(usable)

    def pairs(ids, unit, qids, qmat):
        for i, j in _blocks(len(ids), len(qids)):
            sc = _scores(unit[i:j], qmat)
            yield _arrow(schema, np.tile(qids, j - i), np.repeat(ids[i:j], len(qids)), sc.ravel())
    if small:
        shared = _query_matrix(vectors.sparkSession, usable)

        def run(batches):
            qids, qmat = shared.value
            for b in batches:
                if b.num_rows and len(qids):
                    for cols in pairs(_ids(b.column(0)), _matrix(b.column(1)), qids, qmat):
                        yield pa.RecordBatch.from_arrays(cols, schema.names)
        return vectors.select(id_col, vec_col).mapInArrow(run, schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            parts = list(pairs(_ids(left["doc_id"]), _matrix(left["v"]), _ids(right["qid"]), _matrix(right["qv"])))
        parts = parts or [_arrow(schema, [], [], [])]
        return pa.concat_tables([pa.Table.from_arrays(c, names=schema.names) for c in parts])
    return _dealt(vectors, usable, n, id_col, vec_col).applyInArrow(meet, schema)


def vector_stats(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per vector: norm, and sum / sum of squares of the unit vector (E4 check)."""
    u = normalize(vec_col)
    return vectors.select(
        F.col(id_col),
        l2_norm(vec_col).alias("norm"),
        F.size(vec_col).alias("dim"),
        F.aggregate(u, F.lit(0.0).cast("double"), lambda a, x: a + x).alias("unit_sum"),
        F.aggregate(u, F.lit(0.0).cast("double"), lambda a, x: a + x * x).alias("unit_sq"))
