"""Stored dense index: unit vectors by cells, and exact top-k that leaves out cells which cannot hold a hit.

Centres are fitted on a bounded sample (spherical k-means on the SAMPLE_ROWS
vectors of least hash of their id); every vector is placed in the cell of its
nearest centre and stored once as a unit vector, in order of cells, so that a
search reads the row groups of the cells it asks for. A cell keeps the greatest
angle between its centre and a member. By the triangle inequality of angles no
member is nearer to a query than the angle to the centre less that radius,
which bounds its cosine.

A search scores the nearest cells of each query first; the k-th score found is
the threshold, and of the other cells only those are read whose bound reaches
it. Results are exact, whatever the centres are. Vectors are appended as further
folders under the same centres; a manifest names the folders that count, and an
id that comes again counts in its last one.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprank.functions.ranking import rank_topk
from sprank.operators import dense
from sprank.sources import manifest as states

SAMPLE_ROWS = 20_000   # vectors that the centres are fitted on, at most
MAX_CELLS = 4096       # their number follows the square root of the rows up to this; more rows make larger cells
SWEEPS = 10
FIRST_CELLS = 3        # nearest cells of a query that are scored for its threshold, more if they hold fewer than k vectors
SLACK = 1e-9           # of bounds and of scores ranked by nine places
ZERO = -1              # cell of vectors without a direction, which score 0


def fit(vectors: DataFrame, id_col: str, vec_col: str, cells: int | None, rows: int) -> np.ndarray:
    """Unit centres by spherical k-means on the sample."""
    share = min(1.0, 2 * SAMPLE_ROWS / max(1, rows))
    hashed = F.xxhash64(F.col(id_col).cast("string"), F.lit(5))
    sample = vectors.where(F.col(vec_col).isNotNull())
    if share < 1:  # a threshold first, so that few rows are put in order
        sample = sample.where(F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30)))
    unit = dense._matrix(sample.orderBy(hashed).limit(SAMPLE_ROWS).select(vec_col).toArrow()[vec_col])
    unit = unit[np.linalg.norm(unit, axis=1) > 0.5]
    n = min(cells or max(1, math.isqrt(max(1, rows))), MAX_CELLS, max(1, len(unit)))
    if not len(unit):
        return np.zeros((0, 0))
    centres = unit[np.linspace(0, len(unit) - 1, n).astype(int)]
    for _ in range(SWEEPS):
        which = np.argmax(unit @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, which, unit)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    return centres


def _place(vectors: DataFrame, centres: np.ndarray, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, cell, angle, unit) of every vector."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(centres)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    schema = T.StructType([rows.schema["vec_id"], T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()),
                           T.StructField("unit", T.ArrayType(T.DoubleType()))])

    def run(batches):
        c = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            unit = dense._matrix(b.column(1))
            cell, angle = np.full(len(unit), ZERO, np.int32), np.zeros(len(unit))
            some = np.flatnonzero(np.linalg.norm(unit, axis=1) > 0.5)
            for i, j in dense._blocks(len(some), len(c)) if len(c) else ():
                near = dense._scores(unit[some[i:j]], c)
                best = near.argmax(1)
                cell[some[i:j]] = best
                angle[some[i:j]] = np.arccos(np.clip(near[np.arange(j - i), best], -1, 1))
            if len(some) and not len(c):
                cell[some], angle[some] = 0, np.pi  # nothing was learned: one cell that is always read
            flat = pa.array(unit.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, max(1, unit.shape[1]), dtype=np.int32))
                                             if unit.shape[1] else pa.array(np.zeros(len(unit) + 1, np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), pa.array(angle), lists], names=schema.names)
    return rows.mapInArrow(run, schema)


def _state(spark: SparkSession, path: str) -> dict:
    return states.newest(spark, os.path.join(path, "manifest")) or {"number": 0, "parts": []}


def append(spark: SparkSession, path: str, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None) -> dict:
    """Store vectors under ``path``; the first call fits the centres. Ids are unique within a call. Gives the new state.

    A large cell is dealt over tasks by id; nothing that was stored is written again.
    """
    state = _state(spark, path)
    if not state["parts"]:
        centres = fit(vectors, id_col, vec_col, cells, vectors.count())
        state["centres"] = centres.tolist()
    name = f"part-{uuid.uuid4().hex[:16]}"
    placed = _place(vectors, np.array(state["centres"]), id_col, vec_col)
    size = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(size, "cell", F.xxhash64("vec_id")).sortWithinPartitions("cell").write.parquet(os.path.join(path, name))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    radii = spark.read.schema(ddl).parquet(os.path.join(path, name)).groupBy("cell").agg(F.count(F.lit(1)), F.max("angle")).collect()
    state["parts"].append({"name": name, "ddl": ddl, "cells": {str(c): [n, r] for c, n, r in radii}})
    state["number"] += 1
    states.commit(spark, os.path.join(path, "manifest"), state)
    return state


def compact(spark: SparkSession, path: str) -> dict:
    """Write the live vectors of all parts as one; cells keep their centres."""
    state = _state(spark, path)
    if len(state["parts"]) > 1:
        live = _live(spark, path, state)
        name = f"part-{uuid.uuid4().hex[:16]}"
        size = int(spark.conf.get("spark.sql.shuffle.partitions"))
        live.repartitionByRange(size, "cell", F.xxhash64("vec_id")).sortWithinPartitions("cell").write.parquet(os.path.join(path, name))
        ddl = state["parts"][0]["ddl"]
        radii = spark.read.schema(ddl).parquet(os.path.join(path, name)).groupBy("cell").agg(F.count(F.lit(1)), F.max("angle")).collect()
        state |= {"parts": [{"name": name, "ddl": ddl, "cells": {str(c): [n, r] for c, n, r in radii}}], "number": state["number"] + 1}
        states.commit(spark, os.path.join(path, "manifest"), state)
    return state


def _live(spark: SparkSession, path: str, state: dict, wanted: list[int] | None = None) -> DataFrame:
    """Vectors of the wanted cells that no later part replaces; only their row groups are read."""
    frames, later = [], None
    for part in reversed(state["parts"]):
        whole = spark.read.schema(part["ddl"]).parquet(os.path.join(path, part["name"]))
        rows = whole if wanted is None else whole.where(F.col("cell").isin(wanted))
        frames.append(rows if later is None else rows.join(later, "vec_id", "left_anti"))
        ids = whole.select("vec_id")
        later = ids if later is None else later.unionByName(ids)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _bounds(state: dict, qmat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, their vectors, greatest cosine that each query can have with a member of each)."""
    held: dict[int, list] = {}
    for part in state["parts"]:
        for c, (n, r) in part["cells"].items():
            old = held.setdefault(int(c), [0, 0.0])
            old[0], old[1] = old[0] + n, max(old[1], r)
    cells = np.array(sorted(held), np.int64)
    count, radius = np.array([held[c][0] for c in cells]), np.array([held[c][1] for c in cells])
    centres = np.array(state["centres"])
    bound = np.ones((len(qmat), len(cells)))
    if centres.size:
        near = np.arccos(np.clip(dense._scores(qmat, centres), -1, 1))
        some = cells >= 0
        bound[:, some] = np.cos(np.maximum(0.0, near[:, cells[some]] - radius[some]))
    bound[:, cells == ZERO] = 0.0
    return cells, count, bound


def _scan(spark: SparkSession, path: str, state: dict, schema, qids, qmat, ask: np.ndarray, cells: np.ndarray, k: int) -> DataFrame:
    """(qid, doc_id, score): per task the k best of each query among the cells it asks for (a row of ``ask`` per query)."""
    use = ask.any(0)
    shared = spark.sparkContext.broadcast((qids, qmat, {int(c): np.flatnonzero(ask[:, i]) for i, c in enumerate(cells) if use[i]}))
    rows = _live(spark, path, state, [int(c) for c in cells[use]]).select("vec_id", "cell", "unit")

    def run(batches):
        qids, qmat, asks = shared.value
        best: dict[int, dense._Best] = {}
        out = []
        for b in batches:
            ids, cell = dense._ids(b.column(0)), b.column(1).to_numpy()
            for c in np.unique(cell):
                mine = np.flatnonzero(cell == c)
                unit = dense._matrix(b.column(2).take(pa.array(mine)))
                found = best.setdefault(int(c), dense._Best(len(asks[int(c)]), k))
                for i, j in dense._blocks(len(mine), len(asks[int(c)])):
                    found.add(ids[mine[i:j]], dense._scores(unit[i:j], qmat[asks[int(c)]]))
        for c, found in best.items():
            found.cut()
            if found.ids is not None and len(found.q):
                out.append(pa.RecordBatch.from_arrays(dense._arrow(schema, qids[asks[c][found.q]], found.ids, found.score), schema.names))
        yield from out
    return rows.mapInArrow(run, schema)


def topk(spark: SparkSession, path: str, queries: DataFrame, k: int, qid_col: str = "qid", qvec_col: str = "q_emb",
         rank_col: str = "rank", read: list | None = None) -> DataFrame:
    """The rows of ``dense_topk`` over the stored vectors. ``read`` gets (cells read, cells there) of each query.

    Queries go in blocks of checked size; one block's bounds, thresholds and
    ids are held by the driver.
    """
    if k < 0:
        raise ValueError("k must be >= 0")
    state = _state(spark, path)
    kind = spark.read.schema(state["parts"][0]["ddl"]).parquet(os.path.join(path, state["parts"][0]["name"])).schema["vec_id"].dataType
    schema = T.StructType([T.StructField("qid", queries.schema[qid_col].dataType), T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
    if k == 0:
        return rank_topk(spark.createDataFrame([], schema), "qid", "score", "doc_id", k, rank_col)
    usable = dense._usable(queries, qid_col, qvec_col)
    n, floats = usable.agg(F.count(F.lit(1)), F.sum(F.size("qv"))).first()
    blocks = max(1, math.ceil((floats or 0) / dense.MAX_QUERY_FLOATS), math.ceil(n * MAX_CELLS / dense.MAX_CELLS / 8))
    tops = []
    for block in range(blocks):
        table = usable.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow()  # of checked size
        qids, qmat = dense._ids(table["qid"]), dense._matrix(table["qv"])
        cells, count, bound = _bounds(state, qmat)
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(count[order], axis=1) - count[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, (before < k) | (np.arange(len(cells)) < FIRST_CELLS), axis=1)
        near = rank_topk(_scan(spark, path, state, schema, qids, qmat, first, cells, k), "qid", "score", "doc_id", k)
        least = {r[0]: r[1] for r in near.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score"))).collect()}
        level = np.array([-2.0 if least.get(q) is None else least[q] for q in qids.tolist()])
        ask = first | (bound >= (level - SLACK)[:, None])
        if read is not None:
            read += [(int(a), len(cells)) for a in ask.sum(1)]
        tops.append(_scan(spark, path, state, schema, qids, qmat, ask, cells, k))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return rank_topk(out, "qid", "score", "doc_id", k, rank_col)
