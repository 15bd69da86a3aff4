"""Dense top-k by cells is exact, reads few cells of clustered vectors, and follows appends."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sprank.operators import cells, dense

SCHEMA = "vec_id string, embedding array<float>"


def rows(df):
    return sorted((r.qid, r.rank, r.doc_id, round(r.score, 9)) for r in df.collect())


def test_exact_with_appends_and_skips(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    data = [(f"v{i:04d}", [float(x) for x in centres[i % 30] + 0.05 * rng.normal(size=8)]) for i in range(1500)]
    data += [(f"hot{i:03d}", data[0][1]) for i in range(700)] + [("zero", [0.0] * 8), ("none", None), ("short", [1.0])]
    queries = [(i, [float(x) for x in centres[i] + 0.05 * rng.normal(size=8)]) for i in range(5)] + [(90, [0.0] * 8), (91, None), (92, [-float(x) for x in centres[0]])]
    q = spark.createDataFrame(queries, "qid long, q_emb array<float>")
    path = str(tmp_path / "c")
    old = [(i, v) for i, v in data if i < "v0900" or i in ("none", "short")] + [(f"v{i:04d}", [1.0] * 8) for i in range(1000, 1100)]
    new = [x for x in data if x not in old]
    for part in (old, new):
        cells.append(spark, path, spark.createDataFrame(part, SCHEMA).repartition(3))
    want = dense.dense_topk(spark.createDataFrame(data, SCHEMA), q, 10)
    read: list = []
    assert rows(cells.topk(spark, path, q, 10, read=read)) == rows(want)
    assert len(read) == 6 and sum(a for a, _ in read[:5]) < 0.5 * sum(b for _, b in read[:5])
    before = cells._state(spark, path)["number"]
    assert len(cells.compact(spark, path)["parts"]) == 1 and cells._state(spark, path)["number"] == before + 1
    assert rows(cells.topk(spark, path, q, 10)) == rows(want)
    assert cells.topk(spark, path, q, 0).count() == 0
    few = cells.topk(spark, path, q, 3000)
    assert few.where("qid = 92").count() == len(data)


def test_without_any_direction(spark, tmp_path):
    path = str(tmp_path / "c")
    cells.append(spark, path, spark.createDataFrame([("a", [0.0, 0.0]), ("b", None)], SCHEMA))
    cells.append(spark, path, spark.createDataFrame([("c", [1.0, 0.0]), ("a", [0.0, 1.0])], SCHEMA))
    q = spark.createDataFrame([(1, [1.0, 0.1])], "qid long, q_emb array<float>")
    got = [(r.doc_id, round(r.score, 6)) for r in cells.topk(spark, path, q, 3).orderBy("rank").collect()]
    assert got == [("c", 0.995037), ("a", 0.099504), ("b", 0.0)]


def test_only_the_asked_cells_are_read(spark, tmp_path):
    path = str(tmp_path / "c")
    data = spark.range(4000).select(F.col("id").cast("string").alias("vec_id"), F.array(
        F.cos(F.col("id") % 4), F.sin(F.col("id") % 4), F.rand(1) / 100).cast("array<float>").alias("embedding"))
    cells.append(spark, path, data, cells=4)
    plan = cells._live(spark, path, cells._state(spark, path), [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(cell, [1,2])" in plan
