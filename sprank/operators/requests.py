"""A table of search requests, each with its own ``top_k``, ``alpha``, ``rerank`` and ``filters``, answered in one job.

requests (qid, query, q_emb, top_k, alpha, rerank, filters) -> the rows that
``search`` would give each of them on its own. Lists are cut to the greatest k
of all requests before their shuffle and to each request's own k after it.

``filters`` (map of attribute to value) restrict a request to the documents
whose attributes all match. They are applied before any list is cut, and a
short keyword list is filled with documents that match; corpus statistics stay
those of the whole corpus. Equal filters are one filter set; the documents of
all sets are found in one pass by a join on one attribute and value each (no
cross join), and travel as a list of sets per document, so scores are checked
where they are made, by ``doc_id``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprank.functions.ranking import minmax, rank_key, rank_topk
from sprank.operators import bm25, dense
from sprank.operators import rerank as rr
from sprank.operators.fusion import HybridIndex, fuse
from sprank.operators.search import with_content
from sprank.plans.sizing import checked_broadcast
from sprank.session import checkpoint_small

# What a request that leaves a field open gets.
TOP_K, ALPHA, RERANK = 5, 0.6, True
EVERYTHING = 0  # the filter set of requests without filters


def prepared(requests: DataFrame) -> DataFrame:
    """Requests with defaults for open fields and the number of their filter set; a qid occurs once."""
    have = set(requests.columns)
    kinds = {"top_k": ("int", TOP_K), "alpha": ("double", ALPHA), "rerank": ("boolean", RERANK)}
    cols = [F.coalesce(F.col(c).cast(kind), F.lit(value)).alias(c) if c in have else F.lit(value).cast(kind).alias(c) for c, (kind, value) in kinds.items()]
    filters = F.col("filters") if "filters" in have else F.lit(None).cast("map<string,string>")
    entries = F.sort_array(F.map_entries(filters))
    entries = F.when(F.size(entries) > 0, entries)
    r = requests.select("qid", "query", "q_emb", *cols, entries.alias("entries")).where("qid is not null")
    sets = r.where("entries is not null").select("entries").distinct()
    sets = sets.withColumn("fid", F.row_number().over(Window.orderBy("entries")))  # distinct filter sets of the requests only
    r = r.join(sets, "entries", "left")
    return checkpoint_small(r.withColumn("fid", F.coalesce("fid", F.lit(EVERYTHING))))


def memberships(requests: DataFrame, attributes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fids): the filter sets that a document matches; documents without one are left out."""
    sets = requests.where(F.col("fid") != EVERYTHING).select(
        "fid", F.col("entries")[0]["key"].alias("key"), F.col("entries")[0]["value"].alias("value"), "entries").distinct()
    names = [c for c in attributes.columns if c != id_col]
    if not names:
        raise ValueError("filters need attributes")
    has = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))])
    rows = attributes.select(F.col(id_col).alias("doc_id"), has.alias("has")).select("doc_id", "has", F.explode("has").alias("key", "value"))
    pairs = rows.join(checked_broadcast(sets, what="filter sets")[0], ["key", "value"]).where(
        F.forall("entries", lambda e: F.coalesce(F.element_at("has", e["key"]) == e["value"], F.lit(False))))
    return pairs.groupBy("doc_id").agg(F.collect_set("fid").alias("fids"))


def _matching(scores: DataFrame, asked: DataFrame, members: DataFrame | None) -> DataFrame:
    """Scores (qid, doc_id, score) of documents that their request's filters let through."""
    scores = scores.join(checked_broadcast(asked.select("qid", "fid"), what="requests")[0], "qid")
    if members is None:
        return scores
    free = scores.where(F.col("fid") == EVERYTHING)
    bound = scores.where(F.col("fid") != EVERYTHING).join(members, "doc_id").where(F.array_contains("fids", F.col("fid"))).drop("fids")
    return free.unionByName(bound)


def _own_k(ranked: DataFrame, asked: DataFrame, rank: str, times: int) -> DataFrame:
    own = checked_broadcast(asked.select("qid", F.col("top_k").alias("__k")), what="requests")[0]
    return ranked.join(own, "qid").where(F.col(rank) <= F.col("__k") * times).drop("__k")


def _fill(index: bm25.BM25Index, asked: DataFrame, matched: DataFrame, members: DataFrame | None, k: int) -> DataFrame:
    """(qid, doc_id): for each request its smallest documents by id that it does not match, among those its filters let through.

    With no negative idf the first k ids of its filter set are enough, matched or not.
    """
    docs = index.doc_ids.withColumn("fid", F.lit(EVERYTHING))
    if members is not None:
        docs = docs.unionByName(members.join(index.doc_ids, "doc_id", "left_semi").select("doc_id", F.explode("fids").alias("fid")))
    asked = asked.select("qid", "fid")
    if index.stats["eps"] >= 0:
        w = Window.partitionBy("fid").orderBy("doc_id")
        first = docs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")
        return first.join(asked, "fid").select("qid", "doc_id")
    slots = max(1, math.ceil(index.stats["n"] / bm25.SLOT_DOCS))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    kind = index.doc_ids.schema["doc_id"].dataType
    everywhere = asked.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    pairs = matched.select("qid", "doc_id", "fid", slot.alias("slot")).unionByName(everywhere.withColumn("doc_id", F.lit(None).cast(kind)))
    out = T.StructType([asked.schema["qid"], T.StructField("doc_id", kind)])

    def smallest(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(docs["id"].to_numpy())
        found = []
        for qid, mine in pairs.groupby("qid")["doc_id"]:
            hit = np.searchsorted(ids, mine.dropna().astype(docs["id"].dtype).to_numpy())
            near = np.arange(min(len(ids), k + len(hit)))
            found += [(qid, x) for x in ids[np.setdiff1d(near, hit)[:k]]]
        return pd.DataFrame(found, columns=["qid", "doc_id"])
    docs = docs.select(F.col("doc_id").alias("id"), F.col("fid").alias("f"), slot.alias("at"))
    return docs.groupBy("f", "at").cogroup(pairs.groupBy("fid", "slot")).applyInPandas(smallest, out)


def keyword_lists(index: bm25.BM25Index, asked: DataFrame, members: DataFrame | None, k: int) -> DataFrame:
    """(qid, doc_id, score): the keyword list of each request, of up to k rows."""
    scores = _matching(bm25.bm25_scores(index, asked), asked, members)
    top = rank_topk(scores, "qid", "score", "doc_id", k, "__r").select("qid", "doc_id", "score", F.lit(True).alias("m"))
    fill = _fill(index, asked, scores, members, k).select("qid", "doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("m"))
    best = top.unionByName(fill).groupBy("qid", "doc_id").agg(F.max_by("score", "m").alias("score"))
    return rank_topk(best, "qid", "score", "doc_id", k, "list_rank")


def dense_lists(vectors: DataFrame, asked: DataFrame, members: DataFrame | None, k: int, id_col: str, vec_col: str) -> DataFrame:
    """(qid, doc_id, score): the dense list of each request, of up to k rows.

    Requests are shipped in blocks of checked size; a task scores its vectors
    against the requests of each filter set they are in, and keeps the k best.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("v"))
    none = F.array().cast("array<int>")
    rows = rows.withColumn("fids", none) if members is None else rows.join(members, "doc_id", "left").withColumn("fids", F.coalesce("fids", none))
    usable = asked.select("qid", "fid", F.col("q_emb").alias("qv")).where(F.col("qv").isNotNull() & (dense.l2_norm("qv") >= dense.NORM_FLOOR))
    schema = T.StructType([asked.schema["qid"], T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    blocks = max(1, math.ceil((usable.agg(F.sum(F.size("qv"))).first()[0] or 0) / dense.MAX_QUERY_FLOATS))
    tops = []
    for block in range(blocks):
        table = usable.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow()  # of checked size
        shared = spark.sparkContext.broadcast((dense._ids(table["qid"]), dense._matrix(table["qv"]), table["fid"].to_numpy()))

        def run(batches, shared=shared):
            qids, qmat, fids = shared.value
            best = {f: dense._Best(int((fids == f).sum()), k) for f in np.unique(fids)}
            for b in batches:
                if not b.num_rows:
                    continue
                ids, unit, sets = dense._ids(b.column(0)), dense._matrix(b.column(1)), b.column(2)
                row = np.repeat(np.arange(b.num_rows), np.diff(sets.offsets.to_numpy()))
                which = sets.flatten().to_numpy(zero_copy_only=False)
                for f, found in best.items():
                    use = np.arange(b.num_rows) if f == EVERYTHING else row[which == f]
                    for i, j in dense._blocks(len(use), int((fids == f).sum())):
                        found.add(ids[use[i:j]], dense._scores(unit[use[i:j]], qmat[fids == f]))
            for f, found in best.items():
                found.cut()
                if found.ids is not None and len(found.q):
                    yield pa.RecordBatch.from_arrays(dense._arrow(schema, qids[fids == f][found.q], found.ids, found.score), schema.names)
        tops.append(rows.mapInArrow(run, schema))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return rank_topk(out, "qid", "score", "doc_id", k, "list_rank")


def search_requests(index: HybridIndex, requests: DataFrame, content: DataFrame, attributes: DataFrame | None = None,
                    scorer: str = "overlap") -> DataFrame:
    """requests -> (qid, rank, doc_id, content, score, rerank_score, query), up to ``top_k`` rows each.

    Open (null or absent) fields get the defaults; a ``top_k`` below 1 has no
    rows, an empty filter map is no filter, and a document without a filtered
    attribute does not match. ``attributes`` (doc_id, columns) is needed where
    a request has filters.
    """
    asked = prepared(requests)
    most, filtered = asked.agg(F.max("top_k"), F.max("fid")).first()
    k = 4 * max(1, most or 0)
    members = None
    if filtered:
        if attributes is None:
            raise ValueError("filters need attributes")
        members = memberships(asked, attributes)
    lists = keyword_lists(index.bm25, asked, members, k).withColumn("list", F.lit("sparse"))
    if index.vectors is not None:
        lists = lists.unionByName(dense_lists(index.vectors, asked, members, k, index.vec_id, index.vec_col).withColumn("list", F.lit("dense")))
    lists = _own_k(lists, asked, "list_rank", 4).withColumnRenamed("score", "raw")
    fields = checked_broadcast(asked.select("qid", "query", "alpha", "rerank", "top_k"), what="requests")[0]
    fused = fuse(minmax(lists, ["qid", "list"], "raw", "norm").join(fields.select("qid", "alpha"), "qid"), "alpha").drop("alpha")
    hits = _own_k(rank_topk(fused, "qid", "score", "doc_id", k // 2), asked, "rank", 2)
    c = with_content(hits, content).join(fields, "qid")
    scored = rr.score_pairs(c.where("rerank"), scorer=scorer).unionByName(c.where("not rerank").withColumn("rerank_score", F.lit(None).cast("double")))
    w = Window.partitionBy("qid").orderBy(rank_key("rerank_score").desc(), "rank", "doc_id")
    out = scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.col("top_k"))
    return out.select("qid", F.col("__r").alias("rank"), "doc_id", "content", "score", "rerank_score", "query")
