"""Incremental keyword index: append a batch of postings with upsert by id.

Postings of documents that appear again in the new batch are dropped (latest
version wins), then the new postings are added; vocabulary and statistics are
derived again from the combined postings (``bm25.index_from_postings``), which
equals a full rebuild. Work is proportional to the postings; the anti join is
left to Spark, which broadcasts the batch's ids below its size threshold and
else joins by ``doc_id``, along which stored postings are bucketed already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    ids = new.where(F.col("first")).select("doc_id")
    kept = old.join(ids, "doc_id", "left_anti")
    return kept.unionByName(new.select(*kept.columns))


def append_vectors(old: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Dense side of an append: the newest vector per id wins; ids are keys, so
    vectors and ids cannot drift apart."""
    return old.join(new.select(id_col), id_col, "left_anti").unionByName(new.select(*old.columns))
