"""Reranking of (query, content) candidate pairs.

The default scorer is native: |distinct query tokens & distinct content
tokens| / |distinct query tokens| (0 for an empty query), computed with array
set functions inside the JVM. A model scorer (e.g. a cross-encoder) plugs in
by name through ``register_scorer`` and runs as an iterator Pandas UDF with
the model cached per Python worker process; only the model name travels in
the closure.

Candidates are cut *before* scoring (the plan ranks, filters, then calls the
scorer), because Catalyst does not move a Python UDF below a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sprank.functions.ranking import rank_topk
from sprank.functions.text import tokens

# Reference defaults for the rerank cut and the threshold filter.
DEFAULT_TOP_K = 5
DEFAULT_THRESHOLD = 0.5

_LOADERS: dict[str, Callable[[], Callable[[list[str], list[str]], np.ndarray]]] = {}
_CACHE: dict[str, Callable] = {}


def overlap_score(query, content) -> Column:
    qd = F.array_distinct(tokens(query))
    cd = F.array_distinct(tokens(content))
    nq = F.size(qd)
    return F.when(nq > 0, F.size(F.array_intersect(qd, cd)) / nq).otherwise(F.lit(0.0))


def _overlap_py(queries: list[str], contents: list[str]) -> np.ndarray:
    out = np.zeros(len(queries))
    for i, (q, c) in enumerate(zip(queries, contents)):
        qs = set((q or "").split())
        if qs:
            out[i] = len(qs & set((c or "").split())) / len(qs)
    return out


def register_scorer(name: str, loader: Callable[[], Callable[[list[str], list[str]], np.ndarray]]):
    """``loader()`` returns ``score(queries, contents) -> array``; called once per worker."""
    _LOADERS[name] = loader


register_scorer("overlap-py", lambda: _overlap_py)


def _get_scorer(name: str, loader=None):
    if name not in _CACHE:
        _CACHE[name] = (loader or _LOADERS[name])()
    return _CACHE[name]


def udf_scorer(name: str, batch_size: int = 32):
    """Iterator Pandas UDF (query, content) -> double for a registered scorer.
    The loader travels in the closure; the model is loaded once per worker."""
    loader = _LOADERS[name]

    @F.pandas_udf("double")
    def score(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fn = _get_scorer(name, loader)
        for q, c in it:
            ql, cl = q.tolist(), c.tolist()
            parts = [np.asarray(fn(ql[i:i + batch_size], cl[i:i + batch_size]), dtype=float)
                     for i in range(0, len(ql), batch_size)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
    return score


def score_pairs(cands: DataFrame, query_col: str = "query", content_col: str = "content",
                scorer: str = "overlap") -> DataFrame:
    if scorer == "overlap":
        col = overlap_score(query_col, content_col)
    else:
        col = udf_scorer(scorer)(F.col(query_col), F.col(content_col))
    return cands.withColumn("rerank_score", col)


def rerank(cands: DataFrame, top_k: int = DEFAULT_TOP_K, scorer: str = "overlap",
           query_col: str = "query", content_col: str = "content",
           prior_rank: str = "rank") -> DataFrame:
    """Score every candidate, stable sort by rerank score desc (ties keep the
    prior order), keep ``top_k`` per query. Adds ``rerank_score``, ``rerank_rank``."""
    scored = score_pairs(cands, query_col, content_col, scorer)
    return rank_topk(scored, "qid", "rerank_score", "doc_id", top_k, "rerank_rank",
                     extra_order=[F.col(prior_rank).asc()])


def rerank_threshold(cands: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                     scorer: str = "overlap", query_col: str = "query",
                     content_col: str = "content") -> DataFrame:
    """Rerank all candidates and keep those with ``rerank_score >= threshold``."""
    return score_pairs(cands, query_col, content_col, scorer).where(
        F.col("rerank_score") >= threshold)
