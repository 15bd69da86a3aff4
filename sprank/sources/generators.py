"""Synthetic document generators, as native column expressions over an id
column (``spark.range`` or any table's ids): no rows are built on the driver.

Random choices are ``xxhash64(id, seed, salt)``-based, so they are
deterministic and independent of partitioning (the same shape as the
reference generators, not the same random draws).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Subjects and sentences of the sample documents; callers may pass their own.
TOPICS = ["query planning", "columnar storage", "stream joins", "text indexing", "vector search", "load balancing",
          "schema changes", "data quality", "cost models", "fault recovery"]
INTRO = "These notes are about %s. "
BODY = "They start from a small example, say what breaks at size, and close with open points."
ORIGIN, MADE_ON, AUTHORS = "sample", "2020-01-01", 10


def _draw(id_col: Column, seed: int, salt: int, k: int) -> Column:
    """Deterministic integer in [0, k) per row."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed), F.lit(salt)), F.lit(k))


def topic_documents(ids: DataFrame, id_col: str = "id", seed: int = 42,
                    topics: list[str] = TOPICS) -> DataFrame:
    """Sample documents: 1-3 distinct topics, content naming them, its length,
    metadata (source, created, one of AUTHORS writers), id ``doc_%04d``."""
    i = F.col(id_col)
    pool = F.array(*[F.lit(t) for t in topics])
    # Shuffle the pool by a per-row hash of each topic, take the first 1-3.
    order = F.transform(pool, lambda t: F.struct(F.xxhash64(i, F.lit(seed), t).alias("h"), t.alias("t")))
    n = _draw(i, seed, 1, 3) + 1
    chosen = F.transform(F.slice(F.array_sort(order), 1, n), lambda s: s["t"])
    content = F.concat(F.format_string(INTRO, F.array_join(chosen, ", ")), F.lit(BODY))
    return ids.select(
        F.format_string("doc_%04d", i).alias("id"),
        content.alias("content"),
        chosen.alias("topics"),
        F.length(content).alias("length"),
        F.struct(F.lit(ORIGIN).alias("source"), F.lit(MADE_ON).alias("created"),
                 F.concat(F.lit("writer_"), (_draw(i, seed, 2, AUTHORS) + 1).cast("string")).alias("author"))
        .alias("metadata"))


def template_articles(ids: DataFrame, domains: dict[str, list[str]], sentences: list[str],
                      id_col: str = "id", seed: int = 42, paragraphs: int = 5) -> DataFrame:
    """Templated multi-paragraph articles: per row a domain, and per paragraph
    a sentence template (``%s`` = a keyword of the domain)."""
    i = F.col(id_col)
    names = list(domains)
    dom = F.element_at(F.array(*[F.lit(d) for d in names]), (_draw(i, seed, 0, len(names)) + 1).cast("int"))
    kw = F.create_map(*[x for d in names for x in (F.lit(d), F.array(*[F.lit(w) for w in domains[d]]))])
    words = F.element_at(kw, dom)
    tmpl = F.array(*[F.lit(s) for s in sentences])
    paras = []
    for p in range(paragraphs):
        s = F.element_at(tmpl, (_draw(i, seed, 10 + p, len(sentences)) + 1).cast("int"))
        w = F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(100 + p)), F.size(words)) + 1).cast("int"))
        paras.append(F.replace(s, F.lit("%s"), w))  # the template is per row
    return ids.select(F.format_string("article_%04d", i).alias("doc_id"), dom.alias("domain"),
                      F.concat_ws("\n\n", *paras).alias("content"))
