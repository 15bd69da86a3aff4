"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked: in turn, for
each of the three attributes, every cell is scaled so that the attribute's
marginal meets its target, until all marginals agree. A document is then kept
with the probability its cell's factor has against the largest factor, so the
kept tokens meet the targets in expectation. DataFrame functions only.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sprank.llm.common import written

ATTRIBUTES = ("source", "lang", "topic")
TEMPER = 0.9      # default target of a value: its token share to this power, normalised
ROUNDS, TOLERANCE = 25, 1e-10
SEED = "mix-1"

# Fixed rules that give a document its topic, the first that holds.
TOPICS = (("table", r"\|"), ("legal", r"(?i)licen[sc]e"), ("web", r"(?i)https?://|www\.|@"), ("figures", r"[0-9]"))


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tempered(cells: DataFrame, attribute: str, power: float = TEMPER) -> DataFrame:
    """(attribute, target): shares of weight to ``power``, normalised over the values."""
    shares = cells.groupBy(attribute).agg(F.pow(F.sum("w0"), F.lit(power)).alias("p"))
    total = shares.agg(F.sum("p")).first()[0] or 1.0
    return shares.select(attribute, (F.col("p") / F.lit(total)).alias("target"))


def residuals(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Fitted cells -> (attribute, value, target, share, gap): every target against what the cells weigh.

    gap is the difference relative to the target. A value that no cell has gets
    share 0 and gap 1; a target of 0 counts its share as gap.
    """
    out = None
    for a, goal in targets.items():
        sums = cells.groupBy(a).agg(F.sum("w").alias("share"))
        share, target = F.coalesce("share", F.lit(0.0)), F.col("target")
        one = goal.join(sums, a, "left").select(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"), "target", share.alias("share"),
                                                F.when(target == 0, share).otherwise(F.abs(share / target - 1)).alias("gap"))
        out = one if out is None else out.unionByName(one)
    return out


class Unmet(ValueError):
    """Targets that raking did not reach."""


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, strict: bool = False) -> DataFrame:
    """cells (attributes, w0 > 0) -> the same with w, fitted to ``targets`` (attribute value, target).

    Stops when every marginal is within ``tolerance`` of its target, relatively,
    or after ``rounds`` rounds. Targets that the cells cannot meet (a value that
    no cell has, marginals that contradict each other) leave it as near as
    raking gets: a warning, or Unmet if ``strict``, then names the worst value,
    and ``residuals`` lists all. Values without a target keep their weight.
    """
    now = written(cells.withColumn("w", F.col("w0")), "cells")
    names = list(targets)
    goal = {a: written(t, "target") for a, t in targets.items()}
    for _ in range(rounds):
        step = now
        for a in names:
            sums = step.groupBy(a).agg(F.sum("w").alias("__s")).join(goal[a], a)
            factor = sums.select(a, (F.col("target") / F.col("__s")).alias("__f"))
            step = step.join(factor, a, "left").withColumn("w", F.col("w") * F.coalesce("__f", F.lit(1.0))).drop("__f")
        now = written(step, "cells")
        worst = residuals(now, goal).agg(F.max(F.struct("gap", "attribute", "value", "target", "share")).alias("r")).first()["r"] if goal else None
        if worst is None or worst["gap"] <= tolerance:
            return now
    text = f"raking left {worst['attribute']} {worst['value']!r} at {worst['share']:.6g} against a target of {worst['target']:.6g} after {rounds} rounds"
    if strict:
        raise Unmet(text)
    warnings.warn(text, RuntimeWarning, stacklevel=2)
    return now


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens, the three attributes); a null value is a value of its own ('', others begin with '=')."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    return docs.select("doc_id", tokens_of(F.col("text")).alias("tokens"), named(F.col("source")).alias("source"),
                       named(F.col("lang")).alias("lang"), topic_of(F.coalesce("text", F.lit(""))).alias("topic"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by doc_id and seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, strict: bool = False) -> DataFrame:
    """documents -> (doc_id, tokens, topic, probability, kept), one row per input row.

    Without ``targets`` each attribute's target is its tempered token shares.
    Null attributes are a value of their own; documents without tokens (null or
    empty texts) weigh nothing and are kept with probability 1; repeated rows
    of a doc_id share their fate. An empty table gives an empty result. Targets
    that are not reached give a warning, or Unmet if ``strict`` (see ``rake``).
    """
    rows = written(_marked(docs), "marked")
    w = rows.where("tokens > 0").groupBy(*ATTRIBUTES).agg(F.sum("tokens").cast("double").alias("n"))
    total = rows.agg(F.sum("tokens")).first()[0] or 1
    cells = written(w.select(*ATTRIBUTES, (F.col("n") / F.lit(float(total))).alias("w0")), "shares")
    fitted = rake(cells, targets or {a: tempered(cells, a) for a in ATTRIBUTES}, strict=strict)
    most = fitted.agg(F.max(F.col("w") / F.col("w0"))).first()[0] or 1.0
    factor = fitted.select(*ATTRIBUTES, (F.col("w") / F.col("w0") / F.lit(most)).alias("p"))
    out = rows.join(factor, list(ATTRIBUTES), "left")
    p = F.round(F.when(F.col("tokens") == 0, 1.0).otherwise(F.col("p")), 6)
    return out.select("doc_id", "tokens", "topic", p.alias("probability"), (draw(F.col("doc_id")) < p).alias("kept"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The documents that the calibrated sample keeps, with the columns they came with."""
    gone = mixed(docs, targets).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")


def oracle(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the rows of ``mixed`` over documents."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text,''), '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    ctes = [f"""marked AS MATERIALIZED (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens,
  coalesce('=' || source, '') AS source, coalesce('=' || lang, '') AS lang, {topic} AS topic FROM documents)""",
            """c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) / (SELECT CAST(sum(tokens) AS DOUBLE) FROM marked) AS w0,
  CAST(sum(tokens) AS DOUBLE) / (SELECT CAST(sum(tokens) AS DOUBLE) FROM marked) AS w FROM marked WHERE tokens > 0 GROUP BY ALL)"""]
    for a in ATTRIBUTES:
        ctes.append(f"t_{a} AS MATERIALIZED (SELECT {a}, pow(sum(w0), {TEMPER}) / sum(pow(sum(w0), {TEMPER})) OVER () AS target FROM c0 GROUP BY {a})")
    n = 0
    for _ in range(rounds):
        for a in ATTRIBUTES:
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, w0, w * target / sum(w) OVER (PARTITION BY c.{a}) AS w FROM c{n} c JOIN t_{a} t ON c.{a} = t.{a})")
            n += 1
    ctes.append(f"f AS MATERIALIZED (SELECT source, lang, topic, (w / w0) / max(w / w0) OVER () AS p FROM c{n})")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, tokens, topic, probability, (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 8)) AS UBIGINT) / 4294967296.0) < probability AS kept
FROM (SELECT m.doc_id, m.tokens, m.topic, round(CASE WHEN tokens = 0 THEN 1.0 ELSE p END, 6) AS probability
      FROM marked m LEFT JOIN f ON m.source = f.source AND m.lang = f.lang AND m.topic = f.topic)"""
