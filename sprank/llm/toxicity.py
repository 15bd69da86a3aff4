"""Toxicity by FTRL-proximal logistic regression over hashed word grams.

Features are words, pairs of adjacent words and pairs with one word between
them, lower-cased and hashed; a document has each feature once or not. FTRL
keeps a rate per coordinate and an L1 penalty, so most weights are exactly
zero and the learned table is small enough to ship to every task (it never has
more than 2^DIM_BITS entries).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sprank.llm.common import (NON_WORD, _GRAM, flat_utf8, lower_ascii, mix, prefix_hash, row_chunks, span_hash,
                               word_spans)

DIM_BITS = 22
TRAIN_ROWS = 16_000  # bound of the labelled sample, least hash of doc_id first
HASH_CELLS = 16      # bits of that hash by which the sample is cut before it is sorted
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.1


def features(buf: np.ndarray, offsets: np.ndarray, bits: int = DIM_BITS):
    """Yields (first row, feature, row bounds) for chunks of rows; features repeat as they occur."""
    for i, j in row_chunks(offsets, 1 << 19):
        part, off = lower_ascii(buf[offsets[i]:offsets[j]]), offsets[i:j + 1] - offsets[i]
        start, end, bounds = word_spans(part, off, NON_WORD)
        words = span_hash(prefix_hash(part), start, end)
        row = np.repeat(np.arange(j - i), np.diff(bounds))
        found, rows = [words], [row]
        for gap in (1, 2):
            same = row[gap:] == row[:-gap]
            found.append(mix(words[:-gap][same] * np.uint64(_GRAM) + words[gap:][same] + np.uint64(gap)))
            rows.append(row[gap:][same])
        f = (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)
        r = np.concatenate(rows)
        order = np.argsort(r, kind="stable")
        yield i, f[order], np.searchsorted(r[order], np.arange(j - i + 1))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = DIM_BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature, weight) of the non-zero weights and the bias; rows hold distinct features."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(x):
        zx = z[x]
        l1 = np.where(x == bias, 0.0, L1)
        return np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((BETA + np.sqrt(n[x])) / ALPHA + L2))
    for _ in range(epochs):
        for f, y in zip(rows, labels, strict=True):
            x = np.append(f, bias)
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            s = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - s * w
            n[x] += g * g
    hit = np.flatnonzero((z[:-1] > L1) | (z[:-1] < -L1))  # all others are zero
    return hit, weights(hit), float(weights(np.array([bias]))[0])


def sample_ids(rows: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id of the ``limit`` rows of least hash.

    Counts by cell of the hash say up to which cell rows can be wanted, so that
    about ``limit`` rows are sorted, not ``limit`` of every partition.
    """
    at = F.xxhash64("doc_id", F.lit(5))
    cell = F.shiftright(at, 64 - HASH_CELLS).cast("int")
    w = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # 2^HASH_CELLS rows at most
    cells = rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    last = cells.where(F.col("before") < limit).agg(F.max("cell")).first()[0]
    return (rows.where(cell <= F.lit(last)).select(at.alias("at"), "doc_id", "label")
            .orderBy("at", "doc_id").limit(limit).select("doc_id"))


def train(rows: DataFrame, limit: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(doc_id, text, label) -> weights, from a bounded sample of at most ``limit`` labelled rows.

    Features are extracted where the texts lie; one task then runs the
    sequential learner over the sample. With no labelled row, or labels all
    alike, the bias alone speaks (probability 0 if there is none).
    """
    def extract(batches):
        for b in batches:
            buf, off = flat_utf8(b.column(1))
            out = [np.empty(0, np.int32)] * b.num_rows
            for first, f, bounds in features(buf, off):
                for r in range(len(bounds) - 1):
                    out[first + r] = np.unique(f[bounds[r]:bounds[r + 1]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.tobytes() for x in out], pa.binary())], ["at", "label", "f"])

    def learn(part: pa.Table) -> pa.Table:
        rows = []  # views of the features as they came
        for chunk in part["f"].chunks:
            buf, off = flat_utf8(chunk)
            rows += [buf[i:j].view(np.int32) for i, j in zip(off[:-1], off[1:], strict=True)]
        label = part["label"].to_numpy()
        order = np.lexsort((label, part["at"].to_numpy()))
        f, w, bias = ftrl([rows[i] for i in order], label[order].astype(float))
        return pa.table({"f": np.append(f, -1), "w": np.append(w, bias)})

    at = F.xxhash64("doc_id", F.lit(5))
    ids = sample_ids(rows, limit)
    chosen = rows.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select(at.alias("at"), "text", "label")
    model = (chosen.mapInArrow(extract, "at long, label int, f binary").groupBy(F.lit(0).alias("one"))
             .applyInArrow(learn, "f long, w double").toPandas())
    if not len(model):
        return np.zeros(0, np.int64), np.zeros(0), -35.0
    bias = model["f"] < 0
    return model["f"][~bias].to_numpy(np.int64), model["w"][~bias].to_numpy(), float(model["w"][bias].iloc[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str], name: str = "score") -> DataFrame:
    """Adds ``name``, the probability of label 1, to the ``keep`` columns; reads nothing but ``text`` to do so."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches):
        f, w, bias = shared.value
        dense = np.zeros(1 << DIM_BITS, np.float32)
        dense[f] = w
        for b in batches:
            buf, off = flat_utf8(b.column("text"))
            total = np.full(b.num_rows, bias)
            for first, x, bounds in features(buf, off):
                hit = np.flatnonzero(dense[x])
                row = np.searchsorted(bounds, hit, side="right") - 1
                pair = np.unique(row << DIM_BITS | x[hit])  # a feature counts once in a document
                np.add.at(total, first + (pair >> DIM_BITS), dense[pair & ((1 << DIM_BITS) - 1)])
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(p)], names=schema.names)
    return docs.select(*keep, *({"text"} - set(keep))).mapInArrow(run, schema)


def learn_labels(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Model from ``labels`` (doc_id, toxic), without rows whose crc32 of doc_id as text is divisible by 5.

    Null ids and null labels teach nothing; a document labelled several times is toxic if any of them says so.
    """
    known = (labels.where("doc_id is not null and toxic is not null")
             .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")))
    return train(docs.select("doc_id", "text").join(known, "doc_id"), limit)


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted), one row per input row.

    Null and empty texts are scored by the bias alone. A null doc_id is not held
    out. Rows that repeat a labelled doc_id each teach, and count towards
    ``limit``. An empty table gives an empty result; without labels every score
    is 0. Columns other than doc_id and text are not read.
    """
    model = learn_labels(docs, labels, limit)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = score(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose score is under 0.5, with the columns they came with."""
    model = learn_labels(docs, labels, limit)
    mark = "__toxic"
    return score(docs, model, docs.columns, mark).where(F.col(mark) < 0.5).drop(mark)
