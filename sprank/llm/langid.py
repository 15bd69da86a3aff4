"""Language identification by prediction by partial matching over bytes.

Per language a variable-order byte context tree (orders 0 to 3) gives each next
byte a probability: in a context seen n times with d distinct successors, a
seen byte of count c has c / (n + d), and the escape to the next shorter
context d / (n + d); a context not seen costs nothing to leave, and below order
0 all 256 bytes are alike. A text starts as if three zero bytes stood before it.
No context or byte value is left out. The counts are
frozen after training, so a byte's code length depends only on the three bytes
before it, and whole texts are scored by table lookups. The language with the
shortest exact code length is predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sprank.llm.common import flat_utf8, row_chunks, written

ORDER = 3
TRAIN_DOCS_PER_LANG = 2000  # bound of the labelled sample, whole texts, least hash of doc_id first
BROADCAST_ROWS = 200_000    # larger samples (very many labels) are joined by shuffle
TRAIN_BYTES_PER_LANG = 64 << 20  # and of its bytes; the first text of a label always counts
UNSEEN = 8.0                # bits of a byte below order 0: all 256 are alike
CHUNK_BYTES = 1 << 18
HASH_CELLS = 16             # bits of the hash of doc_id by which the sample is cut before it is ranked
_MODELS: dict[str, "Model"] = {}


def _grams(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte of each row: the three bytes before it (zeros before a row's start) and itself, as one number."""
    n = np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))
    g = buf.astype(np.uint32)
    for back in (1, 2, 3):
        prev = np.zeros(len(buf), np.uint32)
        prev[back:] = buf[:-back]
        prev[n < back] = 0
        g |= prev << np.uint32(8 * back)
    return g


def gram_counts(rows: DataFrame) -> DataFrame:
    """(label, text) -> (label, gram, n): counts of every byte with its three predecessors."""
    def run(batches):
        for b in batches:
            labels = b.column(0).dictionary_encode()
            buf, off = flat_utf8(b.column(1))
            code = labels.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(labels.dictionary.to_pylist()):
                mine = np.flatnonzero(code == i)
                grams = [_grams(buf[off[r]:off[r + 1]], np.array([0, off[r + 1] - off[r]])) for r in mine if off[r + 1] > off[r]]
                if grams:
                    g, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["label", "gram", "n"])
    return rows.select("label", "text").mapInArrow(run, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Lookup tables of the frozen trees.

    Of each order: the sorted grams (context and byte) that any language has
    seen with their code lengths by language, and the sorted contexts with the
    lengths of their escapes. Every byte value and every context counts.
    """

    def __init__(self, labels: list[str], which: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.labels, k = labels, len(labels)
        self.orders = []
        shorter = None
        for order in range(ORDER + 1):
            part = gram & ((1 << 8 * (order + 1)) - 1)
            keys, inv = np.unique(part, return_inverse=True)
            cell = np.bincount(inv * k + which, weights=n, minlength=len(keys) * k).reshape(len(keys), k)
            first = np.flatnonzero(np.diff(keys >> 8, prepend=-1))
            size = np.add.reduceat(cell, first)
            kinds = np.add.reduceat((cell > 0).astype(np.float64), first)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(size > 0, np.log2((size + kinds) / kinds), 0.0)
                of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
                below = UNSEEN if order == 0 else shorter[1][np.searchsorted(shorter[0], keys & ((1 << 8 * order) - 1))]
                cost = np.where(cell > 0, np.log2((size + kinds)[of] / cell), escape[of] + below)
            shorter = keys, cost
            self.orders.append((keys.astype(np.uint32), cost.astype(np.float32), (keys[first] >> 8).astype(np.uint32), escape.astype(np.float32)))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each gram under each language."""
        out = np.zeros((len(grams), len(self.labels)), np.float32)
        left = np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            keys, cost, contexts, escape = self.orders[order]
            g = grams[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            known = keys[at] == g
            if order == ORDER and known.all():
                return cost[at]
            out[left[known]] += cost[at[known]]
            left, context = left[~known], g[~known] >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            out[left] += np.where((contexts[at] == context)[:, None], escape[at], np.float32(0))
        out[left] += np.float32(UNSEEN)
        return out

    def lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each row under each language; long rows go piece by piece."""
        out = np.zeros((len(offsets) - 1, len(self.labels)))
        for i, j in row_chunks(offsets, CHUNK_BYTES):
            off = offsets[i:j + 1] - offsets[i]
            grams = _grams(buf[offsets[i]:offsets[j]], off)
            for lo in range(0, len(grams), 2 * CHUNK_BYTES):
                bits = self.costs(grams[lo:lo + 2 * CHUNK_BYTES])
                cut = np.clip(off - lo, 0, len(bits))
                full = np.diff(cut) > 0
                out[i:j][full] += np.add.reduceat(bits, cut[:-1][full], axis=0, dtype=np.float64)
        return out


def sample_ids(rows: DataFrame, per_label: int, per_label_bytes: int) -> DataFrame:
    """(doc_id, label) of the sample that ``train`` describes.

    Counts by label and cell of the hash say up to which cell a label's rows
    can be wanted, so that only those few are ranked and no task sorts a label.
    """
    at = F.xxhash64("doc_id", F.lit(3))
    rows = rows.select("doc_id", "label", F.octet_length("text").cast("long").alias("size"), at.alias("at"),
                       F.shiftright(at, 64 - HASH_CELLS).cast("int").alias("cell"))
    before = Window.partitionBy("label").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (rows.groupBy("label", "cell").agg(F.countDistinct("doc_id").alias("n"))
             .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    last = written(cells.where(F.col("before") < per_label).groupBy("label").agg(F.max("cell").alias("last")), "last")
    if last.count() <= BROADCAST_ROWS:  # a row per label; the rows of a common label then stay where they are
        last = F.broadcast(last)
    near = rows.join(last, "label").where("cell <= last").groupBy("label", "doc_id", "at").agg(F.max("size").alias("size"))
    w = Window.partitionBy("label").orderBy("at", "doc_id")
    near = near.withColumn("n", F.row_number().over(w)).withColumn("bytes", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return near.where((F.col("n") <= per_label) & ((F.col("bytes") <= per_label_bytes) | (F.col("n") == 1))).select("doc_id", "label")


def train(rows: DataFrame, per_label: int = TRAIN_DOCS_PER_LANG,
          per_label_bytes: int = TRAIN_BYTES_PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, label, text) -> labels and counts of the grams of a bounded sample.

    The sample is, for each label, the whole texts of the ``per_label`` doc_ids
    of least hash, as far as they hold ``per_label_bytes`` bytes (the first
    always counts); the counts the driver gets are bounded by it. Rows with a
    null in any of the three columns are left out; rows that repeat a sampled
    doc_id and label all teach. An empty table teaches nothing.
    """
    rows = rows.where("doc_id is not null and label is not null and text is not null")
    ids = written(sample_ids(rows, per_label, per_label_bytes), "sample")
    if ids.count() <= BROADCAST_ROWS:  # per_label rows for each of a few labels: the texts then stay where they are
        ids = F.broadcast(ids)
    got = gram_counts(rows.join(ids, ["doc_id", "label"], "left_semi")).toPandas()
    labels = sorted(got["label"].unique())
    which = got["label"].map({x: i for i, x in enumerate(labels)}).to_numpy(np.int64)
    return labels, which, got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.float64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, counts: tuple, keep: list[str]) -> DataFrame:
    """Adds lang_pred and score to the ``keep`` columns of ``docs``; reads nothing but ``text`` to do so.

    score is the posterior of the predicted language under equal priors. Null
    texts, texts with no letter, and all texts if nothing was learned, get
    'und' and 0. Ties go to the first label in order.
    """
    spark = docs.sparkSession
    labels = counts[0]
    if not labels:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(counts)
    key = str(id(shared)) + spark.sparkContext.applicationId
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(*shared.value)
        model = _MODELS[key]
        for b in batches:
            text = b.column(0)
            bits = model.lengths(*flat_utf8(text))
            best = bits.argmin(1)
            score = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
            none = ~np.fromiter(map(has_letter, text.to_pylist()), bool, len(text))
            pred = pc.if_else(pa.array(none), "und", pa.array(labels, pa.string()).take(pa.array(best)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pred, pa.array(np.where(none, 0.0, score))], names=schema.names)
    return docs.select("text", *keep).mapInArrow(run, schema)


def identify(docs: DataFrame, per_label: int = TRAIN_DOCS_PER_LANG) -> DataFrame:
    """documents -> (doc_id, held_out, lang_pred, score), one row per input row.

    held_out: crc32 of doc_id as text leaves 2 modulo 4; such rows and rows of
    null doc_id, lang or text teach nothing. A null doc_id is not held out. An
    empty table gives an empty result; other columns than the three are not read.
    """
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = docs.select("doc_id", "text", F.col("lang").alias("label"), F.coalesce(part == 2, F.lit(False)).alias("held_out"))
    counts = train(docs.where(~F.col("held_out")), per_label)
    return predict(docs, counts, ["doc_id", "held_out"])
