"""Document fingerprints by one-permutation MinHash.

Every 5-word shingle is hashed once; the top bits choose one of BINS bins and
the least rest in a bin is kept. An empty bin copies the first non-empty bin in
an order of its own (optimal densification: the order is fixed and differs per
bin, so equal sets fill alike). Of each bin the low BITS bits are stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprank.llm.common import (SPACE, flat_utf8, gram_hashes, lower_ascii, partitions, prefix_hash, row_chunks, span_hash,
                               word_spans)

SHINGLE, BINS, BITS = 5, 256, 8
_EMPTY = np.uint64((1 << 64) - 1)
_rng = np.random.default_rng(13)
_ORDER = np.argsort(_rng.random((BINS, BINS)), axis=1)  # for each bin, in which order it asks the others
_RANK = np.argsort(_ORDER, axis=1)


def _densify(v: np.ndarray) -> None:
    full = v != _EMPTY
    count = full.sum(1)
    for r in np.flatnonzero((count > 0) & (count <= 32)):
        have = np.flatnonzero(full[r])
        v[r] = np.where(full[r], v[r], v[r][have[_RANK[:, have].argmin(1)]])
    rows = np.flatnonzero((count > 32) & (count < BINS))
    for t in range(BINS):
        if not len(rows):
            break
        ask = _ORDER[:, t]
        part, ok = v[rows], full[rows]
        v[rows] = np.where((part == _EMPTY) & ok[:, ask], np.where(ok, part, _EMPTY)[:, ask], part)
        rows = rows[(v[rows] == _EMPTY).any(1)]


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, empty): BINS codes of BITS bits per text; texts without words have no shingles."""
    buf, offsets = flat_utf8(texts)
    codes, empty = np.zeros((len(texts), BINS), np.uint8), np.zeros(len(texts), bool)
    for i, j in row_chunks(offsets, 1 << 19):
        part, off = lower_ascii(buf[offsets[i]:offsets[j]]), offsets[i:j + 1] - offsets[i]
        start, end, bounds = word_spans(part, off, SPACE)
        grams, gb = gram_hashes(span_hash(prefix_hash(part), start, end), bounds, SHINGLE)
        row = np.repeat(np.arange(j - i), np.diff(gb))
        v = np.full((j - i) * BINS, _EMPTY)
        np.minimum.at(v, row * BINS + (grams >> np.uint64(56)).astype(np.int64), grams & np.uint64((1 << 56) - 1))
        v = v.reshape(j - i, BINS)
        empty[i:j] = np.diff(gb) == 0
        _densify(v)
        codes[i:j] = (v & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return codes, empty


def packed(codes: np.ndarray, empty: np.ndarray) -> list[str]:
    """Hexadecimal strings of the packed codes; '' for a text without shingles."""
    bits = np.unpackbits(codes[:, :, None], axis=2)[:, :, 8 - BITS:].reshape(len(codes), BINS * BITS)
    return ["" if e else x.tobytes().hex() for x, e in zip(np.packbits(bits, axis=1), empty, strict=True)]


def likeness(a: np.ndarray, a_empty: np.ndarray, b: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity: share of equal codes, less what chance makes equal.

    Two texts without shingles are alike (1); one of them is unlike any other (0).
    """
    chance = 2.0 ** -BITS
    est = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), est)


def with_next(docs: DataFrame) -> DataFrame:
    """(part, last, doc_id, text): documents dealt by ranges of doc_id, each range closed by the first row of the next.

    Rows of a part are sorted by (doc_id, text); ``last`` marks the closing copy
    (the last range is closed by the first row of all). One shuffle of the
    texts; the driver sees range bounds only, as many as there are partitions.
    Rows with a null doc_id get part -1.
    """
    n = partitions(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id", F.col("doc_id").cast("double").alias("__x"))
    cuts = sorted(set(ids.where("__x is not null").approxQuantile("__x", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    cuts = cuts or [0.0]
    deal = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__x", outputCol="__b", handleInvalid="keep")
    firsts = deal.transform(ids).where("doc_id is not null").groupBy("__b").agg(F.min("doc_id")).orderBy("__b").collect()
    before = {firsts[i][1]: int(firsts[i - 1][0]) for i in range(len(firsts))}
    own = F.struct(F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("__b").cast("int")).alias("part"), F.lit(False).alias("last"))
    rows = deal.transform(docs.withColumn("__x", F.col("doc_id").cast("double")))
    if before:
        prev = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("doc_id"))
        copy = F.struct(prev.alias("part"), F.lit(True).alias("last"))
        own = F.explode(F.when(F.col("doc_id").isin(list(before)), F.array(own, copy)).otherwise(F.array(own)))
    return (rows.select(own.alias("__p"), "doc_id", "text").select("__p.*", "doc_id", "text")
            .repartition(n, "part").sortWithinPartitions("part", "last", "doc_id", "text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """documents -> fingerprints of each whole text and of its edited text, one row per input row.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edit replaces the last quarter of the code
    points by the first as many of the next document in (doc_id, text) order;
    the last is followed by the first. Null texts count as empty. Rows with a
    null doc_id have no next document: their edit replaces by nothing and
    near_next is null. Fingerprints of texts without words are ''.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        own = [r for r in rows[:-1] if not r[1]]
        at = [i for i, r in enumerate(rows[:-1]) if not r[1]]
        follows = [rows[i + 1][3] if rows[i][0] >= 0 else "" for i in at]
        texts = [r[3] for r in own]
        edits = [t[:len(t) - len(t) // 4] + f[:len(t) // 4] for t, f in zip(texts, follows, strict=True)]
        codes, none = fingerprints(pa.array([r[3] for r in rows], pa.large_string()))
        mine, nxt = np.array(at, np.int64), np.array(at, np.int64) + 1
        ecodes, enone = fingerprints(pa.array(edits, pa.large_string()))
        alone = np.array([r[0] < 0 for r in own], bool)
        return pa.RecordBatch.from_arrays([
            pa.array([r[2] for r in own], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
            pa.array(packed(codes[mine], none[mine]), pa.string()), pa.array(packed(ecodes, enone), pa.string()),
            pa.array(likeness(codes[mine], none[mine], ecodes, enone)),
            pa.array(likeness(codes[mine], none[mine], codes[nxt], none[nxt]), mask=alone)],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += len(row[3])
                if size > 1 << 20 and len(held) > 1:
                    yield finish(held)
                    held, size = held[-1:], len(held[-1][3])
        if held:
            yield finish([*held, (-2, True, None, "")])

    return with_next(docs).mapInArrow(run, schema)
