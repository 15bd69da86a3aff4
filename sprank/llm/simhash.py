"""SimHash near-duplicates over Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments (22, 21, 21 bits), each padded
to the 23 bits of the perfect binary Golay code. If two fingerprints differ in
at most four bits, the two segments with the fewest differences hold at most
two of them together; then some word lies within one bit of both fingerprints
on these two segments, and decodes to the same pair of codewords. So each
fingerprint gets, for each pair of segments, the codeword index pairs of its
own two segments and of all their one-bit neighbours (about ten), and any two
fingerprints within four bits share a key. Candidates are verified by their
exact bit distance.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprank.llm.common import partitions, split_hot, written
from sprank.llm.components import connected_components

SEGMENTS = ((42, 22), (21, 21), (0, 21))
MAX_DISTANCE = 4
CHUNK = 4096  # fingerprints of one key that meet in one group
SMALL = 48    # groups up to this size are compared by shifting


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of one text: ASCII-lowered words, shingles with repeats, majority of XXH64 bits."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    k = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:len(parts) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[i:j], 42) for i, j in zip(starts, (ends[k - 1:] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class Golay:
    """The (23, 12) code: index of the codeword within three bits of a word."""
    GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1

    def __init__(self):
        unit = [self._rest(1 << i) for i in range(23)]
        half = lambda lo, n: np.array([self._xor(unit[lo + i] for i in range(n) if v >> i & 1) for v in range(1 << n)], np.int64)
        self.low, self.high = half(0, 12), half(12, 11)
        self.error = np.zeros(2048, np.int64)
        for n in (1, 2, 3):
            for bits in itertools.combinations(range(23), n):
                self.error[self._xor(unit[i] for i in bits)] = sum(1 << i for i in bits)

    def _rest(self, w: int) -> int:
        for i in range(22, 10, -1):
            if w >> i & 1:
                w ^= self.GENERATOR << (i - 11)
        return w

    @staticmethod
    def _xor(values) -> int:
        out = 0
        for v in values:
            out ^= v
        return out

    def index(self, w: np.ndarray) -> np.ndarray:
        """Information bits (12) of the nearest codeword."""
        return (w ^ self.error[self.low[w & 0xFFF] ^ self.high[w >> 12]]) >> 11


def fuzzy_keys(fp: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every distinct key of each fingerprint."""
    fp = fp.view(np.uint64)
    near, own = [], []
    for shift, bits in SEGMENTS:
        w = ((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        flips = np.concatenate([[0], 1 << np.arange(bits)])
        idx = code.index(w[:, None] ^ flips[None, :])
        near.append(idx)
        own.append(idx[:, :1])
    rows, keys = [], []
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        k = np.concatenate([near[i] << 12 | own[j], own[i] << 12 | near[j]], axis=1)
        k.sort(axis=1)
        new = np.ones(k.shape, bool)
        new[:, 1:] = k[:, 1:] != k[:, :-1]
        rows.append(np.nonzero(new)[0])
        keys.append(k[new] | n << 24)
    return np.concatenate(rows), np.concatenate(keys)


def _tree(f: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph 'within ``most`` bits' over one group."""
    left, out = f.copy(), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = np.bitwise_count(left ^ x) <= most
            if hit.any():
                got = left[hit]
                out.extend((int(x), int(y)) for y in got)
                todo.extend(got)
                left = left[~hit]
    return out


def _links(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside runs of equal keys (rows sorted by key)."""
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([cut, [len(keys)]]))
    a, b = [], []
    for i in np.flatnonzero(size > SMALL):
        if pairs := _tree(np.unique(fps[cut[i]:cut[i] + size[i]]), most):
            p = np.array(pairs, np.uint64)
            a.append(p[:, 0])
            b.append(p[:, 1])
    run = np.repeat(size, size)
    ok = run <= SMALL
    keys, fps = keys[ok], fps[ok]
    for s in range(1, int(size[size <= SMALL].max(initial=1))):
        same = keys[s:] == keys[:-s]
        if not same.any():
            break
        x, y = fps[s:][same], fps[:-s][same]
        hit = (np.bitwise_count(x ^ y) <= most) & (x != y)
        a.append(x[hit])
        b.append(y[hit])
    empty = np.zeros(0, np.uint64)
    return np.concatenate(a or [empty]), np.concatenate(b or [empty])


def near_links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect all within ``max_distance`` bits.

    Small key groups give all their links, large ones a spanning forest, so
    connectivity is exact while a hot key does not emit all its pairs.
    """
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError("three segments with one-bit neighbours cover at most four differing bits")

    def emit(batches):
        code = Golay()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 1 << 14):
                part = fp[i:i + (1 << 14)]
                rows, keys = fuzzy_keys(np.ascontiguousarray(part), code)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows])], ["key", "fp"])

    def compare(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                k = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy().astype(np.int64)
                held_k = np.concatenate([held_k, k])
                held_f = np.concatenate([held_f, b.column(2).to_numpy().view(np.uint64)])
                if not len(held_k):
                    continue
                done = int(np.searchsorted(held_k, held_k[-1]))
            else:
                done = len(held_k)
            if done:
                x, y = _links(held_k[:done], held_f[:done], max_distance)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])
                held_k, held_f = held_k[done:], held_f[done:]

    keyed = split_hot(fps.select("fp").mapInArrow(emit, "key int, fp long"), "key", "fp", CHUNK)
    return (keyed.select("key", "part", "fp").repartition(partitions(fps), "key", "part")
            .sortWithinPartitions("key", "part").mapInArrow(compare, "a long, b long")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, words: int = 4, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """documents -> (doc_id, fingerprint, component_id), one row per input row.

    Texts are read once, whole. Null and empty texts have fingerprint zero and
    link like any other; texts of fewer words than a shingle are one shingle.
    Rows with a null doc_id keep their row; component_id is null only where no
    reachable row has a doc_id. Repeated rows are kept. Equal fingerprints are
    collapsed before the search. Other columns of ``docs`` are not read.
    """
    marks = written(with_fingerprints(docs, words), "simhash")
    first = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    parts = connected_components(near_links(first, max_distance))
    named = (first.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("component", F.coalesce("component", "fp")))
    low = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(low, "component").select("fp", "component_id")
    return marks.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 4, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The documents of ``docs`` with one document (the smallest doc_id) of each group kept.

    Rows with a null doc_id stay: they cannot be told apart. Repeated rows of a
    kept doc_id stay. Columns are returned as they came.
    """
    found = near_duplicates(docs, words, max_distance).where("doc_id <> component_id")
    gone = found.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
