"""Removal of repeated byte windows, a stand-in for a depth-limited radix sort of suffixes.

Only the first WINDOW bytes of suffixes count, and equal groups at that depth
are exactly the repeated windows. Sorting every suffix digit by digit would send
every position of every text through several shuffles; here no suffix is
ordered. Windows are grouped by hashes instead, and most leave in runs:

* The key of a window is the GRAM bytes of least hash in it (the same in equal
  windows, wherever they stand). Neighbouring windows share it, so the first
  pass moves one record per run of windows, about a fourteenth of the positions,
  with a hash of the whole stretch of text that the run covers. A run equal to
  one of an earlier document in key and stretch is settled; a run alone in its
  key is, too.
* Runs that share the key only (at the edges of repeats) go to the last pass,
  window by window, by a hash of the whole window.

Hashes: 32 bits of the key besides the bucket that it picks, 64 bits of the
stretch (a run is settled on all of them), 64 bits of the whole window in the
last pass. Answers return to the group of documents that asked, a byte per run
and a bit per window.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprank.llm.common import flat_utf8, mix, prefix_hash, row_chunks, span_hash

WINDOW, GRAM = 50, 24
GROUP_BYTES = 4 << 20    # text of the documents that travel together, about
BUCKET_BYTES = 16 << 20  # text whose runs meet in one bucket, about
PIECE = 1 << 21          # windows of a long text that are looked at together
_AT = np.uint64((1 << 28) - 1)


class Runs:
    """Runs of valid windows that share their least gram, over a chunk of texts."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, use: np.ndarray, window: int, gram: int):
        none = np.zeros(0, np.int64)
        self.first = self.last = self.row = none
        self.digit, self.stretch = none.view(np.uint64), none.view(np.uint64)
        n = len(buf) - window + 1
        if n <= 0:
            return
        s = prefix_hash(buf)
        at = np.arange(len(buf) - gram + 1)
        h = span_hash(s, at, at + gram)
        least = (h & ~_AT) | at.astype(np.uint64)
        width, want = 1, window - gram + 1
        while 2 * width <= want:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < want:
            least = np.minimum(least[:len(least) - (want - width)], least[want - width:])
        anchor = (least & _AT).astype(np.int64)
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)[:n]
        valid = use[row] & (np.arange(n) + window <= offsets[1:][row])
        start = valid.copy()
        start[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        end = valid.copy()
        end[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
        self.first, self.last = np.flatnonzero(start), np.flatnonzero(end)
        self.row = row[self.first]
        self.digit = h[anchor[self.first]]
        self.stretch = span_hash(s, self.first, self.last + window)


def _group(table: pa.Table):
    """Documents of a group in a fixed order: (doc ids, which have one, buffer, offsets)."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table["doc_id"].combine_chunks()
    known = np.asarray(ids.is_valid())
    return ids.fill_null(0).to_numpy(zero_copy_only=False), known, *flat_utf8(table["text"])


def _chunks(group, window: int, gram: int) -> list[tuple]:
    """(first row, end row, first byte of the row, bytes, offsets, runs) of the chunks of a group.

    A text of more than PIECE bytes is a chunk for every PIECE of its windows;
    its pieces overlap by all but one byte of a window, so each window lies in
    one of them.
    """
    ids, known, buf, off = group
    out = []
    for i, j in row_chunks(off, 1 << 19):
        size = int(off[j] - off[i])
        if j > i + 1 or size <= PIECE:
            part, po = buf[off[i]:off[j]], off[i:j + 1] - off[i]
            out.append((i, j, 0, part, po, Runs(part, po, known[i:j], window, gram)))
            continue
        for at in range(0, size - window + 1, PIECE):
            part = buf[off[i] + at:off[i] + min(size, at + PIECE + window - 1)]
            po = np.array([0, len(part)])
            out.append((i, j, at, part, po, Runs(part, po, known[i:j], window, gram)))
    return out


def _bucket(digit: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(digit) >> np.uint64(32)) % np.uint64(buckets)


def _send(g: int, kind: int, bucket: np.ndarray, buckets: int, keys: list[np.ndarray], docs: np.ndarray) -> pa.Table:
    """Rows (g, bucket, data): key columns and documents of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(bucket.dtype))
    to, data = [], []
    for b in np.flatnonzero(np.diff(cut)):
        i = order[cut[b]:cut[b + 1]]
        to.append(b)
        data.append(zstandard.compress(b"".join([*(k[i].tobytes() for k in keys), np.diff(docs[i], prepend=0).tobytes()]), 1))
    return pa.table({"g": pa.array([g] * len(to), pa.int32()), "kind": pa.array([kind] * len(to), pa.int32()),
                     "bucket": pa.array(to, pa.int32()), "data": pa.array(data, pa.binary())})


_SENT = "g int, kind int, bucket int, data binary"


def _received(part: pa.Table, *types):
    """(key columns of ``types``, documents, bounds of each row) of all rows of one bucket."""
    types = [np.dtype(t) for t in (*types, np.int64)]
    cols, width = [[np.zeros(0, t)] for t in types], sum(t.itemsize for t in types)
    for x in part["data"].to_pylist():
        raw = zstandard.decompress(x)
        n, at = len(raw) // width, 0
        for col, t in zip(cols, types, strict=True):
            col.append(np.frombuffer(raw, t, n, at))
            at += n * t.itemsize
        cols[-1][-1] = np.cumsum(cols[-1][-1])
    return *map(np.concatenate, cols), np.cumsum([len(k) for k in cols[-1]])


def _answer(part: pa.Table, bounds: np.ndarray, codes: np.ndarray) -> pa.Table:
    data = [zstandard.compress(codes[i:j].tobytes(), 1) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({"g": part["g"].combine_chunks(), "kind": part["kind"].combine_chunks(), "bucket": part["bucket"].combine_chunks(), "data": pa.array(data, pa.binary())})


def _least(group: np.ndarray, docs: np.ndarray, up: bool = True) -> np.ndarray:
    """For each row the least (or greatest) document of its run of equal ``group``."""
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(cut, len(group)))
    return np.repeat((np.minimum if up else np.maximum).reduceat(docs, cut), size)


SETTLED, OPEN = 1, 2


def _settle(part: pa.Table) -> pa.Table:
    """First two digits: 0 alone, SETTLED equal to an earlier document's run, OPEN shares the first digit only."""
    first, stretch, docs, bounds = _received(part, np.uint32, np.uint64)
    codes = np.zeros(len(first), np.uint8)
    if len(first):
        order = np.lexsort((docs, stretch, first))
        first, stretch, d = first[order], stretch[order], docs[order]
        k = np.cumsum(np.concatenate([[False], (first[1:] != first[:-1]) | (stretch[1:] != stretch[:-1])]))
        settled = d > _least(k, d)
        other = (_least(first, k) != _least(first, k, False)) & (_least(first, d) != _least(first, d, False))
        codes[order] = np.where(settled, SETTLED, np.where(other, OPEN, 0))
    return _answer(part, bounds, codes)


def _repeated(part: pa.Table) -> pa.Table:
    """Whole windows: 1 if an earlier document holds it."""
    keys, docs, bounds = _received(part, np.uint64)
    codes = np.zeros(len(keys), np.uint8)
    if len(keys):
        order = np.lexsort((docs, keys))
        codes[order] = docs[order] > _least(keys[order], docs[order])
    return _answer(part, bounds, codes)


def _codes(answers: pa.Table, kind: int, bucket: np.ndarray) -> np.ndarray:
    """Answers put back in the order in which the questions were asked."""
    out = np.zeros(len(bucket), np.uint8)
    order = np.argsort(bucket, kind="stable")
    got = {(k, b): x for k, b, x in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "data")), strict=True)}
    cut = np.searchsorted(bucket[order], np.unique(bucket))
    for b, i in zip(bucket[order][cut].tolist(), np.split(order, cut[1:]), strict=True) if len(order) else ():
        out[i] = np.frombuffer(zstandard.decompress(got[kind, b]), np.uint8)
    return out


def _each(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each run."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """documents -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row.

    A byte goes if a window of ``window`` bytes that covers it also starts in a
    document of smaller doc_id, judged on the input. Null texts count as empty;
    texts shorter than the window stay. Rows of a null doc_id stay whole and
    remove nothing. Rows that repeat a doc_id don't remove each other's bytes.
    Long texts go piece by piece, with the same result. An empty table gives an
    empty result; columns other than doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = max(1, math.ceil(total / GROUP_BYTES)), max(1, math.ceil(total / BUCKET_BYTES))
    docs = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).select("g", "doc_id", "text")

    def ask(table: pa.Table) -> pa.Table:
        group = _group(table)
        first, stretch, who, bucket = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, *_, r in _chunks(group, window, gram):
            first.append(r.digit.astype(np.uint32))
            stretch.append(r.stretch)
            who.append(group[0][i + r.row])
            bucket.append(_bucket(r.digit, buckets))
        return _send(table["g"][0].as_py(), 1, np.concatenate(bucket), buckets, [np.concatenate(first), np.concatenate(stretch)], np.concatenate(who))

    def opened(group, answers: pa.Table) -> list[tuple]:
        """For each chunk: its place, runs, codes, and the windows of the open runs with their buckets."""
        chunks, out, at = _chunks(group, window, gram), [], 0
        codes = _codes(answers, 1, np.concatenate([np.zeros(0, np.uint64), *(_bucket(c[-1].digit, buckets) for c in chunks)]))
        for i, j, begin, part, po, r in chunks:
            mine = codes[at:at + len(r.first)]
            at += len(r.first)
            o = np.flatnonzero(mine == OPEN)
            count = r.last[o] - r.first[o] + 1
            start = _each(r.first[o], count)
            out.append((i, j, begin, part, po, r, mine, start, np.repeat(_bucket(r.digit[o], buckets), count), np.repeat(r.row[o], count)))
        return out

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _send(0, 2, np.zeros(0, np.int64), buckets, [np.zeros(0, np.uint64)], np.zeros(0, np.int64))
        group = _group(table)
        keys, who, bucket = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, _, _, part, _, _, _, start, b, row in opened(group, answers):
            if len(start):
                keys.append(span_hash(prefix_hash(part), start, start + window))
            who.append(group[0][i + row])
            bucket.append(b)
        return _send(table["g"][0].as_py(), 2, np.concatenate(bucket), buckets, [np.concatenate(keys)], np.concatenate(who))

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = [], [], [], [], []
        if table.num_rows:
            group = _group(table)
            ids, known = group[0].tolist(), group[1].tolist()

            def emit(k: int, text: np.ndarray, gone: np.ndarray, n: int, spans: int) -> None:
                kept = text[~gone] if n else text
                for col, v in zip(out, (ids[k] if known[k] else None, len(text), n, spans, hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                    col.append(v)

            chunks, at = opened(group, answers), 0
            last = _codes(answers, 2, np.concatenate([np.zeros(0, np.uint64), *(c[-2] for c in chunks)]))
            for i, j, begin, part, po, r, mine, start, _, _ in chunks:
                hit = start[last[at:at + len(start)] == 1]
                at += len(start)
                done = mine == SETTLED
                step = np.zeros(len(part) + 1, np.int64)
                np.add.at(step, np.concatenate([r.first[done], hit]), 1)
                np.add.at(step, np.concatenate([r.last[done], hit]) + window * np.ones(done.sum() + len(hit), np.int64), -1)
                gone = np.cumsum(step[:-1]) > 0
                if j == i + 1 and group[3][j] - group[3][i] > PIECE:  # a long text: its pieces are put together first
                    text = group[2][group[3][i]:group[3][j]]
                    whole = np.zeros(len(text), bool) if begin == 0 else whole
                    whole[begin:begin + len(part)] |= gone
                    if begin + len(part) == len(text):
                        spans = int(whole[0]) + int(np.count_nonzero(whole[1:] & ~whole[:-1]))
                        emit(i, text, whole, int(np.count_nonzero(whole)), spans)
                    continue
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                begins[po[:-1][po[:-1] < len(part)]] |= gone[po[:-1][po[:-1] < len(part)]]
                less, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
                for k in range(j - i):
                    lo, hi = po[k], po[k + 1]
                    emit(i + k, part[lo:hi], gone[lo:hi], int(less[hi] - less[lo]), int(spans[hi] - spans[lo]))
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_bytes": pa.array(out[1], pa.int64()), "n_removed": pa.array(out[2], pa.int64()),
                         "n_spans": pa.array(out[3], pa.int64()), "kept_sha256": pa.array(out[4], pa.string())})

    runs = docs.groupBy("g").applyInArrow(ask, _SENT).groupBy("bucket").applyInArrow(_settle, _SENT)
    edges = docs.groupBy("g").cogroup(runs.groupBy("g")).applyInArrow(ask_windows, _SENT).groupBy("bucket").applyInArrow(_repeated, _SENT)
    return docs.groupBy("g").cogroup(runs.unionByName(edges).groupBy("g")).applyInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
