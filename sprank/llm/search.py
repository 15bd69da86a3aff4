"""Ranked lexical search, term at a time on short lists and document at a time over long ones.

Terms are hashed to 64 bits. One pass over the documents writes an inverted
index of the terms that the queries ask for, block by block: every document's
number of terms, and for each term a list of (document, occurrences) with the
greatest occurrences and the least length in every range of 512 documents. The
corpus counts (documents, terms, documents of each term) come from what was
written, added up per task first.

A block is then searched for every item in its tasks. The lists that are short
in this block are added into summed accumulators; these make one more iterator,
bounded by their greatest sum. It goes with the long lists through the ranges
in document order: a range whose bounds add up to less than the item's k-th
score so far is skipped unread; in the others the lists that could not lift a
document over that score by themselves (the lowest bounds) are looked up only
for documents still in reach. A task keeps its thresholds from block to block
and sends the k best of each item; the ranks come from those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sprank.llm.common import (NON_WORD, flat_utf8, lower_ascii, prefix_hash, row_chunks, span_hash, word_spans,
                               written)

RANGE = 512                  # documents of a range
SHORT = 64                   # a list is short in a block where it has no more than one in SHORT documents
MAX_QUERY_BYTES = 64 << 20   # hashed terms of the items that are shipped to all tasks at once
CHUNK_BYTES = 1 << 19        # of text hashed at once, about
BLOCK_BYTES, BLOCK_DOCS = 1 << 23, 4096  # of a block of documents, about
INDEX = "n binary, ids binary, term binary, size binary, docs binary, tf binary, n_docs long, n_terms long"


def hashed_terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all terms, repeats included, row bounds): runs of ASCII letters, digits and all other characters."""
    low = lower_ascii(buf)
    start, end, bounds = word_spans(low, offsets, NON_WORD)
    return span_hash(prefix_hash(low), start, end), bounds


def asked(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item, as hashes; rows of an item_id count as one item, null ids not."""
    def run(batches):
        for b in batches:
            for lo, hi in row_chunks(flat_utf8(b.column(1))[1], CHUNK_BYTES):
                h, bounds = hashed_terms(*flat_utf8(b.column(1).slice(lo, hi - lo)))
                row = np.repeat(np.arange(hi - lo), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(h.view(np.int64))],
                                                 names=["item_id", "term"])
    items = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null")
    return items.mapInArrow(run, "item_id long, term long").distinct()


class Items:
    """The items of a block of queries: item ids, the terms they ask for, and the terms of each item by number."""

    def __init__(self, pairs: pa.Table):
        item, term = pairs.column("item_id").to_numpy(), pairs.column("term").to_numpy().view(np.uint64)
        self.terms, number = np.unique(term, return_inverse=True)
        self.ids, row = np.unique(item, return_inverse=True)
        order = np.lexsort((number, row))
        self.number, self.bounds = number[order], np.searchsorted(row[order], np.arange(len(self.ids) + 1))


def _packed(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([values.astype(kind).tobytes()], pa.binary())


def index_block(doc_ids: pa.Array, texts: pa.Array, terms: np.ndarray) -> pa.RecordBatch:
    """One row: the index of a block of documents, in ascending order of doc_id, for the sorted ``terms``."""
    lengths, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    tfs = [np.zeros(0, np.int64)]
    m = max(1, len(terms))
    for lo, hi in row_chunks(flat_utf8(texts)[1], CHUNK_BYTES):
        h, bounds = hashed_terms(*flat_utf8(texts.slice(lo, hi - lo)))
        lengths.append(np.diff(bounds))
        at = np.searchsorted(terms, h)
        hit = np.flatnonzero(at < len(terms))
        hit = hit[terms[at[hit]] == h[hit]]
        row = np.searchsorted(bounds, hit, side="right") - 1
        key, tf = np.unique((row + lo) * m + at[hit], return_counts=True)
        keys.append(key)
        tfs.append(tf)
    n, key, tf = np.concatenate(lengths), np.concatenate(keys), np.concatenate(tfs)
    known = np.asarray(doc_ids.is_valid())
    ids = doc_ids.fill_null(0).to_numpy().astype(np.int64)
    order = np.lexsort((ids, ~known))  # null ids last: they count but are never found
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    doc, term = place[key // m], key % m
    at = np.lexsort((doc, term))
    doc, term, tf = doc[at], term[at], tf[at]
    found, size = np.unique(term, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [_packed(n[order], "<i8"), _packed(ids[order][:int(known.sum())], "<i8"), _packed(terms[found] if len(found) else terms[:0], "<u8"),
         _packed(size, "<u4"), _packed(doc, "<u4"), _packed(tf, "<u4"), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])],
        names=[f.split()[0] for f in INDEX.split(",")])


def index(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """documents -> index blocks of the items' terms, written once."""
    def run(batches):
        for b in batches:
            for lo, hi in row_chunks(flat_utf8(b.column(1))[1], BLOCK_BYTES):
                for at in range(lo, hi, BLOCK_DOCS):
                    n = min(BLOCK_DOCS, hi - at)
                    yield index_block(b.column(0).slice(at, n), b.column(1).slice(at, n), shared.value.terms)
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), "postings")


def document_counts(blocks: DataFrame) -> DataFrame:
    """(term, df) over all blocks; a task sends a term once."""
    def run(batches):
        terms, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            new = np.frombuffer(b"".join(b.column("term").to_pylist()), "<u8")
            more = np.frombuffer(b"".join(b.column("size").to_pylist()), "<u4").astype(np.int64)
            terms, at = np.unique(np.concatenate([terms, new]), return_inverse=True)
            df = np.bincount(at, np.concatenate([df, more]), len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df)], names=["term", "df"])
    return blocks.select("term", "size").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Block:
    """One index block with the weights of its lists and their bounds by range."""

    def __init__(self, row: dict, items: Items, weight: np.ndarray, n_docs: int, n_terms: int):
        n = np.frombuffer(row["n"], "<i8")
        self.m = 100 - 90 + (90 * n * n_docs) // max(1, n_terms)
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.docs, self.tf = np.frombuffer(row["docs"], "<u4").astype(np.int64), np.frombuffer(row["tf"], "<u4").astype(np.int64)
        size = np.frombuffer(row["size"], "<u4").astype(np.int64)
        self.number = np.searchsorted(items.terms, np.frombuffer(row["term"], "<u8"))  # sorted, like the terms
        self.weight = weight[self.number]
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.ranges = -(-len(n) // RANGE)
        # One cell for each list and range that meet: postings [cell_start, next) and the greatest impact they can have.
        lists = np.repeat(np.arange(len(size)), size)
        at = lists * self.ranges + self.docs // RANGE
        self.cell_start = np.flatnonzero(np.diff(at, prepend=-1)) if len(at) else np.zeros(0, np.int64)
        self.cell = at[self.cell_start]
        self.cell_end = np.append(self.cell_start[1:], len(at))
        if len(at):
            greatest = np.maximum.reduceat(self.tf, self.cell_start)
            least = np.minimum.reduceat(self.m[self.docs], self.cell_start)
            self.cell_bound = impact(greatest, least) * self.weight[self.cell // max(1, self.ranges)]
        else:
            self.cell_bound = np.zeros(0, np.int64)
        self.first_cell = np.searchsorted(self.cell, np.arange(len(size) + 1) * max(1, self.ranges))

    def scores(self, which: int, lo: int, hi: int) -> np.ndarray:
        return self.weight[which] * impact(self.tf[lo:hi], self.m[self.docs[lo:hi]])


class Best:
    """The k best (score, doc_id) of an item so far; equal scores by smaller doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = 1  # scores below this can't enter; one equal to it can, by a smaller doc_id

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[:self.k]
        self.score, self.ids = score[order], ids[order]
        if len(order) == self.k:
            self.least = max(1, int(self.score[-1]))


def search_block(block: Block, terms: np.ndarray, best: Best) -> tuple[int, int]:
    """Offer the documents of a block that can be among the k best; (ranges read, ranges that hold a term)."""
    at = np.searchsorted(block.number, terms)
    at = at[at < len(block.number)]
    at = at[np.isin(block.number[at], terms)]
    at = np.unique(at[block.weight[at] > 0])
    if not len(at) or not len(block.ids):
        return 0, 0
    size = block.start[at + 1] - block.start[at]
    short = size <= max(1, len(block.m) // SHORT)
    # Term at a time: the short lists become one iterator of (document, sum).
    docs = np.concatenate([block.docs[block.start[t]:block.start[t + 1]] for t in at[short]] or [np.zeros(0, np.int64)])
    sums = np.concatenate([block.scores(t, block.start[t], block.start[t + 1]) for t in at[short]] or [np.zeros(0, np.int64)])
    acc_docs, where = np.unique(docs, return_inverse=True)
    acc = np.zeros(len(acc_docs), np.int64)
    np.add.at(acc, where, sums)
    long = at[~short]
    # Bounds of every iterator in every range; the accumulators are row 0, their bound is their greatest sum there.
    bound = np.zeros((1 + len(long), block.ranges), np.int64)
    first = np.full((1 + len(long), block.ranges), -1)
    last = first.copy()
    edges = np.searchsorted(acc_docs, np.arange(block.ranges + 1) * RANGE)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        bound[0, full] = np.maximum.reduceat(acc, edges[full])
    first[0], last[0] = edges[:-1], edges[1:]
    for k, t in enumerate(long, 1):
        cells = slice(block.first_cell[t], block.first_cell[t + 1])
        r = block.cell[cells] - t * block.ranges
        bound[k, r], first[k, r], last[k, r] = block.cell_bound[cells], block.cell_start[cells], block.cell_end[cells]
    total = bound.sum(0)
    read = 0
    for r in np.flatnonzero(total > 0).tolist():
        if total[r] < best.least:
            continue
        read += 1
        base = r * RANGE
        score, seen = np.zeros(RANGE, np.int64), np.zeros(RANGE, bool)
        order = np.argsort(-bound[:, r], kind="stable")
        order = order[bound[order, r] > 0]
        reach = np.cumsum(bound[order, r][::-1])[::-1]  # of a list and all that are bounded lower
        for pos, k in enumerate(order.tolist()):
            lo, hi = int(first[k, r]), int(last[k, r])
            where = (acc_docs if k == 0 else block.docs)[lo:hi] - base
            if reach[pos] < best.least:
                # By themselves these lists lift nothing over the threshold: look up what is still in reach.
                seen &= score + reach[pos] >= best.least
                use = np.flatnonzero(seen[where])
                if not seen.any():
                    break
                where = where[use]
            else:
                use = None
                seen[where] = True
            if k == 0:
                add = acc[lo:hi] if use is None else acc[lo:hi][use]
            else:
                t = long[k - 1]
                tf = block.tf[lo:hi] if use is None else block.tf[lo:hi][use]
                add = block.weight[t] * impact(tf, block.m[where + base])
            score[where] += add
        found = np.flatnonzero(seen & (score >= best.least))
        found = found[found + base < len(block.ids)]
        if len(found):
            best.add(score[found], block.ids[found + base])
    return read, int((total > 0).sum())


def best_of_blocks(blocks: DataFrame, items: Broadcast, counts: Broadcast, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best of every item from each task, scores above 0."""
    def run(batches):
        its, (weight, n_docs, n_terms) = items.value, counts.value
        best = [Best(k) for _ in its.ids]
        for b in batches:
            for at in range(b.num_rows):
                block = Block(b.slice(at, 1).to_pylist()[0], its, weight, n_docs, n_terms)
                for i, mine in enumerate(best):
                    search_block(block, its.number[its.bounds[i]:its.bounds[i + 1]], mine)
        size = [len(x.ids) for x in best]
        if sum(size):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(its.ids, size)), pa.array(np.concatenate([x.ids for x in best])), pa.array(np.concatenate([x.score for x in best]))],
                names=["item_id", "doc_id", "score"])
    return blocks.select("n", "ids", "term", "size", "docs", "tf").mapInArrow(run, "item_id long, doc_id long, score long")


def weights(terms: np.ndarray, counts: pa.Table, n_docs: int) -> np.ndarray:
    """w of every term by number, 0 for a term that no document holds."""
    df = dict(zip(counts.column("term").to_numpy().view(np.uint64).tolist(), counts.column("df").to_pylist(), strict=True))
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in terms.tolist()], np.int64)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0, ties by smaller doc_id.

    Repeated rows of documents are documents of their own; documents of null
    doc_id count in the statistics but are not returned. Rows of an item_id
    make one item; items of null id, without terms or without a matching
    document have no rows, and so has an empty table on either side. Items go
    in blocks of about MAX_QUERY_BYTES of terms, dealt by hash, each searched
    over all documents.
    """
    spark = docs.sparkSession
    pairs = written(asked(items), "asked")
    parts = max(1, math.ceil(pairs.count() * 16 / MAX_QUERY_BYTES))
    found = []
    for part in range(parts):
        its = Items(pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toArrow())
        shared = spark.sparkContext.broadcast(its)
        blocks = index(docs, shared)
        n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        weight = weights(its.terms, document_counts(blocks).toArrow(), n_docs or 0)
        counts = spark.sparkContext.broadcast((weight, n_docs or 0, n_terms or 0))
        found.append(best_of_blocks(blocks, shared, counts, k))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.select("item_id", F.row_number().over(w).alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def oracle() -> str:
    return r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, total GROUP BY term, nd),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
