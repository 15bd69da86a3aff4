"""Okapi BM25 keyword index and scoring as DataFrame plans.

Postings (doc_id, term, tf, dl, first) hold one row per distinct term of a
document plus one NULL-term row per document (``first``), hash-partitioned by
``doc_id``; building them takes one shuffle of the documents and none by term.
A stored index (``store``) also has its vocabulary (term, df), and its postings
are laid out by term hash as well, so a search reads only the parts that can
hold its terms, once.

Scoring joins the query terms (broadcast in blocks of checked size) to the
postings, so no posting list is ever shuffled by term: a term present in
every document is just a long scan, not a hot shuffle key. Because the
postings are partitioned by ``doc_id``, the per-(query, document) sum needs no
exchange. A top-k search joins each posting to its term once, whatever number
of queries asks for it, adds up the scores of a block of documents in one
array of bounded size and keeps the k best of each query, so the only shuffle
(by query id) moves partitions x queries x k rows.

Semantics follow the ``rank-bm25`` Okapi defaults: idf = ln(N-df+0.5) -
ln(df+0.5); a negative idf is replaced by epsilon x (mean idf over all distinct
terms); a query term repeated counts again; unknown terms add 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprank.functions.ranking import RANK_DIGITS, rank_topk
from sprank.functions.text import tokens

# The public Okapi defaults of the rank-bm25 package.
K1 = 1.5
B = 0.75
EPSILON = 0.25

# Query terms broadcast at once, and the number of terms up to which the scan is
# also filtered by term (beyond, by part only).
MAX_BLOCK_BYTES = 64 << 20
MAX_PRUNED_TERMS = 200
# Documents of one slot when smallest unmatched ids are searched.
SLOT_DOCS = 200_000
# Scores, and shares that add up to them, of one block of documents in a search: 16 MB an array, about.
MAX_CELLS = 2_000_000


@dataclass
class BM25Index:
    """Postings plus corpus statistics. ``stats`` holds four numbers computed
    once at build time (N, avgdl, mean idf, eps), so searches never
    aggregate the whole vocabulary again."""
    postings: DataFrame
    stats: dict
    k1: float = K1
    b: float = B
    epsilon: float = EPSILON
    # Of a stored index (``store.load_index``): doc_id buckets, parts by term
    # hash (column ``tb``; -1 holds the document rows), and the vocabulary.
    partitions: int | None = None
    term_parts: int | None = None
    stored_terms: DataFrame | None = None

    @property
    def doc_ids(self) -> DataFrame:
        if self.term_parts:
            return self.postings.where(F.col("tb") == -1).select("doc_id")
        return self.postings.where(F.col("first")).select("doc_id")

    @property
    def segments(self) -> list[BM25Index]:
        """Indexes that hold the documents, each document in one of them."""
        return [self]

    def narrowed(self, frame: DataFrame, terms: list[str] | None, parts: list[int] | None) -> DataFrame:
        """Rows of a stored table that can hold the query terms: by part, and for few terms by term."""
        if self.term_parts and parts is not None:
            frame = frame.where(F.col("tb").isin(parts))
        return frame.where(F.col("term").isin(terms)) if terms else frame

    @property
    def terms(self) -> DataFrame:
        """The vocabulary (term, df, raw_idf, idf): one aggregation by term,
        pre-combined in every task (a hot term is one row per task)."""
        n = float(self.stats["n"])
        df_terms = self.stored_terms
        if df_terms is None:
            df_terms = self.postings.where(~F.col("first")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return idf_columns(df_terms.select("term", "df"), n, self.stats["eps"])


def idf_columns(df_terms: DataFrame, n: float, eps: float | None) -> DataFrame:
    raw = F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    out = df_terms.withColumn("raw_idf", raw)
    e = F.lit(eps).cast("double")
    return out.withColumn("idf", F.when(F.col("raw_idf") < 0, e).otherwise(F.col("raw_idf")))


def build_postings(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   colocate: bool = True, num_partitions: int | None = None) -> DataFrame:
    """Postings of ``corpus``: (doc_id, term, tf, dl, first).

    With ``colocate`` the documents are hash-partitioned by ``doc_id`` first
    (one shuffle of the text); tokenising, exploding and counting per
    (doc_id, term) then run inside those partitions with no further exchange,
    and the postings come out clustered by ``doc_id``. Each document also
    gets one row with a NULL term (``first``), so that documents without
    tokens still count and corpus statistics need no second pass.
    """
    docs = corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if colocate:
        docs = (docs.repartition(num_partitions, "doc_id") if num_partitions
                else docs.repartition("doc_id"))
    tok = docs.select("doc_id", tokens("text").alias("tok"))
    rows = tok.select("doc_id", F.size("tok").cast("int").alias("dl"),
                      F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("tok"))).alias("term"))
    post = rows.groupBy("doc_id", "term").agg(F.count("term").cast("int").alias("tf"),
                                             F.max("dl").alias("dl"))
    return post.withColumn("first", F.col("term").isNull())


# Types of ids whose postings are made in arrays.
ARRAY_IDS = (T.StringType(), T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType())
# Postings of one Arrow batch.
BATCH_ROWS = 50_000


def build_sorted(corpus: DataFrame, num_partitions: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """(the rows of ``build_postings``, whether they lie sorted in their partitions: document rows first, then by term).

    Texts are split in the JVM. A task numbers the terms and documents of its
    partition, keeps (term, document, tf) of every batch in arrays and sorts the
    numbers, so no posting is hashed or compared as a row; a writer that sorts
    by term finds them in order. Ids of other types go through ``build_postings``.
    """
    kind = corpus.schema[id_col].dataType
    if kind not in ARRAY_IDS:
        return build_postings(corpus, id_col, text_col, num_partitions=num_partitions), False
    tok = corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition(num_partitions, "doc_id").select(
        "doc_id", tokens("text").alias("tok"))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()),
                           T.StructField("dl", T.IntegerType()), T.StructField("first", T.BooleanType())])

    def summed(pair, tf, dl):
        """Sorted pairs, each once, with the sum of their counts and the greatest of their lengths."""
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        if not len(first):
            return pair, tf, dl
        return pair[first], np.add.reduceat(tf[order], first), np.maximum.reduceat(dl[order], first)

    def numbered(parts):
        """(distinct values of all batches, number of each value of every batch)."""
        both = pa.chunked_array(parts).combine_chunks().dictionary_encode(null_encoding="encode")
        return both.dictionary, np.split(both.indices.to_numpy(), np.cumsum([len(x) for x in parts])[:-1])

    def run(batches):
        docs, terms, held = [], [], []
        for batch in batches:
            tok = batch.column(1)
            lens = np.diff(tok.offsets.to_numpy())
            doc = batch.column(0).dictionary_encode(null_encoding="encode")
            term = tok.flatten().dictionary_encode()
            d, wide = doc.indices.to_numpy(), len(doc.dictionary)
            whole = np.zeros(wide, np.int32)
            np.maximum.at(whole, d, lens)
            pair, tf, dl = summed(term.indices.to_numpy().astype(np.int64) * wide + np.repeat(d, lens), np.ones(len(term), np.int32), np.repeat(lens, lens))
            docs.append(doc.dictionary)
            terms.append(term.dictionary)
            held.append((whole, (pair // max(wide, 1)).astype(np.int32), (pair % max(wide, 1)).astype(np.int32), tf, dl))
        if not docs:
            return
        ids, id_at = numbered(docs)
        words, word_at = numbered(terms)
        longest = np.zeros(len(ids), np.int32)
        for at, (whole, *_) in zip(id_at, held, strict=True):
            np.maximum.at(longest, at, whole)
        order = pc.sort_indices(words).to_numpy()
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        words = words.take(pa.array(order))
        pair = np.concatenate([place[w[t]] * len(ids) + d[i] for d, w, (_, t, i, _, _) in zip(id_at, word_at, held, strict=True)])
        # An id that comes in several batches is one document.
        pair, tf, dl = summed(pair, *(np.concatenate([x[c] for x in held]) for c in (3, 4)))
        del held
        for i in range(0, len(ids), BATCH_ROWS):
            n = len(ids[i:i + BATCH_ROWS])
            yield pa.RecordBatch.from_arrays([ids[i:i + n], pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.int32)), pa.array(longest[i:i + n]),
                                              pa.array(np.ones(n, bool))], schema.names)
        for i in range(0, len(pair), BATCH_ROWS):
            s = slice(i, i + BATCH_ROWS)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(pair[s] % len(ids))), words.take(pa.array(pair[s] // len(ids))), pa.array(tf[s].astype(np.int32)),
                                              pa.array(dl[s].astype(np.int32)), pa.array(np.zeros(len(pair[s]), bool))], schema.names)
    return tok.mapInArrow(run, schema), True


def corpus_stats(postings: DataFrame, epsilon: float = EPSILON) -> dict:
    """N, avgdl, mean raw idf over all distinct terms, eps = epsilon x mean idf.
    Two one-row aggregations; the per-term counts are pre-combined in every
    task before the shuffle by term."""
    n, avgdl = postings.where(F.col("first")).agg(F.count(F.lit(1)), F.avg("dl")).first()
    terms = postings.where(~F.col("first")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return stats_from_terms(terms, n, avgdl, epsilon)


def stats_from_terms(terms: DataFrame, n: int, avgdl: float | None, epsilon: float = EPSILON) -> dict:
    """The statistics from a vocabulary (term, df), the number of documents and their mean length."""
    if not n:
        return {"n": 0, "avgdl": 0.0, "avg_idf": 0.0, "eps": 0.0}
    avg_idf = idf_columns(terms, float(n), 0.0).agg(F.avg("raw_idf")).first()[0]
    avg_idf = float(avg_idf) if avg_idf is not None else 0.0
    return {"n": int(n), "avgdl": float(avgdl), "avg_idf": avg_idf, "eps": epsilon * avg_idf}


def index_from_postings(postings: DataFrame, k1: float = K1, b: float = B,
                        epsilon: float = EPSILON) -> BM25Index:
    """Derive corpus statistics from postings (also used after an append,
    where postings of several batches are combined)."""
    return BM25Index(postings=postings, stats=corpus_stats(postings, epsilon), k1=k1, b=b,
                     epsilon=epsilon)


def build_bm25(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               k1: float = K1, b: float = B, epsilon: float = EPSILON,
               colocate: bool = True, num_partitions: int | None = None) -> BM25Index:
    """Build the BM25 index of ``corpus`` (whitespace tokens, case kept)."""
    post = build_postings(corpus, id_col, text_col, colocate, num_partitions)
    return index_from_postings(post, k1, b, epsilon)


def query_terms(queries: DataFrame, qid_col: str = "qid", query_col: str = "query") -> DataFrame:
    """(qid, term, qtf): a repeated query token counts again."""
    return (queries.select(F.col(qid_col).alias("qid"),
                           F.explode(tokens(query_col)).alias("term"))
                   .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))


def term_part(term, parts: int):
    """Part of a stored index that holds a term."""
    if parts == 1:
        return F.lit(0)
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _query_blocks(queries: DataFrame, qid_col: str, query_col: str) -> list[DataFrame]:
    """Query terms (qid, term, qtf) in blocks that may be broadcast: whole
    queries, dealt by hash, about MAX_BLOCK_BYTES each (one block if they fit)."""
    qt = query_terms(queries, qid_col, query_col)
    size = qt.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    if size <= MAX_BLOCK_BYTES:
        return [qt]
    n = math.ceil(2 * size / MAX_BLOCK_BYTES)
    return [qt.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]


def _weighted_terms(index: BM25Index, qt: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(query terms with qtf, idf, avgdl; postings of each segment that can hold them).

    Document frequencies come from the stored vocabulary, else the postings are
    streamed past the distinct query terms and counted (partial counts per
    task, so a term in every document costs one row per task)."""
    few = [r[0] for r in qt.select("term").distinct().limit(MAX_PRUNED_TERMS + 1).collect()]
    terms = few if len(few) <= MAX_PRUNED_TERMS else None
    parts = None
    if index.term_parts and index.term_parts > 1:
        parts = [r[0] for r in qt.select(term_part("term", index.term_parts)).distinct().collect()]
    postings = [x.narrowed(x.postings, terms, parts) for x in index.segments]
    distinct = F.broadcast(qt.select("term").distinct())
    if index.stored_terms is not None:
        qdf = index.narrowed(index.stored_terms, terms, parts).select("term", "df").join(distinct, "term")
    else:
        qdf = _union(postings).join(distinct, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    wq = idf_columns(qdf, float(index.stats["n"]), index.stats["eps"]).join(qt, "term")
    return wq.withColumn("avgdl", F.lit(float(index.stats["avgdl"]))), postings


def _block_scores(index: BM25Index, wq: DataFrame, postings: list[DataFrame]) -> DataFrame:
    k1, b = index.k1, index.b
    tf = F.col("tf")
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    return _union([x.join(F.broadcast(wq), "term")
                   .select("qid", "doc_id",
                           (F.col("qtf") * F.col("idf") * tf * F.lit(k1 + 1) / (tf + norm)).alias("c"))
                   .groupBy("qid", "doc_id").agg(F.sum("c").alias("score")) for x in postings])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bm25_scores(index: BM25Index, queries: DataFrame, qid_col: str = "qid",
                query_col: str = "query") -> DataFrame:
    """(qid, doc_id, score) for every document matching at least one query term."""
    return _union([_block_scores(index, *_weighted_terms(index, qt)) for qt in _query_blocks(queries, qid_col, query_col)])


class _Best:
    """The k best (id, score) of every query so far; a NULL id comes before all others."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit = k, max(MAX_CELLS // 4, 4 * queries * k)
        self.parts, self.held = [], 0

    def add(self, ids: np.ndarray, known: np.ndarray, query: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((ids, known, query, score))
        self.held += len(ids)
        if self.held > self.limit:
            self.cut()

    def cut(self) -> None:
        if not self.parts:
            return
        ids, known, query, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        place = np.unique(ids, return_inverse=True)[1]  # order of ids of any type
        order = np.lexsort((place, known, -np.round(score, RANK_DIGITS), query))
        q = query[order]
        keep = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
        self.parts, self.held = [(ids[keep], known[keep], query[keep], score[keep])], len(keep)


def _doc_blocks(cost: np.ndarray, queries: int):
    """Ranges of documents whose scores, and whose shares (``cost`` of each document), stay within MAX_CELLS."""
    rows = max(1, MAX_CELLS // max(queries, 1))
    upto, i = np.cumsum(cost), 0
    while i < len(cost):
        j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + MAX_CELLS, side="right"))
        yield i, (i := min(max(j, i + 1), i + rows))


def _shared_terms(wq: DataFrame):
    """(for the tasks: first query of every term, their numbers and weights, their qids; (term, t) and (qid, q) as frames)."""
    spark = wq.sparkSession
    asked = wq.select("term", "qid", (F.col("qtf") * F.col("idf")).alias("weight")).toArrow()  # a block of checked size
    term, qid = asked["term"].combine_chunks().dictionary_encode(), asked["qid"].combine_chunks().dictionary_encode(null_encoding="encode")
    of = term.indices.to_numpy()
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(term.dictionary) + 1))
    shared = spark.sparkContext.broadcast((first, qid.indices.to_numpy()[order], asked["weight"].to_numpy()[order], qid.dictionary))

    def numbered(values, name, number):
        at = pa.array(np.arange(len(values)), pa.int32())
        return spark.createDataFrame(pa.table({name: values, number: at}), T.StructType([T.StructField(name, wq.schema[name].dataType), T.StructField(number, T.IntegerType())]))
    return shared, numbered(term.dictionary, "term", "t"), numbered(qid.dictionary, "qid", "q")


def _hits():
    return F.collect_list(F.struct("t", "tf", "dl")).alias("hits")


def _best_documents(docs: DataFrame, index: BM25Index, shared, qid_field: T.StructField, k: int) -> DataFrame:
    """(qid, doc_id, score): of every partition the ``k`` best documents of each query among those that match it.

    ``docs``: doc_id and hits, an array of (t, tf, dl), and where a document
    counts for some queries only, ``asked``, their numbers.
    """
    schema = T.StructType([qid_field, docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    k1, b, avgdl = index.k1, index.b, float(index.stats["avgdl"])

    def run(batches):
        first, query, weight, qids = shared.value
        best, n = _Best(len(qids), k), len(qids)
        kind = None
        for batch in batches:
            ids, hits = batch.column(0), batch.column(1)
            kind = ids.type
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            names = ids.fill_null(0 if pa.types.is_integer(kind) else "").to_numpy(zero_copy_only=False)
            at = hits.offsets.to_numpy()
            t, tf, dl = (x.to_numpy()[at[0]:at[-1]] for x in hits.values.flatten())
            at = at - at[0]
            worth = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            times = first[t + 1] - first[t]
            doc = np.repeat(np.arange(len(names)), np.diff(at))
            only = batch.column(2) if batch.num_columns > 2 else None
            for i, j in _doc_blocks(np.bincount(doc, times, len(names)).astype(np.int64), n):
                s = slice(at[i], at[j])
                p = np.repeat(np.arange(at[i], at[j]), times[s])  # the posting of every share
                of = first[t[p]] + np.arange(len(p)) - np.repeat(np.cumsum(times[s]) - times[s], times[s])
                cell = (doc[p] - i) * n + query[of]
                score = np.bincount(cell, weight[of] * worth[p], (j - i) * n)
                match = np.bincount(cell, minlength=(j - i) * n) > 0
                if only is not None:
                    cut = only.offsets.to_numpy()[i:j + 1]
                    counts = np.zeros((j - i) * n, bool)
                    counts[np.repeat(np.arange(j - i), np.diff(cut)) * n + only.values.to_numpy()[cut[0]:cut[-1]]] = True
                    match &= counts
                score[~match] = -np.inf
                score = score.reshape(j - i, n)
                r = np.round(score, RANK_DIGITS)
                least = np.partition(r, j - i - k, axis=0)[j - i - k] if j - i > k else -np.inf
                row, q = np.nonzero((r >= least) & (r > -np.inf))
                best.add(names[i + row], known[i + row], q, score[row, q])
        best.cut()
        for ids, known, q, score in best.parts:
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), pa.array(ids, kind, mask=~known), pa.array(score, pa.float64())], schema.names)
    return docs.mapInArrow(run, schema)


def _block_best(index: BM25Index, wq: DataFrame, postings: list[DataFrame], k: int) -> DataFrame:
    """(qid, doc_id, score): in every partition of the postings the ``k`` best documents of each query that match it."""
    shared, terms, _ = _shared_terms(wq)
    return _union([_best_documents(x.join(F.broadcast(terms), "term").groupBy("doc_id").agg(_hits()), index, shared, wq.schema["qid"], k)
                   for x in postings])


def _unmatched(index: BM25Index, qids: DataFrame, matched: DataFrame | None, k: int) -> DataFrame:
    """(qid, doc_id): among others the k smallest ids that a query does not match.

    With no negative idf every score is >= 0, so the members of a top-k list
    that match nothing are all among the first k ids of the corpus. Otherwise
    negative scores rank below zero, and each slot of documents gives every
    query its own k smallest unmatched ids.
    """
    if index.stats["eps"] >= 0:
        first = [r[0] for r in index.doc_ids.orderBy("doc_id").limit(k).collect()]
        kind = index.doc_ids.schema["doc_id"].dataType
        ids = F.array(*[F.lit(x).cast(kind) for x in first]) if first else F.array().cast(f"array<{kind.simpleString()}>")
        return qids.select("qid", F.explode(ids).alias("doc_id"))
    slots = max(1, math.ceil(index.stats["n"] / SLOT_DOCS))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    asked = qids.select("qid").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    pairs = matched.select("qid", "doc_id", slot.alias("slot")).unionByName(
        asked.withColumn("doc_id", F.lit(None).cast(index.doc_ids.schema["doc_id"].dataType)))
    out = T.StructType([qids.schema["qid"], index.doc_ids.schema["doc_id"]])

    def smallest(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(docs["id"].to_numpy())
        found = []
        for qid, mine in pairs.groupby("qid")["doc_id"]:
            hit = np.searchsorted(ids, mine.dropna().astype(docs["id"].dtype).to_numpy())
            near = np.arange(min(len(ids), k + len(hit)))
            found += [(qid, x) for x in ids[np.setdiff1d(near, hit)[:k]]]
        return pd.DataFrame(found, columns=["qid", "doc_id"])
    docs = index.doc_ids.select(F.col("doc_id").alias("id"), slot.alias("at"))
    return (docs.groupBy("at").cogroup(pairs.groupBy("slot"))
            .applyInPandas(smallest, out))


def bm25_topk(index: BM25Index, queries: DataFrame, k: int, qid_col: str = "qid",
              query_col: str = "query", rank_col: str = "rank") -> DataFrame:
    """Top ``min(k, N)`` documents per query by BM25, score desc then id asc.

    Unmatched documents score 0 and are eligible, so a short list is padded
    with the smallest zero-score ids (this moves the minimum used later by
    min-max normalisation). Plan: the matched scores are summed inside the
    doc_id partitions and cut to the top k per query there (``_block_best``)
    before the only shuffle; the pad candidates then join that small list.
    Exact: a document of the final top k is either among the matched top k
    (positive, zero and negative matched scores keep their relative order) or
    a smallest unmatched id (see ``_unmatched``).
    """
    if k < 0:
        raise ValueError("k must be >= 0")
    qids = queries.select(F.col(qid_col).alias("qid")).distinct()
    tops, matched = [], []
    for qt in _query_blocks(queries, qid_col, query_col):
        weighted = _weighted_terms(index, qt)
        tops.append(rank_topk(_block_best(index, *weighted, max(k, 1)), "qid", "score", "doc_id", k, "_r").drop("_r"))
        if index.stats["eps"] < 0:
            matched.append(_block_scores(index, *weighted).select("qid", "doc_id"))
    pad = _unmatched(index, qids, _union(matched) if matched else None, k).select(
        "qid", "doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("m"))
    cand = _union(tops).withColumn("m", F.lit(True)).unionByName(pad)
    # a pad id that also matched keeps its matched score
    best = cand.groupBy("qid", "doc_id").agg(F.max_by("score", "m").alias("score"))
    return rank_topk(best, "qid", "score", "doc_id", k, rank_col)
