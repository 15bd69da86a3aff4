"""Alignment of two tokenizers' tokens by lockstep merging of their end offsets.

Both token sequences of a text cover the same bytes, so sorted end offsets
decide everything: two tokens are linked where their byte ranges end together,
and such a place cuts both sequences into groups. One NumPy state vector holds
the A and B pointers of every document of a batch. Each step compares the two
end offsets of all of them, emits a link and a cut where they are equal, and
moves the pointer that lags (both, where equal); finished documents are
compacted away. A document much longer than the others of its batch enters as
several lanes, which begin where both sequences are known to end a token.

Every token has a byte at least, so no two tokens of a sequence end together
and each cut is one link. The two tokens of a link end at the same byte, so one
is a suffix of the other: a vocabulary pair can be linked only if so, and the
number of linked pairs is bounded by the bytes of both vocabularies, at any
input size. That bounds the corpus-wide counts, which are broadcast.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprank.llm.common import flat_utf8, row_chunks, written

LANE = 2048           # A tokens from which a document is cut into lanes, about
BATCH_BYTES = 1 << 20  # of text whose tokens a worker holds at once, about
CACHE_WORDS = 200_000  # stretches whose ids a task keeps; all are forgotten when there are more
LAST = 1 << 31         # set in the last token of a group
_SAFE = re.compile(r"(?<=\S) (?=\S)")
# The byte-level alphabet shows these bytes as themselves and the others as 256, 257, ...
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_OF = {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in _SHOWN)} | {chr(b): b for b in _SHOWN}

ALIGNED = "n_a long, n_b long, n_groups long, a_tokens binary, b_tokens binary"
DIGESTS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Bytes of every id of a tokenizer, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        first = np.cumsum(size) - size
        return self.bytes[np.repeat(self.start[ids] - first, size) + np.arange(int(size.sum()))]


class ByteLevel:
    """Byte-level BPE from a tokenizers file; special tokens inside texts are plain text. Reads a space and the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        shown = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.vocabulary = Vocabulary([bytes(map(_BYTE_OF.__getitem__, t)) if all(c in _BYTE_OF for c in t) else t.encode() for t in shown])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """SentencePiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        if any("▁" in m.id_to_piece(i).lstrip("▁") for i in ids):
            raise ValueError("a piece crosses a space, so texts can't be cut there")
        self.vocabulary = Vocabulary([bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i)
                                      else m.id_to_piece(i).replace("▁", " ").encode() for i in ids])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_LOADED: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def load(paths: tuple[str, str]) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, once in each worker process."""
    if paths not in _LOADED:
        _LOADED.clear()
        _LOADED[paths] = ByteLevel(paths[0]), Pieces(paths[1])
    return _LOADED[paths]


class Encoder:
    """Ids of whole texts under both tokenizers, by their stretches; a task keeps those it has met.

    Neither tokenizer's rules look across a space between two other characters,
    so the ids of a text are those of its stretches in turn.
    """

    def __init__(self, paths: tuple[str, str]):
        self.sides = load(paths)
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts in turn, row bounds) of each tokenizer."""
        if len(self.known[0]) >= CACHE_WORDS:
            for known in self.known:
                known.clear()
        rows = [t.split(" ") if t else [] for t in texts]
        fresh = set().union(*rows).difference(self.known[0])
        edgy = {w for w in fresh if not w or w[0].isspace() or w[-1].isspace()}
        if edgy:  # other white space beside a space: such texts are cut between plain characters only
            rows = [r if edgy.isdisjoint(r) else _SAFE.split(t) for r, t in zip(rows, texts, strict=True)]
            fresh = set().union(*rows).difference(self.known[0])
        fresh = list(fresh)
        out = []
        for tokenizer, known in zip(self.sides, self.known, strict=True):
            for lo in range(0, len(fresh), 1 << 14):
                some = fresh[lo:lo + (1 << 14)]
                found = tokenizer.encode(some)
                flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
                stop = np.cumsum([4 * len(x) for x in found]).tolist()
                known.update(zip(some, [flat[x:y] for x, y in zip([0, *stop], stop)], strict=True))
            packed = [b"".join(map(known.__getitem__, r)) for r in rows]
            size = np.array([len(x) // 4 for x in packed], np.int64)
            out.append((np.frombuffer(b"".join(packed), "<u4").astype(np.int64), np.concatenate([[0], np.cumsum(size)])))
        for word in fresh:
            if len(word) > 64 or not word or word[0].isspace() or word[-1].isspace():
                for known in self.known:
                    del known[word]
        return out


def lanes(a_end: np.ndarray, a_bounds: np.ndarray, b_end: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(A pointer, B pointer, A end) of each lane: whole documents, or pieces of long ones."""
    i, j = [a_bounds[:-1]], [b_bounds[:-1]]
    for row in np.flatnonzero(np.diff(a_bounds) >= 2 * LANE):
        a, b = a_end[a_bounds[row]:a_bounds[row + 1]], b_end[b_bounds[row]:b_bounds[row + 1]]
        for p in range(LANE, len(a) - LANE // 2, LANE):
            near = a[p - 1:p + LANE // 2]
            at = np.minimum(np.searchsorted(b, near), len(b) - 1)
            both = np.flatnonzero(b[at] == near)
            if len(both):  # else the lane goes on
                i.append([a_bounds[row] + p + both[0]])
                j.append([b_bounds[row] + at[both[0]] + 1])
    i, j = np.sort(np.concatenate(i)), np.sort(np.concatenate(j))  # both rise together
    end = np.append(i[1:], a_bounds[-1])
    full = i < end
    return i[full], j[full], end[full]


def lockstep(a_end: np.ndarray, b_end: np.ndarray, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of every link, in order, by one state vector over all lanes."""
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(i):
        x, y = a_end[i], b_end[j]
        same = x == y
        links_a.append(i[same])
        links_b.append(j[same])
        i, j = i + (x <= y), j + (y <= x)
        live = i < end  # both sequences of a lane end at one byte, so B is at its end too
        if not live.all():
            i, j, end = i[live], j[live], end[live]
    # Later tokens of a lane have later links, and lanes lie one behind the other: sorted, they pair up again.
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


def align_batch(texts: pa.Array, encoder: Encoder) -> tuple[np.ndarray, ...]:
    """(A ids, A bounds, B ids, B bounds, last A token of each group, last B token, group bounds) of a batch of texts."""
    n = len(texts)
    rows = texts.to_pylist()
    a, b = encoder.sides
    buf, off = flat_utf8(pa.array([" " + t if t else "" for t in rows], pa.large_string()))
    side = []
    for tokenizer, (ids, bounds) in zip((a, b), encoder.ids(rows), strict=True):
        said = tokenizer.vocabulary.joined(ids)
        size = tokenizer.vocabulary.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        side.append((ids, bounds, total, said))
    good = np.ones(n, bool)
    for _, bounds, total, said in side:
        length = total[bounds[1:]] - total[bounds[:-1]]
        good &= length == np.diff(off)
        if len(said) == len(buf) and good.all():
            differ = np.flatnonzero(said != buf)
            good[np.searchsorted(off, differ, side="right") - 1] = False
        else:
            for k in np.flatnonzero(good):
                good[k] = np.array_equal(said[total[bounds[k]]:total[bounds[k + 1]]], buf[off[k]:off[k + 1]])
    base = np.concatenate([[0], np.cumsum(np.where(good, np.diff(off), 0))])
    kept = []
    for ids, bounds, _, _ in side:
        keep = np.repeat(good, np.diff(bounds))
        kept_ids = ids[keep]
        count = np.where(good, np.diff(bounds), 0)
        kept.append((kept_ids, np.concatenate([[0], np.cumsum(count)])))
    (a_ids, a_bounds), (b_ids, b_bounds) = kept
    # Rows without tokens take no bytes, so offsets count on from row to row.
    a_end, b_end = np.cumsum(a.vocabulary.size[a_ids]), np.cumsum(b.vocabulary.size[b_ids])
    last_a, last_b = lockstep(a_end, b_end, *lanes(a_end, a_bounds, b_end, b_bounds))
    return a_ids, a_bounds, b_ids, b_bounds, last_a, last_b, np.searchsorted(a_end[last_a], base, side="right")


def _packed(ids: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of little-endian unsigned 32-bit ids, the last token of each group marked."""
    ids = ids.astype("<u4")
    ids[last] |= LAST
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                 [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())


def unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, last token of each group, group bounds of the rows) of a column of aligned tokens."""
    raw, off = flat_utf8(col)
    ids = np.frombuffer(raw.tobytes(), "<u4")
    last = np.flatnonzero(ids & LAST)
    return (ids & (LAST - 1)).astype(np.int64), last, np.searchsorted(last, off // 4)


def align(docs: DataFrame, paths: tuple[str, str], text: str = "text") -> DataFrame:
    """Adds the alignment of ``text`` to the rows of ``docs``: n_a, n_b, n_groups, a_tokens, b_tokens.

    The tokens are ids in turn, unsigned 32-bit numbers whose top bit marks the
    last token of a group; the k-th marked tokens of both sides are linked.
    Texts that are null or empty, or whose A or B tokens do not join to a space
    and the text, have no tokens. One row per input row, in any number; columns
    of the same names are replaced.
    """
    added = [f.split()[0] for f in ALIGNED.split(",")]
    keep = [c for c in docs.columns if c != text and c not in added]
    schema = docs.select(*keep).schema
    for f in ALIGNED.split(","):
        schema = schema.add(*f.split())

    def run(batches):
        encoder = Encoder(paths)  # forgotten with the task: idle workers hold no words
        for batch in batches:
            texts = batch.column(0)
            _, off = flat_utf8(texts)
            for lo, hi in row_chunks(off, BATCH_BYTES):
                a_ids, a_bounds, b_ids, b_bounds, last_a, last_b, groups = align_batch(texts.slice(lo, hi - lo), encoder)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in batch.columns[1:]],
                     *[pa.array(np.diff(x)) for x in (a_bounds, b_bounds, groups)],
                     _packed(a_ids, last_a, a_bounds), _packed(b_ids, last_b, b_bounds)], names=schema.names)
    return docs.select(text, *keep).mapInArrow(run, schema)


def bounded(batches):
    """Aligned rows in batches of about a quarter of a million A tokens."""
    for batch in batches:
        for lo, hi in row_chunks(flat_utf8(batch.column("a_tokens"))[1], BATCH_BYTES):
            yield batch.slice(lo, hi - lo)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n): the links of each id pair over all rows. A task sends a pair once."""
    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in bounded(batches):
            (a, last_a, _), (b, last_b, _) = [unpacked(batch.column(c)) for c in ("a_tokens", "b_tokens")]
            found, n = np.unique(a[last_a] << 32 | b[last_b], return_counts=True)
            keys, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(counts)], names=["a", "b", "n"])
    return (aligned.select("a_tokens", "b_tokens").mapInArrow(run, "a long, b long, n long")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))


def collected(counts: DataFrame, paths: tuple[str, str]) -> Broadcast:
    """Counts, and whether each is the highest of its B id, for every worker; bounded by the vocabularies' bytes."""
    got = counts.toArrow()
    a, b, n = [got.column(c).to_numpy() for c in ("a", "b", "n")]
    bound = sum(int(t.vocabulary.size.sum()) for t in load(paths))
    if len(n) > 2 * bound:  # a string may be an ordinary token and a byte token
        raise AssertionError("more linked pairs than suffixes in the vocabularies")
    key = a.astype(np.int64) << 32 | b.astype(np.int64)
    order = np.argsort(key)
    top = np.zeros(int(b.max()) + 1 if len(b) else 1, np.int64)
    np.maximum.at(top, b, n)
    return counts.sparkSession.sparkContext.broadcast((key[order], n[order], (n == top[b])[order]))


_SAID: list[bytes] = []  # at 3 * id + mark: the decimal id and a comma, bar or semicolon


def group_text(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, groups: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each row: ids in the order they are said, each with the mark that follows it."""
    size_a, size_b = [np.diff(last, prepend=-1) for last in (last_a, last_b)]
    at_a = np.arange(len(a)) + np.repeat(last_b + 1 - size_b, size_a)
    at_b = np.arange(len(b)) + np.repeat(last_a + 1, size_b)
    said = np.empty(len(a) + len(b), np.int64)
    said[at_a], said[at_b] = 3 * a, 3 * b
    said[at_a[last_a]] += 1
    said[at_b[last_b]] += 2
    most = int(said.max()) if len(said) else -1
    while len(_SAID) <= most:
        _SAID.extend([b"%d%c" % (len(_SAID) // 3, m) for m in b",|;"])
    parts = list(map(_SAID.__getitem__, said.tolist()))
    edge = np.concatenate([[0], np.cumsum(size_a + size_b)])[groups].tolist()
    return [b"".join(parts[x:y])[:-1] for x, y in zip(edge[:-1], edge[1:], strict=True)]


def digests(aligned: DataFrame, shared: Broadcast) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of aligned rows."""
    def run(batches):
        keys, counts, best = shared.value
        for batch in bounded(batches):
            (a, last_a, groups), (b, last_b, _) = [unpacked(batch.column(c)) for c in ("a_tokens", "b_tokens")]
            at = np.searchsorted(keys, a[last_a] << 32 | b[last_b])
            n, top = np.concatenate([[0], np.cumsum(counts[at])]), np.concatenate([[0], np.cumsum(best[at])])
            said = group_text(a, b, last_a, last_b, groups)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_a"), batch.column("n_b"), batch.column("n_groups"),
                 *[pa.array(np.diff(x[groups])) for x in (np.arange(len(at) + 1), top, n)],
                 pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in said], pa.string())],
                names=[f.split()[0] for f in DIGESTS.split(",")])
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "a_tokens", "b_tokens").mapInArrow(run, DIGESTS)


def aligned_digests(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """documents -> digests of the alignment of every whole text, one row per input row.

    The alignment is written once, so texts are tokenised once; an empty table
    gives an empty result. Rows of null doc_id count like any other.
    """
    paths = paths or default_tokenizers()
    rows = written(align(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), paths), "aligned")
    return digests(rows, collected(pair_counts(rows), paths))
