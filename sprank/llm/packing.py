"""Packing documents into token windows by non-negative least squares.

Texts are tokenised once; each document becomes full windows and one rest of
fewer tokens than a window. Shallow combinations of rest lengths that fill a
window exactly are enumerated from the histogram of rest lengths (at most one
entry per length below the window), repeat counts come from non-negative least
squares against that histogram, are rounded down, and used up greedily. What is
left over is laid end to end and cut at window ends.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprank.llm.common import buckets_for, running_totals, written

WINDOW = 4096
END_ID = 2
CACHE_WORDS = 400_000  # words whose ids a task keeps; all are forgotten when it is full
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")  # white space to some and not to others, or a special token's start
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@[-`{-~]*)")
_CASED = re.compile("[^\x00-\xff]")  # beyond Latin-1 the case of a letter may depend on its neighbours or change its length
# The byte-level alphabet shows these bytes as themselves and the others as 256, 257, ...
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}
_ALPHABET = [chr(_HIDDEN.get(b, b)) for b in range(256)]


class WordIds(dict):
    """Token ids of white-space separated words as packed 16-bit numbers.

    The tokenizer's rules never look across white space, so the ids of a text
    are those of its words in turn. Letters and the punctuation after them are
    looked up apart, lower-cased, which finds most words again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.packed = [i.to_bytes(2, "little") for i in range(size)]

    def direct(self, text: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def __missing__(self, word: str) -> bytes:
        m = _PLAIN.fullmatch(word)
        if not m:
            out = self.direct(word)
        elif m[2]:
            out = self[m[1]] + self[m[2]]  # punctuation is a piece of its own
        elif (low := word.lower()) != word:
            out = self[low]
        else:  # small letters: one piece to the rules, so the model alone decides
            seen = word if word.isascii() else "".join([_ALPHABET[b] for b in word.encode()])
            out = b"".join([self.packed[t.id] for t in self.model.tokenize(seen)])
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out

    def text(self, text: str) -> bytes:
        for odd in _ODD:
            if odd in text:
                return self.direct(text)
        if text.isascii() or not _CASED.search(text):
            text = text.lower()  # as the tokenizer does, but at once: one entry for a word at all its places
        return b"".join(map(self.__getitem__, text.split()))


def tokenized(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(uid, doc_id, n, crcs, rest, rest_crc): ids per document, written once.

    n counts the ids with the end id; crcs are those of the full windows; rest
    holds the remaining ids as 16-bit numbers.
    """
    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<u4").tobytes())

    def run(batches):
        words = WordIds(path)  # forgotten with the task: idle workers hold no words
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                out = []
                for t in b.column(1).slice(lo, 256).to_pylist():
                    ids = np.append(np.frombuffer(words.text(t or ""), np.uint16), np.uint16(END_ID))
                    full = len(ids) // window
                    rest = ids[full * window:]
                    out.append((len(ids), [crc(ids[i * window:(i + 1) * window]) for i in range(full)], rest.tobytes(), crc(rest)))
                n, crcs, rest, last = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, 256), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.array(last, pa.int64())],
                    ["doc_id", "n", "crcs", "rest", "rest_crc"])
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, crcs array<long>, rest binary, rest_crc long")
    return written(found.withColumn("uid", F.monotonically_increasing_id()), "tokens")


def combinations(count: np.ndarray, window: int, per_length: int = 6) -> list[tuple[int, ...]]:
    """Pairs, triples and quadruples of present lengths that sum to the window, the longest first.

    All pairs; for each longest length the ``per_length`` triples of the most
    frequent partners, and as many quadruples with each of a few frequent short
    lengths.
    """
    have = np.flatnonzero(count)
    out = [(int(a), int(window - a)) for a in have if 2 * a >= window and count[window - a]]

    def triples(total: int, tail: tuple[int, ...]) -> None:
        for a in have[(have < total) & (3 * have >= total)]:
            b = have[(2 * have >= total - a) & (have <= a) & (have < total - a)]
            c = total - a - b
            ok = count[c] > 0
            b, c = b[ok], c[ok]
            top = np.argsort(-np.minimum(count[b], count[c]), kind="stable")[:per_length]
            out.extend((int(a), int(b[i]), int(c[i]), *tail) for i in top)
    triples(window, ())
    small = have[have < window // 8]
    for s in small[np.argsort(-count[small], kind="stable")[:4]]:
        triples(window - int(s), (int(s),))
    return out


def solve(count: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 20) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts of combinations that never use a length more often than it occurs.

    Non-negative least squares by coordinate descent, rounded down; then what
    the rounded counts leave is offered to the combinations again in turn.
    """
    cols = [(np.array(list(m)), np.array(list(m.values()), float)) for m in map(Counter, combos)]
    left, x = count.astype(float).copy(), np.zeros(len(cols))
    for _ in range(sweeps):
        moved = 0.0
        for k, (rows, m) in enumerate(cols):
            step = max(-x[k], float(left[rows] @ m) / float(m @ m))
            if step:
                x[k] += step
                left[rows] -= step * m
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    free, used = count.astype(np.int64).copy(), np.zeros(len(cols), np.int64)
    order = np.argsort(-x, kind="stable")
    for most in (np.floor(x).astype(np.int64), np.full(len(cols), np.iinfo(np.int64).max)):
        for k in order:
            rows, m = cols[k]
            n = int(min(most[k], (free[rows] // m.astype(np.int64)).min()))
            if n > 0:
                free[rows] -= n * m.astype(np.int64)
                used[k] += n
    return [(combos[k], int(used[k])) for k in range(len(cols)) if used[k]]


def _places(chosen: list[tuple[tuple[int, ...], int]], window: int) -> tuple[np.ndarray, ...]:
    """For each length, the ranges of ranks dealt to combinations: (key of first rank, key of end, sequence, times, offset)."""
    begin, out, base = np.zeros(window, np.int64), [], 0
    for combo, n in chosen:
        at = 0
        for length, times in sorted(Counter(combo).items(), reverse=True):
            out.append((length << 40 | int(begin[length]), length << 40 | int(begin[length]) + n * times, base, times, at))
            begin[length] += n * times
            at += length * times
        base += n
    cols = np.array(sorted(out), np.int64).reshape(-1, 5).T
    return (*cols, base)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """documents -> pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Null and empty texts are the end id alone. Repeated rows and rows of a null
    doc_id are documents of their own. Sequences hold ``window`` ids but for
    the very last. An empty table gives no pieces. Other columns are not read.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, tokenizer, window)
    found = tokens.agg(F.count(F.lit(1)), F.sum(F.floor(F.col("n") / window))).first()
    rows, full = int(found[0]), int(found[1] or 0)
    buckets = buckets_for(rows)
    count = np.zeros(window, np.int64)
    for r, n in tokens.groupBy((F.col("n") % window).alias("r")).count().collect():  # at most ``window`` lengths
        count[r] = n
    count[0] = 0
    chosen = solve(count, combinations(count, window))
    first, end, base, times, offset, combos = _places(chosen, window)
    shared = spark.sparkContext.broadcast((first, end, base, times, offset))

    whole = running_totals(tokens.where(F.size("crcs") > 0).select("uid", "doc_id", "n", "crcs"), ["uid"], {"before": F.size("crcs")}, buckets=buckets)
    whole = (whole.select("doc_id", "n", "before", F.posexplode("crcs").alias("i", "crc"))
             .select("doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
                     F.col("n").alias("doc_tokens"), (F.col("before") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))

    rest = tokens.select("uid", "doc_id", "n", "rest_crc", (F.col("n") % window).alias("r")).where("r > 0")
    ranked = running_totals(rest, ["uid"], {"rank": F.lit(1)}, within=["r"], buckets=buckets)

    def place(batches):
        first, end, base, times, offset = shared.value
        for b in batches:
            r, rank = b.column("r").to_numpy(), b.column("rank").to_numpy()
            key = r << 40 | rank
            i = np.searchsorted(first, key, side="right") - 1
            ok = (i >= 0) & (key < (end[i] if len(end) else 0))
            i = np.where(ok, i, 0)
            nth = key - (first[i] if len(first) else 0)
            if len(first):
                seq, at = base[i] + nth // times[i], offset[i] + nth % times[i] * r
            else:
                seq = at = np.zeros(len(r), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), b.column("n"), b.column("rest_crc"), b.column("r"), pa.array(seq, mask=~ok), pa.array(at, mask=~ok)],
                                             ["uid", "doc_id", "n", "rest_crc", "r", "seq", "at"])
    placed = written(ranked.select("uid", "doc_id", "n", "rest_crc", "r", "rank").mapInArrow(
        place, "uid long, doc_id long, n long, rest_crc long, r long, seq long, at long"), "placed")

    def rests(df: DataFrame, seq, at) -> DataFrame:
        return df.select("doc_id", (F.col("n") - F.col("r")).alias("start"), F.col("r").alias("length"), F.col("rest_crc").alias("ids_crc32"),
                         F.col("n").alias("doc_tokens"), seq.alias("sequence_id"), at.alias("offset"))

    late = running_totals(placed.where("seq is null").select("uid", "doc_id", "n", "rest_crc", "r"), ["uid"], {"pos": F.col("r")}, buckets=buckets)
    late = written(late, "residual")
    crossing = F.floor(F.col("pos") / window) < F.floor((F.col("pos") + F.col("r") - 1) / window)
    base_late = full + combos
    cut = late.where(crossing).join(tokens.select("uid", "rest"), "uid")

    def divide(batches):
        for b in batches:
            out = []
            for doc, n, r, pos, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "r", "pos", "rest")), strict=True):
                ids = np.frombuffer(ids, np.uint16).astype("<u4")
                head = window - pos % window
                for lo, hi, seq, at in ((0, head, pos // window, pos % window), (head, r, pos // window + 1, 0)):
                    out.append((doc, n - r + lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), n, base_late + seq, at))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    pieces = cut.select("doc_id", "n", "r", "pos", "rest").mapInArrow(
        divide, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return (whole.unionByName(rests(placed.where("seq is not null"), F.col("seq") + full, F.col("at")))
            .unionByName(rests(late.where(~crossing), F.floor(F.col("pos") / window) + base_late, F.col("pos") % window))
            .unionByName(pieces))


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
