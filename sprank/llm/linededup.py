"""Line deduplication by an exact set-similarity join.

A line is the set of its words (ASCII-lowered, split at white space). It goes
if an earlier line of the corpus, in (doc_id, line number) order, has a Jaccard
similarity of at least NUM / DEN with it; judged on the input, so a line that
goes still removes later ones.

Words are ordered by rarity (counts of a fixed-size table over all lines, then
the word's hash). Two similar lines share a word among the rarest few of each
(prefix filter). Where that word is still frequent, a prefix one word longer
holds a second shared word, and the pair of both words is the key. Lines of
equal word sets are brought together first, by a 64-bit sum over their words:
all but the first go, and only the first is searched. Pairs of lines that meet
are tested by their sizes, by the positions of the shared word, and by the bits
that differ between parity signatures of the two sets (64 bits, 128 or 256 for
long lines), which are at most their difference in words. The most promising earlier
line of each line is verified on its words. Lines whose first candidate fails
are searched again, with all their candidates: these meet with their texts by
the keys that they share, and each line is verified there until one earlier line
is similar, so none is lost and no pairs are returned. Words are compared by 44-bit hashes in the search
and as they are in the verification.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprank.llm.common import (SPACE, flat_utf8, lower_ascii, mix, partitions, prefix_hash, row_chunks, span_hash,
                               word_spans, written)

NUM, DEN = 4, 5
TABLE_BITS = 22   # entries of the table of word rarities: 4 MB shipped, 16 MB while counting, at any input size
BITMAP_BITS = 27  # bits of a line bitmap: 16 MB at any input size
KEY_BITS = 24     # entries of the table of wanted keys: 16 MB; the fuller it is, the more lines are read again
HOT = 1024        # words that occur more often are joined by pairs of words
LONG = 80         # lines of more words carry 128 signature bits, those of more than twice as many 256
PART = 200_000    # lines of a word that meet in one task, about
TOGETHER = 20_000  # occurrences of a word whose pairs with other words are dealt to one bucket, about
HELD = 1 << 20    # lines and words of them that are dealt out at once
SLICE = 50_000    # lines whose postings are dealt out at once
HEADS = 1 << 22   # bytes of packed lines that are unpacked at once
AT_ONCE = 4096    # earlier lines that a line is verified with at once
PAIRS = 1 << 18   # pairs of lines that are tested at once
SMALL = 1024      # groups up to this size are compared whole, larger ones until each line has a candidate
_HASH = np.uint64((1 << 44) - 1)


def _ceil(a, b):
    return -(-a // b)


def _line_ends(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, row, number in its row) of all lines."""
    breaks = np.flatnonzero(buf == 10)
    per_row = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    ends = np.append(np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable"), offsets[-1])
    row = np.repeat(np.arange(len(per_row)), per_row)
    return ends, row, np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)


class Lines:
    """The lines of a chunk of texts and the distinct words of each, the rarest first."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, counts: np.ndarray | None):
        self.offsets, self.row, self.number = _line_ends(buf, offsets)
        start, end, bounds = word_spans(buf, self.offsets, SPACE)
        self.hash = span_hash(prefix_hash(lower_ascii(buf)), start, end) >> np.uint64(20)
        self.line = np.repeat(np.arange(len(self.row)), np.diff(bounds))
        if counts is None:
            return
        rank = counts[(self.hash >> np.uint64(44 - TABLE_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(44) | self.hash
        if len(self.row) < 1 << 14:  # line, rarity (6 bits) and hash fit one sortable number
            key = np.sort(self.line.astype(np.uint64) << np.uint64(50) | rank)
            line, rank = (key >> np.uint64(50)).astype(np.int64), key & np.uint64((1 << 50) - 1)
        else:
            order = np.lexsort((rank, self.line))
            line, rank = self.line[order], rank[order]
        new = np.ones(len(rank), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (line[1:] != line[:-1])
        self.line, self.hash = line[new], rank[new] & _HASH
        self.size = np.bincount(self.line, minlength=len(self.row))
        self.position = np.arange(len(self.line)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.signature = np.zeros(len(self.row), np.uint64)
        some = self.size > 0
        if some.any():
            at = (np.cumsum(self.size) - self.size)[some]
            self.signature[some] = np.bitwise_xor.reduceat(np.uint64(1) << (self.hash & np.uint64(63)), at)

    def wide(self) -> np.ndarray:
        """More signature words of the long lines: three, or one (two of the four folded); with the last they fold to the short signature."""
        out = np.zeros((len(self.row), 3), np.uint64)
        long = self.size > LONG
        if long.any():
            use = long[self.line]
            h, at = self.hash[use], np.concatenate([[0], np.cumsum(self.size[long])[:-1]])
            bit, word = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) & np.uint64(3)
            for k in range(3):
                out[long, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), at)
            mid = self.size <= 2 * LONG
            out[mid, 0] ^= out[mid, 2]
            out[mid, 1:] = 0
        return out

    def in_prefix(self) -> np.ndarray:
        return self.position < _prefix(self.size)[self.line]


def line_id(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.int64).view(np.uint64)) + number.astype(np.uint64) * np.uint64(_ODD))


_ODD = 0xA24BAED4963EE407


def _chunks(batches, counts):
    """Yields (doc ids, buffer, offsets, Lines) of a little text at a time, so that its arrays stay in the cache."""
    for b in batches:
        buf, off = flat_utf8(b.column(1))
        for i, j in row_chunks(off, 1 << 17):
            part, po = buf[off[i]:off[j]], off[i:j + 1] - off[i]
            doc = b.column(0).slice(i, j - i)
            yield doc if doc.null_count else doc.to_numpy(), part, po, Lines(part, po, counts)


def _table_sum(df: DataFrame, run, size: int, dtype=np.int64, op=np.add) -> np.ndarray:
    """Sum (or ``op``) of one fixed-size table per task; slices of it are put together in the cluster."""
    n, step = size, (1 << 16) // np.dtype(dtype).itemsize

    def emit(batches):
        total = run(batches)
        some = [i for i in range(0, n, step) if total[i:i + step].any()]
        for k in range(0, len(some), 32):
            at = some[k:k + 32]
            yield pa.RecordBatch.from_arrays([pa.array([i // step for i in at], pa.int32()), pa.array([zstandard.compress(total[i:i + step].tobytes(), 1) for i in at], pa.binary())], ["at", "t"])

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(step, dtype)
        for x in part["t"].to_pylist():
            op(total, np.frombuffer(zstandard.decompress(x), dtype), out=total)
        return pa.table({"at": part["at"][:1].combine_chunks(), "t": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})
    out = np.zeros(n, dtype)
    for r in df.mapInArrow(emit, "at int, t binary").groupBy("at").applyInArrow(add, "at int, t binary").collect():
        out[r["at"] * step:(r["at"] + 1) * step] = np.frombuffer(zstandard.decompress(r["t"]), dtype)
    return out


def _selected(batches, bitmap, rarity):
    """Yields (doc ids, numbers, texts as bytes, Lines with a line a row) of the lines in a bitmap, about a megabyte at once; only these are split into words."""
    held, size = [], 0

    def split():
        texts = [t for _, _, part in held for t in part]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        return *(np.concatenate(c) for c in zip(*[h[:2] for h in held], strict=True)), texts, Lines(np.frombuffer(b"".join(texts), np.uint8), off, rarity)
    for b in batches:
        buf, off = flat_utf8(b.column(1))
        for i, j in row_chunks(off, 1 << 19):
            part, po = buf[off[i]:off[j]], off[i:j + 1] - off[i]
            ends, row, number = _line_ends(part, po)
            doc = b.column(0).slice(i, j - i).to_numpy()[row]
            use = np.flatnonzero(_has(bitmap, line_id(doc, number)))
            if len(use):
                texts = [part[ends[k]:ends[k + 1]].tobytes().rstrip(b"\n") for k in use.tolist()]
                held.append((doc[use], number[use], texts))
                size += sum(map(len, texts))
                if size >= 1 << 20:
                    yield split()
                    held, size = [], 0
    if held:
        yield split()


def _rarities(docs: DataFrame) -> np.ndarray:
    """Occurrences of words per table entry, in half octaves (under 64)."""
    def run(batches):
        total = np.zeros(1 << TABLE_BITS, np.uint32)
        for _, _, _, lines in _chunks(batches, None):
            np.add.at(total, (lines.hash >> np.uint64(44 - TABLE_BITS)).astype(np.int64), np.uint32(1))
        return total

    def add(a, b, out):
        out[:] = np.minimum(a.astype(np.uint64) + b, np.iinfo(np.uint32).max)
    total = _table_sum(docs, run, 1 << TABLE_BITS, np.uint32, add)
    return np.floor(2 * np.log2(total + 1.0)).astype(np.uint8)


def _occurrences(steps: np.ndarray) -> np.ndarray:
    """At least the occurrences that a rarity stands for; exactly 1 for words that occur once."""
    return np.where(steps <= 2, 1, np.exp2((steps + 1.0) / 2).astype(np.int64))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """(doc_id, number) -> bits of the lines' ids; a set bit may belong to other lines too."""
    def emit(batches):
        for b in batches:
            h = line_id(b.column(0).to_numpy(), b.column(1).to_numpy()) >> np.uint64(64 - BITMAP_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(17)).astype(np.int32)), pa.array((h & np.uint64((1 << 17) - 1)).astype(np.int32))], ["at", "bit"])

    def fill(part: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 17, np.uint8)
        bits[part["bit"].to_numpy()] = 1
        return pa.table({"at": part["at"][:1].combine_chunks(), "t": pa.array([np.packbits(bits).tobytes()], pa.binary())})
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    cells = ids.select("doc_id", "number").mapInArrow(emit, "at int, bit int").distinct()
    for r in cells.groupBy("at").applyInArrow(fill, "at int, t binary").collect():
        out[r["at"] << 14:(r["at"] + 1) << 14] = np.frombuffer(r["t"], np.uint8)
    return out


def _has(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    h = (ids >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bitmap[h >> 3] >> (7 - (h & 7)).astype(np.uint8) & 1).astype(bool)


# A block of postings: columns of equal length, packed one after the other.
_FIELDS = (("word", np.uint32), ("part", np.uint32), ("doc", np.int64), ("number", np.int32), ("size", np.int32), ("position", np.int32), ("signature", np.uint64))


def _wide_bytes(wide: np.ndarray, size: np.ndarray) -> bytes:
    """The wide signatures without the words that lines of these sizes do not have."""
    return wide[size > LONG, 0].tobytes() + wide[size > 2 * LONG, 1:].tobytes()


def _wide_from(raw: bytes, at: int, size: np.ndarray) -> tuple[np.ndarray, int]:
    """(the wide signatures at a place of ``raw``, the place after them)."""
    wide, long, longer = np.zeros((len(size), 3), np.uint64), size > LONG, size > 2 * LONG
    n, m = int(long.sum()), 2 * int(longer.sum())
    wide[long, 0] = np.frombuffer(raw, np.uint64, n, at)
    wide[longer, 1:] = np.frombuffer(raw, np.uint64, m, at + 8 * n).reshape(-1, 2)
    return wide, at + 8 * (n + m)


def _pack(cols: list[np.ndarray]) -> bytes:
    """Columns of _FIELDS and the wide signatures."""
    wide = _wide_bytes(cols[-1], cols[4])
    cols = [np.diff(c, prepend=c.dtype.type(0)) if i == 2 else c for i, c in enumerate(cols[:-1])]
    raw = [np.int64(len(cols[0])).tobytes(), *(c.astype(d).tobytes() for c, (_, d) in zip(cols, _FIELDS, strict=True)), wide]
    return zstandard.compress(b"".join(raw), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, at, out = int(np.frombuffer(raw[:8], np.int64)[0]), 8, []
    for i, (_, d) in enumerate(_FIELDS):
        size = n * np.dtype(d).itemsize
        c = np.frombuffer(raw[at:at + size], d)
        out.append(np.cumsum(c) if i == 2 else c)
        at += size
    return [*out, _wide_from(raw, at, out[4])[0]]


def _prefix_keys(x: Lines, use: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, join key, occurrences of the word) for the prefix words ``use``."""
    n = _occurrences(rarity[(x.hash[use] >> np.uint64(44 - TABLE_BITS)).astype(np.int64)])
    use, n = use[n > 1], n[n > 1]  # a word that occurs once is shared by no other line
    # A frequent word goes with each later word of the prefix that is one word longer;
    # a line of one word, which only its equals match, stays alone.
    size = x.size[x.line[use]]
    later = np.minimum(size, size - _ceil(NUM * size, DEN) + 2) - 1 - x.position[use]
    hot = (n > HOT) & (size > 1)
    times = np.where(hot, later, 1)
    i = np.repeat(np.arange(len(use)), times)
    nth = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
    key = x.hash[use][i]
    two = hot[i]
    key[two] = mix(key[two] * np.uint64(_ODD) + x.hash[use[i[two]] + 1 + nth[two]])
    return use[i], key, n[i]


def _prefix(size: np.ndarray) -> np.ndarray:
    return size - _ceil(NUM * size, DEN) + 1


class Heads(Lines):
    """Lines of which the words of the prefix and one more are known, but for the leading ones that occur once."""

    def __init__(self, size: np.ndarray, first: np.ndarray, words: np.ndarray, hashes: np.ndarray):
        self.size, self.hash = size, hashes
        self.line = np.repeat(np.arange(len(size)), words)
        self.position = np.arange(len(hashes)) - np.repeat(np.cumsum(words) - words - first, words)


# A block of lines: columns of equal length, the wide signatures of long lines, then the words of all.
_HEAD = (("total", np.uint64), ("doc", np.int64), ("number", np.int32), ("size", np.int32), ("first", np.int32), ("words", np.int32), ("signature", np.uint64))


def _pack_heads(cols: list[np.ndarray], wide: np.ndarray, hashes: np.ndarray) -> bytes:
    cols = [np.diff(c, prepend=c.dtype.type(0)) if i == 1 else c for i, c in enumerate(cols)]
    raw = [np.int64(len(cols[0])).tobytes(), *(c.astype(d).tobytes() for c, (_, d) in zip(cols, _HEAD, strict=True)), _wide_bytes(wide, cols[3]),
           (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (hashes >> np.uint64(32)).astype(np.uint16).tobytes()]
    return zstandard.compress(b"".join(raw), 1)


def _unpack_heads(data: bytes) -> list[np.ndarray]:
    """Columns of _HEAD, the wide signatures and the words."""
    raw = zstandard.decompress(data)
    n, at, out = int(np.frombuffer(raw[:8], np.int64)[0]), 8, []
    for i, (_, d) in enumerate(_HEAD):
        c = np.frombuffer(raw, d, n, at)
        out.append(np.cumsum(c) if i == 1 else c)
        at += n * np.dtype(d).itemsize
    wide, at = _wide_from(raw, at, out[3])
    n = (len(raw) - at) // 6
    return [*out, wide, np.frombuffer(raw, np.uint32, n, at) | np.frombuffer(raw, np.uint16, n, at + 4 * n).astype(np.uint64) << np.uint64(32)]


def _firsts(size, total, doc, number, sig) -> tuple[np.ndarray, np.ndarray]:
    """(the first line of every word set, the later lines of each but repeats of the first)."""
    order = np.lexsort((sig, number, doc, total, size))
    same = np.zeros(len(order), bool)
    same[1:] = (total[order[1:]] == total[order[:-1]]) & (size[order[1:]] == size[order[:-1]])
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    # A row of the same doc_id, number and words is the same line again.
    copy = order[same & ((doc[order] != doc[first]) | (number[order] != number[first]))]
    return order[~same], copy


def _heads(docs: DataFrame, rarity, buckets: int) -> DataFrame:
    """(bucket, copies, data): blocks of lines dealt by their word sets.

    Lines of equal word sets that are held at once are one; the later ones come as copies.
    Lines whose prefix shares no word with any line are left out.
    """
    def run(batches):
        held, size = [], 0
        for doc, _, _, x in _chunks(batches, rarity.value):
            did, number, sig, wide = doc[x.row], x.number, x.signature, x.wide()
            # Lines of equal word sets: hashes added up are the same.
            total = np.zeros(len(x.row), np.uint64)
            some = np.flatnonzero(x.size > 0)
            if len(some):
                total[some] = np.add.reduceat(mix(x.hash), (np.cumsum(x.size) - x.size)[some])
            head = x.position < np.minimum(x.size, _prefix(x.size) + 1)[x.line]
            head &= _occurrences(rarity.value[(x.hash >> np.uint64(44 - TABLE_BITS)).astype(np.int64)]) > 1
            keyed = np.zeros(len(x.row), bool)
            keyed[x.line[head & x.in_prefix()]] = True
            head = np.flatnonzero(head & keyed[x.line])
            words = np.bincount(x.line[head], minlength=len(x.row))
            line = np.flatnonzero(keyed)
            skip = x.position[head[(np.cumsum(words) - words)[line]]]  # words that occur once come first
            held.append((total[line], did[line], number[line], x.size[line], skip, words[line], sig[line], wide[line], x.hash[head]))
            size += len(line) + len(head)
            if size >= HELD:
                yield from _headed(held, buckets)
                held, size = [], 0
        if size:
            yield from _headed(held, buckets)
    return docs.mapInArrow(run, _BLOCK)


def _headed(held: list, buckets: int):
    """Yields the blocks of the lines of several chunks: the copies, and for each bucket that has any the first lines."""
    *cols, wide, hashes = (np.concatenate(c) for c in zip(*held, strict=True))
    total, did, number, size, _, words, sig = cols
    first, copy = _firsts(size, total, did, number, sig)
    if len(copy):
        yield _copies(int(sig[copy[0]] % np.uint64(buckets)), did[copy], number[copy], sig[copy], wide[copy])
    to = (mix(total[first]) % np.uint64(buckets)).astype(np.int64)
    at = np.lexsort((number[first], did[first], to))
    begin, cut = np.cumsum(words) - words, np.searchsorted(to[at], np.arange(buckets + 1))
    some, out = np.flatnonzero(np.diff(cut)).tolist(), []
    for k in some:
        i = first[at[cut[k]:cut[k + 1]]]
        n = words[i]
        w = np.repeat(begin[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out.append(_pack_heads([c[i] for c in cols], wide[i], hashes[w]))
    yield _blocks(some, out)


def _postings(docs: DataFrame, rarity, buckets: int) -> DataFrame:
    """Blocks of prefix postings of the lines of documents."""
    return _posted(_heads(docs, rarity, buckets), rarity, buckets)


def _posted(heads: DataFrame, rarity, buckets: int) -> DataFrame:
    """(bucket, copies, data): blocks of prefix postings.

    Lines of equal word sets are one; the later ones come as copies. The keys
    of one word go to one bucket, those of a very frequent word by their second
    word to several. A word with very many postings is dealt into parts, any
    two of its lines sharing one.
    """
    def run(block: pa.Table) -> pa.Table:
        out, heads = [], []
        for copies, data in zip(block["copies"].to_pylist(), block["data"].to_pylist(), strict=True):
            if copies:
                out.append(_block(int(zlib.crc32(data) % buckets), True, data))
            else:
                heads.append(_unpack_heads(data))
        if heads:
            total, did, number, size, skip, words, sig, wide, hashes = (np.concatenate(c) for c in zip(*heads, strict=True))
            size = size.astype(np.int64)
            first, copy = _firsts(size, total, did, number, sig)
            if len(copy):
                out.append(_copies(int(sig[copy[0]] % np.uint64(buckets)), did[copy], number[copy], sig[copy], wide[copy]))
            begin = np.cumsum(words, dtype=np.int64) - words
            for i in range(0, len(first), SLICE):
                ln = first[i:i + SLICE]
                ln = ln[np.lexsort((number[ln], did[ln]))]
                n = words[ln].astype(np.int64)
                x = Heads(size[ln], skip[ln], n, hashes[np.repeat(begin[ln] - np.cumsum(n) + n, n) + np.arange(n.sum())])
                postings = _prefix_keys(x, np.flatnonzero(x.in_prefix()), rarity.value)
                out.append(_dealt_blocks(x, *postings, did[ln], number[ln], sig[ln], wide[ln], buckets))
        return pa.Table.from_batches(out, schema=_EMPTY)
    return heads.groupBy("bucket").applyInArrow(run, _BLOCK)


def _dealt(x: Lines, use, key, n, did, number, sig, wide, buckets: int):
    """Yields (bucket, lines, columns of a block) of the postings ``use`` of lines, one or none a bucket; ``use`` is ascending."""
    line = x.line[use]
    share = np.where(n > PART, _ceil(2 * n, PART), 1)
    own = (line_id(did, number)[line] % share.astype(np.uint64)).astype(np.int64)
    rep = np.repeat(np.arange(len(use)), share)
    other = np.arange(len(rep)) - np.repeat(np.cumsum(share) - share, share)
    own, c = own[rep], share[rep]
    part = np.minimum(own, other) * c + np.maximum(own, other)
    use, line, key, n = use[rep], line[rep], key[rep], n[rep]
    home = x.hash[use] + (mix(key) % _ceil(n, TOGETHER).astype(np.uint64)) * np.uint64(_ODD)
    bucket = ((mix(mix(home) + part.astype(np.uint64) * np.uint64(_ODD)) >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
    at = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    for k in np.flatnonzero(np.diff(cut)).tolist():
        i = at[cut[k]:cut[k + 1]]
        u, ln = use[i], line[i]
        yield k, ln, [key[i], part[i], did[ln], number[ln], x.size[ln], x.position[u], sig[ln], wide[ln]]


def _dealt_blocks(*args) -> pa.RecordBatch:
    """The blocks of ``_dealt``."""
    out = {k: _pack(cols) for k, _, cols in _dealt(*args)}
    return _blocks([*out], [*out.values()])


_BLOCK = "bucket int, copies boolean, data binary"
_EMPTY = pa.schema([("bucket", pa.int32()), ("copies", pa.bool_()), ("data", pa.binary())])


def _block(bucket: int, copies: bool, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([copies]), pa.array([data], pa.binary())], schema=_EMPTY)


def _blocks(buckets: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([False] * len(data), pa.bool_()), pa.array(data, pa.binary())], schema=_EMPTY)


def _copies(bucket: int, did, number, sig, wide) -> pa.RecordBatch:
    i = np.lexsort((number, did))
    none = np.zeros(len(i), np.int64)
    return _block(bucket, True, _pack([none, none, did[i], number[i], none, none, sig[i], wide[i]]))


def _differ(a, b, size, sig, wide):
    """Bits that differ between the signatures of rows a and b."""
    x = sig[a] ^ sig[b]
    out = np.bitwise_count(x).astype(np.int16)
    least = np.minimum(size[a], size[b])
    both = np.flatnonzero(least > 2 * LONG)
    if len(both):
        rest = wide[a[both]] ^ wide[b[both]]
        last = x[both] ^ rest[:, 0] ^ rest[:, 1] ^ rest[:, 2]
        out[both] = np.bitwise_count(last).astype(np.int16) + np.bitwise_count(rest).sum(1, dtype=np.int16)
    both = np.flatnonzero((least > LONG) & (least <= 2 * LONG))
    if len(both):  # the third word of a line that has none is 0
        p, q = wide[a[both]], wide[b[both]]
        half = p[:, 0] ^ p[:, 2] ^ q[:, 0] ^ q[:, 2]
        out[both] = np.bitwise_count(half).astype(np.int16) + np.bitwise_count(x[both] ^ half)
    return out


def _may_match(a, b, size, pos, sig, wide):
    """(can the sets of rows a and b be similar, bits that differ between the signatures)."""
    both = size[a] + size[b]
    need = _ceil(NUM * both, NUM + DEN)
    ok = (np.minimum(size[a] - pos[a], size[b] - pos[b]) >= need) & (np.minimum(size[a], size[b]) * DEN >= NUM * np.maximum(size[a], size[b]))
    differ = np.full(ok.shape, 999, np.int16)
    i = np.flatnonzero(ok)
    differ[i] = _differ(a[i] if np.ndim(a) else np.full(len(i), a), b[i] if np.ndim(b) else np.full(len(i), b), size, sig, wide)
    return ok & (differ <= both - 2 * need), differ


def _least_shared(size_a, size_b):
    """Words that the prefixes of two similar lines share at least."""
    return _ceil(NUM * (size_a + size_b), NUM + DEN) - _ceil(NUM * np.maximum(size_a, size_b), DEN) + 1


def _search(cols: list[np.ndarray], only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(later, earlier) row numbers of candidates of one bucket.

    Without ``only`` one earlier row for each line that has any; with ``only``
    (a bitmap of lines) all earlier rows of the lines in it, as often as they
    meet.
    """
    if only is not None:
        none = np.zeros(0, np.int64)
        late, early = zip((none, none), *_earlier(cols, only), strict=True)
        return np.concatenate(late), np.concatenate(early)
    order, new, doc, number, size, pos, sig, wide = _grouped(cols)
    group = np.cumsum(new) - 1
    best, found = np.full(len(order), 999, np.int16), np.full(len(order), -1)

    def keep(a, b):
        """Offer row b to the later row a."""
        ok, differ = _may_match(a, b, size, pos, sig, wide)
        ok &= ((doc[a] != doc[b]) | (number[a] != number[b])) & (differ < best[a])
        best[a[ok]], found[a[ok]] = differ[ok], b[ok]

    # Lines alike in size, position and whole signature, so in all that the tests look at: the first
    # of a group is the candidate of the others, if it may be, and stands for them before later lines.
    by = np.lexsort((size << 32 | pos, sig, group))
    x, y = by[1:], by[:-1]
    same = np.zeros(len(by), bool)
    same[1:] = (group[x] == group[y]) & (sig[x] == sig[y]) & (size[x] == size[y]) & (pos[x] == pos[y]) & (wide[x] == wide[y]).all(1)
    lead = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
    keep(by[same], lead[same])
    rows = np.flatnonzero(found < 0)
    count = np.bincount(group[rows], minlength=group[-1] + 1 if len(group) else 0)
    few = rows[count[group[rows]] <= SMALL]
    few = few[np.lexsort((size[few], group[few]))]
    g, big = group[few], size[few]
    act, s = np.arange(len(few)), 0
    while len(act):  # every row against the row s places on, while sizes allow it
        s += 1
        act = act[act < len(few) - s]
        act = act[(g[act] == g[act + s]) & (big[act + s] * NUM <= big[act] * DEN)]
        x, y = few[act], few[act + s]
        keep(np.maximum(x, y), np.minimum(x, y))
    many = rows[count[group[rows]] > SMALL]
    for mine in np.split(many, np.flatnonzero(np.diff(group[many])) + 1) if len(many) else ():
        wait = mine
        for b in mine:  # the earliest first, against all later rows without a candidate
            wait = wait[(wait > b) & (found[wait] < 0)]
            if not len(wait):
                break
            keep(wait, np.full(len(wait), b))
    a = np.flatnonzero(found >= 0)
    by = a[np.lexsort((best[a], sig[a], number[a], doc[a]))]  # the best of each line
    first = np.ones(len(by), bool)
    first[1:] = (doc[by[1:]] != doc[by[:-1]]) | (number[by[1:]] != number[by[:-1]]) | (sig[by[1:]] != sig[by[:-1]])
    a = by[first]
    return order[a], order[found[a]]


def _grouped(cols: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(order of rows by group and line, does a group begin, doc, number, size, position, signatures) in that order.

    Rows that are alone in their group are left out.
    """
    word, part, doc, number, size, pos, sig, wide = cols
    w = word.astype(np.uint64) << np.uint64(32) | part
    by = np.argsort(w)
    same = np.diff(w[by]) == 0
    order = np.sort(by[np.append(same, False)[:len(by)] | np.append(False, same)[:len(by)]])
    order = order[np.lexsort((sig[order], number[order], doc[order], w[order]))]
    w = w[order]
    new = np.concatenate([[True], w[1:] != w[:-1]])[:len(w)]
    return order, new, *(c[order] for c in (doc, number, size.astype(np.int64), pos.astype(np.int64), sig, wide))


def _earlier(cols: list[np.ndarray], only: np.ndarray):
    """Yields (rows of lines in the bitmap ``only``, candidates among the earlier rows of their groups), some pairs at a time.

    Positions are not looked at: any shared word may bring two similar lines
    together, and only the rarest one need stand early in both.
    """
    order, new, doc, number, size, pos, sig, wide = _grouped(cols)
    cut, begin = np.flatnonzero(new), np.zeros_like(pos)
    rows = np.flatnonzero(_has(only, line_id(doc, number)))
    first = cut[np.searchsorted(cut, rows, side="right") - 1]
    for i, j in row_chunks(np.concatenate([[0], np.cumsum(rows - first)]), PAIRS):
        n = rows[i:j] - first[i:j]
        a = np.repeat(rows[i:j], n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[i:j], n)
        ok, _ = _may_match(a, b, size, begin, sig, wide)
        ok &= (doc[a] != doc[b]) | (number[a] != number[b])
        if ok.any():
            yield order[a[ok]], order[b[ok]]


_KEY = ["doc_id", "number", "signature"]
_PAIR = "doc_id long, number int, signature long, e_doc long, e_number int, e_signature long, differ int"


def _pairs(cols, a, b) -> pa.Table:
    _, _, doc, number, size, _, sig, wide = cols
    return pa.table({"doc_id": doc[a], "number": number[a].astype(np.int32), "signature": sig[a].view(np.int64), "e_doc": doc[b], "e_number": number[b].astype(np.int32),
                     "e_signature": sig[b].view(np.int64), "differ": _differ(a, b, size, sig, wide).astype(np.int32)})


def _candidates(postings: DataFrame) -> DataFrame:
    """(line, its best earlier line, differ), written; differ is -1 for copies, which need no verification."""
    def run(part: pa.Table) -> pa.Table:
        out = []
        for copies in (True, False):
            data = [x for x, c in zip(part["data"].to_pylist(), part["copies"].to_pylist(), strict=True) if c == copies]
            if data:
                cols = [np.concatenate(c) for c in zip(*map(_unpack, data), strict=True)]
                rows = np.arange(len(cols[0]))
                t = _pairs(cols, *((rows, rows) if copies else _search(cols, None)))
                out.append(t.set_column(6, "differ", pa.array(np.full(len(t), -1, np.int32))) if copies else t)
        return pa.concat_tables(out)
    found = postings.groupBy("bucket").applyInArrow(run, _PAIR)
    best = found.groupBy(*_KEY).agg(F.min(F.struct("differ", "e_doc", "e_number", "e_signature")).alias("m"))
    return written(best.select(*_KEY, "m.e_doc", "m.e_number", "m.e_signature", "m.differ"), "candidates")


def _size_class(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits shifted out, the three leading bits) of sizes."""
    shift = np.maximum(np.frexp(size.astype(np.float64))[1] - 3, 0).astype(np.int64)
    return shift, size >> shift


def _key_at(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Table entry of a key in lines of a size."""
    shift, top = _size_class(size)
    return (mix(key + (8 * shift + top).astype(np.uint64) * np.uint64(_ODD)) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def _asked(key: np.ndarray, size: np.ndarray):
    """Yields (entries, shared keys at least) under which lines similar to lines of ``size`` words have the keys, by class of their sizes."""
    low, high = _ceil(NUM * size, DEN), DEN * size // NUM
    while len(key):
        shift, top = _size_class(low)
        last = np.minimum(((top + 1) << shift) - 1, high)
        # Between the two sizes it may be one less; a frequent word may count once less than it is shared.
        least = np.minimum(_least_shared(size, low), _least_shared(size, last)) - 2
        yield _key_at(key, low), np.clip(least, 1, 255)
        more = last < high
        key, size, low, high = key[more], size[more], last[more] + 1, high[more]


def _enough(line: np.ndarray, least: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Which wanted keys of lines, in line order, are enough for each line to meet all asking ones similar to it.

    The asking lines keep all. Where no key is asked for with fewer than n to be
    shared, any n - 1 can go: the last ones, of the most frequent words.
    """
    if not len(line):
        return np.ones(0, bool)
    begin = np.flatnonzero(np.diff(line, prepend=-1))
    count = np.diff(begin, append=len(line))
    after = np.repeat(begin + count, count) - 1 - np.arange(len(line))
    return asks[line] | (after >= np.repeat(np.minimum.reduceat(least, begin), count) - 1)


def _unpacked(batches):
    """Yields (doc ids, numbers, signatures, Heads) of some blocks of lines at a time."""
    for b in batches:
        data = [x for x, copies in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True) if not copies]
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        for i, j in row_chunks(sizes, HEADS):
            _, did, number, size, skip, words, sig, wide, hashes = (np.concatenate(c) for c in zip(*map(_unpack_heads, data[i:j]), strict=True))
            yield did, number, sig, wide, Heads(size.astype(np.int64), skip, words, hashes)


def _near(heads: DataFrame, asks, rarity, buckets: int) -> tuple[DataFrame, Broadcast]:
    """(doc_id, number) of the lines in the bitmap ``asks`` and of their candidates, once a bucket; the table of wanted keys.

    An entry of the table holds 256 less the keys to be shared. A line similar
    to one of ``asks`` finds at least n entries that ask for n or fewer; only
    such lines meet, by the keys of these entries.
    """
    def keys(batches):
        total = np.zeros(1 << KEY_BITS, np.uint8)
        for did, number, _, _, x in _unpacked(batches):
            mine = _has(asks.value, line_id(did, number))
            use, key, _ = _prefix_keys(x, np.flatnonzero(mine[x.line] & x.in_prefix()), rarity.value)
            for at, least in _asked(key, x.size[x.line[use]]):
                np.maximum.at(total, at, (256 - least).astype(np.uint8))
        return total
    wanted = heads.sparkSession.sparkContext.broadcast(_table_sum(heads, keys, 1 << KEY_BITS, np.uint8, np.maximum))

    def deal(batches):
        for did, number, sig, wide, x in _unpacked(batches):
            use, key, n = _prefix_keys(x, np.flatnonzero(x.in_prefix()), rarity.value)
            least = 256 - wanted.value[_key_at(key, x.size[x.line[use]])].astype(np.int64)
            use, key, n, least = (c[least < 256] for c in (use, key, n, least))
            at = np.lexsort((least, x.line[use]))
            line = x.line[use][at]
            mine = _has(asks.value, line_id(did, number))
            hit = mine.copy()
            hit[line[least[at] <= np.arange(1, len(line) + 1) - np.searchsorted(line, line)]] = True
            ok = hit[x.line[use]] & _enough(x.line[use], least, mine)
            if ok.any():
                yield _dealt_blocks(x, use[ok], key[ok], n[ok], did, number, sig, wide, buckets)

    def meet(part: pa.Table) -> pa.Table:
        cols = [np.concatenate(c) for c in zip(*map(_unpack, part["data"].to_pylist()), strict=True)]
        hit = np.zeros(len(cols[0]), bool)
        for a, b in _earlier(cols, asks.value):
            hit[a] = hit[b] = True
        doc, number = cols[2][hit], cols[3][hit]
        order = np.lexsort((number, doc))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(doc[order]) != 0) | (np.diff(number[order]) != 0)
        return pa.table({"doc_id": doc[order[new]], "number": number[order[new]]})
    return heads.mapInArrow(deal, _BLOCK).groupBy("bucket").applyInArrow(meet, "doc_id long, number int"), wanted


class Words:
    """The words of lines, numbered, and the lines as they are."""

    def __init__(self, lines: list[bytes], rarity: np.ndarray):
        self.lines = lines
        x = Lines(np.frombuffer(b"".join(lines), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in lines])]).astype(np.int64), rarity)
        distinct, self.word = np.unique(x.hash, return_inverse=True)
        self.size, self.begin = x.size, np.cumsum(x.size) - x.size
        self.mark = np.zeros(len(distinct), bool)

    def similar(self, a: int, others: np.ndarray) -> bool:
        """Is line ``a`` similar to one of ``others``, by their numbers?"""
        mine = self.word[self.begin[a]:self.begin[a] + self.size[a]]
        self.mark[mine] = True
        try:
            for i in range(0, len(others), AT_ONCE):
                b = others[i:i + AT_ONCE]
                n = self.size[b]
                at = np.cumsum(n) - n
                shared = np.add.reduceat(self.mark[self.word[np.repeat(self.begin[b] - at, n) + np.arange(n.sum())]], at, dtype=np.int64)
                if any(_similar(self.lines[a], self.lines[k]) for k in b[shared * DEN >= NUM * (self.size[a] + n - shared)]):
                    return True
            return False
        finally:
            self.mark[mine] = False


def _similar(x: bytes, y: bytes) -> bool:
    x, y = set(x.lower().split()), set(y.lower().split())
    both = len(x & y)
    return both * DEN >= NUM * (len(x) + len(y) - both)


def _found_again(docs: DataFrame, heads: DataFrame, failed: DataFrame, rarity) -> DataFrame:
    """Those lines of ``failed`` that any earlier line matches, each once, written.

    The candidates found over the stored lines are dealt with their texts by
    the wanted keys, and verified where they meet.
    """
    sc, buckets = docs.sparkSession.sparkContext, partitions(docs)
    asks = sc.broadcast(_bitmap(failed))
    near, wanted = _near(heads, asks, rarity, buckets)
    near = sc.broadcast(_bitmap(written(near.distinct(), "near")))  # written, or each task would keep two Python workers

    def deal(batches):
        for did, number, lines, x in _selected(batches, near.value, rarity.value):
            use, key, n = _prefix_keys(x, np.flatnonzero(x.in_prefix()), rarity.value)
            least = 256 - wanted.value[_key_at(key, x.size[x.line[use]])].astype(np.int64)
            use, key, n, least = (c[least < 256] for c in (use, key, n, least))
            ok = _enough(x.line[use], least, _has(asks.value, line_id(did, number)))
            out = []
            for k, ln, cols in _dealt(x, use[ok], key[ok], n[ok], did, number, x.signature, x.wide(), buckets):
                some, at = np.unique(ln, return_inverse=True)
                out.append((k, _pack(cols), at.astype(np.int32), zstandard.compress(b"\n".join(lines[i] for i in some.tolist()), 1)))
            if out:
                types = (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["bucket", "data", "at", "lines"])

    def verify(part: pa.Table) -> pa.Table:
        cols = [np.concatenate(c) for c in zip(*map(_unpack, part["data"].to_pylist()), strict=True)]
        at, lines = part["at"].combine_chunks(), [zstandard.decompress(x).split(b"\n") for x in part["lines"].to_pylist()]
        n = np.array([len(x) for x in lines])
        at = at.flatten().to_numpy() + np.repeat(np.cumsum(n) - n, at.value_lengths().to_numpy())
        words = Words([t for x in lines for t in x], rarity.value)
        found = {}
        for a, b in _earlier(cols, asks.value):
            pair, i = np.unique(at[a] * len(words.lines) + at[b], return_index=True)  # two lines may meet by several keys
            line, other = pair // len(words.lines), pair % len(words.lines)
            begin = np.flatnonzero(np.diff(line, prepend=-1))
            for j, k in zip(begin.tolist(), [*begin[1:].tolist(), len(line)], strict=True):
                if line[j] not in found and words.similar(line[j], other[j:k]):
                    found[line[j]] = a[i[j]]
        a = np.array(list(found.values()), np.int64)
        return pa.table({"doc_id": cols[2][a], "number": cols[3][a], "signature": cols[6][a].view(np.int64)})
    met = docs.mapInArrow(deal, "bucket int, data binary, at array<int>, lines binary")
    found = met.groupBy("bucket").applyInArrow(verify, "doc_id long, number int, signature long")
    return written(found.distinct().join(failed, _KEY, "left_semi"), "matches")


def _verified(docs: DataFrame, pairs: DataFrame, rarity) -> DataFrame:
    """Those (doc_id, number, signature) of written ``pairs`` whose word sets are similar to their partner's."""
    ends = pairs.select("doc_id", "number", "signature").unionByName(
        pairs.select(F.col("e_doc").alias("doc_id"), F.col("e_number").alias("number"), F.col("e_signature").alias("signature")))
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(ends))

    def fetch(batches):
        for doc, number, lines, x in _selected(batches, wanted.value, rarity.value):
            use = np.flatnonzero(x.size > 0)
            yield pa.RecordBatch.from_arrays([pa.array(doc[use]), pa.array(number[use].astype(np.int32)), pa.array(x.signature[use].view(np.int64)),
                                              pa.array([lines[i] for i in use], pa.binary())], ["doc_id", "number", "signature", "line"])

    def verify(batches):
        for b in batches:
            ok = [_similar(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:3], ["doc_id", "number", "signature"]).filter(pa.array(ok, pa.bool_()))
    texts = docs.mapInArrow(fetch, "doc_id long, number int, signature long, line binary")
    # Both joins name the same columns, so the lines are fetched and shuffled once.
    first = pairs.select(*_KEY, "e_doc", "e_number", "e_signature").join(texts, _KEY).select(*[F.col(c).alias(f"o_{c}") for c in (*_KEY, "line")], F.col("e_doc").alias("doc_id"),
                                          F.col("e_number").alias("number"), F.col("e_signature").alias("signature"))
    both = first.join(texts, _KEY).select(*[F.col(f"o_{c}").alias(c) for c in (*_KEY, "line")], F.col("line").alias("e_line"))
    return both.mapInArrow(verify, "doc_id long, number int, signature long")


def duplicate_lines(docs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(doc_id, number, signature) of the lines that an earlier line matches, and the table of rarities."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    spark = docs.sparkSession
    rarity = spark.sparkContext.broadcast(_rarities(docs))
    heads = written(_heads(docs, rarity, partitions(docs)), "lines")
    best = _candidates(_posted(heads, rarity, partitions(docs)))
    pairs = best.where("differ >= 0")
    found = written(_verified(docs, pairs, rarity).distinct(), "matches")
    failed = written(pairs.select(*_KEY).join(found, _KEY, "left_anti"), "unresolved")
    found = found.unionByName(best.where("differ < 0").select(*_KEY))
    if not failed.isEmpty():
        found = found.unionByName(_found_again(docs, heads, failed, rarity))
    return found, rarity


def _stripped(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the kept text, and how many lines there were and went."""
    found, rarity = duplicate_lines(docs)
    lines = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("number", "signature")).alias("__gone"))
    rows = docs.join(lines, docs["doc_id"].cast("long") == lines["__id"], "left").select(F.col("text").alias("__text"), "__gone", *keep)
    schema = docs.select(*keep).schema.add("__kept", "string").add("__lines", "long").add("__went", "long")

    def run(batches):
        for b in batches:
            buf, off = flat_utf8(b.column(0))
            gone, kept, n, went = b.column(1), [], [], []
            values, bounds = gone.flatten(), [0] * (b.num_rows + 1)
            for i, v in enumerate(gone.to_pylist()):
                bounds[i + 1] = bounds[i] + (len(v) if v else 0)
            number, sig = values.field(0).to_numpy(), values.field(1).to_numpy().view(np.uint64)
            for i, j in row_chunks(off, 1 << 19):
                part, po = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                x, raw = Lines(part, po, rarity.value), part.tobytes()
                first = np.searchsorted(x.row, np.arange(j - i + 1))
                for r in range(j - i):
                    s = slice(bounds[i + r], bounds[i + r + 1])
                    lines = raw[po[r]:po[r + 1]].split(b"\n")
                    drop = {int(k) for k, g in zip(number[s], sig[s], strict=True) if k < len(lines) and x.signature[first[r] + k] == g}
                    kept.append(b"\n".join(x for k, x in enumerate(lines) if k not in drop).decode() if drop else None)
                    n.append(len(lines) if po[r + 1] > po[r] else 0)
                    went.append(len(drop))
            text = pa.array([t if k is None else k for k, t in zip(kept, b.column(0).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[2:], text, pa.array(n, pa.int64()), pa.array(went, pa.int64())], names=schema.names)
    return rows.mapInArrow(run, schema)


def line_counts(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_lines, n_removed, removed_lines), one row per input row.

    removed_lines: the numbers (from 0, ascending) of the lines that go. Lines
    end at line feeds. Lines without words, null and empty texts and rows of a
    null doc_id stay as they are and match nothing; null and empty texts have
    no lines. Rows that repeat a doc_id and a text are one document; rows that
    share only the doc_id are told apart by their lines' words.
    """
    found, rarity = duplicate_lines(docs)

    def run(batches):
        for doc, _, po, x in _chunks(batches, rarity.value):
            first = np.append(np.searchsorted(x.row, np.arange(len(doc))), len(x.row)).astype(np.int32)
            n = np.where(np.diff(po) > 0, np.diff(first), 0)
            marks = pa.ListArray.from_arrays(pa.array(first), pa.array(x.signature.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), marks], ["doc_id", "n_lines", "marks"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = found.groupBy("doc_id").agg(F.collect_list(F.struct("number", "signature")).alias("gone"))
    if rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"))) + 1
        rows = rows.select("doc_id", F.when(F.col("text") != "", lines).otherwise(0).cast("long").alias("n_lines"))
        mine = F.col("gone")
    else:
        rows = rows.mapInArrow(run, "doc_id long, n_lines long, marks array<long>")
        mine = F.filter("gone", lambda g: (g["number"] < F.col("n_lines")) & (F.get("marks", g["number"]) == g["signature"]))
    went = F.coalesce(F.array_sort(F.transform(mine, lambda g: g["number"])), F.array().cast("array<int>"))
    return (rows.join(gone, "doc_id", "left").withColumn("removed_lines", went)
            .select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines"))


def strip_lines(docs: DataFrame) -> DataFrame:
    """The documents with their duplicate lines taken out of ``text``.

    Documents that lose every line with words go: all they said stands earlier.
    Columns are returned as they came; n_chars, if there, is counted anew.
    """
    out = _stripped(docs, docs.columns)
    gone = (F.col("__went") > 0) & ~F.coalesce(F.col("__kept"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    text = {"text": F.col("__kept")} | ({"n_chars": F.when(F.col("__went") > 0, F.length("__kept").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return out.where(~gone).withColumns(text).select(*docs.columns)
