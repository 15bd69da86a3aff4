"""Exact top-k by integer inner product over a bit-sliced index.

The index keeps blocks of rows as bitmaps: bit b of quantised attribute d over
all rows of the block is one slice. A query's scores are the sum of shifted
attribute slices, one per signed binary digit of its components, made by
carry-save addition of bitmaps; all rows of a block are added at once. The best
rows are chosen from the most significant score slice downward; rows that tie
at the boundary are resolved exactly by vec_id.

Components are exact integers of any size that a finite double can give. Rows
are put into blocks by the width of their greatest component (32 bits, then
steps of 64), and blocks of wide rows hold fewer of them, so a block's size is
bounded and one huge component makes no other row's slices longer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sprank.llm.common import partitions, written

BLOCK_ROWS = 1 << 16       # rows of a block of 32-bit components, about
QUERY_ROWS, FEW_QUERIES = 4096, 128  # most queries that meet a block in a task; and where there are too few tasks
SCALE = 256
NARROW = 32                # bits of the first class of rows
MAX_LONG = (1 << 63) - 1


def _usable(vec):
    inf = float("inf")
    return vec.isNotNull() & F.forall(vec, lambda x: F.coalesce((x > -inf) & (x < inf), F.lit(False)))


def _width(vec):
    """Bits that the quantised components of a usable vector fit in, sign included: 32 or a multiple of 64."""
    most = F.coalesce(F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    wide = (F.ceil((F.log2(most) + math.log2(SCALE) + 2) / 64) * 64).cast("int")
    return F.when(most < float(2 ** (NARROW - 2) // SCALE), NARROW).otherwise(wide)


def _ints(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of exact integers floor(256 x): 64-bit, or Python's where those are too short."""
    flat = col.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(flat) or np.abs(flat).max() < 2.0 ** 53:
        return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dim)
    exact = [int(x) * SCALE if abs(x) >= 2.0 ** 53 else math.floor(SCALE * x) for x in flat.tolist()]
    return np.array(exact, object).reshape(-1, dim)


def order_key(v: int) -> bytes:
    """Byte strings that sort as the integers do, whatever their size."""
    n = (abs(v).bit_length() + 7) // 8
    key = (0x8000 + n).to_bytes(2, "big") + abs(v).to_bytes(n, "big")
    return key if v >= 0 else bytes(255 - x for x in key)


def sliced(x: np.ndarray, bits: int) -> np.ndarray:
    """(rows, attributes) of integers of ``bits`` bits -> bitmaps (attribute, bit, 64-bit words), offset to be non-negative."""
    n, dim = x.shape
    out = np.zeros((dim, bits, (n + 63) // 64 * 8), np.uint8)
    for d in range(dim):
        if x.dtype == object:
            size = (bits + 7) // 8
            raw = b"".join((v + (1 << (bits - 1))).to_bytes(size, "little") for v in x[:, d].tolist())
            planes = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(n, size), axis=1, bitorder="little")[:, :bits].T
        else:
            planes = ((x[:, d] + (1 << (bits - 1)))[None, :] >> np.arange(bits)[:, None] & 1).astype(np.uint8)
        out[d, :, :(n + 7) // 8] = np.packbits(planes, axis=1, bitorder="little")
    return out.view(np.uint64)


def bits_of(x: np.ndarray) -> int:
    """Bits of the two's complement that holds all of ``x``."""
    return 1 + max((max(v, -v - 1).bit_length() for v in (int(x.max(initial=0)), int(x.min(initial=0)))), default=0)


def build_index(vectors: DataFrame, sizes: dict[int, int], block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(vec_id, embedding), usable rows only, and their number by width -> (index blocks, number of block ids).

    Blocks (block, dim, n, bits, ids, slices) are written once; a block id holds
    rows of one width class, and a block of one dimension.
    """
    first, count, at = {}, {}, 0
    for width, rows in sorted(sizes.items()):
        first[width], count[width] = at, max(1, math.ceil(rows * width / (block_rows * NARROW)))
        at += count[width]

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")
        dim, n = part["dim"][0].as_py(), part.num_rows
        x = _ints(part["embedding"], dim) if dim else np.zeros((n, 0), np.int64)
        bits = bits_of(x)
        sl = sliced(x, bits) if dim else np.zeros(0, np.uint64)
        return pa.table({"block": part["block"][:1].combine_chunks(), "dim": pa.array([dim], pa.int32()), "n": pa.array([n], pa.int32()), "bits": pa.array([bits], pa.int32()),
                         "ids": pa.array([part["vec_id"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "slices": pa.array([sl.tobytes()], pa.binary())})
    block = F.lit(0)
    for width in sizes:  # 17 classes at most
        mine = first[width] + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(count[width]))
        block = F.when(_width(F.col("embedding")) == width, mine).otherwise(block)
    dealt = vectors.select(block.cast("int").alias("block"), F.size("embedding").alias("dim"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    built = dealt.groupBy("block", "dim").applyInArrow(build, "block int, dim int, n int, bits int, ids binary, slices binary")
    return written(built, "slices"), max(at, 1)


def signed_digits(q: int) -> list[tuple[int, bool]]:
    """(power, negative) of the non-adjacent form of q."""
    out, neg = [], q < 0
    q, p = abs(q), 0
    while q:
        if q & 1:
            d = 2 - (q & 3)
            out.append((p, (d < 0) != neg))
            q -= d
        q >>= 1
        p += 1
    return out


def add_slices(levels: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps of given powers of two: one slice per power of the total."""
    out, p = [], 0
    while p < len(levels):
        now = levels[p]
        if len(now) > 1 and p + 1 == len(levels):
            levels.append([])
        while len(now) > 2:
            a, b, c = now.pop(), now.pop(), now.pop()
            t = a ^ b
            now.append(t ^ c)
            levels[p + 1].append((a & b) | (t & c))
        if len(now) == 2:
            a, b = now
            now[:] = [a ^ b]
            levels[p + 1].append(a & b)
        out.append(now[0] if now else None)
        p += 1
    return out


def best_rows(total: list[np.ndarray], eligible: np.ndarray, k: int) -> np.ndarray:
    """Positions (ascending) of the k rows of largest sum; ties at the boundary to the first positions."""
    sure, tied = np.zeros_like(eligible), eligible
    for s in reversed(total):
        if s is None:
            continue
        x = tied & s
        n = int(np.bitwise_count(sure | x).sum(dtype=np.int64))
        if n > k:
            tied = x
        else:
            sure, tied = sure | x, tied & ~s
            if n == k:
                tied = np.zeros_like(tied)
                break
    at = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    got = at(sure)
    return np.sort(np.concatenate([got, at(tied)[:k - len(got)]]))


def block_top(ids: np.ndarray, slices: np.ndarray, bits: int, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """(query, vec_id, score) of the k best rows of one block for each query, its own row left out; scores are Python's integers."""
    n, words = len(ids), (len(ids) + 63) // 64
    valid = np.zeros(words * 64, np.uint8)
    valid[:n] = 1
    valid = np.packbits(valid, bitorder="little").view(np.uint64)
    inverse = ~slices
    top = (1 << bits) - 1
    out_q, out_v, out_s = [], [], []
    for q, vec in zip(query_ids.tolist(), queries.tolist(), strict=True):
        levels, shift = [[] for _ in range(bits + 1)], -(1 << (bits - 1)) * sum(vec)
        for d, value in enumerate(vec):
            for p, neg in signed_digits(value):
                while len(levels) < p + bits:
                    levels.append([])
                use = inverse[d] if neg else slices[d]
                for b in range(bits):
                    levels[p + b].append(use[b])
                if neg:
                    shift -= top << p
        total = add_slices(levels)
        lo, hi = np.searchsorted(ids, q), np.searchsorted(ids, q, side="right")
        mine = valid
        if hi > lo:
            own = np.zeros(words * 64, np.uint8)
            own[lo:hi] = 1
            mine = valid & ~np.packbits(own, bitorder="little").view(np.uint64)
        rows = best_rows(total, mine, k)
        short = len(total) < 62 and abs(shift) < 1 << 62
        score = np.full(len(rows), shift, np.int64 if short else object)
        for p, s in enumerate(total):
            if s is not None:
                bit = ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
                score += (bit if short else bit.astype(object)) << p
        out_q += [q] * len(rows)
        out_v += ids[rows].tolist()
        out_s += score.tolist()
    return out_q, out_v, out_s


def query_groups(queries: int, blocks: int, tasks: int) -> int:
    """Groups into which the queries are dealt; each is a copy of the index in the shuffle.

    As few as QUERY_ROWS allows; more only while blocks times groups give fewer
    tasks than the session's, down to groups of FEW_QUERIES.
    """
    least, most = math.ceil(queries / QUERY_ROWS), math.ceil(queries / FEW_QUERIES)
    return max(1, least, min(most, math.ceil(tasks / blocks)))


def top_k(index: DataFrame, blocks: int, queries: DataFrame, query_count: int, k: int = 5) -> DataFrame:
    """(vec_id, embedding) queries against all index blocks -> (query_id, rank, vec_id, score).

    Queries and blocks meet group by group: every pair of a block and a group of
    queries is one bounded task. Each task gives k rows per query, so what meets
    in the last ranking is k rows per query and block. Ranks go by the exact
    score; a score beyond 64 bits is given as the nearest long.
    """
    groups = query_groups(query_count, blocks, 2 * partitions(queries))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], []
        if left.num_rows and right.num_rows:
            query_ids = right["vec_id"].to_numpy().astype(np.int64)
            for row in left.to_pylist():
                dim, bits, ids = row["dim"], row["bits"], np.frombuffer(row["ids"], np.int64)
                words = (len(ids) + 63) // 64
                sl = np.frombuffer(row["slices"], np.uint64).reshape(dim, bits, words) if dim else np.zeros((0, bits, words), np.uint64)
                q = _ints(right["embedding"], dim) if dim else np.zeros((right.num_rows, 0), np.int64)
                for a, b in zip(out, block_top(ids, sl, bits, q, query_ids, k), strict=True):
                    a.extend(b)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array([max(-MAX_LONG - 1, min(MAX_LONG, v)) for v in out[2]], pa.int64()),
                         "key": pa.array([order_key(v) for v in out[2]], pa.binary())})

    right = queries.select(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(groups)).cast("int").alias("g"), F.size("embedding").alias("dim"),
                           F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = left.groupBy("block", "g", "dim").cogroup(right.groupBy("block", "g", "dim")).applyInArrow(
        search, "query_id long, vec_id long, score long, key binary")
    w = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Queries: the rows of ``vectors`` whose vec_id is divisible by ``every``; candidates: all others.

    Each component x counts as floor(256 x). Vectors that are null or hold null
    or non-finite components, and rows of null vec_id, take no part. Vectors of
    other dimension than the query's are no candidates; empty vectors score 0.
    Fewer than k candidates are all returned. A vec_id that occurs again is one
    query, with the least of its vectors (in the order of arrays); its other
    rows count as the query's own. An empty table gives an empty result.
    Components may have any finite size; a score beyond 64 bits is given as the
    nearest long, and ranks go by the exact one.
    """
    good = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select("vec_id", "embedding")
    asked = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sizes = good.groupBy(_width(F.col("embedding")).alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).collect()  # 18 rows at most
    index, blocks = build_index(good, {r.width: r.n for r in sizes})
    return top_k(index, blocks, asked, sum(r.asked for r in sizes), k)
