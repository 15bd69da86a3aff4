"""Each operator and the pipeline against brute force, a round trip or held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001
from pyspark.sql import functions as F
from tests_llm_tokens import ids_of

import corpus_pipeline
from sprank.llm import langid, linededup, minhash, mixing, packing, queries, simhash, substrings, topk, toxicity, warc
from sprank.llm.common import flat_utf8
from sprank.llm.components import connected_components

Q = queries.queries()


def plain_top(rows, every=50, k=5):
    """Rows of distinct ids -> exact top-k in Python's integers."""
    exact = {i: [int(Fraction(x) * 256 // 1) for x in v] for i, v in rows if v is not None and all(map(math.isfinite, v))}
    out = []
    for q in sorted(i for i in exact if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q and len(v) == len(exact[q]))[:k]
        out += [(q, n + 1, i, max(-2 ** 63, min(2 ** 63 - 1, -s))) for n, (s, i) in enumerate(best)]
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r.doc_id, r.text) for r in rows]


def test_line_dedup(spark, texts):
    gone = brute.removed_lines(texts)
    got = {r.doc_id: (r.n_lines, r.removed_lines) for r in Q["op1_line_dedup"](spark, SF001).collect()}
    assert got == {i: (len(t.split("\n")) if t else 0, gone[i]) for i, t in texts}
    assert sum(map(len, gone.values())) > 100


def test_line_search_finds_all_pairs(monkeypatch):
    """Frequent words by pairs and both searches, on lines of few distinct words, some of them long."""
    monkeypatch.setattr(linededup, "LONG", 8)
    rng = np.random.default_rng(1)
    lines = [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 14)) % 30) for _ in range(1500)]
    buf = "\n".join(lines).encode()
    counts = np.zeros(1 << linededup.TABLE_BITS, np.int64)
    off = np.array([0, len(buf)])
    x = linededup.Lines(np.frombuffer(buf, np.uint8), off, None)
    np.add.at(counts, (x.hash >> np.uint64(44 - linededup.TABLE_BITS)).astype(int), 1)
    rarity = np.floor(2 * np.log2(counts + 1.0)).astype(np.uint8)
    x = linededup.Lines(np.frombuffer(buf, np.uint8), off, rarity)
    sets = [frozenset(s.lower().split()) for s in lines]
    want = {(i, j) for i in range(1500) for j in range(i) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    for hot, small in ((10 ** 9, 10 ** 9), (20, 10 ** 9), (20, 3)):
        monkeypatch.setattr(linededup, "HOT", hot)
        monkeypatch.setattr(linededup, "SMALL", small)
        use, key, _ = linededup._prefix_keys(x, np.flatnonzero(x.in_prefix()), rarity)
        ln = x.line[use]
        order = np.lexsort((ln, key))
        use, key, ln = use[order], key[order], ln[order]
        cols = [key.astype(np.uint32), np.zeros(len(key), np.uint32), np.zeros(len(key), np.int64), ln.astype(np.int32),
                x.size[ln].astype(np.int32), x.position[use].astype(np.int32), x.signature[ln], x.wide()[ln]]
        everyone = np.full(1 << (linededup.BITMAP_BITS - 3), 255, np.uint8)
        a, b = linededup._search(cols, everyone)
        met = Counter(zip(ln[a].tolist(), ln[b].tolist()))
        enough = {p for p, n in met.items() if n >= max(1, int(linededup._least_shared(len(sets[p[0]]), len(sets[p[1]]))) - 1)}
        assert want <= enough, hot
        a, b = linededup._search(cols, None)
        assert (ln[a] > ln[b]).all()
        assert {i for i, _ in want} <= set(ln[a].tolist())


def test_equal_lines_meet_before_the_search(spark):
    """Lines of equal word sets in different tasks: one is searched, the others are copies; long lines among them."""
    line = " ".join(f"word{i}" for i in range(100))
    rows = [(i, f"{line.upper() if i % 2 else line}\nown{i} line{i}\n{line} more{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    rarity = spark.sparkContext.broadcast(linededup._rarities(docs))
    found = [(r.copies, linededup._unpack(bytes(r.data))) for r in linededup._postings(docs, rarity, 3).collect()]
    copies = sorted(zip(*(np.concatenate([c[i] for is_copy, c in found if is_copy]).tolist() for i in (2, 3)), strict=True))
    assert copies == [(i, 0) for i in range(1, 60)]
    searched = {x for is_copy, c in found if not is_copy for x in zip(c[2].tolist(), c[3].tolist(), c[4].tolist(), strict=True)}
    assert searched == {(0, 0, 100)} | {(i, 2, 101) for i in range(60)}
    gone = brute.removed_lines(rows)
    got = {r.doc_id: r.removed_lines for r in linededup.line_counts(docs).collect()}
    assert got == {i: sorted(gone.get(i, [])) for i, _ in rows}


def test_second_line_search_returns_no_pairs(spark, monkeypatch):
    """A large group just under the threshold, some of it over: what is written grows with the lines, not with their pairs."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{i}" for i in rng.permutation(80)[14:]) for _ in range(200)]
    rows = sorted((int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True))
    sizes, write = [], linededup.written

    def counted(df, name):
        out = write(df, name)
        sizes.append((name, out.count()))
        return out
    monkeypatch.setattr(linededup, "written", counted)
    gone = brute.removed_lines(rows)
    got = {r.doc_id: r.removed_lines for r in linededup.line_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: sorted(gone.get(i, [])) for i, _ in rows} and sum(map(len, got.values())) > 20
    assert [x for x in sizes if x[0] == "unresolved"][0][1] > 50  # the second search has something to do
    assert max(n for _, n in sizes) <= len(rows), sizes


def test_line_search_keeps_alike_rows_as_partners(spark):
    """A line that resembles only a row that was left to a row of the same size and signature."""
    rng = np.random.default_rng(8)
    names = ["".join(chr(c) for c in rng.integers(97, 123, 9)) for _ in range(300)]
    bit = {x: int(linededup.Lines(np.frombuffer(x.encode(), np.uint8), np.array([0, 9]), None).hash[0]) & 63 for x in names}
    r, q = next((x, y) for n, x in enumerate(names) for y in names[:n] if bit[x] == bit[y])
    w, e, c = "word", "end", [f"common{i}" for i in range(8)]
    rows = [(1, " ".join([r, w, *c])), (2, " ".join([w, q, *c])), (3, " ".join([w, q, *c, e]))]
    rows += [(10 + n, " ".join([x] * k)) for n, (x, k) in enumerate([(q, 10), *((x, 100) for x in c), (e, 900)])]
    gone = brute.removed_lines(rows)
    got = {i.doc_id: i.removed_lines for i in linededup.line_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: gone[i] for i, _ in rows} and got[3] == [0]


def test_simhash(spark, texts):
    fps = [brute.simhash(t) for _, t in texts]
    comp = brute.components([i for i, _ in texts], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q["op2_simhash"](spark, SF001).collect()}
    assert got == {i: (f"{f:016x}", comp[i]) for (i, _), f in zip(texts, fps)}
    assert len(set(comp.values())) < len(comp)


def test_golay_decodes_three_errors():
    code, rng = simhash.Golay(), np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 500)
    word = w ^ code.error[code.low[w & 0xFFF] ^ code.high[w >> 12]]
    for _ in range(20):
        bits = [1 << b for b in rng.choice(23, 3, replace=False)]
        assert (code.index(word ^ sum(bits)) == word >> 11).all()
        assert (code.index(word ^ bits[0]) == word >> 11).all()


def test_fuzzy_keys_meet_within_four_bits():
    code, rng = simhash.Golay(), np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n in range(5):
        flip = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for _ in a], np.uint64)
        keys = []
        for f in (a, a ^ flip):
            r, k = simhash.fuzzy_keys(f, code)
            mine = defaultdict(set)
            for i, x in zip(r.tolist(), k.tolist()):
                mine[i].add(x)
            keys.append(mine)
        assert all(keys[0][i] & keys[1][i] for i in range(len(a)))


def test_links_of_hot_keys(spark, monkeypatch):
    """Large groups give a spanning forest, also when a key is split into parts."""
    monkeypatch.setattr(simhash, "CHUNK", 60)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 3)
    fps = {int(b) for b in base}
    for _ in range(400):
        b = int(rng.choice(base))
        for x in rng.choice(64, rng.integers(1, 7), replace=False):
            b ^= 1 << int(x)
        fps.add(b - (1 << 64) if b >= 1 << 63 else b)
    fps = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = brute.components(list(range(len(fps))), np.array(fps, np.int64).view(np.uint64))
    groups = defaultdict(set)
    for i, f in enumerate(fps):
        groups[got.get(f, f)].add(i)
    assert sorted(map(min, groups.values())) == sorted(set(want.values()))
    assert all(want[i] == min(g) for g in groups.values() for i in g)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = Q["op3_language_id"](spark, SF001).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in Q["op4_toxicity"](spark, d).where("held_out").collect() if r.doc_id in toxic]
    hit = Counter((toxic[r.doc_id], r.predicted) for r in held)
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.75  # some 300 toxic rows to learn from here
    assert hit[0, 0] / (hit[0, 0] + hit[0, 1]) > 0.99


def test_language_models_equal_a_plain_walk(monkeypatch):
    rng = np.random.default_rng(1)
    scripts = ["abc de", "наш мир", "日本語 です", "مرحبا ب", "\x00\x7fßéñ"]
    draw = lambda k, n: "".join(rng.choice(list(scripts[k] + "ab "), n))
    taught = [(str(k), draw(k, 40)) for k in range(5) for _ in range(4)] + [("5", "".join(map(chr, range(1, 2500))))]
    assert len(set("".join(t for _, t in taught).encode())) > 127
    texts = [draw(k, int(rng.integers(0, 60))) for k in range(5) for _ in range(5)] + ["", "a", "zq", "\u07ff\U0001f600"]
    labels = sorted({x for x, _ in taught})
    which = np.concatenate([np.full(len(t.encode()), labels.index(x)) for x, t in taught])
    grams = np.concatenate([langid._grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for _, t in taught]).astype(np.int64)
    model, want = langid.Model(labels, which, grams, np.ones(len(grams))), brute.code_lengths(taught, texts)
    for size in (1 << 18, 7):  # whole texts at once, and in pieces
        monkeypatch.setattr(langid, "CHUNK_BYTES", size)
        got = model.lengths(*flat_utf8(pa.array(texts)))
        assert [[got[i][j] for j in range(len(labels))] for i in range(len(texts))] == [
            pytest.approx([want[i][x] for x in labels], abs=1e-3) for i in range(len(texts))]


def test_language_query_equals_a_plain_walk(spark):
    rows = [(i, " ".join(f"{a}{(i * 7 + k) % 11}" for k in range(6)) + (" я" if i % 5 == 0 else ""), a)
            for i in range(60) for a in ["ab", "ba", "cé"][i % 3:i % 3 + 1]]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    taught = [(a, t) for i, t, a in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    for (i, _, _), bits in zip(rows, brute.code_lengths(taught, [t for _, t, _ in rows])):
        best = min(sorted(bits), key=bits.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()), abs=1e-4)


@pytest.mark.parametrize("cells", [4, 16])
def test_samples_are_the_least_hashes(spark, monkeypatch, cells):
    monkeypatch.setattr(langid, "HASH_CELLS", cells)
    monkeypatch.setattr(toxicity, "HASH_CELLS", cells)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), F.lit("four").alias("text"))
    rows = rows.unionByName(rows.where("doc_id < 900").limit(300))
    at = {s: {r.doc_id: r.h for r in rows.select("doc_id", F.xxhash64("doc_id", F.lit(s)).alias("h")).collect()} for s in (3, 5)}
    least = lambda ids, s, n: sorted(ids, key=lambda i: (at[s][i], i))[:n]
    want = {(i, x) for x, rest in (("a", {0}), ("b", {1, 2})) for i in least([i for i in range(4000) if i % 3 in rest], 3, 70)}
    assert {tuple(r) for r in langid.sample_ids(rows, 70, 1000).collect()} == want
    assert langid.sample_ids(rows, 70, 41).groupBy("label").count().collect() == langid.sample_ids(rows, 10, 1000).groupBy("label").count().collect()
    assert langid.sample_ids(rows, 70, 1).count() == 2
    once = rows.distinct().withColumn("label", F.lit(1))
    assert sorted(r.doc_id for r in toxicity.sample_ids(once, 70).collect()) == sorted(least(range(4000), 5, 70))


def test_toxicity_learner_memory():
    """Beyond the two tables of the learner nothing of their size is held."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 1 << toxicity.DIM_BITS, 50)).astype(np.int32) for _ in range(200)]
    rows = [np.union1d(x, np.arange(20 * (i % 2), 20 * (i % 2) + 20)).astype(np.int32) for i, x in enumerate(rows)]
    tracemalloc.start()
    f, w, _ = toxicity.ftrl(rows, np.arange(200) % 2.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(f) >= 40 and (w != 0).all()
    assert peak < 2.5 * 8 * (1 << toxicity.DIM_BITS)


def test_toxicity_equals_plain_ftrl(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)] + ["Ärger", "x1"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 14)))) + (" bad thing" if i % 3 == 0 else "")) for i in range(400)]
    labels = [(i, int(i % 3 == 0)) for i in range(400)]
    model = toxicity.learn_labels(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.s for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"], "s").collect()}
    at = {r.doc_id: r.h for r in spark.range(400).select(F.col("id").alias("doc_id"), F.xxhash64("id", F.lit(5)).alias("h")).collect()}

    def grams(text):
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))
        return {(x,) for x in w} | {(1, *p) for p in zip(w, w[1:])} | {(2, *p) for p in zip(w, w[2:])}
    learned = sorted((i for i, _ in rows if zlib.crc32(str(i).encode()) % 5), key=at.get)
    weights, bias = brute.ftrl([grams(rows[i][1]) for i in learned], [labels[i][1] for i in learned],
                               toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    for i, text in rows:
        p = 1 / (1 + np.exp(-(bias + sum(weights.get(g, 0) for g in grams(text)))))
        assert got[i] == pytest.approx(p, abs=1e-4)
    assert len(weights) == len(model[0])


def test_ftrl_leaves_noise_at_zero():
    rng = np.random.default_rng(0)
    y = (rng.random(600) < 0.3).astype(float)
    rows = [np.unique(np.append(rng.integers(100, 5000, 40), [7] if t else [8])) for t in y]
    f, w, _ = toxicity.ftrl(rows, y, bits=13)
    weight = dict(zip(f.tolist(), w.tolist()))
    assert weight[7] > 1 and weight.get(8, 0) <= 0 and len(f) < 500


def test_topk(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF001}/embeddings.parquet')")
    want = sorted(con.execute(queries.oracle_sql()["op5_topk"]).fetchall())
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in Q["op5_topk"](spark, SF001).collect()) == want


def test_topk_of_components_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * 10.0 ** int(rng.choice([0, 2, 7, 8, 12, 17, 25, 300]))).tolist()) for i in range(240)]
    rows += [(300, [1e7, 1.0, 0.0]), (301, [-1.7976931348623157e308, 5e-324, -0.001]), (302, [2.0 ** 45, -2.0 ** 45, 0.5]), (303, [8388608.0, -8388608.0, 0.0]),
             (304, [float("inf"), 0.0, 0.0]), (350, [0.0, 0.0, 0.0]), (400, [2.0 ** 22, 2.0 ** 53, -2.0 ** 53]), (450, [0.25, -0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.nearest(df).collect())
    assert got == plain_top(rows)
    assert any(abs(r[3]) > 2 ** 62 for r in got) and any(abs(r[3]) < 2 ** 40 for r in got)


def test_order_keys_sort_as_integers():
    v = sorted({s * (1 << e) + d for s in (-1, 1) for e in (0, 7, 8, 15, 16, 63, 64, 300, 2100) for d in (-1, 0, 1)})
    assert sorted(v, key=topk.order_key) == v


def test_query_groups_copy_the_index_rarely():
    assert topk.query_groups(1000, 1, 16) == 8         # small index: enough tasks
    assert topk.query_groups(10 ** 6, 800, 400) == 245  # large one: a copy per 4,096 queries
    assert topk.query_groups(0, 1, 16) == 1


def test_bit_sliced_scores_are_exact():
    rng = np.random.default_rng(4)
    x = np.sort(rng.integers(-900, 900, (333, 7)), axis=0)
    q = rng.integers(-900, 900, (5, 7))
    q[0] = 0
    bits = 11
    words = (333 + 63) // 64
    u = np.zeros((7, words * 64), np.int64)
    u[:, :333] = (x + 1024).T
    sl = np.stack([np.packbits((u >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], axis=1)
    got = topk.block_top(np.arange(333), sl.view(np.uint64).reshape(7, bits, words), bits, q, np.array([400, 401, 5, 6, 7]), 6)
    want = []
    for i, v in zip([400, 401, 5, 6, 7], q):
        best = sorted((-int(s), j) for j, s in enumerate(x @ v) if j != i)[:6]
        want += sorted((i, j, -s) for s, j in best)
    assert list(zip(*got)) == want


def test_minhash(spark, texts):
    got = {r.doc_id: r for r in Q["op6_minhash"](spark, SF001).collect()}
    sets = [brute.shingles(t) for _, t in texts]
    off = []
    for n, (i, t) in enumerate(texts):
        cut, nxt = len(t or "") // 4, texts[(n + 1) % len(texts)][1] or ""
        edited = (t or "")[:len(t or "") - cut] + nxt[:cut]
        r = got[i]
        assert r.n_chars == len(t or "") and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off.append(r.near_edited - brute.jaccard(sets[n], brute.shingles(edited)))
        off.append(r.near_next - brute.jaccard(sets[n], sets[(n + 1) % len(texts)]))
    assert np.abs(off).mean() < 0.03 and abs(np.mean(off)) < 0.01
    by_text = defaultdict(set)
    for i, t in texts:
        by_text[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_minhash_over_chunk_ends(spark):
    """Texts of megabytes: every row meets its next across chunk and partition ends."""
    df = spark.createDataFrame([(i, f"text {i} " * 90_000) for i in range(9)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in minhash.edited_fingerprints(df).collect()}
    assert len(got) == 9
    for i in range(9):
        t, n = f"text {i} " * 90_000, f"text {(i + 1) % 9} " * 90_000
        cut = len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - cut] + n[:cut]).encode()).hexdigest()


def test_substrings(spark, texts):
    want = brute.repeats(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q["op7_substrings"](spark, SF001).collect()}
    assert got == {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in want.items()}


def test_substrings_at_edges(spark):
    """Runs of one byte, repeats of just the window, overlaps, and repeats at both ends of a text."""
    rng = np.random.default_rng(5)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    a, b = word(50), word(70)
    rows = [(1, "x" * 60 + a), (2, a + "y" * 49), (3, "x" * 49), (4, "x" * 51 + b), (5, b[:49] + "q" + b[1:] + a[1:]), (6, "é" * 40), (7, "é" * 30), (8, a[:49] + b), (9, "")]
    rows += [(10 + i, "".join(rng.choice(["ab", "ba", "c"], 400))) for i in range(30)]
    want = brute.repeats(rows)
    from sprank.llm.substrings import remove_repeats
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: v[:3] for i, v in want.items()}


def test_substrings_of_long_texts_in_pieces(spark):
    rng = np.random.default_rng(9)
    # Over two million windows a piece: repeats over the ends of pieces, found in a short and in a long text.
    long = rng.integers(97, 123, 5 << 20).astype(np.uint8).tobytes()
    cut = substrings.PIECE
    first = long[cut - 300:cut + 200] + b"|" + long[2 * cut + 10:2 * cut + 100] + b"|" + long[:70] + b"|" + long[-64:]
    other = long[cut - 20:cut + 29] + b"#" + long[100:149]  # 49 bytes: too short
    later = b"x" * 7 + long[cut - 100_000:2 * cut + 100_000] + b"y"
    docs = [(1, first), (2, other), (3, long), (4, later)]
    rows = spark.createDataFrame([(i, b.decode()) for i, b in docs], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(rows).collect()}
    spans = sorted([(0, 70), (cut - 300, cut + 200), (2 * cut + 10, 2 * cut + 100), (len(long) - 64, len(long))])
    kept = b"".join(long[a:b] for a, b in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(long)]))
    assert (got[3].n_bytes, got[3].n_removed, got[3].n_spans) == (len(long), sum(e - s for s, e in spans), 4)
    assert got[3].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert (got[4].n_removed, got[4].n_spans) == (len(later) - 8, 1) and got[4].kept_sha256 == hashlib.sha256(b"x" * 7 + b"y").hexdigest()
    assert got[1].n_removed == got[2].n_removed == 0


def test_substrings_of_half_equal_hashes(spark):
    """Stretches whose hashes share their lower 32 bits are different stretches."""
    same = "on a quiet hill above the river stands an old stone tower; below it"
    rows = [(i, head + same) for i, head in enumerate(["dfkaypkv", "jljmkpkf", "vmnttiin", "osvzdmis", "jhsnsvda", "jblyxnpq"])]
    from sprank.llm.substrings import Runs, remove_repeats
    runs = [Runs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), np.ones(1, bool), 50, 24) for _, t in rows[:2]]
    a, b = ({(d, h & 0xFFFFFFFF): h for d, h in zip(r.digit.tolist(), r.stretch.tolist(), strict=True)} for r in runs)
    assert any(a[k] != b[k] for k in a.keys() & b.keys())
    want = brute.repeats(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: v[:3] for i, v in want.items()}


def test_warc_against_sql_and_round_trip(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF001}/pages.parquet')")
    got = Q["op8_warc"](spark, SF001)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()['op8_warc']})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)
    warc.write_warc(got, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    want = {(r.record_id, r.refers_to, r.warc_type, r.block_digest, r.block) for r in got.collect()}
    h = F.col("headers")
    assert {tuple(r) for r in back.select(h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Type"], h["WARC-Block-Digest"], "block").collect()} == want


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    attrs = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    weights = Counter()
    for i, r in rows.items():
        weights[(*attrs[i], r.topic)] += r.tokens
    total = sum(weights.values())
    weights = {k: v / total for k, v in weights.items() if v}
    fit = brute.raked(weights, [brute.tempered(weights, p, mixing.TEMPER) for p in range(3)])
    most = max(fit[k] / weights[k] for k in fit)
    for i, r in rows.items():
        k = (*attrs[i], r.topic)
        assert r.probability == pytest.approx(fit[k] / weights[k] / most if k in fit else 1.0, abs=2e-6)
        u = int(hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest()[:8], 16) / 2 ** 32
        assert r.kept == (u < r.probability)
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def check_packing(pieces, texts):
    """Every id lies in exactly one piece; sequences are gapless and at most a window long."""
    ids = {i: ids_of(t) for i, t in texts}
    seen = defaultdict(list)
    for r in pieces:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x)
        assert r.ids_crc32 == zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes())
        seen[r.doc_id].append((r.start, r.length))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(seen[i]):
            assert start == at and n > 0
            at += n
        assert at == len(x)
    seqs = defaultdict(list)
    for r in pieces:
        seqs[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        sizes.append(at)
    assert max(sizes) <= 4096 and sum(s < 4096 for s in sizes) <= 1
    assert sorted(seqs) == list(range(len(seqs)))


def test_words_are_looked_up_once_in_all_their_cases():
    """Words of Latin-1 texts are kept lower-cased; ids are those of the whole text, of other texts too."""
    words = packing.WordIds(packing.default_tokenizer())
    for text in ("Straße STRASSE straße Straße", "ÀÉÎ àéî ÿß µª º x²", "DON'T don't 'S 's", "A\xa0B\x85c", "ΟΔΟΣ οδος Σ", "İstanbul I", "A\x1cB", "<|endoftext|> A"):
        assert words.text(text) == words.direct(text)
    words.clear()
    assert words.text("Mañana mañana MAÑANA") == words.direct("mañana") * 3 and len(words) == 1


def test_packing(spark, texts):
    check_packing(Q["op10_packing"](spark, SF001).collect(), texts)


def test_combinations_never_overuse():
    rng = np.random.default_rng(6)
    count = np.bincount((rng.gamma(1.2, 700, 20_000)).astype(int) % 4095 + 1, minlength=4096)
    chosen = packing.solve(count, packing.combinations(count, 4096))
    used = Counter()
    for combo, n in chosen:
        assert sum(combo) == 4096 and n > 0
        for x in combo:
            used[x] += n
    assert all(used[x] <= count[x] for x in used)
    assert sum(x * n for x, n in used.items()) > 0.5 * (count * np.arange(4096)).sum()


def test_word_ids_equal_the_tokenizer(texts):
    words = packing.WordIds(packing.default_tokenizer())
    odd = ["It's we're THE don't l'eau s'il 123abc _x_ a_b ÉÉé İI ΣΣ ßÿ x\x1cy <|endoftext|>z \xa0q ẞ 'S LL", "café é naïve\xad µ ª º × ÷ a×b"]
    for t in [t for _, t in texts] + odd:
        assert np.frombuffer(words.text(t or ""), np.uint16).tolist() == ids_of(t)[:-1]


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage against a plain version, on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF001).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept[name] = docs
        rows = sorted((r.doc_id, r.text) for r in before.collect())
        if name == "toxicity":
            good = {r.doc_id for r in Q["op4_toxicity"](spark, SF001).where("predicted = 0").collect()}
            assert {r.doc_id for r in docs.collect()} == good
        elif name == "line dedup":
            gone = brute.removed_lines(rows)
            want = {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]) if gone[i] else t for i, t in rows}
            want = {i: t for i, t in want.items() if not gone[i] or t.encode().split()}
            got = docs.collect()
            assert {r.doc_id: r.text for r in got} == want
            assert all(r.n_chars == len(r.text) for r in got if gone[r.doc_id])
        elif name == "simhash near-dedup":
            comp = brute.components([i for i, _ in rows], [brute.simhash(t) for _, t in rows])
            assert {r.doc_id for r in docs.collect()} == set(comp.values())
        elif name == "mixing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in mixing.mixed(before).where("kept").collect()}
        else:
            check_packing(docs.collect(), rows)
    assert kept["mixing"].columns == kept["toxicity"].columns
    assert corpus_pipeline.run(spark, SF001).count() == kept["packing"].count()


def test_long_line_signatures_survive_packing_and_bound_the_difference():
    """Lines of 64, 128 and 256 signature bits: what is unpacked is what was packed, and no more bits than words differ."""
    rng = np.random.default_rng(4)
    sets = [rng.choice(600, n, replace=False) for n in rng.integers(1, 500, 200)]
    sets += [np.append(s[rng.random(len(s)) < .9], 600 + i) for i, s in enumerate(sets)]
    text = "\n".join(" ".join(f"w{x}" for x in s) for s in sets).encode()
    x = linededup.Lines(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.full(1 << linededup.TABLE_BITS, 9, np.uint8))
    n, wide = len(sets), x.wide()
    assert (x.size > 2 * linededup.LONG).any() and ((x.size > linededup.LONG) & (x.size <= 2 * linededup.LONG)).any()
    doc = rng.integers(-(1 << 62), 1 << 62, n)
    cols = [np.arange(n, dtype=np.uint32), np.zeros(n, np.uint32), doc, x.number.astype(np.int32), x.size.astype(np.int32), np.zeros(n, np.int32), x.signature, wide]
    data = linededup._pack(cols)
    assert all((a == b).all() for a, b in zip(linededup._unpack(data), cols, strict=True))
    bare = linededup._pack([*cols[:7], np.zeros_like(wide)])
    assert len(data) - len(bare) < 8 * (x.size > linededup.LONG).sum() + 16 * (x.size > 2 * linededup.LONG).sum() + 200
    heads = [x.hash[:n], doc, x.number, x.size, np.zeros(n, int), x.size, x.signature]
    assert all((a == b).all() for a, b in zip(linededup._unpack_heads(linededup._pack_heads(heads, wide, x.hash)), [*heads, wide, x.hash], strict=True))
    a, b = (i.ravel() for i in np.indices((n, n)))
    words = [set(s.tolist()) for s in sets]
    differ = linededup._differ(a, b, x.size, x.signature, wide)
    assert (differ <= [len(words[i] ^ words[j]) for i, j in zip(a, b, strict=True)]).all()
    near, far = differ[(b == a + 200) & (x.size[b] > linededup.LONG)], differ[(b == a + 199) & (x.size[b] > linededup.LONG)]
    assert np.median(near) < np.median(far)


def test_line_blocks_do_not_grow_with_the_chunks(spark, monkeypatch):
    """Lines and their postings are dealt out many chunks at a time: the blocks of a task are as many as the buckets, not chunks times buckets."""
    rng = np.random.default_rng(5)
    rows = [(i, "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 3000, 30)) for _ in range(60))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    rarity = spark.sparkContext.broadcast(linededup._rarities(docs))
    blocks = linededup._heads(docs, rarity, 8).collect()
    assert sum(len(t) for _, t in rows) > 8 * (1 << 17)
    assert len([r for r in blocks if not r.copies]) <= 8
    lines = sorted((d, k) for r in blocks if not r.copies for d, k in zip(*(c.tolist() for c in linededup._unpack_heads(bytes(r.data))[1:3]), strict=True))
    assert lines == [(i, k) for i in range(120) for k in range(60)]
    monkeypatch.setattr(linededup, "HELD", 20_000)
    small = linededup._heads(docs, rarity, 8).collect()
    assert len(small) > len(blocks)
    same = sorted((d, k) for r in small if not r.copies for d, k in zip(*(c.tolist() for c in linededup._unpack_heads(bytes(r.data))[1:3]), strict=True))
    assert same == lines


def test_keys_left_out_lose_no_pair():
    """Lines that share at least n wanted keys with an asking one still share one of those that are kept."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        count = rng.integers(1, 9, 6)
        line, least = np.repeat(np.arange(6), count), rng.integers(1, 6, count.sum())
        asks = rng.random(6) < .2
        kept = linededup._enough(line, least, asks)
        assert kept[asks[line]].all()
        for k in np.flatnonzero(~asks):
            mine, use = least[line == k], kept[line == k]
            for n in range(1, 6):  # any n keys asked for with n or fewer: one of them is kept
                assert (~use[mine <= n]).sum() < n
