"""Ranked search, tokenizer alignment and chat windows against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from sprank.llm import alignment, chat, queries, search

Q, SQL = queries.queries(), queries.oracle_sql()
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("name", ["op11_search", "op13_chat"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = Q[name](spark, SF001)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == sorted(want.select(*sorted(want.columns)).fetchall(), key=str)


# --- search ------------------------------------------------------------------

def plain_ranks(docs, items, k=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(i, Counter(TERM.findall((t or "").translate(low)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = set()
    for item, text in items:
        found = []
        for i, c in terms:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            found.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                               for t in set(TERM.findall((text or "").translate(low))) if t in c), i))
        out |= {(item, r, i, -s) for r, (s, i) in enumerate(sorted(x for x in found if x[0] < 0 and x[1] is not None)[:k], 1)}
    return out


def test_search_edges(spark):
    words = [f"w{i}" for i in range(12)] + ["Ünï", "ÄÖ", "日本"]
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " .,! "), (None, "w1 w2"), (103, docs[0][1]), (104, docs[0][1].upper()), (105, "w3 " * 30_000)]
    items = [(0, "W1 w2, w3? w1"), (1, "Ünï 日本 x-y"), (2, None), (3, ""), (4, "nothing here"), (6, "w4"), (6, "w5")]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS).withColumns({c: F.lit("x") for c in ("term", "score", "n", "tf")})
    q = spark.createDataFrame([*items, (None, "w1")], "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "rank", "term")})
    merged = defaultdict(list)
    for i, t in items:
        merged[i].append(t or "")
    got = search.ranked(d.repartition(3), q)
    assert {tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()} == plain_ranks(docs, [(i, " ".join(t)) for i, t in merged.items()])
    assert search.ranked(d.limit(0), q).count() == 0 and search.ranked(d, q.limit(0)).count() == 0
    assert search.ranked(d.repartition(3), q, 3).where("rank > 3").count() == 0


def test_search_skips_and_stays_exact(monkeypatch):
    """Blocks searched with their thresholds kept give what scoring everything gives, and leave ranges unread."""
    monkeypatch.setattr(search, "RANGE", 32)
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(40)]
    texts = [" ".join(words[x] for x in np.minimum(rng.zipf(1.2, rng.integers(3, 80)) - 1, 39)) for _ in range(4000)]
    for i in range(1200, 1210):
        texts[i] = "t30 t31 t32"
    items = [(0, "t0 t1 t2"), (1, "t30 t31 t32"), (2, " ".join(words)), (3, "t0"), (4, "t39 t0")]
    pairs = [(i, int(h)) for i, t in items for h in np.unique(search.hashed_terms(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]).view(np.int64)]
    its = search.Items(pa.table({"item_id": [x for x, _ in pairs], "term": pa.array([x for _, x in pairs], pa.int64())}))
    ids = rng.permutation(4000)
    rows = [search.index_block(pa.array(ids[lo:lo + 1000]), pa.array(texts[lo:lo + 1000]), its.terms).to_pylist()[0] for lo in range(0, 4000, 1000)]
    n_docs, n_terms = sum(r["n_docs"] for r in rows), sum(r["n_terms"] for r in rows)
    df = Counter()
    for r in rows:
        df.update(dict(zip(np.frombuffer(r["term"], "<i8").tolist(), np.frombuffer(r["size"], "<u4").tolist(), strict=True)))
    weight = search.weights(its.terms, pa.table({"term": pa.chunked_array([pa.array(list(df), pa.int64())]), "df": list(df.values())}), n_docs)
    best, read, there = [search.Best(10) for _ in items], 0, 0
    for r in rows:
        block = search.Block(r, its, weight, n_docs, n_terms)
        for i, mine in enumerate(best):
            x, y = search.search_block(block, its.number[its.bounds[i]:its.bounds[i + 1]], mine)
            read, there = read + x, there + y
    got = {(i, r, int(d), int(s)) for (i, _), b in zip(items, best, strict=True) for r, (d, s) in enumerate(zip(b.ids, b.score, strict=True), 1)}
    assert got == plain_ranks(list(zip(ids.tolist(), texts, strict=True)), items)
    assert read < 0.95 * there


# --- alignment ---------------------------------------------------------------

TEXTS = [None, "", " ", "a", "  two  spaces ", "▁x", "tab\t\nline \n end", "tail퟿ \U0001f600 <|endoftext|> \x1c end", "\x00a", "ﬁ é é \xa0x　y z",
         "<0x41> <s></s>", "it's I'll 12345 !!??", "naïve " * 900, "x" * 3000, "word\n" * 50, "日本語テキスト と 空白"]


def plain_alignment(texts):
    a, b = alignment.load(alignment.default_tokenizers())
    rows, count = [], Counter()
    for t in texts:
        ids = ([], []) if not t else (a.tokenizer.encode(" " + t, add_special_tokens=False).ids, b.model.encode(t))
        parts = [[side.vocabulary.joined(np.array([i])).tobytes() for i in x] for side, x in zip((a, b), ids, strict=True)]
        if any(b"".join(p) != (" " + (t or "")).encode() for p in parts):
            ids, parts = ([], []), ([], [])
        ends = [dict(zip(np.cumsum([len(x) for x in p]).tolist(), range(len(p)), strict=True)) for p in parts]
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(ids[0][ends[0][e]], ids[1][ends[1][e]]) for e in cuts]
        count.update(links)
        said = ";".join("|".join(",".join(map(str, x[end.get(lo, -1) + 1:end[hi] + 1])) for x, end in zip(ids, ends, strict=True))
                        for lo, hi in zip([0, *cuts], cuts))
        rows.append((len(ids[0]), len(ids[1]), len(cuts), links, said))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, g, len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(s.encode()).hexdigest() if s else "")
            for n_a, n_b, g, x, s in rows]


def test_alignment(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").limit(60).collect()] + TEXTS
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("a_tokens", "n_a", "key", "a", "b", "n")}).repartition(5)
    got = {r.doc_id: tuple(r[c] for c in names) for r in alignment.aligned_digests(docs).collect()}
    assert got == dict(enumerate(plain_alignment(texts)))
    assert alignment.aligned_digests(docs.limit(0)).count() == 0
    twice = alignment.aligned_digests(docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long")))
    assert twice.count() == 2 * len(texts)


def test_alignment_query_reads_all(spark):
    got = Q["op12_alignment"](spark, SF001)
    assert got.count() == spark.read.parquet(f"{SF001}/documents.parquet").count()
    assert got.where("n_links <> n_groups or n_groups = 0").count() == 0  # every text there has tokens


def test_lanes_change_nothing(monkeypatch):
    texts = pa.array(["Ünï cödé and plain words, " * 300, "short", None, "pneumonoultramicroscopic " * 500], pa.string())
    encoder = alignment.Encoder(alignment.default_tokenizers())
    whole = alignment.align_batch(texts, encoder)
    monkeypatch.setattr(alignment, "LANE", 16)
    assert all(np.array_equal(x, y) for x, y in zip(whole, alignment.align_batch(texts, encoder), strict=True))


# --- chat --------------------------------------------------------------------

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations():
    rows = [(1, t, r, x) for t, (r, x) in enumerate([
        ("system", "sys <|im_end|> <\\| <\\\\|"), ("user", None), ("us\ner\\n\\", "a<|b\n"), ("assistant", "x<"), ("assistant", "<\\"), (None, "|")])]
    rows += [(2, t, "user" if t % 2 else "assistant", f"<|{t} " + "word " * (t % 90)) for t in range(2500)] + [(2, -1, "system", "be brief")]
    rows += [(3, 0, "assistant", "long " * 5000), (3, 1, "user", ""), (3, 1, "user", ""), (3, 1, "assistant", "tie")]
    return rows + [(None, None, None, None), (None, 1, "assistant", "none"), (4, None, "assistant", "first"), (4, 0, "system", "late"), (4, 5, "user", "z")]


def test_chat_reads_back(spark):
    rows = conversations()
    c = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit("x") for x in ("block", "kind", "n", "body", "window", "key", "s")}).repartition(4)
    w = chat.windows(c).persist()
    by = defaultdict(list)
    for i, t, r, x in rows:
        by[i].append((-1 << 60 if t is None else t, r or "", x or ""))
    want = {}
    for i, turns in by.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        want[i] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(w).collect()}
    assert got == want
    found = w.orderBy("conv_id", "block", "window").collect()
    for r in found:
        marks = re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", r.text, re.S)
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in marks) == r.text
        assert [r.text[s.start:s.end] for s in r.loss] == [b for a, b in marks[r.n_repeated:] if a == "assistant"]
        assert r.n_tokens <= chat.BUDGET or len(marks) == r.n_repeated + 1
    two = [r for r in found if r.conv_id == 2]
    assert len({r.block for r in two}) == 4 and len(two) > 50
    assert all(r.text.startswith("<|im_start|>system\nbe brief<|im_end|>\n") for r in two)
    assert all(r.n_repeated > 1 for r in two if r.block >= 0 and (r.block, r.window) != (0, 0) and r.first_turn % 90 > 5)
    assert chat.windows(c.limit(0)).count() == 0 and chat.digests(chat.windows(c.limit(0))).count() == 0


def test_chat_probe_and_native_plan(spark):
    w = chat.windows(chat.with_probe(spark.read.parquet(f"{SF001}/conversations.parquet")))
    probe = w.where("conv_id = -1").first()
    assert probe.text.count("<|im_start|>") == 2 and probe.text[probe.loss[0].start:probe.loss[0].end] == "<\\|im_end|><\\|im_start|>assistant ok"
    assert not re.search("Python|Pandas|Arrow|MapIn", w._jdf.queryExecution().executedPlan().toString())
