"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sprank.llm import langid, linededup, minhash, mixing, packing, simhash, substrings, topk, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 5003}x{i % 7}" for i in range(40_000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
ROWS = [
    (1, BASE, "en", "a", 90), (1, BASE, "en", "a", 90), (2, None, "en", None, None), (3, "", None, "b", 0),
    (4, " \n\t ", "fr", "b", 4), (None, BASE, "en", "a", 90), (5, LONG, "en", "c", len(LONG)), (6, "123 !!! 456", "fr", "a", 11),
    (7, BASE, "fr", "a", 90), (8, BASE.replace("tau", "upsilon") + "\nein Ñandú größer", "de", "b", 95), (None, None, None, None, None),
    (9, "a", "en", "a", 1), (10, "x\n\ny\r\nz\n", "de", "c", 8), (11, "tail퟿ \U0001f600 <|endoftext|> \x1c end", "de", "c", 30),
]
CLASH = ["g", "part", "last", "bucket", "data", "score", "fp", "uid", "kind", "label", "rank", "tokens", "topic", "kept", "number",
         "signature", "component_id", "key", "n", "r", "seq", "held_out", "probability", "w", "f", "at", "before"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"extra {c}") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 1, 1), (8, 0, 0), (8, 0, 1), (None, 1, 1), (9, 1, None), (5, 1, 0), (6, 0, 0), (10, 1, 0), (11, 1, 0)],
                                 "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


OPERATORS = {
    "op1": (lambda d, _: linededup.line_counts(d), 14), "op2": (lambda d, _: simhash.near_duplicates(d), 14),
    "op3": (lambda d, _: langid.identify(d), 14), "op4": (lambda d, x: toxicity.classify(d, x), 14),
    "op6": (lambda d, _: minhash.edited_fingerprints(d), 14), "op7": (lambda d, _: substrings.remove_repeats(d), 14),
    "op9": (lambda d, _: mixing.mixed(d), 14),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(name, docs, empty, labels):
    run, n = OPERATORS[name]
    rows = run(docs, labels).collect()
    assert len(rows) == n
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert run(empty, labels.limit(0)).count() == 0


def test_simhash_groups(docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    same = {r.component_id for r in simhash.near_duplicates(docs).where("doc_id in (1, 7)").collect()}
    assert same == {1}
    assert got[2, "0" * 16] == got[3, "0" * 16] == got[4, "0" * 16] == 2


def test_language_rules(docs):
    got = {r.doc_id: r for r in langid.identify(docs).where("doc_id is not null").collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 6))
    assert got[1].lang_pred in ("en", "fr", "de")
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_without_labels(docs, labels):
    rows = toxicity.classify(docs, labels.limit(0)).collect()
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in rows)


def test_fingerprints_of_empty_texts(docs):
    got = {r.doc_id: r for r in minhash.edited_fingerprints(docs).where("doc_id is not null").collect()}
    assert got[2].fingerprint == got[3].fingerprint == got[4].fingerprint == ""
    assert got[2].near_next == 1.0 and got[2].n_chars == 0
    assert got[1].fingerprint == got[7].fingerprint != got[8].fingerprint
    lone = minhash.edited_fingerprints(docs).where("doc_id is null").collect()
    assert all(r.near_next is None for r in lone)


def test_substrings_of_repeated_and_null_ids(docs):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in substrings.remove_repeats(docs).collect()]
    n = len(BASE)
    assert got.count((1, n, 0, 0)) == 2  # rows of one doc_id don't remove each other
    assert (7, n, n, 1) in got and (None, n, 0, 0) in got and (2, 0, 0, 0) in got


def test_lines_of_repeated_rows(docs):
    got = {(r.doc_id, r.n_lines, r.n_removed) for r in linededup.line_counts(docs).collect()}
    assert (1, 1, 0) in got and (7, 1, 1) in got and (8, 2, 1) in got and (2, 0, 0) in got and (None, 1, 0) in got
    assert (10, 5, 0) in got


def test_packing_covers_every_row(docs, empty):
    from tests_llm_tokens import ids_of
    rows = packing.pack(docs, packing.default_tokenizer()).collect()
    want = sum(len(ids_of(r[1])) for r in ROWS)
    assert sum(r.length for r in rows) == want
    assert sum(r.doc_id is None and r.start == 0 for r in rows) == 2
    assert packing.pack(empty, packing.default_tokenizer()).count() == 0


def test_mixing_probabilities(docs):
    got = mixing.mixed(docs).collect()
    assert all(0 <= r.probability <= 1 for r in got)
    assert all(r.probability == 1 and r.kept for r in got if r.doc_id in (2, 3, 4))


def test_mixing_tells_of_unmet_targets(spark):
    cells = spark.createDataFrame([("a", "x", 0.5), ("b", "y", 0.5)], "source string, lang string, w0 double")
    source = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, target double")
    lang = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "lang string, target double")
    with pytest.warns(RuntimeWarning, match="raking left source 'b' at 0.5 against a target of 0.1"):
        fitted = mixing.rake(cells, {"source": source, "lang": lang}, rounds=3)
    gaps = {(r.attribute, r.value): r.gap for r in mixing.residuals(fitted, {"source": source, "lang": lang}).collect()}
    assert gaps["source", "b"] == pytest.approx(4) and gaps["lang", "x"] == pytest.approx(0)
    with pytest.raises(mixing.Unmet):
        mixing.rake(cells, {"source": source, "lang": lang}, rounds=3, strict=True)
    more = source.unionByName(spark.createDataFrame([("none", 0.2)], source.schema))
    with pytest.raises(mixing.Unmet, match="'none' at 0 "):
        mixing.rake(cells, {"source": more}, rounds=2, strict=True)
    met = mixing.rake(cells, {"source": source}, strict=True).collect()
    assert {r.source: r.w for r in met} == pytest.approx({"a": 0.9, "b": 0.1})
    assert mixing.rake(cells.limit(0), {"source": source.limit(0)}, strict=True).count() == 0


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (50, [-1.0, 0.25]), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (100, [1.0]), (8, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x")).withColumn("score", F.lit("y"))
    got = sorted(tuple(r) for r in topk.nearest(df).collect())
    a, b = 256 * 256 + 128 * 128, -256 * 256 + 128 * 64
    assert got == [(0, 1, 1, a), (0, 2, 2, a), (0, 3, 7, 0), (0, 4, 50, b), (50, 1, 7, 0), (50, 2, 0, b), (50, 3, 0, b), (50, 4, 1, b), (50, 5, 2, b), (100, 1, 8, 65536)]
    assert topk.nearest(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [-1.0]), (0, [0.5]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.nearest(twice.repartition(4)).collect()] == [(0, 1, 1, -256 * 512)]  # the least vector asks


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, "http://a/?x=1", "<p>a &amp;lt; b</p><!-- open"), (2, None, None), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    got = warc.derivatives(warc.responses(pages.withColumn("payload", F.lit("clash")).withColumn("record_id", F.lit("clash")))).collect()
    assert len(got) == 8
    text = {r.page_id: r.block for r in got if r.warc_type == "conversion"}
    assert text[1] == "a &lt; b" and text[2] == text[None] == ""
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_links_and_references(spark):
    import html
    import json
    page = ("<a href='x'>1</a><a class=k href=y id=q>2</a><A HREF = \"z&amp;&#233;\">3</a><a data-href='no' title='t'>4</a><area href='no'>"
            "<a\nhref=\"it's\">5</a><a href=''>6</a><a href=a/b?c=d&amp;e>7</a><title>T &mdash; &#x1F600;</title>"
            "<p>&#233;&#xE9; &mdash; &hellip; &amp;#233; &#0; &#55296; &#x110000; &#99999999; &bogus; &eacute;&#39;</p>")
    got = {r.warc_type: r.block for r in warc.derivatives(warc.responses(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))).collect()}
    meta = json.loads(got["metadata"])
    assert meta["links"] == ["x", "y", "z&é", "it's", "", "a/b?c=d&e"] and meta["title"] == "T — \U0001f600"
    assert got["conversion"].endswith("éé — … &#233; \ufffd \ufffd \ufffd &#99999999; &bogus; é'")
    assert all(html.unescape(name) in (char, "\xa0") for name, char in warc.REFERENCES)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns(spark, name, docs, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    for d in (docs, empty):
        out = stage(spark, d, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == d.dtypes
        assert (out.count() > 0) == (d is docs)
