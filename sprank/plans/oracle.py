"""DuckDB SQL equal to each registered query (tables pre-registered as views).

Plain statements of the semantics, written independently of the Spark plans:
all-pairs joins are fine here because the check runs on small data.
"""

from __future__ import annotations

from sprank.functions.text import JAVA_WS, PY_WS_EXPLICIT
from sprank.plans.inputs import ALPHA, LIST_K, TOP_K

WS = PY_WS_EXPLICIT + "+"
JWS = JAVA_WS + "+"
NL = "chr(10)"


def tok(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({expr}, ''), '{WS}'), lambda x: x <> '')"


def clean(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '{JWS}', ' ', 'g'), ' ')"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}', ' ', 'g'), ' ')"


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


# Word windows (80 / 15 -> step 65, keep >= 40 tokens) over the cleaned text.
CHUNK_WORDS = f"""
WITH t AS (SELECT doc_id, {tok(clean('text'))} AS tk FROM documents),
w AS (SELECT doc_id, tk, unnest(range(0, len(tk), 65)) AS s FROM t),
k AS (SELECT doc_id, s, array_to_string(tk[s + 1 : s + 80], ' ') AS chunk
      FROM w WHERE least(80, len(tk) - s) >= 40)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::BIGINT AS chunk_idx,
       doc_id::VARCHAR || '_' || (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::VARCHAR AS chunk_id,
       chunk
FROM k"""

# Character windows (500 every 450, strip, keep length > 30) over collapsed text.
CHUNK_CHARS = f"""
WITH t AS (SELECT doc_id, {collapse('text')} AS c FROM documents),
w AS (SELECT doc_id, s, trim(substring(c, s + 1, 500), ' ') AS chunk
      FROM (SELECT doc_id, c, unnest(range(0, length(c), 450)) AS s FROM t)),
k AS (SELECT * FROM w WHERE length(chunk) > 30)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::BIGINT AS chunk_idx,
       doc_id::VARCHAR || '_chunk' || (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::VARCHAR AS chunk_id,
       chunk
FROM k"""


def bm25_ctes(corpus: str = "documents") -> str:
    """BM25 CTEs over ``corpus`` (a table or subquery with doc_id, text)."""
    return f"""
docs AS (SELECT doc_id, {tok('text')} AS tk FROM {corpus}),
dl AS (SELECT doc_id, len(tk) AS dl FROM docs),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS term FROM docs) GROUP BY doc_id, term),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tdf AS (SELECT term, count(*) AS df FROM post GROUP BY term),
traw AS (SELECT term, df, ln(st.n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM tdf, st),
eps AS (SELECT 0.25 * avg(raw_idf) AS eps FROM traw),
terms AS (SELECT term, df, CASE WHEN raw_idf < 0 THEN eps ELSE raw_idf END AS idf FROM traw, eps),
q AS (SELECT item_id AS qid, text AS query FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tok('query')}) AS term FROM q) GROUP BY qid, term),
sc AS (SELECT qt.qid, post.doc_id,
              sum(qt.qtf * terms.idf * post.tf * 2.5 / (post.tf + 1.5 * (0.25 + 0.75 * dl.dl / st.avgdl))) AS score
       FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN dl USING (doc_id), st
       GROUP BY qt.qid, post.doc_id)"""


def sparse_topk(name: str, k: int) -> str:
    return f"""
{name}_all AS (SELECT q.qid, dl.doc_id, coalesce(sc.score, 0.0) AS score
               FROM q CROSS JOIN dl LEFT JOIN sc ON sc.qid = q.qid AND sc.doc_id = dl.doc_id),
{name} AS (SELECT qid, doc_id, score,
                  row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS list_rank
           FROM {name}_all QUALIFY list_rank <= {k})"""


def dense_ctes(vectors: str = "embeddings", queries: str = "(SELECT item_id AS qid, vec_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id)") -> str:
    """Cosine CTEs over ``vectors`` (vec_id, embedding) and ``queries`` (qid, embedding)."""
    return f"""
qv AS (SELECT qid, embedding::DOUBLE[] AS qe FROM {queries}),
qn AS (SELECT qid, qe, sqrt(list_dot_product(qe, qe)) AS nq FROM qv WHERE sqrt(list_dot_product(qe, qe)) >= 1e-10),
vn AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS ve,
              greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-10) AS nv FROM {vectors}),
ds AS (SELECT qid, doc_id, list_dot_product(ve, qe) / (nv * nq) AS score FROM qn, vn)"""


DENSE_CTES = dense_ctes()


def embedded(src: str, key: str, text: str, dim: int = 384) -> str:
    """Subquery ({key}, embedding): signed md5 cells of the tokens, normalised."""
    return f"""(WITH s AS MATERIALIZED (SELECT {key} AS k, {tok(f'lower({text})')} AS tk FROM {src}),
  w AS (SELECT k, md5(w) AS h FROM (SELECT k, unnest(tk) AS w FROM s)),
  c AS MATERIALIZED (SELECT k, CAST(('0x' || substr(h, 1, 8)) AS UBIGINT) % {dim} AS i, CAST(sum(CASE WHEN substr(h, 9, 1) >= '8' THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM w GROUP BY ALL),
  n AS (SELECT k, sqrt(sum(v * v)) AS nn FROM c GROUP BY k),
  z AS (SELECT s.k, r.range AS i FROM s CROSS JOIN range({dim}) r)
  SELECT z.k AS {key}, list(CAST(coalesce(c.v, 0.0) / greatest(n.nn, 1e-10) AS FLOAT) ORDER BY z.i) AS embedding
  FROM z LEFT JOIN n ON n.k = z.k LEFT JOIN c ON c.k = z.k AND c.i = z.i GROUP BY z.k)"""


def dense_topk(name: str, k: int) -> str:
    return f"""
{name} AS (SELECT qid, doc_id, score,
                  row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS list_rank
           FROM ds QUALIFY list_rank <= {k})"""


def norm_lists(k: int, corpus: str = "documents", dense: str = DENSE_CTES) -> str:
    """CTE ``lists`` (qid, list, doc_id, raw, norm, list_rank) for lists of k."""
    return f"""{bm25_ctes(corpus)},
{sparse_topk('sp', k)},
{dense},
{dense_topk('dn', k)},
both_l AS (SELECT qid, 'sparse' AS list, doc_id, score AS raw, list_rank FROM sp
           UNION ALL SELECT qid, 'dense' AS list, doc_id, score AS raw, list_rank FROM dn),
lists AS (SELECT *, (raw - min(raw) OVER (PARTITION BY qid, list)) /
                    CASE WHEN max(raw) OVER (PARTITION BY qid, list) > min(raw) OVER (PARTITION BY qid, list)
                         THEN max(raw) OVER (PARTITION BY qid, list) - min(raw) OVER (PARTITION BY qid, list)
                         ELSE 1.0 END AS norm
          FROM both_l)"""


def fused(alpha: float, src: str = "lists") -> str:
    a = f"{float(alpha)!r}::DOUBLE"
    return f"""
fz AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.doc_id, s.doc_id) AS doc_id,
              coalesce(d.norm, 0.0) AS dense, coalesce(s.norm, 0.0) AS sparse
       FROM (SELECT * FROM {src} WHERE list = 'dense') d
       FULL OUTER JOIN (SELECT * FROM {src} WHERE list = 'sparse') s ON d.qid = s.qid AND d.doc_id = s.doc_id),
fused AS (SELECT qid, doc_id, dense, sparse, {a} * dense + (1.0::DOUBLE - {a}) * sparse AS score FROM fz)"""


def hybrid(top: int, alpha: float, corpus: str = "documents", dense: str = DENSE_CTES) -> str:
    """CTE ``hy`` (qid, rank, doc_id, score): lists of 2*top, first top fused."""
    return f"""{norm_lists(2 * top, corpus, dense)},
{fused(alpha)},
hy AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank
       FROM fused QUALIFY rank <= {top})"""


def overlap(q: str, c: str) -> str:
    qd = f"list_distinct({tok(q)})"
    cd = f"list_distinct({tok(c)})"
    return f"CASE WHEN len({qd}) > 0 THEN len(list_intersect({qd}, {cd})) / len({qd}) ELSE 0.0 END"


def candidates() -> str:
    """CTE ``cand`` (qid, rank, doc_id, score, content, query, rerank_score)."""
    return f"""{hybrid(2 * TOP_K, ALPHA)},
cand0 AS (SELECT hy.qid, hy.rank, hy.doc_id, hy.score, coalesce(d.text, '') AS content, q.query
          FROM hy LEFT JOIN documents d ON d.doc_id = hy.doc_id JOIN q ON q.qid = hy.qid),
cand AS (SELECT *, {overlap('query', 'content')} AS rerank_score FROM cand0)"""


def reranked() -> str:
    """CTE ``rr`` (qid, rank, doc_id, score, rerank_score, content, query)."""
    return f"""{candidates()},
rr0 AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 9) DESC, rank, doc_id) AS rrank,
               doc_id, score, rerank_score, content, query
        FROM cand),
rr AS (SELECT qid, rrank AS rank, doc_id, score, rerank_score, content, query FROM rr0 WHERE rrank <= {TOP_K})"""


def _minute(col: str = "ts") -> str:
    return f"strftime(date_trunc('minute', {col}), '%Y-%m-%d %H:%M:%S')"


BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def _histogram_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{b!r}' AS le, {b!r}::DOUBLE AS bound" for b in BUCKETS) + \
        " UNION ALL SELECT '+Inf' AS le, 'inf'::DOUBLE AS bound"
    return f"""
WITH b AS ({rows}),
e AS (SELECT event_type AS endpoint, value * 0.001 AS v FROM events),
tot AS (SELECT endpoint, sum(v) AS s, count(*) AS c FROM e GROUP BY endpoint)
SELECT tot.endpoint, b.le, (SELECT count(*) FROM e WHERE e.endpoint = tot.endpoint AND e.v <= b.bound)::BIGINT AS bucket_count,
       round(tot.s, 6) AS sum, tot.c::BIGINT AS count
FROM tot CROSS JOIN b"""


def oracle_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["doc_word_count"] = "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS word_count FROM documents"
    s["doc_char_count"] = "SELECT doc_id, length(text)::BIGINT AS char_count FROM documents"
    s["doc_clean"] = f"SELECT doc_id, {clean('text')} AS clean FROM documents"
    s["doc_sentence_count"] = (
        f"SELECT doc_id, len(regexp_split_to_array({clean('text')}, '\\.{JWS}'))::BIGINT AS sentence_count "
        "FROM documents")
    s["doc_snippet"] = f"""
SELECT doc_id, CASE WHEN length(f) > 260 THEN substring(f, 1, 260) || '...' ELSE substring(f, 1, 260) END AS snippet
FROM (SELECT doc_id, regexp_replace(replace(text, {NL}, ' '), '^{WS}|{WS}$', '', 'g') AS f FROM documents)"""
    s["doc_avg_stats"] = """
SELECT doc_id, avg(len(string_split(text, ' '))) AS avg_words, avg(length(text)) AS avg_chars
FROM documents GROUP BY doc_id"""
    s["chunk_words"] = CHUNK_WORDS
    s["chunk_raw_words"] = CHUNK_WORDS.replace(tok(clean("text")), tok("text")).replace("'_' ||", "'_c' ||")
    s["clean_counts"] = (f"SELECT doc_id, len(string_split({clean('text')}, ' '))::BIGINT AS word_count, "
                         f"length({clean('text')})::BIGINT AS char_count FROM documents")
    s["upload_check"] = ("SELECT page_id, ends_with(lower(url), '/') AS accepted, "
                         "CASE WHEN ends_with(lower(url), '/') THEN NULL ELSE 'unsupported_type' END AS reason FROM pages")
    pdf = "concat_ws('', source, '-', doc_id::VARCHAR, CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.PDF' ELSE '.txt' END)"
    s["upload_check_pdf"] = (f"SELECT doc_id, {pdf} AS filename, coalesce(lang, '') IN ('en', 'fr') AS accepted, "
                             "CASE WHEN coalesce(lang, '') IN ('en', 'fr') THEN NULL ELSE 'unsupported_type' END AS reason FROM documents")
    s["chunk_chars"] = CHUNK_CHARS
    s["chunk_summary"] = f"""
WITH w AS (SELECT doc_id, count(*) AS n FROM ({CHUNK_WORDS}) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM ({CHUNK_CHARS}) GROUP BY doc_id)
SELECT d.doc_id, coalesce(w.n, 0)::BIGINT AS n_word_chunks, coalesce(c.n, 0)::BIGINT AS n_char_chunks,
       'Indexed ' || coalesce(c.n, 0)::VARCHAR || ' chunks from ' || d.doc_id::VARCHAR AS message
FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN c USING (doc_id)"""
    s["chunk_source_id"] = f"""
SELECT chunk_id, regexp_replace(chunk_id, '_[^_]*$', '') AS source_id FROM ({CHUNK_WORDS})"""
    s["ingest_rejects"] = f"""
WITH w AS (SELECT DISTINCT doc_id FROM ({CHUNK_WORDS})),
c AS (SELECT DISTINCT doc_id FROM ({CHUNK_CHARS}))
SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN 'no_text' ELSE 'too_short' END AS reason
FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
WHERE c.doc_id IS NULL OR w.doc_id IS NULL"""
    s["vec_normalize"] = """
SELECT vec_id, round(n, 6) AS norm, len(embedding)::BIGINT AS dim,
       round(list_sum(embedding::DOUBLE[]) / greatest(n, 1e-10), 6) AS unit_sum,
       round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / (greatest(n, 1e-10) * greatest(n, 1e-10)), 6) AS unit_sq
FROM (SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"""
    s["dense_scores"] = f"WITH {DENSE_CTES} SELECT qid, doc_id, {r6('score')} AS score FROM ds"
    s["dense_topk"] = (f"WITH {DENSE_CTES}, {dense_topk('dn', LIST_K)} "
                       f"SELECT qid, list_rank::BIGINT AS rank, doc_id, {r6('score')} AS score FROM dn")
    s["bm25_index"] = f"WITH {bm25_ctes()} SELECT term, df::BIGINT AS df, {r6('idf')} AS idf FROM terms"
    s["bm25_scores"] = f"WITH {bm25_ctes()} SELECT qid, doc_id, {r6('score')} AS score FROM sc"
    s["bm25_topk"] = (f"WITH {bm25_ctes()}, {sparse_topk('sp', LIST_K)} "
                      f"SELECT qid, list_rank::BIGINT AS rank, doc_id, {r6('score')} AS score FROM sp")
    s["dense_topk_cells"] = s["dense_topk"]
    s["bm25_topk_blocks"] = s["bm25_topk"]
    s["index_append"] = s["bm25_index"]
    s["append_search"] = s["bm25_topk"]
    s["vectors_append"] = s["dense_topk"]
    chunk_corpus = f"(SELECT chunk_id AS doc_id, chunk AS text FROM ({CHUNK_WORDS}))"
    s["chunk_bm25_topk"] = (f"WITH {bm25_ctes(chunk_corpus)}, {sparse_topk('sp', LIST_K)} "
                            f"SELECT qid, list_rank::BIGINT AS rank, doc_id AS chunk_id, {r6('score')} AS score FROM sp")
    s["minmax_scores"] = (f"WITH {norm_lists(LIST_K)} SELECT qid, list, list_rank::BIGINT AS list_rank, doc_id, "
                          f"{r6('raw')} AS raw, {r6('norm')} AS norm FROM lists")
    s["hybrid_fuse"] = (f"WITH {norm_lists(LIST_K)}, {fused(ALPHA)} SELECT qid, doc_id, {r6('dense')} AS dense, "
                        f"{r6('sparse')} AS sparse, {r6('score')} AS score FROM fused")
    s["hybrid_search"] = (f"WITH {hybrid(TOP_K, ALPHA)} "
                          f"SELECT qid, rank::BIGINT AS rank, doc_id, {r6('score')} AS score FROM hy")
    s["search_no_rerank"] = (f"WITH {hybrid(2 * TOP_K, ALPHA)} SELECT qid, rank::BIGINT AS rank, doc_id, "
                             f"{r6('score')} AS score FROM hy WHERE rank <= {TOP_K}")
    s["hits_with_content"] = (f"WITH {hybrid(TOP_K, ALPHA)} SELECT hy.qid, hy.rank::BIGINT AS rank, hy.doc_id, "
                              "coalesce(d.text, '') AS content FROM hy LEFT JOIN documents d ON d.doc_id = hy.doc_id")
    s["hits_with_title"] = (f"WITH {hybrid(TOP_K, ALPHA)} SELECT hy.qid, hy.rank::BIGINT AS rank, hy.doc_id, "
                            "coalesce(p.url, hy.doc_id::VARCHAR) AS title FROM hy LEFT JOIN pages p ON p.page_id = hy.doc_id")
    s["pool_semi"] = (f"WITH {hybrid(TOP_K, ALPHA)} SELECT qid, rank::BIGINT AS rank, doc_id, {r6('score')} AS score "
                      "FROM hy WHERE doc_id IN (SELECT doc_id FROM labels)")
    s["alpha_sweep"] = f"""WITH {norm_lists(2 * TOP_K)},
al AS (SELECT unnest([0.0, 0.3, 0.5, 0.7, 1.0]::DOUBLE[]) AS alpha),
fz AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.doc_id, s.doc_id) AS doc_id,
              coalesce(d.norm, 0.0) AS dense, coalesce(s.norm, 0.0) AS sparse
       FROM (SELECT * FROM lists WHERE list = 'dense') d
       FULL OUTER JOIN (SELECT * FROM lists WHERE list = 'sparse') s ON d.qid = s.qid AND d.doc_id = s.doc_id),
fa AS (SELECT qid, alpha, doc_id, alpha * dense + (1.0::DOUBLE - alpha) * sparse AS score FROM fz CROSS JOIN al)
SELECT qid, alpha, doc_id, {r6('score')} AS score,
       CASE WHEN alpha = 0 THEN 'keyword' WHEN alpha = 1 THEN 'semantic' ELSE 'hybrid' END AS mode
FROM fa QUALIFY row_number() OVER (PARTITION BY qid, alpha ORDER BY round(score, 9) DESC, doc_id) = 1"""
    s["rerank_topk"] = (f"WITH {reranked()} SELECT qid, rank::BIGINT AS rank, doc_id, {r6('score')} AS score, "
                        f"{r6('rerank_score')} AS rerank_score FROM rr")
    s["rerank_threshold"] = (f"WITH {candidates()} SELECT qid, rank::BIGINT AS rank, doc_id, {r6('score')} AS score, "
                             f"{r6('rerank_score')} AS rerank_score FROM cand WHERE rerank_score >= 0.5")
    s["score_percent"] = f"""WITH {reranked()}
SELECT qid, rank::BIGINT AS rank, doc_id,
       round(least(100.0, coalesce(rerank_score, score) /
             greatest(max(coalesce(rerank_score, score)) OVER (PARTITION BY qid), 0.001) * 100.0), 1) AS pct
FROM rr"""
    s["search_response"] = f"""WITH {reranked()}
SELECT qid, count(*)::BIGINT AS total_results, arg_min(doc_id, rank) AS top_doc_id,
       string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids
FROM rr GROUP BY qid"""
    s["search_requests"] = f"""WITH {bm25_ctes()}, {DENSE_CTES},
rq AS (SELECT qid, query, CASE WHEN qid % 7 > 0 THEN 2 + qid % 4 ELSE {TOP_K} END AS top_k, CASE WHEN qid % 5 > 0 THEN (qid % 5) / 4.0::DOUBLE ELSE {ALPHA}::DOUBLE END AS alpha,
              CASE WHEN qid % 11 > 0 THEN qid % 2 = 0 ELSE true END AS rerank FROM q),
ok AS (SELECT rq.qid, d.doc_id FROM rq, documents d WHERE qid % 3 = 0 OR (qid % 3 = 1 AND lang = 'en') OR (qid % 3 = 2 AND lang = 'fr' AND source = 'src3')),
two AS (SELECT 'sparse' AS list, ok.qid, ok.doc_id, coalesce(sc.score, 0.0) AS raw FROM ok LEFT JOIN sc USING (qid, doc_id)
        UNION ALL SELECT 'dense' AS list, qid, doc_id, score AS raw FROM ds WHERE qid % 3 = 0 OR (qid, doc_id) IN (SELECT (qid, doc_id) FROM ok)),
cut AS (SELECT two.*, top_k, row_number() OVER (PARTITION BY list, qid ORDER BY round(raw, 9) DESC, doc_id) AS list_rank
        FROM two JOIN rq USING (qid) QUALIFY list_rank <= 4 * top_k),
lists AS (SELECT *, (raw - min(raw) OVER (PARTITION BY qid, list)) / CASE WHEN max(raw) OVER (PARTITION BY qid, list) > min(raw) OVER (PARTITION BY qid, list)
                 THEN max(raw) OVER (PARTITION BY qid, list) - min(raw) OVER (PARTITION BY qid, list) ELSE 1.0 END AS norm FROM cut),
{fused(ALPHA).replace(f'{float(ALPHA)!r}::DOUBLE', 'alpha').replace('FROM fz)', 'FROM fz JOIN rq USING (qid))')},
hy AS (SELECT f.qid, f.doc_id, f.score, top_k, rerank, query, row_number() OVER (PARTITION BY f.qid ORDER BY round(f.score, 9) DESC, f.doc_id) AS rank
       FROM fused f JOIN rq USING (qid) QUALIFY rank <= 2 * top_k),
rs AS (SELECT hy.*, CASE WHEN rerank THEN {overlap('query', "coalesce(d.text, '')")} END AS rerank_score FROM hy LEFT JOIN documents d USING (doc_id))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 9) DESC, rank, doc_id)::BIGINT AS rank, doc_id, {r6('score')} AS score, {r6('rerank_score')} AS rerank_score
FROM rs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 9) DESC, rank, doc_id) <= top_k"""
    s["context_block"] = f"""WITH {reranked()}
SELECT qid, string_agg('[Chunk ' || rank::VARCHAR || ' — ' || doc_id::VARCHAR || ']' || {NL} || content,
                       {NL} || {NL} ORDER BY rank) AS context
FROM rr GROUP BY qid"""
    s["context_short"] = f"""WITH {reranked()},
cs AS (SELECT qid, string_agg('[' || rank::VARCHAR || '] ' || content, {NL} || {NL} ORDER BY rank) AS context
       FROM rr GROUP BY qid)
SELECT q.qid, coalesce(cs.context, '(no context)') AS context FROM (SELECT DISTINCT qid FROM q) q LEFT JOIN cs USING (qid)"""
    last10 = """(SELECT conv_id, turn, role, text FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10)"""
    s["history_last10"] = f"SELECT * FROM {last10}"
    hist = f"(SELECT * FROM {last10} WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND text <> '')"
    s["history_filtered"] = f"SELECT * FROM {hist}"
    s["prompt_messages"] = f"""WITH {reranked()},
ctx AS (SELECT qid, string_agg('[Chunk ' || rank::VARCHAR || ' — ' || doc_id::VARCHAR || ']' || {NL} || content,
                               {NL} || {NL} ORDER BY rank) AS context, any_value(query) AS query FROM rr GROUP BY qid),
h AS (SELECT conv_id AS qid, turn, role, text AS content,
             (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS msg_idx FROM {hist}),
nh AS (SELECT qid, count(*) AS nh FROM h GROUP BY qid)
SELECT h.qid, h.msg_idx, h.role, h.content FROM h WHERE h.qid IN (SELECT qid FROM ctx)
UNION ALL
SELECT ctx.qid, coalesce(nh.nh, 0)::BIGINT AS msg_idx, 'user' AS role,
       'CONTEXT:' || {NL} || ctx.context || {NL} || {NL} || 'QUESTION: ' || ctx.query || {NL} || {NL} ||
       'Answer using ONLY the context above. If the answer is not there, say so.' AS content
FROM ctx LEFT JOIN nh USING (qid)"""
    def body(max_tokens: int, system: str, messages: str) -> str:
        return (f"CAST(json_object('version', '2023-05-31', 'max_tokens', {max_tokens}, 'system', '{system}', "
                f"'messages', {messages}) AS VARCHAR) AS body")
    s["prompt_json"] = f"""SELECT qid, {body(512, 'You are a research assistant. Answer concisely from the provided context only.',
       "list(json_object('role', role, 'content', content) ORDER BY msg_idx)")}
FROM ({s["prompt_messages"]}) GROUP BY qid"""
    message = "[json_object('role', 'user', 'content', 'Context:' || " + NL + " || c.context || " + NL + " || " + NL + " || 'Question: ' || b.text)]"
    s["prompt_json_short"] = f"""SELECT c.qid, {body(400, 'Answer only from the provided context. Be concise.', message)}
FROM ({s["context_short"]}) c JOIN benchmark b ON b.item_id = c.qid"""
    s["conversation_turns"] = """
SELECT conv_id, count(*)::BIGINT AS n_messages, least(count(*), 20)::BIGINT AS kept,
       floor(least(count(*), 20) / 2)::BIGINT AS turns
FROM conversations GROUP BY conv_id"""
    s["metric_counters"] = """
SELECT event_type AS endpoint, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
       count(*)::BIGINT AS requests
FROM events GROUP BY ALL"""
    s["metric_histogram"] = _histogram_sql()
    s["metric_gauge"] = """
SELECT event_type AS endpoint, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts,
       arg_max(value, (ts, event_id)) AS last_value
FROM events GROUP BY event_type"""
    s["index_size"] = "SELECT count(DISTINCT doc_id)::BIGINT AS index_size FROM documents"
    s["latency_percentiles"] = f"""
SELECT {_minute()} AS minute, event_type AS endpoint, count(*)::BIGINT AS n,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
       round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY ALL"""
    s["stream_percentiles"] = s["latency_percentiles"]
    s["requests_per_minute"] = f"""
SELECT {_minute()} AS minute, event_type AS endpoint, count(*)::BIGINT AS requests, round(sum(value), 6) AS total
FROM events GROUP BY ALL"""
    s["avg_per_minute"] = f"""
SELECT {_minute()} AS minute, event_type AS endpoint, round(avg(value), 6) AS avg FROM events GROUP BY ALL"""
    s["errors_per_minute"] = f"""
SELECT {_minute()} AS minute, count(*)::BIGINT AS requests, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors
FROM events GROUP BY ALL"""
    s["run_speedup"] = """
WITH t AS (SELECT count(*) FILTER (WHERE event_type = 'view')::BIGINT AS n_a,
                  coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0.0) AS time_a,
                  count(*) FILTER (WHERE event_type = 'click')::BIGINT AS n_b,
                  coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0.0) AS time_b
           FROM events WHERE event_type IN ('view', 'click'))
SELECT n_a, round(time_a, 6) AS time_a, n_b, round(time_b, 6) AS time_b,
       round(CASE WHEN time_a > 0 THEN n_a / time_a ELSE 0.0 END, 6) AS throughput_a,
       round(CASE WHEN time_b > 0 THEN n_b / time_b ELSE 0.0 END, 6) AS throughput_b,
       round(CASE WHEN time_b > 0 THEN time_a / time_b ELSE 0.0 END, 6) AS speedup
FROM t"""
    s["log_tail"] = """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type, value
FROM events ORDER BY events.ts DESC, event_id LIMIT 50"""
    s["log_enrich"] = """
SELECT event_id, length(props)::BIGINT AS query_length, user_id AS doc_count,
       round(value * 0.001, 6) AS duration_seconds,
       round(CASE WHEN value * 0.001 > 0 THEN user_id / (value * 0.001) ELSE 0.0 END, 6) AS throughput
FROM events"""
    vec = "len(embedding)::BIGINT AS dim, embedding"
    s["embed_chunks"] = f"SELECT chunk_id, {vec} FROM {embedded(f'({CHUNK_CHARS})', 'chunk_id', 'chunk')}"
    s["embed_queries"] = f"SELECT item_id AS qid, {vec} FROM {embedded('benchmark', 'item_id', 'text')}"
    s["embed_queries_model"] = s["embed_queries"]
    missing = "(SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN embedding ELSE list_transform(range(64), lambda x: 0::FLOAT) END AS embedding FROM embeddings)"
    s["zero_fallback"] = (f"WITH {dense_ctes(missing)}, {dense_topk('dn', LIST_K)} "
                          f"SELECT qid, list_rank::BIGINT AS rank, doc_id, {r6('score')} AS score FROM dn")
    chunk_vecs = f"(SELECT chunk_id AS vec_id, embedding FROM {embedded(f'({CHUNK_WORDS})', 'chunk_id', 'chunk')})"
    query_vecs = f"(SELECT item_id AS qid, embedding FROM {embedded('benchmark', 'item_id', 'text')})"
    chunk_hits = f"""WITH {hybrid(TOP_K, ALPHA, chunk_corpus, dense_ctes(chunk_vecs, query_vecs))},
hits AS (SELECT hy.qid, hy.rank::BIGINT AS rank, hy.doc_id AS chunk_id, {r6('hy.score')} AS score, ck.text AS content,
                concat_ws('/', d.source, d.lang, d.doc_id::VARCHAR) AS title
         FROM hy JOIN {chunk_corpus} ck ON ck.doc_id = hy.doc_id
         JOIN documents d ON d.doc_id::VARCHAR = regexp_replace(hy.doc_id, '_[^_]*$', ''))"""
    s["chunk_hybrid_search"] = f"{chunk_hits} SELECT qid, rank, chunk_id, score, content, title FROM hits"
    s["chunk_context_block"] = f"""{chunk_hits}
SELECT qid, string_agg('[Chunk ' || rank::VARCHAR || ' — ' || chunk_id || ']' || {NL} || content, {NL} || {NL} ORDER BY rank) AS context
FROM hits GROUP BY qid"""
    s["rerank_udf"] = s["rerank_topk"]
    windows = f"(SELECT chunk_id AS doc_id, chunk AS text FROM ({CHUNK_CHARS}))"
    window_vecs = f"(SELECT chunk_id AS vec_id, embedding FROM {embedded(f'({CHUNK_CHARS})', 'chunk_id', 'chunk')})"
    s["stream_search"] = (f"WITH {hybrid(TOP_K, ALPHA, windows, dense_ctes(window_vecs, query_vecs))} "
                          f"SELECT qid, rank::BIGINT AS rank, doc_id AS chunk_id, {r6('score')} AS score FROM hy")
    from sprank.plans import extra
    s.update(extra.oracle_sql())
    return s
