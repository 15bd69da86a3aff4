"""Overlapping chunkers (word windows, character windows) as native array plans.

Each document row is cut inside the row with ``sequence``/``slice``/
``transform``/``filter`` and then ``posexplode``d, so chunking never shuffles
and never leaves the JVM. Kept chunks are numbered densely from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sprank.functions.text import clean, collapse_ws, tokens

# Chunk id formats: demo `{doc}_{i}`, scaling notebook `{doc}_c{i}`, upload `{doc}_chunk{i}`.
ID_STYLES = {"plain": "_", "c": "_c", "chunk": "_chunk"}


def _starts(n: Column, step: int) -> Column:
    # sequence(0, n-1, step) fails for n = 0 under ANSI, so guard it.
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>"))


def word_windows(tok: Column, size: int = 80, overlap: int = 15) -> Column:
    """Word chunks from an already materialised token array column.

    Windows start at 0, step, 2*step ... < n with step = max(1, size -
    overlap); a window is kept only if it has at least size // 2 tokens;
    tokens are joined by one space. ``tok`` should be a plain column reference
    so that it is not recomputed inside each lambda call.
    """
    if size < 1:
        raise ValueError("size must be >= 1")
    step = max(1, size - overlap)
    half = size // 2
    n = F.size(tok)
    starts = F.filter(_starts(n, step), lambda s: F.least(F.lit(size), n - s) >= half)
    return F.transform(starts, lambda s: F.array_join(F.slice(tok, s + 1, size), " "))


def char_pieces(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """A collapsed text cut once into pieces of ``size - overlap`` code points, in time linear in its length."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size - overlap}}}"), F.lit(0))


def char_windows(pieces: Column, size: int = 500, overlap: int = 50, min_len: int = 30) -> Column:
    """Character chunks from an already materialised ``char_pieces`` column:
    windows of ``size`` code points every ``size - overlap``, each stripped,
    kept if longer than ``min_len``. A window is its own piece and the beginning
    of those after it. ``pieces`` should be a plain column reference so that it
    is not cut again inside each lambda call."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    spans = -(-size // (size - overlap))
    if spans == 1:
        windows = F.transform(pieces, lambda p: F.trim(p))
    elif spans == 2:
        after = F.concat(F.slice(pieces, 2, F.size(pieces)), F.array(F.lit("")))
        windows = F.zip_with(pieces, after, lambda p, q: F.trim(F.concat(p, F.substring(q, 1, overlap))))
    else:
        windows = F.transform(pieces, lambda p, i: F.trim(F.substring(
            F.concat(p, F.array_join(F.slice(pieces, i + 2, spans - 1), "")), 1, size)))
    return F.filter(windows, lambda c: F.length(c) > min_len)


def _prepared(df: DataFrame, id_col: str, text_col: str, keep: list[str],
              word: bool = True, char: tuple[int, int] | None = None, lower_clean: bool = True) -> DataFrame:
    """Materialise token array / pieces of the collapsed text (``char`` = size, overlap) once per row."""
    cols = [F.col(c) for c in dict.fromkeys([id_col] + keep)]
    if word:
        src = clean(text_col) if lower_clean else F.col(text_col)
        cols.append(tokens(src).alias("_tok"))
    if char:
        cols.append(char_pieces(collapse_ws(text_col), *char).alias("_pieces"))
    return df.select(*cols)


def _explode(df: DataFrame, id_col: str, arr: Column, id_style: str,
             chunk_col: str, keep: list[str]) -> DataFrame:
    sep = ID_STYLES[id_style]
    return (df.select(*[F.col(c) for c in dict.fromkeys([id_col] + keep)],
                      F.posexplode(arr).alias("chunk_idx", chunk_col))
              .withColumn("chunk_id", F.concat(F.col(id_col).cast("string"), F.lit(sep),
                                               F.col("chunk_idx").cast("string"))))


def word_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                size: int = 80, overlap: int = 15, lower_clean: bool = True,
                id_style: str = "plain", chunk_col: str = "chunk",
                keep: list[str] | None = None) -> DataFrame:
    """One row per word chunk: (id, chunk_idx, chunk, chunk_id).

    ``lower_clean`` applies the demo clean step (lower-case, collapse) first,
    as the demo chunks its ``clean`` column. Whitespace split as Python's
    ``str.split()``.
    """
    keep = keep or []
    p = _prepared(df, id_col, text_col, keep, lower_clean=lower_clean)
    return _explode(p, id_col, word_windows(F.col("_tok"), size, overlap), id_style, chunk_col, keep)


def char_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                size: int = 500, overlap: int = 50, min_len: int = 30,
                id_style: str = "chunk", chunk_col: str = "chunk",
                keep: list[str] | None = None) -> DataFrame:
    """One row per character chunk: (id, chunk_idx, chunk, chunk_id)."""
    keep = keep or []
    p = _prepared(df, id_col, text_col, keep, word=False, char=(size, overlap))
    return _explode(p, id_col, char_windows(F.col("_pieces"), size, overlap, min_len),
                    id_style, chunk_col, keep)


def _counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    p = _prepared(docs, id_col, text_col, [], word=True, char=(500, 50))
    return p.select(id_col, F.size(word_windows(F.col("_tok"))).alias("nw"),
                    F.size(char_windows(F.col("_pieces"))).alias("nc"))


def chunk_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks per document for both chunkers; zero-chunk documents show 0.

    Counted with ``size`` of the per-row arrays, so no explode and no join are
    needed (a left join of exploded counts would give the same numbers).
    """
    c = _counts(docs, id_col, text_col)
    return c.select(
        F.col(id_col),
        F.col("nw").cast("bigint").alias("n_word_chunks"),
        F.col("nc").cast("bigint").alias("n_char_chunks"),
        F.format_string("Indexed %d chunks from %s", F.col("nc"), F.col(id_col).cast("string")).alias("message"))


def ingest_rejects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents an ingest would refuse: ``no_text`` if the character chunker
    yields nothing, else ``too_short`` if the word chunker yields nothing."""
    c = _counts(docs, id_col, text_col)
    reason = F.when(F.col("nc") == 0, F.lit("no_text")).when(F.col("nw") == 0, F.lit("too_short"))
    # explode of a 0/1-element array instead of a Filter: a filter on these
    # derived sizes would be pushed below the projection and re-run the
    # regular expressions inside every lambda call.
    return c.select(F.col(id_col), F.explode(F.array_compact(F.array(reason))).alias("reason"))


def accept_by_extension(files: DataFrame, name_col: str = "filename",
                        ext: str = ".pdf") -> DataFrame:
    """Split uploads by extension (any case): adds ``accepted`` and ``reason``."""
    ok = F.lower(F.col(name_col)).endswith(ext.lower())
    return files.withColumn("accepted", ok).withColumn(
        "reason", F.when(ok, F.lit(None).cast("string")).otherwise(F.lit("unsupported_type")))
