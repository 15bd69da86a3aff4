"""Prompt assembly: ranked context blocks, conversation history, message lists.

The output is a prompt table ready for batch inference; every group here is
bounded (k hits, the last few messages), so per-group ``collect_list`` never
gathers an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The reference's prompt texts and limits.
CHUNK_HEADER = "[Chunk %d — %s]\n%s"
SHORT_ITEM = "[%d] %s"
NO_CONTEXT = "(no context)"
ANSWER_RULE = "Answer using ONLY the context above. If the answer is not there, say so."
SYSTEM_TEXT = "You are a research assistant. Answer concisely from the provided context only."
HISTORY_MESSAGES = 10
CLIENT_MESSAGES = 20
MAX_TOKENS = 512
SHORT_MAX_TOKENS = 400
SHORT_SYSTEM_TEXT = "Answer only from the provided context. Be concise."
CHAT_ROLES = ("user", "assistant")


def context_block(results: DataFrame, rank_col: str = "rank") -> DataFrame:
    """(qid, context): ``[Chunk i — doc_id]\\ncontent`` in rank order, i from 1,
    joined by a blank line."""
    items = F.sort_array(F.collect_list(F.struct(
        F.col(rank_col).alias("r"), F.col("doc_id").cast("string").alias("d"), F.col("content").alias("c"))))
    return (results.groupBy("qid").agg(items.alias("items"))
            .select("qid", F.array_join(F.transform(
                "items", lambda x, i: F.format_string(CHUNK_HEADER, i + 1, x["d"], x["c"])),
                "\n\n").alias("context")))


def context_short(queries: DataFrame, results: DataFrame, rank_col: str = "rank") -> DataFrame:
    """(qid, context): ``[i] content`` joined by a blank line, ``(no context)`` if none."""
    items = F.sort_array(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col("content").alias("c"))))
    ctx = (results.groupBy("qid").agg(items.alias("items"))
           .select("qid", F.array_join(F.transform(
               "items", lambda x, i: F.format_string(SHORT_ITEM, i + 1, x["c"])), "\n\n").alias("context")))
    return (queries.select("qid").distinct().join(ctx, "qid", "left")
            .withColumn("context", F.coalesce(F.col("context"), F.lit(NO_CONTEXT))))


def last_messages(conv: DataFrame, n: int = HISTORY_MESSAGES, conv_col: str = "conv_id",
                  turn_col: str = "turn") -> DataFrame:
    """Last ``n`` messages of each conversation (by turn), with ``pos`` oldest first.
    ``row_number <= n`` lets Spark cut each conversation before the shuffle."""
    w = Window.partitionBy(conv_col).orderBy(F.col(turn_col).desc())
    last = conv.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    return last


def history(conv: DataFrame, n: int = HISTORY_MESSAGES, conv_col: str = "conv_id",
            turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Last ``n`` messages first, then keep user/assistant messages with content
    (so fewer than ``n`` may remain)."""
    last = last_messages(conv, n, conv_col, turn_col)
    return last.where(F.col("role").isin(*CHAT_ROLES) & F.col(text_col).isNotNull()
                      & (F.col(text_col) != ""))


def final_user_message(context, query):
    return F.concat(F.lit("CONTEXT:\n"), context, F.lit("\n\nQUESTION: "), query,
                    F.lit("\n\n" + ANSWER_RULE))


def prompt_messages(queries: DataFrame, results: DataFrame, conv: DataFrame,
                    n: int = HISTORY_MESSAGES) -> DataFrame:
    """Message rows (qid, msg_idx, role, content): the filtered history of the
    conversation with ``conv_id = qid`` (oldest first), then the final user
    message carrying context and question. Only queries with results get one.
    The (bounded) results feed two branches, so they are checkpointed once."""
    from sprank.session import checkpoint_small
    results = checkpoint_small(results)
    hist = history(conv, n).select(F.col("conv_id").alias("qid"), "turn", "role",
                                   F.col("text").alias("content"))
    hw = Window.partitionBy("qid").orderBy("turn")
    hist = hist.withColumn("msg_idx", (F.row_number().over(hw) - 1).cast("bigint"))
    nhist = hist.groupBy("qid").agg(F.count(F.lit(1)).alias("nh"))
    ctx = context_block(results)
    final = (ctx.join(queries.select("qid", "query"), "qid")
             .join(nhist, "qid", "left")
             .select("qid", F.coalesce(F.col("nh"), F.lit(0)).cast("bigint").alias("msg_idx"),
                     F.lit("user").alias("role"),
                     final_user_message(F.col("context"), F.col("query")).alias("content")))
    kept = hist.join(ctx.select("qid"), "qid", "left_semi")
    return kept.select("qid", "msg_idx", "role", "content").unionByName(final)


def prompt_json(messages: DataFrame, max_tokens: int = MAX_TOKENS, system: str = SYSTEM_TEXT,
                version: tuple[str, str] | None = None) -> DataFrame:
    """(qid, body): the request body as JSON, messages in order. ``version`` is
    the name and value of the API version field, which comes first."""
    msgs = F.transform(F.sort_array(F.collect_list(F.struct("msg_idx", "role", "content"))),
                       lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    fields = ([F.lit(version[1]).alias(version[0])] if version else []) + [
        F.lit(max_tokens).alias("max_tokens"), F.lit(system).alias("system"), F.col("messages")]
    return (messages.groupBy("qid").agg(msgs.alias("messages"))
            .select("qid", F.to_json(F.struct(*fields)).alias("body")))


def prompt_json_short(queries: DataFrame, contexts: DataFrame, version: tuple[str, str] | None = None) -> DataFrame:
    """(qid, body): the short form, one user message with the short context and the question."""
    content = F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("query"))
    rows = queries.select("qid", "query").join(contexts, "qid").select(
        "qid", F.lit(0).cast("bigint").alias("msg_idx"), F.lit("user").alias("role"), content.alias("content"))
    return prompt_json(rows, SHORT_MAX_TOKENS, SHORT_SYSTEM_TEXT, version)


def conversation_turns(conv: DataFrame, cap: int = CLIENT_MESSAGES, conv_col: str = "conv_id") -> DataFrame:
    """Client-side cap: keep the last ``cap`` messages; turns = floor(kept / 2)."""
    return (conv.groupBy(conv_col).agg(F.count(F.lit(1)).alias("n_messages"))
            .withColumn("kept", F.least(F.col("n_messages"), F.lit(cap)))
            .withColumn("turns", F.floor(F.col("kept") / 2).cast("bigint")))
