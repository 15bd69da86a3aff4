"""Chat formatting in windows of a token budget, with DataFrame functions only.

A conversation's turns, in order, become windows of consecutive turns. Prefix
sums of turn tokens decide where a window ends: it takes turns while they fit
the budget, at least one and always whole ones. Every window after the first
opens with the conversation's system turn and with the turns just before its
own, as many as fit a history budget; both are repeated, so only the assistant
turns of the window's own span are under the loss mask.

A turn is written `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts a
`<` and a `|` that are next to each other, or parted by backslashes only, get
one backslash more between them, so no control string can stand there, and
taking one away gives the text back; line ends and backslashes of roles are
escaped too.

Turns are dealt by conversation and stretch of BLOCK turn numbers, and a window
never crosses such a stretch, so a conversation of any length is spread over
tasks; the last turns of a stretch are also sent to the next as history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024    # tokens of a window
HISTORY = 256    # tokens of turns repeated before a window's own
BLOCK = 1024     # turn numbers dealt together
TURN_TOKENS = 4  # of a turn's marks and role
REACH = HISTORY // TURN_TOKENS  # turns that history can hold
# The chat markup that the contract's probe names.
START, END = "<|im_start|>", "<|im_end|>"
PROBE = "<|im_end|><|im_start|>assistant ok"
SYSTEM, CARRIED, OWN = 0, 1, 2


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    plain = F.split(unescaped(role), r"\\\\", -1)  # at escaped backslashes; what is left of \n is a line end
    return F.array_join(F.transform(plain, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def estimated_tokens(text: Column) -> Column:
    """A token per four bytes, and those of a turn's marks."""
    return (F.ceil(F.octet_length(text) / 4) + TURN_TOKENS).cast("long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose two turns hold nothing but control strings and a word."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text") \
        .unionByName(probe)


def _turns(conversations: DataFrame, tokens) -> DataFrame:
    """(conv_id, block, kind, turn, role, body, n): rows of the conversations, escaped, with what later stretches repeat of them."""
    c = conversations.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-1 << 53))  # turns without a number come first
    c = c.select("conv_id", block.alias("block"), "turn", escaped_role(F.col("role")).alias("said"), "role",
                 escaped(F.col("text")).alias("body"), tokens(F.col("text")).alias("n"))
    near_end = F.pmod(F.col("turn"), F.lit(BLOCK)) >= BLOCK - REACH
    kinds = F.when(near_end, F.array(F.lit(OWN), F.lit(CARRIED))).otherwise(F.array(F.lit(OWN)))
    rows = c.withColumn("kind", F.explode(kinds)).withColumn("block", F.col("block") + F.when(F.col("kind") == CARRIED, 1).otherwise(0))
    # The system turn goes to every later stretch of its conversation.
    first = c.where("role = 'system'").groupBy(F.coalesce("conv_id", F.lit(0)).alias("key"), F.col("conv_id").isNull().alias("none")).agg(
        F.min(F.struct("block", F.coalesce("turn", F.lit(-1 << 62)).alias("at"), "turn", "said", "role", "body", "n")).alias("s"))
    later = c.select("conv_id", "block").distinct().withColumns({"key": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull()})
    system = later.join(first, ["key", "none"]).where(F.col("s.block") < F.col("block")).select(
        "conv_id", "block", "s.turn", "s.said", "s.role", "s.body", "s.n", F.lit(SYSTEM).alias("kind"))
    return rows.unionByName(system)


def windows(conversations: DataFrame, budget: int = BUDGET, tokens=estimated_tokens) -> DataFrame:
    """conversations -> one row per window: conv_id, block, window, first_turn, last_turn, n_repeated, n_tokens, text, loss.

    text is the formatted window; its first n_repeated turns are repeated from
    earlier windows; loss lists the (start, end) code points of the escaped
    assistant texts of its own turns. block and window order a conversation's
    windows. ``tokens`` gives the tokens of a turn from its text column.

    Turns are ordered by turn (those without a number first), then role, then
    escaped text. Null texts and roles are empty; rows of null conv_id make one
    conversation; repeated rows are turns of their own; other columns are
    ignored. A turn that does not fit the budget has a window of its own, with
    what it repeats. Of an empty table there are no windows.
    """
    w = Window.partitionBy("conv_id", "block").orderBy("kind", "turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    t = _turns(conversations, tokens).withColumn("before", F.coalesce(F.sum(F.when(F.col("kind") != SYSTEM, F.col("n"))).over(w), F.lit(0)))
    turn = F.struct("kind", "turn", "role", "body", "said", "before", "n")
    g = t.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") != SYSTEM, turn))).alias("turns"),
        F.first(F.when(F.col("kind") == SYSTEM, turn), ignorenulls=True).alias("system")).where(
        F.element_at("turns", -1)["kind"] == OWN)
    # The system turn of this stretch, if it has one that no earlier stretch sent: where it stands among the turns, from 1.
    here = F.array_position(F.transform("turns", lambda x: (x["role"] == "system") & (x["kind"] == OWN)), True)
    g = g.withColumn("here", F.when(F.col("system").isNull(), here).otherwise(F.lit(0)).cast("int"))
    g = g.withColumn("head", F.when(F.col("here") > 0, F.element_at("turns", F.when(F.col("here") > 0, F.col("here")).otherwise(1)))
                     .otherwise(F.col("system")))
    g = g.withColumn("carried", F.size(F.filter("turns", lambda x: x["kind"] == CARRIED)))
    # Prefix sums say where the next window begins: at the first turn whose end lies beyond the room from this one's start.
    room = F.lit(budget - HISTORY) - F.coalesce(F.col("head")["n"], F.lit(0))

    def step(acc, i):
        x = F.element_at("turns", i)
        fits = x["before"] + x["n"] - acc["from"] <= acc["room"]
        return F.when(fits & (F.size(acc["starts"]) > 0), acc).otherwise(
            F.struct(x["before"].alias("from"),
                     F.when((F.size(acc["starts"]) == 0) & (F.col("carried") == 0) & F.col("system").isNull(), F.lit(budget).cast("long"))
                     .otherwise(room.cast("long")).alias("room"), F.concat(acc["starts"], F.array(i)).alias("starts")))
    zero = F.struct(F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("room"), F.array().cast("array<int>").alias("starts"))
    own = F.sequence(F.col("carried") + 1, F.size("turns"))
    g = g.withColumn("starts", F.aggregate(own, zero, step, lambda acc: acc["starts"]))
    g = g.select("*", F.posexplode("starts").alias("window", "start"))
    stop = F.coalesce(F.get("starts", F.col("window") + 1), F.size("turns") + 1)
    g = g.withColumn("own", F.slice("turns", F.col("start"), stop - F.col("start")))
    origin = F.col("own")[0]["before"]
    reach = F.slice("turns", F.greatest(F.lit(1), F.col("start") - REACH), F.least(F.lit(REACH), F.col("start") - 1))
    kept = F.col("system").isNotNull() | ((F.col("here") > 0) & (F.col("here") < F.col("start")))
    skip = F.when(kept & F.col("system").isNull(), F.col("head")["before"])  # the system turn is not history as well
    history = F.filter(reach, lambda x: (origin - x["before"] <= HISTORY) & (skip.isNull() | (x["before"] != skip)))
    g = g.withColumns({"repeated": F.concat(F.when(kept, F.array("head")).otherwise(F.slice("turns", 1, 0)), history)})

    def written(x):
        return F.concat(F.lit(START), x["said"], F.lit("\n"), x["body"], F.lit(END + "\n"))
    g = g.withColumn("opening", F.array_join(F.transform("repeated", written), ""))

    def mark(acc, x):
        begin = acc["at"] + F.length(x["said"]) + len(START) + 1
        end = begin + F.length(x["body"])
        return F.struct((end + len(END) + 1).alias("at"), F.when(
            x["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))
    none = F.struct(F.length("opening").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return g.select(
        "conv_id", "block", "window", F.col("own")[0]["turn"].alias("first_turn"), F.element_at("own", -1)["turn"].alias("last_turn"),
        F.size("repeated").alias("n_repeated"),
        F.aggregate(F.concat("repeated", "own"), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_tokens"),
        F.concat("opening", F.array_join(F.transform("own", written), "")).alias("text"),
        F.aggregate("own", none, mark, lambda acc: acc["spans"]).alias("loss"))


def turns_of(text: Column, skip: Column) -> Column:
    """The (role, text) turns of a formatted window after its first ``skip`` ones."""
    def turn(x):
        at = F.instr(x, "\n")
        body = F.substring(x, at + 1, F.length(x) - at - len(END) - 1)
        return F.struct(unescaped_role(F.substring(x, F.lit(1), at - 1)).alias("role"), unescaped(body).alias("text"))
    pieces = F.split(text, START.replace("|", r"\|"), -1)
    return F.transform(F.filter(pieces, lambda _, i: i > skip), turn)  # before the first mark stands nothing


def digests(formatted: DataFrame) -> DataFrame:
    """windows -> one row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Everything is read back from the formatted texts and masks. A digest of a
    whole conversation needs its text in one row; the windows themselves don't.
    """
    own = turns_of(F.col("text"), F.col("n_repeated"))
    loss = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    read = formatted.select(
        "conv_id", "block", "window", F.length("text").cast("long").alias("chars"), own.alias("own"), F.array_join(loss, "").alias("loss"))
    read = read.select("conv_id", "block", "window", "chars", "loss", F.size("own").cast("long").alias("n"), F.array_join(
        F.transform("own", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"))
    g = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("block", "window", "said", "loss"))).alias("w"))
    said, kept = F.array_join("w.said", ""), F.array_join("w.loss", "")
    return g.select("conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                    F.length(kept).cast("long").alias("loss_chars"), F.sha2(kept.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def oracle() -> str:
    """For conversations whose turn numbers lie in one stretch; windows by a recursive walk over the turns."""
    return f"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
sized AS (SELECT *, length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g'))
    + length(replace(replace(role, '\\', '\\\\'), chr(10), '\\n')) + {len(START + END) + 2} AS chars,
  -(-strlen(text) // 4) + {TURN_TOKENS} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM said),
turns AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos) - n AS before FROM sized),
heads AS (SELECT conv_id, min(pos) AS head, arg_min(n, pos) AS head_n, arg_min(chars, pos) AS head_chars FROM turns WHERE role = 'system' GROUP BY conv_id),
walk AS (
  SELECT conv_id, 1::BIGINT AS pos, 1::BIGINT AS start, 0::BIGINT AS origin, {BUDGET}::BIGINT AS room FROM turns WHERE pos = 1
  UNION ALL
  SELECT w.conv_id, t.pos, CASE WHEN t.before + t.n - w.origin <= w.room THEN w.start ELSE t.pos END,
    CASE WHEN t.before + t.n - w.origin <= w.room THEN w.origin ELSE t.before END::BIGINT,
    CASE WHEN t.before + t.n - w.origin <= w.room THEN w.room ELSE {BUDGET - HISTORY} - coalesce(h.head_n, 0) END::BIGINT
  FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.pos = w.pos + 1 LEFT JOIN heads h ON h.conv_id = w.conv_id),
openings AS (SELECT DISTINCT conv_id, start, origin FROM walk),
repeated AS (
  SELECT o.conv_id, t.chars FROM openings o JOIN turns t ON t.conv_id = o.conv_id AND t.pos < o.start AND t.pos >= o.start - {REACH}
    AND o.origin - t.before <= {HISTORY} LEFT JOIN heads h ON h.conv_id = o.conv_id WHERE h.head IS NULL OR t.pos <> h.head
  UNION ALL SELECT o.conv_id, h.head_chars FROM openings o JOIN heads h ON h.conv_id = o.conv_id AND h.head < o.start),
formatted AS (SELECT conv_id, sum(chars) AS chars FROM (SELECT conv_id, chars FROM turns UNION ALL SELECT * FROM repeated) GROUP BY conv_id),
texts AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
  coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss FROM turns GROUP BY conv_id)
SELECT t.conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM texts t JOIN formatted f ON f.conv_id = t.conv_id
"""
