"""Chat formatting from an event log.

A log holds, for each conversation, events in the order of ``seq``:

- ``message``     opens a turn with a role and a text
- ``delta``       appends its text to the turn
- ``edit``        replaces the text of the turn
- ``regenerate``  restarts the turn from its text and discards the later turns seen so far

``event_log`` makes such a log of a table of turns: assistant texts arrive in deltas,
some after a discarded first answer and a follow-up to it, other texts as messages,
some of them edited. ``fold`` reduces a log to final turns, ``render`` writes a
conversation as one string ``<turn ROLE>TEXT</turn>\\n`` per turn, with a loss mask: the
code point ranges of the assistant texts in that string. ``read_back`` parses string
and mask. In roles and texts ``\\``, ``<`` and ``>`` become ``\\0``, ``\\1`` and
``\\2``, so no text can imitate a marker and nothing is lost.

Everything is DataFrame functions. Events shuffle once, by conversation, because a
rendered conversation is one row; sorting spills to disk. A very long conversation is
thus one task, and its string and turns must fit in memory a few times.

Edge cases: a null text or role counts as empty, a null kind as ``message``; a null
conversation id is a conversation of its own; events that tie in ``seq`` go by turn,
kind, role and text; events without a turn form one, which is first and never
discarded; repeated rows are repeated events; in ``turn_rows`` each row is a turn of
its own even if turn numbers repeat or are null (nulls first); an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Characters that are escaped, and what stands for them.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), (">", "\\2"))
OPEN, HEAD_END, CLOSE = "<turn ", ">", "</turn>\n"
LOSS_ROLE = "assistant"
#: Code points of a delta in a made log, and the text that is replaced there.
PIECE, DRAFT = 256, "(draft)"


def escaped(text: Column) -> Column:
    for raw, mark in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    for raw, mark in reversed(ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


def turn_rows(rows: DataFrame) -> DataFrame:
    """A log from a table with one row for each turn: the rows of a conversation, numbered by turn."""
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), role, text)
    n = F.row_number().over(order).cast("long")
    return rows.select("conv_id", n.alias("seq"), n.alias("turn"), F.lit("message").alias("kind"), role.alias("role"), text.alias("text"))


def event_log(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """A log that folds to the turns of ``rows``: streamed, regenerated and edited by the place of a turn."""
    e = turn_rows(rows).select("conv_id", F.col("turn").alias("n"), "role", "text")

    def event(kind: str, text: Column, role: Column | None = None, turn: Column | None = None) -> Column:
        return F.struct((F.col("n") if turn is None else turn).alias("turn"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))

    none, draft = F.lit(""), F.lit(DRAFT)
    deltas = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), lambda t: event("delta", t))
    opened = event("message", none, F.col("role"))
    again = F.array(opened, event("delta", draft), event("message", draft, F.lit("user"), F.col("n") + 1), event("regenerate", none))
    streamed = F.when(F.col("n") % 4 == 0, F.concat(again, deltas)).otherwise(F.concat(F.array(opened), deltas))
    edited = F.array(event("message", draft, F.col("role")), event("edit", F.col("text")))
    said = F.when(F.col("n") % 3 == 0, edited).otherwise(F.array(event("message", F.col("text"), F.col("role"))))
    e = e.select("conv_id", "n", F.posexplode(F.when(F.col("role") == LOSS_ROLE, streamed).otherwise(said)).alias("k", "e"))
    return e.select("conv_id", F.shiftleft("n", 32).bitwiseOR(F.col("k").cast("long")).alias("seq"), "e.*")


def fold(events: DataFrame) -> DataFrame:
    """Final turns (conv_id, turn, role, text) of a log (conv_id, seq, turn, kind, role, text)."""
    kind = F.coalesce("kind", F.lit("message"))
    e = events.select("conv_id", "seq", "turn", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("seq", "turn", "kind", "role", "text")
    e = e.withColumn("at", F.row_number().over(order))
    later = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)
    e = e.withColumn("cut", cut).where(~F.coalesce(F.col("turn") > F.col("cut"), F.lit(False)))
    starts = F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(Window.partitionBy("conv_id", "turn"))
    e = e.withColumn("start", starts).where(F.col("start").isNull() | (F.col("at") >= F.col("start")) | F.col("role").isNotNull())
    live = F.col("start").isNull() | (F.col("at") >= F.col("start"))
    texts = F.sort_array(F.collect_list(F.when(live, F.struct("at", "text"))))
    return e.groupBy("conv_id", "turn").agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))), F.lit("")).alias("role"),
        F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("text"),
    )


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the string of each conversation, and the code point ranges (start, end) that the loss covers."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(HEAD_END))
    rows = turns.select("conv_id", "turn", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(CLOSE)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    rows = rows.withColumn("start", start).select("conv_id", "turn", F.concat("head", "body", F.lit(CLOSE)).alias("whole"), F.when(F.col("loss"), F.struct("start", (F.col("start") + F.length("body")).alias("end"))).alias("span"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "whole"))).alias("parts"), F.sort_array(F.collect_list("span")).alias("loss"))
    return out.select("conv_id", F.array_join(F.col("parts.whole"), "").alias("formatted"), "loss")


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, chars) from ``formatted`` and the mask alone; a turn's ``loss`` says that a range of the mask is its text."""
    # no split inside: the markers hold characters that texts cannot
    blocks = F.transform(F.filter(F.split("formatted", CLOSE), lambda b: b != ""), lambda b, k: F.struct(k.alias("pos"), b.alias("block"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end")))
    spans = F.transform("loss", lambda s: F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("block"), s["start"].alias("start"), s["end"].alias("end")))
    rows = rendered.select("conv_id", F.explode(F.concat(blocks, spans)).alias("x")).select("conv_id", "x.*")
    size = F.coalesce(F.length("block") + len(CLOSE), F.lit(0))
    before = Window.partitionBy("conv_id").orderBy(F.col("pos").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    body = F.substring_index("block", HEAD_END, -1)
    rows = rows.withColumn("size", size).withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    begin, stop = F.col("at") + F.length("block") - F.length(body), F.col("at") + F.length("block")
    role = unescaped(F.substring_index(F.substring("block", len(OPEN) + 1, 2**31 - 1), HEAD_END, 1))
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", role.alias("role"), unescaped(body).alias("text"), stop.alias("stop"), "size"))
    # a text and the range that covers it begin at the same place, and no two texts do
    met = rows.select("conv_id", F.coalesce("start", begin).alias("at"), turn.alias("turn"), "end").groupBy("conv_id", "at").agg(F.max("turn").alias("turn"), F.max("end").alias("end"))
    met = met.where("turn IS NOT NULL").select("conv_id", F.struct("turn.pos", "turn.role", "turn.text", F.coalesce(F.col("end") == F.col("turn.stop"), F.lit(False)).alias("loss")).alias("turn"), "turn.size")
    out = met.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.sum("size").alias("chars"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return out.select("conv_id", "turns", loss.alias("loss_text"), "chars")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted, then read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).coalesce(1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_back(render(fold(event_log(rows.unionByName(extra)))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(x: str) -> str:
    for raw, mark in ESCAPES:
        x = f"replace({x}, '{raw}', '{mark}')"
    return x


OP8_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), told AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length({_sql_escaped('role')}) + length({_sql_escaped('text')}) + {len(OPEN + HEAD_END + CLOSE)}) AS chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM told
"""
