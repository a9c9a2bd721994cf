"""Chat formatting with Spark expressions only.

    ### User: first text<+>second text </turn>
    ### Assistant: answer </turn>

The turns of a conversation are collected as structs, sorted, and folded into one string; adjacent turns of a role share
a block, joined by <+>. Inside texts and roles a backslash, # and < are written \\b, \\h and \\l (in roles also : as \\c),
so no control string can occur there, and reading back is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, JOIN, END = "### ", ": ", "<+>", " </turn>\n"
#: Roles with a display name; any other role is written \r and its escaped name.
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
LOSS_ROLE = "assistant"


def escaped(text: Column, also: tuple = ()) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), [*ESCAPES, *also], text)


def unescaped(text: Column, also: tuple = ()) -> Column:
    """Each backslash of an escaped text begins an escape, so the last step may restore the backslash itself."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), [*also, *ESCAPES[::-1]], text)


def _shown(role: Column) -> Column:
    known = reduce(lambda c, r: c.when(role == r[0], r[1]), list(ROLES.items())[1:], F.when(role == "user", ROLES["user"]))
    return known.otherwise(F.concat(F.lit("\\r"), escaped(role, ((":", "\\c"),))))


def _role(shown: Column) -> Column:
    known = reduce(lambda c, r: c.when(shown == r[1], r[0]), list(ROLES.items())[1:], F.when(shown == ROLES["user"], "user"))
    return known.otherwise(unescaped(F.substring(shown, 3, 2**31 - 3), ((":", "\\c"),)))


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, length in code points of formatted).

    The loss mask covers the text of every assistant turn, without markers. Turns are ordered by turn (null last), then
    role, then text; rows that repeat are turns of their own. A null text or role is empty; rows with a null conv_id
    form one conversation. Other columns are ignored; an empty table gives an empty result.

    A conversation is one output row, so its turns meet in one task by definition; nothing else does.
    """
    turn = F.struct(
        F.col(turn_col).isNull().alias("no_turn"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    chats = rows.select(F.col(id_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    before = F.element_at(F.col("turns"), F.lit(1))["role"]
    # Parts of the output: what opens a turn (marker, or joint within a block) and its escaped text.
    parts = F.transform(
        "turns",
        lambda t, k: F.struct(
            F.when(k == 0, F.concat(F.lit(HEAD), _shown(before), F.lit(COLON)))
            .when(F.get("turns", k - 1)["role"] == t["role"], F.lit(JOIN))
            .otherwise(F.concat(F.lit(END + HEAD), _shown(t["role"]), F.lit(COLON)))
            .alias("opens"),
            escaped(t["text"]).alias("body"),
            (t["role"] == LOSS_ROLE).alias("loss"),
        ),
    )
    chats = chats.select("conv_id", parts.alias("parts"))
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["opens"]) + F.length(p["body"])).cast("long").alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(p["opens"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length"))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["opens"], p["body"])), ""), F.lit(END))
    return chats.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text: what formatted and loss_spans say, with the escapes undone."""
    blocks = F.split(F.regexp_replace("formatted", r"(?s)\A### | </turn>\n\z", ""), f"\\Q{END}{HEAD}\\E", -1)
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.instr(b, F.lit(COLON)) + len(COLON)), "\\Q" + JOIN + "\\E", -1),
                lambda t: F.struct(_role(F.substr(b, F.lit(1), F.instr(b, F.lit(COLON)) - 1)).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


#: DuckDB SQL of the query over conversations and the fixed conversation -7.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS body,
         lag(role) OVER w AS prev, row_number() OVER w AS k
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
sized AS (
  SELECT *, length(body) + CASE WHEN k > 1 AND prev = role THEN 3
    ELSE 4 + 9 + 2 + CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6
      ELSE 2 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c')) END END AS n
  FROM esc)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
