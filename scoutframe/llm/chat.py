"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything is DataFrame functions.  A template gives each role a prefix and a
suffix (control strings) and a loss flag.  Texts are escaped so that no control
string can occur inside them; reading the output back undoes that exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutframe.llm._shared import table

#: role: (prefix, suffix, loss on the text).  ``None`` stands for any other role, named in its prefix.
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<s>", "</s>", True),
    None: ("[ROLE={}]", "[/ROLE]", False),
}
#: Character and what stands for it inside texts and role names.  The backslash comes first.
ESCAPES = (("\\", "\\b"), ("[", "\\o"), ("]", "\\c"), ("<", "\\l"), (">", "\\g"))
#: state, role -> state.  What is missing here is an error.
MACHINE = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}
FINAL = ("assistant",)
_TURN = r"(<<SYS>>|\[INST\] |<s>|\[ROLE=[^\[\]<>]*\])([^\[\]<>]*?)(<</SYS>>| \[/INST\]|</s>|\[/ROLE\])"


def escaped(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _by_role(role: Column, part: int) -> Column:
    out = None
    for name, parts in TEMPLATE.items():
        if name is not None:
            out = (F if out is None else out).when(role == name, F.lit(parts[part]))
    other = TEMPLATE[None][part]
    if part == 0:
        head, tail = other.split("{}")
        other = F.concat(F.lit(head), escaped(role), F.lit(tail))
    return out.otherwise(other)


def segments_of(turn: Column) -> Column:
    """Three segments of a turn: prefix, escaped text, suffix, each with its loss flag."""

    def segment(text, loss):
        return F.struct(text.alias("text"), loss.alias("loss"))

    role = turn["role"]
    return F.array(
        segment(_by_role(role, 0), F.lit(False)),
        segment(escaped(turn["text"]), _by_role(role, 2)),
        segment(_by_role(role, 1), F.lit(False)),
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``segments`` (text, loss), ``formatted``, ``valid`` and ``end_state``.

    Turns are ordered by turn, then role, then text, so ties and repeated rows
    have one order.  A null text or role is empty; a null turn comes first.  A
    conversation that breaks the order of roles is formatted as well, with
    ``valid`` false.  Other columns of the input play no part.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("turn"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    step = F.create_map(*[F.lit(x) for (a, b), c in MACHINE.items() for x in (f"{a}>{b}", c)])
    state = F.aggregate(
        "turns",
        F.lit("start"),
        lambda at, t: F.coalesce(F.try_element_at(step, F.concat(at, F.lit(">"), t["role"])), F.lit("error")),
    )
    out = grouped.select(
        "conv_id",
        state.alias("end_state"),
        F.flatten(F.transform("turns", segments_of)).alias("segments"),
    )
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("end_state").isin(*FINAL).alias("valid"),
        "end_state",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (role, text, loss) read from ``formatted`` alone."""
    parts = formatted.select(
        "*",
        F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(1)).alias("__open"),
        F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(2)).alias("__body"),
    )

    def role_of(mark):
        out = None
        for name, (prefix, _, _) in TEMPLATE.items():
            if name is not None:
                out = (F if out is None else out).when(mark == prefix, F.lit(name))
        return out.otherwise(unescaped(F.regexp_extract(mark, r"=([^\[\]]*)\]", 1)))

    losing = [p for n, (p, _, loss) in TEMPLATE.items() if loss and n is not None]
    turn = F.zip_with(
        "__open",
        "__body",
        lambda mark, body: F.struct(
            role_of(mark).alias("role"), unescaped(body).alias("text"), mark.isin(*losing).alias("loss")
        ),
    )
    return parts.withColumn("turns", turn).drop("__open", "__body")


def op4_chat_fsm(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, with digests read back from the output."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    back = read_back(format_chats(rows.unionAll(extra)))
    said_back = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_back, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _oracle() -> str:
    return r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(text) + length(text) - length(regexp_replace(text, '[\\\[\]<>]', '', 'g')) AS text_len,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
      ELSE 14 + length(role) + length(role) - length(regexp_replace(role, '[\\\[\]<>]', '', 'g')) END AS mark_len,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS after
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_len + mark_len)::BIGINT AS formatted_chars,
  bool_and((before IS NULL AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
    OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user'))
    AND bool_or(after IS NULL AND role = 'assistant') AS valid
FROM marked GROUP BY conv_id"""


QUERIES = {"op4_chat_fsm": op4_chat_fsm}
ORACLE_SQL = {"op4_chat_fsm": _oracle()}
