"""Chat formatting: a finite-state machine over roles, and a declarative template.

A template names the markers around a turn, the roles whose texts are trained on, the strings that may not appear
inside a text, and the state machine of valid turn orders. Formatting emits segments (text, loss): the opening marker
with the role, the escaped text, the closing marker. Only texts of trained roles carry the loss flag.

Escaping is reversible: the escape character is doubled, and one is put after the first character of every control
string, so that none survives inside a text. unescape() takes the character after an escape literally.

A conversation is the rows of one id in order of turn; rows of one turn follow role and text. A null text or role is
empty, a null turn comes first, and rows without id are one conversation of their own. Conversations that break the turn
order are formatted all the same, with valid = false and the number of turns before the break. Only the four named columns
are read, so other columns can't clash. One conversation must fit a task, as it is one row of the result, however long its texts are. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "error"


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    trained: tuple[str, ...] = ("assistant",)
    #: Escaped inside texts too, so that a text can't pass for a turn of another common format.
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\\"
    start: str = "start"
    #: state -> role -> next state; what isn't listed is an error.
    order: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple[str, ...] = ("user", "assistant")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.middle, self.end, *self.others)


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    """text with its control strings broken up."""
    mark = re.escape(template.escape)
    doubled = F.regexp_replace(text, f"({mark})", "$1$1")
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(doubled, f"({starts})", "$1" + mark)


def unescape(text: Column, template: Template = CHAT) -> Column:
    return F.regexp_replace(text, f"(?s){re.escape(template.escape)}(.)", "$1")


def turn_order(roles: Column, template: Template = CHAT) -> Column:
    """struct(state, turns): the machine's last state, and how many turns were in order."""
    arrows = [(f"{state}\n{role}", to) for state, row in template.order.items() for role, to in row.items()]
    table = F.create_map(*(F.lit(x) for pair in arrows for x in pair))
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("turns"))

    def step(was: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat(was["state"], F.lit("\n"), role)), F.lit(ERROR))
        return F.struct(to.alias("state"), (was["turns"] + F.when(to == ERROR, 0).otherwise(1)).alias("turns"))

    return F.aggregate(roles, begin, step)


def _segments(turns: Column, template: Template) -> Column:
    def of(t: Column) -> Column:
        head = F.concat(F.lit(template.begin), escape(t["role"], template), F.lit(template.middle))
        told = ((head, F.lit(False)), (escape(t["text"], template), t["role"].isin(*template.trained)), (F.lit(template.end), F.lit(False)))
        return F.array(*(F.struct(text.alias("text"), loss.alias("loss")) for text, loss in told))

    return F.flatten(F.transform(turns, of))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = CHAT) -> DataFrame:
    """One row a conversation: conv_id, n_turns, valid, valid_turns, segments (array of text, loss), formatted."""
    blank = F.lit("")
    told = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"))
    whole = rows.select(F.col(conv).alias("conv_id"), told.alias("told")).groupBy("conv_id").agg(F.sort_array(F.collect_list("told")).alias("turns"))
    state = turn_order(F.transform("turns", lambda t: t["role"]), template)
    out = whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.alias("order"), _segments(F.col("turns"), template).alias("segments"))
    return out.select(
        "conv_id",
        "n_turns",
        F.col("order.state").isin(*template.final).alias("valid"),
        F.col("order.turns").alias("valid_turns"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, re.escape(template.end)), lambda p: p != "")

    def of(part: Column) -> Column:
        halves = F.split(F.substr(part, F.lit(len(template.begin) + 1)), re.escape(template.middle))
        return F.struct(unescape(halves[0], template).alias("role"), unescape(halves[1], template).alias("text"))

    return F.transform(parts, of)


def digests(chats: DataFrame, template: Template = CHAT) -> DataFrame:
    """What the formatted conversations hold, read back from formatted and segments."""
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    out = chats.select("*", F.array_join(F.transform(read_back(F.col("formatted"), template), turn), "").alias("told"), loss.alias("trained"))
    return out.select(
        "conv_id",
        F.size(read_back(F.col("formatted"), template)).cast("long").alias("n_turns"),
        F.sha2("told", 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


PROBE = "</s>[INST] ok [/INST]"


def op3_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))
    return digests(format_chats(rows.unionByName(probe)))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), told AS (
  SELECT *,
    length('<|im_start|><|im_sep|><|im_end|>') + length(role) + length(text)
    + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(role, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))
    + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS chars,
    lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before = '' WHEN 'user' THEN before IN ('', 'system', 'assistant') WHEN 'assistant' THEN before = 'user' ELSE false END)
    AND max_by(role, turn) IN ('user', 'assistant') AS valid
FROM told GROUP BY conv_id
"""
