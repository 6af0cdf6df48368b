r"""Chat formatting (operator 8), with DataFrame functions only.

A template declares, for each role, the text before and after a turn and whether
the turn counts for the loss.  A finite-state machine over roles, also declared,
says whether the order of turns is valid and where it first goes wrong.  The
output of a conversation is a list of segments (text, loss flag); their
concatenation is the formatted text.

Control strings inside a text are escaped by a mark put after their first
character (`[INST]` becomes `[\INST]`, and `[\INST]` becomes `[\\INST]`).
Escaped text holds no control string, so the turns can be read back by cutting
at the control strings, and taking one mark away restores the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """roles: role -> (before, after, loss).  A role that is not declared is
    written as other[0] + role + other[1] + text + other[2], without loss.
    moves: state -> {role: next state}; `*` stands for any other role."""

    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("<s>[INST]", "[/INST]", False), "assistant": ("<bot>", "</s>", True)})
    other: tuple[str, str, str] = ("<role>", "<says>", "</role>")
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        """Control strings, longest first.  None may begin inside another, or
        text beside a control string could be taken for part of one."""
        pieces = {m for before, after, _ in self.roles.values() for s in (before, after) for m in re.findall(r"<<?/?\w+>>?|\[/?\w+\]", s)} | set(self.other)
        return sorted(pieces, key=lambda s: (-len(s), s))


def _quoted(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


def _inside(controls: list[str], marks: str) -> str:
    """A pattern of each control string with ``marks`` after its first character:
    group 1 the character, group 2 what follows the marks."""
    heads = sorted({c[0] for c in controls})
    each = [f"({_quoted(h)}){marks}({'|'.join(_quoted(c[1:]) for c in controls if c[0] == h)})" for h in heads]
    return each


def escape(text: Column, template: Template) -> Column:
    for pattern in _inside(template.controls, r"(\\*)"):
        text = F.regexp_replace(text, pattern, r"$1\\$2$3")
    return text


def unescape(text: Column, template: Template) -> Column:
    for pattern in _inside(template.controls, r"\\(\\*)"):
        text = F.regexp_replace(text, pattern, r"$1$2$3")
    return text


def format_chats(rows: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments (array of text and
    loss flag), formatted, valid, and error_turn (place of the first turn the
    machine refuses, from 0; n_turns if the end is refused; null if valid).

    Turns go by (turn, role, text), nulls first, so ties have one order.  Null
    texts and roles count as empty; repeated rows are turns of their own; rows
    without conv_id form one conversation with a null id; no rows give no rows.
    A conversation is one output text and so is gathered in one row.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")))).alias("turns"))

    def segments(t: Column) -> Column:
        body = escape(t["text"], template)
        name = escape(t["role"], template)
        pieces = F.array(*[F.struct(F.lit(x).alias("text"), F.lit(False).alias("loss")) if isinstance(x, str) else F.struct(x.alias("text"), F.lit(False).alias("loss")) for x in (template.other[0], name, template.other[1], body, template.other[2])])
        for r, (before, after, loss) in template.roles.items():
            own = F.array(*[F.struct(x.alias("text"), F.lit(flag).alias("loss")) for x, flag in ((F.lit(before), False), (body, loss), (F.lit(after), False))])
            pieces = F.when(t["role"] == r, own).otherwise(pieces)
        return pieces

    def move(state: Column, role: Column) -> Column:
        out = F.lit("refused")
        for s, to in template.moves.items():
            step = F.lit(to.get("*", "refused"))
            for r, then in to.items():
                if r != "*":
                    step = F.when(role == r, F.lit(then)).otherwise(step)
            out = F.when(state == s, step).otherwise(out)
        return out

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("seen"))
    end = F.aggregate("turns", begin, lambda a, t: F.when(a["state"] == "refused", a).otherwise(F.struct(move(a["state"], t["role"]).alias("state"), (a["seen"] + 1).alias("seen"))))
    out = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", segments)).alias("segments"), end.alias("end"))
    valid = F.col("end.state").isin(*template.final)
    at = F.when(F.col("end.state") == "refused", F.col("end.seen") - 1).otherwise(F.col("end.seen"))
    return out.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), valid.alias("valid"), F.when(~valid, at.cast("long")).alias("error_turn"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted text, unescaped."""
    starts = {before: role for role, (before, _, _) in template.roles.items()} | {template.other[0]: None}
    ends = {after for _, after, _ in template.roles.values()} | {template.other[2]}
    begin = "|".join(_quoted(s) for s in sorted(starts, key=lambda s: (-len(s), s)))
    finish = "|".join(_quoted(s) for s in sorted(ends, key=lambda s: (-len(s), s)))
    turns = F.regexp_extract_all(formatted, F.lit(f"(?s)((?:{begin}).*?(?:{finish}))"), F.lit(1))

    def read(turn: Column) -> Column:
        head = F.regexp_extract(turn, f"(?s)^({begin})", 1)
        body = F.regexp_extract(turn, f"(?s)^(?:{begin})(.*?)(?:{finish})$", 1)
        says = _quoted(template.other[1])
        role = F.regexp_extract(body, f"(?s)^(.*?){says}", 1)
        text = body
        for before, r in starts.items():
            if r is not None:
                role = F.when(head == before, F.lit(r)).otherwise(role)
            else:
                text = F.when(head == before, F.regexp_extract(body, f"(?s)^.*?{says}(.*)$", 1)).otherwise(text)
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(turns, read)


def digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """The query's columns, read back from ``formatted`` and ``segments``."""
    turns = read_turns(F.col("formatted"), template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # each segment is unescaped by itself: nothing stands between two of them
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    out = chats.withColumn("turns", turns).withColumn("masked", masked)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "error_turn",
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    echo = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{echo}'), (-1L, 1L, 'assistant', '{echo}') AS t(conv_id, turn, role, text)")
    return digests(format_chats(rows.unionByName(own))).drop("error_turn")


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '(<)(\\*)(<SYS>>|</SYS>>|/role>|role>|says>|/s>|bot>|s>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/INST\]|INST\])', '\1\\\2\3', 'g')) AS body,
    CASE role WHEN 'system' THEN length('<<SYS>><</SYS>>') WHEN 'user' THEN length('<s>[INST][/INST]') WHEN 'assistant' THEN length('<bot></s>') ELSE length('<role><says></role>') + length(role) END AS marks
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + marks) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text), '(system,)?user,assistant(,user,assistant)*') AS valid
FROM escaped GROUP BY conv_id
"""
