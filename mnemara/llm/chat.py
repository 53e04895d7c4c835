"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events ``conv_id, seq, msg_id, kind, role, text``:

=============  ==================================================================================
``start``      opens message ``msg_id`` with its role
``delta``      appends text to the message
``edit``       replaces what the message holds so far; later deltas append to it
``regenerate`` empties the message and removes every message that was started after it until now
=============  ==================================================================================

Events are grouped by message first (sorted by ``seq``, folded to one text), so what reaches a conversation
is one row a message; the conversation is then rendered with a template. Every control string inside a role
or text gets a backslash after its first character (backslashes are doubled first), so a marker of the template
never occurs inside a turn and ``unescape(escape(x)) == x``.

Edge cases: null text is empty, null role is the empty role; messages with no ``start`` event take the
place and role of their first event; rows equal in conversation and turn are ordered by role, then text;
repeated rows are turns of their own; null conversation ids form one conversation; an empty table gives an
empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemara.llm.common import table

DELTA_CHARS = 512


@dataclass(frozen=True)
class Template:
    open: str = "<|turn|>"
    close: str = "<|end|>"
    #: Control strings of common chat templates, escaped inside texts beside the template's own.
    foreign: tuple[str, ...] = field(default=("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>"))

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.close, *self.foreign)

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.controls:
            out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
        return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, seq`` (of the message's start), ``role, text``."""
    resets = F.col("kind").isin("edit", "regenerate")
    message = events.groupBy("conv_id", "msg_id").agg(
        F.min("seq").alias("seq"),
        F.min_by(F.struct("role"), F.struct((F.col("kind") != "start").alias("k"), "seq"))["role"].alias("role"),
        F.max(F.when(resets, F.col("seq"))).alias("_reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_regen"),
        F.array_sort(
            F.collect_list(F.when(F.col("kind").isin("delta", "edit"), F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
        ).alias("_parts"),
    )
    live = F.filter("_parts", lambda p: F.col("_reset").isNull() | (p["seq"] >= F.col("_reset")))
    message = message.withColumn("text", F.array_join(F.transform(live, lambda p: p["text"]), ""))
    # A message goes if a regeneration of an earlier message comes after its start.
    earlier = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max("_regen").over(earlier)
    return (
        message.withColumn("_cut", cut)
        .where(F.col("_cut").isNull() | (F.col("_cut") < F.col("seq")))
        .select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), "text")
    )


def render(messages: DataFrame, template: Template = Template(), loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss_spans``: spans are the turns under the loss mask, as code points of ``formatted``."""
    t = template
    role = F.replace(t.escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    m = (
        messages.withColumn("_head", F.concat(F.lit(t.open), role, F.lit("\n")))
        .withColumn("_body", t.escape(F.col("text")))
        .withColumn("_turn", F.concat("_head", "_body", F.lit(t.close)))
    )
    order = Window.partitionBy("conv_id").orderBy("seq")
    m = m.withColumn("_no", F.row_number().over(order)).withColumn(
        "_start", F.sum(F.length("_turn").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("_turn") + F.length("_head")
    )
    span = F.when(
        F.col("role").isin(*loss_roles),
        F.struct(F.col("_no").alias("turn"), F.col("_start").alias("start"), (F.col("_start") + F.length("_body")).alias("end")),
    )
    return m.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_turn"))), lambda x: x["_turn"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text as ``array<struct<role, text, body>>``; ``body`` is the text as escaped."""
    pieces = F.split(formatted, _quoted(template.close))
    head = r"^((?:[^\\\n]|\\[\s\S])*)\n"

    def turn(p: Column) -> Column:
        rest = F.substring(p, F.lit(len(template.open) + 1), F.length(p))
        raw = F.regexp_extract(rest, head, 1)
        body = F.substring(rest, F.length(raw) + 2, F.length(rest))
        return F.struct(unescape(raw).alias("role"), unescape(body).alias("text"), body.alias("body"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def _quoted(s: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|<>" and c not in "<>-" else c for c in s)


def conversation_events(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """A log that leads to a table of turns: a start and deltas a turn, and as a chat has them some detours.

    By a hash of conversation and message, one message in eight starts with words that an edit replaces, and one in sixteen
    with words, and another message after it, that a regeneration takes back.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "msg_id", F.row_number().over(order).cast("long")
    )
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / delta_chars)).cast("int")
    detour = F.pmod(F.xxhash64("conv_id", "msg_id"), F.lit(16))
    wrong = F.concat(F.substring("text", 1, 16), F.lit("<|end|>?"))

    def event(i: int | Column, kind: str | Column, part: Column, own: bool = True) -> Column:
        none = F.lit(None).cast("string")
        role = F.col("role") if own and isinstance(kind, str) and kind == "start" else none
        return F.struct(
            (F.lit(i) if isinstance(i, int) else i).alias("i"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), role.alias("role"),
            (none if part is None else part).alias("part"), (F.col("msg_id") if own else -F.col("msg_id")).alias("msg_id"),
        )

    start, nothing = event(0, "start", None), F.array().cast("array<struct<i:int,kind:string,role:string,part:string,msg_id:bigint>>")
    before = F.when(detour == 0, F.array(event(1, "delta", wrong), event(2, "start", None, own=False), event(3, "delta", wrong, own=False), event(4, "regenerate", None)))
    before = before.when(detour <= 2, F.array(event(1, "delta", wrong))).otherwise(nothing)
    edited = (detour == 1) | (detour == 2)
    parts = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: event(i + 4, F.when(edited & (i == 1), "edit").otherwise("delta"), F.substring(F.col("text"), (i - 1) * delta_chars + 1, F.lit(delta_chars))),
    )
    return rows.withColumn("e", F.explode(F.concat(F.array(start), before, parts))).select(
        "conv_id", (F.col("msg_id") * (1 << 24) + F.col("e.i")).alias("seq"), F.col("e.msg_id").alias("msg_id"), F.col("e.kind").alias("kind"), F.col("e.role").alias("role"), F.col("e.part").alias("text")
    )


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    return render(fold_events(conversation_events(conversations)), template)


PROBE_TEXT = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table with conversation -7, whose texts are another template's control strings."""
    turns = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])
    probe = conversations.sparkSession.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.explode(turns).alias("t")
    ).select("conv_id", "t.turn", "t.role", F.lit(PROBE_TEXT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_conversations(with_probe(table(spark, sf_dir, "conversations")))
    turns = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    # Text under the mask: what the spans cover of the formatted text.
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return (
        out.withColumn("turns", read_turns(F.col("formatted")))
        .withColumn("loss_text", F.array_join(masked, ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2("loss_text", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def _sql_escape(column: str) -> str:
    t = Template()
    out = f"replace({column}, '\\', '\\\\')"
    for c in t.controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP9_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE_TEXT}'
), g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|turn|>') + length(replace({_sql_escape('role')}, chr(10), '\\' || chr(10))) + 1
      + length({_sql_escape('text')}) + length('<|end|>'))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
