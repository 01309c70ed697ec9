"""Chat formatting by a declarative template, in DataFrame functions only.

A finite-state machine walks the roles of a conversation and says whether the
turn order is valid and where it first breaks. Each turn becomes segments with
a loss flag: its opening mark, its text, its closing mark. The formatted text is
the segments joined.

Escapes: a backslash in a text is doubled, and a backslash is put behind the
first character of every control string in it. No control string holds a
backslash, so none is left, and `Template` refuses control strings that a text
and the marks around it could make together. Dropping each backslash before its
next character gives the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles are learnt, and which roles may follow each other."""

    open: str = "<|turn|>"
    close: str = "<|end|>"
    #: Also never left as they are inside texts: the marks of other common formats.
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    learnt: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a pair that is missing breaks the order for good.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("answered",)

    def strings(self) -> list[str]:
        """All control strings, longest first."""
        out = sorted({self.open, self.close, *self.controls}, key=lambda c: (-len(c), c))
        if any(len(c) < 2 or set(c) & set("\\\n") for c in out):
            raise ValueError("a control string has two characters or more and neither backslash nor line feed")
        for c in out:
            for i in range(1, len(c)):
                head, tail = c[:i], c[i:]
                if any(m.endswith(head) or head.endswith(m) or m.startswith(tail) or tail.startswith(m) for m in (self.open, self.close)):
                    raise ValueError(f"a text next to a mark could make the control string {c!r}")
        return out


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def escape(text: Column, template: Template) -> Column:
    """`text` without any control string."""
    strings = template.strings()
    rest = {first: "|".join(_literal(c[1:]) for c in strings if c[0] == first) for first in sorted({c[0] for c in strings})}
    found = "|".join(f"{_literal(first)}(?={ahead})" for first, ahead in rest.items())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), found, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_order(roles: Column, template: Template) -> Column:
    """State after all roles and the place of the first that breaks the order (null if none)."""
    table = F.create_map(
        *[F.lit(x) for state, moves in template.moves.items() for role, to in moves.items() for x in (f"{state}\n{role}", to)]
    )
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("turn"), F.lit(None).cast("int").alias("broken_at"))

    def step(at: Column, role: Column) -> Column:
        to = F.coalesce(F.element_at(table, F.concat(at["state"], F.lit("\n"), F.coalesce(role, F.lit("")))), F.lit("broken"))
        return F.struct(
            to.alias("state"),
            (at["turn"] + 1).alias("turn"),
            F.coalesce(at["broken_at"], F.when(to == "broken", at["turn"])).alias("broken_at"),
        )

    return F.aggregate(roles, start, step)


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text): valid, broken_at, segments and formatted text.

    Turns are ordered by turn, then role, then text; nulls come first. A null
    text or role is empty. Rows with a null conv_id are one conversation;
    repeated rows are turns of their own, which breaks the order (valid is false)
    but drops nothing. Other columns are not used.
    """
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    talks = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("_turn")).groupBy("conv_id")
    talks = talks.agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))

    def segments(t: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        # the role ends at the first line feed that has no backslash before it
        role = F.replace(escape(t["role"], template), F.lit("\n"), F.lit("\\\n"))
        return F.array(
            segment(F.concat(F.lit(template.open), role, F.lit("\n")), F.lit(False)),
            segment(escape(t["text"], template), t["role"].isin(*template.learnt)),
            segment(F.lit(template.close), F.lit(False)),
        )

    order = turn_order(F.transform("_turns", lambda t: t["role"]), template)
    return (
        talks.withColumn("_order", order)
        .withColumn("segments", F.flatten(F.transform("_turns", segments)))
        .select(
            "conv_id",
            (F.col("_order.broken_at").isNull() & F.col("_order.state").isin(*template.accepting)).alias("valid"),
            F.col("_order.broken_at").alias("broken_at"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped."""
    parts = F.split(formatted, _literal(template.open))
    turns = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    pattern = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)" + _literal(template.close) + r"\z"

    def one(part: Column) -> Column:
        return F.struct(
            unescape(F.regexp_extract(part, pattern, 1)).alias("role"),
            unescape(F.regexp_extract(part, pattern, 2)).alias("text"),
        )

    return F.transform(turns, one)


def conversation_digests(talks: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the formatted output."""
    turns = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return (
        talks.withColumn("_turns", read_turns(F.col("formatted"), template))
        .withColumn("_loss", F.array_join(loss, ""))
        .select(
            "conv_id",
            F.size("_turns").cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.length("_loss").cast("bigint").alias("loss_chars"),
            F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
            F.length("formatted").cast("bigint").alias("formatted_chars"),
            "valid",
            "broken_at",
        )
    )
