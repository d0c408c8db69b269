"""Chat formatting from a declarative template, in DataFrame functions only.

A template names the control strings, the roles under the loss and the finite
state machine over roles. The machine runs on blocks of BLOCK_TURNS turns: a
block's effect is the state reached from every state, and effects compose in
the order of blocks, so a conversation of any length is checked without
gathering its turns in one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 256


@dataclass(frozen=True)
class ChatTemplate:
    """Turns read ``<open>role<role_end>text<close>``; ``loss_roles`` carry the loss.

    ``turns`` maps each state ("" is the start, other states are the role last
    seen) to the roles that may follow; ``final`` are the states to end in.
    """

    open: str = "<|im_start|>"
    role_end: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    """No control string is left: a backslash goes before the bar of every
    ``<|`` (or ``<`` backslashes ``|``)."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chat_segments(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, turn, role, text and ``segments``: an array of (text, loss).

    One row per turn, with three segments: the opening with the role, the
    escaped text (under the loss for the template's loss roles) and the
    closing. The formatted conversation is all segments in the order of turn,
    role, text. Null role or text counts as empty; a null turn sorts first;
    turns with equal numbers follow each other by role and text. Turns are
    formatted whether or not their order is valid (see :func:`turn_order`).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    part = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    return turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.array(
            part(F.concat(F.lit(template.open), escape_role(role), F.lit(template.role_end)), F.lit(False)),
            part(escape(text), role.isin(*template.loss_roles)),
            part(F.lit(template.close), F.lit(False)),
        ).alias("segments"),
    )


def turn_order(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, valid: whether the roles of each conversation, in turn order,
    are accepted by the template's state machine. An unknown role is not."""
    states = ["", *[s for s in template.turns if s]]
    dead = len(states)
    step = {
        role: [states.index(role) if s < dead and role in template.turns[states[s]] else dead for s in range(dead + 1)]
        for role in states[1:]
    }
    effect = F.lit(None)
    for role, to in step.items():
        effect = F.when(F.col("role") == role, F.array(*map(F.lit, to))).otherwise(effect)
    effect = F.coalesce(effect, F.array(*[F.lit(dead)] * (dead + 1)))
    start = F.array(*map(F.lit, range(dead + 1)))

    def composed(steps: Column) -> Column:
        return F.aggregate(steps, start, lambda now, s: F.transform(now, lambda x: F.get(s["effect"], x)))

    blocks = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .select("conv_id", "turn", F.floor(F.col("turn") / BLOCK_TURNS).alias("block"), "role", F.xxhash64("text").alias("t"), effect.alias("effect"))
        .groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "t", "effect"))).alias("steps"))
        .select("conv_id", F.struct("block", composed(F.col("steps")).alias("effect")).alias("step"))
    )
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    return whole.select(
        "conv_id", F.get(composed(F.col("steps")), 0).isin(*[states.index(s) for s in template.final]).alias("valid")
    )


def read_formatted(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """A formatted conversation -> array of (role, text), the template undone."""
    quoted = "".join("\\" + c if not c.isalnum() and c not in "_\n" else c for c in template.open)
    pieces = F.slice(F.split(formatted, quoted, -1), 2, 1_000_000_000)

    def parse(piece: Column) -> Column:
        role = F.substring_index(piece, template.role_end, 1)
        body = F.substr(
            piece, F.length(role) + len(template.role_end) + 1,
            F.length(piece) - F.length(role) - len(template.role_end) - len(template.close),
        )
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, parse)


def conversation_digests(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Per conversation the digests of what its formatted output holds.

    A digest runs over a whole conversation, so here (and only here) its text
    comes together in one row.
    """
    whole = (
        chat_segments(turns, template).groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "segments"))).alias("turns"))
        .select("conv_id", F.flatten(F.transform("turns", lambda t: t["segments"])).alias("segments"))
        .select(
            "conv_id",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss_text"),
        )
        .withColumn("back", read_formatted(F.col("formatted"), template))
    )
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digests = whole.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).alias("a")
    order = turn_order(turns, template).alias("b")
    return digests.join(order, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.*", "b.valid")
