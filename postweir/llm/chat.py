"""Conversations as one formatted text each, with loss flags, from a declarative template; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that begin or end a marker, and what stands for them inside a text. The first is the escape character.
ESCAPES = {"\\": "\\0", "<": "\\1", "[": "\\2", ">": "\\3"}


@dataclass(frozen=True)
class Turn:
    """How a role's turn is marked, and whether its text counts for the loss. Both marks begin with `<` or `[`."""

    opening: str
    closing: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """Marks of the known roles; other roles are written as <role=NAME>. `moves` are the allowed steps of the role machine."""

    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("<<SYS>>", "<</SYS>>", False), "user": Turn("[INST]", "[/INST]", False), "assistant": Turn("<s>", "</s>", True),
    })
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })
    accepted: tuple[str, ...] = ("answered",)


def escape(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), ESCAPES.items(), text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), reversed(ESCAPES.items()), text)


def _by_role(template: Template, role: Column, part, other: Column) -> Column:
    for name, turn in template.turns.items():
        other = F.when(role == name, part(turn)).otherwise(other)
    return other


def _machine(template: Template, turns: Column) -> Column:
    """struct(state, wrong): the state after all turns, and the place of the first turn that no move allows, or NULL."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state} {role}", to)])

    def step(at: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(at["state"], F.lit(" "), turn["role"]))
        return F.struct(
            F.coalesce(to, F.lit("wrong")).alias("state"), (at["n"] + 1).alias("n"),
            F.coalesce(at["wrong"], F.when(to.isNull(), at["n"])).alias("wrong"),
        )

    return F.aggregate(turns, F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("wrong")), step)


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, valid, wrong_turn, segments, formatted), one row for each conversation.

    Of `rows` only (conv_id, turn, role, text) are read. Turns are ordered by (turn, role, text), so ties and repeated rows
    have one order; a null role or text counts as empty and a null turn comes first. `segments` are (text, loss) in order and
    `formatted` is their concatenation; one conversation is one row, so its turns meet in one task. A conversation whose roles break the order is formatted all the same, with `valid` false.
    """
    template = template or Template()
    empty = F.lit("")
    turns = rows.select("conv_id", F.struct(
        F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    ).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def marks(turn: Column) -> Column:
        role = turn["role"]
        opening = _by_role(template, role, lambda t: F.lit(t.opening), F.concat(F.lit("<role="), escape(role), F.lit(">")))
        closing = _by_role(template, role, lambda t: F.lit(t.closing), F.lit("</role>"))
        loss = _by_role(template, role, lambda t: F.lit(t.loss), F.lit(False))
        off = F.lit(False)
        return F.array(
            F.struct(opening.alias("text"), off.alias("loss")), F.struct(escape(turn["text"]).alias("text"), loss.alias("loss")),
            F.struct(closing.alias("text"), off.alias("loss")),
        )

    walked = turns.withColumn("m", _machine(template, F.col("turns"))).withColumn("segments", F.flatten(F.transform("turns", marks)))
    return walked.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.col("m.state").isin(*template.accepted).alias("valid"),
        F.col("m.wrong").alias("wrong_turn"), "segments", F.array_join("segments.text", "").alias("formatted"),
    )


def read_chats(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text, loss>> read back from a formatted conversation."""
    template = template or Template()
    openings = "|".join([*("\\Q" + t.opening + "\\E" for t in template.turns.values()), "<role=[^<\\[>]*>"])

    def turn(part: Column) -> Column:
        other = F.regexp_extract(part, "^<role=([^>]*)>", 1)
        role, body = unescape(other), F.substr(part, F.length(other) + F.lit(8))
        loss = F.lit(False)
        for name, t in template.turns.items():
            here = part.startswith(t.opening)
            role = F.when(here, F.lit(name)).otherwise(role)
            body = F.when(here, F.substr(part, F.lit(len(t.opening) + 1))).otherwise(body)
            loss = F.when(here, F.lit(t.loss)).otherwise(loss)
        return F.struct(role.alias("role"), unescape(body).alias("text"), loss.alias("loss"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(f"(?:{openings})[^<\\[]*"), F.lit(0)), turn)


def chat_digests(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of what is read back from `formatted`."""
    read = chats.select("conv_id", "valid", "formatted", read_chats(F.col("formatted"), template).alias("t"))
    turns = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform(F.filter("t", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id", F.size("t").cast("bigint").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(lost).cast("bigint").alias("loss_chars"), F.sha2(lost.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid",
    )
