"""Chat formatting by a declarative template and a finite-state machine over roles.

A `Template` says how a turn is marked, which roles carry loss, which strings are control
strings, and which role may follow in which state. Everything is DataFrame functions: turns
are ordered within their conversation, the machine is a fold over the roles, and the text
is emitted as segments with a loss flag each. Control strings inside texts and roles are
escaped with one escape character, so that the output can be read back without loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is `open` role `middle` text `close`. The first control string must be `close`."""

    open: str = "<|"
    middle: str = "|>"
    close: str = "</s>"
    escape: str = "␛"
    also_control: tuple[str, ...] = ("[INST]", "[/INST]", "<s>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("start", "user", "assistant")
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def codes(self) -> list[tuple[str, str]]:
        """(string, what stands for it): the escape character first, so that what follows it is never text."""
        strings = (self.escape, self.close, self.open, self.middle, *self.also_control)
        if len(strings) > 36 or len(set(strings)) < len(strings) or any(self.escape in s for s in strings[1:]):
            raise ValueError("control strings must be few, distinct and free of the escape character")
        return [(s, self.escape + "0123456789abcdefghijklmnopqrstuvwxyz"[i]) for i, s in enumerate(strings)]


def escaped(col: Column, t: Template) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), t.codes(), col)


def unescaped(col: Column, t: Template) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), reversed(t.codes()), col)


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, formatted, segments, state, valid), one row for each conversation.

    rows: conv_id, turn, role, text; other columns are ignored. Turns go by `turn`, nulls
    first, ties by role and text; repeated rows stay turns of their own. A null role or text is empty. A
    null conv_id is a conversation. `segments` is the output in order, as (kind, text, loss)
    where `formatted` is their concatenation. `valid` says whether the machine took every turn
    and ended in a final state; `state` is where it ended, or "invalid". Conversations that
    aren't valid are formatted all the same.
    """
    t = template or Template()
    none = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = rows.select("conv_id", F.struct(F.col("turn"), none.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("x"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    arcs = F.create_map(*[F.lit(y) for (s, r), to in t.moves.items() for y in (f"{s}\n{r}", to)])
    # no state holds a line break, so a role can't forge a key
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.element_at(arcs, F.concat(s, F.lit("\n"), x["role"])), F.lit("invalid")))
    loss = lambda x: x["role"].isin(*t.loss_roles)
    seg = lambda kind, text, flag: F.struct(F.lit(kind).alias("kind"), text.alias("text"), flag.alias("loss"))
    no = F.lit(False)
    parts = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                seg("control", F.concat(F.lit(t.open), escaped(x["role"], t), F.lit(t.middle)), no),
                seg("text", escaped(x["text"], t), loss(x)),
                seg("control", F.lit(t.close), no),
            ),
        )
    )
    out = chats.select("conv_id", parts.alias("segments"), state.alias("state"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "state", F.col("state").isin(*t.final).alias("valid"))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted conversation, from its text alone."""
    t = template or Template()
    marked = F.split(formatted, f"\\Q{t.close}\\E", -1)
    marked = F.slice(marked, F.lit(1), F.size(marked) - 1)

    def turn(x: Column) -> Column:
        # what comes before the first `middle`, looked for behind `open`
        body = F.substr(x, F.lit(len(t.open) + 1))
        cut = F.instr(body, F.lit(t.middle))
        return F.struct(
            unescaped(F.substr(body, F.lit(1), cut - 1), t).alias("role"),
            unescaped(F.substr(body, cut + F.lit(len(t.middle))), t).alias("text"),
        )

    return F.transform(marked, turn)


def chat_digest(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from what `format_chats` emits."""
    t = template or Template()
    out = format_chats(rows, t)
    lost = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
    out = out.select("conv_id", read_back(F.col("formatted"), t).alias("turns"), lost.alias("lost"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        "formatted_chars",
    )
