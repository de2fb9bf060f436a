"""Chat formatting: a finite-state machine over roles and segments with loss flags from a declarative template.

DataFrame functions only. ``format_chats`` gives one row a conversation: ``segments`` (array of text and loss, whose
texts joined are the training text), ``n_turns``, ``state`` (where the machine ends; ``invalid`` once an order is not
allowed) and ``valid``. ``read_back`` recovers the turns from the joined text alone and the learnt text from the segments.

Control strings inside texts are escaped: after the first character of every control string, however many backslashes
stand there already, one backslash is put in; reading takes one out. Both are exact inverses, and no escaped text
holds a control string.

Null text or role counts as empty. A null conversation id is a conversation of its own; null turns come first. Rows that
share a turn go by role, then text; repeated rows stay. Roles that the template lacks are written with their name and end
in the state ``invalid``; they bear no loss. A conversation is one row of the result, so it is gathered in one place;
nothing else is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import plain


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of turns, and the allowed order: from a state (the last role, or ``start``) to roles."""

    start: str = "<s>"
    turns: dict[str, Turn] = field(
        default_factory=lambda: {"system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("[ANS]", "</s>", loss=True)}
    )
    #: Any other role: open, role, middle, text, close.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    @property
    def controls(self) -> list[str]:
        marks = {self.start, *self.other, *(m for t in self.turns.values() for m in (t.open, t.close))}
        if any(len(m) < 2 or "\\" in m or m[0] in m[1:] for m in marks):
            raise ValueError("marks need two characters or more, no backslash, and their first character only once")
        return sorted(marks)


TEMPLATE = Template()


def _rest(template: Template) -> tuple[str, str]:
    """A class of first characters and a pattern of what follows them in control strings."""
    firsts = "[" + "".join(sorted({re.escape(c[0]) for c in template.controls})) + "]"
    if any(a[0] in b[1:] for a in template.controls for b in template.controls):
        raise ValueError("no control string may hold the first character of another one")
    # a first character counts only before the rest of a control string of its own; a superset of these is as reversible
    return firsts, "(?:" + "|".join(sorted({re.escape(c[1:]) for c in template.controls})) + ")"


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    firsts, rest = _rest(template)
    return F.regexp_replace(text, rf"({firsts})(\\*)(?={rest})", r"$1\\$2")


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    firsts, rest = _rest(template)
    return F.regexp_replace(text, rf"({firsts})\\(\\*)(?={rest})", r"$1$2")


def _machine(roles: Column, template: Template) -> Column:
    """The state after all roles."""
    moves = F.create_map(*(F.lit(x) for state, roles in template.order.items() for role in roles for x in (f"{state}>{role}", role)))
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(">"), role)), F.lit("invalid")))


def format_chats(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, template: Template = TEMPLATE) -> DataFrame:
    """One row a conversation: the id, ``segments``, ``n_turns``, ``state``, ``valid``."""
    rows = df.select(
        F.col(plain(conv_col)),
        F.struct(
            F.col(plain(turn_col)).alias("turn"), F.coalesce(F.col(plain(role_col)), F.lit("")).alias("role"), F.coalesce(F.col(plain(text_col)), F.lit("")).alias("text")
        ).alias("__turn"),
    )
    chats = rows.groupBy(plain(conv_col)).agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))

    def segment(text: Column, loss: bool = False) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def turn(t: Column) -> Column:
        text = escape(t["text"], template)
        made = F.array(*(segment(x) for x in (F.lit(template.other[0]), escape(t["role"], template), F.lit(template.other[1]), text, F.lit(template.other[2]))))
        for role, marks in template.turns.items():
            made = F.when(t["role"] == role, F.array(segment(F.lit(marks.open)), segment(text, marks.loss), segment(F.lit(marks.close)))).otherwise(made)
        return made

    state = _machine(F.transform("__turns", lambda t: t["role"]), template)
    return chats.select(
        plain(conv_col),
        F.concat(F.array(segment(F.lit(template.start))), F.flatten(F.transform("__turns", turn))).alias("segments"),
        F.size("__turns").cast("long").alias("n_turns"), state.alias("state"),
    ).withColumn("valid", F.col("state") != "invalid")


def formatted(segments: Column) -> Column:
    """The training text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learnt(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped text by text, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def read_back(text: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted text."""
    q = re.escape
    known = "|".join(f"{q(t.open)}.*?{q(t.close)}" for t in template.turns.values())
    other = ".*?".join(map(q, template.other))
    turns = F.regexp_extract_all(text, F.lit(f"(?s)({known}|{other})"), F.lit(1))

    def parse(t: Column) -> Column:
        a, b, c = template.other
        inner = F.regexp_replace(F.regexp_replace(t, "^" + q(a), ""), q(c) + "$", "")
        made = F.struct(
            unescape(F.substring_index(inner, b, 1), template).alias("role"), unescape(F.regexp_replace(inner, f"(?s)^.*?{q(b)}", ""), template).alias("text")
        )
        for role, marks in template.turns.items():
            body = F.substr(t, F.lit(len(marks.open) + 1), F.length(t) - len(marks.open) - len(marks.close))
            made = F.when(F.startswith(t, F.lit(marks.open)), F.struct(F.lit(role).alias("role"), unescape(body, template).alias("text"))).otherwise(made)
        return made

    return F.transform(turns, parse)
