"""Chat formatting: one training text per conversation, with a loss mask, from relational expressions only.

Turns are collected as structs and sorted; adjacent turns of one role become one turn of several parts; the pieces are
put between control strings. Control strings that occur in a text or role are escaped, so the result can be read back
exactly, and no tokenizer can take them for control.

Order: turn (null first), then role, then text; repeated rows stay. Null texts and roles count as empty. A null
conversation id is a conversation of its own. Other columns of the input are left out. A conversation is one value of
the result, so it has to fit into a task; the work on its texts is done before they are collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Control strings of a turn, and strings that other templates and tokenizers use for control."""

    turn: str = "<|turn|>"
    says: str = "<|says|>"
    also: str = "<|also|>"
    end: str = "<|end|>"
    learned_role: str = "assistant"
    protected: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
                                  "<|startoftext|>", "<unk>")

    def __post_init__(self):
        every = self.controls
        for a in every:
            if len(a) < 2 or ESCAPE in a:
                raise ValueError(f"a control string needs two characters or more and no {ESCAPE}: {a!r}")
            for b in every:
                if a != b and a in b or any(a.endswith(b[:n]) for n in range(1, len(b)) if n < len(a)):
                    raise ValueError(f"control strings may not overlap: {a!r}, {b!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.turn, self.says, self.also, self.end, *self.protected)))


def escaped(text: Column, template: Template) -> Column:
    """Backslashes doubled, then one backslash behind the first character of each control string."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in template.controls:
        out = F.replace(out, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    """Of two backslashes one stays; a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """`conv_id`, `turn`, `role`, `text` → `conv_id`, `formatted`, `segments`.

    The segments make up the formatted text; `learned` marks those under the loss mask: each text of the learned role.
    """
    def clean(name: str) -> Column:
        return escaped(F.coalesce(F.col(name), F.lit("")), template)

    rows = conversations.select("conv_id", F.struct("turn", clean("role").alias("role"), clean("text").alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, F.greatest(i - 1, F.lit(0)))["role"]))
        return bound(starts, lambda s: F.transform(s, lambda at, k: F.struct(
            F.get(t, at)["role"].alias("role"),
            F.transform(F.slice(t, at + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - at), lambda x: x["text"]).alias("parts"))))

    def piece(text: Column, learned: Column) -> Column:
        return F.struct(text.alias("chunk"), learned.alias("learned"))

    def pieces(run: Column) -> Column:
        learned, no = run["role"] == F.lit(template.learned_role), F.lit(False)
        parts = F.flatten(F.transform(run["parts"], lambda p, i: F.when(i == 0, F.array(piece(p, learned))).otherwise(
            F.array(piece(F.lit(template.also), no), piece(p, learned)))))
        return F.concat(F.array(piece(F.concat(F.lit(template.turn), run["role"], F.lit(template.says)), no)), parts,
                        F.array(piece(F.lit(template.end), no)))

    segments = bound(F.col("turns"), lambda t: bound(runs(t), lambda r: F.flatten(F.transform(r, pieces))))
    return turns.select("conv_id", segments.alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["chunk"]), "").alias("formatted"), "segments")


def _literal(control: str) -> str:
    return r"\Q" + control + r"\E"


def read_turns(text: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text, as an array of (role, text); merged turns are told apart again."""
    def of(one: Column) -> Column:
        sides = F.split(one, _literal(template.says), 2)
        return bound(sides, lambda s: F.transform(F.split(s[1], _literal(template.also), -1), lambda part: F.struct(
            unescaped(F.substring(s[0], F.lit(len(template.turn) + 1), F.length(s[0]))).alias("role"), unescaped(part).alias("text"))))

    turns = F.split(text, _literal(template.end), -1)
    return F.flatten(F.transform(bound(turns, lambda t: F.slice(t, F.lit(1), F.size(t) - 1)), of))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["learned"]), lambda s: unescaped(s["chunk"])), "")
