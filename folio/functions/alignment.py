"""Alignment of two sequences by their longest common blocks, and positions carried over it.

The longest common block comes first, of equal ones the earliest in the old sequence, then in the new one; what is left and
right of it is aligned the same way. Nothing is treated as noise, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher


def operations(old: Sequence, new: Sequence) -> list[tuple[str, int, int, int, int]]:
    """`equal`, `replace`, `delete` and `insert` with half-open ranges of both sequences, in order."""
    if old == new:
        return [("equal", 0, len(old), 0, len(new))] if len(old) else []
    return SequenceMatcher(None, old, new, autojunk=False).get_opcodes()


def carried(operations: list[tuple[str, int, int, int, int]], size: int, at: int, right: bool) -> int:
    """Where a border before element `at` of the old sequence is in the new one, of `size` elements.

    A border inside a change goes to its left or its right end; one at the beginning of an operation goes to the
    beginning of the first such operation, so what was inserted there lies behind it.
    """
    for tag, a, b, c, d in operations:
        if a <= at < b or a == b == at:
            if at == a:
                return c
            return c + at - a if tag == "equal" else d if right else c
    return size


def kept_at(old: str, new: str, low: int, high: int) -> int | None:
    """Where the characters from `low` to `high` stand in the new text, if one common block holds them all."""
    for tag, a, b, c, _ in operations(old, new):
        if tag == "equal" and a <= low and high <= b:
            return c + low - a
    return None
