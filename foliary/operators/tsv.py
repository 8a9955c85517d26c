"""Serialization of tables: one line per row, one field per column."""

from __future__ import annotations

import re
from collections.abc import Sequence

_cuts = re.compile(r"[\r\n\t]+")
_word = re.compile(r"[0-9A-Za-z]")


def flatten(value: str) -> str:
    """A cell's text on one line; pieces are joined with a space only between ASCII words or numbers."""
    out = ""
    for part in filter(None, (p.strip() for p in _cuts.split(value or ""))):
        out += (" " if out and _word.match(out[-1]) and _word.match(part[0]) else "") + part
    return out


def table_tsv(rows: Sequence[Sequence[tuple[int, int, str]]]) -> str:
    """rows of (column, span, text). A cell whose place is taken goes to the next free one; spanned places stay empty;
    what finds no place is dropped with the rest of its row."""
    width = max((max(len(r), *(c + max(s, 1) for c, s, _ in r)) for r in rows if r), default=0)
    if not width:
        return ""
    lines = []
    for row in rows:
        values, taken = [""] * width, [False] * width
        for column, span, text in row:
            if not 0 <= column < width or taken[column]:
                column = next((i for i in range(width) if not taken[i]), width)
            if column >= width:
                break
            values[column] = flatten(text)
            end = min(width, column + max(span, 1))
            taken[column:end] = [True] * (end - column)
        lines.append("\t".join(values))
    return "\n".join(lines)
