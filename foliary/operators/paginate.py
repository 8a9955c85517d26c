"""Layout estimate: paragraphs to lines, lines to pages.

Two folds over ordered rows: characters of a paragraph fill lines of the usable width, and lines fill pages until the
usable height (or the share of a known page count) is used up.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from ..formats.common import cell, page, rect, union

_wide = re.compile("[⺀-⻳⼀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿぀-ゟ゠-ヿㇰ-ㇿｦ-ﾟ가-힣ᄀ-ᇿ㄰-㆏\U00020000-\U0003ffff]")


@dataclass
class Paragraph:
    runs: list[dict] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    before: float = 0.0
    after: float = 0.0
    line_height: float = 0.0
    break_before: bool = False
    break_after: bool = False
    table: int = 0
    row: int = 0
    column: int = 0
    row_span: int = 1
    col_span: int = 1
    separator: str = ""


@dataclass
class Options:
    width: float = 0.0
    height: float = 0.0
    top: float = 0.0
    right: float = 0.0
    bottom: float = 0.0
    left: float = 0.0
    target_pages: int = 0

    def filled(self) -> Options:
        """A4 and margins of an inch where nothing is given; a margin of 0 counts as not given."""
        m = [v if v > 0 else 72.0 for v in (self.top, self.right, self.bottom, self.left)]
        return Options(self.width if self.width > 0 else 595.28, self.height if self.height > 0 else 841.89, *m, self.target_pages)


@dataclass
class Line:
    source: Paragraph | None = None
    runs: list[dict] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    height: float = 0.0
    separator: str = ""
    break_before: bool = False
    break_after: bool = False

    def filled(self) -> bool:
        return bool(self.images) or any(r["text"].strip() for r in self.runs)


def char_width(c: str, size: float) -> float:
    if c == "\t":
        return size * 2
    if c.isspace():
        return size * 0.5
    if c < "\x80":
        return size * 0.55
    return size if _wide.match(c) else size * 0.8


def append_run(runs: list[dict], r: dict) -> None:
    """Joins a run to the one before if style and place continue it."""
    if not r["text"]:
        return
    if runs:
        p = runs[-1]
        a, b = p["bounds"], r["bounds"]
        if (p["font"], p["size"], p["color"]) == (r["font"], r["size"], r["color"]) and abs(a["y"] - b["y"]) < 0.01 and abs(a["x"] + a["width"] - b["x"]) < 0.01:
            p["text"] += r["text"]
            a["width"] += b["width"]
            a["height"] = max(a["height"], b["height"])
            return
    runs.append(r)


def lines_of(paragraphs: list[Paragraph], width: float) -> list[Line]:
    out: list[Line] = []
    for p in paragraphs:
        first = len(out)
        if p.before > 0:
            out.append(Line(height=p.before))
        here, x = Line(p), 0.0
        usual = p.line_height if p.line_height > 0 else 1.25 * max([11.0, *(r["size"] for r in p.runs)])

        def end(here: Line = None, usual: float = usual) -> None:
            here.height = here.height if here.height > 0 else usual
            out.append(here)

        for r in p.runs:
            size = r["size"] if r["size"] > 0 else 11.0
            tall = max(size * 1.25, p.line_height)
            for c in r["text"]:
                if c in "\r\n":
                    end(here)
                    here, x = Line(p), 0.0
                    continue
                w = char_width(c, size)
                if x > 0 and x + w > width:
                    end(here)
                    here, x = Line(p), 0.0
                append_run(here.runs, {**r, "size": size, "text": c, "bounds": rect(x, 0, w, size)})
                x += w
                here.height = max(here.height, tall)
        if here.runs or not p.runs:
            end(here)
        for im in p.images:
            w = im["bounds"]["width"] if im["bounds"]["width"] > 0 else im["width"] * 0.75
            h = im["bounds"]["height"] if im["bounds"]["height"] > 0 else im["height"] * 0.75
            if w > width > 0:
                w, h = width, h * width / w
            out.append(Line(p, images=[{**im, "bounds": rect(0, im["bounds"]["y"], w, h)}], height=max(h, 1.0)))
        content = len(out) - 1
        if p.after > 0:
            out.append(Line(height=p.after))
        if p.separator and content >= first:
            out[content].separator = p.separator
        if p.break_after:
            if not out:
                out.append(Line(height=1.0))
            out[-1].break_after = True
        if p.break_before and first < len(out):
            out[first].break_before = True
    return out


def _into_table(pg: dict, state: dict, line: Line, runs: list[dict]) -> None:
    s = line.source
    key = (pg["number"], s.table)
    if key not in state:
        pg["tables"].append({"bounds": rect(), "rows": []})
        state[key] = (pg["tables"][-1], {})
    table, rows = state[key]
    if s.row not in rows:
        rows[s.row] = {"cells": []}
        table["rows"].append(rows[s.row])
    cells = rows[s.row]["cells"]
    c = next((c for c in cells if c["column"] == s.column), None)
    if c is None:
        c = cell(s.row, s.column, "", max(s.row_span, 1), max(s.col_span, 1))
        cells.append(c)
    if runs:
        c["text"] += ("\n" if c["text"] else "") + "".join(r["text"] for r in runs)
        for r in runs:
            c["bounds"], table["bounds"] = union(c["bounds"], r["bounds"]), union(table["bounds"], r["bounds"])
        c["runs"] += runs


def paginate(paragraphs: list[Paragraph], options: Options | None = None) -> list[dict]:
    """Pages of the paragraphs. With target_pages the content is shared out evenly; a target of one page is ignored
    when the content is more than one and a half pages."""
    o = (options or Options()).filled()
    lines = lines_of(paragraphs, o.width - o.left - o.right)
    if not lines:
        return [page(1, o.width, o.height)]
    usable, total, target = o.height - o.top - o.bottom, math.fsum(x.height for x in lines), o.target_pages
    if target == 1 and total > usable * 1.5:
        target = 0
    if target > 0 and total > 0:
        usable = total / target
    hard = [a.break_after or b.break_before for a, b in zip(lines, lines[1:])] + [False]
    left, pages, state = sum(hard), [page(1, o.width, o.height)], {}
    y, used, bound = 0.0, 0.0, usable
    fresh = lambda: pages.append(page(len(pages) + 1, o.width, o.height))
    for i, line in enumerate(lines):
        pg = pages[-1]
        if target > 0:
            turn = len(pages) + left < target and line.filled() and bool(pg["images"] or pg["text"].strip()) and used + line.height > bound
        else:
            turn = bool(pg["runs"] or pg["images"]) and y + line.height > usable
        if turn:
            fresh()
            pg, y = pages[-1], 0.0
            bound = usable * len(pages) if target > 0 else bound
        placed = [{**r, "bounds": {**r["bounds"], "y": o.top + y}} for r in line.runs]
        for r in placed:
            append_run(pg["runs"], {**r, "bounds": dict(r["bounds"])})
        pg["text"] += "".join(r["text"] for r in placed)
        pg["images"] += [{**im, "bounds": {**im["bounds"], "y": o.top + y}} for im in line.images]
        table = line.source.table if line.source else 0
        if table > 0:
            _into_table(pg, state, line, placed)
        if line.separator and not line.break_after:
            pg["text"] += line.separator
        elif not table and line.runs and i + 1 < len(lines) and not line.break_after:
            pg["text"] += "\n"
        y += line.height
        used += line.height
        if hard[i]:
            left -= 1
            fresh()
            y = 0.0
            bound = usable * len(pages) if target > 0 else bound
    for pg in pages:
        pg["text"] = pg["text"].strip(" \r\n")
    return pages
