"""Tables from ruled lines: segments to rules, rules to candidate cells, cells to connected grids, text to cells."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..formats.common import cell, rect, run, union
from .tsv import table_tsv

MOST_RULES, MOST_LEVELS, MOST_CELLS = 10_000, 512, 4096


@dataclass
class Style:
    """What differs between page formats."""

    tolerance: float = 3.0
    averaging: bool = True
    least_height: float = 5.0
    least_width: float = 5.0
    infer_borders: bool = True
    ascending: bool = False  # y grows downwards
    first_cell: bool = False  # a run goes to the first cell that holds the place near its left end
    text_of: Callable[[list[dict]], str] = field(default=lambda runs: "".join(r["text"] for r in runs))


def classify(segment: tuple[float, float, float, float], tolerance: float) -> tuple[str, float, float, float] | None:
    """(orientation, coordinate, from, to) of a segment that is straight and at least 4 long, else None."""
    x1, y1, x2, y2 = segment
    dx, dy = abs(x2 - x1), abs(y2 - y1)
    if dy <= tolerance and dx >= 4:
        return "h", (y1 + y2) / 2, min(x1, x2), max(x1, x2)
    if dx <= tolerance and dy >= 4:
        return "v", (x1 + x2) / 2, min(y1, y2), max(y1, y2)
    return None


def merge_rules(rules: list[tuple[float, float, float]], style: Style) -> list[list[float]]:
    """Joins collinear rules that touch: [coordinate, from, to]."""
    out: list[list[float]] = []
    for c, a, b in sorted(rules):
        near = next((r for r in out if abs(r[0] - c) <= style.tolerance and a <= r[2] + style.tolerance and b >= r[1] - style.tolerance), None)
        if near is None:
            out.append([c, a, b])
        else:
            near[0] = (near[0] + c) / 2 if style.averaging else near[0]
            near[1], near[2] = min(near[1], a), max(near[2], b)
    return out


def levels(values: list[float], style: Style) -> list[float]:
    """Distinct coordinates up to the tolerance, ascending."""
    out: list[float] = []
    for v in sorted(values):
        if out and abs(out[-1] - v) <= style.tolerance:
            out[-1] = (out[-1] + v) / 2 if style.averaging else out[-1]
        else:
            out.append(v)
    return out


def nearest(lines: list[float], value: float) -> int:
    """Index of the closest line; of equals the lower."""
    return min(range(len(lines)), key=lambda i: (abs(lines[i] - value), i))


def candidate_cells(horizontal: list[list[float]], vertical: list[list[float]], style: Style) -> list[tuple[float, float, float, float]]:
    """(left, low, right, high) between two levels that rules close on all sides and no rule divides."""
    t = style.tolerance
    ys = levels([h[0] for h in horizontal], style)
    if len(ys) > MOST_LEVELS or len(horizontal) + len(vertical) > MOST_RULES:
        return []
    covers = lambda y, a, b: any(abs(h[0] - y) <= t and h[1] <= a + t and h[2] >= b - t for h in horizontal)
    out: list[tuple[float, float, float, float]] = []
    for i, low in enumerate(ys):
        for high in ys[i + 1 :]:
            if high - low < style.least_height:
                continue
            xs = levels([v[0] for v in vertical if v[1] <= low + t and v[2] >= high - t], style)
            if style.infer_borders and xs:
                both = [h for h in horizontal if abs(h[0] - low) <= t and h[1] <= xs[0] + t and h[2] >= xs[-1] - t]
                if both:
                    widest = max(both, key=lambda h: h[2] - h[1])
                    for x in widest[1:]:
                        if covers(high, min(x, xs[0]), max(x, xs[-1])) and all(abs(x - v) > t for v in xs):
                            xs = sorted([*xs, x])
            for left, right in zip(xs, xs[1:]):
                if right - left < style.least_width or not (covers(low, left, right) and covers(high, left, right)):
                    continue
                if any(low + t < h[0] < high - t and h[1] <= left + t and h[2] >= right - t for h in horizontal):
                    continue
                out.append((left, low, right, high))
                if len(out) > MOST_CELLS:
                    return []
    return out


def touching(a: tuple, b: tuple, t: float) -> bool:
    """Whether two cells share a border or a part of one."""
    across = (abs(a[2] - b[0]) <= t or abs(b[2] - a[0]) <= t) and min(a[3], b[3]) - max(a[1], b[1]) > -t
    along = (abs(a[3] - b[1]) <= t or abs(b[3] - a[1]) <= t) and min(a[2], b[2]) - max(a[0], b[0]) > -t
    return across or along


def connected(cells: list[tuple], t: float) -> list[list[tuple]]:
    groups, left = [], list(range(len(cells)))
    while left:
        queue, group = [left.pop(0)], []
        while queue:
            i = queue.pop()
            group.append(i)
            near = [j for j in left if touching(cells[i], cells[j], t)]
            queue += near
            left = [j for j in left if j not in near]
        groups.append([cells[i] for i in sorted(group)])
    return groups


def _score(b: dict, c: tuple) -> float:
    """How much of a run lies in a cell; a run whose centre lies inside counts more than one that only overlaps."""
    x, y = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2
    inside = c[0] <= x <= c[2] and c[1] <= y <= c[3]
    w, h = min(b["x"] + b["width"], c[2]) - max(b["x"], c[0]), min(b["y"] + b["height"], c[3]) - max(b["y"], c[1])
    area = max(0.0, w) * max(0.0, h) / max(1e-9, b["width"] * b["height"])
    return area + (1.0 if inside else 0.0)


def build(cells: list[tuple], runs: list[dict], style: Style) -> tuple[dict, set[int]]:
    """Table of a connected grid and the indexes of the runs in it. Rows follow the page's reading direction."""
    t = style.tolerance
    xs = levels([x for c in cells for x in (c[0], c[2])], style)
    place: dict[int, int] = {}
    by_row = sorted(range(len(cells)), key=lambda k: (cells[k][1], cells[k][0]))
    for i, r in enumerate(runs):
        if not r["text"]:
            continue
        if style.first_cell:
            b = r["bounds"]
            x, y = b["x"] + min(b["width"] / 2, max(r["size"] * 0.2, 1)), b["y"] + b["height"] / 2
            holds = (k for k in by_row if cells[k][0] - t <= x <= cells[k][2] + t and cells[k][1] - t <= y <= cells[k][3] + t)
            if (k := next(holds, None)) is not None:
                place[i] = k
            continue
        scores = [_score(r["bounds"], c) for c in cells]
        k = max(range(len(cells)), key=lambda k: (scores[k], -k))
        if scores[k] > 0.25:
            place[i] = k
    upward = not style.ascending
    if upward and place:
        # a page may be written from its foot: the first and last text inside decide
        first, last = (runs[f(place)]["bounds"]["y"] for f in (min, max))
        upward = first >= last
    edge = (lambda c: -c[3]) if upward else (lambda c: c[1])
    rows: list[list[int]] = []
    for k in sorted(range(len(cells)), key=lambda k: (edge(cells[k]), cells[k][0])):
        if rows and abs(edge(cells[rows[-1][0]]) - edge(cells[k])) <= t:
            rows[-1].append(k)
        else:
            rows.append([k])
    edges = [edge(cells[r[0]]) for r in rows]
    out, bounds = [], rect()
    for i, row in enumerate(rows):
        made = []
        for k in sorted(row, key=lambda k: cells[k][0]):
            c = cells[k]
            a, b = nearest(xs, c[0]), nearest(xs, c[2])
            foot = -c[1] if upward else c[3]
            down = max(1, sum(1 for e in edges if edge(c) - t < e < foot - t))
            own = [runs[j] for j in sorted(place) if place[j] == k]
            box = rect(c[0], c[1], c[2] - c[0], c[3] - c[1])
            made.append(cell(i, a, style.text_of(own), down, max(1, b - a), box, own))
            bounds = union(bounds, box)
        out.append({"cells": made})
    return {"bounds": bounds, "rows": out}, set(place)


def detect(runs: list[dict], segments: list[tuple[float, float, float, float]], style: Style) -> tuple[list[dict], list[set[int]]]:
    """Tables of a page and, for each, the indexes of its runs. A grid needs two cells and two rows or columns."""
    rules = [r for s in segments if (r := classify(s, style.tolerance))]
    if len(rules) > MOST_RULES:
        return [], []
    sides = {k: merge_rules([r[1:] for r in rules if r[0] == k], style) for k in "hv"}
    tables, inside = [], []
    for group in connected(candidate_cells(sides["h"], sides["v"], style), style.tolerance):
        if len(group) < 2:
            continue
        table, own = build(group, runs, style)
        if len(table["rows"]) >= 2 or max(len(r["cells"]) for r in table["rows"]) >= 2:
            tables.append(table)
            inside.append(own)
    return tables, inside


def tsv_of(table: dict) -> str:
    return table_tsv([[(c["column"], c["col_span"], c["text"]) for c in r["cells"]] for r in table["rows"]])


def page_text(runs: list[dict], tables: list[dict], inside: list[set[int]], text_of: Callable[[list[dict]], str]) -> str:
    """Text in run order; each table stands once, where its first run is."""
    owner = {i: k for k, own in enumerate(inside) for i in own}
    parts, plain, seen = [], [], set()

    def flush() -> None:
        text = text_of(plain)
        if text:
            parts.append(text)
        plain.clear()

    for i, r in enumerate(runs):
        k = owner.get(i)
        if k is None:
            plain.append(r)
        elif k not in seen:
            flush()
            parts.append(tsv_of(tables[k]))
            seen.add(k)
    flush()
    parts += [t for k, table in enumerate(tables) if k not in seen and (t := tsv_of(table)).strip()]
    return "\n".join(parts).strip(" \r\n")


def lines_by_gap(runs: list[dict]) -> str:
    """Text of runs in stream order: a line ends where the baseline moves by more than 0.55 of the size, a space stands
    where the gap exceeds 0.2 of it."""
    out, prev = "", None
    for r in runs:
        if not r["text"]:
            continue
        if prev is not None:
            a, b = prev["bounds"], r["bounds"]
            if abs(b["y"] - a["y"]) > 0.55 * max(prev["size"], r["size"]):
                out += "\n"
            elif b["x"] - (a["x"] + a["width"]) > 0.2 * max(prev["size"], r["size"]):
                out += " "
        out += r["text"]
        prev = r
    return out.strip(" \r\n")


def lines_by_anchor(runs: list[dict]) -> str:
    """Text of runs sorted by place: a run joins the line whose first run is at most 0.55 of its size (at least 2)
    away; nothing is put between runs."""
    lines: list[str] = []
    start = None
    for r in sorted(runs, key=lambda r: (r["bounds"]["y"], r["bounds"]["x"])):
        y, size = r["bounds"]["y"], r["size"] if r["size"] > 0 else 10.0
        if start is None or (lines[-1] and abs(y - start) > max(2.0, size * 0.55)):
            lines.append("")
        if not lines[-1]:
            start = y
        lines[-1] += r["text"]
    return "\n".join(x for x in lines if x)


__all__ = ["Style", "build", "candidate_cells", "classify", "connected", "detect", "levels", "lines_by_anchor", "lines_by_gap", "merge_rules", "nearest", "page_text", "run", "tsv_of"]
