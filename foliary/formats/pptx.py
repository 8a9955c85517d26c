"""Presentations in the XML format: one page per slide; shapes, then tables and frames, then pictures."""

from __future__ import annotations

import posixpath
from itertools import accumulate
from xml.etree.ElementTree import Element

from ..operators.tsv import table_tsv
from .common import FormatError, add_line, archive, attr, cell, child, children, document, find, image, integer, local, number, page, rect, relationships, run, xml

EMU = 12700


def _emu(text: str) -> float:
    return number(text) / EMU


def _bounds(n: Element) -> dict:
    off, ext = (find(n, k)[:1] for k in ("off", "ext"))
    o, e = (off[0] if off else None), next((x for x in find(n, "ext") if attr(x, "cx")), ext[0] if ext else None)
    return rect(_emu(attr(o, "x")) if o is not None else 0, _emu(attr(o, "y")) if o is not None else 0, _emu(attr(e, "cx")) if e is not None else 0, _emu(attr(e, "cy")) if e is not None else 0)


def _style(n: Element) -> dict:
    props = child(n, "rPr")
    out = {"font": "", "size": 18.0, "color": "#000000"}
    if props is not None:
        out["size"] = number(attr(props, "sz"), 1800) / 100 if attr(props, "sz") else 18.0
        out["font"] = next((attr(f, "typeface") for k in ("latin", "ea") for f in find(props, k) if attr(f, "typeface")), "")
        out["color"] = next(("#" + attr(c, "val").upper() for c in find(props, "srgbClr") if attr(c, "val")), "#000000")
    return out


def _texts(container: Element, bounds: dict) -> tuple[str, list[dict]]:
    lines, runs = [], []
    for p in find(container, "p"):
        line = ""
        for r in p:
            if local(r.tag) in ("r", "fld"):
                value = "".join(t.text or "" for t in find(r, "t"))
                if value:
                    runs.append(run(value, dict(bounds), **_style(r)))
                    line += value
        if line:
            lines.append(line)
    return "\n".join(lines), runs


def _offsets(sizes: list[float], whole: float) -> list[float]:
    total = sum(sizes)
    scale = whole / total if total > 0 and whole > 0 else 1.0
    return [x * scale for x in accumulate(sizes, initial=0.0)]


def _table(frame: Element) -> dict | None:
    found = find(frame, "tbl")
    if not found:
        return None
    grid, rows, box = child(found[0], "tblGrid"), children(found[0], "tr"), _bounds(frame)
    xs = _offsets([_emu(attr(c, "w")) for c in children(grid, "gridCol")] if grid is not None else [], box["width"])
    ys = _offsets([_emu(attr(r, "h")) for r in rows], box["height"])
    table = {"bounds": box, "rows": []}
    for i, row in enumerate(rows):
        cells = []
        for j, tc in enumerate(children(row, "tc")):
            if any(attr(tc, k).lower() in ("1", "true") for k in ("hMerge", "vMerge")):
                continue
            across, down = max(1, integer(attr(tc, "gridSpan"), 1)), max(1, integer(attr(tc, "rowSpan"), 1))
            b = rect()
            if j < len(xs) - 1 and i < len(ys) - 1:
                right, low = min(j + across, len(xs) - 1), min(i + down, len(ys) - 1)
                b = rect(box["x"] + xs[j], box["y"] + ys[i], xs[right] - xs[j], ys[low] - ys[i])
            text, runs = _texts(tc, b)
            cells.append(cell(i, j, text, down, across, b, runs))
        table["rows"].append({"cells": cells})
    return table if table["rows"] else None


def parse(data: bytes) -> dict:
    files = archive(data)
    deck = xml(files.get("ppt/presentation.xml"), "presentation")
    rels = relationships(files.get("ppt/_rels/presentation.xml.rels"), "ppt")
    size = find(deck, "sldSz")
    width, height = (_emu(attr(size[0], "cx")), _emu(attr(size[0], "cy"))) if size else (720.0, 540.0)
    pages: list[dict] = []
    for s in find(deck, "sldId"):
        rid = next((v for k, v in s.attrib.items() if k.startswith("{") and local(k) == "id"), "")
        part = rels.get(rid)
        if not part:
            continue
        slide = xml(files.get(part), part)
        pg = page(len(pages) + 1, width, height, f"Slide {len(pages) + 1}")
        for shape in find(slide, "sp"):
            text, runs = _texts(shape, _bounds(shape))
            pg["runs"] += runs
            add_line(pg, text)
        for frame in find(slide, "graphicFrame"):
            table = _table(frame)
            if table:
                pg["tables"].append(table)
                pg["runs"] += [r for row in table["rows"] for c in row["cells"] for r in c["runs"]]
                add_line(pg, table_tsv([[(c["column"], c["col_span"], c["text"]) for c in row["cells"]] for row in table["rows"]]))
            else:
                text, runs = _texts(frame, _bounds(frame))
                pg["runs"] += runs
                add_line(pg, text)
        own = relationships(files.get(posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")), posixpath.dirname(part))
        for pic in find(slide, "pic"):
            target = next((own.get(attr(b, "embed"), "") for b in find(pic, "blip")), "")
            if files.get(target):
                pg["images"].append(image(target, files[target], _bounds(pic)))
        pages.append(pg)
    if not pages:
        raise FormatError("no slides")
    return document("pptx", "slide", pages)
