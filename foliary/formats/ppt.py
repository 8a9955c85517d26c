"""Binary presentations: the slide list gives order and outline text, slide containers the text of their shapes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..operators.grid import tsv_of
from . import cfb
from .common import FormatError, cell, document, page, rect, run, union
from .officeart import images

DEEPEST = 200
SLIDE_LIST, SLIDE, DOCUMENT_ATOM, PERSIST, CHARS, BYTES = 4080, 1006, 1001, 1011, 4000, 4008


def records(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(version, instance, kind, content)."""
    at = 0
    while at + 8 <= len(data):
        head, kind, n = struct.unpack_from("<HHI", data, at)
        if at + 8 + n > len(data):
            return
        yield head & 0xF, head >> 4, kind, data[at + 8 : at + 8 + n]
        at += 8 + n


def _text(kind: int, data: bytes) -> str:
    return data.decode("utf-16-le" if kind == CHARS else "utf-8", "replace")


def _add(pg: dict, value: str) -> None:
    value = value.replace("\r", "\n").replace("\v", "\n").strip()
    if value:
        pg["text"] += ("\n" if pg["text"] else "") + value
        pg["runs"].append(run(value, size=18.0))


def _collect(data: bytes, pg: dict, depth: int = 0) -> None:
    if depth > DEEPEST:
        return
    for version, _, kind, b in records(data):
        if kind in (CHARS, BYTES):
            _add(pg, _text(kind, b))
        if version == 0xF:
            _collect(b, pg, depth + 1)


#: Record types of drawings.
GROUP, SHAPE, ANCHOR, TEXT_BOX, TABLE_PROPERTIES, TABLE_FLAG = 0xF003, 0xF004, 0xF00F, 0xF00D, 0xF122, 0x039F


def _below(data: bytes, depth: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(kind, instance, content) of all records, containers before what they hold."""
    if depth > DEEPEST:
        return
    for version, instance, kind, b in records(data):
        yield kind, instance, b
        if version == 0xF:
            yield from _below(b, depth + 1)


def _is_table(shape: bytes) -> bool:
    for kind, count, b in _below(shape):
        if kind == TABLE_PROPERTIES:
            for key, value in struct.iter_unpack("<HI", b[: min(count, len(b) // 6) * 6]):
                if key & 0x3FFF == TABLE_FLAG and value & 1:
                    return True
    return False


def _box(shape: bytes) -> dict | None:
    for kind, _, b in _below(shape):
        if kind == ANCHOR and len(b) >= 16:
            left, top, right, low = (v / 8 for v in struct.unpack_from("<4i", b))
            return rect(left, top, right - left, low - top) if right > left and low > top else None
    return None


def _table(group: bytes) -> dict | None:
    """A group whose first shape is marked as a table: text shapes become cells, their distinct left and upper edges
    the columns and rows."""
    parts = list(records(group))
    if len(parts) < 2 or parts[0][2] != SHAPE or not _is_table(parts[0][3]):
        return None
    made = []
    for _, _, kind, b in parts[1:]:
        box = _box(b) if kind == SHAPE else None
        if box and any(k == TEXT_BOX for k, _, _ in _below(b)):
            pg = page(0)
            _collect(b, pg)
            made.append((box, pg["text"], [{**r, "bounds": dict(box)} for r in pg["runs"]]))
    if not made:
        return None
    xs, ys = (sorted({m[0][k] for m in made}) for k in "xy")
    span = lambda edges, a, size: max(1, sum(a <= e < a + size for e in edges))
    rows: list[dict] = [{"cells": []} for _ in ys]
    bounds = made[0][0]
    for box, text, runs in made:
        i, j = ys.index(box["y"]), xs.index(box["x"])
        rows[i]["cells"].append(cell(i, j, text, span(ys, box["y"], box["height"]), span(xs, box["x"], box["width"]), box, runs))
        bounds = union(bounds, box)
    for r in rows:
        r["cells"].sort(key=lambda c: c["column"])
    return {"bounds": bounds, "rows": rows}


def _tables(data: bytes, depth: int = 0) -> list[dict]:
    out = []
    for version, _, kind, b in records(data):
        table = _table(b) if kind == GROUP else None
        if table:
            out.append(table)
        elif version == 0xF and depth < DEEPEST:
            out += _tables(b, depth + 1)
    return out


def _put_table(pg: dict, table: dict) -> None:
    """The table's cells one below the other in the text give way to its rows; else the rows are added."""
    rows, flat = tsv_of(table), "\n".join(c["text"].strip() for r in table["rows"] for c in r["cells"])
    pg["tables"].append(table)
    if flat and flat in pg["text"]:
        pg["text"] = pg["text"].replace(flat, rows, 1)
    elif rows and rows not in pg["text"]:
        _add(pg, rows)


def _slides(data: bytes, size: tuple[float, float]) -> list[dict]:
    out, at = [], 0
    while at + 8 <= len(data):
        kind, n = struct.unpack_from("<HI", data, at + 2)
        if kind == SLIDE and 0 < n and at + 8 + n <= len(data):
            pg = page(len(out) + 1, *size, f"Slide {len(out) + 1}")
            body = data[at + 8 : at + 8 + n]
            _collect(body, pg)
            pg["images"] = images(body)
            for table in _tables(body):
                _put_table(pg, table)
            out.append(pg)
            at += 8 + n
        else:
            at += 1
    return out


def parse(data: bytes) -> dict:
    streams = cfb.read(data)
    content = streams.get("PowerPoint Document")
    if not content:
        raise FormatError("no presentation stream")
    size, pages = [720.0, 540.0], []

    def walk(b: bytes, depth: int = 0) -> None:
        if depth > DEEPEST:
            return
        for version, instance, kind, body in records(b):
            if kind == DOCUMENT_ATOM and len(body) >= 8:
                size[:] = [v / 8 for v in struct.unpack_from("<ii", body)]
            if kind == SLIDE_LIST and instance == 0:
                here = None
                for _, _, k, part in records(body):
                    if k == PERSIST:
                        here = page(len(pages) + 1, *size, f"Slide {len(pages) + 1}")
                        pages.append(here)
                    elif here is not None and k in (CHARS, BYTES):
                        _add(here, _text(k, part))
            elif version == 0xF:
                walk(body, depth + 1)

    walk(content)
    slides = _slides(content, tuple(size))
    if slides and not pages:
        pages = slides
    elif len(slides) >= len(pages) > 0:
        # containers may begin with masters; the last ones belong to the listed slides
        for pg, extra in zip(pages, slides[-len(pages) :]):
            for r in extra["runs"]:
                if r["text"].strip() and r["text"].strip() not in pg["text"]:
                    _add(pg, r["text"])
            pg["images"] += extra["images"]
            for table in extra["tables"]:
                _put_table(pg, table)
    if not pages:
        pg = page(1, *size, "Slide 1")
        _collect(content, pg)
        pages = [pg] if pg["text"] else []
    if not pages:
        raise FormatError("no slides or text")
    pages[0]["images"] += images(streams.get("Pictures", b""))
    return document("ppt", "slide", pages)
