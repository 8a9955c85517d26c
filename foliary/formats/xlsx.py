"""Workbooks in the XML format: one page per sheet, one line per row."""

from __future__ import annotations

import posixpath
import re
from xml.etree.ElementTree import Element

from .common import FormatError, archive, attr, child, children, document, find, image, integer, local, number, page, rect, relationships, run, xml

_ref = re.compile(r"([A-Za-z]+)(\d+)")
WIDEST = 16384


def position(ref: str) -> tuple[int, int]:
    """Zero-based (column, row) of a reference such as B3; bad references are (0, 0)."""
    m = _ref.fullmatch(ref)
    if not m:
        return 0, 0
    column = 0
    for c in m.group(1).upper():
        column = min(WIDEST, column * 26 + ord(c) - 64)
    return column - 1, int(m.group(2)) - 1


def _shown(n: Element) -> str:
    """Visible text: phonetic runs are skipped."""
    return "".join((c.text or "") if local(c.tag) == "t" else "" if local(c.tag) == "rPh" else _shown(c) for c in n)


def _value(c: Element, shared: list[str]) -> str:
    kind = attr(c, "t")
    if kind == "inlineStr" and find(c, "is"):
        return _shown(find(c, "is")[0])
    v = child(c, "v")
    raw = (v.text or "") if v is not None else ""
    if kind == "s":
        i = integer(raw)
        return shared[i] if 0 <= i < len(shared) else raw
    return ("TRUE" if raw == "1" else "FALSE") if kind == "b" else raw


def _styles(data: bytes | None) -> tuple[list[dict], list[int]]:
    if data is None:
        return [], []
    root = xml(data, "styles")
    fonts = []
    for group in find(root, "fonts")[:1]:
        for f in children(group, "font"):
            name, size, color = child(f, "name"), child(f, "sz"), child(f, "color")
            rgb = attr(color, "rgb") if color is not None else ""
            fonts.append({"font": attr(name, "val") if name is not None else "", "size": number(attr(size, "val"), 11.0) if size is not None else 11.0, "color": "#" + rgb[-6:].upper() if len(rgb) >= 6 else "#000000"})
    return fonts, [integer(attr(x, "fontId")) for g in find(root, "cellXfs")[:1] for x in children(g, "xf")]


def _pictures(files: dict[str, bytes], part: str, root: Element) -> list[dict]:
    rels = lambda p: relationships(files.get(posixpath.join(posixpath.dirname(p), "_rels", posixpath.basename(p) + ".rels")), posixpath.dirname(p))
    own = rels(part)
    targets = {t for d in find(root, "drawing") if attr(d, "id") in own for t in rels(own[attr(d, "id")]).values() if "/media/" in t and files.get(t)}
    return sorted((image(t, files[t]) for t in targets), key=lambda im: im["name"])


def parse(data: bytes) -> dict:
    files = archive(data)
    book = xml(files.get("xl/workbook.xml"), "workbook")
    rels = relationships(files.get("xl/_rels/workbook.xml.rels"), "xl")
    strings = files.get("xl/sharedStrings.xml")
    shared = [_shown(si) for si in children(xml(strings, "shared strings"), "si")] if strings else []
    fonts, formats = _styles(files.get("xl/styles.xml"))
    pages: list[dict] = []
    for sheet in find(book, "sheet"):
        part = rels.get(attr(sheet, "id"))
        if not part:
            continue
        root = xml(files.get(part), part)
        pg = page(len(pages) + 1, name=attr(sheet, "name"))
        for row in find(root, "row"):
            values: list[str] = []
            for c in children(row, "c"):
                value, (column, line) = _value(c, shared), position(attr(c, "r"))
                values += [""] * (column - len(values)) + [value]
                if value:
                    k = integer(attr(c, "s"))
                    f = formats[k] if 0 <= k < len(formats) else -1
                    style = fonts[f] if 0 <= f < len(fonts) else fonts[0] if fonts else {"font": "", "size": 11.0, "color": "#000000"}
                    pg["runs"].append(run(value, rect(column, line, 1, 1), **style))
            text = "\t".join(values).rstrip("\t")
            if text:
                pg["text"] += ("\n" if pg["text"] else "") + text
        pg["images"] = _pictures(files, part, root)
        pages.append(pg)
    if not pages:
        raise FormatError("no worksheets")
    return document("xlsx", "worksheet", pages)
