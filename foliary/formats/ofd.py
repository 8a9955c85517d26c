"""OFD packages: placed text, images and paths of native pages; tables from ruled lines."""

from __future__ import annotations

import posixpath
import re
from xml.etree.ElementTree import Element

from ..operators.grid import Style, detect, lines_by_anchor, page_text
from .common import FormatError, archive, attr, children, document, find, image, page, rect, run, xml

MM = 72 / 25.4
XML_LIMIT, RESOURCE_LIMIT, MOST_ENTRIES = 20 << 20, 256 << 20, 20_000
STYLE = Style(tolerance=1.5, averaging=False, least_height=0.0, least_width=0.0, infer_borders=False, ascending=True, first_cell=True, text_of=lines_by_anchor)


def _numbers(text: str) -> list[float]:
    out = []
    for part in (text or "").replace(",", " ").split():
        try:
            out.append(float(part))
        except ValueError:
            continue
    return out


def member(base: str, name: str) -> str:
    """Path of a package member named from another one; names that leave the package are errors."""
    name = name.strip().replace("\\", "/")
    path = posixpath.normpath(name.lstrip("/") if name.startswith("/") else posixpath.join(posixpath.dirname(base), name))
    if path == ".." or path.startswith("../"):
        raise FormatError(f"member outside the package: {name}")
    return path


def _box(root: Element) -> tuple[float, float] | None:
    for b in find(root, "PhysicalBox")[:1]:
        v = _numbers(b.text or "")
        if len(v) >= 4:
            return v[2] * MM, v[3] * MM
    return None


def _placed(node: Element) -> dict | None:
    v = _numbers(attr(node, "Boundary"))
    return rect(*(x * MM for x in v[:4])) if len(v) >= 4 else None


def _color(node: Element) -> str:
    for c in children(node, "FillColor")[:1]:
        v = _numbers(attr(c, "Value"))
        if len(v) >= 3:
            return "#" + "".join(f"{max(0, min(255, int(x + 0.5))):02X}" for x in v[:3])
    return ""


def _segments(node: Element) -> list[tuple[float, float, float, float]]:
    """Straight strokes of a path, moved by its boundary."""
    base = _numbers(attr(node, "Boundary"))
    ox, oy = (base[0], base[1]) if len(base) >= 2 else (0.0, 0.0)
    out, at, start = [], None, None
    for data in find(node, "AbbreviatedData"):
        for op, args in re.findall(r"([A-Za-z])([^A-Za-z]*)", data.text or ""):
            v = _numbers(args)
            if op == "C" and at and start:
                out.append((*at, *start))
                at = start
            if len(v) < 2:
                continue
            to = ((v[0] + ox) * MM, (v[1] + oy) * MM)
            if op == "M":
                start = to
            elif op == "L" and at:
                out.append((*at, *to))
            at = to if op in "ML" else at
    return out


def _page(root: Element, number: int, fonts: dict[str, str], media: dict[str, dict], size: tuple[float, float]) -> dict:
    pg = page(number, *(_box(root) or size))
    segments: list[tuple[float, float, float, float]] = []
    for node in root.iter():
        kind = node.tag.rpartition("}")[2]
        b = _placed(node) if kind in ("TextObject", "ImageObject") else None
        if kind == "TextObject" and b:
            text = "".join(t.text or "" for t in find(node, "TextCode"))
            if text:
                pg["runs"].append(run(text, b, fonts.get(attr(node, "Font"), ""), (_numbers(attr(node, "Size")) or [0.0])[0] * MM, _color(node)))
        elif kind == "ImageObject" and b:
            im = media.get(attr(node, "ResourceID")) or {"name": attr(node, "ID"), "format": "", "width": 0, "height": 0, "data": b""}
            pg["images"].append({**im, "bounds": b})
        elif kind == "PathObject":
            segments += _segments(node)
    pg["tables"], inside = detect(pg["runs"], segments, STYLE)
    pg["text"] = page_text(pg["runs"], pg["tables"], inside, lines_by_anchor)
    return pg


def parse(data: bytes) -> dict:
    files = {k.lower(): v for k, v in archive(data, RESOURCE_LIMIT, MOST_ENTRIES).items()}

    def part(name: str) -> Element:
        raw = files.get(name.lower())
        if raw is not None and len(raw) > XML_LIMIT:
            raise FormatError(f"XML entry too large: {name}")
        return xml(raw, name)

    if "ofd.xml" not in files:
        raise FormatError("OFD.xml is missing")
    roots = [n for n in find(part("OFD.xml"), "DocRoot") if (n.text or "").strip()]
    if not roots:
        raise FormatError("DocRoot is missing")
    name = member("OFD.xml", roots[0].text)
    doc = part(name)
    fonts: dict[str, str] = {}
    media: dict[str, dict] = {}
    for ref in [*find(doc, "PublicRes"), *find(doc, "DocumentRes")]:
        try:
            where = member(name, ref.text or "")
            res = part(where)
        except FormatError:
            continue
        fonts |= {attr(f, "ID"): attr(f, "FamilyName") or attr(f, "FontName") for f in find(res, "Font") if attr(f, "ID")}
        base = attr(res, "BaseLoc")
        for m in find(res, "MultiMedia"):
            for f in find(m, "MediaFile") if attr(m, "Type") == "Image" else ():
                try:
                    at = member(where, posixpath.join(base, (f.text or "").strip()))
                except FormatError:
                    continue
                if at.lower() in files:
                    media[attr(m, "ID")] = image(at, files[at.lower()])
    size = _box(doc) or (210 * MM, 297 * MM)
    pages: list[dict] = []
    for p in find(doc, "Page"):
        if attr(p, "BaseLoc"):
            pages.append(_page(part(member(name, attr(p, "BaseLoc"))), len(pages) + 1, fonts, media, size))
    if not pages:
        raise FormatError("no pages")
    return document("ofd", "native", pages)
