"""Word documents: body paragraphs with breaks, tables, inline and floating content, laid out by estimate."""

from __future__ import annotations

from xml.etree.ElementTree import Element

from ..operators.paginate import Options, Paragraph, paginate
from .common import ENTRY_LIMIT, FormatError, archive, attr, child, children, document, find, image, integer, local, number, run, xml


def _twips(node: Element | None, name: str) -> float:
    return number(attr(node, name)) / 20 if node is not None else 0.0


def _inside(p: Element, name: str) -> list[Element]:
    """Descendants of the name, but not within text boxes."""
    out: list[Element] = []

    def walk(n: Element) -> None:
        for c in n:
            kind = local(c.tag)
            if kind == "txbxContent":
                continue
            if kind == name:
                out.append(c)
            walk(c)

    walk(p)
    return out


def _text(n: Element) -> str:
    kind = local(n.tag)
    own = (n.text or "") if kind in ("t", "instrText") else "\t" if kind == "tab" else "\n" if kind == "br" and attr(n, "type") != "page" else ""
    return own + "".join(map(_text, n))


def _style(props: Element | None, base: dict) -> dict:
    out = dict(base)
    if props is None:
        return out
    value = lambda name: next((attr(c, "val") or attr(c, "id") for c in children(props, name)), "")
    if value("sz"):
        out["size"] = number(value("sz"), out["size"] * 2) / 2
    if value("color") not in ("", "auto"):
        out["color"] = "#" + value("color").upper()
    if value("rFonts"):
        out["font"] = value("rFonts")
    return out


def _blocks(root: Element) -> list[tuple[Element, Paragraph]]:
    """Paragraphs in reading order with their place in a table; an empty cell gives an empty paragraph."""
    out: list[tuple[Element, Paragraph]] = []
    tables = 0

    def walk(parent: Element, place: tuple | None) -> None:
        nonlocal tables
        for c in parent:
            kind = local(c.tag)
            if kind == "txbxContent":
                continue
            if kind == "p":
                out.append((c, Paragraph(**dict(zip(("table", "row", "column", "col_span"), place)) if place else {})))
            elif kind == "tbl":
                tables += 1
                own = tables
                for r, row in enumerate(children(c, "tr")):
                    column, cells = 0, children(row, "tc")
                    for k, tc in enumerate(cells):
                        grid = child(child(tc, "tcPr"), "gridSpan")
                        span = max(1, integer(attr(grid, "val"), 1)) if grid is not None else 1
                        place_, before = (own, r, column, span), len(out)
                        walk(tc, place_)
                        if len(out) == before:
                            out.append((Element("p"), Paragraph(table=own, row=r, column=column, col_span=span)))
                        out[-1][1].separator = "\t" if k + 1 < len(cells) else "\n"
                        column += span
            else:
                walk(c, place)

    bodies = find(root, "body")
    walk(bodies[0] if bodies else root, None)
    return out


def _break_first(p: Element) -> bool:
    """Whether a rendered page break stands before anything visible."""
    for n in _flow(p):
        kind = local(n.tag)
        if kind == "lastRenderedPageBreak":
            return True
        if kind in ("drawing", "pict") or (kind in ("t", "instrText") and (n.text or "").strip()):
            return False
    return False


def _flow(p: Element):
    for c in p:
        yield c
        yield from _flow(c)


def parse(data: bytes) -> dict:
    files = archive(data, ENTRY_LIMIT)
    if "word/document.xml" not in files:
        raise FormatError("missing word/document.xml")
    root = xml(files["word/document.xml"], "document")
    rels = {}
    if "word/_rels/document.xml.rels" in files:
        rels = {attr(r, "Id"): "word/" + attr(r, "Target") for r in find(xml(files["word/_rels/document.xml.rels"], "relationships"), "Relationship")}
    pictures = lambda n: [image(rels[t], files[rels[t]]) for b in find(n, "blip") if (t := attr(b, "embed")) in rels and files.get(rels[t])]
    rendered = bool(find(root, "lastRenderedPageBreak"))
    blocks, paragraphs, floating, hint = _blocks(root), [], [], 0
    for i, (p, frame) in enumerate(blocks):
        props = child(p, "pPr")
        base = _style(child(props, "rPr"), run("", size=11.0))
        spacing = child(props, "spacing")
        if spacing is not None:
            frame.before, frame.after = _twips(spacing, "before"), _twips(spacing, "after")
            if attr(spacing, "line"):
                raw = number(attr(spacing, "line"))
                frame.line_height = base["size"] * raw / 240 if attr(spacing, "lineRule") == "auto" else raw / 20
        frame.break_before = child(props, "pageBreakBefore") is not None
        section = child(props, "sectPr")
        kind = child(section, "type")
        ends = section is not None and not rendered and ((attr(kind, "val") if kind is not None else "") or "nextPage") != "continuous"
        parts, flowing = [frame], 0
        for r in _inside(p, "r"):
            if _inside(r, "lastRenderedPageBreak"):
                here = parts[-1]
                if here.runs or here.images:
                    parts.append(Paragraph(after=here.after, line_height=frame.line_height, table=frame.table, row=frame.row, column=frame.column, row_span=frame.row_span, col_span=frame.col_span, separator=here.separator))
                    here.break_after, here.after, here.separator = True, 0.0, ""
                else:
                    here.break_before = True
            text = _text(r)
            if text:
                parts[-1].runs.append({**_style(child(r, "rPr"), base), "text": text})
            inline = _inside(r, "inline")
            found = [im for n in inline for im in pictures(n)] if inline else [] if _inside(r, "anchor") else pictures(r)
            parts[-1].images += found
            flowing += len(found)
        anchors = _inside(p, "anchor")
        floating += [(hint, pictures(a), []) for a in anchors]
        if not flowing and not anchors and not _inside(p, "inline"):
            parts[-1].images += pictures(p)
        floating += [(hint, [], [Paragraph(runs=[{**_style(child(r, "rPr"), run("", size=11.0)), "text": t} for r in find(q, "r") if (t := _text(r))]) for q in find(box, "p")]) for box in find(p, "txbxContent")]
        follows = rendered and i + 1 < len(blocks) and _break_first(blocks[i + 1][0])
        if ends or (not follows and any(attr(b, "type") == "page" for b in _inside(p, "br"))):
            parts[-1].break_after = True
        paragraphs += parts
        hint += len(_inside(p, "lastRenderedPageBreak"))
    sections = find(root, "sectPr")
    size, margin = (child(sections[-1], n) if sections else None for n in ("pgSz", "pgMar"))
    options = Options(_twips(size, "w"), _twips(size, "h"), *(_twips(margin, n) for n in ("top", "right", "bottom", "left")))
    if "docProps/app.xml" in files:
        counted = find(xml(files["docProps/app.xml"], "properties"), "Pages")
        options.target_pages = integer((counted[0].text or "").strip()) if counted else 0
    pages = paginate(paragraphs, options)
    for at, images, texts in floating:
        pg = pages[min(max(at, 0), len(pages) - 1)]
        pg["images"] += images
        if texts:
            over = paginate(texts, Options(pg["width"], pg["height"], target_pages=1))[0]
            pg["runs"] += over["runs"]
            if over["text"]:
                pg["text"] += ("\n" if pg["text"] else "") + over["text"]
    return document("docx", "layout-estimated", pages)
