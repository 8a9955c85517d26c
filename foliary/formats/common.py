"""What the format parsers share: rows of the model as plain dicts, archives, XML without namespaces, image headers."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
from xml.etree import ElementTree

ENTRY_LIMIT = 512 << 20


class FormatError(ValueError):
    """The bytes are not a readable document of the format."""


def rect(x: float = 0.0, y: float = 0.0, width: float = 0.0, height: float = 0.0) -> dict:
    return {"x": float(x), "y": float(y), "width": float(width), "height": float(height)}


def run(text: str, bounds: dict | None = None, font: str = "", size: float = 0.0, color: str = "#000000") -> dict:
    return {"text": text, "bounds": bounds or rect(), "font": font, "size": float(size), "color": color}


def page(number: int, width: float = 0.0, height: float = 0.0, name: str = "") -> dict:
    return {"number": number, "name": name, "width": float(width), "height": float(height), "text": "", "runs": [], "images": [], "tables": []}


def document(fmt: str, pagination: str, pages: list[dict]) -> dict:
    return {"format": fmt, "pagination": pagination, "pages": pages}


def cell(row: int, column: int, text: str = "", row_span: int = 1, col_span: int = 1, bounds: dict | None = None, runs: list[dict] | None = None) -> dict:
    return {"row": row, "column": column, "row_span": row_span, "col_span": col_span, "bounds": bounds or rect(), "text": text, "runs": runs or []}


def union(a: dict, b: dict) -> dict:
    """Smallest rectangle around both; one without extent counts as absent."""
    if not a["width"] and not a["height"]:
        return b
    if not b["width"] and not b["height"]:
        return a
    x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
    return rect(x, y, max(a["x"] + a["width"], b["x"] + b["width"]) - x, max(a["y"] + a["height"], b["y"] + b["height"]) - y)


def add_line(p: dict, text: str) -> None:
    if text:
        p["text"] += ("\n" if p["text"] else "") + text


def archive(data: bytes, limit: int = ENTRY_LIMIT, most: int | None = None) -> dict[str, bytes]:
    """All entries of a zip; an entry over the limit is an error."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise FormatError(f"not a zip archive: {e}") from None
    out = {}
    infos = z.infolist()
    if most is not None and len(infos) > most:
        raise FormatError("too many entries")
    for info in infos:
        if info.is_dir():
            continue
        if info.file_size > limit:
            raise FormatError(f"entry too large: {info.filename}")
        out[info.filename] = z.read(info)
    return out


def local(name: str) -> str:
    return name.rpartition("}")[2] if isinstance(name, str) else ""


def xml(data: bytes | None, what: str = "part") -> ElementTree.Element:
    if data is None:
        raise FormatError(f"missing {what}")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise FormatError(f"bad XML in {what}: {e}") from None


def attr(node: ElementTree.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if local(k) == name), "")


def children(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in node if local(c.tag) == name]


def child(node: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
    return next((c for c in node if local(c.tag) == name), None) if node is not None else None


def find(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    """The node itself and all below it with the local name, in document order."""
    return [n for n in node.iter() if local(n.tag) == name]


def number(text: str, default: float = 0.0) -> float:
    try:
        return float(text)
    except ValueError:
        return default


def integer(text: str, default: int = 0) -> int:
    try:
        return int(text)
    except ValueError:
        return default


def relationships(data: bytes | None, base: str) -> dict[str, str]:
    """Relationship id to the path of its part."""
    if data is None:
        return {}
    out = {}
    for r in find(xml(data, "relationships"), "Relationship"):
        target = attr(r, "Target")
        out[attr(r, "Id")] = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(base, target))
    return out


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height from the header of a PNG, GIF or JPEG; (0, 0) otherwise."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(data):
            if data[i] != 0xFF:
                i += 1
                continue
            marker = data[i + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                return w, h
            i += 2 if marker in (0x01, 0xFF) or 0xD0 <= marker <= 0xD9 else 2 + struct.unpack(">H", data[i + 2 : i + 4])[0]
    return 0, 0


def sniff(data: bytes) -> str:
    """Image type by its first bytes, or the empty string."""
    for head, kind in ((b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpg"), (b"GIF8", "gif"), (b"BM", "bmp"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff")):
        if data.startswith(head):
            return kind
    return ""


def image(name: str, data: bytes, bounds: dict | None = None, fmt: str | None = None) -> dict:
    w, h = image_size(data)
    return {"name": posixpath.basename(name), "format": fmt if fmt is not None else posixpath.splitext(name)[1].lstrip("."), "width": w, "height": h, "bounds": bounds or rect(), "data": data}
