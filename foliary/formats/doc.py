"""Binary Word documents and HTML saved under the same name."""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from collections.abc import Iterator

from ..operators.paginate import Options, Paragraph, paginate
from . import cfb, officeart
from .common import FormatError, document, page, run
from .html import text_of

_DROPPED = {"\r": "\n", "\v": "\n", "\x07": "\n", "\t": "\t", "\f": "\f"}


def pieces(word: bytes, table: bytes) -> list[tuple[int, int, bool]]:
    """(place in the stream, characters, one byte each) of the text pieces; empty where the piece table is broken."""
    at = 154 + 33 * 8
    if len(word) < at + 8:
        return []
    start, size = struct.unpack_from("<II", word, at)
    clx, i = table[start : start + size], 0
    if size < 5 or start + size > len(table):
        return []
    while i + 3 <= len(clx) and clx[i] == 1:
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    if i + 5 > len(clx) or clx[i] != 2:
        return []
    n = struct.unpack_from("<I", clx, i + 1)[0]
    plc = clx[i + 5 : i + 5 + n]
    count = (n - 4) // 12
    if len(plc) < n or count < 1:
        return []
    ends = struct.unpack_from(f"<{count + 1}I", plc)
    out = []
    for k in range(count):
        fc = struct.unpack_from("<I", plc, (count + 1) * 4 + k * 8 + 2)[0]
        narrow, place = bool(fc & 0x40000000), fc & 0x3FFFFFFF
        place //= 2 if narrow else 1
        if ends[k + 1] > ends[k] and place < len(word):
            out.append((place, ends[k + 1] - ends[k], narrow))
    return out


DEFAULT = ("", 11.0, "#000000")
#: The sixteen colours that older properties number from 1.
COLORS = "#000000 #0000FF #00FFFF #00FF00 #FF00FF #FF0000 #FFFF00 #FFFFFF #00008B #008B8B #006400 #8B008B #8B0000 #808000 #A9A9A9 #D3D3D3".split()


def part(word: bytes, table: bytes, index: int) -> bytes:
    """The stretch of the table stream that an entry of the file header points to."""
    at = 154 + index * 8
    if len(word) < at + 8:
        return b""
    start, size = struct.unpack_from("<II", word, at)
    return table[start : start + size] if start + size <= len(table) else b""


def font_names(data: bytes) -> list[str]:
    out, at = [], 4
    n = struct.unpack_from("<H", data)[0] if len(data) >= 4 else 0
    while len(out) < n and at < len(data) and data[at] >= 39 and at + data[at] + 1 <= len(data):
        end = at + data[at] + 1
        out.append(data[at + 40 : end - (end - at) % 2].decode("utf-16-le", "replace").split("\0")[0])
        at = end
    return out


def _operands(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(operation, operand) of a list of properties; what is cut off ends it."""
    at = 0
    while at + 2 <= len(data):
        op = struct.unpack_from("<H", data, at)[0]
        at += 2
        n = {0: 1, 1: 1, 2: 2, 4: 2, 5: 2, 3: 4, 7: 3}.get(op >> 13, -1)
        if n < 0:
            if at >= len(data):
                break
            n = data[at]
            at += 1
        arg = data[at : at + n]
        if len(arg) < n:
            break
        yield op, arg
        at += n


def _properties(data: bytes, fonts: list[str]) -> tuple[str, float, str]:
    """Font (the East Asian one first), size and colour of a list of properties."""
    font, size, color = DEFAULT
    chosen: dict[int, int] = {}
    for op, arg in _operands(data):
        if op == 0x4A43:
            size = struct.unpack("<H", arg)[0] / 2
        elif op in (0x4A4F, 0x4A50):
            chosen[op] = struct.unpack("<H", arg)[0]
        elif op == 0x2A42:
            color = COLORS[arg[0] - 1] if 1 <= arg[0] <= 16 else "#000000"
        elif op == 0x6870 and arg != b"\xff" * 4:
            color = f"#{arg[0]:02X}{arg[1]:02X}{arg[2]:02X}"
    k = chosen.get(0x4A50, chosen.get(0x4A4F, -1))
    return (fonts[k] if 0 <= k < len(fonts) else font), size, color


def style_runs(word: bytes, table: bytes) -> list[tuple[int, int, tuple]]:
    """(from, to, style) over places in the document stream."""
    fonts = font_names(part(word, table, 15))
    return [(a, b, _properties(data, fonts) if data is not None else DEFAULT) for a, b, data in property_runs(word, table)]


def property_runs(word: bytes, table: bytes) -> list[tuple[int, int, bytes | None]]:
    """(from, to, properties) over places in the document stream, from the pages of character properties."""
    plc, out = part(word, table, 12), []
    if len(plc) < 12 or (len(plc) - 4) % 8:
        return []
    n = (len(plc) - 4) // 8
    for pn in struct.unpack_from(f"<{n}I", plc, (n + 1) * 4):
        page_ = word[pn * 512 : pn * 512 + 512]
        runs = page_[511] if len(page_) == 512 else 0
        base = (runs + 1) * 4
        if not runs or base + runs > 511:
            continue
        ends = struct.unpack_from(f"<{runs + 1}I", page_)
        for j in range(runs):
            at = page_[base + j] * 2
            data = page_[at + 1 : at + 1 + page_[at]] if 0 < at < 511 and at + 1 + page_[at] <= 511 else None
            out.append((ends[j], ends[j + 1], data))
    return sorted(out, key=lambda r: r[0])


def styled(word: bytes, table: bytes) -> tuple[str, list[tuple]]:
    """The text of all pieces and the style of each character: the last run that begins at or before its place."""
    runs = style_runs(word, table)
    starts = [r[0] for r in runs]
    text, styles = [], []
    for at, n, narrow in pieces(word, table):
        raw = word[at : at + n * (1 if narrow else 2)]
        chars = raw.decode("latin-1") if narrow else "".join(chr(u) if not 0xD800 <= u < 0xE000 else "\ufffd" for (u,) in struct.iter_unpack("<H", raw[: len(raw) // 2 * 2]))
        text.append(chars)
        for k in range(len(chars)):
            place = at + k * (1 if narrow else 2)
            i = bisect_right(starts, place) - 1
            styles.append(runs[i][2] if i >= 0 and place < runs[i][1] else DEFAULT)
    return "".join(text), styles


def pictures(word: bytes, table: bytes, data: bytes) -> dict[int, dict]:
    """Inline pictures by the number of the character that stands for them: a mark whose properties point into the data
    stream, where the first picture record of the block counts."""
    spots = [(a, b, struct.unpack("<I", arg)[0]) for a, b, p in property_runs(word, table) for op, arg in _operands(p or b"") if op == 0x6A03]
    out, cp = {}, 0
    starts = [s[0] for s in spots]
    for at, n, narrow in pieces(word, table) if spots and data else ():
        step = 1 if narrow else 2
        for k in range(n):
            place = at + k * step
            if word[place : place + step] == b"\x01\0"[:step]:
                i = bisect_right(starts, place) - 1
                if i >= 0 and place < spots[i][1] and (found := _block_picture(data, spots[i][2])):
                    out[cp + k] = found
        cp += n
    return out


def _block_picture(data: bytes, at: int) -> dict | None:
    """The first picture of the block that begins at a place of the data stream with its own length."""
    if at + 4 > len(data):
        return None
    size = struct.unpack_from("<I", data, at)[0]
    block = data[at : at + size] if 0 < size <= len(data) - at else data[at:]
    found = officeart.images(block)[:1]
    return found[0] | {"name": f"doc-image-{at}"} if found else None


def raw_text(word: bytes) -> str:
    """Without a piece table: stretches of at least four plausible UTF-16 units, else printable ASCII."""
    units = struct.unpack(f"<{len(word) // 2}H", word[: len(word) // 2 * 2])
    good = "".join("x" if 0x20 <= u <= 0x7E or u >= 0x300 or u in (9, 10, 13) else " " for u in units)
    parts = (word[2 * m.start() : 2 * m.end()].decode("utf-16-le", "replace") for m in re.finditer("x{4,}", good))
    text = "".join(p + "\n" for p in parts if p.strip())
    return (text or "".join("\n" if b in (10, 13) else chr(b) if 0x20 <= b < 0x7F else "" for b in word)).strip()


def paragraphs_of(text: str, styles: list[tuple] | None = None, images: dict[int, dict] | None = None) -> list[Paragraph]:
    """Paragraph ends, page breaks and cell marks; a second cell mark in a row ends the row, two plain paragraph ends
    part one table from the next."""
    out: list[Paragraph] = []
    here: list[dict] = []
    table = serial = row = column = first = breaks = 0
    apart = False

    shown: list[dict] = []

    def close() -> None:
        out.append(Paragraph(runs=list(here), images=list(shown)))
        here.clear()
        shown.clear()

    for i, c in enumerate(text):
        if c == "\f":
            close()
            out[-1].break_after = True
            table, breaks, apart = 0, 0, False
        elif c in "\r\v":
            close()
            breaks += 1
            apart = apart or breaks >= 2
        elif c == "\x07":
            breaks, doubled = 0, i > 0 and text[i - 1] == "\x07"
            if doubled:
                continue
            close()
            if not table or apart:
                serial += 1
                table, row, column, first, apart = serial, 0, 0, len(out) - 1, False
            for p in out[first:]:
                p.table, p.row, p.column = table, row, column
            last = text[i + 1 : i + 2] == "\x07"
            out[-1].separator = "\n" if last else "\t"
            row, column = (row + 1, 0) if last else (row, column + 1)
            first = len(out)
        elif images and i in images:
            shown.append(images[i])
        elif c == "\t" or c >= " ":
            font, size, color = styles[i] if styles else DEFAULT
            if here and (here[-1]["font"], here[-1]["size"], here[-1]["color"]) == (font, size, color):
                here[-1]["text"] += c
            else:
                here.append(run(c, None, font, size, color))
            breaks = 0
    if here or shown:
        close()
    return out


def page_count(summary: bytes) -> int:
    """Property 14 of the summary, or 0."""
    if len(summary) < 48 or summary[:2] != b"\xfe\xff":
        return 0
    for s in range(struct.unpack_from("<I", summary, 24)[0]):
        if 28 + s * 20 + 20 > len(summary):
            break
        base = struct.unpack_from("<I", summary, 28 + s * 20 + 16)[0]
        if base + 8 > len(summary):
            continue
        for i in range(min(struct.unpack_from("<I", summary, base + 4)[0], (len(summary) - base - 8) // 8)):
            key, off = struct.unpack_from("<II", summary, base + 8 + i * 8)
            if key == 14 and base + off + 8 <= len(summary) and struct.unpack_from("<I", summary, base + off)[0] == 3:
                return struct.unpack_from("<i", summary, base + off + 4)[0]
    return 0


def anchor(plc: bytes, main: int) -> int:
    """The first place to which a drawing is anchored, or 0."""
    n = (len(plc) - 4) // 30
    spots = [cp for cp in struct.unpack_from(f"<{n}I", plc) if cp < main] if n > 0 else []
    return min(spots, default=0)


def parse(data: bytes) -> dict:
    head = data.strip()
    if head.startswith((b"<!DOCTYPE html", b"<html")):
        pg = page(1)
        pg["text"] = text_of(data.decode("utf-8", "replace"))
        pg["runs"] = [run(pg["text"], size=11.0)]
        return document("doc", "single-flow", [pg])
    if not data.startswith(cfb.MAGIC):
        raise FormatError("neither a compound file nor HTML")
    streams = cfb.read(data)
    word = streams.get("WordDocument", b"")
    second = len(word) > 12 and struct.unpack_from("<H", word, 10)[0] & 0x0200
    table = streams.get("1Table" if second else "0Table", b"")
    text, styles = styled(word, table)
    if text:
        story = lambda at: struct.unpack_from("<I", word, at)[0] if len(word) >= at + 4 else 0
        main = story(76) if 0 < story(76) <= len(text) else len(text)
        pages = paginate(paragraphs_of(text[:main], styles[:main], pictures(word, table, streams.get("Data", b""))), Options(target_pages=max(0, page_count(streams.get("\x05SummaryInformation", b"")))))
        # text boxes follow the notes, headers and comments; they stand before the text of the page of the first anchor
        box = main + sum(story(at) for at in range(80, 97, 4))
        inside = text[box : box + story(100)] if main < len(text) else ""
        if inside.strip():
            over = paginate(paragraphs_of(inside, styles[box : box + len(inside)]), Options(target_pages=1))[0]
            pg = pages[min(len(pages) - 1, anchor(part(word, table, 40), main) * len(pages) // main)]
            pg["runs"] = over["runs"] + pg["runs"]
            pg["text"] = over["text"] + ("\n" if over["text"] and pg["text"] else "") + pg["text"]
        return document("doc", "layout-estimated", pages)
    pages = []
    for piece in "".join(_DROPPED.get(c, c if c >= " " or c == "\n" else "") for c in raw_text(word)).split("\f"):
        pg = page(len(pages) + 1)
        pg["text"] = piece.strip()
        pg["runs"] = [run(pg["text"], size=11.0)] if pg["text"] else []
        pages.append(pg)
    return document("doc", "layout-estimated", pages)
