"""Binary workbooks (BIFF8): one page per sheet in stream order, one line per row."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from . import cfb
from .common import FormatError, document, page, rect, run
from .officeart import images

#: The palette entries 8 to 15.
PALETTE = dict(enumerate(("#000000", "#FFFFFF", "#FF0000", "#00FF00", "#0000FF", "#FFFF00", "#FF00FF", "#00FFFF"), 8))
_DEFAULT = {"font": "", "size": 11.0, "color": "#000000"}


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        if at + 4 + n > len(data):
            return
        yield kind, data[at + 4 : at + 4 + n]
        at += 4 + n


def _text(data: bytes, wide: bool) -> str:
    """Wide text is UTF-16; narrow text keeps its bytes, read as UTF-8 with replacement."""
    return data.decode("utf-16-le" if wide else "utf-8", "replace")


def shared_strings(b: bytes) -> list[str]:
    if len(b) < 8:
        return []
    count, at, out = min(struct.unpack_from("<I", b, 4)[0], (len(b) - 8) // 3), 8, []
    while len(out) < count and at + 3 <= len(b):
        n, flags = struct.unpack_from("<HB", b, at)
        at += 3
        extra = 0
        if flags & 8 and at + 2 <= len(b):
            extra += 4 * struct.unpack_from("<H", b, at)[0]
            at += 2
        if flags & 4 and at + 4 <= len(b):
            extra += struct.unpack_from("<I", b, at)[0]
            at += 4
        size = n * (2 if flags & 1 else 1)
        if at + size > len(b):
            break
        out.append(_text(b[at : at + size], bool(flags & 1)))
        at += size + extra
    return out


def rk(v: int) -> float:
    """Packed number: a shifted integer or the upper half of a double, in hundredths if bit 0 is set."""
    if v & 2:
        n = float((v - (1 << 32) if v & 0x80000000 else v) >> 2)
    else:
        n = struct.unpack("<d", struct.pack("<Q", (v & ~3) << 32))[0]
    return n / 100 if v & 1 else n


def number_text(v: float) -> str:
    """Shortest digits that give the same double; with an exponent where it is below -4 or from 6 on."""
    if v != v or v in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "+Inf", "-inf": "-Inf"}[str(v)]
    mantissa, exponent = f"{v:.17e}".split("e")
    digits = repr(abs(v))
    if "e" in digits:
        m, e = digits.split("e")
        whole, _, frac = m.partition(".")
        shortest, power = (whole + frac).rstrip("0") or "0", int(e)
    else:
        whole, _, frac = digits.partition(".")
        frac = "" if frac == "0" else frac
        all_ = (whole + frac).lstrip("0")
        power = len(whole) - 1 if whole != "0" else -(len(frac) - len(frac.lstrip("0")) + 1) if all_ else 0
        shortest = all_.rstrip("0") or "0"
    sign = "-" if mantissa[0] == "-" else ""
    if power < -4 or power >= 6:
        tail = f"e{'-' if power < 0 else '+'}{abs(power):02d}"
        return sign + shortest[0] + ("." + shortest[1:] if len(shortest) > 1 else "") + tail
    if power < 0:
        return sign + "0." + "0" * (-power - 1) + shortest
    body = shortest.ljust(power + 1, "0")
    return sign + body[: power + 1] + ("." + body[power + 1 :] if len(body) > power + 1 else "")


def _font(b: bytes) -> dict:
    if len(b) < 16:
        return dict(_DEFAULT)
    n, wide = b[14], bool(b[15] & 1)
    size = n * (2 if wide else 1)
    return {"font": _text(b[16 : 16 + size], wide) if 16 + size <= len(b) else "", "size": struct.unpack_from("<H", b)[0] / 20, "color": PALETTE.get(struct.unpack_from("<H", b, 4)[0], "#000000")}


def _sheet(b: bytes) -> tuple[int, str] | None:
    if len(b) < 8:
        return None
    n, wide = b[6], bool(b[7] & 1)
    size = n * (2 if wide else 1)
    return (struct.unpack_from("<I", b)[0], _text(b[8 : 8 + size], wide)) if 8 + size <= len(b) else None


def _cells(stream: bytes, shared: list[str]) -> tuple[list[tuple[int, int, int, str]], bytes]:
    out, drawing = [], b""
    for kind, b in records(stream):
        value = None
        if kind == 0xFD and len(b) >= 10:
            i = struct.unpack_from("<I", b, 6)[0]
            value = shared[i] if i < len(shared) else ""
        elif kind == 0x204 and len(b) >= 9:
            n, wide = struct.unpack_from("<H", b, 6)[0], bool(b[8] & 1)
            size = n * (2 if wide else 1)
            value = _text(b[9 : 9 + size], wide) if 9 + size <= len(b) else None
        elif kind == 0x203 and len(b) >= 14:
            value = number_text(struct.unpack_from("<d", b, 6)[0])
        elif kind == 0x27E and len(b) >= 10:
            value = number_text(rk(struct.unpack_from("<I", b, 6)[0]))
        elif kind == 0x205 and len(b) >= 8:
            value = "TRUE" if b[6] else "FALSE"
        elif kind in (0xEC, 0xEB):
            drawing += b
        if value is not None:
            out.append((*struct.unpack_from("<HHH", b), value))
    return out, drawing


def parse(data: bytes) -> dict:
    streams = cfb.read(data)
    book = streams.get("Workbook") or streams.get("Book")
    if not book:
        raise FormatError("no workbook stream")
    sheets, shared, fonts, formats = [], [], [], []
    for kind, b in records(book):
        if kind == 0x85 and (s := _sheet(b)):
            sheets.append(s)
        elif kind == 0xFC:
            shared = shared_strings(b)
        elif kind == 0x31:
            fonts += [dict(_DEFAULT)] * (len(fonts) == 4) + [_font(b)]  # index 4 is reserved
        elif kind == 0xE0 and len(b) >= 2:
            formats.append(struct.unpack_from("<H", b)[0])
    sheets.sort(key=lambda s: s[0])
    pages = []
    for i, (start, name) in enumerate(sheets):
        end = sheets[i + 1][0] if i + 1 < len(sheets) else len(book)
        cells, drawing = _cells(book[start:end], shared) if start < len(book) else ([], b"")
        pg = page(i + 1, name=name)
        rows: dict[int, dict[int, str]] = {}
        for row, column, xf, value in cells:
            rows.setdefault(row, {})[column] = value
            f = formats[xf] if xf < len(formats) else -1
            style = fonts[f] if 0 <= f < len(fonts) else fonts[0] if fonts else _DEFAULT
            pg["runs"].append(run(value, rect(column, row, 1, 1), **style))
        lines = ("\t".join(r.get(c, "") for c in range(max(r) + 1)).rstrip("\t") for _, r in sorted(rows.items()))
        pg["text"] = "\n".join(x for x in lines if x)
        pg["images"] = images(drawing)
        pages.append(pg)
    if not pages:
        raise FormatError("no worksheets")
    return document("xls", "worksheet", pages)
