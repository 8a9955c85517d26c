"""Minimal files of every format, built in memory from text: the inputs of round-trip queries and tests."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Sequence
from xml.sax.saxutils import escape

from .formats import cfb


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            info = zipfile.ZipInfo(name)  # without a clock: equal input, equal bytes
            z.writestr(info, body)
    return out.getvalue()


def _clean(text: str) -> str:
    return escape("".join(c for c in text if c in "\t\n\r" or (" " <= c and not 0xD800 <= ord(c) < 0xE000 and c not in "￾￿")))


def rtf(lines: Sequence[str]) -> bytes:
    def code(c: str) -> str:
        if c in "\\{}":
            return "\\" + c
        if c == "\t":
            return "\\tab "
        if " " <= c < "\x7f":
            return c
        n = ord(c)
        return "".join(f"\\u{u - 65536 * (u > 32767)}?" for u in struct.unpack(f"<{len(c.encode('utf-16-le')) // 2}H", c.encode("utf-16-le"))) if n > 31 else ""

    body = "".join("".join(map(code, x)) + "\\par\n" for x in lines)
    return ("{\\rtf1\\ansi\\deff0{\\fonttbl{\\f0 Arial;}}{\\colortbl;\\red0\\green0\\blue0;}\n\\f0\\fs22 " + body + "}").encode("latin-1")


def docx(lines: Sequence[str], table: Sequence[Sequence[str]] = ()) -> bytes:
    p = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{_clean(t)}</w:t></w:r></w:p>'
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    body = "".join(map(p, lines)) + (f"<w:tbl>{rows}</w:tbl>" if rows else "")
    return _zip({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def _column(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx(rows: Sequence[Sequence[str]], name: str = "Sheet1") -> bytes:
    shared: dict[str, int] = {}
    body = ""
    for r, row in enumerate(rows, 1):
        body += f'<row r="{r}">' + "".join(f'<c r="{_column(c)}{r}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>' for c, v in enumerate(row) if v) + "</row>"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return _zip(
        {
            "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="{_clean(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {ns}>" + "".join(f'<si><t xml:space="preserve">{_clean(s)}</t></si>' for s in shared) + "</sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>",
        }
    )


def pptx(slides: Sequence[Sequence[str]]) -> bytes:
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "ppt/presentation.xml": f"<p:presentation {ns}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + i}" r:id="rId{i}"/>' for i in range(len(slides))) + '</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="slides/slide{i + 1}.xml"/>' for i in range(len(slides))) + "</Relationships>",
    }
    for i, lines in enumerate(slides, 1):
        body = "".join(f"<a:p><a:r><a:t>{_clean(x)}</a:t></a:r></a:p>" for x in lines)
        parts[f"ppt/slides/slide{i}.xml"] = f"<p:sld {ns}><p:cSld><p:spTree><p:sp><p:txBody>{body}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
    return _zip(parts)


def ofd(lines: Sequence[str], rules: Sequence[tuple[float, float, float, float]] = ()) -> bytes:
    ns = 'xmlns:ofd="http://www.ofdspec.org/2016"'
    texts = "".join(f'<ofd:TextObject ID="{i}" Boundary="10 {10 + 6 * i} 180 5" Size="4"><ofd:TextCode>{_clean(x)}</ofd:TextCode></ofd:TextObject>' for i, x in enumerate(lines))
    paths = "".join(f'<ofd:PathObject Boundary="0 0 210 297"><ofd:AbbreviatedData>M {a} {b} L {c} {d}</ofd:AbbreviatedData></ofd:PathObject>' for a, b, c, d in rules)
    return _zip(
        {
            "OFD.xml": f"<ofd:OFD {ns}><ofd:DocBody><ofd:DocRoot>Doc_0/Document.xml</ofd:DocRoot></ofd:DocBody></ofd:OFD>",
            "Doc_0/Document.xml": f'<ofd:Document {ns}><ofd:CommonData><ofd:PageArea><ofd:PhysicalBox>0 0 210 297</ofd:PhysicalBox></ofd:PageArea></ofd:CommonData><ofd:Pages><ofd:Page ID="1" BaseLoc="Pages/Page_0/Content.xml"/></ofd:Pages></ofd:Document>',
            "Doc_0/Pages/Page_0/Content.xml": f"<ofd:Page {ns}><ofd:Content><ofd:Layer>{texts}{paths}</ofd:Layer></ofd:Content></ofd:Page>",
        }
    )


def pdf(lines: Sequence[str], table: Sequence[Sequence[str]] = (), packed: bool = True, width: int = 120, pictures: Sequence[tuple[bytes, bytes]] = ()) -> bytes:
    """ASCII lines, one below the other; a table is drawn with ruling lines under them. pictures: (dictionary entries,
    stream) of image objects, numbered from 6; the last stands in a nested form."""
    esc = lambda t: t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    y, ops = 800.0, []
    for x in lines:
        ops.append(f"BT /F1 10 Tf 1 0 0 1 50 {y:g} Tm ({esc(x)}) Tj ET")
        y -= 20
    if table:
        height, top = 24, y
        n, m = max(map(len, table)), len(table)
        ops += [f"50 {top - i * height:g} m {50 + n * width} {top - i * height:g} l S" for i in range(m + 1)]
        ops += [f"{50 + j * width} {top:g} m {50 + j * width} {top - m * height:g} l S" for j in range(n + 1)]
        ops += [f"BT /F1 10 Tf 1 0 0 1 {54 + j * width} {top - i * height - 4:g} Tm ({esc(c)}) Tj ET" for i, r in enumerate(table) for j, c in enumerate(r)]
    stream = "\n".join(ops).encode("latin-1", "replace")
    body = zlib.compress(stream) if packed else stream
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> %s >> >>" % (b"/XObject << " + b" ".join(b"/I%d %d 0 R" % (k, k) for k in range(6, 6 + len(pictures))) + b" >>" if pictures else b"")]
    parts.append(b"<< /Length %d%s >>\nstream\n" % (len(body), b" /Filter /FlateDecode" if packed else b"") + body + b"\nendstream")
    parts.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    parts += [b"<< /Type /XObject %s /Length %d >>\nstream\n" % (head, len(raw)) + raw + b"\nendstream" for head, raw in pictures]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1)) + b"%%EOF\n"


def xls(rows: Sequence[Sequence[str | float]], name: str = "Sheet1") -> bytes:
    rec = lambda kind, b: struct.pack("<HH", kind, len(b)) + b
    strings: dict[str, int] = {}
    cells = b""
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            if isinstance(v, float):
                cells += rec(0x203, struct.pack("<HHHd", r, c, 0, v))
            elif v:
                cells += rec(0xFD, struct.pack("<HHHI", r, c, 0, strings.setdefault(v, len(strings))))
    sst = struct.pack("<II", len(strings), len(strings)) + b"".join(struct.pack("<HB", len(s.encode("utf-16-le")) // 2, 1) + s.encode("utf-16-le") for s in strings)
    raw = name.encode("utf-16-le")
    size = 4 + 8 + len(raw) + 4 + len(sst)
    sheet = rec(0x85, struct.pack("<IHBB", size, 0, len(name), 1) + raw)
    return cfb.write({"Workbook": sheet + rec(0xFC, sst) + cells})


def ppt(slides: Sequence[Sequence[str]]) -> bytes:
    rec = lambda kind, b, version=0: struct.pack("<HHI", version, kind, len(b)) + b
    body = b"".join(rec(1011, b"\0" * 20) + b"".join(rec(4000, x.encode("utf-16-le")) for x in lines) for lines in slides)
    return cfb.write({"PowerPoint Document": rec(1000, rec(1001, struct.pack("<ii", 5760, 4320)) + rec(4080, body, 15), 15)})


def doc(lines: Sequence[str]) -> bytes:
    text = "".join(x + "\r" for x in lines)
    raw = text.encode("utf-16-le")
    start = 1024
    word = bytearray(start) + raw
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(raw) // 2) + struct.pack("<HIH", 0, start, 0)
    struct.pack_into("<I", word, 76, len(raw) // 2)
    struct.pack_into("<II", word, 154 + 33 * 8, 0, len(clx))
    return cfb.write({"WordDocument": bytes(word), "0Table": clx})


def html(lines: Sequence[str]) -> bytes:
    return ("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>" + "".join(f"<p>{_clean(x)}</p>" for x in lines) + "</body></html>").encode()


BUILDERS = {"rtf": rtf, "docx": docx, "ofd": ofd, "pdf": pdf, "doc": doc}

#: Broken page descriptions: none may end a task.
MALFORMED = {
    "empty": b"",
    "header_only": b"%PDF-1.4\n",
    "huge_objstm_offsets": b"%PDF-1.5\n1 0 obj\n<< /Type /ObjStm /N 2 /First 30 >>\nstream\n7 9223372036854775807 8 1       <<>> <<>>\nendstream\nendobj\n2 0 obj\n<< /Type /Page >>\nendobj\n",
    "huge_image_dims": b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Resources << /XObject << /I 2 0 R >> >> >>\nendobj\n2 0 obj\n<< /Subtype /Image /Width 99999999999999999 /Height 99999999999999999 /Filter /FlateDecode >>\nstream\nx\nendstream\nendobj\n",
    "huge_smask_dims": b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Resources << /XObject << /I 2 0 R >> >> >>\nendobj\n2 0 obj\n<< /Subtype /Image /Filter /DCTDecode /SMask 3 0 R >>\nstream\nx\nendstream\nendobj\n3 0 obj\n<< /Width 99999999999999999 /Height 99999999999999999 >>\nendobj\n",
    "page_cycle": b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [2 0 R] >>\nendobj\n",
    "parent_cycle": b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Parent 1 0 R >>\nendobj\n",
    "unterminated_string": b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< >>\nstream\nBT (open\nendstream\nendobj\n",
    "stray_delims": b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< >>\nstream\n) > ] } { >> BT ] Tj ET\nendstream\nendobj\n",
    "trailing_backslash": b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< >>\nstream\nBT (open\\\nendstream\nendobj\n",
}
