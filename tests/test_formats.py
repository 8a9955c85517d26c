import pytest

from foliary import fixtures as X
from foliary.formats import cfb, doc, pdf, xls, xlsx
from foliary.formats.common import image_size, sniff
from foliary.formats.html import text_of
from foliary.formats.rtf import cp1252
from foliary.sources.documents import parse

LINES = ["Hello (a) world", "Zweite Zeile", "third\\line"]


@pytest.mark.parametrize(("ext", "make"), [(".rtf", X.rtf), (".docx", X.docx), (".ofd", X.ofd), (".pdf", X.pdf), (".doc", X.doc), (".doc", X.html), (".ppt", lambda x: X.ppt([x])), (".pptx", lambda x: X.pptx([x]))])
def test_round_trip(ext, make):
    d = parse("x" + ext, make(LINES), normalize=False)
    assert (d["status"], d["error"]) == ("ok", None)
    assert d["pages"][0]["text"] == "\n".join(LINES)


@pytest.mark.parametrize(("ext", "make"), [(".xls", X.xls), (".xlsx", X.xlsx)])
def test_sheets(ext, make):
    d = parse("x" + ext, make([["a", "", "c"], [], ["é"]]))
    assert d["pages"][0]["text"] == "a\t\tc\né"
    assert [(r["text"], r["bounds"]["x"], r["bounds"]["y"]) for r in d["pages"][0]["runs"]] == [("a", 0, 0), ("c", 2, 0), ("é", 0, 2)]


def test_pdf_table():
    p = parse("x.pdf", X.pdf(["before"], [["a", "b"], ["c", "d"], ["e", "f"]]))["pages"][0]
    assert [[c["text"] for c in r["cells"]] for r in p["tables"][0]["rows"]] == [["a", "b"], ["c", "d"], ["e", "f"]]
    assert p["text"] == "before\na\tb\nc\td\ne\tf"


def test_docx_table_spans_cells():
    p = parse("x.docx", X.docx(["p"], [["a", "b"], ["c", ""]]))["pages"][0]
    assert p["text"] == "p\na\tb\nc\t" and len(p["tables"]) == 1


@pytest.mark.parametrize("case", sorted(X.MALFORMED))
def test_malformed_pages_end_in_a_row(case):
    assert parse("x.pdf", X.MALFORMED[case])["status"] in ("ok", "failed")


@pytest.mark.parametrize("ext", [".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".pdf", ".rtf", ".ofd"])
@pytest.mark.parametrize("data", [b"", b"\0" * 600, cfb.MAGIC + b"\xff" * 700, b"PK\x03\x04junk", None])
def test_broken_input_fails_alone(ext, data):
    d = parse("x" + ext, data)
    assert d["status"] == "failed" and d["error"] and d["pages"] == []


def test_unknown_extension_is_skipped():
    assert parse("x.zip", b"")["status"] == parse("noext", b"")["status"] == "skipped"


def test_pdf_strings():
    assert pdf.literal(r"(a\(b\)\101\n)") == b"a(b)A\n"
    assert pdf.literal("<4 14>") == b"A@"
    assert pdf.tokens("[(a) -20 (b)] TJ") == [["(a)", "-20", "(b)"], "TJ"]
    assert pdf.cmap("beginbfchar <01> <0041> endbfchar beginbfrange <02> <04> <0061> endbfrange") == {b"\1": "A", b"\2": "a", b"\3": "b", b"\4": "c"}
    assert pdf._rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"


def test_numbers_of_sheets():
    assert [xls.number_text(v) for v in (0.0, 100000.0, 1e6, 1234567.0, 0.0001, 0.00001, -2.5, 1 / 3)] == ["0", "100000", "1e+06", "1.234567e+06", "0.0001", "1e-05", "-2.5", "0.3333333333333333"]
    assert xls.rk((5 << 2) | 2) == 5 and xls.rk(((-7 & 0x3FFFFFFF) << 2) | 3) == -0.07
    assert xlsx.position("AA10") == (26, 9) and xlsx.position("1A") == (0, 0)


def test_word_marks():
    p = doc.paragraphs_of("a\x07b\x07\x07c\x07d\x07\x07tail\r")
    assert [(x.table, x.row, x.column, x.separator) for x in p[:4]] == [(1, 0, 0, "\t"), (1, 0, 1, "\n"), (1, 1, 0, "\t"), (1, 1, 1, "\n")]
    assert not p[4].table


def test_small_parts():
    assert cp1252(b"\x80\x81a") == "€\x81a"
    assert image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + b"\0\0\0\5\0\0\0\6") == (5, 6) and image_size(b"x") == (0, 0)
    assert sniff(b"GIF89a") == "gif" and sniff(b"") == ""
    assert text_of("<head>x</head>a<br>b<td>c</td>d<p></p>\n\n\n<p>e &amp; f</p>") == "a\nbc\td\n\ne & f"
    assert cfb.read(cfb.write({"A": b"one", "B": b"two" * 3000}))["B"][:9000] == b"two" * 3000


def test_word_styles():
    assert doc._properties(bytes.fromhex("434A 1C00 7068 FF000000 4F4A 0000".replace(" ", "")), ["Arial"]) == ("Arial", 14.0, "#FF0000")
    assert doc._properties(b"\x43", []) == doc.DEFAULT and doc.style_runs(b"", b"") == []
    p = doc.paragraphs_of("ab\r", [("X", 9.0, "#000000"), doc.DEFAULT, doc.DEFAULT])
    assert [(r["text"], r["font"]) for r in p[0].runs] == [("a", "X"), ("b", "")]


def test_legacy_slide_table():
    import struct

    from foliary.formats import ppt

    rec = lambda kind, b, version=0, instance=0: struct.pack("<HHI", version | instance << 4, kind, len(b)) + b
    shape = lambda x, y, t: rec(0xF004, rec(0xF00F, struct.pack("<4i", x, y, x + 80, y + 40)) + rec(0xF00D, rec(4000, t.encode("utf-16-le")), 15), 15)
    head = rec(0xF004, rec(0xF122, struct.pack("<HI", 0x039F, 1), 0, 1), 15)
    group = rec(0xF003, head + shape(0, 0, "a") + shape(80, 0, "b") + shape(0, 40, "c") + shape(80, 40, "d"), 15)
    d = ppt.parse(cfb.write({"PowerPoint Document": rec(1006, group, 15)}))
    assert d["pages"][0]["text"] == "a\tb\nc\td" and len(d["pages"][0]["tables"]) == 1


def test_clip_table():
    ops = ["q 0 0 200 1 re n Q", "0 100 m 200 100 l S 0 40 m 200 40 l S 100 40 m 100 100 l S"]
    for i, row in enumerate((("a", "b"), ("c", "d"))):
        for j, t in enumerate(row):
            ops.append(f"q {j * 100} {70 - i * 30} 100 30 re W n BT /F1 10 Tf 1 0 0 1 {j * 100 + 5} {90 - i * 30} Tm ({t}) Tj ET Q")
    runs, clips = pdf.read_text(pdf.tokens(" ".join(ops)), {})
    tables, inside = pdf.clip_tables(runs, clips, pdf.read_segments(pdf.tokens(" ".join(ops))))
    assert [[c["text"] for c in r["cells"]] for r in tables[0]["rows"]] == [["a", "b"], ["c", "d"]] and inside == [{0, 1, 2, 3}]


def test_pictures_need_a_recognizer():
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + b"\0\0\0\5\0\0\0\6"
    assert parse("a.png", png)["status"] == "skipped"
    d = parse("a.PNG", png, recognize=lambda d: d["pages"][0].update(text="关 于"))
    assert d["status"] == "ok" and d["pages"][0]["text"] == "关于"


def _pixels(data: bytes) -> list:
    """Rows of RGBA values of a PNG whose rows have no filter."""
    import struct
    import zlib

    at, w, h, raw = 8, 0, 0, b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        w, h = struct.unpack_from(">II", body) if kind == b"IHDR" else (w, h)
        raw += body if kind == b"IDAT" else b""
        at += n + 12
    rows = zlib.decompress(raw)
    return [[tuple(rows[y * (w * 4 + 1) + 1 + 4 * x :][:4]) for x in range(w)] for y in range(h)]


def test_pdf_pictures():
    import zlib

    size = b"/Subtype /Image /Width 2 /Height 1 /BitsPerComponent 8 /Filter /FlateDecode "
    pictures = [
        (size + b"/ColorSpace /DeviceRGB /SMask 7 0 R", zlib.compress(bytes([1, 2, 3, 4, 5, 6]))),
        (size + b"/ColorSpace /DeviceGray", zlib.compress(bytes([9, 200]))),
        (b"/Subtype /Form /Resources << /XObject << /J 9 0 R /K 8 0 R >> >>", b""),
        (size + b"/ColorSpace /DeviceCMYK /DecodeParms << /Predictor 15 >>", zlib.compress(bytes([1, 0, 0, 0, 255, 255, 0, 0, 1]))),
        (b"/Subtype /Image /Width 3 /Height 4 /Filter /DCTDecode", b"\xff\xd8\xff"),
        (size + b"/ColorSpace [/Indexed /DeviceRGB 1 11 0 R]", zlib.compress(b"\0\1")),
    ]
    got = parse("x.pdf", X.pdf(["a"], pictures=pictures))["pages"][0]["images"]
    by = {im["name"]: im for im in got}
    assert sorted(by) == ["I10", "I11", "I6", "I7", "I9"]
    assert _pixels(by["I6"]["data"]) == [[(1, 2, 3, 9), (4, 5, 6, 200)]] and _pixels(by["I7"]["data"]) == [[(9, 9, 9, 255), (200, 200, 200, 255)]]
    four = by["I9"]
    assert four["format"] == "png" and _pixels(four["data"]) == [[(0, 0, 0, 255), (0, 255, 255, 255)]]
    assert by["I10"]["format"] == "jpg" and by["I10"]["data"].startswith(b"\xff\xd8\xff") and by["I11"]["format"] == "raw"


def test_word_pictures():
    import struct

    text = "a\x01b\r"
    raw = text.encode("utf-16-le")
    word = bytearray(2048) + raw
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, 4) + struct.pack("<HIH", 0, 2048, 0)
    plc = struct.pack("<III", 2048, 2056, 2)
    struct.pack_into("<I", word, 76, 4)
    struct.pack_into("<II", word, 154 + 33 * 8, 0, len(clx))
    struct.pack_into("<II", word, 154 + 12 * 8, len(clx), len(plc))
    fkp = bytearray(512)
    struct.pack_into("<II", fkp, 0, 2050, 2052)
    fkp[8], fkp[511] = 250, 1
    fkp[500:507] = bytes([6]) + struct.pack("<HI", 0x6A03, 3)
    word[1024:1536] = fkp
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + b"\0\0\0\5\0\0\0\6"
    block = struct.pack("<HHI", 0, 0xF01E, 17 + len(png)) + b"\0" * 17 + png
    data = b"xyz" + struct.pack("<I", 4 + len(block)) + block
    d = parse("x.doc", cfb.write({"WordDocument": bytes(word), "0Table": clx + plc, "Data": data}), normalize=False)
    assert d["status"] == "ok" and d["pages"][0]["text"] == "ab"
    im = d["pages"][0]["images"][0]
    assert (im["name"], im["format"], im["width"], im["height"], bytes(im["data"])) == ("doc-image-3", "png", 5, 6, png)


def test_html_walk():
    assert text_of("a <> b < c <p>x</p>y") == "a <> b x\ny"
    assert text_of("<HEAD a='1'>no<style>p</style>yes<script>open") == "yesopen"
    assert text_of("<script>x</script >a<BR/>b<td>c</TD>d &amp;lt; &nbsp;") == "a\nbc\td &lt;"
    assert text_of("") == "" and text_of("a < b") == "a < b" and text_of("<b") == "<b"
