"""Rich text: a token stream drives a group-state machine that yields paragraphs, laid out by estimate."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..operators.paginate import Options, Paragraph, paginate
from .common import FormatError, document, image, rect, run

_token = re.compile(r"\\(?P<word>[A-Za-z]+)(?P<arg>-?[0-9]+)? ?|\\'(?P<hex>[0-9A-Fa-f]{2})|\\(?P<sign>[^A-Za-z])|(?P<brace>[{}])|(?P<text>[^\\{}]+)", re.DOTALL)
#: Destinations of the public RTF specification whose content is no body text.
DESTINATIONS = frozenset(
    """aftncn aftnsep aftnsepc annotation atnauthor atndate atnicn atnid atnparent atnref atntime atrfend atrfstart author
    background bkmkend bkmkstart blipuid buptim category colorschememapping colortbl comment company creatim datafield
    datastore defchp defpap do doccomm docvar dptxbxtext ebcend ebcstart factoidname falt fchars ffdeftext ffentrymcr
    ffexitmcr ffformat ffhelptext ffl ffname ffstattext field file filetbl fldinst fldrslt fontemb fontfile fonttbl footer
    footerf footerl footerr footnote formfield ftncn ftnsep ftnsepc generator header headerf headerl headerr hl hlfr
    hlinkbase hlloc hlsrc hsv htmltag info keycode keywords latentstyles lchars levelnumbers leveltext lfolevel linkval
    list listlevel listname listoverride listoverridetable listpicture liststylename listtable manager mhtmltag mmath
    nesttableprops nextfile nonesttables objalias objclass objdata object objname objsect objtime oldcprops oldpprops
    oldsprops oldtprops operator panose password passwordhash pgp pgptbl picprop pict pn pnseclvl pntext printim private
    propname protend protstart protusertbl pxe result revtbl revtim rsidtbl rxe shp shpgrp shpinst shppict shprslt shptxt
    sn sp staticval stylesheet subject sv svb tc template themedata title txe ud upr userprops wgrffmtfilter
    windowcaption writereservation writereservhash xe xmlattrname xmlattrvalue xmlclose xmlname xmlnstbl xmlopen""".split()
)
_SIGNS = {"{": "{", "}": "}", "\\": "\\", "~": "\u00a0", "_": "\u2011", "-": "\u00ad"}


def cp1252(data: bytes) -> str:
    """Windows-1252; the five bytes it leaves open stand for themselves."""
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)


def groups(source: str, control: str) -> list[str]:
    """Balanced groups that begin with the control word, outermost first, not overlapping."""
    out, at = [], 0
    while (start := source.find("{\\" + control, at)) >= 0:
        depth = 0
        for m in re.finditer(r"\\.|[{}]", source[start:], re.DOTALL):
            depth += {"{": 1, "}": -1}.get(m.group(), 0)
            if not depth:
                at = start + m.end()
                out.append(source[start:at])
                break
        else:
            break
    return out


def _fonts(source: str) -> dict[int, str]:
    group = (groups(source, "fonttbl") or [""])[0]
    names = ((int(m[1]), re.sub(r"[{}]", "", re.sub(r"\\[A-Za-z]+-?\d* ?", "", m[2])).strip()) for m in re.finditer(r"\{\\f(\d+)(.*?);\}", group, re.DOTALL))
    return {i: n for i, n in names if n}


def _colors(source: str) -> list[str]:
    group = (groups(source, "colortbl") or [""])[0]
    out = []
    for entry in group[len("{\\colortbl") :].rstrip("}").split(";")[:-1]:
        c = {k: min(255, int(v)) for k, v in re.findall(r"\\(red|green|blue)(\d+)", entry)}
        out.append(f"#{c['red']:02X}{c['green']:02X}{c['blue']:02X}" if len(c) == 3 else "")
    return out or [""]


def _pictures(source: str) -> list[dict]:
    kinds = (("\\pngblip", "png"), ("\\jpegblip", "jpg"), ("\\emfblip", "emf"), ("\\wmetafile", "wmf"), ("\\dibitmap", "dib"))
    heads = {"png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff"}
    out = []
    for i, g in enumerate(groups(source, "pict"), 1):
        kind = next((k for mark, k in kinds if mark in g), "raw")
        runs = [re.sub(r"\s", "", m.group()) for m in re.finditer(r"(?:[0-9a-fA-F]{2}[ \t\r\n]*){16,}", g)]
        data = bytes.fromhex(max(runs, key=len)) if runs else b""
        start = data.find(heads[kind]) if kind in heads else 0
        data = data[max(start, 0) :]
        if not data:
            continue
        im = image(f"rtf-image-{i}.{kind}", data, fmt=kind)
        goal = [int(m[1]) / 20 if (m := re.search(rf"\\{w}(-?\d+)", g)) and int(m[1]) > 0 else 0.0 for w in ("picwgoal", "pichgoal")]
        im["bounds"] = rect(0, 0, goal[0] or im["width"] * 0.75, goal[1] or im["height"] * 0.75)
        out.append(im)
    return out


@dataclass(frozen=True)
class State:
    skip: bool = False
    font: int = 0
    size: float = 12.0
    color: int = 0
    fallback: int = 1
    in_table: bool = False


class _Reader:
    def __init__(self, source: str):
        self.source, self.fonts, self.colors, self.pictures = source, _fonts(source), _colors(source), _pictures(source)
        self.state, self.stack, self.spans, self.here = State(), [], [], Paragraph()
        self.done: list[Paragraph] = []
        self.width, self.height = 612.0, 792.0
        self.table = self.serial = self.row = self.column = self.first = 0
        self.row_ended = False

    def write(self, text: str) -> None:
        s = self.state
        if s.skip or not text:
            return
        color = (self.colors[s.color] if 0 <= s.color < len(self.colors) else "") or "#000000"
        new = run(text, None, self.fonts.get(s.font, ""), s.size, color)
        if self.spans and all(self.spans[-1][k] == new[k] for k in ("font", "size", "color")):
            self.spans[-1]["text"] += text
        else:
            self.spans.append(new)

    def paragraph(self) -> None:
        if self.spans or self.here.images:
            if self.here.images or any(s["text"].strip() for s in self.spans):
                self.here.runs = self.spans
                self.done.append(self.here)
            self.spans, self.here = [], Paragraph()

    def page_break(self) -> None:
        self.paragraph()
        if self.done:
            self.done[-1].break_after = True

    def open_table(self) -> None:
        if not self.table:
            self.serial += 1
            self.table, self.row, self.column = self.serial, 0, 0
            return True
        return False

    def next_row(self) -> None:
        self.row, self.column, self.row_ended = self.row + 1, 0, True

    def cell(self, row_end: bool) -> None:
        self.paragraph()
        if self.open_table():
            self.first = max(0, len(self.done) - 1)
        for p in self.done[self.first :]:
            p.table, p.row, p.column, p.row_span, p.col_span = self.table, self.row, self.column, 1, 1
        if self.done:
            self.done[-1].separator = "\n" if row_end else "\t"
        if row_end:
            self.next_row()
        else:
            self.column += 1
        self.first = len(self.done)

    def control(self, word: str, value: int | None) -> None:
        s = self.state
        plain = {"font": 0, "size": 12.0, "color": 0}
        if word == "par":
            self.paragraph()
            if self.row_ended and not s.in_table:
                self.table, self.row_ended = 0, False
        elif word == "trowd":
            self.open_table()
            self.first, self.row_ended = len(self.done), False
        elif word == "intbl":
            self.state = replace(s, in_table=value != 0)
        elif word == "cell":
            self.cell(False)
        elif word == "row":
            if self.first < len(self.done) or self.spans or self.here.images:
                self.cell(True)
            elif self.done:
                self.done[-1].separator = "\n"
                self.next_row()
        elif word in ("line", "tab"):
            self.write("\n" if word == "line" else "\t")
        elif word == "page":
            self.page_break()
        elif word == "pard":
            self.state = replace(s, in_table=False, **plain)
        elif word == "plain":
            self.state = replace(s, **plain)
        elif value is not None:
            if word == "f":
                self.state = replace(s, font=value)
            elif word == "fs":
                self.state = replace(s, size=max(0.0, value / 2))
            elif word == "cf":
                self.state = replace(s, color=value)
            elif word == "uc" and value >= 0:
                self.state = replace(s, fallback=value)
            elif word == "paperw":
                self.width = value / 20
            elif word == "paperh":
                self.height = value / 20

    def read(self) -> list[Paragraph]:
        starred, skip_chars, section, shown, pending = False, 0, False, 0, bytearray()

        def settle() -> None:
            if pending:
                self.write(cp1252(bytes(pending)))
                pending.clear()

        for m in _token.finditer(self.source):
            if m["hex"]:
                if skip_chars:
                    skip_chars -= 1
                else:
                    pending.append(int(m["hex"], 16))
                continue
            if not m["text"]:
                settle()
            if m["brace"] == "{":
                self.stack.append(self.state)
            elif m["brace"]:
                self.state, starred = (self.stack.pop() if self.stack else self.state), False
            elif m["sign"]:
                starred = starred or m["sign"] == "*"
                self.write(_SIGNS.get(m["sign"], ""))
            elif m["word"]:
                word, value = m["word"], int(m["arg"]) if m["arg"] else None
                if word == "pict":
                    self.here.images += self.pictures[shown : shown + 1]
                    shown += 1
                if starred or word in DESTINATIONS:
                    self.state, starred = replace(self.state, skip=True), False
                elif self.state.skip:
                    continue
                elif word == "u":
                    if value is not None:
                        value += 65536 * (value < 0)
                        self.write(chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else "\ufffd")
                        skip_chars = self.state.fallback
                elif word == "sect":
                    self.paragraph()
                    section = True
                elif word in ("sbkpage", "sbkodd", "sbkeven", "sbknone", "sbkcol"):
                    if section and word not in ("sbknone", "sbkcol"):
                        self.page_break()
                    section = False
                else:
                    self.control(word, value)
            elif not self.state.skip:
                settle()
                text = m["text"].replace("\r", "").replace("\n", "")
                drop = min(skip_chars, len(text))
                skip_chars -= drop
                self.write(text[drop:])
        settle()
        self.paragraph()
        return self.done


def parse(data: bytes) -> dict:
    if not data[:16].lstrip(b" \t\r\n").startswith(b"{\\rtf"):
        raise FormatError("not an RTF file")
    reader = _Reader(data.decode("latin-1"))
    paragraphs = reader.read()
    return document("rtf", "layout-estimated", paginate(paragraphs, Options(reader.width, reader.height)))
