"""Whitespace, date and identifier normalization of Chinese page text, as rules over runs of white space.

A text is cut into solid stretches and white-space runs; each rule decides for a run or a digit cluster which of its
characters go. Row ends of tab-separated rows are set aside first, so that no rule joins rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import regex as re

INLINE = " \u00a0\u3000"
LAYOUT = INLINE + "\t\r\n"
COMPONENT = INLINE + "\r\n"
#: Stands for a row end while rules run; never part of a rule's white space that may go.
ROW = chr(0xE002)
_space = re.compile(rf"[\s\x85{INLINE}{ROW}]+")
_chinese = re.compile(r"[\p{Han}　-〿！-･·—…‘’“”《》〈〉【】〔〕（），。！？；：、]")
_breaks = re.compile(r"\r\n|\r|\n")
CONNECTORS = "-－–—~～至"
_year = re.compile(rf"[0-9][0-9{LAYOUT}]*(?=年)")
_part = re.compile(rf"([0-9][0-9{COMPONENT}]*)(?:(?=([月日]))|(个[{COMPONENT}]*工[{COMPONENT}]*作[{COMPONENT}]*日))")


def _row_ends(text: str) -> set[int]:
    """Places of line-break characters next to a line that holds a tab."""
    if "\t" not in text:
        return set()
    out: set[int] = set()
    cuts = list(_breaks.finditer(text))
    edges = [0, *(m.end() for m in cuts)]
    ends = [*(m.start() for m in cuts), len(text)]
    tabbed = [("\t" in text[a:b]) for a, b in zip(edges, ends, strict=True)]
    for k, m in enumerate(cuts):
        if tabbed[k] or tabbed[k + 1]:
            out.update(range(m.start(), m.end()))
    return out


def _in(chars: str, c: str) -> bool:
    return bool(c) and c in chars


def _date_gap(solid: str, right: str) -> bool:
    """Whether white space between `solid` (its last three characters) and `right` stands inside a date or a range."""
    left, before, third = solid[-1:], solid[-2:-1], solid[-3:-2]
    digit = str.isdecimal
    if (left and digit(left) and _in("年月日", right)) or (_in("年月", left) and right and digit(right)):
        return True
    if _in(CONNECTORS, right) and (_in("年月日", left) or (left and digit(left) and _in("年月日", before))):
        return True
    if _in(CONNECTORS, left) and right and digit(right):
        return _in("年月日", before) or bool(before and digit(before) and _in("年月日", third))
    return False


def removed(text: str, rows: bool) -> set[int]:
    """Places of the white space that goes. rows: keep tabs and the ends of tab-separated rows."""
    keep = _row_ends(text) if rows else set()
    t = "".join(ROW if i in keep else c for i, c in enumerate(text)) if keep else text
    gone: set[int] = set()
    spaces = lambda a, b: (i for i in range(a, b) if t[i] in LAYOUT)
    for m in _year.finditer(t):
        digits = [c for c in m.group() if c not in LAYOUT]
        if len(digits) == 4 and 1000 <= int("".join(digits)) <= 2999:
            gone.update(spaces(*m.span()))
    for m in _part.finditer(t):
        cluster = m.group(1)
        digits = "".join(c for c in cluster if c not in COMPONENT)
        if m.group(2):
            good = len(digits) <= 2 and 1 <= int(digits) <= (12 if m.group(2) == "月" else 31)
        else:
            good = len(digits) <= 4 and "\r" not in cluster and "\n" not in cluster
        if good:
            gone.update(spaces(*m.span()))
    solid, at = "", 0
    for m in _space.finditer(t):
        solid = (solid + t[at : m.start()])[-3:]
        right = t[m.end() : m.end() + 1]
        at = m.end()
        between = bool(solid and right and _chinese.match(solid[-1]) and _chinese.match(right))
        date = _date_gap(solid, right)
        if between or date:
            gone.update(i for i in spaces(*m.span()) if t[i] != "\t" or (date and not rows))
    return gone


def squeeze(text: str, rows: bool = False) -> str:
    """The text without the white space that goes: rows=True for pages, False for cells."""
    gone = removed(text, rows)
    return "".join(c for i, c in enumerate(text) if i not in gone) if gone else text


_S = f"[{INLINE}]*"
_LINE = rf"(?:{_S}(?:(?:\r\n?|\n){_S})?)"
_spaced = lambda n: rf"[0-9](?:{_S}[0-9]){{0,{n - 1}}}"
_identifier = re.compile(
    rf"(?P<reset>[\r\n\t])"
    rf"|〔(?P<year>[0-9{INLINE}]{{4,32}})〕(?:{_S}(?P<number>{_spaced(6)}){_S}号)?"
    rf"|(?P<page>第{_S}{_spaced(6)}{_S}页{_S}共{_S}{_spaced(6)}{_S}页)"
    rf"|(?P<article>第{_S}{_spaced(4)}{_S}(?:\.{_S}{_spaced(4)}{_S}){{1,7}}(?:(?:\r\n?|\n){_S})?条)"
    rf"|(?P<ordinal>第{_LINE}[0-9]{{1,6}}(?![0-9]){_LINE}号)"
    rf"|(?P<order>国令第{_S}{_spaced(6)}{_S}号)"
    rf"|(?P<label>证券代码|证券简称|公告编号)(?P<colon>[:：])"
)
_blank = re.compile(rf"[{INLINE}\r\n]+")
_code = re.compile(rf"{_S}([0-9](?:{_S}[0-9])*)")
_notice = re.compile(rf"{_S}([0-9A-Za-z/\-－–—](?:{_S}[0-9A-Za-z/\-－–—])*)")
_name = re.compile(rf"{_S}([A-Za-z*](?:{_S}[A-Za-z*])*)(?:{_S}(?=\p{{Han}}))?")


def _value(label: str, text: str, at: int) -> tuple[str, int]:
    """What follows a field label, compacted, and where it ends; nothing if it isn't of the field's form."""
    m = {"证券代码": _code, "公告编号": _notice, "证券简称": _name}[label].match(text, at)
    if not m:
        return "", at
    token = _blank.sub("", m.group(1))
    if label == "证券代码":
        return (token, m.end()) if len(token) == 6 else ("", at)
    if label == "公告编号":
        token = re.sub("[－–—]", "-", token)
        good = len(token) >= 4 and token[0] != "-" and token[-1] != "-" and sum(c.isalnum() for c in token) >= 4
        return (token, m.end()) if good else ("", at)
    return token, m.end()


def identifiers(text: str) -> str:
    """Compact bracketed years and document numbers, page, article and ordinal references, orders, and the values of
    the three securities fields. Anything else stays."""
    gates = {"page": "页共" in text, "article": "." in text and "条" in text, "ordinal": "号" in text, "order": "国令第" in text}
    if not (("第" in text and any(gates.values())) or "证券" in text or "公告编号" in text or "〔" in text):
        return text
    out, at, seen = [], 0, False
    while True:
        m = _identifier.search(text, at)
        if not m:
            break
        out.append(text[at : m.start()])
        end, kind = m.end(), m.lastgroup
        if m.group("reset"):
            out.append(m.group())
            seen = False
        elif m.group("year"):
            year = _blank.sub("", m.group("year"))
            if len(year) == 4 and 1000 <= int(year) <= 2999:
                out.append(f"〔{year}〕" + (_blank.sub("", m.group("number")) + "号" if m.group("number") else ""))
            else:
                out.append("〔")
                end = m.start() + 1
        elif m.group("label"):
            if seen and "".join(out)[-1:].strip():
                out.append(" ")
            out.append(m.group())
            token, end = _value(m.group("label"), text, end)
            out.append(token)
            seen = True
        elif gates[kind]:
            out.append(_blank.sub("", m.group()))
        else:
            out.append(text[m.start()])
            end = m.start() + 1
        at = end
    return "".join(out) + text[at:]


def protect(text: str, tables: Sequence[str]) -> tuple[str, str]:
    """Line breaks of each multi-row TSV found in the text, and those just before and after it, turned into a marker
    that the text doesn't hold; the marker."""
    marker = chr(0xE000) + "ROW" + chr(0xE001)
    while marker in text:
        marker += chr(0xE001)
    for tsv in tables:
        if "\n" not in tsv:
            continue
        m = re.search(r"(?P<b>\r?\n)?" + re.escape(tsv) + r"(?P<a>\r\n?|\n)?", text)
        if m:
            text = text[: m.start()] + marker * bool(m["b"]) + tsv.replace("\n", marker) + marker * bool(m["a"]) + text[m.end() :]
    return text, marker


def page_text(text: str, tables: Sequence[str] = ()) -> str:
    safe, marker = protect(text, tables)
    return identifiers(squeeze(safe, rows=True).replace(marker, "\n"))


def cell_text(text: str) -> str:
    return identifiers(squeeze(text))


def run_texts(texts: Sequence[str]) -> list[str]:
    """White space is judged across run borders, identifiers within each run."""
    joined = "".join(texts)
    gone, at, out = removed(joined, rows=False), 0, []
    for t in texts:
        out.append(identifiers("".join(c for i, c in enumerate(t, at) if i not in gone)))
        at += len(t)
    return out
