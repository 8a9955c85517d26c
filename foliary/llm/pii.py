"""Problem 3: personal information inside free text.

Spans that may be an item are the nodes of a conditional random field over a record. Each has a potential from features
of its form, its words and what stands beside it; neighbouring spans are chained, and distant spans that repeat a text
or share a name's word are joined by skip edges, along which loopy message passing brings their labels into line. The
word lists (given names, family names) are counted over all records; the weights of features and edges are learned by
pseudo-likelihood from reliable places of a bounded sample (SAMPLE).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import records

SAMPLE = 12_000
#: So many rows are looked through for the sample, by hash.
LOOKED = 16 * SAMPLE
BITS, EPOCHS, SWEEPS = 15, 60, 4
#: A word is a name if it was seen so often, and makes this share of all sightings of its list.
SEEN, SHARE = 2, 1 / 20_000
TYPES = ("email", "phone", "id_number", "address", "name")
#: One-to-one stand-ins, so that places in the text stay the same.
_plain = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)} | dict.fromkeys([0xA0, 0x2000, *range(0x2002, 0x200B), 0x202F, 0x205F, 0x3000], 32) | {0x2011: 45, 0x2010: 45}
_odd = re.compile("[\u00a0\u2000-\u2011\u202f\u205f\u3000\uff01-\uff5e]")
_hidden = re.compile("[­​-‏⁠﻿]")
_accent = re.compile("[̀-ͯ]")
_marks = re.compile(f"{_hidden.pattern}|{_accent.pattern}")

U = "A-ZÀ-ÖØ-ÞА-ЯЁ"
L = "a-zß-öø-ÿа-яё"
W = f"[{U}][{L}{U}]*(?:[-’'][{U}]?[{L}]+)*"
EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|\s?(?:\(at\)|\[at\])\s?)[A-Za-z0-9-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\])\s?)[A-Za-z0-9-]+)+", re.I)
NUMBER = re.compile(r"(?<![A-Za-z0-9_./+<-])(?:\(?\+\d{1,3}\)?[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d[\d .()/-]{5,22}[\dX](?:-?[A-Z])?(?:,?\s(?:ext\.?|x)\s?\d{1,5})?(?![A-Za-z0-9_/]|-\d|\n?-\n?[A-Z]{2}|\.\d)")
NINO = re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])|(?<![\w-])[XYZ]-?\d{7}-?[A-Z](?![\w-])")
_town = rf"{W}(?:-{W}){{0,2}}"
STREETS = "Street|Road|Lane|Close|Mews|Avenue|Way|Drive|Court|Terrace|Crescent|Square|Hill|Row|Walk|Gardens|St|Rd|Ave"
ADDRESS = [
    re.compile(rf"(?:(?:Flat|Apt\.?|Unit|Suite) \d+\s?[a-zA-Z]?,\s)?\d{{1,5}}[a-zA-Z]?\s(?:{W}\s){{1,3}}(?:{STREETS})\b\.?(?:,\s(?:Apt\.?|Flat|Unit|Suite|Floor)\s\d+\s?[a-zA-Z]?)?(?:,\s{W})?(?:,?\s[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}}|,?\s[A-Z]{{2}}\s\d{{5}})?"),
    re.compile(rf"\bP\.?\s?O\.? Box \d+(?:,\s{W})?(?:,?\s[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}}|,?\s[A-Z]{{2}}\s\d{{5}})?"),
    re.compile(rf"\b[{U}][{L}]+(?:str\.|straße|strasse|gasse|weg|allee|platz|ring|damm|ufer)\s\d{{1,4}}\s?[a-z]?(?:,\s\d{{5}}\s{_town})?"),
    re.compile(rf"\b(?:Am|An der|An den|Im|Auf der|Zum|Zur)\s{W}(?:\s{W})?\s\d{{1,4}}\s?[a-z]?,\s\d{{5}}\s{_town}"),
    re.compile(rf"\bPostfach\s\d[\d ]*\d(?:,\s\d{{5}}\s{_town})?"),
    re.compile(rf"\b\d{{1,4}}(?:\s(?:bis|ter|quater))?,?\s(?:[Rr]ue|RUE|[Aa]venue|[Bb]oulevard|[Bb]d|[Pp]lace|[Ii]mpasse|[Cc]hemin|[Aa]llée|[Qq]uai|[Rr]oute|[Cc]ours)\s(?:(?:de|du|des|la|le|d’|l’)\s?)*{W}(?:-{W})?(?:,\s(?:apt\.?|bât\.?|appartement)\s\w+)?(?:,\s\d{{5}}\s{_town})?"),
    re.compile(rf"\b(?:BP|B\.P\.)\s\d+(?:,\s\d{{5}}\s{_town})?"),
    re.compile(rf"(?:\bC/|\b(?:Calle|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|P\.º|Ctra\.?|Camino))\s?(?:(?:de|del|la|las|los|el)\s)*{W}(?:\s{W})?,\s(?:n\.º\s)?\d{{1,4}}(?:,\s\d{{1,2}}\.?\s?[ºª°o]\.?\s?[A-Za-z]{{1,5}}\.?)?(?:,\s\d{{5}}\s{_town})?"),
    re.compile(rf"\b(?:Apdo\.?|Apartado)(?:\sde\scorreos)?\s\d+(?:,\s\d{{5}}\s{_town})?", re.I),
    re.compile(rf"\bг\.\s{W}(?:-{W})?,\s(?:(?:ул|пер|просп|пр|пл|наб|ш|б-р)\.?\s{W}(?:\s{W})?,\s(?:д\.\s?\d+[а-я]?)(?:,\s(?:корп|стр)\.\s?\d+)?(?:,\s(?:кв|оф)\.\s?\d+)?|а/я\s\d+)|\b(?:ул|пер|просп)\.\s{W},\s(?:д\.\s?\d+[а-я]?)(?:,\s(?:кв|оф)\.\s?\d+)?(?:,\sг\.\s{W})?|\bа/я\s\d+(?:,\s(?:\d{{6}}\s)?(?:г\.\s)?{W})?"),
    re.compile(r"[一-鿿]{1,6}?(?:省|自治区)?[一-鿿]{1,5}?(?:市|县|州)(?:[一-鿿]{1,5}?(?:区|县|镇|乡))?(?:[一-鿿]{1,5}?(?:镇|乡))?[一-鿿]{1,6}?(?:(?:路|街|大道|巷|道)\s?\d{1,5}\s?号(?:\d{1,4}(?:栋|幢|号楼))?(?:\d{1,2}单元)?(?:\d{1,5}(?:室|房))?|村(?:\d{1,4}组|\d{1,4}号))"),
    re.compile(r"[一-鿿ァ-ヺー]{1,8}[都道府県][一-鿿ァ-ヺー]{1,10}?[市区郡](?:[一-鿿ァ-ヺー]{1,8}?区)?[一-鿿ァ-ヺー]{1,10}?(?:[町村丁])?\s?\d{1,4}(?:[-−]\d{1,4}){1,3}(?:[-−]?\d{1,4}号室?)?|[一-鿿ァ-ヺー]{1,8}[都道府県][一-鿿ァ-ヺー]{1,10}?[市区郡][一-鿿ァ-ヺー]{1,10}?\d{1,3}丁目\d{1,3}番地?(?:\d{1,3}号)?"),
]
ADDRESS = [re.compile(p.pattern.replace(r"\s", "[ \n]")) for p in ADDRESS]
#: A text without any of these has no address of the form at the same place of ADDRESS.
_streets = tuple(f" {x}" for x in STREETS.split("|"))
TRIGGERS = [
    _streets, ("Box ",), ("str.", "straße", "strasse", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer"), ("Am ", "An ", "Im ", "Auf ", "Zum ", "Zur "), ("Postfach",),
    ("ue ", "RUE", "oulevard", "d ", "lace ", "mpasse", "hemin", "llée", "uai ", "oute ", "ours "), ("BP ", "B.P."), ("C/", "Calle", "Avda", "Avenida", "Plaza", "Pza", "Paseo", "P.º", "Ctra", "Camino"), ("Apdo", "partado"), ("г. ", "ул. ", "а/я", "пер. ", "просп. ", "г.\n"), ("号", "组"), ("県", "都", "府", "道"),
]
#: Forms that need letters beyond ASCII.
BEYOND_ASCII = (9, 10, 11)
_numbered = {5: re.compile(r"\d(?:[ \n](?:bis|ter|quater))?,?[ \n](?:[Rr]ue|RUE|[Aa]v|[Bb]|[Pp]l|[Ii]mp|[Cc]h|[Aa]ll|[Qq]u|[Rr]ou|[Cc]ou)"), 3: re.compile(r"\d{5}"), 0: re.compile(r"\d[a-zA-Z]?[ \n][A-Z]"), 10: re.compile(r"[路街道巷村] ?\d"), 11: re.compile(r"\d-\d|丁目")}
#: What leads to an address and is no part of it.
_lead = re.compile(r"^.*(?:寄往|现住址?|住在|住址[是为]?|地址[是为：:]?|位于|送至|送往|住所[はは：:]?|住于)")
_digit = re.compile("[0-9]")
_digits = re.compile(r"\d[\d ().-]{5,}\d|\d{7}|\d\) ?\d{5}")
#: Words that lead to a number of the kind, and words that lead away from it.
ID_CUES = re.compile(r"(?i)(?:\bID|identity|holder|claimant|national insurance|\bssn\b|social security|tax|steuer|ausweis|\bdni\b|\bnie\b|\bnif\b|снилс|инн|паспорт|身份证|证件|個人番号|マイナンバー|sécurité sociale|le numéro|die nummer|आधार|बत्तर|บัตร|card of)")
PHONE_CUES = re.compile(r"(?i)(?:reached at|call|phone|tel|mobil|fon|unter|répond au|appeler|atiende en|llame al|телефон|тел\.|звон|手机|电话|電話|携帯|โทร|फ़ोन|フォン| or | oder | ou | o )")
NOT_CUES = re.compile(r"(?i)(?:zähler|meter|compteur|contador|счётчик|表号|流水号|tracking|batch|order|lot\b|lote|charge|version|firmware|driver|serial|no\.|nr\.|n\.º|n°|№|box|art\.|order no|партия|заказ|накладн|订单|编号|表格|型号|注文|(?<!個人)番号|fig|sec|abs)\W{0,3}$")
FIRM = re.compile(r"(?i)\s*(?:&|und\b|et fils|y cía|ltd|inc|llc|gmbh|ag\b|kg\b|co\.|s\.?a\.?|s\.?l\.?|sarl|ооо|оао|dept|street|road|lane|avenue|close|mews|gate|review|study|handbook|manual|office|depot)")
LATIN_CUES = re.compile(rf"(?:attention of|[Aa]pplicant:?|contact|[Yy]esterday|met|checked by|Antragsteller(?:in)?|wenden Sie sich an|z\. ?Hd\.(?: von)?|an|attention de|écrire à|demandeur|demanderesse|[Ll]a solicitante|[Ee]l solicitante|atención de|escriba a|[Зз]аявитель|получатель|Вчера|напишите|обратитесь к)\s+((?:[{U}][{L}{U}]+(?:-[{U}][{L}]+)?)(?:,? (?:[{U}]\. ?){{0,2}}[{U}][{L}{U}]+(?:-[{U}][{L}]+)?)?)|(?:^|[.!?]\s+|\n)((?:[{U}][{L}]+) (?:[{U}]\. )?(?:[{U}][{L}]+(?:-[{U}][{L}]+)?))\s+(?:moved to|wohnt\s+in|habite|vive en|живёт|signed|\()|(?:^|[\n\t|]|[•·*▪–-] ) ?((?:[{U}][{L}]+) (?:[{U}]\. )?(?:[{U}][{L}]+(?:-[{U}][{L}]+)?)), (?=[^\s,]+(?:@|\(at|\[at)|[+(]?\d)")
ZH_CUES = re.compile(r"(?:申请人|收件人|联系|请联系)([一-鿿]{2,4})(?=[，。,（\n]|$)|(?:^|[。！？，\n])([一-鿿]{2,4})(?=的手机)")
JA_CUES = re.compile(r"(?:申請者|担当者は|受取人)([一-鿿]{2,4} ?[一-鿿]{2})(?=[、，])|の([一-鿿]{2,4} ?[一-鿿]{2})(?=宛て)")
_word = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
GATE = r"\d[\d .()/-]{5,}\d|@|\((?i:at)\)|\[(?i:at)\]|\p{Lu}|[a-z]{3}|[\p{IsHan}]{2}"


def flat(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters, and the place of each in the original (None: the same)."""
    if text.isascii():
        return text, None
    t = text.translate(_plain) if _odd.search(text) else text
    if _marks.search(t):
        import unicodedata

        out, at = [], []
        for i, c in enumerate(t):
            if _hidden.match(c):
                continue
            if _accent.match(c) and out:
                both = unicodedata.normalize("NFC", out[-1] + c)
                if len(both) == 1:
                    out[-1] = both
                    continue
            out.append(c)
            at.append(i)
        return "".join(out), [*at, len(t)]
    return t, None


def sightings(raw: str) -> Iterator[tuple[str, str]]:
    """(list, word) of the names in the reliable places of a text."""
    t = flat(raw)[0]
    for m in LATIN_CUES.finditer(t):
        n = m.group(1) or m.group(2) or m.group(3)
        parts = [p for p in re.split(r"[ ,]+", n) if len(p) > 2]
        if len(parts) == 2:
            first, last = parts[::-1] if "," in n else parts
            yield "given", first.lower()
            yield "family", last.lower()
    if t.isascii():
        return
    for m in ZH_CUES.finditer(t):
        n = m.group(1) or m.group(2)
        k = 2 if len(n) == 4 else 1
        if len(n) > 2:
            yield "zs", n[:k]
            yield "zg", n[k:]
    for m in JA_CUES.finditer(t):
        n = (m.group(1) or m.group(2)).replace(" ", "")
        yield "jf", n[:-2]
        yield "jg", n[-2:]


class Lexicon:
    """Given and family names seen in reliable places; counts: how often by (list, word)."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        by: dict[str, Counter] = defaultdict(Counter)
        for (k, w), n in counts.items():
            by[k][w] += n
        often = lambda k: {w for w, n in by[k].items() if n >= max(SEEN, SHARE * by[k].total())}
        self.family, self.zs, self.jf, self.jg, self.zg = map(often, ("family", "zs", "jf", "jg", "zg"))
        self.given = {w for w in often("given") if by["given"][w] >= 0.5 * by["family"][w]}
        self.names = self.given | self.family
        either = lambda ws: "(?:" + "|".join(sorted(map(re.escape, ws), key=lambda w: (-len(w), w))) + ")"
        self.zh = re.compile(f"{either(self.zs)} ?{either(self.zg)}") if self.zs and self.zg else None
        self.ja = re.compile(f"{either(self.jf)} ?{either(self.jg)}") if self.jf and self.jg else None


#: Dates and addresses of machines; decimal numbers in a row; numbers of orders.
_date = re.compile(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{1,3}(?:\.\d{1,3}){3}|\d{4}/\d{2}")
_measures, _code = re.compile(r"(?=.*\.)\d{1,5}(?:\.\d{1,2})?(?: \d{1,5}(?:\.\d{1,2})?)*"), re.compile(r"\d/\d{2}-")
_han = re.compile("[一-鿿]")
_two_initials = re.compile(r"[А-ЯЁ]\.\s?[А-ЯЁ]\.")
_after = re.compile(rf"\s((?:[{U}]\.\s?){{0,2}})({W}|[{L}]+(?:-[{L}]+)?)")
_before = re.compile(rf"({W}|[{U}]{{2,}}),\s$")
_initials = re.compile(rf"\s(?:[{U}]\.\s?){{1,2}}(?<=\.)")


def spans(t: str, lex: Lexicon) -> list[tuple[int, int, str, str]]:
    """(start, end, type, form) of everything that may be an item; addresses before the rest, overlaps allowed."""
    out: list[tuple[int, int, str, str]] = []
    if "@" in t or "at" in t.lower() and ("(" in t or "[" in t):
        out += [(m.start(), m.end(), "email", "email") for m in EMAIL.finditer(t)]
    if _digit.search(t):
        for m in NUMBER.finditer(t) if _digits.search(t) else ():
            s = re.split(r"(?<!ext)\.\s|  ", m.group())[0]
            if _measures.fullmatch(s) or _code.search(s) or _date.fullmatch(s):
                continue
            form = re.sub(r"\d+", lambda d: str(len(d.group())), s)
            k = sum(c.isdigit() for c in s)
            if k >= 7:
                out.append((m.start(), m.start() + len(s), number_type(s, form, k), form))
        out += [(m.start(), m.end(), "id_number", "nino") for m in NINO.finditer(t)]
        ascii_ = t.isascii()
        for i, p in enumerate(ADDRESS):
            if ascii_ and i in BEYOND_ASCII:
                continue
            if any(map(t.__contains__, TRIGGERS[i])) and (i not in _numbered or _numbered[i].search(t)):
                for m in p.finditer(t):
                    cut = _lead.match(m.group()) if i > 9 else None
                    out.append((m.start() + (cut.end() if cut else 0), m.end(), "address", f"a{i}"))
    given, family = lex.given, lex.family
    taken = -1
    hopeful = not lex.names.isdisjoint(_word.findall(t.lower())) or (not t.isascii() and _two_initials.search(t))
    for m in _word.finditer(t) if hopeful else ():
        w = m.group()
        low = w.lower()
        if m.start() < taken:
            continue
        if low in given:
            a, e, form = m.start(), m.end(), ""
            n = _after.match(t, e)
            b = _before.search(t[max(0, a - 40) : a])
            if b and (not n or not n.group(2)[0].isupper() or b.group(1).lower() in family) and (b.group(1).lower() in family or not (n and n.group(2)[:1].isupper())):
                a, form = a - len(b.group()), "comma"
                i = re.compile(rf"(?:\s[{U}]\.){{1,2}}").match(t, e)
                e = i.end() if i else e
            elif n and (n.group(2)[0].isupper() or (w.islower() and len(n.group(2)) > 3)):
                e, form = n.end(), "full" if n.group(2).lower() in family else "new"
                if w.islower():
                    form += "low"
            if form:
                out.append((a, e, "name", form))
                taken = e
        elif low in family:
            i = _initials.match(t, m.end())
            if i and t[m.start()].isupper():
                out.append((m.start(), i.end(), "name", "initials"))
                taken = i.end()
        elif len(w) > 5 and w[0].isupper() and "А" <= w[0] <= "я":
            i = re.compile(r"\s[А-ЯЁ]\.\s?[А-ЯЁ]\.").match(t, m.end())
            if i:
                out.append((m.start(), i.end(), "name", "initials"))
    han = not t.isascii() and (lex.zh is not None or lex.ja is not None) and _han.search(t)
    if lex.zh is not None and han:
        out += [(m.start(), m.end(), "name", "zh") for m in lex.zh.finditer(t)]
    if lex.ja is not None and han:
        out += [(m.start(), m.end(), "name", "ja") for m in lex.ja.finditer(t)]
    return out


def number_type(s: str, form: str, k: int) -> str:
    if re.fullmatch(r"\d{2}\.\d{3}\.\d{3}-?[A-Z]", s):
        return "id_number"
    if "+" in s or "(" in s or "ext" in s or "x" in s[1:]:
        return "phone"
    if re.fullmatch(r"8[-]?[A-Z]", form) or k == 18 or (k == 17 and s[-1] == "X") or k in (15,) or form in ("3-2-4", "3 2 4", "2 3 3 3", "11", "3-3-3 2", "12", "4 4 4", "4-4-4", "13", "1-4-5-2-1", "1 4 5 2 1", "9", "3 3 3"):
        if form == "11" and s[0] == "1" and s[1] in "3456789":
            return "phone"
        return "id_number"
    return "phone"


def _features(t: str, node: tuple[int, int, str, str], lex: Lexicon) -> list[str]:
    a, e, kind, form = node
    left, right = t[max(0, a - 24) : a], t[e : e + 16]
    lw = _word.findall(left)[-2:]
    rw = _word.findall(right)[:1]
    alone = (not left.strip(" ") or left.rstrip(" ")[-1:] in "\t\n|") and (not right.strip(" ") or right.lstrip(" ")[:1] in "\t\n|,")
    f = [kind, f"{kind}|{form}", f"{kind}|alone{alone}", f"{kind}|l={lw[-1].lower() if lw else left[-1:]}", f"{kind}|ll={left[-2:]}", f"{kind}|r={rw[0].lower() if rw else right[:1]}", f"{kind}|rc={right[:1]}"]
    if kind in ("phone", "id_number"):
        f += [f"{kind}|id{bool(ID_CUES.search(left))}", f"{kind}|ph{bool(PHONE_CUES.search(left))}", f"{kind}|not{bool(NOT_CUES.search(left))}", f"{kind}|n{sum(c.isdigit() for c in t[a:e])}"]
    if kind == "name":
        parts = [p.lower() for p in _word.findall(t[a:e])]
        f += [f"name|firm{bool(FIRM.match(right))}", f"name|s{bool(parts) and parts[-1] in lex.family}", f"name|up{t[a:e].isupper()}", f"name|amp{left.rstrip()[-1:] == '&'}", *(f"w={p}" for p in parts)]
    return f


def _reliable(t: str, node: tuple[int, int, str, str]) -> int | None:
    a, e, kind, form = node
    left, right = t[max(0, a - 24) : a], t[e : e + 24]
    if kind == "email":
        return 1
    if kind in ("phone", "id_number"):
        if NOT_CUES.search(left):
            return 0
        s = t[a:e]
        if re.search(r"[./]\d{1,2}$", s) and s.count(".") == 1:
            return 0
        if kind == "id_number" and (ID_CUES.search(left) or form == "nino"):
            return 1
        if kind == "phone" and (s[0] == "+" or PHONE_CUES.search(left) or "ext" in s):
            return 1
        return None
    if kind == "address":
        return 1
    if FIRM.match(right) or left.rstrip()[-1:] == "&":
        return 0
    if form in ("full", "comma", "initials", "zh", "ja"):
        return 1
    if form == "new" and re.search(r"(?:of|[Aa]pplicant:?|contact|met|by|steller|teller|à|a|de|solicitante|заявитель|Заявитель|получатель)\s$", left):
        return 1
    return None


def _hash(f: str) -> int:
    return zlib.crc32(f.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1


def edges(t: str, nodes: list[tuple[int, int, str, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Neighbouring spans, and spans that share a text or, for names, a word; nodes in order."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if 0 <= nodes[i + 1][0] - nodes[i][1] < 40]
    skip, same = {}, {}
    for i, (a, e, kind, _) in enumerate(nodes):
        # each node is joined to the last one that shares its text or a word: a chain, never all pairs
        for w in {t[a:e].lower(), *(_word.findall(t[a:e].lower()) if kind == "name" else ())}:
            j = same.get((kind, w))
            if j is not None and j != i:
                skip[j, i] = None
            same[kind, w] = i
    return chain, list(skip)


class Field:
    """Lists, weights and inference."""

    def __init__(self, texts: list[str], lexicon: Lexicon | None = None):
        self.lex = lexicon or Lexicon(Counter(s for t in texts for s in sightings(t)))
        rows = []
        for raw in texts:
            t = flat(raw)[0]
            nodes = sorted(spans(t, self.lex))
            labels = [_reliable(t, n) for n in nodes]
            beside = [[0.0, 0.0] for _ in nodes]
            for k, pairs in enumerate(edges(t, nodes)):
                for i, j in pairs:
                    for a, b in ((i, j), (j, i)):
                        if labels[b] is not None:
                            beside[a][k] += 2 * labels[b] - 1
            rows += [([_hash(f) for f in _features(t, n, self.lex)], y, c) for n, y, c in zip(nodes, labels, beside, strict=True) if y is not None]
        # so that a kind never seen rejected is not taken as always wrong, weights start from a slight yes
        self.weights = np.zeros(1 << BITS)
        for k in TYPES:
            self.weights[_hash(k)] = 1.0
        #: What a neighbour with a label, and one that shares its text, add to the log-odds.
        self.pull = np.full(2, 0.3)
        if rows:
            at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
            ids = np.fromiter((i for r in rows for i in r[0]), np.int64)
            y, near = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
            power, power2 = np.full(1 << BITS, 1e-6), np.full(2, 1e-6)
            for _ in range(EPOCHS):
                p = 1 / (1 + np.exp(-np.bincount(at, self.weights[ids], len(rows)) - near @ self.pull))
                g = np.bincount(ids, (p - y)[at], 1 << BITS) + 1e-3 * self.weights
                h = (p - y) @ near + 1e-3 * self.pull
                power += g * g
                power2 += h * h
                self.weights -= 0.3 * g / np.sqrt(power)
                # labels that repeat never push each other apart
                self.pull = np.clip(self.pull - 0.1 * h / np.sqrt(power2), 0.05, 4.0)
        self.weights = self.weights.astype(np.float32)
        self._list: list[float] | None = None

    def items(self, raw: str | None) -> list[tuple[int, int, str]]:
        """(start, end, type) of the items of a text, in order and without overlaps; [] for null and empty texts."""
        if not raw:
            return []
        t, at = flat(raw)
        nodes = spans(t, self.lex)
        if not nodes:
            return []
        nodes.sort()
        if self._list is None:
            self._list = self.weights.tolist()
        w = self._list
        unary = [sum([w[_hash(f)] for f in _features(t, x, self.lex)]) for x in nodes]
        chain, skip = edges(t, nodes)
        belief = self._propagate(unary, dict.fromkeys(chain, float(self.pull[0])) | dict.fromkeys(skip, float(self.pull[1])))
        chosen: list[tuple[int, int, str]] = []
        size = lambda x: x[1] - x[0]
        for i in sorted(range(len(nodes)), key=lambda i: (-(nodes[i][2] in ("address", "email")), -size(nodes[i]), -belief[i], nodes[i][0])):
            if belief[i] > 0 and all(nodes[i][1] <= a or nodes[i][0] >= e for a, e, _ in chosen):
                chosen.append(nodes[i][:3])
        chosen.sort()
        return [(at[a], at[e - 1] + 1, k) if at else (a, e, k) for a, e, k in chosen]

    @staticmethod
    def _propagate(unary: list[float], edges: dict[tuple[int, int], float]) -> list[float]:
        """Loopy belief propagation in log-odds for binary labels with attractive edges."""
        if not edges:
            return list(unary)
        pull = {d: math.tanh(w / 2) for (i, j), w in edges.items() for d in ((i, j), (j, i))}
        msg = dict.fromkeys(pull, 0.0)
        for _ in range(SWEEPS):
            total = list(unary)
            for (_, j), m in msg.items():
                total[j] += m
            msg = {(i, j): 2 * math.atanh(w * math.tanh(max(-30.0, min(30.0, total[i] - msg[j, i])) / 2) * 0.999999) for (i, j), w in pull.items()}
        total = list(unary)
        for (_, j), m in msg.items():
            total[j] += m
        return total


#: What leads to a name somewhere in a text.
CUES = r"attention|[Aa]pplicant|contact|checked by|moved to|signed|Antragsteller|wohnt|habite|écrire|solicitante|vive en|escriba|аявитель|получатель|живёт|申请人|收件人|联系|手机号码|申請者|宛て|(?m)^\S+ \S+, "


def lexicon(df: DataFrame, text: str) -> Lexicon:
    """Names counted over all rows; one row per distinct name that was seen more than once comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            n.update(s for t in b.column(0).to_pylist() for s in sightings(t))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.string()), pa.array([w for _, w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["list", "word", "n"])

    seen = df.where(F.col(text).rlike(CUES)).select(text).mapInArrow(run, "list string, word string, n long").groupBy("list", "word").agg(F.sum("n").alias("n"))
    return Lexicon({(r.list, r.word): r.n for r in seen.where(F.col("n") >= SEEN).collect()})


def train(df: DataFrame, key: str, text: str = "text", size: int = SAMPLE) -> Field:
    """Lists from all rows, weights from at most `size` rows that hold a leading word, those with the least hash among the
    LOOKED rows that are looked through."""
    n = df.count()
    h = F.xxhash64(key)
    rows = df if n <= LOOKED else df.where(F.pmod(h, F.lit(1 << 30)) < int(LOOKED / n * (1 << 30)))
    # the least hashes in the same order at every number of rows
    some = rows.where(F.col(text).rlike(CUES)).select(F.pmod(h, F.lit(1 << 30)).alias("h"), F.col(text).alias("t")).orderBy("h", "t").limit(size)
    return Field([r.t for r in some.collect()], lexicon(df, text))


def find(df: DataFrame, field: Field, keys: list[str], text: str = "text") -> DataFrame:
    """(*keys, pii_type, pii_text, start_pos), one row per item. Null and empty texts have none; repeated rows repeat
    their items."""
    sent = df.sparkSession.sparkContext.broadcast(field)  # bounded by the sample and 2^BITS weights
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                for a, e, k in field.items(t):
                    at.append(i)
                    out.append((k, t[a:e], a))
            take = pa.array(at, pa.int64())
            new = [pa.array([o[j] for o in out], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(take) for j in range(len(keys))), *new], names=[*keys, "pii_type", "pii_text", "start_pos"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", pii_type string, pii_text string, start_pos int"
    return df.where(F.col(text).rlike(GATE)).select(*keys, F.col(text).alias("_t")).mapInArrow(run, schema)


def redact(df: DataFrame, field: Field, keys: list[str], text: str = "text") -> DataFrame:
    """All rows (*keys, text) with every item replaced by [TYPE]; null texts stay null."""
    sent = df.sparkSession.sparkContext.broadcast(field)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def masked(t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for a, e, k in sent.value.items(t):
            out += [t[at:a], f"[{k.upper()}]"]
            at = e
        return "".join(out) + t[at:]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{text: [masked(t if isinstance(t, str) else None) for t in f[text]]})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{text}` string"
    return df.select(*keys, text).mapInPandas(run, schema)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    found = find(rows, train(rows, "record_id"), ["record_kind", "record_id"])
    return found.select("record_kind", "record_id", "pii_type", "pii_text").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and cell with placeholders."""
    rows = records(spark, sf_dir)
    return redact(rows, train(rows, "record_id"), ["record_kind", "record_id"])


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}
SQL: dict[str, str] = {}
