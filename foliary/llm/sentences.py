"""Problem 6: sentence units across languages and scripts.

Candidates are the places after closing marks, blank lines and, in Thai, spaces; each is classified by a maximum-entropy
model over its neighbourhood. The model is fitted on reliable places of a bounded sample of pages (SAMPLE): those that
the text itself settles, such as a blank line after a full stop, or a small letter after a point. Applying it is a map
over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sample, table

#: Pages whose reliable places train the model.
SAMPLE = 4000
BITS, EPOCHS, RATE = 16, 40, 0.5
#: Common abbreviations that stand inside sentences, without their last point.
SHORT = set(
    """mr mrs ms dr prof st no nos vol fig figs sec ch p pp vs cf approx ca est ext dept ed eds ref art nr bd abs abb vgl bzw usw sog str tel co
    jr sr sra sres dra srta dña d núm num pág págs apdo avda av cap aprox izda dcha m mme mlle mm n env réf chap éd bd
    г ул д кв пер пр просп стр с см разд рис т тыс млн руб коп ок ст гл им обл стр корп шт ч напр проф доц
    e.g i.e a.k.a z.b d.h u.a z.t i.d.r o.ä s.a s.l s.l.u т.е т.д т.п т.к p.ej""".split()
)
#: Abbreviations that may end a sentence before a capital letter.
MAY_END = {"etc", "usw", "a.m", "p.m", "ltd", "inc", "corp", "шт", "руб", "s.a", "s.l", "т.д", "т.п"}
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember".split())
#: Words that lead into a German ordinal number.
ARTICLES = set("der die das den dem des am im vom zum beim zur jeder jede jedes".split())
OPEN, CLOSE = "“„«「『（(\"‘‹", "”“»」』）)\"’›"
_mark = re.compile(r"(?:\.{2,}|…+|[.!?。！？।])[.!?。！？…]*(?:[”»」』）)\"’›]|“(?!\w))*(?:\s(?=[»]))?»?|\n[ \t\r]*\n\s*|(?<=[ก-๛])[ \n]+(?=\S)|(?<=\S)[ \n]+(?=[ก-๛])")
_token = re.compile(r"\S+$")
_next = re.compile(r"\s*(\S{1,24})")
CJK = "一-鿿぀-ヿ㐀-䶿々"
_cjk, _thai = re.compile(f"[{CJK}]"), re.compile("[ก-๛]")


def _shape(w: str) -> str:
    out = []
    for c in w[:12]:
        s = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "字" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def quoted(text: str) -> list[tuple[int, int, bool]]:
    """Spans of direct speech (start, end, whether a colon or a comma leads into it), within one paragraph."""
    pairs = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』"}
    out, i, stop = [], 0, 0
    while i < len(text):
        if text[i] in pairs:
            if stop <= i:  # the end of the paragraph, found once
                stop = text.find("\n\n", i)
                stop = len(text) if stop < 0 else stop
            j = text.find(pairs[text[i]], i + 1, stop)
            if j > 0:
                out.append((i, j, text[:i].rstrip()[-1:] in (":", "：", ",", "，")))
                i = j
        i += 1
    return out


def candidates(text: str) -> list[dict]:
    """Every place where a sentence may begin: pos (of the next sentence's first character) and its surroundings."""
    spans, out = quoted(text), []
    at = 0
    for m in _mark.finditer(text):
        end = m.end()
        rest = _next.match(text, end)
        if not rest:
            continue
        pos = rest.start(1)
        while at < len(spans) and spans[at][1] < m.start():
            at += 1
        inside = led = closing = False
        if at < len(spans) and spans[at][0] < m.start() <= spans[at][1]:
            inside, led, closing = end <= spans[at][1], spans[at][2], end > spans[at][1]
        before = text[max(0, m.start() - 40) : m.start()]
        prev = _token.search(before)
        w = prev.group().lstrip("(“„«\"'’‘[").lower() if prev else ""
        lead = before[: prev.start()].split()[-1:] if prev else []
        gap = text[end:pos] if m.group().strip() else m.group()
        out.append({"pos": pos, "mark": m.group().strip(), "prev": w, "raw": prev.group() if prev else "", "next": rest.group(1), "gap": gap, "inside": inside, "led": led, "closing": closing, "left": before[-1:], "lead": lead[0].lower() if lead else ""})
    return out


def kind(c: dict) -> str:
    if not c["mark"]:
        return "blank" if c["gap"].count("\n") > 1 else "thai"
    if c["mark"][0] in "。！？" or (c["mark"][0] in "…." and len(c["mark"]) > 1 and _cjk.match(c["left"] or " ")):
        return "cjk"
    return "point" if c["mark"][0] in ".…" else "end"


def first_letter(w: str) -> str:
    for c in w:
        if c.isalnum():
            return "9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "字"
    return "-"


def features(c: dict) -> list[str]:
    k, w, nx = kind(c), c["prev"], c["next"]
    f = first_letter(nx)
    gap = "none" if not c["gap"] else "blank" if c["gap"].count("\n") > 1 else "line" if "\n" in c["gap"] else "wide" if len(c["gap"]) > 1 else "space"
    short = w.strip(".") in SHORT
    digits = bool(re.fullmatch(r"\d{1,2}", w))
    base = [k, f"{k}|{f}", f"{k}|{gap}", f"{k}|{f}|{gap}", f"in{c['inside']}|{k}", f"cl{c['closing']}{c['led']}|{k}|{f}|{c['mark'][:1]}"]
    if k == "thai":
        beside = (c["left"] or " ").isdigit() or nx[:1].isdigit()
        return [*base, f"th{beside}", f"th{bool(_thai.match(nx))}{bool(_thai.match(c['left'] or ' '))}"]
    if k == "cjk":
        return [*base, f"m={c['mark'][:2]}", f"cn={nx[:2]}|{c['closing']}", f"m={c['mark'][:1]}|{c['closing']}{c['led']}"]
    return [
        *base, f"w={w}", f"w={w}|{f}", f"sh={_shape(c['raw'])}", f"len={min(len(w), 6)}", f"short={short}|{f}", f"may={w.strip('.') in MAY_END}|{f}",
        f"dot={'.' in w}|{f}", f"init={len(w) == 1 and w.isalpha()}|{c['raw'][-1:].isupper()}|{f}", f"num={digits}|{f}|{nx.strip('.,').lower() in MONTHS}|{c['lead'] in ARTICLES}",
        f"n={nx.lower().strip('.,')[:12]}", f"m={c['mark'][:2]}|{f}", f"tight={gap == 'none'}|{f}|{c['left'].islower()}|{'.' in w or '@' in w or '/' in w or ':' in w}",
    ]


def reliable(c: dict, facts: dict[str, float]) -> int | None:
    """1 or 0 where the text itself settles the matter, else None. facts: how often a word before a point is followed
    by a digit, per sample."""
    k, w, nx = kind(c), c["prev"].strip("."), c["next"]
    f = first_letter(nx)
    blank = c["gap"].count("\n") > 1
    if blank or k == "blank":
        return 1
    if c["inside"]:
        return 0
    if k == "thai":
        return 0 if (c["left"] or " ").isdigit() or nx[:1].isdigit() else 1 if _thai.match(nx) and _thai.match(c["left"] or " ") else None
    if k == "cjk":
        if c["mark"][0] in "…." and len(set(c["mark"])) == 1:
            return 0
        if c["closing"]:
            return 1 if c["led"] and c["mark"][0] == "。" else 0
        return 1
    if nx[:1] in "—–-" and f in "a-":
        return 0
    if f == "a":
        return 0 if c["gap"] or not c["left"].islower() else 0
    if not c["gap"]:
        clean = not ("." in w or "@" in w or "/" in w or ":" in w or "www" in w)
        return 1 if f == "A" and c["left"].islower() and clean and len(w) > 1 and nx[1:2].islower() else 0
    if k == "end":
        return 1
    if len(set(c["mark"])) == 1 and len(c["mark"]) > 1:
        return None
    if len(w) == 1 and w.isalpha() and c["raw"][-1:].isupper():
        return 0
    if w in MAY_END and f == "A":
        return 1
    if w in SHORT or facts.get(w, 0) > 0.8:
        return 0
    if re.fullmatch(r"\d{1,3}", w) and (nx.strip(".,").lower() in MONTHS or c["lead"] in ARTICLES):
        return 0
    if f == "A" and "." not in w and len(w) > 2:
        return 1
    return None


def _ids(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1 for n in names]


def fit(texts: list[str]) -> np.ndarray:
    """Weights of the model, hashed to 2^BITS features; deterministic."""
    found = [c for t in texts for c in candidates(t)]
    seen, digit = Counter(), Counter()
    for c in found:
        if kind(c) == "point" and c["gap"]:
            seen[c["prev"].strip(".")] += 1
            digit[c["prev"].strip(".")] += first_letter(c["next"]) == "9"
    facts = {w: digit[w] / n for w, n in seen.items() if n >= 4 and not w[-1:].isdigit()}
    rows = [(_ids(features(c)), y) for c in found if (y := reliable(c, facts)) is not None]
    weights = np.zeros(1 << BITS)
    if not rows:
        return weights.astype(np.float32)
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    ids = np.fromiter((i for r in rows for i in r[0]), np.int64)
    y = np.array([r[1] for r in rows], float)
    power = np.full(1 << BITS, 1e-8)
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.bincount(at, weights[ids], len(rows))))
        g = np.bincount(ids, (p - y)[at], 1 << BITS) + 1e-3 * weights
        power += g * g
        weights -= RATE * g / np.sqrt(power)
    return weights.astype(np.float32)


def headings(text: str) -> list[int]:
    """Starts of what follows a heading that only a line end sets apart: a short first line of a paragraph, without a
    closing mark, before a line that is much longer."""
    out, pos = [], 0
    lines = text.split("\n")
    full = max(map(len, lines))
    fresh = True
    for i, line in enumerate(lines):
        s = line.strip()
        after = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if fresh and s and after and s[-1] not in ".!?。！？…।:：,，;；、" + CLOSE and len(s) * 5 < full * 3 and len(s) <= 60 and len(after) > len(s) and first_letter(after) in "A9字" and not _thai.search(s):
            wide = bool(_cjk.search(s))
            if (len(s) <= 16 and full >= 24 and not re.search("[，。]", s)) if wide else full >= 40 and s[:1].isupper():
                out.append(pos + len(line) + 1 + len(lines[i + 1]) - len(lines[i + 1].lstrip()))
        fresh = not s
        pos += len(line) + 1
    return out


def starts(text: str | None, weights: np.ndarray) -> list[int]:
    """Positions (code points) where sentences begin; [] for null and blank texts."""
    if not text or not text.strip():
        return []
    got = {len(text) - len(text.lstrip())}
    found = candidates(text)
    for c in found:
        if float(weights[_ids(features(c))].sum()) > 0:
            got.add(c["pos"])
    got.update(headings(text))
    return sorted(got)


def model(df: DataFrame, key: str, text: str = "text", size: int = SAMPLE) -> np.ndarray:
    """Fitted on a bounded sample of the rows."""
    return fit(sample(df, key, text, size))


def segment(df: DataFrame, weights: np.ndarray, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, start_pos, sentence), one row per sentence. Null and blank texts have none; a sentence runs to the next
    start, without outer white space. Repeated rows repeat their sentences."""
    shared = df.sparkSession.sparkContext.broadcast(weights)  # 2^BITS floats
    kind_ = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, t in zip(f["_k"], f["_t"], strict=True):
                at = starts(t, shared.value)
                out += [(k, a, t[a:b].strip()) for a, b in zip(at, [*at[1:], None])]
            yield pd.DataFrame(out, columns=[key, "start_pos", "sentence"])

    return df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t IS NOT NULL").mapInPandas(run, f"`{key}` {kind_}, start_pos int, sentence string")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "doc_pages").select("page_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    wanted = table(spark, sf_dir, "segment_pages").where("page_id IS NOT NULL").distinct()
    return segment(pages.join(wanted, "page_id", "left_semi"), model(pages, "page_id")).select("page_id", "start_pos").distinct()


def p6_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every page. Of a page delivered several times the first delivery counts, which ids and times
    settle before texts are cut; deliveries of the same moment repeat their sentences."""
    rows = table(spark, sf_dir, "doc_pages").select("page_id", "text", "loaded_at")
    first = rows.groupBy("page_id").agg(F.min("loaded_at").alias("_at")).select(F.col("page_id").alias("_id"), "_at")
    once = rows.join(first, F.col("page_id").eqNullSafe(F.col("_id")) & F.col("loaded_at").eqNullSafe(F.col("_at")), "left_semi").select("page_id", "text")
    return segment(once, model(_pages(spark, sf_dir), "page_id"))


QUERIES = {"p6_found": p6_found, "p6_sentences": p6_sentences}
SQL: dict[str, str] = {}
