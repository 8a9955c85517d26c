"""Figures of texts, computed over whole Arrow batches: every code point is looked up once in a table of classes, and
counts, words and word hashes come from reductions over the batch. Lines are rated by their form."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

STATS = ("mean_word_len", "symbol_ratio", "digit_ratio", "line_end_ratio", "common_ratio", "novowel_ratio")
KINDS = ("prose", "list", "table", "junk")
#: Marks that end a sentence.
ENDS = ".!?。！？…।:：\"”»」』)）"
LETTER, DIGIT, MARK, SPACE, BREAK, END, VOWELLESS, LATIN = (1 << i for i in range(8))
SCRIPTS = ("ja", "th", "hi", "ru", "zh")
_BLOCKS = {"ja": ((0x3040, 0x30FF),), "th": ((0xE00, 0xE7F),), "hi": ((0x900, 0x97F),), "ru": ((0x400, 0x52F),), "zh": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))}
UNSPACED = ("zh", "ja", "th")


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, script (1 + place in SCRIPTS) and lower case of the code points below 2^16."""
    cls, script, low = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        k = unicodedata.category(c)
        cls[i] = (LETTER if k[0] == "L" else DIGIT if k[0] == "N" else MARK if k[0] == "M" else 0) | (SPACE if c.isspace() else 0) | (BREAK if c in "\n\r" else 0) | (END if c in ENDS else 0)
        if k[0] == "L" and i < 0x250:
            cls[i] |= LATIN
        if c.lower() in "bcdfghjklmnpqrstvwxz" and i < 128:
            cls[i] |= VOWELLESS
        if len(c.lower()) == 1:
            low[i] = ord(c.lower())
    for n, k in enumerate(SCRIPTS):
        for a, b in _BLOCKS[k]:
            script[a : b + 1] = n + 1
    return cls, script, low


_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _hash(word: str) -> int:
    with np.errstate(over="ignore"):
        c = np.array([ord(x) for x in word.lower()], np.uint64)
        return int(np.sum(c * _POWERS[np.arange(len(c)) & 63], dtype=np.uint64))


def figures(texts: list[str | None], words: dict[str, list[str]]) -> dict[str, np.ndarray]:
    """n_chars, n_lines, n_words, lang and STATS (NaN where undefined) of each text; null counts as empty."""
    cls_of, script_of, low_of = tables()
    texts = ["" if t is None else t for t in texts]
    n = len(texts)
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, n)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    small = np.minimum(code, 0xFFFF)
    cls = cls_of[small]
    # each text ends with the separator, so reduceat has no empty range
    total = lambda mask: np.add.reduceat(mask, start, dtype=np.int64)
    has = lambda bit: (cls & bit) != 0
    letter, digit, space, brk = has(LETTER), has(DIGIT), has(SPACE), has(BREAK)
    letters, digits, marks = total(letter), total(digit), total(has(MARK))
    dense = size - (total(space) - 1)
    word = letter | digit
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    at = np.flatnonzero(begins)
    owner = np.searchsorted(start, at, "right") - 1
    n_words = np.bincount(owner, minlength=n)
    # lines with something in them, and those whose last visible character ends a sentence
    seen = np.flatnonzero(~space)
    line_no = np.cumsum(brk)
    last = np.ones(len(seen), bool)
    last[:-1] = line_no[seen[1:]] != line_no[seen[:-1]]
    tail = seen[last]
    of = np.searchsorted(start, tail, "right") - 1
    n_lines, ended = np.bincount(of, minlength=n), np.bincount(of[has(END)[tail]], minlength=n)
    # words: hashes of their lower-case letters, and whether they consist of consonants
    hashes, bare = np.empty(0, np.uint64), np.empty(0, bool)
    if len(at):
        run = np.where(word, small, 0)
        ends = np.append(at[1:], len(code))
        idx = np.arange(len(code)) - np.repeat(np.append(0, at), np.diff(np.concatenate([[0], at, [len(code)]])))
        with np.errstate(over="ignore"):
            hashes = np.add.reduceat(np.where(word, low_of[run], 0).astype(np.uint64) * _POWERS[idx & 63], at)
        w_len = np.add.reduceat(word, at, dtype=np.int64)
        bare = (np.add.reduceat(has(VOWELLESS), at, dtype=np.int64) == w_len) & (w_len > 1)
        del ends, run, idx
    hollow = np.bincount(owner[bare], minlength=n)
    by_script = np.stack([total(script_of[small] == k + 1) for k in range(len(SCRIPTS))])
    spaced = sorted(k for k in words if k not in UNSPACED)
    hits = {k: np.bincount(owner[np.isin(hashes, np.array([_hash(w) for w in words[k]], np.uint64))], minlength=n) for k in spaced}
    latin = [k for k in spaced if k not in SCRIPTS]
    best = np.stack([hits[k] for k in latin]) if latin else np.zeros((1, n), int)
    lang = np.array(latin or ["und"], object)[best.argmax(0)]
    lang[best.max(0) == 0] = "und"
    for k in ("zh", "ru", "hi", "th", "ja"):
        share = by_script[SCRIPTS.index(k)] * (5 if k == "ja" else 3) > letters
        lang[share] = k
    lang[letters == 0] = "und"
    common = np.zeros(n)
    for k in spaced:
        m = lang == k
        common[m] = hits[k][m]
    for i in np.flatnonzero(np.isin(lang.astype(str), UNSPACED)):
        common[i] = sum(map(texts[i].count, words.get(lang[i], ())))
    base = np.where(np.isin(lang.astype(str), UNSPACED), letters, n_words)
    with np.errstate(all="ignore"):
        over = lambda a, b: np.where(b > 0, a / b, np.nan)
        out = {
            "n_chars": np.fromiter((len(t.strip()) for t in texts), np.int32, n),
            "n_lines": n_lines.astype(np.int32),
            "n_words": n_words.astype(np.int32),
            "mean_word_len": over(letters + digits + marks, n_words),
            "symbol_ratio": over(dense - letters - digits - marks, dense),
            "digit_ratio": over(digits, dense),
            "line_end_ratio": over(ended, n_lines),
            "common_ratio": over(common, base),
            "novowel_ratio": over(hollow, n_words),
        }
    return out | {"lang": lang}


#: Forms of lines.
_leaders = re.compile(r"(?:[._·…]\s?){5,}\s*\d+\s*$|…{2,}\s*\d+\s*$")
_markup = re.compile(r"</?\w+:\w+|\bT[jd] ET\b|\bBT /F\d")
_hex = re.compile(r"\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{24,}\b")
_repeated = re.compile(r"([^\s._·…—-])\1{11,}|(?:(\S{1,3} ?)\2{7,})")
_consonants = re.compile(r"(?i)\b[b-df-hj-np-tv-xz]{2,}\b")
_item = re.compile(r"\s*(?:[•·∙▪◦‣●○■□*–—-]\s|\[[ xX✓]?\]|\(?\d{1,3}[.)、）]\s?(?!\d)|[a-zA-Z]\)\s|\d{1,2}(?:\.\d{1,2}){1,3}\s)")
_pair = re.compile(r"\s*[^:：.!?。\t]{2,40}[:：]\s?(?:\S[^.!?。！？]{0,60}|\S*[\d.,-]+\S*)$")
_abbreviated = re.compile(r"\s*[^:：!?。\t]{2,40}[:：]\s?\S{1,24}(?:\s\S{1,12}){0,3}$")
_codes = re.compile(r"\([^()\s]{3,20}\)[,;]?\s*$")
_columns = re.compile(r"\s\|\s|\|.*\||(?<![.!?。！？…”»\"'’:])[ 　]{3,}(?=\S)")


def line_kind(line: str) -> str:
    """blank, junk, table, list or prose, of one line by its form alone."""
    if line.isspace() or not line:
        return "blank"
    end = line.rstrip()[-1]
    if end.isdigit() and line.lstrip()[0] not in "._·…" and ("…" in line or "__" in line or ". ." in line or "..." in line or "·" in line) and _leaders.search(line):
        return "list"
    if line.count("\t") > 1 or ("   " in line and len(_gap.findall(line)) > 1) or (line.count(" | ") > 1 and len(_bars.findall(line)) > 1):
        return "table"
    dense = "".join(line.split())
    n = len(dense)
    if n >= 12:
        if ("<" in line or " ET" in line) and _markup.search(line):
            return "junk"
        if len(set(dense)) * 3 < n + 8 and _repeated.search(line):
            return "junk"
        if n >= 24 and _hex.search(line):
            return "junk"
        vowels = sum(map(line.count, "aeiouAEIOU"))
        if vowels * 6 < n and (not dense.isalnum() or line.isascii()):
            odd = sum(not (c.isalnum() or unicodedata.category(c)[0] == "M") for c in dense)
            latin = len(line.encode("utf-8", "surrogatepass")) * 4 < len(line) * 5
            if odd * 2 > n or (latin and len(_consonants.findall(line)) * 2 > len(line.split())):
                return "junk"
    if _item.match(line):
        return "list"
    if "\t" in line or (("|" in line or "   " in line or "　　　" in line) and _columns.search(line)):
        return "table"
    if (":" in line or "：" in line) and len(line) < 104 and (_pair.match(line) or _abbreviated.match(line)):
        return "list"
    if end in "),;" and _codes.search(line):
        return "list"
    return "prose"


_bars = re.compile(r"[^\W_][)%.€]? \| (?=[\w(-]|$|\|)")
_gap = re.compile(r"\S {3,}(?=\S)")
_lines = re.compile(r"\r\n|\r|\n")


def kind_sizes(text: str | None) -> tuple[int, int, int, int]:
    """Characters without white space in lines of each of KINDS."""
    got = dict.fromkeys(KINDS, 0)
    if text:
        for line in _lines.split(text) if "\r" in text else text.split("\n"):
            k = line_kind(line)
            if k != "blank":
                got[k] += len("".join(line.split()))
    return tuple(got.values())
