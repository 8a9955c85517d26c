"""Chains of encoding and decoding, scored for whole batches of texts at once.

A chain says by which codec a text was read and in which it had been written. The texts of a batch are one array of code
points; the reading codec turns them into bytes, the written one the bytes into other characters, and every character
that comes out is worth the difference between its log-probability and that of the characters it replaces. The worth of
a chain for a text is the most that any stretch of the text gains, so texts garbled in part are found as well as whole
ones. All steps are array operations; only texts that gain enough are taken apart one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product
from typing import NamedTuple, Protocol

import numpy as np

#: Codecs by which texts are read or in which they were written.
LATIN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
SINGLE = (*LATIN, *CYRILLIC, "cp874")
WIDE = ("gb18030", "big5hkscs", "cp932", "euc_jp", "cp949")
#: Distances by which the codes of a font without a character map lie off.
SHIFTS = tuple(k for n in range(1, 32) for k in (n, -n))
#: (read, written): the product of all codecs, control characters of one codec, swapped bytes, symbol codes, shifts.
CHAINS: tuple[tuple[str, str], ...] = (
    *((a, b) for a, b in product((*SINGLE, *WIDE), ("utf-8", *SINGLE, *WIDE)) if a != b),
    ("cp1252", "cp1252"),
    ("cp1252 twice", "utf-8"),
    ("utf-16-be", "utf-16-le"),
    ("symbol", "latin-1"),
    *((f"shift{k:+d}", "ascii") for k in SHIFTS),
)
NUMBER = {c: n for n, c in enumerate(CHAINS)}
#: What a character costs that a chain cannot turn.
LOST = 6.0
#: What it costs when a stretch begins or ends beside a character beyond ASCII: garbled text rarely starts inside a word.
CUT = 8.0
#: The least that a character counts: one rare character proves little, however rare it is.
FLOOR = -10.0
_RESET = 1e8


@cache
def bytes_of(codec: str) -> np.ndarray:
    """The byte of each of 2^16 characters in a single-byte codec, -1 where there is none; control characters and bytes
    that the codec leaves open stand for themselves."""
    out = np.full(1 << 16, -1, np.int32)
    out[:256] = np.arange(256)
    if codec not in ("cp1252", "latin-1"):
        out[160:256] = -1
    for b in range(128, 256):
        if len(c := bytes([b]).decode(codec, "ignore")) == 1:
            out[ord(c)] = b
    return out


@cache
def chars_of(codec: str) -> np.ndarray:
    """The character of each byte in a single-byte codec, 0 where the codec leaves it open."""
    return np.array([ord(c) if len(c := bytes([b]).decode(codec, "ignore")) == 1 else 0 for b in range(256)], np.int64)


@cache
def pairs_of(codec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A codec of two-byte characters: the character of each two bytes, the two bytes of each character (0: none),
    whether a byte leads, and the characters of single bytes."""
    there, back, lead, alone = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(256, bool), np.zeros(256, np.int64)
    alone[:128] = np.arange(128)
    for a in range(0x81, 0xFF):
        for b in range(0x40, 0xFF):
            c = bytes([a, b]).decode(codec, "ignore")
            if len(c) == 1 and "\x7f" < c <= "￿":
                there[a << 8 | b] = ord(c)
                lead[a] = True
                if not back[ord(c)] or c.encode(codec, "ignore") == bytes([a, b]):
                    back[ord(c)] = a << 8 | b
    for b in range(128, 256):
        if not lead[b] and len(c := bytes([b]).decode(codec, "ignore")) == 1:
            alone[b] = ord(c)
    return there, back, lead, alone


@cache
def swapped() -> np.ndarray:
    """What each of 2^16 characters is with its bytes exchanged (0: no character). Blanks that were kept stay; other
    characters of one byte come from no exchange."""
    c = np.arange(1 << 16)
    d = (c & 255) << 8 | c >> 8
    ok = (c > 255) & (d > 31) & ((d < 0xD800) | (d > 0xF8FF)) & ((d < 127) | (d > 159)) & (d < 0xFFFE)
    out = np.where(ok, d, 0)
    out[[9, 10, 13, 32]] = [9, 10, 13, 32]
    return out


@cache
def moved(k: int) -> np.ndarray:
    """What each character is when its code lies k off: visible ASCII only, the rest stays."""
    c = np.arange(1 << 16)
    out = c.copy()
    at = (c > 32) & (c < 127)
    out[at] = np.where((c[at] + k > 32) & (c[at] + k < 127), c[at] + k, 0)
    return out


class Scores(Protocol):
    def logs(self, c: np.ndarray, p: np.ndarray) -> np.ndarray: ...


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (those beyond 2^16 folded into one), the ones before them, and where each text starts."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    c = np.minimum(np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF).astype(np.int64)
    p = np.empty_like(c)
    p[0], p[1:] = 10, c[:-1]
    return c, p, np.concatenate([[0], np.cumsum(size + 1)[:-1]])


class Units(NamedTuple):
    """Bytes that a reading codec makes of characters."""

    raw: np.ndarray  # the byte, -1 where the codec has none for the character
    src: np.ndarray  # place of its character in the batch
    follows: np.ndarray  # whether the unit before is the one before in the text
    share: np.ndarray  # its part of what its character was worth
    last: np.ndarray  # place of the last character it stands for


class Turned(NamedTuple):
    """Characters that come out of a chain."""

    code: np.ndarray  # 0: undecodable
    at: np.ndarray  # number of the first unit


class Batch:
    """The texts of a batch as arrays, with the log-probability of every character."""

    def __init__(self, texts: list[str], model: Scores):
        self.texts, self.model = texts, model
        self.c, self.p, self.start = codes(texts)
        self.end = np.append(self.start[1:], len(self.c)) - 1
        self.old = np.maximum(model.logs(self.c, self.p), FLOOR).astype(np.float64)
        self.old[self.end] = 0.0
        self.of = np.repeat(np.arange(len(texts)), np.diff(np.append(self.start, len(self.c))))

    def marked(self, src: np.ndarray) -> np.ndarray:
        """The texts that hold any of the places."""
        out = np.zeros(len(self.texts), bool)
        out[self.of[src]] = True
        return out

    def only(self, u: Units, texts: np.ndarray) -> Units:
        """The units of the texts that the mask names."""
        ok = texts[self.of[u.src]]
        return Units(*(x[ok] for x in u))

    def any(self, mask: np.ndarray) -> np.ndarray:
        """Whether the mask holds anywhere in each text."""
        return np.maximum.reduceat(mask, self.start)

    def total(self, mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, self.start, dtype=np.int64)

    def narrow(self, read: str) -> Units:
        """Units of a single-byte codec: its characters beyond ASCII and the ones after them, in all texts that have
        some."""
        raw = bytes_of(read)[self.c]
        high = (self.c > 127) & (raw >= 0)
        near = high.copy()
        near[1:] |= high[:-1]
        # characters that the codec lacks stand between, undecodable, where they touch
        near[1:] |= (self.c[1:] > 127) & near[:-1]
        near[self.end] = False
        at = np.flatnonzero(near)
        follows = np.empty(len(at), bool)
        follows[:1], follows[1:] = False, np.diff(at) == 1
        return Units(raw[at], at, follows, self.old[at], at)

    def wide(self, read: str, some: np.ndarray) -> Units:
        """Units of a two-byte codec, of the whole texts numbered `some`."""
        take = np.zeros(len(self.texts), bool)
        take[some] = True
        mask = take[self.of]
        mask[self.end] = False
        at = np.flatnonzero(mask)
        c = self.c[at]
        two = pairs_of(read)[1][c]
        n = np.where(two > 0, 2, 1)
        src = np.repeat(at, n)
        first = np.ones(len(src), bool)
        first[1:] = src[1:] != src[:-1]
        both = np.repeat(two, n)
        raw = np.where(both > 0, np.where(first, both >> 8, both & 255), np.where(self.c[src] < 128, self.c[src], -1))
        follows = np.ones(len(src), bool)
        follows[:1] = False
        follows[1:] = (src[1:] - src[:-1]) <= 1
        return Units(raw, src, follows, self.old[src] / np.repeat(n, n), src)

    def same(self, table: np.ndarray, some: np.ndarray) -> tuple[Units, Turned]:
        """Characters turned one by one by a table, of the whole texts numbered `some`."""
        take = np.zeros(len(self.texts), bool)
        take[some] = True
        mask = take[self.of]
        mask[self.end] = False
        at = np.flatnonzero(mask)
        follows = np.ones(len(at), bool)
        follows[:1], follows[1:] = False, np.diff(at) == 1
        return Units(self.c[at], at, follows, self.old[at], at), Turned(table[self.c[at]], np.arange(len(at)))

    def gains(self, u: Units, t: Turned) -> np.ndarray:
        """What each new character gains over the characters that it replaces."""
        src = u.src[t.at]
        here = self.c[src]
        new = np.where(t.code > 0, t.code, here)
        prev = np.empty_like(new)
        prev[:1], prev[1:] = self.p[src[:1]], np.where(u.follows[t.at[1:]], new[:-1], self.p[src[1:]])
        g = self.model.logs(new, prev) - np.add.reduceat(u.share, t.at)
        # a lost character stays lost
        return np.where(t.code > 0, g, np.where(here == 0xFFFD, 0.0, -LOST))

    def cuts(self, u: Units, t: Turned) -> tuple[np.ndarray, np.ndarray]:
        """What it costs to begin a stretch at each new character, and to end one there."""
        high = (self.c[u.src] > 127).astype(np.float64)
        begin, end = np.zeros(len(t.at)), np.zeros(len(t.at))
        touch = u.follows[t.at[1:]] * high[t.at[1:] - 1] * high[t.at[1:]] * CUT
        begin[1:] = end[:-1] = touch
        # a stretch begins with a character that changes
        begin[t.code == self.c[u.src[t.at]]] = -FLOOR * 100
        return begin, end

    def best(self, u: Units, t: Turned) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts that the chain can turn in part, and the most that a stretch of each gains."""
        if not len(t.at):
            return t.at, t.at.astype(float)
        of = self.of[u.src[t.at]]
        begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        g = self.gains(u, t)
        begin, end = self.cuts(u, t)
        drop = g.copy()
        drop[begins] -= _RESET
        after = np.cumsum(drop)
        return of[begins], np.maximum.reduceat(after - end - np.minimum.accumulate(after - g + begin), begins)

    def spans(self, u: Units, t: Turned) -> Iterator[tuple[int, str]]:
        """(number, text with its best stretch turned) of every text that the chain can turn in part."""
        of = self.of[u.src[t.at]]
        begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        g = self.gains(u, t)
        begin, end = self.cuts(u, t)
        ends = np.append(begins[1:], len(of))
        for b, e in zip(begins, ends, strict=True):
            total = np.cumsum(g[b:e])
            before = np.append(0.0, total[:-1]) + begin[b:e]
            z = int(np.argmax(total - end[b:e] - np.minimum.accumulate(before)))
            a = int(np.argmin(before[: z + 1]))
            i = int(of[b])
            text, first = self.texts[i], int(self.start[i])
            stop = int(u.src[t.at[b + a]]) - first
            out = [text[:stop]]
            for j in range(b + a, b + z + 1):
                src = int(u.src[t.at[j]]) - first
                last = t.at[j + 1] - 1 if j + 1 < len(t.at) else len(u.src) - 1
                out.append(text[stop:src])
                out.append(chr(t.code[j]) if t.code[j] > 0 else text[max(src, stop) : src + 1])
                stop = max(stop, int(u.last[last]) - first + 1)
            yield i, "".join(out) + text[stop:]


def from_single(u: Units, written: str) -> Turned:
    return Turned(np.where(u.raw >= 0, chars_of(written)[u.raw], 0), np.arange(len(u.raw)))


def from_utf8(u: Units) -> tuple[Turned, np.ndarray]:
    """Sequences of UTF-8 among the units, and which units start one of two bytes or more."""
    b, n = u.raw.astype(np.int64), len(u.raw)
    tail = (b >= 0x80) & (b < 0xC0) & u.follows
    t1, t2, t3 = (np.append(tail[k:], np.zeros(min(k, n), bool))[:n] for k in (1, 2, 3))
    b1, b2, b3 = (np.append(b[k:], np.zeros(min(k, n), np.int64))[:n] & 0x3F for k in (1, 2, 3))
    two = (b >= 0xC2) & (b < 0xE0) & t1
    three = (b >= 0xE0) & (b < 0xF0) & t1 & t2
    four = (b >= 0xF0) & (b < 0xF5) & t1 & t2 & t3
    c3 = (b & 0x0F) << 12 | b1 << 6 | b2
    three &= (c3 >= 0x800) & ((c3 < 0xD800) | (c3 > 0xDFFF))
    code = np.where(two, (b & 0x1F) << 6 | b1, np.where(three, c3, np.where(four, 0xFFFF, np.where((b >= 0) & (b < 0x80), b, 0))))
    inside = np.zeros(n + 3, bool)
    for k, m in ((1, two | three | four), (2, three | four), (3, four)):
        inside[k : n + k] |= m
    at = np.flatnonzero(~inside[:n])
    return Turned(code[at], at), two | three | four


def again(u: Units, t: Turned, read: str) -> Units:
    """The units that the characters of a first decoding are in a codec, to be decoded once more."""
    ends = np.append(t.at[1:], len(u.raw)) - 1
    return Units(np.where(t.code > 0, bytes_of(read)[t.code], -1), u.src[t.at], u.follows[t.at], np.add.reduceat(u.share, t.at), u.last[ends])


def from_wide(u: Units, written: str) -> Turned:
    """Characters of two bytes, read one after the other from where a run of leading bytes starts."""
    there, _, lead, alone = pairs_of(written)
    n = len(u.raw)
    raw = np.maximum(u.raw, 0)
    can = lead[raw] & (u.raw >= 0)
    runs = can.copy()
    runs[1:] &= ~(can[:-1] & u.follows[1:])
    i = np.arange(n)
    leads = can & (((i - np.maximum.accumulate(np.where(runs, i, 0))) & 1) == 0)
    nxt = np.append(u.follows[1:] & (u.raw[1:] >= 0), False)
    code = np.where(leads & nxt, there[raw << 8 | np.append(raw[1:], 0)], 0)
    # a leading byte takes the next one with it unless that is ASCII and makes no character
    takes = leads & nxt & ((code > 0) | (np.append(raw[1:], 0) > 127))
    code = np.where(leads, code, np.where(u.raw >= 0, alone[raw], 0))
    inside = np.append(False, takes[:-1])
    at = np.flatnonzero(~inside)
    return Turned(code[at], at)


def decode(u: Units, written: str) -> Turned:
    if written == "utf-8":
        return from_utf8(u)[0]
    return from_wide(u, written) if written in WIDE else from_single(u, written)


class Tables:
    """Chains that turn characters one by one, rated by how frequent the characters are alone: a quick look at which
    texts are worth a closer one."""

    def __init__(self, singles: np.ndarray, tables: dict[int, np.ndarray]):
        logs = np.log((singles + 0.5) / (singles.sum() + 1.0))
        self.gains = {n: np.where(to > 0, logs[to] - logs, -LOST).astype(np.float32) for n, to in tables.items()}

    def over(self, b: Batch, some: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """(chain, numbers of the texts among `some` with a stretch that gains `least`)."""
        if not len(some):
            return
        size = b.end[some] - b.start[some] + 1
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.repeat(b.start[some] - first, size) + np.arange(size.sum())
        c, last = b.c[at], first + size - 1
        for n, gain in self.gains.items():
            g = gain[c].astype(np.float64)
            g[last] = -_RESET
            total = np.cumsum(g)
            top = np.maximum.reduceat(total - np.minimum.accumulate(total), first)
            if len(hit := some[top > least]):
                yield n, hit


@cache
def aligned() -> dict[int, np.ndarray]:
    """The tables of the chains between two codecs of two-byte characters, and of swapped bytes."""
    out = {}
    for a, b in product(WIDE, WIDE):
        if a != b:
            two = pairs_of(a)[1]
            out[NUMBER[a, b]] = np.where(two > 0, pairs_of(b)[0][two], np.where(np.arange(1 << 16) < 128, np.arange(1 << 16), 0))
    out[NUMBER["utf-16-be", "utf-16-le"]] = swapped()
    return out


@cache
def shifts() -> dict[int, np.ndarray]:
    return {NUMBER[f"shift{k:+d}", "ascii"]: moved(k) for k in SHIFTS}


@cache
def symbols() -> np.ndarray:
    """The characters that the codes of a symbol font stand for."""
    out = np.where(np.arange(1 << 16) < 128, np.arange(1 << 16), 0)
    out[0xF020:0xF080] = np.arange(0x20, 0x80)
    out[0xF0A0:0xF100] = np.arange(0xA0, 0x100)
    return out


#: A stretch that characters rated alone must gain for a closer look.
LOOK = 4.0
LOOK_SHIFT = 12.0


class Detector:
    """Every chain against every text of a batch. Chains that a single-byte codec was read by are scored wherever its
    characters stand; chains between two-byte codecs, swapped bytes and shifts where characters rated alone gain; the
    rest (two-byte to single-byte, Thai and Cyrillic to two-byte) on the texts that `low` marks as unlikely."""

    def __init__(self, model: Scores, singles: np.ndarray):
        self.model = model
        self.wide, self.shift = Tables(singles, aligned()), Tables(singles, shifts())

    def gains(self, texts: list[str], low: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, chain, gain) of all chains that gain more than `least`, the best of each text first."""
        b, found = Batch(texts, self.model), []

        def keep(n: int, u: Units, t: Turned) -> None:
            i, g = b.best(u, t)
            if (ok := g > least).any():
                found.append((i[ok], np.full(int(ok.sum()), n), g[ok]))

        self._narrow(b, low, keep)
        self._wide(b, low, keep)
        self._coded(b, low, keep)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, n, g = (np.concatenate(x) for x in zip(*found, strict=True))
        at = np.lexsort((n, -g, i))
        return i[at], n[at], g[at]

    def _narrow(self, b: Batch, low: np.ndarray, keep) -> None:
        c = b.c
        other = b.total((c >= 0x400) & (c < 0x530)) * 3 < b.total(((c | 32) >= 97) & ((c | 32) <= 122))
        for read in SINGLE:
            units = b.narrow(read)
            if not len(units.raw):
                continue
            lead = from_utf8(units)[1]
            if lead.any():
                u = b.only(units, b.marked(units.src[lead]))
                first = from_utf8(u)[0]
                keep(NUMBER[read, "utf-8"], u, first)
                if read == "cp1252":
                    u = again(u, first, read)
                    second, lead = from_utf8(u)
                    if lead.any():
                        keep(NUMBER["cp1252 twice", "utf-8"], u, second)
            near, far = (units, b.only(units, other | low)) if read in CYRILLIC else (units, units) if read in LATIN else (b.only(units, low),) * 2
            for written in SINGLE:
                u = near if read not in CYRILLIC or written in CYRILLIC else far
                if (read, written) in NUMBER and len(u.raw):
                    keep(NUMBER[read, written], u, from_single(u, written))
            two = (units.raw > 127) & units.follows
            two[1:] &= units.raw[:-1] > 127
            u = b.only(units, b.marked(units.src[two]) if read in LATIN else low)
            if len(u.raw):
                for written in WIDE:
                    keep(NUMBER[read, written], u, from_wide(u, written))

    def _wide(self, b: Batch, low: np.ndarray, keep) -> None:
        wide = b.any(b.c > 0x2E7F)
        some, odd = np.flatnonzero(wide), np.flatnonzero(wide & low)
        if not len(some):
            return
        for read in WIDE:
            u = b.wide(read, some)
            keep(NUMBER[read, "utf-8"], u, from_utf8(u)[0])
            if len(odd):
                u = b.wide(read, odd)
                for written in SINGLE:
                    keep(NUMBER[read, written], u, from_single(u, written))
        for n, hit in self.wide.over(b, some, LOOK):
            read, written = CHAINS[n]
            if read in WIDE:
                u = b.wide(read, hit)
                keep(n, u, from_wide(u, written))
            else:
                keep(n, *b.same(swapped(), hit))

    def _coded(self, b: Batch, low: np.ndarray, keep) -> None:
        c = b.c
        odd = np.flatnonzero(low & b.any(c > 0xFF) & ~b.any(c > 0x2E7F))
        if len(odd):
            keep(NUMBER["utf-16-be", "utf-16-le"], *b.same(swapped(), odd))
        marked = np.flatnonzero(b.any((c >= 0xF020) & (c < 0xF100)))
        if len(marked):
            keep(NUMBER["symbol", "latin-1"], *b.same(symbols(), marked))
        visible, small = b.total((c > 32) & (c < 127) & ((c < 48) | (c > 57))), b.total((c >= 97) & (c <= 122))
        ascii_ = np.flatnonzero(~b.any(c > 0x180) & (visible > 5) & ((small * 3 < b.end - b.start) | low))
        for n, hit in self.shift.over(b, ascii_, LOOK_SHIFT):
            keep(n, *b.same(moved(int(CHAINS[n][0][5:])), hit))

    def restored(self, texts: list[str], chains: list[int]) -> list[str]:
        """Each text with the best stretch of its chain turned."""
        out = list(texts)
        for n in sorted(set(chains)):
            own = [k for k, x in enumerate(chains) if x == n]
            b = Batch([texts[k] for k in own], self.model)
            read, written = CHAINS[n]
            every = np.arange(len(own))
            if read in SINGLE:
                u = b.narrow(read)
                t = decode(u, written)
            elif read.endswith("twice"):
                u = b.narrow("cp1252")
                u = again(u, from_utf8(u)[0], "cp1252") if len(u.raw) else u
                t = from_utf8(u)[0]
            elif read in WIDE:
                u = b.wide(read, every)
                t = decode(u, written)
            else:
                u, t = b.same(swapped() if read == "utf-16-be" else symbols() if read == "symbol" else moved(int(read[5:])), every)
            if len(t.at):
                for i, text in b.spans(u, t):
                    out[own[i]] = text
        return out
