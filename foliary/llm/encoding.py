"""Problem 2: text that was decoded with the wrong encoding.

A character model (hashed pairs, backed off to characters and to blocks of 128 code points) is counted over all clean
runs; a second pass takes out runs in scripts without spaces that a chain turns into far more usual characters. Every
chain of reading with one codec what another had written is scored on every stretch of every run, in vectorised batches
(chains.py), and the likeliest result is accepted if it gains more than a margin validated on all clean runs and, where
these leave it open, on all of them garbled. Garbling belongs to a file: where a file has such runs, its other runs that the same chain makes likelier
at all are accepted too, and several small gains of one chain in one file add up. Codes of a font whose declared map
stands in the fonts table are a chain of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chains import CHAINS, Batch, Detector, Tables, aligned, codes
from .common import durable, table
from .lookalike import look

BITS = 20
#: Likelihoods of clean runs are counted in steps of 1 / STEP, and gains in steps of 1 / STEP of their binary logarithm.
STEP = 1024
#: The share of clean runs that count as unlikely.
TRIED = 0.06
#: Least margin of a single run, gain from which a run counts at all, what counts among several runs of a file, and what
#: those must gain together.
MARGIN, WEAK, SOME, TOGETHER = 9.0, 3.0, 5.0, 12.0
#: What a pair or character that the reference never shows counts: garbled files teach little, rare words still something.
UNSEEN = 0.01
#: The total gain that a stretch of characters turned one by one must have to keep a run from teaching.
STRETCH = 12.0
#: Characters that no correctly decoded text holds.
BROKEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f\ufffd\ue000-\uf8ff\U000f0000-\U0010ffff]")
#: As many sequences of three as no text that was read correctly has by chance.
_longest = re.compile(rb"(?:[\xe3-\xe9][\x80-\xbf]{2}){4,}")


def _pair(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((p * 0x9E3779B1 + c) * 0x85EBCA77 >> 11) & ((1 << BITS) - 1)


class Model:
    """Smoothed log-probabilities of characters given the one before."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray, contexts: np.ndarray | None = None):
        """contexts: how often a character stands before another, if that is not how often it counts itself."""
        total = singles.sum() + 1.0
        blocks = np.repeat(singles.reshape(-1, 128).sum(1), 128)
        block = (blocks + 1e-3) / (total + 1)
        self.single = ((singles + 0.05 * block) / (total + 0.05)).astype(np.float64)
        self.single = np.maximum(self.single, block / 128 * 1e-3).astype(np.float32)
        self.pairs, self.count = pairs.astype(np.float32), singles.astype(np.float32)
        self.before = self.count if contexts is None else contexts.astype(np.float32)
        self._detector: Detector | None = None

    def __getstate__(self):
        return self.__dict__ | {"_detector": None}

    @property
    def detector(self) -> Detector:
        if self._detector is None:
            self._detector = Detector(self, self.count.astype(np.float64))
        return self._detector

    def logs(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        a = 3.0
        return np.log((self.pairs[_pair(p, c)] * (self.count[c] > 0) + a * self.single[c]) / (self.before[p] + a))

    def score(self, texts: list[str], wide: bool = False) -> tuple[np.ndarray, ...]:
        """Total, and the least sum over two neighbours of which one isn't ASCII, of each text; and lengths.
        wide: also whether a text is mostly in scripts written without spaces."""
        c, p, start = codes(texts)
        logs = self.logs(c, p)
        size = np.diff(np.append(start, len(c)))
        two = logs.copy()
        two[1:] += logs[:-1]
        two[(c < 128) & (p < 128)] = 0
        out = np.add.reduceat(logs, start), np.minimum.reduceat(two, start), size
        return (*out, np.add.reduceat(c > 0x2E7F, start, dtype=np.int64) * 2 > size) if wide else out


def clean(text: Column) -> Column:
    """Records that may teach the model: without broken characters and without the usual marks of garbling."""
    # all of the marks but one lie beyond ASCII
    plain = (F.octet_length(text) == F.length(text)) & ~text.contains("\x7f")
    return text.isNotNull() & (F.length(text) > 0) & (plain | ~text.rlike(r"[\x7f-\x84\x86-\x9f\x{fffd}\x{e000}-\x{f8ff}]|[ÂÃâåäæçéèï][\x{80}-\x{bf}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|[√¬][^\s]|[À-ÿ]{4}|\p{Ll}[‡‰¸ŽŸŠˆ˜¨´∂\p{IsHan}À-ÖØ-ÞЀ-ӿ][a-z]|[a-z][Ѐ-ӿ]|вЂ|Р[°-ї]"))


class Nothing:
    """Scores of a batch that is only looked at character by character."""

    def logs(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.zeros(len(c), np.float32)


def mistaken(tables: Tables, texts: list[str]) -> list[int]:
    """Numbers of the texts of wide characters that pass for clean but are others read wrongly."""
    if not texts:
        return []
    b = Batch(texts, Nothing())
    found = {int(i) for _, hit in tables.over(b, np.flatnonzero(b.any(b.c > 0x2E7F)), STRETCH) for i in hit}
    # no character has more than two of the twelve bytes
    many = b.total(b.c > 127) > 5
    return [i for i, t in enumerate(texts) if i in found or (many[i] and any(_longest.search(t.encode(c, "replace")) for c in ("gb18030", "cp949", "cp932")))]


def _counted(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """How often every hashed pair and every character occurs in the rows, and their number; at most 2^BITS + 2^16
    numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, singles, rows = np.zeros(1 << BITS, np.int64), np.zeros(1 << 16, np.int64), 0
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            rows += len(texts)
            if texts:
                c, p, _ = codes(texts)
                pairs += np.bincount(_pair(p, c), minlength=1 << BITS)
                singles += np.bincount(c, minlength=1 << 16)
        both = np.concatenate([pairs, singles])
        i = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(both[i], rows))], names=["i", "n"])

    # every task hands over up to 2^BITS + 2^16 counts, so a few tasks for every core are enough
    rows_ = df.select(text).coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    got = rows_.mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((1 << BITS) + (1 << 16))
    rows = int(got.n[got.i == -1].sum())
    got = got[got.i >= 0]
    both[got.i] = got.n
    return both, rows


def train(df: DataFrame, text: str, reference: DataFrame | None = None) -> tuple[Model, int]:
    """The model, counted over all clean rows, and their number. reference: a column of texts that other ways of
    extraction gave; what it never shows counts UNSEEN. Without one a second pass takes out the rows of wide characters
    that the first counts show to be others read wrongly."""
    both, rows = _counted(df.where(clean(F.col(text))), text)
    cut = 1 << BITS
    if reference is not None:
        known = _counted(reference, reference.columns[0])[0]
        counts = known + both * np.where(known > 0, 1.0, UNSEEN)
        return Model(counts[:cut], counts[cut:], known[cut:] + both[cut:]), rows
    # the marks of clean() don't know text garbled into another text of wide characters: what the first counts show to be such doesn't teach
    first = df.sparkSession.sparkContext.broadcast(Tables(both[cut:], aligned()))

    def garbled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(mistaken(first.value, b.column(0).to_pylist()), pa.int64()))

    wide = df.where(F.col(text).rlike(r"[\x{2e80}-\x{10ffff}]{2}") & clean(F.col(text))).select(text)
    bad, n = _counted(wide.mapInArrow(garbled, wide.schema), text)
    both -= bad
    first.unpersist()
    return Model(both[:cut], both[cut:]), rows - n


@dataclass(frozen=True)
class Limits:
    """Below the floor of its least likely place, or below the usual mean, a run is unlikely; scripts without spaces are
    full of rare pairs and have limits of their own. margin: the gain from which one run counts by itself."""

    floor: float = -20.0
    usual: float = -6.5
    floor_wide: float = -20.0
    usual_wide: float = -6.5
    margin: float = MARGIN

    def low(self, model: Model, texts: list[str]) -> np.ndarray:
        total, least, size, wide = model.score(texts, wide=True)
        mean = total / size
        return np.where(wide, (least < self.floor_wide) | (mean < self.usual_wide), (least < self.floor) | (mean < self.usual))


@dataclass(frozen=True)
class Gain:
    """What a chain gains on a text."""

    gain: float
    chain: int
    text: str


def _script(c: str) -> str:
    o = ord(c)
    return "latin" if o < 0x250 else "greek" if o < 0x400 else "cyrillic" if o < 0x530 else "hindi" if 0x900 <= o < 0x980 else "thai" if 0xE00 <= o < 0xE80 else "wide" if o > 0x2E80 else "other"


def plausible(old: str, new: str, n: int) -> bool:
    """Whether a few changed characters are in the script of the words around them."""
    if CHAINS[n][1] == "utf-8":
        return True
    k = 0
    m = min(len(old), len(new))
    while k < m and old[k] == new[k]:
        k += 1
    e = 0
    while e < m - k and old[-1 - e] == new[-1 - e]:
        e += 1
    own = {_script(c) for c in new[k : len(new) - e] if c.isalpha() and ord(c) > 127}
    if not own or len(new) - e - k >= 8 or (own == {"wide"} and len(new) - e - k > 1):
        return True
    around = {_script(c) for c in new[:k] + new[len(new) - e :] if c.isalpha()}
    return own <= around if around else own == {"latin"} or len(new) - e - k >= 4


def _sound(old: str, new: str, n: int) -> bool:
    """Whether what a shift makes of a text can be text: mostly small letters, of several kinds."""
    if not CHAINS[n][0].startswith("shift"):
        return True
    changed = [b for a, b in zip(old, new, strict=True) if a != b]
    small = [c for c in changed if c.islower()]
    return len(small) > 5 and len(set(small)) > 4 and len(small) * 3 > len(changed) * 2 and len(small) * 2 > sum(not c.isspace() for c in new)


def gains(model: Model, limits: Limits, texts: list[str], least: float = WEAK) -> dict[int, list[Gain]]:
    """The chains that gain more than `least` on a text, the best first, by the number of the text. A letter of another
    script that only looks like the usual one is no wrong decoding: what the usual letters explain better is left out."""
    low = limits.low(model, texts)
    broken = np.array([BROKEN.search(t) is not None for t in texts])
    i, n, g = model.detector.gains(texts, low | broken, least)
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    ok = (rank < 3) & (g > np.where(np.char.startswith(READ[n], "shift"), SHIFTED, least)) if len(i) else np.zeros(0, bool)
    i, n, g = i[ok], n[ok], g[ok]
    new = model.detector.restored([texts[k] for k in i], n.tolist())
    odd = [k for k, (j, t) in enumerate(zip(i, new, strict=True)) if not broken[j] and t != texts[j] and look(texts[j]) != texts[j]]
    worse = set()
    if odd:
        a, b = (model.score(x)[0] for x in ([look(texts[i[k]]) for k in odd], [new[k] for k in odd]))
        worse = {k for k, x, y in zip(odd, a, b, strict=True) if x >= y}
    # a shift is one of many: what it makes of a text must be usual as a whole
    turned = [k for k, m in enumerate(n) if READ[m].startswith("shift")]
    if turned:
        worse |= {k for k, x in zip(turned, limits.low(model, [new[k] for k in turned]), strict=True) if x}
    out: dict[int, list[Gain]] = {}
    for k, (j, m, x, t) in enumerate(zip(i.tolist(), n.tolist(), g.tolist(), new, strict=True)):
        if k not in worse and t != texts[j] and _sound(texts[j], t, m) and plausible(texts[j], t, m):
            out.setdefault(j, []).append(Gain(x, m, t))
    return out


READ = np.array([r for r, _ in CHAINS])
#: What a shift must gain: it is one of many and turns every letter.
SHIFTED = 25.0


#: Chains that clean runs are garbled by: (read, written).
GARBLED = (("cp1252", "utf-8"), ("latin-1", "gbk"), ("gb18030", "utf-8"), ("big5hkscs", "gbk"), ("cp1252", "cp932"), ("mac_roman", "utf-8"), ("cp1251", "koi8_r"), ("cp850", "utf-8"), ("cp1250", "utf-8"), ("cp850", "cp1252"))


def _counts(df: DataFrame, of: Callable[[list[str]], np.ndarray]) -> dict[int, int]:
    """How often every number that `of` gives for the texts of a batch (the first column) occurs; only sums of the
    numbers that occur come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            if len(texts := b.column(0).to_pylist()):
                new, n = np.unique(of(texts), return_counts=True)
                values, at = np.unique(np.concatenate([values, new]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(values)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["i", "n"])

    return {r.i: r.n for r in df.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}


def quantile(counts: dict[int, int], q: float) -> float:
    """The quantile of numbers that occur so often, between neighbours in proportion, as numpy has it."""
    values = np.array(sorted(counts), np.float64)
    below = np.cumsum([counts[int(v)] for v in values])
    at = q * (below[-1] - 1)
    low, high = values[np.searchsorted(below, [np.floor(at), np.ceil(at)], "right")]
    return float(low + (high - low) * (at - np.floor(at)))


def _teaches(model: Model, texts: list[str]) -> list[str]:
    """Of clean texts those that limits are taken from."""
    left_out = set(mistaken(model.detector.wide, texts))
    return [t for i, t in enumerate(texts) if len(t) >= 8 and not BROKEN.search(t) and i not in left_out]


def floors(df: DataFrame, text: str, model: Model) -> tuple[Limits, int]:
    """Floors that all but a few of all clean runs pass, and how many runs they are taken from."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def of(texts: list[str]) -> np.ndarray:
        if not (texts := _teaches(sent.value, texts)):
            return np.zeros(0, np.int64)
        total, least, size, wide = sent.value.score(texts, wide=True)
        both = np.floor(np.concatenate([least, total / size]) * STEP).astype(np.int64)
        # the kind in the two lowest bits: wide or not, mean or least
        return both << 2 | np.concatenate([wide, wide]) << 1 | np.repeat([0, 1], len(texts))

    counts = _counts(df.where(clean(F.col(text))).select(text), of)
    sent.unpersist()
    kinds: list[dict[int, int]] = [{}, {}, {}, {}]
    for i, n in counts.items():
        kinds[i & 3][i >> 2] = n
    rows = sum(kinds[0].values()) + sum(kinds[2].values())
    if not rows:
        return Limits(), 0
    at = lambda k, q: quantile(kinds[k], q) / STEP if kinds[k] else -20.0
    return Limits(at(0, TRIED), at(1, TRIED / 2), at(2, TRIED / 2), at(3, TRIED / 2)), rows


def _steps(gains_: np.ndarray) -> np.ndarray:
    """Gains on a scale of steps; 0 for none."""
    return np.where(gains_ > 1, np.floor(np.log2(np.maximum(gains_, 1)) * STEP), 0).astype(np.int64)


def margin(df: DataFrame, text: str, rated: DataFrame, model: Model, limits: Limits, rows: int) -> float:
    """The gain that parts clean runs from deliberately garbled ones, never under MARGIN. rated: what rate() gives for all
    rows of df; rows: the number of clean runs that teach. The clean runs are garbled only where their own gains leave
    the margin open."""
    if not rows:
        return MARGIN
    sent = df.sparkSession.sparkContext.broadcast(model)
    best = lambda texts: _steps(np.array([x[0].gain if (x := got.get(i)) else 0.0 for i in range(len(texts))])) if (got := gains(sent.value, limits, texts)) else np.zeros(len(texts), np.int64)

    def garbled(texts: list[str]) -> np.ndarray:
        bad = []
        for t in _teaches(sent.value, texts):
            for read, written in GARBLED:
                try:
                    g = t.encode(written).decode(read)
                except UnicodeError:
                    continue
                if g != t:
                    bad.append(g)
        return np.concatenate([best(bad[k : k + 2000]) for k in range(0, len(bad), 2000)]) if bad else np.zeros(0, np.int64)

    own = rated.where((F.col("kind") == PERHAPS) & (F.col("nth") == 0)).where(clean(F.col("old"))).select("old", "gain")

    def clean_gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            good = set(_teaches(sent.value, texts))
            ok = [i for i, t in enumerate(texts) if t in good]
            yield pa.RecordBatch.from_arrays([pa.array(_steps(b.column(1).to_numpy()[ok]))], names=["i"])

    counts = {r.i: r.n for r in own.mapInArrow(clean_gains, "i long").groupBy("i").agg(F.count("*").alias("n")).collect()}
    counts[0] = counts.get(0, 0) + rows - sum(counts.values())
    value = lambda steps: 2 ** (steps / STEP)
    top = value(quantile(counts, 0.99))
    if top > MARGIN and (counts := _counts(df.where(clean(F.col(text))).select(text), garbled)):
        top = min(top, value(quantile(counts, 0.01)))
    sent.unpersist()
    return max(MARGIN, top)


#: Words and codes of at most twenty characters, and those that mix letters and digits or cases as no word does.
_word = re.compile(r"[^\W_]{3,20}")
_mixed = re.compile(r"[^\W\d_]\d|\d[^\W\d_]|[a-zà-ÿ][A-Z]")


def coded(text: str) -> bool:
    """Whether several words of a text mix what words don't mix, as codes of a font do whose characters are others."""
    words = _word.findall(text)
    mixed = sum(_mixed.search(w) is not None for w in words)
    return mixed > 2 and mixed * 10 >= 3 * len(words) and max(map(len, text.split())) <= 30


FOUND, PERHAPS, UNLIKELY = 0, 1, 2
FONT_MAP = len(CHAINS)


def rate(df: DataFrame, model: Model, limits: Limits, key: str, text: str, file: str | None, font: str | None) -> DataFrame:
    """(key, file, font, kind, gain, chain, restored, nth, top, old), whatever the margin: FOUND where characters stand that
    no decoding gives, PERHAPS for every chain that gains a little (nth: its rank; with the text as it is in the first),
    UNLIKELY (with the text as it is) for unlikely Latin text, only where the file is known. top: the best gain of the
    text."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    sent = df.sparkSession.sparkContext.broadcast(model)  # 2^BITS and 2^16 floats

    def of(texts: list[str]) -> dict[str, list[tuple[int, float, int | None, str | None, int, float, str | None]]]:
        m = sent.value
        out: dict[str, list[tuple[int, float, int | None, str | None, int, float, str | None]]] = {}
        found, low = gains(m, limits, texts), limits.low(m, texts)
        for i, t in enumerate(texts):
            got = found.get(i, [])
            top = got[0].gain if got else 0.0
            if BROKEN.search(t):
                out[t] = [(FOUND, top, got[0].chain if got else None, got[0].text if got else None, 0, top, None)]
                continue
            out[t] = [(PERHAPS, g.gain, g.chain, g.text, k, top, None if k else t) for k, g in enumerate(got)]
            if file and low[i] and max(t) < "\u2e80" and sum(c.isalnum() for c in t) > 3:
                out[t].append((UNLIKELY, 0.0, None, t, 0, top, None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}  # headings and labels repeat; bounded
        types = (pa.int8(), pa.float64(), pa.int32(), pa.string(), pa.int8(), pa.float64(), pa.string())
        for b in batches:
            texts = b.column(3).to_pylist()
            if len(known) > 100_000:
                known.clear()
            if fresh := [t for t in dict.fromkeys(texts) if t not in known]:
                known.update(dict.fromkeys(fresh, ()))
                known.update(of(fresh))
            rows = [(i, r) for i, t in enumerate(texts) for r in known[t]]
            take = pa.array([i for i, _ in rows], pa.int64())
            new = [pa.array([r[k] for _, r in rows], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(3)), *new], names=["_key", "_file", "_font", "kind", "gain", "chain", "restored", "nth", "top", "old"])

    column = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("_key"), column(file).alias("_file"), column(font).alias("_font"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_key {kinds[key]}, _file string, _font string, kind byte, gain double, chain int, restored string, nth byte, top double, old string")


def decided(rated: DataFrame, least: float, file: str | None) -> DataFrame:
    """The rows of rate() under a margin: the best chain of a text that gains it is FOUND, and no other row of the text
    counts. Without a file nothing but FOUND is left, and no chain that doesn't gain the margin."""
    rows = rated.where((F.col("kind") == FOUND) | (F.col("top") <= least) | ((F.col("kind") == PERHAPS) & (F.col("nth") == 0)))
    kind = F.when((F.col("kind") == PERHAPS) & (F.col("gain") > least), F.lit(FOUND)).otherwise(F.col("kind")).cast("byte")
    rows = rows.select("_key", "_file", "_font", kind.alias("kind"), "gain", "chain", "restored")
    if file:
        return rows
    some = F.col("gain") > least
    return rows.where(F.col("kind") == FOUND).select("_key", "_file", "_font", "kind", F.when(some, F.col("gain")).otherwise(0.0).alias("gain"), F.when(some, F.col("chain")).alias("chain"), F.when(some, F.col("restored")).alias("restored"))


def by_file(rows: DataFrame) -> DataFrame:
    """The rows of PERHAPS whose file has their chain: from one run that gains the margin, or from several with different
    results that gain TOGETHER."""
    one = rows.where((F.col("kind") == FOUND) & F.col("chain").isNotNull() & (F.col("gain") > MARGIN)).select("_file", "chain")
    each = rows.where((F.col("gain") > SOME) & F.col("chain").isNotNull()).groupBy("_file", "chain", "restored").agg(F.max("gain").alias("gain"))
    more = each.groupBy("_file", "chain").agg(F.sum("gain").alias("all"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("all") > TOGETHER)).select("_file", "chain")
    return rows.where(F.col("kind") == PERHAPS).join(one.union(more).distinct(), ["_file", "chain"]).select(*rows.columns)


def by_font(rows: DataFrame, model: Model, limits: Limits, fonts: DataFrame) -> DataFrame:
    """The rows of UNLIKELY that the declared map of their font turns into likely text. fonts: path, font, cmap."""
    sent, names = rows.sparkSession.sparkContext.broadcast(model), rows.columns
    # code in hex to character, where a visible ASCII code stands for another character
    code = F.conv(F.col("e.key"), 16, 10).cast("int")
    some = fonts.where(F.col("cmap").isNotNull()).select("path", "font", "cmap", F.explode(F.map_entries("cmap")).alias("e"))
    odd = some.groupBy("path", "font").agg(F.count_if(code.between(33, 126) & (F.char(code) != F.col("e.value"))).alias("odd"), F.first("cmap").alias("cmap"))
    maps = odd.where(F.col("odd") > 5).select(F.col("path").alias("_file"), F.col("font").alias("_font"), F.map_entries("cmap").alias("map"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            old = b.column(6).to_pylist()
            new = []
            for t, entries in zip(old, b.column(7).to_pylist(), strict=True):
                to = {int(e["key"], 16): e["value"] for e in entries if e["value"]}
                new.append(t.translate({k: v for k, v in to.items() if 32 < k < 0x250}))
            ok = []
            if old:
                was, now = m.score(old)[0], m.score(new)[0]
                ok = [i for i in range(len(old)) if new[i] != old[i] and now[i] - was[i] > limits.margin]
                gain = pa.array([float(now[i] - was[i]) for i in ok], pa.float64())
                take = pa.array(ok, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(4)), gain, pa.array([FONT_MAP] * len(ok), pa.int32()), pa.array([new[i] for i in ok], pa.string())], names=names)

    joined = rows.where(F.col("kind") == UNLIKELY).join(maps, ["_file", "_font"]).select(*rows.columns, "map")
    return joined.mapInArrow(run, rows.schema)


def by_code(rows: DataFrame) -> DataFrame:
    """The rows of UNLIKELY in fonts of a file with several runs of coded words; their text is not restored."""
    r = rows.where(F.col("kind") == UNLIKELY).withColumn("_coded", F.pandas_udf(lambda s: s.map(coded), "boolean")("restored"))
    r = durable(r)
    fonts = r.where("_coded").groupBy("_file", "_font").agg(F.count("*").alias("n")).where("n > 1").select("_file", F.coalesce("_font", F.lit("")).alias("_name"))
    hit = r.withColumn("_name", F.coalesce("_font", F.lit(""))).join(fonts, ["_file", "_name"])
    hit = hit.where(F.col("_coded") | F.col("restored").rlike(r"[\p{L}][0-9]|[0-9]\p{L}|\p{Ll}\p{Lu}"))
    return hit.select("_key", "_file", "_font", "kind", "gain", "chain", F.lit(None).cast("string").alias("restored"))


def repair(df: DataFrame, model: Model, limits: Limits, key: str = "run_id", text: str = "text", file: str | None = None, font: str | None = None, fonts: DataFrame | None = None) -> DataFrame:
    """(key, gain, chain, restored), one row per key whose text was decoded wrongly. restored is null where no chain
    explains it. file, font: columns that say where a run stands; with them weak runs are judged by their file, and by
    the maps of `fonts` (path, font, cmap). Null and empty texts are left out; repeated rows count once."""
    rated = rate(df, model, limits, key, text, file, font)
    return judged(durable(rated) if file else rated, model, limits, key, file, font, fonts)


def judged(rated: DataFrame, model: Model, limits: Limits, key: str, file: str | None = None, font: str | None = None, fonts: DataFrame | None = None) -> DataFrame:
    """What repair() gives, from the rows of rate()."""
    rows = decided(rated, limits.margin, file)
    found = rows.where(F.col("kind") == FOUND)
    if file:
        found = rows.where(F.col("kind") == FOUND).union(by_file(rows))
        if font:
            found = found.union(by_code(rows))
            if fonts is not None:
                found = found.union(by_font(rows, model, limits, fonts))
    names = F.array(*(F.lit("/".join(c)) for c in CHAINS), F.lit("font map"))
    best = found.groupBy("_key").agg(F.max_by(F.struct("gain", "chain", "restored"), F.struct(F.col("restored").isNotNull(), "gain", "chain")).alias("b"))
    return best.select(F.col("_key").alias(key), "b.gain", F.get(names, F.col("b.chain")).alias("chain"), "b.restored")


def _fitted(runs: DataFrame, key: str, text: str, reference: DataFrame | None, file: str | None = None, font: str | None = None) -> tuple[Model, Limits, DataFrame]:
    """Model and limits, from all rows, and the rows rated by them."""
    model, _ = train(runs, text, reference)
    limits, rows = floors(runs, text, model)
    rated = durable(rate(runs, model, limits, key, text, file, font))
    return model, replace(limits, margin=margin(runs, text, rated, model, limits, rows)), rated


def fitted(runs: DataFrame, key: str, text: str, reference: DataFrame | None = None) -> tuple[Model, Limits]:
    """The model, counted over all clean runs, and limits that are quantiles over all clean runs."""
    return _fitted(runs, key, text, reference)[:2]


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "text_runs").where("font IS NULL OR font <> 'OCR'").select("run_id", "path", "font", "text")
    fonts = table(spark, sf_dir, "fonts").select("path", "font", "cmap")
    model, limits, rated = _fitted(runs, "run_id", "text", table(spark, sf_dir, "doc_pages").select("text"), "path", "font")
    return judged(rated, model, limits, "run_id", "path", "font", fonts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select("run_id")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs found, with the chain and the restored text where one is accepted."""
    return _repaired(spark, sf_dir)


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored}
SQL: dict[str, str] = {}
