"""Problem 5: one form for visually identical text.

Words with a character in an unusual form are cut out of the texts by one JVM pattern; only the distinct words are
mapped to their look-alike key. The keys are grouped under the accent-sensitive Unicode collation, every class takes as
its member the value with the fewest unusual characters (then the most frequent, then the least in binary order), and
the members are joined back to the records.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, records
from .figures import KINDS
from .quality import describe

#: Fixed values, as Java and Python classes understand them: forms that are not the usual ones.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\U000e0001-\U000e01ef"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
WIDTHS = "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\uffdc"
VARIANTS = "\u0132\u0133\u013f\u0140\u0149\u017f\u01c4-\u01cc\u01f1-\u01f3\u2e80-\u2ef3\u2f00-\u2fd5\uf900-\ufaff\ufb00-\ufb17\ufb50-\ufdff\ufe70-\ufefc\U0001d400-\U0001d7ff\U0002f800-\U0002fa1f"
MARKS = "\u0300-\u036f\u3099\u309a"
LATIN, GREEK, CYRILLIC = "A-Za-zÀ-ɏ", "Ͱ-Ͽ", "Ѐ-ԯ"
#: Letters of other scripts beside the Latin letters that look the same.
LOOKS = {
    "CYRILLIC": ("АВЕЅІЈКМНОРСТУХЗаеѕіјорсухԁԛԝһӏ", "ABESIJKMHOPCTYX3aesijopcyxdqwhl"),
    "GREEK": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικτχγ", "ABEZHIKMNOPTYXavopuiktxy"),
}
_GAP = f"[{INVISIBLE}{MARKS}]*"
MIXED = "|".join(f"[{a}]{_GAP}[{b}]" for a, b in ((LATIN, CYRILLIC + GREEK), (CYRILLIC + GREEK, LATIN), (GREEK, CYRILLIC), (CYRILLIC, GREEK)))
UNUSUAL = f"[{INVISIBLE}{SPACES}{WIDTHS}{VARIANTS}{MARKS}]"
#: Where words end; marks of Chinese and Japanese are among them, as these scripts have no spaces.
BREAKS = r" \t\r\n。，、；：？！“”（）「」"
WORD = f"[^{BREAKS}]*(?:{UNUSUAL}|{MIXED})[^{BREAKS}]*"

_invisible, _folded = re.compile(f"[{INVISIBLE}]"), re.compile(f"[{WIDTHS}゙゚]+|[{VARIANTS}]")
_letters = re.compile(f"[{LATIN}{GREEK}{CYRILLIC}{MARKS}]+")
_composed = re.compile(f"[{LATIN}{GREEK}{CYRILLIC}぀-ヿ][{MARKS}]+")
_kana = re.compile("[ｦ-ﾟ゠-ヿ][ﾞﾟ゙゚]")


def _needed(s: str, i: int) -> bool:
    """Whether the invisible character at i is part of an emoji or of Thai, Hindi or a related script."""
    left, right = s[i - 1 : i], s[i + 1 : i + 2]
    emoji = lambda c: bool(c) and (unicodedata.category(c) in ("So", "Sk") or c in "️‍#*0123456789" and c != "")
    if s[i] in "‍️︎" and left and unicodedata.category(left) in ("So", "Sk", "Mn", "Cf") and emoji(left):
        return True
    if s[i] in "‌‍" and left and "ऀ" <= left <= "෿":
        return True
    if s[i] == "​" and left and right and "฀" <= left <= "໿" and "฀" <= right <= "໿":
        return True
    return "\U000e0020" <= s[i] <= "\U000e007f" and ("\U0001f3f4" in s)


def _script(c: str) -> str:
    return "CYRILLIC" if "Ѐ" <= c <= "ԯ" else "GREEK" if "Ͱ" <= c <= "Ͽ" else "LATIN" if c.isalpha() else ""


_TO_LATIN = {k: dict(zip(*v, strict=True)) for k, v in LOOKS.items()}
_FROM_LATIN = {k: {b: a for a, b in zip(*v, strict=True) if b.isalpha()} for k, v in LOOKS.items()}


def _one_script(m: re.Match) -> str:
    w = m.group()
    n = {k: sum(_script(c) == k for c in w) for k in ("LATIN", "CYRILLIC", "GREEK")}
    if sum(v > 0 for v in n.values()) < 2:
        return w
    main = max(n, key=lambda k: (n[k], k == "LATIN"))

    def turn(c: str) -> str:
        own = _script(c)
        if own in ("", main):
            return c
        latin = c if own == "LATIN" else _TO_LATIN[own].get(c)
        to = latin if main == "LATIN" or latin is None else _FROM_LATIN[main].get(latin)
        return to or c

    return "".join(map(turn, w))


def look(word: str) -> str:
    """The look-alike key of a word: what it would be in the usual characters."""
    w = "".join(c for i, c in enumerate(word) if not _invisible.match(c) or _needed(word, i))
    w = re.sub(f"[{SPACES}]", " ", w)
    w = _kana.sub(lambda m: unicodedata.normalize("NFKC", m.group()), w)
    w = _folded.sub(lambda m: unicodedata.normalize("NFKC", m.group()), w)
    w = _composed.sub(lambda m: unicodedata.normalize("NFC", m.group()), w)
    return _letters.sub(_one_script, w)


def looks(words: pd.Series) -> pd.Series:
    return words.map(look)


def members(words: DataFrame) -> DataFrame:
    """(word, n) to (word, member): the member of the word's class. Null words are left out, repeated ones added up."""
    # the key itself belongs to its class: texts in the usual form carry it
    mapped = words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).withColumn("key", F.pandas_udf(looks, "string")("word"))
    usual = mapped.select(F.col("key").alias("word"), F.lit(0).cast("long").alias("n"), "key")
    both = mapped.unionByName(usual).withColumn("class", F.collate(F.col("key"), "UNICODE"))
    worth = F.struct((F.col("word") != F.col("key")).cast("int").alias("a"), F.regexp_count("word", F.lit(UNUSUAL)).alias("b"), (-F.col("n")).alias("c"), F.col("word").alias("d"))
    classes = both.groupBy("class").agg(F.min_by("word", worth).alias("member"))
    return mapped.withColumn("class", F.collate(F.col("key"), "UNICODE")).join(classes, "class").select("word", "member")


def unusual_words(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(*keys, word), one row per row and distinct word with a character in an unusual form."""
    rows = df.where(F.col(text).rlike(f"{UNUSUAL}|{MIXED}"))
    return rows.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), 0))).alias("word"))


def find(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(*keys, word, member): words that are not the member of their class. Null and blank texts have none."""
    words = durable(unusual_words(df, keys, text))
    m = durable(members(words.groupBy("word").agg(F.count("*").alias("n"))).where("word <> member"))
    return words.join(m, "word").select(*keys, "word", "member")


def unify(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """All rows (*keys, text) with every such word replaced by its member; null texts stay null, repeated rows stay
    repeated."""
    changed = find(df, keys, text).groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("word", "member"))).alias("_to"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    cond: Column = same[0]
    for c in same[1:]:
        cond = cond & c
    parts = F.split(F.col(f"l.{text}"), f"(?<=[{BREAKS}])|(?=[{BREAKS}])")
    fixed = F.array_join(F.transform(parts, lambda w: F.coalesce(F.element_at(F.col("r._to"), w), w)), "")
    distinct = changed.alias("r")
    return df.alias("l").join(distinct, cond, "left").select(*(F.col(f"l.{k}") for k in keys), F.when(F.col("r._to").isNull(), F.col(f"l.{text}")).otherwise(fixed).alias(text))


def _without_junk(df: DataFrame) -> DataFrame:
    """Junk pages are not rated; only rows with an unusual form are looked at."""
    rows = describe(df.where(F.col("text").rlike(f"{UNUSUAL}|{MIXED}")), {}, keep=df.columns)
    junk = (F.col("record_kind") == "page") & (F.col("c_junk") > 0) & (F.col("c_junk") == F.greatest(*(F.col(f"c_{k}") for k in KINDS)))
    return rows.where(~junk).select(*df.columns)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(_without_junk(records(spark, sf_dir)), ["record_kind", "record_id"]).select("record_kind", "record_id").distinct()


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and cell in one form."""
    rows = records(spark, sf_dir)
    odd = F.coalesce(F.col("text").rlike(f"{UNUSUAL}|{MIXED}"), F.lit(False))
    return rows.where(~odd).unionByName(unify(rows.where(odd), ["record_kind", "record_id"]))


QUERIES = {"p5_found": p5_found, "p5_unified": p5_unified}
SQL: dict[str, str] = {}
