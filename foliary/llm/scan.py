"""Problem 4: noise in the lines of scanned pages.

Edge lines are parted from the body by the gaps of the page; divided words are judged by how often the joined and the
hyphenated form occur in the body; misread words are rare tokens that an anagram-hash difference of a known confusion
turns into a much more frequent token (equi-joins in SQL; in scripts without spaces the tokens are character triples).
All windows are over one page; what crosses a page end is joined by page number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

#: What a scan makes of a letter, and the letter.
CONFUSIONS = """c e;e c;0 o;+ t;cl d;d cl;l i;i l;ii u;u ii;j i;rn m;m rn;9 g;b h;h b;I l;l I;| l;| I;li h;h li;1 l;1 I;vv w;8 B;5 S;5 s;6 b;
0 O;O 0;o 0;l 1;a ä;o ö;u ü;e é;a á;n ñ;н и;и н;п л;л п;0 о;0 О;ш щ;щ ш;о 0;bl ы;ьl ы;е с;с е;б 6;3 з;з 3;c о;t f;f t;丁 了;朋 期;八 人;冂 门;介 个;末 未;
入 人;问 间;伞 个;巳 已;己 已;仕 在;各 名;き ま;か が;犬 大;太 大;土 士;士 土;日 曰;曰 日;ソ ン;ン ソ;シ ツ;ツ シ;ほ は;末 来;千 干;干 千;贷 货;
鸟 乌;ま き;ぬ め;る ろ;ろ る;わ れ;れ わ;ク ワ;ワ ク;フ ワ;ラ ヲ;木 本;白 自;自 白;目 日;日 目;力 刀;ロ 口;口 ロ;ニ 二;二 ニ;夕 タ;タ 夕;ケ ヶ;エ 工;工 エ"""
PAIRS = [tuple(p.split()) for p in CONFUSIONS.replace("\n", "").split(";")]
#: Lengths of what a scan misreads.
SIZES = sorted({len(a) for a, _ in PAIRS})
#: How much more frequent the variant must be, and how often it must occur at least.
RATIO, RATIO_UNSPACED, LEAST = 10, 4, 5
HYPHENS = "\\-\u2010\u2011\u00ac\u2013\u00ad"
_number = r"(?:\d{1,4}|[ivxlIVXL1j|]{1,7}|[0-9lI|O]{1,3})"
_label = r"(?:page|p\.|pg\.|seite|s\.|página|pág\.|pagina|стр(?:\.|аница)?|с\.|第|หน้า(?:ที่)?|पृष्ठ|folio)?"
#: A page's number, alone or at the end or the beginning of an edge line.
ALONE = rf"(?i)^[\s·]*[\[(—–-]?\s*{_label}\s*{_number}\s*(?:(?:/|of|0f|von|de|sur|из|共|/\s*第)\s*[\dlIO|]{{1,4}})?\s*[\])—–-]?\s*(?:页|ページ|頁)?[\s·]*$"
AT_END = rf"(?i)(?:[\s·]+\[\s*{_number}\s*\]|[\s·]+[—–-]\s*{_number}\s*[—–-]|[\s·]+(?:page|p\.|seite|página|pág\.|стр\.?|第|หน้า|पृष्ठ)\s*{_number}(?:\s*(?:of|0f|von|de|sur|из|/)\s*[\dlIO|]{{1,4}})?(?:\s*(?:页|ページ|頁))?|[\s·]+[\dlIO|]{{1,3}}\s*/\s*[\dlIO|]{{1,3}}|[\s·]+\d{{1,3}}\s*(?:页|ページ|頁))\s*$"
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx"
TOKEN = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}0-9+|]+(?:['’][\p{IsLatin}]+)?"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
TRIPLE = r"(?=([\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]{3}))"


def lines(df: DataFrame) -> DataFrame:
    """One row per line_id, null texts left out, with zone (head, body or foot): at most two lines at either end of a
    page that a gap of more than twice the line height sets apart. Without positions all lines are body."""
    one = df.where("text IS NOT NULL AND line_id IS NOT NULL").select("line_id", "path", "page_no", "seq", "text", "y", "height").dropDuplicates(["line_id"])
    w = Window.partitionBy("path", "page_no").orderBy("seq", "line_id")
    size = F.coalesce(F.percentile_approx("height", 0.5).over(Window.partitionBy("path", "page_no")), F.lit(12.0))
    gap = F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0))
    x = one.withColumn("_gap", (gap > 2.2 * size).cast("int")).withColumn("_block", F.sum("_gap").over(w))
    page = Window.partitionBy("path", "page_no")
    x = x.withColumn("_last", F.max("_block").over(page)).withColumn("_in", F.count("*").over(Window.partitionBy("path", "page_no", "_block")))
    small = (F.col("_in") <= 2) & (F.col("_last") > 0)
    zone = F.when(small & (F.col("_block") == 0), "head").when(small & (F.col("_block") == F.col("_last")), "foot").otherwise("body")
    return x.select("line_id", "path", "page_no", "seq", "text", zone.alias("zone"))


def edge_kinds(x: DataFrame) -> DataFrame:
    """(line_id, noise_kind) header and page_number of edge lines."""
    t, n = F.trim("text"), F.col("page_no")
    roman = F.element_at(F.split(F.lit(ROMAN), " "), F.when(n.between(1, 20), n))
    last = F.lower(F.regexp_extract(t, r"[\s·]([0-9]{1,4}|[ivxlIVXL]{1,7})\s*$", 1))
    by_page = (last != "") & ((last == n.cast("string")) | (last == roman))
    alone = t.rlike(ALONE)
    kinds = F.array_compact(F.array(F.when(~alone & (F.length(t) > 0), "header"), F.when(alone | t.rlike(AT_END) | by_page, "page_number")))
    return x.where("zone <> 'body'").select("line_id", F.explode(kinds).alias("noise_kind"))


def body(x: DataFrame) -> DataFrame:
    """Body lines with the text of the next body line (of the next page at a page's end) and whether the line before
    ends in a hyphen."""
    b = x.where("zone = 'body'")
    w = Window.partitionBy("path", "page_no").orderBy("seq", "line_id")
    b = b.withColumns({"_next": F.lead("text").over(w), "_no": F.row_number().over(w), "_prev": F.lag("text").over(w)})
    first = b.where("_no = 1").select("path", (F.col("page_no") - 1).alias("page_no"), F.col("text").alias("_over"))
    final = b.where("_next IS NULL").select("path", (F.col("page_no") + 1).alias("page_no"), F.col("text").alias("_under"))
    b = b.join(first, ["path", "page_no"], "left").join(final, ["path", "page_no"], "left")
    ends = rf"\p{{L}}[{HYPHENS}]\s*$"
    before = F.coalesce("_prev", F.when(F.col("_no") == 1, F.col("_under")))
    return b.select("line_id", "path", "page_no", "seq", "text", F.coalesce("_next", F.when(F.col("_next").isNull(), F.col("_over"))).alias("next"), F.coalesce(before.rlike(ends), F.lit(False)).alias("after_hyphen"), F.col("text").rlike(ends).alias("ends_hyphen"))


def words(b: DataFrame) -> DataFrame:
    """(line_id, token): whole words of body lines and character triples of scripts without spaces; the two parts of a
    divided word are left out."""
    t = F.when(F.col("ends_hyphen"), F.regexp_replace("text", rf"[^\s]+[{HYPHENS}]\s*$", "")).otherwise(F.col("text"))
    t = F.when(F.col("after_hyphen"), F.regexp_replace(t, r"^\s*\S+", "")).otherwise(t)
    found = F.concat(F.regexp_extract_all(t, F.lit(TOKEN), 0), F.regexp_extract_all(t, F.lit(TRIPLE), 1))
    return b.select("line_id", F.explode(F.array_distinct(found)).alias("token"))


def anagram(text: Column) -> Column:
    """The sum of a value per character: texts with the same characters share it, and exchanging characters shifts it
    by a fixed difference."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: a + F.shiftrightunsigned(F.xxhash64(c), 22))


def corrections(counts: DataFrame) -> DataFrame:
    """(token, correction, n): the most frequent variant of each rare token; counts: (token, n)."""
    spark = counts.sparkSession
    rules = spark.createDataFrame(PAIRS, "a string, b string").withColumn("shift", anagram(F.col("b")) - anagram(F.col("a")))
    known = counts.where(F.col("n") >= LEAST).select(F.col("token").alias("correction"), F.col("n").alias("m"), anagram(F.col("token")).alias("h"))
    # every place of every token with the one or two characters there, joined with the fixed list by equality
    at = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.array(*(F.struct(i.alias("i"), F.substr("token", i, F.lit(k)).alias("a")) for k in SIZES)))
    places = counts.where(F.length("token") > 0).select("token", "n", anagram(F.col("token")).alias("_h"), F.explode(F.array_distinct(F.flatten(at))).alias("p"))
    tried = places.select("token", "n", "_h", "p.i", "p.a").join(F.broadcast(rules), "a").select("token", "n", "a", "b", (F.col("_h") + F.col("shift")).alias("h"), "i")
    variant = F.concat(F.substr("token", F.lit(1), F.col("i") - 1), F.col("b"), F.substr("token", F.col("i") + F.length("a"), F.length("token")))
    tried = tried.withColumn("variant", variant)
    hit = tried.join(known, "h").where((F.col("variant") == F.col("correction")) & (F.col("m") >= F.when(F.col("token").rlike(UNSPACED), RATIO_UNSPACED).otherwise(RATIO) * F.col("n")))
    return hit.groupBy("token").agg(F.max_by("correction", F.struct("m", "correction")).alias("correction"), F.max("m").alias("n"))


#: Digits and signs inside words in small letters, capital I after a small letter, letters between digits.
ODD = r"^(?=.*\p{Ll})(?:.*\p{Ll}[0-9+|](?![0-9])\p{L}?.*|.*(?<![0-9])[0-9+|]\p{Ll}{2,}.*|.*\p{Ll}I.*|.*\p{Ll}[+|0]$)$"
MIXED = r"(?<![\p{L}\d.,/-])\d+(?:[.,]\d+)?[OIl|](?:[.,]\d+|\d+)|(?<![\p{L}\d.,/-])[OIl|]\d*[.,]\d|\d[.,]\d*[OIl|](?![\p{L}\d])"
CODE = r"^(?:[0-9]+(?:st|nd|rd|th|er|re|e|o|a|m|km|kg|mm|cm|l|t|h|x|g)|[A-Za-z]{1,2}[0-9]+|m[0-9]|[0-9]+[a-zа-я]|v[0-9]+)$"


def misread(b: DataFrame) -> DataFrame:
    """(line_id) of body lines with a misrecognised character."""
    w = durable(words(b))
    counts = durable(w.groupBy("token").agg(F.count("*").alias("n")))
    plain = corrections(counts.where(~F.col("token").rlike(r"^[0-9+|]+$"))).select("token")
    odd = counts.where(F.col("token").rlike(ODD) & ~F.col("token").rlike(CODE) & (F.length("token") > 1)).select("token")
    bad = durable(plain.union(odd).distinct())
    return w.join(bad, "token", "left_semi").select("line_id").union(b.where(F.col("text").rlike(MIXED)).select("line_id")).distinct()


def divided(b: DataFrame) -> DataFrame:
    """(line_id, joined) of body lines that end inside a word divided for the line end only."""
    left = F.regexp_extract("text", rf"([\p{{L}}\p{{M}}'’{HYPHENS}]*[\p{{L}}\p{{M}}])[{HYPHENS}]\s*$", 1)
    right = F.regexp_extract("next", r"^\s*([\p{L}\p{M}]+)", 1)
    c = b.where("ends_hyphen AND next IS NOT NULL").select("line_id", left.alias("l"), right.alias("r"))
    c = c.where(F.col("r").rlike(r"^\p{Ll}") & (F.length("l") > 0))
    c = c.select("line_id", "r", F.lower(F.concat("l", "r")).alias("joined"), F.lower(F.concat(F.regexp_replace("l", f"[{HYPHENS}]", "-"), F.lit("-"), F.col("r"))).alias("kept"))
    c = durable(c)
    text = F.lower(F.when(F.col("ends_hyphen"), F.regexp_replace("text", rf"\S+[{HYPHENS}]\s*$", "")).otherwise(F.col("text")))
    text = F.when(F.col("after_hyphen"), F.regexp_replace(text, r"^\s*\S+", "")).otherwise(text)
    forms = b.select(F.explode(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)*"), 0)).alias("form"))
    wanted = c.select(F.explode(F.array("joined", "kept")).alias("form")).distinct()
    seen = durable(forms.join(wanted, "form", "left_semi").groupBy("form").agg(F.count("*").alias("n")))
    c = c.join(seen.toDF("joined", "nj"), "joined", "left").join(seen.toDF("kept", "nk"), "kept", "left").fillna(0, ["nj", "nk"])
    # compounds show themselves inside lines; a word that never does either is taken as divided, a hanging "and" is not
    hanging = F.col("r").isin("und", "oder", "bzw", "and", "or", "et", "ou", "y", "o", "и", "или") & (F.col("nj") == 0)
    return c.where((F.col("nk") <= F.col("nj")) & ~hanging).select("line_id", "joined")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(lines(table(spark, sf_dir, "ocr_lines")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir)
    b = durable(body(x))
    kind = lambda df, k: df.select("line_id", F.lit(k).alias("noise_kind"))
    return edge_kinds(x).union(kind(divided(b), "hyphen")).union(kind(misread(b), "misread")).distinct()


def paragraphs(x: DataFrame) -> DataFrame:
    """(path, page_no, body): the body of each page as running text. Edge lines are left out, misread words get their
    most frequent correction, divided words are joined; a page without body lines has no row."""
    b = durable(body(x))
    w = durable(words(b))
    fixes = durable(corrections(w.groupBy("token").agg(F.count("*").alias("n")).where(~F.col("token").rlike(r"^[0-9+|]+$"))).select("token", "correction"))
    own = w.join(fixes, "token").groupBy("line_id").agg(F.collect_list(F.struct("token", "correction")).alias("fix"))
    y = b.join(own, "line_id", "left").join(divided(b).select("line_id", F.lit(True).alias("cut")), "line_id", "left")
    fixed = F.coalesce(F.aggregate("fix", F.col("text"), lambda t, f: F.replace(t, f["token"], f["correction"])), F.col("text"))
    end = F.when(F.col("cut"), F.regexp_replace(F.rtrim(fixed), f"[{HYPHENS}]$", "")).otherwise(F.concat(F.rtrim(fixed), F.when(F.col("ends_hyphen") | F.rtrim(fixed).rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}。，、]$"), "").otherwise(" ")))
    y = y.groupBy("path", "page_no").agg(F.array_sort(F.collect_list(F.struct("seq", "line_id", end.alias("t")))).alias("ls"))
    return y.select("path", "page_no", F.trim(F.array_join(F.transform("ls", lambda s: s["t"]), "")).alias("body"))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(_lines(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_paragraphs": p4_paragraphs}
SQL: dict[str, str] = {}
