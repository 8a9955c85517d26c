"""Small cases with brute force or known answers, and the awkward inputs: nulls, empty and very long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary import llm
from foliary.llm import encoding, figures, level, lookalike, mix, neardup, pii, quality, scan, sentences, tokens
from foliary.llm.bpe import transducer
from foliary.llm.common import tokenizer_path

WORDS = {"en": "the of and to in a is that for it was on with as by at be this which not are".split(), "de": "der die das und in zu den von mit ist ein eine nicht auf für dem".split(), "zh": list("的了在是和不有与对为于中上也就都而及将由")}
PROSE = "The gate keeper of the town was in the yard. It was late and the lamp was on. "
LONG = PROSE * 3000


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# 1 -------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("", "blank"), ("The office confirmed that it was late.", "prose"), ("• Blue ink", "list"), ("3.2 the roof Andor ........ 12", "list"), ("Batch: 2 March 2017", "list"), ("a\tb\tc", "table"),
        ("Item          Quantity      Unit", "table"), ("zng qmmqrbwc pmctspkk zhtqz wwmbs dsdj", "junk"), ("== == == == == == == == == ==", "junk"), ("12c8728d1a517598b0b432482d15f01394ab9b75", "junk"),
        ('<w:p w:val="1"/></w:r>', "junk"), ("因为送往青云的货物晚了38天，我们的小组只好关上了椅子。", "prose"), ("Rain cover, Filter set (XLS.82235.5),", "list"),
    ],
)
def test_line_kinds(line, kind):
    assert figures.line_kind(line) == kind


def test_figures_by_hand():
    f = figures.figures([None, "", "Ab cd. 12!\nthe zz", LONG], WORDS)
    assert list(f["n_words"][:3]) == [0, 0, 5] and list(f["n_lines"][:3]) == [0, 0, 2]
    assert f["line_end_ratio"][2] == 0.5 and np.isnan(f["symbol_ratio"][0])
    assert f["digit_ratio"][2] == pytest.approx(2 / 13) and f["symbol_ratio"][2] == pytest.approx(2 / 13)
    assert f["common_ratio"][2] == pytest.approx(1 / 5) and f["novowel_ratio"][2] == pytest.approx(2 / 5) or f["lang"][2] == "en"
    assert f["lang"][3] == "en"


def test_kinds_and_tails(spark):
    rows = [("page", i, PROSE * 2) for i in range(30)] + [("page", 40, "1) a\n2) b\n3) c"), ("page", 41, None), ("page", 41, None), ("page", 42, ""), ("cell", 43, "Door hinge Lo, Blue ink Ma, Label roll 12"), ("page", 44, LONG)]
    got = {r.record_id: r.text_kind for r in quality.classify(frame(spark, rows, "record_kind string, record_id long, text string"), WORDS).collect()}
    assert (got[0], got[40], got[41], got[42], got[43], got[44]) == ("prose", "list", None, None, "list", "prose")
    assert quality.classify(frame(spark, [], "record_kind string, record_id long, text string"), WORDS).count() == 0


def test_percentiles_against_sorting(spark):
    s = quality.describe(frame(spark, [(i, "the " + "x" * (i + 1)) for i in range(101)], "id long, text string"), WORDS)
    p = {r.id: (r.p_mean_word_len, r.z_mean_word_len) for r in quality.percentiles(s, quality.sketches(s)).collect()}
    assert abs(p[50][0] - 0.5) < 0.06 and abs(p[50][1]) < 0.1 and p[100][0] > 0.95


# 2 -------------------------------------------------------------------------------------------------------------------
def test_repair(spark):
    clean = [f"Die Fähre öffnete zwei Säcke für den Gärtner Nr. {i}." for i in range(400)] + [f"因为送往青云的货物晚了{i}天，护士只好关上了大门。" for i in range(400)]
    bad = {"utf": "Die Fähre öffnete zwei Säcke.".encode().decode("cp1252"), "gbk": "因为送往青云的货物晚了，护士只好关上了大门。".encode("gbk").decode("latin-1"), "lost": "Die F�hre", "swap": "zwei Säcke".encode("utf-16-le").decode("utf-16-be")}
    rows = list(enumerate(clean)) + [(1000, bad["utf"]), (1001, bad["gbk"]), (1002, bad["lost"]), (1003, bad["swap"]), (1004, None), (1005, ""), (1006, "São Brevo"), (1000, bad["utf"])]
    df = frame(spark, rows, "run_id long, text string")
    got = {r.run_id: r.restored for r in encoding.repair(df, *encoding.fitted(df, "run_id", "text")).collect()}
    assert set(got) == {1000, 1001, 1002, 1003}
    assert got[1000] == "Die Fähre öffnete zwei Säcke." and got[1001].startswith("因为送往") and got[1003] == "zwei Säcke" and got[1002] is None


ROLES = ["护士", "厨师", "园丁", "邮递员", "面包师", "司机", "妹妹", "检查员"], ["关上了大门", "弄丢了篱笆", "买下了面包", "擦干净了名单", "修好了轮子", "看见了屋顶", "装满了台灯", "带来了钥匙"], ["新来的同事", "我们的小组", "负责人", "监督管理机构", "计量校准试验所", "排水工程联合体"]


def sentences_of(n):
    a, b, c = ROLES
    return [f"因为送往青云的货物晚了{i}天，{a[i % 8]}和{c[i % 6]}只好{b[i // 8 % 8]}。" for i in range(n)]


def turned(t, read, written):
    return t.encode(written).decode(read)


def turnable(texts, read, written):
    """(text, garbled text) of the texts that every byte of can be read so, without broken characters."""
    pairs = [(t, t.encode(written).decode(read, "replace")) for t in texts]
    return [(t, g) for t, g in pairs if not encoding.BROKEN.search(g)]


def test_repair_of_wide_text_read_as_wide_text(spark):
    """Wholly garbled runs, so many that they teach a model that counts them, and stretches within clean runs."""
    big = turnable([t[12:] for t in sentences_of(1400)[900:]], "big5hkscs", "gb18030")[:20]
    assert len(big) == 20
    rows = list(enumerate(sentences_of(900))) + [(2000 + i, g) for i, (_, g) in enumerate(big)]
    parts = {4000: ("关上了大门", "big5hkscs", "gb18030"), 4001: ("护士厨师", "gb18030", "utf-8"), 4002: ("擦干净了名单", "cp1252", "gb18030")}
    rows += [(k, f"因为送往青云的货物晚了7天，护士只好{turned(*p)}。") for k, p in parts.items()]
    df = frame(spark, rows, "run_id long, text string")
    got = {r.run_id: r.restored for r in encoding.repair(df, *encoding.fitted(df, "run_id", "text")).collect()}
    assert set(got) == {k for k, _ in rows if k >= 2000}
    assert all(got[2000 + i] == t for i, (t, _) in enumerate(big))
    assert got[4000] == "因为送往青云的货物晚了7天，护士只好关上了大门。"


def test_garbled_wide_text_teaches_nothing(spark):
    good = sentences_of(900)
    bad = [g for _, g in turnable([t[12:] for t in good], "big5hkscs", "gb18030")[:20]]
    assert len(bad) == 20
    schema = "run_id long, text string"
    both, alone = (encoding.train(frame(spark, list(enumerate(t)), schema), "text") for t in (good + bad, good))
    assert both[1] == alone[1] == 900
    assert (both[0].count == alone[0].count).all() and (both[0].pairs == alone[0].pairs).all()


WORDS_OF = ["Die Fähre öffnete zwei Säcke und schloss die Türen", "Die Müllerin grüßte den Bäcker am schönen Flüsschen", "El camión llegó mañana a la estación", "Le garçon a mangé où la forêt brûlait déjà"]
TURNED = [("cp850", "utf-8"), ("cp1250", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252")]


def test_product_of_codecs(spark):
    """Every text of the list garbled by every chain, among clean runs that hold the same words."""
    good = [f"{t} {i}" for i in range(60) for t in WORDS_OF]
    bad = {5000 + 10 * k + n: (t, turned(t, *c)) for k, c in enumerate(TURNED) for n, t in enumerate(WORDS_OF)}
    rows = list(enumerate(good)) + [(k, g) for k, (_, g) in bad.items()] + [(9000, turned(turned(WORDS_OF[0], "cp1252", "utf-8"), "cp1252", "utf-8"))]
    ref = frame(spark, [(t,) for t in good], "text string")
    df = frame(spark, rows, "run_id long, text string")
    got = {r.run_id: r.restored for r in encoding.repair(df, *encoding.fitted(df, "run_id", "text", ref)).collect()}
    assert set(got) == set(bad) | {9000}
    assert all(got[k] == t for k, (t, _) in bad.items()) and got[9000] == WORDS_OF[0]


def test_swapped_bytes_with_blanks_kept(spark):
    good = sentences_of(300) + [f"{t} {i}" for i in range(60) for t in WORDS_OF]
    swap = lambda t: "".join(c if c == " " else c.encode("utf-16-be").decode("utf-16-le") for c in t)
    bad = {7000: WORDS_OF[0].replace("ß", "ss"), 7001: good[5], 7002: "A4 12.50 EUR 1749.00"}
    df = frame(spark, list(enumerate(good)) + [(k, swap(t)) for k, t in bad.items()], "run_id long, text string")
    got = {r.run_id: r.restored for r in encoding.repair(df, *encoding.fitted(df, "run_id", "text", frame(spark, [(t,) for t in good + ["Paper A4 12.50 EUR 1749.00 kg"] * 9], "text string"))).collect()}
    assert got == bad


def test_files_and_fonts(spark):
    """One short run is judged by its file; the map of a font restores codes; codes without a map are found in groups."""
    good = [f"{t} {i}" for i in range(80) for t in WORDS_OF] + [PROSE] * 40
    code = str.maketrans("abcdefghijklmnopqrstuvwxyz", "nKt7WbF3sQ0TwkL8Iq5yHzcX1v")
    lines = ["the gate keeper of the town was in the yard", "it was late and the lamp was on", "the lamp of the gate was in the town"]
    rows = [(i, "a.pdf", "F", t) for i, t in enumerate(good)]
    rows += [(3000, "b.pdf", "F", turned(WORDS_OF[2], "mac_roman", "cp1252")), (3001, "b.pdf", None, turned("año", "mac_roman", "cp1252")), (3002, "a.pdf", "F", "año"), (3003, None, None, "año")]
    rows += [(4000 + k, "c.pdf", "G", t.translate(code)) for k, t in enumerate(lines)] + [(5000 + k, "d.pdf", None, t.translate(code)) for k, t in enumerate(lines)] + [(6000, "a.pdf", "F", "gahqjSsCzCUPuh1a3FaWknTbdYBJImKQGicCrZOCE0xjWdCr0cnyRR4S")]
    df = frame(spark, [*rows, rows[-1], (7000, None, None, None), (7001, "x", "y", "")], "run_id long, path string, font string, text string")
    fonts = frame(spark, [("c.pdf", "G", {f"{v:04X}": chr(k) for k, v in code.items()}), ("c.pdf", "H", None), ("a.pdf", "F", {"0041": "A"})], "path string, font string, cmap map<string,string>")
    model = encoding.fitted(df, "run_id", "text", frame(spark, [(t,) for t in good], "text string"))
    got = {r.run_id: (r.chain, r.restored) for r in encoding.repair(df, *model, "run_id", "text", "path", "font", fonts).collect()}
    assert {k for k in got if k < 7002} == {3000, 3001, 4000, 4001, 4002, 5000, 5001, 5002}
    assert got[3001] == ("mac_roman/cp1252", "año") and [got[4000 + k] for k in range(3)] == [("font map", t) for t in lines]
    assert all(got[5000 + k] == (None, None) for k in range(3))


def test_limits_come_from_all_clean_runs(spark):
    """Quantiles over every clean run, far more of them than any sample held; a run that is broken or short counts not."""
    rng = random.Random(11)
    words = [w.strip(".,") for t in WORDS_OF + [PROSE] for w in t.split()]
    good = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 12))) + f" {rng.randint(0, 9999)}" for _ in range(9000)] + sentences_of(900)
    df = frame(spark, list(enumerate([*good, "\ufffd\ufffd broken text here", "short", None, ""])), "run_id long, text string")
    model, limits = encoding.fitted(df, "run_id", "text")
    total, least, size, wide = model.score([t for t in good if len(t) >= 8], wide=True)
    mean, q = total / size, encoding.TRIED
    want = [np.quantile(least[~wide], q), np.quantile(mean[~wide], q / 2), np.quantile(least[wide], q / 2), np.quantile(mean[wide], q / 2)]
    got = [limits.floor, limits.usual, limits.floor_wide, limits.usual_wide]
    assert np.allclose(got, want, rtol=0, atol=1.01 / encoding.STEP) and limits.margin == encoding.MARGIN


def test_margin_counts_all_clean_runs(spark):
    """More than a hundredth of the clean runs gain: the margin lies between them and the same runs garbled."""
    assert encoding.quantile({0: 97, 5: 2, 9: 1}, 0.99) == pytest.approx(np.quantile([0] * 97 + [5] * 2 + [9], 0.99))
    df = frame(spark, [(i, f"{t} {i}") for i in range(60) for t in WORDS_OF], "run_id long, text string")
    model, limits = encoding.fitted(df, "run_id", "text")
    schema = "kind byte, nth byte, old string, gain double"
    rated = lambda g: frame(spark, [(encoding.PERHAPS, 0, f"{WORDS_OF[0]} {i}", g) for i in range(30)], schema)
    low = encoding.margin(df, "text", rated(8.0), model, limits, 240)
    mid = encoding.margin(df, "text", rated(11.0), model, limits, 240)
    high = encoding.margin(df, "text", rated(1000.0), model, limits, 240)
    assert low == encoding.MARGIN < mid == pytest.approx(11.0, rel=1e-3) and mid < high < 1000


def test_repair_of_nothing(spark):
    df = frame(spark, [], "run_id long, text string")
    assert encoding.repair(df, *encoding.fitted(df, "run_id", "text")).count() == 0


# 3 -------------------------------------------------------------------------------------------------------------------
TRAIN = [f"The parcel goes to {i} Oak Street, Milton, ZZ 1234{i % 10}, attention of {n}. Applicant: {n}, ID number 925 14 461{i % 10}." for i, n in enumerate(["Greta Ashgrave", "Tobin Harskin", "Odette Quenby"] * 8)]


def test_items():
    f = pii.Field(TRAIN)
    t = "Call +1 533 555 0125. Write to greta(at)mail.example.net or a.b@c.example. Greta Ashgrave lives at Flat 2c, 7 Oak Road, Apt 3, Selton QZ2 4YY. Tracking no. 2024-17-27 and QQ123456A. Ada Street is long."
    got = {(k, t[a:e]) for a, e, k in f.items(t)}
    assert got == {("phone", "+1 533 555 0125"), ("email", "greta(at)mail.example.net"), ("email", "a.b@c.example"), ("name", "Greta Ashgrave"), ("address", "Flat 2c, 7 Oak Road, Apt 3, Selton QZ2 4YY"), ("id_number", "QQ123456A")}
    assert f.items(None) == f.items("") == [] and f.items(LONG) == []


def test_places_in_odd_characters():
    f = pii.Field(TRAIN)
    t = "电话＋１ ５３３ ５５５ ０１２５。 Gre​ta Ashgrave"
    assert {t[a:e] for a, e, _ in f.items(t)} == {"＋１ ５３３ ５５５ ０１２５", "Gre​ta Ashgrave"}


def test_message_passing_agrees_with_enumeration():
    u, edges = [2.0, -0.5, 0.3], {(0, 1): 1.5, (1, 2): 0.3}
    states = list(itertools.product((0, 1), repeat=3))
    w = [np.exp(sum(x * s for x, s in zip(u, st, strict=True)) + sum(c * (st[i] == st[j]) for (i, j), c in edges.items())) for st in states]
    exact = [np.log(sum(x for x, s in zip(w, states, strict=True) if s[i]) / sum(x for x, s in zip(w, states, strict=True) if not s[i])) for i in range(3)]
    assert np.allclose(pii.Field._propagate(u, edges), exact, atol=1e-3)


def test_redaction(spark):
    df = frame(spark, [("page", 1, "Mail a.b@c.example now"), ("page", 2, None), ("cell", 1, "")], "record_kind string, record_id long, text string")
    got = {(r.record_kind, r.record_id): r.text for r in pii.redact(df, pii.Field([]), ["record_kind", "record_id"]).collect()}
    assert got == {("page", 1): "Mail [EMAIL] now", ("page", 2): None, ("cell", 1): ""}
    assert pii.find(frame(spark, [], "id long, text string"), pii.Field([]), ["id"]).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------
def scanned(spark, pages):
    rows, i = [], 0
    for (path, no), lines in pages.items():
        for k, (y, t) in enumerate(lines):
            i += 1
            rows += [(i, path, no, k, t, float(y), 11.0)] * (1 + (i == 2))
    return frame(spark, rows, "line_id long, path string, page_no int, seq int, text string, y double, height double")


def test_noise_of_scans(spark):
    body = [(72 + 13 * k, t) for k, t in enumerate(["the second-hand lamp of the department"] * 60)]
    page = [(36, "Storage class Veovo [1]"), (72, "the depart-"), (85, "ment saw the second-"), (98, "hand lamp. thc night guard"), (818, "p. 1")]
    x = scan.lines(scanned(spark, {("a", 1): page, ("b", 1): body, ("c", 1): [(72, None), (85, "")]}))
    b = scan.body(x)
    got = {(r.line_id, r.noise_kind) for r in scan.edge_kinds(x).collect()} | {(r.line_id, "hyphen") for r in scan.divided(b).collect()} | {(r.line_id, "misread") for r in scan.misread(scan.body(scan.lines(scanned(spark, {("a", 1): page, ("b", 1): [(y, t + " guard") for y, t in body]})))).collect()}
    assert got == {(1, "header"), (1, "page_number"), (5, "page_number"), (2, "hyphen"), (4, "misread")}
    text = {r.path: r.body for r in scan.paragraphs(x).collect()}
    assert text["a"].startswith("the department saw the second-hand lamp. the night")


def test_anagram_differences(spark):
    h = spark.range(1).select((scan.anagram(F.lit("then")) - scan.anagram(F.lit("thcn"))).alias("a"), (scan.anagram(F.lit("e")) - scan.anagram(F.lit("c"))).alias("b")).first()
    assert h.a == h.b


def test_no_lines(spark):
    assert scan.misread(scan.body(scan.lines(scanned(spark, {})))).count() == 0


# 5 -------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("word", "usual"),
    [
        ("ＷＧ-２０", "WG-20"), ("pério", "pério"), ("S﻿ha​w", "Shaw"), ("6.2 a", "6.2 a"), ("ﬁxed", "fixed"), ("⼩狗", "小狗"), ("notrе", "notre"), ("Милcк", "Милск"), ("ﾃﾝﾙ", "テンル"), ("ﾌﾟ", "プ"),
        ("👩‍🔧", "👩‍🔧"), ("क्‍ष", "क्‍ष"), ("m²", "m²"), ("，！", "，！"), ("Милск", "Милск"), ("½", "½"), ("ภาษา​ไทย", "ภาษา​ไทย"),
    ],
)
def test_looks(word, usual):
    assert lookalike.look(word) == usual


def test_unified(spark):
    rows = [("page", 1, "Ｔorona is here"), ("page", 2, "Torona is here"), ("page", 2, "Torona is here"), ("cell", 1, None), ("cell", 2, ""), ("page", 3, LONG + "é")]
    df = frame(spark, [(*r, "x") for r in rows], "record_kind string, record_id long, text string, member string")
    got = {(r.record_kind, r.record_id): r.text for r in lookalike.unify(df, ["record_kind", "record_id"]).collect()}
    assert got[("page", 1)] == got[("page", 2)] == "Torona is here" and got[("cell", 1)] is None and got[("page", 3)].endswith("é")
    assert {(r.record_kind, r.record_id) for r in lookalike.find(df, ["record_kind", "record_id"]).collect()} == {("page", 1), ("page", 3)}
    assert lookalike.find(df.limit(0), ["record_kind", "record_id"]).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def weights():
    texts = [
        "The average cost rose to 3.50 per unit, while the goat saw it. See sec. 4.2 of the manual, p. 32, before you close the file. Add oil, water, etc. to the tank at 7.20 a.m. and stir.\n\nThe shop had 24 of them. We saw it.",
        "Am 9. März kam Kiste Nr. 18 an. Die Probe wog ca. 3,5 kg, d. h. weniger als dort. Der Hund lief weg.\n\nDas Kind sah die Tür.", "“Keep dry.” is printed on box No. 4 here. Is it late? It is.\n\nThe end came.",
        "负责人说：“设备已经检修完毕。”园丁去了霞临。“封条完好吗？”检查员问道。灯……还亮着。他问：“何时开工？何时完工？”随后离开。\n\n老师来了。", "สำนักงานที่นาโมแจ้งว่าเปิดแล้ว ราคาเฉลี่ยขึ้นเป็น 62 บาทแล้ว ครูซื้อกุญแจ",
    ]
    return sentences.fit(texts * 20)


@pytest.mark.parametrize(
    "parts",
    [
        ["The sample weighed approx. 45.2 kg, i.e. less than there. ", "We saw Milo. ", "It rained."], ["Delivery terms\n\n", "The office closed. ", "“Keep dry.” is printed on box No. 12 from Lum.\n", "The cook\nleft."],
        ["Am 22. März kam Kiste Nr. 28 an. ", "Der Hund lief."], ["他问：“何时开工？何时完工？”随后离开。", "“封条完好吗？”检查员问道。", "园丁去了霞临。"], ["สำนักงานแจ้งว่าบันทึกไว้ 9 ครั้ง ", "ครูซื้อกุญแจ"],
        ["It was late.", "Next came the cook."],
    ],
)
def test_sentences(weights, parts):
    want = [sum(map(len, parts[:i])) for i in range(len(parts))]
    got = sentences.starts("".join(parts), weights)
    assert got == want


def test_sentences_of_odd_texts(spark, weights):
    df = frame(spark, [(1, None), (2, ""), (3, " \n"), (4, "  One."), (4, "  One."), (5, LONG)], "page_id long, text string")
    got = sentences.segment(df, weights).collect()
    assert [(r.page_id, r.start_pos, r.sentence) for r in got if r.page_id < 5] == [(4, 2, "One.")] * 2
    assert sum(r.page_id == 5 for r in got) == 6000


# 7 -------------------------------------------------------------------------------------------------------------------
def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    rows = []
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(120)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(2):
            other = list(base)
            for _ in range(rng.randint(0, 9)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            if i % 3 == 0:
                k = len(other) // 2
                other = other[k:] + other[:k]
            rows.append((len(rows), " ".join(other)))
    rows += [(500, rows[0][1]), (501, rows[0][1].upper()), (0, rows[0][1]), (502, None), (503, ""), (504, "short")]
    found, members = neardup.links(frame(spark, [(*r, "z") for r in rows], "page_id long, text string, a string"))
    got = {(r.a, r.b) for r in neardup.pairs_of(found, members, "page_id").collect()}
    texts = {i: "".join(t.split()).lower() for i, t in rows if t}
    grams = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in texts.items() if len(t) >= 400}
    want = {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if len(grams[a] & grams[b]) >= 0.75 * len(grams[a] | grams[b])}
    assert got == want and len(want) > 60


def test_hot_copies_stay_linear(spark):
    t = " ".join(f"word{i}" for i in range(120))
    found, members = neardup.links(spark.range(300).select(F.col("id").alias("page_id"), F.lit(t).alias("text")))
    assert found.count() == 0 and members.count() == 300 and neardup.pairs_of(found, members, "page_id").count() == 299


def test_components(spark):
    e = frame(spark, [(5, 4), (4, 3), (3, 2), (10, 11), (7, 7), (5, 4)], "a long, b long")
    assert {(r.node, r.component) for r in neardup.components(e).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (10, 10), (11, 10)}
    assert neardup.components(e.limit(0)).count() == 0


def test_course():
    assert neardup.course([1, 2, 3, 4], [1, 2, 9, 4]) == 0.75 and neardup.course([], []) == 1.0
    a, b = (neardup.profile(t) for t in ("abcdefghij", "abcdefgxyz"))
    assert neardup.compare(a, b)[1] == 3 / 9 and neardup.compare(a, b, 0.5)[0] == 0.0 and neardup.compare(a, a) == (1.0, 1.0)


def test_hot_keys_meet_in_blocks(spark):
    """A key of many ids, one of few and one of one: all pairs once, whatever the size of a block."""
    rows = [(i, 1) for i in range(40)] + [(i, 2) for i in (3, 50, 51)] + [(60, 3)]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40)} | {(3, 50), (3, 51), (50, 51)}
    for block in (7, 1000):
        got = [(r.a, r.b) for r in neardup.candidates(frame(spark, rows, "_id long, _key long"), block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_scrambled_text_is_compared(spark):
    """Sentences in any order: the sets decide, not the course."""
    words = [f"sentence {i} speaks of the {['gate', 'lamp', 'yard', 'chair', 'boat'][i % 5]} number {i * 37 % 101} near the {i * 53 % 97} river." for i in range(24)]
    other = [words[i] for i in np.random.default_rng(3).permutation(24)]
    df = frame(spark, [(1, " ".join(words)), (2, " ".join(other))], "page_id long, text string")
    assert [(r.a, r.b) for r in neardup.links(df)[0].collect()] == [(1, 2)]


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def test_no_pair_is_left_out(spark):
    """Long pieces in any order and scattered changes, on both sides of the threshold, against brute force."""
    rng, rows = random.Random(17), []
    for i in range(24):
        pieces = [letters(rng, 30 + i) for _ in range(20 + 2 * i)]
        for _ in range(3):
            other = [p[:9] + "-" + p[10:] if rng.random() < i % 6 / 12 else p for p in pieces]
            rows.append((len(rows), " ".join(rng.sample(other, len(other)))))
        rows.append((len(rows), " ".join(pieces[: int(len(pieces) * (0.76 + i / 200))])))
    found, members = neardup.links(frame(spark, rows, "page_id long, text string"))
    got = [(r.a, r.b) for r in neardup.pairs_of(found, members, "page_id", None).collect()]
    grams = {i: {u[k : k + 5] for k in range(len(u) - 4)} for i, t in rows if len(u := "".join(t.split())) >= 400}
    want = {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if len(grams[a] & grams[b]) >= 0.75 * len(grams[a] | grams[b])}
    assert sorted(got) == sorted(want) and 20 < len(want) < 24 * 6


def test_keys_with_several_texts(spark):
    """Every text of a key is compared; texts that share a key aren't taken for copies."""
    rng = random.Random(19)
    a, b = (" ".join(letters(rng, 12) for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a[:-9]), (5, b[9:]), (1, a)]
    found, members = neardup.links(frame(spark, rows, "page_id long, text string"))
    got = [(r.a, r.b) for r in neardup.pairs_of(found, members, "page_id").collect()]
    assert sorted(got) == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 4), (3, 5)]


def test_all_pairs_of_copies(spark):
    t = " ".join(f"word{i}" for i in range(120))
    found, members = neardup.links(spark.range(60).select(F.col("id").alias("page_id"), F.lit(t).alias("text")))
    assert neardup.pairs_of(found, members, "page_id", None).count() == 60 * 59 // 2


def test_hot_parts_of_texts_meet_in_blocks(monkeypatch):
    """The join of prefixes finds the same pairs whether keys are cut into blocks or not, and in any step."""
    rng = random.Random(23)
    base = [letters(rng, 500) for _ in range(6)]
    texts = [t[:k] + letters(rng, 20) + t[k:] for t in base for k in range(20, 480, 20)]
    level = np.full(1 << neardup.BITS, 8 * 7, np.uint8)
    every = [neardup.tokens_of(t, level) for t in texts]
    ids = np.arange(len(texts)) * 7 + 1

    def pairs():
        cut = [neardup.prefix(t, 0.75, int(i)) for t, i in zip(every, ids, strict=True)]
        sign = np.array([np.frombuffer(neardup.signs(t), np.uint64) for t in every])
        of = np.repeat(np.arange(len(texts)), [len(k) for k, _ in cut])
        got = neardup.met(ids, np.array([len(t) for t in every], np.int32), sign, of, np.concatenate([k for k, _ in cut]), np.concatenate([p for _, p in cut]), 0.75)
        return {tuple(p) for g in got for p in g.T.tolist()}, len(of)

    whole, n = pairs()
    monkeypatch.setattr(neardup, "HOT", 16)
    monkeypatch.setattr(neardup, "STEP", 100)
    cut, more = pairs()
    assert cut == whole and more > 4 * n
    want = {(int(ids[a]), int(ids[b])) for a, b in itertools.combinations(range(len(texts)), 2) if len(np.intersect1d(every[a], every[b])) >= 0.75 * len(np.union1d(every[a], every[b]))}
    assert want and want <= whole


# 8 -------------------------------------------------------------------------------------------------------------------
def test_encoding_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    ref, own = Tokenizer.from_file(path), transducer(path)
    ref.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", " ", "  a  b", "<|endoftext|>", "it's 12,5 kg", "中国人民\n 新来", "a b", "ภาษาไทย क्ष 👩‍🔧", LONG, "x" * 5000] + ["".join(rng.choice("aeinrst hT'é中国<|>\n\t03") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        ids = own.encode(t)
        assert ids == ref.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == t


def test_ids_of_odd_rows(spark):
    df = frame(spark, [(1, None, "k"), (2, "", "k"), (3, "a", "k"), (3, "a", "k")], "doc_id long, text string, ids string")
    got = tokens.encode(df, keep=["doc_id"]).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == [(1, []), (2, []), (3, [64]), (3, [64])]
    assert tokens.encode(df.limit(0), keep=["doc_id"]).count() == 0
    assert {r.doc_id: r.text for r in tokens.decode(tokens.encode(df, keep=["doc_id"])).collect()} == {1: "", 2: "", 3: "a"}


# 9 -------------------------------------------------------------------------------------------------------------------
def test_mix_keeps_budgets(spark):
    rng = random.Random(5)
    rows = [(i, "big" if i % 3 else "small", rng.randint(0, 50)) for i in range(3000)] + [(9000, None, 10), (9001, "untargeted", 10), (9002, "big", None)]
    goals = frame(spark, [("big", 0.5, 1), ("small", 0.5, 2), ("absent", 0.0, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mix.mix(frame(spark, rows, "doc_id long, source string, n_tokens int"), goals).collect()
    size = {s: sum(r[2] or 0 for r in rows if r[1] == s) for s in ("big", "small")}
    total = sum(size.values())
    for s, most in (("big", 1), ("small", 2)):
        got = sum(r.copies * r.n_tokens for r in m if r.source == s)
        want = min(0.5 * total, most * size[s])
        assert want - 51 <= got <= want + 1e-6
        assert all(1 <= r.copies <= most for r in m if r.source == s)
    assert {r.source for r in m} == {"big", "small"}
    assert mix.mix(frame(spark, [], "doc_id long, source string, n_tokens int"), goals).count() == 0


# 10 ------------------------------------------------------------------------------------------------------------------
def test_levels(spark):
    rng = random.Random(2)
    words = {k: [f"{'easy' if k < 3 else 'hard'}{c}{k}" for c in "abcdefghij"] for k in range(1, 6)}
    rows, labels = [], []
    for i in range(300):
        k = 1 + i % 5
        pool = [w for d in (-1, 0, 0, 1) for w in words.get(k + d, [])]
        rows.append((i, " ".join(f"The {rng.choice(pool)} of {rng.choice(pool)} and {rng.choice(pool)}." for _ in range(14))))
        if i < 150:
            labels.append((i, k))
    rows += [(900, None), (901, ""), (902, "short"), (903, "• a\n• b\n" * 60)]
    got = {r.doc_id: r.level for r in level.levels(frame(spark, rows, "doc_id long, text string"), frame(spark, [*labels, (902, 0), (3, None)], "doc_id long, reading_level int")).collect()}
    assert sum((got[i] >= 4) == (1 + i % 5 >= 4) for i in range(150, 300)) >= 135
    assert [got[i] for i in (900, 901, 902, 903)] == [0, 0, 0, 0]


def test_levels_without_labels(spark):
    d = frame(spark, [(1, LONG), (2, None)], "doc_id long, text string")
    assert level.levels(d, frame(spark, [], "doc_id long, reading_level int")).count() == 2


# all -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_queries_run(spark, sf_dir, name):
    df = llm.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


def test_decoded_equals_sql(spark, sf_dir):
    import duckdb

    want = duckdb.sql(llm.oracle_sql()["p8_decoded"].replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'")).fetchall()
    assert sorted(map(tuple, llm.queries()["p8_decoded"](spark, sf_dir).select("doc_id", "text").collect())) == sorted(want)
