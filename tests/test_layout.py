import numpy as np

from foliary import ocr
from foliary.formats.common import image
from foliary.operators import grid
from foliary.operators.paginate import Options, Paragraph, char_width, paginate
from foliary.operators.tsv import flatten, table_tsv


def p(text, **k):
    return Paragraph(runs=[{"text": text, "font": "", "size": 11.0, "color": "#000000", "bounds": {"x": 0.0, "y": 0.0, "width": 0.0, "height": 0.0}}], **k)


def test_fifty_lines_fill_a_page():
    assert len(paginate([p("x")] * 50)) == 1 and len(paginate([p("x")] * 51)) == 2


def test_breaks_and_targets():
    assert [x["text"] for x in paginate([p("a", break_after=True), p("b")])] == ["a", "b"]
    assert [x["text"] for x in paginate([p("a"), p("b", break_before=True)])] == ["a", "b"]
    assert len(paginate([p("x")] * 10, Options(target_pages=5))) == 5
    assert len(paginate([p("x")] * 100, Options(target_pages=1))) == 2
    assert paginate([])[0]["text"] == ""


def test_wrapping_and_widths():
    pages = paginate([p("word " * 40)])
    assert "\n" in pages[0]["text"]
    assert (char_width("\t", 10), char_width(" ", 10), char_width("a", 10), char_width("中", 10), char_width("é", 10)) == (20, 5, 5.5, 10, 8)


def test_tables_of_paragraphs():
    page = paginate([p("a", table=1, row=0, column=0, separator="\t"), p("b", table=1, row=0, column=1, separator="\n")])[0]
    assert page["text"] == "a\tb" and [c["text"] for c in page["tables"][0]["rows"][0]["cells"]] == ["a", "b"]


def test_tsv():
    assert flatten(" a\tb \n中\n文 c") == "a b中文 c"
    assert table_tsv([[(0, 2, "a"), (2, 1, "b")], [(0, 1, "c"), (0, 1, "d"), (1, 1, "e"), (0, 1, "lost")]]) == "a\t\tb\t\nc\td\te\tlost"
    assert table_tsv([]) == "" and table_tsv([[(0, 1, "x\ty")]]) == "x y"


def test_grid_cap_is_all_or_nothing():
    assert grid.detect([], [(0, i * 10.0, 50, i * 10.0) for i in range(600)], grid.Style()) == ([], [])


def test_lines():
    r = lambda t, x, y: {"text": t, "size": 10.0, "bounds": {"x": x, "y": y, "width": 10.0, "height": 10.0}}
    assert grid.lines_by_gap([r("a", 0, 0), r("b", 10, 0), r("c", 30, 0), r("d", 0, -20)]) == "ab c\nd"
    assert grid.lines_by_anchor([r("c", 0, 20), r("b", 30, 1), r("a", 0, 0)]) == "ab\nc"


def test_recognition_steps():
    steps = np.zeros((5, 4))
    for i, k in enumerate((1, 1, 0, 2, 3)):
        steps[i, k] = 1
    assert ocr.decode(steps, ["a", "b"]) == ("ab ", 1.0)
    assert list(ocr.turned(np.array([[0.0, 5.0], [3.0, 0.0]]), 0.9)) == [True, False]
    m = np.zeros((32, 32))
    m[10:15, 5:25] = 0.9
    found = ocr.boxes(m, ocr.Config(), 32, 32)
    assert len(found) == 1 and found[0].y0 <= 10 and found[0].x1 >= 25
    assert ocr.text_color(np.zeros((4, 4, 3))) == "#000000"
    assert ocr.resize(np.ones((4, 4, 3)), 8, 8).shape == (8, 8, 3)
    assert ocr.candidates([image("a.png", b"x")]) == []


def test_recognizer_adds_text():
    class Detector:
        def run(self, t):
            out = np.zeros(t.shape[2:])
            out[8:20, 10:50] = 0.9
            return out

    class Recognizer:
        def run(self, t):
            s = np.zeros((len(t), 2, 3))
            s[:, 0, 1] = s[:, 1, 0] = 1
            return s

    doc = {"pages": [{"text": "", "runs": [], "width": 100.0, "height": 50.0, "images": [{"width": 64, "height": 32, "data": b"x"}]}]}
    ocr.recognizer(ocr.Engine(Detector(), Recognizer(), ["a"]), lambda b: np.zeros((32, 64, 3)))(doc)
    assert doc["pages"][0]["text"] == "a" and doc["pages"][0]["runs"][0]["font"] == "OCR"


def test_recognition_of_a_picture(tmp_path):
    import pytest

    class Detector:
        def run(self, x):
            m = np.zeros(x.shape[2:], np.float32)
            m[8:20, 8:50] = 1
            return m

    class Recognizer:
        def run(self, x):
            steps = np.zeros((len(x), 3, 4), np.float32)
            steps[:, 0, 1] = steps[:, 1, 3] = steps[:, 2, 2] = 1
            return steps

    engine = ocr.Engine(Detector(), Recognizer(), ["关", "于"])
    pixels = lambda data: np.zeros((32, 64, 3))
    r = ocr.recognize_image(b"", engine, pixels)
    assert r.text == "关 于" and r.lines[0].confidence == 1.0
    (tmp_path / "x.png").write_bytes(b"x")
    assert ocr.image_bytes_to_text(b"", engine, pixels) == ocr.image_to_text(str(tmp_path / "x.png"), engine, pixels) == "关于"
    assert ocr.Config(threshold=-1, batch=0, workers=0).filled() == ocr.Config()
    with pytest.raises(FileNotFoundError, match="detector"):
        ocr.engine(ocr.Config())
