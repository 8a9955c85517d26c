import os

from pyspark.sql import functions as F

from foliary import fixtures as X
from foliary import sinks
from foliary.functions import sql
from foliary.sources import documents as D
from foliary.streaming import documents as S


def folder(tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    for name, body in {"a.rtf": X.rtf(["关 于 x"]), "a.pdf": X.pdf(["t"], [["p", "q"], ["r", "s"]]), "b.docx": b"junk", "c.txt": b"text", ".hidden.rtf": X.rtf(["no"]), "sub/d.rtf": X.rtf(["no"])}.items():
        (d / name).write_bytes(body)
    return str(d)


def test_folder_to_documents_and_files(spark, tmp_path):
    docs = D.read_documents(spark, folder(tmp_path)).cache()
    got = {os.path.basename(r.path): (r.status, r.pages[0].text if r.pages else None) for r in docs.collect()}
    assert got == {"a.rtf": ("ok", "关于 x"), "a.pdf": ("ok", "t\np\tq\nr\ts"), "b.docx": ("failed", None), "c.txt": ("skipped", None)}
    assert {r.status: r.documents for r in D.summary(docs).collect()} == {"ok": 2, "failed": 1, "skipped": 1}
    written = sinks.write_files(docs, str(tmp_path / "out")).collect()
    assert sorted(r.file for r in written) == ["page_1.txt", "page_1.txt", "page_1_table_1.tsv"]
    assert len({sinks.folder_name(r.path) for r in written}) == 2
    assert D.cells(docs).count() == 4 and D.runs(docs).where("text <> ''").count() == 6


def test_modes(spark, tmp_path):
    path = folder(tmp_path)
    assert D.read_documents(spark, path, mode="DROPMALFORMED").count() == 2
    try:
        D.read_documents(spark, path, mode="FAILFAST").collect()
        raise SystemExit("no error")
    except Exception as e:  # noqa: BLE001
        assert "b.docx" in str(e) or "c.txt" in str(e)


def test_stream(spark, tmp_path):
    q = S.status_counts(S.stream_documents(spark, folder(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.status: r.documents for r in spark.table("counts").collect()} == {"ok": 2, "failed": 1, "skipped": 1}


def test_functions_in_sql(spark):
    sql.register(spark)
    r = spark.sql("SELECT flatten_cell('a\\nb') f, normalize_page('关 于') n, html_text('<p>a</p>b') h, normalize_cell(null) z").first()
    assert (r.f, r.n, r.h, r.z) == ("a b", "关于", "a\nb", None)
    spark.createDataFrame([("x.rtf", bytearray(X.rtf(["q"])))], "path string, content binary").createOrReplaceTempView("f")
    assert spark.sql("SELECT d.status, d.page_no, d.text FROM f, LATERAL extract_pages(f.path, f.content) d").first() == ("ok", 1, "q")


def test_empty_input(spark):
    e = spark.createDataFrame([], "path string, content binary")
    assert D.extract(e).count() == 0
    assert D.extract(spark.createDataFrame([(None, None)], "path string, content binary")).select(F.col("status")).first()[0] == "skipped"


def test_empty_files_have_rows(spark, tmp_path):
    (tmp_path / "a.rtf").write_bytes(X.rtf(["one"]))
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / ".hidden.pdf").write_bytes(b"")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.pdf").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.status, len(r.pages)) for r in D.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.rtf": ("ok", 1), "b.pdf": ("failed", 0)}
    assert [r.status for r in D.read_documents(spark, str(tmp_path / "b.pdf")).collect()] == ["failed"]


def test_files_at_an_address(spark, tmp_path):
    docs = D.extract(spark.createDataFrame([("x/a.rtf", X.rtf(["one"]))], "path string, content binary"))
    assert [tuple(r) for r in sinks.write_files(docs, f"file://{tmp_path}").collect()] == [("x/a.rtf", "page_1.txt", 3)]
    assert sorted(x.name for x in (tmp_path / sinks.folder_name("x/a.rtf")).iterdir()) == ["page_1.txt"]


def test_styles_across_blocks(spark):
    from foliary.operators.relational import style_at

    chars = spark.createDataFrame([("a", k) for k in (0, 5, 9, 10, 35, 70, 99)] + [("b", 50)], "path string, fc long")
    styles = spark.createDataFrame([("a", 5, 10, "x"), ("a", 30, 80, "y"), ("c", 0, 99, "z")], "path string, start long, stop long, style string")
    want = {("a", 0): None, ("a", 5): "x", ("a", 9): "x", ("a", 10): None, ("a", 35): "y", ("a", 70): "y", ("a", 99): None, ("b", 50): None}
    for block in (4, 1000):
        assert {(r.path, r.fc): r.style for r in style_at(chars, styles, block).collect()} == want
