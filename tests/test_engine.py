"""Plans over Spark: conversions with errors as data, streams, sinks, and every oracle."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vellumry.operators import model, relational, render, textual
from vellumry.plans import catalogue, convert, matrix
from vellumry.sources import files
from vellumry.streaming.convert import convert_stream

FILES = [("1", "a.txt", None, b"one\n\ntwo <x>\x0cpage"), ("2", "t.csv", None, b"h,k\n1,2\n"), ("3", "bad.pdf", None, b"%PDF-1.4 nothing"), ("4", "old.doc", None, b"\xd0\xcf\x11\xe0abc"),
         ("5", "e.txt", None, b""), ("6", "n.zzz", None, b"x"), ("7", "m.csv", "txt", b"plain, text")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, n, d, bytearray(c)) for i, n, d, c in FILES], "doc_id string, name string, declared string, content binary")


def test_convert_keeps_errors_as_rows(rows):
    got = {r.doc_id: r for r in convert.convert(rows, "pdf").collect()}
    assert got["1"].data[:5] == b"%PDF-" and got["1"].name == "a.pdf" and got["1"].type == "application/pdf" and got["2"].data[:5] == b"%PDF-" and got["7"].data
    assert "PDF to PDF" in got["3"].error and "binary" in got["4"].error and "empty" in got["5"].error and "not supported" in got["6"].error
    assert all((r.error is None) == (r.data is not None) for r in got.values()) and len(got) == len(FILES)
    assert "damaged" in {r.doc_id: r for r in convert.convert(rows, "txt").collect()}["3"].error


def test_column_renderings_equal_their_python_twins(spark, rows):
    documents = convert.read(convert.detect(rows.where("doc_id in ('1', '2')")))
    named = model.page([model.heading("H", 2), model.paragraph("b\tx\ny", bold=True), model.paragraph("  "), model.table([["a\n b", "c"], ["<", None]]), model.paragraph("l", lines=["l1", "l2"])], 10, 10, "P&1")
    own = spark.createDataFrame([("9", "T<", "pptx", [named, model.page([], 1, 1)], None)], model.DOCUMENT)
    for r in documents.unionByName(own).select("title", "pages", render.to_text(F.col("pages")).alias("t"), render.to_html(F.col("title"), F.col("pages")).alias("h"), render.sheets(F.col("pages"), F.col("source")).alias("s"), "source").collect():
        pages = [p.asDict(True) for p in r.pages]
        assert r.t == textual.to_text(pages) and r.h == textual.to_html(r.title, pages)
        assert [(s.name, s.rows) for s in r.s] == convert.to_sheets(pages, r.source)


LIGHT = [("a.csv", "json", b'h,2,"x"\n1,"a,b"\n', '[\n  {\n    "2": "a,b",\n    "h": "1",\n    "x": ""\n  }\n]'), ("a.json", "csv", b'[{"a":1},{"b":"x,y"}]', 'a,b\n1,\n,"x,y"'), ("a.json", "txt", b'{"a":[1,{}]}', '{\n  "a": [\n    1,\n    {}\n  ]\n}'),
         ("a.txt", "json", b'q"\n', '{\n  "text": "q\\"\\n"\n}'), ("a.html", "txt", b"<p>x &amp; <b>y</b>", "x & y")]


@pytest.mark.parametrize("name,target,data,want", LIGHT)
def test_light_conversions(spark, name, target, data, want):
    df = spark.createDataFrame([("1", name, None, bytearray(data)), ("2", name, None, bytearray(b"{"))], "doc_id string, name string, declared string, content binary")
    got = {r.doc_id: r for r in convert.convert(df, target).collect()}
    assert bytes(got["1"].data).decode() == want and got["1"].name == f"a.{target}"
    assert (got["2"].error is not None) == name.endswith("json")
    assert convert.convert_bytes(data, name, None, target)[0]["data"].decode() == want


def test_txt_to_html_twins(spark):
    text = "a < b & 'c'\n"
    assert textual.text_to_html(text) == spark.range(1).select(render.text_to_html(F.lit(text)).alias("h")).first().h
    assert convert.convert_bytes(text.encode(), "a.txt", None, "html")[0]["data"].decode() == textual.text_to_html(text)


def test_multi_sheet_csv(spark):
    from vellumry.sources import xlsx

    book = xlsx.write([("A", [["x", "1"]]), ("B", [["y"]])], "t", convert.STAMP)
    df = spark.createDataFrame([("1", "w.xlsx", None, bytearray(book))], "doc_id string, name string, declared string, content binary")
    got = {r.name: bytes(r.data) for r in convert.convert(df, "csv").collect()}
    assert got == {"w-A.csv": b"\xef\xbb\xbfx,1\r\n", "w-B.csv": b"\xef\xbb\xbfy\r\n"}


def test_conversion_reads_the_bytes_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    for target in ("docx", "txt", "html", "csv", "json"):
        plan = convert.convert(files.scan(spark, str(tmp_path)), target)._jdf.queryExecution().optimizedPlan().toString()
        scans = [line for line in plan.splitlines() if re.search("Relation.*binaryFile|Relation \\[", line)]
        assert plan.count("MapInArrow") == 1 and len(scans) <= 2, plan  # the second scan lists files over the cap, without content


def test_refusals_are_the_same_in_columns_and_in_python(spark):
    cases = [(s, t, n, d) for s in ("ole", "pdf", "txt", "png", "xyz", "") for t in ("pdf", "json", "docx", "png") for n in (0, 5) for d in ("doc", "txt")]
    df = spark.createDataFrame(cases, "s string, t string, n int, d string")
    got = df.select("*", matrix.refusal(F.col("s"), F.col("t"), F.col("n"), F.col("d")).alias("why")).collect()
    assert [r.why for r in got] == [matrix.why_refused(r.s, r.t, r.n, r.d) for r in got]


def test_scan_stream_and_sink(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for i in range(3):
        (src / f"f{i}.txt").write_text(f"text {i}")
    (src / "big.bin").write_bytes(b"x" * 100)
    capped = {r.name: (r.content is None, r.error) for r in files.scan(spark, str(src), most_bytes=50).collect()}
    assert files.scan(spark, str(src), "*.txt").count() == 3 and len(capped) == 4 and capped["f0.txt"] == (False, None)
    assert capped["big.bin"] == (True, "The file has 100 bytes; at most 50 are read.")
    assert convert.convert(files.scan(spark, str(src), most_bytes=50), "pdf").where("name is null").first().error.startswith("The file has 100 bytes")
    done = convert.convert(files.scan(spark, str(src), "*.txt").drop("length"), "docx")
    files.write_outputs(done, str(out))
    assert sorted(os.listdir(out)) == ["f0.docx", "f1.docx", "f2.docx"]
    for _ in range(2):  # nothing new the second time
        convert_stream(spark, str(src), "pdf", str(tmp_path / "stream"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "stream"))
    assert got.where("data is not null").count() == 3 and got.where("error is not null").count() == 1


def test_sql_functions(spark):
    files.register_functions(spark)
    r = spark.sql("""select parse_csv('a;"b;c"') c, html_text('<p>x<b>y') h, json_csv('[{"k":1}]') j, number_text(1e7D) n""").first()
    assert r.c == [["a", "b;c"]] and r.h == "xy" and r.j == "k\n1" and r.n == "10000000"


def test_matrix(spark):
    m = matrix.matrix(spark)
    assert {r.target for r in matrix.targets(m, "gif").collect()} == {"png", "jpeg", "webp"}
    assert {r.target for r in matrix.targets(m, "csv").collect()} == {"xlsx", "pdf", "docx", "html", "json"}
    assert matrix.search(m, "PDF TO docx").count() == 1


def test_header_numbers(spark):
    df = spark.createDataFrame([(1, 1, " a "), (1, 2, None), (1, 3, "a"), (2, 1, "a")], "t int, c int, n string")
    assert [r.header for r in relational.duplicate_numbers(df, "t", "c", "n").orderBy("t", "c").collect()] == ["a", "column2", "a_2", "a"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


SLOW = {"pdf_roundtrip"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_catalogue_against_duckdb(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    found = con.execute(catalogue.ORACLE_SQL[name])
    columns = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted(str([r[i] for i in at]) for r in found.fetchall())
    got = catalogue.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    assert sorted(str(list(r)) for r in got.select(*columns).collect()) == want


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_pages_and_texts_of_every_kind_are_taken(spark, tmp_path):
    pages = [(1, None, ""), (2, "<body><p>a&amp</p>b &am</body>", "a&b &am"), (3, "<title>x&am</title><body>&quot<i>c</i>&quo-&qu &q&a&copy;</body>", '"c&quo-&qu &q&a©'), (4, "<body>é &amp; e</body>", "é & e"), (5, "", "")]
    texts = [(1, None), (2, "naïve Ærø straße, x"), (3, "日本 text عربى a\n\nb"), (4, ""), (5, "plain 😀 words")]
    spark.createDataFrame([p[:2] for p in pages], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in catalogue.QUERIES["html_to_text"](spark, str(tmp_path)).select("page_id", "text").collect()} == {(i, t) for i, _, t in pages}
    want = {(str(i), sum(c.isascii() and c.isalpha() for c in t) if t else None) for i, t in texts}
    assert {tuple(r) for r in catalogue.QUERIES["pdf_roundtrip"](spark, str(tmp_path)).select("doc_id", "letters").collect()} == want
