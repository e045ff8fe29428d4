"""Text rules: Python forms, Column forms, and their agreement."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from vellumry.functions import columns as C
from vellumry.functions import text as T
from vellumry.sources import csvio, htmlio, jsonio


@pytest.mark.parametrize("value,want", [(1.0, "1"), (1e7, "10000000"), (0.1 + 0.2, "0.30000000000000004"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"),
                                        (1e-6, "0.000001"), (1e-7, "1e-7"), (-2.5, "-2.5"), (0.0, "0"), (1.5e300, "1.5e+300"), (float("inf"), "Infinity"), (100.0, "100")])
def test_js_number(value, want):
    assert T.js_number(value) == want


def test_significant_and_rounding():
    assert T.significant(0.1 + 0.2) == "0.3" and T.significant(1234567.125) == "1234567.125"
    assert [T.round_half_up(x) for x in (2.5, -2.5, 0.4)] == [3, -2, 0]
    assert T.short_number(1.005) == "1" or T.short_number(1.005) == "1.01"
    assert T.short_number(2.50) == "2.5" and T.short_number(-0.001) == "0"


NAMES = ["a/b/report.final.pdf", "C:\\x\\y.txt", ".hidden", "", None, "a<b>.csv", "  spaced .txt", "noext", "x.", "/"]
FORMATS = [".JPG", "htm", "Text", "xlsm", "pdf", None, "", "..png"]


def test_names_and_formats_agree(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", C.stem(F.col("n")).alias("s"))
    assert all(r.s == T.stem(r.n) for r in df.collect())
    df = spark.createDataFrame([(n,) for n in FORMATS], "n string").select("n", C.normalize_format(F.col("n")).alias("s"))
    assert all(r.s == T.normalize_format(r.n) for r in df.collect())
    assert T.stem("a/b/report.final.pdf") == "report.final" and T.stem(".hidden") == ".hidden" and T.stem("") == "converted"


DATA = [b"\xff\xfeh\x00i\x00", b"\xfe\xff\x00h\x00i", b"\xef\xbb\xbfhi", "é日".encode(), b"caf\xe9", b"\xef\xbb\xbfcaf\xe9", b"", "x�y".encode()]


def test_decode_agrees(spark):
    got = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(DATA)], "i int, d binary").select("i", C.decode_text(F.col("d")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: T.decode_text(d) for i, d in enumerate(DATA)}
    assert T.decode_text(b"caf\xe9") == "café" and T.decode_text(DATA[5]).startswith("ï»¿") and T.decode_text(DATA[0]) == "hi"


TEXTS = ['a&b<c>"d"\'', "tab\tx", "ctrl\x00\x1fok", "plain", "", None, "line\nend", "emoji😀", "x�￾y"]


def test_escapes_agree(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", C.escape_xml(F.col("t")).alias("x"), C.escape_html(F.col("t")).alias("h"), C.csv_escape(F.col("t")).alias("c"), C.trim(F.col("t")).alias("m"))
    for r in df.collect():
        assert r.x == T.escape_xml(r.t) and r.h == T.escape_html(r.t) and r.c == T.csv_escape(r.t)
        assert r.m is None or r.m == T.trim(r.t)
    assert T.escape_xml("a\x0bb'") == "ab'" and T.escape_html("'") == "&#39;"


def test_unicode_trim(spark):
    text = "  \t﻿x\x85\x1c "
    assert T.trim(text) == "x\x85\x1c"
    assert spark.range(1).select(C.trim(F.lit(text)).alias("t")).first().t == "x\x85\x1c"


def test_csv_grammar():
    parse = csvio.parse
    assert parse('a,"b ""q"" c",d\r\n1,2\n\n"x\ny",z\r') == [["a", 'b "q" c', "d"], ["1", "2"], [""], ["x\ny", "z"]]
    assert parse('a"b,c') == [['a"b', "c"]] and parse('"a"b,c') == [["ab", "c"]]
    assert parse('"open, to the end\n') == [["open, to the end\n"]]
    assert parse("a,b\n") == [["a", "b"]] and parse("") == [] and parse('x\n""') == [["x"]] and parse("a,") == [["a", ""]]
    assert parse("a;b\n1,5;2", None) == [["a", "b"], ["1,5", "2"]] and parse("a\tb") == [["a", "b"]]
    assert csvio.detect_delimiter("a,b;c") == "," and csvio.detect_delimiter("a;b;c,d\nx,,,,") == ";" and csvio.detect_delimiter("none") == ","


def test_csv_agrees_with_the_standard_library_on_plain_input():
    rows = [["a", 'q"q', "x\ny"], ["", "1,2", "é"]]
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    assert csvio.parse(out.getvalue()) == rows == csvio.parse(T.rows_to_csv(rows))


def test_simple_dialect_breaks_quoted_newlines():
    assert csvio.parse_simple('  a,"b,c"\n"x\ny",z\n') == [["a", "b,c"], ["x"], ["y,z"]]


def test_delimiter_agrees(spark):
    lines = ["a,b;c", "a;b;c,d", "a\tb", "", "x;y\tz\tw"]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", C.csv_delimiter(F.col("x")).alias("d")).collect()
    assert all(r.d == csvio.detect_delimiter(r.x) for r in got)


def test_headers_and_records():
    assert T.header_names([" a ", "", "a", "b", "a", None]) == ["a", "column2", "a_2", "b", "a_3", "column6"]
    rows = [["name", "2020", "10", "name"], ["x", "1"], ["y", "2", "3", "4", "extra"]]
    assert list(T.rows_to_records(rows)[0]) == ["10", "2020", "name", "name_2"]
    assert T.rows_to_records(rows)[0] == {"name": "x", "2020": "1", "10": "", "name_2": ""}
    assert T.rows_to_records([]) == []


def test_json():
    assert jsonio.to_csv('[{"a":1,"b":null},{"c":{"x":1},"a":[1,[2,3]]},{"b":true,"a":"q,\\"r"}]') == 'a,b,c\n1,,\n"1,2,3",,[object Object]\n"q,""r",true,'
    assert jsonio.to_csv('{"a":1.0}') == "a\n1"
    assert json.loads(jsonio.wrap_text("é\n")) == {"text": "é\n"}
    assert jsonio.sheets_to_json([("A", [["h"], ["1"]]), ("B", [["k"], ["2"]])]) == json.dumps({"A": [{"h": "1"}], "B": [{"k": "2"}]}, indent=2) + "\n"
    assert jsonio.sheets_to_json([("A", [])]) == "[]\n"


def test_html_text():
    page = "<html><head><title>T</title><style>s{}</style><script>1<2</script></head><body> a&#65;&eacute; <!-- c --><script>x()</script><p>un<b>closed<table><tr><td>c</table> </body></html>"
    assert htmlio.to_text(page) == "aAé x()unclosedc"
    assert htmlio.to_text("just text") == "just text" and htmlio.to_text(None) == "" and htmlio.to_text("<title>x</title>y") == "y"


def test_widths_and_wrapping():
    assert T.char_width("i") == 222 and T.char_width("é") == T.char_width("e") and T.char_width("日") == 1000 and T.char_width("λ") == 556
    lines = T.wrap_text("one two three four", 10, T.text_width("one two", 10))
    assert lines == ["one two", "three", "four"]
    assert T.wrap_text("abcdefgh", 10, T.text_width("abc", 10) + 0.01)[0] == "abc"
    assert T.wrap_text("日本語日本語", 10, 30.0) == ["日本語", "日本語"]
    assert T.wrap_text("a\n\nb", 10, 100) == ["a", "", "b"]


def test_columns_and_labels(spark):
    assert [T.column_name(i) for i in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(T.column_index(T.column_name(i)) == i for i in range(0, 20000, 7))
    got = spark.range(0, 16384, 5).select("id", C.column_name(F.col("id")).alias("n")).collect()
    assert all(r.n == T.column_name(r.id) for r in got)
    assert [T.roman(n) for n in (4, 9, 14, 1999)] == ["IV", "IX", "XIV", "MCMXCIX"] and [T.letters(n) for n in (1, 26, 27)] == ["a", "z", "aa"]
    assert T.human_size(512) == "512 B" and T.human_size(1536) == "1.50 KB" and T.human_size(20 * 1024 ** 2) == "20.0 MB"
