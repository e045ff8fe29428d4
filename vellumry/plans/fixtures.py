"""Queries of the readers over hand-built files, with the rows that the formats' rules give.

The files are not made by this engine's writers, so a reader and a writer that err alike are told.
Each query returns (file, n, block): the blocks of a file in order, or its error.  A block is written
h<level>:text, p:text, or t: with rows by / and cells by |.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model
from . import convert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _shown() -> Column:
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "|")), "/")
    return F.when(F.col("type") == "table", F.concat(F.lit("t:"), rows)).when(F.col("type") == "heading", F.concat(F.lit("h"), F.col("level").cast("string"), F.lit(":"), "text")).otherwise(F.concat(F.lit("p:"), "text"))


def fixture(name: str, kind: str, files: dict[str, tuple[bytes, list[str]]]) -> None:
    """Register a query over files: their bytes and expected blocks (or one error after `!`)."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(k, f"{k}.{kind}", None, bytearray(data)) for k, (data, _) in files.items()], "doc_id string, name string, declared string, content binary")
        read = convert.read(convert.detect(rows.repartition(4)))
        blocks = model.blocks(read).select(F.col("doc_id").alias("file"), "page_no", "block_no", _shown().alias("block"))
        before = F.struct("page_no", "block_no")
        listed = blocks.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(before.alias("at"), "block"))).alias("b"))
        made = listed.select("file", F.posexplode("b.block").alias("n", "block"))
        failed = read.where("error is not null").select(F.col("doc_id").alias("file"), F.lit(0).alias("n"), F.concat(F.lit("!"), "error").alias("block"))
        return made.unionByName(failed)

    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {n}, {quoted(b)})" for k, (_, blocks) in files.items() for n, b in enumerate(blocks))
    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT file, n::INTEGER AS n, block FROM (VALUES {values}) v(file, n, block)"


# ------------------------------------------------------------------ packages

def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(*targets: tuple[str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="r{n}" Type="http://x/{kind}" Target="{target}"/>' for n, (kind, target) in enumerate(targets, 1)) + "</Relationships>"


def book(*sheets: str, strings: str = "", styles: str = "", setting: str = "", states: dict[int, str] | None = None) -> bytes:
    entries = "".join(f'<sheet name="S{n}" sheetId="{n}" r:id="r{n}" {(states or {}).get(n, "")}/>' for n in range(1, len(sheets) + 1))
    parts = {"xl/workbook.xml": f"<workbook>{setting}<sheets>{entries}</sheets></workbook>",
             "xl/_rels/workbook.xml.rels": rels(*(("worksheet", f"worksheets/s{n}.xml") for n in range(1, len(sheets) + 1)), ("sharedStrings", "sharedStrings.xml"), ("styles", "styles.xml")),
             "xl/sharedStrings.xml": f"<sst>{strings}</sst>", "xl/styles.xml": f"<styleSheet>{styles}</styleSheet>"}
    return package(parts | {f"xl/worksheets/s{n}.xml": f"<worksheet><sheetData>{s}</sheetData></worksheet>" for n, s in enumerate(sheets, 1)})


def numbers_at(*rows: int) -> str:
    return "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c></row>' for r in rows)


_STYLES = ('<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0%"/><numFmt numFmtId="166" formatCode="&quot;day&quot; 0"/><numFmt numFmtId="167" formatCode="hh:mm"/></numFmts>'
           '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="167"/><xf numFmtId="14"/><xf numFmtId="9"/></cellXfs>')
_CELLS = ('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>in</t><r><t>line</t></r></is></c><c t="b"><v>1</v></c><c t="b"><v>0</v></c><c t="e"><v>#N/A</v></c></row>'
          '<row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2" s="2"><v>0.125</v></c><c r="C2" s="3"><v>7</v></c><c r="D2" s="4"><v>0.75</v></c><c r="E2" s="5"><v>45292.75</v></c><c r="F2" s="6"><v>0.5</v></c></row>'
          '<row r="3"><c r="A3"><v>0.1</v></c><c r="B3"><v>1E7</v></c><c r="C3"><v>123456789.123456789</v></c><c r="D3" t="str"><v>a_x0041_b</v></c><c r="F3"><v>-0</v></c></row><row r="4"><c r="A4" t="s"><v>99</v></c></row>')

fixture("fixture_xlsx", "xlsx", {
    "cells": (book(_CELLS, strings="<si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>", styles=_STYLES),
              ["t:plain|rich|inline|TRUE|FALSE|#N/A/2024-01-01|12.5%|7|18:00:00|2024-01-01 18:00:00|50%/0.1|10000000|123456789.123457|aAb||0"]),
    "gaps": (book(numbers_at(2, 4)), ["t:/2//4"]),
    "long_gap": (book(numbers_at(1, 60, 61)), ["t:1" + "/" * 51 + "60/61"]),
    "hidden": (book(numbers_at(1), "", '<row r="1"><c r="C1"><v>3</v></c></row>', states={1: 'state="hidden"'}), ["t:||3"]),
    "epoch": (book('<row r="1"><c r="A1" s="1"><v>0</v></c></row>', styles=_STYLES, setting='<workbookPr date1904="1"/>'), ["t:1904-01-01"]),
    "far_column": (book('<row r="1"><c r="XFE1"><v>1</v></c><c r="B1"><v>2</v></c><c><v>3</v></c></row>'), ["t:|2|3"]),
    "no_sheet": (book("", states={1: 'state="veryHidden"'}), ["!This workbook has no visible worksheets with cell data."]),
})


def word(body: str, styles: str = "", numbers: str = "") -> bytes:
    return package({"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels(("styles", "styles.xml"), ("numbering", "numbering.xml")),
                    "word/styles.xml": f"<w:styles>{styles}</w:styles>", "word/numbering.xml": f"<w:numbering>{numbers}</w:numbering>"})


def para(text: str, props: str = "") -> str:
    return f'<w:p><w:pPr>{props}</w:pPr><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def item(text: str, level: int, number: int = 1) -> str:
    return para(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>')


def cell(inner: str, props: str = "") -> str:
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{inner}</w:tc>"


_LEVELS = "".join(f'<w:lvl w:ilvl="{n}"><w:start w:val="{start}"/><w:numFmt w:val="{kind}"/></w:lvl>' for n, (kind, start) in enumerate((("decimal", 3), ("lowerRoman", 1), ("upperLetter", 26), ("bullet", 1), ("ordinal", 1))))
_NUMBERS = f'<w:abstractNum w:abstractNumId="7">{_LEVELS}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num>'
_HEADS = '<w:style w:styleId="H"><w:name w:val="Heading 1"/></w:style><w:style w:styleId="T"><w:name w:val="Subtitle"/></w:style><w:style w:styleId="O"><w:name w:val="own"/><w:pPr><w:outlineLvl w:val="5"/></w:pPr></w:style>'

fixture("fixture_docx", "docx", {
    "headings": (word(para(" Head ", '<w:pStyle w:val="H"/><w:outlineLvl w:val="2"/>') + para("Sub", '<w:pStyle w:val="T"/>') + para("deep", '<w:pStyle w:val="O"/>') + para("own", '<w:outlineLvl w:val="1"/>') + para("body", '<w:outlineLvl w:val="9"/>') + para(" "), _HEADS),
                 ["h1:Head", "h2:Sub", "h3:deep", "h2:own", "p:body"]),
    "lists": (word("".join(item(t, n) for t, n in (("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 2), ("f", 0), ("g", 1), ("h", 3), ("i", 4))) + item("none", 0, 0) + item("unknown", 1, 9) + item("Head", 0).replace("<w:numPr>", '<w:pStyle w:val="H"/><w:numPr>'), _HEADS, _NUMBERS),
              ["p:3. a", "p:  i. b", "p:  ii. c", "p:    Z. d", "p:    AA. e", "p:4. f", "p:  i. g", "p:      • h", "p:        1. i", "p:none", "p:  • unknown", "h1:Head"]),
    "inline": (word('<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:noBreakHyphen/><w:sym w:font="S" w:char="F041"/><w:cr/></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>new </w:t></w:r></w:ins>'
                    '<mc:AlternateContent><mc:Choice><w:r><w:t>yes</w:t></w:r></mc:Choice><mc:Fallback><w:r><w:t>no</w:t></w:r></mc:Fallback></mc:AlternateContent><w:r><w:instrText>PAGE</w:instrText><w:t>&#x41;&amp;&lt;  </w:t></w:r></w:p>'),
               ["p:a\tb\n-A\nnew yesA&<"]),
    "breaks": (word('<w:p><w:r><w:t>x</w:t><w:br w:type="page"/><w:t>y</w:t></w:r></w:p>' + para("next") + para("own page", "<w:pageBreakBefore/>") + para("same", '<w:pageBreakBefore w:val="0"/>')), ["p:xy", "p:next", "p:own page", "p:same"]),
    "tables": (word(f'<w:tbl><w:tr>{cell(para(" wide "), "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}{cell(para("c"))}</w:tr><w:sdt><w:sdtContent><w:tr>{cell(para("d") + para("e"))}<w:sdt><w:sdtContent>{cell("<w:tbl><w:tr>" + cell(para("i")) + cell(para("j")) + "</w:tr></w:tbl>")}</w:sdtContent></w:sdt></w:tr></w:sdtContent></w:sdt></w:tbl>'),
               ["t:wide||c/d\ne|i | j|"]),
    "boxes": (word("<w:p><w:r><w:t>with</w:t><w:pict><w:txbxContent>" + para("boxed") + "</w:txbxContent></w:pict></w:r></w:p><w:sdt><w:sdtContent>" + para("control") + "</w:sdtContent></w:sdt><w:customXml>" + para("custom") + "</w:customXml>"), ["p:with", "p:boxed", "p:control", "p:custom"]),
    "no_body": (package({"word/document.xml": "<x/>"}), ["!This Word document has no readable body."]),
})


def show(*trees: str) -> bytes:
    ids = "".join(f'<p:sldId r:id="r{n}"/>' for n in reversed(range(1, len(trees) + 1)))
    return package({"ppt/presentation.xml": f'<p:presentation><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(*(("slide", f"slides/s{n}.xml") for n in range(1, len(trees) + 1)))}
                   | {f"ppt/slides/s{n}.xml": f"<p:sld><p:cSld><p:spTree>{t}</p:spTree></p:cSld></p:sld>" for n, t in enumerate(trees, 1)})


def shape(text: str, x: int = 0, y: int = 0, kind: str = "", level: int = 0) -> str:
    place = f'<p:nvPr><p:ph type="{kind}"/></p:nvPr>' if kind else ""
    return f'<p:sp><p:nvSpPr>{place}</p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:pPr lvl="{level}"/><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


_FRAME = '<p:graphicFrame><p:xfrm><a:off x="0" y="900"/></p:xfrm><a:tbl><a:tr><a:tc><a:p><a:r><a:t>a</a:t></a:r><a:br/><a:fld><a:t>b</a:t></a:fld></a:p></a:tc><a:tc><a:p/></a:tc></a:tr><a:tr><a:tc><a:p><a:r><a:t>c</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:graphicFrame>'

fixture("fixture_pptx", "pptx", {
    "order": (show(_FRAME + shape("low", 0, 500) + shape("right", 9, 100) + shape("left", 1, 100, level=2) + shape("foot", kind="ftr") + shape("7", kind="sldNum") + f'<p:grpSp>{shape("in group", 0, 300)}</p:grpSp>' + shape("Title", 0, 999, "ctrTitle")),
              ["h1:Title", "p:    left", "p:right", "p:in group", "p:low", "t:a\nb|/c"]),
    "slides": (show(shape("second in file order"), shape("first in list order") + "<mc:AlternateContent><mc:Choice>" + shape("chosen", 5, 5) + "</mc:Choice></mc:AlternateContent>"), ["p:first in list order", "p:chosen", "p:second in file order"]),
    "no_slides": (show(), ["!This presentation has no slides."]),
})


# ------------------------------------------------------------------ PDF

_FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def stream(data: bytes, more: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), more, data)


def pdf(content: bytes, font: bytes = _FONT, page: bytes = b"", extra: dict[int, bytes] | None = None, table: bool = True, resources: bytes = b"") -> bytes:
    """A document of one page; objects from 6 on are free.  Without a table readers must scan."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
               3: b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> %s >> /Contents 4 0 R %s >>" % (resources, page), 4: content, 5: font, **(extra or {})}
    data, at = bytearray(b"%PDF-1.4\n"), {}
    for n, body in objects.items():
        at[n] = len(data)
        data += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    if not table:
        return bytes(data) + b"trailer << /Root 1 0 R >>\n%%EOF"
    start, size = len(data), max(objects) + 1
    data += b"xref\n0 %d\n" % size + b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(size))
    return bytes(data) + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (size, start)


def lines(*rows: tuple[float, float, float, str]) -> bytes:
    """A content stream of texts (x, y from the bottom, size, text)."""
    return b"\n".join(b"BT /F1 %g Tf %g %g Td (%s) Tj ET" % (size, x, y, text.encode("latin-1")) for x, y, size, text in rows)


def sub_rows(data: bytes, width: int) -> bytes:
    """Rows by the PNG predictor Sub, padded with spaces."""
    data += b" " * (-len(data) % width)
    rows = [data[s:s + width] for s in range(0, len(data), width)]
    return b"".join(b"\x01" + bytes((x - y) % 256 for x, y in zip(r, b"\0" + r)) for r in rows)


_HELLO = b"BT /F1 12 Tf 72 700 Td (Hello \\(you\\)\\041 \\\nx) Tj ET"
_CMAP = b"/CIDInit begincmap 1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <00660069> endbfchar 2 beginbfrange <41> <43> <0061> <44> <45> [<0058> <0059>] endbfrange endcmap"
_PROSE = "the quick brown fox jumps over the lazy dog and runs along the long way"

fixture("fixture_pdf", "pdf", {
    "strings": (pdf(stream(_HELLO)), ["p:Hello (you)! x"]),
    "no_table": (pdf(stream(_HELLO), table=False), ["p:Hello (you)! x"]),
    "leading_junk": (b"junk\n" + pdf(stream(_HELLO)), ["p:Hello (you)! x"]),
    "flate": (pdf(stream(zlib.compress(_HELLO), b"/Filter /FlateDecode")), ["p:Hello (you)! x"]),
    "raw_flate": (pdf(stream(zlib.compress(_HELLO)[:-4], b"/Filter /FlateDecode")), ["p:Hello (you)! x"]),
    "predictor": (pdf(stream(zlib.compress(sub_rows(_HELLO, 8)), b"/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 8 >>")), ["p:Hello (you)! x"]),
    "hex": (pdf(stream(_HELLO.hex().encode() + b">", b"/Filter /ASCIIHexDecode")), ["p:Hello (you)! x"]),
    "run_length": (pdf(stream(bytes([len(_HELLO) - 1]) + _HELLO + b"\x80", b"/Filter [/RunLengthDecode]")), ["p:Hello (you)! x"]),
    "array": (pdf(stream(b"BT /F1 10 Tf 50 700 Td [(Hel) -20 (lo) -400 (wor) 30 (ld)] TJ T* 0 -14 Td <416263> Tj ET")), ["p:Hello world Abc"]),
    "to_unicode": (pdf(stream(b"BT /F1 12 Tf 72 700 Td (\\001ABCDE) Tj ET"), b"<< /Type /Font /Subtype /TrueType /BaseFont /AAAAAA+Some /ToUnicode 6 0 R >>", extra={6: stream(_CMAP)}), ["p:fiabcXY"]),
    "differences": (pdf(stream(b"BT /F1 12 Tf 72 700 Td (abc) Tj ET"), b"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /Differences [97 /eacute /uni0416 /f_i] >> >>"), ["p:éЖfi"]),
    "form": (pdf(stream(b"/X Do"), resources=b"/XObject << /X 6 0 R >>", extra={6: stream(b"BT /F1 12 Tf 10 10 Td (in form) Tj ET", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 50 600] /Resources << /Font << /F1 5 0 R >> >>")}), ["p:in form"]),
    "rotated_page": (pdf(stream(b"BT /F1 12 Tf 0 1 -1 0 300 100 Tm (upright when turned) Tj ET"), page=b"/Rotate 90"), ["p:upright when turned"]),
    "spaces": (pdf(stream(b"BT /F1 12 Tf 72 700 Td (a  b) Tj ET")), ["p:a b"]),
    "length_wrong": (pdf(stream(_HELLO).replace(b"/Length %d" % len(_HELLO), b"/Length 5")), ["p:Hello (you)! x"]),
    "no_text": (pdf(stream(b"0 0 10 10 re f")), ["!This PDF has no text layer; scanned pages need character recognition first."]),
})

fixture("fixture_layout", "pdf", {
    "heading": (pdf(stream(lines((72, 720, 24, "Big"), (72, 690, 17, "Mid"), (72, 665, 14, "Low"), (72, 640, 12, _PROSE)))), ["h1:Big", "h2:Mid", "h3:Low", f"p:{_PROSE}"]),
    "paragraph": (pdf(stream(lines((72, 700, 12, _PROSE), (72, 686, 12, _PROSE[:-3] + "so-"), (72, 672, 12, "called and " + _PROSE[:39]), (72, 640, 12, "after a gap")))), [f"p:{_PROSE} {_PROSE[:-3]}so-called and {_PROSE[:39]}", "p:after a gap"]),
    "hyphen_before_capital": (pdf(stream(lines((72, 700, 12, _PROSE + " page-"), (72, 686, 12, "Up")))), [f"p:{_PROSE} page- Up"]),
    "bullets": (pdf(stream(lines((72, 700, 12, _PROSE), (72, 686, 12, "- item one"), (72, 672, 12, "2. item two"), (72, 658, 12, "(a) item three")))), [f"p:{_PROSE}", "p:- item one", "p:2. item two", "p:(a) item three"]),
    "table": (pdf(stream(lines(*((x, 700 - 14 * r, 10, t) for r, row in enumerate((("Name", "Qty", "Note"), ("Apple", "3", "red"), ("Pear", "12", "green"))) for x, t in zip((72, 180, 260), row))))), ["t:Name|Qty|Note/Apple|3|red/Pear|12|green"]),
    "bridged_table": (pdf(stream(lines((72, 700, 10, "a"), (200, 700, 10, "b"), (72, 686, 10, "lone"), (72, 672, 10, "c"), (200, 672, 10, "d")))), ["t:a|b/lone|/c|d"]),
    "lone_cells": (pdf(stream(lines((72, 700, 10, "left"), (300, 700, 10, "right")))), ["p:left\tright"]),
    "columns": (pdf(stream(lines(*((x, 700 - 13 * r, 9, f"{side} column words of line {r} go on to here") for r in range(9) for x, side in ((50, "left"), (320, "right")))))),
                ["p:" + " ".join(f"left column words of line {r} go on to here" for r in range(9)), "p:" + " ".join(f"right column words of line {r} go on to here" for r in range(9))]),
    "overprint": (pdf(stream(lines((72, 700, 12, "twice"), (72.3, 700, 12, "twice"), (72, 660, 12, "once")))), ["p:twice", "p:once"]),
})


# ------------------------------------------------------------------ plain formats and errors

fixture("fixture_csv", "csv", {
    "quotes": (b'a,"b,c","d""e"\r\n"two\nlines",x"y,"z"w\n', ['t:a|b,c|d"e/two\nlines|x"y|zw']),
    "blank_row": (b"a,b\n\nc\n", ["t:a|b//c"]),
    "semicolons": (b"a;b,c;d\n1;2;3\n", ["t:a|b,c|d/1|2|3"]),
    "tabs": (b"a\tb\rc\td", ["t:a|b/c|d"]),
    "open_quote": (b'a,"b\nc', ["t:a|b\nc"]),
    "utf_16": ("\ufeffä,б\n".encode("utf-16-le"), ["t:ä|б"]),
    "latin_1": ("ä,ö\n".encode("latin-1"), ["t:ä|ö"]),
})

fixture("fixture_errors", "pdf", {
    "not_pdf": (b"PK no package", ["!This file is not a PDF document."]),
    "damaged": (b"%PDF-1.4\n%%EOF", ["!This PDF is damaged: its document catalog could not be found."]),
    "password": (pdf(stream(_HELLO)).replace(b"trailer <<", b"trailer << /Encrypt << /Filter /Other >>"), ["!This PDF is encrypted with a security handler that is not supported."]),
})
