"""Readers and writers: hand-made files, round trips, guards and damage."""

import hashlib
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

from vellumry.operators import layout, model
from vellumry.plans.convert import convert_bytes, read_pages, sniff
from vellumry.sources import docx, limits, pptx, xlsx, xmlio, zipio
from vellumry.sources.images import encode_png
from vellumry.sources.pdf import content, crypto, filters, fonts, objects, writer

TXT = "Total: 100% (net) \\ gross\n你好，世界。全角标点\nCafé “quoted” text\nLast line"
CSV = 'name,qty,note\nApple,3,"red, round"\nPear,12,"green\nlong"\n'
ONE = lambda *a: convert_bytes(*a)[0]["data"]


# ------------------------------------------------------------------ the properties of the whole

def test_txt_to_pdf_and_back():
    pdf = ONE(TXT.encode(), "a.txt", "txt", "pdf")
    assert pdf.startswith(b"%PDF-") and pdf == ONE(TXT.encode(), "a.txt", "txt", "pdf")
    text = ONE(pdf, "a.pdf", "pdf", "txt").decode()
    assert all(line in text for line in TXT.split("\n"))


def test_txt_to_docx_and_back():
    text = ONE(ONE(TXT.encode(), "a.txt", "txt", "docx"), "a.docx", "docx", "txt").decode()
    assert [x for x in text.split("\n") if x] == TXT.split("\n")


def test_txt_to_pptx_and_back():
    text = ONE(ONE(TXT.encode(), "a.txt", "txt", "pptx"), "a.pptx", "pptx", "txt").decode()
    assert all(line in text for line in TXT.split("\n"))


def test_csv_to_xlsx_and_back():
    book = ONE(CSV.encode(), "a.csv", "csv", "xlsx")
    assert ONE(book, "a.xlsx", "xlsx", "csv").decode("utf-8-sig").replace("\r\n", "\n") == CSV
    import json
    assert json.loads(ONE(book, "a.xlsx", "xlsx", "json")) == [{"name": "Apple", "qty": "3", "note": "red, round"}, {"name": "Pear", "qty": "12", "note": "green\nlong"}]


@pytest.mark.parametrize("target", ["xlsx", "docx", "pptx", "csv", "html", "txt"])
def test_pdf_tables_survive(target):
    pdf = ONE(CSV.encode(), "a.csv", "csv", "pdf")
    out = ONE(pdf, "a.pdf", "pdf", target)
    text = out.decode() if target in ("csv", "html", "txt") else ONE(out, f"a.{target}", target, "txt").decode()
    assert all(cell in text for cell in ("name", "qty", "Apple", "3", "red, round", "Pear", "12"))


def test_content_beats_extension():
    data = ONE(TXT.encode(), "a.txt", "txt", "docx")
    assert "Last line" in ONE(data, "b.pdf", "pdf", "txt").decode()
    assert sniff(b"x" * 1000 + b"%PDF-", "txt") == "pdf" and sniff(b"PK\x03\x04broken", "txt") == "txt" and sniff(b"plain", "csv") == "csv"


@pytest.mark.parametrize("data,name,target,words", [(b"\xd0\xcf\x11\xe0ab", "a.doc", "txt", "Old binary DOC"), (b"%PDF-1.4\n%%EOF", "a.pdf", "txt", "damaged"), (b"x", "a.txt", "xlsx", "TXT to XLSX"),
                                                    (b"", "a.txt", "pdf", "empty"), (b"x", "a.zzz", "pdf", "not supported"), (b"plain", "a.docx", "txt", "ZIP")])
def test_errors(data, name, target, words):
    with pytest.raises(ValueError, match=words):
        convert_bytes(data, name, None, target)


# ------------------------------------------------------------------ packages

def package(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_zip_both_ways():
    made = zipio.create([("a.txt", "é" * 100), ("b/c.bin", bytes(range(256)))])
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.testzip() is None and z.read("a.txt").decode() == "é" * 100 and z.infolist()[0].date_time[:3] == (1980, 1, 1)
    parts = zipio.entries(package({"x\\y.txt": "hi", "stored": "s"}))
    assert parts["x/y.txt"].read() == b"hi" and zipio.text(parts, "none") == ""
    with pytest.raises(zipio.PackageError):
        zipio.entries(b"PK\x03\x04 nothing")


def test_xml_is_lenient():
    root = xmlio.parse('<?xml version="1.0"?><!DOCTYPE x><w:a w:v="1 &lt; &#x41;"><b/>t<![CDATA[<raw>]]><!-- c --><c>&#99999999;x</d></w:a>')
    a = root.child("a")
    assert a.attrs["v"] == "1 < A" == a.attrs["w:v"] and a.text() == "t<raw>x" and [k.name for k in a.kids()] == ["b", "c"]
    assert xmlio.resolve("xl/workbook.xml", "../a/./b.xml") == "a/b.xml" and xmlio.resolve("xl/workbook.xml", "/c.xml") == "c.xml"


RELS = '<Relationships>%s</Relationships>'


def book(sheets, strings="", styles="", states=None, setting=""):
    states = states or {}
    listed = "".join(f'<sheet name="S{i}" sheetId="{i}" r:id="r{i}" {states.get(i, "")}/>' for i in range(1, len(sheets) + 1))
    rels = "".join(f'<Relationship Id="r{i}" Type="x/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    rels += '<Relationship Id="s" Type="x/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="t" Type="x/styles" Target="/xl/styles.xml"/>'
    files = {"xl/workbook.xml": f"<workbook>{setting}<sheets>{listed}</sheets></workbook>", "xl/_rels/workbook.xml.rels": RELS % rels, "xl/sharedStrings.xml": f"<sst>{strings}</sst>", "xl/styles.xml": styles}
    files |= {f"xl/worksheets/sheet{i}.xml": f"<worksheet><sheetData>{s}</sheetData></worksheet>" for i, s in enumerate(sheets, 1)}
    return package(files)


def test_xlsx_cells():
    styles = '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="[h]:mm &quot;h&quot;"/><numFmt numFmtId="171" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs></styleSheet>'
    strings = "<si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si><si><t>a_x000D__x0041_</t></si>"
    row = ('<row r="2"><c r="A2" t="s"><v>0</v></c><c t="s"><v>1</v></c><c r="D2" t="s"><v>2</v></c><c r="E2" t="b"><v>1</v></c><c r="F2" t="inlineStr"><is><t>in</t></is></c></row>'
           '<row r="3"><c r="A3" s="1"><v>45292</v></c><c r="B3" s="2"><v>0.75</v></c><c r="C3" s="3"><v>0.125</v></c><c r="D3" s="4"><v>45292.75</v></c><c r="E3"><v>0.30000000000000004</v></c><c r="XFE3"><v>9</v></c><c r="F3" t="e"><v>#N/A</v></c></row>')
    (name, rows), = xlsx.read_sheets(book([row], strings, styles))
    assert name == "S1" and rows == [[""] * 6, ["plain", "rich", "", "aA", "TRUE", "in"], ["2024-01-01", "18:00:00", "12.5%", "2024-01-01 18:00:00", "0.3", "#N/A"]]


def test_xlsx_guards():
    far = '<row r="1"><c r="A1"><v>1</v></c></row><row r="200"><c r="A200"><v>2</v></c></row><row r="201"/>'
    (_, rows), = xlsx.read_sheets(book([far]))
    rows_at = lambda *numbers: "".join(f'<row r="{n}"><c r="A{n}"><v>{n}</v></c></row>' for n in numbers)
    (_, gaps), = xlsx.read_sheets(book([rows_at(1, 1000, 1001, 1002)]))
    assert len(gaps) == 54 and [r[0] for r in gaps if r[0]] == ["1", "1000", "1001", "1002"]
    assert len(rows) == 1 + limits.BLANK_ROWS + 1
    cell = '<row r="1"><c r="A1" s="1"><v>0</v></c></row>'
    styles = '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    assert xlsx.read_sheets(book([cell], styles=styles, setting='<workbookPr date1904="1"/>'))[0][1] == [["1904-01-01"]]
    two = book([cell, cell, ""], states={1: 'state="hidden"'})
    assert [n for n, _ in xlsx.read_sheets(two)] == ["S2", "S3"] and [p["name"] for p in xlsx.read(two)] == ["S2"]
    with pytest.raises(zipio.PackageError):
        xlsx.read_sheets(book([cell], states={1: 'state="veryHidden"'}))
    assert [xlsx.format_kind(f) for f in ("yyyy", "mm:ss", "m", "0.00", '"day" 0', "[Red]0%", "mm0")] == ["date", "time", "time", "", "", "percent", ""]


def test_xlsx_writer():
    data = xlsx.write([("A/b", [["n", "1,234", "1234567890123456", "007", "-1.5", "a\nb"]]), ("a b", [["x" * 40000]])], "t", "2000-01-01T00:00:00Z")
    parts = zipio.entries(data)
    sheet = zipio.text(parts, "xl/worksheets/sheet1.xml")
    assert 's="1"><v>1234</v>' in sheet and "<v>-1.5</v>" in sheet and "<t xml:space=\"preserve\">007</t>" in sheet and 's="3"' in sheet
    assert [n for n, _ in xlsx.read_sheets(data)] == ["A b", "a b (2)"] and len(xlsx.read_sheets(data)[1][1][0][0]) == limits.CELL_CHARS


def word(body, styles="", numbers=""):
    rels = '<Relationship Id="a" Type="x/styles" Target="styles.xml"/><Relationship Id="b" Type="x/numbering" Target="numbering.xml"/>'
    return package({"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": RELS % rels, "word/styles.xml": f"<w:styles>{styles}</w:styles>", "word/numbering.xml": f"<w:numbering>{numbers}</w:numbering>"})


def test_docx_paragraphs():
    p = lambda t, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    item = lambda t, level: p(t, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>')
    numbers = '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerRoman"/></w:lvl><w:lvl w:ilvl="2"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num>'
    styles = '<w:style w:styleId="H"><w:name w:val="heading 2"/></w:style><w:style w:styleId="O"><w:name w:val="own"/><w:pPr><w:outlineLvl w:val="5"/></w:pPr></w:style>'
    body = (p("Head", '<w:pStyle w:val="H"/>') + p("Out", '<w:pStyle w:val="O"/>') + item("a", 0) + item("b", 1) + item("c", 1) + item("d", 0) + item("e", 1) + item("f", 2)
            + '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bo</w:t><w:tab/><w:br/><w:noBreakHyphen/></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t> </w:t></w:r></w:p>'
            + '<w:p><w:r><w:t>x</w:t><w:br w:type="page"/><w:t>y</w:t></w:r></w:p>' + p("next") + p("own page", "<w:pageBreakBefore/>") + '<w:sectPr><w:pgSz w:w="10000" w:h="20000"/></w:sectPr>')
    pages = docx.read(word(body, styles, numbers))
    first = [(b["type"], b.get("level"), b["text"]) for b in pages[0]["blocks"]]
    assert first[:2] == [("heading", 2, "Head"), ("heading", 3, "Out")]
    assert [t for _, _, t in first[2:8]] == ["3. a", "  i. b", "  ii. c", "4. d", "  i. e", "    • f"]
    assert pages[0]["blocks"][8]["text"] == "bo\t\n-" and pages[0]["blocks"][8]["bold"] and first[9][2] == "xy"
    assert [b["text"] for b in pages[1]["blocks"]] == ["next"] and [b["text"] for b in pages[2]["blocks"]] == ["own page"]
    assert (pages[0]["width"], pages[0]["height"]) == (500, 1000)


def test_docx_tables_boxes_and_errors():
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    nested = f'<w:tc><w:tbl><w:tr>{cell("i")}{cell("j")}</w:tr></w:tbl></w:tc>'
    table = f'<w:tbl><w:tr>{cell("wide", "<w:gridSpan w:val=\"2\"/>")}{cell("c")}</w:tr><w:tr>{cell("d")}{nested}</w:tr></w:tbl>'
    box = '<w:p><w:r><w:t>with</w:t><mc:AlternateContent><mc:Choice><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></mc:Choice><mc:Fallback><w:t>no</w:t></mc:Fallback></mc:AlternateContent></w:r></w:p>'
    blocks = docx.read(word(table + box))[0]["blocks"]
    assert blocks[0]["rows"] == [["wide", "", "c"], ["d", "i | j", ""]] and [b["text"] for b in blocks[1:]] == ["with", "boxed"]
    outline = '<w:p><w:pPr><w:pStyle w:val="H"/><w:outlineLvl w:val="2"/></w:pPr><w:r><w:t xml:space="preserve"> Head </w:t></w:r></w:p><w:p><w:pPr><w:outlineLvl w:val="2"/></w:pPr><w:r><w:t>own</w:t></w:r></w:p>'
    heads = docx.read(word(outline + f'<w:tbl><w:tr>{cell(" padded ")}</w:tr></w:tbl>', '<w:style w:styleId="H"><w:name w:val="heading 1"/></w:style>'))[0]["blocks"]
    assert [(b.get("level"), b.get("text")) for b in heads[:2]] == [(1, "Head"), (3, "own")] and heads[2]["rows"] == [["padded"]]
    with pytest.raises(zipio.PackageError, match="body"):
        docx.read(package({"word/document.xml": "<x/>"}))
    with pytest.raises(zipio.PackageError, match="missing"):
        docx.read(package({"other.xml": "<x/>"}))


def show(trees, size='<p:sldSz cx="9144000" cy="6858000"/>'):
    ids = "".join(f'<p:sldId r:id="r{i}"/>' for i in range(1, len(trees) + 1))
    rels = "".join(f'<Relationship Id="r{i}" Type="x/slide" Target="slides/s{i}.xml"/>' for i in range(1, len(trees) + 1))
    files = {"ppt/presentation.xml": f"<p:presentation><p:sldIdLst>{ids}</p:sldIdLst>{size}</p:presentation>", "ppt/_rels/presentation.xml.rels": RELS % rels}
    return package(files | {f"ppt/slides/s{i}.xml": f"<p:sld><p:cSld><p:spTree>{t}</p:spTree></p:cSld></p:sld>" for i, t in enumerate(trees, 1)})


def shape(text, x=0, y=0, kind=None, level=0):
    ph = f'<p:nvPr><p:ph type="{kind}"/></p:nvPr>' if kind else ""
    return f'<p:sp><p:nvSpPr>{ph}</p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:pPr lvl="{level}"/><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


def test_pptx_order_and_groups():
    table = '<p:graphicFrame><p:xfrm><a:off x="0" y="900"/></p:xfrm><a:tbl><a:tr><a:tc><a:p><a:r><a:t>a</a:t></a:r></a:p></a:tc><a:tc><a:p/></a:tc></a:tr></a:tbl></p:graphicFrame>'
    tree = table + shape("low", 0, 500) + shape("right", 9, 100) + shape("left", 1, 100, level=2) + shape("foot", 0, 0, "ftr") + f'<p:grpSp>{shape("in group", 0, 300)}</p:grpSp>' + shape("Title", 0, 999, "ctrTitle")
    page, = pptx.read(show([tree]))
    assert [b.get("text") or b["rows"] for b in page["blocks"]] == ["Title", "    left", "right", "in group", "low", [["a", ""]]]
    assert page["name"] == "Slide 1" and (page["width"], page["height"]) == (720, 540)
    with pytest.raises(zipio.PackageError, match="no slides"):
        pptx.read(show([]))


def test_pptx_flow_budget_tables_and_headings():
    blocks = [model.heading("A"), model.heading("B")] + [model.paragraph(f"p{i}") for i in range(14)] + [model.table([[str(i)] for i in range(30)])]
    slides = pptx.flow([{"blocks": blocks}])
    assert slides[0]["title"] == "B" and len(slides[0]["texts"]) == 12 and len(slides[1]["texts"]) == 2
    assert [len(s["rows"]) for s in slides if s["rows"] is not None] == [12, 12, 6]
    assert [s["title"] for s in slides] == ["B"] * 5
    assert [s["title"] for s in pptx.flow([{"blocks": blocks[:2]}], keep_consecutive=True)] == ["A", "B"]
    untitled = [{"name": "Page name", "blocks": [model.paragraph("x")]}, {"blocks": [model.paragraph("y")]}, {"blocks": []}]
    assert [s["title"] for s in pptx.flow(untitled, "Document")] == ["Page name", "Document", "Document"]
    back = pptx.read(pptx.write([{"name": None, "width": None, "height": None, "blocks": [model.heading("H"), model.paragraph("a\nb"), model.table([["1", "2"]])]}], "t", "2000-01-01T00:00:00Z"))
    assert [[b.get("text") or b["rows"] for b in p["blocks"]] for p in back] == [["H", "a\nb"], ["H", [["1", "2"]]]]


# ------------------------------------------------------------------ PDF

def pdf_of(objs, trailer="", version=b"1.5"):
    """A file from numbered object bodies, with a table."""
    data, offsets = bytearray(b"%PDF-" + version + b"\n"), {}
    for n, body in objs.items():
        offsets[n] = len(data)
        data += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start, size = len(data), max(objs) + 1
    data += b"xref\n0 %d\n" % size + b"".join(b"%010d 00000 n \n" % offsets[n] if n in offsets else b"0000000000 65535 f \n" for n in range(size))
    return bytes(data + f"trailer << /Size {size} /Root 1 0 R {trailer} >>\nstartxref\n{start}\n%%EOF".encode())


def stream(body, more=""):
    return f"<< /Length {len(body)} {more} >>\nstream\n".encode() + body + b"\nendstream"


def simple(content_bytes, more="", page="", font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding /WinAnsiEncoding >>", extra=None):
    return {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] >>",
            3: f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F 5 0 R >> /XObject << /X 6 0 R >> >> {page} >>".encode(), 4: stream(content_bytes, more), 5: font, **(extra or {})}


SHOW = b"BT /F 10 Tf 20 50 Td (Hello) Tj ET"


def text_of(data):
    return [r["text"] for p in content.read_runs(data)[0] for r in p["runs"]]


def test_pdf_plain_and_damaged():
    good = pdf_of(simple(SHOW))
    assert text_of(good) == ["Hello"] and text_of(b"junk\n" + good) == ["Hello"]
    assert text_of(good.replace(b"startxref", b"startxxxx")) == ["Hello"]
    assert text_of(good.replace(b"xref\n0", b"xref\n9")) == ["Hello"]
    assert text_of(good.replace(b"/Length 34", b"/Length 99")) == ["Hello"]
    run = content.read_runs(good)[0][0]["runs"][0]
    assert run["bold"] and abs(run["sx"] - 20) < 1e-6 and abs(run["sy"] - 50) < 1e-6 and run["size"] == 10
    with pytest.raises(ValueError):
        content.read_runs(b"x" * 5000 + good)


@pytest.mark.parametrize("turn,place", [(0, (20, 50)), (90, (50, 20)), (180, (180, 50)), (270, (50, 180))])
def test_pdf_rotation(turn, place):
    page = content.read_runs(pdf_of(simple(SHOW, page=f"/Rotate {turn}")))[0][0]
    assert (page["width"], page["height"]) == ((200, 100) if turn % 180 == 0 else (100, 200))
    run = page["runs"][0]
    assert (round(run["sx"]), round(run["sy"])) == place


def test_pdf_operators():
    ops = b"BT /F 10 Tf 12 TL 1 0 0 1 10 90 Tm (A) Tj T* (B) Tj (C) ' 0 0 (D) \" [(E) -2000 (F)] TJ 10 Tz ET q 2 0 0 2 0 0 cm BT /F 5 Tf 5 5 Td <47> Tj ET Q BI /W 1 ID xx EI /X Do BT /F 9 Tf 1 2 Td (\\050\\\\n\\) t) Tj ET"
    form = {6: stream(b"BT /F 10 Tf 100 10 Td (form) Tj ET", "/Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 0]")}
    runs = content.read_runs(pdf_of(simple(ops, extra=form)))[0][0]["runs"]
    texts = [r["text"] for r in runs]
    assert texts[:4] == ["A", "B", "C", "DE"] and texts[4] == "F" and "G" in texts and "form" in texts and "(\\n) t" in texts
    assert runs[texts.index("G")]["size"] == 10 and round(runs[texts.index("form")]["sx"]) == 105


def ascii85(data):
    import base64
    return base64.a85encode(data) + b"~>"


def run_length(data):
    return b"".join(bytes([len(data[i:i + 100]) - 1]) + data[i:i + 100] for i in range(0, len(data), 100)) + b"\x80"


def lzw(data):
    """Codes of nine bits, cleared before the width would grow."""
    codes, out, bits = [], 0, 0
    for i, b in enumerate(data):
        if i % 200 == 0:
            codes.append(256)
        codes.append(b)
    for c in [*codes, 257]:
        out, bits = out << 9 | c, bits + 9
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


def png_up(data, columns):
    rows, above = [], bytes(columns)
    for i in range(0, len(data), columns):
        row = data[i:i + columns].ljust(columns)
        rows.append(b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above)))
        above = row
    return b"".join(rows)


@pytest.mark.parametrize("body,more", [(zlib.compress(SHOW), "/Filter /FlateDecode"), (zlib.compress(SHOW)[:-4], "/Filter /FlateDecode"), (ascii85(SHOW), "/Filter [/ASCII85Decode]"), (SHOW.hex().encode() + b">", "/Filter /AHx"),
                                       (run_length(SHOW), "/Filter /RunLengthDecode"), (lzw(SHOW), "/Filter /LZWDecode"), (ascii85(zlib.compress(SHOW)), "/Filter [/A85 /Fl]"),
                                       (zlib.compress(png_up(SHOW, 8)), "/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 8 >>")])
def test_pdf_filters(body, more):
    assert text_of(pdf_of(simple(body, more))) == ["Hello"]


def test_predictors_against_numpy():
    rng = np.random.default_rng(1)
    plain = rng.integers(0, 256, (4, 6), dtype=np.uint8)
    tiff = np.concatenate([plain[:, :1], np.diff(plain, axis=1)], axis=1).astype(np.uint8)
    assert filters.predicted(tiff.tobytes(), {"Predictor": 2, "Columns": 6}) == plain.tobytes()
    coded, above = bytearray(), np.zeros(6, int)
    for kind, row in zip((0, 1, 3, 4), plain.astype(int)):
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        coded += bytes([kind]) + bytes(((row - {0: 0, 1: left, 3: (left + above) // 2, 4: paeth}[kind]) & 255).astype(np.uint8))
        above = row
    assert filters.predicted(bytes(coded), {"Predictor": 15, "Columns": 6}) == plain.tobytes()


def test_pdf_object_and_xref_streams():
    objs = simple(SHOW)
    inner = {k: objs.pop(k) for k in (1, 2, 3, 5)}
    heads, bodies = [], b""
    for k, v in inner.items():
        heads.append(f"{k} {len(bodies)}")
        bodies += v + b" "
    head = (" ".join(heads) + " ").encode()
    objs[7] = stream(zlib.compress(head + bodies), f"/Type /ObjStm /N {len(inner)} /First {len(head)} /Filter /FlateDecode")
    data, offsets = bytearray(b"%PDF-1.5\n"), {}
    for n, body in objs.items():
        offsets[n] = len(data)
        data += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    rows = b""
    for n in range(9):
        if n in inner:
            rows += struct.pack(">BHB", 2, 7, list(inner).index(n))
        else:
            rows += struct.pack(">BHB", 1 if n in offsets or n == 8 else 0, offsets.get(n, len(data)), 0)
    start = len(data)
    data += b"8 0 obj\n" + stream(zlib.compress(rows), "/Type /XRef /Size 9 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    assert text_of(bytes(data)) == ["Hello"] and text_of(bytes(data).replace(b"startxref", b"startxxxx")) == ["Hello"]


def test_pdf_fonts():
    differences = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /Differences [65 /eacute /uni4E2D /f_i /Lslash.alt 70 /u1F600] >> /FirstChar 65 /Widths [500 500 500 500] >>"
    assert text_of(pdf_of(simple(b"BT /F 10 Tf 0 0 Td (ABCDF) Tj ET", font=differences))) == ["é中fiŁ😀"]
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <41> <00660066> endbfchar 2 beginbfrange <42> <44> <0391> <50> <51> [<0061> <0062>] endbfrange"
    mapped = b"<< /Type /Font /Subtype /TrueType /BaseFont /ABCDEF+Some-BoldItalic /ToUnicode 6 0 R >>"
    data = pdf_of(simple(b"BT /F 10 Tf 0 0 Td (ABCDPQ) Tj ET", font=mapped, extra={6: stream(cmap)}))
    assert text_of(data) == ["ffΑΒΓab"]
    run = content.read_runs(data)[0][0]["runs"][0]
    assert run["bold"] and run["italic"]
    composite = b"<< /Type /Font /Subtype /Type0 /BaseFont /Y /Encoding /Identity-H /DescendantFonts [7 0 R] /ToUnicode 6 0 R >>"
    big = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0100> <0900> <4E00> endbfrange"
    data = pdf_of(simple(b"BT /F 10 Tf 0 0 Td <0100010100050102> Tj ET", font=composite, extra={6: stream(big), 7: b"<< /Subtype /CIDFontType2 /DW 1000 /W [256 [500] 257 300 700] >>"}))
    pages, unmapped, _ = content.read_runs(data)
    assert "".join(r["text"] for r in pages[0]["runs"]).replace(" ", "") == "一丁丂" and unmapped == 1
    assert fonts.glyph_text("Adieresis") == "Ä" and fonts.glyph_text("alpha") == "α" and fonts.glyph_text(".notdef") is None and fonts.glyph_text("g123") is None


def test_aes_and_rc4_vectors():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        keys = crypto._round_keys(bytes(range(size)))
        assert crypto._encrypt_block(plain, keys).hex() == want and crypto._decrypt_block(bytes.fromhex(want), keys) == plain
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    data = bytes(range(48))
    assert crypto.aes_cbc_decrypt(key, crypto.aes_cbc_encrypt(key, data, plain), plain, unpad=False) == data


def encrypted(version):
    """A file encrypted for the empty user password."""
    objs, owner, permissions, file_id = simple(SHOW), b"o" * 32, -4, b"0123456789abcdef"
    if version == 6:
        key = bytes(range(32))
        check, salt = b"CHECKSLT", b"KEYSALT!"
        user = crypto.hardened_hash(b"", check, b"", 6) + check + salt
        ue = crypto.aes_cbc_encrypt(crypto.hardened_hash(b"", salt, b"", 6), key, bytes(16))
        d = f"/V 5 /R 6 /Length 256 /U <{user.hex()}> /UE <{ue.hex()}> /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF"
        seal = lambda body, n: bytes(16) + crypto.aes_cbc_encrypt(key, body + bytes([16 - len(body) % 16]) * (16 - len(body) % 16), bytes(16))
    else:
        size, rev = (5, 2) if version == 2 else (16, 3 if version == 3 else 4)
        key = hashlib.md5(crypto.PADDING + owner + struct.pack("<i", permissions) + file_id).digest()
        if rev >= 3:
            for _ in range(50):
                key = hashlib.md5(key[:size]).digest()
        key = key[:size]
        if rev == 2:
            user = crypto.rc4(key, crypto.PADDING)
        else:
            user = crypto.rc4(key, hashlib.md5(crypto.PADDING + file_id).digest())
            for i in range(1, 20):
                user = crypto.rc4(bytes(b ^ i for b in key), user)
            user += bytes(16)
        cf = "/CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF /StrF /StdCF" if version == 4 else ""
        d = f"/V {1 if version == 2 else 2 if version == 3 else 4} /R {rev} /Length {size * 8} /U <{user.hex()}> {cf}"

        def seal(body, n):
            salted = hashlib.md5(key + struct.pack("<I", n)[:3] + b"\0\0" + (b"sAlT" if version == 4 else b"")).digest()[:min(16, size + 5)]
            if version != 4:
                return crypto.rc4(salted, body)
            pad = 16 - len(body) % 16
            return bytes(16) + crypto.aes_cbc_encrypt(salted, body + bytes([pad]) * pad, bytes(16))
    objs[4] = stream(seal(SHOW, 4))
    objs[9] = f"<< /Filter /Standard /O <{owner.hex()}> /P {permissions} {d} >>".encode()
    return pdf_of(objs, f"/Encrypt 9 0 R /ID [<{file_id.hex()}> <{file_id.hex()}>]")


@pytest.mark.parametrize("version", [2, 3, 4, 6])
def test_pdf_encryption(version):
    data = encrypted(version)
    assert text_of(data) == ["Hello"]
    with pytest.raises(ValueError, match="password"):
        content.read_runs(data.replace(b"/U <", b"/U <ff"))
    with pytest.raises(ValueError, match="handler"):
        content.read_runs(data.replace(b"/Standard", b"/Other   "))


def test_pdf_writer_pages_and_title():
    data = writer.write([model.page([model.paragraph(f"line {i}") for i in range(200)], 300, 200)], "Tïtle 題")
    doc = objects.Document(data)
    assert doc.title() == "Tïtle 題" and len(doc.pages()) > 5
    text = "\n".join(text_of(data))
    assert all(f"line {i}" in text for i in range(200))
    tall = writer.write([model.page([model.table([["h", "k"], ["x\n" * 500, "y"]])], 300, 200)], "t")
    assert len(objects.Document(tall).pages()) == 2  # a cell is cut at one page


# ------------------------------------------------------------------ layout

def run(text, x, y, size=10.0, bold=False, width=None, ux=1.0, uy=0.0):
    w = width if width is not None else len(text) * size * 0.5
    return {"text": text, "sx": x, "sy": y, "ex": x + w * ux, "ey": y + w * uy, "ux": ux, "uy": uy, "size": size, "bold": bold, "italic": False}


def test_layout_paragraphs_and_headings():
    runs = [run("Big head", 50, 40, 20, True), run("first line of the text that goes on-", 50, 70), run("ward to the right edge of column", 50, 82, width=182), run("short", 50, 94), run("New after gap", 50, 130), run("• item", 50, 142), run("side", 5, 300, ux=0.0, uy=1.0)]
    blocks = layout.layout([{"width": 300, "height": 400, "runs": runs}])[0]["blocks"]
    assert (blocks[0]["type"], blocks[0]["level"], blocks[0]["text"]) == ("heading", 1, "Big head")
    assert blocks[1]["text"].startswith("first line of the text that goes on-ward to") and blocks[1]["text"].endswith("short")
    assert [b["text"] for b in blocks[2:]] == ["New after gap", "• item", "side"]


def test_layout_tables_and_soft_gaps():
    rows = [[("Name", 50), ("Qty", 120), ("Note", 180)], [("Apple", 50), ("3", 120), ("red", 180)], [("Pear", 50), ("12", 120), ("green", 180)]]
    runs = [run(t, x, 50 + 14 * i) for i, r in enumerate(rows) for t, x in r]
    block, = layout.layout([{"width": 300, "height": 200, "runs": runs}])[0]["blocks"]
    assert block["rows"] == [[t for t, _ in r] for r in rows]
    soft = layout.build_lines([run("ab", 50, 50), run("cd", 68, 50), run("plain text over the gap", 50, 62)])
    assert [c.text for c in soft[0].cells] == ["ab cd"]


def test_layout_two_columns():
    left, right = "left side of the page has text", "right side of the page has more"
    runs = [r for i in range(10) for r in (run(f"{left} {i}", 40, 50 + 12 * i, width=150), run(f"{right} {i}", 220, 50 + 12 * i, width=150))]
    pages = layout.layout([{"width": 400, "height": 400, "runs": runs}])
    text = " ".join(b["text"] for b in pages[0]["blocks"])
    assert text.index(f"{left} 9") < text.index(f"{right} 0")


def test_layout_errors_and_body_size():
    with pytest.raises(layout.NoText, match="text layer"):
        layout.layout([{"width": 1, "height": 1, "runs": []}])
    with pytest.raises(layout.NoText, match="fonts"):
        layout.layout([{"width": 1, "height": 1, "runs": []}], unmapped=5)
    lines = layout.build_lines([run("aaaa", 0, 10, 9.2), run("bbbb", 0, 30, 12.1)])
    assert layout.dominant_size(lines) == 9.0 and layout.dominant_size([]) == 11.0


def test_soft_hyphen_and_cjk_joining():
    lines = layout.build_lines([run("soft­", 0, 10), run("ened", 0, 22), run("漢字", 0, 34), run("続き", 0, 46)])
    texts = [line.text for line in lines]
    assert layout.joined(texts[:2]) == "softened" and layout.joined(texts[2:]) == "漢字続き"
    assert layout.joined(["page 2-", "up"]) == "page 2-up" and layout.joined(["a-", "Ünder"]) == "a- Ünder"


def test_layout_short_lines_are_measured_against_text_lines_only():
    prose = [run(f"{'word ' * 8}{i}", 50, 40 + 12 * i, width=150) for i in range(3)]
    table = [run(t, x, 120 + 14 * i) for i in range(3) for t, x in (("Name", 50), ("Qty", 250), ("Price", 420))]
    blocks = layout.layout([{"width": 600, "height": 400, "runs": prose + table}])[0]["blocks"]
    assert [b["type"] for b in blocks] == ["paragraph", "table"] and len(blocks[0]["lines"]) == 3


def test_layout_columns_join_by_the_largest_size_and_lone_lines_keep_their_cells():
    rows = [[("aa", 50, 10.0, 20), ("bb", 71.5, 10.0, 20), ("cc", 150, 10.0, 20)], [("dd", 50, 20.0, 20), ("ee", 150, 10.0, 20)]]
    assert len(layout.column_intervals([(50, 70), (71.5, 91.5)], 0.2 * 20)) == 1 and len(layout.column_intervals([(50, 70), (71.5, 91.5)], 0.2 * 5)) == 2
    lone = layout.layout([{"width": 400, "height": 100, "runs": [run("left", 50, 20), run("right", 200, 20)]}])[0]["blocks"]
    assert [(b["type"], b["text"], b["cells"]) for b in lone] == [("paragraph", "left\tright", ["left", "right"])]
    assert rows


def test_png_encoder_reads_back(spark, tmp_path):
    from vellumry.sources import files, images

    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(encode_png(pixels))
    (tmp_path / "b.png").write_bytes(b"no image")
    every = files.image_rows(spark, str(tmp_path))
    assert ["cannot" in (r.error or "") or "can be decoded" in (r.error or "") for r in images.convert(every).orderBy("origin").collect()] == [False, True]
    rows = every.where("error is null")
    r = rows.first()
    assert np.array_equal(images.from_bgr(r.data, r.height, r.width, r.nChannels), pixels)
    assert images.convert(rows).first().data == encode_png(pixels) and "encoder" in images.convert(rows, "webp").first().error


def test_txt_pages():
    pages = read_pages(b"a  \r\nb\n\nc\n\n\x0cd\re", "txt")
    assert [[b["text"] for b in p["blocks"]] for p in pages] == [["a", "b", "", "c"], ["d\re"]]


def test_pdf_glyphs_are_worked_out_once():
    """A character is cleaned and coded once, however often it is shown."""
    from vellumry.functions import text as rules
    from vellumry.plans import convert
    from vellumry.sources.pdf import content

    body = "\n".join(f"The quick brown fox {n} jumps over the lazy dog" for n in range(300))
    content.clean.cache_clear()
    rules.win_ansi.cache_clear()
    pages = convert.read_pages(writer.write(convert.read_pages(body.encode(), "txt"), "t", "txt"), "pdf")
    found = "".join(b["text"] or "" for p in pages for b in p["blocks"])
    assert [c for c in found if c.isalpha()] == [c for c in body if c.isalpha()]
    assert content.clean.cache_info().misses <= len(set(body)) and rules.win_ansi.cache_info().misses <= len(set(body))
