"""Plain readers and text sinks of the document model as Column expressions.

A document is one row, so none of these shuffles: pages, blocks, rows and cells are transformed in
place with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import columns as C
from .model import A4, PAGES

# The frame of a rendered page.
HTML_HEAD = """<!doctype html>
<html lang="en">
<head>
<meta charset="utf-8">
<meta name="viewport" content="width=device-width, initial-scale=1">
<title>"""
HTML_STYLE = """</title>
<style>
body { font-family: system-ui, sans-serif; line-height: 1.5; max-width: 60rem; margin: 2rem auto; padding: 0 1rem; color: #1b1b1b; }
section + section { border-top: 1px solid #ccc; margin-top: 2rem; padding-top: 1rem; }
table { border-collapse: collapse; margin: 1rem 0; }
th, td { border: 1px solid #999; padding: 0.3rem 0.6rem; text-align: left; vertical-align: top; }
th { background: #f0f0f0; }
</style>
</head>
<body>
"""
HTML_TAIL = "\n</body>\n</html>\n"
PRE_HEAD = '<!doctype html>\n<html lang="en">\n<head>\n  <meta charset="utf-8">\n  <title>Converted Text</title>\n</head>\n<body>\n  <pre>'
PRE_TAIL = "</pre>\n</body>\n</html>\n"


def txt_lines(text: Column) -> Column:
    """Lines of a page: its end is trimmed, then each line's end; a lone CR does not split."""
    return F.transform(F.split(C.trim_end(text), "\r?\n"), C.trim_end)


def txt_pages(text: Column) -> Column:
    """The model of a plain text: form feeds part pages, every line is a paragraph."""
    def block(line: Column) -> Column:
        return F.named_struct(
            F.lit("type"), F.lit("paragraph"), F.lit("level"), F.lit(None).cast("int"), F.lit("text"), line,
            F.lit("bold"), F.lit(None).cast("boolean"), F.lit("size"), F.lit(None).cast("double"),
            F.lit("lines"), F.lit(None).cast("array<string>"), F.lit("cells"), F.lit(None).cast("array<string>"),
            F.lit("rows"), F.lit(None).cast("array<array<string>>"))

    def page(part: Column) -> Column:
        return F.named_struct(
            F.lit("name"), F.lit(None).cast("string"), F.lit("width"), F.lit(A4[0]), F.lit("height"), F.lit(A4[1]),
            F.lit("blocks"), F.transform(txt_lines(part), block),
            F.lit("items"), F.lit(None).cast(PAGES.elementType["items"].dataType))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\f"), page)


def _cell_line(cell: Column) -> Column:
    return F.regexp_replace(F.coalesce(cell, F.lit("")), f"{C.SPACE}*\n{C.SPACE}*", " ")


def _row_line(row: Column) -> Column:
    return F.array_join(F.transform(row, _cell_line), "\t")


def to_text(pages: Column) -> Column:
    """TXT: cells by tab, rows by newline, blocks by a blank line, pages by two, page names as
    rules if there is more than one page and any has a name."""
    named = (F.size(pages) > 1) & F.exists(pages, lambda p: p["name"].isNotNull() & (p["name"] != ""))

    def block(b: Column) -> Column:
        table = F.array_join(F.transform(b["rows"], _row_line), "\n")
        return F.when(b["type"] == "table", table).when(b["lines"].isNotNull(), F.array_join(b["lines"], "\n")).otherwise(F.coalesce(b["text"], F.lit("")))

    def page(p: Column) -> Column:
        parts = F.transform(p["blocks"], block)
        title = F.array(F.concat(F.lit("=== "), p["name"], F.lit(" ===")))
        return F.array_join(F.when(named & (F.coalesce(p["name"], F.lit("")) != ""), F.concat(title, parts)).otherwise(parts), "\n\n")

    return F.concat(C.trim_end(F.array_join(F.transform(pages, page), "\n\n\n")), F.lit("\n"))


def _html_text(value: Column) -> Column:
    return F.replace(F.replace(C.escape_xml(value), F.lit("\n"), F.lit("<br>")), F.lit("\t"), F.lit("&emsp;"))


def to_html(title: Column, pages: Column) -> Column:
    """HTML: a section per page; blank paragraphs are dropped; the first of several rows is a head."""
    def row(r: Column, tag: Column) -> Column:
        cell = lambda c: F.concat(F.lit("<"), tag, F.lit(">"), _html_text(c), F.lit("</"), tag, F.lit(">"))
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))

    def block(b: Column) -> Column:
        level = F.coalesce(F.nullif(b["level"], F.lit(0)), F.lit(1)).cast("string")
        head = F.concat(F.lit("<h"), level, F.lit(">"), _html_text(b["text"]), F.lit("</h"), level, F.lit(">"))
        rows = F.transform(b["rows"], lambda r, i: row(r, F.when((i == 0) & (F.size(b["rows"]) > 1), F.lit("th")).otherwise(F.lit("td"))))
        bold = F.coalesce(b["bold"], F.lit(False))
        text = F.concat(F.lit("<p>"), F.when(bold, F.lit("<strong>")).otherwise(F.lit("")), _html_text(b["text"]), F.when(bold, F.lit("</strong>")).otherwise(F.lit("")), F.lit("</p>"))
        return (F.when(b["type"] == "heading", head).when(b["type"] == "table", F.concat(F.lit("<table>\n"), F.array_join(rows, "\n"), F.lit("\n</table>")))
                .when(C.trim(F.coalesce(b["text"], F.lit(""))) != "", text))

    def page(p: Column) -> Column:
        parts = F.filter(F.transform(p["blocks"], block), lambda x: x.isNotNull())
        name = F.array(F.concat(F.lit('<h2 class="page-name">'), _html_text(p["name"]), F.lit("</h2>")))
        parts = F.when(F.coalesce(p["name"], F.lit("")) != "", F.concat(name, parts)).otherwise(parts)
        return F.concat(F.lit("<section>\n"), F.array_join(parts, "\n"), F.lit("\n</section>"))

    shown = C.escape_xml(F.coalesce(F.nullif(title, F.lit("")), F.lit("Converted document")))
    return F.concat(F.lit(HTML_HEAD), shown, F.lit(HTML_STYLE), F.array_join(F.transform(pages, page), "\n"), F.lit(HTML_TAIL))


def sheets(pages: Column, source: Column) -> Column:
    """Array of (name, rows): tables give their rows; a heading is set off by an empty row; other
    blocks are a row of their cells or their text."""
    fallback = F.when(source == "pdf", F.lit("Page ")).otherwise(F.lit("Sheet "))
    empty = F.array().cast("array<array<string>>")

    def add(acc: Column, b: Column) -> Column:
        own = F.when(b["type"] == "table", F.transform(b["rows"], lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))).otherwise(
            F.array(F.when(b["cells"].isNotNull(), b["cells"]).otherwise(F.array(b["text"]))))
        gap = (b["type"] == "heading") & (F.size(acc) > 0) & (F.size(F.get(acc, F.size(acc) - 1)) > 0)
        return F.concat(acc, F.when(gap, F.array(F.array().cast("array<string>"))).otherwise(empty), own)

    return F.transform(pages, lambda p, i: F.struct(
        F.coalesce(F.nullif(p["name"], F.lit("")), F.concat(fallback, (i + 1).cast("string"))).alias("name"),
        F.aggregate(p["blocks"], empty, add).alias("rows")))


def rows_to_csv(rows: Column) -> Column:
    """CSV with CRLF after every row; nothing but CRLF if there is no row."""
    return F.concat(F.array_join(F.transform(rows, C.csv_row), "\r\n"), F.lit("\r\n"))


def text_to_html(text: Column) -> Column:
    """The browser's rendering of a plain text: all of it preformatted."""
    return F.concat(F.lit(PRE_HEAD), C.escape_html(text), F.lit(PRE_TAIL))
