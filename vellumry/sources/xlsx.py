"""Excel workbooks: reader to sheets of text cells, and writer with typed cells."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta

from ..functions.columns import GROUPED_NUMBER, PLAIN_NUMBER
from ..functions.text import column_index, column_name, escape_xml, round_half_up, significant, utf16_length
from ..operators import model
from . import limits, ooxml, xmlio, zipio
from .zipio import PackageError

_ESCAPE = re.compile(r"_x([0-9A-Fa-f]{4})_")
_REF = re.compile(r"([A-Za-z]+)(\d*)")
# Built-in number formats that show dates, times and percentages.
DATE_IDS = frozenset([*range(14, 18), 22, *range(27, 32), 34, 35, 36, *range(50, 59)])
TIME_IDS = frozenset([18, 19, 20, 21, 32, 33, 45, 46, 47])
PERCENT_IDS = frozenset([9, 10])


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: "" if m[1].upper() == "000D" else chr(int(m[1], 16)), text)


def rich_text(node: xmlio.Element | None) -> str:
    """Runs of a string without its phonetic guide."""
    if node is None:
        return ""
    parts = []
    for c in node.kids():
        if c.name == "t":
            parts.append(c.text())
        elif c.name == "r":
            parts += [t.text() for t in c.kids("t")]
    return _unescaped("".join(parts))


def format_kind(code: str) -> str:
    """date, time, percent or empty, by a custom format code.  Parts in brackets do not count, so
    elapsed times are told by their minutes."""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code).lower()
    day, clock = re.search("[dy]", bare), re.search("[hs]", bare)
    if day or clock or ("m" in bare and not re.search("[0#]", bare)):
        return "date" if day else "time"
    return "percent" if "%" in bare else ""


def _builtin_kind(number: int) -> str:
    return "date" if number in DATE_IDS else "time" if number in TIME_IDS else "percent" if number in PERCENT_IDS else ""


def cell_formats(styles: xmlio.Element) -> list[str]:
    """The kind of each cell style."""
    custom = {n.attrs.get("numFmtId"): format_kind(n.attrs.get("formatCode", "")) for n in styles.find_all("numFmt")}
    table = styles.find("cellXfs")
    out = []
    for xf in table.kids("xf") if table else ():
        number = xf.attrs.get("numFmtId", "0")
        out.append(custom[number] if number in custom else _builtin_kind(int(number) if number.isdigit() else 0))
    return out


def number_text(raw: str, kind: str, epoch_1904: bool) -> str:
    """A stored number as it is read: ISO dates and times, percentages, else 15 digits."""
    try:
        value = float(raw)
    except ValueError:
        return raw
    if not raw.strip() or not math.isfinite(value):
        return raw
    if kind in ("date", "time"):
        seconds = round_half_up((value + (1462 if epoch_1904 else 0) - 25569) * 86400)
        try:
            at = datetime(1970, 1, 1) + timedelta(seconds=seconds)
        except OverflowError:
            return raw
        if kind == "time" and value < 1:
            return at.strftime("%H:%M:%S")
        day = f"{at.year:04d}-{at.month:02d}-{at.day:02d}"
        return day if value == math.floor(value) else f"{day} {at:%H:%M:%S}"
    return significant(value * 100) + "%" if kind == "percent" else significant(value)


def _sheet_rows(sheet: xmlio.Element, strings: list[str], formats: list[str], epoch_1904: bool) -> list[list[str]]:
    rows: list[list[str]] = []
    data = sheet.find("sheetData")
    following = 1  # the number of a row that follows the last one, whatever was left out of a gap
    for row in data.kids("row") if data else ():
        number = int(row.attrs["r"]) if row.attrs.get("r", "").isdigit() and int(row.attrs["r"]) else following
        rows += [[] for _ in range(min(number - following, limits.BLANK_ROWS))]
        following = number + 1
        cells: dict[int, str] = {}
        column = -1
        for c in row.kids("c"):
            ref = _REF.match(c.attrs.get("r", ""))
            column = column_index(ref[1]) if ref else column + 1
            if column >= limits.COLUMNS:
                continue
            value = _cell_value(c, strings, formats, epoch_1904)
            if value:
                cells[column] = value
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    while rows and not any(rows[-1]):
        rows.pop()
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _cell_value(c: xmlio.Element, strings: list[str], formats: list[str], epoch_1904: bool) -> str:
    kind, v = c.attrs.get("t", "n"), c.child("v")
    raw = v.text() if v is not None else ""
    if kind == "s":
        return strings[int(raw)] if raw.strip().isdigit() and int(raw) < len(strings) else ""
    if kind == "inlineStr":
        return rich_text(c.child("is"))
    if kind in ("str", "e", "d"):
        return _unescaped(raw)
    if kind == "b":
        return "TRUE" if raw.strip() == "1" else "FALSE" if raw else ""
    style = c.attrs.get("s", "0")
    known = formats[int(style)] if style.isdigit() and int(style) < len(formats) else ""
    return number_text(raw, known, epoch_1904) if raw else ""


def read_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of the visible worksheets in order."""
    parts = zipio.entries(data)
    book_part = xmlio.main_part(parts, "xl/workbook.xml")
    if book_part not in parts:
        raise PackageError("This file is not an Excel workbook (xl/workbook.xml is missing).")
    book, rels = xmlio.parse(zipio.text(parts, book_part)), xmlio.relations(parts, book_part)
    by_kind = {kind.rpartition("/")[2]: target for kind, target in rels.values()}
    strings = [rich_text(si) for si in xmlio.parse(zipio.text(parts, by_kind.get("sharedStrings", "xl/sharedStrings.xml"))).find_all("si")]
    formats = cell_formats(xmlio.parse(zipio.text(parts, by_kind.get("styles", "xl/styles.xml"))))
    setting = book.find("workbookPr")
    epoch_1904 = setting is not None and setting.attrs.get("date1904") in ("1", "true")
    out = []
    for sheet in book.find_all("sheet"):
        kind, target = rels.get(sheet.attrs.get("r:id", sheet.attrs.get("id", "")), ("", ""))
        if sheet.attrs.get("state") in ("hidden", "veryHidden") or not kind.endswith("/worksheet") or target not in parts:
            continue
        out.append((sheet.attrs.get("name") or f"Sheet{len(out) + 1}", _sheet_rows(xmlio.parse(zipio.text(parts, target)), strings, formats, epoch_1904)))
    if not out:
        raise PackageError("This workbook has no visible worksheets with cell data.")
    return out


def read(data: bytes) -> list[dict]:
    """Pages of the model: a page with one table per sheet; blank sheets only if all are blank."""
    sheets = read_sheets(data)
    kept = [s for s in sheets if s[1]] or sheets[:1]
    width, height = model.A4[1], model.A4[0]
    return [model.page([model.table(rows)] if rows else [], width, height, name) for name, rows in kept]


# ------------------------------------------------------------------ writer

def sheet_names(names: list[str | None]) -> list[str]:
    """Names that Excel accepts, told apart without regard to case."""
    used, out = set(), []
    for n, raw in enumerate(names, 1):
        name = re.sub(r"[\[\]:*?/\\\x00-\x1f]", " ", raw or f"Sheet{n}").strip()[:limits.SHEET_NAME] or f"Sheet{n}"
        suffix = 2
        while name.lower() in used:
            tail = f" ({suffix})"
            name, suffix = name[:limits.SHEET_NAME - len(tail)] + tail, suffix + 1
        used.add(name.lower())
        out.append(name)
    return out


def _cell(value: str, ref: str) -> str:
    short = len(re.sub(r"\D", "", value)) <= 15
    if short and re.fullmatch(PLAIN_NUMBER[1:-1], value, re.ASCII):
        return f'<c r="{ref}"><v>{value}</v></c>'
    if short and re.fullmatch(GROUPED_NUMBER[1:-1], value, re.ASCII):
        return f'<c r="{ref}" s="{2 if "." in value else 1}"><v>{value.replace(",", "")}</v></c>'
    style = ' s="3"' if "\n" in value else ""
    if utf16_length(value) > limits.CELL_CHARS:
        value = value.encode("utf-16-le")[:2 * limits.CELL_CHARS].decode("utf-16-le", "ignore")
    return f'<c r="{ref}"{style} t="inlineStr"><is><t xml:space="preserve">{escape_xml(value)}</t></is></c>'


def _worksheet(rows: list[list[str]]) -> str:
    widths: dict[int, int] = {}
    body = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, value in enumerate(row):
            if value:
                widths[c] = max(widths.get(c, 0), max(map(utf16_length, value.split("\n"))))
                cells.append(_cell(value, f"{column_name(c)}{r}"))
        if cells:
            body.append(f'<row r="{r}">{"".join(cells)}</row>')
    columns = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{min(60, max(8.43, widths.get(c, 0) * 1.15 + 2)):.2f}" customWidth="1"/>' for c in range(max(widths, default=-1) + 1))
    return ooxml.part("worksheet", "http://schemas.openxmlformats.org/spreadsheetml/2006/main", (f"<cols>{columns}</cols>" if columns else "") + f"<sheetData>{''.join(body)}</sheetData>")


def write(sheets: list[tuple[str | None, list[list[str]]]], title: str, stamp: str) -> bytes:
    """A workbook; numbers become numeric cells, texts with line ends wrap."""
    sheets = sheets or [("Sheet1", [])]
    names = sheet_names([n for n, _ in sheets])
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    entries = "".join(f'<sheet name="{escape_xml(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    styles = ('<fonts count="1"><font><sz val="11"/><name val="Calibri"/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
              '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf numFmtId="0" xfId="0"/><xf numFmtId="3" xfId="0" applyNumberFormat="1"/>'
              '<xf numFmtId="4" xfId="0" applyNumberFormat="1"/><xf numFmtId="0" xfId="0" applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf></cellXfs>')
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    overrides = {"/xl/workbook.xml": kind + "sheet.main+xml", "/xl/styles.xml": kind + "styles+xml"} | {f"/xl/worksheets/sheet{i}.xml": kind + "worksheet+xml" for i in range(1, len(names) + 1)}
    rels = [("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(names) + 1)] + [("styles", "styles.xml")]
    return zipio.create([
        *ooxml.package("xl/workbook.xml", overrides, title, stamp),
        ("xl/workbook.xml", ooxml.part("workbook", space, f"<sheets>{entries}</sheets>")),
        ("xl/_rels/workbook.xml.rels", ooxml.relationships(rels)),
        ("xl/styles.xml", ooxml.part("styleSheet", space, styles)),
        *((f"xl/worksheets/sheet{i}.xml", _worksheet(rows)) for i, (_, rows) in enumerate(sheets, 1))])
