"""Text rules as Column expressions, so that they stay inside the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FORMAT_ALIASES, MIME_TYPES

#: Unicode white space as a regular-expression class; Spark's trim and \s know fewer characters.
SPACE = "[\\t-\\r\\u0020\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def mapped(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def normalize_format(name: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "^\\.", "")
    return F.coalesce(mapped(FORMAT_ALIASES, low), low)


def mime_type(name: Column) -> Column:
    return mapped(MIME_TYPES, name)


def stem(name: Column) -> Column:
    base = F.regexp_extract(F.translate(F.coalesce(name, F.lit("")), "\\", "/"), "[^/]*$", 0)
    cut = F.regexp_replace(base, "^(.+)\\.[^.]*$", "$1")
    safe = trim(F.regexp_replace(cut, '[\\x00-\\x1f<>:"/|?*\\\\]', "_"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("converted"))


def decode_text(data: Column) -> Column:
    """UTF-16 with a mark, else UTF-8 without its mark, else Latin-1."""
    mark = F.hex(F.substring(data, 1, 2))
    plain = data.cast("string")
    utf8 = F.when(F.hex(F.substring(data, 1, 3)) == "EFBBBF", F.substring(plain, 2, 2 ** 31 - 1)).otherwise(plain)
    sound = F.is_valid_utf8(plain) & ~F.contains(plain, F.lit("�"))
    rest = F.substring(data, 3, 2 ** 31 - 1)
    return (F.when(mark == "FFFE", F.decode(rest, "UTF-16LE")).when(mark == "FEFF", F.decode(rest, "UTF-16BE"))
            .when(sound, utf8).otherwise(F.decode(data, "ISO-8859-1")))


def sniff_magic(data: Column, declared: Column) -> Column:
    """pdf, ole, zip or the declared format, by the first bytes; a zip's parts tell more."""
    head = F.substring(data, 1, 1024)
    return (F.when(F.contains(head, F.lit(b"%PDF-")), F.lit("pdf"))
            .when(F.hex(F.substring(data, 1, 4)) == "D0CF11E0", F.lit("ole"))
            .when(F.hex(F.substring(data, 1, 2)) == "504B", F.lit("zip")).otherwise(declared))


def csv_escape(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_row(values: Column) -> Column:
    return F.array_join(F.transform(values, csv_escape), ",")


def csv_delimiter(line: Column) -> Column:
    """The most frequent of comma, semicolon and tab, earlier ones first, comma if there is none."""
    count = {d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in (",", ";", "\t")}
    most = F.greatest(*count.values())
    return F.when((count[","] == most) | (most == 0), F.lit(",")).when(count[";"] == most, F.lit(";")).otherwise(F.lit("\t"))


def escape_xml(value: Column) -> Column:
    text = F.regexp_replace(F.coalesce(value, F.lit("")), "[^\\t\\n\\r\\x20-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]", "")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def escape_html(value: Column) -> Column:
    text = F.coalesce(value, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def column_name(index: Column) -> Column:
    """Letters of a 0-based column below 18,278 (three letters)."""
    n = index.cast("int")
    last = F.char(65 + n % 26)
    return F.when(n < 26, last).when(n < 702, F.concat(F.char(65 + F.floor((n - 26) / 26).cast("int")), last)).otherwise(
        F.concat(F.char(65 + F.floor((n - 702) / 676).cast("int")), F.char(65 + F.floor((n - 702) / 26).cast("int") % 26), last))


def serial_text(serial: Column, time_only: Column, epoch_1904: bool = False) -> Column:
    """A spreadsheet date serial as ISO text."""
    seconds = F.floor((serial + (1462 if epoch_1904 else 0) - 25569) * 86400 + 0.5)
    at = F.timestamp_seconds(seconds)
    return (F.when(time_only & (serial < 1), F.date_format(at, "HH:mm:ss"))
            .when(serial == F.floor(serial), F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss")))


def heading_level(size: Column, body: Column) -> Column:
    """1 to 3 by size against the body size; null for body text."""
    ratio = size / body
    return F.when(ratio >= 1.7, 1).when(ratio >= 1.35, 2).when(ratio >= 1.15, 3)


# What a spreadsheet writer stores as a number, plain or with grouped thousands.
PLAIN_NUMBER = "^-?(0|[1-9][0-9]{0,14})(\\.[0-9]{1,10})?$"
GROUPED_NUMBER = "^-?[0-9]{1,3}(,[0-9]{3})+(\\.[0-9]{1,10})?$"


def cell_kind(text: Column) -> Column:
    """How a spreadsheet writer types a cell: empty, number, grouped, wrapped or text."""
    short = F.length(F.regexp_replace(text, "[^0-9]", "")) <= 15
    return (F.when(text == "", F.lit("empty")).when(text.rlike(PLAIN_NUMBER) & short, F.lit("number"))
            .when(text.rlike(GROUPED_NUMBER) & short, F.lit("grouped"))
            .when(F.contains(text, F.lit("\n")), F.lit("wrapped")).otherwise(F.lit("text")))
