"""CSV in two dialects: the tolerant reader with a detected delimiter, and the line-based one."""

from __future__ import annotations

import re

_SPECIAL: dict[str, re.Pattern] = {}


def detect_delimiter(text: str) -> str:
    """The most frequent of comma, semicolon and tab in the first line, quotes not minded."""
    first = re.split(r"[\r\n]", text, maxsplit=1)[0]
    return max(",;\t", key=first.count)  # the first of equals


def parse(text: str, delimiter: str | None = None) -> list[list[str]]:
    """Rows of fields.  A quote opens a quoted field only where the field is empty; two quotes in it
    are one; text after the closing quote is appended; CR, LF and CRLF end rows outside quotes."""
    sep = delimiter or detect_delimiter(text)
    special = _SPECIAL.setdefault(sep, re.compile(f'[{re.escape(sep)}"\r\n]'))
    rows, row, field, at, n = [], [], "", 0, len(text)
    while at < n:
        m = special.search(text, at)
        stop = m.start() if m else n
        field += text[at:stop]
        if not m:
            at = n
            break
        char, at = m.group(), stop + 1
        if char == sep:
            row.append(field)
            field = ""
        elif char == '"':
            if field:
                field += '"'
                continue
            while True:  # the quoted part, to its closing quote or the end of the text
                close = text.find('"', at)
                if close < 0:
                    field, at = field + text[at:], n
                    break
                field, at = field + text[at:close], close + 1
                if text[at:at + 1] != '"':
                    break
                field, at = field + '"', at + 1
        else:
            if char == "\r" and text[at:at + 1] == "\n":
                at += 1
            rows.append([*row, field])
            row, field = [], ""
    if field or row:
        rows.append([*row, field])
    return rows


def parse_simple(text: str) -> list[list[str]]:
    """Rows of the trimmed text by line, then by comma; a quote turns quoting on and off anywhere."""
    from ..functions.text import trim

    return [_simple_line(line) for line in re.split("\r?\n", trim(text))]


def _simple_line(line: str) -> list[str]:
    out, field, quoted, at = [], "", False, 0
    while at < len(line):
        c = line[at]
        if c == '"' and quoted and line[at + 1:at + 2] == '"':
            field, at = field + '"', at + 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out.append(field)
            field = ""
        else:
            field += c
        at += 1
    return [*out, field]
