"""Scalar text rules in Python, for readers and writers that work on one document at a time."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

#: The white space that a trim removes: Unicode spaces, line ends and the byte order mark.
SPACE_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Other names of formats.
FORMAT_ALIASES = {"jpg": "jpeg", "htm": "html", "text": "txt", "xlsm": "xlsx", "docm": "docx", "pptm": "pptx"}

# MIME types by format.
MIME_TYPES = {
    "txt": "text/plain", "html": "text/html", "csv": "text/csv", "json": "application/json", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "png": "image/png", "jpeg": "image/jpeg", "webp": "image/webp",
}


def trim(text: str) -> str:
    return text.strip(SPACE_CHARS)


def trim_end(text: str) -> str:
    return text.rstrip(SPACE_CHARS)


def normalize_format(name: str | None) -> str:
    """Lower case, without one leading dot, aliases resolved."""
    low = (name or "").lower().removeprefix(".")
    return FORMAT_ALIASES.get(low, low)


def stem(name: str | None) -> str:
    """File name without folders and last extension, with characters that files may not have
    replaced; `converted` if nothing is left."""
    base = (name or "").replace("\\", "/").rsplit("/", 1)[-1]
    dot = base.rfind(".")
    base = base[:dot] if dot > 0 else base
    return trim(re.sub(r'[\x00-\x1f<>:"/|?*\\]', "_", base)) or "converted"


def decode_text(data: bytes) -> str:
    """UTF-16 with a mark, else UTF-8 without its mark, else Latin-1 if UTF-8 does not fit."""
    if data[:2] == b"\xff\xfe":
        return data[2:].decode("utf-16-le", "replace")
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    text = data.decode("utf-8", "replace")
    return data.decode("latin-1") if "\ufffd" in text else text.removeprefix("\ufeff")


def utf16_length(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "\uffff" for c in text)


def js_number(value: float) -> str:
    """A double as text with the fewest digits that tell it apart, integers without a fraction."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    if value == 0:
        return "0"
    sign, digits, exponent = _decimal(repr(abs(value)))
    sign = "-" if value < 0 else sign
    n = exponent + len(digits)  # position of the decimal point after the first digit
    if 0 < n <= 21:
        return sign + (digits + "0" * (n - len(digits)) if n >= len(digits) else f"{digits[:n]}.{digits[n:]}")
    if -6 < n <= 0:
        return f"{sign}0.{'0' * -n}{digits}"
    mantissa = digits[0] + (f".{digits[1:]}" if len(digits) > 1 else "")
    return f"{sign}{mantissa}e{'+' if n > 0 else '-'}{abs(n - 1)}"


def _decimal(text: str) -> tuple[str, str, int]:
    """Digits and exponent, so that the value is digits * 10 ** exponent."""
    mantissa, _, power = text.partition("e")
    whole, _, part = mantissa.partition(".")
    digits, exponent = (whole + part).lstrip("0"), int(power or 0) - len(part)
    short = digits.rstrip("0")
    return "", short or "0", exponent + len(digits) - len(short)


def significant(value: float, digits: int = 15) -> str:
    """A number as text after rounding to so many significant digits."""
    return js_number(float(f"{value:.{digits}g}"))


def short_number(value: float) -> str:
    """At most two decimals, without trailing zeros."""
    text = f"{math.floor(abs(value) * 100 + 0.5) / 100:.2f}".rstrip("0").rstrip(".")
    return "-" + text if value < 0 and text != "0" else text


def round_half_up(value: float) -> int:
    return math.floor(value + 0.5)


def csv_escape(value: str | None) -> str:
    text = value or ""
    return '"' + text.replace('"', '""') + '"' if re.search(r'[",\n\r]', text) else text


def rows_to_csv(rows: list[list[str]]) -> str:
    return "".join(",".join(map(csv_escape, r)) + "\r\n" for r in rows) or "\r\n"


def header_names(header: list[str]) -> list[str]:
    """Trimmed names; blank ones are numbered columns, repeated ones get a number."""
    seen: dict[str, int] = {}
    out = []
    for n, cell in enumerate(header, 1):
        name = trim(cell or "") or f"column{n}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def rows_to_records(rows: list[list[str]]) -> list[dict[str, str]]:
    """Records keyed by the header.  As in JavaScript objects, names that are array indexes come
    first in ascending order, and a later column wins a name that occurs twice."""
    if not rows:
        return []
    names = header_names(rows[0])
    order = object_order(names)
    out = []
    for row in rows[1:]:
        record = {name: (row[i] if i < len(row) else "") or "" for i, name in enumerate(names)}
        out.append({name: record[name] for name in order})
    return out


def object_order(names) -> list[str]:
    """Distinct names in the order that JavaScript objects list them."""
    distinct = list(dict.fromkeys(names))
    return sorted(filter(_is_index, distinct), key=int) + [n for n in distinct if not _is_index(n)]


def _is_index(name: str) -> bool:
    return bool(re.fullmatch(r"0|[1-9]\d{0,9}", name)) and int(name) < 2 ** 32 - 1


_INVALID_XML = re.compile("[^\t\n\r\u0020-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def escape_xml(value: str | None) -> str:
    """Without characters that XML cannot hold; apostrophes stay."""
    text = _INVALID_XML.sub("", value or "")
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def escape_html(value: str | None) -> str:
    text = (value or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;").replace("'", "&#39;")


# Ranges of characters that are set without spaces and as wide as the type size.
CJK_RANGES = ((0x2E80, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x3FFFF))


def is_cjk(char: str) -> bool:
    code = ord(char)
    return code >= 0x2E80 and any(a <= code <= b for a, b in CJK_RANGES)


# Advance widths of Helvetica for the codes 32 to 126, in thousandths of the size.
HELVETICA = [int(w) for w in """278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278
556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556
1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778
667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556
333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556
556 556 333 500 278 556 500 722 500 500 500 334 260 334 584""".split()]


@lru_cache(maxsize=65536)
def char_width(char: str) -> int:
    """Width in thousandths of the type size."""
    code = ord(char)
    if 32 <= code <= 126:
        return HELVETICA[code - 32]
    if is_cjk(char):
        return 1000
    if 0xC0 <= code <= 0x24F:  # accented Latin letters are as wide as their base
        base = ord(unicodedata.normalize("NFD", char)[0])
        if 32 <= base <= 126:
            return HELVETICA[base - 32]
    return 556


def text_width(text: str, size: float) -> float:
    return sum(map(char_width, text)) * size / 1000


@lru_cache(maxsize=65536)
def win_ansi(char: str) -> int:
    """The code of a character in Windows-1252, of its plain form, or of a question mark."""
    for form in (char, unicodedata.normalize("NFKD", char)[:1]):
        try:
            return form.encode("cp1252")[0]
        except (UnicodeEncodeError, IndexError):
            continue
    return 0x3F


def wrap_text(text: str, size: float, width: float) -> list[str]:
    """Greedy lines of at most `width`.  Words break at spaces, between CJK characters anywhere,
    and inside only if a word alone is too wide.  A tab counts as four spaces."""
    out = []
    for paragraph in text.replace("\t", "    ").split("\n"):
        line, used = "", 0.0
        for unit in _units(paragraph):
            w = text_width(unit, size)
            if used + w <= width:
                line, used = line + unit, used + w
                continue
            if unit.strip(" ") == "":
                if line:
                    out.append(trim_end(line))
                line, used = "", 0.0
                continue
            if line.strip(" "):
                out.append(trim_end(line))
                line, used = "", 0.0
            for char in unit:
                cw = text_width(char, size)
                if line and used + cw > width:
                    out.append(line)
                    line, used = "", 0.0
                line, used = line + char, used + cw
        out.append(trim_end(line))
    return out


def _units(text: str) -> list[str]:
    """Runs of spaces, words, and single CJK characters."""
    out = []
    for part in re.findall(r" +|[^ ]+", text):
        if part.isascii():
            out.append(part)
            continue
        word = ""
        for c in part if part[0] != " " else [part]:
            if len(c) == 1 and c != " " and is_cjk(c):
                out += [word, c] if word else [c]
                word = ""
            else:
                word += c
        if word:
            out.append(word)
    return out


def column_name(index: int) -> str:
    """Letters of a 0-based column."""
    out, n = "", index + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_index(letters: str) -> int:
    """0-based column of letters."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def roman(n: int) -> str:
    # Roman numerals.
    out = ""
    for value, mark in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += mark * (n // value)
        n %= value
    return out


def letters(n: int) -> str:
    """a to z, then aa, ab, as list labels."""
    return column_name(n - 1).lower()


def human_size(size: int) -> str:
    """Bytes, or the largest fitting unit with two decimals below ten and one from ten."""
    if size < 1024:
        return f"{size} B"
    value, units = size / 1024, ["KB", "MB", "GB"]
    while value >= 1024 and len(units) > 1:
        value /= 1024
        units.pop(0)
    return f"{value:.{1 if value >= 10 else 2}f} {units[0]}"
