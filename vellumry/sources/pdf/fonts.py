"""Fonts of a PDF: codes to characters and widths."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import Any

from ...functions.text import char_width
from .objects import Document, Lexer, Name, Op, Stream

# Glyph names that are not built from a Unicode name.
GLYPHS = {"space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&",
          "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-",
          "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
          "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">",
          "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^",
          "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
          "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§",
          "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®",
          "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·",
          "cedilla": "¸", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "ordmasculine": "º",
          "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿",
          "multiply": "×", "divide": "÷", "germandbls": "ß", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø",
          "oslash": "ø", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı",
          "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "endash": "–", "emdash": "—", "bullet": "•",
          "ellipsis": "…", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”",
          "quotesinglbase": "‚", "quotedblbase": "„", "guilsinglleft": "‹", "guilsinglright": "›", "dagger": "†",
          "daggerdbl": "‡", "perthousand": "‰", "florin": "ƒ", "Euro": "€", "trademark": "™", "minus": "−", "fraction": "⁄",
          "circumflex": "ˆ", "tilde": "˜", "breve": "˘", "dotaccent": "˙", "ring": "˚", "hungarumlaut": "˝", "ogonek": "˛",
          "caron": "ˇ", "nbspace": " ", "sfthyphen": "­"}
# Codes of the standard encoding that differ from ASCII.
STANDARD = {0x27: "’", 0x60: "‘", 0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤", 0xA9: "'",
            0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "fi", 0xAF: "fl", 0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·",
            0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿", 0xC1: "`",
            0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯", 0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝",
            0xCE: "˛", 0xCF: "ˇ", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ",
            0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß"}
ACCENTS = {"GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CARON": "caron",
           "CEDILLA": "cedilla", "OGONEK": "ogonek", "MACRON": "macron", "BREVE": "breve", "DOT ABOVE": "dotaccent", "DOUBLE ACUTE": "hungarumlaut"}


@lru_cache(maxsize=1)
def _accented() -> dict[str, str]:
    """Names of accented Latin letters, by rule from their Unicode names; Greek letters too."""
    out = {}
    for code in [*range(0xC0, 0x180), *range(0x1E0, 0x220)]:
        m = re.fullmatch(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z]) WITH (.+)", unicodedata.name(chr(code), ""))
        if m and m[3] in ACCENTS:
            out[(m[2].lower() if m[1] == "SMALL" else m[2]) + ACCENTS[m[3]]] = chr(code)
    for code in range(0x391, 0x3CA):
        m = re.fullmatch(r"GREEK (SMALL|CAPITAL) LETTER ([A-Z]+)", unicodedata.name(chr(code), ""))
        if m:
            out.setdefault(m[2].lower() if m[1] == "SMALL" else m[2].capitalize(), chr(code))
    return out


def glyph_text(name: str) -> str | None:
    """Characters of a glyph name: by list, by rule, uniXXXX, uXXXXX, parts joined by _, before a dot."""
    name = name.split(".", 1)[0] if not name.startswith(".") else ""
    if not name:
        return None
    if len(name) == 1 and name.isalpha():
        return name
    if name in GLYPHS:
        return GLYPHS[name]
    if name in _accented():
        return _accented()[name]
    if re.fullmatch("uni(?:[0-9A-Fa-f]{4})+", name):
        return "".join(chr(int(name[i:i + 4], 16)) for i in range(3, len(name), 4))
    if re.fullmatch("u[0-9A-Fa-f]{4,6}", name) and int(name[1:], 16) <= 0x10FFFF:
        return chr(int(name[1:], 16))
    if "_" in name:
        parts = [glyph_text(p) for p in name.split("_")]
        return "".join(parts) if all(p is not None for p in parts) else None
    return None


class CMap:
    """Code spaces, and codes to text, one by one or by range."""

    def __init__(self):
        self.spaces: list[tuple[int, int, int]] = []  # bytes, low, high
        self.single: dict[int, str] = {}
        self.ranges: list[tuple[int, int, str]] = []

    @classmethod
    def parse(cls, data: bytes) -> CMap:
        out, lexer, stack = cls(), Lexer(data, content=True), []
        while (x := lexer.next()) != "" or not isinstance(x, Op):
            if not isinstance(x, Op):
                stack.append(x)
                continue
            if x == "endcodespacerange":
                pairs = [s for s in stack if isinstance(s, bytes)]
                out.spaces += [(len(a), int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in zip(pairs[::2], pairs[1::2])]
            elif x in ("endbfchar", "endcidchar"):
                for a, b in zip(stack[::2], stack[1::2]):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        out.single[int.from_bytes(a, "big")] = _utf16(b)
            elif x == "endbfrange":
                out._range(stack)
            stack = []
        return out

    def _range(self, stack: list) -> None:
        for low, high, to in zip(stack[::3], stack[1::3], stack[2::3]):
            if not isinstance(low, bytes) or not isinstance(high, bytes):
                continue
            a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
            if isinstance(to, list):
                self.single |= {a + i: _utf16(t) for i, t in enumerate(to[:b - a + 1]) if isinstance(t, bytes)}
            elif isinstance(to, bytes) and to:
                if b - a >= 512:
                    self.ranges.append((a, b, _utf16(to)))
                else:
                    self.single |= {a + i: _plus(_utf16(to), i) for i in range(b - a + 1)}

    def get(self, code: int) -> str | None:
        if code in self.single:
            return self.single[code]
        return next((_plus(t, code - a) for a, b, t in self.ranges if a <= code <= b), None)

    def split(self, data: bytes) -> list[tuple[int, int]]:
        """(code, bytes) by the code spaces, two bytes where none fits."""
        out, at = [], 0
        while at < len(data):
            for n in range(1, 5):
                code = int.from_bytes(data[at:at + n], "big")
                if at + n <= len(data) and any(s == n and a <= code <= b for s, a, b in self.spaces):
                    break
            else:
                n = 2 if not self.spaces else min(s for s, _, _ in self.spaces)
                code = int.from_bytes(data[at:at + n], "big")
            out.append((code, n))
            at += n
        return out


def _utf16(b: bytes) -> str:
    return b.decode("utf-16-be", "ignore") if len(b) > 1 else b.decode("latin-1")


def _plus(text: str, n: int) -> str:
    return text[:-1] + chr(min(ord(text[-1]) + n, 0x10FFFF)) if text else ""


class Font:
    def __init__(self, doc: Document, d: dict):
        self.singles: dict[int, tuple[str | None, float, bool]] = {}
        get = doc.get
        base = str(get(d.get("BaseFont")) or "")
        self.composite = get(d.get("Subtype")) == "Type0"
        inner = d
        if self.composite:
            kids = get(d.get("DescendantFonts"))
            inner = get(kids[0]) if isinstance(kids, list) and kids else {}
            inner = inner if isinstance(inner, dict) else {}
        face = get(inner.get("FontDescriptor"))
        face = face if isinstance(face, dict) else {}
        flags = get(face.get("Flags")) or 0
        name = re.sub("^[A-Z]{6}\\+", "", base).lower()
        self.bold = bool(re.search("bold|black|heavy|semibold|demi", name)) or bool(flags & 0x40000)
        self.italic = bool(re.search("italic|oblique", name)) or bool(flags & 0x40)
        to = get(d.get("ToUnicode"))
        self.to_unicode = CMap.parse(doc.decoded(to)) if isinstance(to, Stream) else None
        self.type3 = get(d.get("Subtype")) == "Type3"
        matrix = get(d.get("FontMatrix"))
        self.scale = float(matrix[0]) if self.type3 and isinstance(matrix, list) and matrix else 0.001
        if self.composite:
            self._composite(doc, d, inner)
        else:
            self._simple(doc, d, face)

    def _simple(self, doc: Document, d: dict, face: dict) -> None:
        get = doc.get
        encoding = get(d.get("Encoding"))
        base = get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(str(base))
        self.codes: dict[int, str | None] = {}
        for code in range(32, 256):
            if codec:
                self.codes[code] = bytes([code]).decode(codec, "ignore") or None
            elif code < 127:
                self.codes[code] = STANDARD.get(code, chr(code))
            else:
                self.codes[code] = STANDARD.get(code)
        if isinstance(encoding, dict):
            code = 0
            for x in get(encoding.get("Differences")) or ():
                x = get(x)
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    self.codes[code] = glyph_text(x)
                    code += 1
        first = get(d.get("FirstChar")) or 0
        widths = get(d.get("Widths"))
        self.widths = {first + i: float(w) for i, w in enumerate(map(get, widths)) if isinstance(w, (int, float))} if isinstance(widths, list) else {}
        missing = get(face.get("MissingWidth"))
        self.missing = float(missing) if isinstance(missing, (int, float)) else None

    def _composite(self, doc: Document, d: dict, inner: dict) -> None:
        get = doc.get
        encoding = get(d.get("Encoding"))
        self.cmap = CMap.parse(doc.decoded(encoding)) if isinstance(encoding, Stream) else None
        label = str(encoding) if isinstance(encoding, Name) else ""
        self.unicode_codes = bool(re.match("Uni.*-(UCS2|UTF16)", label))
        default = get(inner.get("DW"))
        self.missing = float(default) if isinstance(default, (int, float)) else 1000.0
        self.widths: dict[int, float] = {}
        items = [get(x) for x in get(inner.get("W")) or ()]
        at = 0
        while at + 1 < len(items):
            first, second = items[at], items[at + 1]
            if isinstance(second, list):
                self.widths |= {first + i: float(w) for i, w in enumerate(map(get, second)) if isinstance(w, (int, float))}
                at += 2
            elif at + 2 < len(items):
                if isinstance(items[at + 2], (int, float)) and isinstance(first, int) and isinstance(second, int) and second - first < 65536:
                    self.widths |= dict.fromkeys(range(first, second + 1), float(items[at + 2]))
                at += 3
            else:
                break

    def glyphs(self, data: bytes) -> list[tuple[str | None, float, bool]]:
        """(text or None, width in text space at size 1, whether it is a one-byte space)."""
        if self.composite:
            if self.unicode_codes:
                pairs = [(int.from_bytes(data[i:i + 2], "big"), 2) for i in range(0, len(data), 2)]
            else:
                pairs = (self.cmap or self.to_unicode or CMap()).split(data) if self.cmap and self.cmap.spaces else [(int.from_bytes(data[i:i + 2], "big"), 2) for i in range(0, len(data), 2)]
            out, high = [], None
            for code, n in pairs:
                text = self.to_unicode.get(code) if self.to_unicode else None
                if text is None and self.unicode_codes:
                    if 0xD800 <= code < 0xDC00:
                        high = code
                        continue
                    text = (chr(0x10000 + (high - 0xD800 << 10) + code - 0xDC00) if high and 0xDC00 <= code < 0xE000 else chr(code)) if not 0xD800 <= code < 0xDC00 else None
                    high = None
                out.append((text, self.widths.get(code, self.missing) * 0.001, n == 1 and code == 32))
            return out
        return [self._single(code) for code in data]

    def _single(self, code: int) -> tuple[str | None, float, bool]:
        """The glyph of a one-byte code, remembered."""
        if (known := self.singles.get(code)) is not None:
            return known
        text = self.to_unicode.get(code) if self.to_unicode else None
        text = self.codes.get(code) if text is None else text
        width = self.widths.get(code)
        if width is None:
            width = self.missing if self.missing is not None else char_width(text[0]) if text else 500.0
        self.singles[code] = text, width * self.scale, code == 32
        return self.singles[code]


def load(doc: Document, resources: Any, name: str, cache: dict) -> Font | None:
    fonts = doc.get(resources.get("Font")) if isinstance(resources, dict) else None
    ref = fonts.get(name) if isinstance(fonts, dict) else None
    d = doc.get(ref)
    if not isinstance(d, dict):
        return None
    if id(d) not in cache:
        cache[id(d)] = Font(doc, d)
    return cache[id(d)]
