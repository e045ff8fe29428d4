"""Content streams to runs of glyphs in page coordinates with the origin at the top left."""

from __future__ import annotations

import math
import re
from functools import lru_cache
from typing import Any

from .. import limits
from . import fonts
from .objects import Document, Lexer, Op, Stream

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1, 0, 0, 1, 0, 0)
# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def times(a: Matrix, b: Matrix) -> Matrix:
    """a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
            a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def geometry(doc: Document, page: dict) -> tuple[float, float, Matrix]:
    """Width, height, and the matrix from user space to the displayed page."""
    box = None
    for key in ("CropBox", "MediaBox"):
        value = doc.get(page.get(key))
        value = [doc.get(v) for v in value] if isinstance(value, list) else []
        if len(value) == 4 and all(isinstance(v, (int, float)) for v in value) and value[0] != value[2] and value[1] != value[3]:
            box = value
            break
    x0, x1 = sorted((box or [0, 0, 612, 792])[0::2])
    y0, y1 = sorted((box or [0, 0, 612, 792])[1::2])
    w, h = x1 - x0, y1 - y0
    turn = doc.get(page.get("Rotate"))
    turn = int(turn) % 360 if isinstance(turn, (int, float)) else 0
    if turn == 90:
        return h, w, (0, 1, 1, 0, -y0, -x0)
    if turn == 180:
        return w, h, (-1, 0, 0, 1, x1, -y0)
    if turn == 270:
        return h, w, (0, -1, -1, 0, y1, x1)
    return w, h, (1, 0, 0, -1, -x0, y1)


@lru_cache(maxsize=65536)
def clean(text: str) -> str:
    text = "".join(LIGATURES.get(c, c) for c in text)
    return re.sub("[\x00-\x1f\x7f-\x9f]", "", re.sub("[\t ]", " ", text))


class Page:
    def __init__(self, doc: Document, page: dict, cache: dict):
        self.doc, self.cache, self.unmapped = doc, cache, 0
        self.width, self.height, base = geometry(doc, page)
        self.runs: list[dict] = []
        self.open: dict | None = None  # the run that the next glyph may go on
        contents = doc.get(page.get("Contents"))
        parts = [doc.get(c) for c in contents] if isinstance(contents, list) else [contents]
        data = b"\n".join(doc.decoded(s) for s in parts if isinstance(s, Stream))
        self._run(data, doc.get(page.get("Resources")), base, 0)

    def _run(self, data: bytes, resources: Any, ctm: Matrix, depth: int) -> None:
        lexer, stack = Lexer(data, content=True), []
        font, size, saved = None, 0.0, []
        tm = lm = IDENTITY
        gs = {"char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0}
        num = lambda k, default=0.0: stack[k] if -len(stack) <= k < len(stack) and isinstance(stack[k], (int, float)) else default

        def move(x: float, y: float) -> None:
            nonlocal tm, lm
            lm = times((1, 0, 0, 1, x, y), lm)
            tm = lm

        def show(text: bytes) -> None:
            nonlocal tm
            if font is None:
                return
            scale, char, word, rise = gs["scale"], gs["char"], gs["word"], gs["rise"]
            t0, t1, t2, t3, t4, t5 = tm
            # only the place changes from glyph to glyph
            to = times(tm, ctm)
            m = times((size * scale, 0, 0, size, 0, rise), to)
            up, along = rise * to[2], rise * to[3]
            high, wide = math.hypot(m[2], m[3]), math.hypot(m[0], m[1])
            for chars, width, space in font.glyphs(text):
                if chars is None:
                    self.unmapped += 1
                elif (shown := clean(chars)) and high and wide:
                    x, y = up + (t4 * ctm[0] + t5 * ctm[2] + ctm[4]), along + (t4 * ctm[1] + t5 * ctm[3] + ctm[5])
                    self._glyph(shown, x, y, x + m[0] * width, y + m[1] * width, m[0] / wide, m[1] / wide, high, font)
                advance = (width * size + char + (word if space else 0)) * scale
                t4, t5 = advance * t0 + t4, advance * t1 + t5
            tm = (t0, t1, t2, t3, t4, t5)

        while True:
            x = lexer.next()
            if not isinstance(x, Op):
                if len(stack) >= limits.OPERANDS:
                    stack.pop(0)
                stack.append(x)
                continue
            if x == "":
                break
            if x == "BT":
                tm = lm = IDENTITY
            elif x == "Tf" and len(stack) >= 2:
                font, size = fonts.load(self.doc, resources, str(stack[-2]), self.cache), num(-1)
            elif x == "Td":
                move(num(-2), num(-1))
            elif x == "TD":
                gs["lead"] = -num(-1)
                move(num(-2), num(-1))
            elif x == "Tm" and len(stack) >= 6:
                tm = lm = tuple(num(k) for k in range(-6, 0))
            elif x == "T*":
                move(0, -gs["lead"])
            elif x in ("Tj", "'", '"'):
                if x != "Tj":
                    if x == '"':
                        gs["word"], gs["char"] = num(-3), num(-2)
                    move(0, -gs["lead"])
                if stack and isinstance(stack[-1], bytes):
                    show(stack[-1])
            elif x == "TJ" and stack and isinstance(stack[-1], list):
                for part in stack[-1]:
                    if isinstance(part, bytes):
                        show(part)
                    elif isinstance(part, (int, float)):
                        tm = times((1, 0, 0, 1, -part / 1000 * size * gs["scale"], 0), tm)
            elif x in ("Tc", "Tw", "TL", "Ts"):
                gs[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise"}[x]] = num(-1)
            elif x == "Tz":
                gs["scale"] = num(-1, 100) / 100
            elif x == "cm" and len(stack) >= 6:
                ctm = times(tuple(num(k) for k in range(-6, 0)), ctm)
            elif x == "q":
                saved.append((ctm, dict(gs), font, size))
            elif x == "Q" and saved:
                ctm, gs, font, size = saved.pop()
            elif x == "Do" and stack and depth < limits.FORM_DEPTH:
                self._form(resources, str(stack[-1]), ctm, depth)
            elif x == "BI":
                self._skip_image(lexer)
            stack = []

    def _form(self, resources: Any, name: str, ctm: Matrix, depth: int) -> None:
        known = self.doc.get(resources.get("XObject")) if isinstance(resources, dict) else None
        form = self.doc.get(known.get(name)) if isinstance(known, dict) else None
        if not isinstance(form, Stream) or self.doc.get(form.dict.get("Subtype")) != "Form":
            return
        m = self.doc.get(form.dict.get("Matrix"))
        m = tuple(v for v in map(self.doc.get, m) if isinstance(v, (int, float))) if isinstance(m, list) else IDENTITY
        own = self.doc.get(form.dict.get("Resources"))
        self._run(self.doc.decoded(form), own if isinstance(own, dict) else resources, times(m, ctm) if len(m) == 6 else ctm, depth + 1)

    @staticmethod
    def _skip_image(lexer: Lexer) -> None:
        found = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r /\[<(]|$)").search(lexer.data, lexer.at)
        lexer.at = found.end() if found else len(lexer.data)

    def _glyph(self, text: str, sx: float, sy: float, ex: float, ey: float, ux: float, uy: float, size: float, font: fonts.Font) -> None:
        """Append a glyph to the last run if it goes on in the same style, line and direction."""
        last, blank = self.open, not text.strip()
        if last and abs(last["size"] - size) <= 0.03 * max(size, last["size"]) and last["bold"] == font.bold and abs(last["ux"] - ux) <= 0.02 and abs(last["uy"] - uy) <= 0.02:
            dx, dy = sx - last["ex"], sy - last["ey"]
            along, across = dx * ux + dy * uy, abs(dx * uy - dy * ux)
            if across < 0.2 * size and -0.6 * size < along < 0.55 * size:
                after_space = last["text"].endswith(" ")
                if not (after_space and text == " "):  # spaces do not add up
                    last["text"] += (" " if along > 0.17 * size and not after_space and text != " " else "") + text
                last["ex"], last["ey"] = ex, ey
                return
        self.open = None  # a blank glyph ends a run and opens none
        if not blank:
            self.open = {"text": text, "sx": sx, "sy": sy, "ex": ex, "ey": ey, "ux": ux, "uy": uy, "size": size, "bold": font.bold, "italic": font.italic}
            self.runs.append(self.open)


def read_runs(data: bytes) -> tuple[list[dict], int, str]:
    """Pages {width, height, runs}, the number of unmapped glyphs, and the title.  A page that
    cannot be read is an empty page of the usual size."""
    doc = Document(data)
    pages, unmapped, cache = [], 0, {}
    for d in doc.pages():
        try:
            page = Page(doc, d, cache)
            pages.append({"width": page.width, "height": page.height, "runs": page.runs})
            unmapped += page.unmapped
        except Exception:  # a damaged page must not lose the others
            pages.append({"width": 612.0, "height": 792.0, "runs": []})
    return pages, unmapped, doc.title()
