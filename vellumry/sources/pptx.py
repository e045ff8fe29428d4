"""PowerPoint presentations: reader to slides, and writers for positioned and flowing text."""

from __future__ import annotations

from itertools import groupby

from ..functions.text import escape_xml, utf16_length
from ..operators import model
from . import ooxml, xmlio, zipio
from .xmlio import Element
from .zipio import PackageError

EMU = 12700  # per point
SLIDE = (960.0, 540.0)
DROPPED = frozenset(("sldNum", "dt", "ftr", "hdr"))
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
SPACE = "http://schemas.openxmlformats.org/presentationml/2006/main"
#: Slides take so many lines of so many characters, and tables so many rows.
BUDGET_LINES, LINE_CHARS, TABLE_ROWS = 12, 80, 12
MOST_POINTS = 56 * 72
#: Places and sizes on flowing slides, and of boxes at the place of an item, in points and in em.
MARGIN, TITLE_TOP, TITLE_HEIGHT, BODY_TOP, ROW_HEIGHT = 36.0, 24.0, 72.0, 108.0, 29.2
TITLE_SIZE, BODY_SIZE = 28.0, 18.0
PAGE = (612.0, 792.0)
RISE, BOX_HEIGHT = 0.93, 1.25


def _number(node: Element | None, key: str, default: float) -> float:
    try:
        return float(node.attrs[key]) if node is not None else default
    except (KeyError, ValueError):
        return default


def paragraph_text(p: Element) -> str:
    level = int(_number(p.child("pPr"), "lvl", 0))
    parts = []
    for c in p.kids():
        if c.name in ("r", "fld"):
            t = c.child("t")
            parts.append(t.text() if t is not None else "")
        elif c.name == "br":
            parts.append("\n")
    text = "".join(parts)
    return "  " * level + text if text.strip() else ""


def _shapes(tree: Element, out: list[tuple]) -> None:
    """(is no title, y, x, order, blocks) of each shape; groups are opened without their frame."""
    for s in tree.kids():
        if s.name == "AlternateContent":
            branch = s.child("Choice") or s.child("Fallback")
            if branch is not None:
                _shapes(branch, out)
        elif s.name == "grpSp":
            _shapes(s, out)
        elif s.name in ("sp", "graphicFrame"):
            ph = s.find("ph")
            kind = ph.attrs.get("type", "") if ph is not None else ""
            if kind in DROPPED:
                continue
            off = s.find("off")
            y, x = _number(off, "y", 0), _number(off, "x", 0)
            title = kind in ("title", "ctrTitle")
            blocks = []
            if s.name == "graphicFrame":
                tbl = s.find("tbl")
                if tbl is not None:
                    blocks.append(model.table([["\n".join(filter(None, (paragraph_text(p) for p in tc.find_all("p")))) for tc in tr.kids("tc")] for tr in tbl.kids("tr")]))
            else:
                body = s.child("txBody")
                texts = [t for p in (body.kids("p") if body is not None else ()) if (t := paragraph_text(p))]
                blocks = [model.heading("\n".join(texts), 1)] if title and texts else [model.paragraph(t) for t in texts]
            if blocks:
                out.append((not title, y, x, len(out), blocks))


def read(data: bytes) -> list[dict]:
    """A page per slide in the order of the slide list: titles first, then by place."""
    parts = zipio.entries(data)
    main = xmlio.main_part(parts, "ppt/presentation.xml")
    if main not in parts:
        raise PackageError("This file is not a PowerPoint presentation (ppt/presentation.xml is missing).")
    root, rels = xmlio.parse(zipio.text(parts, main)), xmlio.relations(parts, main)
    size = root.find("sldSz")
    width, height = _number(size, "cx", SLIDE[0] * EMU) / EMU, _number(size, "cy", SLIDE[1] * EMU) / EMU
    listed = root.find("sldIdLst")
    pages = []
    for s in listed.kids("sldId") if listed is not None else ():
        _, part = rels.get(s.attrs.get("r:id", ""), ("", ""))
        if part not in parts:
            continue
        tree = xmlio.parse(zipio.text(parts, part)).at("sld", "cSld", "spTree")
        found: list[tuple] = []
        if tree is not None:
            _shapes(tree, found)
        pages.append(model.page([b for f in sorted(found, key=lambda f: f[:4]) for b in f[4]], width, height, f"Slide {len(pages) + 1}"))
    if not pages:
        raise PackageError("This presentation has no slides.")
    return pages


# ------------------------------------------------------------------ writers

def _frame(x: float, y: float, w: float, h: float, prefix: str = "a") -> str:
    a, b, c, d = (max(0, round(v * EMU)) for v in (x, y, w, h))
    return f'<{prefix}:xfrm><a:off x="{a}" y="{b}"/><a:ext cx="{c}" cy="{d}"/></{prefix}:xfrm>'


def _runs(text: str, size: float, bold: bool) -> str:
    """One paragraph; line ends are breaks within it."""
    look = f'<a:rPr lang="en-US" sz="{min(400_000, max(100, round(size * 100)))}"{" b=\"1\"" if bold else ""}/>'
    return f"<a:p>{'<a:br/>'.join(f'<a:r>{look}<a:t>{escape_xml(line)}</a:t></a:r>' for line in text.split(chr(10))) if text else ''}</a:p>"


def _box(n: int, texts: list[tuple[str, float, bool]], at: tuple[float, float, float, float], title: bool = False, wrap: bool = True) -> str:
    """A text box of paragraphs (text, size, bold); tabs are four spaces."""
    place = '<p:nvPr><p:ph type="title"/></p:nvPr>' if title else "<p:nvPr/>"
    body = '<a:bodyPr wrap="square" rtlCol="0"><a:normAutofit/></a:bodyPr>' if wrap else '<a:bodyPr wrap="none" lIns="0" tIns="0" rIns="0" bIns="0" rtlCol="0"><a:noAutofit/></a:bodyPr>'
    return (f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="Text {n}"/><p:cNvSpPr txBox="1"/>{place}</p:nvSpPr><p:spPr>{_frame(*at)}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr>'
            f'<p:txBody>{body}<a:lstStyle/>{"".join(_runs(t.replace(chr(9), "    "), size, bold) for t, size, bold in texts)}</p:txBody></p:sp>')


def _table(n: int, rows: list[list[str]], at: tuple[float, float, float]) -> str:
    columns = max([1, *map(len, rows)])
    x, y, wide = at
    width, size = int(wide * EMU / columns), 9 if columns > 8 else 11 if columns > 5 else 14
    cell = lambda t, bold: f"<a:tc><a:txBody><a:bodyPr/><a:lstStyle/>{_runs(t or '', size, bold)}</a:txBody><a:tcPr/></a:tc>"
    body = "".join(f'<a:tr h="{round(ROW_HEIGHT * EMU)}">{"".join(cell(r[c] if c < len(r) else "", k == 0) for c in range(columns))}</a:tr>' for k, r in enumerate(rows))
    frame = _frame(x, y, width * columns / EMU, ROW_HEIGHT * len(rows), prefix="p")
    return (f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{n}" name="Table {n}"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr>{frame}'
            f'<a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/table"><a:tbl><a:tblPr firstRow="1"/><a:tblGrid>{f"<a:gridCol w={chr(34)}{width}{chr(34)}/>" * columns}</a:tblGrid>{body}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>')


def _lines(text: str) -> int:
    """Lines that a text takes of a slide."""
    return sum(max(1, -(-utf16_length(x) // LINE_CHARS)) for x in text.split("\n"))


def _sections(page: dict, title: str) -> list[tuple[str, list[dict]]]:
    """Blocks of a page by the heading that they stand under; the first ones stand under the title."""
    out: list[tuple[str, list[dict]]] = [(title, [])]
    for block in page["blocks"] or ():
        if block["type"] == "heading":
            out.append((block["text"] or "", []))
        else:
            out[-1][1].append(block)
    return out


def _section_slides(title: str, blocks: list[dict]) -> list[dict]:
    """Slides of one section: tables by TABLE_ROWS rows, texts by BUDGET_LINES lines."""
    out: list[dict] = []
    for is_table, some in groupby(blocks, key=lambda b: b["type"] == "table"):
        if is_table:
            for rows in ((b["rows"] or []) for b in some):
                out += [{"title": title, "texts": [], "rows": rows[s:s + TABLE_ROWS]} for s in range(0, len(rows), TABLE_ROWS)]
            continue
        used = BUDGET_LINES + 1
        for text, bold in ((b["text"] or "", bool(b.get("bold"))) for b in some):
            if used + _lines(text) > BUDGET_LINES and (used > BUDGET_LINES or out[-1]["texts"]):
                out.append({"title": title, "texts": [], "rows": None})
                used = 0
            out[-1]["texts"].append((text, bold))
            used += _lines(text)
    return out


def flow(pages: list[dict], title: str = "", keep_consecutive: bool = False) -> list[dict]:
    """Slides {title, texts, rows} of flowing blocks.

    Slides are titled by the heading above them, before the first one by the page's name or the
    document's title.  A section without blocks gives no slide but where it ends its page, so a
    heading right after a heading replaces it; with keep_consecutive each heading has a slide.
    """
    slides: list[dict] = []
    for page in pages:
        sections = _sections(page, page.get("name") or title)
        for n, (head, blocks) in enumerate(sections):
            found = _section_slides(head, blocks)
            if not found and (n == len(sections) - 1 or keep_consecutive and n):
                found = [{"title": head, "texts": [], "rows": None}]
            slides += found
    return slides


def _flow_slide(slide: dict, width: float, height: float) -> str:
    x, top, wide = MARGIN, BODY_TOP, width - 2 * MARGIN
    out = [_box(2, [(slide["title"], TITLE_SIZE, True)], (x, TITLE_TOP, wide, TITLE_HEIGHT), title=True)] if slide["title"] else []
    if slide["rows"] is not None:
        out.append(_table(3, slide["rows"], (x, top, wide)))
    elif slide["texts"]:
        out.append(_box(3, [(text, BODY_SIZE, bold) for text, bold in slide["texts"]], (x, top, wide, height - top - MARGIN)))
    return "".join(out)


def _placed_slide(page: dict, width: float, height: float) -> str:
    """One box per item of a page, scaled to fit the slide."""
    scale = min(width / (page["width"] or PAGE[0]), height / (page["height"] or PAGE[1]))
    out = []
    for n, item in enumerate(page["items"] or (), 2):
        size = item["size"] * scale
        at = (item["x"] * scale, (item["y"] - item["size"] * RISE) * scale, item["width"] * scale + size, size * BOX_HEIGHT)
        out.append(_box(n, [(item["text"], size, bool(item["bold"]))], at, wrap=False))
    return "".join(out)


def write(pages: list[dict], title: str, stamp: str) -> bytes:
    """A presentation: text at its place where pages have items, flowing slides otherwise."""
    if any(p.get("items") is not None for p in pages):
        width, height = (min(MOST_POINTS, max(72.0, pages[0][k] or usual)) for k, usual in zip(("width", "height"), PAGE))
        trees = [_placed_slide(p, width, height) for p in pages]
    else:
        width, height = SLIDE
        trees = [_flow_slide(s, width, height) for s in flow(pages, title)] or [""]
    pair = f'xmlns:a="{DRAWING}"'
    group = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
    kind = "application/vnd.openxmlformats-officedocument.presentationml."
    count = len(trees)
    overrides = {"/ppt/presentation.xml": kind + "presentation.main+xml", "/ppt/slideMasters/slideMaster1.xml": kind + "slideMaster+xml", "/ppt/slideLayouts/slideLayout1.xml": kind + "slideLayout+xml",
                 "/ppt/theme/theme1.xml": "application/vnd.openxmlformats-officedocument.theme+xml"} | {f"/ppt/slides/slide{i}.xml": kind + "slide+xml" for i in range(1, count + 1)}
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, count + 1))
    show = (f'<p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId{count + 1}"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst>'
            f'<p:sldSz cx="{round(width * EMU)}" cy="{round(height * EMU)}"/><p:notesSz cx="6858000" cy="9144000"/>')
    part = lambda root, body: ooxml.part(root, SPACE, body, "p", f" {pair}")
    tree = f"<p:cSld><p:spTree>{group}</p:spTree></p:cSld>"
    colours = "".join(f'{k}="{v}" ' for k, v in dict(bg1="lt1", tx1="dk1", bg2="lt2", tx2="dk2", accent1="accent1", accent2="accent2", accent3="accent3", accent4="accent4", accent5="accent5", accent6="accent6", hlink="hlink", folHlink="folHlink").items())
    master = f'{tree}<p:clrMap {colours}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst>'
    return zipio.create([
        *ooxml.package("ppt/presentation.xml", overrides, title, stamp),
        ("ppt/presentation.xml", part("presentation", show)),
        ("ppt/_rels/presentation.xml.rels", ooxml.relationships([*(("slide", f"slides/slide{i}.xml") for i in range(1, count + 1)), ("slideMaster", "slideMasters/slideMaster1.xml"), ("theme", "theme/theme1.xml")])),
        ("ppt/slideMasters/slideMaster1.xml", part("sldMaster", master)),
        ("ppt/slideMasters/_rels/slideMaster1.xml.rels", ooxml.relationships([("slideLayout", "../slideLayouts/slideLayout1.xml"), ("theme", "../theme/theme1.xml")])),
        ("ppt/slideLayouts/slideLayout1.xml", part("sldLayout", tree)),
        ("ppt/slideLayouts/_rels/slideLayout1.xml.rels", ooxml.relationships([("slideMaster", "../slideMasters/slideMaster1.xml")])),
        ("ppt/theme/theme1.xml", _theme()),
        *((f"ppt/slides/slide{i}.xml", part("sld", f"<p:cSld><p:spTree>{group}{t}</p:spTree></p:cSld>")) for i, t in enumerate(trees, 1)),
        *((f"ppt/slides/_rels/slide{i}.xml.rels", ooxml.relationships([("slideLayout", "../slideLayouts/slideLayout1.xml")])) for i in range(1, count + 1))])


def _theme() -> str:
    # A plain colour scheme.
    scheme = dict(dk1="000000", lt1="FFFFFF", dk2="44546A", lt2="E7E6E6", accent1="4472C4", accent2="ED7D31", accent3="A5A5A5", accent4="FFC000", accent5="5B9BD5", accent6="70AD47", hlink="0563C1", folHlink="954F72")
    colours = "".join(f'<a:{k}><a:srgbClr val="{v}"/></a:{k}>' for k, v in scheme.items())
    font = '<a:latin typeface="Calibri"/><a:ea typeface=""/><a:cs typeface=""/>'
    fill, line = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>', '<a:ln w="6350"><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>'
    effect = "<a:effectStyle><a:effectLst/></a:effectStyle>"
    look = f'<a:fmtScheme name="Plain"><a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{line * 3}</a:lnStyleLst><a:effectStyleLst>{effect * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst></a:fmtScheme>'
    body = f'<a:themeElements><a:clrScheme name="Plain">{colours}</a:clrScheme><a:fontScheme name="Plain"><a:majorFont>{font}</a:majorFont><a:minorFont>{font}</a:minorFont></a:fontScheme>{look}</a:themeElements>'
    return ooxml.part("theme", DRAWING, body, "a", ' name="Plain"')
