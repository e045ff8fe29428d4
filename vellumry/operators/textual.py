"""TXT and HTML of one document in Python; the Column forms in render.py are their twins."""

from __future__ import annotations

import re

from ..functions.columns import SPACE
from ..functions.text import escape_html, escape_xml, trim, trim_end
from .render import HTML_HEAD, HTML_STYLE, HTML_TAIL, PRE_HEAD, PRE_TAIL

_BREAKS = re.compile(f"{SPACE}*\n{SPACE}*")


def to_text(pages: list[dict]) -> str:
    named = len(pages) > 1 and any(p.get("name") for p in pages)
    out = []
    for page in pages:
        parts = [f"=== {page['name']} ==="] if named and page.get("name") else []
        for b in page["blocks"] or ():
            if b["type"] == "table":
                parts.append("\n".join("\t".join(_BREAKS.sub(" ", c or "") for c in r) for r in b["rows"]))
            else:
                parts.append("\n".join(b["lines"]) if b.get("lines") is not None else b["text"] or "")
        out.append("\n\n".join(parts))
    return trim_end("\n\n\n".join(out)) + "\n"


def _shown(text: str | None) -> str:
    return escape_xml(text).replace("\n", "<br>").replace("\t", "&emsp;")


def to_html(title: str, pages: list[dict]) -> str:
    sections = []
    for page in pages:
        parts = [f'<h2 class="page-name">{_shown(page["name"])}</h2>'] if page.get("name") else []
        for b in page["blocks"] or ():
            if b["type"] == "heading":
                n = b.get("level") or 1
                parts.append(f"<h{n}>{_shown(b['text'])}</h{n}>")
            elif b["type"] == "table":
                rows = []
                for i, row in enumerate(b["rows"]):
                    tag = "th" if i == 0 and len(b["rows"]) > 1 else "td"
                    rows.append("<tr>" + "".join(f"<{tag}>{_shown(c)}</{tag}>" for c in row) + "</tr>")
                parts.append("<table>\n" + "\n".join(rows) + "\n</table>")
            elif trim(b["text"] or ""):
                strong = ("<strong>", "</strong>") if b.get("bold") else ("", "")
                parts.append(f"<p>{strong[0]}{_shown(b['text'])}{strong[1]}</p>")
        sections.append("<section>\n" + "\n".join(parts) + "\n</section>")
    return HTML_HEAD + escape_xml(title or "Converted document") + HTML_STYLE + "\n".join(sections) + HTML_TAIL


def text_to_html(text: str) -> str:
    """The browser's rendering of a plain text: all of it preformatted."""
    return PRE_HEAD + escape_html(text) + PRE_TAIL
