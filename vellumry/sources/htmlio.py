"""HTML to text: what a browser gives as the body's text content."""

from __future__ import annotations

from html.parser import HTMLParser

from ..functions.text import trim

#: Elements whose presence does not open the body, and which belong to the head.
HEAD = frozenset(("html", "head", "title", "meta", "link", "base", "style", "script", "noscript", "template"))


class _Body(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open, self.hidden, self.after_head = False, None, False

    def handle_starttag(self, tag, attrs):
        if tag == "body" or tag not in HEAD:
            self.open = True
        if not self.open and tag in ("title", "style", "script", "noscript", "template"):
            self.hidden = tag

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = None
        elif tag == "head":
            self.after_head = True

    def handle_data(self, data):
        if not self.open and self.hidden is None and data.strip():
            self.open = True  # text outside the head opens the body
        if self.open and self.hidden is None:
            self.out.append(data)


def to_text(html: str | None) -> str:
    """Text of the body with its scripts and styles, without comments, trimmed."""
    parser = _Body()
    parser.feed(html or "")
    parser.close()
    return trim("".join(parser.out))
