"""Lenient XML trees for Office parts: prefixes are ignored, and any closing tag pops."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

from . import zipio

_TOKEN = re.compile(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<![^\[>]*(?:\[.*?\])?[^>]*>|<(/?)([^\s/>]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_REF = re.compile(r"&(?:#x([0-9a-fA-F]+)|#(\d+)|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


class Element:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def kids(self, name: str | None = None) -> Iterator[Element]:
        """Child elements, of one name if given."""
        return (c for c in self.children if isinstance(c, Element) and (name is None or c.name == name))

    def child(self, name: str) -> Element | None:
        return next(self.kids(name), None)

    def at(self, *path: str) -> Element | None:
        node = self
        for name in path:
            node = node.child(name) if node is not None else None
        return node

    def find_all(self, name: str) -> Iterator[Element]:
        """Descendants of a name, depth first, not inside other matches."""
        stack = list(reversed(list(self.kids())))
        while stack:
            node = stack.pop()
            if node.name == name:
                yield node
            else:
                stack.extend(reversed(list(node.kids())))

    def find(self, name: str) -> Element | None:
        return next(self.find_all(name), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)


def unescape(text: str) -> str:
    """The five named references and numeric ones; numbers beyond Unicode give nothing."""
    def one(m: re.Match) -> str:
        if m[3]:
            return _NAMED[m[3]]
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if code <= 0x10FFFF else ""
    return _REF.sub(one, text) if "&" in text else text


def parse(xml: str) -> Element:
    root = Element("", {})
    stack, at = [root], 0
    for m in _TOKEN.finditer(xml):
        if m.start() > at:
            stack[-1].children.append(unescape(xml[at:m.start()]))
        at = m.end()
        if m[3] is None:
            if m[1]:
                stack[-1].children.append(m[1])
        elif m[2]:
            if len(stack) > 1:
                stack.pop()
        else:
            attrs = {}
            for key, a, b in _ATTR.findall(m[4]):
                value = unescape(a or b)
                attrs[key] = value
                attrs.setdefault(key.rpartition(":")[2], value)
            node = Element(m[3].rpartition(":")[2], attrs)
            stack[-1].children.append(node)
            if not m[5]:
                stack.append(node)
    if at < len(xml):
        stack[-1].children.append(unescape(xml[at:]))
    return root


def resolve(base: str, target: str) -> str:
    """A part name from a target relative to the part `base`."""
    full = target if target.startswith("/") else posixpath.join(posixpath.dirname(base), target)
    return posixpath.normpath("/" + full).lstrip("/")


def relations(parts: dict, part: str) -> dict[str, tuple[str, str]]:
    """Relation id to (type, part name) of a part; '' names the package."""
    folder, name = posixpath.split(part)
    rels = zipio.text(parts, posixpath.join(folder, "_rels", f"{name}.rels"))
    return {r.attrs.get("Id", ""): (r.attrs.get("Type", ""), resolve(part, r.attrs.get("Target", ""))) for r in parse(rels).find_all("Relationship")}


def main_part(parts: dict, usual: str) -> str:
    """The office document that the package names, or the usual one."""
    return next((target for kind, target in relations(parts, "").values() if kind.endswith("/officeDocument")), usual)
