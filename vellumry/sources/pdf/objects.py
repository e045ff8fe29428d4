"""PDF objects: lexer, cross-references with repair, object streams, page tree."""

from __future__ import annotations

import re
import struct
from typing import Any

from .. import limits
from . import crypto, filters


class PdfError(ValueError):
    """A PDF that cannot be read."""


class Name(str):
    __slots__ = ()


class Op(str):
    """A keyword."""
    __slots__ = ()


class Ref(tuple):
    """(object number, generation)."""
    __slots__ = ()


class Stream:
    __slots__ = ("dict", "raw", "owner", "plain")

    def __init__(self, d: dict, raw: bytes, owner: tuple[int, int] | None):
        self.dict, self.raw, self.owner, self.plain = d, raw, owner, None


END = Op("")
_SPACE = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_STRING = re.compile(rb"[()\\]")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)(?:-\d*)?$")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_ESCAPES = {ord(k): v for k, v in zip("nrtbf", b"\n\r\t\b\f")}


class Lexer:
    def __init__(self, data: bytes, at: int = 0, content: bool = False):
        self.data, self.at, self.content = data, at, content

    def skip(self) -> None:
        self.at = _SPACE.match(self.data, self.at).end()

    def next(self, depth: int = 0) -> Any:
        """The next object; keywords are Op, the end of the data is END."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            return END
        c = data[at]
        if c == 0x2F:
            m = _REGULAR.match(data, at + 1)
            self.at = m.end() if m else at + 1
            raw = m.group() if m else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw).decode("latin-1"))
        if c == 0x28:
            return self._literal()
        if c == 0x3C:
            if data[at + 1:at + 2] == b"<":
                self.at += 2
                return self._dict(depth)
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1:end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == 0x5B:
            self.at += 1
            out: list = []
            while (x := self.next(depth + 1)) is not END and x != "]" if depth < 200 else False:
                out.append(x)
            return out
        if c in b"]{})>":
            self.at += 2 if data[at:at + 2] == b">>" else 1
            return Op(data[at:self.at].decode())
        m = _REGULAR.match(data, at)
        if not m:
            self.at += 1
            return Op(chr(c))
        word, self.at = m.group(), m.end()
        if _NUMBER.match(word):
            if not self.content and word.isdigit():
                r = _REF.match(data, _SPACE.match(data, self.at).end())
                if r:
                    self.at = r.end()
                    return Ref((int(word), int(r[1])))
            body = word[:1] + word[1:].split(b"-")[0]
            return float(body) if b"." in body else int(body)
        return {b"true": True, b"false": False, b"null": None}.get(word, Op(word.decode("latin-1")))

    def _literal(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while True:
            m = _STRING.search(data, at)
            if not m:
                self.at = len(data)
                return bytes(out + data[at:])
            out += data[at:m.start()]
            at = m.end()
            c = m.group()
            if c == b"(":
                depth += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    self.at = at
                    return bytes(out)
            else:
                n = data[at:at + 1]
                at += 1
                if n and n in b"01234567":
                    octal = re.match(rb"[0-7]{1,3}", data[at - 1:at + 2]).group()
                    out.append(int(octal, 8) & 255)
                    at += len(octal) - 1
                elif n == b"\r":
                    at += data[at:at + 1] == b"\n"
                elif n and n != b"\n":
                    out.append(_ESCAPES.get(n[0], n[0]))
                continue
            out += c

    def _dict(self, depth: int) -> dict:
        out: dict = {}
        while depth < 200:
            key = self.next(depth + 1)
            if key is END or key == ">>" and isinstance(key, Op):
                break
            if not isinstance(key, Name):
                continue
            value = self.next(depth + 1)
            if isinstance(value, Op):
                if value == ">>" or value is END:
                    break
                continue
            out[str(key)] = value
        return out


class Document:
    """Objects of one file, fetched on demand."""

    def __init__(self, data: bytes):
        start = data.find(b"%PDF-")
        if not 0 <= start <= limits.HEADER_OFFSET:
            raise PdfError("This file is not a PDF document.")
        self.data = data[start:]
        self.table: dict[int, tuple] = {}  # number -> (offset, generation) or (stream, index, None)
        self.cache: dict[int, Any] = {}
        self.members: dict[int, dict[int, Any]] = {}
        self.trailer: dict = {}
        self.cipher: crypto.Cipher | None = None
        self.rebuilt = False
        try:
            self._read_tables()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise PdfError("no catalog")
        except (PdfError, ValueError, IndexError, TypeError, struct.error, RecursionError):
            self._rebuild()
        self._open()
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            if not self.rebuilt:
                self._rebuild()
                self._open()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise PdfError("This PDF is damaged: its document catalog could not be found.")

    def _open(self) -> None:
        encrypt = self.get(self.trailer.get("Encrypt"))
        if isinstance(encrypt, dict):
            encrypt = {k: self.get(v) for k, v in encrypt.items()}
            ids = self.get(self.trailer.get("ID"))
            self.cache.clear()
            self.members.clear()
            try:
                self.cipher = crypto.open_empty(encrypt, self.get(ids[0]) if isinstance(ids, list) and ids else b"", self.get)
            except crypto.Refused as e:
                raise PdfError(str(e)) from e
            ref = self.trailer.get("Encrypt")
            self.plain_object = ref[0] if isinstance(ref, Ref) else None

    # -------------------------------------------------- cross-references

    def _read_tables(self) -> None:
        tail = self.data.rfind(b"startxref")
        if tail < 0:
            raise PdfError("no startxref")
        queue, seen = [Lexer(self.data, tail + 9).next()], set()
        while queue:
            at = queue.pop(0)
            if not isinstance(at, int) or at in seen or at >= len(self.data):
                if not seen:
                    raise PdfError("bad startxref")
                continue
            seen.add(at)
            lexer = Lexer(self.data, at)
            first = lexer.next()
            if first == "xref" and isinstance(first, Op):
                trailer = self._read_table(lexer)
            else:
                trailer = self._read_stream_table(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            if "XRefStm" in trailer:
                queue.append(trailer["XRefStm"])
            if "Prev" in trailer:
                queue.append(trailer["Prev"])

    def _read_table(self, lexer: Lexer) -> dict:
        while True:
            first = lexer.next()
            if first == "trailer" and isinstance(first, Op):
                trailer = lexer.next()
                if not isinstance(trailer, dict):
                    raise PdfError("bad trailer")
                return trailer
            count = lexer.next()
            if not isinstance(first, int) or not isinstance(count, int):
                raise PdfError("bad xref table")
            for n in range(first, first + count):
                at, gen, kind = lexer.next(), lexer.next(), lexer.next()
                if not isinstance(at, int) or not isinstance(kind, Op):
                    raise PdfError("bad xref entry")
                if kind == "n":
                    self.table.setdefault(n, (at, gen))
                else:
                    self.table.setdefault(n, ())

    def _read_stream_table(self, at: int) -> dict:
        _, stream = self._parse_at(at, None)
        if not isinstance(stream, Stream) or not isinstance(stream.dict.get("W"), list):
            raise PdfError("bad xref stream")
        data, w = self.decoded(stream), stream.dict["W"]
        index = stream.dict.get("Index") or [0, stream.dict.get("Size", 0)]
        size, pos = sum(w), 0
        for first, count in zip(index[::2], index[1::2]):
            for n in range(first, first + count):
                if pos + size > len(data):
                    break
                kind, a, b = (int.from_bytes(data[pos + sum(w[:k]):pos + sum(w[:k + 1])], "big") for k in range(3))
                kind = kind if w[0] else 1
                pos += size
                self.table.setdefault(n, (a, b) if kind == 1 else (a, b, None) if kind == 2 else ())
        return stream.dict

    def _rebuild(self) -> None:
        """Scan for objects, trailers and object streams; later definitions win."""
        self.rebuilt = True
        self.table, self.cache, self.members = {}, {}, {}
        for m in re.finditer(rb"(?<!\d)(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj\b", self.data):
            self.table[int(m[1])] = (m.start(), int(m[2]))
        for m in re.finditer(rb"\btrailer\b", self.data):
            d = Lexer(self.data, m.end()).next()
            if isinstance(d, dict):
                self.trailer |= d
        catalog, packed = None, []
        for n in sorted(self.table):
            try:
                value = self.get(Ref((n, 0)))
            except (PdfError, RecursionError, ValueError):
                continue
            d = value.dict if isinstance(value, Stream) else value
            if not isinstance(d, dict):
                continue
            kind = d.get("Type")
            if kind == "Catalog":
                catalog = Ref((n, 0))
            elif kind == "ObjStm":
                packed.append(n)
            elif kind == "XRef":
                for k, v in d.items():
                    self.trailer.setdefault(k, v)
        encrypted = "Encrypt" in self.trailer
        for n in packed if not encrypted else ():
            for k in self._members_of(n):
                self.table.setdefault(k, (n, 0, None))
                if isinstance(v := self.get(Ref((k, 0))), dict) and v.get("Type") == "Catalog":
                    catalog = Ref((k, 0))
        if not isinstance(self.get(self.trailer.get("Root")), dict) and catalog:
            self.trailer["Root"] = catalog

    # -------------------------------------------------- objects

    def get(self, value: Any) -> Any:
        """The value behind references."""
        for _ in range(limits.REFERENCE_DEPTH):
            if not isinstance(value, Ref):
                return value
            value = self._fetch(value[0])
        return None

    def _fetch(self, n: int) -> Any:
        if n in self.cache:
            return self.cache[n]
        self.cache[n] = None  # a loop finds nothing
        entry = self.table.get(n)
        value = None
        if entry and len(entry) == 3:
            value = self._members_of(entry[0]).get(n)
        elif entry:
            try:
                found, value = self._parse_at(entry[0], n)
                if found != n:
                    raise PdfError("object number mismatch")
            except (PdfError, ValueError, IndexError):
                if self.rebuilt:
                    value = None
                else:
                    trailer = dict(self.trailer)
                    self._rebuild()
                    self.trailer = trailer | {k: v for k, v in self.trailer.items() if k not in trailer}
                    return self._fetch(n)
        self.cache[n] = value
        return value

    def _parse_at(self, at: int, expected: int | None) -> tuple[int, Any]:
        lexer = Lexer(self.data, at)
        n, gen, word = lexer.next(), lexer.next(), lexer.next()
        if not isinstance(n, int) or word != "obj" or not isinstance(word, Op):
            raise PdfError("bad object header")
        value = lexer.next()
        if isinstance(value, dict):
            lexer.skip()
            if self.data[lexer.at:lexer.at + 6] == b"stream":
                start = lexer.at + 6
                start += 2 if self.data[start:start + 2] == b"\r\n" else 1 if self.data[start:start + 1] in (b"\n", b"\r") else 0
                return n, Stream(value, self._stream_bytes(value, start), (n, gen) if expected is not None else None)
        if self.cipher and expected is not None and n != getattr(self, "plain_object", None):
            value = self._decrypted(value, (n, gen))
        return n, value

    def _stream_bytes(self, d: dict, start: int) -> bytes:
        length = d.get("Length")
        length = self.get(length) if isinstance(length, Ref) else length
        if isinstance(length, int) and length >= 0 and re.match(rb"[\x00\t\n\x0c\r ]*endstream", self.data[start + length:start + length + 16]):
            return self.data[start:start + length]
        end = self.data.find(b"endstream", start)
        if end < 0:
            end = self.data.find(b"endobj", start)
        end = len(self.data) if end < 0 else end
        return re.sub(rb"\r?\n$", b"", self.data[start:end])

    def _decrypted(self, value: Any, owner: tuple[int, int]) -> Any:
        if isinstance(value, bytes):
            return self.cipher.string(value, owner)
        if isinstance(value, list):
            return [self._decrypted(v, owner) for v in value]
        if isinstance(value, dict):
            return {k: self._decrypted(v, owner) for k, v in value.items()}
        return value

    def _members_of(self, n: int) -> dict[int, Any]:
        """Objects of an object stream."""
        if n not in self.members:
            self.members[n] = out = {}
            stream = self._fetch(n)
            if isinstance(stream, Stream):
                data, first = self.decoded(stream), self.get(stream.dict.get("First")) or 0
                head = Lexer(data)
                pairs = [(head.next(), head.next()) for _ in range(min(self.get(stream.dict.get("N")) or 0, len(data)))]
                for k, at in pairs:
                    if isinstance(k, int) and isinstance(at, int):
                        out[k] = Lexer(data, first + at).next()
        return self.members[n]

    def decoded(self, stream: Stream) -> bytes:
        """Stream bytes after decryption and its filters; an unknown filter ends the chain."""
        if stream.plain is None:
            names, parms = self.get(stream.dict.get("Filter")), self.get(stream.dict.get("DecodeParms"))
            names = [self.get(x) for x in names] if isinstance(names, list) else [names] if names else []
            parms = [self.get(x) for x in parms] if isinstance(parms, list) else [parms]
            data = stream.raw
            exempt = stream.dict.get("Type") == "XRef" or "Crypt" in names or stream.owner is None
            if self.cipher and not exempt and not (stream.dict.get("Type") == "Metadata" and not self.cipher.metadata):
                data = self.cipher.stream(data, stream.owner)
            for i, name in enumerate(names):
                p = parms[i] if i < len(parms) and isinstance(parms[i], dict) else {}
                out = filters.decode(str(name), data, {k: self.get(v) for k, v in p.items()})
                if out is None:
                    break
                data = out
            stream.plain = data
        return stream.plain

    # -------------------------------------------------- pages

    def pages(self) -> list[dict]:
        """Page dictionaries with what they inherit, in order."""
        root = self.get(self.trailer.get("Root"))
        out: list[dict] = []
        seen: set[int] = set()

        def walk(ref: Any, inherited: dict, depth: int) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or depth > limits.PAGE_DEPTH or id(node) in seen:
                return
            seen.add(id(node))
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, own, depth + 1)
            else:
                out.append(own | node)

        walk(root.get("Pages"), {}, 0)
        if not out:
            for n in sorted(self.table):
                node = self.get(Ref((n, 0)))
                if isinstance(node, dict) and node.get("Type") == "Page":
                    out.append(node)
        return out

    def title(self) -> str:
        info = self.get(self.trailer.get("Info"))
        raw = self.get(info.get("Title")) if isinstance(info, dict) else None
        if not isinstance(raw, bytes):
            return ""
        if raw[:2] == b"\xfe\xff":
            return raw[2:].decode("utf-16-be", "replace")
        return raw[3:].decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("cp1252", "replace")
