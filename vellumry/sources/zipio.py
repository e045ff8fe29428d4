"""ZIP packages: a directory reader that copes with damage, and a writer with stable bytes."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass


class PackageError(ValueError):
    """A package that cannot be read."""


@dataclass
class Entry:
    data: memoryview
    method: int
    encrypted: bool
    name: str

    def read(self) -> bytes:
        if self.method == 0:
            return bytes(self.data)
        if self.method != 8:
            raise PackageError(f"ZIP entry {self.name} uses compression method {self.method}, which is not supported.")
        return zlib.decompressobj(-15).decompress(self.data)


NOT_A_PACKAGE = "This file is not a ZIP-based Office document."


def entries(data: bytes) -> dict[str, Entry]:
    """Entries by name, from the central directory; nothing is inflated yet."""
    end = data.rfind(b"PK\x05\x06")
    if end < 0 or end + 22 > len(data):
        raise PackageError(NOT_A_PACKAGE)
    count, _, at = struct.unpack_from("<HII", data, end + 10)
    if (count == 0xFFFF or at == 0xFFFFFFFF) and data[end - 20:end - 16] == b"PK\x06\x07":
        big = struct.unpack_from("<Q", data, end - 12)[0]
        if data[big:big + 4] == b"PK\x06\x06":
            count, _, at = struct.unpack_from("<QQQ", data, big + 32)
    view, out = memoryview(data), {}
    for _ in range(count):
        if data[at:at + 4] != b"PK\x01\x02" or at + 46 > len(data):
            break
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, at + 20)
        local = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46:at + 46 + n_name].decode("utf-8", "replace").replace("\\", "/")
        packed, local = _wide(data[at + 46 + n_name:at + 46 + n_name + n_extra], plain, packed, local)
        if data[local:local + 4] == b"PK\x03\x04":
            skip = sum(struct.unpack_from("<HH", data, local + 26))
            start = local + 30 + skip
            out[name] = Entry(view[start:start + packed], method, bool(flags & 1), name)
        at += 46 + n_name + n_extra + n_note
    if not out:
        raise PackageError(NOT_A_PACKAGE)
    return out


def _wide(extra: bytes, plain: int, packed: int, local: int) -> tuple[int, int]:
    """Sizes and offsets of more than 32 bits, from extra field 1."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            if plain == 0xFFFFFFFF and values:
                values.pop(0)
            if packed == 0xFFFFFFFF and values:
                packed = values.pop(0)
            if local == 0xFFFFFFFF and values:
                local = values.pop(0)
        at += 4 + size
    return packed, local


def text(parts: dict[str, Entry], name: str) -> str:
    """An entry as text; empty if there is none."""
    return parts[name].read().decode("utf-8", "replace").removeprefix("﻿") if name in parts else ""


def create(files: list[tuple[str, str | bytes]]) -> bytes:
    """A package with all files deflated and dated 1980-01-01, so equal input gives equal bytes."""
    body, directory = bytearray(), bytearray()
    for name, content in files:
        raw = content.encode() if isinstance(content, str) else content
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = deflate.compress(raw) + deflate.flush()
        label = name.encode()
        common = struct.pack("<HHHHHIIIHH", 20, 0x800, 8, 0, 0x21, zlib.crc32(raw), len(packed), len(raw), len(label), 0)
        directory += b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, len(body)) + label
        body += b"PK\x03\x04" + common + label + packed
    return bytes(body + directory + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(files), len(files), len(directory), len(body), 0))
