"""Stream filters."""

from __future__ import annotations

import re
import zlib

import numpy as np

SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}


def decode(name: str, data: bytes, parms: dict) -> bytes | None:
    """Decoded bytes, or None for a filter that is not known."""
    name = SHORT.get(name, name)
    if name == "FlateDecode":
        return predicted(inflate(data), parms)
    if name == "LZWDecode":
        return predicted(lzw(data, parms.get("EarlyChange", 1)), parms)
    if name == "ASCIIHexDecode":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">", 1)[0])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if name == "ASCII85Decode":
        return ascii85(data)
    if name == "RunLengthDecode":
        return run_length(data)
    return data if name == "Crypt" else None


def inflate(data: bytes) -> bytes:
    """As much as can be inflated: with a header, without the first two bytes, or raw."""
    for bits, skip in ((15, 0), (-15, 2), (-15, 0)):
        d, out = zlib.decompressobj(bits), bytearray()
        try:
            for at in range(skip, len(data), 4096):
                out += d.decompress(data[at:at + 4096])
            return bytes(out + d.flush())
        except zlib.error:
            if out:
                return bytes(out)
    return b""


def lzw(data: bytes, early: int) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, bits, held, width, last = bytearray(), 0, 0, 9, None
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held & (1 << width) - 1
        bits &= (1 << held) - 1
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if code == 257:
            break
        if last is None:
            if code >= len(table):
                break
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(last + entry[:1])
        elif code == len(table):
            entry = last + last[:1]
            table.append(entry)
        else:
            break
        out += entry
        last = entry
        width = min(12, max(9, (len(table) + (1 if early else 0)).bit_length()))
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~", 1)[0].removeprefix(b"<"):
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _word(group)
                group = []
    if len(group) > 1:
        out += _word(group + [84] * (5 - len(group)))[:len(group) - 1]
    return bytes(out)


def _word(group: list[int]) -> bytes:
    n = 0
    for d in group:
        n = n * 85 + d
    return (n & 0xFFFFFFFF).to_bytes(4, "big")


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1:at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1:at + 2] * (257 - n)
            at += 2
    return bytes(out)


def predicted(data: bytes, parms: dict) -> bytes:
    """Undo a TIFF or PNG predictor."""
    kind = parms.get("Predictor", 1) or 1
    if kind < 2:
        return data
    colors, bits, columns = parms.get("Colors", 1) or 1, parms.get("BitsPerComponent", 8) or 8, parms.get("Columns", 1) or 1
    step, size = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        if bits != 8:
            return data
        whole = len(data) // size * size
        rows = np.frombuffer(data[:whole], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes() + data[whole:]
    out, above = bytearray(), bytearray(size)
    for at in range(0, len(data), size + 1):
        tag, row = data[at], bytearray(data[at + 1:at + 1 + size])
        _unfilter(tag, row, above, step)
        out += row
        above = row + bytearray(size - len(row))
    return bytes(out)


def _unfilter(tag: int, row: bytearray, above: bytearray, step: int) -> None:
    if tag == 1:
        for i in range(step, len(row)):
            row[i] = row[i] + row[i - step] & 255
    elif tag == 2:
        for i in range(len(row)):
            row[i] = row[i] + above[i] & 255
    elif tag == 3:
        for i in range(len(row)):
            left = row[i - step] if i >= step else 0
            row[i] = row[i] + (left + above[i] >> 1) & 255
    elif tag == 4:
        for i in range(len(row)):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
            row[i] = row[i] + near[2] & 255
