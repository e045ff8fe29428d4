"""The standard security handler, opened with the empty user password."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable
from functools import lru_cache

PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class Refused(ValueError):
    """A handler or password that cannot be used."""


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = j + s[i] + key[i % len(key)] & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for byte in data:
        i = i + 1 & 255
        j = j + s[i] & 255
        s[i], s[j] = s[j], s[i]
        out.append(byte ^ s[s[i] + s[j] & 255])
    return bytes(out)


@lru_cache(maxsize=1)
def _boxes() -> tuple[list[int], list[int], list[list[int]]]:
    """The AES substitution box, its inverse, and products in GF(2^8), from their definition."""
    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a = a << 1 ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        return out
    box = []
    for x in range(256):
        inv = next((y for y in range(256) if times(x, y) == 1), 0)
        value = 0x63
        for k in range(5):
            value ^= (inv << k | inv >> 8 - k) & 255
        box.append(value)
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    products = {k: [times(x, k) for x in range(256)] for k in (2, 3, 9, 11, 13, 14)}
    return box, back, [products.get(k, []) for k in range(15)]


def _round_keys(key: bytes) -> list[list[int]]:
    box = _boxes()[0]
    n = len(key) // 4
    words = [list(key[4 * i:4 * i + 4]) for i in range(n)]
    rcon = 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [box[b] for b in w[1:] + w[:1]]
            w[0] ^= rcon
            rcon = rcon << 1 ^ (0x11B if rcon & 0x80 else 0)
        elif n > 6 and i % n == 4:
            w = [box[b] for b in w]
        words.append([a ^ b for a, b in zip(words[i - n], w)])
    return [sum(words[i:i + 4], []) for i in range(0, len(words), 4)]


_SHIFT = [0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11]
_BACK = [_SHIFT.index(i) for i in range(16)]


def _decrypt_block(block: bytes, keys: list[list[int]]) -> bytes:
    _, back, p = _boxes()
    s = [a ^ b for a, b in zip(block, keys[-1])]
    for n in range(len(keys) - 2, -1, -1):
        s = [back[s[i]] ^ k for i, k in zip(_BACK, keys[n])]
        if n:
            s = [p[14][s[c]] ^ p[11][s[c + (r + 1) % 4 - r]] ^ p[13][s[c + (r + 2) % 4 - r]] ^ p[9][s[c + (r + 3) % 4 - r]] for c in range(16) for r in (c % 4,)]
    return bytes(s)


def _encrypt_block(block: bytes, keys: list[list[int]]) -> bytes:
    box, _, p = _boxes()
    s = [a ^ b for a, b in zip(block, keys[0])]
    for n in range(1, len(keys)):
        s = [box[s[i]] for i in _SHIFT]
        if n < len(keys) - 1:
            s = [p[2][s[c]] ^ p[3][s[c + (r + 1) % 4 - r]] ^ s[c + (r + 2) % 4 - r] ^ s[c + (r + 3) % 4 - r] for c in range(16) for r in (c % 4,)]
        s = [a ^ b for a, b in zip(s, keys[n])]
    return bytes(s)


def aes_cbc_decrypt(key: bytes, data: bytes, iv: bytes | None = None, unpad: bool = True) -> bytes:
    """CBC; without iv the first block is it."""
    if iv is None:
        iv, data = data[:16], data[16:]
    keys, out = _round_keys(key), bytearray()
    for at in range(0, len(data) // 16 * 16, 16):
        block = data[at:at + 16]
        out += bytes(a ^ b for a, b in zip(_decrypt_block(block, keys), iv))
        iv = block
    if unpad and out and 1 <= out[-1] <= 16:
        del out[-out[-1]:]
    return bytes(out)


def aes_cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    keys, out = _round_keys(key), bytearray()
    for at in range(0, len(data), 16):
        iv = _encrypt_block(bytes(a ^ b for a, b in zip(data[at:at + 16], iv)), keys)
        out += iv
    return bytes(out)


def hardened_hash(password: bytes, salt: bytes, more: bytes, revision: int) -> bytes:
    """The hash of revision 6: rounds of AES and a hash that the data choose."""
    k = hashlib.sha256(password + salt + more).digest()
    if revision < 6:
        return k
    n = 0
    while True:
        e = aes_cbc_encrypt(k[:16], (password + k + more) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


class Cipher:
    def __init__(self, key: bytes, strings: str, streams: str, metadata: bool):
        self.key, self.strings, self.streams, self.metadata = key, strings, streams, metadata

    def _apply(self, method: str, data: bytes, owner: tuple[int, int]) -> bytes:
        if method == "Identity":
            return data
        if method == "AESV3":
            return aes_cbc_decrypt(self.key, data)
        salted = self.key + struct.pack("<I", owner[0])[:3] + struct.pack("<H", owner[1] & 0xFFFF) + (b"sAlT" if method == "AESV2" else b"")
        key = hashlib.md5(salted).digest()[:min(16, len(self.key) + 5)]
        return aes_cbc_decrypt(key, data) if method == "AESV2" else rc4(key, data)

    def string(self, data: bytes, owner: tuple[int, int]) -> bytes:
        return self._apply(self.strings, data, owner)

    def stream(self, data: bytes, owner: tuple[int, int]) -> bytes:
        return self._apply(self.streams, data, owner)


def _method(d: dict, which: str, get: Callable) -> str:
    name = d.get(which, "Identity")
    if name == "Identity":
        return "Identity"
    known = get((get(d.get("CF")) or {}).get(name)) or {}
    return {"V2": "RC4", "AESV2": "AESV2", "AESV3": "AESV3", "None": "Identity"}.get(str(known.get("CFM", "None")), "Identity")


def open_empty(d: dict, file_id: bytes, get: Callable) -> Cipher:
    """The cipher of an encryption dictionary for the empty user password."""
    if d.get("Filter") != "Standard":
        raise Refused("This PDF is encrypted with a security handler that is not supported.")
    version, revision = d.get("V", 0) or 0, d.get("R", 2)
    metadata = d.get("EncryptMetadata", True) is not False
    methods = ("RC4", "RC4") if version < 4 else (_method(d, "StrF", get), _method(d, "StmF", get))
    user, owner = d.get("U", b""), d.get("O", b"")
    if revision >= 5:
        check, salt = user[32:40], user[40:48]
        if hardened_hash(b"", check, b"", revision) != user[:32]:
            raise Refused("This PDF is password-protected. Remove the password before converting.")
        inner = hardened_hash(b"", salt, b"", revision)
        return Cipher(aes_cbc_decrypt(inner, d.get("UE", b"")[:32], bytes(16), unpad=False), *methods, metadata)
    size = (d.get("Length", 40) or 40) // 8 if version > 1 else 5
    if version == 4:
        size = 16
    seed = PADDING + owner[:32] + struct.pack("<i", _signed(d.get("P", 0))) + file_id + (b"\xff\xff\xff\xff" if revision >= 4 and not metadata else b"")
    key = hashlib.md5(seed).digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:size]).digest()
    key = key[:size]
    if revision == 2:
        right = rc4(key, PADDING) == user[:32]
    else:
        made = rc4(key, hashlib.md5(PADDING + file_id).digest())
        for i in range(1, 20):
            made = rc4(bytes(b ^ i for b in key), made)
        right = made[:16] == user[:16]
    if not right:
        raise Refused("This PDF is password-protected. Remove the password before converting.")
    return Cipher(key, *methods, metadata)


def _signed(n: int) -> int:
    return (n + 2 ** 31) % 2 ** 32 - 2 ** 31
