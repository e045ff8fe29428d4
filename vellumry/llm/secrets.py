"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

Two second-order Markov models over letters, digits and one class for all else are trained from
labelled samples: random strings (hex, base32, base64, alphanumeric, letters) and ordinary
identifiers (words of a tokenizer's vocabulary joined in the usual ways, numbers, rules of repeated
signs).  A candidate is a run of token characters.  Its secrets are the stretches whose summed
log-likelihood ratio passes a bound, so a random part is found inside a long path or next to a fixed
pattern.  The bound is fitted: it is the least that FALSE_RATE of the held-out identifiers pass, whose
words the models have not seen.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import slices, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the models: runs of these characters, at least this long, as are the stretches.
LEAST_CHARS = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
#: Share of held-out identifiers that may pass the bound.
FALSE_RATE = 1 / 10_000
#: Samples of each label that the models learn from, and that the bound is fitted on.
SAMPLES, HELD_OUT = 12_000, 24_000
SEED = 7

# The alphabets of random strings.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", UPPER + DIGITS, LOWER + DIGITS, UPPER + LOWER + DIGITS,
             UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", UPPER + LOWER, LOWER)


def vocabulary_words(path: str) -> tuple[list[str], list[str]]:
    """Lower-case ASCII words of a SentencePiece vocabulary: four fifths to learn from, and the rest."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    words = sorted({w.lower() for w in (model.id_to_piece(i)[1:] for i in range(model.get_piece_size()) if model.id_to_piece(i)[0] == "▁") if re.fullmatch("[A-Za-z]{2,}", w)})
    return [w for w in words if zlib.crc32(w.encode()) % 5], [w for w in words if not zlib.crc32(w.encode()) % 5]


def identifier(words: list[str], style: int, rng: random.Random) -> str:
    """An ordinary identifier, number or rule of signs, in one of eleven styles."""
    some = [rng.choice(words) for _ in range(rng.randint(1, 6))]
    digits = lambda low, high: "".join(rng.choices(DIGITS, k=rng.randint(low, high)))
    return (lambda: "_".join(some), lambda: some[0] + "".join(w.title() for w in some[1:]), lambda: "".join(w.title() for w in some), lambda: "_".join(some).upper(),
            lambda: "-".join(some) + rng.choice(["", "-" + digits(1, 4)]), lambda: "/" + "/".join(some), lambda: "".join(some), lambda: "".join(some).title(), lambda: "".join(some).upper(),
            lambda: rng.choice(["", "v", "id", "no-", "+"]) + "-".join(digits(2, 12) for _ in range(rng.randint(1, 3))),
            lambda: rng.choice("=-_x/+0") * rng.randint(4, 80))[style % 11]()


def labelled_samples(words: list[str], count: int, seed: int) -> list[tuple[str, bool]]:
    """(string, is random) samples, `count` of each label; the same for the same seed."""
    rng = random.Random(seed)
    out = []
    for n in range(count):
        out.append(("".join(rng.choices(ALPHABETS[n % len(ALPHABETS)], k=rng.randint(LEAST_CHARS, 64))), True))
        out.append((identifier(words, n, rng), False))
    return out


def _symbols(text: str) -> np.ndarray:
    """Characters as small integers: 0 start, letters and digits each, one for all else."""
    codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    return _CLASS[codes]


_CLASS = np.full(256, 63, np.int64)
for _i, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
    _CLASS[ord(_c)] = _i + 1
_N = 64


class MarkovRatio:
    """Log-likelihood ratio of second-order character models, interpolated with lower orders, and the
    bound that the rate of held-out identifiers gives."""

    def __init__(self, samples: list[tuple[str, bool]], held_out: list[tuple[str, bool]], rate: float = FALSE_RATE):
        self.table = self._model([s for s, r in samples if r]) - self._model([s for s, r in samples if not r])
        best = sorted((self.best(s) for s, r in held_out if not r), reverse=True)
        self.bound = max(best[int(len(best) * rate)] if best else 0.0, 1e-9)

    @staticmethod
    def _model(texts: list[str]) -> np.ndarray:
        """log P(c | a, b) as an array over [a, b, c]."""
        three = np.zeros((_N, _N, _N), np.float64)
        s = np.concatenate([[0, 0], *(x for t in texts for x in (_symbols(t), [0, 0]))])
        np.add.at(three, (s[:-2], s[1:-1], s[2:]), s[2:] > 0)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + _N)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (three + 10 * p2[None]) / (three.sum(axis=2, keepdims=True) + 10)
        return np.log(p3)

    def ratios(self, run: str) -> np.ndarray:
        """The ratio's share of each character."""
        s = np.concatenate([[0, 0], _symbols(run)])
        return self.table[s[:-2], s[1:-1], s[2:]]

    def best(self, run: str) -> float:
        """The greatest sum of a stretch."""
        total = np.concatenate([[0.0], np.cumsum(self.ratios(run))])
        return float((total - np.minimum.accumulate(total)).max())

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """Stretches of LEAST_CHARS or more whose sums pass the bound.  One ends at its maximum once
        the sum has fallen by the bound, so parts that ordinary text divides are told apart."""
        out, total, start, most, end = [], 0.0, 0, 0.0, 0
        for n, x in enumerate([*self.ratios(run).tolist(), -float("inf")]):
            if out and n < out[-1][1]:  # inside the last stretch, which was carried to its border
                start = end = n + 1
                continue
            total += x
            if total > most:
                most, end = total, n + 1
            elif total < most - self.bound or total <= 0:
                if most > self.bound and end - start >= LEAST_CHARS:
                    out.append(_to_borders(run, start, end))
                total, most, start, end = 0.0, 0.0, n + 1, n + 1
        return out


def _to_borders(run: str, start: int, end: int) -> tuple[int, int]:
    """The stretch with the letters and digits right before and after it."""
    while start and run[start - 1].isalnum():
        start -= 1
    while end < len(run) and run[end].isalnum():
        end += 1
    return start, end


@lru_cache(maxsize=4)
def model(vocabulary: str) -> MarkovRatio:
    """The worker's model; its samples are fixed by the vocabulary file and the constants above."""
    known, unseen = vocabulary_words(vocabulary)
    return MarkovRatio(labelled_samples(known, SAMPLES, SEED), labelled_samples(unseen, HELD_OUT, SEED + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


#: A run of hex characters is matched whole, so its length may as well be asked of the pattern.
_LONG_HEX = re.compile(HEX.pattern[:-1] + "{24,}")


def _joined(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The union of spans that come by start; the kind is that of the first."""
    out: list[tuple[int, int, str]] = []
    for start, end, kind in spans:
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1]), out[-1][2]
        else:
            out.append((start, end, kind))
    return out


def random_spans(text: str, base: list[tuple[int, int, str]], ratio: MarkovRatio) -> list[tuple[int, int, str]]:
    """Stretches that the models call random, unless one fixed pattern or a union of them holds the
    whole of it.  A stretch may reach over the ends of a fixed pattern's span, which stays as it is."""
    out, taken, at = [], _joined(base), 0
    for m in CANDIDATE.finditer(text):
        for s, e in ratio.stretches(m.group()):
            s, e = m.start() + s, m.start() + e
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if at == len(taken) or s < taken[at][0] or e > taken[at][1]:
                out.append((s, e, "random"))
    return out


def all_spans(text: str, ratio: MarkovRatio) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(base + random_spans(text, base, ratio), key=lambda x: (x[0], KINDS.index(x[2])))


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of docs.

    Offsets are code points.  Null and empty texts have no spans, an empty `spans` and the digest
    of the empty string.  Whole texts are read in time linear in their length.  Of equal starts the
    kinds come in the order of KINDS.  A null doc_id stays null, rows that repeat stay repeated, an
    empty table gives no rows; only doc_id and text are read.
    """
    schema = StructType([docs.schema["doc_id"], *(StructField(c, LongType()) for c in ("n_assign", "n_access", "n_hex")), StructField("base_sha256", StringType()), StructField("spans", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model(vocabulary)
        for b in slices(batches):
            cols = [], [], [], [], []
            for text in texts_of(b.column(1)):
                spans = all_spans(text, ratio)
                base = [s for s in spans if s[2] != "random"]
                row = (*(sum(k == x[2] for x in base) for k in KINDS[:3]), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans))
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(text: str, ratio: MarkovRatio) -> str:
    """text with every span (overlaps joined) replaced by [KIND] of its first span."""
    out, at = [], 0
    for start, end, kind in _joined(all_spans(text, ratio)):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs with all secrets in text replaced; n_chars, where there is one, follows the new text.
    Null texts stay null; all other columns and all rows, repeated ones and those with a null doc_id
    among them, are kept as they are; an empty table stays empty."""
    schema = docs.schema
    at = schema.names.index("text")
    count = schema.names.index("n_chars") if "n_chars" in schema.names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model(vocabulary)
        for b in slices(batches):
            old = b.column(at).to_pylist()
            new = [None if t is None else redacted(t, ratio) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if count is not None:
                kept = b.column(count).to_pylist()
                columns[count] = pa.array([k if a == t else len(t) for a, t, k in zip(old, new, kept)], b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, schema)
