"""Best-fit packing of documents into fixed-length sequences by linear grouping.

Lengths are integers from 1 to the sequence size, so the whole corpus is one histogram of at most
`size` rows, and a packing is a bounded list of bin kinds with counts.  The plan is made from the
histogram alone; documents then find their place by arithmetic on their rank within their length.

1. Large lengths (over a border) are cut into groups of equal cardinality and rounded up to the
   largest of their group.
2. The few-size problem is solved over configurations by column generation (simplex on the
   configurations, knapsack for new ones); configuration counts are rounded down.
3. Actual documents replace the rounded ones.  Whatever rounding down left over is grouped and
   solved again, until no configuration has a whole count; the last few join the rest.
4. The rest, mostly small documents, is placed by best fit, longest first, where bins of the same
   kind are filled together.

How many groups, and which lengths are large, is chosen from the histogram: the settings of TRIALS
are planned in order until one reaches the lower bound (all tokens over the size), and the plan with
the fewest sequences holds.  Every plan is one of linear grouping.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer, pre_tokenizers

from .common import bytes_of, slices, stash

SIZE = 4096
#: (number of groups, parts, reserve): lengths over size / parts are large, and configurations leave a
#: reserve of so many tokens, which small documents fill better than they fill the slack of rounding.
TRIALS = ((64, 3, 256), (64, 3, 128), (64, 3, 512), (64, 3, 0), (32, 6, 0), (256, 3, 0))
#: Rows of one length that are ranked together; longer classes are split by hash into more buckets.
BUCKET_ROWS = 100_000
CACHE_WORDS = 700_000
CACHE_BYTES = 48


#: How the tokenizer's pattern cuts a lower-case ASCII word.
PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordIds:
    """Token ids of whole texts, equal to the tokenizer's, with words remembered.

    The tokenizer's own normaliser drops white space and its pieces never cross it, so a text may
    be cut at the six ASCII white space bytes and each word encoded once.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.memory: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        # The same merges without normaliser and pattern, for words that these leave as they are.
        self.ascii, self.light = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True

    def __call__(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = text.split()
        found = list(map(self.memory.get, words))
        if None in found:
            fresh = self._fresh({w for w, v in zip(words, found) if v is None})
            if len(self.memory) + len(fresh) > CACHE_WORDS:
                self.memory.clear()
            self.memory.update((w, v) for w, v in fresh.items() if len(w) <= CACHE_BYTES)
            found = [fresh[w] if v is None else v for w, v in zip(words, found)]
        return b"".join(found)

    def _fresh(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Words of plain ASCII, or of letters up to Latin Extended-A with stops and commas after
        them, are cut as the tokenizer's pattern cuts them; runs of letters are then encoded in one
        call and remembered, as are the other runs.  All else goes through the whole tokenizer."""
        out, split, cores, tails = {}, {}, self.cores, self.tails
        for w in words:
            word = w.decode()
            if word.isascii() and "<|" not in word:
                split[w] = PATTERN.findall(word.lower())
                continue
            core = word.rstrip(".,")
            if core.isalpha() and max(core) <= "\u017f" and "\u0130" not in core:
                split[w] = [core.lower(), word[len(core):]] if len(core) < len(word) else [core.lower()]
            else:
                out[w] = self._whole(word)
        if len(cores) > CACHE_WORDS:
            cores.clear()
        if len(tails) > CACHE_WORDS:
            tails.clear()
        runs = {r for pieces in split.values() for r in pieces if r not in cores and r not in tails}
        for r in runs:
            if not r.isalpha():
                tails[r] = self._whole(r)
        self._encode_cores([r for r in runs if r.isalpha() and r.isascii()], self.ascii)
        self._encode_cores([r for r in runs if r.isalpha() and not r.isascii()], self.light)
        for w, pieces in split.items():
            out[w] = b"".join([cores[r] if r in cores else tails[r] for r in pieces])
        return out

    def _encode_cores(self, runs: list[str], tokenizer: Tokenizer) -> None:
        if runs:
            ids = np.array(tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
            packed, at = ids.tobytes(), 0
            # the last token of a run, and no other, carries the word-end mark
            for r, end in zip(runs, (np.flatnonzero(self.ends[ids]) + 1).tolist()):
                self.cores[r] = packed[4 * at:4 * end]
                at = end

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


_tokenizers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's encoder of a tokenizer file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.  A document is its ids and the
    end id; only documents over `size` are cut, every `size` tokens."""
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"]
    schema = StructType([kind, StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        for b in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for n, text in enumerate(bytes_of(b.column(1))):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    row.append(n)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- the plan, from the histogram

Kind = tuple[tuple[int, int], ...]  # (length, how many of it in one bin), longest first


def configurations(sizes: list[int], counts: list[int], size: int) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of the few-size problem: configurations (items per size) and counts."""
    k = len(sizes)
    columns = [np.zeros(k) for _ in range(k)]
    for i, s in enumerate(sizes):
        columns[i][i] = max(1, min(size // s, counts[i]))
    demand = np.array(counts, float)
    basis = np.array(columns).T
    for _ in range(3 * k + 100):  # any basis will do, so a degenerate end is not worth its time
        inverse = np.linalg.inv(basis)
        amounts, prices = inverse @ demand, np.ones(k) @ inverse
        new, worth = _knapsack(sizes, counts, prices, size)
        bins = amounts.sum()
        if bins - bins / max(worth, 1.0) < max(0.2, 2e-5 * bins):  # bins / worth is a lower bound of the optimum
            break
        step = inverse @ new
        ratios = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratios))
        if not np.isfinite(ratios[leave]):
            break
        basis[:, leave] = new
    amounts = np.linalg.solve(basis, demand)
    return [(np.rint(basis[:, j]).astype(int), a) for j, a in enumerate(amounts) if a > 1e-9]


def _knapsack(sizes: list[int], counts: list[int], prices: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """The configuration of greatest price.  Large sizes fit only a few times, so the table has
    one layer per size and copy."""
    best = np.zeros(size + 1)
    taken = []
    for i, s in enumerate(sizes):
        layer = np.zeros(size + 1, np.int16)
        if prices[i] > 0:
            base = best.copy()
            for n in range(1, min(size // s, counts[i]) + 1):
                other = np.full(size + 1, -1.0)
                other[n * s:] = base[:size + 1 - n * s] + n * prices[i]
                better = other > best + 1e-12
                best = np.where(better, other, best)
                layer[better] = n
        taken.append(layer)
    out, room = np.zeros(len(sizes)), size
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = taken[i][room]
        room -= int(out[i]) * sizes[i]
    return out, float(prices @ out)


def _grouped(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """(length, count) runs, longest first, cut into groups of equal cardinality."""
    total = sum(c for _, c in large)
    per, out, now, held = max(1, -(-total // groups)), [], [], 0
    for length, count in large:
        while count:
            take = min(count, per - held)
            now.append([length, take])
            held += take
            count -= take
            if held == per:
                out.append(now)
                now, held = [], 0
    return out + [now] if now else out


def _place_configurations(histogram: dict[int, int], size: int, groups: int, least: int, reserve: int = 0) -> tuple[list[list], dict[int, int]]:
    """Bins of the rounded problems filled with actual lengths, and the lengths that are left."""
    most = size - reserve
    left = {s: c for s, c in histogram.items() if least <= s < size}
    bins = [[c, Counter({s: 1})] for s, c in left.items() if s > most]  # no partner, but room for small ones
    rest = {s: c for s, c in histogram.items() if s not in left}
    left = {s: c for s, c in left.items() if s <= most}
    while left:
        made, left = _one_round(left, most, groups)
        bins += made
        if not made:
            break
    for s, c in left.items():
        rest[s] = rest.get(s, 0) + c
    return bins, rest


def _one_round(large: dict[int, int], size: int, groups: int) -> tuple[list[list], dict[int, int]]:
    """Round up within groups, solve, and fill the whole configurations with actual lengths."""
    merged: dict[int, list[list[int]]] = {}
    for q in _grouped(sorted(large.items(), reverse=True), groups):  # groups with the same rounded size are one size
        merged.setdefault(q[0][0], []).extend(q)
    sizes = list(merged)
    counts = [sum(c for _, c in merged[s]) for s in sizes]
    bins: list[list] = []
    for config, amount in configurations(sizes, counts, size):
        n = int(amount + 1e-9)
        slots = [i for i, k in enumerate(config) for _ in range(k)]
        if n and slots:
            bins += _filled([(_taken(merged[sizes[i]], n)) for i in slots], n)
    left: dict[int, int] = {}
    for queue in merged.values():
        for s, c in queue:
            left[s] = left.get(s, 0) + c
    return bins, left


def _taken(queue: list[list[int]], need: int) -> list[list[int]]:
    """The first `need` pieces of a group's queue as (length, count) runs; length 0 is an empty slot."""
    out = []
    while need and queue:
        take = min(need, queue[0][1])
        out.append([queue[0][0], take])
        queue[0][1] -= take
        need -= take
        if not queue[0][1]:
            queue.pop(0)
    return out + [[0, need]] if need else out


def _filled(runs: list[list[list[int]]], n: int) -> list[list]:
    """`n` bins with one run of lengths per slot; bins between two borders of any run are of one kind."""
    bins = []
    while n:
        step = min(r[0][1] for r in runs)
        if kind := Counter(r[0][0] for r in runs if r[0][0]):
            bins.append([step, kind])
        n -= step
        for r in runs:
            r[0][1] -= step
            if not r[0][1]:
                r.pop(0)
    return bins


def _best_fit(bins: list[list], rest: dict[int, int], size: int) -> list[tuple[int, Kind]]:
    """Best fit of the rest, longest first, over bins grouped by the room they have left."""
    by_room: dict[int, list[list]] = {}
    for count, kind in bins:
        by_room.setdefault(size - sum(s * k for s, k in kind.items()), []).append([count, kind])
    rooms = sorted(by_room)

    def put(room: int, entry: list) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(entry)

    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                q = size // length
                full, odd = divmod(left, q)
                if full:
                    put(size - q * length, [full, Counter({length: q})])
                if odd:
                    put(size - odd * length, [1, Counter({length: odd})])
                left = 0
                continue
            room = rooms[at]
            entry = by_room[room][-1]
            q = room // length
            take = min(entry[0], left // q)
            if take:
                put(room - q * length, [take, entry[1] + Counter({length: q})])
                left -= take * q
            else:
                take = 1
                put(room - left * length, [1, entry[1] + Counter({length: left})])
                left = 0
            entry[0] -= take
            if not entry[0]:
                by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(bisect.bisect_left(rooms, room))
    return [(c, tuple(sorted(k.items(), reverse=True))) for entries in by_room.values() for c, k in entries]


def plan(histogram: dict[int, int], size: int = SIZE, trials: tuple[tuple[int, int, int], ...] = TRIALS) -> list[tuple[int, Kind]]:
    """Bin kinds with counts that hold exactly the histogram's pieces."""
    bound = -(-sum(s * c for s, c in histogram.items()) // size)
    best, fewest = [], None
    for groups, parts, reserve in trials:
        made = _best_fit(*_place_configurations(histogram, size, groups, size // parts + 1, reserve), size)
        n = sum(c for c, _ in made)
        if fewest is None or n < fewest:
            best, fewest = made, n
        if fewest == bound:
            break
    return best


def places(kinds: list[tuple[int, Kind]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: the first rank, the first sequence, how many of the length
    one sequence holds, and the offset of the first.  Sorted by (length, first rank)."""
    rows, base, seen = [], 0, Counter()
    for count, kind in kinds:
        offset = 0
        for length, k in kind:
            rows.append((length, seen[length], base, k, offset))
            seen[length] += count * k
            offset += length * k
        base += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "base", "each", "offset"), table.T))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, trials: tuple[tuple[int, int, int], ...] = TRIALS) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset.

    Null and empty texts are the end id alone, so they have one piece of one token.  A text of any
    length is tokenized whole and cut.  Rows that repeat are packed each.  No documents give no rows.
    Which of the pieces of equal length takes which place is open, as they are alike to the plan; the
    places of a length are dealt by hash buckets of BUCKET_ROWS and then by doc_id and piece.  Only
    the histogram (at most `size` rows) and its plan reach the driver; only doc_id and text are read.
    """
    found = stash(pieces_of(docs, tokenizer, end_id, size), "pieces")
    histogram = {r[0]: r[1] for r in found.groupBy("length").count().collect()}
    table = places(plan(histogram, size, trials))
    buckets = {n: -(-c // BUCKET_ROWS) for n, c in histogram.items() if c > BUCKET_ROWS}
    n_buckets = F.lit(1)
    if buckets:
        n_buckets = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in buckets.items() for x in kv)), F.col("length")), F.lit(1))
    salted = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), n_buckets))
    sizes = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    first = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("first"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(first, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = StructType([*(f for f in ranked.schema if f.name != "rank"), StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        starts = np.searchsorted(t["length"], np.arange(size + 2))
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            row = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine = length == n
                s, e = starts[n], starts[n + 1]
                row[mine] = s + np.searchsorted(t["rank"][s:e], rank[mine], side="right") - 1
            within = rank - t["rank"][row]
            each = t["each"][row]
            sequence = t["base"][row] + within // each
            offset = t["offset"][row] + within % each * length
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], schema=pa.schema([*(b.schema.field(i) for i in range(5)), ("sequence_id", pa.int64()), ("offset", pa.int64())]))

    return ranked.mapInArrow(locate, schema)
