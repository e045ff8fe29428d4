"""Links between texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash at 3 bits sees few of these (about one in seven pairs from 0.8 to 1 on the test tables), so
the near-duplicate stage adds a fingerprint of SKETCH positional bytes: byte j is the low byte of
the j-th minwise hash.  It is searched like the SimHash one, by an inverted index and a tally: keys
are bands of ROWS minwise values, members of one key tally their shared positional bytes, and pairs
that may have the similarity are verified by the exact Jaccard similarity of their shingle hashes.
A pair at 0.8 shares a key with probability 0.9996; the tally has a standard error of about 0.025
and only sorts out pairs that lie five of them below.

A key's members come in order of how many texts share their keys, so the original of a group of
copies is first and takes its copies at once; only members that no earlier leader takes are compared
with all.  Links tie groups together, they are never all pairs.  In a list of up to LIST_ROWS members
whose leaders leave more than one group, all members of different groups are compared, so no link
between groups is lost.  A longer list is searched in parts that keep the leaders; if that leaves one
group, nothing is open.  Else its members are dealt anew by FURTHER single bytes of the sketch (a
pair at 0.8 shares none of them with probability 0.0003), and what is still too long and open by
pairs of blocks, each of which is again compared in full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bytes_of, release, slices, stash

WORDS = 5
SIMILARITY = 0.8
SKETCH, BANDS, ROWS = 256, 20, 5
LIST_ROWS = 1024
#: Bits of the table that tells texts without a list before a shuffle.
MARKS = 2 ** 26
#: Bytes of the sketch, beyond those of the bands, that split the lists which parts leave open.
FURTHER = tuple(range(BANDS * ROWS + 1, BANDS * ROWS + 6))
#: Shared bytes of 256 from which a pair is verified: the expectation at the similarity, less five standard errors.
TALLY = int(SKETCH * (SIMILARITY + (1 - SIMILARITY) / 256) - 5 * (SKETCH * SIMILARITY * (1 - SIMILARITY)) ** 0.5)

_rng = np.random.default_rng(17)
_MULTIPLY = (_rng.integers(0, 2 ** 63, SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2 ** 63, SKETCH, dtype=np.uint64)


def shingles(text: bytes) -> tuple[np.ndarray, bytes] | None:
    """Sorted distinct hashes of a text's shingles and the digest of its words; None if it has no
    words."""
    tokens = text.lower().split()
    if not tokens:
        return None
    joined = b" ".join(tokens)
    if len(tokens) <= WORDS:
        runs = [joined]
    else:
        ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
        starts = [0] + [e + 1 for e in ends[:-1]]
        runs = [joined[s:e] for s, e in zip(starts, ends[WORDS - 1:])]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(7)), np.uint64, len(runs))), xxhash.xxh3_128_digest(joined)


def minwise(text: bytes) -> tuple[np.ndarray, bytes] | None:
    """Minwise values (high halves, mixed) of a text's shingles and the digest of its words; None
    if it has no words."""
    made = shingles(text)
    if made is None:
        return None
    hashes, digest = made
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at:at + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return least >> np.uint64(16), digest


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest, keys and sketch of every row with words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, digest, keys, sketch = [], [], [], []
            for n, text in enumerate(bytes_of(b.column(1))):
                made = minwise(text)
                if made is None:
                    continue
                least, d = made
                row.append(n)
                digest.append(d)
                keys.append([xxhash.xxh64_intdigest(least[k * ROWS:(k + 1) * ROWS].tobytes(), k) - 2 ** 63 for k in range(BANDS)])
                # bits from the middle: low bits of a product mix badly
                sketch.append(((least >> np.uint64(20)) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "digest", "keys", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, digest binary, keys array<long>, sketch binary")


def _shingled(docs: DataFrame) -> DataFrame:
    """digest and shingle hashes (8 bytes each) of every row with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [m for m in map(shingles, bytes_of(b.column(0))) if m is not None]
            yield pa.RecordBatch.from_arrays([pa.array([d for _, d in made], pa.binary()), pa.array([h.tobytes() for h, _ in made], pa.binary())], ["digest", "hashes"])

    return docs.select("text").mapInArrow(run, "digest binary, hashes binary")


def _tie(ids: list, sketch: np.ndarray, hashes: list[np.ndarray], leaders: list[int], known: list[int], out: tuple[list, list], whole: bool = False) -> tuple[list[int], list[int]]:
    """Link the members after those whose groups are known, and return the leaders and the groups
    of all; a group is named by the position of one of its leaders.

    A member that no leader ties becomes a leader: it is compared with everything before it and
    with everything after, and tied to one member of each group it reaches.  A leader takes all
    similar later members that are free.  If the whole list is here, members of different groups are
    then compared as well, until one group is left.
    """
    done = len(known)
    free = np.ones(len(ids), bool)
    free[:done] = False
    group = np.zeros(len(ids), np.int64)  # position of the leader that took a member
    group[:done] = known
    sizes = np.array([len(h) for h in hashes])
    root = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def near(i: int, start: int, end: int) -> list[int]:
        """Members from start to end that may be similar to i, by tally and by size."""
        tally = np.count_nonzero(sketch[start:end] == sketch[i], axis=1) >= TALLY
        n = sizes[start:end]
        return (start + np.flatnonzero(tally & (np.minimum(n, sizes[i]) >= SIMILARITY * np.maximum(n, sizes[i])))).tolist()

    def similar(i: int, j: int) -> bool:
        """Whether the exact Jaccard similarity reaches the limit."""
        a, b = hashes[i], hashes[j]
        both = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
        return both / (len(a) + len(b) - both) >= SIMILARITY

    def take(i: int, start: int, end: int) -> None:
        for j in near(i, start, end):
            if (free[j] or find(int(group[j])) != find(int(group[i]))) and similar(i, j):
                out[0].append(ids[i])
                out[1].append(ids[j])
                if free[j]:
                    free[j], group[j] = False, group[i]
                else:
                    root[find(int(group[j]))] = find(int(group[i]))

    for i in leaders:
        take(i, done, len(ids))
    leaders = list(leaders)
    for i in range(done, len(ids)):
        if free[i]:
            free[i], group[i] = False, i
            leaders.append(i)
            take(i, 0, i)
            take(i, i + 1, len(ids))
    if whole:
        roots = np.array([find(int(g)) for g in group])
        led = set(leaders)  # leaders have met everybody
        for i in range(len(ids)):
            if i in led or (roots == roots[i]).all():
                continue
            for j in near(i, 0, i):
                if roots[j] != roots[i] and similar(i, j):
                    out[0].append(ids[i])
                    out[1].append(ids[j])
                    roots[roots == roots[j]] = roots[i]
        return leaders, roots.tolist()
    return leaders, [find(int(g)) for g in group]


def _search(dealt: DataFrame, most: int | None) -> DataFrame:
    """a, b and open: links of lists, and the keys of lists over `most` rows that several groups are
    left in.  dealt: key, shares, doc_id, sketch and hashes; without `most` no list is cut."""
    kind = dealt.schema["doc_id"].dataType
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("key", "shares", "doc_id", "sketch", "hashes").repartition(parts, "key").sortWithinPartitions("key", F.desc("shares"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, shingled, pivots = None, [], [], [], None
        out: tuple[list, list] = ([], [])
        open_keys: list[int] = []

        def close(last: bool) -> None:
            """Search the rows held, which are the list or a part of it."""
            nonlocal ids, held, shingled, pivots
            if ids:
                rows = np.frombuffer(b"".join(held), np.uint8).reshape(-1, SKETCH)
                if pivots is None:
                    pivots = ids, rows, shingled, *_tie(ids, rows, shingled, [], [], out, whole=last)
                else:
                    done = len(pivots[0])
                    every = pivots[0] + ids, np.vstack([pivots[1], rows]), pivots[2] + shingled
                    leaders, group = _tie(*every, pivots[3], pivots[4], out)
                    stay = [*range(done), *(i for i in leaders if i >= done)]
                    place = {i: n for n, i in enumerate(stay)}
                    pivots = [every[0][i] for i in stay], every[1][stay], [every[2][i] for i in stay], [place[i] for i in leaders], [place[group[i]] for i in stay]
                    if last and len(set(pivots[4])) > 1:
                        open_keys.append(key)
            ids, held, shingled = [], [], []

        def found() -> pa.RecordBatch:
            n, m = len(out[0]), len(open_keys)
            columns = [pa.array([*x, *[None] * m], to_arrow_type(kind)) for x in out]
            return pa.RecordBatch.from_arrays([*columns, pa.array([*[None] * n, *open_keys], pa.int64())], ["a", "b", "open"])

        for b in batches:
            for k, doc_id, sketch, hashes in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if k != key:
                    close(True)
                    key, pivots = k, None
                elif most is not None and len(ids) == most:
                    close(False)
                ids.append(doc_id)
                held.append(sketch)
                shingled.append(np.frombuffer(hashes, np.uint64))
            yield found()
            out[0].clear()
            out[1].clear()
            open_keys.clear()
        close(True)
        yield found()

    name = kind.simpleString()
    return dealt.mapInArrow(run, f"a {name}, b {name}, open long")


def _shared(keyed: DataFrame) -> DataFrame:
    """keyed (key, digest) where two or more texts have the key, with their number n and a digest of
    the list, left and right."""
    of = Window.partitionBy("key")
    half = lambda seed: F.bit_xor(F.xxhash64("digest", F.lit(seed))).over(of)
    return keyed.select("key", "digest", F.count("*").over(of).alias("n"), half(1).alias("left"), half(2).alias("right")).where("n > 1")


def _distinct_lists(every: DataFrame) -> DataFrame:
    """key and digest of lists, one of those that hold the same texts.  Copies share most of their
    keys, and to search a list again finds the same links."""
    same = ["n", "left", "right"]
    first = every.groupBy(*same).agg(F.min("key").alias("key"))
    return every.join(first, ["key", *same], "left_semi").select("key", "digest")


def _maybe(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """docs whose doc_id may be one of listed: all that are, and few others.  A table of MARKS bits,
    the same size for any input, goes to the tasks, so that other texts need not be shuffled."""
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    words = listed.select(mark.alias("m")).groupBy(F.floor(F.col("m") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(m % 64 AS INT)))").alias("bits")).toArrow()
    table = np.zeros(MARKS // 64, np.int64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))
    memory: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not memory:
            memory["table"] = np.frombuffer(zlib.decompress(shared.value), np.int64)
        for b in batches:
            at = b.column(2).to_numpy()
            yield b.select([0, 1]).filter(pa.array(memory["table"][at >> 6] >> (at & 63) & 1 == 1))

    return docs.select("doc_id", "text", mark.alias("m")).mapInArrow(run, docs.select("doc_id", "text").schema)


def links(docs: DataFrame) -> DataFrame:
    """Links (a, b) of doc_ids; of texts with the same words only the smallest doc_id takes part.

    Null texts, texts without words and rows without a doc_id have no links.  Rows that repeat a
    doc_id take part with each of their texts, so two texts of one id may link it to itself.  An
    empty table gives no rows; a text of any length is taken whole.
    """
    named = docs.where("doc_id is not null")
    made = stash(sketches(named), "minwise")
    kind = docs.schema["doc_id"].dataType
    texts = stash(made.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "minwise-texts")
    release(made)
    keyed = texts.select(F.explode("keys").alias("key"), "digest")
    every = stash(_shared(keyed), "minwise-keys")
    ranks = every.groupBy("digest").agg(F.sum("n").alias("shares"))
    listed = stash(texts.join(ranks, "digest").select("digest", "doc_id", "shares", "sketch"), "minwise-listed")
    release(texts)
    members = stash(_distinct_lists(every), "minwise-lists")
    release(every)
    # shingles of listed texts only: those of all would be as large as the texts
    near = _maybe(named, listed)
    full = _shingled(near.join(listed.select("doc_id").distinct(), "doc_id", "left_semi")).groupBy("digest").agg(F.first("hashes").alias("hashes"))
    known = stash(listed.join(full, "digest"), "minwise-known")
    release(listed)
    columns = ["shares", "doc_id", "sketch", "hashes"]
    first = stash(_search(members.select("key", "digest").join(known, "digest"), LIST_ROWS), "minwise-links")
    found, left = first.where("open is null").select("a", "b"), first.where("open is not null").select(F.col("open").alias("key"))
    if left.isEmpty():
        return _whole(found, members, known, first)
    byte = lambda j: F.xxhash64("key", F.lit(j), F.substring("sketch", j + 1, 1))
    rest = members.join(left.distinct(), "key", "left_semi").select("key", "digest").join(known.select("digest", "sketch"), "digest")
    split = stash(rest.select(F.explode(F.array(*map(byte, FURTHER))).alias("key"), "digest"), "minwise-split")
    second = stash(_search(split.join(known, "digest"), LIST_ROWS), "minwise-links")
    found, left = found.unionByName(second.where("open is null").select("a", "b")), second.where("open is not null").select(F.col("open").alias("key"))
    if left.isEmpty():
        return _whole(found, members, known, first, split, second)
    rest = split.join(left.distinct(), "key", "left_semi").join(known, "digest")
    blocks = rest.groupBy("key").agg(F.ceil(F.count("*") * 2 / LIST_ROWS).cast("int").alias("n"))
    mine, other = F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"), F.col("other")
    pairs = rest.join(blocks, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    third = _search(pairs.select(F.xxhash64("key", F.least("mine", other), F.greatest("mine", other)).alias("key"), *columns), None)
    return _whole(found.unionByName(third.select("a", "b")), members, known, first, split, second)


def _whole(found: DataFrame, *inputs: DataFrame) -> DataFrame:
    """The distinct links as a stored table; what they were made from goes."""
    kept = stash(found.distinct(), "minwise-found")
    release(*inputs)
    return kept
