"""SimHash near-duplicates through an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they
share at least 5 bytes position by position: the guaranteed minimum.  A posting list for a single
positional byte would hold 1/256 of all fingerprints, which makes the tally quadratic.  The index
keys are therefore groups of four positional bytes: the 14 blocks of the Steiner system S(3, 4, 8).
The complement of any five positions is a triple, and exactly one block avoids a given triple, so
every pair with five shared bytes meets in at least one posting list and no pair is lost.  Inside a
list the shared positional bytes of a pair are tallied, pairs below five are discarded, and the
rest is verified by its Hamming distance.

Lists are searched breadth first and give a spanning forest, never all pairs.  A list with more
than `list_rows` fingerprints is split by a fifth byte position (still lossless, as five bytes are
shared), and what is still too long is linked through Hamming balls over the three bytes left:
x and y are within 3 bits exactly if a word z has x at distance 0 or 1 and y at distance up to 2,
and a z has at most 301 neighbours, so these groups are bounded by geometry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minwise
from .common import bytes_of, release, slices, stash
from .components import components

MAX_BITS = 3
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
#: Fingerprints of one posting list that are searched directly in one task.
LIST_ROWS = 2048


def steiner_blocks() -> list[tuple[int, ...]]:
    """S(3, 4, 8): the 4-subsets of 0..7 whose binary labels add up to zero without carry."""
    return [b for b in combinations(range(BYTES), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]


BLOCKS = steiner_blocks()


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one UTF-8 text as an unsigned integer (no words: 0)."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        shingles = [joined]
    else:
        ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
        starts = [0] + [e + 1 for e in ends[:-1]]
        shingles = [joined[s:e] for s, e in zip(starts, ends[words - 1:])]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long (the same 64 bits) for every row of docs."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prints = np.array([fingerprint(t, words) for t in bytes_of(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["doc_id", "fp"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("doc_id", kind), StructField("fp", LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _byte(i: int) -> F.Column:
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def _packed(positions: tuple[int, ...], tag: int) -> F.Column:
    key = F.lit(tag).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def _neighbours(x: np.uint64, others: np.ndarray) -> np.ndarray:
    """Count filtering and verification of one fingerprint against an array of others."""
    diff = others ^ x
    shared = (diff.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    keep = shared >= MIN_SHARED
    keep[keep] = np.bitwise_count(diff[keep]) <= MAX_BITS
    return keep


def spanning_forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of links among distinct fingerprints."""
    left, edges = np.sort(members), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _neighbours(x, left)
            if near.any():
                found = left[near]
                edges.extend((x, y) for y in found)
                queue.extend(found)
                left = left[~near]
    return edges


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Groups of equal keys from key-sorted batches as (key, fingerprints, hot).  A group with
    more than `most` rows comes in parts, all marked hot, so memory stays bounded."""
    key, parts, rows, hot = None, [], 0, False
    for b in batches:
        keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
            if e == s:
                continue
            if keys[s] != key:
                if rows:
                    yield key, np.concatenate(parts), hot
                key, parts, rows, hot = keys[s], [], 0, False
            parts.append(fps[s:e])
            rows += e - s
            if rows > most:
                yield key, np.concatenate(parts), True
                parts, rows, hot = [], 0, True
    if rows:
        yield key, np.concatenate(parts), hot


def _linker(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, hot = [], [], []
        for key, fps, is_hot in _runs(batches, most):
            if is_hot:
                a.extend([int(key)] * len(fps))
                b.extend(fps.tolist())
                hot.extend([True] * len(fps))
            elif len(fps) > 1:
                edges = spanning_forest(fps.view(np.uint64))
                pairs = np.array(edges, np.uint64).view(np.int64).reshape(-1, 2)
                a.extend(pairs[:, 0].tolist())
                b.extend(pairs[:, 1].tolist())
                hot.extend([False] * len(pairs))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(hot, pa.bool_())], ["a", "b", "hot"])
                a, b, hot = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(hot, pa.bool_())], ["a", "b", "hot"])

    return run


def _dealt(keyed: DataFrame) -> DataFrame:
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key", "fp")


def ball_masks(bits: int) -> np.ndarray:
    """XOR masks of weight 0 to 2 over `bits` bits, the light ones (0 and 1) first."""
    ones = [1 << i for i in range(bits)]
    return np.array([0, *ones, *(a | b for a, b in combinations(ones, 2))], np.int64)


def _ball_links(hot: DataFrame) -> DataFrame:
    """Links among members of lists that share five positional bytes, through Hamming balls."""
    masks = ball_masks(24)
    light = 25

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rest, key, fp = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            n = len(fp)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(key, len(masks))), pa.array((rest[:, None] ^ masks[None, :]).ravel()),
                pa.array(np.tile(np.arange(len(masks)) >= light, n)), pa.array(np.repeat(fp, len(masks)))], ["key", "z", "far", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None  # rows of one (key, z) come together, those within one bit first
        for b in batches:
            a, c = [], []
            for key, z, far, fp in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (key, z) != at:
                    at, centre = (key, z), None if far else fp
                elif centre is not None:
                    a.append(centre)
                    c.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    rest = F.lit(0).cast("long")
    for i in range(3):  # the three positions outside the block and the fifth position, packed
        rest = F.shiftleft(rest, 8).bitwiseOR(F.element_at(F.col("left"), i + 1))
    left = F.lit(None).cast("array<bigint>")
    for n, block in enumerate(BLOCKS):
        for fifth in (p for p in range(BYTES) if p not in block):
            others = [p for p in range(BYTES) if p not in block and p != fifth]
            tag = n * BYTES + fifth
            left = F.when(F.shiftrightunsigned("key", 40) == tag + 1, F.array(*(_byte(p) for p in others))).otherwise(left)
    masked = hot.select("key", "fp", left.alias("left")).select(rest.alias("rest"), "key", "fp")
    parts = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread_out = masked.mapInArrow(spread, "key long, z long, far boolean, fp long")
    return spread_out.repartition(parts, "key", "z").sortWithinPartitions("key", "z", "far", "fp").mapInArrow(link, "a long, b long").distinct()


def links(prints: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links (a, b) that connect exactly what all pairs within MAX_BITS would connect.

    prints: one distinct non-null long per row in column fp.  The result is already stored.
    """
    keys = F.array(*(_packed(block, n + 1) for n, block in enumerate(BLOCKS)))
    first = stash(_dealt(prints.select(F.explode(keys).alias("key"), "fp")).mapInArrow(_linker(list_rows), "a long, b long, hot boolean"), "simhash-lists")
    found = first.where("not hot").select("a", "b")
    hot = first.where("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if hot.isEmpty():
        return found
    deeper = F.lit(None).cast("array<bigint>")
    for n, block in enumerate(BLOCKS):
        rest = [p for p in range(BYTES) if p not in block]
        deeper = F.when(F.shiftrightunsigned("key", 32) == n + 1, F.array(*(_packed((*block, p), n * BYTES + p + 1) for p in rest))).otherwise(deeper)
    fifth = hot.select(F.explode(deeper).alias("key"), "fp")
    second = stash(_dealt(fifth).mapInArrow(_linker(list_rows), "a long, b long, hot boolean"), "simhash-split-lists")
    found = found.unionByName(second.where("not hot").select("a", "b"))
    hot = second.where("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if hot.isEmpty():
        return found
    return found.unionByName(stash(_ball_links(hot), "simhash-balls"))


def near_duplicates(docs: DataFrame, words: int = 3, list_rows: int = LIST_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over
    links of at most 3 differing bits, for every row of docs.

    Null and empty texts have the fingerprint zero and link like any other.  Repeated rows stay
    repeated.  A null doc_id never becomes a component_id unless its component has no other.
    Only doc_id and text are read, so further columns cannot clash.
    """
    prints = stash(fingerprints(docs, words), "simhash-prints")
    per_print = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(prints.select("fp").distinct(), list_rows))
    rooted = per_print.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stash(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(least, "root").select("fp", "component_id")
    out = prints.join(of_print, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest doc_id stays.

    Groups are the components of near_duplicates() joined by the links of minwise.links(), which
    sees the copies from a similarity of 0.8 on that 3 bits of SimHash do not.  Rows are numbered in
    a stored table and judged by their texts: unlike texts that share a doc_id both stay, rows
    without a doc_id are copies or originals like any other (a row with one stays before them), and
    of rows that are the same one stays.  Null, empty and blank texts are copies of one another.  An
    empty table stays empty; all columns are kept as they are.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = stash(docs.select(F.monotonically_increasing_id().alias("row"), whole), "rows")
    texts = rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))
    of = stash(near_duplicates(texts, words).select("doc_id", "component_id"), "simhash-components")
    by = lambda name: of.select(F.col("doc_id").alias(name), F.col("component_id").alias(f"_{name}"))
    wide = minwise.links(texts)
    edges = wide.join(by("a"), "a").join(by("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    labels = components(edges)
    release(wide)
    groups = of.join(labels, F.col("component_id") == F.col("node"), "left").select(F.col("doc_id").alias("row"), F.coalesce("root", "component_id").alias("g"))
    names = rows.select("row", F.col("doc.doc_id").alias("doc_id"))
    first = groups.join(names, "row").groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row"))["row"].alias("row"))
    return rows.join(first, "row", "left_semi").select("doc.*")
