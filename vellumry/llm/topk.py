"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integer weights per dimension (a term).  Queries and candidates are dealt into
blocks; a task holds one query block and one candidate block, turns the candidates into postings
(per term: candidate positions and weights), and scatters the weighted postings of each term into
the dense score arrays of ARRAYS queries at once.  Partition selection keeps the k best of each
block, and the blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

TOP = 20
SCALE = 64
#: Rows of a query block and of a candidate block that meet in one task.
QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 4096
#: Queries whose dense score arrays are held at once.
ARRAYS = 8
#: Scores are held within this range, which leaves a mark for a query's own row.
MOST = 2 ** 63 - 1


def weights(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and its integer weights; vectors that are null or hold null, NaN or infinite
    components are left out.  Weights beyond the range of a long saturate."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(sound).select("vec_id", whole.alias("w"))


def _matrix(rows: list) -> np.ndarray:
    """Weights as a matrix, zero where a shorter vector lacks a term."""
    sizes = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(rows) if sizes.sum() else 0
    return out


def accumulate(query_rows: np.ndarray, queries: list, rows: np.ndarray, ids: np.ndarray, candidates: list, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `top` best candidates of each query, as (position of the query, candidate id, score).

    Rows name queries and candidates; a candidate of the query's own row is left out.  Candidates
    are put in ascending id, so an earlier position wins a tie.  Shorter vectors count as zero in
    the terms they lack.  Scores are exact; those beyond the range of a long saturate.
    """
    order = np.lexsort((rows, ids))
    rows, ids = rows[order], ids[order]
    c, q = _matrix([candidates[i] for i in order]), _matrix(queries)
    terms = min(c.shape[1], q.shape[1])
    bound = float(np.abs(c.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * max(terms, 1)
    kind = np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else object  # exact each: sums are whole numbers
    postings = []
    for t in range(terms):
        where = np.flatnonzero(c[:, t])
        if 2 * len(where) > len(ids):  # a long list is scattered in order, zeros and all
            postings.append((t, None, c[:, t].astype(kind)))
        elif len(where):
            postings.append((t, where, c[where, t].astype(kind)))
    place = {int(r): n for n, r in enumerate(rows)}
    out: tuple[list, list, list] = ([], [], [])
    room = np.empty((ARRAYS, len(ids)), kind)
    for q0 in range(0, len(query_rows), ARRAYS):
        part = q[q0:q0 + ARRAYS].astype(kind)
        scores, spare = np.zeros((len(part), len(ids)), kind), room[:len(part)]
        for t, where, values in postings:
            using = np.flatnonzero(part[:, t])
            if where is None and 2 * len(using) > len(part):
                scores += np.multiply(part[:, t, None], values, out=spare)
            elif len(using):
                at = (using, slice(None)) if where is None else np.ix_(using, where)
                scores[at] += part[using, t, None] * values
        whole = (np.clip(scores, -MOST, MOST) if kind is object else scores).astype(np.int64)
        for n, row in enumerate(query_rows[q0:q0 + ARRAYS].tolist()):
            own = place.get(row)
            if own is not None:
                whole[n, own] = -MOST - 1
            keep = min(top, len(ids) - (own is not None))
            if not keep:
                continue
            border = np.partition(whole[n], len(ids) - keep)[len(ids) - keep]  # then ties enter by the smallest id
            best = np.concatenate([np.flatnonzero(whole[n] > border), np.flatnonzero(whole[n] == border)[:keep]])
            best = best[np.lexsort((best, ~whole[n, best]))][:keep]  # ~x falls as x grows, without overflow
            out[0].append(np.full(keep, q0 + n, np.int64))
            out[1].append(ids[best])
            out[2].append(whole[n, best])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches; the last column's lists stay arrays."""
    for b in batches:
        *plain, lists = b.columns
        cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for *row, s, e in zip(*(c.to_pylist() for c in plain), cuts.tolist(), cuts[1:].tolist()):
            yield *row, flat[s:e]


def top_k(vectors: DataFrame, every: int = 20, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose vec_id is divisible by `every` its `top`
    best other rows by integer inner product, ties to the smaller vec_id.

    All candidates if there are fewer; a query without other rows has none.  Rows that repeat a
    vec_id are queries each and candidates each, for one another too: only a query's own row is left
    out.  Null ids and vectors with null or non-finite components take no part; an empty vector
    scores zero.  No vectors give no rows.  Queries meet candidates in blocks by an equi-join on the
    block pair, never by a cross join; the rows are numbered in a stored table, so that a task that
    runs again sees the same numbers.
    """
    known = stash(weights(vectors).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    queries = known.where(F.col("vec_id") % every == 0)
    n, m = known.count(), queries.count()
    q_blocks, c_blocks = max(1, -(-m // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(q_blocks * c_blocks, 20_000))
    block = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    every_block = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select(F.lit(0).alias("side"), block(q_blocks).alias("qb"), every_block(c_blocks).alias("cb"), "row", "vec_id", "w")
    right = known.select(F.lit(1).alias("side"), every_block(q_blocks).alias("qb"), block(c_blocks).alias("cb"), "row", "vec_id", "w")
    # a fixed number of partitions: the work of a block pair is far more than its bytes say
    dealt = left.unionByName(right).repartition(parts, "qb", "cb").sortWithinPartitions("qb", "cb", "side", "row")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each run of equal (qb, cb) is a query block and then a candidate block."""
        for _, held in groupby(_rows(batches), key=lambda r: r[:2]):
            sides: tuple[list, list] = ([], [])
            for _, _, side, row, vec_id, w in held:
                sides[side].append((row, vec_id, w))
            if not sides[0] or not sides[1]:
                continue
            (rows, ids, w), (other, names, v) = (zip(*x) for x in sides)
            at, found, score = accumulate(np.array(rows), list(w), np.array(other), np.array(names), list(v), top)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(rows)[at]), pa.array(np.array(ids)[at]), pa.array(found), pa.array(score)], ["row", "query_id", "vec_id", "score"])

    found = dealt.select("qb", "cb", "side", "row", F.col("vec_id").cast("long").alias("vec_id"), "w").mapInArrow(meet, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
