"""Token counts as delta-maintained rollups.

Totals by (source, lang, tokenizer) are additive, so a change feed is enough to maintain them: an
insert adds its counts, a delete subtracts the counts it was entered with, and a revision subtracts
the old and adds the new.  A batch of changes is reduced to one signed row per group and committed
under its batch id; committing an id again changes nothing, so a retried job cannot count twice, and
committing other content under it is an error.

Layout of a rollup folder: a batch's signed sums are written below `pending/` and renamed to
`delta/<batch id>/` when they are complete.  The rename is the commit: it fails where the name is
taken, so of two writers with one batch id one counts, and no marker file is needed.  `base/<n>/`
holds compacted totals together with the ids and digests of the batches in them; a base replaces the
one before and is renamed into place in the same way.  Stores whose rename is no single step need a
single writer.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bytes_of, release, slices, stash, texts_of

KEYS = ("source", "lang", "tokenizer")
SUMS = ("documents", "tokens")
INSERT, DELETE, REVISE = "insert", "delete", "revise"
WORDS = "words-1"
BYTE_BPE = "byte_bpe_50k-1"

_encodings: dict[str, tiktoken.Encoding] = {}


def byte_bpe(path: str, pattern: str) -> tiktoken.Encoding:
    """The worker's encoding from a file of ranks (base64 token, rank)."""
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def counted(docs: DataFrame, bpe_path: str | None, pattern: str | None = None) -> DataFrame:
    """source, lang, tokenizer, estimate and tokens for every row of docs and tokenizer version.

    Words are runs of other characters than the six ASCII white space characters.  Without
    bpe_path only words are counted.  estimate is a quarter of the text's code points, rounded up.
    Null and empty texts have no tokens.
    """
    text = F.coalesce("text", F.lit(""))
    keys = F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")
    guess = F.ceil(F.length(text) / 4).cast("long").alias("estimate")
    if bpe_path is None:
        words = F.regexp_count(text, F.lit("[^ \\t-\\r]+"))
        return docs.select(*keys, F.lit(WORDS).alias("tokenizer"), guess, words.cast("long").alias("tokens"))
    schema = StructType([*(StructField(k, StringType()) for k in KEYS), StructField("estimate", LongType()), StructField("tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_bpe(bpe_path, pattern)
        for b in slices(batches):
            words = [len(t.split()) for t in bytes_of(b.column(3))]
            pieces = [len(encoding.encode_ordinary(t)) for t in texts_of(b.column(3))]
            for name, tokens in ((WORDS, words), (BYTE_BPE, pieces)):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([name] * len(tokens), pa.string()), b.column(2), pa.array(tokens, pa.int64())], schema=pa.schema([("source", pa.string()), ("lang", pa.string()), ("tokenizer", pa.string()), ("estimate", pa.int64()), ("tokens", pa.int64())]))

    return docs.select(*keys, guess, text.alias("text")).mapInArrow(run, schema)


def changes(rows: DataFrame, kind: str, before: str | None = None) -> DataFrame:
    """A change feed from counted rows: all of one kind, `before` naming the old count column."""
    old = F.col(before) if before else F.lit(None).cast("long")
    new = F.lit(None).cast("long") if kind == DELETE else F.col("tokens")
    return rows.select(*KEYS, F.lit(kind).alias("change"), (F.col("tokens") if kind == DELETE and not before else old).alias("old_tokens"), new.alias("new_tokens"))


def signed_sums(feed: DataFrame) -> DataFrame:
    """One signed row per group.  The aggregation is partial on the map side, so a source with a
    third of all rows costs one row per task.  Null counts add zero; null keys are a group."""
    documents = F.when(F.col("change") == INSERT, 1).when(F.col("change") == DELETE, -1).otherwise(0)
    new = F.when(F.col("change") != DELETE, F.coalesce("new_tokens", F.lit(0))).otherwise(0)
    old = F.when(F.col("change") != INSERT, F.coalesce("old_tokens", F.lit(0))).otherwise(0)
    return feed.groupBy(*KEYS).agg(F.sum(documents).cast("long").alias("documents"), F.sum(new - old).cast("long").alias("tokens"))


class Rollup:
    """A rollup folder.  All access goes through Spark and the Hadoop file system, so any store
    that Spark can write will do."""

    SCHEMA = StructType([*(StructField(k, StringType()) for k in KEYS), *(StructField(s, LongType()) for s in SUMS)])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _publish(self, part: str, name: str) -> bool:
        """Rename a complete folder to its name; False (and the folder goes) if the name is taken."""
        fs, source = self._fs(f"{self.path}/{part}")
        _, target = self._fs(f"{self.path}/{name}")
        fs.mkdirs(target.getParent())
        done = not fs.exists(target) and fs.rename(source, target)
        if done and fs.exists(self._fs(f"{self.path}/{name}/{part.rpartition('/')[2]}")[1]):  # moved into a folder made meanwhile
            fs.delete(self._fs(f"{self.path}/{name}/{part.rpartition('/')[2]}")[1], True)
            done = False
        if not done:
            fs.delete(source, True)
        return done

    def _base(self) -> str | None:
        return max(self._names("base"), key=int, default=None)

    def _inside(self) -> DataFrame:
        """batch and digest of all batches of the base; a table of any length stays in Spark."""
        base = self._base()
        if base is None:
            return self.spark.createDataFrame([], "batch string, digest long")
        return self.spark.read.schema("batch string, digest long").parquet(f"{self.path}/base/{base}/batches")

    def batches(self) -> DataFrame:
        """batch and digest of all committed batches."""
        return reduce(DataFrame.unionByName, (self._delta(n).select(F.lit(n).alias("batch"), "digest").limit(1) for n in self._open()), self._inside())

    def _open(self) -> list[str]:
        """Ids of the batches that no base holds yet."""
        names = self._names("delta")
        if not names:
            return []
        held = {r[0] for r in self._inside().where(F.col("batch").isin(names)).select("batch").collect()}  # no more than there are names
        return [n for n in names if n not in held]

    def _delta(self, batch: str) -> DataFrame:
        return self.spark.read.schema(StructType([*self.SCHEMA, StructField("digest", LongType())])).parquet(f"{self.path}/delta/{batch}")

    def _known(self, batch: str) -> int | None:
        """The digest of a committed batch, or None."""
        if batch in self._names("delta"):
            return self._delta(batch).first().digest
        row = self._inside().where(F.col("batch") == batch).first()
        return None if row is None else row.digest

    def commit(self, batch: str, feed: DataFrame) -> bool:
        """Add a batch of changes; False if it was committed before (nothing is done then).

        Other content under a known id is a ValueError.  A batch without rows commits its id.  A
        write that failed half way is below `pending/`, which nothing reads.
        """
        if not re.fullmatch(r"[\w-][\w.-]*", batch):
            raise ValueError(f"a batch id is letters, digits, dots and dashes, and no dot at first: {batch!r}")
        part = f"pending/{uuid.uuid4().hex}"
        sums = stash(signed_sums(feed), "rollup-batch")
        columns = F.struct(*KEYS, *SUMS)
        digest = sums.agg(F.coalesce(F.bit_xor(F.xxhash64(columns)), F.lit(0))).first()[0]
        known = self._known(batch)
        if known is None:
            rows = sums.withColumn("digest", F.lit(digest).cast("long"))
            mark = self.spark.createDataFrame([(None, None, None, 0, 0, digest)], rows.schema)  # the id is committed even without rows
            rows.unionByName(mark).write.parquet(f"{self.path}/{part}")
            release(sums)
            if self._publish(part, f"delta/{batch}"):
                return True
            known = self._known(batch)
        release(sums)
        if known != digest:
            raise ValueError(f"batch {batch} was committed with other content")
        return False

    def totals(self) -> DataFrame:
        """Totals of all committed batches; groups without documents and tokens are left out."""
        base = self._base()
        paths = [f"{self.path}/delta/{b}" for b in self._open()]
        paths += [f"{self.path}/base/{base}/totals"] if base else []
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)
        sums = rows.groupBy(*KEYS).agg(*(F.sum(s).alias(s) for s in SUMS))
        return sums.where("documents != 0 or tokens != 0")

    def compact(self) -> None:
        """Fold all committed batches into a new base.  The rename of the base is the commit, so a
        reader sees the old state or the new one; folded deltas and the base before are then removed.
        Readers that hold a plan on them must have ended."""
        before, folded = self._base(), self._open()
        part = f"pending/{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{self.path}/{part}/totals")
        self.batches().write.parquet(f"{self.path}/{part}/batches")
        if not self._publish(part, f"base/{int(before or 0) + 1}"):
            return  # another writer compacted the same state
        for name in [*(f"delta/{b}" for b in folded), *([f"base/{before}"] if before else [])]:
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)


def count_corpus(docs: DataFrame, path: str, bpe_path: str | None, pattern: str | None = None) -> DataFrame:
    """Totals after the life of a corpus.

    Every document is inserted with an estimate, and blank ones a second time; the second ones are
    deleted with all the tokens that they were entered with; every estimate is revised by the counted
    tokens, documents without a token are deleted, and the first batch is delivered again, as after a
    lost acknowledgement.

    documents and tokens per source, lang and tokenizer; null keys, and those of tables that lack the
    column, are groups of their own; an empty table gives no rows; a text of any length is counted
    whole.  Texts are tokenized once: the counted rows (no texts) are stored.
    """
    for name in ("source", "lang"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))
    rows = stash(counted(docs, bpe_path, pattern), "token-counts")
    rollup = Rollup(docs.sparkSession, path)
    guessed = rows.select(*KEYS, F.col("estimate").alias("tokens"))
    twice = rows.where("tokens = 0").select(*KEYS, (F.col("estimate") + 1).alias("tokens"))
    rollup.commit("1-inserts", changes(guessed, INSERT))
    rollup.commit("2-repeats", changes(twice, INSERT))
    rollup.commit("3-withdrawn", changes(twice, DELETE))
    rollup.commit("4-revisions", changes(rows, REVISE, before="estimate"))
    rollup.commit("5-deletes", changes(rows.where("tokens = 0"), DELETE))
    rollup.commit("1-inserts", changes(guessed, INSERT))
    return rollup.totals()
