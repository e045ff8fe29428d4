"""Files as rows: batch and stream scans, SQL functions, and a sink for output files."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from . import limits


def _named(files: DataFrame, *more: str) -> DataFrame:
    name = F.regexp_extract("path", "[^/]*$", 0)
    return files.select(F.col("path").alias("doc_id"), name.alias("name"), F.nullif(F.regexp_extract(name, "\\.([^.]+)$", 1), F.lit("")).alias("declared"), "length", "content", *more)


def scan(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int = limits.FILE_BYTES) -> DataFrame:
    """doc_id, name, declared, length, content and error of the files below path.

    Files over the cap come without content and with an error; neither scan reads theirs, as the
    length filter reaches the first and the second has no content column.  The pattern prunes the
    listing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    fit = files.where(F.col("length") <= most_bytes).withColumn("error", F.lit(None).cast("string"))
    too_long = F.format_string("The file has %d bytes; at most %d are read.", "length", F.lit(most_bytes))
    over = files.select("path", "modificationTime", "length").where(F.col("length") > most_bytes).withColumn("content", F.lit(None).cast("binary")).withColumn("error", too_long)
    return _named(fit.unionByName(over), "error")


def stream(spark: SparkSession, path: str, pattern: str = "*", files_per_trigger: int = 64) -> DataFrame:
    """The same rows as files arrive.  Conversion keeps no state, so it needs no watermark."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return _named(files)


def image_rows(spark: SparkSession, path: str) -> DataFrame:
    """Images as decoded rows: origin, height, width, nChannels, mode, data (BGR) and error, which
    says so where a file is no image that can be decoded."""
    rows = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    return rows.withColumn("error", F.when(F.col("height") < 0, F.lit("The file is not an image that can be decoded.")))


def register_functions(spark: SparkSession) -> None:
    """Document functions for SQL: parse_csv, html_text, json_csv, number_text."""
    from ..functions.text import significant
    from . import csvio, htmlio, jsonio

    def vectorised(name: str, kind: str, f) -> None:
        @F.pandas_udf(kind)
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else f(v))

        spark.udf.register(name, run)

    vectorised("parse_csv", "array<array<string>>", csvio.parse)
    vectorised("html_text", "string", htmlio.to_text)
    vectorised("json_csv", "string", jsonio.to_csv)
    vectorised("number_text", "string", significant)


class OutputFiles(DataSource):
    """A sink `output_files` that writes rows (name, data) as files below a folder that all executors
    reach: a mount, or a store that Arrow knows (hdfs, s3, gs).

    Each task writes under a temporary name and renames, so a retried task replaces its own files.
    """

    @classmethod
    def name(cls) -> str:
        return "output_files"

    def schema(self) -> StructType:
        return StructType().add("name", "string").add("data", "binary")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FilesWriter(self.options["path"])


class _FilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path if "://" in path else "file://" + posixpath.abspath(path.removeprefix("file:"))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        for row in rows:
            target = posixpath.join(folder, posixpath.basename(row["name"]))
            part = f"{target}.part-{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(row["data"])
            store.move(part, target)
        return WriterCommitMessage()


def write_outputs(outputs: DataFrame, path: str) -> None:
    """Write the outputs of a conversion (name, data) as files; rows with an error are left out."""
    outputs.sparkSession.dataSource.register(OutputFiles)
    outputs.where("data is not null").select("name", "data").write.format("output_files").mode("append").option("path", path).save()
