"""The conversion matrix, its searches, and the routes of a conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sources and the targets that the engine converts them to.
ENGINE = {
    "pdf": ("txt", "html", "docx", "xlsx", "pptx", "csv"),
    "docx": ("txt", "html", "pdf", "pptx"),
    "xlsx": ("csv", "json", "txt", "html", "pdf", "docx"),
    "pptx": ("txt", "html", "pdf", "docx"),
    "txt": ("docx", "pdf", "pptx"),
    "csv": ("xlsx", "pdf", "docx", "html"),
}
# Conversions between light formats.
LIGHT = (("png", "jpeg"), ("png", "webp"), ("jpeg", "png"), ("jpeg", "webp"), ("webp", "png"), ("webp", "jpeg"), ("bmp", "png"),
         ("csv", "json"), ("json", "csv"), ("txt", "html"), ("html", "txt"), ("txt", "json"), ("json", "txt"))
IMAGES = ("png", "jpeg", "webp", "bmp", "gif")
IMAGE_TARGETS = ("png", "jpeg", "webp")

PAIRS = [(s, t, "engine") for s, targets in ENGINE.items() for t in targets] + [(s, t, "light") for s, t in LIGHT]


def matrix(spark: SparkSession) -> DataFrame:
    """source, target, engine; fewer than fifty rows."""
    return spark.createDataFrame(PAIRS, "source string, target string, engine string")


def targets(table: DataFrame, source: str) -> DataFrame:
    """Targets offered for a source: the matrix, and for images every image target."""
    found = table.where(F.col("source") == source).select("target")
    if source in IMAGES:
        found = found.unionByName(table.sparkSession.createDataFrame([(t,) for t in IMAGE_TARGETS], "target string"))
    return found.where(F.col("target") != source).distinct()


def search(table: DataFrame, term: str) -> DataFrame:
    """Rows whose "source to target engine" holds the trimmed lower-case term."""
    haystack = F.concat_ws(" ", "source", F.lit("to"), "target", "engine")
    return table.where(F.contains(haystack, F.lit(term.strip().lower())))


def swaps(table: DataFrame) -> DataFrame:
    """Pairs whose reverse is offered too."""
    back = table.select(F.col("source").alias("target"), F.col("target").alias("source"), F.lit(True).alias("back"))
    return table.join(F.broadcast(back), ["source", "target"], "left_semi")  # a literal table


def usage(table: DataFrame) -> DataFrame:
    """One line per source with its targets in alphabetical order."""
    return table.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("target")), ", ").alias("targets"))


def supported(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit(">"), target).isin([f"{s}>{t}" for s, t, _ in PAIRS])


def is_light(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit(">"), target).isin([f"{s}>{t}" for s, t in LIGHT])


OLD_OFFICE = ("doc", "xls", "ppt")
IS_OLD = "Old binary {} files cannot be read; save the file in its newer format first."
IS_OLE = "The file is an old binary or password-protected Office file and cannot be read."
UNKNOWN = "{} files are not supported as conversion input."
UNSUPPORTED, LISTED, EMPTY = "{} to {} is not supported.", " It converts to: {}.", "The file is empty."


def why_refused(source: str, target: str, size: int, declared: str) -> str | None:
    """refusal() for one file."""
    if source == "ole":
        return IS_OLD.format(declared.upper()) if declared in OLD_OFFICE else IS_OLE
    if source not in {s for s, _, _ in PAIRS}:
        return UNKNOWN.format((source or "unknown").upper())
    if (source, target) not in {(s, t) for s, t, _ in PAIRS}:
        others = LISTED.format(", ".join(t.upper() for t in ENGINE[source])) if source in ENGINE else ""
        return UNSUPPORTED.format(source.upper(), target.upper()) + others
    return EMPTY if size == 0 else None


def refusal(source: Column, target: Column, size: Column, declared: Column) -> Column:
    """Why a conversion cannot start, or null.  An empty file is noticed last."""
    said = lambda text, *parts: F.format_string(text.replace("{}", "%s"), *parts)
    listed = F.lit("")
    for s, ts in ENGINE.items():
        listed = F.when(source == s, F.lit(LISTED.format(", ".join(t.upper() for t in ts)))).otherwise(listed)
    return (F.when((source == "ole") & declared.isin(*OLD_OFFICE), said(IS_OLD, F.upper(declared))).when(source == "ole", F.lit(IS_OLE))
            .when(~source.isin(list({s for s, _, _ in PAIRS})), said(UNKNOWN, F.upper(F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown")))))
            .when(~supported(source, target), F.concat(said(UNSUPPORTED, F.upper(source), F.upper(target)), listed))
            .when(size == 0, F.lit(EMPTY)))
