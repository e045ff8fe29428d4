"""The document model: one row per document, its pages and blocks nested in reading order.

A document that stays in one row needs no shuffle to be rendered, and array positions keep the
order that loose rows would lose.  pages(), blocks() and cells() give the flat views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

_TEXTS = ArrayType(StringType())

BLOCK = StructType([
    StructField("type", StringType()), StructField("level", IntegerType()), StructField("text", StringType()),
    StructField("bold", BooleanType()), StructField("size", DoubleType()), StructField("lines", _TEXTS),
    StructField("cells", _TEXTS), StructField("rows", ArrayType(_TEXTS))])

ITEM = StructType([
    StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("width", DoubleType()),
    StructField("size", DoubleType()), StructField("text", StringType()), StructField("bold", BooleanType())])

PAGE = StructType([
    StructField("name", StringType()), StructField("width", DoubleType()), StructField("height", DoubleType()),
    StructField("blocks", ArrayType(BLOCK)), StructField("items", ArrayType(ITEM))])

PAGES = ArrayType(PAGE)

DOCUMENT = StructType([
    StructField("doc_id", StringType()), StructField("title", StringType()), StructField("source", StringType()),
    StructField("pages", PAGES), StructField("error", StringType())])

#: Page sizes in points: A4 upright and on its side.
A4 = (595.28, 841.89)


def heading(text: str, level: int = 1, **more) -> dict:
    return {"type": "heading", "level": level, "text": text, **more}


def paragraph(text: str, **more) -> dict:
    return {"type": "paragraph", "text": text, **more}


def table(rows: list[list[str]], **more) -> dict:
    return {"type": "table", "rows": rows, **more}


def page(blocks: list[dict], width: float, height: float, name: str | None = None, items: list[dict] | None = None) -> dict:
    return {"name": name, "width": float(width), "height": float(height), "blocks": blocks, "items": items}


def pages(documents: DataFrame) -> DataFrame:
    """doc_id, page_no, name, width, height."""
    p = documents.select("doc_id", F.posexplode("pages").alias("page_no", "page"))
    return p.select("doc_id", "page_no", "page.name", "page.width", "page.height")


def blocks(documents: DataFrame) -> DataFrame:
    """doc_id, page_no, block_no and the fields of each block."""
    p = documents.select("doc_id", F.posexplode("pages").alias("page_no", "page"))
    b = p.select("doc_id", "page_no", F.posexplode("page.blocks").alias("block_no", "block"))
    return b.select("doc_id", "page_no", "block_no", "block.*")


def cells(documents: DataFrame) -> DataFrame:
    """doc_id, page_no, block_no, row_no, col_no, value of all table cells."""
    r = blocks(documents).select("doc_id", "page_no", "block_no", F.posexplode("rows").alias("row_no", "row"))
    return r.select("doc_id", "page_no", "block_no", "row_no", F.posexplode("row").alias("col_no", "value"))
