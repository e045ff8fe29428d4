"""Conversion of files: bytes to the document model, and the model to output files.

A file is one row and one task's work.  `convert` takes bytes to outputs in one scan and one Python
stage over Arrow batches.  Where the model is wanted itself, `detect`, `read` and `emit` are its
stages; what can be said in Columns there (formats, text and HTML rendering) is.  Failures are
values in `error`, so one bad file never fails a job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from .. import ship
from ..functions import columns as C
from ..functions.text import MIME_TYPES, decode_text, normalize_format, rows_to_csv, stem, trim_end
from ..operators import layout, model, render, textual
from ..sources import csvio, docx, htmlio, jsonio, limits, pptx, xlsx, zipio
from ..sources.pdf import content, writer
from . import matrix

#: A fixed time for package properties, so that equal input gives equal bytes.
STAMP = "2000-01-01T00:00:00Z"
#: Files of an Arrow batch that are handled at a time.
FILES = 16

OUTPUT = StructType([StructField("name", StringType()), StructField("type", StringType()), StructField("data", BinaryType())])
#: Parts that tell which kind of package a ZIP file is.
PACKAGE_PARTS = (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"))


def sniff(data: bytes, declared: str) -> str:
    """The format by content, whatever was declared."""
    if b"%PDF-" in data[:limits.SNIFF_BYTES]:
        return "pdf"
    if data[:4] == b"\xd0\xcf\x11\xe0":
        return "ole"
    if data[:2] == b"PK":
        try:
            parts = zipio.entries(data)
        except (zipio.PackageError, ValueError, IndexError):
            return declared
        return next((kind for part, kind in PACKAGE_PARTS if part in parts), declared)
    return declared


def read_pages(data: bytes, source: str) -> list[dict]:
    """Pages of the model from the bytes of one file."""
    if source == "pdf":
        pages, unmapped, _ = content.read_runs(data)
        return layout.layout(pages, unmapped)
    if source in ("docx", "xlsx", "pptx"):
        return {"docx": docx, "xlsx": xlsx, "pptx": pptx}[source].read(data)
    text = decode_text(data)
    if source == "csv":
        rows = csvio.parse(text)
        return [model.page([model.table(rows)] if rows else [], model.A4[1], model.A4[0])]
    return [model.page([model.paragraph(trim_end(line)) for line in trim_end(part).replace("\r\n", "\n").split("\n")], *model.A4) for part in text.split("\f")]


def to_sheets(pages: list[dict], source: str) -> list[tuple[str, list[list[str]]]]:
    """Sheets of rows, as render.sheets gives them."""
    out = []
    for n, page in enumerate(pages, 1):
        rows: list[list[str]] = []
        for block in page["blocks"] or ():
            if block["type"] == "table":
                rows += [[c or "" for c in r] for r in block["rows"]]
                continue
            if block["type"] == "heading" and rows and rows[-1]:
                rows.append([])
            rows.append(list(block["cells"]) if block.get("cells") else [block["text"]])
        out.append((page.get("name") or f"{'Page' if source == 'pdf' else 'Sheet'} {n}", rows))
    return out


def write_outputs(pages: list[dict], title: str, source: str, target: str, stamp: str = STAMP) -> list[dict]:
    """Binary and tabular outputs of one document; TXT and HTML are rendered in Columns."""
    one = lambda data: [{"name": f"{title}.{target}", "type": MIME_TYPES[target], "data": data}]
    if target == "docx":
        return one(docx.write(pages, title, stamp, source))
    if target == "xlsx":
        return one(xlsx.write(to_sheets(pages, source), title, stamp))
    if target == "pptx":
        return one(pptx.write(pages, title, stamp))
    if target == "pdf":
        return one(writer.write(pages, title, source))
    sheets = to_sheets(pages, source)
    if target == "json":
        return one(jsonio.sheets_to_json(sheets).encode())
    if target == "csv":
        full = [s for s in sheets if s[1]]
        if source == "xlsx" and len(full) > 1:
            return [{"name": f"{title}-{stem(name + '.x')}.csv", "type": MIME_TYPES["csv"], "data": ("﻿" + rows_to_csv(rows)).encode()} for name, rows in full]
        return one(("﻿" + rows_to_csv([r for _, rows in sheets for r in rows])).encode())
    raise ValueError(f"{target.upper()} output is not supported.")


def light_output(data: bytes, source: str, target: str) -> bytes:
    """Conversions between light formats, which work on the text without a document model."""
    text = data.decode("utf-8", "replace").removeprefix("\ufeff")
    made = {("csv", "json"): jsonio.from_csv, ("json", "csv"): jsonio.to_csv, ("txt", "json"): jsonio.wrap_text, ("json", "txt"): jsonio.reformat,
            ("html", "txt"): htmlio.to_text, ("txt", "html"): textual.text_to_html}.get((source, target))
    if made is None:
        raise ValueError(f"{source.upper()} to {target.upper()} works on decoded images; read the folder with image_rows().")
    return made(text).encode()


def convert_light(files: DataFrame) -> DataFrame:
    """doc_id, outputs, error of files (doc_id, name, source, target, content) in light formats."""
    kind = ArrayType(OUTPUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("doc_id", pa.string()), ("outputs", _arrow(kind)), ("error", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                rows = []
                for r in batch.slice(at, FILES).to_pylist():
                    try:
                        data = light_output(r["content"] or b"", r["source"], r["target"])
                        rows.append({"doc_id": r["doc_id"], "outputs": [{"name": f"{r['title']}.{r['target']}", "type": MIME_TYPES[r["target"]], "data": data}], "error": None})
                    except Exception as e:  # as when reading
                        rows.append({"doc_id": r["doc_id"], "outputs": None, "error": str(e) or type(e).__name__})
                yield pa.RecordBatch.from_pylist(rows, types)

    schema = StructType([StructField("doc_id", StringType()), StructField("outputs", kind), StructField("error", StringType())])
    return files.select(F.col("doc_id").cast("string"), C.stem(F.col("name")).alias("title"), "source", "target", "content").mapInArrow(run, schema)


def detect(files: DataFrame) -> DataFrame:
    """files (doc_id, name, declared, content) with the detected source in place of the declared."""
    @F.pandas_udf("string")
    def packed(content: pd.Series, declared: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else sniff(d, k or "") for d, k in zip(content, declared)], dtype=object)

    declared = C.normalize_format(F.coalesce(F.col("declared"), F.regexp_extract("name", "\\.([^.]*)$", 1))).alias("declared")
    rest = [c for c in files.columns if c not in ("content", "declared")]
    magic = C.sniff_magic(F.col("content"), F.col("declared"))
    # only packages need their directory read, so no other content goes to Python; one projection, as
    # what makes the files may be dear
    kind = F.when(magic == "zip", packed(F.when(magic == "zip", F.col("content")), F.col("declared"))).otherwise(magic)
    return files.select(*rest, "content", declared).select(*rest, "content", "declared", kind.alias("source"))


def read(files: DataFrame) -> DataFrame:
    """Documents (doc_id, title, source, pages, error) of files with a detected source."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("doc_id", pa.string()), ("title", pa.string()), ("source", pa.string()), ("pages", _arrow(model.PAGES)), ("error", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                rows = []
                for doc_id, title, source, data in zip(*(batch.slice(at, FILES).column(i).to_pylist() for i in range(4))):
                    try:
                        rows.append((doc_id, title, source, read_pages(data or b"", source), None))
                    except Exception as e:  # a file that cannot be read is a row with an error
                        rows.append((doc_id, title, source, None, str(e) or type(e).__name__))
                yield pa.RecordBatch.from_pylist([dict(zip(types.names, r)) for r in rows], types)

    return files.select(F.col("doc_id").cast("string"), C.stem(F.col("name")).alias("title"), "source", "content").mapInArrow(run, model.DOCUMENT)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def emit(documents: DataFrame) -> DataFrame:
    """Outputs of documents that have a `target`: doc_id, outputs array, error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("doc_id", pa.string()), ("outputs", _arrow(ArrayType(OUTPUT))), ("error", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                rows = []
                for r in batch.slice(at, FILES).to_pylist():
                    try:
                        rows.append({"doc_id": r["doc_id"], "outputs": write_outputs(r["pages"], r["title"], r["source"], r["target"]), "error": None})
                    except Exception as e:  # as when reading
                        rows.append({"doc_id": r["doc_id"], "outputs": None, "error": str(e) or type(e).__name__})
                yield pa.RecordBatch.from_pylist(rows, types)

    good = documents.where("error is null")
    light = good.where(F.col("target").isin("txt", "html"))
    text = F.when(F.col("target") == "txt", render.to_text(F.col("pages"))).otherwise(render.to_html(F.col("title"), F.col("pages")))
    made = light.select("doc_id", F.array(F.struct(F.concat("title", F.lit("."), "target").alias("name"), C.mime_type(F.col("target")).alias("type"), F.encode(text, "UTF-8").alias("data"))).alias("outputs"), F.lit(None).cast("string").alias("error"))
    schema = StructType([StructField("doc_id", StringType()), StructField("outputs", ArrayType(OUTPUT)), StructField("error", StringType())])
    heavy = good.where(~F.col("target").isin("txt", "html")).select("doc_id", "title", "source", "target", "pages").mapInArrow(run, schema)
    failed = documents.where("error is not null").select("doc_id", F.lit(None).cast(ArrayType(OUTPUT)).alias("outputs"), "error")
    return made.unionByName(heavy).unionByName(failed)


def convert(files: DataFrame, target: str) -> DataFrame:
    """doc_id, output_no, name, type, data, error: files (doc_id, name, declared, content, and error
    where the scan has one) turned into target.

    One pass: a file's bytes are scanned once and go through one Python stage that detects, refuses,
    reads and writes.  What cannot be converted is refused before it is parsed.
    """
    ship(files.sparkSession)
    kind = ArrayType(OUTPUT)
    to = normalize_format(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("doc_id", pa.string()), ("outputs", _arrow(kind)), ("error", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                rows = []
                for doc_id, name, declared, data, error in zip(*(c.to_pylist() for c in batch.slice(at, FILES).columns)):
                    made = None
                    try:
                        made = convert_bytes(data or b"", name or "", declared, to) if error is None else None
                    except Exception as e:  # a file that cannot be converted is a row with an error
                        error = str(e) or type(e).__name__
                    rows.append({"doc_id": doc_id, "outputs": made, "error": error})
                yield pa.RecordBatch.from_pylist(rows, types)

    column = lambda c, usual: (F.col(c) if c in files.columns else usual).alias(c)
    none = F.lit(None).cast("string")
    schema = StructType([StructField("doc_id", StringType()), StructField("outputs", kind), StructField("error", StringType())])
    done = files.select(F.col("doc_id").cast("string"), column("name", none), column("declared", none), "content", column("error", none)).mapInArrow(run, schema)
    return done.select("doc_id", F.posexplode_outer("outputs").alias("output_no", "o"), "error").select("doc_id", "output_no", "o.name", "o.type", "o.data", "error")


def convert_bytes(data: bytes, name: str, source: str | None, target: str) -> list[dict]:
    """One file in Python: detected by content, refused or read, and written."""
    declared = normalize_format(source or (name.rsplit(".", 1)[-1] if "." in name else ""))
    kind, to = sniff(data, declared), normalize_format(target)
    if why := matrix.why_refused(kind, to, len(data), declared):
        raise ValueError(why)
    title = stem(name)
    if (kind, to) in matrix.LIGHT:
        return [{"name": f"{title}.{to}", "type": MIME_TYPES[to], "data": light_output(data, kind, to)}]
    pages = read_pages(data, kind)
    if to in ("txt", "html"):
        text = textual.to_text(pages) if to == "txt" else textual.to_html(title, pages)
        return [{"name": f"{title}.{to}", "type": MIME_TYPES[to], "data": text.encode()}]
    return write_outputs(pages, title, kind, to)


