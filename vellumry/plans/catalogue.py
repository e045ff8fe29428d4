"""Queries of the engine's operators over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as T
from ..operators import model, relational, render
from ..sources import csvio, htmlio, jsonio
from . import convert, fixtures, matrix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The white space class in DuckDB's pattern syntax.
SP = "[\\t-\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{SP}", SP)
        return f
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as the model: one row per document, nested in place."""
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", render.txt_pages(F.col("text")).alias("pages"))


# ------------------------------------------------------------------ scans

_SQL_LINES = "list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '{SP}+$', ''), '\\r?\\n'), lambda x: regexp_replace(x, '{SP}+$', ''))"


@query(f"""SELECT doc_id, (i - 1)::INTEGER AS line_no, l[i] AS line
           FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_SQL_LINES} AS l FROM documents))""")
def txt_lines(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", render.txt_lines(F.coalesce("text", F.lit(""))).alias("l"))
    return d.select("doc_id", F.posexplode("l").alias("line_no", "line"))


@query("""SELECT doc_id, (i - 1)::INTEGER AS page_no, len(regexp_split_to_array(regexp_replace(p[i], '{SP}+$', ''), '\\n'))::INTEGER AS n_blocks
          FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
                FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), '.' || chr(10), '.' || chr(12)), chr(12)) AS p FROM documents))""")
def txt_pages(spark, sf_dir):
    """Form feeds in place of the line ends that end a sentence."""
    d = _table(spark, sf_dir, "documents")
    paged = d.select("doc_id", render.txt_pages(F.replace(F.coalesce("text", F.lit("")), F.lit(".\n"), F.lit(".\f"))).alias("pages"))
    return paged.select("doc_id", F.posexplode("pages").alias("page_no", "p")).select("doc_id", "page_no", F.size("p.blocks").alias("n_blocks"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'ole' WHEN 2 THEN 'zip' WHEN 3 THEN 'html' WHEN 4 THEN 'jpeg' ELSE 'txt' END AS format FROM pages""")
def sniff_format(spark, sf_dir):
    """First bytes set by row, declared formats in several spellings."""
    k = F.col("page_id") % 6
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    magic = F.when(k == 0, F.lit(b"\n%PDF-1.4")).when(k == 1, F.lit(b"\xd0\xcf\x11\xe0")).when(k == 2, F.lit(b"PK\x03\x04")).otherwise(F.lit(b""))
    declared = F.when(k == 4, F.lit(".JPG")).when(k == 5, F.lit("Text")).otherwise(F.lit("htm"))
    return _table(spark, sf_dir, "pages").select("page_id", C.sniff_magic(F.concat(magic, body), C.normalize_format(declared)).alias("format"))


@query("""SELECT page_id, CASE WHEN s = '' THEN 'converted' ELSE s END AS stem FROM (
            SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1'), '[<>:"/|?*\\\\]', '_', 'g')) AS s FROM pages)""")
def file_stem(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", C.stem(F.col("url")).alias("stem"))


@query("SELECT doc_id, text AS decoded FROM documents")
def text_decode(spark, sf_dir):
    """Texts written in UTF-16, UTF-8 with a mark and UTF-8 by turns, and read back."""
    k, t = F.col("doc_id") % 4, F.col("text")
    data = (F.when(k == 0, F.concat(F.lit(b"\xff\xfe"), F.encode(t, "UTF-16LE"))).when(k == 1, F.concat(F.lit(b"\xfe\xff"), F.encode(t, "UTF-16BE")))
            .when(k == 2, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(t, "UTF-8"))).otherwise(F.encode(t, "UTF-8")))
    return _table(spark, sf_dir, "documents").select("doc_id", C.decode_text(data).alias("decoded"))


# ------------------------------------------------------------------ CSV and JSON

_ESC = "CASE WHEN regexp_matches({0}, '[\",\\n\\r]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(f"SELECT conv_id, turn, {_ESC.format('text')} AS field FROM conversations")
def csv_escape(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", C.csv_escape(F.col("text")).alias("field"))


@query(f"""SELECT conv_id, string_agg(turn::VARCHAR || ',' || {_ESC.format('role')} || ',' || {_ESC.format('text')} || chr(13) || chr(10), '' ORDER BY turn) AS csv
           FROM conversations GROUP BY conv_id""")
def csv_render(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    cells = F.transform("r", lambda x: F.array(x["turn"].cast("string"), x["role"], x["text"]))
    return rows.select("conv_id", render.rows_to_csv(cells).alias("csv"))


@query("""SELECT doc_id, CASE WHEN c >= s AND c >= t THEN ',' WHEN s >= t THEN ';' ELSE chr(9) END AS delimiter FROM (
            SELECT doc_id, len(l) - len(replace(l, ',', '')) AS c, len(l) - len(replace(l, ';', '')) AS s, len(l) - len(replace(l, chr(9), '')) AS t
            FROM (SELECT doc_id, replace(string_split(text, chr(10))[1], ' ', CASE doc_id % 3 WHEN 0 THEN ';' WHEN 1 THEN chr(9) ELSE ' ' END) AS l FROM documents))""")
def csv_delimiter(spark, sf_dir):
    """First lines with spaces turned into semicolons or tabs by turns."""
    other = F.when(F.col("doc_id") % 3 == 0, F.lit(";")).when(F.col("doc_id") % 3 == 1, F.lit("\t")).otherwise(F.lit(" "))
    line = F.replace(F.get(F.split("text", "\n"), F.lit(0)), F.lit(" "), other)
    return _table(spark, sf_dir, "documents").select("doc_id", C.csv_delimiter(line).alias("delimiter"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def csv_roundtrip(spark, sf_dir):
    """Conversations rendered as CSV by group, and read back by the tolerant reader."""
    @F.pandas_udf("array<array<string>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(csvio.parse)

    rows = csv_render(spark, sf_dir).select("conv_id", F.explode(parse("csv")).alias("r"))
    return rows.select("conv_id", F.get("r", F.lit(0)).cast("long").alias("turn"), F.get("r", F.lit(1)).alias("role"), F.get("r", F.lit(2)).alias("text"))


@query("""SELECT n_regionkey::VARCHAR AS region, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::INTEGER AS record_no, n_name AS name, n_nationkey::VARCHAR AS key FROM nation""")
def records_json(spark, sf_dir):
    """Tables written as JSON files: records keyed by the header."""
    files = _written(_nations(spark, sf_dir), "json")
    records = F.from_json(F.col("content").cast("string"), "array<struct<name string, key string>>")
    return files.select(F.col("doc_id").alias("region"), F.posexplode(records).alias("record_no", "r")).select("region", "record_no", "r.name", "r.key")


@query("""SELECT n_regionkey::VARCHAR AS region, chr(65279) || 'name,key' || chr(13) || chr(10) || string_agg(n_name || ',' || n_nationkey || chr(13) || chr(10), '' ORDER BY n_name) AS csv FROM nation GROUP BY 1""")
def csv_files(spark, sf_dir):
    """Tables written as CSV files, byte for byte."""
    return _written(_nations(spark, sf_dir), "csv").select(F.col("doc_id").alias("region"), F.col("content").cast("string").alias("csv"))


@query("""SELECT p_size AS t, p_partkey AS col_no, CASE WHEN k = 1 THEN p_brand ELSE p_brand || '_' || k END AS header
          FROM (SELECT p_size, p_partkey, p_brand, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS k FROM part)""")
def header_dedupe(spark, sf_dir):
    """Header cells of one table for each size, names told apart."""
    p = _table(spark, sf_dir, "part").select(F.col("p_size").alias("t"), F.col("p_partkey").alias("col_no"), F.col("p_brand").alias("name"))
    return relational.duplicate_numbers(p, "t", "col_no", "name").select("t", "col_no", "header")


@query("""WITH k AS (SELECT o_orderkey, [('o_orderkey', 0), ('status', 1), ('price', 2)] || CASE WHEN o_orderpriority LIKE '1%' THEN [('priority', 3)] ELSE [] END
                      || CASE WHEN o_custkey % 7 = 3 THEN [('customer', 4)] ELSE [] END AS ks FROM orders),
               f AS (SELECT x[1] AS key, min((o_orderkey, x[2])) AS first FROM (SELECT o_orderkey, unnest(ks) AS x FROM k) GROUP BY 1)
          SELECT (row_number() OVER (ORDER BY first) - 1)::INTEGER AS pos, key FROM f""")
def json_key_union(spark, sf_dir):
    """Keys of records that do not all have the same ones."""
    o = _table(spark, sf_dir, "orders")
    some = F.concat(F.array(F.lit("o_orderkey"), F.lit("status"), F.lit("price")),
                    F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("priority"))).otherwise(F.array().cast("array<string>")),
                    F.when(F.col("o_custkey") % 7 == 3, F.array(F.lit("customer"))).otherwise(F.array().cast("array<string>")))
    return relational.first_seen_keys(o, some, "o_orderkey")


@query("SELECT event_id, json_extract_string(props, '$.k') AS line FROM events")
def json_to_csv(spark, sf_dir):
    """Each event's properties as CSV: the line after the header."""
    @F.pandas_udf("string")
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: jsonio.to_csv(t).partition("\n")[2])

    return _table(spark, sf_dir, "events").select("event_id", lines("props").alias("line"))


@query("""SELECT doc_id, '{' || chr(10) || '  "text": ' || to_json(text)::VARCHAR || chr(10) || '}' AS json FROM documents""")
def txt_json(spark, sf_dir):
    @F.pandas_udf("string")
    def wrap(texts: pd.Series) -> pd.Series:
        return texts.map(jsonio.wrap_text)

    return _table(spark, sf_dir, "documents").select("doc_id", wrap("text").alias("json"))


# ------------------------------------------------------------------ HTML, XML, renderings

_UNREF = "replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


def _page_texts(pages: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(htmlio.to_text)

    return pages.select("page_id", read("html").alias("text"))


_WHOLE_REF = "regexp_replace(html, '&(amp|quot)([^;a-z])', '&\\1;\\2', 'g')"


@query(f"""SELECT page_id, coalesce(regexp_replace({_UNREF.format(f"regexp_replace(regexp_replace(regexp_extract({_WHOLE_REF}, '(?s)<body[^>]*>(.*)$', 1), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')")}, '^{{SP}}+|{{SP}}+$', '', 'g'), '') AS text FROM pages""".replace("{{SP}}", "{SP}"))
def html_to_text(spark, sf_dir):
    """Text content of every page: a reference cut before its semicolon is read, one cut in its name
    stays as text, and no page gives no text."""
    return _page_texts(_table(spark, sf_dir, "pages"))


_XML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"SELECT doc_id, {_XML.format('text')} AS escaped FROM documents")
def xml_escape(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", C.escape_xml(F.col("text")).alias("escaped"))


@query(f"SELECT page_id, replace({_XML.format('html')}, '''', '&#39;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", C.escape_html(F.col("html")).alias("escaped"))


@query(f"""SELECT doc_id, '{render.HTML_HEAD}' || source || '{render.HTML_STYLE}' || '<section>' || chr(10) ||
                  array_to_string(list_transform(list_filter({_SQL_LINES}, lambda x: x != ''), lambda x: '<p>' || replace({_XML.format('x')}, chr(9), '&emsp;') || '</p>'), chr(10))
                  || chr(10) || '</section>' || '{render.HTML_TAIL}' AS html FROM documents""")
def doc_html(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return d.select("doc_id", render.to_html(F.col("source"), F.col("pages")).alias("html"))


@query(f"SELECT doc_id, regexp_replace(array_to_string({_SQL_LINES}, chr(10) || chr(10)), '{{SP}}+$', '') || chr(10) AS txt FROM documents".replace("{{SP}}", "{SP}"))
def doc_txt(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", render.to_text(F.col("pages")).alias("txt"))


@query(f"""SELECT doc_id, '<!doctype html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '  <meta charset="utf-8">' || chr(10) || '  <title>Converted Text</title>'
                  || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '  <pre>' || replace({_XML.format('text')}, '''', '&#39;') || '</pre>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS html FROM documents""")
def txt_pre_html(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", render.text_to_html(F.col("text")).alias("html"))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of one page: a heading per turn and its text as a paragraph."""
    block = lambda kind, level, text: F.named_struct(
        F.lit("type"), F.lit(kind), F.lit("level"), F.lit(level).cast("int"), F.lit("text"), text, F.lit("bold"), F.lit(None).cast("boolean"), F.lit("size"), F.lit(None).cast("double"),
        F.lit("lines"), F.lit(None).cast("array<string>"), F.lit("cells"), F.lit(None).cast("array<string>"), F.lit("rows"), F.lit(None).cast("array<array<string>>"))
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    blocks = F.flatten(F.transform("t", lambda x: F.array(block("heading", 1, x["role"]), block("paragraph", None, x["text"]))))
    page = F.named_struct(F.lit("name"), F.lit(None).cast("string"), F.lit("width"), F.lit(612.0), F.lit("height"), F.lit(792.0), F.lit("blocks"), blocks, F.lit("items"), F.lit(None).cast(model.ArrayType(model.ITEM)))
    return turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("conv_id").cast("string").alias("title"), F.lit("txt").alias("source"), F.array(page).alias("pages"), F.lit(None).cast("string").alias("error"))


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, role, text FROM conversations)
          SELECT conv_id::VARCHAR AS doc_id, 'Sheet 1' AS sheet, row_no::INTEGER AS row_no, value FROM (
            SELECT conv_id, 3 * k AS row_no, role AS value FROM r UNION ALL SELECT conv_id, 3 * k + 1, text FROM r)""")
def sheet_projection(spark, sf_dir):
    """Headings are set off by an empty row."""
    s = _talks(spark, sf_dir).select("doc_id", F.explode(render.sheets(F.col("pages"), F.col("source"))).alias("s"))
    rows = s.select("doc_id", F.col("s.name").alias("sheet"), F.posexplode("s.rows").alias("row_no", "row"))
    return rows.where(F.size("row") > 0).select("doc_id", "sheet", "row_no", F.get("row", F.lit(0)).alias("value"))


# ------------------------------------------------------------------ spreadsheets

@query("""WITH e AS (SELECT l_orderkey AS sheet, max(l_linenumber) AS rows, 7 AS cols FROM lineitem GROUP BY 1),
               g AS (SELECT sheet, unnest(range(0, rows + 1)) AS row_no FROM e),
               c AS (SELECT l_orderkey AS sheet, l_linenumber AS row_no, l_quantity::INTEGER % 8 AS col, max(l_suppkey::VARCHAR) AS v FROM lineitem GROUP BY ALL),
               m AS (SELECT sheet, max(col) AS cols FROM c GROUP BY 1)
          SELECT sheet, row_no::BIGINT AS row_no, string_agg(coalesce(v, ''), '|' ORDER BY k) AS line
          FROM (SELECT g.sheet, g.row_no, k.k, c.v FROM g JOIN m USING (sheet) JOIN (SELECT unnest(range(0, 8)) AS k) k ON k.k <= m.cols LEFT JOIN c ON c.sheet = g.sheet AND c.row_no = g.row_no AND c.col = k.k)
          GROUP BY sheet, row_no""")
def table_grid_densify(spark, sf_dir):
    l = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row_no"), (F.col("l_quantity").cast("int") % 8).alias("col"), F.col("l_suppkey").cast("string").alias("v"))
    return relational.densify(l, "sheet", "row_no", "col", "v").select("sheet", "row_no", F.array_join("values", "|").alias("line"))


@query("""SELECT value, CASE WHEN value = '' THEN 'empty' WHEN regexp_full_match(value, '-?(0|[1-9][0-9]{0,14})(\\.[0-9]{1,10})?') AND len(regexp_replace(value, '[^0-9]', '', 'g')) <= 15 THEN 'number'
                             WHEN regexp_full_match(value, '-?[0-9]{1,3}(,[0-9]{3})+(\\.[0-9]{1,10})?') AND len(regexp_replace(value, '[^0-9]', '', 'g')) <= 15 THEN 'grouped'
                             WHEN contains(value, chr(10)) THEN 'wrapped' ELSE 'text' END AS cell_kind
          FROM (SELECT c_acctbal::DECIMAL(18,2)::VARCHAR AS value FROM customer UNION ALL SELECT format('{:,}', c_custkey * 1237) FROM customer UNION ALL SELECT '0' || c_custkey FROM customer
                UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT text FROM conversations)""")
def cell_typing(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    values = [F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.format_number(F.col("c_custkey") * 1237, 0), F.concat(F.lit("0"), F.col("c_custkey").cast("string")), F.col("c_mktsegment")]
    rows = c.select(F.explode(F.array(*values)).alias("value")).unionByName(_table(spark, sf_dir, "conversations").select(F.col("text").alias("value")))
    return rows.select("value", C.cell_kind(F.col("value")).alias("cell_kind"))


@query("""SELECT idx::BIGINT AS idx, CASE WHEN idx < 26 THEN chr((65 + idx)::INTEGER) WHEN idx < 702 THEN chr((65 + (idx - 26) // 26)::INTEGER) || chr((65 + idx % 26)::INTEGER)
                 ELSE chr((65 + (idx - 702) // 676)::INTEGER) || chr((65 + ((idx - 702) // 26) % 26)::INTEGER) || chr((65 + idx % 26)::INTEGER) END AS name FROM range(16384) t(idx)""")
def column_letters(spark, sf_dir):
    return spark.range(16384).select(F.col("id").alias("idx"), C.column_name(F.col("id")).alias("name"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 18 HOUR, '%Y-%m-%d %H:%M:%S') AS moment, '18:00:00' AS clock FROM orders")
def serial_dates(spark, sf_dir):
    serial = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01")).cast("double") + 25569
    return _table(spark, sf_dir, "orders").select("o_orderkey", C.serial_text(serial, F.lit(False)).alias("day"), C.serial_text(serial + 0.75, F.lit(False)).alias("moment"), C.serial_text(F.lit(0.75), F.lit(True)).alias("clock"))


@query("SELECT l_orderkey, l_linenumber, regexp_replace(l_extendedprice::VARCHAR, '\\.0$', '') AS price, regexp_replace(l_discount::VARCHAR, '\\.0$', '') AS discount FROM lineitem")
def number_text(spark, sf_dir):
    """Doubles as the shortest text, without a fraction where there is none."""
    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(T.significant)

    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shown("l_extendedprice").alias("price"), shown("l_discount").alias("discount"))


# ------------------------------------------------------------------ layout, relational forms

_SIZES = "(SELECT l_suppkey AS g, l_orderkey * 8 + l_linenumber AS seq, 8 + (l_quantity::INTEGER % 9) * 0.5 AS size, 1 + (l_partkey % 40) AS chars FROM lineitem)"
_MODE = f"""(SELECT g, size AS mode FROM (SELECT g, size, row_number() OVER (PARTITION BY g ORDER BY sum(chars) DESC, min(seq)) AS r FROM {_SIZES} GROUP BY g, size) WHERE r = 1)"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
                                                    (8 + (F.col("l_quantity").cast("int") % 9) * 0.5).cast("double").alias("size"), (1 + F.col("l_partkey") % 40).alias("chars"))


@query(f"SELECT g, mode::DOUBLE AS mode FROM {_MODE}")
def body_size_mode(spark, sf_dir):
    return relational.weighted_mode(_sizes(spark, sf_dir), "g", F.floor(F.col("size") * 2 + 0.5) / 2, F.col("chars"), "seq")


@query(f"""SELECT g, seq, CASE WHEN size / mode >= 1.7 THEN 1 WHEN size / mode >= 1.35 THEN 2 WHEN size / mode >= 1.15 THEN 3 END::INTEGER AS level FROM {_SIZES} JOIN {_MODE} USING (g)""")
def heading_level(spark, sf_dir):
    sizes = _sizes(spark, sf_dir)
    return sizes.join(body_size_mode(spark, sf_dir), "g").select("g", "seq", C.heading_level(F.col("size"), F.col("mode")).alias("level"))


_SPANS = "(SELECT l_suppkey AS g, l_orderkey * 8 + l_linenumber AS seq, l_extendedprice AS x0, l_extendedprice + l_quantity AS x1 FROM lineitem)"
_UNION = f"""(SELECT g, island, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM (
               SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY g ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {_SPANS})) GROUP BY g, island)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("x0"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("x1"))


@query(f"SELECT g, island::BIGINT AS island, x0 AS start, x1 AS \"end\" FROM {_UNION}")
def column_intervals(spark, sf_dir):
    return relational.interval_union(_spans(spark, sf_dir), "g", "x0", "x1")


@query(f"""WITH u AS {_UNION}, p AS (SELECT l_suppkey AS g, l_suppkey * 1000000000 + l_orderkey * 8 + l_linenumber AS seq, min(l_extendedprice) * 0.97 AS x FROM lineitem GROUP BY ALL),
                b AS (SELECT p.g, p.seq, p.x, u.island AS i FROM p ASOF LEFT JOIN u ON p.g = u.g AND p.x >= u.x0),
                c AS (SELECT b.seq, b.x, u.island, u.x0, u.x1 FROM b JOIN u ON u.g = b.g AND u.island BETWEEN coalesce(b.i, 0) AND coalesce(b.i, 0) + 1)
           SELECT seq, island::BIGINT AS island FROM (SELECT seq, island, row_number() OVER (PARTITION BY seq ORDER BY greatest(x0 - x, x - x1, 0), island) AS r FROM c) WHERE r = 1""")
def nearest_column(spark, sf_dir):
    points = _spans(spark, sf_dir).groupBy("g", (F.col("g") * 1_000_000_000 + F.col("seq")).alias("seq")).agg((F.min("x0") * 0.97).alias("x"))
    return relational.nearest_interval(points, column_intervals(spark, sf_dir), "g", "seq", "x")


_BASE = "(SELECT l_suppkey AS g, l_orderkey * 8 + l_linenumber AS seq, (l_orderkey * 8 + l_linenumber) * 2.0 AS y, 10 + max(l_quantity::INTEGER % 3) * 0.6 AS size FROM lineitem GROUP BY ALL)"


@query(f"""SELECT g, seq, sum(new) OVER (PARTITION BY g ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS para_no FROM (
             SELECT *, CASE WHEN y - lag(y) OVER w > 0 AND y - lag(y) OVER w <= 1.7 * greatest(size, lag(size) OVER w) AND abs(size - lag(size) OVER w) <= 0.08 * lag(size) OVER w THEN 0 ELSE 1 END AS new
             FROM {_BASE} WINDOW w AS (PARTITION BY g ORDER BY seq))""")
def paragraph_islands_simple(spark, sf_dir):
    """Paragraphs by pitch and size alone; the rules that depend on a paragraph's length are off."""
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("g"), seq.alias("seq")).agg((F.lit(10.0) + F.max(F.col("l_quantity").cast("int") % 3) * 0.6).alias("size"))
    lines = lines.withColumn("y", F.col("seq") * 2.0)
    return relational.paragraph_islands(lines, "g", "seq", "y", "size").select("g", "seq", "para_no")


@query("""WITH i AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS level FROM conversations),
               r AS (SELECT *, CASE WHEN level = 0 THEN NULL ELSE max(CASE WHEN level = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS run FROM i)
          SELECT conv_id, turn, level, row_number() OVER (PARTITION BY conv_id, level, run ORDER BY turn)::INTEGER AS label_no FROM r""")
def list_numbering(spark, sf_dir):
    """Turns as a nested list; the inner numbers start again below each outer item."""
    items = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", 0).otherwise(1).alias("level"))
    return relational.list_labels(items, "conv_id", "turn", "level")


@query("""SELECT l_orderkey, l_linenumber, ((l_linenumber - 1) // 3)::INTEGER AS chunk FROM lineitem""")
def slide_chunks(spark, sf_dir):
    """Table rows dealt to slides, three to each."""
    l = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("k"))
    return relational.chunks(l, "k", 3).select("l_orderkey", "l_linenumber", "chunk")


# ------------------------------------------------------------------ the matrix

_PAIRS_SQL = "(VALUES " + ", ".join(f"('{s}', '{t}', '{e}')" for s, t, e in matrix.PAIRS) + ") m(source, target, engine)"


@query(f"""SELECT DISTINCT source, target FROM (SELECT source, target FROM {_PAIRS_SQL}
           UNION ALL SELECT s, t FROM (VALUES {", ".join(f"('{s}')" for s in matrix.IMAGES)}) i(s), (VALUES {", ".join(f"('{t}')" for t in matrix.IMAGE_TARGETS)}) g(t)) WHERE source != target""")
def catalogue_targets(spark, sf_dir):
    """What is offered for each source."""
    m = matrix.matrix(spark)
    sources = sorted({s for s, _, _ in matrix.PAIRS} | set(matrix.IMAGES))
    return reduce(DataFrame.unionByName, (matrix.targets(m, s).select(F.lit(s).alias("source"), "target") for s in sources))


@query(f"SELECT source, target, engine FROM {_PAIRS_SQL} WHERE contains(source || ' to ' || target || ' ' || engine, 'to pdf')")
def catalogue_search(spark, sf_dir):
    return matrix.search(matrix.matrix(spark), "  To PDF ")


@query(f"SELECT a.source, a.target, a.engine FROM {_PAIRS_SQL.replace(' m(', ' a(')} SEMI JOIN {_PAIRS_SQL.replace(' m(', ' b(')} ON a.source = b.target AND a.target = b.source")
def catalogue_swaps(spark, sf_dir):
    return matrix.swaps(matrix.matrix(spark)).select("source", "target", "engine")


@query(f"SELECT source, string_agg(target, ', ' ORDER BY target) AS targets FROM (SELECT DISTINCT source, target FROM {_PAIRS_SQL}) GROUP BY source")
def catalogue_usage(spark, sf_dir):
    return matrix.usage(matrix.matrix(spark))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'BMP to PDF is not supported. ' WHEN 1 THEN 'ZZZ files are not supported as conversion input.' WHEN 2 THEN 'The file is empty.' END AS reason FROM pages"""
       .replace("'BMP to PDF is not supported. '", "'BMP to PDF is not supported.'"))
def refusals(spark, sf_dir):
    k = F.col("page_id") % 4
    source = F.when(k == 0, F.lit("bmp")).when(k == 1, F.lit("zzz")).otherwise(F.lit("txt"))
    size = F.when(k == 2, 0).otherwise(F.length("html"))
    return _table(spark, sf_dir, "pages").select("page_id", matrix.refusal(source, F.lit("pdf"), size, source).alias("reason"))


# ------------------------------------------------------------------ round trips through real bytes

def _cells_of(files: DataFrame, key: str) -> DataFrame:
    """Non-empty table cells read back from output files, with the table's key."""
    read = convert.read(convert.detect(files))
    return model.cells(read).select(F.col("doc_id").alias(key), "row_no", "col_no", "value").where("value != ''")


def _written(documents: DataFrame, target: str) -> DataFrame:
    """Output files of documents as input files again."""
    out = convert.emit(documents.withColumn("target", F.lit(target)))
    return out.select("doc_id", F.explode("outputs").alias("o")).select("doc_id", F.col("o.name").alias("name"), F.lit(None).cast("string").alias("declared"), F.col("o.data").alias("content"))


def _table_documents(rows: DataFrame, key: Column, cells: list[Column], header: list[str], order: list[Column] | None = None) -> DataFrame:
    """One document per key with one table: a header row and the rows in order of their cells, or of
    other columns."""
    line = F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in cells))
    placed = F.struct(*(c.alias(f"o{n}") for n, c in enumerate(order or [])), line.alias("line"))
    grouped = rows.select(key.cast("string").alias("doc_id"), placed.alias("placed")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("placed")), lambda r: r["line"]).alias("lines"))
    block = F.named_struct(F.lit("type"), F.lit("table"), F.lit("level"), F.lit(None).cast("int"), F.lit("text"), F.lit(None).cast("string"), F.lit("bold"), F.lit(None).cast("boolean"), F.lit("size"), F.lit(None).cast("double"),
                           F.lit("lines"), F.lit(None).cast("array<string>"), F.lit("cells"), F.lit(None).cast("array<string>"), F.lit("rows"), F.concat(F.array(F.array(*(F.lit(h) for h in header))), F.col("lines")))
    page = F.named_struct(F.lit("name"), F.lit(None).cast("string"), F.lit("width"), F.lit(841.89), F.lit("height"), F.lit(595.28), F.lit("blocks"), F.array(block), F.lit("items"), F.lit(None).cast(model.ArrayType(model.ITEM)))
    return grouped.select("doc_id", F.col("doc_id").alias("title"), F.lit("csv").alias("source"), F.array(page).alias("pages"), F.lit(None).cast("string").alias("error"))


_NATION_SQL = """WITH r AS (SELECT n_regionkey::VARCHAR AS region, [n_name, n_nationkey::VARCHAR] AS line FROM nation),
   n AS (SELECT region, row_number() OVER (PARTITION BY region ORDER BY line)::INTEGER AS row_no, line FROM r UNION ALL SELECT DISTINCT region, 0, ['name', 'key'] FROM r)
   SELECT region, row_no, c::INTEGER AS col_no, line[c + 1] AS value FROM n, range(2) t(c)"""


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_documents(_table(spark, sf_dir, "nation"), F.col("n_regionkey"), [F.col("n_name"), F.col("n_nationkey")], ["name", "key"])


@query(_NATION_SQL)
def xlsx_roundtrip(spark, sf_dir):
    return _cells_of(_written(_nations(spark, sf_dir), "xlsx"), "region")


@query(_NATION_SQL)
def docx_table_roundtrip(spark, sf_dir):
    return _cells_of(_written(_nations(spark, sf_dir), "docx"), "region")


@query(_NATION_SQL)
def pptx_table_roundtrip(spark, sf_dir):
    return _cells_of(_written(_nations(spark, sf_dir), "pptx"), "region")


@query(_NATION_SQL)
def pdf_table_roundtrip(spark, sf_dir):
    return _cells_of(_written(_nations(spark, sf_dir), "pdf"), "region")


@query("""SELECT c_nationkey::VARCHAR AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name)::INTEGER AS row_no, c_name AS name, regexp_replace(c_acctbal::VARCHAR, '\\.0$', '') AS balance, c_mktsegment AS segment FROM customer""")
def xlsx_numbers_roundtrip(spark, sf_dir):
    """Balances survive as numeric cells, with all their digits.  Customers of one name stay in the
    order of the table, as the SQL leaves them."""
    @F.pandas_udf("string")
    def digits(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else repr(float(v)).removesuffix(".0"))

    c = _table(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_mktsegment", digits("c_acctbal").alias("balance"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    order = [F.col("c_name").isNull(), F.col("c_name"), F.col("file"), F.col("row")]
    files = _written(_table_documents(c, F.col("c_nationkey"), [F.col("c_name"), F.col("balance"), F.col("c_mktsegment")], ["name", "balance", "segment"], order), "xlsx")
    rows = model.blocks(convert.read(convert.detect(files))).select(F.col("doc_id").alias("nation"), F.posexplode("rows").alias("row_no", "r")).where("row_no > 0")
    return rows.select("nation", "row_no", *(F.get("r", F.lit(i)).alias(n) for i, n in enumerate(("name", "balance", "segment"))))


@query("""WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, role, text FROM conversations)
          SELECT conv_id::VARCHAR AS doc_id, 2 * k AS block_no, 'heading' AS type, role AS text FROM r UNION ALL SELECT conv_id::VARCHAR, 2 * k + 1, 'paragraph', text FROM r""".replace("2 * k AS", "(2 * k)::INTEGER AS"))
def docx_roundtrip(spark, sf_dir):
    """Conversations as Word documents and back, block by block."""
    files = _written(_talks(spark, sf_dir), "docx")
    return model.blocks(convert.read(convert.detect(files))).select("doc_id", "block_no", "type", "text")


@query("""WITH r AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS page_no, role, text FROM conversations)
          SELECT conv_id::VARCHAR AS doc_id, page_no, 0 AS block_no, 'heading' AS type, role AS text FROM r UNION ALL SELECT conv_id::VARCHAR, page_no, 1, 'paragraph', text FROM r""")
def pptx_roundtrip(spark, sf_dir):
    """Conversations as presentations and back: a slide per turn, titled by its role."""
    read = convert.read(convert.detect(_written(_talks(spark, sf_dir), "pptx")))
    return model.blocks(read).select("doc_id", "page_no", "block_no", "type", "text")


@query("""SELECT doc_id::VARCHAR AS doc_id, CASE WHEN regexp_matches(text, '[^{SP}]') THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) END::BIGINT AS letters FROM documents""".replace("[^{SP}]", "[^" + SP[1:]))
def pdf_roundtrip(spark, sf_dir):
    """Every text as PDF and back: no letter is lost in layout and extraction.  Blank and null texts
    make a PDF without text, which the reader reports as an error: their count is null."""
    # a file is one task for each of its row groups, which hold many texts, and a text is dear
    return _letters(_table(spark, sf_dir, "documents").repartition(4 * spark.sparkContext.defaultParallelism))


def _letters(d: DataFrame) -> DataFrame:
    docs = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("title"), F.lit("txt").alias("source"), render.txt_pages(F.col("text")).alias("pages"), F.lit(None).cast("string").alias("error"))
    read = convert.read(convert.detect(_written(docs, "pdf")))
    text = F.array_join(F.flatten(F.transform("pages", lambda p: F.transform(p["blocks"], lambda b: F.coalesce(b["text"], F.array_join(F.flatten(b["rows"]), " "))))), "\n")
    return read.select("doc_id", F.length(F.regexp_replace(text, "[^A-Za-z]", "")).cast("long").alias("letters"))


# ------------------------------------------------------------------ readers over hand-built files

QUERIES |= fixtures.QUERIES
ORACLE_SQL |= fixtures.ORACLE_SQL
