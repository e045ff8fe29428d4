"""The relational operators inside readers and layout, as DataFrame operators of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def first_seen_keys(records: DataFrame, keys: Column, order: str) -> DataFrame:
    """pos and key: distinct keys of all records in the order they are first seen.

    The aggregation is partial before the shuffle; only the distinct keys, a header's worth, are
    ordered in one place.
    """
    seen = records.select(F.col(order).alias("at"), F.posexplode(keys).alias("k", "key"))
    firsts = seen.groupBy("key").agg(F.min(F.struct("at", "k")).alias("first"))
    return firsts.select((F.row_number().over(Window.orderBy("first")) - 1).alias("pos"), "key")


def duplicate_numbers(rows: DataFrame, table: str, order: str, name: str) -> DataFrame:
    """rows with `header`: names trimmed, blank ones numbered columns, repeated ones suffixed."""
    position = F.row_number().over(Window.partitionBy(table).orderBy(order))
    named = rows.withColumn("_n", position).withColumn("_h", C.trim(F.coalesce(F.col(name), F.lit(""))))
    named = named.withColumn("_h", F.when(F.col("_h") == "", F.concat(F.lit("column"), F.col("_n").cast("string"))).otherwise(F.col("_h")))
    again = F.row_number().over(Window.partitionBy(table, "_h").orderBy(order))
    header = F.when(again == 1, F.col("_h")).otherwise(F.concat("_h", F.lit("_"), again.cast("string")))
    return named.withColumn("header", header).drop("_n", "_h")


def weighted_mode(rows: DataFrame, group: str, value: Column, weight: Column, order: str) -> DataFrame:
    """group and mode: the value with the greatest total weight, the first seen of equals.

    Two partial aggregations; the winner is a max over a struct, so no group is sorted.
    """
    per = rows.groupBy(group, value.alias("_v")).agg(F.sum(weight).alias("_w"), F.min(order).alias("_first"))
    best = per.groupBy(group).agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col("_first"), F.col("_v"))).alias("_b"))
    return best.select(group, F.col("_b._v").alias("mode"))


def interval_union(intervals: DataFrame, group: str, start: str, end: str, slack: float = 0.0) -> DataFrame:
    """group, island, start, end: intervals that overlap or lie within slack become one."""
    order = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + slack), 1).otherwise(0))
    numbered = opened.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(group, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"))


def nearest_interval(points: DataFrame, intervals: DataFrame, group: str, point_id: str, at: str) -> DataFrame:
    """point_id, island: the nearest interval of the point's group, the earlier of equals.

    Intervals of a group are disjoint, so only the last that starts at or before the point and the
    next one can be nearest; one sort by place finds both, and points are not multiplied.
    """
    none = F.lit(None)
    ends = F.struct(F.col("start"), F.col("end"), F.col("island"))
    marks = intervals.select(group, F.col("start").alias("_x"), F.lit(0).alias("_k"), none.cast(points.schema[point_id].dataType).alias(point_id), ends.alias("_i"))
    asked = points.select(group, F.col(at).cast("double").alias("_x"), F.lit(1).alias("_k"), point_id, none.cast(marks.schema["_i"].dataType).alias("_i"))
    order = Window.partitionBy(group).orderBy("_x", "_k", point_id)
    both = marks.unionByName(asked)
    both = both.withColumn("_p", F.last("_i", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # backwards, as a frame that looks ahead to the end would be evaluated anew for every row
    back = Window.partitionBy(group).orderBy(F.desc("_x"), F.desc("_k"), F.desc(point_id))
    both = both.withColumn("_n", F.last("_i", True).over(back.rowsBetween(Window.unboundedPreceding, 0))).where("_k = 1")
    before, after = F.greatest(F.col("_x") - F.col("_p.end"), F.lit(0.0)), F.col("_n.start") - F.col("_x")
    nearest = F.when(F.col("_p").isNotNull() & (F.col("_n").isNull() | (before <= after)), F.col("_p.island")).otherwise(F.col("_n.island"))
    return both.where(F.col("_p").isNotNull() | F.col("_n").isNotNull()).select(point_id, nearest.alias("island"))


def paragraph_islands(lines: DataFrame, group: str, order: str, y: str, size: str) -> DataFrame:
    """lines with para_no: a line joins the one before if it is at most 1.7 sizes below it and of a
    size within 8 %.  These are the rules that do not depend on a paragraph's length so far."""
    w = Window.partitionBy(group).orderBy(order)
    pitch, last = F.col(y) - F.lag(y).over(w), F.lag(size).over(w)
    joins = (pitch > 0) & (pitch <= 1.7 * F.greatest(F.col(size), last)) & (F.abs(F.col(size) - last) <= 0.08 * last)
    opened = lines.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return opened.withColumn("para_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def densify(cells: DataFrame, sheet: str, row: str, col: str, value: str) -> DataFrame:
    """sheet, row, values: sparse cells as full rows up to the sheet's last column; rows without
    cells are empty.  Each row is assembled in place from its own cells."""
    one = cells.groupBy(sheet, row, col).agg(F.max(value).alias(value))  # a cell that is given twice
    filled = one.groupBy(sheet, row).agg(F.map_from_entries(F.collect_list(F.struct(col, value))).alias("_m"))
    extent = cells.groupBy(sheet).agg(F.max(row).alias("_rows"), F.max(col).alias("_cols"))
    grid = extent.select(sheet, "_cols", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows").cast("long"))).alias(row))
    full = grid.join(filled.withColumn(row, F.col(row).cast("long")), [sheet, row], "left")
    values = F.transform(F.sequence(F.lit(0), F.col("_cols").cast("int")), lambda c: F.coalesce(F.try_element_at("_m", c), F.lit("")))
    return full.select(sheet, row, values.alias("values"))


def list_labels(items: DataFrame, group: str, order: str, level: str) -> DataFrame:
    """items with label_no: numbers of nested lists, which start again below a higher item."""
    w = Window.partitionBy(group).orderBy(order)
    tables = items
    # an item's run starts after the last item of a higher level
    above = F.max(F.when(F.col(level) == 0, F.col(order))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    tables = tables.withColumn("_run", F.when(F.col(level) == 0, F.lit(None)).otherwise(above))
    return tables.withColumn("label_no", F.row_number().over(Window.partitionBy(group, level, "_run").orderBy(order))).drop("_run")


def chunks(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with chunk: consecutive numbers 0, 1, ... for every `size` values of order."""
    return rows.withColumn("chunk", F.floor(F.col(order) / size).cast("int"))
