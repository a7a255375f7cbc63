"""A trace as a small raster, and value suggestions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.patterns import first_line, lines, wildcard
from ..schemas import Tables
from ..storage import written
from .match import with_op_columns

MAX_WIDTH, MAX_HEIGHT, COLORS, FLUSHED_BIT = 256, 1024, 8, 128
SUGGESTIONS, VALUE_LIMIT = 16, 160
#: Rows of each trace that suggestions are sought in first.
LEADING = 1 << 16
FIELDS = ("instruction", "phase", "lane", "metadata", "op_metadata", "phase_metadata")


def symbols(stages: DataFrame) -> DataFrame:
    """trace, name, symbol_id: lanes and names numbered by first appearance (row, stage, the lane before the name)."""
    each = stages.select("trace", F.explode(F.array(F.struct("row_idx", "stage", F.lit(0).alias("k"), F.col("lane").alias("name")), F.struct("row_idx", "stage", F.lit(1).alias("k"), F.col("name").alias("name")))).alias("x"))
    first = each.groupBy("trace", F.col("x.name").alias("name")).agg(F.min(F.struct("x.row_idx", "x.stage", "x.k")).alias("first"))
    return first.select("trace", "name", (F.row_number().over(Window.partitionBy("trace").orderBy("first")) - 1).alias("symbol_id"))


def overview(tables: Tables, width: int = MAX_WIDTH, height: int = MAX_HEIGHT) -> DataFrame:
    """trace, y, x, color, flushed: the cells of a raster that stages cover; of several stages the last by row and stage shows.

    Of stages with one span of cells the latest is found first, then that of each cell; both are aggregated before
    their shuffles, so at most height x width^2 spans and height x width cells a trace leave a task.
    """
    w = max(1, min(width, MAX_WIDTH))
    # few names have most stages each: written, their size is known, so they are sent to the stages rather than these dealt by name
    names = written((tables.symbols if tables.symbols is not None else symbols(tables.stages)).select("trace", "symbol_id", "name"), "symbols")
    info = tables.traces.select("trace", F.col("count").alias("n"), F.col("first_cycle").alias("c0"), F.col("last_cycle").alias("c1"))
    h = F.greatest(F.least(F.lit(min(height, MAX_HEIGHT)), F.col("n")), F.lit(1))
    s = with_op_columns(tables.stages, tables, ["flushed"]).join(F.broadcast(info), "trace").join(names, ["trace", "name"])
    last = F.greatest(F.coalesce(F.col("end_cycle") - 1, F.col("c1")), F.col("start_cycle"))
    first_x, last_x = column(F.col("start_cycle"), w), column(last, w)
    # one number for place and looks, of which the greatest is the latest: it is aggregated by hashing, structs would be sorted
    looks = (1 + F.pmod("symbol_id", F.lit(COLORS))) * 4 + F.coalesce(F.col("flushed").cast("int"), F.lit(2))
    c = F.col("row_idx").cast("decimal(20,0)") * F.lit(Decimal(1 << 37)) + (F.col("stage").cast("long") * 64 + looks).cast("decimal(18,0)")
    spans = s.select(
        "trace", c.cast("decimal(38,0)").alias("c"),
        F.least(F.floor(F.col("row_idx").cast("decimal(20,0)") * h / F.greatest("n", F.lit(1))), h - 1).cast("int").alias("y"),
        first_x.alias("first_x"), F.greatest(last_x, F.least(first_x + 2, F.lit(w - 1))).alias("last_x"),
    )
    latest = F.max("c").alias("c")
    cells = spans.groupBy("trace", "y", "first_x", "last_x").agg(latest).select("trace", "y", "c", F.explode(F.sequence("first_x", "last_x")).alias("x"))
    shown = cells.groupBy("trace", "y", "x").agg(latest)
    color, flushed = F.shiftright(F.col("_looks"), 2), F.when(F.col("_looks") % 4 < 2, F.col("_looks") % 4 == 1)
    shown = shown.withColumn("_looks", F.pmod("c", F.lit(Decimal(64))).cast("int"))
    return shown.select("trace", "y", "x", (color + F.when(flushed, FLUSHED_BIT).otherwise(0)).alias("color"), flushed.alias("flushed"))


def column(cycle: Column, width: int) -> Column:
    """The raster column of a cycle: its part of the trace's cycles, scaled to the width."""
    span = (F.greatest(F.col("c1") - F.col("c0"), F.lit(0)) + 1).cast("decimal(20,0)")
    at = F.greatest(cycle - F.col("c0"), F.lit(0)).cast("decimal(20,0)")
    return F.least(F.floor(at * width / span), F.lit(width - 1)).cast("int")


def suggest(tables: Tables, field: str, text: str = "", n: int = SUGGESTIONS, rows: int = LEADING) -> DataFrame:
    """trace, value: the first n different values of a field that the pattern is found in, sorted by value.

    First is by row, then the detail's lines before the stages. Values are not empty and have at
    most 160 characters. The leading rows of each trace are searched, and more of them, 16 times as many each time, until every
    trace has n values or no further rows: on saved traces, whose rows are in order, a frequent pattern reads a bounded part.
    """
    if field not in FIELDS:
        raise ValueError(f"field is one of {FIELDS}, not {field!r}")
    if len(text.encode()) > 2048:
        raise ValueError("the pattern is too long")
    while True:
        first = written(_first_values(tables, field, text, n, rows), "suggestions")  # n rows a trace
        full = first.groupBy("trace").agg(F.count("*").alias("found")).where(F.col("found") >= n)
        if tables.ops.where(F.col("row_idx") >= rows).select("trace").join(full, "trace", "left_anti").isEmpty():
            return first.orderBy("trace", "value")
        rows *= 16


def _first_values(tables: Tables, field: str, text: str, n: int, rows: int) -> DataFrame:
    ops, stages = tables.ops.where(F.col("row_idx") < rows), tables.stages.where(F.col("row_idx") < rows)
    place = lambda stage, k: F.struct("row_idx", F.lit(stage).alias("stage") if isinstance(stage, int) else stage, k)
    parts = []
    if field == "instruction":
        parts.append(ops.select("trace", place(-1, F.lit(0).alias("k")).alias("at"), first_line(F.col("label")).alias("value")))
    if field in ("metadata", "op_metadata"):
        each = ops.select("trace", "row_idx", F.posexplode(lines(F.col("detail"))).alias("k", "value"))
        parts.append(each.select("trace", place(-1, F.col("k")).alias("at"), "value"))
    if field in ("metadata", "phase_metadata"):
        each = stages.select("trace", "row_idx", "stage", F.posexplode(lines(F.col("labels"))).alias("k", "value"))
        parts.append(each.select("trace", place(F.col("stage"), F.col("k")).alias("at"), "value"))
    if field in ("phase", "lane"):
        parts.append(stages.select("trace", place(F.col("stage"), F.lit(0).alias("k")).alias("at"), F.col("name" if field == "phase" else "lane").alias("value")))
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    fits = values.where((F.col("value") != "") & (F.char_length("value") <= VALUE_LIMIT) & F.col("value").rlike(wildcard(text, whole=False)))
    first = fits.groupBy("trace", "value").agg(F.min("at").alias("at"))
    order = Window.partitionBy("trace").orderBy("at")
    return first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select("trace", "value")
