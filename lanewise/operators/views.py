"""Views of results and rows: order, pages, rectangles, lookups, areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scan import BUCKET, numbered, ranked

SPANS = ("both", "source", "target", "all")
PAGE_LIMIT, ROW_LIMIT, WINDOW_LIMIT = 128, 1024, 2048
#: Rows up to which a sorted page is cut from the first ones; deeper pages come from a distributed sort.
SHALLOW = 10_000


def sort_elapsed(hits: DataFrame, descending: bool = True) -> DataFrame:
    """hits by elapsed; equal ones by hit_idx, ascending either way."""
    return hits.orderBy(*by_elapsed(descending))


def by_elapsed(descending: bool) -> list[Column]:
    return [F.desc("elapsed") if descending else F.asc("elapsed"), F.asc("hit_idx")]


def ranked_elapsed(hits: DataFrame, descending: bool = True) -> DataFrame:
    """All hits with sort_idx, their place in sort_elapsed's order."""
    return ranked(hits, by_elapsed(descending), "sort_idx")


def top_elapsed(hits: DataFrame, k: int, descending: bool = True) -> DataFrame:
    return sort_elapsed(hits, descending).limit(k)


def page(hits: DataFrame, start: int, count: int, index: str = "hit_idx", limit: int = PAGE_LIMIT) -> DataFrame:
    """The hits from start, at most count (and at most limit): a range of their numbers, no offset."""
    if start < 0 or count < 0:
        raise ValueError("start and count are not negative")
    return hits.where((F.col(index) >= start) & (F.col(index) < start + min(count, limit)))


def sorted_page(hits: DataFrame, start: int, count: int, descending: bool = True) -> DataFrame:
    """A page in order of elapsed, with sort_idx."""
    stop = start + min(count, PAGE_LIMIT)
    if stop > SHALLOW:
        return ranked_elapsed(hits, descending).where((F.col("sort_idx") >= start) & (F.col("sort_idx") < stop))
    order = Window.orderBy(*by_elapsed(descending))  # over SHALLOW rows at most
    return top_elapsed(hits, stop, descending).withColumn("sort_idx", F.row_number().over(order).cast("long") - 1).where(F.col("sort_idx") >= start)


def hit(hits: DataFrame, index: int, ops: DataFrame, op: str = "s_op_id", trace: str | None = None) -> DataFrame:
    """One hit by its number, with its source operation's label and detail: that of the trace named, or of each trace."""
    found = hits.where(F.col("hit_idx") == index)
    return (found if trace is None else found.where(F.col("trace") == trace)).join(ops.select("trace", F.col("op_id").alias(op), "label", "detail"), ["trace", op])


def hit_bounds(hits: DataFrame, n_rows: Column | int, span: str = "both", row_pad: int = 0) -> DataFrame:
    """hits with cycle_start, cycle_end, row_start, row_end: a pair's rectangle, or a single phase's own."""
    if span not in SPANS or row_pad < 0:
        raise ValueError(f"span is one of {SPANS}, and the padding is not negative")
    last = F.greatest((F.lit(n_rows) if isinstance(n_rows, int) else n_rows) - 1, F.lit(0))
    if "t_row_idx" not in hits.columns:
        return hits.withColumns({"cycle_start": F.col("start_cycle"), "cycle_end": F.col("start_cycle") + F.col("elapsed"), "row_start": F.col("row_idx"), "row_end": F.col("row_idx")})
    s, t = F.col("s_row_idx"), F.col("t_row_idx")
    a, b = {"both": (F.least(s, t), F.greatest(s, t)), "source": (s, s), "target": (t, t), "all": (F.lit(0), last)}[span]
    return hits.withColumns(
        {
            "cycle_start": F.least("s_cycle", "t_cycle"),
            "cycle_end": F.greatest("s_cycle", "t_cycle"),
            "row_start": F.greatest(a - row_pad, F.lit(0)).cast("long"),
            "row_end": F.least(b + row_pad, last).cast("long"),
        }
    )


def hits_in_window(bounded: DataFrame, cycles: tuple[int, int], rows: tuple[int, int], limit: int | None = None, keep: int | None = None) -> DataFrame:
    """The hits whose rectangle meets the window, borders included.

    With a limit, the first of them by number in each trace; hit `keep` stands in for the last of these if it
    meets the window but comes later. They are cut down in buckets of numbers before a trace's are compared.
    """
    found = bounded.where(_meets(cycles, rows))
    if limit is None:
        return found
    chosen = F.lit(False) if keep is None else F.col("hit_idx") == keep
    order = [F.when(chosen, 0).otherwise(1), F.col("hit_idx")]
    for keys in (["trace", F.shiftright("hit_idx", BUCKET.bit_length() - 1)], ["trace"]):
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
    return found


def window_total(bounded: DataFrame, cycles: tuple[int, int], rows: tuple[int, int], by_trace: bool = False) -> DataFrame:
    """total: how many hits meet the window, whatever limit hits_in_window has; one row, or one for each trace with any."""
    return bounded.where(_meets(cycles, rows)).groupBy(*(["trace"] if by_trace else [])).agg(F.count("*").alias("total"))


def _meets(cycles: tuple[int, int], rows: tuple[int, int]) -> Column:
    return (F.col("cycle_start") <= cycles[1]) & (F.col("cycle_end") >= cycles[0]) & (F.col("row_start") <= rows[1]) & (F.col("row_end") >= rows[0])


def rows(ops: DataFrame, start: int, count: int, stride: int = 1, hide_flushed: bool = False) -> DataFrame:
    """Operations of rows [start, start + count * stride), every stride-th; with hide_flushed, rows count visible ones (view_row)."""
    if stride < 1 or start < 0 or count < 0:
        raise ValueError("stride is positive; start and count are not negative")
    shown = visible(ops, hide_flushed)
    at = F.col("view_row")
    return shown.where((at >= start) & (at < start + min(count, ROW_LIMIT) * stride) & ((at - start) % stride == 0))


def visible(ops: DataFrame, hide_flushed: bool) -> DataFrame:
    return numbered(ops.where(~F.col("flushed")), ["trace"], ["row_idx"], "view_row") if hide_flushed else ops.withColumn("view_row", F.col("row_idx"))


def locate(ops: DataFrame, wanted: DataFrame, by: str = "op_id") -> DataFrame:
    """Operations by op_id, row_idx or rid, for a whole table of wanted values.

    Of operations with one rid, the one that isn't flushed and has the lowest id.
    """
    if by == "rid":
        best = ops.where(~F.col("flushed") & F.col("rid").isNotNull()).join(wanted.select("rid").distinct(), "rid", "left_semi").groupBy("trace", "rid").agg(F.min_by(F.struct(*[c for c in ops.columns if c not in ("trace", "rid")]), "op_id").alias("x"))
        return best.select("trace", "rid", "x.*")
    if by not in ("op_id", "row_idx"):
        raise ValueError("by is op_id, row_idx or rid")
    return ops.join(wanted.select(by).distinct(), by, "left_semi")


def area_bounds(ops: DataFrame, a: int, b: int, hide_flushed: bool = False) -> DataFrame:
    """first_id, last_id, first_row, last_row of the displayed rows a to b, in either order; none if one is out of range."""
    low, high = min(a, b), max(a, b)
    shown = visible(ops, hide_flushed).where((F.col("view_row") == low) | (F.col("view_row") == high))
    found = shown.groupBy("trace").agg(F.min("op_id").alias("first_id"), F.max("op_id").alias("last_id"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"), F.count("*").alias("n"))
    return found.where(F.col("n") == (1 if low == high else 2)).drop("n")


def area_rows(ops: DataFrame, first_row: int, last_row: int, hide_flushed: bool = False) -> DataFrame:
    found = ops.where(F.col("row_idx").between(first_row, last_row))
    return found.where(~F.col("flushed")) if hide_flushed else found
