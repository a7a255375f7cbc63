"""What is known about single operations: details, reports, dependencies, stage times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import after_last
from ..schemas import Tables

#: Columns whose 64-bit values are written as text, so that JSON readers keep them exact.
WIDE = ("bigint", "decimal")


def status_col() -> Column:
    return F.when(F.col("flushed"), "flushed").when(F.col("incomplete"), "incomplete").when(F.col("rid").isNotNull(), "retired").otherwise("active")


def stage_elapsed(tables: Tables) -> DataFrame:
    """Stages with shown_end (the last cycle + 1 if not known) and elapsed, not below 0."""
    s = tables.stages.join(tables.traces.select("trace", "last_cycle"), "trace")
    end = F.coalesce(F.col("end_cycle"), after_last())
    return s.withColumn("shown_end", end).withColumn("elapsed", F.greatest(end - F.col("start_cycle"), F.lit(0))).drop("last_cycle")


def first_phase(tables: Tables) -> DataFrame:
    """trace, op_id, first_phase: the least stage start of each operation, else its fetch cycle."""
    first = tables.stages.groupBy("trace", "op_id").agg(F.min("start_cycle").alias("s"))
    return tables.ops.join(first, ["trace", "op_id"], "left").select("trace", "op_id", F.coalesce("s", "fetch_cycle").alias("first_phase"))


def lanes(tables: Tables) -> DataFrame:
    """trace, op_id, lane, lane_index, lane_count, n_stages: an operation's lanes in order of first appearance."""
    return tables.stages.groupBy("trace", "op_id", "lane").agg(F.min("lane_index").alias("lane_index"), F.max("lane_count").alias("lane_count"), F.count("*").alias("n_stages"))


def dependency_edges(tables: Tables) -> DataFrame:
    """Dependencies with the rows of both operations; the producer's is null if it isn't in the trace."""
    rows = tables.ops.select("trace", "op_id", "row_idx")
    own = tables.deps.join(rows, ["trace", "op_id"])
    made = rows.select("trace", F.col("op_id").alias("producer"), F.col("row_idx").alias("producer_row"))
    return own.join(made, ["trace", "producer"], "left").select("trace", "op_id", "seq", "producer", "kind", "cycle", "row_idx", "producer_row")


def _with_parts(tables: Tables, ids: DataFrame | None) -> DataFrame:
    key = ["trace", "op_id"]
    ops, stages, deps = tables.ops, tables.stages, tables.deps
    if ids is not None:
        wanted = ids.select("op_id").distinct()
        ops, stages = ops.join(wanted, "op_id", "left_semi"), stages.join(wanted, "op_id", "left_semi")
        deps = deps.join(wanted, "op_id", "left_semi") if deps is not None else None
    s = stages.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("stage", "lane", "name", "lane_index", "lane_count", "start_cycle", "end_cycle", "labels", "open"))).alias("stages"))
    out = ops.join(s, key, "left")
    if deps is None:
        return out.withColumn("deps", F.lit(None).cast("array<struct<seq:int,producer:bigint,kind:bigint,cycle:bigint>>"))
    d = deps.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "producer", "kind", "cycle"))).alias("deps"))
    return out.join(d, key, "left")


def operation_details(tables: Tables, ids: DataFrame) -> DataFrame:
    """The operations of ids (op_id) with their stages and dependencies as ordered arrays."""
    return _with_parts(tables, ids)


def metadata_text(tables: Tables, ids: DataFrame | None = None) -> DataFrame:
    """trace, op_id, report: an operation as plain text."""
    text = lambda c: F.col(c).cast("string")
    head = F.concat(
        F.col("label"), F.lit("\nOp "), text("op_id"), F.lit(" · Global "), text("gid"), F.lit(" · Thread "), text("tid"), F.lit("\nRetired ID: "), F.coalesce(F.concat(F.lit("Some("), text("rid"), F.lit(")")), F.lit("None")),
        F.lit("\nCycles: "), text("fetch_cycle"), F.lit("–"), F.coalesce(text("end_cycle"), F.lit("active")), F.lit(" · Source line "), text("line"), F.lit("\nStatus: "), status_col(), F.lit("\n"), F.col("detail"),
    )
    stage = lambda x: F.concat(F.lit("\n"), x["lane"], F.lit(" / "), x["name"], F.lit(": "), x["start_cycle"].cast("string"), F.lit("–"), F.coalesce(x["end_cycle"].cast("string"), F.lit("active")), F.lit(" "), x["labels"])
    dep = lambda x: F.concat(F.lit("\nDepends on "), x["producer"].cast("string"), F.lit(" · type "), x["kind"].cast("string"), F.lit(" · cycle "), x["cycle"].cast("string"))
    joined = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ""), F.lit(""))
    return _with_parts(tables, ids).select("trace", "op_id", F.concat(head, joined("stages", stage), joined("deps", dep)).alias("report"))


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON (column json), whole numbers of 64 bits and more as text; nulls are left out."""
    exact = [F.col(f.name).cast("string").alias(f.name) if f.dataType.simpleString().startswith(WIDE) else F.col(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*exact)).alias("json"))
