"""Matching stage occurrences, and stable numbers for what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import first_line, name_matches
from ..functions.predicates import Phase, after_last, boundary_cycle
from ..schemas import Tables
from .scan import numbered

EXCERPT = 160
#: Names that a pattern is replaced by at most.
LISTED = 500
STATUS, TEXTS = ["gid", "rid", "flushed", "incomplete"], ["label", "detail"]


def with_op_columns(stages: DataFrame, tables: Tables, columns: list[str]) -> DataFrame:
    """stages with their operations' columns; joined with operations only for those it doesn't have."""
    missing = [c for c in columns if c not in stages.columns]
    return stages.join(tables.ops.select("trace", "op_id", *missing), ["trace", "op_id"]) if missing else stages


def names_test(tables: Tables, column: str, pattern: str) -> Column:
    """The test of a name column, as a list of the traces' own names if they are known and not too many fit.

    Equality with listed names reaches Parquet's statistics and dictionaries, which an expression doesn't.
    """
    if pattern == "*" or tables.symbols is None:
        return name_matches(F.col(column), pattern)
    fit = tables.symbols.where(name_matches(F.col("name"), pattern)).select("name").distinct().limit(LISTED + 1).collect()  # LISTED + 1 rows at most
    return name_matches(F.col(column), pattern) if len(fit) > LISTED else F.col(column).isin([r[0] for r in fit])


def phase_rows(tables: Tables, phase: Phase) -> DataFrame:
    """The stage occurrences that meet the phase's conditions, open ones included, with their operations' status.

    Stages alone answer conditions on names, numbers and status; operations are met only for their texts, by the stages that
    pass the other conditions.
    """
    last = tables.traces.select("trace", "last_cycle")
    rows = with_op_columns(tables.stages.where(names_test(tables, "name", phase.name) & names_test(tables, "lane", phase.lane or "*")), tables, STATUS).join(F.broadcast(last), "trace")  # one row a trace
    rows = rows.where(phase.on_numbers())
    return with_op_columns(rows, tables, TEXTS).where(phase.on_texts()) if phase.needs_text() else rows.where(phase.on_texts())


def endpoints(tables: Tables, phase: Phase) -> DataFrame:
    """phase_rows at the phase's boundary (column cycle), without those whose end is not known."""
    rows = phase_rows(tables, phase)
    if phase.at == "end":
        rows = rows.where(~F.col("open"))
    return rows.withColumn("cycle", boundary_cycle(phase.at))


def skipped(tables: Tables, phase: Phase) -> DataFrame:
    """One row: how many matching occurrences were skipped, as their end was asked for but isn't known."""
    return phase_rows(tables, phase).agg(F.count_if(F.col("open") & F.lit(phase.at == "end")).alias("skipped"))


def excerpts(df: DataFrame) -> DataFrame:
    """df with instr_text (first line of the label), phase_text, lane_text and meta_text (detail and stage labels), 160 characters each."""
    shown = {"instr_text": first_line(F.col("label")), "phase_text": F.col("name"), "lane_text": F.col("lane"), "meta_text": F.concat(F.col("detail"), F.lit("\n"), F.col("labels"))}
    return df.withColumns({k: F.left(v, F.lit(EXCERPT)) for k, v in shown.items()})


def match_phases(tables: Tables, phase: Phase, texts: bool = True) -> DataFrame:
    """Every matching occurrence: hit_idx (order of row and stage), its place, cycle, elapsed and, with texts, excerpts."""
    found = endpoints(tables, phase).withColumn("elapsed", F.coalesce(F.col("end_cycle"), after_last()) - F.col("start_cycle"))
    place = ["trace", "op_id", "row_idx", "tid", "stage", "lane", "lane_index", "lane_count", "name", "start_cycle", "end_cycle", "open", "cycle", "elapsed"]
    if texts:
        found = excerpts(with_op_columns(found, tables, TEXTS)).select(*place, "instr_text", "phase_text", "lane_text", "meta_text")
    else:
        found = found.select(*place)
    return numbered(found, ["trace"], ["row_idx", "stage"], "hit_idx")


def query_stats(hits: DataFrame, skips: list[DataFrame]) -> DataFrame:
    """One row: hits and skipped, the sum over the scans given."""
    total = hits.agg(F.count("*").alias("hits"))
    gone = skips[0]
    for s in skips[1:]:
        gone = gone.unionAll(s)
    return total.crossJoin(gone.agg(F.sum("skipped").alias("skipped")))  # one row each
