"""Pairing each source occurrence with the k-th later row of its thread that has a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import Phase, compare
from ..schemas import Tables
from ..storage import written
from .match import endpoints
from .scan import numbered, running_sum

KINDS = {"delays": (">=", 0), "overlaps": ("<", 0), "both": None}
FIELDS = ["op_id", "row_idx", "stage", "name", "lane", "start_cycle", "end_cycle", "cycle"]


def pair_phases(tables: Tables, source: Phase, target: Phase, skip: int = 0, gaps: tuple[tuple[str, int], ...] = (), rows: tuple[tuple[str, int], ...] = (), kind: str = "both") -> DataFrame:
    """hit_idx, trace, tid, source and target fields (s_*, t_*), elapsed = target cycle - source cycle.

    A target row counts once, by its matching occurrence of least (cycle, stage). `skip` rows with
    a target are passed over. gaps (on elapsed), rows (on the distance of rows) and kind act after
    pairing: they drop pairs, and never choose another target.
    """
    if skip < 0 or any(v < 0 for _, v in rows):
        raise ValueError("skip and row distances are not negative")
    if kind not in KINDS:
        raise ValueError(f"kind is one of {tuple(KINDS)}, not {kind!r}")
    s = endpoints(tables, source)
    t = endpoints(tables, target).groupBy("trace", "tid", "row_idx").agg(F.min(F.struct("cycle", "stage", *[c for c in FIELDS if c not in ("cycle", "stage", "row_idx")])).alias("t"))
    # both are used twice below, once for buckets' rows and once for their totals
    s_side = s.select("trace", "tid", F.col("row_idx").alias("at"), F.lit(0).alias("is_target"), F.struct(*FIELDS).alias("x"))
    t_side = t.select("trace", "tid", F.col("row_idx").alias("at"), F.lit(1).alias("is_target"), F.struct(*[F.col("row_idx") if c == "row_idx" else F.col(f"t.{c}").alias(c) for c in FIELDS]).alias("x"))
    counted = running_sum(written(s_side.unionByName(t_side), "endpoints"), ["trace", "tid"], "at", F.col("is_target"), "c")
    left = counted.where("is_target = 0").select("trace", "tid", (F.col("c") + 1 + skip).alias("ordinal"), F.col("x").alias("s"))
    right = counted.where("is_target = 1").select("trace", "tid", F.col("c").alias("ordinal"), F.col("x").alias("t"))
    pairs = left.join(right, ["trace", "tid", "ordinal"])
    out = pairs.select("trace", "tid", *[F.col(f"s.{c}").alias(f"s_{c}") for c in FIELDS], *[F.col(f"t.{c}").alias(f"t_{c}") for c in FIELDS], (F.col("t.cycle") - F.col("s.cycle")).alias("elapsed"))
    for op, value in [*gaps, *([KINDS[kind]] if KINDS[kind] else [])]:
        out = out.where(compare(F.col("elapsed"), op, value))
    for op, value in rows:
        out = out.where(compare(row_distance(), op, value))
    return renumbered(written(out, "pairs"))


def row_distance() -> Column:
    return F.abs(F.col("t_row_idx") - F.col("s_row_idx"))


def renumbered(pairs: DataFrame) -> DataFrame:
    """pairs with hit_idx: their order by source row and stage."""
    return numbered(pairs.drop("hit_idx"), ["trace"], ["s_row_idx", "s_stage"], "hit_idx")
