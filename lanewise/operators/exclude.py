"""Dropping pairs that have a forbidden boundary strictly inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.predicates import Phase
from ..schemas import Tables
from ..storage import written
from .match import endpoints
from .pair import renumbered
from .scan import bounds_of, next_value

#: Exclusion points up to which they are sent to every task and compared with each pair; beyond, pairs look for their next point.
BROADCAST_POINTS = 500
#: Points a bucket of cycles holds, so that a block that most points fall into is many tasks.
POINTS = 1 << 18
KEY = ["trace", "s_row_idx", "s_stage"]


def exclude_between(pairs: DataFrame, tables: Tables, phase: Phase, scope: str = "rows", broadcast_points: int = BROADCAST_POINTS) -> DataFrame:
    """pairs (of pair_phases) without those that a matching boundary of `phase` lies strictly inside.

    Inside means strictly between the two cycles, in any order. Scope `rows` also asks for a row
    strictly between the two rows, of any thread; scope `all` takes any row and thread. Numbers
    are given anew.
    """
    if scope not in ("rows", "all"):
        raise ValueError(f"scope is rows or all, not {scope!r}")
    points = endpoints(tables, phase).select("trace", F.col("row_idx").alias("p_row"), F.col("cycle").alias("p_cycle")).distinct()
    points = written(points, "points")
    few = points.limit(broadcast_points + 1).count() <= broadcast_points
    if few:
        inside = (F.col("p_cycle") > F.least("s_cycle", "t_cycle")) & (F.col("p_cycle") < F.greatest("s_cycle", "t_cycle"))
        if scope == "rows":
            inside &= (F.col("p_row") > F.least("s_row_idx", "t_row_idx")) & (F.col("p_row") < F.greatest("s_row_idx", "t_row_idx"))
        p = points.withColumnRenamed("trace", "p_trace")
        return renumbered(pairs.join(F.broadcast(p), (F.col("trace") == F.col("p_trace")) & inside, "left_anti"))
    # numbering reads what is left twice
    hit = written(_hit_any(pairs, points) if scope == "all" else _hit_rows(pairs, points), "hit")
    return renumbered(pairs.join(hit, KEY, "left_anti"))


def _hit_any(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Keys of pairs whose cycles enclose a point: the next point after the lower cycle is below the higher one."""
    low, high = F.least("s_cycle", "t_cycle"), F.greatest("s_cycle", "t_cycle")
    asked = pairs.select(*KEY, low.alias("at"), high.alias("high"), F.lit(None).cast("long").alias("point"))
    given = points.select("trace", F.lit(None).cast("long").alias("s_row_idx"), F.lit(None).cast("int").alias("s_stage"), F.col("p_cycle").alias("at"), F.lit(None).cast("long").alias("high"), F.col("p_cycle").alias("point")).distinct()
    after = next_value(asked.unionByName(given), ["trace"], "at", F.col("point"), "next", bounds_of(points, "p_cycle", POINTS))
    return after.where("high is not null and next < high").select(*KEY)


def _hit_rows(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Keys of pairs that enclose a point by rows and cycles.

    The next point after a pair's lower cycle decides many pairs: there is no point inside if it isn't below the higher one, and
    there is one if it is and its row lies inside. So does the last point before the pair's later row, by its cycle, for what is left.
    The others are met in blocks of rows.
    """
    near = written(_next_points(pairs, points), "near-points").where("next.p_cycle < high")
    inside = F.col("next.p_row").between(F.col("first"), F.col("stop") - 1)
    found, spans = near.where(inside).select(*KEY), near.where(~inside).drop("next")
    if spans.isEmpty():
        return found
    near = written(_last_points(spans, points), "last-points").where("-next.place >= first")
    inside = (F.col("next.p_cycle") > F.col("at")) & (F.col("next.p_cycle") < F.col("high"))
    found, spans = found.union(near.where(inside).select(*KEY)), near.where(~inside).drop("next")
    return found if spans.isEmpty() else found.union(_hit_blocks(spans, points))


def _next_points(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs of any rows between (KEY, first, stop, at, high) with next: the point (p_cycle, p_row) of least cycle beyond `at`, the lower cycle."""
    first, last = F.least("s_row_idx", "t_row_idx") + 1, F.greatest("s_row_idx", "t_row_idx") - 1
    point = F.struct("p_cycle", "p_row")
    kind = points.select(point.alias("p")).schema["p"].dataType
    spans = pairs.select(*KEY, first.alias("first"), (last + 1).alias("stop"), F.least("s_cycle", "t_cycle").alias("at"), F.greatest("s_cycle", "t_cycle").alias("high"), F.lit(None).cast(kind).alias("point")).where("first < stop")
    given = points.select("trace", F.col("p_cycle").alias("at"), point.alias("point"))
    after = next_value(spans.unionByName(given, allowMissingColumns=True), ["trace"], "at", F.col("point"), "next", bounds_of(points, "p_cycle", POINTS))
    return after.where("high is not null").select(*KEY, "first", "stop", "at", "high", "next")


def _last_points(spans: DataFrame, points: DataFrame) -> DataFrame:
    """spans with next: the point (place, its row negated, and p_cycle) of greatest row before `stop`."""
    given = points.select("trace", (-F.col("p_row")).alias("place"), "p_cycle")
    point = F.struct("place", "p_cycle")
    kind = given.select(point.alias("p")).schema["p"].dataType
    asked = spans.select("*", (-F.col("stop")).alias("place"), F.lit(None).cast(kind).alias("point"))
    both = asked.unionByName(given.select("trace", "place", point.alias("point")), allowMissingColumns=True)
    return next_value(both, ["trace"], "place", F.col("point"), "next", bounds_of(given, "place", POINTS)).where("high is not null").select(*spans.columns, "next")


def _hit_blocks(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Keys of spans (of _next_points) that enclose a point.

    A pair's open row interval is the union of at most two power-of-two blocks a level; each point
    is in one block a level. In a block, only cycles are left to compare: the pair is hit if the next point
    after its lower cycle comes before its higher one. Levels end at the longest row distance of the pairs.
    """
    longest = spans.agg(F.max(F.col("stop") - F.col("first"))).first()[0]
    levels = list(range((longest or 1).bit_length() + 1))
    blocks = []
    for level in levels:
        size = 1 << level
        a, b = F.floor((F.col("first") + (size - 1)) / size).cast("long"), F.floor(F.col("stop") / size).cast("long")
        blocks.append(F.when((a < b) & (a % 2 == 1), F.struct(F.lit(level).alias("level"), a.alias("block"))))
        blocks.append(F.when((a < b) & (b % 2 == 1), F.struct(F.lit(level).alias("level"), (b - 1).alias("block"))))
    nodes = spans.select(*KEY, "at", "high", F.explode(F.array_compact(F.array(*blocks))).alias("n"))
    asked = nodes.select(*KEY, "at", "high", F.lit(None).cast("long").alias("point"), "n.level", "n.block")
    own = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("p_row", k).alias("block")) for k in levels])).alias("n")
    given = points.select("trace", "p_cycle", own).select("trace", F.lit(None).cast("long").alias("s_row_idx"), F.lit(None).cast("int").alias("s_stage"), F.col("p_cycle").alias("at"), F.lit(None).cast("long").alias("high"), F.col("p_cycle").alias("point"), "n.level", "n.block")
    after = next_value(asked.unionByName(given), ["trace", "level", "block"], "at", F.col("point"), "next", bounds_of(points, "p_cycle", POINTS))
    return after.where("high is not null and next < high").select(*KEY).distinct()
