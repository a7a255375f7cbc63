"""Running sums, counts, least and greatest values over one long order, in parallel.

A window without a partition is one task. Here the order is cut into buckets by a whole number
that any row can compute (row div size); a window runs inside each bucket, a second one over one row
per bucket carries totals across, and a join brings them back. Buckets are values, not partitions,
so a task that runs again finds the same ones.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import written

#: Rows of a bucket, if rows are dense.
BUCKET = 65_536
#: Rows that a task sorts at once, of rows that are dealt by their number.
TASK_ROWS = 1 << 17


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, bucket: Column | None = None, size: int = BUCKET) -> DataFrame:
    """df with `name`: each row's position (from 0) within keys by order. The first order column must be a whole number."""
    lead = bucket if bucket is not None else F.col(order[0])
    cut = df.withColumn("_bucket", F.shiftright(lead, size.bit_length() - 1))
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    inside = cut.withColumn("_at", F.row_number().over(own).cast("long") - 1)
    totals = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return inside.join(bases, [*keys, "_bucket"]).withColumn(name, F.col("_at") + F.col("_base")).drop("_bucket", "_at", "_base")


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, size: int = BUCKET) -> DataFrame:
    """df with `name`: the sum of value over rows up to and with this one's order value (equal order values share it)."""
    cut = df.withColumn("_bucket", F.shiftright(F.col(order), size.bit_length() - 1)).withColumn("_value", value)
    own = Window.partitionBy(*keys, "_bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = cut.withColumn("_at", F.coalesce(F.sum("_value").over(own), F.lit(0)))
    totals = cut.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return inside.join(bases, [*keys, "_bucket"]).withColumn(name, F.col("_at") + F.col("_base")).drop("_bucket", "_value", "_at", "_base")


def cut_by(column: Column, bounds: list[int]) -> Column:
    """How many of the rising bounds are at most the column's value, by halving."""
    if not bounds:
        return F.lit(0)
    k = len(bounds) // 2
    bound = bounds[k] if bounds[k] < 1 << 63 else Decimal(bounds[k])
    return F.when(column < bound, cut_by(column, bounds[:k])).otherwise(cut_by(column, bounds[k + 1 :]) + (k + 1))


def bounds_of(df: DataFrame, column: str, size: int, most: int = 256) -> list[int]:
    """Values that cut df's rows into parts of about `size` rows, or of more if that were over `most` parts."""
    parts = min(most, -(-df.count() // size))
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 10_000)).first()[0]
    return sorted({int(x) for x in found})


def next_value(df: DataFrame, keys: list[str], order: str, value: Column, name: str, bounds: list[int]) -> DataFrame:
    """df with `name`: the least non-null value among rows strictly later in order.

    Rows of a key are cut into buckets at bounds (of bounds_of). A bucket is read from its end with a running least
    value, which costs one step a row; the least values of later buckets are carried in from one row each.
    """
    cut = df.withColumn("_bucket", cut_by(F.col(order), bounds)).withColumn("_value", value)
    own = Window.partitionBy(*keys, "_bucket").orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_at", F.min("_value").over(own))
    if not bounds:
        return inside.withColumnRenamed("_at", name).drop("_bucket", "_value")
    totals = cut.groupBy(*keys, "_bucket").agg(F.min("_value").alias("_n"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_base", F.min("_n").over(later)).drop("_n")
    return inside.join(bases, [*keys, "_bucket"]).withColumn(name, F.least("_at", "_base")).drop("_bucket", "_value", "_at", "_base")


def numbered_by_ranges(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """numbered for order columns of any kind and spread, which should tell a key's rows apart.

    A distributed sort by keys and order cuts the rows into ranges and is written once; the rows of each range and
    key are counted, a row each, and every key's counts are carried from range to range.
    """
    placed = written(df.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    bases = bases.select("_part", *keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return placed.join(bases, ["_part", *keys]).withColumn(name, F.col("_at") + F.col("_base")).drop("_at", "_part", "_base")


def dealt(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by key over a task for each `rows` rows, if that is more tasks than a shuffle has; else as it is.

    Windows and joins by the key then keep this number of tasks, so what a task sorts doesn't grow with df.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def is_dense(df: DataFrame, column: str, size: int = BUCKET) -> bool:
    """Whether a whole-number column's values fill the buckets that numbered would cut them into: one row in 1024 at most per bucket."""
    if df.schema[column].dataType.simpleString().startswith("decimal"):
        return False
    low, high, n = df.agg(F.min(column), F.max(column), F.count("*")).first()
    return not n or (high - low) // size <= n // 1024


def with_rows(ops: DataFrame, dense: bool | None = None) -> DataFrame:
    """ops with row_idx: each operation's place in its trace by op_id. Ids that are far apart, such as hashes, are numbered by sorted ranges."""
    if dense is None:
        dense = is_dense(ops, "op_id")
    return numbered(ops, ["trace"], ["op_id"], "row_idx") if dense else numbered_by_ranges(ops, ["trace"], ["op_id"], "row_idx")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`: each row's position (from 0) in an order of any columns, which should tell all rows apart.

    A distributed sort cuts df into ranges; the sorted rows are written once, so that their places
    stay the same, and each range's rows are counted: one row a sort partition is sent to every task.
    """
    placed = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.withColumn("_part", part).withColumn("_own", own).join(F.broadcast(bases), "_part").withColumn(name, F.col("_own") + F.col("_base")).drop("_at", "_part", "_own", "_base")
