"""Exact top-k search by inner product with vector-approximation files.

Components become integers, floor(256 * x). A table of approximations is stored beside the vectors: a byte a
component (an eighth of the whole number) names the cell that holds it, cells being quantiles of that component over a sample, closed by the least
and greatest values of all rows. A scan reads approximations only and bounds every score from both sides, as a
cell bounds its component; a candidate whose upper bound is below the k-th best lower bound of its query
can't be a result. Exact vectors are then read for what is left, in the order of the bounds: first a few for each
query, and after the k-th exact score among those is known, only the ones whose bounds reach it.

Equal vectors are searched once: the search runs between different vectors, each with its k + 1
smallest ids, and each query then leaves out its own rows. So neither a common vector nor ties at
the k-th place make more candidates.

The scan is dealt in blocks: every block of queries meets every block of approximations in one task, so a task
holds two blocks and nothing grows with the table but the number of tasks. Exact vectors of candidates are shuffled
once for each reading, however many blocks of queries there are.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor
do null ids. Vectors of different lengths don't meet. Rows of equal id and vector count once; different vectors
of one id count each, and none is a candidate of its own id. Ties go to the
smaller id. Scores must fit 64 bits; components of up to 2**24 are exact. Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed, table, written

K, QUERY_MODULO = 5, 50
BITS = 8
#: Rows of a candidate block and of a query block, on average.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 4096
#: Vectors that the cells' borders are taken from, on average: a documented sample.
SAMPLE_ROWS = 4096
#: Queries of a block that the scan takes at once.
STRIP = 64
#: Exact vectors that the first reading takes for each query, a multiple of the results asked for.
FIRST_READING = 4


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """first (the smallest id), v, ids (the k + 1 smallest ids) for each different vector of rows (vec_id, v)."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.min("vec_id").alias("first"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of a batch's list column, by length."""
    column = batch.column(at)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, flat[(starts[rows][:, None] + np.arange(size)).astype(np.int64)].reshape(len(rows), size)


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]


def cell_tables(points: DataFrame) -> dict[int, Cells]:
    """For each vector length: the cuts between cells (component, 2**BITS - 1), and the cells' least and greatest values.

    Cuts come from a hashed sample, the ends of the outer cells from all rows.
    """

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _matrices(batch, 0):
                size = x.shape[1]
                yield pa.record_batch([pa.array(np.full(size, size)), pa.array(np.arange(size)), pa.array(x.min(0)), pa.array(x.max(0))], names=["size", "at", "low", "high"])

    ends: dict[int, dict[int, tuple[int, int]]] = {}
    for r in points.select("v").mapInArrow(extremes, "size long, at long, low long, high long").groupBy("size", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        ends.setdefault(r["size"], {})[r["at"]] = (r["low"], r["high"])  # one row a component
    n = points.count()
    draw = F.pmod(F.xxhash64("key", F.lit("cells")), F.lit(1_000_003)) / 1_000_003.0
    by_length: dict[int, list] = {}
    for v in points.where(draw < min(1.0, SAMPLE_ROWS / max(n, 1))).select("v").toPandas()["v"]:
        by_length.setdefault(len(v), []).append(v)
    share = np.arange(1, 1 << BITS) / (1 << BITS)
    out = {}
    for size, each in ends.items():
        low, high = (np.array([each[j][i] for j in range(size)], np.int64) for i in (0, 1))
        if size in by_length:
            cuts = np.quantile(np.array(by_length[size], np.float64), share, axis=0, method="lower").T.astype(np.int64)
        else:  # one cell
            cuts = np.repeat(high[:, None] + 1, len(share), axis=1)
        floors = np.concatenate([low[:, None], cuts], axis=1)
        tops = np.concatenate([cuts - 1, high[:, None]], axis=1)
        out[size] = cuts, floors, np.maximum(tops, floors)
    return out


def approximations(points: DataFrame, tables: dict[int, Cells]) -> DataFrame:
    """key, size, cells of each vector: a byte for each component."""
    shared = points.sparkSession.sparkContext.broadcast({d: t[0] for d, t in tables.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch, 1):
                size = x.shape[1]
                codes = np.zeros(x.shape, np.uint8)
                for j in range(size):
                    codes[:, j] = np.searchsorted(shared.value[size][j], x[:, j], side="right")
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(x), size, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["key", "size", "cells"])

    return points.select("key", "v").mapInArrow(run, "key long, size int, cells binary")


def _block_scan(k: int, shared):
    """For each query of a block pair, the candidates that could be among its k best, with bounds of their scores."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for size, part in pdf.groupby("size"):
            queries, rest = part[part["v"].notna()], part[part["v"].isna()]
            if queries.empty or rest.empty:
                continue
            q_ids, c_ids = queries["key"].to_numpy(), rest["key"].to_numpy()
            q = np.array(queries["v"].tolist(), np.float64).reshape(len(queries), size)
            codes = np.frombuffer(b"".join(rest["cells"]), np.uint8).reshape(len(rest), size)
            if size:
                _, floors, tops = shared.value[size]
                low, high = (t[np.arange(size), codes].astype(np.float64) for t in (floors, tops))
            else:
                low = high = np.zeros((len(rest), 0))
            # float sums of whole numbers below 2**53 are exact; beyond, bounds are widened
            most = size * max(np.abs(q).max(initial=0), 1) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0), 1)
            slack = 0.0 if most < 2**52 else 1e-9
            take = min(k, len(rest))
            for start in range(0, len(q), STRIP):
                strip = q[start : start + STRIP]
                up, down = np.maximum(strip, 0), np.minimum(strip, 0)
                upper, lower = up @ high.T + down @ low.T, up @ low.T + down @ high.T
                if slack:
                    upper, lower = upper + np.abs(upper) * slack + 1, lower - np.abs(lower) * slack - 1
                bound = np.partition(lower, len(rest) - take, axis=1)[:, len(rest) - take]
                i, j = np.nonzero(upper >= bound[:, None])
                for column, values in zip(out, (q_ids[start + i], c_ids[j], lower[i, j], upper[i, j]), strict=True):
                    column.append(values)
        kinds = (np.int64, np.int64, np.float64, np.float64)
        joined = [np.concatenate(a) if a else np.zeros(0, t) for a, t in zip(out, kinds, strict=True)]
        return pd.DataFrame(dict(zip(("query", "candidate", "lower", "upper"), joined, strict=True)))

    return scan


def _kth(scores: DataFrame, by: str, k: int, name: str) -> DataFrame:
    """query, name: the k-th best of column by for each query; null if there are fewer."""
    order = Window.partitionBy("query").orderBy(F.desc(by))
    best = scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.groupBy("query").agg(F.max(F.when(F.col("place") == k, F.col(by))).alias(name))


def _read(pairs: DataFrame, points: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """query, candidate, score of the pairs, from their exact vectors."""
    both = pairs.select("query", "candidate").join(points.select(F.col("key").alias("candidate"), "v"), "candidate")
    both = both.join(query_vectors.select(F.col("key").alias("query"), F.col("v").alias("w")), "query")
    product = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0).cast("long"), lambda t, x: t + x)
    return both.select("query", "candidate", product.alias("score"))


def nearest(points: DataFrame, query_vectors: DataFrame, k: int, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(query, candidate, score) of exact vectors that hold each query's k best, and the pairs that bounds alone left."""
    n, m = points.count(), query_vectors.count()
    c_blocks, q_blocks = max(1, -(-n // candidate_block)), max(1, -(-m // query_block))
    tables = cell_tables(points)
    cells = written(approximations(points, tables), "cells")
    deal = lambda c, b: F.pmod(F.xxhash64("key", F.lit(c)), F.lit(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    candidates = cells.select("key", "size", "cells", F.lit(None).cast("array<long>").alias("v"), deal("c", c_blocks).alias("c"), every(q_blocks).alias("q"))
    questions = query_vectors.select("key", F.size("v").alias("size"), F.lit(None).cast("binary").alias("cells"), "v", every(c_blocks).alias("c"), deal("q", q_blocks).alias("q"))
    scan = _block_scan(k, points.sparkSession.sparkContext.broadcast(tables))
    found = checkpointed(candidates.unionByName(questions).groupBy("c", "q").applyInPandas(scan, "query long, candidate long, lower double, upper double"))
    left = found.join(_kth(found, "lower", k, "sure"), "query").where(F.col("sure").isNull() | (F.col("upper") >= F.col("sure"))).drop("sure")
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "candidate")
    left = checkpointed(left.withColumn("place", F.row_number().over(order)))
    early = checkpointed(_read(left.where(F.col("place") <= FIRST_READING * k), points, query_vectors))
    late = left.where(F.col("place") > FIRST_READING * k).join(_kth(early, "score", k, "reached"), "query").where(F.col("reached").isNull() | (F.col("upper") >= F.col("reached")))
    return early.unionByName(_read(late, points, query_vectors)), left


def top_k(vectors: DataFrame, k: int = K, modulo: int = QUERY_MODULO, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the queries (ids divisible by modulo) among vectors (vec_id, embedding)."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding")).alias("v")).distinct()
    rows = checkpointed(rows)
    asked = rows.where(F.col("vec_id") % modulo == 0)
    points = checkpointed(distinct_vectors(rows, k).withColumn("key", F.monotonically_increasing_id()))
    query_vectors = checkpointed(asked.select("v").distinct().join(points.select("v", "key"), "v"))
    # an id's own vectors take places that others must not lose
    own = asked.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    found, _ = nearest(points, query_vectors, k + own, candidate_block, query_block)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    # candidates' ids, and the ids of the rows that ask with this vector
    held = found.join(points.select(F.col("key").alias("candidate"), "first", "ids"), "candidate")
    top = held.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + own)
    answers = top.select("query", "score", F.explode("ids").alias("vec_id"))
    line = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("place", F.row_number().over(line)).where(F.col("place") <= k + own).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id"))).alias("list"))
    askers = asked.join(query_vectors.select("v", F.col("key").alias("query")), "v").select(F.col("vec_id").alias("query_id"), "query")
    given = askers.join(answers, "query").select("query_id", F.filter("list", lambda x: x["vec_id"] != F.col("query_id")).alias("list"))
    ranked = given.select("query_id", F.posexplode(F.slice("list", 1, k)).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


#: DuckDB: all scores of the queries by list functions.
SQL = f"""
WITH ok AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
      FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {QUERY_MODULO} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
