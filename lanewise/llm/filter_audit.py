"""Filter interaction audit: what each filter removes in every order, by contractions of a contingency tensor.

Five filters judge a whole text, each on its own: A too few words, B too few different words, C too
many capitals, D forbidden signs, E a copy of a text with a smaller id, wherever in the table that is. A part's
documents are counted by the five outcomes, so that a part is a tensor of 2x2x2x2x2 counts (axis: filter;
0 pass, 1 fail), and one more of the good and one of the toxic documents. What a filter does at a step
of an order is then a contraction of that tensor with a vector for each axis: pass, fail or all.

Work grows with the documents only up to the counts: texts are read once for their outcomes and a
digest; copies are counted before they are dealt by digest, so a text that a third of the rows share is a
few rows there; 32 cells a part go on, and every order is derived from these.

Defined results: a null text is empty (A fails, B to D pass). A null source is the part ''. A row without an id
is no copy of a smaller id. Rows that repeat an id and its text are counted each, and all are the first copy if it is
the least id. Of a document's labels the good and the toxic ones count if any row says so; documents
without labels are neither. Texts of any length are read whole. An empty table has no parts and no rows. Columns other
than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2  # words; percent of the words; percent of the code points
WORD, CAPITAL, SIGN = r"[^\x20\x09-\x0D]+", r"[A-Z]", r"[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUT = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)


def text_outcomes(text: Column) -> Column:
    """A whole number of four bits: bit k is set if filter ABCD[k] fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, CAPITAL, ""))
    fails = [n < LEAST_WORDS, distinct * 100 < n * LEAST_DISTINCT, capitals * 100 > F.length(text) * MOST_CAPITALS, text.rlike(SIGN)]
    bits = [F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, digest, bits, good, toxic, n of the documents: n rows of one id, text and part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_outcomes(text).cast("int").alias("bits"))
    slim = written(slim, "outcomes")
    told = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
    told = told.agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    named = slim.where("doc_id is not null").join(told, "doc_id", "left").na.fill(0, ["good", "toxic"])
    return named.groupBy("doc_id", "part", "digest", "bits", "good", "toxic").agg(F.count("*").alias("n")).unionByName(
        slim.where("doc_id is null").groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n")).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, cell, n, good, toxic: the tensors' counts that aren't zero; cell has a bit for each failing filter.

    Copies of a part with the same labels are one row (copies have the same outcomes in A to D), with the least id
    and how many rows have it; of these rows, at most four a part and digest, the least id over all is the first copy.
    """
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    alike = marked(docs, labels).groupBy("digest", "part", "bits", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"), first.alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("free") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    judged = alike.withColumn("least", least).select("part", "bits", "good", "toxic", passing.alias("first"), (F.col("n") - passing).alias("copies"))
    both = judged.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("bits").alias("cell"), F.col("first").alias("n")), F.struct((F.col("bits") + 16).alias("cell"), F.col("copies").alias("n")))).alias("x"))
    n = F.col("x.n")
    return both.where(n > 0).groupBy("part", F.col("x.cell").alias("cell")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def _selectors() -> dict[str, np.ndarray]:
    """For each measure, a vector for each order, step and axis: (600, 5, 2)."""
    kept, removed, failing, alone = ([] for _ in range(4))
    for order in ORDERS:
        for step, name in enumerate(order):
            before = order[:step]
            kept.append([PASS if f in before or f == name else ALL for f in FILTERS])
            removed.append([PASS if f in before else FAIL if f == name else ALL for f in FILTERS])
            failing.append([FAIL if f == name else ALL for f in FILTERS])
            alone.append([FAIL if f == name else PASS for f in FILTERS])
    return {k: np.array(v, np.int64) for k, v in (("kept", kept), ("removed", removed), ("failing", failing), ("alone", alone))}


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Counts (parts, orders x steps) of tensors (parts, 2, 2, 2, 2, 2) under a vector for each axis."""
    return np.einsum("pabcde,na,nb,nc,nd,ne->pn", tensors, *(chosen[:, k] for k in range(5)), optimize=True)


def audit(tensors: np.ndarray) -> np.ndarray:
    """(parts, 600, measures) of tensors (parts, 3, 2, 2, 2, 2, 2): all, good and toxic documents."""
    s = _selectors()
    removed = contract(tensors[:, 0], s["removed"])
    steps = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    shapley = np.stack([removed[:, steps == k].sum(1) for k in range(5)], 1)[:, steps]
    parts = [contract(tensors[:, 0], s["kept"]), removed, contract(tensors[:, 0], s["failing"]) - removed, contract(tensors[:, 0], s["alone"]), contract(tensors[:, 1], s["removed"]), contract(tensors[:, 2], s["removed"]), shapley]
    return np.stack(parts, 2)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the measures, for each part, all 120 orders and their five steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = np.repeat(ORDERS, 5)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, listed = batch.column(0).slice(begin, 256), batch.column(1).slice(begin, 256)
                flat = np.zeros((len(part), 3, 32), np.int64)
                rows = np.repeat(np.arange(len(part)), np.asarray(pa.compute.list_value_length(listed)))
                values = listed.flatten()
                cell = values.field("cell").to_numpy()
                for k, name in enumerate(("n", "good", "toxic")):
                    flat[rows, k, cell] = values.field(name).to_numpy()
                # a cell's lowest bit is A: the last axis of the reshaped counts, so axes are turned around
                tensors = flat.reshape(len(part), 3, 2, 2, 2, 2, 2).transpose(0, 1, 6, 5, 4, 3, 2)
                found = audit(tensors).reshape(-1, len(MEASURES))
                names = part.take(pa.array(np.repeat(np.arange(len(part)), len(orders))))
                yield pa.record_batch([names, pa.array(np.tile(orders, len(part))), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(part) * len(ORDERS))), *[pa.array(found[:, k]) for k in range(len(MEASURES))]], names=["part", "filter_order", "step", *MEASURES])

    counted = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return counted.mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT w.doc_id, part, CAST(len(words) < 200 AS INT) AS a, CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT) AS b,
        CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS INT) AS c, CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d,
        CAST(coalesce(w.doc_id > least, false) AS INT) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = w.doc_id),
cell AS (SELECT part, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a + b + c + d + e AS n_fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, a, b, c, d, e),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letter p, letter q, letter r, letter s, letter t
           WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
steps AS (SELECT o, CAST(k AS INT) AS step, o[k] AS x, list_transform(range(1, k), lambda i: o[i]) AS before FROM orders, range(1, 6) g(k)),
judged AS (SELECT part, o, step, x, n, good, toxic, n_fails, fails[x] = 1 AS fails_here, len(list_filter(before, lambda y: fails[y] = 1)) > 0 AS gone FROM cell, steps),
counted AS (SELECT part, o, step, x, sum(CASE WHEN NOT gone AND NOT fails_here THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails_here THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND fails_here THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails_here AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND fails_here THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails_here THEN toxic ELSE 0 END) AS toxic_lost FROM judged GROUP BY part, o, step, x)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted
"""
