"""SimHash near-duplicate detection with pigeonring filtering.

Fingerprint: ASCII-lower-cased words, word shingles with repeats, XXH64 (seed 42) of each; a bit is
1 if it is set in over half of the hashes. Two documents link if their fingerprints differ in at
most `budget` bits; components of the links are groups of near copies.

Candidates come from the pigeonring principle. The 64 bits form a ring of eight segments. If two
fingerprints differ in at most 2 bits, some start on the ring has a chain in which, for every
length l, the first l segments differ in at most l * 2 / 8 bits. So the first three segments are
equal (a 24-bit join key with the start), up to seven differ in at most one bit, all eight in two;
`chain` tests this before the full Hamming distance is taken.

Only different fingerprints take part, so exact copies cost nothing. Fingerprints in a key's group
of more than `group_bound` members leave the pairwise join; each of them sends itself and its 64
one-bit neighbours instead, and two of them share such a point exactly if they differ in at most
two bits. At most 65 fingerprints meet at a point, so no group is ever paired in full and no link is
lost.

`keep_one_of_each`, for whole corpora, takes what the fingerprints link as candidates and keeps those whose exact
shingle overlap (Jaccard) is 0.8 and more. As majority fingerprints lose pairs at that similarity, the pairs that they did not
find are then looked for by the exact search of `shingles`, which `similar_texts` uses alone.

Defined results: null and empty texts have fingerprint zero and link like any other. A component's
id is the smallest non-null doc_id in it (null if there is none). Repeated rows are returned each. Tables
without rows give none. Columns other than doc_id and text are neither read nor returned, but
by `keep_one_of_each`, which returns all as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import shingles
from .common import checkpointed, fresh, table

SEGMENTS, SEGMENT_BITS = 8, 8
BUDGET = 2
#: Members of a key's group that are paired with each other at most; larger groups go another way.
GROUP_BOUND = 64


def shingle_hashes(text: str | None, words_per_shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's shingles, repeats included; of the whole text if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= words_per_shingle:
        return np.frombuffer(digest(joined, 42), ">u8").astype(np.uint64)
    starts, at = [0], 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    raw = b"".join([digest(joined[i : j - 1], 42) for i, j in zip(starts, starts[words_per_shingle:], strict=False)])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    return majority(shingle_hashes(text, words_per_shingle))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """keep's columns with fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), words_per_shingle) for x in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.record_batch([*batch.columns[:-1], pa.array(values.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    source = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, fp long")


def _turned(fp: Column, start: int) -> Column:
    """fp turned so that the ring's segment `start` comes lowest."""
    bits = start * SEGMENT_BITS
    return fp if not bits else F.shiftrightunsigned(fp, bits).bitwiseOR(F.shiftleft(fp, 64 - bits))


def chain(difference: Column, budget: int) -> Column:
    """Whether every prefix of the chain, in a difference turned to its start, stays in its share of the budget."""
    tests = None
    for length in range(1, SEGMENTS + 1):
        low = difference if length == SEGMENTS else difference.bitwiseAND(F.lit((1 << (length * SEGMENT_BITS)) - 1))
        test = F.bit_count(low) <= length * budget // SEGMENTS
        tests = test if tests is None else tests & test
    return tests


def links(points: DataFrame, budget: int = BUDGET, group_bound: int = GROUP_BOUND) -> DataFrame:
    """(u, v), u < v: links that connect all of the different fingerprints (column fp) within the budget."""
    if budget != 2:
        raise ValueError("the chain keys are laid out for a budget of 2 bits")
    exact = -(-SEGMENTS // budget) - 1  # segments whose share of the budget is below one bit
    mask = F.lit((1 << (exact * SEGMENT_BITS)) - 1)
    starts = [F.struct(F.lit(i).cast("long").alias("start"), _turned(F.col("fp"), i).alias("turned")) for i in range(SEGMENTS)]
    keyed = points.select("fp", F.explode(F.array(*starts)).alias("s")).select("fp", F.col("s.turned").alias("turned"), (F.shiftleft(F.col("s.start"), exact * SEGMENT_BITS).bitwiseOR(F.col("s.turned").bitwiseAND(mask))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = checkpointed(keyed.join(sizes, "key"))
    small = members.where(F.col("n") <= group_bound)
    a, b = small.select("key", F.col("fp").alias("u"), F.col("turned").alias("tu")), small.select("key", F.col("fp").alias("v"), F.col("turned").alias("tv"))
    near = a.join(b, "key").where((F.col("u") < F.col("v")) & chain(F.col("tu").bitwiseXOR(F.col("tv")), budget) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= budget)).select("u", "v")
    crowded = members.where(F.col("n") > group_bound).select("fp").distinct()
    one = F.lit(1).cast("long")
    neighbours = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, k))))
    at = crowded.select("fp", F.explode(neighbours).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)
    star = at.select(F.array_min("met").alias("u"), F.explode("met").alias("v")).where(F.col("u") != F.col("v"))
    return near.union(star).distinct()


#: Edges of a task when components are found.
EDGES_PER_TASK = 50_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): each node of the edges (u, v) with the smallest node of its component.

    Alternates two star steps until nothing moves: every node passes its smallest neighbour to its
    larger neighbours, then to its smaller ones. The logarithm of the longest path bounds the rounds.
    Edges are dealt by the node that the next step groups by, over as many tasks as their number asks for. A round is three
    shuffles without joins, as what the driver keeps of stages and tasks until the job's end grows with their number.
    """
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(most, before[0] // EDGES_PER_TASK + 1))
    for _ in range(max_rounds):
        if not before[0]:
            break
        ends = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
        both = edges.select(F.explode(ends).alias("e")).select("e.a", "e.b").repartition(tasks, "a")
        least = both.withColumn("m", F.least(F.min("b").over(Window.partitionBy("a")), F.col("a")))
        large = least.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).repartition(tasks, "u").dropDuplicates(["u", "v"])
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        # the least neighbour's edge stays, the others' ends go to it
        moved = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = checkpointed(moved.repartition(tasks, "u").dropDuplicates(["u", "v"]))
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_copies(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id of each row of docs."""
    marks = checkpointed(fingerprints(docs, ["doc_id"], words_per_shingle=words_per_shingle))
    points = checkpointed(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(points.select("fp")))
    grouped = roots.join(points.withColumnRenamed("fp", "node"), "node")
    best = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = grouped.join(best, "root").select(F.col("node").alias("fp"), "component_id")
    label = points.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return marks.join(label, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_copies_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each document."""
    return near_copies(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def proposed_pairs(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(u, v), u < v: each of reps (node, doc_id, th) with the smallest node of its fingerprint, and a fingerprint's smallest node
    with the smallest one of those that link with it.
    """
    marks = fingerprints(docs.withColumn("th", shingles.text_hash()), ["doc_id", "th"])
    points = checkpointed(marks.join(reps, shingles.same_row(marks, reps)).select("node", "fp").distinct())
    first = checkpointed(points.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    several = first.where("n > 1").select("fp", "first")
    same = points.join(shingles.shipped(several), "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    first = first.drop("n")
    ends = links(first.select("fp")).join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v")
    near = ends.groupBy(F.greatest("a", "b").alias("v")).agg(F.min(F.least("a", "b")).alias("u")).select("u", "v")
    return checkpointed(same.union(near))


def similar_texts(docs: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """doc_id, component_id of each row of docs, components being those of shingle sets that overlap by 0.8 and more."""
    found = shingles.groups(docs, components, words_per_shingle)
    grouped = found.reps.join(found.roots, "node")
    best = grouped.groupBy("root").agg(F.min("first").alias("best"))
    moved = grouped.join(best, "root").select("pid", "best")
    label = found.reps.join(moved, "pid", "left").select("pid", F.coalesce("best", "first")["doc_id"].alias("component_id"))
    return found.rows.join(label, "pid").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """The documents, all columns kept, of which one of each group of near copies stays.

    The one with the smallest doc_id stays, rows without an id come last; of several texts with one id the
    one of the smallest hash, of repeated rows (equal id and text) any one. So different texts with equal or
    missing ids all stay unless they are near copies.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = shingles.groups(docs.select("doc_id", "text"), components, words_per_shingle, candidates=proposed_pairs)
    copies = found.rows.join(found.reps.select(F.col("node").alias("rid")), "rid", "left_anti").select("doc_id", "th")
    grouped = found.reps.join(found.roots, "node")
    best = grouped.groupBy("root").agg(F.min("first").alias("best"))
    near = checkpointed(grouped.join(best, "root").where(F.col("node") != F.col("best.node")).select("node", "doc_id", "th"))
    kept = checkpointed(found.reps.join(near.select("node"), "node", "left_anti").select("doc_id", "th"))
    copies = checkpointed(copies.distinct())
    # rows that are named like a kept one are repeats of it
    gone = near.select("doc_id", "th").union(copies.join(kept, shingles.same_row(copies, kept), "left_anti")).distinct()
    repeated = checkpointed(copies.join(kept, shingles.same_row(copies, kept), "left_semi"))
    gone, th = shingles.shipped(checkpointed(gone)), fresh(docs, "text_hash")
    named = docs.withColumn(th, shingles.text_hash())
    left = named.join(gone, shingles.same_row(named, gone, th=th), "left_anti")
    if repeated.isEmpty():
        return left.select(*columns)
    repeated = shingles.shipped(repeated)
    is_repeated = shingles.same_row(left, repeated, th=th)
    once = left.join(repeated, is_repeated, "left_semi").dropDuplicates(["doc_id", th])
    return left.join(repeated, is_repeated, "left_anti").select(*columns).unionByName(once.select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    return near_copies_of_documents(table(spark, sf_dir, "documents"))
