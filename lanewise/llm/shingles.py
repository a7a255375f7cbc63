"""Groups of texts whose sets of word shingles overlap by 0.8 and more, without loss.

A text's set has the 64-bit hashes of its shingles (ASCII-lower-cased words), each once; a text of fewer
words is one shingle. Two sets link if their Jaccard similarity is at least 4 / 5, which is the same as
9 * common >= 4 * (sizes of both). That is tested on the whole sets.

Candidates come from prefixes: in one order of all shingles, two sets with n and m members that overlap so
far share at least 0.8 * max(n, m) of them, so they share one among the first n - ceil(0.8 * n) + 1 and the
first m - ceil(0.8 * m) + 1. Any order will do; shingles that a sample of the texts has often come last, the
others by hash, so that common lines seldom stand in a prefix. What is missing in the sample or in its
bounded table costs time only.

A candidate pair is pruned by sizes and by parity fingerprints: each shingle turns one bit over, so
fingerprints differ in at most as many bits as the sets in members, of which a link allows a ninth of both
sizes. A fingerprint has at least two bits a shingle; a short one of 512 bits goes along where pairs are made.

Equal sets are one node. Each member of a shingle's group is first held against the group's smallest member.
Groups of three and more that then still hold several components meet in full, in cells of bounded blocks:
only pairs of different components that pass the short fingerprint leave the join, and of those that share
several groups most leave it in one of them only. Links inside a component would change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import WordHasher, checkpointed, mixed, text_chunks, written

#: A text of so many is in the sample, shingles in at least so many of its texts come last, and how many of them at most.
SAMPLE, COMMON, COMMON_TABLE = 16, 4, 1 << 16
#: Members of a group's block; two blocks meet in a task.
BLOCK = 4096
#: Rows (of a few numbers each) up to which a list is sent to every task; longer ones are met by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Groups of a set that are listed with it, the first ones in the order of their keys.
LISTED = 8
#: Longs of a short fingerprint, and the least of a whole one.
SHORT, LEAST = 8, 32
SIGNS = [f"s{i}" for i in range(SHORT)]
_STEP = np.uint64(0xD1342543DE82EF95)


def shingle_sets(column: pa.Array, words_per_shingle: int) -> Iterator[np.ndarray]:
    """Each row's different shingle hashes in ascending order; nulls and empty texts have none."""
    hasher = WordHasher()
    for _, data, offsets in text_chunks(column):
        lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        words, _, _, row = hasher(lower, offsets)
        borders = np.searchsorted(row, np.arange(len(offsets)))
        whole = np.zeros(max(len(words) - words_per_shingle + 1, 0), np.uint64)
        for i in range(words_per_shingle):
            whole = whole * _STEP + words[i : i + len(whole)]
        whole = mixed(whole)
        for a, b in zip(borders[:-1], borders[1:]):
            if b - a >= words_per_shingle:
                yield np.unique(whole[a : b - words_per_shingle + 1])
            else:
                short = np.zeros(min(b - a, 1), np.uint64)
                for w in words[a:b]:
                    short = short * _STEP + w
                yield mixed(short)


ARROW = {"pid": pa.int64(), "n": pa.int32(), "shingles": pa.list_(pa.int64()), "bits": pa.list_(pa.int64())} | dict.fromkeys(SIGNS, pa.int64())


def _mapped(docs: DataFrame, words_per_shingle: int, kinds: str, cells) -> DataFrame:
    """docs' first columns but the last, the text, with the cells of each text's set."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [cells(s) for s in shingle_sets(part.column(part.num_columns - 1), words_per_shingle)]
                more = [pa.array([r[name] for r in rows], ARROW[name]) for name in names]
                yield pa.record_batch([*part.columns[:-1], *more], names=[*part.schema.names[:-1], *names])

    given = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, given + kinds)


def _parity(s: np.ndarray, longs: int) -> np.ndarray:
    odd = np.bincount((s % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fingerprint_longs(n: int) -> int:
    """Longs of the whole fingerprint of a set of n: a power of two, two bits a shingle at least."""
    return max(LEAST, 1 << max(0, (2 * n - 1) // 64).bit_length())


def _pid(s: np.ndarray) -> int:
    """The set's name: equal sets have equal ones."""
    return int(np.array(xxhash.xxh64_intdigest(s.tobytes(), 42), np.uint64).view(np.int64))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def text_hash() -> Column:
    return F.xxhash64("text")


def common_shingles(docs: DataFrame, words_per_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of the sample, ascending, and their counts."""
    some = docs.where(F.pmod(text_hash(), F.lit(SAMPLE)) == 0).select("text").distinct()
    each = _mapped(some, words_per_shingle, "shingles array<long>", lambda s: {"shingles": s.view(np.int64)})
    counts = each.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    top = counts.orderBy(F.desc("n"), "s").limit(COMMON_TABLE).toArrow()
    s, n = top.column("s").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def marked(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """rid (a number of the row), doc_id, th (the text's hash), pid, n, shingles (the prefix) and fingerprints of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words_per_shingle))

    def cells(s: np.ndarray) -> dict:
        common, counts = shared.value
        size = prefix_length(len(s))
        ordered = s[:size]
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            weight = np.where(common[at] == s, counts[at], 0)
            ordered = s[np.argsort(weight, kind="stable")[:size]]
        return {"pid": _pid(s), "n": len(s), "shingles": ordered.view(np.int64), "bits": _parity(s, fingerprint_longs(len(s)))} | dict(zip(SIGNS, _parity(s, SHORT).tolist(), strict=True))

    kinds = "pid long, n int, shingles array<long>, bits array<long>, " + ", ".join(f"{s} long" for s in SIGNS)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_hash().alias("th"), "text")
    return written(_mapped(rows, words_per_shingle, kinds, cells), "near-marks")


def _limit(apart: Column) -> Column:
    """Whether sets of n and m members that differ in `apart` members, or more, can still link."""
    n, m = F.col("n").cast("long"), F.col("m").cast("long")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * apart.cast("long") <= n + m)


def _bits_apart() -> Column:
    """Bits in which the fingerprints a and b differ; the longer one is folded to the other's length first."""

    def fitted(x: str, y: str) -> Column:
        half = F.size(y)
        folded = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > half, folded).otherwise(F.col(x))

    each = F.zip_with(fitted("a", "b"), fitted("b", "a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(each, F.lit(0), lambda t, x: t + x)


def shipped(small: DataFrame) -> DataFrame:
    """small, marked for a broadcast if it has few rows; it should be cut from its lineage before."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def same_row(a: DataFrame, b: DataFrame, doc_id: str = "doc_id", th: str = "th") -> Column:
    """Whether rows of a and b (doc_id, th) name the same document, a missing id being equal to a missing one."""
    return a[doc_id].eqNullSafe(b["doc_id"]) & (a[th] == b["th"])


@dataclass
class Groups:
    """rows: rid, doc_id, th, pid of each document. reps: each different set's pid, its first row (node, doc_id, th)
    and first, what it is ordered by. roots: node, root of the sets that link with others."""

    rows: DataFrame
    reps: DataFrame
    roots: DataFrame


def groups(docs: DataFrame, components, words_per_shingle: int = 5, block: int = BLOCK, candidates=None) -> Groups:
    """The groups of docs (doc_id, text); components gives (node, root) of links (u, v).

    candidates, called with docs and reps, gives pairs (u, v) of nodes, u < v, that another search proposes: they are tested first,
    and those that link are not looked at again.
    """
    marks = marked(docs, words_per_shingle)
    rows = marks.select("rid", "doc_id", "th", "pid")
    # rows without an id come last
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", F.col("rid").alias("node"))
    reps = checkpointed(rows.groupBy("pid").agg(F.min(first).alias("first")).select("pid", "first", "first.node", "first.doc_id", "first.th"))
    again = checkpointed(rows.select("rid").join(reps.select(F.col("node").alias("rid")), "rid", "left_anti"))
    sets = marks.join(shipped(again), "rid", "left_anti").withColumnRenamed("rid", "node")
    proposed = candidates(docs, reps) if candidates is not None else None
    return Groups(rows, reps, _roots(sets, reps, docs, components, words_per_shingle, block, proposed))


def _roots(sets: DataFrame, reps: DataFrame, docs: DataFrame, components, words_per_shingle: int, block: int, proposed: DataFrame | None = None) -> DataFrame:
    keyed = sets.select("node", F.explode("shingles").alias("key"))
    held = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("held")).where("held > 1")
    members = checkpointed(keyed.join(held, "key"))
    maps = sets.select("node", "n", "bits")
    star = members.where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    known = None
    if proposed is not None:
        known = _linked(_close(proposed, maps), reps, docs, words_per_shingle)
        star = star.join(known, ["u", "v"], "left_anti")
    near = _linked(_close(star, maps), reps, docs, words_per_shingle)
    near = near if known is None else near.union(known)
    roots = checkpointed(components(near))
    # groups of three and more that hold several components
    large = members.where("held > 2").join(roots, "node", "left").select("key", "node", "held", F.coalesce("root", "node").alias("root"))
    ends = large.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    left = checkpointed(large.join(ends, "key"))
    across = checkpointed(_across(left, sets.select("node", "n", *SIGNS), block))
    late = _linked(_close(across, maps), reps, docs, words_per_shingle)
    # the components found are stars already
    return roots if late.isEmpty() else checkpointed(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(late)))


def _across(left: DataFrame, signs: DataFrame, block: int) -> DataFrame:
    """(u, v): pairs of different roots of left (key, node, held, root) that share a key and whose short fingerprints allow a link."""
    keys = left.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("key")), 1, LISTED).alias("keys"))  # of one prefix
    rows = left.join(keys, "node").join(signs, "node")
    blocks = F.ceil(F.col("held") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("cell", F.struct(F.least("mine", "other"), F.greatest("mine", "other"))).drop("other", "held")
    u = rows.select("key", "cell", F.col("node").alias("u"), "mine", "root", "n", "keys", *SIGNS)
    v = rows.select("key", "cell", F.col("node").alias("v"), F.col("mine").alias("theirs"), F.col("root").alias("v_root"), F.col("n").alias("m"), F.col("keys").alias("v_keys"), *[F.col(s).alias(f"v_{s}") for s in SIGNS])
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(s).bitwiseXOR(F.col(f"v_{s}"))) for s in SIGNS])
    one = (F.col("mine") < F.col("theirs")) | ((F.col("mine") == F.col("theirs")) & (F.col("u") < F.col("v")) & (F.col("u_cell.col1") == F.col("u_cell.col2")))
    u = u.withColumnRenamed("cell", "u_cell").withColumnRenamed("key", "u_key")
    # a pair leaves in the first group that both list; in each that they share if they list no common one
    first_shared = F.coalesce(F.array_min(F.array_intersect("keys", "v_keys")) == F.col("u_key"), F.lit(True))
    meets = (F.col("u_key") == v["key"]) & (F.col("u_cell") == v["cell"]) & one & (F.col("root") != F.col("v_root")) & _limit(apart) & first_shared
    return u.join(v, meets).select("u", "v").distinct()


def _close(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sizes and whole fingerprints (maps: node, n, bits) allow a link."""
    both = pairs.join(maps.toDF("u", "n", "a"), "u").join(maps.toDF("v", "m", "b"), "v")
    return checkpointed(both.where(_limit(_bits_apart())).select("u", "v"))


def _linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """The pairs (u, v) whose whole sets overlap far enough."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = checkpointed(reps.join(nodes, "node").select("node", "doc_id", "th"))
    texts = docs.select("doc_id", text_hash().alias("th"), "text")
    w = shipped(wanted)
    found = texts.join(w, same_row(texts, w)).select("node", "text")
    sets = _mapped(found, words_per_shingle, "shingles array<long>", lambda s: {"shingles": s.view(np.int64)}).dropDuplicates(["node"])
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    return checkpointed(both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v"))
