"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text has one score s = w . x with weights shared by all grades, over hashed features: words
and their beginnings, word shapes and immediate repeats. Features whose presence doesn't differ
significantly between lower and higher grades are left out of the fit. Ordered thresholds
t1 < t2 < ... turn it into P(grade >= j) = sigmoid(s - tj), so one model gives the expected grade
and any tail probability. Weights and thresholds are fitted together by gradient descent on the
likelihood of the grades; thresholds stay ordered as they are sums of positive steps.

Defined results: null and empty texts have no features, so their score is 0. Rows without a rating
teach nothing. Without any rating the tail probability is 1 (nothing is rejected). Repeated rows
are judged each on their own. Columns other than the named ones are passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHasher, coded, decoded, mixed, text_chunks

#: Buckets of the hashed features.
DIMENSIONS = 1 << 18
#: Rated rows that the fit reads, on average: a documented bound, drawn by a hash of the row's id.
TRAIN_ROWS = 4000
#: A document stays if P(grade >= KEEP_GRADE) is at least KEEP_TAIL.
KEEP_GRADE, KEEP_TAIL = 2, 0.4
STEPS, RATE, DECAY = 150, 0.08, 1e-5
#: Bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5)
#: A feature takes part if its presence differs between lower and higher grades by this many standard errors.
LEAST_Z = 6.5


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..., a column each."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def features(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of each text's features: presence of words and word beginnings, shares of shapes."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    words, starts, ends, row = hasher(lower, offsets)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    # a word without its punctuation: letters, and bytes of other scripts, decide
    alpha = ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    core, _, _, core_row, *begins = hasher(np.where(alpha, lower, 32).astype(np.uint8), offsets, PREFIXES)
    letters = np.concatenate([[0], np.cumsum(alpha)])
    capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    size = ends - starts
    n_letters, n_capitals, n_digits = (x[ends] - x[starts] for x in (letters, capitals, digits))
    shape = (np.minimum(n_capitals, 2) * 3 + np.minimum(n_digits, 2)) * 4 + np.minimum(size - n_letters - n_digits, 3)
    shape = shape * 4 + np.minimum(n_letters // 4, 3)
    shape_hash = mixed(shape.astype(np.uint64) + np.uint64(0xABCDEF))
    pair = (row[1:] == row[:-1]) if len(words) > 1 else np.zeros(0, bool)
    same = (words[1:] == words[:-1]) & pair if len(words) > 1 else np.zeros(0, bool)
    n_rows = len(offsets) - 1
    per_row = np.bincount(row, minlength=n_rows).astype(np.float64)

    def present(r: np.ndarray, h: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.unique(r.astype(np.uint64) << np.uint64(32) | ((h + np.uint64(salt)) % np.uint64(DIMENSIONS)))
        return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), np.ones(len(key), np.float32)

    def share(r: np.ndarray, h: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, count = np.unique(r.astype(np.uint64) << np.uint64(32) | (h % np.uint64(DIMENSIONS)), return_counts=True)
        where = (key >> np.uint64(32)).astype(np.int64)
        return where, (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (value * np.sqrt(count / per_row[where])).astype(np.float32)

    parts = [present(core_row, core, 0), *[present(core_row, h, k) for k, h in zip(PREFIXES, begins, strict=True)], share(row, shape_hash, 3.0)]
    if pair.any():
        parts.append(share(row[1:][same], np.full(int(same.sum()), 0x5EED, np.uint64), 3.0))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def fit(rated: DataFrame, text: str = "text", grade: str = "grade", row_id: str = "doc_id", bound: int = TRAIN_ROWS) -> OrdinalModel:
    """Weights and thresholds from rated rows, at most about `bound` of them."""
    rated = rated.where(F.col(grade).isNotNull() & F.col(text).isNotNull())
    n = rated.count()
    draw = (F.xxhash64(F.col(row_id), F.lit("quality")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    sample = rated.where(draw < min(1.0, bound / max(n, 1))).select(text, F.col(grade).cast("int").alias("grade"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            grades = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in text_chunks(batch.column(0)):
                r, b, v = features(data, offsets, hasher)
                order = np.argsort(r, kind="stable")
                r, b, v = r[order], b[order].astype(np.int32), v[order].astype(np.float32)
                cuts = np.searchsorted(r, np.arange(len(offsets)))
                yield pa.record_batch(
                    [pa.array(grades[first : first + len(offsets) - 1].astype(np.int32)), pa.array([b[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), pa.array([v[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                    names=["grade", "bucket", "value"],
                )

    got = sample.mapInArrow(extract, "grade int, bucket binary, value binary").toArrow()
    grades = got.column("grade").to_numpy().astype(np.int64)
    if len(grades) == 0 or len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(DIMENSIONS, np.float32), np.full(max(1, int(grades.max(initial=KEEP_GRADE))), -30.0))
    buckets = [np.frombuffer(x.as_py(), np.int32) for x in got.column("bucket")]
    ends = np.cumsum([len(x) for x in buckets])
    bucket = np.concatenate(buckets)
    del buckets
    value = np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in got.column("value")])
    del got
    return descend(ends, bucket, value, grades)


def telling(ends: np.ndarray, bucket: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """For each bucket, whether its presence differs between the grades below and above some threshold."""
    counts = np.stack([np.bincount(bucket, weights=np.repeat(grades == g, np.diff(ends, prepend=0)), minlength=DIMENSIONS) for g in range(int(grades.max()) + 1)])
    rows = np.bincount(grades, minlength=len(counts)).astype(float)
    out = np.zeros(DIMENSIONS, bool)
    for j in range(1, len(counts)):
        low, high, n_low, n_high = counts[:j].sum(0), counts[j:].sum(0), max(rows[:j].sum(), 1), max(rows[j:].sum(), 1)
        p = (low + high) / (n_low + n_high)
        error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n_low + 1 / n_high))
        out |= np.abs(low / n_low - high / n_high) > LEAST_Z * error
    return out


def descend(ends: np.ndarray, bucket: np.ndarray, value: np.ndarray, grades: np.ndarray, steps: int = STEPS, strip: int = 1 << 19) -> OrdinalModel:
    """Full-batch Adam on the ordinal log-likelihood; rows without features count too.

    Row i's features end at ends[i]. Scores and gradients are summed in strips of about `strip`
    features, so little is held beside the features themselves.
    """
    n, levels = len(grades), int(grades.max())
    used = telling(ends, bucket, grades)[bucket]
    ends = np.concatenate([[0], np.cumsum(used)])[ends]
    bucket, value = bucket[used], value[used]
    starts = np.concatenate([[0], ends[:-1]])
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, starts[cuts[-1]] + strip, side="right"))))
    w = np.zeros(DIMENSIONS)
    share = np.array([(grades >= j).mean() for j in range(1, levels + 1)]).clip(1e-3, 1 - 1e-3)
    first = np.log(1 / share - 1)
    free = np.concatenate([[first[0]], np.log(np.maximum(np.diff(first), 0.05))])  # the first threshold, then positive steps
    momentum, second = np.zeros(DIMENSIONS + levels), np.zeros(DIMENSIONS + levels)
    score = np.zeros(n)
    for step in range(1, steps + 1):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = slice(starts[a], ends[b - 1])
            rows = np.repeat(np.arange(b - a), ends[a:b] - starts[a:b])
            score[a:b] = np.bincount(rows, weights=w[bucket[part]] * value[part], minlength=b - a)
        t = np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])
        bounds = np.concatenate([[-np.inf], t, [np.inf]])
        below = np.where(grades + 1 <= levels, _sigmoid(bounds[np.minimum(grades + 1, levels + 1)] - score), 1.0)
        lower = np.where(grades >= 1, _sigmoid(bounds[grades] - score), 0.0)
        p = np.maximum(below - lower, 1e-9)
        slope_up, slope_low = below * (1 - below), lower * (1 - lower)
        d_score = (slope_up - slope_low) / p / n  # of minus the log-likelihood
        g_w = DECAY * w
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = slice(starts[a], ends[b - 1])
            g_w += np.bincount(bucket[part], weights=np.repeat(d_score[a:b], ends[a:b] - starts[a:b]) * value[part], minlength=DIMENSIONS)
        g_t = np.array([(-(slope_up / p)[grades + 1 == j].sum() + (slope_low / p)[grades == j].sum()) / n for j in range(1, levels + 1)])
        tail = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([g_w, [tail[0]], tail[1:] * np.exp(free[1:])])
        momentum = 0.9 * momentum + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        move = RATE * (momentum / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w -= move[:DIMENSIONS]
        free -= move[DIMENSIONS:]
    return OrdinalModel(w.astype(np.float32), np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))]))


def judge(docs: DataFrame, model: OrdinalModel, keep: list[str], text: str = "text", grade: int = KEEP_GRADE) -> DataFrame:
    """keep's columns with expected_grade and tail_probability = P(grade >= `grade`)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = shared.value, WordHasher()
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for first, data, offsets in text_chunks(batch.column("_text")):
                r, b, v = features(data, offsets, hasher)
                score[first : first + len(offsets) - 1] = np.bincount(r, weights=m.weights[b] * v, minlength=len(offsets) - 1)
            tails = m.tails(score)
            at = np.minimum(grade, tails.shape[1]) - 1
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*rest, pa.array(tails.sum(1)), pa.array(tails[:, at])], names=[*batch.schema.names[:-1], "expected_grade", "tail_probability"])

    source = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, expected_grade double, tail_probability double")


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, grade of the labelled documents: 0 low quality, 1 fair but toxic, 2 good.

    One label a document: of repeated ones the lowest grade counts.
    """
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    marks = labels.where(F.col("doc_id").isNotNull()).select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    return marks.where(F.col("grade").isNotNull())


def fit_documents(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> OrdinalModel:
    """The model for documents, from the labels of a bounded sample of them.

    The sample is drawn on the labels, so few texts meet the join; at TRAIN_ROWS ids the drawn side
    is small enough to be sent to every task.
    """
    marks = graded(docs, labels)
    n = marks.count()
    draw = (F.xxhash64(F.col("doc_id"), F.lit("quality")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    few = marks.where(draw < min(1.0, bound / max(n, 1)))
    return fit(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), bound=bound)


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_probability, selected of each document."""
    out = judge(docs, fit_documents(docs, labels), ["doc_id"])
    return out.withColumn("selected", F.col("tail_probability") >= KEEP_TAIL)


def keep_good(docs: DataFrame, labels: DataFrame, tail: float = KEEP_TAIL) -> DataFrame:
    """The documents, all columns kept, whose tail probability is at least `tail`."""
    rows, names = coded(docs), docs.columns
    judged = judge(rows, fit_documents(docs, labels), rows.columns, f"c{names.index('text')}")
    return decoded(judged.where(F.col("tail_probability") >= tail), names)
