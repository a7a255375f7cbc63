"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Examples are labelled texts, at most EXAMPLES of each label on average, one of each family of near copies (texts
that share their least five-word shingle hash). Terms are words and their beginnings, lower-cased; the
vocabulary is the terms that significantly more examples of label 1 hold than of label 0. A term's inverse document
frequency is counted over all documents. An index lists for each term its examples in order, cut into blocks of
BLOCK examples; each block's greatest weight bounds what the term can add there. A text looks up its terms: blocks
are visited by falling bound, until no bound reaches the k-th cosine found, so the neighbours are exact.

Neighbours vote with their closeness, weighted so that both labels count as they do among all labelled rows, and with
a little of the rate of texts without terms. Votes become scores by an isotonic curve, fitted on
the examples' own votes without themselves. The neighbours are the score's evidence.

Defined results: a null or empty text has no terms; texts without terms, however long they are, get the smoothed
rate of label 1 among examples without terms, and no evidence. Of repeated labels of an id the greatest counts;
labels other than 0 and 1, null ids and ids without a document teach nothing. Without labels every score is 0.
Ties between neighbours go to the smaller example number, which follows from the examples' hashes. Equal texts get equal
scores. Rows without an id are scored and are not held out. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import WordHasher, mixed, spread, table, text_chunks, written

#: Labelled rows of each label that the fit reads, on average: a documented bound, drawn by a hash of the row's id.
EXAMPLES = 4000
#: Bytes of the word beginnings that are terms beside whole words; words of a family's shingles.
BEGINNINGS, SHINGLE = (4, 5, 6), 5
#: A term takes part if its presence among label 1 exceeds that among label 0 by this many standard errors.
LEAST_Z = 6.0
NEIGHBOURS, BLOCK = 15, 64
#: Blocks whose postings are summed at once.
AT_ONCE = 16
#: The weight of the base rate in a vote, and what keeps the weight of an equal vector finite.
BASE, NEAR = 0.5, 0.05
TOXIC = 0.7


def terms(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each term, repeats included: words of letters, and their beginnings."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    letter = ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    whole, _, _, row, *begins = hasher(np.where(letter, lower, 32).astype(np.uint8), offsets, BEGINNINGS)
    return np.tile(row, 1 + len(begins)), np.concatenate([whole, *[h + np.uint64(k) for k, h in zip(BEGINNINGS, begins, strict=True)]])


def family(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> np.ndarray:
    """For each text the least hash of its five-word shingles (of all its words, if there are fewer)."""
    words, _, _, row = hasher(data, offsets)
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not len(words):
        return out
    rolled = words.copy()
    for k in range(1, SHINGLE):
        same = row[k:] == row[:-k]
        rolled[: len(words) - k] = np.where(same, rolled[: len(words) - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:], rolled[: len(words) - k])
    sizes = np.bincount(row, minlength=n)
    first = np.cumsum(sizes) - sizes
    inside = np.arange(len(words)) - first[row] <= np.maximum(sizes[row] - SHINGLE, 0)
    np.minimum.at(out := np.full(n, np.iinfo(np.uint64).max, np.uint64), row[inside], mixed(rolled[inside]))
    return np.where(sizes > 0, out, 0)


@dataclass
class BlockMaxIndex:
    """Postings of unit vectors: for each term its examples in order and their weights, and each block's greatest weight."""

    n: int
    starts: np.ndarray  # terms x (blocks + 1): where a block's postings begin
    example: np.ndarray
    weight: np.ndarray
    most: np.ndarray  # terms x blocks

    @classmethod
    def build(cls, n: int, n_terms: int, term: np.ndarray, example: np.ndarray, weight: np.ndarray) -> BlockMaxIndex:
        order = np.lexsort((example, term))
        term, example, weight = term[order], example[order], weight[order]
        blocks = max(1, -(-n // BLOCK))
        cell = term * blocks + example // BLOCK
        begins = np.searchsorted(cell, np.arange(n_terms * blocks + 1))
        most = np.zeros(n_terms * blocks)
        np.maximum.at(most, cell, weight)
        starts = np.concatenate([begins[:-1].reshape(n_terms, blocks), begins[blocks::blocks].reshape(n_terms, 1)], 1) if n_terms else np.zeros((0, blocks + 1), np.int64)
        return cls(n, starts, example, weight, most.reshape(n_terms, blocks))

    def nearest(self, terms_: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k greatest cosines above 0, ties to the smaller example."""
        bound = weights @ self.most[terms_]
        found, cosine = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-bound, kind="stable")
        for i in range(0, len(order), AT_ONCE):
            # sums of floats may differ in their last bits, so blocks within such a difference are visited too
            least = cosine[-1] - 1e-9 if len(found) == k else 0.0
            blocks = order[i : i + AT_ONCE]
            blocks = blocks[(bound[blocks] > 0) & (bound[blocks] >= least)]
            if not len(blocks):
                break
            begin = self.starts[terms_[:, None], blocks]
            size = (self.starts[terms_[:, None], blocks + 1] - begin).ravel()
            at = spread(begin.ravel(), size)
            place = self.example[at] + np.repeat(np.tile((np.arange(len(blocks)) - blocks) * BLOCK, len(terms_)), size)
            own = np.round(np.bincount(place, weights=np.repeat(np.repeat(weights, len(blocks)), size) * self.weight[at], minlength=len(blocks) * BLOCK), 12)
            hit = np.flatnonzero(own)
            number = blocks[hit // BLOCK] * BLOCK + hit % BLOCK
            found, cosine = np.append(found, number[number != without]), np.append(cosine, own[hit[number != without]])
            best = np.lexsort((found, -cosine))[:k]
            found, cosine = found[best], cosine[best]
        return found, cosine


@dataclass
class Judge:
    """What a score needs: vocabulary (sorted hashes) with idf, index, labels and ids of the examples, weights of labels, curve."""

    vocabulary: np.ndarray
    idf: np.ndarray
    index: BlockMaxIndex
    label: np.ndarray
    doc_id: list
    label_weight: np.ndarray
    base: float
    votes: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    scores: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def vector(self, place: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = (1 + np.log(times)) * self.idf[place]
        return w / np.sqrt((w * w).sum())

    def vote(self, place: np.ndarray, times: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        found, cosine = self.index.nearest(place, self.vector(place, times), without=without)
        w = cosine**2 / (1 + NEAR - np.minimum(cosine, 1)) * self.label_weight[self.label[found]]
        return float((w[self.label[found] == 1].sum() + BASE * self.base) / (w.sum() + BASE)), found, cosine

    def score(self, vote: float) -> float:
        return float(np.interp(vote, self.votes, self.scores))


def listed(vocabulary: np.ndarray, column: pa.Array, hasher: WordHasher) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, ends, place, times) for slices of a column: the vocabulary's terms of each text and how often it has them."""
    marked = np.zeros(1 << 16, bool)  # most terms of a text are ruled out by their low bits
    marked[vocabulary & np.uint64(0xFFFF)] = True
    for _, data, offsets in text_chunks(column):
        row, h = terms(data, offsets, hasher)
        maybe = marked[h & np.uint64(0xFFFF)]
        row, h = row[maybe], h[maybe]
        at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
        hit = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
        key, times = np.unique(row[hit] << 32 | at[hit], return_counts=True)
        n = len(offsets) - 1
        yield n, np.searchsorted(key >> 32, np.arange(n), side="right"), key & 0xFFFFFFFF, times


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def examples_of(docs: DataFrame, labels: DataFrame, bound: int = EXAMPLES) -> tuple[DataFrame, np.ndarray]:
    """Examples (example, doc_id, label, text), numbered from 0, and how many labelled rows each label has."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).where(~held_out())
    counts = np.zeros(2)
    for r in told.groupBy("label").count().collect():  # two rows
        counts[r[0]] = r[1]
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_003)) / 1_000_003.0
    rate = F.when(F.col("label") == 1, min(1.0, bound / max(counts[1], 1))).otherwise(min(1.0, bound / max(counts[0], 1)))
    few = told.where(draw < rate)  # about 2 * bound ids
    drawn = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            own = [family(data, offsets, hasher) for _, data, offsets in text_chunks(batch.column(1))]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))], names=[*batch.schema.names, "family"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = drawn.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {kind}, text string, label int, family long")
    text = F.coalesce("text", F.lit(""))
    once = each.groupBy("family", "label").agg(F.min_by(F.struct("doc_id", text.alias("text")), F.struct(F.xxhash64(text), text, "doc_id")).alias("x"))
    number = F.row_number().over(Window.orderBy(F.xxhash64("x.text"), "x.text", "label")) - 1  # the bounded examples only
    return written(once.select(number.cast("long").alias("example"), "x.doc_id", "label", "x.text"), "examples"), counts


def vocabulary_of(examples: DataFrame, least_z: float = LEAST_Z) -> np.ndarray:
    """Hashes, in order, of the terms that significantly more examples of label 1 hold than of label 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            label = batch.column(1).to_numpy().astype(np.int64)
            for first, data, offsets in text_chunks(batch.column(0)):
                row, h = terms(data, offsets, hasher)
                known, place = np.unique(h, return_inverse=True)
                own = np.unique(row * len(known) + place)  # each text's different terms
                held, place = label[first + own // max(len(known), 1)], own % max(len(known), 1)
                for k in (0, 1):
                    n = np.bincount(place[held == k], minlength=len(known))
                    yield pa.record_batch([pa.array(known[n > 0].view(np.int64)), pa.array(np.full(int((n > 0).sum()), k, np.int32)), pa.array(n[n > 0])], names=["term", "label", "n"])

    size = np.zeros(2)
    for r in examples.groupBy("label").count().collect():  # two rows
        size[r[0]] = r[1]
    if size.min() == 0:
        return np.zeros(0, np.uint64)
    held = examples.select("text", "label").mapInArrow(run, "term long, label int, n long").groupBy("term")
    held = held.agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    p = (F.col("a") + F.col("b")) / float(size.sum())
    error = F.sqrt(p * (1 - p) * float(1 / size[1] + 1 / size[0]))
    telling = held.where((F.col("a") / float(size[1]) - F.col("b") / float(size[0])) > least_z * error).select("term")
    return np.sort(telling.toArrow().column(0).to_numpy().view(np.uint64))  # each is in many of the bounded examples


def document_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents hold each term, and how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = WordHasher(), np.zeros(len(shared.value) + 1, np.int64), 0
        for batch in batches:
            for count, _, place, _ in listed(shared.value, batch.column(0), hasher):
                held[:-1] += np.bincount(place, minlength=len(shared.value))
                n += count
        held[-1] = n
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at), pa.array(held[at])], names=["term", "n"])

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term of the vocabulary
        out[r[0]] = r[1]
    return out[:-1], int(out[-1])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve of least weighted squared error, by pooling adjacent violators."""
    levels: list[list[float]] = []
    for v in np.unique(x):
        own = x == v
        levels.append([v, v, float((w[own] * y[own]).sum()), float(w[own].sum())])
        while len(levels) > 1 and levels[-2][2] * levels[-1][3] >= levels[-1][2] * levels[-2][3]:
            _, high, a, b = levels.pop()
            levels[-1][1:] = [high, levels[-1][2] + a, levels[-1][3] + b]
    return np.array([e for low, high, *_ in levels for e in (low, high)]), np.array([a / b for *_, a, b in levels for _ in (0, 1)])


def fit(docs: DataFrame, labels: DataFrame, bound: int = EXAMPLES) -> Judge | None:
    """The judge of texts, or none without any example."""
    examples, counts = examples_of(docs, labels, bound)
    vocabulary = vocabulary_of(examples)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, place, times = batch.slice(begin, 256), [], []
                for n, ends, at, count in listed(shared.value, part.column(3), hasher):
                    cuts = [0, *ends.tolist()]
                    place += [at[cuts[i] : cuts[i + 1]] for i in range(n)]
                    times += [count[cuts[i] : cuts[i + 1]] for i in range(n)]
                yield pa.record_batch([*part.columns[:3], pa.array(place, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], names=[*part.schema.names[:3], "place", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    vectors = written(examples.mapInArrow(run, f"example long, doc_id {kind}, label int, place array<long>, times array<long>"), "vectors")
    got = vectors.orderBy("example").toArrow()  # bounded rows, of the vocabulary's terms only
    if not got.num_rows:
        return None
    held, n_docs = document_counts(docs, vocabulary) if len(vocabulary) else (np.zeros(0), 0)
    idf = np.log1p(n_docs / np.maximum(held, 1))
    label = got.column("label").to_numpy().astype(np.int64)
    lists = got.column("place").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    place, times = lists.flatten().to_numpy(), got.column("times").combine_chunks().flatten().to_numpy()
    example = np.repeat(np.arange(len(label)), sizes)
    w = (1 + np.log(times)) * idf[place]
    length = np.sqrt(np.bincount(example, weights=w * w, minlength=len(label)))
    # both labels count as among all labelled rows
    shown = np.bincount(label, minlength=2)
    label_weight = counts / np.maximum(shown, 1)
    label_weight /= max(label_weight.max(), 1e-12)
    bare = sizes == 0
    base = float((label_weight[label[bare]] * label[bare]).sum() / (label_weight[label[bare]].sum() + 1)) if bare.any() else 0.0
    judge = Judge(vocabulary, idf, BlockMaxIndex.build(len(label), len(vocabulary), place, example, w / length[example]), label, got.column("doc_id").to_pylist(), label_weight, base)
    return calibrated(judge, vectors)


def calibrated(judge: Judge, vectors: DataFrame) -> Judge:
    """judge with the curve from its examples' votes, each without itself."""
    shared = vectors.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            votes = [shared.value.vote(np.array(r["place"]), np.array(r["times"]), r["example"])[0] for r in rows]
            yield pa.record_batch([pa.array([r["label"] for r in rows], pa.int32()), pa.array(votes, pa.float64())], names=["label", "vote"])

    dealt = vectors.where(F.size("place") > 0).repartition(vectors.sparkSession.sparkContext.defaultParallelism)
    got = dealt.mapInArrow(run, "label int, vote double").toArrow()  # bounded rows
    label, votes = got.column(0).to_numpy().astype(np.int64), np.round(got.column(1).to_numpy(), 6)
    if len(np.unique(label)) == 2:
        judge.votes, judge.scores = isotonic(votes, label.astype(float), judge.label_weight[label])
    return judge


def toxicity(docs: DataFrame, judge: Judge | None) -> DataFrame:
    """doc_id, score and evidence (the nearest examples: doc_id, label, cosine) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if judge is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.array().cast(f"array<struct<doc_id:{kind},label:int,cosine:double>>").alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j, hasher = shared.value, WordHasher()
        for batch in batches:
            score, evidence = [], []
            for n, ends, place, times in listed(j.vocabulary, batch.column(1), hasher):
                begin = 0
                for end in ends.tolist():
                    if begin == end:
                        score.append(j.base)
                        evidence.append([])
                    else:
                        vote, found, cosine = j.vote(place[begin:end], times[begin:end])
                        score.append(j.score(round(vote, 6)))
                        evidence.append([{"doc_id": j.doc_id[i], "label": int(j.label[i]), "cosine": float(c)} for i, c in zip(found, cosine, strict=True)])
                    begin = end
            ids = batch.column(0)
            yield pa.record_batch([ids, pa.array(score, pa.float64()), pa.array(evidence, pa.list_(pa.struct([("doc_id", ids.type), ("label", pa.int32()), ("cosine", pa.float64())])))], names=["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id:{kind},label:int,cosine:double>>")


def toxicity_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    judged = toxicity(docs, fit(docs, labels))
    return judged.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
