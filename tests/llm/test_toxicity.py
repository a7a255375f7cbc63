"""Toxicity: the index against all cosines, counts against plain ones, held-out accuracy, and odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lanewise.llm.common import WordHasher
from lanewise.llm.toxicity import BEGINNINGS, BlockMaxIndex, document_counts, examples_of, fit, isotonic, listed, terms, toxicity, toxicity_of_documents, vocabulary_of

DOCS, LABELS = "doc_id long, text string, score double, label string", "doc_id long, toxic int, quality int, text string"
BAD = ("vile", "scumbag", "lowlife", "rotter")


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(["", "", "ly"]))
        docs.append((i, " ".join(text).capitalize() + ".", None, "x"))
        labels.append((i, int(toxic), 1, None))
    return docs, labels


@pytest.mark.parametrize("seed", range(4))
def test_nearest_are_those_of_all_cosines(seed):
    rng = np.random.default_rng(seed)
    n, n_terms, k = 700, 40, 9
    dense = np.where(rng.random((n, n_terms)) < 0.08, rng.integers(1, 4, (n, n_terms)), 0).astype(float)
    dense[::7] = dense[0]  # ties
    dense[5] = 0
    length = np.sqrt((dense**2).sum(1, keepdims=True))
    unit = np.divide(dense, length, out=np.zeros_like(dense), where=length > 0)
    example, term = np.nonzero(unit)
    index = BlockMaxIndex.build(n, n_terms, term, example, unit[example, term])
    for q in range(0, n, 13):
        at = np.flatnonzero(unit[q])
        if not len(at):
            continue
        for without in (-1, q):
            found, cosine = index.nearest(at, unit[q, at], k, without)
            every = np.round(unit @ unit[q], 12)
            want = sorted((i for i in range(n) if every[i] > 0 and i != without), key=lambda i: (-every[i], i))[:k]
            assert found.tolist() == want and np.allclose(cosine, every[want])


def test_terms_are_words_and_their_beginnings():
    texts = ["Ab cdefgh, éa x1y", "", "cdefgh"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]])
    row, h = terms(data, offsets, WordHasher())
    per_word = 1 + len(BEGINNINGS)
    assert np.bincount(row, minlength=3).tolist() == [5 * per_word, 0, per_word]
    assert set(h[row == 2]) <= set(h[row == 0]) and len(set(h[row == 2])) == per_word


def test_document_counts_and_vocabulary(spark):
    docs, labels = corpus(900)
    d = spark.createDataFrame(docs, DOCS).repartition(5)
    examples, counts = examples_of(d, spark.createDataFrame(labels, LABELS), 100_000)
    assert counts.tolist() == [sum(x[1] == k and zlib.crc32(str(x[0]).encode()) % 3 != 1 for x in labels) for k in (0, 1)]
    vocabulary = vocabulary_of(examples)
    held, n = document_counts(d, vocabulary)
    plain = np.zeros(len(vocabulary), int)
    for _, ends, place, _ in listed(vocabulary, pa.array([x[1] for x in docs]), WordHasher()):
        plain += np.bincount(place, minlength=len(vocabulary))
    assert n == 900 and held.tolist() == plain.tolist() and len(vocabulary) >= len(BAD)


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(1500)
    hidden = [(i, None if zlib.crc32(str(i).encode()) % 3 == 1 else t, q, x) for i, t, q, x in labels]
    got = toxicity_of_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(hidden, LABELS)).collect()
    truth = {i: t for i, t, *_ in labels}
    assert len(got) == 1500 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.97
    assert {(r.doc_id, r.score) for r in got} == {(r.doc_id, r.score) for r in toxicity_of_documents(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(labels, LABELS)).collect()}


def test_evidence_and_odd_rows(spark):
    docs, labels = corpus(600)
    odd = [(5000, None, 0.1, ""), (5001, "", None, None), (None, "vile scumbag", None, ""), (None, None, None, ""), (5002, "neutral words " * 60_000 + "vile", None, ""), (7, "vile scumbag", None, ""), (7, "vile scumbag", None, "")]
    told = [*labels, (6, 0, 1, ""), (6, 1, 1, ""), (None, 1, 1, ""), (99_999, 1, 1, ""), (8, None, 1, ""), (9, 3, 1, "")]
    d = spark.createDataFrame(docs + odd, DOCS)
    got = toxicity(d, fit(d, spark.createDataFrame(told, LABELS))).collect()
    assert len(got) == 607
    same = {r.score for r in got if (r.doc_id is None or r.doc_id == 7) and r.evidence}
    assert len([r for r in got if r.doc_id == 7]) == 3 and len(same) == 1 and same.pop() > 0.7
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 7}
    assert by_id[5000].score == by_id[5001].score < 0.3 and by_id[5000].evidence == []
    assert all(e.cosine > 0 and e.label in (0, 1) for r in got for e in r.evidence)


def test_without_labels_or_documents(spark):
    docs, labels = corpus(30)
    none = spark.createDataFrame([], LABELS)
    assert {(r.score, r.predicted) for r in toxicity_of_documents(spark.createDataFrame(docs, DOCS), none).collect()} == {(0.0, 0)}
    assert toxicity_of_documents(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).collect() == []
    clean = [(i, 0, 1, "") for i, *_ in labels]
    assert {r.predicted for r in toxicity_of_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(clean, LABELS)).collect()} == {0}


def test_curve_rises():
    x, y = isotonic(np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0.0, 1, 0, 0, 1]), np.ones(5))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all() and y[0] == 0 and y[-1] == 1
