"""Models and plans against brute force on small instances, and what large groups are dealt by."""

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import langid_ppm, mixing, packing, quality, url_templates


def fewest(lengths: list[int], capacity: int) -> int:
    """The least number of sequences, by trying each place for each piece."""
    best = len(lengths)

    def go(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                left = list(rooms)
                left.remove(room)
                go(i + 1, [*left, room - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(120))
def test_fixed_sets_are_part_of_a_best_answer(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 64])
    lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
    sets, left = packing.reduced(dict(Counter(lengths)), capacity)
    assert all(a + (b or 0) <= capacity for a, b, _ in sets)
    rest = sorted(Counter(left).elements(), reverse=True)
    assert Counter(rest) + Counter([x for a, b, n in sets for x in [a, *([b] if b else [])] * n]) == Counter(lengths)
    best = fewest(lengths, capacity)
    assert sum(n for *_, n in sets) + (fewest(rest, capacity) if rest else 0) == best
    fill = Counter()
    for length, a, b, first, _ in packing.plan(dict(Counter(lengths)), capacity):
        for i in range(b - a):
            fill[first + i] += length
    assert max(fill.values()) <= capacity and sum(fill.values()) == sum(lengths) and best <= len(fill) <= best + 1


@pytest.mark.parametrize("least, rows", [(1, 5), (3, 1000), (64, 1)])
def test_ranks_are_gapless_however_lengths_are_dealt(spark, least, rows):
    found = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id") % 3).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    histogram = {r[0]: r[1] for r in found.groupBy("length").count().collect()}
    by = {}
    for r in packing.ranked(found, histogram, least, rows).collect():
        by.setdefault(r.length, []).append(r["rank"])
    assert {k: sorted(v) for k, v in by.items()} == {k: list(range(n)) for k, n in histogram.items()}


def test_buckets_grow_with_the_leaf():
    assert mixing.bucket_digits(0) == mixing.bucket_digits(16**6) == 3
    assert mixing.bucket_digits(16**6 + 1) == 4 and mixing.bucket_digits(10**12) == 5


def test_selection_does_not_depend_on_the_buckets(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(9), rng.choice(["en", "de"]), rng.choice(["src0", "src1"])) for i in range(600)], "doc_id long, text string, lang string, source string")
    taken = []
    for digits in (1, 3, 5):
        monkeypatch.setattr(mixing, "bucket_digits", lambda n, digits=digits: digits)
        taken.append(sorted(map(str, mixing.mixed_documents(docs).collect())))
    assert taken[0] == taken[1] == taken[2] and len(taken[0]) > 100


def plain_fit(rows, grades, steps):
    """Adam on the ordinal log-likelihood, its gradient taken by a step into the complex numbers, which loses no digits: rows are {bucket: value}."""
    n, levels = len(rows), max(grades)
    used = sorted({b for r in rows for b in r})
    at = {b: i for i, b in enumerate(used)}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def loss(p):
        cuts = [p[len(used)]]
        for step in p[len(used) + 1 :]:
            cuts.append(cuts[-1] + np.exp(step))
        total = 0.0
        for row, g in zip(rows, grades, strict=True):
            score = sum(p[at[b]] * v for b, v in row.items())
            upper = sigmoid(cuts[g] - score) if g < levels else 1.0
            total -= np.log(upper - (sigmoid(cuts[g - 1] - score) if g else 0.0)) / n
        return total + quality.DECAY / 2 * (p[: len(used)] ** 2).sum()

    share = [sum(g >= j for g in grades) / n for j in range(1, levels + 1)]
    first = [np.log(1 / s - 1) for s in share]
    p = np.array([0.0] * len(used) + [first[0], *[np.log(max(b - a, 0.05)) for a, b in zip(first, first[1:], strict=False)]])
    m = v = np.zeros(len(p))
    for step in range(1, steps + 1):
        g = np.array([loss(p + e).imag / 1e-20 for e in np.eye(len(p)) * 1e-20j])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - quality.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {b: p[i] for b, i in at.items()}, np.concatenate([[p[len(used)]], p[len(used)] + np.cumsum(np.exp(p[len(used) + 1 :]))])


@pytest.mark.parametrize("levels, strip", list(product((1, 2, 3), (3, 1 << 19))))
def test_the_fit_follows_the_likelihood(monkeypatch, levels, strip):
    monkeypatch.setattr(quality, "LEAST_Z", 0.3)
    rng = random.Random(levels)
    grades = [i % (levels + 1) for i in range(24)]
    rows = [{b: rng.choice([0.5, 1.0, 2.0]) for b in range(6) if rng.random() < (0.2 + 0.6 * (g / levels if b % 2 else 1 - g / levels))} for g in grades]
    ends = np.cumsum([len(r) for r in rows])
    bucket = np.array([b for r in rows for b in r])
    value = np.array([x for r in rows for x in r.values()], np.float32)
    model = quality.descend(ends, bucket, value, np.array(grades), steps=12, strip=strip)
    telling = quality.telling(ends, bucket, np.array(grades))
    assert telling[:6].sum() > 2
    weights, thresholds = plain_fit([{b: x for b, x in r.items() if telling[b]} for r in rows], grades, 12)
    assert model.thresholds == pytest.approx(thresholds, abs=1e-5)
    assert {b: model.weights[b] for b in weights} == pytest.approx(weights, abs=1e-5)
    assert np.count_nonzero(model.weights) == len(weights)


def test_grades_of_documents_follow_the_weights(spark):
    """Expected grade and tail from a model, by whole texts; very long and empty texts too."""
    rng = random.Random(5)
    model = quality.OrdinalModel(np.random.default_rng(5).normal(0, 0.02, quality.DIMENSIONS).astype(np.float32), np.array([-1.0, 0.7]))
    texts = ["", None, "one", "one two one two " * 3, " ".join(rng.choices(["alpha", "Beta", "c3", "dd!"], k=200_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(docs, model, ["doc_id"]).collect():
        data = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)
        _, b, v = quality.features(data, np.array([0, len(data)]), quality.WordHasher())
        score = float((model.weights[b].astype(float) * v).sum())
        tails = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert r.expected_grade == pytest.approx(sum(tails), abs=1e-4) and r.tail_probability == pytest.approx(tails[1], abs=1e-4)


def test_repeated_labels_take_the_lowest_grade(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (2, 1, 0), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert sorted(map(tuple, quality.graded(docs, labels).collect())) == [(1, 0), (2, 1)]


def test_a_language_of_long_texts_gives_fewer_of_them(spark, monkeypatch):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.lit(2000)).alias("text"), F.lit("en").alias("lang"))
    seen = []
    monkeypatch.setattr(langid_ppm, "build_model", lambda grams: seen.append(sum(grams.column("n").to_pylist())))
    langid_ppm.fit(docs)
    langid_ppm.fit(docs, bytes_per_language=200_000)
    langid_ppm.fit(docs.limit(0))
    assert seen[0] == 2_000_000 and 50_000 < seen[1] < 500_000 and seen[2] == 0


def test_a_trap_of_many_levels_takes_one_step(spark):
    rows = [(i, "http://trap/" + "/".join("ab"[j % 2] for j in range(i)) + ("/x" if i % 2 else "")) for i in range(1000)] + [(2000, "http://long/" + "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    calls = []
    step, url_templates.merged = url_templates.merged, lambda nodes: calls.append(1) or step(nodes)
    try:
        got = url_templates.judge(pages, spark.createDataFrame([], "page_id long, bad int"), []).collect()
    finally:
        url_templates.merged = step
    assert len(got) == len(rows) and not calls and all(r.template is not None for r in got)
