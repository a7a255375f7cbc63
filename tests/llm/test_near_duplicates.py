"""The pipeline's near-duplicate stage goes through the fingerprints of op9, an exact test follows."""

import random

import corpus_pipeline
from lanewise.llm import shingles, simhash


def test_fingerprints_propose_and_overlaps_decide(spark, sf, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for i in range(20):
        body = [word() for _ in range(400)]
        rows.append((3 * i, " ".join(body)))
        body[-1] = word()
        rows.append((3 * i + 1, " ".join(body)))
    # of one majority fingerprint, but unlike
    rows += [(1000 + i, "the same short line of words " * 60 + " ".join(word() for _ in range(40))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, propose, linked = [], simhash.proposed_pairs, shingles._linked
    monkeypatch.setattr(simhash, "proposed_pairs", lambda d, reps: (pairs := propose(d, reps), seen.append((pairs, reps)))[0])
    tested = []
    monkeypatch.setattr(shingles, "_linked", lambda pairs, *more: (tested.append(pairs.count()), linked(pairs, *more))[1])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert kept == {3 * i for i in range(20)} | {1000 + i for i in range(10)}
    ids = {r.node: r.doc_id for r in seen[0][1].collect()}
    proposed = {tuple(sorted((ids[r.u], ids[r.v]))) for r in seen[0][0].collect()}
    near = sum((3 * i, 3 * i + 1) in proposed for i in range(20))
    assert near >= 15 and tested[0] >= near and tested[1] <= 20 - near


def test_a_round_of_components_is_three_shuffles(spark, monkeypatch):
    plans, kept = [], simhash.checkpointed
    monkeypatch.setattr(simhash, "checkpointed", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert len(plans) > 2 and all(p.count("Exchange ") == 3 and "Join" not in p for p in plans[1:])


def test_proposals_need_no_components(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the same line" + " " * i + " of words") for i in range(6)] + [(9, "another text")], "doc_id long, text string")
    rows = docs.withColumn("th", shingles.text_hash()).withColumn("node", docs["doc_id"]).select("node", "doc_id", "th")
    monkeypatch.setattr(simhash, "components", None)
    pairs = [(r.u, r.v) for r in simhash.proposed_pairs(docs, rows).collect()]
    assert sorted(pairs) == [(0, i) for i in range(1, 6)]
