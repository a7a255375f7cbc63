"""Matching, pairing, exclusion and views on small tables against the sequential model."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lanewise.functions.patterns import lines, user_regex, wildcard
from lanewise.functions.predicates import Phase
from lanewise.operators.details import to_json_rows
from lanewise.operators import exclude
from lanewise.operators.exclude import _hit_any, _hit_rows, exclude_between
from lanewise.operators.match import endpoints, match_phases, query_stats, skipped
from lanewise.operators.pair import pair_phases
from lanewise.operators.scan import bounds_of, next_value, numbered, running_sum
from lanewise.operators.views import area_bounds, hit_bounds, hits_in_window, page, rows, sort_elapsed, sorted_page
from lanewise.schemas import OPS, STAGES, Tables

from . import model


def tables_of(spark, ops, stages, last=None):
    """ops: (op_id, tid, flushed, label, detail); stages: (op_id, stage, name, start, end)."""
    ids = sorted(o[0] for o in ops)
    row = {i: n for n, i in enumerate(ids)}
    tid = {o[0]: o[1] for o in ops}
    end = max([s[4] or s[3] for s in stages], default=0) if last is None else last
    o = spark.createDataFrame([("t", i, i, t, None if f is None else i, 0, end, bool(f), False, i, label, detail, row[i]) for i, t, f, label, detail in ops], OPS)
    flushed = {o[0]: o[2] for o in ops}
    s = spark.createDataFrame([("t", i, row[i], tid[i], i, None if flushed[i] is None else i, bool(flushed[i]), False, k, "0", name, 0, 1, a, b, "", b is None) for i, k, name, a, b in stages], STAGES)
    return Tables(o, s, traces=spark.createDataFrame([("t", len(ops), 0, end)], "trace string, count long, first_cycle long, last_cycle long"))


def test_scans_match_a_plain_window(spark):
    rng = random.Random(1)
    data = [(k, rng.randrange(-500, 5000), rng.randrange(9)) for k in "ab" for _ in range(400)]
    df = spark.createDataFrame(data, "k string, at long, v long")
    got = {}
    for r in running_sum(df, ["k"], "at", F.col("v"), "total", size=64).collect():
        got.setdefault((r.k, r.at), set()).add(r.total)
    assert all(v == {sum(x for k, a, x in data if k == key and a <= at)} for (key, at), v in got.items())
    assert bounds_of(df, "at", 10_000) == [] and 6 <= len(cuts := bounds_of(df, "at", 100)) <= 8
    for bounds in ([], cuts, [0]):
        for r in next_value(df, ["k"], "at", F.when(F.col("v") > 6, F.col("at")), "later", bounds).collect():
            assert r.later == min((a for k, a, v in data if k == r.k and a > r.at and v > 6), default=None)
    one = numbered(spark.createDataFrame([(a,) for a in set(x[1] for x in data)], "at long").withColumn("k", F.lit(1)), ["k"], ["at"], "n", size=64)
    assert [r.n for r in one.orderBy("at").collect()] == list(range(one.count()))


def test_patterns(spark):
    df = spark.createDataFrame([("Free RQU *=36\r\nsecond\n",)], "x string")
    test = lambda e: df.select(e.alias("y")).first().y
    assert test(lines(F.col("x"))) == ["Free RQU *=36", "second"]
    assert test(F.col("x").rlike(wildcard("rqu ?=3*", whole=False))) and not test(F.col("x").rlike(wildcard("36*second", whole=False)))
    assert not test(F.lit("name\n").rlike(wildcard("name", whole=True))) and test(F.lit("ÀB.").rlike(wildcard("àb.", whole=True)))
    for bad in ("(", "(?=a)", r"(a)\1"):
        with pytest.raises(ValueError):
            user_regex(bad)


@pytest.mark.parametrize("bad", [{"name": ""}, {"name": "x", "at": "middle"}, {"name": "x", "where": (("speed", "=", 1),)}, {"name": "x", "where": (("op", "~", 1),)}, {"name": "x", "where": (("op", "=", -1),)}, {"name": "x", "status": "gone"}, {"name": "x", "label": "l" * 81}])
def test_phase_arguments(bad):
    with pytest.raises(ValueError):
        Phase(**bad)


def random_tables(spark, seed):
    rng = random.Random(seed)
    ops = [(i * 3, rng.randrange(3), rng.random() < 0.2, f"op{i % 4}", "d") for i in range(60)]
    stages = []
    for i, *_ in ops:
        for k in range(rng.randrange(4)):
            start = rng.randrange(100)
            stages.append((i, k, rng.choice("AAB C".replace(" ", "")), start, None if rng.random() < 0.1 else start + rng.randrange(20)))
    return tables_of(spark, ops, stages), ops, stages


def test_pairs_and_exclusion_match_the_model(spark):
    t, ops, stages = random_tables(spark, 4)
    row, tid = {i: n for n, (i, *_) in enumerate(ops)}, {o[0]: o[1] for o in ops}
    point = lambda s, end: (tid[s[0]], row[s[0]], s[1], s[4] if end else s[3])
    sources = [point(s, True) for s in stages if s[2] == "A" and s[4] is not None]
    targets = [point(s, False) for s in stages if s[2] == "B"]
    stops = [(row[s[0]], s[3]) for s in stages if s[2] == "C"]
    key = lambda df: [(r.s_row_idx, r.s_stage, r.t_row_idx, r.elapsed) for r in df.orderBy("hit_idx").collect()]
    plain = lambda ps: [(s[1], s[2], d[1], d[3] - s[3]) for s, d in ps]
    for skip in (0, 2):
        want = model.pairs(sources, targets, skip)
        got = pair_phases(t, Phase("A", at="end"), Phase("B"), skip=skip).cache()
        assert key(got) == plain(want)
        assert key(pair_phases(t, Phase("A", at="end"), Phase("B"), skip=skip, gaps=(("<", 10),), rows=(("<=", 4),))) == [x for x in plain(want) if x[3] < 10 and abs(x[2] - x[0]) <= 4]
        for scope in ("rows", "all") if skip == 0 else ():
            kept = plain([p for p in want if not model.enclosed(p, stops, scope == "rows")])
            for few in (5000, 0):
                assert key(exclude_between(got, t, Phase("C"), scope, few)) == kept
    gone = query_stats(got, [skipped(t, Phase("A", at="end"))]).first()
    assert gone.skipped == sum(s[2] == "A" and s[4] is None for s in stages)


def test_single_matches_and_order(spark):
    big = (1 << 60) + 1
    t = tables_of(spark, [(1, 0, False, "a", ""), (2, 0, False, "b", "")], [(1, 0, "X", big, None), (2, 0, "X", big + 1, big + 6)], last=big + 10)
    hits = match_phases(t, Phase("x"))
    assert [(r.hit_idx, r.elapsed, r.open) for r in hits.orderBy("hit_idx").collect()] == [(0, 11, True), (1, 5, False)]
    assert match_phases(t, Phase("*", at="end")).count() == 1
    assert [r.hit_idx for r in sort_elapsed(hits, False).collect()] == [1, 0]
    assert '"op_id":"1"' in to_json_rows(hits.where("op_id = 1")).first().json


def test_elapsed_order_has_stable_ties(spark):
    ops = [(i, 0, False, "", "") for i in range(240)]
    t = tables_of(spark, ops, [(i, 0, "P", i, i + i % 11 + 1) for i in range(240)])
    hits = match_phases(t, Phase("P"))
    for down in (True, False):
        want = sorted(range(240), key=lambda i: (-(i % 11) if down else i % 11, i))
        assert [r.hit_idx for r in sort_elapsed(hits, down).collect()] == want
        assert [r.hit_idx for r in sorted_page(hits, 20, 10, down).orderBy("sort_idx").collect()] == want[20:30]
    assert [r.hit_idx for r in page(hits, 5, 3).orderBy("hit_idx").collect()] == [5, 6, 7]
    box = hit_bounds(hits, 240)
    kept = sorted(r.hit_idx for r in hits_in_window(box, (0, 10**6), (0, 239), limit=200, keep=230).collect())
    assert kept == [*range(199), 230]


def test_rectangles(spark):
    pairs = spark.createDataFrame([("t", 0, 0, 3, 120, 110)], "trace string, hit_idx long, s_row_idx long, t_row_idx long, s_cycle long, t_cycle long")
    one = lambda *a: tuple(hit_bounds(pairs, 6, *a).select("cycle_start", "cycle_end", "row_start", "row_end").first())
    assert one("both", 2) == (110, 120, 0, 5) and one("target") == (110, 120, 3, 3) and one("all") == (110, 120, 0, 5) and one("source", 9) == (110, 120, 0, 5)


def test_rows_and_areas(spark):
    n = (1 << 53) + 1
    t = tables_of(spark, [(n, 0, True, "", ""), (n + 2, 0, False, "", ""), (n + 5, 0, True, "", ""), (n + 9, 0, False, "", "")], [])
    shown = lambda *a: [tuple(r)[1:] for r in area_bounds(t.ops, *a).collect()]
    assert shown(1, 0, True) == [(n + 2, n + 9, 1, 3)] and shown(0, 1) == [(n, n + 2, 0, 1)] and shown(0, 7) == []
    assert [r.op_id - n for r in rows(t.ops, 0, 2, stride=2).orderBy("row_idx").collect()] == [0, 5]
    assert [r.op_id - n for r in rows(t.ops, 0, 9, hide_flushed=True).orderBy("row_idx").collect()] == [2, 9]


def test_hundred_threads(spark):
    ops = [(i, i % 100, False, "", "") for i in range(300)]
    t = tables_of(spark, ops, [(i, 0, "P", i, i + 1) for i in range(300)])
    got = pair_phases(t, Phase("P", at="end"), Phase("P"), skip=1).collect()
    assert len(got) == 100 and all(r.t_op_id == r.s_op_id + 200 and r.elapsed == 199 for r in got)


def test_exclusion_of_many_points(spark):
    """Every row has points and pairs, cycles are skewed and row order isn't cycle order; held against the model on some pairs."""
    rng = random.Random(8)
    n = 30_000
    cycle = [rng.randrange(50) if rng.random() < 0.5 else rng.randrange(10**9) for _ in range(n)]
    points = spark.createDataFrame([("t", i, c) for i, c in enumerate(cycle)], "trace string, p_row long, p_cycle long")
    pairs = []
    for i in range(n):
        a, b = rng.randrange(10**9), rng.randrange(60)
        pairs.append(("t", i, 0, i + rng.choice((0, 1, 3, -2, 500, n)), *((a, a + rng.randrange(10**7)) if rng.random() < 0.7 else (b, b + rng.randrange(4)))))
    df = spark.createDataFrame(pairs, "trace string, s_row_idx long, s_stage int, t_row_idx long, s_cycle long, t_cycle long")
    began = time.time()
    got = {r.s_row_idx for r in _hit_rows(df, points).collect()}, {r.s_row_idx for r in _hit_any(df, points).collect()}
    assert time.time() - began < 120
    for p in rng.sample(pairs, 400):
        pair = ((0, p[1], 0, p[4]), (0, p[3], 0, p[5]))
        for k, rows_ in enumerate((True, False)):
            assert (p[1] in got[k]) == model.enclosed(pair, enumerate(cycle), rows_)


def test_stages_are_matched_without_their_operations(spark):
    t, _, _ = random_tables(spark, 5)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    joins = lambda df: plan(df).count("Join Inner")
    status = Phase("A", status="retired", where=(("rid", ">", 3), ("duration", ">=", 2)), phase_meta="*")
    assert joins(endpoints(t, status)) == 1 and joins(endpoints(t, Phase("A", instr="op1"))) == 2  # the last cycle; the label
    bare = Tables(t.ops, t.stages.drop("gid", "rid", "flushed", "incomplete"), traces=t.traces)
    for phase in (status, Phase("*", instr="op2", status="flushed")):
        key = lambda x: sorted((r.op_id, r.stage, r.cycle, r.elapsed) for r in match_phases(x, phase).collect())  # noqa: B023, E731
        assert key(t) == key(bare)


def test_next_points_decide_pairs_in_order(spark, monkeypatch):
    """Where rows are in the order of cycles, no pair is left for blocks; elsewhere only those that the next point leaves open."""
    pair = lambda i, s, t, a, b: ("t", i, 0, s, t, a, b)
    kinds = "trace string, s_op_id long, s_stage int, s_row_idx long, t_row_idx long, s_cycle long, t_cycle long"
    ordered = spark.createDataFrame([pair(i, i, i + 5, 10 * i, 10 * i + 50) for i in range(0, 300, 2)], kinds)
    points = spark.createDataFrame([("t", i, 10 * i) for i in range(0, 150, 3)] + [("t", i, 10 * i) for i in range(150, 300, 40)], "trace string, p_row long, p_cycle long")
    at = [r.p_row for r in points.collect()]
    left, blocks = [], exclude._hit_blocks
    monkeypatch.setattr(exclude, "_hit_blocks", lambda spans, points: (left.extend(r.s_row_idx for r in spans.collect()), blocks(spans, points))[1])
    assert sorted(r.s_row_idx for r in _hit_rows(ordered, points).collect()) == [i for i in range(0, 300, 2) if any(i < p < i + 5 for p in at)] and not left
    # the next point's row is outside: the last point of its rows is in 7, 400 has none, 700 has another one than both
    mixed = spark.createDataFrame([pair(7, 7, 20, 100, 200), pair(400, 400, 420, 100, 200), pair(600, 600, 640, 500, 501), pair(700, 700, 740, 300, 400), pair(800, 800, 840, 300, 400)], kinds)
    points = spark.createDataFrame([("t", 90, 110), ("t", 9, 150), ("t", 610, 501), ("t", 5, 310), ("t", 701, 350), ("t", 735, 10), ("t", 835, 10)], "trace string, p_row long, p_cycle long")
    for size in (exclude.POINTS, 2):
        left.clear()
        monkeypatch.setattr(exclude, "POINTS", size)
        assert sorted(r.s_row_idx for r in _hit_rows(mixed, points).collect()) == [7, 700] and sorted(left) == [700, 800]
