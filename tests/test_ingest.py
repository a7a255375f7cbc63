"""Logs into tables: known small logs, random logs against the sequential model, files and codecs."""

import gzip
import os
import random

import pytest
import zstandard

from lanewise.functions.predicates import Phase
from lanewise.operators.match import endpoints, match_phases
from lanewise.operators.overview import overview, suggest
from lanewise.operators.search import search, snippets
from lanewise.sources.ingest import ingest, ingest_lines, parse
from lanewise.sources.store import load, load_buckets, save, save_buckets
from lanewise.storage import scratch
from lanewise.streaming.stream import stream_ingest

from . import model

BASIC = """Kanata\t0004
C=\t100
I\t0\t10\t0
L\t0\t0\tproducer\\nname
S\t0\t0\tF
C\t1
S\t0\t0\tX
L\t0\t2\texecute\\nlabel
S\t0\t1\tM
I\t1\t11\t1
L\t1\t0\tconsumer
W\t1\t0\t0
S\t1\t0\tF
C\t2
E\t0\t1\tM
R\t0\t5\t0
S\t1\t0\tX
C\t2
R\t1\t6\t1
L\t1\t1\tlate\ttext
"""


def lines_of(spark, text, trace="t", size=7):
    rows = [(trace, i // size, i % size, v) for i, v in enumerate(text.split("\n")[:-1])]
    return spark.createDataFrame(rows, "trace string, block long, pos long, value string")


def seen(tables):
    ops = {r.op_id: r for r in tables.ops.collect()}
    stages = {}
    for s in sorted(tables.stages.collect(), key=lambda s: s.stage):
        stages.setdefault(s.op_id, []).append(s)
    deps = {}
    for d in sorted(tables.deps.collect(), key=lambda d: d.seq):
        deps.setdefault(d.op_id, []).append((d.producer, d.kind, d.cycle))
    return ops, stages, deps


def test_basic_log(spark):
    t = ingest_lines(lines_of(spark, BASIC))
    info = t.traces.first()
    assert (info["count"], info.flushed, info.first_cycle, info.last_cycle, info.warning_count) == (2, 1, 100, 105, 0)
    ops, stages, deps = seen(t)
    assert ops[0].label == "producer\nname" and ops[1].flushed and ops[1].detail == "late\ttext"
    assert [s.name for s in stages[0]] == ["F", "X", "M"] and stages[0][1].labels == "execute\nlabel" and stages[0][2].lane_index == 1
    assert deps[1] == [(0, 0, 101)]
    assert info.symbols == ["0", "F", "X", "1", "M"]
    grid = overview(t).collect()
    assert {r.y for r in grid} == {0, 1} and all((r.color >= 128) == (r.y == 1) for r in grid)
    found = search(t, "producer|consumer", regex=True)
    assert sorted(r.op_id for r in found.collect()) == [0, 1] and [r.op_id for r in search(t, status="flushed").collect()] == [1]
    assert [r.snippet for r in snippets(search(t, "EXECUTE"), t, "EXECUTE").collect()] == ["Stage metadata: execute\nlabel"]
    assert [r.value for r in suggest(t, "phase_metadata", "lab*").collect()] == ["label"]


def test_resource_lines_and_incomplete(spark):
    t = ingest_lines(lines_of(spark, "Kanata\t0004\ncore=CPU:width=4\nI\t3\t0\t0\nRQU=15:RSQ=14\n\nS\t3\t0\tF\nC\t4\n"))
    op = t.ops.first()
    assert op.incomplete and op.end_cycle == 5 and t.rejects.count() == 0 and t.stages.first().open


def random_log(seed, n=220):
    rng, out = random.Random(seed), ["Kanata\t0004"]
    for _ in range(n):
        i, lane, name = rng.randrange(8), rng.choice("01"), rng.choice(["F", "X", "M "])
        out.append(
            rng.choice(
                [f"C\t{rng.randrange(4)}", f"C=\t{rng.randrange(200)}", f"I\t{i}\t{i}\t{i % 3}", f"S\t{i}\t{lane}\t{name}", f"S\t{i}\t{lane}\t{name}", f"E\t{i}\t{lane}\t{name}", f"E\t{i}\t{lane}\tnew", f"R\t{i}\t{rng.randrange(9)}\t{rng.choice('0012')}" if rng.random() < 0.4 else "C\t1", f"L\t{i}\t{rng.choice('01223')}\ta\\n{rng.randrange(9)}", f"L\t{i}\t2\t", f"W\t{i}\t{rng.randrange(8)}\t1", rng.choice(["Q\t1", "I\tx\t1\t1", "I\t9\t-1\t0", "k=v", "", "S\t1", "L\t1\t0", "C\t-3", "C\t99999999999999999999", f"R\t{i}\tz\t0", f"W\t{i}\t1"])]
            )
        )
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("seed", range(2))
def test_random_logs_match_the_model(spark, seed):
    texts = {f"t{k}": random_log(seed * 10 + k) for k in range(3)}
    lines = None
    for name, text in texts.items():
        part = lines_of(spark, text, name, 17)
        lines = part if lines is None else lines.unionAll(part)
    t = ingest_lines(lines)
    ops, stages, deps, infos = t.ops.collect(), t.stages.collect(), t.deps.collect(), {r.trace: r for r in t.traces.collect()}
    for name, text in texts.items():
        want, first, last, names, refused = model.read(text.split("\n")[:-1])
        own = {r.op_id: r for r in ops if r.trace == name}
        assert {i: (o["gid"], o["tid"], o["rid"], o["fetch"], o["end"], o["flushed"], o["incomplete"], o["label"], o["detail"], o["line"]) for i, o in want.items()} == {i: (r.gid, r.tid, r.rid, r.fetch_cycle, r.end_cycle, r.flushed, r.incomplete, r.label, r.detail, r.line) for i, r in own.items()}
        assert sorted((r.row_idx, i) for i, r in own.items()) == list(enumerate(sorted(want)))
        got = sorted((s.op_id, s.stage, s.lane, s.name, s.start_cycle, s.end_cycle, s.labels) for s in stages if s.trace == name)
        assert got == sorted((i, k, s["lane"], s["name"], s["start"], s["end"], s["labels"]) for i, o in want.items() for k, s in enumerate(o["stages"]))
        assert sorted((d.op_id, d.seq, d.producer, d.kind, d.cycle) for d in deps if d.trace == name) == sorted((i, k, *d) for i, o in want.items() for k, d in enumerate(o["deps"]))
        info = infos[name]
        assert (info.first_cycle, info.last_cycle, info.symbols, info.warning_count, info["count"]) == (first, last, names, refused, len(want))


def test_files_codecs_and_store(spark, tmp_path):
    text = BASIC.replace("\n", "\r\n").rstrip("\r\n")
    half = len(text) // 2
    (tmp_path / "plain.log").write_text(text, newline="")
    (tmp_path / "a.gz").write_bytes(gzip.compress(text[:half].encode()) + gzip.compress(text[half:].encode()))
    z = zstandard.ZstdCompressor().compress
    (tmp_path / "b.zst").write_bytes(z(text[:half].encode()) + z(text[half:].encode()))
    (tmp_path / "c.zstd").write_bytes(z(text.encode()))
    t = ingest(spark, str(tmp_path))
    by = {r.trace.rsplit("/", 1)[-1]: (r["count"], r.flushed, r.first_cycle, r.last_cycle, r.warning_count) for r in t.traces.collect()}
    assert by == dict.fromkeys(["plain.log", "a.gz", "b.zst", "c.zstd"], (2, 1, 100, 105, 0))
    save(t, str(tmp_path / "saved"))
    back = load(spark, str(tmp_path / "saved"))
    assert sorted(map(str, back.stages.select(*t.stages.columns).collect())) == sorted(map(str, t.stages.collect()))


def test_buckets_are_joined_where_they_lie(spark, tmp_path):
    t = ingest_lines(lines_of(spark, BASIC))
    save_buckets(t, spark, "small", str(tmp_path / "buckets"), 3)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for phase in (Phase("*", instr="prod*"), Phase("x", op_meta_contains="late")):
            plan = endpoints(load_buckets(spark, "small"), phase)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin [trace" in plan and "hashpartitioning(trace" not in plan
            shuffled = endpoints(t, phase)
            assert "hashpartitioning(trace" in shuffled._jdf.queryExecution().executedPlan().toString()
            assert sorted((r.op_id, r.stage) for r in endpoints(load_buckets(spark, "small"), phase).collect()) == sorted((r.op_id, r.stage) for r in shuffled.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    save_buckets(t, spark, "small", str(tmp_path / "again"))
    assert load_buckets(spark, "small").stages.count() == t.stages.count()


def test_names_reach_the_scan_of_saved_traces(spark, tmp_path):
    save(ingest_lines(lines_of(spark, BASIC + "S\t0\t0\tFetch\nS\t0\t0\tfx\n")), str(tmp_path / "saved"))
    t = load(spark, str(tmp_path / "saved"))
    for pattern, names, n in (("f*", "[Fetch,F,fx]", 4), ("x", "[X]", 2), ("none*", None, 0)):
        hits = match_phases(t, Phase(pattern), texts=False)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert hits.count() == n
        if names:
            listed = [p for p in plan.split("PushedFilters: ")[1:] if "name" in p]
            assert listed and all(x in listed[0] for x in names.strip("[]").split(","))


def test_texts_beyond_the_limit_are_not_gathered(spark):
    log = "Kanata\t0004\nI\t0\t0\t0\nI\t1\t0\t0\nL\t0\t0\tab\n" + "".join(f"L\t0\t{k % 2}\t{k:06d}\n" for k in range(50)) + "L\t1\t0\t12345\nL\t1\t1\t67890\nS\t0\t0\tF\nL\t0\t2\tstays\n"
    t = parse(lines_of(spark, log), max_op_bytes=10)
    assert {r.op_id: (r.label, r.detail) for r in t.ops.collect()} == {0: ("", ""), 1: ("12345", "67890")}
    assert [(r.line, r.reason) for r in t.rejects.collect()] == [(2, "operation_too_large")] and t.stages.first().labels == "stays"


def test_suggestions_widen_until_there_are_enough(spark):
    log = "Kanata\t0004\n" + "".join(f"I\t{i}\t0\t0\nL\t{i}\t0\tv{i // 10}\nS\t{i}\t0\t{'F' if i < 390 else 'late'}\n" for i in range(400))
    t = ingest_lines(lines_of(spark, log, size=50))
    for rows in (1, 16, 1000):
        assert [r.value for r in suggest(t, "instruction", "v", rows=rows).collect()] == sorted(f"v{k}" for k in range(16))
        assert [r.value for r in suggest(t, "phase", "late", rows=rows).collect()] == ["late"] and suggest(t, "lane", "none", rows=rows).collect() == []


def test_scratch_tables_are_deleted(spark):
    with scratch(spark):
        t = ingest_lines(lines_of(spark, BASIC))
        files = [f.removeprefix("file://").removeprefix("file:") for f in t.ops.inputFiles()]
        assert files and all(os.path.exists(f) for f in files) and t.ops.count() == 2
    assert not any(os.path.exists(f) for f in files)


def test_snippets_end_at_whole_characters(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé日\U0001f600 ") for _ in range(rng.randrange(120))) + "KEY" + "".join(rng.choice("aé日\U0001f600 ") for _ in range(rng.randrange(120))) for _ in range(80)]
    log = "Kanata\t0004\n" + "".join(f"I\t{i}\t0\t0\nL\t{i}\t0\t{x}\n" for i, x in enumerate(texts))
    t = ingest_lines(lines_of(spark, log, size=50))
    found = snippets(search(t, "key"), t, "key")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        raw = texts[r.op_id].encode()
        at = raw.index(b"KEY")
        start, end = max(at - 40, 0), min(at + 63, len(raw))
        while start > 0 and raw[start] & 0xC0 == 0x80:
            start -= 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        assert r.snippet == "Disassembly: " + raw[start:end].decode()


def test_bad_files(spark, tmp_path):
    (tmp_path / "bad").write_text("Kanata\t0005\nI\t0\t0\t0\n")
    (tmp_path / "good").write_text(BASIC)
    (tmp_path / "bytes").write_bytes(b"Kanata\t0004\nI\t0\t0\t0\nL\t0\t0\t\xff\xfe\n")
    with pytest.raises(ValueError, match="header|utf8"):
        ingest(spark, str(tmp_path))
    t = ingest(spark, str(tmp_path), on_bad="reject")
    assert [r.trace.rsplit("/", 1)[-1] for r in t.traces.collect()] == ["good"]
    assert {(r.trace.rsplit("/", 1)[-1], r.reason) for r in t.rejects.collect()} == {("bad", "bad_header"), ("bytes", "not_utf8")}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty").write_text("")
    with pytest.raises(ValueError, match="empty"):
        ingest(spark, str(tmp_path / "none"))
    (tmp_path / "none" / "good").write_text(BASIC)
    (tmp_path / "none" / "nothing.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "none" / "spaced").write_text("Kanata\t0004 \n")
    with pytest.raises(ValueError, match="empty"):
        ingest(spark, str(tmp_path / "none"))
    t = ingest(spark, str(tmp_path / "none"), on_bad="reject")
    assert [r.trace.rsplit("/", 1)[-1] for r in t.traces.collect()] == ["good"]
    assert {(r.trace.rsplit("/", 1)[-1], r.reason) for r in t.rejects.collect()} == {("empty", "empty_file"), ("nothing.gz", "empty_file"), ("spaced", "bad_header")}


def clock_log(seed, most, n=260):
    """Additions of every size up to the greatest number and beyond, in an order that matters."""
    rng, out = random.Random(seed), ["Kanata\t0004", "I\t1\t1\t1"]
    for k in range(n):
        add = rng.choice([rng.randrange(4), rng.randrange(1 << rng.randrange(1, most.bit_length() + 1)), most - rng.randrange(5)])
        out += [f"C\t{add}" if rng.random() < 0.8 else f"C=\t{rng.randrange(1 << rng.randrange(1, most.bit_length() + 1))}", f"S\t1\t0\tn{k % 7}"]
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("wide", [False, True])
def test_clock_beyond_the_greatest_number(spark, wide, tmp_path):
    most = (1 << 64) - 1 if wide else (1 << 63) - 1
    texts = {f"t{k}": clock_log(k, most, 60 * k + 20) for k in range(3)}
    texts |= {"two": f"Kanata\t0004\nC\t{most}\nI\t0\t0\t0\nC\t{most}\nC\t1\nC\t0\nS\t0\t0\tF\n", "set": f"Kanata\t0004\nC=\t{most}\nI\t0\t0\t0\nC\t5\n", "calm": BASIC}
    lines = None
    for name, text in texts.items():
        part = lines_of(spark, text, name, 11)
        lines = part if lines is None else lines.unionAll(part)
    t = ingest_lines(lines, wide=wide)
    stages, infos = t.stages.collect(), {r.trace: r for r in t.traces.collect()}
    for name, text in texts.items():
        want, first, last, names, refused = model.read(text.split("\n")[:-1], most)
        got = sorted((s.op_id, s.stage, s.name, s.start_cycle, s.end_cycle) for s in stages if s.trace == name)
        assert got == sorted((i, k, s["name"], s["start"], s["end"]) for i, o in want.items() for k, s in enumerate(o["stages"]))
        assert (infos[name].first_cycle, infos[name].last_cycle, infos[name].symbols, infos[name].warning_count) == (first, last, names, refused)
    save(t, str(tmp_path / "saved"))
    back = load(spark, str(tmp_path / "saved"), wide)
    assert sorted(map(str, back.stages.collect())) == sorted(map(str, stages)) and back.ops.schema["op_id"].dataType.simpleString() == ("decimal(20,0)" if wide else "bigint")
    hits = match_phases(back, Phase("*", where=(("cycle", "=", most),)))
    assert hits.count() == sum(s.start_cycle == most for s in stages) > 0 and {r.elapsed for r in hits.where("trace = 'two'").collect()} <= {0, 1}


def test_labels_without_text(spark):
    t = ingest_lines(lines_of(spark, "Kanata\t0004\nI\t0\t0\t0\nL\t0\t0\nL\t0\t1\tx\nL\t0\t1\nS\t0\t0\tF\nL\t0\t2\ta\nL\t0\t2\nL\t0\t2\tb\nL\t0\n"))
    assert (t.ops.first().label, t.ops.first().detail, t.stages.first().labels) == ("", "x", "a\n\nb")
    assert [r.reason for r in t.rejects.collect()] == ["invalid_number"]


@pytest.mark.parametrize("limit", [3, 6])
def test_names_beyond_the_limit(spark, limit):
    rng, texts = random.Random(limit), {}
    for k in range(3):
        out = ["Kanata\t0004", "I\t1\t1\t1", "I\t2\t1\t1"]
        for _ in range(120):
            lane, name, op = rng.choice(["0", "1", "2", "long" * 70]), rng.choice([*"abcdefgh", "0", "much" * 70])[: 300 if k else 1], rng.choice("123")
            out.append(rng.choice([f"S\t{op}\t{lane}\t{name}", f"S\t{op}\t{lane}\t{name}", f"E\t{op}\t{lane}\t{name}", "C\t1", f"L\t{op}\t2\tx{rng.randrange(9)}"]))
        texts[f"t{k}"] = "\n".join(out) + "\n"
    lines = None
    for name, text in texts.items():
        part = lines_of(spark, text, name, 13)
        lines = part if lines is None else lines.unionAll(part)
    t = parse(lines, symbol_limit=limit)
    stages, infos = t.stages.collect(), {r.trace: r for r in t.traces.collect()}
    for name, text in texts.items():
        want, _, _, names, refused = model.read(text.split("\n")[:-1], limit=limit)
        got = sorted((s.op_id, s.stage, s.lane, s.name, s.start_cycle, s.end_cycle, s.labels) for s in stages if s.trace == name)
        assert got == sorted((i, k, s["lane"], s["name"], s["start"], s["end"], s["labels"]) for i, o in want.items() for k, s in enumerate(o["stages"]))
        assert (infos[name].symbols, infos[name].warning_count) == (names, refused)
    assert "symbol_limit" in {r.reason for r in t.rejects.collect()}


def test_stream_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one").write_text(BASIC)
    run = lambda: stream_ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    run()
    (src / "two").write_text(BASIC)
    run()
    run()
    got = load(spark, str(tmp_path / "out"))
    assert sorted((r.trace.rsplit("/", 1)[-1], r.op_id) for r in got.ops.collect()) == [("one", 0), ("one", 1), ("two", 0), ("two", 1)]


def test_files_of_one_name_and_odd_names(spark, tmp_path):
    """Equal base names in two folders are two traces; names with signs of patterns are read as they are."""
    later = BASIC.replace("C=\t100", "C=\t500")
    for folder, name, text in (("a", "trace.log", BASIC), ("b", "trace.log", later), ("b", "x[1]{2}.log", BASIC), ("b", "x1.log", later)):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / name).write_text(text)
    t = ingest(spark, str(tmp_path / "in" / "*"))
    assert sorted((r["count"], r.first_cycle, r.warning_count, r.bytes) for r in t.traces.collect()) == [(2, 100, 0, len(BASIC))] * 2 + [(2, 500, 0, len(BASIC))] * 2
    assert t.traces.select("trace").distinct().count() == 4 and t.ops.count() == 8
    stream_ingest(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), str(tmp_path / "mark"), files_per_batch=3).awaitTermination()
    got = load(spark, str(tmp_path / "out"))
    assert sorted((r["count"], r.first_cycle) for r in got.traces.collect()) == [(2, 100)] * 2 + [(2, 500)] * 2
    assert sorted(map(str, got.stages.collect())) == sorted(map(str, t.stages.select(*got.stages.columns).collect()))
