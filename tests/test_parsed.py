"""Tables of a log made alone: equal to those made together, and without what only others need."""

import pytest

from lanewise.sources import ingest
from lanewise.sources.adapters import order_log

from .test_ingest import BASIC, lines_of


@pytest.fixture(scope="module")
def log(spark, sf, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('log')}/lines"
    kept = order_log(spark, sf).where(f"block = 0 or (block = 1 and pos < {150 << 24})")
    kept.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def whole(log):
    return ingest.parse(log)


@pytest.mark.parametrize("name, labels", [("ops", {"lines", "ops"}), ("stages", {"lines", "placed", "names", "ops"}), ("deps", {"lines"}), ("symbols", {"lines", "names"}), ("counts", {"lines"})])
def test_a_table_alone(monkeypatch, log, whole, name, labels):
    want = sorted(map(str, getattr(whole, name).collect()))
    seen, write = set(), ingest.written
    monkeypatch.setattr(ingest, "written", lambda df, label, *more: (seen.add((label, "value" in df.columns and df.where("cmd = 'S' and value is not null").isEmpty())), write(df, label, *more))[1])
    alone = ingest.parse(log, only=[name])
    assert sorted(map(str, getattr(alone, name).collect())) == want and len(want) > 0
    assert {label for label, _ in seen} - {"clock", "phase"} == labels
    assert all(lean for label, lean in seen if label == "lines") or name in ("stages", "symbols")


def test_tables_not_asked_for_are_refused(spark):
    t = ingest.parse(lines_of(spark, BASIC), only=["deps"])
    with pytest.raises(ValueError, match="ops is not among"):
        t.ops  # noqa: B018
    with pytest.raises(ValueError, match="no tables"):
        ingest.parse(lines_of(spark, BASIC), only=["op"])
