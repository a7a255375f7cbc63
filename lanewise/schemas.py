"""The fixed table schemas, and the bundle of tables that operators take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

LINES = "trace STRING, block BIGINT, pos BIGINT, value STRING"
OPS = "trace STRING, op_id BIGINT, gid BIGINT, tid BIGINT, rid BIGINT, fetch_cycle BIGINT, end_cycle BIGINT, flushed BOOLEAN, incomplete BOOLEAN, line BIGINT, label STRING, detail STRING, row_idx BIGINT"
STAGES = "trace STRING, op_id BIGINT, row_idx BIGINT, tid BIGINT, gid BIGINT, rid BIGINT, flushed BOOLEAN, incomplete BOOLEAN, stage INT, lane STRING, name STRING, lane_index INT, lane_count INT, start_cycle BIGINT, end_cycle BIGINT, labels STRING, open BOOLEAN"
DEPS = "trace STRING, op_id BIGINT, seq INT, producer BIGINT, kind BIGINT, cycle BIGINT"
SYMBOLS = "trace STRING, symbol_id INT, name STRING"
TRACES = "trace STRING, count BIGINT, flushed BIGINT, first_cycle BIGINT, last_cycle BIGINT, warning_count BIGINT, warnings ARRAY<STRING>, symbols ARRAY<STRING>, bytes BIGINT, complete BOOLEAN"
REJECTS = "trace STRING, line BIGINT, reason STRING, value STRING"
#: Columns that are unsigned 64-bit numbers in tables of wide traces.
WIDE_COLUMNS = frozenset("op_id gid tid rid fetch_cycle end_cycle start_cycle producer kind cycle first_cycle last_cycle".split())


def of(name: str, wide: bool = False) -> str:
    """A table's schema by its name."""
    columns = [c.split(" ", 1) for c in globals()[name.upper()].split(", ")]
    return ", ".join(f"{c} DECIMAL(20,0)" if wide and c in WIDE_COLUMNS else f"{c} {t}" for c, t in columns)


@dataclass(frozen=True)
class Tables:
    """A set of traces. `ops` and `stages` suffice for queries; the others come from ingest."""

    ops: DataFrame
    stages: DataFrame
    deps: DataFrame | None = None
    symbols: DataFrame | None = None
    traces: DataFrame | None = None
    rejects: DataFrame | None = None
