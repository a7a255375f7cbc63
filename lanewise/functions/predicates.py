"""Phase conditions: which stage occurrences match, and at which of their two boundaries."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from .patterns import lines, some_line, user_regex, wildcard

COMPARISONS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
NUMBERS = {"op": "op_id", "global": "gid", "thread": "tid", "rid": "rid", "cycle": "cycle", "duration": "duration"}
STATUSES = ("all", "retired", "flushed", "incomplete")
LIMIT, LABEL_LIMIT = 1 << 64, 80


def compare(column: Column, op: str, value: int) -> Column:
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}")
    if abs(value) >= 1 << 63:  # a decimal, of 38 digits at most: no column has more
        value = Decimal(max(-(10**37), min(value, 10**37)))
    return getattr(column, COMPARISONS[op])(F.lit(value))


def status_is(status: str) -> Column:
    flushed, incomplete = F.col("flushed"), F.col("incomplete")
    return {"all": F.lit(True), "retired": ~flushed & ~incomplete, "flushed": flushed, "incomplete": incomplete}[status]


def boundary_cycle(at: str) -> Column:
    return F.col("end_cycle") if at == "end" else F.col("start_cycle")


def after_last() -> Column:
    """The end shown of what hasn't ended: the cycle after the trace's last one, or that one if there is none beyond."""
    return F.coalesce(F.try_add(F.col("last_cycle"), F.lit(1)), F.col("last_cycle"))


@dataclass(frozen=True)
class Phase:
    """Conditions on a stage occurrence, all of which must hold; text is compared without case.

    name (required, `*` is any) and lane match whole names; instr and the *_contains forms match
    within, meta forms a whole line of the operation's detail (op_meta), the stage's labels
    (phase_meta) or either (meta); *_re are regular expressions. where lists numeric comparisons
    such as ("duration", ">=", 5). at is the boundary that counts, "start" or "end".
    """

    name: str
    at: str = "start"
    lane: str | None = None
    instr: str | None = None
    instr_re: str | None = None
    meta: str | None = None
    op_meta: str | None = None
    phase_meta: str | None = None
    meta_contains: str | None = None
    op_meta_contains: str | None = None
    phase_meta_contains: str | None = None
    meta_re: str | None = None
    op_meta_re: str | None = None
    phase_meta_re: str | None = None
    status: str = "all"
    where: tuple[tuple[str, str, int], ...] = ()
    label: str = ""

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a phase condition is required; * is any phase")
        if self.at not in ("start", "end"):
            raise ValueError(f"at is start or end, not {self.at!r}")
        if self.status not in STATUSES:
            raise ValueError(f"status is one of {STATUSES}, not {self.status!r}")
        if len(self.label) > LABEL_LIMIT:
            raise ValueError(f"a label has at most {LABEL_LIMIT} characters")
        for field, op, value in self.where:
            if field not in NUMBERS:
                raise ValueError(f"unknown field {field!r}")
            if op not in COMPARISONS:
                raise ValueError(f"unknown comparison {op!r}")
            if not isinstance(value, int) or isinstance(value, bool) or not 0 <= value < LIMIT:
                raise ValueError(f"{field} is compared with a whole number from 0 to 2**64 - 1, not {value!r}")

    def on_numbers(self) -> Column:
        """The tests of status and numbers, over stages with their operation's and the trace's last cycle."""
        tests = [F.lit(True) if self.status == "all" else status_is(self.status)]
        return reduce(and_, [*tests, *[compare(self._number(field), op, value) for field, op, value in self.where]])

    def on_texts(self) -> Column:
        """The tests of texts; those but phase_meta need the operation's label and detail."""
        tests = [F.lit(True)]
        if self.instr is not None:
            tests.append(F.col("label").rlike(wildcard(self.instr, whole=False)))
        if self.instr_re is not None:
            tests.append(F.col("label").rlike(user_regex(self.instr_re)))
        own, phase = lines(F.col("detail")), lines(F.col("labels"))
        scopes = {"meta": F.concat(own, phase), "op_meta": own, "phase_meta": phase}
        for scope, array in scopes.items():
            for suffix, compiled in (("", lambda p: wildcard(p, whole=True)), ("_contains", lambda p: wildcard(p, whole=False)), ("_re", user_regex)):
                if (pattern := getattr(self, scope + suffix)) is not None:
                    tests.append(some_line(array, compiled(pattern)))
        return reduce(and_, tests)

    def needs_text(self) -> bool:
        """Whether a test reads the operation's label or detail."""
        return any(getattr(self, x) is not None for x in ("instr", "instr_re", "meta", "op_meta", "meta_contains", "op_meta_contains", "meta_re", "op_meta_re"))

    def _number(self, field: str) -> Column:
        if field == "cycle":
            return boundary_cycle(self.at)
        if field == "duration":
            return F.greatest(F.coalesce(F.col("end_cycle"), after_last()) - F.col("start_cycle"), F.lit(0))
        return F.col(NUMBERS[field])
