"""Event logs into tables.

A log is lines in order; a line's place is (block, pos), where a block is a split of a file. What
depends on the order of the whole log (line numbers, the clock) is scanned inside blocks and
carried across them; all else depends on one operation's lines only and is grouped by (trace, op).
Lines that are not understood are never lost: they are rows of `rejects` with a reason.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property, partial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.patterns import unescaped
from ..operators.scan import numbered_by_ranges, with_rows
from ..schemas import Tables
from ..storage import written
from .frames import ENDING, read_frames

# Fixed values of the format and its limits
MAGIC, VERSION = "Kanata", "0004"
LINE_LIMIT, SYMBOL_LIMIT, NAME_LIMIT, WARNINGS, OP_BYTES = 8 << 20, 65_536, 256, 10, 8 << 20
COMMANDS = ("I", "L", "S", "E", "R", "W")
OP = ["trace", "op_id"]
#: An operation's keys for windows and groups: as a log has few traces, a sort that begins by the id tells rows apart sooner.
BY_OP = ["op_id", "trace"]
#: Columns of the lines as they are written.
LINE = ["trace", "block", "at", "value", "cmd", "add", "set", "refused", "d", "m", "issue", "head"]
#: Blocks of a log up to which their totals are sent to every task.
BLOCKS = 1 << 18


@dataclass(frozen=True)
class Numbers:
    """The type of identifiers and cycles, and the greatest one."""

    type: str
    most: int

    def lit(self, value: int) -> Column:
        return F.lit(Decimal(value)).cast(self.type)


LONG, WIDE = Numbers("bigint", (1 << 63) - 1), Numbers("decimal(20,0)", (1 << 64) - 1)


def read_lines(spark: SparkSession, paths: str | Sequence[str], range_bytes: int | None = None) -> DataFrame:
    r"""trace, block, pos, value of text files, plain or compressed by their name's ending (.gz, .zst, .zstd).

    Only `\n` ends a line; one `\r` before it is dropped. trace is the file's whole path, so files of one name
    in different folders are different traces. With range_bytes, Zstandard files are read in ranges of so many
    compressed bytes, a task for each, if they have several frames; else by one task a file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.option("lineSep", "\n").text(paths)
    if range_bytes is not None:
        raw = raw.where(~F.col("_metadata.file_path").rlike(ENDING))
    meta = raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos")).withColumnRenamed("path", "trace")
    if range_bytes is not None:
        meta = meta.unionByName(read_frames(spark, paths, range_bytes))
    return meta.select("trace", "block", "pos", F.when(F.endswith("value", F.lit("\r")), F.substring(F.col("value"), F.lit(1), F.length("value") - 1)).otherwise(F.col("value")).alias("value"))


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """lines with line: 1, 2, ... in each trace."""
    own = Window.partitionBy("block", "trace").orderBy("pos")
    before = Window.partitionBy("trace").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = lines.groupBy("trace", "block").agg(F.count("*").alias("n")).select("trace", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return lines.withColumn("at", F.row_number().over(own)).join(bases, ["trace", "block"]).select("trace", "block", (F.col("at") + F.col("base")).alias("line"), "value")


def _number(text: Column, kind: Numbers = LONG) -> Column:
    """A whole number: digits, a plus sign before them allowed, white space around; null for all else and beyond the kind's greatest."""
    found = F.trim(text).try_cast(kind.type)
    if kind is WIDE:
        found = F.when(found <= kind.lit(kind.most), found)
    return F.when(text.rlike(r"\A\s*\+?[0-9]+\s*\z"), found)


def _too_large(text: Column, kind: Numbers = LONG) -> Column:
    return F.coalesce(text.rlike(r"\A\s*\+?[0-9]+\s*\z"), F.lit(False)) & _number(text, kind).isNull()


def numbered_lines(lines: DataFrame, kind: Numbers = LONG, needed: Column | None = None, in_lines: bool = True, checked: bool = False) -> DataFrame:
    """Lines with at (their place in the block), cmd, add, set, refused, d and m (see placed_lines), issue, head and n, the block's lines.

    An addition is refused at once if it would pass the greatest number even if the clock were only what the block has set
    it to before; whether others are is known once the clock of the whole trace is.

    needed: which lines (by cmd and value) are kept with their value, all if None; of the others only each block's first and last line
    stay, and those with an issue, which makes a whole trace unreadable and is looked for if checked. Without in_lines they
    are not even counted, so that line tells the order of those that stay only (unless checked, when any may be the header).
    """
    fields = F.split("value", "\t", -1)
    given = lines.withColumn("cmd", F.substring_index("value", "\t", 1))
    arg = _number(F.get(fields, 1), kind)
    issue = F.when(~F.is_valid_utf8("value"), "not_utf8").when(F.octet_length("value") > LINE_LIMIT, "line_too_long") if checked else F.lit(None).cast("string")
    head = F.when(F.col("cmd") == MAGIC, F.get(fields, 1) == VERSION)
    given = given.select("trace", "block", "pos", "value", "cmd", F.when(F.col("cmd") == "C", arg).alias("add"), F.when(F.col("cmd") == "C=", arg).alias("set"), head.alias("head"), issue.alias("issue"))
    given = given.withColumn("_wanted", F.lit(True) if needed is None else F.coalesce(needed, F.lit(False)))
    if needed is not None:
        if not in_lines and not checked:
            given = given.where(F.col("_wanted") | F.col("cmd").isin(MAGIC, "C", "C="))
        value = F.when(F.col("_wanted"), F.col("value")).when(F.col("issue").isNotNull(), F.left("value", F.lit(200)))
        given = given.withColumn("value", value).withColumn("cmd", F.when(F.col("_wanted"), F.col("cmd")))
    by_pos = Window.partitionBy("block", "trace").orderBy("pos")
    so_far, whole = by_pos.rowsBetween(Window.unboundedPreceding, 0), by_pos.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given = given.withColumn("at", F.row_number().over(by_pos)).withColumn("n", F.count(F.lit(1)).over(whole))
    stays = F.col("_wanted") | (F.col("at") == 1) | (F.col("at") == F.col("n")) | F.col("issue").isNotNull()
    if needed is not None:  # other lines are counted, and that is all
        given = given.where(stays | F.col("add").isNotNull() | F.col("set").isNotNull())
    given = given.withColumn("top", F.max("set").over(so_far))
    sure = F.col("add") > kind.lit(kind.most) - F.coalesce("top", kind.lit(0))
    placed = placed_lines(given.withColumn("refused", F.coalesce(sure, F.lit(False))), "pos")
    return placed.where(stays).select(*LINE)


def placed_lines(given: DataFrame, order: str = "at") -> DataFrame:
    """Lines with d, the sum of their block's additions so far (null beyond its type), and m, the greatest set value less d."""
    own = Window.partitionBy("block", "trace").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = F.when(F.col("add").isNull() | F.col("refused"), F.lit(0).cast(given.schema["add"].dataType)).otherwise(F.col("add"))
    return given.withColumn("d", F.try_sum(counted).over(own)).withColumn("m", F.max(F.col("set") - F.col("d")).over(own))


def carried_blocks(inside: DataFrame, checked: bool = False) -> DataFrame:
    """A row a block: base (lines before it), x (the clock before it), final (the clock after it), broken (its sums passed their
    type), first (it is its trace's first), head (its first line is a header), unreadable (its trace is; false unless checked).

    `C` adds, `C=` sets, never backwards. With D the sum of additions, the clock is D + max(0, max(set value - D)): a block as a
    whole maps a clock x to A + max(x, M), and those maps are carried across blocks.
    """
    big = "decimal(38,0)"
    found = F.bool_or(F.coalesce(F.when(F.col("at") == 1, F.col("head")), F.lit(False)))
    totals = inside.groupBy("trace", "block").agg(F.max("at").alias("n"), F.max("d").cast(big).alias("a"), F.max("m").cast(big).alias("most"), F.bool_or(F.col("d").isNull()).alias("broken"), found.alias("head"), F.bool_or(F.col("issue").isNotNull()).alias("unfit"))
    by_block = Window.partitionBy("trace").orderBy("block")
    before, whole = by_block.rowsBetween(Window.unboundedPreceding, -1), by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast(big)
    carried = totals.withColumn("first", F.row_number().over(by_block) == 1).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")).withColumn("s", F.coalesce(F.try_sum("a").over(before).cast(big), zero))
    carried = carried.withColumn("x", F.col("s") + F.greatest(zero, F.coalesce(F.max(F.col("most") - F.col("s")).over(before), zero)))
    unreadable = F.max((F.col("first") & ~F.col("head")) | F.col("unfit")).over(whole) if checked else F.lit(False)
    return carried.select("trace", "block", "base", "x", (F.col("a") + F.greatest("x", F.coalesce("most", "x"))).alias("final"), "broken", "first", "head", unreadable.alias("unreadable"))


def clock_of(lines: DataFrame, kind: Numbers = LONG, needed: Column | None = None, in_lines: bool = True, checked: bool = False) -> tuple[DataFrame, DataFrame]:
    """numbered_lines and carried_blocks, written.

    An addition beyond the greatest number does not count, so order matters where one occurs: only if a trace's clock would
    pass it are lines searched for more refused additions than the sure ones, and placed again without these.
    """
    inside = written(numbered_lines(lines, kind, needed, in_lines, checked), "lines")
    blocks = written(carried_blocks(inside, checked), "clock")
    over = blocks.where("not unreadable").groupBy("trace").agg(F.max("final").alias("final"), F.bool_or("broken").alias("broken"))
    over = over.where(F.col("broken") | (F.col("final") > F.lit(Decimal(kind.most)))).select("trace")
    if over.isEmpty():
        return inside, blocks
    whole = written(numbered_lines(lines, kind, None if needed is None else needed | F.col("cmd").isin("C", "C="), in_lines, checked), "lines")
    own = whole.where("add is not null or set is not null").join(over, "trace", "left_semi").select("trace", "block", "at", "add", "set")
    gone = refused_additions(written(own, "clock"), kind.most).withColumn("_gone", F.lit(True))
    late = over.withColumn("_late", F.lit(True))
    marked = whole.join(gone, ["trace", "block", "at"], "left").join(late, "trace", "left").withColumn("refused", F.when(F.col("_late"), F.coalesce("_gone", F.lit(False))).otherwise(F.col("refused")))
    inside = written(placed_lines(marked).select(*LINE), "lines")
    return inside, written(carried_blocks(inside, checked), "clock")


def refused_additions(clock: DataFrame, most: int) -> DataFrame:
    """trace, block, at of the additions that would pass `most`, of clock lines (trace, block, at, add, set).

    The room left under `most` never grows. While it lies in [unit, 2 unit), unit a power of two, smaller additions than
    unit always fit and those from 2 unit on never do; one in between may fit, and then the room falls below
    unit. So a trace has at most 65 phases of one unit, each an ordinary scan with carry across blocks, and all traces
    take a phase at once.
    """
    big = "decimal(38,0)"
    lit = lambda v: F.lit(Decimal(v)).cast(big)
    room = lambda x: lit(most) - x
    unit_of = lambda x: F.array_max(F.filter(F.array(*[lit(1 << k) for k in range(65)]), lambda p: p <= room(x)))
    c = clock.select("trace", F.struct("block", "at").alias("place"), "block", F.col("add").cast(big).alias("add"), F.col("set").cast(big).alias("set"))
    start = F.struct(F.lit(-(1 << 62)).alias("block"), F.lit(0).alias("at"))
    state = c.select("trace").distinct().select("trace", start.alias("begin"), lit(0).alias("x")).withColumn("unit", unit_of(F.col("x")))
    phases = []
    own = Window.partitionBy("block", "trace").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("trace").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        state = written(state, "phase")
        if state.isEmpty():
            break
        rest = c.join(state, "trace").where(F.col("place") > F.col("begin"))
        rest = rest.withColumn("d", F.coalesce(F.sum(F.when(F.col("add") < F.col("unit"), F.col("add"))).over(own).cast(big), lit(0))).withColumn("m", F.max(F.col("set") - F.col("d")).over(own))
        totals = rest.groupBy("trace", "block").agg(F.max("d").alias("a"), F.max("m").alias("top"))
        totals = totals.withColumn("s", F.coalesce(F.sum("a").over(before).cast(big), lit(0))).withColumn("best", F.max(F.col("top") - F.col("s")).over(before)).select("trace", "block", "s", "best")
        x = F.col("s") + F.greatest(F.col("x"), F.coalesce("best", "x"))
        rest = rest.join(totals, ["trace", "block"]).withColumn("y", F.col("d") + F.greatest(x, F.coalesce("m", x)))
        fits = (F.col("add") >= F.col("unit")) & (F.col("add") <= room(F.col("y")))
        ends = rest.where(fits | (room(F.col("y")) < F.col("unit"))).groupBy("trace").agg(F.min(F.struct("place", (F.col("y") + F.when(fits, F.col("add")).otherwise(0)).cast(big).alias("x"), F.coalesce(fits, F.lit(False)).alias("fits"))).alias("end"))
        phase = written(state.select("trace", "begin", "unit").join(ends, "trace", "left"), "phase")
        phases.append(phase)
        # with no room left, only additions of nothing fit, and nothing sets the clock any more
        state = phase.where("end is not null").select("trace", F.col("end.place").alias("begin"), F.col("end.x").alias("x")).withColumn("unit", F.coalesce(unit_of(F.col("x")), lit(0)))
        full = written(state.where("unit = 0").select("trace", "begin", lit(1).alias("unit"), F.lit(None).cast(phase.schema["end"].dataType).alias("end")), "phase")
        phases.append(full)
        state = state.where("unit > 0")
    every = phases[0]
    for p in phases[1:]:
        every = every.unionByName(p)
    inside = (F.col("place") > F.col("begin")) & (F.col("end").isNull() | (F.col("place") <= F.col("end.place")))
    kept = (F.col("add") < F.col("unit")) | ((F.col("place") == F.col("end.place")) & F.col("end.fits"))
    return c.where("add is not null").join(every, "trace").where(inside & ~F.coalesce(kept, F.lit(False))).select("trace", "place.block", "place.at")


def parse(lines: DataFrame, sizes: DataFrame | None = None, max_op_bytes: int = OP_BYTES, wide: bool = False, symbol_limit: int = SYMBOL_LIMIT, only: Sequence[str] | None = None) -> Parsed:
    """The tables of lines (trace, block, pos, value). Lines of traces with a bad header should be left out before.

    wide: identifiers and cycles are unsigned 64-bit numbers, as DECIMAL(20, 0). symbol_limit: stage and lane names a
    trace has at most; a stage whose name or lane would be one more is refused. only: the names of the tables that will be
    asked for, so that lines which none of them needs are neither shuffled nor written.
    """
    return Parsed(lines, sizes, max_op_bytes, wide, symbol_limit, only)


#: The commands, besides the clock's, that a table is made of; rejects and traces need all lines. Those whose fields are read.
NEEDS = {"ops": ("I", "L", "R"), "stages": ("I", "L", "S", "E", "R"), "deps": ("I", "W"), "symbols": ("I", "S"), "counts": ("I", "R")}
READ = NEEDS | {"deps": ("W",), "symbols": ("S",), "counts": ("R",)}


class Parsed(Tables):
    """The tables of a log, each made when it is first asked for.

    What several tables use (the lines with their place and clock, the lines of operations with what begins and ends them,
    the names' first lines, the numbered operations) is written to the shared folder once it is needed; all else is lazy.
    Besides the tables there are counts (trace, count, flushed, first_cycle, last_cycle of each trace), unreadable
    (trace, line, reason of traces that were left out, None without any) and unread (the same with the lines' values).
    If checked, traces without a header, or with a line that isn't text or is too long, are left out.
    """

    def __init__(self, lines: DataFrame, sizes: DataFrame | None, max_op_bytes: int, wide: bool, symbol_limit: int, only: Sequence[str] | None, checked: bool = False) -> None:
        if only is not None and (unknown := set(only) - set(NEEDS) - {"rejects", "traces"}):
            raise ValueError(f"no tables {sorted(unknown)}")
        whole = only is None or not set(only) <= set(NEEDS)
        self.lines, self.sizes, self.checked = lines, sizes, checked
        self.kind, self.max_op_bytes, self.symbol_limit = WIDE if wide else LONG, max_op_bytes, symbol_limit
        self.commands = None if whole else sorted({c for t in only for c in NEEDS[t]})
        self.only, self.lazy = None if whole else set(only), only is not None

    # a table is not made for being shown or compared
    __repr__, __eq__, __hash__ = object.__repr__, object.__eq__, object.__hash__

    def _asked(self, table: str) -> None:
        if self.only is not None and table not in self.only:
            raise ValueError(f"{table} is not among the tables that were asked for")

    def _number(self, k: int) -> Column:
        return _number(F.get("parts", k), self.kind)

    @cached_property
    def _carried(self) -> tuple[DataFrame, DataFrame]:
        needed = None
        if self.only is not None:
            needed = F.col("cmd").isin(*self.commands)
            if not self.only >= {"ops", "stages"}:  # labels of operations or of stages only
                label = _number(F.get(F.split("value", "\t", -1), 2), self.kind)
                needed = needed & ((F.col("cmd") != "L") | F.coalesce(label <= 1 if "ops" in self.only else label == 2, F.lit(False)))
            if "counts" in self.only:
                needed = needed | (F.col("cmd") == "C=")
        return clock_of(self.lines, self.kind, needed, self.only is None or "ops" in self.only, self.checked)

    @cached_property
    def unreadable(self) -> DataFrame | None:
        """trace, line, reason of what makes a whole trace unreadable: its header, or a line that isn't text or is too long; or a file without lines."""
        if not self.checked:
            return None
        inside, blocks = self._carried
        bad = None
        gone = blocks.where("unreadable")
        if not gone.isEmpty():
            own = inside.join(shipped(gone.select("trace", "block", "base", (F.col("first") & ~F.col("head")).alias("headless"))), ["trace", "block"])
            headless = F.col("headless") & (F.col("at") == 1)
            bad = own.select("trace", (F.col("at") + F.col("base")).alias("line"), F.when(headless, "bad_header").otherwise(F.col("issue")).alias("reason")).where("reason is not null")
        if self.sizes is not None:
            empty = self.sizes.join(blocks.where("first").select("trace"), "trace", "left_anti").select("trace", F.lit(1).cast("long").alias("line"), F.lit("empty_file").alias("reason"))
            if not empty.isEmpty():
                bad = empty if bad is None else bad.unionByName(empty)
        return None if bad is None else written(bad, "bad-lines")

    @cached_property
    def unread(self) -> DataFrame | None:
        if self.unreadable is None:
            return None
        inside, blocks = self._carried
        at = blocks.where("unreadable").select("trace", "block", "base")
        kept = inside.where("issue is not null").join(shipped(at), ["trace", "block"]).select("trace", (F.col("at") + F.col("base")).alias("line"), F.left("value", F.lit(200)).alias("kept"))
        # a header's line has no issue of its own, and is looked up
        headless = self.unreadable.where("reason = 'bad_header'").select("trace")
        first = self.lines.join(headless, "trace", "left_semi").groupBy("trace").agg(F.min_by(F.left("value", F.lit(200)), F.struct("block", "pos")).alias("header"))
        each = self.unreadable.join(kept, ["trace", "line"], "left").join(first, "trace", "left")
        return each.select("trace", "line", "reason", F.when(F.col("reason") == "bad_header", F.col("header")).when(F.col("reason") == "empty_file", "").otherwise(F.col("kept")).alias("value"))

    @cached_property
    def _clock(self) -> DataFrame:
        """trace, line, value, cmd, set, refused, and cycle, the clock after the line. A trace's first line is its header."""
        inside, blocks = self._carried
        x = F.col("x").cast(self.kind.type)
        cycle = (F.col("d") + F.greatest(x, F.coalesce("m", x))).cast(self.kind.type)
        carried = shipped(blocks.where("not unreadable").select("trace", "block", "base", "x"))
        return inside.join(carried, ["trace", "block"]).select("trace", (F.col("at") + F.col("base")).alias("line"), "value", "cmd", "set", "refused", cycle.alias("cycle"))

    @cached_property
    def _events(self) -> DataFrame:
        own = self._clock.where(F.col("cmd").isin(*(self.commands or COMMANDS)) & (F.col("line") > 1)).withColumn("parts", F.split("value", "\t", -1))
        return own.withColumn("op_id", self._number(1))

    @cached_property
    def _last_cycle(self) -> DataFrame:
        return self._carried[1].where("not unreadable").groupBy("trace").agg(F.max("final").cast(self.kind.type).alias("last_cycle"))

    @cached_property
    def _placed(self) -> DataFrame:
        """Lines of operations with intro, the line that begins theirs (null before it), r_line, the one that ends it, good_r, bytes,
        and if all is asked for _large (the operation's texts pass the limit) and _stages (stages begun so far, if no name is one too many).

        All is told in one order of an operation's lines, which are dealt once.
        """
        cmd, two_numbers = F.col("cmd"), self._number(2).isNotNull() & self._number(3).isNotNull()
        good_i, good_r = (cmd == "I") & two_numbers, (cmd == "R") & self._number(2).isNotNull() & (self._number(3) <= 1)
        size = F.when((cmd == "L") & (self._number(2) <= 1), F.octet_length(label_text()))
        names = good_names(F.trim(F.get("parts", 2)), F.trim(F.get("parts", 3)))
        read = None if self.only is None else sorted({c for t in self.only for c in READ[t]})
        value = F.col("value") if read is None else F.when(cmd.isin(*read), F.col("value"))
        own = self._events.where("op_id is not null").select(
            *OP, "line", "cmd", "cycle", value.alias("value"), F.coalesce(good_i, F.lit(False)).alias("_good_i"), F.coalesce(good_r, F.lit(False)).alias("good_r"), size.alias("_size"), F.coalesce((cmd == "S") & names, F.lit(False)).alias("_good_s")
        )
        by_line = Window.partitionBy(*BY_OP).orderBy("line")
        so_far, whole = by_line.rowsBetween(Window.unboundedPreceding, 0), by_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        after = F.col("line") > F.col("intro")
        # bytes of the operation's label and detail so far: texts beyond the limit are never gathered
        shown = F.when(after, F.col("_size"))
        placed = own.withColumn("intro", F.min(F.when(F.col("_good_i"), F.col("line"))).over(so_far)).withColumns(
            {"r_line": F.min(F.when(F.col("good_r") & after, F.col("line"))).over(whole)}
            | ({} if self.only is not None and "ops" not in self.only else {"bytes": F.sum(shown).over(so_far)})
            | ({} if self.only is not None else {"_large": F.coalesce(F.sum(shown).over(whole) > self.max_op_bytes, F.lit(False)), "_stages": F.sum(F.when(F.col("_good_s") & after, 1).otherwise(0)).over(so_far)})
        )
        if "bytes" not in placed.columns:
            placed = placed.withColumn("bytes", F.lit(0).cast("long"))
        placed = placed.drop("_good_i", "_size", "_good_s")
        if self.only is None or len(self.only) > 1 or "stages" in self.only:
            placed = written(placed, "placed")  # one other table reads it once
        return placed.withColumn("parts", F.split("value", "\t", -1))  # split anew rather than dealt and stored

    @cached_property
    def _named(self) -> tuple[DataFrame, DataFrame, bool]:
        """The names' first lines, the lines behind their operation's beginning with _over, and whether any is over."""
        live = self._placed.where(F.col("line") > F.col("intro")).withColumn("lane", F.trim(F.get("parts", 2))).withColumn("name", F.trim(F.get("parts", 3)))
        names = written(first_lines(live), "names")
        live = live.withColumn("_over", F.lit(False))
        crowded = names.groupBy("trace").agg(F.count("*").alias("n")).where(F.col("n") > self.symbol_limit).select("trace")
        return (*admitted(names, live, crowded, self.symbol_limit), True) if not crowded.isEmpty() else (names, live, False)

    @cached_property
    def _marked_ops(self) -> DataFrame:
        """ops. All of an operation is gathered by a single grouping, which the window's shuffle already serves if it isn't written."""
        kind, number = self.kind, self._number
        text = label_text()
        after = F.col("line") > F.col("intro")
        with_text = self.only is None or "ops" in self.only
        pieces = lambda k: F.collect_list(F.when(after & (F.col("cmd") == "L") & (number(2) == k) & (F.col("bytes") <= self.max_op_bytes), F.struct("line", text.alias("text"))))
        joined = lambda k: F.array_join(F.transform(F.array_sort(pieces(k)), lambda x: x["text"]), "") if with_text else F.lit("")
        wanted = F.col("cmd").isin("I", "L", "R") if with_text else F.col("cmd").isin("I", "R")
        gathered = self._placed.where((F.col("line") >= F.col("intro")) & wanted).groupBy(*BY_OP).agg(
            F.min_by(F.struct(number(2).alias("gid"), number(3).alias("tid"), F.col("cycle").alias("fetch_cycle"), "line"), F.when(~after, F.col("line"))).alias("i"),
            F.min_by(F.struct(number(2).alias("rid"), F.col("cycle").alias("r_cycle"), (number(3) == 1).alias("r_flushed")), F.when(after & F.col("good_r"), F.col("line"))).alias("r"),
            joined(0).alias("label"), joined(1).alias("detail"), F.coalesce(F.max("bytes") > self.max_op_bytes, F.lit(False)).alias("_large"),
        )
        gathered = gathered.select(*OP, "i.*", "r.*", "label", "detail", "_large")
        shown = lambda c: F.when(F.col("_large"), "").otherwise(unescaped(F.col(c))).alias(c)
        ops = gathered.join(F.broadcast(self._last_cycle), "trace").select(
            *OP, "gid", "tid", "rid", "fetch_cycle", F.coalesce("r_cycle", (F.least("last_cycle", kind.lit(kind.most - 1)) + 1).cast(kind.type)).alias("end_cycle"), F.coalesce("r_flushed", F.lit(False)).alias("flushed"), F.col("rid").isNull().alias("incomplete"), "line", shown("label"), shown("detail")
        )
        ops = written(ops, "ops")  # its numbering reads it twice
        numbered_ops = with_rows(ops)
        return numbered_ops if self.only is not None and self.only <= {"ops", "counts"} else written(numbered_ops, "ops")

    @cached_property
    def ops(self) -> DataFrame:
        self._asked("ops")
        return self._marked_ops

    @cached_property
    def stages(self) -> DataFrame:
        """An E sets the end of the latest S of its lane and name, over what a later S of the lane or R would; so does a label its text."""
        self._asked("stages")
        cmd, live = F.col("cmd"), self._named[1]
        is_s, is_e, is_l = cmd == "S", cmd == "E", cmd == "L"
        good_s = is_s & good_names(F.col("lane"), F.col("name")) & ~F.col("_over")
        marks = live.where(good_s | (is_e & F.get("parts", 3).isNotNull()) | (is_l & (self._number(2) == 2)))
        marks = marks.select(*OP, "line", "cmd", "cycle", "r_line", F.when(~is_l, F.col("lane")).alias("lane"), F.when(~is_l, F.col("name")).alias("name"), F.when(is_l, label_text()).alias("text"))
        so_far = Window.partitionBy(*BY_OP).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        last = F.last(F.when(is_s, F.struct("lane", "name")), ignorenulls=True).over(so_far)
        marks = marks.withColumns({"stage": F.sum(F.when(is_s, 1).otherwise(0)).over(so_far) - 1, "_last": last})
        # a label of the latest stage belongs to that stage's run of its lane and name, up to the next one
        own = lambda c: F.when(is_l, F.col("_last")[c]).otherwise(F.col(c)).alias(c)
        marks = marks.select(*OP, "line", "cmd", "cycle", "r_line", "stage", "text", own("lane"), own("name"))
        same = Window.partitionBy(*BY_OP, "lane", "name").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        marks = marks.withColumn("run", F.sum(F.when(is_s, 1).otherwise(0)).over(same)).where("run > 0")
        of_s = lambda c: F.max(F.when(is_s, F.col(c))).alias(c)
        s = marks.groupBy(*BY_OP, "lane", "name", "run").agg(
            of_s("line"), of_s("cycle"), of_s("stage"), F.max("r_line").alias("r_line"), F.max_by(F.when(is_e, F.col("cycle")), F.when(is_e, F.col("line"))).alias("e_cycle"), F.collect_list(F.when(is_l, F.struct("line", "text"))).alias("x")
        )
        glued = F.aggregate(F.array_sort("x"), F.lit(""), lambda a, x: F.when(a == "", x["text"]).otherwise(F.concat(a, F.lit("\n"), x["text"])))
        s = s.withColumn("labels", unescaped(glued)).drop("x")
        of_lane = Window.partitionBy(*BY_OP, "lane").orderBy("line")
        s = s.withColumns({"next_start": F.lead("cycle").over(of_lane), "next_line": F.lead("line").over(of_lane), "first_of_lane": F.min("stage").over(of_lane.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
        s = s.withColumn("lane_index", F.dense_rank().over(Window.partitionBy(*BY_OP).orderBy("first_of_lane")) - 1).withColumn("lane_count", F.max("lane_index").over(Window.partitionBy(*BY_OP)) + 1)
        s = s.join(self._marked_ops.select(*OP, "row_idx", "tid", "gid", "rid", "flushed", "incomplete", F.col("end_cycle").alias("op_end")), OP)
        closed_by_r = (F.col("r_line") > F.col("line")) & (F.col("next_line").isNull() | (F.col("r_line") < F.col("next_line")))
        end = F.coalesce("e_cycle", F.when(closed_by_r, F.col("op_end")).otherwise(F.col("next_start")), F.when(F.col("r_line").isNull(), F.col("op_end")))
        s = s.withColumn("end_cycle", end)
        is_open = F.col("end_cycle").isNull() | (F.col("incomplete") & (F.col("end_cycle") == F.col("op_end")))
        return s.select("trace", "op_id", "row_idx", "tid", "gid", "rid", "flushed", "incomplete", F.col("stage").cast("int").alias("stage"), "lane", "name", F.col("lane_index").cast("int").alias("lane_index"), F.col("lane_count").cast("int").alias("lane_count"), F.col("cycle").alias("start_cycle"), "end_cycle", "labels", is_open.alias("open"))

    @cached_property
    def deps(self) -> DataFrame:
        self._asked("deps")
        w = self._placed.where((F.col("line") > F.col("intro")) & (F.col("cmd") == "W") & self._number(2).isNotNull() & self._number(3).isNotNull())
        by_line = Window.partitionBy(*BY_OP).orderBy("line")
        return w.select(*OP, (F.row_number().over(by_line) - 1).alias("seq"), self._number(2).alias("producer"), self._number(3).alias("kind"), "cycle")

    @cached_property
    def symbols(self) -> DataFrame:
        """At most symbol_limit names a trace."""
        self._asked("symbols")
        return self._named[0].select("trace", (F.row_number().over(Window.partitionBy("trace").orderBy("first")) - 1).alias("symbol_id"), "name")

    @cached_property
    def _refused(self) -> DataFrame:
        """Refused lines; written if all tables may be asked for, as both rejects and traces read them."""
        names, live, over = self._named
        found = rejects(self._clock, self._placed, live if over else None, names, self.kind)
        return found if self.lazy else written(found, "refused")

    @cached_property
    def rejects(self) -> DataFrame:
        self._asked("rejects")
        return self._refused if self.unread is None else self._refused.unionByName(self.unread)

    @cached_property
    def counts(self) -> DataFrame:
        self._asked("counts")
        if "_marked_ops" in self.__dict__:
            return counted(self._clock, self._marked_ops, self._last_cycle)
        # an operation counts once it is begun, and is flushed if the first line that ends it says so
        last = F.min_by(self._number(3) == 1, F.when(F.col("good_r") & (F.col("line") == F.col("r_line")), F.col("line")))
        own = self._placed.where((F.col("line") >= F.col("intro")) & F.col("cmd").isin("I", "R")).groupBy(*BY_OP).agg(F.min("intro").alias("line"), F.coalesce(last, F.lit(False)).alias("flushed"))
        return counted(self._clock, own, self._last_cycle)

    @cached_property
    def traces(self) -> DataFrame:
        self._asked("traces")
        found = self._refused.select("trace", "line", "reason")
        return trace_info(self.counts, self.symbols, written(found, "refused") if self.lazy else found, self.sizes)


def shipped(blocks: DataFrame) -> DataFrame:
    """A row a block, sent to every task if they are few; then it is met where the lines lie."""
    return F.broadcast(blocks) if blocks.limit(BLOCKS + 1).count() <= BLOCKS else blocks


def good_names(lane: Column, name: Column) -> Column:
    return name.isNotNull() & (F.octet_length(lane) <= NAME_LIMIT) & (F.octet_length(name) <= NAME_LIMIT)


def label_text() -> Column:
    """An L line's text, tabs included; empty if the line ends before it."""
    return F.coalesce(F.get(F.split("value", "\t", 4), 3), F.lit(""))


def first_lines(live: DataFrame) -> DataFrame:
    """trace, name, first (line, and 0 for a lane or 1 for a stage's name) of the names that S lines give.

    A line's lane comes first; a lane that is too long refuses the line before its name is seen.
    """
    fits = lambda c: F.octet_length(c) <= NAME_LIMIT
    own = live.where((F.col("cmd") == "S") & F.get("parts", 3).isNotNull() & fits("lane"))
    # as one number, which groups hash
    each = own.select("trace", F.explode(F.array(F.struct((F.col("line") * 2).alias("first"), F.col("lane").alias("name")), F.when(fits("name"), F.struct((F.col("line") * 2 + 1).alias("first"), F.col("name"))))).alias("x")).where("x is not null")
    first = each.groupBy("trace", F.col("x.name").alias("name")).agg(F.min("x.first").alias("_first"))
    return first.select("trace", "name", F.struct(F.shiftright("_first", 1).alias("line"), F.col("_first").bitwiseAND(1).cast("int").alias("k")).alias("first"))


def admitted(names: DataFrame, live: DataFrame, crowded: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The names of which each trace has at most `limit`, and live with _over on the S lines that were refused for that.

    Until a trace has its last name every name that fits is taken, so the first ones by line are those that stay; from then on
    a line is refused if one of its names isn't among them. In traces with too many names, names are numbered by a distributed sort.
    """
    many = names.join(crowded, "trace", "left_semi").select("trace", "name", "first", F.col("first.line").alias("line"), F.col("first.k").alias("k"))
    numbered_names = numbered_by_ranges(many, ["trace"], ["line", "k"], "symbol_id")
    out = written(numbered_names.where(F.col("symbol_id") >= limit).select("trace", "name"), "names")
    own = live.where((F.col("cmd") == "S") & F.get("parts", 3).isNotNull() & (F.octet_length("lane") <= NAME_LIMIT)).select("trace", "line", F.explode(F.array_distinct(F.array("lane", "name"))).alias("name"))
    gone = own.join(out, ["trace", "name"], "left_semi").select("trace", "line").distinct().withColumn("_gone", F.lit(True))
    marked = live.join(gone, ["trace", "line"], "left").withColumn("_over", F.coalesce("_gone", F.lit(False))).drop("_gone")
    return written(names.join(out, ["trace", "name"], "left_anti"), "names"), written(marked.drop("parts"), "live").withColumn("parts", F.split("value", "\t", -1))


def rejects(clock: DataFrame, placed: DataFrame, over: DataFrame | None, names: DataFrame, kind: Numbers = LONG) -> DataFrame:
    """trace, line, reason, value of what was left out; a line can have two reasons.

    Reasons that a line tells by itself are found in the clock's lines, all others in one reading of the operations' lines,
    which needs no shuffle: what stands before a line was counted when they were placed. Only if a trace has too many names
    (over: the lines behind their operation's beginning with _over) are stages counted again without the refused ones.
    """
    p = lambda k: F.get("parts", k)
    number, too_large = partial(_number, kind=kind), partial(_too_large, kind=kind)
    arg = F.when(too_large(p(1)), "out_of_range").when(number(p(1)).isNull(), "invalid_number")
    resource = (F.size("parts") == 1) & F.contains("cmd", F.lit("="))
    outer = F.when(F.col("cmd").isin("C", "C="), F.coalesce(arg, F.when(F.col("refused"), "out_of_range").when(F.col("set") < F.col("cycle"), "backwards")))
    outer = outer.when((F.col("cmd") == "") | resource, F.lit(None)).when(F.col("cmd").isin(*COMMANDS), arg).otherwise("unknown_command")
    first = clock.where("line > 1").withColumn("parts", F.split("value", "\t", -1)).select("trace", "line", outer.alias("reason"), "value").where("reason is not null")
    if over is None:
        lines = placed.withColumn("_over", F.lit(False))
    else:
        good_s = (F.col("cmd") == "S") & good_names(F.col("lane"), F.col("name")) & ~F.col("_over")
        begun = F.sum(F.when(good_s, 1).otherwise(0)).over(Window.partitionBy(*BY_OP).orderBy("line"))
        early = placed.where("intro is null or line <= intro").withColumn("_over", F.lit(False))
        lines = early.unionByName(over.withColumn("_stages", begun).select(*early.columns))
    cmd, live = F.col("cmd"), F.col("line") > F.col("intro")
    # each field is read once
    lines = lines.withColumns({"p2": p(2), "p3": p(3)}).withColumns({
        "lane": F.trim("p2"), "name": F.trim("p3"), "n2": F.when(cmd.isin("I", "L", "R", "W"), number(F.col("p2"))), "n3": F.when(cmd.isin("I", "R", "W"), number(F.col("p3"))),
    })
    lane, name, n2, n3 = (F.col(c) for c in ("lane", "name", "n2", "n3"))
    big = lambda n, p: n.isNull() & too_large(F.col(p))
    numbers = F.when(n2.isNull() | n3.isNull(), F.when(big(n2, "p2") | big(n3, "p3"), "out_of_range").otherwise("invalid_number"))
    second = F.when(F.col("intro").isNull() | (F.col("line") < F.col("intro")), F.when(cmd == "I", numbers).otherwise("unknown_operation"))
    late = F.when(live & (F.col("line") > F.col("r_line")) & ~cmd.isin("L", "I"), "after_retirement")
    of_l = F.when(n2.isNull(), F.when(too_large(F.col("p2")), "out_of_range").otherwise("invalid_number")).when(n2 > 2, "unknown_label_kind").when((n2 == 2) & (F.col("_stages") == 0), "label_without_stage")
    of_s = F.when(lane.isNull(), "missing_lane").when(name.isNull(), "missing_stage").when((F.octet_length(lane) > NAME_LIMIT) | (F.octet_length(name) > NAME_LIMIT), "symbol_too_long").when(F.col("_over"), "symbol_limit")
    of_r = F.when(F.col("line") > F.col("r_line"), "already_retired").otherwise(F.coalesce(numbers, F.when(n3 > 1, "invalid_status")))
    of_e = F.when(lane.isNull(), "missing_lane").when(name.isNull(), "missing_stage")
    of_w = F.coalesce(numbers, F.when(n2 > F.col("op_id"), "future_producer"))
    inner = F.when(live, F.when(cmd == "I", "redefined").when(cmd == "L", of_l).when(cmd == "S", of_s).when(cmd == "R", of_r).when(cmd == "E", of_e).when(cmd == "W", of_w))
    large = F.when((F.col("line") == F.col("intro")) & F.col("_large"), "operation_too_large")
    found = F.array(F.coalesce(second, inner, large), late)
    found = lines.select("trace", "line", F.explode(found).alias("reason"), "value").where("reason is not null")
    # an end mark needs its lane and name to be known before, by whatever role
    known = names.select("trace", "name", F.col("first.line").alias("since"))
    ends = placed.where(live & (cmd == "E")).select("trace", "line", "value", F.trim(p(2)).alias("lane"), F.trim(p(3)).alias("name")).where("name is not null")
    ends = ends.join(known.select("trace", F.col("name").alias("lane"), F.col("since").alias("lane_since")), ["trace", "lane"], "left").join(known, ["trace", "name"], "left")
    unknown = F.when(F.col("lane_since").isNull() | (F.col("lane_since") > F.col("line")), "unknown_lane").when(F.col("since").isNull() | (F.col("since") > F.col("line")), "unknown_stage")
    return first.unionAll(found).unionAll(ends.select("trace", "line", unknown.alias("reason"), "value").where("reason is not null"))


def counted(clock: DataFrame, ops: DataFrame, last_cycle: DataFrame) -> DataFrame:
    """trace, count, flushed, first_cycle, last_cycle of each trace with lines; ops needs trace, line and flushed."""
    own = ops.groupBy("trace").agg(F.count("*").alias("count"), F.count_if("flushed").alias("flushed"), F.min("line").alias("first_i"))
    sets = clock.where((F.col("set") == F.col("cycle")) & F.col("set").isNotNull()).join(F.broadcast(own.select("trace", "first_i")), "trace", "left").where(F.col("first_i").isNull() | (F.col("line") < F.col("first_i")))
    first = sets.groupBy("trace").agg(F.max_by("cycle", "line").alias("first_cycle"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return last_cycle.join(own, "trace", "left").join(first, "trace", "left").select("trace", zero("count", "long"), zero("flushed", "long"), zero("first_cycle", last_cycle.schema["last_cycle"].dataType), "last_cycle")


def trace_info(counts: DataFrame, symbols: DataFrame, found: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """One row a trace: counts, cycles, the first warnings, symbols, bytes."""
    order = Window.partitionBy("trace").orderBy("line", "reason")
    warned = found.groupBy("trace").agg(F.count("*").alias("warning_count"))
    shown = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= WARNINGS).groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("_n", F.concat(F.lit("Line "), F.col("line").cast("string"), F.lit(": "), "reason").alias("w")))).alias("x"))
    shown = shown.select("trace", F.transform("x", lambda x: x["w"]).alias("warnings"))
    named = symbols.groupBy("trace").agg(F.transform(F.array_sort(F.collect_list(F.struct("symbol_id", "name"))), lambda x: x["name"]).alias("symbols"))
    none = F.array().cast("array<string>")
    out = counts.join(warned, "trace", "left").join(shown, "trace", "left").join(named, "trace", "left")
    out = out.join(sizes, "trace", "left") if sizes is not None else out.withColumn("bytes", F.lit(None).cast("long"))
    return out.select("trace", "count", "flushed", "first_cycle", "last_cycle", F.coalesce("warning_count", F.lit(0)).cast("long").alias("warning_count"), F.coalesce("warnings", none).alias("warnings"), F.coalesce("symbols", none).alias("symbols"), "bytes", F.lit(True).alias("complete"))


def ingest_lines(lines: DataFrame, on_bad: str = "error", sizes: DataFrame | None = None, wide: bool = False, only: Sequence[str] | None = None) -> Parsed:
    """parse, after traces that can't be read raise ValueError or, with on_bad='reject', become rejects only.

    With sizes (trace, bytes of every file), a file without any line is one that can't be read.
    """
    if on_bad not in ("error", "reject"):
        raise ValueError("on_bad is error or reject")
    parsed = Parsed(lines, sizes, OP_BYTES, wide, SYMBOL_LIMIT, only, checked=True)
    if parsed.unreadable is not None and on_bad == "error":
        worst = parsed.unreadable.orderBy("trace", "line").first()
        raise ValueError(f"{worst['trace']}, line {worst['line']}: {worst['reason']}")
    return parsed


def ingest(spark: SparkSession, paths: str | Sequence[str], on_bad: str = "error", wide: bool = False, range_bytes: int | None = None, only: Sequence[str] | None = None) -> Parsed:
    """The tables of trace files, a trace for each. A file without any line can't be read. range_bytes as for read_lines, only as for parse."""
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    sizes = files.select(F.col("_metadata.file_path").alias("trace"), F.col("length").alias("bytes"))
    # a reader leaves out files of no bytes, so names come from the listing that the driver has made for it; paths without
    # an authority may have one slash or three
    plain = lambda c: F.regexp_replace(c, r"\A([A-Za-z0-9+.-]+):///", "$1:/")
    named = spark.createDataFrame([(f,) for f in files.inputFiles()], "file string").join(sizes.withColumn("path", plain("trace")), plain("file") == F.col("path"), "left")
    return ingest_lines(read_lines(spark, paths, range_bytes), on_bad, named.select(F.coalesce("trace", "file").alias("trace"), "bytes"), wide, only)
