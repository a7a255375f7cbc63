"""Text search over operations with typed filters, and snippets of what matched."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import literal_regex, user_regex
from ..schemas import Tables
from .scan import numbered

Range = tuple[int | None, int | None]
#: Bytes of text around a match that a snippet shows, before and after.
BEFORE, AFTER = 40, 60


def within(column: Column, bounds: Range | None) -> Column:
    """Inclusive bounds, each of which may be missing; null passes only without bounds."""
    if bounds is None or bounds == (None, None):
        return F.lit(True)
    low, high = bounds
    test = F.lit(True)
    if low is not None:
        test &= column >= low
    if high is not None:
        test &= column <= high
    return test


def status_filter(status: str) -> Column:
    known = {"": F.lit(True), "all": F.lit(True), "retired": F.col("rid").isNotNull() & ~F.col("flushed"), "flushed": F.col("flushed"), "incomplete": F.col("incomplete")}
    return known.get(status, F.lit(False))


def search(tables: Tables, text: str = "", regex: bool = False, case_sensitive: bool = False, op: Range | None = None, gid: Range | None = None, tid: Range | None = None, rid: Range | None = None, cycles: Range | None = None, stage: str = "", status: str = "all") -> DataFrame:
    """Operations that pass all filters and, unless text is empty, hold it in a label, detail, stage name or stage label.

    Returns the operations' columns with hit_idx, in row order. An unknown status finds nothing.
    """
    own = within(F.col("op_id"), op) & within(F.col("gid"), gid) & within(F.col("tid"), tid) & within(F.col("rid"), rid) & status_filter(status)
    if cycles is not None:
        own &= within(F.coalesce("end_cycle", "fetch_cycle"), (cycles[0], None)) & within(F.col("fetch_cycle"), (None, cycles[1]))
    found = tables.ops.where(own)
    if stage:
        named = tables.stages.where(F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") == re.sub("[A-Z]", lambda m: m[0].lower(), stage))
        found = found.join(named.select("trace", "op_id").distinct(), ["trace", "op_id"], "left_semi")
    if text:
        pattern = pattern_of(text, regex, case_sensitive)
        held = tables.stages.where(F.col("name").rlike(pattern) | F.col("labels").rlike(pattern)).select("trace", "op_id", F.lit(True).alias("_in_stage")).distinct()
        found = found.join(held, ["trace", "op_id"], "left").where(F.col("label").rlike(pattern) | F.col("detail").rlike(pattern) | F.col("_in_stage")).drop("_in_stage")
    return numbered(found, ["trace"], ["row_idx"], "hit_idx")


def pattern_of(text: str, regex: bool = False, case_sensitive: bool = False) -> str:
    return user_regex(text, case_sensitive) if regex else literal_regex(text, case_sensitive)


def snippets(hits: DataFrame, tables: Tables, text: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """trace, op_id, seq, snippet of the hits: a row for each field that matched, in the order label, detail, stages.

    Where a match begins and ends comes from the same expression that found it; a snippet runs 40
    bytes to the left and 60 to the right of it, then on to whole characters.
    """
    pattern = pattern_of(text, regex, case_sensitive)
    key = ["trace", "op_id"]
    own = hits.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit("Disassembly").alias("field"), F.col("label").alias("value")), F.struct(F.lit(1).alias("seq"), F.lit("Metadata").alias("field"), F.col("detail").alias("value")))).alias("f"))
    stages = tables.stages.join(hits.select(*key), key, "left_semi")
    of_stage = stages.select(*key, F.explode(F.array(F.struct((F.col("stage") * 2 + 2).alias("seq"), F.lit("Stage").alias("field"), F.col("name").alias("value")), F.struct((F.col("stage") * 2 + 3).alias("seq"), F.lit("Stage metadata").alias("field"), F.col("labels").alias("value")))).alias("f"))
    fields = own.unionByName(of_stage).select(*key, "f.*").where(F.col("value").rlike(pattern))
    match = F.regexp_substr("value", F.lit(pattern))
    before = F.regexp_extract("value", rf"\A((?s:.*?))(?:{pattern})", 1)
    return fields.select(*key, "seq", cut(F.col("field"), F.col("value"), before, F.coalesce(match, F.lit(""))).alias("snippet"))


def cut(field: Column, value: Column, before: Column, match: Column) -> Column:
    """field, and value's bytes from 40 before the match to 60 behind it, widened to whole characters."""
    raw = F.encode(value, "UTF-8")
    inner = lambda i: F.hex(F.substring(raw, i + 1, F.lit(1))).between("80", "BF")  # noqa: E731  a byte within a character
    low = F.greatest(F.octet_length(before) - BEFORE, F.lit(0))
    high = F.least(F.octet_length(before) + F.octet_length(match) + AFTER, F.octet_length(value))
    # a character has four bytes at most
    start = F.when(~inner(low), low).when(~inner(low - 1), low - 1).when(~inner(low - 2), low - 2).otherwise(low - 3)
    stop = F.when(~inner(high), high).when(~inner(high + 1), high + 1).when(~inner(high + 2), high + 2).otherwise(high + 3)
    return F.concat(field, F.lit(": "), F.decode(F.substring(raw, start + 1, stop - start), "UTF-8"))
