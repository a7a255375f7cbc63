"""The registered queries in DuckDB's SQL, written from the tables' meaning, not from the plans."""

from __future__ import annotations

EVENTS = """
ev AS (SELECT event_id AS op_id, user_id AS tid, event_id % 2 AS parity, event_type AS name, epoch_us(ts) AS start_cycle,
         lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS end_cycle, row_number() OVER (ORDER BY event_id) - 1 AS row_idx,
         CASE WHEN event_type <> 'error' THEN event_id END AS rid, event_type = 'signup' AS flushed, event_type = 'error' AS incomplete,
         event_type || ' value=' || CAST(floor(value) AS BIGINT) AS label, 'props ' || coalesce(props, '') || chr(10) || 'user=' || user_id AS detail
       FROM events WHERE event_id IS NOT NULL),
info AS (SELECT max(greatest(start_cycle, coalesce(end_cycle, start_cycle))) AS last_cycle, count(*) AS n FROM ev)"""
ORDERS = """
st0 AS (SELECT l_orderkey AS op_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS stage,
          l_linestatus AS lane, l_returnflag AS name, datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS start_cycle,
          CASE WHEN l_quantity >= 2 THEN datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + CAST(floor(l_quantity) AS BIGINT) END AS end_cycle, 'part=' || l_partkey AS labels FROM lineitem),
op AS (SELECT o_orderkey AS op_id, o_custkey AS gid, o_orderkey % 8 AS tid, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey END AS rid, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS fetch_cycle,
         (SELECT max(coalesce(s.end_cycle, s.start_cycle)) FROM st0 s WHERE s.op_id = o_orderkey) AS end_cycle, o_orderstatus = 'F' AS flushed, o_orderstatus = 'O' AS incomplete, o_orderpriority AS label,
         'status=' || o_orderstatus || chr(10) || 'price=' || CAST(floor(o_totalprice) AS BIGINT) AS detail, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders),
st AS (SELECT st0.*, op.row_idx, op.tid, op.gid, op.rid, op.flushed, op.incomplete, op.label, op.detail FROM st0 JOIN op USING (op_id)),
info AS (SELECT greatest((SELECT max(greatest(fetch_cycle, coalesce(end_cycle, fetch_cycle))) FROM op), (SELECT max(greatest(start_cycle, coalesce(end_cycle, start_cycle))) FROM st)) AS last_cycle)"""
TALKS = """
tk AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS op_id, conv_id AS tid, coalesce(x.text, '') AS detail, coalesce(x.role, '') AS name, split_part(coalesce(x.text, ''), chr(10), 1) AS label,
         row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_idx
       FROM (SELECT conv_id, turn, min({'role': role, 'text': text}) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn))"""


def hits(view: str, where: str, cycle: str = "start_cycle") -> str:
    """Matched stages of V1 (ev) or V2 (st)."""
    if view == "ev":
        cols, head = "op_id, row_idx, 0 AS stage, name, CAST(parity AS VARCHAR) AS lane", EVENTS
    else:
        cols, head = "op_id, row_idx, stage, name, lane", ORDERS
    known = " AND end_cycle IS NOT NULL" if cycle == "end_cycle" else ""
    return f"""WITH {head} SELECT op_id, row_idx, CAST(stage AS INTEGER) AS stage, name, lane, {cycle} AS cycle, coalesce(end_cycle, last_cycle + 1) - start_cycle AS elapsed,
               row_number() OVER (ORDER BY row_idx, stage) - 1 AS hit_idx FROM (SELECT {cols}, start_cycle, end_cycle, last_cycle FROM {view}, info WHERE ({where}){known})"""


def pairs(skip: int = 0, where: str = "true", head: str = "WITH", tail: str = "SELECT s_op_id, t_op_id, s_row_idx, t_row_idx, s_cycle, t_cycle, elapsed, hit_idx FROM pr") -> str:
    """Errors' ends with the user's later purchases: the one before which `skip` others lie."""
    return f"""{head} {EVENTS},
    src AS (SELECT op_id, row_idx, tid, end_cycle AS cycle FROM ev WHERE name = 'error' AND end_cycle IS NOT NULL),
    tgt AS (SELECT op_id, row_idx, tid, start_cycle AS cycle, row_number() OVER (PARTITION BY tid ORDER BY row_idx) AS k FROM ev WHERE name = 'purchase'),
    nx AS (SELECT src.*, (SELECT count(*) FROM tgt WHERE tgt.tid = src.tid AND tgt.row_idx <= src.row_idx) AS seen FROM src),
    pr0 AS (SELECT nx.op_id AS s_op_id, tgt.op_id AS t_op_id, nx.row_idx AS s_row_idx, tgt.row_idx AS t_row_idx, nx.cycle AS s_cycle, tgt.cycle AS t_cycle, tgt.cycle - nx.cycle AS elapsed
            FROM nx JOIN tgt ON tgt.tid = nx.tid AND tgt.k = nx.seen + 1 + {skip}),
    pr AS (SELECT *, row_number() OVER (ORDER BY s_row_idx) - 1 AS hit_idx FROM pr0 WHERE {where})
    {tail}"""


INSIDE = "x.start_cycle > least(s_cycle, t_cycle) AND x.start_cycle < greatest(s_cycle, t_cycle)"
BETWEEN = " AND x.row_idx > least(s_row_idx, t_row_idx) AND x.row_idx < greatest(s_row_idx, t_row_idx)"
NO_NEW = f"NOT EXISTS (SELECT 1 FROM ev x WHERE x.name = 'signup' AND x.tid < 3 AND {INSIDE}"
NO_LONG = f"NOT EXISTS (SELECT 1 FROM st x, info WHERE x.name = 'A' AND coalesce(x.end_cycle, last_cycle + 1) - x.start_cycle >= 45 AND {INSIDE}"
BOX = "SELECT hit_idx, least(s_cycle, t_cycle) AS cycle_start, greatest(s_cycle, t_cycle) AS cycle_end, {a} AS row_start, {b} AS row_end FROM pr, info"
LONG = hits("st", "lower(name) = 'r' AND coalesce(end_cycle, last_cycle + 1) - start_cycle >= 30")
#: The log of the events: each event at its time, its end one cycle later, a producer before it.
LOG = """WITH ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t, row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM events WHERE event_id IS NOT NULL),
clock AS (SELECT *, max(t + 0) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM ev)"""

FILES = """ SELECT event_id // 4096 + 1 AS block, event_id AS op_id, user_id AS gid, user_id % 16 AS tid, t AS fetch_cycle, event_type AS label, 'user=' || user_id AS detail,
    row_number() OVER (PARTITION BY event_id // 4096 ORDER BY event_id) - 1 AS row_idx FROM clock"""
#: The log of the orders: the clock is set by each order, never back, and each line adds 3 to it.
ORDER_LOG = """WITH o AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus = 'O' AS is_open, o_orderstatus = 'F' AS flushed, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 10 AS v,
         o_orderpriority || '\\nclerk' || chr(9) || o_orderkey AS raw, coalesce(n, 0) AS n, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
d AS (SELECT *, CAST(3 * (sum(n) OVER (ORDER BY k) - n) AS BIGINT) AS before FROM o),
c AS (SELECT *, before + greatest(max(v - before) OVER (ORDER BY k), 0) AS c FROM d),
info AS (SELECT max(c + 3 * n) AS last_cycle FROM c),
op AS (SELECT c.*, CASE WHEN is_open THEN last_cycle + 1 ELSE c + 3 * n END AS op_end FROM c, info),
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS i FROM lineitem),
st AS (SELECT k, row_idx, i, l_linestatus AS lane, l_returnflag AS name, l_partkey, l_suppkey, l_linenumber, c + 3 * i AS start_cycle, 'part=' || l_partkey || chr(10) || 'line' || chr(10) || CASE WHEN l_partkey % 17 = 0 THEN chr(10) ELSE '' END || 'number=' || l_linenumber AS labels,
         CASE WHEN l_quantity < 10 THEN c + 3 * i + 3 WHEN l_quantity < 25 THEN c + 3 * i + 1 ELSE coalesce(c + 3 * lead(i) OVER (PARTITION BY k, l_linestatus ORDER BY i), op_end) END AS end_cycle
       FROM li JOIN op ON k = l_orderkey)"""
#: The log with numbers from 2**63 on: one stage an order, each adds 3 to the clock.
WIDE_LOG = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS name, o_custkey, 9223372036854775808::HUGEINT + o_orderkey AS id, 9223372036854775808::HUGEINT + datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 10 AS v,
         row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders),
c AS (SELECT *, 3 * row_idx + greatest(max(v - 3 * row_idx) OVER (ORDER BY k), 0) AS c FROM o),
info AS (SELECT max(c) + 3 AS last_cycle, min(c) AS c0, count(*) AS n FROM c),
op AS (SELECT c.*, k % 3 <> 0 AS retired, CASE WHEN k % 3 <> 0 THEN c + 3 ELSE last_cycle + 1 END AS op_end, CASE WHEN k % 3 <> 0 OR name <> 'O' THEN c + 3 ELSE last_cycle + 1 END AS end_cycle FROM c, info)"""
NAMES = """sy0 AS (SELECT name, min(p) AS p FROM (SELECT lane AS name, (row_idx * 1000 + i) * 2 AS p FROM st UNION ALL SELECT name, (row_idx * 1000 + i) * 2 + 1 FROM st) GROUP BY name),
sy AS (SELECT name, row_number() OVER (ORDER BY p) - 1 AS symbol_id FROM sy0)"""
REFUSED = "refused AS ({})".format(
    " UNION ALL ".join(
        f"SELECT '{reason}' AS reason, count(*) AS n FROM {view} WHERE {where}"
        for reason, view, where in (
            ("backwards", "op", "v < c"), ("unknown_operation", "op", "k % 5 = 0"), ("unknown_command", "op", "k % 6 = 0"), ("unknown_label_kind", "op", "k % 7 = 0"), ("redefined", "op", "k % 9 = 0"),
            ("label_without_stage", "op", "k % 10 = 0"), ("unknown_lane", "st", "l_partkey % 11 = 0"), ("missing_stage", "st", "l_partkey % 13 = 0"), ("future_producer", "st", "l_suppkey > k"),
            ("after_retirement", "op", "NOT is_open AND k % 8 = 0"), ("already_retired", "op", "NOT is_open AND k % 8 = 0"), ("invalid_status", "op", "is_open AND k % 8 = 0"), ("invalid_number", "op", "k % 12 = 0"), ("out_of_range", "op", "k % 11 = 0"),
        )
    )
)


def line_pairs(skip: int = 0, where: str = "true") -> str:
    """Returned lines' ends with the thread's later orders that have a new line, by their least start and stage."""
    return f"""WITH {ORDERS},
    tgt AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY row_idx) AS k FROM (SELECT tid, row_idx, any_value(op_id) AS op_id, min(start_cycle) AS cycle, arg_min(stage, start_cycle * 1000 + stage) AS stage FROM st WHERE name = 'N' GROUP BY tid, row_idx)),
    src AS (SELECT op_id, row_idx, stage, tid, end_cycle AS cycle FROM st WHERE name = 'R' AND end_cycle IS NOT NULL),
    nx AS (SELECT src.*, coalesce(tgt.k, 0) AS seen FROM src ASOF LEFT JOIN tgt ON src.tid = tgt.tid AND src.row_idx >= tgt.row_idx),
    pr AS (SELECT nx.op_id AS s_op_id, tgt.op_id AS t_op_id, nx.row_idx AS s_row_idx, tgt.row_idx AS t_row_idx, nx.cycle AS s_cycle, tgt.cycle AS t_cycle, tgt.cycle - nx.cycle AS elapsed, CAST(nx.stage AS INTEGER) AS s_stage, CAST(tgt.stage AS INTEGER) AS t_stage
           FROM nx JOIN tgt ON tgt.tid = nx.tid AND tgt.k = nx.seen + 1 + {skip})
    SELECT *, row_number() OVER (ORDER BY s_row_idx, s_stage) - 1 AS hit_idx FROM pr WHERE {where}"""


HALVES = f"""WITH {ORDERS}, h AS (SELECT op_id, 'orders-' || tid % 2 AS trace, label, fetch_cycle, end_cycle, row_number() OVER (PARTITION BY tid % 2 ORDER BY op_id) - 1 AS row_idx FROM op),
    own AS (SELECT trace, greatest(max(greatest(h.fetch_cycle, coalesce(h.end_cycle, h.fetch_cycle))), max(greatest(s.start_cycle, coalesce(s.end_cycle, s.start_cycle)))) AS last_cycle FROM h LEFT JOIN st0 s USING (op_id) GROUP BY trace),
    long AS (SELECT h.trace, h.op_id, h.row_idx, h.label, s.start_cycle AS a, coalesce(s.end_cycle, last_cycle + 1) AS z, row_number() OVER (PARTITION BY h.trace ORDER BY h.row_idx, s.stage) - 1 AS hit_idx
             FROM h JOIN st0 s USING (op_id) JOIN own ON own.trace = h.trace WHERE s.name = 'R' AND coalesce(s.end_cycle, last_cycle + 1) - s.start_cycle >= 30),
    met AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY CASE WHEN hit_idx = 900 THEN 0 ELSE 1 END, hit_idx) AS n FROM long WHERE a <= 2000 AND z >= 200 AND row_idx BETWEEN 50 AND 1000000)"""


def found(where: str, view: str = "op", head: str = ORDERS) -> str:
    return f"WITH {head} SELECT op_id, row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS hit_idx FROM {view} WHERE {where}"


def op_rows(where: str, view: str = "op", head: str = ORDERS) -> str:
    return f"WITH {head} SELECT op_id, row_idx, tid, rid, flushed FROM {view} WHERE {where}"


def oracle_sql() -> dict[str, str]:
    order = "WITH h AS ({}) SELECT row_number() OVER (ORDER BY elapsed {}, hit_idx) - 1 AS sort_idx, hit_idx, op_id, elapsed FROM h"
    some_line = "len(list_filter(string_split({}, chr(10)), lambda x: regexp_matches(x, '{}'))) > 0"
    everyone = NO_NEW.replace(" AND x.tid < 3", "")
    return {
        "flagship_error_to_purchase": pairs(where=f"elapsed >= 0 AND {NO_NEW})", tail="SELECT s_op_id, t_op_id, s_cycle, t_cycle, elapsed, hit_idx FROM pr"),
        "match_single": hits("ev", "name = 'purchase'"),
        "match_wildcards": hits("st", "length(lane) = 1 AND regexp_matches(label, '(?i).*-urg.*')"),
        "match_numeric": hits("st", "lower(name) = 'n' AND tid = 3 AND op_id > 100 AND rid <> 7 AND greatest(coalesce(end_cycle, last_cycle + 1) - start_cycle, 0) >= 10"),
        "match_cycle": hits("st", "end_cycle <= 400 AND gid < 700", "end_cycle"),
        "match_status": hits("st", "lower(name) = 'a' AND flushed"),
        "match_end_known": hits("st", "lower(name) = 'r' AND lower(lane) = 'f'", "end_cycle"),
        "match_meta_lines": hits("st", "len(list_filter(string_split(detail || chr(10) || labels, chr(10)), lambda x: lower(x) = 'status=p')) > 0"),
        "match_meta_scopes": hits("st", "len(list_filter(string_split(detail, chr(10)), lambda x: regexp_matches(x, 'price=1.*0'))) > 0 AND regexp_matches(labels, 'part=1.')"),
        "match_op_meta": hits("st", some_line.format("detail", "(?i)^status=f$")),
        "match_saved_buckets": hits("st", some_line.format("detail", "(?i)^status=f$")),
        "match_phase_meta": hits("st", some_line.format("labels", "^part=7.$")),
        "match_meta_contains": hits("st", some_line.format("detail || chr(10) || labels", "=1.3")),
        "match_op_meta_re": hits("st", some_line.format("detail", "^price=[0-9]{5}$")),
        "match_phase_meta_re": hits("st", some_line.format("labels", "=(1|22)[0-4]$")),
        "match_excerpts": f"WITH {TALKS} SELECT op_id, row_idx AS hit_idx, left(label, 160) AS instr_text, left(name, 160) AS phase_text, 'turn' AS lane_text, left(detail || chr(10), 160) AS meta_text FROM tk",
        "match_regex": hits("ev", "regexp_matches(label, 'value=[0-9]{2}$') AND len(list_filter(string_split(detail, chr(10)), lambda x: regexp_matches(x, '^user=1[0-5]$'))) > 0"),
        "pair_next": pairs(),
        "pair_skip2": pairs(2),
        "pair_overlaps": pairs(where="elapsed < 0"),
        "pair_overlaps_lines": line_pairs(where="elapsed < 0"),
        "pair_skip1_lines": line_pairs(1),
        "pair_gaps": pairs(where="elapsed > 1000000000 AND elapsed <= 90000000000"),
        "pair_row_distance": pairs(where="abs(t_row_idx - s_row_idx) <= 400 AND elapsed >= 0"),
        "exclude_rows": pairs(where=f"{NO_NEW}{BETWEEN})"),
        "exclude_all": pairs(where=f"{NO_NEW})"),
        "exclude_rows_shuffled": pairs(where=f"{NO_NEW}{BETWEEN})"),
        "exclude_all_shuffled": pairs(where=f"{NO_NEW})"),
        "exclude_rows_everyone": pairs(where=f"{everyone}{BETWEEN})"),
        "exclude_all_everyone": pairs(where=f"{everyone})"),
        "exclude_rows_lines": line_pairs(where=f"{NO_LONG}{BETWEEN})"),
        "exclude_all_lines": line_pairs(where=f"{NO_LONG})"),
        "elapsed_desc": order.format(LONG, "DESC"),
        "elapsed_asc": order.format(LONG, "ASC"),
        "top_elapsed": pairs(tail="SELECT s_op_id, t_op_id, s_row_idx, t_row_idx, s_cycle, t_cycle, elapsed, hit_idx FROM pr ORDER BY elapsed DESC, hit_idx LIMIT 20"),
        "hits_page": f"SELECT hit_idx, op_id, elapsed FROM ({LONG}) WHERE hit_idx BETWEEN 256 AND 355",
        "sorted_page": f"SELECT * FROM (SELECT row_number() OVER (ORDER BY elapsed DESC, hit_idx) - 1 AS sort_idx, hit_idx, op_id, elapsed FROM ({LONG})) WHERE sort_idx BETWEEN 128 AND 191",
        "hit_lookup": pairs(tail="SELECT s_op_id, t_op_id, label, elapsed FROM pr JOIN ev ON ev.op_id = s_op_id WHERE hit_idx = 7"),
        "hit_bounds_both": pairs(tail=BOX.format(a="least(s_row_idx, t_row_idx)", b="greatest(s_row_idx, t_row_idx)")),
        "hit_bounds_source": pairs(tail=BOX.format(a="greatest(s_row_idx - 3, 0)", b="least(s_row_idx + 3, n - 1)")),
        "hit_bounds_target": pairs(tail=BOX.format(a="greatest(t_row_idx - 2, 0)", b="least(t_row_idx + 2, n - 1)")),
        "hit_bounds_all": pairs(tail=BOX.format(a="CAST(0 AS BIGINT)", b="n - 1")),
        "hit_bounds_single": f"SELECT hit_idx, cycle AS cycle_start, cycle + elapsed AS cycle_end, row_idx AS row_start, row_idx AS row_end FROM ({LONG})",
        "hits_in_window_of_each": f"{HALVES} SELECT trace, hit_idx, op_id, row_idx FROM met WHERE n <= 300",
        "hit_lookup_of_each": f"{HALVES} SELECT trace, op_id, row_idx, label FROM long WHERE hit_idx = 40",
        "window_total_of_each": f"{HALVES} SELECT trace, count(*) AS total FROM met GROUP BY trace",
        "window_total": pairs(tail="SELECT count(*) AS total FROM pr WHERE least(s_row_idx, t_row_idx) <= 400 AND greatest(s_row_idx, t_row_idx) >= 100"),
        "hits_in_window": pairs(tail=""", w AS (SELECT hit_idx, least(s_row_idx, t_row_idx) AS row_start, greatest(s_row_idx, t_row_idx) AS row_end FROM pr WHERE least(s_row_idx, t_row_idx) <= 400 AND greatest(s_row_idx, t_row_idx) >= 100)
            SELECT * FROM w ORDER BY CASE WHEN hit_idx = 700 THEN 0 ELSE 1 END, hit_idx LIMIT 2048"""),
        "query_stats": pairs(tail="SELECT (SELECT count(*) FROM pr) AS hits, (SELECT count(*) FROM ev WHERE name = 'error' AND end_cycle IS NULL) AS skipped"),
        "rows_page": op_rows("row_idx BETWEEN 500 AND 699"),
        "rows_stride": op_rows("row_idx BETWEEN 3 AND 702 AND (row_idx - 3) % 7 = 0"),
        "rows_hide_flushed": f"WITH {ORDERS} SELECT * FROM (SELECT op_id, row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS view_row FROM op WHERE NOT flushed) WHERE view_row BETWEEN 100 AND 149",
        "locate_ids": op_rows("op_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)"),
        "locate_rids": op_rows("NOT flushed AND rid IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 49)"),
        "locate_rows": op_rows("row_idx IN (SELECT o_custkey FROM orders)", "ev", EVENTS),
        "area_bounds": f"WITH {ORDERS}, v AS (SELECT op_id, row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS k FROM op WHERE NOT flushed) SELECT min(op_id) AS first_id, max(op_id) AS last_id, min(row_idx) AS first_row, max(row_idx) AS last_row FROM v WHERE k IN (40, 300)",
        "area_rows": op_rows("row_idx BETWEEN 40 AND 700 AND NOT flushed"),
        "search_text": found("lower(label) LIKE '%purchase value=1%' OR lower(detail) LIKE '%purchase value=1%' OR name LIKE '%purchase value=1%'", "ev", EVENTS),
        "search_regex": found("regexp_matches(label, '(?i)[aeiou]{3}n') OR regexp_matches(detail, '(?i)[aeiou]{3}n') OR regexp_matches(name, '(?i)[aeiou]{3}n')", "tk", TALKS),
        "search_case": found("contains(label, 'The ') OR contains(detail, 'The ') OR contains(name, 'The ')", "tk", TALKS),
        "search_ranges": found("op_id >= 100 AND gid <= 500 AND tid BETWEEN 2 AND 5 AND rid >= 0"),
        "search_cycles": found("coalesce(end_cycle, fetch_cycle) >= 200 AND fetch_cycle <= 300"),
        "search_stage": found("rid IS NOT NULL AND NOT flushed AND op_id IN (SELECT op_id FROM st WHERE name = 'A')"),
        "search_status": found("incomplete"),
        "search_stage_text": found("contains(label, 'part=77') OR contains(detail, 'part=77') OR op_id IN (SELECT op_id FROM st WHERE contains(labels, 'part=77'))"),
        "search_snippets": f"WITH {EVENTS} SELECT op_id, CAST(0 AS BIGINT) AS seq, 'Disassembly: ' || substr(label, greatest(instr(label, 'value=9') - 40, 1), instr(label, 'value=9') - greatest(instr(label, 'value=9') - 40, 1) + 67) AS snippet FROM ev WHERE contains(label, 'value=9')",
        "search_snippets_fields": f"""WITH {ORDERS}, f AS (SELECT op_id, 0 AS seq, 'Disassembly' AS field, label AS v FROM op UNION ALL SELECT op_id, 1, 'Metadata', detail FROM op
            UNION ALL SELECT op_id, stage * 2 + 2, 'Stage', name FROM st UNION ALL SELECT op_id, stage * 2 + 3, 'Stage metadata', labels FROM st)
            SELECT op_id, CAST(seq AS BIGINT) AS seq, field || ': ' || v AS snippet FROM f WHERE regexp_matches(v, '(?i)-URG|price=1|part=7|^R$')""",
        "search_total": f"WITH {ORDERS} SELECT count(*) AS total FROM op WHERE op_id IN (SELECT op_id FROM st WHERE contains(labels, 'part=7'))",
        "trace_info": f"WITH {ORDERS} SELECT 'orders' AS trace, count(*) AS n_ops, count(*) FILTER (flushed) AS flushed, CAST(min(fetch_cycle) AS BIGINT) AS first_cycle, any_value(last_cycle) AS last_cycle FROM op, info",
        "symbols": f"WITH {ORDERS}, f AS (SELECT name, min(k) AS k FROM (SELECT lane AS name, (row_idx * 1000 + stage) * 2 AS k FROM st UNION ALL SELECT name, (row_idx * 1000 + stage) * 2 + 1 FROM st) GROUP BY name) SELECT name, row_number() OVER (ORDER BY k) - 1 AS symbol_id FROM f",
        "suggest_instruction": f"WITH {EVENTS} SELECT value FROM (SELECT label AS value, min(row_idx) AS k FROM ev WHERE regexp_matches(label, 'click.*9') GROUP BY label ORDER BY k LIMIT 16)",
        "suggest_phase": f"WITH {EVENTS} SELECT value FROM (SELECT name AS value, min(row_idx) AS k FROM ev GROUP BY name ORDER BY k LIMIT 16)",
        "suggest_lane": f"WITH {ORDERS} SELECT DISTINCT lane AS value FROM st",
        "suggest_metadata": f"""WITH {ORDERS}, v AS (SELECT unnest(string_split(detail, chr(10))) AS value, row_idx, -1 AS stage, generate_subscripts(string_split(detail, chr(10)), 1) AS k FROM op UNION ALL SELECT labels, row_idx, stage, 0 FROM st)
            SELECT value FROM (SELECT value, min((row_idx * 1000 + stage + 1) * 10 + k) AS k FROM v WHERE regexp_matches(value, '=1.') GROUP BY value ORDER BY k LIMIT 16)""",
        "overview": f"""WITH {ORDERS}, f AS (SELECT name, min(k) AS k FROM (SELECT lane AS name, (row_idx * 1000 + stage) * 2 AS k FROM st UNION ALL SELECT name, (row_idx * 1000 + stage) * 2 + 1 FROM st) GROUP BY name),
            sy AS (SELECT name, row_number() OVER (ORDER BY k) - 1 AS symbol_id FROM f), b AS (SELECT min(fetch_cycle) AS c0, count(*) AS n FROM op),
            g AS (SELECT row_idx, stage, 1 + symbol_id % 8 + CASE WHEN flushed THEN 128 ELSE 0 END AS color, flushed, least(row_idx * least(n, 1024) // n, least(n, 1024) - 1) AS y,
                    least(greatest(start_cycle - c0, 0) * 256 // (last_cycle - c0 + 1), 255) AS a, least(greatest(greatest(coalesce(end_cycle, last_cycle + 1) - 1, start_cycle) - c0, 0) * 256 // (last_cycle - c0 + 1), 255) AS z
                  FROM st JOIN sy USING (name), b, info),
            c AS (SELECT y, unnest(generate_series(a, greatest(z, least(a + 2, 255)))) AS x, color, flushed, row_idx * 1000 + stage AS k FROM g)
            SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(arg_max(color, k) AS BIGINT) AS color, arg_max(flushed, k) AS flushed FROM c GROUP BY y, x""",
        "stage_elapsed": f"WITH {ORDERS} SELECT op_id, stage, coalesce(end_cycle, last_cycle + 1) AS shown_end, greatest(coalesce(end_cycle, last_cycle + 1) - start_cycle, 0) AS elapsed FROM st, info",
        "lanes": f"WITH {ORDERS}, f AS (SELECT op_id, lane, min(stage) AS s, count(*) AS n_stages FROM st GROUP BY op_id, lane) SELECT op_id, lane, row_number() OVER (PARTITION BY op_id ORDER BY s) - 1 AS lane_index, count(*) OVER (PARTITION BY op_id) AS lane_count, n_stages FROM f",
        "first_phase": f"WITH {ORDERS} SELECT op_id, CAST(coalesce((SELECT min(start_cycle) FROM st WHERE st.op_id = op.op_id), fetch_cycle) AS BIGINT) AS first_phase FROM op",
        "status": f"WITH {ORDERS} SELECT op_id, CASE WHEN flushed THEN 'flushed' WHEN incomplete THEN 'incomplete' WHEN rid IS NOT NULL THEN 'retired' ELSE 'active' END AS status FROM op",
        "metadata_text": f"""WITH {EVENTS}, p AS (SELECT *, lag(op_id) OVER (PARTITION BY tid ORDER BY op_id) AS producer FROM ev)
            SELECT op_id, label || chr(10) || 'Op ' || op_id || ' · Global ' || tid || ' · Thread ' || tid || chr(10) || 'Retired ID: ' || coalesce('Some(' || rid || ')', 'None') || chr(10) || 'Cycles: ' || start_cycle || '–' || coalesce(CAST(end_cycle AS VARCHAR), 'active')
              || ' · Source line ' || op_id || chr(10) || 'Status: ' || CASE WHEN flushed THEN 'flushed' WHEN incomplete THEN 'incomplete' ELSE 'retired' END || chr(10) || detail || chr(10) || parity || ' / ' || name || ': ' || start_cycle || '–' || coalesce(CAST(end_cycle AS VARCHAR), 'active') || ' '
              || coalesce(chr(10) || 'Depends on ' || producer || ' · type 0 · cycle ' || start_cycle, '') AS report FROM p""",
        "operation_details": f"WITH {ORDERS}, l AS (SELECT op_id, count(*) AS n, string_agg(lane || '/' || name || ':' || start_cycle, ',' ORDER BY stage) AS t FROM st GROUP BY op_id) SELECT op.op_id, row_idx, coalesce(n, 0) AS n_stages, t AS stage_list FROM op LEFT JOIN l ON l.op_id = op.op_id",
        "dependency_edges": f"WITH {EVENTS}, d AS (SELECT op_id, start_cycle AS cycle, row_idx, lag(op_id) OVER w AS producer, lag(row_idx) OVER w AS producer_row FROM ev WINDOW w AS (PARTITION BY tid ORDER BY op_id)) SELECT op_id, producer, cycle, row_idx, producer_row FROM d WHERE producer IS NOT NULL",
        "to_json_rows": f"WITH {EVENTS} SELECT '{{\"op_id\":\"' || op_id || '\",\"fetch_cycle\":\"' || start_cycle || '\",\"flushed\":' || CASE WHEN flushed THEN 'true' ELSE 'false' END || '}}' AS json FROM ev",
        "ingest_ops": LOG + """, o AS (SELECT *, (SELECT max(c) + 1 FROM clock) AS last FROM clock) SELECT event_id AS op_id, user_id AS gid, user_id % 16 AS tid, CASE WHEN event_type <> 'error' THEN event_id END AS rid, t AS fetch_cycle,
            CASE WHEN event_type = 'error' THEN last + 1 ELSE t + 1 END AS end_cycle, event_type = 'signup' AS flushed, event_type = 'error' AS incomplete, event_type AS label, 'user=' || user_id AS detail, row_idx FROM o""",
        "ingest_stages": LOG + " SELECT event_id AS op_id, event_type AS name, '0' AS lane, t AS start_cycle, t + 1 AS end_cycle, 'value=' || CAST(floor(value) AS BIGINT) AS labels, false AS open FROM clock",
        "ingest_deps": LOG + " SELECT event_id AS op_id, event_id - 1 AS producer, CAST(0 AS BIGINT) AS kind, t + 1 AS cycle FROM clock WHERE event_id > 0",
        "ingest_symbols": "SELECT DISTINCT event_type AS name FROM events UNION SELECT '0'",
        "ingest_rejects": "SELECT 'after_retirement' AS reason, count(*) AS n FROM events WHERE event_type <> 'error' AND event_id > 0",
        "ingest_trace_info": LOG + " SELECT 'log' AS trace, count(*) AS n_ops, count(*) FILTER (event_type = 'signup') AS flushed, min(t) AS first_cycle, max(t) + 1 AS last_cycle FROM clock",
        "ingest_saved": LOG + " SELECT event_id AS op_id, row_idx, CAST(0 AS BIGINT) AS stage, event_type AS name, t AS start_cycle, t + 1 AS end_cycle, 'value=' || CAST(floor(value) AS BIGINT) AS labels FROM clock",
        "ingest_text_files": LOG + FILES,
        "ingest_gzip_files": LOG + FILES,
        "ingest_frame_files": LOG + FILES.replace("event_id // 4096 + 1 AS block", "event_id // 65536 AS part").replace("event_id // 4096", "event_id // 65536"),
        "ingest_bad_files": """WITH b AS (SELECT o_orderkey >> 9 AS b, count(*) AS n FROM orders GROUP BY 1)
            SELECT 'block-' || b AS trace, CASE b % 3 WHEN 0 THEN 'bad_header' WHEN 1 THEN 'not_utf8' ELSE 'read' END AS found, CASE b % 3 WHEN 2 THEN n ELSE 0 END AS n FROM b""",
        "rows_of_hashed_ids": """WITH h AS (SELECT CAST(o_orderkey % 2 AS VARCHAR) AS trace, CAST((o_orderkey::HUGEINT * 6364136223846793005) % 9223372036854775783 AS BIGINT) AS op_id, o_orderkey AS gid FROM orders)
            SELECT trace, op_id, gid, row_number() OVER (PARTITION BY trace ORDER BY op_id) - 1 AS row_idx FROM h""",
        "wide_log_ops": f"{WIDE_LOG} SELECT CAST(id AS VARCHAR) AS op_id, CASE WHEN retired THEN CAST(id AS VARCHAR) END AS rid, CAST(k % 8 AS VARCHAR) AS tid, CAST(c AS VARCHAR) AS fetch_cycle, CAST(op_end AS VARCHAR) AS end_cycle, NOT retired AS incomplete, row_idx FROM op",
        "wide_log_deps": f"{WIDE_LOG} SELECT CAST(id AS VARCHAR) AS op_id, CAST(id - 1 AS VARCHAR) AS producer, CAST(c + 3 AS VARCHAR) AS cycle FROM op WHERE k % 5 = 0",
        "wide_log_matches": f"""{WIDE_LOG}, m AS (SELECT * FROM op WHERE id > 9223372036854775908::HUGEINT)
            SELECT CAST(id AS VARCHAR) AS op_id, row_idx, CAST(c AS VARCHAR) AS cycle, CAST(end_cycle - c AS VARCHAR) AS elapsed, row_number() OVER (ORDER BY row_idx) - 1 AS hit_idx FROM m""",
        "wide_log_pairs": f"""{WIDE_LOG}, src AS (SELECT id, row_idx, k % 8 AS tid, end_cycle AS cycle FROM op WHERE name = 'F'), tgt AS (SELECT id, row_idx, k % 8 AS tid, c AS cycle FROM op WHERE name = 'O'),
            pr AS (SELECT src.id AS s_id, tgt.id AS t_id, src.row_idx, src.cycle AS s_cycle, tgt.cycle AS t_cycle FROM src ASOF JOIN tgt ON src.tid = tgt.tid AND src.row_idx < tgt.row_idx),
            kept AS (SELECT * FROM pr WHERE NOT EXISTS (SELECT 1 FROM op x WHERE x.name = 'P' AND x.c > least(s_cycle, t_cycle) AND x.c < greatest(s_cycle, t_cycle)))
            SELECT CAST(s_id AS VARCHAR) AS s_op_id, CAST(t_id AS VARCHAR) AS t_op_id, CAST(s_cycle AS VARCHAR) AS s_cycle, CAST(t_cycle AS VARCHAR) AS t_cycle, CAST(t_cycle - s_cycle AS VARCHAR) AS elapsed, row_number() OVER (ORDER BY row_idx) - 1 AS hit_idx FROM kept""",
        "wide_log_json": f"{WIDE_LOG} SELECT '{{\"op_id\":\"' || id || '\",\"row_idx\":\"' || row_idx || '\"}}' AS json FROM op",
        "wide_log_overview": f"""{WIDE_LOG}, f AS (SELECT name, min(k) AS p FROM (SELECT '0' AS name, min(k) * 2 AS k FROM op UNION ALL SELECT name, min(k) * 2 + 1 FROM op GROUP BY name) GROUP BY name),
            sy AS (SELECT name, row_number() OVER (ORDER BY p) - 1 AS symbol_id FROM f), c0 AS (SELECT v AS first_cycle FROM op ORDER BY k LIMIT 1),
            g AS (SELECT row_idx, 1 + symbol_id % 8 AS color, least(row_idx * least(n, 128) // n, least(n, 128) - 1) AS y, CAST(least(greatest(c - first_cycle, 0) * 64 // (last_cycle - first_cycle + 1), 63) AS BIGINT) AS a,
                    CAST(least(greatest(greatest(end_cycle - 1, c) - first_cycle, 0) * 64 // (last_cycle - first_cycle + 1), 63) AS BIGINT) AS z FROM op JOIN sy USING (name), info, c0),
            cells AS (SELECT y, unnest(generate_series(a, greatest(z, least(a + 2, 63)))) AS x, color, row_idx AS k FROM g)
            SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(arg_max(color, k) AS BIGINT) AS color FROM cells GROUP BY y, x""",
        "order_log_ops": f"""{ORDER_LOG} SELECT k AS op_id, o_custkey AS gid, k % 8 AS tid, CASE WHEN NOT is_open THEN k END AS rid, c AS fetch_cycle, op_end AS end_cycle, flushed, is_open AS incomplete,
            replace(raw, '\\n', chr(10)) AS label, 'after' AS detail, row_idx FROM op""",
        "order_log_stages": f"""{ORDER_LOG}, l AS (SELECT k, lane, row_number() OVER (PARTITION BY k ORDER BY min(i)) - 1 AS lane_index FROM st GROUP BY k, lane)
            SELECT k AS op_id, i AS stage, name, lane, lane_index, start_cycle, end_cycle, labels FROM st JOIN l USING (k, lane)""",
        "order_log_deps": f"{ORDER_LOG} SELECT k AS op_id, i AS seq, l_suppkey AS producer, CAST(l_linenumber AS BIGINT) AS kind, start_cycle + 3 AS cycle FROM st",
        "order_log_symbols": f"{ORDER_LOG}, {NAMES} SELECT name, symbol_id FROM sy",
        "order_log_rejects": f"{ORDER_LOG}, {REFUSED} SELECT reason, n FROM refused WHERE n > 0",
        "order_log_info": f"""{ORDER_LOG}, {NAMES}, {REFUSED} SELECT 'orders' AS trace, (SELECT count(*) FROM op) AS n_ops, (SELECT count(*) FROM op WHERE flushed) AS flushed, (SELECT arg_min(v, k) FROM op) AS first_cycle, last_cycle,
            CAST((SELECT sum(n) FROM refused) AS BIGINT) AS warning_count, (SELECT string_agg(name, ',' ORDER BY symbol_id) FROM sy) AS symbols, CAST(least(10, (SELECT sum(n) FROM refused)) AS BIGINT) AS n_shown FROM info""",
        "order_log_limited": f"{ORDER_LOG} SELECT k AS op_id, CASE WHEN length(raw) + 5 <= 28 THEN replace(raw, '\\n', chr(10)) ELSE '' END AS label, CASE WHEN length(raw) + 5 <= 28 THEN 'after' ELSE '' END AS detail FROM op",
        "order_log_too_large": f"{ORDER_LOG} SELECT 'operation_too_large' AS reason, count(*) AS n FROM op WHERE length(raw) + 5 > 28 HAVING count(*) > 0",
        "stream_ingest": LOG + " SELECT event_id AS op_id, event_type AS name, t AS start_cycle, t + 1 AS end_cycle FROM clock",
    }
