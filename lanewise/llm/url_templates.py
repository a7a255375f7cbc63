"""URL filters: curated rules first, then a tree of path templates for each host.

A url's path is a list of segments. Segments that look variable (numbers, hex strings, long mixed
codes) become wildcards of their kind. The tree of a host is merged from the top down. The literal branches
of a node that have enough labels are pooled by their share of bad pages (in bins), and neighbouring pools merge unless a
two-proportion z test tells them apart, so similar branches become one wildcard: `*` for the cluster of most labels,
`*1`, `*2`, .. for others, by bin; a cluster of one branch stays literal. Branches of few labels can't be told apart
from each other: they are `*`, with the cluster of most labels if that has several branches or is the only one. The
children of merged branches are pooled before the next level is judged, so a level has all labels of its wildcard.
Templates are rejected by their smoothed share of bad labels: (bad + prior * strength) / (labelled + strength)
reaching `purity`, where prior is the share over all labelled pages.

Nodes of up to WHOLE_ROWS different paths, as most hosts are from the start, are solved with all that is below them by
the task that holds them. Larger ones are stepped through: a step takes a table of (host, merged prefix, rest of the path)
one level down, common starts of all paths of a node being passed at once, until what is left is small. A node's pools are
at most BINS + 2 rows, so a node of any width is no large group. Both ways give the same templates, which a test holds.

A host's pages are summed by distinct (host, shaped path) before anything else is done with them,
so a host with a third of all pages costs a few rows, and paths differ after shaping only in their
literal segments. Literal segments that look like a wildcard begin with `~` in templates.

Rules are (host, path, verdict) triples. A rule fits its host and all subdomains if the path starts
with the rule's; of those that fit, the longest wins. Rules are few (they are typed by people) and
become one expression.

Defined results: empty tables give no rows; urls of any length count whole; of equally long rules the first in
alphabetical order wins; columns other than the named ones are neither read nor returned. A null url or one without `://` has an empty host and path, which are judged like
any other. Pages with null ids have no label. Repeated label rows of a page count once, as bad if
one of them is. Without labels nothing but the rules blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed, table

#: Example rules of the query: (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: z below which branches count as similar, labels that a branch needs to be tested, and the smoothing.
SIMILAR_Z, LEAST_LABELS, STRENGTH, PURITY = 1.96, 5, 10, 0.8
#: Bins of the share of bad pages.
BINS = 20
#: Rows up to which a node's whole subtree is one task's work.
WHOLE_ROWS = 4096
#: Levels that the SQL form is unrolled to; the operator takes all.
SQL_LEVELS = 6

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of variable segments, the first that matches counts.
SHAPES = [(r"^[0-9]+$", "{n}"), (r"^[0-9]+\.[a-z]{2,5}$", "{n}.x"), (r"^[0-9a-fA-F]{8,}$", "{hex}"), (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"), (r"^.*[0-9].*[0-9].*[0-9].*$", "{code}"), (r"^.{40,}$", "{long}")]

LIKE_WILDCARD = "^[*{~]"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, or nulls."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def shaped(path: Column) -> Column:
    """The path's segments, variable ones as wildcards of their kind."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")

    def one(s: Column) -> Column:
        first, rest = SHAPES[0], SHAPES[1:]
        kinds = reduce(lambda c, x: c.when(s.rlike(x[0]), x[1]), rest, F.when(s.rlike(first[0]), first[1]))
        return kinds.otherwise(F.when(s.rlike(LIKE_WILDCARD), F.concat(F.lit("~"), s)).otherwise(s))

    return F.transform(parts, one)


def merged(nodes: DataFrame) -> DataFrame:
    """host, prefix, segment, form of the branches nodes (host, prefix, segment, n, b): the wildcard or segment that stands for each."""
    variable = F.col("segment").startswith("{")
    bin_ = F.when(F.col("n") >= LEAST_LABELS, F.floor(F.col("b") * BINS / F.col("n")).cast("int"))
    binned = nodes.withColumn("bin", F.when(~variable, bin_)).withColumn("free", variable)
    pools = binned.where("not free").groupBy("host", "prefix", "bin").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("k"))
    node, line = Window.partitionBy("host", "prefix"), Window.partitionBy("host", "prefix").orderBy(F.asc_nulls_first("bin"))
    n, b, m, c = F.nullif("n", F.lit(0)), F.col("b"), F.nullif(F.lag("n").over(line), F.lit(0)), F.lag("b").over(line)
    share = (b + c) / (n + m)
    # z squared over its bound, without a division by zero: difference**2 > bound * variance
    differ = F.lag("bin").over(line).isNotNull() & F.col("bin").isNotNull() & ((b / n - c / m) * (b / n - c / m) > SIMILAR_Z * SIMILAR_Z * (share * (1 - share) * (1 / n + 1 / m)))
    pools = pools.withColumn("cluster", F.sum(F.when(differ, 1).otherwise(0)).over(line)).withColumn("tested", F.col("bin").isNotNull())
    own = Window.partitionBy("host", "prefix", "tested", "cluster")
    pools = pools.withColumn("size", F.sum("k").over(own)).withColumn("rank", F.when(F.col("tested"), F.struct(F.sum("n").over(own).alias("n"), (-F.col("cluster")).alias("c"))))
    pools = pools.withColumn("main", F.coalesce(F.col("rank") == F.max("rank").over(node), F.lit(False)))
    pools = pools.withColumn("thin", F.coalesce(F.max(F.when(~F.col("tested"), F.col("size"))).over(node), F.lit(0)))
    pools = pools.withColumn("most", F.coalesce(F.max(F.when(F.col("main"), F.col("size"))).over(node), F.lit(0)))
    one = F.coalesce(F.max(F.when(F.col("tested"), F.col("cluster"))).over(node), F.lit(0)) == 0
    pools = pools.withColumn("with_thin", (F.col("thin") > 0) & ((F.col("most") > 1) | one))
    together = F.when(F.col("with_thin"), F.col("thin") + F.col("most")).otherwise(F.col("size"))
    form = F.when(F.col("main") | ~F.col("tested"), F.when(together > 1, "*")).when(F.col("size") > 1, F.concat(F.lit("*"), F.col("cluster").cast("string")))
    forms = pools.select("host", "prefix", F.coalesce("bin", F.lit(-1)).alias("bin"), form.alias("form"))
    named = binned.withColumn("bin", F.when(F.col("free"), -2).otherwise(F.coalesce("bin", F.lit(-1)))).join(forms, ["host", "prefix", "bin"], "left")
    return named.select("host", "prefix", "segment", F.coalesce("form", "segment").alias("form"))


def _under(prefix: Column, more: Column) -> Column:
    """The prefix with more segments (an array) after it."""
    return F.concat_ws("/", F.filter(F.concat(F.array(prefix), more), lambda s: s != ""))


def forms_of(counts: dict[str, tuple[int, int]]) -> dict[str, str]:
    """What `merged` says of one node's branches, segment -> (labelled, bad)."""
    pools: dict[int, list] = {}  # by bin, -1 for branches of few labels: labelled, bad, segments
    for segment, (n, b) in counts.items():
        if not segment.startswith("{"):
            pool = pools.setdefault(floor(b * BINS / n) if n >= LEAST_LABELS else -1, [0, 0, []])
            pool[0] += n
            pool[1] += b
            pool[2].append(segment)
    thin = pools.pop(-1, [0, 0, []])[2]
    clusters: list[list] = []
    last = None
    for _, (n, b, segments) in sorted(pools.items()):
        if last is not None:
            m, c = last
            share = (b + c) / (n + m)
            differ = (b / n - c / m) * (b / n - c / m) > SIMILAR_Z * SIMILAR_Z * (share * (1 - share) * (1 / n + 1 / m))
        if last is None or differ:
            clusters.append([0, []])
        clusters[-1][0] += n
        clusters[-1][1] += segments
        last = n, b
    main = max(range(len(clusters)), key=lambda k: (clusters[k][0], -k), default=-1)
    most = clusters[main][1] if clusters else []
    forms = {s: f"*{k}" for k, (_, own) in enumerate(clusters) if k != main and len(own) > 1 for s in own}
    for own in [thin + most] if thin and (len(most) > 1 or len(clusters) < 2) else [thin, most]:
        if len(own) > 1:
            forms |= dict.fromkeys(own, "*")
    return forms


def solved(rows: list[tuple[list[str], int, int]], prefix: str) -> list[str]:
    """The template of each row (rest of its path, labelled, bad) of one node, level by level."""
    out = [prefix] * len(rows)
    nodes = [(list(range(len(rows))), 0, [prefix] if prefix else [])]
    while nodes:
        at, level, before = nodes.pop()
        low, high = (f(rows[i][0][level:] for i in at) for f in (min, max))
        common = next((k for k, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), len(low))
        before, level = before + low[:common], level + common
        counts: dict[str, tuple[int, int]] = {}
        for i in at:
            path, n, b = rows[i]
            if len(path) > level:
                m, c = counts.get(path[level], (0, 0))
                counts[path[level]] = m + n, c + b
            else:
                out[i] = "/".join(before)
        forms = forms_of(counts)
        below: dict[str, list[int]] = {}
        for i in at:
            if len(rows[i][0]) > level:
                segment = rows[i][0][level]
                below.setdefault(forms.get(segment, segment), []).append(i)
        nodes += [(own, level + 1, [*before, form]) for form, own in below.items()]
    return out


def solve_whole(rows: DataFrame) -> DataFrame:
    """host, shape, template of nodes (host, shape, labelled, bad, prefix, rest) that are small enough to be held by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def flush() -> pa.RecordBatch:
            names = solved([(r["rest"], r["labelled"], r["bad"]) for r in held], node[1])
            return pa.record_batch([pa.array([node[0]] * len(held), pa.string()), pa.array([r["shape"] for r in held], pa.list_(pa.string())), pa.array(names, pa.string())], names=["host", "shape", "template"])

        for batch in batches:
            for row in batch.to_pylist():
                if (own := (row["host"], row["prefix"])) != node:
                    if held:
                        yield flush()
                    node, held = own, []
                held.append(row)
        if held:
            yield flush()

    return rows.repartition("host", "prefix").sortWithinPartitions("host", "prefix").mapInArrow(run, "host string, shape array<string>, template string")


def named_paths(seen: DataFrame, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """host, shape, template of each path of seen (host, shape, labelled, bad)."""
    going = seen.select("host", "shape", "labelled", "bad", F.lit("").alias("prefix"), F.col("shape").alias("rest"))
    done: list[DataFrame] = []
    while True:
        ends = going.groupBy("host", "prefix").agg(F.count("*").alias("rows"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        apart = F.array_position(F.zip_with("low", "high", lambda x, y: ~x.eqNullSafe(y)), True)
        ends = ends.select("host", "prefix", "rows", F.when(apart > 0, apart - 1).otherwise(F.size("low")).cast("int").alias("common"))
        rows = going.join(ends, ["host", "prefix"])
        done.append(solve_whole(rows.where(F.col("rows") <= whole_rows).drop("rows", "common")))
        large = rows.where(F.col("rows") > whole_rows)
        large = large.withColumn("prefix", _under(F.col("prefix"), F.slice("rest", F.lit(1), F.col("common")))).withColumn("rest", F.slice("rest", F.col("common") + 1, F.size("rest"))).drop("common", "rows")
        large = checkpointed(large)
        if large.isEmpty():
            return checkpointed(reduce(DataFrame.unionByName, done))
        done.append(large.where(F.size("rest") == 0).select("host", "shape", F.col("prefix").alias("template")))
        left = large.where(F.size("rest") > 0).withColumn("segment", F.col("rest")[0])
        forms = merged(left.groupBy("host", "prefix", "segment").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")))
        next_ = left.join(forms, ["host", "prefix", "segment"])
        going = checkpointed(next_.select("host", "shape", "labelled", "bad", _under(F.col("prefix"), F.array("form")).alias("prefix"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest")))


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, shape, template, labelled, bad, purity, rejected for each distinct shaped path of a host.

    pages has host, shape, page_id; labels has page_id, bad (0 or 1).
    """
    marks = labels.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.join(marks, "page_id", "left").groupBy("host", "shape").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    seen = checkpointed(seen)
    prior = seen.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.sum("labelled"), F.lit(1))).alias("prior"))
    named = seen.join(named_paths(seen), ["host", "shape"])
    pools = named.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(prior))  # one row
    purity = (F.col("bad") + F.col("prior") * STRENGTH) / (F.col("labelled") + STRENGTH)
    pools = pools.select("host", "template", "labelled", "bad", purity.alias("purity"), ((purity >= PURITY) & (F.col("labelled") > 0)).alias("rejected"))
    return named.select("host", "shape", "template").join(pools, ["host", "template"])


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each page (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("shape", shaped(F.col("path")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = templates(split, labels)
    out = split.join(found, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def query(spark, sf_dir: str) -> DataFrame:
    """Labels of the table are by id: a page is bad if the document of its id is of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 0).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels, RULES)


def _sql_level(level: int) -> str:
    """DuckDB's form of `merged` and one step down: from state{level} (host, shape, labelled, bad, prefix) to the next."""
    p, node = f"p{level}", "PARTITION BY host, prefix"
    return f"""
    n{level} AS (SELECT host, prefix, shape[{level + 1}] AS segment, sum(labelled) AS n, sum(bad) AS b FROM state{level} WHERE len(shape) > {level} GROUP BY ALL),
    b{level} AS (SELECT *, starts_with(segment, '{{') AS free, CASE WHEN NOT starts_with(segment, '{{') AND n >= {LEAST_LABELS} THEN CAST(floor(b * {BINS} / n) AS INTEGER) END AS bin FROM n{level}),
    a{level} AS (SELECT host, prefix, bin, sum(n) AS n, sum(b) AS b, count(*) AS k FROM b{level} WHERE NOT free GROUP BY ALL),
    l{level} AS (SELECT *, lag(n) OVER w AS m, lag(b) OVER w AS c, lag(bin) OVER w AS before FROM a{level} WINDOW w AS ({node} ORDER BY bin NULLS FIRST)),
    d{level} AS (SELECT *, before IS NOT NULL AND pow(b / n - c / m, 2) > {SIMILAR_Z * SIMILAR_Z} * (((b + c) / (n + m)) * (1 - (b + c) / (n + m)) * (1 / n + 1 / m)) AS differ FROM l{level}),
    c{level} AS (SELECT *, sum(CASE WHEN differ THEN 1 ELSE 0 END) OVER ({node} ORDER BY bin NULLS FIRST) AS cluster, bin IS NOT NULL AS tested FROM d{level}),
    s{level} AS (SELECT *, sum(k) OVER o AS size, CASE WHEN tested THEN sum(n) OVER o * 64 - cluster END AS place FROM c{level} WINDOW o AS (PARTITION BY host, prefix, tested, cluster)),
    m{level} AS (SELECT *, coalesce(place = max(place) OVER ({node}), false) AS main, coalesce(max(CASE WHEN NOT tested THEN size END) OVER ({node}), 0) AS thin, coalesce(max(CASE WHEN tested THEN cluster END) OVER ({node}), 0) = 0 AS one FROM s{level}),
    {p} AS (SELECT *, coalesce(max(CASE WHEN main THEN size END) OVER ({node}), 0) AS most FROM m{level}),
    f{level} AS (SELECT host, prefix, bin, CASE WHEN main OR NOT tested THEN CASE WHEN (CASE WHEN thin > 0 AND (most > 1 OR one) THEN thin + most ELSE size END) > 1 THEN '*' END
                                                WHEN size > 1 THEN '*' || CAST(cluster AS VARCHAR) END AS form FROM {p}),
    g{level} AS (SELECT b.host, b.prefix, b.segment, coalesce(form, b.segment) AS form FROM b{level} b LEFT JOIN f{level} f ON NOT b.free AND f.host = b.host AND f.prefix = b.prefix AND f.bin IS NOT DISTINCT FROM b.bin),
    state{level + 1} AS (SELECT s.host, s.shape, labelled, bad, CASE WHEN form IS NULL THEN s.prefix WHEN s.prefix = '' THEN form ELSE s.prefix || '/' || form END AS prefix
                         FROM state{level} s LEFT JOIN g{level} g ON g.host = s.host AND g.prefix = s.prefix AND g.segment = s.shape[{level + 1}])"""


def url_sql(rules: list[tuple[str, str, str]] = RULES) -> str:
    """The same in DuckDB's SQL, for paths of up to SQL_LEVELS segments."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in ordered]
    rule = "CASE" + "".join(f" WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, ordered, strict=True)) + " END"
    verdict = "CASE" + "".join(f" WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, ordered, strict=True)) + " END"
    shape = "CASE" + "".join(f" WHEN regexp_matches(s, '{p}') THEN '{k}'" for p, k in SHAPES) + f" WHEN regexp_matches(s, '{LIKE_WILDCARD}') THEN '~' || s ELSE s END"
    levels = ",".join(_sql_level(i) for i in range(SQL_LEVELS))
    return f"""
    WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    sp AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {shape}) AS shape FROM hp),
    marks AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
    seen AS (SELECT host, shape, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM sp LEFT JOIN marks USING (page_id) GROUP BY host, shape),
    prior AS (SELECT coalesce(sum(bad), 0) / greatest(sum(labelled), 1) AS prior FROM seen),
    state0 AS (SELECT *, '' AS prefix FROM seen),{levels},
    full_named AS (SELECT host, shape, labelled, bad, prefix AS template FROM state{SQL_LEVELS}),
    pools AS (SELECT host, template, (sum(bad) + any_value(prior) * {STRENGTH}) / (sum(labelled) + {STRENGTH}) AS purity, sum(labelled) AS labelled FROM full_named, prior GROUP BY host, template)
    SELECT page_id, sp.host AS host, path, {rule.replace('host', 'sp.host')} AS rule,
           coalesce({verdict.replace('host', 'sp.host')}, CASE WHEN purity >= {PURITY} AND pools.labelled > 0 THEN 'block' ELSE 'allow' END) AS verdict,
           full_named.template AS template, round(purity, 6) AS purity
    FROM sp JOIN full_named ON sp.host = full_named.host AND sp.shape = full_named.shape JOIN pools ON pools.host = full_named.host AND pools.template = full_named.template"""
