"""Mixing sources to target weights by hierarchical budgeting.

Sources hang in a tree domain > language > source. A token budget flows down it in proportion to
whole-number weights. What a child cannot use (its documents hold too few tokens, even over all
epochs) goes to its siblings by their weights first; only what a whole branch cannot use goes to
that branch's own siblings, as a branch never gets more than its leaves can use.

Among siblings this is water-filling: in order of capacity / weight each child is full or open; the
full ones get their capacity, the open ones share the rest by weight. Budgets are whole tokens;
shares are rounded down, so a level leaves less than one token a child unused.

A leaf's documents stand in a seeded order of their own in each epoch; the leaf takes the longest
prefix of epoch 1, then 2, ... that fits its budget. The prefix is found without sorting a leaf in
one task: documents fall into buckets by the first digits of their seeded hash, as many as the largest leaf's count
asks for, buckets are summed and accumulated, and only within a bucket are documents accumulated one by one.

Defined results: null text counts 0 tokens, null language or source is the branch `none`, null ids
are ordered by an empty id. Documents of 0 tokens are taken with the prefix that they stand in, which ends where the
budget is reached. Very long texts count whole.
Branches that the weights don't name get the default weight; weight 0 takes nothing. Rows that are
equal in id and order hash stand in text-length order and are taken as they fit. Empty tables give no rows;
other columns are ignored, but returned by `keep_mix`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed, fresh, table

#: Hex digits of the seeded hash that name a leaf's bucket, at least: 4096 buckets a leaf and epoch.
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class MixPlan:
    """Weights by branch ("web", "web/en", "web/en/src0"), the share of all tokens wanted, epochs and seed."""

    weights: dict[str, int] = field(default_factory=dict)
    default_weight: int = 1
    budget_percent: int = 50
    epochs: int = 2
    seed: str = "mix-1"


#: The plan of the query: languages by need, the large source held back, half of the corpus' tokens.
PLAN = MixPlan(weights={"web": 2, "books": 3, "web/en": 4, "web/de": 2, "web/fr": 2, "books/en": 4}, budget_percent=50, epochs=2)
#: The pipeline's plan: each document at most once, most tokens stay.
PIPELINE_PLAN = MixPlan(weights={"web": 3, "books": 2, "web/en": 4, "web/de": 2, "web/fr": 2, "books/en": 4}, budget_percent=80, epochs=1)


def tokens(text: Column) -> Column:
    """White-space-separated words of a text: bounds between a space and another character."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def domain(source: Column) -> Column:
    """The domain of a source: the crawl source src0 is web, the numbered others are books."""
    return F.when(source == "src0", "web").otherwise("books")


def _weight(path: Column, plan: MixPlan) -> Column:
    """The weight of a branch; the plan's names are few, as people write them."""
    if not plan.weights:
        return F.lit(plan.default_weight).cast("long")
    named = F.create_map(*[F.lit(x) for kv in plan.weights.items() for x in kv])
    return F.coalesce(F.try_element_at(named, path), F.lit(plan.default_weight)).cast("long")


def share_out(nodes: DataFrame, parent: str, name: str) -> DataFrame:
    """nodes with `given`: each one's part of its parent's `budget` (columns capacity, weight, budget)."""
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(parent).orderBy(ratio, name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(parent)
    usable = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)
    left = F.col("budget") - F.coalesce(F.sum(usable).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    marked = nodes.withColumn("_usable", usable).withColumn("_left", left).withColumn("_weights", weight_left).withColumn("_rank", F.row_number().over(order))
    full = (F.col("_weights") <= 0) | (F.col("_usable").cast("decimal(38,0)") * F.col("_weights") <= F.col("_left").cast("decimal(38,0)") * F.col("weight"))
    marked = marked.withColumn("_open", F.when(~full, F.col("_rank"))).withColumn("_first", F.min("_open").over(everyone))
    at_first = lambda c: F.max(F.when(F.col("_rank") == F.col("_first"), F.col(c))).over(everyone)
    marked = marked.withColumn("_rest", at_first("_left")).withColumn("_sum", at_first("_weights"))
    part = F.floor(F.col("_rest").cast("decimal(30,0)") * F.col("weight").cast("decimal(7,0)") / F.col("_sum")).cast("long")
    given = F.when(F.col("_first").isNull() | (F.col("_rank") < F.col("_first")), F.col("_usable")).otherwise(F.least(F.greatest(part, F.lit(0)), F.col("_usable")))
    return marked.withColumn("given", given.cast("long")).drop("_usable", "_left", "_weights", "_rank", "_open", "_first", "_rest", "_sum")


def budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """leaf rows (domain, lang, source, leaf_tokens) with each leaf's budget."""
    can = F.col("leaf_tokens") * plan.epochs
    sized = leaves.withColumn("capacity", can)
    path_l, path_s = F.concat_ws("/", "domain", "lang"), F.concat_ws("/", "domain", "lang", "source")
    total = sized.agg(F.floor(F.sum("leaf_tokens") * plan.budget_percent / 100).cast("long").alias("wanted"))
    domains = sized.groupBy("domain").agg(F.sum("capacity").alias("capacity")).crossJoin(F.broadcast(total))  # one row
    domains = domains.select("domain", "capacity", _weight(F.col("domain"), plan).alias("weight"), F.col("wanted").alias("budget"), F.lit(0).alias("root"))
    domains = share_out(domains, "root", "domain").select("domain", F.col("given").alias("budget"))
    langs = sized.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(domains, "domain")
    langs = langs.withColumn("weight", _weight(path_l, plan))
    langs = share_out(langs, "domain", "lang").select("domain", "lang", F.col("given").alias("budget"))
    lowest = sized.join(langs, ["domain", "lang"]).withColumn("weight", _weight(path_s, plan)).withColumn("branch", path_l)
    return share_out(lowest, "branch", "source").select("domain", "lang", "source", "leaf_tokens", F.col("given").alias("leaf_budget"))


def bucket_digits(documents: int, least: int = BUCKET_DIGITS) -> int:
    """Hex digits that name a bucket, so that a leaf of so many documents has as many buckets as documents in each, or more."""
    digits = least
    while 16 ** (2 * digits) < documents:
        digits += 1
    return digits


def select(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """The taken documents of sizes (doc_id, lang, source, n_tokens and, if wanted, row), a row for each epoch that takes one.

    Returns domain, lang, source, doc_id, n_tokens, epoch and end_token, the leaf's tokens up to the document's end.
    """
    more = [c for c in sizes.columns if c == "row"]
    named = sizes.select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), "n_tokens", *more)
    named = checkpointed(named.withColumn("domain", domain(F.col("source"))))
    leaf = ["domain", "lang", "source"]
    leaves = checkpointed(named.groupBy(*leaf).agg(F.sum("n_tokens").alias("leaf_tokens"), F.count("*").alias("leaf_documents")))
    digits = bucket_digits(leaves.agg(F.max("leaf_documents")).first()[0] or 0)
    shares = checkpointed(budgets(leaves, plan))
    order_hash = F.md5(F.concat_ws("|", F.lit(plan.seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    laid = named.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(plan.epochs)))).withColumn("place", order_hash)
    laid = laid.withColumn("bucket", F.substring("place", 1, digits))
    key = [*leaf, "epoch", "bucket"]
    sums = laid.groupBy(*key).agg(F.sum("n_tokens").alias("held"))
    before = Window.partitionBy(*leaf, "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("earlier", F.coalesce(F.sum("held").over(before), F.lit(0))).join(shares, leaf)
    sums = sums.withColumn("earlier", F.col("earlier") + (F.col("epoch") - 1) * F.col("leaf_tokens")).where(F.col("earlier") < F.col("leaf_budget"))
    inside = Window.partitionBy(*key).orderBy("place", "n_tokens", *more)
    reached = laid.join(sums.select(*key, "earlier", "leaf_budget"), key)
    ended = reached.withColumn("end_token", F.col("earlier") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return ended.where((F.col("end_token") <= F.col("leaf_budget")) & (F.col("end_token") - F.col("n_tokens") < F.col("leaf_budget"))).select(*leaf, "doc_id", "n_tokens", F.col("epoch").cast("int").alias("epoch"), "end_token", *more)


def mixed_documents(docs: DataFrame, plan: MixPlan = PLAN) -> DataFrame:
    return select(docs.select("doc_id", "lang", "source", tokens(F.col("text")).alias("n_tokens")), plan)


def keep_mix(docs: DataFrame, plan: MixPlan = PIPELINE_PLAN) -> DataFrame:
    """The documents, all columns kept, that the plan takes: rows with equal or no ids each by their texts, repeated rows together."""
    text_hash = fresh(docs, "text_hash")
    named = docs.withColumn(text_hash, F.xxhash64("text"))
    taken = select(named.select("doc_id", "lang", "source", tokens(F.col("text")).alias("n_tokens"), F.col(text_hash).alias("row")), plan).select("doc_id", "row").distinct()
    taken_id, taken_row = fresh(docs, "taken_id"), fresh(docs, "taken_row")
    taken = taken.toDF(taken_id, taken_row)
    kept = named.join(taken, F.col("doc_id").eqNullSafe(F.col(taken_id)) & (F.col(text_hash) == F.col(taken_row)), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents"))


def _sql_share(source: str, parent: str, name: str, rest: str) -> str:
    """DuckDB's form of share_out: `source` has capacity, weight, budget and the parent's and node's names."""
    return f"""
      SELECT {rest}, CASE WHEN first_open IS NULL OR rk < first_open THEN usable
                          ELSE least(greatest(CAST(floor(CAST(rest AS HUGEINT) * weight // wsum) AS BIGINT), 0), usable) END AS given
      FROM (SELECT *, max(CASE WHEN rk = first_open THEN lft END) OVER (PARTITION BY {parent}) AS rest,
                   max(CASE WHEN rk = first_open THEN wleft END) OVER (PARTITION BY {parent}) AS wsum
            FROM (SELECT *, min(CASE WHEN NOT (wleft <= 0 OR CAST(usable AS HUGEINT) * wleft <= CAST(lft AS HUGEINT) * weight) THEN rk END) OVER (PARTITION BY {parent}) AS first_open
                  FROM (SELECT *, budget - coalesce(sum(usable) OVER w, 0) AS lft,
                               sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER w, 0) AS wleft,
                               row_number() OVER (PARTITION BY {parent} ORDER BY ratio, {name}) AS rk
                        FROM (SELECT *, CASE WHEN weight > 0 THEN capacity ELSE 0 END AS usable,
                                     CASE WHEN weight > 0 THEN capacity / weight ELSE 'Infinity'::DOUBLE END AS ratio FROM ({source}))
                        WINDOW w AS (PARTITION BY {parent} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))"""


def mix_sql(plan: MixPlan = PLAN, docs: str = "documents") -> str:
    """The same selection in DuckDB's SQL: (domain, lang, source, doc_id, n_tokens, epoch, end_token)."""

    def weight(path: str) -> str:
        return "CASE " + path + "".join(f" WHEN '{k}' THEN {v}" for k, v in plan.weights.items()) + f" ELSE {plan.default_weight} END"

    path_l, path_s = "concat_ws('/', domain, lang)", "concat_ws('/', domain, lang, source)"
    return f"""
    WITH named AS (
      SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
             CASE WHEN coalesce(source, 'none') = 'src0' THEN 'web' ELSE 'books' END AS domain,
             CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS BIGINT) AS n_tokens
      FROM {docs}),
    leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS leaf_tokens, CAST(sum(n_tokens) * {plan.epochs} AS BIGINT) AS capacity FROM named GROUP BY ALL),
    total AS (SELECT CAST(floor(sum(leaf_tokens) * {plan.budget_percent} / 100) AS BIGINT) AS wanted FROM leaves),
    d AS ({_sql_share(f"SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, {weight('domain')} AS weight, any_value(wanted) AS budget, 0 AS root FROM leaves, total GROUP BY domain", "root", "domain", "domain")}),
    l AS ({_sql_share(f"SELECT domain, lang, CAST(sum(capacity) AS BIGINT) AS capacity, {weight(path_l)} AS weight, any_value(given) AS budget FROM leaves JOIN d USING (domain) GROUP BY domain, lang", "domain", "lang", "domain, lang")}),
    s AS ({_sql_share(f"SELECT domain, lang, source, leaf_tokens, capacity, {weight(path_s)} AS weight, given AS budget FROM leaves JOIN l USING (domain, lang)", "domain, lang", "source", "domain, lang, source, leaf_tokens")}),
    laid AS (SELECT *, md5(concat_ws('|', '{plan.seed}', CAST(epoch AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS place
             FROM named, (SELECT unnest(range(1, {plan.epochs + 1})) AS epoch)),
    ended AS (SELECT *, (epoch - 1) * leaf_tokens + sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, n_tokens ROWS UNBOUNDED PRECEDING) AS end_token
              FROM laid JOIN s USING (domain, lang, source))
    SELECT domain, lang, source, doc_id, n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(end_token AS BIGINT) AS end_token
    FROM ended WHERE end_token <= given AND end_token - n_tokens < given"""
