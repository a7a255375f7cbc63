"""The filter interaction audit against a plain run of each order, and against its SQL."""

import re
from itertools import permutations

import duckdb

from lanewise.llm import filter_audit
from lanewise.llm.filter_audit import MEASURES, query

DOCS, LABELS = "doc_id long, text string, lang string, source string, cell long, first string", "doc_id long, quality int, toxic int, n long"


def outcomes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def brute(docs, labels):
    rows = []
    for i, text, _, source, *_ in docs:
        text = text or ""
        fails = outcomes(text)
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs)
        rows.append((source or "", fails, any(d == i and q == 1 for d, q, *_ in labels if i is not None), any(d == i and x == 1 for d, _, x, _ in labels if i is not None)))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = sum(r[1][f] for r in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step, *[r[m] for m in MEASURES]) for r in df.collect()}


def test_every_order_matches_a_plain_run(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "short", long, long + " $", long.upper(), " ".join(["same"] * 300), long, long, "short", "a\x0bb c | \U0001f600", "WORD " * 50_000, long.upper(), None]
    docs = [(i, t, None, ("s", None, "", "q")[i % 4], i, "x") for i, t in enumerate(texts)]
    docs += [docs[3], docs[3], docs[9], (None, long, None, "q", 0, ""), (None, "short", None, None, 0, ""), (3, long, None, "other", 0, ""), (8, "another text of 8", None, "s", 0, "")]
    labels = [(3, 1, 0, 1), (3, 0, 1, 1), (4, 1, None, 1), (9, None, 1, 1), (9, None, 1, 1), (None, 1, 1, 1), (77, 1, 1, 1), (5, 2, 3, 1)]
    got = filter_audit.filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert got.count() == 600 * 4 and rows_of(got) == brute(docs, labels)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "x", None, "s", 0, "")], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(none, labels).collect() == []
    assert rows_of(filter_audit.filter_audit(some, labels)) == brute([(1, "x", None, "s")], [])


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(filter_audit.SQL)
    assert want.columns == ["part", "filter_order", "step", *MEASURES]
    assert rows_of(query(spark, sf)) == set(want.fetchall())
