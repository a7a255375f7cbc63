"""The pipeline end to end, and the queries that SQL can express against DuckDB."""

import duckdb
import pytest

import corpus_pipeline
from lanewise.llm import entries, langid_ppm, mixing, quality, simhash
from lanewise.llm.common import table


def test_stages_pass_columns_on(spark, sf):
    docs = table(spark, sf, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n, name
        n = docs.count()


def test_pipeline_packs_what_is_kept(spark, sf):
    docs = table(spark, sf, "documents")
    for keep in (langid_ppm.keep_known_languages, lambda d: quality.keep_good(d, table(spark, sf, "labels")), simhash.keep_one_of_each, mixing.keep_mix):
        docs = keep(docs).cache()
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entries.queries()[name](spark, sf)
    want = con.sql(entries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda r: sorted((str(x) for x in r))
    mine = rows(tuple(r[c] for c in columns) for r in got.collect())
    place = [want.columns.index(c) for c in columns]
    assert mine == rows(tuple(r[i] for i in place) for r in want.fetchall())
