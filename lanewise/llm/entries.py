"""The operators' queries and, where SQL can say them, their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, html_density, langid_ppm, mixing, mpegts, packing, quality, simhash, token_alignment, toxicity, url_templates, va_topk, warc_bundles
from .common import table


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_ppm.language_of_documents(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_html_density": html_density.query,
        "op2_ordinal_quality": op2,
        "op3_url_templates": url_templates.query,
        "op4_va_topk": va_topk.query,
        "op5_mpegts_media": mpegts.query,
        "op6_best_fit_packing": packing.query,
        "op7_ppm_language": op7,
        "op8_warc_bundles": warc_bundles.query,
        "op9_simhash_pigeonring": simhash.query,
        "op10_source_mixing": mixing.query,
        "op11_filter_audit": filter_audit.query,
        "op12_token_alignment": token_alignment.query,
        "op13_toxicity": toxicity.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_templates": url_templates.url_sql(), "op4_va_topk": va_topk.SQL, "op8_warc_bundles": warc_bundles.SQL, "op10_source_mixing": mixing.mix_sql(), "op11_filter_audit": filter_audit.SQL}
