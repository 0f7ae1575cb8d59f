"""One query per training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, html, langid, license, neardup, oracles, packing, pii, quality, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim overlap of all documents with the benchmark."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("longest_match", "runs")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 2-word shingles."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger and verdicts of all documents."""
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of all documents."""
    return pii.report(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    return langid.predict(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to seekable bundles and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page urls."""
    return urlfilter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents by canonical digest."""
    return license.scan(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(_table(spark, sf_dir, "pages"))


QUERIES = {"op4_warc": op4_warc, "op5_url_filters": op5_url_filters, "op7_license_scan": op7_license_scan, "op9_html_extraction": op9_html_extraction, "op6_language_id": op6_language_id, "op8_pii": op8_pii, "op3_quality_rules": op3_quality_rules, "op2_near_dedup": op2_near_dedup, "op10_decontamination": op10_decontamination, "op1_packing": op1_packing}
ORACLES: dict[str, str] = oracles.ORACLES
