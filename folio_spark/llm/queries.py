"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm import archive, fingerprints, license_scan, media, mixing, ngram_join, packing, quality, secret_scan, toxicity
from folio_spark.session import scratch, ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_classes(_read(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return media.interleave(pages, media.page_payloads(pages))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), mixing.TARGETS)


def op6_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = archive.write_archives(_read(spark, sf_dir, "pages"), scratch(spark, "archives"))
    folder = scratch(spark, "archive_paths")
    paths.write.parquet(folder)
    rows = archive.read_archives(spark.read.schema(paths.schema).parquet(folder).repartition(F.col("path")))
    return rows.select("page_id", "url", "html", "sha256", F.octet_length("html").cast("long").alias("n_bytes"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_license_scan, op3_fingerprints, op4_media_columns, op5_mixing, op6_web_archive, op7_quality, op8_toxicity, op9_ngram_join, op10_packing)}
SQL = {"op6_web_archive": archive.SQL, "op10_packing": packing.SQL.format(docs="documents")}
