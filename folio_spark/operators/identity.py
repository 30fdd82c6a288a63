"""Deterministic identifiers and fingerprints."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fingerprint(content: Column) -> Column:
    """Lower-case hex SHA-256 of bytes or of a text's UTF-8."""
    return F.sha2(content.cast("binary"), 256)


def page_fingerprint(doc: Column, page_index: Column, component: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc, page_index.cast("string"), component), 256)


def short(c: Column) -> Column:
    return F.substring(c, 1, 12)


def artifact_id(doc: Column, page_index: Column, page_print: Column) -> Column:
    return F.concat(doc, F.lit(":"), F.format_string("p%06d", page_index), F.lit(":"), short(page_print))


def block_id(page_index: Column, block_index: Column) -> Column:
    return F.format_string("p%06d:b%06d", page_index, block_index)


def image_id(page_index: Column, image_index: Column) -> Column:
    return F.format_string("p%06d:im%06d", page_index, image_index)


@F.pandas_udf(StringType())
def float_bits(x: pd.Series) -> pd.Series:
    """IEEE-754 bits of a float32 as eight hex digits: Spark can't cast FLOAT to BINARY."""
    return x.map(lambda v: None if v is None else struct.pack(">f", v).hex())


def component_hash(pages: DataFrame, texts: list[str], numbers: list[str], floats: list[str]) -> DataFrame:
    """pages with component: SHA-256 over `key NUL value LF` lines; floats by their bits, so that equal pages hash alike on any machine."""
    line = lambda k, v: F.concat(F.lit(f"{k}\0"), F.coalesce(v.cast("string"), F.lit("")), F.lit("\n"))
    parts = [line(k, F.col(k)) for k in (*texts, *numbers)] + [line(k, float_bits(F.col(k).cast("float"))) for k in floats]
    return pages.withColumn("component", F.sha2(F.concat(*parts), 256))


def corpus_fingerprint(docs: DataFrame, label: str, print_: str, pages: str, header: str = "folio-corpus-v1") -> DataFrame:
    """One row: SHA-256 over a header and one line for each document, in the labels' order."""
    row = F.struct(F.col(label).alias("l"), F.col(print_).alias("f"), F.col(pages).cast("string").alias("p"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.concat(x["l"], F.lit("\t"), x["f"], F.lit("\t"), x["p"], F.lit("\n")))
    return docs.agg(F.sha2(F.concat(F.lit(f"{header}\n"), F.array_join(lines, "")), 256).alias("corpus_fingerprint"), F.count("*").alias("documents"))


def cache_key(*parts: Column) -> Column:
    """Key of a cached artifact: schema, parser, versions, fingerprints and options."""
    return F.sha2(F.concat_ws(":", *parts), 256)
