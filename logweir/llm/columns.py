"""Small shared pieces of the operators: tables, column names, text columns."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL's translate() does with these what ASCII lower-casing does.
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def with_result(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with result columns; one of the same name that was there before is replaced."""
    new = {k.lower() for k in columns}
    return df.select(*[col(df, c) for c in df.columns if c.lower() not in new], *[v.alias(k) for k, v in columns.items()])


def utf8_length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""
