"""Delimited text sinks; nested columns become joined strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Every column as text: arrays joined by a comma and a blank, all else cast."""
    return df.select(*(F.array_join(F.col(f.name).cast("array<string>"), ", ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast("string").alias(f.name) for f in df.schema))


def write_tsv(df: DataFrame, path: str, quote: bool = False) -> None:
    """A header and tab-separated rows, one file for each partition."""
    flat(df).write.mode("overwrite").option("sep", "\t").option("quote", '"' if quote else "").option("quoteAll", quote).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def file_name(gene_name: str, suffix: str = "_connectivities.csv") -> str:
    """A default file name: the alphanumerics of a gene name, and a suffix."""
    return "".join(c for c in gene_name if c.isascii() and c.isalnum()) + suffix
