"""GTF annotation as a DataFrame of gene ids and names."""

from __future__ import annotations

import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def strip_version(column: str) -> Column:
    """The text before its first dot."""
    return F.regexp_replace(column, r"\..*$", "")


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def read_gtf(spark: SparkSession, path: str, strip_names: bool = True) -> DataFrame:
    """(gene_id, gene_name), the first record of each id in file order; names are null where absent."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    fields = lines.where(~F.col("value").startswith("#"))

    def attribute(name: str) -> Column:
        return F.nullif(F.regexp_extract("value", f'{name} "([^"]*)"', 1), F.lit(""))

    rows = fields.select(attribute("gene_id").alias("gene_id"), attribute("gene_name").alias("gene_name"), "file", "block", "line").where("gene_id is not null")
    rows = rows.withColumn("gene_id", strip_version("gene_id"))
    if strip_names:
        rows = rows.withColumn("gene_name", strip_version("gene_name"))
    return keep_first(rows, "gene_id", "file", "block", "line").select("gene_id", "gene_name")


def download_gtf(spark: SparkSession, link: str, to: str, timeout: float = 600.0, strip_names: bool = True) -> DataFrame:
    """read_gtf of a file fetched once, by the driver, to a path that executors can read."""
    staged = spark._jvm.org.apache.hadoop.fs.Path(to)
    with urllib.request.urlopen(link, timeout=timeout) as source:
        out = staged.getFileSystem(spark._jsc.hadoopConfiguration()).create(staged, True)
        try:
            while part := source.read(1 << 20):
                out.write(bytearray(part))
        finally:
            out.close()
    return read_gtf(spark, to, strip_names)


def read_gmt(spark: SparkSession, path: str, source: str = "GMT") -> DataFrame:
    """(source, term_id, term_name, gene_id) of a gene-set file: term, name and genes, separated by tabs."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) > 2)
    return rows.select(F.lit(source).alias("source"), f[0].alias("term_id"), f[1].alias("term_name"), F.explode(F.slice(f, 3, F.size(f))).alias("gene_id")).where("gene_id <> ''")
