"""Annotation joins and input validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.gtf import keep_first


def coding(annotation: DataFrame, nc: DataFrame) -> DataFrame:
    """Annotation rows whose gene is not non-coding."""
    return annotation.join(nc.select("gene_id"), "gene_id", "left_anti")


def annotate(genes: DataFrame, annotation: DataFrame, nc: DataFrame) -> DataFrame:
    """genes with gene_name and is_nc: the first match, non-coding rows before coding ones; null where unknown."""
    both = nc.select("gene_id", "gene_name", F.lit(True).alias("is_nc"), F.lit(0).alias("side")).unionByName(coding(annotation, nc).select("gene_id", "gene_name", F.lit(False).alias("is_nc"), F.lit(1).alias("side")))
    return genes.join(keep_first(both, "gene_id", "side", "gene_name").drop("side"), "gene_id", "left")


def gene_summary(genes: DataFrame, annotation: DataFrame, nc: DataFrame, modules: DataFrame, connectivity: DataFrame, dge: DataFrame, stability: DataFrame | None = None, cut: float = 0.0, cut_scale: float = 100.0) -> DataFrame:
    """One row a gene: names, module, stable flag, connectivities and differential expression."""
    x = annotate(genes.select("gene_id"), annotation, nc).join(modules, "gene_id", "left")
    if stability is None:
        x = x.withColumn("stable", F.lit(True))
    else:
        x = x.join(stability, "gene_id", "left").withColumn("stable", F.coalesce(F.col("stability") > cut / cut_scale, F.lit(False))).drop("stability")
    first = keep_first(dge.select("gene_id", "log2fc", "pval"), "gene_id", "log2fc", "pval")
    return x.join(connectivity, "gene_id", "left").join(first, "gene_id", "left")


def map_symbols(genes: DataFrame, symbols: DataFrame) -> DataFrame:
    """genes with entrez_id, a row for each id of symbols (symbol, entrez_id) that the gene_name has; null for none."""
    return genes.join(symbols.select(F.col("symbol").alias("gene_name"), "entrez_id").distinct(), "gene_name", "left").select(*genes.columns, "entrez_id")


#: The columns that each table has to begin with, in order.
COLUMNS = {"annotation": ["gene_id", "gene_name"], "nc": ["gene_id", "gene_name"], "traits": ["sample_ord", "trait"], "dge": ["gene_id", "log2fc", "pval"]}


def violations(counts: DataFrame, annotation: DataFrame | None, traits: DataFrame | None, dge: DataFrame | None, symbols: DataFrame | None = None, nc: DataFrame | None = None) -> DataFrame:
    """(rule, detail, n): one row for each rule that the inputs break.

    A missing table or column, columns in another order, and a trait that is no number are rows; rules on
    rows are checked where the columns they need are there. nc is checked if given.
    """
    spark = counts.sparkSession
    found, tables = [], {"annotation": annotation, "traits": traits, "dge": dge} | ({"nc": nc} if nc is not None else {})
    for name, df in tables.items():
        wanted = COLUMNS[name]
        missing = wanted if df is None else [c for c in wanted if c not in df.columns]
        if df is None:
            found.append((f"{name} missing", name, 1))
        elif missing:
            found.append((f"{name} columns", ", ".join(missing), len(missing)))
        elif df.columns[: len(wanted)] != wanted:
            found.append((f"{name} column order", ", ".join(df.columns[: len(wanted)]), len(wanted)))
    if traits is not None and "trait" in traits.columns and not isinstance(traits.schema["trait"].dataType, T.NumericType):
        found.append(("trait is no number", traits.schema["trait"].dataType.simpleString(), 1))
    frames = [spark.createDataFrame(found, "rule string, detail string, n bigint")] if found else []

    def absent(rule: str, left: DataFrame | None, right: DataFrame | None, key: str) -> None:
        if left is not None and right is not None and key in left.columns and key in right.columns:
            gone = left.select(key).distinct().join(right.select(key), key, "left_anti")
            frames.append(gone.agg(F.lit(rule).alias("rule"), F.min(key).cast("string").alias("detail"), F.count("*").alias("n")).where("n > 0"))

    absent("count gene without annotation", counts, annotation, "gene_id")
    absent("count sample without trait", counts, traits, "sample_ord")
    absent("differential gene without annotation", dge, annotation, "gene_id")
    if symbols is not None and annotation is not None and "gene_name" in annotation.columns:
        names = annotation.select("gene_name").distinct().join(symbols.select(F.col("symbol").alias("gene_name"), F.lit(1).alias("hit")).distinct(), "gene_name", "left")
        rate = names.agg(F.bround(100.0 * F.count("hit") / F.count("*"), 0).cast("bigint").alias("n"))
        frames.append(rate.where("n < 50").select(F.lit("symbols mapped below half").alias("rule"), F.col("n").cast("string").alias("detail"), "n"))
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], "rule string, detail string, n bigint")
