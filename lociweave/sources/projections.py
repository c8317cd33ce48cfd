"""The driver's tables seen as the engine's inputs: counts, traits, annotation, vectors, labels, gene sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, sample_ord, cnt): a gene is a part, a sample a quarter of shipping, the count the quantity, with zeros filled in.

    A gene's samples are summed side by side, so one shuffle by gene and a join of one row a gene do.
    """
    shipped = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("q"))
    first, last = shipped.agg(F.min("q"), F.max("q")).first()
    if first is None:
        first = last = 0
    wide = shipped.groupBy(F.col("l_partkey").alias("gene_id")).agg(*(F.sum(F.when(F.col("q") == q, F.col("l_quantity"))).alias(f"s{q - first}") for q in range(first, last + 1)))
    every = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id")).join(wide, "gene_id", "left")
    samples = F.array(*(F.coalesce(f"s{i}", F.lit(0.0)) for i in range(last - first + 1)))
    return every.select("gene_id", F.posexplode(samples).alias("sample_ord", "cnt")).select("gene_id", F.col("sample_ord").cast("bigint").alias("sample_ord"), "cnt")


def differential(c: DataFrame) -> DataFrame:
    """(gene_id, log2fc, pval): the two halves of the samples against each other; the p-value is arithmetic."""
    late, early = (F.avg(F.when(side, F.col("cnt"))) + 0.5 for side in (F.col("sample_ord") >= 14, F.col("sample_ord") < 14))
    return c.groupBy("gene_id").agg((F.log(late / early) / F.log(F.lit(2.0))).alias("log2fc")).withColumn("pval", ((F.col("gene_id") * 7919 % 1000).cast("double") + 0.5) / 1000.0)


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, gene_name, is_nc) of parts; promotional parts play the non-coding genes."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_name"), (F.col("p_type") == "PROMO").alias("is_nc"))


def traits(c: DataFrame) -> DataFrame:
    """(sample_ord, trait) of the samples of c: 0 before sample 14, then 1."""
    return c.select("sample_ord").distinct().withColumn("trait", (F.col("sample_ord") >= 14).cast("double"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, v, module): expression vectors with a given module label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gene_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("module"))


def vector_genes(e: DataFrame) -> DataFrame:
    """(gene_id, is_nc, log2fc, pval) of vectors, with exact boundary values."""
    return e.select("gene_id", (F.col("gene_id") % 5 == 0).alias("is_nc"), ((F.col("gene_id") * 37 % 61 - 30) / F.lit(10.0)).alias("log2fc"), (((F.col("gene_id") * 7919 % 1000) + F.lit(0.5).cast("double")) / F.lit(1000.0)).alias("pval"))


def iteration_labels(spark: SparkSession, sf_dir: str, iterations: int = 20) -> DataFrame:
    """(iter, gene_id, module): labels of the full network (iter 0) and of each resampling; null where a gene was held out."""
    g = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.explode(F.sequence(F.lit(0), F.lit(iterations))).alias("iter"))
    gene, it = F.col("gene_id"), F.col("iter")
    held = (it > 0) & (gene % iterations == it - 1)
    label = F.when((gene * 31 + it * 17) % 10 < 8, (gene % 6 + it) % 6).otherwise((gene * 13 + it * 7) % 6)
    return g.select("iter", "gene_id", F.when(~held, label).cast("int").alias("module"))


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term_id, gene_id): brands, sizes and types as terms."""
    p = table(spark, sf_dir, "part")
    terms = F.array(F.concat(F.lit("B:"), "p_brand"), F.concat(F.lit("S:"), F.col("p_size").cast("string")), F.concat(F.lit("T:"), "p_type"))
    return p.select(F.explode(terms).alias("term_id"), F.col("p_partkey").alias("gene_id"))


def part_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, module) of parts, by type and parity; 0 is unassigned."""
    kind, even = F.col("p_type"), F.col("p_partkey") % 2 == 0
    label = F.when((kind == "PROMO") | (kind == "ECONOMY") & even, 1).when((kind == "SMALL") | (kind == "ECONOMY") & ~even, 2).when(kind == "LARGE", 3).otherwise(0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), label.alias("module"))
