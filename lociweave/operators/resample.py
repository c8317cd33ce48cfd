"""Leave-group-out resampling: assignment, module matching and stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_groups(genes: DataFrame, n: int, order: Column | None = None, seed: int = 0) -> DataFrame:
    """(gene_id, iter): each gene is held out of one of n iterations, groups of equal size.

    Genes are ranked by a seeded hash, or by `order`. The rank comes from counts by hash prefix, so
    no task sorts all genes.
    """
    key = F.xxhash64("gene_id", F.lit(seed)) if order is None else order
    x = genes.select("gene_id", key.alias("key")).withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(256)) if order is None else F.floor(F.col("key") / 64))
    inside = Window.partitionBy("slot").orderBy("key", "gene_id")
    before = x.groupBy("slot").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = x.withColumn("own", F.row_number().over(inside)).join(before.drop("count"), "slot")
    return ranked.select("gene_id", ((F.col("before") + F.col("own") - 1) % n + 1).cast("int").alias("iter"))


def match_modules(labels: DataFrame) -> DataFrame:
    """(module, iter, matched): the label of each iteration that shares most genes with each module of iter 0.

    Label 0 is a candidate; ties go to the label met first by gene id in the iteration; matched is
    null where no label overlaps.
    """
    full = labels.where("iter = 0 and module is not null").select("gene_id", F.col("module").alias("base"))
    others = labels.where("iter > 0 and module is not null")
    first = others.groupBy("iter", "module").agg(F.min("gene_id").alias("first_seen"))
    overlap = others.join(full, "gene_id").groupBy("base", "iter", "module").agg(F.count("*").alias("n")).join(first, ["iter", "module"])
    best = overlap.groupBy("base", "iter").agg(F.min(F.struct(-F.col("n"), "first_seen", "module"))["module"].alias("matched"))
    every = full.select("base").distinct().join(F.broadcast(labels.where("iter > 0").select("iter").distinct().agg(F.collect_list("iter").alias("iters"))))  # one row of iteration numbers
    return every.select("base", F.explode("iters").alias("iter")).join(best, ["base", "iter"], "left").select(F.col("base").alias("module"), "iter", "matched")


def _kept(labels: DataFrame, matches: DataFrame) -> DataFrame:
    """(gene_id, module, iter, hit): whether a gene's label in an iteration is the match of its module."""
    full = labels.where("iter = 0 and module is not null").select("gene_id", F.col("module").alias("base"))
    x = labels.where("iter > 0").join(full, "gene_id").join(matches.select(F.col("module").alias("base"), "iter", "matched"), ["base", "iter"], "left")
    return x.select("gene_id", F.col("base").alias("module"), "iter", F.coalesce(F.col("module") == F.col("matched"), F.lit(False)).cast("int").alias("hit"))


def module_stability(labels: DataFrame, matches: DataFrame) -> DataFrame:
    """(module, iter, ratio): share of a module's genes that carry its match; module 0 is left out."""
    return _kept(labels, matches).where("module <> 0").groupBy("module", "iter").agg((F.sum("hit") / F.count("*")).alias("ratio"))


def gene_stability(labels: DataFrame, matches: DataFrame, exclude_heldout: bool = False) -> DataFrame:
    """(gene_id, stability): share of iterations in which a gene stays with its module; held-out iterations count by default."""
    x = _kept(labels, matches)
    if exclude_heldout:
        x = x.join(labels.where("module is null").select("gene_id", "iter"), ["gene_id", "iter"], "left_anti")
    return x.groupBy("gene_id").agg((F.sum("hit") / F.count("*")).alias("stability"))


def cumulative(stability: DataFrame) -> DataFrame:
    """(cutoff, n_genes) with stability below k * 0.1, for k from 0 to 10, in one pass."""
    cuts = F.array(*(F.struct(F.lit(k * 0.1).alias("cutoff"), (F.col("stability") < F.lit(k * 0.1)).cast("bigint").alias("below")) for k in range(11)))
    return stability.select(F.explode(cuts).alias("c")).groupBy("c.cutoff").agg(F.sum("c.below").alias("n_genes"))
