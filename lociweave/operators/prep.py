"""Expression preparation: filters, dispersion gates, the log transform and sample distances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise

#: What makes a median absolute deviation consistent with a standard deviation of normal data.
MAD_SCALE = 1.4826


def filter_low_expression(counts: DataFrame, least: float = 1.0, n_samples: int | None = None, skip_first_sample: bool = True) -> DataFrame:
    """Rows of genes with more than ceil((n - 1) / 4) samples above `least`; the first sample is not counted by default.

    n_samples: known number of samples; counted from the data where not given.
    """
    n = counts.select("sample_ord").distinct().count() if n_samples is None else n_samples
    seen = counts.where("sample_ord > 0") if skip_first_sample else counts
    kept = seen.groupBy("gene_id").agg(F.count_if(F.col("cnt") > least).alias("n")).where(F.col("n") > math.ceil((n - 1) / 4))
    return counts.join(kept.select("gene_id"), "gene_id", "left_semi")


def differential_genes(dge: DataFrame, p: float = 0.01, fc: float = 1.0) -> DataFrame:
    """Rows with pval < p and |log2fc| > fc; nulls never pass."""
    return dge.where((F.col("pval") < p) & (F.abs("log2fc") > fc))


def gene_sd(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gene_id").agg(F.stddev_samp("cnt").alias("sd"))


def sd_gate(counts: DataFrame, deg: DataFrame, quantile: float = 0.01) -> DataFrame:
    """(gene_id, sd, threshold) of all genes whose deviation exceeds the given quantile of that of the differential genes.

    Genes that are not differential stay if they vary as much; without differential genes nothing stays.
    """
    sd = gene_sd(counts)
    threshold = sd.join(deg.select("gene_id"), "gene_id", "left_semi").agg(F.percentile("sd", F.lit(quantile)).alias("threshold"))
    return sd.join(F.broadcast(threshold), F.col("sd") > F.col("threshold"))  # one row


def gene_mad(counts: DataFrame, skip_first_sample: bool = True) -> DataFrame:
    """(gene_id, mad): scaled median absolute deviation; the first sample is left out by default."""
    seen = counts.where("sample_ord > 0") if skip_first_sample else counts
    x = seen.groupBy("gene_id").agg(F.sort_array(F.collect_list("cnt")).alias("x")).withColumn("med", _middle("x"))
    apart = x.select("gene_id", F.sort_array(F.transform("x", lambda v: F.abs(v - F.col("med")))).alias("d"))
    return apart.select("gene_id", (F.lit(MAD_SCALE) * _middle("d")).alias("mad"))


def _middle(column: str) -> Column:
    """The median of a sorted array; null for an empty one."""
    n, x = F.size(column), F.col(column)
    lo, hi = F.get(x, F.floor((n - 1) / 2).cast("int")), F.get(x, F.floor(n / 2).cast("int"))
    return F.when(n > 0, lo + (hi - lo) * 0.5)


def top_variable(counts: DataFrame, top: int = 5000) -> DataFrame:
    """(gene_id, mad) of the genes with the largest deviations; ties go to the smaller id."""
    return gene_mad(counts).where("mad is not null").orderBy(F.desc("mad"), "gene_id").limit(top)


def log_cpm(counts: DataFrame, library_axis: str = "gene") -> DataFrame:
    """(gene_id, sample_ord, value): log2((c + 0.5) / (total + 1) * 1e6), with totals by gene, or by sample."""
    if library_axis not in ("gene", "sample"):
        raise ValueError("library_axis is 'gene' or 'sample'")
    key = "gene_id" if library_axis == "gene" else "sample_ord"
    totals = counts.groupBy(key).agg(F.sum("cnt").alias("total"))
    return counts.join(totals, key).select("gene_id", "sample_ord", F.log2((F.col("cnt") + 0.5) / (F.col("total") + 1.0) * 1e6).alias("value"))


def prepare(counts: DataFrame, dge: DataFrame, method: str = "DEG", p: float = 0.01, fc: float = 1.0, top: int = 5000, least: float = 1.0, n_samples: int | None = None) -> DataFrame:
    """Filtered, log-transformed expression (gene_id, sample_ord, value)."""
    kept = materialise(filter_low_expression(counts, least, n_samples), "kept")  # read several times below
    if method == "DEG":
        genes = sd_gate(kept, differential_genes(dge.join(kept.select("gene_id").distinct(), "gene_id", "left_semi"), p, fc)).select("gene_id")
    elif method == "var":
        genes = top_variable(kept, top).select("gene_id")
    else:
        raise ValueError("method is 'DEG' or 'var'")
    return log_cpm(kept.join(genes, "gene_id", "left_semi"))


def sample_distance(expr: DataFrame) -> DataFrame:
    """(s, t, distance) for s < t: Euclidean distances over all genes that both samples have.

    Each task sums squared differences for all pairs of samples over its genes, so the shuffle
    carries a square of samples for each task, not pairs of values.
    """
    genes = expr.groupBy("gene_id").agg(F.collect_list("sample_ord").alias("s"), F.collect_list("value").alias("v")).select("s", "v")

    def sums(batches):
        total = {}
        for frame in batches:
            lengths = [len(s) for s in frame["s"]]
            if not sum(lengths):
                continue
            samples, at = np.unique(np.concatenate(frame["s"].to_list()).astype(np.int64), return_inverse=True)
            x = np.full((len(frame), len(samples)), np.nan)
            x[np.repeat(np.arange(len(frame)), lengths), at] = np.concatenate(frame["v"].to_list())
            for i, s in enumerate(samples[:-1].tolist()):
                d = x[:, i + 1 :] - x[:, i : i + 1]
                both = ~np.isnan(d).all(0)
                for t, q in zip(samples[i + 1 :][both].tolist(), np.nansum(d[:, both] ** 2, 0).tolist()):
                    total[s, t] = total.get((s, t), 0.0) + q
        yield pd.DataFrame([(s, t, q) for (s, t), q in total.items()], columns=["s", "t", "q"])

    parts = genes.mapInPandas(sums, "s bigint, t bigint, q double")
    return parts.groupBy("s", "t").agg(F.sqrt(F.sum("q")).alias("distance"))
