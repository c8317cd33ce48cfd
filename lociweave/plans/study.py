"""A study: input tables and parameters, and the steps from counts to enriched modules."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import student_p
from ..operators import annotate, cluster, enrich, network, prep, report, resample, similarity
from ..sources import sinks
from .storage import materialise

log = logging.getLogger("lociweave")


@dataclass(frozen=True)
class Study:
    """Tables in long form. Steps return a new study; nothing runs before an action.

    counts (gene_id, sample_ord, cnt), traits (sample_ord, trait), dge (gene_id, log2fc, pval),
    annotation and nc (gene_id, gene_name), expr (gene_id, sample_ord, value).
    """

    counts: DataFrame | None = None
    dge: DataFrame | None = None
    traits: DataFrame | None = None
    annotation: DataFrame | None = None
    nc: DataFrame | None = None
    expr: DataFrame | None = None
    labels: DataFrame | None = None
    stability: DataFrame | None = None
    summary: DataFrame | None = None
    tom: DataFrame | None = None
    power: float | None = None
    height: float | None = None
    cut: float = 0.0
    parameters: dict = field(default_factory=dict)

    def check(self, symbols: DataFrame | None = None) -> DataFrame:
        return annotate.violations(self.counts if self.counts is not None else self.expr, self.annotation, self.traits, self.dge, symbols, self.nc)

    def filter_transform(self, p: float = 0.01, fc: float = 1.0, top: int = 5000, method: str = "DEG") -> Study:
        return replace(self, expr=prep.prepare(self.counts, self.dge, method, p, fc, top))

    def sample_tree(self) -> DataFrame:
        return cluster.sample_tree(prep.sample_distance(self.expr))

    def cut_outliers(self, height: float | None = None) -> Study:
        samples = self.expr.select("sample_ord").distinct()
        kept = materialise(cluster.keep_samples(prep.sample_distance(self.expr), height, samples=samples).where("keep").select("sample_ord"), "samples")
        return replace(self, height=height, expr=self.expr.join(kept, "sample_ord", "left_semi"), traits=self.traits.join(kept, "sample_ord", "left_semi"))

    def vectors(self) -> DataFrame:
        """(gene_id, v): values in order of samples."""
        x = self.expr.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("sample_ord", "value"))).alias("x"))
        return x.select("gene_id", F.col("x.value").alias("v"))

    def scan_powers(self, powers=range(1, 21)) -> DataFrame:
        return network.scale_free_scan(network.connectivity(self.vectors(), [float(p) for p in powers]))

    def select_power(self, power: float) -> Study:
        if isinstance(power, bool) or not isinstance(power, (int, float)):
            raise ValueError("power is one number")
        return replace(self, power=float(power))

    def bootstrap(self, iterations: int = 100, seed: int = 0, least: int = 30) -> Study:
        x = self.vectors()
        held = resample.assign_groups(x, iterations, seed=seed)
        labels = cluster.detect_modules(x, self.power, "pearson", least, held_out=held, iterations=iterations)
        labels = materialise(labels, "labels")
        return replace(self, labels=labels, stability=resample.gene_stability(labels, resample.match_modules(labels)))

    def set_cut(self, cut: float) -> Study:
        if isinstance(cut, bool) or not isinstance(cut, (int, float)) or not 0 <= cut <= 1:
            raise ValueError("cut is a number from 0 to 1")
        return replace(self, cut=float(cut))

    def summarise(self, kind: str = "bicor", least: int = 30, merge: float = 0.3, cut_scale: float = 100.0, path: str | None = None) -> Study:
        """The gene summary and the overlaps, as tables; the summary goes to path as TSV, whatever comes after."""
        if self.power is None:
            raise ValueError("select_power comes first")
        log.info("detecting modules")
        x = materialise(self.vectors(), "vectors")
        modules = materialise(cluster.detect_modules(x, self.power, kind, least, merge).select("gene_id", "module"), "modules")
        log.info("connectivity and summary")
        k = network.intramodular(x, modules, self.power)
        summary = materialise(annotate.gene_summary(x, self.annotation, self.nc, modules, k, self.dge, self.stability, self.cut, cut_scale), "summary")
        log.info("%d genes in %d modules", summary.count(), summary.where("module <> 0").select("module").distinct().count())
        if path is not None:
            sinks.write_tsv(summary, path)
        log.info("topological overlap")
        return replace(self, summary=summary, tom=materialise(network.topological_overlap(x, self.power), "overlap"))

    def ranked(self) -> DataFrame:
        """(gene_id, module, rank): the stable genes of each module in order of their ids."""
        rank = F.row_number().over(Window.partitionBy("module").orderBy("gene_id"))
        return self.summary.where("stable").select("gene_id", "module", rank.alias("rank"))

    def enrich(self, sets: DataFrame, most: float | None = None) -> DataFrame:
        """Ordered over-representation of each module, with adjusted p; those of at most `most` where given."""
        tests = enrich.benjamini_hochberg(enrich.enrichment_ordered(self.ranked(), sets))
        return tests if most is None else enrich.significant(tests, most)

    def submodules(self, reduced: DataFrame, sets: DataFrame, path: str | None = None) -> tuple[Study, DataFrame]:
        """The study with submodules in its summary, and the non-coding genes of each; reduced: what reduce_terms gave."""
        modules = self.summary.where("stable").select("gene_id", "module")
        sub = materialise(enrich.submodule_genes(reduced, sets, modules), "submodules")
        pairs = network.both_ways(similarity.adjacency(similarity.correlations(self.vectors()), self.power))
        found = enrich.connected_nc(sub, pairs, self.summary.where("stable").select("gene_id", "gene_name", F.coalesce("is_nc", F.lit(False)).alias("is_nc"), "log2fc", "pval"), modules)
        summary = enrich.submodule_lists(self.summary, sub)
        if path is not None:
            sinks.write_tsv(summary, path)
        return replace(self, summary=summary), found

    def heatmap(self, module: int, top: int, remove_non_deg: bool = False, submodule: int | None = None, path: str | None = None) -> DataFrame:
        """Cells of a module's heatmap; its genes go to path as TSV."""
        if not isinstance(remove_non_deg, bool):
            raise ValueError("remove_non_deg is True or False")
        if path is not None and not isinstance(path, str):
            raise ValueError("path is a text")
        genes = self.summary.withColumnRenamed("kWithin", "k")
        known = [r[0] for r in report.modules_of(genes).collect()]
        if module not in known:
            raise ValueError(f"no module {module!r}; there are {known}")
        if submodule is not None:
            names = sorted({r[0] for r in genes.where(F.col("module") == module).select(F.explode("submodules")).distinct().collect()}) if "submodules" in genes.columns else []
            if submodule not in names:
                raise ValueError(f"no submodule {submodule!r} in module {module!r}; there are {names}")
        cells = report.heatmap(self.tom, genes, module, top, remove_non_deg, submodule)
        if path is not None:
            sinks.write_tsv(report.heatmap_table(genes, cells, remove_non_deg).drop("place"), path, quote=True)
        return cells

    def trait_correlations(self) -> DataFrame:
        modules = self.summary.where("stable").select("gene_id", "module")
        found = cluster.trait_correlation(cluster.eigengenes(self.vectors(), modules), self.traits)
        return found.withColumn("p", student_p(F.col("corr"), F.col("n").cast("double")))

    def bars(self) -> DataFrame:
        return report.module_bars(self.summary.select("gene_id", "module", "is_nc"), self.trait_correlations())

    def neighbours(self, name: str, n: int | None = 100, path: str | None = None) -> DataFrame:
        """The best neighbours of a non-coding gene, with annotation; they go to path as CSV."""
        if not isinstance(name, str):
            raise ValueError("name is a text")
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 1):
            raise ValueError("n is a positive number of genes, or None for all")
        if path is not None and not isinstance(path, str):
            raise ValueError("path is a text")
        if self.summary is None or self.tom is None:
            raise ValueError("summarise comes first")
        gene = report.resolve_name(self.summary, name)
        found = report.neighbourhood_table(report.neighbourhood(self.tom, self.summary.select("gene_id", "module"), gene, n), self.summary)
        if path is not None:
            sinks.write_csv(found, path)
        return found

    def associate(self, name: str, sets: DataFrame, n: int = 100, nodes: int = 25, most: float = 0.05, path: str | None = None, terms_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Guilt by association for one non-coding gene: (neighbours, enriched terms, nodes, edges).

        The neighbours, best first, are one ordered query against the genes of the summary; the network is
        that of the best `nodes` of them, each with the terms that hold it.
        """
        for value, what in ((nodes, "nodes"), (n, "n")):
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{what} is a positive integer")
        if isinstance(most, bool) or not isinstance(most, (int, float)) or not 0 < most <= 1:
            raise ValueError("most is a number above 0, at most 1")
        near = materialise(self.neighbours(name, n, path), "neighbours")
        place = F.row_number().over(Window.orderBy(F.desc("connectivity"), "gene_id"))  # at most n rows
        ranks = near.select("gene_id", place.alias("rank"))
        asked = self.summary.select("gene_id").join(ranks, "gene_id", "left").select("gene_id", F.when(F.col("rank").isNotNull(), 1).otherwise(0).alias("module"), F.coalesce("rank", F.lit(0)).alias("rank"))
        terms = materialise(enrich.significant(enrich.benjamini_hochberg(enrich.enrichment_ordered(asked, sets)), most), "terms")
        if terms_path is not None:
            sinks.write_csv(terms, terms_path)
        shown = ranks.where(F.col("rank") <= nodes).select("gene_id", (F.col("rank") - 1).alias("rank"))
        held = sets.join(terms.select("term_id"), "term_id", "left_semi")
        placed = report.layout(shown).join(report.membership(shown.select("gene_id"), held), "gene_id")
        return near, terms, placed, report.subnetwork(self.tom, shown, self.summary.count())
