"""Sources, sinks, joins with their quirks, the fluent study and the streaming extra."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_kernels import adjusted_rand, planted

from lociweave.operators import annotate, cluster, enrich, network, prep, report, resample, similarity
from lociweave.plans.study import Study
from lociweave.sources import gtf, sinks
from lociweave.streaming import moments


def test_gtf(spark, tmp_path):
    lines = ['#!genome', 'chr1\ta\tgene\t1\t2\t.\t+\t.\tgene_id "G1.4"; gene_name "AB.1";', 'chr1\ta\texon\t1\t2\t.\t+\t.\tgene_id "G1.5"; gene_name "ZZ";', 'chr1\ta\tgene\t1\t2\t.\t+\t.\tgene_id "G2";', 'chr1\ta\tgene\t1\t2\t.\t+\t.\tnote "none";']
    (tmp_path / "x.gtf").write_text("\n".join(lines))
    rows = {r["gene_id"]: r["gene_name"] for r in gtf.read_gtf(spark, str(tmp_path / "x.gtf")).collect()}
    assert rows == {"G1": "AB", "G2": None}
    assert gtf.read_gtf(spark, str(tmp_path / "x.gtf"), strip_names=False).where("gene_id = 'G1'").first()["gene_name"] == "AB.1"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None)], "g int, t array<string>, x double")
    sinks.write_tsv(df, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    assert text.splitlines()[0] == "g\tt\tx" and "a, b" in text
    assert sinks.file_name("LINC-01.055") == "LINC01055_connectivities.csv"


def test_low_expression_ignores_the_first_sample(spark):
    rows = [(g, s, 9.0 if (g == 1 and s < 2) or (g == 2 and 0 < s < 4) else 0.0) for g in (1, 2) for s in range(5)]
    c = spark.createDataFrame(rows, "gene_id long, sample_ord long, cnt double")
    kept = lambda **k: {r[0] for r in prep.filter_low_expression(c, **k).select("gene_id").distinct().collect()}
    assert kept() == {2} and kept(skip_first_sample=False) == {1, 2}


def test_library_axis_does_not_change_gene_correlations(spark):
    rng = np.random.default_rng(0)
    c = spark.createDataFrame([(g, s, float(v)) for g in range(4) for s, v in enumerate(rng.integers(0, 50, 8))], "gene_id long, sample_ord long, cnt double")
    x = prep.log_cpm(c).toPandas().pivot(index="gene_id", columns="sample_ord", values="value").to_numpy()
    raw = c.toPandas().pivot(index="gene_id", columns="sample_ord", values="cnt").to_numpy()
    assert np.allclose(np.corrcoef(x), np.corrcoef(np.log2(raw + 0.5)))
    with pytest.raises(ValueError):
        prep.log_cpm(c, "row")


def test_first_match_prefers_non_coding(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "a")], "gene_id long, gene_name string")
    nc = spark.createDataFrame([(1, "n")], "gene_id long, gene_name string")
    rows = {r["gene_id"]: (r["gene_name"], r["is_nc"]) for r in annotate.annotate(spark.range(1, 4).withColumnRenamed("id", "gene_id"), a, nc).collect()}
    assert rows == {1: ("n", True), 2: ("a", False), 3: (None, None)}


def test_unmatched_modules_have_ratio_zero(spark):
    rows = [(0, g, 1 if g < 4 else 2) for g in range(8)] + [(1, g, 5 if g < 4 else None) for g in range(8)]
    labels = spark.createDataFrame(rows, "iter int, gene_id long, module int")
    m = resample.match_modules(labels)
    assert {(r["module"], r["matched"]) for r in m.collect()} == {(1, 5), (2, None)}
    assert {r["module"]: r["ratio"] for r in resample.module_stability(labels, m).collect()} == {1: 1.0, 2: 0.0}


def test_groups_have_equal_size(spark):
    n = resample.assign_groups(spark.range(103).withColumnRenamed("id", "gene_id"), 10).groupBy("iter").count().toPandas()["count"]
    assert len(n) == 10 and n.max() - n.min() <= 1


def test_blocks_do_not_change_the_network(spark):
    x, _ = planted(modules=2, size=15, noise=10)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "gene_id long, v array<double>")
    whole, parts = (network.topological_overlap(e, 4.0, size=s).toPandas().sort_values(["i", "j"]) for s in (512, 9))
    assert len(whole) == 40 * 39 // 2 and np.allclose(whole["tom"], parts["tom"])
    k = [network.connectivity(e, [2.0], size=s).toPandas().sort_values("gene_id")["k"] for s in (512, 9)]
    assert np.allclose(*k)
    r = similarity.correlations(e, size=9).toPandas()
    assert np.allclose(r["r"], np.corrcoef(x)[r["i"], r["j"]])


def test_enrichment_tail_and_reduction(spark):
    modules = spark.createDataFrame([(g, 1 if g < 5 else 0) for g in range(20)], "gene_id long, module int")
    sets = spark.createDataFrame([("T", g) for g in range(5)] + [("U", g) for g in range(4, 12)], "term_id string, gene_id long")
    p = {r["term_id"]: 10 ** r["log10_p"] for r in enrich.enrichment(modules, sets).collect()}
    assert p["T"] == pytest.approx(1 / 15504) and p["U"] == pytest.approx(1 - 792 / 15504)
    assert enrich.complete_linkage_groups(np.array([[0, 0.1, 0.9], [0.1, 0, 0.9], [0.9, 0.9, 0]]), 0.7).tolist() == [1, 1, 2]
    with pytest.raises(ValueError):
        enrich.source_of("XX")


def test_relevance_on_a_small_graph(spark):
    parents = spark.createDataFrame([("a", "m"), ("b", "m"), ("m", "r"), ("c", "r")], "child string, parent string")
    ic = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("m", 1.0), ("r", 0.0), ("c", 2.0)], "term string, ic double")
    terms = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    sim = {(r["a"], r["b"]): r["sim"] for r in enrich.relevance(parents, ic, terms).collect()}
    assert sim[("a", "b")] == pytest.approx(2 / 5 * (1 - np.exp(-1))) and ("a", "c") not in sim


def test_study_from_counts_to_modules(spark, tmp_path):
    x, truth = planted(modules=3, size=40, noise=30, samples=24)
    expr = spark.createDataFrame([(int(g), int(s), float(v)) for g, row in enumerate(x) for s, v in enumerate(row)], "gene_id long, sample_ord long, value double")
    genes = spark.range(len(x)).withColumnRenamed("id", "gene_id")
    names = genes.select("gene_id", F.concat(F.lit("n"), "gene_id").alias("gene_name"))
    dge = genes.select("gene_id", F.lit(1.5).alias("log2fc"), F.lit(0.01).alias("pval"))
    traits = spark.createDataFrame([(s, float(s % 2)) for s in range(24)], "sample_ord long, trait double")
    study = Study(expr=expr, annotation=names, nc=names.where("gene_id % 5 = 0"), dge=dge, traits=traits).cut_outliers().select_power(6).bootstrap(3, least=20).set_cut(0.1).summarise(least=20)
    got = study.summary.toPandas().sort_values("gene_id")
    assert adjusted_rand(got["module"].to_numpy(), truth) > 0.7
    assert study.stability.agg(F.max("stability")).first()[0] <= 1
    assert study.trait_correlations().where("p between 0 and 1").count() == got["module"].max()
    near = study.neighbours("n5", 7).toPandas()
    assert len(near) == 7 and near["gene_id"].iloc[0] == 5 and near["connectivity"].is_monotonic_decreasing
    assert study.scan_powers([2, 4]).count() == 2 and study.bars().count() > 0
    sets = genes.select(F.concat(F.lit("T"), (F.col("gene_id") / 40).cast("int")).alias("term_id"), "gene_id")
    terms = study.enrich(sets).toPandas()
    assert {(r.module, r.term_id) for r in terms.itertuples() if r.q < 1e-6} == {(int(m), f"T{k}") for k, m in enumerate(pd.Series(got["module"].to_numpy()[: 120]).groupby(np.arange(120) // 40).agg(lambda x: x.mode()[0]))}
    found, enriched, nodes, edges = (x.toPandas() for x in study.associate("n5", sets, 30, 10, path=str(tmp_path / "near"), terms_path=str(tmp_path / "terms")))
    assert enriched["term_id"].tolist() == ["T0"] and len(nodes) == 10 and len(edges) == 45 and len(found) == 20  # above the median of the 40 genes of the module
    assert spark.read.option("header", True).csv(str(tmp_path / "near")).count() == 20
    reduced = spark.createDataFrame([(int(m), t, 1) for m, t in {(r.module, r.term_id) for r in terms.itertuples() if r.q < 1e-6}], "module int, term_id string, cluster int")
    whole, sub = study.submodules(reduced, sets, str(tmp_path / "summary"))
    assert whole.summary.where("size(submodules) = 1").count() > 100 and sub.count() == 3 and sub.where("n_nc > 0").count() > 0
    module = int(got.set_index("gene_id").loc[5, "module"])
    assert whole.heatmap(module, 3, submodule=1, path=str(tmp_path / "map")).count() > 0
    for bad in (lambda: whole.heatmap(99, 3), lambda: whole.heatmap(module, 3, submodule=7), lambda: whole.heatmap(module, 0), lambda: study.associate("n5", sets, nodes=0), lambda: study.associate("n5", sets, most=2), lambda: study.set_cut(2), lambda: study.select_power("x"), lambda: study.neighbours("n1")):
        with pytest.raises(ValueError):
            bad()


def test_streaming_moments(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([("g", float(a), float(a + b)) for a, b in x], "pair string, x double, y double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = moments.maintain(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "pair")
    q.processAllAvailable()
    q.stop()
    r = moments.merge_moments(spark.read.parquet(str(tmp_path / "out")), "pair").first()
    assert r["n"] == 300 and r["r"] == pytest.approx(np.corrcoef(x[:, 0], x.sum(1))[0, 1])


def test_reports(spark):
    nodes = spark.createDataFrame([(7, 0), (8, 1), (9, 2)], "gene_id long, rank int")
    at = {r["gene_id"]: (round(r["x"], 6), round(r["y"], 6)) for r in report.layout(nodes).collect()}
    assert at[7] == (0, 0) and at[9] == (1, 0)
    terms = spark.createDataFrame([(8, "t2"), (8, "t1")], "gene_id long, term_id string")
    assert {r["gene_id"]: (r["terms"], r["unenriched"]) for r in report.membership(nodes, terms).collect()}[8] == (["t1", "t2"], False)


def test_gene_set_file_and_download(spark, tmp_path):
    (tmp_path / "s.gmt").write_text("T1\tfirst\tg1\tg2\nT2\tsecond\tg3\n")
    assert {tuple(r) for r in gtf.read_gmt(spark, str(tmp_path / "s.gmt"), "X").collect()} == {("X", "T1", "first", "g1"), ("X", "T1", "first", "g2"), ("X", "T2", "second", "g3")}
    (tmp_path / "a.gtf").write_text('c\ta\tgene\t1\t2\t.\t+\t.\tgene_id "G1"; gene_name "N";')
    assert gtf.download_gtf(spark, (tmp_path / "a.gtf").as_uri(), str(tmp_path / "b.gtf")).first()["gene_name"] == "N"


def test_term_reports(spark):
    reduced = spark.createDataFrame([(1, "t1", 1, "t1", 2.5), (1, "t2", 2, "t2", 1.5)], "module int, term_id string, cluster int, parent string, score double")
    nc = spark.createDataFrame([(1, 1, 3, "a, b, c", 2)], "module int, cluster int, n_nc long, nc_ids string, n_nc_de long")
    labelled = report.cluster_labels(reduced, nc)
    assert [r["label"] for r in labelled.orderBy("cluster").collect()] == ["1 - t1 (2/3)", "2 - t2 (0/0)"]
    corr = spark.createDataFrame([(1, 0.5, 0.03)], "module int, corr double, p double")
    assert report.treemap(labelled, corr).first()["title"] == "module 1: r = 0.50, p = 0.030"
    tests = reduced.select("module", "term_id", (-F.col("score")).alias("log10_p"))
    assert report.top_terms(tests, 99).count() == 2 and report.top_terms(tests, 1).first()["term_id"] == "t1"
    cells = report.cell_colours(spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.9)], "i long, j long, tom double"), 16)
    assert {r["cell"] for r in cells.collect()} == {1, 16}


def test_absent_samples_are_no_leaves(spark):
    ids = [0, 1, 2, 4]
    d = spark.createDataFrame([(s, t, 10.0) for s in ids for t in ids if s < t], "s long, t long, distance double")
    assert [r["height"] for r in cluster.sample_tree(d).orderBy("step").collect()] == [10.0] * 3
    assert sorted(r["sample_ord"] for r in cluster.keep_samples(d).where("keep").collect()) == ids
    far = spark.createDataFrame([(7, 9, 1.0), (7, 30, 50.0), (9, 30, 50.0)], "s long, t long, distance double")
    assert sorted(r["sample_ord"] for r in cluster.keep_samples(far, 5.0, 2).where("keep").collect()) == [7, 9]
    one = spark.createDataFrame([(6,)], "sample_ord long")
    assert [(r["sample_ord"], r["keep"]) for r in cluster.keep_samples(far.limit(0), None, samples=one).collect()] == [(6, True)]


def test_overlap_median_is_that_of_the_whole_matrix(spark):
    rng = np.random.default_rng(2)
    for n, values in ((9, rng.random(36)), (8, np.repeat([0.25, 0.5], 14)), (7, rng.random(21) * 1e-7)):
        m = np.eye(n)
        m[np.triu_indices(n, 1)] = values
        m = np.maximum(m, m.T)
        tom = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(i + 1, n)], "i long, j long, tom double")
        assert report.overlap_median(tom, n, bins=4) == pytest.approx(np.median(m), abs=0)


def test_modules_of_blocks_become_one(spark):
    x, truth = planted(modules=3, size=80, noise=20, samples=30)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "gene_id long, v array<double>")
    whole = cluster.detect_modules(e, 6.0, least=20).toPandas().sort_values("gene_id")["module"].to_numpy()
    parts = cluster.detect_modules(e, 6.0, least=20, block=150).toPandas().sort_values("gene_id")["module"].to_numpy()
    assert whole.max() == parts.max() == 3 and adjusted_rand(parts, truth) > 0.7


def test_violations_of_missing_tables(spark):
    counts = spark.createDataFrame([(1, 0, 5.0)], "gene_id long, sample_ord long, cnt double")
    assert sorted(r["rule"] for r in annotate.violations(counts, None, None, None).collect()) == ["annotation missing", "dge missing", "traits missing"]


def test_ambiguous_names_warn(spark):
    s = spark.createDataFrame([(2, "a", True), (1, "a", True)], "gene_id long, gene_name string, is_nc boolean")
    with pytest.warns(UserWarning):
        assert report.resolve_name(s, "a") == 1
