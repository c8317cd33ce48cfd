"""The corpus pipeline against its stages' rules, with planted cases."""

import random

import pytest

import corpus_pipeline as pipeline
from lociweave.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_registered():
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources"]


def test_planted_cases(spark, tmp_path):
    rng = random.Random(12)
    stems = {"en": "th ing ed the and ter ly on".split(), "de": "sch ung der ein lich ver ge über".split()}

    def prose(lang, n=120):
        return " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    rows = [(i, prose("en" if i % 2 else "de"), "en" if i % 2 else "de", f"s{i % 3}", 0) for i in range(120)]
    item = prose("en", 30)
    text = dict((r[0], r[1]) for r in rows)
    rows += [(200, text[3].upper(), "en", "s0", 0), (201, text[4], "de", "s1", 0)]  # exact copies, the larger id stays
    words = text[5].split()
    words[60] = "changed"
    rows += [(202, " ".join(words), "en", "s2", 0)]  # a near copy of 5
    rows += [(203, prose("en", 60) + " " + item + " " + prose("en", 60), "en", "s0", 0), (204, None, "en", "s0", 0), (205, "123 456 !!!", "en", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == COLUMNS
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = set(range(120))
    assert clean | {200, 201, 202, 203} == kept[0]
    assert kept[1] == kept[0] - {3, 4}
    assert kept[2] == kept[1] - {202}
    assert kept[3] == kept[2] - {203}
    mixed = pipeline.run(spark, str(tmp_path))
    assert mixed.columns == [*COLUMNS, "mix_copies"]
    got = {r["doc_id"] for r in mixed.collect()}
    assert got <= kept[3] and len(got) > 0.5 * len(kept[3])


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None)]])
def test_tiny_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
