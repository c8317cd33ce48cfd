"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations alone.

A source with target t and size s is taken floor(t / s) times whole, and the rest of its budget is
filled with one more copy of the documents whose hash lies below a threshold. The threshold is
found without a sort: words are summed by (source, hash digit); the running sum over the digits of
a source shows the digit in which the budget runs out; only that boundary bucket is summed again by
its next digit. Each level has at most 4096 rows a source, however many documents there are. After
the last digit the boundary holds documents of one hash value, which go in if that brings the
source nearer to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: Hex digits of the hash that each level of the histogram reads, and the number of levels.
DIGITS, LEVELS = 3, 4


def row_hash(column: str = "doc_id") -> Column:
    """Hex digits that depend on the document's id alone; a null id hashes as an empty string."""
    return F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, DIGITS * LEVELS)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_COPIES) -> DataFrame:
    """(key, source_size) of (key, source, source_size), with target: share of all words by weight, at most `most` times the source's size.

    Excess of capped sources is reshared by weight. That fixes one level L with target =
    min(most * size, L * weight): ordered by most * size / weight, capped sources come first, and L
    is what they leave over the weights of the others. A row per source: the windows take one task,
    which is meant for up to some millions of sources.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full_at", "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", w).withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    x = x.withColumn("left_", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("level", F.col("left_") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source, by full_at, that the level at its place does not fill: all after it share that level
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "place", "level"))).over(everything)["level"]
    return x.withColumn("found", level).select("key", "source_size", F.least("cap", F.coalesce(F.col("found") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_COPIES) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    size: words of the text, 0 for null or empty. taken: size times the copies that the mix holds.
    Each source ends within half a document (the one at its threshold) of its target. A null source
    is a source, the last by name. Rows that share a doc_id, null ids too, share a hash and are
    taken or left together. A source without words has target 0. An empty table gives an empty
    result. Other columns are not read. Reruns agree: nothing depends on order or partitions.
    """
    rows = materialise(measured(docs).select("row.doc_id", "key", "size", "hash"), "sizes")
    return taken(rows, rows, weights, share, most).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_COPIES) -> DataFrame:
    """The documents of the mix, with all their columns and mix_copies, how often the mix repeats each; the rest go.

    A column mix_copies of docs is replaced. Rows that share a doc_id, null ids too, are taken or left
    together, repeated rows as well; documents without words go where their source is not repeated
    whole. An empty table gives an empty result.
    """
    every = measured(docs)
    rows = materialise(every.drop("row"), "sizes")
    mixed = taken(every, rows, weights, share, most).where("copies > 0")
    return mixed.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "mix_copies"), F.col("copies").alias("mix_copies"))


def measured(docs: DataFrame) -> DataFrame:
    """key (of the source), size and hash of each row of docs, with the row itself."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    return docs.select(F.struct("*").alias("row"), key.alias("key"), size.alias("size"), row_hash().alias("hash"))


def taken(to: DataFrame, rows: DataFrame, weights, share, most) -> DataFrame:
    """`to` with source_size, target and copies, from the sizes in `rows`; both have key, size and hash."""
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("key") != "null", F.substring("key", 2, 1 << 30)))
    targets = source_targets(sizes, weights, share, most)
    copies = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long")
    plan = materialise(targets.withColumn("copies", copies).withColumn("budget", F.col("target") - copies * F.col("source_size")), "targets")

    edge = plan.select("key", F.lit("").alias("edge"), F.col("budget").alias("rest"))
    for level in range(1, LEVELS + 1):
        edge = materialise(_refine(rows, edge, DIGITS * level), f"edge-{level}")
    extra = F.when(F.col("budget") <= 0, 0).when(F.col("edge").isNull() | (F.col("hash") < F.col("edge")), 1).when(F.col("hash") == F.col("edge"), (F.col("words") <= 2 * F.col("rest")).cast("int")).otherwise(0)
    ends = materialise(plan.join(edge, "key"), "thresholds")  # a row per source, of known size
    return to.join(ends, "key").withColumn("copies", F.col("copies") + extra).drop("budget")


def _refine(rows: DataFrame, edge: DataFrame, digits: int) -> DataFrame:
    """The boundary bucket of each source, one level finer: (key, edge, rest, words).

    edge is null where all of a source fits; rest is the budget left inside the boundary bucket,
    words what the bucket holds.
    """
    inside = rows.join(edge.select("key", "edge"), "key").where(F.col("hash").startswith(F.col("edge")) & (F.col("size") > 0))
    sums = inside.groupBy("key", F.substring("hash", 1, digits).alias("digit")).agg(F.sum("size").alias("words"))
    run = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy("digit")))
    over = run.join(edge.select("key", "rest"), "key").where(F.col("upto") > F.col("rest"))
    first = over.groupBy("key").agg(F.min(F.struct("digit", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), "words")).alias("first"))
    return edge.select("key").join(first, "key", "left").select("key", F.col("first.digit").alias("edge"), F.col("first.rest").alias("rest"), F.col("first.words").alias("words"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op9_source_mix": op9_source_mix}

ORACLE_SQL = {
    "op9_source_mix": f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size,
        substr(md5(coalesce(doc_id::varchar, '')), 1, {DIGITS * LEVELS}) h from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) place from d group by 1),
w as (select *, case (place - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end weight, 2.0::double * source_size cap from s),
f as (select *, cap / weight full_at,
        1.5::double * (select sum(source_size) from s)::double - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) left_,
        (select sum(weight) from w) - coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) open_ from w),
l as (select arg_min(left_ / open_, (full_at, place)) filter (where full_at >= left_ / open_) level from f),
t as (select source, source_size, least(cap, coalesce(level * weight, cap)) target from f, l),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint copies from t),
r as (select source, h, sum(size)::bigint words, sum(sum(size)) over (partition by source order by h)::bigint upto from d where size > 0 group by 1, 2),
e as (select p.source, min(h) edge, arg_min(p.target - p.copies * p.source_size - upto + words, h) rest, arg_min(words, h) words
        from p join r on r.source is not distinct from p.source where upto > p.target - p.copies * p.source_size group by 1)
select d.doc_id, d.size, p.source_size, p.target, d.size * (p.copies + case when e.edge is null or d.h < e.edge then 1
        when d.h = e.edge and e.words <= 2 * e.rest then 1 else 0 end) taken
from d join p on p.source is not distinct from d.source left join e on e.source is not distinct from d.source"""
}
