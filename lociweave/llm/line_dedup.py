"""Line dedup by winnowing over line hashes, in DataFrame operations alone.

Each window of RUN consecutive lines selects its line of least hash, so any repeated run of RUN lines
or more selects a line at the same place of every copy. Only selected positions are shuffled, by the
hash of their line; those whose line is selected nowhere else, nearly all, are settled by one
aggregation. Each position carries the hashes of its neighbours: from the others the match is
extended to the left and to the right, line by line, into the runs of RUN lines around the position
that selected it. The first place of each run stays; later ones are deleted, and a longer repeated
run is a chain of them. Positions are never paired with one another: each run has one first
place, a minimum that is combined before the shuffle. What is aggregated is written before it is
joined, so that the join can split a line or run that is everywhere.

Runs are compared by the 64-bit hashes of all their lines: different runs are taken for equal only
where each line of one has the hash of its counterpart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Lines that a run needs to count as repeated; winnowing's window and guarantee.
RUN = 3


def line_dedup(docs: DataFrame, run: int = RUN) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, kept (the lines left, joined by line breaks).

    Lines are what lies between line feeds, unchanged; null text has no lines, an empty text has one
    empty line. A line goes if a window of `run` consecutive lines that covers it also starts earlier:
    in a document with a smaller doc_id, or above in the same one. Windows are judged on the input.
    Documents of fewer lines keep all. Rows with a null doc_id keep all and take nothing from others.
    Rows that share a doc_id are one document: windows at the same place are one. An empty table
    gives an empty result. Other columns are not read.
    """
    lines = F.when(F.col("text").isNotNull(), F.split("text", "\n", -1))
    whole = docs.select("doc_id", lines.alias("lines"))
    hashed = whole.where(F.col("doc_id").isNotNull() & (F.size("lines") >= run)).select("doc_id", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"))
    starts = F.sequence(F.lit(0), F.size("h") - run)
    selected = F.array_distinct(F.transform(starts, lambda i: (i + F.array_position(F.slice("h", i + 1, run), F.array_min(F.slice("h", i + 1, run))) - 1).cast("int")))
    # around: the hashes of the lines from `from` on, up to run - 1 on either side of the position
    low = F.greatest(F.col("at") - (run - 1), F.lit(0))
    rows = hashed.select("doc_id", "h", F.explode(selected).alias("at")).select("doc_id", "at", F.get("h", F.col("at")).alias("print"), low.alias("from"), F.slice("h", low + 1, F.col("at") + run - low).alias("around"))
    rows = materialise(rows, "selected")
    prints = materialise(rows.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "prints")

    met = rows.join(prints, "print", "left_semi")
    inside = F.sequence(F.lit(0), F.size("around") - run)
    runs = F.transform(inside, lambda i: F.struct((F.col("from") + i).cast("int").alias("start"), F.slice("around", i + 1, run).alias("run")))
    own = F.filter(runs, lambda r: r["start"] + F.array_position(r["run"], F.col("print")) - 1 == F.col("at"))
    own = F.filter(own, lambda r: F.array_min(r["run"]) == F.col("print"))
    found = materialise(met.select("doc_id", F.explode(own).alias("r")).select("doc_id", "r.*"), "runs")
    place = F.struct("doc_id", "start")
    first = found.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("run", "first")
    late = found.join(materialise(first, "first"), "run").where(place > F.col("first")).select("doc_id", "start").distinct()
    gone = late.groupBy("doc_id").agg(F.collect_list("start").alias("starts"))

    cover = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (run - 1)))))
    gone = gone.select(F.col("doc_id").alias("__doc"), cover.alias("gone"))
    joined = whole.join(gone, F.col("doc_id") == F.col("__doc"), "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(_without("lines", F.col("gone")))
    return joined.select(
        "doc_id",
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(kept, "\n"), F.lit("")).alias("kept"),
    )


def _without(lines: str, gone: Column) -> Column:
    """The lines at no position in gone, by one hash-based set difference over positions."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(left, lambda i: F.get(F.col(lines), i))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}

ORACLE_SQL = {
    "op2_line_dedup": f"""
with d as (select doc_id, case when text is null then []::varchar[] else string_split(text, chr(10)) end l from documents),
x as (select doc_id, l, unnest(range(0, len(l) - {RUN - 1})) s from d where len(l) >= {RUN} and doc_id is not null),
g as (select doc_id, s, l[s + 1 : s + {RUN}] c from x),
r as (select *, row_number() over (partition by c order by doc_id, s) k from g),
p as (select doc_id, list(distinct p) gone from (select doc_id, unnest(range(s, s + {RUN})) p from r where k > 1) group by 1)
select d.doc_id, len(d.l)::bigint n_lines, coalesce(len(p.gone), 0)::bigint n_removed,
    sha256(array_to_string(case when p.gone is null then d.l else
        list_transform(list_filter(range(0, len(d.l)), lambda i: not list_contains(p.gone, i)), lambda i: d.l[i + 1]) end, chr(10))) kept_sha256
from d left join p using (doc_id)"""
}
