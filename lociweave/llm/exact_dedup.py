"""Exact dedup against a minimal perfect hash over historical distinct digests.

The rows come in two batches, history and new rows. The history's distinct digests are dealt to
shards by their first bytes; each shard gets a minimal perfect hash whose slots hold the full
digest, the locator (doc_id) of the winner and the number of rows. Rows look up their digest: the
slot's digest is compared byte by byte, so a nonmember never passes for a member. Members are summed
by slot, which may find a larger doc_id than the slot's winner; only nonmembers are grouped by
digest. Each group keeps its row with the largest doc_id.

Only digests and ids are shuffled, never texts. Rows of one digest are counted by partial
aggregation before the shuffle; lookups of a shard with many rows are salted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, materialise, mix64, numbered, table, text_bytes

SHARD_DIGESTS = 65_536
SALT_ROWS = 131_072
MAX_LEVELS = 48


class MinimalPerfectHash:
    """Levelled bitmaps: a key's slot is the rank of the first level's bit that it alone claims.

    Keys are distinct 128-bit prefixes of digests, as an (n, 2) array of uint64.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes = sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bits = np.unpackbits(bits, count=int(self.starts[-1])).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - self.bits

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            return (mix64(keys[:, 0] + seed) ^ mix64(keys[:, 1] ^ seed)) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> MinimalPerfectHash:
        sizes, parts = [], []
        for level in range(MAX_LEVELS):
            if not len(keys):
                break
            size = max(64, int(len(keys) * gamma))
            at = cls.places(keys, level, size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            keys = keys[~alone[at]]
        if len(keys):
            raise ValueError("keys of a minimal perfect hash must be distinct")
        return cls(np.array(sizes, np.int64), np.packbits(np.concatenate(parts) if parts else np.zeros(0, bool)))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has it; keys outside the built set may get any slot."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.starts[level] + self.places(keys[open_], level, size).astype(np.int64)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return out


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)[:, :16].copy().view(np.uint64)


@F.arrow_udf(T.BinaryType())
def digest_of(text: pa.Array) -> pa.Array:
    """SHA-256 of the text with A-Z lower-cased."""
    return pa.array([hashlib.sha256(t.lower()).digest() for t in text_bytes(text)], pa.binary())


def _shard(n: int):
    return (F.conv(F.hex(F.substring("digest", 17, 4)), 16, 10).cast("long") % n).cast("int")


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """One row a shard: the hash, and the slots' digests, winners and sizes, of (digest, keep_id, n) with distinct digests."""
    kind = groups.schema["keep_id"].dataType.simpleString()

    def build(rows: pa.Table) -> pa.Table:
        digests = rows["digest"].to_pylist()
        mph = MinimalPerfectHash.build(_keys(digests))
        order = pa.array(np.argsort(mph.slots(_keys(digests))))
        return pa.table({
            "shard": rows["shard"].slice(0, 1), "sizes": pa.array([mph.sizes.tolist()], pa.list_(pa.int64())), "bits": pa.array([np.packbits(mph.bits).tobytes()]),
            "digests": pa.array([b"".join(digests[i] for i in order.to_pylist())]), "winners": _one_list(rows["keep_id"].take(order)), "counts": _one_list(rows["n"].take(order)),
        })

    schema = f"shard int, sizes array<bigint>, bits binary, digests binary, winners array<{kind}>, counts array<bigint>"
    return groups.select(_shard(shards).alias("shard"), "digest", "keep_id", "n").groupBy("shard").applyInArrow(build, schema)


def _one_list(values: pa.ChunkedArray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.combine_chunks())


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Rows of (rid, doc_id, digest, late) with shard and slot, and the slot's winner and count; slot is null where the index does not hold exactly that digest."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.select("rid", "doc_id", "digest", "late", _shard(shards).alias("shard"))
    plan = dealt.groupBy("shard").count().select("shard", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("salts"))
    dealt = dealt.join(plan, "shard").select("rid", "doc_id", "digest", "late", "shard", F.pmod(F.xxhash64("rid"), "salts").cast("int").alias("salt"))
    copies = index.join(plan, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(["rid", "doc_id", "digest", "late", "shard"])
        slots = pa.nulls(left.num_rows, pa.int32())
        held = [pa.nulls(left.num_rows, left["doc_id"].type), pa.nulls(left.num_rows, pa.int64())]
        if left.num_rows and right.num_rows:
            one, digests = right.select(["sizes", "bits", "digests"]).to_pylist()[0], left["digest"].to_pylist()
            mph = MinimalPerfectHash(np.asarray(one["sizes"], np.int64), np.frombuffer(one["bits"], np.uint8))
            at, bytes_ = mph.slots(_keys(digests)), one["digests"]
            slots = pa.array([s if s >= 0 and bytes_[32 * s : 32 * s + 32] == d else None for s, d in zip(at.tolist(), digests)], pa.int32())
            held = [right[c].combine_chunks().flatten().take(slots) for c in ("winners", "counts")]
        return left.append_column("slot", slots).append_column("winner", held[0]).append_column("before", held[1])

    schema = f"rid bigint, doc_id {kind}, digest binary, late boolean, shard int, slot int, winner {kind}, before bigint"
    return dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(check, schema)


def grouped(rows: DataFrame, old: DataFrame) -> DataFrame:
    """rows (rid, doc_id, digest, late) with keep_id and group_size; old (doc_id, digest) is the history, of which rows that are not late are part.

    Rows whose digest is a slot's are counted by slot, which holds the winner and the size so far; the
    others are grouped by digest among themselves.
    """
    groups = materialise(old.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")), "history")
    shards = max(1, -(-groups.count() // SHARD_DIGESTS))
    looked = materialise(look_up(rows, materialise(build_index(groups, shards), "index"), shards), "looked-up")
    members, others = looked.where("slot is not null"), looked.where("slot is null")
    # each in a table of its own, apart from its aggregation, so that the joins can split a hot group
    slots = members.groupBy("shard", "slot").agg(F.max(F.greatest("doc_id", "winner")).alias("keep_id"), (F.max("before") + F.count_if("late")).alias("group_size"))
    fresh = others.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    wanted = ["rid", "doc_id", "digest", "keep_id", "group_size"]
    return members.join(materialise(slots, "slots"), ["shard", "slot"]).select(wanted).union(others.join(materialise(fresh, "nonmembers"), "digest").select(wanted))


def two_batches(rows: DataFrame) -> DataFrame:
    """grouped() of (rid, doc_id, digest): the half with an even hash of rid is the history, the other half is looked up."""
    late = rows.withColumn("late", F.pmod(F.xxhash64("rid"), F.lit(2)) == 1)
    return grouped(late, late.where("not late"))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    history: earlier documents, as (doc_id, text); they count in groups and may win, but have no
    rows in the result. Without it, half of docs is the first batch and the other half is looked up
    in its index.

    doc_id is of any ordered type. Null text counts as empty. A null doc_id never wins over another; a
    group of null ids alone has keep_id null and all its rows kept. Rows that repeat the winner's
    doc_id are all kept, as the id is the locator. An empty table gives an empty result. Other columns
    of docs are not read.
    """
    digest = digest_of("text").alias("digest")
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", digest), "digests")
    done = two_batches(rows) if history is None else grouped(rows.withColumn("late", F.lit(True)), materialise(history.select("doc_id", digest), "digests"))
    return done.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, that of the largest doc_id.

    Rows are told apart by a number of their own: a doc_id with several texts has a row for each; of
    rows that repeat text and doc_id one stays; a null doc_id stays where its group has no other.
    Null and empty texts are one group. An empty table gives an empty result; all columns pass through.
    """
    rows = numbered(docs, digest=digest_of("text"))
    done = two_batches(rows.select("rid", F.col("row.doc_id").alias("doc_id"), "digest"))
    winners = done.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("rid").alias("rid")).select("rid")
    # a table of known size: documents are shuffled only where it is too large to broadcast
    losers = materialise(rows.select("rid").join(winners, "rid", "left_anti"), "copies")
    return rows.join(losers, "rid", "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}

ORACLE_SQL = {
    "op10_exact_dedup": f"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) text_sha256 from documents),
g as (select text_sha256, max(doc_id) keep_id, count(*) group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id kept, text_sha256 from d join g using (text_sha256)"""
}
