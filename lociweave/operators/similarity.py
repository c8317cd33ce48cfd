"""Gene by gene similarity by block matrix products in Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise

#: Genes in a block, which is what a task reads, and in a strip of it, which is multiplied at once.
BLOCK, STRIP = 4096, 256
#: Numbers worked on at once, few enough for a CPU's cache.
PIECE = 32_768
#: Blocks where all pairs of genes are made: at least as many, if they are not small then, for tasks enough.
PANELS = 8


def panel(genes: int) -> int:
    """Genes in a block where all pairs are made: large, as each block is read by each of its pairs."""
    return max(STRIP, min(16_384, -(-genes // PANELS)))


def pearson_rows(x: np.ndarray) -> np.ndarray:
    """Rows centred and scaled to unit length; constant rows become null vectors."""
    z = x - x.mean(1, keepdims=True)
    norm = np.sqrt((z * z).sum(1, keepdims=True))
    return np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)


def bicor_rows(x: np.ndarray) -> np.ndarray:
    """Rows weighted by Tukey's biweight about the median, unit length; rows of zero deviation fall back to Pearson."""
    d = x - np.median(x, 1, keepdims=True)
    mad = np.median(np.abs(d), 1, keepdims=True)
    u = np.divide(d, 9 * mad, out=np.zeros_like(d), where=mad > 0)
    z = d * (1 - u * u) ** 2 * (np.abs(u) < 1)
    norm = np.sqrt((z * z).sum(1, keepdims=True))
    z = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
    return np.where(mad > 0, z, pearson_rows(x))


ROWS = {"pearson": pearson_rows, "bicor": bicor_rows}


def blocks(expr: DataFrame, kind: str = "pearson", size: int = BLOCK, label: str | None = None) -> tuple[DataFrame, int]:
    """(b, ids, z, s) and the number of blocks: unit vectors of about `size` genes of (gene_id, v), s samples each.

    Genes are dealt to blocks by a hash of their id, so no order over all genes is needed. With a label
    column, labels holds the genes' values of it, -1 for none.
    """
    n = max(1, -(-expr.count() // size))
    unit = ROWS[kind]

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("gene_id")
        z = unit(np.stack(rows["v"].to_numpy()).astype(float))
        return pd.DataFrame({"b": rows["b"].iloc[:1].to_numpy(), "ids": [rows["gene_id"].tolist()], "z": [z.tobytes()], "s": [z.shape[1]], "labels": [rows["label"].tolist()]})

    own = F.lit(-1) if label is None else F.coalesce(F.col(label), F.lit(-1))
    dealt = expr.where("v is not null").select("gene_id", "v", own.cast("bigint").alias("label"), F.pmod(F.xxhash64("gene_id"), F.lit(n)).cast("int").alias("b"))
    return dealt.groupBy("b").applyInPandas(pack, "b int, ids array<bigint>, z binary, s int, labels array<bigint>"), n


def matrix(row) -> np.ndarray:
    return np.frombuffer(row["z"]).reshape(-1, row["s"])


def table_of(packed: DataFrame) -> DataFrame:
    """Blocks as a table, each in a file of its own, for the tasks of pairs to read."""
    return materialise(packed, "blocks", 1)


def block_pairs(left: DataFrame, work, schema: str, right: DataFrame | None = None, shares: int = 1) -> DataFrame:
    """What work(i, j, row_i, row_j) yields, tables of the schema, for each pair of blocks i <= j of left; or of a block of left with one of right.

    Both are tables (`table_of`), of which a task reads the blocks of its pairs: disk holds each vector once, and none is shuffled to a pair.
    With shares, so many tasks do a pair, and row_i["share"] says which of them work is in.
    """
    columns, own = ["b", "ids", "z", "s", "labels"], right is None

    def side(x: DataFrame, name: str) -> DataFrame:
        return x.select(*(F.col(c).alias(f"{c}_{name}") for c in columns))

    one = side(left, "i").withColumn("share", F.lit(0)) if shares == 1 else side(left, "i").crossJoin(left.sparkSession.range(0, shares, 1, shares).select(F.col("id").cast("int").alias("share")).hint("shuffle_replicate_nl"))
    pairs = one.join(side(left if own else right, "j").hint("shuffle_replicate_nl"), F.col("b_i") <= F.col("b_j") if own else F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                a, b = ({c: row[f"{c}_{name}"] for c in columns} for name in "ij")
                a["share"] = row["share"]
                for x in (a, b):
                    x["ids"] = np.asarray(x["ids"], np.int64)
                yield from _sent(work(a["b"], b["b"], a, b))

    return pairs.mapInArrow(run, schema)


def _sent(tables) -> Iterator[pa.RecordBatch]:
    for x in tables:
        yield pa.RecordBatch.from_pandas(x, preserve_index=False) if isinstance(x, pd.DataFrame) else x


def upper(same: bool, x: np.ndarray, y: np.ndarray, values: np.ndarray, name: str, lo: int = 0) -> pa.RecordBatch:
    """Pairs (i, j, value) with i < j of a strip of values of genes x and y, each pair once; of a block with itself the pairs right of the diagonal, which begins at column lo."""
    if same:
        r, c = np.nonzero(np.arange(len(y))[None, :] > np.arange(lo, lo + len(x))[:, None])
        a, b, v = x[r], y[c], values[r, c]
    else:
        a, b, v = np.repeat(x, len(y)), np.tile(y, len(x)), values.reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(v)], ["i", "j", name])


def raised(r: np.ndarray, power: float) -> np.ndarray:
    """|r| to the power; whole ones up to 64 by products."""
    r = np.abs(r)
    n = int(power)
    if n != power or not 1 <= n <= 64:
        return r**power
    out = None
    while n:
        if n & 1:
            out = r.copy() if out is None else np.multiply(out, r, out=out)
        n >>= 1
        if n:
            r = r * r
    return out


def raise_to(r: np.ndarray, power: float) -> None:
    """r to |r| to the power, in place, the same products as `raised`, by pieces that stay in cache."""
    flat, n = r.reshape(-1), int(power)
    whole = n == power and 1 <= n <= 64
    held = np.empty(min(flat.size, PIECE), r.dtype)
    for lo in range(0, flat.size, PIECE):
        v = flat[lo : lo + PIECE]
        np.abs(v, out=v)
        if not whole:
            np.power(v, power, out=v)
            continue
        out, left = None, n
        while left > 1 or out is not None and left:
            if left & 1:
                if out is None:
                    out = held[: len(v)]
                    out[:] = v
                else:
                    np.multiply(out, v, out=out)
            left >>= 1
            if left:
                np.multiply(v, v, out=v)
        if out is not None:
            v[:] = out


def adjacent(x: np.ndarray, y: np.ndarray, power: float, ids_x: np.ndarray, ids_y: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Adjacencies of unit vectors x and y, 0 of a gene with itself; out: where to write them."""
    w = np.matmul(x, y.T, out=out)
    if w.flags.c_contiguous:
        np.clip(w, -1, 1, out=w)
        raise_to(w, power)
    else:
        w[:] = raised(np.clip(w, -1, 1), power)
    met = np.nonzero(np.isin(ids_x, ids_y))[0]
    w[met] = np.where(ids_x[met, None] == ids_y[None, :], 0, w[met])
    return w


def rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """Values with so many digits, halves away from zero as in SQL; in place, by rows that stay in cache."""
    if digits is None:
        return values
    scale, step = 10.0**digits, max(1, 32_768 // max(1, values.shape[-1]))
    for lo in range(0, len(values), step):
        v = values[lo : lo + step]
        np.multiply(v, scale, out=v)
        np.trunc(v + np.copysign(0.5, v), out=v)
        np.divide(v, scale, out=v)
        np.add(v, 0.0, out=v)  # no negative zero
    return values


def correlations(expr: DataFrame, kind: str = "pearson", size: int | None = None, digits: int | None = None) -> DataFrame:
    """(i, j, r) for i < j: correlation of every two genes; digits: rounded in the tasks that make them, which takes a fraction of Spark's round()."""
    return _pairs(expr, kind, size, "r", lambda r: rounded(r, digits))


def adjacencies(expr: DataFrame, power: float, kind: str = "pearson", size: int | None = None, digits: int | None = None) -> DataFrame:
    """(i, j, a) for i < j with a = |r| to the power, as `adjacency` of `correlations`, but made in the tasks of the correlations."""
    return _pairs(expr, kind, size, "a", lambda r: rounded(raised(r, power), digits))


def _pairs(expr: DataFrame, kind: str, size: int | None, name: str, value) -> DataFrame:
    """(i, j, value of r) for i < j; value takes strips of correlations. A task makes at most some BLOCK squared rows, whatever the size of a block."""
    size = max(BLOCK, panel(expr.count())) if size is None else size
    packed, shares = blocks(expr, kind, size)[0], -(-size * size // BLOCK**2)

    def work(i, j, a, b):
        x, y = matrix(a), matrix(b)
        for lo in range(a["share"] * STRIP, len(x), shares * STRIP):  # strips by turns, as those of a block with itself get shorter
            for at in range(lo // BLOCK * BLOCK if i == j else 0, len(y), BLOCK):
                yield upper(i == j, a["ids"][lo : lo + STRIP], b["ids"][at : at + BLOCK], value(np.clip(x[lo : lo + STRIP] @ y[at : at + BLOCK].T, -1, 1)), name, lo - at)

    return block_pairs(table_of(packed), work, f"i bigint, j bigint, {name} double", shares=shares)


def adjacency(pairs: DataFrame, power: float) -> DataFrame:
    """(i, j, a) with a = |r| to the power, unsigned."""
    return pairs.select("i", "j", F.pow(F.abs("r"), F.lit(float(power))).alias("a"))
