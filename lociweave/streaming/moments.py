"""Incremental correlation of sample streams: moments kept by micro-batch, merged at read time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def batch_moments(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, sx, sy, sxx, syy, sxy) of (keys, x, y)."""
    x, y = F.col("x"), F.col("y")
    return pairs.where("x is not null and y is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))


def merge_moments(moments: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, r): the correlation over all batches."""
    s = moments.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    var = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    return s.select(*keys, "n", (cov / F.sqrt(F.nullif(F.greatest(var, F.lit(0.0)), F.lit(0.0)))).alias("r"))


def maintain(stream: DataFrame, path: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Writes the moments of each micro-batch under its number, so a replayed batch replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch_moments(batch, *keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).start()
