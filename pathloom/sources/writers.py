"""Sinks: partitioned tables for layers, directed edges and model results, instead of files with telling names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_KEYS = ("subset", "calibration_name", "run_num")


def write_layer(df: DataFrame, path: str, columns: Sequence[str] | None = None, partition_by: Sequence[str] = (), overwrite: bool = False) -> None:
    """A layer as Parquet; without `overwrite` what is there is left alone and an error raised."""
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*partition_by).parquet(path)


def sided(edges: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Directed edges whose pairs of columns (forward, reverse) change places on reverse links."""
    back = F.col("reverse_link")
    swapped = {a: F.when(back, F.col(b)).otherwise(F.col(a)) for a, b in pairs} | {b: F.when(back, F.col(a)).otherwise(F.col(b)) for a, b in pairs}
    return edges.withColumns(swapped)


def write_models(df: DataFrame, path: str) -> None:
    """Model results by subset, name and run: only the runs that are written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MODEL_KEYS).parquet(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def next_run(models: DataFrame) -> DataFrame:
    """The next free run number of each subset and name."""
    return models.groupBy("subset", "calibration_name").agg((F.max("run_num") + 1).alias("run_num"))


def unfinished(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks without stored results: what a restarted run has left to do."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def summary(layers: dict[str, tuple[DataFrame, DataFrame]], length: str = "length_ft") -> DataFrame:
    """Per network its links, nodes, miles and mean length in feet."""
    out = None
    for name, (links, nodes) in layers.items():
        n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
        one = links.agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("links"), (F.sum(length) / 5280).alias("miles"), F.avg(length).alias("mean_ft")).crossJoin(n)
        out = one if out is None else out.unionByName(one)
    return out


def texts_for_times(df: DataFrame) -> DataFrame:
    """Timestamps and intervals as text, for formats without them."""
    return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t.startswith(("timestamp", "date", "interval"))})
