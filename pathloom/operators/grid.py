"""Irregular readings onto a regular time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.common import US, floor_div, micros

#: Readings of one source are ordered within blocks of this many seconds, so no task orders a whole source.
BLOCK_S = 3600
#: Cells of a long gap are made in slices of this many.
SLICE = 4096


def regular_grid(
    readings: DataFrame, source: str, at: str, value: str, step_s: int = 30, hold_s: int = 60, accept: Column | None = None
) -> DataFrame:
    """One row per source and grid cell from its first to its last usable reading.

    A reading is valid from its time to the next reading of the source, but at most hold_s seconds: the readings form a
    step function of intervals. Intersected with the cells [s, s + step_s) this gives

    source, slot_start (Unix seconds), n_readings, mean_value (time-weighted over the covered part; null without cover),
    coverage (covered fraction of the cell, within the source's span), state: 'observed' (has a reading), 'filled' (no
    reading, wholly or partly covered by an earlier one) or 'missing'.

    Defined cases: rows with a null source, time or value, a NaN value, or refused by `accept` are not usable; readings of
    one source and instant count as one, with their mean; repeated rows therefore count once; a source without usable
    readings has no rows; an empty table gives an empty result; other columns are ignored.

    Scale: one shuffle of (source, hour) blocks, partly aggregated cells afterwards. Only one summary row per source and
    hour is ordered per source, so a source with a third of all rows spreads over many tasks.
    """
    ok = F.col(source).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    if accept is not None:
        ok = ok & accept
    block = floor_div(F.col("us"), BLOCK_S * US)
    rows = (
        readings.where(ok)
        .select(F.col(source).alias("src"), micros(at).alias("us"), F.col(value).cast("double").alias("v"))
        .withColumn("block", block)
        .repartition(F.col("src"), F.col("block"))
        .groupBy("src", "block", "us")
        .agg(F.avg("v").alias("v"))
    )
    inside = rows.withColumn("next", F.lead("us").over(Window.partitionBy("src", "block").orderBy("us"))).where("next is not null")
    # the last reading of each block is followed by the first of the source's next block that has any
    ends = rows.groupBy("src", "block").agg(F.max("us").alias("us"), F.max_by("v", "us").alias("v"), F.min("us").alias("first"))
    across = ends.withColumn("next", F.lead("first").over(Window.partitionBy("src").orderBy("block")))
    cols = ["src", "us", "v", "next"]
    step = step_s * US
    spans = (
        inside.select(cols)
        .unionByName(across.select(cols))
        .withColumn("c0", floor_div(F.col("us"), step))
        # the cell of the next reading is its own; the last reading of a source has its cell alone
        .withColumn("c1", F.when(F.col("next").isNull(), F.col("c0")).otherwise(F.greatest(F.col("c0"), floor_div(F.col("next") - 1, step))))
        .withColumn("until", F.least(F.col("us") + hold_s * US, F.coalesce("next", F.col("us") + hold_s * US)))
    )
    own = F.col("cell") == F.col("c0")
    # cells up to the last one the interval lies in; that of the next reading may be among them
    cells = (
        spans.withColumn("slice", F.explode(F.sequence("c0", "c1", F.lit(SLICE).cast("bigint"))))
        .withColumn("cell", F.explode(F.sequence("slice", F.least(F.col("slice") + SLICE - 1, F.col("c1")))))
        .withColumn("us_in", F.greatest(F.lit(0), F.least("until", (F.col("cell") + 1) * step) - F.greatest("us", F.col("cell") * step)))
        .select("src", "cell", "us_in", (F.col("us_in") * F.col("v")).alias("area"), own.cast("bigint").alias("n"))
    )
    out = cells.groupBy("src", "cell").agg(F.sum("us_in").alias("covered"), F.sum("area").alias("area"), F.sum("n").alias("n_readings"))
    return out.select(
        F.col("src").alias(source),
        (F.col("cell") * step_s).alias("slot_start"),
        "n_readings",
        F.when(F.col("covered") > 0, F.col("area") / F.col("covered")).alias("mean_value"),
        (F.col("covered") / F.lit(float(step))).alias("coverage"),
        F.when(F.col("n_readings") > 0, "observed").when(F.col("covered") > 0, "filled").otherwise("missing").alias("state"),
    )


def empty_cells(grid: DataFrame) -> DataFrame:
    """The cells of a regular grid that have no reading of their own."""
    return grid.where(F.col("n_readings") == 0)
