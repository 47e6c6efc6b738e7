"""Repeated consecutive events collapsed into runs, by a regular expression over symbol strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.common import US, floor_div, micros

#: One sequence is cut into chunks of this many positions; runs are joined across the cuts.
CHUNK = 65_536
#: A maximal repetition of one symbol; NUL separates what must not be joined.
REPEATED = re.compile("([^\x00])\\1*", re.DOTALL)
#: The first code point used, and the gap that can't be encoded.
FIRST_CODE, SURROGATES = 0x100, (0xD800, 0xE000)

_OUT = "seq bigint, chunk bigint, first_pos bigint, last_pos bigint, first_us bigint, last_us bigint, n bigint, a bigint, b int, head boolean, tail boolean"


def _symbols(codes: np.ndarray) -> str:
    """Small non-negative numbers as one string, a code point each."""
    points = codes + FIRST_CODE
    points = np.where(points >= SURROGATES[0], points + SURROGATES[1] - SURROGATES[0], points)
    return points.astype("<u4").tobytes().decode("utf-32-le")


def _collapse(max_gap_us: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_run: pd.DataFrame | None = None  # the last run so far: the next batch may go on with it
        for batch in batches:
            if not len(batch):
                continue
            seq, chunk, us, a, b = (batch[c].to_numpy() for c in ("seq", "chunk", "us", "a", "b"))
            codes, _ = pd.factorize(pd.MultiIndex.from_arrays([a, b]))
            changed = (seq[1:] != seq[:-1]) | (chunk[1:] != chunk[:-1])
            cut = np.flatnonzero(changed | (us[1:] - us[:-1] > max_gap_us)) + 1
            # a separator before each row at a cut shifts the rows behind it
            text = _symbols(np.insert(codes, cut, -FIRST_CODE))
            row_of = np.insert(np.arange(len(codes)), cut, -1)
            spans = np.array([m.span() for m in REPEATED.finditer(text)])
            first, last = row_of[spans[:, 0]], row_of[spans[:, 1] - 1]
            starts = np.r_[True, changed]
            ends = np.r_[changed, True]
            pos = batch["pos"].to_numpy()
            out = pd.DataFrame({
                "seq": seq[first], "chunk": chunk[first], "first_pos": pos[first], "last_pos": pos[last], "first_us": us[first],
                "last_us": us[last], "n": last - first + 1, "a": a[first], "b": b[first], "head": starts[first], "tail": ends[last],
            })
            if open_run is not None:
                o, f = open_run.iloc[0], out.iloc[0]
                same = o["seq"] == f["seq"] and o["chunk"] == f["chunk"]
                if same:
                    open_run["tail"] = False
                    out.loc[0, "head"] = False
                if same and o["a"] == f["a"] and o["b"] == f["b"] and f["first_us"] - o["last_us"] <= max_gap_us:
                    out.loc[0, ["first_pos", "first_us", "head"]] = [o["first_pos"], o["first_us"], o["head"]]
                    out.loc[0, "n"] = out.loc[0, "n"] + o["n"]
                else:
                    yield open_run
            open_run = out.iloc[-1:].reset_index(drop=True)
            yield out.iloc[:-1]
        if open_run is not None:
            yield open_run

    return run


def collapse_runs(rows: DataFrame, seq: str, pos: str, event: str, direction: str, at: str, max_gap_s: int, chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of the same event (event, direction), each row at most max_gap_s after the one before it.

    One row per run, also for runs of one row: seq, first_pos, last_pos, n, event, direction, started, duration_s.

    Defined cases: repeated rows count once; rows with a null seq, pos or event are left out; a null direction takes the
    last known one before it in the sequence, and where there is none it is a value of its own; a null time is no gap
    (such rows neither end a run nor measure one); rows of one position are ordered by time, event and direction;
    an empty table gives an empty result; other columns are ignored.

    Method: per sequence the events become symbols (Unicode code points) of one string, in which a regular expression with
    a backreference finds the repetitions; spans map back to positions and times. The alphabet is made anew per
    batch, so it can't run out. Long sequences are cut into chunks of positions; only the first and
    last run of each chunk are compared with the neighbouring chunks, so a hot sequence is spread over many tasks.
    """
    kept = (
        rows.where(F.col(seq).isNotNull() & F.col(pos).isNotNull() & F.col(event).isNotNull())
        .select(
            F.col(seq).cast("bigint").alias("seq"), F.col(pos).cast("bigint").alias("pos"), F.col(event).cast("bigint").alias("a"),
            F.col(direction).cast("int").alias("b"), micros(at).alias("us"),
        )
        .withColumn("chunk", floor_div(F.col("pos"), chunk))
        .repartition("seq", "chunk")
        .dropDuplicates(["seq", "chunk", "pos", "a", "b", "us"])
    )
    order = [F.col("pos"), F.col("us"), F.col("a"), F.col("b")]
    before = Window.partitionBy("seq", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what is known at the end of the earlier chunks
    ends = kept.groupBy("seq", "chunk").agg(
        F.max(F.when(F.col("b").isNotNull(), F.struct(*order))).getField("b").alias("b_end"), F.max("us").alias("us_end")
    )
    earlier = Window.partitionBy("seq").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("seq", "chunk", F.last("b_end", True).over(earlier).alias("b_before"), F.last("us_end", True).over(earlier).alias("us_before"))
    filled = kept.withColumn("b", F.last("b", True).over(before)).withColumn("us", F.last("us", True).over(before))
    filled = filled.join(ends, ["seq", "chunk"], "left").select(
        "seq", "chunk", "pos", "a", F.coalesce("b", "b_before", F.lit(-1)).alias("b"), F.coalesce("us", "us_before", F.lit(-(1 << 62))).alias("us")
    )
    runs = filled.repartition("seq", "chunk").sortWithinPartitions("seq", "chunk", "pos", "us", "a", "b").mapInPandas(_collapse(max_gap_s * US), _OUT)

    # runs at the cuts: joined where the next chunk goes on with the same event in time
    line = Window.partitionBy("seq").orderBy("chunk", "first_pos", "first_us")
    edge = runs.where("head or tail")
    prev = F.lag(F.struct("chunk", "a", "b", "tail", "last_us")).over(line)
    edge = edge.withColumn("p", prev).withColumn(
        "fresh",
        F.when(
            F.col("head") & F.col("p.tail") & (F.col("p.chunk") < F.col("chunk")) & (F.col("p.a") == F.col("a"))
            & (F.col("p.b") == F.col("b")) & (F.col("first_us") - F.col("p.last_us") <= max_gap_s * US), 0,
        ).otherwise(1),
    )
    edge = edge.withColumn("island", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = edge.groupBy("seq", "island").agg(
        F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"), F.sum("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"),
    )
    cols = ["seq", "first_pos", "last_pos", "first_us", "last_us", "n", "a", "b"]
    return (
        runs.where("not head and not tail").select(cols).unionByName(edge.select(cols))
        .select(
            F.col("seq").alias(seq), "first_pos", "last_pos", "n", F.col("a").alias(event),
            F.when(F.col("b") >= 0, F.col("b") == 1).alias(direction), F.timestamp_micros("first_us").alias("started"),
            ((F.col("last_us") - F.col("first_us")) / F.lit(float(US))).alias("duration_s"),
        )
    )
