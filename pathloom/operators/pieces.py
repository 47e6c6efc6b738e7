"""Ordered sequences cut into pieces with context, and groups put together again from Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.common import floor_div


def with_pieces(rows: DataFrame, order: str, size: int, context: int) -> DataFrame:
    """Rows of recordings (`rec`) with `piece` and `own`: each row belongs to the piece of its order value; the rows of the last and the first `context` order values
    that a piece has also come, as context, to the next and the previous piece that the recording has, however far away that is."""
    o = F.col(order)
    rows = rows.withColumn("piece", floor_div(o, size)).withColumn("own", F.lit(True))
    if rows.where((o >= size) | (o < 0)).isEmpty():  # as a rule the files' statistics tell
        return rows
    each = Window.partitionBy("rec").orderBy("piece")
    beside = rows.select("rec", "piece").distinct().withColumn("_before", F.lag("piece").over(each)).withColumn("_after", F.lead("piece").over(each)).where("_before is not null or _after is not null")
    inside = Window.partitionBy("rec", "piece")
    near = rows.join(beside, ["rec", "piece"]).withColumn("_first", F.dense_rank().over(inside.orderBy(order))).withColumn("_last", F.dense_rank().over(inside.orderBy(F.desc(order))))
    to = F.array_compact(F.array(F.when(F.col("_first") <= context, F.col("_before")), F.when(F.col("_last") <= context, F.col("_after"))))
    copies = near.withColumn("piece", F.explode(to)).withColumn("own", F.lit(False))
    return rows.unionByName(copies.select(*rows.columns))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of at least `rows` rows (the last may have fewer) that hold whole groups of the sorted input."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < rows:
            continue
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
        last = np.ones(len(frame), bool)
        for k in keys:
            last &= (frame[k] == frame[k].iloc[-1]).to_numpy()
        start = int(np.argmax(last))
        if start:
            yield frame.iloc[:start].reset_index(drop=True)
            frame = frame.iloc[start:].reset_index(drop=True)
        held, size = [frame], 0 if start else len(frame) // 2
    if held:
        yield pd.concat(held, ignore_index=True)


def group_starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where each group of a sorted frame begins."""
    new = np.ones(len(frame), bool)
    if len(frame):
        new[1:] = False
        for k in keys:
            v = frame[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
