"""References to records that do not exist, and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.common import micros

#: References to one key beyond this many are spread over further parts, each with its own copy of the key's intervals.
PART_ROWS = 200_000
#: Of keys with that many there are no more than this, whatever the tables' size: beyond, parts become larger.
MOST_MANY = 100_000


@dataclass(frozen=True)
class Reference:
    """Column `field` of `rows` (named `tab`, identified by `row_id`, made at `at`) names a record of the parent `parent`."""

    rows: DataFrame
    tab: str
    field: str
    row_id: str
    at: str
    parent: str


@dataclass(frozen=True)
class Parent:
    """Records of `rows` with `key`, valid from `since` (inclusive) to `until` (exclusive; null: still valid)."""

    rows: DataFrame
    key: str
    since: str
    until: str


def orphan_references(references: list[Reference], parents: dict[str, Parent], part_rows: int = PART_ROWS) -> DataFrame:
    """Every non-null reference that no parent record with this key is valid for when the referring row was made.

    Gives tab, field, row_id, key, period ('YYYY-MM' of the row's time) and reason: 'missing' (the key never was valid),
    'late' (it becomes valid only afterwards), 'deleted' (it was valid before, and is not any more or not just then).

    Defined cases: repeated rows count once; a null reference is no reference; a row without a time can't be judged and has no
    case; a parent row with a null key or start, or that ends no later than it starts, is never valid; several rows
    of one key are valid whenever one of them is; empty tables give an empty result or only 'missing' ones.

    Method: the ends of the validity intervals and the references are brought together by key, sorted by time, and merged
    in one linear pass that counts the intervals open at each reference. The intervals of a key are first reduced to
    distinct ones. Keys with many references are cut into parts by row; their intervals, not their references, are
    repeated for each part. The list of such keys, which is broadcast, has at most MOST_MANY rows.
    """
    refs = None
    for r in references:
        one = r.rows.select(
            F.lit(r.parent).alias("parent"), F.lit(r.tab).alias("tab"), F.lit(r.field).alias("field"),
            F.col(r.field).cast("bigint").alias("key"), F.col(r.row_id).cast("bigint").alias("row_id"), micros(r.at).alias("us"),
        ).where("key is not null and us is not null")
        refs = one if refs is None else refs.unionByName(one)
    held = None
    for name, p in parents.items():
        one = p.rows.select(F.lit(name).alias("parent"), F.col(p.key).cast("bigint").alias("key"), micros(p.since).alias("a"), micros(p.until).alias("b"))
        one = one.where("key is not null and a is not null and (b is null or b > a)").distinct()
        held = one if held is None else held.unionByName(one)

    part_rows = max(part_rows, refs.count() // MOST_MANY)
    many = refs.groupBy("parent", "key").count().where(F.col("count") > part_rows)  # MOST_MANY rows at most
    many = many.select("parent", "key", F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    refs = refs.join(F.broadcast(many), ["parent", "key"], "left")
    refs = refs.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row_id", "field"), F.col("parts")).cast("int")))
    held = held.join(F.broadcast(many), ["parent", "key"], "left")
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))

    none = F.lit(None)
    events = held.select(
        "parent", "key", "part",
        F.explode(F.array(
            F.struct(F.col("a").alias("us"), F.lit(1).alias("step")),
            F.struct(F.col("b").alias("us"), F.lit(-1).alias("step")),
        )).alias("e"),
    ).where("e.us is not null")
    events = events.select("parent", "key", "part", "e.us", "e.step", none.cast("string").alias("tab"), none.cast("string").alias("field"), none.cast("bigint").alias("row_id"))
    probes = refs.select("parent", "key", "part", "us", F.lit(0).alias("step"), "tab", "field", "row_id")
    key = Window.partitionBy("parent", "key", "part")
    # at one instant the intervals' ends come before the references: starts are inclusive, ends exclusive
    run = key.orderBy("us", (F.col("step") == 0)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = (
        events.unionByName(probes)
        .withColumn("open", F.sum("step").over(run))
        .withColumn("before", F.sum(F.when(F.col("step") > 0, 1).otherwise(0)).over(run))
        .where("step = 0 and open = 0")
    )
    # only the orphans meet the list of known keys again
    known = held.select("parent", "key", F.lit(True).alias("known")).distinct()
    out = merged.join(known, ["parent", "key"], "left")
    return (
        out.select(
            "tab", "field", "row_id", "key", F.date_format(F.timestamp_micros("us"), "yyyy-MM").alias("period"),
            F.when(F.col("known").isNull(), "missing").when(F.col("before") > 0, "deleted").otherwise("late").alias("reason"),
        )
        .distinct()
    )


def orphans_per_period(orphans: DataFrame) -> DataFrame:
    """Orphan references counted per table, field, period and reason."""
    return orphans.groupBy("tab", "field", "period", "reason").agg(F.count(F.lit(1)).alias("n"))
