"""Losses of routes against observed ones, and assessment metrics of scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- losses --------------------------------------------------------------------------------------------------


def jaccard(chosen: DataFrame, other: DataFrame, key: str, edge: Sequence[str], length: str) -> DataFrame:
    """Per key, lengths of the intersection and the union of two sets of edges: key, intersection_len, union_len, jaccard. Repeated edges count once; keys of either side count."""
    a = chosen.select(key, *edge, F.col(length).alias("_l")).dropDuplicates([key, *edge]).withColumn("_a", F.lit(1))
    b = other.select(key, *edge, F.col(length).alias("_m")).dropDuplicates([key, *edge]).withColumn("_b", F.lit(1))
    both = a.join(b, [key, *edge], "full").withColumn("_len", F.coalesce("_l", "_m"))
    out = both.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("_len"))), F.lit(0.0)).alias("intersection_len"), F.sum("_len").alias("union_len"))
    return out.withColumn("jaccard", F.col("intersection_len") / F.nullif(F.col("union_len"), F.lit(0.0)))


def jaccard_losses(pairs: DataFrame) -> DataFrame:
    """-mean of the trips' shares and -share of the summed lengths: loss_mean, loss_total, trips."""
    return pairs.agg((-F.avg("jaccard")).alias("loss_mean"), (-F.sum("intersection_len") / F.sum("union_len")).alias("loss_total"), F.count(F.lit(1)).alias("trips"))


def detour(chosen_len: Column, shortest_len: Column) -> Column:
    """(chosen - shortest) / shortest."""
    return (chosen_len - shortest_len) / F.nullif(shortest_len, F.lit(0.0))


def recovered(pairs: DataFrame, chosen_len: Column, threshold: float) -> DataFrame:
    """Trips whose overlap makes up the threshold of the chosen route, and their share of all: n, recovered, share."""
    hit = F.coalesce(F.col("intersection_len") / chosen_len >= threshold, F.lit(False))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("int")).cast("bigint").alias("recovered"), F.avg(hit.cast("int")).alias("share"))


def aggregated_loss(trips: DataFrame, models: Sequence[str], digits: int = 4) -> DataFrame:
    """Mean and total losses per model."""
    return trips.groupBy(*models).agg(
        F.round(-F.avg("jaccard_exact"), digits).alias("loss_mean"), F.round(-F.sum("intersection_len") / F.sum("union_len"), digits).alias("loss_total"), F.count(F.lit(1)).alias("trips")
    )


def squared_differences(chosen: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Sum over keys of (chosen - other)^2 for each column; missing values are 0: attribute, ssd."""
    b = other.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sums = chosen.select(key, *columns).join(b, key, "full").agg(*[F.sum(F.pow(z(c) - z(f"_o_{c}"), 2)).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("ssd")) for c in columns])).alias("x")).select("x.*")


# --- assessment ----------------------------------------------------------------------------------------------


def betweenness(edges: DataFrame, od: DataFrame, keys: Sequence[str], trips: str, link: Sequence[str]) -> DataFrame:
    """Trips over each link: the sum over the OD pairs whose route uses it, of links with any."""
    return edges.join(od.select(*keys, trips), list(keys)).groupBy(*link).agg(F.sum(trips).alias("trips")).where("trips > 0")


def percent_detour(minutes: Column, shortest: Column) -> Column:
    return (minutes - shortest) / F.nullif(shortest, F.lit(0.0)) * 100


def by_zone(od: DataFrame, zone: str, value: Column, trips: str) -> DataFrame:
    """Trip-weighted mean of a value per zone: zone, value, trips."""
    return od.where(value.isNotNull()).groupBy(zone).agg((F.sum(value * F.col(trips)) / F.nullif(F.sum(trips), F.lit(0))).alias("value"), F.sum(trips).alias("trips"))


def impedance_reduction(od: DataFrame, current: str, future: str, trips: str) -> DataFrame:
    """Reduction of the least impedance over all pairs: weighted_mean, unchanged (pairs), most."""
    drop = F.col(current) - F.col(future)
    return od.agg((F.sum(drop * F.col(trips)) / F.sum(trips)).alias("weighted_mean"), F.sum((drop == 0).cast("int")).cast("bigint").alias("unchanged"), F.max(drop).alias("most"))


def most_reduced(links: DataFrame, link: str, current: str, future: str, ties: Sequence[str]) -> DataFrame:
    """Of a link's directions the one with the most negative change: link, change, and the tie columns."""
    change = (F.col(future) - F.col(current)).alias("change")
    return links.groupBy(link).agg(F.min(F.struct(change, *ties)).alias("b")).select(link, F.col("b.change").alias("change"), *[F.col(f"b.{t}").alias(t) for t in ties])


def contribution(links: DataFrame, groups: Sequence[str], length: str, change: str, trips: str) -> DataFrame:
    """Length x change x trips summed per project, and per mile: contribution, per_mile."""
    out = links.groupBy(*groups).agg(F.sum(F.col(length) * F.col(change) * F.col(trips)).alias("contribution"), (F.sum(length) / 5280).alias("_miles"))
    return out.withColumn("per_mile", F.col("contribution") / F.nullif(F.col("_miles"), F.lit(0.0))).drop("_miles")


def attribute_shares(route: DataFrame, key: str, length: str, categories: dict[str, Column], denominators: dict[str, Column] | None = None) -> DataFrame:
    """Share of each route's length for which each condition holds; a denominator restricts the length it is a share of. 0 where nothing is."""
    held = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), F.col(length)).otherwise(0.0))
    base = denominators or {}
    return route.groupBy(key).agg(F.sum(length).alias("length"), *[F.coalesce(held(c) / F.nullif(held(base[n]) if n in base else F.sum(length), F.lit(0.0)), F.lit(0.0)).alias(n) for n, c in categories.items()])
