"""Relational idioms of the pipeline: funnels, weighted means, best rows, alignment, samples, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.network import ranges


def funnel(rows: DataFrame, stages: Sequence[tuple[str, Column]], measures: dict[str, Column]) -> DataFrame:
    """Measures after each of a series of filters, each on top of those before it: stage_no, stage and a column per measure. One pass over the rows."""
    kept, reached = F.lit(True), F.lit(0)
    for _, condition in stages:
        kept = kept & F.coalesce(condition, F.lit(False))
        reached = reached + kept.cast("int")
    names = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage")) for i, (n, _) in enumerate(stages, 1)])
    # a row counts in the stages it reaches
    deep = rows.withColumn("_reached", reached).where("_reached > 0").withColumn("_s", F.explode(F.slice(names, F.lit(1), F.col("_reached"))))
    return deep.groupBy(F.col("_s.stage_no").alias("stage_no"), F.col("_s.stage").alias("stage")).agg(*[c.alias(n) for n, c in measures.items()])


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value x weight over sum of weight, of the rows that have both."""
    both = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(both, value * weight)) / F.nullif(F.sum(F.when(both, weight)), F.lit(0.0))


def best_row(rows: DataFrame, keys: Sequence[str], by: Column, ties: Sequence[str], largest: bool = False) -> DataFrame:
    """The row with the smallest (largest) value per key; ties take the smallest of the tie columns. Partly aggregated, not sorted."""
    order = F.struct((-by if largest else by).alias("_by"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    rest = [c for c in rows.columns if c not in keys]
    best = rows.where(by.isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def mode_or_mixed(rows: DataFrame, keys: Sequence[str], value: str, mixed: str = "Mixed") -> DataFrame:
    """The most frequent value per key, or `mixed` if several are."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    top = counts.groupBy(*keys, "count").agg(F.min(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    best = top.groupBy(*keys).agg(F.max(F.struct("count", "_n", "_v")).alias("b"))
    return best.select(*keys, F.when(F.col("b._n") > 1, mixed).otherwise(F.col("b._v")).alias(value), F.col("b.count").alias("n"))


def align(tables: dict[str, DataFrame], keys: Sequence[str], columns: Sequence[str], fill: object | None = None) -> DataFrame:
    """Tables side by side on their keys (full outer), each column with its table's name as suffix; missing values filled."""
    renamed = [df.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in columns]) for name, df in tables.items()]
    out = reduce(lambda a, b: a.join(b, list(keys), "full"), renamed)
    return out if fill is None else out.fillna(fill)


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows with those of the same key replaced."""
    return stored.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def register(stored: DataFrame, new: DataFrame, index: str) -> DataFrame:
    """Settings with new ones appended unless they are there, numbered from 0 in the order of the numbers they had."""
    cols = [c for c in stored.columns if c != index]
    rows = stored.unionByName(new.withColumn(index, F.lit(None).cast("bigint")))
    first = rows.groupBy(*cols).agg(F.min(index).alias("_old"))
    order = Window.orderBy(F.col("_old").asc_nulls_last(), *cols)
    return first.withColumn(index, F.row_number().over(order) - 1).drop("_old")


def undirected(links: DataFrame, a: str = "A", b: str = "B", ties: Sequence[str] = ("linkid",)) -> DataFrame:
    """One link per unordered pair of ends: the first by the tie columns."""
    pair = links.withColumn("_lo", F.least(a, b)).withColumn("_hi", F.greatest(a, b))
    return best_row(pair, ["_lo", "_hi"], F.lit(0), list(ties)).drop("_lo", "_hi").select(*links.columns)


def completeness(rows: DataFrame, columns: Sequence[str], weight: Column) -> DataFrame:
    """Weighted share of rows in which each attribute is known: attribute, share. One pass, however many columns."""
    sums = rows.agg(F.sum(weight).alias("_all"), *[F.sum(F.when(F.col(c).isNotNull(), weight).otherwise(0)).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), (F.col(c) / F.col("_all")).alias("share")) for c in columns])).alias("x")).select("x.*")


def correlations(rows: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Pearson correlations of all pairs of columns, rounded: a, b, r."""
    pairs = [(a, b) for a in columns for b in columns]
    r = rows.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.bround(F.col(f"_{i}"), digits).alias("r")) for i, (a, b) in enumerate(pairs)]
    return r.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def histogram(rows: DataFrame, value: Column, width: float, weight: Column | None = None, origin: float = 0.0) -> DataFrame:
    """Weight (or number) of rows by bins of a width: bin, weight."""
    return rows.where(value.isNotNull()).groupBy(F.floor((value - origin) / width).alias("bin")).agg((F.sum(weight) if weight is not None else F.count(F.lit(1))).alias("weight"))


def scaled(rows: DataFrame, column: str) -> DataFrame:
    """A column scaled to 0..1 by its extremes, in `<column>_scaled`; 0 if it is constant."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    out = rows.crossJoin(F.broadcast(ends))  # one row
    span = F.col("_hi") - F.col("_lo")
    return out.withColumn(f"{column}_scaled", F.when(span > 0, (F.col(column) - F.col("_lo")) / span).otherwise(0.0)).drop("_lo", "_hi")


def share_of_total(rows: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    """Number, amount and percentage of the total amount per key: n, amount, percent."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"))
    # groups are few; their total is over them
    total = sums.agg(F.sum("amount").alias("_total"))
    return sums.crossJoin(F.broadcast(total)).withColumn("percent", F.col("amount") / F.col("_total") * 100).drop("_total")


def interval_of(rows: DataFrame, keys: Sequence[str], column: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean, standard deviation, median and an interval of a column per key (exact percentiles with linear interpolation)."""
    p = F.percentile(column, F.array(F.lit(0.5), F.lit(low), F.lit(high)))
    out = rows.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), p.alias("_p"))
    return out.select(*keys, "mean", "sd", F.col("_p")[0].alias("median"), F.col("_p")[1].alias("low"), F.col("_p")[2].alias("high"))


def dissolve(rows: DataFrame, keys: Sequence[str], line: str, sums: dict[str, Column]) -> DataFrame:
    """Per key the number of parts of its multi-part geometry and sums over all: keys, n, the sums. The parts themselves come from dissolved_parts."""
    return rows.groupBy(*keys).agg(F.count(line).alias("n"), *[c.alias(k) for k, c in sums.items()])


def dissolved_parts(rows: DataFrame, keys: Sequence[str], line: str, piece: int = 10_000) -> DataFrame:
    """The multi-part geometries of dissolve: keys, piece, parts (array of lines). A key with very many lines has several pieces, so no row grows without bound."""
    spread = rows.where(F.col(line).isNotNull()).withColumn("_h", F.xxhash64(line))
    n = spread.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / piece).alias("_n"))
    return spread.join(n, list(keys)).groupBy(*keys, F.pmod("_h", "_n").alias("piece")).agg(F.collect_list(line).alias("parts"))


# --- samples: by hashes, so that they are the same whatever the partitions -----------------------------------


def hash_order(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def folds(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Rows with `fold` in 0..k-1, the same for all rows of a key; fold sizes differ by what hashing does."""
    return rows.withColumn("fold", F.pmod(hash_order(seed, key), F.lit(k)).cast("int"))


def equal_folds(keys: DataFrame, key: str, k: int, order: Column) -> DataFrame:
    """Distinct keys in folds of sizes that differ by one at most. Ranks are made per range of the order, so no task holds all keys."""
    d = keys.select(key).distinct().withColumn("_o", order)
    parts = d.withColumn("_p", F.pmod(F.col("_o"), F.lit(ranges(d.count()))))
    counts = parts.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.join(F.broadcast(counts.select("_p", "_before")), "_p").withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_o", key)) + F.col("_before") - 1)
    return ranked.select(key, F.pmod("_r", F.lit(k)).cast("int").alias("fold"))


def bootstrap(rows: DataFrame, keys: Sequence[str], replicates: int, seed: int = 0) -> DataFrame:
    """Poisson bootstrap: each row with its number of draws in each replicate (replicate, draws), rows drawn at least once. Rows needn't be counted or gathered."""
    u = (F.xxhash64(F.lit(seed), F.col("replicate"), *keys).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).alias("u")
    reps = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_u", u)
    cumulative, term, draws = 0.0, 0.36787944117144233, F.lit(0)
    for n in range(1, 9):
        cumulative += term
        term /= n
        draws = draws + (F.col("_u") >= cumulative).cast("int")
    return reps.withColumn("draws", draws).where("draws > 0").drop("_u")


def one_per_group(rows: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """A random row per group, the same at every run."""
    return best_row(rows, [group], hash_order(seed, key), [key])


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n random rows of each stratum that has as many."""
    w = Window.partitionBy(stratum)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(hash_order(seed, key), key)))
    full = rows.groupBy(stratum).count().where(F.col("count") >= n).select(stratum)
    return ranked.where(F.col("_r") <= n).drop("_r").join(full, stratum, "left_semi")
