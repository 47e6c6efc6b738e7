"""Link and turn impedances from specifications, year and scenario networks, priced turn graphs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost of a link that mustn't be used.
BLOCKED = 9e9


@dataclass(frozen=True)
class Term:
    """A coefficient on an attribute of links or turns, with the range it is searched in; bypass_base: not on links of the base case."""

    col: str
    type: str
    beta: float = 0.0
    range: tuple[float, float] = (0.0, 1.0)
    bypass_base: bool = False


def _total(terms: Sequence[Term], kind: str, base: Column) -> Column:
    parts = [F.lit(t.beta) * F.col(t.col) * (F.when(base, 0.0).otherwise(1.0) if t.bypass_base else F.lit(1.0)) for t in terms if t.type == kind]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def link_cost(terms: Sequence[Term], base_cost: Column, base: Column | None = None) -> Column:
    """base x (1 + sum of beta x attribute), 8 digits; without link terms the base."""
    if not any(t.type == "link" for t in terms):
        return base_cost
    return F.bround(base_cost * (1 + _total(terms, "link", base if base is not None else F.lit(False))), 8)


def turn_cost(terms: Sequence[Term]) -> Column:
    """Sum of beta x attribute over the turn terms, 8 digits."""
    return F.bround(_total(terms, "turn", F.lit(False)), 8)


def lowry_cost(base_cost: Column, slope: Column, roadway: Column, accommodation: Column) -> Column:
    """base x (1 + slope + roadway x (1 - accommodation))."""
    return base_cost * (1 + slope + roadway * (1 - accommodation))


def legacy_cost(minutes: Column, coefficients: dict[str, float], off_street: Column) -> Column:
    """minutes x (1 + sum of coefficient x attribute), the sum left out off the street; never below 0.01."""
    total = reduce(lambda a, b: a + b, [F.lit(v) * F.col(k) for k, v in coefficients.items()], F.lit(0.0))
    return F.greatest(F.lit(0.01), minutes * (1 + F.when(off_street, 0.0).otherwise(total)))


#: Impedance functions by name: (terms, base cost, base flag) -> cost.
LINK_FUNCTIONS: dict[str, Callable[[Sequence[Term], Column, Column | None], Column]] = {"linear": link_cost}


def priced_turns(turns: DataFrame, links: DataFrame, link: Column, turn: Column, blocked: Column | None = None) -> DataFrame:
    """Turns with `target_cost`, `turn_cost` and `total_cost` (what entering the target costs). A turn whose cost is null or negative raises when it is computed.

    `links` are directed (linkid, reverse_link), `blocked` says which can't be used.
    """
    cost = F.when(blocked, BLOCKED).otherwise(link) if blocked is not None else link
    priced = links.select(F.col("linkid").alias("target_linkid"), F.col("reverse_link").alias("target_reverse_link"), cost.alias("target_cost"))
    out = turns.withColumn("turn_cost", turn).join(priced, ["target_linkid", "target_reverse_link"])
    total = F.col("target_cost") + F.col("turn_cost")
    checked = F.when(total.isNull() | (total < 0), F.raise_error(F.lit("a turn has no cost or a negative one")).cast("double")).otherwise(total)
    return out.withColumn("total_cost", checked)


def year_networks(links: DataFrame, years: DataFrame, year: str, zero: Sequence[str], infinite: Sequence[str] = ()) -> DataFrame:
    """Links as they are in each of the years (one column `network_year`): what was built later has the listed columns zero, and is blocked if one of the `infinite` flags is set. One pass."""
    grid = links.crossJoin(F.broadcast(years.select("network_year").distinct()))  # a few years
    later = F.coalesce(F.col(year) > F.col("network_year"), F.lit(False))
    blocked = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in infinite], F.lit(False))
    flagged = grid.withColumn("blocked", later & blocked)
    return flagged.withColumns({c: F.when(later, 0).otherwise(F.col(c)) for c in zero})


def improved(links: DataFrame, projects: DataFrame, key: str, facilities: Sequence[str], kind: str) -> DataFrame:
    """Links after improvements: on improved links the existing facilities are zero and the improvement's is one."""
    p = projects.select(key, F.col(kind).alias("_kind")).distinct()
    out = links.join(p, key, "left")
    return out.withColumns({c: F.when(F.col("_kind").isNull(), F.col(c)).otherwise((F.col("_kind") == c).cast("int")) for c in facilities}).drop("_kind")
