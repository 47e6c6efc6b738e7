"""Scalar rules of street networks: bins, turn classes, names, recodes, times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- numbers -------------------------------------------------------------------------------------------------


def right_closed_bin(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (lo, hi] a value lies in; the first interval includes its lower edge, values outside have none."""
    out = F.when(value < edges[0], F.lit(None))
    for hi, label in zip(edges[1:], labels):
        out = out.when(value <= hi, F.lit(label))
    return out


def left_closed_bin(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval [lo, hi) a value lies in; values outside have none."""
    out = F.when(value < edges[0], F.lit(None))
    for hi, label in zip(edges[1:], labels):
        out = out.when(value < hi, F.lit(label))
    return out


def base_minutes(length_ft: Column, speed_mph: float, digits: int = 8) -> Column:
    """Travel time over a length at a constant speed."""
    return F.bround(length_ft / 5280 / speed_mph * 60, digits)


#: Slopes in (from, to] percent and lengths above this many metres, and the divisor of the climb there; elsewhere it is 7.
CLIMBS = [(3, 5, 120, 6.0), (5, 8, 60, 5.0), (8, 10, 30, 4.5), (10, 13, 15, 4.0)]


def slope_factor(slope: Column, length_m: Column) -> Column:
    """Factor on the flat travel time by slope in percent and length in metres: 1.5 below -30, a parabola to 0, 1 + (slope / g)^2 to 20, then 10; at most 10."""
    g = F.lit(7.0)
    for low, high, longer, value in CLIMBS:
        g = F.when((slope > low) & (slope <= high) & (length_m > longer), value).otherwise(g)
    down = F.lit(0.7 / 13)
    raw = F.when(slope < -30, 1.5).when(slope < 0, 1 + 2 * down * slope + down / 13 * slope * slope).when(slope <= 20, 1 + (slope / g) * (slope / g)).otherwise(10.0)
    return F.when(slope.isNotNull() & length_m.isNotNull(), F.least(raw, F.lit(10.0)))


def lanes_reconciled(*sources: Column) -> Column:
    """The least of the known lane counts, 1 if none is known."""
    return F.coalesce(F.least(*sources), F.lit(1))


def lanes_per_direction(total: Column, oneway: Column) -> Column:
    """Lanes of one direction from a total. A one-way has them all (at most 3); otherwise half. Two-way with exactly five has none stated."""
    one = F.when(total >= 3, 3).when(total == 2, 2).when(total == 1, 1)
    two = F.when(total > 5, 3).when((total > 2) & (total <= 4), 2).when(total <= 2, 1)
    return F.when(oneway, one).otherwise(two)


def impute_class(value: Column, link_type: Column, middle_types: Sequence[str], lowest: int = 0, middle: int = 1) -> Column:
    """An ordinal attribute with its nulls filled by tier: `middle` for the listed types, else the lowest."""
    return F.coalesce(value, F.when(link_type.isin(*middle_types), F.lit(middle)).otherwise(F.lit(lowest)))


# --- angles --------------------------------------------------------------------------------------------------


def planar_azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))), F.lit(360.0))


def angle_change(source: Column, target: Column) -> Column:
    return F.pmod(target - source, F.lit(360.0))


def turn_class(change: Column) -> Column:
    """straight (below 30, above 330), right [30, 150], uturn (150, 210), left [210, 330]."""
    return F.when((change > 330) | (change < 30), "straight").when(change <= 150, "right").when(change < 210, "uturn").otherwise("left")


# --- names ---------------------------------------------------------------------------------------------------

#: Street suffixes and directions with their abbreviations.
SUFFIXES = {
    "avenue": "ave", "boulevard": "blvd", "circle": "cir", "court": "ct", "drive": "dr", "highway": "hwy", "lane": "ln", "parkway": "pkwy", "place": "pl", "road": "rd", "square": "sq",
    "street": "st", "terrace": "ter", "trail": "trl", "way": "way",
}
#: Further words that only expand_name writes out.
ALSO_EXPANDED = {"cres": "crescent", "pk": "pike", "expwy": "expressway", "rdg": "ridge", "blf": "bluff", "fwy": "freeway", "plz": "plaza", "grn": "green", "cyn": "canyon", "pt": "pointe"}
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}


def _tokens(name: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", ""))
    return F.filter(F.split(clean, r"\s+"), lambda t: t != "")


def _recode(tokens: Column, table: dict[str, str]) -> Column:
    words = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(words, t), t))


def contract_suffix(name: Column) -> Column:
    """Lower case without punctuation, street suffixes abbreviated; null stays null."""
    return F.array_join(_recode(_tokens(name), SUFFIXES), " ")


def expand_name(name: Column) -> Column:
    """The opposite: abbreviations of suffixes and directions written out."""
    full = {v: k for k, v in {**SUFFIXES, **DIRECTIONS}.items()} | ALSO_EXPANDED
    return F.array_join(_recode(_tokens(name), full), " ")


def remove_suffix(name: Column) -> Column:
    """A street's own name: directions dropped, a last word that is a suffix dropped, unless nothing is left; null and empty give null."""
    drop = [*DIRECTIONS, *DIRECTIONS.values()]
    ends = [*SUFFIXES, *SUFFIXES.values()]
    words = F.transform(_tokens(name), lambda t: F.when(t == "mlk", "martin luther king").otherwise(t))
    words = F.filter(words, lambda t: ~t.isin(*drop))
    n = F.size(words)
    cut = F.when((n > 1) & F.element_at(words, F.when(n > 0, -1).otherwise(F.lit(None))).isin(*ends), F.slice(words, 1, F.greatest(n - 1, F.lit(0)))).otherwise(words)
    return F.nullif(F.array_join(cut, " "), F.lit(""))


def shares_token(a: Column, b: Column) -> Column:
    """Whether two names have a word in common; false if either is null."""
    return F.coalesce(F.arrays_overlap(F.split(a, " "), F.split(b, " ")), F.lit(False))


def split_names(field: Column) -> Column:
    """A field of several street names as an array of clean ones: parentheses and '&', '@' and ' at ' divide, blanks go."""
    parts = F.split(F.regexp_replace(F.lower(field), r"[()&@]|\s+at\s+", "/"), "/")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def normal_id(value: Column) -> Column:
    """A numeric id as text without decimals."""
    return F.regexp_replace(value.cast("string"), r"\..*$", "")


# --- arrays, maps, times -------------------------------------------------------------------------------------


def sublist_start(seq: Column, part: Column) -> Column:
    """Zero-based place of the first occurrence of an array within another, null if none."""
    n = F.size(part)
    last = F.size(seq) - n
    places = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(seq, i + 1, n) == part))
    return F.try_element_at(places, F.lit(1))


def sequence_direction(nodes: Column, way: Column) -> Column:
    """'forward' or 'reverse' if nodes run along a way of nodes, also over the closing of a ring; else null."""
    ring = F.concat(way, F.slice(way, 2, F.greatest(F.size(way) - 1, F.lit(0))))
    back = F.reverse(nodes)
    closed = F.element_at(way, 1) == F.element_at(way, -1)
    return (
        F.when(sublist_start(way, nodes).isNotNull(), "forward").when(sublist_start(way, back).isNotNull(), "reverse")
        .when(closed & sublist_start(ring, nodes).isNotNull(), "forward").when(closed & sublist_start(ring, back).isNotNull(), "reverse")
    )


def keys_like(tags: Column, part: str) -> Column:
    """The entries of a map whose key contains a text."""
    return F.map_filter(tags, lambda k, _: F.contains(k, F.lit(part)))


def elapsed_text(seconds: Column) -> Column:
    """Seconds as '1d 2h 3m'."""
    s = seconds.cast("bigint")
    return F.format_string("%dd %dh %dm", F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60))


def nearest_minute(at: Column) -> Column:
    """A timestamp rounded to the minute, ties to the even one."""
    return F.timestamp_seconds((F.bround(F.unix_micros(at) / 60_000_000.0, 0) * 60).cast("bigint"))


def departures(start: Column, end: Column, step_s: int) -> Column:
    """Seconds of the departures start + k * step; their number is (end - start) / step, rounded half to even."""
    n = F.bround((end - start) / step_s, 0).cast("bigint")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0).cast("bigint"))), lambda k: start + k * step_s)).otherwise(F.array().cast("array<bigint>"))


# --- classification ------------------------------------------------------------------------------------------


def first_rule(rules: Sequence[tuple[Column, str]], otherwise: str | None = None, overrides: Sequence[tuple[Column, str]] = ()) -> Column:
    """First rule that holds decides; overrides are tried after it, the last that holds wins."""
    out = F.lit(otherwise)
    for condition, label in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(label)).otherwise(out)
    for condition, label in overrides:
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(label)).otherwise(out)
    return out


def best_of(order: Sequence[str], *values: Column) -> Column:
    """The value that comes last in an order of labels; unknown ones don't count."""
    rank = F.create_map(*[F.lit(x) for i, label in enumerate(order) for x in (label, i)])
    label = F.create_map(*[F.lit(x) for i, label in enumerate(order) for x in (i, label)])
    ranks = [F.try_element_at(rank, v) for v in values]
    top = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return F.try_element_at(label, top)


def flags(conditions: dict[str, Column]) -> list[Column]:
    """Conditions as 0/1 columns; unknown is 0."""
    return [F.coalesce(c, F.lit(False)).cast("int").alias(name) for name, c in conditions.items()]


def base_case(columns: Sequence[str]) -> Column:
    """Whether all of the 0/1 columns are zero."""
    return F.forall(F.array(*[F.col(c) for c in columns]), lambda x: x == 0)


def along_way(nodes: Column, way: Column, measures: Column) -> Column:
    """Start and end of a link along the way it is a part of, as a struct of distances; null if its nodes don't run along the way.

    `measures` are the distances of the way's nodes from its start. On a ring the end may lie behind the way's end by up to a round; a link that runs
    against the way has the distances of its turned self.
    """
    n = F.size(nodes)
    whole = F.element_at(measures, -1)
    closed = F.element_at(way, 1) == F.element_at(way, -1)
    ring = F.when(closed, F.concat(way, F.slice(way, 2, F.greatest(F.size(way) - 1, F.lit(0))))).otherwise(way)
    far = F.when(closed, F.concat(measures, F.transform(F.slice(measures, 2, F.greatest(F.size(measures) - 1, F.lit(0))), lambda m: m + whole))).otherwise(measures)
    at = F.coalesce(sublist_start(ring, nodes), sublist_start(ring, F.reverse(nodes)))
    return F.when(at.isNotNull(), F.struct(F.get(far, at).alias("start"), F.get(far, at + n - 1).alias("end")))
