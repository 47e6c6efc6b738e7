"""What map tags say about a link: its type, its bicycle facility by direction, its attributes. Rules are data; `first_rule` applies them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.scalars import first_rule

#: Tag values with a meaning.
ALLOWED = ["yes", "permitted", "permissive", "designated"]
FOOTWAYS = ["path", "track", "pedestrian", "steps", "corridor", "footway"]
ROADS = "primary primary_link residential secondary secondary_link tertiary tertiary_link trunk trunk_link unclassified living_street".split()
PARKING = ["parking_aisle", "driveway"]
CLOSED = ["no", "private", "customers"]
NONE = ["no", "separate", "none"]
UNPAVED = ["gravel", "log", "wood", "ground", "grass", "unpaved", "dirt", "mud", "stepping_stones", "fine_gravel", "brick", "dirt/sand"]
FORBIDDEN = ["no", "private", "unknown"]


def _is(tags: Column, key: str, *values: str) -> Column:
    """Whether a tag has one of the values; a missing tag hasn't."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)).isin(*values), F.lit(False))


def _has(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key)).isNotNull()


def link_type(tags: Column) -> Column:
    """sidewalk, pedestrian, bike, parking_and_driveways, service, road, restricted_access_road, or null where no rule holds; overrides: bicycle=no, construction, proposed."""
    riding = _is(tags, "bicycle", *ALLOWED)
    foot = _is(tags, "highway", *FOOTWAYS)
    service = _is(tags, "highway", "service")
    rules = [
        (~riding & _is(tags, "footway", "sidewalk", "crossing"), "sidewalk"), (~riding & foot, "pedestrian"), (_is(tags, "highway", "cycleway") | (foot & riding), "bike"),
        (_is(tags, "service", *PARKING), "parking_and_driveways"), (service & ~_has(tags, "name"), "service"), (_is(tags, "highway", *ROADS) | (service & _has(tags, "name")), "road"),
        (_is(tags, "highway", "motorway", "motorway_link"), "restricted_access_road"),
    ]
    late = [(_is(tags, "bicycle", "no"), "no_bike"), (_is(tags, "highway", "construction"), "road"), (_is(tags, "highway", "proposed"), "no_access_or_private")]
    return first_rule(rules, None, late)


def facility(tags: Column, kind: Column, forward: bool) -> Column:
    """The bicycle facility on one side of a link of a type: 'no facility', cycletrack, multi use path, sharrow, buffered bike lane, bike lane; null if nothing tells.

    The right side is taken for the forward direction, the left side for the reverse one.
    """
    side = "cycleway:right" if forward else "cycleway:left"
    bike = F.coalesce(kind == "bike", F.lit(False))
    both = ["cycleway", "cycleway:both"]
    any_both = lambda *v: _is(tags, both[0], *v) | _is(tags, both[1], *v)
    nothing = (~_has(tags, both[0]) & ~_has(tags, both[1])) | any_both(*NONE)
    no_side = ~_has(tags, side) | _is(tags, side, *NONE)
    sided = F.filter(F.map_entries(tags), lambda e: e["key"].startswith("cycleway:right") | e["key"].startswith("cycleway:left"))
    one_way = F.lit(False) if forward else _is(tags, "oneway", "yes")
    own_way = _is(tags, "highway", "cycleway")
    walkers = _is(tags, "foot", *ALLOWED)
    plain = (F.size(sided) == 0) | F.exists(sided, lambda e: e["value"] == "no")
    rules = [
        (_is(tags, "access", *CLOSED), "no facility"), (~bike & nothing & no_side, "no facility"), (own_way & ~walkers & ~one_way, "cycletrack"), (_is(tags, side, "track") & ~one_way, "cycletrack"),
        (own_way | bike, "multi use path"), (any_both("shared_lane") | _is(tags, side, "shared_lane"), "sharrow"), ((F.size(sided) == 0) & _is(tags, "cycleway:both:buffer", "yes"), "buffered bike lane"),
        (_is(tags, side, "lane") & _is(tags, f"{side}:buffer", "yes"), "buffered bike lane"), (plain & any_both("lane", "yes"), "bike lane"), (_is(tags, side, "lane", "yes", "opposite_lane"), "bike lane"),
    ]
    return first_rule(rules)


def rideable(tags: Column) -> Column:
    """Whether a cycleway is paved and open to bicycles; a path must say so. Unknown surfaces count as paved."""
    return ~_is(tags, "surface", *UNPAVED) & ~_is(tags, "bicycle", *FORBIDDEN) & ~(_is(tags, "highway", "path") & ~_has(tags, "bicycle"))


def recoded(value: Column, table: dict[str, str]) -> Column:
    """A value by a dictionary; unknown ones are null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def speed_of(text: Column) -> Column:
    """The number before the unit of a speed like '35 mph'; null if there is none."""
    return F.get(F.split(F.trim(text), r"\s+"), F.lit(0)).try_cast("double")


def number_of(text: Column) -> Column:
    return text.try_cast("int")
