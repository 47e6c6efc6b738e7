"""Records of two sources that describe the same facility, matched without a common key."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.common import cut

#: Kinds of streets and how they are shortened.
KINDS = {
    "avenue": "ave av aven", "boulevard": "blvd bvd blv boul", "circle": "cir", "connector": "conn con connection cnctr", "court": "ct", "drive": "dr drv", "greenway": "grnwy gnwy gwy",
    "highway": "hwy", "lane": "ln", "parkway": "pkwy pky pwy", "path": "pth", "place": "pl plc", "road": "rd", "square": "sq", "street": "st str", "terrace": "ter", "trail": "tr trl", "way": "wy",
}
#: Words that say which part of a street is meant, or what is built there, not what it is called.
QUALIFIERS = set(
    "the old new n s e w ne nw se sw north south east west side bike bikes bikeway bikeways lanes cycleway ext extension phase ph i ii iii iv 1 2 3 4 segment seg part".split()
)
_KIND_OF = {short: kind for kind, shorts in KINDS.items() for short in [kind, *shorts.split()]}
_WORDS = re.compile(r"[^\W_]+")

#: Bits of each of a name's two codes (of letter pairs, of letters), and the Hamming distance up to which names are found.
NAME_BITS, NAME_RADIUS = 60, 9
#: Lengths are coded in steps of this factor, as a bit vector of NAME_BITS bits in which a run of half as many ones begins at the step: two codes are two bits
#: apart for each step between them, so within NAME_RADIUS bits are lengths up to four steps (a quarter) apart.
LENGTH_STEP = 1.057
#: Metres that two records of one facility may lie apart beside what their lengths explain.
SLACK_M = 60.0
#: Metres of the smallest block, not less than twice SLACK_M; blocks double. No two places are farther apart than half a turn.
BLOCK_M = 128.0
EARTH_M = 6371008.8
FARTHEST_M = math.pi * EARTH_M


@dataclass(frozen=True)
class Weights:
    """Weights of the fields' similarities, for pairs with two names and for others, and what a contradiction leaves of the score."""

    named: tuple[float, float, float, float, float] = (0.35, 0.2, 0.15, 0.15, 0.15)  # name, kind, class, overlap, length
    unnamed: tuple[float, float, float] = (0.3, 0.3, 0.4)  # class, overlap, length
    other_kind: float = 0.7
    other_name: float = 0.6
    #: Names less similar than this are different names.
    name_floor: float = 0.68
    #: The score at which a match is as likely as not: above what contradicting fields leave of it, below what one wrong field does.
    even: float = 0.68


def _bits(grams: set[str], bits: int) -> int:
    code = 0
    for g in grams:
        code |= 1 << (xxhash.xxh64_intdigest(g.encode()) % bits)
    return code


def name_parts(name: str | None) -> tuple[str, str | None]:
    """What a street is called, without spelling and qualifiers, and its kind (None if the name doesn't say)."""
    words = _WORDS.findall((name or "").lower())
    joined, i = [], 0
    while i < len(words):  # 'green way' is a greenway
        if i + 1 < len(words) and words[i] + words[i + 1] in _KIND_OF and words[i] not in _KIND_OF:
            joined.append(words[i] + words[i + 1])
            i += 2
        else:
            joined.append(words[i])
            i += 1
    kinds = [k for k, w in enumerate(joined) if w in _KIND_OF]
    # a kind at the end, or at the start of a turned name, is the kind; 'Street Lane' is called Street
    at = kinds[-1] if kinds else None
    kind = _KIND_OF[joined[at]] if at is not None else None
    rest = [w for k, w in enumerate(joined) if k != at and w not in QUALIFIERS]
    return " ".join(rest), kind


def name_code(called: str) -> int:
    """Letter pairs of a name as a fixed number of bits."""
    padded = f" {called} "
    return _bits({padded[i : i + 2] for i in range(len(padded) - 1)}, NAME_BITS)


def letter_code(called: str) -> int:
    """Letters of a name, told apart when they come again, as bits: swapped letters make no difference."""
    return _bits({f"{c}{called[:i].count(c)}" for i, c in enumerate(called) if c != " "}, NAME_BITS)


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        codes, letters, kinds, classes = [], [], [], []
        for names, kinds_said in zip(b["names"], b["classes"]):
            parts = [name_parts(n) for n in (names if names is not None else []) if n is not None]
            parts = [p for p in parts if p[0]]
            codes.append([name_code(p[0]) for p in parts])
            letters.append([letter_code(p[0]) for p in parts])
            kinds.append([p[1] or "" for p in parts])
            classes.append(sorted({c.strip().lower() for c in (kinds_said if kinds_said is not None else []) if c is not None and c.strip()}))
        yield pd.DataFrame({"id": b["id"], "lon": b["lon"], "lat": b["lat"], "metres": b["metres"], "codes": codes, "letters": letters, "kinds": kinds, "classes": classes})


def encode_records(rows: DataFrame, key: str, names: list[str], classes: list[str], lon: str, lat: str, length: str, to_metres: float) -> DataFrame:
    """Records with their names as bit codes: id, lon, lat, metres, codes, letters, kinds, classes. Rows without a key or a position are left out."""
    placed = F.col(key).isNotNull() & (F.abs(F.col(lat)) <= 89) & (F.abs(F.col(lon)) <= 180)
    r = rows.where(placed).select(
        F.col(key).cast("bigint").alias("id"), F.array(*[F.col(n).cast("string") for n in names]).alias("names"), F.array(*[F.col(c).cast("string") for c in classes]).alias("classes"),
        F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), (F.col(length) * to_metres).cast("double").alias("metres"),
    ).distinct()
    out = r.mapInPandas(_encode, "id bigint, lon double, lat double, metres double, codes array<bigint>, letters array<bigint>, kinds array<string>, classes array<string>")
    return out.withColumn("metres", F.when(~F.isnan("metres") & (F.col("metres") > 0), F.col("metres")))


def _substrings(code: Column, bits: int, radius: int) -> Column:
    """radius + 1 disjoint parts of a code: two codes at most radius bits apart agree in one of them."""
    edges = [bits * i // (radius + 1) for i in range(radius + 2)]
    parts = [F.shiftright(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) * F.lit(radius + 1) + F.lit(i) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return F.array(*parts)


def _reach() -> Column:
    """Metres that a record and a shorter partner may lie apart at most."""
    return F.least(F.lit(FARTHEST_M / 2), F.lit(SLACK_M) + F.coalesce(F.col("metres"), F.lit(0.0)) / 2)


def _class() -> Column:
    """The class of blocks at least twice as high as a record's reach."""
    return F.greatest(F.lit(0), F.ceil(F.log2(2 * _reach() / BLOCK_M))).cast("int")


def _blocks(r: DataFrame, around: bool) -> DataFrame:
    """The block of each row's class that it lies in or, looking around, those that its reach touches (as a rule two to four): `block`.

    Blocks are rows of equal height, each cut into a whole number of columns at least as wide as high where the row (and the next) is narrowest; columns close
    around the earth. What is touched follows from the sphere, so no pair within reach is missed wherever it lies, and no place
    changes the blocks of others.
    """
    per_degree = F.lit(math.radians(1) * EARTH_M)
    r = r.withColumn("size", F.lit(BLOCK_M) * F.pow(F.lit(2.0), F.col("class")))
    row = lambda metres: F.floor(metres / F.col("size")).cast("bigint")
    y = F.col("lat") * per_degree
    r = r.withColumn("by", F.explode(F.sequence(row(y - F.col("reach")), row(y + F.col("reach")))) if around else row(y))
    pole = F.least(F.lit(90.0), F.greatest(F.abs((F.col("by") - 1) * F.col("size")), F.abs((F.col("by") + 2) * F.col("size"))) / per_degree)
    r = r.withColumn("narrow", F.cos(F.radians(pole)))
    r = r.withColumn("columns", F.greatest(F.lit(1), F.floor(360 * per_degree * F.col("narrow") / F.col("size"))).cast("bigint"))
    column = lambda lon: F.floor((lon + 180) / 360 * F.col("columns")).cast("bigint")
    if around:
        turn = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sin(F.col("reach") / (2 * EARTH_M)) / F.col("narrow")))) * (1 + 1e-9)
        r = r.withColumn("turn", F.coalesce(F.least(F.lit(180.0), turn), F.lit(180.0)))
        r = r.withColumn("bx", F.explode(F.sequence(column(F.col("lon") - F.col("turn")), column(F.col("lon") + F.col("turn"))))).drop("turn")
    else:
        r = r.withColumn("bx", column(F.col("lon")))
    return r.withColumn("block", F.xxhash64("role", "class", F.pmod("bx", "columns"), "by")).drop("size", "by", "bx", "columns", "narrow", "class", *(["reach"] if around else []))


def _named(r: DataFrame) -> DataFrame:
    return r.where(F.size("codes") > 0).withColumn("code", F.explode("codes"))


def _sized(r: DataFrame) -> DataFrame:
    """Records with their length as a code, in the smallest blocks."""
    half, mask = NAME_BITS // 2, (1 << NAME_BITS) - 1
    r = r.where("metres is not null").withColumn("step", F.pmod(F.floor(F.log("metres") / math.log(LENGTH_STEP)), F.lit(NAME_BITS)).cast("int"))
    # a run of ones from the step on, around the code
    return r.withColumn("class", F.lit(0)).withColumn(
        "code", F.expr(f"(shiftleft({(1 << half) - 1}L, step) & {mask}L) | if(step > {half}, shiftright({(1 << half) - 1}L, {NAME_BITS} - step), 0L)")
    )


def _asking(r: DataFrame, named: int, unnamed: int) -> DataFrame:
    """Rows that look around themselves, as far as they reach: named records, for shorter ones; records without a name, for records of like length."""
    one = _named(r).withColumn("class", _class()).withColumn("role", F.lit(named)).withColumn("reach", _reach())
    other = _sized(r.where(F.size("codes") == 0)).withColumn("role", F.lit(unnamed)).withColumn("reach", F.lit(SLACK_M))
    return _blocks(one.select(*_KEPT, "reach").unionByName(other.select(*_KEPT, "reach")), True)


def _answering(r: DataFrame, named: int, unnamed: int, classes: list[int]) -> DataFrame:
    """Rows that lie where others look: named records, in the blocks of each class from their own on; all records with a length."""
    one = _named(r).withColumn("own", _class()).withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes]) if classes else F.expr("array(cast(null as int))")))
    one = one.where(F.col("class") >= F.col("own")).withColumn("role", F.lit(named))
    return _blocks(one.select(*_KEPT).unionByName(_sized(r).withColumn("role", F.lit(unnamed)).select(*_KEPT)), False)


_KEPT = ["role", "class", "id", "lon", "lat", "metres", "code"]


def _metres_apart() -> Column:
    p, q = F.radians("a_lat"), F.radians("b_lat")
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(F.col("b_lon") - F.col("a_lon")) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _side(r: DataFrame, side: str) -> DataFrame:
    return r.select([F.col(c).alias(c if c in ("block", "part", "window") else f"{side}_{c}") for c in r.columns])


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of close codes near each other: exactly those at most NAME_RADIUS bits apart (of their names or, where a name is missing, of their lengths),
    no farther apart than their lengths explain.

    A record is only cut into parts where another record looks for its like: rows of a block in which none does are left out before.
    """
    classes = sorted({r[0] for x in (a, b) for r in _named(x).select(_class()).distinct().collect()})  # about 20 classes reach around the earth
    asks = [_asking(a, 0, 2), _asking(b, 1, 3)]
    answers = [_answering(a, 1, 3, classes), _answering(b, 0, 2, classes)]
    sides = []
    for mine, theirs, ask in ((0, 1, asks[0]), (1, 0, asks[1])):
        wanted = answers[mine].join(asks[theirs].select("block").distinct(), "block", "left_semi")
        both = ask.unionByName(wanted)
        sides.append(both.withColumn("part", F.explode(_substrings(F.col("code"), NAME_BITS, NAME_RADIUS))))
    pairs = _side(sides[0], "a").hint("merge").join(_side(sides[1], "b"), ["block", "part"])
    longer = F.greatest(F.coalesce("a_metres", F.lit(0.0)), F.coalesce("b_metres", F.lit(0.0)))
    shorter = F.least(F.coalesce("a_metres", F.lit(0.0)), F.coalesce("b_metres", F.lit(0.0)))
    near = _metres_apart() <= SLACK_M + F.when(F.col("a_role") < 2, (longer - shorter) / 2).otherwise(0.0)
    # lengths whose steps are a whole code apart have the same bits
    alike = (F.col("a_role") < 2) | (shorter * 2 >= longer)
    close = F.bit_count(F.col("a_code").bitwiseXOR(F.col("b_code"))) <= NAME_RADIUS
    return pairs.where((F.col("a_role") == F.col("b_role")) & close & alike & near).select("a_id", "b_id").distinct()


def scored(pairs: DataFrame, a: DataFrame, b: DataFrame, w: Weights) -> DataFrame:
    """Pairs with the similarities of their fields and the weighted score."""
    both = pairs.join(_side(a, "a").hint("merge"), "a_id").join(_side(b, "b").hint("merge"), "b_id")
    dice = "2D * (bit_count(x.c & y.c) + bit_count(x.l & y.l)) / (bit_count(x.c) + bit_count(y.c) + bit_count(x.l) + bit_count(y.l))"
    said = "transform({0}_codes, (c, i) -> struct(c, {0}_letters[i] as l, {0}_kinds[i] as k))"
    # the most similar of the names; at equal similarity the one whose kind agrees, or is unknown, before one that contradicts
    compare = F.expr(
        f"array_max(flatten(transform({said.format('a')}, x -> transform({said.format('b')}, y -> struct({dice} as name, "
        "case when x.k = '' or y.k = '' then 0 when x.k = y.k then 1 else -1 end as kind)))))"
    )
    apart = _metres_apart()
    long_, short_ = F.greatest("a_metres", "b_metres"), F.least("a_metres", "b_metres")
    grams = "aggregate(transform({0}_classes, c -> transform(sequence(1, greatest(length(c) - 1, 1)), i -> substr(c, i, 2))), cast(array() as array<string>), (s, g) -> array_union(s, g))"
    both = both.withColumn("best", compare).withColumn("apart", apart)
    both = both.withColumn("ratio", short_ / long_).withColumn(
        "overlap", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((long_ + short_) / 2 - F.greatest(F.lit(0.0), F.col("apart") - SLACK_M / 2)) / short_))
    )
    both = both.withColumn("ga", F.expr(grams.format("a"))).withColumn("gb", F.expr(grams.format("b")))
    same = F.arrays_overlap("a_classes", "b_classes")
    both = both.withColumn(
        "class", F.when((F.size("ga") > 0) & (F.size("gb") > 0), F.when(same, 1.0).otherwise(F.size(F.array_intersect("ga", "gb")) / (F.size("ga") + F.size("gb"))))
    )
    length = F.greatest(F.lit(0.0), 1 + F.log(F.col("ratio")) / math.log(2))
    name, kind = F.col("best.name"), F.col("best.kind")

    def mean(parts: list[tuple[float, Column]]) -> Column:
        """Weighted over the fields both records have."""
        top, under = F.lit(0.0), F.lit(0.0)
        for weight, c in parts:
            top, under = top + F.coalesce(c * weight, F.lit(0.0)), under + F.when(c.isNotNull(), weight).otherwise(0.0)
        return F.when(under > 0, top / under).otherwise(0.0)

    n, k, c, o, m = w.named
    named = mean([(n, name), (k, (kind + 1) / 2), (c, F.col("class")), (o, F.col("overlap")), (m, length)])
    named = named * F.when(kind < 0, w.other_kind).otherwise(1.0) * F.when(name < w.name_floor, w.other_name).otherwise(1.0)
    c, o, m = w.unnamed
    unnamed = mean([(c, F.col("class")), (o, F.col("overlap")), (m, length)])
    score = F.when(name.isNotNull(), named).otherwise(unnamed)
    return both.select("a_id", "b_id", name.alias("name"), kind.alias("kind"), "class", "overlap", length.alias("length"), "apart", score.alias("score"))


def calibrate(scores: np.ndarray, counts: np.ndarray, even: float) -> float:
    """Slope of the confidence in the score: the log-odds of two normal components fitted to the scores' histogram on either side of `even`.

    With too few pairs, or none on one side, it is 25.
    """
    low, high = scores < even, scores >= even
    if counts[low].sum() < 10 or counts[high].sum() < 10:
        return 25.0
    mean = [np.average(scores[k], weights=counts[k]) for k in (low, high)]
    spread = [np.average((scores[k] - m) ** 2, weights=counts[k]) for k, m in zip((low, high), mean)]
    pooled = np.average(spread, weights=[counts[low].sum(), counts[high].sum()])
    return float(np.clip((mean[1] - mean[0]) / max(pooled, 1e-3), 5.0, 60.0))


def match_records(a: DataFrame, b: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Pairs of encoded records (see encode_records) with their fields' similarities, score and confidence: a_id, b_id, name, kind, class, overlap,
    length, apart, score, confidence.

    Defined cases: records without a key or position have no pairs; a missing name, kind, class or length leaves the field out of the score
    (records of which neither a name nor a length can be compared have no pair); repeated records count once; a confidence of 0.5
    divides matches from others; empty tables give an empty result.

    Method: letter pairs of names become bit vectors of NAME_BITS bits. Multi-index hashing cuts them into NAME_RADIUS + 1 parts, so that all pairs within
    NAME_RADIUS bits agree in a part and are found exactly by an equality join on block and part; where a name is missing the code of the length
    serves in the same way. Blocks come in classes of doubling size by the length of the longer record. Field similarities are Dice
    coefficients (of bits and letter pairs) and shares of length, weighted; the score's distribution over all candidates calibrates the confidence.
    """
    # the records are read by eight branches, the scores by two: both are written once
    a, b = cut(a), cut(b)
    rows = cut(scored(candidates(a, b), a, b, weights))
    histogram = rows.groupBy(F.round(F.col("score") * 200).cast("int").alias("bin")).count().toPandas()  # at most 201 rows
    slope = calibrate(histogram["bin"].to_numpy(float) / 200, histogram["count"].to_numpy(float), weights.even)
    return rows.withColumn("confidence", 1 / (1 + F.exp(-(F.col("score") - weights.even) * slope)))
