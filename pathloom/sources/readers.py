"""Scans: street features, raw ways, restrictions, flows, trip lists, timetables, with pruning and pushdown left to Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Coded trip and user tables without a header.
TRIPS = "tripid bigint, userid bigint, trip_type string, description string, starttime timestamp, endtime timestamp, num_points int"
USERS = (
    "userid bigint, created_date timestamp, device string, email string, age int, gender int, income int, ethnicity int, homeZIP string, schoolZip string, workZip string, "
    "cycling_freq int, rider_history int, rider_type int, app_version string"
)
GTFS = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "routes": "route_id string, route_short_name string, route_long_name string, route_type int",
    "trips": "route_id string, service_id string, trip_id string, shape_id string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
}


def layer(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, bounds: tuple[str, str, str, str] = ("minx", "miny", "maxx", "maxy")) -> DataFrame:
    """A Parquet layer, of a study area (west, south, east, north) only what may touch it: the predicate on its bounds columns reaches the scan."""
    df = spark.read.parquet(path)
    if box is None:
        return df
    w, s, e, n = (F.col(c) for c in bounds)
    return df.where((w <= box[2]) & (e >= box[0]) & (s <= box[3]) & (n >= box[1]))


def with_bounds(df: DataFrame, geometry: str) -> DataFrame:
    """A layer with the bounds columns that make it prunable."""
    of = lambda f, c: f(F.transform(geometry, lambda p: p[c]))
    return df.withColumns({"minx": of(F.array_min, "x"), "miny": of(F.array_min, "y"), "maxx": of(F.array_max, "x"), "maxy": of(F.array_max, "y")})


def renamed(df: DataFrame, parts: dict[str, str]) -> DataFrame:
    """The first column whose name contains a text gets a name: {'_A': 'A', '_B': 'B'}."""
    names = {}
    for part, to in parts.items():
        hit = next((c for c in df.columns if part in c and c not in names), None)
        if hit is not None:
            names[hit] = to
    return df.withColumnsRenamed(names)


def geojson(spark: SparkSession, path: str, tags: Sequence[str], removed: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Ways and nodes of a feature collection: osmid, chosen tags as columns, the others (but tiger* and removed ones) in `all_tags`, geometry as points.

    Ways that come twice count once; a one-way of -1 is turned round and becomes yes. A file is a task's unit: large extracts come as newline-delimited features,
    one a line, which are split.
    """
    props = T.MapType(T.StringType(), T.StringType())
    feature = T.StructType([T.StructField("id", T.StringType()), T.StructField("properties", props), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])
    raw = spark.read.text(path, wholetext=False)
    one = F.from_json("value", feature)
    many = F.from_json("value", T.StructType([T.StructField("features", T.ArrayType(feature))]))
    lines = raw.withColumn("_m", many).select(F.explode(F.when(F.col("_m.features").isNotNull(), F.col("_m.features")).otherwise(F.array(one))).alias("f")).where("f.geometry is not null")
    p = F.col("f.properties")
    rest = F.map_filter(p, lambda k, _: ~k.isin(*tags, *removed, "@id", "@type", "id", "type") & ~k.startswith("tiger"))
    rows = lines.select(
        F.coalesce(F.try_element_at(p, F.lit("@id")), F.try_element_at(p, F.lit("id")), F.regexp_extract("f.id", r"(\d+)$", 1)).cast("bigint").alias("osmid"),
        F.coalesce(F.try_element_at(p, F.lit("@type")), F.try_element_at(p, F.lit("type"))).alias("type"), *[F.try_element_at(p, F.lit(t)).alias(t) for t in tags], rest.alias("all_tags"),
        F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("_c"),
    )
    pt = lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))
    ways = rows.where("geom_type = 'LineString'").withColumn("geometry", F.transform(F.from_json("_c", "array<array<double>>"), pt)).drop("_c").dropDuplicates(["osmid"])
    if "oneway" in tags:
        back = F.col("oneway") == "-1"
        ways = ways.withColumn("geometry", F.when(back, F.reverse("geometry")).otherwise(F.col("geometry"))).withColumn("oneway", F.when(back, "yes").otherwise(F.col("oneway")))
    nodes = rows.where("geom_type = 'Point'").withColumn("geometry", pt(F.from_json("_c", "array<double>"))).drop("_c")
    return ways, nodes


def overpass(spark: SparkSession, path: str) -> DataFrame:
    """Elements of an Overpass answer: osmid, type, nodes and tags."""
    schema = "elements array<struct<type:string,id:bigint,nodes:array<bigint>,tags:map<string,string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e")).select(F.col("e.id").alias("osmid"), "e.type", "e.nodes", "e.tags")


def restrictions(relations: DataFrame) -> DataFrame:
    """Turn restrictions of relations (osmid, tags, members array<struct<type,ref,role>>): relation, kind, restriction, from_way, to_way; several ways give several rows.

    'restriction:hgv' has the kind 'hgv'.
    """
    entry = F.filter(F.map_entries("tags"), lambda e: e["key"].startswith("restriction"))
    of = lambda role: F.explode(F.transform(F.filter("members", lambda m: (m["role"] == role) & (m["type"] == "way")), lambda m: m["ref"]))
    r = relations.withColumn("_e", F.get(entry, F.lit(0))).where("_e is not null")
    r = r.withColumn("from_way", of("from"))
    r = r.withColumn("to_way", of("to"))
    kind = F.nullif(F.get(F.split("_e.key", ":"), F.lit(1)), F.lit(""))
    return r.select(F.col("osmid").alias("relation"), kind.alias("kind"), F.col("_e.value").alias("restriction"), "from_way", "to_way")


def flows(spark: SparkSession, path: str) -> DataFrame:
    """Job flows between blocks (gzipped CSV): work and home block as text, total_jobs. Only three columns are parsed."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("w_geocode").alias("work_blockid"), F.col("h_geocode").alias("home_blockid"), F.col("S000").cast("bigint").alias("total_jobs"))


def trip_lists(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Several trip files as one, of the columns needed, ids as text."""
    raw = spark.read.option("header", True).csv(list(paths)).select(*columns)
    return raw.withColumns({c: F.regexp_replace(F.col(c), r"\..*$", "") for c in ids})


def headerless(spark: SparkSession, path: str, schema: str, drop: Sequence[str] = ()) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=False).drop(*drop)


def gtfs(spark: SparkSession, folder: str, service: Column | None = None) -> dict[str, DataFrame]:
    """The feed's tables, trips of a service only (a condition on trips), and seconds since midnight for times (also beyond 24:00)."""
    out = {}
    for name, schema in GTFS.items():
        raw = spark.read.option("header", True).csv(f"{folder}/{name}.txt")
        fields = [f.strip().split(" ") for f in schema.split(",")]
        out[name] = raw.select(*[F.col(c).cast(t).alias(c) for c, t in fields if c in raw.columns])
    if service is not None:
        out["trips"] = out["trips"].where(service)
    secs = lambda c: F.aggregate(F.transform(F.split(c, ":"), lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s * 60 + x)
    times = out["stop_times"]
    times = times.withColumns({c.replace("_time", "_sec"): secs(c) for c in ("arrival_time", "departure_time") if c in times.columns})
    out["stop_times"] = times.join(out["trips"].select("trip_id"), "trip_id", "left_semi")
    return out


def route_and_stop(feed: dict[str, DataFrame], without_types: Sequence[int] = (0,)) -> DataFrame:
    """Which route calls at which stop, once each, with the stop's place."""
    r = feed["routes"].where(~F.coalesce(F.col("route_type").isin(*without_types), F.lit(False))) if without_types else feed["routes"]
    calls = feed["stop_times"].join(feed["trips"].select("trip_id", "route_id"), "trip_id").select("route_id", "stop_id").distinct()
    return calls.join(r.select("route_id", "route_type"), "route_id").join(feed["stops"], "stop_id")
