"""Readers, writers, the streaming extension and the registered queries."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pathloom.sources import readers, writers
from pathloom.streaming.traces import sessions, windowed_speeds


def test_geojson(spark, tmp_path):
    way = lambda i, pts, **p: {"type": "Feature", "properties": {"@id": str(i), "@type": "way", **p}, "geometry": {"type": "LineString", "coordinates": pts}}
    feats = [
        way(1, [[0, 0], [1, 1]], highway="road", oneway="-1", **{"tiger:x": "1", "surface": "dirt", "note": "n"}), way(1, [[0, 0], [1, 1]], highway="road", oneway="-1"), way(2, [[2, 2], [3, 3]], highway="path"),
        {"type": "Feature", "properties": {"@id": "9", "@type": "node", "crossing": "yes"}, "geometry": {"type": "Point", "coordinates": [5, 6]}},
    ]
    whole, lines = tmp_path / "whole.json", tmp_path / "lines.json"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    lines.write_text("\n".join(map(json.dumps, feats)))
    for f in (whole, lines):
        ways, nodes = readers.geojson(spark, str(f), ["highway", "oneway"], ["note"])
        got = {r["osmid"]: r for r in ways.collect()}
        assert sorted(got) == [1, 2] and got[1]["oneway"] == "yes" and [tuple(p) for p in got[1]["geometry"]] == [(1.0, 1.0), (0.0, 0.0)]
        assert set(got[1]["all_tags"]) <= {"surface"} and got[2]["highway"] == "path"
        assert [(r["osmid"], tuple(r["geometry"])) for r in nodes.collect()] == [(9, (5.0, 6.0))]


def test_overpass_and_restrictions(spark, tmp_path):
    f = tmp_path / "o.json"
    f.write_text(json.dumps({"version": 1, "elements": [{"type": "way", "id": 7, "nodes": [1, 2], "tags": {"highway": "road"}}]}, indent=1))
    assert [(r["osmid"], r["nodes"], r["tags"]) for r in readers.overpass(spark, str(f)).collect()] == [(7, [1, 2], {"highway": "road"})]
    members = [("way", 1, "from"), ("way", 2, "from"), ("node", 5, "via"), ("way", 3, "to")]
    schema = "osmid bigint, tags map<string,string>, members array<struct<type:string,ref:bigint,role:string>>"
    rel = spark.createDataFrame([(1, {"type": "restriction", "restriction:hgv": "no_left_turn"}, members), (2, {"type": "route"}, members)], schema)
    assert sorted(tuple(r) for r in readers.restrictions(rel).collect()) == [(1, "hgv", "no_left_turn", 1, 3), (1, "hgv", "no_left_turn", 2, 3)]


def test_csv_scans(spark, tmp_path):
    (tmp_path / "od.csv").write_text("w_geocode,h_geocode,S000,SA01\n01,02,5,1\n")
    assert [tuple(r) for r in readers.flows(spark, str(tmp_path / "od.csv")).collect()] == [("01", "02", 5)]
    for i in (1, 2):
        (tmp_path / f"t{i}.csv").write_text(f"hh_id,person_id,x\n{i}.0,7,z\n")
    got = readers.trip_lists(spark, [str(tmp_path / "t1.csv"), str(tmp_path / "t2.csv")], ["hh_id", "person_id"], ["hh_id"])
    assert sorted(tuple(r) for r in got.collect()) == [("1", "7"), ("2", "7")]
    (tmp_path / "trip.csv").write_text("5,6,commute,d,2015-01-01 00:00:00,2015-01-01 01:00:00,9\n")
    assert readers.headerless(spark, str(tmp_path / "trip.csv"), readers.TRIPS, ["description"]).first()["num_points"] == 9


def test_gtfs(spark, tmp_path):
    files = {
        "stops": "stop_id,stop_name,stop_lat,stop_lon\nA,a,1,2\nB,b,3,4\n", "routes": "route_id,route_short_name,route_type\nr,1,3\nq,2,0\n", "trips": "route_id,service_id,trip_id\nr,wk,t\nq,wk,u\nr,su,v\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,08:00:00,08:00:30,A,1\nt,25:10:00,25:10:00,B,2\nu,08:00:00,08:00:00,A,1\nv,08:00:00,08:00:00,A,1\n",
        "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\n",
    }
    for n, text in files.items():
        (tmp_path / f"{n}.txt").write_text(text)
    feed = readers.gtfs(spark, str(tmp_path), F.col("service_id") == "wk")
    assert sorted((r["trip_id"], r["departure_sec"]) for r in feed["stop_times"].collect()) == [("t", 28830), ("t", 90600), ("u", 28800)]
    assert sorted((r["route_id"], r["stop_id"]) for r in readers.route_and_stop(feed).collect()) == [("r", "A"), ("r", "B")]


def test_bounds_reach_the_scan(spark, tmp_path):
    df = spark.range(10).select("id", F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y")), F.struct((F.col("id") + 1.0).alias("x"), F.lit(1.0).alias("y"))).alias("geometry"))
    writers.write_layer(readers.with_bounds(df, "geometry"), str(tmp_path / "layer"))
    got = readers.layer(spark, str(tmp_path / "layer"), (2.5, 0.0, 4.5, 1.0))
    assert sorted(r["id"] for r in got.collect()) == [2, 3, 4]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = readers.layer(spark, str(tmp_path / "layer"), (2.5, 0.0, 4.5, 1.0))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(minx" in plan and "GreaterThanOrEqual(maxx" in plan
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_layer(df, str(tmp_path / "layer"))


def test_models(spark, tmp_path):
    path = str(tmp_path / "models")
    m = spark.createDataFrame([("all", "base", 0, 1.0), ("all", "base", 1, 2.0), ("f", "base", 0, 3.0)], "subset string, calibration_name string, run_num int, loss double")
    writers.write_models(m, path)
    writers.write_models(m.where("subset = 'f'").withColumn("loss", F.lit(9.0)), path)
    back = writers.read_models(spark, path)
    assert sorted((r["subset"], r["run_num"], r["loss"]) for r in back.collect()) == [("all", 0, 1.0), ("all", 1, 2.0), ("f", 0, 9.0)]
    assert sorted(tuple(r) for r in writers.next_run(back).collect()) == [("all", "base", 2), ("f", "base", 1)]


def test_streams_and_tables_agree(spark, tmp_path):
    rows = [(1, 10, 5.0), (1, 200, 7.0), (1, 400, 1.0), (2, 5000, 3.0), (1, 9000, 3.0), (9, 99_999, 0.0)]
    df = spark.createDataFrame(rows, "trip int, t bigint, v double").select("trip", F.timestamp_seconds("t").alias("at"), "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for f, name in ((lambda d: windowed_speeds(d, "trip", "at", "v"), "w"), (lambda d: sessions(d, "trip", "at"), "s")):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {tuple(r) for r in spark.table(name).collect()}
        want = {tuple(r) for r in f(df).where("trip <> 9").collect()}
        assert got == want  # the last ping only moves the watermark on


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 90


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n not in {"shortest_path_cost", "bounded_sssp"}][::3])
def test_queries_equal_sql(spark, data, name):
    """A third of the queries on the smallest tables; the driver compares all."""
    duckdb = pytest.importorskip("duckdb")
    import os

    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    got = entry.queries()[name](spark, data).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    show = lambda v: "" if v is None or v != v else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    norm = lambda d: sorted(tuple(show(v) for v in r) for r in d[cols].astype(object).itertuples(index=False, name=None))
    assert norm(got) == norm(want)
