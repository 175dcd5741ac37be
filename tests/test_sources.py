"""Readers, writers and streams through files."""

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from noisegrid.sources import readers, shapefile, writers
from noisegrid.streaming import jobs


def test_geojson_and_sequence(spark, tmp_path):
    doc = {"features": [{"properties": {"PK": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}
    (tmp_path / "cty-1.geojson").write_text(json.dumps(doc))
    with gzip.open(tmp_path / "page.geojson.gz", "wt") as f:
        json.dump(doc, f)
    assert readers.read_geojson(spark, str(tmp_path / "cty-1.geojson"), "PK:int").select("tile_id", "PK").collect() == [("cty-1", 1)]
    assert readers.read_geojson_pages(spark, str(tmp_path / "*.gz"), "PK:int").select("tile_id", "PK").collect() == [("page", 1)]
    way = {"properties": {"id": "w1", "highway": "primary"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}
    node = {"properties": {"id": "n"}, "geometry": {"type": "Point", "coordinates": [0, 0]}}
    (tmp_path / "s.geojsonseq").write_text("".join("\x1e" + json.dumps(x) + "\n" for x in (way, node)) .replace('"coordinates": [0, 0]', '"coordinates": [[0, 0]]'))
    assert [(r.id, r.highway, len(r.geom)) for r in readers.read_geojsonseq(spark, str(tmp_path / "s.geojsonseq")).collect()] == [("w1", "primary", 2)]


def test_level_export(spark, tmp_path):
    (tmp_path / "e.csv").write_text("﻿IDRECEIVER,PERIOD,THE_GEOM,LAEQ,LEQ\n1, d ,SRID=26911;POINT Z (352000.5 3784000 1.5),51.5,60\n", encoding="utf-8")
    assert readers.read_level_export(spark, str(tmp_path / "e.csv")).collect() == [(1, "D", 352000.5, 3784000.0, 1.5, 51.5, 60.0)]


def test_weather_and_curves(spark, tmp_path):
    (tmp_path / "w.psv").write_text("STATION|DATE|temperature|temperature_Quality_Code\nK|2026-01-01T00:00:00|9999|5\n")
    r = readers.read_station_hours(spark, str(tmp_path / "w.psv")).first()
    assert (r.temperature.status, r.temperature_quality) == ("missing_or_variable_code", "5")
    (tmp_path / "NPD_data.csv").write_bytes("NPD_ID;Noise Metric;Op Mode;Power Setting;L_200ft;L_1000ft\nÄ1;SEL;A;100;90.5;80\n".encode("windows-1252"))
    rows = readers.npd_long(readers.read_semicolon(spark, str(tmp_path / "NPD_data.csv"))).orderBy("distance_m").collect()
    assert [(r.npd_id, round(r.distance_m, 2), r.level_db) for r in rows] == [("Ä1", 60.96, 90.5), ("Ä1", 304.8, 80.0)]


def test_transit(spark, tmp_path):
    (tmp_path / "calendar.txt").write_text("service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nW,1,0,0,0,0,0,1,20260101,20260131\n")
    t = readers.read_gtfs(spark, str(tmp_path))
    assert t["trips"].count() == 0 and readers.calendar_days(t["calendar"]).first().dow == [0, 6]


def test_traces_and_paths(spark, tmp_path):
    good = {"icao": "abc", "t": "C172", "timestamp": 100.0, "trace": [[0.5, 34.0, -118.0, "ground", 1, 2, 0], [5, 34.1, -118.1, 1200, 1, 2, 2]]}
    for name, body in (("a", json.dumps(good)), ("b", "{broken")):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            f.write(body)
    rows = readers.read_traces(spark, str(tmp_path / "*.json.gz")).orderBy("idx").collect()
    ok = [r for r in rows if not r.corrupt]
    assert [(r.epoch, r.alt_state, r.new_leg) for r in ok] == [(100.5, "ground", False), (105.0, "numeric", True)] and sum(r.corrupt for r in rows) == 1
    paths = spark.createDataFrame([("p", 1.0, [(1.0, 2.0, 3.0), (2.0, 3.0, 4.0)])], "path_id string, start double, points array<struct<epoch:double,x:double,y:double>>")
    writers.write_paths(paths, str(tmp_path / "paths"))
    assert readers.read_paths(spark, str(tmp_path / "paths")).count() == 2
    with pytest.raises(ValueError, match="identities"):
        writers.write_paths(paths.withColumn("icao", F.lit("x")), str(tmp_path / "no"))
    with pytest.raises(ValueError, match="bytes"):
        writers.write_paths(paths, str(tmp_path / "no"), 10)


def test_shapefile(spark, tmp_path):
    points = [(0.0, 0.0), (1.0, 2.0)]
    body = struct.pack("<I4d2I1I", 3, 0, 0, 1, 2, 1, 2, 0) + b"".join(struct.pack("<2d", *p) for p in points)
    (tmp_path / "r.shp").write_bytes(b"\0" * 100 + struct.pack(">II", 1, len(body) // 2) + body)
    name = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    (tmp_path / "r.dbf").write_bytes(struct.pack("<BBBBIHH", 3, 0, 0, 0, 1, 32 + 32 + 1, 11) + b"\0" * 20 + name + b"\r" + b" " + b"Main St".ljust(10))
    r = readers.read_shapefiles(spark, str(tmp_path / "*"), ["NAME"]).first()
    assert r.NAME == "Main St" and [(p.x, p.y) for p in r.geom] == points


def test_shapefiles_are_read_in_runs(spark, tmp_path):
    """What the data source writes it reads back, in runs of records; deleted records and points are skipped."""
    lines = [[(float(k), float(i * k)) for i in range(2 + k % 4)] for k in range(57)]
    rows = [(line, f"n{k}", None if k % 5 == 0 else "é") for k, line in enumerate(lines)]
    frame = spark.createDataFrame(rows, "geom array<struct<x:double,y:double>>, NAME string, NOTE string").repartition(2)
    shapefile.register(spark)
    frame.write.format("shapefile").mode("append").option("records", 20).save(str(tmp_path / "s"))
    stems = {p.stem for p in (tmp_path / "s").glob("*.shp")}
    assert len(stems) >= 3
    for glob, records in (("part*", 7), ("part*", 50_000)):
        back = readers.read_shapefiles(spark, str(tmp_path / "s" / glob), ["NAME", "NOTE"], records)
        assert back.rdd.getNumPartitions() >= (57 // 7 if records == 7 else len(stems))
        assert {(tuple((p.x, p.y) for p in r.geom), r.NAME, r.NOTE) for r in back.collect()} == {(tuple(g), n, o or "") for g, n, o in rows}
    assert spark.read.format("shapefile").load(str(tmp_path / "s" / "part*")).columns == ["file", "record", "geom", "NAME", "NOTE"]
    one = next(p for p in (tmp_path / "s").glob("*.dbf"))
    data = bytearray(one.read_bytes())
    head, width = struct.unpack("<HH", data[8:12])
    data[head + 2 * width] = ord("*")
    one.write_bytes(data)
    again = readers.read_shapefiles(spark, str(tmp_path / "s" / "part*"), ["NAME"], 7)
    assert again.count() == 56
    (tmp_path / "s" / f"{one.stem}.shx").unlink()
    assert readers.read_shapefiles(spark, str(tmp_path / "s" / "part*"), ["NAME"], 7).count() == 56
    assert readers.read_shapefiles(spark, str(tmp_path / "s" / "none*"), ["NAME"]).count() == 0
    with pytest.raises(Exception, match="longer than"):
        frame.limit(1).withColumn("NAME", F.lit("x" * 70)).write.format("shapefile").mode("append").save(str(tmp_path / "long"))


def test_grids(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 4.0)], "row int, col int, z double")
    writers.write_ascii_grid(cells, str(tmp_path / "g"), 100.0, 200.0, 10.0, 2, 2)
    back = readers.read_ascii_grid(spark, str(tmp_path / "g" / "part*")).collect()
    assert sorted((r.row, r.col, r.x, r.y, r.z) for r in back if r.z is not None) == [(0, 0, 105.0, 205.0, 1.0), (0, 1, 115.0, 205.0, 2.0), (1, 1, 115.0, 215.0, 4.0)] and len(back) == 4


def test_other_writers(spark, tmp_path):
    pts = spark.createDataFrame([("t", "k", 1.0, 2.0, "D", 50.0)], "tile_id string, receiver_key string, x double, y double, period string, laeq double")
    writers.write_features(pts, str(tmp_path / "f"))
    assert json.loads(spark.read.text(str(tmp_path / "f")).first()[0])["geometry"]["coordinates"] == [1.0, 2.0]
    writers.write_tile_documents(pts, str(tmp_path / "t"), pts.select("tile_id"))
    writers.write_rail_results(pts, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).first().rail_d == 50.0
    writers.write_cells(pts.withColumn("cells", F.array(F.struct(F.lit(1).alias("cell_e"), F.lit(2).alias("cell_n")), F.struct(F.lit(1).alias("cell_e"), F.lit(3).alias("cell_n")))), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    writers.write_receipt(str(tmp_path / "x"), pts=pts, again=pts.repartition(3))
    assert len({r.sha256 for r in spark.read.json(str(tmp_path / "x")).collect()}) == 1
    writers.write_pyramid(spark.createDataFrame([(1, 0, 0, 0, 0, 1.0)], "z int, x int, y int, py int, px int, value double"), str(tmp_path / "p"))
    writers.write_csv(pts, str(tmp_path / "csv"))
    shards = tmp_path / "s.json"
    shards.write_text("[[1,2,3,0,4,5,6,7,8,9],[1,2]]")
    assert readers.read_dense_shards(spark, str(shards)).count() == 1


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    done = query.awaitTermination(90)
    query.stop()
    assert done


def test_stream_levels_equal_batch(spark, tmp_path):
    rows = [("e1", "s", 7200, 60.0), ("e1", "s", 7200, 60.0), ("e2", "s", 7260, 60.0), ("e3", "s", 11_200, 70.0), ("z", "s", 90_000, 50.0)]
    df = spark.createDataFrame(rows, "event_id string, site string, t int, sel double").withColumn("ts", F.timestamp_seconds("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_laeq(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    drain(stream.writeStream.outputMode("append").format("memory").queryName("laeq").option("checkpointLocation", str(tmp_path / "ck")))
    got = {r.start.timestamp(): (r.laeq, r.n) for r in spark.table("laeq").collect()}
    assert {n for _, n in got.values()} == {2, 1} and min(v for v, _ in got.values()) == pytest.approx(63.0103 - 35.563, abs=1e-3)


def test_stream_throughput(spark, tmp_path):
    df = spark.createDataFrame([("h", 0, 100, 10), ("h", 600, 200, 10), ("h", 90_000, 1, 1)], "host string, t int, receivers int, seconds int").withColumn("ended", F.timestamp_seconds("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_throughput(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    drain(stream.writeStream.outputMode("append").format("memory").queryName("tp").option("checkpointLocation", str(tmp_path / "ck")))
    assert 15.0 in {r.per_second for r in spark.table("tp").collect()}
