"""Registered queries through files: whole tables are written in a format and read back; their SQL gives the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from noisegrid.functions import geometry as G
from noisegrid.operators import lidar, outlines
from noisegrid.plans.queries import _orders, _rings, _round_all, query
from noisegrid.plans.views import ctes, view
from noisegrid.shared import new_path
from noisegrid.sources import readers, shapefile, writers

c = F.col


def _text(df, value, name):
    """Lines of text, written; their path."""
    path = new_path(df.sparkSession, name)
    df.select(value.alias("value")).write.text(path)
    return path


@query(ctes("segs") + " SELECT concat('w', seg_id) AS id, CASE WHEN seg_id % 2 = 0 THEN 'primary' ELSE 'residential' END AS highway, CAST(2 AS INTEGER) AS points, ax, by_ AS \"by\" FROM segs WHERE seg_id % 3 <> 0")
def sequence_of_streets(spark, sf_dir):
    """Lines of a GeoJSON text sequence; what is no line goes."""
    i = c("seg_id")
    geometry = F.struct(F.when(i % 3 == 0, "MultiLineString").otherwise("LineString").alias("type"), F.array(F.array("ax", "ay"), F.array("bx", "by")).alias("coordinates"))
    feature = F.struct(F.concat(F.lit("w"), i.cast("string")).alias("id"), F.struct(F.when(i % 2 == 0, "primary").otherwise("residential").alias("highway")).alias("properties"), geometry.alias("geometry"))
    path = _text(view(spark, sf_dir, "segs"), F.concat(F.lit("\x1e"), F.to_json(feature)), "seq")
    rows = readers.read_geojsonseq(spark, path)
    return rows.select("id", "highway", F.size("geom").alias("points"), c("geom")[0]["x"].alias("ax"), c("geom")[1]["y"].alias("by"))


@query(ctes("blds") + " SELECT CAST(bld_id AS INTEGER) AS \"PK\", kind AS \"KIND\", 'Polygon' AS geometry_type, cx - half_w AS x, cy + half_h AS y FROM blds")
def feature_collection(spark, sf_dir):
    """Footprints as the features of one document for each tile."""
    ring = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(F.struct(c("bld_id").cast("int").alias("PK"), c("kind").alias("KIND")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    tiles = _rings(spark, sf_dir).groupBy((c("bld_id") % 8).alias("t")).agg(F.collect_list(feature).alias("features"))
    path = new_path(spark, "tiles")
    tiles.repartition(8, "t").select(F.to_json(F.struct("features")).alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    rows = readers.read_geojson_pages(spark, f"{path}/*.gz", "PK:int,KIND:string")
    return rows.select("PK", "KIND", "geometry_type", c("coordinates")[0][0][0].alias("x"), c("coordinates")[0][2][1].alias("y"))


@query(ctes("segs") + " SELECT concat('r', seg_id) AS record_id, CAST(seg_id % 7 + 1 AS VARCHAR) AS f_system, CAST(CAST(aadt AS BIGINT) AS VARCHAR) AS aadt, CASE WHEN seg_id % 4 <> 0 THEN '55' END AS speed_limit, bx FROM segs")
def traffic_records(spark, sf_dir):
    i = c("seg_id")
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array("ax", "ay"), F.array("bx", "by")).alias("coordinates"))
    record = F.struct(F.concat(F.lit("r"), i.cast("string")).alias(":id"), (i % 7 + 1).cast("string").alias("f_system"), c("aadt").cast("long").cast("string").alias("aadt"), F.when(i % 4 != 0, "55").alias("speed_limit"), line.alias("line"))
    rows = readers.read_traffic_records(spark, _text(view(spark, sf_dir, "segs"), F.to_json(record), "records"))
    return rows.select("record_id", "f_system", "aadt", "speed_limit", c("geom")[1]["x"].alias("bx"))


@query(ctes("pts") + " SELECT pk, CASE pk % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'E' ELSE 'N' END AS period, x, y, 1.5::DOUBLE AS z, CASE WHEN pk % 11 <> 0 THEN laeq END AS laeq FROM pts")
def level_exports(spark, sf_dir):
    """Level exports with their points as texts."""
    pts = view(spark, sf_dir, "pts")
    period = F.element_at(F.array(F.lit("d"), F.lit(" E "), F.lit("N")), (c("pk") % 3 + 1).cast("int"))
    geom = F.format_string("SRID=26911;POINT Z (%s %s 1.5)", c("x").cast("string"), c("y").cast("string"))
    path = new_path(spark, "export")
    writers.write_csv(pts.select(c("pk").alias("IDRECEIVER"), period.alias("PERIOD"), geom.alias("THE_GEOM"), F.when(c("pk") % 11 != 0, c("laeq").cast("string")).otherwise("none").alias("LAEQ"), c("laeq").alias("LEQ")), path)
    return readers.read_level_export(spark, path).select("pk", "period", "x", "y", "z", "laeq")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) / 10 END AS temperature, CASE WHEN o_orderkey % 3 = 0 THEN 'missing_or_variable_code' ELSE 'reported' END AS status, CAST(o_orderkey % 9 AS VARCHAR) AS quality FROM orders")
def station_hours(spark, sf_dir):
    k = c("o_orderkey")
    path = new_path(spark, "station")
    rows = _orders(spark, sf_dir).select(k.alias("STATION"), F.lit("2026-01-01T00:00:00").alias("DATE"), F.when(k % 3 == 0, "9999").otherwise((c("o_custkey").cast("double") / 10).cast("string")).alias("temperature"), (k % 9).alias("temperature_Quality_Code"))
    rows.write.option("header", True).option("sep", "|").csv(path)
    back = readers.read_station_hours(spark, path)
    return back.select(c("STATION").cast("long").alias("k"), c("temperature.value").alias("temperature"), c("temperature.status").alias("status"), c("temperature_quality").alias("quality"))


@query("SELECT concat('Ä', p_partkey) AS npd_id, CAST(p_size AS DOUBLE) AS power, ft * 0.3048::DOUBLE AS distance_m, 100 - p_size - ft / 1000.0::DOUBLE AS level_db FROM part CROSS JOIN (VALUES (200), (1000), (4000)) f(ft)")
def wide_curves(spark, sf_dir):
    """Semicolon tables in an old code page: wide curves to long ones."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = new_path(spark, "npd")
    level = lambda ft: (100 - c("p_size") - ft / 1000.0).alias(f"L_{ft}ft")
    part.select(F.concat(F.lit("Ä"), c("p_partkey").cast("string")).alias("NPD_ID"), F.lit("SEL").alias("Noise Metric"), F.lit("D").alias("Op Mode"), c("p_size").alias("Power Setting"), level(200), level(1000), level(4000)).write.option("header", True).option("sep", ";").option("encoding", "iso-8859-1").csv(f"{path}/NPD_data.csv")
    long = readers.npd_long(readers.read_npd_tables(spark, path, ("NPD_data",))["NPD_data"])
    return long.select("npd_id", "power", "distance_m", F.round("level_db", 9).alias("level_db"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, concat('R', o_custkey % 6) AS route_id, CAST(o_custkey % 20 AS VARCHAR) AS service_id, CAST(0 AS BIGINT) AS exceptions FROM orders")
def transit_folder(spark, sf_dir):
    """A transit folder without the table of exceptions."""
    path = new_path(spark, "gtfs")
    writers.write_csv(_orders(spark, sf_dir).select(F.concat(F.lit("R"), (c("o_custkey") % 6).cast("string")).alias("route_id"), (c("o_custkey") % 20).alias("service_id"), c("o_orderkey").alias("trip_id")), f"{path}/trips.txt")
    gtfs = readers.read_gtfs(spark, path)
    none = gtfs["calendar_dates"].agg(F.count("*").alias("exceptions"))
    return gtfs["trips"].select("trip_id", "route_id", "service_id").crossJoin(F.broadcast(none))


@query(ctes("trace") + " SELECT ident, CAST(row_number() OVER (PARTITION BY ident ORDER BY pt_id) - 1 AS INTEGER) AS idx, 1000 + t_s AS epoch, alt_state, alt_ft, track_deg FROM trace")
def trace_documents(spark, sf_dir):
    """A document for each trace, rows of mixed types inside."""
    t = view(spark, sf_dir, "trace")
    text = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    row = F.concat(F.lit("["), F.concat_ws(",", text(c("t_s")), F.lit("34.1"), F.lit("-118.2"), F.when(c("alt_state") == "ground", F.lit('"ground"')).otherwise(text(c("alt_ft"))), F.lit("120"), text(c("track_deg")), F.lit("0")), F.lit("]"))
    one = t.groupBy("ident").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pt_id", row.alias("row")))), lambda x: x["row"]), ",").alias("rows"))
    document = F.format_string('{"icao":"%d","t":"C172","timestamp":1000.0,"trace":[%s]}', "ident", "rows")
    path = new_path(spark, "traces")
    one.select(document.alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    back = readers.read_traces(spark, f"{path}/*.gz")
    return back.select(c("ident").cast("long").alias("ident"), "idx", "epoch", "alt_state", "alt_ft", "track_deg")


@query(ctes("trace") + " SELECT CAST(ident AS VARCHAR) AS path_id, CAST(row_number() OVER (PARTITION BY ident ORDER BY t_s) - 1 AS INTEGER) AS idx, t_s AS epoch, x, y FROM trace")
def stored_paths(spark, sf_dir):
    points = F.sort_array(F.collect_list(F.struct(c("t_s").alias("epoch"), "x", "y")))
    paths = view(spark, sf_dir, "trace").groupBy(c("ident").cast("string").alias("path_id")).agg(F.min("t_s").alias("start"), points.alias("points"))
    path = new_path(spark, "paths")
    writers.write_paths(paths, path)
    return readers.read_paths(spark, path).select("path_id", "idx", "epoch", "x", "y")


@query(ctes("pts") + ', g AS (SELECT CAST(floor((y - 3784000) / 200) AS INT) AS r, CAST(floor((x - 352000) / 200) AS INT) AS c, max(laeq) AS z FROM pts WHERE pk % 3 = 0 GROUP BY 1, 2) SELECT r AS "row", c AS col, 352000 + (c + 0.5) * 200.0::DOUBLE AS x, 3784000 + (r + 0.5) * 200.0::DOUBLE AS y, z FROM g')
def terrain_file(spark, sf_dir):
    cells = view(spark, sf_dir, "pts").where("pk % 3 = 0").groupBy(F.floor((c("y") - 3784000) / 200).cast("int").alias("row"), F.floor((c("x") - 352000) / 200).cast("int").alias("col")).agg(F.max("laeq").alias("z"))
    path = new_path(spark, "grid")
    writers.write_ascii_grid(cells, path, 352000.0, 3784000.0, 200.0, 20, 20)
    return readers.read_ascii_grid(spark, f"{path}/part*").where("z is not null").select(c("row").cast("int").alias("row"), c("col").cast("int").alias("col"), "x", "y", "z")


@query(ctes("obs") + " SELECT CAST(obs_id AS DOUBLE) AS id, -118 - obs_id % 100 / 1000.0::DOUBLE AS lon, laeq AS d23 FROM obs WHERE obs_id % 6 <> 0")
def dense_shards(spark, sf_dir):
    """Receivers as arrays of ten numbers in a shard; others are left out."""
    k = c("obs_id")
    values = F.array(k.cast("double"), -118 - (k % 100) / 1000.0, F.lit(34.0), F.lit(1.0), c("laeq"), *[F.lit(0.0)] * 5)
    rows = view(spark, sf_dir, "obs").select((k % 16).alias("s"), F.when(k % 6 == 0, F.slice(values, 1, 4)).otherwise(values).alias("v"))
    shards = rows.groupBy("s").agg(F.to_json(F.collect_list("v")).alias("value"))
    path = new_path(spark, "shards")
    shards.repartition(16, "s").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_dense_shards(spark, f"{path}/part*").select("id", "lon", "d23")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 = 0 THEN 'excluded' WHEN c_custkey % 3 <> 0 THEN 'located' ELSE 'unresolved' END AS status, c_custkey % 3 <> 0 AS placed FROM customer")
def monitor_sites(spark, sf_dir):
    k = c("c_custkey")
    site = F.struct(k.cast("string").alias("id"), F.when(k % 3 != 0, -118.5).alias("lon"), F.when(k % 3 != 0, 34.2).alias("lat"), F.when(k % 5 == 0, "moved").alias("exclude"))
    path = _text(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.to_json(site), "sites")
    return readers.read_sites(spark, path, lines=True).select("id", "status", c("utm").isNotNull().alias("placed"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS runway_end, CAST(n_nationkey * 10 AS DOUBLE) AS heading, CASE WHEN n_nationkey % 2 = 0 THEN 34.5 ELSE 34.0 END::DOUBLE AS lat, CASE WHEN n_nationkey % 2 = 0 THEN 'displaced' ELSE 'end' END AS place_source, CASE WHEN n_nationkey % 4 = 0 THEN 801.0 ELSE 800.0 END::DOUBLE AS elevation_ft, CASE WHEN n_nationkey % 4 = 0 THEN 'displaced' ELSE 'end' END AS elevation_source FROM nation")
def runway_ends(spark, sf_dir):
    k = c("n_nationkey")
    even = k % 2 == 0
    end = F.struct(k.cast("string").alias("RWY_END_ID"), (k * 10).cast("double").alias("TRUE_ALIGNMENT"), F.lit(34.0).alias("LAT_DECIMAL"), F.lit(-118.0).alias("LONG_DECIMAL"), F.when(even, 34.5).alias("LAT_DISPLACED_THR_DECIMAL"), F.when(even, -118.5).alias("LONG_DISPLACED_THR_DECIMAL"), F.lit(800.0).alias("RWY_END_ELEV"), F.when(k % 4 == 0, 801.0).alias("DISPLACED_THR_ELEV"))
    ends = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.collect_list(F.struct(end.alias("attributes"))).alias("features"))
    return readers.read_runways(spark, _text(ends, F.to_json(F.struct("features")), "runways")).select("runway_end", "heading", "lat", "place_source", "elevation_ft", "elevation_source")


@query("SELECT concat('S', n_nationkey) AS service, CAST(n_nationkey AS DOUBLE) / 10 AS d, CAST(1 AS INTEGER) AS stops, -118 - n_nationkey / 100.0::DOUBLE AS stop_x, CAST(n_nationkey % 3 AS INTEGER) AS class_order, concat('C', n_nationkey % 3) AS class FROM nation")
def line_config(spark, sf_dir):
    """Services, stations and classes of a rail line."""
    k = c("n_nationkey")
    name = lambda letter: F.concat(F.lit(letter), k.cast("string"))
    service = F.struct(F.lit("T").alias("trainset"), (k / 10).alias("D"), F.lit(0.0).alias("E"), F.lit(0.0).alias("N"), F.array(name("P")).alias("stops"), F.lit(80.0).alias("speed_kmh"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    pick = lambda i: F.filter(F.collect_list(F.struct(k.alias("k"), name("S").alias("s"))), lambda x: x["k"] % 3 == i)
    classes = F.array(*[F.struct(F.lit(f"C{i}").alias("name"), F.lit("Main").alias("name_contains"), F.transform(pick(i), lambda x: x["s"]).alias("services")) for i in range(3)])
    document = nation.agg(F.map_from_entries(F.collect_list(F.struct(name("S"), service))).alias("services"), F.map_from_entries(F.collect_list(F.struct(name("P"), F.array(-118 - k / 100.0, F.lit(34.0))))).alias("stations"), classes.alias("classes"))
    path = _text(document, F.to_json(F.struct("services", "stations", "classes")), "line")
    of = readers.read_line_classes(spark, path).select("class_order", "class", F.explode("services").alias("service"))
    rows = readers.read_line_config(spark, path).join(of, "service")
    return rows.select("service", "d", F.size("stops").alias("stops"), c("stops")[0]["x"].alias("stop_x"), "class_order", "class")


@query(ctes("blds") + " SELECT bld_id, CAST(1 AS INTEGER) AS holes, round(4 * half_w * half_h * 1e-12 * 1e12, 0) > 0 AS kept FROM blds WHERE bld_id % 4 <> 0")
def footprints_in_metres(spark, sf_dir):
    """Footprints in degrees with a hole as rings in metres; tiny ones go."""
    k = c("bld_id")
    p = lambda i, j, s: F.array(-118.5 + (i * c("half_w") * s) / 92_000, 34.2 + (j * c("half_h") * s) / 111_000)
    ring = lambda s: F.array(*[p(i, j, s) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    rows = view(spark, sf_dir, "blds").select("bld_id", "half_w", "half_h", F.array(F.when(k % 4 == 0, F.array(ring(0.05), ring(0.01))).otherwise(F.array(ring(1.0), ring(0.2)))).alias("coordinates"))
    kept = readers.footprint_rings(rows)
    exact = F.abs(G.ring_area(c("ring")) / (4 * c("half_w") * c("half_h")) - 1) < 0.02
    return kept.select("bld_id", F.size("holes").alias("holes"), exact.alias("kept"))


@query(ctes("pts") + " SELECT 'features' AS name, count(*) AS n, sum(pk)::BIGINT AS keys FROM pts UNION ALL SELECT 'cells', 2 * count(*), 2 * sum(pk)::BIGINT FROM pts UNION ALL SELECT 'tiles', count(*), sum(pk)::BIGINT FROM pts UNION ALL SELECT 'pyramid', count(*), sum(pk)::BIGINT FROM pts")
def written_layers(spark, sf_dir):
    """Features, cells, tile documents and pyramids as they are read back."""
    pts = view(spark, sf_dir, "pts").withColumns({"tile_id": (c("pk") % 8).cast("string"), "z": (c("pk") % 3).cast("int")})
    path = new_path(spark, "layers")
    writers.write_features(pts, f"{path}/features")
    cell = lambda n: F.struct(F.floor(c("x") / 1000).cast("int").alias("cell_e"), F.lit(n).alias("cell_n"))
    writers.write_cells(pts.withColumn("cells", F.array(cell(1), cell(2))), f"{path}/cells")
    writers.write_tile_documents(pts, f"{path}/documents", pts.groupBy("tile_id").count())
    writers.write_pyramid(pts, f"{path}/pyramid")
    features = spark.read.schema("properties struct<pk:long>").json(f"{path}/features").select("properties.pk")
    read = (("features", features), ("cells", spark.read.parquet(f"{path}/cells")), ("tiles", spark.read.schema("pk long").json(f"{path}/documents/tiles")), ("pyramid", spark.read.parquet(f"{path}/pyramid")))
    out = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("pk").alias("keys")) for name, df in read]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query(ctes("obs") + " SELECT receiver_id % 7 AS tile_id, receiver_id AS receiver_key, max(CASE WHEN period = 'D' THEN laeq END) AS rail_d, max(CASE WHEN period = 'N' THEN laeq END) AS rail_n FROM obs GROUP BY 1, 2")
def written_rail(spark, sf_dir):
    path = new_path(spark, "rail")
    writers.write_rail_results(view(spark, sf_dir, "obs").select((c("receiver_id") % 7).alias("tile_id"), c("receiver_id").alias("receiver_key"), "period", "laeq"), path)
    return spark.read.parquet(path).select(c("tile_id").cast("long").alias("tile_id"), "receiver_key", "rail_d", "rail_n")


_COVERED = ctes("pts") + """, c AS (SELECT DISTINCT CAST(floor(x / 100) AS BIGINT) AS e, CAST(floor(y / 100) AS BIGINT) AS n FROM pts WHERE (CAST(floor(x / 100) AS BIGINT) * 7919 + CAST(floor(y / 100) AS BIGINT) * 104729) % 11 > 3),
b AS (SELECT e, n, e AS le, n AS ln FROM c UNION SELECT c.e, c.n, b.le, b.ln FROM b JOIN c ON abs(c.e - b.e) + abs(c.n - b.n) = 1),
l AS (SELECT e, n, min(le * 10000000 + ln) AS k FROM b GROUP BY e, n)"""


def _covered(spark, sf_dir):
    cells = view(spark, sf_dir, "pts").select(G.cell_of(c("x"), c("y"), 100.0).alias("c")).select("c.*")
    return cells.where((c("cell_e").cast("long") * 7919 + c("cell_n").cast("long") * 104729) % 11 > 3).distinct()


@query(_COVERED.replace("WITH ", "WITH RECURSIVE ", 1) + """, v AS (SELECT k, e + i AS x, n + j AS y, count(*) AS m, count(DISTINCT i) AS di, count(DISTINCT j) AS dj FROM l CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j) GROUP BY k, x, y),
q AS (SELECT k, count(*) FILTER (m = 1) AS q1, count(*) FILTER (m = 3) AS q3, count(*) FILTER (m = 2 AND di = 2 AND dj = 2) AS qd FROM v GROUP BY k),
s AS (SELECT k, count(*) AS cells, 4 * count(*) - sum((SELECT count(*) FROM l o WHERE o.k = l.k AND abs(o.e - l.e) + abs(o.n - l.n) = 1)) AS perimeter FROM l GROUP BY k)
SELECT cells * 10000.0::DOUBLE AS area, CAST(perimeter AS DOUBLE) * 100 AS perimeter, CAST(1 - (q1 - q3 - 2 * qd) / 4 AS BIGINT) AS holes, CAST(q1 + q3 + 2 * qd AS BIGINT) AS corners FROM s JOIN q USING (k)""")
def coverage_polygons(spark, sf_dir):
    """Polygons around covered cells: area without holes, length of all rings, holes, corners."""
    rings, sides = outlines.coverage_rings(_covered(spark, sf_dir), 100.0)
    length = sides.groupBy("ring").agg(F.sum(F.abs(c("x2") - c("x1")) + F.abs(c("y2") - c("y1"))).alias("length"))
    out = rings.join(length, "ring").groupBy("polygon").agg(F.sum("area").alias("area"), F.sum("length").alias("perimeter"), F.count_if(~c("outer")).alias("holes"), F.sum("sides").alias("corners"))
    return out.drop("polygon")


@query(_COVERED.replace("WITH ", "WITH RECURSIVE ", 1) + """ SELECT 'coverage' AS name, count(DISTINCT k)::BIGINT AS n, count(*) * 10000.0::DOUBLE AS total FROM l
UNION ALL SELECT 'percentiles', 101, round(sum(v), 3) FROM (SELECT unnest(quantile_cont(laeq, """ + str([k / 100 for k in range(101)]) + """)) AS v FROM pts)
UNION ALL SELECT 'counts', count(DISTINCT receiver_id)::BIGINT, round(sum(CAST(35 AS DOUBLE) + CAST(event_id % 400 AS DOUBLE) / CAST(10 AS DOUBLE)), 3) FROM (SELECT user_id AS receiver_id, event_id FROM events) UNION ALL SELECT 'receipts', 2, NULL FROM (SELECT 1)""")
def written_index(spark, sf_dir):
    """The layer index read back: areas from the rings of its features, percentiles, counts, and receipts that don't
    depend on order."""
    obs, path = view(spark, sf_dir, "obs"), new_path(spark, "index")
    rings, sides = outlines.coverage_rings(_covered(spark, sf_dir), 100.0)
    percentiles = view(spark, sf_dir, "pts").agg(F.percentile("laeq", [k / 100 for k in range(101)]).alias("v")).select(F.posexplode("v").alias("percent", "level"))
    counts = obs.groupBy("receiver_id").agg(F.sum("laeq").alias("total"))
    writers.write_layer_index(path, outlines.polygons(rings, sides), percentiles, counts)
    writers.write_receipt(f"{path}/receipt", one=obs, two=obs.repartition(5))
    cross = lambda r, i: F.get(r, i)[0] * F.get(r, i + 1)[1] - F.get(r, i + 1)[0] * F.get(r, i)[1]
    doubled = lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), F.lit(0.0), lambda a, i: a + cross(r, i))
    area = F.aggregate(F.transform("geometry.coordinates", doubled), F.lit(0.0), lambda a, v: a + v) / 2
    features = spark.read.json(f"{path}/coverage").agg(F.lit("coverage").alias("name"), F.count("*").alias("n"), F.sum(area).alias("total"))
    levels = spark.read.json(f"{path}/percentiles").agg(F.lit("percentiles").alias("name"), F.count("*").alias("n"), F.sum("level").alias("total"))
    sums = spark.read.json(f"{path}/counts").agg(F.lit("counts").alias("name"), F.count("*").alias("n"), F.sum("total").alias("total"))
    same = spark.read.json(f"{path}/receipt").groupBy("sha256").agg(F.lit("receipts").alias("name"), F.count("*").alias("n"), F.lit(None).cast("double").alias("total")).drop("sha256")
    return _round_all(features.union(levels).union(sums).union(same), 3)


@query(ctes("segs") + " SELECT CAST(seg_id AS VARCHAR) AS \"SEG\", CASE WHEN seg_id % 3 = 0 THEN NULL ELSE 'road ' || seg_id % 3 END AS \"NAME\", ax, ay, bx, by_ AS \"by\" FROM segs")
def shapefile_records(spark, sf_dir):
    """Lines through shapefiles whose records are read in runs."""
    path, i = new_path(spark, "shapes"), c("seg_id")
    ends = F.array(F.struct(c("ax").alias("x"), c("ay").alias("y")), F.struct(c("bx").alias("x"), c("by").alias("y")))
    rows = view(spark, sf_dir, "segs").select(ends.alias("geom"), i.cast("string").alias("SEG"), F.when(i % 3 != 0, F.concat(F.lit("road "), (i % 3).cast("string"))).alias("NAME"))
    shapefile.register(spark)
    rows.repartition(2).write.format("shapefile").mode("append").option("records", 40).save(path)
    back = readers.read_shapefiles(spark, f"{path}/part*", ["SEG", "NAME"], 15)
    at = lambda k, o: c("geom")[k][o]
    return back.select("SEG", F.nullif("NAME", F.lit("")).alias("NAME"), at(0, "x").alias("ax"), at(0, "y").alias("ay"), at(1, "x").alias("bx"), at(1, "y").alias("by"))


@query(ctes("pts") + """, h AS (SELECT pk, x, y, laeq AS z, pk * 7919 % 1000003 AS h FROM pts),
d AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 256), floor(y / 256), floor(z / 256) ORDER BY h, pk) AS a, row_number() OVER (PARTITION BY floor(x / 128), floor(y / 128), floor(z / 128) ORDER BY h, pk) AS b,
       row_number() OVER (PARTITION BY floor(x / 64), floor(y / 64), floor(z / 64) ORDER BY h, pk) AS c, row_number() OVER (PARTITION BY floor(x / 32), floor(y / 32), floor(z / 32) ORDER BY h, pk) AS e FROM h)
SELECT pk, x, y, z, CAST(CASE WHEN a = 1 THEN 0 WHEN b = 1 THEN 1 WHEN c = 1 THEN 2 WHEN e = 1 THEN 3 ELSE 4 END AS INTEGER) AS depth FROM d
WHERE (a = 1 OR b = 1 OR c = 1) AND x BETWEEN 352500 AND 354100 AND y BETWEEN 3784700 AND 3786100""")
def points_at_depth(spark, sf_dir):
    """Points of a box at the three coarsest depths, from a table written by depth and cell."""
    path, pts = new_path(spark, "points"), view(spark, sf_dir, "pts").withColumnRenamed("laeq", "z")
    lidar.write_points(pts, path, "pk", 256.0, 4, c("pk") * 7919 % 1000003)
    return lidar.scan_points(spark.read.parquet(path), 352500.0, 3784700.0, 354100.0, 3786100.0, 2).select("pk", "x", "y", "z", "depth")
