"""Readers: explicit schemas, nothing inferred, everything split-able as it is read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noisegrid.functions import acoustics, text
from noisegrid.functions import geometry as G
from noisegrid.sources import shapefile

POINT = "struct<x:double,y:double>"


def read_geojson(spark: SparkSession, path: str, properties: str, geometry: str = "array<array<array<double>>>") -> DataFrame:
    """One row per feature: its properties, geometry type and coordinates, and the file's name without extensions.

    `properties` and `geometry` are DDL types; a document is one split.
    """
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:{geometry}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)*$", 1)
    return rows.select(name.alias("tile_id"), F.explode("features").alias("f")).select("tile_id", "f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_geojson_pages(spark: SparkSession, glob: str, properties: str, geometry: str = "array<array<array<double>>>") -> DataFrame:
    """Paged, gzipped documents: a page is a split, a page's file name its tile_id."""
    return read_geojson(spark, glob, properties, geometry)


def read_geojsonseq(spark: SparkSession, path: str, tags: tuple[str, ...] = ("highway", "lanes", "oneway", "maxspeed", "service", "name")) -> DataFrame:
    """Lines of a GeoJSON text sequence (a record separator before each): LineStrings with id and the kept tags."""
    schema = f"id string, properties struct<{','.join(f'{t}:string' for t in ('id', *tags))}>, geometry struct<type:string,coordinates:array<array<double>>>"
    rows = spark.read.text(path).select(F.from_json(F.ltrim("value", F.lit("\x1e")), schema).alias("f"))
    line = F.transform("f.geometry.coordinates", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.where("f.geometry.type = 'LineString'").select(F.coalesce("f.id", "f.properties.id").alias("id"), *[F.col(f"f.properties.{t}").alias(t) for t in tags], line.alias("geom"))


def read_traffic_records(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON traffic records with their line inside; numbers stay strings for functions.text.number."""
    names = ("f_system", "facility_type", "aadt", "aadt_single_unit", "aadt_combination", "speed_limit")
    schema = T.StructType([T.StructField(":id", T.StringType()), *[T.StructField(n, T.StringType()) for n in names], T.StructField("line", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType())))]))])
    rows = spark.read.schema(schema).json(path)
    line = F.transform("line.coordinates", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select(F.col("`:id`").alias("record_id"), *names, line.alias("geom"))


def read_level_export(spark: SparkSession, path: str) -> DataFrame:
    """(pk, period, x, y, z, laeq, leq) of a CSV export with a byte order mark and `SRID;POINT Z (x y z)` texts."""
    names = ("IDRECEIVER", "PERIOD", "THE_GEOM", "LAEQ", "LEQ")
    raw = spark.read.option("header", True).csv(path)
    raw = raw.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿").strip().upper()) for c in raw.columns]).select(*names)
    at = lambda i: F.regexp_extract("THE_GEOM", r"\(\s*(\S+)\s+(\S+)(?:\s+(\S+))?\s*\)", i).try_cast("double")
    return raw.select(F.col("IDRECEIVER").try_cast("long").alias("pk"), F.upper(F.trim("PERIOD")).alias("period"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), F.col("LAEQ").try_cast("double").alias("laeq"), F.col("LEQ").try_cast("double").alias("leq"))


def read_station_hours(spark: SparkSession, path: str, variables: tuple[str, ...] = ("temperature", "altimeter", "wind_speed", "wind_direction")) -> DataFrame:
    """Hourly station weather, pipe-separated: time, and (value, status) with the quality code of each variable."""
    raw = spark.read.option("header", True).option("sep", "|").csv(path)
    kept = [v for v in variables if v in raw.columns]
    cols = [c for v in kept for c in (text.weather_value(F.col(v)).alias(v), (F.col(f"{v}_Quality_Code") if f"{v}_Quality_Code" in raw.columns else F.lit(None).cast("string")).alias(f"{v}_quality"))]
    return raw.select("STATION", F.to_timestamp("DATE").alias("ts"), *cols)


def read_semicolon(spark: SparkSession, path: str) -> DataFrame:
    """A table of the aircraft data set: semicolons, Windows-1252 (read as Latin-1; the 27 letters that differ follow)."""
    raw = spark.read.option("header", True).option("sep", ";").option("encoding", "iso-8859-1").csv(path)
    differ = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
    latin, own = "".join(map(chr, differ)), bytes(differ).decode("cp1252")
    return raw.select(*[F.translate(f"`{c}`", latin, own).alias(c) for c in raw.columns])


def read_npd_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = ("NPD_data", "Default_fixed_point_profiles", "Aircraft")) -> dict[str, DataFrame]:
    return {n: read_semicolon(spark, f"{folder}/{n}.csv") for n in names}


def npd_long(df: DataFrame) -> DataFrame:
    """Wide curves (columns L_<feet>ft) as (npd_id, metric, op, power, distance_m, level_db)."""
    feet = {c: float(c[2:-2]) for c in df.columns if c.startswith("L_") and c.endswith("ft")}
    rows = df.unpivot(["NPD_ID", "Noise Metric", "Op Mode", "Power Setting"], list(feet), "name", "level")
    return rows.select(F.col("NPD_ID").alias("npd_id"), F.col("Noise Metric").alias("metric"), F.col("Op Mode").alias("op"), F.col("Power Setting").try_cast("double").alias("power"), (F.regexp_extract("name", r"L_(\d+)ft", 1).cast("double") * 0.3048).alias("distance_m"), F.col("level").try_cast("double").alias("level_db"))


#: The columns that the transit tables are read with.
GTFS = {
    "routes": ("route_id", "route_short_name", "route_long_name", "route_type"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon", "parent_station"),
    "trips": ("route_id", "service_id", "trip_id", "direction_id"),
    "stop_times": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
}


def read_gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The transit tables as strings; one that is missing is empty, a column that is missing null."""
    out = {}
    for name, cols in GTFS.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
        try:
            raw = spark.read.option("header", True).csv(f"{folder}/{name}.txt")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            out[name] = spark.createDataFrame([], schema)
            continue
        out[name] = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in cols])
    return out


def calendar_days(calendar: DataFrame) -> DataFrame:
    """Services with their weekdays as an array (0 Monday) and dates."""
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    dow = F.array_compact(F.array(*[F.when(F.col(d) == "1", F.lit(i)) for i, d in enumerate(days)]))
    return calendar.select("service_id", dow.alias("dow"), F.to_date("start_date", "yyyyMMdd").alias("start_date"), F.to_date("end_date", "yyyyMMdd").alias("end_date"))


def read_traces(spark: SparkSession, glob: str) -> DataFrame:
    """Points of aircraft trace documents (one gzipped JSON each): ident, type and the typed fields of each row.

    A document that can't be read gives one row with `corrupt` and no point. A folder's documents are listed at once,
    not one by one.
    """
    folder, _, name = glob.rpartition("/")
    schema = "icao string, t string, timestamp double, trace string, _corrupt_record string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    rows = rows.option("pathGlobFilter", name).json(folder) if folder and "*" in name and not set(folder) & set("*?[{") else rows.json(glob)
    each = rows.select(F.col("icao").alias("ident"), F.col("t").alias("type_code"), "timestamp", F.col("_corrupt_record").isNotNull().alias("corrupt"), F.posexplode_outer(F.from_json("trace", "array<array<string>>")).alias("idx", "row"))
    return each.select("ident", "type_code", "corrupt", "idx", acoustics.point_record(F.col("row"), F.col("timestamp")).alias("p")).select("ident", "type_code", "corrupt", "idx", "p.*")


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """Points of stored paths (path_id, points array<struct<epoch, x, y>>)."""
    rows = spark.read.schema("path_id string, start double, points array<struct<epoch:double,x:double,y:double>>").json(path)
    return rows.select("path_id", F.posexplode("points").alias("idx", "p")).select("path_id", "idx", "p.*")


def read_shapefiles(spark: SparkSession, glob: str, attributes: list[str], records: int = 50_000) -> DataFrame:
    """(file, geom, attributes) of all .shp under glob (a pattern without extension), each with its .dbf.

    Where a pair has an index (.shx), every `records` records are one task's work; else the pair is.
    """
    shapefile.register(spark)
    rows = spark.read.format("shapefile").option("attributes", ",".join(attributes)).option("records", records).load(glob)
    return rows.select("file", "geom", *attributes)


def read_ascii_grid(spark: SparkSession, glob: str) -> DataFrame:
    """(file, row, col, x, y, z) of ESRI ASCII grids; rows count from the bottom, nodata is null.

    Header lines and rows are told apart by their first word; a grid is one split, for its rows have no number.
    """
    raw = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("file"), F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    head = F.map_from_entries(F.transform(F.filter("lines", lambda x: x.rlike("^[A-Za-z]")), lambda x: F.struct(F.lower(F.split(x, r"\s+")[0]).alias("k"), F.split(x, r"\s+")[1].cast("double").alias("v"))))
    rows = raw.select("file", head.alias("h"), F.filter("lines", lambda x: ~x.rlike("^[A-Za-z]")).alias("lines"))
    rows = rows.select("file", "h", F.size("lines").alias("n"), F.posexplode("lines").alias("top", "line")).select("file", "h", (F.col("n") - 1 - F.col("top")).alias("row"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "z"))
    size = F.col("h")["cellsize"]
    z = F.col("z").try_cast("double")
    return rows.select("file", "row", "col", (F.col("h")["xllcorner"] + (F.col("col") + 0.5) * size).alias("x"), (F.col("h")["yllcorner"] + (F.col("row") + 0.5) * size).alias("y"), F.when(~z.eqNullSafe(F.coalesce(F.col("h")["nodata_value"], F.lit(-9999.0))), z).alias("z"))


def read_line_config(spark: SparkSession, path: str) -> DataFrame:
    """Services of a rail line: (service, trainset, d, e, n, speed_kmh, stops)."""
    schema = "services map<string,struct<trainset:string,D:double,E:double,N:double,stops:array<string>,speed_kmh:double>>, stations map<string,array<double>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    each = rows.select("stations", F.explode(F.map_entries("services")).alias("s"))
    at = F.transform("s.value.stops", lambda n: F.struct(F.col("stations")[n][0].alias("x"), F.col("stations")[n][1].alias("y")))
    return each.select(F.col("s.key").alias("service"), F.col("s.value.trainset").alias("trainset"), *[F.col(f"s.value.{p}").alias(p.lower()) for p in "DEN"], F.col("s.value.speed_kmh").alias("speed_kmh"), at.alias("stops"))


def read_line_classes(spark: SparkSession, path: str) -> DataFrame:
    """Classes of a rail line in order, for roads.classify_lines: (class_order, class, pattern, x1, y1, x2, y2,
    services). The first that fits a line counts; a missing side of a box is open."""
    schema = "classes array<struct<name:string,name_contains:string,lon_min:double,lat_min:double,lon_max:double,lat_max:double,services:array<string>>>"
    each = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("classes").alias("class_order", "k"))
    pattern = F.concat(F.lit("\\Q"), F.coalesce("k.name_contains", F.lit("")), F.lit("\\E"))
    sides = [F.coalesce(f"k.{a}", F.lit(b)).alias(n) for a, b, n in (("lon_min", -180.0, "x1"), ("lat_min", -90.0, "y1"), ("lon_max", 180.0, "x2"), ("lat_max", 90.0, "y2"))]
    return each.select("class_order", F.col("k.name").alias("class"), pattern.alias("pattern"), *sides, F.col("k.services").alias("services"))


def read_dense_shards(spark: SparkSession, glob: str) -> DataFrame:
    """Receivers of shards: arrays of ten numbers; rows that aren't are left out."""
    names = ("id", "lon", "lat", "family", "d23", "e23", "n23", "d585", "e585", "n585")
    rows = spark.read.text(glob, wholetext=True).select(F.explode(F.from_json("value", "array<array<double>>")).alias("r"))
    return rows.where("size(r) = 10 and r[0] is not null and r[1] is not null and r[2] is not null").select(*[F.col("r")[i].alias(n) for i, n in enumerate(names)])


def read_sites(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Monitors and sites, one document or a site a line; those without coordinates stay, with their status."""
    rows = spark.read.schema("id string, airport string, location string, lon double, lat double, position_uncertainty_m double, measured map<string,double>, exclude string").option("multiLine", not lines).json(path)
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return rows.withColumn("status", F.when(F.col("exclude").isNotNull(), "excluded").when(known, "located").otherwise("unresolved")).withColumn("utm", F.when(known, G.lonlat_to_utm(F.col("lon"), F.col("lat"))))


def read_runways(spark: SparkSession, path: str) -> DataFrame:
    """Runway ends: the displaced threshold where there is one, with the source of place and elevation."""
    schema = "features array<struct<attributes:struct<RWY_END_ID:string,TRUE_ALIGNMENT:double,LAT_DECIMAL:double,LONG_DECIMAL:double,LAT_DISPLACED_THR_DECIMAL:double,LONG_DISPLACED_THR_DECIMAL:double,RWY_END_ELEV:double,DISPLACED_THR_ELEV:double>>>"
    a = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.attributes.*")
    moved = F.col("LAT_DISPLACED_THR_DECIMAL").isNotNull() & F.col("LONG_DISPLACED_THR_DECIMAL").isNotNull()
    return a.select(
        F.col("RWY_END_ID").alias("runway_end"), F.col("TRUE_ALIGNMENT").alias("heading"),
        F.when(moved, F.col("LAT_DISPLACED_THR_DECIMAL")).otherwise(F.col("LAT_DECIMAL")).alias("lat"), F.when(moved, F.col("LONG_DISPLACED_THR_DECIMAL")).otherwise(F.col("LONG_DECIMAL")).alias("lon"),
        F.when(moved, "displaced").otherwise("end").alias("place_source"), F.coalesce(F.when(moved, F.col("DISPLACED_THR_ELEV")), F.col("RWY_END_ELEV")).alias("elevation_ft"), F.when(moved & F.col("DISPLACED_THR_ELEV").isNotNull(), "displaced").otherwise("end").alias("elevation_source"),
    )


def footprint_rings(df: DataFrame, least_m2: float = 4.0) -> DataFrame:
    """Polygon or multi-polygon footprints in degrees as outer rings in metres, one row per part; small parts go.

    `coordinates` is an array of polygons, each an array of rings.
    """
    rows = df.withColumn("_p", F.explode("coordinates"))
    ring = F.transform(F.col("_p")[0], lambda p: G.lonlat_to_utm(p[0], p[1]))
    holes = F.transform(F.slice("_p", 2, 1 << 20), lambda r: F.transform(r, lambda p: G.lonlat_to_utm(p[0], p[1])))
    rows = rows.withColumns({"ring": ring, "holes": holes}).drop("_p", "coordinates")
    return rows.where((F.size("ring") >= 4) & (G.ring_area(F.col("ring")) >= least_m2))
