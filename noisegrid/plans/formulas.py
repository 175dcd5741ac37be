"""Registered queries over column functions: each applies several to whole tables; its SQL says the same by other words."""

from __future__ import annotations

from pyspark.sql import functions as F

from noisegrid.functions import acoustics as A
from noisegrid.functions import geometry as G
from noisegrid.functions import levels as L
from noisegrid.functions import text as X
from noisegrid.functions import timefns as T
from noisegrid.functions import traffic
from noisegrid.functions.sql import geodesic_inverse
from noisegrid.plans.queries import _orders, _rings, _round_all, query
from noisegrid.plans.views import ctes, view

c = F.col


@query(ctes("obs") + """, o AS (SELECT obs_id, laeq, CAST(50 + obs_id % 8000 AS DOUBLE) AS hz, CASE WHEN obs_id % 3 <> 0 THEN laeq - 5 END AS part FROM obs),
w AS (SELECT *, hz * hz AS q, pow(10.0::DOUBLE, laeq / 10) AS p FROM o)
SELECT obs_id, round(CASE WHEN part IS NULL THEN laeq ELSE 10 * log10(p + pow(10.0::DOUBLE, part / 10)) END, 4) AS both,
round(20 * log10(148693636.0::DOUBLE * q * q / ((q + 424.36) * sqrt(q + 11599.29) * sqrt(q + 544496.41) * (q + 148693636.0))) + 2, 4) AS weight,
round(greatest(0, least(1, (laeq - 40) / 30)), 6) AS share, round_even(laeq / 3, 1) AS tenth, CAST(round_even(laeq * 10 / 3, 0) AS INTEGER) AS deci, round_even(laeq * 10 / 3, 0) / 10 AS back,
round(10 * log10((12 * p + 3 * pow(10.0::DOUBLE, (laeq + 3) / 10) + 9 * pow(10.0::DOUBLE, (laeq + 6) / 10)) / 24), 4) AS roads,
round(10 * log10(greatest(p * (pow(10.0::DOUBLE, -1.61) + pow(10.0::DOUBLE, -0.76) + pow(10.0::DOUBLE, -0.62)), p * (pow(10.0::DOUBLE, -1.71) + pow(10.0::DOUBLE, -0.66) + pow(10.0::DOUBLE, -0.62)))), 4) AS power FROM w""")
def level_functions(spark, sf_dir):
    """Sums of two levels, A-weights, shares, roundings, the daily level without aircraft, octave-band power."""
    x = c("laeq")
    bands = lambda *d: F.array(*[x + v for v in d])
    rows = view(spark, sf_dir, "obs").select(
        "obs_id",
        L.energy_add(x, F.when(c("obs_id") % 3 != 0, x - 5)).alias("both"),
        L.a_weighting((50 + c("obs_id") % 8000).cast("double")).alias("weight"),
        F.round(L.normalize(x, 40.0, 70.0), 6).alias("share"),
        L.round_db(x / 3).alias("tenth"),
        L.to_decidb(x / 3).cast("int").alias("deci"),
        L.from_decidb(L.to_decidb(x / 3)).alias("back"),
        L.without_aircraft(x, x - 2, x - 4).alias("roads"),
        L.source_power(bands(0, 1, -3), bands(-1, 2, -3), [-16.1, -8.6, -3.2]).alias("power"),
    )
    return rows.select(*[F.round(n, 4).alias(n) if n in ("both", "weight", "roads", "power") else c(n) for n in rows.columns])


@query("""WITH t AS (SELECT o_orderkey AS k, o_orderkey % 6 AS m, o_orderkey % 5 AS n, CAST(o_custkey AS DOUBLE) / 10 AS v FROM orders)
SELECT k, CASE m WHEN 0 THEN v WHEN 1 THEN v WHEN 5 THEN -v * 100 END AS number, CASE m WHEN 0 THEN v WHEN 1 THEN v WHEN 5 THEN -v * 100 ELSE 7.0 END AS number_or,
round(CASE n WHEN 0 THEN 60 WHEN 1 THEN 60 * 1.609344 WHEN 2 THEN 45 ELSE 30 END, 6)::DOUBLE AS speed,
round(CASE m WHEN 0 THEN 4.5 WHEN 1 THEN 14 * 0.3048 WHEN 2 THEN 14 * 0.3048 WHEN 5 THEN 3 ELSE 4.3 END, 6)::DOUBLE AS height, m IN (3, 4) AS imputed,
m = 1 OR n = 2 AS hospital, CASE m WHEN 0 THEN 'rpm_per_engine' WHEN 1 THEN 'percent_per_engine' WHEN 2 THEN 'hp_per_engine' WHEN 3 THEN 'lb_per_engine' WHEN 4 THEN 'lb_per_engine' END AS unit,
CASE n WHEN 0 THEN v END AS weather, CASE n WHEN 0 THEN 'reported' WHEN 1 THEN 'missing_or_variable_code' WHEN 2 THEN 'missing_or_variable_code' ELSE 'missing' END AS status,
round((1000 + n - 1013.25) / 33.8638866667 * 1000, 6)::DOUBLE AS feet, year_of AS year FROM t JOIN (SELECT o_orderkey AS k2, greatest(CASE WHEN o_orderkey % 3000 BETWEEN 1900 AND 2099 THEN o_orderkey % 3000 END, CAST(year(o_orderdate) AS BIGINT)) AS year_of FROM orders) ON k = k2""")
def text_functions(spark, sf_dir):
    """Numbers, speeds, heights, hospitals, units, weather codes, altimeter corrections and years from texts."""
    k, v = c("o_orderkey"), (c("o_custkey").cast("double") / 10).cast("string")
    pick = lambda of, *xs: F.element_at(F.array(*[F.lit(x) if not hasattr(x, "alias") else x for x in xs]), (of + 1).cast("int"))
    m, n = k % 6, k % 5
    number = pick(m, v, F.concat(F.lit(" "), v, F.lit(" ")), "NaN", "x1", "", F.concat(F.lit("-"), v, F.lit("e2")))
    height = X.wall_height(pick(m, "4.5 m", "14'", "14 ft", "20 m", "tall", "3"))
    weather = X.weather_value(pick(n, v, "9999", "-999.9", "", None))
    return _orders(spark, sf_dir).select(
        k.alias("k"),
        X.number(number).alias("number"),
        X.number(number, 7.0).alias("number_or"),
        F.round(X.speed_kmh(pick(n, "60", "60 mph", "45 km/h", "none", None), 30.0), 6).alias("speed"),
        F.round(height["value"], 6).alias("height"),
        height["imputed"].alias("imputed"),
        X.is_hospital(F.concat(pick(m, "Fire", "St. Mary HOSPITAL", "School", "Park", "Hall", "Mall"), pick(n, "", " A", " Medical", " B", ""))).alias("hospital"),
        X.power_unit(pick(m, "RPM", "% thrust", "Shaft HP", "Thrust (lb)", "CNT", "other")).alias("unit"),
        weather["value"].alias("weather"),
        weather["status"].alias("status"),
        F.round(X.pressure_alt_correction(1000.0 + n), 6).alias("feet"),
        T.source_year(F.concat(F.lit("v"), (k % 3000).cast("string"), F.lit(" of "), F.year("o_orderdate").cast("string"), F.lit(", 12345"))).cast("long").alias("year"),
    )


@query(ctes("blds") + """ SELECT b.bld_id, CASE WHEN b.bld_id % 4 = 0 THEN concat('lariac:', b.bld_id) ELSE concat('dpw:', b.bld_id, '@', CAST(cx AS BIGINT), ',', CAST(cy AS BIGINT)) END AS building_key,
CASE WHEN b.bld_id % 3 = 0 THEN concat('t', b.bld_id % 9, ':grid:', b.bld_id) ELSE concat('facade:', b.bld_id) END AS receiver_key, CASE WHEN b.bld_id % 3 = 0 THEN concat('grid:', b.bld_id) ELSE CAST(b.bld_id AS VARCHAR) END AS short_key, b.bld_id % 4 <> 3 AS same FROM blds b""")
def key_functions(spark, sf_dir):
    """Keys of buildings and receivers, and rings that are the same up to their first vertex and direction."""
    b, ring = _rings(spark, sf_dir), c("ring")
    turned = F.concat(F.slice(ring, 3, 3), F.slice(ring, 2, 2))
    moved = F.transform(ring, lambda p: F.struct((p["x"] + 1e-3).alias("x"), p["y"].alias("y")))
    other = F.when(c("bld_id") % 4 == 0, ring).when(c("bld_id") % 4 == 1, turned).when(c("bld_id") % 4 == 2, F.reverse(turned)).otherwise(moved)
    name = c("bld_id").cast("string")
    stored = F.when(c("bld_id") % 3 == 0, F.concat(F.lit("t"), (c("bld_id") % 9).cast("string"), F.lit(":grid:"), name))
    key = X.receiver_key(stored, F.lit("facade"), c("bld_id"))
    return b.select("bld_id", X.building_key(F.when(c("bld_id") % 4 == 0, "tarzana-pilot").otherwise("county"), name, ring).alias("building_key"), key.alias("receiver_key"), X.key_without_tile(key).alias("short_key"), G.same_ring(ring, other).alias("same"))


@query("""WITH t AS (SELECT c_custkey AS k, c_custkey % 4 AS m FROM customer)
SELECT k, CASE WHEN m <> 3 THEN concat(k, CASE WHEN m = 1 THEN ' 1/2' ELSE '' END, ' N ', CASE WHEN m = 0 THEN 'Main St' ELSE '5th Av' END, CASE WHEN m = 2 THEN ' Apt 3' ELSE '' END, CASE WHEN m = 0 THEN '' ELSE ', Los Angeles' END) END AS address,
round((CASE WHEN m IN (0, 1) THEN 1 ELSE -1 END) * (k % 180 + (k % 60) / 60.0::DOUBLE + (k % 50) / 3600.0::DOUBLE), 9) AS degrees FROM t""")
def address_functions(spark, sf_dir):
    """Addresses in tidy letters, and degrees of angles."""
    k = c("c_custkey")
    m = k % 4
    none = F.lit(None).cast("string")
    address = X.format_address(k.cast("string"), F.when(m == 1, "1/2"), F.lit("N"), F.when(m == 0, "MAIN ST").when(m == 3, none).otherwise("5TH AV"), F.when(m == 2, "APT 3"), F.when(m == 0, "").otherwise("LOS ANGELES CA"))
    hemisphere = F.when(m == 0, "N").when(m == 1, "E").when(m == 2, "S").otherwise("W")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), address.alias("address"), F.round(X.dms((k % 180).cast("double"), (k % 60).cast("double"), (k % 50).cast("double"), hemisphere), 9).alias("degrees"))


@query(ctes("trace") + """, t AS (SELECT pt_id, track_deg AS h, CAST(pt_id % 360 AS DOUBLE) AS g, -118 + (x - 352000) / 100000 AS lon, 34 + (y - 3784000) / 100000 AS lat, x - 354000 AS dx, y - 3786000 AS dy FROM trace)
SELECT pt_id, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat - 34) / 2), 2) + cos(radians(34)) * cos(radians(lat)) * pow(sin(radians(lon + 118) / 2), 2))), 4) AS metres,
round(radians(lon + 118) * cos(radians(34)) * 6371000, 4) AS lx, round(radians(lat - 34) * 6371000, 4) AS ly,
round(dx * sin(radians(h)) + dy * cos(radians(h)), 4) + 0.0 AS along, round(dx * cos(radians(h)) - dy * sin(radians(h)), 4) + 0.0 AS across,
CASE WHEN abs(h - g) > 180 THEN 360 - abs(h - g) ELSE abs(h - g) END AS turn, least(abs(h - g) % 180, 180 - abs(h - g) % 180) AS undirected,
round(CASE WHEN dx = 0 AND dy = 0 THEN 0 WHEN degrees(atan2(dy, dx)) < 0 THEN degrees(atan2(dy, dx)) + 180 WHEN degrees(atan2(dy, dx)) >= 180 THEN 0 ELSE degrees(atan2(dy, dx)) END, 6) AS direction,
round(h + (g - h) * 0.25, 6) AS plain, round(CASE WHEN h > 180 THEN -sqrt((h - 180) * (h - 180) + 0.25 * (((h - 180) + 9) * ((h - 180) + 9) - (h - 180) * (h - 180))) ELSE sqrt(h * h + 0.25 * ((h + 9) * (h + 9) - h * h)) END, 6) AS root,
dx <= 500 AND dx + 100 >= -500 AND dy <= 500 AND dy + 100 >= -500 AS meets, round(lon - 1000 / 111320.0::DOUBLE / cos(radians(lat)), 9) AS west, round(lat + 1000 / 111320.0::DOUBLE, 9) AS north FROM t""")
def plane_functions(spark, sf_dir):
    """Distances on the sphere and the plane, frames of tracks, angles, interpolation and boxes."""
    t = view(spark, sf_dir, "trace").select("pt_id", c("track_deg").alias("h"), (c("pt_id") % 360).cast("double").alias("g"), (-118 + (c("x") - 352000) / 100000).alias("lon"), (34 + (c("y") - 3784000) / 100000).alias("lat"), (c("x") - 354000).alias("dx"), (c("y") - 3786000).alias("dy"))
    one = F.lit
    xy, frame, box = G.local_xy(c("lon"), c("lat"), one(-118.0), one(34.0)), G.track_frame(c("dx"), c("dy"), c("h")), G.expand_point(c("lon"), c("lat"), 1000.0)
    return t.select(
        "pt_id",
        F.round(G.haversine(one(-118.0), one(34.0), c("lon"), c("lat")), 4).alias("metres"),
        F.round(xy["x"], 4).alias("lx"), F.round(xy["y"], 4).alias("ly"), F.round(frame["along"], 4).alias("along"), F.round(frame["across"], 4).alias("across"),
        G.angle_diff(c("h"), c("g")).alias("turn"), G.line_angle_diff(c("h"), c("g")).alias("undirected"),
        F.round(G.line_angle(c("dx"), c("dy")), 6).alias("direction"),
        F.round(G.lerp(c("h"), c("g"), one(0.25)), 6).alias("plain"),
        F.round(F.when(c("h") > 180, G.lerp_sq(180 - c("h"), 180 - c("h") - 9, one(0.25))).otherwise(G.lerp_sq(c("h"), c("h") + 9, one(0.25))), 6).alias("root"),
        G.bbox_intersects(c("dx"), c("dy"), c("dx") + 100, c("dy") + 100, one(-500.0), one(-500.0), one(500.0), one(500.0)).alias("meets"),
        F.round(box["x1"], 9).alias("west"), F.round(box["y2"], 9).alias("north"),
    )


@query(ctes("trace") + """, t AS (SELECT pt_id, track_deg AS a, CAST(pt_id % 360 AS DOUBLE) AS b FROM trace), d AS (SELECT *, CASE WHEN b - a >= 180 THEN b - a - 360 WHEN b - a < -180 THEN b - a + 360 ELSE b - a END AS turn FROM t)
SELECT pt_id, round((a + turn * 0.25 + 360) - 360 * floor((a + turn * 0.25 + 360) / 360), 6) AS heading, round(CASE WHEN b > 180 THEN NULL WHEN b <= 90 THEN 0 - b / 30 ELSE -3 - (b - 90) / 15 END, 6) AS gain FROM d""")
def angle_functions(spark, sf_dir):
    """Headings on the shorter arc, and gains between directivity knots."""
    knots = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(g).alias("gain")) for a, g in ((0.0, 0.0), (90.0, -3.0), (180.0, -9.0))])
    b = (c("pt_id") % 360).cast("double")
    return view(spark, sf_dir, "trace").select("pt_id", F.round(G.interp_heading(c("track_deg"), b, F.lit(0.25)), 6).alias("heading"), F.round(A.directivity_gain(b, knots), 6).alias("gain"))


@query(ctes("pts") + """, p AS (SELECT pk, x, y, -118.4 + (pk % 800) * 0.001 AS lon, 33.6 + (pk % 900) * 0.001 AS lat FROM pts)
SELECT pk, round(lon::DOUBLE, 6) AS lon, round(lat::DOUBLE, 6) AS lat, concat('cty-e', CAST(floor(x / 1000) AS INTEGER), '-n', CAST(floor(y / 1000) AS INTEGER)) AS tile,
CAST((floor((x + 600) / 1000) - floor((x - 600) / 1000) + 1) * (floor((y + 30) / 1000) - floor((y - 30) / 1000) + 1) AS INTEGER) AS cells,
round(6378137 * radians((pk % 9000) * 0.001::DOUBLE), 3) AS equator_m, CASE WHEN pk % 9000 = 0 THEN 0.0 ELSE 90.0 END AS azimuth FROM p""")
def grid_functions(spark, sf_dir):
    """Projection there and back, names of cells, cells that a box touches, and geodesics along the equator."""
    pk = c("pk")
    p = view(spark, sf_dir, "pts").withColumns({"lon": -118.4 + (pk % 800) * 0.001, "lat": 33.6 + (pk % 900) * 0.001})
    utm = G.lonlat_to_utm(c("lon"), c("lat"))
    p = p.withColumn("u", utm).withColumn("back", G.utm_to_lonlat(c("u.x"), c("u.y"))).withColumn("cell", G.cell_of(c("x"), c("y")))
    p = p.withColumn("g", geodesic_inverse(F.lit(0.0), F.lit(0.0), (pk % 9000) * 0.001, F.lit(0.0)))
    return p.select(
        "pk", F.round("back.lon", 6).alias("lon"), F.round("back.lat", 6).alias("lat"), G.tile_id(c("cell.cell_e"), c("cell.cell_n")).alias("tile"),
        F.size(G.cells_of_bbox(c("x") - 600, c("y") - 30, c("x") + 600, c("y") + 30)).alias("cells"), F.round("g.distance_m", 3).alias("equator_m"), F.round("g.azimuth_deg", 9).alias("azimuth"),
    )


@query(ctes("recs") + """, t AS (SELECT edge_id, CAST(edge_id % 90 AS DOUBLE) AS v, CAST(edge_id % 700 AS DOUBLE) AS m, CAST(edge_id % 13 AS DOUBLE) AS n, CASE edge_id % 5 WHEN 0 THEN 'DF' WHEN 1 THEN 'EA' WHEN 2 THEN 'NL' WHEN 3 THEN 'N0' ELSE 'N1' END AS period FROM recs),
h AS (SELECT 10 * log10(sum(pow(10.0::DOUBLE, (s + w) / 10))) AS a FROM (SELECT unnest([-28, -26, -24, -20, -16, -12, -8, -4, -2, 0, 0, 0, 0, 0, -1, -2, -4, -5, -7, -9, -12, -15, -19, -23]) AS s, unnest([-30.2, -26.2, -22.5, -19.1, -16.1, -13.4, -10.9, -8.6, -6.6, -4.8, -3.2, -1.9, -0.8, 0.0, 0.6, 1.0, 1.2, 1.3, 1.2, 1.0, 0.5, -0.1, -1.1, -2.5]) AS w))
SELECT edge_id, period, CASE period WHEN 'DF' THEN 0.2 WHEN 'EA' THEN 0.85 WHEN 'NL' THEN 0.8 WHEN 'N0' THEN 0.0 ELSE 1.0 END::DOUBLE AS favourable, CAST(16 AS INTEGER) AS sectors,
round(least(v, sqrt(greatest(m, 30)) * 3.6), 6) AS speed, CASE WHEN n > 0 THEN round(round(143.3 - (SELECT a FROM h), 2) + 10 * log10(n / greatest(v, 10) / 2000), 2) ELSE -99.0 END AS khz FROM t""")
def rail_functions(spark, sf_dir):
    """Weather of periods, train speeds near stops, and horn levels a metre of line."""
    k = c("edge_id")
    t = view(spark, sf_dir, "recs").select("edge_id", (k % 90).cast("double").alias("v"), (k % 700).cast("double").alias("m"), (k % 13).cast("double").alias("n"), F.element_at(F.array(*map(F.lit, ("DF", "EA", "NL", "N0", "N1"))), (k % 5 + 1).cast("int")).alias("period"))
    horn = traffic.horn_emission(c("n"), c("v"))[13]
    return traffic.period_weather(t).select("edge_id", "period", "favourable", F.size("rose").alias("sectors"), F.round(traffic.service_speed(c("v"), c("m")), 6).alias("speed"), F.round(horn, 2).alias("khz"))


@query(ctes("trace") + """ SELECT pt_id, 1000 + CAST(pt_id % 500 AS DOUBLE) AS epoch, CAST(pt_id % 60 AS DOUBLE) AS lat, CASE WHEN alt_state = 'ground' THEN 'ground' WHEN pt_id % 7 = 0 THEN 'missing' ELSE 'numeric' END AS alt_state,
CASE WHEN alt_state <> 'ground' AND pt_id % 7 <> 0 THEN CAST(200 + pt_id % 3000 AS DOUBLE) END AS alt_ft, pt_id % 2 = 1 AS stale, (pt_id // 2) % 2 = 1 AS new_leg, CASE WHEN (pt_id // 4) % 2 = 1 THEN 'geometric' ELSE 'barometric' END AS vrate_datum, CASE WHEN (pt_id // 8) % 2 = 1 THEN 'geometric' ELSE 'barometric' END AS alt_datum, track_deg FROM trace""")
def point_records(spark, sf_dir):
    """Typed points of trace rows of texts."""
    text = lambda x: x.cast("string")
    t = view(spark, sf_dir, "trace")
    alt = F.when(c("alt_state") == "ground", "ground").when(c("pt_id") % 7 != 0, text(200 + c("pt_id") % 3000))
    row = F.array(text(c("pt_id") % 500), text(c("pt_id") % 60), F.lit("-118.5"), alt, F.lit("250"), text(c("track_deg")), text(c("pt_id") % 16), F.lit("64"), F.lit(None), F.lit("adsb"), F.lit("900"))
    p = t.select("pt_id", A.point_record(row, F.lit(1000.0)).alias("p")).select("pt_id", "p.*")
    return p.select("pt_id", "epoch", "lat", "alt_state", "alt_ft", "stale", "new_leg", "vrate_datum", "alt_datum", "track_deg")


@query(ctes("obs") + " SELECT receiver_id, round(CAST(sum(CAST(round(laeq * 1000000) AS BIGINT)) AS DOUBLE) / 1e6 / count(laeq), 9) AS mean, round(max(laeq) + 3000 + 10 * log10(sum(pow(10.0::DOUBLE, (laeq - (SELECT max(o.laeq) FROM obs o)) / 10)) / pow(10.0::DOUBLE, (max(laeq) - (SELECT max(o.laeq) FROM obs o)) / 10)), 4) AS huge FROM obs GROUP BY receiver_id")
def stable_sums(spark, sf_dir):
    """Means that are the same in any order, and energy sums of levels whose energies overflow."""
    obs = view(spark, sf_dir, "obs").withColumn("high", c("laeq") + 3000)
    return _round_all(obs.groupBy("receiver_id").agg(F.round(L.exact_mean(c("laeq")), 9).alias("mean"), F.round(L.energy_sum_stable(c("high")), 4).alias("huge")), 9)
