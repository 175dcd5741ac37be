"""Registered queries: each runs operators over whole tables; its SQL twin says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noisegrid.functions import geometry as G
from noisegrid.functions import levels as L
from noisegrid.functions import text as X
from noisegrid.functions import timefns as T
from noisegrid.functions import traffic
from noisegrid.operators import compare, events, field, heights, lidar, nearest, roads, rules, tiles, traces
from noisegrid.operators import spatial as S
from noisegrid.plans.views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_HUNDREDTHS = str([i / 100 for i in range(101)])


def _r(c: str | Column, digits: int = 2) -> Column:
    return F.round(c, digits)


def _round_all(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_MEANS = ctes("obs") + """, m AS (SELECT receiver_id, period, 10 * log10(avg(pow(10.0::DOUBLE, laeq / 10))) AS l FROM obs GROUP BY 1, 2),
p AS (SELECT receiver_id, max(CASE WHEN period = 'D' THEN l END) AS d, max(CASE WHEN period = 'E' THEN l END) AS e, max(CASE WHEN period = 'N' THEN l END) AS n FROM m GROUP BY 1)"""


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "obs").groupBy("receiver_id", "period").agg(L.energy_mean(F.col("laeq")).alias("laeq"))
    return tiles.pivot_periods(obs, ["receiver_id"]).select("receiver_id", "d", "e", "n")


@query(_MEANS + " SELECT receiver_id, round(10 * log10((12 * pow(10.0::DOUBLE, d / 10) + 3 * pow(10.0::DOUBLE, (e + 5) / 10) + 9 * pow(10.0::DOUBLE, (n + 10) / 10)) / 24), 2) AS cnel FROM p")
def cnel_by_receiver(spark, sf_dir):
    return _means(spark, sf_dir).select("receiver_id", _r(L.cnel(F.col("d"), F.col("e"), F.col("n"))).alias("cnel"))


@query(_MEANS + " SELECT receiver_id, round(10 * log10((12 * pow(10.0::DOUBLE, d / 10) + 3 * pow(10.0::DOUBLE, e / 10) + 9 * pow(10.0::DOUBLE, n / 10)) / 24), 2) AS laeq24 FROM p")
def laeq24_by_receiver(spark, sf_dir):
    return _means(spark, sf_dir).select("receiver_id", _r(L.laeq24(F.col("d"), F.col("e"), F.col("n"))).alias("laeq24"))


@query(ctes("obs") + " SELECT receiver_id, period, round(10 * log10(sum(pow(10.0::DOUBLE, laeq / 10))), 2) AS laeq, count(laeq) AS classes FROM obs GROUP BY 1, 2")
def energy_sum_by_class(spark, sf_dir):
    obs = view(spark, sf_dir, "obs").withColumn("period", F.concat("period", "cls"))
    return _round_all(tiles.rollup_classes(obs, ["receiver_id"]))


_BUILDINGS = ctes("obs") + ", b AS (SELECT receiver_id % 50 AS building_key, period, min(laeq) AS lo, max(laeq) AS hi, count(*) AS n FROM obs GROUP BY 1, 2)"


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.building_summary(view(spark, sf_dir, "obs").withColumn("building_key", F.col("receiver_id") % 50), ["building_key"], "laeq")


@query(_BUILDINGS + " SELECT building_key, period, round(hi - lo, 2) AS spread, n AS receiver_count FROM b")
def loudest_minus_quietest_building(spark, sf_dir):
    return _summary(spark, sf_dir).select("building_key", "period", _r(F.col("max") - F.col("min")).alias("spread"), "receiver_count")


@query(ctes("obs") + ", t AS (SELECT receiver_id, avg(laeq) AS m FROM obs GROUP BY 1) SELECT CAST(unnest(range(101)) AS INTEGER) AS pct, round(unnest(q), 3) AS level FROM (SELECT quantile_cont(m, " + _HUNDREDTHS + ") AS q FROM t)")
def building_percentiles(spark, sf_dir):
    mean = view(spark, sf_dir, "obs").groupBy("receiver_id").agg(F.avg("laeq").alias("level"))
    return tiles.building_percentiles(mean, ["level"]).select(F.posexplode("level").alias("pct", "level")).select("pct", _r("level", 3).alias("level"))


@query(ctes("obs") + """, t AS (SELECT receiver_id, round(avg(laeq), 6) AS m FROM obs GROUP BY 1), q AS (SELECT round(unnest(q), 6) AS v FROM (SELECT quantile_cont(m, """ + _HUNDREDTHS + """) AS q FROM t))
SELECT receiver_id, CAST(least(100, (SELECT count(*) FROM q WHERE v < m)) AS INTEGER) AS louder_than FROM t""")
def percentile_rank(spark, sf_dir):
    mean = view(spark, sf_dir, "obs").groupBy("receiver_id").agg(_r(F.avg("laeq"), 6).alias("level"))
    table = tiles.building_percentiles(mean, ["level"]).select(F.transform("level", lambda x: F.round(x, 6)).alias("table"))
    return mean.crossJoin(F.broadcast(table)).select("receiver_id", tiles.percentile_rank(F.col("level"), F.col("table")).alias("louder_than"))


@query(ctes("obs") + """ SELECT period, CAST((laeq >= 45)::INT + (laeq >= 50)::INT + (laeq >= 55)::INT + (laeq >= 60)::INT + (laeq >= 65)::INT + (laeq >= 70)::INT + (laeq >= 75)::INT + (laeq >= 80)::INT AS INTEGER) AS band,
CASE WHEN laeq < 45 THEN 'Quiet' WHEN laeq < 55 THEN 'Moderate' WHEN laeq < 65 THEN 'Noticeable' WHEN laeq < 70 THEN 'Loud' ELSE 'Very loud' END AS word,
CASE WHEN period = 'N' THEN CAST(laeq > 45 AS INTEGER) END AS above, count(*) AS n FROM obs GROUP BY ALL""")
def level_bands(spark, sf_dir):
    c = F.col("laeq")
    return view(spark, sf_dir, "obs").groupBy("period", L.band(c).alias("band"), L.level_word(c).alias("word"), L.above_guideline(c, F.col("period")).cast("int").alias("above")).agg(F.count("*").alias("n"))


@query(ctes("obs") + " SELECT period, count(*) AS n, count(CASE WHEN obs_id % 17 <> 0 AND obs_id % 19 <> 0 AND obs_id % 23 <> 0 AND obs_id % 29 <> 0 THEN 1 END) AS n_valid, round(avg(CASE WHEN obs_id % 17 <> 0 AND obs_id % 19 <> 0 AND obs_id % 23 <> 0 AND obs_id % 29 <> 0 THEN laeq END), 4) AS mean FROM obs GROUP BY 1")
def valid_levels(spark, sf_dir):
    i = F.col("obs_id")
    dirty = F.when(i % 17 == 0, F.lit(-99.0)).when(i % 19 == 0, F.lit(float("nan"))).when(i % 23 == 0, F.lit(float("inf"))).otherwise(F.col("laeq"))
    rows = view(spark, sf_dir, "obs").withColumn("level", L.valid_level(dirty, i % 29 == 0))
    return rows.groupBy("period").agg(F.count("*").alias("n"), F.count("level").alias("n_valid"), _r(F.avg("level"), 4).alias("mean"))


_TRAFFIC = ctes("recs") + """, d(mtfcc, a, mv, hgv) AS (VALUES ('S1100', 60000, 0.03, 0.04), ('S1630', 6000, 0.015, 0.015), ('S1200', 12000, 0.02, 0.01), ('S1400', 800, 0.01, 0.0), ('S1640', 1500, 0.02, 0.0), ('S1730', 150, 0.01, 0.0), ('S1740', 300, 0.01, 0.0)),
t AS (SELECT r.edge_id, r.mtfcc, coalesce(r.aadt_record, d.a) * r.split AS aadt, d.mv::DOUBLE AS mv, d.hgv::DOUBLE AS hgv, CASE WHEN r.aadt_record IS NULL THEN 'class_default:' || r.mtfcc ELSE 'hpms_2024' END AS basis FROM recs r JOIN d ON r.mtfcc = d.mtfcc)"""


def _traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.col("aadt_record").isNotNull()
    none = F.lit(None).cast("string")
    edges = view(spark, sf_dir, "recs").select("edge_id", "mtfcc", "split", none.alias("street"), F.lit(False).alias("dead_end"), F.when(has, F.col("edge_id").cast("string")).alias("record_id"), F.col("aadt_record").cast("string").alias("aadt"), none.alias("aadt_su"), none.alias("aadt_comb"), none.alias("speed_limit"), none.alias("f_system"))
    return traffic.traffic_for(edges)


@query(_TRAFFIC + """ SELECT edge_id, p.period || CASE WHEN mtfcc IN ('S1100', 'S1630') THEN 'F' WHEN mtfcc = 'S1200' THEN 'A' ELSE 'L' END AS period,
round(aadt / 16 * p.f * (1 - mv - hgv), 10) AS lv, round(aadt / 16 * p.f * mv, 10) AS mv, round(aadt / 16 * p.f * hgv, 10) AS hgv FROM t CROSS JOIN (VALUES ('D', 1.0::DOUBLE), ('E', 0.6::DOUBLE), ('N', 0.2::DOUBLE)) AS p(period, f)
UNION ALL SELECT edge_id, p.period, round(aadt / 16 * 0.2::DOUBLE * (1 - mv - hgv), 10), round(aadt / 16 * 0.2::DOUBLE * mv, 10), round(aadt / 16 * 0.2::DOUBLE * hgv, 10) FROM t CROSS JOIN (VALUES ('N0'), ('N1')) AS p(period)""")
def period_flows(spark, sf_dir):
    return _round_all(traffic.period_flows(_traffic(spark, sf_dir)).select("edge_id", "period", "lv", "mv", "hgv"), 10)


@query(_TRAFFIC + " SELECT mtfcc, basis, count(*) AS n, round(sum(aadt), 1) AS aadt FROM t GROUP BY 1, 2")
def traffic_defaults_basis(spark, sf_dir):
    rows = _traffic(spark, sf_dir).withColumn("basis", F.regexp_replace("basis", "^(hpms_2024):.*$", "$1"))
    return rows.groupBy("mtfcc", "basis").agg(F.count("*").alias("n"), _r(F.sum("aadt_assigned"), 1).alias("aadt"))


@query(ctes("stops") + """, p AS (SELECT route, CASE WHEN h >= 7 AND h < 19 THEN 'D' WHEN h >= 19 AND h < 22 THEN 'E' ELSE 'N' END AS period FROM (SELECT route, CAST(split_part(clock, ':', 1) AS INT) % 24 AS h FROM stops))
SELECT route AS route_id, period, round(count(*) / 7.0 / CASE period WHEN 'D' THEN 12 WHEN 'E' THEN 3 ELSE 9 END, 4) AS per_hour FROM p GROUP BY route, period""")
def trains_per_hour(spark, sf_dir):
    stops = view(spark, sf_dir, "stops")
    trips = stops.select("trip_id", F.col("route").alias("route_id"), F.col("dow").alias("date"))
    return _round_all(roads.trains_per_hour(stops.select("trip_id", "clock"), trips), 4)


_NEAR = """, c AS (SELECT p.pk, p.laeq, s.seg_id, s.aadt, p.x, p.y, s.ax, s.ay, s.bx, s.by_, (s.bx - s.ax) * (s.bx - s.ax) + (s.by_ - s.ay) * (s.by_ - s.ay) AS l2,
 ((p.x - s.ax) * (s.bx - s.ax) + (p.y - s.ay) * (s.by_ - s.ay)) AS dot FROM pts p JOIN segs s ON p.x BETWEEN least(s.ax, s.bx) - {m} AND greatest(s.ax, s.bx) + {m} AND p.y BETWEEN least(s.ay, s.by_) - {m} AND greatest(s.ay, s.by_) + {m}),
e AS (SELECT *, CASE WHEN l2 > 0 THEN least(1.0, greatest(0.0, dot / l2)) ELSE 0.0 END AS part FROM c),
n AS (SELECT *, sqrt(pow(x - ax - part * (bx - ax), 2) + pow(y - ay - part * (by_ - ay), 2)) AS d FROM e)"""


@query(ctes("pts", "segs") + _NEAR.format(m=300) + " SELECT pk, round(min(d), 3) AS distance FROM n WHERE d <= 300 GROUP BY pk")
def nearest_segment(spark, sf_dir):
    near = S.nearest_segment(view(spark, sf_dir, "pts"), view(spark, sf_dir, "segs"), 300.0)
    return near.select("pk", _r("distance", 3).alias("distance"))


@query(ctes("pts", "segs") + _NEAR.format(m=3) + """, r AS (SELECT pk, min(d) AS d FROM n WHERE d <= 3 GROUP BY pk)
SELECT pk % 100 AS tile_id, count(*) AS receiver_count, count(r.d) AS on_road_count, round(max(laeq), 2) AS max_level FROM pts LEFT JOIN r USING (pk) GROUP BY 1""")
def on_road_flags(spark, sf_dir):
    pts = view(spark, sf_dir, "pts")
    road = S.nearest_segment(pts, view(spark, sf_dir, "segs"), 3.0)
    none = pts.select("pk", F.lit(0.0).alias("excess"))
    rows = pts.select("pk", (F.col("pk") % 100).alias("tile_id"), *[F.col("laeq").alias(p) for p in "den"])
    return _round_all(tiles.tile_summary(tiles.apply_flags(rows, none, road), F.col("d")).select("tile_id", "receiver_count", "on_road_count", "max_level"))


_CEILING = ctes("pts", "segs") + _NEAR.format(m=500) + """, k AS (SELECT pk, aadt, sqrt(l2) AS long, dot / sqrt(l2) AS along, greatest(1.0, abs((x - ax) * (by_ - ay) - (y - ay) * (bx - ax)) / sqrt(l2)) AS h FROM n WHERE d <= 500 AND l2 > 0),
l AS (SELECT pk, 10 * log10(sum(aadt * (atan((long - along) / h) + atan(along / h)) / h) / (2 * pi())) AS level FROM k GROUP BY pk)"""


@query(_CEILING + " SELECT pk, round(level, 2) AS level FROM l")
def ceiling_level(spark, sf_dir):
    found = compare.ceiling_level(view(spark, sf_dir, "pts"), view(spark, sf_dir, "segs").withColumn("power", F.col("aadt")), 500.0)
    return _round_all(found)


@query(_CEILING + " SELECT count(*) AS n, round(quantile_cont(laeq - level - 30, 0.5), 2) AS p50, round(quantile_cont(laeq - level - 30, 0.9), 2) AS p90, round(quantile_cont(laeq - level - 30, 0.99), 2) AS p99, round(max(laeq - level - 30), 2) AS p100, count(CASE WHEN laeq - level - 30 > 6 THEN 1 END) AS flagged FROM l JOIN pts USING (pk)")
def ceiling_report(spark, sf_dir):
    pts = view(spark, sf_dir, "pts")
    found = compare.ceiling_level(pts, view(spark, sf_dir, "segs").withColumn("power", F.col("aadt")), 500.0)
    met = found.select("pk", (F.col("level") + 30).alias("ceiling")).join(pts.select("pk", F.col("laeq").alias("level")), "pk")
    return _round_all(compare.ceiling_report(met))


_SITES = """, g AS (SELECT *, CAST(floor(cx / {m}) AS BIGINT) AS ce, CAST(floor(cy / {m}) AS BIGINT) AS cn FROM blds),
h AS (SELECT *, CAST(floor(x / {m}) AS BIGINT) AS ce, CAST(floor(y / {m}) AS BIGINT) AS cn FROM pts),
w AS (SELECT h.pk, g.bld_id, g.kind, g.height_m, sqrt(pow(h.x - g.cx, 2) + pow(h.y - g.cy, 2)) AS d FROM h CROSS JOIN (VALUES (-1), (0), (1)) AS i(i) CROSS JOIN (VALUES (-1), (0), (1)) AS j(j) JOIN g ON g.ce = h.ce + i.i AND g.cn = h.cn + j.j)"""


@query(ctes("pts", "segs") + """, d AS (SELECT pk, seg_id, sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (by_ - ay), 2)) AS d FROM (SELECT *, CASE WHEN bx = ax AND by_ = ay THEN 0 ELSE greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) END AS t FROM pts CROSS JOIN segs))
SELECT pk, round(min(d), 3) AS distance FROM d GROUP BY pk""")
def nearest_segment_any(spark, sf_dir):
    """The distance to the nearest segment, however far."""
    return _round_all(nearest.nearest_segment_any(view(spark, sf_dir, "pts"), view(spark, sf_dir, "segs")).select("pk", "distance"), 3)


@query(ctes("pts", "segs") + """, d AS (SELECT pk, seg_id AS site_id, sqrt(pow(x - ax, 2) + pow(y - ay, 2)) AS d FROM pts CROSS JOIN segs)
SELECT pk, site_id, round(d, 3) AS distance, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY d, site_id) AS k FROM d) WHERE k <= 3""")
def nearest_sites_any(spark, sf_dir):
    """The three nearest of the segments' starts to each point, however far."""
    sites = view(spark, sf_dir, "segs").select(F.col("seg_id").alias("site_id"), F.col("ax").alias("sx"), F.col("ay").alias("sy"))
    return _round_all(nearest.nearest_sites(view(spark, sf_dir, "pts"), sites, 3), 3)


@query(ctes("pts", "blds") + _SITES.format(m=200) + ", r AS (SELECT pk, bld_id AS site_id, round(d, 3) AS distance, CAST(row_number() OVER (PARTITION BY pk ORDER BY d, bld_id) AS INTEGER) AS rank FROM w WHERE d <= 200) SELECT * FROM r WHERE rank <= 3")
def knn_sites(spark, sf_dir):
    sites = view(spark, sf_dir, "blds").select(F.col("bld_id").alias("site_id"), F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    return _round_all(S.knn(view(spark, sf_dir, "pts"), sites, 3, 200.0), 3)


@query(ctes("pts", "blds") + _SITES.format(m=500) + " SELECT pk, kind, round(min(d), 3) AS distance FROM w WHERE kind <> 'house' AND d <= CASE kind WHEN 'fire' THEN 250 ELSE 500 END GROUP BY pk, kind")
def nearby_places(spark, sf_dir):
    places = view(spark, sf_dir, "blds").select("kind", F.col("bld_id").alias("site_id"), F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    found = S.nearby_places(view(spark, sf_dir, "pts"), places, {"heliport": 500.0, "hospital": 500.0, "fire": 250.0})
    return _round_all(found.drop("site_id"), 3)


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    p = lambda i, j: F.struct((c("cx") + i * c("half_w")).alias("x"), (c("cy") + j * c("half_h")).alias("y"))
    return view(spark, sf_dir, "blds").withColumn("ring", F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1), p(-1, -1)))


@query(ctes("pts", "blds") + " SELECT bld_id, count(*) AS n, min(pk) AS first_pk FROM pts JOIN blds ON x >= cx - half_w AND x < cx + half_w AND y >= cy - half_h AND y < cy + half_h GROUP BY bld_id")
def points_in_footprints(spark, sf_dir):
    met = S.count_in_polygons(view(spark, sf_dir, "pts"), _rings(spark, sf_dir).select("bld_id", "ring"), poly="bld_id")
    return met.withColumnRenamed("first", "first_pk")


@query(ctes("blds") + """, m AS (SELECT a.bld_id, quantile_cont(b.height_m, 0.5) AS median, avg(b.height_m) AS mean, count(*) AS n FROM blds a JOIN blds b ON b.cx BETWEEN a.cx - 100 AND a.cx + 100 AND b.cy BETWEEN a.cy - 100 AND a.cy + 100 AND a.bld_id <> b.bld_id AND b.height_m IS NOT NULL AND sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) <= 100 GROUP BY 1)
SELECT bld_id, round(median, 3) AS median, round(mean, 3) AS mean, coalesce(n, 0) AS n FROM blds LEFT JOIN m USING (bld_id)""")
def neighbour_heights(spark, sf_dir):
    return _round_all(heights.neighbour_stats(view(spark, sf_dir, "blds"), 100.0), 3)


@query(ctes("blds") + """, m AS (SELECT a.bld_id, quantile_cont(b.height_m, 0.5) AS median FROM blds a JOIN blds b ON b.cx BETWEEN a.cx - 100 AND a.cx + 100 AND b.cy BETWEEN a.cy - 100 AND a.cy + 100 AND a.bld_id <> b.bld_id AND b.height_m IS NOT NULL AND sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) <= 100 GROUP BY 1)
SELECT bld_id, round(coalesce(height_m, median, 4.0), 3) AS height_m, height_m IS NULL AS imputed FROM blds LEFT JOIN m USING (bld_id)""")
def impute_heights(spark, sf_dir):
    return _round_all(heights.impute_heights(view(spark, sf_dir, "blds")), 3)


@query(ctes("pts") + """, c AS (SELECT CAST(floor(x / 250) AS INT) AS e, CAST(floor(y / 250) AS INT) AS n, count(*) AS k FROM pts GROUP BY 1, 2)
SELECT e + i.i AS home_e, n + j.j AS home_n, sum(k)::BIGINT AS points FROM c CROSS JOIN (VALUES (-1), (0), (1)) AS i(i) CROSS JOIN (VALUES (-1), (0), (1)) AS j(j) GROUP BY 1, 2""")
def neighbour_gather_counts(spark, sf_dir):
    cells = view(spark, sf_dir, "pts").select(G.cell_of(F.col("x"), F.col("y"), 250.0).alias("c")).select("c.*").groupBy("cell_e", "cell_n").agg(F.count("*").alias("k"))
    return S.with_neighbours(cells).groupBy("home_e", "home_n").agg(F.sum("k").alias("points"))


@query(ctes("pts") + """, c AS (SELECT DISTINCT floor(x / 100) * 100 AS e, floor(y / 100) * 100 AS n FROM pts WHERE (CAST(floor(x / 100) AS BIGINT) * 7 + CAST(floor(y / 100) AS BIGINT) * 3) % 5 <> 0),
s AS (SELECT e AS x1, n AS y1, e + 100 AS x2, n AS y2 FROM c UNION ALL SELECT e, n, e, n + 100 FROM c UNION ALL SELECT e + 100, n, e + 100, n + 100 FROM c UNION ALL SELECT e, n + 100, e + 100, n + 100 FROM c)
SELECT x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM s GROUP BY 1, 2, 3, 4 HAVING count(*) = 1""")
def coverage_outline(spark, sf_dir):
    cells = view(spark, sf_dir, "pts").select(G.cell_of(F.col("x"), F.col("y"), 100.0).alias("c")).select("c.*").where((F.col("cell_e").cast("long") * 7 + F.col("cell_n").cast("long") * 3) % 5 != 0)
    return S.dissolve_cells(cells, 100.0)


@query(ctes("pts") + """, f AS (SELECT floor(x / 10) * 10 AS x, floor(y / 10) * 10 AS y, avg(laeq) AS v FROM pts GROUP BY 1, 2),
g AS (SELECT floor(x / 40) * 40 AS x, floor(y / 40) * 40 AS y, avg(laeq) AS v FROM pts GROUP BY 1, 2),
i AS (SELECT f.x, f.y, f.v, a.v * (1 - u) * (1 - w) + b.v * u * (1 - w) + c.v * (1 - u) * w + d.v * u * w AS e FROM (SELECT *, floor(x / 40) * 40 AS x0, floor(y / 40) * 40 AS y0, (x - floor(x / 40) * 40) / 40 AS u, (y - floor(y / 40) * 40) / 40 AS w FROM f) f
 JOIN g a ON a.x = x0 AND a.y = y0 JOIN g b ON b.x = x0 + 40 AND b.y = y0 JOIN g c ON c.x = x0 AND c.y = y0 + 40 JOIN g d ON d.x = x0 + 40 AND d.y = y0 + 40)
SELECT count(*) AS n, round(avg(abs(e - v)), 3) AS mae, round(sqrt(avg((e - v) * (e - v))), 3) AS rmse, round(avg(e - v), 3) AS bias FROM i""")
def lattice_error(spark, sf_dir):
    pts = view(spark, sf_dir, "pts")
    on = lambda s: pts.groupBy((F.floor(F.col("x") / s) * s).cast("double").alias("x"), (F.floor(F.col("y") / s) * s).cast("double").alias("y")).agg(F.avg("laeq").alias("value"))
    fine = on(10).withColumn("pk", F.struct("x", "y"))
    return _round_all(compare.lattice_error(fine, on(40), 40.0).select("n", "mae", "rmse", "bias"), 3)


_RUNS = ctes("obs") + ", a AS (SELECT obs_id AS k, laeq AS a FROM obs WHERE obs_id % 10 <> 3), b AS (SELECT obs_id AS k, laeq + (obs_id % 7) * 0.5::DOUBLE - 1.5::DOUBLE AS b, period FROM obs WHERE obs_id % 10 <> 7)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, i = view(spark, sf_dir, "obs"), F.col("obs_id")
    return compare.compare_runs(obs.where(i % 10 != 3), obs.where(i % 10 != 7).withColumn("laeq", F.col("laeq") + (i % 7) * 0.5 - 1.5), "obs_id", "laeq")


@query(_RUNS + ", m AS (SELECT a, b, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k) SELECT side, count(*) AS n, round(avg(abs(b - a)), 4) AS mae FROM m GROUP BY side")
def run_compare(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("side").agg(F.count("*").alias("n"), _r(F.avg(F.abs(F.col("b") - F.col("a"))), 4).alias("mae"))


@query(_RUNS + """, m AS (SELECT a.a, b.b, b.b - a.a AS e, 'all' AS band FROM a JOIN b ON a.k = b.k UNION ALL SELECT a.a, b.b, b.b - a.a, 'loud' FROM a JOIN b ON a.k = b.k WHERE a.a >= 65)
SELECT band, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e), 4) AS bias, round(quantile_cont(e, 0.5), 4) AS median, round(quantile_cont(abs(e), 0.9), 4) AS p90, round(count(CASE WHEN abs(e) <= 1 THEN 1 END) / count(e)::DOUBLE, 4) AS within_1 FROM (SELECT band, round(e, 6) AS e FROM m) GROUP BY band""")
def run_compare_bands(spark, sf_dir):
    both = _runs(spark, sf_dir).where("side = 'both'").withColumns({"b": F.round(F.col("b") - F.col("a"), 6), "_a": F.col("a")}).withColumn("a", F.lit(0.0))
    return _round_all(compare.compare_run_bands(both, {"all": F.lit(True), "loud": F.col("_a") >= 65}).select("band", "n", "mae", "rmse", "bias", "median", "p90", "within_1"), 4)


@query(ctes("pts", "segs") + _NEAR.format(m=300) + """, m AS (SELECT pk, min(d) AS d FROM n WHERE d <= 300 GROUP BY pk), k AS (SELECT CASE WHEN d < 50 THEN 'near' WHEN d < 150 THEN 'middle' WHEN d < 300 THEN 'far' END AS band, CAST(pk % 3 AS INT) AS cls, laeq - 60 AS e FROM m JOIN pts USING (pk))
SELECT band, cls, count(*) AS n, round(quantile_cont(e, 0.5), 3) AS median, round(avg(e), 3) AS mean FROM k WHERE band IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20""")
def band_comparison(spark, sf_dir):
    pts = view(spark, sf_dir, "pts")
    met = S.nearest_segment(pts, view(spark, sf_dir, "segs"), 300.0).join(pts, "pk").select("distance", (F.col("pk") % 3).cast("int").alias("cls"), F.col("laeq").alias("model"), F.lit(60.0).alias("reference"))
    return _round_all(compare.compare_bands(met, [("near", 0, 50), ("middle", 50, 150), ("far", 150, 300)]).drop("blank"), 3)


_PAIRS = ctes("trace") + ", p AS (SELECT ident, pt_id, t_s, x, y, stale, alt_ft, lead(t_s) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(stale) OVER w AS stale2 FROM trace WINDOW w AS (PARTITION BY ident ORDER BY t_s))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "trace").select("ident", F.col("t_s").alias("epoch"), "pt_id", "x", "y", "stale", F.lit(False).alias("new_leg"))
    return traces.trace_pairs(points)


@query(_PAIRS + " SELECT ident, count(*) AS pairs, round(sum(t2 - t_s), 1) AS seconds FROM p WHERE t2 IS NOT NULL AND NOT stale AND NOT stale2 AND t2 - t_s <= 1500 GROUP BY ident")
def trace_pairs(spark, sf_dir):
    return traces.admissible_pairs(_pairs(spark, sf_dir), 1500.0).groupBy("ident").agg(F.count("*").alias("pairs"), _r(F.sum(F.col("b.epoch") - F.col("a.epoch")), 1).alias("seconds"))


@query(_PAIRS + """, q AS (SELECT *, greatest(0.0, CASE WHEN x2 > x THEN (353000 - x) / (x2 - x) WHEN x2 < x THEN (x - 355000) / (x - x2) ELSE 0 END, CASE WHEN y2 > y THEN (3785000 - y) / (y2 - y) WHEN y2 < y THEN (y - 3787000) / (y - y2) ELSE 0 END) AS lo,
 least(1.0, CASE WHEN x2 > x THEN (355000 - x) / (x2 - x) WHEN x2 < x THEN (x - 353000) / (x - x2) ELSE 1 END, CASE WHEN y2 > y THEN (3787000 - y) / (y2 - y) WHEN y2 < y THEN (y - 3785000) / (y - y2) ELSE 1 END) AS hi FROM p WHERE t2 IS NOT NULL AND NOT (x = x2 AND (x < 353000 OR x > 355000)) AND NOT (y = y2 AND (y < 3785000 OR y > 3787000)))
SELECT ident, count(*) AS parts, round(sum((hi - lo) * (t2 - t_s)), 2) AS seconds FROM q WHERE lo < hi GROUP BY ident""")
def lines_bbox_clip(spark, sf_dir):
    cut = traces.clip_pairs(_pairs(spark, sf_dir), (353000.0, 3785000.0, 355000.0, 3787000.0))
    return cut.groupBy("ident").agg(F.count("*").alias("parts"), _r(F.sum(F.col("epoch_hi") - F.col("epoch_lo"))).alias("seconds"))


@query(ctes("trace") + ", s AS (SELECT ident, pt_id, sum(CASE WHEN t_s - prev <= 1500 THEN 0 ELSE 1 END) OVER (PARTITION BY ident ORDER BY t_s) AS island FROM (SELECT *, lag(t_s) OVER (PARTITION BY ident ORDER BY t_s) AS prev FROM trace)) SELECT ident, CAST(island AS BIGINT) AS island, count(*) AS points FROM s GROUP BY 1, 2")
def path_islands(spark, sf_dir):
    return traces.path_islands(view(spark, sf_dir, "trace"), 1500.0).groupBy("ident", "island").agg(F.count("*").alias("points"))


_EPISODES = ctes("trace") + """, i AS (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY t_s) AS idx FROM trace), g AS (SELECT * FROM i WHERE alt_state = 'ground'),
b AS (SELECT *, CASE WHEN idx - lag(idx) OVER w = 1 AND t_s - lag(t_s) OVER w <= 6000 AND abs(x - lag(x) OVER w) < 3000 AND abs(y - lag(y) OVER w) < 3000 THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY ident ORDER BY idx)),
e AS (SELECT ident, episode, min(t_s) AS "start", max(t_s) AS "end", count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY ident ORDER BY idx) AS BIGINT) AS episode FROM b) GROUP BY 1, 2)"""


def _episodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = view(spark, sf_dir, "trace").withColumns({"epoch": F.col("t_s"), "idx": F.row_number().over(W.partitionBy("ident").orderBy("t_s"))})
    return points, traces.ground_episodes(points, gap_s=6000.0, apart=3000.0)


@query(_EPISODES + ' SELECT ident, episode, "start", "end", n FROM e')
def ground_episodes(spark, sf_dir):
    return _episodes(spark, sf_dir)[1].select("ident", "episode", "start", "end", "n")


@query(_EPISODES + """, a AS (SELECT * FROM trace WHERE alt_state = 'numeric'),
v AS (SELECT e.ident, e.episode, 'arrival' AS operation, e."start" - a.t_s AS gap, a.t_s, a.alt_ft FROM e JOIN a ON a.ident = e.ident AND a.t_s < e."start" AND a.t_s >= e."start" - 3000 AND a.alt_ft >= 0
 UNION ALL SELECT e.ident, e.episode, 'departure', a.t_s - e."end", a.t_s, a.alt_ft FROM e JOIN a ON a.ident = e.ident AND a.t_s > e."end" AND a.t_s <= e."end" + 2400 AND a.alt_ft >= 500)
SELECT ident, episode, operation, t_s AS witness_ts, alt_ft AS witness_ft FROM (SELECT *, row_number() OVER (PARTITION BY ident, episode, operation ORDER BY gap) AS r FROM v) WHERE r = 1""")
def event_windows(spark, sf_dir):
    points, episodes = _episodes(spark, sf_dir)
    found = traces.event_windows(points.withColumn("height_ft", F.col("alt_ft")), episodes, before_s=3000.0, after_s=2400.0, climb_ft=500.0)
    return found.select("ident", "episode", "operation", "witness_ts", "witness_ft")


@query(ctes("trace") + ", d AS (SELECT ident, alt_state AS type_code, sqrt(pow(x - 354000, 2) + pow(y - 3786000, 2)) AS d FROM trace) SELECT r.r::DOUBLE AS radius, type_code, count(DISTINCT ident) AS paths, count(*) AS points FROM d JOIN (VALUES (500), (1000), (2000)) AS r(r) ON d.d <= r.r GROUP BY 1, 2")
def proximity_counts(spark, sf_dir):
    return traces.proximity_counts(view(spark, sf_dir, "trace").withColumnRenamed("alt_state", "type_code"), 354000.0, 3786000.0, [500.0, 1000.0, 2000.0])


def _sel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "obs").select("receiver_id", F.col("ts").cast("timestamp").alias("ts"), F.col("laeq").alias("sel"))


@query(ctes("obs") + " SELECT receiver_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(10 * log10(sum(pow(10.0::DOUBLE, laeq / 10) * CASE period WHEN 'D' THEN 1 WHEN 'E' THEN 3 ELSE 10 END) / 86400), 2) + 0.0::DOUBLE AS cnel, count(*) AS n FROM obs GROUP BY 1, 2")
def daily_cnel(spark, sf_dir):
    return _round_all(events.daily_cnel(_sel(spark, sf_dir), "UTC", ["receiver_id"]).withColumn("day", F.col("day").cast("string")))


@query(ctes("obs") + """, s AS (SELECT receiver_id, sum(CASE WHEN period = 'D' THEN pow(10.0::DOUBLE, laeq / 10) ELSE 0 END) AS d, sum(CASE WHEN period = 'E' THEN 3 * pow(10.0::DOUBLE, laeq / 10) ELSE 0 END) AS e, sum(CASE WHEN period = 'N' THEN 10 * pow(10.0::DOUBLE, laeq / 10) ELSE 0 END) AS n,
 count(CASE WHEN period = 'D' THEN 1 END) AS n_d, count(CASE WHEN period = 'E' THEN 1 END) AS n_e, count(CASE WHEN period = 'N' THEN 1 END) AS n_n FROM obs GROUP BY 1)
SELECT receiver_id, n_d, n_e, n_n, round(d / (d + e + n), 4) AS share_d, round(n / (d + e + n), 4) AS share_n, round(10 * log10((d + e + n) / 86400), 2) AS cnel FROM s""")
def subset_cnel(spark, sf_dir):
    r = events.subset_cnel(_sel(spark, sf_dir), "UTC", ["receiver_id"])
    return r.select("receiver_id", "n_d", "n_e", "n_n", _r("share_d", 4).alias("share_d"), _r("share_n", 4).alias("share_n"), _r("cnel").alias("cnel"))


@query(ctes("obs") + " SELECT receiver_id, round(10 * log10(sum(pow(10.0::DOUBLE, laeq / 10))) - 10 * log10(2678400), 2) AS laeq, count(*) AS n FROM obs WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1")
def laeq_from_sel(spark, sf_dir):
    return _round_all(events.laeq_from_sel(_sel(spark, sf_dir), "2024-01-01", "2024-02-01", ["receiver_id"]))


@query(ctes("obs") + """, k AS (SELECT obs_id, receiver_id, epoch_us(ts) / 1000000.0 AS t, (obs_id % 50) * 600.0 AS d FROM obs),
m AS (SELECT *, max(t + d) OVER (PARTITION BY receiver_id ORDER BY t, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM k)
SELECT 'duration' AS rule, count(*) AS n FROM m WHERE d <= 0 UNION ALL SELECT 'overlap', count(*) FROM m WHERE ahead > t""")
def event_overlaps(spark, sf_dir):
    obs = view(spark, sf_dir, "obs").select(F.col("obs_id").alias("event_id"), F.col("receiver_id").alias("site"), F.col("ts").cast("timestamp").alias("start_ts"), ((F.col("obs_id") % 50) * 600.0).alias("duration_s"), F.col("laeq").alias("laeq_db"), F.lit("LAeq").alias("metric"), F.lit("A").alias("weighting"))
    return rules.validate_events(obs).groupBy("rule").agg(F.count("*").alias("n"))


_NPD = [("X", p, d, lv) for p, row in ((1000.0, (95.0, 85.0, 70.0, 55.0)), (3000.0, (101.0, 92.0, 78.0, 64.0)), (5000.0, (107.0, 99.0, 86.0, 73.0))) for d, lv in zip((60.96, 304.8, 1219.2, 4876.8), row, strict=True)]


def _npd(spark: SparkSession, less: float = 0.0) -> DataFrame:
    return spark.createDataFrame([(i, p, d, lv - less) for i, p, d, lv in _NPD], "npd_id string, power double, distance_m double, level_db double")


def _npd_sql(power: str, distance: str, less: float = 0.0) -> str:
    """Level as nested cases over the fixed table."""
    ds = (60.96, 304.8, 1219.2, 4876.8)
    log = f"log10(greatest({distance}, 30.0))"

    def curve(row: tuple) -> str:
        part = [f"({a - less} + {b - a} * ({log} - log10({x})) / (log10({y}) - log10({x})))" for a, b, x, y in zip(row, row[1:], ds, ds[1:], strict=False)]
        return f"CASE WHEN {log} < log10({ds[1]}) THEN {part[0]} WHEN {log} < log10({ds[2]}) THEN {part[1]} ELSE {part[2]} END"

    a, b, c = (curve(r) for r in ((95.0, 85.0, 70.0, 55.0), (101.0, 92.0, 78.0, 64.0), (107.0, 99.0, 86.0, 73.0)))
    return f"CASE WHEN {power} < 1000 OR {power} > 5000 THEN NULL WHEN {power} < 3000 THEN ({a}) + (({b}) - ({a})) * ({power} - 1000) / 2000.0 ELSE ({b}) + (({c}) - ({b})) * ({power} - 3000) / 2000.0 END"


@query(ctes("pts") + f", q AS (SELECT pk, 800 + (pk % 45) * 100.0::DOUBLE AS power, 10 + (pk % 6000)::DOUBLE AS d FROM pts) SELECT pk, round({_npd_sql('power', 'd')}, 2) AS level_db, CASE WHEN power < 1000 OR power > 5000 THEN 'power_outside' ELSE 'ok' END AS status FROM q")
def npd_levels(spark, sf_dir):
    from noisegrid.functions.acoustics import npd_level

    rows = view(spark, sf_dir, "pts").select("pk", F.lit("X").alias("npd_id"), (800 + (F.col("pk") % 45) * 100.0).alias("power"), (10 + (F.col("pk") % 6000)).cast("double").alias("distance_m"))
    return _round_all(npd_level(rows, _npd(spark), ["pk"]))


@query(ctes("pts") + f""", g AS (SELECT pk, x - 352000 AS ox, y - 3786000 AS oy, 600.0::DOUBLE AS z FROM pts), k AS (SELECT pk, ox AS q, abs(oy) AS lat_m, sqrt(oy * oy + pow(z - 1.5, 2)) AS slant, (z - 1.5) AS h FROM g),
l AS (SELECT pk, q, lat_m, {_npd_sql('3000.0', 'slant')} AS s0, {_npd_sql('3000.0', 'slant', 8.0)} AS m0, degrees(atan2(h, lat_m)) AS beta, atan2(h, lat_m) AS phi FROM k),
f AS (SELECT *, 2 / pi() * 270.05 * pow(10.0::DOUBLE, (s0 - m0) / 10) AS sc FROM l), a AS (SELECT *, -q / 0.3048 / sc AS a1, -(q - 4000) / 0.3048 / sc AS a2 FROM f),
t AS (SELECT *, (a2 / (1 + a2 * a2) + atan(a2) - a1 / (1 + a1 * a1) - atan(a1)) / pi() AS share FROM a)
SELECT pk, round(s0 + 10 * log10(416.86 / 409.81) + 10 * log10(160.0 * 1852 / 3600 / 80)
 + 10 * log10(pow(0.00384 * pow(cos(phi), 2) + pow(sin(phi), 2), 0.0621) / (0.8786 * pow(sin(2 * phi), 2) + pow(cos(2 * phi), 2)))
 - CASE WHEN beta >= 50 THEN 0 ELSE (CASE WHEN lat_m <= 914 THEN 1.089 * (1 - exp(-0.00274 * lat_m)) ELSE 1 END) * (1.137 - 0.0229 * beta + 9.72 * exp(-0.142 * beta)) END + greatest(-150, 10 * log10(share)), 2) AS sel FROM t""")
def segment_sel(spark, sf_dir):
    from noisegrid.functions import acoustics as A

    c = F.col
    pts = view(spark, sf_dir, "pts").select("pk", (c("x") - 352000).alias("ox"), (c("y") - 3786000).alias("oy"), F.lit(1.5).alias("oz"))
    fixed = {"s1": 0.0, "z1": 600.0, "v1": 80.0, "p1": 3000.0, "s2": 4000.0, "z2": 600.0, "v2": 80.0, "p2": 3000.0}
    g = A.segment_geometry(pts.withColumns({n: F.lit(v) for n, v in fixed.items()} | {"operation": F.lit("A"), "npd_id": F.lit("X")})).withColumn("distance_m", c("slant_m"))
    g = A.with_npd_level(A.with_npd_level(g, _npd(spark), "s0", "_s"), _npd(spark, 8.0), "m0", "_m")
    ft = 1 / 0.3048
    level = A.segment_sel(c("s0"), A.impedance_adjustment(F.lit(15.0), F.lit(760.0)), A.duration_correction(c("speed_mps")), A.installation_correction(c("phi_deg"), F.lit("wing")), A.lateral_attenuation(c("beta_deg"), c("lateral_m")), A.finite_segment(c("s0"), c("m0"), c("q_m") * ft, c("length_m") * ft), F.lit(0.0))
    return g.select("pk", _r(level).alias("sel"))


@query(ORACLES["segment_sel"].replace("SELECT pk, round(s0", "SELECT pk AS site_id, round(s0"))
def event_exposure(spark, sf_dir):
    """Exposure of every point to an event of one level segment."""
    c = F.col
    sites = view(spark, sf_dir, "pts").select(c("pk").alias("site_id"), (c("x") - 352000).alias("ox"), (c("y") - 3786000).alias("oy"), F.lit(1.5).alias("oz"))
    fixed = {"s1": 0.0, "z1": 600.0, "v1": 80.0, "p1": 3000.0, "s2": 4000.0, "z2": 600.0, "v2": 80.0, "p2": 3000.0}
    event = spark.range(1).select(F.lit("e").alias("profile_id"), F.lit(1).alias("seq"), *[F.lit(v).alias(n) for n, v in fixed.items()], F.lit("A").alias("operation"), F.lit("X").alias("npd_id"))
    return events.event_sel(event, sites, _npd(spark), _npd(spark, 8.0)).select("site_id", _r("sel").alias("sel"))


@query(ctes("pts") + """, g AS (SELECT pk, x - 352000 AS q, nullif(abs(y - 3786000), 0) AS b FROM pts), a(w) AS (SELECT 20.0::DOUBLE * log10(pow(12194.0::DOUBLE, 2) * pow(1000.0::DOUBLE, 4) / ((1e6 + pow(20.6::DOUBLE, 2)) * sqrt((1e6 + pow(107.7::DOUBLE, 2)) * (1e6 + pow(737.9::DOUBLE, 2))) * (1e6 + pow(12194.0::DOUBLE, 2)))) + 2)
SELECT pk AS site_id, round(100 + w + 10 * log10((atan((4000 - q) / b) + atan(q / b)) / b / 20), 2) AS sel FROM g CROSS JOIN a""")
def moving_source(spark, sf_dir):
    sites = view(spark, sf_dir, "pts").select(F.col("pk").alias("site_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    track = spark.createDataFrame([(1, 0, 0.0, 352000.0, 3786000.0, 200.0, 356000.0, 3786000.0)], "track_id int, seq int, t1 double, x1 double, y1 double, t2 double, x2 double, y2 double")
    return events.moving_source_sel(track, sites, [(1000.0, 100.0)]).select("site_id", _r("sel").alias("sel"))


@query(ctes("pts") + """, g AS (SELECT pk, x - 352000 AS q, sqrt(pow(y - 3786000, 2) + 900) AS b FROM pts), e AS (SELECT pk, b, 2 * (atan((4000 - q) / b) + atan(q / b)) / b / 20 AS t FROM g),
w AS (SELECT pk, b, 10 * log10(t * 50) + 90 - 1.5 AS low, 10 * log10(t * 50) + 100 - 2 AS high FROM e)
SELECT pk AS site_id, round(low, 3) AS low, round(high, 3) AS high, round(10 * log10(pow(10.0::DOUBLE, (low + {low}) / 10) + pow(10.0::DOUBLE, (high + {high}) / 10)), 3) AS sel FROM w""".format(low=-16.189653372521796, high=0.00014152769487951744))
def moving_source_bands(spark, sf_dir):
    """A source 31 m high that drives there and back: two bands with losses, and their A-weighted sum."""
    c = F.col
    sites = view(spark, sf_dir, "pts").select(c("pk").alias("site_id"), c("x").alias("ox"), c("y").alias("oy"), F.lit(1.0).alias("oz"))
    names = "track_id int, seq int, t1 double, x1 double, y1 double, z1 double, heading1 double, t2 double, x2 double, y2 double, z2 double, heading2 double"
    there = (1, 0, 0.0, 352000.0, 3786000.0, 31.0, 0.0, 200.0, 356000.0, 3786000.0, 31.0, 0.0)
    back = (1, 1, 200.0, 356000.0, 3786000.0, 31.0, 180.0, 400.0, 352000.0, 3786000.0, 31.0, 180.0)
    out = events.moving_source_sel(spark.createDataFrame([there, back], names), sites, [(125.0, 90.0), (1000.0, 100.0)], reference_m=50.0**0.5, loss_db=[1.5, 2.0])
    return out.select("site_id", _r(c("bands")[0], 3).alias("low"), _r(c("bands")[1], 3).alias("high"), _r("sel", 3).alias("sel"))


@query(ctes("segs") + " SELECT seg_id AS edge_id, seg_id + 1000000 AS other_id, 1.0::DOUBLE AS share FROM segs")
def conflate_traffic(spark, sf_dir):
    segs = view(spark, sf_dir, "segs").withColumn("seq", F.lit(0))
    lines = segs.select(F.col("seg_id").alias("edge_id"), "seq", "ax", "ay", "bx", "by", F.lit(False).alias("freeway"))
    others = segs.select((F.col("seg_id") + 1000000).alias("other_id"), "seq", *[(F.col(c) + 0.25).alias(c) for c in ("ax", "ay", "bx", "by")], F.lit(False).alias("freeway"), (F.lit(0.0) - F.abs(F.col("seg_id") - F.col("seg_id"))).alias("aadt"))
    return roads.assign_traffic(lines, others, reach=1.0)


@query(ctes("segs") + """, p AS (SELECT seg_id, ax AS x, ay AS y FROM segs UNION ALL SELECT seg_id, bx, by_ FROM segs UNION ALL SELECT seg_id + 1000000, bx, by_ FROM segs WHERE seg_id % 3 = 0 UNION ALL SELECT seg_id + 1000000, bx + 10, by_ + 10 FROM segs WHERE seg_id % 3 = 0),
f AS (SELECT x, y, min(seg_id) AS seg_id FROM p GROUP BY 1, 2 HAVING count(*) = 1) SELECT DISTINCT seg_id AS edge_id FROM f""")
def dead_ends(spark, sf_dir):
    segs = view(spark, sf_dir, "segs").select(F.col("seg_id").alias("edge_id"), "ax", "ay", "bx", "by")
    more = segs.where(F.col("edge_id") % 3 == 0).select(F.col("edge_id") + 1000000, "bx", "by", F.col("bx") + 10, F.col("by") + 10)
    return roads.dead_ends(segs.union(more))


@query(ctes("recs") + """, e AS (SELECT edge_id, edge_id % 500 AS r, (edge_id % 97) * 10.0 AS f, (edge_id % 97) * 10.0 + 150 AS t, (edge_id % 5) * 3.0 AS o, mtfcc IN ('S1100', 'S1630') AS fw FROM recs)
SELECT edge_id, CASE WHEN fw OR EXISTS (SELECT 1 FROM e b WHERE b.r = a.r AND b.edge_id <> a.edge_id AND least(a.t, b.t) - greatest(a.f, b.f) > 75 AND abs(a.o - b.o) > 5) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS split FROM e a""")
def split_carriageways(spark, sf_dir):
    i = F.col("edge_id")
    return roads.detect_split(view(spark, sf_dir, "recs").select("edge_id", (i % 500).alias("record_id"), ((i % 97) * 10.0).alias("from_m"), ((i % 97) * 10.0 + 150).alias("to_m"), ((i % 5) * 3.0).alias("offset_m"), F.col("mtfcc").isin("S1100", "S1630").alias("freeway")))


_BINS = ctes("pts") + ", b AS (SELECT CAST(floor(y / {s}) AS INT) AS r, CAST(floor(x / {s}) AS INT) AS c, CAST(sum(CAST(round(laeq * 1000000) AS BIGINT)) AS DOUBLE) / 1e6 AS s, count(laeq) AS n FROM pts GROUP BY 1, 2)"


@query(_BINS.format(s=5) + ' SELECT r AS "row", c AS col, round(s, 3) AS sum, n FROM b')
def bin_surface(spark, sf_dir):
    return _round_all(field.bin_points(view(spark, sf_dir, "pts")), 3)


def _blur_sql(sigma: float, step: float) -> str:
    half = field.kernel(sigma, step)
    total = half[0] + 2 * sum(half[1:])
    rows = ", ".join(f"({k}, {half[abs(k)] / total!r}::DOUBLE)" for k in range(1 - len(half), len(half)))
    return f"(VALUES {rows})"


@query(_BINS.format(s=40) + f""", k1(o, w) AS {_blur_sql(72.0, 40.0)}, k2(o, w) AS {_blur_sql(240.0, 40.0)},
a AS (SELECT r + i.o AS r, c + j.o AS c, sum(s * i.w * j.w) AS s, sum(n * i.w * j.w) AS n FROM b CROSS JOIN k1 i CROSS JOIN k1 j GROUP BY 1, 2),
d AS (SELECT r + i.o AS r, c + j.o AS c, sum(s * i.w * j.w) AS s, sum(n * i.w * j.w) AS n FROM b CROSS JOIN k2 i CROSS JOIN k2 j GROUP BY 1, 2),
m AS (SELECT coalesce(a.r, d.r) AS r, coalesce(a.c, d.c) AS c, coalesce(a.s / a.n, d.s / d.n) AS v FROM (SELECT * FROM a WHERE n > 0.0500001) a FULL JOIN (SELECT * FROM d WHERE n > 0.0200001) d ON a.r = d.r AND a.c = d.c)
SELECT r AS "row", c AS col, round(v, 3) AS value FROM m""")
def gaussian_surface(spark, sf_dir):
    bins = field.bin_points(view(spark, sf_dir, "pts"), 40.0)
    return _round_all(field.gaussian_surface(bins, 40.0, 72.0, 240.0, 0.0500001, 0.0200001), 3)


@query(_BINS.format(s=40) + f""", k1(o, w) AS {_blur_sql(192.0, 40.0)}, a AS (SELECT r + i.o AS r, c + j.o AS c, sum(s * i.w * j.w) AS s, sum(n * i.w * j.w) AS n FROM b CROSS JOIN k1 i CROSS JOIN k1 j GROUP BY 1, 2)
SELECT r AS "row", c AS col, round(s / n, 3) AS value FROM a WHERE n > 0.0200001""")
def glow_surface(spark, sf_dir):
    return _round_all(field.glow_surface(field.bin_points(view(spark, sf_dir, "pts"), 40.0), 40.0, 192.0, 0.0200001), 3)


@query(ctes("pts") + """, p AS (SELECT 5 AS z, CAST(floor((x - 352000) / 10) AS INT) AS wx, CAST(floor((y - 3784000) / 10) AS INT) AS wy, CAST(sum(CAST(round(laeq * 1000000) AS BIGINT)) AS DOUBLE) / 1e6 / count(laeq) AS v FROM pts GROUP BY 2, 3),
q AS (SELECT 4 AS z, wx // 2 AS wx, wy // 2 AS wy, CAST(sum(CAST(round(v * 1000000) AS BIGINT)) AS DOUBLE) / 1e6 / count(v) AS v FROM p GROUP BY 2, 3), s AS (SELECT 3 AS z, wx // 2 AS wx, wy // 2 AS wy, CAST(sum(CAST(round(v * 1000000) AS BIGINT)) AS DOUBLE) / 1e6 / count(v) AS v FROM q GROUP BY 2, 3), u AS (SELECT * FROM p UNION ALL SELECT * FROM q UNION ALL SELECT * FROM s)
SELECT z, CAST(wx // 256 AS INT) AS x, CAST(wy // 256 AS INT) AS y, CAST(wx % 256 AS INT) AS px, CAST(wy % 256 AS INT) AS py, v AS value FROM u""")
def pyramid_mean(spark, sf_dir):
    wx, wy = F.floor((F.col("x") - 352000) / 10).cast("int"), F.floor((F.col("y") - 3784000) / 10).cast("int")
    px = view(spark, sf_dir, "pts").groupBy(wx.alias("wx"), wy.alias("wy")).agg(L.exact_mean(F.col("laeq")).alias("value"))
    px = px.select(F.lit(5).alias("z"), F.floor(F.col("wx") / 256).cast("int").alias("x"), F.floor(F.col("wy") / 256).cast("int").alias("y"), (F.col("wy") % 256).alias("py"), (F.col("wx") % 256).alias("px"), "value")
    out = field.build_pyramid(px, 3, 5)
    return out.select("z", "x", "y", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), "value")


@query(_BINS.format(s=50) + """, g AS (SELECT r, c, s / n AS v FROM b), q AS (SELECT pk, x / 50 - 0.5 AS u, y / 50 - 0.5 AS w FROM pts), h AS (SELECT pk, CAST(floor(u) AS INT) AS c0, CAST(floor(w) AS INT) AS r0, u - floor(u) AS fu, 1 - u + floor(u) AS gu, w - floor(w) AS fw, 1 - w + floor(w) AS gw FROM q)
SELECT pk, (gw * gu) * a.v + (gw * fu) * b.v + (fw * gu) * c.v + (fw * fu) * d.v AS value
FROM h LEFT JOIN g a ON a.r = r0 AND a.c = c0 LEFT JOIN g b ON b.r = r0 AND b.c = c0 + 1 LEFT JOIN g c ON c.r = r0 + 1 AND c.c = c0 LEFT JOIN g d ON d.r = r0 + 1 AND d.c = c0 + 1 WHERE coalesce(a.v, b.v, c.v, d.v) IS NOT NULL""")
def sample_raster(spark, sf_dir):
    pts = view(spark, sf_dir, "pts")
    grid = field.bin_points(pts, 50.0).select("row", "col", (F.col("sum") / F.col("n")).alias("value"))
    return S.sample_raster(pts, grid, 50.0, bilinear=True)


@query(ctes("pts") + """, l AS (SELECT pk, -119.0::DOUBLE + (x - 352000) / 100000 AS lon, 34.0::DOUBLE + (y - 3784000) / 100000 AS lat FROM pts),
w AS (SELECT (lon + 180) / 360 * 256 * 32768 AS wx, (0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 * 32768 AS wy FROM l)
SELECT CAST(floor(wx / 256) AS INT) AS x_tile, CAST(floor(wy / 256) AS INT) AS y_tile, count(*) AS n FROM w GROUP BY 1, 2""")
def web_tiles(spark, sf_dir):
    pts = view(spark, sf_dir, "pts").select((F.lit(-119.0) + (F.col("x") - 352000) / 100000).alias("lon"), (F.lit(34.0) + (F.col("y") - 3784000) / 100000).alias("lat"))
    return field.web_pixels(pts, 15).groupBy("x_tile", "y_tile").agg(F.count("*").alias("n"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus <> 'O')
SELECT o_custkey AS tile_id, o_orderkey AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderdate DESC, o_orderkey DESC) AS k FROM r) WHERE k = 1""")
def latest_runs(spark, sf_dir):
    runs = _orders(spark, sf_dir).select(F.col("o_custkey").alias("tile_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("model_rank"), F.col("o_orderdate").alias("ended_at"), (F.col("o_orderstatus") != "O").alias("completed"))
    return tiles.latest_runs(runs).select("tile_id", "run_id")


@query("SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def changed_files(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("sha"))
    old = o.where(F.col("path") % 5 != 0).withColumn("sha", F.when(F.col("path") % 3 == 0, F.lit("old")).otherwise(F.col("sha")))
    return tiles.changed_files(o, old).select("path")


@query("WITH b AS (SELECT o_custkey AS cell, o_orderkey AS block_id, o_orderstatus = 'F' AS done FROM orders) SELECT cell, count(*) AS blocks FROM b GROUP BY cell HAVING bool_and(done)")
def ready_cells(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_custkey").alias("cell"), F.col("o_orderkey").alias("block_id"), "o_orderstatus")
    cells = o.groupBy("cell").agg(F.count("*").alias("blocks"))
    return tiles.ready_cells(cells, o, o.where("o_orderstatus = 'F'"), ["cell"])


_CLAIMS = ["the", "la", "der"]


@query(r"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
r AS (SELECT doc_id, """ + ", ".join(rf"regexp_matches(regexp_replace(t, '(^|[^a-z])(not|never|no)(\s+(a|an|the))?(\s+(is|are|be))?\s+{p}($|[^a-z])', '\1 \7', 'g'), '(^|[^a-z]){p}($|[^a-z])') AS v_{p}" for p in ("the", "la", "der")) + " FROM d) SELECT doc_id FROM r WHERE v_the OR v_la OR v_der")
def claim_violations(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.where(~X.claim_safe(F.col("text"), _CLAIMS)).select("doc_id")


@query(ctes("obs") + """, p AS (SELECT obs_id % 2 AS tile_id, receiver_id % 50 AS building_key, period, min(laeq) AS lo, max(laeq) AS hi, count(*) AS n FROM obs GROUP BY 1, 2, 3)
SELECT building_key, period, min(lo) AS min, max(hi) AS max, sum(n)::BIGINT AS receiver_count, count(*) AS tiles FROM p GROUP BY 1, 2""")
def tile_merge(spark, sf_dir):
    obs = view(spark, sf_dir, "obs").withColumns({"building_key": F.col("receiver_id") % 50, "tile_id": F.col("obs_id") % 2})
    parts = tiles.building_summary(obs, ["tile_id", "building_key"], "laeq")
    return tiles.merge_buildings(parts).select("building_key", "period", "min", "max", "receiver_count", F.size("tile_ids").cast("long").alias("tiles"))


@query("""WITH r AS (SELECT o_custkey % 40 AS host, o_orderdate AS t, o_orderkey % 900 + 100 AS receivers, o_orderkey % 70 + 10 AS seconds FROM orders), m AS (SELECT max(t) AS now FROM r),
a AS (SELECT host, receivers, seconds, date_diff('day', CAST(t AS DATE), CAST(now AS DATE)) AS age FROM r CROSS JOIN m), s AS (SELECT host, count(CASE WHEN age <= 90 THEN 1 END) AS n, count(*) AS n_all, sum(CASE WHEN age <= 90 THEN receivers END) AS r, sum(receivers) AS r_all, sum(CASE WHEN age <= 90 THEN seconds END) AS s, sum(seconds) AS s_all FROM a WHERE age <= 720 GROUP BY 1)
SELECT host, CASE WHEN n < 3 THEN n_all ELSE n END AS runs, round(CASE WHEN n < 3 THEN r_all / s_all ELSE r / s END, 4) AS per_second, CASE WHEN n < 3 THEN 17280.0::DOUBLE ELSE 2160.0::DOUBLE END AS hours FROM s""")
def throughput(spark, sf_dir):
    o = _orders(spark, sf_dir).select((F.col("o_custkey") % 40).alias("host"), F.col("o_orderdate").alias("ended"), (F.col("o_orderkey") % 900 + 100).alias("receivers"), (F.col("o_orderkey") % 70 + 10).alias("seconds"))
    now = o.agg(F.max("ended")).first()[0]
    return _round_all(compare.throughput(o, str(now), 2160.0, 17280.0), 4)


@query(ctes("pts") + ', g AS (SELECT CAST(floor(y / 25) AS INT) AS "row", CAST(floor(x / 25) AS INT) AS col, min(CASE WHEN pk % 3 = 0 THEN laeq END) AS ground, max(CASE WHEN pk % 3 <> 0 THEN laeq END) AS top, count(CASE WHEN pk % 3 <> 0 THEN 1 END) AS hits, count(CASE WHEN pk % 3 <> 0 AND pk % 4 > 1 THEN 1 END) AS multi FROM pts GROUP BY 1, 2) SELECT * FROM g')
def wall_cells(spark, sf_dir):
    pts = view(spark, sf_dir, "pts").select("x", "y", F.col("laeq").alias("z"), F.lit(0).cast("long").alias("block"), F.when(F.col("pk") % 3 == 0, 2).otherwise(1).alias("cls"), (F.col("pk") % 4).alias("ret"))
    return lidar.rasterize_points(pts, 25.0).drop("block", "deck")


@query()
def wall_lines(spark, sf_dir):
    """Walls along the segments: lidar-like cells every half metre, with the points as background."""
    segs = view(spark, sf_dir, "segs").select(F.col("seg_id").alias("edge_id"), F.lit(0).alias("seq"), "ax", "ay", "bx", "by")
    cells = S.densify(segs, 0.25).select(F.lit(0).cast("long").alias("block"), F.floor(F.col("y") / 0.5).cast("int").alias("row"), F.floor(F.col("x") / 0.5).cast("int").alias("col"), F.lit(4.0).alias("height")).distinct()
    near = cells.withColumn("block", F.shiftleft(F.floor(F.col("row") / 1000).cast("long"), 24) + F.floor(F.col("col") / 1000))
    return lidar.wall_lines(near)


@query(ctes("pts", "segs") + """, l AS (SELECT seg_id, ax, ay, bx - ax AS dx, by_ - ay AS dy, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS m FROM segs),
d AS (SELECT seg_id, m, laeq, greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (m * m))) AS p, x - ax AS px, y - ay AS py, dx, dy FROM l JOIN pts ON x BETWEEN least(ax, ax + dx) - 60 AND greatest(ax, ax + dx) + 60 AND y BETWEEN least(ay, ay + dy) - 60 AND greatest(ay, ay + dy) + 60),
k AS (SELECT seg_id, round(p * m / 20) * 20 AS s, quantile_cont(laeq, 0.5) AS z FROM d WHERE sqrt(pow(px - p * dx, 2) + pow(py - p * dy, 2)) <= 60 GROUP BY 1, 2 HAVING count(*) >= 3),
w AS (SELECT seg_id, s, z, quantile_cont(z, 0.5) OVER (PARTITION BY seg_id ORDER BY s ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mid FROM k), e AS (SELECT seg_id, unnest(range(CAST(floor(m / 20) AS BIGINT) + 1)) * 20.0::DOUBLE AS s FROM l),
f AS (SELECT e.seg_id, e.s, w.z FROM e LEFT JOIN w ON w.seg_id = e.seg_id AND w.s = e.s AND abs(w.z - w.mid) <= 1.5),
g AS (SELECT *, last_value(CASE WHEN z IS NOT NULL THEN s END IGNORE NULLS) OVER a AS sa, last_value(z IGNORE NULLS) OVER a AS za, first_value(CASE WHEN z IS NOT NULL THEN s END IGNORE NULLS) OVER b AS sb, first_value(z IGNORE NULLS) OVER b AS zb FROM f WINDOW a AS (PARTITION BY seg_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY seg_id ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT seg_id AS edge_id, s AS station, round(coalesce(z, za + (zb - za) * (s - sa) / (sb - sa), za, zb), 4) AS z FROM g""")
def deck_profile(spark, sf_dir):
    pts = view(spark, sf_dir, "pts").select("x", "y", F.col("laeq").alias("z"), F.lit(17).alias("cls"))
    decks = view(spark, sf_dir, "segs").select(F.col("seg_id").alias("edge_id"), F.lit(0).alias("seq"), "ax", "ay", "bx", "by")
    return _round_all(lidar.deck_profile(pts, decks, reach=60.0, step=20.0), 4)


@query(ctes("segs") + """, a AS (SELECT seg_id, 1000.0::DOUBLE + seg_id % 50 AS r, CASE seg_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.62 WHEN 2 THEN 0.7 ELSE 0.9 END AS part FROM segs), b AS (SELECT *, sqrt(least(2.8, greatest(1.8, 1 / part / part))) AS f FROM a)
SELECT seg_id AS airport, level, round(CASE level WHEN 70 THEN r * part WHEN 65 THEN r WHEN 60 THEN r * f ELSE r * f * f END, 3) AS radius, CAST(360 AS BIGINT) AS n FROM b CROSS JOIN (VALUES (55.0::DOUBLE), (60.0::DOUBLE), (65.0::DOUBLE), (70.0::DOUBLE)) l(level)""")
def contour_extension(spark, sf_dir):
    """Circles around every supplier's segment as two official rings, extended outwards."""
    segs = view(spark, sf_dir, "segs").withColumn("r", 1000.0 + F.col("seg_id") % 50)
    part = F.element_at(F.array(*map(F.lit, (0.5, 0.62, 0.7, 0.9))), (F.col("seg_id") % 4 + 1).cast("int"))
    ring = lambda r: F.transform(F.sequence(F.lit(0), F.lit(360)), lambda k: F.struct((F.col("ax") + r * F.cos(k * F.pi() / 180)).alias("x"), (F.col("ay") + r * F.sin(k * F.pi() / 180)).alias("y")))
    rows = segs.select(F.col("seg_id").alias("airport"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.explode(F.array(F.struct(F.lit(65.0).alias("level"), ring(F.col("r")).alias("ring")), F.struct(F.lit(70.0).alias("level"), ring(F.col("r") * part).alias("ring")))).alias("c"))
    contours = rows.select(F.concat_ws(":", "airport", "c.level").alias("contour_id"), "airport", "cx", "cy", "c.level", "c.ring")
    out = lidar.extend_contours(lidar.ring_radii(contours, 360), contours.select("contour_id", "airport", "level"), n=360)
    return out.groupBy("airport", "level").agg(_r(F.avg("radius"), 3).alias("radius"), F.count("*").alias("n"))


@query(ctes("pts", "segs") + """, d AS (SELECT pk, seg_id, abs(x - ax) AS dx, abs(y - ay) AS dy FROM pts JOIN segs ON seg_id % 10 = 1 AND x >= ax - 800 AND x < ax + 800 AND y >= ay - 500 AND y < ay + 500), l AS (SELECT pk, seg_id, dx, dy, CASE WHEN dx < 400 AND dy < 200 THEN 70 ELSE 65 END AS level FROM d)
SELECT pk, seg_id AS airport, round(CASE level WHEN 70 THEN 70 + 5 * least(1, least(400 - dx, 200 - dy) / 200) ELSE 65 + 5 * least(800 - dx, 500 - dy) / (least(800 - dx, 500 - dy) + sqrt(pow(greatest(dx - 400, 0), 2) + pow(greatest(dy - 200, 0), 2))) END, 7) AS level FROM l""")
def contour_levels(spark, sf_dir):
    """Levels of points between the borders of oblong contours."""
    segs = view(spark, sf_dir, "segs").where("seg_id % 10 = 1")
    p = lambda x, y: F.struct((F.col("ax") + x).alias("x"), (F.col("ay") + y).alias("y"))
    ring = lambda w, h: F.array(p(-w, -h), p(w, -h), p(w, h), p(-w, h), p(-w, -h))
    both = F.array(F.struct(F.lit(65.0).alias("level"), ring(800.0, 500.0).alias("ring")), F.struct(F.lit(70.0).alias("level"), ring(400.0, 200.0).alias("ring")))
    contours = segs.select(F.col("seg_id").alias("airport"), F.explode(both).alias("c")).select("airport", "c.*")
    return _round_all(lidar.contour_level(view(spark, sf_dir, "pts"), contours), 7)


@query()
def mesh_surface(spark, sf_dir):
    pts = view(spark, sf_dir, "pts")
    cells = pts.withColumns({"cell_e": F.floor(F.col("x") / 500).cast("int"), "cell_n": F.floor(F.col("y") / 500).cast("int")})
    around = S.with_neighbours(cells)
    e, n = F.col("home_e") * 500, F.col("home_n") * 500
    halo = around.where(F.col("x").between(e - 50, e + 550) & F.col("y").between(n - 50, n + 550))
    mesh = field.mesh_surface(halo, 10.0, 60.0, 500.0)
    return mesh.groupBy("cell_e", "cell_n").agg(F.count("*").alias("n"), _r(F.avg("value"), 2).alias("mean"))


@query("""SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round((c + 0.5) * 20 * 0.5 - (r + 0.5) * 20 * 0.25 + 50, 4) AS value FROM range(10, 190) a(r) CROSS JOIN range(10, 190) b(c) WHERE (SELECT count(*) FROM lineitem) > 0""")
def mesh_plane(spark, sf_dir):
    """The triangulated surface of all points on a tilted plane, away from the border: the plane itself."""
    x, y = F.col("x") - 352000, F.col("y") - 3784000
    pts = view(spark, sf_dir, "pts").select(x.alias("x"), y.alias("y"), (x * 0.5 - y * 0.25 + 50).alias("laeq"))
    around = S.with_neighbours(pts.withColumns({"cell_e": F.floor(F.col("x") / 500).cast("int"), "cell_n": F.floor(F.col("y") / 500).cast("int")}))
    e, n = F.col("home_e") * 500, F.col("home_n") * 500
    halo = around.where(F.col("x").between(e - 200, e + 700) & F.col("y").between(n - 200, n + 700))
    mesh = field.mesh_surface(halo, 20.0, 1e9, 500.0)
    rows = mesh.select((F.col("cell_n") * 25 + F.col("row")).alias("row"), (F.col("cell_e") * 25 + F.col("col")).alias("col"), _r("value", 4).alias("value"))
    return rows.where(F.col("row").between(10, 189) & F.col("col").between(10, 189))


@query()
def height_model(spark, sf_dir):
    rows = heights.block_split(heights.height_features(_rings(spark, sf_dir)), size=500.0)
    names = [c for c, t in rows.dtypes if c not in ("bld_id", "cx", "cy", "height_m", "held_out")]
    _, test, _, _ = heights.train_heights(rows, names, iterations=5, depth=3)
    return test.select("bld_id", "height_m", _r("estimate", 2).alias("estimate"))


FLAGSHIP = cnel_by_receiver
