"""Registered queries over selection, inventory, counts and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from noisegrid.functions import geometry as G
from noisegrid.functions import levels as L
from noisegrid.functions import timefns as T
from noisegrid.operators import compare, events, field, heights, lidar, roads, rules, tiles, traces
from noisegrid.operators import spatial as S
from noisegrid.plans.queries import _BINS, _blur_sql, _orders, _rings, _round_all, _sel, query
from noisegrid.plans.views import ctes, view


@query(ctes("obs") + ", a AS (SELECT DISTINCT obs_id AS k FROM obs WHERE obs_id % 3 <> 0), b AS (SELECT DISTINCT obs_id AS k FROM obs WHERE obs_id % 4 <> 0) SELECT CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def key_overlap(spark, sf_dir):
    obs = view(spark, sf_dir, "obs").select("obs_id")
    return tiles.key_overlap(obs.where("obs_id % 3 <> 0"), obs.where("obs_id % 4 <> 0"), "obs_id")


@query(ctes("obs") + ", a AS (SELECT obs_id AS k FROM obs WHERE obs_id % 3 <> 0), b AS (SELECT obs_id AS k FROM obs WHERE obs_id % 4 <> 0) SELECT k, 'missing' AS problem FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'unexpected' FROM b WHERE k NOT IN (SELECT k FROM a)")
def inventory_diff(spark, sf_dir):
    obs = view(spark, sf_dir, "obs").select(F.col("obs_id").alias("k"))
    return rules.inventory_diff(obs.where("k % 3 <> 0"), obs.where("k % 4 <> 0"), "k")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 7 <> 0 AND o_custkey % 5 <> 0")
def todo_cells(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_custkey")
    return tiles.todo_cells(o.select("k"), o.where("o_orderstatus = 'F'"), o.where("k % 7 = 0"), o.where("o_custkey % 5 = 0"), keys=["k"])


@query("SELECT o_orderkey AS run_id, o_orderdate AS ended FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 8")
def recent_runs(spark, sf_dir):
    return compare.recent_runs(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("ended")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return rules.assert_unique(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query(ctes("obs") + ", h AS (SELECT receiver_id, CAST(ts AS DATE) AS d, count(DISTINCT period) AS k, max(CASE WHEN period = 'D' THEN 1 ELSE 0 END) AS pd, max(CASE WHEN period = 'E' THEN 1 ELSE 0 END) AS pe, max(CASE WHEN period = 'N' THEN 1 ELSE 0 END) AS pn FROM obs GROUP BY 1, 2) SELECT receiver_id, CAST(d AS VARCHAR) AS day, concat(CASE WHEN pd = 0 THEN 'D' ELSE '' END, CASE WHEN pe = 0 THEN 'E' ELSE '' END, CASE WHEN pn = 0 THEN 'N' ELSE '' END) AS missing FROM h WHERE k < 3")
def incomplete_periods(spark, sf_dir):
    obs = view(spark, sf_dir, "obs").withColumn("day", F.to_date("ts").cast("string"))
    return rules.assert_complete(obs, ["D", "E", "N"], ["receiver_id", "day"]).select("receiver_id", "day", F.array_join("missing", "").alias("missing"))


@query("SELECT 'event_type' AS name, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY user_id")
def quality_counts(spark, sf_dir):
    return compare.quality_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type", "user_id"])


@query(ctes("obs") + ", m AS (SELECT receiver_id, period, avg(laeq) AS v FROM obs GROUP BY 1, 2), p AS (SELECT receiver_id % 50 AS building_key, max(CASE WHEN period = 'D' THEN v END) AS max_d, min(CASE WHEN period = 'D' THEN v END) AS min_d, max(CASE WHEN period = 'E' THEN v END) AS max_e, min(CASE WHEN period = 'E' THEN v END) AS min_e, max(CASE WHEN period = 'N' THEN v END) AS max_n, min(CASE WHEN period = 'N' THEN v END) AS min_n FROM m GROUP BY 1) SELECT building_key, round(max_d, 3) AS max_d, round(min_d, 3) AS min_d, round(max_e, 3) AS max_e, round(min_e, 3) AS min_e, round(max_n, 3) AS max_n, round(min_n, 3) AS min_n FROM p")
def facade_extremes(spark, sf_dir):
    mean = view(spark, sf_dir, "obs").groupBy("receiver_id", "period").agg(F.avg("laeq").alias("laeq"))
    wide = tiles.pivot_periods(mean, ["receiver_id"]).withColumn("building_key", F.col("receiver_id") % 50)
    return _round_all(tiles.facade_extremes(wide), 3)


@query(ctes("pts") + " SELECT min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM pts")
def envelope(spark, sf_dir):
    return tiles.envelope(view(spark, sf_dir, "pts"))


@query(ctes("pts") + ', g AS (SELECT CAST(floor(y / 100) AS INT) AS r, CAST(floor(x / 100) AS INT) AS c, CAST(sum(CAST(round(laeq * 1000000) AS BIGINT)) AS DOUBLE) / 1e6 / count(laeq) AS v FROM pts GROUP BY 1, 2) SELECT a.r AS "row", a.c AS col, round(avg(CASE WHEN b.v >= 55 THEN 1.0 ELSE 0.0 END), 6) AS share FROM g a JOIN g b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY 1, 2')
def box_share(spark, sf_dir):
    bins = field.bin_points(view(spark, sf_dir, "pts"), 100.0)
    return _round_all(field.box_share(bins, F.col("sum") / F.col("n") >= 55, 2), 6)


@query(ctes("pts") + """, g AS (SELECT CAST(floor(y / 50) AS INT) AS r, CAST(floor(x / 50) AS INT) AS c, min(CASE WHEN pk % 5 = 0 THEN laeq END) AS v FROM pts GROUP BY 1, 2),
n AS (SELECT a.r, a.c, avg(b.v) AS v FROM g a JOIN g b ON (b.r = a.r AND abs(b.c - a.c) = 1) OR (b.c = a.c AND abs(b.r - a.r) = 1) GROUP BY 1, 2) SELECT g.r AS "row", g.c AS col, round(coalesce(g.v, n.v), 4) AS ground FROM g LEFT JOIN n ON g.r = n.r AND g.c = n.c""")
def fill_gaps(spark, sf_dir):
    pts = view(spark, sf_dir, "pts").select("x", "y", F.col("laeq").alias("z"), F.lit(0).cast("long").alias("block"), F.when(F.col("pk") % 5 == 0, 2).otherwise(1).alias("cls"), F.lit(1).alias("ret"))
    return _round_all(lidar.fill_gaps(lidar.rasterize_points(pts, 50.0), 1).select("row", "col", "ground"), 4)


@query(ctes("pts") + ", v AS (SELECT floor(x / 200) AS a, floor(y / 200) AS b, floor(laeq / 5) AS c, max(laeq) AS z FROM pts GROUP BY 1, 2, 3) SELECT z, count(*) AS n FROM v GROUP BY z")
def thin_voxels(spark, sf_dir):
    pts = view(spark, sf_dir, "pts").select("x", "y", (F.col("laeq") * 40).alias("z"))
    return lidar.thin_voxels(pts, 200.0).select(F.round(F.col("z") / 40, 6).alias("z")).groupBy("z").agg(F.count("*").alias("n"))


@query(ctes("pts") + ', g AS (SELECT CAST(floor(y / 50) AS INT) AS r, CAST(floor(x / 50) AS INT) AS c, CAST(sum(CAST(round(laeq * 1000000) AS BIGINT)) AS DOUBLE) / 1e6 / count(laeq) AS v FROM pts GROUP BY 1, 2) SELECT pk, v AS value FROM pts JOIN g ON r = CAST(floor(y / 50) AS INT) AND c = CAST(floor(x / 50) AS INT)')
def sample_nearest_cell(spark, sf_dir):
    pts = view(spark, sf_dir, "pts")
    grid = field.bin_points(pts, 50.0).select("row", "col", (F.col("sum") / F.col("n")).alias("value"))
    return S.sample_raster(pts, grid, 50.0)


@query("SELECT o_custkey AS tile_id, o_orderkey AS run_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS id FROM orders")
def assign_ids(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_custkey").alias("tile_id"), F.col("o_orderkey").alias("run_id"), "o_orderdate")
    return tiles.assign_ids(o, ["tile_id"], F.col("o_orderdate"), F.col("run_id")).select("tile_id", "run_id", "id")


@query(ctes("stops") + ", d AS (SELECT clock, count(*) AS fragments, min(route) AS first_end, count(DISTINCT route) AS ends FROM stops GROUP BY clock) SELECT clock, fragments, first_end, CAST(ends AS INTEGER) AS ends FROM d")
def dedupe_events(spark, sf_dir):
    out = traces.dedupe_events(view(spark, sf_dir, "stops").withColumnRenamed("route", "runway_end"), ["clock"])
    return out.select("clock", "fragments", F.col("runway_ends")[0].alias("first_end"), F.size("runway_ends").alias("ends"))


@query("WITH s AS (SELECT o_custkey AS run_id, o_orderpriority AS stage, min(CASE WHEN o_orderstatus = 'O' THEN o_orderdate END) AS a, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS b FROM orders GROUP BY 1, 2) SELECT run_id, stage, CAST(date_diff('day', CAST(a AS DATE), CAST(b AS DATE)) * 86400 AS DOUBLE) AS seconds FROM s")
def stage_seconds(spark, sf_dir):
    event = F.when(F.col("o_orderstatus") == "O", "stage_submitted").when(F.col("o_orderstatus") == "F", "stage_completed")
    return compare.stage_seconds(_orders(spark, sf_dir).select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("stage"), event.alias("event"), F.col("o_orderdate").alias("ts")))


@query(ctes("obs") + " SELECT receiver_id, round(10 * log10(pow(10.0::DOUBLE, max(laeq) / 10) + pow(10.0::DOUBLE, min(laeq) / 10)), 3) AS both, round(CASE WHEN min(laeq) <= 45 THEN max(laeq) WHEN max(laeq) > min(laeq) + 3 THEN 10 * log10(pow(10.0::DOUBLE, max(laeq) / 10) - pow(10.0::DOUBLE, min(laeq) / 10)) END, 3) AS rest, round(max(laeq) + 10 * log10(600), 3) AS sel FROM obs GROUP BY receiver_id")
def level_algebra(spark, sf_dir):
    r = view(spark, sf_dir, "obs").groupBy("receiver_id").agg(F.max("laeq").alias("a"), F.min("laeq").alias("b"))
    return _round_all(r.select("receiver_id", L.energy_add_n(F.col("a"), F.col("b")).alias("both"), L.energy_subtract(F.col("a"), F.col("b")).alias("rest"), L.sel_from_laeq(F.col("a"), F.lit(600.0)).alias("sel")), 3)


@query(ctes("obs") + " SELECT cls, period, round(avg(abs(laeq - 60)), 4) AS mae, round(sqrt(avg((laeq - 60) * (laeq - 60))), 4) AS rmse, count(*) AS n FROM obs GROUP BY 1, 2")
def error_by_class(spark, sf_dir):
    obs = view(spark, sf_dir, "obs").withColumn("reference", F.lit(60.0))
    return _round_all(compare.error_stats(obs, "laeq", "reference", ["cls", "period"]).select("cls", "period", "mae", "rmse", "n"), 4)


@query(ctes("blds") + " SELECT bld_id, round(4 * half_w * half_h, 3) AS area, round(4 * (half_w + half_h), 3) AS perimeter, round(least(half_w, half_h) / greatest(half_w, half_h), 6) AS aspect, round(cx, 3) AS cx, round(cy, 3) AS cy FROM blds")
def footprint_stats(spark, sf_dir):
    s = _rings(spark, sf_dir).select("bld_id", G.ring_stats(F.col("ring")).alias("s"))
    return s.select("bld_id", F.round("s.area", 3).alias("area"), F.round("s.perimeter", 3).alias("perimeter"), F.round("s.aspect", 6).alias("aspect"), F.round("s.cx", 3).alias("cx"), F.round("s.cy", 3).alias("cy"))


@query(ctes("segs") + ", l AS (SELECT seg_id, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS m FROM segs), n AS (SELECT seg_id, m, greatest(1, ceil(m / 25)) AS k FROM l) SELECT seg_id AS edge_id, CAST(k + 1 AS BIGINT) AS points, round(m, 3) AS length FROM n")
def densify_lines(spark, sf_dir):
    segs = view(spark, sf_dir, "segs").select(F.col("seg_id").alias("edge_id"), F.lit(0).alias("seq"), "ax", "ay", "bx", "by")
    return _round_all(S.densify(segs, 25.0).groupBy("edge_id").agg(F.count("*").alias("points"), F.max("station").alias("length")), 3)


@query(ctes("trace") + ", b AS (SELECT ident, t_s, x, y FROM trace WHERE x BETWEEN 353000 AND 354000 AND y BETWEEN 3785000 AND 3786000) SELECT ident, count(*) AS points, min(t_s) AS first_s FROM b GROUP BY ident")
def points_in_box(spark, sf_dir):
    trace = view(spark, sf_dir, "trace").withColumn("depth", F.lit(0))
    return lidar.scan_points(trace, 353000.0, 3785000.0, 354000.0, 3786000.0, 0).groupBy("ident").agg(F.count("*").alias("points"), F.min("t_s").alias("first_s"))


@query(ctes("recs") + " SELECT edge_id, CASE WHEN mtfcc IN ('S1100', 'S1630') THEN 'F' WHEN mtfcc = 'S1200' THEN 'A' ELSE 'L' END AS cls FROM recs WHERE mtfcc <> 'S1740'")
def edge_classes(spark, sf_dir):
    from noisegrid.functions.traffic import CLASS_DEFAULTS, source_class

    edges = view(spark, sf_dir, "recs").withColumns({"ax": F.lit(0.0), "ay": F.lit(0.0), "bx": F.lit(10.0), "by": F.lit(0.0)})
    kept = roads.filter_edges(edges, (-5.0, -5.0, 5.0, 5.0), [c for c in CLASS_DEFAULTS if c != "S1740"])
    return kept.select("edge_id", source_class(F.col("mtfcc"), F.lit(None).cast("string")).alias("cls"))


@query(ctes("obs") + " SELECT CASE WHEN h >= 7 AND h < 19 THEN 'D' WHEN h >= 19 AND h < 22 THEN 'E' ELSE 'N' END AS part, count(*) AS n FROM (SELECT CAST((hour(ts) + 16) % 24 AS INT) AS h FROM obs) GROUP BY 1")
def local_dayparts(spark, sf_dir):
    return _sel(spark, sf_dir).groupBy(T.daypart(F.col("ts"), "-08:00").alias("part")).agg(F.count("*").alias("n"))


@query(ctes("obs") + " SELECT s.v AS side, h.v::DOUBLE AS height_ft, count(*) AS n, round(avg(laeq), 4) AS mean FROM obs CROSS JOIN (VALUES ('16L'), ('16R')) AS s(v) CROSS JOIN (VALUES (0), (100), (200)) AS h(v) GROUP BY 1, 2")
def scenario_grid(spark, sf_dir):
    sites = spark.range(1).select(F.lit("a").alias("site_id"))
    grid = events.scenario_grid(view(spark, sf_dir, "obs").select("laeq"), sites, ["16L", "16R"], [0.0, 100.0, 200.0], [0.0])
    return _round_all(grid.groupBy("side", "height_ft").agg(F.count("*").alias("n"), F.avg("laeq").alias("mean")), 4)


@query()
def stale_cells(spark, sf_dir):
    """Cells of the points whose own or neighbouring rows changed between two versions."""
    pts = view(spark, sf_dir, "pts").withColumns({"cell_e": F.floor(F.col("x") / 250).cast("int"), "cell_n": F.floor(F.col("y") / 250).cast("int")})
    old = pts.withColumn("laeq", F.when(F.col("pk") % 997 == 0, F.col("laeq") + 1).otherwise(F.col("laeq")))
    sign = lambda d: field.cell_signature(d, "v1", ["pk", "laeq"])
    return field.refresh_field(sign(pts), sign(old))[0].select("cell_e", "cell_n")


@query(ctes("blds") + """, r AS (SELECT bld_id, cx, cy, 2 * half_w AS w, 2 * half_h AS h, greatest(4, ceil(4 * (half_w + half_h) / 10)) AS n FROM blds), k AS (SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM r), s AS (SELECT *, (k + 0.5) * 2 * (w + h) / n AS d FROM k),
p AS (SELECT bld_id, k, cx + CASE WHEN d <= w THEN d - w / 2 WHEN d <= w + h THEN w / 2 + 2 WHEN d <= 2 * w + h THEN w / 2 - (d - w - h) ELSE -w / 2 - 2 END AS x, cy + CASE WHEN d <= w THEN -h / 2 - 2 WHEN d <= w + h THEN d - w - h / 2 WHEN d <= 2 * w + h THEN h / 2 + 2 ELSE h / 2 - (d - 2 * w - h) END AS y FROM s)
SELECT bld_id, k, round(x, 4) AS x, round(y, 4) AS y FROM p WHERE NOT EXISTS (SELECT 1 FROM blds b WHERE abs(x - b.cx) < b.half_w + 1 AND abs(y - b.cy) < b.half_h + 1 AND pow(greatest(abs(x - b.cx) - b.half_w, 0), 2) + pow(greatest(abs(y - b.cy) - b.half_h, 0), 2) < 1)""")
def facade_receivers(spark, sf_dir):
    """Receivers around all footprints that stand free of others."""
    rings = _rings(spark, sf_dir).select("bld_id", "ring")
    out = tiles.facade_receivers(rings)
    return _round_all(out.select("bld_id", F.regexp_extract("receiver_key", r":(\d+)$", 1).cast("long").alias("k"), "x", "y"), 4)


@query(ctes("pts", "blds", "segs") + """, c AS (SELECT DISTINCT CAST(floor(x / 1000) AS INT) AS e, CAST(floor(y / 1000) AS INT) AS n FROM pts WHERE x < 353000), g AS (SELECT e * 1000 + (i + 0.5) * s AS x, n * 1000 + (j + 0.5) * s AS y, s FROM c CROSS JOIN (VALUES (20.0::DOUBLE), (10.0::DOUBLE)) v(s) CROSS JOIN range(100) a(i) CROSS JOIN range(100) b(j) WHERE i < 1000 / s AND j < 1000 / s),
r AS (SELECT ax, ay, bx - ax AS dx, by_ - ay AS dy FROM segs WHERE seg_id % 7 = 1), f AS (SELECT * FROM g WHERE s = 20 OR EXISTS (SELECT 1 FROM r WHERE pow(x - ax - greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) * dx, 2) + pow(y - ay - greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) * dy, 2) <= 2500))
SELECT s AS spacing_m, CAST(floor(x / 100) AS BIGINT) AS e, CAST(floor(y / 100) AS BIGINT) AS n, count(*) AS receivers FROM f WHERE NOT EXISTS (SELECT 1 FROM blds b WHERE abs(x - b.cx) < b.half_w + 2 AND abs(y - b.cy) < b.half_h + 2 AND pow(greatest(abs(x - b.cx) - b.half_w, 0), 2) + pow(greatest(abs(y - b.cy) - b.half_h, 0), 2) < 4) GROUP BY 1, 2, 3""")
def open_receivers(spark, sf_dir):
    """The lattices of a column of cells, denser near roads, without what stands in or at a footprint."""
    cells = view(spark, sf_dir, "pts").where("x < 353000").select(F.floor(F.col("x") / 1000).cast("int").alias("cell_e"), F.floor(F.col("y") / 1000).cast("int").alias("cell_n")).distinct()
    out = tiles.open_receivers(cells, view(spark, sf_dir, "segs").where("seg_id % 7 = 1"), _rings(spark, sf_dir).select("ring"), near_m=50.0)
    return out.groupBy("spacing_m", F.floor(F.col("x") / 100).alias("e"), F.floor(F.col("y") / 100).alias("n")).agg(F.count("*").alias("receivers"))


@query(ctes("pts", "blds", "segs") + """, c AS (SELECT DISTINCT CAST(floor(x / 1000) AS INT) AS e, CAST(floor(y / 1000) AS INT) AS n FROM pts), g AS (SELECT e * 1000 + (i + 0.5) * s AS x, n * 1000 + (j + 0.5) * s AS y, s FROM c CROSS JOIN (VALUES (20.0::DOUBLE), (10.0::DOUBLE)) v(s) CROSS JOIN range(100) a(i) CROSS JOIN range(100) b(j) WHERE i < 1000 / s AND j < 1000 / s),
r AS (SELECT ax, ay, bx - ax AS dx, by_ - ay AS dy FROM segs WHERE aadt / CASE WHEN seg_id % 3 = 0 THEN 0.5 ELSE 1 END >= 20000), f AS (SELECT * FROM g WHERE s = 20 OR EXISTS (SELECT 1 FROM r WHERE pow(x - ax - greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) * dx, 2) + pow(y - ay - greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) * dy, 2) <= 2500))
SELECT s AS spacing_m, CAST(floor(x / 100) AS BIGINT) AS e, CAST(floor(y / 100) AS BIGINT) AS n, count(*) AS receivers FROM f WHERE NOT EXISTS (SELECT 1 FROM blds b WHERE abs(x - b.cx) < b.half_w + 2 AND abs(y - b.cy) < b.half_h + 2 AND pow(greatest(abs(x - b.cx) - b.half_w, 0), 2) + pow(greatest(abs(y - b.cy) - b.half_h, 0), 2) < 4) GROUP BY 1, 2, 3""")
def busy_lattice(spark, sf_dir):
    """The lattices of all cells, denser near busy roads, without what stands in or at a footprint."""
    cells = view(spark, sf_dir, "pts").select(F.floor(F.col("x") / 1000).cast("int").alias("cell_e"), F.floor(F.col("y") / 1000).cast("int").alias("cell_n")).distinct()
    edges = view(spark, sf_dir, "segs").withColumnRenamed("aadt", "aadt_assigned").withColumn("split", F.when(F.col("seg_id") % 3 == 0, 0.5).otherwise(1.0))
    out = tiles.open_receivers(cells, roads.busy_edges(edges, 20000.0), _rings(spark, sf_dir).select("ring"), near_m=50.0)
    return out.groupBy("spacing_m", F.floor(F.col("x") / 100).alias("e"), F.floor(F.col("y") / 100).alias("n")).agg(F.count("*").alias("receivers"))


@query((_BINS.format(s=20) + f""", k1(o, w) AS {_blur_sql(40.0, 20.0)}, k2(o, w) AS {_blur_sql(60.0, 20.0)}, i AS (SELECT DISTINCT CAST(floor(cy / 20) AS INT) AS r, CAST(floor(cx / 20) AS INT) AS c FROM blds),
g AS (SELECT r, c, s / n AS v FROM b ANTI JOIN i USING (r, c)), t AS (SELECT g.r + e.o AS r, g.c + f.o AS c, sum(v * e.w * f.w) / sum(e.w * f.w) AS v FROM g CROSS JOIN k1 e CROSS JOIN k1 f GROUP BY 1, 2), m AS (SELECT g.r, g.c, t.v FROM g JOIN t USING (r, c)),
w AS (SELECT b.r + e.o AS r, b.c + f.o AS c, sum(s * e.w * f.w) / sum(n * e.w * f.w) AS v FROM b CROSS JOIN k2 e CROSS JOIN k2 f GROUP BY 1, 2),
d AS (SELECT i.r, i.c, m.r - i.r AS y, m.c - i.c AS x, m.v FROM i JOIN m ON m.r BETWEEN i.r - 3 AND i.r + 3 AND m.c BETWEEN i.c - 3 AND i.c + 3),
n AS (SELECT r, c, arg_min(v, (y * y + x * x) * 100 + (y + 3) * 10 + x + 3) AS v FROM d WHERE y * y + x * x <= 9 GROUP BY r, c)
SELECT w.r AS "row", w.c AS col, round(coalesce(m.v, n.v, w.v), 3) AS value FROM w LEFT JOIN m USING (r, c) LEFT JOIN n USING (r, c)""").replace("WITH ", "WITH " + ctes("blds").removeprefix("WITH ") + ", ", 1))
def surface_fill(spark, sf_dir):
    """The surface of the points with footprints filled from the ground around."""
    pts, rings = view(spark, sf_dir, "pts"), _rings(spark, sf_dir)
    bins = field.bin_points(pts, 20.0)
    grid = bins.select("row", "col", (F.col("sum") / F.col("n")).alias("value"))
    inside = rings.select(F.floor(F.col("cy") / 20).cast("int").alias("row"), F.floor(F.col("cx") / 20).cast("int").alias("col")).distinct()
    ground = field.ground_smooth(grid, inside, 40.0, 20.0)
    wide = field.blur(bins, 60.0, 20.0).select("row", "col", "value")
    return _round_all(field.fill_surface(wide.select("row", "col"), ground, wide, inside), 3)


@query()
def held_out_blocks(spark, sf_dir):
    """Buildings by 2 km block and whether the block is held out."""
    split = heights.block_split(view(spark, sf_dir, "blds"), size=500.0)
    return split.groupBy(F.floor(F.col("cx") / 500).alias("e"), F.floor(F.col("cy") / 500).alias("n"), "held_out").agg(F.count("*").alias("buildings"))


@query(ctes("trace") + """, k AS (SELECT ident, t_s, alt_ft, quantile_cont(alt_ft, 0.5) OVER (PARTITION BY ident ORDER BY t_s ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mid FROM trace WHERE alt_ft IS NOT NULL), f AS (SELECT t.ident, t.t_s, CASE WHEN abs(k.alt_ft - k.mid) > 500 THEN k.mid ELSE k.alt_ft END AS z FROM trace t LEFT JOIN k ON k.ident = t.ident AND k.t_s = t.t_s),
g AS (SELECT *, last_value(CASE WHEN z IS NOT NULL THEN t_s END IGNORE NULLS) OVER a AS sa, last_value(z IGNORE NULLS) OVER a AS za, first_value(CASE WHEN z IS NOT NULL THEN t_s END IGNORE NULLS) OVER b AS sb, first_value(z IGNORE NULLS) OVER b AS zb FROM f WINDOW a AS (PARTITION BY ident ORDER BY t_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY ident ORDER BY t_s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ident, t_s, round(coalesce(z, za + (zb - za) * (t_s - sa) / (sb - sa)), 4) AS alt_ft FROM g""")
def smoothed_tracks(spark, sf_dir):
    """Altitudes of each trace with spikes replaced and gaps filled."""
    t = view(spark, sf_dir, "trace").select("ident", "t_s", "alt_ft")
    known = traces.running_median(t.where("alt_ft is not null"), "ident", "t_s", "alt_ft", 2, 500.0)
    full = t.select("ident", "t_s").join(known, ["ident", "t_s"], "left")
    return _round_all(traces.interpolate_gaps(full, "ident", "t_s", "alt_ft"), 4)
