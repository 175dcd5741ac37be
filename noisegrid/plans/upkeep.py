"""Registered queries over what is kept up to date: stored surfaces, releases and streams; their SQL starts afresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from noisegrid.functions import levels as L
from noisegrid.operators import field, stored
from noisegrid.plans.queries import _BINS, _blur_sql, _round_all, query
from noisegrid.plans.views import ctes, view
from noisegrid.shared import new_path
from noisegrid.streaming import jobs, release, stateful

c = F.col


def _before(pts):
    """The points before a change: some had other levels, some places had none."""
    return pts.where("x < 355200").withColumn("laeq", F.when(c("pk") % 997 == 0, c("laeq") + 1).otherwise(c("laeq")))


@query(_BINS.format(s=40) + f""", k1(o, w) AS {_blur_sql(72.0, 40.0)}, k2(o, w) AS {_blur_sql(240.0, 40.0)},
a AS (SELECT r + i.o AS r, c + j.o AS c, sum(s * i.w * j.w) AS s, sum(n * i.w * j.w) AS n FROM b CROSS JOIN k1 i CROSS JOIN k1 j GROUP BY 1, 2),
d AS (SELECT r + i.o AS r, c + j.o AS c, sum(s * i.w * j.w) AS s, sum(n * i.w * j.w) AS n FROM b CROSS JOIN k2 i CROSS JOIN k2 j GROUP BY 1, 2),
m AS (SELECT coalesce(a.r, d.r) AS r, coalesce(a.c, d.c) AS c, coalesce(a.s / a.n, d.s / d.n) AS v FROM (SELECT * FROM a WHERE n > 0.0500001) a FULL JOIN (SELECT * FROM d WHERE n > 0.0200001) d ON a.r = d.r AND a.c = d.c)
SELECT r AS "row", c AS col, round(v, 3) AS value FROM m""")
def refreshed_surface(spark, sf_dir):
    """A stored surface after a change, which must be the surface of the points as they are now."""
    pts, path = view(spark, sf_dir, "pts"), new_path(spark, "surface")
    surface = lambda p: field.gaussian_surface(field.bin_points(p, 40.0), 40.0, 72.0, 240.0, 0.0500001, 0.0200001)
    for points in (_before(pts), pts):
        stored.refresh_surface(points, path, surface, 1000.0, 40.0, "v1", ["pk", "laeq"])
    return _round_all(stored.read_surface(spark, path).select("row", "col", "value"), 3)


@query(ctes("pts") + """, p AS (SELECT 4 AS z, CAST(floor(x / 40) AS INT) AS wx, CAST(floor(y / 40) AS INT) AS wy, CAST(sum(CAST(round(laeq * 1000000) AS BIGINT)) AS DOUBLE) / 1e6 / count(laeq) AS v FROM pts GROUP BY 2, 3),
q AS (SELECT 3 AS z, wx // 2 AS wx, wy // 2 AS wy, CAST(sum(CAST(round(v * 1000000) AS BIGINT)) AS DOUBLE) / 1e6 / count(v) AS v FROM p GROUP BY 2, 3), s AS (SELECT 2 AS z, wx // 2 AS wx, wy // 2 AS wy, CAST(sum(CAST(round(v * 1000000) AS BIGINT)) AS DOUBLE) / 1e6 / count(v) AS v FROM q GROUP BY 2, 3), u AS (SELECT * FROM p UNION ALL SELECT * FROM q UNION ALL SELECT * FROM s)
SELECT z, CAST(wx // 16 AS INT) AS x, CAST(wy // 16 AS INT) AS y, CAST(wx % 16 AS INT) AS px, CAST(wy % 16 AS INT) AS py, v AS value FROM u""")
def refreshed_pyramid(spark, sf_dir):
    """A stored pyramid after a change: changed cells reach the tiles over them and those tiles' ancestors."""
    pts, surface, path = view(spark, sf_dir, "pts"), new_path(spark, "surface"), new_path(spark, "pyramid")
    means = lambda p: p.groupBy(F.floor(c("y") / 40).alias("row"), F.floor(c("x") / 40).alias("col")).agg(L.exact_mean(c("laeq")).alias("value"))
    for points in (_before(pts), pts):
        dirty = stored.refresh_surface(points, surface, means, 1000.0, 40.0, "v1", ["pk", "laeq"])
        stored.refresh_pyramid(dirty, surface, path, stored.metre_tiling(4, 1000.0, 40.0, 16), 2, 16)
    return stored.read_pyramid(spark, path).select("z", "x", "y", "px", "py", "value")


def _runs_of_orders(spark, sf_dir):
    k = c("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("t"), (c("o_custkey") % 40).cast("string")).alias("tile_id"), (k % 3).cast("int").alias("rank"), k.alias("ended"), F.floor("o_totalprice").cast("double").alias("level"), (k % 5).alias("part"))


@query("""WITH r AS (SELECT 't' || (o_custkey % 40) AS tile_id, CAST(o_orderkey % 3 AS INT) AS rank, o_orderkey AS ended, CAST(floor(o_totalprice) AS DOUBLE) AS level FROM orders),
m AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY rank DESC, ended DESC) AS k FROM r) SELECT tile_id, rank, ended, level FROM m WHERE k = 1""")
def released_tiles(spark, sf_dir):
    """What readers see after runs of tiles came in five parts: each tile's best run."""
    runs, source, target = _runs_of_orders(spark, sf_dir), new_path(spark, "runs"), new_path(spark, "release")
    schema, state = runs.drop("part").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), new_path(spark, "stream")
    for part in range(5):
        runs.where(c("part") == part).drop("part").write.mode("append").parquet(source)
        release.stream_release(spark, source, schema, target, state, lambda b: b, lambda b: b.where("level < 0")).awaitTermination()
    return release.read_release(spark, target).select("tile_id", "rank", "ended", "level")


def _live(spark, parts, build, mode="append"):
    """Write the parts one by one and let the stream that build() makes of them run after each; what it has given."""
    source, target, state = (new_path(spark, n) for n in ("parts", "live", "stream"))
    for part in parts:
        part.write.mode("append").parquet(source)
        out = build(spark.readStream.schema(part.schema).parquet(source))
        out.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(target)


@query(ctes("trace") + """, n AS (SELECT ident, t_s, CASE WHEN t_s - lag(t_s) OVER w <= 300 THEN 0 ELSE 1 END AS new FROM trace WINDOW w AS (PARTITION BY ident ORDER BY t_s)), p AS (SELECT ident, t_s, sum(new) OVER (PARTITION BY ident ORDER BY t_s) AS k FROM n)
SELECT CAST(ident AS VARCHAR) AS ident, min(t_s) + 1000000 AS start, max(t_s) + 1000000 AS "end", count(*) AS points FROM p GROUP BY ident, k HAVING max(t_s) + 300 <= (SELECT max(t_s) FROM trace) - 900""")
def live_paths(spark, sf_dir):
    """Paths of points that came in three parts, some before earlier ones: those that have ended."""
    rows = view(spark, sf_dir, "trace").select(c("ident").cast("string").alias("ident"), (c("t_s") + 1e6).alias("epoch"), F.timestamp_seconds(c("t_s") + 1e6).alias("ts"), (c("t_s") + c("pt_id") * 7919 % 800).alias("came"))
    last = rows.agg(F.max("came")).first()[0]
    parts = [rows.where((c("came") > last * k / 3) & (c("came") <= last * (k + 1) / 3) if k else c("came") <= last / 3).drop("came") for k in range(3)]
    return _live(spark, parts, lambda s: stateful.stream_paths(s, 300.0, "900 seconds"))


_LIVE_EVENTS = ctes("obs") + """, e AS (SELECT obs_id AS k, CAST(receiver_id % 20 AS VARCHAR) AS site, epoch(ts) AS t, floor(epoch(ts) / 3600) * 3600 AS start, laeq, obs_id % 3 AS part FROM obs),
z AS (SELECT s.site, p.part, (SELECT max(t) FROM e WHERE e.site = s.site AND e.part <= p.part) - 600 AS closed FROM (SELECT DISTINCT site FROM e) s CROSS JOIN (VALUES (0), (1), (2)) p(part)),
f AS (SELECT e.*, start + 3600 <= coalesce((SELECT closed FROM z WHERE z.site = e.site AND z.part = e.part - 1), -1) AS late, start + 3600 <= (SELECT closed FROM z WHERE z.site = e.site AND z.part = 2) AS done FROM e)"""


def _live_events(spark, sf_dir):
    rows = view(spark, sf_dir, "obs").select((c("receiver_id") % 20).cast("string").alias("site"), c("obs_id").cast("string").alias("event_id"), c("ts").cast("timestamp").alias("ts"), c("laeq").alias("sel"), (c("obs_id") % 3).alias("part"))
    return _live(spark, [rows.where(c("part") == k).drop("part") for k in range(3)], stateful.stream_levels)


@query(_LIVE_EVENTS + " SELECT site, CAST(start AS BIGINT) AS start, round(10 * log10(sum(pow(10.0::DOUBLE, laeq / 10)) / 3600), 6) AS laeq, count(*) AS n FROM f WHERE done AND NOT late GROUP BY site, f.start")
def live_levels(spark, sf_dir):
    """Hourly levels of events that came in three parts: those of hours that have closed."""
    return _round_all(stateful.levels_of(_live_events(spark, sf_dir)).withColumn("start", F.unix_seconds("start")), 6)


@query(_LIVE_EVENTS + " SELECT site, CAST(k AS VARCHAR) AS event_id, laeq AS sel FROM f WHERE late")
def late_events(spark, sf_dir):
    """The very events that came after their hour had closed."""
    return stateful.left_out(_live_events(spark, sf_dir)).select("site", "event_id", "sel")


@query(ctes("obs") + """, r AS (SELECT ts, CAST(receiver_id % 5 AS VARCHAR) AS host, obs_id % 100 AS receivers, 1 + obs_id % 7 AS seconds FROM obs), w AS (SELECT *, CAST(floor(epoch(ts) / 600) * 600 + 600 * k AS BIGINT) AS "at" FROM r CROSS JOIN range(1, 19) g(k))
SELECT "at", host, sum(receivers)::DOUBLE / sum(seconds) AS per_second, count(*) AS runs FROM w WHERE "at" <= (SELECT max(epoch(ts)) FROM obs) - 3600 GROUP BY 1, 2""")
def live_throughput(spark, sf_dir):
    """Receivers a second by host over three hours, every ten minutes, once the watermark has passed."""
    runs = view(spark, sf_dir, "obs").select(c("ts").cast("timestamp").alias("ended"), (c("receiver_id") % 5).cast("string").alias("host"), (c("obs_id") % 100).alias("receivers"), (1 + c("obs_id") % 7).alias("seconds"))
    return _live(spark, [runs], jobs.stream_throughput).withColumn("at", F.unix_seconds("at"))
