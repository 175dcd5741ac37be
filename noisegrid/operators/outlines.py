"""Coverage polygons: the rings around cells, chained without walking them.

Sides of cells keep the covered ground to their left; straight runs of sides become one. Where two sides leave a corner,
a ring first turns left, around its own cell; a ring that meets itself in a corner is then parted there into two. Places
along a ring come from pointer doubling: after k rounds every side knows the least side among the 2**k after it, and
how far away that is, so a ring of n sides takes log2(n) equi-joins and no task sees a whole ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noisegrid.shared import new_path

#: Directions of sides: east, north, west, south; a left turn is one more.
EAST, NORTH, WEST, SOUTH = range(4)


def _kept(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession, "outline")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _key(x: Column, y: Column, way: Column) -> Column:
    """One number for a side by where it starts and its direction; coordinates have 30 bits and a sign."""
    place = lambda v: v.cast("long") + F.lit(1 << 30)
    return F.shiftleft(place(x), 33).bitwiseOR(F.shiftleft(place(y), 2)).bitwiseOR(way.cast("long"))


def unit_sides(cells: DataFrame) -> DataFrame:
    """(x, y, way): sides of cells (cell_e, cell_n) that no other cell shares, by their start, in cells."""
    e, n = F.col("cell_e").cast("long"), F.col("cell_n").cast("long")

    def side(x: Column, y: Column, way: int, line: Column, at: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), F.lit(way).alias("way"), F.lit(way % 2).alias("axis"), line.alias("line"), at.alias("at"))

    sides = F.array(side(e, n, EAST, n, e), side(e + 1, n, NORTH, e + 1, n), side(e + 1, n + 1, WEST, n + 1, e), side(e, n + 1, SOUTH, e, n))
    every = cells.select("cell_e", "cell_n").distinct().select(F.explode(sides).alias("s")).select("s.*")
    return every.groupBy("axis", "line", "at").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("x", "y", "way")]).where("n = 1").drop("n")


def straight_sides(units: DataFrame) -> DataFrame:
    """Units with the side they are part of: (id, sx, sy) of its start and (tx, ty) of its end.

    Sides of one direction on one line join while they follow each other; a window holds the sides of a line.
    """
    forward = F.col("way").isin(EAST, NORTH)
    w = W.partitionBy("axis", "line", "way").orderBy("at")
    run = units.withColumn("run", F.col("at") - F.row_number().over(w))
    whole = W.partitionBy("axis", "line", "way", "run")
    lo, hi = F.min("at").over(whole), F.max("at").over(whole) + 1
    ends = run.withColumns({"_s": F.when(forward, lo).otherwise(hi), "_t": F.when(forward, hi).otherwise(lo)})
    flat = F.col("axis") == 0
    x = lambda c: F.when(flat, F.col(c)).otherwise(F.col("line"))
    y = lambda c: F.when(flat, F.col("line")).otherwise(F.col(c))
    rows = ends.withColumns({"sx": x("_s"), "sy": y("_s"), "tx": x("_t"), "ty": y("_t")}).withColumn("id", _key(F.col("sx"), F.col("sy"), F.col("way")))
    return rows.drop("run", "_s", "_t")


def _ranked(links: DataFrame) -> DataFrame:
    """(id, next) of rings -> (id, ring, ahead): the least id of the ring, and the steps to it."""
    now = _kept(links.select("id", F.col("next").alias("to"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("ahead")))
    step = 1
    while True:
        far = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("ring").alias("_ring"), F.col("ahead").alias("_ahead"))
        less = F.col("_ring") < F.col("ring")
        met = now.join(far, "to").select("id", F.col("_to").alias("to"), F.least("ring", "_ring").alias("ring"), F.when(less, F.col("_ahead") + step).otherwise(F.col("ahead")).alias("ahead"), less.alias("moved"))
        now = _kept(met)
        if now.where("moved").isEmpty():
            return now.select("id", "ring", "ahead")
        step *= 2
        now = now.drop("moved")


def chain(sides: DataFrame) -> DataFrame:
    """(id, way, sx, sy, tx, ty) of straight sides -> with ring, seq: closed rings without a corner met twice.

    seq counts from 0 along a ring. Rings that meet themselves in corners are ranked again after they are parted there,
    others once.
    """
    starts = sides.select(F.col("id").alias("next"), F.col("sx").alias("tx"), F.col("sy").alias("ty"), F.col("way").alias("_way"))
    left = F.col("_way") == (F.col("way") + 1) % 4
    met = sides.select("id", "way", "tx", "ty").join(starts, ["tx", "ty"])
    links = _kept(met.groupBy("id", "tx", "ty").agg(F.max_by("next", left.cast("int")).alias("next"), F.count("*").alias("outs"), F.min_by("next", left.cast("int")).alias("other")))
    first = _ranked(links)
    # both sides that leave a corner are of one ring: part it there
    rings = first.select(F.col("id").alias("next"), F.col("ring").alias("_a")), first.select(F.col("id").alias("other"), F.col("ring").alias("_b"))
    pinched = links.where("outs = 2").join(rings[0], "next").join(rings[1], "other").where("_a = _b").select("id", F.col("other").alias("_other"), F.col("_a").alias("ring"))
    pinched = _kept(pinched)
    if pinched.isEmpty():
        placed = first
    else:
        again = first.join(pinched.select("ring").distinct(), "ring", "left_semi").select("id")
        parted = links.join(again, "id", "left_semi").join(pinched.select("id", "_other"), "id", "left").select("id", F.coalesce("_other", "next").alias("next"))
        placed = first.join(again, "id", "left_anti").unionByName(_ranked(parted))
    length = placed.groupBy("ring").agg(F.count("*").alias("_n"))
    seq = F.pmod(F.col("_n") - F.col("ahead"), F.col("_n"))
    return sides.join(placed.join(length, "ring").select("id", "ring", seq.alias("seq")), "id")


def coverage_rings(cells: DataFrame, size: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """(rings, sides) of cells: rings (ring, outer, area, sides, polygon) and their sides (ring, seq, x1, y1, x2, y2).

    Outer rings run counter-clockwise, holes clockwise, so that areas (negative for holes) add up to that of the cells.
    `polygon` is the outer ring that a hole belongs to. Repeated cells count once; no cells give no rings.
    """
    units = _kept(straight_sides(unit_sides(cells)))
    straight = units.select("id", "way", "sx", "sy", "tx", "ty").distinct()
    sides = _kept(chain(straight))
    doubled = F.sum(F.col("sx") * F.col("ty") - F.col("tx") * F.col("sy"))
    rings = sides.groupBy("ring").agg(doubled.alias("_d"), F.count("*").alias("sides"))
    rings = rings.select("ring", (F.col("_d") > 0).alias("outer"), (F.col("_d") / 2 * size * size).alias("area"), "sides")
    parents = _polygons(units, sides.select("id", "ring"), rings)
    corners = [(F.col(c) * size).alias(n) for c, n in (("sx", "x1"), ("sy", "y1"), ("tx", "x2"), ("ty", "y2"))]
    return rings.join(parents, "ring"), sides.select("ring", "seq", *corners)


def _polygons(units: DataFrame, of_side: DataFrame, rings: DataFrame) -> DataFrame:
    """(ring, polygon). West of a hole's leftmost side stand covered cells, and at their other end a ring of the same
    polygon that reaches farther west; following these leads to the outer ring. A window holds the sides in a row."""
    upright = units.where("axis = 1").join(of_side, "id").select("ring", F.col("line").alias("x"), F.col("at").alias("row"))
    west = upright.withColumn("parent", F.lag("ring").over(W.partitionBy("row").orderBy("x")))
    first = west.groupBy("ring").agg(F.min(F.struct("x", "row", "parent")).alias("m"))
    now = _kept(rings.join(first, "ring").select("ring", F.when(F.col("outer"), F.col("ring")).otherwise(F.col("m.parent")).alias("polygon")))
    while True:
        up = now.select(F.col("ring").alias("polygon"), F.col("polygon").alias("_up"))
        met = _kept(now.join(up, "polygon").select("ring", F.col("_up").alias("polygon"), (F.col("_up") != F.col("polygon")).alias("moved")))
        now = met.drop("moved")
        if met.where("moved").isEmpty():
            return now


def polygons(rings: DataFrame, sides: DataFrame) -> DataFrame:
    """(polygon, area, coordinates): one row for each polygon, its outer ring first, each ring closed, as in GeoJSON. A
    row is as large as its polygon."""
    lines = sides.groupBy("ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x1", "y1"))).alias("s"))
    points = F.transform("s", lambda p: F.array(p["x1"], p["y1"]))
    closed = lines.select("ring", F.concat(points, F.slice(points, 1, 1)).alias("line"))
    rows = rings.join(closed, "ring").groupBy("polygon").agg(F.sum("area").alias("area"), F.sort_array(F.collect_list(F.struct((~F.col("outer")).alias("hole"), "ring", "line"))).alias("r"))
    return rows.select("polygon", "area", F.col("r.line").alias("coordinates"))
