"""The noise surface: bins, blurred and triangulated surfaces, fills, web tiles and their pyramid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisegrid.functions import geometry as G
from noisegrid.functions import levels as L
from noisegrid.operators import spatial as S
from noisegrid.operators.small import dealt


def bin_points(points: DataFrame, step: float = 5.0, value: str = "laeq") -> DataFrame:
    """(row, col, sum, n) of points in cells of step metres."""
    return points.groupBy(F.floor(F.col("y") / step).cast("int").alias("row"), F.floor(F.col("x") / step).cast("int").alias("col")).agg(L.exact_sum(F.col(value)).alias("sum"), F.count(value).alias("n"))


def kernel(sigma: float, step: float, reach: float = 3.0) -> list[float]:
    """Half of a Gaussian: weights at 0, 1, ... cells."""
    return [math.exp(-0.5 * (k * step / sigma) ** 2) for k in range(math.ceil(reach * sigma / step) + 1)]


def blur(bins: DataFrame, sigma: float, step: float = 5.0) -> DataFrame:
    """(row, col, value, weight): sums and counts spread with a Gaussian along x, then along y.

    value is the spread sum over the spread count; weight the spread count, 1 where every cell holds one point. A pass
    repeats each cell once for every offset and adds up before the shuffle.
    """
    half = kernel(sigma, step)
    total = half[0] + 2 * sum(half[1:])
    offsets = F.array(*[F.struct(F.lit(k).alias("o"), F.lit(half[abs(k)] / total).alias("w")) for k in range(1 - len(half), len(half))])
    rows = bins.select("row", "col", F.col("sum").cast("double").alias("sum"), F.col("n").cast("double").alias("n"))
    for axis, other in (("col", "row"), ("row", "col")):
        moved = rows.select(other, axis, "sum", "n", F.explode(offsets).alias("k"))
        rows = moved.groupBy(other, (F.col(axis) + F.col("k.o")).alias(axis)).agg(F.sum(F.col("sum") * F.col("k.w")).alias("sum"), F.sum(F.col("n") * F.col("k.w")).alias("n"))
    return rows.select("row", "col", (F.col("sum") / F.col("n")).alias("value"), F.col("n").alias("weight"))


def gaussian_surface(bins: DataFrame, step: float = 5.0, fine: float = 9.0, wide: float = 30.0, dense: float = 0.05, thin: float = 0.02) -> DataFrame:
    """The fine blur where points are dense, else the wide one where there are some, else nothing."""
    a = blur(bins, fine, step).where(F.col("weight") > dense).select("row", "col", F.col("value").alias("_a"))
    b = blur(bins, wide, step).where(F.col("weight") > thin).select("row", "col", F.col("value").alias("_b"))
    return b.join(a, ["row", "col"], "full_outer").select("row", "col", F.coalesce("_a", "_b").alias("value"))


def glow_surface(bins: DataFrame, step: float = 5.0, sigma: float = 24.0, thin: float = 0.02) -> DataFrame:
    """One blur of middling width where there are some points, for the glow under the surface."""
    return blur(bins, sigma, step).where(F.col("weight") > thin).select("row", "col", "value")


def mesh_points(points: DataFrame, segments: DataFrame, on_road_m: float = 8.0, least_aadt: float = 5000.0) -> DataFrame:
    """Receivers without those that stand on quiet roads."""
    return S.off_segments(points, segments.where(F.col("aadt") < least_aadt), on_road_m)


def along_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The order of points along a Z-curve, so that neighbours follow each other."""
    span = max(np.ptp(x), np.ptp(y), 1e-9)

    def spread(v: np.ndarray) -> np.ndarray:
        v = ((v - v.min()) / span * 65535).astype(np.uint64)
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = (v | (v << np.uint64(shift))) & np.uint64(mask)
        return v

    return np.argsort(spread(x) | (spread(y) << np.uint64(1)), kind="stable")


def triangulate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Delaunay triangles of distinct points (indices, three a row, counter-clockwise).

    Points are added along a curve. Each is found by walking from the triangle made last, so in a few steps; triangles
    whose circle holds it, spreading from there over shared sides, leave a hollow, whose border is joined to it.
    """
    n = len(x)
    if n < 3:
        return np.zeros((0, 3), np.int64)
    cx, cy = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
    far = 64.0 * max(np.ptp(x), np.ptp(y), 1.0)
    px = [*(x - cx).tolist(), -2 * far, 2 * far, 0.0]
    py = [*(y - cy).tolist(), -far, -far, 2 * far]
    # a triangle t has corners at[3t..3t+2]; beyond[3t+i] is the triangle over the side from corner i to the next
    at, beyond = [n, n + 1, n + 2], [-1, -1, -1]
    last = 0
    for p in along_curve(x, y).tolist():
        u, v = px[p], py[p]
        t, came = last, -1
        while True:
            k = 3 * t
            a, b, c = at[k], at[k + 1], at[k + 2]
            ax, ay, bx, by, dx, dy = px[a], py[a], px[b], py[b], px[c], py[c]
            if (bx - ax) * (v - ay) < (by - ay) * (u - ax) and beyond[k] != came:
                came, t = t, beyond[k]
            elif (dx - bx) * (v - by) < (dy - by) * (u - bx) and beyond[k + 1] != came:
                came, t = t, beyond[k + 1]
            elif (ax - dx) * (v - dy) < (ay - dy) * (u - dx) and beyond[k + 2] != came:
                came, t = t, beyond[k + 2]
            else:
                break
        hollow, todo, border = {t}, [t], []
        while todo:
            k = 3 * todo.pop()
            for i in (k, k + 1, k + 2):
                o = beyond[i]
                if o in hollow:
                    continue
                a, b = at[i], at[i + 1 if i < k + 2 else k]
                if o >= 0:
                    j = 3 * o
                    ax, ay, bx, by, dx, dy = px[at[j]] - u, py[at[j]] - v, px[at[j + 1]] - u, py[at[j + 1]] - v, px[at[j + 2]] - u, py[at[j + 2]] - v
                    inside = (ax * ax + ay * ay) * (bx * dy - dx * by) - (bx * bx + by * by) * (ax * dy - dx * ay) + (dx * dx + dy * dy) * (ax * by - bx * ay)
                    if inside > 0 or (px[b] - px[a]) * (v - py[a]) <= (py[b] - py[a]) * (u - px[a]):
                        hollow.add(o)
                        todo.append(o)
                        continue
                border.append((a, b, o))
        border = [(a, b, o) for a, b, o in border if o not in hollow]
        free, starts = list(hollow), {}
        for a, b, o in border:
            if free:
                t = free.pop()
                k = 3 * t
                at[k], at[k + 1], at[k + 2] = a, b, p
                beyond[k] = o
            else:
                t = len(at) // 3
                k = 3 * t
                at += (a, b, p)
                beyond += (o, -1, -1)
            starts[a] = t
            if o >= 0:
                j = 3 * o
                if at[j] == b:
                    beyond[j] = t
                elif at[j + 1] == b:
                    beyond[j + 1] = t
                else:
                    beyond[j + 2] = t
        for t in starts.values():
            after = starts[at[3 * t + 1]]
            beyond[3 * t + 1], beyond[3 * after + 2] = after, t
        last = t
    out = np.array(at, np.int64).reshape(-1, 3)
    return out[(out < n).all(axis=1)]


def fill_triangles(corners: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, x0: float, y0: float, step: float, n: int) -> np.ndarray:
    """An n x n grid of the values in triangles at cell centres, linear between corners; nan outside.

    All triangles at once: each is cut into the rows that it crosses, each row into the columns between its sides.
    """
    out = np.full((n, n), np.nan)
    if not len(corners):
        return out
    tx, ty, tv = (x[corners] - x0) / step - 0.5, (y[corners] - y0) / step - 0.5, v[corners]
    slack = 1e-9
    first = np.clip(np.ceil(ty.min(axis=1) - slack), 0, n).astype(int)
    count = np.clip(np.floor(ty.max(axis=1) + slack), -1, n - 1).astype(int) - first + 1
    tri = np.repeat(np.arange(len(corners)), np.maximum(count, 0))
    start = np.cumsum(np.maximum(count, 0)) - np.maximum(count, 0)
    row = first[tri] + np.arange(len(tri)) - start[tri]
    lo, hi = np.full(len(tri), np.inf), np.full(len(tri), -np.inf)
    for i, j in ((0, 1), (1, 2), (2, 0)):
        ay, by, ax, bx = ty[tri, i], ty[tri, j], tx[tri, i], tx[tri, j]
        flat = np.abs(by - ay) < slack
        part = np.where(flat, 0.0, (row - ay) / np.where(flat, 1.0, by - ay))
        on = (part >= -slack) & (part <= 1 + slack) & (~flat | (np.abs(row - ay) <= slack))
        at = ax + part * (bx - ax)
        lo = np.where(on, np.minimum(lo, np.where(flat, np.minimum(ax, bx), at)), lo)
        hi = np.where(on, np.maximum(hi, np.where(flat, np.maximum(ax, bx), at)), hi)
    some = lo <= hi
    tri, row, lo, hi = tri[some], row[some], lo[some], hi[some]
    left = np.clip(np.ceil(lo - slack), 0, n).astype(int)
    width = np.maximum(np.clip(np.floor(hi + slack), -1, n - 1).astype(int) - left + 1, 0)
    cell = np.repeat(np.arange(len(tri)), width)
    col = left[cell] + np.arange(len(cell)) - (np.cumsum(width) - width)[cell]
    tri, row = tri[cell], row[cell]
    (ax, bx, dx), (ay, by, dy) = tx[tri].T, ty[tri].T
    size = (by - dy) * (ax - dx) + (dx - bx) * (ay - dy)
    wa = ((by - dy) * (col - dx) + (dx - bx) * (row - dy)) / size
    wb = ((dy - ay) * (col - dx) + (ax - dx) * (row - dy)) / size
    out[row, col] = wa * tv[tri, 0] + wb * tv[tri, 1] + (1 - wa - wb) * tv[tri, 2]
    return out


def mesh_surface(points: DataFrame, step: float = 5.0, most_edge: float = 40.0, size: float = 1000.0, value: str = "laeq", grain: float = 0.5) -> DataFrame:
    """(cell_e, cell_n, row, col, value): linear inside Delaunay triangles whose edges are most_edge at most.

    Points carry home_e, home_n: with_neighbours() or a halo join has given each cell the points around it, so groups
    are the points of a cell and its halo. Points in one square of `grain` metres become their mean before the shuffle,
    so that a group has no more than its area holds of them, however many points it has. Rows and columns count
    from the cell's corner.
    """
    n = int(size / step)
    at = lambda c: F.floor(F.col(c) / grain)
    means = points.groupBy("home_e", "home_n", at("x").alias("_x"), at("y").alias("_y")).agg(*[F.avg(c).alias(c) for c in ("x", "y", value)]).drop("_x", "_y")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = (pdf[c].to_numpy(float) for c in ("x", "y", value))
        t = triangulate(x, y)
        long = np.max([np.hypot(x[t[:, i]] - x[t[:, j]], y[t[:, i]] - y[t[:, j]]) for i, j in ((0, 1), (1, 2), (2, 0))], axis=0) if len(t) else np.zeros(0)
        out = fill_triangles(t[long <= most_edge], x, y, v, key[0] * size, key[1] * size, step, n)
        r, k = np.nonzero(~np.isnan(out))
        return pd.DataFrame({"cell_e": np.int32(key[0]), "cell_n": np.int32(key[1]), "row": r.astype(np.int32), "col": k.astype(np.int32), "value": out[r, k]})

    return dealt(means, "home_e", "home_n").groupBy("home_e", "home_n").applyInPandas(run, "cell_e int, cell_n int, row int, col int, value double")


def ground_smooth(grid: DataFrame, inside: DataFrame, sigma: float = 4.0, step: float = 5.0) -> DataFrame:
    """Blur of the cells outside footprints (`inside`: row, col); cells inside are cut out."""
    ground = grid.join(inside, ["row", "col"], "left_anti")
    soft = blur(ground.select("row", "col", F.col("value").alias("sum"), F.lit(1).alias("n")), sigma, step)
    return ground.select("row", "col").join(soft.select("row", "col", "value"), ["row", "col"])


def fill_surface(cells: DataFrame, mesh: DataFrame, wide: DataFrame, inside: DataFrame, reach: int = 3) -> DataFrame:
    """A value for each cell: the mesh; else the wide fill outside footprints; inside them the nearest ground cell at
    most `reach` cells away, then the wide fill. Ties go to the least offset."""
    around = sorted(((i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if 0 < i * i + j * j <= reach * reach), key=lambda o: (o[0] ** 2 + o[1] ** 2, o))
    rows = cells.join(inside.withColumn("_in", F.lit(True)), ["row", "col"], "left").join(mesh.select("row", "col", F.col("value").alias("_m")), ["row", "col"], "left").join(wide.select("row", "col", F.col("value").alias("_w")), ["row", "col"], "left")
    need = rows.where("_in and _m is null").select("row", "col")
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(around)])
    tried = need.select("row", "col", F.explode(offsets).alias("o")).select(F.col("row").alias("_r"), F.col("col").alias("_c"), "o.k", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    ground = mesh.join(inside, ["row", "col"], "left_anti")
    near = tried.join(ground, ["row", "col"]).groupBy("_r", "_c").agg(F.min_by("value", "k").alias("_g")).select(F.col("_r").alias("row"), F.col("_c").alias("col"), "_g")
    return rows.join(near, ["row", "col"], "left").select("row", "col", F.coalesce("_m", "_g", "_w").alias("value"))


def web_pixels(points: DataFrame, zoom: int, tile: int = 256) -> DataFrame:
    """Points (lon, lat) with tile and pixel (x_tile, y_tile, px, py)."""
    w = G.world_px(F.col("lon"), F.col("lat"), zoom, tile)
    rows = points.withColumn("_w", w)
    return rows.withColumns({"x_tile": F.floor(F.col("_w.x") / tile).cast("int"), "y_tile": F.floor(F.col("_w.y") / tile).cast("int"), "px": F.pmod(F.floor("_w.x"), F.lit(tile)).cast("int"), "py": F.pmod(F.floor("_w.y"), F.lit(tile)).cast("int")}).drop("_w")


def resample_tiles(tiles: DataFrame, grid: DataFrame, zoom: int, step: float, tile: int = 256, least_weight: float = 0.5) -> DataFrame:
    """(z, x, y, py, px, value): the pixels of tiles (x, y), bilinear in a metre grid (row, col, value) where the cells
    that are there weigh more than least_weight."""
    count = F.sequence(F.lit(0), F.lit(tile - 1))
    px = tiles.select("x", "y", F.explode(count).alias("px")).select("*", F.explode(count).alias("py"))
    at = G.tile_pixel_lonlat(zoom, F.col("x"), F.col("y"), F.col("px"), F.col("py"), tile)
    px = px.withColumn("_l", at).withColumn("_u", G.lonlat_to_utm(F.col("_l.lon"), F.col("_l.lat")))
    u, v = F.col("_u.x") / step - 0.5, F.col("_u.y") / step - 0.5
    corners = F.array(*[F.struct((F.floor(v) + i).cast("int").alias("row"), (F.floor(u) + j).cast("int").alias("col"), (((v - F.floor(v)) if i else (1 - v + F.floor(v))) * ((u - F.floor(u)) if j else (1 - u + F.floor(u)))).alias("w")) for i in (0, 1) for j in (0, 1)])
    met = px.select("x", "y", "py", "px", F.explode(corners).alias("c")).select("x", "y", "py", "px", "c.*").join(grid.where("value is not null"), ["row", "col"])
    sums = met.groupBy("x", "y", "py", "px").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum("w").alias("w")).where(F.col("w") > least_weight)
    return sums.select(F.lit(zoom).alias("z"), "x", "y", "py", "px", (F.col("s") / F.col("w")).alias("value"))


def halve(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """The next lower zoom: means of 2 x 2 pixels, nulls left out."""
    wx, wy = F.col("x") * tile + F.col("px"), F.col("y") * tile + F.col("py")
    half = lambda c: F.floor(c / 2).cast("int")
    up = pixels.groupBy((F.col("z") - 1).alias("z"), half(wx).alias("_x"), half(wy).alias("_y")).agg(L.exact_mean(F.col("value")).alias("value"))
    return up.select("z", F.floor(F.col("_x") / tile).cast("int").alias("x"), F.floor(F.col("_y") / tile).cast("int").alias("y"), F.pmod(F.col("_y"), F.lit(tile)).alias("py"), F.pmod(F.col("_x"), F.lit(tile)).alias("px"), "value")


def build_pyramid(pixels: DataFrame, lowest: int, highest: int, tile: int = 256) -> DataFrame:
    """All zooms from highest, which pixels are of, to lowest."""
    out = level = pixels
    for _ in range(highest - lowest):
        level = halve(level, tile)
        out = out.unionByName(level)
    return out


def pack_tiles(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """(z, x, y, values): one array per tile, null where there is no value."""
    held = pixels.groupBy("z", "x", "y").agg(F.map_from_entries(F.collect_list(F.struct((F.col("py") * tile + F.col("px")).alias("k"), "value"))).alias("m"))
    return held.select("z", "x", "y", F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), lambda i: F.col("m")[i]).alias("values"))


def pad_edges(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """One pixel more around what has values: the mean of the neighbours that have."""
    wx, wy = F.col("x") * tile + F.col("px"), F.col("y") * tile + F.col("py")
    world = pixels.where("value is not null").select("z", wx.alias("wx"), wy.alias("wy"), "value")
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    border = world.select("z", "wx", "wy", "value", F.explode(offsets).alias("o")).groupBy("z", (F.col("wx") + F.col("o.i")).alias("wx"), (F.col("wy") + F.col("o.j")).alias("wy")).agg(F.avg("value").alias("value"))
    out = world.unionByName(border.join(world.select("z", "wx", "wy"), ["z", "wx", "wy"], "left_anti"))
    return out.select("z", F.floor(F.col("wx") / tile).cast("int").alias("x"), F.floor(F.col("wy") / tile).cast("int").alias("y"), F.pmod(F.col("wy"), F.lit(tile)).cast("int").alias("py"), F.pmod(F.col("wx"), F.lit(tile)).cast("int").alias("px"), "value")


def refresh_field(cells: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, kept) of cells (cell_e, cell_n, signature) against cached ones; only changed ones are computed."""
    keys = ["cell_e", "cell_n", "signature"]
    return cells.join(cache.select(*keys), keys, "left_anti"), cache.join(cells.select(*keys), keys, "left_semi")


def cell_signature(rows: DataFrame, version: str, cols: list[str]) -> DataFrame:
    """(cell_e, cell_n, signature): a hash of all rows that a cell and its neighbours hold, and of a version."""
    own = rows.groupBy("cell_e", "cell_n").agg(F.sum(F.xxhash64(*cols).cast("decimal(20,0)")).alias("h"), F.count("*").alias("n"))
    near = S.with_neighbours(own).groupBy(F.col("home_e").alias("cell_e"), F.col("home_n").alias("cell_n")).agg(F.sum(F.xxhash64("cell_e", "cell_n", "h", "n").cast("decimal(20,0)")).alias("h"))
    return near.select("cell_e", "cell_n", F.sha2(F.concat_ws("|", F.lit(version), F.col("h").cast("string")), 256).alias("signature"))


def box_share(grid: DataFrame, mask: Column, reach: int) -> DataFrame:
    """(row, col, share): the share of masked cells in the box of reach cells around each cell, sums along rows, then
    columns."""
    rows = grid.select("row", "col", mask.cast("double").alias("m"), F.lit(1.0).alias("n"))
    offsets = F.array(*[F.lit(k) for k in range(-reach, reach + 1)])
    for axis, other in (("col", "row"), ("row", "col")):
        moved = rows.select(other, axis, "m", "n", F.explode(offsets).alias("o")).select(other, (F.col(axis) + F.col("o")).alias(axis), "m", "n")
        rows = moved.groupBy(other, axis).agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    return grid.select("row", "col").join(rows.select("row", "col", (F.col("m") / F.col("n")).alias("share")), ["row", "col"])


def check_halos(ring: DataFrame, grid: DataFrame, step: float, reach: int = 5, least: float = 0.75, key: str = "pk") -> DataFrame:
    """Ring points that read nothing though at least 75 % of the cells around have a value."""
    at = ring.select(key, F.floor(F.col("y") / step).cast("int").alias("row"), F.floor(F.col("x") / step).cast("int").alias("col"))
    share = box_share(grid, F.col("value").isNotNull(), reach)
    met = at.join(grid, ["row", "col"], "left").join(share, ["row", "col"], "left")
    return met.where(F.col("value").isNull() & (F.col("share") >= least)).select(key, "share")
