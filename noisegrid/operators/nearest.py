"""Nearest and k nearest without a limit on distance, in one chain of joins.

Items are counted once in small cells, and the counts summed up into cells of twice the size, again and again. For each
cell of points, the finest level at which it and the cells around it hold k items bounds how far the k-th nearest can
be; runs of cells with few items (leaves) that lie farther than that are left out, then those farther than the bound
that the remaining leaves' own counts give. What is left are candidates of a cell of points. Such a cell is split in
four again and again, and a part keeps the candidates that can be among the k nearest of any point in it, by their
distance from its middle, until few candidates or few points are left; so a point meets about as many items however
dense they stand. Where a distance can be computed over arrays, only cells of very many candidates are split by Spark,
the others while they are looked over. Empty ground costs nothing, of items in one place only the k least are taken,
points of one place are one, and where most places stand in one cell, they are dealt out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noisegrid.functions import geometry as G
from noisegrid.operators.small import dealt
from noisegrid.shared import new_path

LEVELS = 24
SPLITS = 6
#: Candidates of a cell that are looked over at once, and rows that a Python worker holds together, about.
AT_ONCE, TOGETHER = 4096, 50_000


def _cell(c: str, base: float) -> Column:
    return F.floor(F.col(c) / base).cast("long")


def _up(c: str, level: Column | str) -> Column:
    return F.call_function("shiftright", F.col(c), F.col(level).cast("int") if isinstance(level, str) else level)


def _around(df: DataFrame) -> DataFrame:
    """Rows repeated for the 3 x 3 cells around (ce, cn)."""
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return df.withColumn("_o", near).withColumns({"ce": F.col("ce") + F.col("_o.i"), "cn": F.col("cn") + F.col("_o.j")}).drop("_o")


def _levels(df: DataFrame, first: Column | int = 0) -> DataFrame:
    """Rows repeated for the levels from `first` on, with (ce, cn) of each."""
    start = F.lit(first) if isinstance(first, int) else first
    rows = df.where(start <= LEVELS).withColumn("level", F.explode(F.sequence(start, F.lit(LEVELS))))
    return rows.withColumns({"ce": _up("ce0", "level"), "cn": _up("cn0", "level")})


def leaves(items: DataFrame, base: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(counts, leaves): items by level and cell (level, ce, cn, n), and for each small cell with items (ce0, cn0) the
    largest cell around it that holds at most `most` (leaf, le, ln, count)."""
    small = items.groupBy("ce0", "cn0").agg(F.count("*").alias("n"))
    counts = _levels(small).groupBy("level", "ce", "cn").agg(F.sum("n").alias("n"))
    fits = _levels(small.select("ce0", "cn0")).join(counts.hint("merge"), ["level", "ce", "cn"]).where((F.col("n") <= most) | (F.col("level") == 0))
    best = F.max(F.struct("level", "ce", "cn", "n"))
    return counts, fits.groupBy("ce0", "cn0").agg(best.alias("b")).select("ce0", "cn0", F.col("b.level").alias("leaf"), F.col("b.ce").alias("le"), F.col("b.cn").alias("ln"), F.col("b.n").alias("count"))


def _gap(a: Column, b: Column, size_a: Column, size_b: Column, far: bool) -> Column:
    """Between two intervals [a, a + size_a], [b, b + size_b]: the least, or the greatest distance."""
    if far:
        return F.greatest(a + size_a - b, b + size_b - a)
    return F.greatest(F.lit(0.0), a - b - size_b, b - a - size_a)


def _base(items: DataFrame) -> float:
    """64 m, halved until a cell with items holds about 64 of them."""
    n, cells = items.agg(F.count("*"), F.approx_count_distinct(F.struct(_cell("ix", 64.0), _cell("iy", 64.0)))).first()
    return 64.0 / 2 ** max(0, math.ceil(math.log(max(n, 1) / max(cells, 1) / 64, 4)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, so that a plan ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _start(cells: DataFrame, items: DataFrame, k: int, slack: float, base: float, most: int, limit: float | None) -> DataFrame:
    """(ce0, cn0, leaf, le, ln) and the items' columns: what can be among the k nearest of any point of the cells."""
    items = items.withColumns({"_e": _cell("ix", base), "_n": _cell("iy", base)})
    counts, of_cell = (stored(df, n) for df, n in zip(leaves(items.select(F.col("_e").alias("ce0"), F.col("_n").alias("cn0")), base, most), ("counts", "leaves"), strict=True))
    # how far the k-th nearest can be from a cell of points
    block = _around(counts).groupBy("level", "ce", "cn").agg(F.sum("n").alias("n"))
    enough = _levels(cells).join(block.hint("merge"), ["level", "ce", "cn"]).where(F.col("n") >= k)
    bound = cells.join(enough.groupBy("ce0", "cn0").agg(F.min("level").alias("reach")).hint("merge"), ["ce0", "cn0"], "left")
    bound = stored(bound.withColumn("reach", F.coalesce("reach", F.lit(LEVELS))), "reaches")
    leaf = of_cell.select("leaf", "le", "ln", "count").distinct()
    # leaves below two levels over the reach are met there, larger ones at their own level
    wide = F.least(F.col("reach") + 2, F.lit(LEVELS))
    here = _around(bound.withColumn("level", wide).withColumns({"ce": _up("ce0", "level"), "cn": _up("cn0", "level")}))
    small = leaf.withColumn("level", F.explode(F.sequence("leaf", F.lit(LEVELS)))).withColumns({"ce": F.call_function("shiftright", "le", (F.col("level") - F.col("leaf")).cast("int")), "cn": F.call_function("shiftright", "ln", (F.col("level") - F.col("leaf")).cast("int"))})
    over = _around(_levels(bound, wide + 1))
    large = leaf.withColumns({"level": F.col("leaf"), "ce": F.col("le"), "cn": F.col("ln")})
    pairs = here.join(small.hint("merge"), ["level", "ce", "cn"]).unionByName(over.join(large.hint("merge"), ["level", "ce", "cn"])).drop("level", "ce", "cn")
    own, side = F.lit(base), F.lit(base) * F.pow(F.lit(2.0), F.col("leaf"))
    across = lambda far: F.hypot(_gap(F.col("ce0") * own, F.col("le") * side, own, side, far), _gap(F.col("cn0") * own, F.col("ln") * side, own, side, far))
    most_m = 2 * math.sqrt(2) * base * F.pow(F.lit(2.0), F.col("reach")) + slack
    pairs = pairs.withColumns({"_least": across(False), "_most": across(True)}).where((F.col("_least") - slack <= most_m) | (F.col("reach") == LEVELS))
    if limit is not None:
        pairs = pairs.where(F.col("_least") - slack <= limit)
    so_far = F.sum("count").over(W.partitionBy("ce0", "cn0").orderBy("_most", "leaf", "le", "ln"))
    pairs = pairs.withColumn("_sum", so_far).withColumn("_bound", F.min(F.when(F.col("_sum") >= k, F.col("_most"))).over(W.partitionBy("ce0", "cn0")))
    pairs = stored(pairs.where(F.col("_bound").isNull() | (F.col("_least") - slack <= F.col("_bound"))).select("ce0", "cn0", "leaf", "le", "ln"), "pairs")
    rows = items.join(of_cell.select(F.col("ce0").alias("_e"), F.col("cn0").alias("_n"), "leaf", "le", "ln").hint("merge"), ["_e", "_n"]).drop("_e", "_n")
    return pairs.join(rows.hint("merge"), ["leaf", "le", "ln"]).drop("leaf", "le", "ln")


def _narrowed(rows: DataFrame, size: float, k: int, distance: Column, most: int, few: int, limit: float | None) -> DataFrame:
    """Candidates of cells (ce, cn) without those that are none of the k nearest of any point there; `_open` is 0 where a
    cell has few left, or few points, else 1."""
    cell = W.partitionBy("ce", "cn")
    middle = {"x": (F.col("ce") + 0.5) * size, "y": (F.col("cn") + 0.5) * size}
    half = size * math.sqrt(0.5) * (1 + 1e-9) + 1e-6
    rows = rows.withColumns(middle).withColumn("_d", distance).drop("x", "y")
    kth = F.nth_value("_d", k).over(cell.orderBy("_d").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("_kth", kth).where(F.col("_kth").isNull() | (F.col("_d") <= F.col("_kth") + 2 * half))
    if limit is not None:
        rows = rows.where(F.col("_d") - half <= limit)
    enough = (F.count("*").over(cell) <= most) | (F.col("_points") <= few)
    return rows.withColumn("_open", F.when(enough, 0).otherwise(1)).drop("_d", "_kth")


def _look(x: np.ndarray, y: np.ndarray, shape: list[np.ndarray], k: int, away: Callable[..., np.ndarray], depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, distances) of the k nearest items of places, n x k; ties to the least number. Places are split in four
    while there are many pairs, and a part keeps the items that can be among the k nearest of any place in it."""
    n, size = len(x), len(shape[0])
    k = min(k, size)
    if n * size > 1 << 16 and n > 4 and size > max(16, 2 * k) and depth < 40:
        x1, x2, y1, y2 = x.min(), x.max(), y.min(), y.max()
        mx, my = (x1 + x2) / 2, (y1 + y2) / 2
        half = math.hypot(x2 - x1, y2 - y1) / 2 * (1 + 1e-9) + 1e-6
        far = away(mx, my, *shape)
        some = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1] + 2 * half)
        shape, part = [v[some] for v in shape], (x > mx) * 2 + (y > my)
        found, distances = np.empty((n, k), dtype=np.int64), np.empty((n, k))
        for own in (np.flatnonzero(part == p) for p in range(4)):
            if len(own):
                at, distances[own] = _look(x[own], y[own], shape, k, away, depth + 1)
                found[own] = some[at]
        return found, distances
    step, out = max(1, (1 << 16) // size), []
    for i in range(0, n, step):
        far = away(x[i : i + step, None], y[i : i + step, None], *[v[None, :] for v in shape])
        at = far.argmin(axis=1)[:, None] if k == 1 else far.argsort(axis=1, kind="stable")[:, :k]
        out.append((at, np.take_along_axis(far, at, axis=1)))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _looker(item: str, shape: list[str], k: int, away: Callable[..., np.ndarray], limit: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function from places and candidates of some cells to (x, y, item, distance, rank)."""
    cell = ["split", "ce", "cn", "_hand"]

    def cells(table: pa.Table) -> dict[tuple[int, ...], slice]:
        at = np.stack([table[c].to_numpy() for c in cell], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)])) if len(at) else np.empty(0, dtype=np.int64)
        return {tuple(at[i]): slice(i, j) for i, j in itertools.pairwise([*starts, len(at)])}

    def run(places: pa.Table, items: pa.Table) -> pa.Table:
        places, items = (t.sort_by([(c, "ascending") for c in by]).combine_chunks() for t, by in ((places, cell), (items, [*cell, item])))
        x, y, columns = places["x"].to_numpy(), places["y"].to_numpy(), [items[c].to_numpy() for c in shape]
        met, parts = cells(items), []
        for c, own in cells(places).items():
            if c in met:
                at, far = _look(x[own], y[own], [v[met[c]] for v in columns], k, away)
                rank = np.broadcast_to(np.arange(1, at.shape[1] + 1, dtype=np.int32), at.shape)
                some = np.ones(at.shape, dtype=bool) if limit is None else far <= limit
                of = np.broadcast_to(np.arange(own.start, own.stop)[:, None], at.shape)
                parts.append((of[some], met[c].start + at[some], far[some], rank[some]))
        of, at, far, rank = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, dtype=t) for i, t in enumerate(("int64", "int64", "float64", "int32")))
        return pa.table({"x": x[of], "y": y[of], item: items[item].take(pa.array(at)), "distance": far, "rank": rank})

    return run


def k_nearest(points: DataFrame, items: DataFrame, k: int, distance: Callable[..., Column], key: str = "pk", item: str = "item", slack: float = 0.0, base: float | None = None, most: int | None = None, crowd: int = 4096, limit: float | None = None, shape: list[str] | None = None, away: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """(key, item, distance, rank): the k nearest items of each point, ties to the least item; with `limit` those so far.

    Points are (key, x, y); items (item, ix, iy, ...), where no part of an item is farther than `slack` from (ix, iy), and
    an item may have several rows if k is 1. `distance` is that of a point and an item's row. With `shape`, the columns of
    an item that matter, alike in all its rows, `away` gives the same distance from arrays x, y and those columns, and
    candidates are looked over there instead of as pairs. Where there are fewer than k items all are given; points without
    coordinates, and all points if there are no items, are absent. Points of one place are looked around once. Steps are
    written to the shared folder, so that no plan grows with their number.
    """
    most = most or max(16, 2 * k)
    items = stored(items, "items")
    base = base or _base(items)
    fine, spark = base / 2**SPLITS, points.sparkSession
    points = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    places = stored(points.select("x", "y").distinct().withColumns({"_fe": _cell("x", fine), "_fn": _cell("y", fine)}), "places")
    # cells that hold places, of all sizes, once
    found = stored(places.groupBy("_fe", "_fn").agg(F.count("*").alias("_points")), "cells")
    up = lambda c, split: F.call_function("shiftright", F.col(c), (F.lit(SPLITS) - split).cast("int"))
    held = lambda split: found.groupBy(up("_fe", F.lit(split)).alias("ce"), up("_fn", F.lit(split)).alias("cn")).agg(F.sum("_points").alias("_points"))
    # as often as the fullest cell needs
    fullest = held(0).agg(F.max("_points")).first()[0] or 1
    splits = min(SPLITS, max(0, math.ceil(math.log(fullest / 4, 4))))
    rows = _start(held(0).select(F.col("ce").alias("ce0"), F.col("cn").alias("cn0")), items, k, slack, base, most, limit)
    columns = [item, *shape] if shape else items.columns
    rows = rows.select(F.col("ce0").alias("ce"), F.col("cn0").alias("cn"), *columns)
    rows = rows.distinct() if shape and slack else rows
    root, last = new_path(spark, "candidates"), 0
    while True:
        rows = _narrowed(rows.join(held(last).hint("merge"), ["ce", "cn"]), base / 2**last, k, distance(), AT_ONCE if shape else most, 4, limit)
        rows.write.partitionBy("_open").parquet(f"{root}/split={last}")
        kept = spark.read.schema(f"{rows.drop('_open')._jdf.schema().toDDL()}, split int, _open int").parquet(root)
        rows = kept.where((F.col("split") == last) & (F.col("_open") == 1)).drop("split", "_open", "_points")
        if last == splits or rows.isEmpty():
            break
        last += 1
        parts = F.array(*[F.struct((F.col("ce") * 2 + i).alias("ce"), (F.col("cn") * 2 + j).alias("cn")) for i in (0, 1) for j in (0, 1)])
        rows = rows.withColumn("_c", F.explode(parts)).withColumns({n: F.col(f"_c.{n}") for n in ("ce", "cn")}).drop("_c")
    rows = kept.where((F.col("_open") == 0) | (F.col("split") == last)).drop("_open")
    # places of a crowded cell are dealt out
    hands = F.ceil(F.col("_points") / F.lit(crowd)).cast("long")
    of_cell = stored(rows.groupBy("split", "ce", "cn").agg(F.count("*").alias("_n"), F.max(hands).alias("_hands")), "cells")
    given = places.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(last))))
    given = given.withColumns({"ce": up("_fe", F.col("split")), "cn": up("_fn", F.col("split"))}).drop("_fe", "_fn")
    given = given.join(of_cell.drop("_n").hint("merge"), ["split", "ce", "cn"]).withColumn("_hand", F.pmod(F.xxhash64("x", "y"), F.col("_hands"))).drop("_hands")
    each = F.explode(F.sequence(F.lit(0).cast("long"), hands - 1))
    if shape:
        total = of_cell.agg(F.sum(F.col("_n") * F.col("_hands"))).first()[0] or 0
        bundle = F.pmod(F.xxhash64("split", "ce", "cn", "_hand"), F.lit(math.ceil((total + places.count()) / TOGETHER) or 1))
        left, right = (dealt(df.withColumn("_b", bundle), "_b").groupBy("_b") for df in (given, rows.withColumn("_hand", each).drop("_points")))
        schema = f"x double, y double, {items.select(item)._jdf.schema().toDDL()}, distance double, rank int"
        best = left.cogroup(right).applyInArrow(_looker(item, shape, k, away, limit), schema)
    else:
        sets = rows.groupBy("split", "ce", "cn").agg(F.max("_points").alias("_points"), F.collect_list(F.struct(*columns)).alias("_items"))
        met = given.join(sets.withColumn("_hand", each).drop("_points").hint("merge"), ["split", "ce", "cn", "_hand"])
        met = met.withColumn("_i", F.explode("_items")).select("x", "y", "_i.*").select("x", "y", item, distance().alias("distance"))
        met = met if limit is None else met.where(F.col("distance") <= limit)
        best = met.groupBy("x", "y", item).agg(F.min("distance").alias("distance"))
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("x", "y").orderBy("distance", item))).where(F.col("rank") <= k)
    return points.join(best.hint("merge"), ["x", "y"]).select(key, item, "distance", "rank")


def nearest_sites(points: DataFrame, sites: DataFrame, k: int, key: str = "pk", site: str = "site_id", limit: float | None = None) -> DataFrame:
    """(key, site, distance, rank): the k nearest sites (site, sx, sy), however far, or up to a limit."""
    items = sites.select(site, F.col("sx").alias("ix"), F.col("sy").alias("iy")).where("ix is not null and iy is not null")
    # of sites in one place only the k least can be given
    items = items.withColumn("_r", F.row_number().over(W.partitionBy("ix", "iy").orderBy(site))).where(F.col("_r") <= k).drop("_r")
    c = F.col
    distance = lambda: F.sqrt(F.pow(c("x") - c("ix"), 2) + F.pow(c("y") - c("iy"), 2))
    away = lambda x, y, ix, iy: np.sqrt((x - ix) ** 2 + (y - iy) ** 2)
    return k_nearest(points.select(key, "x", "y"), items, k, distance, key, site, limit=limit, shape=["ix", "iy"], away=away)


def nearest_segment_any(points: DataFrame, segments: DataFrame, key: str = "pk", seg: str = "seg_id", piece_m: float = 128.0, limit: float | None = None) -> DataFrame:
    """(key, seg, distance): the nearest segment, however far, or up to a limit, ties to the least id. Long segments are
    met by pieces; of segments in one place only the least is."""
    ends = ["ax", "ay", "bx", "by"]
    lines = segments.groupBy(*ends).agg(F.min(seg).alias(seg)).where(" and ".join(f"{c} is not null" for c in ends))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    parts = lines.select(seg, *ends, F.greatest(F.ceil(length / piece_m), F.lit(1)).cast("int").alias("_n"))
    parts = parts.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    middle = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("_i") + 0.5) / F.col("_n")
    items = parts.select(seg, *ends, middle("ax", "bx").alias("ix"), middle("ay", "by").alias("iy"))
    distance = lambda: G.point_segment(*map(F.col, ("x", "y", *ends)))["distance"]
    return k_nearest(points.select(key, "x", "y"), items, 1, distance, key, seg, piece_m / 2 + 1e-6, limit=limit, shape=ends, away=G.far_from_segments).select(key, seg, "distance")
