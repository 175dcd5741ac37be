"""Stored surfaces, releases and streams that are kept up to date."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noisegrid.operators import field, stored
from noisegrid.streaming import release, stateful


def files(path):
    """Data files by partition, with the times they were written."""
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def written(before, after):
    return {str(Path(f).parent) for f in after.items() ^ before.items() for f in [f[0]]}


def points_of(spark, rows):
    return spark.createDataFrame([(k, float(x), float(y), float(v)) for k, (x, y, v) in enumerate(rows)], "pk long, x double, y double, laeq double")


def values(df):
    return {tuple(r[:-1]): round(r[-1], 6) for r in df.collect()}


def test_refresh_writes_only_what_a_change_reaches(spark, tmp_path):
    """Equal to a full rebuild after levels, points and a whole cell change; only the partitions in reach are written."""
    rnd = random.Random(2)
    rows = [(352000 + rnd.randrange(5000), 3784000 + rnd.randrange(5000), rnd.randrange(400, 800) / 10) for _ in range(600)]
    blurred = lambda p: field.gaussian_surface(field.bin_points(p, 100.0), 100.0, 90.0, 300.0)
    args = (blurred, 1000.0, 100.0, "v1", ["pk", "laeq"])
    tiling = stored.web_tiling(14, 1000.0, 100.0, 32)
    kept, tiles, fresh = str(tmp_path / "s"), str(tmp_path / "p"), (str(tmp_path / "fs"), str(tmp_path / "fp"))

    def refresh(points, surface, pyramid):
        dirty = stored.refresh_surface(points, surface, *args)
        return dirty, None if dirty.isEmpty() else stored.refresh_pyramid(dirty, surface, pyramid, tiling, 12, 32)

    refresh(points_of(spark, rows), kept, tiles)
    kept_rows = [r for r in rows if r[0] < 356000 or r[1] < 3788000]
    now = [(x, y, v + 5) if (x, y) == kept_rows[7][:2] else (x, y, v) for x, y, v in kept_rows]
    points = points_of(spark, rows).join(points_of(spark, now).drop("pk", "laeq"), ["x", "y"], "left_semi").withColumn("laeq", F.when((F.col("x") == kept_rows[7][0]) & (F.col("y") == kept_rows[7][1]), F.col("laeq") + 5).otherwise(F.col("laeq")))
    before = files(kept), files(tiles)
    dirty, touched = refresh(points, kept, tiles)
    refresh(points, *fresh)
    assert values(stored.read_surface(spark, kept).select("row", "col", "value")) == values(stored.read_surface(spark, fresh[0]).select("row", "col", "value"))
    assert values(stored.read_pyramid(spark, tiles)) == values(stored.read_pyramid(spark, fresh[1]))
    assert written(before[0], files(kept)) == {f"cell_e={r.cell_e}/cell_n={r.cell_n}" for r in dirty.collect()}
    assert written(before[1], files(tiles)) == {f"z={r.z}/x={r.x}/y={r.y}" for r in touched.collect()}
    assert 9 < dirty.count() < len(before[0]) - 10
    before = files(kept), files(tiles)
    assert refresh(points, kept, tiles)[0].isEmpty() and (files(kept), files(tiles)) == before
    cells = points.withColumns({"cell_e": F.floor(F.col("x") / 1000).cast("int"), "cell_n": F.floor(F.col("y") / 1000).cast("int")})
    marks = spark.read.parquet(kept).where("signature is not null")
    again = stored.dirty_cells(field.cell_signature(cells, "v2", ["pk", "laeq"]), marks)
    assert again.count() == marks.where("signature <> ''").count() and marks.where("signature = ''").count() > 0


def test_a_refresh_that_broke_off_is_taken_up(spark, tmp_path):
    """Cells whose write failed keep their old mark, so the next refresh computes them."""
    rows = [(352000 + 37 * k % 4000, 3784000 + 91 * k % 4000, 50.0 + k % 7) for k in range(300)]
    means = lambda p: p.groupBy(F.floor(F.col("y") / 50).alias("row"), F.floor(F.col("x") / 50).alias("col")).agg(F.avg("laeq").alias("value"))
    path = str(tmp_path / "s")
    stored.refresh_surface(points_of(spark, rows), path, means, 1000.0, 50.0, "v1", ["pk", "laeq"])
    before, now = files(path), points_of(spark, [(x, y, v + 1) for x, y, v in rows])

    def broken(p):
        return means(p).withColumn("value", F.raise_error("lost").cast("double"))

    with pytest.raises(Exception, match="lost"):
        stored.refresh_surface(now, path, broken, 1000.0, 50.0, "v1", ["pk", "laeq"])
    assert files(path) == before
    stored.refresh_surface(now, path, means, 1000.0, 50.0, "v1", ["pk", "laeq"])
    assert values(stored.read_surface(spark, path).select("row", "col", "value")) == values(means(now))


# Releases


TILES = "tile_id string, rank int, ended int, level double"


def released(spark, target):
    return {(r.tile_id, r.rank, r.ended, r.level) for r in release.read_release(spark, target).collect()}


def test_release_keeps_the_newest_run_of_a_tile(spark, tmp_path):
    """Files in any order of batches give, by tile, the rows of the best run, as if all runs were there at once."""
    rnd = random.Random(4)
    runs = [(f"t{k}", rnd.randrange(3), e, float(i)) for i, (k, e) in enumerate((rnd.randrange(6), rnd.randrange(40)) for _ in range(40))]
    runs = list({r[:3]: r for r in runs}.values())
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    want = {}
    for k in range(0, len(runs), 12):
        part = runs[k : k + 12]
        spark.createDataFrame([r for r in part for _ in range(2)], TILES).coalesce(1).write.mode("append").parquet(src)
        query = release.stream_release(spark, src, TILES, out, ck, lambda b: b, lambda b: b.where("level < 0"), 1)
        assert query.awaitTermination(90) and query.exception() is None
        for r in part:
            want[r[0]] = max(want.get(r[0], r), r, key=lambda x: x[1:3])
        assert released(spark, out) == set(want.values())
        assert release.read_release(spark, out).count() == 2 * len(want)
    assert release.read_manifest(spark, out).count() == len(want)


def test_a_release_that_fails_changes_nothing_for_readers(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = lambda *rows: spark.createDataFrame(list(rows), TILES)
    same, fine = (lambda b: b), (lambda b: b.where("level < 0"))
    with pytest.raises(ValueError, match="no release"):
        release.read_release(spark, out)
    release.publish(batch(("a", 1, 5, 1.0), ("b", 1, 5, 2.0)), 0, out, same, fine)
    first = released(spark, out)
    with pytest.raises(ValueError, match="not published"):
        release.publish(batch(("a", 2, 6, -3.0)), 1, out, same, fine)
    assert released(spark, out) == first
    # broken off after the data, and after the manifest, but before the switch
    with pytest.raises(Exception, match="lost"):
        release.publish(batch(("a", 2, 6, 3.0)), 1, out, lambda b: b.withColumn("level", F.raise_error("lost").cast("double")), lambda b: b.limit(0))
    release.stage(batch(("a", 2, 6, 3.0), ("c", 1, 1, 4.0)), 1, out, same, fine)
    assert released(spark, out) == first and release.newest_version(spark, out) == 0
    # the batch comes again, whole
    release.publish(batch(("a", 2, 6, 3.0), ("c", 1, 1, 4.0)), 1, out, same, fine)
    second = {("a", 2, 6, 3.0), ("b", 1, 5, 2.0), ("c", 1, 1, 4.0)}
    assert released(spark, out) == second
    # a repeated batch and an older run change nothing
    release.publish(batch(("a", 9, 9, 9.0)), 1, out, same, fine)
    release.publish(batch(("a", 1, 99, 7.0), ("b", 1, 5, 8.0)), 2, out, same, fine)
    assert released(spark, out) == second
    release.publish(batch(("a", 3, 1, 5.0), ("b", 3, 1, 5.0), ("c", 3, 1, 5.0)), 3, out, same, fine)
    assert {r.batch for r in release.unused_batches(spark, out).collect()} == {0, 1}  # 2 had no winner


# Streams


def drain(frame, at, name):
    query = frame.writeStream.outputMode("append").format("parquet").option("path", str(at / name)).option("checkpointLocation", str(at / f"{name}-ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(180) and query.exception() is None
    return frame.sparkSession.read.schema(frame.schema).parquet(str(at / name)).collect()


def arriving(spark, folder, schema, batches, ts):
    """A stream whose batches are the given rows; ts comes from the column named."""
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros((F.col(ts) * 1e6).cast("long"))).coalesce(1).write.mode("append").parquet(folder)
    frame = spark.createDataFrame([], schema).withColumn("ts", F.timestamp_micros((F.col(ts) * 1e6).cast("long")))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_paths_of_points_in_any_order(spark, tmp_path):
    """Orders shuffled within the watermark give the paths of all points at once; state ends empty."""
    rnd = random.Random(9)
    points = []
    for ident in ("a", "b", "c"):
        t = rnd.randrange(100)
        for _ in range(40):
            t += rnd.choice([10, 40, 90, 91, 200])
            points.append((ident, float(t)))
    end = max(t for _, t in points) + 2000
    want = []
    for ident in ("a", "b", "c"):
        times = sorted(t for i, t in points if i == ident)
        cuts = [0, *[k for k in range(1, len(times)) if times[k] - times[k - 1] > 90], len(times)]
        want += [(ident, times[p], times[q - 1], q - p) for p, q in zip(cuts, cuts[1:])]
    for seed in (1, 2):
        order = sorted(points, key=lambda p: p[1] + random.Random(f"{seed}{p}").uniform(0, 300))
        size = 17 + 20 * seed
        batches = [order[k : k + size] for k in range(0, len(order), size)] + [[("z", end)], [("z", end + 1)]]
        live = arriving(spark, str(tmp_path / f"p{seed}"), "ident string, epoch double", batches, "epoch")
        got = drain(stateful.stream_paths(live, 90.0, "400 seconds"), tmp_path, f"paths{seed}")
        assert sorted(tuple(r) for r in got if r.ident != "z") == sorted(want)
        state = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / f"paths{seed}-ck"))
        assert {r.key.ident for r in state.collect()} <= {"z"}


def test_levels_and_what_they_leave_out(spark, tmp_path):
    """Each event is in a level or left out, whatever the order; levels are those of the events not left out."""
    rnd = random.Random(10)
    events = [(f"e{k}", rnd.choice("st"), float(rnd.randrange(6 * 3600)), 50.0 + rnd.randrange(30)) for k in range(120)]
    for seed, spread in ((1, 0), (2, 9000)):
        order = sorted(events, key=lambda e: e[2] + random.Random(f"{seed}{e}").uniform(0, spread))
        batches = [order[k : k + 30] + order[k : k + 2] for k in range(0, 120, 30)] + [[(f"end{s}", s, 90_000.0, 10.0) for s in "st"]]
        live = arriving(spark, str(tmp_path / f"e{seed}"), "event_id string, site string, t double, sel double", batches, "t")
        got = drain(stateful.stream_levels(live, 3600.0, 600.0), tmp_path, f"levels{seed}")
        late = {r.event_id for r in got if r.kind == "late"}
        counted = sum(r.n for r in got if r.kind == "level")
        assert counted + len(late) == 120 and bool(late) == (seed == 2)
        want = {}
        for event, site, t, sel in events:
            if event not in late:
                want.setdefault((site, t // 3600 * 3600), []).append(10 ** (sel / 10))
        levels = {(r.site, r.start): (r.laeq, r.n) for r in got if r.kind == "level"}
        assert {k: n for k, (_, n) in levels.items()} == {k: len(v) for k, v in want.items()}
        for key, energies in want.items():
            assert levels[key][0] == pytest.approx(10 * math.log10(sum(energies) / 3600))
