"""Stateful streams: paths stitched from points in any order, and levels beside the very events that they leave out.

State lives in RocksDB; prepare() sets that for a session.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PATHS = "ident string, start double, end double, points long"
LEVELS = "kind string, site string, start double, laeq double, n long, event_id string, epoch double, sel double"


def prepare(spark: SparkSession) -> None:
    """Keep the state of this session's streams in RocksDB, which stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class PathProcessor(StatefulProcessor):
    """Points wait until the watermark has passed them, for an earlier one may still come; then they join the open path
    in order of time. A path ends when a gap shows, or once the watermark is a gap beyond its last point."""

    def __init__(self, gap_s: float):
        self.gap_s = gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start double, end double, n long")
        self.waiting = handle.getListState("waiting", "epoch double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = math.inf
        for chunk in rows:
            times = chunk["epoch"].astype(float)
            self.waiting.appendList([(t,) for t in times])
            first = min(first, times.min())
        self._wake(first, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        times = sorted(t for (t,) in self.waiting.get()) if self.waiting.exists() else []
        ready, left = [t for t in times if t * 1000 <= passed], [t for t in times if t * 1000 > passed]
        start, end, n = self.open.get() if self.open.exists() else (0.0, 0.0, 0)
        done = []
        for t in ready:
            if n and t - end > self.gap_s:
                done.append((key[0], start, end, n))
                n = 0
            start, end, n = (start if n else t), t, n + 1
        if n and (end + self.gap_s) * 1000 <= passed:
            done.append((key[0], start, end, n))
            n = 0
        self.waiting.clear()
        if left:
            self.waiting.put([(t,) for t in left])
        self.open.clear()
        if n:
            self.open.update((start, end, n))
        if left or n:
            self._wake(min([*left[:1], *([end + self.gap_s] if n else [])]), passed)
        return iter([pd.DataFrame(done, columns=["ident", "start", "end", "points"]).astype({"ident": object})] if done else [])

    def _wake(self, at: float, passed: int) -> None:
        self.handle.registerTimer(max(math.ceil(at * 1000), passed + 1))

    def close(self) -> None:
        pass


def stream_paths(points: DataFrame, gap_s: float = 90.0, late: str | None = None) -> DataFrame:
    """Finished paths of live points (ident, ts, epoch in seconds): a gap over gap_s ends a path.

    Points may come in any order within the watermark (`late`, by default as long as the gap); the paths are those of
    path_islands() over all points that came in time. A trace's state is its open path and the points that the watermark
    hasn't passed, and nothing once its last path has ended.
    """
    prepare(points.sparkSession)
    live = points.select("ident", "ts", F.col("epoch").cast("double").alias("epoch")).withWatermark("ts", late or f"{math.ceil(gap_s)} seconds")
    return live.groupBy("ident").transformWithStateInPandas(PathProcessor(gap_s), PATHS, "append", "eventTime")


class LevelProcessor(StatefulProcessor):
    """Energy by window until the site's clock, its newest event less a delay, has passed the window's end. Events of
    windows that are closed come out as they are. A batch's ids are held, most_held at once, and only those of windows
    that stay open go to the state."""

    def __init__(self, window_s: float, delay_s: float, idle_s: float | None, most_held: int = 1_000_000):
        self.window_s, self.delay_s, self.idle_s, self.most_held = window_s, delay_s, idle_s, most_held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "newest double, closed double, alarm long")
        self.windows = handle.getMapState("windows", "start double", "energy double, n long")
        self.ids = handle.getMapState("ids", "start double, event_id string", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, closed, alarm = self.clock.get() if self.clock.exists() else (-math.inf, -math.inf, 0)
        sums = {start: tuple(value) for (start,), value in self.windows.iterator()}
        stored, touched, fresh, held = set(sums), set(), {}, 0  # stored: windows whose ids the state has
        for chunk in rows:
            starts = (chunk["epoch"] // self.window_s) * self.window_s
            late = starts + self.window_s <= closed
            if late.any():
                out = chunk[late]
                yield _rows(kind="late", site=key[0], start=starts[late], event_id=out["event_id"], epoch=out["epoch"], sel=out["sel"])
            for start, event, sel in zip(starts[~late].tolist(), chunk.loc[~late, "event_id"], chunk.loc[~late, "sel"].tolist(), strict=True):
                if event is not None:
                    seen = fresh.setdefault(start, set())
                    if event in seen or (start in stored and self.ids.containsKey((start, event))):
                        continue
                    seen.add(event)
                    held += 1
                energy, n = sums.get(start, (0.0, 0))
                sums[start] = (energy + 10 ** (sel / 10), n + 1)
                touched.add(start)
            newest = max(newest, chunk["epoch"].max())
            if held > self.most_held:
                stored |= self._store(fresh)
                fresh, held = {}, 0
        closed = max(closed, newest - self.delay_s)
        done = {start for start in sums if start + self.window_s <= closed}
        self._forget(done & stored)
        self._store({start: seen for start, seen in fresh.items() if start not in done})
        for start in touched - done:
            self.windows.updateValue((start,), sums[start])
        if done:
            yield self._levels(key[0], sorted((start, *sums[start]) for start in done))
        if self.idle_s is not None:
            alarm = timerValues.getCurrentProcessingTimeInMs() + int(self.idle_s * 1000)
            self.handle.registerTimer(alarm)
        self.clock.update((newest, closed, alarm))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, closed, alarm = self.clock.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= alarm:
            closed = max(closed, (newest // self.window_s + 1) * self.window_s)
            self.clock.update((newest, closed, alarm))
            yield from self._close(key[0], closed)

    def _close(self, site: str, closed: float) -> Iterator[pd.DataFrame]:
        done = sorted((start, *value) for (start,), value in self.windows.iterator() if start + self.window_s <= closed)
        if done:
            self._forget({start for start, _, _ in done})
            yield self._levels(site, done)

    def _store(self, fresh: dict[float, set[str]]) -> set[float]:
        for start, seen in fresh.items():
            for event in seen:
                self.ids.updateValue((start, event), (True,))
        return set(fresh)

    def _forget(self, starts: set[float]) -> None:
        if not starts:
            return
        for start in starts:
            if self.windows.containsKey((start,)):
                self.windows.removeKey((start,))
        for start, event in [k for k in self.ids.keys() if k[0] in starts]:
            self.ids.removeKey((start, event))

    def _levels(self, site: str, done: list[tuple[float, float, int]]) -> pd.DataFrame:
        laeq = [10 * math.log10(energy / self.window_s) for _, energy, _ in done]
        return _rows(kind="level", site=site, start=[s for s, _, _ in done], laeq=laeq, n=[n for _, _, n in done])

    def close(self) -> None:
        pass


def _rows(**columns) -> pd.DataFrame:
    """Rows of LEVELS from what they have; the other columns are null."""
    size = len(columns["start"])
    frame = pd.DataFrame({name: [v] * size if isinstance(v, str) else list(v) for name, v in columns.items()})
    frame = frame.reindex(columns=[c.split()[0] for c in LEVELS.split(", ")])
    return frame.astype({"kind": object, "site": object, "event_id": object, "start": "float64", "laeq": "float64", "n": "Int64", "epoch": "float64", "sel": "float64"})


def stream_levels(events: DataFrame, window_s: float = 3600.0, delay_s: float = 600.0, idle_s: float | None = None) -> DataFrame:
    """Two kinds of rows from SEL events (event_id, site, ts, sel): `level`, the level and number of a site's events in a
    window that has closed, and `late`, each event that came when its window had.

    A window closes once the site's newest event is delay_s beyond its end, after the batch in which that shows; with
    idle_s also after so many seconds without events. Repeats of an id within an open window count once. Every event
    is in a level, late, a repeat, or still in an open window. State is the open windows and their ids.
    """
    prepare(events.sparkSession)
    rows = events.select("site", "event_id", F.unix_micros("ts").cast("double").alias("epoch"), F.col("sel").cast("double").alias("sel")).withColumn("epoch", F.col("epoch") / 1e6)
    mode = "none" if idle_s is None else "processingTime"
    return rows.groupBy("site").transformWithStateInPandas(LevelProcessor(window_s, delay_s, idle_s), LEVELS, "append", mode)


def levels_of(out: DataFrame) -> DataFrame:
    """(site, start, laeq, n) of what stream_levels() gives."""
    return out.where("kind = 'level'").select("site", F.timestamp_micros((F.col("start") * 1e6).cast("long")).alias("start"), "laeq", "n")


def left_out(out: DataFrame) -> DataFrame:
    """(site, event_id, ts, sel) of the events that came too late."""
    return out.where("kind = 'late'").select("site", "event_id", F.timestamp_micros((F.col("epoch") * 1e6).cast("long")).alias("ts"), "sel")
