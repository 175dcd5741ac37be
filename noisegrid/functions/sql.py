"""The functions under SQL names, and a table function for lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: name -> (parameters, type, body in SQL).
FUNCTIONS = {
    "energy_add": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN b IS NULL THEN a ELSE 10D * log10(pow(10D, a / 10D) + pow(10D, b / 10D)) END"),
    "cnel": ("d DOUBLE, e DOUBLE, n DOUBLE", "DOUBLE", "10D * log10((12D * pow(10D, d / 10D) + 3D * pow(10D, (e + 5D) / 10D) + 9D * pow(10D, (n + 10D) / 10D)) / 24D)"),
    "laeq24": ("d DOUBLE, e DOUBLE, n DOUBLE", "DOUBLE", "10D * log10((12D * pow(10D, d / 10D) + 3D * pow(10D, e / 10D) + 9D * pow(10D, n / 10D)) / 24D)"),
    "sel_from_laeq": ("laeq DOUBLE, seconds DOUBLE", "DOUBLE", "CASE WHEN seconds > 0 THEN laeq + 10D * log10(seconds) END"),
    "laeq_from_sel": ("sel DOUBLE, seconds DOUBLE", "DOUBLE", "CASE WHEN seconds > 0 THEN sel - 10D * log10(seconds) END"),
    "level_band": ("level DOUBLE", "INT", "CASE WHEN level IS NOT NULL THEN CAST(least(8, greatest(0, floor((level - 40D) / 5D))) AS INT) END"),
    "haversine_m": ("lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE", "2D * 6371008.8D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2D), 2D) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2D), 2D))))"),
    "daypart": ("ts TIMESTAMP, zone STRING", "STRING", "CASE WHEN hour(from_utc_timestamp(ts, zone)) >= 7 AND hour(from_utc_timestamp(ts, zone)) < 19 THEN 'D' WHEN hour(from_utc_timestamp(ts, zone)) >= 19 AND hour(from_utc_timestamp(ts, zone)) < 22 THEN 'E' WHEN ts IS NOT NULL THEN 'N' END"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the SQL functions and densify_line; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")

    @F.udtf(returnType="station double, x double, y double")
    class DensifyLine:
        """Points every step along a line given as arrays of x and y, its vertices included."""

        def eval(self, xs: list[float], ys: list[float], step: float) -> Iterator[tuple[float, float, float]]:
            at = 0.0
            for k, (x1, y1, x2, y2) in enumerate(zip(xs, ys, xs[1:], ys[1:], strict=False)):
                long = float(np.hypot(x2 - x1, y2 - y1))
                n = max(1, int(np.ceil(long / step)))
                for i in range(0 if k == 0 else 1, n + 1):
                    yield at + i / n * long, x1 + i / n * (x2 - x1), y1 + i / n * (y2 - y1)
                at += long

    spark.udtf.register("densify_line", DensifyLine)
    return [*FUNCTIONS, "densify_line"]


def geodesic_inverse(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """(distance_m, azimuth_deg) on the WGS 84 ellipsoid by Vincenty's iteration, at most 100 rounds, over batches.

    Points for which it doesn't converge (nearly antipodal) give nulls.
    """

    @F.pandas_udf("distance_m double, azimuth_deg double")
    def run(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
        a, f = 6378137.0, 1 / 298.257223563
        b = (1 - f) * a
        u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x.to_numpy(float)))) for x in (lat1, lat2))
        span = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
        lam, moved = span.copy(), np.full(len(span), np.inf)
        with np.errstate(all="ignore"):
            for _ in range(100):
                s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
                c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
                sigma = np.arctan2(s, c)
                sin_a = np.where(s == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(s == 0, 1.0, s))
                cos2_a = 1 - sin_a**2
                mid = np.where(cos2_a == 0, 0.0, c - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2_a == 0, 1.0, cos2_a))
                k = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
                new = span + (1 - k) * f * sin_a * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
                moved, lam = np.abs(new - lam), new
                if np.nanmax(moved, initial=0.0) < 1e-12:
                    break
            e2 = cos2_a * (a**2 - b**2) / b**2
            g = (np.sqrt(1 + e2) - 1) / (np.sqrt(1 + e2) + 1)
            big_a, big_b = (1 + g**2 / 4) / (1 - g), g * (1 - 3 * g**2 / 8)
            d = big_b * s * (mid + big_b / 4 * (c * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
            azimuth = np.degrees(np.arctan2(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))) % 360
            good = moved < 1e-9
        return pd.DataFrame({"distance_m": np.where(good, b * big_a * (sigma - d), np.nan), "azimuth_deg": np.where(good, azimuth, np.nan)}).astype("Float64").where(pd.Series(good), pd.NA) if not good.all() else pd.DataFrame({"distance_m": b * big_a * (sigma - d), "azimuth_deg": azimuth})

    return run(lon1, lat1, lon2, lat2)
