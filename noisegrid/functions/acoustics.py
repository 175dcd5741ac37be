"""Event acoustics: noise-power-distance levels, segment geometry and the terms of a segment's exposure level.

The formulas are those of ECAC Doc 29, 5th edition, volume 2.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noisegrid.functions.geometry import lerp_sq, once
from noisegrid.operators.small import hinted

FT_PER_S = 270.05
MIN_DISTANCE_M = 30.0
MOST_EXTRAPOLATED_DB = 5.0


def npd_brackets(npd: DataFrame) -> DataFrame:
    """Distance intervals of each power curve: (npd_id, power, lo, hi, level_lo, level_hi, first, last)."""
    w = W.partitionBy("npd_id", "power").orderBy("distance_m")
    nxt = npd.select("npd_id", "power", F.log10("distance_m").alias("lo"), F.lead(F.log10("distance_m")).over(w).alias("hi"), F.col("level_db").alias("level_lo"), F.lead("level_db").over(w).alias("level_hi"), F.row_number().over(w).alias("k"), F.count("*").over(W.partitionBy("npd_id", "power")).alias("n"))
    return nxt.where("hi is not null").select("npd_id", "power", "lo", "hi", "level_lo", "level_hi", (F.col("k") == 1).alias("first"), (F.col("k") == F.col("n") - 1).alias("last"))


def npd_curves(npd: DataFrame) -> DataFrame:
    """(npd_id, curves): each id's power curves in order, each with its distance intervals in order."""
    part = F.struct("lo", "hi", "level_lo", "level_hi")
    each = npd_brackets(npd).groupBy("npd_id", "power").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return each.groupBy("npd_id").agg(F.sort_array(F.collect_list(F.struct("power", "parts"))).alias("curves"))


def with_npd_level(df: DataFrame, npd: DataFrame, level: str = "level_db", status: str = "status", extrapolate_power: bool = False) -> DataFrame:
    """Add the level of rows (npd_id, power, distance_m) from a table (npd_id, power, distance_m, level_db).

    Linear in the log of distance on each power curve (edge intervals go on, 30 m at least), then linear in power.
    status is `ok`, `no_table`, `power_outside`, or `extrapolated_too_far` if power extrapolation moves the level by
    over 5 dB. The curves of an id are one value, broadcast where they are small, so that rows aren't shuffled.
    """
    log_d, at = F.col("_log"), F.col("power")

    def on_curve(k: Column) -> Column:
        last = F.size(k["parts"]) - 1
        p = F.filter(k["parts"], lambda s, i: ((i == 0) | (log_d >= s["lo"])) & ((i == last) | (log_d < s["hi"])))[0]
        return once(p, lambda p: F.struct(k["power"].alias("power"), (p["level_lo"] + (p["level_hi"] - p["level_lo"]) * (log_d - p["lo"]) / (p["hi"] - p["lo"])).alias("level")))

    rows = df.withColumn("_log", F.log10(F.greatest(F.col("distance_m"), F.lit(MIN_DISTANCE_M))))
    rows = rows.join(hinted(npd_curves(npd).withColumnRenamed("curves", "_curves")), "npd_id", "left")
    rows = rows.withColumn("_c", F.transform("_curves", on_curve))
    n = F.coalesce(F.size("_c"), F.lit(0))
    low = F.greatest(F.lit(0), F.least(n - 2, F.size(F.filter("_c", lambda x: x["power"] <= at)) - 1))
    a, z, first, end = F.get("_c", low), F.get("_c", F.least(low + 1, n - 1)), F.get("_c", F.lit(0)), F.get("_c", n - 1)
    part = F.when(z["power"] > a["power"], (at - a["power"]) / (z["power"] - a["power"])).otherwise(0.0)
    value = a["level"] + part * (z["level"] - a["level"])
    under, over = at < first["power"], at > end["power"]
    nearest = F.when(under, first["level"]).otherwise(end["level"])
    known = F.when(n <= 0, "no_table").when((under | over) & F.lit(not extrapolate_power), "power_outside").when((under | over) & (F.abs(value - nearest) > MOST_EXTRAPOLATED_DB), "extrapolated_too_far").otherwise("ok")
    return rows.withColumn("_s", known).withColumn(level, F.when(F.col("_s") == "ok", value)).drop("_curves", "_c", "_log").withColumnRenamed("_s", status)


def npd_level(df: DataFrame, npd: DataFrame, keys: list[str], extrapolate_power: bool = False) -> DataFrame:
    """keys, level_db and status of with_npd_level."""
    return with_npd_level(df, npd, extrapolate_power=extrapolate_power).select(*keys, "level_db", "status")


def segment_geometry(df: DataFrame) -> DataFrame:
    """Add q, length, slant, lateral, beta, phi, speed and power to segments s1, z1, v1, p1 to s2, z2, v2, p2 (metres,
    m/s; p the power) seen from a receiver ox, oy, oz; `operation` is A or D.

    Behind or ahead of a runway segment, distances are to its nearer end.
    """
    c = F.col
    z1, z2 = F.greatest(c("z1"), F.lit(1.0)), F.greatest(c("z2"), F.lit(1.0))
    dx, dz = c("s2") - c("s1"), z2 - z1
    length = F.sqrt(dx * dx + dz * dz)
    df = df.select("*", length.alias("length_m"), (dx / length).alias("_ux"), (dz / length).alias("_uz"), z1.alias("_z1"), z2.alias("_z2"))
    df = df.withColumn("q_m", (c("ox") - c("s1")) * c("_ux") + (c("oz") - c("_z1")) * c("_uz"))
    cx, cz = c("s1") + c("q_m") * c("_ux"), c("_z1") + c("q_m") * c("_uz")
    before, after = c("q_m") < 0, c("q_m") > c("length_m")
    nx = F.when(before, c("s1")).when(after, c("s2")).otherwise(cx)
    nz = F.when(before, c("_z1")).when(after, c("_z2")).otherwise(cz)
    runway = (c("z1") <= 1.0) & (c("z2") <= 1.0)
    to_end = runway & (((c("operation") == "D") & before) | ((c("operation") == "A") & after))
    far = lambda x, z: F.sqrt(F.pow(c("ox") - x, 2) + F.pow(c("oy"), 2) + F.pow(c("oz") - z, 2))
    lateral = F.when(to_end, F.sqrt(F.pow(c("ox") - nx, 2) + F.pow(c("oy"), 2))).otherwise(F.abs(c("oy")))
    height = nz - c("oz")
    flat = F.when(to_end, height).when(before | after, height / F.abs(c("_ux"))).otherwise((cz - c("oz")) / F.abs(c("_ux")))
    part = F.least(F.greatest(c("q_m") / c("length_m"), F.lit(0.0)), F.lit(1.0))
    return df.select(
        "*",
        F.when(to_end, far(nx, nz)).otherwise(far(cx, cz)).alias("slant_m"),
        lateral.alias("lateral_m"),
        F.when(flat <= 0, F.lit(0.0)).otherwise(F.degrees(F.atan2(flat, lateral))).alias("beta_deg"),
        F.greatest(F.lit(0.0), F.degrees(F.atan2((cz - c("oz")) / F.abs(c("_ux")), F.abs(c("oy"))))).alias("phi_deg"),
        F.when(runway, (c("v1") + c("v2")) / 2.0).otherwise(lerp_sq(c("v1"), c("v2"), part)).alias("speed_mps"),
        lerp_sq(c("p1"), c("p2"), part).alias("power"),
    ).drop("_ux", "_uz", "_z1", "_z2")


def impedance_adjustment(temp_c: Column, pressure_mmhg: Column) -> Column:
    ratio = pressure_mmhg / 760.0
    return 10.0 * F.log10(416.86 * ratio / F.sqrt((temp_c + 273.15) / 288.15) / 409.81)


def duration_correction(speed_mps: Column) -> Column:
    """Against the reference speed of 160 kt."""
    return 10.0 * F.log10(F.lit(160.0 * 1852.0 / 3600.0) / speed_mps)


def installation_correction(phi_deg: Column, kind: Column) -> Column:
    """Of wing- or fuselage-mounted jets by depression angle; propellers have none."""
    phi = F.radians(phi_deg)
    form = lambda a, b, c: 10.0 * F.log10(F.pow(a * F.pow(F.cos(phi), 2) + F.pow(F.sin(phi), 2), b) / (c * F.pow(F.sin(2 * phi), 2) + F.pow(F.cos(2 * phi), 2)))
    return F.when(kind == "wing", form(0.00384, 0.0621, 0.8786)).when(kind == "fuselage", form(0.1225, 0.329, 1.0)).otherwise(0.0)


def lateral_attenuation(beta_deg: Column, lateral_m: Column) -> Column:
    near = F.when(lateral_m <= 914.0, 1.089 * (1.0 - F.exp(-0.00274 * lateral_m))).otherwise(1.0)
    return F.when(beta_deg >= 50, 0.0).when((beta_deg >= 0) & (lateral_m >= 0), near * (1.137 - 0.0229 * beta_deg + 9.72 * F.exp(-0.142 * beta_deg)))


def _scaled(sel: Column, lamax: Column) -> Column:
    return 2.0 / math.pi * FT_PER_S * F.pow(F.lit(10.0), (sel - lamax) / 10.0)


def _primitive(x: Column) -> Column:
    return x / (1.0 + x * x) + F.atan(x)


def _tail(low: Column, high: Column) -> Column:
    """Integral of 2 / (1 + t^2)^2 from low to high, both above 10: 12 terms of the series in 1 / t."""

    def term(n: Column) -> Column:
        power = 2 * n + 1
        sign = F.when(n % 2 == 1, 1.0).otherwise(-1.0)
        return sign * 2.0 * n / power * F.pow(low, -power) * -F.expm1(-power * F.log(high / low))

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0.0), lambda acc, n: acc + term(n.cast("double")))


def finite_segment(sel: Column, lamax: Column, q_ft: Column, length_ft: Column) -> Column:
    """Share of the infinite path's energy that a segment gives, in dB, -150 at least."""
    a1, a2 = -q_ft / _scaled(sel, lamax), -(q_ft - length_ft) / _scaled(sel, lamax)
    share = F.when(a1 > 10.0, _tail(a1, a2)).when(a2 < -10.0, _tail(-a2, -a1)).otherwise(_primitive(a2) - _primitive(a1)) / math.pi
    return F.when((length_ft > 0) & (share > 0), F.greatest(F.lit(-150.0), 10.0 * F.log10(share)))


def takeoff_roll(sel: Column, lamax: Column, length_ft: Column) -> Column:
    """As finite_segment for a receiver abeam the start of the take-off roll."""
    share = _primitive(length_ft / _scaled(sel, lamax)) / math.pi
    return F.when(share > 0, 10.0 * F.log10(share))


def start_of_roll(q_ft: Column, lateral_ft: Column, kind: Column) -> Column:
    """Directivity behind the start of roll; 0 ahead of it, null where the formula has no value."""
    far = F.sqrt(q_ft * q_ft + lateral_ft * lateral_ft)
    psi = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q_ft / far))))
    log_term = F.log(math.pi * psi / 180.0)
    jet = 2329.44 - 8.0573 * psi + 11.51 * F.exp(math.pi * psi / 180.0) - 3.4601 * psi / log_term - 17403338.3 * log_term / (psi * psi)
    prop = F.lit(0.0)
    for k, factor in enumerate((-34643.898, 30722162.0, -11491573931.0, 2.34928567e12, -2.83584442e14, 2.02271504e16, -7.90084471e17, 1.30506872e19)):
        prop = prop + F.lit(factor) / F.pow(psi, k)
    ahead = (far <= 0) | (q_ft >= 0)
    value = F.when(kind == "turboprop", prop).otherwise(jet) * F.least(F.lit(1.0), 2500.0 / far)
    return F.when(ahead, 0.0).when((psi >= 90.0) & (psi < 180.0), value)


def segment_sel(baseline: Column, impedance: Column, duration: Column, installation: Column, lateral: Column, finite: Column, blockage: Column) -> Column:
    """Sum of the terms; null if any is unknown."""
    return baseline + impedance + duration + installation - lateral + finite + blockage


def directivity_gain(angle: Column, knots: Column) -> Column:
    """Between sorted (angle, gain) knots; null outside them."""
    below = F.filter(knots, lambda k: k["angle"] <= angle)
    above = F.filter(knots, lambda k: k["angle"] >= angle)
    a, b = F.element_at(below, -1), F.get(above, F.lit(0))
    inside = (F.size(below) > 0) & (F.size(above) > 0)
    return F.when(inside, F.when(b["angle"] == a["angle"], a["gain"]).otherwise(a["gain"] + (b["gain"] - a["gain"]) * (angle - a["angle"]) / (b["angle"] - a["angle"])))


def point_record(row: Column, base: Column) -> Column:
    """A typed point of a trace row (array of strings: offset, lat, lon, altitude or `ground`, speed, track, flags,
    vertical rate, extra, source, geometric altitude). Flag bits: 1 stale, 2 new leg, 4 geometric rate, 8 geometric
    altitude."""
    at = lambda i: F.get(row, F.lit(i))
    flags = F.coalesce(at(6).try_cast("int"), F.lit(0))
    bit = lambda n: flags.bitwiseAND(F.lit(n)) != 0
    state = F.when(at(3) == "ground", "ground").when(at(3).try_cast("double").isNotNull(), "numeric").otherwise("missing")
    return F.struct(
        (base + at(0).try_cast("double")).alias("epoch"), at(1).try_cast("double").alias("lat"), at(2).try_cast("double").alias("lon"),
        at(3).try_cast("double").alias("alt_ft"), state.alias("alt_state"), F.when(bit(8), "geometric").otherwise("barometric").alias("alt_datum"),
        at(4).try_cast("double").alias("gs_kt"), at(5).try_cast("double").alias("track_deg"), bit(1).alias("stale"), bit(2).alias("new_leg"),
        at(7).try_cast("double").alias("vrate_fpm"), F.when(bit(4), "geometric").otherwise("barometric").alias("vrate_datum"), at(9).alias("source"), at(10).try_cast("double").alias("geo_alt_ft"),
    )
