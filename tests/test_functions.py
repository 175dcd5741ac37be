"""Column functions against literal vectors and their own laws."""

import math

import pytest
from pyspark.sql import functions as F

from noisegrid.functions import acoustics as A
from noisegrid.functions import geometry as G
from noisegrid.functions import levels as L
from noisegrid.functions import sql, text, traffic
from noisegrid.functions import timefns as T


def value(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


def d(x):
    return F.lit(x).cast("double")


def test_levels(spark):
    assert value(spark, L.energy_add(d(60), d(60)), L.energy_add(d(60), d(None)), L.energy_add(d(None), d(60))) == (pytest.approx(63.0102999566), 60.0, None)
    assert value(spark, L.energy_add_n(d(60), d(None), d(60)), L.energy_add_n(d(None))) == (pytest.approx(63.0103, abs=1e-4), None)
    assert value(spark, L.energy_subtract(d(60), d(45)), L.energy_subtract(d(60), d(50)), L.energy_subtract(d(60), d(58)), L.energy_subtract(d(60), d(None))) == (60.0, pytest.approx(59.5424, abs=1e-4), None, 60.0)
    assert value(spark, L.cnel(d(60), d(60), d(60))) == pytest.approx(60 + 10 * math.log10((12 + 3 * 10**0.5 + 90) / 24))
    assert value(spark, L.laeq24(d(60), d(60), d(60))) == pytest.approx(60)
    assert value(spark, L.sel_from_laeq(d(80), d(10)), L.sel_from_laeq(d(83.1), d(24.2)), L.laeq_from_sel(d(90), d(10)), L.sel_from_laeq(d(1), d(0))) == (pytest.approx(90), pytest.approx(96.9382, abs=1e-4), pytest.approx(80), None)
    bad = [F.lit(float(x)) for x in ("nan", "inf", "-inf")] + [d(-99), d(None)]
    assert value(spark, *[L.valid_level(b) for b in bad], L.valid_level(d(50), F.lit(True)), L.valid_level(d(50))) == (None,) * 6 + (50.0,)
    assert value(spark, L.round_db(d(2.25)), L.to_decidb(d(45.25)), L.from_decidb(F.lit(452).cast("smallint"))) == (2.2, 452, 45.2)
    assert value(spark, *[L.band(d(x)) for x in (44.9, 45, 80, None)], L.level_word(d(54.9)), L.level_word(d(70)), L.above_guideline(d(46), F.lit("N")), L.normalize(d(7), 0, 5)) == (0, 1, 8, None, "Moderate", "Very loud", True, 1.0)
    assert value(spark, L.a_weighting(d(1000))) == pytest.approx(0, abs=0.01)


def test_energy_aggregates(spark):
    df = spark.createDataFrame([(60.0,), (60.0,), (None,)], "l double")
    assert df.agg(L.energy_sum(F.col("l")), L.energy_mean(F.col("l"))).first()[:] == (pytest.approx(63.0103, abs=1e-4), pytest.approx(60))
    empty = df.where("false")
    assert empty.agg(L.energy_sum(F.col("l")), L.energy_sum(F.col("l"), "neg_inf")).first()[:] == (None, -math.inf)
    with pytest.raises(Exception, match="no finite level"):
        empty.agg(L.energy_sum(F.col("l"), "error")).collect()
    assert spark.createDataFrame([(1e4,), (1e4,)], "l double").agg(L.energy_sum_stable(F.col("l"))).first()[0] == pytest.approx(1e4 + 3.0103, abs=1e-4)


def test_time_and_text(spark):
    assert value(spark, T.period_of_clock(F.lit("25:10:00")), T.period_of_clock(F.lit("07:00:00")), T.period_of_clock(F.lit("20:00")), T.period_of_clock(F.lit("x"))) == ("N", "D", "E", None)
    ts = F.to_timestamp(F.lit("2026-03-08 20:00:00"))
    assert value(spark, T.daypart(ts, "America/Los_Angeles"), T.cnel_weight(ts, "UTC")) == ("D", 3.0)
    assert value(spark, T.source_year(F.lit("map of 1998, revised 2004; no 12345")), T.source_year(F.lit("none"))) == (2004, None)
    assert value(spark, text.number(F.lit(" 12.5 ")), text.number(F.lit("nan"), 3), text.number(F.lit("x")), text.speed_kmh(F.lit("60 mph"), 50), text.speed_kmh(F.lit("70"), 50), text.speed_kmh(F.lit("?"), 50)) == (12.5, 3.0, None, pytest.approx(96.56064), 70.0, 50.0)
    assert [tuple(value(spark, text.wall_height(F.lit(x)))) for x in ("4.5 m", "14'", "14 ft", "40", "", None)] == [(4.5, False), (pytest.approx(4.2672), False), (pytest.approx(4.2672), False), (4.3, True), (4.3, True), (4.3, True)]
    assert value(spark, text.tidy(F.lit("19305 N REDWING ST")), text.tidy(F.lit("1ST AVE")), text.is_hospital(F.lit("Medic pad")), text.is_hospital(F.lit(None).cast("string"))) == ("19305 N Redwing St", "1st Ave", True, False)
    none = F.lit(None).cast("string")
    assert value(spark, text.format_address(F.lit("12"), none, F.lit("N"), F.lit("OAK ST"), none, F.lit("RESEDA CA"))) == "12 N Oak St, Reseda"
    assert value(spark, text.dms(d(34), d(30), d(36), F.lit("S")), text.power_unit(F.lit("CNT (lb)")), text.power_unit(F.lit("RPM")), text.pressure_alt_correction(d(1013.25))) == (pytest.approx(-34.51), "lb_per_engine", "rpm_per_engine", 0.0)
    assert [tuple(value(spark, text.weather_value(F.lit(x)))) for x in ("9999", "", "12.5")] == [(None, "missing_or_variable_code"), (None, "missing"), (12.5, "reported")]


@pytest.mark.parametrize(("claim", "safe"), [("This is measured data.", False), ("This is not measured data.", True), ("It is never a measured value", True), ("It is not only measured", False), ("not here. measured there", False), ("unmeasured", True), (None, True), ("not measured and measured", False)])
def test_claims(spark, claim, safe):
    assert value(spark, text.claim_safe(F.lit(claim).cast("string"), ["measured"])) is safe


def test_geometry(spark):
    here = value(spark, G.lonlat_to_utm(d(-118.5), d(34.2)))
    back = value(spark, G.utm_to_lonlat(d(here.x), d(here.y)))
    assert (back.lon, back.lat) == (pytest.approx(-118.5, abs=1e-7), pytest.approx(34.2, abs=1e-7)) and here.x == pytest.approx(361_800, abs=300)
    assert value(spark, G.haversine(d(0), d(0), d(1), d(0))) == pytest.approx(111_195, abs=1)
    assert value(spark, G.angle_diff(d(350), d(10)), G.interp_heading(d(359), d(1), d(0.5)), G.line_angle_diff(d(170), d(5)), G.line_angle(d(-1), d(0))) == (20.0, 0.0, 15.0, pytest.approx(0))
    assert value(spark, G.point_segment(*map(d, (5, 3, 0, 0, 10, 0))), G.point_segment(*map(d, (-3, 4, 0, 0, 10, 0)))) == ((3.0, 0.5), (5.0, 0.0))
    assert value(spark, G.clip_segment(*map(d, (-5, 5, 15, 5, 0, 0, 10, 10))), G.clip_segment(*map(d, (-5, 15, 15, 15, 0, 0, 10, 10))), G.clip_time(*map(d, (0, 10, 5, 20)))) == ((0.25, 0.75), None, (0.5, 1.0))
    assert value(spark, G.lerp_sq(d(3), d(5), d(0.5)), G.lerp_sq(d(-3), d(-5), d(0.5)), G.lerp_sq(d(-4), d(4), d(0.25))) == (pytest.approx(math.sqrt(17)), pytest.approx(-math.sqrt(17)), 0.0)
    square = F.array(*[F.struct(d(x).alias("x"), d(y).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2), (0, 0))])
    s = value(spark, G.ring_stats(square))
    assert (s.cx, s.cy, s.area, s.perimeter, s.vertices, s.aspect) == (2.0, 1.0, 8.0, 12.0, 4, 0.5)
    turned = F.array(*[F.struct(d(x).alias("x"), d(y).alias("y")) for x, y in ((4, 2), (4, 0), (0, 0), (0, 2), (4, 2))])
    assert value(spark, G.in_ring(d(1), d(1), square), G.in_ring(d(5), d(1), square), G.same_ring(square, turned), G.same_ring(square, F.transform(turned, lambda p: F.struct((p["x"] + 1).alias("x"), p["y"].alias("y"))))) == (True, False, True, False)
    assert len(value(spark, G.cells_of_bbox(*map(d, (-10, 990, 10, 1010))))) == 4
    tile = value(spark, G.lonlat_to_tile(d(-118.5), d(34.2), 12))
    pixel = value(spark, G.tile_pixel_lonlat(12, F.lit(tile.x), F.lit(tile.y), d(127.5), d(127.5)))
    assert value(spark, G.lonlat_to_tile(d(pixel.lon), d(pixel.lat), 12)) == tile


def test_geodesic(spark):
    far, turn = value(spark, sql.geodesic_inverse(d(0), d(0), d(1), d(0)))
    assert (far, turn) == (pytest.approx(111_319.4908, abs=1e-3), pytest.approx(90))
    assert value(spark, sql.geodesic_inverse(d(3), d(4), d(3), d(4))) [0] == 0


def test_traffic(spark):
    edges = spark.createDataFrame(
        [(1, "S1400", None, False, 1.0, None, None, None, None, None, None), (2, "S1400", "residential", True, 1.0, None, None, None, None, None, None), (3, "S1400", "tertiary", False, 0.5, None, None, None, None, None, None), (4, "S1100", None, False, 0.5, "7", "100000", "3000", "60000", "65", "1")],
        "edge_id int, mtfcc string, street string, dead_end boolean, split double, record_id string, aadt string, aadt_su string, aadt_comb string, speed_limit string, f_system string",
    )
    rows = {r.edge_id: r for r in traffic.traffic_for(edges).collect()}
    assert [rows[i].aadt_assigned for i in (1, 2, 3, 4)] == [800, 150, 2000, 50000]
    assert [rows[i].basis for i in (1, 2, 3, 4)] == ["class_default:S1400", "class_default:S1400/dead_end", "class_default:S1400/tertiary", "hpms_2024:7"]
    assert (rows[4].hgv_share, rows[4].car_kmh, rows[4].truck_kmh) == (0.5, pytest.approx(104.607, abs=1e-3), 88.0) and rows[2].car_kmh == 25
    flows = traffic.period_weather(traffic.period_flows(traffic.traffic_for(edges))).collect()
    assert {r.period for r in flows} == {"DL", "EL", "NL", "DA", "EA", "NA", "DF", "EF", "NF", "N0", "N1"} and all(len(r.rose) == 16 for r in flows)
    bands = value(spark, traffic.horn_emission(d(2), d(36)))
    total = 10 * math.log10(sum(10 ** ((b + a) / 10) for b, a in zip(bands, traffic.A_WEIGHTS, strict=True)))
    assert total == pytest.approx(143.3 - 10 * math.log10(36000), abs=0.02) and value(spark, traffic.horn_emission(d(0), d(36)))[0] == -99
    assert value(spark, traffic.service_speed(d(80), d(0))) == pytest.approx(math.sqrt(30) * 3.6)


def test_npd(spark):
    npd = spark.createDataFrame([("A", 100.0, 30.48, 60.0), ("A", 100.0, 304.8, 40.0), ("A", 200.0, 30.48, 70.0), ("A", 200.0, 304.8, 50.0)], "npd_id string, power double, distance_m double, level_db double")
    asked = spark.createDataFrame([(1, "A", 150.0, math.sqrt(30.48 * 304.8)), (2, "A", 250.0, 100.0), (3, "B", 150.0, 100.0), (4, "A", 100.0, 3048.0), (5, "A", 100.0, 1.0)], "k int, npd_id string, power double, distance_m double")
    rows = {r.k: r for r in A.npd_level(asked, npd, ["k"]).collect()}
    assert (rows[1].level_db, rows[4].level_db) == (pytest.approx(55.0), pytest.approx(20.0)) and (rows[2].status, rows[3].status) == ("power_outside", "no_table")
    assert rows[5].level_db == pytest.approx(60 - 20 * math.log10(30 / 30.48))
    more = {r.k: r for r in A.npd_level(asked, npd, ["k"], extrapolate_power=True).collect()}
    assert more[2].level_db == pytest.approx(75 - 20 * math.log10(100 / 30.48))


def test_segment_terms(spark):
    assert value(spark, A.lateral_attenuation(d(60), d(500)), A.duration_correction(d(160 * 1852 / 3600))) == (0.0, pytest.approx(0))
    whole = value(spark, A.finite_segment(d(90), d(80), d(5e6), d(1e7)))
    half = value(spark, A.finite_segment(d(90), d(80), d(0), d(1e7)))
    assert whole == pytest.approx(0, abs=1e-6) and half == pytest.approx(-3.0103, abs=1e-3)
    near, far = (value(spark, A.finite_segment(d(90), d(80), d(-x), d(1e4))) for x in (17_200, 17_100))
    assert abs(near - far) < 0.1  # the series goes on where the closed form ends
    knots = F.array(*[F.struct(d(a).alias("angle"), d(g).alias("gain")) for a, g in ((0, 0), (90, -6), (180, -10))])
    assert value(spark, A.directivity_gain(d(45), knots), A.directivity_gain(d(190), knots)) == (-3.0, None)
    row = F.array(*[F.lit(x).cast("string") for x in ("10.5", "34.1", "-118.4", "ground", "12", "90", "3", None, None, "adsb_icao", None, None, None, None)])
    p = value(spark, A.point_record(row, d(1000)))
    assert (p.epoch, p.alt_state, p.alt_ft, p.stale, p.new_leg) == (1010.5, "ground", None, True, True)


def test_sql_functions(spark):
    names = sql.register_functions(spark)
    assert "cnel" in names
    row = spark.sql("SELECT energy_add(60D, 60D) a, cnel(60D, 60D, 60D) c, level_band(81D) b, level_band(44D) z, daypart(timestamp'2026-01-01 20:00:00', 'UTC') p, haversine_m(0D, 0D, 1D, 0D) h").first()
    assert (row.a, row.b, row.z, row.p) == (pytest.approx(63.0103, abs=1e-4), 8, 0, "E") and row.h == pytest.approx(111_195, abs=1)
    line = spark.sql("SELECT * FROM densify_line(array(0D, 10D, 10D), array(0D, 0D, 5D), 4D)").collect()
    assert [r.station for r in line] == [0.0, pytest.approx(10 / 3), pytest.approx(20 / 3), 10.0, 12.5, 15.0]
