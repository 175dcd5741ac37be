"""Tolerant casts, codes, keys and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KMH_PER_MPH = 1.609344
WALL_HEIGHT_M = 4.3
MISSING_CODES = ["999", "9999", "99999", "-9999", "-999.9", "-9999.0"]


def number(c: Column, default: float | None = None) -> Column:
    """A finite number, or the default."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x), F.lit(default).cast("double"))


def speed_kmh(c: Column, default: float) -> Column:
    """From "60", "60 mph" or "60 km/h"."""
    first = F.split(F.trim(c), r"[ ;]")[0]
    x = F.regexp_extract(first, r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.coalesce(F.when(F.lower(c).contains("mph"), x * KMH_PER_MPH).otherwise(x), F.lit(float(default)))


def wall_height(c: Column) -> Column:
    """(value, imputed) of a height in m, feet or ': from 1 to 12 m, else the usual height."""
    raw = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    form = r"^([0-9]+(?:\.[0-9]+)?)\s*(m|ft|'|feet)?$"
    value = F.regexp_extract(raw, form, 1).try_cast("double")
    value = value * F.when(F.regexp_extract(raw, form, 2).isin("ft", "'", "feet"), 0.3048).otherwise(1.0)
    fits = F.coalesce(value.between(1.0, 12.0), F.lit(False))
    return F.struct(F.when(fits, value).otherwise(F.lit(WALL_HEIGHT_M)).alias("value"), (~fits).alias("imputed"))


def building_key(study: Column, source_id: Column, ring: Column) -> Column:
    """Ids of one study are unique; elsewhere the rounded centre of the ring's vertices is added."""
    n = F.greatest(F.size(ring) - 1, F.lit(1))
    mean = lambda axis: F.bround(F.aggregate(F.slice(ring, F.lit(1), n), F.lit(0.0), lambda acc, p: acc + p[axis]) / n, 0).cast("long").cast("string")
    return F.when(study == "tarzana-pilot", F.concat(F.lit("lariac:"), source_id)).otherwise(F.concat(F.lit("dpw:"), source_id, F.lit("@"), mean("x"), F.lit(","), mean("y")))


def receiver_key(key: Column, family: Column, pk: Column) -> Column:
    """The stored key, or one made of family and number."""
    return F.coalesce(key, F.concat_ws(":", family, pk.cast("string")))


def key_without_tile(key: Column) -> Column:
    """What follows the tile's name in a key."""
    return F.regexp_replace(key, r"^[^:]*:", "")


_KEPT = ["N", "S", "E", "W", "NE", "NW", "SE", "SW"]


def tidy(text: Column) -> Column:
    """Words with one capital; directions stay, ordinals are in lower case."""

    def one(w: Column) -> Column:
        plain = F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1 << 20)))
        return F.when(w.isin(*_KEPT), w).when(w.rlike(r"^\d+(ST|ND|RD|TH)$"), F.lower(w)).otherwise(plain)

    return F.array_join(F.transform(F.split(F.trim(text), r"\s+"), one), " ")


def format_address(number_: Column, fraction: Column, direction: Column, street: Column, unit: Column, city: Column) -> Column:
    """House number, street and city; null without a number or street."""
    parts = F.concat_ws(" ", number_, fraction, direction, street, unit)
    town = tidy(F.regexp_replace(city, r"(?i)\s+CA$", ""))
    return F.when(number_.isNotNull() & street.isNotNull(), F.concat_ws(", ", tidy(parts), F.when(town != "", town)))


def is_hospital(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike("(?i)hospital|medic")


def claim_safe(text: Column, phrases: list[str]) -> Column:
    """False where a phrase stands without not, never or no just before it in its sentence.

    A determiner and then a form of be may stand between. Only words count as phrases, not parts of longer words.
    """
    out = F.lit(True)
    lowered = F.lower(F.coalesce(text, F.lit("")))
    negated = r"(?:^|(?<=[^a-z]))(?:not|never|no)(?:\s+(?:a|an|the))?(?:\s+(?:is|are|be))?\s*"
    for phrase in phrases:
        word = re.escape(phrase.lower())
        rest = F.regexp_replace(lowered, negated + r"(?<=[^a-z])" + word + r"(?=$|[^a-z])", " ")
        out = out & ~rest.rlike(r"(?:^|[^a-z])" + word + r"(?=$|[^a-z])")
    return out


def dms(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(hemisphere.isin("S", "W"), -value).when(hemisphere.isin("N", "E"), value)


def power_unit(parameter: Column) -> Column:
    """Unit of a power parameter's name, first match; null if none is known."""
    p = F.lower(parameter)
    has = lambda *xs: F.greatest(*[p.contains(x) for x in xs]) if len(xs) > 1 else p.contains(xs[0])
    return (
        F.when(has("rpm"), "rpm_per_engine")
        .when(has("%", "percent"), "percent_per_engine")
        .when(has("hp", "horse_power"), "hp_per_engine")
        .when(has("thrust", "cnt", "lb"), "lb_per_engine")
    )


def weather_value(c: Column) -> Column:
    """(value, status) of a station reading."""
    empty, code = c.isNull() | (c == ""), c.isin(*MISSING_CODES)
    status = F.when(empty, "missing").when(code, "missing_or_variable_code").otherwise("reported")
    return F.struct(F.when(~empty & ~code, c.try_cast("double")).alias("value"), status.alias("status"))


def pressure_alt_correction(qnh_hpa: Column) -> Column:
    """Feet to add to a pressure altitude: 1,000 ft an inch of mercury from standard pressure."""
    return (qnh_hpa - 1013.25) * 1000.0 / 33.8638866667
