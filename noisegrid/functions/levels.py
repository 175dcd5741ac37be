"""Decibel algebra. Levels are logs of energy: sums, means and differences happen in linear energy."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper edges of the 5 dB bands, and of the words for a level.
BAND_EDGES = [45, 50, 55, 60, 65, 70, 75, 80]
WORDS = [(45, "Quiet"), (55, "Moderate"), (65, "Noticeable"), (70, "Loud"), (None, "Very loud")]
GUIDELINES = {"Q": 53.0, "N": 45.0}


def energy(level: Column) -> Column:
    return F.pow(F.lit(10.0), level / 10.0)


def level_of(amount: Column) -> Column:
    return 10.0 * F.log10(amount)


def valid_level(c: Column, masked: Column | None = None) -> Column:
    """The level, or null where it is -99, NaN, infinite or masked."""
    good = ~F.isnan(c) & (c != -99.0) & (F.abs(c) < float("inf"))
    if masked is not None:
        good = good & ~F.coalesce(masked, F.lit(False))
    return F.when(good, c.cast("double"))


def energy_add(a: Column, b: Column) -> Column:
    """Sum of two levels; a where b is null, null where a is."""
    return F.when(b.isNull(), a).otherwise(level_of(energy(a) + energy(b)))


def energy_add_n(*cols: Column) -> Column:
    """Sum of the levels that are not null; null if none is."""
    known = F.filter(F.array(*cols), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + energy(x))
    return F.when(F.size(known) > 0, level_of(total))


def energy_subtract(total: Column, part: Column) -> Column:
    """Take a part out of a total: parts up to 45 dB (or unknown) change nothing; a part within 3 dB leaves null."""
    loud = F.coalesce(part > 45.0, F.lit(False))
    return F.when(~loud, total).when(total > part + 3.0, level_of(energy(total) - energy(part)))


def cnel(d: Column, e: Column, n: Column) -> Column:
    """24 h level of day, evening (+5 dB) and night (+10 dB)."""
    return level_of((12.0 * energy(d) + 3.0 * energy(e + 5.0) + 9.0 * energy(n + 10.0)) / 24.0)


def laeq24(d: Column, e: Column, n: Column) -> Column:
    return level_of((12.0 * energy(d) + 3.0 * energy(e) + 9.0 * energy(n)) / 24.0)


def without_aircraft(d: Column, e: Column, n: Column) -> Column:
    return cnel(d, e, n)


def sel_from_laeq(laeq: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, laeq + level_of(seconds))


def laeq_from_sel(sel: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, sel - level_of(seconds))


def a_weighting(hz: Column) -> Column:
    """A-weighting in dB of a frequency (IEC 61672); null for none above 0."""
    f2 = hz * hz
    c1, c2, c3, c4 = 20.6**2, 107.7**2, 737.9**2, 12194.0**2
    response = c4 * f2 * f2 / ((f2 + c1) * F.sqrt((f2 + c2) * (f2 + c3)) * (f2 + c4))
    return F.when(hz > 0, 20.0 * F.log10(response) + 2.0)


def band(level: Column) -> Column:
    """Index 0 to 8 of the 5 dB band."""
    out = F.lit(0)
    for edge in BAND_EDGES:
        out = out + F.when(level >= edge, 1).otherwise(0)
    return F.when(level.isNotNull(), out)


def level_word(level: Column) -> Column:
    out = F.when(level.isNull(), F.lit(None).cast("string"))
    for edge, word in WORDS[:-1]:
        out = out.when(level < edge, word)
    return out.otherwise(WORDS[-1][1])


def above_guideline(level: Column, period: Column) -> Column:
    """Above the guideline of the 24 h (Q) or night (N) level; null for other periods."""
    return F.when(period == "Q", level > GUIDELINES["Q"]).when(period == "N", level > GUIDELINES["N"])


def normalize(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((c - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def round_db(c: Column, digits: int = 1) -> Column:
    return F.bround(c, digits)


def to_decidb(c: Column) -> Column:
    return F.bround(c * 10.0, 0).cast("smallint")


def from_decidb(c: Column) -> Column:
    return c.cast("double") / 10.0


def energy_sum(c: Column, on_empty: str = "null") -> Column:
    """Aggregate: the energy sum of a group's levels. Groups without a level give null, `error` or `neg_inf`."""
    total = level_of(F.sum(energy(c)))
    if on_empty == "neg_inf":
        return F.coalesce(total, F.lit(-math.inf))
    if on_empty == "error":
        bad = (F.count(c) == 0) | (F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))) > 0)
        return F.when(bad, F.raise_error("energy sum of no finite level").cast("double")).otherwise(total)
    return total


def energy_sum_stable(c: Column) -> Column:
    """Aggregate: as energy_sum for levels so high that their energies overflow, by the group's highest level."""
    levels = F.collect_list(c)
    top = F.array_max(levels)
    return top + level_of(F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + energy(x - top)))


def exact_sum(c: Column) -> Column:
    """Aggregate: the sum in millionths as integers, so that it is the same in any order; null without values."""
    return F.sum(F.round(c * 1_000_000).cast("long")) / F.lit(1e6)


def exact_mean(c: Column) -> Column:
    """Aggregate: the mean of an exact_sum."""
    return exact_sum(c) / F.count(c)


def energy_mean(c: Column) -> Column:
    """Aggregate: the level of the mean energy."""
    return level_of(F.avg(energy(c)))


def source_power(warm: Column, cold: Column, weights: list[float]) -> Column:
    """A-weighted power level from octave-band levels at two temperatures: the louder of the two."""

    def total(bands: Column) -> Column:
        weighted = F.zip_with(bands, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: energy(x + w))
        return level_of(F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))))

    return F.greatest(total(warm), total(cold))
