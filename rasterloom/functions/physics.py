"""Column functions: indexes, physics, angular gates and threshold tests.

A null channel makes an index null; tests are false where an input is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BOLTZMANN, LIGHT, PLANCK, Thresholds

TH = Thresholds()


def test(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def invalid_value(x: Column) -> Column:
    """Missing, not finite, or out of 0..350."""
    return x.isNull() | F.isnan(x) | (x > 350) | (x < 0)


def cloud_index(cosz: Column, mir: Column, lir: Column, method: str = "default") -> Column:
    diff = mir - lir
    if method == "default":
        return diff
    if method == "mu-normalization":
        return diff / F.greatest(cosz, F.lit(0.05))
    if method == "norm-diff":
        return F.try_divide(diff, mir + lir)
    if method == "epsilon":
        k = PLANCK * LIGHT / (BOLTZMANN * 2.0e-6)
        return 1 - F.exp(-k * (F.try_divide(F.lit(1.0), lir) - F.try_divide(F.lit(1.0), mir)))
    raise ValueError(f"unknown method {method}")


def snow_index(vis: Column, sir: Column, zen: Column | None = None, least: float = 0.02, kind: str = "ndsi") -> Column:
    total = F.greatest(sir + vis, F.lit(least))
    if kind == "ndsi":
        return (vis - sir) / total
    if kind == "ndsi-zenith":
        return (vis - sir) / total + 0.15 * F.pow(1 - F.cos(zen), 2)
    return F.when(sir.isNotNull(), vis / F.greatest(sir, F.lit(least)))


def brightness_temperature(kelvin: Column, wavelength: float, emissivity: float) -> Column:
    """Expected brightness temperature of a grey body (wavelength in metres)."""
    a = PLANCK / BOLTZMANN * LIGHT / wavelength
    return a / F.ln(1 + (F.exp(a / kelvin) - 1) / emissivity)


def angular_factor(zen: Column) -> Column:
    return 1 / F.greatest(F.pow(F.greatest(F.cos(zen), F.lit(0.0)), 0.3), F.lit(0.04))


def glint_angle_cosine(zen: Column, sat: Column, scatter: Column) -> Column:
    return 2 * F.cos(zen) * F.cos(sat) - F.cos(scatter)


def smooth_threshold(x: Column, th: float) -> Column:
    return F.exp(-(x - th))


def between_degrees(zen: Column, lo: float, hi: float) -> Column:
    """Open interval of an angle in radians."""
    return test((zen > math.radians(lo)) & (zen < math.radians(hi)))


#: fixed values: the angular gates in degrees
GATES = {"dawn_day": (0, 85), "day": (15, 85), "night": (0, 90), "twilight": (80, 90), "temporal": (75, 89), "satellite": (15, 70)}


def gate(zen: Column, name: str) -> Column:
    return between_degrees(zen, *GATES[name])


def gross_cloud(lir: Column, forecast: Column) -> Column:
    return test(forecast - lir > TH.gross_cloud)


def gross_snow(lir: Column, forecast: Column) -> Column:
    return test(lir - forecast > -2 * TH.gross_snow)


def cold(lir: Column, t2m: Column, wavelength: float = 12.4e-6) -> Column:
    return test(brightness_temperature(t2m, wavelength, 0.85) - lir > 8)


def opaque_cloud(cli_mu: Column, eps: Column) -> Column:
    return test((cli_mu > TH.cli_cloud) & (eps < TH.opaque))


def transparent_cloud(eps: Column) -> Column:
    return test(eps > TH.cloud_epsilon)


def broad_cirrus_snow(eps: Column) -> Column:
    return test(eps < TH.broad_cirrus)


def thin_cirrus(is_land: Column, lir: Column, fir: Column, lir_fc: Column, fir_fc: Column) -> Column:
    return test(((lir - fir) - (lir_fc - fir_fc) > TH.thin_cirrus) & ((lir < 305) | ~is_land))


def land_visible(is_land: Column, vis: Column, clear: Column) -> Column:
    return test(is_land & (vis - clear > TH.land_visible))


def ndsi_test(ndsi: Column, cos_scatter: Column | None = None) -> Column:
    extra = F.lit(0.0) if cos_scatter is None else 0.15 * F.pow(cos_scatter - 1, 2)
    return test(ndsi > TH.ndsi + extra)


def sea_coast_cloud(zen: Column, is_land: Column, near_land: Column, vis: Column) -> Column:
    """Bright water: open sea against a low threshold, sea beside land against a higher one."""
    factor = 1 / F.pow(F.greatest(F.cos(zen), F.lit(0.03)), 0.3)
    return test((~near_land & (vis > TH.sea * factor)) | (near_land & ~is_land & (vis > TH.coast * factor)))


def sun_glint_low_cloud(cosz: Column, vis: Column, mir: Column, lir: Column) -> Column:
    diff = mir - lir
    return test(gate(F.acos(cosz), "day") & (mir < 320) & (vis > 0.6) & (diff > 0) & (vis > diff / 0.15))


def lir_fir(lir: Column, fir: Column) -> Column:
    """Small epsilon index of the pair, and cold."""
    k = PLANCK * LIGHT / (BOLTZMANN * 2.0e-6)
    return test((F.exp(-k * (F.try_divide(F.lit(1.0), fir) - F.try_divide(F.lit(1.0), lir))) < 0.2) & (lir < 303.15))


def stable(x: Column, past: Column, limit: float | Column) -> Column:
    return test(F.abs(x - past) < limit)


def thermal_stable(is_land: Column, lir: Column, fir: Column, past_lir: Column, past_fir: Column) -> Column:
    """lir keeps within its surface's limit, or its difference to fir within theirs; false where neither can be told."""
    limit = F.when(is_land, TH.evolution_land).otherwise(TH.evolution_sea)
    return stable(lir, past_lir, limit) | stable(lir - fir, past_lir - past_fir, TH.evolution_pair)


def low_cloud_composite(fir: Column, lir: Column, mir: Column) -> list[Column]:
    """Three infrared channels from 200 K on in half degrees, times 255; all 0 where lir leaves (0, 250] of them, null where it is missing."""
    steps = [F.bround(2 * (c - 200), 0) for c in (fir, lir, mir)]
    return [F.when((steps[1] <= 0) | (steps[1] > 250), 0.0).otherwise(F.when(lir.isNotNull(), 255 * c)) for c in steps]


def trainable(columns: list[Column], single: bool = False) -> Column:
    """No value is missing; `single`: of one channel, none outside 0 to 300 either."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (c.between(0, 300) if single else F.lit(True))
    return test(ok)


def layers(*tests: Column) -> Column:
    """The number, from 1, of the last test that holds; 0 if none."""
    out = F.lit(0)
    for i, held in enumerate(tests, 1):
        out = F.when(held, i).otherwise(out)
    return out


def seeds_visible(vis: Column, mean: Column) -> Column:
    return test(vis > 1.05 * mean)


def seeds_infrared(lir: Column, mean: Column) -> Column:
    return test((lir > mean - 5) & (lir < mean + 0.5))


def tricky_index(x: Column, gamma: float, s: float) -> Column:
    """exp(-gamma |x - s|) less its value at 0, over its largest value (at s)."""
    low = math.exp(-gamma * s)
    return (F.exp(-gamma * F.abs(x - s)) - low) / (1 - low)


def snow_composite(vis: Column, sir: Column, mir: Column) -> list[Column]:
    """Red, green and blue, 0 where negative."""
    return [F.greatest(255 * c, F.lit(0.0)) for c in (vis, sir, (mir - 250) / 100)]


def night_like(*features: Column) -> Column:
    """All features are -1."""
    return test(F.forall(F.array(*features), lambda x: x == -1))
