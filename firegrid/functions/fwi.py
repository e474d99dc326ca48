"""The Canadian Fire Weather Index System (Van Wagner 1987), as expressions.

The equations are written once over a small set of functions, so the same text
serves Spark columns and NumPy arrays (the day-by-day recursion).
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Moisture scale, day-length factors by month, start values of a series.
SCALE = 250.0 * 59.5 / 101.0
DMC_DAYS = [6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0]
DC_DAYS = [-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6]
START = (85.0, 6.0, 15.0)

_COLUMN = SimpleNamespace(
    exp=F.exp, log=F.log, sqrt=F.sqrt, pow=lambda a, b: F.pow(a, F.lit(b)), power_of=lambda a, b: F.pow(F.lit(a), b),
    where=lambda c, a, b: F.when(c, a).otherwise(b),
    least=lambda a, b: F.least(a, F.lit(b)), most=lambda a, b: F.greatest(a, F.lit(b)),
    of_month=lambda values, m: F.element_at(F.array(*map(F.lit, values)), m.cast("int")),
)
_ARRAY = SimpleNamespace(
    exp=np.exp, log=np.log, sqrt=np.sqrt, pow=np.power, power_of=np.power,
    where=np.where, least=np.minimum, most=np.maximum, of_month=lambda values, m: np.array(values)[m - 1],
)


def _kind(x):
    return _COLUMN if isinstance(x, Column) else _ARRAY


def ffmc(before, temp, rh, wind, rain):
    """Fine Fuel Moisture Code of a day from the day before's."""
    f = _kind(before)
    h = f.least(rh, 99.9999)
    m = SCALE * (101.0 - before) / (59.5 + before)
    net = f.most(rain - 0.5, 1e-9)
    wet = m + 42.5 * net * f.exp(-100.0 / (251.0 - m)) * (1.0 - f.exp(-6.93 / net))
    wet = wet + f.where(m > 150.0, 0.0015 * f.pow(m - 150.0, 2.0) * f.sqrt(net), wet * 0.0)
    m = f.where(rain > 0.5, f.least(wet, 250.0), m)
    common = 0.18 * (21.1 - temp) * (1.0 - f.exp(-0.115 * h))
    dry_to = 0.942 * f.pow(h, 0.679) + 11.0 * f.exp((h - 100.0) / 10.0) + common
    wet_to = 0.618 * f.pow(h, 0.753) + 10.0 * f.exp((h - 100.0) / 10.0) + common

    def rate(part):
        k = 0.424 * (1.0 - f.pow(part, 1.7)) + 0.0694 * f.sqrt(wind) * (1.0 - f.pow(part, 8.0))
        return f.power_of(10.0, k * 0.581 * f.exp(0.0365 * temp))

    wetting = wet_to - (wet_to - m) / rate((100.0 - h) / 100.0)
    drying = dry_to + (m - dry_to) / rate(h / 100.0)
    m = f.where((m < dry_to) & (m < wet_to), wetting, f.where(m > dry_to, drying, m))
    return f.most(f.least(59.5 * (250.0 - m) / (SCALE + m), 101.0), 0.0)


def dmc(before, temp, rh, rain, month):
    """Duff Moisture Code."""
    f = _kind(before)
    drying = 1.894 * (f.most(temp, -1.1) + 1.1) * (100.0 - rh) * f.of_month(DMC_DAYS, month) * 1e-4
    net = 0.92 * f.most(rain, 1.5) - 1.27
    m = 20.0 + 280.0 / f.exp(0.023 * before)
    log = f.log(f.most(before, 1e-9))
    slope = f.where(before <= 33.0, 100.0 / (0.5 + 0.3 * before), f.where(before <= 65.0, 14.0 - 1.3 * log, 6.2 * log - 17.2))
    m = m + 1000.0 * net / (48.77 + slope * net)
    wet = f.most(43.43 * (5.6348 - f.log(m - 20.0)), 0.0)
    return f.most(f.where(rain > 1.5, wet, before) + drying, 0.0)


def dc(before, temp, rain, month):
    """Drought Code."""
    f = _kind(before)
    drying = f.most(0.5 * (0.36 * (f.most(temp, -2.8) + 2.8) + f.of_month(DC_DAYS, month)), 0.0)
    net = 0.83 * f.most(rain, 2.8) - 1.27
    wet = f.most(before - 400.0 * f.log(1.0 + 3.937 * net / (800.0 * f.exp(-before / 400.0))), 0.0)
    return f.most(f.where(rain > 2.8, wet, before) + drying, 0.0)


def isi(code, wind):
    """Initial Spread Index from the fine fuel code."""
    f = _kind(code)
    m = SCALE * (101.0 - code) / (59.5 + code)
    return 0.208 * f.exp(0.05039 * wind) * 91.9 * f.exp(-0.1386 * m) * (1.0 + f.pow(m, 5.31) / 49_300_000.0)


def bui(duff, drought):
    """Buildup Index; 0 where both codes are 0."""
    f = _kind(duff)
    none = (duff == 0.0) & (drought == 0.0)
    both = f.where(none, duff * 0.0 + 1.0, duff + 0.4 * drought)
    u = 0.8 * drought * duff / both
    share = f.where(duff == 0.0, duff * 0.0, (duff - u) / f.where(duff == 0.0, duff * 0.0 + 1.0, duff))
    low = f.most(duff - (0.92 + f.pow(0.0114 * duff, 1.7)) * share, 0.0)
    return f.where(none, duff * 0.0, f.where(u < duff, low, u))


def fwi(spread, buildup):
    """Fire Weather Index."""
    f = _kind(spread)
    part = f.where(buildup > 80.0, 1000.0 / (25.0 + 108.64 / f.exp(0.023 * buildup)), 0.626 * f.pow(buildup, 0.809) + 2.0)
    b = 0.1 * spread * part
    return f.where(b <= 1.0, b, f.exp(2.72 * f.pow(0.434 * f.log(f.most(b, 1.0)), 0.647)))


def step(before: tuple, temp, rh, wind, rain, month) -> tuple:
    """One day: new codes and indices ``(ffmc, dmc, dc, isi, bui, fwi)``."""
    a, b, c = ffmc(before[0], temp, rh, wind, rain), dmc(before[1], temp, rh, rain, month), dc(before[2], temp, rain, month)
    s, u = isi(a, wind), bui(b, c)
    return a, b, c, s, u, fwi(s, u)


def relative_humidity(temp: Column, dew: Column) -> Column:
    """Magnus formula, in percent, at most 100."""
    e = lambda t: F.exp(17.625 * t / (243.04 + t))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * e(dew) / e(temp)))


def weather_errors(temp: Column, rh: Column, wind: Column, rain: Column, month: Column) -> Column:
    """Codes of failed input checks, in order; empty if the row is valid."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    checks = [
        ("temperature_not_finite", finite(temp)),
        ("humidity_out_of_range", finite(rh) & rh.between(0, 100)),
        ("wind_negative", finite(wind) & (wind >= 0)),
        ("precipitation_negative", finite(rain) & (rain >= 0)),
        ("month_out_of_range", month.isNotNull() & month.between(1, 12)),
    ]
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks)))
