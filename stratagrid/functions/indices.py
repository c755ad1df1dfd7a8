"""Column expressions for spectral, climate and productivity indices.

Ratios use try_divide, so a zero denominator gives NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the light-use-efficiency model.
T_MIN, T_OPT, T_MAX = 0.0, 20.33, 48.0
NDVI_MIN, NDVI_MAX, FPAR_MIN, FPAR_MAX = 0.03, 0.96, 0.001, 0.95
PAR_SCALE, LST_SCALE, LST_OFFSET = 0.0864, 0.02, -273.15
# Fixed values of the geometric temperature model: (a, b) of the daily maximum and minimum.
GEO_MAX, GEO_MIN = (37.03043, -15.43029), (24.16453, -15.71751)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b): NDVI, NDWI, NDTI, LSWI by the bands given."""
    return ratio(a - b, a + b)


def scaled_index(v: Column, scale: float = 125.0, offset: float = 125.0, low: float = 0.0, high: float = 250.0) -> Column:
    """v * scale + offset within low..high."""
    return F.greatest(F.least(v * scale + offset, F.lit(high)), F.lit(low))


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return ratio(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1)


def nirv(nir: Column, red: Column) -> Column:
    return (normalized_difference(nir, red) - 0.08) * nir


def bsi(blue: Column, red: Column, nir: Column, swir: Column) -> Column:
    """Bare soil index."""
    return ratio((swir + red) - (nir + blue), (swir + red) + (nir + blue))


def fpar(ndvi: Column) -> Column:
    """Absorbed share of radiation, linear in NDVI."""
    return (ndvi - NDVI_MIN) * (FPAR_MAX - FPAR_MIN) / (NDVI_MAX - NDVI_MIN) + FPAR_MIN


def lst_celsius(lst: Column) -> Column:
    return lst * LST_SCALE + LST_OFFSET


def par_energy(par: Column) -> Column:
    return par * PAR_SCALE


def temperature_scalar(t: Column) -> Column:
    span = (t - T_MAX) * (t - T_MIN)
    return ratio(span, span - (t - T_OPT) * (t - T_OPT))


def water_scalar(lswi: Column, lswi_max: Column) -> Column:
    return ratio(1 + lswi, 1 + lswi_max)


def gross_productivity(par: Column, fpar_: Column, w: Column, t: Column, lue: float = 1.0, scale: float = 10.0) -> Column:
    """Productivity, 0 where the absorbed share or the product is negative."""
    out = par * fpar_ * w * t * lue * scale
    return F.when((fpar_ < 0) | (out < 0), 0.0).otherwise(out)


def geometric_temperature(lat: Column, elevation: Column, day: Column, coefficients: tuple[float, float] = GEO_MAX) -> Column:
    """Temperature (hundredths of a degree) from latitude in degrees, elevation and day of year."""
    a, b = coefficients
    phi = F.radians(lat)
    season = F.cos((day - 18) * math.pi / 182.5 + F.when(lat >= 0, 1.0).otherwise(4.0) * math.pi)
    return F.bround((a * F.cos(phi) + b * (1 - season) * F.abs(F.sin(phi)) - 0.006 * elevation * 0.1) * 100)


def box_cox(v: Column, lam: float) -> Column:
    return F.log(v) if lam == 0 else (F.pow(v, F.lit(lam)) - 1) / lam


def inverse_box_cox(v: Column, lam: float) -> Column:
    return F.exp(v) if lam == 0 else F.pow(F.greatest(v * lam + 1, F.lit(0.0)), F.lit(1 / lam))


def nan_to_null(v: Column) -> Column:
    """NaN never travels: it becomes NULL at every source."""
    return F.when(~F.isnan(v), v)


def clip(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def rounded(v: Column, digits: int) -> Column:
    """v times ten to the digits, rounded half away from zero, scaled back: DuckDB's rounding of doubles, where F.round takes the shortest decimal."""
    return F.round(v * 10.0**digits) / 10.0**digits


def density(heads: Column, area: Column) -> Column:
    """Heads per area; a zero area or a zero density is NULL."""
    d = ratio(heads, area)
    return F.when(d != 0, d)


def land_system(crop: Column, cultivated: Column, natural: Column, p50: Column, p95: Column) -> Column:
    """Land-system class 0 to 4 from three shares (percent) and two temperature percentiles; first rule wins."""
    gate = (p50 > 13400) & (p95 < 16058)
    return (
        F.when(gate & (natural > 0) & (natural > cultivated) & (crop <= 19), 1)
        .when(gate & (cultivated > 0) & (cultivated >= natural) & (crop <= 19), 2)
        .when(gate & (cultivated + natural > 0) & (crop > 19) & (crop <= 37), 3)
        .when(gate & (crop > 0) & (crop <= 67), 4)
        .otherwise(0)
    )


def renormalised(shares: list[Column], most: float = 100.0) -> list[Column]:
    """Shares scaled down to most where their sum exceeds it."""
    total = sum(shares[1:], shares[0])
    return [F.when(total > most, s / total * most).otherwise(s) for s in shares]


def hard_class(cultivated: Column, natural: Column) -> Column:
    """2 where natural >= 42, else 1 where cultivated >= 32, else 0."""
    return F.when(natural >= 42, 2).when(cultivated >= 32, 1).otherwise(0)


def encode_band(v: Column, scale: float, nodata: int, kind: str = "smallint") -> Column:
    """Value as stored in an integer band: scaled, rounded, NULL as nodata."""
    return F.coalesce(F.bround(nan_to_null(v) * scale), F.lit(nodata)).cast(kind)


def decode_band(v: Column, scale: float, nodata: int) -> Column:
    return F.when(v != nodata, v / scale)


def normal_tail(z: Column) -> Column:
    """Two-sided normal p-value by the Abramowitz-Stegun polynomial 7.1.26 (error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def cell_centre(row: Column, col: Column, x0: float, y0: float, res: float) -> tuple[Column, Column]:
    """(x, y) of a cell's centre; (x0, y0) is the upper left corner of the grid."""
    return x0 + (col + 0.5) * res, y0 - (row + 0.5) * res
