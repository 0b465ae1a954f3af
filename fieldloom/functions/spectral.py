"""Spectral and radar indices as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.mathx import round_to, round_up


def first_set(*bands: Column) -> Column:
    """The first band that is neither null nor 0; the last one as it is."""
    return F.coalesce(*[F.when(b != 0, b) for b in bands[:-1]], bands[-1])


def normalized(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def bare_soil(swir: Column, red: Column, nir: Column, blue: Column) -> Column:
    return F.try_divide((swir + red) - (nir + blue), (swir + red) + (nir + blue))


def snapshot(nir: Column, red: Column, green: Column, blue: Column) -> dict[str, Column]:
    """Indices of one acquisition from raw counts: NDVI in whole percent, NDWI to three digits, EVI and SAVI in percent to one digit."""
    ndvi = round_up(round_to(normalized(nir, red), 1000, 10.0))
    evi = round_to(F.try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 10_000), 1000, 10.0)
    savi = round_to(F.try_divide(nir - red, nir + red + 0.5) * 1.5, 1000, 10.0)
    return {"ndvi": ndvi, "ndwi": round_to(normalized(green, nir), 1000, 1000.0), "evi": round_to(evi, 10, 10.0), "savi": round_to(savi, 10, 10.0)}


def reflectance(raw: Column) -> Column:
    """Counts as a fraction; 0 and NaN are no data."""
    return F.when((raw != 0) & ~F.isnan(raw), raw / 10_000)


def clean_index(a: Column, b: Column) -> Column:
    """Normalised difference, of which exactly -1 is no data."""
    v = normalized(a, b)
    return F.when(v != -1, v)


def monthly(bands: dict[str, Column]) -> dict[str, Column]:
    """NDVI, EVI, NDRE and NDMI of reflectances."""
    b2, b4, b5, b8, b11 = (bands[k] for k in ("B2", "B4", "B5", "B8", "B11"))
    return {"NDVI": clean_index(b8, b4), "EVI": F.try_divide(2.5 * (b8 - b4), b8 + 6 * b4 - 7.5 * b2 + 1), "NDRE": clean_index(b8, b5), "NDMI": clean_index(b8, b11)}


def senescence(b2: Column, b4: Column, b6: Column) -> Column:
    return (b4 - b2) / (b6 + 1e-4)


def moisture(b8: Column, b11: Column) -> Column:
    return b11 / (b8 + 1e-4)


def field_pixel(nir: Column, red: Column, green: Column, blue: Column, swir: Column) -> Column:
    """Whether a pixel may be a field: green, not wet, not built, not bare."""
    return (normalized(nir, red) > 0.15) & (normalized(green, nir) < 0.1) & (normalized(swir, nir) < 0.05) & (bare_soil(swir, red, nir, blue) < 0.25)


def radar(vv: Column, vh: Column) -> dict[str, Column]:
    """Backscatter to two digits and its ratio to three."""
    return {"vv": round_to(vv, 100, 100.0), "vh": round_to(vh, 100, 100.0), "vh_vv": round_to(F.try_divide(vh, vv), 1000, 1000.0)}


def soil_type(swir: Column, nir: Column) -> Column:
    ratio = F.try_divide(swir, nir)
    return F.when(ratio > 1.5, "Sol argileux sec").when(ratio > 1.0, "Sol limoneux").when(ratio.isNotNull(), "Sol humide")


def ndvi_zone(ndvi: Column) -> Column:
    """high, mid or low; null of no data; what is out of range is low."""
    return F.when(ndvi.isNull() | F.isnan(ndvi), F.lit(None).cast("string")).when((ndvi >= 0.75) & (ndvi < 1.01), "high").when((ndvi >= 0.35) & (ndvi < 0.75), "mid").otherwise("low")
