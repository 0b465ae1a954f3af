"""Rounding, distances and projections as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom import constants as K


def col(c: Column | str | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(float(c))


def bind(value: Column, use) -> Column:
    """use(value), with value computed once a row however often it stands in there."""
    return F.get(F.transform(F.array(value), use), 0)


def round_up(x: Column, digits: int = 0) -> Column:
    """Nearest value of so many digits; ties toward plus infinity."""
    return F.floor(x + 0.5).cast("double") if not digits else F.floor(x * 10.0**digits + 0.5).cast("double") / 10.0**digits


def round_to(x: Column, thousandths: float, scale: float) -> Column:
    """round_up(x * thousandths) / scale."""
    return F.floor(x * thousandths + 0.5).cast("double") / scale


def round_even(x: Column, digits: int = 0) -> Column:
    """Nearest value; ties to even."""
    return F.bround(x, digits)


def finite(x: Column) -> Column:
    """x, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))  # greatest and least pass over nulls


def haversine_m(lng1, lat1, lng2, lat2) -> Column:
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lng2) - col(lng1)) / 2), 2)
    return 2 * K.EARTH_RADIUS_M * F.asin(F.sqrt(F.when(h < 1, h).when(h.isNotNull(), 1.0)))


def lng_scale(lat) -> Column:
    """Cosine of the latitude, .1 at least."""
    return F.greatest(F.abs(F.cos(F.radians(col(lat)))), F.lit(0.1))


def flat_km(lat1, lng1, lat2, lng2) -> Column:
    """Equirectangular distance scaled at the first point."""
    return F.hypot((col(lng2) - col(lng1)) * K.KM_PER_DEG_LNG * lng_scale(lat1), (col(lat2) - col(lat1)) * K.KM_PER_DEG_LAT)


def flat_m(lat1, lng1, lat2, lng2) -> Column:
    """Equirectangular distance with one length of a degree for both axes."""
    return F.hypot((col(lng2) - col(lng1)) * (K.M_PER_DEG * F.cos(F.radians(col(lat1)))), (col(lat2) - col(lat1)) * K.M_PER_DEG)


def degrees_for_metres(radius_m, lat) -> tuple[Column, Column]:
    """(longitude, latitude) degrees of a radius."""
    d_lat = F.degrees(col(radius_m) / K.EARTH_RADIUS_M)
    return d_lat / F.greatest(F.cos(F.radians(col(lat))), F.lit(1e-6)), d_lat


def degrees_of(radius_m: float, lat: float) -> tuple[float, float]:
    """The same on the driver, for pushed-down bounds."""
    d_lat = math.degrees(radius_m / K.EARTH_RADIUS_M)
    return d_lat / max(math.cos(math.radians(lat)), 1e-6), d_lat


def mercator(lng, lat) -> tuple[Column, Column]:
    lat = clamp(col(lat), -K.MERCATOR_MAX_LAT, K.MERCATOR_MAX_LAT)
    return K.MERCATOR_RADIUS_M * F.radians(col(lng)), K.MERCATOR_RADIUS_M * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def from_mercator(x, y) -> tuple[Column, Column]:
    """(longitude, latitude)."""
    return F.degrees(col(x) / K.MERCATOR_RADIUS_M), F.degrees(2 * F.atan(F.exp(col(y) / K.MERCATOR_RADIUS_M)) - math.pi / 2)


def metres_per_pixel(lat, zoom) -> Column:
    return K.PIXEL_M_AT_ZOOM_0 * F.cos(F.radians(col(lat))) / F.pow(F.lit(2.0), col(zoom))


def zoom_for_area(area_m2, lat, fallback: int) -> Column:
    """The zoom at which 640 pixels hold a parcel with some room, from ``fallback`` to 20."""
    width = F.greatest(F.lit(180.0), F.sqrt(col(area_m2)) * 2.2)
    zoom = F.floor(F.log2(K.PIXEL_M_AT_ZOOM_0 * F.cos(F.radians(col(lat))) * 640 / width))
    return F.greatest(F.lit(fallback).cast("long"), F.least(F.lit(20).cast("long"), zoom)).cast("int")


def tile_grid(z, x, y, pixels: int = 256) -> dict[str, Column]:
    """Upper left corner and scale, in Mercator metres, of a map tile."""
    side = 2 * math.pi * K.MERCATOR_RADIUS_M / F.pow(F.lit(2.0), col(z))
    half = math.pi * K.MERCATOR_RADIUS_M
    return {"origin_x": col(x) * side - half, "origin_y": half - col(y) * side, "scale": side / pixels}


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logistic(model: dict, columns: dict[str, Column]) -> Column:
    """Chance by a standardised logistic model; null if a feature is."""
    z = F.lit(float(model["intercept"]))
    for f, c, m, s in zip(model["features"], model["coef"], model["mean"], model["std"], strict=True):
        z = z + c * (columns[f] - m) / s
    return sigmoid(z)
