"""Dates, labels, codes and type guards as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.mathx import bind, col, finite


def month_key(date: Column) -> Column:
    """YYYY-MM of a date, a timestamp or an ISO text."""
    return F.substring(date.cast("string"), 1, 7)


def month_start(key: Column) -> Column:
    return F.to_date(key, "yyyy-MM")


def season(lat: Column, month: Column) -> Column:
    """Season by the month; south of the equator six months later."""
    m = F.when(lat < 0, (month + 5) % 12 + 1).otherwise(month)
    return (
        F.when(m.isin(10, 11), "Semis / Levée")
        .when(m.isin(12, 1, 2), "Tallage")
        .when(m.isin(3, 4), "Montaison")
        .when(m == 5, "Épiaison")
        .when(m == 6, "Maturation")
        .when(m.isin(7, 8), "Récolte / Post-récolte")
        .when(m == 9, "Jachère")
    )


def growth_stage(days: Column) -> Column:
    """Stage by the days since planting."""
    return (
        F.when(days < 0, "Pré-semis")
        .when(days <= 7, "Semis")
        .when(days <= 20, "Levée")
        .when(days <= 45, "Tallage")
        .when(days <= 65, "Montaison")
        .when(days <= 80, "Épiaison")
        .when(days <= 110, "Maturation")
        .when(days.isNotNull(), "Récolte")
    )


def age_days(seen: Column, as_of: Column) -> Column:
    """Whole days between two timestamps, 0 at least."""
    days = F.floor((F.unix_millis(as_of) - F.unix_millis(seen)) / 86_400_000.0 + 0.5)
    return F.when(days > 0, days).when(days.isNotNull(), F.lit(0).cast("long"))


def iso_millis(ms: Column) -> Column:
    """Epoch milliseconds as an ISO text with milliseconds, in UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def spot_label(prefix: str, lat, lng, digits: int = 6) -> Column:
    return F.format_string(f"{prefix}-%.{digits}f-%.{digits}f", col(lat), col(lng))


def joined(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty; null if there is none."""
    return F.nullif(F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def as_number(value: Column) -> Column:
    """A text as a finite number, else null; truth values are none."""
    return finite(value.try_cast("double"))


def as_text(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def as_texts(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull())


def hue(red: Column, green: Column, blue: Column) -> Column:
    """Hue in degrees of 0 to 255 channels; 0 of greys."""

    def of(p: Column) -> Column:
        d = p["high"] - p["low"]
        h = F.when(p["high"] == p["r"], F.try_divide(p["g"] - p["b"], d)).when(p["high"] == p["g"], F.try_divide(p["b"] - p["r"], d) + 2).otherwise(F.try_divide(p["r"] - p["g"], d) + 4)
        return F.coalesce(F.pmod(h * 60, F.lit(360.0)), F.lit(0.0))

    channels = F.struct(red.alias("r"), green.alias("g"), blue.alias("b"))
    spread = lambda c: F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), F.greatest(c["r"], c["g"], c["b"]).alias("high"), F.least(c["r"], c["g"], c["b"]).alias("low"))
    return bind(bind(channels, spread), of)


def kml_label(color: Column) -> Column:
    """1 (barley) of green hues, 0 of red ones, null of others, from a KML aabbggrr colour."""

    def of(c: Column) -> Column:
        part = lambda k: F.conv(F.substring(c, k, 2), 16, 10).cast("double")
        label = bind(hue(part(7), part(5), part(3)), lambda h: F.when(h.between(70, 170), 1).when((h < 30) | (h > 330), 0))
        return F.when(F.length(c) == 8, label)

    return bind(color, of)


def failure_notice(message: Column) -> Column:
    """What a user is told of a failure."""
    low = F.lower(message)
    own = low.contains("database") | low.contains("parcelles")
    return F.when(own, "La base des parcelles agricoles est indisponible. Essayez un rayon plus large ou vérifiez la configuration de la base de données.").otherwise(message)
