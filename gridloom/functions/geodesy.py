"""Map-projection arithmetic as column expressions.

Transverse Mercator series of Snyder, "Map Projections: A Working Manual" (USGS
Professional Paper 1395, 1987), equations 3-21, 3-26, 8-9 to 8-25, scale 0.9996 on the
central meridian. Sentinels and overrides of zones follow the usual UTM exceptions for
south-west Norway and Svalbard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: id, name, equatorial radius in metres, squared eccentricity; fixed values
ELLIPSOIDS = [
    (-1, "Placeholder", 0.0, 0.0),
    (1, "Airy", 6377563.0, 0.00667054),
    (2, "Australian National", 6378160.0, 0.006694542),
    (3, "Bessel 1841", 6377397.0, 0.006674372),
    (4, "Bessel 1841 (Nambia) ", 6377484.0, 0.006674372),
    (5, "Clarke 1866", 6378206.0, 0.006768658),
    (6, "Clarke 1880", 6378249.0, 0.006803511),
    (7, "Everest", 6377276.0, 0.006637847),
    (8, "Fischer 1960 (Mercury) ", 6378166.0, 0.006693422),
    (9, "Fischer 1968", 6378150.0, 0.006693422),
    (10, "GRS 1967", 6378160.0, 0.006694605),
    (11, "GRS 1980", 6378137.0, 0.00669438),
    (12, "Helmert 1906", 6378200.0, 0.006693422),
    (13, "Hough", 6378270.0, 0.00672267),
    (14, "International", 6378388.0, 0.00672267),
    (15, "Krassovsky", 6378245.0, 0.006693422),
    (16, "Modified Airy", 6377340.0, 0.00667054),
    (17, "Modified Everest", 6377304.0, 0.006637847),
    (18, "Modified Fischer 1960", 6378155.0, 0.006693422),
    (19, "South American 1969", 6378160.0, 0.006694542),
    (20, "WGS 60", 6378165.0, 0.006693422),
    (21, "WGS 66", 6378145.0, 0.006694542),
    (22, "WGS-72", 6378135.0, 0.006694318),
    (23, "WGS-84", 6378137.0, 0.00669438),
]
WGS84 = (6378137.0, 0.00669438)
K0 = 0.9996
BANDS = "CDEFGHJKLMNPQRSTUVWX"


def ellipsoids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ELLIPSOIDS, "id int, name string, radius double, ecc2 double")


def _trunc(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def wrap_longitude(lon: Column) -> Column:
    """Into -180..180 by truncation: values below -180 are left one turn short."""
    return (lon + 180) - _trunc((lon + 180) / 360) * 360 - 180


def zone_letter(lat: Column) -> Column:
    """Latitude band C to X; Z outside -80..84."""
    return F.when((lat < -80) | (lat > 84), F.lit("Z")).otherwise(F.substring(F.lit(BANDS), F.least(F.floor((lat + 80) / 8), F.lit(19)).cast("int") + 1, F.lit(1)))


def zone_letter_open(lat: Column) -> Column:
    """Latitude band; C also south of -80 and X also north of 84."""
    return F.substring(F.lit(BANDS), F.greatest(F.least(F.floor((lat + 80) / 8), F.lit(19)), F.lit(0)).cast("int") + 1, F.lit(1))


def zone_raw(lon: Column) -> Column:
    return (_trunc((wrap_longitude(lon) + 180) / 6) + 1).cast("int")


def zone_number(lat: Column, lon: Column, given: Column | None = None) -> Column:
    """Effective zone: the given or computed one, unless an exception applies."""
    w = wrap_longitude(lon)
    base = zone_raw(lon) if given is None else given
    north = (lat >= 72) & (lat < 84)
    return (
        F.when(north & (w >= 0) & (w < 9), 31).when(north & (w >= 9) & (w < 21), 33).when(north & (w >= 21) & (w < 33), 35).when(north & (w >= 33) & (w < 42), 37)
        .when((lat >= 56) & (lat < 64) & (w >= 3) & (w < 12), 32).otherwise(base)
    )


def zone_prefix(zone: Column) -> Column:
    """Leading digits of a zone text; NULL if there are none or they are no 32-bit number."""
    return F.nullif(F.regexp_extract(F.trim(zone), r"^[0-9]+", 0), F.lit("")).try_cast("int")


def is_north(zone: Column) -> Column:
    return F.regexp_extract(F.trim(zone), r"^[0-9]+\s*([A-Za-z])", 1) >= "N"


def _meridian_terms(e2: float) -> tuple[float, float, float, float]:
    return (
        1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256,
        3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024,
        15 * e2**2 / 256 + 45 * e2**3 / 1024,
        35 * e2**3 / 3072,
    )


def utm_forward(lat: Column, lon: Column, zone: Column | None = None, ellipsoid: tuple[float, float] = WGS84) -> dict[str, Column]:
    """zone, easting, northing. A given zone still yields to the exceptions."""
    a, e2 = ellipsoid
    ep2 = e2 / (1 - e2)
    number = zone_number(lat, lon, zone)
    phi = lat * (math.pi / 180)
    away = (wrap_longitude(lon) - ((number - 1) * 6 - 177)) * (math.pi / 180)
    sin, cos = F.sin(phi), F.cos(phi)
    nu = a / F.sqrt(1 - e2 * sin * sin)
    t = F.tan(phi) * F.tan(phi)
    c = ep2 * cos * cos
    s = away * cos
    s2 = s * s
    m0, m2, m4, m6 = _meridian_terms(e2)
    arc = a * (m0 * phi - m2 * F.sin(2 * phi) + m4 * F.sin(4 * phi) - m6 * F.sin(6 * phi))
    east = K0 * nu * s * (1 + s2 * ((1 - t + c) / 6 + s2 * (5 - 18 * t + t * t + 72 * c - 58 * ep2) / 120)) + 500000.0
    north = K0 * (arc + nu * F.tan(phi) * s2 * (0.5 + s2 * ((5 - t + 9 * c + 4 * c * c) / 24 + s2 * (61 - 58 * t + t * t + 600 * c - 330 * ep2) / 720)))
    return {"zone": number, "easting": east, "northing": F.when(lat < 0, north + 10000000.0).otherwise(north)}


def utm_inverse(easting: Column, northing: Column, zone: Column, north: Column, ellipsoid: tuple[float, float] = WGS84) -> dict[str, Column]:
    """lat, lon in degrees from a zone number and its hemisphere."""
    a, e2 = ellipsoid
    ep2 = e2 / (1 - e2)
    root = math.sqrt(1 - e2)
    e1 = (1 - root) / (1 + root)
    mu = F.when(north, northing).otherwise(northing - 10000000.0) / (K0 * a * _meridian_terms(e2)[0])
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu)
    w = 1 - e2 * F.sin(phi) * F.sin(phi)
    nu = a / F.sqrt(w)
    rho = a * (1 - e2) / (w * F.sqrt(w))
    t = F.tan(phi) * F.tan(phi)
    c = ep2 * F.cos(phi) * F.cos(phi)
    d = (easting - 500000.0) / (nu * K0)
    d2 = d * d
    lat = phi - nu * F.tan(phi) / rho * d2 * (0.5 - d2 * ((5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) / 24 - d2 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) / 720))
    lon = d * (1 - d2 * ((1 + 2 * t + c) / 6 - d2 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) / 120)) / F.cos(phi)
    return {"lat": lat * (180 / math.pi), "lon": (zone - 1) * 6 - 177 + lon * (180 / math.pi)}
