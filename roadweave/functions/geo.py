"""Geometry as expressions over longitude and latitude in degrees: SQL text that joins, windows and filters can hold."""

from __future__ import annotations

RADIUS = 6378160.187  # fixed value: metres, equatorial radius of the reference ellipsoid used for great circles
METRES_PER_DEGREE = 111319.49


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Great-circle metres; the root's argument is kept within 0..1, and equal points are 0 apart."""
    h = f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    return f"({2 * RADIUS!r} * asin(sqrt(least(1.0E0, greatest(0.0E0, {h})))))"


def bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Initial bearing, 0 to 360 degrees clockwise from north; 0 for equal points."""
    d = f"radians(({lon2}) - ({lon1}))"
    y = f"sin({d}) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d})"
    return f"CASE WHEN ({lon1}) = ({lon2}) AND ({lat1}) = ({lat2}) THEN 0.0E0 WHEN atan2({y}, {x}) < 0 THEN degrees(atan2({y}, {x})) + 360.0E0 ELSE degrees(atan2({y}, {x})) END"


def planar(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Equirectangular squared distance in metres, with a degree of longitude scaled at the first latitude."""
    return f"(pow((({lon2}) - ({lon1})) * cos(radians({lat1})) * {METRES_PER_DEGREE!r}, 2) + pow((({lat2}) - ({lat1})) * {METRES_PER_DEGREE!r}, 2))"


def turn_degree(heading_in: str, heading_out: str) -> str:
    return f"((({heading_out}) - ({heading_in}) + 360) % 360)"


def turn_type(degree: str) -> str:
    """The ranges of each kind of turn, in degrees clockwise."""
    return (
        f"CASE WHEN {degree} <= 10 OR {degree} >= 350 THEN 'straight' WHEN {degree} <= 44 THEN 'slight_right' WHEN {degree} <= 135 THEN 'right' WHEN {degree} <= 159 THEN 'sharp_right' "
        f"WHEN {degree} <= 200 THEN 'reverse' WHEN {degree} <= 224 THEN 'sharp_left' WHEN {degree} <= 315 THEN 'left' ELSE 'slight_left' END"
    )


def tile_id(lon: str, lat: str, size: float) -> str:
    """Row-major id of the tile of ``size`` degrees that holds the point."""
    return f"CAST(floor((({lat}) + 90) / {size!r}) * {int(360 / size)} + floor((({lon}) + 180) / {size!r}) AS BIGINT)"


def fixed(x: str, scale: int = 1000) -> str:
    """A double as a whole number of 1/scale, halves up, so engines agree on it."""
    return f"CAST(floor(({x}) * {scale} + 0.5E0) AS BIGINT)"
