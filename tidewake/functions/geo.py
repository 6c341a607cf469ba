"""Longitude conventions and distances as JVM-side column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean sphere radius, WGS84 axes, metres per second to knots.
SPHERE_RADIUS_M = 6371008.8
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)
KNOTS_PER_MPS = 1.9438444924406
# No two points on Earth are farther apart than this.
MAX_DISTANCE_M = 20_040_000.0


def lon_to_360(lon: Column) -> Column:
    # + 0.0 turns the negative zero of a negative multiple of 360 into zero
    return F.pmod(lon, F.lit(360.0)) + F.lit(0.0)


def lon_to_180(lon: Column) -> Column:
    """Fold to -180..180; a positive input on the seam stays +180."""
    folded = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return F.when((folded == -180.0) & (lon > 0), F.lit(180.0)).otherwise(folded)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_dp = (p2 - p1) / 2
    half_dl = (F.radians(lon2) - F.radians(lon1)) / 2
    h = F.pow(F.sin(half_dp), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_dl), 2)
    return 2 * SPHERE_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the WGS84 ellipsoid: Vincenty's inverse formula run inside the JVM.

    The fixed-point loop over the longitude difference is an ``aggregate`` over a short
    sequence. Where it does not settle (nearly antipodal points) the sphere is used.
    """
    u1 = F.atan((1 - WGS84_F) * F.tan(F.radians(lat1)))
    u2 = F.atan((1 - WGS84_F) * F.tan(F.radians(lat2)))
    dlon = F.radians(F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0)
    fixed = F.struct(
        dlon.alias("dlon"), F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"))

    def solve(k: Column) -> Column:
        zero = F.lit(0.0)
        start = F.struct(
            k["dlon"].alias("lam"), F.lit(1.0).alias("step"), zero.alias("sin_sigma"), zero.alias("cos_sigma"),
            zero.alias("sigma"), zero.alias("sin_alpha"), zero.alias("cos2_alpha"), zero.alias("cos_2m"))

        def turn(state: Column, _: Column) -> Column:
            lam = state["lam"]
            arc = F.struct(
                F.hypot(k["c2"] * F.sin(lam), k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(lam)).alias("sin_sigma"),
                (k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(lam)).alias("cos_sigma"))

            def azimuth(g: Column) -> Column:
                sin_alpha = F.when(g["sin_sigma"] == 0, 0.0).otherwise(k["c1"] * k["c2"] * F.sin(lam) / g["sin_sigma"])
                return F.struct(
                    g["sin_sigma"].alias("sin_sigma"), g["cos_sigma"].alias("cos_sigma"),
                    F.atan2(g["sin_sigma"], g["cos_sigma"]).alias("sigma"), sin_alpha.alias("sin_alpha"))

            def middle(g: Column) -> Column:
                cos2 = 1 - g["sin_alpha"] * g["sin_alpha"]
                return F.struct(
                    *[g[n].alias(n) for n in ("sin_sigma", "cos_sigma", "sigma", "sin_alpha")],
                    cos2.alias("cos2_alpha"),
                    F.when(cos2 < 1e-15, 0.0).otherwise(g["cos_sigma"] - 2 * k["s1"] * k["s2"] / cos2).alias("cos_2m"),
                    (WGS84_F / 16 * cos2 * (4 + WGS84_F * (4 - 3 * cos2))).alias("c"))

            def moved(g: Column) -> Column:
                new_lam = k["dlon"] + (1 - g["c"]) * WGS84_F * g["sin_alpha"] * (
                    g["sigma"] + g["c"] * g["sin_sigma"] * (
                        g["cos_2m"] + g["c"] * g["cos_sigma"] * (2 * g["cos_2m"] * g["cos_2m"] - 1)))
                return bind(new_lam, lambda n: F.struct(
                    n.alias("lam"), F.abs(n - lam).alias("step"),
                    *[g[x].alias(x) for x in ("sin_sigma", "cos_sigma", "sigma", "sin_alpha", "cos2_alpha", "cos_2m")]))

            next_state = bind(arc, lambda g: bind(azimuth(g), lambda h: bind(middle(h), moved)))
            return F.when(state["step"] < 1e-12, state).otherwise(next_state)

        def finish(state: Column) -> Column:
            u_sq = state["cos2_alpha"] * (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
            series = bind(u_sq, lambda u: F.struct(
                (1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))).alias("a"),
                (u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))).alias("b")))
            m, sin_s, cos_s = state["cos_2m"], state["sin_sigma"], state["cos_sigma"]

            def metres(t: Column) -> Column:
                delta = t["b"] * sin_s * (m + t["b"] / 4 * (
                    cos_s * (2 * m * m - 1) - t["b"] / 6 * m * (4 * sin_s * sin_s - 3) * (4 * m * m - 3)))
                return WGS84_B * t["a"] * (state["sigma"] - delta)

            return F.when(state["step"] < 1e-9, bind(series, metres))

        return F.aggregate(F.sequence(F.lit(1), F.lit(30)), start, turn, finish)

    return F.when((lon1 == lon2) & (lat1 == lat2), 0.0).otherwise(
        F.coalesce(bind(fixed, solve), haversine_m(lon1, lat1, lon2, lat2))
    )


# The ellipsoid's distance lies within these factors of the sphere's.
SPHERE_LOW, SPHERE_HIGH = 0.993, 1.006


def haversine_scalar(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = (
        math.sin((p2 - p1) / 2) ** 2
        + math.cos(p1) * math.cos(p2)
        * math.sin((math.radians(lon2) - math.radians(lon1)) / 2) ** 2
    )
    return 2 * SPHERE_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


def geodesic_scalar(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Scalar twin of :func:`geodesic_m` for the sequential fold."""
    if lon1 == lon2 and lat1 == lat2:
        return 0.0
    u1 = math.atan((1 - WGS84_F) * math.tan(math.radians(lat1)))
    u2 = math.atan((1 - WGS84_F) * math.tan(math.radians(lat2)))
    dlon = math.radians((lon2 - lon1 + 180.0) % 360.0 - 180.0)
    s1, c1, s2, c2 = math.sin(u1), math.cos(u1), math.sin(u2), math.cos(u2)
    lam = dlon
    for _ in range(30):
        sin_s = math.hypot(c2 * math.sin(lam), c1 * s2 - s1 * c2 * math.cos(lam))
        cos_s = s1 * s2 + c1 * c2 * math.cos(lam)
        sigma = math.atan2(sin_s, cos_s)
        sin_a = 0.0 if sin_s == 0 else c1 * c2 * math.sin(lam) / sin_s
        cos2_a = 1 - sin_a * sin_a
        m = 0.0 if cos2_a < 1e-15 else cos_s - 2 * s1 * s2 / cos2_a
        c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
        new = dlon + (1 - c) * WGS84_F * sin_a * (
            sigma + c * sin_s * (m + c * cos_s * (2 * m * m - 1))
        )
        step, lam = abs(new - lam), new
        if step < 1e-12:
            break
    if step >= 1e-9:
        return haversine_scalar(lon1, lat1, lon2, lat2)
    u_sq = cos2_a * (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
    big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
    big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
    delta = big_b * sin_s * (
        m + big_b / 4 * (
            cos_s * (2 * m * m - 1) - big_b / 6 * m * (4 * sin_s * sin_s - 3) * (4 * m * m - 3)
        )
    )
    return WGS84_B * big_a * (sigma - delta)
