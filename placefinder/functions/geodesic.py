"""Distances on the WGS 84 spheroid, as native columns.

The usual iteration for the difference of longitude on the auxiliary sphere answers nearly every pair of points. It
doesn't settle where they are almost opposite each other; there the azimuth at the first point is halved down
instead, as the longitude that is reached grows with it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 spheroid.
MAJOR_M, FLATTENING = 6378137.0, 1 / 298.257223563
MINOR_M = MAJOR_M * (1 - FLATTENING)
_SECOND = (MAJOR_M**2 - MINOR_M**2) / MINOR_M**2
#: Steps of each search; pairs that have not settled to this angle go to the second.
STEPS, HALVINGS, SETTLED = 20, 60, 1e-12


def _drift(sin0: Column, sigma: Column, sin_s: Column, cos_s: Column, mid: Column) -> Column:
    """How much longer the way round the auxiliary sphere is than the difference of longitude."""
    cos2 = 1 - sin0 * sin0
    c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
    return (1 - c) * FLATTENING * sin0 * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1)))


def _length(sin0: Column, sigma: Column, sin_s: Column, cos_s: Column, mid: Column) -> Column:
    """Metres of an arc ``sigma`` of the auxiliary sphere."""
    u = (1 - sin0 * sin0) * _SECOND
    a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    bend = b * sin_s * (mid + b / 4 * (cos_s * (2 * mid * mid - 1) - b / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)))
    return F.lit(MINOR_M) * a * (sigma - bend)


def _reduced(lat: Column) -> Column:
    return F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(lat)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _arc(p: Column, turn: Column) -> Column:
    """sin0, sigma, sin_s, cos_s, mid for a difference ``turn`` of longitude on the auxiliary sphere."""
    s1, c1, s2, c2 = p["s1"], p["c1"], p["s2"], p["c2"]
    across = c1 * s2 - s1 * c2 * F.cos(turn)
    sin_s = F.sqrt(F.pow(c2 * F.sin(turn), 2) + across * across)
    cos_s = s1 * s2 + c1 * c2 * F.cos(turn)

    def rest(v: Column) -> Column:
        sin0 = F.when(v["sin_s"] > 0, c1 * c2 * F.sin(turn) / v["sin_s"]).otherwise(0.0)
        cos2 = 1 - sin0 * sin0
        mid = F.when(cos2 > 1e-15, v["cos_s"] - 2 * s1 * s2 / cos2).otherwise(0.0)
        return F.struct(sin0.alias("sin0"), F.atan2(v["sin_s"], v["cos_s"]).alias("sigma"), v["sin_s"].alias("sin_s"), v["cos_s"].alias("cos_s"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mid)).alias("mid"))

    return _let(F.struct(sin_s.alias("sin_s"), cos_s.alias("cos_s")), rest)


_parts = lambda a: (a["sin0"], a["sigma"], a["sin_s"], a["cos_s"], a["mid"])


def _way(p: Column, azimuth: Column) -> Column:
    """The same five values, and the longitude reached, for an azimuth at the first point.

    The first point is the one farther from the equator, and south of it.
    """
    s1, c1, s2, c2 = p["s1"], p["c1"], p["s2"], p["c2"]
    sin0 = F.sin(azimuth) * c1
    north1 = F.cos(azimuth) * c1
    north2 = F.sqrt(F.greatest(north1 * north1 + (s1 - s2) * (s1 + s2), F.lit(0.0)))

    def rest(v: Column) -> Column:
        one, two = F.atan2(s1, v["north1"]), F.atan2(s2, v["north2"])
        round_ = F.atan2(v["sin0"] * s2, v["north2"]) - F.atan2(v["sin0"] * s1, v["north1"])
        return F.struct(v["sin0"].alias("sin0"), (two - one).alias("sigma"), F.sin(two - one).alias("sin_s"), F.cos(two - one).alias("cos_s"), F.cos(one + two).alias("mid"), round_.alias("round"))

    arc = _let(F.struct(sin0.alias("sin0"), north1.alias("north1"), north2.alias("north2")), rest)
    return _let(arc, lambda a: F.struct(*(a[n].alias(n) for n in ("sin0", "sigma", "sin_s", "cos_s", "mid")), (a["round"] - _drift(*_parts(a))).alias("reached")))


def _opposite(p: Column) -> Column:
    """Metres between points that are almost opposite each other, by halving the azimuth."""
    swap = F.abs(p["s1"]) < F.abs(p["s2"])
    sa, ca, sb, cb = (F.when(swap, p[x]).otherwise(p[y]) for x, y in (("s2", "s1"), ("c2", "c1"), ("s1", "s2"), ("c1", "c2")))
    south = F.when(sa > 0, -1.0).otherwise(1.0)
    # A first point on the equator counts as one just south of it.
    turned = F.struct(F.least(sa * south, F.lit(-1e-200)).alias("s1"), ca.alias("c1"), (sb * south).alias("s2"), cb.alias("c2"), p["turn"].alias("turn"))

    def search(q: Column) -> Column:
        def halve(span: Column, _: Column) -> Column:
            middle = (span["low"] + span["high"]) / 2
            short = _way(q, middle)["reached"] < q["turn"]
            return _let(F.struct(middle.alias("m"), short.alias("short")), lambda v: F.struct(F.when(v["short"], v["m"]).otherwise(span["low"]).alias("low"), F.when(v["short"], span["high"]).otherwise(v["m"]).alias("high")))

        start = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi).alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda span: _let(_way(q, (span["low"] + span["high"]) / 2), lambda a: _length(*_parts(a))))

    return _let(turned, search)


def spheroid_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres of the shortest way on the spheroid; null if a coordinate is null, 0 between equal points."""
    turn = F.abs(F.pmod(F.radians(lon2 - lon1) + math.pi, F.lit(2 * math.pi)) - math.pi)
    given = F.struct(turn.alias("turn"), *(f(_reduced(lat)).alias(n) for lat, names in ((lat1, "s1 c1"), (lat2, "s2 c2")) for f, n in zip((F.sin, F.cos), names.split())))

    def answer(p: Column) -> Column:
        def step(held: Column, _: Column) -> Column:
            following = p["turn"] + _let(_arc(p, held["at"]), lambda a: _drift(*_parts(a)))
            # A pair that has settled, or gone beyond half the Earth, is left as it is.
            stays = (held["moved"] < SETTLED) | (held["at"] > math.pi)
            return F.when(stays, held).otherwise(_let(following, lambda x: F.struct(x.alias("at"), F.abs(x - held["at"]).alias("moved"))))

        start = F.struct(p["turn"].alias("at"), F.lit(1.0).alias("moved"))
        settled = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
        return _let(settled, lambda e: F.when((e["moved"] < SETTLED) & (e["at"] <= math.pi), _let(_arc(p, e["at"]), lambda a: _length(*_parts(a)))).otherwise(_opposite(p)))

    known = lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull()
    return F.when(known, F.when((lon1 == lon2) & (lat1 == lat2), 0.0).otherwise(_let(given, answer)))
