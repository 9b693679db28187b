"""Closed-form map projections and their inverses, once for columns and arrays alike.

A projection string selects one; its formulas are written over a small set of
functions that exist for Spark columns and for numpy arrays, so both forms give
the same places. Conformal projections and the azimuthal equal-area one are on the
ellipsoid the string names (WGS 84 by default; ``+R=`` makes it a sphere). The
others are on a sphere of its equatorial radius. Places that a projection cannot
show give null (columns) or not a number (arrays). Strings that are not listed
raise. Datums are not shifted: longitude and latitude are on the string's own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import Column, functions as F

from geolith.functions.ellipsoids import Ellipsoid, degrees, ellipsoid, named, parameters

__all__ = ["A", "XY", "degrees", "forward", "forward_array", "grid_north", "inverse", "inverse_array", "parameters", "projection"]

A = named("WGS84").a
XY = tuple[Column, Column]
_HALF = math.pi / 2


class _Columns:
    """Functions of columns."""

    sin, cos, tan, asin, atan, atan2 = F.sin, F.cos, F.tan, F.asin, F.atan, F.atan2
    sinh, cosh, tanh, asinh, exp, log, sqrt, hypot, abs = F.sinh, F.cosh, F.tanh, F.asinh, F.exp, F.log, F.sqrt, F.hypot, F.abs

    @staticmethod
    def power(x: Any, y: float) -> Column:
        return F.pow(x, F.lit(y))

    @staticmethod
    def mod(x: Column, y: float) -> Column:
        return F.pmod(x, F.lit(y))

    @staticmethod
    def where(test: Column, x: Any, y: Any) -> Column:
        return F.when(test, x).otherwise(y)

    @staticmethod
    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))

    @staticmethod
    def iterate(start: Column, step: Callable[[Column], Column], rounds: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda t, _: step(t))


class _Arrays:
    """The same of arrays."""

    sin, cos, tan, asin, atan, atan2 = np.sin, np.cos, np.tan, np.arcsin, np.arctan, np.arctan2
    sinh, cosh, tanh, asinh, exp, log, sqrt, hypot, abs = np.sinh, np.cosh, np.tanh, np.arcsinh, np.exp, np.log, np.sqrt, np.hypot, np.abs
    power, mod, where = np.power, np.mod, np.where

    @staticmethod
    def clamp(x: np.ndarray) -> np.ndarray:
        return np.clip(x, -1.0, 1.0)

    @staticmethod
    def iterate(start: np.ndarray, step: Callable[[np.ndarray], np.ndarray], rounds: int) -> np.ndarray:
        for _ in range(rounds):
            start = step(start)
        return start


class Given(NamedTuple):
    """Parameters of a projection: earth, angles in radians (lon_0 in degrees), scale."""

    earth: Ellipsoid
    lon_0: float
    lat_0: float
    lat_1: float
    lat_2: float
    lat_ts: float | None
    k_0: float
    o_lon_p: float
    o_lat_p: float


# -- latitudes of the ellipsoid -------------------------------------------------

def _isometric(m: Any, e: float, phi: Any) -> Any:
    """The ordinate of Mercator on a unit ellipsoid."""
    s = m.sin(phi)
    y = m.log((1 + s) / (1 - s)) / 2
    return y - (e / 2) * m.log((1 + e * s) / (1 - e * s)) if e else y


def _from_isometric(m: Any, e: float, psi: Any) -> Any:
    """The latitude, by fixed-point steps (each gains two digits and more)."""
    s = m.tanh(psi)
    if e:
        s = m.iterate(s, lambda v: m.tanh(psi + (e / 2) * m.log((1 + e * v) / (1 - e * v))), 8)
    return m.asin(m.clamp(s))


def _q(m: Any, e: float, phi: Any) -> Any:
    """Twice the area between the equator and a latitude, a radian wide, on a unit ellipsoid."""
    s = m.sin(phi)
    if not e:
        return 2 * s
    return (1 - e * e) * (s / (1 - e * e * s * s) + m.log((1 + e * s) / (1 - e * s)) / (2 * e))


def _parallel(earth: Ellipsoid, phi: float) -> float:
    """Radius of a parallel on a unit ellipsoid."""
    return math.cos(phi) / math.sqrt(1 - earth.e2 * math.sin(phi) ** 2)


_number = _Arrays


def _one(f: Callable, *args: Any) -> float:
    """A formula of one number."""
    return float(f(_number, *args[:-1], np.float64(args[-1])))


# -- projections: forward (lam, phi in radians) and inverse, in metres without offsets ----

def _merc_scale(g: Given) -> float:
    return g.earth.a * (g.k_0 if g.lat_ts is None else _parallel(g.earth, g.lat_ts))


def _merc(m: Any, g: Given, lam: Any, phi: Any) -> tuple:
    k = _merc_scale(g)
    return m.abs(phi) < _HALF - 1e-12, k * lam, k * _isometric(m, g.earth.e, phi)


def _merc_back(m: Any, g: Given, x: Any, y: Any) -> tuple:
    k = _merc_scale(g)
    return None, x / k, _from_isometric(m, g.earth.e, y / k)


def _webmerc(m: Any, g: Given, lam: Any, phi: Any) -> tuple:
    return m.abs(phi) < _HALF - 1e-12, g.earth.a * lam, g.earth.a * m.log(m.tan(math.pi / 4 + phi / 2))


def _webmerc_back(m: Any, g: Given, x: Any, y: Any) -> tuple:
    return None, x / g.earth.a, 2 * m.atan(m.exp(y / g.earth.a)) - _HALF


def _eqc(m: Any, g: Given, lam: Any, phi: Any) -> tuple:
    return None, g.earth.a * math.cos(g.lat_ts or 0.0) * lam, g.earth.a * (phi - g.lat_0)


def _eqc_back(m: Any, g: Given, x: Any, y: Any) -> tuple:
    return None, x / (g.earth.a * math.cos(g.lat_ts or 0.0)), y / g.earth.a + g.lat_0


def _sinu(m: Any, g: Given, lam: Any, phi: Any) -> tuple:
    return None, g.earth.a * lam * m.cos(phi), g.earth.a * phi


def _sinu_back(m: Any, g: Given, x: Any, y: Any) -> tuple:
    phi = y / g.earth.a
    lam = x / (g.earth.a * m.cos(phi))
    return (m.abs(phi) < _HALF) & (m.abs(lam) <= math.pi + 1e-9), lam, phi


def _moll(m: Any, g: Given, lam: Any, phi: Any) -> tuple:
    target = math.pi * m.sin(phi)
    theta = m.iterate(phi, lambda t: t - m.where(m.cos(t) > 1e-9, (2 * t + m.sin(2 * t) - target) / (2 + 2 * m.cos(2 * t)), 0.0), 12)
    return None, 2 * math.sqrt(2) / math.pi * g.earth.a * lam * m.cos(theta), math.sqrt(2) * g.earth.a * m.sin(theta)


def _moll_back(m: Any, g: Given, x: Any, y: Any) -> tuple:
    v = y / (math.sqrt(2) * g.earth.a)
    theta = m.asin(m.clamp(v))
    lam = math.pi * x / (2 * math.sqrt(2) * g.earth.a * m.cos(theta))
    return (m.abs(v) < 1) & (m.abs(lam) <= math.pi + 1e-9), lam, m.asin(m.clamp((2 * theta + m.sin(2 * theta)) / math.pi))


def _seen(m: Any, lam: Any, phi: Any, phi_0: float) -> tuple:
    """Components to the east and north, and cosine of the angle from the centre."""
    c = math.sin(phi_0) * m.sin(phi) + math.cos(phi_0) * m.cos(phi) * m.cos(lam)
    return m.cos(phi) * m.sin(lam), math.cos(phi_0) * m.sin(phi) - math.sin(phi_0) * m.cos(phi) * m.cos(lam), c


def _unseen(m: Any, x: Any, y: Any, rho: Any, angle: Any, phi_0: float) -> tuple:
    """lam and phi of a place at an angle from the centre, in the direction of x, y."""
    far = m.where(rho > 1e-12, rho, 1.0)
    phi = m.asin(m.clamp(m.cos(angle) * math.sin(phi_0) + y * m.sin(angle) * math.cos(phi_0) / far))
    lam = m.atan2(x * m.sin(angle), rho * math.cos(phi_0) * m.cos(angle) - y * math.sin(phi_0) * m.sin(angle))
    return m.where(rho > 1e-12, lam, 0.0), m.where(rho > 1e-12, phi, phi_0)


def _laea_frame(g: Given) -> tuple[float, float, float, float]:
    """q of the pole, authalic latitude of the centre, authalic radius, and the stretch to the east."""
    e = g.earth.e
    qp = _one(_q, e, _HALF)
    beta = math.asin(max(-1.0, min(1.0, _one(_q, e, g.lat_0) / qp)))
    r = g.earth.a * math.sqrt(qp / 2)
    d = 1.0 if abs(abs(g.lat_0) - _HALF) < 1e-9 else g.earth.a * _parallel(g.earth, g.lat_0) / (r * math.cos(beta))
    return qp, beta, r, d


def _laea(m: Any, g: Given, lam: Any, phi: Any) -> tuple:
    qp, beta_0, r, d = _laea_frame(g)
    beta = m.asin(m.clamp(_q(m, g.earth.e, phi) / qp)) if g.earth.e else phi
    x, y, c = _seen(m, lam, beta, beta_0)
    b = r * m.sqrt(2 / (1 + c))
    return c > -1 + 1e-12, b * d * x, b / d * y


def _laea_back(m: Any, g: Given, x: Any, y: Any) -> tuple:
    qp, beta_0, r, d = _laea_frame(g)
    u, v = x / d, y * d
    rho = m.hypot(u, v)
    lam, beta = _unseen(m, u, v, rho, 2 * m.asin(m.clamp(rho / (2 * r))), beta_0)
    e2 = g.earth.e2
    phi = beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * m.sin(2 * beta) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * m.sin(4 * beta) + 761 * e2**3 / 45360 * m.sin(6 * beta)
    return rho <= 2 * r, lam, phi


def _aeqd(m: Any, g: Given, lam: Any, phi: Any) -> tuple:
    x, y, c = _seen(m, lam, phi, g.lat_0)
    s = m.sqrt(x * x + y * y)
    k = m.where(s > 1e-12, m.atan2(s, c) / m.where(s > 1e-12, s, 1.0), 1.0)
    return (s > 1e-12) | (c > 0), g.earth.a * k * x, g.earth.a * k * y


def _aeqd_back(m: Any, g: Given, x: Any, y: Any) -> tuple:
    rho = m.hypot(x, y)
    return rho <= math.pi * g.earth.a, *_unseen(m, x, y, rho, rho / g.earth.a, g.lat_0)


def _ortho(m: Any, g: Given, lam: Any, phi: Any) -> tuple:
    x, y, c = _seen(m, lam, phi, g.lat_0)
    return c >= 0, g.earth.a * x, g.earth.a * y


def _ortho_back(m: Any, g: Given, x: Any, y: Any) -> tuple:
    rho = m.hypot(x, y)
    return rho <= g.earth.a, *_unseen(m, x, y, rho, m.asin(m.clamp(rho / g.earth.a)), g.lat_0)


def _gnom(m: Any, g: Given, lam: Any, phi: Any) -> tuple:
    x, y, c = _seen(m, lam, phi, g.lat_0)
    near = m.where(c > 1e-10, c, 1.0)
    return c > 1e-10, g.earth.a * x / near, g.earth.a * y / near


def _gnom_back(m: Any, g: Given, x: Any, y: Any) -> tuple:
    rho = m.hypot(x, y)
    return None, *_unseen(m, x, y, rho, m.atan(rho / g.earth.a), g.lat_0)


def _polar_scale(g: Given) -> float:
    """Radius at a unit of exp(-isometric latitude)."""
    e = g.earth.e
    if g.lat_ts is not None and abs(abs(g.lat_ts) - _HALF) > 1e-9:
        return g.earth.a * _parallel(g.earth, abs(g.lat_ts)) * math.exp(_one(_isometric, e, abs(g.lat_ts)))
    return 2 * g.earth.a * g.k_0 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))


def _conformal(m: Any, e: float, phi: Any) -> Any:
    return 2 * m.atan(m.exp(_isometric(m, e, phi))) - _HALF if e else phi


def _oblique_scale(g: Given) -> tuple[float, float]:
    chi = _one(_conformal, g.earth.e, g.lat_0)
    return 2 * g.earth.a * g.k_0 * _parallel(g.earth, g.lat_0) / math.cos(chi), chi


def _stere(m: Any, g: Given, lam: Any, phi: Any) -> tuple:
    if abs(abs(g.lat_0) - _HALF) < 1e-9:
        up = math.copysign(1.0, g.lat_0)
        beyond = m.abs(phi + up * _HALF) < 1e-12
        top = m.abs(phi - up * _HALF) < 1e-12
        rho = m.where(top, 0.0, _polar_scale(g) * m.exp(-up * _isometric(m, g.earth.e, m.where(beyond | top, 0.0, phi))))
        return ~beyond, rho * m.sin(lam), -up * rho * m.cos(lam)
    k, chi_0 = _oblique_scale(g)
    pole = m.abs(phi) >= _HALF - 1e-12
    x, y, c = _seen(m, lam, m.where(pole, phi, _conformal(m, g.earth.e, m.where(pole, 0.0, phi))), chi_0)
    return c > -1 + 1e-12, k * x / (1 + c), k * y / (1 + c)


def _stere_back(m: Any, g: Given, x: Any, y: Any) -> tuple:
    rho = m.hypot(x, y)
    if abs(abs(g.lat_0) - _HALF) < 1e-9:
        up = math.copysign(1.0, g.lat_0)
        phi = m.where(rho > 1e-9, up * _from_isometric(m, g.earth.e, -m.log(m.where(rho > 1e-9, rho, 1.0) / _polar_scale(g))), up * _HALF)
        return None, m.where(rho > 1e-9, m.atan2(x, -up * y), 0.0), phi
    k, chi_0 = _oblique_scale(g)
    lam, chi = _unseen(m, x, y, rho, 2 * m.atan(rho / k), chi_0)
    return None, lam, _from_isometric(m, g.earth.e, m.log(m.tan(math.pi / 4 + chi / 2))) if g.earth.e else chi


def _cone(g: Given) -> tuple[float, float, float]:
    """Constant of the cone, radius at the equator, and radius at the origin."""
    e, psi = g.earth.e, lambda v: _one(_isometric, g.earth.e, v)
    m1 = _parallel(g.earth, g.lat_1)
    n = math.sin(g.lat_1) if abs(g.lat_1 - g.lat_2) < 1e-12 else math.log(m1 / _parallel(g.earth, g.lat_2)) / (psi(g.lat_2) - psi(g.lat_1))
    k = g.earth.a * g.k_0 * m1 * math.exp(n * psi(g.lat_1)) / n
    return n, k, 0.0 if abs(abs(g.lat_0) - _HALF) < 1e-9 else k * math.exp(-n * psi(g.lat_0))


def _lcc(m: Any, g: Given, lam: Any, phi: Any) -> tuple:
    n, k, rho_0 = _cone(g)
    ok = m.abs(phi) < _HALF - 1e-12
    rho = k * m.exp(-n * _isometric(m, g.earth.e, m.where(ok, phi, 0.0)))
    return ok, rho * m.sin(n * lam), rho_0 - rho * m.cos(n * lam)


def _lcc_back(m: Any, g: Given, x: Any, y: Any) -> tuple:
    n, k, rho_0 = _cone(g)
    s = math.copysign(1.0, n)
    rho = s * m.hypot(x, rho_0 - y)
    ok = m.abs(rho) > 1e-9
    return ok, m.atan2(s * x, s * (rho_0 - y)) / n, _from_isometric(m, g.earth.e, -m.log(m.where(ok, rho, k) / k) / n)


class _Series(NamedTuple):
    radius: float
    forth: tuple[float, ...]
    back: tuple[float, ...]


def _krueger(earth: Ellipsoid) -> _Series:
    """Radius of the rectifying sphere, and coefficients of the series in the third flattening."""
    n = earth.f / (2 - earth.f)
    radius = earth.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forth = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return _Series(radius, forth, back)


def _rectified(g: Given) -> float:
    """Rectifying latitude of the origin."""
    xi = math.atan(math.sinh(_one(_isometric, g.earth.e, g.lat_0)))
    return xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(_krueger(g.earth).forth))


def _tmerc(m: Any, g: Given, lam: Any, phi: Any) -> tuple:
    s = _krueger(g.earth)
    pole = m.abs(phi) >= _HALF - 1e-12
    t = m.sinh(_isometric(m, g.earth.e, m.where(pole, 0.0, phi)))
    xi, eta = m.where(pole, phi, m.atan2(t, m.cos(lam))), m.where(pole, 0.0, m.asinh(m.sin(lam) / m.hypot(t, m.cos(lam))))
    x = eta + sum(c * m.cos(2 * (j + 1) * xi) * m.sinh(2 * (j + 1) * eta) for j, c in enumerate(s.forth))
    y = xi + sum(c * m.sin(2 * (j + 1) * xi) * m.cosh(2 * (j + 1) * eta) for j, c in enumerate(s.forth))
    return m.abs(eta) <= 2.6234, g.k_0 * s.radius * x, g.k_0 * s.radius * (y - _rectified(g))


def _tmerc_back(m: Any, g: Given, x: Any, y: Any) -> tuple:
    s = _krueger(g.earth)
    eta, xi = x / (g.k_0 * s.radius), y / (g.k_0 * s.radius) + _rectified(g)
    e = eta - sum(c * m.cos(2 * (j + 1) * xi) * m.sinh(2 * (j + 1) * eta) for j, c in enumerate(s.back))
    n = xi - sum(c * m.sin(2 * (j + 1) * xi) * m.cosh(2 * (j + 1) * eta) for j, c in enumerate(s.back))
    tau = m.sin(n) / m.hypot(m.sinh(e), m.cos(n))
    return m.abs(eta) <= 2.6234, m.atan2(m.sinh(e), m.cos(n)), _from_isometric(m, g.earth.e, m.asinh(tau))


_SHAPES: dict[str, tuple[Callable, Callable]] = {
    "merc": (_merc, _merc_back),
    "webmerc": (_webmerc, _webmerc_back),
    "eqc": (_eqc, _eqc_back),
    "sinu": (_sinu, _sinu_back),
    "moll": (_moll, _moll_back),
    "laea": (_laea, _laea_back),
    "aeqd": (_aeqd, _aeqd_back),
    "ortho": (_ortho, _ortho_back),
    "gnom": (_gnom, _gnom_back),
    "stere": (_stere, _stere_back),
    "lcc": (_lcc, _lcc_back),
    "tmerc": (_tmerc, _tmerc_back),
    "utm": (_tmerc, _tmerc_back),
}
GEOGRAPHIC = ("longlat", "latlong", "lonlat", "latlon")
_UNITS = {"m": 1.0, "km": 1000.0, "us-ft": 1200 / 3937, "ft": 0.3048}


class Projection:
    """A projection string, ready to be applied to columns or arrays."""

    def __init__(self, text: str):
        given = parameters(text)
        self.name = given.get("proj")
        self.rotated = self.name == "ob_tran" and given.get("o_proj") in GEOGRAPHIC
        self.geographic = self.name in GEOGRAPHIC
        if not (self.rotated or self.geographic or self.name in _SHAPES):
            raise ValueError(f"unsupported projection: {text}")
        value = lambda k, d: degrees(given[k]) if given.get(k) else d
        angle = lambda k, d: math.radians(value(k, d))
        x_0, y_0, k_0, lon_0 = value("x_0", 0.0), value("y_0", 0.0), value("k_0", value("k", 1.0)), value("lon_0", 0.0)
        if self.name == "utm":
            zone = int(value("zone", 0))
            if not 1 <= zone <= 60:
                raise ValueError(f"a zone from 1 to 60 is needed: {text}")
            x_0, y_0, k_0, lon_0 = 500_000.0, 10_000_000.0 if "south" in given else 0.0, 0.9996, 6.0 * zone - 183
        lat_1 = angle("lat_1", 33.0 if self.name == "lcc" and not given.get("lat_0") else value("lat_0", 33.0))
        self.given = Given(
            earth=ellipsoid(given), lon_0=lon_0, lat_0=angle("lat_0", 90.0 if self.name == "stere" else 0.0), lat_1=lat_1,
            lat_2=angle("lat_2", 45.0 if self.name == "lcc" and not given.get("lat_1") and not given.get("lat_0") else math.degrees(lat_1)),
            lat_ts=angle("lat_ts", 0.0) if given.get("lat_ts") else None, k_0=k_0, o_lon_p=value("o_lon_p", 0.0), o_lat_p=angle("o_lat_p", 90.0),
        )
        self.unit = float(given["to_meter"]) if given.get("to_meter") else _UNITS[given.get("units") or "m"]
        self.x_0, self.y_0 = x_0, y_0

    def _turned(self, m: Any, lon: Any) -> Any:
        d = lon - self.given.lon_0
        return m.where(m.abs(d) <= 180.0, d, m.mod(d + 180.0, 360.0) - 180.0)

    def forth(self, m: Any, lon: Any, lat: Any) -> tuple:
        """Whether a place shows (None: always), and x and y."""
        g = self.given
        if self.geographic:
            return None, lon, lat
        if self.rotated:
            d, p = math.pi / 180 * (lon - g.lon_0), math.pi / 180 * lat
            x, y, z = m.cos(p) * m.cos(d), m.cos(p) * m.sin(d), m.sin(p)
            turned = m.atan2(y, math.sin(g.o_lat_p) * x + math.cos(g.o_lat_p) * z) * (180 / math.pi) + g.o_lon_p
            return None, m.mod(turned + 180.0, 360.0) - 180.0, m.asin(m.clamp(math.sin(g.o_lat_p) * z - math.cos(g.o_lat_p) * x)) * (180 / math.pi)
        ok, x, y = _SHAPES[self.name][0](m, g, self._turned(m, lon) * (math.pi / 180), lat * (math.pi / 180))
        return ok, (x + self.x_0) / self.unit, (y + self.y_0) / self.unit

    def back(self, m: Any, x: Any, y: Any) -> tuple:
        """Whether there is such a place (None: always), and longitude and latitude."""
        g = self.given
        if self.geographic:
            return None, x, y
        if self.rotated:
            d, p = math.pi / 180 * (x - g.o_lon_p), math.pi / 180 * y
            u, v, w = m.cos(p) * m.cos(d), m.cos(p) * m.sin(d), m.sin(p)
            lon = m.atan2(v, math.sin(g.o_lat_p) * u - math.cos(g.o_lat_p) * w) * (180 / math.pi) + g.lon_0
            return None, m.mod(lon + 180.0, 360.0) - 180.0, m.asin(m.clamp(math.sin(g.o_lat_p) * w + math.cos(g.o_lat_p) * u)) * (180 / math.pi)
        ok, lam, phi = _SHAPES[self.name][1](m, g, x * self.unit - self.x_0, y * self.unit - self.y_0)
        lon = lam * (180 / math.pi) + g.lon_0
        return ok, m.where(m.abs(lon) <= 180.0, lon, m.mod(lon + 180.0, 360.0) - 180.0), phi * (180 / math.pi)


def projection(text: str) -> Projection:
    return Projection(text)


def _of_columns(f: Callable) -> Callable[[Column, Column], XY]:
    def run(x: Column, y: Column) -> XY:
        ok, u, v = f(_Columns, x, y)
        return (u, v) if ok is None else (F.when(ok, u), F.when(ok, v))

    return run


def _of_arrays(f: Callable) -> Callable[[np.ndarray], np.ndarray]:
    def run(places: np.ndarray) -> np.ndarray:
        places = np.asarray(places, np.float64).reshape(-1, 2)
        with np.errstate(all="ignore"):
            ok, x, y = f(_Arrays, places[:, 0], places[:, 1])
        out = np.stack([x, y], axis=1)
        out[~np.isfinite(out).all(axis=1) | (False if ok is None else ~ok)] = np.nan
        return out

    return run


def forward(text: str) -> Callable[[Column, Column], XY]:
    """Columns of longitude and latitude to x and y."""
    return _of_columns(projection(text).forth)


def inverse(text: str) -> Callable[[Column, Column], XY]:
    """Columns of x and y to longitude and latitude."""
    return _of_columns(projection(text).back)


def forward_array(text: str) -> Callable[[np.ndarray], np.ndarray]:
    """Rows of longitude and latitude to rows of x and y."""
    return _of_arrays(projection(text).forth)


def inverse_array(text: str) -> Callable[[np.ndarray], np.ndarray]:
    """Rows of x and y to rows of longitude and latitude."""
    return _of_arrays(projection(text).back)


def between(source: str, target: str) -> Callable[[Column, Column], XY]:
    """Columns of one system to another, through longitude and latitude."""
    there, on = inverse(source), forward(target)
    return lambda x, y: on(*there(x, y))


def grid_north(project: Callable[[Column, Column], XY], lon: Column, lat: Column, step: float = 1e-4) -> Column:
    """Degrees from grid north to true north: the direction of a small step along the meridian, taken southwards next to the pole."""
    turn = lat + step > 90
    x1, y1 = project(lon, F.when(turn, lat - step).otherwise(lat))
    x2, y2 = project(lon, F.when(turn, lat).otherwise(lat + step))
    return F.degrees(F.atan2(x2 - x1, y2 - y1))
