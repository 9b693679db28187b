"""Ellipsoids and datums by name, and the shape of the earth that a projection string asks for."""

from __future__ import annotations

import math
from typing import NamedTuple

# Equatorial radius, and inverse flattening (rf) or polar radius (b).
ELLIPSOIDS = {
    "MERIT": (6378137.0, "rf", 298.257),
    "SGS85": (6378136.0, "rf", 298.257),
    "GRS80": (6378137.0, "rf", 298.257222101),
    "IAU76": (6378140.0, "rf", 298.257),
    "airy": (6377563.396, "b", 6356256.910),
    "APL4.9": (6378137.0, "rf", 298.25),
    "NWL9D": (6378145.0, "rf", 298.25),
    "mod_airy": (6377340.189, "b", 6356034.446),
    "andrae": (6377104.43, "rf", 300.0),
    "aust_SA": (6378160.0, "rf", 298.25),
    "GRS67": (6378160.0, "rf", 298.2471674270),
    "bessel": (6377397.155, "rf", 299.1528128),
    "bess_nam": (6377483.865, "rf", 299.1528128),
    "clrk66": (6378206.4, "b", 6356583.8),
    "clrk80": (6378249.145, "rf", 293.4663),
    "clrk80ign": (6378249.2, "rf", 293.4660212936269),
    "CPM": (6375738.7, "rf", 334.29),
    "delmbr": (6376428.0, "rf", 311.5),
    "engelis": (6378136.05, "rf", 298.2566),
    "evrst30": (6377276.345, "rf", 300.8017),
    "evrst48": (6377304.063, "rf", 300.8017),
    "evrst56": (6377301.243, "rf", 300.8017),
    "evrst69": (6377295.664, "rf", 300.8017),
    "evrstSS": (6377298.556, "rf", 300.8017),
    "fschr60": (6378166.0, "rf", 298.3),
    "fschr60m": (6378155.0, "rf", 298.3),
    "fschr68": (6378150.0, "rf", 298.3),
    "helmert": (6378200.0, "rf", 298.3),
    "hough": (6378270.0, "rf", 297.0),
    "intl": (6378388.0, "rf", 297.0),
    "krass": (6378245.0, "rf", 298.3),
    "kaula": (6378163.0, "rf", 298.24),
    "lerch": (6378139.0, "rf", 298.257),
    "mprts": (6397300.0, "rf", 191.0),
    "new_intl": (6378157.5, "b", 6356772.2),
    "plessis": (6376523.0, "b", 6355863.0),
    "SEasia": (6378155.0, "b", 6356773.3205),
    "walbeck": (6376896.0, "b", 6355834.8467),
    "WGS60": (6378165.0, "rf", 298.3),
    "WGS66": (6378145.0, "rf", 298.25),
    "WGS72": (6378135.0, "rf", 298.26),
    "WGS84": (6378137.0, "rf", 298.257223563),
    "sphere": (6370997.0, "b", 6370997.0),
}
# The ellipsoid of a datum (FMI is a sphere of its own).
DATUMS = {
    "WGS84": "WGS84",
    "FMI": 6371229.0,
    "GGRS87": "GRS80",
    "NAD83": "GRS80",
    "NAD27": "clrk66",
    "potsdam": "bessel",
    "carthage": "clrk80ign",
    "hermannskogel": "bessel",
    "ire65": "mod_airy",
    "nzgd49": "intl",
    "OSGB36": "airy",
}


class Ellipsoid(NamedTuple):
    a: float
    f: float  # flattening

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


def named(name: str) -> Ellipsoid:
    """An ellipsoid or datum; unknown names raise."""
    of = DATUMS.get(name, name)
    if isinstance(of, float):
        return Ellipsoid(of, 0.0)
    if of not in ELLIPSOIDS:
        raise ValueError(f"unknown ellipsoid: {name}")
    a, kind, value = ELLIPSOIDS[of]
    return Ellipsoid(a, 1 / value if kind == "rf" else 1 - value / a)


def parameters(text: str) -> dict[str, str | None]:
    """Keys and values of a projection string; flags have none."""
    return dict((p.lstrip("+").split("=", 1) + [None])[:2] for p in text.split() if p.lstrip("+"))


def degrees(value: str) -> float:
    """A number, or degrees that end in E, N (positive), W or S (negative)."""
    if value[-1:] in "WSws":
        return -float(value[:-1])
    return float(value[:-1] if value[-1:] in "ENen" else value)


def ellipsoid(given: dict[str, str | None]) -> Ellipsoid:
    """Shape of a projection string: R; or a with b, rf or f; or ellps or datum; else WGS 84. A radius alone is a sphere."""
    number = lambda k: float(given[k]) if given.get(k) else None
    if (r := number("R")) is not None:
        return Ellipsoid(r, 0.0)
    base = named(given.get("ellps") or given.get("datum") or "WGS84")
    a = number("a")
    if (b := number("b")) is not None:
        return Ellipsoid(a or base.a, 1 - b / (a or base.a))
    if (rf := number("rf")) is not None:
        return Ellipsoid(a or base.a, 1 / rf)
    if (f := number("f")) is not None:
        return Ellipsoid(a or base.a, f)
    if a is not None and not (given.get("ellps") or given.get("datum")):
        return Ellipsoid(a, 0.0)
    return Ellipsoid(a or base.a, base.f)
