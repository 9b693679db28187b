"""WKT and SVG text of geometry columns, and parameters of projection strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from geolith.functions.position import Box


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def number(value: Column, decimals: int) -> Column:
    """A number with at most so many decimals, without trailing zeros; never -0."""
    text = F.format_string(f"%.{decimals}f", F.round(value, decimals).cast("double") + F.lit(0.0))  # -0 + 0 is 0
    return F.regexp_replace(text, r"\.?0+$", "") if decimals else text


def _pairs(points: Column, decimals: int, between: str = " ") -> Column:
    return F.transform(points, lambda p: F.concat_ws(between, number(p["x"], decimals), number(p["y"], decimals)))


def wkt_point(p: Column, decimals: int = 6) -> Column:
    return F.concat(F.lit("POINT ("), number(p["x"], decimals), F.lit(" "), number(p["y"], decimals), F.lit(")"))


def _path(points: Column, decimals: int) -> Column:
    return F.concat(F.lit("("), F.array_join(_pairs(points, decimals), ","), F.lit(")"))


def wkt_line(points: Column, decimals: int = 6) -> Column:
    return F.when(F.size(points) == 0, F.lit("LINESTRING EMPTY")).otherwise(F.concat(F.lit("LINESTRING "), _path(points, decimals)))


def _rings(polygon: Column, decimals: int) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(polygon, lambda r: _path(r, decimals)), ","), F.lit(")"))


def wkt_polygon(polygon: Column, decimals: int = 6) -> Column:
    return F.when(F.size(polygon) == 0, F.lit("POLYGON EMPTY")).otherwise(F.concat(F.lit("POLYGON "), _rings(polygon, decimals)))


def wkt(geom: Column, decimals: int = 6) -> Column:
    """WKT of a geometry struct in its least type."""
    from geolith.schema import geometry_type

    kind = geometry_type(geom)
    polys = F.transform(geom["polys"], lambda p: _rings(p, decimals))
    lines = F.transform(geom["lines"], lambda p: _path(p, decimals))
    points = F.transform(geom["points"], lambda p: F.concat(F.lit("("), number(p["x"], decimals), F.lit(" "), number(p["y"], decimals), F.lit(")")))
    named = lambda texts, name: F.transform(texts, lambda t: F.concat(F.lit(name + " "), t))
    every = F.concat(named(points, "POINT"), named(lines, "LINESTRING"), named(polys, "POLYGON"))
    single = F.concat(points, lines, polys)
    return F.when(F.size(every) == 0, F.lit("GEOMETRYCOLLECTION EMPTY")).when(F.size(every) == 1, F.get(every, F.lit(0))).when(kind == "GEOMETRYCOLLECTION", F.concat(kind, F.lit(" ("), F.array_join(every, ","), F.lit(")"))).otherwise(F.concat(kind, F.lit(" ("), F.array_join(single, ","), F.lit(")")))


def _svg(points: Column, box: Box | None, decimals: int, close: bool) -> Column:
    def place(p: Column) -> Column:
        x, y = (p["x"], p["y"]) if box is None else box.to_pixel(p["x"], p["y"])
        return F.concat_ws(" ", number(x, decimals), number(y, decimals))

    def path(p: Column) -> Column:
        more = F.when(F.size(p) > 1, F.concat(F.lit(" "), F.array_join(F.slice(p, F.lit(2), F.size(p)), " "))).otherwise(F.lit(""))
        return F.when(F.size(p) > (2 if close else 1), F.concat(F.lit("M"), F.get(p, F.lit(0)), more, F.lit("Z" if close else ""))).otherwise(F.lit(""))

    fresh = _let(F.transform(points, place), lambda shown: F.filter(shown, lambda p, i: p != F.coalesce(F.get(shown, i - 1), F.lit(""))))
    if close:
        fresh = _let(fresh, lambda p: F.when((F.size(p) > 1) & (F.get(p, F.lit(0)) == F.element_at(p, -1)), F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))
    return _let(fresh, path)


def svg_line(points: Column, box: Box | None = None, decimals: int = 1) -> Column:
    """Path of a line in a viewport; neighbours that round to one place are drawn once."""
    return _svg(points, box, decimals, False)


def svg_polygon(polygon: Column, box: Box | None = None, decimals: int = 1) -> Column:
    """Path of a polygon; rings that shrink to a line go."""
    return F.array_join(F.transform(polygon, lambda r: _svg(r, box, decimals, True)), "")


def projection_parameters(text: Column) -> Column:
    """map<string, string> of '+key=value +flag' text; flags have null values."""
    clean = F.regexp_replace(F.trim(text), r"(^|\s+)\+", " ")
    return F.str_to_map(F.trim(clean), F.lit(r"\s+"), F.lit("="))


def signed_degrees(value: Column) -> Column:
    """Degrees of '24.5E' or '60S' text: W and S are negative."""
    size = F.regexp_replace(value, "[EWNSewns]$", "").try_cast("double")
    return F.when(value.rlike("[WSws]$"), -size).otherwise(size)
