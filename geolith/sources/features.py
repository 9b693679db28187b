"""Feature tables: chosen attributes and geometry of a database or file, filtered at the source."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


class Host(NamedTuple):
    """Where a database is, as options of the JDBC source."""

    host: str
    database: str
    user: str
    password: str
    port: int = 5432

    def options(self) -> dict[str, str]:
        return {"url": f"jdbc:postgresql://{self.host}:{self.port}/{self.database}?options=-c%20TimeZone=UTC", "user": self.user, "password": self.password, "driver": "org.postgresql.Driver"}

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table by schema.name, read lazily; filters and columns are pushed down."""
        return spark.read.format("jdbc").options(**self.options()).option("dbtable", name).load()


#: Bounds, in metres, of projected features.
BOUNDS = (-3e7, -3e7, 3e7, 3e7)


def read_features(layer: DataFrame, fields: list[str] | None = None, where: str | None = None, compatible: bool = False, geom: str | None = None, projection: str | None = None, source: str | None = None, bounds: tuple[float, float, float, float] = BOUNDS, densify_km: float = 50.0) -> DataFrame:
    """Columns of a layer that a WHERE text admits. Fields that the layer lacks are left out.

    compatible: integers of 64 bits that fit 32 stay as they are, missing text is empty, and columns of other types than integer, double, text and time go.
    geom: the geometry column, whose rings are closed; with a projection it is projected from its source (longitude and latitude by default), and null where nothing is left.
    """
    rows = layer.where(F.expr(where)) if where else layer
    names = [c for c in layer.columns if (fields is None or c in fields) and c != geom]
    kept = (T.IntegerType, T.LongType, T.DoubleType, T.StringType, T.TimestampType, T.TimestampNTZType)
    if compatible:
        names = [c for c in names if isinstance(layer.schema[c].dataType, kept)]
    columns = [F.coalesce(c, F.lit("")).alias(c) if compatible and isinstance(layer.schema[c].dataType, T.StringType) else F.col(c) for c in names]
    if geom is not None:
        columns.append(shaped(F.col(geom), projection, source, bounds, densify_km).alias(geom))
    return rows.select(*columns)


def shaped(geom: Column, projection: str | None, source: str | None, bounds: tuple[float, float, float, float], densify_km: float) -> Column:
    """A geometry as it is read: projected, then with its rings closed."""
    from geolith.functions.metrics import closed
    from geolith.operators import spatial

    if projection is not None:
        geom = spatial.transform(geom, projection, bounds, densify_km, source=source)
    polys = F.transform(geom["polys"], lambda p: F.transform(p, closed))
    return F.when(geom.isNotNull(), F.struct(geom["srid"].alias("srid"), polys.alias("polys"), geom["lines"].alias("lines"), geom["points"].alias("points")))


def geometry_collection(layer: DataFrame, geom: str = "geom", where: str | None = None) -> DataFrame:
    """One row with all geometries of a layer side by side, not merged; nulls go."""
    from geolith import schema

    rows = (layer.where(F.expr(where)) if where else layer).where(F.col(geom).isNotNull())
    g = F.col(geom)
    return rows.agg(schema.collected(g["polys"], g["lines"], g["points"]).alias(geom))
