"""Order-sensitive operators over vertex tables (key, idx, x, y, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from geolith.tables import materialised

METRES_PER_DEGREE = 111_320.0
POLE_CIRCLE = 40_075_000.0


def _order(*keys: str):
    return W.partitionBy(*keys).orderBy("idx")


def with_step(vertices: DataFrame, *keys: str) -> DataFrame:
    """step: distance from the vertex before, null at the first."""
    w = _order(*keys)
    return vertices.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))


def split_runs(vertices: DataFrame, key: str, jump: float, cyclic: bool = False) -> DataFrame:
    """run: number of the stretch between jumps or missing places that a vertex is in; vertices without a place go. cyclic: the last stretch of a ring, whose end meets the first vertex within a jump, belongs to the first."""
    w = _order(key)
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    broken = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) > jump, F.lag(known).over(w) == F.lit(False), F.lit(False))
    rows = vertices.withColumn("broken", broken.cast("int")).withColumn("run", F.sum("broken").over(w)).where(known).drop("broken")
    if not cyclic:
        return rows
    whole = W.partitionBy(key)
    first, last = (F.first(F.struct("x", "y")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.last(F.struct("x", "y")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    meets = F.hypot(first["x"] - last["x"], first["y"] - last["y"]) <= jump
    return rows.withColumn("run", F.when(meets & (F.col("run") == F.max("run").over(whole)), F.min("run").over(whole)).otherwise(F.col("run")))


def densified(vertices: DataFrame, step: float, *keys: str, planar: bool = False) -> DataFrame:
    """keys, idx, part, x, y, last: edges longer than a step (km of lon/lat, or planar units) cut into equal parts. An edge along a pole is as long as its share of the globe."""
    w = _order(*keys)
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    rows = vertices.select(*keys, "idx", "x", "y", nx.alias("nx"), ny.alias("ny"))
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    if planar:
        length = F.hypot(dx, dy) / step
    else:
        pole = (F.abs("y") == 90) & (F.col("y") == F.col("ny"))
        plain = F.hypot(dx * METRES_PER_DEGREE * F.cos(F.radians((F.col("y") + F.col("ny")) / 2)), dy * METRES_PER_DEGREE)
        length = F.when(pole, F.abs(dx) / 360 * POLE_CIRCLE).otherwise(plain) / (step * 1000)
    n = F.greatest(F.lit(1), F.ceil(F.round(length, 9)))
    cut = rows.withColumn("n", F.coalesce(n, F.lit(1)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("part") / F.col("n")
    at = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) + t * (F.col(b) - F.col(a)))
    return cut.select(*keys, "idx", "part", at("x", "nx").alias("x"), at("y", "ny").alias("y"), F.col("nx").isNull().alias("last"))


def without_repeats(vertices: DataFrame, *keys: str, within: float = 0.0, grid: float | None = None) -> DataFrame:
    """Vertices that differ from the one before by more than a distance; or, with a grid, that lie in another of its cells (towards nil)."""
    w = _order(*keys)
    place = (lambda n: F.col(n)) if grid is None else (lambda n: F.when(F.col(n) < 0, F.ceil(F.col(n) / grid)).otherwise(F.floor(F.col(n) / grid)))
    step = F.greatest(*[F.abs(place(n) - F.lag(place(n)).over(w)) for n in "xy"])
    return vertices.withColumn("step_", step).where(F.col("step_").isNull() | (F.col("step_") > within)).drop("step_")


def vertex_ids(vertices: DataFrame) -> DataFrame:
    """x, y and vertex, the rank of every different place from 1 on. Places are sorted over all tasks; a task's ranks begin where those of the tasks before it end."""
    places = vertices.select("x", "y").distinct().repartitionByRange("x", "y").sortWithinPartitions("x", "y")
    places = materialised(places.withColumn("at", F.monotonically_increasing_id()))  # the task's number, and the place's within it
    task, rank = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = places.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))  # a row for each task
    before = sizes.select("task", (F.sum("n").over(W.orderBy("task")) - F.col("n")).alias("before"))
    return places.withColumn("task", task).join(F.broadcast(before), "task").select("x", "y", (F.col("before") + rank + 1).alias("vertex"))


def vertex_counts(vertices: DataFrame, *keys: str) -> DataFrame:
    """x, y and n: in how many rings' places a vertex stands; a closed ring's last vertex counts once."""
    w = W.partitionBy(*keys, "ring")
    last = (F.col("idx") == F.max("idx").over(w)) & (F.max("idx").over(w) > 0)
    first = lambda c: F.first(c).over(w.orderBy("idx"))
    closing = last & (F.col("x") == first("x")) & (F.col("y") == first("y"))
    return vertices.withColumn("closing", closing).where(~F.col("closing")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def boundary_edges(vertices: DataFrame, *keys: str) -> DataFrame:
    """x1, y1, x2, y2 of half-edges whose reverse does not occur."""
    w = W.partitionBy(*keys, "ring").orderBy("idx")
    e = vertices.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    back = e.select(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return e.join(back, ["x1", "y1", "x2", "y2"], "left_anti")


def kernel(kind: str, distance: Column, radius: float) -> Column:
    """Weight of a vertex at a distance; 0 from the radius on."""
    d = distance / radius
    value = {"average": F.lit(1.0), "linear": 1 - d, "gaussian": F.exp(-(d * d) / (2 * 1.5**2)), "tukey": (1 - d * d) * (1 - d * d)}[kind]
    return F.when(distance >= radius, F.lit(0.0)).otherwise(value)


def effective_area(vertices: DataFrame, *keys: str) -> DataFrame:
    """area: of the triangle with both neighbours; ends have none and go."""
    w = _order(*keys)
    ax, ay, bx, by = F.lag("x").over(w), F.lag("y").over(w), F.lead("x").over(w), F.lead("y").over(w)
    area = F.abs((F.col("x") - ax) * (by - ay) - (bx - ax) * (F.col("y") - ay)) / 2
    return vertices.withColumn("area", area).where("area is not null")


def smoothed_window(vertices: DataFrame, key: str, radius: float) -> DataFrame:
    """One pass of a linear kernel over path length: a vertex becomes the weighted mean of those within the radius.

    Weights are linear on either side of a vertex, so sums of values and of values
    times path length over the two half windows give the mean without a self join.
    """
    along = with_step(vertices, key).withColumn("along", F.sum(F.coalesce("step", F.lit(0.0))).over(_order(key)))

    def window(value: str, start: str, end: str) -> Column:
        return F.expr(f"sum({value}) OVER (PARTITION BY `{key}` ORDER BY along RANGE BETWEEN {start} AND {end})")

    def total(value: str) -> Column:
        """Sum of value * (radius - |distance|) over both sides; vertices at the very place stand in both and are taken out once."""
        reach, here = f"{radius!r}D", F.col("along")
        before, after, same = (f"{reach} PRECEDING", "CURRENT ROW"), ("CURRENT ROW", f"{reach} FOLLOWING"), ("CURRENT ROW", "CURRENT ROW")
        left = (radius - here) * window(value, *before) + window(f"{value} * along", *before)
        right = (radius + here) * window(value, *after) - window(f"{value} * along", *after)
        return left + right - radius * window(value, *same)

    weight = total("1.0D")
    return along.select(key, "idx", (total("x") / weight).alias("x"), (total("y") / weight).alias("y"))
