"""Coordinate grids and cell masks as long tables (i, j, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

# A cell is a pole's when one side is so many times the other; it comes from a projection fault when it is so many metres wide; it is oblong when it is so many times as high as wide, or the reverse. The first of invalid, pole, flat, huge, oblong and the windings that holds is a cell's quality.
POLE, HUGE, OBLONG = 1000, 1e6, 100


def generate(spark: SparkSession, nx: int, ny: int, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """i, j, x, y of nx * ny places spread evenly from corner to corner."""
    if nx < 2 or ny < 2:
        raise ValueError("a grid needs two places a side")
    cells = spark.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    return cells.select("i", "j", (x1 + F.col("i") * ((x2 - x1) / (nx - 1))).alias("x"), (y1 + F.col("j") * ((y2 - y1) / (ny - 1))).alias("y"))


def bilinear(points: DataFrame, grid: DataFrame, nx: int, ny: int, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """points (x, y, ...) with px, py interpolated between the four corners of their grid cell (px, py by i, j); nulls outside."""
    inside = F.col("x").between(x1, x2) & F.col("y").between(y1, y2)
    fx, fy = (F.col("x") - x1) / (x2 - x1) * (nx - 1), (F.col("y") - y1) / (y2 - y1) * (ny - 1)
    i, j = F.least(F.floor(fx), F.lit(nx - 2)), F.least(F.floor(fy), F.lit(ny - 2))
    corner = [F.col("px"), F.col("py")]
    four = None
    for di in (0, 1):
        for dj in (0, 1):
            part = grid.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), *[c.alias(f"{n}{di}{dj}") for c, n in zip(corner, "ab", strict=True)])
            four = part if four is None else four.join(part, ["i", "j"])
    at = points.withColumns({"i": F.when(inside, i), "j": F.when(inside, j), "u": fx - i, "v": fy - j})
    out = at.join(four, ["i", "j"], "left")
    mix = lambda n: (1 - F.col("u")) * (1 - F.col("v")) * F.col(f"{n}00") + F.col("u") * (1 - F.col("v")) * F.col(f"{n}10") + (1 - F.col("u")) * F.col("v") * F.col(f"{n}01") + F.col("u") * F.col("v") * F.col(f"{n}11")
    return out.select(*points.columns, mix("a").alias("px"), mix("b").alias("py"))


def projected(grid: DataFrame, projection: str, source: str | None = None) -> DataFrame:
    """A grid with its places in a projection, from longitude and latitude or another system; places it cannot show are null."""
    from geolith.functions import projections

    to = projections.forward(projection) if source is None else projections.between(source, projection)
    x, y = to(F.col("x"), F.col("y"))
    return grid.select("i", "j", x.alias("x"), y.alias("y"))


def cell_quality(grid: DataFrame) -> DataFrame:
    """i, j and quality of every cell: invalid, pole, huge, oblong, clockwise, counterclockwise or notconvex."""
    at = lambda di, dj, k: grid.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    cells = at(0, 0, 1).join(at(0, 1, 2), ["i", "j"]).join(at(1, 1, 3), ["i", "j"]).join(at(1, 0, 4), ["i", "j"])
    x, y = ([F.col(f"{n}{k}") for k in range(1, 5)] for n in "xy")
    missing = F.lit(False)
    for c in (*x, *y):
        missing |= c.isNull() | F.isnan(c)
    low, high = F.abs(x[3] - x[0]), F.abs(x[2] - x[1])
    dx, dy = F.greatest(*x) - F.least(*x), F.greatest(*y) - F.least(*y)
    turns = [(x[b] - x[a]) * (y[c] - y[b]) - (y[b] - y[a]) * (x[c] - x[b]) for a, b, c in ((0, 1, 2), (1, 2, 3), (2, 3, 0), (3, 0, 1))]
    every = lambda test: test(turns[0]) & test(turns[1]) & test(turns[2]) & test(turns[3])
    quality = (
        F.when(missing, "invalid")
        .when((high > low * POLE) | (low > high * POLE), "pole")
        .when((dx == 0) | (dy == 0), "invalid")
        .when((dx >= HUGE) | (dy >= HUGE), "huge")
        .when((dy / dx < 1 / OBLONG) | (dy / dx > OBLONG), "oblong")
        .when(every(lambda t: t <= 0), "clockwise")
        .when(every(lambda t: t >= 0), "counterclockwise")
        .otherwise("notconvex")
    )
    return cells.select("i", "j", quality.alias("quality"))


def needs_flipping(quality: DataFrame) -> DataFrame:
    """Counts of cells by winding, and whether the grid is likely upside down."""
    cw, ccw = (F.count_if(F.col("quality") == q) for q in ("clockwise", "counterclockwise"))
    return quality.agg(cw.alias("cw"), ccw.alias("ccw"), (ccw > 2 * cw).alias("needs_flipping"))


def wrap_shift(grid: DataFrame, height: int) -> DataFrame:
    """Column at which a global grid's middle row wraps around, 0 if it doesn't."""
    row = grid.where(F.col("j") == height // 2)
    step = F.hypot(F.col("x") - F.lead("x").over(W.orderBy("i")), F.col("y") - F.lead("y").over(W.orderBy("i")))
    gaps = row.select("i", step.alias("gap")).where("gap is not null")
    both = gaps.agg(F.max(F.struct("gap", (-F.col("i")).alias("i"))).alias("top"), F.sort_array(F.collect_list("gap"), False).alias("gaps"))  # one row of a grid
    second = F.coalesce(F.get("gaps", F.lit(1)), F.lit(0.0))
    most, at = F.col("top")["gap"], -F.col("top")["i"]
    return both.select(F.when((second <= 0.01 * most) & (most > 0) & (at > 0), at + 1).otherwise(0).alias("shift"))


def combine(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Masks (i, j, flag) joined cell by cell: and, or, xor; cells missing on one side raise no flag."""
    a, b = F.coalesce(F.col("flag"), F.lit(False)), F.coalesce(F.col("other"), F.lit(False))
    value = {"and": a & b, "or": a | b, "xor": a != b}[how]
    return left.join(right.withColumnRenamed("flag", "other"), ["i", "j"], "full").select("i", "j", value.alias("flag"))


def mask_box(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Least and largest i and j of set cells; of none, the empty box (width, height, 0, 0)."""
    on = lambda c, f: f(F.when(F.col("flag"), F.col(c)))
    return mask.agg(F.coalesce(on("i", F.min), F.lit(width)).alias("imin"), F.coalesce(on("j", F.min), F.lit(height)).alias("jmin"), F.coalesce(on("i", F.max), F.lit(0)).alias("imax"), F.coalesce(on("j", F.max), F.lit(0)).alias("jmax"))


