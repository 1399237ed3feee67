"""Fixed lattices: bins, ids, height layers, tiles with halo, neighbour stencils.

Everything here is a column expression or an explode of a constant array, so plans stay inside code generation; a stencil
is an equi-join on the shifted bins, never a join on distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True where a number is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def bin_of(c: Column, lower: float, spacing: float) -> Column:
    """1-based bin of a coordinate."""
    return (F.floor((c - lower) / spacing) + 1).cast("long")


def extent(nx: int, ny: int, spacing: float, offset: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float, float, float]:
    """xmin, xmax, ymin, ymax of a lattice centred at the offset."""
    return (offset[0] - nx * spacing / 2, offset[0] + nx * spacing / 2, offset[1] - ny * spacing / 2, offset[1] + ny * spacing / 2)


def with_cells(df: DataFrame, x: str, y: str, lower: tuple[float, float], spacing: tuple[float, float], shape: tuple[int, int]) -> DataFrame:
    """Adds bx, by, in_grid and the column-major cell id (null outside)."""
    bx, by = bin_of(F.col(x), lower[0], spacing[0]), bin_of(F.col(y), lower[1], spacing[1])
    inside = bx.between(1, shape[0]) & by.between(1, shape[1])
    return df.withColumns({"bx": bx, "by": by, "in_grid": inside, "cell": F.when(inside, (bx - 1) * shape[1] + by)})


def retained(df: DataFrame, x: str, y: str, z: str, min_range: float, max_range: float, half_box: float) -> DataFrame:
    """Finite returns within a range shell and outside the square exclusion box around the sensor."""
    X, Y, Z = F.col(x), F.col(y), F.col(z)
    distance = F.sqrt(X * X + Y * Y + Z * Z)
    return df.where(finite(X) & finite(Y) & finite(Z) & distance.between(min_range, max_range) & ~((F.abs(X) < half_box) & (F.abs(Y) < half_box)))


def stencil(reach: int, centre: bool = True) -> Column:
    """Array of (dx, dy) within a Chebyshev reach."""
    return F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if centre or i or j))


def neighbours(cells: DataFrame, values: DataFrame, keys: list[str], reach: int, centre: bool = True) -> DataFrame:
    """Rows of cells (keys, bx, by) joined with the values of all cells within reach; the neighbour's offset is dx, dy."""
    shifted = cells.withColumn("__d", F.explode(stencil(reach, centre))).select(*cells.columns, F.col("__d.dx").alias("dx"), F.col("__d.dy").alias("dy"))
    shifted = shifted.withColumns({"__nx": F.col("bx") + F.col("dx"), "__ny": F.col("by") + F.col("dy")})
    other = values.withColumnRenamed("bx", "__nx").withColumnRenamed("by", "__ny")
    return shifted.join(other, [*keys, "__nx", "__ny"]).drop("__nx", "__ny")


def tiles_with_halo(df: DataFrame, x: str, y: str, tile: float, halo: float) -> DataFrame:
    """Every point in its own tile (is_core) and, once each, in those whose halo holds it: tx, ty, is_core."""
    own_x, own_y = F.floor(F.col(x) / tile).cast("long"), F.floor(F.col(y) / tile).cast("long")
    low_x, high_x = F.floor((F.col(x) - halo) / tile).cast("long"), F.floor((F.col(x) + halo) / tile).cast("long")
    low_y, high_y = F.floor((F.col(y) - halo) / tile).cast("long"), F.floor((F.col(y) + halo) / tile).cast("long")
    spread = df.withColumn("tx", F.explode(F.sequence(low_x, high_x))).withColumn("ty", F.explode(F.sequence(low_y, high_y)))
    return spread.withColumn("is_core", (F.col("tx") == own_x) & (F.col("ty") == own_y))


def dilate(cells: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Cells within a Chebyshev reach of a marked one."""
    grown = cells.select(*keys, "bx", "by", F.explode(stencil(reach)).alias("__d"))
    return grown.select(*keys, (F.col("bx") + F.col("__d.dx")).alias("bx"), (F.col("by") + F.col("__d.dy")).alias("by")).distinct()


def marked_rows(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """All rows with all their columns, and marked: whether their keys are among the found ones."""
    hit = found.select(*keys).distinct().withColumn("__m", F.lit(True))
    return df.join(hit, keys, "left").withColumn("marked", F.col("__m").isNotNull()).drop("__m")


def spacing_constant(spacing: Column, known: dict[float, float]) -> Column:
    """The constant of a known lattice spacing; any other spacing is an error."""
    out = F.lit(None).cast("double")
    for s, c in known.items():
        out = F.when(F.abs(spacing - s) < 1e-9, F.lit(float(c))).otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("no constant for spacing "), spacing.cast("string"))).cast("double"))
