"""Cell bucketing for spatial joins: equi joins on grid cells, then the exact
predicate. Catalyst has no spatial join, and a nested loop would not scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slickwatch.functions.geo import as_col

#: Copies of the small side of a salted join.
SALTS = 16


def cell(value, size: float) -> Column:
    return F.floor(as_col(value) / F.lit(float(size)))


def with_point_cell(df: DataFrame, lon, lat, size: float) -> DataFrame:
    """Each point in the one cell that holds it."""
    return df.withColumn("_cx", cell(lon, size)).withColumn("_cy", cell(lat, size))


def with_box_cells(df: DataFrame, min_x, min_y, max_x, max_y, size: float) -> DataFrame:
    """Each box once per cell it touches."""
    return df.withColumn(
        "_cx", F.explode(F.sequence(cell(min_x, size), cell(max_x, size)))
    ).withColumn("_cy", F.explode(F.sequence(cell(min_y, size), cell(max_y, size))))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], salts: int = SALTS) -> DataFrame:
    """Inner join in which no key of the small ``right`` side is one task: ``left`` is dealt by ``by``, ``right`` copied."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    return dealt.join(copies, [*on, "_salt"]).drop("_salt")
