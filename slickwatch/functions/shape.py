"""Shape descriptors and the pixel-to-map transform."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from slickwatch.functions.geo import as_col


def descriptors(area, perimeter, major, minor, hull_area) -> dict[str, Column]:
    """Compactness, elongation, equivalent diameter and solidity of a blob."""
    a, p, major, minor, hull = map(as_col, (area, perimeter, major, minor, hull_area))
    return {
        "compactness": F.when(p == 0, 1.0).otherwise(F.lit(4 * math.pi) * a / (p * p)),
        "elongation": major / F.greatest(minor, F.lit(1e-6)),
        "equivalent_diameter": F.lit(2.0) * F.sqrt(a / F.lit(math.pi)),
        "solidity": a / F.greatest(hull, F.lit(1.0)),
    }


def pixel_to_map(x, y, transform: dict[str, float]) -> tuple[Column, Column]:
    """Pixel to lon/lat by a north-up geotransform ``{a, c, e, f}``."""
    return (
        F.lit(transform["c"]) + F.lit(transform["a"]) * as_col(x),
        F.lit(transform["f"]) + F.lit(transform["e"]) * as_col(y),
    )


def map_to_pixel(lon, lat, transform: dict[str, float]) -> tuple[Column, Column]:
    return (
        (as_col(lon) - F.lit(transform["c"])) / F.lit(transform["a"]),
        (as_col(lat) - F.lit(transform["f"])) / F.lit(transform["e"]),
    )
