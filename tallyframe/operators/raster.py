"""Rules on pixels as rows (page_id, x, y, r, g, b): ink, paper, and the bounds of a form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def is_blue(r: Column, g: Column, b: Column, strict: bool = True) -> Column:
    """Blue print: the crop's rule, or the detector's looser one."""
    least, over_r, over_g, most = (85, 1.12, 1.04, 190) if strict else (78, 1.08, 1.02, 205)
    return (b > least) & (b > r * over_r) & (b > g * over_g) & (r < most)


def dark_bounds(pixels: DataFrame, dark: float = 205.0, rows: int = 1, columns: int = 1) -> DataFrame:
    """(page_id, top, bottom, left_, right_): first and last row and column that hold so many dark pixels."""
    ink = pixels.where(luminance(F.col("r"), F.col("g"), F.col("b")) < dark)
    edge = lambda axis, least, a, b: ink.groupBy("page_id", axis).agg(F.count("*").alias("n")).where(F.col("n") >= least).groupBy("page_id").agg(F.min(axis).alias(a), F.max(axis).alias(b))
    return edge("y", rows, "top", "bottom").join(edge("x", columns, "left_", "right_"), "page_id", "full_outer")
