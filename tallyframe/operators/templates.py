"""Form templates: normalised, saved once per id, matched to pages by the seller's tax id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def region(x: Column, y: Column, w: Column, h: Column, fallback: tuple[float, float, float, float]) -> Column:
    """Shares of the page: x and y in [0, 1], w and h in [0.01, 1]."""
    side = lambda c, d: F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(d))))
    return F.struct(S.clamp_ratio(x, F.lit(fallback[0])).alias("x"), S.clamp_ratio(y, F.lit(fallback[1])).alias("y"), side(w, fallback[2]).alias("w"), side(h, fallback[3]).alias("h"))


def pixels(r: Column, width: float, height: float) -> Column:
    """A region in whole pixels inside the page."""
    x, y = F.least(r["x"], F.lit(0.99)), F.least(r["y"], F.lit(0.99))
    w, h = F.least(r["w"], F.lit(1.0) - x), F.least(r["h"], F.lit(1.0) - y)
    size = lambda c: F.greatest(F.lit(1), S.round_half_up(c).cast("int"))
    return F.struct(S.round_half_up(x * width).cast("int").alias("left"), S.round_half_up(y * height).cast("int").alias("top"), size(w * width).alias("width"), size(h * height).alias("height"))


def save(templates: DataFrame, new: DataFrame, key: str = "template_id", when: str = "updated_at") -> DataFrame:
    """Templates with the new ones put in; the latest of each id stays."""
    latest = Window.partitionBy(key).orderBy(F.desc(when), F.desc("new_"))
    both = templates.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("rank_", F.row_number().over(latest)).where("rank_ = 1").drop("rank_", "new_")


def match(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """pages(page_id, text) with template_id and reason: the first template whose tax id stands in
    the text, else the first template.

    Every run of eight digits of a text is a key of an equi-join, so neither side is broadcast whole or crossed."""
    first = templates.orderBy("template_id").limit(1).select(F.col("template_id").alias("default_id"))
    runs = F.flatten(F.transform(F.regexp_extract_all(S.text(F.col("text")), F.lit("([0-9]{8,})"), F.lit(1)), lambda d: F.transform(F.sequence(F.lit(1), F.length(d) - 7), lambda i: F.substr(d, i, F.lit(8)))))
    keys = pages.select("page_id", F.explode(F.array_distinct(runs)).alias("vendor_tax_id"))
    hits = keys.join(templates.where(F.col("vendor_tax_id") != "").select("vendor_tax_id", "template_id"), "vendor_tax_id").groupBy("page_id").agg(F.min("template_id").alias("found_id"))
    joined = pages.select("page_id").join(hits, "page_id", "left").join(F.broadcast(first), how="cross")
    return joined.select("page_id", F.coalesce("found_id", "default_id").alias("template_id"), F.when(F.col("found_id").isNotNull(), "seller-tax-id").otherwise("default-template").alias("reason"))
