"""Sales, tax and total of invoices from their items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def invoice_totals(items: DataFrame, key: str = "rec_id") -> DataFrame:
    """Totals of the invoices all of whose items have a quantity and a unit price; others have none."""
    whole = F.bool_and(F.col("quantity").isNotNull() & F.col("unit_price").isNotNull())
    sums = items.groupBy(key).agg(F.count("*").alias("n_items"), whole.alias("complete"), F.sum(F.col("quantity") * F.col("unit_price")).alias("s"))
    sales = F.when(F.col("complete"), F.col("s"))
    return sums.select(key, "n_items", sales.alias("sales"), S.tax_of(sales).alias("tax"), (sales + S.tax_of(sales)).alias("total"), F.when(F.col("complete"), "formula").otherwise("none").alias("amount_source"))


def invoice_totals_half_even(items: DataFrame, key: str = "rec_id") -> DataFrame:
    """Subtotal over the complete items, tax with halves to the even number; none where the subtotal is 0 or missing."""
    sums = items.groupBy(key).agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("subtotal"))
    base = F.when(F.col("subtotal") != 0, F.col("subtotal"))
    return sums.select(key, "subtotal", S.tax_half_even(base).alias("tax"), (base + S.tax_half_even(base)).alias("total"))
