"""The line-item report: a row for each item of each record, and a row of totals.

records: rec_id, invoice_number, tax_id, item_name, status, confidence_level,
warnings, filename, tax_amount, total_amount (texts), items (array of structs with
pos, item_name, quantity, unit_price, amount; null or empty if none), quantity and
unit_price (lists as text, used where there are no items).

Missing numbers of items count as 0, as they do in the sheet this report replaces;
blank cells come only from the lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Labels and headings of the sheet.
CONFIRMED, UNCONFIRMED, TOTALS = "已確認", "未確認", "合計"
SHEET = "財務收據紀錄"
HEADINGS = {"invoice_number": "發票號碼", "tax_id": "統一編號", "item_name": "品名", "quantity": "數量", "unit_price": "單價", "amount": "金額", "tax": "稅金", "total": "總金額", "confirmed": "是否確認", "confidence_level": "信心等級", "warnings": "警告", "filename": "圖片檔名"}
WIDTHS = (14, 12, 24, 10, 14, 14, 14, 14, 12, 12, 36, 28)


def record_items(items: Column, quantity: Column, unit_price: Column) -> Column:
    """The items, or else what the lists say, or else one blank line."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    own = F.transform(items, lambda x: F.struct(S.text(x["item_name"]).alias("item_name"), zero(x["quantity"]).alias("quantity"), zero(x["unit_price"]).alias("unit_price"), zero(x["amount"]).alias("amount")))
    blank = F.array(F.struct(F.lit(None).cast("bigint").alias("q"), F.lit(None).cast("bigint").alias("p")))
    zipped = F.transform(F.arrays_zip(S.number_list(quantity).alias("q"), S.number_list(unit_price).alias("p")), lambda x: F.struct(x["q"].alias("q"), x["p"].alias("p")))
    pairs = F.when(F.size(zipped) > 0, zipped).otherwise(blank)
    listed = F.transform(pairs, lambda x: F.struct(F.lit("").alias("item_name"), x["q"].alias("quantity"), x["p"].alias("unit_price"), (x["q"] * x["p"]).alias("amount")))
    return F.when(F.size(F.coalesce(items, F.expr("array()").cast(own_type()))) > 0, own).otherwise(listed)


def own_type() -> str:
    return "array<struct<pos:int,item_name:string,quantity:bigint,unit_price:bigint,amount:bigint>>"


def report_lines(records: DataFrame) -> DataFrame:
    lines = records.withColumn("lines", record_items(F.col("items"), F.col("quantity"), F.col("unit_price")))
    flat = lines.select("*", F.posexplode("lines").alias("at", "x"))
    last = F.col("at") == F.size("lines") - 1
    name = F.when(F.col("x.item_name") != "", F.col("x.item_name")).otherwise(S.text(F.col("item_name")))
    return flat.select(
        "rec_id", (F.col("at") + 1).alias("line"), "invoice_number", "tax_id", name.alias("item_name"), F.col("x.quantity").alias("quantity"), F.col("x.unit_price").alias("unit_price"), F.col("x.amount").alias("amount"),
        F.when(last, S.number_value(F.col("tax_amount"))).alias("tax"), F.when(last, S.number_value(F.col("total_amount"))).alias("total"),
        F.when(F.col("status") == "confirmed", CONFIRMED).otherwise(UNCONFIRMED).alias("confirmed"), S.text(F.col("confidence_level")).alias("confidence_level"), F.coalesce(F.array_join("warnings", ", "), F.lit("")).alias("warnings"), "filename",
    )


def totals(lines: DataFrame) -> DataFrame:
    """One row: sums of the non-blank amounts, taxes and totals."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
    return lines.agg(zero("amount"), zero("tax"), zero("total"))


def with_totals(lines: DataFrame) -> DataFrame:
    """The lines and, with a null rec_id, the row of totals. Sort by rec_id (nulls last) and line."""
    foot = totals(lines)
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in lines.dtypes if name not in ("amount", "tax", "total", "confirmed")]
    return lines.unionByName(foot.select(*blank, "amount", "tax", "total", F.lit(TOTALS).alias("confirmed")))
