"""Candidates of several recognisers for one record, validated and reconciled.

A candidate is a row: rec_id, prio (smaller is first), source, invoice_raw, tax_raw,
conf, items (array of name, quantity, unit_price, conf). Grouping gathers a record's
candidates, a handful, into one array in order of prio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import fields as V


def _total_fields(sales: Column, conf: Column, status: Column, reason: Column) -> dict[str, Column]:
    none = sales.isNull()
    out = {}
    for name, value, missing in (("amount", sales, V.NO_ITEMS), ("tax", S.tax_of(sales), V.NO_AMOUNT), ("total", sales + S.tax_of(sales), V.NO_AMOUNT)):
        out[name] = V.make(value, value, F.lit("formula"), F.when(none, 0.0).otherwise(conf), F.when(none, V.MANUAL).otherwise(status), F.when(none, missing).otherwise(reason))
    return out


def validated(candidates: DataFrame) -> DataFrame:
    """Candidates with invoice, tax_id, items (fields), amount, tax, total and overall_status."""

    def item(x: Column) -> Column:
        q, p = V.number_field(x["quantity"], F.col("source"), x["conf"], V.QUANTITY), V.number_field(x["unit_price"], F.col("source"), x["conf"], V.UNIT_PRICE)
        return F.struct(F.substring(S.text(x["name"]), 1, 80).alias("name"), q.alias("quantity"), p.alias("unit_price"))

    step = candidates.withColumns({"invoice": V.invoice_field(F.col("invoice_raw"), F.col("source"), F.col("conf")), "buyer": V.tax_field(F.col("tax_raw"), F.col("source"), F.col("conf")), "items": F.transform("items", item)})
    step = step.withColumn("items", F.transform("items", lambda x: F.struct(x["name"].alias("name"), x["quantity"].alias("quantity"), x["unit_price"].alias("unit_price"), V.amount_field(x["quantity"], x["unit_price"]).alias("amount"))))
    good = F.filter("items", lambda x: x["amount"]["value"].isNotNull())
    step = step.withColumn("good_", good)
    sales = F.when(F.size("good_") > 0, F.aggregate("good_", F.lit(0).cast("bigint"), lambda a, x: a + x["amount"]["value"]))
    conf = F.array_min(F.transform("good_", lambda x: F.least(x["quantity"]["confidence"], x["unit_price"]["confidence"])))
    sure = F.forall("good_", lambda x: x["amount"]["status"] == V.AUTO)
    step = step.withColumns(_total_fields(sales, conf, F.when(sure, V.AUTO).otherwise(V.LOW), F.when(sure, "").otherwise(V.TOTAL_LOW)))
    return step.withColumns({"warnings": F.when(F.size("good_") == 0, F.array(F.lit(V.NO_PAIRS))).otherwise(F.expr("array()").cast("array<string>")), "overall_status": overall()}).drop("good_")


def overall() -> Column:
    """needs_review if any field isn't auto."""
    flat = (F.col("invoice.status") == V.AUTO) & (F.col("buyer.status") == V.AUTO) & (F.col("amount.status") == V.AUTO) & (F.col("tax.status") == V.AUTO) & (F.col("total.status") == V.AUTO)
    rows = F.forall("items", lambda x: (x["quantity"]["status"] == V.AUTO) & (x["unit_price"]["status"] == V.AUTO) & (x["amount"]["status"] == V.AUTO))
    return F.when(flat & rows, "auto").otherwise("needs_review")


def choose_field(found: Column) -> Column:
    """One field of an array of candidates' fields, in their order: of those that are
    auto the first, a little surer if others agree; none if any of them disagrees."""
    auto = F.filter(found, lambda f: f["status"] == V.AUTO)
    first = F.get(auto, F.lit(0))
    other = F.get(F.filter(auto, lambda f: f["value"] != first["value"]), F.lit(0))
    said = F.array_join(F.transform(auto, lambda f: F.concat(S.source_label(f["source"]), F.lit(":"), F.when(f["raw_text"] != "", f["raw_text"]).otherwise(f["value"].cast("string")))), " / ")
    nothing = F.lit(None)
    conflict = F.struct(nothing.cast("string").alias("value"), said.alias("raw_text"), first["source"].alias("source"), F.least(first["confidence"], other["confidence"]).alias("confidence"), F.lit(V.LOW).alias("status"), F.lit(V.CONFLICT).alias("reason"))
    surer = F.least(F.lit(1.0), first["confidence"] + F.when(F.size(auto) > 1, 0.08).otherwise(0.0))
    agreed = F.struct(first["value"].alias("value"), first["raw_text"].alias("raw_text"), first["source"].alias("source"), surer.alias("confidence"), first["status"].alias("status"), first["reason"].alias("reason"))
    return F.when(F.size(auto) == 0, F.get(found, F.lit(0))).when(other.isNotNull(), conflict).otherwise(agreed)


def signature(items: Column) -> Column:
    part = lambda f: F.coalesce(f["value"].cast("string"), F.lit(""))
    return F.array_join(F.transform(items, lambda x: F.concat(part(x["quantity"]), F.lit("x"), part(x["unit_price"]))), "|")


def merged(candidates: DataFrame) -> DataFrame:
    """One row per record: invoice, buyer, items, amount, tax, total, overall_status, warnings."""
    grouped = _gathered(validated(candidates))
    sets = F.filter(F.transform("all_", lambda c: F.filter(c["items"], lambda x: (x["quantity"]["status"] == V.AUTO) & (x["unit_price"]["status"] == V.AUTO))), lambda s: F.size(s) > 0)
    step = grouped.withColumn("sets_", sets).withColumn("first_", F.get("sets_", F.lit(0)))
    clash = F.exists("sets_", lambda s: signature(s) != signature(F.col("first_")))
    fallback = F.get(F.filter(F.transform("all_", lambda c: c["items"]), lambda s: F.size(s) > 0), F.lit(0))
    step = step.withColumns({"clash_": F.coalesce(clash, F.lit(False)), "fallback_": F.coalesce(fallback, F.get(F.transform("all_", lambda c: c["items"]), F.lit(0)))})
    low = lambda f: F.struct(f["value"].alias("value"), f["raw_text"].alias("raw_text"), f["source"].alias("source"), f["confidence"].alias("confidence"), F.lit(V.LOW).alias("status"), F.lit(V.CONFLICT).alias("reason"))
    lowered = F.transform("first_", lambda x: F.struct(F.lit("").alias("name"), low(x["quantity"]).alias("quantity"), low(x["unit_price"]).alias("unit_price"), low(x["amount"]).alias("amount")))
    step = step.withColumn("items", F.when(F.size("sets_") == 0, F.col("fallback_")).when(F.col("clash_"), lowered).otherwise(F.col("first_")))
    # Totals only count items both of whose numbers are sure.
    step = step.withColumn("sure_", F.filter("items", lambda x: (x["quantity"]["status"] == V.AUTO) & (x["unit_price"]["status"] == V.AUTO)))
    sales = F.when(F.size("sure_") > 0, F.aggregate("sure_", F.lit(0).cast("bigint"), lambda a, x: a + x["quantity"]["value"] * x["unit_price"]["value"]))
    conf = F.array_min(F.transform("sure_", lambda x: F.least(x["quantity"]["confidence"], x["unit_price"]["confidence"])))
    step = step.withColumns(_total_fields(sales, conf, F.lit(V.AUTO), F.lit("")))
    step = step.withColumns({"invoice": choose_field(F.transform("all_", lambda c: c["invoice"])), "buyer": choose_field(F.transform("all_", lambda c: c["buyer"]))})
    warnings = F.concat(F.when(F.col("clash_"), F.array(F.lit(V.ITEM_CONFLICT))).otherwise(F.expr("array()").cast("array<string>")), F.flatten(F.transform("all_", lambda c: c["warnings"])))
    step = step.withColumns({"warnings": F.array_distinct(warnings), "overall_status": overall()})
    return step.select("rec_id", "invoice", "buyer", "items", "amount", "tax", "total", "overall_status", "warnings")


def _gathered(candidates: DataFrame) -> DataFrame:
    """(rec_id, all_): a record's candidates in order of prio."""
    row = F.struct("prio", "invoice", "buyer", "items", "warnings")
    by_prio = lambda a, b: F.when(a["prio"] < b["prio"], -1).when(a["prio"] > b["prio"], 1).otherwise(0)
    return candidates.groupBy("rec_id").agg(F.collect_list(row).alias("all_")).withColumn("all_", F.array_sort("all_", by_prio))


def worst(found: Column) -> Column:
    """An array of fields as one: worst status, least confidence, else the first; the
    reason of the first that isn't auto."""
    first, n = F.get(found, F.lit(0)), F.array_max(F.transform(found, lambda f: V.rank(f["status"])))
    odd = F.get(F.filter(found, lambda f: f["status"] != V.AUTO), F.lit(0))
    reason = F.when(n == 0, first["reason"]).when(odd["reason"] != "", odd["reason"]).otherwise(first["reason"])
    whole = F.struct(first["value"].alias("value"), first["raw_text"].alias("raw_text"), first["source"].alias("source"), F.array_min(F.transform(found, lambda f: f["confidence"])).alias("confidence"), V.unrank(n).alias("status"), reason.alias("reason"))
    none = F.struct(F.lit(None).cast("bigint").alias("value"), F.lit("").alias("raw_text"), F.lit("tesseract").alias("source"), F.lit(0.0).alias("confidence"), F.lit(V.MANUAL).alias("status"), F.lit("").alias("reason"))
    return F.when(F.size(found) > 0, whole).otherwise(none)


def flat_items(items: Column) -> Column:
    """Items as the record keeps them; line numbers are given before empty ones go."""
    one = lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), x["name"].alias("item_name"), x["quantity"]["value"].alias("quantity"), x["unit_price"]["value"].alias("unit_price"), x["amount"]["value"].alias("amount"), x["quantity"]["source"].alias("source"), V.unrank(F.greatest(V.rank(x["quantity"]["status"]), V.rank(x["unit_price"]["status"]), V.rank(x["amount"]["status"]))).alias("status"), F.least(x["quantity"]["confidence"], x["unit_price"]["confidence"]).alias("confidence"))
    return F.filter(F.transform(items, one), lambda x: x["quantity"].isNotNull() | x["unit_price"].isNotNull() | x["amount"].isNotNull())


def flat_fields(merged_rows: DataFrame) -> DataFrame:
    """Texts of the record: invoice_number, tax_id, quantity, unit_price, sales_amount, tax_amount, total_amount."""
    shown = lambda c: S.text(F.col(f"{c}.value"))
    listed = lambda f: S.list_text(F.filter(F.transform("items", lambda x: x[f]["value"]), lambda v: v.isNotNull()))
    return merged_rows.select("rec_id", shown("invoice").alias("invoice_number"), shown("buyer").alias("tax_id"), listed("quantity").alias("quantity"), listed("unit_price").alias("unit_price"), shown("amount").alias("sales_amount"), shown("tax").alias("tax_amount"), shown("total").alias("total_amount"), F.size(flat_items(F.col("items"))).alias("n_items"))


def meta(merged_rows: DataFrame) -> DataFrame:
    """Sources, statuses, confidences (maps) and validation_errors of merged records."""
    step = merged_rows.withColumns({"quantity_": worst(F.transform("items", lambda x: x["quantity"])), "price_": worst(F.transform("items", lambda x: x["unit_price"]))})
    names = {"invoiceNumber": "invoice", "taxId": "buyer", "quantity": "quantity_", "unitPrice": "price_", "salesAmount": "amount", "taxAmount": "tax", "totalAmount": "total"}
    table = lambda part: F.create_map(*[y for k, c in names.items() for y in (F.lit(k), F.col(f"{c}.{part}"))])
    error = lambda name, f: F.struct(F.lit(name).alias("field"), F.when(f["reason"] != "", f["reason"]).otherwise(V.NEEDS_REVIEW).alias("reason"), f["status"].alias("status"), f["source"].alias("source"))
    rows = F.flatten(F.transform("items", lambda x: F.array(error("quantity", x["quantity"]), error("unitPrice", x["unit_price"]))))
    every = F.concat(F.array(error("invoiceNumber", F.col("invoice")), error("taxId", F.col("buyer"))), rows, F.array(error("salesAmount", F.col("amount"))))
    return step.select("rec_id", table("source").alias("field_sources"), table("status").alias("field_statuses"), table("confidence").alias("field_confidence"), F.filter(every, lambda e: e["status"] != V.AUTO).alias("validation_errors"))
