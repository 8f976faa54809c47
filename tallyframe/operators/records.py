"""Whole-record rules: official fields, normalisation, review status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Messages of the record checks.
INVOICE_LOW, INVOICE_FORMAT, INVOICE_SELLER = "信心分數低於 0.6", "發票號碼必須為 2 個英文字母 + 8 位數字", "發票號碼不可使用賣方統編或印章統編"
TAX_LOW, TAX_FORMAT = "手寫統編信心分數低於 0.8", "統一編號必須為 8 位數字"
QUANTITY_LOW, QUANTITY_FORMAT = "手寫數量信心分數低於 0.8", "數量必須為 1~999 的正整數，可用逗號分隔多筆"
PRICE_LOW, PRICE_FORMAT, PRICE_RANGE = "手寫單價信心分數低於 0.8", "單價必須為正整數，可用逗號分隔多筆", "單價超過合理範圍"
LENGTHS = "數量與單價筆數不一致，請用逗號逐筆對齊"
MANUAL_INPUT = "需人工輸入"


def _error(field: str, reason: Column) -> Column:
    return F.when(reason.isNotNull(), F.struct(F.lit(field).alias("field"), reason.alias("reason")))


def official(records: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Adds the official fields (texts, empty if not valid) and errors (array of field, reason).

    records: invoice_number, tax_id, quantity, unit_price (texts) and conf_invoice,
    conf_tax, conf_quantity, conf_price. Confidence is checked first, then form. A
    record without an official invoice number has no official numbers either.
    """
    code, tax = S.invoice_code(F.col("invoice_number")), S.digits(F.col("tax_id"))
    seller = F.substring(code, 3, 8).isin(*excluded) if excluded else F.lit(False)
    bad_invoice = F.when(S.confidence(F.col("conf_invoice")) < 0.6, INVOICE_LOW).when(~S.is_invoice(code), INVOICE_FORMAT).when(seller, INVOICE_SELLER)
    bad_tax = F.when(S.confidence(F.col("conf_tax")) < 0.8, TAX_LOW).when(~S.is_tax_id(tax), TAX_FORMAT)
    q, p = S.number_list(F.col("quantity")), S.number_list(F.col("unit_price"))
    bad_q = F.when(S.confidence(F.col("conf_quantity")) < 0.8, QUANTITY_LOW).when((F.size(q) == 0) | F.exists(q, lambda x: (x <= 0) | (x > 999)), QUANTITY_FORMAT)
    bad_p = F.when(S.confidence(F.col("conf_price")) < 0.8, PRICE_LOW).when((F.size(p) == 0) | F.exists(p, lambda x: x <= 0), PRICE_FORMAT).when(F.exists(p, lambda x: x > 1_000_000), PRICE_RANGE)
    step = records.withColumns({"bad_invoice_": bad_invoice, "bad_tax_": bad_tax, "bad_q_": bad_q, "bad_p_": bad_p, "q_": q, "p_": p})
    both = F.col("bad_q_").isNull() & F.col("bad_p_").isNull()
    bad_sum = F.when(both & (F.size("q_") != F.size("p_")), LENGTHS)
    sales = F.when(both & (F.size("q_") == F.size("p_")), F.aggregate(F.zip_with("q_", "p_", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, x: a + x))
    step = step.withColumns({"bad_sum_": bad_sum, "sales_": sales})
    tax_text, total_text = S.tax_and_total(F.col("sales_").cast("string"))
    shown = lambda good, c: F.when(F.col("bad_invoice_").isNull() & good, c).otherwise("")
    errors = F.array(_error("invoiceNumber", F.col("bad_invoice_")), _error("taxId", F.col("bad_tax_")), _error("quantity", F.col("bad_q_")), _error("unitPrice", F.col("bad_p_")), _error("salesAmount", F.col("bad_sum_")))
    out = step.withColumns({
        "official_invoice": F.when(F.col("bad_invoice_").isNull(), code).otherwise(""), "official_tax": F.when(F.col("bad_tax_").isNull(), tax).otherwise(""),
        "official_quantity": shown(F.col("bad_q_").isNull(), S.list_text(F.col("q_"))), "official_price": shown(F.col("bad_p_").isNull(), S.list_text(F.col("p_"))),
        "official_sales": shown(F.col("sales_").isNotNull(), F.col("sales_").cast("string")), "official_tax_amount": shown(F.col("sales_").isNotNull(), tax_text), "official_total": shown(F.col("sales_").isNotNull(), total_text),
        "errors": F.filter(errors, lambda e: e.isNotNull()),
    })
    return out.drop("bad_invoice_", "bad_tax_", "bad_q_", "bad_p_", "bad_sum_", "q_", "p_", "sales_")


def normalized(records: DataFrame, rules=S.DIGIT_CORRECTIONS) -> DataFrame:
    """Digit corrections, form checks and totals of recognised records.

    records: invoice_number, tax_id, warnings, items (array of line_no, item_name,
    quantity, unit_price as texts or numbers, ocr_amount). Corrections touch the
    letters of an invoice number too, so one with an O or I in its prefix is rejected.
    """
    code = S.invoice_code(S.correct_digits(F.col("invoice_number"), rules))
    tax = S.digits(S.correct_digits(F.col("tax_id"), rules))
    bare = (code != "") & ~S.is_invoice(code) & S.is_tax_id(S.digits(code))
    step = records.withColumns({"code_": F.when(S.is_invoice(code), code).otherwise(""), "bare_": bare, "tax_": F.when(S.is_tax_id(tax), tax).otherwise("")})
    same = (F.col("code_") != "") & (F.col("tax_") != "") & (F.col("tax_") == F.substring("code_", 3, 8))

    def item(x: Column, i: Column) -> Column:
        q, p = S.number_from(x["quantity"], decimals=True), S.number_from(x["unit_price"])
        return F.struct(
            F.coalesce(F.when(x["line_no"] != 0, x["line_no"]), (i + 1).cast("int")).alias("line_no"), S.text(x["item_name"]).alias("item_name"), q.alias("quantity"), p.alias("unit_price"), (q * p).alias("amount"),
            x["ocr_amount"].cast("double").alias("ocr_amount"), F.when((q * p).isNotNull(), "auto").otherwise("manual_required").alias("status"),
        )

    step = step.withColumns({"same_": same, "all_": F.transform("items", item)})
    warned = F.flatten(F.transform("all_", lambda x: F.array(F.when(x["quantity"].isNull(), "quantity_missing"), F.when(x["unit_price"].isNull(), "unit_price_missing"), F.when(x["ocr_amount"] != x["amount"], "ocr_amount_mismatch"))))
    kept = F.filter("all_", lambda x: x["quantity"].isNotNull() | x["unit_price"].isNotNull() | (x["item_name"] != ""))
    step = step.withColumns({"kept_": kept, "item_warnings_": warned})
    complete = (F.size("kept_") > 0) & F.forall("kept_", lambda x: x["amount"].isNotNull())
    sales = F.when(complete, F.aggregate("kept_", F.lit(0.0), lambda a, x: a + x["amount"]))
    step = step.withColumn("sales_", sales)
    warnings = F.concat("warnings", F.array(F.when(F.col("bare_"), "invoice_number_missing_prefix"), F.when(F.col("same_"), "buyer_tax_id_same_as_invoice_number")), "item_warnings_", F.array(F.when(F.col("sales_").isNull(), "amount_needs_manual_check")))
    tax_amount = S.tax_of(F.col("sales_"))
    return step.withColumns({
        "invoice_number": F.col("code_"), "tax_id": F.when(F.col("same_"), "").otherwise(F.col("tax_")), "items": F.col("kept_"), "sales_amount": F.col("sales_"), "tax_amount": tax_amount,
        "total_amount": F.col("sales_") + tax_amount, "amount_source": F.when(F.col("sales_").isNotNull(), "formula").otherwise("none"), "warnings": F.array_distinct(F.filter(warnings, lambda w: w.isNotNull())),
    }).drop("code_", "bare_", "tax_", "same_", "all_", "kept_", "item_warnings_", "sales_")


def reviewed(records: DataFrame) -> DataFrame:
    """Adds the closing warnings, confidence_level, and the status, confidence and errors of each field."""
    open_items = (F.size("items") == 0) | F.exists("items", lambda x: x["quantity"].isNull() | x["unit_price"].isNull() | x["amount"].isNull())
    more = F.array(F.when(F.col("invoice_number") == "", "invoice_number_missing_prefix"), F.when(F.col("tax_id") == "", "buyer_tax_id_missing"), F.when(open_items, "amount_needs_manual_check"))
    step = records.withColumn("warnings", F.concat("warnings", F.filter(more, lambda w: w.isNotNull())))
    has = lambda w: F.array_contains("warnings", w)
    every = lambda f: F.when((F.size("items") > 0) & F.forall("items", lambda x: x[f].isNotNull()), "auto").otherwise("manual_required")
    given = lambda c: F.when(F.col(c).isNotNull(), "auto").otherwise("manual_required")
    statuses = {
        "invoiceNumber": F.when((F.col("invoice_number") != "") & ~has("invoice_number_missing_prefix"), "auto").otherwise("manual_required"),
        "taxId": F.when((F.col("tax_id") != "") & ~has("buyer_tax_id_same_as_invoice_number"), "low_confidence").otherwise("manual_required"),  # a tax id is never sure
        "quantity": every("quantity"), "unitPrice": every("unit_price"), "salesAmount": given("sales_amount"), "taxAmount": given("tax_amount"), "totalAmount": given("total_amount"),
    }
    level = F.when((F.size("warnings") > 0) | (F.size("items") == 0), "low").when(F.coalesce(F.exists(F.map_values("extracted_statuses"), lambda s: s == "low_confidence"), F.lit(False)), "medium").otherwise("high")
    sure = {"invoiceNumber": 0.85, "taxId": 0.85}
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("status")) for k, v in statuses.items()])
    step = step.withColumns({"confidence_level": level, "warnings": F.array_distinct("warnings"), "pairs_": pairs})
    confidence = F.map_from_entries(F.transform("pairs_", lambda x: F.struct(x["field"], F.when(x["status"] == "auto", F.when(x["field"].isin(*sure), 0.85).otherwise(0.75)).when(x["status"] == "low_confidence", 0.65).otherwise(0.0))))
    errors = F.transform(F.filter("pairs_", lambda x: x["status"] != "auto"), lambda x: F.struct(x["field"].alias("field"), F.when(x["status"] == "low_confidence", "低信心，需人工確認").otherwise("需人工確認").alias("reason"), x["status"].alias("status")))
    return step.withColumns({"field_statuses": F.map_from_entries("pairs_"), "field_confidence": confidence, "errors": errors, "processing_status": F.when((F.size(errors) > 0) | (F.size("warnings") > 0), "need_review").otherwise("done")}).drop("pairs_")


def needs_more(records: DataFrame) -> Column:
    """Whether a field is missing that another recogniser could still give."""
    blank = lambda c: S.text(F.col(c)) == ""
    return blank("invoice_number") | blank("tax_id") | blank("seller_name") | (F.size("items") <= 0) | F.exists("items", lambda x: (x["item_name"] == "") | x["quantity"].isNull() | x["unit_price"].isNull())


def manual_record(reason: Column) -> dict[str, Column]:
    """The fields of a record that is left to manual input."""
    fields = ("invoiceNumber", "taxId", "quantity", "unitPrice")
    return {
        "status": F.lit("unconfirmed"), "processing_status": F.lit("need_review"), "provider_status": F.lit("manual_required"), "confidence_level": F.lit("low"), "amount_source": F.lit("none"), "warnings": F.array(reason),
        "errors": F.array(*[F.struct(F.lit(f).alias("field"), F.lit(MANUAL_INPUT).alias("reason")) for f in fields]),
    }
