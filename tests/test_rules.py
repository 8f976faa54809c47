"""Golden cases of the scalar rules, validation and reconciliation."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators import fields, merge, records, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("rule", "said", "want"),
    [
        (S.number_list, "1,000/25 7", [1, 0, 25, 7]), (S.number_list, None, []), (S.integer_or_null, "1.5", 15), (S.integer_or_null, "-3", 3), (S.integer_or_null, "", None), (S.integer_or_null, "99999999999999999", None),
        (S.confidence, "85", 0.85), (S.confidence, "1", 1.0), (S.confidence, "150", 1.0), (S.confidence, "-1", 0.0), (S.confidence, "x", 0.0), (S.confidence, "NaN", 0.0), (S.confidence, None, 0.0),
        (S.money_text, "1S,O00", "15,000"), (S.number_value, "39.5", 395), (S.number_value, "0", None), (S.numeric_cell, "a1,200.5x", 1200.5), (S.numeric_cell, ">0", 20.0), (S.numeric_cell, "x", None),
        (S.text_number, " il|2 ", 1112), (S.correct_digits, "OIl8", "0118"), (S.invoice_code, "ab-12 ", "AB12"), (S.safe_name, "x/y z.PNG", "y_z.png"), (S.safe_name, None, "invoice.jpg"), (S.public_url, "data/a/b.jpg", "/api/files/a/b.jpg"),
    ],
)
def test_scalar(spark, rule, said, want):
    assert one(spark, rule(F.lit(said).cast("string"))) == want


def test_a_last_newline_is_no_match(spark):
    assert not one(spark, S.is_invoice(F.lit("AB12345678\n")))
    assert one(spark, S.is_invoice(F.lit("AB12345678")))


def test_rounding_of_tax(spark):
    rows = spark.createDataFrame([(10,), (30,), (50,), (70,)], "s long").select(S.tax_of(F.col("s")).alias("up"), S.tax_half_even(F.col("s")).alias("even")).collect()
    assert [r["up"] for r in rows] == [1, 2, 3, 4]
    assert [r["even"] for r in rows] == [0, 2, 2, 4]


SCHEMA = "rec_id long, prio int, source string, invoice_raw string, tax_raw string, conf double, items array<struct<name:string,quantity:string,unit_price:string,conf:double>>"


def candidate(prio, invoice, tax, items, conf=0.9, source="macos_vision"):
    return (1, prio, source, invoice, tax, conf, [("", str(q), str(p), conf) for q, p in items])


def test_formula_over_items(spark):
    r = merge.validated(spark.createDataFrame([candidate(0, "VT17832862", "49403043", [(1, 150000), (1, 10000)])], SCHEMA)).first()
    assert (r["amount"]["value"], r["tax"]["value"], r["total"]["value"], r["overall_status"]) == (160000, 8000, 168000, "auto")


def test_conflict_blanks_the_field(spark):
    rows = [candidate(1, "VT17832862", "49403043", [(1, 10)]), candidate(0, "ZX17803850", "49403043", [(1, 10)], source="google_vision")]
    m = merge.merged(spark.createDataFrame(rows, SCHEMA))
    r = m.first()
    assert (r["invoice"]["status"], r["invoice"]["value"]) == ("low_confidence", None)
    assert r["invoice"]["raw_text"] == "Google Vision:ZX17803850 / macOS Vision:VT17832862"
    assert r["buyer"]["confidence"] == pytest.approx(0.98)
    assert merge.flat_fields(m).first()["invoice_number"] == ""


def test_invalid_fields_are_manual(spark):
    r = merge.validated(spark.createDataFrame([candidate(0, "17832862", "ABC", [(0, "一萬")])], SCHEMA)).first()
    assert {r["invoice"]["status"], r["buyer"]["status"], r["items"][0]["quantity"]["status"], r["amount"]["status"]} == {"manual_required"}
    assert r["warnings"] == [fields.NO_PAIRS]


def test_low_confidence_is_kept(spark):
    r = merge.validated(spark.createDataFrame([candidate(0, "VT17832862", "49403043", [(1, 150000)], conf=0.59)], SCHEMA)).first()
    assert (r["buyer"]["value"], r["buyer"]["status"], r["amount"]["value"], r["amount"]["status"]) == ("49403043", "low_confidence", 150000, "low_confidence")


def test_items_that_differ_are_lowered_and_unsure_ones_dropped(spark):
    sure = [("a", "1", "10", 0.9), ("b", "2", "10", 0.1)]
    rows = [(1, 0, "paddleocr", "", "", 0.9, sure), (1, 1, "macos_vision", "", "", 0.9, [("a", "1", "10", 0.9)]), (2, 0, "paddleocr", "", "", 0.9, sure), (2, 1, "macos_vision", "", "", 0.9, [("a", "3", "10", 0.9)])]
    found = {r["rec_id"]: r for r in merge.merged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found[1]["items"]) == 1 and found[1]["amount"]["value"] == 10 and found[1]["amount"]["status"] == "auto"
    assert found[2]["items"][0]["quantity"]["status"] == "low_confidence" and found[2]["amount"]["value"] is None and fields.ITEM_CONFLICT in found[2]["warnings"]


def test_record_without_invoice_has_no_numbers(spark):
    rows = [("AB12345678", "12345678", "1,2", "10,20"), ("bad", "12345678", "1", "10"), ("AB12345678", "1", "1,2", "10"), ("AB00000100", "12345678", "1000", "10")]
    df = spark.createDataFrame(rows, "invoice_number string, tax_id string, quantity string, unit_price string").select("*", *[F.lit(1.0).alias(f"conf_{k}") for k in ("invoice", "tax", "quantity", "price")])
    found = records.official(df, ("00000100",)).collect()
    assert [(r["official_quantity"], r["official_sales"], r["official_total"]) for r in found] == [("1,2", "50", "53"), ("", "", ""), ("1,2", "", ""), ("", "", "")]
    assert [e["reason"] for e in found[2]["errors"]] == [records.TAX_FORMAT, records.LENGTHS]
    assert [e["reason"] for e in found[3]["errors"]] == [records.INVOICE_SELLER, records.QUANTITY_FORMAT]


def test_normalising_rejects_corrected_prefixes(spark):
    schema = "invoice_number string, tax_id string, warnings array<string>, items array<struct<line_no:int,item_name:string,quantity:string,unit_price:string,ocr_amount:bigint>>"
    rows = [("OI12345678", "12345678", [], [(0, "x", "2", "100", 300)]), ("AB12345678", "12345678", [], [(0, "", "1.5", "10", None), (0, "", None, None, None)])]
    a, b = records.normalized(spark.createDataFrame(rows, schema)).collect()
    assert a["invoice_number"] == "" and a["tax_id"] == "12345678" and a["warnings"] == ["ocr_amount_mismatch"]
    assert b["tax_id"] == "" and "buyer_tax_id_same_as_invoice_number" in b["warnings"]
    assert [i["line_no"] for i in b["items"]] == [1] and b["total_amount"] == 16.0


def test_overlay_and_edits(spark):
    got = one(spark, store.overlay(F.expr("map('a', '1', 'b', '2')"), F.expr("map('b', '3')")))
    assert got == {"a": "1", "b": "3"}
    assert one(spark, store.sales_of(F.lit("1,2"), F.lit("10"))) == 0
    items = one(spark, store.line_items(F.lit("1,2"), F.lit("10"), F.array(F.lit("x"))))
    assert [(i["line_no"], i["item_name"], i["amount"], i["status"]) for i in items] == [(1, "x", 10, "auto"), (2, "", None, "manual_required")]


def test_modes(spark):
    modes = {m: (one(spark, S.effective_mode(F.lit(m))), one(spark, S.default_mode(F.lit(m)))) for m in ("Hybrid", "paddle_ocr", "", "nope")}
    assert modes == {"Hybrid": ("hybrid", "hybrid"), "paddle_ocr": ("local", "paddleocr"), "": ("local", "local"), "nope": ("local", "local")}


def test_service_numbers(spark):
    from tallyframe.sources import documents

    said = {"3": 3.0, "null": 0.0, "true": 1.0, "false": 0.0, '"true"': None, '" 4e1 "': 40.0, '""': 0.0, '"4x"': None, '"Infinity"': None, '"1d"': None, "{}": None}
    rows = spark.createDataFrame([(k, f'{{"fields": {{"items": [{{"quantity": {k}}}]}}}}') for k in said], "k string, answer string")
    found = {r["k"]: r["c"]["items"][0]["quantity"] for r in rows.select("k", documents.service_candidate(rows["answer"]).alias("c")).collect()}
    assert found == said
    for text in ("", "no", "[1]", '{"fields": {"items": 4}}', None):
        c = spark.createDataFrame([(text,)], "answer string").select(documents.service_candidate(F.col("answer")).alias("c")).first()["c"]
        assert c["items"] == [] and c["warnings"] == [] and c["invoice_no"] is None and c["invoice_confidence"] == 0.0
