"""Validated fields: a value with its provenance, as a struct column.

{value, raw_text, source, confidence, status, reason}; status is auto,
low_confidence or manual_required.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S

AUTO, LOW, MANUAL = "auto", "low_confidence", "manual_required"
# Names of the fields in messages, and messages.
QUANTITY, UNIT_PRICE = "數量", "單價"
NEEDS_REVIEW = "需人工確認"
INVOICE_EMPTY, INVOICE_FORMAT, INVOICE_LOW = "發票號碼需人工確認", "發票號碼格式不符", "發票號碼信心不足"
TAX_EMPTY, TAX_FORMAT, TAX_LOW = "統一編號需人工確認", "統一編號必須是 8 碼數字", "統一編號信心不足"
NOT_POSITIVE, TOO_LOW = "必須是正整數", "信心不足"
NO_ITEMS, NO_AMOUNT = "沒有可計算的品項", "沒有可計算的金額"
AMOUNT_LOW, AMOUNT_MISSING = "數量或單價信心不足，金額需人工確認", "數量或單價缺失，無法計算金額"
TOTAL_LOW = "來源欄位低信心，需人工確認"
NO_PAIRS = "沒有可成立的數量與單價組合"
CONFLICT, ITEM_CONFLICT = "不同 Provider 結果不一致", "不同 Provider 的品項數量/單價不一致"
#: Confidence below which a field is kept but flagged.
LEAST = {"invoice": 0.6, "tax": 0.8, "number": 0.6}


def make(value: Column, raw: Column, source: Column, conf: Column, status: Column | str, reason: Column | str = "") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(value.alias("value"), S.text(raw).alias("raw_text"), S.known_source(source).alias("source"), S.confidence(conf).alias("confidence"), lit(status).alias("status"), lit(reason).alias("reason"))


def _checked(value: Column, raw: Column, source: Column, conf: Column, empty: Column, bad: Column, low: Column, reasons: tuple[str, str, str]) -> Column:
    status = F.when(empty | bad, MANUAL).when(low, LOW).otherwise(AUTO)
    reason = F.when(empty, reasons[0]).when(bad, reasons[1]).when(low, reasons[2]).otherwise("")
    return make(F.when(~(empty | bad), value), raw, source, conf, status, reason)


def invoice_field(raw: Column, source: Column, conf: Column) -> Column:
    code = S.invoice_code(raw)
    return _checked(code, raw, source, conf, code == "", ~S.is_invoice(code), S.confidence(conf) < LEAST["invoice"], (INVOICE_EMPTY, INVOICE_FORMAT, INVOICE_LOW))


def tax_field(raw: Column, source: Column, conf: Column) -> Column:
    number = S.digits(raw)
    return _checked(number, raw, source, conf, number == "", ~S.is_tax_id(number), S.confidence(conf) < LEAST["tax"], (TAX_EMPTY, TAX_FORMAT, TAX_LOW))


def number_field(raw: Column, source: Column, conf: Column, label: str) -> Column:
    number = S.integer_or_null(raw)
    bad = ~F.coalesce(number > 0, F.lit(False))
    return _checked(number, raw, source, conf, F.lit(False), bad, S.confidence(conf) < LEAST["number"], ("", label + NOT_POSITIVE, label + TOO_LOW))


def amount_field(quantity: Column, unit_price: Column) -> Column:
    """The product of two number fields."""
    both = quantity["value"].isNotNull() & unit_price["value"].isNotNull()
    sure = (quantity["status"] == AUTO) & (unit_price["status"] == AUTO)
    value = F.when(both, quantity["value"] * unit_price["value"])
    conf = F.when(both, F.least(quantity["confidence"], unit_price["confidence"])).otherwise(0.0)
    status = F.when(both & sure, AUTO).when(both, LOW).otherwise(MANUAL)
    reason = F.when(both & sure, "").when(both, AMOUNT_LOW).otherwise(AMOUNT_MISSING)
    return make(value, value, F.lit("formula"), conf, status, reason)


def rank(status: Column) -> Column:
    """0 auto, 1 low, 2 manual: the worst of several is the greatest."""
    return F.when(status == MANUAL, 2).when(status == LOW, 1).otherwise(0)


def unrank(n: Column) -> Column:
    return F.when(n >= 2, MANUAL).when(n == 1, LOW).otherwise(AUTO)
