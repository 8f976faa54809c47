"""Queries on validation and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fields as V_
from ..operators import merge, records
from ..sources import views as V
from .registry import query

SELLERS = ("00000100", "00000250", "00000899")

# DuckDB macros in plain SQL: confidence, invoice and tax checks of a candidate.
_CONF = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {c} > 1 THEN {c} / 100 ELSE {c} END))"
_CODE = "regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"
_DIGITS = "regexp_replace({c}, '[^0-9]', '', 'g')"


def _status(value: str, good: str, conf: str, least: float) -> str:
    return f"CASE WHEN {value} = '' OR NOT regexp_full_match({value}, '{good}') THEN 'manual_required' WHEN {conf} < {least} THEN 'low_confidence' ELSE 'auto' END"


_FIELDS = f"""
SELECT rec_id, prio, source, conf, invoice_raw, tax_raw, code, tax, {_status('code', '[A-Z]{2}[0-9]{8}', 'conf', 0.6)} AS invoice_status, {_status('tax', '[0-9]{8}', 'conf', 0.8)} AS tax_status
FROM (SELECT *, {_CODE.format(c='invoice_raw')} AS code, {_DIGITS.format(c='tax_raw')} AS tax FROM candidates)
"""


@query(
    V.duck(
        "candidates",
        f""", f AS ({_FIELDS})
SELECT rec_id, prio, CASE WHEN invoice_status <> 'manual_required' THEN code END AS invoice, invoice_status, CASE WHEN code = '' THEN '發票號碼需人工確認' WHEN invoice_status = 'manual_required' THEN '發票號碼格式不符' WHEN invoice_status = 'low_confidence' THEN '發票號碼信心不足' ELSE '' END AS invoice_reason,
 CASE WHEN tax_status <> 'manual_required' THEN tax END AS tax_id, tax_status, CASE WHEN tax = '' THEN '統一編號需人工確認' WHEN tax_status = 'manual_required' THEN '統一編號必須是 8 碼數字' WHEN tax_status = 'low_confidence' THEN '統一編號信心不足' ELSE '' END AS tax_reason, conf AS confidence FROM f""",
    )
)
def validate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.candidates(spark, sf_dir).withColumns({"i": V_.invoice_field(F.col("invoice_raw"), F.col("source"), F.col("conf")), "t": V_.tax_field(F.col("tax_raw"), F.col("source"), F.col("conf"))})
    return c.select("rec_id", "prio", F.col("i.value").alias("invoice"), F.col("i.status").alias("invoice_status"), F.col("i.reason").alias("invoice_reason"), F.col("t.value").alias("tax_id"), F.col("t.status").alias("tax_status"), F.col("t.reason").alias("tax_reason"), F.col("i.confidence").alias("confidence"))


_ITEM_STATUS = "CASE WHEN {v} IS NULL OR {v} <= 0 THEN 'manual_required' WHEN conf < 0.6 THEN 'low_confidence' ELSE 'auto' END"
_ITEMS = f"SELECT *, {_ITEM_STATUS.format(v='quantity')} AS qs, {_ITEM_STATUS.format(v='unit_price')} AS ps FROM items"


@query(
    V.duck(
        "items",
        f""", f AS ({_ITEMS})
SELECT rec_id, pos, quantity, qs AS quantity_status, CASE qs WHEN 'manual_required' THEN '數量必須是正整數' WHEN 'low_confidence' THEN '數量信心不足' ELSE '' END AS quantity_reason, unit_price, ps AS price_status, quantity * unit_price AS amount,
 CASE WHEN quantity * unit_price IS NULL THEN 'manual_required' WHEN qs = 'auto' AND ps = 'auto' THEN 'auto' ELSE 'low_confidence' END AS amount_status, CASE WHEN quantity * unit_price IS NULL THEN CAST(0 AS DOUBLE) ELSE conf END AS amount_confidence FROM f""",
    )
)
def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.lit("paddleocr")
    i = V.items(spark, sf_dir).withColumns({"q": V_.number_field(F.col("quantity"), source, F.col("conf"), V_.QUANTITY), "p": V_.number_field(F.col("unit_price"), source, F.col("conf"), V_.UNIT_PRICE)}).withColumn("a", V_.amount_field(F.col("q"), F.col("p")))
    return i.select("rec_id", "pos", F.col("q.value").alias("quantity"), F.col("q.status").alias("quantity_status"), F.col("q.reason").alias("quantity_reason"), F.col("p.value").alias("unit_price"), F.col("p.status").alias("price_status"), F.col("a.value").alias("amount"), F.col("a.status").alias("amount_status"), F.col("a.confidence").alias("amount_confidence"))


def listed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their numbers as lists in texts."""
    grouped = V.items(spark, sf_dir).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "quantity", "unit_price"))).alias("its"))
    some = lambda f: F.coalesce(S.list_text(F.filter(F.col(f"its.{f}"), lambda x: x.isNotNull())), F.lit(""))
    return V.records(spark, sf_dir).join(grouped, "rec_id", "left").select("rec_id", F.col("invoice_raw").alias("invoice_number"), F.col("tax_raw").alias("tax_id"), "conf", some("quantity").alias("quantity"), some("unit_price").alias("unit_price"))


_LISTS = ", grouped AS (SELECT rec_id, list(quantity ORDER BY pos) FILTER (WHERE quantity IS NOT NULL) AS qs, list(unit_price ORDER BY pos) FILTER (WHERE unit_price IS NOT NULL) AS ps FROM items GROUP BY rec_id)\n"


@query(
    V.duck(
        "items records",
        _LISTS
        + f""", r AS (SELECT rec_id, {_CODE.format(c='invoice_raw')} AS code, {_DIGITS.format(c='tax_raw')} AS tax, conf, least(1.0, conf + 0.25) AS conf_n, coalesce(qs, []) AS qs, coalesce(ps, []) AS ps FROM records LEFT JOIN grouped USING (rec_id))
, e AS (SELECT *, CASE WHEN conf < 0.6 THEN '信心分數低於 0.6' WHEN NOT regexp_full_match(code, '[A-Z]{{2}}[0-9]{{8}}') THEN '發票號碼必須為 2 個英文字母 + 8 位數字' WHEN substr(code, 3, 8) IN {SELLERS} THEN '發票號碼不可使用賣方統編或印章統編' END AS e1,
 CASE WHEN conf < 0.8 THEN '手寫統編信心分數低於 0.8' WHEN NOT regexp_full_match(tax, '[0-9]{{8}}') THEN '統一編號必須為 8 位數字' END AS e2,
 CASE WHEN conf_n < 0.8 THEN '手寫數量信心分數低於 0.8' WHEN len(qs) = 0 OR len(list_filter(qs, lambda x: x <= 0 OR x > 999)) > 0 THEN '數量必須為 1~999 的正整數，可用逗號分隔多筆' END AS e3,
 CASE WHEN conf_n < 0.8 THEN '手寫單價信心分數低於 0.8' WHEN len(ps) = 0 OR len(list_filter(ps, lambda x: x <= 0)) > 0 THEN '單價必須為正整數，可用逗號分隔多筆' WHEN len(list_filter(ps, lambda x: x > 1000000)) > 0 THEN '單價超過合理範圍' END AS e4 FROM r)
, g AS (SELECT *, CASE WHEN e3 IS NULL AND e4 IS NULL AND len(qs) <> len(ps) THEN '數量與單價筆數不一致，請用逗號逐筆對齊' END AS e5, CASE WHEN e3 IS NULL AND e4 IS NULL AND len(qs) = len(ps) THEN CAST(list_sum(list_transform(range(1, len(qs) + 1), lambda i: qs[i] * ps[i])) AS BIGINT) END AS s FROM e)
SELECT rec_id, CASE WHEN e1 IS NULL THEN code ELSE '' END AS invoice, CASE WHEN e2 IS NULL THEN tax ELSE '' END AS tax_id, CASE WHEN e1 IS NULL AND e3 IS NULL THEN array_to_string(qs, ',') ELSE '' END AS quantity, CASE WHEN e1 IS NULL AND e4 IS NULL THEN array_to_string(ps, ',') ELSE '' END AS unit_price,
 CASE WHEN e1 IS NULL AND s IS NOT NULL THEN CAST(s AS VARCHAR) ELSE '' END AS sales, CASE WHEN e1 IS NULL AND s IS NOT NULL THEN CAST(CAST(floor(s * CAST(0.05 AS DOUBLE) + 0.5) AS BIGINT) AS VARCHAR) ELSE '' END AS tax, CASE WHEN e1 IS NULL AND s IS NOT NULL THEN CAST(s + CAST(floor(s * CAST(0.05 AS DOUBLE) + 0.5) AS BIGINT) AS VARCHAR) ELSE '' END AS total, concat_ws('; ', e1, e2, e3, e4, e5) AS errors FROM g""",
    )
)
def validate_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.least(F.lit(1.0), F.col("conf") + 0.25)
    rows = listed_records(spark, sf_dir).withColumns({"conf_invoice": F.col("conf"), "conf_tax": F.col("conf"), "conf_quantity": more, "conf_price": more})
    found = records.official(rows, SELLERS)
    return found.select("rec_id", F.col("official_invoice").alias("invoice"), F.col("official_tax").alias("tax_id"), F.col("official_quantity").alias("quantity"), F.col("official_price").alias("unit_price"), F.col("official_sales").alias("sales"), F.col("official_tax_amount").alias("tax"), F.col("official_total").alias("total"), F.array_join(F.transform("errors", lambda e: e["reason"]), "; ").alias("errors"))


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a recogniser gives them, with items."""
    item = F.struct("pos", F.lit(0).alias("line_no"), F.coalesce("item_name", F.lit("")).alias("item_name"), "quantity", "unit_price", "ocr_amount")
    grouped = V.items(spark, sf_dir).groupBy("rec_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = V.records(spark, sf_dir).join(grouped, "rec_id", "left")
    return rows.select("rec_id", F.col("invoice_raw").alias("invoice_number"), F.col("tax_raw").alias("tax_id"), F.lit(None).cast("string").alias("seller_name"), F.expr("array()").cast("array<string>").alias("warnings"), F.coalesce("items", F.expr("filter(array(struct(0 as pos, 0 as line_no, '' as item_name, 0L as quantity, 0L as unit_price, 0L as ocr_amount)), x -> false)")).alias("items"), F.create_map(F.lit("taxId"), F.lit("low_confidence")).alias("extracted_statuses"))


def _corrected(c: str) -> str:
    return f"replace(replace(replace({c}, 'O', '0'), 'I', '1'), 'l', '1')"


_NORMALISED = f"""
, g AS (SELECT rec_id, count(*) AS n, bool_and(quantity IS NOT NULL AND unit_price IS NOT NULL) AS complete, CAST(sum(quantity * unit_price) AS DOUBLE) AS s, bool_or(quantity IS NULL) AS no_q, bool_or(unit_price IS NULL) AS no_p, bool_or(quantity * unit_price <> ocr_amount) AS mismatch,
  min(CASE WHEN quantity IS NULL THEN pos * 3 END) AS at_q, min(CASE WHEN unit_price IS NULL THEN pos * 3 + 1 END) AS at_p, min(CASE WHEN quantity * unit_price <> ocr_amount THEN pos * 3 + 2 END) AS at_m FROM items GROUP BY rec_id)
, c AS (SELECT rec_id, {_CODE.format(c=_corrected('invoice_raw'))} AS code, {_DIGITS.format(c=_corrected('tax_raw'))} AS tax, g.* EXCLUDE (rec_id) FROM records LEFT JOIN g USING (rec_id))
, d AS (SELECT *, CASE WHEN regexp_full_match(code, '[A-Z]{{2}}[0-9]{{8}}') THEN code ELSE '' END AS inv, code <> '' AND NOT regexp_full_match(code, '[A-Z]{{2}}[0-9]{{8}}') AND regexp_full_match({_DIGITS.format(c='code')}, '[0-9]{{8}}') AS bare, CASE WHEN regexp_full_match(tax, '[0-9]{{8}}') THEN tax ELSE '' END AS tid FROM c)
, e AS (SELECT *, inv <> '' AND tid <> '' AND tid = substr(inv, 3, 8) AS same FROM d)
, f AS (SELECT *, CASE WHEN same THEN '' ELSE tid END AS tax_id, CASE WHEN complete THEN s END AS sales, list_transform(list_sort(list_filter([{{'at': 1, 'w': CASE WHEN bare THEN 'invoice_number_missing_prefix' END}}, {{'at': 2, 'w': CASE WHEN same THEN 'buyer_tax_id_same_as_invoice_number' END}},
   {{'at': at_q, 'w': CASE WHEN no_q THEN 'quantity_missing' END}}, {{'at': at_p, 'w': CASE WHEN no_p THEN 'unit_price_missing' END}}, {{'at': at_m, 'w': CASE WHEN mismatch THEN 'ocr_amount_mismatch' END}}, {{'at': 999999, 'w': CASE WHEN complete IS NOT TRUE THEN 'amount_needs_manual_check' END}}], lambda x: x.w IS NOT NULL)), lambda x: x.w) AS ws FROM e)
"""


@query(V.duck("items records", _NORMALISED + "SELECT rec_id, inv AS invoice_number, tax_id, sales AS sales_amount, CAST(floor(sales * CAST(0.05 AS DOUBLE) + 0.5) AS BIGINT) AS tax_amount, sales + CAST(floor(sales * CAST(0.05 AS DOUBLE) + 0.5) AS BIGINT) AS total_amount, CASE WHEN sales IS NULL THEN 'none' ELSE 'formula' END AS amount_source, CAST(coalesce(n, 0) AS INT) AS n_items, array_to_string(ws, ',') AS warnings FROM f"))
def normalize_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.normalized(recognised(spark, sf_dir))
    return found.select("rec_id", "invoice_number", "tax_id", "sales_amount", "tax_amount", "total_amount", "amount_source", F.size("items").alias("n_items"), F.array_join("warnings", ",").alias("warnings"))


@query(
    V.duck(
        "items records",
        _NORMALISED
        + """, h AS (SELECT *, list_distinct(list_concat(ws, list_filter([CASE WHEN inv = '' THEN 'invoice_number_missing_prefix' END, CASE WHEN tax_id = '' THEN 'buyer_tax_id_missing' END, CASE WHEN complete IS NOT TRUE THEN 'amount_needs_manual_check' END], lambda x: x IS NOT NULL))) AS w2 FROM f)
SELECT rec_id, CASE WHEN len(w2) > 0 OR n IS NULL THEN 'low' ELSE 'medium' END AS confidence_level, CASE WHEN inv <> '' THEN 'auto' ELSE 'manual_required' END AS invoice_status, CASE WHEN tax_id <> '' THEN 'low_confidence' ELSE 'manual_required' END AS tax_status,
 CASE WHEN no_q IS FALSE THEN 'auto' ELSE 'manual_required' END AS quantity_status, CASE WHEN no_p IS FALSE THEN 'auto' ELSE 'manual_required' END AS price_status, CASE WHEN sales IS NOT NULL THEN 'auto' ELSE 'manual_required' END AS sales_status,
 CASE WHEN inv <> '' THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS invoice_confidence, CASE WHEN tax_id <> '' THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END AS tax_confidence, CAST((inv = '')::INT + 1 + (no_q IS NOT FALSE)::INT + (no_p IS NOT FALSE)::INT + 3 * (sales IS NULL)::INT AS INT) AS n_errors, CAST(len(w2) AS INT) AS n_warnings, 'need_review' AS processing_status FROM h""",
    )
)
def hybrid_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.reviewed(records.normalized(recognised(spark, sf_dir)))
    status = lambda k: F.col("field_statuses")[k]
    conf = lambda k: F.col("field_confidence")[k]
    return found.select("rec_id", "confidence_level", status("invoiceNumber").alias("invoice_status"), status("taxId").alias("tax_status"), status("quantity").alias("quantity_status"), status("unitPrice").alias("price_status"), status("salesAmount").alias("sales_status"), conf("invoiceNumber").alias("invoice_confidence"), conf("taxId").alias("tax_confidence"), F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "processing_status")


def with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with items; the second recogniser misreads one quantity of every fourth record."""
    item = F.struct("pos", "item_name", "quantity", "unit_price", "conf")
    grouped = V.items(spark, sf_dir).groupBy("rec_id").agg(F.array_sort(F.collect_list(item)).alias("its"))
    rows = V.candidates(spark, sf_dir).join(grouped, "rec_id", "left")
    off = (F.col("prio") == 1) & (F.col("rec_id") % 4 == 0)
    none = F.expr("filter(array(struct('' as name, 0L as quantity, 0L as unit_price, 0D as conf)), x -> false)")
    items = F.transform("its", lambda x: F.struct(F.coalesce(x["item_name"], F.lit("")).alias("name"), (x["quantity"] + F.when(off & (x["pos"] == 1), 1).otherwise(0)).alias("quantity"), x["unit_price"].alias("unit_price"), x["conf"].alias("conf")))
    return rows.select("rec_id", "prio", "source", "invoice_raw", "tax_raw", "conf", F.coalesce(items, none).alias("items"))


_MERGE = f"""
, f AS ({_FIELDS})
, chosen AS (
  SELECT rec_id, count(*) FILTER (WHERE invoice_status = 'auto') AS n_i, count(DISTINCT code) FILTER (WHERE invoice_status = 'auto') AS d_i, arg_min(code, prio) FILTER (WHERE invoice_status = 'auto') AS v_i, arg_min(conf, prio) FILTER (WHERE invoice_status = 'auto') AS c_i, min(conf) FILTER (WHERE invoice_status = 'auto') AS m_i,
    arg_min(CASE WHEN invoice_status <> 'manual_required' THEN code END, prio) FILTER (WHERE prio = 0) AS f_i, arg_min(invoice_status, prio) AS s_i, arg_min(conf, prio) AS fc,
    count(*) FILTER (WHERE tax_status = 'auto') AS n_t, count(DISTINCT tax) FILTER (WHERE tax_status = 'auto') AS d_t, arg_min(tax, prio) FILTER (WHERE tax_status = 'auto') AS v_t, arg_min(conf, prio) FILTER (WHERE tax_status = 'auto') AS c_t, min(conf) FILTER (WHERE tax_status = 'auto') AS m_t,
    arg_min(CASE WHEN tax_status <> 'manual_required' THEN tax END, prio) FILTER (WHERE prio = 0) AS f_t, arg_min(tax_status, prio) AS s_t FROM f GROUP BY rec_id)
, merged_fields AS (
  SELECT rec_id, CASE WHEN n_i = 0 THEN f_i WHEN d_i > 1 THEN NULL ELSE v_i END AS invoice, CASE WHEN n_i = 0 THEN s_i WHEN d_i > 1 THEN 'low_confidence' ELSE 'auto' END AS invoice_status, CASE WHEN n_i = 0 THEN fc WHEN d_i > 1 THEN m_i ELSE least(1.0, c_i + CASE WHEN n_i > 1 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) END AS invoice_confidence,
    CASE WHEN n_t = 0 THEN f_t WHEN d_t > 1 THEN NULL ELSE v_t END AS tax_id, CASE WHEN n_t = 0 THEN s_t WHEN d_t > 1 THEN 'low_confidence' ELSE 'auto' END AS tax_status, CASE WHEN n_t = 0 THEN fc WHEN d_t > 1 THEN m_t ELSE least(1.0, c_t + CASE WHEN n_t > 1 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) END AS tax_confidence FROM chosen)
"""


@query(V.duck("candidates", _MERGE + "SELECT * FROM merged_fields"))
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.merged(with_items(spark, sf_dir))
    return found.select("rec_id", F.col("invoice.value").alias("invoice"), F.col("invoice.status").alias("invoice_status"), F.col("invoice.confidence").alias("invoice_confidence"), F.col("buyer.value").alias("tax_id"), F.col("buyer.status").alias("tax_status"), F.col("buyer.confidence").alias("tax_confidence"))


_SETS = """
, sure AS (SELECT rec_id, pos, quantity AS q, unit_price AS p, conf FROM items WHERE quantity > 0 AND unit_price > 0 AND conf >= 0.6)
, sets AS (SELECT rec_id, count(*) AS n, min(conf) AS c, CAST(sum(q * p) AS BIGINT) AS s, bool_or(pos = 1) AS has_first FROM sure GROUP BY rec_id)
, alls AS (SELECT rec_id, count(*) AS n_all FROM items GROUP BY rec_id)
, mi AS (SELECT r.rec_id, coalesce(a.n_all, 0) AS n_all, coalesce(s.n, 0) AS n_sure, s.c, s.s, coalesce(s.has_first AND r.rec_id % 4 = 0, false) AS clash FROM records r LEFT JOIN alls a USING (rec_id) LEFT JOIN sets s USING (rec_id))
, mt AS (SELECT rec_id, CAST(CASE WHEN n_sure = 0 THEN n_all ELSE n_sure END AS INT) AS n_items, clash, CASE WHEN n_sure > 0 AND NOT clash THEN s END AS amount, CASE WHEN n_sure > 0 AND NOT clash THEN c ELSE 0.0::DOUBLE END AS confidence, n_sure FROM mi)
"""


@query(V.duck("items records", _SETS + "SELECT rec_id, n_items, amount, CAST(floor(amount * CAST(0.05 AS DOUBLE) + 0.5) AS BIGINT) AS tax, amount + CAST(floor(amount * CAST(0.05 AS DOUBLE) + 0.5) AS BIGINT) AS total, confidence, CASE WHEN amount IS NULL THEN 'manual_required' ELSE 'auto' END AS amount_status, clash FROM mt"))
def merge_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.merged(with_items(spark, sf_dir))
    return found.select("rec_id", F.size("items").alias("n_items"), F.col("amount.value").alias("amount"), F.col("tax.value").alias("tax"), F.col("total.value").alias("total"), F.col("amount.confidence").alias("confidence"), F.col("amount.status").alias("amount_status"), F.array_contains("warnings", V_.ITEM_CONFLICT).alias("clash"))


@query(
    V.duck(
        "items candidates",
        _MERGE
        + _SETS
        + """SELECT m.rec_id, coalesce(m.invoice, '') AS invoice_number, coalesce(m.tax_id, '') AS tax_id, coalesce(CAST(t.amount AS VARCHAR), '') AS sales_amount, coalesce(CAST(CAST(floor(t.amount * CAST(0.05 AS DOUBLE) + 0.5) AS BIGINT) AS VARCHAR), '') AS tax_amount,
 CASE WHEN m.invoice_status = 'auto' AND m.tax_status = 'auto' AND t.amount IS NOT NULL THEN 'auto' ELSE 'needs_review' END AS overall_status FROM merged_fields m JOIN mt t USING (rec_id)""",
    )
)
def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.merged(with_items(spark, sf_dir))
    flat = merge.flat_fields(found.withColumn("rec_id", F.struct("rec_id", "overall_status")))
    return flat.select("rec_id.rec_id", "invoice_number", "tax_id", "sales_amount", "tax_amount", "rec_id.overall_status")


@query(
    V.duck(
        "items records",
        f""", f AS ({_ITEMS}), r AS (SELECT *, greatest(CASE qs WHEN 'manual_required' THEN 2 WHEN 'low_confidence' THEN 1 ELSE 0 END, CASE ps WHEN 'manual_required' THEN 2 WHEN 'low_confidence' THEN 1 ELSE 0 END) AS worst FROM f)
SELECT rec_id, CASE max(worst) WHEN 2 THEN 'manual_required' WHEN 1 THEN 'low_confidence' ELSE 'auto' END AS status, min(conf) AS confidence, CAST(count(*) FILTER (WHERE quantity IS NOT NULL OR unit_price IS NOT NULL) AS INT) AS n_kept, CAST(sum(quantity * unit_price) AS BIGINT) AS amount FROM r GROUP BY rec_id""",
    )
)
def item_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst status and least confidence over a record's items, from one candidate."""
    one = merge.validated(with_items(spark, sf_dir).where("prio = 0")).where(F.size("items") > 0)
    flat = merge.flat_items(F.col("items"))
    whole = lambda f: merge.worst(F.transform("items", lambda x: x[f]))
    step = one.withColumns({"q": whole("quantity"), "p": whole("unit_price")})
    return step.select("rec_id", V_.unrank(F.greatest(V_.rank(F.col("q.status")), V_.rank(F.col("p.status")))).alias("status"), F.least("q.confidence", "p.confidence").alias("confidence"), F.size(flat).alias("n_kept"), F.col("amount.value").alias("amount"))


@query(
    V.duck(
        "items candidates",
        _MERGE
        + _SETS
        + """, low AS (SELECT rec_id, sum((quantity IS NULL OR quantity <= 0 OR conf < 0.6)::INT + (unit_price IS NULL OR unit_price <= 0 OR conf < 0.6)::INT) AS n_odd FROM items GROUP BY rec_id)
SELECT m.rec_id, m.invoice_status, m.tax_status, CASE WHEN t.amount IS NULL THEN 'manual_required' ELSE 'auto' END AS sales_status,
 CAST((m.invoice_status <> 'auto')::INT + (m.tax_status <> 'auto')::INT + (t.amount IS NULL)::INT + CASE WHEN t.clash THEN 2 * t.n_sure WHEN t.n_sure > 0 THEN 0 ELSE coalesce(l.n_odd, 0) END AS INT) AS n_errors FROM merged_fields m JOIN mt t USING (rec_id) LEFT JOIN low l USING (rec_id)""",
    )
)
def field_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.meta(merge.merged(with_items(spark, sf_dir)))
    status = lambda k: F.col("field_statuses")[k]
    return found.select("rec_id", status("invoiceNumber").alias("invoice_status"), status("taxId").alias("tax_status"), status("salesAmount").alias("sales_status"), F.size("validation_errors").alias("n_errors"))


@query(
    V.duck(
        "items records",
        f""", f AS ({_ITEMS}), g AS (SELECT rec_id, CAST(sum(quantity * unit_price) AS BIGINT) AS s, min(conf) FILTER (WHERE quantity * unit_price IS NOT NULL) AS c, bool_and(qs = 'auto' AND ps = 'auto') FILTER (WHERE quantity * unit_price IS NOT NULL) AS ok FROM f GROUP BY rec_id)
SELECT rec_id, s AS amount, CASE WHEN s IS NULL THEN 'manual_required' WHEN ok THEN 'auto' ELSE 'low_confidence' END AS amount_status, coalesce(c, 0.0::DOUBLE) AS confidence, CASE WHEN s IS NULL THEN '沒有可成立的數量與單價組合' ELSE '' END AS warnings FROM records LEFT JOIN g USING (rec_id)""",
    )
)
def candidate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = merge.validated(with_items(spark, sf_dir).where("prio = 0"))
    return one.select("rec_id", F.col("amount.value").alias("amount"), F.col("amount.status").alias("amount_status"), F.col("amount.confidence").alias("confidence"), F.array_join("warnings", ",").alias("warnings"))


@query(
    V.duck(
        "records",
        """SELECT rec_id, coalesce(CASE WHEN lower(m) IN ('local','tesseract','paddleocr','google-vision','openai-vision','hybrid','manual') THEN lower(m) END, 'local') AS mode, CASE lower(m) WHEN 'paddle_ocr' THEN 'paddleocr' WHEN 'google_vision' THEN 'google-vision' WHEN '' THEN 'local' WHEN 'nope' THEN 'local' ELSE lower(m) END AS configured,
 CASE WHEN s IN ('paddleocr','hybrid','formula') THEN s ELSE 'tesseract' END AS source, CASE s WHEN 'paddleocr' THEN 'PaddleOCR' ELSE s END AS label FROM (SELECT rec_id, ['Hybrid', 'paddle_ocr', '', 'nope', 'MANUAL', 'google_vision'][CAST(rec_id % 6 AS INT) + 1] AS m, ['paddleocr', 'hybrid', 'abc', 'formula'][CAST(rec_id % 4 AS INT) + 1] AS s FROM records)""",
    )
)
def provider_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.get(F.array(*map(F.lit, ("Hybrid", "paddle_ocr", "", "nope", "MANUAL", "google_vision"))), (F.col("rec_id") % 6).cast("int"))
    source = F.get(F.array(*map(F.lit, ("paddleocr", "hybrid", "abc", "formula"))), (F.col("rec_id") % 4).cast("int"))
    return V.records(spark, sf_dir).select("rec_id", S.effective_mode(asked).alias("mode"), S.default_mode(asked).alias("configured"), S.known_source(source).alias("source"), S.source_label(source).alias("label"))


@query(V.duck("records", "SELECT rec_id, 'need_review' AS processing_status, 'manual_required' AS provider_status, 'low' AS confidence_level, concat(batch_id, ' disabled') AS warnings, CAST(4 AS INT) AS n_errors FROM records"))
def manual_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = V.records(spark, sf_dir).withColumns(records.manual_record(F.concat(F.col("batch_id"), F.lit(" disabled"))))
    return made.select("rec_id", "processing_status", "provider_status", "confidence_level", F.array_join("warnings", ",").alias("warnings"), F.size("errors").alias("n_errors"))

