"""Queries on amounts, reports and the record store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import amounts, report, store
from ..sources import views as V
from .registry import query

#: The day that counts as today.
TODAY = "1996-03-13"


@query(
    V.duck(
        "items",
        """
, sums AS (SELECT rec_id, count(*) AS n_items, bool_and(quantity IS NOT NULL AND unit_price IS NOT NULL) AS complete, CAST(sum(quantity * unit_price) AS BIGINT) AS s FROM items GROUP BY rec_id)
SELECT rec_id, n_items, CASE WHEN complete THEN s END AS sales, CASE WHEN complete THEN CAST(floor(s * CAST(0.05 AS DOUBLE) + 0.5) AS BIGINT) END AS tax,
 CASE WHEN complete THEN s + CAST(floor(s * CAST(0.05 AS DOUBLE) + 0.5) AS BIGINT) END AS total, CASE WHEN complete THEN 'formula' ELSE 'none' END AS amount_source FROM sums
""",
    )
)
def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts.invoice_totals(V.items(spark, sf_dir))


@query(
    V.duck(
        "items",
        """
, sums AS (SELECT rec_id, CAST(sum(quantity * unit_price) AS BIGINT) AS subtotal FROM items GROUP BY rec_id)
SELECT rec_id, subtotal, CASE WHEN subtotal <> 0 THEN CAST(round_even(subtotal * CAST(0.05 AS DOUBLE), 0) AS BIGINT) END AS tax,
 CASE WHEN subtotal <> 0 THEN subtotal + CAST(round_even(subtotal * CAST(0.05 AS DOUBLE), 0) AS BIGINT) END AS total FROM sums
""",
    )
)
def invoice_totals_bankers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts.invoice_totals_half_even(V.items(spark, sf_dir))


def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as the report takes them; every tenth has lists in place of items."""
    items = V.items(spark, sf_dir).select("rec_id", "pos", "item_name", "quantity", "unit_price", (F.col("quantity") * F.col("unit_price")).alias("amount"))
    grouped = items.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item_name", "quantity", "unit_price", "amount"))).alias("items"))
    whole = F.forall("items", lambda x: x["amount"].isNotNull())
    sales = F.when(whole, F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["amount"]))
    joined = V.records(spark, sf_dir).join(grouped, "rec_id", "left").withColumn("sales", sales)
    listed = F.col("rec_id") % 10 == 3
    tax, total = S.tax_and_total(F.col("sales").cast("string"))
    return joined.select(
        "rec_id", F.col("invoice_raw").alias("invoice_number"), F.col("tax_raw").alias("tax_id"), F.lit("").alias("item_name"), "status", "created_at", "processing_status",
        F.when(F.col("conf") < 0.5, "low").otherwise("medium").alias("confidence_level"), F.array("processing_status", "batch_id").alias("warnings"), F.concat(F.col("batch_id"), F.lit(".jpg")).alias("filename"),
        tax.alias("tax_amount"), total.alias("total_amount"), F.when(~listed, F.col("items")).alias("items"),
        F.when(listed, S.list_text(F.filter("items.quantity", lambda x: x.isNotNull()))).alias("quantity"), F.when(listed, S.list_text(F.filter("items.unit_price", lambda x: x.isNotNull()))).alias("unit_price"),
    )


_REPORT = """
, grouped AS (
  SELECT rec_id, bool_and(quantity IS NOT NULL AND unit_price IS NOT NULL) AS complete, CAST(sum(quantity * unit_price) AS BIGINT) AS s,
    list({'pos': pos, 'item_name': item_name, 'q': quantity, 'p': unit_price} ORDER BY pos) AS its,
    coalesce(list(quantity ORDER BY pos) FILTER (WHERE quantity IS NOT NULL), []) AS qs, coalesce(list(unit_price ORDER BY pos) FILTER (WHERE unit_price IS NOT NULL), []) AS ps
  FROM items GROUP BY rec_id
), recs AS (
  SELECT r.*, g.its, g.qs, g.ps, CASE WHEN g.complete AND g.s > 0 THEN CAST(floor(g.s * CAST(0.05 AS DOUBLE) + 0.5) AS BIGINT) END AS tax_v, CASE WHEN g.complete AND g.s > 0 THEN g.s END AS sales_v
  FROM records r LEFT JOIN grouped g USING (rec_id)
), lines AS (
  SELECT recs.*, unnest(range(1, len(its) + 1)) AS line, len(its) AS n, 'items' AS kind FROM recs WHERE rec_id % 10 <> 3 AND its IS NOT NULL
  UNION ALL
  SELECT recs.*, unnest(range(1, greatest(1, len(coalesce(qs, [])), len(coalesce(ps, []))) + 1)) AS line, greatest(1, len(coalesce(qs, [])), len(coalesce(ps, []))) AS n, 'lists' AS kind FROM recs WHERE rec_id % 10 = 3 OR its IS NULL
), cells AS (
  SELECT *, CASE kind WHEN 'items' THEN coalesce(its[line].q, 0) ELSE CASE WHEN rec_id % 10 = 3 THEN qs[line] END END AS quantity, CASE kind WHEN 'items' THEN coalesce(its[line].p, 0) ELSE CASE WHEN rec_id % 10 = 3 THEN ps[line] END END AS unit_price,
    CASE kind WHEN 'items' THEN coalesce(its[line].q * its[line].p, 0) ELSE CASE WHEN rec_id % 10 = 3 THEN qs[line] * ps[line] END END AS amount, CASE WHEN kind = 'items' THEN coalesce(its[line].item_name, '') ELSE '' END AS item_name
  FROM lines
), report AS (
  SELECT rec_id, CAST(line AS INT) AS line, invoice_raw AS invoice_number, tax_raw AS tax_id, item_name, quantity, unit_price, amount, CASE WHEN line = n AND tax_v > 0 THEN tax_v END AS tax, CASE WHEN line = n THEN sales_v + tax_v END AS total,
    CASE WHEN status = 'confirmed' THEN '已確認' ELSE '未確認' END AS confirmed, CASE WHEN conf < 0.5 THEN 'low' ELSE 'medium' END AS confidence_level, concat(processing_status, ', ', batch_id) AS warnings, concat(batch_id, '.jpg') AS filename
  FROM cells
)
"""


@query(V.duck("items records", _REPORT + "SELECT * FROM report UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(sum(amount) AS BIGINT), CAST(sum(tax) AS BIGINT), CAST(sum(total) AS BIGINT), '合計', NULL, NULL, NULL FROM report"))
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.with_totals(report.report_lines(report_records(spark, sf_dir)))


@query(V.duck("items records", _REPORT + "SELECT CAST(sum(amount) AS BIGINT) AS amount, CAST(sum(tax) AS BIGINT) AS tax, CAST(sum(total) AS BIGINT) AS total FROM report"))
def export_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(report.report_lines(report_records(spark, sf_dir)))


@query(
    V.duck(
        "items records",
        _REPORT.split(", lines AS")[0]
        + f"""SELECT count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '{TODAY}') AS today, CAST(coalesce(sum(sales_v + tax_v), 0) AS BIGINT) AS month_total,
 count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status <> 'confirmed') AS unconfirmed, count(*) FILTER (WHERE processing_status = 'pending') AS pending, count(*) FILTER (WHERE processing_status = 'failed') AS failed FROM recs""",
    )
)
def dashboard_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the sum over all records, whatever their month."""
    total = F.coalesce(F.sum(F.coalesce(S.digits(F.col("total_amount")).try_cast("bigint"), F.lit(0))), F.lit(0).cast("bigint"))
    return report_records(spark, sf_dir).agg(
        F.count_if(F.to_date("created_at") == F.lit(TODAY).cast("date")).alias("today"), total.alias("month_total"), F.count_if(F.col("status") == "confirmed").alias("confirmed"),
        F.count_if(F.col("status") != "confirmed").alias("unconfirmed"), F.count_if(F.col("processing_status") == "pending").alias("pending"), F.count_if(F.col("processing_status") == "failed").alias("failed"),
    )


@query(
    V.duck(
        "records",
        """SELECT batch_id, bool_or(status <> 'confirmed' OR length(tax_raw) <> 8 OR processing_status IN ('need_review', 'provider_unavailable')) AS needs_review,
 count(*) FILTER (WHERE status <> 'confirmed' OR length(tax_raw) <> 8 OR processing_status IN ('need_review', 'provider_unavailable')) AS n_open FROM records GROUP BY batch_id""",
    )
)
def needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a batch has a record that asks for a prompt before it is exported."""
    field_status = F.create_map(F.lit("taxId"), F.when(S.is_tax_id(F.col("tax_raw")), "auto").otherwise("manual_required"))
    rows = V.records(spark, sf_dir).withColumn("field_statuses", field_status)
    still_open = (F.col("status") != "confirmed") | F.exists(F.map_values("field_statuses"), lambda s: s == "manual_required") | F.col("processing_status").isin("need_review", "provider_unavailable")
    return rows.groupBy("batch_id").agg(F.bool_or(still_open).alias("needs_review"), F.count_if(still_open).alias("n_open"))


@query(
    V.duck(
        "records",
        """SELECT rec_id, batch_id, CAST(row_number() OVER (ORDER BY rec_id % 3 = 0, rec_id) AS INT) AS sequence_no FROM records""",
    )
)
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.records(spark, sf_dir).select("rec_id", "batch_id")
    return store.append(rows.where(F.col("rec_id") % 3 != 0), rows.where(F.col("rec_id") % 3 == 0)).select("rec_id", "batch_id", "sequence_no")


@query(
    V.duck(
        "records patches",
        """SELECT rec_id, batch_id, CAST(row_number() OVER (ORDER BY rec_id) AS INT) AS sequence_no FROM records WHERE rec_id NOT IN (SELECT rec_id FROM patches WHERE field = 'processingStatus')""",
    )
)
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = V.patches(spark, sf_dir).where(F.col("field") == "processingStatus")
    return store.delete(V.records(spark, sf_dir).select("rec_id", "batch_id"), gone).select("rec_id", "batch_id", "sequence_no")


_FIELDS = ("quantity", "unitPrice", "taxId", "status", "processingStatus")
_FOLD = ", fold AS (SELECT rec_id, " + ", ".join(f"""arg_max(value, seq) FILTER (WHERE field = '{f}') AS "{f}\"""" for f in _FIELDS) + ", count(*) AS n_edits FROM patches GROUP BY rec_id)\n"


@query(V.duck("patches", _FOLD + 'SELECT rec_id, quantity, "unitPrice" AS unit_price, "taxId" AS tax_id, status, "processingStatus" AS processing_status, n_edits FROM fold'))
def patch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.fold_edits(V.patches(spark, sf_dir), _FIELDS)
    return found.select("rec_id", "quantity", F.col("unitPrice").alias("unit_price"), F.col("taxId").alias("tax_id"), "status", F.col("processingStatus").alias("processing_status"), "n_edits")


@query(
    V.duck(
        "records patches",
        _FOLD + """SELECT r.rec_id, r.batch_id, coalesce(f."taxId", r.tax_raw) AS tax_raw, coalesce(f.status, r.status) AS status, coalesce(f."processingStatus", r.processing_status) AS processing_status FROM records r LEFT JOIN fold f USING (rec_id)""",
    )
)
def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = store.fold_edits(V.patches(spark, sf_dir), _FIELDS)
    rows = V.records(spark, sf_dir).select("rec_id", "batch_id", "tax_raw", "status", "processing_status")
    return store.update(rows, edits, {"taxId": "tax_raw", "status": "status", "processingStatus": "processing_status"})
