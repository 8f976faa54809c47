"""Queries on what comes in and on what the screens show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import raster, records
from ..sources import views as V
from .checks import recognised
from .registry import query


@query(
    """
WITH f AS (SELECT page_id, page_id % 20 AS batch, CASE WHEN page_id % 3 = 0 THEN 'text/plain' ELSE 'image/jpeg' END AS kind FROM pages), g AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY page_id) AS i FROM f WHERE kind LIKE 'image/%')
SELECT page_id, concat('B19960313-', CAST(batch AS VARCHAR)) AS batch_id, concat(lpad(CAST(i AS VARCHAR), 3, '0'), '-img_', CAST(page_id AS VARCHAR), '.jpg') AS filename, 'pending' AS processing_status, 'unconfirmed' AS status, '' AS invoice_number FROM g
"""
)
def import_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an upload as pending records: images only, numbered within their batch."""
    files = V.table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 20).alias("batch"), F.when(F.col("page_id") % 3 == 0, "text/plain").otherwise("image/jpeg").alias("kind"), F.concat(F.lit("c:/up/img "), F.col("page_id").cast("string"), F.lit(".JPG")).alias("name"))
    number = F.row_number().over(Window.partitionBy("batch").orderBy("page_id")).cast("string")
    batch = F.concat(F.lit("B"), F.date_format(F.lit("1996-03-13").cast("date"), "yyyyMMdd"), F.lit("-"), F.col("batch").cast("string"))
    return files.where(F.startswith("kind", F.lit("image/"))).select("page_id", batch.alias("batch_id"), F.concat(F.lpad(number, 3, "0"), F.lit("-"), S.safe_name(F.col("name"))).alias("filename"), F.lit("pending").alias("processing_status"), F.lit("unconfirmed").alias("status"), F.lit("").alias("invoice_number"))


@query(V.duck("records", "SELECT rec_id, batch_id FROM records WHERE batch_id = 'B7' AND processing_status = 'pending'"))
def pending_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.records(spark, sf_dir).where((F.col("batch_id") == "B7") & (F.col("processing_status") == "pending")).select("rec_id", "batch_id")


@query(
    V.duck(
        "records",
        """SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN 'low_confidence' WHEN length(tax_raw) <> 8 THEN 'manual_required' ELSE 'auto' END AS tax_status, CASE WHEN rec_id % 3 = 0 THEN 'paddleocr' ELSE 'tesseract' END AS tax_source, CASE WHEN rec_id % 3 = 0 THEN conf ELSE 0.0::DOUBLE END AS tax_confidence, CASE WHEN length(tax_raw) <> 8 THEN concat(batch_id, ',tax') ELSE batch_id END AS warnings FROM records""",
    )
)
def field_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's status, source and confidence with their defaults, and all warnings once."""
    some = F.col("rec_id") % 3 == 0
    none = F.expr("map()").cast("map<string,string>")
    rows = V.records(spark, sf_dir).withColumns({
        "statuses": F.when(some, F.create_map(F.lit("taxId"), F.lit("low_confidence"))).otherwise(none), "sources": F.when(some, F.create_map(F.lit("taxId"), F.lit("paddleocr"))).otherwise(none),
        "confidence": F.when(some, F.create_map(F.lit("taxId"), F.col("conf"))), "errors": F.when(F.length("tax_raw") != 8, F.array(F.struct(F.lit("taxId").alias("field"), F.lit("tax").alias("reason")))).otherwise(F.expr("array()").cast("array<struct<field:string,reason:string>>")),
        "warnings": F.array("batch_id", "batch_id"),
    })
    wrong = F.exists("errors", lambda e: e["field"] == "taxId")
    return rows.select("rec_id", F.coalesce(F.col("statuses")["taxId"], F.when(wrong, "manual_required").otherwise("auto")).alias("tax_status"), F.coalesce(F.col("sources")["taxId"], F.lit("tesseract")).alias("tax_source"), F.coalesce(F.col("confidence")["taxId"], F.lit(0.0)).alias("tax_confidence"), F.array_join(F.array_distinct(F.concat("warnings", F.transform("errors", lambda e: e["reason"]))), ",").alias("warnings"))


@query(V.duck("items records", "SELECT r.rec_id, bool_or(NOT regexp_full_match(regexp_replace(upper(replace(replace(replace(invoice_raw, 'O', '0'), 'I', '1'), 'l', '1')), '[^A-Z0-9]', '', 'g'), '[A-Z]{2}[0-9]{8}') OR length(tax_raw) <> 8 OR r.rec_id % 7 = 6 AND tax_raw = lpad(CAST(r.rec_id AS VARCHAR), 8, '0') AND regexp_full_match(regexp_replace(upper(replace(replace(replace(invoice_raw, 'O', '0'), 'I', '1'), 'l', '1')), '[^A-Z0-9]', '', 'g'), '[A-Z]{2}[0-9]{8}') OR r.rec_id % 2 = 0 OR i.rec_id IS NULL OR item_name IS NULL OR quantity IS NULL OR unit_price IS NULL OR tax_raw = substr(invoice_raw, 3, 8)) AS needs_more FROM records r LEFT JOIN items i ON i.rec_id = r.rec_id GROUP BY r.rec_id"))
def needs_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether another recogniser is asked for what is missing."""
    found = records.normalized(recognised(spark, sf_dir)).withColumn("seller_name", F.when(F.col("rec_id") % 2 == 1, "known"))
    return found.select("rec_id", records.needs_more(found).alias("needs_more"))


@query("SELECT s_suppkey AS rec_id, CASE WHEN s_suppkey % 10 = 0 THEN 'Acme' ELSE s_name END AS seller_name FROM supplier")
def seller_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names corrected by a table of rules, as an equi-join."""
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rec_id"), F.col("s_name").alias("seller_name"))
    rules = s.where(F.col("rec_id") % 10 == 0).select("seller_name", F.lit("Acme").alias("corrected")).distinct()
    return s.join(rules, "seller_name", "left").select("rec_id", F.coalesce("corrected", "seller_name").alias("seller_name"))


@query(
    """
WITH t AS (SELECT s_suppkey AS id, s_suppkey + 500000 AS vendor FROM supplier), d AS (SELECT o_orderkey AS rec_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 200 ELSE -1 END AS asked, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 200 + 500000 ELSE -1 END AS vendor FROM orders)
SELECT rec_id, coalesce(a.id, b.id, (SELECT min(id) FROM t)) AS template_id FROM d LEFT JOIN t a ON a.id = d.asked LEFT JOIN t b ON b.vendor = d.vendor
"""
)
def template_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's template: by its id, else by its seller, else the first one."""
    t = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + 500000).alias("vendor"))
    key = F.col("o_orderkey")
    d = V.table(spark, sf_dir, "orders").select(key.alias("rec_id"), F.when(key % 3 == 0, key % 200).otherwise(-1).alias("asked"), F.when(key % 3 == 1, key % 200 + 500000).otherwise(-1).alias("vendor"))
    first = t.agg(F.min("id").alias("first_id"))
    found = d.join(t.select(F.col("id").alias("by_id")), F.col("asked") == F.col("by_id"), "left").join(t.select(F.col("id").alias("by_vendor"), "vendor"), "vendor", "left").join(F.broadcast(first), how="cross")
    return found.select("rec_id", F.coalesce("by_id", "by_vendor", "first_id").alias("template_id"))


_PIXELS = "SELECT l_orderkey % 50 AS page_id, l_partkey % 40 AS x, l_suppkey % 30 AS y, CAST(l_quantity * 5 AS BIGINT) AS r, CAST(l_linenumber * 30 AS BIGINT) AS g, CAST(l_partkey % 256 AS BIGINT) AS b FROM {lineitem}"


@query(
    f"WITH p AS ({_PIXELS.format(lineitem='lineitem')}), k AS (SELECT * FROM p WHERE r * 0.299 + g * 0.587 + b * 0.114 < 60), ys AS (SELECT page_id, y FROM k GROUP BY page_id, y HAVING count(*) >= 2), xs AS (SELECT page_id, x FROM k GROUP BY page_id, x HAVING count(*) >= 2) SELECT page_id, top, bottom, left_, right_ FROM (SELECT page_id, min(y) AS top, max(y) AS bottom FROM ys GROUP BY page_id) FULL JOIN (SELECT page_id, min(x) AS left_, max(x) AS right_ FROM xs GROUP BY page_id) USING (page_id)"
)
def dark_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dark_bounds(spark.sql(_PIXELS, lineitem=V.table(spark, sf_dir, "lineitem")), dark=60.0, rows=2, columns=2)


@query(f"WITH p AS ({_PIXELS.format(lineitem='lineitem')}) SELECT page_id, count(*) FILTER (WHERE b > 85 AND b > r * 1.12 AND b > g * 1.04 AND r < 190) AS crop_blue, count(*) FILTER (WHERE b > 78 AND b > r * 1.08 AND b > g * 1.02 AND r < 205) AS detector_blue FROM p GROUP BY page_id")
def blue_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(_PIXELS, lineitem=V.table(spark, sf_dir, "lineitem"))
    blue = lambda strict: F.count_if(raster.is_blue(F.col("r"), F.col("g"), F.col("b"), strict))
    return p.groupBy("page_id").agg(blue(True).alias("crop_blue"), blue(False).alias("detector_blue"))


@query(V.duck("records", """SELECT batch_id, rec_id, concat('{"rec_id":', CAST(rec_id AS VARCHAR), ',"status":"', status, '","warnings":["', processing_status, '"]}') AS debug FROM records"""))
def debug_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object a record, to be written in folders by batch."""
    return V.records(spark, sf_dir).select("batch_id", "rec_id", F.to_json(F.struct("rec_id", "status", F.array("processing_status").alias("warnings"))).alias("debug"))
