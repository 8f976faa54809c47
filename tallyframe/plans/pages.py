"""Queries on the layout of pages and on what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import extract, layout
from ..sources import views as V
from .registry import query


def pages(spark: SparkSession, sf_dir: str, reading_order: bool = False) -> DataFrame:
    found = layout.gather(V.words(spark, sf_dir))
    return found.withColumn("lines", layout.by_place(F.col("lines"))) if reading_order else found


def _flat(df: DataFrame, field: str = "f") -> DataFrame:
    return df.select("page_id", f"{field}.*")


# Lines as rows: boxes, centers and the digits of the text; rn is the reading order.
_LINES = r"""
, l AS (SELECT page_id, pos, coalesce(text, '') AS text, conf / 100.0::DOUBLE AS conf, left_ AS x1, top_ AS y1, left_ + width_ AS x2, top_ + height_ AS y2, (left_ + left_ + width_) / 2.0::DOUBLE AS cx, (top_ + top_ + height_) / 2.0::DOUBLE AS cy,
   regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g') AS dig, row_number() OVER (PARTITION BY page_id ORDER BY top_, left_, pos) AS rn FROM words)
, p AS (SELECT DISTINCT page_id FROM l)
"""


@query(V.duck("words", _LINES + "SELECT page_id, pos, cx, cy, CAST(round(conf * 100) AS INT) AS confidence, greatest(1, x2 - x1) AS width, greatest(1, y2 - y1) AS height FROM l"))
def words_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = pages(spark, sf_dir).select("page_id", F.explode("lines").alias("x"))
    x = F.col("x")
    return flat.select("page_id", x["pos"].alias("pos"), x["cx"].alias("cx"), x["cy"].alias("cy"), S.round_half_up(x["conf"] * 100).cast("int").alias("confidence"), F.greatest(F.lit(1), x["x2"] - x["x1"]).alias("width"), F.greatest(F.lit(1), x["y2"] - x["y1"]).alias("height"))


def _fold(tolerance: int) -> str:
    """The greedy grouping as a recursive walk over each page's lines in order of height."""
    return V.duck(
        "words",
        _LINES
        + f"""
, o AS (SELECT page_id, pos, cx, cy, row_number() OVER (PARTITION BY page_id ORDER BY cy, pos) AS k FROM l)
, fold AS (
  SELECT page_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(s DOUBLE, n INT)[]) AS g, CAST(0 AS BIGINT) AS slot FROM p
  UNION ALL
  SELECT page_id, k, CASE WHEN slot <= len(g) THEN list_transform(g, lambda x, i: CASE WHEN i = slot THEN {{'s': x.s + cy, 'n': x.n + 1}} ELSE x END) ELSE list_append(g, {{'s': cy, 'n': 1}}) END AS g, slot
  FROM (SELECT f.page_id, o.k, f.g, o.cy, coalesce(list_filter(range(1, len(f.g) + 1), lambda i: abs(f.g[i].s / f.g[i].n - o.cy) <= {tolerance})[1], len(f.g) + 1) AS slot FROM fold f JOIN o ON o.page_id = f.page_id AND o.k = f.k + 1)
)
SELECT o.page_id, o.pos, CAST(f.slot AS INT) AS row_no, CAST(row_number() OVER (PARTITION BY o.page_id, f.slot ORDER BY o.cx, o.k) AS INT) AS cell_no FROM fold f JOIN o ON o.page_id = f.page_id AND o.k = f.k
""",
        recursive=True,
    )


def _groups(spark: SparkSession, sf_dir: str, tolerance: int) -> DataFrame:
    rows = pages(spark, sf_dir).select("page_id", F.posexplode(layout.row_groups(F.col("lines"), tolerance)).alias("r", "x"))
    return rows.select("page_id", "r", F.posexplode("x.row").alias("c", "y")).select("page_id", F.col("y.pos").alias("pos"), (F.col("r") + 1).alias("row_no"), (F.col("c") + 1).alias("cell_no"))


@query(_fold(30))
def row_groups_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, 30)


@query(_fold(34))
def row_groups_34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, 34)


@query(
    V.duck(
        "words",
        _LINES
        + r"""
, top AS (SELECT page_id, upper(replace(string_agg(text, ' ' ORDER BY pos), 'ß', 'SS')) AS joined, max(conf) AS top_conf, arg_min(upper(text), pos) FILTER (WHERE regexp_full_match(upper(trim(text)), '[A-Z]{2}')) AS pre, arg_min(conf, pos) FILTER (WHERE regexp_full_match(upper(trim(text)), '[A-Z]{2}')) AS pre_c,
   arg_min(dig, pos) FILTER (WHERE length(dig) = 8) AS num, arg_min(conf, pos) FILTER (WHERE length(dig) = 8) AS num_c FROM l WHERE cx <= 540 AND cy <= 175 GROUP BY page_id)
, d AS (SELECT p.page_id, regexp_replace(regexp_extract(joined, '[A-Z]{2}\s*[0-9]{8}', 0), '\s+', '', 'g') AS direct, top.* EXCLUDE (page_id) FROM p LEFT JOIN top USING (page_id))
SELECT page_id, CASE WHEN direct <> '' THEN direct WHEN pre IS NOT NULL AND num IS NOT NULL THEN concat(pre, num) END AS value, CASE WHEN direct <> '' THEN greatest(top_conf, 0.75) WHEN pre IS NOT NULL AND num IS NOT NULL THEN least(pre_c, num_c) WHEN num IS NOT NULL THEN num_c ELSE 0.0::DOUBLE END AS confidence,
 CASE WHEN direct <> '' OR (pre IS NOT NULL AND num IS NOT NULL) THEN 'auto' ELSE 'manual_required' END AS status, CASE WHEN direct <> '' OR (pre IS NOT NULL AND num IS NOT NULL) THEN '' ELSE 'invoice_number_missing_prefix' END AS reason FROM d
""",
    )
)
def extract_invoice_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(pages(spark, sf_dir).select("page_id", extract.invoice_by_position(F.col("lines")).alias("f")))


@query(
    V.duck(
        "words",
        _LINES
        + r"""
, area AS (SELECT *, regexp_extract(text, '統一編號[:：]?\s*([0-9]{8})', 1) AS same, substr(dig, 1, 8) AS d8 FROM l WHERE cx <= 660 AND cy BETWEEN 70 AND 301)
, lab AS (SELECT page_id, coalesce(arg_min(cy, pos) FILTER (WHERE regexp_matches(text, '統一編號|統編')), arg_min(cy, pos) FILTER (WHERE text LIKE '%買受人%' AND text NOT LIKE '%註記欄%')) AS ly FROM area GROUP BY page_id)
, c AS (SELECT page_id, pos * 2 AS o, same AS v, conf, cy FROM area WHERE same <> '' UNION ALL SELECT page_id, pos * 2 + 1, d8, conf, cy FROM area WHERE length(d8) = 8 AND d8 <> same)
, k AS (SELECT c.page_id, v, conf, row_number() OVER (PARTITION BY c.page_id ORDER BY CASE WHEN ly IS NOT NULL AND cy >= ly - 24.5 THEN 0 ELSE 1 END, CASE WHEN ly IS NOT NULL AND cy >= ly - 24.5 THEN abs(cy - ly) ELSE 0 END, o) AS r FROM c LEFT JOIN lab USING (page_id))
SELECT p.page_id, k.v AS value, CASE WHEN k.v IS NULL THEN 0.0::DOUBLE ELSE least(k.conf, 0.84) END AS confidence, CASE WHEN k.v IS NULL THEN 'manual_required' ELSE 'low_confidence' END AS status, CASE WHEN k.v IS NULL THEN 'buyer_tax_id_missing' ELSE 'buyer_tax_id_needs_review' END AS reason FROM p LEFT JOIN (SELECT * FROM k WHERE r = 1) k USING (page_id)
""",
    )
)
def extract_tax_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(pages(spark, sf_dir).select("page_id", extract.tax_id_by_position(F.col("lines")).alias("f")))


_PAIR = """
, pair AS (SELECT a.page_id, concat(upper(a.text), b.dig) AS pv, least(a.conf, b.conf) AS pc, row_number() OVER (PARTITION BY a.page_id ORDER BY a.rn, b.rn) AS r FROM l a JOIN l b ON a.page_id = b.page_id AND regexp_full_match(upper(a.text), '[A-Z]{2}') AND length(b.dig) = 8 AND b.cx > a.cx AND abs(b.cy - a.cy) <= 35 AND a.cy < 180)
"""


@query(V.duck("words", _LINES + _PAIR + "SELECT page_id, pv AS value, pc AS confidence FROM pair WHERE r = 1"))
def prefix_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir, True).select("page_id", extract.prefix_and_number(F.col("lines")).alias("f")).where(F.col("f").isNotNull())
    return found.select("page_id", F.col("f.value").alias("value"), F.col("f.conf").alias("confidence"))


@query(
    V.duck(
        "words",
        _LINES
        + _PAIR
        + r"""
, j AS (SELECT page_id, regexp_replace(regexp_extract(upper(replace(string_agg(text, ' ' ORDER BY rn), 'ß', 'SS')), '[A-Z]{2}\s*[0-9]{8}', 0), '\s+', '', 'g') AS direct FROM l GROUP BY page_id)
, h AS (SELECT page_id, direct, max(conf) FILTER (WHERE contains(upper(replace(text, 'ß', 'SS')), substr(direct, 1, 2)) OR contains(dig, substr(direct, 3, 8))) AS hc FROM l JOIN j USING (page_id) GROUP BY page_id, direct)
, v AS (SELECT h.page_id, CASE WHEN direct <> '' THEN direct ELSE pv END AS value, CASE WHEN direct <> '' THEN coalesce(hc, 0.8) ELSE coalesce(pc, 0.0::DOUBLE) END AS confidence FROM h LEFT JOIN (SELECT * FROM pair WHERE r = 1) q USING (page_id))
SELECT *, CASE WHEN value IS NULL THEN 'MISSING' WHEN confidence >= 0.85 THEN 'CONFIRMED' ELSE 'NEEDS_REVIEW' END AS status FROM v
""",
    )
)
def service_invoice_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(pages(spark, sf_dir, True).select("page_id", extract.invoice_by_text(F.col("lines")).alias("f")))


_ROW = """
, same_row AS (SELECT a.page_id, b.dig AS sv, b.conf AS sc, row_number() OVER (PARTITION BY a.page_id ORDER BY a.rn, b.cx - a.cx, b.rn) AS r FROM l a JOIN l b ON a.page_id = b.page_id AND regexp_matches(a.text, '統一編號|統編') AND length(b.dig) = 8 AND b.cx > a.cx AND abs(b.cy - a.cy) <= 35)
"""
_AHEAD = """
, joined AS (SELECT page_id, rn, conf, text, regexp_extract(string_agg(dig, '') OVER (PARTITION BY page_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), '([0-9]{8})', 1) AS av FROM l)
, ahead AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rn) AS r FROM joined WHERE regexp_matches(text, '統一編號|統編|買受人|營業人') AND av <> '')
"""


@query(V.duck("words", _LINES + _ROW + "SELECT page_id, sv AS value, sc AS confidence FROM same_row WHERE r = 1"))
def label_same_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir, True).select("page_id", extract.tax_id_same_row(F.col("lines")).alias("f")).where(F.col("f").isNotNull())
    return found.select("page_id", S.digits(F.col("f.text")).alias("value"), F.col("f.conf").alias("confidence"))


@query(V.duck("words", _LINES + _AHEAD + "SELECT page_id, av AS value, conf AS confidence FROM ahead WHERE r = 1"))
def lookahead_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir, True).select("page_id", extract.tax_id_lookahead(F.col("lines")).alias("f")).where(F.col("f").isNotNull())
    return found.select("page_id", "f.value", F.col("f.conf").alias("confidence"))


@query(
    V.duck(
        "words",
        _LINES
        + _ROW
        + _AHEAD
        + """
, anywhere AS (SELECT page_id, regexp_extract(dig, '([0-9]{8})', 1) AS ev, conf AS ec, row_number() OVER (PARTITION BY page_id ORDER BY rn) AS r FROM l WHERE length(dig) >= 8)
, v AS (SELECT p.page_id, coalesce(sv, av, ev) AS value, coalesce(sc, a.conf, ec) AS c FROM p LEFT JOIN (SELECT * FROM same_row WHERE r = 1) s USING (page_id) LEFT JOIN (SELECT * FROM ahead WHERE r = 1) a USING (page_id) LEFT JOIN (SELECT * FROM anywhere WHERE r = 1) e USING (page_id))
SELECT page_id, value, CASE WHEN value IS NULL THEN 0.0::DOUBLE ELSE least(c, 0.84) END AS confidence, CASE WHEN value IS NULL THEN 'MISSING' ELSE 'NEEDS_REVIEW' END AS status FROM v
""",
    )
)
def service_tax_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(pages(spark, sf_dir, True).select("page_id", extract.tax_id_by_text(F.col("lines")).alias("f")))


_NUMBERS = r"""
, money AS (SELECT *, translate(text, '¢SsOoIl|D%', '5550011103') AS m FROM l WHERE regexp_matches(text, '[0-9]') OR length(regexp_replace(text, '\s+', '', 'g')) > 2)
, nums AS (SELECT * EXCLUDE (num), num AS numeric, CAST(num AS DOUBLE) AS value FROM (SELECT *, CASE WHEN regexp_matches(m, '[0-9]/,[0-9]{3}') THEN concat(regexp_extract(m, '([0-9])/,([0-9]{3})', 1), '12', substr(regexp_extract(m, '([0-9])/,([0-9]{3})', 2), 2, 2)) ELSE regexp_replace(m, '[^0-9]', '', 'g') END AS num FROM money) WHERE num <> '')
"""


@query(
    V.duck(
        "words",
        _LINES
        + _NUMBERS
        + """
, anchor AS (SELECT page_id, coalesce(arg_min(pos, pos) FILTER (WHERE text LIKE '%單價%'), arg_min(pos, pos) FILTER (WHERE text LIKE '%單%')) AS pos FROM l GROUP BY page_id)
, a AS (SELECT l.* FROM l JOIN anchor USING (page_id, pos))
, near AS (SELECT a.page_id, n.pos, n.numeric, row_number() OVER (PARTITION BY a.page_id ORDER BY sqrt((n.cx - a.cx) * (n.cx - a.cx) + (n.cy - a.cy) * (n.cy - a.cy)), n.pos) AS r FROM a JOIN nums n ON a.page_id = n.page_id AND n.value BETWEEN 1 AND 1000000
  AND ((abs(n.cy - a.cy) < greatest(a.y2 - a.y1, n.y2 - n.y1) * 2.2 AND n.cx > a.cx) OR (n.cy > a.cy AND abs(n.cx - a.cx) < greatest(a.x2 - a.x1, n.x2 - n.x1) * 8)))
SELECT page_id, pos, numeric FROM near WHERE r = 1
""",
    )
)
def nearest_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number nearest to the unit price's label."""
    anchor = layout.keyword(F.col("lines"), extract.KEYWORDS["unitPrice"])
    found = pages(spark, sf_dir).withColumn("anchor", anchor).select("page_id", layout.nearest_number(F.col("anchor"), F.col("lines"), lambda x: x["value"].between(1, 1_000_000)).alias("f"))
    return found.where(F.col("f").isNotNull()).select("page_id", "f.pos", "f.numeric")


@query(
    V.duck(
        "words",
        _LINES
        + _NUMBERS
        + """
, t AS (SELECT * FROM nums WHERE y1 BETWEEN 200 AND 390 AND value > 0)
, u AS (SELECT * FROM t WHERE value BETWEEN 100 AND 1000000 AND x1 BETWEEN 390 AND 570)
, a AS (SELECT u.page_id, u.pos AS up, n.value AS av, n.cy AS ay, n.conf AS ac, row_number() OVER (PARTITION BY u.page_id, u.pos ORDER BY abs(n.cy - u.cy), n.value DESC, n.rn) AS r FROM u JOIN t n ON u.page_id = n.page_id AND n.value BETWEEN 100 AND 10000000 AND n.x1 BETWEEN 580 AND 780 AND abs(n.cy - u.cy) < 24)
, q AS (SELECT u.page_id, u.pos AS up, n.value AS qv, n.conf AS qc, row_number() OVER (PARTITION BY u.page_id, u.pos ORDER BY abs(n.cy - u.cy), n.x1, n.rn) AS r FROM u JOIN t n ON u.page_id = n.page_id AND n.value BETWEEN 1 AND 999 AND n.x1 BETWEEN 300 AND 470 AND abs(n.cy - u.cy) < 42)
, j AS (SELECT u.page_id, u.pos, coalesce(qv, 1) AS quantity, CASE WHEN qv IS NULL AND av > u.value * 2 THEN av ELSE u.value END AS unit_price, coalesce(av, u.value) AS target, av, coalesce(ay, u.cy) AS height,
   least(coalesce(qc, 0.85), CASE WHEN u.conf > 0 THEN u.conf ELSE 0.6 END, CASE WHEN av IS NULL THEN 0.8 WHEN ac > 0 THEN ac ELSE 0.6 END) AS confidence FROM u LEFT JOIN (SELECT * FROM a WHERE r = 1) a ON a.page_id = u.page_id AND a.up = u.pos LEFT JOIN (SELECT * FROM q WHERE r = 1) q ON q.page_id = u.page_id AND q.up = u.pos)
SELECT page_id, CAST(quantity AS DOUBLE) AS quantity, unit_price, quantity * unit_price AS amount, height, confidence FROM j WHERE av IS NULL OR abs(quantity * unit_price - target) <= greatest(2, floor(target * CAST(0.01 AS DOUBLE) + 0.5))
""",
    )
)
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("page_id", F.explode(extract.table_rows(F.col("lines"))).alias("r"))
    return rows.select("page_id", "r.quantity", "r.unit_price", "r.amount", "r.height", "r.confidence")


@query()
def table_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the table without duplicates, fitted to the subtotal."""
    rows = pages(spark, sf_dir).select("page_id", extract.with_subtotal(extract.distinct_rows(extract.table_rows(F.col("lines"))), F.col("lines")).alias("rows"))
    return rows.select("page_id", F.posexplode("rows").alias("at", "r")).select("page_id", (F.col("at") + 1).alias("line_no"), "r.quantity", "r.unit_price", "r.amount", "r.confidence")


@query(
    V.duck(
        "words",
        _LINES
        + """
, hy AS (SELECT page_id, arg_min(y1, rn) FILTER (WHERE regexp_matches(text, '数量|數量|單價|单价')) AS header_y FROM l GROUP BY page_id)
, n AS (SELECT l.*, coalesce(header_y, 0) AS hy FROM l JOIN hy USING (page_id) WHERE abs(y1 - coalesce(header_y, 0)) <= 24)
, b AS (SELECT page_id, arg_max(cx, rn) FILTER (WHERE regexp_matches(text, '數量|数量')) AS qx, arg_max(cx, rn) FILTER (WHERE regexp_matches(text, '單價|单价')) AS px, arg_max(cx, rn) FILTER (WHERE regexp_matches(text, '金額|金额') OR text IN ('金', '額', '额')) AS ax FROM n GROUP BY page_id)
SELECT p.page_id, coalesce(qx - 48, 390.0::DOUBLE) AS quantity_low, coalesce(qx + 48, 505.0::DOUBLE) AS quantity_high, coalesce(px - 58, 505.0::DOUBLE) AS price_low, coalesce(px + 58, 625.0::DOUBLE) AS price_high, coalesce(ax - 75, 625.0::DOUBLE) AS amount_low, coalesce(ax + 75, 780.0::DOUBLE) AS amount_high FROM p LEFT JOIN b USING (page_id)
""",
    )
)
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.coalesce(layout.first(F.filter("lines", lambda x: x["text"].rlike("数量|數量|單價|单价")))["y1"], F.lit(0))
    found = pages(spark, sf_dir, True).withColumn("h", header).select("page_id", extract.column_bands(F.col("lines"), F.col("h")).alias("b"))
    return found.select("page_id", *[F.col(f"b.{n}.{e}").alias(f"{n}_{e}") for n in ("quantity", "price", "amount") for e in ("low", "high")])


@query()
def extract_items_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.items_by_headers(pages(spark, sf_dir)).select("page_id", F.posexplode("items").alias("at", "i"), "item_warnings")
    return found.select("page_id", (F.col("at") + 1).alias("line_no"), F.col("i.item_name").alias("item_name"), F.col("i.quantity").alias("quantity"), F.col("i.unit_price").alias("unit_price"), F.col("i.amount").alias("amount"), F.col("i.ocr_amount").alias("ocr_amount"), F.array_join("i.notes", ",").alias("warnings"))


@query()
def extract_items_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.items_by_bands(pages(spark, sf_dir, True)).select("page_id", F.posexplode("items").alias("at", "i"), F.size("item_warnings").alias("n_warnings"))
    return found.select("page_id", (F.col("at") + 1).alias("line_no"), F.col("i.name").alias("item_name"), F.col("i.quantity").alias("quantity"), F.col("i.unit_price").alias("unit_price"), F.col("i.amount").alias("amount"), F.col("i.confidence").alias("confidence"), F.col("i.status").alias("status"), "n_warnings")


@query()
def anchored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.anchored(pages(spark, sf_dir)).drop("lines")


_MONEY = r"""
, ln AS (SELECT doc_id, translate(unnest(string_split_regex(coalesce(text, ''), '\r?\n')), '¢SsOoIl|D%', '5550011103') AS m FROM documents)
, raws AS (SELECT doc_id, unnest(regexp_extract_all(m, '[0-9][0-9,]{2,}[0-9]')) AS raw FROM ln)
, c AS (
  SELECT doc_id, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS num, 'text' AS kind FROM raws WHERE length(regexp_replace(raw, '[^0-9]', '', 'g')) >= 4 AND TRY_CAST(regexp_replace(raw, '[^0-9]', '', 'g') AS DOUBLE) BETWEEN 1 AND 10000000
  UNION ALL SELECT doc_id, t, regexp_replace(t, '[^0-9]', '', 'g'), 'trimmed' FROM (SELECT doc_id, raw, regexp_replace(raw, '([0-9]{1,3},[0-9]{3})[0-9]$', '\1') AS t FROM raws) WHERE t <> raw AND length(regexp_replace(t, '[^0-9]', '', 'g')) >= 4
  UNION ALL SELECT doc_id, regexp_extract(m, '[0-9]/,[0-9]{3}', 0), concat(regexp_extract(m, '([0-9])/,([0-9]{3})', 1), '12', substr(regexp_extract(m, '([0-9])/,([0-9]{3})', 2), 2, 2)), 'hand' FROM ln WHERE regexp_matches(m, '[0-9]/,[0-9]{3}'))
"""


@query("WITH start AS (SELECT 1)" + _MONEY + 'SELECT doc_id, raw, num AS "numeric", kind FROM c')
def money_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.money_candidates(F.col("text"))).alias("c"))
    return found.select("doc_id", "c.*")


@query("WITH start AS (SELECT 1)" + _MONEY + ", v AS (SELECT doc_id, contains(raw, ',') AS comma, CAST(num AS DOUBLE) AS value FROM c), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY comma DESC, value DESC) AS r FROM v WHERE value BETWEEN 100 AND 1000000) SELECT d.doc_id, CAST(w.value AS BIGINT) AS unit_price FROM documents d LEFT JOIN (SELECT * FROM w WHERE r = 1) w USING (doc_id)")
def unit_price_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", extract.unit_price_of(extract.money_candidates(F.col("text"))).alias("unit_price"))


@query("WITH n AS (SELECT doc_id, TRY_CAST(unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS DOUBLE) AS v FROM documents), s AS (SELECT doc_id, CAST(sum(v) AS BIGINT) AS quantity FROM n WHERE v BETWEEN 1 AND 999 GROUP BY doc_id) SELECT d.doc_id, s.quantity FROM documents d LEFT JOIN s USING (doc_id)")
def quantity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", extract.quantity_from_text(F.col("text")).alias("quantity"))


@query(
    V.duck(
        "words",
        """
, c AS (SELECT page_id, top_ // 20 AS y, count(*) AS n FROM words GROUP BY ALL), i AS (SELECT *, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS g FROM c WHERE n >= 2)
SELECT page_id, CAST(min(y) AS INT) AS start, CAST(max(y) AS INT) AS stop, CAST(sum(n) AS BIGINT) AS score FROM i GROUP BY page_id, g HAVING max(y) - min(y) + 1 > 1
""",
    )
)
def layout_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of heights that hold two words or more."""
    counts = V.words(spark, sf_dir).groupBy("page_id", F.floor(F.col("top_") / 20).cast("int").alias("y")).agg(F.count("*").alias("n"))
    return layout.bands(counts, 2, 1)


@query(
    V.duck(
        "words",
        """
, s AS (SELECT page_id, list(left_ ORDER BY left_) AS xs, list(top_ ORDER BY top_) AS ys FROM words GROUP BY page_id)
SELECT page_id, xs[CAST(floor(len(xs) * CAST(0.01 AS DOUBLE)) AS BIGINT) + 1] AS x_low, xs[CAST(floor(len(xs) * CAST(0.99 AS DOUBLE)) AS BIGINT) + 1] AS x_high, ys[CAST(floor(len(ys) * CAST(0.01 AS DOUBLE)) AS BIGINT) + 1] AS y_low, ys[CAST(floor(len(ys) * CAST(0.99 AS DOUBLE)) AS BIGINT) + 1] AS y_high FROM s
""",
    )
)
def pixel_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.words(spark, sf_dir).groupBy("page_id").agg(F.collect_list("left_").alias("xs"), F.collect_list("top_").alias("ys"))
    rank = lambda c, q: layout.nearest_rank(F.col(c), q)
    return rows.select("page_id", rank("xs", 0.01).alias("x_low"), rank("xs", 0.99).alias("x_high"), rank("ys", 0.01).alias("y_low"), rank("ys", 0.99).alias("y_high"))
