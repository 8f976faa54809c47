"""Queries on scalar rules, readers, lists, templates and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import records, store, templates
from ..sources import documents as D
from ..sources import views as V
from .checks import _LISTS, SELLERS, listed_records
from .registry import query


@query(V.duck("records", "SELECT rec_id, regexp_replace(invoice_raw, '[^0-9]', '', 'g') AS digits, regexp_replace(upper(invoice_raw), '[^A-Z0-9]', '', 'g') AS code, CAST(regexp_replace(tax_raw, '[^0-9]', '', 'g') AS BIGINT) AS number, CASE WHEN regexp_full_match(tax_raw, '[0-9]+') AND CAST(tax_raw AS BIGINT) > 0 THEN CAST(tax_raw AS BIGINT) END AS positive, concat(CAST(rec_id AS VARCHAR), '.5') AS said, CAST(rec_id * 10 + 5 AS BIGINT) AS joined FROM records"))
def digits_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.col("rec_id").cast("string"), F.lit(".5"))
    return V.records(spark, sf_dir).select("rec_id", S.digits(F.col("invoice_raw")).alias("digits"), S.invoice_code(F.col("invoice_raw")).alias("code"), S.integer_or_null(F.col("tax_raw")).alias("number"), S.number_from(F.col("tax_raw")).alias("positive"), said.alias("said"), S.number_value(said).alias("joined"))


@query(V.duck("words", "SELECT page_id, pos, translate(text, '¢SsOoIl|D%', '5550011103') AS money, regexp_replace(translate(upper(replace(trim(text), 'ß', 'SS')), 'IL|', '111'), '[^0-9]', '', 'g') AS cell FROM words"))
def money_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.words(spark, sf_dir).select("page_id", "pos", S.money_text(F.col("text")).alias("money"), S.digits(F.translate(F.upper(F.trim(F.col("text"))), "IL|", "111")).alias("cell"))


@query(V.duck("words", "SELECT page_id, pos, CASE WHEN n > 0 THEN n END AS cell FROM (SELECT page_id, pos, TRY_CAST(regexp_extract(translate(replace(text, ',', ''), '>＞', '22'), '[0-9]+(\\.[0-9]+)?', 0) AS DOUBLE) AS n FROM words)"))
def numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.words(spark, sf_dir).select("page_id", "pos", S.numeric_cell(F.col("text")).alias("cell"))


@query(V.duck("records", "SELECT rec_id, CASE WHEN rec_id % 4 = 0 THEN concat(CAST(rec_id % 1000 AS VARCHAR), ',0,', '7') WHEN rec_id % 4 = 1 THEN concat(CAST(rec_id % 1000 AS VARCHAR), ',7') WHEN rec_id % 4 = 2 THEN '12,34,5' ELSE '' END AS numbers, CAST(CASE WHEN rec_id % 4 = 0 THEN 3 WHEN rec_id % 4 = 1 THEN 2 WHEN rec_id % 4 = 2 THEN 3 ELSE 0 END AS INT) AS n FROM records"))
def number_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("rec_id") % 1000).cast("string")
    said = F.when(F.col("rec_id") % 4 == 0, F.concat(n, F.lit(",000/ x7"))).when(F.col("rec_id") % 4 == 1, F.concat(F.lit("$"), n, F.lit(" , 7 元"))).when(F.col("rec_id") % 4 == 2, "1a2/3-4\t5").otherwise(" abc ")
    numbers = S.number_list(said)
    return V.records(spark, sf_dir).select("rec_id", S.list_text(numbers).alias("numbers"), F.size(numbers).alias("n"))


@query(V.duck("records", "SELECT rec_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN c > 1 THEN c / 100 ELSE c END)) AS confidence, 0.0::DOUBLE AS bad FROM (SELECT rec_id, conf * 150 - 20 AS c FROM records)"))
def confidence_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.records(spark, sf_dir).select("rec_id", S.confidence(F.col("conf") * 150 - 20).alias("confidence"), S.confidence(F.when(F.col("rec_id") % 2 == 0, "x").otherwise("NaN")).alias("bad"))


_KINDS = "['invoiceNumber', 'taxId', 'quantity', 'unitPrice'][CAST(pos % 4 AS INT) + 1]"
_CLEAN = r"CASE WHEN kind = 'invoiceNumber' THEN regexp_replace(upper(replace(regexp_replace(text, '\s+', '', 'g'), 'ß', 'SS')), '[^A-Z0-9]', '', 'g') ELSE regexp_replace(translate(regexp_replace(text, '\s+', '', 'g'), 'OoIl|Ss', '0011155'), '[^0-9]', '', 'g') END"


def _score(full: float, part: float, some: float, number: float, long: float) -> str:
    return f"""CASE kind WHEN 'invoiceNumber' THEN CASE WHEN regexp_full_match(cleaned, '[A-Z]{{2}}[0-9]{{8}}') THEN {full} WHEN regexp_matches(cleaned, '[0-9]{{8}}') THEN {part} ELSE 0 END WHEN 'taxId' THEN CASE WHEN regexp_full_match(cleaned, '[0-9]{{8}}') THEN {full} WHEN length(cleaned) >= 6 THEN {some} ELSE 0 END
 WHEN 'quantity' THEN CASE WHEN TRY_CAST(cleaned AS DOUBLE) BETWEEN 1 AND 999 THEN {number} ELSE 0 END ELSE CASE WHEN TRY_CAST(cleaned AS DOUBLE) BETWEEN 1 AND 1000000 THEN {number} ELSE 0 END + CASE WHEN length(cleaned) >= 4 THEN {long} ELSE 0 END END"""


_REGIONS = f", k AS (SELECT page_id, pos, text, conf, {_KINDS} AS kind FROM words), r AS (SELECT *, {_CLEAN} AS cleaned FROM k)\n"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("invoiceNumber", "taxId", "quantity", "unitPrice"))), (F.col("pos") % 4).cast("int"))
    rows = V.words(spark, sf_dir).withColumn("kind", kind)
    return rows.withColumn("cleaned", S.region_clean(F.col("kind"), F.col("text")))


@query(V.duck("words", _REGIONS + f"SELECT page_id, pos, kind, cleaned, CAST(conf / 100.0::DOUBLE + {_score(3, 1.5, 1, 2.5, 0.5)} AS DOUBLE) AS score FROM r"))
def region_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).select("page_id", "pos", "kind", "cleaned", S.region_score(F.col("kind"), F.col("cleaned"), F.col("conf") / 100.0, vision=False).alias("score"))


@query(
    V.duck(
        "words",
        _REGIONS
        + f"""
, t AS (SELECT page_id, CAST(floor(pos / 8) AS INT) AS region, kind, cleaned, conf / 100.0::DOUBLE + {_score(3, 1.5, 1, 2.5, 0.5)} AS score FROM r WHERE pos % 8 < 4 AND conf >= 20), v AS (SELECT page_id, CAST(floor(pos / 8) AS INT) AS region, kind, cleaned, conf / 100.0::DOUBLE + {_score(4, 2, 1.5, 3, 1)} AS score FROM r WHERE pos % 8 >= 4 AND conf >= 20), b AS (SELECT page_id, region, kind, t.cleaned AS tc, t.score AS ts, v.cleaned AS vc, v.score AS vs, v.score IS NOT NULL AND (t.score IS NULL OR v.score >= t.score) AS wins FROM t FULL JOIN v USING (page_id, region, kind))
SELECT page_id, region, kind, CASE WHEN wins THEN 'vision' ELSE 'tesseract' END AS winner, CASE WHEN wins THEN vc ELSE tc END AS text, CASE WHEN wins THEN tc ELSE vc END AS fallback, CAST(CASE WHEN wins THEN vs ELSE ts END AS DOUBLE) AS score FROM b
""",
    )
)
def region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recognisers' texts of each region, four of eight words each; the better score wins, ties
    the second's. A recogniser that is less than 20 % sure has read nothing."""
    rows = _regions(spark, sf_dir).where("conf >= 20").withColumn("region", F.floor(F.col("pos") / 8).cast("int"))

    def side(vision: bool) -> DataFrame:
        score = S.region_score(F.col("kind"), F.col("cleaned"), F.col("conf") / 100.0, vision).alias("score")
        return rows.where((F.col("pos") % 8 >= 4) == F.lit(vision)).select("page_id", "region", "kind", F.struct("cleaned", score).alias("v" if vision else "t"))

    both = side(False).join(side(True), ["page_id", "region", "kind"], "full_outer")
    wins = F.col("v").isNotNull() & (F.col("t").isNull() | (F.col("v.score") >= F.col("t.score")))
    pick = lambda a, b: F.when(wins, F.col(a)).otherwise(F.col(b))
    return both.select("page_id", "region", "kind", F.when(wins, "vision").otherwise("tesseract").alias("winner"), pick("v.cleaned", "t.cleaned").alias("text"), pick("t.cleaned", "v.cleaned").alias("fallback"), pick("v.score", "t.score").alias("score"))


@query(V.duck("items records", _LISTS + ", u AS (SELECT rec_id, qs, ps, unnest(range(1, greatest(len(coalesce(qs, [])), len(coalesce(ps, []))) + 1)) AS i FROM records JOIN grouped USING (rec_id)) SELECT rec_id, CAST(i AS INT) AS line_no, qs[i] AS quantity, ps[i] AS unit_price, qs[i] * ps[i] AS amount FROM u"))
def zip_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = store.line_items(F.col("quantity"), F.col("unit_price"), F.array().cast("array<string>"))
    rows = listed_records(spark, sf_dir).select("rec_id", F.explode(items).alias("x"))
    return rows.select("rec_id", "x.line_no", "x.quantity", "x.unit_price", "x.amount")


@query(
    V.duck(
        "items records",
        """, g AS (SELECT rec_id, list(quantity ORDER BY pos) FILTER (WHERE quantity IS NOT NULL) AS qs, list(unit_price ORDER BY pos) FILTER (WHERE unit_price IS NOT NULL) AS ps, list(coalesce(item_name, '') ORDER BY pos) AS names FROM items GROUP BY rec_id), u AS (SELECT *, unnest(range(1, greatest(len(coalesce(qs, [])), len(coalesce(ps, []))) + 1)) AS i FROM g)
SELECT rec_id, CAST(i AS INT) AS line_no, coalesce(names[i], '') AS item_name, CASE WHEN qs[i] IS NOT NULL AND ps[i] IS NOT NULL THEN 'auto' ELSE 'manual_required' END AS status FROM u""",
    )
)
def carry_item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of existing items carried over to edited lists by position."""
    names = V.items(spark, sf_dir).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("item_name", F.lit("")).alias("n")))).alias("its")).select("rec_id", F.col("its.n").alias("names"))
    rows = listed_records(spark, sf_dir).join(names, "rec_id").select("rec_id", F.explode(store.line_items(F.col("quantity"), F.col("unit_price"), F.col("names"))).alias("x"))
    return rows.select("rec_id", "x.line_no", "x.item_name", "x.status")


_EDIT = """
, e AS (SELECT rec_id, arg_max(value, seq) FILTER (WHERE field = 'quantity') AS q, arg_max(value, seq) FILTER (WHERE field = 'unitPrice') AS p, arg_max(value, seq) FILTER (WHERE field = 'taxId') AS t, arg_max(value, seq) FILTER (WHERE field = 'status') AS s FROM patches GROUP BY rec_id)
, b AS (SELECT r.rec_id, r.invoice_raw, e.q IS NOT NULL OR e.p IS NOT NULL AS listed, e.s IS NOT NULL AS confirmed, coalesce(e.t, r.tax_raw) AS tax_raw, CASE WHEN e.q IS NOT NULL THEN [TRY_CAST(e.q AS BIGINT)] ELSE coalesce(g.qs, []) END AS qs, CASE WHEN e.p IS NOT NULL THEN [TRY_CAST(e.p AS BIGINT)] ELSE coalesce(g.ps, []) END AS ps FROM records r JOIN e USING (rec_id) LEFT JOIN grouped g USING (rec_id))
, c AS (SELECT *, CASE WHEN len(qs) > 0 AND len(qs) = len(ps) THEN CAST(list_sum(list_transform(range(1, len(qs) + 1), lambda i: qs[i] * ps[i])) AS BIGINT) ELSE 0 END AS sales, regexp_replace(upper(invoice_raw), '[^A-Z0-9]', '', 'g') AS code, regexp_replace(tax_raw, '[^0-9]', '', 'g') AS tax FROM b)
, d AS (SELECT *, NOT regexp_full_match(code, '[A-Z]{2}[0-9]{8}') AS e1, NOT regexp_full_match(tax, '[0-9]{8}') AS e2, len(qs) = 0 OR len(list_filter(qs, lambda x: x <= 0 OR x > 999)) > 0 AS e3, len(ps) = 0 OR len(list_filter(ps, lambda x: x <= 0 OR x > 1000000)) > 0 AS e4 FROM c)
, f AS (SELECT *, e1::INT + e2::INT + e3::INT + e4::INT + (NOT e3 AND NOT e4 AND len(qs) <> len(ps))::INT AS n FROM d)
"""


@query(
    V.duck(
        "items records patches",
        _LISTS
        + _EDIT
        + """SELECT rec_id, tax_raw AS tax_id, array_to_string(qs, ',') AS quantity, array_to_string(ps, ',') AS unit_price, CASE WHEN NOT listed THEN NULL WHEN sales > 0 THEN CAST(sales AS VARCHAR) ELSE '' END AS sales_amount, CASE WHEN NOT listed THEN NULL WHEN sales > 0 THEN CAST(CAST(floor(sales * CAST(0.05 AS DOUBLE) + 0.5) AS BIGINT) AS VARCHAR) ELSE '' END AS tax_amount,
 CASE WHEN NOT listed THEN NULL WHEN sales > 0 THEN 'formula' ELSE 'none' END AS amount_source, CASE WHEN confirmed THEN 'confirmed' ELSE 'unconfirmed' END AS status, CASE WHEN confirmed OR n = 0 THEN 'done' ELSE 'need_review' END AS processing_status, CASE WHEN confirmed OR n = 0 THEN 'medium' ELSE 'low' END AS confidence_level, CAST(CASE WHEN confirmed THEN 0 ELSE n END AS INT) AS n_errors FROM f""",
    )
)
def edit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last edit of each field applied: lists, sums, checks, status. A confirmed record isn't checked."""
    edits = store.fold_edits(V.patches(spark, sf_dir), ("quantity", "unitPrice", "taxId", "status"))
    rows = listed_records(spark, sf_dir).join(edits.withColumnsRenamed({"quantity": "q", "unitPrice": "p", "taxId": "t", "status": "s"}), "rec_id")
    rows = rows.withColumns({"quantity": F.coalesce("q", "quantity"), "unit_price": F.coalesce("p", "unit_price"), "tax_id": F.coalesce("t", "tax_id"), **{f"conf_{k}": F.lit(1.0) for k in ("invoice", "tax", "quantity", "price")}})
    done = records.official(rows)
    listed, confirmed = F.col("q").isNotNull() | F.col("p").isNotNull(), F.col("s") == "confirmed"
    sales = store.sales_of(F.col("quantity"), F.col("unit_price"))
    tax, _ = S.tax_and_total(sales.cast("string"))
    n = F.when(confirmed, 0).otherwise(F.size("errors"))
    return done.select(
        "rec_id", "tax_id", S.list_text(S.number_list(F.col("quantity"))).alias("quantity"), S.list_text(S.number_list(F.col("unit_price"))).alias("unit_price"), F.when(listed, F.when(sales > 0, sales.cast("string")).otherwise("")).alias("sales_amount"), F.when(listed, tax).alias("tax_amount"), F.when(listed, F.when(sales > 0, "formula").otherwise("none")).alias("amount_source"),
        F.when(confirmed, "confirmed").otherwise("unconfirmed").alias("status"), F.when(n == 0, "done").otherwise("need_review").alias("processing_status"), F.when(n == 0, "medium").otherwise("low").alias("confidence_level"), n.alias("n_errors"),
    )


_TEMPLATES = "SELECT concat('t', lpad(CAST(s_suppkey AS STRING), 4, '0')) AS template_id, substring(s_name, 1, 80) AS vendor_name, lpad(CAST(s_suppkey AS STRING), 8, '0') AS vendor_tax_id FROM {supplier}"


@query(
    f"WITH t AS ({_TEMPLATES.format(supplier='supplier')}), p AS (SELECT o_orderkey AS page_id, concat('x', lpad(CAST(o_custkey AS VARCHAR), 8, '0'), ' y') AS said FROM orders), h AS (SELECT page_id, min(template_id) AS found FROM p JOIN t ON contains(said, vendor_tax_id) GROUP BY page_id) SELECT page_id, coalesce(found, (SELECT min(template_id) FROM t)) AS template_id, CASE WHEN found IS NULL THEN 'default-template' ELSE 'seller-tax-id' END AS reason FROM p LEFT JOIN h USING (page_id)"
)
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("x"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit(" y")).alias("text"))
    return templates.match(pages, spark.sql(_TEMPLATES, supplier=V.table(spark, sf_dir, "supplier")))


@query("WITH b AS (SELECT s_suppkey, least(1.0::DOUBLE, greatest(0.0::DOUBLE, s_acctbal / 5000)) AS x, least(1.0::DOUBLE, greatest(0.01::DOUBLE, s_acctbal / 20000)) AS w FROM supplier), c AS (SELECT *, least(x, 0.99) AS cx, least(w, 1 - least(x, 0.99)) AS cw FROM b) SELECT concat('t-', CAST(s_suppkey AS VARCHAR)) AS template_id, x, w, CAST(floor(cx * 1200 + 0.5) AS INT) AS left_, greatest(1, CAST(floor(cw * 1200 + 0.5) AS INT)) AS width_ FROM c")
def template_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.table(spark, sf_dir, "supplier")
    r = templates.region(F.col("s_acctbal") / 5000, F.lit("bad"), F.col("s_acctbal") / 20000, F.lit(None), (0.1, 0.1, 0.2, 0.2))
    rows = s.select(S.safe_template_id(F.concat(F.lit("t /"), F.col("s_suppkey").cast("string"))).alias("template_id"), r.alias("r")).withColumn("p", templates.pixels(F.col("r"), 1200.0, 700.0))
    return rows.select("template_id", "r.x", "r.w", F.col("p.left").alias("left_"), F.col("p.width").alias("width_"))


@query("SELECT s_suppkey AS template_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS vendor_name, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS updated_at FROM supplier")
def template_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("template_id"))
    return templates.save(ids.select("template_id", F.lit("old").alias("vendor_name"), F.lit(1).alias("updated_at")), ids.where(F.col("template_id") % 3 == 0).select("template_id", F.lit("new").alias("vendor_name"), F.lit(2).alias("updated_at")))


@query(V.duck("records", f"SELECT rec_id, tax_raw FROM records WHERE tax_raw NOT IN {SELLERS}"))
def seller_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.records(spark, sf_dir).where(~F.col("tax_raw").isin(*SELLERS)).select("rec_id", "tax_raw")


@query(V.duck("records", "SELECT rec_id, concat('/api/files/uploads/', batch_id, '/', CAST(rec_id AS VARCHAR), '.jpg') AS image_url, CASE WHEN rec_id % 2 = 0 THEN '' ELSE concat('/api/files/', batch_id) END AS thumbnail_url FROM records"))
def present_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.concat(F.lit("data//uploads/"), F.col("batch_id"), F.lit("/"), F.col("rec_id").cast("string"), F.lit(".jpg"))
    thumb = F.when(F.col("rec_id") % 2 == 0, "").otherwise(F.concat(F.lit("/"), F.col("batch_id")))
    return V.records(spark, sf_dir).select("rec_id", S.public_url(image).alias("image_url"), F.when(thumb == "", "").otherwise(S.public_url(thumb)).alias("thumbnail_url"))


@query(V.duck("records", "SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN concat('a_b_', CAST(rec_id AS VARCHAR), '.png') WHEN rec_id % 3 = 1 THEN '發票_1.jpg' ELSE 'invoice.jpg' END AS name, concat(lpad(CAST(rec_id % 1000 AS VARCHAR), 3, '0'), '-x') AS numbered FROM records"))
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("rec_id") % 3 == 0, F.concat(F.lit("dir/a b&*"), F.col("rec_id").cast("string"), F.lit(".PNG"))).when(F.col("rec_id") % 3 == 1, "發票 1").otherwise("")
    return V.records(spark, sf_dir).select("rec_id", S.safe_name(raw).alias("name"), F.concat(F.lpad((F.col("rec_id") % 1000).cast("string"), 3, "0"), F.lit("-x")).alias("numbered"))


@query(V.duck("words", "SELECT page_id, CAST(left_ AS DOUBLE) AS left_, CAST(top_ AS DOUBLE) AS top_, CAST(conf AS DOUBLE) AS confidence, trim(text) AS text FROM words WHERE pos % 3 <> 1 AND trim(text) <> ''"))
def tsv_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words written as tab-separated text, a page each, and read back."""
    level = F.when(F.col("pos") % 3 == 1, "4").otherwise("5")
    row = F.array_join(F.array(level, *[F.lit("1")] * 5, *[F.col(c).cast("string") for c in ("left_", "top_", "width_", "height_", "conf")], F.col("text")), "\t")
    text = V.words(spark, sf_dir).groupBy("page_id").agg(F.array_join(F.concat(F.array(F.lit("level\thead")), F.collect_list(row)), "\n").alias("tsv"))
    rows = text.select("page_id", F.explode(D.tsv_words(F.col("tsv"))).alias("w"))
    return rows.select("page_id", F.col("w.left").alias("left_"), F.col("w.top").alias("top_"), "w.confidence", "w.text")


@query(V.duck("words", "SELECT page_id, pos, left_ AS x1, top_ AS y1, left_ + width_ AS x2, top_ + height_ AS y2, trim(text) AS text FROM words WHERE trim(text) <> ''"))
def polygon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines given as parallel arrays with polygons."""
    p = lambda x, y: F.struct((x + F.lit(0.4)).cast("double").alias("x"), (y + F.lit(0.2)).cast("double").alias("y"))
    l, t = F.col("left_"), F.col("top_")
    r, b = l + F.col("width_"), t + F.col("height_")
    made = D.parallel_lines(F.array("text"), F.array((F.col("conf") / 100.0)), F.array(F.array(p(l, t), p(r, t), p(r, b), p(l, b))))
    rows = V.words(spark, sf_dir).select("page_id", "pos", F.explode(made).alias("m"))
    return rows.select("page_id", "pos", "m.box.x1", "m.box.y1", "m.box.x2", "m.box.y2", "m.text")


@query(V.duck("words", "SELECT page_id, pos, CAST(floor(left_ / 1200.0::DOUBLE * 1200 + 0.5) AS INT) AS left_, greatest(0, CAST(floor((1.0 - (1 - top_ / 700.0::DOUBLE)) * 700 + 0.5) AS INT)) AS top_ FROM words"))
def unit_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("left_") / 1200.0, F.lit(1.0) - F.col("top_") / 700.0
    rows = V.words(spark, sf_dir).select("page_id", "pos", D.unit_box(x, x + F.col("width_") / 1200.0, y, y - F.col("height_") / 700.0, 1200.0, 700.0).alias("b"))
    return rows.select("page_id", "pos", F.col("b.left").alias("left_"), F.col("b.top").alias("top_"))


@query(V.duck("records", "SELECT rec_id, CASE WHEN rec_id % 7 <> 6 THEN concat('AB', CAST(rec_id AS VARCHAR)) END AS invoice_no, CASE WHEN rec_id % 7 = 6 THEN 0.0::DOUBLE ELSE (rec_id % 100) / 100.0::DOUBLE END AS invoice_confidence, CASE WHEN rec_id % 7 <> 6 THEN CAST(rec_id AS VARCHAR) END AS total, CAST(CASE WHEN rec_id % 7 = 6 THEN 0 ELSE 1 END AS INT) AS n_warnings, CASE rec_id % 7 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 3 THEN 4.5::DOUBLE WHEN 5 THEN 0.0::DOUBLE END AS quantity, CASE WHEN rec_id % 7 < 6 THEN CASE WHEN rec_id % 2 = 0 THEN '12' ELSE '9.5' END END AS unit_price, CASE WHEN rec_id % 7 < 6 THEN '' END AS name FROM records"))
def service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose quantity is a number, null, missing, a string, no number or blank; every seventh is no JSON."""
    r = F.col("rec_id")
    quantity = F.element_at(F.array(*map(F.lit, ['"quantity": 3,', '"quantity": null,', "", '"quantity": " 4.5 ",', '"quantity": "4x",', '"quantity": "",', ""])), (r % 7 + 1).cast("int"))
    price = F.when(r % 2 == 0, F.lit('"unitPrice": null, "unit_price": 12')).otherwise(F.lit('"unitPrice": "9.5", "unit_price": 12'))
    whole = F.concat(F.lit('{"fields": {"invoiceNo": {"value": "AB'), r, F.lit('", "confidence": '), ((r % 100) / 100.0).cast("string"), F.lit('}, "items": [{'), quantity, price, F.lit('}], "total": '), r, F.lit('}, "warnings": ["w"]}'))
    answer = F.when(r % 7 == 6, F.substring(whole, 1, 20)).otherwise(whole)
    rows = V.records(spark, sf_dir).select("rec_id", D.service_candidate(answer).alias("c"))
    first = F.get("c.items", F.lit(0))
    return rows.select("rec_id", "c.invoice_no", "c.invoice_confidence", "c.total", F.size("c.warnings").alias("n_warnings"), first["quantity"].alias("quantity"), first["unit_price"].alias("unit_price"), first["name"].alias("name"))


@query(V.duck("words", "SELECT page_id, pos, text, CAST(floor(c * 100 + 0.5) AS INT) AS confidence, CASE WHEN pos % 11 = 3 THEN 0 ELSE left_ END AS left_, top_, CASE WHEN pos % 7 = 0 THEN 1 WHEN pos % 11 = 3 THEN greatest(1, left_ + width_) ELSE greatest(1, width_) END AS width_, greatest(1, height_) AS height_ FROM (SELECT *, (CASE WHEN pos % 4 = 0 THEN pos % 90 + 10 ELSE (pos % 100) / 100.0::DOUBLE END) / (CASE WHEN pos % 4 = 0 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END) AS c FROM words)"))
def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with boxes as words: every fourth score is per cent, every seventh box ends where it starts, every eleventh has no left edge."""
    score = F.when(F.col("pos") % 4 == 0, (F.col("pos") % 90 + 10).cast("double")).otherwise((F.col("pos") % 100) / F.lit(100.0))
    start = F.when(F.col("pos") % 11 != 3, F.col("left_"))
    end = F.when(F.col("pos") % 7 == 0, F.coalesce(start, F.lit(0))).otherwise(F.col("left_") + F.col("width_"))
    box = F.struct(start.alias("x1"), F.col("top_").alias("y1"), end.alias("x2"), (F.col("top_") + F.col("height_")).alias("y2"))
    rows = V.words(spark, sf_dir).select("page_id", "pos", D.line_word(F.col("text"), score, box).alias("w"))
    return rows.select("page_id", "pos", "w.text", "w.confidence", *[F.col(f"w.{k}").alias(f"{k}_") for k in ("left", "top", "width", "height")])


@query(V.duck("words", "SELECT page_id, pos, CAST(floor(left_ / s + 0.5) AS INT) + 25 AS left_, CAST(floor(top_ / s + 0.5) AS INT) + CAST(page_id % 9 AS INT) AS top_, CAST(floor(width_ / s + 0.5) AS INT) AS width_, CAST(floor(height_ / s + 0.5) AS INT) AS height_ FROM (SELECT *, greatest(1.0::DOUBLE, CAST(pos % 5 AS DOUBLE)) AS s FROM words)"))
def crop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of crops enlarged one to four times, on their page; a scale below 1 counts as 1."""
    word = F.struct(*[F.col(f"{k}_").alias(k) for k in ("left", "top", "width", "height")])
    origin = F.lit(25), (F.col("page_id") % 9).cast("int")
    rows = V.words(spark, sf_dir).select("page_id", "pos", D.on_page(word, *origin, (F.col("pos") % 5).cast("double")).alias("w"))
    return rows.select("page_id", "pos", *[F.col(f"w.{k}").alias(f"{k}_") for k in ("left", "top", "width", "height")])


@query(V.duck("records", "SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN invoice_raw ELSE concat('AB', lpad(CAST(rec_id AS VARCHAR), 8, '0')) END AS invoice_number, CASE WHEN rec_id % 5 = 4 THEN tax_raw WHEN rec_id % 3 = 0 THEN tax_raw ELSE tax_raw END AS tax_id FROM records"))
def enhance_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what is missing is filled from another recogniser's JSON answer."""
    answer = F.concat(F.lit('Sure: {"invoiceNumber": "AB'), F.lpad(F.col("rec_id").cast("string"), 8, "0"), F.lit('", "taxId": null} ok'))
    rows = V.records(spark, sf_dir).withColumns({"own": F.when(F.col("rec_id") % 3 == 0, F.col("invoice_raw")).otherwise(""), "said": D.answer_json(answer, "invoiceNumber string, taxId string")})
    fill = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    return rows.select("rec_id", fill(F.col("own"), F.col("said.invoiceNumber")).alias("invoice_number"), fill(F.col("tax_raw"), F.col("said.taxId")).alias("tax_id"))


@query("SELECT user_id AS rec_id, count(*) AS n_edits, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def edit_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that the streaming fold of edits keeps, as one batch."""
    e = V.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("rec_id")).agg(F.count("*").alias("n_edits"), F.max_by("event_type", "event_id").alias("last_type"))
