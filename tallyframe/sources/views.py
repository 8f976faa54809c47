"""Invoice-like inputs derived from the star-schema tables.

Each view is one SQL text that Spark and DuckDB both run; table names stand in
braces. items: a row per invoice line. records: a row per invoice. words: boxes of
the words on a page. candidates: two recognisers' fields of each record. patches:
an edit log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ITEMS = """
SELECT l_orderkey AS rec_id,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS pos,
 p_name AS item_name,
 CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS quantity,
 CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE CAST(floor(l_extendedprice / l_quantity + 0.5) AS BIGINT) END AS unit_price,
 CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS ocr_amount,
 CAST(50 + l_partkey % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS conf
FROM {lineitem} LEFT JOIN {part} ON l_partkey = p_partkey
"""

RECORDS = """
SELECT o_orderkey AS rec_id,
 concat('B', CAST(o_custkey % 20 AS STRING)) AS batch_id,
 CASE WHEN o_orderkey % 7 = 4 THEN lpad(CAST(o_orderkey AS STRING), 8, '0')
      WHEN o_orderkey % 7 = 5 THEN concat(chr(CAST(97 + o_orderkey % 26 AS INT)), 'b-', lpad(CAST(o_orderkey AS STRING), 8, '0'))
      ELSE concat(chr(CAST(65 + o_orderkey % 26 AS INT)), chr(CAST(65 + CAST(floor(o_orderkey / 26) AS BIGINT) % 26 AS INT)), lpad(CAST(o_orderkey AS STRING), 8, '0')) END AS invoice_raw,
 CASE WHEN o_orderkey % 7 = 6 THEN lpad(CAST(o_orderkey AS STRING), 8, '0')
      WHEN o_orderkey % 11 = 3 THEN lpad(CAST(o_custkey AS STRING), 7, '0')
      ELSE lpad(CAST(o_custkey AS STRING), 8, '0') END AS tax_raw,
 CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'unconfirmed' END AS status,
 CASE WHEN o_orderkey % 6 = 0 THEN 'pending' WHEN o_orderkey % 6 = 1 THEN 'failed' WHEN o_orderkey % 6 = 2 THEN 'need_review' ELSE 'done' END AS processing_status,
 CAST(o_orderkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS conf,
 o_orderdate AS created_at
FROM {orders}
"""

#: Each document is dealt out in pages of 40 words, so that a page is bounded and every word of a text is on one.
_PAGES = "SELECT doc_id * 1000003 + CAST(floor(i / 40) AS BIGINT) AS page_id, i % 40 AS pos, tok FROM ({words})"
_TOKENS_SPARK = _PAGES.format(words=r"SELECT doc_id, CAST(i AS BIGINT) AS i, tok FROM {documents} LATERAL VIEW posexplode(split(text, '[ \\n]+')) t AS i, tok")
_TOKENS_DUCK = _PAGES.format(words=r"SELECT doc_id, CAST(i - 1 AS BIGINT) AS i, toks[i] AS tok FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '[ \n]+') AS toks FROM documents))")

WORDS = """
SELECT page_id, pos,
 CASE WHEN pos = 0 THEN CASE WHEN page_id % 5 = 0 THEN tok ELSE concat(chr(CAST(65 + page_id % 26 AS INT)), chr(CAST(65 + (page_id * 7) % 26 AS INT))) END
      WHEN pos = 1 THEN lpad(CAST((page_id * 7919 + 104729) % 100000000 AS STRING), 8, '0')
      WHEN pos = 5 THEN CASE WHEN page_id % 7 = 0 THEN '買受人' ELSE '統一編號' END
      WHEN pos = 6 THEN CASE WHEN page_id % 11 = 0 THEN lpad(CAST(page_id AS STRING), 7, '0') ELSE lpad(CAST((page_id * 6007 + 31337) % 100000000 AS STRING), 8, '0') END
      WHEN pos = 10 THEN '品名' WHEN pos = 11 THEN '數量' WHEN pos = 12 THEN '單價' WHEN pos = 13 THEN '金額'
      WHEN pos >= 15 AND pos % 5 = 1 AND (page_id + pos) % 9 <> 0 THEN CAST(1 + (page_id + pos - 1) % 12 AS STRING)
      WHEN pos >= 15 AND pos % 5 = 2 THEN CAST(100 + (page_id * 31 + (pos - 2) * 17) % 900 AS STRING)
      WHEN pos >= 15 AND pos % 5 = 3 THEN CAST((1 + (page_id + pos - 3) % 12) * (100 + (page_id * 31 + (pos - 3) * 17) % 900) + CASE WHEN (page_id + pos) % 4 = 0 THEN 1 ELSE 0 END AS STRING)
      ELSE tok END AS text,
 CAST(CASE WHEN pos = 1 THEN 160 WHEN pos = 6 THEN 200 WHEN pos % 5 = 0 THEN 40 WHEN pos < 10 AND pos % 5 = 2 THEN 520 WHEN pos < 10 AND pos % 5 = 3 THEN 700
      WHEN pos % 5 = 1 THEN 390 WHEN pos % 5 = 2 THEN 520 WHEN pos % 5 = 3 THEN 650 ELSE 900 END AS INT) AS left_,
 CAST(40 + 60 * CAST(floor(pos / 5) AS BIGINT) + CASE WHEN page_id % 4 = 3 THEN CASE WHEN pos % 5 = 3 THEN 32 ELSE 0 END ELSE (pos * 11 + page_id * 5) % 33 END AS INT) AS top_,
 CAST(8 * length(tok) + 8 AS INT) AS width_, 24 AS height_, CAST((pos * 31 + page_id * 7) % 101 AS INT) AS conf
FROM {tokens}
"""

CANDIDATES = """
SELECT r.rec_id, p.prio, p.source,
 CASE WHEN p.prio = 1 AND r.rec_id % 5 = 0 THEN concat('ZZ', lpad(CAST(r.rec_id AS STRING), 8, '0')) ELSE r.invoice_raw END AS invoice_raw,
 CASE WHEN p.prio = 1 AND r.rec_id % 9 = 0 THEN '00000000' ELSE r.tax_raw END AS tax_raw,
 CASE WHEN p.prio = 1 THEN r.conf ELSE CAST((r.rec_id * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS conf
FROM {records} r CROSS JOIN (SELECT 0 AS prio, 'paddleocr' AS source UNION ALL SELECT 1, 'macos_vision') p
"""

PATCHES = """
SELECT event_id AS seq, ts, user_id AS rec_id,
 CASE event_type WHEN 'click' THEN 'quantity' WHEN 'view' THEN 'unitPrice' WHEN 'signup' THEN 'taxId' WHEN 'purchase' THEN 'status' ELSE 'processingStatus' END AS field,
 CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'failed' ELSE regexp_extract(props, '([0-9]+)', 1) END AS value
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ITEMS, lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RECORDS, orders=table(spark, sf_dir, "orders"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = spark.sql(_TOKENS_SPARK, documents=table(spark, sf_dir, "documents"))
    return spark.sql(WORDS, tokens=tokens)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CANDIDATES, records=records(spark, sf_dir))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PATCHES, events=table(spark, sf_dir, "events"))


_DUCK = {
    "items": ITEMS.format(lineitem="lineitem", part="part"),
    "records": RECORDS.format(orders="orders"),
    "tokens_": _TOKENS_DUCK,
    "words": WORDS.format(tokens="tokens_"),
    "candidates": CANDIDATES.format(records="records"),
    "patches": PATCHES.format(events="events"),
}
_NEEDS = {"words": ["tokens_"], "candidates": ["records"]}


def duck(names: str, body: str, recursive: bool = False) -> str:
    """body with the named views as common table expressions; body may add its own
    by starting with ', name AS (...) SELECT ...'."""
    order: list[str] = []
    for name in names.split():
        order += [n for n in [*_NEEDS.get(name, []), name] if n not in order]
    body = body.strip()
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({_DUCK[n]})" for n in order) + ("\n" if body.startswith(",") else "\n") + body
