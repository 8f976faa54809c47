"""The queries on words read whole texts, in pages of 40 words."""

import duckdb

from tallyframe import plans
from tallyframe.sources import views

from .test_oracles import ordered


def test_words_of_whole_texts(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    words = views.words(spark, small)
    assert words.count() == documents.selectExpr("sum(size(split(text, '[ \\\\n]+')))").first()[0]
    assert words.select("page_id", "pos").distinct().count() == words.count()
    assert words.agg({"pos": "max"}).first()[0] == 39


def test_region_merge_reads_every_word(spark, small, tmp_path):
    """A region per eight words, on every page."""
    docs = spark.createDataFrame([(1, " ".join(f"{i}" for i in range(100)), "en", "x", 1), (2, None, "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.QUERIES["region_merge"](spark, str(tmp_path))
    rows = found.collect()
    assert {(r["page_id"] - 1000003, r["region"]) for r in rows} == {(p, k) for p in range(3) for k in range(5) if 40 * p + 8 * k < 100}
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = connection.sql(plans.ORACLES["region_merge"])
    assert ordered(rows, found.columns) == ordered(want.fetchall(), want.columns)


def test_the_running_text_is_searched_once(spark, small):
    """Not again for each word of the page, and the numbers are not sought again for each prefix."""
    page = plans.QUERIES["service_invoice_no"](spark, small)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1 and plan.count("rlike(") + plan.count("RLIKE") <= 2
