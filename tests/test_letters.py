"""Letters whose capital is several letters, and odd white space, as the queries' SQL takes them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe import plans
from tallyframe.functions import scalars as S

from .test_oracles import ordered


@pytest.mark.parametrize("name", ["extract_invoice_no", "prefix_pair", "service_invoice_no"])
def test_invoice_numbers(spark, tmp_path, name):
    # The first word stands as it is on pages that 5 divides; the view puts eight digits right of it.
    first = ["ß", "ﬁ", "st", "ſt", "ﬆ", "ı", "ıı", "ß12345678", "ﬂ12345678", "AB\x0b12345678", "AB\t12345678", "ẚb", "É", " ", "a"]
    docs = [(5 * k, f"{word} x ß y z und ﬁ 12345678", "de", "x", 1) for k, word in enumerate(first, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.QUERIES[name](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = connection.sql(plans.ORACLES[name])
    assert ordered(found.collect(), found.columns) == ordered(want.fetchall(), want.columns)


def test_capitals_of_every_letter(spark):
    plain = "regexp_replace(upper(chr(i::INT)), '[^A-Z]', '', 'g')"
    want = dict(duckdb.sql(f"SELECT i, {plain} FROM (SELECT unnest(range(1, 55296)) AS i) WHERE {plain} <> ''").fetchall())
    letters = spark.createDataFrame([(i, chr(i)) for i in range(1, 55296)] + [(i, chr(i)) for i in range(0xFB00, 0xFB20)], "i long, c string")
    got = letters.select("i", F.regexp_replace(S.capitals(F.col("c")), "[^A-Z]", "").alias("u")).where("u <> ''")
    assert {r["i"]: r["u"] for r in got.collect()} == want
