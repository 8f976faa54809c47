"""Readers of recognition output and of the record store's files.

Broken files and rows are left out silently, as the store has always done: a file
that is no JSON array reads as an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Columns of a word-level row of tab-separated recognition output, from 0.
LEFT, TOP, WIDTH, HEIGHT, CONF, TEXT = 6, 7, 8, 9, 10, 11


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file, or JSON lines, of records; corrupt parts are dropped."""
    found = spark.read.schema(f"{schema}, corrupt_ string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt_").json(path)
    # The second condition always holds; a scan of the corrupt column alone isn't allowed.
    return found.where(F.col("corrupt_").isNull() & (F.hash(*[c for c in found.columns if c != "corrupt_"]) >= -(2**31))).drop("corrupt_")


def read_templates(spark: SparkSession, folder: str, schema: str, default: DataFrame) -> DataFrame:
    """All JSON files of a folder, each one template; the default if there is none. The
    check for none is a lookup of one row."""
    found = read_records(spark, folder, schema)
    return found if found.take(1) else default


def write_records(records: DataFrame, path: str) -> None:
    """Overwrite path with the records as JSON lines."""
    records.write.mode("overwrite").json(path)


def tsv_words(text: Column) -> Column:
    """Words of one page's tab-separated text: word-level rows with 12 columns or more,
    a text and a confidence of 0 or more. Bad numbers are 0."""
    rows = F.transform(F.slice(F.split(S.text(text), r"\r?\n"), 2, 1 << 30), lambda r: F.split(r, "\t"))
    good = F.filter(rows, lambda p: (F.size(p) >= 12) & (F.get(p, F.lit(0)) == "5"))
    number = lambda p, i: F.coalesce(F.get(p, F.lit(i)).try_cast("double"), F.lit(0.0))
    words = F.transform(good, lambda p: F.struct(number(p, LEFT).alias("left"), number(p, TOP).alias("top"), number(p, WIDTH).alias("width"), number(p, HEIGHT).alias("height"), number(p, CONF).alias("confidence"), F.trim(F.array_join(F.slice(p, TEXT + 1, 1 << 30), "\t")).alias("text")))
    return F.filter(words, lambda w: (w["text"] != "") & (w["confidence"] >= 0))


def polygon_box(points: Column) -> Column:
    """Integer bounds of an array of {x, y}; points without numbers are skipped, none give zeros."""
    good = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    edge = lambda f, k: F.coalesce(f(F.transform(good, lambda p: p[k])).cast("int"), F.lit(0))
    return F.struct(edge(F.array_min, "x").alias("x1"), edge(F.array_min, "y").alias("y1"), edge(F.array_max, "x").alias("x2"), edge(F.array_max, "y").alias("y2"))


def parallel_lines(texts: Column, scores: Column, boxes: Column) -> Column:
    """{text, confidence, box} from parallel arrays; empty texts go, missing scores are 0."""
    zipped = F.arrays_zip(texts.alias("t"), scores.alias("s"), boxes.alias("b"))
    made = F.transform(zipped, lambda z: F.struct(F.trim(S.text(z["t"])).alias("text"), F.coalesce(z["s"], F.lit(0.0)).alias("confidence"), polygon_box(z["b"]).alias("box")))
    return F.filter(made, lambda m: m["text"] != "")


def unit_box(min_x: Column, max_x: Column, max_y: Column, min_y: Column, width: float, height: float) -> Column:
    """Pixels from the top left of a box given as shares from the bottom left."""
    pixel = lambda c, least: F.greatest(F.lit(least), S.round_half_up(c).cast("int"))
    return F.struct(pixel(min_x * width, 0).alias("left"), pixel((1.0 - max_y) * height, 0).alias("top"), pixel((max_x - min_x) * width, 1).alias("width"), pixel((max_y - min_y) * height, 1).alias("height"))


def line_word(text: Column, score: Column, box: Column) -> Column:
    """A word of a line with a box {x1, y1, x2, y2}: missing edges are 0, no side is below 1, confidence is per cent."""
    edge = lambda k: F.coalesce(box[k], F.lit(0)).cast("int")
    side = lambda far, near: F.greatest(F.lit(1), edge(far) - edge(near))
    return F.struct(S.text(text).alias("text"), S.round_half_up(S.confidence(score) * 100).cast("int").alias("confidence"), edge("x1").alias("left"), edge("y1").alias("top"), side("x2", "x1").alias("width"), side("y2", "y1").alias("height"))


def on_page(word: Column, left: Column, top: Column, scale: Column) -> Column:
    """A word read in an enlarged crop, on the page: divided by the scale, halves up, and moved by the crop's origin."""
    share = lambda k: S.round_half_up(word[k] / F.greatest(F.lit(1.0), scale)).cast("int")
    return F.struct((share("left") + left).alias("left"), (share("top") + top).alias("top"), share("width").alias("width"), share("height").alias("height"))


def _number(v: Column) -> Column:
    """A JSON value as a finite number: null, false and blank strings are 0; what is missing or no number is null."""
    said, flag = F.trim(F.try_variant_get(v, "$", "string")), F.schema_of_variant(v) == "BOOLEAN"
    value = F.when(F.is_variant_null(v) | (said == "") | (flag & (said == "false")), F.lit(0.0)).when(flag, F.lit(1.0)).when(said.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), said.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def service_candidate(answer: Column) -> Column:
    """A recognition service's JSON answer as a candidate; one that is no JSON gives nulls, confidences of 0 and no items.
    A null quantity or amount is 0, a missing one null; a unit price has two names."""
    said = F.try_parse_json(answer)
    part = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    score = lambda v, path: S.confidence(_number(part(v, path, "variant")))
    item = lambda v: F.struct(
        _number(part(v, "$.quantity", "variant")).alias("quantity"), F.coalesce(part(v, "$.unitPrice"), part(v, "$.unit_price")).alias("unit_price"),
        _number(part(v, "$.amount", "variant")).alias("amount"), F.coalesce(part(v, "$.name"), F.lit("")).alias("name"), score(v, "$.confidence").alias("confidence"),
    )
    listed = lambda path, f, kind: F.coalesce(F.transform(part(said, path, "array<variant>"), f), F.array().cast(kind))
    return F.struct(
        part(said, "$.fields.invoiceNo.value").alias("invoice_no"), score(said, "$.fields.invoiceNo.confidence").alias("invoice_confidence"),
        part(said, "$.fields.buyerTaxId.value").alias("tax_id"), score(said, "$.fields.buyerTaxId.confidence").alias("tax_confidence"),
        listed("$.fields.items", item, "array<struct<quantity:double,unit_price:string,amount:double,name:string,confidence:double>>").alias("items"),
        part(said, "$.fields.subtotal").alias("subtotal"), part(said, "$.fields.tax").alias("tax"), part(said, "$.fields.total").alias("total"),
        listed("$.warnings", lambda w: F.coalesce(part(w, "$"), F.lit("null")), "array<string>").alias("warnings"),
    )


def answer_json(text: Column, schema: str) -> Column:
    """The object between the first and the last brace of a model's answer, null if it is none."""
    return F.from_json(F.regexp_extract(S.text(text), r"(?s)(\{.*\})", 1), schema)
