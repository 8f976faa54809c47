"""Layout folds against plain models, and extraction on drawn pages."""

import random

from pyspark.sql import functions as F

from tallyframe.operators import extract, layout, report
from tallyframe.sources import documents, providers, sheet
from tallyframe.streaming import edits


def page(spark, words):
    rows = [(1, i, t, x, y, w, 20, c) for i, (t, x, y, w, c) in enumerate(words)]
    return layout.gather(spark.createDataFrame(rows, "page_id long, pos long, text string, left_ int, top_ int, width_ int, height_ int, conf int"))


def test_row_groups_follow_the_running_mean(spark):
    chance = random.Random(8)
    pages = {p: [(chance.randrange(400), chance.randrange(300)) for _ in range(chance.randrange(1, 25))] for p in range(60)}
    rows = [(p, i, "x", x, y, 10, 20, 50) for p, ws in pages.items() for i, (x, y) in enumerate(ws)]
    df = layout.gather(spark.createDataFrame(rows, "page_id long, pos long, text string, left_ int, top_ int, width_ int, height_ int, conf int"))
    for r in df.select("page_id", layout.row_groups(F.col("lines"), 30).alias("g")).collect():
        model = []
        for i in sorted(range(len(pages[r["page_id"]])), key=lambda i: pages[r["page_id"]][i][1]):
            y = pages[r["page_id"]][i][1] + 10
            home = next((g for g in model if abs(sum(h for _, h in g) / len(g) - y) <= 30), None)
            model.append([(i, y)]) if home is None else home.append((i, y))
        want = [sorted((i for i, _ in g), key=lambda i: pages[r["page_id"]][i][0]) for g in model]
        assert [sorted(x["pos"] for x in g["row"]) for g in r["g"]] == [sorted(g) for g in want]
        assert [[pages[r["page_id"]][x["pos"]][0] for x in g["row"]] for g in r["g"]] == [[pages[r["page_id"]][i][0] for i in g] for g in want]


HEAD = [("品名", 60, 150, 60, 90), ("數量", 400, 150, 60, 90), ("單價", 530, 150, 60, 90), ("金額", 660, 150, 60, 90)]


def test_items_by_headers(spark):
    rows = [*HEAD, ("Pen", 60, 220, 60, 90), ("2", 420, 220, 20, 90), ("100", 550, 222, 40, 90), ("300", 680, 218, 40, 90), ("Ink", 60, 270, 60, 90), ("100", 550, 270, 40, 90), ("300", 680, 270, 40, 90), ("Cap", 60, 325, 60, 90), ("5", 420, 325, 20, 90), ("合計", 60, 340, 60, 90)]
    r = extract.items_by_headers(page(spark, rows)).first()
    got = [(i["item_name"], i["quantity"], i["unit_price"], i["amount"]) for i in r["items"]]
    assert got == [("Pen", 3.0, 100.0, 300.0), ("Ink", 3.0, 100.0, 300.0)]  # the last row holds a total's label
    assert r["item_warnings"] == ["quantity_corrected_from_amount_reference", "quantity_inferred_from_amount_reference"]


def test_items_by_bands(spark):
    rows = [*HEAD, ("Pen", 60, 220, 60, 90), ("Il", 420, 220, 20, 90), ("100", 550, 222, 40, 80), ("9000", 680, 218, 40, 90), ("Ink", 60, 290, 60, 90), ("3", 420, 290, 20, 90)]
    r = extract.items_by_bands(page(spark, rows).withColumn("lines", layout.by_place(F.col("lines")))).first()
    assert [(i["name"], i["quantity"], i["unit_price"], i["amount"], i["confidence"], i["status"]) for i in r["items"]] == [("Pen", 11, 100, 1100, 0.8, "NEEDS_REVIEW")]
    assert r["item_warnings"][0].startswith(extract.AMOUNT_DIFFERS) and r["item_warnings"][1] == extract.UNEVEN


def test_merged_header(spark):
    b = page(spark, [("品名", 60, 150, 60, 90), ("數量金", 400, 150, 60, 90)]).select(extract.column_bands(F.col("lines"), F.lit(150)).alias("b")).first()["b"]
    assert (b["quantity"]["low"], b["price"]["low"], b["amount"]["low"]) == (302.0, 407.0, 530.0)


def test_table_rows_and_subtotal(spark):
    rows = [("1", 400, 240, 20, 90), ("1000", 450, 240, 40, 90), ("1000", 600, 240, 40, 90), ("1000", 450, 250, 40, 90), ("2000", 450, 320, 40, 50), ("3050", 600, 440, 40, 90)]
    p = page(spark, rows)
    plain = p.select(extract.distinct_rows(extract.table_rows(F.col("lines"))).alias("r")).first()["r"]
    assert [(x["quantity"], x["unit_price"]) for x in plain] == [(1.0, 1000.0), (1.0, 2000.0)]
    r = extract.anchored(p).first()
    assert (r["quantity"], r["unit_price"], r["sales"], r["quantity_conf"]) == ("1,1", "1050,2000", "3050", 0.8)


def test_anchored_fields_without_a_table(spark):
    rows = [("AB", 100, 50, 30, 90), ("12345678", 160, 50, 80, 70), ("統一編號", 60, 120, 80, 90), ("87654321", 160, 120, 80, 80), ("數量", 60, 520, 40, 90), ("3", 120, 520, 20, 60), ("單價", 60, 600, 40, 90), ("50", 120, 600, 20, 70)]
    r = extract.anchored(page(spark, rows)).first()
    assert (r["invoice"], r["invoice_conf"], r["tax_id"], r["tax_conf"]) == ("AB12345678", 0.6, "87654321", 0.8)
    assert (r["quantity"], r["unit_price"], r["sales"]) == ("3", "50", "150")
    assert extract.anchored(page(spark, rows), ("12345678",)).first()["invoice"] == ""


def test_slashed_thousands(spark):
    found = page(spark, [("1/,234", 0, 0, 10, 90), ("abc", 0, 0, 10, 90)]).select(layout.number_words(F.col("lines")).alias("w")).first()["w"]
    assert [w["numeric"] for w in found] == ["11234"]


def test_records_file(spark, tmp_path):
    good, cut = tmp_path / "good.json", tmp_path / "cut.json"
    good.write_text('[{"id": "a", "n": 1}, {"id": "b"}]')
    cut.write_text('[{"id": "a", "n": 1}, {"id"')
    assert [tuple(r) for r in documents.read_records(spark, str(good), "id string, n int").collect()] == [("a", 1), ("b", None)]
    assert documents.read_records(spark, str(cut), "id string, n int").count() == 0
    default = spark.createDataFrame([("d", 0)], "id string, n int")
    assert documents.read_templates(spark, str(cut), "id string, n int", default).first()["id"] == "d"
    documents.write_records(default, str(tmp_path / "out"))
    assert documents.read_records(spark, str(tmp_path / "out"), "id string, n int").first()["id"] == "d"


def test_spreadsheet(spark, small):
    import io
    import zipfile
    from xml.dom.minidom import parseString

    from tallyframe.plans import ledger

    rows = report.with_totals(report.report_lines(ledger.report_records(spark, small).where("rec_id < 50")))
    book = zipfile.ZipFile(io.BytesIO(sheet.workbook(rows)))
    cells = parseString(book.read("xl/worksheets/sheet1.xml")).getElementsByTagName("row")
    assert len(cells) == rows.count() + 1
    assert report.TOTALS in cells[-1].toxml() and report.HEADINGS["invoice_number"] in cells[0].toxml()


def test_a_failing_image_is_one_row(spark):
    images = spark.createDataFrame([("a", b"x"), ("b", b"bad"), ("c", b"")], "image_id string, content binary")

    def read(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return [{"text": "hi", "confidence": 0.5, "x1": 0, "y1": 1, "x2": 2, "y2": 3}] if content else []

    found = {r["image_id"]: r for r in providers.recognise(images, "own", read).collect()}
    assert found["a"]["text"] == "hi" and found["b"]["error"] == "unreadable" and not found["b"]["ok"] and found["c"]["ok"]


def test_edits_as_a_stream(spark, small, tmp_path):
    from tallyframe.sources import views

    log = views.patches(spark, small)
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    run = edits.last_values(stream, ("quantity", "status")).writeStream.outputMode("complete").format("memory").queryName("last_values").option("checkpointLocation", str(tmp_path / "check")).start()
    run.processAllAvailable()
    run.stop()
    want = sorted(map(tuple, edits.last_values(log, ("quantity", "status")).collect()))
    assert sorted(map(tuple, spark.table("last_values").collect())) == want
    assert edits.windowed_counts(log).agg(F.sum("n")).first()[0] == log.count()


def test_anchored_fields_mend_numbers_once(spark):
    plan = extract.anchored(page(spark, [("1/,234", 0, 0, 10, 90)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
