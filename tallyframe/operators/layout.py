"""Geometry of recognised text: lines with boxes, rows of a table, nearest neighbours.

A page is one row (page_id, lines); lines is an array of structs {pos, text, conf
(0..1), x1, y1, x2, y2, cx, cy} in order of pos. All of this runs inside one
array, a whole page however long, and the only shuffle is the one that gathers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

WIDTH, HEIGHT = 1200.0, 700.0


def gather(words: DataFrame) -> DataFrame:
    """words(page_id, pos, text, left_, top_, width_, height_, conf 0..100) -> (page_id, lines)."""
    x1, y1 = F.col("left_"), F.col("top_")
    x2, y2 = x1 + F.col("width_"), y1 + F.col("height_")
    line = F.struct("pos", S.text(F.col("text")).alias("text"), (F.col("conf") / 100.0).alias("conf"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), ((x1 + x2) / 2.0).alias("cx"), ((y1 + y2) / 2.0).alias("cy"))
    return words.groupBy("page_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))


def let(value: Column, use) -> Column:
    """use(value) with value worked out once. Columns are expressions: one that stands in
    several places of another is evaluated in each of them."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def first(found: Column) -> Column:
    """The first element, null if there is none."""
    return F.get(found, F.lit(0))


def ordered(found: Column, *keys) -> Column:
    """An array sorted by functions of its elements, ties in the order they stand in."""
    keyed = F.transform(found, lambda x, i: F.struct(*[k(x).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), x.alias("x")))
    # sort_array, as array_sort calls an interpreted function for each comparison.
    return F.transform(F.sort_array(keyed), lambda s: s["x"])


def by_place(found: Column) -> Column:
    """Top to bottom, then left to right."""
    return ordered(found, lambda x: x["y1"], lambda x: x["x1"])


def row_groups(found: Column, tolerance: float) -> Column:
    """Lines as rows, in order of height: each joins the first row whose mean height lies
    within the tolerance, or opens one. {s, n, row}; row is sorted from left to right.

    The mean moves with each line, so this is a fold and no split at gaps."""
    start = F.expr("filter(array(named_struct('s', 0D, 'n', 0, 'is', array(0))), x -> false)")
    held = F.transform(ordered(found, lambda x: x["cy"]), lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def add(rows: Column, h: Column) -> Column:
        y, i = h["x"]["cy"], h["i"]
        joined = lambda at: F.transform(rows, lambda r, k: F.when(k == at, F.struct((r["s"] + y).alias("s"), (r["n"] + 1).alias("n"), F.concat(r["is"], F.array(i)).alias("is"))).otherwise(r))
        opened = F.concat(rows, F.array(F.struct(y.alias("s"), F.lit(1).alias("n"), F.array(i).alias("is"))))
        fits = F.array_position(F.transform(rows, lambda r: F.abs(r["s"] / r["n"] - y) <= tolerance), F.lit(True)).cast("int") - 1
        return let(fits, lambda at: F.when(at >= 0, joined(at)).otherwise(opened))

    # The fold only moves numbers of lines; the lines are looked up once it is done.
    def rows_of(lines: Column) -> Column:
        rows = F.aggregate(lines, start, add)
        return F.transform(rows, lambda r: F.struct(r["s"].alias("s"), r["n"].alias("n"), ordered(F.transform(r["is"], lambda i: F.get(lines, i)["x"]), lambda x: x["cx"]).alias("row")))

    return let(held, rows_of)


def texts(found: Column, sep: str) -> Column:
    return F.array_join(F.transform(found, lambda x: x["text"]), sep)


def compact(found: Column) -> Column:
    """Trimmed texts run together."""
    return F.array_join(F.transform(found, lambda x: F.trim(x["text"])), "")


def number_words(found: Column) -> Column:
    """Words that may be numbers, with `numeric`, their digits after look-alikes are mended.
    A digit, a slash and a comma is how a hand-written thousand is misread."""
    maybe = F.filter(found, lambda x: x["text"].rlike("[0-9]") | (F.length(F.regexp_replace(x["text"], r"\s+", "")) > 2))
    slashed = r"([0-9])/,([0-9]{3})"

    def mend(x: Column) -> Column:
        numeric = lambda plain: F.when(plain.rlike(slashed), F.concat(F.regexp_extract(plain, slashed, 1), F.lit("12"), F.substring(F.regexp_extract(plain, slashed, 2), 2, 2))).otherwise(S.digits(plain))
        return let(let(S.money_text(x["text"]), numeric), lambda n: x.withField("numeric", n).withField("value", n.try_cast("double")))

    return F.filter(F.transform(maybe, mend), lambda x: x["numeric"] != "")


def right_or_below(anchor: Column, x: Column) -> Column:
    tall = F.greatest(anchor["y2"] - anchor["y1"], x["y2"] - x["y1"]) * 2.2
    wide = F.greatest(anchor["x2"] - anchor["x1"], x["x2"] - x["x1"]) * 8
    dx, dy = x["cx"] - anchor["cx"], x["cy"] - anchor["cy"]
    return ((F.abs(dy) < tall) & (dx > 0)) | ((dy > 0) & (F.abs(dx) < wide))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"])


def nearest_number(anchor: Column, found: Column, fits, numbers: Column | None = None) -> Column:
    """The number right of or below the anchor that is nearest to it and fits.
    numbers: number_words(found), if they are at hand; so below."""
    good = lambda a: F.filter(number_words(found) if numbers is None else numbers, lambda x: fits(x) & right_or_below(a, x))
    return let(anchor, lambda a: F.when(a.isNotNull(), first(ordered(good(a), lambda x: distance(a, x)))))


def keyword(found: Column, words: tuple[str, ...]) -> Column:
    """The first word that contains the first of the key words that any contains."""
    holds = lambda w: first(F.filter(found, lambda x: F.contains(F.trim(x["text"]), F.lit(w))))
    return F.coalesce(*map(holds, words))


def bands(counts: DataFrame, threshold: int, shortest: int) -> DataFrame:
    """Maximal runs of y with at least threshold counts that are longer than shortest.
    counts(page_id, y, n) -> (page_id, start, stop, score)."""
    from pyspark.sql import Window

    order = Window.partitionBy("page_id").orderBy("y")
    islands = counts.where(F.col("n") >= threshold).withColumn("island", F.col("y") - F.row_number().over(order))
    runs = islands.groupBy("page_id", "island").agg(F.min("y").alias("start"), F.max("y").alias("stop"), F.sum("n").alias("score"))
    return runs.where(F.col("stop") - F.col("start") + 1 > shortest).select("page_id", "start", "stop", "score")


def nearest_rank(values: Column, share: float) -> Column:
    """The element at floor(n * share) of the sorted values."""
    return F.get(F.array_sort(values), F.floor(F.size(values) * F.lit(share)).cast("int"))
