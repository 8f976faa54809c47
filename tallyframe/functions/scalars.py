"""Scalar rules for recognised text, numbers and confidences, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest integer that a double holds exactly; larger ones count as no number.
SAFE = 2**53 - 1
# Characters that recognisers confuse with digits, as (seen, meant).
MONEY_LOOKALIKES = ("¢SsOoIl|D%", "5550011103")
REGION_LOOKALIKES = ("OoIl|Ss", "0011155")
DIGIT_CORRECTIONS = (("O", "0"), ("I", "1"), ("l", "1"))
# Sources that are known, and how they are shown.
SOURCES = ("paddleocr", "hybrid", "ollama", "easyocr", "tesseract", "macos_vision", "google_vision", "openai_vision", "formula", "manual")
SOURCE_LABELS = {"paddleocr": "PaddleOCR", "easyocr": "EasyOCR", "tesseract": "Tesseract", "macos_vision": "macOS Vision", "google_vision": "Google Vision", "openai_vision": "OpenAI Vision"}
MODES = ("local", "tesseract", "paddleocr", "google-vision", "openai-vision", "hybrid", "manual")
MODE_ALIASES = {"paddle_ocr": "paddleocr", "google_vision": "google-vision", "openai_vision": "openai-vision"}
#: Letters whose capital is several letters, some of A-Z among them.
SEVERAL = "ßŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def digits(c: Column) -> Column:
    """ASCII digits only; null is the empty text."""
    return F.regexp_replace(text(c), "[^0-9]", "")


def invoice_code(c: Column) -> Column:
    """Upper case, A-Z and 0-9 only."""
    return F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]", "")


def capitals(c: Column) -> Column:
    """Upper case letter by letter, to look for A-Z in: ß or a ligature is no two letters."""
    return F.upper(F.translate(text(c), SEVERAL, "ẞ" * len(SEVERAL)))


def matches(c: Column, pattern: str) -> Column:
    r"""Whole-text match; \z rather than $, which also stands before a last newline."""
    return F.coalesce(c.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def is_invoice(c: Column) -> Column:
    return matches(c, "[A-Z]{2}[0-9]{8}")


def is_tax_id(c: Column) -> Column:
    return matches(c, "[0-9]{8}")


def money_text(c: Column) -> Column:
    return F.translate(text(c), *MONEY_LOOKALIKES)


def safe_long(c: Column) -> Column:
    """The number of a text of digits, null if it is empty or beyond SAFE."""
    n = c.try_cast("bigint")
    return F.when(n <= SAFE, n)


def integer_or_null(c: Column) -> Column:
    """All digits as one number: "1.5" is 15, "-3" is 3."""
    return safe_long(digits(c))


def number_from(c: Column, decimals: bool = False) -> Column:
    """A positive number, commas dropped; null for anything else in the text."""
    plain = F.trim(F.replace(text(c), F.lit(","), F.lit("")))
    if decimals:
        n = F.when(matches(plain, r"[0-9]+(?:\.[0-9]+)?"), plain.try_cast("double"))
        return F.when(n > 0, n)
    n = F.when(matches(plain, "[0-9]+"), safe_long(plain))
    return F.when(n > 0, n)


def text_number(c: Column) -> Column:
    """Upper case, I, L and | as 1, then all digits as one number."""
    return digits(F.translate(F.upper(F.trim(text(c))), "IL|", "111")).try_cast("bigint")


def number_list(c: Column) -> Column:
    """Numbers separated by commas, slashes or white space; other characters are dropped."""
    parts = F.transform(F.split(text(c), r"[,\s/]+"), lambda p: F.regexp_replace(p, "[^0-9]", ""))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.try_cast("bigint"))


def list_text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def number_value(c: Column) -> Column:
    """All digits as one number, null unless positive: "39.5" is 395."""
    n = digits(c).try_cast("bigint")
    return F.when(n > 0, n)


def numeric_cell(c: Column) -> Column:
    """The first number of a table cell: commas dropped, > read as 2."""
    plain = F.translate(F.replace(text(c), F.lit(","), F.lit("")), ">＞", "22")
    n = F.regexp_extract(plain, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
    return F.when(n > 0, n)


def confidence(c: Column) -> Column:
    """Into [0, 1]; above 1 counts as per cent; what is no finite number is 0."""
    n = c.try_cast("double") if not isinstance(c, float) else F.lit(c)
    scaled = F.when(n > 1, n / 100.0).otherwise(n)
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).otherwise(F.lit(0.0))


def round_half_up(c: Column) -> Column:
    return F.floor(c.cast("double") + F.lit(0.5)).cast("bigint")


def tax_of(sales: Column) -> Column:
    """5 %, halves up."""
    return round_half_up(sales.cast("double") * F.lit(0.05))


def tax_half_even(sales: Column) -> Column:
    """5 %, halves to the even number."""
    return F.rint(sales.cast("double") * F.lit(0.05)).cast("bigint")


def tax_and_total(sales_text: Column) -> tuple[Column, Column]:
    """(tax, total) as texts, empty unless the digits of sales_text are positive."""
    sales = digits(sales_text).try_cast("bigint")
    good = F.coalesce(sales > 0, F.lit(False))
    return F.when(good, tax_of(sales).cast("string")).otherwise(""), F.when(good, (sales + tax_of(sales)).cast("string")).otherwise("")


def correct_digits(c: Column, rules=DIGIT_CORRECTIONS) -> Column:
    out = text(c)
    for seen, meant in rules:
        out = F.replace(out, F.lit(seen), F.lit(meant))
    return out


def region_clean(kind: Column, c: Column) -> Column:
    """Text of a form region, by the region's field."""
    plain = F.regexp_replace(text(c), r"\s+", "")
    return F.when(kind == "invoiceNumber", F.regexp_replace(F.upper(plain), "[^A-Z0-9]", "")).otherwise(F.regexp_replace(F.translate(plain, *REGION_LOOKALIKES), "[^0-9]", ""))


def region_score(kind: Column, cleaned: Column, conf: Column, vision: bool) -> Column:
    """Confidence plus a bonus for texts that look like the field."""
    full, part, some, number, long = (4.0, 2.0, 1.5, 3.0, 1.0) if vision else (3.0, 1.5, 1.0, 2.5, 0.5)
    n = cleaned.try_cast("double")
    within = lambda top: F.when(F.coalesce(n.between(1, top), F.lit(False)), number).otherwise(0.0)
    bonus = (
        F.when(kind == "invoiceNumber", F.when(is_invoice(cleaned), full).when(cleaned.rlike("[0-9]{8}"), part).otherwise(0.0))
        .when(kind == "taxId", F.when(is_tax_id(cleaned), full).when(F.length(cleaned) >= 6, some).otherwise(0.0))
        .when(kind == "quantity", within(999))
        .when(kind == "unitPrice", within(1_000_000) + F.when(F.length(cleaned) >= 4, long).otherwise(0.0))
        .otherwise(0.0)
    )
    return F.coalesce(conf.cast("double"), F.lit(0.0)) + bonus


def known_source(c: Column) -> Column:
    return F.when(c.isin(*SOURCES), c).otherwise("tesseract")


def source_label(c: Column) -> Column:
    out = c
    for name, label in SOURCE_LABELS.items():
        out = F.when(c == name, label).otherwise(out)
    return out


def effective_mode(c: Column, default: str = "local") -> Column:
    asked = F.lower(F.when(text(c) == "", F.lit(default)).otherwise(text(c)))
    return F.when(asked.isin(*MODES), asked).otherwise("local")


def default_mode(c: Column) -> Column:
    asked = F.lower(F.when(text(c) == "", F.lit("local")).otherwise(text(c)))
    out = F.when(asked.isin(*MODES), asked)
    for alias, mode in MODE_ALIASES.items():
        out = out.when(asked == alias, mode)
    return out.otherwise("local")


def public_url(c: Column) -> Column:
    return F.concat(F.lit("/api/files/"), F.regexp_replace(F.regexp_replace(text(c), r"\Adata/", ""), r"\A/+", ""))


def safe_name(c: Column) -> Column:
    """A file name without unusual characters, 80 characters and an extension at most."""
    name = F.when(text(c) == "", "invoice.jpg").otherwise(text(c))
    last = F.regexp_extract(F.regexp_replace(name, r"/+\z", ""), r"([^/]*)\z", 1)
    ext = F.regexp_extract(last, r"\A.+(\.[^.]*)\z", 1)
    stem = F.substr(last, F.lit(1), F.length(last) - F.length(ext))
    base = F.substring(F.regexp_replace(stem, r"[^A-Za-z0-9_一-鿿.-]+", "_"), 1, 80)
    tail = F.regexp_replace(F.lower(F.when(ext == "", ".jpg").otherwise(ext)), r"[^.A-Za-z0-9_]", "")
    return F.concat(F.when(base == "", "invoice").otherwise(base), F.when(tail == "", ".jpg").otherwise(tail))


def safe_template_id(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.when(text(c) == "", "template").otherwise(text(c)), r"[^A-Za-z0-9_.-]+", "-"), 1, 80)


def clamp_ratio(c: Column, fallback: Column) -> Column:
    n = c.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), fallback).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))
