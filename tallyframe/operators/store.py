"""The record store as functions from tables to tables, and edits.

Edits come as a log (seq, rec_id, field, value). They are folded to the last value
of each field of a record, joined to the records and applied at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .numbering import dense_number

EDITABLE = ("invoiceNumber", "taxId", "quantity", "unitPrice", "salesAmount", "taxAmount", "totalAmount")


def append(current: DataFrame, new: DataFrame, order: str = "rec_id") -> DataFrame:
    """All records, those of new last, numbered from 1 as sequence_no."""
    both = current.withColumn("batch_", F.lit(0)).unionByName(new.withColumn("batch_", F.lit(1)), allowMissingColumns=True)
    return dense_number(both, ["batch_", order], "sequence_no").drop("batch_")


def delete(current: DataFrame, gone: DataFrame, key: str = "rec_id") -> DataFrame:
    """The records whose key isn't in gone, numbered again."""
    return dense_number(current.join(gone.select(key).distinct(), key, "left_anti"), [key], "sequence_no")


def fold_edits(log: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(rec_id, a column for each field with the last value set, n_edits)."""
    last = [F.max_by("value", F.when(F.col("field") == f, F.col("seq"))).alias(f) for f in fields]
    return log.where(F.col("field").isin(*fields)).groupBy("rec_id").agg(*last, F.count("*").alias("n_edits"))


def update(current: DataFrame, edits: DataFrame, columns: dict[str, str], key: str = "rec_id") -> DataFrame:
    """Records with the edited columns replaced; columns: edit's field -> record's column."""
    patch = edits.select(key, *[F.col(f).alias(f"new_{c}") for f, c in columns.items()])
    joined = current.join(patch, key, "left")
    keep = {c: F.coalesce(f"new_{c}", c).alias(c) for c in columns.values()}
    return joined.select(*[keep.get(c, F.col(c)) for c in current.columns])


def overlay(below: Column, above: Column) -> Column:
    """Two maps as one; above wins."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(below), lambda e: ~F.array_contains(F.map_keys(above), e["key"])), F.map_entries(above)))


def line_items(quantity: Column, unit_price: Column, names: Column) -> Column:
    """Items from two lists, names carried over by position."""
    pairs = F.arrays_zip(S.number_list(quantity).alias("q"), S.number_list(unit_price).alias("p"))
    both = lambda x: x["q"].isNotNull() & x["p"].isNotNull()
    return F.transform(
        pairs,
        lambda x, i: F.struct(
            (i + 1).cast("int").alias("line_no"), F.coalesce(F.get(names, i), F.lit("")).alias("item_name"), x["q"].alias("quantity"), x["p"].alias("unit_price"), (x["q"] * x["p"]).alias("amount"),
            F.when(both(x), "auto").otherwise("manual_required").alias("status"), F.when(both(x), 1.0).otherwise(0.0).alias("confidence"),
        ),
    )


def sales_of(quantity: Column, unit_price: Column) -> Column:
    """Sum of products of two lists of one length, else 0."""
    q, p = S.number_list(quantity), S.number_list(unit_price)
    total = F.aggregate(F.zip_with(q, p, lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when((F.size(q) > 0) & (F.size(q) == F.size(p)), total).otherwise(F.lit(0).cast("bigint"))
