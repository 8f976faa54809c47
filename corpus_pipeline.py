"""The corpus pipeline: language ID, exact, near and substring deduplication, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next one's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup, langid, near_copies, packing, substring_dedup
from tallyframe.llm._common import KeySet, Scratch, among, body, cut, held, small_batches, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language: null texts and texts without a letter. A missing
    label is filled with the prediction. Repeated rows and ties of two languages are
    judged alike, very long texts by the whole text; extra columns stay whatever their
    names; an empty table gives an empty result."""
    small_batches(spark)
    model = langid.train(docs.where(held("doc_id", 4) != 2))
    found = langid.classified(docs, model, docs.columns)
    kept = found.where(F.col("lang_pred") != langid.UNKNOWN)
    lang = F.coalesce(F.col("carried.lang"), F.col("lang_pred"))
    return kept.select(*[lang.alias(c) if c == "lang" else F.col(f"carried.`{c}`") for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays; of its repeated rows, one. A null
    text counts as empty; a null id stays only where its text has no other; very long texts
    are compared whole; extra columns stay; an empty table gives an empty result."""
    small_batches(spark)
    pair = lambda digest, ident: F.concat_ws(":", digest, F.col(ident).cast("string"))
    keep = exact_dedup.exact_owners(docs).select(pair(F.col("text_sha256"), "keep_id").alias("pair_"))
    rows = docs.select(pair(F.sha2(body("text"), 256), "doc_id").alias("pair_"), F.struct("*").alias("row_"))
    return rows.join(keep, "pair_", "left_semi").dropDuplicates(["pair_"]).select("row_.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, by five-word shingles with a similarity of 0.8 or more, the row with the
    smallest id stays, a row without an id last; rows that share an id but not the text are told
    apart, repeated rows are kept or dropped together. Texts without words have no near copies;
    very long texts are compared whole; extra columns stay; an empty table gives an empty result."""
    small_batches(spark)
    key = F.xxhash64(F.col("doc_id").cast("string"), body("text"))
    rows = docs.select(key.alias("key_"), "doc_id", "text")
    group = cut(near_copies.groups(rows, "key_"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key_")
    member = cut(group.join(rows.select("key_", "doc_id"), F.col("node") == F.col("key_")).select("label", "key_", order.alias("order_")))
    stay = cut(member.groupBy("label").agg(F.min("order_").getField("key_").alias("stay_")))
    gone = cut(member.join(stay, "label").where("key_ <> stay_").select("key_").distinct())
    # Rows whose key can't be one that goes need no join, so their texts are not shuffled.
    whole = docs.select(key.alias("key_"), F.struct("*").alias("row_")).withColumn("maybe_", among(F.col("key_"), KeySet.of(gone, "key_"), spark))
    left = whole.where("maybe_").join(gone, "key_", "left_anti")
    return whole.where("not maybe_").select("row_.*").unionByName(left.select("row_.*"))


def _rest(text: bytes, words: list[bytes], kept: list[bytes]) -> tuple[str]:
    return ((text if len(kept) == len(words) else b" ".join(kept)).decode("utf-8", "replace"),)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 or more that stand elsewhere too go; texts without any stay as they
    are, and so does a null text. Repeated rows are each other's repeats; very long texts are
    taken whole; extra columns stay whatever their names; an empty table gives an empty result."""
    small_batches(spark)
    # The text travels once, so the carried row is without it.
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row_"), F.col("text").isNull().alias("none_"), "text")
    found = substring_dedup.substring_dedup(rows, _rest, "rest_ string", ["row_", "none_"])
    text = F.when(~F.col("none_"), F.col("rest_"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"row_.`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its place in a training sequence. A null or empty text
    is its end token alone; very long texts are cut into several pieces; repeated rows are
    packed one by one; extra columns are ignored; an empty table gives an empty result."""
    import public_tokenizers

    small_batches(spark)

    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keep_words=False))


STAGES = [("language_id", language_id), ("exact_dedup", exact_stage), ("simhash_dedup", near_stage), ("substring_dedup", substring_stage), ("best_fit_packing", packing_stage)]

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir))
        return cut(STAGES[-1][1](spark, docs, sf_dir))
