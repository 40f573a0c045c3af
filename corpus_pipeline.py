"""A corpus pipeline: quality filter, near-duplicates, repeats, source mix and packing, stage after stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm import mixing, packing, quality, shingles, suffix_dedup
from gridlark.llm.common import materialize, table, text_or_empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rates 1; it learns from the labels of the documents at hand.

    Statistics travel with their rows' texts only once, and rows are judged one by one, so repeated
    and null ids keep their own verdicts. Without labels of both classes nothing is rejected.
    """
    stats = quality.document_statistics(docs)
    model = quality.train(stats, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y")))
    reject_none = not len(model.feature)
    if reject_none:
        return docs.select(*COLUMNS)
    return quality.keep_good(docs.select(*COLUMNS), model)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are similar by 0.8 or more: the one with the smallest id. Covering SimHash (as op4) and bands find them.

    Of equal texts the row with the smallest id stays (a null id only where there is no other; of equal ids the least source,
    lang and length). Null and empty texts are one component. An empty table gives no rows; other columns go.
    """
    none, names = F.col("doc_id").isNull(), COLUMNS
    keyed = docs.select(*names).withColumn("__k", F.xxhash64(text_or_empty("text")))
    classes = shingles.classes(keyed.select(F.col("__k").alias("k"), text_or_empty("text").alias("text")))
    rooted = keyed.groupBy(F.col("__k").alias("k")).agg(F.min("doc_id").alias("id")).join(classes, "k", "left")
    stay = rooted.groupBy(F.coalesce("root", "k").alias("root")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("s"))
    # copies are merged map-side, so that no task gets all rows of a common text
    merged = keyed.groupBy("__k").agg(F.min_by(F.struct(*names), F.struct(none, "doc_id", "source", "lang", "n_chars")).alias("r"))
    return merged.join(stay.select(F.col("s.k").alias("__k")), "__k", "left_semi").select("r.*")


def repeat_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words, or of 400 bytes, that stand elsewhere too; all documents stay.

    A null text stays null; equal rows lose what they share, which is everything of 400 bytes or 51 words; columns besides those of documents go.
    """
    return _columns(suffix_dedup.remove_passages(docs.select(*COLUMNS)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them: one row for each epoch with words of theirs.

    Documents without words, and so null texts, are taken zero times; ties in the order go by id, then text; an empty table gives no rows.
    """
    return _columns(mixing.take(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: one row a piece; a null or empty text is its separator alone, an empty table gives no rows, columns besides the id and text go."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicate_filter),
    ("repeats", repeat_filter),
    ("mix", source_mix),
    ("pack", pack),
]

#: A trained classifier, a tokenizer and a suffix index have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
