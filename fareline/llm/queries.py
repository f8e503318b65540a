"""Queries p7_ to p9_: the problems on texts, over whole texts and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.llm.canonical import canonical_sql, canonical_texts, look_alike_classes, look_alike_pairs
from fareline.llm.leakage import leaked_passages, renamed_passages, template_classes
from fareline.llm.packing import pack, token_counts
from fareline.session import table

CAPACITY = 2048


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(token_counts(documents), CAPACITY, documents.count())


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences, tokens and the share of the room that is filled."""
    bins = p7_sequences(spark, sf_dir).where("sequence_id is not null").groupBy("sequence_id").agg(F.sum("n_tokens").alias("tokens"))
    return bins.agg(F.count(F.lit(1)).alias("sequences"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (F.sum("tokens") / (F.count(F.lit(1)) * CAPACITY)).alias("filled"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an item's passage under other numbers, names or units: a row per document and template class."""
    return renamed_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each template class."""
    return template_classes(table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(look_alike_classes(table(spark, sf_dir, "documents")))


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_texts(table(spark, sf_dir, "documents"))


QUERIES = {"p7_sequences": p7_sequences, "p7_fill": p7_fill, "p8_found": p8_found, "p8_renamed": p8_renamed, "p8_classes": p8_classes, "p9_found": p9_found, "p9_texts": p9_texts}

#: Blocks of Unicode that the SQL twins map: Latin, marks, Greek, Cyrillic, punctuation, ligatures, full width.
BLOCKS = ((0x80, 0x250), (0x300, 0x530), (0x2000, 0x2070), (0x2212, 0x2213), (0x3000, 0x3001), (0xFB00, 0xFB07), (0xFE00, 0xFE10), (0xFEFF, 0xFF5F))
_FORM = canonical_sql("text", [chr(c) for low, high in BLOCKS for c in range(low, high)])
_WINDOWS = "SELECT DISTINCT {id}, array_to_string(w[i : i + 11], ' ') AS passage FROM (SELECT {id}, w, unnest(generate_series(1, len(w) - 11)) AS i FROM (SELECT {id}, regexp_extract_all(lower({form}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}))"

SQL = {
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({_WINDOWS.format(id='doc_id', form=_FORM, table='documents')}) JOIN ({_WINDOWS.format(id='item_id', form=_FORM, table='eval_items')}) USING (passage)",
    "p9_found": f"WITH f AS (SELECT DISTINCT doc_id, text, md5({_FORM}) AS form FROM documents WHERE text IS NOT NULL) SELECT DISTINCT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2 FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p9_texts": f"SELECT doc_id, {_FORM} AS text FROM documents",
}
