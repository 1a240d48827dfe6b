"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it kept, with the columns of documents;
the last one returns the packed pieces. Stages are written as Parquet and read again as the next one's docs.
Null or empty texts pass every stage, once each; an empty table stays empty. Rows are told apart by a key of their own
within a stage, and travel as one struct, so null and repeated ids are rows like others and extra columns of any name stay: of a
near-duplicate class, repeated rows among it, one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import mixing, neardup, packing, suffix, toxicity
from logloom.llm.common import durable, table, tune


def row_keyed(docs: DataFrame) -> DataFrame:
    """document (all columns), row_key; written, so that every read finds the same keys."""
    return durable(docs.select(F.struct("*").alias("document"), F.monotonically_increasing_id().alias("row_key")))


def by_row(keyed: DataFrame, *more: str) -> DataFrame:
    """The row key as doc_id, for operators that need an id of each row, and the named columns."""
    return keyed.select(F.col("row_key").alias("doc_id"), *(F.col(f"document.{c}").alias(c) for c in more))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity classifier scores at 0.5 or more."""
    tune(spark)
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda c: F.crc32(c.cast("string")) % 5 == 0)
    return toxicity.reject(docs, weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate class: the smallest id, null ids last."""
    tune(spark)
    keyed = row_keyed(docs)
    classes = durable(neardup.near_duplicates(by_row(keyed, "text"))).select(F.col("doc_id").alias("row_key"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key"))
    kept = classes.join(keyed.select("row_key", F.col("document.doc_id").alias("doc_id")), "row_key").groupBy("class_id").agg(first.alias("kept")).select("kept.row_key")
    return keyed.join(kept, "row_key", "left_semi").select("document.*")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte of a passage of 200 bytes or more that occurs elsewhere; documents stay, n_chars follows."""
    tune(spark)
    keyed = row_keyed(docs)
    spans = suffix.repeated_spans(by_row(keyed, "text"))
    rest = F.struct(*(F.col("document")[c].alias(c) for c in docs.columns if c != "text"))
    cut = suffix.without_repeats(keyed.select(F.col("row_key").alias("doc_id"), F.col("document.text").alias("text"), rest.alias("rest")), spans)
    n = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return cut.select(*(F.col("text") if c == "text" else n.alias(c) if c == "n_chars" else F.col("rest")[c].alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source meets its target; a repeat is a row of its own. Texts without a word weigh nothing and stay once."""
    keyed = row_keyed(docs)
    sized = durable(mixing.keyed(keyed.select("row_key", "document.doc_id", "document.text", "document.source"), "row_key"))
    repeats = F.when(F.col("size") == 0, 1).otherwise(F.col("repeats")).cast("int")
    taken = mixing.mix(sized, durable(mixing.targets(sized))).select("row_key", repeats.alias("repeats")).where("repeats > 0")
    return keyed.join(taken, "row_key").select("document", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("repeat")).select("document.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises and packs; returns pieces with sequence_id and offset."""
    tune(spark)
    return packing.pack(durable(packing.pieces(docs, packing.tokenizer_path())))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokens, classifiers and suffix orders are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
