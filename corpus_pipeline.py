"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again. A stage's table has the
columns of documents; the last one adds the tokens.

Cases: a null text, or one without a letter, goes in the language stage; a later stage given one keeps it (lines,
near_copies as a document without words, mixing not, as it has size 0, tokens with no ids); null ids, languages and
sources are values like others; columns besides those of documents are dropped; repeated rows are one document to
near_copies; texts of any length are taken whole; without labelled languages the language stage keeps all rows with a
letter, without a table of labels mixing draws by the texts alone; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.llm import common, op2_language, op4_bpe, op6_simhash, op9_lines, op10_mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; documents that it rejects go. It learns from what is labelled and not held out."""
    raw = op2_language.learn(docs)
    return op2_language.keep(docs.select(*COLUMNS), "text", raw)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, those of one line if it is long or a document's only one; n_chars follows the text."""
    clean = op9_lines.remove_repeated_lines(docs.select(*COLUMNS), "doc_id", "text", single=True)
    return clean.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, of equal ids one row."""
    return op6_simhash.keep_first(docs.select(*COLUMNS), "doc_id", "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it; labels of quality weigh the draw where there are any."""
    labels = common.table(spark, sf_dir, "labels") if common.has_table(spark, sf_dir, "labels") else None
    return op10_mixing.repeat(docs.select(*COLUMNS), labels)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens, their ids (little-endian unsigned 32-bit) and the digests of ids and decoded bytes."""
    return op4_bpe.tokenised(docs.select(*COLUMNS))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixing", mixing), ("tokens", tokens)]

#: Compression, SimHash and BPE aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes as soon as the next one is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.remove_path(spark, before)
        before = path
    return docs
