"""A cleaning pipeline over ``documents``: each stage reads what the one before it has written.

``STAGES`` keeps the columns of ``documents`` up to the last one, which returns the packing.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecask.llm import language, lines, minhash, packing, suffixes
from tilecask.llm.frames import temporaries
from tilecask.llm.queries import TOKENIZER
from tilecask.sources.scratch import delete_folder, new_folder

#: A document goes if no language is at least this probable.
LEAST_SCORE = 0.3
#: Documents estimated to resemble each other this far, a standard deviation below what the third stage asks for, go whole from the second to it.
VERSIONS = 0.76


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without a letter or a likely language go."""
    found = language.predict(docs, language.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; documents with nothing left go.

    Near copies of one document keep what they share with each other: cut to the lines that differ, none
    would be known for a copy by the next stage, which is there to keep one of them.
    """
    cut = lines.without_shared_lines(docs, versions=VERSIONS)
    gone = (F.col("n_lines_removed") > 0) & (F.length(F.trim("text")) == 0)
    return _counted(cut.where(~gone).select(*docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the first by id: shingles of five words, similarity 0.8.

    Rows count by id and text, so those of one id may go and stay apart, and of repeated rows one stays.
    Rows without an id come after the others; those that resemble none stay, as does every row without a word.
    """
    number = F.col("doc_id")
    text = F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), 1, 16)
    key = F.struct(number.isNull().alias("unnumbered"), F.coalesce(number, F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("number"), text.alias("text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0d]"), F.lit(False))
    rows = docs.where(worded).select(key.alias("row"), "text", F.struct(*docs.columns).alias("own"))
    kept = minhash.near_duplicates(rows.select("row", "text"), width=5, percent=80, id_col="row").where("kept").select(F.col("row").alias("first")).distinct()
    # grouped by the side that the join deals out uncast: the texts go through one exchange
    first = rows.join(kept, F.col("row") == F.col("first")).groupBy("first").agg(F.min("own").alias("own"))
    return first.select("own.*").union(docs.where(~worded))


def own_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that start elsewhere too; documents with nothing left go."""
    cut = suffixes.without_repeats(docs, length=200)
    return _counted(cut.where(F.col("text").isNull() | (F.length("text") > 0) | (F.col("n_chars") == 0)).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(TOKENIZER), capacity=2048, end_id=0)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("lines", own_lines),
    ("minhash", one_of_each),
    ("suffixes", own_passages),
    ("packing", packed),
]
#: Hash families and a trained model have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage has stored on the way goes when it ends, and its result when the next one has been written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        where = new_folder(spark, f"corpus-{name}")
        with temporaries(spark):
            stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
        if before:
            delete_folder(spark, before)
        before = where
    return docs
