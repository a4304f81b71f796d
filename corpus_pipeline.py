"""The corpus pipeline: toxic documents go, near-duplicate lines are cut out, one document of each group of
near-duplicates stays, and what is left is packed into windows of ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All stages but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.llm import linededup, packing, simhash, toxicity
from bitext.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model does not predict toxic, each row judged by its own whole text: rows with a null or
    repeated doc_id as well, repeated rows each. Null and empty texts are judged by the bias alone. Without labels no
    model can be learnt and all rows stay; an empty table stays empty; other columns may have any names."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with one line of each group of near-duplicates. Texts change here, so ``n_chars`` is counted anew.

    The line of the smallest doc_id stays (null ids last), then of the smallest text hash and line number. A row that
    repeats a doc_id and its text goes; documents that lose every line go, those without any line (null, empty and
    blank texts) stay. An empty table stays empty; other columns may have any names."""
    rows = linededup.drop_lines(docs)
    if "n_chars" in rows.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id (null ids last), then with the
    smallest text hash. Texts without words are one group; a row that repeats a doc_id and its text goes. An empty table
    stays empty; other columns may have any names."""
    return simhash.keep_one(docs, shingle=3, bits=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences as in the packing query, and with their ids. Null and empty texts are documents of the end
    id alone, a null doc_id stays null, repeated rows are packed each; an empty table gives no rows."""
    import public_tokenizers

    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("SimHash near-dedup", dedup_documents), ("packing", pack)]

#: SQL expresses neither the learnt classifier nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
