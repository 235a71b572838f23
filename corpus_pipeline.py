"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's
``docs``; all but the last return the columns of ``documents``, other columns go.  A stage judges what its predecessor
kept.  Every stage takes null and empty texts (without words, secrets or scores against them, so they stay), null ids
(rows of their own) and repeated rows, and an empty table gives an empty one.  What ``run`` writes to the shared folder
stays for its result; ``scratch.clear`` deletes it once that has been written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.minhash import near_duplicate_rows, numbered
from palimpsest.llm.packing import pack
from palimpsest.llm.queries import TOKENIZER
from palimpsest.llm.scratch import cut
from palimpsest.llm.secrets import find_secrets, redact
from palimpsest.llm.substrings import remove_repeats
from palimpsest.llm.toxicity import fit_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with another text and its number of characters."""
    docs = docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to the labels of this folder, scores below one half; all of them where
    the labels give no model."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs.select(*COLUMNS)).filter("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of least id, also where rows are the same, share an id or have none."""
    rows = numbered(docs.select(*COLUMNS))
    gone = near_duplicate_rows(rows, k=5, percent=80).filter("not kept").select("row")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that begin anywhere else too; a text that loses all goes, others keep
    their own white space unless they lose something."""
    out = remove_repeats(docs.select(*COLUMNS), window=50)
    out = out.filter("n_removed = 0 or n_removed < n_words")
    return _with_text(out, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in them replaced by a mark."""
    return _with_text(find_secrets(docs.select(*COLUMNS)), redact(F.col("text"), F.col("secrets")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER), length=2048, end=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: No stage can be said in SQL on whole tables; tests hold them against brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
