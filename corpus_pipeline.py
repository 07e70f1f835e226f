"""Corpus preparation in five stages, each of which works on all that the stage before it kept.

The columns are those of documents up to the last stage; a document that a stage shortens has its n_chars counted anew,
and one that mixing repeats is there once for each copy. The last stage gives the pieces of training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.language import identified
from millrace.llm.minhash import one_of_each
from millrace.llm.mixing import mixed
from millrace.llm.packing import packed
from millrace.llm.queries import tokenizer_path
from millrace.llm.repeats import repeated
from millrace.llm.shared import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; those without a letter (null and empty texts too), and those far
    from all languages, go. Rows are judged each on its own, so repeated rows and null ids need no rule; without labels
    nothing is known and all go."""
    return identified(docs, carry=("text", "lang", "source", "n_chars")).filter("not rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts, whatever the ids: that of least id (null last), then of least hash
    of its text. Rows without a word are in no group and stay; of equal rows one stays. No rows give no rows."""
    return one_of_each(docs.select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages: all copies go, the first included, so a row that occurs twice is left without
    the text that both hold, and stays as an empty document. A null text becomes an empty one."""
    out = repeated(docs, with_text=True, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, up to three. Empty documents take no words of the mix but are
    drawn like others; a null source is one of its own; rows with equal or null ids are drawn each on its own."""
    out = mixed(docs, carry=("text", "lang", "source", "n_chars"))
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, of every row; a null or empty text is one piece that holds the end."""
    return packed(docs, tokenizer_path())


STAGES = [("language", language), ("near_dedup", near_dedup), ("repeats", repeats), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None  # character models, induced sorting and byte-pair encoding have no SQL; tests/llm holds a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        since = len(Scratch.made)
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        Scratch.release(since)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
