"""One query for each training-data operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import fingerprints as _fp
from millrace.llm import mixing, neighbours, topk, urlfilter
from millrace.llm.shared import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {"op3_mixing": mixing.SQL, "op5_topk": topk.SQL, "op6_url_lists": urlfilter.SQL, "op7_fingerprints": _fp.SQL, "op12_neighbours": neighbours.SQL}


def query(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_minhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.repeats import repeated

    return repeated(table(spark, sf_dir, "documents"))


@query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


@query("op5_topk")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.topk import top_inner

    return top_inner(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query("op8_brown")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.brown import class_scores

    return class_scores(table(spark, sf_dir, "documents"))


@query("op1_language")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.language import identified

    return identified(table(spark, sf_dir, "documents"))


@query("op4_licenses")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.licenses import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


@query("op6_url_lists")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch days and dated lists, which the tables lack, are drawn by rule from the pages' own ids and hosts."""
    pages = table(spark, sf_dir, "pages")
    found = urlfilter.as_of(urlfilter.dated(pages), urlfilter.sample_entries(pages))
    return found.withColumn("fetched_on", F.col("fetched_at").cast("string")).drop("fetched_at")


@query("op11_importance")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.importance import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_neighbours")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_conversations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.conversations import damaged, repaired_conversations

    return repaired_conversations(damaged(table(spark, sf_dir, "conversations")))
