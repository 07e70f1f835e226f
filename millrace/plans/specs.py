"""Benchmark specifications: how a benchmark's answers are extracted and judged. A registry of column factories."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X


@dataclass(frozen=True)
class Spec:
    """extract: prediction from text and options; judge: verdict (null if a judge is needed) from truth and prediction."""

    name: str
    prediction: str
    extract: Callable[[Column, Column], Column]
    judge: Callable[[Column, Column], Column]
    item_id: str = "question_id"
    hint: str = ""  # how an answer is to be given
    group: str | None = None  # items of one value of this column are asked in one prompt


def _exact_letter(truth: Column, found: Column) -> Column:
    return F.when(F.coalesce(truth, F.lit("")) == "", F.lit(None).cast("boolean")).otherwise(F.upper(F.trim(truth)) == found)


_LETTER = "Answer with <answer>A</answer>, one option letter."

_SPECS = {
    s.name: s
    for s in (
        Spec("open_answer", "predicted_answer", lambda t, o: X.last_real_answer(t), lambda g, p: F.lit(None).cast("boolean"), "id", "Answer with <answer>...</answer>, a short text."),
        Spec("option_text", "predicted_option", X.option_choice, _exact_letter, hint=_LETTER),
        Spec("option_letter", "predicted_option", lambda t, o: X.choice(t, "ABCD"), _exact_letter, hint=_LETTER),
        Spec("yes_no", "predicted_option", lambda t, o: X.yes_no(t), _exact_letter, hint=_LETTER),
        Spec("exact_answer", "level3_answer", lambda t, o: X.lenient_answer(t), lambda g, p: F.when(g.isNotNull(), X.norm_exact(p) == X.norm_exact(g)), hint="Answer each question with Final Answer: and a short text.", group="video"),
    )
}


def spec(name: str) -> Spec:
    if name not in _SPECS:
        raise KeyError(f"unknown benchmark {name}; known: {', '.join(sorted(_SPECS))}")
    return _SPECS[name]


def names() -> list[str]:
    return sorted(_SPECS)


def items(files: DataFrame, name: str, fields: str = "question string, options array<string>, category string, difficulty string, language string, video string") -> DataFrame:
    """A benchmark's items from its JSON files (path, content): their id as text, the given fields, and source_index, their place."""
    from millrace.sources.scan import json_items, typed

    s = spec(name)
    rows = typed(json_items(files), f"`{s.item_id}` string, {fields}")
    return rows.withColumnRenamed("place", "source_index").drop("path")


def prompts(items: DataFrame, name: str) -> DataFrame:
    """(id, prompt): a prompt of each item, with its options if it has any, or of each group with its questions numbered in order; behind it how to answer. The id is the item's, or the group's value."""
    s = spec(name)
    options = F.col("options") if "options" in items.columns else F.lit(None).cast("array<string>")
    if not s.group:
        return items.select(F.col(s.item_id).cast("string").alias("id"), F.concat_ws("\n\n", X.prompt(F.col("question"), options), F.lit(s.hint)).alias("prompt"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("source_index", "question"))), lambda q, i: F.concat(i + 1, F.lit(". "), q["question"]))  # of one video
    return items.groupBy(F.col(s.group).cast("string").alias("id")).agg(F.concat_ws("\n\n", F.array_join(listed, "\n"), F.lit(s.hint)).alias("prompt"))


def rescored(rows: DataFrame, name: str, text: str = "text", options: str = "options", truth: str = "truth") -> DataFrame:
    """Adds new_prediction and new_correct, from the saved texts, by any benchmark's rules."""
    s = spec(name)
    out = rows.withColumn("new_prediction", s.extract(F.col(text), F.col(options)))
    return out.withColumn("new_correct", s.judge(F.col(truth), F.col("new_prediction")))


def filtered(results: DataFrame, items: DataFrame, rescue: bool = True) -> DataFrame:
    """Results with their item's truths, correctness, pass decision and reasons. results: id, predicted, text, exit_reason, error; items: id, answer_type, ground_truth."""
    r = results.join(items, "id", "left").withColumn("predicted", F.coalesce(F.nullif(F.col("predicted"), F.lit("")), X.last_answer("text")))
    r = r.withColumn("verdict", X.correctness(F.col("answer_type"), F.col("predicted"), F.col("ground_truth")))
    r = r.withColumn("decision", X.passes(F.col("verdict.ok"), F.col("verdict.reason"), F.col("exit_reason"), F.col("error"), rescue))
    return r.select("*", F.col("verdict.ok").alias("correct"), F.col("decision.passed").alias("passed"), F.col("decision.why").alias("reason")).drop("verdict", "decision")
