"""Clean-up of conversations in row form: (conversation, place, role, text). Array forms come from grouping at the end."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import answers

PLACEHOLDERS = ("", "...", "X", "FINAL_ANSWER")
DONE = '{"name": "task_complete", "arguments": {}}'


def is_done(c: Column) -> Column:
    return F.coalesce(F.get_json_object(c, "$.name") == "task_complete", F.lit(False))


def last_answer(messages: DataFrame, key: str, place: str, role: str, text: str, checklist: str) -> DataFrame:
    """The last payload that is no placeholder, not from system messages nor from tool messages that hold the checklist."""
    m = messages.filter((F.col(role) != "system") & ~((F.col(role) == "tool") & F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(checklist))))
    found = m.select(key, place, F.posexplode(answers(text)).alias("_k", "answer")).filter(~F.col("answer").isin(*PLACEHOLDERS))
    return found.groupBy(key).agg(F.max_by("answer", F.struct(place, "_k")).alias("answer"))


def collapse_assistants(messages: DataFrame, key: str, place: str, role: str) -> DataFrame:
    """Of neighbouring assistant messages the last."""
    nxt = F.lead(role).over(Window.partitionBy(key).orderBy(place))
    return messages.withColumn("_next", nxt).filter((F.col(role) != "assistant") | F.coalesce(F.col("_next") != "assistant", F.lit(True))).drop("_next")


def with_terminal(messages: DataFrame, key: str, place: str, role: str, text: str) -> DataFrame:
    """Conversations whose last assistant message holds an answer, with no completion call after it, get a call and an empty response right behind it. Places become decimals, so nothing is renumbered."""
    per = messages.groupBy(key).agg(F.max(F.when(F.col(role) == "assistant", F.struct(place, text))).alias("a"), F.max(F.when((F.col(role) == "tool_call") & is_done(F.col(text)), F.col(place))).alias("done"))
    need = per.filter(F.contains(F.col(f"a.{text}"), F.lit("<answer>")) & (F.col("done").isNull() | (F.col("done") < F.col(f"a.{place}"))))
    at = F.col(f"a.{place}").cast("double")
    new = F.array(F.struct((at + 0.25).alias(place), F.lit("tool_call").alias(role), F.lit(DONE).alias(text)), F.struct((at + 0.5).alias(place), F.lit("tool_response").alias(role), F.lit("").alias(text)))
    added = need.select(key, F.explode(new).alias("x")).select(key, "x.*")
    return messages.select(key, F.col(place).cast("double").alias(place), role, text).unionByName(added)


def with_answer_inside(messages: DataFrame, answers_of: DataFrame, key: str, place: str, role: str, text: str) -> DataFrame:
    """Before each completion call, the nearest assistant message of its block of assistant messages and calls gets the answer if it has none; a block without one gets a new message."""
    w = Window.partitionBy(key).orderBy(place)
    block = F.sum((~F.col(role).isin("assistant", "tool_call")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    m = messages.join(answers_of.select(key, F.col("answer").alias("_answer")), key, "left").withColumn("_block", block)
    before = F.last(F.when(F.col(role) == "assistant", F.col(place)), True).over(Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("_host", F.when((F.col(role) == "tool_call") & is_done(F.col(text)) & F.col("_answer").isNotNull(), F.coalesce(before.cast("double"), F.lit(-1.0))))
    m = m.withColumn("_chosen", F.max(F.when(F.col("_host") >= 0, F.col("_host"))).over(Window.partitionBy(key, "_block")))
    hosts = m.filter("_host >= 0").select(key, F.col("_host").alias("_h")).distinct()
    wrapped = F.concat(F.lit("<answer>"), F.col("_answer"), F.lit("</answer>"))
    trimmed = F.rtrim(F.coalesce(F.col(text), F.lit("")))
    out = m.join(hosts.withColumnRenamed("_h", "_hh").withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col(place).cast("double") == F.col("_hh")), "left")
    put = F.col("_hh").isNotNull() & ~F.contains(F.coalesce(F.col(text), F.lit("")), F.lit("<answer>"))
    changed = out.select(key, F.col(place).cast("double").alias(place), role, F.when(put, F.concat(F.when(trimmed != "", F.concat(trimmed, F.lit("\n\n"))).otherwise(""), wrapped)).otherwise(F.col(text)).alias(text))
    made = m.filter("_host < 0").select(key, (F.col(place).cast("double") - 0.25).alias(place), F.lit("assistant").alias(role), wrapped.alias(text))
    return changed.unionByName(made)


def paired_images(messages: DataFrame, key: str, place: str, role: str, text: str, name: str = "image_read") -> DataFrame:
    """Responses of image calls: in each run of calls and the run of responses behind it, the i-th response is that of the i-th call."""
    w = Window.partitionBy(key).orderBy(place)
    new = (F.col(role) != F.lag(role).over(w)) | F.lag(role).over(w).isNull()
    m = messages.filter("true").withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    m = m.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_run").orderBy(place)))
    calls = m.filter((F.col(role) == "tool_call") & (F.get_json_object(text, "$.name") == name)).select(key, (F.col("_run") + 1).alias("_run"), "_i", F.col(place).alias("call_place"))
    return m.filter(F.col(role) == "tool_response").join(calls, [key, "_run", "_i"]).select(key, "call_place", F.col(place).alias("response_place"))


def as_arrays(messages: DataFrame, key: str, place: str, fields: Sequence[str]) -> DataFrame:
    """One row of each conversation with its messages in order."""
    return messages.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, *fields))), lambda m: F.struct(*(m[f].alias(f) for f in fields))).alias("messages"))


def loss_mask(roles: Column, lengths: Column) -> Column:
    """For messages of given token lengths, a mask that is 1 on tokens of assistant messages, from the first of them on."""
    parts = F.transform(F.arrays_zip(roles.alias("r"), lengths.alias("n")), lambda x: F.array_repeat(F.when(x["r"] == "assistant", 1).otherwise(0), x["n"].cast("int")))
    return F.flatten(parts)


def aligned(tokens: Column, mask: Column, log_probs: Column) -> Column:
    """Entries (token, mask, log_prob) of a training sequence; an error if the lengths differ."""
    same = (F.size(tokens) == F.size(mask)) & (F.size(mask) == F.size(log_probs))
    return F.when(same, F.arrays_zip(tokens.alias("token"), mask.alias("mask"), log_probs.alias("log_prob"))).otherwise(F.raise_error(F.lit("tokens, mask and log_probs differ in length")))


def recovered_calls(c: Column) -> Column:
    """Tool calls in tags of a message, as JSON texts: whole ones, and cut-off ones that closing repairs."""
    import re

    from millrace.functions.nested import close_truncated

    tag = re.compile(r"<tool_call>\s*(.*?)\s*(?:</tool_call>|$)", re.S | re.I)

    def one(text: str) -> list[str]:
        out = []
        for body in tag.findall(text):
            start = body.find("{")
            fixed = close_truncated(body[start:]) if start >= 0 else None
            if fixed is not None and isinstance(json.loads(fixed), dict):
                out.append(fixed)
        return out

    return F.pandas_udf(lambda s: s.map(one, na_action="ignore"), "array<string>")(c)


def folded_images(messages: DataFrame, key: str, place: str, role: str, text: str, mark: str) -> DataFrame:
    """A user message that only carries an image (its text begins with the mark) joins the response right before it."""
    w = Window.partitionBy(key).orderBy(place)
    nxt_role, nxt_text = F.lead(role).over(w), F.lead(text).over(w)
    m = messages.withColumn("_take", (F.col(role) == "tool_response") & (nxt_role == "user") & F.coalesce(nxt_text.startswith(mark), F.lit(False))).withColumn("_nt", nxt_text)
    m = m.withColumn("_gone", F.coalesce(F.lag("_take").over(w), F.lit(False))).filter("not _gone")
    return m.select(key, place, role, F.when(F.col("_take"), F.concat(F.col(text), F.col("_nt"))).otherwise(F.col(text)).alias(text))


def truncated_tail(messages: DataFrame, key: str, place: str, n: int, text: str, limit: int) -> DataFrame:
    """The last n messages of a conversation, their texts cut to a limit."""
    w = Window.partitionBy(key).orderBy(F.desc(place))
    return messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).withColumn(text, F.left(F.col(text), F.lit(limit))).drop("_r")


