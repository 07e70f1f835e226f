"""Rewards of trajectories and their shaping within groups. Steps are expressions over one row, or windows over a group."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import NETWORK, SYNTAX_FAILURE, norm_reward, split_words

# Fixed values that scores depend on.
FORMAT_BONUS, FORMAT_PENALTY, MODALITY_PENALTY, BAD_TOOL_WEIGHT = 0.2, -0.2, -0.3, 0.5
LENGTH_ALPHA, LENGTH_FLOOR, FLAT = 0.2, 0.5, 1e-8
TIMEOUT_EXITS = ("timeout", "step_limit", "context_overflow")
ALLOWED_TOOLS = ("execute_commands", "image_read", "task_complete")
GOLD_FILES = r"(?i)ground_truth|answer_key|gold_answer|\.gold|all_final\.jsonl|rl_train\.jsonl|sft_train\.jsonl"


def outcome(prediction: Column, truths: Column) -> Column:
    """1 if the normalized prediction equals a normalized truth, else 0."""
    p = norm_reward(prediction)
    return F.when(prediction.isNotNull() & (p != "") & F.exists(F.coalesce(truths, F.array().cast("array<string>")), lambda t: norm_reward(t) == p), 1.0).otherwise(0.0)


def format_value(exit_reason: Column, prediction: Column) -> Column:
    fine = F.coalesce((exit_reason == "task_complete") & (F.trim(prediction) != ""), F.lit(False))
    return F.when(fine, FORMAT_BONUS).otherwise(FORMAT_PENALTY)


def removed(exit_reason: Column, prediction: Column) -> Column:
    return prediction.isNull() & F.coalesce(exit_reason.isin(*TIMEOUT_EXITS), F.lit(False))


def modality(videos: Column, audios: Column, names: Column, video_tools: Sequence[str], audio_tools: Sequence[str], image_tools: Sequence[str]) -> Column:
    """(ok, has_video, has_audio): a video needs a video or image tool; an audio that is not among the videos needs an audio tool."""
    none = F.array().cast("array<string>")
    v, a, n = (F.coalesce(c, none) for c in (videos, audios, names))
    uses = lambda tools: F.arrays_overlap(n, F.array(*map(F.lit, tools))) if tools else F.lit(False)
    has_video, has_audio = F.size(v) > 0, F.size(F.array_except(a, v)) > 0
    ok = (~has_video | uses([*video_tools, *image_tools])) & (~has_audio | uses(audio_tools))
    return F.struct(ok.alias("ok"), has_video.alias("has_video"), has_audio.alias("has_audio"))


def subtools(text: Column, tools: Sequence[str]) -> Column:
    """Configured helpers whose name occurs in the text of a call's arguments, whatever their case."""
    return F.filter(F.array(*map(F.lit, sorted(tools))), lambda t: F.contains(F.lower(text), F.lower(t)))


#: Words of a command line: runs of plain characters, escaped ones and quoted parts between blanks.
_PLAIN, _ESCAPED, _SINGLE, _DOUBLE = r"[^ \t\r\n'\"\\]++", r"\\.", r"'[^']*+'", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SEGMENT = f"{_PLAIN}|{_ESCAPED}|{_SINGLE}|{_DOUBLE}"


def _unquoted(segment: Column) -> Column:
    inner = F.substring(segment, F.lit(2), F.length(segment) - 2)
    double = F.regexp_replace(inner, r'(?s)\\(["\\])', "$1")
    return F.when(segment.startswith("'"), inner).when(segment.startswith('"'), double).when(segment.startswith("\\"), F.substring(segment, F.lit(2), F.lit(1))).otherwise(segment)


def shell_words(c: Column) -> Column:
    """A command line's words as a POSIX shell takes them: quotes group and go, a backslash keeps the next character. With a quote or backslash left open the words are those between white space.

    A scanner of quotes by patterns that never go back: what matches from left to right is what a state machine would
    consume, and a quote or backslash is left over exactly if it ends within one.
    """
    rest = F.regexp_replace(c, f"(?s){_ESCAPED}|{_SINGLE}|{_DOUBLE}", "")
    words = F.transform(F.regexp_extract_all(c, F.lit(f"(?s)(?:{_SEGMENT})++"), F.lit(0)), lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(f"(?s){_SEGMENT}"), F.lit(0)), _unquoted), ""))
    return F.when(rest.rlike(r"""['"\\]"""), split_words(c)).otherwise(words)


def normal_path(path: Column) -> Column:
    """An absolute path without empty, `.` and `..` parts."""
    step = lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(p.isin("", "."), done).otherwise(F.array_append(done, p))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def escapes(c: Column, workspace: str) -> Column:
    """Whether a command names an answer file, or an absolute path outside the workspace, /workspace and /tmp; a lone slash is no path."""
    roots = [F.lit("/" + "/".join(x for x in r.split("/") if x)) for r in (workspace, "/workspace", "/tmp")]
    inside = lambda p: functools.reduce(lambda x, y: x | y, [(p == r) | p.startswith(F.concat(r, F.lit("/"))) for r in roots])
    paths = F.transform(F.filter(shell_words(c), lambda w: w.startswith("/") & (w != "/")), normal_path)
    return F.when(c.isNotNull(), c.rlike(GOLD_FILES) | F.exists(paths, lambda p: ~inside(p)))


def networked(c: Column) -> Column:
    return F.coalesce(c.rlike(NETWORK), F.lit(False))


def tool_summary(calls: DataFrame, replies: DataFrame, key: str, workspace: str, allowed: Sequence[str] = ALLOWED_TOOLS, name: str = "name", malformed: str = "malformed", text: str = "command", role: str = "role", reply: str = "text") -> DataFrame:
    """By trajectory: n_tool calls, faults by kind, p_bad_tool, and names of tools. A malformed call, or one without a name, counts as such only; others may count in several ways. Replies of tools that tell of a syntax failure count too, whichever call they answer. calls: key, name, malformed, text (its strings); replies: key, role, text."""
    bad = F.coalesce(F.col(malformed), F.lit(False)) | (F.coalesce(F.col(name), F.lit("")) == "")
    c = calls.groupBy(key).agg(
        F.count("*").alias("n_tool"), F.count_if(bad).alias("n_unparseable"),
        (F.count_if(~bad & ~F.col(name).isin(*allowed)) + F.count_if(~bad & networked(F.col(text)))).alias("n_disallowed"), F.count_if(~bad & escapes(F.col(text), workspace)).alias("n_escape"), F.collect_set(name).alias("_names"), F.collect_set(text).alias("_texts"))
    failed = replies.filter((F.col(role) == "tool") & F.col(reply).rlike(SYNTAX_FAILURE)).groupBy(key).agg(F.count("*").alias("n_syntax_fail"))
    out = c.join(failed, key, "full").fillna(0, ["n_tool", "n_unparseable", "n_disallowed", "n_escape", "n_syntax_fail"])
    faults = F.col("n_unparseable") + F.col("n_disallowed") + F.col("n_escape") + F.col("n_syntax_fail")
    names = F.struct(F.coalesce("_names", F.array().cast("array<string>")).alias("tools"), F.coalesce(F.array_join("_texts", " "), F.lit("")).alias("text"))
    return out.select(key, "n_tool", "n_unparseable", "n_disallowed", "n_escape", "n_syntax_fail", (faults.cast("double") / (F.col("n_tool") + 1)).alias("p_bad_tool"), names.alias("names"))


def rewarded(runs: DataFrame, summary: DataFrame, key: str, video_tools: Sequence[str], audio_tools: Sequence[str], image_tools: Sequence[str], observed: str | None = None) -> DataFrame:
    """Runs with all components of their reward. runs: key, prediction, exit_reason, truths, videos, audios, and, if named, the observed number of calls, which counts if it is higher than that of the messages. Runs without a summary made no calls."""
    counts = ["n_tool", "n_unparseable", "n_disallowed", "n_escape", "n_syntax_fail"]
    r = runs.join(summary.drop("p_bad_tool"), key, "left").fillna(0, counts)
    if observed:
        r = r.withColumn("n_tool", F.greatest("n_tool", F.coalesce(observed, F.lit(0))))
    used = F.array_union(F.coalesce("names.tools", F.array().cast("array<string>")), subtools(F.coalesce("names.text", F.lit("")), [*video_tools, *audio_tools, *image_tools]))
    mod = modality(F.col("videos"), F.col("audios"), used, video_tools, audio_tools, image_tools)
    r = r.withColumns({"raw_acc": outcome(F.col("prediction"), F.col("truths")), "_mod": mod, "format": format_value(F.col("exit_reason"), F.col("prediction")), "removed": removed(F.col("exit_reason"), F.col("prediction"))})
    fail = F.col("n_unparseable") + F.col("n_disallowed") + F.col("n_escape") + F.col("n_syntax_fail")
    s = score(F.col("raw_acc"), F.col("_mod.ok"), F.col("_mod.has_video") | F.col("_mod.has_audio"), F.col("n_tool"), fail, F.col("n_escape"), F.col("format"), F.col("removed"))
    r = r.withColumn("_s", s).withColumns({"modality_match": F.col("_mod.ok"), "has_video": F.col("_mod.has_video"), "has_audio": F.col("_mod.has_audio"), "format_error": F.col("format") < 0, "active": ~F.col("removed")})
    return r.select("*", "_s.*").drop("_s", "_mod", "names")


def score(raw: Column, modality_ok: Column, has_media: Column, n_tool: Column, n_fail: Column, n_escape: Column, fmt: Column, gone: Column) -> Column:
    """(score, correctness, modality_penalty, p_bad_tool): 1 for a correct answer with tools and modality and no escape, else the format's value; then penalties; 0 if removed."""
    right = F.when((raw > 0.5) & modality_ok & (n_tool > 0) & (n_escape == 0), 1.0).otherwise(0.0)
    miss = F.when(has_media & ~modality_ok, MODALITY_PENALTY).otherwise(0.0)
    bad = n_fail / (n_tool + 1)
    total = F.when(gone, 0.0).otherwise(F.when(right >= 1, right).otherwise(fmt) + miss - BAD_TOOL_WEIGHT * bad)
    return F.struct(total.alias("score"), right.alias("correctness"), miss.alias("modality_penalty"), bad.alias("p_bad_tool"))


def length_shaped(df: DataFrame, group: str) -> DataFrame:
    """Scores of correct rows shrink with their steps beyond the fewest of a valid correct row of the group, to half at most. Adds length_factor and has_reference."""
    steps = F.greatest(F.coalesce(F.nullif(F.col("num_steps").cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    good = ~F.col("removed") & (F.col("correctness") >= 1)
    fewest = F.min(F.when(good & F.col("modality_match") & (F.col("n_tool") > 0), steps)).over(Window.partitionBy(group))
    factor = F.when(good & F.col("_least").isNotNull(), F.greatest(F.lit(LENGTH_FLOOR), 1 - LENGTH_ALPHA * (steps - F.col("_least")) / F.col("_least"))).otherwise(1.0)
    out = df.withColumn("_least", fewest).withColumn("length_factor", factor).withColumn("has_reference", F.col("_least").isNotNull())
    return out.withColumn("score", F.col("score") * F.col("length_factor")).drop("_least")


def group_rules(reward: str = "reward", gone: str = "removed") -> list[tuple[Column, Column]]:
    """The usual reasons to drop a group, as (condition, reason) over its rows: a removed row, fewer than two rows, rewards all alike."""
    n, out = F.count_if(~F.col(gone)), F.count_if(F.col(gone))
    return [
        (out > 0, F.concat(F.lit("removed_"), out.cast("string"))),
        (n <= 1, F.concat(F.lit("active_"), n.cast("string"))),
        (F.max(reward) - F.min(reward) <= FLAT, F.concat(F.lit("zero_std_"), F.round(F.min(reward), 3).cast("string"))),
    ]


def group_filter(df: DataFrame, group: str, reward: str = "reward", gone: str = "removed", rules: Sequence[tuple[Column, Column]] | None = None) -> DataFrame:
    """keep and reason by group: the first of the rules whose condition holds drops it. Rules are aggregates, so all of them are one pass."""
    rules = group_rules(reward, gone) if rules is None else rules
    why = F.lit(None).cast("string")
    for holds, reason in reversed(rules):
        why = F.when(holds, reason).otherwise(why)
    dropped = functools.reduce(lambda a, b: a | b, (holds for holds, _ in rules), F.lit(False))
    return df.groupBy(group).agg((~dropped).alias("keep"), why.alias("reason"))


def trained_on(df: DataFrame, group: str, rules: Sequence[tuple[Column, Column]] | None = None, post: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Rows of the groups that the rules keep, after a hook (df, group) -> df: rewards centred in their group unless another is given."""
    kept = group_filter(df, group, rules=rules).filter("keep").select(group)
    return (post or centred)(df.join(kept, group, "left_semi"), group)


def centred(df: DataFrame, group: str, reward: str = "reward", gone: str = "removed", scale: bool = False) -> DataFrame:
    """advantage: reward less the mean of the group's active rows, over their deviation if asked; 0 for removed rows."""
    w = Window.partitionBy(group)
    active = F.when(~F.col(gone), F.col(reward))
    value = F.col(reward) - F.avg(active).over(w)
    if scale:
        value = value / (F.stddev_pop(active).over(w) + 1e-6)
    return df.withColumn("advantage", F.when(F.col(gone), 0.0).otherwise(value))
