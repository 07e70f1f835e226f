"""Dataflows that users run as a whole: evaluation, parity checks, subsets, escalation, capacity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import geometry as G
from millrace.functions import text as X
from millrace.operators import intervals as I  # noqa: E741
from millrace.operators import metrics as M
from millrace.operators import report as R
from millrace.operators.quality import set_digest


def present(levels: Column, level: int, fields: Sequence[Column]) -> Column:
    """Whether a level was attempted: as the request says, else if any of its fields is there."""
    asked = F.exists(levels, lambda v: v.cast("string").try_cast("int") == level)
    given = F.lit(False)
    for f in fields:
        given = given | f.isNotNull()
    return F.when(levels.isNotNull(), F.coalesce(asked, F.lit(False))).otherwise(given)


def evaluate(annotations: DataFrame, predictions: DataFrame, gold_windows: DataFrame, found_windows: DataFrame, gold_boxes: DataFrame, found_boxes: DataFrame, tolerance: int) -> DataFrame:
    """Scored rows of the predictions that have an annotation: l3_correct, tiou, viou, l4_correct, l5_correct, has_temporal_gt, has_spatial_gt.

    annotations: question_id, answer, category; predictions: question_id, prediction; windows: question_id, s, e; boxes:
    question_id, t, boxes (array of boxes within 0 and 1, one row of each time). Each true time takes the found time
    nearest to it within the tolerance (of equal ones the earlier), or counts 0; viou is the mean over true times.
    """
    rows = predictions.join(annotations, "question_id").withColumn("l3_correct", X.norm_exact("prediction") == X.norm_exact("answer"))
    tiou = I.temporal_iou(gold_windows, found_windows, ["question_id"]).select("question_id", "tiou")
    b = found_boxes.select("question_id", F.col("t").alias("t2"), F.col("boxes").alias("found"))
    from millrace.operators.joins import nearest

    g = gold_boxes.withColumn("_id", F.struct("question_id", "t"))
    near = nearest(g, b.withColumn("o", F.col("t2")), ["question_id"], "t", "t2", tolerance, "o", ["found"])
    frame = F.coalesce(G.union_iou(F.col("boxes"), F.col("near.found")), F.lit(0.0))
    viou = near.groupBy("question_id").agg(F.avg(frame).alias("viou"))
    out = rows.join(tiou, "question_id", "left").join(viou, "question_id", "left")
    out = out.withColumns({"has_temporal_gt": F.col("tiou").isNotNull(), "has_spatial_gt": F.col("viou").isNotNull(), "tiou": F.coalesce("tiou", F.lit(0.0)), "viou": F.coalesce("viou", F.lit(0.0))})
    return out.withColumn("l4_correct", F.col("l3_correct") & (F.col("tiou") > 0.3)).withColumn("l5_correct", F.col("l4_correct") & (F.col("viou") > 0.3))


def question_rows(predictions: DataFrame, scored: DataFrame) -> DataFrame:
    """Every prediction with its scores; without an annotation an error text in their place."""
    s = scored.select("question_id", "l3_correct", "tiou", "viou", "l4_correct", "l5_correct", F.lit(True).alias("_known"))
    out = predictions.join(s, "question_id", "left").withColumn("eval_matched_annotation", F.coalesce("_known", F.lit(False)))
    return out.withColumn("eval_error", F.when(~F.col("eval_matched_annotation"), "question_id not found in annotations")).drop("_known")


def converted(messages: DataFrame, key: str, place: str, role: str, text: str, reminder: str, checklist: str = "") -> DataFrame:
    """A run's messages as one training conversation: key, messages (place, role, text in order).

    Blank messages and the harness's own reminders go (user messages after the first that hold the text `reminder`),
    images that came as user messages join the tool response before them, neighbouring assistant messages become their
    last, the run's last answer is put beside completion calls that lack it, and a run that ends in an answer without a
    completion gets one. The order of the steps matters: each works on what the one before left.
    """
    from millrace.operators import conversation as C

    m = messages.select(key, F.col(place).cast("double").alias(place), role, text)
    first = F.min(F.when((F.col(role) == "user") & (F.trim(F.coalesce(text, F.lit(""))) != ""), F.col(place))).over(Window.partitionBy(key))
    noise = (F.col(role) == "user") & (F.col(place) > F.col("_first")) & F.contains(F.coalesce(text, F.lit("")), F.lit(reminder))
    kept = m.withColumn("_first", first).filter(~F.coalesce(noise, F.lit(False)) & ((F.trim(F.coalesce(text, F.lit(""))) != "") | F.col(role).isin("tool_call", "tool_response"))).drop("_first")
    answers = C.last_answer(messages, key, place, role, text, checklist or "\0")
    turns = C.collapse_assistants(C.folded_images(kept, key, place, role, text, "<image>"), key, place, role)
    turns = C.with_terminal(C.with_answer_inside(turns, answers, key, place, role, text), key, place, role, text)
    return C.as_arrays(turns, key, place, [role, text])


def parity(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """Four checks of two sets of prompts: keys of one side only, keys that repeat, texts that differ (paths masked), and where the first differs."""
    a, b = left.select(key, X.mask_paths(text).alias("a")), right.select(key, X.mask_paths(text).alias("b"))
    both = a.join(b, key)
    repeats = lambda df: df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n")).select(F.lit("repeated_keys").alias("check"), "n")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    parts = one(a.join(b, key, "left_anti"), "only_left").unionAll(one(b.join(a, key, "left_anti"), "only_right")).unionAll(repeats(a)).unionAll(one(both.filter(~F.col("a").eqNullSafe(F.col("b"))), "different"))
    return parts.unionAll(both.agg(F.min(X.first_difference(F.col("a"), F.col("b"))).cast("long").alias("n")).select(F.lit("first_difference").alias("check"), "n"))


def subset(items: DataFrame, key: str, ordinal: str, n: int | None, digest: str | None = None) -> DataFrame:
    """The first n items (all without n). Repeated keys, a source of another digest, or fewer than n items raise."""
    facts = items.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids"), set_digest(F.col(key)).alias("digest")).first()
    if facts["rows"] != facts["ids"]:
        raise ValueError(f"{facts['rows'] - facts['ids']} repeated ids")
    if digest and digest != facts["digest"]:
        raise ValueError(f"digest is {facts['digest']}, not {digest}")
    if n and facts["rows"] < n:
        raise ValueError(f"{facts['rows']} items, {n} wanted")
    ordered = items.orderBy(ordinal)
    return ordered.limit(n) if n else ordered


def escalated(first: DataFrame, second: DataFrame, key: str, ok: str, error: str) -> DataFrame:
    """Results after a second pass over the failures of the first: the later attempt holds."""
    failed = R.failures(first, key, ok, error)
    again = second.join(failed, key, "left_semi").withColumn("attempt", F.lit(2))
    return first.join(again.select(key), key, "left_anti").withColumn("attempt", F.lit(1)).unionByName(again)


def selected(items: DataFrame, ids: Sequence | None = None, categories: Sequence | None = None, difficulty: str | None = None, language: str | None = None, indexes: str = "", most: int | None = None) -> DataFrame:
    """A benchmark's item filters, all of them optional, before the limit by source_index. A missing index counts as -1."""
    from millrace.operators.select import member_filter

    df = member_filter(member_filter(items, "id", ids), "category", categories)
    df = df.filter(F.col("difficulty") == difficulty.capitalize()) if difficulty else df
    df = df.filter(F.col("language") == language) if language else df
    if indexes:
        df = df.filter(F.coalesce("source_index", F.lit(-1)).isin([int(x) for x in indexes.split(",") if x.strip()]))
    ordered = df.orderBy(F.coalesce("source_index", F.lit(-1)))
    return ordered.limit(most) if most else ordered


def capacity(requests: DataFrame, seconds: str, tokens: str, rank: str, queue: str) -> DataFrame:
    """requests, tokens, mean and nearest-rank 90 and 99 percent of the seconds, longest queue, and requests by rank."""
    hist = requests.groupBy(rank).agg(F.count("*").alias("n"))
    stats = requests.agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"), F.avg(seconds).alias("mean"), F.max(queue).alias("longest_queue"))
    stats = stats.join(M.order_statistics(requests, [], seconds, {"p90": M.nearest_rank(0.9), "p99": M.nearest_rank(0.99)}))  # one row each
    return stats.join(hist.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(rank).cast("string"), "n")))).alias("by_rank")))


EFFORTS = ("low", "medium", "high", "xhigh")


def effort(key: Column, retries: Column, share: float, levels: Sequence[str] = EFFORTS) -> Column:
    """Effort of a run: a share of the keys, by hash, begins at the second level; each retry is one level higher, to the highest."""
    draw = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 1000
    at = F.when(draw < int(1000 * share), 1).otherwise(0) + retries.cast("int")
    return F.get(F.array(*map(F.lit, levels)), F.least(at, F.lit(len(levels) - 1)))


def gauge_fold(samples: DataFrame, metric: str, value: str, summed: Sequence[str]) -> DataFrame:
    """One value of each gauge: the sum over its series, or the largest."""
    return samples.groupBy(metric).agg(F.when(F.first(metric).isin(*summed), F.sum(value)).otherwise(F.max(value)).alias("value"))


def majority(votes: DataFrame, key: str, vote: str, score: str) -> DataFrame:
    """The vote of most rows of a key; a tie goes by the mean score reaching one half."""
    yes, no = F.count_if(F.col(vote)), F.count_if(~F.col(vote))
    return votes.groupBy(key).agg(F.when(yes == no, F.avg(score) >= 0.5).otherwise(yes > no).alias("passed"))


def yes_share(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """Share of yes; no answer counts as none."""
    return answers.groupBy(key).agg(F.avg(F.coalesce(F.col(answer).cast("double"), F.lit(0.0))).alias("yes_share"))


def best_match(pairs: DataFrame, left: str, score: str, right: str, least: float) -> DataFrame:
    """For each left row the right row of the best score (ties to the lower), if it reaches the least; right rows may serve several."""
    won = pairs.groupBy(left).agg(F.max_by(F.struct(F.col(right).alias("right"), F.col(score).alias("score")), F.struct(F.col(score), -F.col(right))).alias("m"))
    return won.filter(F.col("m.score") >= least).select(left, "m.right", "m.score")


def canonical_values(rows: DataFrame, column: str, synonyms: DataFrame) -> DataFrame:
    """Values replaced by the canonical one of a synonym table (canonical, names: array); others stay."""
    s = synonyms.select(F.col("canonical").alias("_c"), F.explode("names").alias("_n"))
    return rows.join(s, F.lower(column) == F.lower("_n"), "left").withColumn(column, F.coalesce("_c", column)).drop("_c", "_n")


def speaker_spans(turns: DataFrame, key: str, place: str, speaker: str, text: str) -> DataFrame:
    """Neighbouring turns of one speaker as one span: key, speaker, first and last place, joined text."""
    w = Window.partitionBy(key).orderBy(place)
    new = F.coalesce((F.col(speaker) != F.lag(speaker).over(w)).cast("int"), F.lit(1))
    t = turns.withColumn("_new", new).withColumn("_span", F.sum("_new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text]), " ")
    return t.groupBy(key, "_span", speaker).agg(F.min(place).alias("first_place"), F.max(place).alias("last_place"), joined.alias("joined")).drop("_span")


def rms_windows(values: Column, size: int, hop: int) -> Column:
    """Root mean square of each whole window of an array of numbers."""
    starts = F.when(F.size(values) >= size, F.sequence(F.lit(1), F.size(values) - size + 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    return F.transform(starts, lambda i: F.sqrt(total(F.slice(values, i, size)) / size))


def quotes_found(quotes: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Quotes (key, quote) that are said, in normal form, within one span of their key, and the speaker: the first span that holds them."""
    n = quotes.withColumn("_q", X.norm_ws("quote"))
    met = n.join(spans.select(key, "speaker", "first_place", X.norm_ws("joined").alias("_t")), key).filter(F.contains("_t", "_q"))
    won = met.groupBy(key, "quote").agg(F.min_by("speaker", "first_place").alias("speaker"))
    return quotes.join(won, [key, "quote"], "left")


_LEVEL_FIELDS = {1: ("level1_answer",), 2: ("level2_answer",), 3: ("level3_answer", "answer", "prediction"), 4: ("level4_temporal", "temporal", "temporal_prediction", "level4_prediction"), 5: ("level5_spatial", "spatial", "spatial_prediction", "level5_prediction")}


def leveled(scored: DataFrame, predictions: DataFrame, requested: str = "levels") -> DataFrame:
    """Scored rows with l1_correct and l2_correct (null without an answer) and, for each of five levels, whether it was attempted: as the request lists it, else if a field of its prediction is there. predictions: question_id and any of those fields."""
    have = {k: [n for n in names if n in predictions.columns] for k, names in _LEVEL_FIELDS.items()}
    of = lambda k: [F.col(f"_p.{n}") for n in have[k]]
    fields = F.struct(*(F.col(c) for c in predictions.columns))
    rows = scored.join(predictions.select("question_id", fields.alias("_p")), "question_id")
    levels = F.col(f"_p.{requested}") if requested in predictions.columns else F.lit(None).cast("array<int>")
    right = lambda k: F.when(F.coalesce(*of(k)).isNotNull(), X.norm_exact(F.coalesce(*of(k))) == X.norm_exact("answer")) if have[k] else F.lit(None).cast("boolean")
    out = rows.withColumns({"l1_correct": right(1), "l2_correct": right(2)} | {f"l{k}_attempted": present(levels, k, of(k)) for k in _LEVEL_FIELDS})
    return out.drop("_p")


def data_filter(results: DataFrame, items: DataFrame, messages: DataFrame, reminder: str, rescue: bool = True, keep_failed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(report, training rows) of a run's results, a row at a time: what is wrong with one leaves the others as they are.

    results: id, source_index, predicted, exit_reason, error; items: id, answer_type, ground_truth; messages: source_index,
    content, the JSON list of a run's messages (role, content). Without a prediction the last answer of the run's assistant and tool messages
    holds. report: id, source_index, predicted, correct, passed, reason; a row whose messages are no list has the reason
    `row_error:bad_messages` and does not pass, one that passes and has none keeps its reason with `;no_item_dir`. Training rows:
    source_index, messages, passed; of rows that pass, or of all, that have messages.
    """
    from millrace.plans.specs import filtered

    kind = "array<struct<role:string,content:string>>"
    files = messages.select("source_index", F.from_json("content", kind).alias("_m"), (F.coalesce(F.ltrim("content").startswith("["), F.lit(False)) & F.try_parse_json("content").isNotNull()).alias("_good"))
    said = F.array_join(F.transform(F.filter("_m", lambda m: m["role"].isin("assistant", "tool")), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    r = results.join(files.withColumn("text", said).withColumn("_has", F.lit(True)), "source_index", "left")
    judged = filtered(r, items, rescue)
    broken = F.coalesce(F.col("_has") & ~F.col("_good"), F.lit(False))
    wanted = (F.col("passed") | F.lit(keep_failed)) & ~broken
    reason = F.when(broken, "row_error:bad_messages").when(wanted & F.col("_has").isNull(), F.concat(F.coalesce("reason", F.lit("")), F.lit(";no_item_dir"))).otherwise(F.col("reason"))
    judged = judged.withColumns({"reason": reason, "_take": wanted & F.col("_has").isNotNull(), "passed": F.col("passed") & ~broken})
    report = judged.select("id", "source_index", "predicted", "correct", "passed", "reason")
    turns = judged.filter("_take").select("source_index", F.posexplode("_m").alias("place", "m")).select("source_index", "place", F.col("m.role").alias("role"), F.col("m.content").alias("text"))
    rows = converted(turns, "source_index", "place", "role", "text", reminder).join(judged.filter("_take").select("source_index", "passed"), "source_index")
    return report, rows
