"""Accuracy, agreement and error metrics. Counts and sums are partial before the shuffle; ratios come last and are not rounded."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK_ROWS = 200_000  # in a task of many sorts


def share(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    got = F.try_divide(a.cast("double"), b)
    return got if empty is None else F.coalesce(got, F.lit(empty))


def accuracy_block(verdict: str = "is_correct", prediction: str = "prediction", tool_calls: str = "tool_call_num") -> list[Column]:
    """count, correct_count, accuracy (over rows with a verdict), non_empty_ratio, avg_tool_calls."""
    n, ok, graded = F.count("*"), F.count_if(F.col(verdict)), F.count(verdict)
    filled = F.count_if(F.coalesce(F.col(prediction), F.lit("")) != "")
    return [n.alias("count"), ok.alias("correct_count"), share(ok, graded).alias("accuracy"), share(filled, n).alias("non_empty_ratio"), share(F.sum(F.coalesce(F.col(tool_calls), F.lit(0))), n).alias("avg_tool_calls")]


def accuracy_report(df: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """The block over all rows and by each key alone, in one aggregation: level (`overall` or the key), group, and the block. Null keys have no group."""
    sets = [[]] + [[F.col(k)] for k in keys]
    level = F.lit("overall")
    for k in reversed(keys):
        level = F.when(F.grouping(k) == 0, F.lit(k)).otherwise(level)
    out = df.groupingSets(sets, *(F.col(k) for k in keys)).agg(level.alias("level"), *accuracy_block(**columns))
    group = F.coalesce(*(F.col(k).cast("string") for k in keys))
    return out.withColumn("group", group).filter((F.col("level") == "overall") | F.col("group").isNotNull()).drop(*keys)


def run_audit(df: DataFrame, key: str, verdict: str, prediction: str, tokens: Sequence[str]) -> DataFrame:
    """By key: verdict counts, empty predictions, accuracy over all and over scored rows, average tokens."""
    ok, bad = F.count_if(F.col(verdict)), F.count_if(~F.col(verdict))
    mean = [share(F.sum(F.coalesce(F.col(t), F.lit(0))), F.count("*")).alias(f"avg_{t}") for t in tokens]
    return df.groupBy(key).agg(F.count("*").alias("n"), ok.alias("correct"), bad.alias("incorrect"), F.count_if(F.col(verdict).isNull()).alias("skipped"), F.count_if(F.coalesce(F.col(prediction), F.lit("")) == "").alias("empty_pred"), share(ok, F.count("*")).alias("accuracy_all"), share(ok, ok + bad).alias("accuracy_scored"), *mean)


def order_statistics(df: DataFrame, key: Sequence[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """By key (one row without), the values at the places (from 0, of the number of values) in order; nulls do not count. Values are counted first, so a task orders the distinct values of a key and holds none of them together."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key)
    counts = counts.withColumn("_to", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    at = lambda place: (F.col("_to") - F.col("_n") <= place) & (place < F.col("_to"))
    return counts.groupBy(*key).agg(*(F.max(F.when(at(place(F.col("_all"))), F.col(value))).alias(name) for name, place in places.items()))


def upper_median(n: Column) -> Column:
    """Place of the upper median: n div 2."""
    return F.floor(n / 2)


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """Place int(n * q + 0.999) - 1, at least 0."""
    return lambda n: F.greatest(F.lit(0), F.floor(n * F.lit(q) + 0.999) - 1)


def weighted_mean(value: str, weight: str) -> Column:
    """By weight; the plain mean if all weights are 0."""
    return F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.nullif(F.sum(weight), F.lit(0))), F.avg(value))


def variation(value: str) -> Column:
    """Population deviation over the mean; 100 with fewer than two rows."""
    return F.when(F.count(value) < 2, 100.0).otherwise(F.try_divide(F.stddev_pop(value), F.avg(value)))


def class_counts(df: DataFrame, truth: str, found: str, key: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn of each class. A missing prediction is a class of its own, so it costs the true one a miss."""
    per = df.groupBy(*key, truth, found).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col(truth).alias("label"), F.lit(True).alias("is_truth")), F.struct(F.col(found).alias("label"), F.lit(False).alias("is_truth")))
    rows = per.select(*key, F.explode(sides).alias("x"), (F.col(truth).eqNullSafe(F.col(found))).alias("hit"), "n").filter("x.label is not null")
    out = rows.groupBy(*key, F.col("x.label").alias("label")).agg(F.sum(F.when(F.col("hit") & F.col("x.is_truth"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("hit") & ~F.col("x.is_truth"), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~F.col("hit") & F.col("x.is_truth"), F.col("n")).otherwise(0)).alias("fn"))
    return out


def macro_f1(counts: DataFrame, zero: str = "skip", key: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over classes. A class without any count: `skip` leaves it out, `zero` counts 0, `one` counts 1."""
    empty = {"skip": F.lit(None).cast("double"), "zero": F.lit(0.0), "one": F.lit(1.0)}[zero]
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), empty)
    return counts.groupBy(*key).agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"), F.count("*").alias("classes"))


def set_f1(truth: DataFrame, found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F1 of two sets of rows; 1 if both are empty."""
    a, b = truth.select(*columns).distinct(), found.select(*columns).distinct()
    n = a.agg(F.count("*").alias("n_truth")).join(b.agg(F.count("*").alias("n_found"))).join(a.join(b, list(columns)).agg(F.count("*").alias("n_both")))
    return n.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("n_both"), F.col("n_truth") + F.col("n_found")), F.lit(1.0)))


def unordered(a: str, b: str) -> Column:
    return F.array_sort(F.array(a, b))


def _confusion(df: DataFrame, a: str, b: str, key: Sequence[str]) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*key, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def cohen_kappa(df: DataFrame, a: str, b: str, key: Sequence[str] = (), least: int = 5) -> DataFrame:
    """n, observed, expected, kappa. Fewer than `least` pairs: 0. Only one label in all: the observed agreement."""
    c = _confusion(df, a, b, key)
    total = c.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = c.groupBy(*key, F.col("a").alias("label")).agg(F.sum("n").alias("x")), c.groupBy(*key, F.col("b").alias("label")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, [*key, "label"]).groupBy(*key).agg(F.sum(F.col("x") * F.col("y")).alias("chance"))
    out = total.join(chance, list(key), "left") if key else total.join(chance)
    po, pe = share(F.col("same"), F.col("n")), share(F.coalesce("chance", F.lit(0)), F.col("n") * F.col("n"))
    kappa = F.when(F.col("n") < least, 0.0).when(pe >= 1, po).otherwise((po - pe) / (1 - pe))
    return out.select(*key, "n", po.alias("observed"), pe.alias("expected"), kappa.alias("kappa"))


def quadratic_kappa(df: DataFrame, a: str, b: str, key: Sequence[str] = ()) -> DataFrame:
    """1 less weighted disagreement over that by chance, with squared distances of integer labels; 1 if there is none by chance. All from five sums."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    s = d.groupBy(*key).agg(F.count("*").alias("n"), F.sum((x - y) * (x - y)).alias("dis"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    chance = F.col("n") * (F.col("sxx") + F.col("syy")) - 2 * F.col("sx") * F.col("sy")  # n times the sum over all pairs, over n
    return s.select(*key, "n", F.when(chance == 0, 1.0).otherwise(1 - F.col("n") * F.col("dis").cast("double") / chance).alias("kappa"))


def kendall_tau(df: DataFrame, key: Sequence[str], a: str, b: str) -> DataFrame:
    """Tau-b of each key of two rows or more; null without order on a side. Rows without either value take no part.

    Pairs are counted, not made: all pairs, less those tied, less twice those in opposite order. The latter are found at
    the highest binary digit in which the ranks of b differ: among ranks that agree above it, each row with a 0 there
    counts the rows with a 1 that come before it by a. A row takes part once for each digit, n log n in all.
    All steps go by key in one stage, so its tasks are as many as keep TASK_ROWS rows in each on average.
    """
    df = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*dict.fromkeys((*key, a, b)))
    df = df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / TASK_ROWS)), *key)
    pairs = lambda n: n * (n - 1) / 2
    rank = lambda c: F.dense_rank().over(Window.partitionBy(*key).orderBy(c))
    ranked = df.select(*key, rank(a).alias("ra"), rank(b).alias("rb"))
    cells = ranked.groupBy(*key, "ra", "rb").agg(F.count("*").alias("n"))
    tied = lambda by, name: cells.groupBy(*key, by).agg(F.sum("n").alias("n")).groupBy(*key).agg(F.sum(pairs(F.col("n"))).alias(name))
    both = cells.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("tab"), F.max("rb").alias("top"))
    digits = cells.join(both.select(*key, F.length(F.bin("top")).alias("_d")), list(key)).withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("_d") - 1)))
    bit = F.call_function("shiftright", F.col("rb"), F.col("_l")).bitwiseAND(F.lit(1))
    digits = digits.withColumns({"_above": F.call_function("shiftright", F.col("rb"), F.col("_l") + 1), "_bit": bit})
    before = F.sum(F.when(F.col("_bit") == 1, F.col("n"))).over(Window.partitionBy(*key, "_l", "_above").orderBy("ra").rangeBetween(Window.unboundedPreceding, -1))
    opposite = digits.withColumn("_o", before).filter("_bit = 0").groupBy(*key).agg(F.coalesce(F.sum(F.col("_o") * F.col("n")), F.lit(0)).alias("d"))
    s = both.join(tied("ra", "ta"), list(key)).join(tied("rb", "tb"), list(key)).join(opposite, list(key), "left").filter("n > 1")
    ua, ub = pairs(F.col("n")) - F.col("ta"), pairs(F.col("n")) - F.col("tb")
    agree = ua + ub - pairs(F.col("n")) + F.col("tab") - 2 * F.coalesce(F.col("d"), F.lit(0))
    return s.select(*key, F.try_divide(agree, F.sqrt(ua * ub)).alias("tau"))


def errors(truth: str, found: str, floor: float = 0.0) -> list[Column]:
    """mae, mape (denominator at least `floor`), rmse over rows with both values."""
    d = F.col(found) - F.col(truth)
    return [F.avg(F.abs(d)).alias("mae"), F.avg(F.try_divide(F.abs(d), F.greatest(F.lit(floor), F.abs(F.col(truth))))).alias("mape"), F.sqrt(F.avg(d * d)).alias("rmse")]


def dwell_share(df: DataFrame, key: str, state: str, length: str, claimed: str, least: float) -> DataFrame:
    """Time of a key in its claimed state over all its time, from turns of at least a length."""
    turns = df.filter(F.col(length) >= least)
    return turns.groupBy(key).agg(share(F.sum(F.when(F.col(state) == F.col(claimed), F.col(length)).otherwise(0)), F.sum(length)).alias("dwell"))


def claim_ratio(df: DataFrame, key: str, ok: str, weight: str, expected: str) -> DataFrame:
    """Passed weight over all weight; strict: every claim with an expectation passed."""
    return df.groupBy(key).agg(share(F.sum(F.when(F.col(ok), F.col(weight)).otherwise(0)), F.sum(weight)).alias("ratio"), F.coalesce(F.bool_and(F.when(F.col(expected).isNotNull(), F.col(ok))), F.lit(True)).alias("strict"))


def severity_recall(df: DataFrame, key: str, truth: str, found: str, ranks: dict[str, int]) -> DataFrame:
    """Highest severity of a key on both sides; recall of keys that truly have one of rank 1 or more."""
    of = lambda c: F.coalesce(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))[F.col(c)], F.lit(0))
    top = df.groupBy(key).agg(F.max(of(truth)).alias("t"), F.max(of(found)).alias("f"))
    return top.agg(F.count_if(F.col("t") >= 1).alias("positives"), share(F.count_if((F.col("t") >= 1) & (F.col("f") >= 1)), F.count_if(F.col("t") >= 1)).alias("recall"))


def label_share_guard(df: DataFrame, label: str, least_share: float, least_count: int) -> DataFrame:
    per = df.groupBy(label).agg(F.count("*").alias("n"))
    least, total = F.min("n"), F.sum("n")
    return per.agg(share(least, total).alias("least_share"), ((share(least, total) >= least_share) & (least >= least_count)).alias("balanced"))


def most_common(df: DataFrame, key: Sequence[str], value: str, ordinal: str) -> DataFrame:
    """Most frequent value of a key; of equal ones that which appears first."""
    per = df.groupBy(*key, value).agg(F.count("*").alias("_n"), F.min(ordinal).alias("_at"))
    return per.groupBy(*key).agg(F.max_by(value, F.struct("_n", -F.col("_at"))).alias(value))


def speaker_error_rate(truth: DataFrame, found: DataFrame, key: Sequence[str], step: int = 50, collar: int = 250) -> DataFrame:
    """Share of sampled times inside a true turn, away from its edges by the collar, at which the found speaker is another or none.

    Sides: key, s, e, label, ordinal, in milliseconds. A time has the first turn that covers it (of true ones the least label); a turn without length covers none.
    Times are not made one by one: a turn is a mask of 64 times for each bucket of them that it touches, and of each bucket
    a turn keeps the times that none before it has.
    """
    at = lambda c, shift=0: (F.col(c) + shift) / step
    first, last = F.ceil(at("s")), F.floor(at("e", -1))
    inner = F.greatest(first, F.ceil(at("s", collar))), F.least(last, F.floor(at("e", -collar)))

    def masks(turns: DataFrame, low: Column, high: Column, ordinal: Column, true: bool) -> DataFrame:
        turns = turns.select(*key, F.col("label").alias("_label"), ordinal.alias("_ordinal"), F.lit(true).alias("_is_true"), low.cast("long").alias("_low"), high.cast("long").alias("_high")).filter("_low <= _high")
        bucket = lambda c: F.floor(F.col(c) / 64)
        turns = turns.withColumn("_bucket", F.explode(F.sequence(bucket("_low"), bucket("_high"))))
        begin = F.greatest(F.col("_low") - F.col("_bucket") * 64, F.lit(0)).cast("int")
        end = F.least(F.col("_high") - F.col("_bucket") * 64, F.lit(63)).cast("int")
        ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - end + begin)
        return turns.select(*key, "_bucket", "_is_true", "_ordinal", "_label", F.call_function("shiftleft", ones, begin).alias("_mask"))

    kind = found.schema["ordinal"].dataType
    both = masks(truth, *inner, F.lit(None).cast(kind), True).unionAll(masks(found.dropna(subset=[*key, "ordinal"]), first, last, F.col("ordinal"), False))
    place = [*key, "_bucket"]
    earlier = Window.partitionBy(*place, "_is_true").orderBy("_ordinal", F.col("_label").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("_mask").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("_mask").over(earlier), F.lit(0).cast("long"))))
    side = lambda true: F.coalesce(F.bit_or(F.when(F.col("_is_true") == true, F.col("_own"))), F.lit(0).cast("long"))
    held = both.withColumn("_own", own).filter("_own <> 0").groupBy(*place, "_label").agg(side(True).alias("_t"), side(False).alias("_f"))
    named = F.coalesce(F.bit_or(F.when(F.col("_label").isNotNull(), F.col("_f"))).over(Window.partitionBy(*place)), F.lit(0).cast("long"))
    other = F.when(F.col("_label").isNull(), F.col("_named")).otherwise(F.bitwise_not("_f"))  # who has no name is as good as none
    held = held.withColumn("_named", named).filter("_t <> 0")
    sums = held.groupBy(*key).agg(F.sum(F.bit_count("_t")).alias("samples"), F.sum(F.bit_count(F.col("_t").bitwiseAND(other))).alias("_wrong"))
    return sums.select(*key, "samples", share(F.col("_wrong"), F.col("samples")).alias("error_rate"))


def contingency(df: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Pairs for a best label map: key, i, j, score, by the sum of a weight. Label places are by order of the label."""
    per = df.groupBy("key", a, b).agg(F.sum(weight).alias("score"))
    return per.withColumn("i", F.dense_rank().over(Window.partitionBy("key").orderBy(a)) - 1).withColumn("j", F.dense_rank().over(Window.partitionBy("key").orderBy(b)) - 1)


# The published 13a tokenization of machine-translation scores, in order.
_MARKS = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_SPLITS = ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "))


def score_tokens(text: str) -> list[str]:
    """Words and marks of a text as translation scores count them."""
    for old, new in _MARKS:
        text = text.replace(old, new)
    text = f" {text} "
    for pattern, new in _SPLITS:
        text = re.sub(pattern, new, text)
    return text.split()


def _ngrams(words: Sequence[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def bleu_parts(hypotheses: Iterable[str], references: Iterable[str], order: int = 4) -> list[int]:
    """Lengths, then matches and totals of each order: they add up over parts of a corpus."""
    out = [0] * (2 + 2 * order)
    for h, r in zip(hypotheses, references, strict=True):
        x, y = score_tokens(h), score_tokens(r)
        out[0] += len(x)
        out[1] += len(y)
        for n in range(1, order + 1):
            a, b = _ngrams(x, n), _ngrams(y, n)
            out[2 * n] += sum(min(c, b[g]) for g, c in a.items())
            out[2 * n + 1] += max(0, len(x) - n + 1)
    return out


def bleu(parts: Sequence[int]) -> float:
    """Corpus score between 0 and 1, with exponential smoothing of orders without a match."""
    logs, smooth = 0.0, 1.0
    orders = len(parts) // 2 - 1
    for n in range(1, orders + 1):
        hit, total = parts[2 * n], parts[2 * n + 1]
        if not total:
            return 0.0
        if not hit:
            smooth *= 2
        logs += math.log(hit / total if hit else 1 / (smooth * total))
    brevity = min(0.0, 1 - parts[1] / parts[0]) if parts[0] else -math.inf
    return math.exp(brevity + logs / orders)


def corpus_bleu(df: DataFrame, hypothesis: str, reference: str) -> DataFrame:
    """One row, bleu. Each Arrow batch gives its counts; only sums of counts meet."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([bleu_parts(b["h"].fillna(""), b["r"].fillna(""))], columns=[f"c{k}" for k in range(10)])

    parts = df.select(F.col(hypothesis).alias("h"), F.col(reference).alias("r")).mapInPandas(count, ", ".join(f"c{k} long" for k in range(10)))
    summed = parts.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(10)))
    score = F.pandas_udf(lambda *c: pd.concat(c, axis=1).apply(lambda r: bleu([int(x) for x in r]), axis=1), "double")
    return summed.select(score(*(F.col(f"c{k}") for k in range(10))).alias("bleu"))
