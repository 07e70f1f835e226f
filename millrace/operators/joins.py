"""Keyed, tolerant, as-of and interval joins, each as equality on a key or bucket with the rest as a condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.intervals import overlap_pairs
from millrace.operators.stepwise import Steps

CROWD = 8  # places in a cell that a search for the nearest begins with


def left_fallback(rows: DataFrame, build: DataFrame, key: Sequence[str], wanted: str, fallbacks: Sequence[str]) -> DataFrame:
    """The build side's value, or the first of the row's own fields that is not empty. Build rows with a null in the key go."""
    for k in key:
        build = build.filter(F.col(k).isNotNull())
    found = build.groupBy(*key).agg(F.max(wanted).alias("_found"))
    out = rows.join(found, list(key), "left")
    return out.withColumn(wanted, F.coalesce(F.col("_found"), *(F.nullif(F.col(f).cast("string"), F.lit("")) for f in fallbacks))).drop("_found")


def with_verdict(rows: DataFrame, verdicts: DataFrame, key: Sequence[str], own: str, given: str) -> DataFrame:
    """A row's own verdict, else that given for its key."""
    one = verdicts.groupBy(*key).agg(F.bool_or(given).alias("_given"))
    return rows.join(one, list(key), "left").withColumn(own, F.coalesce(F.col(own), F.col("_given"))).drop("_given")


def matched(predictions: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Every prediction with whether its key has an annotation."""
    known = annotations.select(F.col(key).cast("string").alias("_k")).distinct()
    return predictions.join(known, F.col(key).cast("string") == F.col("_k"), "left").withColumn("matched", F.col("_k").isNotNull()).drop("_k")


def done(items: DataFrame, results: DataFrame, key: str, least_attempt: int) -> DataFrame:
    ok = results.filter(F.col("error").isNull() & (F.col("attempt") >= least_attempt))
    return items.join(ok, key, "left_semi")


def pending(items: DataFrame, results: DataFrame, key: str, least_attempt: int) -> DataFrame:
    ok = results.filter(F.col("error").isNull() & (F.col("attempt") >= least_attempt))
    return items.join(ok, key, "left_anti")


def set_changes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, and which."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def with_penalty(truth: DataFrame, found: DataFrame, key: Sequence[str], value: str, penalty: float) -> DataFrame:
    return truth.join(found, list(key), "left").withColumn(value, F.coalesce(F.col(value), F.lit(penalty)))


def nearest(left: DataFrame, right: DataFrame, key: Sequence[str], t: str, t2: str, tolerance: int, ordinal: str, take: Sequence[str]) -> DataFrame:
    """Each left row with the right row of its key nearest in time, within the tolerance; of equal ones the first by ordinal.

    Left rows look into their bucket of the tolerance's width and its two neighbours, so that both sides meet by equality.
    left needs a unique column `_id`.
    """
    a = left.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(t) / tolerance) + d)))
    b = right.select(*key, F.col(t2).alias("_t2"), F.col(ordinal).alias("_o"), *(F.col(c).alias(f"_r_{c}") for c in take)).withColumn("_bucket", F.floor(F.col("_t2") / tolerance))
    near = a.join(b, [*key, "_bucket"]).withColumn("_delta", F.abs(F.col(t) - F.col("_t2"))).filter(F.col("_delta") <= tolerance)
    won = near.groupBy("_id").agg(F.min_by(F.struct(F.col("_delta").alias("delta"), *(F.col(f"_r_{c}").alias(c) for c in take)), F.struct("_delta", "_o")).alias("near"))
    return left.join(won, "_id", "left")


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], t: str, t2: str, value: str, tolerance: int | None = None) -> DataFrame:
    """The right value last known at each left time: one union and one window, no range join."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_at", F.lit(None).cast(right.schema[t2].dataType))
    other = right.select(*key, F.col(t2).alias(t), F.col(value).alias("_v"), F.col(t2).alias("_at")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*key).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_v").alias("v"), F.col("_at").alias("at"))), True).over(w)
    out = both.unionByName(other, allowMissingColumns=True).withColumn("_last", last).filter("_side = 1")
    keep = F.lit(True) if tolerance is None else F.col(t) - F.col("_last.at") <= tolerance
    return out.withColumn(value, F.when(keep, F.col("_last.v"))).drop("_side", "_v", "_at", "_last")


def containing(points: DataFrame, spans: DataFrame, key: Sequence[str], t: str, ordinal: str, take: str, width: int) -> DataFrame:
    """Each point (unique `_id`) with the first span of its key that holds it."""
    p = points.withColumn("s", F.col(t)).withColumn("e", F.col(t) + 1)
    met = overlap_pairs(p, spans, key, width)
    won = met.groupBy("_id").agg(F.min_by(take, F.col(ordinal)).alias(take))
    return points.join(won, "_id", "left")


def overlap_vote(left: DataFrame, right: DataFrame, key: Sequence[str], label: str, width: int) -> DataFrame:
    """Each left interval (unique `_id`) with the label that overlaps it longest in sum; ties to the label that sorts first."""
    met = overlap_pairs(left, right, key, width).withColumn("_len", F.least("e", "e2") - F.greatest("s", "s2"))
    per = met.groupBy("_id", label).agg(F.sum("_len").alias("_len"))
    won = per.groupBy("_id").agg(F.min_by(F.struct(F.col(label).alias(label), F.col("_len").alias("overlap")), F.struct(-F.col("_len"), F.col(label))).alias("vote"))
    return left.join(won, "_id", "left")


def not_overlapping(left: DataFrame, right: DataFrame, key: Sequence[str], width: int) -> DataFrame:
    """Left intervals (unique `_id`) that no right interval of the key overlaps."""
    return left.join(overlap_pairs(left, right, key, width).select("_id"), "_id", "left_anti")


def zipped(a: DataFrame, b: DataFrame, key: Sequence[str], order_a: str, order_b: str) -> DataFrame:
    """The i-th row of each side, for keys with as many rows on both sides."""
    x = a.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(order_a))).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    y = b.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(order_b))).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    return x.join(y, [*key, "_i", "_n"]).drop("_n")


def grid_agreement(a: DataFrame, b: DataFrame, key: Sequence[str], grid: DataFrame, width: int) -> DataFrame:
    """Share of grid times (columns key, t) at which the first active state of both sides is the same; times without a state on either side do not count.

    Sides: key, s, e, state, ordinal.
    """
    at = grid.withColumn("_id", F.struct(*key, "t"))
    side = lambda df, name: containing(at, df.select(*key, F.col("s").alias("s2"), F.col("e").alias("e2"), "ordinal", F.col("state").alias(name)), key, "t", "ordinal", name, width).drop("_id")
    both = side(a, "left_state").join(side(b, "right_state"), [*key, "t"]).filter("left_state is not null or right_state is not null")
    return both.groupBy(*key).agg(F.count("*").alias("steps"), F.count_if(F.col("left_state") == F.col("right_state")).alias("same"))


def radius_nearest(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Each row of a (_id, x, y) with the nearest row of b (name, x2, y2) within the radius, not one to one; ties by name.

    Equal places are one. Cells meet by equality with their neighbours, from those that hold CROWD places of b on average:
    what is found nearer than a cell's width is the nearest of all, and other places go on to wider cells, up to the radius.
    """
    steps = Steps(a.sparkSession, "nearest")
    q = steps.put(b.dropna(subset=["x2", "y2"]).groupBy("x2", "y2").agg(F.min("name").alias("name")), "places")
    rest = steps.put(a.select("x", "y").dropna().distinct(), "points")
    cell = lambda c, w: F.floor(F.col(c) / w)
    widths = [radius / 4**k for k in range(8)]
    n, *cells = q.agg(F.count("*"), *(F.approx_count_distinct(F.struct(cell("x2", w), cell("y2", w))) for w in widths)).first()
    finest = next((k for k, c in enumerate(cells) if n <= CROWD * c), len(widths) - 1)
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    far = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    out = None
    for k in range(finest, -1, -1):
        w = widths[k]
        p = rest.withColumn("_d", F.explode(near)).select("x", "y", (cell("x", w) + F.col("_d.i")).alias("_cx"), (cell("y", w) + F.col("_d.j")).alias("_cy"))
        met = p.join(q.select("*", cell("x2", w).alias("_cx"), cell("y2", w).alias("_cy")), ["_cx", "_cy"])
        met = met.withColumn("_far", far).filter(F.col("_far") <= w * w * (1 - 1e-9 if k else 1))  # a place at the very edge goes on
        won = met.groupBy("x", "y").agg(F.min(F.struct("_far", "name")).alias("m")).select("x", "y", "m.name", F.col("m._far").alias("squared"))
        won = steps.put(won, f"won-{k}")
        out = won if out is None else out.unionAll(won)
        if k:
            rest = steps.put(rest.join(won, ["x", "y"], "left_anti"), f"points-{k}")
    return a.join(out, ["x", "y"], "left").select(*a.columns, "name", "squared")


def close_to_boundary(rows: DataFrame, edges: DataFrame, key: Sequence[str], t: str, edge: str, tolerance: int) -> DataFrame:
    """Rows with an edge of their key within the tolerance."""
    a = rows.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(t) / tolerance) + d)))
    b = edges.select(*key, F.col(edge).alias("_edge")).withColumn("_bucket", F.floor(F.col("_edge") / tolerance))
    same = [a[k] == b[k] for k in key] + [a["_bucket"] == b["_bucket"], F.abs(a[t] - b["_edge"]) <= tolerance]
    on: Column = same[0]
    for c in same[1:]:
        on = on & c
    return a.join(b, on, "left_semi").drop("_bucket").distinct()


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key no parent has; rows without a key are none."""
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def dominant_label(matches: DataFrame, labels: DataFrame, left: str, right: str, label: str, place: str) -> DataFrame:
    """Of each matched left row, the label that its right row has most often; of equal ones the one seen first. matches: left, right; labels: right, label, place. A right row without labels gives null."""
    counts = labels.groupBy(right, label).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    top = counts.groupBy(right).agg(F.max_by(label, F.struct("_n", -F.col("_first"))).alias(label))
    return matches.join(top, right, "left").select(left, right, label)


def labelled_pairs(predictions: DataFrame, truths: DataFrame, key: str, predicted: str, label: str, missing: str = "MISSING") -> DataFrame:
    """Counts of (predicted, true) labels over all predictions; one without a truth counts as of the class `missing`."""
    both = predictions.select(key, F.col(predicted).alias("predicted")).join(truths.select(key, F.col(label).alias("true")), key, "left")
    return both.groupBy("predicted", F.coalesce("true", F.lit(missing)).alias("true")).agg(F.count("*").alias("n"))


def required_match(rows: DataFrame, matched_column: str = "matched") -> DataFrame:
    """The counts of a join (loaded, matched, unmatched) in one row; an error if nothing matched."""
    counts = rows.agg(F.count("*").alias("loaded"), F.count_if(matched_column).alias("matched"))
    checked = F.when(F.col("matched") > 0, F.col("matched")).otherwise(F.raise_error(F.lit("no key matched")).cast("long"))
    return counts.select("loaded", checked.alias("matched"), (F.col("loaded") - F.col("matched")).alias("unmatched"))
