"""Reports: weighted dimensions, grade rollups, transitions, inventories, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.geometry import credit
from millrace.operators.select import best_per_key


def weighted_score(values: DataFrame, dimensions: DataFrame, key: str) -> DataFrame:
    """score: sum of weight times credit over all dimensions (a missing value has none); passed: every value reaches its threshold. dimensions: dim, weight, threshold, higher; values: key, dim, value."""
    grid = dimensions.join(values, "dim", "left")
    ok = F.when(F.col("higher"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    gained = F.coalesce(credit(F.col("value"), F.col("threshold"), F.col("higher")), F.lit(0.0)) * F.when(F.col("value").isNotNull(), F.col("weight")).otherwise(0.0)
    total = dimensions.agg(F.count("*").alias("_dims"))  # one row
    out = grid.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(gained).alias("score"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("_all"), F.count("*").alias("_n"))
    return out.join(F.broadcast(total)).select(key, "score", (F.col("_all") & (F.col("_n") == F.col("_dims"))).alias("passed"))


def grade_rollup(grades: DataFrame) -> DataFrame:
    """total, graded, passed, failed, errors, mean_score (over rows with one)."""
    return grades.agg(F.count("*").alias("total"), F.count("passed").alias("graded"), F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("status") == "error").alias("errors"), F.avg("score").alias("mean_score"))


def transitions(rows: DataFrame, old: Column, new: Column, old_ok: Column, new_ok: Column) -> DataFrame:
    """Counters of a rescoring: total, skipped (no new value), flipped, recovered (wrong or none to right), regressed."""
    was, now = F.coalesce(old_ok, F.lit(False)), F.coalesce(new_ok, F.lit(False))
    return rows.agg(F.count("*").alias("total"), F.count_if(new.isNull()).alias("skipped"), F.count_if(new.isNotNull() & ~old.eqNullSafe(new)).alias("flipped"), F.count_if(new.isNotNull() & ~was & now).alias("recovered"), F.count_if(new.isNotNull() & was & ~now).alias("regressed"))


def filter_summary(rows: DataFrame, kind: str, passed: str) -> DataFrame:
    k = F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("?")).alias("kind")
    return rows.groupBy(k).agg(F.count("*").alias("total"), F.count_if(F.col(passed)).alias("passed"))


def inventory(candidates: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(selected, summary). Candidates: benchmark, item_id, correct, complete and what the order names. The best correct and complete one of each item is selected; summary counts rows, items and what is missing by benchmark."""
    key = ["benchmark", "item_id"]
    selected = best_per_key(candidates.filter("correct and complete"), key, order)
    per = candidates.groupBy("benchmark").agg(F.count("*").alias("candidate_rows"), F.count_distinct("item_id").alias("unique_items"), F.count_if("correct").alias("correct_candidate_rows"), F.count_if(F.col("correct").isNull()).alias("unscored_candidate_rows"))
    right = candidates.filter("correct").select(*key).distinct()
    missing = right.join(selected.select(*key), key, "left_anti").groupBy("benchmark").agg(F.count("*").alias("missing"), F.array_sort(F.collect_list("item_id")).alias("missing_ids"))
    counts = right.groupBy("benchmark").agg(F.count("*").alias("correct_unique_items")).join(selected.groupBy("benchmark").agg(F.count("*").alias("selected")), "benchmark", "left")
    out = per.join(counts, "benchmark", "left").join(missing, "benchmark", "left").fillna(0, ["correct_unique_items", "selected", "missing"])
    return selected, out.withColumn("missing_ids", F.coalesce("missing_ids", F.array().cast("array<string>")))


def failures(rows: DataFrame, key: str, ok: str, error: str) -> DataFrame:
    """Keys of rows with an error or without a match."""
    return rows.filter((F.coalesce(F.col(error), F.lit("")) != "") | ~F.coalesce(F.col(ok), F.lit(False))).select(key).distinct()


def snapshot(rows: DataFrame, elapsed: str, tools: str, error: str) -> DataFrame:
    from millrace.operators.metrics import order_statistics, upper_median

    median = lambda c: order_statistics(rows, [], c, {f"median_{c}": upper_median})
    counts = rows.agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.col(error), F.lit("")) != "").alias("n_errors"))
    return counts.join(median(elapsed).toDF("median_elapsed")).join(median(tools).toDF("median_tools"))  # one row each


def manifest(files: DataFrame, path: str, size: str, content: str) -> DataFrame:
    """By extension: files and bytes, and a digest of the contents that does not depend on their order."""
    from millrace.operators.quality import set_digest

    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).alias("ext")
    return files.groupBy(ext).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), set_digest(F.col(content)).alias("sha256"))


def error_ratio(errors: Column, most: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - errors / F.lit(most))


def level_report(rows: DataFrame, key: str | None = None) -> DataFrame:
    """Evaluator report, in percent and unrounded: accuracies of levels 3 to 5, mean overlaps over all and annotated rows."""
    pct = lambda c: F.coalesce(F.avg(c) * 100, F.lit(0.0))
    g = rows.groupBy(key) if key else rows.groupBy()
    return g.agg(F.count("*").alias("count"), *(pct(F.col(f"l{k}_correct").cast("double")).alias(f"level{k}_accuracy") for k in (3, 4, 5)), pct(F.col("tiou")).alias("mean_tiou_all"), pct(F.when(F.col("has_temporal_gt"), F.col("tiou"))).alias("mean_tiou_annotated"), pct(F.col("viou")).alias("mean_viou_all"), pct(F.when(F.col("has_spatial_gt"), F.col("viou"))).alias("mean_viou_annotated"))



def whole_report(rows: DataFrame) -> DataFrame:
    """The evaluator's overall block in one row, in percent and unrounded: accuracies of five levels (of the first two over the answered rows), mean overlaps, coverage of annotations, and attempted and correct counts."""
    pct = lambda c: F.coalesce(F.avg(c.cast("double")) * 100, F.lit(0.0))
    time, space = F.col("has_temporal_gt"), F.col("has_spatial_gt")
    overlaps = [pct(F.col("tiou")).alias("mean_tiou_all"), pct(F.when(time, F.col("tiou"))).alias("mean_tiou_annotated"), pct(F.col("viou")).alias("mean_viou_all"), pct(F.when(space, F.col("viou"))).alias("mean_viou_annotated")]
    cover = [pct(time).alias("temporal_annotation_coverage"), pct(space).alias("spatial_annotation_coverage"), pct(time & space).alias("spatio_temporal_annotation_coverage")]
    levels = [c for k in range(1, 6) for c in (pct(F.col(f"l{k}_correct")).alias(f"level{k}_accuracy"), F.count_if(f"l{k}_attempted").alias(f"level{k}_attempted_count"), F.count_if(F.col(f"l{k}_attempted") & F.coalesce(f"l{k}_correct", F.lit(False))).alias(f"level{k}_correct_count"))]
    return rows.agg(F.count("*").alias("count"), *levels, *overlaps, *cover)


def grouped_reports(rows: DataFrame, keys: Sequence[str] = ("category", "language", "evidence_span"), many: str | None = "capabilities") -> DataFrame:
    """The evaluator's groupings in one pass: dimension, group (as text), count, accuracies of levels 3 to 5 and mean overlaps; rows count in each of their several values of `many`."""
    pct = lambda c: F.avg(F.col(c).cast("double")) * 100
    tag = lambda name, c: F.struct(F.lit(name).alias("dimension"), F.coalesce(c.cast("string"), F.lit("")).alias("group"))
    tags = F.array(*(tag(k, F.col(k)) for k in keys))
    if many:
        tags = F.concat(tags, F.transform(F.coalesce(many, F.array().cast("array<string>")), lambda c: tag(many.removesuffix("ies") + "y" if many.endswith("ies") else many, c)))
    each = rows.select("l3_correct", "l4_correct", "l5_correct", "tiou", "viou", F.explode(tags).alias("_t")).select("_t.*", "l3_correct", "l4_correct", "l5_correct", "tiou", "viou")
    return each.groupBy("dimension", "group").agg(F.count("*").alias("count"), *(pct(f"l{k}_correct").alias(f"level{k}_accuracy") for k in (3, 4, 5)), pct("tiou").alias("mean_tiou_all"), pct("viou").alias("mean_viou_all"))
