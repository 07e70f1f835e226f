"""Choosing rows by order within a key. Every order is total: callers name a tie-break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order. The rank filter is pushed below the shuffle as a group limit."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, key: Sequence[str], attempt: str, ordinal: str) -> DataFrame:
    """The highest attempt of each key; of equal ones the later row."""
    return best_per_key(df, key, [F.desc(attempt), F.desc(ordinal)])


def with_prior(df: DataFrame, key: Sequence[str], order: Sequence[str], fields: Sequence[str], name: str = "prior") -> DataFrame:
    """Each row with the named fields of the rows of its key before it."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.collect_list(F.struct(*fields)).over(w))


def merge_shards(df: DataFrame, key: Sequence[str], path: str, ordinal: str) -> DataFrame:
    """Rows of several shards: the last by path, then by place, holds for its key."""
    fields = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*fields), F.struct(path, ordinal)).alias("_row")).select(*key, "_row.*")


def top_k(df: DataFrame, k: int, score: str, name: str) -> DataFrame:
    """Highest scores, ties by name."""
    return df.orderBy(F.desc(score), F.asc(name)).limit(k)


def first_n(df: DataFrame, n: int, ordinal: str) -> DataFrame:
    return df.orderBy(ordinal).limit(n)


def filter_then_limit(df: DataFrame, predicate: Column, n: int, ordinal: str) -> DataFrame:
    """The limit counts only rows that pass the predicate."""
    return df.filter(predicate).orderBy(ordinal).limit(n)


def numeric_first(c: Column) -> list[Column]:
    """Order of keys: numbers by value, then the others by text."""
    number = c.try_cast("bigint")
    return [number.isNull(), number, c]


def numbered(df: DataFrame, order: Sequence[Column], coarse: Sequence[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in the order. `coarse` are columns that do not fall as the order rises: rows are numbered within groups of equal ones, after the number of rows in all groups before, so no task gets the whole table."""
    keys = {f"_c{k}": c for k, c in enumerate(coarse)}
    rows = df.withColumns(keys)
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each group
    before = groups.select(F.struct(*keys).alias("_g"), before.alias("_before"))
    out = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("_g", F.struct(*keys))
    return out.join(before, "_g").withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop(*keys, "_i", "_g", "_before")


def tail(values: Column, n: int) -> Column:
    """The last n entries of an array."""
    return F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)


def member_filter(df: DataFrame, column: str, wanted: Sequence | None) -> DataFrame:
    """Rows whose value, as text, is wanted; nothing wanted means all."""
    return df.filter(F.col(column).cast("string").isin([str(x) for x in wanted])) if wanted else df


def collapse_runs(df: DataFrame, key: Sequence[str], order: str, role: str) -> DataFrame:
    """Of neighbouring rows with one role, the last."""
    nxt = F.lead(role).over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("_next", nxt).filter(F.col("_next").isNull() | (F.col("_next") != F.col(role))).drop("_next")


def first_appearance(df: DataFrame, value: str, ordinal: str) -> DataFrame:
    """Distinct values in the order in which they first appear."""
    return df.groupBy(value).agg(F.min(ordinal).alias("first_at"))


def first_calls(calls: DataFrame, ids: Sequence[str], ordinal: str) -> DataFrame:
    """Of calls that repeat an id, the first; the stream form keeps ids for as long as its watermark."""
    return calls.groupBy(*ids).agg(F.min(ordinal).alias(ordinal))


def weighted_rotation(df: DataFrame, name: str, weight: str) -> DataFrame:
    """(slot, name): names in turns by weight. Each name's i-th turn is due at (i - 1/2) / weight; ties by name. Names are those of a rotation (endpoints, benchmarks), so one window orders them."""
    turns = df.filter(F.col(weight) >= 1).select(name, weight, F.explode(F.sequence(F.lit(1), F.col(weight).cast("int"))).alias("_i"))
    due = (2 * F.col("_i") - 1).cast("double") / (2 * F.col(weight))
    return turns.withColumn("slot", F.row_number().over(Window.orderBy(due, name))).select("slot", name)


def archived(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows with their attempt (from 1), the number of attempts of their key, and whether a later one supersedes them: the latest and the archive in one table, as long as the input."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = df.withColumns({"attempt": F.row_number().over(w), "attempts": F.count("*").over(Window.partitionBy(*key))})
    return out.withColumn("superseded", F.col("attempt") < F.col("attempts"))
