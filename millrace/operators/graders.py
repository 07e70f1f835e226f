"""Graders as table functions: the rows of a case go in, a row for each dimension comes out, and weights make them a score.

A grader is a class that takes a case's rows one by one and tells the dimensions at the end; its state is what it has
to compare, such as two sets of pairs. As a table function it runs over a partitioned table, so cases are spread by Spark,
and its result joins with whatever else is known of the case. Where a case may be large, a grader also has `counted`, which
compares by Spark and leaves a few rows of each case; `graded` sends it only those.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

DIMENSIONS = "dim string, value double, ok boolean, detail string"
#: What Python's strip takes, so that both forms of a grader compare the same strings.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


class Grader(Protocol):
    def take(self, row: Row) -> None: ...

    def dimensions(self) -> Iterator[tuple[str, float | None, bool, str]]: ...


def table_function(grader: Callable[[], Grader], key: str, kind: str) -> Any:
    """(key, dim, value, ok, detail) as a table function of a table that is partitioned by the key (a column of type `kind`)."""

    class Graded:
        def __init__(self):
            self.inner, self.key = None, None

        def eval(self, row: Row):
            if self.inner is None:
                self.inner, self.key = grader(), row[key]
            self.inner.take(row)

        def terminate(self):
            if self.inner is not None:
                for d in self.inner.dimensions():
                    yield (self.key, *d)

    return F.udtf(Graded, returnType=f"`{key}` {kind}, {DIMENSIONS}")


def graded(rows: DataFrame, grader: Callable[[], Grader], key: str) -> DataFrame:
    """The dimensions of each case of `rows`."""
    f = table_function(grader, key, rows.schema[key].dataType.simpleString())
    counted = getattr(grader, "counted", None)
    return f((counted(rows, key) if counted else rows).asTable().partitionBy(key))


def weighed(dims: DataFrame, key: str, weights: Mapping[str, float], as_flag: tuple[str, ...] = ()) -> DataFrame:
    """key, score (weighted values; of dimensions in as_flag whether they are met) and whether all dimensions are met."""
    weight: Column = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("dim")]
    value = F.when(F.col("dim").isin(*as_flag), F.col("ok").cast("double")).otherwise(F.coalesce("value", F.lit(0.0)))
    return dims.groupBy(key).agg(F.sum(F.coalesce(weight, F.lit(0.0)) * value).alias("score"), F.bool_and("ok").alias("passed"))


class Reconciliation:
    """Matches of two vendors' catalogues against the true ones, with anomalies, the unmatched rest and a report.

    Rows: kind, a, b, flag, n. `truth` a true pair (flag: with an anomaly); `match` a claimed one (flag: so); `unmatched` vendor a, number b;
    `chart` width a and height b (of several the greatest, or the last as they come); `report` its words n; `axis` a judge's answer flag.
    Of counted cases: `count` the number n of what a names, `fault` the text a, `both` a number a that is matched and unmatched.
    """

    # Fixed values that scores depend on.
    RECALL, PRECISION, ANOMALIES, AXES, WORDS, WIDTH, HEIGHT = 0.75, 0.80, 0.70, 0.70, 320, 1280, 720
    WEIGHTS = {"match_recall": 0.18, "match_precision": 0.18, "price_anomaly_recall": 0.22, "chart_size": 0.07, "cross_doc_consistency": 0.20, "report_axes": 0.15}  # noqa: RUF012
    FLAGS = ("chart_size", "cross_doc_consistency")

    def __init__(self):
        self.true, self.odd, self.found, self.marked, self.rest = set(), set(), set(), set(), set()
        self.faults, self.chart, self.axes, self.counts, self.both = [], None, [], Counter(), set()

    @classmethod
    def counted(cls, rows: DataFrame, key: str) -> DataFrame:
        """For each case counts of its pairs and axes, its least five faults, the least number that is matched and unmatched, and its chart: a dozen rows at most, whatever its size."""
        raw = [F.coalesce(c, F.lit("")) for c in ("a", "b")]
        x, y = (F.btrim(c, F.lit(SPACES)) for c in raw)
        is_ = lambda kind: F.coalesce(F.col("kind") == kind, F.lit(False))
        flag, some = F.coalesce("flag", F.lit(False)), F.lit(None).cast("string")
        row = lambda kind, a=some, n=None, b=some: (F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), F.lit(None).cast("boolean").alias("flag"), (F.lit(None) if n is None else n).cast("long").alias("n"))

        whole = (x != "") & (y != "")
        pairs = rows.filter(is_("truth") | is_("match")).groupBy(F.col(key), x.alias("x"), y.alias("y"))
        pairs = pairs.agg(F.bool_or(is_("truth")).alias("true"), F.bool_or(is_("truth") & flag).alias("odd"), F.bool_or(is_("match") & whole).alias("found"), F.bool_or(is_("match") & whole & flag).alias("marked"))
        sums = {"true": F.col("true"), "odd": F.col("odd"), "found": F.col("found"), "hit": F.col("found") & F.col("true"), "odd_hit": F.col("marked") & F.col("odd")}
        counts = pairs.groupBy(key).agg(*(F.count_if(c).alias(n) for n, c in sums.items()))
        counts = counts.select(key, F.explode(F.array(*(F.struct(*row("count", F.lit(n), F.col(n))) for n in sums))).alias("r"))

        once = rows.groupBy(key).agg(F.count_if(is_("axis")).alias("axes"), F.count_if(is_("axis") & flag).alias("met"), F.max(F.when(is_("chart"), F.struct(raw[0].cast("long").alias("w"), raw[1].cast("long").alias("h")))).alias("c"))
        chart = F.struct(*row("chart", F.col("c.w").cast("string"), b=F.col("c.h").cast("string")))
        once = once.select(key, F.explode(F.filter(F.array(*(F.struct(*row("count", F.lit(n), F.col(n))) for n in ("axes", "met")), F.when(F.col("c").isNotNull(), chart)), lambda r: r.isNotNull())).alias("r"))

        vendor = F.upper(x)
        fault = F.when(is_("match") & ~(raw[0].startswith("A-") & raw[1].startswith("B-")), F.concat(F.lit("pair "), raw[0], F.lit("/"), raw[1]))
        fault = fault.when(is_("unmatched") & ~(vendor.isin("A", "B") & y.startswith(F.concat(vendor, F.lit("-")))), F.concat(F.lit("unmatched "), raw[0], F.lit("/"), raw[1]))
        fault = fault.when(is_("report") & (F.col("n") > cls.WORDS), F.concat(F.lit("report of "), F.col("n").cast("string"), F.lit(" words")))
        faults = rows.select(key, fault.alias("f")).filter("f is not null").withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("f"))).filter("k <= 5")
        faults = faults.select(key, F.struct(*row("fault", F.col("f"))).alias("r"))

        numbers = rows.filter((is_("match") & whole) | is_("unmatched")).select(key, is_("match").alias("m"), F.explode(F.when(is_("match"), F.array(x, y)).otherwise(F.array(y))).alias("v"))
        both = numbers.groupBy(key, "v").agg((F.bool_or("m") & F.bool_or(~F.col("m"))).alias("both")).filter("both").groupBy(key).agg(F.min("v").alias("v"))
        both = both.select(key, F.struct(*row("both", F.col("v"))).alias("r"))
        return counts.unionAll(once).unionAll(faults).unionAll(both).select(key, "r.*")

    def take(self, row: Row) -> None:
        a, b = row["a"] or "", row["b"] or ""
        pair = (a.strip(), b.strip())
        if row["kind"] == "count":
            self.counts[a] += row["n"]
        elif row["kind"] == "fault":
            self.faults.append(a)
        elif row["kind"] == "both":
            self.both.add(a)
        elif row["kind"] == "truth":
            self.true.add(pair)
            self.odd |= {pair} if row["flag"] else set()
        elif row["kind"] == "match":
            if not (a.startswith("A-") and b.startswith("B-")):
                self.faults.append(f"pair {a}/{b}")
            if all(pair):
                self.found.add(pair)
                self.marked |= {pair} if row["flag"] else set()
        elif row["kind"] == "unmatched":
            vendor = pair[0].upper()
            if vendor not in ("A", "B") or not pair[1].startswith(f"{vendor}-"):
                self.faults.append(f"unmatched {a}/{b}")
            self.rest.add(pair[1])
        elif row["kind"] == "chart":
            self.chart = (int(a), int(b))
        elif row["kind"] == "report" and (row["n"] or 0) > self.WORDS:
            self.faults.append(f"report of {row['n']} words")
        elif row["kind"] == "axis":
            self.axes.append(bool(row["flag"]))

    def dimensions(self) -> Iterator[tuple[str, float | None, bool, str]]:
        hit = self.found & self.true
        n = self.counts + Counter(true=len(self.true), odd=len(self.odd), found=len(self.found), hit=len(hit), odd_hit=len(self.marked & self.odd), axes=len(self.axes), met=sum(self.axes))
        share = lambda part, whole: n[part] / max(1, n[whole])
        for dim, value, least in (("match_recall", share("hit", "true"), self.RECALL), ("match_precision", share("hit", "found"), self.PRECISION), ("price_anomaly_recall", share("odd_hit", "odd"), self.ANOMALIES), ("report_axes", share("met", "axes"), self.AXES)):
            yield dim, value, value >= least, ""
        big = self.chart is not None and self.chart[0] >= self.WIDTH and self.chart[1] >= self.HEIGHT
        yield "chart_size", None, big, "" if big else f"{self.chart}"
        both = self.both | ({x for pair in self.found for x in pair} & self.rest)
        faults = sorted(self.faults)[:5]
        if both and len(faults) < 5:
            faults.append(f"matched and unmatched: {min(both)}")
        yield "cross_doc_consistency", None, not (faults or both), "; ".join(faults)
