"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources in code-point order (null last) have weights 5, 2, 1, repeating. They share the words of all; no target is above
`cap` times its source's words, and what is above is shared again by weight (solved at once: sources sorted by the level
at which they fill up, and two running sums). A document's expected copies are target / words of its source. Their
prefix sums within the source, plus one offset of the source, cross some integers: one copy for each.

Documents are ordered by size stratum, then by a salt, size and id, so that copies spread evenly over sizes and the words
taken come near the target. The prefix sum is a count of cells (source, stratum, salt), summed per source, plus a running
number within the cell: a cell has at most some 65,536 rows of a stratum's, whatever the source's share of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import WORD, Scratch

WEIGHTS, CAP, CELL, LEAST_SALTS = (5, 2, 1), 3, 65_536, 16
_RATIO = "{cap}.0D * source_size / weight"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """skey, source_size, target of each source; `sizes` has one row of a source: skey, source, source_size."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("weight", weight).withColumn("full", F.expr(_RATIO.format(cap=cap)))
    up = Window.orderBy("full", "skey")
    s = s.withColumn("k", F.row_number().over(up)).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - before).cast("double") / rest)
    least = F.min(F.when(F.col("level") <= F.col("full"), F.struct("k", "level"))).over(Window.partitionBy())["level"]
    return s.withColumn("rise", least).select("skey", "source_size", F.least(F.lit(float(cap)) * F.col("source_size"), F.col("rise") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix", carry: tuple[str, ...] = (), tables: Scratch | None = None) -> DataFrame:
    """doc_id, size (words), source_size, target, copies, taken (copies * size), and the columns named in carry.

    Null and empty texts have size 0 and take 0 words. A null source is a source of its own, after all others. Rows with
    equal ids are sampled each on their own, in the order of a hash of the text; a null id is last and has the salt of its
    text. Same rows give the same result. Columns that are not named are not read, so their names do not matter. An empty
    table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    text, unnamed = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").isNull()
    drawn = F.when(unnamed, F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), drawn.alias("drawn"), F.xxhash64(text).alias("tie"), *([F.struct(*carry).alias("carried")] if carry else []))
    if not carry:  # the texts are read once
        base = (tables or Scratch(docs.sparkSession, "mix")).put(base, "sizes")
    salts = max(LEAST_SALTS, -(-docs.count() // CELL))
    bits = F.length(F.bin("size"))
    mixer = F.pmod(F.coalesce("doc_id", "drawn"), F.lit(1 << 31)) * F.lit(1103515245)
    base = base.withColumns({
        "skey": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")),
        "stratum": (bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")).cast("int"),
        "salt": F.pmod(F.floor(mixer / 65536), F.lit(salts)).cast("int"),
    })
    cell = ["skey", "stratum", "salt"]
    counts = base.groupBy(*cell).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("skey").orderBy("stratum", "salt")) - F.col("n")
    before = counts.select(*cell, before.alias("before"))
    share = targets(base.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), weights, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "skey")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    share = share.select("skey", "source_size", "target", rate.alias("rate"), offset.alias("offset"))
    within = F.row_number().over(Window.partitionBy(*cell).orderBy("size", F.col("doc_id").asc_nulls_last(), "tie"))
    out = base.withColumn("i", within).join(before, cell).join(share, "skey")
    place = F.col("before") + F.col("i")
    copies = F.floor(place * F.col("rate") + F.col("offset")) - F.floor((place - 1) * F.col("rate") + F.col("offset"))
    out = out.withColumn("copies", F.least(copies, F.lit(cap).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *([f"carried.{c}" for c in carry]))


SQL = """
WITH base AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(text, '')), 1, 8) AS BIGINT) AS drawn FROM documents),
n AS (SELECT greatest(16, CAST(ceil(count(*) / 65536.0) AS BIGINT)) AS salts FROM documents),
keyed AS (SELECT base.*, coalesce('s' || source, 'n') AS skey,
  length(bin(size)) * 16 + (size >> CAST(greatest(length(bin(size)) - 4, 0) AS BIGINT)) AS stratum,
  ((((coalesce(doc_id, drawn) % 2147483648) + 2147483648) % 2147483648) * 1103515245 // 65536) % salts AS salt FROM base, n),
src AS (SELECT skey, source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY ALL),
weighed AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM src),
filled AS (SELECT *, 3.0::DOUBLE * source_size / weight AS fill FROM weighed),
leveled AS (SELECT *, row_number() OVER up AS k,
  CAST((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER (ORDER BY fill, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / (sum(weight) OVER (ORDER BY fill, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM filled WINDOW up AS (ORDER BY fill, skey)),
rise AS (SELECT arg_min(level, k) AS rise FROM leveled WHERE level <= fill),
share AS (SELECT skey, source_size, least(3.0::DOUBLE * source_size, rise * weight) AS target,
  CAST('0x' || substr(md5('mix' || skey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM leveled, rise),
placed AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY stratum, salt, size, doc_id NULLS LAST) AS place FROM keyed),
copied AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, u, place FROM placed JOIN share USING (skey))
SELECT doc_id, size, source_size, target,
  CAST(least(3, floor(place * rate + u) - floor((place - 1) * rate + u)) AS BIGINT) AS copies,
  CAST(least(3, floor(place * rate + u) - floor((place - 1) * rate + u)) AS BIGINT) * size AS taken FROM copied
"""
