"""Bottom-k sketches of word shingles, with DataFrame functions only.

A sketch is the sorted array of the K least hashes (16 hexadecimal digits of MD5) of a text's distinct 5-word shingles;
fewer words make one shingle. It is the same in any engine, and sketches of parts merge to the sketch of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SIZE, DIGITS = 128, 5, 16
BLANKS = r"[\x20\x09-\x0D]+"
BUCKET_ROWS, MOST_BUCKETS = 256, 1 << 16


def sketch(text: Column, k: int = K, size: int = SIZE) -> Column:
    """The sketch of a text; null and blank texts have an empty one."""
    digest = lambda w: F.substring(F.md5(F.array_join(w, " ").cast("binary")), 1, DIGITS)

    def of(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: digest(F.slice(words, i, size)))
        return F.when(F.size(words) >= size, runs).when(F.size(words) > 0, F.array(digest(words))).otherwise(F.array().cast("array<string>"))

    split = F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")
    hashes = F.transform(F.array(split), of)[0]  # bound once: a lambda would split again for each shingle
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets, from theirs."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's sketch that is in both; 1 for two empty sets. Exact if the union has k members at most."""
    whole = merge(a, b, k)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(whole, F.array_intersect(a, b))).cast("double"), F.size(whole)), F.lit(1.0))


def distinct_count(a: Column, k: int = K) -> Column:
    """Members of the set: exact below k, else (k - 1) over the k-th hash as a part of all."""
    last = F.conv(F.substring(F.element_at(a, -1), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's set that is in b's; 1 if a's is empty."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds are below the value, by bisection."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # one literal, however many bounds
    steps = F.array(*(F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)))
    take = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) < value), at + s).otherwise(at)
    return F.coalesce(F.aggregate(steps, F.lit(0), take), F.lit(0))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next document's first ones, in
    ascending order of doc_id (null first; rows with equal ids by text), after the last the first. Rows are dealt by
    ranges of doc_id; each range gets the first row of the next, so that the texts are shuffled once and no range is
    larger than its share. Null texts are empty. A document alone follows itself. Only doc_id and text are read. An empty
    table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.count()
    parts = max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    bounds = sorted({b for b in cuts or []})
    dealt = docs.withColumn("bucket", _bucket(F.col("doc_id"), bounds)).withColumn("extra", F.lit(0))
    heads = dealt.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("head"))
    first = docs.join(F.broadcast(heads), docs["doc_id"].eqNullSafe(heads["head"]))  # a row for each bucket: MOST_BUCKETS at most
    first = first.groupBy("bucket").agg(F.min(F.struct("text", "doc_id")).alias("f")).select("bucket", "f.doc_id", "f.text")
    order = Window.orderBy("bucket")
    wrap = F.first("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    next_bucket = heads.select("bucket", F.coalesce(F.lead("bucket").over(order), wrap).alias("following"))
    tails = first.withColumnRenamed("bucket", "following").join(next_bucket, "following").select("doc_id", "text", "bucket", F.lit(1).alias("extra"))
    w = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    out = dealt.unionByName(tails).withColumn("next", F.coalesce(F.lead("text").over(w), F.lit("")))
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    out = out.select("bucket", "extra", "doc_id", "text", n.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), sketch(F.col("text"), k).alias("own"), F.when(F.col("extra") == 0, sketch(edited, k)).alias("changed"))
    out = out.withColumn("following", F.lead("own").over(w)).filter("extra = 0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("own", "").alias("fingerprint"), F.array_join("changed", "").alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"), resemblance(F.col("own"), F.col("following"), k).alias("near_next"),
    )


_SKETCH = "list_sort(list_distinct(CASE WHEN len({w}) >= 5 THEN list_transform(range(1, len({w}) - 3), lambda i: substr(md5(array_to_string({w}[i:i + 4], ' ')), 1, 16)) WHEN len({w}) > 0 THEN [substr(md5(array_to_string({w}, ' ')), 1, 16)] ELSE CAST([] AS VARCHAR[]) END))[1:128]"
_NEAR = "CASE WHEN len({b}) + len({a}) = 0 THEN 1.0 ELSE CAST(len(list_intersect(list_sort(list_distinct(list_concat({a}, {b})))[1:128], list_intersect({a}, {b}))) AS DOUBLE) / len(list_sort(list_distinct(list_concat({a}, {b})))[1:128]) END"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT text AS head FROM d ORDER BY doc_id NULLS FIRST, text LIMIT 1),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), head) AS next FROM d, f),
e AS (SELECT doc_id, text, next, substr(text, 1, length(text) - length(text) // 2) || substr(next, 1, length(text) // 2) AS edited FROM n),
w AS (SELECT doc_id, text, edited, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS a, regexp_extract_all(edited, '[^\x20\x09-\x0D]+') AS b, regexp_extract_all(next, '[^\x20\x09-\x0D]+') AS c FROM e),
s AS (SELECT doc_id, text, edited, {_SKETCH.format(w="a")} AS a, {_SKETCH.format(w="b")} AS b, {_SKETCH.format(w="c")} AS c FROM w)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  {_NEAR.format(a="a", b="b")} AS near_edited, {_NEAR.format(a="a", b="c")} AS near_next FROM s
"""
