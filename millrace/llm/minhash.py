"""Near-duplicate groups by min-max hashing.

1. One pass over the texts: the set of 5-word shingle hashes, and under each of 64 permutations both its least and its
   greatest value: 128 values for 64 evaluations. 32 bands of two permutations (four values) each. At a similarity of
   0.75 a band agrees with probability 0.32, so that a pair agrees in none with probability 5e-6.
2. Rows with equal sets collapse to one class (pre-aggregated, so a third of all rows being copies is no hot key), which
   has a number of its own: ids may repeat or be null.
3. Each band value that several classes have ties them to the least of them. Of these ties, those whose 128 values
   suggest a similarity under LOOSE go (the estimate errs by 0.04; chance ties must not chain families together).
   Where a tie went, the members of that value are compared with each other by their 128 values, in blocks of CLOSE, and
   tied from LOOSE on. So a pair of 0.75 or more, which has some 10 common bands, is tied, directly or by others.
4. Families (components of the ties) are compared on their full sets. First every member with the family's hub (its
   least class), which settles near copies of one text at a cost linear in their number. Members that the hub does not
   link then meet those it does and each other, in blocks dealt out by a hash, so that a family of any size is many
   small tasks; members already joined are not compared, and a block gives a spanning forest of its links.
5. Components of the links, and back to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.links import components
from millrace.llm.shared import Scratch, marked

PERMUTATIONS, BANDS, BLOCK, SHINGLES, CLOSE, LOOSE = 64, 32, 256, 1 << 17, 1024, 0.55  # BLOCK: members, SHINGLES: all theirs, of a block
_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * K.U(2) + K.U(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
SIGNATURE = "doc_id long, t1 long, t2 long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary"


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value of each permutation: (64, 2)."""
    low, high = np.full(PERMUTATIONS, ~K.U(0)), np.zeros(PERMUTATIONS, K.U)
    for i in range(0, len(shingles), 4096):
        x = _A[:, None] * shingles[None, i : i + 4096]
        x += _B[:, None]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.stack([low, high], axis=1)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            count, h = np.zeros(n, np.int64), np.zeros((n, 2), K.U)
            bands, sig = np.zeros((n, BANDS), np.int64), np.zeros((n, 2 * PERMUTATIONS), np.uint8)
            for i, rows, buf, at in K.pieces(batch.column(3)):
                sh, first = K.shingle_hashes(buf, at, size)
                for d in range(rows):
                    s = np.unique(sh[first[d] : first[d + 1]])
                    count[i + d] = len(s)
                    if len(s):
                        m = signature(s)
                        h[i + d] = s.sum(), (s * (s >> K.U(7) | K.U(1))).sum()
                        q = m.reshape(BANDS, -1)
                        bands[i + d] = K.mix((q * K.PLACE[: q.shape[1]]).sum(axis=1)).view(np.int64)
                        sig[i + d] = (K.mix(m.ravel()) >> K.U(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(count), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].copy().view(np.int64)), _rows(bands, count > 0), pa.array([x.tobytes() for x in sig], pa.binary())],
                ["doc_id", "t1", "t2", "n_shingles", "h1", "h2", "bands", "sig"],
            )

    return K.trimmed(run)


def _rows(values: np.ndarray, has: np.ndarray) -> pa.Array:
    lengths = np.where(has, values.shape[1], 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values[has].ravel()))


def _bytes(signatures) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, signatures)), np.uint8).reshape(len(signatures), -1)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal values, less what 8 bits of each agree by chance."""
    return ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_alike(_bytes(a), _bytes(b))) if len(a) else pd.Series([], dtype="float64")


def close(sig: np.ndarray, left: np.ndarray, right: np.ndarray, tied: np.ndarray, loose: float) -> list[tuple[int, int]]:
    """As forest, by signatures; members marked tied are joined already."""
    group, out = np.arange(len(sig)), []
    group[tied] = len(sig)
    targets = np.flatnonzero(right)
    for i in np.flatnonzero(left):
        todo = targets[group[targets] != group[i]]
        todo = todo[(todo > i) | ~left[todo] | ~right[i]]
        for j in todo[_alike(sig[todo], sig[i]) >= loose] if len(todo) else ():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((int(i), int(j)))
    return out


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between members marked left and members marked right (either may be both) that join what was not yet joined.
    Members marked joined are in one group from the start.

    Exact: each left set is marked in a table of the shingles of all, and one sum over the right sets gives all
    intersections. A pair that others already join needs no comparison.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(sizes)))
    group, out, mark = np.arange(n), [], np.zeros(int(local.max(initial=-1)) + 1, np.int32)
    if joined is not None:
        group[joined] = n
    targets = np.flatnonzero(right)
    for i in np.flatnonzero(left):
        todo = targets[group[targets] != group[i]]
        todo = todo[(todo > i) | ~left[todo] | ~right[i]]  # a pair of two-sided members once
        todo = todo[100 * np.minimum(sizes[todo], sizes[i]) >= percent * np.maximum(sizes[todo], sizes[i])]
        if not len(todo):
            continue
        mine = local[at[i] : at[i + 1]]
        mark[mine] = 1
        if len(todo) * 2 > n:
            common = np.add.reduceat(mark[local], at[:-1])[todo]
        else:
            common = np.array([mark[local[at[j] : at[j + 1]]].sum() for j in todo])
        mark[mine] = 0
        for j in todo[100 * common >= percent * (sizes[todo] + sizes[i] - common)]:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((int(i), int(j)))
    return out


def _separate(loose: float):
    """Rows of a bucket: bucket, i, j, block, node, signature, and whether the tie to the bucket's least member stays."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        block, tied = np.array([r[3] for r in rows]), np.array([r[6] for r in rows])
        for a, b in close(_bytes([r[5] for r in rows]), block == rows[0][1], block == rows[0][2], tied, loose):
            yield rows[a][4], rows[b][4]

    return _grouped(links)


def _compare(size: int, percent: int):
    """Rows of a family: component, i, j, block, node, text, and whether the hub links the member."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        (_, i, j), texts = rows[0][:3], pa.array([r[5] for r in rows], pa.string())
        sets: list[np.ndarray] = []
        for _, n, buf, at in K.pieces(texts):
            sh, first = K.shingle_hashes(buf, at, size)
            sets += [np.unique(sh[first[d] : first[d + 1]]) for d in range(n)]
        block, joined = np.array([r[3] for r in rows]), np.array([r[6] for r in rows], bool)
        for a, b in forest(sets, block == i, block == j, percent, joined):
            yield rows[a][4], rows[b][4]

    return _grouped(links)


def _grouped(links):
    """Rows arrive sorted by family or bucket and pair of blocks; a group is at most two blocks of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    found += links(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        if held:
            found = list(links(held))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return K.trimmed(run)


def _dealt(rows: DataFrame, key: str, node: str, *carry: str) -> DataFrame:
    """key, i, j, block, node: each row once for each pair of blocks that its own is in. rows has nb, the number of blocks."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64(node), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    return rows.select(key, node, "block", *carry, other).select(key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", node, *carry)


def _blocks(n: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(shingles) / SHINGLES)).cast("int")


def _among(tied: DataFrame, judged: DataFrame, sig: DataFrame) -> DataFrame:
    """Ties among the members of buckets in which a tie to the least member went."""
    rows = tied.join(judged, ["least", "node"])
    cut = rows.groupBy("bucket").agg(F.ceil(F.count("*") / CLOSE).cast("int").alias("nb"), F.count("*").alias("n"), F.min("near").alias("whole")).filter("n > 1 and not whole").select("bucket", "nb")
    rows = _dealt(rows.join(cut, "bucket"), "bucket", "node", "near").join(sig, "node").select("bucket", "i", "j", "block", "node", "sig", "near")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return rows.mapInArrow(_separate(LOOSE), "a long, b long")


def _families(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """component, node, t1, t2, n_shingles of every class that a tie holds; the component is the least of its nodes."""
    member = classes.select("node", F.posexplode("bands").alias("band", "value"))
    bucket = member.groupBy("band", "value").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").select("band", "value", "least")
    tied = scratch.put(member.join(bucket, ["band", "value"]).filter("node <> least").select(F.xxhash64("band", "value").alias("bucket"), "least", "node"), "tied")
    sig = classes.select("node", "sig")
    pairs = tied.select("least", "node").distinct()
    pairs = pairs.join(sig.withColumnRenamed("sig", "x"), "node").join(sig.select(F.col("node").alias("least"), F.col("sig").alias("y")), "least")
    likeness = F.pandas_udf(_likeness, "double")
    judged = scratch.put(pairs.select("least", "node", (likeness("x", "y") >= LOOSE).alias("near")), "judged")
    ties = judged.filter("near").select(F.col("node").alias("a"), F.col("least").alias("b"))
    family = components(ties.unionAll(_among(tied, judged, sig)), scratch, "ties")
    family = family.select("node", "component").unionAll(family.select(F.col("component").alias("node"), "component").distinct())
    family = scratch.put(family.join(classes.select("node", "t1", "t2", "n_shingles"), "node").select("component", "node", "t1", "t2", "n_shingles"), "family")
    scratch.drop("tied", "judged")
    return family


def _links(docs: DataFrame, family: DataFrame, scratch: Scratch, percent: int, size: int) -> DataFrame:
    """Links (a, b) of nodes, as forests, after comparison of full sets."""
    texts = marked(docs, family, "t1").filter("maybe").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    members = scratch.put(family.join(texts, ["t1", "t2"]).select("component", "node", "n_shingles", "text"), "members")
    compare, columns = _compare(size, percent), ["component", "i", "j", "block", "node", "text", "joined"]

    def compared(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(*columns).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
        return scratch.put(rows.mapInArrow(compare, "a long, b long"), name)

    nb = family.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).select("component", _blocks("n", "s").alias("nb"))
    rows, hub = members.join(nb, "component"), F.col("node") == F.col("component")
    block = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    dealt = rows.filter(~hub).select("component", F.lit(-1).alias("i"), block.alias("j"), block.alias("block"), "node", "text", F.lit(False).alias("joined"))
    hubs = rows.filter(hub).select("component", F.lit(-1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), F.lit(-1).alias("block"), "node", "text", F.lit(False).alias("joined"))
    near = compared(dealt.unionAll(hubs), "near")
    touched = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("hit", F.lit(True))
    rest = family.filter(~hub).join(touched, "node", "left").select("component", "node", "n_shingles", F.col("hit").isNotNull().alias("joined"))
    count = lambda joined, what: F.sum(F.when(F.col("joined") == F.lit(joined), what).otherwise(0))
    counts = rest.groupBy("component").agg(*(count(j, w).alias(f"{k}{int(j)}") for j in (False, True) for k, w in (("n", F.lit(1)), ("s", F.col("n_shingles")))))
    # Blocks of members that the hub leaves come first, then those of members that it links.
    counts = counts.filter("n0 > 0 and n0 + n1 > 1").select("component", _blocks("n0", "s0").alias("nb0"), _blocks("n1", "s1").alias("nb1"))
    rest = scratch.put(rest.join(counts, "component").select("node", "joined", "nb0", "nb1"), "rest")
    if not rest.take(1):
        return near
    h = F.xxhash64("node")
    own = F.when(F.col("joined"), F.col("nb0") + F.pmod(h, F.greatest("nb1", F.lit(1)))).otherwise(F.pmod(h, F.col("nb0"))).cast("int")
    last = F.when(F.col("joined"), F.col("nb0")).otherwise(F.col("nb0") + F.col("nb1"))
    rows = rest.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    rows = rows.select("node", "joined", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return near.unionAll(compared(rows.join(members, "node"), "far"))


def near_groups(docs: DataFrame, percent: int = 75, size: int = 5, tables: Scratch | None = None) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), n_shingles, grp: of each row, the number of its component; null without a word.

    Groups are of texts: rows that repeat an id, or have none, are in the group of their own text.
    """
    spark = docs.sparkSession
    scratch = tables or Scratch(spark, "near")
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), text.alias("text"))
    signed = scratch.put(docs.mapInArrow(_signatures(size), SIGNATURE), "signed")
    key = ["n_shingles", "h1", "h2"]
    classes = signed.filter("n_shingles > 0").groupBy(*key).agg(F.min(F.struct("t1", "t2")).alias("t"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = scratch.put(classes.select(*key, "t.t1", "t.t2", "bands", "sig", F.monotonically_increasing_id().alias("node")), "classes")
    family = _families(classes, scratch)
    links = _links(docs, family, scratch, percent, size)
    label = components(links, scratch, "links").select("node", "component")
    final = classes.select(*key, "node").join(label, "node", "left").select(*key, F.coalesce("component", "node").alias("grp"))
    out = scratch.put(signed.select("doc_id", "t1", "t2", *key).join(final, key, "left").select("doc_id", "t1", "t2", "n_shingles", "grp"), "groups")
    scratch.drop("signed", "classes", "family", "members", "near", "far", "rest")
    return out


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5, tables: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links), kept (whether that is the row's own id).

    Rows without a word (null, empty or blank texts) have an empty set and are linked with nothing. Fewer words than a
    shingle has make one shingle. Rows that repeat an id are one document: what any of their texts reaches, all of them
    with a word reach. Rows without an id link others as all do; theirs is the least id of their component, null if it
    has none, and only then are they kept. Ties: the least id stands for a component. Columns besides doc_id and text
    are not read. An empty table gives an empty result.
    """
    scratch = tables or Scratch(docs.sparkSession, "ids")
    rows = near_groups(docs, percent, size)
    named = rows.filter("doc_id is not null and grp is not null")
    spread = scratch.put(named.groupBy("doc_id").agg(F.min("grp").alias("least"), F.max("grp").alias("most")).filter("least <> most").select("doc_id", "least"), "spread")
    if spread.take(1):  # an id in several groups joins them
        joined = components(named.join(spread, "doc_id").select(F.col("grp").alias("a"), F.col("least").alias("b")), scratch, "joined")
        rows = rows.join(joined.withColumnRenamed("node", "grp"), "grp", "left").withColumn("grp", F.coalesce("component", "grp"))
    least = rows.filter("grp is not null").groupBy("grp").agg(F.min("doc_id").alias("least"))
    whole = F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    out = rows.join(least, "grp", "left").select("doc_id", "n_shingles", whole.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, percent: int = 75, size: int = 5, tables: Scratch | None = None) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of least id, null last, then of least text hash, then of least other columns.

    Rows without a word are in no group and stay. Rows that repeat an id with different texts are judged each by its text.
    """
    scratch = tables or Scratch(docs.sparkSession, "distinct")
    rows = near_groups(docs, percent, size)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    best = rows.filter("grp is not null").groupBy("grp").agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1").select("grp", "best")
    judged = rows.join(best, "grp").select("doc_id", "t1", "t2", (order == F.col("best")).alias("stays"))
    judged = judged.groupBy("doc_id", "t1", "t2").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1")
    judged = scratch.put(judged.select(F.col("doc_id").alias("of_id"), "t1", "t2", "stays"), "judged")
    text, columns = F.col("text").cast("string"), docs.columns
    held = docs.select(F.struct(*columns).alias("row"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"))
    held = marked(held, judged, "t1")
    some = held.filter("maybe").withColumn("of_id", F.col("row.doc_id").cast("long")).alias("d")
    same = [F.col("d.t1") == F.col("j.t1"), F.col("d.t2") == F.col("j.t2"), F.col("d.of_id").eqNullSafe(F.col("j.of_id"))]
    some = some.join(judged.alias("j"), same, "left").select("row", "d.of_id", "d.t1", "d.t2", "stays")
    copied = some.filter("stays").groupBy("of_id", "t1", "t2").agg(F.min("row").alias("row"))
    return held.filter("not maybe").select("row.*").unionAll(some.filter("stays is null").select("row.*")).unionAll(copied.select("row.*"))
