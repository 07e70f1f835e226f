"""Near-duplicate embeddings by binary codes of a random rotation, with stored correction factors.

A unit vector x is rotated at random; its code is the signs of what comes out, which is the unit vector c nearest to it
among all sign patterns, and <c, x> is stored as its correction factor. For any unit vector y, <c, y> / <c, x> is an
unbiased estimate of <x, y>, and its error is at most EPSILON * sqrt(1 - <x, y>^2) * sqrt(1 - <c, x>^2) / <c, x> / sqrt(D - 1)
but for a chance below 2 exp(-EPSILON^2 / 2). y itself is kept rotated, in 8 bits a component, whose rounding is added to
the bound. A pair whose estimate, either way, shows that it is below the wanted cosine is done; all others are computed
exactly, in doubles, from the vectors as given.

Pairs meet in buckets of cross-polytope hashes: the number and sign of the largest component after a rotation, for
several rotations joined. There are as many tables of such buckets as a pair at the wanted cosine needs to meet in one of
them but for a share of LOSS, from the measured chance that it meets. Only codes are sent to the buckets, not vectors.

Crowded buckets: exact copies count as one vector before. In a bucket of more than BLOCK rows some are hubs; what is so near to a
hub that any two such vectors must be linked (half the wanted angle) is its core. Links inside a core are counted, never
paired. What is left meets in pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.links import components
from millrace.llm.shared import Scratch

LEAST, LOSS, EPSILON = 0.9, 5e-4, 6.0
BLOCK, IN_BUCKET, PAIRS, ROUNDS = 256, 4, 1 << 15, 4
_CHANCE: dict[tuple[int, float], float] = {}
_MATRICES: dict[int, np.ndarray] = {}


def padded(dim: int) -> int:
    return max(64, 1 << (dim - 1).bit_length())


def _signs(width: int, name: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([width, name])).integers(0, 2, (3, width)) * 2.0 - 1


def rotated(x: np.ndarray, name: int) -> np.ndarray:
    """Rows under the random rotation of that number: up to 64 components a random orthogonal matrix, beyond three times random signs and a Hadamard transform. Row length: a power of two."""
    n, width = x.shape
    if width == 64:
        if name not in _MATRICES:
            q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([width, name])).normal(size=(width, width)))
            _MATRICES[name] = q * np.sign(np.diag(r))
        return x @ _MATRICES[name]
    for s in _signs(width, name):
        x = x * s
        h = 1
        while h < width:
            y = x.reshape(n, width // (2 * h), 2, h)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, width)
            h *= 2
        x = x / math.sqrt(width)
    return x


def polytope(x: np.ndarray, name: int) -> np.ndarray:
    """The nearest vertex of the rotated cross-polytope: 2 * width values."""
    y = rotated(x, name)
    at = np.abs(y).argmax(axis=1)
    return 2 * at + (y[np.arange(len(y)), at] < 0)


def meeting_chance(width: int, cosine: float, draws: int = 4000) -> float:
    """That two vectors of this cosine have one vertex in common; measured, over random rotations."""
    if (width, cosine) not in _CHANCE:
        rng, hit, each = np.random.default_rng(width), 0, draws // 20
        for name in range(20):
            x, e = rng.normal(size=(2, each, width))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            e -= (e * x).sum(axis=1, keepdims=True) * x
            e /= np.linalg.norm(e, axis=1, keepdims=True)
            y = cosine * x + math.sqrt(1 - cosine**2) * e
            hit += int((polytope(x, 1000 + name) == polytope(y, 1000 + name)).sum())
        _CHANCE[width, cosine] = hit / (20 * each)
    return _CHANCE[width, cosine]


def plan(n: int, dim: int, cosine: float = LEAST, loss: float = LOSS) -> tuple[int, int]:
    """(vertices joined in a key, tables): unrelated vectors are about IN_BUCKET to a bucket at any n."""
    width = padded(dim)
    joined = max(1, round(math.log(max(1, n / IN_BUCKET)) / math.log(2 * width)))
    p = meeting_chance(width, cosine) ** joined
    return joined, max(1, math.ceil(math.log(loss) / math.log1p(-p)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of each length."""
    values, at = np.asarray(column.values, np.float64), np.asarray(column.offsets, np.int64)
    size = np.diff(at)
    for dim in np.unique(size):
        here = np.flatnonzero(size == dim)
        yield here, values[at[here][:, None] + np.arange(dim)]


def encoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: sign bits, rotated components in 8 bits, and the correction factor with the 8 bits' unit."""
    width = padded(x.shape[1])
    y = rotated(np.pad(x, ((0, 0), (0, width - x.shape[1]))), 0)
    step = np.abs(y).max(axis=1) / 127
    factor = np.abs(y).sum(axis=1) / math.sqrt(width)
    return np.packbits(y >= 0, axis=1), np.rint(y / step[:, None]).astype(np.int8), np.stack((factor, step), axis=1).astype(np.float32)


def _encode(plans: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for here, x in _matrix(batch.column(1)):
                dim = x.shape[1]
                joined, tables = plans[dim]
                x = unit(x)
                bits, q, f = encoded(x)
                wide = np.pad(x, ((0, 0), (0, padded(dim) - dim)))
                keys = np.zeros((len(x), tables), np.int64)
                for t in range(tables):
                    h = np.full(len(x), dim * 65_537 + t, K.U)
                    for j in range(joined):
                        h = K.mix(h * K.U(0x9E3779B97F4A7C15) + polytope(wide, 1 + t * joined + j).astype(K.U) + K.U(1))
                    keys[:, t] = h.view(np.int64)
                code = [b.tobytes() + a.tobytes() + c.tobytes() for b, a, c in zip(bits, q, f, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(here)), pa.array(code, pa.binary()), lists], ["node", "code", "keys"])

    return K.trimmed(run)


def estimates(bits: np.ndarray, q: np.ndarray, f: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (a, b): the estimate of the inner product from a's code and b's components, and the least that it would be (but for the chance that EPSILON leaves) if the cosine were as wanted."""
    width = q.shape[1]
    dot = np.einsum("ij,ij->i", bits[a], q[b], dtype=np.float32) * f[b, 1] / math.sqrt(width)
    c = np.minimum(f[a, 0], 1.0)
    spread = min(EPSILON / math.sqrt(width - 1), 1.0) * np.sqrt(1 - c * c) * math.sqrt(1 - cosine**2)
    rounding = math.sqrt(width) * f[b, 1] / 2
    return dot / c, cosine - (spread + rounding) / c - 1e-4


def _meet(cosine: float):
    """Rows arrive sorted by unit. A unit is a bucket (side 0 only) or two blocks of one; the undecided pairs of rows of different cores go out."""

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        unit_, side, node, core = (np.concatenate([h[k] for h in held]) for k in range(4))
        code = [c for h in held for c in h[4]]
        size = np.array([len(c) for c in code])
        for bytes_ in np.unique(size):
            here = np.flatnonzero(size == bytes_)
            raw = np.frombuffer(b"".join(code[i] for i in here), np.uint8).reshape(len(here), bytes_)
            width = (bytes_ - 8) * 8 // 9
            bits = np.unpackbits(raw[:, : width // 8], axis=1).astype(np.float32) * 2 - 1
            q = np.ascontiguousarray(raw[:, width // 8 : width // 8 + width]).view(np.int8).astype(np.float32)
            f = np.ascontiguousarray(raw[:, width // 8 + width :]).view(np.float32)
            for a, b in _pairs(unit_[here], side[here]):
                u, s, n, k = (v[here] for v in (unit_, side, node, core))
                keep = (n[a] != n[b]) & ((k[a] != k[b]) | (k[a] < 0))
                a, b = a[keep], b[keep]
                for _ in range(2):  # both ways: two codes, two estimates
                    got, bound = estimates(bits, q, f, a, b, cosine)
                    a, b = b[got >= bound], a[got >= bound]
                if len(a):
                    lo, hi = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                    yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit_, side, node, core = (np.asarray(batch.column(k)) for k in range(4))
            code = batch.column(4).to_pylist()
            cut = 0
            if rows >= 4096:  # a unit ends: it has at most two blocks
                new = np.flatnonzero(np.concatenate(([unit_[0] != last], unit_[1:] != unit_[:-1])))
                if len(new):
                    cut = int(new[0])
                    if cut:
                        held.append((unit_[:cut], side[:cut], node[:cut], core[:cut], code[:cut]))
                    yield from settle(held)
                    held, rows = [], 0
            held.append((unit_[cut:], side[cut:], node[cut:], core[cut:], code[cut:]))
            rows, last = rows + len(unit_) - cut, unit_[-1]
        if held:
            yield from settle(held)

    return K.trimmed(run)


def _pairs(unit_: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within a unit, or between its two sides if it has two; about PAIRS at a time. Rows are ordered by unit and side."""
    n = len(unit_)
    if n < 2:
        return
    begin = np.flatnonzero(np.concatenate(([True], unit_[1:] != unit_[:-1])))
    end = np.append(begin[1:], n)
    which = np.repeat(np.arange(len(begin)), end - begin)
    two = side[end - 1] > 0
    split = begin + np.add.reduceat((side == 0).astype(np.int64), begin)  # where side 1 begins
    first = np.where(two[which], np.where(side == 0, split[which], n), np.arange(n) + 1)
    many = np.maximum(np.where(two[which] & (side > 0), 0, end[which] - first), 0)
    total = np.cumsum(many)
    at = 0
    while at < n:
        stop = min(n, max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right"))))
        m = many[at:stop]
        if m.sum():
            a = np.repeat(np.arange(at, stop), m)
            b = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[at:stop], m)
            yield a, b
        at = stop


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of vectors (columns 2 and 3) with their cosine in place of them."""
    for batch in batches:
        out = np.zeros(batch.num_rows)
        right = batch.column(3)
        values, at = np.asarray(right.values, np.float64), np.asarray(right.offsets, np.int64)
        for here, x in _matrix(batch.column(2)):
            y = values[at[here][:, None] + np.arange(x.shape[1])]
            # Equal powers of two leave the quotient as it is and keep squares within a double.
            x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) for v in (x, y))
            out[here] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1)) / np.sqrt((y * y).sum(axis=1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "cosine"])


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs of nodes, exact in doubles."""
    one = lambda side: vectors.select(F.col("node").alias(side), F.col("v").alias(f"v{side}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "va", "vb")
    return both.mapInArrow(K.trimmed(_exact), "a long, b long, cosine double")


def cores(crowded: DataFrame, vectors: DataFrame, cosine: float, scratch: Scratch) -> DataFrame | None:
    """(node, core) of what lies within half the wanted angle of a hub of a crowded bucket (t, key, node). Hubs are of least hash; rows without a core choose again."""
    near = math.sqrt((1 + cosine) / 2) + 1e-9
    found, left = None, crowded
    for k in range(ROUNDS):
        full = left.groupBy("key").agg(F.count("*").alias("c"), F.min_by("node", F.xxhash64("node", F.lit(k))).alias("hub")).filter(F.col("c") > BLOCK)
        asked = scratch.put(left.join(full, "key").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), f"asked-{k}")
        if not asked.take(1):
            break
        got = cosines(asked, vectors).filter(F.col("cosine") >= near)
        own = got.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("core"))
        # A hub that found someone is in its own core, unless it belongs to another's, with which its own then goes without it.
        hubs = own.select(F.col("core").alias("node")).distinct().join(own.select("node"), "node", "left_anti").withColumn("core", F.col("node"))
        now = scratch.put(own.unionAll(hubs), f"cores-{k}")
        if not now.take(1):
            break
        found = now if found is None else found.unionAll(now)
        left = scratch.put(left.join(now.select("node"), "node", "left_anti"), f"left-{k}")
    return found


def _units(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (unit, side, node, core, code) of all buckets that two vectors share: a bucket of at most BLOCK rows is a unit, of others each two blocks that are not of one core."""
    sizes = scratch.put(entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "sizes")
    none = F.lit(-1).cast("long")
    few = entries.join(sizes.filter(F.col("c") <= BLOCK), "key").select(F.col("key").alias("unit"), F.lit(0).alias("side"), "node", "core", "code")
    many = scratch.put(entries.join(sizes.filter(F.col("c") > BLOCK).select("key"), "key").select("key", "node", "core", "code"), "many")
    groups = many.groupBy("key", "core").agg(F.count("*").alias("c"))
    groups = groups.withColumn("label", F.when(F.col("c") > BLOCK, F.col("core")).otherwise(none))
    blocks = groups.groupBy("key", "label").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks"))
    blocks = scratch.put(blocks, "blocks")
    own = many.join(groups.filter("core >= 0 and label >= 0").select("key", "core", "label"), ["key", "core"], "left").withColumn("label", F.coalesce("label", none))
    own = own.join(blocks, ["key", "label"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks").cast("long")).cast("int"))
    each = blocks.select("key", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    other = each.select("key", F.col("label").alias("label2"), F.col("block").alias("block2"))
    place, place2 = F.struct("label", "block"), F.struct("label2", "block2")
    pairs = each.join(other, "key").filter((place <= place2) & ~((F.col("label") == F.col("label2")) & (F.col("label") >= 0)))
    pairs = pairs.withColumn("unit", F.xxhash64("key", "label", "block", "label2", "block2"))
    sides = F.when(place == place2, F.array(F.struct("label", "block", F.lit(0).alias("side")))).otherwise(F.array(F.struct("label", "block", F.lit(0).alias("side")), F.struct(F.col("label2").alias("label"), F.col("block2").alias("block"), F.lit(1).alias("side"))))
    seats = pairs.select("key", "unit", F.explode(sides).alias("s")).select("key", "unit", "s.*")
    return few.unionAll(own.join(seats, ["key", "label", "block"]).select("unit", "side", "node", "core", "code"))


def near_vectors(rows: DataFrame, cosine: float = LEAST, loss: float = LOSS, tables: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    n_links counts the other rows at a cosine of at least `cosine` (positive); each is computed, or follows from two
    cosines to a hub, so none is below it. A pair at the wanted cosine is missed with a chance of `loss`, a nearer one
    with less. component_id is the smallest id that links reach, kept is whether it is the row's own. Vectors that are
    null, zero or hold a null or non-finite component have no links; vectors meet those of their own length. Rows that
    repeat an id are vectors each on their own. A null id is larger than all: a component of null ids alone has a null
    one, and its rows are kept. Only vec_id and embedding are read. An empty table gives an empty result.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the wanted cosine is above 0 and at most 1")
    spark = rows.sparkSession
    scratch = tables or Scratch(spark, "neighbours")
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    given = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, v).alias("v"))
    given = given.withColumn("twin", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v"), F.xxhash64("v", F.lit(1)))))
    given = scratch.put(given, "rows")
    reps = given.filter("v is not null").groupBy("twin").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v"))
    reps = scratch.put(reps.withColumn("dim", F.size("v")), "reps")
    vectors = reps.select("node", "v")
    plans = {r["dim"]: plan(r["n"], r["dim"], cosine, loss) for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row of each length
    codes = scratch.put(reps.select("node", "v").mapInArrow(_encode(plans), "node long, code binary, keys array<long>"), "codes")
    entries = codes.select("node", F.explode("keys").alias("key"))
    crowded = entries.join(entries.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK).select("key"), "key").select("key", "node")
    core = cores(scratch.put(crowded, "crowded"), vectors, cosine, scratch)
    none = F.lit(-1).cast("long")
    known = codes.join(core, "node", "left").withColumn("core", F.coalesce("core", none)) if core is not None else codes.withColumn("core", none)
    met = _units(known.select("node", F.explode("keys").alias("key"), "code", "core"), scratch)
    pairs = met.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(_meet(cosine), "a long, b long").distinct()
    links = cosines(scratch.put(pairs, "pairs"), vectors).filter(F.col("cosine") >= cosine).select("a", "b")
    links = scratch.put(links, "links")
    many = reps.select("node", "copies")
    ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(many.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("n"))
    ties = links
    if core is not None:
        inside = core.join(many, "node")
        total = inside.groupBy("core").agg(F.sum("copies").alias("all"))
        degree = degree.unionAll(inside.join(total, "core").select("node", (F.col("all") - F.col("copies")).alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
        ties = ties.unionAll(core.filter("node <> core").select(F.col("node").alias("a"), F.col("core").alias("b")))
    label = components(ties, scratch, "components")
    placed = reps.select("twin", "node", "copies").join(degree, "node", "left").join(label, "node", "left")
    placed = placed.select("twin", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component"))
    member = given.select("row", "vec_id", "twin").join(placed, "twin", "left").withColumn("component", F.coalesce("component", "row"))
    member = scratch.put(member.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component"), "members")
    least = member.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = member.join(least, "component")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.b = v.r GROUP BY reach.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.r) AS n_links, c.component_id, v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v JOIN c ON c.a = v.r
"""
