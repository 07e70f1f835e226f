"""Exact top-k inner products by elimination with a table of pivots.

A vector's distances to the pivots are computed once. For a query q and a candidate x the largest |d(q,p) - d(x,p)| is a
lower bound of their distance, hence (|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of their inner product. Candidates
are evaluated from the highest bound down, and a query stops when the next bound is below its k-th score: exact, whatever
the pivots. Only what the bounds leave is evaluated.

Rows are dealt by their nearest pivot, so that a block holds what lies together, and a block is left out as a whole for a
query if its ranges of distances allow. A query's k-th score among the sample, from which the pivots come, is a first
bound for every block; within a task it rises from block to block. The results of blocks are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.shared import Scratch

PIVOTS, SAMPLE, QUERY_BLOCK, DATA_BLOCK = 64, 2048, 512, 4096
TOGETHER, FIRST, MORE = 8, 64, 64  # queries whose bounds are computed at once, candidates evaluated before the first stop, and how many times as many before each next
#: Distances are kept in single precision. One counts as so much less and more than kept, whatever it is a distance to: a far pivot bounds little, but never too much.
BELOW, ABOVE = np.float32(1 - 2.0**-21), np.float32(1 + 2.0**-21)
_BLOCK = "dim int, ids binary, rows binary, vectors binary, tables binary, least binary"


def choose_pivots(sample: list[np.ndarray], count: int) -> dict[int, np.ndarray]:
    """By length of vector: the origin, then each time the sampled vector farthest from those chosen."""
    out = {}
    for dim in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == dim], np.float64)
        chosen = [np.zeros(dim)]
        far = np.linalg.norm(x, axis=1)
        while len(chosen) < count and far.max(initial=0) > 0:
            chosen.append(x[int(far.argmax())])
            far = np.minimum(far, np.linalg.norm(x - chosen[-1], axis=1))
        out[dim] = np.array(chosen)
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of rows, exact: in doubles while all sums stay below 2 to the 53, else in 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[-1]
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if top < 2**53 else q @ x.T


class Sample:
    """Bounded: what every worker gets. The vectors by length, with their row numbers, and the pivots."""

    def __init__(self, rows: list[int], vectors: list[np.ndarray], pivots: int):
        self.pivots = choose_pivots(vectors, pivots)
        self.rows = {d: np.array([r for r, v in zip(rows, vectors, strict=True) if len(v) == d], np.int64) for d in self.pivots}
        self.vectors = {d: np.array([v for v in vectors if len(v) == d], np.int64) for d in self.pivots}

    def table(self, x: np.ndarray) -> np.ndarray:
        """Distances to the pivots of this length; to the origin, if the sample had none of it."""
        f = x.astype(np.float64)
        return np.stack([np.linalg.norm(f - q, axis=1) for q in self.pivots.get(x.shape[1], np.zeros((1, x.shape[1])))], axis=1).astype(np.float32)

    def least(self, rows: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """Each row's k-th score among the sample without itself: its k-th among all is no lower. The least integer if the sample has fewer."""
        out = np.full(len(rows), np.iinfo(np.int64).min)
        known = self.vectors.get(x.shape[1])
        if known is None or len(known) <= k:
            return out
        scores = _products(x, known)
        scores[rows[:, None] == self.rows[x.shape[1]][None, :]] = np.iinfo(np.int64).min
        return np.partition(scores, len(known) - k, axis=1)[:, len(known) - k]


def _nearest(shared):
    """Rows with the number of their nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            values, at = np.asarray(column.values), np.asarray(column.offsets, np.int64)
            sizes, near = np.diff(at), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(sizes):
                here = np.flatnonzero(sizes == dim)
                x = values[at[here][:, None] + np.arange(dim)]
                near[here] = shared.value.table(x).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["vec_id", "row", "asks", "v", "near"])

    return K.trimmed(run)


def _pack(shared, size: int, k: int):
    """Blocks of vectors of one length: ids, row numbers, vectors, distances to the pivots, and (k > 0) k-th scores among the sample."""

    def emit(dim: int, ids: list[int], rows: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
        x, rows = np.array(vectors, np.int64).reshape(len(ids), dim), np.array(rows, np.int64)
        parts = (np.array(ids, np.int64), rows, x, shared.value.table(x), shared.value.least(rows, x, k) if k else np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in parts)], names=["dim", "ids", "rows", "vectors", "tables", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            column = batch.column(2)
            values, at = np.asarray(column.values), np.asarray(column.offsets)
            for j, (i, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                v = values[at[j] : at[j + 1]]
                parts = held.setdefault(len(v), ([], [], []))
                for part, x in zip(parts, (i, row, v), strict=True):
                    part.append(x)
                if len(parts[0]) >= size:
                    yield emit(len(v), *held.pop(len(v)))
        for dim, parts in held.items():
            yield emit(dim, *parts)

    return K.trimmed(run)


class Best:
    """The k best of each query of a block so far: scores descending, ties by smaller id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, table: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.rows, self.vectors, self.table, self.k = ids, rows, vectors, table, k
        self.plain = vectors.astype(np.float64)
        self.square, self.top = (self.plain**2).sum(axis=1), float(np.abs(self.plain).max(initial=0))
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.least = least.astype(np.int64)  # no lower score is among the k best
        self.evaluated = 0

    def offer(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        plain = x.astype(np.float64)
        square = (plain**2).sum(axis=1)
        exact = self.top * float(np.abs(plain).max(initial=0)) * x.shape[1] < 2**53  # all sums are whole in doubles
        columns = np.ascontiguousarray(table.T)
        # What the block as a whole allows: no distance outside its range to each pivot, no vector longer than its longest.
        gap = np.maximum(self.table * BELOW - table.max(axis=0) * ABOVE, table.min(axis=0) * BELOW - self.table * ABOVE).max(axis=1)
        gap = np.maximum(gap, 0).astype(np.float64)
        wanted = np.flatnonzero(self._upper(self.square, square.max(), gap) >= self.least)
        for at in range(0, len(wanted), TOGETHER):
            self._offer(wanted[at : at + TOGETHER], ids, rows, plain if exact else x, columns, square)

    @staticmethod
    def _upper(a, b, bound):
        return (a + b - bound * bound) / 2 + 4e-6 * (1 + a + b)  # with room for the rounding of the distances

    def _offer(self, part: np.ndarray, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, columns: np.ndarray, square: np.ndarray) -> None:
        low, high = self.table[part] * BELOW, self.table[part] * ABOVE
        bound, gap = np.zeros((len(low), len(ids)), np.float32), np.empty((len(low), len(ids)), np.float32)
        for p, column in enumerate(columns):
            for a, b in ((low[:, p, None], column * ABOVE), (column * BELOW, high[:, p, None])):
                np.subtract(a, b, out=gap)
                np.maximum(bound, gap, out=bound)
        upper = self._upper(self.square[part, None], square[None, :], bound.astype(np.float64))
        upper[self.rows[part, None] == rows[None, :]] = -np.inf
        vectors = self.plain if x.dtype == np.float64 else self.vectors
        for i, j in enumerate(part):
            live, step = np.flatnonzero(upper[i] >= max(float(self.least[j]), -1e300)), FIRST
            while len(live):
                if len(live) > step:  # the highest bounds first
                    order = np.argpartition(-upper[i, live], step)
                    now, live = live[order[:step]], live[order[step:]]
                else:
                    now, live = live, live[:0]
                self._keep(j, (x[now] @ vectors[j]).astype(np.int64), ids[now])
                live = live[upper[i, live] >= self.least[j]]
                step *= MORE

    def _keep(self, j: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.evaluated += len(ids)
        good = scores >= self.least[j]
        s, n = np.concatenate((self.found[j][0], scores[good])), np.concatenate((self.found[j][1], ids[good]))
        if len(s) > self.k:
            keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, n = s[keep], n[keep]
        order = np.lexsort((n, -s))[: self.k]
        self.found[j] = s[order], n[order]
        if len(order) == self.k:
            self.least[j] = max(self.least[j], self.found[j][0][-1])

    def record(self) -> pa.RecordBatch:
        count = [len(s) for s, _ in self.found]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, count)), pa.array(np.repeat(self.rows, count)), pa.array(np.concatenate([n for _, n in self.found])), pa.array(np.concatenate([s for s, _ in self.found]))], ["query_id", "query_row", "vec_id", "score"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = None, None
        for batch in batches:
            for row in batch.to_pylist():
                whole = lambda name, row=row: np.frombuffer(row[name], np.int64)
                dim, q = row["qdim"], whole("qrows")
                if now != (dim, row["qrows"]):
                    if best is not None:
                        yield best.record()
                    now = (dim, row["qrows"])
                    best = Best(whole("qids"), q, whole("qvectors").reshape(len(q), dim), np.frombuffer(row["qtables"], np.float32).reshape(len(q), -1), whole("qleast"), k)
                if row["dim"] == dim:
                    ids = whole("ids")
                    best.offer(ids, whole("rows"), whole("vectors").reshape(len(ids), dim), np.frombuffer(row["tables"], np.float32).reshape(len(ids), -1))
        if best is not None:
            yield best.record()

    return K.trimmed(run)


def top_inner(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, tables: Scratch | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest integer inner product with each query, without its own.

    A component x counts as floor(scale * x). Ties go to the smaller vec_id. Vectors that are null or hold a null or
    non-finite component, and rows without an id, take no part; vectors meet those of their own length only. Rows that
    repeat an id are queries and candidates each on their own: such a query has its ranks once for each row. Fewer
    candidates than k give all. Inner products must fit 64 bits. Only vec_id and embedding are read. An empty table gives
    an empty result.
    """
    spark = rows.sparkSession
    scratch = tables or Scratch(spark, "topk")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    valid = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    valid = scratch.put(valid.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(is_query, F.lit(False)).alias("asks"), whole.alias("v")), "rows")
    drawn = valid.orderBy(F.xxhash64("row", "vec_id"), "row").limit(SAMPLE).select("row", "v").toPandas()  # SAMPLE rows at most
    sample = spark.sparkContext.broadcast(Sample(drawn["row"].tolist(), [np.array(v, np.int64) for v in drawn["v"]], PIVOTS))
    placed = valid.mapInArrow(_nearest(sample), "vec_id long, row long, asks boolean, v array<long>, near int")
    placed = scratch.put(placed.repartitionByRange("near", "row").sortWithinPartitions("near", "row"), "placed")
    packed_q = scratch.put(placed.filter("asks").select("vec_id", "row", "v").mapInArrow(_pack(sample, QUERY_BLOCK, k), _BLOCK), "queries")
    packed = scratch.put(placed.select("vec_id", "row", "v").mapInArrow(_pack(sample, DATA_BLOCK, 0), _BLOCK), "data").drop("least")
    named = packed_q.select(*(F.col(c).alias(f"q{c}") for c in packed_q.columns))
    hits = named.crossJoin(packed).mapInArrow(_search(k), "query_id long, query_row long, vec_id long, score long")  # blocks, not rows
    hits = scratch.put(hits, "hits")
    scratch.drop("rows", "placed", "queries", "data")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.r <> d.r AND len(q.v) = len(d.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
