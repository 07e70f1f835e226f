"""Importance resampling towards a target distribution, by hashed runs of words and an external sort-count.

Every document becomes a stream of bucket numbers, one for each run of 1 to ORDERS consecutive words, written as packed
16-bit numbers with the offset at which each document begins. Streams are read twice. First each is sorted and
run-length encoded, and the counts of its runs are summed over all streams, which Spark's shuffle does outside memory.
Then, with the gain of each bucket known, they are read again and the gains of a document are gathered and summed from
its offset to the next. The texts themselves are read once.

A run's bucket is the CRC-32 of its bytes modulo the number of buckets. The CRC of joined words comes from those of the
words: a shift by the length of what follows (a linear map, hence four table look-ups), and an exclusive or.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.shared import Scratch, ordinal

BUCKETS, ORDERS, LEAST_WORDS, SEED = 10_000, 3, 20, 42
STREAM = 1 << 19  # features in a row of the streams table
LOCKSTEP = 64  # bytes of words that are hashed side by side; longer words one by one
_FIELDS = "rows array<long>, ids array<long>, words array<long>, features array<long>, offsets array<int>, stream binary"
#: Separators: all of ASCII but digits and letters.
SEPARATOR = np.array([c < 0x30 or 0x3A <= c < 0x41 or 0x5B <= c < 0x61 or 0x7B <= c < 0x80 for c in range(256)])
LOWER = np.array([c + 32 if 0x41 <= c < 0x5B else c for c in range(256)], np.uint8)


class _Crc:
    """CRC-32 of many words at once and of their joins."""

    def __init__(self):
        self.byte = self._table()
        self.near = self._shifts(LOCKSTEP + 2)
        self.space = np.uint32(zlib.crc32(b" "))
        self.doubled = [self.near[1]]  # shifts by 1, 2, 4, ... bytes

    @staticmethod
    def _table() -> np.ndarray:
        c = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
        return c.astype(np.uint32)

    def _shifts(self, n: int) -> np.ndarray:
        """For 0 .. n-1 zero bytes, four tables of 256: what each byte of a CRC becomes."""
        out = np.empty((n, 4, 256), np.uint32)
        now = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
        for k in range(n):
            out[k] = now
            now = self.byte[now & np.uint32(255)] ^ (now >> np.uint32(8))
        return out

    @staticmethod
    def _apply(tables: np.ndarray, at: np.ndarray | int, c: np.ndarray) -> np.ndarray:
        out = tables[at, 0, c & np.uint32(255)]
        for k in range(1, 4):
            out ^= tables[at, k, (c >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def shift(self, c: np.ndarray, by: np.ndarray) -> np.ndarray:
        """What c becomes if so many bytes follow."""
        far = np.flatnonzero(by >= len(self.near))
        out = self._apply(self.near, np.where(by < len(self.near), by, 0), c)
        if len(far):
            now, left, k = c[far], by[far], 0
            while left.any():
                if k == len(self.doubled):
                    self.doubled.append(self._apply(self.doubled[-1][None], 0, self.doubled[-1].ravel()).reshape(4, 256))
                odd = (left & 1) == 1
                now = np.where(odd, self._apply(self.doubled[k][None], 0, now), now)
                left, k = left >> 1, k + 1
            out[far] = now
        return out

    def words(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        order = np.argsort(-np.minimum(size, LOCKSTEP).astype(np.int16), kind="stable")
        first, length = starts[order], np.minimum(size, LOCKSTEP)[order]
        c = np.full(len(order), 0xFFFFFFFF, np.uint32)
        live = np.searchsorted(-length, -np.arange(1, LOCKSTEP + 1), "right")  # words of at least 1, 2, ... bytes
        for k in range(int(length[0]) if len(length) else 0):
            n = live[k]
            c[:n] = self.byte[(c[:n] ^ low[first[:n] + k]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
        out = np.empty(len(order), np.uint32)
        out[order] = ~c
        for i in np.flatnonzero(size > LOCKSTEP).tolist():
            out[i] = zlib.crc32(low[starts[i] : ends[i]])
        return out


_CRC: list[_Crc] = []


def _crc() -> _Crc:
    if not _CRC:
        _CRC.append(_Crc())
    return _CRC[0]


def run_buckets(crc: np.ndarray, size: np.ndarray, first: np.ndarray, orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of words of each text, text after text, and where each text's begin. crc, size: of the words; first: each text's first word."""
    n, depth = len(crc), np.arange(len(crc)) - np.repeat(first[:-1], np.diff(first))
    joined, columns, there = crc, [crc % np.uint32(buckets)], [np.ones(n, bool)]
    tool = _crc()
    spaced = tool.shift(np.full(n, tool.space), size) ^ crc if orders > 1 else crc  # of a space and the word
    for k in range(1, orders):
        before = np.zeros(n, np.uint32)
        before[1:] = joined[:-1]
        joined = tool.shift(before, size + 1) ^ spaced
        columns.append(joined % np.uint32(buckets))
        there.append(depth >= k)
    there = np.stack(there, axis=1)
    stream = np.stack(columns, axis=1)[there].astype(np.uint16)
    made = np.concatenate(([0], np.cumsum(there.sum(axis=1))))
    return stream, made[first]


def _text_words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = K.words(buf, at, SEPARATOR)
    return _crc().words(LOWER[buf], starts, ends), ends - starts, first


def _long_text(buf: np.ndarray, orders: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, stream) of parts of one text: cut at separators, each part with the words before it that runs still need."""
    crc, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    gaps = np.flatnonzero(SEPARATOR[buf])
    begin = 0
    while begin < len(buf):
        k = np.searchsorted(gaps, begin + K.PIECE)
        end = int(gaps[k]) + 1 if k < len(gaps) else len(buf)
        c, s, _ = _text_words(buf[begin:end], np.array([0, end - begin]))
        old = len(crc)
        crc, size = np.concatenate((crc, c)), np.concatenate((size, s))
        stream, _ = run_buckets(crc, size, np.array([0, len(crc)]), orders, buckets)
        yield len(c), stream[sum(min(j + 1, orders) for j in range(old)) :]
        crc, size = crc[max(0, len(crc) - orders + 1) :], size[max(0, len(size) - orders + 1) :]
        begin = end


def _stream(orders: int, buckets: int):
    """Rows of packed streams of about STREAM features; a longer document goes over several rows, each of which names it."""

    def emit(held: list[tuple[int, int | None, int, np.ndarray]]) -> pa.RecordBatch:
        size = np.array([len(h[3]) for h in held], np.int64)
        one = lambda v, kind: pa.array([v], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [one([h[0] for h in held], pa.int64()), one([h[1] for h in held], pa.int64()), one([h[2] for h in held], pa.int64()), one(size.tolist(), pa.int64()), one((np.cumsum(size) - size).tolist(), pa.int32()), pa.array([np.concatenate([h[3] for h in held]).astype("<u2").tobytes()], pa.binary())],
            ["rows", "ids", "words", "features", "offsets", "stream"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        full = 0
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, n, buf, at in K.pieces(batch.column(2)):
                if n == 1 and len(buf) > K.PIECE:
                    parts = ((rows[i], ids[i], w, s) for w, s in _long_text(buf, orders, buckets))
                else:
                    crc, size, first = _text_words(buf, at)
                    stream, begin = run_buckets(crc, size, first, orders, buckets)
                    parts = [(rows[i + d], ids[i + d], int(first[d + 1] - first[d]), stream[begin[d] : begin[d + 1]]) for d in range(n)]
                for part in parts:
                    held.append(part)
                    full += len(part[3])
                    if full >= STREAM or len(held) >= STREAM >> 3:
                        yield emit(held)
                        held, full = [], 0
        if held:
            yield emit(held)

    return K.trimmed(run)


def _sort_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stream sorted and run-length encoded; the runs of a batch are put together."""
    for batch in batches:
        total = np.zeros(1 << 16, np.int64)
        for data in batch.column(0):
            s = np.sort(np.frombuffer(data.as_buffer(), "<u2"), kind="stable")  # a radix sort for 16 bits
            begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))
            total[s[begin]] += np.diff(np.append(begin, len(s)))
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(total[bucket])], ["bucket", "n"])


def _gather(shared):
    """Each document's sum of gains: one gather for a stream and one sum from offset to offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                lists = [np.asarray(c.flatten()) for c in (batch.column(j).slice(k, 1) for j in (0, 2, 3, 4))]
                rows, words, features, offsets = lists
                ids = batch.column(1).slice(k, 1).flatten()
                each = gain[np.frombuffer(batch.column(5)[k].as_buffer(), "<u2")]
                sums, some = np.zeros(len(rows), np.int64), np.flatnonzero(features)
                if len(some):
                    sums[some] = np.add.reduceat(each, offsets[some])
                yield pa.RecordBatch.from_arrays([pa.array(rows), ids, pa.array(words), pa.array(features), pa.array(sums)], ["row", "doc_id", "words", "n_features", "weight"])

    return K.trimmed(run)


def streams(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, id_column: str = "doc_id") -> DataFrame:
    """The table of packed bucket streams of all texts (null: no word). `rows` numbers the input rows."""
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_stream(orders, buckets), _FIELDS)


def bucket_counts(made: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket in a table of streams; what comes to the driver is a number for each bucket."""
    counts = np.zeros(buckets, np.int64)
    for r in made.select("stream").mapInArrow(_sort_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, the thousandfold log ratio of its smoothed shares in target and corpus, rounded down."""
    s, t, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float((b + 1) * (s + n)) / float((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED, tables: Scratch | None = None) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn.

    weight sums the gains of a document's runs of 1 to `orders` words. score adds Gumbel noise that the id and seed fix,
    so that the highest scores are a sample without replacement by exp(weight / 1000). Of the documents with at least
    `least_words` words, `percent` of a hundred (rounded down) are drawn; ties go to the smaller id (null last), rows
    that repeat id and score to the earlier row. A null text has no words; a null id has the noise of an empty one. Rows
    that repeat an id are documents each on their own. Without documents the result is empty; without a target all of
    its counts are 0. Other columns are not read. A text is held whole by one task, its words a part at a time.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")
    spark = docs.sparkSession
    scratch = tables or Scratch(spark, "importance")
    made = scratch.put(streams(docs, orders, buckets), "streams")
    aim = bucket_counts(streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders, buckets), buckets)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(made, buckets), aim))
    parts = made.mapInArrow(_gather(gain), "row long, doc_id long, words long, n_features long, weight long")
    whole = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("words", "n_features", "weight")))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.put(whole.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    fit = F.col("words") >= least_words
    many = scored.agg(F.count_if(fit)).first()[0] * percent // 100
    placed = ordinal(scored.filter(fit), [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row")], "rank", scratch)
    rank = F.when(F.col("rank") <= many, F.col("rank")).cast("long").alias("rank")
    keep = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*keep, rank).unionAll(scored.filter(~fit).select(*keep, F.lit(None).cast("long").alias("rank")))
