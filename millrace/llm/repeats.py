"""Repeated passages by suffix arrays over shards of the corpus.

A string of LENGTH bytes that starts in two places holds, in both, the same least gram (by hash, leftmost): so the
corpus is cut into segments, runs of string starts with the same least gram hash, and the hash is the shard. Strings
that are equal are always in the same shard. Segments that are equal as a whole are settled by counting; of a shard's
different segments one copy each goes into a suffix array built by induced sorting, and a start is repeated if its
permuted common prefix with a neighbour reaches LENGTH. Shards whose different segments are more than SHARD bytes are cut again by
a longer gram, up to the whole string, at which equal shard means equal string; none is left out at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.shared import Scratch, marked
from millrace.llm.suffixes import common_prefixes, suffix_array

LENGTH, GRAM, SHARD, TEXT, LONG = 200, 48, 1 << 20, 1 << 19, 1 << 20  # SHARD, TEXT, LONG: bytes
TASK_BYTES, MOST_TASKS = 2 << 20, 1 << 15  # of text that a sorting task gets, and how many tasks there are at most
_SEG = "start int, n int, key long, body long, self boolean"


def gram_lengths(length: int, first: int = GRAM) -> tuple[int, ...]:
    """Each level's grams leave half as much of the string beside them as the level before; at the last a gram is the string. So a shard that a common gram made large falls apart at the first level whose grams go beyond what is common, into segments no shorter than need be."""
    out = [min(first, length)]
    while length - out[-1] > 24:
        out.append(length - (length - out[-1]) // 2)
    return (*out, length) if out[-1] < length else tuple(out)


def segments(buf: np.ndarray, at: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, ...]:
    """Starts, numbers of string starts, shard hashes, content hashes, and whether a segment has two least grams (only then can it repeat within itself). Texts follow each other in buf."""
    m = len(buf) - gram + 1
    window = length - gram + 1
    none = np.zeros(0, np.int64)
    if m < window:
        return none, none, none, none, none.astype(bool)
    sums = K.prefix(buf, K.BYTES)
    h = K.mix((sums[gram:] - sums[:m]) * K.powers(len(sums))[1][:m])
    bits = K.U(max(1, int(m).bit_length()))
    v = np.full(-(-m // window) * window, ~K.U(0))
    np.bitwise_or((h >> bits) << bits, np.arange(m, dtype=K.U), out=v[:m])
    grid = v.reshape(-1, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = m - window + 1
    least = np.minimum(back[:count], ahead[window - 1 : window - 1 + count])
    valid = np.ones(count + 1, bool)
    valid[count] = False
    for end in at[1:-1]:
        valid[max(0, end - length + 1) : end] = False
    pos = (least & ((K.U(1) << bits) - K.U(1))).astype(np.int64)
    key = h[pos]
    moved, changed = pos[1:] != pos[:-1], key[1:] != key[:-1]
    begin = valid[:count].copy()
    begin[1:] &= changed | ~valid[: count - 1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return none, none, none, none, none.astype(bool)
    stop = valid[:count].copy()
    stop[:-1] &= changed | ~valid[1:count]
    ends = np.flatnonzero(stop) + 1
    moves = np.concatenate(([0], np.cumsum(moved)))
    return starts, ends - starts, key[starts].view(np.int64), K.spans(sums, starts, ends + length - 1).view(np.int64), moves[ends - 1] > moves[starts]


def _windows(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place in the row) of runs of whole texts, and of parts of texts longer than LONG; parts overlap so that each string is in one. A segment that a cut divides is two of its shard."""
    for i, rows, buf, at in K.pieces(column):
        if rows > 1 or len(buf) <= LONG:
            yield i, buf, at, 0
            continue
        for begin in range(0, max(1, len(buf) - length + 1), LONG):
            part = buf[begin : begin + LONG + length - 1]
            yield i, part, np.array([0, len(part)]), begin


def _cut(gram: int, length: int, text: int):
    """Segments of the bytes in column `text`: a row's columns before it, the start added to the third of them if there is one, and those after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, buf, at, begin in _windows(batch.column(text), length):
                s, n, key, body, own = segments(buf, at, gram, length)
                d = np.searchsorted(at, s, "right") - 1
                take = pa.array(d + i)
                start = s - at[d] + begin
                if text > 2:
                    start = start + np.asarray(batch.column(2).take(take))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(body), pa.array(own), *(c.take(take) for c in batch.columns[text + 1 :])],
                    ["id", "th", "start", "n", "key", "body", "self", "copies"][: 7 + len(batch.columns) - text - 1],
                )

    return K.trimmed(run)


def _slice(length: int):
    """A document's text once, and the bytes of each segment that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, parts = (batch.column(k).to_pylist() for k in (0, 1, 3))
            rows = []
            for d in range(batch.num_rows):
                data = batch.column(2)[d].as_buffer()
                for p in parts[d]:
                    rows.append((ids[d], ths[d], p["start"], p["n"], p["key"], p["copies"], data[p["start"] : p["start"] + p["n"] + length - 1].to_pybytes()))
                if len(rows) >= 20_000:
                    yield _record(rows)
                    rows = []
            yield _record(rows)

    return K.trimmed(run)


_TEXTS = "id long, th long, start int, n int, key long, copies long, data binary"


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], ["id", "th", "start", "n", "key", "copies", "data"])


def repeated_starts(datas: list[bytes], shard: np.ndarray, length: int) -> np.ndarray:
    """For the concatenated segments, whether the string of that length at a position also starts elsewhere in its shard."""
    sizes = np.array([len(x) + 1 for x in datas])
    raw = np.frombuffer(b"\0".join(datas) + b"\0", np.uint8)
    text = raw.astype(np.int32) + 1
    ends = np.cumsum(sizes) - 1
    text[ends] = 0
    owner = np.repeat(shard.astype(np.int32), sizes)
    sa = suffix_array(text, owner)
    limit = np.repeat(ends, sizes)
    plcp = common_prefixes(raw, text, sa, owner, limit)
    hit = np.zeros(len(text), bool)
    near = plcp[sa] >= length
    hit[sa[near]] = True
    hit[sa[:-1][near[1:]]] = True
    return hit


def _sort_suffixes(length: int):
    """Rows arrive sorted by shard; whole shards are put together up to about TEXT bytes."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        key = np.array([r[4] for r in held])
        shard = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        hit = repeated_starts([r[6] for r in held], shard, length)
        at = np.concatenate(([0], np.cumsum([len(r[6]) + 1 for r in held])))
        out: list[list] = [[], [], [], []]
        edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for b, e, k in zip(begin.tolist(), end.tolist(), (np.searchsorted(at, begin, "right") - 1).tolist(), strict=True):
            if held[k][5] == 1:  # of several copies all is known to be repeated
                for col, v in zip(out, (held[k][0], held[k][1], held[k][2] + b - int(at[k]), e - b), strict=True):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["id", "th", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= TEXT and row[4] != held[-1][4]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield settle(held)

    return K.trimmed(run)


def _removed(length: int, with_text: bool):
    """Applies a document's repeated starts to its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, runs, digest, kept = [], [], [], [], []
            for data, parts in zip(batch.column(0), batch.column(1), strict=True):
                raw = np.frombuffer(data.as_buffer(), np.uint8) if data.is_valid and data.as_buffer().size else np.zeros(0, np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                if parts.is_valid:
                    starts, n = np.asarray(parts.values.field(0), np.int64), np.asarray(parts.values.field(1), np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + n + length - 1, -1)
                out = np.cumsum(edge)[:-1] > 0
                rest = raw[~out].tobytes()
                size.append(len(raw))
                gone.append(int(out.sum()))
                runs.append(int((np.diff(np.concatenate(([0], out.view(np.int8)))) == 1).sum()))
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore") if with_text else None)
            made = [pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())]
            rest = batch.columns[2:]
            yield pa.RecordBatch.from_arrays([*made, *rest], [*_MADE, *[f"c{k}" for k in range(len(rest))]])

    return K.trimmed(run)


_MADE = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
_OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _level(found: DataFrame, count: Column) -> DataFrame:
    """The segments of shards in which something can repeat; whole: the shard is several copies of one content."""
    shared = found.groupBy("key").agg(count.alias("c"), F.min("body").alias("lo"), F.max("body").alias("hi"), F.max("self").alias("own"))
    shared = shared.filter("c > 1 or own").select("key", (F.col("lo") == F.col("hi")).alias("one"), "c")
    hits = found.join(shared, "key").withColumn("whole", F.col("one") & (F.col("c") > 1))
    return hits


def repeated(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] | None = None, with_text: bool = False, carry: tuple[str, ...] = (), tables: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, without the bytes that a repeated string covers.

    A string of `length` bytes counts as repeated if it starts at another place too, in the same document or another,
    judged on the input. All copies go, the first included. Null and empty texts have 0 bytes and the digest of nothing.
    Repeated rows are copies like any others; rows with a null id take part. with_text adds kept_text, in which a
    character of which a part was removed is left out; carry names further columns to return. Others are not read. An empty table gives an empty one.
    """
    grams = grams or gram_lengths(length)
    scratch = tables or Scratch(docs.sparkSession, "repeats")
    data = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    # The id (a hash for a null one) and a hash of the text name what is repeated in it; rows that agree in both share it.
    named = [F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(data, F.lit(1))).alias("id"), F.xxhash64(data).alias("th"), data.alias("data")]
    base = docs.select(*named)
    found = scratch.put(base.mapInArrow(_cut(grams[0], length, 2), f"id long, th long, {_SEG}").withColumn("copies", F.lit(1).cast("long")), "segments")
    place = F.struct("id", "th", "start", "n")
    spans = None
    for level in range(len(grams)):
        hits = _level(found, F.sum("copies"))
        if level == len(grams) - 1:  # a shard is one string: what is in it is repeated, be it by itself
            hits = hits.withColumn("whole", F.lit(True))
        hits = scratch.put(hits, f"hits-{level}")
        scratch.drop(f"segments-{level}" if level else "segments")
        done = hits.filter("whole and copies = 1").select("id", "th", "start", "n")
        bodies = hits.filter("not whole").groupBy("key", "body").agg(F.sum("copies").alias("copies"), F.min(place).alias("at"))
        bodies = scratch.put(bodies, f"bodies-{level}")
        twice = bodies.filter("copies > 1").select("key", "body")
        done = done.unionAll(hits.filter("not whole and copies = 1").join(twice, ["key", "body"], "left_semi").select("id", "th", "start", "n"))
        spans = done if spans is None else spans.unionAll(done)
        if not bodies.take(1):
            break
        sizes = bodies.groupBy("key").agg(F.sum(F.col("at.n") + (length - 1)).alias("bytes"))
        parts = bodies.join(sizes, "key").select("key", "copies", "at.*", (F.col("bytes") > SHARD).alias("large"))
        parts = parts.groupBy("id", "th").agg(F.collect_list(F.struct("key", "copies", "start", "n", "large")).alias("parts"))  # of one text
        parts = scratch.put(parts, f"parts-{level}")
        small_bytes, large = parts.select(F.explode("parts").alias("p")).agg(F.sum(F.when(~F.col("p.large"), F.col("p.n") + (length - 1))), F.max("p.large")).first()
        texts = marked(base, parts, "id").filter("maybe").drop("maybe").join(parts, ["id", "th"]).groupBy("id", "th").agg(F.first("data").alias("data"), F.first("parts").alias("parts"))
        pick = lambda large: F.filter("parts", lambda p: p["large"] == F.lit(large))
        small = texts.select("id", "th", "data", pick(False).alias("parts")).filter(F.size("parts") > 0).mapInArrow(_slice(length), _TEXTS)
        tasks = max(1, min(MOST_TASKS, (small_bytes or 0) // TASK_BYTES))
        small = small.repartition(tasks, "key").sortWithinPartitions("key", "id", "th", "start")
        spans = spans.unionAll(scratch.put(small.mapInArrow(_sort_suffixes(length), "id long, th long, start int, n int"), f"sorted-{level}"))
        if not large:
            break
        nxt = grams[level + 1]  # there is one: at the last, a shard has one content
        rest = texts.select("id", "th", "data", pick(True).alias("parts")).filter(F.size("parts") > 0)
        pieces = rest.mapInArrow(_slice(length), _TEXTS).select("id", "th", "start", "data", "copies")
        found = scratch.put(pieces.mapInArrow(_cut(nxt, length, 3), f"id long, th long, {_SEG}, copies long"), f"segments-{level + 1}")
    marks = scratch.put(spans.groupBy("id", "th").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "marks")  # of one text
    scratch.drop(*(f"{t}-{k}" for t in ("hits", "bodies", "parts", "sorted", "segments") for k in range(len(grams))))
    names = [f"c{k}" for k in range(len(carry) + 1)]
    rest = [F.col("doc_id").cast("long").alias("c0"), *(F.col(c).alias(n) for c, n in zip(carry, names[1:], strict=True))]
    flagged = marked(docs.select(*named, *rest), marks, "id")
    types = "".join(f", {c} {t}" for c, t in flagged.select(*names).dtypes)
    touched = flagged.filter("maybe").join(marks, ["id", "th"], "left").select("data", "spans", *names).mapInArrow(_removed(length, with_text), _OUT + types)
    zero = F.lit(0).cast("long")
    text = F.col("data").cast("string") if with_text else F.lit(None).cast("string")
    whole = flagged.filter("not maybe").select(F.length("data").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"), text.alias("kept_text"), *names)
    out = touched.unionAll(whole)
    return out.select(F.col("c0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else []), *(F.col(n).alias(c) for c, n in zip(carry, names[1:], strict=True)))
