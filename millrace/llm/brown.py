"""Language-model scores from Brown classes.

Exchange clustering puts every training word that occurs MIN_COUNT times or more into one of CLASSES classes: a word moves
to the class that most raises the likelihood of the class bigrams. It runs in two parts. First the UNITS most frequent
words and SHAPES groups of all others (by length and last byte) move one by one, in turn, until a round moves none: these
are the classes to begin with. Then, SWEEPS times, one pass over the training texts counts the classes before and after
each word, each word's counts meet in a shuffle, and every word moves to its best class, all others as they are. Of the
assignments before and after each sweep the one of greatest likelihood stays, for moves made at once need not add up.
Words of fewer occurrences, and those never seen, have the class of their group.

A token's probability is the transition from the class before it times the word's share of its class, both smoothed by
adding HALF a count; a word never seen is one more word of its class. A text starts after an end.

Counts of words, words of a class, neighbours and class bigrams cover all training texts. What goes to the driver is
bounded: unit bigrams (UNITS + SHAPES + 1 squared), class bigrams, and at most TABLE frequent words, which also go to the
workers. Words beyond the table have counts and classes by a join with the words of each text; nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.shared import Scratch, crc_mod

UNITS, SHAPES, CLASSES, TABLE, HALF, ROUNDS, SWEEPS, MIN_COUNT = 1024, 64, 48, 1 << 18, 0.5, 8, 2, 4
PENDING, WORDS = 1 << 21, 512  # neighbours that a task counts at a time, and words that move at a time
END = np.uint64(0x5E0D5E0D5E0D5E0D)  # stands for the end in place of a word's hash
END_SHAPE = SHAPES
UNSET = 255  # in place of a class: that of the shape


def tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of the words of each text, an end after each text, and each text's first token."""
    h, starts, ends, first = K.word_hashes(buf, at)
    if len(starts):
        last = buf[ends - 1].astype(np.int64)
        last[(last >= 65) & (last <= 90)] += 32
        shape = (last * 7 & 15) * 4 + np.minimum((ends - starts - 1) // 3, 3)
    else:
        shape = np.zeros(0, np.int64)
    count = np.diff(first)
    begin = first + np.arange(len(first))
    hashes, shapes = np.empty(len(h) + len(count), K.U), np.empty(len(h) + len(count), np.int64)
    is_end = np.zeros(len(hashes), bool)
    is_end[begin[1:] - 1] = True
    hashes[is_end], shapes[is_end] = END, END_SHAPE
    hashes[~is_end], shapes[~is_end] = h, shape
    return hashes, shapes, begin


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often they occur, summed over PENDING tokens before they leave the task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    pending = 0

    def flush() -> pa.RecordBatch:
        h, shape = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        u, index, n = np.unique(h, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(shape[index].astype(np.int8)), pa.array(n)], ["h", "shape", "n"])

    for batch in batches:
        for _, _, buf, at in K.pieces(batch.column(0)):
            h, shape, _ = tokens(buf, at)
            held.append((h, shape.astype(np.int8)))
            pending += len(h)
            if pending >= PENDING:
                yield flush()
                held, pending = [], 0
    if pending:
        yield flush()


class Units:
    """Unit of each token: a frequent word's place, or the unit of its shape (the end has its own)."""

    def __init__(self, words: np.ndarray):
        self.sorted = np.sort(words)
        self.size = len(words) + SHAPES + 1

    def of(self, hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        n = len(self.sorted)
        if not n:
            return shapes
        at = np.minimum(np.searchsorted(self.sorted, hashes), n - 1)
        return np.where(self.sorted[at] == hashes, at, n + shapes)


def _pairs(units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = units.value
        total = np.zeros(u.size * u.size, np.int64)
        end = u.size - 1
        for batch in batches:
            for _, _, buf, at in K.pieces(batch.column(0)):
                h, shape, begin = tokens(buf, at)
                now = u.of(h, shape)
                before = np.concatenate(([end], now[:-1]))
                before[begin[:-1]] = end
                codes, n = np.unique(before * u.size + now, return_counts=True)
                total[codes] += n
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total[codes])], ["code", "n"])

    return K.trimmed(run)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit. The last unit (the end) has the last class alone; others start by frequency, in turn."""
    n = len(bigrams)
    freq = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-freq[:-1], kind="stable")
    of = np.full(n, classes - 1)
    of[order] = np.arange(n - 1) % max(1, classes - 1)
    if classes < 3:
        return of
    big = bigrams.astype(np.float64)
    one = np.eye(classes)[of]
    m = one.T @ big @ one
    free = classes - 1
    for _ in range(rounds):
        moves = 0
        for w in order:
            a = of[w]
            if not freq[w]:
                continue
            own = big[w, w]
            right, left = np.bincount(of, big[w], classes), np.bincount(of, big[:, w], classes)
            right[a] -= own
            left[a] -= own
            m[a] -= right
            m[:, a] -= left
            m[a, a] -= own
            rows, cols = m.sum(axis=1) + left, m.sum(axis=0) + right  # what meets the word counts there wherever it goes
            # What joining class b adds to the sum of pair counts times their logarithm, and takes in the margins.
            gain = (_xlogx(m + right[None, :]) - _xlogx(m)).sum(axis=1) + (_xlogx(m + left[:, None]) - _xlogx(m)).sum(axis=0)
            d = np.diag(m)
            gain += _xlogx(d + right + left + own) + _xlogx(d) - _xlogx(d + right) - _xlogx(d + left)
            out, into = right.sum() + own, left.sum() + own
            gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(cols + into) - _xlogx(cols)
            b = int(gain[:free].argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            m[b] += right
            m[:, b] += left
            m[b, b] += own
            of[w] = b
            moves += b != a
        if not moves:
            break
    return of


class Table:
    """Frequent words with their counts and, by sweep, classes; the class of each shape for all other words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, classes: np.ndarray, shapes: np.ndarray, size: int):
        order = np.argsort(words)
        self.words, self.counts, self.classes, self.shapes, self.size = words[order], counts[order], [classes[order]], shapes.astype(np.uint8), size

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return at, self.words[at] == hashes

    def classes_of(self, at: np.ndarray, found: np.ndarray, shapes: np.ndarray, sweep: int) -> np.ndarray:
        out = self.shapes[shapes]
        if len(self.words):
            own = self.classes[sweep][at]
            out = np.where(found & (own != UNSET), own, out)
        return out.astype(np.int64)


_CONTEXT = "pair boolean, h long, n long, data binary"
_ENTRY = np.dtype([("code", np.uint8), ("n", "<u2")])  # of a word's data, after a byte with its class; a greater number is several entries


class _Often:
    """Bitmap of the words beyond the table that occur MIN_COUNT times or more: a few too many pass, none is missing."""

    BITS = 24

    def __init__(self, words: DataFrame):
        bit = F.col("h").bitwiseAND(F.lit((1 << self.BITS) - 1))
        rows = words.select(F.shiftright(bit, 6).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("mask")).groupBy("at").agg(F.bit_or("mask").alias("mask"))
        got = rows.toPandas()  # 2 ** (BITS - 6) rows at most
        self.bits = np.zeros(1 << (self.BITS - 6), np.int64)
        self.bits[got["at"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64)

    def may(self, h: np.ndarray) -> np.ndarray:
        bit = (h & K.U((1 << self.BITS) - 1)).astype(np.int64)
        return (self.bits[bit >> 6] >> (bit & 63)) & 1 == 1


def _neighbours(shared, sweep: int, often):
    """For each word that moves: its class, how often each class comes after it (codes 0 ..), before it (codes `size` ..), and it after itself (code 2 * size); and the class bigrams (pair is true, h is 'before * size + after'). often: for words beyond the table, if any of them move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        size, width = t.size, 2 * t.size + 1
        total = np.zeros(size * size, np.int64)
        held: list[tuple] = []
        pending = 0

        def flush() -> pa.RecordBatch:
            h, index, cls, code = (np.concatenate([x[k] for x in held]) for k in range(4))
            out = np.flatnonzero(index < 0)  # words beyond the table are numbered after it
            more, number = np.unique(h[out], return_inverse=True)
            index[out] = len(t.words) + number
            names = np.concatenate((t.words, more))
            key, n = np.unique(index * width + code, return_counts=True)
            of = key // width
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            word = of[first]
            class_of = np.zeros(len(names), np.int8)
            class_of[index] = cls
            times = -(-n // 65535)  # entries that hold the number
            entries = np.empty(int(times.sum()), _ENTRY)
            entries["code"] = np.repeat(key % width, times)
            entries["n"] = 65535
            last = np.cumsum(times) - 1
            entries["n"][last] = n - 65535 * (times - 1)
            size_of = np.diff(np.append(last[first] - times[first] + 1, len(entries))) * _ENTRY.itemsize + 1
            edge = np.concatenate(([0], np.cumsum(size_of)))
            data, inside = np.empty(edge[-1], np.uint8), np.ones(edge[-1], bool)
            inside[edge[:-1]] = False
            data[edge[:-1]], data[inside] = class_of[word], entries.view(np.uint8)
            packed = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(word), bool)), pa.array(names[word].view(np.int64)), pa.array(np.zeros(len(word), np.int64)), packed], names=_names(_CONTEXT))

        for batch in batches:
            for _, _, buf, at in K.pieces(batch.column(0)):
                h, shape, begin = tokens(buf, at)
                place, found = t.find(h)
                now = t.classes_of(place, found, shape, sweep)
                before, start = np.concatenate(([size - 1], now[:-1])), np.zeros(len(h), bool)
                start[begin[:-1]] = True
                before[start] = size - 1
                total += np.bincount(before * size + now, minlength=size * size)
                itself = np.concatenate(([False], (h[1:] == h[:-1]) & ~start[1:]))
                moving = shape != END_SHAPE
                if len(t.words):
                    moving &= np.where(found, t.counts[place] >= MIN_COUNT, often.value.may(h) if often else False)
                here = np.flatnonzero(moving)
                index = np.where(found, place, -1)
                held.append((h[here], index[here], now[here], np.where(itself[here], 2 * size, size + before[here])))
                ahead = np.flatnonzero(moving[:-1] & ~itself[1:])  # an end comes after every word, so each has a next token
                held.append((h[ahead], index[ahead], now[ahead], now[ahead + 1]))
                pending += len(here) + len(ahead)
                if pending >= PENDING:
                    yield flush()
                    held, pending = [], 0
        if pending:
            yield flush()
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(code), bool)), pa.array(code), pa.array(total[code]), pa.array([b""] * len(code), pa.binary())], names=_names(_CONTEXT))

    return K.trimmed(run)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def gains(m: np.ndarray, a: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each word, of class a, and each class: the sum of x log x of class bigrams less those of the margins once it is there, up to a constant of the word.

    right and left: counts of the classes after and before the word, without those of itself (own). Only the classes that
    a word meets change, so the work is as large as its neighbours are many.
    """
    words, size = right.shape
    each = np.arange(words)
    out = np.zeros((words, size))
    for mine, other, matrix in ((right, left, m), (left, right, m.T)):
        w, c = np.nonzero(mine)
        if not len(w):
            continue
        x = matrix.T[c].copy()  # over classes: their count with class c on this side, without the word
        k = np.arange(len(w))
        x[k, a[w]] -= mine[w, c]
        same = np.flatnonzero(c == a[w])
        x[same] -= other[w[same]]
        x[same, a[w[same]]] -= own[w[same]]
        more = _xlogx(x + mine[w, c][:, None]) - _xlogx(x)
        begin = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        out[w[begin]] += np.add.reduceat(more, begin, axis=0)
    d = np.repeat(np.diag(m)[None, :], words, axis=0)
    d[each, a] -= right[each, a] + left[each, a] + own
    out += _xlogx(d + right + left + own[:, None]) + _xlogx(d) - _xlogx(d + right) - _xlogx(d + left)
    for mine, margin in ((right, m.sum(axis=1)), (left, m.sum(axis=0))):
        rest, sum_ = np.repeat(margin[None, :], words, axis=0), mine.sum(axis=1) + own
        rest[each, a] -= sum_
        out -= _xlogx(rest + sum_[:, None]) - _xlogx(rest)
    return out


def _moved(m: np.ndarray):
    """Rows (h, data) arrive sorted by word; each word of MIN_COUNT tokens or more gets its best class (the last one is the end's alone)."""
    size = len(m)
    width = 2 * size + 1

    def settle(h: np.ndarray, a: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        enough = v[:, size:].sum(axis=1) >= MIN_COUNT  # each token has one before it
        h, v, a = h[enough], v[enough].astype(np.float64), a[enough]
        gain = gains(m, a, v[:, :size], v[:, size : 2 * size], v[:, -1])[:, : max(1, size - 1)]
        best = gain.argmax(axis=1)
        best = np.where(gain[np.arange(len(a)), best] > gain[np.arange(len(a)), a] + 1e-9, best, a)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(best.astype(np.int16))], names=["h", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, a, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64)  # the last word is not yet complete
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, column = np.asarray(batch.column(0)), batch.column(1).cast(pa.large_binary())
            at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
            heads = at[:-1] - at[0]
            inside = np.ones(len(raw), bool)
            inside[heads] = False
            entries = raw[inside].view(_ENTRY)
            new = np.append(len(h) == 0 or keys[0] != h[-1], keys[1:] != keys[:-1])
            word = np.cumsum(new) + len(h) - 1
            begun = np.flatnonzero(new)
            h, a = np.append(h, keys[begun]), np.append(a, raw[heads[begun]].astype(np.int64))
            v = np.vstack((v, np.zeros((len(begun), width), np.int64)))
            low = word[0]
            place = np.repeat(word - low, (np.diff(at) - 1) // _ENTRY.itemsize) * width + entries["code"]
            v[low:] += np.bincount(place, entries["n"], (len(h) - low) * width).astype(np.int64).reshape(-1, width)
            if len(h) > WORDS:
                yield settle(h[:-1], a[:-1], v[:-1])
                h, a, v = h[-1:], a[-1:], v[-1:].copy()
        if len(h):
            yield settle(h, a, v)

    return K.trimmed(run)


class _Known:
    """Classes by sweep of the words beyond the table that a batch of texts holds."""

    def __init__(self, column: pa.Array):
        flat = column.flatten()
        self.h, first = np.unique(np.asarray(flat.field("h"), np.int64).view(np.uint64), return_index=True)
        self.classes = [np.asarray(x, np.int16)[first] for x in (flat.field(k) for k in range(1, flat.type.num_fields))]

    def find(self, hashes: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that are not in the table but known, and the place of each."""
        out = np.flatnonzero(~found)
        if not len(self.h):
            return out[:0], out[:0]
        at = np.minimum(np.searchsorted(self.h, hashes[out]), len(self.h) - 1)
        hit = self.h[at] == hashes[out]
        return out[hit], at[hit]

    def apply(self, cls: np.ndarray, known: tuple[np.ndarray, np.ndarray], sweep: int) -> np.ndarray:
        if sweep:
            cls[known[0]] = self.classes[sweep - 1][known[1]]
        return cls


def _bigrams(shared, sweeps: int):
    """Class bigrams of every assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        total = np.zeros((sweeps, t.size * t.size), np.int64)
        for batch in batches:
            known = _Known(batch.column(1))
            for _, _, buf, at in K.pieces(batch.column(0)):
                h, shape, begin = tokens(buf, at)
                place, found = t.find(h)
                beyond = known.find(h, found)
                for k in range(sweeps):
                    now = known.apply(t.classes_of(place, found, shape, k), beyond, k)
                    before = np.concatenate(([t.size - 1], now[:-1]))
                    before[begin[:-1]] = t.size - 1
                    total[k] += np.bincount(before * t.size + now, minlength=t.size * t.size)
        k, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(total[k, code])], names=["sweep", "code", "n"])

    return K.trimmed(run)


class Model:
    """What a worker needs: the table, the assignment that stays, transitions, and the weight of each class."""

    def __init__(self, table: Table, sweep: int, bigrams: np.ndarray, types: np.ndarray):
        self.table, self.sweep = table, sweep
        self.step = np.log10((bigrams + HALF) / (bigrams.sum(axis=1, keepdims=True) + HALF * table.size))
        self.weight = np.log10(bigrams.sum(axis=0) + HALF * (types + 1))


def likelihood(m: np.ndarray) -> float:
    """Of class bigrams, up to what does not depend on the classes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


_LISTED = "row long, doc_id long, held_out boolean, text string, rare array<struct<h:long,tf:int>>"


def _rare_words(h: np.ndarray, found: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Of each text, the words beyond the table and how often it has each."""
    rows = len(begin) - 1
    doc = np.repeat(np.arange(rows), np.diff(begin))
    rare_doc, rare_h = doc[~found], h[~found]
    order = np.lexsort((rare_h, rare_doc))
    rare_doc, rare_h = rare_doc[order], rare_h[order]
    new = np.concatenate(([True], (rare_doc[1:] != rare_doc[:-1]) | (rare_h[1:] != rare_h[:-1]))) if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    tf = np.diff(np.append(starts, len(order))).astype(np.int32)
    offsets = np.searchsorted(rare_doc[starts], np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(rare_h[starts].view(np.int64)), pa.array(tf)], ["h", "tf"]))


def _list(shared):
    """Texts with a number and their words beyond the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, rows, buf, at in K.pieces(batch.column(2)):
                h, _, begin = tokens(buf, at)
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(rows)), *(c.slice(i, rows) for c in batch.columns), _rare_words(h, t.find(h)[1], begin)], names=_names("row long, doc_id long, held_out boolean, text string, rare array"))
                row += rows

    return K.trimmed(run)


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, part double, steps double, rare array<struct<h:long,tf:int>>, more long, gain double"


def _score(model, rare: bool):
    """Per text: tokens, those in the table, sum of log10(count + 1/2) of these, sum of transitions less class weights, and (rare) the other words with their numbers; what is known of these passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = model.value, TaskContext.get().partitionId() << 40
        t = m.table
        logs = np.log10(t.counts + HALF)
        for batch in batches:
            known = _Known(batch.column(3))
            for i, rows, buf, at in K.pieces(batch.column(2)):
                h, shape, begin = tokens(buf, at)
                place, found = t.find(h)
                cls = known.apply(t.classes_of(place, found, shape, m.sweep), known.find(h, found), m.sweep)
                before = np.concatenate(([t.size - 1], cls[:-1]))
                before[begin[:-1]] = t.size - 1
                steps = np.add.reduceat(m.step[before, cls] - m.weight[cls], begin[:-1])
                part = np.add.reduceat(np.where(found, logs[place], 0.0), begin[:-1]) if len(t.words) else np.zeros(rows)
                others = _rare_words(h, found | (not rare), begin)
                cut = [c.slice(i, rows) for c in batch.columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(rows)), cut[0], cut[1], pa.array(np.diff(begin)), pa.array(np.add.reduceat(found.astype(np.int64), begin[:-1])), pa.array(part), pa.array(steps), others, cut[4], cut[5]],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "part", "steps", "rare", "more", "gain"],
                )
                row += rows

    return K.trimmed(run)


def _matrix(rows, size: int) -> np.ndarray:
    out = np.zeros(size * size)
    out[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out.reshape(size, size)


def _swept(train: DataFrame, table: Table, begin: np.ndarray, counts: DataFrame, least: int, beyond: bool, scratch: Scratch) -> list[DataFrame]:
    """(h, class) of every word that moves, after each sweep; the table's classes are set too. begin: class bigrams before the first, which need no counting."""
    spark, out = train.sparkSession, []
    often = spark.sparkContext.broadcast(_Often(counts.filter((F.col("n") < least) & (F.col("n") >= MIN_COUNT)))) if beyond else None
    for k in range(SWEEPS):
        context, m = train.mapInArrow(_neighbours(spark.sparkContext.broadcast(table), k, often), _CONTEXT), begin
        if k:
            context = scratch.put(context, f"context-{k}")
            m = _matrix(context.filter("pair").groupBy(F.col("h").alias("code")).agg(F.sum("n").alias("n")).toPandas(), table.size)  # classes squared
        words = context.filter("not pair").select("h", "data").repartition("h").sortWithinPartitions("h")
        moved = scratch.put(words.mapInArrow(_moved(m), "h long, class short"), f"moved-{k}")
        scratch.drop(f"context-{k}")
        frequent = moved.join(counts.filter(F.col("n") >= least).select("h"), "h", "left_semi") if beyond else moved
        got = frequent.toPandas()  # TABLE rows at most
        classes = np.full(len(table.words), UNSET, np.uint8)
        at, found = table.find(got["h"].to_numpy(np.int64).view(np.uint64))
        classes[at[found]] = got["class"].to_numpy(np.uint8)[found]
        table.classes.append(classes)
        out.append(moved)
    return out


def class_scores(docs: DataFrame, folds: int = 5, held: int = 1, tables: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10), perplexity of every document.

    Documents whose crc32(doc_id as text) modulo `folds` is `held` do not train; a null id trains. Null and empty texts
    are an end alone. Repeated rows count, and are scored, each on their own. With nothing to train on, counts are 0 and
    all words are unknown. Only doc_id and text are read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    scratch = tables or Scratch(spark, "brown")
    out = F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    train = docs.filter("not held_out").select("text")
    counts = train.mapInArrow(K.trimmed(_count), "h long, shape byte, n long").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))
    counts = scratch.put(counts, "counts")
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toPandas()  # distinct counts: some root of the tokens
    total, vocabulary = int((by_count["n"] * by_count["words"]).sum()), int(by_count["words"].sum())
    fits = by_count[by_count["words"].cumsum() <= TABLE]
    least = int(fits["n"].min()) if len(fits) else 1 << 62
    top = counts.filter(F.col("n") >= least).toPandas().sort_values(["n", "h"], ascending=[False, True])  # TABLE rows at most
    half = float(np.log10(HALF))
    beyond = bool(((by_count["n"] >= MIN_COUNT) & (by_count["n"] < least)).any())
    words = top["h"].to_numpy(np.int64).view(np.uint64)
    units = Units(words[words != END][:UNITS])
    pairs = train.mapInArrow(_pairs(share(units)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    size = min(CLASSES, units.size)
    bigrams = _matrix(pairs, units.size)
    of = exchange(bigrams, size)
    begin = np.full(len(words), UNSET, np.uint8)
    if len(units.sorted):
        at = np.minimum(np.searchsorted(units.sorted, words), len(units.sorted) - 1)
        begin = np.where(units.sorted[at] == words, of[at], UNSET).astype(np.uint8)
    table = Table(words, top["n"].to_numpy(), begin, of[len(units.sorted) :], size)
    moved = _swept(train, table, np.eye(size)[of].T @ bigrams @ np.eye(size)[of], counts, least, beyond, scratch)
    classes = "array<struct<h:long" + "".join(f",c{k + 1}:short" for k in range(SWEEPS)) + ">>"
    rest = counts.filter(F.col("n") < least).select("h", "n")
    gained = (F.sum("tf").alias("more"), F.sum(F.col("tf") * (F.log10(F.col("n") + HALF) - F.lit(half))).alias("gain"))
    given = docs.select("doc_id", "held_out", "text", F.array().cast(classes).alias("known"), F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("gain"))
    if beyond:  # texts meet the counts and classes of their words beyond the table
        for k, m in enumerate(moved):
            rest = rest.join(m.select("h", F.col("class").alias(f"c{k + 1}")), "h", "left")
        listed = scratch.put(docs.mapInArrow(_list(share(table)), _LISTED), "listed")
        own = F.collect_list(F.when(F.col("c1").isNotNull(), F.struct("h", *(f"c{k + 1}" for k in range(SWEEPS)))))  # of one text
        met = listed.select("row", F.explode("rare").alias("w")).select("row", "w.h", "w.tf").join(rest, "h").groupBy("row").agg(own.alias("known"), *gained)
        met = listed.drop("rare").join(met, "row", "left")
        given = scratch.put(met.select("doc_id", "held_out", "text", F.coalesce("known", F.array().cast(classes)).alias("known"), F.coalesce("more", F.lit(0)).cast("long").alias("more"), F.coalesce("gain", F.lit(0.0)).alias("gain")), "given")
        scratch.drop("listed")
    bigrams = given.filter("not held_out").select("text", "known").mapInArrow(_bigrams(share(table), SWEEPS + 1), "sweep int, code int, n long").groupBy("sweep", "code").agg(F.sum("n").alias("n")).toPandas()
    matrices = [_matrix(bigrams[bigrams["sweep"] == k], size) for k in range(SWEEPS + 1)]
    sweep = int(np.argmax([likelihood(m) for m in matrices]))
    model = Model(table, sweep, matrices[sweep], _types(counts, table, moved[sweep - 1] if sweep else None, top))
    scored = scratch.put(given.mapInArrow(_score(share(model), not beyond), _SCORED), "scored")
    everything = scored
    if not beyond:
        seen = scored.select("row", F.explode("rare").alias("w")).select("row", "w.h", "w.tf").join(rest, "h").groupBy("row").agg(*gained)
        everything = scored.drop("rare", "more", "gain").join(seen, "row", "left")
    # Words in neither table nor join have a count of 0, so log10(1/2) each.
    logs = F.col("part") + (F.col("n_tokens") - F.col("known")) * F.lit(half) + F.coalesce("gain", F.lit(0.0))
    mass = float(np.log10(total + HALF * (vocabulary + 1)))
    return everything.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(mass)).alias("base_score"), (logs + F.col("steps")).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _types(counts: DataFrame, table: Table, moved: DataFrame | None, top: pd.DataFrame) -> np.ndarray:
    """Distinct training words of each class. Those of a group are counted in Spark, and words with a class of their own taken from them."""
    types, group = np.zeros(table.size), table.shapes.astype(np.int64)
    kinds = counts.groupBy("shape").agg(F.count("*").alias("words")).toPandas()  # a row of each shape
    np.add.at(types, group[kinds["shape"].to_numpy(np.int64)], kinds["words"].to_numpy(np.float64))
    if moved is None:
        own = top.sort_values("h", key=lambda h: h.to_numpy().view(np.uint64)).assign(**{"class": table.classes[0], "words": 1})
        own = own[own["class"] != UNSET]
    else:
        own = moved.join(counts.select("h", "shape"), "h").groupBy("shape", "class").agg(F.count("*").alias("words")).toPandas()  # shapes times classes
    np.subtract.at(types, group[own["shape"].to_numpy(np.int64)], own["words"].to_numpy(np.float64))
    np.add.at(types, own["class"].to_numpy(np.int64), own["words"].to_numpy(np.float64))
    return types
