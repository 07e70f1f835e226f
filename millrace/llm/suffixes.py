"""Suffix arrays of many short byte strings at once, by induced sorting, and their permuted common prefixes.

The usual scans of induced sorting go through one suffix array from end to end. Here the strings of a shard are
independent, so every step handles some buckets of all strings together: those of a run of characters that induce nothing
among themselves, so that they are final when their turn comes, and what they induce goes, in order, to later buckets.
Array operations replace a loop over positions, and the steps are few both for bytes, of which there are few, and for the
reduced strings of the recursion, in which nearly every character is another.
"""

from __future__ import annotations

import numpy as np

TOGETHER = 64  # steps in which comparisons go on all at once; the few longer ones end one by one


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order and their positions, equal keys in order: one plain sort of key and position in a word."""
    bits = int(len(keys)).bit_length()
    packed = (keys.astype(np.int64) << bits) | np.arange(len(keys))
    packed.sort()
    return packed >> bits, packed & ((1 << bits) - 1)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending keys: where each run of equal ones begins, and the length of each."""
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return begin, np.diff(np.append(begin, len(keys)))


def _within(keys: np.ndarray) -> np.ndarray:
    """Running number of each entry among equal keys, in order."""
    k, order = _sorted(keys)
    begin, length = _runs(k)
    out = np.empty(len(k), np.int64)
    out[order] = np.arange(len(k)) - np.repeat(begin, length)
    return out


class _Buckets:
    """Buckets of (string, character), numbered in that order; a string's buckets are those from first[s] up to last[s]."""

    def __init__(self, text: np.ndarray, owner: np.ndarray):
        width = int(text.max(initial=0)) + 1
        keys, at = _sorted(owner.astype(np.int64) * width + text)
        begin, sizes = _runs(keys)
        self.of = np.empty(len(text), np.int32)
        self.of[at] = np.repeat(np.arange(len(begin), dtype=np.int32), sizes)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.first, many = _runs(keys[begin] // width)
        self.last = self.first + many


def _slices(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[k] .. start[k] + length[k] - 1."""
    keep = length > 0
    start, length = start[keep], length[keep]
    if not len(start):
        return np.zeros(0, np.int64)
    step = np.ones(int(length.sum()), np.int64)
    step[0] = start[0]
    step[np.cumsum(length)[:-1]] = start[1:] - start[:-1] - length[:-1] + 1
    return np.cumsum(step)


def _induce(b: _Buckets, small: np.ndarray, first: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array induced from leftmost-small suffixes in the given order. small: S-type positions; first: starts of strings.

    What a bucket induces into itself, a run of one character, comes in waves, one for each character of the run; as many
    waves as all runs of a wave still have characters are written at once.
    """
    n = len(small)
    sa = np.full(n, -1, np.int32)
    count = len(b.start) - 1
    in_s = np.bincount(b.of[small], minlength=count)
    size = np.diff(b.start)
    split = b.start[:-1] + size - in_s  # where S-type suffixes begin in a bucket
    placed = b.of[lms]
    seeds = np.bincount(placed, minlength=count)
    sa[b.start[1:][placed] - seeds[placed] + _within(placed)] = lms
    head = b.start[:-1].copy()
    fresh = np.append(True, b.of[1:] != b.of[:-1])[:n]
    behind = (np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))).astype(np.int32)  # equal characters before

    def put_large(source: np.ndarray) -> None:
        source = source[~first[source]] - 1
        source = source[~small[source]]
        to, order = _sorted(b.of[source])
        begin, length = _runs(to)
        to = to[begin]
        sa[np.arange(len(source)) + np.repeat(head[to] - begin, length)] = source[order]
        head[to] += length

    def steps(source: np.ndarray, length: np.ndarray, at: np.ndarray, way: int) -> int:
        """Waves after this one that only continue its runs, written from `at` of each bucket on, up or down."""
        m = int(behind[source].min())
        if m:
            begin = np.cumsum(length) - length
            place = np.repeat(at - way * begin, length) + way * np.arange(len(source))
            k = np.arange(m)[:, None]
            sa[place + way * k * np.repeat(length, length)] = source - 1 - k
        return m

    # A last suffix is L-type: what follows it, the end of its string, sorts before all.
    ends = np.flatnonzero(np.append(first[1:], True)) if n else np.zeros(0, np.int64)
    to = b.of[ends]
    sa[head[to]] = ends
    head[to] += 1

    def large_alone(now: np.ndarray) -> None:
        begin = b.start[:-1][now].copy()
        while True:
            length = head[now] - begin
            wave = _slices(begin, length)
            if not len(wave):
                break
            source = sa[wave]
            m = steps(source, length, head[now], 1)
            if m:
                head[now] += m * length
                begin = head[now] - length
            else:
                begin = head[now].copy()
                put_large(source)
        put_large(sa[_slices(b.start[1:][now] - seeds[now], seeds[now])])

    def large_in(now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _slices(*_pairwise(b.start[:-1][now], b.start[1:][now] - seeds[now], head[now] - b.start[:-1][now], seeds[now])), head[now] - b.start[:-1][now] + seeds[now]

    def large_to(source: np.ndarray) -> np.ndarray:
        before = source - 1
        return np.where(first[source] | small[before], count, b.of[before])

    _scan(b.first, b.last, sa, large_in, large_to, put_large, large_alone)
    tail = b.start[1:].copy()

    def put_small(source: np.ndarray) -> None:
        source = source[~first[source]] - 1
        source = source[small[source]]
        to, order = _sorted(b.of[source])
        begin, length = _runs(to)
        to = to[begin]
        sa[np.repeat(tail[to] - 1 + begin, length) - np.arange(len(source))] = source[order]
        tail[to] -= length

    def small_alone(now: np.ndarray) -> None:
        now = count - 1 - now
        end = b.start[1:][now].copy()
        while True:
            length = end - tail[now]
            wave = _slices(tail[now], length)
            if not len(wave):
                break
            source = sa[_backward(wave, length)]
            m = steps(source, length, tail[now] - 1, -1)
            if m:
                tail[now] -= m * length
                end = tail[now] + length
            else:
                end = tail[now].copy()
                put_small(source)
        large = split[now] - b.start[:-1][now]
        put_small(sa[_backward(_slices(b.start[:-1][now], large), large)])

    def small_in(now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        now = count - 1 - now
        done, large = b.start[1:][now] - tail[now], split[now] - b.start[:-1][now]
        begin, length = _pairwise(tail[now], b.start[:-1][now], done, large)
        return _backward(_slices(begin, length), length), done + large

    def small_to(source: np.ndarray) -> np.ndarray:
        before = source - 1
        return np.where(first[source] | ~small[before], count, count - 1 - b.of[before])

    # Backwards: buckets are numbered from the last.
    _scan(count - b.last[::-1], count - b.first[::-1], sa, small_in, small_to, put_small, small_alone)
    return sa


def _pairwise(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of two ranges of each bucket, one after the other."""
    return np.stack((a, b), axis=1).ravel(), np.stack((n, m), axis=1).ravel()


def _scan(first: np.ndarray, last: np.ndarray, sa: np.ndarray, entries, target, put, alone) -> None:
    """Every string's buckets in order, first[s] up to last[s]: as many at once as hold no suffix that induces one into a bucket among them. So what is known of them is all there is, and what they induce falls behind them in order.

    Of k buckets of random characters about k * k / (buckets left) entries induce into the run, so runs are about as
    long as the root of the buckets left. A bucket that induces into itself goes alone.
    """
    at, width = first.copy(), np.full(len(first), 4)
    live = np.flatnonzero(at < last)
    far = np.int64(1) << 40
    while len(live):
        most = np.minimum(width[live], last[live] - at[live])
        now = _slices(at[live], most)
        place, size = entries(now)
        source = sa[place]
        to = target(source).astype(np.int64)
        nearest = np.full(len(now), far)
        some = size > 0
        if len(to):
            nearest[some] = np.minimum.reduceat(to, (np.cumsum(size) - size)[some])
        # The nearest target of a bucket and those before it in its string: strings far apart, so that none sees another's.
        which = np.repeat(np.arange(len(live)), most)
        nearest = np.minimum.accumulate(nearest - which * (far + far)) + which * (far + far)
        good = nearest > now
        taken = np.add.reduceat(good.astype(np.int64), np.cumsum(most) - most)
        one = taken == 0
        keep = np.repeat(good, size)
        if keep.any():
            put(source if keep.all() else source[keep])
        if one.any():
            alone(at[live[one]])
        at[live] += np.maximum(taken, 1)
        width[live] = np.maximum(4, 2 * taken)
        live = live[at[live] < last[live]]


def _backward(wave: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The same ranges, each from its end to its start."""
    length = length[length > 0]
    ends = np.cumsum(length)
    return wave[np.repeat(ends - 1 + (ends - length), length) - np.arange(len(wave))] if len(wave) else wave


def suffix_array(text: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions of all suffixes, ordered by string and then by suffix; a string's end sorts before every character.

    text: characters as non-negative integers. owner: the string of each position, ascending.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    last = np.append(owner[1:] != owner[:-1], True)
    first = np.concatenate(([True], last[:-1]))
    nxt = np.append(text[1:], 0)
    nxt[last] = -1  # the end
    rel = np.sign(nxt - text)  # +1: the next is larger, so S-type; 0: as the next position
    at = np.where(rel == 0, n, np.arange(n))
    decided = np.minimum.accumulate(at[::-1])[::-1]
    small = rel[decided] > 0
    lms = np.flatnonzero(small & np.concatenate(([False], ~small[:-1])) & ~first)
    b = _Buckets(text, owner)
    if not len(lms):
        return _induce(b, small, first, lms)
    sa = _induce(b, small, first, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = sa[is_lms[sa]]  # leftmost-small substrings in order
    # Lengths up to and with the next leftmost-small position, or to the end of the string.
    ends = np.flatnonzero(last)
    following = np.append(lms[1:], n)
    stop = np.minimum(following, ends[owner[lms] if owner[-1] + 1 == len(ends) else np.searchsorted(ends, lms)])
    size = np.zeros(n, np.int64)
    size[lms] = stop - lms + 1
    to_end = np.zeros(n, bool)
    to_end[lms] = following > ends[np.searchsorted(ends, lms)]
    same = _equal_neighbours(text, owner, ranked, size, to_end)
    name = np.empty(n, np.int64)
    name[ranked] = np.cumsum(~same)
    reduced, red_owner = name[lms], owner[lms]
    new_string = np.concatenate(([True], red_owner[1:] != red_owner[:-1]))
    dense_owner = np.cumsum(new_string) - 1
    if same.any():
        heads = np.flatnonzero(new_string)
        base = np.minimum.reduceat(reduced, heads)
        order = lms[suffix_array(reduced - base[dense_owner], dense_owner)]
    else:
        order = ranked
    return _induce(b, small, first, order)


def _equal_neighbours(text: np.ndarray, owner: np.ndarray, ranked: np.ndarray, size: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """Whether each substring equals the one before it in order."""
    same = np.zeros(len(ranked), bool)
    if len(ranked) < 2:
        return same
    a, b = ranked[1:], ranked[:-1]
    live = np.flatnonzero((owner[a] == owner[b]) & (size[a] == size[b]) & (to_end[a] == to_end[b]))
    k = 0
    while len(live) and k < TOGETHER:
        live = live[text[a[live] + k] == text[b[live] + k]]
        k += 1
        done = size[a[live]] <= k
        same[live[done] + 1] = True
        live = live[~done]
    for i in live.tolist():  # few: all leftmost-small substrings together are about as long as the text
        m = int(size[a[i]])
        same[i + 1] = np.array_equal(text[a[i] + k : a[i] + m], text[b[i] + k : b[i] + m])
    return same


def common_prefixes(raw: np.ndarray, text: np.ndarray, sa: np.ndarray, owner: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Permuted: for each position, the bytes shared with the suffix before it in order, at most up to limit (the position where its own segment ends) of either. 0 for the first suffix of a string.

    Where the characters before a suffix and before its neighbour are equal, the positions before are neighbours too and
    share one character more: such a value is the one before it less 1. Only the others are found by comparison.
    """
    n = len(text)
    plcp = np.zeros(n, np.int64)
    if n < 2:
        return plcp
    near = owner[sa[1:]] == owner[sa[:-1]]
    before = np.full(n, -1, np.int64)
    before[sa[1:][near]] = sa[:-1][near]
    begins = np.append(True, limit[1:] != limit[:-1])
    carried = (before > 0) & ~begins
    at = np.flatnonzero(carried)
    carried[at] = (text[at - 1] == text[before[at] - 1]) & ~begins[before[at]]
    a = np.flatnonzero(~carried & (before >= 0))
    b = before[a]
    room = np.minimum(limit[a] - a, limit[b] - b)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(np.uint64).ravel()
    got, live = np.zeros(len(a), np.int64), np.flatnonzero(room > 0)
    for _ in range(TOGETHER):
        diff = words[a[live] + got[live]] ^ words[b[live] + got[live]]
        low = diff & (~diff + np.uint64(1))
        step = np.where(diff == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        got[live] += step
        live = live[(step == 8) & (got[live] < room[live])]
        if not len(live):
            break
    for i in live.tolist():  # the sum of all compared prefixes is bounded by n log n, so few are long
        x, y, k, most = int(a[i]), int(b[i]), int(got[i]), int(room[i])
        while k < most:
            m = min(4096, most - k)
            other = np.flatnonzero(raw[x + k : x + k + m] != raw[y + k : y + k + m])
            if len(other):
                k += int(other[0])
                break
            k += m
        got[i] = k
    plcp[a] = np.minimum(got, room)
    known = np.maximum.accumulate(np.where(carried, 0, np.arange(n)))
    return np.maximum(plcp[known] - (np.arange(n) - known), 0)
