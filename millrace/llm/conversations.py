"""Repair of conversation structure: damaged turns are found, and the cheapest edits that give a well-formed order of roles.

A conversation is well formed if its roles' initials are `(s?(ua)+)?`. Four states say how far one is: nothing yet, after
the system turn, after a user turn, after an assistant turn. The costs of finishing a conversation from each state, before
each turn, come from its last turn backwards, for all conversations of about one length at once: one step of array
operations for each turn, over a tensor of turns, conversations and states. Edits are then traced forward, again one step for
all conversations, by choosing the first edit in ASCII order that keeps to the stored costs; each leads to one state, so
the whole string of edits is the least of the cheapest.

Turns come to the costs as a byte each (initial and fault), in the order of their conversation, not as texts. The texts
are sent once more, behind the edits of their conversation, and go through a running digest: no conversation's text is
ever held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.shared import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 40
TOGETHER = 1 << 18  # turns of conversations whose costs are computed at once, or one conversation if it is longer
SYSTEM, USER, ASSISTANT, OTHER = range(4)
BLANK, DUPLICATE, CUT = 1, 2, 3
SPACES = " \t\n\x0b\x0c\r"
#: Where a turn of each role leads from: nothing yet, a system turn, a user turn, an assistant turn; -1: nowhere.
LEADS = {SYSTEM: (1, -1, -1, -1), USER: (2, 2, -1, 2), ASSISTANT: (-1, -1, 3, -1), OTHER: (-1,) * 4}
FORCED = np.array([USER, USER, ASSISTANT, USER])  # the role that an inserted or renamed turn must have in each state
AFTER = np.array([2, 2, 3, 2])
_LEADS = np.array([LEADS[k] for k in range(4)])
_EDITS = np.frombuffer(b"DIKR", np.uint8)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that are left, and `lost` rows (of which only conv_id matters), after damage by a hash of id and turn. Nulls of any column count as one space in the hash, a null role or text as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"), (kind == 0).alias("lost"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def _tie() -> Column:
    return F.xxhash64("text")


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place (0 for lost rows), initial, fault of damaged rows; texts stay behind."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    thin = rows.select("conv_id", "turn", "lost", "role", role.alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?", "")).alias("cut"), _tie().alias("tie"), F.md5("text").alias("same"))
    thin = thin.repartition("conv_id")
    by_turn = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    seen = F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "same").orderBy(F.col("turn").asc_nulls_first()))
    place = F.row_number().over(Window.partitionBy("conv_id", "lost").orderBy(*by_turn, F.col("same")))
    fault = F.when(F.col("blank"), BLANK).when(F.col("seen") > 1, DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    out = thin.withColumn("seen", seen).withColumn("place", F.when(F.col("lost"), 0).otherwise(place))
    return out.select("conv_id", "turn", "place", F.col("initial").cast("tinyint").alias("initial"), fault.cast("tinyint").alias("fault"))


def costs_backward(initial: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """(turns + 1, conversations, states): the cost of finishing from before each turn. initial, fault: (turns, conversations); initial -1 where a conversation has ended."""
    turns, n = initial.shape
    out = np.empty((turns + 1, n, 4), np.int64)
    out[turns] = _inserted(np.tile(np.array([0, NEVER, NEVER, 0]), (n, 1)))
    for t in range(turns - 1, -1, -1):
        nxt, who = out[t + 1], initial[t]
        best = nxt + DELETE
        stays = fault[t] != BLANK
        stays &= fault[t] != DUPLICATE
        more = np.where(stays, np.where(fault[t] == CUT, TRUNCATED, 0), NEVER)[:, None]
        lead = _LEADS[who]  # -1 rows are read as OTHER's, which do not matter
        kept = np.where(lead >= 0, np.take_along_axis(nxt, np.maximum(lead, 0), axis=1), NEVER) + KEEP + more
        renamed = nxt[:, AFTER] + REROLE + more
        best = np.minimum(best, np.minimum(kept, renamed))
        out[t] = np.where((who < 0)[:, None], nxt, _inserted(np.minimum(best, NEVER)))
    return out


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Costs if turns may be inserted before: at most two help, for any state is then back where it was."""
    for _ in range(2):
        cost = np.minimum(cost, cost[:, AFTER] + INSERT)
    return cost


def traced(initial: np.ndarray, fault: np.ndarray, cost: np.ndarray) -> list[bytes]:
    """The least string of cheapest edits of each conversation, in ASCII order."""
    turns, n = initial.shape
    length = (initial >= 0).sum(axis=0)
    at, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out: list[list[np.ndarray]] = []
    live = np.arange(n)
    while len(live):
        t, s = at[live], state[live]
        now = cost[t, live, s]
        more = t < length[live]
        u = np.minimum(t, max(turns - 1, 0))
        nxt = cost[np.minimum(t + 1, turns), live]
        who = np.where(more, initial[u, live], OTHER) if turns else np.full(len(live), OTHER)
        bad = fault[u, live] if turns else np.zeros(len(live), np.int64)
        extra = np.where((bad == BLANK) | (bad == DUPLICATE), NEVER, np.where(bad == CUT, TRUNCATED, 0))
        lead, row = _LEADS[who, s], np.arange(len(live))
        delete = more & (nxt[row, s] + DELETE == now)
        insert = cost[t, live, AFTER[s]] + INSERT == now
        keep = more & (lead >= 0) & (nxt[row, np.maximum(lead, 0)] + KEEP + extra == now)
        rerole = more & (nxt[row, AFTER[s]] + REROLE + extra == now)
        edit = np.where(delete, 0, np.where(insert, 1, np.where(keep, 2, np.where(rerole, 3, 4))))
        state[live] = np.where(edit == 0, s, np.where(edit == 2, np.maximum(lead, 0), np.where(edit == 4, s, AFTER[s])))
        at[live] += (edit != 1) & (edit != 4)
        going = edit < 4  # nothing is left to do: the end
        out.append((live[going], _EDITS[edit[going]]))
        live = live[going]
    who = np.concatenate([w for w, _ in out]) if out else np.zeros(0, np.int64)
    what = np.concatenate([e for _, e in out]) if out else np.zeros(0, np.uint8)
    order = np.argsort(who, kind="stable")
    ends = np.cumsum(np.bincount(who, minlength=n))
    text = what[order].tobytes()
    return [text[e - m : e] for e, m in zip(ends.tolist(), np.diff(np.append(0, ends)).tolist(), strict=True)]


def repaired(conversations: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(cost, edits) of conversations, each an array of initial * 4 + fault by turn. Those of like length are in one tensor."""
    size = np.array([len(c) for c in conversations], np.int64)
    out: list = [None] * len(size)
    bucket = np.zeros(len(size), np.int64)
    big = size > 0
    bucket[big] = np.ceil(np.log2(size[big]) * 4).astype(np.int64) + 1  # steps of a fourth of an octave
    for b in np.unique(bucket):
        here = np.flatnonzero(bucket == b)
        turns = int(size[here].max())
        for k in range(0, len(here), step := max(1, TOGETHER // max(1, turns))):
            part = here[k : k + step]
            tensor = np.full((turns, len(part)), -4, np.int8)
            for j, i in enumerate(part):
                tensor[: size[i], j] = conversations[i]
            initial, fault = tensor >> 2, tensor & 3
            cost = costs_backward(initial, fault)
            for i, edits, c in zip(part, traced(initial, fault, cost), cost[0, :, 0].tolist(), strict=True):
                out[i] = (c, edits)
    return out


_FOUND = "conv_id long, edits string, cost long, blank long, duplicate long, truncated long, illegal long, gaps long"
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, place, initial, fault) arrive by conversation and place, lost ones first; a row for each conversation goes out."""
    held: list[tuple[int | None, np.ndarray, int]] = []
    now: list = []
    count = 0

    def close() -> None:
        turns, codes = [p[0] for p in now], np.concatenate([p[1] for p in now])
        distinct = sum(p[2] for p in now)
        lo, hi = min((t[0] for t in turns if len(t)), default=None), max((t[-1] for t in turns if len(t)), default=None)
        held.append((now_id[0], codes, int(hi) - int(lo) + 1 - distinct if lo is not None else 0))

    def settle() -> pa.RecordBatch:
        codes = [h[1] for h in held]
        fixed = repaired(codes)
        count_of = lambda f: [int((c & 3 == f).sum()) for c in codes]
        illegal = [int((~_LEGAL[c[:-1] >> 2, c[1:] >> 2]).sum()) for c in codes]
        cols = [[h[0] for h in held], [e.decode() for _, e in fixed], [c for c, _ in fixed], count_of(BLANK), count_of(DUPLICATE), count_of(CUT), illegal, [h[2] for h in held]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(cols)], [x.split()[0] for x in _FOUND.split(", ")])

    now_id: list = [None]
    last_turn: int | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, turn = batch.column(0), batch.column(1)
        cid, cnull = np.asarray(conv.fill_null(0)), np.asarray(conv.is_null())
        tid, tnull = np.asarray(turn.fill_null(0)), np.asarray(turn.is_null())
        place, code = np.asarray(batch.column(2)), (np.asarray(batch.column(3)) << 2 | np.asarray(batch.column(4))).astype(np.int8)
        cuts = np.flatnonzero((cid[1:] != cid[:-1]) | (cnull[1:] != cnull[:-1])) + 1
        for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cid)], strict=True):
            who = None if cnull[b] else int(cid[b])
            if not now or now_id[0] != who:
                if now:
                    close()
                    if count >= TOGETHER:
                        yield settle()
                        held.clear()
                        count = 0
                now, now_id[0], last_turn = [], who, None
            there = place[b:e] > 0
            turns = tid[b:e][there & ~tnull[b:e]]
            new = int((turns[1:] != turns[:-1]).sum()) + int(len(turns) > 0 and turns[0] != last_turn)
            last_turn = int(turns[-1]) if len(turns) else last_turn
            ends = turns[[0, -1]] if len(turns) else turns
            now.append((ends, code[b:e][there], new))
            count += e - b
    if now:
        close()
    if held:
        yield settle()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, edits, role, text) arrive by conversation, its edits first and then its turns in order: the digest of what the edits make of them."""
    ids: list = []
    digests: list[str] = []
    state: dict = {}

    def put(role: str, text: str) -> None:
        state["sha"].update((("\n" if state["any"] else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        state["any"], state["made"] = True, state["made"] + 1

    def forced() -> str:
        return "assistant" if state["last"] == "u" else "user"

    def insert() -> None:
        edits = state["edits"]
        while state["at"] < len(edits) and edits[state["at"]] == "I":
            role = forced()
            put(role, "")
            state["last"], state["at"] = role[0], state["at"] + 1

    def close() -> None:
        if state:
            insert()
            ids.append(state["id"])
            digests.append(state["sha"].hexdigest())

    for batch in batches:
        for conv, edits, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if edits is not None:
                close()
                state.update(id=conv, edits=edits, at=0, last="", sha=hashlib.sha256(), any=False, made=0)
                continue
            insert()
            edit = state["edits"][state["at"]]
            state["at"] += 1
            if edit != "D":
                who = forced() if edit == "R" else role
                put(who, text)
                state["last"] = who[:1]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])
        ids, digests = [], []
    close()
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])


def repaired_conversations(rows: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of `rows` (as `damaged` gives them).

    Turns are ordered by turn (null first), then role, then a hash of the text; equal rows are copies, of which all but
    one are duplicates. gaps leaves null turns out; without any other it is 0. A conversation of which all rows are lost
    has zeros, no edits and the digest of nothing. Roles other than of initial s, u, a can be renamed or deleted. A null
    conv_id is a conversation. Other columns are not read. An empty table gives an empty result. A conversation is in one
    task, as a byte for each turn and 32 while its costs are computed; its texts pass by one at a time.
    """
    scratch = tables or Scratch(rows.sparkSession, "conversations")
    given = coded(rows).sortWithinPartitions("conv_id", "place")
    found = scratch.put(given.mapInArrow(K.trimmed(_edits), _FOUND), "edits")
    none = lambda t: F.lit(None).cast(t)
    heads = found.select("conv_id", F.lit(0).alias("part"), "edits", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"))
    turns = rows.filter("not lost").select("conv_id", F.lit(1).alias("part"), none("string").alias("edits"), "turn", "role", "text")
    line = heads.unionAll(turns).withColumn("tie", _tie()).withColumn("same", F.md5("text"))
    line = line.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "tie", "same")
    digests = line.select("conv_id", "edits", "role", "text").mapInArrow(K.trimmed(_digests), "did long, repaired_sha256 string")
    out = found.join(digests, found["conv_id"].eqNullSafe(digests["did"]))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.col("edits").alias("audit"), "repaired_sha256")
