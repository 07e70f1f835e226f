"""Sequence packing by power-of-two decomposition.

A document's n tokens (its ids, then one end id) become floor(n / 1024) pieces of 1024 and one piece for each bit of the
remainder, longest first. Pieces of equal length form a bucket and each piece is a sequence by itself, so no sequence
crosses documents and, every length being a power of two, none is padded. Nothing is shuffled: a row needs only its text.

Null or empty text: one piece that holds the end id. Repeated rows are packed each on their own. A null id stays null.
Only the id and the text are read, so further columns, whatever their names, do not matter. No rows give no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
CACHE_BYTES, CACHE_CHUNK, LONG_BLANKS = 24 << 20, 24, 4096  # bytes of chunks and ids that a worker keeps, characters of such a chunk, and of blanks that the pattern may meet at once
_SPLIT = re.compile(r" \s")
#: The published pre-tokenizer of the vocabulary (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode white space (fixed values), as the pattern has it.
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANKS)


class Ids(dict):
    """Little-endian ids of ' ' + chunk, for chunks that a single space precedes. What precedes a lone space never joins what follows, so ids of chunks concatenate to the ids of the text. Short chunks are kept up to `room` bytes."""

    def __init__(self, encode, single, room: int):
        super().__init__()
        self.encode, self.single, self.room = encode, single, room

    def __missing__(self, chunk: str) -> bytes:
        whole = chunk.isascii() and chunk.isalpha()  # one piece to the pattern
        out = array("I", self.single(b" " + chunk.encode()) if whole else self.encode(" " + chunk)).tobytes()
        if len(chunk) <= CACHE_CHUNK and self.room > 0:
            self.room -= len(chunk) + len(out) + 160  # and the objects that hold them
            self[chunk] = out
        return out


def _ranks(d: dict) -> dict[bytes, int] | None:
    """Byte ranks of a byte-level BPE file whose ids follow its merges; None for any other file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    pre, model, added = d.get("pre_tokenizer") or {}, d["model"], {t["content"] for t in d.get("added_tokens") or ()}
    fits = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not d.get("normalizer") and model["type"] == "BPE" and not model.get("ignore_merges")
    fits = fits and not any(t.get(k) for t in d.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip"))
    try:
        ranks = {bytes(shown[c] for c in token): k for token, k in model["vocab"].items() if token not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        fits = fits and all(model["vocab"][a + b] == 256 + k for k, (a, b) in enumerate(merges))
    except KeyError:
        return None
    return ranks if fits else None


def encoder(path: str):
    """A function from a text to its ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizers library without added special tokens: the string of a special token in a text is that token."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    ranks = _ranks(d)
    if ranks is None:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    import tiktoken

    made = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain, single = made.encode_ordinary, made._encode_single_piece
    special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in d.get("added_tokens") or ()}
    marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    get = Ids(plain, single, CACHE_BYTES).__getitem__

    def words(text: str) -> bytes:
        if _SPLIT.search(text):
            return np.array(plain(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        if rest and not rest[-1]:  # a last space stands alone
            rest.pop()
            return np.array(plain(first), "<u4").tobytes() + b"".join(map(get, rest)) + np.array(plain(" "), "<u4").tobytes()
        return np.array(plain(first), "<u4").tobytes() + b"".join(map(get, rest))

    def part(text: str) -> bytes:
        """Long runs of blanks never meet the pattern, which would go back through them: all but the last, or all at the end of a text, are one piece of their own."""
        out, at = [], 0
        for run in _BLANKS.finditer(text) if len(text) >= LONG_BLANKS else ():
            end = run.end() - (run.end() < len(text))
            out += [words(text[at : run.start()]), np.array(single(text[run.start() : end].encode()), "<u4").tobytes()]
            at = end
        return b"".join(out) + words(text[at:])

    def ids(text: str) -> bytes:
        if marks is None or not marks.search(text):
            return part(text)
        return b"".join(special[x] if k % 2 else part(x) for k, x in enumerate(marks.split(text)))

    return ids


def binary_lengths(n: int, longest: int) -> list[int]:
    """Whole pieces of the longest power of two, then the bits of the rest from the top."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def packed(docs: DataFrame, tokenizer_path: str, longest: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of every document: place, length, checksum of the ids, and the sequence that holds them. `longest` is a power of two. The file is read by each worker, from where the tokenizers are installed. Sequence ids are the scan task's number and a running number; they are unique, and stay the same for the same input files."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, next_id = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids(text.as_py() or "") + end
                n, at = len(data) // 4, 0
                for length in binary_lengths(n, longest):
                    for col, v in zip(cols, (doc, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), n), strict=True):
                        col.append(v)
                    at += length
            lengths = np.array(cols[2], np.int64)
            made = [pa.array(c, pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays([*made, pa.array(next_id + np.arange(len(lengths)), pa.int64()), pa.array(np.zeros(len(lengths), np.int64)), pa.array(np.log2(np.maximum(lengths, 1)).astype(np.int32))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"])
            next_id += len(lengths)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.trimmed(run), SCHEMA)
