"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Letters in lower case, everything else as a single blank. The model of a language has interpolated probabilities for all
n-grams of any language, so that one search of a sorted array of hashes serves all languages at once, and back-off
weights for contexts. The language of the lowest cross-entropy per character wins. Calibration on sampled texts that did
not train gives, for each language, the mean and spread of the cross-entropy, by which a text can be rejected.

Bound of the fit (a documented parameter): PER_LANGUAGE labelled texts of each language, those of least hash of id and
text; of a text longer than LONGEST characters the sample holds the first LONGEST, and such texts come after all others.
Every text is scored whole, a very long one in parts with the characters before them that the model looks back to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.shared import crc_mod

ORDER, PER_LANGUAGE, LONGEST, REJECT_AT, SHORT = 4, 320, 200_000, 16.0, 60
PART = 1 << 20  # characters of a long text that are scored at once
UNKNOWN = "und"
_ALPHA: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _ALPHA:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
        _ALPHA.append(table)
    return _ALPHA[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts (a blank before and after each), each text's first, and its number of letters."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "replace"), np.uint32).copy()
    at = np.concatenate(([0], np.cumsum([len(t) + 2 for t in low])))
    letter = _letters()[codes]
    codes[~letter] = 32
    sums = np.concatenate(([0], np.cumsum(letter)))
    count = sums[at[1:]] - sums[at[:-1]]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank of a run
    keep[at[:-1]] = True
    inside = np.concatenate(([0], np.cumsum(keep)))
    return codes[keep], inside[at], count


def grams(codes: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0 .. order, the hash of the n characters that end at each position (fewer at a text's start)."""
    one = K.mix(codes.astype(K.U) + K.U(1))
    depth = np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))
    out, total = [np.zeros(len(codes), K.U)], np.zeros(len(codes), K.U)
    for n in range(1, order + 1):
        add = np.zeros(len(codes), K.U)
        add[n - 1 :] = one[: len(one) - n + 1] if n > 1 else one
        add[depth < n - 1] = 0
        total = total + add * K.PLACE[n - 1]
        out.append(total)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """keys[n], logp[n]: sorted n-gram hashes and log10 probabilities by language; contexts[n], backoff[n]: of the n - 1 characters before."""

    def __init__(self, languages: list[str], order: int):
        self.languages, self.order = languages, order
        self.keys: list[np.ndarray] = [np.zeros(0, K.U)]
        self.logp: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = [np.zeros(0, K.U)]
        self.backoff: list[np.ndarray] = [np.zeros((0, len(languages)), np.float32)]
        self.mean, self.spread, self.per_char = (np.zeros(len(languages)) for _ in range(3))

    def long_scores(self, text: str) -> tuple[np.ndarray, int, int]:
        """The same of one text, a part at a time."""
        total, count, letters, before = np.zeros(len(self.languages)), 0, 0, ""
        for begin in range(0, len(text), PART):
            end = begin + PART
            codes, first, n = characters([before + text[begin:end]])
            known, _, had = characters([before])
            skip = 1 if not begin else len(known) - (before[-1] != " ")  # a blank is added after a letter that a cut parts from the next
            stop = len(codes) - (end < len(text) and text[end - 1].isalpha())
            total += self.logs(codes, first)[skip:stop].sum(axis=0, dtype=np.float64)
            count, letters = count + max(0, stop - skip), letters + int(n[0] - had[0])
            before = codes[max(0, stop - 4 * self.order) : stop].astype("<u4").tobytes().decode("utf-32-le", "replace")
        return total, count, letters

    def char_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of log10 probabilities by text and language, scored characters, letters."""
        if len(texts) == 1 and len(texts[0]) > PART:
            return tuple(np.array([x]) for x in self.long_scores(texts[0]))
        codes, first, letters = characters(texts)
        acc = self.logs(codes, first)
        acc[first[:-1]] = 0  # the blank before a text is given
        sums = np.add.reduceat(acc.astype(np.float64), first[:-1]) if len(texts) else np.zeros((0, len(self.languages)))
        return sums, np.diff(first) - 1, letters

    def logs(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each character after those before it, by language."""
        g = grams(codes, first, self.order)
        size = len(codes)
        acc = np.zeros((size, len(self.languages)), np.float32)
        left = np.arange(size)
        for n in range(self.order, 0, -1):
            at, hit = _find(self.keys[n], g[n][left])
            acc[left[hit]] += self.logp[n][at[hit]]
            left = left[~hit]
            before = np.where(left > 0, g[n - 1][left - 1], K.U(0))
            at, hit = _find(self.contexts[n], before)
            acc[left[hit]] += self.backoff[n][at[hit]]
        acc[left] += self.logp[0]
        return acc


def train(texts: list[str], labels: list[str], order: int = ORDER) -> Model:
    languages = sorted(set(labels))
    model = Model(languages, order)
    tables: list[list[dict]] = []
    alphabet: set[int] = set()
    for lang in languages:
        codes, first, _ = characters([t for t, x in zip(texts, labels, strict=True) if x == lang])
        alphabet |= set(np.unique(codes).tolist())
        g = grams(codes, first, order)
        depth = np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))
        per: list[dict] = [{}]
        counts_of = None
        for n in range(order, 0, -1):
            if counts_of is None:
                here = np.flatnonzero(depth >= 1)  # the first blank is given
                key, index, a = np.unique(g[n][here], return_index=True, return_counts=True)
                at = here[index]
            else:  # of distinct (n + 1)-grams, how many end in each n-gram
                key, index, a = np.unique(g[n][counts_of], return_index=True, return_counts=True)
                at = counts_of[index]
            ctx, suffix = g[n - 1][at - 1] if n > 1 else np.zeros(len(at), K.U), g[n - 1][at]
            per.insert(1, {"key": key, "a": a.astype(np.float64), "ctx": ctx, "suffix": suffix})
            counts_of = at
        tables.append(per)
    uniform = -np.log10(len(alphabet) + 1)
    model.logp.append(np.full(len(languages), uniform, np.float32))
    for n in range(1, order + 1):
        keys = np.unique(np.concatenate([t[n]["key"] for t in tables]))
        contexts = np.unique(np.concatenate([t[n]["ctx"] for t in tables]))
        suffix, ctx_of = np.zeros(len(keys), K.U), np.zeros(len(keys), K.U)
        p, gamma = np.zeros((len(keys), len(languages))), np.ones((len(contexts), len(languages)))
        for j, t in enumerate(tables):
            r = t[n]
            at, _ = _find(keys, r["key"])
            suffix[at], ctx_of[at] = r["suffix"], r["ctx"]
            c, inverse = np.unique(r["ctx"], return_inverse=True)
            mass, kinds = np.bincount(inverse, r["a"]), np.bincount(inverse)
            once, twice = (r["a"] == 1).sum(), (r["a"] == 2).sum()
            d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            p[at, j] = np.maximum(r["a"] - d, 0) / mass[inverse]
            gamma[_find(contexts, c)[0], j] = d * kinds / mass
        lower = np.full((len(keys), len(languages)), 10**uniform) if n == 1 else 10 ** model.logp[n - 1][_find(model.keys[n - 1], suffix)[0]].astype(np.float64)
        p += gamma[_find(contexts, ctx_of)[0]] * lower
        model.keys.append(keys)
        model.logp.append(np.log10(p).astype(np.float32))
        model.contexts.append(contexts)
        model.backoff.append(np.log10(gamma).astype(np.float32))
    return model


def calibrate(model: Model, texts: list[str], labels: list[str]) -> None:
    """Mean and spread of a text's cross-entropy under its own language, for long and for short texts."""
    sums, n, _ = model.char_scores(texts)
    ce = -sums / np.maximum(n, 1)[:, None]
    for j, lang in enumerate(model.languages):
        own = np.array([x == lang for x in labels], bool) & (n > 0)
        x, size = ce[own, j], n[own]
        model.mean[j] = np.average(x, weights=size) if len(x) else 2.0
        error = np.abs(x - model.mean[j])
        model.per_char[j] = np.quantile(error * np.sqrt(size), 0.9) if len(x) else 4.0
        model.spread[j] = np.quantile(error[size > 200], 0.9) if (size > 200).any() else 0.1


def fit(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = PER_LANGUAGE, order: int = ORDER) -> Model | None:
    """From a bounded sample of labelled documents whose crc32(doc_id as text) modulo `folds` is not `held`; None if there are none."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(crc_mod("doc_id", folds) != held, F.lit(True)))
    drawn = F.struct((F.char_length("text") > LONGEST).alias("long"), F.xxhash64("doc_id", "text", F.lit(5)).alias("h"))
    first = Window.partitionBy("lang").orderBy("drawn")
    thin = labelled.select("lang", drawn.alias("drawn")).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language)
    last = thin.groupBy("lang").agg(F.max("drawn").alias("last"))  # a row of each language
    near = labelled.select("lang", F.substring("text", 1, LONGEST).alias("text"), drawn.alias("drawn")).join(F.broadcast(last), "lang").filter("drawn <= last")
    got = near.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language).select("lang", "text", "k").toPandas()  # per_language rows of each
    if not len(got):
        return None
    got = got.sort_values(["lang", "k"])
    test = np.arange(len(got)) % 5 == 4
    if test.sum() < 20 or got["lang"][~test].nunique() < got["lang"].nunique():
        test[:] = False
    texts, labels = got["text"].to_numpy(), got["lang"].to_numpy()
    model = train(list(texts[~test]), list(labels[~test]), order)
    check = test if test.any() else ~test
    calibrate(model, list(texts[check]), list(labels[check]))
    return model


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, score, ce, rejected = [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            texts = batch.column(1)
            sizes = np.diff(_offsets(texts)) if n else []
            i = 0
            while model is not None and i < n:
                j, total = i, 0
                while j < n and (j == i or total + sizes[j] <= K.PIECE):
                    total += int(sizes[j])
                    j += 1
                part = [t or "" for t in texts.slice(i, j - i).to_pylist()]
                sums, chars, letters = model.char_scores(part)
                mean = -sums / np.maximum(chars, 1)[:, None]
                best = mean.argmin(axis=1)
                low = mean[np.arange(len(part)), best]
                weight = np.exp(-(mean - low[:, None]) * np.log(10) * np.minimum(chars, SHORT)[:, None])
                far = low - model.mean[best] > REJECT_AT * np.maximum(model.spread[best], model.per_char[best] / np.sqrt(np.maximum(chars, 1)))
                for k in np.flatnonzero(letters > 0):
                    lang[i + k] = model.languages[best[k]]
                    score[i + k], ce[i + k], rejected[i + k] = 1 / weight[k].sum(), low[k], bool(far[k])
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(ce, from_pandas=True), pa.array(rejected), *batch.columns[2:]], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected", *[f"c{k}" for k in range(len(batch.columns) - 2)]])

    return K.trimmed(run)


def _offsets(texts: pa.Array) -> np.ndarray:
    t = texts.cast(pa.large_string()).fill_null("")
    return np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]


def identified(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = PER_LANGUAGE, order: int = ORDER, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every document, and the columns named in carry.

    lang_pred is a learned language, or `und` for a null text or one without a letter; these have score 0, a null
    cross_entropy and are rejected. score: the winner's share if each language's likelihood of up to SHORT characters at
    its rate counts. Ties go to the language first in code-point order. rejected: the text's rate is farther from what
    the language's own texts showed than REJECT_AT times the spread at its length. A null id is not held out. Labels,
    sources and ids are no inputs of a prediction; other columns are not read. Nothing to learn from: all are `und`. The
    sample is bounded whatever the ids: of rows that share id and text as many are drawn as there is room for.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, folds, held, per_language, order))
    rest = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    types = "".join(f", c{k} {t}" for k, (_, t) in enumerate(given.dtypes[2:]))
    out = given.mapInArrow(_predict(model), f"doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean{types}")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected", *(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)))
