import math
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import brown, language
from millrace.llm.brown import class_scores, exchange
from millrace.llm.language import identified


def test_kneser_ney_sums_to_one():
    model = language.train(["the cat sat on the mat", "a cat ate a rat"], ["x", "x"], 3)
    alphabet = [ord(c) for c in sorted(set("the cat sat on the mat a cat ate a rat"))] + [ord("?")]  # and one never seen
    for context in (" at", " th", " zz", " "):
        logs = [model.logs(np.array([*map(ord, context), c], np.uint32), np.array([0, len(context) + 1]))[-1, 0] for c in alphabet]
        assert sum(10.0**x for x in logs) == pytest.approx(1.0, abs=1e-4)


def plain_kneser_ney(texts, labels, order):
    """Interpolated Kneser-Ney by dictionaries of strings: a function from a text to the log10 probability in each language."""

    def clean(t):
        out = " "
        for c in t.lower() + " ":
            out += c if c.isalpha() else " " if out[-1] != " " else ""
        return out

    cut = lambda s, n: s[len(s) - n :] if len(s) > n else s
    alphabet, models = set("".join(clean(t) for t in texts)), {}
    for lang in sorted(set(labels)):
        tops = Counter()
        for t, x in zip(texts, labels, strict=True):
            s = clean(t)
            tops.update(cut(s[: i + 1], order) for i in range(1, len(s)) if x == lang)
        levels = {order: tops}
        for n in range(order - 1, 0, -1):
            levels[n] = Counter(cut(g, n) for g in levels[n + 1])
        models[lang] = []
        for n in range(1, order + 1):
            mass, kinds = Counter(), Counter()
            for g, a in levels[n].items():
                mass[g[:-1]] += a
                kinds[g[:-1]] += 1
            once, twice = (sum(a == k for a in levels[n].values()) for k in (1, 2))
            models[lang].append((levels[n], mass, kinds, min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5))

    def p(lang, n, g):
        if not n:
            return 1 / (len(alphabet) + 1)
        count, mass, kinds, d = models[lang][n - 1]
        lower = p(lang, n - 1, cut(g, n - 1))
        return max(count[g] - d, 0) / mass[g[:-1]] + d * kinds[g[:-1]] / mass[g[:-1]] * lower if g[:-1] in mass else lower

    return lambda t: [sum(math.log10(p(lang, order, cut(clean(t)[: i + 1], order))) for i in range(1, len(clean(t)))) for lang in sorted(models)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_plain_kneser_ney(order):
    rng = np.random.default_rng(order)
    texts = ["".join(rng.choice(list("abcdé ,9"), rng.integers(1, 60))) for _ in range(30)] + ["der Hund und die Katze", "the dog and the cat, the end"]
    labels = [("x", "y")[k % 2] for k in range(len(texts))]
    plain = plain_kneser_ney(texts, labels, order)
    asked = [*texts[:6], "a", "", "zzz ab", "the dog und Katze", "É" * 40, "12 34"]
    sums, _, _ = language.train(texts, labels, order).char_scores(asked)
    for t, got in zip(asked, sums, strict=True):
        assert got == pytest.approx(plain(t), abs=1e-3)


@pytest.mark.parametrize("part", [7, 50, 333])
def test_parts_of_a_long_text_add_up(monkeypatch, part):
    rng = np.random.default_rng(part)
    texts = ["".join(rng.choice(list("abcdé ,9Z.."), 900)) for _ in range(20)]
    model = language.train(texts, [("x", "y")[k % 2] for k in range(20)], 4)
    asked = [*texts[:5], "9" * 400 + "ab cd" + "." * 300 + "dé", "a" * 500, "." * 500, "Ab" * 260]
    want = [model.char_scores([t]) for t in asked]
    monkeypatch.setattr(language, "PART", part)
    for t, (sums, n, letters) in zip(asked, want, strict=True):
        got = model.char_scores([t])
        assert got[0][0] == pytest.approx(sums[0], abs=1e-2) and (int(got[1][0]), int(got[2][0])) == (int(n[0]), int(letters[0]))


@pytest.mark.parametrize("ids", ["own", "one", "none"])
def test_sample_of_long_texts_and_of_one_id(spark, monkeypatch, ids):
    """Labelled texts all longer than the sample takes, or one language's; rows that share an id, or have none."""
    monkeypatch.setattr(language, "LONGEST", 300)
    rng = np.random.default_rng(8)
    say = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [({"own": k, "one": 8, "none": None}[ids], say(*(("abcd", 120) if k % 2 else ("efgh", 9))), ("aa", "bb")[k % 2 == 0]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identified(df, per_language=40, carry=("lang",)).collect()
    assert len(got) == 400 and all(r["lang_pred"] == r["lang"] for r in got)
    model = language.fit(df.filter("lang = 'aa'"), per_language=40)
    assert model.languages == ["aa"]
    assert language.fit(df.filter("lang = 'zz'")) is None


def test_ties_and_repeated_rows_of_languages(spark):
    rows = [(k // 2, "one and the same text", ("aa", "bb")[k % 2]) for k in range(80)] + [(None, "one and the same text", None)] * 3
    got = identified(spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} == {"aa"} and not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_languages_held_out(spark):
    rng = np.random.default_rng(0)
    kinds = {"aa": list("abcde"), "bb": list("cdefg"), "cc": list("ghijk")}
    rows = [(k, " ".join("".join(rng.choice(kinds[lang], 5)) for _ in range(12)), lang) for k in range(240) for lang in [list(kinds)[k % 3]]]
    rows += [(900, None, "aa"), (901, "12 - 34", "aa"), (902, "", None), (903, "abc " * 9000, None)]
    df = spark.createDataFrame([(*r, "und") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {r["doc_id"]: r for r in identified(df, order=3).collect()}
    truth = {r[0]: r[2] for r in rows[:240]}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] for d in held)
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[d]["lang_pred"] for d in (900, 901, 902)] == ["und"] * 3 and got[901]["rejected"]
    assert got[903]["lang_pred"] == "aa"
    assert identified(df.limit(0)).count() == 0
    nothing = identified(df.filter("doc_id < 5").selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(1)
    true = np.arange(24) % 3
    big = rng.poisson(np.array([[1, 30, 1], [1, 1, 30], [30, 1, 1]])[true][:, true])
    of = exchange(np.pad(big, (0, 1)).astype(float), 4)

    def value(c):
        m = np.eye(4)[c].T @ np.pad(big, (0, 1)) @ np.eye(4)[c]
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(m) - f(m.sum(0)) - f(m.sum(1))

    assert value(of) >= value(np.append(true, 3)) - 1e-6
    for w in range(24):  # and no word's move raises it further
        for c in range(3):
            moved = of.copy()
            moved[w] = c
            assert value(moved) <= value(of) + 1e-6


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(3)
    words, size = 12, 5
    for _ in range(20):
        big = rng.integers(0, 5, (words, words)) * (rng.random((words, words)) < 0.6)
        of = rng.integers(0, size, words)
        one = np.eye(size)[of]
        m = one.T @ big @ one
        own = np.diag(big).astype(float)
        right, left = big @ one, big.T @ one
        right[np.arange(words), of] -= own
        left[np.arange(words), of] -= own
        gain = brown.gains(m, of, right, left, own)
        for w in range(words):
            values = []
            for c in range(size):
                there = np.eye(size)[np.where(np.arange(words) == w, c, of)]
                values.append(brown.likelihood(there.T @ big @ there))
            assert gain[w] - gain[w, 0] == pytest.approx(np.array(values) - values[0], abs=1e-6)


@pytest.mark.parametrize("table", [1 << 18, 40, 4])
def test_base_scores_equal_brute_force(documents, monkeypatch, table):
    monkeypatch.setattr(brown, "TABLE", table)  # few words in the table send the others through the join
    rows = documents.collect()
    words = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), None]) for r in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, ws in words if not held(d) for w in ws)
    total, mass = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    got = {r["doc_id"]: r for r in class_scores(documents).collect()}
    assert len(got) == len(rows)
    for d, ws in words:
        g = got[d]
        assert g["base_score"] == pytest.approx(sum(math.log10(c[w] + 0.5) - mass for w in ws))
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held(d), len(ws), sum(c[w] > 0 for w in ws), total)
        assert g["score"] < 0
    assert class_scores(documents.limit(0)).count() == 0


def plain_scores(rows, units, classes, least, sweeps, table):
    """The model word by word, in Python: the same first classes, then every word to its best class, all others as they are, those beyond the table as their group."""
    texts = [(d, [*(t or "").encode().lower().split(), None]) for d, t in rows]
    train = [w for d, w in texts if not (d is not None and zlib.crc32(str(d).encode()) % 5 == 1)]
    count = Counter(w for ws in train for w in ws)

    def token(w):
        buf = np.frombuffer(w or b"", np.uint8)
        h, shape, _ = brown.tokens(buf, np.array([0, len(buf)]))
        return (brown.END, brown.END_SHAPE) if w is None else (h[0], int(shape[0]))

    known = {w: token(w) for _, ws in texts for w in ws}
    order = sorted((w for w in count if w is not None), key=lambda w: (-count[w], int(np.uint64(known[w][0]).view(np.int64))))[:units]
    unit = {w: k for k, w in enumerate(sorted(order, key=lambda w: known[w][0]))}
    index = lambda w: unit.get(w, len(unit) + known[w][1])
    n = len(unit) + brown.SHAPES + 1
    big = np.zeros((n, n))
    for ws in train:
        for a, b in zip([None, *ws], ws, strict=False):
            big[index(a), index(b)] += 1
    size = min(classes, n)
    of = exchange(big, size)
    group = {w: int(of[len(unit) + known[w][1]]) for w in known}
    now = {w: int(of[index(w)]) for w in known}
    held, in_table = 0, set()
    for n in sorted(set(count.values()), reverse=True):
        level = [w for w in count if count[w] == n]
        held += len(level)
        in_table |= set(level) if held <= table else set()
    after, before = ({w: Counter() for w in count} for _ in range(2))
    for ws in train:
        for a, b in zip([None, *ws], ws, strict=False):
            after[a][b] += 1
            before[b][a] += 1

    def matrix(of):
        m = np.zeros((size, size))
        for a in after:
            for b, c in after[a].items():
                m[of[a], of[b]] += c
        return m

    tried = []
    for k in range(sweeps + 1):
        tried.append((brown.likelihood(matrix(now)), dict(now), matrix(now)))
        now = {w: c if w in in_table else group[w] for w, c in now.items()}
        m, nxt = matrix(now), dict(group)
        for w in count:
            if w is not None and count[w] >= least:
                right, left = np.zeros((2, 1, size))
                for v, c in after[w].items():
                    right[0, now[v]] += c if v != w else 0
                for v, c in before[w].items():
                    left[0, now[v]] += c if v != w else 0
                gain = brown.gains(m, np.array([now[w]]), right, left, np.array([float(after[w][w])]))[0, : size - 1]
                nxt[w] = int(gain.argmax()) if gain.max() > gain[now[w]] + 1e-9 else now[w]
        now = nxt
    best = max(range(sweeps + 1), key=lambda k: (tried[k][0], -k))
    _, now, m = tried[best]
    tokens_of, types = m.sum(axis=0), Counter(now[w] for w in count)
    p = lambda a, b: (m[now[a], now[b]] + 0.5) / (m[now[a]].sum() + 0.5 * size) * (count[b] + 0.5) / (tokens_of[now[b]] + 0.5 * (types[now[b]] + 1))
    return best, [(d, sum(math.log10(p(a, b)) for a, b in zip([None, *ws], ws, strict=False))) for d, ws in texts], p, count


@pytest.mark.parametrize("table", [1 << 18, 60])
def test_class_scores_equal_a_plain_model(spark, monkeypatch, table):
    monkeypatch.setattr(brown, "TABLE", table)
    monkeypatch.setattr(brown, "UNITS", 12)
    monkeypatch.setattr(brown, "CLASSES", 6)
    monkeypatch.setattr(brown, "MIN_COUNT", 2)
    rng = np.random.default_rng(7)
    names, verbs, rows = [f"n{k}" for k in range(40)], [f"v{k}x" for k in range(40)], []
    for d in range(70):
        words = [w for _ in range(rng.integers(1, 12)) for w in (names[min(39, rng.geometric(0.08))], verbs[min(39, rng.geometric(0.08))], *(["very"] * rng.integers(0, 3)))]
        rows.append((d, " ".join(words)))
    rows += [(None, "n1 v1x n1"), (200, None), (201, ""), (202, "never seen"), (3, "n1 v1x"), (3, "n1 v1x")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, h long, row long")
    best, want, p, count = plain_scores(rows, 12, 6, 2, brown.SWEEPS, table)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6)) for r in class_scores(df).collect()))
    assert got == sorted((d is None, d or 0, round(s, 6)) for d, s in want)
    assert best > 0  # the sweeps raised the likelihood
    assert class_scores(df.filter("text is null")).first()["n_tokens"] == 1
