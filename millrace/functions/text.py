"""Normalizers, answer extractors and text predicates as Column expressions; each normalizer keeps a name of its own."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: the punctuation set, the answer tag, placeholders, the cue words and fillers.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACES = r"\p{Zs}"  # what trim takes in the SQL of the queries: no line ends, no tabs
ANSWER_TAG = r"(?is)<answer>(.*?)</answer>"
PLACEHOLDERS = ("...", "..", ".", "YOUR_ANSWER", "FINAL_ANSWER", "ANSWER", "TBD", "N/A")
CUE = (
    r"(?imd)(?:^|[\.\n,;:]\s*)(?:(?:my|our|so\s+the|therefore\s+the|hence\s+the)\s+)?(?:\*\*)?(?:the\s*answer\s*(?:is|=|:)|final\s*answer|answer)(?:\*\*)?\s*[:=]?\s*(?:\*\*)?"
    r"`?([^\n`*]{1,80}?)`?(?:\*\*)?\s*[\.,;!\?]?\s*(?:$|\n)"
)
FILLERS = ("", "the", "above", "below", "yes", "no", "none", "n/a", "na", "unknown", "unclear", "inconclusive", "indeterminate", "ambiguous", "unable", "uncertain")
HEDGES = ("unclear", "unknown", "uncertain", "unable", "inconclusive", "indeterminate", "ambiguous", "not ", "i ", "we ", "based ", "somewhere ", "probably ", "possibly ", "likely ")
OPTION_PHRASE = (
    r"(?i)\b(?:answer\s+is\s*|answer\s*[:=]\s*|(?:i\s+(?:will\s+)?(?:chose|choose|pick|select)\s+)|final\s+answer\s*[:=]?\s*|correct\s+(?:option|answer)\s+is\s*|option\s+)"
    r"\(?\*?([A-D])\*?\)?\b"
)
OPTION_LINE = r"(?i)^\s*[A-D][\.\)]\s+\S"
NETWORK = r"(?i)\b(curl|wget|ssh|scp|rsync|nc|telnet)\b|https?://"
SECRET_NAME = r"(?i)(?:api[_-]?key|access[_-]?token|secret|password|credential|cookie)"
SECRET = r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*\S+|\bsk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|/(home|Users)/[A-Za-z0-9._-]+/"
SYNTAX_FAILURE = r"(?i)SyntaxError|invalid syntax|unexpected EOF|parse error|unexpected token|missing operand|unterminated string"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_filter(c: Column | str) -> Column:
    """Trimmed, lower case, ASCII punctuation deleted, blanks collapsed."""
    return collapse(F.translate(F.lower(F.trim(_text(c))), ASCII_PUNCTUATION, ""))


def norm_reward(c: Column | str) -> Column:
    """Lower case; comma, semicolon and the word `and` are separators, and one blank each."""
    return collapse(F.regexp_replace(F.lower(F.trim(_text(c))), r"\s*[,;]\s*|\s+and\s+|\s+", " "))


def norm_pred(c: Column | str) -> Column:
    return collapse(F.lower(_text(c)))


norm_ws = norm_pred


def norm_ident(c: Column | str) -> Column:
    """Blanks and hyphens as underscores, other non-word characters deleted."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_text(c))), r"[\s-]+", "_"), r"[^a-z0-9_]", "")


def norm_label(c: Column | str) -> Column:
    return F.lower(F.translate(F.trim(_text(c)), "- ", "__"))


def norm_words(c: Column | str) -> Column:
    return collapse(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9' ]", " "))


def safe_name(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), r"[^A-Za-z0-9._-]+", "_")


def numeric_canonical(c: Column) -> Column:
    """Canonical text of a plain number (no commas, at most 6 decimals, 8.0 as 8), or null."""
    plain = F.replace(F.trim(c), F.lit(","), F.lit(""))
    value = F.when(plain.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), plain.try_cast("decimal(38,10)"))
    shown = F.regexp_replace(F.regexp_replace(F.bround(value, 6).cast("decimal(38,6)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(shown == "-0", "0").otherwise(shown)


def norm_exact(c: Column | str) -> Column:
    """The evaluator's normalizer: compatibility forms, then canonical numbers, else punctuation and symbols as blanks."""
    t = nfkc(c)
    return F.coalesce(numeric_canonical(t), collapse(F.regexp_replace(F.lower(F.trim(t)), r"[\p{P}\p{S}]", " ")))


def nfkc(c: Column | str) -> Column:
    """Unicode compatibility form, which Spark has no function for: Arrow batches."""
    return F.pandas_udf(lambda s: s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore"), "string")(_text(c))


@cache
def _is_dense(x: str) -> bool:
    """Whether a character is of a script without blanks."""
    name = unicodedata.name(x, "")
    return "CJK" in name or "HIRAGANA" in name or "KATAKANA" in name


class _Marks(dict):
    """A table for str.translate that learns each character once: punctuation and symbols become `other`."""

    def __init__(self, other: str):
        self.other = other

    def __missing__(self, code: int) -> str:
        x = chr(code)
        self[code] = self.other if unicodedata.category(x)[0] in "PS" else x
        return self[code]


_NO_MARKS, _BLANK_MARKS = _Marks(""), _Marks(" ")


def asr_form(text: str) -> str:
    t = unicodedata.normalize("NFKC", text).casefold()
    if not t.isascii() and any(map(_is_dense, set(t))):
        return "".join(t.translate(_NO_MARKS).split())
    return " ".join(t.translate(_BLANK_MARKS).split())


def norm_asr(c: Column | str) -> Column:
    """Compatibility form and full case folding; scripts without blanks lose punctuation, others get blanks for it."""
    return F.pandas_udf(lambda s: s.map(asr_form, na_action="ignore"), "string")(_text(c))


def stripped(c: Column, blank: str = r"\s") -> Column:
    """Without what the class `blank` holds at both ends; `$` would also match before a last line end."""
    return F.regexp_replace(c, rf"^{blank}+|{blank}+\z", "")


def answers(c: Column | str, blank: str = r"\s") -> Column:
    return F.transform(F.regexp_extract_all(_text(c), F.lit(ANSWER_TAG), 1), lambda x: stripped(x, blank))


def last_answer(c: Column | str, blank: str = r"\s") -> Column:
    """Payload of the last answer tag, or null. What is stripped of it is a class of characters: any white space, or as SQL's trim has it SPACES."""
    return F.try_element_at(answers(c, blank), F.lit(-1))


def _is_placeholder(x: Column) -> Column:
    return F.upper(x).isin(*PLACEHOLDERS) | ~x.rlike(r"[\p{L}\p{N}]")


def last_real_answer(c: Column | str) -> Column:
    """The last payload that is no placeholder; if all are, the last one; empty without a tag."""
    found = answers(c)
    return F.coalesce(F.try_element_at(F.filter(found, lambda x: ~_is_placeholder(x)), F.lit(-1)), F.try_element_at(found, F.lit(-1)), F.lit(""))


def tag_or_text(c: Column | str, blank: str = r"\s") -> Column:
    """Payload of the last answer tag, else the text, both stripped."""
    return F.coalesce(last_answer(c, blank), stripped(_text(c), blank))


def lenient_answer(c: Column | str) -> Column:
    """The last tag, else the last short statement after an answer cue within the last 4000 characters that is neither a filler nor begins with a hedge."""
    tail = F.right(_text(c), F.lit(4000))
    found = F.transform(F.regexp_extract_all(tail, F.lit(CUE), 1), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"[\s.*`'\":,;!?]+$", ""), r"^[\s*`'\":]+", ""))
    fine = F.filter(found, lambda x: ~F.lower(x).isin(*FILLERS) & ~_starts(F.lower(x), HEDGES))
    return F.coalesce(last_answer(c), F.try_element_at(fine, F.lit(-1)), F.lit(""))


def _starts(c: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


# How a letter is labelled, how it stands alone, and what may surround it at the end of a text.
_LABELED = r"\b(?:OPTION|ANSWER|CHOICE|CORRECT ANSWER)(?:\s+IS)?\s*[:：]?\s*[*(\[]*([%s])(?:[*)\].,:;!?\s]|$)"
_BARE = r"^[\s*(\[]*([%s])[\s*)\].,:;!?]*$"


def choice(c: Column | str, letters: str) -> Column:
    """A letter of the allowed ones: labelled, alone, alone or labelled in a line (from the last line), or at the end."""
    allowed = "".join(sorted(set(letters.upper())))
    text = F.upper(F.trim(tag_or_text(c)))
    labeled, bare = _LABELED % allowed, _BARE % allowed
    lines = F.transform(F.reverse(F.split(text, r"\r?\n")), lambda x: F.trim(F.regexp_replace(x, r"^[>\-*\s]+", "")))
    of = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, bare, 1), F.lit("")), F.nullif(F.regexp_extract(x, labeled, 1), F.lit("")))
    by_line = F.try_element_at(F.filter(F.transform(lines, of), lambda x: x.isNotNull()), F.lit(1))
    end = F.nullif(F.regexp_extract(F.concat(F.lit(" "), F.right(text, F.lit(80))), r"[\s*(\[]([%s])[\s*)\].,:;!?]*$" % allowed, 1), F.lit(""))
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(labeled), 1), F.lit(-1)), F.nullif(F.regexp_extract(text, bare, 1), F.lit("")), by_line, end, F.lit(""))


def yes_no(c: Column | str) -> Column:
    """A for yes, B for no, if just one of them is said and no letter is."""
    text = F.lower(tag_or_text(c))
    yes, no = text.rlike(r"\byes\b"), text.rlike(r"\bno\b")
    return F.coalesce(F.nullif(choice(c, "AB"), F.lit("")), F.when(yes & ~no, "A").when(no & ~yes, "B"), F.lit(""))


def option_choice(c: Column | str, options: Column) -> Column:
    """A to D in four layers: last tag that is a letter, last answer phrase, last free-standing letter outside option lines, the only option whose text occurs."""
    text = F.trim(_text(c))
    tagged = F.filter(F.transform(answers(c), lambda x: F.regexp_extract(F.upper(x), _BARE % "A-D", 1)), lambda x: x != "")
    phrase = F.regexp_extract_all(text, F.lit(OPTION_PHRASE), 1)
    free = F.array_join(F.filter(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"), lambda x: ~x.rlike(OPTION_LINE)), "\n")
    letters = F.regexp_extract_all(free, F.lit(r"(?<![\p{L}\p{N}_./-])([A-D])(?![\p{L}\p{N}_-])"), 1)
    said = F.lower(collapse(text))
    parts = F.transform(options, lambda o: F.struct(F.upper(F.regexp_extract(o, r"(?i)^\s*([A-D])\.", 1)).alias("k"), F.lower(F.trim(F.regexp_extract(o, r"(?i)^\s*[A-D]\.\s*(.+?)\s*$", 1))).alias("v")))
    named = F.filter(parts, lambda p: (p["v"] != "") & F.contains(said, p["v"]))
    same = F.filter(parts, lambda p: (p["v"] != "") & (p["v"] == said))
    only = F.array_distinct(F.transform(named, lambda p: p["k"]))
    last = lambda a: F.upper(F.try_element_at(a, F.lit(-1)))
    layers = F.coalesce(last(tagged), last(phrase), F.try_element_at(letters, F.lit(-1)), F.try_element_at(F.transform(same, lambda p: p["k"]), F.lit(-1)), F.when(F.size(only) == 1, F.get(only, 0)))
    return F.when(text == "", "").otherwise(F.coalesce(layers, F.lit("")))


def allowed_letters(options: Column) -> Column:
    """Letters that options start with, ABCD if none."""
    found = F.filter(F.transform(options, lambda o: F.upper(F.regexp_extract(o, r"^\s*([A-Za-z])[.):]", 1))), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(found)), ""), F.lit("")), F.lit("ABCD"))


def correctness(answer_type: Column, predicted: Column, truths: Column) -> Column:
    """(ok, reason): multiple choice by equal normal forms or by first token, open answers by inclusion either way."""
    p = norm_filter(predicted)
    t = F.transform(F.filter(F.coalesce(truths, F.array().cast("array<string>")), lambda x: x.isNotNull()), norm_filter)
    token = F.substring_index(p, " ", 1)
    verdict = lambda ok, why: F.struct(F.lit(ok).alias("ok"), F.lit(why).alias("reason"))
    mcq = F.when(F.exists(t, lambda g: g == p), verdict(True, "exact_match")).when(F.exists(t, lambda g: (g == token) | F.startswith(g, F.concat(token, F.lit(" ")))), verdict(True, "first_token_match")).otherwise(verdict(False, "no_match_mcq"))
    within = F.filter(t, lambda g: (g != "") & (F.contains(p, g) | F.contains(g, p)))
    found = F.concat(F.lit("open_substring(g_in_p="), F.when(F.contains(p, F.get(within, 0)), "True").otherwise("False"), F.lit(")"))
    free = F.when(F.size(within) > 0, F.struct(F.lit(True).alias("ok"), found.alias("reason"))).otherwise(verdict(False, "no_match_open"))
    none = F.coalesce(F.size(truths), F.lit(0)) <= 0
    return F.when(F.coalesce(predicted, F.lit("")) == "", verdict(False, "empty_prediction")).when(none, verdict(False, "no_ground_truth")).when(p == "", verdict(False, "prediction_empty_after_normalize")).when(answer_type == "mcq", mcq).otherwise(free)


def passes(ok: Column, reason: Column, exit_reason: Column, error: Column, rescue: bool = True) -> Column:
    """(passed, why): with rescue the match alone decides, else a clean exit is needed too."""
    done = F.coalesce(exit_reason == "task_complete", F.lit(False))
    if rescue:
        return F.struct(ok.alias("passed"), F.when(ok & ~done, F.concat(reason, F.lit(";rescue=on"))).otherwise(reason).alias("why"))
    bad = ~done | (F.coalesce(error, F.lit("")) != "")
    return F.struct((ok & ~bad).alias("passed"), F.when(bad, F.concat(F.lit("bad_exit("), F.coalesce(exit_reason, F.lit("None")), F.lit(")"))).otherwise(reason).alias("why"))


def tri_state(c: Column | str) -> Column:
    """True, false or null from the usual words and digits."""
    v = F.lower(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))
    return F.when(v.isin("true", "yes", "correct", "1"), True).when(v.isin("false", "no", "incorrect", "0"), False)


def first_number(c: Column | str) -> Column:
    return F.regexp_extract(_text(c), r"([-+]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def numbers(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_text(c), F.lit(r"([-+]?[0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.try_cast("double"))


def reports_number(c: Column | str, value: Column, tolerance: float) -> Column:
    """Whether any number in the text is within the tolerance of the value."""
    return F.exists(numbers(c), lambda x: F.abs(x - value) <= tolerance)


def clock_seconds(c: Column | str) -> Column:
    """Seconds of H:M:S, M:S (the fraction after a comma or a dot), or a plain number; else null."""
    parts = F.transform(F.split(F.replace(F.trim(_text(c)), F.lit(","), F.lit(".")), ":"), lambda x: x.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when(F.size(parts) <= 3, total)


def tag_list(c: Column | str) -> Column:
    """Tags of a JSON array, or of a list with semicolons or commas."""
    t = F.trim(_text(c))
    cut = F.when(F.contains(t, F.lit(";")), F.split(t, ";")).otherwise(F.split(t, ","))
    raw = F.when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), F.array().cast("array<string>"))).otherwise(cut)
    return F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_text(c), F.lit(r"\S+"))


def token_jaccard(a: Column, b: Column) -> Column:
    """Distinct words in both over words in either; null if neither has any."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def set_recall(truth: Column, found: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(truth, found)).cast("double"), F.size(F.array_distinct(truth)))


def window_jaccard(quote: Column, words: Column) -> Column:
    """Best word Jaccard of a quote with any run of as many words of a text."""
    n = F.size(quote)
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.coalesce(F.array_max(F.transform(starts, lambda i: token_jaccard(F.slice(words, i, F.greatest(n, F.lit(1))), quote))), F.lit(0.0))


def keyword_near(text: Column, first: str, second: str, distance: int = 200) -> Column:
    gap = f"[\\s\\S]{{0,{distance}}}"
    return text.rlike(f"(?i){first}{gap}{second}|{second}{gap}{first}")


def mask_paths(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), r"/tmp/[A-Za-z0-9._/-]+", "/tmp/<path>")


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) of the first character in which two texts differ, also by one's end; null if they are equal."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    return F.when(a != b, F.array_position(differ, True) - 1)


def head_tail(c: Column | str, limit: int) -> Column:
    """A text of more characters than the limit keeps its two halves of it around a mark."""
    t = _text(c)
    half = limit // 2
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(half)), F.lit(" ... "), F.right(t, F.lit(half))))


def prompt(question: Column, options: Column) -> Column:
    """Question, then each option with its letter on a line."""
    lines = F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o, i: F.concat(F.lit("  "), F.chr(F.lit(65) + i), F.lit(". "), o))
    return F.concat_ws("\n", question, lines)


def surrogate_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256), 1, 16))


def benchmark_of(path: Column, names: Sequence[str]) -> Column:
    """First of the names, in their order, that the lower-case path contains."""
    return F.coalesce(*(F.when(F.contains(F.lower(path), F.lit(n)), n) for n in names))


def url_origin(c: Column | str) -> Column:
    got = F.regexp_extract(F.lower(_text(c)), r"^([a-z][a-z0-9+.-]*://[^/?#@]+)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(got, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1"), F.lit(""))


def character_error_rate(truth: Column, found: Column) -> Column:
    """Edit distance over the length of the truth; with an empty truth 0 if nothing was found, else 1."""
    return F.when(F.length(truth) == 0, (F.length(found) > 0).cast("double")).otherwise(F.levenshtein(found, truth) / F.length(truth))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often use names it, also within its lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


#: What parts words where words are those between any white space.
ANY_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def split_words(c: Column | str) -> Column:
    return F.filter(F.split(_text(c), ANY_SPACE), lambda w: w != "")


def _symbol(k: Column) -> Column:
    """A character of its own for each number from 1 on, for a million numbers; no half of a pair."""
    code = k + 0xFF
    code = F.when(code < 0xD800, code).otherwise(code + 0x800)
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word of the two becomes one character, and Spark's edit distance of texts does the rest."""
    spelt = lambda words, known: F.array_join(F.transform(words, lambda w: _symbol(F.array_position(known, w))), "")
    return let(F.array_distinct(F.concat(a, b)), lambda known: F.levenshtein(spelt(a, known), spelt(b, known)))


def word_error_rate(truth: Column, found: Column) -> Column:
    """Edit distance in words over the number of true words; with none of these 0 if none was found, else 1."""

    def rate(p: Column) -> Column:
        n = F.size(p["a"])
        return F.when(n == 0, (F.size(p["b"]) > 0).cast("double")).otherwise(word_distance(p["a"], p["b"]) / n)

    return let(F.struct(split_words(truth).alias("a"), split_words(found).alias("b")), rate)
