"""Records of runs: fields by first present name, result rows of all benchmarks, fan-out of group runs, claims, dimensions of grader reports, and the smaller joins that graders make."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.nested import embedded_object

# Fixed values that records depend on: where a field stands in nested runs, the columns of each result row, waits of a command.
NESTED = {
    "level1_answer": ("level1", "parsed_answer"),
    "level2_answer": ("level2", "parsed_answer"),
    "level3_answer": ("level3", "parsed_answer"),
    "answer": ("level3", "parsed_answer"),
    "prediction": ("level3", "parsed_answer"),
    "level4_temporal": ("level4", "parsed_temporal"),
    "temporal": ("level4", "parsed_temporal"),
    "temporal_prediction": ("level4", "parsed_temporal"),
    "level4_prediction": ("level4", "parsed_temporal"),
    "level5_spatial": ("level5", "parsed_spatial"),
    "spatial": ("level5", "parsed_spatial"),
    "spatial_prediction": ("level5", "parsed_spatial"),
    "level5_prediction": ("level5", "parsed_spatial"),
}
ITEM_FIELDS = {
    "open_answer": ("id", "category", "Level", "task_type", "total_steps", "required_external_tools", "question", "omni_modal_input"),
    "exact_answer": ("question_id", "video_id", "video", "language", "category"),
    "option_text": ("question_id", "video_id", "video_category", "sub_category", "duration", "question_type", "difficulty", "question", "options"),
    "option_letter": ("question_id", "video_path", "level", "question", "options"),
    "yes_no": ("question_id", "video_file", "level", "question", "options"),
}
GOLD_FIELDS = {"open_answer": ("answer", "annotated_solution", "sources"), "exact_answer": ("answer",), "option_text": ("answer", "correct_option"), "option_letter": ("correct_answer",), "yes_no": ("correct_answer",)}
RUN_FIELDS = ("is_correct", "raw_model_output", "tool_call_num", "return_code", "timed_out", "stdout_text", "stderr_text")
NOTE = r"^N(\d{3,5})(?:-N(\d{3,5}))?$"
DEFAULT_WAIT, LONGEST_WAIT = 1.0, 60.0
CHOICES = 20  # of rare words, for a set and a size of partners


def _keys(c: Column) -> Column:
    return F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))


def present_field(record: Column, names: Sequence[str]) -> Column:
    """Of a JSON object, the text of the first of the names that it has, null values included; else of the first that its nested runs have."""
    at = lambda c, k: F.get_json_object(c, f"$['{k}']")
    out = F.when(F.lit(False), F.lit(""))
    for n in names:
        out = out.when(F.array_contains(_keys(record), n), at(record, n))
    runs = at(record, "runs")
    for n in names:
        if n in NESTED:
            level, field = NESTED[n]
            out = out.when(F.array_contains(_keys(at(runs, level)), field), at(at(runs, level), field))
    return out


def has_field(record: Column, names: Sequence[str]) -> Column:
    """Whether any of the names is there, in the record or in its nested runs."""
    runs, out = F.get_json_object(record, "$.runs"), F.lit(False)
    for n in names:
        out = out | F.array_contains(_keys(record), n)
        if n in NESTED:
            out = out | F.array_contains(_keys(F.get_json_object(runs, f"$.{NESTED[n][0]}")), NESTED[n][1])
    return out


def result_rows(runs: DataFrame, items: DataFrame, name: str, prediction: str, key: str = "source_index", gold: bool = False, level: str | None = None) -> DataFrame:
    """One row of a run: its item's fields, the prediction under the benchmark's own name, and what the run left. Fields that the items lack are null; a truth that is a letter is trimmed, in upper case. runs: key, prediction and RUN_FIELDS."""
    have = set(items.columns)
    field = lambda c: F.lit(level).alias(c) if c == "level" else F.col(f"i.{c}").alias(c) if c in have else F.lit(None).cast("string").alias(c)
    truth = lambda c: F.upper(F.trim(F.coalesce(F.col(f"i.{c}").cast("string"), F.lit("")))).alias(c) if c.startswith("correct") and c in have else field(c)
    extra = [c for c in runs.columns if c.startswith(("outer_", "retry_", "thread_", "session_", "gpu_"))]
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) if c in ("stdout_text", "stderr_text") else F.col(f"r.{c}").alias(c)
    met = runs.alias("r").join(items.alias("i"), F.col(f"r.{key}") == F.col(f"i.{key}"), "left")
    return met.select(F.col(f"r.{key}").alias(key), *map(field, ITEM_FIELDS[name]), F.col("r.prediction").alias(prediction), *map(text, RUN_FIELDS), *(F.col(f"r.{c}").alias(c) for c in extra), *(map(truth, GOLD_FIELDS[name]) if gold else ()))


def union_rows(parts: Sequence[DataFrame], predictions: Sequence[str]) -> DataFrame:
    """Result rows of several benchmarks as one table, columns that one lacks null, with `prediction` from the first of the named columns that is not null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("prediction", F.coalesce(*(F.col(c) for c in predictions if c in out.columns)))


def fanned_out(runs: DataFrame, items: DataFrame, group: str, extract: Callable[[Column, Column], Column], judge: Callable[[Column, Column], Column], text: str = "raw_model_output") -> DataFrame:
    """A row of each member of a group, from the group's one run: its own prediction from the shared text, and the verdict on it. items: group, options, truth and further fields."""
    met = items.join(runs, group)
    met = met.withColumn("prediction", extract(F.col(text), F.col("options")))
    return met.withColumn("is_correct", judge(F.col("truth"), F.col("prediction")))


def tool_use_blocks(events: DataFrame, key: str, event: str) -> DataFrame:
    """By key: blocks of type tool_use in the content of assistant events (JSON texts); 0 without one."""
    content = F.from_json(F.get_json_object(event, "$.message.content"), "array<struct<type:string>>")
    n = F.when(F.get_json_object(event, "$.type") == "assistant", F.size(F.filter(content, lambda b: b["type"] == "tool_use")))
    return events.groupBy(key).agg(F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0)).alias("tool_uses"))


def _used(event: Column, at: str) -> Column:
    """(prompt, completion) tokens of a usage object; cached input counts as input."""
    n = lambda name: F.coalesce(F.get_json_object(event, f"$.{at}.{name}").try_cast("long"), F.lit(0).cast("long"))
    return F.struct((n("input_tokens") + n("cache_creation_input_tokens") + n("cache_read_input_tokens")).alias("prompt"), n("output_tokens").alias("completion"))


def session_tokens(events: DataFrame, key: str, place: str, event: str) -> DataFrame:
    """By key, prompt and completion tokens: of the last result event, if it has any; else the sums over assistant messages."""
    kind, turn = F.get_json_object(event, "$.type"), _used(F.col(event), "message.usage")
    last = F.max_by(F.when(kind == "result", _used(F.col(event), "usage")), F.when(kind == "result", F.col(place)))
    total = lambda part: F.coalesce(F.sum(F.when(kind == "assistant", turn[part])), F.lit(0))
    out = events.groupBy(key).agg(last.alias("_last"), total("prompt").alias("_p"), total("completion").alias("_c"))
    told = F.coalesce((F.col("_last.prompt") != 0) | (F.col("_last.completion") != 0), F.lit(False))
    return out.select(key, F.when(told, F.col("_last.prompt")).otherwise(F.col("_p")).alias("prompt_tokens"), F.when(told, F.col("_last.completion")).otherwise(F.col("_c")).alias("completion_tokens"))


def turn_tokens(events: DataFrame, key: str, event: str) -> DataFrame:
    """By key, tokens summed over completed turns; the total is input and output, of which cached input is a part."""
    done = F.get_json_object(event, "$.type") == "turn.completed"
    n = lambda name: F.coalesce(F.sum(F.when(done, F.get_json_object(event, f"$.usage.{name}").try_cast("double").cast("long"))), F.lit(0)).alias(name)
    out = events.groupBy(key).agg(n("input_tokens"), n("output_tokens"), n("cached_input_tokens"))
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def distinct_calls(events: DataFrame, key: str, event: str) -> DataFrame:
    """By key, tool calls: started commands by the id of their item, and events of a tool's type by their own; both share one set of ids, and one without an id counts by itself."""
    get = lambda path: F.get_json_object(event, path)
    kind = F.coalesce(get("$.type"), F.lit(""))
    started = (kind == "item.started") & (F.coalesce(F.nullif(get("$.item.type"), F.lit("")), get("$.item.item_type")) == "command_execution")
    tool = kind.rlike("exec_command|apply_patch|web_search|tool_call")
    some = lambda c: F.nullif(c, F.lit(""))
    ids = F.when(started, some(get("$.item.id"))).otherwise(F.coalesce(some(get("$.call_id")), some(get("$.id"))))
    calls = F.coalesce(started, F.lit(False)) | tool
    return events.groupBy(key).agg((F.count_distinct(F.when(calls, ids)) + F.count_if(calls & ids.isNull())).alias("calls"))


def both_terms(found: DataFrame, glossary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Entries of a glossary of which a found row has all terms (trimmed), and their share: `covered`, `total`, `ratio`."""
    f = found.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns)).distinct()
    first = columns[0]
    hit = glossary.join(f, list(columns), "left_semi").agg(F.count_distinct(first).alias("covered"))
    return hit.join(glossary.agg(F.count("*").alias("total"))).withColumn("ratio", F.col("covered").cast("double") / F.greatest("total", F.lit(1)))


def matched_lookup(matches: DataFrame, flags: DataFrame, left: str, right: str, flag: str) -> DataFrame:
    """Flags of the right row that each left row was matched to; a pair without a flag counts as false. matches: left, right; flags: right, rule, flag."""
    rules = flags.select("rule").distinct()
    wanted = matches.join(F.broadcast(rules))  # a rule is a kind of check: a handful
    return wanted.join(flags, [right, "rule"], "left").select(left, "rule", F.coalesce(flag, F.lit(False)).alias(flag))


def overlapping_enough(left: DataFrame, right: DataFrame, keys: Sequence[str], least: float, width: int) -> DataFrame:
    """Left intervals (keys, _id, s, e) that any right interval (keys, s2, e2) covers with an IoU of at least so much; right ones may serve several."""
    from millrace.operators.intervals import overlap_pairs

    met = overlap_pairs(left, right, list(keys), width)
    inter = F.least("e", "e2") - F.greatest("s", "s2")
    union = (F.col("e") - F.col("s")) + (F.col("e2") - F.col("s2")) - inter
    good = met.filter(inter.cast("double") / union >= least).select("_id").distinct()
    return left.join(good, "_id", "left_semi")


def _subsets(words: Column, n: Column) -> Column:
    """All choices of n of the words, in their order."""
    longer = lambda sets, x: F.concat(sets, F.transform(F.filter(sets, lambda c: F.size(c) < n), lambda c: F.array_append(c, x)))
    return F.filter(F.aggregate(words, F.array(F.array().cast("array<string>")), longer), lambda c: F.size(c) == n)


def _near_sets(sets: DataFrame, least: float, g: list[str]) -> DataFrame:
    """(x, y, jaccard): pairs of different sets (g, x, w) that are similar, by common choices of rare words.

    Sets of n and m words must share o of them. Of their rarest n - o + k and m - o + k words they then share k, so rows
    meet by choices of k words, k as large as leaves no row more than CHOICES of them for a size of partners.
    """
    each = sets.select(*g, "x", F.explode("w").alias("word"))
    counts = each.groupBy(*g, "word").agg(F.count("*").alias("df"))
    ordered = each.join(counts, [*g, "word"]).groupBy(*g, "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda r: r["word"]).alias("w"))
    ordered = ordered.withColumn("n", F.size("w"))
    lo, hi = F.least("n", "m"), F.greatest("n", "m")
    sized = ordered.join(F.broadcast(ordered.select(F.col("n").alias("m")).distinct()), lo >= F.lit(least) * hi - 1e-9)  # sizes of sets are few
    sized = sized.select(*g, "x", "w", "n", lo.alias("lo"), hi.alias("hi"), F.ceil(F.lit(least / (1 + least)) * (F.col("n") + F.col("m")) - 1e-9).cast("int").alias("o"))
    spare, k = F.col("hi") - F.col("o"), F.lit(1)
    for n in range(2, 5):
        ways = F.lit(1)
        for i in range(n):
            ways = ways * (spare + n - i)
        k = F.when((F.col("o") >= n) & (ways <= CHOICES * math.factorial(n)), n).otherwise(k)
    sized = sized.withColumn("k", k)
    rare = F.slice("w", F.lit(1), F.col("n") - F.col("o") + F.col("k"))
    met = sized.select(*g, "x", "n", "lo", "hi", F.explode(_subsets(rare, F.col("k"))).alias("c")).withColumn("c", F.xxhash64("c"))
    one, two = met.filter("n = lo").select(*g, "lo", "hi", "c", "x"), met.filter("n = hi").select(*g, "lo", "hi", "c", F.col("x").alias("y"))
    pairs = one.join(two, [*g, "lo", "hi", "c"]).filter("lo < hi or x < y").select(*g, "x", "y").distinct()
    pairs = pairs.join(sets.select(*g, "x", F.col("w").alias("v")), [*g, "x"]).join(sets.select(*g, F.col("x").alias("y"), F.col("w").alias("u")), [*g, "y"])
    both = F.size(F.array_intersect("v", "u"))
    return pairs.select(*g, "x", "y", (both.cast("double") / (F.size("v") + F.size("u") - both)).alias("jaccard")).filter(F.col("jaccard") >= least)


def similar_pairs(rows: DataFrame, key: str, words: str, least: float, group: str | None = None) -> DataFrame:
    """(a, b, jaccard) of all pairs of rows (of one group, if named) whose sets of words reach the similarity; empty sets are in none.

    From half of the words on, equal sets are compared once, by choices of rare words, and pairs of their rows come at the
    end. Below that a prefix filter: words are ordered from the rarest on. Sets of n words that reach a similarity t share
    one of each other's first n - ceil(t * n) + 1 words, so only rows that meet in a rare word are compared, by their sizes and sets.
    """
    g = [group] if group else []
    if least >= 0.5:
        own = rows.select(*g, key, F.array_sort(F.array_distinct(F.array_compact(words))).alias("w")).filter(F.size("w") > 0)
        sets = own.groupBy(*g, "w").agg(F.min(key).alias("x"))
        member = own.join(sets, [*g, "w"]).select(*g, key, "x")
        near = _near_sets(sets, least, g)
        both = near.unionAll(sets.select(*g, "x", F.col("x").alias("y"), F.lit(1.0).alias("jaccard")))
        both = both.join(member.select(*g, "x", F.col(key).alias("p")), [*g, "x"]).join(member.select(*g, F.col("x").alias("y"), F.col(key).alias("q")), [*g, "y"])
        return both.filter("x <> y and p <> q or p < q").select(*g, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "jaccard")
    sets = rows.select(*g, key, F.array_distinct(words).alias("w")).filter(F.size("w") > 0)
    each = sets.select(*g, key, F.size("w").alias("n"), F.explode("w").alias("word"))
    counts = each.groupBy(*g, "word").agg(F.count("*").alias("df"))
    ordered = each.join(counts, [*g, "word"]).withColumn("place", F.row_number().over(Window.partitionBy(*g, key).orderBy("df", "word")))
    prefix = ordered.filter(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
    a, b = prefix.select(*g, "word", F.col(key).alias("a"), F.col("n").alias("na")), prefix.select(*g, "word", F.col(key).alias("b"), F.col("n").alias("nb"))
    size = (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9) & (F.col("a") < F.col("b"))
    met = a.join(b, [*g, "word"]).filter(size).select(*g, "a", "b").distinct()
    met = met.join(sets.select(*g, F.col(key).alias("a"), F.col("w").alias("x")), [*g, "a"]).join(sets.select(*g, F.col(key).alias("b"), F.col("w").alias("y")), [*g, "b"])
    both = F.size(F.array_intersect("x", "y"))
    return met.select(*g, "a", "b", (both.cast("double") / (F.size("x") + F.size("y") - both)).alias("jaccard")).filter(F.col("jaccard") >= least)


def claim_check(text: Column, pattern: str, expected: Column, tolerance: float = 0.05, absolute: bool = False) -> Column:
    """(ok, found, delta): the number in the pattern's first match against the expected one, by relative difference or, if absolute, by plain; with none expected any number will do."""
    found = F.replace(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    delta = found - expected
    off = F.abs(delta) if absolute else F.abs(delta) / F.greatest(F.lit(1e-9), F.abs(expected))
    ok = F.when(found.isNull(), False).when(expected.isNull(), True).otherwise(off <= tolerance)
    return F.struct(ok.alias("ok"), found.alias("found"), delta.alias("delta"))


def claims_score(claims: DataFrame, key: str, ok: str, weight: str, expected: str) -> DataFrame:
    """By key: share of the weight of claims that hold, and whether all with an expected number do."""
    strict = F.bool_and(F.when(F.col(expected).isNotNull(), F.col(ok)))
    return claims.groupBy(key).agg(F.coalesce(F.try_divide(F.sum(F.when(F.col(ok), F.col(weight)).otherwise(0.0)), F.sum(weight)), F.lit(0.0)).alias("score"), F.coalesce(strict, F.lit(True)).alias("ok"))


def note_range(c: Column) -> Column:
    """(first, last) of `N012-N034` or `N012`; null if it is neither or runs backwards."""
    t = F.trim(F.coalesce(c, F.lit("")))
    a = F.regexp_extract(t, NOTE, 1).try_cast("int")
    b = F.coalesce(F.regexp_extract(t, NOTE, 2).try_cast("int"), a)
    return F.when(a <= b, F.struct(a.alias("first"), b.alias("last")))


def clamped_wait(c: Column, kind: Column | None = None) -> Column:
    """Seconds of a command: a positive number up to LONGEST_WAIT; anything else, true and false too, is DEFAULT_WAIT."""
    number = F.trim(c.cast("string")).try_cast("double")
    fine = number > 0
    if kind is not None:
        fine = fine & (kind != "BOOLEAN")
    return F.when(F.coalesce(fine, F.lit(False)), F.least(number, F.lit(LONGEST_WAIT))).otherwise(F.lit(DEFAULT_WAIT))


def tag_index(c: Column) -> Column:
    """Entries (filename, tags) of a JSON text of any of three shapes: {"items": [{filename, tags}]}, the list alone, or {tag: [filenames]}, which is turned round."""
    entries = lambda x: F.transform(F.from_json(x, "array<struct<filename:string,tags:array<string>>>"), lambda r: F.struct(r["filename"].alias("filename"), F.coalesce(r["tags"], F.array().cast("array<string>")).alias("tags")))
    pairs = F.map_entries(F.from_json(c, "map<string,array<string>>"))
    files = F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.coalesce(p["value"], F.array().cast("array<string>")))))
    turned = F.transform(files, lambda f: F.struct(f.alias("filename"), F.transform(F.filter(pairs, lambda p: F.array_contains(p["value"], f)), lambda p: p["key"]).alias("tags")))
    items = F.get_json_object(c, "$.items")
    return F.coalesce(F.when(F.ltrim(items).startswith("["), entries(items)).when(F.ltrim(c).startswith("["), entries(c)).when(F.ltrim(c).startswith("{"), turned), F.array().cast("array<struct<filename:string,tags:array<string>>>"))


def grader_pass(stdout: Column, stderr: Column) -> Column:
    """The report's own `pass`, if it is a boolean; else by the words Overall: PASS or FAIL on either stream; else null."""
    said = F.schema_of_variant(F.try_parse_json(F.get_json_object(embedded_object(stdout), "$.pass"))) == "BOOLEAN"
    blob = F.concat_ws("\n", F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit("")))
    return F.when(F.coalesce(said, F.lit(False)), F.get_json_object(embedded_object(stdout), "$.pass").try_cast("boolean")).when(F.contains(blob, F.lit("Overall: PASS")), True).when(F.contains(blob, F.lit("Overall: FAIL")), False)


def grader_dimensions(reports: DataFrame, key: str, stdout: str, at: str = "$.dims") -> DataFrame:
    """(key, dim, value, ok) of each dimension in a grader's report: an object of numbers, booleans or objects with value (or score) and ok (or pass)."""
    dims = F.from_json(F.get_json_object(embedded_object(F.col(stdout)), at), "map<string,string>")
    d = reports.select(key, F.explode(dims).alias("dim", "raw"))
    part = lambda *names: F.coalesce(*(F.get_json_object("raw", f"$.{n}") for n in names))
    plain = ~F.ltrim("raw").startswith("{")
    value = F.when(plain, F.coalesce(F.col("raw").try_cast("double"), F.col("raw").try_cast("boolean").cast("double"))).otherwise(part("value", "score", "ratio").try_cast("double"))
    ok = F.when(plain, F.when(F.col("raw").isin("true", "false"), F.col("raw") == "true")).otherwise(part("ok", "pass").try_cast("boolean"))
    return d.select(key, "dim", value.alias("value"), ok.alias("ok"))
