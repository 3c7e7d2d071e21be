"""Quality rules whose cutoffs are chosen under a bound on the share of good texts they reject.

A rule rejects a text whose measure is above the cutoff of its stratum. The cutoffs of all rules form a path of settings
fixed in advance: the rules take turns, each lowering its cutoff by one place of its grid, loosest first, so every setting
rejects all that the one before it does. For each setting of a stratum, the good texts of the labelled holdout that any
rule would reject are counted, and an exact binomial test asks whether their true share can be above ALPHA. The tests of a
stratum are made in the order of the path and end at the first that fails; the last setting that passed is taken. Tests in
a fixed order need no division of the level among themselves, only among the strata, so all strata hold their bound
together with probability 1 - DELTA. A stratum with too few labels passes no test and has no cutoff: with four strata and
no good text hit, 217 are enough. Everything is DataFrame expressions.

Result by case: a null or empty text has no words and fails the base rules; a null stratum is a stratum; a text with
several labels is good if all of them say so; repeated rows each count and get the same verdict; an empty table gives no
rows. Repeats are found by 64-bit hashes of windows inside one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweave.operators.keyed import attach

from .common import store, table

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
ALPHA, DELTA = 0.02, 0.05
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\u000b\f\r"
#: Rule -> measure over the base columns (as SQL for both engines) and its cutoffs, lowest first.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25)),
    "long_words": ("word_chars / greatest(n_words, 1)", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
}
#: The path: rule and cutoff that each step sets, loosest first.
STEPS: list[tuple[str, float]] = [
    (rule, cuts[-turn]) for turn in range(1, max(len(cuts) for _, cuts in RULES.values()) + 1) for rule, (_, cuts) in RULES.items() if turn <= len(cuts)]


def first_step() -> str:
    """SQL: the first step of the path that rejects the row, null if none does."""
    cases = (" ".join(f"when {measure} > {cut} then {i}" for i, (r, cut) in enumerate(STEPS, 1) if r == rule) for rule, (measure, _) in RULES.items())
    return f"least({', '.join(f'case {whens} end' for whens in cases)})"


def settings(rule: str) -> list[float | None]:
    """Cutoff of ``rule`` after each step, none before its first."""
    out, at = [], None
    for r, cut in STEPS:
        at = cut if r == rule else at
        out.append(at)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more; the sort runs only where some window does."""
    every = words

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        pairs = let(placed, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        steps = let(places, lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def counted(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.size(w) - (WINDOW - 1)), lambda _, i: F.xxhash64(F.slice(w, i + 1, F.lit(WINDOW))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))

    return let(every, lambda w: F.when(F.size(w) > WINDOW, counted(w)).otherwise(F.lit(0).cast("long")))


def base_measures(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """``id, stratum`` and the base columns of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"), text.alias("text"))
    measured = rows.select(
        "id", "stratum",
        F.char_length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
    ).select("id", "stratum", "word_chars", "n_symbols", "l.*", "w.*")
    return measured.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def ln_factorial(n: Column) -> Column:
    """Stirling's series at n + 10, taken back step by step; exact to about 1e-13 relative."""
    z = n + 10.0
    series = 1 / (12.0 * z) - 1 / (360.0 * z * z * z) + 1 / (1260.0 * z * z * z * z * z)
    back = sum((F.log(n + float(i)) for i in range(2, 11)), F.log(n + 1.0))
    return (z + 0.5) * F.log(z) - z + 0.9189385332046727 + series - back


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, share) where k <= n * share; 1 elsewhere.

    From k downwards the probabilities fall faster and faster, so terms beyond ten standard deviations don't count.
    """
    n, k = n.cast("double"), k.cast("double")
    log_top = ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) + k * F.log(F.lit(share)) + (n - k) * F.log(F.lit(1 - share))
    terms = F.least(k, F.ceil(10 * F.sqrt(n * share)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] * (k - i) * (1 - share) / ((n - k + i + 1) * share)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    below = F.when(terms > 0, F.aggregate(F.sequence(F.lit(0), terms - 1), start, step, lambda a: a["s"])).otherwise(F.lit(1.0))
    return F.when((n > 0) & (k <= n * share), F.least(F.lit(1.0), F.exp(log_top) * below)).otherwise(F.lit(1.0))


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum`` and a cutoff for each rule, null where the path ends before the rule's turn; no row if no test passes."""
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(good_col).alias("good")).filter("good = 1").select("id")
    holdout = measured.filter("not base_failed").join(good, "id", "left_semi")
    tried = holdout.select("stratum", F.expr(first_step()).alias("first"))
    hits = [F.count_if(F.col("first") <= i).alias(f"k_{i}") for i in range(1, len(STEPS) + 1)]
    counted = tried.groupBy("stratum").agg(F.count("*").alias("n"), *hits)
    level = counted.agg(F.count("*").alias("strata")).select((F.lit(delta) / F.greatest("strata", F.lit(1))).alias("level"))
    tests = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"k_{i}").alias("k")) for i in range(1, len(STEPS) + 1)])
    # One row per stratum and step; the level is one row.
    rows = counted.select("stratum", "n", F.explode(tests).alias("t")).select("stratum", "n", "t.*").join(F.broadcast(level))
    failed = F.min(F.when(binomial_tail(F.col("k"), F.col("n"), alpha) > F.col("level"), F.col("step")))
    taken = rows.groupBy("stratum").agg((F.coalesce(failed, F.lit(len(STEPS) + 1)) - 1).alias("step")).filter("step > 0")
    return taken.select("stratum", *[F.element_at(F.array(*[F.lit(cut).cast("double") for cut in settings(rule)]), F.col("step")).alias(rule) for rule in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality") -> DataFrame:
    """Id, the base columns, ``base_failed``, ``kept`` and the rules that rejected the row."""
    measured, _ = store(base_measures(docs, id_col, text_col, stratum_col))
    chosen, _ = store(cutoffs(measured, labels, id_col, good_col))
    judged = attach(measured, chosen, ["stratum"])
    failed = F.array_compact(F.array(*[F.when(F.expr(f"{measure} > {rule}"), F.lit(rule)) for rule, (measure, _) in RULES.items()]))
    return judged.withColumn("rejected_by", F.array_join(failed, ",")).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"), "rejected_by")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle() -> str:
    """The same in DuckDB: windows by joining words, tails by summing all terms."""
    chosen = ", ".join(f"[{', '.join('null' if cut is None else str(cut) for cut in settings(rule))}][step] as {rule}" for rule in RULES)
    failed = ", ".join(f"case when {measure} > {rule} then '{rule}' end" for rule, (measure, _) in RULES.items())
    return rf"""
with texts as (select row_number() over () as r, doc_id, coalesce('=' || lang, '') as stratum, coalesce(text, '') as text from documents),
split as (select r, doc_id, stratum, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from texts),
windows as (select r, unnest(range(1, len(w) - {WINDOW - 2})) as i, w from split where len(w) > {WINDOW}),
keyed as (select r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as g from windows),
twice as (select r, i, count(*) over (partition by r, g) as c from keyed),
covered as (select r, count(distinct i + o) as n from (select r, i from twice where c > 1), (select unnest(range(0, {WINDOW})) as o) group by r),
base as (select s.r, doc_id, stratum, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words from split s left join covered c on s.r = c.r),
judged as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from base),
good as (select doc_id from labels group by doc_id having min(quality) = 1),
tried as (select stratum, {first_step()} as first from judged where not base_failed and doc_id in (select doc_id from good)),
counted as (select stratum, i as step, count(*) as n, count(*) filter (first <= i) as k from tried, (select unnest(range(1, {len(STEPS) + 1})) as i) group by all),
tails as (select *, case when k > n * {ALPHA} then 1 else list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln({1 - ALPHA})))) end as p from counted),
ends as (select stratum, coalesce(min(step) filter (p > {DELTA} / (select count(distinct stratum) from counted)), {len(STEPS) + 1}) - 1 as step from tails group by stratum),
chosen as (select stratum, {chosen} from ends where step > 0),
named as (select j.*, array_to_string(list_filter([{failed}], lambda x: x is not null), ',') as rejected_by from judged j left join chosen c on j.stratum = c.stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rejected_by = '' as kept, rejected_by from named
"""


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": oracle()}
