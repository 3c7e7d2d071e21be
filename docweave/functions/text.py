"""Text normalisation and key expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# The upper-case Latin letters that decompose into a base letter and a mark.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYY"
# Every character the source rules count as blank (Java's \s knows fewer).
BLANKS = "\t\n\u000b\f\r    -     　﻿"
# The first class lets most characters go at once; the second has a test for every blank.
WS = rf"[\t-\r \u00a0\u1680-\ufeff&&[{BLANKS}]]"
# What a single space replaces: longer runs, and blanks other than a space.
RUN = f"{WS}{{2,}}|(?! ){WS}"
BLANKS_IN_ASCII = r"[\t\n\x0B\f\r ]{2,}|[\t\n\x0B\f\r]"
BLANK_CHARS = "".join(re.findall(f"[{BLANKS}]", "".join(map(chr, range(0x10000)))))
MARKS = "".join(map(chr, range(0x300, 0x370)))
# Tokens that never carry meaning in a title.
STOP_WORDS = (
    "A AS AO AOS COM DA DAS DE DO DOS E EM NA NAS NO NOS O OS PARA POR UM UMA C"
).split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(c: Column | str) -> Column:
    """Null is the empty string; outer blanks are dropped."""
    return F.btrim(F.coalesce(col(c).cast("string"), F.lit("")), F.lit(BLANK_CHARS))


def norm(c: Column | str) -> Column:
    """Upper case without accents, long dashes as '-', blanks squeezed.

    Plain ASCII values, most keys and codes, skip the accent table, and pass no pattern unless they have
    blanks to squeeze.
    """
    given = F.coalesce(col(c).cast("string"), F.lit(""))
    upper = F.upper(given)
    # one pass: accents and dashes to their plain sign, blanks to ' ', combining marks to nothing
    folded = F.translate(upper, ACCENTED + "–—" + BLANK_CHARS + MARKS, PLAIN + "--" + " " * len(BLANK_CHARS))
    value = (
        F.when(F.octet_length(given) > F.char_length(given), F.regexp_replace(folded, " {2,}", " "))
        .when(F.contains(given, F.lit("  ")) | given.rlike(r"[\t-\r]"), F.regexp_replace(upper, BLANKS_IN_ASCII, " "))
        .otherwise(upper)
    )
    return F.trim(value)


def canon_key(c: Column | str) -> Column:
    """``norm`` without blanks around the separators ``_ . -``."""
    before = F.regexp_replace(norm(c), r" ([_.\-])", "$1")
    return F.regexp_replace(before, r"([_.\-]) ", "$1")


def loose_key(c: Column | str) -> Column:
    """Letters and digits of ``norm`` only."""
    return F.regexp_replace(norm(c), "[^A-Z0-9]", "")


def canonical_tag(c: Column | str) -> Column:
    """Letter and digit runs of ``norm``, digit runs without leading zeros, joined."""
    runs = F.regexp_extract_all(norm(c), F.lit("([A-Z]+|[0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")), "")


def punct_tag(c: Column | str) -> Column:
    """Tag with the non-tagged marker dropped and all separators written as one '-'."""
    value = F.regexp_replace(norm(c), "^NT[-_]", "")
    value = F.regexp_replace(F.regexp_replace(value, "[/_]+", "-"), " ", "")
    return F.regexp_replace(F.regexp_replace(value, "-+", "-"), "^-|-$", "")


def compact_tag(c: Column | str) -> Column:
    return F.regexp_replace(punct_tag(c), "[^A-Z0-9]", "")


def tokens(c: Column | str, min_len: int = 3, stop: list[str] | None = None) -> Column:
    """Distinct tokens of ``norm``, split on anything that is no letter or digit."""
    found = F.filter(F.split(norm(c), "[^A-Z0-9]+"), lambda t: F.length(t) >= min_len)
    found = F.array_distinct(found)
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found


def title_tokens(c: Column | str) -> Column:
    return tokens(c, 3, STOP_WORDS)


def first_rule(subject: Column, rules: list[tuple[str, str]], default: str = "") -> Column:
    """Label of the first ``(regex, label)`` rule that matches ``subject``."""
    test = lambda x: F.coalesce(*[F.when(x.rlike(p), F.lit(lab)) for p, lab in rules], F.lit(default))
    return let(subject, test)


def literal_map(pairs: dict[str, str], key: Column, default: str) -> Column:
    """Lookup in a small fixed dictionary, kept inside the generated code."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared tokens over the larger token set; 0 when one is empty."""
    larger = F.greatest(F.size(a), F.size(b), F.lit(1))
    return F.size(F.array_intersect(a, b)) / larger


def half_up(c: Column) -> Column:
    """Rounding with .5 going up, as a long."""
    return F.floor(c + F.lit(0.5)).cast("bigint")
