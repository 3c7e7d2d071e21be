"""Cleaning, typing and code-decomposition jobs: a table in, the same rows with new columns out.

Each job comes with a profile that counts what happened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes, dates, revision, text
from .keyed import latest_by

# Error tokens spreadsheets leave in cells, and wordings that mean "no value".
ERROR_TOKENS = (
    r"(?i)#(N/A|N/D|VALUE!|VALOR!|REF!|NAME\?|NOME\?|DIV/0!|NUM!|NÚM!|NULL!|NULO!|SPILL!|DESPEJAR!|CALC!|FIELD!"
    r"|CAMPO!|BLOCKED!|BLOQUEADO!|BUSY!|OCUPADO!|CONNECT!|CONECTAR!|GETTING_DATA)"
)
UNAVAILABLE = (
    "", "0", "-", "N/A", "N/D", "NA", "ND", "#N/A", "#N/D", "NAO INFORMADO", "A DEFINIR", "PENDENTE",
    "SEM DESCRICAO", "NAO DISPONIVEL",
)


def key_standardize(df: DataFrame, column: str) -> DataFrame:
    return (
        df.withColumn("norm_key", text.norm(column))
        .withColumn("canon_key", text.canon_key(column))
        .withColumn("loose_key", text.loose_key(column))
        .withColumn("compact_key", text.canonical_tag(column))
    )


def key_collisions(df: DataFrame, column: str) -> DataFrame:
    """Loose keys that stand for more than one canonical key."""
    keyed = df.groupBy(text.loose_key(column).alias("loose_key"), text.canon_key(column).alias("canon_key")).count()
    return (
        keyed.groupBy("loose_key")
        .agg(
            F.count(F.lit(1)).alias("spellings"),
            F.sum("count").cast("bigint").alias("row_count"),
            F.min("canon_key").alias("first_key"),
            F.max("canon_key").alias("last_key"),
        )
        .filter("spellings > 1")
    )


# What is rewritten in a cell with spreadsheet errors, then in a piece of a title; in order.
ERROR_RULES = [
    (ERROR_TOKENS, " "),
    (r"\s*\|\s*", " | "),
    (r"^\s*\|\s*|\s*\|\s*$", ""),
    (r"\|\s*\|", "|"),
    (r"\s+([,;:])", "$1"),
    (r"(\s+[-–—]\s+){2,}", " - "),
]
# Every text that one of the rules changes has one of these; most cells and titles have none.
ERROR_SIGNS = r"[#|]|\s[,;:]|[-–—]\s+[-–—]"
TITLE_SIGNS = r"[-–—]|\s\s|^\s|\s$|^(?i:TAG)|(?iu:IDENTIFICA)|(?i:DE\s+DE)"
TITLE_RULES = [
    (r"(?i)^TAG\s*[:\-]?\s*", ""),
    (r"(?iu)\bDE\s+IDENTIFICA[CÇ][AÃ]O\s+DE\b", "DE"),
    (r"(?iu)\bDE\s+IDENTIFICA[CÇ][AÃ]O\s+D([OA]S?)\b", "D$1"),
    (r"(?iu)\bIDENTIFICA[CÇ][AÃ]O\s+DE\b", ""),
    (r"(?iu)\bIDENTIFICA[CÇ][AÃ]O\b", ""),
    (r"(?i)\bDE\s+DE\b", "DE"),
    (r"\s+[-–—]\s+", " - "),
    (r"(?:\s+-\s+){2,}", " - "),
    (r"\s{2,}", " "),
    (r"^\s*-\s*|\s*-\s*$", ""),
]


def rewrite(v: Column, rules: list[tuple[str, str]], signs: str) -> Column:
    """Text after every ``(pattern, replacement)`` in order; without one of the ``signs`` no rule applies."""
    return F.when(v.rlike(signs), reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, v)).otherwise(v)


def strip_errors(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(rewrite(text.text(c), ERROR_RULES, ERROR_SIGNS), text.RUN, " "))


def is_unavailable(c: Column | str) -> Column:
    return text.norm(c).isin(*UNAVAILABLE) | (strip_errors(c) == "")


def placeholder_nullify(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.withColumn("_clean", strip_errors(c))
        df = df.withColumn(f"{c}_missing", text.norm(c).isin(*UNAVAILABLE) | (F.col("_clean") == ""))
        df = df.withColumn(f"{c}_clean", F.when(F.col(f"{c}_missing"), F.lit("")).otherwise(F.col("_clean")))
    return df.drop("_clean")


def placeholder_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, missing, with error tokens, changed. One pass over the data."""
    n = F.count(F.lit(1))
    per_column = [
        F.struct(
            F.lit(c).alias("column_name"),
            n.alias("row_count"),
            F.count_if(is_unavailable(c)).alias("missing"),
            F.count_if(F.col(c).rlike(ERROR_TOKENS)).alias("with_errors"),
            F.count_if((strip_errors(c) != text.text(c)) & ~is_unavailable(c)).alias("changed"),
        ).alias(c)
        for c in columns
    ]
    return df.agg(*per_column).select(F.inline(F.array(*columns)))


def mixed_date_normalize(df: DataFrame, column: str, now: str, days: int = 30) -> DataFrame:
    return (
        df.withColumn("date_style", dates.date_style(column))
        .withColumn("date_value", dates.date_text(column))
        .withColumn("recent", dates.is_recent(column, days, now))
    )


def mixed_date_profile(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(dates.date_style(column).alias("date_style")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(dates.parse_date(column)).alias("parsed"),
        (F.count(F.lit(1)) - F.count(dates.parse_date(column))).alias("unparsed"),
    )


def revision_rank(df: DataFrame, column: str) -> DataFrame:
    rev = revision.normal_revision(column)
    return (
        df.withColumn("normal_revision", rev)
        .withColumn("revision_kind", revision.revision_kind(F.col("normal_revision")))
        .withColumn("revision_rank", revision.revision_rank(F.col("normal_revision")))
    )


def revision_profile(df: DataFrame, key: str, column: str) -> DataFrame:
    """Blank and invalid revisions per document, and the highest valid rank."""
    rev = revision.normal_revision(column)
    rank = revision.revision_rank(rev)
    return df.groupBy(key).agg(
        F.count_if(rev == "").alias("blank"),
        F.count_if((rev != "") & (rank < 0)).alias("invalid"),
        F.max(rank).alias("top_rank"),
    )


def revision_next(df: DataFrame, column: str) -> DataFrame:
    rev = revision.normal_revision(column)
    return df.withColumn("normal_revision", rev).withColumn(
        "next_revision", revision.revision_next(F.col("normal_revision"))
    )


def version_from_name(c: Column | str) -> Column:
    """Version written at the end of a file name."""
    name = F.upper(F.regexp_replace(F.element_at(F.split(text.text(c), r"[\\/]"), -1), r"(?i)\.(xlsx|xlsm|xls)$", ""))
    name = F.regexp_replace(name, r"\s+\(\d+\)$", "")
    standard = F.regexp_extract(name, r"_\d{4}[_-](\d+|[A-Z]+\d*)$", 1)
    explicit = F.regexp_extract(name, r"(?:^|[_\s-])REV(?:ISAO)?[_\s-]*(\d+|[A-Z]+\d*)$", 1)
    return F.when(standard != "", standard).otherwise(explicit)


def version_newest(df: DataFrame, keys: list[str], version: str, source: str) -> DataFrame:
    """Greatest version per key: numbers before letter codes, then prefix, then number."""
    given = F.regexp_replace(F.upper(text.text(version)), r"\s+", "")
    value = F.when(given != "", given).otherwise(version_from_name(source))
    parsed = df.withColumn("_v", value).filter(F.col("_v").rlike(r"^(\d+|[A-Z]+\d*)$"))
    v = F.col("_v")
    number = F.regexp_extract(v, r"(\d*)$", 1)
    return latest_by(
        parsed,
        keys,
        [
            F.when(v.rlike(r"^\d+$"), 0).otherwise(1),
            F.regexp_extract(v, "^([A-Z]*)", 1),
            F.when(number == "", F.lit(0)).otherwise(number.try_cast("bigint")),
        ],
        [v.alias("newest_version")],
    )


def code_decompose(df: DataFrame, column: str, families: list[tuple[str, str, dict[str, int]]]) -> DataFrame:
    """Split codes by the first family pattern ``(name, regex, {part: group})`` that matches."""
    code = F.regexp_replace(text.text(column), rf"(?i)\.({codes.FILE_EXTENSIONS})$", "")
    parts = sorted({p for _, _, groups in families for p in groups})
    matched = [code.rlike(rx) for _, rx, _ in families]
    pick = lambda values: F.coalesce(*[F.when(m, x) for m, x in zip(matched, values)], F.lit(""))
    out = df.withColumn("code_family", pick([F.lit(name) for name, _, _ in families]))
    for p in parts:
        out = out.withColumn(
            f"code_{p}",
            pick([F.regexp_extract(code, rx, groups[p]) if p in groups else F.lit("") for _, rx, groups in families]),
        )
    return out


def multi_code_flag(c: Column | str, pattern: str) -> Column:
    """True when a cell holds more than one code."""
    return F.size(F.regexp_extract_all(text.norm(c), F.lit(f"({pattern})"), F.lit(1))) > 1


def strip_unit_prefix(c: Column, unit: str) -> Column:
    """Drop a leading unit name when what follows still looks like a tag."""
    rest = F.regexp_extract(c, rf"(?i)^{unit}[-_./\s]+(.+)$", 1)
    looks = rest.rlike("[A-Za-z]") & rest.rlike(r"\d") & rest.rlike(r"[-_./]")
    return F.when(looks, rest).otherwise(c)


Rule = tuple[str, str, Column]


def code_validate(df: DataFrame, rules: list[Rule], family: Column) -> DataFrame:
    """Violated rules per row; a rule is ``(family, name, condition that must hold)``."""
    broken = [F.when((family == fam) & ~F.coalesce(ok, F.lit(False)), F.lit(name)) for fam, name, ok in rules]
    return df.withColumn("code_family", family).withColumn("violations", F.array_compact(F.array(*broken)))


def violation_profile(df: DataFrame) -> DataFrame:
    return (
        df.select("code_family", F.explode("violations").alias("rule"))
        .groupBy("code_family", "rule")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def category_infer(value: Column, official: list[str], keywords: list[tuple[str, str]], code: Column,
                   code_map: dict[str, str]) -> Column:
    """Category of a free text: exact option, longest option in the prefix, tail or whole, keyword, code."""
    by_length = sorted(official, key=lambda o: (-len(o), o))
    plain = {o: o.upper().translate(str.maketrans(text.ACCENTED, text.PLAIN)) for o in official}

    def test(source: Column, parts: Column) -> Column:
        tail = F.coalesce(F.get(parts, F.size(parts) - 1), source)
        prefix = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise(F.lit(""))
        tests = [F.when(source == plain[o], F.lit(o)) for o in official]
        tests += [F.when(F.contains(prefix, F.lit(plain[o])), F.lit(o)) for o in by_length]
        tests += [F.when(F.contains(tail, F.lit(plain[o])), F.lit(o)) for o in by_length]
        tests += [F.when(F.contains(source, F.lit(plain[o])), F.lit(o)) for o in by_length if len(o) >= 5]
        tests += [F.when(F.contains(source, F.lit(k)), F.lit(lab)) for k, lab in keywords]
        return F.coalesce(*tests, text.literal_map(code_map, text.norm(code), ""))

    pieces = lambda source: F.filter(F.transform(F.split(source, "/"), lambda p: F.trim(p)), lambda p: p != "")
    return text.let(text.norm(value), lambda s: text.let(pieces(s), lambda parts: test(s, parts)))


def batch_next(df: DataFrame, column: str, prefix: str, offset: int = 0) -> DataFrame:
    """Last used sequence per year and the code ``offset`` steps after the next free one."""
    seq, year = codes.batch_sequence(column, prefix), codes.batch_year(column, prefix)
    used = df.select(seq.alias("s"), year.alias("batch_year")).filter("s is not null")
    following = F.col("last_sequence") + 1 + offset
    return (
        used.groupBy("batch_year")
        .agg(F.max("s").alias("last_sequence"), F.count(F.lit(1)).alias("row_count"))
        .withColumn(
            "next_code",
            F.when(following <= 9999, codes.batch_code(prefix, following, F.col("batch_year"))).otherwise(F.lit("")),
        )
        .withColumn("exhausted", following > 9999)
    )


def wbs_ancestors(df: DataFrame, column: str) -> DataFrame:
    """One row per work code and ancestor, the code itself first."""
    code = codes.wbs_norm(column)
    return (
        df.withColumn("work_code", code)
        .filter(F.col("work_code") != "")
        .withColumn("ancestor", F.explode(codes.wbs_prefixes(F.col("work_code"))))
        .withColumn("depth", codes.wbs_depth(F.col("ancestor")))
    )


def common_prefix_depth(a: Column, b: Column) -> Column:
    """Number of leading parts two dotted codes share."""
    return F.size(F.array_intersect(codes.wbs_prefixes(a), codes.wbs_prefixes(b)))


def alias_expand(df: DataFrame, column: str) -> DataFrame:
    """A compact tag ``X-01A-B/C`` also stands for X-01A, X-01B and X-01C."""
    v = text.text(column)
    shape = r"(?i)^(.*?\d+)([A-Z])((?:[-/][A-Z])+)$"
    stem, first, more = (F.regexp_extract(v, shape, i) for i in (1, 2, 3))
    letters = F.filter(F.split(F.concat(first, more), "[-/]"), lambda x: x != "")
    expanded = F.when(v.rlike(shape), F.transform(letters, lambda x: F.concat(stem, x))).otherwise(
        F.array().cast("array<string>")
    )
    return df.withColumn("alias", F.explode(F.array_distinct(F.concat(F.array(v), expanded)))).withColumn(
        "alias_key", text.loose_key("alias")
    )


def span_keys(df: DataFrame, column: str, min_len: int = 6) -> DataFrame:
    """Joined token runs with a digit; seeds of containment joins."""
    spans = codes.token_spans(column, None, min_len, need_digit=True)
    whole = text.loose_key(column)
    return df.withColumn("span", F.explode(F.filter(spans, lambda s: s != whole)))


def without_parentheses(v: Column) -> Column:
    """Text without what stands in parentheses, however deep: each pass takes the innermost pairs."""

    def innermost_first(x: Column) -> Column:
        opened = F.length(x) - F.length(F.replace(x, F.lit("("), F.lit("")))
        passes = F.when(opened > 0, F.aggregate(F.sequence(F.lit(1), opened), x, lambda acc, _: F.regexp_replace(acc, r"\([^()]*\)", " ")))
        return F.coalesce(passes, x)

    v = text.let(v, innermost_first)
    v = F.trim(F.regexp_replace(v, text.RUN, " "))
    v = F.regexp_replace(v, r"\s+([,.;:])", "$1")
    return F.regexp_replace(v, r"([,.;:])(?:\s*[,.;:])+", "$1")


def title_part(c: Column | str) -> Column:
    """One cleaned piece of a title."""
    v = text.let(strip_errors(c), lambda x: rewrite(x, TITLE_RULES, TITLE_SIGNS))
    bare = lambda x: F.replace(x, F.lit('"'), F.lit(""))
    even = text.let(v, lambda x: F.when((F.length(x) - F.length(bare(x))) % 2 == 1, bare(x)).otherwise(x))
    return F.when(text.norm(c).isin(*UNAVAILABLE), F.lit("")).otherwise(even)


def title_parts(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """``df`` with ``title_part`` of some columns under new names.

    One column per step: a rewriting reads its input several times, and a nested expression would work it out each time.
    """
    gone = {name: f"{name}_gone" for name in columns}
    df = df.withColumns({**{name: text.text(c) for name, c in columns.items()}, **{gone[name]: text.norm(c).isin(*UNAVAILABLE) for name, c in columns.items()}})
    bare = lambda x: F.replace(x, F.lit('"'), F.lit(""))
    steps = [
        lambda x: F.trim(F.regexp_replace(rewrite(x, ERROR_RULES, ERROR_SIGNS), text.RUN, " ")), lambda x: rewrite(x, TITLE_RULES, TITLE_SIGNS),
        lambda x: F.when((F.length(x) - F.length(bare(x))) % 2 == 1, bare(x)).otherwise(x),
    ]
    for step in steps:
        df = df.withColumns({name: step(F.col(name)) for name in columns})
    return df.withColumns({name: F.when(F.col(gone[name]), F.lit("")).otherwise(F.col(name)) for name in columns}).drop(*gone.values())


def title_clean(c: Column | str) -> Column:
    return text.norm(text.let(without_parentheses(text.text(c)), title_part))


# Points a title loses per issue.
TITLE_PENALTIES = {
    "empty": 100, "placeholder": 55, "reserved": 0, "format": 6, "extension": 18, "document": 40, "short": 24,
    "duplicate": 12, "parentheses": 12, "generic": 22, "characters": 5,
}


def title_quality_score(df: DataFrame, title: str, document: str) -> DataFrame:
    """Suggested spelling, issues, score and status of every title."""
    spelled = F.regexp_replace(F.regexp_replace("_raw", "[‒-―]", "-"), text.RUN, " ")
    spelled = F.regexp_replace(F.regexp_replace(spelled, r"\s+([,;:.])", "$1"), r"([,;:])\1+", "$1")
    staged = (
        df.withColumn("_raw", text.text(title))
        .withColumn("suggested", F.upper(F.trim(spelled)))
        .withColumn("_plain", text.norm("suggested"))
        .withColumn("_words", F.size(F.filter(F.split("_plain", "[^A-Z0-9]+"), lambda t: F.length(t) >= 3)))
        .withColumn("_kind", text.first_rule(F.col("_plain"), codes.TITLE_KINDS))
    )
    raw, suggested, plain = F.col("_raw"), F.col("suggested"), F.col("_plain")
    has, reserved = raw != "", plain.rlike(r"\bRESERVADO\b")
    count = lambda ch: F.length(raw) - F.length(F.replace(raw, F.lit(ch), F.lit("")))
    tests = {
        "empty": ~has,
        "placeholder": has & plain.rlike(r"\b(SEM TITULO|A DEFINIR|TBD|XXX|NAO INFORMADO|N/A)\b"),
        "reserved": reserved,
        "format": has & (suggested != raw),
        "extension": raw.rlike(r"(?i)\.(PDF|DOCX?|XLSX?|DWG|DGN|PPTX?)\b"),
        "document": (F.col(document) != "") & (text.canon_key(title) == text.canon_key(document)),
        "short": has & (F.length(suggested) < 8) & ~reserved,
        "duplicate": plain.rlike(r"\b([A-Z0-9]{3,})\s+\1\b"),
        "parentheses": count("(") != count(")"),
        "generic": (F.col("_kind") != "") & (F.col("_words") <= 2) & ~reserved,
        "characters": suggested.rlike(r"(?i)[^A-ZÀ-Ý0-9 ()_\-/,.;:+ºª%&]"),
    }
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in tests.items()]))
    weight = F.create_map(*[F.lit(x) for kv in TITLE_PENALTIES.items() for x in kv])
    lost = F.aggregate("issues", F.lit(0), lambda acc, name: acc + F.element_at(weight, name))
    return (
        staged.withColumn("issues", found)
        .withColumn("score", F.greatest(F.lit(0), F.lit(100) - lost))
        .withColumn(
            "title_status",
            F.when(F.array_contains("issues", "reserved"), "reserved")
            .when(F.col("score") >= 88, "good")
            .when(F.col("score") >= 68, "attention")
            .otherwise("review"),
        )
        .drop("_raw", "_plain", "_words", "_kind")
    )


IDENTIFIER = r"\b[A-Z0-9]{1,4}(?:-[A-Z])?-[A-Z0-9][A-Z0-9._/-]{2,}\b"


def strip_type(title: Column, kind: Column) -> Column:
    """Title without a leading type text and the separator after it."""
    cut = lambda n: text.let(
        text.norm(kind),
        lambda k: F.when((k != "") & F.startswith(n, k), F.substring(n, F.length(k) + 1, F.length(n))).otherwise(n),
    )
    return F.regexp_replace(text.let(text.norm(title), cut), r"^[\s:\-]+|[\s:\-]+$", "")


def generic_title(title: Column, kind: Column) -> Column:
    """True when a title says too little: fewer than two content words and no identifier."""
    words = lambda rest: F.size(F.filter(F.split(rest, "[^A-Z0-9]+"), lambda t: F.length(t) >= 3))
    little = lambda rest: ((words(rest) < 2) & ~rest.rlike(IDENTIFIER)) | (rest == text.norm(kind))
    return (text.norm(title) != "RESERVADO") & (is_unavailable(title) | text.let(strip_type(title, kind), little))


def claimed_revision(name: Column, code: Column) -> Column:
    """Revision written after the code in a file name, normal form; '' when there is none."""
    stem = F.regexp_replace(text.text(name), r"\.[^.]+$", "")
    at = F.instr(F.upper(stem), F.upper(code))
    tail = F.when((code != "") & (at > 0), F.substring(stem, at + F.length(code), F.length(stem))).otherwise(stem)
    labelled = F.regexp_extract(tail, r"(?i)[_ -]REV(?:ISAO)?[_ -]?([A-Z]{1,3}\d*|0)$", 1)
    bare = F.regexp_extract(tail, r"(?i)[_ -]([A-Z]{1,3}\d*|0)$", 1)
    return revision.normal_revision(F.when(labelled != "", labelled).otherwise(bare))


def revision_from_text(page: Column, code: Column, before: int = 180, after: int = 260) -> Column:
    """The one valid revision named in a window around the code, '' when none or several."""
    value, key = text.canon_key(page), text.canon_key(code)
    at = F.instr(value, key)
    start = F.greatest(F.lit(1), at - before)
    window = F.substring(value, start, at + F.length(key) + after - start)
    found = F.regexp_extract_all(
        window, F.lit(r"(?:REVISAO|\bREV\.?|\bREVISION)\s*[:\-]?\s*([A-HJ-NP-Z]{1,3}|0)\b"), F.lit(1)
    )
    valid = F.array_distinct(F.filter(found, lambda r: revision.revision_kind(r) != "invalid"))
    return F.when((key != "") & (at > 0) & (F.size(valid) == 1), F.get(valid, F.lit(0))).otherwise(F.lit(""))


def proposed_file_name(name: Column, code: Column, rev: Column) -> Column:
    """Code, revision suffix unless it is 0, and the extension of the given name (.pdf when missing)."""
    ext = F.lower(F.regexp_extract(text.text(name), r"(\.[^.]+)$", 1))
    ext = F.when(ext == "", F.lit(".pdf")).otherwise(ext)
    suffix = F.when((rev != "") & (rev != "0"), F.concat(F.lit("_"), rev)).otherwise(F.lit(""))
    return F.concat(code, suffix, ext)


def filename_validate(df: DataFrame, name: str, code: str, rev: str) -> DataFrame:
    wanted = revision.normal_revision(rev)
    claimed = claimed_revision(F.col(name), F.col(code))
    return (
        df.withColumn("expected_name", proposed_file_name(F.col(name), F.col(code), wanted))
        .withColumn("claimed_revision", claimed)
        .withColumn("name_ok", text.canon_key(name) == text.canon_key("expected_name"))
        .withColumn("revision_ok", F.when(wanted == "0", claimed == "").otherwise(claimed == wanted))
    )


def option_list_validate(df: DataFrame, options: dict[str, list[str]]) -> DataFrame:
    """Fields whose value is not in the official list of the field."""
    plain = lambda xs: [x.upper().translate(str.maketrans(text.ACCENTED, text.PLAIN)) for x in xs]
    off = [F.when(~text.norm(f).isin(*plain(xs)), F.lit(f)) for f, xs in options.items()]
    return df.withColumn("off_list", F.array_compact(F.array(*off)))


# What each marker prefix of a non-tagged item stands for.
NON_TAGGED_PREFIXES = {
    "LBN": "LEITO NOVO", "LBE": "LEITO EXISTENTE", "LBR": "LEITO REMANESCENTE", "ETN": "ELETRODUTO NOVO",
    "ETE": "ELETRODUTO EXISTENTE", "ETR": "ELETRODUTO REMANESCENTE", "LMN": "LUMINÁRIA NOVA",
    "LME": "LUMINÁRIA EXISTENTE", "LMR": "LUMINÁRIA REMANESCENTE", "SPN": "SUPORTE NOVO", "SPE": "SUPORTE EXISTENTE",
    "EMT": "ESTRUTURA METÁLICA", "VM": "VÁLVULA MANUAL", "CNXN": "CONEXÃO NOVA", "CNXE": "CONEXÃO EXISTENTE",
    "MISN": "MISCELÂNEA NOVA", "MISE": "MISCELÂNEA EXISTENTE", "AND": "ANDAIME", "BOB": "CABO NOVO",
    "PIPE": "ELETRODUTO", "NF": "NOTA FISCAL", "ENV": "ENVELOPE", "CI": "CAIXA DE PASSAGEM", "CX": "CAIXA DE INSPEÇÃO",
    "CAN": "CANALETA", "C": "CABO",
}


def nontagged_decode(df: DataFrame, tag: str, exact: DataFrame | None = None,
                     prefixes: dict[str, str] | None = None) -> DataFrame:
    """``nt-PREFIX-rest`` as what and where; an exact dictionary row (tag, description) wins.

    The grammar knows sections (1X185MM), lengths (469M), sizes (100X50), and drawing numbers at the end.
    """
    v = text.text(tag)
    body = F.regexp_extract(v, r"(?i)^nt-(.+)$", 1)
    parts = F.split(F.upper(body), "-")
    head = F.regexp_extract(F.get(parts, F.lit(0)), "^([A-Z]+)", 1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    what = text.literal_map(prefixes or NON_TAGGED_PREFIXES, head, "")
    where = F.array_join(
        F.transform(
            rest,
            lambda p: F.when(p.rlike(r"^\d+X\d+MM$"), F.concat(F.regexp_replace(p, r"^(\d+)X(\d+)MM$", "$1 X $2"), F.lit(" MM2")))
            .when(p.rlike(r"^\d+X\d+$"), F.concat(F.regexp_replace(p, "X", " X "), F.lit(" MM")))
            .when(p.rlike(r"^\d+M$"), F.regexp_replace(p, "M$", " M"))
            .otherwise(p),
        ),
        " ",
    )
    out = df.withColumn("nt_body", body).withColumn("nt_what", F.when(body != "", what).otherwise(F.lit("")))
    out = out.withColumn("nt_where", F.when(F.col("nt_what") != "", where).otherwise(F.lit("")))
    rule = F.when(F.col("nt_what") == "", F.lit("")).when(F.col("nt_where") == "", F.col("nt_what")).otherwise(
        F.concat_ws(" - ", "nt_what", "nt_where")
    )
    if exact is None:
        return out.withColumn("nt_description", rule).withColumn("nt_exact", F.lit(False))
    given = exact.select(text.norm("tag").alias("_t"), F.col("description").alias("_d")).groupBy("_t").agg(F.min("_d").alias("_d"))
    joined = out.join(given, (text.norm(tag) == F.col("_t")) & (F.col("nt_body") != ""), "left")
    return (
        joined.withColumn("nt_description", F.coalesce("_d", rule))
        .withColumn("nt_exact", F.col("_d").isNotNull())
        .drop("_t", "_d")
    )
