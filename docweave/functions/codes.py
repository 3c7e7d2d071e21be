"""Expressions over document codes, batch codes, dotted work codes and '|' paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import canon_key, first_rule, let, norm, text

FILE_EXTENSIONS = "PDF|DOC|DOCX|XLS|XLSX|XLSM|DWG|DGN|PPT|PPTX"
# Misspellings of folder names that must compare equal.
PATH_TYPOS = {"EDECUCAO": "EXECUCAO", "INTRUMENT": "INSTRUMENT"}
# Title kinds in order of test.
TITLE_KINDS = [
    (r"\bCURRICULO\b", "CURRICULO"),
    (r"\bIEIS\b|INSTRUCAO DE EXECUCAO E INSPECAO DE SOLDAGEM", "IEIS"),
    (r"\bEPS\b|ESPECIFICACAO DE PROCEDIMENTO DE SOLDAGEM", "EPS"),
    (r"\bRQPS\b|QUALIFICACAO DE PROCEDIMENTO DE SOLDAGEM", "RQPS"),
    (r"\bRQS\b|QUALIFICACAO DE SOLDADOR", "RQS"),
    (r"\bRSQ\b|RELACAO DE SOLDADORES QUALIFICADOS", "RSQ"),
    (r"\bRIR\b|INSPECAO DE RECEBIMENTO", "RIR"),
    (r"\bRNC\b|RELATORIO DE NAO CONFORMIDADE", "RNC"),
    (r"\bDATA BOOK\b", "DATA BOOK"),
    (r"\bPLANO\b", "PLANO"),
    (r"\bPROCEDIMENTO\b", "PROCEDIMENTO"),
    (r"\bRELATORIO\b", "RELATORIO"),
    (r"\bCERTIFICACAO\b|\bCERTIFICADO\b", "CERTIFICADO"),
]
# Subject patterns over the text, then over the code when the text names none.
SUBJECTS_TEXT = [
    (r"\bMOTORES?\b", "MOTOR"),
    (r"\bCABOS?\b|\bBOBINA\b", "CABO"),
    (r"\bTRANSFORMADOR(ES)?\b", "TRANSFORMADOR"),
    (r"\bCAIXAS?\b|\bBORNE\b", "CAIXA"),
    (r"\bINFRAESTRUTURA\b|\bELETRODUTO\b|\bLEITO\b|\bBANDEJA\b", "INFRAESTRUTURA"),
    (r"\bPAINEL(ES|S)?\b", "PAINEL"),
    (r"\bVASOS?\b|\bTANQUES?\b", "VASO_TANQUE"),
    (r"\bFORNOS?\b|\bQUEIMADORES?\b", "FORNO_QUEIMADOR"),
    (r"\bTURBINAS?\b", "TURBINA"),
    (r"\bESTRUTURA METALICA\b", "ESTRUTURA_METALICA"),
    (r"\bACABAMENTO\b", "ACABAMENTO"),
]
SUBJECT_ALONE = (r"\bINSTRUMENTACAO\b", "INSTRUMENTO")


def strip_extension(key: Column, extensions: str = FILE_EXTENSIONS) -> Column:
    return F.regexp_replace(key, rf"\.({extensions})$", "")


def request_key(c: Column | str) -> Column:
    return strip_extension(canon_key(c))


def title_kind(c: Column | str) -> Column:
    return first_rule(norm(c), TITLE_KINDS)


def subjects(title: Column, code_rules: list[tuple[str, str]] | None = None, code: Column | None = None,
             text_rules: list[tuple[str, str]] | None = None, alone: tuple[str, str] | None = SUBJECT_ALONE) -> Column:
    """Sorted set of subject labels of a text; code patterns are used only when the text names none."""
    labels = lambda x, rules: F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(lab)) for p, lab in rules]))

    def by_text(x: Column) -> Column:
        found = labels(x, text_rules or SUBJECTS_TEXT)
        if not alone:
            return found
        only = F.when(x.rlike(alone[0]), F.array(F.lit(alone[1]))).otherwise(F.array().cast("array<string>"))
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(only))

    found = let(F.regexp_replace(norm(title), "[^A-Z0-9]+", " "), by_text)
    if code_rules:
        by_code = let(norm(code), lambda x: labels(x, code_rules))
        found = let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(by_code))
    return F.array_sort(F.array_distinct(found))


def path_key(c: Column | str, typos: dict[str, str] | None = None) -> Column:
    value = norm(c)
    for wrong, right in (PATH_TYPOS if typos is None else typos).items():
        value = F.replace(value, F.lit(wrong), F.lit(right))
    return F.replace(F.replace(value, F.lit(" |"), F.lit("|")), F.lit("| "), F.lit("|"))


def path_levels(c: Column | str) -> Column:
    parts = F.transform(F.split(text(c), r"\|"), lambda p: text(p))
    return F.filter(parts, lambda p: p != "")


def path_complete(c: Column | str) -> Column:
    return F.size(path_levels(c)) >= 3


def unzero(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.regexp_replace(p, r"^0+(?=\d)", ""))


def wbs_norm(c: Column | str) -> Column:
    """First dotted number of 2 to 7 parts, each part without leading zeros."""
    found = F.regexp_extract(text(c), r"(\d+(\.\d+){1,6})", 1)
    return F.array_join(unzero(F.split(found, r"\.")), ".")


def leading_code(c: Column | str) -> Column:
    found = F.regexp_extract(text(c), r"^(\d+(\.\d+)*)", 1)
    return F.array_join(unzero(F.split(found, r"\.")), ".")


def wbs_depth(code: Column) -> Column:
    return F.when(code == "", F.lit(0)).otherwise(F.size(F.split(code, r"\.")))


def wbs_prefixes(code: Column) -> Column:
    """The code itself and all its ancestors, deepest first."""
    cut = lambda parts: F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")
    )
    return let(F.split(code, r"\."), cut)


def batch_sequence(c: Column | str, prefix: str) -> Column:
    """Sequence of ``PREFIX-0001-2024``, null when the value is no batch code."""
    found = F.regexp_extract(F.upper(text(c)), rf"^{prefix}-(\d{{4}})-(\d{{4}})$", 1)
    return F.when(found != "", found.try_cast("int"))


def batch_year(c: Column | str, prefix: str) -> Column:
    found = F.regexp_extract(F.upper(text(c)), rf"^{prefix}-(\d{{4}})-(\d{{4}})$", 2)
    return F.when(found != "", found.try_cast("int"))


def batch_code(prefix: str, sequence: Column, year: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.lpad(sequence.cast("string"), 4, "0"), F.lit("-"), year.cast("string"))


def sequence_tail(c: Column | str) -> Column:
    """Number at the end of a code, null when there is none."""
    found = F.regexp_extract(F.regexp_replace(text(c), r"\.[A-Za-z0-9]+$", ""), r"[-_](\d{1,18})$", 1)
    return F.when(found != "", found.try_cast("bigint"))


def token_spans(c: Column | str, max_tokens: Column | None = None, min_len: int = 1, need_digit: bool = False, sep: str = "") -> Column:
    """Distinct contiguous token runs of ``norm``; ``max_tokens`` only spares runs that can hit nothing."""

    def runs(parts: Column) -> Column:
        starts = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
        return F.flatten(
            F.transform(
                starts,
                lambda i: F.transform(
                    F.sequence(F.lit(1), F.size(parts) - i + 1 if max_tokens is None else F.least(max_tokens, F.size(parts) - i + 1)),
                    lambda n: F.array_join(F.slice(parts, i, n), sep),
                ),
            )
        )

    spans = let(F.filter(F.split(norm(c), "[^A-Z0-9]+"), lambda t: t != ""), runs)
    keep = lambda s: (F.length(s) >= min_len) & s.rlike("[0-9]") if need_digit else F.length(s) >= min_len
    return F.array_distinct(F.filter(spans, keep))
