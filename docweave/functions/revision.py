"""Revision sequence: 0, then letters without I and O, then two letters, ...; field revisions add digits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import literal_map, norm

# The letters revisions use.
ALPHABET = "ABCDEFGHJKLMNPQRSTUVWXYZ"
# Official status wordings and the kind each one stands for.
STATUS_KINDS = {
    "NAO POSTADO": "not_posted",
    "EM ANALISE": "analysis",
    "COM COMENTARIOS": "advance",
    "SEM COMENTARIOS": "advance",
    "ACEITO SEM COMENTARIOS": "advance",
    "RECUSADO": "advance",
    "PARA CONSTRUCAO": "issued",
    "CONFORME CONSTRUIDO": "issued",
    "PARA COMPRA": "issued",
    "EM WORKFLOW": "pending",
    "PENDENTE CERTIFICACAO": "pending",
    "CANCELADO": "closed",
}
LETTERS = f"[{ALPHABET}]+"


def status_kind(c: Column | str) -> Column:
    return literal_map(STATUS_KINDS, norm(c), "unknown")


def normal_revision(c: Column | str) -> Column:
    return F.replace(F.regexp_replace(norm(c), r"^REV(ISAO)?\.?\s*", ""), F.lit(" "), F.lit(""))


def revision_kind(rev: Column) -> Column:
    """standard, field or invalid, of an already normal revision."""
    return (
        F.when(rev.rlike(f"^(0|{LETTERS})$"), "standard")
        .when(rev.rlike(f"^{LETTERS}[1-9][0-9]*$"), "field")
        .otherwise("invalid")
    )


def _letter_value(letters: Column) -> Column:
    digits = F.filter(F.split(letters, ""), lambda x: x != "")
    return F.aggregate(
        digits, F.lit(0).cast("bigint"), lambda acc, x: acc * len(ALPHABET) + F.instr(F.lit(ALPHABET), x)
    )


def revision_rank(rev: Column) -> Column:
    """0 for '0', 1000 per step of the letter sequence plus the field number, -1 when invalid."""
    kind = revision_kind(rev)
    letters = F.regexp_extract(rev, "^([A-Z]+)", 1)
    number = F.regexp_extract(rev, "([0-9]+)$", 1)
    base = _letter_value(letters) * 1000
    place = F.instr(F.lit(ALPHABET), rev)
    # most revisions are one character, which needs no pattern
    return (
        F.when(rev == "0", F.lit(0).cast("bigint"))
        .when(F.octet_length(rev) == 1, F.when(place > 0, place.cast("bigint") * 1000).otherwise(F.lit(-1).cast("bigint")))
        .when(kind == "standard", base)
        .when(kind == "field", base + number.try_cast("bigint"))
        .otherwise(F.lit(-1).cast("bigint"))
    )


def revision_next(rev: Column) -> Column:
    """Successor of a standard revision; '' for a field or invalid one."""
    stem = F.regexp_extract(rev, "^(.*?)Z*$", 1)
    tail = F.length(rev) - F.length(stem)
    last = F.substring(stem, -1, 1)
    bumped = F.substring(F.lit(ALPHABET), F.instr(F.lit(ALPHABET), last) + 1, F.lit(1))
    carried = F.concat(F.expr("''"), F.substring(stem, F.lit(1), F.length(stem) - 1), bumped)
    head = F.when(F.length(stem) == 0, F.lit("A")).otherwise(carried)
    following = F.concat(head, F.repeat(F.lit("A"), tail))
    return (
        F.when(rev == "0", F.lit("A"))
        .when(revision_kind(rev) == "standard", following)
        .otherwise(F.lit(""))
    )
