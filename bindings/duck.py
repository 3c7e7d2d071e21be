"""DuckDB spellings of the shared expressions, for the oracle SQL."""

from __future__ import annotations

from docweave.functions import codes, text
from docweave.functions.revision import ALPHABET, STATUS_KINDS

from .views import duck_view

ESCAPES = {"": "\\x{000b}"}


def _cls() -> str:
    return (
        "[\\t\\n\\x{000b}\\f\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}"
        "\\x{3000}\\x{feff}]"
    )


def rx(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{repl}', 'g')"


def txt(x: str) -> str:
    return rx(f"coalesce(cast({x} as varchar), '')", f"^{_cls()}+|{_cls()}+$")


def norm(x: str) -> str:
    up = f"upper(replace(coalesce(cast({x} as varchar), ''), 'ß', 'ss'))"
    plain = f"translate({up}, '{text.ACCENTED}–—', '{text.PLAIN}--')"
    return f"trim({rx(rx(plain, '[\\x{0300}-\\x{036f}]'), _cls() + '+', ' ')})"


def key(x: str) -> str:
    return rx(norm(x), " ?([_.\\-]) ?", "\\1")


def loose(x: str) -> str:
    return rx(norm(x), "[^A-Z0-9]")


def request_key(x: str) -> str:
    return f"regexp_replace({key(x)}, '\\.({codes.FILE_EXTENSIONS})$', '')"


def ptag(x: str) -> str:
    v = f"regexp_replace({norm(x)}, '^NT[-_]', '')"
    v = rx(rx(v, "[/_]+", "-"), " ")
    return rx(rx(v, "-+", "-"), "^-|-$")


def ctag(x: str) -> str:
    runs = f"regexp_extract_all({norm(x)}, '[A-Z]+|[0-9]+')"
    return f"array_to_string(list_transform({runs}, lambda r: case when regexp_matches(r, '^0+$') then '0' else ltrim(r, '0') end), '')"


def rev(x: str) -> str:
    return f"replace(regexp_replace({norm(x)}, '^REV(ISAO)?\\.?\\s*', ''), ' ', '')"


def rev_kind(r: str) -> str:
    return (
        f"case when regexp_full_match({r}, '0|[{ALPHABET}]+') then 'standard' "
        f"when regexp_full_match({r}, '[{ALPHABET}]+[1-9][0-9]*') then 'field' else 'invalid' end"
    )


def rev_rank(r: str) -> str:
    lets = f"regexp_extract({r}, '^[A-Z]+')"
    val = (
        f"cast(coalesce(list_sum(list_transform(generate_series(1, length({lets})), "
        f"lambda i: instr('{ALPHABET}', {lets}[i]) * power(24, length({lets}) - i))), 0) as bigint)"
    )
    return (
        f"case when {r} = '0' then 0 when ({rev_kind(r)}) = 'standard' then {val} * 1000 "
        f"when ({rev_kind(r)}) = 'field' then {val} * 1000 + cast(regexp_extract({r}, '[0-9]+$') as bigint) "
        f"else -1 end"
    )


def rev_next(r: str) -> str:
    """Successor by value: rank + 1 written in the alphabet again, for up to three letters."""
    n = f"(cast(({rev_rank(r)}) / 1000 as bigint) + 1)"
    ch = lambda e: f"substr('{ALPHABET}', cast({e} as bigint) + 1, 1)"
    return (
        f"case when ({rev_kind(r)}) <> 'standard' then '' when {n} <= 24 then {ch(f'{n} - 1')} "
        f"when {n} <= 600 then concat({ch(f'({n} - 25) // 24')}, {ch(f'({n} - 25) % 24')}) "
        f"else concat({ch(f'({n} - 601) // 576')}, {ch(f'(({n} - 601) // 24) % 24')}, {ch(f'({n} - 601) % 24')}) end"
    )


def kind(x: str) -> str:
    rows = " ".join(f"when '{s}' then '{k}'" for s, k in STATUS_KINDS.items())
    return f"case {norm(x)} {rows} else 'unknown' end"


def toks(x: str, min_len: int = 3, stop: list[str] | None = None) -> str:
    base = f"list_distinct(list_filter(regexp_split_to_array({norm(x)}, '[^A-Z0-9]+'), lambda t: length(t) >= {min_len}))"
    if not stop:
        return base
    words = ", ".join(f"'{s}'" for s in stop)
    return f"list_filter({base}, lambda t: t not in ({words}))"


def title_toks(x: str) -> str:
    return toks(x, 3, text.STOP_WORDS)


def title_kind(x: str) -> str:
    n = norm(x)
    return "case " + " ".join(f"when regexp_matches({n}, '{p}') then '{k}'" for p, k in codes.TITLE_KINDS) + " else '' end"


def path_key(x: str) -> str:
    v = norm(x)
    for a, b in codes.PATH_TYPOS.items():
        v = f"replace({v}, '{a}', '{b}')"
    return rx(v, " ?\\| ?", "|")


def path_complete(x: str) -> str:
    return f"len(list_filter(string_split({txt(x)}, '|'), lambda p: trim(p) <> '')) >= 3"


def unzero(x: str) -> str:
    """Dotted number without leading zeros in its parts."""
    return (
        f"array_to_string(list_transform(string_split({x}, '.'), lambda p: case when p = '' then '' "
        f"when regexp_matches(p, '^0+$') then '0' else ltrim(p, '0') end), '.')"
    )


def wbs(x: str) -> str:
    return unzero(f"regexp_extract({txt(x)}, '(\\d+(\\.\\d+){{1,6}})', 1)")


BR = "^(\\d{1,2})/(\\d{1,2})/(\\d{4}|\\d{2})(\\s.*)?$"
ISO = "^(\\d{4})-(\\d{2})-(\\d{2})([T ].*)?$"


def date(x: str) -> str:
    v = txt(x)
    y = f"regexp_extract({v}, '{BR}', 3)"
    br = (
        f"try_cast(concat(case when length({y}) = 2 then '20' || {y} else {y} end, '-', lpad(regexp_extract({v}, '{BR}', 2), 2, '0'), "
        f"'-', lpad(regexp_extract({v}, '{BR}', 1), 2, '0')) as date)"
    )
    return (
        f"case when regexp_matches({v}, '{BR}') then {br} when regexp_matches({v}, '{ISO}') then try_cast(substr({v}, 1, 10) as date) "
        f"when regexp_matches({v}, '^\\d{{5,6}}(\\.\\d+)?$') and try_cast({v} as double) > 20000 "
        f"then date '1899-12-30' + cast(floor(try_cast({v} as double)) as integer) end"
    )


def date_text(x: str) -> str:
    return f"coalesce(cast(cast({date(x)} as date) as varchar), '')"


def day(x: str) -> str:
    return f"cast(coalesce(date_diff('day', date '1970-01-01', cast({date(x)} as date)), 0) as bigint)"


def seq(x: str, prefix: str = "AL") -> str:
    return f"cast(nullif(regexp_extract(upper({txt(x)}), '^{prefix}-(\\d{{4}})-(\\d{{4}})$', 1), '') as integer)"


def yr(x: str, prefix: str = "AL") -> str:
    return f"cast(nullif(regexp_extract(upper({txt(x)}), '^{prefix}-(\\d{{4}})-(\\d{{4}})$', 2), '') as integer)"


def v(name: str) -> str:
    return duck_view(name)


def rules(n: str, pairs: list[tuple[str, str]], default: str = "") -> str:
    return "case " + " ".join(f"when regexp_matches({n}, '{p}') then '{lab}'" for p, lab in pairs) + f" else '{default}' end"
