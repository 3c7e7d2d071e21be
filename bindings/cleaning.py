"""Cleaning and code-decomposition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import codes, text
from docweave.operators import cleaning as C, titles as T

from . import duck as d
from .registry import query

NOW = "2000-01-15"


@query("key_standardize", f"""select request_id, {d.norm('raw')} norm_key, {d.key('raw')} canon_key, {d.loose('raw')} loose_key,
  {d.ctag('raw')} compact_key from {d.v('requests')}""")
def _(load):
    return C.key_standardize(load("requests"), "raw").select("request_id", "norm_key", "canon_key", "loose_key", "compact_key")


@query("key_collisions", f"""select loose_key, count(distinct k) spellings, count(*) row_count, min(k) first_key, max(k) last_key
  from (select {d.loose('raw')} loose_key, {d.key('raw')} k from {d.v('requests')}) group by 1 having count(distinct k) > 1""")
def _(load):
    return C.key_collisions(load("requests"), "raw")


_BAD = "(?i)#(N/A|N/D|VALUE!|REF!|NAME\\?|DIV/0!|NUM!|NULL!)"


def _d_strip(x):
    v = d.rx(d.txt(x), _BAD, " ")
    v = d.rx(v, "\\s*\\|\\s*", " | ")
    v = d.rx(v, "^\\s*\\|\\s*|\\s*\\|\\s*$")
    v = d.rx(v, "\\|\\s*\\|", "|")
    v = d.rx(v, "\\s+([,;:])", "\\1")
    v = d.rx(v, "(\\s+[-–—]\\s+){2,}", " - ")
    return f"trim({d.rx(v, d._cls() + '+', ' ')})"


_UNAV = ", ".join(f"'{u}'" for u in C.UNAVAILABLE)


def _d_missing(x):
    return f"({d.norm(x)} in ({_UNAV}) or {_d_strip(x)} = '')"


@query("placeholder_nullify", f"""select row_id, {_d_missing('description')} description_missing,
  case when {_d_missing('description')} then '' else {_d_strip('description')} end description_clean from {d.v('mixed')}""")
def _(load):
    return C.placeholder_nullify(load("mixed"), ["description"]).select("row_id", "description_missing", "description_clean")


@query("placeholder_profile", f"""select c column_name, count(*) row_count, count(*) filter (where {_d_missing('x')}) missing,
  count(*) filter (where regexp_matches(x, '{_BAD}')) with_errors,
  count(*) filter (where not {_d_missing('x')} and {_d_strip('x')} <> {d.txt('x')}) changed from (
  select 'description' c, description x from {d.v('mixed')} union all select 'when_text', when_text from {d.v('mixed')}) group by 1""")
def _(load):
    return C.placeholder_profile(load("mixed"), ["description", "when_text"])


_STYLE = f"""case when {d.txt('when_text')} = '' then 'empty' when regexp_matches({d.txt('when_text')}, '{d.BR}') then 'br'
  when regexp_matches({d.txt('when_text')}, '{d.ISO}') then 'iso'
  when regexp_matches({d.txt('when_text')}, '^\\d{{5,6}}$') and try_cast({d.txt('when_text')} as double) > 20000 then 'serial' else 'other' end"""


@query("mixed_date_normalize", f"""select row_id, {_STYLE} date_style, {d.date_text('when_text')} date_value,
  coalesce(date_diff('day', cast({d.date('when_text')} as date), date '{NOW}') between -1 and 30, false) recent from {d.v('mixed')}""")
def _(load):
    return C.mixed_date_normalize(load("mixed"), "when_text", NOW).select("row_id", "date_style", "date_value", "recent")


@query("mixed_date_profile", f"""select {_STYLE} date_style, count(*) row_count, count({d.date('when_text')}) parsed,
  count(*) - count({d.date('when_text')}) unparsed from {d.v('mixed')} group by 1""")
def _(load):
    return C.mixed_date_profile(load("mixed"), "when_text")


@query("revision_rank", f"""select row_id, r normal_revision, {d.rev_kind('r')} revision_kind, cast({d.rev_rank('r')} as bigint) revision_rank
  from (select row_id, {d.rev('revision')} r from {d.v('mixed')})""")
def _(load):
    return C.revision_rank(load("mixed"), "revision").select("row_id", "normal_revision", "revision_kind", "revision_rank")


@query("revision_profile", f"""select document, count(*) filter (where r = '') blank,
  count(*) filter (where r <> '' and k < 0) invalid, max(k) top_rank from (select document, r, cast({d.rev_rank('r')} as bigint) k
  from (select document, {d.rev('revision')} r from {d.v('register')})) group by 1""")
def _(load):
    return C.revision_profile(load("register"), "document", "revision")


@query("revision_next", f"""select row_id, r normal_revision, {d.rev_next('r')} next_revision from (
  select row_id, {d.rev('revision')} r from {d.v('mixed')})""")
def _(load):
    return C.revision_next(load("mixed"), "revision").select("row_id", "normal_revision", "next_revision")


@query("version_newest", f"""select discipline, v newest_version from (select discipline, v, row_number() over (partition by discipline order by
  case when regexp_full_match(v, '\\d+') then 0 else 1 end desc, regexp_extract(v, '^[A-Z]*') desc,
  coalesce(try_cast(nullif(regexp_extract(v, '\\d*$'), '') as bigint), 0) desc) n from (select discipline, upper({d.txt('version')}) v
  from {d.v('register')}) where regexp_full_match(v, '\\d+|[A-Z]+\\d*')) where n = 1""")
def _(load):
    return C.version_newest(load("register"), ["discipline"], "version", "source")


FAMILIES = [("RL", r"^([A-Z]{2})-(\d+(?:\.\d+)*)-([A-Z]{3})-(\d+)$", {"type": 1, "work": 2, "class": 3, "sequence": 4}),
            ("ZZ", r"^(ZZ)-(\d+)$", {"type": 1, "sequence": 2})]
_RLX = "^([A-Z]{2})-(\\d+(?:\\.\\d+)*)-([A-Z]{3})-(\\d+)$"


@query("code_decompose", f"""select request_id, case when rl then 'RL' when zz then 'ZZ' else '' end code_family,
  case when rl then regexp_extract(c, '{_RLX}', 1) when zz then 'ZZ' else '' end code_type,
  case when rl then regexp_extract(c, '{_RLX}', 2) else '' end code_work, case when rl then regexp_extract(c, '{_RLX}', 3) else '' end code_class,
  case when rl then regexp_extract(c, '{_RLX}', 4) when zz then regexp_extract(c, '^ZZ-(\\d+)$', 1) else '' end code_sequence,
  {d.wbs("case when rl then regexp_extract(c, '" + _RLX + "', 2) else '' end")} work_code,
  len(regexp_extract_all({d.norm('raw')}, 'RL-[0-9.]+-[A-Z]{{3}}-[0-9]+')) > 1 multi_code
  from (select request_id, raw, c, regexp_matches(c, '{_RLX}') rl, regexp_matches(c, '^ZZ-\\d+$') zz from (
  select request_id, raw, regexp_replace({d.txt('raw')}, '(?i)\\.(pdf|docx?|xlsx?)$', '') c from {d.v('requests')}))""")
def _(load):
    out = C.code_decompose(load("requests"), "raw", FAMILIES)
    return out.select(
        "request_id", "code_family", "code_type", "code_work", "code_class", "code_sequence",
        codes.wbs_norm("code_work").alias("work_code"), C.multi_code_flag("raw", r"RL-[0-9.]+-[A-Z]{3}-[0-9]+").alias("multi_code"),
    )


def _rules():
    parts = F.split(text.text("raw"), "-")
    g = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return [
        ("RL", "four_groups", F.size(parts) == 4),
        ("RL", "work_code", g(1).rlike(r"^\d+(\.\d+){2}$")),
        ("RL", "class_code", g(2).isin("MEC", "CIV", "ELE", "TUB")),
        ("RL", "sequence", g(3).rlike(r"^\d{12}$")),
        ("OTHER", "known_type", F.lit(False)),
    ]


_VIOL = f"""select request_id, fam code_family, unnest(list_filter([
  case when fam = 'RL' and len(p) <> 4 then 'four_groups' end,
  case when fam = 'RL' and not regexp_matches(coalesce(p[2], ''), '^\\d+(\\.\\d+){{2}}$') then 'work_code' end,
  case when fam = 'RL' and coalesce(p[3], '') not in ('MEC', 'CIV', 'ELE', 'TUB') then 'class_code' end,
  case when fam = 'RL' and not regexp_matches(coalesce(p[4], ''), '^\\d{{12}}$') then 'sequence' end,
  case when fam = 'OTHER' then 'known_type' end], lambda x: x is not null)) rule
  from (select request_id, string_split({d.txt('raw')}, '-') p, case when {d.txt('raw')} like 'RL%' then 'RL' else 'OTHER' end fam from {d.v('requests')})"""


def _family():
    return F.when(F.startswith(text.text("raw"), F.lit("RL")), "RL").otherwise("OTHER")


@query("code_validate", f"""select request_id, code_family, rule from ({_VIOL})""")
def _(load):
    out = C.code_validate(load("requests"), _rules(), _family())
    return out.select("request_id", "code_family", F.explode("violations").alias("rule"))


@query("code_validate_profile", f"""select code_family, rule, count(*) row_count from ({_VIOL}) group by 1, 2""")
def _(load):
    return C.violation_profile(C.code_validate(load("requests"), _rules(), _family()))


OFFICIAL = ["CIVIL", "ELÉTRICA", "MECÂNICA", "TUBULAÇÃO"]
KEYWORDS = [("INSTRUMENT", "INSTRUMENTOS"), ("GERAL", "GERAL")]
CODE_MAP = {"CIV": "CIVIL", "ELE": "ELÉTRICA", "INS": "INSTRUMENTOS", "MEC": "MECÂNICA", "TUB": "TUBULAÇÃO"}
_PATHS = "concat(discipline, ' / ', case when row_no % 3 = 0 then '' when row_no % 3 = 1 then 'Área civil norte' else 'x' end)"
_N = d.norm(_PATHS)
_PARTS = f"list_filter(list_transform(string_split({_N}, '/'), lambda p: trim(p)), lambda p: p <> '')"
_OFF = [("MECANICA", "MECÂNICA"), ("ELETRICA", "ELÉTRICA"), ("TUBULACAO", "TUBULAÇÃO"), ("CIVIL", "CIVIL")]
_OFF_LEN = [("TUBULACAO", "TUBULAÇÃO"), ("ELETRICA", "ELÉTRICA"), ("MECANICA", "MECÂNICA"), ("CIVIL", "CIVIL")]


@query("category_infer", "select row_no, source_ts, case " + " ".join(f"when n = '{a}' then '{b}'" for a, b in _OFF)
       + " " + " ".join(f"when contains(pre, '{a}') then '{b}'" for a, b in _OFF_LEN)
       + " " + " ".join(f"when contains(tail, '{a}') then '{b}'" for a, b in _OFF_LEN)
       + " " + " ".join(f"when contains(n, '{a}') then '{b}'" for a, b in _OFF_LEN)
       + " when contains(n, 'INSTRUMENT') then 'INSTRUMENTOS' when contains(n, 'GERAL') then 'GERAL' "
       + " ".join(f"when cls = '{a}' then '{b}'" for a, b in CODE_MAP.items()) + f""" else '' end category from (
  select row_no, source_ts, {_N} n, coalesce(case when len({_PARTS}) > 0 then {_PARTS}[-1] end, {_N}) tail,
  coalesce(case when len({_PARTS}) > 1 then {_PARTS}[-2] end, '') pre, string_split(document, '-')[3] cls from {d.v('register')})""")
def _(load):
    value = F.expr(_PATHS)
    code = F.get(F.split("document", "-"), F.lit(2))
    return load("register").select("row_no", "source_ts", C.category_infer(value, OFFICIAL, KEYWORDS, code, CODE_MAP).alias("category"))


SUBJECT_CODES = [("-TUB-", "TUBO"), ("-CIV-", "OBRA")]
_SUB = f"regexp_replace({d.norm('title')}, '[^A-Z0-9]+', ' ', 'g')"


@query("subject_multilabel", "select row_no, source_ts, array_to_string(list_sort(list_distinct(case when len(a) > 0 then a when alone then ['INSTRUMENTO'] "
       "else b end)), '+') subjects from (select row_no, source_ts, list_filter([" + ", ".join(
           f"case when regexp_matches({_SUB}, '{p}') then '{k}' end" for p, k in codes.SUBJECTS_TEXT) + f"""], lambda x: x is not null) a,
  regexp_matches({_SUB}, '{codes.SUBJECT_ALONE[0]}') alone, list_filter([case when contains(document, '-TUB-') then 'TUBO' end,
  case when contains(document, '-CIV-') then 'OBRA' end], lambda x: x is not null) b from {d.v('register')})""")
def _(load):
    labels = codes.subjects(F.col("title"), SUBJECT_CODES, F.col("document"))
    return load("register").select("row_no", "source_ts", F.array_join(labels, "+").alias("subjects"))


@query("batch_code_parse_next", f"""select y batch_year, max(s) last_sequence, count(*) row_count,
  concat('AL-', lpad(cast(max(s) + 3 as varchar), 4, '0'), '-', y) next_code, max(s) + 3 > 9999 exhausted
  from (select {d.seq('allocation')} s, {d.yr('allocation')} y from {d.v('control')}) where s is not null group by y""")
def _(load):
    return C.batch_next(load("control"), "allocation", "AL", offset=2)


@query("wbs_ancestors", f"""select doc_id, w work_code, array_to_string(list_slice(string_split(w, '.'), 1, n), '.') ancestor, n depth
  from (select doc_id, w, cast(unnest(generate_series(1, len(string_split(w, '.')))) as integer) n from (
  select doc_id, {d.wbs('wbs')} w from {d.v('worked')}) where w <> '')""")
def _(load):
    return C.wbs_ancestors(load("worked"), "wbs").select("doc_id", "work_code", "ancestor", "depth")


@query("alias_expand", f"""select distinct entry_id, a alias, {d.loose('a')} alias_key from (select entry_id, unnest(list_concat([t],
  case when regexp_matches(t, '^.*?\\d+[A-Z](?:[-/][A-Z])+$') then list_transform(regexp_extract_all(regexp_extract(t, '^.*?\\d+([A-Z](?:[-/][A-Z])+)$', 1),
  '[A-Z]'), lambda x: regexp_extract(t, '^(.*?\\d+)[A-Z](?:[-/][A-Z])+$', 1) || x) else [] end)) a
  from (select entry_id, {d.txt('tag')} t from {d.v('tag_list')}))""")
def _(load):
    return C.alias_expand(load("tag_list"), "tag").select("entry_id", "alias", "alias_key")


@query("span_keys", f"""select distinct request_id, s span from (select request_id, w, array_to_string(list_slice(p, i, j), '') s from (
  select request_id, w, p, i, unnest(generate_series(i, len(p))) j from (select request_id, w, p, unnest(generate_series(1, len(p))) i from (
  select request_id, {d.loose('raw')} w, list_filter(regexp_split_to_array({d.norm('raw')}, '[^A-Z0-9]+'), lambda t: t <> '') p
  from {d.v('requests')}))) ) where length(s) >= 6 and regexp_matches(s, '[0-9]') and s <> w""")
def _(load):
    return C.span_keys(load("requests"), "raw").select("request_id", "span")


def _d_title_part(x):
    v = _d_strip(x)
    for pattern, replacement in C.TITLE_RULES:
        v = d.rx(v, pattern.replace("(?iu)", "(?i)"), replacement.replace("$", "\\"))
    return v


def _d_noparen(x):
    v = d.txt(x)
    blanks = f"list_transform(range(0, length({v}) - length(replace({v}, '(', ''))), lambda i: '')"
    v = f"list_reduce(list_concat([{v}], {blanks}), lambda a, b: regexp_replace(a, '\\([^()]*\\)', ' ', 'g'))"
    v = f"trim({d.rx(v, d._cls() + '+', ' ')})"
    return d.rx(d.rx(v, "\\s+([,.;:])", "\\1"), "([,.;:])(?:\\s*[,.;:])+", "\\1")


@query("title_clean", f"""select doc_id, md5(c) clean_md5, cast(length(c) as integer) clean_length from (select doc_id, {d.norm('case when q % 2 = 1 then replace(v, chr(34), chr(0) ) else v end')} c,
  from (select doc_id, v, length(v) - length(replace(v, chr(34), '')) q from (select doc_id, case when {_d_missing('n')} then '' else {_d_title_part('n')} end v
  from (select doc_id, {_d_noparen('text')} n from documents))))""".replace("chr(0) ", "''"))
def _(load):
    clean = C.title_clean("text")
    out = load("documents").select("doc_id", clean.alias("c"))
    return out.select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").alias("clean_length"))


def _quality(src):
    r = "r"
    s = d.rx(d.rx(r, "[‒-―]", "-"), d._cls() + "+", " ")
    s = d.rx(s, "\\s+([,;:.])", "\\1")
    for ch in ",;:":
        s = d.rx(s, f"{ch}{{2,}}", ch)
    s = f"upper(trim({s}))"
    base = f"select *, {s} s, {d.norm(s)} n, regexp_extract_all({d.norm(s)}, '[A-Z0-9]+|\\s+|[^A-Z0-9\\s]+') pieces, {d.key('document')} dk, {d.key('r')} rk from (select *, {d.txt('title')} r from {src})"
    flags = {
        "empty": (100, "r = ''"),
        "placeholder": (55, "r <> '' and regexp_matches(n, '\\b(SEM TITULO|A DEFINIR|TBD|XXX|NAO INFORMADO|N/A)\\b')"),
        "reserved": (0, "regexp_matches(n, '\\bRESERVADO\\b')"),
        "format": (6, "r <> '' and s <> r"),
        "extension": (18, "regexp_matches(r, '(?i)\\.(PDF|DOCX?|XLSX?|DWG|DGN|PPTX?)\\b')"),
        "document": (40, "document <> '' and rk = dk"),
        "short": (24, "r <> '' and length(s) < 8 and not regexp_matches(n, '\\bRESERVADO\\b')"),
        "duplicate": (12, "len(list_filter(generate_series(1, len(pieces) - 2), lambda i: regexp_full_match(pieces[i], '[A-Z0-9]{3,}') "
                      "and trim(pieces[i + 1]) = '' and pieces[i + 2] = pieces[i])) > 0"),
        "parentheses": (12, "length(replace(r, '(', '')) <> length(replace(r, ')', ''))"),
        "generic": (22, f"({d.title_kind('s')}) <> '' and len(list_filter(regexp_split_to_array(n, '[^A-Z0-9]+'), lambda t: length(t) >= 3)) <= 2 "
                    "and not regexp_matches(n, '\\bRESERVADO\\b')"),
        "characters": (5, "regexp_matches(s, '(?i)[^A-ZÀ-Ý0-9 ()_\\-/,.;:+ºª%&]')"),
    }
    issues = ", ".join(f"case when {c} then '{k}' end" for k, (_, c) in flags.items())
    cost = " + ".join(f"case when {c} then {w} else 0 end" for w, c in flags.values())
    return f"select *, list_filter([{issues}], lambda x: x is not null) issues, cast(greatest(0, 100 - ({cost})) as integer) score from ({base})"


_STATUS = "case when list_contains(issues, 'reserved') then 'reserved' when score >= 88 then 'good' when score >= 68 then 'attention' else 'review' end"


@query("title_quality_score", f"""select row_no, source_ts, array_to_string(issues, '|') issues, score, s suggested, {_STATUS} title_status
  from ({_quality(d.v('register'))})""")
def _(load):
    out = C.title_quality_score(load("register"), "title", "document")
    return out.select("row_no", "source_ts", F.array_join("issues", "|").alias("issues"), "score", "suggested", "title_status")


@query("title_quality_distribution", f"""select {_STATUS} title_status, count(*) row_count, cast(sum(score) as bigint) score_sum
  from ({_quality(d.v('register'))}) group by 1""")
def _(load):
    out = C.title_quality_score(load("register"), "title", "document")
    return out.groupBy("title_status").agg(F.count(F.lit(1)).alias("row_count"), F.sum("score").alias("score_sum"))


_REST = "regexp_replace(case when k <> '' and starts_with(n, k) then substr(n, length(k) + 1) else n end, '^[\\s:\\-]+|[\\s:\\-]+$', '', 'g')"


@query("generic_title_detect", f"""select row_no, source_ts, case when n = 'RESERVADO' then false else miss or (len(list_filter(regexp_split_to_array(rest, '[^A-Z0-9]+'),
  lambda t: length(t) >= 3)) < 2 and not regexp_matches(rest, '\\b[A-Z0-9]{{1,4}}(?:-[A-Z])?-[A-Z0-9][A-Z0-9._/-]{{2,}}\\b')) or rest = k end generic from (
  select *, {_REST} rest from (select row_no, source_ts, {d.norm('title')} n, 'RELATORIO DE INSPECAO' k, {_d_missing('title')} miss from {d.v('register')}))""")
def _(load):
    return load("register").select("row_no", "source_ts", C.generic_title(F.col("title"), F.lit("Relatório de Inspeção")).alias("generic"))


@query("revision_from_text", f"""select request_id, case when dk <> '' and instr(n, dk) > 0 and len(f) = 1 then f[1] else '' end text_revision from (
  select *, list_distinct(list_filter(regexp_extract_all(substr(n, greatest(1, instr(n, dk) - 180), instr(n, dk) + length(dk) + 260 - greatest(1, instr(n, dk) - 180)),
  '(?:REVISAO|\\bREV\\.?|\\bREVISION)\\s*[:\\-]?\\s*([A-HJ-NP-Z]{{1,3}}|0)\\b', 1), lambda r: ({d.rev_kind('r')}) <> 'invalid')) f
  from (select request_id, {d.key('raw')} n, {d.key('document')} dk from {d.v('requests')} r join (select distinct document, cast(right(document, 12) as bigint) k
  from {d.v('register')}) g on g.k = r.request_id))""")
def _(load):
    reg = load("register").select("document").distinct().withColumn("request_id", F.right("document", F.lit(12)).cast("bigint"))
    out = load("requests").join(reg, "request_id")
    return out.select("request_id", C.revision_from_text(F.col("raw"), F.col("document")).alias("text_revision"))


def _claim(name, code):
    stem = f"regexp_replace({d.txt(name)}, '\\.[^.]+$', '')"
    at = f"instr(upper({stem}), upper({code}))"
    tail = f"case when {code} <> '' and {at} > 0 then substr({stem}, {at} + length({code})) else {stem} end"
    lab = f"regexp_extract({tail}, '(?i)[_ -]REV(?:ISAO)?[_ -]?([A-Z]{{1,3}}\\d*|0)$', 1)"
    bare = f"regexp_extract({tail}, '(?i)[_ -]([A-Z]{{1,3}}\\d*|0)$', 1)"
    return d.rev(f"case when {lab} <> '' then {lab} else {bare} end")


_NAME = "concat(document, case when row_no % 3 = 0 then '_rev_a' when row_no % 3 = 1 then '_C' else '' end, case when row_no % 2 = 0 then '.PDF' else '' end)"


@query("filename_propose_validate", f"""select row_no, source_ts, e expected_name, c claimed_revision, {d.key('name')} = {d.key('e')} name_ok,
  case when w = '0' then c = '' else c = w end revision_ok from (select *, concat(document, case when w <> '' and w <> '0' then '_' || w else '' end,
  case when regexp_extract({d.txt('name')}, '(\\.[^.]+)$', 1) = '' then '.pdf' else lower(regexp_extract({d.txt('name')}, '(\\.[^.]+)$', 1)) end) e,
  {_claim('name', 'document')} c from (select *, {_NAME} as name, {d.rev('revision')} w from {d.v('register')}))""")
def _(load):
    out = load("register").withColumn("name", F.expr(_NAME))
    return C.filename_validate(out, "name", "document", "revision").select(
        "row_no", "source_ts", "expected_name", "claimed_revision", "name_ok", "revision_ok"
    )


OPTIONS = {"format": ["A0", "A1", "A2", "A3"], "discipline": OFFICIAL, "document_type": ["RL", "PR"],
           "purpose": ["Para Construção", "Conforme Construído", "Para Compra"]}


@query("option_list_validate", "select off_list, count(*) row_count, min(row_no) first_row from (select row_no, unnest(list_filter([" + ", ".join(
    f"case when {d.norm(f)} not in (" + ", ".join(d.norm(f"'{x}'") for x in xs) + f") then '{f}' end" for f, xs in OPTIONS.items())
    + f"], lambda x: x is not null)) off_list from {d.v('register')}) group by 1")
def _(load):
    out = C.option_list_validate(load("register"), OPTIONS).select("row_no", F.explode("off_list").alias("off_list"))
    return out.groupBy("off_list").agg(F.count(F.lit(1)).alias("row_count"), F.min("row_no").alias("first_row"))


_NT = """select row_no, source_ts, concat(case row_no % 5 when 0 then 'nt-LBN' when 1 then 'NT-VM' when 2 then 'nt-BOB' when 3 then 'VM' else 'nt-QQ' end, '-',
  cast(row_no % 60 as string), 'X185MM-', cast(row_no % 90 as string), 'M-', case when row_no % 4 = 0 then '100X50' else 'CHZ' end) as tag from """


@query("nontagged_decode", f"""select row_no, source_ts, what nt_what, coalesce(e.description, case when what = '' then '' else what || ' - ' || w end) nt_description,
  e.description is not null nt_exact from (select *, case when body = '' then '' when p1 = 'LBN' then 'LEITO NOVO' when p1 = 'VM' then 'VÁLVULA MANUAL'
  when p1 = 'BOB' then 'CABO NOVO' else '' end what, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '(\\d+)X(\\d+)MM', '\\1 X \\2 MM2', 'g'),
  '-(\\d+)M(-|$)', '-\\1 M\\2', 'g'), '-(\\d+)X(\\d+)$', '-\\1 X \\2 MM'), 'zz', ''), '-', ' ') w from (select *, regexp_extract(upper(body), '^([A-Z]+)', 1) p1,
  regexp_replace(upper(body), '^[^-]*-', '') rest from (select *, regexp_extract(tag, '(?i)^nt-(.+)$', 1) body from ({_NT} {d.v('register')})))) t
  left join (select {d.norm('tag')} k, min(description) description from ({_NT} {d.v('register')}) x cross join (select 'Item controlado' description) where row_no % 97 = 0 group by 1) e
  on e.k = {d.norm('t.tag')} and t.body <> ''""")
def _(load):
    tagged = load("register").selectExpr("row_no", "source_ts", _NT.split("source_ts, ", 1)[1].rsplit(" as tag", 1)[0] + " as tag")
    exact = tagged.filter("row_no % 97 = 0").select("tag", F.lit("Item controlado").alias("description"))
    return C.nontagged_decode(tagged, "tag", exact).select("row_no", "source_ts", "nt_what", "nt_description", "nt_exact")
