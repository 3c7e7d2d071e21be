"""Ingest queries: grids, catalogs, evidence files, request lists, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.functions import codes, text
from docweave.session import shared_folder
from docweave.sources import catalogs as K, grids as G, sinks as S

from . import duck as d
from .registry import query


def _in(xs):
    return ", ".join(f"'{x}'" for x in xs)


def _match(h: str, what: str) -> str:
    """Header rule as a CASE over the fixed wordings; ``what`` picks field, kind or score."""
    v = lambda f, kind, score: {"field": f"'{f}'", "kind": f"'{kind}'", "score": str(score)}[what]
    out = [f"when {h} in ({_in(std)}) then {v(f, 'standard', 100)}" for f, (std, _) in G.FIELDS.items()]
    out += [f"when {h} in ({_in(al)}) then {v(f, 'alias', 92)}" for f, (_, al) in G.FIELDS.items()]
    for f, (std, al) in G.FIELDS.items():
        near = " or ".join(f"contains({h}, '{x}') or contains('{x}', {h})" for x in std + al)
        out.append(f"when length({h}) >= 6 and ({near}) then {v(f, 'suggested', 76)}")
    return "case " + " ".join(out) + " end"


CELLS = f"""(select *, {_match('h', 'field')} field, {_match('h', 'kind')} kind, {_match('h', 'score')} score from (
  select source, sheet, row_no, c column_no, trim(cell) header, {d.norm('cell')} h from (
  select source, sheet, row_no, unnest(cells) cell, cast(unnest(generate_series(0, len(cells) - 1)) as integer) c from {d.v('grid')} where row_no <= 60)) where h <> '')"""
HEADERS = f"""(select source, sheet, min(row_no) header_row from (select source, sheet, row_no from {CELLS} where field in ('document', 'revision')
  group by 1, 2, 3 having count(distinct field) = 2) group by 1, 2)"""
MAP = f"""(select source, sheet, field, column_no, kind, score, header from (select c.*, row_number() over (partition by c.source, c.sheet, field order by column_no) n
  from {CELLS} c join {HEADERS} h on h.source = c.source and h.sheet = c.sheet and h.header_row = c.row_no where field is not null) where n = 1)"""


def _headers(load):
    return G.grid_header_detect(load("grid"), ["document", "revision"])


@query("grid_header_detect", f"select * from {HEADERS}")
def _(load):
    return _headers(load)


@query("column_alias_map", f"select * from {MAP}")
def _(load):
    return G.column_alias_map(load("grid"), _headers(load))


_P = " + ".join(f"max(case when field = '{f}' then {p} else 0 end)" for f, p in G.ROW_POINTS.items())
_H = " + ".join(f"max(case when field = '{f}' then {p} else 0 end)" for f, p in G.HISTORY_POINTS.items())
_HAS = lambda f: f"max(case when field = '{f}' then 1 else 0 end)"
ROLES = f"""(select source, sheet, header_row, score, fields, case when usable = 1 and hp >= 8 and row_number() over (partition by source
   order by case when usable = 1 then hp else -1 end desc, sheet desc) = 1 then 'history' when usable = 1 then 'technical' else 'ignore' end role from (
  select *, hp0 + case when {d.norm('sheet')} = 'BASE S3' then 40 when contains({d.norm('sheet')}, 'S3') then 22 else 0 end hp,
  row_number() over (partition by source, sheet order by score desc, header_row) n from (select source, sheet, row_no header_row,
  cast(count(distinct field) * 3 + {_P} + greatest({_HAS('status')}, {_HAS('posting_status')}) * 16 as bigint) score, count(distinct field) fields,
  {_HAS('document')} * {_HAS('revision')} usable, {_H} hp0 from {CELLS.replace('row_no <= 60', 'row_no <= 100')} where field is not null group by 1, 2, 3)) where n = 1)"""


@query("sheet_role_profile", f"select * from {ROLES}")
def _(load):
    return G.sheet_role_profile(load("grid"), "Base S3")


@query("profile_validate", f"""with roles as (select * from {ROLES}), cols as (select source, sheet, case when column_no = 5 and sheet = 'S4' then 4 else column_no end column_no, field from {MAP}
  where field <> 'title' or sheet <> 'S1'),
  per as (select source, count(*) filter (where role = 'technical') t, count(*) filter (where role = 'history') h from roles group by 1)
  select source, '' sheet, 'no_technical_sheet' issue, '' detail from per where t = 0 union all
  select source, '', 'history_sheets', cast(h as varchar) from per where h <> 1 union all
  select r.source, r.sheet, 'missing_field', f.field from roles r, (values ('technical', 'document'), ('technical', 'revision'), ('technical', 'title'),
  ('history', 'document'), ('history', 'revision')) f(role, field) where f.role = r.role and not exists (
  select 1 from cols c where c.source = r.source and c.sheet = r.sheet and c.field = f.field) union all
  select c.source, c.sheet, 'column_used_twice', cast(column_no as varchar) from cols c join roles r on r.source = c.source and r.sheet = c.sheet and r.role <> 'ignore'
  group by c.source, c.sheet, column_no having count(distinct field) > 1""")
def _(load):
    grid = load("grid")
    columns = G.column_alias_map(grid, _headers(load)).filter("field <> 'title' or sheet <> 'S1'")
    moved = F.when((F.col("column_no") == 5) & (F.col("sheet") == "S4"), 4).otherwise(F.col("column_no"))
    return G.profile_validate(G.sheet_role_profile(grid, "Base S3"), columns.select("source", "sheet", "field", moved.alias("column_no")))


_DS = lambda x: f"""case when {x} = '' then 'empty' when regexp_matches({x}, '{d.BR}') then 'br' when regexp_matches({x}, '{d.ISO}') then 'iso'
  when regexp_matches({x}, '^\\d{{5,6}}$') and try_cast({x} as double) > 20000 then 'serial' else 'other' end"""


@query("cell_mode_profile", f"""select source, sheet, formulas, value_cells, coalesce(ds, 'empty') date_style,
  case when formulas > 0 and value_cells > 0 then 'mixed' when formulas > 0 then 'formulas' else 'values' end cell_mode from (
  select g.source, g.sheet, cast(sum(len(list_filter(cells, lambda c: c like '=%'))) as bigint) formulas,
  cast(sum(len(list_filter(cells, lambda c: trim(c) <> '' and c not like '=%'))) as bigint) value_cells,
  min_by({_DS('trim(cells[5])')}, row_no) filter (where trim(cells[5]) <> '' and cells[5] not like '=%') ds
  from {d.v('grid')} g join {HEADERS} h on h.source = g.source and h.sheet = g.sheet where row_no > header_row and row_no <= header_row + 80 group by 1, 2)""")
def _(load):
    return G.cell_mode_profile(load("grid"), _headers(load), date_column=4)


_COL = lambda f: f"max(column_no) filter (where field = '{f}') c_{f}"
_GET = lambda f: f"coalesce({d.txt(f'cells[c_{f} + 1]')}, '') {f}"
_FLD = list(G.FIELDS)
_ROWS = f"""(select *, {d.key('document')} document_key from (select g.source, g.sheet, g.row_no, {', '.join(_GET(f) for f in _FLD)} from {d.v('grid')} g
  join {HEADERS} h on h.source = g.source and h.sheet = g.sheet join (select source, sheet, {', '.join(_COL(f) for f in _FLD)} from {MAP} group by 1, 2) m
  on m.source = g.source and m.sheet = g.sheet where g.row_no > header_row))"""
_ROWS = _ROWS.replace("field in ('document', 'revision')", "field in ('document')").replace("count(distinct field) = 2", "count(distinct field) = 1")
_OUT = "case when document = '' then 'no_document' when document_key = 'FIM' then 'end_marker' when length(document_key) < 7 then 'short_key' else 'read' end"


@query("register_ingest", f"""select source, sheet, row_no, document_key, {', '.join(f for f in _FLD if f not in ('allocation', 'allocation_status'))},
  case when regexp_matches({d.norm('allocation')}, '^(NAO )?ALOCAD[OA]\\b') then '' else allocation end allocation,
  case when regexp_matches({d.norm('allocation')}, '^NAO ALOCAD[OA]\\b') then 'NÃO ALOCADO' when regexp_matches({d.norm('allocation')}, '^ALOCAD[OA]\\b') then 'ALOCADO' else allocation_status end allocation_status
  from {_ROWS} where {_OUT} = 'read'""")
def _(load):
    return G.register_ingest(load("grid"))[0]


@query("register_coverage", f"""select source, sheet, {_OUT} outcome, count(*) row_count from {_ROWS} group by 1, 2, 3 union all
  select distinct source, sheet, 'no_header', 0 from {d.v('grid')} g where (source, sheet) not in (select (source, sheet) from {HEADERS.replace("field in ('document', 'revision')", "field in ('document')").replace('= 2', '= 1')})""")
def _(load):
    return G.register_ingest(load("grid"))[1]


_OV = "case l_orderkey % 4 when 0 then 'Alocado em obra' when 1 then 'não alocada' when 2 then concat('AL-', cast(l_partkey as string)) else '' end"


@query("split_overloaded_column", f"""select l_orderkey, l_linenumber, l_extendedprice, case when l_orderkey % 4 = 0 then 'ALOCADO' when l_orderkey % 4 = 1 then 'NÃO ALOCADO' else '' end state,
  case when l_orderkey % 4 = 2 then 'AL-' || l_partkey else '' end code from lineitem""")
def _(load):
    state, code = G.split_overloaded(F.expr(_OV))
    return load("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", state.alias("state"), code.alias("code"))


_COVER = """select cast(c_nationkey as string) as source, 'Capa' as sheet, cast(c_custkey % 150 + 1 as int) as row_no,
  min(case when c_custkey % 150 = 6 then 'Rev.' when c_custkey % 11 = 0 then substr(c_mktsegment, 1, 1) when c_custkey % 13 = 0 then 'notas'
  else concat(substr(c_mktsegment, 1, 1), cast(c_custkey % 9 as string), ' ') end) as v from {customer} group by 1, 2, 3"""


@query("cover_version_infer", f"""with c as (select source, row_no, replace({d.norm('v')}, ' ', '') x from ({_COVER.replace('{customer}', 'customer')}))
  select source, x version from (select c.source, x, row_number() over (partition by c.source order by row_no desc) n from c join (
  select source, min(row_no) h from c where row_no <= 40 and x in ('REV', 'REV.', 'REVISAO') group by 1) k on k.source = c.source and row_no > h
  where row_no <= 200 and regexp_full_match(x, '0|[A-Z]\\d{{0,3}}')) where n = 1""")
def _(load):
    customer = load("customer")
    grid = customer.sparkSession.sql(_COVER, customer=customer)
    return G.cover_version_infer(grid.select("source", "sheet", "row_no", F.array("v").alias("cells")))


_CC = {"tag": ["DOCUMENTO"], "revision": ["REVISAO"], "title": ["TITULO DO DOCUMENTO"], "status": []}
_RQ = """(select source, sheet, row_no, max(case when h in ('DOCUMENTO', 'TAG') then c end) t, max(case when h in ('REVISAO', 'REVISION') then c end) r,
  max(case when h in ('TITULO DO DOCUMENTO', 'TITLE') then c end) ti, max(case when h = 'STATUS' then c end) st from (
  select source, sheet, row_no, """ + d.norm("cell") + """ h, c from (select source, sheet, row_no, unnest(cells) cell, unnest(generate_series(1, len(cells))) c from """ + d.v("grid") + """ where row_no <= 12)) group by 1, 2, 3)"""


@query("catalog_ingest_required", f"""select source, sheet, row_no, {d.txt('cells[t]')} tag, {d.txt('cells[r]')} revision, {d.txt('cells[ti]')} title,
  case when st is null then '' else {d.txt('cells[st]')} end status from (select g.source, g.sheet, g.row_no, cells, t, r, ti, st, h.row_no hr from {d.v('grid')} g
  join (select *, row_number() over (partition by source, sheet order by row_no) n from {_RQ} where t is not null and r is not null and ti is not null) h
  on h.n = 1 and h.source = g.source and h.sheet = g.sheet) where row_no > hr and (cells[t] <> '' or cells[r] <> '' or cells[ti] <> '' or coalesce(cells[st], '') <> '')""")
def _(load):
    return K_catalog(load)[0]


@query("catalog_ingest_errors", f"""select source, sheet, array_to_string(list_filter([case when t is null then 'tag' end, case when r is null then 'revision' end,
  case when ti is null then 'title' end], lambda x: x is not null).list_sort(), ', ') missing from (select source, sheet, t, r, ti, row_number() over (partition by source, sheet order by
  (t is not null)::int + (r is not null)::int + (ti is not null)::int desc, row_no) n from {_RQ}) where n = 1 and (t is null or r is null or ti is null)""")
def _(load):
    return K_catalog(load)[1]


def K_catalog(load):
    return G.catalog_ingest_required(load("grid"), _CC, ["tag", "revision", "title"])


_COUNTS = "select p_type as catalog, count(*) as row_count from {part} where p_size > 10 group by p_type"
_EXPECT = "select p_type as catalog, cast(case p_type when 'SMALL' then 100000000 when 'PROMO' then 1 else count(*) end as bigint) as expected from {part} group by p_type union all select 'NONE', cast(5 as bigint)"


def _sql(load, text_, *tables):
    frames = {t: load(t) for t in tables}
    return next(iter(frames.values())).sparkSession.sql(text_, **frames)


@query("catalog_volume_review", f"""select e.catalog, expected, coalesce(row_count, 0) row_count, case when coalesce(row_count, 0) = 0 then 'error'
  when row_count < 0.5 * expected or row_count > 2 * expected then 'warning' else 'ok' end verdict
  from ({_EXPECT.replace('{part}', 'part')}) e left join ({_COUNTS.replace('{part}', 'part')}) c on c.catalog = e.catalog""")
def _(load):
    return K.catalog_volume_review(_sql(load, _COUNTS, "part"), _sql(load, _EXPECT, "part"))


@query("catalog_status", f"""select b.catalog, case when p.catalog is null then 'built-in' else 'pinned.xlsx' end source, coalesce(p.row_count, b.row_count) row_count,
  b.row_count builtin_count, case when p.catalog is null then 'built_in' else 'replaced' end origin from (select p_type catalog, count(*) row_count from part group by 1) b
  left join ({_COUNTS.replace('{part}', 'part')}) p on p.catalog = b.catalog and b.catalog in ('SMALL', 'LARGE')""")
def _(load):
    builtin = load("part").groupBy(F.col("p_type").alias("catalog")).agg(F.count(F.lit(1)).alias("row_count")).withColumn("source", F.lit("built-in"))
    pinned = _sql(load, _COUNTS, "part").filter("catalog in ('SMALL', 'LARGE')").withColumn("source", F.lit("pinned.xlsx"))
    return K.catalog_status(builtin, pinned)


_MAPROWS = """select event_id % 3 as sheet_no, event_id as row_no, case when event_type = 'purchase' then concat('UNIT-X|', cast(user_id as string), '|folder') else '' end as path,
  case event_type when 'click' then concat('* nota ', cast(user_id as string)) when 'view' then concat('DOCUMENTOS: ', cast(user_id as string)) else 'x' end as note from {events}"""
_FOLD = f"""select *, case when path <> '' then row_no end e, max(case when path <> '' then row_no end) over (partition by sheet_no order by row_no) entry_row from ({_MAPROWS.replace('{events}', 'events')})"""


@query("continuation_fold", f"""select e.sheet_no, e.row_no, e.path, e.note, count(n.row_no) notes from ({_FOLD}) e left join (select * from ({_FOLD}) where path = '' and note <> 'x') n
  on n.sheet_no = e.sheet_no and n.entry_row = e.row_no where e.path <> '' group by 1, 2, 3, 4""")
def _(load):
    return K.continuation_fold(_sql(load, _MAPROWS, "events"), ["sheet_no"], "row_no", "path", "note")[0]


@query("continuation_notes", f"select sheet_no, entry_row, row_no, note from ({_FOLD}) where path = '' and note <> 'x' and entry_row is not null")
def _(load):
    return K.continuation_fold(_sql(load, _MAPROWS, "events"), ["sheet_no"], "row_no", "path", "note")[1]


_NOTES = "case entry_id % 3 when 0 then concat('Rev.B: alterado (', path, ')') when 1 then concat('a|b|c ', chr(10), path, '|', notes) else replace(path, 'UNIT-X', ' real unit ') end"


@query("path_extract_clean", f"""select entry_id, array_to_string(case when regexp_full_match({d.norm('p[1]')}, 'UNIT-?X|X{{2,}}|NOME UNIDADE|UNIDADE') then list_concat(['UNIT-D'], p[2:]) else p end, '|') clean_path
  from (select entry_id, list_filter(list_transform(string_split(case when regexp_matches(n, '[()\\n]') then coalesce(f, n) else n end, '|'), lambda x: trim(x)), lambda x: x <> '') p from (
  select *, list_sort(list_transform(list_filter(list_transform(regexp_extract_all(n, '[^()\\n|]+(?:\\|[^()\\n|]+){{2,}}'), lambda x: trim(x)), lambda x: {d.path_complete('x')}),
  lambda x: {{'n': length(x), 'p': x}}), 'desc')[1].p f from (select entry_id, {d.txt(_NOTES)} n from {d.v('catalog')})))""")
def _(load):
    noted = load("catalog").withColumn("noted", F.expr(_NOTES.replace("chr(10)", "'\\n'")))
    return K.path_extract_clean(noted, "noted", F.lit("UNIT-D")).select("entry_id", "clean_path")


_LV = "c_custkey, concat('0', cast(c_nationkey as string), '.', c_mktsegment) as l1, case when c_custkey % 3 = 0 then '' else concat('0', cast(c_nationkey as string), '.0', cast(c_custkey % 7 as string), ' sub') end as l2, case when c_custkey % 4 = 0 then concat(cast(c_nationkey as string), '.', cast(c_custkey % 7 as string), '.', cast(c_custkey % 5 as string), 'Z') else 'name' end as l3"


@query("level_base_build", f"""select c_custkey, c base_code from (select c_custkey, {d.unzero('x')} c, row_number() over (partition by c_custkey order by len(string_split(x, '.')) desc, i) n from (
  select c_custkey, unnest([l1, l2, l3]) l, unnest([1, 2, 3]) i from (select {_LV} from customer)) t, lateral (select regexp_extract(t.l, '^(\\d+(\\.\\d+)*)', 1) x) where x <> '') where n = 1""")
def _(load):
    return K.level_base_build(load("customer").selectExpr(*_LV_LIST), ["l1", "l2", "l3"]).select("c_custkey", "base_code")


_LV_LIST = ["c_custkey", *[p.strip() for p in __import__("re").split(r", (?=concat\('0', cast\(c_nationkey as string\), '\.', c_mkt|case when)", _LV)[1:]]]


@query("allocation_history_ingest", f"""select document_key, allocation, source_row from (select *, row_number() over (partition by document_key, allocation, {d.norm('status')}, {d.norm('path')}, {d.norm('comment')},
  {d.norm('return_date')} order by source_row desc) n from (select {d.key('document')} document_key, coalesce(nullif(case when source_row % 2 = 0 then allocation else '' end, ''), regexp_extract(upper(source), '(AL-\\d{{4}}-\\d{{4}})', 1)) allocation,
  status, path, comment, return_date, source_row from {d.v('confirmations')})) where n = 1""")
def _(load):
    rows = load("confirmations")
    own = rows.filter("source_row % 2 = 0")
    named = rows.filter("source_row % 2 = 1").withColumn("allocation", F.lit(""))
    return K.allocation_history_ingest([own, named], "AL").select("document_key", "allocation", "source_row")


_CTL = "select o_custkey % 400 as k, o_orderkey as row_no, o_orderstatus as status from {orders}"


@query("control_ingest", f"""select document, status, row_no from (select concat('doc ', k) document, status, row_no, row_number() over (partition by k order by row_no desc) n from ({_CTL.replace('{orders}', 'orders')})) where n = 1""")
def _(load):
    rows = _sql(load, _CTL, "orders").select(F.concat(F.lit("doc "), F.col("k").cast("string")).alias("document"), "status", "row_no")
    return K.control_ingest(rows)[1].select("document", "status", "row_no")


_EV = f"""select source_row, case when own <> '' then own else named end allocation, case when own <> '' and named <> '' and own <> named then 'file_disagrees' when own = '' and named = '' then 'code_missing'
  when rd <> '' and substr(rd, 1, 4) <> right(case when own <> '' then own else named end, 4) then 'wrong_year' when status = '' and comment = '' then 'nothing_useful' else '' end reject_reason from (
  select source_row, status, comment, case when regexp_full_match(upper(allocation), 'AL-\\d{{4}}-\\d{{4}}') then upper(allocation) else '' end own,
  regexp_extract(upper(source), '(AL-\\d{{4}}-\\d{{4}})', 1) named, {d.date_text("case when return_date = '' then '' else concat(right(source_row::varchar, 1)::int % 3 + 2022, substr(return_date, 5)) end")} rd from {d.v('confirmations')})"""


@query("evidence_ingest_quarantine", _EV)
def _(load):
    moved = F.when(F.col("return_date") == "", "").otherwise(
        F.concat((F.col("source_row") % 10 % 3 + 2022).cast("string"), F.substring("return_date", 5, 20))
    )
    rows = load("confirmations").withColumn("return_date", moved)
    out = K.evidence_quarantine(rows, "AL", useful=["status", "comment"])
    return out.select("source_row", "allocation", "reject_reason")


@query("comment_merge", f"""select source_row, coalesce(array_to_string(list_transform(list_filter(list_transform(l, lambda x, i: {{'i': i, 'x': x}}), lambda s: not exists (select 1) = false and
  list_position(list_transform(l, lambda y: {d.norm('y')}), {d.norm('s.x')}) = s.i), lambda s: s.x), ' | '), '') merged from (select source_row, list_filter([{d.txt('status')}, {d.txt('comment')}, {d.txt('upper(comment)')}, {d.txt('return_date')}],
  lambda v: v <> '' and not regexp_matches(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}') and {d.norm('v')} not in ('N/A', 'NA', '-', '')) l from {d.v('confirmations')})""".replace("not exists (select 1) = false and", ""))
def _(load):
    merged = K.comment_merge(["status", "comment", F.upper("comment"), "return_date"])
    return load("confirmations").select("source_row", merged.alias("merged"))


_LINE = "concat(case when request_id % 4 = 0 then '* ' when request_id % 4 = 1 then '- ' else '' end, '\"', raw, '\";', case when request_id % 5 = 0 then 'FIM' else concat('dir/sub/', raw) end)"


@query("request_list_normalize", f"""select request_key, request_id, part_no, request from (select *, row_number() over (partition by request_key order by request_id, part_no) n from (
  select request_id, part_no, {d.txt('request')} request, {d.request_key('request')} request_key from (select request_id, part_no, string_split(string_split(
  regexp_replace(regexp_replace({d.txt('piece')}, '^[\\s•*\\-]+\\s+', ''), '^[''"]+|[''",;]+$', '', 'g'), '/')[-1], '\\')[-1] request from (
  select request_id, unnest(regexp_split_to_array({_LINE}, '[\\t;|\\r\\n]+')) piece, cast(unnest(generate_series(0, len(regexp_split_to_array({_LINE}, '[\\t;|\\r\\n]+')) - 1)) as integer) part_no
  from {d.v('requests')}))) where request_key not in ('', 'FIM')) where n = 1""")
def _(load):
    lines = load("requests").withColumn("line", F.expr(_LINE))
    return K.request_list_normalize(lines, "line", "request_id")


_FILES = """select event_id, concat('in/', case event_type when 'error' then '~$' when 'view' then '.' when 'click' then 'RELATORIO_TRIAGEM_' else '' end, 'book_', cast(user_id as string),
  case when user_id % 4 = 0 then '.pdf' when user_id % 4 = 1 then '.XLSX' else '.xlsm' end) as name, cast(case when user_id % 9 = 0 then 0 else user_id end as bigint) as size from {events}"""


@query("file_manifest_filter", f"""select skip_reason, count(*) row_count, cast(sum(size) as bigint) bytes from (select size, case when b like '~$%' then 'temporary' when b like '.%' then 'hidden' when size <= 0 then 'empty'
  when regexp_matches(upper(b), '^RELATORIO[ _-]') then 'own_output' when not regexp_matches(lower(b), '\\.(xlsx|xlsm)$') then 'extension' else '' end skip_reason
  from (select *, string_split(name, '/')[-1] b from ({_FILES.replace('{events}', 'events')}))) group by 1""")
def _(load):
    out = K.file_manifest_filter(_sql(load, _FILES, "events"), "name", "size", "xlsx|xlsm", "^RELATORIO[ _-]")
    return out.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("row_count"), F.sum("size").alias("bytes"))


@query("text_line_extract", f"""select file, line_no, tag, size, page, cancelled from (select file, line_no, upper(regexp_extract(line, '(?i)\\b(V[GB]?-\\d+)\\b', 1)) tag,
  regexp_extract(line, '(\\d+")', 1) size, cast(1 + sum(case when line = chr(12) then 1 else 0 end) over (partition by file order by line_no) as bigint) page,
  contains(line, 'CANCELADA') cancelled from {d.v('lines')}) where tag <> ''""")
def _(load):
    return K.text_line_extract(load("lines"), r"V[GB]?-\d+", r'(\d+")')


_CB = "select o_orderkey, o_custkey % 300 as c, case when o_orderkey % 7 = 0 then ' ' else o_orderpriority end as tag, o_orderstatus as discipline from {orders}"


@query("catalog_build_partitioned", f"""select discipline, count(*) row_count, min(o_orderkey) first_row, cast(sum(o_orderkey) as bigint) row_sum from (select *, row_number() over (partition by c, {d.norm('tag')}, discipline
  order by o_orderkey) n from ({_CB.replace('{orders}', 'orders')}) where trim(tag) <> '') where n = 1 group by 1""")
def _(load):
    built = K.catalog_build(_sql(load, _CB, "orders"), ["c", "tag", "discipline"], "o_orderkey")
    return built.groupBy("discipline").agg(F.count(F.lit(1)).alias("row_count"), F.min("o_orderkey").alias("first_row"), F.sum("o_orderkey").alias("row_sum"))


@query("catalog_union_dedupe", f"""select catalog_rank, entry_id, description, path from (select *, row_number() over (partition by {d.norm('description')}, {d.norm('path')} order by catalog_rank desc, entry_id desc) n from (
  select 0 catalog_rank, entry_id, description, path from {d.v('catalog')} union all select 1, entry_id, upper(description), path from {d.v('catalog')} where entry_id % 3 = 0)) where n = 1""")
def _(load):
    base = load("catalog").select("entry_id", "description", "path")
    overlay = base.filter("entry_id % 3 = 0").withColumn("description", F.upper("description"))
    return K.catalog_union_dedupe([base, overlay], ["description", "path"], "entry_id").select("catalog_rank", "entry_id", "description", "path")


@query("complement_union", """select c_custkey key, 'own' origin from customer union all
  select o_orderkey, 'embedded' from orders where o_orderkey not in (select c_custkey from customer)""")
def _(load):
    own = load("customer").select(F.col("c_custkey").alias("key"), F.lit("own").alias("origin"))
    return K.complement_union(own, load("orders").select(F.col("o_orderkey").alias("key"), F.lit("embedded").alias("origin")), "key")


_RULES = [("_CVL_", ["SMALL", "PROMO", "STANDARD"]), ("_ELE_", ["LARGE"]), ("_INS_|_AUT_", ["MEDIUM", "unheard of"]), ("_HVAC_", ["ECONOMY"])]
_KINDS = ["SMALL", "LARGE", "PROMO", "ECONOMY", "STANDARD", "MEDIUM"]
_CODE = "concat('D_', case when l_linenumber = 1 then 'cvl' when l_linenumber = 2 then 'AUT' else 'XYZ' end, '_', l_orderkey)"


@query("partition_prune_by_code", f"""with rules as (select unnest([{', '.join(f"{{'p': '{p}', 't': {x}}}" for p, x in _RULES)}], recursive := true)),
  fired as (select distinct unnest(t) t from rules where exists (select 1 from lineitem where regexp_matches(upper({_CODE}), p)))
  select p_type, count(*) row_count, cast(sum(p_size) as bigint) size_sum from part where p_type in (select t from fired) or not exists (select 1 from fired) group by 1""")
def _(load):
    part = load("part").select("p_partkey", "p_size", "p_type")
    catalog = K.partitioned_catalog(part, f"{shared_folder(part.sparkSession)}/catalog-{uuid.uuid4().hex}", "p_type")
    kept = K.partition_prune_by_code(catalog, "p_type", load("lineitem").select(F.expr(_CODE).alias("code")), "code", _RULES, _KINDS)
    return kept.groupBy("p_type").agg(F.count(F.lit(1)).alias("row_count"), F.sum("p_size").alias("size_sum"))


@query("report_tables", """select 'summary' section, 'rows' name, count(*) amount from orders union all select 'summary', 'states', count(distinct o_orderstatus) from orders
  union all select 'distribution', o_orderstatus, count(*) from orders group by 2 union all select 'filters', 'status', 1""")
def _(load):
    t = S.report_tables(load("orders"), "o_orderstatus", {"status": "all"})
    part = lambda name, amount: t[name].select(F.lit(name).alias("section"), "name", amount.alias("amount"))
    return part("summary", F.col("value")).unionAll(part("distribution", F.col("value"))).unionAll(part("filters", F.lit(1).cast("bigint")))


@query("csv_export", """select '"' || conv_id || '";"' || turn || '";"' || role || '";"' || replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '"', '""') || '"' as value from conversations""")
def _(load):
    return S.csv_lines(load("conversations"), ["conv_id", "turn", "role", "text"])
