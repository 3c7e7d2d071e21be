"""Business jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import codes, text
from docweave.operators import evidence as E, matching as M, ranking as R, similarity as S, titles as T
from docweave.operators.keyed import latest_by
from docweave.plans import allocation as A, audits as U, changes as X, relations, triage as TR

from . import duck as d
from .matching import _MAX, _REQ, DOCS, DOCS_ALL, OUTCOME
from .ranking import _A, CONFLICTS, STATE
from .cleaning import _d_missing
from .evidence import _LIST, composed
from .registry import ORACLES, query

REG, HIST, CTL = d.v("register"), d.v("history"), d.v("control")
_POS = f"(cast({d.rev_rank(d.rev('revision'))} as bigint), greatest(greatest({d.day('modified')}, {d.day('included')}, {d.day('effective_date')}, 0) * 86400000, source_ts, row_no), row_no, source_ts)"
_ALL = f"""(select *, {_POS} pos from (select 1 tech, document, revision, status, posting_status, title, dispatch, effective_date, discipline, document_type, purpose, path, comment, allocation_status, allocation, modified, included, sheet, row_no, source_ts from {REG}
  union all select 0, document, revision, status, posting_status, '', '', '', '', '', '', '', '', '', '', modified, included, sheet, row_no, source_ts from {HIST}))"""
_FIRST = lambda f: f"coalesce(arg_max({d.txt(f)}, pos) filter (where tech = 1 and {d.txt(f)} <> ''), arg_max({d.txt(f)}, pos) filter (where {d.txt(f)} <> ''), '') f_{f}"
_AGR = lambda f, n: f"case when count(distinct {n}) filter (where {n} <> '') = 1 then min({d.txt(f)}) filter (where {n} <> '') else '' end g_{f}"
_JOIN = lambda f: f"(select document, string_agg(v, ' · ' order by pos desc, v desc) {f} from (select document, {d.norm(f)} n, max((pos, {d.txt(f)}))[2] v, max((pos, {d.txt(f)}))[1] pos from a where {d.norm(f)} <> '' group by 1, 2) group by 1)"
RELATION = f"""(with a as (select * from {_ALL}), c as (select document, array_to_string(list_sort(list(distinct field)), ', ') f from {CONFLICTS} group by 1),
  t as (select * from (select *, row_number() over (partition by document order by pos desc) n from a where tech = 1) where n = 1), l as (select * from (select *, row_number() over (partition by document order by pos desc) n from a) where n = 1),
  g as (select document, {', '.join(_FIRST(f) for f in ('title', 'path', 'effective_date', 'discipline', 'document_type', 'purpose'))}, {_AGR('title', d.norm('title'))}, {_AGR('path', d.norm('path'))},
  {_AGR('allocation_status', d.norm('allocation_status'))}, {_AGR('revision', d.rev('revision'))} from a group by 1),
  st as (select document, rev, case when state = 'single' then first_raw else state end s from {STATE}),
  x as (select t.*, g.*, c.f cf, {d.rev('l.revision')} cur, coalesce(nullif({d.txt('l.posting_status')}, ''), nullif({d.txt('l.status')}, ''), nullif({d.txt('t.posting_status')}, ''), nullif({d.txt('t.status')}, ''), 'not_informed') fb
  from t join l on l.document = t.document join g on g.document = t.document left join c on c.document = t.document),
  y as (select x.*, coalesce(st.s, fb) ps from x left join st on st.document = x.document and st.rev = x.cur),
  z as (select *, case when ({d.kind('ps')}) = 'advance' and ({d.rev_next('cur')}) <> '' then {d.rev_next('cur')} else cur end nxt from y),
  w as (select z.*, case when nxt <> cur then coalesce(st.s, 'not_posted') else ps end ns, jd.dispatch jd, ja.allocation ja, jc.comment jc from z left join st on st.document = z.document and st.rev = z.nxt
  left join {_JOIN('dispatch')} jd on jd.document = z.document left join {_JOIN('allocation')} ja on ja.document = z.document left join {_JOIN('comment')} jc on jc.document = z.document)
  select document, case when cf is null then {d.txt('sheet')} else '' end sheet, case when cf is not null then g_title when {d.txt('title')} <> '' then {d.txt('title')} else f_title end title,
  case when cf is not null then g_revision else cur end current_revision, case when cf is null then nxt else '' end next_revision, case when cf is null then ps else 'conflict' end posting_status,
  case when cf is null then ns else '' end next_status, case when cf is null then {d.txt('status')} else '' end technical_status, case when cf is null then f_path else g_path end path,
  case when cf is not null then g_allocation_status when {d.txt('allocation_status')} <> '' then {d.txt('allocation_status')} when coalesce(ja, '') <> '' then 'Alocado' else 'not_informed' end allocation_status,
  case when cf is null then coalesce(jd, '') else '' end dispatch, case when cf is null then coalesce(ja, '') else '' end allocation, case when cf is null then coalesce(jc, '') else '' end as comment,
  case when cf is null then f_effective_date else '' end effective_date, case when cf is null then f_discipline else '' end discipline, case when cf is null then f_document_type else '' end document_type,
  case when cf is null then f_purpose else '' end purpose, cf is not null conflict, coalesce(cf, '') conflict_fields from w)"""


@query("relation_rows", f"select * from {RELATION}")
def _(load):
    return relations.relation_rows(load("register"), load("history"))


@query("relation_status_distribution", f"select {d.norm('posting_status')} status_key, min(posting_status) label, count(*) row_count from {RELATION} group by 1")
def _(load):
    return E.status_distribution(relations.relation_rows(load("register"), load("history")), "posting_status")


_NOW = "2024-01-20"
_M = _MAX.replace(DOCS, DOCS_ALL)
_CLAIM_STEM = f"regexp_replace({d.txt('raw')}, '\\.[^.]+$', '')"
_CLAIM_TAIL = f"case when code <> '' and instr(upper({_CLAIM_STEM}), upper(code)) > 0 then substr({_CLAIM_STEM}, instr(upper({_CLAIM_STEM}), upper(code)) + length(code)) else {_CLAIM_STEM} end"
_CLAIM = d.rev(f"coalesce(nullif(regexp_extract({_CLAIM_TAIL}, '(?i)[_ -]REV(?:ISAO)?[_ -]?([A-Z]{{1,3}}\\d*|0)$', 1), ''), regexp_extract({_CLAIM_TAIL}, '(?i)[_ -]([A-Z]{{1,3}}\\d*|0)$', 1))")
_SIGN = " || '|' || ".join([d.rev("revision"), d.norm("case when trim(posting_status) <> '' then posting_status else status end"), d.txt("dispatch"), d.txt("effective_date"), d.txt("path"),
                           *[d.norm(c) for c in ("title", "format", "discipline", "document_type", "purpose", "allocation_status", "comment", "allocation_stage")]])


@query("triage", f"""with m as (select request_id, count(*) n, min(dk) dk from {_M} group by 1),
  f as (select r.request_id, q.raw, {d.norm('q.hint')} hint, case when m.n = 1 then 'match' when m.n > 1 then 'ambiguous' else 'missing' end outcome, case when m.n = 1 then m.dk else '' end dk from {_REQ} r join {d.v('requests')} q on q.request_id = r.request_id left join m on m.request_id = r.request_id),
  p as (select distinct dk, hint from f where outcome = 'match'), r as (select p.dk, p.hint, g.*, {_SIGN} sig, {d.norm('g.sheet')} sh, {d.norm('g.allocation_status')} = 'NAO ALOCADO' blk, {d.rev('g.revision')} rv from p join {REG} g on {d.key('g.document')} = p.dk),
  u as (select *, hint = '' or sh = hint used from r), c as (select dk, hint, case when count(*) filter (where used) = 0 then 'sheet_mismatch' when hint = '' and count(distinct sh) filter (where used) > 1 then 'ambiguous'
  when count(*) filter (where used) > 1 and count(distinct sig) filter (where used) > 1 then 'ambiguous' else 'chosen' end choice, case when count(*) filter (where used) = 0 then max(blk) else coalesce(max(blk) filter (where used), false) end anyb from u group by 1, 2),
  b as (select * from (select *, row_number() over (partition by dk, hint order by {_A}) i from u where used) where i = 1),
  hh as (select document, max((cast({d.rev_rank('rev')} as bigint), rev)) h from (select document, {d.rev('revision')} rev from {HIST}) group by 1),
  s as (select dk, hint, rv, case when count(*) filter (where hint <> '' and sh = hint) > 0 then case when count(*) filter (where hint <> '' and sh = hint) = 1 then min(({d.txt('dispatch')}, {d.txt('effective_date')})) filter (where hint <> '' and sh = hint) end
  when count(*) = 1 then min(({d.txt('dispatch')}, {d.txt('effective_date')})) end w from r group by 1, 2, 3),
  e as (select p.dk, p.hint, c.choice, coalesce(c.anyb, false) anyb, case when c.choice = 'chosen' then b.document else '' end code, case when c.choice = 'chosen' then b.rv else '' end tr, case when c.choice = 'chosen' then b.allocation_status end al, hh.h from p left join c on c.dk = p.dk and c.hint = p.hint
  left join b on b.dk = p.dk and b.hint = p.hint left join hh on {d.key('hh.document')} = p.dk),
  e2 as (select *, case when ({d.rev_rank('tr')}) >= 0 and ({d.rev_rank('tr')}) >= coalesce(h[1], -1) then tr when coalesce(h[1], -1) >= 0 then h[2] else '' end rev from e),
  e3 as (select e2.*, st.state, s.w, case when st.state = 'single' then {d.kind('st.first_raw')} else 'not_posted' end kd, {d.rev_next('e2.rev')} nx from e2 left join {STATE} st on {d.key('st.document')} = e2.dk and st.rev = e2.rev left join s on s.dk = e2.dk and s.hint = e2.hint and s.rv = e2.rev),
  o as (select f.request_id, f.dk, f.raw, f.outcome, e3.choice, e3.anyb, coalesce(e3.code, '') code, e3.al, e3.rev, e3.state, e3.w[1] wd, e3.w[2] we, e3.w is null wn, e3.kd, e3.nx from f left join e3 on e3.dk = f.dk and e3.hint = f.hint),
  o2 as (select *, case when outcome = 'match' then {_CLAIM} else '' end cl, cast({d.date('we')} as date) ed from o),
  o3 as (select *, case when outcome = 'ambiguous' then 'ambiguous_code' when outcome = 'missing' then 'not_found' when choice is null then 'history_only' when choice = 'sheet_mismatch' then 'sheet_mismatch' when choice = 'ambiguous' then 'conflicting_rows'
  when {d.norm('al')} = 'NAO ALOCADO' then 'not_allocated' when cl <> '' and ({d.rev_kind('cl')}) = 'invalid' then 'invalid_name_revision' when rev = '' then 'empty_revision' when state = 'conflict' then 'status_conflict' when state = 'incomplete' then 'status_blank'
  when kd = 'analysis' then case when wn then 'analysis_no_row' when wd <> '' and coalesce(date_diff('day', ed, date '{_NOW}') between -1 and 30, false) then 'analysis_recent' when wd = '' then 'analysis_no_dispatch' when we = '' then 'analysis_no_date' when ed is null then 'analysis_bad_date' else 'analysis_old' end
  when kd = 'advance' and nx = '' then 'field_revision' when kd not in ('not_posted', 'advance') then 'other_status' when not regexp_matches(code, '^RL-[0-9.]+-(MEC|CIV|ELE|TUB)-') then 'invalid_code' when kd = 'advance' then 'ready_next' else 'ready' end reason from o2)
  select request_id, dk document_key, case when reason like 'ready%' then 'ready' when reason = 'analysis_recent' then 'discard' else 'review' end decision,
  case when reason in ('sheet_mismatch', 'conflicting_rows') and anyb then 'not_allocated_conflict' when reason = 'not_allocated' then 'not_allocated' else '' end block_code, reason,
  case when reason = 'ready_next' or (reason = 'invalid_code' and kd = 'advance') then nx when reason in ('ambiguous_code', 'not_found', 'history_only', 'sheet_mismatch', 'conflicting_rows') then '' when reason = 'invalid_name_revision' then cl else coalesce(rev, '') end revision from o3""")
def _(load):
    valid = F.col("document").rlike(r"^RL-[0-9.]+-(MEC|CIV|ELE|TUB)-")
    return TR.triage(load("requests"), load("register"), load("history"), _NOW, valid)


@query("posting_evidence", f"""select row_no, source_ts, case when {d.txt('dispatch')} <> '' and cast({d.date('effective_date')} as date) is not null then 'complete' when {d.txt('dispatch')} <> '' or {d.txt('effective_date')} <> '' then 'partial' else 'none' end posting from {REG}""")
def _(load):
    return load("register").select("row_no", "source_ts", A.posting_evidence("dispatch", "effective_date").alias("posting"))


_DIAG = "select o_orderkey, case o_custkey % 6 when 0 then 'accepted' when 1 then 'rejected' when 2 then 'pending' when 3 then 'conflict' when 4 then 'empty' else 'unknown' end as kind, o_orderkey % 2 = 0 as in_control, o_orderkey % 3 = 0 as planned, o_orderkey % 5 = 0 as has_code, o_orderkey % 7 < 2 as not_allocated from "


@query("allocation_diagnosis", f"""select o_orderkey, case when kind = 'accepted' then 'allocated' when kind = 'rejected' then 'rejected' when kind = 'pending' and in_control then 'pending_control' when kind = 'pending' then 'pending_external' when kind = 'conflict' then 'conflict'
  when not_allocated and in_control and has_code then 'pending_control' when not_allocated and in_control then 'not_allocated_control' when (not_allocated or kind = 'empty') and not in_control then case when planned then 'new_planned' else 'new_control' end when in_control then 'pending_control' else 'review' end diagnosis from ({_DIAG} orders)""")
def _(load):
    rows = load("orders").selectExpr(*[c.strip() for c in _DIAG[len("select "):-len(" from ")].replace("o_orderkey, case", "o_orderkey|case").replace(" as kind, ", " as kind|").replace("as in_control, ", "as in_control|").replace("as planned, ", "as planned|").replace("as has_code, ", "as has_code|").split("|")])
    return rows.select("o_orderkey", A.diagnosis(F.col("kind"), F.col("in_control"), F.col("planned"), F.col("has_code"), F.col("not_allocated")).alias("diagnosis"))


_LV = ["l1", "l2", "l3"]


def _inferred(load):
    """Path the documents of a work code and class agree on."""
    ctl = load("control").withColumn("profile", F.regexp_extract("document", r"^[A-Z]+-\d+\.(\d+)", 1))
    vote = E.profile_evidence_vote(ctl, ["profile"], "document", "path").select("profile", "path", (F.col("verdict") == "conflict").alias("conflict"))
    docs = load("register").select(text.canon_key("document").alias("document_key")).distinct().withColumn("profile", F.regexp_extract("document_key", r"^[A-Z]+-\d+\.(\d+)", 1))
    return docs.join(vote, "profile").select("document_key", "path", "conflict")


def _analysis(load):
    planned = load("orders").filter("o_orderkey % 4 = 1").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("n"))
    known = load("register").select("document").distinct().withColumn("n", F.right("document", F.lit(12)))
    planned = known.join(planned, "n", "left_semi").select(text.loose_key("document").alias("loose_key"))
    conf = load("confirmations").withColumn("comment", F.when(F.col("comment") == "N/A", "").otherwise(F.col("comment")))
    return A.allocation_analyze(load("requests"), load("register"), load("control"), conf, planned, _inferred(load), "AL", _LV), planned


_DEC = lambda x: f"coalesce({x} in ('accepted', 'rejected', 'pending'), false)"
_FILL = lambda *cs: "coalesce(" + ", ".join(f"nullif({d.txt(c)}, '')" for c in cs) + ", '')"
_HOUT = OUTCOME.replace("status", "h.status").replace("comment", "h.comment")
ANALYSIS = f"""(with m as (select request_id, count(*) n, min(dk) dk from {_MAX} group by 1),
  f as (select r.request_id, case when m.n = 1 then 'match' when m.n > 1 then 'ambiguous' else 'missing' end outcome, case when m.n = 1 then m.dk else '' end dk from {_REQ} r left join m on m.request_id = r.request_id),
  hit as (select dk, min(request_id) request_id from f where outcome = 'match' group by 1), rec as (select * from (select *, row_number() over (partition by document order by row_no desc, source_ts desc) n from {REG}) where n = 1),
  cf as (select document, max(field not in ('allocation', 'allocation_status')) blocking from {CONFLICTS} where scope = 'technical' group by 1),
  h as (select * from (select *, row_number() over (partition by {d.loose('document')} order by coalesce({d.yr('allocation')}::bigint * 100000 + {d.seq('allocation')}, row_no) desc, row_no desc) n from {CTL}) where n = 1),
  ev as (select document, (coalesce({d.yr('allocation')}, 0)::bigint * 100000 + coalesce({d.seq('allocation')}, 0), {d.day('return_date')}, source_modified, source_row) rk, {OUTCOME} oc, allocation, comment from (select * replace (case when comment = 'N/A' then '' else comment end as comment) from {d.v('confirmations')})),
  ce as (select * from (select *, row_number() over (partition by document order by rk desc) n from ev) where n = 1),
  bp as (select * from (select *, row_number() over (partition by pk order by votes desc, sig) n from (select {d.path_key('path')} pk, {d.norm('l1')} || '|' || {d.norm('l2')} || '|' || {d.norm('l3')} sig, count(*) votes, min(l1) l1, min(l2) l2, min(l3) l3 from {CTL} where {d.path_key('path')} <> '' group by 1, 2)) where n = 1),
  pv as (select *, sum(n) over (partition by prof) tot, count(*) over (partition by prof) k, row_number() over (partition by prof order by n desc, p) i from (select regexp_extract(document, '^[A-Z]+-\\d+\\.(\\d+)', 1) prof, {d.path_key('path')} pk, min(path) p, count(distinct document) n from {CTL} where {d.path_key('path')} <> '' group by 1, 2)),
  o as (select hit.request_id, hit.dk, rec.*, coalesce(cf.blocking, false) blocking, cf.document is not null anyc, h.document is not null ic, h.allocation ha, h.status hs, h.comment hc, h.path hp, h.l1 h1, h.l2 h2, h.l3 h3, {_HOUT} ho, ce.oc co, ce.allocation ca, ce.comment cc, right(rec.document, 12)::bigint % 4 = 1 planned,
  case when pv.n >= 3 and pv.n * 100 >= pv.tot * 80 then pv.p else '' end ip from hit join rec on {d.key('rec.document')} = hit.dk left join cf on cf.document = rec.document left join h on {d.loose('h.document')} = {d.loose('rec.document')} left join ce on {d.key('ce.document')} = hit.dk
  left join pv on pv.i = 1 and pv.prof = regexp_extract(hit.dk, '^[A-Z]+-\\d+\\.(\\d+)', 1)),
  a as (select *, case when {_DEC('co')} then co when ic and {_DEC('ho')} then ho when {d.norm('allocation_status')} = 'NAO ALOCADO' then 'not_allocated' when {d.norm('allocation_status')} = 'ALOCADO' then 'accepted' when {d.norm('allocation_status')} <> '' then 'unknown' else 'empty' end res,
  case when {_DEC('co')} then 'confirmation' when ic and {_DEC('ho')} then 'control' else 'register' end rsrc, {_FILL('ca', 'ha', 'allocation')} prev, case when {d.path_complete('path')} then 'register' when {d.path_complete("coalesce(hp, '')")} then 'history' when {d.path_complete("coalesce(ip, '')")} then 'inferred' else 'none' end psrc from o),
  b as (select *, case psrc when 'register' then {d.txt('path')} when 'history' then {d.txt('hp')} when 'inferred' then ip else '' end op, {d.norm('allocation_status')} = 'NAO ALOCADO' na from a),
  c as (select b.*, bp.pk is not null bpk, bp.l1 p1, bp.l2 p2, bp.l3 p3, case when coalesce(h1, '') <> '' or coalesce(h2, '') <> '' or coalesce(h3, '') <> '' then 'history' when bp.pk is not null then 'path' else 'none' end lsrc,
  case when res = 'rejected' and rsrc = 'confirmation' and coalesce(cc, '') <> '' then cc else {_FILL('comment', 'cc', 'hc')} end cm from b left join bp on bp.pk = {d.path_key('b.op')} and bp.pk <> '')
  select request_id, 'match' outcome, dk document_key, case when blocking then 'review' when res = 'accepted' then 'skip' when res in ('rejected', 'not_allocated', 'empty') then 'ready' else 'review' end decision,
  case when blocking then 'technical_conflict' when res = 'accepted' then 'allocated' when res = 'rejected' then 'rejected' when res = 'pending' then case when ic then 'pending_control' else 'pending_external' end when na and ic then case when prev <> '' then 'pending_control' else 'not_allocated_control' end
  when na or (res = 'empty' and not ic) then case when planned then 'new_planned' else 'new_control' end when ic then 'pending_control' else 'review' end diagnosis, res resolution, rsrc resolution_source, prev previous_allocation, psrc path_source, op path, lsrc level_source,
  {', '.join(f"case lsrc when 'history' then coalesce(h{i}, '') when 'path' then p{i} else '' end l{i}" for i in (1, 2, 3))},
  case when {d.txt('dispatch')} <> '' and cast({d.date('effective_date')} as date) is not null then 'complete' when {d.txt('dispatch')} <> '' or {d.txt('effective_date')} <> '' then 'partial' else 'none' end posting,
  case when res = 'rejected' and not blocking then 'reallocation after ' || prev || case when cm <> '' then ': ' || cm else '' end else '' end observation,
  array_to_string(list_filter([case when {d.txt('discipline')} = '' and {d.norm('purpose')} <> 'CONFORME CONSTRUIDO' then 'workflow_empty' end, case when op = '' then 'path_empty' end, case when lsrc = 'none' then 'levels_empty' end, case when psrc = 'inferred' then 'path_inferred' end,
  case when anyc and not blocking then 'allocation_fields_differ' end], lambda x: x is not null), ',') warnings, case when {d.norm('purpose')} = 'CONFORME CONSTRUIDO' then '' else {d.txt('discipline')} end workflow from c
  union all select request_id, outcome, '', 'review', case when outcome = 'missing' then 'not_found' else 'ambiguous' end, '', '', '', '', '', '', '', '', '', '', '', '', '' from f where outcome <> 'match')"""


@query("allocation_analyze", f"select * from {ANALYSIS}")
def _(load):
    return _analysis(load)[0]


@query("allocation_rows", f"select document_key document, '2024-02-01' planned_date, workflow, path, observation, l1 n1, l2 n2, l3 n3, '' n4, '' n5, '' n6 from {ANALYSIS} where decision = 'ready'")
def _(load):
    return A.allocation_rows(_analysis(load)[0], _LV, "2024-02-01")


@query("control_rows", f"""select r.sheet, case when {d.txt('deadline')} <> '' then {d.txt('deadline')} else {d.txt('version')} end deadline_or_version, 'PENDING' status, 'AL-0100-2024' batch, (right(a.document_key, 12)::bigint % 4 = 1)::int planned, a.document_key document,
  '2024-02-01' planned_date, a.workflow, a.path, a.observation, l1 n1, l2 n2, l3 n3, '' n4, '' n5, '' n6 from {ANALYSIS} a join (select *, row_number() over (partition by document order by row_no desc, source_ts desc) n from {REG}) r on r.n = 1 and {d.key('r.document')} = a.document_key where decision = 'ready'""")
def _(load):
    analysis, planned = _analysis(load)
    return A.control_rows(A.allocation_rows(analysis, _LV, "2024-02-01"), load("register"), planned, "PENDING", "AL-0100-2024")


@query("allocation_selection", f"""select document_key, document_key <> '' and diagnosis <> 'technical_conflict' selectable, document_key <> '' and diagnosis <> 'technical_conflict' and decision = 'ready' default_selected,
  document_key <> '' and diagnosis <> 'technical_conflict' and case when right(document_key, 1) = '3' then true else decision = 'ready' end selected, document_key <> '' and diagnosis <> 'technical_conflict' and right(document_key, 1) = '3' and decision <> 'ready' manual from {ANALYSIS}""")
def _(load):
    choices = load("register").select(text.canon_key("document").alias("document_key")).distinct().filter(F.right("document_key", F.lit(1)) == "3").withColumn("selected", F.lit(True))
    return A.allocation_selection(_analysis(load)[0], choices)


@query("batch_plan", f"""select *, group_no > 9999 exhausted from (select case when k = '' then '~ no workflow' else l end label, n documents, k = '' blocking, 7 + row_number() over (order by {d.norm("case when k = '' then '~ no workflow' else l end")}) group_no,
  'AL-' || lpad((7 + row_number() over (order by {d.norm("case when k = '' then '~ no workflow' else l end")}))::varchar, 4, '0') || '-2024' batch_code from (select {d.norm('workflow')} k, min(workflow) l, count(*) n from {ANALYSIS} where decision = 'ready' group by 1))""")
def _(load):
    ready = _analysis(load)[0].filter("decision = 'ready'")
    return A.batch_plan(ready, "workflow", "AL", 8, 2024)


# --- audits -----------------------------------------------------------------
_PEERS = f"""(with r as (select * from (select *, row_number() over (partition by document order by row_no desc, source_ts desc) n from {REG}) where n = 1),
  x as (select document, path, split_part(document, '-', 3) fam, discipline, {d.title_kind('title')} kind from r), ok as (select * from x where {d.path_complete('path')}),
  vb as (select fam || '|' || discipline || '|' || kind k, {d.path_key('path')} pk, min(path) p, count(*) c from ok where discipline <> '' and kind <> '' group by 1, 2), ve as (select fam || '|' || discipline k, {d.path_key('path')} pk, min(path) p, count(*) c from ok where discipline <> '' group by 1, 2),
  tb as (select * from (select *, sum(c) over (partition by k) tot, lead(c) over (partition by k order by c desc, p) sec, row_number() over (partition by k order by c desc, p) i from vb) where i = 1 and c >= 2 and c * 100 >= tot * 70 and not (sec is not null and c - sec < 2 and c * 100 < tot * 86)),
  te as (select * from (select *, sum(c) over (partition by k) tot, lead(c) over (partition by k order by c desc, p) sec, row_number() over (partition by k order by c desc, p) i from ve) where i = 1 and c >= 3 and c * 100 >= tot * 82 and not (sec is not null and c - sec < 2 and c * 100 < tot * 86))
  select x.document, x.path, coalesce(tb.p, te.p, '') pv, case when tb.p is not null then 'B' when te.p is not null then 'E' else '' end ctx from x left join tb on x.kind <> '' and x.discipline <> '' and tb.k = fam || '|' || x.discipline || '|' || kind
  left join te on x.discipline <> '' and te.k = fam || '|' || x.discipline)"""
_TOK = lambda x: f"list_sort({d.title_toks(x)})"
_WHOLE = "description || ' ' || notes"
_MAPPED = f"""(with t as (select document, {d.title_kind('title')} kind, {_TOK('title')} tok, {d.norm('discipline')} disc from (select *, row_number() over (partition by document order by row_no desc, source_ts desc) n from {REG}) where n = 1),
  pr as (select distinct kind, tok, disc from t where kind <> ''), c as (select description, notes, path, min(entry_id) id from {d.v('path_catalog')} where {d.path_complete('path')} group by 1, 2, 3),
  e as (select {d.title_kind(_WHOLE)} kind, {_TOK(_WHOLE)} etok, {d.norm(_WHOLE + " || ' ' || path")} names, {d.path_key('path')} pk, path, id from c),
  s as (select pr.*, pk, path, id, 65 + case when disc <> '' and contains(names, disc) then 24 else 0 end + least(28, 4 * len(list_intersect(tok, etok))) + cast(floor(len(list_intersect(tok, etok)) / greatest(len(tok), len(etok), 1) * 28 + 0.5) as integer) sc from pr join e using (kind)),
  pp as (select *, row_number() over (partition by kind, tok, disc, pk order by sc desc, id) i from s), r as (select *, row_number() over (partition by kind, tok, disc order by sc desc, id) n from pp where i = 1),
  b as (select a.kind, a.tok, a.disc, a.path, a.sc, case when a.sc < 76 then 'none' when z.sc is not null and a.sc - z.sc < 10 then 'conflict' else 'found' end outcome from r a left join r z on z.n = 2 and z.kind = a.kind and z.tok = a.tok and z.disc = a.disc where a.n = 1)
  select document, coalesce(outcome, 'none') outcome, case when outcome = 'found' then path else '' end path, case when outcome = 'found' then case when sc >= 100 then 'high' else 'medium' end else 'none' end confidence
  from t left join b on b.kind = t.kind and b.tok = t.tok and b.disc = t.disc)"""
_KNOWN = f"(select {d.path_key('path')} from {d.v('path_catalog')} where {d.path_complete('path')})"
_TWO_TITLES = f"(select document from {REG} where {d.norm('title')} <> '' group by document having count(distinct {d.norm('title')}) > 1)"
_CTRL = f"(select document_key document, path_status st, path p from ({ORACLES['exact_then_other_year']}))"


def _latest(load):
    return latest_by(load("register"), ["document"], [F.col("row_no"), F.col("source_ts")], ["path", "title", "discipline"])


def _audit_inputs(load):
    rec = _latest(load)
    facts = rec.withColumn("fam", F.get(F.split("document", "-"), F.lit(2))).withColumn("kind", codes.title_kind("title")).withColumn("vote_path", F.when(codes.path_complete("path"), F.col("path")).otherwise(""))
    # votes are counted per path key, so spellings of one path vote together
    facts = facts.withColumn("vote_path", F.when(F.col("vote_path") == "", "").otherwise(F.regexp_replace("vote_path", r"\s*\|\s*", "|")))
    peers = E.backoff_vote(facts, "document", [("B", [F.col("fam"), F.col("discipline"), F.col("kind")], 2, 70), ("E", [F.col("fam"), F.col("discipline")], 3, 82)], "vote_path")
    return rec, peers, load("path_catalog"), S.catalog_score_audit(rec, "document", load("path_catalog"))


def _controlled(load):
    docs = load("register").groupBy(F.col("document").alias("document_key")).agg(F.max("allocation").alias("allocation"))
    evidence = load("confirmations").withColumn("document_key", text.canon_key("document"))
    return E.exact_then_other_year(docs, evidence, "AL").select(F.col("document_key").alias("document"), "path_status", "path")


def _path_audit_sql(controlled: bool) -> str:
    infer = """case when mo = 'conflict' or (mo = 'found' and pv <> '' and {} <> {}) then 'conflict' when mo = 'found' then 'catalog' when pv <> '' then 'peers' else 'none' end""".format(d.path_key("pv"), d.path_key("mp"))
    settle = "case when full_ then 'none' when st = 'found' then 'controlled' when st in ('conflict', 'wrong_year_only', 'allocation_missing') then 'conflict' else 'none' end"
    return f"""(with s as (select p.*, c.st, c.p cp, m.outcome mo, m.path mp, m.confidence mc, {d.path_complete('p.path')} and {d.norm('p.path')} <> '' full_ from {_PEERS} p left join {_CTRL} c on c.document = p.document left join {_MAPPED} m on m.document = p.document),
  t as (select *, {settle if controlled else infer} src from s),
  u as (select *, case src when 'controlled' then cp when 'catalog' then mp when 'peers' then pv else '' end sug from t),
  v as (select *, {d.path_key('path')} in {_KNOWN} known, case when not full_ then 'missing' when {d.path_key('path')} in {_KNOWN} or (sug <> '' and {d.path_key('sug')} = {d.path_key('path')}) then 'ok' when sug <> '' then 'divergent' else 'unconfirmed' end iss from u),
  w as (select *, document in {_TWO_TITLES} clash from v)
  select document, case when clash then 'conflict' else iss end issue, case when clash then 'insufficient' when iss = 'ok' then 'ok' when iss = 'missing' and src = 'controlled' then 'confirmed_error' when iss = 'missing' and sug <> '' then 'suggestion' else 'insufficient' end classification,
  case when iss = 'missing' and not clash then sug else '' end proposed, case when clash then 'none' when iss = 'ok' and known then 'high' when iss in ('divergent', 'unconfirmed') or sug = '' then 'none' when src = 'controlled' then 'high' when src = 'peers' then case ctx when 'E' then 'low' else 'medium' end else mc end confidence,
  case when clash then 'conflict' else src end source, case when src = 'controlled' and not clash then 'approved' else 'pending' end decision from w)"""


PATH_AUDIT = _path_audit_sql(False)
_PATH_COLUMNS = f"document, issue, classification, case when proposed <> '' then {d.path_key('proposed')} else '' end proposed_key, confidence, source, decision"


def _path_audit(load, controlled=None):
    rec, peers, catalog, mapped = _audit_inputs(load)
    conflicts = E.conflict_detect(load("register"), None, fields=["title"])
    return U.path_audit(rec.select("document", "path"), "document", peers, catalog, mapped, controlled, conflicts)


def _path_columns(out):
    return out.select("document", "issue", "classification", F.when(F.col("proposed") != "", codes.path_key("proposed")).otherwise("").alias("proposed_key"), "confidence", "source", "decision")


@query("catalog_score_audit", f"select document, outcome, case when path <> '' then {d.path_key('path')} else '' end path_key, confidence from {_MAPPED}")
def _(load):
    out = S.catalog_score_audit(_latest(load), "document", load("path_catalog"))
    return out.select("document", "outcome", F.when(F.col("path") != "", codes.path_key("path")).otherwise("").alias("path_key"), "confidence")


@query("path_audit", f"select {_PATH_COLUMNS} from {PATH_AUDIT}")
def _(load):
    return _path_columns(_path_audit(load))


@query("path_audit_controlled", f"select {_PATH_COLUMNS} from {_path_audit_sql(True)}")
def _(load):
    return _path_columns(_path_audit(load, _controlled(load)))


_STD = {"RL": "Relatório de inspeção", "PR": "Procedimento"}


def _title_audit(load, mode="auto"):
    reg = load("register")
    rec = latest_by(reg, ["document"], [F.col("row_no"), F.col("source_ts")], ["title", "discipline", "document_type"])
    num = F.right("document", F.lit(12)).cast("bigint")
    tag = F.when(num % 3 == 0, F.concat(F.lit("M-"), F.lpad((num % 5000).cast("string"), 6, "0"))).otherwise("")
    tags = load("tag_list").withColumn("tag_key", text.canonical_tag("tag"))
    # the appendix describes every tag by its discipline
    place = F.when(F.col("cancelled") == 1, U.LAST_RESORT).when(F.col("size_no") % 4 == 0, U.VALVE).otherwise(U.COMPONENT)
    desc = tags.select("tag_key", place.alias("priority"), "description", (F.col("cancelled") == 0).alias("trusted"), (F.col("size_no") % 11 == 0).alias("manual_review"))
    desc = desc.unionByName(tags.select("tag_key", F.lit(U.APPENDIX).alias("priority"), F.col("discipline").alias("description"), F.lit(True).alias("trusted"), F.lit(False).alias("manual_review")))
    desc = desc.groupBy("tag_key", "priority").agg(F.min(F.struct("description", "trusted", "manual_review")).alias("d")).select("tag_key", "priority", "d.*")
    conflicts = E.conflict_detect(reg, None, fields=["title"])
    return U.title_audit(rec, "document", _STD, desc, tag, F.col("document_type"), conflicts, mode)


def _untagged(v, tag):
    """Oracle form of a description without the tag at its start or end."""
    loose = f"array_to_string({_LIST(d.norm(tag))}, '{T.GAP}')"
    lead = f"regexp_replace({v}, '^' || {loose} || '\\s*[-:]\\s*', '')"
    return f"case when {loose} <> '' then regexp_replace({lead}, '\\s*[-:]?\\s*\\b' || {loose} || '\\s*$', '') else {v} end"


_REC = f"""(select document, title, document_type, tag, type, {d.norm('title')} n, {d.norm('type')} tn, {d.ctag('tag')} tag_key, trim({d.rx(d.txt('title'), d._cls() + '+', ' ')}) cur, {_d_missing('title')} miss from (
  select *, case when num % 3 = 0 then 'M-' || lpad(cast(num % 5000 as varchar), 6, '0') else '' end tag, case document_type {' '.join(f"when '{k}' then '{v}'" for k, v in _STD.items())} else '' end as type from (
  select document, title, document_type, cast(right(document, 12) as bigint) num, row_number() over (partition by document order by row_no desc, source_ts desc) i from {d.v('register')}) where i = 1))"""
def _title_audit_sql(mode: str) -> str:
    open_ = f"{d.txt('b.description')} <> '' and priority not in ({', '.join(map(str, U.MODES[mode])) or '0'})"
    desc = f"""(select *, case when not both_ or contains({d.norm('b.description')}, {d.norm('ap')}) then b.description when contains({d.norm('ap')}, {d.norm('b.description')}) then ap else b.description || ' · ' || ap end de from (
  select *, coalesce(b.priority = 2 and not b.manual and ap is not null, false) both_ from (
  select tag_key, min(struct_pack(priority := priority, description := b.description, trusted := b.trusted, manual := b.manual)) filter ({open_}) b, min(b.description) filter ({open_} and priority = 3) ap from (
  select tag_key, priority, min(struct_pack(description := description, trusted := trusted, manual := manual)) b from (
  select {d.ctag('tag')} tag_key, case when cast(cancelled as integer) = 1 then 9 when size_no % 4 = 0 then 1 else 2 end priority, description, cast(cancelled as integer) = 0 trusted, size_no % 11 = 0 manual from {d.v('tag_list')}
  union all select {d.ctag('tag')}, 3, discipline, true, false from {d.v('tag_list')}) group by 1, 2) group by 1)))"""
    judged = f"""(select *, case when miss then 'empty' when tag <> '' and seen <> '' and seen <> upper(tag) then 'wrong_tag' when type <> '' and not (n = tn or starts_with(n, tn || ' ') or starts_with(n, tn || ':')) then 'document_type'
  when sure and not contains(n, {d.norm('tag')}) then 'missing_tag' when descr <> '' and trusted and not contains(n, {d.norm('descr')}) then 'description_mismatch'
  when tag <> '' and not contains(n, {d.norm('tag')}) then 'possible_identifier' when n <> 'RESERVADO' and (miss or (len(list_filter({_LIST('rest')}, lambda w: length(w) >= 3)) < 2 and not regexp_matches(rest, '\\b[A-Z0-9]{{1,4}}(?:-[A-Z])?-[A-Z0-9][A-Z0-9._/-]{{2,}}\\b')) or rest = tn) then 'generic'
  when regexp_matches({d.txt('title')}, '\\s{{2,}}|--|[-–—]\\s*[-–—]|^\\s*[-–—]|[-–—]\\s*$') or regexp_matches(cur, '(?i)\\bTAG\\b\\s*[:\\-]?\\s*[A-Z0-9]') then 'format' else 'ok' end issue from (
  select *, coalesce(b.trusted, false) and descr <> '' trusted, coalesce(b.manual, false) and descr <> '' manual,
  regexp_replace(case when tn <> '' and starts_with(n, tn) then substr(n, length(tn) + 1) else n end, '^[\\s:\\-]+|[\\s:\\-]+$', '', 'g') rest from (
  select r.*, x.b, coalesce(x.both_, false) both_, tag <> '' and x.tag_key is not null sure, case when tag <> '' then coalesce(x.de, '') else '' end descr, upper(regexp_extract(cur, '\\b([A-Za-z]{{1,3}}-\\d{{2,}}[A-Za-z]?)\\b', 1)) seen
  from {_REC} r left join {desc} x on x.tag_key = r.tag_key)))"""
    used = f"(select *, type as kind, case when descr <> '' then descr when miss then '' else {_untagged('_u', 'tag')} end description from (select *, {_untagged('rest', 'seen')} _u from {judged}))"
    keep = "document, issue, type, tag, descr, trusted, manual, miss, n, b, both_, sure, description"
    return f"""(select document, case when c then 'conflict' else issue end issue, case when c then 'insufficient' else cls end classification, case when c then '' else proposed end proposed, case when c then 'none' else conf end confidence,
  case when descr <> '' then 'priority ' || cast(b.priority as varchar) || case when both_ then ' + 3' else '' end else 'current title' end description_source from (
  select *, document in (select document from {d.v('register')} where {d.norm('title')} <> '' group by document having count(distinct {d.norm('title')}) > 1) c,
  case when proposed = '' then 'none' when type <> '' and (trusted or sure) then 'high' when trusted then 'high' when type <> '' or descr <> '' then 'medium' else 'low' end conf from (
  select *, case when issue = 'ok' then 'ok' when manual or issue = 'possible_identifier' then 'insufficient' when issue = 'empty' then case when type <> '' or trusted or sure then 'confirmed_error' else 'insufficient' end
  when issue in ('wrong_tag', 'document_type', 'missing_tag', 'description_mismatch') then 'confirmed_error' else 'suggestion' end cls,
  case when issue not in ('ok', 'possible_identifier') and not manual and composed <> '' and {d.norm('composed')} <> n and (type <> '' or description <> '' or tag <> '') then composed else '' end proposed from {composed(used, keep)})))"""


TITLE_AUDIT = _title_audit_sql("auto")


@query("title_audit", f"select * from {TITLE_AUDIT}")
def _(load):
    return _title_audit(load)


@query("title_audit_appendix", f"select * from {_title_audit_sql('appendix_only')}")
def _(load):
    return _title_audit(load, "appendix_only")


@query("title_audit_issues", f"select issue, classification, confidence, count(*) row_count from {TITLE_AUDIT} group by 1, 2, 3")
def _(load):
    return _title_audit(load).groupBy("issue", "classification", "confidence").agg(F.count(F.lit(1)).alias("row_count"))


_TCLEAN = f"regexp_replace(regexp_replace(string_split({d.txt('tag')}, '/')[-1], '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9._~/\\-]+$', '')"
_RF = f"(select {d.ptag('tag')} n, {d.rx(d.ptag('tag'), '[^A-Z0-9]')} c, tag t from {d.v('tag_list')})"


@query("tag_conference", f"""with r as (select request_id, c clean_code from (select request_id, {_TCLEAN} c, row_number() over (partition by {d.norm(_TCLEAN)} order by request_id, {_TCLEAN}) n from {d.v('tag_requests')}) where n = 1 and {d.norm('c')} <> ''),
  a as (select n, count(*) h, min(t) t from {_RF} group by 1), b as (select c, count(*) h, min(t) t from {_RF} where c <> '' group by 1),
  x as (select r.*, regexp_replace(clean_code, '(?i)^nt[-_]', '') cand, regexp_matches(clean_code, '(?i)^nt[-_]') marked, length(clean_code) between 4 and 120 and regexp_matches({d.ptag('clean_code')}, '[A-Z]') and regexp_matches({d.ptag('clean_code')}, '[0-9]') and regexp_matches(clean_code, '[-_./]') and regexp_full_match(clean_code, '(?i)[A-Z0-9._~/\\-]+') valid from r),
  y as (select x.*, case when a.n is not null then 'contract' when b.c is not null then 'punctuation' else 'none' end mt, coalesce(a.h, b.h, 0) h, coalesce(a.t, b.t, '') t from x left join a on a.n = {d.ptag('x.cand')} left join b on b.c = {d.rx(d.ptag('x.cand'), '[^A-Z0-9]')}),
  z as (select *, case when not valid or h > 1 then 'review' when h = 1 and marked then 'remove_marker' when h = 1 then 'confirmed' when marked then 'non_tagged' else 'add_marker' end status from y)
  select request_id, clean_code, status, case when status in ('remove_marker', 'confirmed') then {d.ptag('t')} when status = 'non_tagged' then case when clean_code like 'nt-%' then clean_code else 'nt-' || cand end when status = 'add_marker' then 'nt-' || cand else clean_code end corrected_code,
  case when valid then mt else 'none' end match_type, status = 'confirmed' and clean_code <> {d.ptag('t')} respelled from z""")
def _(load):
    return X.tag_conference(load("tag_requests"), "request_id", "tag", load("tag_list"), "tag")


_RC = "case issue " + " ".join(f"when '{k}' then '{v[0]}'" for k, v in X.REASONS.items()) + " else 'warning' end"


@query("reason_enrich", f"""select 'DATABOOK_' || upper(issue) reason_code, {_RC} severity, count(*) row_count from {PATH_AUDIT} group by 1, 2""")
def _(load):
    out = X.reason_enrich(_path_audit(load), F.lit("databook"), "issue")
    return out.groupBy("reason_code", "severity").agg(F.count(F.lit(1)).alias("row_count"))


_MK = f"case when {d.txt('tag')} <> '' and {d.txt('discipline')} <> '' then 'TAG::' || {d.norm('discipline')} || '::' || {d.norm('tag')} else 'DOC::' || {d.key('document')} end"
_ED = f"select document, discipline, case when row_no % 4 = 0 then '' else concat('T', cast(row_no % 500 as string)) end as tag, title, case when row_no % 3 = 0 then title else 'auto' end as auto_title, row_no as edited_at, source_ts, '' as proposed, title as current, case when row_no % 5 = 0 then 'ok' else 'generic' end as issue from {REG}"


def _edits(load):
    return load("register").selectExpr("document", "discipline", "case when row_no % 4 = 0 then '' else concat('T', cast(row_no % 500 as string)) end as tag", "title", "case when row_no % 3 = 0 then title else 'auto' end as auto_title",
                                       "row_no as edited_at", "row_no", "source_ts", "'' as proposed", "title as current", "case when row_no % 5 = 0 then 'ok' else 'generic' end as issue")


_MEM = f"(select * from (select {_MK} mk, title lt, row_number() over (partition by {_MK} order by edited_at desc, title desc) n from ({_ED}) where {d.txt('title')} <> '' and {d.norm('title')} <> {d.norm('auto_title')}) where n = 1)"


@query("learned_corrections", f"""select edited_at, source_ts, case when issue <> 'ok' and lt is not null and {d.norm('current')} <> {d.norm('lt')} then {d.norm('lt')} else '' end proposed, coalesce(issue <> 'ok' and lt is not null and {d.norm('current')} <> {d.norm('lt')}, false) learned
  from ({_ED}) e left join {_MEM} m on m.mk = {_MK.replace("document", "e.document").replace("'tag'", "'tag'")}""")
def _(load):
    edits = _edits(load)
    return X.apply_learned(edits, X.learned_corrections(edits, "edited_at")).select("edited_at", "source_ts", "proposed", "learned")


_RN = "select o_orderkey, concat('scan ', cast(o_orderkey as string), case when o_orderkey % 13 = 0 then '.docx' when o_orderkey % 17 = 0 then '' else '.PDF' end) as name, case when o_orderkey % 10 = 0 then '' when o_orderkey % 21 = 0 then 'CON' else concat('N:', cast(o_custkey % 4000 as string)) end as certificate, o_custkey as seq, case when o_orderkey % 4 = 0 then 'review' else 'high' end as confidence from {orders}"


_RENAMES = f"""(with s as (select *, replace(trim(regexp_replace(certificate, '[<>:"/\\\\|?*]', '-', 'g')) || case when o_orderkey % 13 = 0 then '.docx' when o_orderkey % 17 = 0 then '.pdf' else '.pdf' end, '  ', ' ') final_name from ({_RN.replace('{orders}', 'orders')})),
  t as (select *, count(*) over (partition by upper(final_name)) u, regexp_replace(final_name, '\\.[^.]+$', '') b from s),
  v as (select *, case when b = '' then 'empty' when final_name not like '%.pdf' then 'extension' when upper(b) = 'CON' then 'reserved' when u > 1 then 'duplicate' when certificate = '' then 'identifier_missing' when confidence = 'review' then 'identifier_review' else 'ready' end code from t)
  select o_orderkey, name, final_name, code, case when code = 'ready' then 'ready' when code = 'identifier_review' then 'review' else 'blocked' end status from v)"""


def _renames(load):
    orders = load("orders")
    return X.rename_plan(orders.sparkSession.sql(_RN, orders=orders), "name", "certificate", "seq", "confidence", "{certificate}")


@query("rename_plan", f"select o_orderkey, final_name, code, status from {_RENAMES}")
def _(load):
    return _renames(load).select("o_orderkey", "final_name", "code", "status")


_RISK = "case when classification = 'confirmed_error' or issue = 'conflict' then 'error' when classification = 'suggestion' and proposed <> '' then 'suggestion' else 'warning' end risk, proposed <> '' and issue <> 'conflict' approvable"
_ITEMS = f"""(select 'paths' as module, document, issue, proposed, source evidence, case when source = 'catalog' then 'catalog' when source = 'peers' then 'history' when proposed <> '' then 'reference' else 'register' end origin, {_RISK} from {PATH_AUDIT} where issue <> 'ok' and decision = 'pending'
  union all select 'titles', document, issue, proposed, description_source, case when starts_with(description_source, 'priority') then 'descriptions' else 'register' end, {_RISK} from {TITLE_AUDIT} where issue <> 'ok'
  union all select 'relations', document, 'conflict', '', conflict_fields, 'register', 'error', false from {RELATION} where conflict
  union all select 'relations', '', 'not_found', '', 'request', 'register', 'error', false from {d.v('requests')} where request_id not in (select request_id from {_M})
  union all select 'allocation', document_key, diagnosis, '', diagnosis, 'control', case when diagnosis = 'technical_conflict' then 'error' else 'warning' end, false from {ANALYSIS} where decision = 'review'
  union all select 'renames', name, code, final_name, 'file', 'file', case when status = 'blocked' then 'error' else 'warning' end, false from {_RENAMES} where status <> 'ready')"""


@query("pending_queue", f"""select module, issue, origin, risk, approvable, count(*) row_count, count(distinct case when approvable then ({d.norm('proposed')}, {d.norm('evidence')}) end) evidence_groups from {_ITEMS} group by 1, 2, 3, 4, 5""")
def _(load):
    found = M.staged_key_match(load("requests"), "request_id", "raw", M.document_index(load("register").select("document").unionByName(load("history").select("document"))))
    out = X.pending_queue(
        X.path_items(_path_audit(load)), X.title_items(_title_audit(load)),
        X.relation_items(relations.relation_rows(load("register"), load("history")), found.withColumn("document", F.col("request_id").cast("string"))),
        X.allocation_items(_analysis(load)[0]), X.rename_items(_renames(load), "name"),
    )
    groups = F.countDistinct(F.when(F.col("approvable"), F.col("group_key"))).alias("evidence_groups")
    return out.groupBy("module", "issue", "origin", "risk", "approvable").agg(F.count(F.lit(1)).alias("row_count"), groups)


_AP = "select o_orderkey, case when o_orderkey % 9 = 0 then 'stale' else o_orderpriority end as current, case when o_orderkey % 7 = 0 then '' when o_orderkey % 11 = 0 then o_orderpriority else concat('NEW ', o_orderpriority) end as proposed from {orders} union all select o_orderkey, o_orderpriority, 'TWICE' from {orders} where o_orderkey % 50 = 0 union all select -o_orderkey - 1, '', 'LOST' from {orders} where o_orderkey % 500 = 0"
_PLAN = f"""(select a.o_orderkey, 'o_orderpriority' field, {d.txt('a.current')} old_value, {d.txt('a.proposed')} new_value, case when o.o_orderkey is null then 'row_missing' when a.proposed = '' then 'value_missing' when count(*) over (partition by a.o_orderkey) > 1 then 'duplicate_cell'
  when a.current <> '' and o.o_orderpriority <> a.current then 'changed_since' when o.o_orderpriority = a.proposed then 'already_done' else '' end refused from ({_AP.replace('{orders}', 'orders')}) a left join orders o on o.o_orderkey = a.o_orderkey)"""


def _plan(load):
    orders = load("orders")
    return X.change_set_plan(orders.sparkSession.sql(_AP, orders=orders), orders, ["o_orderkey"], "o_orderpriority")


@query("change_set_plan", f"select * from {_PLAN}")
def _(load):
    return _plan(load)


@query("change_set_apply", f"select o.o_orderkey, o.o_orderstatus, coalesce(p.new_value, o.o_orderpriority) o_orderpriority from orders o left join {_PLAN} p on p.o_orderkey = o.o_orderkey and p.refused = ''")
def _(load):
    return X.change_set_apply(load("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), _plan(load), ["o_orderkey"], "o_orderpriority")


@query("output_reconcile", """select 'inputs_not_accounted' issue, count(*) n from customer where c_custkey not in (select o_custkey from orders) union all select 'targets_missing', count(*) from orders where o_orderkey % 9 = 0 union all
  select 'targets_duplicated', count(*) from (select o_custkey || '.pdf' from orders where o_orderkey % 9 <> 0 group by 1 having count(*) > 1)""")
def _(load):
    outputs = load("orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".pdf"))).alias("target"))
    return X.output_reconcile(load("customer").select("c_custkey"), outputs, "c_custkey", "target")


@query("daily_comparison", """select cast(day as varchar) as day, cast(sum(ready) as bigint) ready, cast(sum(failed) as bigint) failed, cast(sum(orders) as bigint) orders, cast(sum(urgent) as bigint) urgent from (
  select cast(ts as date) as day, count(*) filter (where event_type = 'view') ready, count(*) filter (where event_type = 'error') failed, 0 orders, 0 urgent from events group by 1 union all
  select cast(o_orderdate as date) + 9000 - 7500, 0, 0, count(*), count(*) filter (where o_orderpriority = '1-URGENT') from orders group by 1) where day between date '2001-06-01' and date '2024-01-20' group by 1""")
def _(load):
    orders = load("orders").withColumn("at", F.date_add(F.col("o_orderdate").cast("date"), 1500))
    count = F.lit(True)
    return X.daily_comparison({"events": (load("events"), "ts", {"ready": F.col("event_type") == "view", "failed": F.col("event_type") == "error"}),
                               "orders": (orders, "at", {"orders": count, "urgent": F.col("o_orderpriority") == "1-URGENT"})}, "2001-06-01", "2024-01-20")


@query("activity_summary", "select event_type as module, count(*) runs from events group by 1")
def _(load):
    return X.activity_summary(load("events"), "event_type", "ts", "event_id")[0]


@query("activity_recent", "select event_id, event_type, user_id from events order by ts desc, event_id desc limit 50")
def _(load):
    return X.activity_summary(load("events"), "event_type", "ts", "event_id")[1].select("event_id", "event_type", "user_id")
