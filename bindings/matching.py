"""Record linkage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text
from docweave.operators import evidence as E, hierarchy as H, matching as M

from . import duck as d
from .registry import query

DOCS = f"""(select dk, doc, {d.loose('doc')} lk from (select {d.key('document')} dk, max(document) doc from {d.v('register')} group by 1))"""
DOCS_ALL = f"""(select dk, doc, {d.loose('doc')} lk from (select {d.key('document')} dk, max(document) doc from (select document from {d.v('register')} union all select document from {d.v('history')}) group by 1))"""
_REQ = f"(select request_id, hint, {d.request_key('raw')} rk from {d.v('requests')})"


def _at(whole, part):
    return f"regexp_matches({whole}, '(^|[^A-Z0-9])' || regexp_escape({part}) || '($|[^A-Z0-9])')"


# The oracle keeps codes by prefix of the 12 digit key only to find candidates; the tests are the plain rules.
_PAIRS = f"""(select r.request_id, r.rk, {d.loose('r.rk')} rl, dk, lk from {_REQ} r, lateral (select distinct unnest(list_concat(
  regexp_extract_all(r.rk, '[0-9]{{12}}'), regexp_extract_all({d.loose('r.rk')}, '[0-9]{{12}}'))) n) x join {DOCS} on right(lk, 12) = x.n)"""
_STAGED = f"""(select *, min(stage) over (partition by request_id) s from (select request_id, dk, lk,
  case when rk = dk then 1 when {_at('rk', 'dk')} then 2 when rl = lk then 3 when contains(rl, lk) then 4 end stage from {_PAIRS}) where stage is not null)"""
_MAX = f"""(select a.request_id, a.dk, a.s from (select * from {_STAGED} where stage = s) a where not exists (select 1 from (select * from {_STAGED} where stage = s) b
  where b.request_id = a.request_id and b.dk <> a.dk and (length(b.dk) > length(a.dk) or length(b.lk) > length(a.lk)) and (contains(b.dk, a.dk) or contains(b.lk, a.lk))))"""


def _docs(load):
    return M.document_index(load("register"))


@query("staged_key_match", f"""with m as (select * from {_MAX}), sh as (select distinct {d.key('document')} dk, {d.norm('sheet')} sheet from {d.v('register')}),
  h as (select m.*, sh.dk is not null inn, max(sh.dk is not null) over (partition by m.request_id) anyin from m join {_REQ} r on r.request_id = m.request_id
  left join sh on sh.dk = m.dk and sh.sheet = {d.norm('r.hint')} and r.hint <> ''), k as (select request_id, count(*) n, min(dk) dk, min(s) s from h where inn or not anyin group by 1)
  select r.request_id, case when n = 1 then 'match' when n > 1 then 'ambiguous' else 'missing' end outcome, case when n = 1 then dk else '' end document_key,
  coalesce(s, 0) stage, coalesce(n, 0) candidates from {_REQ} r left join k on k.request_id = r.request_id""")
def _(load):
    sheets = load("register").select(text.canon_key("document").alias("document_key"), "sheet")
    return M.staged_key_match(load("requests"), "request_id", "raw", _docs(load), "hint", sheets)


@query("containment_match", f"""with c as (select request_id, dk, lk from {_PAIRS} where {_at('rk', 'dk')})
  select a.request_id, a.dk document_key from c a where not exists (select 1 from c b where b.request_id = a.request_id and b.dk <> a.dk
  and (length(b.dk) > length(a.dk) or length(b.lk) > length(a.lk)) and (contains(b.dk, a.dk) or contains(b.lk, a.lk)))""")
def _(load):
    return M.containment_match(load("requests"), "request_id", "raw", _docs(load))


_PART = "concat(case o_orderkey % 3 when 0 then lpad(cast(o_orderkey as string), 12, '0') when 1 then concat('CIV-', lpad(cast(o_orderkey as string), 12, '0')) else 'none' end)"


@query("reverse_containment_match", f"""with r as (select distinct {d.key(_PART)} request_key from orders where length({d.key(_PART)}) >= 4)
  select request_key, dk document_key from r join {DOCS} on right(dk, 12) = right(request_key, 12) and {_at('dk', 'request_key')}""")
def _(load):
    return M.reverse_containment_match(load("orders").select(F.expr(_PART).alias("raw")), "raw", _docs(load))


_REF = f"(select {d.ptag('tag')} n, {d.rx(d.ptag('tag'), '[^A-Z0-9]')} c, tag t from {d.v('tag_list')})"


@query("reference_lookup_ambiguity", f"""with a as (select n, count(*) h, min(t) t from {_REF} group by 1), b as (select c, count(*) h, min(t) t from {_REF} group by 1)
  select request_id, case when a.n is not null then 'contract' when b.c is not null then 'punctuation' else 'none' end match_type,
  case when coalesce(a.h, b.h, 0) = 1 then 'found' when coalesce(a.h, b.h, 0) > 1 then 'conflict' else 'none' end lookup,
  case when coalesce(a.h, b.h, 0) = 1 then coalesce(a.t, b.t) else '' end reference_tag, coalesce(a.h, b.h, 0) hits, r.l_extendedprice
  from (select x.*, {d.ptag('x.tag')} rn, {d.rx(d.ptag('x.tag'), '[^A-Z0-9]')} rc from (select t.request_id, t.tag, t.l_extendedprice from ({d.v('tag_requests').strip()[1:-1].replace('as request_id,', 'as request_id, l_extendedprice,')}) t) x) r
  left join a on a.n = r.rn left join b on b.c = r.rc""")
def _(load):
    li = load("lineitem")
    from .views import VIEWS

    asked = li.sparkSession.sql(VIEWS["tag_requests"].replace("as request_id,", "as request_id, l_extendedprice,"), lineitem=li)
    out = M.reference_lookup(asked, "request_id", "tag", load("tag_list"), "tag")
    return out.select("request_id", "match_type", "lookup", "reference_tag", "hits", "l_extendedprice")


_ENT = f"""(select replace({d.norm('tag')}, ' ', '') sk, {d.ctag('tag')} ck, {d.loose('tag')} nk, {d.norm('discipline')} dis, entry_id from {d.v('tag_list')})"""
_ASK = f"(select distinct tag, {d.norm('discipline')} wanted from {d.v('tag_requests')})"


@query("tag_cascade_match", f"""with e as (select * from {_ENT}), a as (select tag, wanted, replace({d.norm('tag')}, ' ', '') sk, {d.ctag('tag')} ck, {d.loose('tag')} nk from {_ASK}),
  seeds as (select distinct tag, wanted, nk, unnest(flatten(list_transform(generate_series(1, length(nk)), lambda p: list_transform(generate_series(p, length(nk)), lambda q: nk[p:q])))) hit from a),
  keys as (select nk hit, dis, count(*) n, min(entry_id) e from e where length(nk) >= 4 group by 1, 2),
  spans as (select tag, list_distinct(flatten(list_transform(generate_series(1, len(p)), lambda i: list_transform(generate_series(i, len(p)), lambda j: array_to_string(p[i:j], ''))))) sp from (
  select distinct tag, list_filter(regexp_split_to_array({d.norm('tag')}, '[^A-Z0-9]+'), lambda t: t <> '') p from a)),
  hits as (select s.tag, s.wanted, s.hit, k.dis, k.n, k.e, s.hit = s.nk whole from seeds s join keys k on k.hit = s.hit join spans sp on sp.tag = s.tag
  where s.hit = s.nk or (length(s.hit) >= 6 and regexp_matches(s.hit, '[0-9]') and list_contains(sp.sp, s.hit)) or (length(s.nk) >= 8 and length(s.hit) >= 4)),
  alls as (select a.tag, a.wanted, 1 stage, e.sk hit, e.dis, count(*) n, min(entry_id) e from a join e on e.sk = a.sk and a.sk <> '' group by 1, 2, 4, 5 union all
  select a.tag, a.wanted, 2, e.ck, e.dis, count(*), min(entry_id) from a join e on e.ck = a.ck and a.ck <> '' group by 1, 2, 4, 5 union all
  select tag, wanted, case when whole then 3 else 4 end, hit, dis, n, e from hits where dis = wanted union all
  select tag, wanted, case when whole then 5 else 6 end, hit, dis, n, e from hits),
  f as (select *, min(stage) over (partition by tag, wanted) s from alls),
  g as (select tag, wanted, s, hit, case when s <= 2 then coalesce(sum(n) filter (where dis = wanted), sum(n)) else sum(n) end n,
  case when s <= 2 then coalesce(min(e) filter (where dis = wanted), min(e)) else min(e) end e from f where stage = s or (s = 4 and stage = 4) or (s = 6 and stage = 6) group by 1, 2, 3, 4),
  m as (select * from g where not exists (select 1 from g o where o.tag = g.tag and o.wanted = g.wanted and o.hit <> g.hit and contains(o.hit, g.hit))),
  r as (select tag, wanted, min(s) stage, count(*) keys, cast(sum(n) as bigint) entries, min(hit) first_key, min(e) first_entry from m group by 1, 2)
  select q.request_id, coalesce(stage, 0) stage, coalesce(keys, 0) keys, coalesce(entries, 0) entries, coalesce(first_key, '') first_key, coalesce(first_entry, -1) first_entry
  from {d.v('tag_requests')} q left join r on r.tag = q.tag and r.wanted = {d.norm('q.discipline')}""")
def _(load):
    return M.tag_cascade_match(load("tag_requests"), "request_id", "tag", "discipline", load("tag_list"))


_PX = "select p_partkey as entry_id, concat('M-', lpad(cast(p_partkey % 400 as string), 4, '0'), case p_partkey % 4 when 0 then '-EL7' when 1 then 'L12' when 2 then '' else '-X3' end) as tag, concat('1.', cast(p_size as string)) as wbs, p_type as discipline from {part}"
_PR = "select l_partkey % 400 as k, concat('M ', cast(l_partkey % 400 as string)) as tag, concat('1.', cast(l_linenumber * 6 + 1 as string)) as wbs, case l_linenumber % 3 when 0 then 'Small' when 1 then 'large' else 'PROMO' end as discipline from {lineitem}"


@query("prefix_extension_match", f"""select distinct {d.ctag('r.tag')} head, r.wbs, {d.norm('r.discipline')} discipline, c.entry_id, {d.ctag('c.tag')} catalog_key
  from (select distinct tag, wbs, discipline from ({_PR.replace('{lineitem}', 'lineitem')})) r join ({_PX.replace('{part}', 'part')}) c on c.wbs = r.wbs and {d.norm('c.discipline')} = {d.norm('r.discipline')}
  where starts_with({d.ctag('c.tag')}, {d.ctag('r.tag')}) and regexp_full_match(substr({d.ctag('c.tag')}, length({d.ctag('r.tag')}) + 1), '(EL|L)?\\d{{1,2}}')""")
def _(load):
    li, part = load("lineitem"), load("part")
    return M.prefix_extension_match(li.sparkSession.sql(_PR, lineitem=li), part.sparkSession.sql(_PX, part=part))


_BASE = d.v("hierarchy")
_LEV = ["l1", "l2", "l3"]
_SAME = ", ".join(f"case when count(distinct {d.norm(c)}) = 1 and min({d.norm(c)}) <> '' then min({c}) else '' end {c}" for c in _LEV)


@query("wbs_longest_prefix_join", f"""with b as (select *, case when l3 <> '' then 3 when l2 <> '' then 2 else 1 end dp, {d.norm("case when l3 <> '' then l3 when l2 <> '' then l2 else l1 end")} leaf from {_BASE}),
  a as (select doc_id, {d.wbs('wbs')} w, {d.norm('discipline')} dis from {d.v('worked')}),
  c as (select a.doc_id, w, dis, b.*, max(length(code) - length(replace(code, '.', ''))) over (partition by a.doc_id) md from a join b on a.w = b.code or starts_with(a.w, b.code || '.')),
  best as (select * from c where length(code) - length(replace(code, '.', '')) = md), t as (select doc_id, code, count(*) n, max(dp) d, {_SAME} from best group by 1, 2),
  dm as (select b.doc_id, min(b.l1) x1, min(b.l2) x2, min(b.l3) x3 from best b join t on t.doc_id = b.doc_id and t.d = b.dp where b.leaf = b.dis group by 1 having count(*) = 1)
  select a.doc_id, a.w work_code, coalesce(t.code, '') base_code, case when t.code is null then 'none' when t.n = 1 then 'single' when dm.doc_id is not null then 'discipline' else 'shared' end rule,
  coalesce(case when t.n > 1 and dm.doc_id is not null then x1 else t.l1 end, '') l1, coalesce(case when t.n > 1 and dm.doc_id is not null then x2 else t.l2 end, '') l2,
  coalesce(case when t.n > 1 and dm.doc_id is not null then x3 else t.l3 end, '') l3 from a left join t on t.doc_id = a.doc_id left join dm on dm.doc_id = a.doc_id where a.w <> ''""")
def _(load):
    return H.wbs_longest_prefix_join(load("worked"), "doc_id", "wbs", "discipline", load("hierarchy"), _LEV)


@query("wbs_sibling_fallback", f"""with g as (select string_split(code, '.')[1] || '.' || string_split(code, '.')[2] k, * from {_BASE} where len(string_split(code, '.')) >= 3),
  s as (select k, {_SAME} from g group by 1), a as (select doc_id, {d.wbs('wbs')} w from {d.v('worked')})
  select doc_id, w work_code, coalesce(l1, '') l1, coalesce(l2, '') l2, coalesce(l3, '') l3 from a left join s on s.k = string_split(w, '.')[1] || '.' || string_split(w, '.')[2]""")
def _(load):
    return H.wbs_sibling_fallback(load("worked"), "doc_id", "wbs", load("hierarchy"), _LEV)


_NARROW = """select o_orderkey % 3000 as doc_id, o_orderkey as cand_id, concat('1.', cast(o_orderkey % 3000 % 7 + 1 as string), '.3.', cast(o_orderkey % 3000 % 2 + 1 as string)) as wanted,
  case when o_custkey % 5 = 0 then concat('1.', cast(o_orderkey % 3000 % 7 + 1 as string), '.3.', cast(o_orderkey % 3000 % 2 + 1 as string)) when o_custkey % 5 = 1 then concat('1.0', cast(o_orderkey % 3000 % 7 + 1 as string), '.3') else '9.9' end as own,
  case when o_custkey % 4 = 0 then concat('1.', cast(o_orderkey % 3000 % 7 + 1 as string), '.3.', cast(o_orderkey % 3000 % 2 + 1 as string)) else '8.8' end as activity, o_orderstatus = 'F' as same_discipline from {orders}"""


@query("scope_wbs_narrow", f"""with r as (select *, {d.wbs('wanted')} w, {d.wbs('own')} o, {d.wbs('activity')} a from ({_NARROW.replace('{orders}', 'orders')})),
  l as (select *, case when o = w then 1 when len(string_split(w, '.')) >= 4 and o = array_to_string(string_split(w, '.')[:-2], '.') then 2 else 3 end lv from r),
  b as (select * from (select *, min(lv) over (partition by doc_id) m from l) where lv = m), c as (select *, max(a = w) over (partition by doc_id) anya from b),
  e as (select *, m = 2 and anya by_activity from c), f as (select * from e where not by_activity or a = w), g as (select *, max(same_discipline) over (partition by doc_id) anyd from f)
  select doc_id, cand_id, wanted, own, activity, same_discipline, m scope_level, by_activity from g where same_discipline or not anyd""")
def _(load):
    orders = load("orders")
    return H.scope_wbs_narrow(orders.sparkSession.sql(_NARROW, orders=orders), "doc_id", "wanted", "own", "activity", "same_discipline")


@query("source_priority_coalesce", f"""with a as (select code, min(description) v from (select {d.ctag('tag')} code, description, cancelled from {d.v('tag_list')}) where cancelled = 0 group by 1),
  b as (select {d.ctag('tag')} code, min(discipline) v from {d.v('tag_list')} where size_no % 2 = 0 group by 1), c as (select {d.ctag('tag')} code, min('cancelled ' || description) v from {d.v('tag_list')} where cancelled = 1 group by 1)
  select k.code, coalesce(a.v, b.v, c.v, '') value, case when a.v is not null then 'active' when b.v is not null then 'repair' when c.v is not null then 'cancelled' else 'none' end provenance
  from (select distinct {d.ctag('tag')} code from {d.v('tag_requests')}) k left join a on a.code = k.code left join b on b.code = k.code left join c on c.code = k.code""")
def _(load):
    tags = load("tag_list").withColumn("code", text.canonical_tag("tag"))
    per = lambda rows, v: rows.groupBy("code").agg(F.min(v).alias("value"))
    sources = [
        ("active", per(tags.filter("cancelled = 0"), F.col("description"))),
        ("repair", per(tags.filter("size_no % 2 = 0"), F.col("discipline"))),
        ("cancelled", per(tags.filter("cancelled = 1"), F.concat(F.lit("cancelled "), F.col("description")))),
    ]
    asked = load("tag_requests").select(text.canonical_tag("tag").alias("code")).distinct()
    return E.source_priority_coalesce(asked, "code", sources, "value")


_DA = f"(select distinct document document_key, max(allocation) over (partition by document) allocation from {d.v('register')})"


@query("exact_then_other_year", f"""with ev as (select {d.key('document')} dk, {d.seq('allocation')} s, {d.yr('allocation')} y, kind, {d.path_key('path')} pk, path, {d.day('return_date')} rd, source_modified, source_row
  from {d.v('confirmations')}), a as (select document_key, allocation, {d.seq('allocation')} s, {d.yr('allocation')} y from {_DA}),
  k as (select a.document_key, e.kind, count(distinct pk) paths, count(*) n, max_by(path, (rd, source_modified, source_row)) path from a join ev e on e.dk = a.document_key and e.s = a.s and e.y = a.y group by 1, 2),
  b as (select * from (select *, row_number() over (partition by document_key order by case when kind = 'confirmation' then 0 else 1 end) i from k) where i = 1),
  o as (select a.document_key, array_to_string(list_transform(list_sort(list(distinct e.y)), lambda v: v::varchar), ', ') ys from a join ev e on e.dk = a.document_key and e.s = a.s and e.y <> a.y group by 1)
  select a.document_key, a.allocation, case when a.s is null then 'allocation_missing' when b.paths > 1 then 'conflict' when b.paths = 1 then 'found' when o.ys is not null then 'wrong_year_only' else 'not_found' end path_status,
  coalesce(b.kind, '') path_kind, case when a.s is not null and b.paths = 1 then b.path else '' end path, coalesce(b.n, 0) support,
  case when a.s is not null and b.paths is null and o.ys is not null then o.ys else '' end other_years from a left join b on b.document_key = a.document_key left join o on o.document_key = a.document_key""")
def _(load):
    docs = load("register").groupBy(F.col("document").alias("document_key")).agg(F.max("allocation").alias("allocation"))
    ev = load("confirmations").withColumn("document_key", text.canon_key("document"))
    return E.exact_then_other_year(docs, ev, "AL")


_OUTC = f"{d.norm('status')} || ' ' || {d.norm('comment')}"
OUTCOME = f"""case when regexp_matches({_OUTC}, '\\b(RECUSAD[OA]?|NAO ALOCAD[OA]?|FAVOR VERIFICAR|CORRIGIR)\\b') then 'rejected'
  when regexp_matches({_OUTC}, '\\b(ALOCAD[OA]?|ACEIT[OA]?|OK)\\b') and not regexp_matches({_OUTC}, '\\bNAO\\s+(ALOCAD|ACEIT)') then 'accepted'
  when regexp_matches({_OUTC}, '\\b(PENDENTE|EM ANALISE)\\b') then 'pending' else 'unknown' end"""
_LE_SRC = f"(select * replace (case when source_row % 30 < 3 then 'AL-0001-2023' else allocation end as allocation, case when source_row % 30 < 3 then 0 else source_modified end as source_modified, case when source_row % 30 < 3 then '' else return_date end as return_date, case when source_row % 30 < 3 then 1 else source_row end as source_row) from {d.v('confirmations')})"


@query("latest_evidence_asof", f"""with r as (select {d.key('document')} document_key, (coalesce({d.yr('allocation')}, 0)::bigint * 100000 + coalesce({d.seq('allocation')}, 0), {d.day('return_date')}, source_modified, source_row) rk,
  {OUTCOME} oc, allocation, status from {_LE_SRC}), t as (select * from (select *, max(rk) over (partition by document_key) mx from r) where rk = mx)
  select document_key, count(distinct oc) > 1 conflict, case when count(distinct oc) > 1 then 'conflict' else max(oc) end outcome, max((allocation, status))[1] allocation, max((allocation, status))[2] status from t group by 1""")
def _(load):
    odd = F.col("source_row") % 30 < 3
    rows = load("confirmations").withColumn("allocation", F.when(odd, "AL-0001-2023").otherwise(F.col("allocation")))
    rows = rows.withColumn("source_modified", F.when(odd, 0).otherwise(F.col("source_modified"))).withColumn("return_date", F.when(odd, "").otherwise(F.col("return_date")))
    rows = rows.withColumn("source_row", F.when(odd, 1).otherwise(F.col("source_row"))).withColumn("document_key", text.canon_key("document"))
    return E.latest_evidence(rows, "document_key", "AL", ["allocation", "status"])


@query("allocation_outcome_classify", f"select source_row, {OUTCOME} outcome from {d.v('confirmations')}")
def _(load):
    return load("confirmations").select("source_row", E.classify_outcome("status", "comment").alias("outcome"))


@query("planned_flag_join", """select o_orderkey, c.c_custkey is not null planned, c2.c_custkey is not null in_control from orders left join (select c_custkey from customer where c_custkey % 4 = 0) c
  on c.c_custkey = o_custkey left join (select distinct c_custkey from customer where c_acctbal > 0) c2 on c2.c_custkey = o_custkey""")
def _(load):
    cust = load("customer")
    from docweave.plans.allocation import planned_flags

    return planned_flags(load("orders").select("o_orderkey", "o_custkey"), "o_custkey", cust.filter("c_custkey % 4 = 0"), cust.filter("c_acctbal > 0"), "c_custkey").select(
        "o_orderkey", "planned", "in_control"
    )


@query("missing_anti", f"""select r.request_id, r.raw from {d.v('requests')} r where {d.request_key('r.raw')} not in (select dk from {DOCS})""")
def _(load):
    asked = load("requests").select("request_id", "raw", M.codes.request_key("raw").alias("document_key"))
    return asked.join(_docs(load), "document_key", "left_anti").select("request_id", "raw")


@query("allocation_membership", f"""select distinct document from {d.v('register')} where contains({d.norm('allocation')}, 'AL-0007')""")
def _(load):
    hit = load("register").filter(F.contains(text.norm("allocation"), F.lit("AL-0007"))).select("document").distinct()
    return load("register").select("document").distinct().join(hit, "document", "left_semi")
