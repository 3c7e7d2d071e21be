"""Latest rows, choices, timelines, sequence numbers and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import codes, revision, text
from docweave.operators import evidence as E, keyed, ranking as R, sets

from . import duck as d
from .registry import query

REG, HIST = d.v("register"), d.v("history")
_A = f"({d.rev_rank(d.rev('revision'))}) desc, source_ts desc, {d.day('effective_date')} desc, (dispatch <> '')::int desc, row_no desc"


def _latest(src, order, cols="revision, row_no, source_ts", key="document"):
    return f"select {key}, {cols} from (select *, row_number() over (partition by {key} order by {order}) n from {src}) where n = 1"


@query("latest_record", _latest(REG, _A))
def _(load):
    return R.latest_record(load("register"), "document", R.order_revision(), ["revision", "row_no", "source_ts"])


@query("latest_record_history", _latest(HIST, f"{d.day('modified')} desc, {d.day('included')} desc, row_no desc", "revision, row_no"))
def _(load):
    return R.latest_record(load("history"), "document", R.order_history(), ["revision", "row_no"])


@query("latest_record_relation", _latest(REG, f"({d.rev_rank(d.rev('revision'))}) desc, greatest(greatest({d.day('effective_date')}, {d.day('included')}, 0) * 86400000, source_ts, row_no) desc, row_no desc, source_ts desc"))
def _(load):
    return R.latest_record(load("register"), "document", R.order_relation(["effective_date", "included"]), ["revision", "row_no", "source_ts"])


@query("latest_record_row", _latest(REG, "row_no desc, source_ts desc", "row_no, source_ts"))
def _(load):
    return R.latest_record(load("register"), "document", [F.col("row_no"), F.col("source_ts")], ["row_no", "source_ts"])


_LN = lambda f: f"coalesce(max((row_no, source_ts, {d.txt(f)})) filter (where {d.txt(f)} <> ''), (0::bigint, 0::bigint, ''))[3] {f}"


@query("latest_nonempty_value", f"select document, {_LN('title')}, {_LN('effective_date')}, {_LN('comment')} from {REG} group by 1")
def _(load):
    return R.latest_nonempty_value(load("register"), "document", ["title", "effective_date", "comment"], [F.col("row_no"), F.col("source_ts")])


_SIG = " || '|' || ".join([d.rev("revision"), d.norm("case when trim(posting_status) <> '' then posting_status else status end"), d.txt("dispatch"), d.txt("effective_date"), d.txt("path"),
                          *[d.norm(c) for c in ("title", "format", "discipline", "document_type", "purpose", "allocation_status", "comment", "allocation_stage")]])


@query("record_choice", f"""with r as (select *, {_SIG} sig, {d.norm('sheet')} sh, case when right(document, 1)::int % 3 = 0 then 'ET' when right(document, 1)::int % 3 = 1 then 'CV' else '' end hint,
  {d.norm('allocation_status')} = 'NAO ALOCADO' blk from {REG}), u as (select *, hint = '' or sh = hint as used from r),
  a as (select document, count(*) filter (where used) n, count(distinct sh) filter (where used) ns, count(distinct sig) filter (where used) ng, max(hint) hint, max(blk) blk, max(blk) filter (where used) blku from u group by 1),
  b as (select document, row_no, source_ts from (select *, row_number() over (partition by document order by {_A}) i from u where used) where i = 1),
  c as (select *, case when n = 0 then 'sheet_mismatch' when hint = '' and ns > 1 then 'ambiguous' when n > 1 and ng > 1 then 'ambiguous' else 'chosen' end choice from a)
  select c.document, choice, case when n = 0 then blk else coalesce(blku, false) end any_blocked, coalesce(case when choice = 'chosen' then b.row_no end, -1) row_no from c left join b on b.document = c.document""")
def _(load):
    last = F.right("document", F.lit(1)).cast("int") % 3
    rows = load("register").withColumn("hint", F.when(last == 0, "ET").when(last == 1, "CV").otherwise(""))
    return R.record_choice(rows, "document", "hint", ["row_no"]).withColumn("row_no", F.coalesce("row_no", F.lit(-1).cast("bigint")))


STATE = f"""(select document, rev, case when count(*) filter (where raw = '') > 0 then 'incomplete' when count(distinct {d.norm('raw')}) > 1 then 'conflict' else 'single' end state,
  min_by(raw, row_no) first_raw, count(*) n from (select document, {d.rev('revision')} rev, case when trim(posting_status) <> '' then {d.txt('posting_status')} else {d.txt('status')} end raw, row_no from {HIST}) group by 1, 2)"""


@query("status_for_revision", f"select document, rev, state, case when state = 'single' then first_raw else '' end posted_status, n as rows from {STATE}")
def _(load):
    return R.status_for_revision(load("history"), "document")


@query("revision_timeline", f"""with x as (select document, {d.rev('revision')} rev, title, dispatch, row_no, source_ts, 1 tech from {REG} union all select document, {d.rev('revision')}, '', '', row_no, 0, 0 from {HIST}),
  y as (select *, cast({d.rev_rank('rev')} as bigint) rank from x), s as (select document, rev, rank, cast(sum(tech) as bigint) records, cast(sum(1 - tech) as bigint) events,
  coalesce(max((tech, row_no, {d.txt('title')})) filter (where {d.txt('title')} <> ''), (0, 0::bigint, ''))[3] title, coalesce(max((tech, row_no, {d.txt('dispatch')})) filter (where {d.txt('dispatch')} <> ''), (0, 0::bigint, ''))[3] dispatch
  from y where rank >= 0 group by 1, 2, 3), p as (select s.*, case when st.state = 'single' then first_raw when st.state is not null then st.state else 'not_posted' end step_status,
  row_number() over (partition by s.document order by rank desc) i from s left join {STATE} st on st.document = s.document and st.rev = s.rev),
  nx as (select document, {d.rev_next('rev')} rev from p where i = 1 and ({d.kind('step_status')}) = 'advance' and ({d.rev_next('rev')}) <> '')
  select document, rev, rank, records, events, step_status, title, dispatch, false predicted, i = 1 latest from p union all
  select document, rev, cast({d.rev_rank('rev')} as bigint), 0, 0, 'not_posted', '', '', true, false from nx""")
def _(load):
    return R.revision_timeline(load("register"), load("history"), "document")


_SG = "select concat(p_type, ' ', p_name) as label, count(*) as documents from {part} group by 1"


@query("sequence_number_groups", f"""select label, documents, n group_no, 'AL-' || lpad(n::varchar, 4, '0') || '-2024' batch_code, n > 9999 exhausted from (select *, 40 + row_number() over (order by {d.norm('label')}, label) n
  from ({_SG.replace('{part}', 'part')}))""")
def _(load):
    part = load("part")
    return R.sequence_number_groups(part.sparkSession.sql(_SG, part=part), "label", "AL", 41, 2024)


_NAT = d.norm("name")
_NK = f"""array_to_string(list_transform(regexp_extract_all({_NAT}, '[0-9]+|[^0-9]+'), lambda r: case when regexp_matches(r, '^[0-9]') then lpad(length((case when regexp_full_match(r, '0+') then '0' else ltrim(r, '0') end))::varchar, 10, '0') || (case when regexp_full_match(r, '0+') then '0' else ltrim(r, '0') end) else r end), '')"""
_NAME = "concat('Certificado ', cast(o_custkey % 1000 as string), '-', cast(o_orderkey % 37 as string), '.pdf')"


@query("natural_sort_enumerate", f"select o_orderkey, name, row_number() over (order by {_NK}, name, o_orderkey) sequence from (select o_orderkey, {_NAME} as name from orders)")
def _(load):
    files = load("orders").select("o_orderkey", F.expr(_NAME).alias("name"))
    return R.natural_sort_enumerate(files, "name", "o_orderkey")


@query("retain_last_n", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n <= 30")
def _(load):
    return R.retain_last_n(load("events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 30).select("user_id", "event_id")


@query("samples_per_group", f"""select discipline, sample_no, row_no, title from (select *, row_number() over (partition by discipline order by row_no, title) sample_no from (
  select discipline, min((row_no, title))[1] row_no, min((row_no, title))[2] title from {REG} where {d.norm('title')} <> '' group by discipline, {d.norm('title')})) where sample_no <= 8""")
def _(load):
    out = E.samples_per_group(load("register"), ["discipline"], "title", "row_no", 8)
    return out.select("discipline", F.col("sample_no").cast("bigint").alias("sample_no"), "row_no", "title")


@query("sequence_distance", """select o_orderkey, cast(greatest(0, 10 - least(10, abs(o_custkey - c_custkey))) as integer) bonus from orders join customer on c_custkey = o_custkey + o_orderkey % 14""")
def _(load):
    near = load("orders").withColumn("c_custkey", F.col("o_custkey") + F.col("o_orderkey") % 14).join(load("customer").select("c_custkey"), "c_custkey")
    return near.select("o_orderkey", R.sequence_distance(F.col("o_custkey"), F.col("c_custkey")).alias("bonus"))


@query("dedupe_keep_first", f"select k, request_id from (select {d.request_key('raw')} k, request_id, row_number() over (partition by {d.request_key('raw')} order by request_id) n from {d.v('requests')}) where n = 1")
def _(load):
    return keyed.keep_first(load("requests").select(codes.request_key("raw").alias("k"), "request_id"), ["k"], ["request_id"])


@query("dedupe_keep_last", f"select k, request_id from (select {d.request_key('raw')} k, request_id, row_number() over (partition by {d.request_key('raw')} order by request_id desc) n from {d.v('requests')}) where n = 1")
def _(load):
    return keyed.keep_last(load("requests").select(codes.request_key("raw").alias("k"), "request_id"), ["k"], ["request_id"])


_CF = ["revision", "status", "dispatch", "effective_date", "title", "allocation_status", "allocation", "path"]
_T = f"""(select document, {d.rev('revision')} rev, 'technical' k, {d.rev('revision')} revision, {d.norm('posting_status')} status, {', '.join(d.norm(c) + ' ' + c for c in _CF[2:])} from {REG})"""
_H = f"""(select document, {d.rev('revision')} rev, 'history' k, '' revision, {d.norm("case when trim(posting_status) <> '' then posting_status else status end")} status, {', '.join("'' " + c for c in _CF[2:])} from {HIST})"""
_LONG = lambda src: f"(select document, rev, k, field, value from (unpivot {src} on {', '.join(_CF)} into name field value value) where value <> '')"
CONFLICTS = f"""(select document, 'technical' scope, '' rev, field, min(value) first_value, max(value) last_value from {_LONG(_T)} group by 1, 4 having count(distinct value) > 1 union all
  select document, 'history', rev, field, min(value), max(value) from {_LONG(_H)} group by 1, 3, 4 having count(distinct value) > 1 union all
  select document, 'cross', rev, field, min(value), max(value) from (select * from {_LONG(_T)} union all select * from {_LONG(_H)}) where rev <> '' and field not in ('revision', 'title')
  and (document, rev) in (select (t.document, t.rev) from {_T} t join {_H} h on h.document = t.document and h.rev = t.rev) group by 1, 3, 4 having count(distinct value) > 1)"""


@query("conflict_detect", f"select * from {CONFLICTS}")
def _(load):
    return E.conflict_detect(load("register"), load("history"))


_ID = "cast(row_no as varchar) || ':' || cast(source_ts as varchar)"
_LT = _T.replace("(select document,", f"(select document, {_ID} row_id,", 1)
_LH = _H.replace("(select document,", "(select document, cast(row_no as varchar) row_id,", 1)
_IDS = lambda src: f"(select document, row_id, rev, k, field, value from (unpivot {src} on {', '.join(_CF)} into name field value value) where value <> '')"


@query("conflict_values", f"""select c.document, c.scope, c.rev, c.field, v.value, v.k kind, v.row_id from {CONFLICTS} c join (select * from {_IDS(_LT)} union all select * from {_IDS(_LH)}) v
  on v.document = c.document and v.field = c.field where (c.scope = 'technical' and v.k = 'technical') or (v.rev = c.rev and (c.scope = 'cross' or (c.scope = 'history' and v.k = 'history')))""")
def _(load):
    reg = load("register").withColumn("row_id", F.concat_ws(":", F.col("row_no").cast("string"), F.col("source_ts").cast("string")))
    hist = load("history").withColumn("row_id", F.col("row_no").cast("string"))
    return E.conflict_values(reg, hist, E.conflict_detect(reg, hist), "row_id")


@query("conflict_resolve_history", f"""with h as (select document, row_no, {d.rev('revision')} rev from {HIST}), c as (select document, rev, min(row_no) chosen from h where right(document, 1) in ('3', '7') group by 1, 2)
  select h.document, h.row_no, h.rev from h left join c on c.document = h.document and c.rev = h.rev where chosen is null or chosen = row_no""")
def _(load):
    rows = load("history").withColumn("rev", revision.normal_revision("revision"))
    picks = rows.filter(F.right("document", F.lit(1)).isin("3", "7")).groupBy("document", "rev").agg(F.min("row_no").alias("row_no"))
    return E.conflict_resolve_history(rows, picks, "document", "row_no").select("document", "row_no", "rev")


@query("conflict_summary", f"""select document, array_to_string(list_sort(list(distinct field)), ', ') conflict_fields, max(field not in ('allocation', 'allocation_status')) blocking from {CONFLICTS} group by 1""")
def _(load):
    return E.conflict_summary(E.conflict_detect(load("register"), load("history")))


@query("current_records_conflict", f"""with c as ({_latest(REG, _A)}) select c.document, c.revision, c.row_no, {d.rev('c.revision')} rev, coalesce(f, '') conflict_fields from c left join (
  select document, rev, array_to_string(list_sort(list(distinct field)), ', ') f from {CONFLICTS} where scope <> 'technical' and field in ('status', 'dispatch', 'title') group by 1, 2) k on k.document = c.document and k.rev = {d.rev('c.revision')}""")
def _(load):
    fields = ["status", "dispatch", "title"]
    conflicts = E.conflict_detect(load("register"), load("history"), fields=fields)
    return R.current_records_conflict(load("register"), conflicts, "document", fields, ["row_no"])


_CH = f"(select document, max(row_no) row_no from {REG} where right(document, 1) in ('3', '7') group by 1)"


@query("conflict_resolve", f"select r.document, r.row_no, r.source_ts from {REG} r left join {_CH} c on c.document = r.document where c.row_no is null or c.row_no = r.row_no")
def _(load):
    choices = load("register").filter(F.right("document", F.lit(1)).isin("3", "7")).groupBy("document").agg(F.max("row_no").alias("row_no"))
    return E.conflict_resolve(load("register").select("document", "row_no", "source_ts"), choices, "document", "row_no")


@query("union_sources", f"""select 'register' origin, document, row_no, path from {REG} union all select 'history', document, row_no, '' from {HIST} union all select 'control', document, row_no, path from {d.v('control')}""")
def _(load):
    out = sets.union_sources({"register": load("register").select("document", "row_no", "path"), "history": load("history").select("document", "row_no"), "control": load("control").select("document", "row_no", "path")})
    return out.select("origin", "document", "row_no", F.coalesce("path", F.lit("")).alias("path"))


@query("intersect_tokens", f"""select doc_id, array_to_string(list_sort(list_filter({d.title_toks('title')}, lambda t: list_contains({d.title_toks('family')} || ['LARGE', 'RED', 'BOLT'], t))), '|') shared from {d.v('titles')}""")
def _(load):
    other = F.concat(text.title_tokens("family"), F.array(*map(F.lit, ["LARGE", "RED", "BOLT"])))
    return load("titles").select("doc_id", F.array_join(sets.intersect_tokens(text.title_tokens("title"), other), "|").alias("shared"))


@query("set_difference", f"""select doc_id, array_to_string(list_sort(list_filter({d.title_toks('title')}, lambda t: not list_contains({d.title_toks('family')} || ['LARGE', 'RED', 'BOLT'], t))), '|') only_here from {d.v('titles')}""")
def _(load):
    other = F.concat(text.title_tokens("family"), F.array(*map(F.lit, ["LARGE", "RED", "BOLT"])))
    return load("titles").select("doc_id", F.array_join(sets.set_difference(text.title_tokens("title"), other), "|").alias("only_here"))


_OUT = "select o_orderkey, case when o_orderkey % 50 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 75 = 0 then 'none' else o_orderpriority end as o_orderpriority from {orders} where o_orderkey % 101 <> 0 union all select -o_orderkey, o_orderstatus, o_orderpriority from {orders} where o_orderkey % 997 = 1"


@query("preservation_diff", f"""with b as ({_OUT.replace('{orders}', 'orders')}) select a.o_orderkey, '' field, 'lost' change from orders a where o_orderkey not in (select o_orderkey from b) union all
  select o_orderkey, '', 'added' from b where o_orderkey not in (select o_orderkey from orders) union all
  select a.o_orderkey, 'o_orderstatus', case when a.o_orderkey % 100 = 0 then 'approved' else 'not_approved' end from orders a join b on b.o_orderkey = a.o_orderkey and b.o_orderstatus <> a.o_orderstatus union all
  select a.o_orderkey, 'o_orderpriority', 'not_approved' from orders a join b on b.o_orderkey = a.o_orderkey and b.o_orderpriority <> a.o_orderpriority""")
def _(load):
    orders = load("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    out = orders.sparkSession.sql(_OUT, orders=orders)
    approved = orders.filter("o_orderkey % 100 = 0").select("o_orderkey", F.lit("o_orderstatus").alias("field"))
    return sets.preservation_diff(orders, out, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], approved)
