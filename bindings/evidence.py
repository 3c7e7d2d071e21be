"""Vote, consensus and count queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import codes, text
from docweave.operators import evidence as E, hierarchy as H, ranking as R, titles as T

from . import duck as d
from .cleaning import _d_missing, _d_noparen, _d_title_part
from .registry import query

REG, CTL = d.v("register"), d.v("control")
_LV = ["l1", "l2", "l3"]


@query("majority_vote", f"""select path_key, votes, l1, l2, l3 from (select *, row_number() over (partition by path_key order by votes desc, sig) n from (select {d.path_key('path')} path_key,
  {d.norm('l1')} || '|' || {d.norm('l2')} || '|' || {d.norm('l3')} sig, count(*) votes, min({d.txt('l1')}) l1, min({d.txt('l2')}) l2, min({d.txt('l3')}) l3 from {CTL} where l1 <> '' or l2 <> '' or l3 <> '' group by 1, 2)) where n = 1""")
def _(load):
    return E.majority_vote(load("control").withColumn("path_key", codes.path_key("path")), ["path_key"], _LV)


# Orders vote for the priority of their customer's context.
_BV = "select o_orderkey as row_id, cast(o_custkey % 12 as string) as family, o_orderstatus as discipline, case when o_custkey % 5 = 0 then '' else cast(o_custkey % 7 as string) end as kind, case when o_custkey % 4 = 0 then '' else cast(o_custkey % 9 as string) end as subjects, cast(o_custkey as string) as title, case when o_orderkey % 6 = 0 then '' when o_custkey % 10 < 8 then 'MAIN' else o_orderpriority end as value from {orders}"
_CTX = [("A", ["family", "discipline", "kind", "subjects"], 2, 70), ("B", ["family", "discipline", "kind"], 2, 70), ("C", ["family", "kind", "subjects"], 2, 70), ("D", ["family", "discipline", "title"], 2, 70), ("E", ["family", "discipline"], 3, 82)]
_BVS = _BV.replace("{orders}", "orders")


def _d_ctx(name, parts, minimum, share):
    cond = " and ".join(f"{p} <> ''" for p in parts)
    ks = " || chr(1) || ".join(parts)
    return f"""v{name} as (select k, v, c, tot, sec from (select k, v, c, sum(c) over (partition by k) tot, lead(c) over (partition by k order by c desc, v) sec, row_number() over (partition by k order by c desc, v) n
      from (select {ks} k, min(value) v, count(*) c from src where value <> '' and {cond} group by 1, {d.norm('value')})) where n = 1 and c >= {minimum} and c * 100 >= tot * {share} and not (sec is not null and c - sec < 2 and c * 100 < tot * 86))"""


@query("backoff_vote", f"""with src as ({_BVS}), {', '.join(_d_ctx(*c) for c in _CTX)} select row_id, coalesce(va.v, vb.v, vc.v, vd.v, ve.v, '') voted,
  case when va.v is not null then 'A' when vb.v is not null then 'B' when vc.v is not null then 'C' when vd.v is not null then 'D' when ve.v is not null then 'E' else '' end context,
  coalesce(va.c, vb.c, vc.c, vd.c, ve.c, 0) support, cast(coalesce(va.tot, vb.tot, vc.tot, vd.tot, ve.tot, 0) as bigint) total from src
  """ + " ".join(f"left join v{n} on v{n}.k = case when {' and '.join(p + chr(60) + chr(62) + chr(39) * 2 for p in ps)} then {' || chr(1) || '.join(ps)} end" for n, ps, _, _ in _CTX))
def _(load):
    orders = load("orders")
    rows = orders.sparkSession.sql(_BV, orders=orders)
    return E.backoff_vote(rows, "row_id", [(n, [F.col(p) for p in ps], m, s) for n, ps, m, s in _CTX], "value")


@query("profile_evidence_vote", f"""with p as (select workflow, {d.path_key('path')} pk, min({d.txt('path')}) p, count(distinct document) n from {CTL} where {d.path_key('path')} <> '' group by 1, 2),
  t as (select *, sum(n) over (partition by workflow) total, count(*) over (partition by workflow) paths, row_number() over (partition by workflow order by n desc, p) i from p)
  select workflow, case when n >= 3 and n * 100 >= total * 80 then 'accepted' when paths > 1 then 'conflict' else 'none' end verdict, case when n >= 3 and n * 100 >= total * 80 then p else '' end path, n support, cast(total as bigint) total from t where i = 1""")
def _(load):
    return E.profile_evidence_vote(load("control"), ["workflow"], "document", "path")


@query("evidence_chain", f"""with b as (select distinct document from {REG}), a as (select document, max(path) path, false conflict from {REG} where {d.path_complete('path')} and row_no % 4 = 0 group by 1),
  h as (select document, min(path) path, row_no % 5 = 0 conflict from {CTL} where path <> '' group by document, row_no), w as (select document, 'UNIT-D|GENERAL|' || min(discipline) path, false conflict from {REG} where discipline <> '' group by 1)
  select b.document, case when a.path is not null then a.path when h.path is not null and not h.conflict then h.path when w.path is not null then w.path else '' end path,
  case when a.path is not null then 'register' when h.path is not null and not h.conflict then 'history' when w.path is not null then 'general' else 'none' end evidence_source,
  case when a.path is null and h.conflict then 'history' else '' end prior_conflict from b left join a on a.document = b.document left join h on h.document = b.document left join w on w.document = b.document""")
def _(load):
    reg, ctl = load("register"), load("control")
    no = F.lit(False).alias("conflict")
    own = reg.filter(codes.path_complete("path") & (F.col("row_no") % 4 == 0)).groupBy("document").agg(F.max("path").alias("path")).select("document", "path", no)
    hist = ctl.filter("path <> ''").groupBy("document", "row_no").agg(F.min("path").alias("path")).select("document", "path", (F.col("row_no") % 5 == 0).alias("conflict"))
    general = reg.filter("discipline <> ''").groupBy("document").agg(F.concat(F.lit("UNIT-D|GENERAL|"), F.min("discipline")).alias("path")).select("document", "path", no)
    return E.evidence_chain(reg.select("document").distinct(), "document", [("register", own), ("history", hist), ("general", general)], "path")


_AGREE = lambda f: f"case when count(distinct {d.norm(f)}) filter (where {d.norm(f)} <> '') = 1 then min({d.txt(f)}) filter (where {d.norm(f)} <> '') else '' end {f}"


@query("consensus_value", f"select document, {_AGREE('title')}, {_AGREE('comment')}, {_AGREE('sheet')} from {REG} group by 1")
def _(load):
    return E.consensus_value(load("register"), ["document"], ["title", "comment", "sheet"]).na.fill("")


_MD = "select row_no % 4000 as k, title, discipline, case when row_no % 3 = 0 then 'high' when row_no % 7 = 0 then 'low' else 'medium' end as confidence, source from "


@query("merge_duplicates_flag_ambiguity", f"""select cast(k as varchar) k, {_AGREE('title')}, {_AGREE('discipline')}, count(distinct {d.norm('title')}) filter (where {d.norm('title')} <> '') > 1 title_ambiguous,
  count(distinct {d.norm('discipline')}) filter (where {d.norm('discipline')} <> '') > 1 discipline_ambiguous, array_to_string(list_sort(list(distinct source)), ' · ') sources, count(*) merged_rows,
  case when count(*) filter (where confidence = 'low') > 0 then 'low' when count(*) filter (where confidence = 'medium') > 0 then 'medium' else 'high' end confidence,
  count(distinct {d.norm('title')}) filter (where {d.norm('title')} <> '') > 1 or count(distinct {d.norm('discipline')}) filter (where {d.norm('discipline')} <> '') > 1 manual_review from ({_MD} {REG}) group by k""")
def _(load):
    rows = load("register").selectExpr("cast(row_no % 4000 as string) as k", "title", "discipline", "case when row_no % 3 = 0 then 'high' when row_no % 7 = 0 then 'low' else 'medium' end as confidence", "source")
    out = E.merge_duplicates(rows, "k", ["title", "discipline"], "confidence", "source")
    return out.na.fill("", ["title", "discipline"])


@query("grouped_reference", f"""select k, discipline, case when count(distinct n) = 1 then min(de) else '' end reference_description, count(distinct n) descriptions from (select {d.ctag('tag')} k, discipline,
  case when size_no > 20 then {d.norm('description')} end n, case when size_no > 20 then {d.txt('description')} end de from {d.v('tag_list')}) group by 1, 2""")
def _(load):
    return E.grouped_reference(load("tag_list").withColumn("k", text.canonical_tag("tag")), ["k", "discipline"], "description", F.col("size_no") > 20)


@query("description_preference", f"""select k, score, description from (select *, row_number() over (partition by k order by score desc, length(description) desc, description, entry_id) n from (
  select {d.ctag('tag')} k, description, entry_id, cast(length(description) + case when contains(description, 'ring') then 200 else 0 end - case when cancelled = 1 then 150 else 0 end as bigint) score from {d.v('tag_list')})) where n = 1""")
def _(load):
    score = F.length("description") + F.when(F.contains("description", F.lit("ring")), 200).otherwise(0) - F.when(F.col("cancelled") == 1, 150).otherwise(0)
    return E.description_preference(load("tag_list").withColumn("k", text.canonical_tag("tag")), ["k"], score, "description", "entry_id")


@query("distinct_ordered_concat", f"""select document, string_agg(v, ' · ' order by pos desc, v desc) joined, first(v order by pos desc, v desc) first_value, cast(count(*) as integer) distinct_values from (
  select document, {d.norm('comment')} n, max((row_no, source_ts, {d.txt('comment')}))[3] v, max((row_no, source_ts)) pos from {REG} where {d.norm('comment')} <> '' group by 1, 2) group by 1""")
def _(load):
    return R.distinct_ordered_concat(load("register"), "document", "comment", [F.col("row_no"), F.col("source_ts")])


_SAME = ", ".join(f"case when count(distinct {d.norm(c)}) = 1 and min({d.norm(c)}) <> '' then min({c}) else '' end {c}" for c in _LV)


@query("common_levels", f"select allocation, {_SAME} from {CTL} group by 1")
def _(load):
    return H.consensus_levels(load("control"), ["allocation"], _LV)


_PP = "select row_no, source_ts, document, document_type, discipline, case when title = '' then '' else split_part(title, ' ', 1) || case when row_no % 3 = 0 then ' X' else '' end end as prefix from "
_G = ["document", "document_type, discipline", "document_type"]


def _best(i, keys):
    ks = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    on = " and ".join(f"c.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    return f"""b{i} as (select r.row_no, r.source_ts, c.prefix p, c.n - (c.prefix = r.prefix)::int n, row_number() over (partition by r.row_no, r.source_ts order by c.n - (c.prefix = r.prefix)::int desc, length(c.prefix) desc, c.prefix desc) k
      from src r join (select {keys}, prefix, count(*) n from src where prefix <> '' group by {keys}, prefix) c on {on} where c.n - (c.prefix = r.prefix)::int > 0)"""


@query("prefix_pattern_support", f"""with src as ({_PP} {REG}), {', '.join(_best(i, g) for i, g in enumerate(_G))} select s.row_no, s.source_ts, coalesce(b0.p, b1.p, b2.p, '') pattern, cast(coalesce(b0.n, b1.n, b2.n, 0) as bigint) support from src s
  """ + " ".join(f"left join b{i} on b{i}.row_no = s.row_no and b{i}.source_ts = s.source_ts and b{i}.k = 1" for i in range(3)))
def _(load):
    word = F.get(F.split("title", " "), F.lit(0))
    prefix = F.when(F.col("title") == "", "").otherwise(F.concat(word, F.when(F.col("row_no") % 3 == 0, " X").otherwise("")))
    rows = load("register").select("row_no", "source_ts", "document", "document_type", "discipline", prefix.alias("prefix"))
    out = T.prefix_pattern_support(rows, "row_no", [["document"], ["document_type", "discipline"], ["document_type"]], "prefix")
    return out.select("row_no", "source_ts", "pattern", "support")


_VAR = {"RL": ["Relatório de inspeção", "Relatório de vistoria"], "PR": ["Procedimento de motores", "Procedimento de execução", "Plano"], "XX": ["Outro"]}


@query("variant_choose_by_history", "with v as (select * from (values " + ", ".join(f"('{c}', '{t}', {i})" for c, ts in _VAR.items() for i, t in enumerate(ts)) + f""") x(code, wording, ord)),
  s as (select distinct document_type code, title from {REG} where title <> ''), c as (select v.code, wording, ord, coalesce(max(len(list_filter({d.toks('wording', 2, ['DE', 'DA', 'DO', 'E'])}, lambda t: list_contains({d.toks('title', 2, ['DE', 'DA', 'DO', 'E'])}, t)))
  / len({d.toks('wording', 2, ['DE', 'DA', 'DO', 'E'])})), 0.0) score from v left join s on s.code = v.code group by 1, 2, 3),
  r as (select *, row_number() over (partition by code order by score desc, ord) n, lead(score) over (partition by code order by score desc, ord) nxt, count(*) over (partition by code) variants from c)
  select code, wording, cast(score as double) score, variants, variants > 1 and score = nxt ambiguous from r where n = 1""")
def _(load):
    spark = load("register").sparkSession
    rows = [(c, t, i) for c, ts in _VAR.items() for i, t in enumerate(ts)]
    standard = spark.createDataFrame(rows, "code string, wording string, ord int")
    history = load("register").select(F.col("document_type").alias("code"), "title")
    from docweave.operators.similarity import variant_choose_by_history

    return variant_choose_by_history(standard, history, stop=["DE", "DA", "DO", "E"])


@query("status_distribution", f"select {d.norm('posting_status')} status_key, min(posting_status) label, count(*) row_count from {REG} group by 1")
def _(load):
    return E.status_distribution(load("register"), "posting_status")


@query("decision_counts", "select count(*) total, count(*) filter (where o_orderstatus = 'F') ready, count(*) filter (where o_orderpriority = '1-URGENT') urgent, count(*) filter (where o_totalprice > 200000) large from orders")
def _(load):
    return E.decision_counts(load("orders"), {"ready": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT", "large": F.col("o_totalprice") > 200000})


@query("evidence_signature_group", f"""select sha256({d.norm('title')} || chr(1) || {d.norm('path')} || chr(1) || {d.norm('comment')}) signature, count(*) items, min(title) title, min(path) path, min(comment) as comment, count(*) > 1 group_approvable
  from {REG} where title <> '' group by 1""")
def _(load):
    rows = load("register").withColumn("can", F.col("title") != "")
    return E.signature_groups(rows, ["title", "path", "comment"], "can")


@query("duplicate_targets", "select upper(name) target_key, count(*) uses, min(name) target from (select concat('Doc_', o_custkey % 5000, '_', o_orderkey % 3, '.pdf') as name from orders) group by 1 having count(*) > 1")
def _(load):
    name = F.expr("concat('Doc_', cast(o_custkey % 5000 as string), '_', cast(o_orderkey % 3 as string), '.pdf')")
    return E.duplicate_targets(load("orders").select(name.alias("name")), "name")


_AF = "select o_custkey % 40 as g, case when o_custkey % 40 < 20 then concat('Cert_', cast(o_custkey % 40 as string), '00', cast(o_orderkey as string), '_final.pdf') else concat('A', o_orderpriority, cast(o_orderkey as string), o_orderstatus, '.pdf') end as name from {orders}"


@query("common_affix_pattern", f"""with s as (select g, regexp_replace(name, '\\.[^.]+$', '') s from ({_AF.replace('{orders}', 'orders')})), b as (select g, min(s) a, max(s) b, min(reverse(s)) ra, max(reverse(s)) rb, min(length(s)) sh, count(distinct s) names from s group by 1),
  l as (select *, coalesce(list_max(list_filter(generate_series(0, least(length(a), length(b))), lambda i: a[1:i] = b[1:i])), 0) p, coalesce(list_max(list_filter(generate_series(0, least(length(ra), length(rb))), lambda i: ra[1:i] = rb[1:i])), 0) q from b),
  m as (select *, least(q, sh - p) q2 from l), n as (select s.g, min(regexp_full_match(regexp_extract(a[1:p], '\\d*$') || substr(s, p + 1, length(s) - p - q2), '\\d+')) num from s join m on m.g = s.g group by 1)
  select m.g, names, a[1:p] prefix, reverse(ra[1:q2]) suffix, case when names = 1 then '{{original}}' when num then regexp_replace(a[1:p], '\\d+$', '') || '{{sequence}}' || reverse(ra[1:q2]) else a[1:p] || '{{certificate}}' || reverse(ra[1:q2]) end as template from m join n on n.g = m.g""")
def _(load):
    orders = load("orders")
    return E.affix_template(orders.sparkSession.sql(_AF, orders=orders), ["g"], "name").select("g", "names", "prefix", "suffix", "template")


@query("catalog_stats", f"""select discipline, count(*) row_count, count(distinct {d.norm('tag')}) tags, count(distinct size_no) work_codes, count(*) filter (where cancelled = 0) active, count(*) filter (where cancelled = 1) cancelled from {d.v('tag_list')} group by 1""")
def _(load):
    return E.catalog_stats(load("tag_list"), ["discipline"], "tag", "size_no", F.col("cancelled") == 1)


_COMP = f"""select row_no, source_ts, case row_no % 3 when 0 then 'Relatório de inspeção' when 1 then 'Relatório de montagem' else '' end as kind, concat(case row_no % 4 when 0 then 'M-01 - ' else '' end, title,
  case row_no % 5 when 0 then ' (provisório)' when 1 then ' M 01' else '' end, case row_no % 7 when 0 then ' montagem de bomba' else '' end) as description, case when row_no % 2 = 0 then 'M-01' else '' end as tag from """


_LIST = lambda x: f"list_filter(regexp_split_to_array({x}, '[^A-Z0-9]+'), lambda w: w <> '')"


def _even(v):
    """Text without its quotes where one of them is left open."""
    return f"case when (length({v}) - length(replace({v}, chr(34), ''))) % 2 = 1 then replace({v}, chr(34), '') else {v} end"


_PART = lambda x: f"case when {_d_missing(x)} then '' else {_d_title_part(x)} end"


def composed(source: str, keep: str) -> str:
    """SELECT of ``keep`` and ``composed`` for ``source`` with kind, description and tag."""
    gap = T.GAP.replace("'", "''")
    return f"""(select {keep}, array_to_string(list_filter([case when kept = '' or contains(k, kept) then k when k = '' then kept else k || ' - ' || kept end, t], lambda x: x <> ''), ' - ') composed from (
  select *, case when k = '' or len(dw) = 0 then d when nothing_new or cut >= len(dw) then '' when cut > 0 then regexp_replace(regexp_replace(d, '^(?:[^A-Z0-9]*[A-Z0-9]+){{' || cut || '}}[^A-Z0-9]*', ''), '^(?:DE|DO|DA|DOS|DAS|PARA|E)\\s+', '') else d end kept from (
  select *, case when overlap >= 2 then overlap when coalesce(kw[len(kw)] = dw[1] and length(kw[len(kw)]) >= 4 and len(dw) >= 2, false) then 1 else 0 end cut from (
  select *, coalesce(list_max(flatten(list_transform(range(1, len(kw) + 1), lambda s: list_transform(range(1, least(len(kw) - s + 1, len(dw)) + 1), lambda m: case when kw[s:s + m - 1] = dw[1:m] then m else 0 end)))), 0) overlap,
  len(list_filter(dw, lambda w: w not in ({', '.join(f"'{c}'" for c in T.CONNECTORS)}))) > 0 and len(list_filter(dw, lambda w: w not in ({', '.join(f"'{c}'" for c in T.CONNECTORS)}) and not list_contains(kw, w))) = 0 nothing_new from (
  select *, {_LIST('k')} kw, {_LIST('d')} dw from (
  select *, case when loose <> '' then regexp_replace(regexp_replace(d0, '^' || loose || '\\s*[-:]\\s*', ''), '\\s*[-:]?\\s*\\b' || loose || '\\s*$', '') else d0 end d from (
  select *, {d.norm(_even('kp'))} k, {_even('tp')} t, {d.norm(_even('dp'))} d0, array_to_string({_LIST(d.norm(_even('tp')))}, '{gap}') loose from (
  select *, {_PART('kind')} kp, {_PART('tag')} tp, {_PART('bare')} dp from (select *, {_d_noparen('description')} bare from {source})))))))))"""


@query("title_compose", f"select row_no, source_ts, composed composed_title from {composed(f'({_COMP} {REG})', 'row_no, source_ts')}")
def _(load):
    kind = F.expr("case row_no % 3 when 0 then 'Relatório de inspeção' when 1 then 'Relatório de montagem' else '' end")
    desc = F.expr("concat(case row_no % 4 when 0 then 'M-01 - ' else '' end, title, case row_no % 5 when 0 then ' (provisório)' when 1 then ' M 01' else '' end, case row_no % 7 when 0 then ' montagem de bomba' else '' end)")
    rows = load("register").select("row_no", "source_ts", kind.alias("kind"), desc.alias("description"), F.expr("case when row_no % 2 = 0 then 'M-01' else '' end").alias("tag"))
    return T.title_compose(rows, "kind", "description", "tag").select("row_no", "source_ts", "composed_title")


_WORDS = ["Relatório de inspeção", "Relatório", "Relatório de inspeção mecânica", "Procedimento de motores"]


@query("normative_prefix_strip", f"""with t as (select document, max(title) title from {REG} group by 1), w as (select array_to_string(list_filter(regexp_split_to_array({d.norm('x')}, '[^A-Z0-9]+'), lambda y: y <> ''), ' ') w from (select unnest([{', '.join(f"'{x}'" for x in _WORDS)}]) x)),
  n as (select document, {d.norm('title')} n, array_to_string(list_filter(regexp_split_to_array({d.norm('title')}, '[^A-Z0-9]+'), lambda y: y <> ''), ' ') p from t),
  m as (select document, max(len(string_split(w, ' '))) k from n join w on (p = w or starts_with(p, w || ' ')) and len(string_split(w, ' ')) >= 2 group by 1)
  select n.document, cast(coalesce(k, 0) as integer) prefix_words, case when coalesce(k, 0) = 0 then n when k = 2 then regexp_replace(n, '^(?:[^A-Z0-9]*[A-Z0-9]+){{2}}[^A-Z0-9]*', '') when k = 3 then regexp_replace(n, '^(?:[^A-Z0-9]*[A-Z0-9]+){{3}}[^A-Z0-9]*', '')
  else regexp_replace(n, '^(?:[^A-Z0-9]*[A-Z0-9]+){{4}}[^A-Z0-9]*', '') end stripped_title from n left join m on m.document = n.document""")
def _(load):
    titles = load("register").groupBy("document").agg(F.max("title").alias("title"))
    words = titles.sparkSession.createDataFrame([(w,) for w in _WORDS], "wording string")
    return T.normative_prefix_strip(titles, "document", "title", words, "wording").select("document", "prefix_words", "stripped_title")


_LABEL = r"(?:CERTIFICADO|CERTIFICATE|CERT\.?)"
_RULES = [*T.label_rules(_LABEL, "Etiqueta"), (r"track\((\d+)\)", 110), (r"page=(\d+&ref=\w+)", 100), (r"charset=\"([a-z]+-\d)\"", 92), (r"href=\"/([A-Za-z]*\d[A-Za-z0-9]*)", 88)]
#: Half of the pages have lines of a certificate above their markup.
_LINES = """case page_id % 10 when 0 then concat('Certificado Nº: AB-', page_id, '/1') when 1 then concat('cert. emitido em obra sob NÚMERO 77-', page_id, '.')
  when 2 then concat('x\n Certificado do lote \n\n  X', page_id, '.9 \nfim') when 3 then concat('Lote de certificado final  5', page_id, 'A') when 4 then concat('Etiqueta: T-', page_id, ';') end"""
_CONTENT = f"coalesce({_LINES}, concat(html, url))"


@query("identifier_extract_ranked", f"""with p as (select page_id, {_CONTENT.replace(chr(92) + "n", "' || chr(10) || '")} t from pages), f as (select page_id, t, regexp_replace(t, '[\\s\\x{{a0}}]+', ' ', 'g') o from p),
  l as (select page_id, list_filter(list_transform(regexp_split_to_array(t, '\\n+'), lambda x: trim(regexp_replace(x, '[\\s\\x{{a0}}]+', ' ', 'g'))), lambda x: x <> '') ls from p), n as (select page_id, ls[i] line, ls[i + 1] nxt from (select page_id, ls, unnest(range(1, len(ls) + 1)) i from l)),
  raw as (""" + " union all ".join(f"select page_id, unnest(regexp_extract_all(o, '{rx}', 1)) v, {s} s from f" for rx, s in _RULES) + f"""
  union all select page_id, regexp_extract(line, '(?i){T.NUMBER}?\\s*[:#\\-–]?\\s*({T.SHAPE}{{2,63}})\\s*$', 1), 88 from n where regexp_matches(line, '(?i){_LABEL}')
  union all select page_id, nxt, 82 from n where regexp_matches(line, '(?i){_LABEL}') and regexp_full_match(nxt, '(?i){T.SHAPE}{{1,63}}')),
  c as (select page_id, v, max(s) s from (select page_id, upper(regexp_replace(regexp_replace(regexp_replace(v, '^[#:\\-–—.\\s]+', ''), '[;,.:\\-–—\\s]+$', ''), '(?i)^(?:N[º°O.]?|N[ÚU]MERO)\\s*', '')) v, s from raw)
  where regexp_matches(v, '[0-9]') and length(v) between 2 and 64 and not regexp_full_match(v, '\\d{{1,2}}[/.\\-]\\d{{1,2}}[/.\\-]\\d{{2,4}}') group by 1, 2),
  r as (select *, row_number() over (partition by page_id order by s desc, v) n, lead(s) over (partition by page_id order by s desc, v) s2, count(*) over (partition by page_id) k from c)
  select page_id, v as value, s score, k candidates, coalesce(s2, 0) second_score, case when s >= 100 and (k = 1 or s - coalesce(s2, 0) >= 8) then 'high' when s >= 88 and k = 1 then 'high' else 'review' end confidence from r where n = 1""")
def _(load):
    pages = load("pages").select("page_id", F.lit(1).alias("page"), F.expr(_CONTENT).alias("content"))
    return T.identifier_extract_ranked(pages, ["page_id"], "page", "content", _RULES, _LABEL).drop("page")
