"""Similarity and scored-choice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text
from docweave.operators import similarity as S

from . import duck as d
from .registry import query

CAT, TIT = d.v("catalog"), d.v("titles")
_SORTED = lambda x: f"list_sort({d.title_toks(x)})"
KINDS = [(rf"\b{k}\b", k) for k in ("LARGE", "SMALL", "PROMO", "ECONOMY", "STANDARD", "MEDIUM")]
NOUNS = [(rf"\b{n}S?\b", n) for n in ("WIDGET", "BOLT", "GEAR", "GIZMO", "RING", "ANVIL")]


@query("token_similarity_join", f"""with a as (select distinct {_SORTED('title')} t from {TIT}), b as (select distinct {_SORTED('description')} t from {CAT}), p as (select a.t x, b.t y, len(list_intersect(a.t, b.t)) k, greatest(len(a.t), len(b.t)) m from a, b)
  select array_to_string(x, '|') left_sig, array_to_string(y, '|') right_sig, cast(k / m as double) similarity, cast(k as integer) shared from p where k * 100 >= m * 50""")
def _(load):
    left = load("titles").select(text.title_tokens("title").alias("t0"))
    right = load("catalog").select(text.title_tokens("description").alias("t0"))
    out = S.token_similarity_join(left, right, "t0", 50)
    pipe = lambda c: F.replace(c, F.lit(S.SIG), F.lit("|"))
    return out.select(pipe("left_sig").alias("left_sig"), pipe("right_sig").alias("right_sig"), "similarity", "shared")


_SUBJ = lambda x: "list_sort(list_filter([" + ", ".join(f"case when regexp_matches(regexp_replace({d.norm(x)}, '[^A-Z0-9]+', ' ', 'g'), '{p}') then '{n}' end" for p, n in NOUNS) + "], lambda z: z is not null))"
_SIM = "len(list_intersect(tok, etok)) / greatest(len(tok), len(etok), 1)"


def _targets(load):
    return load("titles").select("doc_id", "title", F.concat(F.lit("Brand#"), (F.col("doc_id") % 4 + 1).cast("string")).alias("discipline"))


@query("catalog_score_best", f"""with t as (select doc_id, {_SORTED('title')} tok, {d.rules(d.norm('title'), KINDS)} kind, {_SUBJ('title')} subj, upper('Brand#' || (doc_id % 4 + 1)) disc from {TIT}), pr as (select distinct tok, kind, subj, disc from t),
  e as (select min(entry_id) entry_id, path, description, notes, {d.norm("description || ' ' || notes")} search, {_SORTED("description || ' ' || notes")} etok, {d.norm("path || ' ' || description")} names, {_SUBJ("description || ' ' || notes || ' ' || path")} esubj, {d.path_key('path')} pk from {CAT} group by path, description, notes),
  prn as (select row_number() over () pid, * from pr), ek as (select entry_id, k from (select entry_id, search, unnest([{', '.join(f"'{k}'" for k in dict.fromkeys(k for _, k in KINDS))}]) k from e) where contains(search, k)),
  cand as (select pid, entry_id from prn join ek on k = kind union select pid, entry_id from (select pid, unnest(subj) w from prn) a join (select entry_id, unnest(esubj) w from e) b using (w)
  union select pid, entry_id from (select pid, len(tok) n, unnest(tok) w from prn) a join (select entry_id, len(etok) m, unnest(etok) w from e) b using (w) group by pid, entry_id, n, m having count(*) * 100 >= 33 * greatest(n, m)),
  s as (select pr.*, e.entry_id, e.path, e.pk, list_filter(tok, lambda w: contains(search, w)) matched, case when kind <> '' and contains(search, kind) then 65 else 0 end + case when contains(names, disc) then 24 else 0 end + cast(floor({_SIM} * 28 + 0.5) as integer)
  + case when len(list_intersect(subj, esubj)) > 0 then 58 when len(subj) > 0 and len(esubj) > 0 then -32 else 0 end sc from cand join prn pr using (pid) join e using (entry_id)),
  s2 as (select *, sc + least(28, len(matched) * 4) score from s where sc + least(28, len(matched) * 4) >= 62), pp as (select *, row_number() over (partition by tok, kind, subj, disc, pk order by score desc, entry_id) i from s2),
  r as (select *, row_number() over (partition by tok, kind, subj, disc order by score desc, entry_id) n from pp where i = 1),
  b as (select a.*, c.score rs, c.matched rm from r a left join r c on c.n = 2 and c.tok = a.tok and c.kind = a.kind and c.subj = a.subj and c.disc = a.disc where a.n = 1),
  o as (select t.doc_id, b.path, b.score, b.rs, case when b.score is null then 'none' when b.rs is not null and b.score - b.rs < 10 and not (len(list_filter(b.matched, lambda x: not list_contains(b.rm, x))) > 0 and len(list_filter(b.rm, lambda x: not list_contains(b.matched, x))) = 0) then 'conflict' else 'found' end outcome
  from t left join b on b.tok = t.tok and b.kind = t.kind and b.subj = t.subj and b.disc = t.disc)
  select doc_id, outcome, case when outcome = 'found' then path else '' end path, cast(coalesce(score, 0) as bigint) score, cast(coalesce(rs, 0) as bigint) runner_score, case when outcome <> 'found' then 'none' when score >= 76 then 'high' else 'medium' end confidence from o""")
def _(load):
    return S.catalog_score_best(_targets(load), "doc_id", load("catalog"), KINDS, NOUNS)


_Q = f"(select distinct case when doc_id % 2 = 0 then 'AB-BRAND-3' else 'ZZ-9' end code, regexp_extract(title, '^(\\S+ \\S+ \\S+)', 1) title from {TIT})"
_W = lambda x: f"trim({d.rx(d.norm(x), '[^A-Z0-9]+', ' ')})"
_MT = lambda x: f"list_filter(string_split({x}, ' '), lambda w, i: length(w) > 2 and not regexp_full_match(w, '\\d+') and list_position(string_split({x}, ' '), w) = i)"
_HAS = lambda f, w: f"contains(' ' || {f} || ' ', ' ' || {w} || ' ')"


@query("catalog_rank_topk", f"""with q as (select code, title, {_W('title')} t, {_MT(_W('title'))} tok, {_MT(_W('code'))} dir, case when code like '%BRAND%' then ['PROMO', 'SMALL ANVIL'] else [] end ex from {_Q}),
  e as (select min(entry_id) entry_id, {_W('description')} de, {_W('notes')} n, {_W('path')} p from {CAT} group by description, notes, path),
  x as (select *, list_transform(tok, lambda w: case when {_HAS('de', 'w')} then 9 when {_HAS('n', 'w')} then 7 when {_HAS('p', 'w')} then 4 else 0 end) tp, list_transform(ex, lambda w: case when {_HAS('p', 'w')} then 16 when {_HAS('de', 'w')} or {_HAS('n', 'w')} then 11 else 0 end) ep,
  list_transform(dir, lambda w: case when {_HAS('de', 'w')} or {_HAS('n', 'w')} then 4 when {_HAS('p', 'w')} then 2 else 0 end) dp, list_transform(generate_series(1, len(tok) - 1), lambda i: tok[i] || ' ' || tok[i + 1]) ph from q, e),
  y as (select *, len(list_filter(tp, lambda v: v > 0)) th, len(list_filter(ep, lambda v: v > 0)) + len(list_filter(dp, lambda v: v > 0)) ch from x where list_sum(tp) > 0),
  z as (select *, th / len(tok) cov, coalesce(list_sum(tp), 0) + coalesce(list_sum(ep), 0) + coalesce(list_sum(dp), 0) + coalesce(list_sum(list_transform(ph, lambda w: case when contains(de, w) then 15 when contains(n, w) then 10 else 0 end)), 0)
  + case when length(t) > 8 and (contains(de, t) or contains(n, t)) then 80 else 0 end - case when len(ex) > 0 and ch = 0 then 8 else 0 end + case when th / len(tok) >= 0.65 then 18 when th / len(tok) >= 0.4 then 8 else 0 end sc from y),
  r as (select *, row_number() over (partition by code, title order by sc desc, cov desc, entry_id) place from z where sc >= 12)
  select code, title, cast(place as integer) place, entry_id, cast(sc as integer) score, cast(th as integer) title_hits, cast(ch as integer) code_hits, case when sc >= 78 and cov >= 0.55 then 'strong' when sc >= 42 and (th >= 2 or ch >= 1) then 'possible' else 'low' end confidence from r where place <= 3""")
def _(load):
    q = load("titles").select(F.when(F.col("doc_id") % 2 == 0, "AB-BRAND-3").otherwise("ZZ-9").alias("code"), F.regexp_extract("title", r"^(\S+ \S+ \S+)", 1).alias("title"))
    return S.catalog_rank_topk(q, load("catalog"), {"BRAND": ["PROMO", "SMALL ANVIL"]}, 3)


@query("discipline_folder_fallback", f"""with e as (select min(entry_id) entry_id, path, description, string_split(path, '|') lv, {d.path_key('path')} pk from {CAT} group by path, description), f as (select *, {d.norm('lv[3]')} folder, {d.norm('lv[4]')} leaf, {_SORTED("description || ' ' || lv[4]")} etok from e),
  fam as (select folder, pk, path, entry_id, 10 + case when contains(leaf, folder) then 8 else 0 end sc from f where regexp_matches(leaf, '^RED\\b')), fr as (select *, row_number() over (partition by folder order by sc desc, length(path), entry_id) i from (select folder, pk, max(sc) sc, arg_min(path, entry_id) path, min(entry_id) entry_id from fam group by 1, 2)),
  fb as (select a.folder, case when b.folder is null or a.sc - b.sc >= 4 then a.path else '' end fp from fr a left join fr b on b.folder = a.folder and b.i = 2 where a.i = 1),
  dd as (select doc_id, upper(split_part(title, ' ', 1)) folder, case when contains(title, ' red ') then 'RIR' else 'CM' end family, {_SORTED('title')} tok from {TIT}), dj as (select dd.*, fb.fp from dd left join fb on fb.folder = dd.folder and dd.family = 'RIR'),
  op as (select distinct folder, tok from dj where fp is null), pr as (select op.*, f.entry_id, f.path, f.pk, cast(floor({_SIM} * 30 + 0.5) as integer) s, list_sort(list_intersect(tok, etok)) matched from op join f on f.folder = op.folder),
  pp as (select *, row_number() over (partition by folder, tok, pk order by s desc, length(path), entry_id) j from pr where s > 0), rr as (select *, row_number() over (partition by folder, tok order by s desc, length(path), entry_id) i from pp where j = 1),
  lk as (select a.folder, a.tok, case when b.folder is null or a.s - b.s >= 6 or (len(list_filter(a.matched, lambda x: not list_contains(b.matched, x))) > 0 and len(list_filter(b.matched, lambda x: not list_contains(a.matched, x))) = 0) then a.path else '' end lp from rr a left join rr b on b.folder = a.folder and b.tok = a.tok and b.i = 2 where a.i = 1)
  select doc_id, coalesce(fp, lp, '') path, case when coalesce(fp, lp, '') = '' then 'none' when fp is not null then 'family' else 'title' end rule from dj left join lk on lk.folder = dj.folder and lk.tok = dj.tok""")
def _(load):
    docs = load("titles").select("doc_id", F.upper(F.get(F.split("title", " "), F.lit(0))).alias("folder"), F.when(F.contains("title", F.lit(" red ")), "RIR").otherwise("CM").alias("family"), "title")
    cat = load("catalog").select("entry_id", "path", "description")
    return S.discipline_folder_fallback(docs, "doc_id", cat, {"RIR": r"^RED\b"})


_SREQ = "select o_orderkey, concat(case o_custkey % 5 when 0 then 'BOMBAS' when 1 then 'COMPRESSAO' when 2 then 'VALVU' when 3 then 'TK' else 'TRANSFER' end, '-', cast(o_custkey % 3 as string)) as tag, concat(cast(o_custkey % 4 + 1 as string), '.2.', cast(o_custkey % 6 as string), case when o_orderkey % 2 = 0 then '.1' else '' end) as wbs, o_orderstatus as discipline, case when o_custkey % 2 = 0 then 'Relatório montagem estrutura' else 'pintura final' end as title from {orders}"
_SCAT = "select p_partkey as entry_id, concat(case p_partkey % 6 when 0 then 'BOMBA' when 1 then 'COMPRESSOR' when 2 then 'VALVULAS' when 3 then 'TRANSFORMADOR' when 4 then 'BOMBASTICA' else 'TK' end, '-', cast(p_size as string)) as tag, concat(cast(p_size % 4 + 1 as string), '.2.', cast(p_partkey % 6 as string)) as wbs, case p_size % 3 when 0 then 'F' when 1 then 'O' else 'P' end as discipline, case p_partkey % 3 when 0 then 'montagem de estrutura' when 1 then 'pintura' else 'teste' end as subject from {part}"
_STM = lambda x: f"list_distinct(regexp_extract_all({d.norm(x)}, '[A-Z]{{5,}}'))"
_AW = lambda x: f"list_filter({d.toks(x)}, lambda t: t not in ('RELATORIO', 'DE', 'DA', 'DO', 'PARA', 'DISCIPLINA', 'AREA', 'UNIDADE'))"


@query("stem_context_match", f"""with q as (select *, case when wbs like '%.%.%.%' then regexp_replace(wbs, '\\.\\d+$', '') else wbs end wp, {_STM('tag')} st, {_AW('title')} aw from (select distinct tag, wbs, discipline, title from ({_SREQ.replace('{orders}', 'orders')}))),
  c as (select *, {_STM('tag')} cs, {_AW('subject')} sw from ({_SCAT.replace('{part}', 'part')})), j as (select q.tag, q.wbs, q.discipline, q.title, st, aw, c.entry_id, cs, sw, {d.norm('c.subject')} subj from q join c on c.discipline = q.discipline and (c.wbs = q.wbs or c.wbs = q.wp)),
  s as (select *, list_max(flatten(list_transform(st, lambda a: list_transform(cs, lambda b: coalesce(list_max(list_filter(generate_series(5, least(length(a), length(b))), lambda i: a[1:i] = b[1:i])), 0))))) sc, list_intersect(aw, sw) w from j),
  b as (select tag, wbs, discipline, title, 'stem' rule, sc + 20 score, count(*) n, min(entry_id) e from (select *, max(sc) over (partition by tag, wbs, discipline, title) mx from s where sc >= 5) where sc = mx group by 1, 2, 3, 4, 6),
  ac as (select s.tag, s.wbs, s.discipline, s.title, entry_id, subj, list_sum(list_transform(w, lambda x: case when length(x) >= 6 then 12 else 7 end)) sc from s left join b on b.tag = s.tag and b.wbs = s.wbs and b.discipline = s.discipline and b.title = s.title where b.tag is null and len(w) > 0 and list_max(list_transform(w, lambda x: length(x))) >= 5),
  a2 as (select tag, wbs, discipline, title, 'activity' rule, sc score, count(*) n, min(entry_id) e from (select *, max(sc) over (partition by tag, wbs, discipline, title) mx from ac) where sc = mx group by 1, 2, 3, 4, 6 having count(distinct subj) = 1)
  select o.o_orderkey, coalesce(f.rule, 'none') rule, cast(coalesce(f.score, 0) as bigint) score, coalesce(f.n, 0) entries, coalesce(f.e, -1) first_entry from ({_SREQ.replace('{orders}', 'orders')}) o left join (select * from b union all select * from a2) f on f.tag = o.tag and f.wbs = o.wbs and f.discipline = o.discipline and f.title = o.title""")
def _(load):
    orders, part = load("orders"), load("part")
    return S.stem_context_match(orders.sparkSession.sql(_SREQ, orders=orders), "o_orderkey", part.sparkSession.sql(_SCAT, part=part))


def family_inputs(load):
    """Documents with family, kind, subjects and words, and the paths they were given before."""
    from docweave.functions import codes
    from docweave.operators.keyed import latest_by

    rec = latest_by(load("register"), ["document"], [F.col("row_no"), F.col("source_ts")], ["title", "discipline"])
    records = rec.select(
        "document", F.regexp_extract("document", r"^([A-Z]+-\d+\.\d+\.\d+-[A-Z]+)-", 1).alias("family"), codes.title_kind("title").alias("kind"),
        codes.subjects(F.col("title")).alias("subjects"), text.title_tokens("title").alias("tokens"), "discipline", codes.sequence_tail("document").alias("seq"),
    )
    return records, load("control").select("document", "path")


FAMILY = f"""(with rec as (select * from (select *, row_number() over (partition by document order by row_no desc, source_ts desc) n from {d.v('register')}) where n = 1),
  r as (select document, regexp_extract(document, '^([A-Z]+-\\d+\\.\\d+\\.\\d+-[A-Z]+)-', 1) family, {d.title_kind('title')} kind, case when regexp_matches({d.norm('title')}, '\\bPAINEL\\b') then case when regexp_matches({d.norm('title')}, '\\bMOTORES?\\b') then ['MOTOR', 'PAINEL'] else ['PAINEL'] end
    when regexp_matches({d.norm('title')}, '\\bMOTORES?\\b') then ['MOTOR'] when regexp_matches({d.norm('title')}, '\\bINSTRUMENTACAO\\b') then ['INSTRUMENTO'] else [] end subj, {_SORTED('title')} tok, {d.norm('discipline')} disc, right(document, 12)::bigint seq from rec),
  e as (select document, {d.path_key('path')} pk, min({d.txt('path')}) path from {d.v('control')} where {d.path_complete('path')} group by 1, 2), c as (select r.*, e.pk, e.path from e join r on r.document = e.document),
  p as (select t.document, t.kind, t.subj, c.pk, c.path, c.document cd, t.kind <> '' and t.kind = c.kind km, len(list_intersect(t.subj, c.subj)) > 0 sm, case when len(t.tok) > 0 and len(c.tok) > 0 then len(list_intersect(t.tok, c.tok)) / greatest(len(t.tok), len(c.tok)) else 0 end sim,
    t.disc <> '' and t.disc = c.disc dm, abs(t.seq - c.seq) gap from r t join c on c.family = t.family and c.document <> t.document where not (t.kind <> '' and c.kind <> '' and t.kind <> c.kind)),
  q as (select *, 50 + case when km then 35 else 0 end + case when sm then 38 else 0 end + floor(sim * 30 + 0.5) + case when dm then 10 else 0 end + 18 + greatest(0, 10 - least(10, gap)) score from p where (len(subj) = 0 or sm) and (km or sim >= 0.32)),
  g as (select document, any_value(kind) kind, any_value(subj) subj, pk, min(path) path, count(distinct cd) n, count(*) filter (where km) kn, max(score) mx from q group by document, pk),
  t as (select *, sum(n) over (partition by document) total, count(*) over (partition by document) paths, row_number() over (partition by document order by n desc, kn desc, pk desc) i from g),
  v as (select *, case when len(subj) = 0 and paths > 1 and n * 100 < total * 90 then 'conflict' when (n >= 2 and n * 100 >= total * 60 and (kind = '' or kn >= ceil(n * 60 / 100))) or (n = 1 and paths = 1 and mx >= 118) then 'accepted' when paths > 1 then 'conflict' else 'none' end verdict from t where i = 1)
  select r.document, coalesce(verdict, 'none') verdict, case when verdict = 'accepted' then path else '' end path, coalesce(n, 0) support, cast(coalesce(total, 0) as bigint) total from r left join v on v.document = r.document)"""


@query("family_evidence_vote", f"select document, verdict, case when path <> '' then {d.path_key('path')} else '' end path_key, support, total from {FAMILY}")
def _(load):
    from docweave.functions import codes
    from docweave.operators.evidence import family_evidence_vote

    records, evidence = family_inputs(load)
    out = family_evidence_vote(records, evidence, "document")
    return out.select("document", "verdict", F.when(F.col("path") != "", codes.path_key("path")).otherwise("").alias("path_key"), "support", "total")
