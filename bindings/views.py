"""Inputs of the registered queries: views over the given tables.

Each view is one SELECT in the dialect Spark SQL and DuckDB share, so the query and its oracle read the
same text. ``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


# Tables that grow with the scale; region, nation and supplier stay small.


def code(k: str) -> str:
    """Document code of an integer key: type, work code, class, sequence."""
    cls = f"case {k} % 5 when 0 then 'MEC' when 1 then 'CIV' when 2 then 'ELE' when 3 then 'TUB' else 'INS' end"
    return (
        f"concat('RL-', cast({k} % 7 + 1 as string), '.', cast({k} % 5 + 1 as string), '.', "
        f"cast({k} % 11 + 1 as string), '-', {cls}, '-', lpad(cast({k} as string), 12, '0'))"
    )


def word(k: str) -> str:
    return (
        f"case {k} % 5 when 0 then 'MECÂNICA' when 1 then 'CIVIL' when 2 then 'ELÉTRICA' "
        f"when 3 then 'TUBULAÇÃO' else 'INSTRUMENTAÇÃO' end"
    )


VIEWS: dict[str, str] = {}

# Register rows: one per lineitem; most fields follow the document, some rows disagree.
VIEWS["register"] = f"""
select {code('l_orderkey')} as document,
  case when l_linenumber = 7 and l_quantity > 25 then 'C'
       when l_orderkey % 8 = 0 then '0' when l_orderkey % 8 = 1 then 'A' when l_orderkey % 8 = 2 then 'Rev. B'
       when l_orderkey % 8 = 3 then 'C' when l_orderkey % 8 = 4 then 'A1' when l_orderkey % 8 = 5 then 'I'
       when l_orderkey % 8 = 6 then '' else 'Z' end as revision,
  case when l_orderkey % 2 = 0 then 'Emitido' else 'Em revisão' end as status,
  case l_orderkey % 3 when 0 then '' when 1 then 'Em Análise' else 'Com Comentários' end as posting_status,
  case when l_orderkey % 9 = 0 then ''
       when l_linenumber = 6 and l_discount > 0.05 then 'Relatório – vistoria de campo'
       when l_orderkey % 4 = 1 then concat('Procedimento de motores ', {word('l_orderkey')})
       else concat('Relatório de inspeção  ', {word('l_orderkey')}, ' painel ', cast(l_orderkey % 50 as string)) end as title,
  case when l_orderkey % 4 = 0 then '' else concat('GR-', cast(l_orderkey % 900 as string)) end as dispatch,
  case when l_orderkey % 10 = 0 then ''
       when l_linenumber >= 6 then cast(cast(l_shipdate as date) as string)
       else concat(lpad(cast(l_orderkey % 28 + 1 as string), 2, '0'), '/01/2024') end as effective_date,
  concat('A', cast(l_orderkey % 5 as string)) as format,
  case when l_orderkey % 13 = 0 then '' else {word('l_orderkey')} end as discipline,
  case l_orderkey % 6 when 0 then 'RL' when 1 then 'XX' else 'PR' end as document_type,
  case l_orderkey % 3 when 0 then 'Para Construção' when 1 then 'Conforme Construído' else 'Outro' end as purpose,
  case l_orderkey % 6 when 0 then '' when 1 then 'UNIT-D|BOOK'
       when 2 then concat('UNIT-D | Book C&M|', {word('l_orderkey')}, '|Inspeção')
       else concat('UNIT-D|BOOK C&M|', {word('l_orderkey')}, '|', case when l_orderkey % 4 = 1 then 'Procedimento' else 'Inspeção' end) end as path,
  case l_orderkey % 5 when 0 then '' when 1 then 'ok' when 2 then 'Corrigir título'
       when 3 then 'Favor verificar' else concat('Nota ', cast(l_suppkey % 3 as string)) end as comment,
  case l_orderkey % 7 when 0 then 'NÃO ALOCADO' when 1 then '' when 2 then 'Não Alocado' else 'ALOCADO' end as allocation_status,
  case when l_orderkey % 5 = 0 then '' else concat('AL-', lpad(cast(l_orderkey % 40 + 1 as string), 4, '0'), '-',
       cast(2022 + l_orderkey % 3 as string)) end as allocation,
  case l_orderkey % 3 when 0 then 'Etapa 1' else '' end as allocation_stage,
  concat('P', cast(l_orderkey % 30 as string)) as deadline,
  '' as modified,
  cast(cast(l_shipdate as date) as string) as included,
  case when l_linenumber = 7 and l_discount > 0.08 then 'CV' else 'ET' end as sheet,
  l_orderkey * 10 + l_linenumber as row_no,
  concat('book_', cast(l_orderkey % 4 as string)) as source,
  cast(round(l_extendedprice * 100) as bigint) as source_ts,
  case l_orderkey % 4 when 0 then 'A' when 1 then 'B2' when 2 then '12' else '' end as version
from {{lineitem}}
"""

# Posting history: two events per document for a part of the documents.
VIEWS["history"] = f"""
select {code('(event_id - event_id % 2)')} as document,
  case when user_id % 6 < 3 then (case (event_id - event_id % 2) % 8 when 0 then '0' when 2 then 'B' when 4 then 'A1' else 'A' end)
       when user_id % 6 = 3 then 'B' when user_id % 6 = 4 then 'C' else '' end as revision,
  case event_type when 'view' then 'Em Análise' when 'click' then 'Com Comentários' when 'purchase' then 'Sem Comentários'
       when 'signup' then 'Para Compra' else '' end as status,
  '' as posting_status,
  cast(cast(ts as date) as string) as modified,
  cast(cast(ts as date) as string) as included,
  'HIST' as sheet, event_id as row_no, concat('hist_', cast(user_id % 3 as string)) as source,
  cast(round(value * 100) as bigint) as source_ts
from {{events}}
"""

# Requests: codes typed in seven ways, with repeats and unknown ones.
VIEWS["requests"] = f"""
select o_orderkey as request_id,
  case o_orderkey % 8
    when 0 then concat('ZZ-', cast(o_orderkey as string))
    when 1 then {code('o_orderkey')}
    when 2 then concat(' ', lower({code('o_orderkey')}), '.pdf')
    when 3 then replace({code('o_orderkey')}, '-', '')
    when 4 then concat('Copia ', {code('o_orderkey')}, ' rev A')
    when 5 then concat({code('o_orderkey')}, ' e ', {code('(o_orderkey + 1)')})
    when 6 then concat('x', replace({code('o_orderkey')}, '.', ''), 'y')
    else {code('(o_orderkey % 100)')} end as raw,
  case when o_orderstatus = 'F' then 'ET' when o_orderstatus = 'P' then 'CV' else '' end as hint
from {{orders}}
"""

# Path catalog over parts.
VIEWS["catalog"] = """
select p_partkey as entry_id, concat(p_type, ' ', p_name) as description,
  concat('UNIT-X|', p_brand, '|', p_type, '|', p_name) as path, cast(p_size as string) as notes
from {part}
"""

# Path catalog of the documents, over parts: two kinds of documents, and entries of no kind.
VIEWS["path_catalog"] = f"""
select p_partkey as entry_id,
  case p_partkey % 3 when 0 then concat('Relatório de inspeção ', {word('p_partkey')}, case when p_size % 10 = 0 then ' painel' else '' end)
    when 1 then concat('Procedimento ', case when p_size % 4 = 0 then 'de motores ' else 'de pintura ' end, {word('p_partkey')}) else concat(p_type, ' ', p_name) end as description,
  concat('UNIT-D|BOOK C&M|', case when p_partkey % 5 = 3 then 'Arquivo' else {word('p_partkey')} end, '|',
    case when p_partkey % 3 = 1 and p_partkey % 5 = 2 then concat('Procedimento ', cast(p_size % 2 as string)) when p_partkey % 3 = 1 then 'Procedimento' else 'Inspeção' end) as path,
  case when p_size % 7 = 0 then '' else p_brand end as notes
from {{part}}
"""

# Texts of the catalog search: short titles written by customers and orders.
VIEWS["titles"] = """
select o_orderkey as doc_id,
  concat(case o_orderkey % 6 when 0 then 'Large' when 1 then 'SMALL' when 2 then 'promo' when 3 then 'Economy'
    when 4 then 'Standard' else 'medium' end, ' ',
    case o_orderkey % 8 when 0 then 'red' when 1 then 'blue' when 2 then 'hot' when 3 then 'cold' when 4 then 'old'
    when 5 then 'new' when 6 then 'large' else 'small' end, ' ',
    case o_custkey % 8 when 0 then 'widget' when 1 then 'bolt' when 2 then 'gear' when 3 then 'gizmo' when 4 then 'ring'
    when 5 then 'anvil' when 6 then 'plate' else 'rod' end,
    case when o_custkey % 3 = 0 then concat(' Brand#', cast(o_custkey % 25 + 1 as string)) else '' end) as title,
  concat('Brand#', cast(o_custkey % 25 + 1 as string)) as family
from {orders}
"""

# Work-code hierarchy: region, nation, customer as dotted codes with level names.
VIEWS["hierarchy"] = """
select code, max(l1) as l1, max(l2) as l2, max(l3) as l3, min(row_no) as row_no from (
select cast(r_regionkey + 1 as string) as code, r_name as l1, '' as l2, '' as l3, cast(r_regionkey as bigint) as row_no from {region}
union all
select concat(cast(n_regionkey + 1 as string), '.', cast(n_nationkey + 1 as string)), r_name, n_name, '',
  cast(100 + n_nationkey as bigint) from {nation} join {region} on n_regionkey = r_regionkey
union all
select concat(cast(n_regionkey + 1 as string), '.', cast(n_nationkey + 1 as string), '.', cast(c_custkey % 20 + 1 as string)),
  r_name, n_name, c_mktsegment, 1000 + c_custkey
  from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
  where c_custkey % 20 < 12) t group by code, case when l3 <> '' then l3 else '' end
"""

# Work codes to place: one per customer, deeper than the hierarchy.
VIEWS["worked"] = """
select c_custkey as doc_id,
  concat(cast(n_regionkey + 1 as string), '.0', cast(n_nationkey + 1 as string), '.', cast(c_custkey % 20 + 1 as string), '.',
    cast(c_custkey % 4 + 1 as string)) as wbs, c_mktsegment as discipline
from {customer} join {nation} on c_nationkey = n_nationkey
"""

# Tag list and tags to look up, with differing punctuation.
VIEWS["tag_list"] = """
select p_partkey as entry_id,
  case p_partkey % 5 when 0 then concat('P-', lpad(cast(p_partkey % 1000 as string), 4, '0'), 'A/B')
    when 1 then concat('TK_', lpad(cast(p_partkey % 700 as string), 4, '0'))
    when 2 then concat('V ', cast(p_partkey as string), '-01') else concat('M-', lpad(cast(p_partkey as string), 6, '0')) end as tag,
  p_name as description, p_type as discipline, p_size as size_no, case when p_size % 7 = 0 then 1 else 0 end as cancelled
from {part}
"""
VIEWS["tag_requests"] = """
select l_orderkey * 10 + l_linenumber as request_id,
  case l_partkey % 6 when 0 then concat('nt-M-', lpad(cast(l_partkey as string), 6, '0'))
    when 1 then concat('M', cast(l_partkey as string)) when 2 then concat('TK-', lpad(cast(l_partkey % 700 as string), 4, '0'))
    when 3 then concat('LINE M-', lpad(cast(l_partkey as string), 6, '0'), ' END') when 4 then concat('P-', lpad(cast(l_partkey % 1000 as string), 4, '0'), 'A')
    else concat('V-', cast(l_partkey as string), '/01') end as tag,
  case l_linenumber % 3 when 0 then 'SMALL' when 1 then 'LARGE' else 'PROMO' end as discipline
from {lineitem}
"""

# Batch evidence: allocation files and confirmations.
VIEWS["confirmations"] = f"""
select {code('(o_orderkey - o_orderkey % 3)')} as document,
  concat('AL-', lpad(cast((o_orderkey - o_orderkey % 3) % 40 + 1 as string), 4, '0'), '-',
    cast(2022 + (o_orderkey - o_orderkey % 3 + case when o_orderkey % 5 = 0 then 1 else 0 end) % 3 as string)) as allocation,
  case o_orderpriority when '1-URGENT' then 'Alocado' when '2-HIGH' then 'Recusado' when '3-MEDIUM' then 'Em análise'
    when '5-LOW' then '' else 'Não alocado' end as status,
  case o_orderkey % 4 when 0 then 'ok' when 1 then 'Favor verificar' when 2 then '' else 'N/A' end as comment,
  case when o_orderkey % 6 = 0 then '' else cast(cast(o_orderdate as date) as string) end as return_date,
  concat('UNIT-D|BOOK C&M|', {word('o_orderkey')}, '|', case when o_orderkey % 9 = 0 then 'Outro' else 'Inspeção' end) as path,
  case when o_orderkey % 2 = 0 then 'confirmation' else 'allocation' end as kind,
  concat('AL-', lpad(cast((o_orderkey - o_orderkey % 3) % 40 + 1 as string), 4, '0'), '-',
    cast(2022 + (o_orderkey - o_orderkey % 3) % 3 as string), '.xlsx') as source,
  cast(round(o_totalprice) as bigint) as source_modified, o_orderkey as source_row
from {{orders}}
"""

# Control rows: earlier allocations with levels.
VIEWS["control"] = f"""
select {code('o_orderkey')} as document,
  concat('AL-', lpad(cast(o_orderkey % 40 + 1 as string), 4, '0'), '-', cast(2021 + o_orderkey % 3 as string)) as allocation,
  case o_orderpriority when '1-URGENT' then 'Alocado' when '2-HIGH' then 'Recusado' when '3-MEDIUM' then 'Pendente' else '' end as status,
  {word('o_orderkey')} as workflow,
  case when o_orderkey % 4 = 0 then '' else concat('UNIT-D|BOOK C&M|', {word('o_orderkey')}, '|', case when o_orderkey % 7 = 0 then 'Outro' else 'Inspeção' end) end as path,
  concat('N', cast(o_orderkey % 3 as string)) as l1, case when o_orderkey % 10 < 7 then 'X' else 'Y' end as l2,
  case when o_orderkey % 11 = 0 then '' else concat('Z', cast(o_orderkey % 5 as string)) end as l3,
  case o_orderkey % 6 when 0 then 'Favor verificar' when 1 then 'ok' else '' end as comment,
  o_orderkey as row_no
from {{orders}} where o_orderkey % 3 <> 0
"""

# Cell grid: one sheet per customer segment and page of 50 rows, two title lines before the header.
VIEWS["grid"] = """
select source, sheet, row_no, cells from (
select concat('book_', c_mktsegment) as source, concat('S', cast(n as string)) as sheet, r as row_no,
  case when r = 1 then array('Lista mestra', '', '', '', '', '')
       when r = 2 then array('', '', '', '', '', '')
       else array('Nº do item', case when n % 6 = 0 then 'Outro' else 'DOCUMENTO' end, case when n % 2 = 0 then 'REVISÃO' else 'Rev.' end,
                  'Título do documento', case when n % 3 = 0 then 'Status SIGEM' else 'STATUS' end, 'ALOCAÇÃO') end as cells
from (select distinct c_mktsegment, cast((c_custkey - c_custkey % 50) / 50 as bigint) as n from {customer}) h,
     (select 1 as r union all select 2 union all select 3) k
union all
select concat('book_', c_mktsegment), concat('S', cast(cast((c_custkey - c_custkey % 50) / 50 as bigint) as string)),
  cast(c_custkey % 50 + 4 as int),
  array(cast(c_custkey as string),
        case when c_custkey % 17 = 0 then '' when c_custkey % 19 = 0 then 'Fim' when c_custkey % 23 = 0 then 'ab-1' else concat('RL-', lpad(cast(c_custkey as string), 9, '0')) end,
        case c_custkey % 3 when 0 then 'A' when 1 then '0' else '' end, concat('Título ', c_name),
        case c_custkey % 4 when 0 then 'Em Análise' when 1 then '=B2' when 2 then '2024-01-05' else '45000' end,
        case c_custkey % 5 when 0 then 'ALOCADO' when 1 then 'Não alocada' when 2 then concat('AL-', lpad(cast(c_custkey % 90 + 1 as string), 4, '0'), '-2024') else '' end)
from {customer}) g
"""

# Text lines of a dump: one per benchmark, document and conversation entry, entity rows among prose.
VIEWS["lines"] = """
select concat('dump_', cast(user_id % 4 as string)) as file, event_id as line_no,
  case when event_id % 41 = 0 then chr(12) when event_type = 'error' then concat('cabecalho ', props)
    else concat(case event_type when 'view' then 'V' when 'click' then 'VG' else 'VB' end, '-', lpad(cast(event_id % 5000 as string), 5, '0'), ' ',
      cast(user_id % 12 + 1 as string), '"', case when event_id % 13 = 0 then ' CANCELADA' else '' end) end as line
from {events}
"""

# Mixed values for cleaning.
VIEWS["mixed"] = """
select l_orderkey * 10 + l_linenumber as row_id,
  case l_partkey % 9 when 0 then '#N/D' when 1 then 'N/A' when 2 then 'A definir' when 3 then '' when 4 then '-' when 5 then concat('Bomba #REF! | ', cast(l_suppkey as string))
    else concat('  Válvula  ', cast(l_suppkey as string)) end as description,
  case l_partkey % 6 when 0 then cast(cast(l_shipdate as date) as string)
    when 1 then concat(cast(day(l_shipdate) as string), '/', cast(month(l_shipdate) as string), '/', cast(year(l_shipdate) % 100 as string))
    when 2 then concat('31/', lpad(cast(month(l_shipdate) as string), 2, '0'), '/', cast(year(l_shipdate) as string))
    when 3 then cast(35000 + l_partkey % 9000 as string) when 4 then 'sem data' else '' end as when_text,
  case l_linenumber when 1 then 'Rev. A' when 2 then 'ZZ' when 3 then 'B12' when 4 then '0' when 5 then 'IO' when 6 then 'revisão Y' else ' AZ ' end as revision
from {lineitem}
"""


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needed = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spark_view(spark, sf_dir, t) for t in needed})


def duck_view(name: str) -> str:
    """The same SELECT with the tables named directly, as a sub-select."""
    sql = VIEWS[name]
    for t in set(re.findall(r"\{(\w+)\}", sql)):
        sql = sql.replace("{" + t + "}", t if t in TABLES else duck_view(t))
    return f"({re.sub(r'\barray\(', 'list_value(', sql).strip()})"
