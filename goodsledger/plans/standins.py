"""Procurement tables derived from the driver's star-schema tables.

One SQL text per table serves Spark and the checking engine: table names are placeholders, only
integers and exactly representable doubles are computed.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

ORDER_LINES = """
select l.l_orderkey as receiving_id,
       cast(row_number() over (partition by l.l_orderkey
            order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
                     l.l_discount, l.l_tax, l.l_shipdate) as bigint) as item_pos,
       lower(p.p_name || ' ' || p.p_type) as name,
       l.l_quantity as quantity, 'шт' as unit, l.l_extendedprice as price,
       l.l_partkey as part_key, l.l_suppkey as supp_key
from {lineitem} l join {part} p on l.l_partkey = p.p_partkey
"""

INVOICE_LINES = """
select receiving_id, item_pos,
       case when k = 3 then split_part(name, ' ', 1) || ' other'
            when k = 5 then 'unlisted ' || cast(part_key as varchar(20))
            else name end as name,
       case when k = 1 then quantity + 1 else quantity end as quantity,
       unit,
       case when k = 2 then price + 5 else price end as price,
       k = 4 as crossed_out,
       case when k = 6 then 'проверено' end as comment,
       part_key
from (select *, (part_key * 7 + item_pos) % 10 as k from {order_lines}) x
where k <> 0
"""

RECEIVINGS = """
select o.o_orderkey as id,
       'REQ-' || cast(o.o_orderkey as varchar(20)) as request_id,
       'PO-' || cast(o.o_orderkey as varchar(20)) as order_number,
       c.c_name as venue,
       coalesce(s.s_name, 'Supplier#none') as supplier,
       case o.o_orderstatus when 'F' then 'confirmed_full' when 'P' then 'control_required'
            else 'receiving_started' end as status,
       cast(null as varchar(20)) as comment,
       o.o_orderdate as created_at
from {orders} o
join {customer} c on o.o_custkey = c.c_custkey
left join (select l_orderkey, min(l_suppkey) as supp_key from {lineitem} group by l_orderkey) m
       on m.l_orderkey = o.o_orderkey
left join {supplier} s on s.s_suppkey = m.supp_key
"""

INVOICE_HEADERS = """
select id as receiving_id,
       'INV-' || cast(id as varchar(20)) as invoice_number,
       '2024-0' || cast(1 + id % 9 as varchar(2)) || '-15' as invoice_date,
       case when id % 10 = 0 then 'OOO Vector ' || cast(id % 7 as varchar(2))
            when id % 10 = 1 then cast(null as varchar(20))
            when id % 10 = 2 then ''
            else 'OOO ' || supplier end as supplier_legal_name
from {receivings}
"""

CORRECTIONS = """
select o.o_orderkey as receiving_id,
       cast(e.event_id as bigint) as seq,
       case when e.event_id % 3 = 0 then 1 + e.user_id % 5 end as item_id,
       case when e.event_id % 3 = 1 then p.p_name
            when e.event_id % 3 = 2 then 'hot ' || p.p_type end as item_query,
       case e.event_type when 'click' then 'mark_received' when 'view' then 'set_quantity'
            when 'error' then 'reject' when 'signup' then 'accept_extra' else 'set_price' end as action,
       case when e.event_id % 4 < 2 then cast(e.user_id % 50 as double) end as quantity,
       case when e.event_id % 5 < 3 then cast(e.user_id % 90 as double) end as price,
       case when e.event_id % 6 < 2 then 'исправлено ' || cast(e.event_id as varchar(20))
            when e.event_id % 6 = 2 then '' end as comment
from {events} e
join {orders} o on o.o_orderkey = e.user_id * 3 + e.event_id % 3
join {part} p on p.p_partkey = e.event_id % 500
"""

RECEIVING_DOCUMENTS = """
select cast(id * 2 + n as bigint) as id, id as receiving_id,
       'file_' || cast(id as varchar(20)) || '_' || cast(n as varchar(2)) as file_id,
       'photo' as file_type, 'max' as source,
       case when (id + n) % 3 = 0 then 'https://files.example/' || cast(id as varchar(20)) end as file_url,
       case when (id + n) % 4 <> 0 then 'Накладная ' || cast(id as varchar(20)) end as raw_text,
       case when n = 1 then 'OOO ' || supplier end as supplier_legal_name,
       case when n = 0 then 'D-' || cast(id as varchar(20)) end as invoice_number,
       case when n = 0 then '2024-02-01' end as invoice_date,
       created_at
from {receivings} r cross join (select 0 as n union all select 1 as n) t
where id % 5 > n
"""

_SOURCES = {
    "order_lines": ORDER_LINES,
    "invoice_lines": INVOICE_LINES,
    "receivings": RECEIVINGS,
    "invoice_headers": INVOICE_HEADERS,
    "corrections": CORRECTIONS,
    "receiving_documents": RECEIVING_DOCUMENTS,
}
_NEEDS = {
    "order_lines": ("lineitem", "part"),
    "invoice_lines": ("order_lines",),
    "receivings": ("orders", "customer", "lineitem", "supplier"),
    "invoice_headers": ("receivings",),
    "corrections": ("events", "orders", "part"),
    "receiving_documents": ("receivings",),
}


def table(spark: SparkSession, sf_dir: str, name: str, kept: Mapping[str, DataFrame] = MappingProxyType({})) -> DataFrame:
    """A driver table, or a stand-in derived from the driver tables and from the stand-ins that are ``kept``."""
    if name in kept:
        return kept[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return derived(spark, name, **{need: table(spark, sf_dir, need, kept) for need in _NEEDS[name]})


def derived(spark: SparkSession, name: str, **inputs: DataFrame) -> DataFrame:
    """A stand-in made of the given tables."""
    return spark.sql(_SOURCES[name], **inputs)


@lru_cache(maxsize=None)
def _closure(name: str) -> tuple[str, ...]:
    found: list[str] = []
    for need in _NEEDS.get(name, ()):
        found += [n for n in _closure(need) if n not in found]
    if name in _SOURCES:
        found.append(name)
    return tuple(found)


def ctes(*names: str) -> str:
    """The stand-ins as a comma separated CTE list for the checking engine (without ``with``)."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in _closure(name) if n not in wanted]
    identity = {n: n for n in (*TABLES, *_SOURCES)}
    return ",\n".join(f"{n} as ({_SOURCES[n].format(**identity)})" for n in wanted)
