"""Queries over receivings: matching, roll-ups, corrections, analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from goodsledger.functions.similarity import product_similarity
from goodsledger.functions.text import normalize_product_name
from goodsledger.operators import analytics, lifecycle, matching
from goodsledger.plans.registry import Inputs, query
from goodsledger.schemas import RECEIVING_STATUSES

# ---------------------------------------------------------------- shared SQL fragments

def norm_sql(x: str) -> str:
    base = f"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'ё', 'е'), '[^a-zа-я0-9%.,\\-]+', ' ', 'g'))"
    for old, new in (("гр.", "г"), ("гр", "г"), ("килограмм", "кг"), ("литр", "л"), ("штук", "шт")):
        base = f"replace({base}, '{old}', '{new}')"
    return base


def sim_sql(a: str, b: str) -> str:
    """Similarity of two normalized texts."""
    ta, tb = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    return (
        f"case when {a} = '' or {b} = '' then 0.0 when contains({a}, {b}) or contains({b}, {a}) then 1.0 "
        f"else len(list_distinct(list_intersect({ta}, {tb})))::double / "
        f"greatest(len(list_distinct(list_concat({ta}, {tb}))), 1) end"
    )


PROBLEMS = (
    "('missing','extra','quantity_mismatch','price_mismatch','replacement_candidate','crossed_out',"
    "'rejected','manual_review')"
)

# Greedy assignment as a walk over the ranked pairs of every receiving.
MATCH_SQL = f"""
on_ as (select *, {norm_sql('name')} as norm from order_lines),
in_ as (select *, {norm_sql('name')} as norm from invoice_lines),
pairs as (
  select receiving_id as g, op, ip, score,
         row_number() over (partition by receiving_id order by op, score desc, ip) as k
  from (select o.receiving_id, o.item_pos as op, i.item_pos as ip, {sim_sql('o.norm', 'i.norm')} as score
        from on_ o join in_ i on o.receiving_id = i.receiving_id) p
  where score >= 0.25),
walk as (
  select g, k, op, ip, score, true as hit, [op] as uo, [ip] as ui from pairs where k = 1
  union all
  select p.g, p.k, p.op, p.ip, p.score,
         not list_contains(w.uo, p.op) and not list_contains(w.ui, p.ip),
         case when not list_contains(w.uo, p.op) and not list_contains(w.ui, p.ip)
              then list_append(w.uo, p.op) else w.uo end,
         case when not list_contains(w.uo, p.op) and not list_contains(w.ui, p.ip)
              then list_append(w.ui, p.ip) else w.ui end
  from walk w join pairs p on p.g = w.g and p.k = w.k + 1),
links as (select g, op, ip, score from walk where hit),
last_order as (select receiving_id, max(item_pos) as m from order_lines group by receiving_id),
items as (
  select o.receiving_id, o.item_pos, o.item_pos as order_pos, i.item_pos as invoice_pos, l.score,
         o.name as item_name_from_order, i.name as item_name_from_invoice,
         o.quantity as ordered_quantity, coalesce(i.quantity, 0) as received_quantity,
         coalesce(i.unit, o.unit) as unit, o.price as ordered_price, coalesce(i.price, 0) as invoice_price,
         case when i.receiving_id is null then 'missing'
              when i.crossed_out then 'crossed_out'
              when l.score < 0.55 then 'replacement_candidate'
              when abs(o.quantity - i.quantity) > 0.0001 then 'quantity_mismatch'
              when abs(o.price - i.price) > 0.01 then 'price_mismatch'
              else 'matched' end as status,
         case when i.receiving_id is null then 'Товар из заявки не найден в накладной'
              when i.crossed_out then coalesce(i.comment, 'Строка отмечена как зачеркнутая')
              when l.score < 0.55 then coalesce(i.comment, 'Возможная замена товара')
              when abs(o.quantity - i.quantity) > 0.0001 then coalesce(i.comment, 'Количество отличается от заявки')
              when abs(o.price - i.price) > 0.01 then coalesce(i.comment, 'Цена отличается от заявки')
              else i.comment end as comment
  from order_lines o
  left join links l on l.g = o.receiving_id and l.op = o.item_pos
  left join invoice_lines i on i.receiving_id = l.g and i.item_pos = l.ip
  union all
  select i.receiving_id, coalesce(m.m, 0) + i.item_pos, null, i.item_pos, null, null, i.name, 0, i.quantity,
         i.unit, 0, i.price,
         case when i.crossed_out then 'crossed_out' else 'extra' end,
         coalesce(i.comment, 'Позиция есть в накладной, но отсутствует в заявке')
  from invoice_lines i
  left join last_order m on m.receiving_id = i.receiving_id
  left join links l on l.g = i.receiving_id and l.ip = i.item_pos
  where l.g is null)
"""

# Receivings after the comparison: roll-up, then the supplier check.
COMPARED_SQL = MATCH_SQL + f""",
flags as (select receiving_id, bool_or(status = 'extra') as e, bool_or(status = 'missing') as m,
                 bool_and(status = 'matched') as a from items group by receiving_id),
heads as (select r.*, h.supplier_legal_name, {norm_sql('r.supplier')} as want,
                 {norm_sql('h.supplier_legal_name')} as got
          from receivings r join invoice_headers h on h.receiving_id = r.id),
judged as (
  select h.*, coalesce(h.supplier_legal_name, '') <> '' and not contains(h.got, h.want)
         and not contains(h.want, h.got) and {sim_sql('h.want', 'h.got')} < 0.35 as differs,
         case when e then 'has_extra_items' when m then 'matched_partial'
              when coalesce(a, true) then 'matched_full' else 'requires_correction' end as rolled
  from heads h left join flags f on f.receiving_id = h.id),
compared as (
  select id, request_id, order_number, venue, supplier, created_at,
         case when differs then 'requires_correction' else rolled end as status,
         case when differs then 'Поставщик в накладной отличается от поставщика в заявке: ' || supplier_legal_name
              else comment end as comment
  from judged)
"""
MATCH_NEEDS = ("order_lines", "invoice_lines")
COMPARE_NEEDS = (*MATCH_NEEDS, "receivings", "invoice_headers")


def match_sides(t: Inputs):
    """Ordered and invoiced lines; the ordered ones are put together once, for the count, both sides and the exports."""
    return t.keep("order_lines"), t.invoice_lines


def matched_items(t: Inputs):
    return matching.match_lines(*match_sides(t))


def compared(t: Inputs):
    orders, invoices = match_sides(t)
    return lifecycle.compare_invoices(t.keep("receivings"), orders, t.invoice_headers, invoices)


# ---------------------------------------------------------------- scalar functions

@query("normalize_product_name", f"""
with names as (select text as raw from documents union all select html from pages union all
               select name from order_lines)
select raw, {norm_sql('raw')} as normalized from names""", needs=("order_lines",))
def _normalize_product_name(t: Inputs):
    names = (
        t.documents.select(F.col("text").alias("raw"))
        .unionAll(t.pages.select("html"))
        .unionAll(t.order_lines.select("name"))
    )
    return names.select("raw", normalize_product_name("raw").alias("normalized"))


@query("product_similarity", f"""
with x as (select a.receiving_id, a.item_pos, {norm_sql('a.name')} as l, {norm_sql('b.name')} as r
           from order_lines a join invoice_lines b on a.receiving_id = b.receiving_id and a.item_pos = b.item_pos)
select receiving_id, item_pos, round({sim_sql('l', 'r')}, 9) as similarity from x""", needs=MATCH_NEEDS)
def _product_similarity(t: Inputs):
    a, b = t.order_lines.alias("a"), t.invoice_lines.alias("b")
    same = (F.col("a.receiving_id") == F.col("b.receiving_id")) & (F.col("a.item_pos") == F.col("b.item_pos"))
    return a.join(b, same).select(
        "a.receiving_id", "a.item_pos", F.round(product_similarity("a.name", "b.name"), 9).alias("similarity")
    )


# ---------------------------------------------------------------- matching

ITEM_COLUMNS = (
    "receiving_id, item_pos, item_name_from_order, item_name_from_invoice, ordered_quantity, received_quantity, "
    "unit, ordered_price, invoice_price, status, comment"
)


@query("match_lines", f"with {MATCH_SQL} select {ITEM_COLUMNS}, order_pos, invoice_pos, round(score, 9) as score from items",
       needs=MATCH_NEEDS, recursive=True)
def _match_lines(t: Inputs):
    return matched_items(t).withColumn("score", F.round("score", 9))


@query("missing_order_lines", f"with {MATCH_SQL} select {ITEM_COLUMNS} from items where status = 'missing'",
       needs=MATCH_NEEDS, recursive=True)
def _missing(t: Inputs):
    return matching.unmatched_orders(matched_items(t)).select(*ITEM_COLUMNS.replace(" ", "").split(","))


@query("extra_invoice_lines", f"with {MATCH_SQL} select {ITEM_COLUMNS} from items where order_pos is null",
       needs=MATCH_NEEDS, recursive=True)
def _extra(t: Inputs):
    return matching.unmatched_invoices(matched_items(t)).select(*ITEM_COLUMNS.replace(" ", "").split(","))


@query("compare_summary", f"""with {MATCH_SQL}
select receiving_id, count(*) filter (where status = 'matched') as matched,
       count(*) filter (where status = 'missing') as missing, count(*) filter (where status = 'extra') as extra,
       count(*) filter (where status = 'quantity_mismatch') as quantity_mismatch,
       count(*) filter (where status = 'price_mismatch') as price_mismatch,
       count(*) filter (where status in ('manual_review','replacement_candidate','crossed_out')) as manual_review
from items group by receiving_id""", needs=MATCH_NEEDS, recursive=True)
def _compare_summary(t: Inputs):
    return lifecycle.compare_summary(matched_items(t))


@query("compared_receivings", f"with {COMPARED_SQL} select * from compared", needs=COMPARE_NEEDS, recursive=True)
def _compared(t: Inputs):
    return compared(t)[0]


@query("supplier_mismatch", f"""
with x as (select r.id, h.supplier_legal_name, {norm_sql('r.supplier')} as want, {norm_sql('h.supplier_legal_name')} as got
           from receivings r join invoice_headers h on h.receiving_id = r.id)
select id, coalesce(supplier_legal_name, '') <> '' and not contains(got, want) and not contains(want, got)
       and {sim_sql('want', 'got')} < 0.35 as differs from x""", needs=("receivings", "invoice_headers"))
def _supplier_mismatch(t: Inputs):
    heads = t.invoice_headers.withColumnRenamed("receiving_id", "id")
    return t.receivings.join(heads, "id").select(
        "id", lifecycle.supplier_differs("supplier", "supplier_legal_name").alias("differs")
    )


# ---------------------------------------------------------------- analytics

STATS_SQL = COMPARED_SQL + f""",
per_item as (
  select c.supplier, count(*) filter (where i.status in {PROBLEMS}) as problem_items,
         count(*) filter (where i.status = 'missing') as missing, count(*) filter (where i.status = 'extra') as extra,
         count(*) filter (where i.status = 'quantity_mismatch') as quantity_mismatch,
         count(*) filter (where i.status = 'price_mismatch') as price_mismatch
  from compared c join items i on i.receiving_id = c.id group by c.supplier),
per_head as (
  select supplier, count(*) as receivings, count(*) filter (where status = 'control_required') as control_required,
         count(*) filter (where comment like '%Поставщик в накладной отличается%') as supplier_mismatch
  from compared group by supplier),
stats as (
  select h.supplier, receivings, coalesce(problem_items, 0) as problem_items,
         round_even(coalesce(problem_items, 0)::double / receivings, 2) as problem_rate,
         coalesce(missing, 0) as missing, coalesce(extra, 0) as extra,
         coalesce(quantity_mismatch, 0) as quantity_mismatch, coalesce(price_mismatch, 0) as price_mismatch,
         supplier_mismatch, control_required,
         coalesce(problem_items, 0) + 2 * supplier_mismatch + 2 * control_required as risk_score
  from per_head h left join per_item p on p.supplier = h.supplier)
"""


@query("supplier_control", f"""with {STATS_SQL}
select *, case when risk_score >= 5 or supplier_mismatch > 0 then 'control_required'
               when risk_score >= 2 then 'watch' else 'ok' end as control_status
from stats order by risk_score desc, supplier""", needs=COMPARE_NEEDS, recursive=True)
def _supplier_control(t: Inputs):
    receivings, items, _ = compared(t)
    return analytics.supplier_ranking(analytics.supplier_statistics(receivings, items))


@query("discrepancy_totals", f"""with {COMPARED_SQL}, tall as (
select 'receivings' as counter, count(*) as n from compared
union all select 'control_required', count(*) from compared where status = 'control_required'
union all select 'supplier_mismatch', count(*) from compared where comment like '%Поставщик в накладной отличается%'
union all select i.status, count(*) from items i join compared c on c.id = i.receiving_id group by i.status
union all select 'problem_items', count(*) from items i join compared c on c.id = i.receiving_id
          where i.status in {PROBLEMS})
select counter, n from tall where n > 0""", needs=COMPARE_NEEDS, recursive=True)
def _totals(t: Inputs):
    receivings, items, _ = compared(t)
    return analytics.discrepancy_totals(receivings, items)


# Receivings in every status, and items of every status, mostly matched; most suppliers have one receiving.
CLASSED_HEADS = """
select o.o_orderkey as id,
       case when o.o_orderkey % 4 = 0 then 'big ' || cast(o.o_orderkey % 100 as varchar(20))
            else 'small ' || cast(o.o_orderkey as varchar(20)) end as supplier,
       {statuses} as status,
       case when o.o_orderkey % 29 = 0 then 'Поставщик в накладной отличается от поставщика в заявке: X' end as comment
from {{orders}} o
"""
CLASSED_ITEMS = """
select receiving_id, item_pos,
       case (part_key + item_pos) % 23 when 0 then 'missing' when 1 then 'extra' when 2 then 'quantity_mismatch'
            when 3 then 'price_mismatch' when 4 then 'crossed_out' when 5 then 'rejected' when 6 then 'manual_review'
            when 7 then 'replacement_candidate' when 8 then 'accepted' when 9 then 'extra_accepted' else 'matched' end as status
from {order_lines}
"""
_CASES = " ".join(f"when {n} then '{status}'" for n, status in enumerate(RECEIVING_STATUSES))
CLASSED_HEADS = CLASSED_HEADS.format(statuses=f"case o.o_orderkey % {len(RECEIVING_STATUSES)} {_CASES} end")
CLASSED_SQL = f"""
compared as ({CLASSED_HEADS.format(orders='orders')}),
items as ({CLASSED_ITEMS.format(order_lines='order_lines')})
"""


def classed(t: Inputs):
    return t.spark.sql(CLASSED_HEADS, orders=t.orders), t.spark.sql(CLASSED_ITEMS, order_lines=t.order_lines)


@query("supplier_control_classes", f"""with {CLASSED_SQL}{STATS_SQL.removeprefix(COMPARED_SQL)}
select *, case when risk_score >= 5 or supplier_mismatch > 0 then 'control_required'
               when risk_score >= 2 then 'watch' else 'ok' end as control_status
from stats""", needs=("order_lines",))
def _supplier_control_classes(t: Inputs):
    return analytics.supplier_statistics(*classed(t))


@query("discrepancy_totals_classes", f"""with {CLASSED_SQL}, tall as (
select 'receivings' as counter, count(*) as n from compared
union all select 'control_required', count(*) from compared where status = 'control_required'
union all select 'supplier_mismatch', count(*) from compared where comment like '%Поставщик в накладной отличается%'
union all select i.status, count(*) from items i join compared c on c.id = i.receiving_id group by i.status
union all select 'problem_items', count(*) from items i join compared c on c.id = i.receiving_id
          where i.status in {PROBLEMS})
select counter, n from tall where n > 0""", needs=("order_lines",))
def _totals_classes(t: Inputs):
    return analytics.discrepancy_totals(*classed(t))


# ---------------------------------------------------------------- receivings of many lines

def crowded_lines(t: Inputs):
    """All lines put into five receivings; names are two words made of a code, many of them equal."""
    place = (F.col("receiving_id") * 8 + F.col("item_pos")).alias("item_pos")
    code = F.lpad(F.col("part_key").cast("string"), 7, "0")
    kind = (F.col("part_key") * 7 + F.col("item_pos")) % 10
    name = F.when(kind == 3, F.concat(F.lit("p"), code, F.lit(" y"), code)).when(kind == 5, F.concat(F.lit("n"), code))
    group = (F.col("receiving_id") % 5).alias("receiving_id")
    orders = t.order_lines.select(group, place, F.concat(F.lit("p"), code, F.lit(" x"), code).alias("name"), "quantity", "unit", "price")
    invoices = t.invoice_lines.select(
        group, place, F.coalesce(name, F.concat(F.lit("p"), code, F.lit(" x"), code)).alias("name"),
        "quantity", "unit", "price", "crossed_out", "comment",
    )
    return orders, invoices


@query("match_crowded_lines", """
with o as (
  select receiving_id % 5 as g, receiving_id * 8 + item_pos as pos, lpad(cast(part_key as varchar), 7, '0') as code,
         quantity, price from order_lines),
i as (
  select receiving_id % 5 as g, receiving_id * 8 + item_pos as pos, lpad(cast(part_key as varchar), 7, '0') as code,
         (part_key * 7 + item_pos) % 10 as k, quantity, price, crossed_out, comment from invoice_lines),
-- every ordered line of a code has the same options, best and first of them served in turn
oc as (select *, row_number() over (partition by g, code order by pos) as turn from o),
ic as (select *, row_number() over (partition by g, code order by case when k = 3 then 1 else 0 end, pos) as turn from i where k <> 5),
last_order as (select g, max(pos) as m from o group by g),
rows_ as (
  select o.g, o.pos as item_pos, o.pos as order_pos, i.pos as invoice_pos, case when i.k = 3 then 1.0 / 3 when i.k is not null then 1.0 end as score,
         case when i.k is null then 'missing' when i.crossed_out then 'crossed_out' when i.k = 3 then 'replacement_candidate'
              when abs(o.quantity - i.quantity) > 0.0001 then 'quantity_mismatch'
              when abs(o.price - i.price) > 0.01 then 'price_mismatch' else 'matched' end as status
  from oc o left join ic i on i.g = o.g and i.code = o.code and i.turn = o.turn
  union all
  select i.g, coalesce(l.m, 0) + i.pos, null, i.pos, null, case when i.crossed_out then 'crossed_out' else 'extra' end
  from (select g, pos, crossed_out from ic anti join oc using (g, code, turn)
        union all select g, pos, crossed_out from i where k = 5) i left join last_order l using (g))
select g as receiving_id, item_pos, order_pos, invoice_pos, round(score, 9) as score, status from rows_""", needs=MATCH_NEEDS)
def _match_crowded(t: Inputs):
    return matching.match_lines(*crowded_lines(t)).select(
        "receiving_id", "item_pos", "order_pos", "invoice_pos", F.round("score", 9).alias("score"), "status"
    )
