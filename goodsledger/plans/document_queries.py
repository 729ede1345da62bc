"""Queries over document texts: lines, numbers, dates, headers, item layouts, register files."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goodsledger.functions.dates import find_date, find_date_in_transfer_form, local_time_text, reformat_date
from goodsledger.functions.documents import (
    document_form,
    document_number_candidate,
    is_continuation_text,
    labelled_tax_id,
    plain_tax_id,
)
from goodsledger.functions.numbers import (
    gross_sum,
    infer_vat_percent,
    numbers_in,
    row_figures,
    sheet_int,
    sheet_number,
    tail_numbers,
    vat_display,
    vat_included,
)
from goodsledger.functions.parties import clean_basis, clean_party, normalize_organization
from goodsledger.functions.products import clean_name, is_product_name
from goodsledger.functions.text import blank_to_null, display_value, normalize_catalog_text, squeeze
from goodsledger.functions.units import normalize_unit
from goodsledger.operators import pages as paging
from goodsledger.operators.extract import HEADER_COLUMNS, item_rows, parse_documents, route_useful, spread, with_kind
from goodsledger.operators.extract_items import with_items
from goodsledger.plans.registry import Inputs, query
from goodsledger.sources import registers
from goodsledger.sources.documents import document_lines

# ---------------------------------------------------------------- whole texts of the documents table

_SPACE = r"[\s\p{Z}\x{0085}]"


@query("document_lines", rf"""
with x as (select doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\x0b\f\r\x{{0085}}\x{{2028}}\x{{2029}}]'),
             lambda s: regexp_replace(s, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda s: s <> '') as lines from documents)
select doc_id, unnest(generate_series(1, len(lines)))::int as line_no, unnest(lines) as line from x""")
def _document_lines(t: Inputs):
    return document_lines(t.documents.select("doc_id", "text"))


@query("document_numbers", rf"""
with x as (select doc_id, list_transform(regexp_extract_all(translate(text, 'Xx', '  '),
             '\d{{1,3}}(?:{_SPACE}\d{{3}})+(?:[,.]\d+)?%?|\d+(?:[,.]\d+)?%?'),
             lambda s: try_cast(replace(translate(s, chr(160) || ''' %', ''), ',', '.') as double)) as n from documents),
y as (select doc_id, list_filter(n, lambda v: v is not null) as n from x)
select doc_id, len(n) as n_numbers, list_min(n) as least, list_max(n) as greatest, n[1] as first_number,
       cast(list_sum(list_transform(n, lambda v: cast(floor(v) as decimal(38,0)))) as double) as whole_total,
       cast(list_sum(list_transform(n, lambda v: cast(floor((v - floor(v)) * 10000 + 0.5) as bigint))) as bigint) as fraction_total from y""")
def _document_numbers(t: Inputs):
    """Whole parts and ten-thousandths are summed apart: exact up to 38 digits, as doubles beyond.

    From 2^53 on a double is whole. It is cut at 2^64 and 2^32, so that its digits become a decimal without rounding.
    """
    numbers = t.documents.select("doc_id", numbers_in("text").alias("n"))
    number, half = "decimal(38,0)", float(1 << 32)

    def digits(v: Column) -> Column:
        top = F.floor(v / half / half)
        low = v - top.cast("double") * half * half
        middle = F.floor(low / half)
        parts = ((top, 1 << 64), (middle, 1 << 32), (F.floor(low - middle.cast("double") * half), 1))
        scaled = [part.cast("decimal(19,0)") * F.lit(Decimal(unit)).cast("decimal(20,0)") for part, unit in parts]
        return (scaled[0] + scaled[1] + scaled[2]).cast(number)

    whole = F.transform("n", lambda v: F.when(v < float(1 << 53), F.floor(v).cast(number)).otherwise(digits(v)))
    part = F.transform("n", lambda v: F.when(v < float(1 << 53), F.floor((v - F.floor(v)) * 10000 + 0.5)).otherwise(F.lit(0).cast("long")))
    given, fits = F.size("n") > 0, F.size("n") * F.array_max("n") < 9e37
    exact = F.aggregate(whole, F.lit(0).cast(number), lambda a, v: (a + v).cast(number)).cast("double")
    rough = F.aggregate("n", F.lit(0.0), lambda a, v: a + v)
    return numbers.select(
        "doc_id", F.size("n").alias("n_numbers"), F.array_min("n").alias("least"), F.array_max("n").alias("greatest"),
        F.get("n", F.lit(0)).alias("first_number"),
        F.when(given, F.when(fits, exact).otherwise(rough)).alias("whole_total"),
        F.when(given, F.aggregate(part, F.lit(0).cast("long"), lambda a, v: a + v)).alias("fraction_total"),
    )


@query("squeezed_texts", rf"""
select doc_id, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')) as squeezed,
       nullif(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '') as trimmed,
       trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g')) as catalog_text
from documents""")
def _squeezed(t: Inputs):
    return t.documents.select(
        "doc_id", squeeze("text").alias("squeezed"), blank_to_null("text").alias("trimmed"),
        normalize_catalog_text("text").alias("catalog_text"),
    )


@query("document_dates", r"""
with x as (select doc_id as id, text, '' as kind from documents union all
  select o_orderkey, case o_orderkey % 5 when 0 then 'от ' || strftime(o_orderdate, '%d.%m.%Y') when 1 then strftime(o_orderdate, '%Y-%m-%d')
         when 2 then strftime(o_orderdate, '%-d.%-m.%y') when 3 then strftime(o_orderdate, '%-d') || ' ' ||
         (['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря'])[month(o_orderdate)]
         || ' ' || strftime(o_orderdate, '%Y') || ' г.' else 'без даты' end,
         case when o_orderkey % 5 = 4 then 'none' when o_orderkey % 5 = 2 then strftime(o_orderdate, '20%y-%m-%d') else strftime(o_orderdate, '%Y-%m-%d') end
  from orders)
select id, kind, case when kind = 'none' then null when kind <> '' then kind else coalesce(
    case when regexp_matches(text, '\d{2}[./-]\d{2}[./-]\d{4}') then regexp_extract(text, '(\d{2})[./-](\d{2})[./-](\d{4})', 3)
      || '-' || regexp_extract(text, '(\d{2})[./-](\d{2})[./-](\d{4})', 2) || '-' || regexp_extract(text, '(\d{2})[./-](\d{2})[./-](\d{4})', 1) end,
    nullif(regexp_extract(text, '\d{4}-\d{2}-\d{2}', 0), ''),
    case when regexp_matches(text, '\b\d{1,2}[./-]\d{1,2}[./-]\d{2}\b') then '20' || regexp_extract(text, '\b(\d{1,2})[./-](\d{1,2})[./-](\d{2})\b', 3)
      || '-' || lpad(regexp_extract(text, '\b(\d{1,2})[./-](\d{1,2})[./-](\d{2})\b', 2), 2, '0')
      || '-' || lpad(regexp_extract(text, '\b(\d{1,2})[./-](\d{1,2})[./-](\d{2})\b', 1), 2, '0') end) end as found
from x""")
def _document_dates(t: Inputs):
    month = F.element_at(
        F.array(*[F.lit(m) for m in (
            "января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря",
        )]),
        F.month("o_orderdate"),
    )
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("от "), F.date_format("o_orderdate", "dd.MM.yyyy")))
        .when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k == 2, F.date_format("o_orderdate", "d.M.yy"))
        .when(k == 3, F.concat(F.date_format("o_orderdate", "d"), F.lit(" "), month, F.date_format("o_orderdate", " yyyy"), F.lit(" г.")))
        .otherwise(F.lit("без даты"))
    )
    kind = (
        F.when(k == 4, F.lit("none"))
        .when(k == 2, F.concat(F.lit("20"), F.date_format("o_orderdate", "yy-MM-dd")))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    texts = t.documents.select(F.col("doc_id").alias("id"), "text", F.lit("").alias("kind")).unionAll(
        t.orders.select("o_orderkey", text, kind)
    )
    return texts.select("id", "kind", find_date("text").alias("found"))


@query("document_kinds", """
select doc_id as id, case when l like '%универсаль%' and l like '%передаточ%' then 'УПД'
  when l like '%торг-12%' or l like '%товарная накладная%' then 'ТОРГ-12'
  when l like '%счет-фактура%' or l like '%счёт-фактура%' then 'Счет-фактура'
  when l like '%накладная%' then 'Накладная' end as form,
  (regexp_matches(l, 'страница\\s*2(?:$|[^0-9a-zа-яё_])') or l like '%порядковых номеров записей%') as continues
from (select doc_id * 10 + k as id, doc_id * 10 + k as doc_id, lower(case k when 0 then text
  when 1 then 'Универсальный ПЕРЕДАТОЧНЫЙ документ ' || text when 2 then text || ' Товарная накладная' when 3 then 'Счёт-фактура ' || text
  when 4 then 'НАКЛАДНАЯ ' || text when 5 then 'Страница 2 ' || text else 'порядковых номеров записей ' || text end) as l
  from documents cross join (select unnest([0,1,2,3,4,5,6]) as k) n) x""")
def _document_kinds(t: Inputs):
    prefix = ["", "Универсальный ПЕРЕДАТОЧНЫЙ документ ", "", "Счёт-фактура ", "НАКЛАДНАЯ ", "Страница 2 ", "порядковых номеров записей "]
    variants = F.array(*[
        F.struct(
            F.lit(k).alias("k"),
            F.concat(F.lit(p), F.col("text"), F.lit(" Товарная накладная" if k == 2 else "")).alias("body"),
        )
        for k, p in enumerate(prefix)
    ])
    rows = t.documents.select("doc_id", F.inline(variants))
    return rows.select(
        (F.col("doc_id") * 10 + F.col("k")).alias("id"), document_form("body").alias("form"),
        is_continuation_text("body").alias("continues"),
    )


@query("parse_documents")
def _parse_documents(t: Inputs):
    """Every header field, the items and the notes of the whole documents table, with the text they were read from."""
    parsed = route_useful(parse_documents(spread(t.documents.select("doc_id", "text"))))
    return parsed.select(
        "doc_id", *HEADER_COLUMNS, F.size("items").alias("n_items"), "items", "parser_notes", "parser_provider",
        F.col("text").alias("raw_text"),
    )


# ---------------------------------------------------------------- scalar rules on derived values

@query("tax_ids", """
select o_orderkey as id, cast(7700000000 + o_orderkey as varchar) as labelled, cast(3900000000 + o_custkey as varchar) as plain from orders""")
def _tax_ids(t: Inputs):
    labelled = F.concat(F.lit("ООО «А», ИНН: "), F.lit(7700000000) + F.col("o_orderkey"), F.lit(", КПП 770001001"))
    plain = F.concat(F.lit("тел. 12345, "), F.lit(3900000000) + F.col("o_custkey"), F.lit(" / 390001001"))
    return t.orders.select(
        F.col("o_orderkey").alias("id"), labelled_tax_id(labelled).alias("labelled"), plain_tax_id(plain).alias("plain")
    )


@query("document_numbers_found", """
select o_orderkey as id, case o_orderkey % 5 when 0 then 'УТ-' || cast(10000 + o_orderkey as varchar)
  when 1 then 'УПМК' || cast(10000 + o_orderkey as varchar) when 2 then cast(1 + o_orderkey % 9 as varchar) || '-' || cast(o_custkey + 100 as varchar) || '-2'
  when 3 then null else cast(o_orderkey + 1000 as varchar) end as found
from orders""")
def _document_numbers_found(t: Inputs):
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("No УТ - "), 10000 + F.col("o_orderkey"), F.lit(" от 5")))
        .when(k == 1, F.concat(F.lit("УПМК"), 10000 + F.col("o_orderkey")))
        .when(k == 2, F.concat(1 + F.col("o_orderkey") % 9, F.lit(" - "), F.col("o_custkey") + 100, F.lit("-2")))
        .when(k == 3, F.date_format("o_orderdate", "'принято' dd.MM.yyyy"))
        .otherwise((F.col("o_orderkey") + 1000).cast("string"))
    )
    return t.orders.select(F.col("o_orderkey").alias("id"), document_number_candidate(text).alias("found"))


@query("organization_names", """
select s_suppkey as id, 'ООО "' || s_name || ' плюс"' as organization,
  case when s_suppkey % 2 = 0 then 'ООО "' || s_name || ' плюс", г. Москва' else null end as party,
  'Договор ' || s_name as basis, case when s_suppkey % 3 = 0 then '' else 'ООО ' || s_name end as shown
from supplier""")
def _organization_names(t: Inputs):
    name = F.col("s_name")
    long = F.concat(F.lit('Поставщик:  Общество с ограниченной  ответственностью "'), name, F.lit(' плюс" 236044, г. Москва'))
    party = F.when(
        F.col("s_suppkey") % 2 == 0, F.concat(F.lit('000 "'), name, F.lit(' плюс", г. Москва р/с 407 (организация, адрес)'))
    ).otherwise(F.concat(F.lit("(организация, адрес, телефон) "), name.substr(1, 0)))
    basis = F.concat(F.lit("Основание: Договор "), name, F.lit(" ."))
    shown = F.when(F.col("s_suppkey") % 3 == 0, F.lit("Поставщик  не распознан")).otherwise(
        F.concat(F.lit("ООО  "), name, F.lit(" (адрес, телефон);"))
    )
    return t.supplier.select(
        F.col("s_suppkey").alias("id"), normalize_organization(long).alias("organization"), clean_party(party).alias("party"),
        clean_basis(basis).alias("basis"), display_value(shown).alias("shown"),
    )


@query("unit_names", """
select l_orderkey, l_linenumber, (['шт','шт','шт','кг','кг','кг','л','мл','шт','кор'])[1 + (l_partkey % 10)] as unit,
       l_partkey as part_key, l_suppkey as supp_key, l_quantity as quantity, l_extendedprice as price from lineitem""")
def _unit_names(t: Inputs):
    spelled = F.element_at(
        F.array(*[F.lit(u) for u in ("Штука.", "iiit", "шt", "KT", "кт.", "kg", "L", " мл ", "", "кор.")]),
        (F.col("l_partkey") % 10 + 1).cast("int"),
    )
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", normalize_unit(spelled).alias("unit"), F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
    )


@query("vat_amounts", """
select l_orderkey, l_linenumber, l_partkey as part_key, l_suppkey as supp_key, l_quantity as quantity, l_extendedprice as price,
  round_even(cast(l_extendedprice as decimal(24,6)) + cast(l_quantity as decimal(24,6)), 2)::double as gross,
  case when l_quantity <= 10 then 0 else round_even(cast(l_extendedprice * l_quantity / (100 + l_quantity) as decimal(28,8)), 2) end::double as included,
  case l_partkey % 3 when 0 then 20.0 when 1 then 10.0 else 18.0 end as inferred,
  case l_partkey % 3 when 0 then '20%' when 1 then '7.5%' else '18.0' end as shown
from lineitem""")
def _vat_amounts(t: Inputs):
    q, p, k = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_partkey") % 3
    rate = F.when(k == 0, 20.4).when(k == 1, 9.7).otherwise(18.2)
    shown = vat_display(
        F.when(k == 0, F.lit(" 20% ")), F.when(k == 1, F.lit(7.5)), F.lit("НДС: ; vatPercent: 18.0").substr(7, 30)
    )
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
        q.alias("quantity"), p.alias("price"), gross_sum(p, q).alias("gross"),
        vat_included(p, F.when(q <= 10, 0.0).otherwise(q)).alias("included"),
        infer_vat_percent(p, p * rate / 100).alias("inferred"), shown.alias("shown"),
    )


@query("row_figures", """
select l_orderkey, l_linenumber, l_partkey as part_key, l_suppkey as supp_key, l_quantity as quantity, l_extendedprice as price,
  case l_partkey % 3 when 0 then 20.0 when 1 then 10.0 end as vat_percent, case when l_partkey % 3 < 2 then 55.5 end as vat_sum
from lineitem""")
def _row_figures(t: Inputs):
    q, p = F.col("l_quantity").cast("decimal(12,2)").cast("string"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    tail = F.concat_ws(
        " ", F.lit("796 - -"), q, p, F.lit("777.7"),
        F.when(F.col("l_partkey") % 3 == 0, "20% 55,5 833.2").when(F.col("l_partkey") % 3 == 1, "10 55.5"),
    )
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
        row_figures(tail_numbers(tail), F.lit("шт")).alias("f"),
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "part_key", "supp_key", "f.quantity", "f.price", "f.vat_percent", "f.vat_sum"
    )


@query("sheet_cells", """
select l_orderkey, l_linenumber, l_partkey as part_key, l_suppkey as supp_key, l_quantity as quantity, l_extendedprice as price,
  case when l_partkey % 4 = 3 then null else l_extendedprice end as number, case when l_partkey % 4 = 3 then null else trunc(l_extendedprice)::int end as whole
from lineitem""")
def _sheet_cells(t: Inputs):
    text = F.col("l_extendedprice").cast("decimal(14,2)").cast("string")
    cell = (
        F.when(F.col("l_partkey") % 4 == 0, text)
        .when(F.col("l_partkey") % 4 == 1, F.concat(F.replace(text, F.lit("."), F.lit(",")), F.lit(" %")))
        .when(F.col("l_partkey") % 4 == 2, F.concat(text.substr(1, 1), F.lit(" "), F.substring(text, 2, 20)))
        .otherwise(F.lit("нет"))
    )
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        sheet_number(cell).alias("number"), sheet_int(cell).alias("whole"),
    )


@query("product_names", """
select p_partkey as id, case when p_partkey % 4 = 3 then 'Точка доступа Wi-Fi' when p_partkey % 4 = 2 then p_name || ' 16-портовый' else p_name end as cleaned,
       p_partkey % 4 <> 1 as is_product from part""")
def _product_names(t: Inputs):
    k = F.col("p_partkey") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("12 "), F.col("p_name"), F.lit(" 6598 4100 -")))
        .when(k == 1, F.concat(F.lit("- "), F.col("p_name"), F.lit(" —")))
        .when(k == 2, F.concat(F.col("p_name"), F.lit("  16 портовый")))
        .otherwise(F.concat(F.lit("Точка доступа 6)-F1 "), F.col("p_name")))
    )
    probe = F.when(k == 1, F.concat(F.lit("Сумма "), F.col("p_name"))).otherwise(F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), clean_name(raw).alias("cleaned"), is_product_name(probe).alias("is_product"))


@query("reformatted_dates", """
select o_orderkey as id, case when o_orderkey % 4 = 3 then 'завтра' else strftime(o_orderdate, '%d.%m.%Y') end as dotted,
       case when o_orderkey % 4 = 3 then 'завтра' else strftime(o_orderdate, '%Y-%m-%d') end as iso,
       strftime(o_orderdate, '%Y-%m-%d') as named
from orders""")
def _reformatted(t: Inputs):
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k == 1, F.date_format("o_orderdate", "d.M.yyyy"))
        .when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.lit(" завтра "))
    )
    named = F.date_format("o_orderdate", "'от' dd/MM/yyyy")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), reformat_date(text, True).alias("dotted"), reformat_date(text, False).alias("iso"),
        find_date_in_transfer_form(named).alias("named"),
    )


@query("local_times", """
select event_id, strftime(ts + case event_id % 4 when 0 then interval 3 hour when 1 then interval (-90) minute else interval 0 hour end,
       '%Y-%m-%d %H:%M:%S') as local_text from events""")
def _local_times(t: Inputs):
    k = F.col("event_id") % 4
    zone = F.when(k == 0, "Europe/Moscow").when(k == 2, "Mars/Base")
    offset = F.when(k == 1, -90).when(k == 3, 5000)
    return t.events.select("event_id", local_time_text(F.col("ts"), zone, offset).alias("local_text"))


# ---------------------------------------------------------------- rendered documents

def _two(value: Column) -> Column:
    return value.cast("decimal(24,2)").cast("string")


def _comma(value: Column) -> Column:
    return F.replace(value.cast("decimal(24,3)").cast("string"), F.lit("."), F.lit(","))


def render(t: Inputs, line: Column, head: str, tail: Column, lines: DataFrame | None = None) -> DataFrame:
    """Documents ``(doc_id, text)``: one per receiving, its lines rendered between a head and a tail."""
    source = t.order_lines if lines is None else lines
    return (
        source.select("receiving_id", "item_pos", "quantity", "price", line.alias("line"))
        .groupBy("receiving_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("item_pos", "line"))).alias("all"),
            F.sum((F.col("quantity") * F.col("price")).cast("decimal(24,2)")).alias("total"),
        )
        .select(
            F.col("receiving_id").alias("doc_id"),
            F.concat_ws("\n", F.lit(head), F.transform("all", lambda x: x["line"]), tail).alias("text"),
        )
    )


def parsed_items(documents: DataFrame) -> DataFrame:
    return item_rows(with_items(with_kind(spread(documents))), "doc_id").select(
        "doc_id", "item_pos", "name", "quantity", "unit", "price", "sum", "vat", "vat_percent", "vat_sum"
    )



@query("inline_rows", """
select receiving_id as doc_id, item_pos, name, quantity, 'шт' as unit, price, round(quantity * price, 2) as sum,
       cast(null as varchar) as vat, cast(null as double) as vat_percent, cast(null as double) as vat_sum
from order_lines""", needs=("order_lines",))
def _inline_rows(t: Inputs):
    q, p = F.col("quantity"), F.col("price")
    line = F.concat_ws(" ", "name", q.cast("int").cast("string"), F.lit("шт"), _two(p), _two(q * p))
    return parsed_items(render(t, line, "Накладная", F.lit("Отпустил")))


@query("receipt_rows", """
select receiving_id as doc_id, item_pos, name, quantity, 'шт' as unit, price, round(quantity * price, 2) as sum,
       cast(null as varchar) as vat, cast(null as double) as vat_percent, cast(null as double) as vat_sum
from order_lines""", needs=("order_lines",))
def _receipt_rows(t: Inputs):
    q, p = F.col("quantity"), F.col("price")
    line = F.concat_ws(
        "\n", F.concat(F.col("item_pos").cast("string"), F.lit(" ТОВАР : ШТ. [M+]7362 "), F.col("name")),
        F.concat(F.lit("ЦЕНА : "), _two(p), F.when(F.col("item_pos") % 2 == 0, F.concat(F.lit(" кол-во: "), q.cast("int").cast("string"))).otherwise(F.lit(""))),
        F.when(F.col("item_pos") % 2 == 1, F.concat(F.lit("КОЛ-ВО: "), q.cast("int").cast("string"))),
        F.concat(F.lit("СУММА : "), _two(q * p)),
    )
    return parsed_items(render(t, line, "ТОВАРНЫЙ ЧЕК\nКАССИР ИВАНОВ", F.lit("БАНКОВСКИЕ ОПЛАТЫ")))


_FIRST_BY_NAME = """
firsts as (select *, row_number() over (partition by receiving_id order by item_pos) as n
           from (select *, row_number() over (partition by receiving_id, name order by item_pos) as k from order_lines) x where k = 1)
"""


@query("block_rows", f"""with {_FIRST_BY_NAME}
select receiving_id as doc_id, n as item_pos, name, quantity, 'шт' as unit, price, round(quantity * price, 2) as sum, '20%' as vat,
       20.0 as vat_percent, 4.5 as vat_sum from firsts""", needs=("order_lines",))
def _block_rows(t: Inputs):
    q, p = F.col("quantity"), F.col("price")
    line = F.concat_ws(
        "\n", F.concat(F.col("item_pos").cast("string"), F.when(F.col("item_pos") % 2 == 0, "\n").otherwise(" "), F.col("name")),
        F.lit("шт"), F.lit("166"), _comma(q), _comma(p), _two(q * p), F.lit("20"), F.lit("4,50"), _two(q * p + 4.5),
    )
    return parsed_items(render(t, line, "Сумма с учетом НДС руб. коп.", F.lit("Всего по накладной")))


@query("numbered_rows", f"""with {_FIRST_BY_NAME}
select receiving_id as doc_id, n as item_pos, name, quantity, 'кг' as unit, price, round(quantity * price, 2) as sum, '18%' as vat,
       18.0 as vat_percent, 7.25 as vat_sum from firsts""", needs=("order_lines",))
def _numbered_rows(t: Inputs):
    q, p = F.col("quantity"), F.col("price")
    line = F.concat_ws(
        " ", F.col("item_pos").cast("string"), "name", F.lit("- кг 796 - - -"), _two(q), _two(p), _two(q * p), F.lit("18% 7.25"), _two(q * p + 7.25)
    )
    return parsed_items(render(t, line, "Сумма с учетом НДС руб. коп.", F.lit("Всего по накладной")))


@query("transfer_rows", """
select receiving_id as doc_id, item_pos, 'Сыр ' || name as name, quantity, 'кг' as unit, price, round(quantity * price, 2) as sum, '10%' as vat,
       10.0 as vat_percent, cast(round_even(cast(quantity * price as decimal(24,2)) * 0.1, 2) as double) as vat_sum
from order_lines""", needs=("order_lines",))
def _transfer_rows(t: Inputs):
    q, p = F.col("quantity"), F.col("price")
    net = (q * p).cast("decimal(24,2)")
    vat = F.bround(net * F.lit("0.1").cast("decimal(3,1)"), 2)
    line = F.concat_ws(
        "\n", F.concat(F.col("item_pos").cast("string"), F.when(F.col("item_pos") % 2 == 0, "\n").otherwise(" "), F.lit("Сыр "), F.col("name")),
        F.lit("2a\n4\n5"), F.lit("166 кг"), _comma(q), _comma(p), _two(net), F.lit("без акциза"), F.lit("10%"), vat.cast("string"),
        (net + vat).cast("string"),
    )
    head = "Универсальный передаточный документ\nСчет-фактура No УТ-35634 от 23 июня 2026 г.\nНаименование товара"
    return parsed_items(render(t, line, head, F.lit("Главный бухгалтер\n1,00")))


@query("column_groups", """
select receiving_id as doc_id, item_pos, name || ' ' || cast(item_pos as varchar) as name, quantity, 'кг' as unit, price,
       round(quantity * price, 2) as sum, '7%' as vat, 7.0 as vat_percent, 3.25 as vat_sum from order_lines""", needs=("order_lines",))
def _column_groups(t: Inputs):
    q, p = F.col("quantity"), F.col("price")
    parts = t.order_lines.select(
        "receiving_id", "item_pos",
        F.concat_ws(" ", F.col("item_pos").cast("string"), "name", F.col("item_pos").cast("string")).alias("head"),
        F.concat_ws("\n", F.lit("кг"), F.lit("166"), _comma(q), _comma(p), _two(q * p), F.lit("7%"), F.lit("3,25"), _two(q * p + 3.25)).alias("body"),
    )
    texts = parts.groupBy("receiving_id").agg(F.array_sort(F.collect_list(F.struct("item_pos", "head", "body"))).alias("all")).select(
        F.col("receiving_id").alias("doc_id"),
        F.concat_ws(
            "\n", F.lit("Товар"), F.transform("all", lambda x: x["head"]), F.lit("Сумма с учетом НДС руб. коп."),
            F.transform("all", lambda x: x["body"]), F.lit("Итого"),
        ).alias("text"),
    )
    return parsed_items(texts)


@query("mixed_columns", """
select receiving_id as doc_id, item_pos, name || ' ' || cast(item_pos as varchar) as name, pow(3, item_pos) + 0.5 as quantity, 'кг' as unit,
       100.0 + part_key % 50 as price, (pow(3, item_pos) + 0.5) * (100 + part_key % 50) as sum, '7%' as vat, 7.0 as vat_percent,
       cast(round_even(cast((pow(3, item_pos) + 0.5) * (100 + part_key % 50) as decimal(24,2)) * 0.07, 2) as double) as vat_sum
from order_lines""", needs=("order_lines",))
def _mixed_columns(t: Inputs):
    q, p = F.pow(F.lit(3.0), F.col("item_pos")) + 0.5, 100.0 + F.col("part_key") % 50
    net = (q * p).cast("decimal(24,2)")
    vat = F.bround(net * F.lit("0.07").cast("decimal(3,2)"), 2)
    rows = t.order_lines.select(
        "receiving_id", "item_pos",
        F.concat_ws("\n", F.concat_ws(" ", F.col("item_pos").cast("string"), "name", F.col("item_pos").cast("string")), F.lit("KT"), F.lit("166"), _comma(q)).alias("head"),
        _two(p).alias("price"),
        F.concat_ws("\n", F.concat(net.cast("string"), F.lit(" 7%")), vat.cast("string"), (net + vat).cast("string")).alias("body"),
    )
    texts = rows.groupBy("receiving_id").agg(
        F.array_sort(F.collect_list(F.struct("item_pos", "head", "price", "body"))).alias("all")
    ).select(
        F.col("receiving_id").alias("doc_id"),
        F.concat_ws(
            "\n", F.lit("ТОВАРНАЯ НАКЛАДНАЯ"), F.transform("all", lambda x: x["head"]),
            F.array_join(F.transform("all", lambda x: x["price"]), " "), F.transform("all", lambda x: x["body"]), F.lit("Итого"),
        ).alias("text"),
    )
    return parsed_items(texts)


def _headed(t: Inputs) -> DataFrame:
    """Waybills with a printed header, one per receiving, lines or not."""
    lines = t.order_lines.select(
        "receiving_id", "item_pos",
        F.concat_ws(" ", "name", F.col("quantity").cast("int").cast("string"), F.lit("шт"), _two(F.col("price")), _two(F.col("quantity") * F.col("price"))).alias("line"),
    ).groupBy("receiving_id").agg(F.array_sort(F.collect_list(F.struct("item_pos", "line"))).alias("all"))
    heads = t.receivings.join(lines.withColumnRenamed("receiving_id", "id"), "id", "left")
    return heads.select(
        F.col("id").alias("doc_id"),
        F.concat_ws(
            "\n", F.lit("Унифицированная форма No ТОРГ-12"),
            F.concat(F.lit('Поставщик ООО "'), F.col("supplier"), F.lit(' плюс", ИНН '), F.lit(7700000000) + F.col("id"), F.lit(" (организация, адрес)")),
            F.lit("Грузополучатель"), F.concat(F.lit('ООО "'), F.col("venue"), F.lit(' плюс", г. Москва р/с 4070')),
            F.concat(F.lit("Склад / подразделение: Склад номер "), F.col("id") % 7),
            F.concat(F.lit("Основание: Договор поставки "), F.col("id") % 100),
            F.lit("Номер документа"), F.lit("Дата составления"), F.concat(F.lit("УТ-"), F.col("id") + 10000), F.date_format("created_at", "dd.MM.yyyy"),
            F.lit("Сумма с учетом НДС руб. коп."), F.transform("all", lambda x: x["line"]),
        ).alias("text"),
    )


@query("waybill_headers", """
select r.id as doc_id, 'ООО "' || supplier || ' плюс", ИНН ' || cast(7700000000 + id as varchar) as supplier,
       cast(7700000000 + id as varchar) as supplier_inn, 'ООО "' || venue || ' плюс", г. Москва' as consignee,
       'ООО "' || venue || ' плюс", г. Москва' as recipient, 'номер ' || cast(id % 7 as varchar) as warehouse,
       'Договор поставки ' || cast(id % 100 as varchar) as basis, 'УТ-' || cast(id + 10000 as varchar) as invoice_number,
       strftime(created_at, '%Y-%m-%d') as invoice_date, 'ТОРГ-12' as document_form,
       (select cast(sum(cast(quantity * price as decimal(24,2))) as double) from order_lines o where o.receiving_id = r.id) as total_sum
from receivings r""", needs=("order_lines", "receivings"))
def _waybill_headers(t: Inputs):
    return parse_documents(spread(_headed(t))).select(
        "doc_id", "supplier", "supplier_inn", "consignee", "recipient", "warehouse", "basis", "invoice_number", "invoice_date",
        "document_form", "total_sum",
    )


# ---------------------------------------------------------------- pages

def _pages(t: Inputs) -> DataFrame:
    """Receivings read as pages of up to three lines, with header values on some pages only."""
    rows = t.order_lines.withColumn("page", F.floor((F.col("item_pos") - 1) / 3) + 1)
    packed = rows.groupBy("receiving_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("item_pos", "name", "quantity", "price"))).alias("all")
    )
    return packed.select(
        F.col("receiving_id").alias("doc_id"), "page",
        F.transform("all", lambda x: F.struct(x["name"].alias("name"), x["quantity"].alias("quantity"), x["price"].alias("price"))).alias("items"),
        F.when(F.col("page") == 2, "S2").when(F.col("page") == 3, "S3").alias("supplier"),
        F.when(F.col("page") == 1, "").otherwise(F.concat(F.lit("N"), F.col("page"))).alias("invoice_number"),
        F.lit(5.5).alias("total_sum"),
        F.array(F.lit("общая"), F.concat(F.lit("страница "), F.col("page") % 2)).alias("parser_notes"),
        F.concat(F.lit("p"), F.col("page") % 2).alias("parser_provider"),
        F.concat(F.lit("f"), F.col("page")).alias("file_name"), F.element_at("all", 1)["name"].alias("text"),
    )


@query("merged_page_headers", """
with p as (select receiving_id, max((item_pos - 1) // 3 + 1) as n from order_lines group by receiving_id)
select receiving_id as doc_id, n as n_pages, case when n >= 2 then 'S2' end as supplier, case when n >= 2 then 'N2' end as invoice_number,
       case when n = 1 then 5.5 end as total_sum from p""", needs=("order_lines",))
def _merged_headers(t: Inputs):
    return paging.merge_headers(_pages(t)).select("doc_id", "n_pages", "supplier", "invoice_number", "total_sum")


@query("merged_page_items", """
select receiving_id as doc_id, (item_pos - 1) // 3 + 1 as page, item_pos, name, quantity, price from order_lines""", needs=("order_lines",))
def _merged_items(t: Inputs):
    return paging.merge_items(_pages(t))


@query("merged_page_texts", """
with f as (select receiving_id, (item_pos - 1) // 3 + 1 as page, name from order_lines where (item_pos - 1) % 3 = 0)
select receiving_id as doc_id, page, '--- File ' || page || ': f' || page || ' ---' || chr(10) || name as raw_text from f""", needs=("order_lines",))
def _merged_texts(t: Inputs):
    return paging.merge_texts(_pages(t))


@query("merged_page_notes", """
with p as (select receiving_id, max((item_pos - 1) // 3 + 1) as n from order_lines group by receiving_id)
select receiving_id as doc_id, 'общая' as note, case when n = 1 then 'p1' else 'multipage_p1+p0' end as parser_provider from p
union all select receiving_id, 'страница 1', case when n = 1 then 'p1' else 'multipage_p1+p0' end from p
union all select receiving_id, 'страница 0', 'multipage_p1+p0' from p where n > 1
union all select receiving_id, 'Многостраничная накладная: объединено файлов/страниц: ' || n || '.', 'multipage_p1+p0' from p where n > 1""",
       needs=("order_lines",))
def _merged_notes(t: Inputs):
    p = _pages(t)
    return paging.merge_notes(p).select("doc_id", "note").join(paging.merge_providers(p), "doc_id")


# ---------------------------------------------------------------- register files

def _cell(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def register_texts(t: Inputs) -> DataFrame:
    """Register files as texts, one per receiving: title, header, rows with quoted commas and a blank row."""
    header = "Загрузка,Дата документа,№ Документа,Поставщик,Торговая точка,Наименование товара из документа,Ед.изм. в документе,Кол-во в документе,Цена за ед-цу,Стоимость без НДС,Ставка НДС,Сумма НДС,Общая стоимость,Корректировка"
    q, p = F.col("quantity"), F.col("price")
    leading = F.col("item_pos") == 1
    row = F.concat_ws(
        ",", F.when(F.col("item_pos") % 5 == 4, "Нет").otherwise(""), F.when(leading, "2024-05-06").otherwise(""),
        F.when(leading, F.concat(F.lit("N-"), F.col("receiving_id"))).otherwise(""),
        F.when(leading, _cell(F.concat(F.lit('ООО "Ромашка", '), F.col("receiving_id")))).otherwise(""), F.lit(""),
        _cell(F.concat(F.col("name"), F.lit(', "1 сорт"'))), F.lit("кг"), q.cast("string"),
        _cell(F.replace(_two(p), F.lit("."), F.lit(","))), F.when(F.col("item_pos") % 2 == 0, _two(q * p)).otherwise(""), F.lit("20%"),
        F.lit("1.5"), _two(q * p + 1.5), F.lit(""),
    )
    rows = t.order_lines.select("receiving_id", "item_pos", row.alias("row"))
    return rows.groupBy("receiving_id").agg(F.array_sort(F.collect_list(F.struct("item_pos", "row"))).alias("all")).select(
        F.concat(F.lit("invoice_"), F.col("receiving_id")).alias("file"),
        F.concat_ws(
            "\r\n", F.lit("﻿Накладные"), F.lit(""), F.lit("Накладные"), F.lit(header), F.transform("all", lambda x: x["row"]), F.lit(""), F.lit("")
        ).alias("text"),
    )


@query("register_items", """
select 'invoice_' || cast(receiving_id as varchar) as file, item_pos as line_number, name || ', "1 сорт"' as name, quantity, 'кг' as unit, price,
       round(quantity * price, 2) as sum, 20.0 as vat_percent, '20%' as vat, 1.5 as vat_sum, cast(null as varchar) as comment,
       'ready' as mapping_status, cast(null as varchar) as mapping_error
from order_lines where item_pos % 5 <> 4""", needs=("order_lines",))
def _register_items(t: Inputs):
    records = registers.with_records(spread(register_texts(t)))
    return registers.register_to_items(registers.register_rows(records, registers.ITEM_COLUMNS))


@query("register_headers", """
select distinct 'invoice_' || cast(receiving_id as varchar) as file, 'ООО "Ромашка", ' || cast(receiving_id as varchar) as supplier,
       'N-' || cast(receiving_id as varchar) as invoice_number, '2024-05-06' as invoice_date, '' as venue, 'Основной склад' as warehouse
from order_lines""", needs=("order_lines",))
def _register_headers(t: Inputs):
    rows = registers.register_rows(registers.with_records(spread(register_texts(t))), registers.HEADER_COLUMNS)
    return registers.register_to_header(rows).select("file", "supplier", "invoice_number", "invoice_date", "venue", "warehouse")


def summary_texts(t: Inputs) -> DataFrame:
    """Older review sheets as texts: a summary block (two forms) and an item block (two forms)."""
    q, p = F.col("quantity"), F.col("price")
    checked = F.col("receiving_id") % 2 == 0
    row = F.when(
        checked,
        F.concat_ws(",", F.col("item_pos").cast("string"), F.lit("Готово"), F.lit(""), F.col("name"), q.cast("string"), F.lit("кг"), _two(p), _two(q * p), F.lit("20.0"), F.lit("4"), F.lit("ок")),
    ).otherwise(
        F.concat_ws(",", F.col("item_pos").cast("string"), F.col("name"), q.cast("string"), F.lit("кг"), _two(p), F.lit(""), F.lit("20.0"), F.lit("4"), _two(q * p + 4))
    )
    heading = F.when(checked, F.lit("№,Статус проверки,Что исправить,Наименование товара,Количество,Ед. изм.,Цена,Сумма,НДС %,НДС сумма,Комментарий пользователя")).otherwise(
        F.lit("№,Наименование товара,Количество,Ед. изм.,Цена,Сумма без НДС,НДС %,НДС сумма,Сумма с НДС,Комментарий пользователя")
    )
    number = F.concat(F.lit("D-"), F.col("receiving_id"))
    summary = F.when(
        F.col("receiving_id") % 3 == 0,
        F.concat(F.lit('Поставщик,Номер накладной,Склад / подразделение\n"ООО ""Лир"", Москва",'), number, F.lit(",Кухня")),
    ).otherwise(
        F.concat(F.lit('Поле,Значение\nПоставщик,старый\nПоставщик,"ООО ""Лир"", Москва"\nНомер накладной,'), number, F.lit("\nСклад / подразделение,Кухня"))
    )
    rows = t.order_lines.select("receiving_id", "item_pos", row.alias("row"))
    return rows.groupBy("receiving_id").agg(F.array_sort(F.collect_list(F.struct("item_pos", "row"))).alias("all")).select(
        F.concat(F.lit("review_"), F.col("receiving_id")).alias("file"),
        F.concat_ws(
            "\n", F.lit("Проверка накладной 1"), F.lit(""), F.lit("Накладная"), summary, F.lit(""), F.lit("Товарные позиции"), heading,
            F.transform("all", lambda x: x["row"]), F.lit(""),
        ).alias("text"),
    )


@query("summary_blocks", """
with r as (select distinct receiving_id from order_lines)
select 'review_' || cast(receiving_id as varchar) as file, f.field,
       case f.field when 'Поставщик' then 'ООО "Лир", Москва' when 'Номер накладной' then 'D-' || cast(receiving_id as varchar) else 'Кухня' end as value
from r cross join (select unnest(['Поставщик', 'Номер накладной', 'Склад / подразделение']) as field) f""", needs=("order_lines",))
def _summary_blocks(t: Inputs):
    return registers.read_summary_blocks(registers.with_records(spread(summary_texts(t))))


@query("summary_headers", """
select distinct 'review_' || cast(receiving_id as varchar) as file, 'ООО "Лир", Москва' as supplier, 'D-' || cast(receiving_id as varchar) as invoice_number,
       'Кухня' as iiko_default_store_id, '' as venue from order_lines""", needs=("order_lines",))
def _summary_headers(t: Inputs):
    blocks = registers.read_summary_blocks(registers.with_records(spread(summary_texts(t))))
    return registers.summary_to_header(blocks).select("file", "supplier", "invoice_number", "iiko_default_store_id", "venue")


@query("legacy_items", """
select 'review_' || cast(receiving_id as varchar) as file, item_pos as line_number, name, quantity, 'кг' as unit, price, round(quantity * price, 2) as sum,
       20.0 as vat_percent, '20%' as vat, 4.0 as vat_sum, case when receiving_id % 2 = 0 then 'ок' end as comment,
       'ready' as mapping_status, cast(null as varchar) as mapping_error
from order_lines""", needs=("order_lines",))
def _legacy_items(t: Inputs):
    return registers.read_legacy_items(registers.with_records(spread(summary_texts(t))))
