"""Queries over reviews: intake, metadata, mapping, validation, previews, register."""

from __future__ import annotations

from pyspark.sql import functions as F

from goodsledger.operators import catalog as catalogs
from goodsledger.operators import payloads, register, review, sync
from goodsledger.operators.review import COMMENT_UPLOADED
from goodsledger.plans.registry import Inputs, query
from goodsledger.sources.catalogs import stated_percent
from goodsledger.schemas import CATALOG, REGISTER_HEADERS, conform
from goodsledger.session import stored

# Review lines: ordered lines as recognized from documents, some with ids, VAT, stated sums or gaps.
LINES_SQL = """
select receiving_id, item_pos,
       case when k = 9 then '' else name end as name,
       case when k = 8 then 0.0 else quantity end as quantity,
       'шт' as unit, price,
       case when k = 1 then cast(quantity * price as double) when k = 2 then 100.0 end as given_sum,
       case when k = 3 then '20%' when k = 4 then '10,5 %' end as vat,
       case when k = 5 then 18.0 end as vat_percent,
       case when k = 3 then 12.5 end as vat_sum,
       case when k = 6 then 'P' || cast(part_key as varchar(20)) end as iiko_product_id,
       case when k = 7 then 'A' || cast(part_key as varchar(20)) end as product_article,
       case when k = 0 then 'проверить' end as comment
from (select *, (part_key + item_pos) % 10 as k from {order_lines}) x
"""
HEADS_SQL = """
select r.id as receiving_id, r.created_at,
       case when r.id % 7 = 0 then cast(null as varchar(20)) else r.supplier end as supplier,
       case when r.id % 11 = 0 then '' else r.venue end as venue,
       case when r.id % 5 = 0 then cast(null as varchar(20)) else 'INV-' || cast(r.id as varchar(20)) end as invoice_number,
       case when r.id % 6 = 0 then '' else '2024-03-07' end as invoice_date,
       case when r.id % 3 = 0 then 'SUP-1' end as iiko_supplier_id,
       case when r.id % 4 = 0 then 'STORE-1' end as iiko_default_store_id
from {receivings} r
"""


def review_requests(t: Inputs):
    """Review requests with nested items, derived from receivings and ordered lines."""
    lines = t.spark.sql(LINES_SQL, order_lines=t.order_lines)
    items = lines.groupBy("receiving_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "item_pos", "name", "quantity", "unit", "price", F.col("given_sum").alias("sum"), "vat", "vat_percent",
            "vat_sum", "iiko_product_id", "product_article", "comment",
        ))).alias("items")
    )
    heads = t.spark.sql(HEADS_SQL, receivings=t.receivings)
    # a receiving without lines is a request without items
    none = F.array().cast(items.schema["items"].dataType)
    return heads.join(items, "receiving_id", "left").withColumn("items", F.coalesce("items", none))


def stored_requests(t: Inputs):
    """Review requests written once, for queries that read them several times."""
    return stored(review_requests(t), "review_requests")


def reviews(t: Inputs, catalog=None):
    return review.create_reviews(review_requests(t), catalog)


def review_documents(t: Inputs, requests=None):
    """The document of every review request."""
    heads = t.spark.sql(HEADS_SQL, receivings=t.receivings) if requests is None else requests
    return heads.select(
        F.col("receiving_id").alias("id"), "receiving_id", F.concat(F.lit("file_"), F.col("receiving_id")).alias("file_id"),
        F.lit(None).cast("string").alias("file_url"), F.lit("Товарная накладная").alias("raw_text"),
        F.col("supplier").alias("supplier_legal_name"), "invoice_number", "invoice_date", "created_at",
    )


_IDENT = {"order_lines": "order_lines", "receivings": "receivings"}
REVIEW_SQL = f"""
lines as ({LINES_SQL.format(**_IDENT)}),
heads as ({HEADS_SQL.format(**_IDENT)}),
bare_heads as (select h.* from heads h where h.receiving_id not in (select receiving_id from lines)),
amounts as (
  select *, coalesce(given_sum, round_even(quantity * price, 2)) as line_sum,
         round_even(quantity * price, 2) as expected,
         coalesce(vat_percent, case vat when '20%' then 20.0 when '10,5 %' then 10.5 end) as percent
  from lines)
"""
REVIEW_NEEDS = ("order_lines", "receivings")


ITEM_COMMENT_SQL = """nullif(concat_ws('; ', 'НДС: ' || vat, 'vatPercent: ' || cast(vat_percent as varchar), 'vatSum: ' || cast(vat_sum as varchar),
              'iiko_product_id: ' || iiko_product_id, 'productArticle: ' || product_article, comment,
              case when abs(given_sum - expected) > 0.01 then 'Расхождение суммы: распознано ' || cast(given_sum as varchar)
                   || ', рассчитано ' || cast(expected as varchar) end), '')"""


@query("review_items", f"""with {REVIEW_SQL}
select receiving_id, item_pos, name as item_name_from_invoice, quantity as received_quantity, unit,
       price as invoice_price,
       case when name <> '' and quantity > 0 then 'accepted' else 'manual_review' end as status,
       {ITEM_COMMENT_SQL} as comment
from amounts""", needs=REVIEW_NEEDS)
def _review_items(t: Inputs):
    return reviews(t)[3].select(
        "receiving_id", "item_pos", "item_name_from_invoice", "received_quantity", "unit", "invoice_price", "status", "comment"
    )


@query("review_lines", f"""with {REVIEW_SQL}
select receiving_id, item_pos, item_pos as line_number, name, quantity, unit, unit as amount_unit, price,
       line_sum as sum, percent as vat_percent, vat_sum from amounts""", needs=REVIEW_NEEDS)
def _review_lines(t: Inputs):
    return reviews(t)[2].select(
        "receiving_id", "item_pos", "line_number", "name", "quantity", "unit", "amount_unit", "price", "sum",
        "vat_percent", "vat_sum",
    )


@query("review_receivings", f"""with {REVIEW_SQL}
select receiving_id as id, coalesce(supplier, '') as supplier, venue,
       coalesce(invoice_number, 'MANUAL-' || strftime(created_at, '%Y%m%d%H%M%S')) as order_number,
       'MVP4-' || coalesce(invoice_number, 'MANUAL-' || strftime(created_at, '%Y%m%d%H%M%S')) as request_id,
       'ocr_processed' as status
from heads""", needs=REVIEW_NEEDS)
def _review_receivings(t: Inputs):
    return reviews(t)[0].select("id", "supplier", "venue", "order_number", "request_id", "status")


@query("review_headers", f"""with {REVIEW_SQL}
select receiving_id, iiko_supplier_id, iiko_default_store_id, venue as trade_point,
       iiko_default_store_id as warehouse, iiko_default_store_id as display_store,
       case when iiko_supplier_id is null or iiko_default_store_id is null then 'needs_review' else 'ready' end as iiko_mapping_status,
       concat_ws('; ', case when iiko_supplier_id is null then 'не заполнен iiko_supplier_id' end,
                 case when iiko_default_store_id is null then 'не заполнен iiko_default_store_id/defaultStore' end) as iiko_mapping_error
from heads""", needs=REVIEW_NEEDS)
def _review_headers(t: Inputs):
    return reviews(t)[1].select(
        "receiving_id", "iiko_supplier_id", "iiko_default_store_id", "trade_point", "warehouse", "display_store",
        "iiko_mapping_status", "iiko_mapping_error",
    )


ISSUES_SQL = REVIEW_SQL + """,
mapped as (select *, iiko_supplier_id is null or iiko_default_store_id is null as review,
                  concat_ws('; ', case when iiko_supplier_id is null then 'не заполнен iiko_supplier_id' end,
                  case when iiko_default_store_id is null then 'не заполнен iiko_default_store_id/defaultStore' end) as error
           from heads),
raw_issues as (
  select receiving_id, 'не распознан поставщик' as message from mapped where supplier is null
  union all select receiving_id, 'не распознана точка доставки / организация' from mapped where venue = ''
  union all select receiving_id, 'не распознан номер накладной' from mapped where invoice_number is null
  union all select receiving_id, 'не распознана дата накладной' from mapped where invoice_date = ''
  union all select receiving_id, 'требуется проверка сопоставления шапки накладной: ' || error from mapped where review
  union all select receiving_id, 'не указан поставщик iiko/supplier id' from mapped where iiko_supplier_id is null
  union all select receiving_id, 'не указан склад iiko/defaultStore' from mapped where iiko_default_store_id is null
  union all select receiving_id, 'нет iiko product/productArticle по позиции: ' || coalesce(nullif(name, ''), 'строка ' || item_pos)
            from amounts where iiko_product_id is null and product_article is null
  union all select receiving_id, 'некорректное количество по позиции: ' || coalesce(nullif(name, ''), 'строка ' || item_pos)
            from amounts where quantity <= 0
  union all select receiving_id, 'нет товарных позиций' from bare_heads),
issues as (select distinct receiving_id, message from raw_issues)
"""


def _issues(t: Inputs):
    receivings, headers, lines, items = reviews(t)
    return receivings, review.review_issues(receivings, items, headers, review_documents(t), lines)


@query("review_issues", f"with {ISSUES_SQL} select * from issues", needs=REVIEW_NEEDS)
def _review_issues(t: Inputs):
    return _issues(t)[1].select("receiving_id", "message")


@query("review_status", f"""with {ISSUES_SQL},
n as (select receiving_id, count(*) as n from issues group by receiving_id)
select k.receiving_id, coalesce(n.n, 0) as n_issues, case when n.n is null then 'ready' else 'needs_review' end as status
from heads k left join n on n.receiving_id = k.receiving_id""", needs=REVIEW_NEEDS)
def _review_status(t: Inputs):
    return review.review_status(*_issues(t))


@query("approval_gate", f"""with {ISSUES_SQL},
n as (select receiving_id, count(*) as n from issues group by receiving_id)
select k.receiving_id,
       case when k.receiving_id % 3 = 0 then 'Перед отправкой пользователь должен подтвердить проверку накладной'
            when n.n > 0 and k.receiving_id % 2 = 0 then 'Накладная требует проверки' end as error_message
from heads k left join n on n.receiving_id = k.receiving_id""", needs=REVIEW_NEEDS)
def _approval_gate(t: Inputs):
    receivings, issues = _issues(t)
    approvals = receivings.select(
        F.col("id").alias("receiving_id"), (F.col("id") % 3 != 0).alias("approved"), (F.col("id") % 2 != 0).alias("allow_with_warnings")
    )
    passed, blocked = review.approval_gate(review.review_status(receivings, issues), approvals)
    return passed.select("receiving_id", F.lit(None).cast("string").alias("error_message")).unionByName(
        blocked.select("receiving_id", "error_message")
    )


# ---------------------------------------------------------------- stored metadata

def _stored(t: Inputs):
    """Metadata as stored now; the header row of every tenth receiving is broken."""
    _, headers, lines, _ = reviews(t)
    broken = (F.col("item_pos") == 0) & (F.col("receiving_id") % 10 == 0)
    return review.stored_meta(headers, lines).withColumn(
        "recognized_items_json", F.when(broken, "{broken").otherwise(F.col("recognized_items_json"))
    )


def _whole_documents(t: Inputs):
    """Documents as they were stored before, one JSON each: a third of them bare lists, some broken."""
    requests = review_requests(t)
    listed = F.to_json(F.transform("items", lambda x: F.struct(x["name"].alias("name"), x["sum"].alias("sum"))))
    wrapped = F.concat(F.lit('{"header":'), F.to_json(F.struct("iiko_supplier_id")), F.lit(',"items":'), listed, F.lit("}"))
    text = F.when(F.col("receiving_id") % 3 == 1, listed).when(F.col("receiving_id") % 10 == 0, F.lit("{broken")).otherwise(wrapped)
    return requests.select(F.col("receiving_id").alias("id"), "receiving_id", text.alias("recognized_items_json"))


@query("document_meta", f"""with {REVIEW_SQL}
select a.receiving_id, a.item_pos, a.name, a.given_sum as sum,
       case when a.receiving_id % 3 <> 1 then h.iiko_supplier_id end as iiko_supplier_id
from amounts a join heads h on h.receiving_id = a.receiving_id
where a.receiving_id % 3 = 1 or a.receiving_id % 10 <> 0""", needs=REVIEW_NEEDS)
def _document_meta(t: Inputs):
    documents = _whole_documents(t)
    heads = review.document_headers(documents).select("receiving_id", "header.iiko_supplier_id")
    return review.document_meta_lines(documents).join(heads, "receiving_id").select(
        "receiving_id", "item_pos", "meta.name", "meta.sum", "iiko_supplier_id"
    )


@query("stored_document_meta", f"""with {REVIEW_SQL}
select a.receiving_id, a.item_pos, a.name, a.line_sum as sum,
       case when a.receiving_id % 10 <> 0 then h.iiko_supplier_id end as iiko_supplier_id
from amounts a join heads h on h.receiving_id = a.receiving_id""", needs=REVIEW_NEEDS)
def _stored_document_meta(t: Inputs):
    stored = _stored(t)
    heads = review.stored_headers(stored).select("receiving_id", "header.iiko_supplier_id")
    return review.stored_meta_lines(stored).join(heads, "receiving_id").select(
        "receiving_id", "item_pos", "meta.name", "meta.sum", "iiko_supplier_id"
    )


@query("item_meta_by_position", f"""with {REVIEW_SQL}
select receiving_id, item_pos, line_sum as sum from amounts""", needs=REVIEW_NEEDS)
def _item_meta(t: Inputs):
    items = reviews(t)[3]
    return review.with_meta(items, review.stored_meta_lines(_stored(t))).select(
        "receiving_id", "item_pos", F.col("meta.sum").alias("sum")
    )


@query("merge_technical", f"""with {REVIEW_SQL},
old as (select receiving_id, cast(line_number as varchar) as line, arg_max(struct_pack(a := article, v := vat), pos) as o
        from (select receiving_id, item_pos as pos, 1 + item_pos % 3 as line_number,
                     'OLD-' || cast(item_pos as varchar) as article, 7.5 as vat from lines) x group by 1, 2)
select a.receiving_id, a.item_pos, coalesce(a.product_article, o.o.a) as product_article,
       coalesce(a.percent, o.o.v) as vat_percent
from amounts a left join old o on o.receiving_id = a.receiving_id and o.line = cast(a.item_pos as varchar)""", needs=REVIEW_NEEDS)
def _merge_technical(t: Inputs):
    lines = reviews(t)[2]
    old = lines.select(
        "receiving_id", "item_pos", (1 + F.col("item_pos") % 3).alias("line_number"),
        F.concat(F.lit("OLD-"), F.col("item_pos").cast("string")).alias("product_article"),
        F.lit(7.5).alias("vat_percent"), F.lit(None).cast("double").alias("vat_sum"),
    )
    return review.merge_technical(lines, old).select("receiving_id", "item_pos", "product_article", "vat_percent")


@query("merge_headers", f"""with {REVIEW_SQL}
select receiving_id, coalesce(nullif(case when receiving_id % 2 = 0 then 'NEW' else '' end, ''), iiko_supplier_id) as iiko_supplier_id,
       coalesce(case when receiving_id % 5 = 0 then 9.5 end, 1.5) as total_sum
from heads""", needs=REVIEW_NEEDS)
def _merge_headers(t: Inputs):
    old = reviews(t)[1].select("receiving_id", "iiko_supplier_id", F.lit(1.5).alias("total_sum"))
    new = old.select(
        "receiving_id",
        F.when(F.col("receiving_id") % 2 == 0, "NEW").otherwise("").alias("iiko_supplier_id"),
        F.when(F.col("receiving_id") % 5 == 0, F.lit(9.5)).alias("total_sum"),
    )
    return review.merge_headers(old, new)


@query("update_reviews", f"""with {REVIEW_SQL}
select a.receiving_id, a.item_pos, a.name as item_name_from_invoice, a.quantity + 1 as received_quantity,
       case when a.name <> '' then 'accepted' else 'manual_review' end as status,
       case when a.receiving_id % 2 = 0 then 'Новый поставщик' else coalesce(h.supplier, '') end as supplier
from amounts a join heads h on h.receiving_id = a.receiving_id""", needs=REVIEW_NEEDS)
def _update_reviews(t: Inputs):
    receivings, headers, lines, _ = reviews(t)
    updates = review_requests(t).withColumns(
        {
            "supplier": F.when(F.col("receiving_id") % 2 == 0, "Новый поставщик").otherwise(F.lit(None)),
            "items": F.transform("items", lambda x: x.withField("quantity", x["quantity"] + 1)),
        }
    )
    after, _, _, items = review.update_reviews(receivings, headers, lines, updates, None)
    names = after.select(F.col("id").alias("receiving_id"), "supplier")
    return items.join(names, "receiving_id").select(
        "receiving_id", "item_pos", "item_name_from_invoice", "received_quantity", "status", "supplier"
    )


# ---------------------------------------------------------------- catalogs

def catalog(t: Inputs):
    """Catalog rows from parts, suppliers, customers and nations."""
    parts = t.part.select(
        F.lit("product").alias("kind"), F.col("p_partkey").alias("entity_pos"),
        F.concat(F.lit("P"), F.col("p_partkey")).alias("id"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("name"),
        F.concat(F.lit("num "), F.col("p_partkey")).alias("num"), F.concat(F.lit("T"), F.col("p_size") % 7).alias("taxCategory"),
    )
    suppliers = t.supplier.select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("entity_pos"),
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"),
    )
    stores = t.customer.select(
        F.lit("store").alias("kind"), F.col("c_custkey").alias("entity_pos"),
        F.concat(F.lit("C"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"),
    )
    none = F.lit(None).cast("double")
    taxes = t.region.select(
        F.lit("tax").alias("kind"), F.col("r_regionkey").cast("long").alias("entity_pos"),
        F.concat(F.lit("T"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"),
        stated_percent(F.col("r_regionkey") * 10.0, none, none).alias("vatPercent"),
    )
    return (
        conform(parts, CATALOG).unionByName(conform(suppliers, CATALOG))
        .unionByName(conform(stores, CATALOG)).unionByName(conform(taxes, CATALOG))
    )


@query("catalog_counts", """
select 'product' as kind, count(*) as n from part union all select 'supplier', count(*) from supplier
union all select 'store', count(*) from customer union all select 'tax', count(*) from region""")
def _catalog_counts(t: Inputs):
    return catalogs.catalog_counts(catalog(t))


@query("match_ordered_products", """
with names as (select distinct name from order_lines),
first_part as (select lower(p_name || ' ' || p_type) as name, min(p_partkey) as k from part group by 1)
select n.name, 'P' || cast(f.k as varchar) as value, f.name as entity_name, 1.0 as confidence, 'ready' as status,
       'сопоставлено автоматически' as reason
from names n join first_part f on f.name = n.name""", needs=("order_lines",))
def _match_ordered(t: Inputs):
    return catalogs.match_names(t.order_lines.select("name"), catalog(t), "product").select(
        "name", "value", "entity_name", "confidence", "status", "reason"
    )


def _ratio_sql(name: str, pairs: str) -> str:
    """``name(q, e, score)``: the ratio of matching blocks of every row of ``pairs(q, e)``.

    ``name_parts`` holds stretches of both texts still to be compared. Of each, the longest common block (the first
    in q, then in e) is counted, and what lies before and after it is compared in turn.
    """
    return f"""
{name}_parts as (
  select q, e, 0 as a0, length(q)::int as a1, 0 as b0, length(e)::int as b1, 0 as size from {pairs}
  union all
  select q, e, case when side = 0 then a0 else i + n end, case when side = 0 then i else a1 end,
         case when side = 0 then b0 else j + n end, case when side = 0 then j else b1 end, case when side = 0 then n else 0 end
  from (
    select q, e, a0, a1, b0, b1, max(n)::int as n, arg_max(i, (n, -i, -j))::int as i, arg_max(j, (n, -i, -j))::int as j
    from (
      select q, e, a0, a1, b0, b1, min(i) as i, min(j) as j, count(*) as n
      from (
        select *, i - row_number() over (partition by q, e, a0, b0, a1, b1, i - j order by i) as run
        from (select q, e, a0, a1, b0, b1, i, unnest(range(b0, b1)) as j
              from (select q, e, a0, a1, b0, b1, unnest(range(a0, a1)) as i from {name}_parts))
        where q[i + 1] = e[j + 1])
      group by q, e, a0, a1, b0, b1, i - j, run)
    group by q, e, a0, a1, b0, b1), (select unnest([0, 1]) as side)),
{name} as (select q, e, 2.0 * sum(size) / (length(q) + length(e)) as score from {name}_parts group by q, e)"""


def _catalog_norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g'))"


def best_match_sql(names: str, fields: str, reason: str) -> str:
    """Best of all catalog texts per name: ``names`` gives ``name``, ``fields`` gives ``pos, field, text, value, entity_name``.

    Every pair is bounded by its shared characters; the ratio is worked out for the five pairs of a name with the
    highest bounds, then for all pairs whose bound reaches the best score so found.
    """
    return f"""
names as (select distinct name from ({names})),
fields as ({fields}),
texts as (
  select e, min((pos, field)) as place, arg_min(value, (pos, field)) as value, arg_min(entity_name, (pos, field)) as entity_name
  from (select *, {_catalog_norm('text')} as e from fields) where e <> '' group by e),
asked as (select distinct {_catalog_norm('name')} as q from names),
q_letters as (select q, c, count(*) as n from (select q, unnest(string_split(q, '')) as c from asked) where c <> '' group by q, c),
e_letters as (select e, c, count(*) as n from (select e, unnest(string_split(e, '')) as c from texts) where c <> '' group by e, c),
bounds as materialized (
  select q, e, 2.0 * sum(least(a.n, b.n)) / (length(q) + length(e)) as bound
  from q_letters a join e_letters b using (c) group by q, e),
inner_ as (
  select q, e, case when q = e then 1.0 else greatest(0.75, least(length(q), length(e))::double / greatest(length(q), length(e))) end as score
  from bounds where contains(q, e) or contains(e, q)),
open_ as (select * from bounds anti join inner_ using (q, e)),
few as (select q, e from open_ qualify row_number() over (partition by q order by bound desc, e) <= 5),
{_ratio_sql('begun', 'few')},
levels as (select q, max(score) as level from (from begun union all from inner_) group by q),
rest as (select q, e from open_ join levels using (q) where bound >= level - 1e-9),
{_ratio_sql('measured', 'rest')},
best as (
  select q, arg_min(e, (-score, place)) as e, max(score) as score
  from (from measured union all from inner_) join texts using (e) where score > 0 group by q)
select n.name, case when b.score >= 0.55 then t.value end as value, t.entity_name, coalesce(round(b.score, 9), 0.0) as confidence,
       case when b.score >= 0.72 then 'ready' else 'needs_review' end as status,
       case when b.score >= 0.72 then 'сопоставлено автоматически'
            when b.score >= 0.55 then 'низкая уверенность автоматического сопоставления' else '{reason}' end as reason
from names n left join best b on b.q = {_catalog_norm('n.name')} left join texts t on t.e = b.e"""


PRODUCT_FIELDS = """
select p_partkey as pos, unnest([0, 1]) as field, unnest([p_name || ' ' || p_type, 'num ' || p_partkey]) as text,
       'P' || p_partkey as value, lower(p_name || ' ' || p_type) as entity_name from part"""
SUPPLIER_FIELDS = "select s_suppkey as pos, 0 as field, s_name as text, 'S' || s_suppkey as value, s_name as entity_name from supplier"
SUPPLIER_NAMES = "select coalesce(supplier_legal_name, '') as name from invoice_headers"


@query("match_invoice_products", f"with {best_match_sql('select name from invoice_lines', PRODUCT_FIELDS, 'товар iiko не найден')}",
       needs=("invoice_lines",), recursive=True)
def _match_invoice(t: Inputs):
    return catalogs.match_names(t.invoice_lines.select("name"), catalog(t), "product").select(
        "name", "value", "entity_name", F.round("confidence", 9).alias("confidence"), "status", "reason"
    )


@query("match_suppliers", f"with {best_match_sql(SUPPLIER_NAMES, SUPPLIER_FIELDS, 'поставщик iiko не найден')}",
       needs=("invoice_headers",), recursive=True)
def _match_suppliers(t: Inputs):
    names = t.invoice_headers.select(F.coalesce("supplier_legal_name", F.lit("")).alias("name"))
    return catalogs.match_names(names, catalog(t), "supplier").select(
        "name", "value", "entity_name", F.round("confidence", 9).alias("confidence"), "status", "reason"
    )


@query("tax_lookup", """
with first_part as (select lower(p_name || ' ' || p_type) as name, min(p_partkey) as k from part group by 1)
select o.receiving_id, o.item_pos, case when p.p_size % 7 between 1 and 4 then (p.p_size % 7) * 10.0 end as tax_percent
from order_lines o join first_part f on f.name = o.name join part p on p.p_partkey = f.k""", needs=("order_lines",))
def _tax_lookup(t: Inputs):
    cat = catalog(t)
    matches = catalogs.match_names(t.order_lines.select("name"), cat, "product").select("name", "taxCategory")
    percents = matches.join(catalogs.tax_percents(cat), "taxCategory", "left").select("name", "tax_percent")
    return catalogs.lookup(t.order_lines.select("receiving_id", "item_pos", "name"), percents, "name", "receiving_id", "item_pos").drop("name")


FILL_SQL = """
first_part as (select lower(p_name || ' ' || p_type) as name, min(p_partkey) as k from part group by 1),
lines as (
  select o.receiving_id, o.item_pos, 'P' || cast(f.k as varchar) as iiko_product_id,
         'num ' || cast(f.k as varchar) as product_article, f.name as iiko_product_name,
         case when p.p_size % 7 between 1 and 4 then (p.p_size % 7) * 10.0 end as vat_percent,
         o.quantity * o.price as total, o.quantity, o.price, r.venue, r.supplier, c.c_custkey
  from order_lines o join first_part f on f.name = o.name join part p on p.p_partkey = f.k
  join receivings r on r.id = o.receiving_id join customer c on c.c_name = r.venue)
"""


@query("fill_items_from_catalogs", f"""with {FILL_SQL}
select receiving_id, item_pos, iiko_product_id, product_article, iiko_product_name, 'шт' as amount_unit,
       'C' || cast(c_custkey as varchar) as store_id, vat_percent,
       case when vat_percent > 0 then cast(round_even(cast(cast(total * vat_percent / (100 + vat_percent) as varchar) as decimal(38,10)), 2) as double)
            when vat_percent is not null then 0 end as vat_sum,
       'ready' as mapping_status, '' as mapping_error
from lines""", needs=("order_lines", "receivings"))
def _fill_items(t: Inputs):
    heads = t.receivings.select(
        F.col("id").alias("receiving_id"), "supplier", "venue",
        *[F.lit(None).cast("string").alias(c) for c in ("iiko_supplier_id", "iiko_default_store_id", "iiko_organization")],
    )
    lines = t.order_lines.select(
        "receiving_id", "item_pos", "name", "quantity", "unit", "price",
        *[F.lit(None).cast(k).alias(c) for c, k in (
            ("sum", "double"), ("vat_percent", "double"), ("vat_sum", "double"), ("iiko_product_id", "string"),
            ("product_article", "string"), ("amount_unit", "string"), ("store_id", "string"),
        )],
    )
    cat = catalog(t)
    filled = catalogs.fill_items(lines, catalogs.fill_headers(heads, cat), cat)
    return filled.select(
        "receiving_id", "item_pos", "iiko_product_id", "product_article", "iiko_product_name", "amount_unit", "store_id",
        "vat_percent", "vat_sum", "mapping_status", "mapping_error",
    )


@query("fill_headers_from_catalogs", """
select r.id as receiving_id, 'S' || cast(s.s_suppkey as varchar) as iiko_supplier_id, coalesce(s.s_name, (select arg_min(s_name, s_suppkey) from supplier)) as iiko_supplier_name,
       'C' || cast(c.c_custkey as varchar) as iiko_default_store_id,
       case when s.s_suppkey is null then 'needs_review' else 'ready' end as iiko_mapping_status,
       case when s.s_suppkey is null then 'поставщик iiko не найден' else '' end as iiko_mapping_error
from receivings r left join supplier s on s.s_name = r.supplier join customer c on c.c_name = r.venue""", needs=("receivings",))
def _fill_headers(t: Inputs):
    unknown = F.when(F.col("supplier") == "Supplier#none", "нет такого").otherwise(F.col("supplier"))
    heads = t.receivings.select(
        F.col("id").alias("receiving_id"), unknown.alias("supplier"), "venue",
        *[F.lit(None).cast("string").alias(c) for c in ("iiko_supplier_id", "iiko_default_store_id", "iiko_organization")],
    )
    return catalogs.fill_headers(heads, catalog(t)).select(
        "receiving_id", "iiko_supplier_id", "iiko_supplier_name", "iiko_default_store_id", "iiko_mapping_status",
        "iiko_mapping_error",
    )


# ---------------------------------------------------------------- preview, XML, register

def _preview(t: Inputs, requests=None):
    requests = stored_requests(t) if requests is None else requests
    receivings, headers, lines, items = review.create_reviews(requests, None)
    documents = review_documents(t, requests)
    issues = review.review_issues(receivings, items, headers, documents, lines)
    return payloads.send_preview(receivings, items, documents, headers, lines, issues)


PREVIEW_SQL = f"""{ISSUES_SQL},
s as (select receiving_id, round_even(sum(cast(line_sum as decimal(24,6))), 2)::double as total from amounts group by receiving_id),
preview as (
select k.receiving_id, k.invoice_number, k.created_at, struct_pack(
         "review_id" := k.receiving_id, "target_system" := 'iiko',
         "target" := struct_pack("organization" := k.venue, "organizationId" := cast(null as varchar),
                                 "warehouse" := coalesce(k.iiko_default_store_id, 'Основной склад'),
                                 "defaultStoreId" := coalesce(k.iiko_default_store_id, 'Основной склад'), "venue" := k.venue),
         "supplier" := struct_pack("displayName" := coalesce(k.supplier, ''), "legalName" := k.supplier, "iikoSupplierId" := k.iiko_supplier_id),
         "invoice" := struct_pack("number" := k.invoice_number, "documentNumber" := k.invoice_number, "date" := k.invoice_date,
                                  "incomingDate" := k.invoice_date, "dueDate" := cast(null as varchar), "totalSum" := coalesce(s.total, 0.0)),
         "statusBeforeSend" := 'ocr_processed', "source" := 'incoming_invoice_adapter') as head
from heads k left join s on s.receiving_id = k.receiving_id)
"""


def total_apart(rows, name: str, path: str):
    """The total as a column of its own: engines write large numbers in different ways."""
    total = F.when(F.col(name).startswith("{"), F.get_json_object(name, path).cast("double"))
    return rows.withColumn("total_sum", total).withColumn(name, F.regexp_replace(name, '"totalSum":[^,}]*', '"totalSum":0'))


@query("send_preview", f"""with {PREVIEW_SQL}
select receiving_id, 0 as section, 0 as pos, regexp_replace(cast(to_json(head) as varchar), '"totalSum":[^,}}]*', '"totalSum":0') as fragment,
       head."invoice"."totalSum" as total_sum from preview
union all select receiving_id, 1, receiving_id, 'file_' || receiving_id, null from heads
union all select a.receiving_id, 2, a.item_pos, cast(to_json(struct_pack(
    "num" := a.item_pos, "name" := a.name, "iikoProductId" := a.iiko_product_id, "productArticle" := a.product_article,
    "supplierProduct" := cast(null as varchar), "supplierProductArticle" := cast(null as varchar),
    "amount" := a.quantity::double, "quantity" := a.quantity::double, "unit" := 'шт', "amountUnit" := 'шт',
    "price" := a.price::double, "sum" := a.line_sum::double, "vatPercent" := a.percent::double, "vatSum" := a.vat_sum::double,
    "store" := coalesce(h.iiko_default_store_id, 'Основной склад'), "status" := case when a.name <> '' and a.quantity > 0 then 'accepted' else 'manual_review' end,
    "mappingStatus" := 'ready', "mappingError" := cast(null as varchar), "comment" := COMMENT)) as varchar), null
  from amounts a join heads h on h.receiving_id = a.receiving_id
union all select receiving_id, 3, 0, message, null from issues""".replace("COMMENT", ITEM_COMMENT_SQL), needs=REVIEW_NEEDS)
def _send_preview(t: Inputs):
    rows = payloads.fragments(_preview(t)).withColumn("pos", F.when(F.col("section") == 3, 0).otherwise(F.col("pos")))
    return total_apart(rows, "fragment", "$.invoice.totalSum")


XML_ITEM_SQL = """
'    <item>' || chr(10) || '      <num>' || item_pos || '</num>' || chr(10)
|| coalesce('      <product>' || iiko_product_id || '</product>' || chr(10), '')
|| coalesce('      <productArticle>' || product_article || '</productArticle>' || chr(10), '')
|| '      <store>' || coalesce(iiko_default_store_id, 'Основной склад') || '</store>' || chr(10)
|| '      <amount>' || cast(quantity as varchar) || '</amount>' || chr(10)
|| '      <amountUnit>шт</amountUnit>' || chr(10)
|| '      <price>' || cast(price as varchar) || '</price>' || chr(10)
|| '      <sum>' || cast(cast(line_sum as double) as varchar) || '</sum>' || chr(10)
|| coalesce('      <vatPercent>' || cast(cast(percent as double) as varchar) || '</vatPercent>' || chr(10), '')
|| coalesce('      <vatSum>' || cast(cast(vat_sum as double) as varchar) || '</vatSum>' || chr(10), '') || '    </item>'
"""


XML_REST_SQL = """
  '  </items>' || chr(10) || '  <comment>отправлено после проверки в таблице</comment>' || chr(10)
  || '  <documentNumber>' || coalesce(invoice_number, cast(receiving_id as varchar)) || '</documentNumber>' || chr(10)
  || case when invoice_date <> '' then '  <dateIncoming>07.03.2024</dateIncoming>' || chr(10) else '' end
  || coalesce('  <invoice>' || invoice_number || '</invoice>' || chr(10), '')
  || '  <defaultStore>' || coalesce(iiko_default_store_id, 'Основной склад') || '</defaultStore>' || chr(10)
  || coalesce('  <supplier>' || coalesce(iiko_supplier_id, supplier) || '</supplier>' || chr(10), '')
  || case when invoice_date <> '' then '  <incomingDate>2024-03-07</incomingDate>' || chr(10) else '' end
  || '</document>'
"""


@query("invoice_xml", f"""with {REVIEW_SQL}
select receiving_id, 0 as section, 0 as pos,
       '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' || chr(10) || '<document>' || chr(10) || '  <items>' as fragment from heads
union all select a.receiving_id, 1, a.item_pos, {XML_ITEM_SQL} from amounts a join heads h on h.receiving_id = a.receiving_id
union all select receiving_id, 2, 0, {XML_REST_SQL} from heads""", needs=REVIEW_NEEDS)
def _invoice_xml(t: Inputs):
    return payloads.invoice_xml(_preview(t))


@query("review_exports", f"""with {PREVIEW_SQL}
select receiving_id, 'MVP4-' || coalesce(invoice_number, 'MANUAL-' || strftime(created_at, '%Y%m%d%H%M%S')) as request_id, 'iiko' as target_system,
       case receiving_id % 4 when 0 then 'iiko_error' when 1 then 'sent_to_iiko' else 'iiko_sent_mock' end as status,
       case when receiving_id % 4 = 0 then 'timeout' end as error_message,
       head."invoice"."totalSum" as total_sum, regexp_replace(cast(to_json(struct_pack("preview" := head,
         "userConfirmation" := struct_pack("approved" := true, "approvedBy" := 'user-' || receiving_id % 7,
             "comment" := case when receiving_id % 5 = 0 then 'исправлено' end, "confirmedAt" := '2024-03-08 10:00:00'),
         "result" := struct_pack("sent" := receiving_id % 4 = 1, "error" := case when receiving_id % 4 = 0 then 'timeout' end))) as varchar), '"totalSum":[^,}}]*', '"totalSum":0') as payload_json,
       case when receiving_id % 4 = 0 then 'accounting_error' else 'sent_to_accounting' end as status_after,
       case when receiving_id % 5 = 0 then 'исправлено' else '{COMMENT_UPLOADED}' end as comment_after
from preview""", needs=REVIEW_NEEDS)
def _review_exports(t: Inputs):
    requests = stored_requests(t)
    receivings = review.create_reviews(requests, None)[0]
    key = F.col("id").alias("receiving_id")
    outcomes = receivings.select(key, (F.col("id") % 4 == 1).alias("sent"), F.when(F.col("id") % 4 == 0, "timeout").alias("error"))
    confirmations = receivings.select(
        key, F.lit(True).alias("approved"), F.concat(F.lit("user-"), F.col("id") % 7).alias("approved_by"),
        F.when(F.col("id") % 5 == 0, "исправлено").alias("comment"), F.lit("2024-03-08 10:00:00").alias("confirmed_at"),
    )
    exports, after = payloads.review_exports(receivings, _preview(t, requests), False, outcomes, confirmations)
    after = after.select(F.col("id").alias("receiving_id"), F.col("status").alias("status_after"), F.col("comment").alias("comment_after"))
    return total_apart(exports.drop("order_number").join(after, "receiving_id"), "payload_json", "$.preview.invoice.totalSum")


@query("sync_and_send", f"""with {ISSUES_SQL},
n as (select receiving_id, count(*) as n from issues group by receiving_id),
judged as (
select k.receiving_id, k.supplier, k.receiving_id % 3 = 0 as unapproved, n.n > 0 and k.receiving_id % 2 = 0 as warned
from heads k left join n on n.receiving_id = k.receiving_id)
select receiving_id, coalesce(supplier, '') as supplier,
       case when unapproved then 'Перед отправкой пользователь должен подтвердить проверку накладной'
            when warned then 'Накладная требует проверки' end as error_message,
       case when unapproved or coalesce(warned, false) then null else 'iiko_sent_mock' end as export_status,
       case when unapproved or coalesce(warned, false) then 'ocr_processed' else 'sent_to_accounting' end as status_after
from judged""", needs=REVIEW_NEEDS)
def _sync_and_send(t: Inputs):
    requests = stored_requests(t)
    receivings, headers, lines, _ = review.create_reviews(requests, None)
    approvals = receivings.select(
        F.col("id").alias("receiving_id"), (F.col("id") % 3 != 0).alias("approved"), (F.col("id") % 2 != 0).alias("allow_with_warnings")
    )
    exports, after, blocked, _ = sync.sync_and_send(receivings, headers, lines, review_documents(t, requests), requests, approvals)
    after = after.select(F.col("id").alias("receiving_id"), "supplier", F.col("status").alias("status_after"))
    said = blocked.select("receiving_id", "error_message")
    logged = exports.select("receiving_id", F.col("status").alias("export_status"))
    return after.join(said, "receiving_id", "left").join(logged, "receiving_id", "left")


@query("document_totals", f"""with {REVIEW_SQL}
select receiving_id, round_even(sum(cast(line_sum as decimal(24,6)) + coalesce(cast(vat_sum as decimal(24,6)), 0)), 2)::double as total_sum
from amounts group by receiving_id""", needs=REVIEW_NEEDS)
def _document_totals(t: Inputs):
    _, _, lines, items = reviews(t)
    return payloads.document_totals(items, lines)


def register_rows_of(t: Inputs):
    """Register rows of the reviews; the requests are written once, as headers, lines, items and documents read them."""
    requests = stored_requests(t)
    receivings, headers, lines, items = review.create_reviews(requests, None)
    return register.build_register(receivings, items, review_documents(t, requests), headers, lines)


REGISTER_SQL = REVIEW_SQL + """,
totals as (select receiving_id, round_even(sum(cast(line_sum as decimal(24,6)) + coalesce(cast(vat_sum as decimal(24,6)), 0)), 2)::double as t
           from amounts group by receiving_id),
register as (
select a.receiving_id, a.item_pos as row_pos,
       case when a.item_pos = 1 then 'ТОРГ-12' else '' end as "Форма документа",
       case when a.item_pos = 1 then coalesce(h.invoice_number, '') else '' end as "№ Документа",
       case when a.item_pos = 1 then h.invoice_date else '' end as "Дата документа",
       case when a.item_pos = 1 then coalesce(h.supplier, '') else '' end as "Поставщик",
       case when a.item_pos = 1 then h.venue else '' end as "Торговая точка",
       case when a.item_pos = 1 then coalesce(h.iiko_default_store_id, '') else '' end as "Склад",
       a.name as "Наименование товара из документа",
       cast(a.quantity as varchar) as "Кол-во в документе",
       cast(cast(a.line_sum as double) as varchar) as "Стоимость без НДС",
       case when a.vat is not null then a.vat when a.vat_percent is not null then '18%' else '' end as "Ставка НДС",
       case when a.vat_sum is not null then '12.5' else '' end as "Сумма НДС",
       cast(round_even(cast(a.line_sum as decimal(24,6)) + coalesce(a.vat_sum, 0)::decimal(24,6), 2)::double as varchar) as "Общая стоимость",
       case when a.item_pos = 1 then cast(t.t as varchar) else '' end as "Сумма накладной",
       case when a.item_pos = 1 then strftime(h.created_at, '%Y-%m-%d %H:%M:%S') else '' end as "Время загрузки документа",
       case when a.item_pos = 1 then '1' else '' end as "ID документа"
from amounts a join heads h on h.receiving_id = a.receiving_id join totals t on t.receiving_id = a.receiving_id
union all
select receiving_id, 1, 'ТОРГ-12', coalesce(invoice_number, ''), invoice_date, coalesce(supplier, ''), venue, coalesce(iiko_default_store_id, ''),
       '', '', '', '', '', '', '0.0', strftime(created_at, '%Y-%m-%d %H:%M:%S'), '1'
from bare_heads)
"""
_SHOWN = (
    "Форма документа", "№ Документа", "Дата документа", "Поставщик", "Торговая точка", "Склад",
    "Наименование товара из документа", "Кол-во в документе", "Стоимость без НДС", "Ставка НДС", "Сумма НДС",
    "Общая стоимость", "Сумма накладной", "Время загрузки документа", "ID документа",
)


@query("invoice_register", f"with {REGISTER_SQL} select * from register", needs=REVIEW_NEEDS)
def _register(t: Inputs):
    return register_rows_of(t).select("receiving_id", "row_pos", *_SHOWN)


def _existing(t: Inputs):
    """An older register: one row per order, ids in the current or the legacy column."""
    blank = [F.lit("").alias(h) for h in REGISTER_HEADERS if h not in ("ID документа", "Корректировка")]
    return t.orders.select(
        F.col("o_orderkey").alias("receiving_id"), F.lit(1).cast("long").alias("row_pos"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("").alias("ID документа"),
        F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).otherwise("нет").alias("Корректировка"),
        *blank,
    )


@query("next_document_id", "select max(o_custkey) + 1 as next_id from orders")
def _next_id(t: Inputs):
    return register.next_document_id(_existing(t))


@query("merge_register", f"""with {REVIEW_SQL},
ids as (select receiving_id, row_number() over (order by receiving_id) + (select max(o_custkey) from orders) as n from heads)
select 0 as merged_block, a.receiving_id, a.item_pos as row_pos,
       case when a.item_pos = 1 then cast(i.n as varchar) else '' end as "ID документа"
from amounts a join ids i on i.receiving_id = a.receiving_id
union all
select 0, b.receiving_id, 1, cast(i.n as varchar) from bare_heads b join ids i on i.receiving_id = b.receiving_id
union all
select 1, o_orderkey, 1, case when o_orderkey % 2 = 0 then cast(o_custkey as varchar) else '' end from orders""", needs=REVIEW_NEEDS)
def _merge_register(t: Inputs):
    return register.merge_register(_existing(t), register_rows_of(t)).select(
        "merged_block", "receiving_id", "row_pos", "ID документа"
    )
