"""Document texts to headers and items, on small texts of our own."""

import pytest

from goodsledger.operators.extract import parse_documents, route_useful

BLOCK = """
Сумма с учетом НДС руб. коп.
1 Мука ржаная
шт
166
3
40,00
120,00
10
12,00
132,00
Товарная накладная имеет приложение на
"""
INLINE = """
ООО Заря
Накладная №А-55 от 04.05.2024
Гречка ядрица 4 кг 80 320
"""
RECEIPT = """
ТОВАРНЫЙ ЧЕК
КАССИР ПЕТРОВА
1 ТОВАР : ШТ. [M+]1234 БАТОН НАРЕЗНОЙ
ЦЕНА : 35.50
КОЛ-ВО: 2
СУММА : 71.00
2 ТОВАР : ШТ. ПАКЕТ
ЦЕНА : 5.00 кол-во: 1
СУММА : 5.00
БАНКОВСКИЕ ОПЛАТЫ
05.06.24 10:00
ИТОГО =76.00
"""
TRANSFER = """
Универсальный передаточный документ
Приложение № 1 к постановлению от 26 декабря 2011 г. № 1137
Счет-фактура No
ФР-20177
от
7 июля 2024 г.
Продавец:
ООО "Сад"
ИНН/КПП продавца
7701234567/770101001
Покупатель:
ООО "Кафе"
Код товара/ работ, услуг
214279
1
Яблоки сезонные
2
2a
166 кг
12,500
100,00
1 250,00
без акциза
10%
125,00
1 375,00
Всего к оплате (9)
Руководитель организации
Основание передачи (сдачи) / получения (приемки)
Договор поставки 12
Товар (груз) получил
"""
SECOND_PAGE = """
Страница
2
наименование, характеристика товара
3 Сыр мягкий
KT
166
2,000
500,00
1 000,00
7%
70,00
1 070,00
Итого
9 000,00
630,00
9 630,00
Товарная накладная имеет приложение на
Всего отпущено на сумму
Груз получил грузополучатель
ООО "Кафе", ИНН 7700000001
"""
HEADER = """
Поставщик ООО "Заря"
Грузополучатель ООО "Кафе"
Склад / подразделение: Холодный цех
Номер документа 845
Дата составления 23.08.2024
"""
PROSE = "без накладной\nпросто текст"


@pytest.fixture(scope="module")
def parsed(spark):
    texts = dict(block=BLOCK, inline=INLINE, receipt=RECEIPT, transfer=TRANSFER, second=SECOND_PAGE, header=HEADER, prose=PROSE)
    df = spark.createDataFrame(list(texts.items()), "doc string, text string")
    return {r.doc: r for r in route_useful(parse_documents(df)).collect()}


def items(row):
    return [(i["name"], i.quantity, i.unit, i.price, i["sum"], i.vat, i.vat_sum) for i in row["items"]]


def test_block_rows(parsed):
    assert items(parsed["block"]) == [("Мука ржаная", 3.0, "шт", 40.0, 120.0, "10%", 12.0)]


def test_inline_row_and_header(parsed):
    row = parsed["inline"]
    assert items(row) == [("Гречка ядрица", 4.0, "кг", 80.0, 320.0, None, None)]
    # the text between the document word and the first digit is skipped, letters included
    assert (row.supplier, row.invoice_number, row.invoice_date) == ("ООО Заря", "55", "2024-05-04")
    assert row.total_sum == 320.0 and row.document_form == "Накладная"


def test_receipt(parsed):
    row = parsed["receipt"]
    assert items(row) == [("БАТОН НАРЕЗНОЙ", 2.0, "шт", 35.5, 71.0, None, None), ("ПАКЕТ", 1.0, "шт", 5.0, 5.0, None, None)]
    assert row.total_sum == 76.0 and row.invoice_date == "2024-06-05"


def test_transfer_document(parsed):
    row = parsed["transfer"]
    assert items(row) == [("Яблоки сезонные", 12.5, "кг", 100.0, 1250.0, "10%", 125.0)]
    assert (row.supplier, row.supplier_inn) == ('ООО "Сад"', "7701234567")
    assert (row.invoice_number, row.invoice_date) == ("ФР-20177", "2024-07-07")
    assert row.basis == "Договор поставки 12" and row.venue == 'ООО "Кафе"' and row.total_sum == 1375.0


def test_continuation_page_has_no_header(parsed):
    row = parsed["second"]
    assert (row.supplier, row.invoice_number, row.invoice_date, row.supplier_inn, row.consignee) == (None,) * 5
    assert row.total_sum == 9630.0
    assert items(row) == [("Сыр мягкий", 2.0, "кг", 500.0, 1000.0, "7%", 70.0)]


def test_explicit_header_fields(parsed):
    row = parsed["header"]
    assert row.venue == 'ООО "Кафе"' and row.display_store == "Холодный цех"
    assert row.invoice_number == "845" and row.invoice_date == "2024-08-23"


def test_texts_without_data_go_to_manual_review(parsed):
    assert parsed["prose"]["items"] == [] and parsed["prose"].invoice_number is None
    assert parsed["prose"].parser_provider == "manual_review_empty_sheet" and len(parsed["prose"].parser_notes) == 2
    assert parsed["inline"].parser_provider == "deterministic_parser"


def test_the_query_returns_every_field_and_the_items(spark, tmp_path):
    from goodsledger.operators.extract import HEADER_COLUMNS
    from goodsledger.plans.catalogue import queries

    spark.createDataFrame([(1, INLINE), (2, PROSE)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries()["parse_documents"](spark, str(tmp_path)).collect()}
    assert {*HEADER_COLUMNS, "items", "n_items", "parser_notes", "parser_provider", "raw_text"} < set(rows[1].asDict())
    assert items(rows[1]) == [("Гречка ядрица", 4.0, "кг", 80.0, 320.0, None, None)] and rows[1].n_items == 1
    assert rows[2]["items"] == [] and rows[2].raw_text == PROSE
