"""Register files, catalogs and the intake stream."""

import json

import pytest
from pyspark.sql import functions as F

from goodsledger.operators.catalog import match_names
from goodsledger.operators.register import number_documents, write_register
from goodsledger.schemas import REGISTER_HEADERS
from goodsledger.sources.catalogs import read_catalog
from goodsledger.sources.registers import (
    WIDTHS,
    cells,
    read_files,
    read_legacy_items,
    read_register,
    read_summary_blocks,
    register_rows,
    register_to_header,
    register_to_items,
    with_records,
)
from goodsledger.streaming.intake import intake_issues, intake_stream, write_intake

REGISTER = (
    "﻿Реестр\r\r\n\r\r\nНакладные\r\r\n"
    "Загрузка,Дата документа,№ Документа,Поставщик,Торговая точка,Наименование товара,Ед.изм.,Количество,Цена,Стоимость без НДС,Сумма НДС,Общая стоимость\r\r\n"
    ',2024-01-02,77,"ООО ""Сад"", Тверь",Кафе,"Сок, 1 л",шт,2,"50,5",,20,121\r\r\n'
    ",,,,,,,,,,,\r\r\n"
    "Нет,,,,,Вода,шт,1,10,10,,10\r\r\n"
    ",,,,,Чай,,3,10,30,,30\r\r\n"
)
SUMMARY = (
    "Проверка накладной 5\n\nНакладная\nПоле,Значение\nПоставщик,ООО Заря\nНомер накладной,5\n\nТоварные позиции\n"
    "№,Статус проверки,Что исправить,Наименование товара,Количество,Ед. изм.,Цена,Сумма,НДС %,НДС сумма,Комментарий пользователя\n"
    "4,Готово,,Мука,2,кг,30,60,10,6,ок\n"
)


def test_register_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text(REGISTER, encoding="utf-8", newline="")
    rows = read_register(spark, str(tmp_path))
    got = [(r.line_number, r.name, r.quantity, r.unit, r.price, r["sum"]) for r in register_to_items(rows).orderBy("line_number").collect()]
    assert got == [(1, "Сок, 1 л", 2.0, "шт", 50.5, 101.0), (4, "Чай", 3.0, "шт", 10.0, 30.0)]
    head = register_to_header(rows).collect()[0]
    assert (head.supplier, head.invoice_number, head.venue, head.warehouse) == ('ООО "Сад", Тверь', "77", "Кафе", "Основной склад")


def test_summary_and_legacy_items(spark, tmp_path):
    (tmp_path / "b.csv").write_text(SUMMARY, encoding="utf-8")
    files = read_files(spark, str(tmp_path))
    assert {r.field: r.value for r in read_summary_blocks(files).collect()} == {"Поставщик": "ООО Заря", "Номер накладной": "5"}
    item = read_legacy_items(files).collect()[0]
    assert (item.line_number, item.name, item.quantity, item["sum"], item.vat, item.comment) == (4, "Мука", 2.0, 60.0, "10%", "ок")


def test_catalog_reader(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"items": [{"id": "1", "displayName": "А"}, {"id": "2", "name": "Б", "vatPercent": 10}]}, ensure_ascii=False), encoding="utf-8")
    rows = read_catalog(spark, str(tmp_path / "c.json"), "tax").orderBy("entity_pos").collect()
    assert [(r.kind, r.id, r.name, r.vatPercent) for r in rows] == [("tax", "1", "А", None), ("tax", "2", "Б", 10.0)]
    (tmp_path / "d.xml").write_text("<list><item><id>9</id><name>Склад</name></item><item><x>1</x></item></list>", encoding="utf-8")
    xml = read_catalog(spark, str(tmp_path / "d.xml"), "store", fmt="xml").collect()
    assert [(r.id, r.name) for r in xml] == [("9", "Склад")]


def test_catalog_of_several_files(spark, tmp_path):
    folder = tmp_path / "several"
    folder.mkdir()
    for name, rows in (("b.json", [{"id": "3", "name": "молоко"}, {"id": "4", "name": "соль"}]), ("a.json", [{"id": "1", "name": "чай"}, {"id": "2", "name": "хлеб"}])):
        (folder / name).write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    rows = read_catalog(spark, str(folder), "product").orderBy("entity_pos").collect()
    assert [r.id for r in rows] == ["1", "2", "3", "4"]
    assert len({r.entity_pos for r in rows}) == 4
    named = match_names(spark.createDataFrame([("молоко",), ("хлеб",)], "name string"), read_catalog(spark, str(folder), "product"), "product")
    assert {(r.name, r.entity_name) for r in named.collect()} == {("молоко", "молоко"), ("хлеб", "хлеб")}


def test_zero_percent_counts_as_stated_only_under_the_last_key(spark, tmp_path):
    taxes = [{"id": "1", "vatPercent": 0, "percent": 10}, {"id": "2", "vatPercent": 0}, {"id": "3", "taxPercent": 0}, {"id": "4", "percent": 5}]
    (tmp_path / "tax.json").write_text(json.dumps(taxes), encoding="utf-8")
    rows = read_catalog(spark, str(tmp_path / "tax.json"), "tax").orderBy("entity_pos").collect()
    assert [r.vatPercent for r in rows] == [10.0, None, 0.0, 5.0]


def test_intake_stream_takes_every_file_once(spark, tmp_path):
    source, target, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    source.mkdir()
    (source / "a.csv").write_text(REGISTER, encoding="utf-8", newline="")
    intake_stream(spark, str(source), str(target), str(mark)).awaitTermination()
    (source / "b.csv").write_text(SUMMARY, encoding="utf-8")
    intake_stream(spark, str(source), str(target), str(mark)).awaitTermination()
    intake_stream(spark, str(source), str(target), str(mark)).awaitTermination()
    items = spark.read.parquet(str(target / "items"))
    assert sorted(r.name for r in items.collect()) == ["Мука", "Сок, 1 л", "Чай"]
    assert spark.read.parquet(str(target / "headers")).count() == 2
    issues = spark.read.parquet(str(target / "issues")).collect()
    assert len({(r.file, r.message) for r in issues}) == len(issues) > 0
    assert any("сумм" in r.message.lower() or "iiko" in r.message.lower() for r in issues)
    # a batch that is repeated after a failure replaces its own output
    folders = {n: str(target / n / "batch=0") for n in ("headers", "items", "issues")}
    again = intake_issues(spark.read.parquet(folders["headers"]), spark.read.parquet(folders["items"]))
    again.write.mode("overwrite").parquet(folders["issues"])
    assert spark.read.parquet(str(target / "issues")).count() == len(issues)


def test_documents_are_numbered_in_order_however_sparse_their_ids(spark):
    ids = [5, 7, 10**9, 10**12, 3 * 10**15, 4 * 10**15]
    blank = {h: "" for h in REGISTER_HEADERS}
    new = spark.createDataFrame([{**blank, "receiving_id": i, "row_pos": p} for i in ids for p in (1, 2)])
    old = spark.createDataFrame([{**blank, "receiving_id": 1, "row_pos": 1, "ID документа": "41", "Корректировка": "нет"}])
    rows = number_documents(new, old).orderBy("receiving_id", "row_pos").collect()
    assert [(r.document_id, r["ID документа"]) for r in rows] == [
        (42 + n, str(42 + n) if p == 1 else "") for n in range(len(ids)) for p in (1, 2)
    ]


def test_register_files_keep_documents_together(spark, tmp_path):
    blank = {h: "" for h in REGISTER_HEADERS}
    rows = spark.createDataFrame([{**blank, "receiving_id": i, "row_pos": p, REGISTER_HEADERS[0]: f"{i}-{p}"} for i in range(20) for p in (2, 1)])
    write_register(rows, str(tmp_path / "register"), folders=4)
    files = sorted((tmp_path / "register").glob("folder=*/*.csv"))
    seen = [[line.split(",")[0] for line in f.read_text(encoding="utf-8").splitlines()[1:]] for f in files]
    assert len({f.parent for f in files}) <= 4
    assert sorted(i for ids in seen for i in set(ids)) == sorted(str(i) for i in range(20))
    assert all(ids[k : k + 2] == [ids[k]] * 2 for ids in seen for k in range(0, len(ids), 2))


def test_cells_of_records(spark):
    wide = [str(n) for n in range(WIDTHS[1] + 5)]
    cases = {
        "a,b,c": ["a", "b", "c"], "": [""], "a,": ["a", ""], ",,": ["", "", ""], '"x, ""y""",,z': ["x, \"y\"", "", "z"], '"",1': ["", "1"],
        '"open,1': ["open,1"], " p , q ": [" p ", " q "], '"l1\nl2",2': ["l1\nl2", "2"], ",".join(wide): wide,
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "record string")
    got = {r.record: r.found for r in rows.select("record", cells(F.col("record")).alias("found")).collect()}
    assert got == cases | {None: None}
    over = spark.createDataFrame([("," * WIDTHS[-1],)], "record string")
    with pytest.raises(Exception, match="more than"):
        over.select(cells(F.col("record"))).collect()


def test_last_column_of_a_name_counts(spark):
    text = "№ Документа,Наименование товара,Цена,Цена\n7,Чай,1,2\n,Соль,3\n"
    rows = register_to_items(register_rows(with_records(spark.createDataFrame([("f", text)], "file string, text string"))))
    assert [(r.name, r.price) for r in rows.orderBy("line_number").collect()] == [("Чай", 2.0), ("Соль", 0.0)]


def test_catalog_by_lines_is_split_and_keeps_its_order(spark, tmp_path):
    entities = [json.dumps({"id": str(n), "name": f"товар {n}"}, ensure_ascii=False) for n in range(500)]
    (tmp_path / "a.json").write_text("[\n" + ",\n".join(entities[:300]) + "\n]\n", encoding="utf-8")
    (tmp_path / "b.json").write_text('{"items": [\n' + "\n".join(entities[300:]) + '\n{"id": broken}\n\n]}\n', encoding="utf-8")
    (tmp_path / "c.json").write_text("", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        found = read_catalog(spark, str(tmp_path), "product", "lines")
        rows = found.orderBy("entity_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.id for r in rows] == [str(n) for n in range(500)]
    assert len({r.entity_pos for r in rows}) == 500


def test_landed_intake_repeats_a_batch_without_doubles(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("landed", "out", "mark"))
    first = spark.createDataFrame([("a", REGISTER), ("none", ""), ("null", None)], "file string, text string")
    first.write.mode("append").parquet(source)
    intake_stream(spark, source, target, mark, landed=True).awaitTermination()
    spark.createDataFrame([("b", SUMMARY)], "file string, text string").write.mode("append").parquet(source)
    intake_stream(spark, source, target, mark, landed=True).awaitTermination()
    write_intake(first, 0, target)
    items = spark.read.parquet(f"{target}/items").collect()
    assert sorted((r.batch, r.file, r.name) for r in items) == [(0, "a", "Сок, 1 л"), (0, "a", "Чай"), (1, "b", "Мука")]
    rejects = spark.read.parquet(f"{target}/rejects").collect()
    assert sorted(r.file for r in rejects) == ["none", "null"]
