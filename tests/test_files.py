import io
import json
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import tickettide.functions.text
import tickettide.sources.workbooks as workbooks
from checks.xlsx import encode_workbook
from tickettide.functions.text import table_name
from tickettide.operators import align, ingest_log, profile
from tickettide.plans.loading import load_table, read_table
from tickettide.schema import DOMAINS, INGEST_LOG_SCHEMA
from tickettide.sources.landed import read_extract, read_pages, records_from_replies

cloudpickle.register_pickle_by_value(workbooks)
cloudpickle.register_pickle_by_value(tickettide.functions.text)

FREIGHT = [["2025-07-14", "Harbour Mill", "810"], ["2025-07-19", "Old Quarry", "95"], ["2025-08-02", "Tin Lantern", "2240"]]


def full_workbook() -> bytes:
    """Shared strings, dates, numbers, booleans, errors, gaps and a second sheet."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f'<workbook {main} {rel}><sheets><sheet name="B" sheetId="2" r:id="r2"/>'
                           '<sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/other.xml"/>'
                                      '<Relationship Id="r2" Target="/xl/worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>Name</t></si><si><r><t>When</t></r><r><t> &amp; how</t></r>"
                                "<rPh><t>no</t></rPh></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/>'
                         '<numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs>'
                         '<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/worksheets/other.xml": "<worksheet/>",
        "xl/worksheets/s.xml": f"""<worksheet {main}><sheetData>
            <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c></row>
            <row r="2"><c r="A2" t="str"><v>x</v></c><c r="B2" s="1"><v>45292.5</v></c><c r="C2" t="b"><v>1</v></c></row>
            <row r="3"/>
            <row r="4"><c r="B4" s="2"><v>45293</v></c><c r="C4" t="e"><v>#N/A</v></c><c r="D4" s="3"><v>1.5</v></c></row>
            </sheetData></worksheet>""",
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        for name, xml in parts.items():
            book.writestr(name, xml)
    return buffer.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "harbour_freight.xlsx").write_bytes(encode_workbook(["Ship Day", "Berth", "Crates"], FREIGHT))
    (tmp_path / "in" / "deep" / "Full.XLSX").write_bytes(full_workbook())
    (tmp_path / "in" / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0 not a zip file")
    (tmp_path / "in" / "notes.txt").write_text("no workbook")
    return str(tmp_path / "in")


def test_workbooks_are_read(spark, folder):
    rows = workbooks.read_workbooks(spark, folder)
    freight = rows.filter("path LIKE '%freight%'").orderBy("row_number").collect()
    assert [[r.cells[h] for h in ("Ship Day", "Berth", "Crates")] for r in freight] == FREIGHT
    assert len(freight[0].cells) == 3
    full = rows.filter("path LIKE '%Full%'").orderBy("row_number").collect()
    assert [r.cells for r in full] == [
        {"Name": "x", "When & how": "2024-01-01 12:00:00", "Unnamed: 2": "true", "Name.1": None},
        {"Name": None, "When & how": "2024-01-02 00:00:00", "Unnamed: 2": None, "Name.1": "1.5"},
    ]
    bad = rows.filter("error IS NOT NULL").collect()
    assert len(bad) == 1 and bad[0].path.endswith("old.xls") and "BadZipFile" in bad[0].error


def test_long_sheets_come_in_batches(spark, monkeypatch):
    monkeypatch.setattr(workbooks, "BATCH_ROWS", 7)
    book = encode_workbook(["n"], ([str(i)] for i in range(50)))
    got = list(workbooks._decode_file("p", book))
    assert [b.num_rows for b in got] == [7] * 7 + [1]
    assert [dict(c)["n"] for b in got for c in b.column(2).to_pylist()] == [str(i) for i in range(50)]


def test_column_types(spark, folder):
    freight = workbooks.read_workbooks(spark, folder)
    kinds = {r.name: r.type for r in workbooks.column_types(freight).collect()}
    assert kinds == {
        "Ship Day": "timestamp_ntz", "Berth": "string", "Crates": "bigint", "Name": "string",
        "When & how": "timestamp_ntz", "Unnamed: 2": "boolean", "Name.1": "double"}
    typed = workbooks.typed_rows(freight, kinds)
    assert typed.agg({"Crates": "sum"}).first()[0] == 3145 and typed.count() == 5
    assert workbooks.typed_rows(freight, {"no such header": "string"}).first()["no such header"] is None


def test_from_workbook_to_table(spark, folder, tmp_path):
    rows = workbooks.read_workbooks(spark, folder, clean=True).filter("path LIKE '%freight%'")
    typed = workbooks.typed_rows(rows, {"ship_day": "date", "berth": "string", "crates": "bigint"})
    name = typed.select(table_name(typed.path)).first()[0]
    assert name == "harbour_freight"
    assert load_table(typed.drop("path", "row_number"), str(tmp_path / name)) == 3
    back = read_table(spark, str(tmp_path / name))
    assert back.count() == 3 and back.agg({"crates": "sum"}).first()[0] == 3145


def test_headers_alike_are_the_file_s_own_error(spark):
    books = spark.createDataFrame(
        [("bad", encode_workbook(["Name", " name\n"], [["a", "b"]])), ("good", encode_workbook([" Full Name\n", "B"], [["c", "d"]]))],
        "path string, content binary")
    rows = {r.path: r for r in workbooks.decode_workbooks(books, clean=True).collect()}
    assert "alike after cleaning: name" in rows["bad"].error and rows["good"].cells == {"full_name": "c", "b": "d"}
    assert align.clean_columns(spark.createDataFrame([(1,)], [" Full Name\n"])).columns == ["full_name"]


def test_rows_are_dropped_as_they_pass(monkeypatch):
    from xml.etree import ElementTree

    book = encode_workbook(["n"], ([str(i)] for i in range(20_000)))
    sizes = []
    plain = ElementTree.iterparse

    def watched(*args, **kwargs):
        for event, element in plain(*args, **kwargs):
            if element.tag.endswith("sheetData"):
                watched.data = element
            if event == "end" and element.tag.endswith("row"):
                sizes.append(len(watched.data))
            yield event, element

    monkeypatch.setattr(workbooks.ElementTree, "iterparse", watched)
    assert sum(1 for _ in workbooks._sheet_rows(book)) == 20_000 and max(sizes) < 2000  # the parser reads ahead by a block


def test_load_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda: read_table(spark, path)
    rows = spark.createDataFrame([(1, 3), (2, 4)], "a bigint, b bigint")
    assert table() is None
    assert load_table(rows, path) == 2
    assert load_table(rows, path, "append") == 2
    assert table().count() == 4
    other = spark.createDataFrame([("x", 9)], "c string, b int")
    assert load_table(other, path) == 1
    assert sorted(map(tuple, table().filter("b = 9").collect())) == [(None, 9)]
    assert table().columns == ["a", "b"]
    open_ = table()
    assert load_table(other, path, "replace") == 1
    assert table().columns == ["c", "b"] and table().count() == 1
    assert open_.count() == 5  # who reads the old table still can
    broken = other.withColumn("b", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        load_table(broken, path, "replace")
    assert table().count() == 1
    assert load_table(other, path) == 1 and table().count() == 2
    with pytest.raises(FileExistsError):
        load_table(rows, path, "fail")
    with pytest.raises(ValueError):
        load_table(rows, path, "guess")


def test_clean_columns(spark):
    rows = spark.createDataFrame([(1, 2, 3)], ["  First Name ", "Amount $", "Region"])
    assert align.clean_columns(rows).columns == ["first_name", "amount_$", "region"]
    with pytest.raises(ValueError, match="first_name"):
        align.clean_columns(spark.createDataFrame([(1, 2)], ["First Name", "first_name"]))


def test_evolve_union(spark):
    older = spark.createDataFrame([(1,)], "a int")
    newer = spark.createDataFrame([(2, 5, "x")], "a int, b int, c string")
    got = sorted(map(tuple, align.evolve_union(older, newer, {"b": 0}).collect()))
    assert got == [(1, 0, None), (2, 5, "x")]


def log_of(spark, *rows):
    return spark.createDataFrame(list(rows), INGEST_LOG_SCHEMA)


def test_ingest_log(spark):
    load = "filename string, received_at string, target_table string, rows_loaded long"
    first = spark.createDataFrame([("tides.xlsx", "2025-05-04 07:15:00", "tides", 12)] * 2, load)
    log = ingest_log.record_ingest(first, log_of(spark), "2025-05-09 18:00:00")
    assert [tuple(r) for r in log.collect()] == [
        ("tides.xlsx", "2025-05-04 07:15:00", "tides", 12, "2025-05-09 18:00:00")]
    later = spark.createDataFrame([("tides.xlsx", "2025-05-04 07:15:00", "tides", 31),
                                   ("tides.xlsx", "2025-05-06 07:15:00", "tides", 4)], load)
    assert ingest_log.already_ingested(later, log).count() == 1
    assert ingest_log.not_yet_ingested(later, log).first().rows_loaded == 4
    after = ingest_log.record_ingest(later, log)
    assert sorted((r.received_at[:10], r.rows_loaded) for r in after.collect()) == [("2025-05-04", 12), ("2025-05-06", 4)]
    assert ingest_log.record_ingest(later, after).count() == 2


def test_reply_pages(spark, tmp_path):
    for page, numbers in enumerate(([1, 2], [3])):
        records = [{"sys_id": str(n), "number": f"INC000{n}", "priority": {"display_value": "Critical", "value": "1"},
                    "unknown": n} for n in numbers]
        (tmp_path / f"page{page}.json").write_text(json.dumps({"result": records}, indent=1))
    (tmp_path / "page9.json").write_text('{"result": []}')
    got = read_pages(spark, str(tmp_path), DOMAINS["incident"])
    assert got.columns == [*DOMAINS["incident"].fields, "raw_payload"]
    assert json.loads(got.filter("sys_id = '3'").first().raw_payload)["unknown"] == 3
    assert sorted((r.sys_id, r.number, r.priority) for r in got.collect()) == [
        (str(n), f"INC000{n}", "1") for n in (1, 2, 3)]
    shown = read_pages(spark, str(tmp_path), DOMAINS["incident"], "display_value")
    assert {r.priority for r in shown.collect()} == {"Critical"}
    replies = spark.createDataFrame([((tmp_path / "page0.json").read_text(),)], "reply string")
    assert records_from_replies(replies, "reply", DOMAINS["incident"]).count() == 2


def test_landed_extracts_may_lack_fields(spark, tmp_path):
    spark.createDataFrame([("1", "x")], "sys_id string, extra string").write.json(str(tmp_path / "e"))
    row = read_extract(spark, str(tmp_path / "e"), DOMAINS["problem"], "json").first()
    assert row.sys_id == "1" and row.known_error is None


def test_object_profile(spark):
    demo = spark.createDataFrame([(1, "a")], "id int, name string")
    assert [tuple(r) for r in profile.object_profile({"demo": demo}).collect()] == [("demo", "table", "id, name", 1)]
    demo.createOrReplaceTempView("zz_demo")
    demo.write.mode("overwrite").saveAsTable("zz_saved")
    assert [tuple(r) for r in profile.catalog_profile(spark, "zz_*").collect()] == [
        ("zz_demo", "view", "id, name", 1), ("zz_saved", "table", "id, name", 1)]
    spark.sql("DROP TABLE zz_saved")
    assert profile.catalog_profile(spark, "no such*").count() == 0
    assert profile.preview(spark.range(500)).count() == 100


def test_a_record_is_parsed_once(spark):
    record = {"sys_id": "1", "state": {"display_value": "New", "value": "1"}, "priority": {"link": "l", "value": "p"}, "category": {"value": None},
              "number": 7, "caller_id": '{"value": "text"}', "urgency": {"other": [1, "x"]}, "impact": True, "extra": 1}
    replies = spark.createDataFrame([(json.dumps({"result": [record, "no record", 5]}),), ("no reply",), (None,)], "reply string")
    rows = records_from_replies(replies, "reply", DOMAINS["incident"])
    first, *others = rows.collect()
    assert (first.sys_id, first.state, first.priority, first.category, first.number, first.caller_id, first.urgency, first.impact, first.opened_at) == (
        "1", "1", "p", None, "7", '{"value": "text"}', '{"other":[1,"x"]}', "true", None)
    assert all(r.sys_id is None for r in others)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parsejson") + plan.count("parse_json") + plan.count("parseJson") == 1
