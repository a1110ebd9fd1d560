from __future__ import annotations

import re
import zipfile

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import types as T

from rowgauge.operators import schema
from rowgauge.sources import quarantine, readers, workbooks, writers
from rowgauge.sources.workbooks import PARTITION_BYTES, SheetsReader, register_xlsx
from workload.workbook_fixture import workbook

TYPES = T.StructType().add("id", T.IntegerType()).add("name", T.StringType()).add(
    "day", T.DateType()
)


def test_csv_is_text_and_empty_is_null(spark, tmp_path):
    path = tmp_path / "People.CSV"
    path.write_text('id,name,day\n1,"Doe, J",2024-01-02\n2,"",\n3\n')
    frame = readers.read_table(spark, str(path))
    assert {t for _, t in frame.dtypes} == {"string"}
    assert [tuple(r) for r in frame.collect()] == [
        ("1", "Doe, J", "2024-01-02"), ("2", None, None), ("3", None, None)
    ]


def test_format_overrules_extension_and_options_pass(spark, tmp_path):
    path = tmp_path / "people.txt"
    path.write_text("id;name\n1;a\n")
    frame = readers.read_table(spark, str(path), format="csv", delimiter=";")
    assert [tuple(r) for r in frame.collect()] == [("1", "a")]
    with pytest.raises(ValueError, match="Unsupported file format"):
        readers.read_table(spark, str(path))


def test_missing_file(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_table(spark, str(tmp_path / "none.csv"))


def test_directory_skips_what_it_cannot_read(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "written"))
    part = next(p for p in (tmp_path / "written").glob("*.parquet"))
    (tmp_path / "good.parquet").write_bytes(part.read_bytes())
    (tmp_path / "bad.parquet").write_text("no parquet")
    (tmp_path / "note.txt").write_text("x")
    found = readers.read_directory(spark, str(tmp_path), "*.parquet")
    assert list(found.tables) == ["good.parquet"]
    assert list(found.failures) == ["bad.parquet"]



def test_directory_takes_a_folder_of_parts_for_one_table(spark, tmp_path):
    spark.range(7).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    part = next(p for p in (tmp_path / "many.parquet").glob("*.parquet"))
    (tmp_path / "one.parquet").write_bytes(part.read_bytes())
    spark.range(2).write.parquet(str(tmp_path / "_hidden.parquet"))
    (tmp_path / "empty.parquet").mkdir()
    found = readers.read_directory(spark, str(tmp_path), "*.parquet")
    assert sorted(found.tables) == ["many.parquet", "one.parquet"] and list(found.failures) == ["empty.parquet"]
    assert found.tables["many.parquet"].count() == 7
    whole = readers.Catalog({"all": readers.TableSpec(str(tmp_path), pattern="m*.parquet", rows_expected=7)})
    assert [r.is_valid for r in whole.expectations(spark).collect()] == [True, True, True]

def test_catalog(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("z\n1\n")
    catalog = readers.Catalog(
        {
            "one": readers.TableSpec(str(tmp_path / "a.csv"), rows_expected=2, columns=2),
            "many": readers.TableSpec(str(tmp_path), pattern="*.csv"),
        }
    )
    assert catalog.load(spark, "one").columns == ["x", "y"]
    assert sorted(catalog.load(spark, "many").tables) == ["a.csv", "b.csv"]
    found = [(r.check, r.actual, r.is_valid) for r in catalog.expectations(spark).collect()]
    # Of a directory, the rows of all files, the columns that any of them has, and the files.
    assert found == [
        ("rows", 1, False), ("columns", 2, True), ("rows", 2, True), ("columns", 3, True), ("tables", 2, True)
    ]
    with pytest.raises(ValueError, match="Unknown dataset"):
        catalog.load(spark, "none")


def test_save_respects_mode(spark, tmp_path):
    path = str(tmp_path / "deep" / "out.parquet")
    writers.save_table(spark.range(7), path)
    writers.save_table(spark.range(3), path, mode="append")
    writers.save_table(spark.range(9), path, mode="ignore")
    assert writers.saved_rows(spark, path) == 10
    with pytest.raises(AnalysisException):
        writers.save_table(spark.range(1), path, mode="error")
    with pytest.raises(ValueError):
        writers.save_table(spark.range(1), path, format="xml")


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert writers.scratch_path(spark, "x").startswith(shared)


def test_quarantine(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("id,name,day\n1,a,2024-01-02\nx,b,2024-02-30\n3,c\n4,d,2024-01-02,more\n5,,\n")
    raw = quarantine.read_csv_with_rejects(spark, str(path), TYPES)
    good, bad = quarantine.quarantine(raw, TYPES, "people", "2024-05-06 07:08:09")
    assert [r.id for r in good.orderBy("id").collect()] == [1, 5]
    assert good.schema == TYPES
    found = {r.record: (r.error_type, r.error_message) for r in bad.collect()}
    assert found == {
        '{"id":"x","name":"b","day":"2024-02-30"}': ("TYPE_ERROR", "Invalid type: id, day"),
        "3,c": ("MALFORMED_ROW", "Line does not fit the columns"),
        "4,d,2024-01-02,more": ("MALFORMED_ROW", "Line does not fit the columns"),
    }
    summary = {r.error_type: r["count"] for r in quarantine.quarantine_summary(bad).collect()}
    assert summary == {"TYPE_ERROR": 1, "MALFORMED_ROW": 2}
    assert quarantine.save_rejects(bad, str(tmp_path / "bad"))
    assert writers.saved_rows(spark, str(tmp_path / "bad"), "json") == 3
    assert not quarantine.save_rejects(bad.filter("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_malformed_json_lines(spark, tmp_path):
    path = tmp_path / "people.json"
    path.write_text('{"id": 1, "name": "a", "day": "2024-01-02"}\n{"id": \n')
    raw = quarantine.read_json_with_rejects(spark, str(path), TYPES)
    good, bad = quarantine.quarantine(raw, TYPES, "people")
    assert good.count() == 1
    assert [r.record for r in bad.collect()] == ['{"id": ']


def test_recorded_by_the_caller(spark):
    rows = spark.createDataFrame([(1, "invalid")], "id int, value string")
    bad = quarantine.record_malformed(rows, "test", "TYPE_ERROR", "Invalid type")
    assert [(r.error_type, r.record) for r in bad.collect()] == [
        ("TYPE_ERROR", '{"id":1,"value":"invalid"}')
    ]


def test_workbooks(spark, tmp_path):
    header = ["id", "name", "note"]
    (tmp_path / "a.xlsx").write_bytes(workbook([[1, "x & y", None], [2.5, "x & y", "z"]], header))
    (tmp_path / "b.xlsx").write_bytes(workbook([["n", 3]], ["name", "id"]))
    frame = readers.read_table(spark, str(tmp_path), format="xlsx")
    assert frame.columns == header
    assert sorted(tuple(r) for r in frame.collect()) == sorted(
        [("1", "x & y", None), ("2.5", "x & y", "z"), ("3", "n", None)], key=str
    )
    one = readers.read_table(spark, str(tmp_path / "a.xlsx"))
    assert one.count() == 2


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (None, "string"), ("", "string"), ("NaN", "string"), ("None", "string"), ("12", "int"),
        (" -7 ", "int"), ("1", "int"), ("0", "int"), ("1_000", "string"), ("1e5", "float"),
        (".5", "float"), ("5.", "float"), ("inf", "float"), ("1.5d", "string"), ("TRUE", "bool"),
        ("off", "bool"), ("2024-02-29", "date"), ("2023-02-29", "string"), ("2024/01/31", "date"),
        ("01/31/2024", "date"), ("31-01-2024", "date"), ("2024-01-31 10:20:30", "timestamp"),
        ("2024-01-31T10:20:30", "timestamp"), ("2024-01-31T25:20:30", "string"), ("word", "string"),
    ],
)
def test_value_types(spark, text, kind):
    frame = spark.createDataFrame([(text,)], "v string")
    assert schema.infer_value_types(frame, "v").first().value_type == kind


def test_column_types_and_policies(spark):
    frame = spark.createDataFrame(
        [("1", "1", "3000000000", "yes", "2024-01-01", None),
         ("2.5", "word", "1", "no", "2024-01-01 00:00:00", ""),
         ("3.5", "word", "2", "on", "2024-01-02", None)],
        "num string, vote string, big string, flag string, day string, none string",
    )

    def types(policy):
        return {r.column_name: r.inferred_type for r in schema.infer_column_types(frame, policy=policy).collect()}

    assert types("majority") == {
        "num": "float", "vote": "int", "big": "long", "flag": "bool", "day": "date", "none": "string"
    }
    assert types("strict") == {
        "num": "float", "vote": "string", "big": "long", "flag": "bool", "day": "timestamp",
        "none": "string",
    }
    typed = schema.apply_schema(frame, schema.infer_schema(frame))
    assert dict(typed.dtypes)["big"] == "bigint"
    assert [r.vote for r in typed.collect()] == [1, None, None]


def test_type_checks_of_typed_columns(spark):
    frame = spark.createDataFrame([(1, 2.5, True, "x"), (None, None, None, None)],
                                  "i int, f double, b boolean, s string")
    found = schema.type_check(frame, {"i": "float", "f": "int", "b": "int", "s": "int"}).collect()
    assert [(r.i_valid, r.f_valid, r.b_valid, r.s_valid) for r in found] == [
        (True, False, True, False), (True, True, True, True)
    ]


def sheets(*books: tuple[str, list[list]]) -> bytes:
    """A workbook of several sheets, listed in the order given but stored in another, with references."""
    import io
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        listed, targets = "", ""
        for k, (name, rows) in enumerate(books):
            number = len(books) - k
            listed += f'<sheet name="{name}" sheetId="{k + 1}" r:id="r{k}"/>'
            targets += f'<Relationship Id="r{k}" Target="worksheets/sheet{number}.xml"/>'
            lines = "".join(
                f'<row r="{y + 1}">' + "".join(
                    f'<c r="{chr(65 + x)}{y + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for x, v in enumerate(row) if v
                ) + "</row>" for y, row in enumerate(rows)
            )
            archive.writestr(f"xl/worksheets/sheet{number}.xml", f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>')
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        archive.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{targets}</Relationships>")
    return out.getvalue()


def test_workbooks_with_different_headers_are_all_read(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sheets(("one", [["x"], ["1"]])))
    (tmp_path / "B.XLSX").write_bytes(sheets(("one", [["x", "y"], ["2", "3"]])))
    frame = readers.read_table(spark, str(tmp_path), format="xlsx")
    assert sorted(frame.columns) == ["x", "y"]
    assert sorted((r.x, r.y) for r in frame.collect()) == [("1", None), ("2", "3")] or sorted(
        map(str, ((r.x, r.y) for r in frame.collect()))
    ) == ["('1', None)", "('2', '3')"]


def test_empty_and_repeated_headers_keep_their_values(spark, tmp_path):
    path = tmp_path / "a.XLSX"
    path.write_bytes(sheets(("one", [["x", "", "x"], ["1", "2", "3"], ["", "5", ""]])))
    frame = readers.read_table(spark, str(path))
    assert frame.columns == ["x", "_c1", "x_2"]
    assert [tuple(r) for r in frame.collect()] == [("1", "2", "3"), (None, "5", None)]


def test_sheets_by_order_name_and_without_header(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    (tmp_path / "a.xlsx").write_bytes(sheets(("late", [["x"], ["1"]]), ("early", [["y"], ["2"]])))
    assert [tuple(r) for r in readers.read_table(spark, path).collect()] == [("1",)]
    assert readers.read_table(spark, path, sheet=1).columns == ["y"]
    assert readers.read_table(spark, path, sheet="early").columns == ["y"]
    assert [tuple(r) for r in readers.read_table(spark, path, header=False).collect()] == [("x",), ("1",)]


def test_directories_are_validated_and_checked(spark, tmp_path):
    for name, n in (("a", 3), ("b", 4)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    spec = readers.TableSpec(
        str(tmp_path / "in" / "*.parquet"), "parquet", "*.parquet", rows_expected=7, columns=1, tables_expected=2
    )
    catalog = readers.Catalog({"all": spec, "one": readers.TableSpec(str(tmp_path / "in" / "a.parquet"), rows_expected=4)})
    found = {(r.dataset, r.check): (r.actual, r.is_valid) for r in catalog.expectations(spark).collect()}
    assert found[("all", "rows")] == (7, True) and found[("all", "columns")] == (1, True)
    assert found[("one", "rows")] == (3, False) and found[("one", "columns")] == (1, True)
    assert ("one", "tables") not in found
    whole = catalog.load(spark, "all", validate=True)
    assert set(whole.reports) == set(whole.tables)
    assert all(r.is_valid for report in whole.reports.values() for r in report.collect())
    assert catalog.load(spark, "one", validate=True).report.count() > 0


def xlsx(spark, path, **options):
    register_xlsx(spark)
    return spark.read.format("xlsx").options(**options).load(str(path))


def test_xlsx_source_reads_headers_that_differ(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sheets(("one", [["x", "", "x"], ["1", "2", "3"], ["", "5", ""]])))
    (tmp_path / "b.XLSX").write_bytes(sheets(("one", [["y", "x"], ["6", "7", "beyond the header"]])))
    (tmp_path / "c.xlsx").write_bytes(sheets(("one", [])))
    (tmp_path / "_d.xlsx").write_bytes(b"no workbook")
    found = xlsx(spark, tmp_path)
    assert found.columns == ["x", "_c1", "x_2", "y"]
    rows = {("1", "2", "3", None), (None, "5", None, None), ("7", None, None, "6")}
    assert set(map(tuple, found.collect())) == rows
    assert xlsx(spark, tmp_path, mergeSchema="false").columns == ["x", "_c1", "x_2"]
    register_xlsx(spark)
    some = spark.read.format("xlsx").schema("y string, none string").load(f"file:{tmp_path}")
    assert sorted(map(str, (r.y for r in some.collect()))) == ["6", "None", "None"]
    assert xlsx(spark, tmp_path / "a.*").count() == 2 and xlsx(spark, tmp_path / "b.XLSX").count() == 1


def test_xlsx_source_by_sheet(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sheets(("late", [["x"], ["1"]]), ("early", [["y"], ["2"]])))
    (tmp_path / "b.xlsx").write_bytes(sheets(("late", [["x"], ["3"]])))
    assert sorted(r.x for r in xlsx(spark, tmp_path).collect()) == ["1", "3"]
    assert [tuple(r) for r in xlsx(spark, tmp_path / "a.xlsx", sheet="early").collect()] == [("2",)]
    assert [tuple(r) for r in xlsx(spark, tmp_path / "a.xlsx", sheet=1, header=False).collect()] == [("y",), ("2",)]
    every = sorted(tuple(map(str, r)) for r in xlsx(spark, tmp_path, sheet="*").collect())
    assert every == [("1", "None"), ("3", "None"), ("None", "2")]


def test_xlsx_source_refuses_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sheets(("one", [["x"], ["1"]])))
    register_xlsx(spark)
    for read in (
        lambda: spark.read.format("xlsx").schema("x int").load(str(tmp_path)).collect(),
        lambda: xlsx(spark, tmp_path / "absent").collect(),
        lambda: xlsx(spark, tmp_path, sheet="absent").collect(),
    ):
        with pytest.raises(PySparkException):
            read()


def test_xlsx_partitions_follow_the_sizes():
    large, small = PARTITION_BYTES, 1000
    planned = SheetsReader([("a", 0, large), ("a", 1, large), *[(f"s{i}", 0, small) for i in range(40)]], ["x"], True)
    counts = [len(p.sheets) for p in planned.partitions()]
    assert sum(counts) == 42 and counts[:2] == [1, 1] and len(counts) < 10


def test_reject_log(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "id int, value string")
    path = str(tmp_path / "log")

    def write(batch, which):
        bad = quarantine.record_malformed(rows.filter(which), "test", "TYPE_ERROR", "Invalid type", "2024-02-01")
        quarantine.log_rejects(bad, path, batch)

    def logged(batches=None):
        found = quarantine.read_rejects(spark, path, batches)
        return sorted((r.batch, r.record[6:7]) for r in found.collect())

    write("2024-02-01", "id < 2")
    write("7", "id = 2")
    write("7", "id = 2")
    assert logged() == [("2024-02-01", "0"), ("2024-02-01", "1"), ("7", "2")]
    assert logged(["7"]) == [("7", "2")]
    write("2024-02-01", "id = 5")
    assert logged() == [("2024-02-01", "5"), ("7", "2")]
    write("7", "false")
    assert logged() == [("2024-02-01", "5")]
    plan = quarantine.read_rejects(spark, path, ["7"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*batch#", plan)
    for unfit in ("", "a/b", "..", "a=b"):
        with pytest.raises(ValueError):
            write(unfit, "true")


def test_header_reads_few_shared_strings(tmp_path, monkeypatch):
    texts = [[f"text {i}"] for i in range(5000)]
    (tmp_path / "a.xlsx").write_bytes(workbook(texts, ["name"]))
    read = []
    monkeypatch.setattr(workbooks, "_text", lambda item, of=workbooks._text: read.append(1) or of(item))
    source = workbooks.WorkbookSource({"path": str(tmp_path)})
    assert source.schema().fieldNames() == ["name"] and len(read) < 10
    rows = list(workbooks.sheet_rows((tmp_path / "a.xlsx").read_bytes()))
    assert rows[1:] == texts and len(read) < 5010
    with pytest.raises(IndexError):
        workbooks._SharedStrings(zipfile.ZipFile(tmp_path / "a.xlsx"))[5001]
