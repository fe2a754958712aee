"""Readers, writers, jobs and streams."""

import io
import zipfile

import pytest

from pairwright.plans.jobs import MatchJob
from pairwright.sources import export, readers, samples, xlsx


def test_csv_encodings_names_and_nulls(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes(' id , name,name\n007,"Zoë ""Z""",x\n8,,"two\nlines"\n'.encode())
    (tmp_path / "l.csv").write_bytes("id,name\n1,Zo\xeb\n".encode("latin-1"))
    df = readers.read_table(spark, str(tmp_path / "u.csv"))
    assert df.columns == ["id", "name", "name.1"] or df.columns[0] == "id"
    assert [tuple(r) for r in df.collect()] == [("007", 'Zoë "Z"', "x"), ("8", "", "two\nlines")]
    assert readers.read_table(spark, str(tmp_path / "l.csv")).first()["name"] == "Zoë"


def test_csv_encoding_is_that_of_the_whole_table(spark, tmp_path):
    body = b"id,name\n" + b"1,plain\n" * (200_000)
    (tmp_path / "late.csv").write_bytes(body + b"2,Zo\xeb\n")
    (tmp_path / "late_utf8.csv").write_bytes(body + "2,Zoë\n".encode())
    (tmp_path / "parts.csv").mkdir()
    (tmp_path / "parts.csv" / "part-0.csv").write_bytes(b"id,name\n1,plain\n")
    (tmp_path / "parts.csv" / "part-1.csv").write_bytes(b"id,name\n2,Zo\xeb\n")
    for name in ("late", "late_utf8", "parts"):
        got = readers.read_table(spark, str(tmp_path / f"{name}.csv")).where("id = '2'").collect()
        assert [r["name"] for r in got] == ["Zoë"], name


def test_json_forms(spark, tmp_path):
    for name, text in (("records", '[{"a": "x", "b": 1}, {"a": null, "b": 2}]'), ("lines", '{"a": "x", "b": 1}\n{"a": null, "b": 2}\n'), ("columns", '{"a": {"0": "x", "1": null}, "b": {"0": 1, "1": 2}}')):
        (tmp_path / f"{name}.json").write_text(text)
        assert sorted(tuple(r) for r in readers.read_table(spark, str(tmp_path / f"{name}.json")).select("a", "b").collect()) == [("", "2"), ("x", "1")], name


def test_unknown_formats(spark):
    for path in ("x.parquet", "x.xls"):
        with pytest.raises(ValueError):
            readers.read_table(spark, path)


def test_workbook_round_trip(spark, tmp_path):
    rows = [("a & b", 1.5, None), ("<é\x07>", 2.0, " x ")]
    df = spark.createDataFrame(rows, "t string, n double, u string").coalesce(1)
    export.write_xlsx(df, str(tmp_path / "t.xlsx"))
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "t.xlsx")).collect()] == [("a & b", "1.5", ""), ("<é>", "2.0", " x ")]
    assert [xlsx._letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and xlsx._column("AAA9") == 702


def test_tables_over_a_sheet_become_workbooks(spark, tmp_path, monkeypatch):
    """All rows are exported in order, whatever their number; a later export leaves nothing of an earlier one."""
    df = spark.range(25).selectExpr("id", "if(id % 3 = 0, null, concat('row ', id)) as t", "timestamp'2020-01-02 03:04:05' as at").repartition(3).orderBy("id")
    rows, path = [(str(i), f"row {i}" if i % 3 else "", "2020-01-02 03:04:05") for i in range(25)], tmp_path / "t.xlsx"
    for most, books in ((26, 1), (11, 3), (25, 2), (26, 1)):
        monkeypatch.setattr(xlsx, "MAX_ROWS", most)
        assert export.export(df, str(path), "xlsx") == str(path)
        files = sorted(path.glob("*.xlsx")) if books > 1 else [path]
        assert [f.name for f in files] == ([f"part-{k:05}.xlsx" for k in range(books)] if books > 1 else ["t.xlsx"])
        sheets = [list(xlsx.sheet_rows(f.read_bytes())) for f in files]
        assert all(s[0] == ["id", "t", "at"] for s in sheets) and max(map(len, sheets)) <= most
        assert [tuple(c or "" for c in r) for s in sheets for r in s[1:]] == rows, most
        assert sorted(tuple(r) for r in readers.read_table(spark, str(path)).collect()) == sorted(rows), most
    export.write_xlsx(df.limit(0), str(path))
    assert readers.read_table(spark, str(path)).columns == ["id", "t", "at"] and readers.read_table(spark, str(path)).count() == 0
    (tmp_path / "other.xlsx").mkdir()
    (tmp_path / "other.xlsx" / "notes.txt").write_text("kept")
    with pytest.raises(ValueError):
        export.write_xlsx(df, str(tmp_path / "other.xlsx"))
    assert (tmp_path / "other.xlsx" / "notes.txt").read_text() == "kept"


def test_sheets_of_other_writers():
    """Prefixed names, shared strings, rich text, formulas, cells without names, and a sheet of many reads."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def rows(body, shared=""):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as book:
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="a" sheetId="1" r:id="x"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="worksheets/s.xml"/></Relationships>')
            book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{shared}</sst>')
            book.writestr("xl/worksheets/s.xml", f'<x:worksheet xmlns:x="{main}"><x:cols/>{body}</x:worksheet>')
        return list(xlsx.sheet_rows(out.getvalue()))

    rich = '<x:c r="D1" t="inlineStr"><x:is><x:r><x:t>a </x:t></x:r><x:r><x:t><![CDATA[</row>]]></x:t></x:r></x:is></x:c>'
    first = f'<x:row><x:c r="B1" t="s"><x:v>1</x:v></x:c><x:c t="b"><x:v>0</x:v></x:c>{rich}<x:c><x:f>A1+1</x:f><x:v>3.5</x:v></x:c><x:c/></x:row><x:row/>'
    want = [[None, "two", "False", "a </row>", "3.5", None], []]
    assert rows(f"<x:sheetData>{first}</x:sheetData>", "<si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r></si>") == want
    assert rows("") == rows("<x:sheetData/>") == []
    many = "".join(f'<x:row r="{i}"><x:c r="A{i}"><x:v>{i}</x:v></x:c></x:row>' for i in range(1, 20_001))
    assert rows(f"<x:sheetData>{many}</x:sheetData>") == [[str(i)] for i in range(1, 20_001)]


def test_samples(spark, tmp_path):
    paths = samples.write_samples(str(tmp_path))
    assert len(paths) == 4 and readers.read_table(spark, paths[-1]).count() == 4
    df, info, kinds = readers.load_table(spark, paths[0], "sample_view")
    assert info.rows == 10 and len(info.preview) == 5 and kinds["Address_A"] == ("address", 0.95)
    assert spark.table("sample_view").count() == 10
    with pytest.raises(KeyError):
        samples.sample(spark, "none")


def test_csv_layout_and_splits(spark, tmp_path):
    """A file without values over lines is read by several tasks; one odd quote anywhere makes it one task's work."""
    body = b'id,name\n' + b'1,"a ""quoted"" name"\n' * 60_000
    (tmp_path / "flat.csv").write_bytes(body)
    (tmp_path / "over.csv").write_bytes(body + b'2,"two\nlines"\n')
    assert readers.csv_layout(spark, str(tmp_path / "flat.csv")) == ("UTF-8", False) and readers.csv_layout(spark, str(tmp_path / "over.csv")) == ("UTF-8", True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        flat, over = (readers.read_table(spark, str(tmp_path / f"{n}.csv")) for n in ("flat", "over"))
        assert flat.rdd.getNumPartitions() > 1 == over.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert flat.where("name = 'a \"quoted\" name'").count() == 60_000 and over.where("id = '2'").first()["name"] == "two\nlines"


def test_json_of_columns_is_parsed_by_executors(spark, tmp_path):
    for name, text in (("rows", '{"a": {"0": "x", "1": null, "2": {"k": 1}}, "b c": {"0": 1, "1": 2.5, "2": true}}'), ("lists", '{\n "a": ["x", null, {"k": 1}],\n "b c": [1, 2.5, true, 9]\n}'), ("one", '{"a": ["only"]}')):
        (tmp_path / f"{name}.json").write_text(text)
    want = [("x", "1"), ("", "2.5"), ('{"k":1}', "true")]
    for name in ("rows", "lists"):
        got = readers.read_table(spark, str(tmp_path / f"{name}.json"))
        assert got.columns == ["a", "b c"] and [tuple(r) for r in got.collect()] == want, name
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "one.json")).collect()] == [("only",)]
    (tmp_path / "record.json").write_text('{\n "a": "x",\n "b": 2\n}')
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "record.json")).collect()] == [("x", "2")]


def test_row_ids_pages_and_scratch(spark):
    from pairwright.operators import results
    from pairwright.sources import scratch

    df = spark.range(1000).selectExpr("id", "1000 - id as back", "cast(id as string) as place").repartition(7).orderBy("back")
    got = results.with_row_id(df, "place").collect()
    assert sorted((r["place"], r["id"]) for r in got) == [(k + 1, 999 - k) for k in range(1000)]
    assert results.with_row_id(df.limit(0)).count() == 0
    scratch.clear_scratch(spark)
    assert scratch._made == []


def test_job(spark, tmp_path):
    df = samples.sample(spark, "companies")
    job = MatchJob.columns(df, str(tmp_path / "job"), "Company_A", "Company_B").start()
    assert job.wait(120) == "completed" and job.progress() == 1.0
    assert job.statistics().first().total == 10 and job.explain(3).first().row_index == 3
    job.export(str(tmp_path / "out.xlsx"), "xlsx")
    back = readers.read_table(spark, str(tmp_path / "out.xlsx"))
    assert back.count() == 10 and back.columns[:3] == ["Row", "Original_Company_A", "Original_Company_B"] and len(back.columns) == 12
    bad = MatchJob.columns(df, str(tmp_path / "bad"), "Company_A", "none")
    with pytest.raises(ValueError):
        bad.run()
    assert bad.status == "failed" and "none" in bad.error
    with pytest.raises(RuntimeError):
        bad.table()
    with pytest.raises(ValueError):
        job.export(str(tmp_path / "out.pdf"), "pdf")
