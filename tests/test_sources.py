import io
import zipfile

import pytest

from tablesmith.operators.ledger import ROW_ID
from tablesmith.operators.numbering import gapless
from tablesmith.sources import json_, layout, naming, text, upload, xlsx


def rows(df):
    return [tuple(r)[1:] for r in df.orderBy(ROW_ID).collect()]


def test_names():
    assert naming.column_names(["Order ID", "", "a-b", "a b", " x! "]) == ["order_id", "col_1", "a_b", "a_b_1", "x"]
    assert naming.table_name("2024 Sales") == "t_2024_sales"
    assert naming.free_name("a", ["a", "a_2"]) == "a_3"


@pytest.mark.parametrize(
    "data, expected",
    [
        (b"\xff\xfe" + "naïve".encode("utf-16-le"), "naïve"),
        (b"\xfe\xff" + "naïve".encode("utf-16-be"), "naïve"),
        (b"\xef\xbb\xbfab", "ab"),
        ("é".encode(), "é"),
    ],
)
def test_encodings(data, expected):
    assert text.decoded(data) == expected


def test_latin_text_is_read():
    assert "caf" in text.decoded("name\ncafé olé\n".encode("latin-1"))


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(sep):
    assert text.delimiter(f"a{sep}b{sep}c\n1{sep}2{sep}3\n") == sep


def test_banner_two_row_header_and_footer(spark):
    data = b"Quarterly export,,,\n,,,\nCustomer,,Order,Order\nID,Name,Date,Amount\n1,Ann,2025-01-02,5\n2,Bob,2025-01-03,6\nTotal,,,11\n"
    df, _, _ = text.read_bytes(spark, data)
    assert df.columns[1:] == ["customer_id", "customer_name", "order_date", "order_amount"]
    assert rows(df) == [("1", "Ann", "2025-01-02", "5"), ("2", "Bob", "2025-01-03", "6")]


def test_years_as_group_labels():
    head, skip = layout.header([["Region", "2026", "2026"], ["Region", "Revenue", "Units"], ["N", "5", "6"], ["S", "7", "8"]])
    assert head == ["Region", "2026_Revenue", "2026_Units"] and skip == 2


def test_junk_first_row(spark):
    df, _, _ = text.read_bytes(spark, b"Bond Trades Export,,,\nbond_id,buy_sell,quantity,x\n1,B,5,1\n2,S,6,2\n")
    assert df.columns[1:] == ["bond_id", "buy_sell", "quantity", "x"]


def test_degenerate_files(spark):
    for bad in (b"", b"  \n ", b"a\0b,c\n1,2\n"):
        with pytest.raises(text.SourceError):
            text.read_bytes(spark, bad)
    df, _, note = text.read_bytes(spark, b"a,b\n")
    assert df.count() == 0 and note
    df, _, _ = text.read_bytes(spark, b"only\nx\ny\nz\n")
    assert rows(df) == [("x",), ("y",), ("z",)]


def test_ragged_rows_and_blank_columns(spark):
    df, _, _ = text.read_bytes(spark, b"a,b,c\n1,2\n3,4,,9\n")
    assert rows(df) == [("1", "2"), ("3", "4")]


def test_scan_of_a_large_file_keeps_file_order(spark, tmp_path):
    body = "".join(f"{i},name {i}\n" for i in range(5000))
    (tmp_path / "big.csv").write_text("Report,\nid,name\n" + body + "Total,\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = text.scan(spark, str(tmp_path / "big.csv"))
        got = [(r[ROW_ID], r["id"]) for r in df.orderBy(ROW_ID).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, str(i)) for i in range(5000)]


def test_scan_with_banner_blank_column_and_clashing_names(spark, tmp_path):
    body = "".join(f"{i},,x{i},{i % 7}\n" for i in range(900))
    (tmp_path / "odd.csv").write_text("A report,,,\nrow,at,file,_bucket\n" + body + "Source: me,,,\n")
    df = text.scan(spark, str(tmp_path / "odd.csv"))
    assert df.columns == [ROW_ID, "row", "file", "bucket"]
    assert [tuple(r) for r in df.orderBy(ROW_ID).collect()] == [(i, str(i), f"x{i}", str(i % 7)) for i in range(900)]


def test_gapless_with_clashing_names_and_nulls(spark):
    for by in ("_at", "at", "row", "bucket", "own", "before", "x", "n", "_number"):
        df = spark.range(300).selectExpr(f"300 - id as `{by}`", *[f"'k' as `{c}`" for c in ("_bucket", "_own", "_n", "_before") if c != by])
        got = gapless(df, by, "number").orderBy("number").collect()
        assert [(r["number"], r[by]) for r in got] == [(i, i + 1) for i in range(300)]
        assert sorted(r[by] for r in gapless(df, by).collect()) == list(range(300))
    nulls = spark.createDataFrame([(None,), (5,), (None,), (2,)], "a long")
    assert [r.a for r in gapless(nulls, "a", "n").orderBy("n").collect()] == [2, 5, None, None]
    assert gapless(nulls.limit(0), "a", "n").count() == 0


def test_json(spark):
    df, _, _ = json_.read_bytes(spark, b'[{"id":1,"address":{"city":"X","zip":"9"},"tags":["urgent","vip",null]},{"id":2,"address":{"city":"Y"}},7]')
    assert df.columns[1:] == ["id", "address_city", "address_zip", "tags", "value"]
    assert rows(df) == [("1", "X", "9", "urgent, vip, ", None), ("2", "Y", None, None, None), (None, None, None, None, "7")]
    with pytest.raises(text.SourceError):
        json_.read_bytes(spark, b"3")


def test_json_scan_matches_the_upload(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":1,"a":{"b":{"c":2}},"t":["x","y"]}\n{"id":2,"a":{"b":{"c":3}}}\n')
    df = json_.scan(spark, str(tmp_path / "a.json"))
    assert sorted(df.columns) == ["a_b_c", "id", "t"]
    assert {r["t"] for r in df.collect()} == {"x, y", None}


def workbook(sheets: dict[str, str], shared: list[str] = (), styles: str = "") -> bytes:
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook(spark):
    cells = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'
    data = '<row><c r="A2"><v>3</v></c><c r="B2" s="1"><v>45658</v></c><c r="C2"><f>A2*2</f><v>6</v></c></row><row><c r="A3"><v>4.5</v></c><c r="C3"><f>A3*2</f></c></row>'
    found = xlsx.read_bytes(spark, workbook({"One": cells + data, "Empty": "", "Head": cells}, ["qty", "day", "total"]))
    assert list(found) == ["One"]
    df, raw, warning = found["One"]
    assert rows(df) == [("3", "2025-01-01", "6"), ("4.5", "", "")] and raw == ["qty", "day", "total"]
    assert "total" in warning
    with pytest.raises(text.SourceError):
        xlsx.read_bytes(spark, b"not a zip")


def test_upload_isolates_failures(spark):
    out = upload.read(spark, [("good.csv", b"name,score\na,1\n"), ("bad.json", b"{"), ("x.pdf", b"%"), ("old.xls", b"zz"), ("good.csv", b"name,score\nb,2\n")])
    assert list(out.tables) == ["good", "good_2"]
    assert set(out.errors) == {"bad.json", "x.pdf", "old.xls"}
