import io
import json
import zipfile

from pyspark.sql import functions as F

from filinglens.operators import chunks as OC
from filinglens.sources import archives, readers, structure


def test_registry_variants(spark, tmp_path):
    (tmp_path / "c.xml").write_text("<result><list><corp_code> 00000001 </corp_code><corp_name>가</corp_name><stock_code>005930</stock_code></list>"
                                    "<list><corp_code>00000002</corp_code><stock_code> </stock_code></list></result>", encoding="utf-8")
    p = str(tmp_path)
    assert {(r.corp_code, r.corp_name, r.stock_code) for r in readers.registry(spark, p).collect()} == {("00000001", "가", "005930"), ("00000002", "", "")}
    assert readers.registry(spark, p, "require").count() == 1
    assert readers.registry(spark, p, "null").filter("stock_code is null").count() == 1


def test_candidate_cache_one_object_per_file(spark, tmp_path):
    for i, filing in enumerate([{"rcept_no": "1", "rcept_dt": "20240101", "report_nm": "사업보고서"}, None]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"analysis_as_of": "20240213", "company": {"corp_code": f"0{i}"}, "filing": filing, "business_text": ""}, indent=2))
    got = {r.corp_code: r.rcept_no for r in readers.candidate_cache(spark, str(tmp_path)).collect()}
    assert got == {"00": "1", "01": None}


def test_statement_files_and_broken_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"company": "A", "business_year": 2023, "dart_report_type": "annual", "fs_div": "CFS",
                                                 "statements": [{"sj_div": "IS", "account_nm": "매출액", "thstrm_amount": "1"}, {"sj_div": "BS"}]}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    rows, bad = readers.statements(spark, str(tmp_path))
    assert [(r.line_no, r.sj_div) for r in rows.orderBy("line_no").collect()] == [(0, "IS"), (1, "BS")]
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["b.json"]


def test_csv_keeps_zeros(spark, tmp_path):
    (tmp_path / "x.csv").write_text("corp_code,rcept_dt\n00000012,20240101\n")
    assert readers.listing(spark, str(tmp_path), ["corp_code", "rcept_dt"]).collect()[0].corp_code == "00000012"


def test_dictionary_order(spark):
    got = readers.dictionary(spark, {"a": ["x", "y", "x"]}, {"a": ["y", "z"]}).orderBy("pos").collect()
    assert [r.keyword for r in got] == ["x", "y", "z"]


def test_archives_from_files(spark, tmp_path):
    def write(name, members):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, c in members:
                z.writestr(n, c)
        (tmp_path / name).write_bytes(b.getvalue())

    write("a.zip", [("x.XML", "<p>짧음</p>".encode("cp949")), ("y.html", "<p>더 긴 문서</p>".encode()), ("i/f.png", b"1"), ("j/f.png", b"2"), ("n.txt", b"")])
    write("b.zip", [("n.txt", b"")])
    (tmp_path / "c.zip").write_bytes(b"nonsense")
    m = archives.members(readers.archives(spark, str(tmp_path))).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    got = sorted((r.name, r.kind, r.filename or "", r.text or "", r.saved_name or "", r.error or "") for r in m.collect())
    assert got == [("a.zip", "document", "x.XML", "<p>짧음</p>", "", ""), ("a.zip", "document", "y.html", "<p>더 긴 문서</p>", "", ""),
                   ("a.zip", "image", "i/f.png", "", "f.png", ""), ("a.zip", "image", "j/f.png", "", "f_1.png", ""),
                   ("b.zip", "error", "", "", "", "NoDocument"), ("c.zip", "error", "", "", "", "BadZipFile")]
    docs = m.filter("kind = 'document'").withColumn("n_chars", F.length("text").cast("bigint"))
    assert [r.filename for r in archives.main_documents(docs, ["name"]).collect()] == ["y.html"]
    parsed = structure.structured(docs, ["name", "filename"], "text", "filename")
    assert {r.text for r in parsed.collect()} == {"짧음", "더 긴 문서"}


def test_decoding_falls_through():
    assert archives.decode("가".encode("utf-8")) == archives.decode("가".encode("cp949")) == "가"
    assert archives.decode(b"a\xff\xff\xfe") == "a"
    assert archives.safe_name('a/b:c?.png') == "a_b_c_.png"


PAGE = """<html><body><style>s</style><p>앞</p>
<table-group><table><tr><th colspan=2>A|B</th></tr><tr><td>1<td rowspan="x">2</tr>
<tr><td>in<table><tr><td>nested</td></tr></table></td></tr></table></table-group>
<table></table><p>그림 <img src="" href="h.png" title="t"> 설명</p></body></html>"""


def test_page_structure():
    p = structure.parse(PAGE)
    assert [t["table_id"] for t in p["tables"]] == ["table_0001", "table_0002"]  # the nested one is a table too; the empty one only uses its number
    first = p["tables"][0]["rows"]
    assert first[0] == [{"text": "A|B", "colspan": 2, "rowspan": 1}]
    assert [c["text"] for c in first[1]] == ["1", "2"]
    assert first[2][0]["text"] == "in nested"
    assert p["tables"][0]["markdown"].split("\n")[:2] == ["| A\\|B |  |", "| --- | --- |"]
    assert p["images"] == [{"image_id": "image_0001", "tag": "img", "source": "h.png", "alt": "", "title": "t", "nearby_text": "그림 설명"}]
    assert "[[TABLE:table_0001]]" in p["text"] and "s" not in p["text"].split("\n")
    assert "<!-- table_0001 -->\n| A\\|B |" in p["markdown"] and "[IMAGE: image_0001]" in p["markdown"]


def test_xml_rows_and_loose_cells():
    p = structure.parse('<?xml version="1.0"?><doc><TABLE-GROUP><ROW><TE COLS="3">a</TE><TU/></ROW></TABLE-GROUP><TABLE><X><TD>1</TD><TD>2</TD></X></TABLE></doc>', "a.xml")
    assert p["tables"][0]["rows"] == [[{"text": "a", "colspan": 3, "rowspan": 1}, {"text": "", "colspan": 1, "rowspan": 1}]]
    assert [c["text"] for c in p["tables"][1]["rows"][0]] == ["1", "2"]


def test_deep_nesting_is_no_problem():
    assert structure.parse("<b>" * 20000 + "x")["text"] == "x"


def test_markdown_expression_equals_the_job(spark):
    docs = structure.structured(spark.createDataFrame([(1, PAGE)], "id int, html string"), ["id"], "html")
    rows = structure.table_rows(docs, ["id"]).select("markdown", OC.table_markdown(F.col("rows")).alias("m"), OC.table_search_text(F.col("rows")).alias("s")).collect()
    assert all(r.markdown == r.m for r in rows)
    assert rows[0].s.split("\n")[:2] == ["A|B", "1 | 2"]


def test_cdata_and_odd_sections_are_read(spark):
    assert structure.parse("<a><p>x</p><![CDATA[hello]]></a>")["text"].split() == ["x", "hello"]
    assert structure.parse("<p>a</p><![foo[x]]><p>b</p>")["text"].startswith("a")
    pages = spark.createDataFrame([(1, "<p>a</p><![foo[x]]>"), (2, None), (3, "<p>b</p><![CDATA[open")], "id int, html string")
    got = {r.id: (r.text.split()[:1], r.error) for r in structure.structured(pages, ["id"], "html").collect()}
    assert got[1][0] == ["a"] and got[2] == ([], None) and got[3][0] == ["b"]


def test_bad_members_leave_the_others(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.xml", "<p>gut</p>" * 20)
        z.writestr("bad.xml", "<p>schlecht</p>" * 200)
        z.writestr("locked.xml", "<p>zu</p>" * 20)
        z.writestr("i.png", b"1")
        spots = {n: z.getinfo(n).header_offset for n in z.namelist()}
    raw = bytearray(b.getvalue())
    at = spots["bad.xml"] + 30 + len("bad.xml")
    raw[at : at + 8] = b"\xff" * 8  # damaged deflate stream
    raw[spots["locked.xml"] + 6] |= 1  # encrypted, in the local and the central header
    central = raw.rindex(b"PK\x01\x02", 0, raw.rindex(b"i.png"))
    central = raw.rindex(b"PK\x01\x02", 0, raw.rindex(b"locked.xml"))
    raw[central + 8] |= 1
    (tmp_path / "x.zip").write_bytes(bytes(raw))
    only = io.BytesIO()
    with zipfile.ZipFile(only, "w") as z:
        z.writestr("i.png", b"1")
    (tmp_path / "y.zip").write_bytes(only.getvalue())
    m = archives.members(readers.archives(spark, str(tmp_path))).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    got = sorted((r.name, r.kind, r.filename or "", r.error or "") for r in m.collect())
    assert got == [("x.zip", "document", "good.xml", ""), ("x.zip", "error", "bad.xml", "error"), ("x.zip", "error", "locked.xml", "RuntimeError"), ("x.zip", "image", "i.png", ""),
                   ("y.zip", "error", "", "NoDocument"), ("y.zip", "image", "i.png", "")]


def test_references_without_semicolon():
    """the query's SQL decodes only references that end; others stay as they are written, scripts untouched."""
    page = "<p>and&amp</p><script>a&ampb</script>&ampx; &lt;b&#39; a&copy=1 &nosuch;"
    got = structure.parse(page, ended=True)
    assert got["text"] == "and&amp\n&ampx; <b' a&copy=1 &nosuch;" and "a&ampb" in got["plain"]
    assert structure.parse("<p>and&amp</p>")["text"] == "and&"


def test_pages_are_parsed_piece_by_piece(spark, monkeypatch):
    """A task yields its pages in pieces bounded by their markup, with the same rows as at once."""
    pages = spark.createDataFrame([(i, None if i == 3 else f"<p>{'x' * 10 * i}</p><table><tr><td>{i}</td></tr></table>") for i in range(40)], "id long, html string").coalesce(1)
    whole = structure.structured(pages, ["id"], "html").orderBy("id").collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"
    monkeypatch.setattr(structure, "PIECE", 500)
    seen = {}
    monkeypatch.setattr(type(pages), "mapInPandas", lambda self, run, schema: seen.update(run=run))
    structure.structured(pages, ["id"], "html")
    batch = structure.pd.DataFrame({"id": range(40), "_markup": [r.html for r in pages.collect()]})
    parts = list(seen["run"]([batch]))
    assert len(parts) > 5 and [i for p in parts for i in p["id"]] == list(range(40))
    assert [t for p in parts for t in p["text"]] == [r.text for r in whole]


def test_files_are_written_from_bounded_batches(spark, tmp_path):
    from filinglens.sources import sinks
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = spark.createDataFrame([(f"{i}.bin", bytes([i]) * i) for i in range(20)], "path string, content binary")
    assert sinks.write_files(files, str(tmp_path / "out")) == 20
    assert (tmp_path / "out" / "7.bin").read_bytes() == bytes([7]) * 7
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"
