import io
import json
import zipfile

from helpers import frame, para, tables
from pyspark.sql import functions as F

from folioscope import model
from folioscope.operators import stores
from folioscope.sources import exports, files, lines, office, pdf, wiki
from folioscope.streaming import ingest

PAGE = """<h1>Title</h1><p>Some <b>text</b></p><ac:structured-macro ac:name="info"><ac:rich-text-body><p>Mind this</p></ac:rich-text-body></ac:structured-macro><h2>Part</h2>
<table><tbody><tr><th>Name</th><th>Value</th></tr><tr><td>a</td><td>1</td></tr></tbody></table><p>See <ac:link><ri:page ri:content-title="Other page"/></ac:link> and <a href="https://x.example/a">this site</a></p>
<ac:image ac:alt="A flow"><ri:attachment ri:filename="flow.png"/></ac:image>
<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">json</ac:parameter><ac:plain-text-body><![CDATA[{"a": "<b>"}]]></ac:plain-text-body></ac:structured-macro>"""


def test_wiki_page(spark):
    pages = spark.createDataFrame([("u", PAGE, "7", "S"), ("none", None, None, None)], "uri string, body string, page_id string, space string")
    b = wiki.page_blocks(pages).orderBy("pos").collect()
    assert [r["kind"] for r in b] == ["heading", "paragraph", "callout", "heading", "table", "paragraph", "image", "code"]
    assert b[4]["headers"] == ["Name", "Value"] and b[4]["rows"] == [["a", "1"]] and not b[4]["is_layout_table"]
    assert b[7]["text"] == '{"a": "<b>"}' and b[7]["lang"] == "json" and b[6]["asset_ref"] == "flow.png"
    assert b[3]["path"] == [1, 1] and b[1]["anchor"]["xpath"] == "./p[1]" and b[1]["anchor"]["quote_prefix"] == "Title" and b[2]["anchor"]["xpath"] == ""
    got = {r["href"]: (r["target"], r["resolved_title"]) for r in wiki.page_links(pages, base_url="https://wiki.example/").collect()}
    assert got == {"https://x.example/a": ("external", None), "/display/S/Other%20page": ("internal", "Other page")}


def test_wiki_tolerance_and_types(spark):
    html = "<ul><li>a<ul><li>b</ul><li>c</ul><p>one<p>two<br>three<blockquote>q</blockquote><script>var t='<p>';</script>"
    b = wiki.page_blocks(spark.createDataFrame([("u", html)], "uri string, body string")).orderBy("pos").collect()
    assert [(r["kind"], r["items"] or r["text"], r["depth"]) for r in b] == [("list", ["a", "c"], 1), ("list", ["b"], 2), ("paragraph", "one", None), ("paragraph", "twothree", None), ("callout", "q", None)]
    rows = spark.createDataFrame([(["x", " Meeting  Notes "], "{}"), ([], '{"k": "how-to-article"}'), (None, None)], "l array<string>, p string")
    got = rows.select(wiki.detected_type(F.col("l"), F.col("p")).alias("t")).select("t.*").collect()
    assert [tuple(r) for r in got] == [("meeting-notes", 0.9, "label"), ("guide", 0.8, "template"), ("unknown", 0.0, "llm")]


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def test_office_files(spark):
    p = lambda text, props="", bold=False, size=None: f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{'<w:b/>' if bold else ''}{f'<w:sz w:val=\"{size}\"/>' if size else ''}</w:rPr><w:t>{text}</w:t></w:r></w:p>"
    num = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'
    row = lambda *c, bold=False: "<w:tr>" + "".join(f"<w:tc>{p(x, bold=bold)}</w:tc>" for x in c) + "</w:tr>"
    docx = _zip(
        {
            "word/styles.xml": f'<w:styles {W}><w:style w:styleId="a1"><w:name w:val="heading 1"/></w:style></w:styles>',
            "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="5"><w:lvl><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num></w:numbering>',
            "word/document.xml": f"<w:document {W}><w:body>{p('Head', '<w:pStyle w:val=\"a1\"/>')}{p('Body text')}{p('Looks like a head', bold=True, size=32)}{p('one', num)}{p('two', num)}<w:tbl>{row('N', 'V', bold=True)}{row('a', '1')}{row('b', '2')}</w:tbl></w:body></w:document>",
            "docProps/core.xml": '<cp xmlns:dc="d"><dc:title>From core</dc:title><dc:creator>Me</dc:creator></cp>',
        }
    )
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    xlsx = exports.workbook([("First", ("Name", "Count"), [("a", 1), ("b", 2)]), ("Blank", (), [])])
    a = 'xmlns:a="a" xmlns:p="p" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sp = lambda kind, *texts: f'<p:sp><p:nvSpPr><p:cNvPr id="{len(texts)}"/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts)}</p:txBody></p:sp>'
    pptx = _zip(
        {
            "ppt/presentation.xml": f'<p:presentation {a}><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/>'),
            "ppt/slides/slide1.xml": f"<p:sld {a}><p:cSld><p:spTree>{sp('other', 'Last')}</p:spTree></p:cSld></p:sld>",
            "ppt/slides/slide2.xml": f"<p:sld {a}><p:cSld><p:spTree>{sp('title', 'First slide')}<p:grpSp>{sp('body', 'x', 'y')}</p:grpSp></p:spTree></p:cSld></p:sld>",
            "ppt/slides/_rels/slide2.xml.rels": RELS.format('<Relationship Id="n" Target="../notesSlides/n1.xml"/>'),
            "ppt/notesSlides/n1.xml": f"<p:notes {a}><p:spTree>{sp('body', 'Say this')}</p:spTree></p:notes>",
        }
    )
    src = spark.createDataFrame([("/d/a.docx", bytearray(docx)), ("/d/b.xlsx", bytearray(xlsx)), ("/d/c.pptx", bytearray(pptx)), ("/d/bad.docx", bytearray(b"no zip")), ("/d/x.txt", bytearray(b""))], "path string, content binary")
    parsed = office.parse_files(src).cache()
    assert {r["uri"]: (r["title"], r["error"] is None) for r in parsed.collect()} == {"/d/a.docx": ("From core", True), "/d/b.xlsx": ("b", True), "/d/c.pptx": ("c", True), "/d/bad.docx": ("bad", False)}
    got = {}
    for r in office.blocks(parsed).orderBy("uri", "pos").collect():
        got.setdefault(r["uri"][3:], []).append(r)
    d = got["a.docx"]
    assert [r["kind"] for r in d] == ["heading", "paragraph", "paragraph", "list", "table"] and d[2]["emphasized_as_heading"] and d[3]["items"] == ["one", "two"] and d[3]["ordered"] is False and d[3]["depth"] == 0
    assert d[4]["headers"] == ["N", "V"] and len(d[4]["rows"]) == 2 and d[4]["anchor"]["paragraph_index"] == 5
    x = got["b.xlsx"]
    assert [r["kind"] for r in x] == ["heading", "table"] and x[1]["headers"] == ["Name", "Count"] and x[1]["anchor"]["range"] == "A1:B3"
    c = got["c.pptx"]
    assert [(r["kind"], r["text"] or r["items"] or r["notes"] or r["slide_index"]) for r in c] == [("heading", "First slide"), ("slide", "Say this"), ("list", ["x", "y"]), ("slide", 2), ("paragraph", "Last")]
    assert office.documents(parsed).count() == 3 and s


def test_pdf_items(spark):
    """Items stand as they are, spaces among them; a space that no line is there for opens none."""
    rows = [(" ", 720.0, 10.0), ("Big", 700.0, 20.0), (" ", 700.0, 20.0), ("title", 700.0, 20.0), ("", 700.0, 90.0), ("body one", 650.0, 10.0), (" more", 648.0, 10.0), ("next", 630.0, 10.0), ("line", 626.0, 10.0), ("Sub", 600.0, 14.0), ("end of it", 580.0, 10.0)]
    df = spark.createDataFrame([("u", 1, i, t, 10.0 * i, y, 5.0, z) for i, (t, y, z) in enumerate(rows)], pdf.ITEMS)
    got = [(r["kind"], r["level"], r["text"], r["anchor"]["bbox"]) for r in pdf.blocks(df).orderBy("pos").collect()]
    assert got == [("heading", 1, "Big title", [10.0, 700.0, 25.0, 20.0]), ("paragraph", None, "body one more nextline", [50.0, 650.0, 15.0, 10.0]), ("heading", 2, "Sub", [90.0, 600.0, 5.0, 14.0]), ("paragraph", None, "end of it", [100.0, 580.0, 5.0, 10.0])]
    assert pdf.blocks(df.limit(0)).count() == 0


def test_files_of_all_kinds(spark):
    """Kinds are told apart by extension; what the caller knows of a file outweighs its properties; damaged files are errors."""
    book = exports.workbook([("First", ("Name", "Count"), [("a", 1)])])
    rows = [("/d/b.xlsx", bytearray(book), "2026-01-01"), ("/d/Report.v2.PDF", bytearray(b"one two"), "2026-02-02"), ("/d/bad.pdf", bytearray(b""), None), ("/d/x.txt", bytearray(b""), None)]
    src = spark.createDataFrame(rows, "path string, content binary, modified_at string")

    def reader(data):
        if not data:
            raise ValueError("no pages")
        return [(1, w, 0.0, 700.0 - 20 * i, 9.0, 10.0) for i, w in enumerate(data.decode().split())]

    docs, blocks, errors = files.parse(src, reader)
    assert {r["uri"]: (r["source_kind"], r["title"], r["modified_at"]) for r in docs.collect()} == {"/d/b.xlsx": ("xlsx", "b", "2026-01-01"), "/d/Report.v2.PDF": ("pdf", "Report.v2", "2026-02-02")}
    assert [r["text"] for r in blocks.where("uri like '%PDF'").collect()] == ["one two"]
    assert [tuple(r) for r in errors.collect()] == [("/d/bad.pdf", "ValueError: no pages")]
    assert sorted(r["uri"] for r in files.parse(src)[2].collect()) == ["/d/Report.v2.PDF", "/d/bad.pdf"]


def test_json_and_lines(spark, tmp_path):
    good = {"schemaVersion": 1, "source": {"kind": "docx", "uri": "u"}, "title": "T", "docType": {"value": "guide", "confidence": 1, "origin": "user"}, "blocks": [{"id": "b1", "kind": "heading", "level": 1, "text": "H", "path": [1]}], "links": [{"blockId": "b1", "text": "x", "href": "/y", "target": "internal"}], "metadata": {"labels": ["l"]}}
    bad = good | {"docType": {"value": "poem", "confidence": 1, "origin": "user"}}
    (tmp_path / "x.json").write_text("\n".join([json.dumps(good), json.dumps(bad), "{broken"]))
    docs, blocks, links, rejects = files.read_json(spark, str(tmp_path))
    assert docs.count() == 1 and blocks.first()["text"] == "H" and links.first()["href"] == "/y"
    assert sorted(r["reject_reason"] for r in rejects.collect()) == ["doc_type", "schema"]
    b = lines.paragraphs(spark.createDataFrame([(1, "a\n\n b"), (2, None)], "k int, t string"), "k", "t")
    assert [(r["uri"], r["text"]) for r in b.orderBy("pos").collect()] == [("1", "a"), ("1", " b")]
    (tmp_path / "f" / "g").mkdir(parents=True)
    for name in ("a.docx", "~$a.docx", "n.txt", "g/b.PDF"):
        (tmp_path / "f" / name).write_bytes(b"x")
    assert sorted(r["path"].rpartition("/")[2] for r in files.scan(spark, str(tmp_path / "f")).select("path").collect()) == ["a.docx", "b.PDF"]


def test_stores(spark):
    old = spark.createDataFrame([("k", 1, "old"), ("same", 5, "old")], "k string, at int, v string")
    new = spark.createDataFrame([("k", 2, "new"), ("same", 5, "new"), ("l", 1, "new")], "k string, at int, v string")
    assert {r["k"]: r["v"] for r in stores.upsert(old, new, ["k"], "at").collect()} == {"k": "new", "same": "new", "l": "new"}
    gate = stores.model_gate(spark.createDataFrame([("a", "u", 10), ("b", "u", 300000), ("c", "v", 1)], "uri string, user_id string, chars int"), spark.createDataFrame([("v", 200)], "user_id string, calls int"), True)
    assert {r["uri"]: r["gate"] for r in gate.collect()} == {"a": None, "b": "too-large", "c": "quota"}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        ingest.upsert_stream(stream, str(tmp_path / "out"), ["k"], "at", str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([("b", 9, "late")], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert {r["k"]: r["v"] for r in ingest.current(rows, str(tmp_path / "out")).collect()} == {"a": "y", "b": "late"}


def test_exports(spark):
    """The reports' columns, orders and labels, as rows and as files."""
    docs, _, _ = tables(spark, {"/d/u.docx": [para("x")], "/d/failed.docx": []})
    docs = docs.withColumn("error", F.when(F.col("uri").contains("failed"), "no zip"))
    scores = frame(spark, [{"uri": "/d/u.docx", "structure": 100, "context": 100, "metadata": 94, "total": 99, "grade": "A"}], "uri string, structure int, context int, metadata int, total int, grade string")
    ddl = f"uri string, id string, rule_id string, severity string, axis string, message string, why string, evidence string, before string, after string, anchor {model.ANCHOR}"
    base = {"uri": "/d/u.docx", "rule_id": "R", "severity": "info", "axis": "structure", "message": "<m>", "why": "w", "evidence": "\x01e", "after": "new"}
    spot = dict.fromkeys(f.name for f in model.schema(f"a {model.ANCHOR}")["a"].dataType) | {"kind": "docx", "paragraph_index": 2}
    found = frame(spark, [base | {"id": "2"}, base | {"id": "1", "severity": "error", "axis": "metadata", "anchor": tuple(spot.values()), "after": None}, base | {"id": "3", "severity": "error"}], ddl)
    assert [tuple(r) for r in exports.summary_rows(docs, scores, found).collect()] == [("failed.docx", "/d/failed.docx", 0, "-", 0, 0, 0, "no zip"), ("u.docx", "/d/u.docx", 99, "A", 2, 0, 1, "완료")]
    assert [tuple(r) for r in exports.finding_rows(docs, found).collect()] == [
        ("u.docx", "오류", "R", "구조", "문서 전체", "<m>", "w", "new"), ("u.docx", "오류", "R", "메타데이터", "3번째 문단", "<m>", "w", ""), ("u.docx", "참고", "R", "구조", "문서 전체", "<m>", "w", "new"),
    ]
    traces = frame(
        spark, [{"id": "b", "rule_id": "TRC006", "severity": "error", "message": "m", "why": "w", "evidence": "A: x", "documents": ["u", "v"], "titles": ["T", "V"], "subject_id": "REQ-1"}, {"id": "a", "rule_id": "TRC005", "severity": "info", "message": "m", "why": "w", "documents": ["u"], "titles": ["T"]}],
        "id string, rule_id string, severity string, message string, why string, evidence string, documents array<string>, titles array<string>, subject_id string",
    )
    assert [tuple(r) for r in exports.trace_rows(traces).collect()] == [("오류", "TRC006", "REQ-1", "T (u)\nV (v)", "m", "w\nA: x"), ("참고", "TRC005", "", "T (u)", "m", "w")]
    _, blocks = office.read(exports.lint_workbook(docs, scores, found), "xlsx")
    assert [b["text"] for b in blocks if b["kind"] == "heading"] == ["요약", "지적"] and blocks[1]["headers"] == list(exports.SUMMARY)
    _, blocks = office.read(exports.trace_workbook(traces), "xlsx")
    assert blocks[0]["text"] == "추적성" and blocks[1]["rows"][0] == ["심각도", "규칙", "식별자", "문서", "내용", "이유"]
    html = exports.lint_html("R", docs, scores, found)
    assert "&lt;m&gt;" in html and "no zip" in html
    assert model.complete(docs, model.DOCUMENTS).columns == docs.columns[:-1]


def test_pages_that_repeat(spark):
    """A page that stands twice counts once; another version of it keeps its own neighbours."""
    pages = [("u", "<p>one</p><p>two</p>"), ("u", "<p>one</p><p>two</p>"), ("u", "<p>other</p><p>words</p>")]
    got = wiki.page_blocks(spark.createDataFrame(pages, "uri string, body string")).select("pos", "text", "anchor.quote_prefix", "anchor.quote_suffix").collect()
    assert sorted(map(tuple, got)) == [(0, "one", None, "two"), (0, "other", None, "words"), (1, "two", "one", None), (1, "words", "other", None)]
