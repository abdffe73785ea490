"""Small inputs of kinds that the test tables don't hold, for queries on sources, prompts and answers; what must come out of them
is written as rows beside each query (see ``catalog``)."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..sources import exports, office, pdf

PAGE = (
    "<h1>Title</h1><p>Some <b>text</b></p><ac:structured-macro ac:name='info'><ac:rich-text-body><p>Mind this</p></ac:rich-text-body></ac:structured-macro><h3>Deep</h3><h2>Part</h2>"
    "<table><tbody><tr><th>Name</th><th>Value</th></tr><tr><td>a</td><td>1</td></tr></tbody></table>"
    "<p>See <ac:link><ri:page ri:content-title='Other page'/></ac:link> and <a href='https://x.example/a'>this site</a> and <a href='#top'>up</a></p>"
    "<ul><li>one</li><li>two<ul><li>in</li></ul></li></ul><ac:image ac:alt='A flow'><ri:attachment ri:filename='flow.png'/></ac:image>"
    "<ac:structured-macro ac:name='code'><ac:parameter ac:name='language'>json</ac:parameter><ac:plain-text-body><![CDATA[{\"a\": \"<b>\"}]]></ac:plain-text-body></ac:structured-macro>"
    "<ac:structured-macro ac:name='drawio'/>"
)


def pages(spark: SparkSession) -> DataFrame:
    """A page that stands twice, one of broken HTML and one without any."""
    rows = [("u", PAGE, "7", "S"), ("u", PAGE, "7", "S"), ("html", "<p>one<p>two<br>three<blockquote>q</blockquote><script>var t='<p>';</script><a href='/download/attachments/7/f.pdf'>f</a>", None, None), ("none", None, None, None)]
    return spark.createDataFrame(rows, "uri string, body string, page_id string, space string")


def payloads(spark: SparkSession) -> DataFrame:
    from ..sources.wiki import PAYLOAD

    def row(number, title, labels=(), properties="{}", when="2026-01-02", who="Ann"):
        return (number, "page", title, ("S",), (3, when), ((who, "a"),), [("Home",)], (([(x,) for x in labels],), properties), (("<p>x</p>",),))

    rows = [row("7", "Plan", ["x", " Meeting  Notes "]), row("8", "Steps", properties='{"k": "how-to-article"}', when=""), row("9", "Else", who="")]
    return spark.createDataFrame(rows, model.schema(PAYLOAD))


def _zip(parts: dict[str, str]) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="a" xmlns:p="p" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def office_files(spark: SparkSession) -> DataFrame:
    """A document, a workbook, slides and a damaged file, with what the file system knows of one of them."""

    def p(text, props="", bold=False, size=None):
        run = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{size}"/>' if size else "")
        return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"

    def row(*cells, bold=False):
        return "<w:tr>" + "".join(f"<w:tc>{p(x, bold=bold)}</w:tc>" for x in cells) + "</w:tr>"

    def shape(kind, *texts):
        body = "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts)
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{len(texts)}"/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>'

    item = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'
    docx = _zip(
        {
            "word/styles.xml": f'<w:styles {_W}><w:style w:styleId="a1"><w:name w:val="heading 1"/></w:style></w:styles>',
            "word/numbering.xml": f'<w:numbering {_W}><w:abstractNum w:abstractNumId="5"><w:lvl><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num></w:numbering>',
            "word/document.xml": f"<w:document {_W}><w:body>{p('Head', '<w:pStyle w:val=\"a1\"/>')}{p('Body text')}{p('Looks like a head', bold=True, size=32)}{p('one', item)}{p('two', item)}<w:tbl>{row('N', 'V', bold=True)}{row('a', '1')}{row('b', '2')}</w:tbl></w:body></w:document>",
            "docProps/core.xml": '<cp xmlns:dc="d"><dc:title>From core</dc:title><dc:creator>Me</dc:creator></cp>',
        }
    )
    xlsx = bytearray(exports.workbook([("First", ("Name", "Count"), [("a", 1), ("b", 2)]), ("Blank", (), [])]))
    pptx = _zip(
        {
            "ppt/presentation.xml": f'<p:presentation {_A}><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": _RELS.format('<Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/>'),
            "ppt/slides/slide1.xml": f"<p:sld {_A}><p:cSld><p:spTree>{shape('other', 'Last')}</p:spTree></p:cSld></p:sld>",
            "ppt/slides/slide2.xml": f"<p:sld {_A}><p:cSld><p:spTree>{shape('title', 'First slide')}<p:grpSp>{shape('body', 'x', 'y')}</p:grpSp></p:spTree></p:cSld></p:sld>",
            "ppt/slides/_rels/slide2.xml.rels": _RELS.format('<Relationship Id="n" Target="../notesSlides/n1.xml"/>'),
            "ppt/notesSlides/n1.xml": f"<p:notes {_A}><p:spTree>{shape('body', 'Say this')}</p:spTree></p:notes>",
        }
    )
    rows = [("/d/a.docx", docx, "Ann"), ("/d/b.xlsx", xlsx, None), ("/d/c.v2.pptx", pptx, None), ("/d/bad.docx", bytearray(b"no zip"), None), ("/d/x.txt", bytearray(b""), None)]
    return spark.createDataFrame(rows, "path string, content binary, author string")


def parsed_office(spark: SparkSession) -> DataFrame:
    return office.parse_files(office_files(spark))


def pdf_items(spark: SparkSession) -> DataFrame:
    rows = [(" ", 720, 10), ("Big", 700, 20), (" ", 700, 20), ("title", 700, 20), ("body one", 650, 10), (" more", 648, 10), ("next", 630, 10), ("Sub", 600, 14), ("end of it", 580, 10)]
    first = [("u", 1, i, t, 10.0 * i, float(y), 5.0, float(z)) for i, (t, y, z) in enumerate(rows)]
    return spark.createDataFrame([*first, ("u", 2, 0, "page two", 0.0, 700.0, 5.0, 10.0), ("v", 1, 0, "plain", 0.0, 9.0, 5.0, 10.0)], pdf.ITEMS)


def ir_lines(spark: SparkSession) -> DataFrame:
    """Documents in JSON, read as ``files.read_json`` does: a whole one, one of an unknown type, one of a later version, and one that is no JSON."""
    from ..sources.files import IR

    good = {
        "schemaVersion": 1, "source": {"kind": "docx", "uri": "u"}, "title": "T", "docType": {"value": "guide", "confidence": 1, "origin": "user"}, "metadata": {"labels": ["l"]},
        "blocks": [{"id": "b1", "kind": "heading", "level": 1, "text": "H", "path": [1]}, {"id": "b2", "kind": "list", "ordered": True, "items": ["x", "y"], "depth": 1}],
        "links": [{"blockId": "b1", "text": "x", "href": "/y", "target": "internal", "status": "ok"}],
    }
    bad = good | {"docType": {"value": "poem", "confidence": 1, "origin": "user"}, "source": {"kind": "docx", "uri": "bad"}}
    later = good | {"schemaVersion": 2, "source": {"kind": "docx", "uri": "later"}}
    lines = [json.dumps(x) for x in (good, bad, later)] + ["{broken"]
    read = F.from_json("value", IR, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return spark.createDataFrame([(x,) for x in lines], "value string").select(read.alias("d")).select("d.*")


def corpus(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Four documents that define, refer to and contradict each other."""
    texts = {
        "w/1": ("Rules", "requirement", ["REQ-001 and REQ-002: at most 3 retries.", "REQ-003 holds"]), "w/2": ("REQ-003 in detail", "design", ["REQ-002 allows 5 retries, REQ-003"]),
        "w/3": ("TC-101 and TC-102", "guide", ["They test REQ-001 and REQ-003"]), "w/4": ("Else", "guide", ["See REQ-014"]),
    }
    docs = spark.createDataFrame([(u, "confluence", t, d, 0.0, "llm", ["l"], "o") for u, (t, d, _) in texts.items()], "uri string, source_kind string, title string, doc_type string, doc_type_confidence double, doc_type_origin string, labels array<string>, owner string")
    blocks = spark.createDataFrame([(u, i, f"b{i + 1}", "paragraph", x) for u, (_, _, xs) in texts.items() for i, x in enumerate(xs)], "uri string, pos int, id string, kind string, text string")
    links = spark.createDataFrame([("w/2", 0, "b1", "next", "w/9//?x#y", "internal", "unchecked"), ("w/2", 1, "b1", "first", "w/1", "internal", "unchecked")], "uri string, link_pos int, block_id string, text string, href string, target string, status string")
    return model.complete(docs, model.DOCUMENTS), model.complete(blocks, model.BLOCKS), model.complete(links, model.LINKS)


def long_corpus(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A document of several chunks, a short one, one that a model fails on, and one of a type left to a model."""
    head = lambda t: ("heading", 1, t)
    para = lambda t: ("paragraph", None, t)
    docs = {"long": [head("Part"), para("x" * 300), head("Next"), para("y" * 300)], "short": [para("Retries three times.")], "bad": [para("boom")]}
    documents = spark.createDataFrame([(u, f"Title {u}", "guide" if u != "bad" else "unknown", 0.0, "llm" if u == "bad" else "user") for u in docs], "uri string, title string, doc_type string, doc_type_confidence double, doc_type_origin string")
    blocks = spark.createDataFrame([(u, i, f"b{i + 1}", *b) for u, bs in docs.items() for i, b in enumerate(bs)], "uri string, pos int, id string, kind string, level int, text string")
    return model.complete(documents, model.DOCUMENTS), model.complete(blocks, model.BLOCKS)


def model_answer(system: str, user: str) -> str:
    """A made-up model, called with a prompt: finds one thing in the short document, contradicts one pair, and fails on what goes boom."""
    if "boom" in user:
        raise RuntimeError("no answer")
    if "summary" in system:
        return json.dumps({"summary": " It is long. "})
    if "contradict" in system:
        both = "3 retries" in user and "5 retries" in user
        lost = {"subjectId": "REQ-003", "quoteA": "not there at all", "quoteB": "REQ-003", "why": "w", "confidence": 0.9}
        return json.dumps({"contradictions": [{"subjectId": "REQ-002", "quoteA": "at most 3 retries", "quoteB": "allows 5 retries", "why": "how many?", "confidence": 0.9}, lost] if both else []})
    found = [{"ruleId": "CTX001", "blockId": "b1", "evidence": "three times", "why": "of what?", "confidence": 0.9}, {"ruleId": "CTX001"}] if "Retries" in user else []
    return "```json\n" + json.dumps({"findings": found}) + "\n```"
