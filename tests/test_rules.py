"""Each rule on documents that break it and documents that keep it; all documents of a test run as one batch."""

from helpers import fired, heading, para, tables

from folioscope.operators import rules
from folioscope.operators.ruleset import Ruleset, RulesetError, from_yaml, resolve, rules_evaluated

import pytest


def expect(found, rule, yes: dict, no: tuple):
    for uri, block in yes.items():
        assert (rule, block) in found[uri], (rule, uri, found[uri])
    for uri in no:
        assert rule not in {r for r, _ in found[uri]}, (rule, uri, found[uri])


def table(rows, headers=(), layout=False):
    return {"kind": "table", "headers": list(headers), "rows": rows, "is_layout_table": layout}


def image(**more):
    return {"kind": "image", "asset_ref": "a.png", **more}


def test_structure_of_headings_and_sections(spark):
    docs = {
        "skip": [heading(1), heading(3)], "skip4": [heading(1), heading(4)], "even": [heading(1), heading(2)], "back": [heading(1), heading(2), heading(3), heading(1)], "first3": [heading(3)],
        "bare801": [para("x" * 801)], "bare800": [para("x" * 800)], "headed": [heading(1), para("x" * 2000)], "code": [para("x" * 100), {"kind": "code", "text": "x" * 2000, "lang": "c"}],
        "long": [heading(2), para("x" * 1501)], "fits": [heading(2), para("x" * 1500)], "three": [b for _ in range(3) for b in (heading(2), para("x" * 1000))], "lead": [para("x" * 1501), heading(1)],
        "empty": [],
    }
    found = fired(spark, docs)
    expect(found, "STR001", {"skip": "b2", "skip4": "b2"}, ("even", "back", "first3"))
    expect(found, "STR002", {"bare801": None}, ("bare800", "headed", "code", "empty"))
    expect(found, "STR003", {"long": "b1", "lead": "b1"}, ("fits", "three"))


def test_images_tables_lists_code_and_macros(spark):
    docs = {
        "hint": [para("See the table below."), image(alt="Costs by month and team")], "after": [image(alt="A long description"), para("The diagram shows it")],
        "has_table": [heading(1), para("table"), image(alt="described well"), table([["a", "b"], ["c", "d"]], ["x", "y"])], "ocr": [para("table"), image(alt="described well", ocr_text="words")], "plain": [para("text"), image(alt="described well")],
        "noalt": [image()], "file": [image(alt="image001.png")], "place": [image(alt="screenshot 3")], "one": [image(alt="x")], "caption": [image(caption="The flow of payments")], "blank_alt": [image(alt="", caption="The flow of payments")],
        "code3": [{"kind": "code", "text": "a\nb\nc"}], "code1": [{"kind": "code", "text": "a"}], "lang": [{"kind": "code", "text": "a\nb\nc", "lang": "sql"}],
        "row12": [table([["a", "b"]])], "flag": [table([["a", "b"], ["c", "d"]], layout=True)], "head": [table([["a", "b"], ["c", "d"]], ["x", "y"])], "grid": [table([["a", "b"], ["c", "d"]])], "col2": [table([["a"], ["b"]])], "no_rows": [table([])],
        "deep4": [{"kind": "list", "items": ["a"], "depth": 4, "ordered": False}], "deep3": [{"kind": "list", "items": ["a"], "depth": 3, "ordered": False}],
        "xls": [{"kind": "macro", "name": "viewxls"}], "PDF": [{"kind": "macro", "name": "ViewPDF", "rendered_text": ""}], "shown": [{"kind": "macro", "name": "excerpt-include", "rendered_text": "words"}], "toc": [{"kind": "macro", "name": "toc"}],
        "bold": [para("Like a heading", emphasized_as_heading=True)],
    }
    found = fired(spark, docs)
    expect(found, "STR004", {"hint": "b2", "after": "b1"}, ("has_table", "ocr", "plain"))
    expect(found, "STR005", {"noalt": "b1", "file": "b1", "place": "b1", "one": "b1"}, ("caption", "blank_alt", "hint"))
    expect(found, "STR006", {"code3": "b1"}, ("code1", "lang"))
    expect(found, "STR008", {"row12": "b1", "flag": "b1", "col2": "b1", "no_rows": "b1"}, ("head", "grid"))
    expect(found, "STR009", {"grid": "b1", "col2": "b1"}, ("head", "flag", "row12"))
    expect(found, "STR010", {"deep4": "b1"}, ("deep3",))
    expect(found, "STR012", {"xls": "b1", "PDF": "b1"}, ("shown", "toc"))
    expect(found, "STR013", {"bold": "b1"}, ("hint",))


def test_links_and_attachments(spark):
    docs = {u: [para("A short text.")] for u in ("here", "url", "korean", "good", "attached", "none", "broken")} | {"long": [para("x" * 300)]}
    file = {"target": "attachment", "text": "plan.pdf", "href": "/download/attachments/1/plan.pdf"}
    links = {"here": [{"text": "Click here!"}], "url": [{"text": "https://a.example"}], "korean": [{"text": "여기"}], "good": [{"text": "The plan"}], "attached": [file], "long": [file], "broken": [{"status": "broken"}, {"status": "broken"}, {"status": "ok"}]}
    found = fired(spark, docs, links)
    expect(found, "STR007", {"here": "b1", "url": "b1", "korean": "b1"}, ("good",))
    expect(found, "STR011", {"attached": "b1"}, ("long", "none"))
    rows = rules.findings(*tables(spark, docs, links)).where("rule_id = 'META006'").select("id").collect()
    assert sorted(r["id"] for r in rows) == ["META006:b1:0", "META006:b1:1"]


def test_metadata(spark):
    empty = [para("text")]
    docs = {u: empty for u in ("generic", "copy", "short", "good", "no_label", "no_owner", "old", "new", "odd_date", "pdf_full")} | {
        "pdf_empty": [], "docx_empty": [],
        "summary": [heading(1, "Summary"), para("x" * 1300)], "no_summary": [heading(1, "Part"), para("x" * 1300)], "lead": [para("x" * 120), heading(1, "Part"), para("x" * 1300)], "late": [heading(1), heading(1), heading(1, "Summary"), para("x" * 1300)],
        "owner_text": [para("owner: someone")], "owner_code": [{"kind": "code", "text": "owner: someone", "lang": "c"}],
        "meeting": [heading(2, "일시"), heading(2, "참석자"), heading(2, "결정 사항")], "meeting_all": [heading(2, "일시"), heading(2, "참석자"), heading(2, "결정사항"), heading(2, "Action Items")], "untyped": [heading(1)],
        "tbd": [para("It is TBD입니다.")], "writing": [para("작성 중인 문서")], "todo_code": [{"kind": "code", "text": "TODO", "lang": "c"}], "todo_head": [heading(1, "TODO")], "todo_in_head": [heading(1, "TODO later")], "word": [para("The TBDX is known")],
    }
    meta = {
        "generic": {"title": "회의록"}, "copy": {"title": "Plan (old)"}, "short": {"title": "ab"}, "good": {"title": "[2026-07-15] Review of the payment module"}, "no_label": {"labels": []}, "old": {"modified_at": "2023-01-01"},
        "new": {"modified_at": "2026-08-01"}, "odd_date": {"modified_at": "yesterday"}, "pdf_full": {"source_kind": "pdf"}, "pdf_empty": {"source_kind": "pdf"}, "docx_empty": {"source_kind": "docx"},
        "meeting": {"doc_type": "meeting-notes"}, "meeting_all": {"doc_type": "meeting-notes"},
    } | {u: {"owner": None} for u in ("no_owner", "owner_text", "owner_code")}
    found = fired(spark, docs, meta=meta)
    expect(found, "META001", {"generic": None, "copy": None, "short": None}, ("good",))
    expect(found, "META002", {"no_summary": "b1", "late": "b1"}, ("summary", "lead", "good"))
    expect(found, "META003", {"no_label": None}, ("good",))
    expect(found, "META004", {"no_owner": None, "owner_code": None}, ("owner_text", "good"))
    expect(found, "META005", {"old": None}, ("new", "odd_date", "good"))
    expect(found, "META007", {"meeting": None}, ("meeting_all", "untyped"))
    expect(found, "META008", {"tbd": "b1", "writing": "b1", "todo_in_head": "b1"}, ("todo_code", "todo_head", "word"))
    expect(found, "STR014", {"pdf_empty": None}, ("pdf_full", "docx_empty"))


def test_rulesets(spark):
    off = resolve({"id": "x", "name": "x", "version": 2, "rules": {"STR001": {"enabled": False}, "META003": {"appliesTo": ["design"]}, "STR010": {"options": {"maxDepth": 0}}}})
    docs = {"a": [heading(1), heading(3), {"kind": "list", "items": ["x"], "depth": 1, "ordered": False}]}
    found = fired(spark, docs, meta={"a": {"labels": []}}, ruleset=off)
    assert {r for r, _ in found["a"]} == {"STR010"}
    assert from_yaml("id: y\nname: y\nversion: 1\nweights: {structure: 0.5, context: 0.3, metadata: 0.2}\n").weights["structure"] == 0.5
    for bad in ({"id": "x"}, {"id": "x", "name": "x", "version": 1, "rules": {"NO1": {}}}, {"id": "x", "name": "x", "version": 1, "weights": {"structure": 0.9, "context": 0.9, "metadata": 0.2}}):
        with pytest.raises(RulesetError):
            resolve(bad)
    assert (rules_evaluated(Ruleset(), "design", True), rules_evaluated(Ruleset(), "guide", True), rules_evaluated(Ruleset(), "guide", False)) == (33, 32, 22)


def test_texts_are_not_shuffled_but_what_is_reported_of_them(spark):
    """A long text moves no bytes: before, whole blocks were shuffled for their neighbours' sake."""
    import re

    from folioscope.operators import rules
    from helpers import tables

    found = rules.findings(*tables(spark, {"u": [heading(1), para("x" * 900)]}), None, None).select("uri", "rule_id", "block_id", "evidence")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    narrow = re.findall(r"Project \[([^\]]*own#[^\]]*bare_image#[^\]]*)\]", plan)
    assert narrow and not any(re.search(r"(?<![A-Za-z_])(text|items|rows|caption|ocr_text)#", x) for x in narrow[:1])


def test_quick_words_stand_in_all_that_patterns_find(spark):
    from pyspark.sql import functions as F

    from folioscope.functions import fixed
    from folioscope.functions.text import may_hold

    texts = ["tbd", "a Todo b", "FixMe", "xxx", "작성중", "추후 작성", "미정", "what???", "Table", "a chart", "DIAGRAM", "표", "차트", "그래프", "다이어그램", "아키텍처", "플로우", "owner: a", "담당자：b", "POC :c", "plain", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for pattern, needs, n in ((fixed.DRAFT_MARK, fixed.DRAFT_MARK_NEEDS, 8), (fixed.TABLE_HINT, fixed.TABLE_HINT_NEEDS, 9), (fixed.OWNER_TEXT, fixed.OWNER_TEXT_NEEDS, 3)):
        assert df.where(t.rlike(pattern)).count() == n
        assert df.where(t.rlike(pattern) & ~may_hold(t, needs)).count() == 0 and df.where(~may_hold(t, needs)).count() > 5
