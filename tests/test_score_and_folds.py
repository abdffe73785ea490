from helpers import frame, heading, para, tables
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.functions import fixed
from folioscope.operators import enrich, score

FOUND = "uri string, axis string, rule_id string, severity string"


def _scores(spark, by_doc):
    rows = [{"uri": u, "axis": a, "rule_id": r, "severity": s} for u, found in by_doc.items() for a, r, s in found]
    docs = spark.createDataFrame([(u,) for u in by_doc], "uri string")
    return {r["uri"]: r.asDict() for r in score.scores(docs, frame(spark, rows, FOUND)).collect()}


def test_known_scores(spark):
    got = _scores(
        spark,
        {
            "none": [], "e": [("structure", "S1", "error")], "w": [("structure", "S1", "warning")], "i": [("structure", "S1", "info")], "e5": [("structure", "S1", "error")] * 5,
            "four": [("structure", f"S{i}", "error") for i in range(4)], "many": [("context", f"C{i % 9}", "error") for i in range(30)], "c": [("context", "C1", "error")],
        },
    )
    assert [got["none"][a] for a in fixed.AXES] == [100] * 3 and got["none"]["total"] == 100 and got["none"]["grade"] == "A"
    assert [got[x]["structure"] for x in ("e", "w", "i", "e5", "four")] == [85, 94, 98, 53, 40]
    assert got["many"]["context"] == 0 and got["c"]["total"] == 93


def test_grades(spark):
    rows = spark.createDataFrame([(t,) for t in (90, 89, 75, 74, 60, 59)], "t int").select(score.grade(__import__("pyspark").sql.functions.col("t"))).collect()
    assert [r[0] for r in rows] == list("ABBCCD")


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(fixed.AXES), st.integers(0, 3), st.sampled_from(fixed.SEVERITIES)), max_size=30), min_size=1, max_size=6))
def test_closed_form_is_the_stepwise_score(spark, docs):
    severity = {}
    by_doc = {f"d{i}": [(a, f"{a}{n}", severity.setdefault((a, n), s)) for a, n, s in found] for i, found in enumerate(docs)}
    got = _scores(spark, by_doc)
    for uri, found in by_doc.items():
        axes, seen = dict.fromkeys(fixed.AXES, 100), {}
        for a, r, s in found:
            seen[r] = seen.get(r, 0) + 1
            axes[a] = max(0, axes[a] - (fixed.PENALTY[s] if seen[r] <= 3 else 1))
        assert {a: got[uri][a] for a in fixed.AXES} == axes


def test_chunks(spark):
    docs = {"eight": [b for i in range(8) for b in (heading(2, f"h{i}"), para("x" * 500))], "one": [heading(1), para("x" * 3000)], "none": []}
    _, blocks, _ = tables(spark, docs)
    got = {}
    for r in enrich.chunks(blocks, 1200).orderBy("uri", "chunk_index").collect():
        got.setdefault(r["uri"], []).append(r)
    assert [r["chunk_index"] for r in got["eight"]] == list(range(len(got["eight"]))) and len(got["eight"]) > 1
    assert [b for r in got["eight"] for b in r["block_ids"]] == [f"b{i + 1}" for i in range(16)]
    assert all(r["markdown"].split("--> ")[1].startswith("## ") for r in got["eight"])
    assert len(enrich.chunks(blocks, 500).where("uri = 'one'").collect()) == 1 and "none" not in got


def test_paths_and_outline(spark):
    docs = {"a": [heading(1), para("x"), heading(2), para("x"), heading(1), para("x")], "b": [heading(2), heading(4)]}
    _, blocks, _ = tables(spark, docs)
    got = {(r["uri"], r["pos"]): list(r["path"]) for r in enrich.heading_paths(blocks).collect()}
    assert got == {("a", 0): [1], ("a", 2): [1, 1], ("a", 4): [2], ("b", 0): [0, 1], ("b", 1): [0, 1, 0, 1]}
    assert {r["uri"]: r["outline"] for r in enrich.outline(blocks).collect()}["a"] == "- A heading\n  - A heading\n- A heading"


def test_hash_classes(spark):
    same = [heading(1), para("text")]
    docs = {"a": same, "b": same, "labels": same, "text": [heading(1), para("other")], "label": same, "when": same}
    meta = {"labels": {"labels": ["y", "x"]}, "a": {"labels": ["x", "y"]}, "b": {"labels": ["x", "y"]}, "text": {"labels": ["x", "y"]}, "label": {"labels": ["x", "y", "z"]}, "when": {"labels": ["x", "y"], "modified_at": "2020-01-01", "version": "3"}}
    h = {r["uri"]: r["document_hash"] for r in enrich.document_hash(*tables(spark, docs, meta=meta)).collect()}
    assert h["a"] == h["b"] == h["labels"] == h["when"] and len({h["a"], h["text"], h["label"]}) == 3


def test_quotations_squeeze_a_text_once(spark):
    """Before, the search for white space ran anew for each use of a text, and whole texts were shuffled for their ends."""
    blocks = tables(spark, {"u": [para(" a  b" * 60), para(""), para("end\n\nof it")]})[1].select("uri", "pos", "id", "kind", "text", "alt", "caption", "asset_ref", "rendered_text", "name", "items", "headers", "rows", "notes")
    quotes = enrich.quotes(blocks)
    got = [tuple(r) for r in quotes.orderBy("pos").collect()]
    whole = " ".join(["a b"] * 60)
    assert got == [("u", 0, whole[:120], None, "paragraph"), ("u", 1, "paragraph", whole[-30:], "end of it"), ("u", 2, "end of it", "paragraph", None)]
    for df in (quotes, enrich.beginnings(blocks)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("(?U)\\s+") == 1
    assert {r["id"] for r in enrich.locate(enrich.beginnings(blocks), blocks).collect()} == {"b1", "b3"}
