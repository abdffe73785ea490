import json

from helpers import frame, heading, para, tables
from pyspark.sql import functions as F

from folioscope.functions.text import evidence_found, normal_uri
from folioscope.operators import grounding, trace
from folioscope.operators.ruleset import resolve


def corpus(spark):
    docs = {
        "w/4001": [para("REQ-001 and REQ-002: at most 3 retries."), para("REQ-003 holds")], "w/4002": [heading(1, "REQ-003 in detail"), para("REQ-002 allows 5 retries, REQ-003")],
        "w/4003": [heading(1, "TC-101 and TC-102"), para("They test REQ-001 and REQ-003")], "w/4004": [para("See REQ-014")],
    }
    meta = {"w/4001": {"doc_type": "requirement"}, "w/4002": {"doc_type": "design"}, "w/4003": {"doc_type": "guide"}, "w/4004": {"doc_type": "guide"}}
    return tables(spark, docs, {"w/4002": [{"href": "w/4900/?x#y"}, {"href": "w/4001"}]}, meta)


def test_trace_corpus(spark):
    documents, blocks, links = corpus(spark)
    m = trace.mentions(documents, blocks).cache()
    found = {r["id"]: r["documents"] for r in trace.trace_findings(documents, m, links).collect()}
    assert found == {"TRC001:REQ-014": ["w/4004"], "TRC003:REQ-002": ["w/4001"], "TRC004:REQ-003": ["w/4001", "w/4002"], "TRC005:w/4002:w/4900": ["w/4002"]}
    assert m.select("id").distinct().count() == 6
    pairs = [(r["uri_a"][-1], r["uri_b"][-1], r["shared_ids"]) for r in trace.top_pairs(m).orderBy("uri_a", "uri_b").collect()]
    assert pairs == [("1", "2", ["REQ-002", "REQ-003"]), ("1", "3", ["REQ-001", "REQ-003"]), ("2", "3", ["REQ-003"])]
    assert trace.top_pairs(m, 1).count() == 1 and trace.shared_id_pairs(m).count() == 3

    top = trace.top_pairs(m)
    answer = json.dumps({"contradictions": [{"subjectId": "REQ-002", "quoteA": "at most 3 retries", "quoteB": "allows 5 retries", "why": "w", "confidence": 0.9}, {"subjectId": "REQ-003", "quoteA": "not there at all, really", "quoteB": "REQ-003", "why": "w", "confidence": 0.9}]})
    answers = spark.createDataFrame([("w/4001", "w/4002", f"```json\n{answer}\n```")], "uri_a string, uri_b string, answer string")
    got = grounding.contradictions(answers, trace.pair_snippets(m, top), top).collect()
    assert [r["id"] for r in got] == ["TRC006:w/4001:w/4002:REQ-002"]


def test_ids_and_uris(spark):
    rows = spark.createDataFrame([("REQ-1 TC-2 PROJ-3 REQ-1 XREQ-12",)], "t string").select(F.inline(trace.matched_ids(F.col("t")))).collect()
    assert {(r["id"], r["kind"]) for r in rows} == {("REQ-1", "requirement"), ("TC-2", "test"), ("PROJ-3", "ticket"), ("REQ-12", "requirement"), ("XREQ-12", "ticket")}
    got = spark.createDataFrame([("https://wiki/pages/12/?a=1#sec",), ("/",), ("https://a/b//",), ("//",)], "u string").select(normal_uri(F.col("u"))).collect()
    assert [r[0] for r in got] == ["https://wiki/pages/12", "/", "https://a/b", ""]


def test_pairs_of_common_ids_against_brute_force(spark):
    """Whatever counts as common, the pairs are those of a full comparison, ties included."""
    import random
    from collections import Counter
    from itertools import combinations

    r = random.Random(4)
    docs = {f"d{i:02}": {f"REQ-{j}" for j in range(12) if r.random() < (0.9 if j < 3 else 0.15)} | ({"AB-1"} if i % 2 else set()) for i in range(40)}
    m = spark.createDataFrame([(u, x) for u, xs in docs.items() for x in xs] * 2, "uri string, id string")
    n = Counter({(a, b): len(docs[a] & docs[b]) for a, b in combinations(sorted(docs), 2) if docs[a] & docs[b]})
    want = sorted(n.items(), key=lambda x: (-x[1], x[0]))[:15]
    for common in (1, 5, 10, 100):
        assert trace.pairs_considered(m, common).first()[0] == len(n)
        got = sorted(((x["uri_a"], x["uri_b"]), x["n_shared"]) for x in trace.top_pairs(m, 15, common).collect())
        assert got == sorted(want), common
    only = spark.createDataFrame([(f"u{i:03}", "UTF-8") for i in range(400)], "uri string, id string")
    assert [(x["uri_a"], x["uri_b"]) for x in trace.top_pairs(only, 3, 10).orderBy("uri_a", "uri_b").collect()] == [("u000", "u001"), ("u000", "u002"), ("u000", "u003")]
    assert trace.pairs_considered(only, 10).first()[0] == 400 * 399 // 2


def test_evidence(spark):
    long = "a" * 2001 + " the word"
    cases = [("the words", "so the  words stand", True), ("the wards are here", "that the words are here now", True), ("", "text", False), (" ", "text", False), ("longer than it", "short", False), ("the wird", long, False), ("the word", long, True), ("nothing like it", "something else", False), (None, "x", False), ("x", None, False)]
    got = spark.createDataFrame([(i, n, h) for i, (n, h, _) in enumerate(cases)], "i int, n string, h string").select("i", evidence_found(F.col("n"), F.col("h")).alias("e")).orderBy("i").collect()
    assert [bool(r["e"]) for r in got] == [c for _, _, c in cases]


def test_verification_reasons(spark):
    docs = {"d": [para("The service retries three times before it fails.")]}
    t = tables(spark, docs, meta={"d": {"doc_type": "guide"}})
    good = {"ruleId": "CTX001", "blockId": "b1", "evidence": "retries three times", "why": "w", "confidence": 0.9}
    items = [good, good | {"blockId": "b99"}, good | {"ruleId": "CTX999"}, good | {"ruleId": "STR001"}, good | {"ruleId": "CTX002"}, good | {"ruleId": "CTX007"}, good | {"confidence": 0.3}, good | {"evidence": "nothing of the kind is said"}, {"ruleId": "CTX001"}, good | {"confidence": 0.7, "ruleId": "CTX003"}, good | {"confidence": 0.95, "ruleId": "CTX003", "suggestion": {"before": "not in it at all", "after": "x"}}]
    answers = spark.createDataFrame([("d", json.dumps({"findings": items})), ("d2", "no json")], "uri string, answer string")
    ruleset = resolve({"id": "r", "name": "r", "version": 1, "rules": {"CTX002": {"enabled": False}}})
    v = grounding.verify(grounding.candidates(answers), t[0], t[1], ruleset).cache()
    reasons = [r["reject_reason"] for r in v.where("uri = 'd'").orderBy("seq").collect()]
    assert sorted(map(str, reasons)) == sorted(map(str, [None, "unknown-block", "unknown-rule", "unknown-rule", "rule-disabled", "doctype-mismatch", "low-confidence", "evidence-not-found", "schema-invalid", None, None]))
    assert [r["reject_reason"] for r in v.where("uri = 'd2'").collect()] == ["schema-invalid"]
    kept = {r["rule_id"]: (r["confidence"], r["before"]) for r in grounding.accepted(v, ruleset).collect()}
    assert kept == {"CTX001": (0.9, None), "CTX003": (0.95, None)}


def test_prompts_and_provider(spark):
    t = tables(spark, {"d": [heading(1, "Part"), para("x" * 300)] * 3})
    p = grounding.chunk_prompts(t[0], t[1], limit=500)
    assert p.count() == 3 and grounding.summary_prompts(t[1], 500).count() == 1
    got = grounding.ask(p, lambda system, user: json.dumps({"n": len(user)}) if "Part" in user else 1 / 0, tasks=2).collect()
    assert all(r["ok"] for r in got)
    assert frame(spark, [], "a string").count() == 0


def test_whole_analysis(spark):
    """Summaries are told with the chunks of long documents; failures cost a status, not the rules' findings."""
    from folioscope.engine import Engine

    docs = {"long": [heading(1, "Part"), para("x" * 9000), heading(1, "Next"), para("y" * 9000)], "short": [para("Retries three times.")], "bad": [para("boom")], "held": [para("never asked")]}
    documents, blocks, links = tables(spark, docs)

    def model(system: str, user: str) -> str:
        if "boom" in user or "never" in user:
            raise RuntimeError("no answer")
        if "summary" in system:
            return json.dumps({"summary": "It is long."})
        found = [{"ruleId": "CTX001", "blockId": "b1", "evidence": "three times", "why": "which?", "confidence": 0.9}] if "Retries" in user else []
        if "Part" in user:
            assert "Summary: It is long." in user
        return "```json\n" + json.dumps({"findings": found + ([{"ruleId": "CTX001"}] if "Retries" in user else [])}) + "\n```"

    gate = spark.createDataFrame([("held", "quota"), ("short", None)], "uri string, gate string")
    found, scores = Engine(spark).lint(documents, blocks, links, model=model, gate=gate)
    assert [(r["uri"], r["why"]) for r in found.where("source = 'llm'").collect()] == [("short", "which?")]
    state = {r["uri"]: (r["model_status"], r["rejected"], r["calls"], r["truncated"]) for r in scores.collect()}
    assert state == {"long": ("ok", 0, 3, False), "short": ("ok", 1, 1, False), "bad": ("failed", 0, 1, False), "held": ("skipped", 0, 0, False)}
    alone, _ = Engine(spark).lint(documents, blocks, links)
    assert alone.count() == found.count() - 1 and alone.where("why = ''").count() == 0


def test_whole_trace(spark):
    from folioscope.engine import Engine

    documents, blocks, links = corpus(spark)

    def model(system: str, user: str) -> str:
        said = [{"subjectId": "REQ-002", "quoteA": "at most 3 retries", "quoteB": "allows 5 retries", "why": "w", "confidence": 0.9}] if "5 retries" in user and "3 retries" in user else []
        return json.dumps({"contradictions": said})

    found, summary = Engine(spark).trace(documents, blocks, links, model, 2)
    got = {r["id"]: (r["titles"], r["why"]) for r in found.collect()}
    assert "TRC006:w/4001:w/4002:REQ-002" in got and all(t and w for t, w in got.values()) and len(got) == 5
    s = summary.first()
    assert (s["document_count"], s["id_count"], s["pairs_considered"], s["pairs_analyzed"]) == (4, 6, 3, 2)


def test_answers_and_schemas(spark):
    rows = [('"plain"', "plain"), ('[{"type": "text", "text": "a"}, {"text": "b"}, {"x": 1}]', "ab"), ("null", ""), ("{}", "")]
    got = spark.createDataFrame(rows, "m string, want string").select(grounding.answer_text(F.col("m")).alias("t"), "want").collect()
    assert [r["t"] for r in got] == [r["want"] for r in got]
    schema = {"type": "object", "properties": {"s": {"type": "string", "nullable": True}, "l": {"type": "array", "items": {"type": "number", "nullable": False}}}}
    assert grounding.standard_schema(schema) == {"type": "object", "properties": {"s": {"type": ["string", "null"]}, "l": {"type": "array", "items": {"type": "number"}}}}


def test_quotations_with_edits(spark):
    """The quick test for shared pieces loses no quotation that a window is near to."""
    import random

    r = random.Random(2)

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    cases = []
    for _ in range(60):
        text = "".join(r.choice("abc ") for _ in range(80)).strip()
        text = " ".join(text.split())
        at, size = r.randrange(0, 30), r.randrange(5, 35)
        quote = list(text[at : at + size])
        for _ in range(r.randrange(0, 6)):
            quote[r.randrange(len(quote))] = r.choice("abcd")
        cases.append((" ".join("".join(quote).split()), text))

    def held(n, h):
        off = int(len(n) * 0.1 + 1e-9)
        return bool(n) and any(distance(h[i : i + len(n)], n) <= off for i in range(len(h) - len(n) + 1))

    got = spark.createDataFrame([(i, n, h) for i, (n, h) in enumerate(cases)], "i int, n string, h string").select("i", evidence_found(F.col("n"), F.col("h")).alias("e")).orderBy("i").collect()
    assert [bool(x["e"]) for x in got] == [held(n, h) for n, h in cases]


def test_texts_without_ids_are_told_by_what_a_match_needs(spark):
    """The quick search lets every text pass that holds an identifier, whatever the patterns."""
    assert [trace._needed(p) for p, _ in trace.fixed.ID_PATTERNS] == ["REQ-", "TC-", "-"]
    assert [trace._needed(p) for p in ("(?i)req-1", r"(a)\101", "a|b", "[A-Z]+", r"\Qa-b\E", "ab?c", "(x-)+y")] == [None, None, None, None, None, "a", "y"]
    texts = ["REQ-1", "TC-2 x", "AB-3", "no", "", "A-4", None, "req-5", "x y"]
    for patterns in (trace.fixed.ID_PATTERNS, ((r"(?i)req-\d", "a"), ("x", "b"))):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        ids, may = trace.matched_ids(F.col("t"), patterns), trace.may_name_ids(F.col("t"), patterns)
        assert df.where((F.size(ids) > 0) & ~may).count() == 0 and df.where(may).count() < len(texts)


def test_pairs_are_counted_without_being_made(spark):
    """An identifier in every document, beside many distinct sets, makes no pairs: before, the sets of common ones met each other."""
    n = 3000
    m = spark.range(n).select(F.format_string("u%05d", "id").alias("uri"), F.explode(F.array(F.lit("UTF-8"), F.concat(F.lit("REQ-"), F.col("id") % 50), F.concat(F.lit("TC-"), F.col("id") % 49))).alias("id"))
    assert trace.pairs_considered(m).first()[0] == n * (n - 1) // 2
    top = trace.top_pairs(m, 5).collect()
    assert [(r["uri_a"], r["uri_b"], r["n_shared"]) for r in top] == [(f"u{i:05}", f"u{i + 2450:05}", 3) for i in range(5)]
    plan = trace.pairs_considered(m)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_places_of_trace_findings_by_ranges(spark):
    """The places are those of one list, though no task numbers it all."""
    found = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "info").when(F.col("id") % 3 == 1, "error").otherwise("warning").alias("severity"), F.concat(F.lit("TRC00"), F.col("id") % 2).alias("rule_id"), F.format_string("x%05d", (F.col("id") * 7919) % 5000).alias("id")).repartition(7)
    got = trace.numbered(found)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    rank = {"error": 1, "warning": 2, "info": 3}
    rows = sorted(got.collect(), key=lambda r: (rank[r["severity"]], r["rule_id"], r["id"]))
    assert [r["nth"] for r in rows] == list(range(1, 5001)) and trace.numbered(found.limit(0)).count() == 0
