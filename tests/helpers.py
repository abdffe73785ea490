"""Small documents for tests."""

from __future__ import annotations

from datetime import datetime, timezone

from folioscope import model
from folioscope.operators import rules
from folioscope.operators.ruleset import Ruleset

NOW = datetime(2026, 8, 22, tzinfo=timezone.utc)


def frame(spark, rows: list[dict], ddl: str):
    schema = model.schema(ddl)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def heading(level, text="A heading"):
    return {"kind": "heading", "level": level, "text": text}


def para(text, **more):
    return {"kind": "paragraph", "text": text, **more}


def tables(spark, docs: dict[str, list[dict]], links: dict[str, list[dict]] | None = None, meta: dict[str, dict] | None = None):
    """documents, blocks and links of documents given as lists of blocks by uri."""
    base = {"source_kind": "confluence", "title": "A plain title of a document", "doc_type": "unknown", "labels": ["l"], "owner": "o", "doc_type_confidence": 0.0, "doc_type_origin": "llm"}
    documents = frame(spark, [base | {"uri": u} | (meta or {}).get(u, {}) for u in docs], model.DOCUMENTS)
    blocks = frame(spark, [{"uri": u, "pos": i, "id": f"b{i + 1}", "path": [], **b} for u, bs in docs.items() for i, b in enumerate(bs)], model.BLOCKS)
    found = frame(spark, [{"uri": u, "link_pos": i, "block_id": "b1", "target": "internal", "href": "/x", "text": "A plain text", "status": "unchecked", **x} for u, ls in (links or {}).items() for i, x in enumerate(ls)], model.LINKS)
    return documents, blocks, found


def fired(spark, docs, links=None, meta=None, ruleset: Ruleset | None = None) -> dict[str, set]:
    """For each document the (rule, block) pairs that fire."""
    rows = rules.findings(*tables(spark, docs, links, meta), ruleset, NOW).select("uri", "rule_id", "block_id").collect()
    out = {u: set() for u in docs}
    for r in rows:
        out[r["uri"]].add((r["rule_id"], r["block_id"]))
    return out
