"""Findings made by a model: prompts for it, and the test of its answers against the documents.

The model itself is a seam: a table of answers replayed by key, or any function of prompts. What comes
back is kept only if rule, block and quotation hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import block_text, evidence_found
from .enrich import chunks, outline
from .ruleset import Ruleset
from .score import roll_up

ANSWER = "struct<findings:array<string>>"
CANDIDATE = "struct<ruleId:string,blockId:string,evidence:string,why:string,suggestion:struct<before:string,after:string>,confidence:double>"
PAIR_CANDIDATE = "struct<subjectId:string,quoteA:string,quoteB:string,why:string,confidence:double>"


def unfenced(c: Column) -> Column:
    """JSON without the code fence around it."""
    inner = F.regexp_extract(c, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(inner != "", inner).otherwise(c)


def answer_text(message: Column) -> Column:
    """Text of an answer's content, given as JSON: a string, or a list of parts whose texts are joined; else empty."""
    whole = F.from_json(F.concat(F.lit('{"c":'), message, F.lit("}")), "struct<c:string>")["c"]
    parts = F.from_json(message, "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), "")
    start = F.left(F.ltrim(message), F.lit(1))
    return F.when(start == "[", F.coalesce(joined, F.lit(""))).when(start == '"', F.coalesce(whole, F.lit(""))).otherwise("")


def standard_schema(node):
    """A response schema in which ``nullable: true`` beside a type becomes a type or null."""
    if isinstance(node, list):
        return [standard_schema(x) for x in node]
    if not isinstance(node, dict):
        return node
    out = {k: standard_schema(v) for k, v in node.items() if k != "nullable"}
    if node.get("nullable") is True and isinstance(out.get("type"), str):
        out["type"] = [out["type"], "null"]
    return out


def active_rules(ruleset: Ruleset) -> dict[str, tuple[str, ...] | None]:
    """Rules a model is asked about, with the document types they are limited to."""
    return {r: ruleset.rules[r].applies_to for r, x in fixed.RULES.items() if x[5] and ruleset.on(r)}


def chunk_prompts(documents: DataFrame, blocks: DataFrame, ruleset: Ruleset | None = None, limit: int = fixed.CHUNK_CHARS, summaries: DataFrame | None = None) -> DataFrame:
    """uri, chunk_index, system, user: one prompt for each chunk, none for documents too large for a model.

    ``summaries`` (uri, summary) are told to the model where there are some."""
    rules = active_rules(ruleset or Ruleset())
    asked = F.filter(F.array(*[F.when(F.lit(a is None) | F.col("doc_type").isin(*(a or ("",))), F.lit(f"- {r}: {fixed.RULES[r][0]}")) for r, a in rules.items()]), lambda x: x.isNotNull())
    parts = chunks(blocks, limit)
    sizes = parts.groupBy("uri").agg(F.sum(F.length("markdown")).alias("chars")).where(F.col("chars") <= fixed.MAX_MODEL_CHARS).select("uri")
    rows = parts.join(sizes, "uri", "left_semi").join(documents.select("uri", "title", "doc_type"), "uri").join(outline(blocks), "uri", "left")
    rows = rows.withColumn("summary", F.lit(None).cast("string")) if summaries is None else rows.join(summaries.select("uri", "summary"), "uri", "left")
    system = F.concat(F.lit("Judge the document by these rules; quote evidence word for word; answer in JSON.\n"), F.array_join(asked, "\n"))
    told = [F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Type: "), "doc_type"), F.concat(F.lit("Summary: "), "summary"), F.concat(F.lit("Outline:\n"), "outline")]
    return rows.select("uri", "chunk_index", system.alias("system"), F.concat_ws("\n\n", *told, "markdown").alias("user"))


def summary_prompts(blocks: DataFrame, limit: int = fixed.CHUNK_CHARS) -> DataFrame:
    """uri, system, user: for documents of more than one chunk, the beginning to be summarised."""
    parts = chunks(blocks, limit)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "markdown"))), lambda x: x["markdown"]), "\n\n")
    long_ = parts.groupBy("uri").agg(F.count("*").alias("n"), text.alias("t")).where("n > 1")
    return long_.select("uri", F.lit("Say in three sentences what the document is about; answer in JSON with the key summary.").alias("system"), F.left("t", F.lit(fixed.SUMMARY_CHARS)).alias("user"))


def summaries(answers: DataFrame) -> DataFrame:
    """uri, summary of the answers that hold one; a call that failed leaves none, and the document is judged without."""
    said = F.trim(F.from_json(unfenced(F.col("answer")), "struct<summary:string>")["summary"])
    return answers.select("uri", said.alias("summary")).where("summary is not null and summary != ''")


def doc_type_prompts(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """uri, user: outline and beginning of documents whose type is left to a model."""
    body = blocks.withColumn("b", block_text()).where("b != ''").groupBy("uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "\n").alias("t"))
    rows = documents.where("doc_type_origin = 'llm'").select("uri", "title").join(outline(blocks), "uri", "left").join(body, "uri", "left")
    return rows.select("uri", F.concat_ws("\n\n", "title", "outline", F.left("t", F.lit(fixed.HEAD_CHARS))).alias("user"))


def inferred_types(answers: DataFrame) -> DataFrame:
    """uri, doc_type, confidence from a model's answers; unknown and 0 where an answer can't be read."""
    a = F.from_json(unfenced(F.col("answer")), "struct<value:string,confidence:double>")
    ok = F.coalesce(a["value"].isin(*fixed.DOC_TYPES) & a["confidence"].between(0, 1), F.lit(False))
    return answers.select("uri", F.when(ok, a["value"]).otherwise("unknown").alias("doc_type"), F.when(ok, a["confidence"]).otherwise(0.0).alias("confidence"))


def replay(prompts: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts with the answers recorded for them; ok is false where there is none."""
    return prompts.join(answers.select(*keys, "answer"), keys, "left").withColumn("ok", F.col("answer").isNotNull())


def ask(prompts: DataFrame, model: Callable[[str, str], str], tasks: int | None = None) -> DataFrame:
    """Prompts with the answers of a function of (system, user); its errors become ok = false.

    ``tasks`` bounds the calls under way at a time, as a service's quota asks; without it the prompts' own partitions do."""
    keep = [f"{n} {t}" for n, t in prompts.dtypes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(system: str, user: str) -> tuple[str | None, str | None]:
            try:
                return model(system, user), None
            except Exception as e:
                return None, str(e)

        for batch in batches:
            got = [one(s, u) for s, u in zip(batch["system"], batch["user"], strict=True)]
            yield batch.assign(answer=[a for a, _ in got], error=[e for _, e in got], ok=[e is None for _, e in got])

    return (prompts.repartition(tasks) if tasks else prompts).mapInPandas(run, ", ".join(keep) + ", answer string, error string, ok boolean")


def candidates(answers: DataFrame) -> DataFrame:
    """uri, item (JSON text, null if the answer holds no list of findings), seq of each finding that a model reports; none of an empty list."""
    listed = F.from_json(unfenced(F.col("answer")), ANSWER)["findings"]
    items = F.coalesce(listed, F.array(F.lit(None).cast("string")))
    order = ["chunk_index"] if "chunk_index" in answers.columns else []
    rows = answers.select("uri", *order, F.posexplode(items).alias("n", "item"))
    seq = F.row_number().over(Window.partitionBy("uri").orderBy(*order, F.coalesce("n", F.lit(0)), "item"))
    return rows.select("uri", "item", seq.alias("seq"))


def verify(found: DataFrame, documents: DataFrame, blocks: DataFrame, ruleset: Ruleset | None = None, least: float = fixed.MIN_CONFIDENCE) -> DataFrame:
    """Candidates with reject_reason (null: accepted), tested in order: schema, rule, switched on, document type, block,
    confidence, quotation. Cheap tests guard the text search."""
    ruleset = ruleset or Ruleset()
    f = F.from_json("item", CANDIDATE)
    row = found.select("uri", "seq", "item", f["ruleId"].alias("rule_id"), f["blockId"].alias("block_id"), f["evidence"].alias("evidence"), f["why"].alias("why"), f["suggestion"].alias("suggestion"), f["confidence"].alias("confidence"))
    texts = blocks.select("uri", F.col("id").alias("block_id"), block_text().alias("body"))
    row = row.join(documents.select("uri", "doc_type"), "uri", "left").join(texts, ["uri", "block_id"], "left")
    whole = (
        F.col("item").isNotNull() & F.col("rule_id").isNotNull() & F.col("block_id").isNotNull() & F.col("evidence").isNotNull() & F.col("why").isNotNull()
        & F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    )
    asked = [r for r, x in fixed.RULES.items() if x[5]]
    limited = {r: c.applies_to for r, c in ruleset.rules.items() if c.applies_to is not None}
    mismatch = F.lit(False)
    for r, types in limited.items():
        mismatch = mismatch | ((F.col("rule_id") == r) & ~F.coalesce(F.col("doc_type").isin(*types), F.lit(False)))
    reason = (
        F.when(~whole, "schema-invalid")
        .when(~F.col("rule_id").isin(*asked), "unknown-rule")
        .when(F.col("rule_id").isin(*[r for r in asked if not ruleset.on(r)] or [""]), "rule-disabled")
        .when(mismatch, "doctype-mismatch")
        .when(F.col("body").isNull(), "unknown-block")
        .when(F.col("confidence") < least, "low-confidence")
        .when(~evidence_found(F.col("evidence"), F.col("body")), "evidence-not-found")
    )
    kept = F.when(evidence_found(F.col("suggestion.before"), F.col("body")), F.col("suggestion"))
    return row.withColumn("reject_reason", reason).withColumn("suggestion", kept).drop("body")


def accepted(verified: DataFrame, ruleset: Ruleset | None = None) -> DataFrame:
    """One finding for each rule and block, that of the highest confidence, the first of equal ones."""
    ruleset = ruleset or Ruleset()
    n = F.row_number().over(Window.partitionBy("uri", "rule_id", "block_id").orderBy(F.desc("confidence"), "seq"))
    best = verified.where("reject_reason is null").withColumn("n", n).where("n = 1")
    pick = lambda of: F.create_map(*[F.lit(x) for r in fixed.RULES for x in (r, of(r))])[F.col("rule_id")]
    return best.select(
        "uri", F.concat_ws(":", "rule_id", "block_id", F.lit("llm")).alias("id"), "rule_id", pick(lambda r: fixed.RULES[r][1]).alias("axis"),
        pick(lambda r: ruleset.rules[r].severity).alias("severity"), "block_id", pick(lambda r: fixed.RULES[r][0]).alias("message"), "evidence",
        F.col("suggestion.before").alias("before"), F.col("suggestion.after").alias("after"), "why", F.lit("llm").alias("source"), "confidence",
        F.concat(F.lit("rules#"), F.lower("rule_id")).alias("docs_url"),
    )


def analyze(documents: DataFrame, blocks: DataFrame, model: Callable[[str, str], str], keep: Callable[[DataFrame, str], DataFrame], ruleset: Ruleset | None = None, limit: int = fixed.CHUNK_CHARS) -> tuple[DataFrame, DataFrame]:
    """A model's findings on whole documents, and one row a document: uri, status (ok, partial or failed), chunks, rejected, calls.

    Summaries of documents of several chunks are asked for first and told with each chunk; a failed one only costs itself. Calls
    count the summaries, as a quota does. ``keep`` writes a table of answers under a name and reads it back, so that no prompt is asked twice."""
    told = keep(ask(summary_prompts(blocks, limit), model), "summaries")
    answers = keep(ask(chunk_prompts(documents, blocks, ruleset, limit, summaries(told)), model), "answers")
    tested = verify(candidates(answers.where("ok")), documents, blocks, ruleset)
    calls = answers.groupBy("uri").agg(roll_up().alias("status"), F.count("*").alias("chunks"))
    asked = told.groupBy("uri").agg(F.count("*").alias("n_told"))
    rejected = tested.groupBy("uri").agg(F.count("reject_reason").alias("rejected"))
    state = calls.join(asked, "uri", "left").join(rejected, "uri", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return accepted(tested, ruleset), state.select("uri", "status", "chunks", none("rejected").alias("rejected"), (F.col("chunks") + none("n_told")).alias("calls"))


def pair_prompts(pairs: DataFrame, snippets: DataFrame, documents: DataFrame) -> DataFrame:
    """uri_a, uri_b, system, user: for each pair of documents that share identifiers, what each says of them."""
    titles = documents.select("uri", "title").distinct()
    side = lambda s: titles.select(F.col("uri").alias(f"uri_{s}"), F.col("title").alias(f"title_{s}"))
    rows = pairs.select("uri_a", "uri_b", "shared_ids").join(snippets, ["uri_a", "uri_b"]).join(side("a"), "uri_a").join(side("b"), "uri_b")
    said = lambda s: F.concat(F.lit(f"[{s.upper()}] "), f"title_{s}", F.lit("\n"), F.array_join(F.transform(f"snippets_{s}", lambda x: F.concat(F.lit("- "), x)), "\n"))
    system = "Two documents speak of the same identifiers. Report only where their numbers, conditions or duties contradict each other; quote both word for word; answer in JSON."
    return rows.select("uri_a", "uri_b", F.lit(system).alias("system"), F.concat_ws("\n\n", F.concat(F.lit("Identifiers: "), F.array_join("shared_ids", ", ")), said("a"), said("b")).alias("user"))


def contradictions(answers: DataFrame, snippets: DataFrame, pairs: DataFrame, least: float = fixed.MIN_CONFIDENCE) -> DataFrame:
    """TRC006 findings: what a model says of a pair, if the identifier is shared, it is sure, and each quotation is in its side's snippets."""
    items = F.from_json(unfenced(F.col("answer")), f"struct<contradictions:array<{PAIR_CANDIDATE}>>")["contradictions"]
    rows = answers.select("uri_a", "uri_b", F.posexplode(items).alias("n", "c")).join(snippets, ["uri_a", "uri_b"]).join(pairs.select("uri_a", "uri_b", "shared_ids"), ["uri_a", "uri_b"])
    side = lambda s: F.array_join(f"snippets_{s}", "\n")
    good = (
        F.when(~F.array_contains("shared_ids", F.col("c.subjectId")), False).when(F.col("c.confidence") < least, False)
        .when(~evidence_found(F.col("c.quoteA"), side("a")), False).otherwise(evidence_found(F.col("c.quoteB"), side("b")))
    )
    severity, message = fixed.TRACE_RULES["TRC006"]
    key = F.concat(F.lit("TRC006:"), "uri_a", F.lit(":"), "uri_b", F.lit(":"), F.col("c.subjectId"))
    out = rows.where(F.coalesce(good, F.lit(False))).withColumn("id", key)
    n = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c.confidence"), "n"))
    return out.withColumn("k", n).where("k = 1").select(
        "id", F.lit("TRC006").alias("rule_id"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.col("c.why").alias("why"), F.array("uri_a", "uri_b").alias("documents"),
        F.col("c.subjectId").alias("subject_id"), F.concat_ws(" / ", "c.quoteA", "c.quoteB").alias("evidence"), F.lit("llm").alias("source"), F.col("c.confidence").alias("confidence"),
    )
