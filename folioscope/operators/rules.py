"""The 22 rules that queries can judge.

Rules on single blocks and on links are nullable structs, worked out where the rows are read; what rules on neighbours,
sections and documents need of a text is too, so that no text is shuffled but what is reported of it. Blocks are shuffled
once by uri: windows and an aggregate reuse that partitioning. Documents are joined with the aggregates of their blocks
and links, the rules on documents added, and all is exploded into findings. A document of very many blocks is one window partition and one group; it is cut
before (``enrich.truncate``) where its size is not bounded."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import blank, bound, clip, may_hold, trimmed
from .enrich import STATS, enrich, facts, is_heading, section_values
from .ruleset import Ruleset

RAW = "uri string, rule_id string, block_id string, seq long, message string, evidence string, before string, after string"
FINDINGS = ("uri", "id", "rule_id", "axis", "severity", "block_id", "message", "why", "evidence", "before", "after", "source", "confidence", "docs_url")
DOCS_URL = "rules#"


def _raw(rule: str, when: Column, block_id, seq, message, evidence=None, before=None, after=None) -> Column:
    text = lambda c: (F.lit(c) if not isinstance(c, Column) else c).cast("string")
    return F.when(
        when,
        F.struct(
            F.lit(rule).alias("rule_id"), text(block_id).alias("block_id"), (seq if isinstance(seq, Column) else F.lit(seq)).cast("long").alias("seq"),
            text(message).alias("message"), text(evidence).alias("evidence"), text(before).alias("before"), text(after).alias("after"),
        ),
    )


def _meaningful(c: str) -> Column:
    t = trimmed(F.coalesce(c, F.lit("")))
    return (F.length(t) >= 3) & ~t.rlike(fixed.IMAGE_FILE) & ~t.rlike(fixed.ALT_PLACEHOLDER)


def block_rules(r: Ruleset, body: Column) -> dict[str, Column]:
    """For each rule on a block by itself, a struct where it fires; ``body`` is the block's text."""
    k, pos, bid = F.col("kind"), F.col("pos"), F.col("id")
    alt = F.coalesce("alt", "asset_ref")
    flat = F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>")))
    headless = F.size(F.coalesce("headers", F.array().cast("array<string>"))) == 0
    layout = F.coalesce("is_layout_table", F.lit(False))
    n_rows = F.size(F.coalesce("rows", F.array().cast("array<array<string>>")))

    def unfinished(at: Column) -> Column:
        mark, from_ = F.regexp_extract(body, f"({fixed.DRAFT_MARK})", 1), F.greatest(F.lit(1), at - 20)
        fires = (at > 0) & ~(is_heading() & (F.length(trimmed(body)) == F.length(mark)))
        return _raw("META008", fires, bid, pos, "a mark of unfinished text is left", F.substr(body, from_, at + 40 - from_), mark)

    return {
        "STR005": _raw("STR005", (k == "image") & ~_meaningful("alt") & ~_meaningful("caption"), bid, pos, "an image has no describing text", alt, F.col("alt")),
        "STR006": _raw("STR006", (k == "code") & blank("lang") & (F.size(F.split(body, "\n")) >= int(r.number("STR006", "minLines"))), bid, pos, "a code block names no language", clip(body)),
        "STR008": _raw("STR008", (k == "table") & (layout | (headless & (F.size(flat) <= 2))), bid, pos, "a table serves only for layout", clip(F.array_join(flat, " | "))),
        "STR009": _raw("STR009", (k == "table") & ~layout & headless & (n_rows >= 2), bid, pos, "a table has no header row", clip(F.array_join(F.get("rows", F.lit(0)), " | "))),
        "STR010": _raw("STR010", (k == "list") & (F.col("depth") > r.number("STR010", "maxDepth")), bid, pos, "a list is nested too deep", clip(body)),
        "STR012": _raw("STR012", (k == "macro") & blank("rendered_text") & F.lower("name").isin(*fixed.CONTENT_MACROS), bid, pos, "a macro's content isn't there as text", F.col("name")),
        "STR013": _raw("STR013", (k == "paragraph") & F.coalesce("emphasized_as_heading", F.lit(False)), bid, pos, "emphasis stands for a heading", clip(body)),
        "META008": F.when((k != "code") & may_hold(body, fixed.DRAFT_MARK_NEEDS), bound(F.regexp_instr(body, F.lit(fixed.DRAFT_MARK)), unfinished)),
    }


def neighbour_rules() -> dict[str, Column]:
    """Rules on a block and those around it, on enriched blocks."""
    bid, pos, text = F.col("id"), F.col("pos"), F.col("heading_text")
    return {
        "STR001": _raw("STR001", is_heading() & (F.col("level") > F.col("level_before") + 1), bid, pos, "a heading level is skipped", text, F.concat(F.lit("h"), F.col("level").cast("string")), F.concat(F.lit("h"), (F.col("level_before") + 1).cast("string"))),
        "STR004": _raw("STR004", F.col("bare_image") & F.col("hinted") & (F.col("table_in_section") == 0), bid, pos, "a table or diagram is there only as an image", F.col("asset_ref"), F.coalesce("alt", "asset_ref")),
    }


def document_rules(r: Ruleset, now: datetime) -> dict[str, Column]:
    """Rules on a document with its aggregates (null where it has no blocks or attachments)."""
    n = lambda c: F.coalesce(c, F.lit(0))
    chars = n("text_chars")
    title = trimmed(F.coalesce("title", F.lit("")))
    modified = F.try_to_timestamp(F.col("modified_at"))
    months = F.floor((F.lit(int(now.timestamp() * 1000)) - F.unix_millis(modified)) / fixed.MONTH_MS)
    doubt = (
        F.when(F.lower(title).isin(*fixed.GENERIC_TITLES), "a general word").when(title.rlike(fixed.DERIVED_TITLE), "a trace of a copy").when(F.length(title) < fixed.SHORT_TITLE, "too short")
    )
    missing = _missing_sections()
    return {
        "STR002": _raw("STR002", (n("has_heading") == 0) & (chars > r.number("STR002", "minChars")), None, -1, "a long document has no heading"),
        "STR011": _raw("STR011", (chars < r.number("STR011", "minChars")) & F.col("attachments").isNotNull(), F.col("attachment_block"), -1, "the content is only in attachments", clip(F.array_join("attachments", ", "))),
        "STR014": _raw("STR014", (F.col("source_kind") == "pdf") & (n("n_blocks") == 0), None, -1, "a PDF has no text layer"),
        "META001": _raw("META001", doubt.isNotNull(), None, -1, F.concat(F.lit("the title says little: "), doubt), title, title),
        "META002": _raw("META002", (chars > r.number("META002", "minChars")) & (n("has_summary") == 0) & (n("lead_chars") < fixed.LEAD_CHARS), F.col("first_id"), -1, "a long document has no summary"),
        "META003": _raw("META003", F.size(F.coalesce("labels", F.array().cast("array<string>"))) == 0, None, -1, "there is no label"),
        "META004": _raw("META004", blank("owner") & (n("names_owner") == 0), None, -1, "no owner is named"),
        "META005": _raw("META005", ~blank("modified_at") & (months >= r.number("META005", "staleMonths")), None, -1, F.concat(F.lit("not changed for months: "), months.cast("string")), F.col("modified_at")),
        "META007": _raw("META007", F.size(missing) > 0, None, -1, F.concat(F.lit("sections are missing: "), F.array_join(missing, ", ")), None, None, F.array_join(missing, ", ")),
    }


def _named(words: list[str]):
    """Whether a text contains one of the words."""

    def test(h: Column) -> Column:
        found = F.contains(h, F.lit(words[0]))
        for w in words[1:]:
            found = found | F.contains(h, F.lit(w))
        return found

    return test


def _missing_sections() -> Column:
    """Labels of the type's required sections that no heading's text, without white space, contains a word of."""
    squeeze = lambda s: "".join(s.lower().split())
    out = F.array().cast("array<string>")
    have = F.coalesce("headings", F.array().cast("array<string>"))
    chain = F.when(F.lit(False), out)
    for doc_type, wanted in fixed.REQUIRED_SECTIONS.items():
        lacks = [F.when(~F.exists(have, _named([squeeze(w) for w in words])), words[0]) for words in wanted]
        chain = chain.when(F.col("doc_type") == doc_type, F.filter(F.array(*lacks), lambda x: x.isNotNull()) if lacks else out)
    return chain.otherwise(out)


def link_rules() -> dict[str, Column]:
    t = F.regexp_replace(F.lower(trimmed(F.coalesce("text", F.lit("")))), "[.!?]+$", "")
    return {
        "STR007": _raw("STR007", t.isin(*fixed.VAGUE_LINKS) | t.rlike("^https?://"), F.col("block_id"), F.col("link_pos"), "a link's text says nothing", F.col("text"), F.col("text")),
        "META006": _raw("META006", F.col("status") == "broken", F.col("block_id"), F.col("link_pos"), "a link is broken", F.col("href")),
    }


def section_rules(r: Ruleset) -> dict[str, Column]:
    """A section is judged at its first row."""
    long_ = F.col("first_of_section") & (F.col("section_chars") > r.number("STR003", "maxSectionChars"))
    return {"STR003": _raw("STR003", long_, F.coalesce("heading_id", "section_first_id"), F.col("section_id"), "a section is too long", F.col("heading"))}


NONE = "array<struct<rule_id:string,block_id:string,seq:bigint,message:string,evidence:string,before:string,after:string>>"
#: What a rule needs of a block's text, and which of a document's values.
NEEDS = {"STR001": ("heading_text",), "STR003": ("heading_text", "n_chars"), "STR004": ("hints_table",), "META002": ("sums_up", "n_chars"), "META004": ("owned",), "META007": ("heading_key",), "STR002": ("n_chars",), "STR011": ("n_chars",)}
VALUES = {"STR002": ("has_heading", "text_chars"), "STR011": ("text_chars",), "STR014": ("n_blocks",), "META002": ("text_chars", "has_summary", "lead_chars", "first_id"), "META004": ("names_owner",), "META007": ("headings",)}


def _fired(found: dict[str, Column], ruleset: Ruleset) -> Column:
    """Array of what some rules report on a row."""
    on = [col for rule, col in found.items() if ruleset.on(rule)]
    return F.filter(F.array(*on), lambda x: x.isNotNull()) if on else F.array().cast(NONE)


def _of_blocks(blocks: DataFrame, ruleset: Ruleset) -> DataFrame:
    """uri, fired, and the document's values that rules need: one row for each uri."""
    on = [r for r in fixed.RULES if ruleset.on(r)]
    of = lambda table: list(dict.fromkeys(x for r in on for x in table.get(r, ())))
    values = {k: STATS[k] for k in of(VALUES)}
    has = set(blocks.columns)
    image = (F.col("kind") == "image") & blank("ocr_text") if ruleset.on("STR004") else F.lit(False)
    seen = facts(blocks, of(NEEDS), own=lambda t: _fired(block_rules(ruleset, t), ruleset), bare_image=lambda t: image)
    columns = ["uri", "id", "pos", "kind", "own", "bare_image", *of(NEEDS), *[c for c in ("level",) if c in has]]
    shown = [F.when(F.col("bare_image"), F.col(c)).alias(c) for c in ("asset_ref", "alt")] if ruleset.on("STR004") else []
    rows = seen.select(*columns, *shown)
    if any(ruleset.on(r) for r in ("STR001", "STR003", "STR004", "META002")):
        rows = enrich(rows)
    if ruleset.on("STR003"):
        rows = section_values(rows)
    fired = F.concat("own", _fired(neighbour_rules(), ruleset), _fired(section_rules(ruleset), ruleset))
    return rows.withColumn("fired", fired).groupBy("uri").agg(F.flatten(F.collect_list(F.when(F.size("fired") > 0, F.col("fired")))).alias("fired"), *[v().alias(k) for k, v in values.items()])


def _of_links(links: DataFrame, ruleset: Ruleset) -> DataFrame:
    """uri, fired_links, attached: one row for each uri with links that a rule needs."""
    attached = F.when(F.col("target") == "attachment", F.struct("link_pos", "block_id", "text")) if ruleset.on("STR011") else F.lit(None).cast("struct<link_pos:int,block_id:string,text:string>")
    rows = links.select("uri", F.inline_outer(F.array(F.struct(F.concat(F.array().cast(NONE), _fired(link_rules(), ruleset)).alias("fired"), attached.alias("attached")))))
    of = rows.where((F.size("fired") > 0) | F.col("attached").isNotNull())
    return of.groupBy("uri").agg(F.flatten(F.collect_list(F.when(F.size("fired") > 0, F.col("fired")))).alias("fired_links"), F.sort_array(F.collect_list("attached")).alias("attached"))


def raw_findings(documents: DataFrame, blocks: DataFrame, links: DataFrame, ruleset: Ruleset | None = None, now: datetime | None = None) -> DataFrame:
    """uri, rule_id, block_id, seq (order within rule and document), message, evidence, before, after.

    Of documents that repeat a uri one counts, the last by all columns that rules read; blocks and links of no document count for nothing."""
    ruleset, now = ruleset or Ruleset(), now or datetime.now().astimezone()
    at_documents = document_rules(ruleset, now)
    on = lambda *found: any(ruleset.on(r) for f in found for r in f)

    fields = ("doc_type", "title", "source_kind", "modified_at", "labels", "owner")
    whole = documents.select("uri", F.struct(*fields).alias("doc")).groupBy("uri").agg(F.max("doc").alias("doc")).select("uri", "doc.*")
    everything = []
    if on(block_rules(ruleset, F.lit("")), neighbour_rules(), section_rules(ruleset), VALUES):
        whole = whole.join(_of_blocks(blocks, ruleset), "uri", "left")
        everything.append("fired")
    if on(link_rules(), ("STR011",)):
        whole = whole.join(_of_links(links, ruleset), "uri", "left")
        everything.append("fired_links")
        whole = whole.withColumn("attachment_block", F.get("attached", F.lit(0))["block_id"]).withColumn("attachments", F.when(F.size("attached") > 0, F.transform("attached", lambda x: x["text"])))
    all_ = F.concat(F.array().cast(NONE), *[F.coalesce(c, F.array().cast(NONE)) for c in everything], _fired(at_documents, ruleset))
    out = whole.select("uri", "doc_type", F.explode_outer(all_).alias("f")).where("f is not null").select("uri", "doc_type", "f.*")
    for rule, c in ruleset.rules.items():
        if c.applies_to is not None and ruleset.on(rule):
            out = out.where((F.col("rule_id") != rule) | F.coalesce(F.col("doc_type").isin(*c.applies_to), F.lit(False)))
    return out.drop("doc_type")


def _of_rule(of) -> Column:
    """A value of the finding's rule."""
    return F.create_map(*[F.lit(x) for r in fixed.RULES for x in (r, of(r))])[F.col("rule_id")]


def findings(documents: DataFrame, blocks: DataFrame, links: DataFrame, ruleset: Ruleset | None = None, now: datetime | None = None) -> DataFrame:
    """Findings with id (rule, block or dash, number within rule and document), axis, severity, why and anchor's block."""
    ruleset = ruleset or Ruleset()
    raw = raw_findings(documents, blocks, links, ruleset, now)
    number = F.row_number().over(Window.partitionBy("uri", "rule_id").orderBy("seq", "block_id", "evidence")) - 1
    return raw.select(
        "uri", F.concat_ws(":", "rule_id", F.coalesce("block_id", F.lit("-")), number.cast("string")).alias("id"), "rule_id",
        _of_rule(lambda r: fixed.RULES[r][1]).alias("axis"), _of_rule(lambda r: ruleset.rules[r].severity).alias("severity"), "block_id", "message",
        _of_rule(lambda r: fixed.WHY.get(r, "")).alias("why"), "evidence",
        "before", "after", F.lit("rule").alias("source"), F.lit(1.0).alias("confidence"), F.concat(F.lit(DOCS_URL), F.lower("rule_id")).alias("docs_url"),
    )


def with_anchors(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Findings with the anchor of their block and its position."""
    where = blocks.select("uri", F.col("id").alias("block_id"), "pos", "anchor")
    return found.join(where, ["uri", "block_id"], "left")


def _report_order() -> list[Column]:
    place = F.when(F.col("block_id").isNull(), -1).otherwise(F.coalesce("pos", F.lit(2**31 - 1)))
    return [place, severity_rank(), F.col("rule_id"), F.col("id")]


def in_report_order(found: DataFrame) -> DataFrame:
    """By place in the document (the document as a whole first, unknown blocks last), severity, rule."""
    return found.orderBy("uri", *_report_order())


def report_places(found: DataFrame) -> DataFrame:
    """Findings with anchors and nth, their place (from 1) in the order of their document's report: no total sort."""
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("uri").orderBy(*_report_order())))


def severity_rank(c: str = "severity") -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), F.col(c))


def by_severity_then_axis(found: DataFrame) -> DataFrame:
    return found.orderBy("uri", *severity_then_axis())


def severity_then_axis() -> list[Column]:
    return [severity_rank(), F.array_position(F.array(*[F.lit(a) for a in fixed.AXES]), F.col("axis")), F.col("id")]
