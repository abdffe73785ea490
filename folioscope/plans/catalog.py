"""Named queries over the test tables, and the SQL that must give the same rows.

Document tables are derived (see ``views``). SQL is written on its own, from the meaning of each query."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..functions import fixed, text
from ..operators import enrich, grounding, rules, score, stores, trace
from ..operators.ruleset import Ruleset, from_yaml, resolve, rule_table, rules_evaluated
from ..session import kept, table
from . import fixtures, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "score_total_grade"
NOW = datetime(1998, 1, 1, tzinfo=timezone.utc)

_NONE = "CAST(NULL AS VARCHAR)"
BODY = """body AS (SELECT *, CASE WHEN kind IN ('heading', 'paragraph', 'code', 'callout') THEN coalesce(text, '')
    WHEN kind = 'list' THEN array_to_string(items, ' ')
    WHEN kind = 'table' THEN array_to_string(list_concat(coalesce(headers, []), flatten(rows)), ' ')
    WHEN kind = 'image' THEN coalesce(alt, caption, '')
    WHEN kind = 'macro' THEN coalesce(rendered_text, '') ELSE coalesce(notes, '') END AS body FROM blocks_li)"""
RICH = f"""{BODY},
  rich AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY pos) AS section_id,
    lag(body, 1) OVER (PARTITION BY uri ORDER BY pos) AS before1, lag(body, 2) OVER (PARTITION BY uri ORDER BY pos) AS before2,
    lead(body, 1) OVER (PARTITION BY uri ORDER BY pos) AS after1 FROM body)"""
STATS = f"""{RICH},
  stats AS (SELECT d.uri, coalesce(sum(CASE WHEN r.kind <> 'code' THEN length(r.body) ELSE 0 END), 0) AS chars,
    coalesce(max(CASE WHEN r.kind = 'heading' THEN 1 ELSE 0 END), 0) AS has_heading, count(r.id) AS n_blocks FROM docs_ord d LEFT JOIN rich r ON r.uri = d.uri GROUP BY d.uri)"""
MENTIONS = f"""{BODY},
  texts AS (SELECT uri, -1 AS pos, {_NONE} AS block_id, 'title' AS k, title AS body, doc_type FROM docs_ord
    UNION ALL SELECT b.uri, b.pos, b.id, b.kind, b.body, d.doc_type FROM body b JOIN docs_ord d ON d.uri = b.uri WHERE b.body <> ''),
  found AS (SELECT *, unnest(list_distinct(regexp_extract_all(body, 'REQ-\\d+'))) AS id, 'requirement' AS kind, 0 AS nth FROM texts
    UNION ALL SELECT *, unnest(list_distinct(regexp_extract_all(body, 'TC-\\d+'))), 'test', 1 FROM texts
    UNION ALL SELECT *, unnest(list_distinct(regexp_extract_all(body, '[A-Z]{{2,10}}-\\d+'))), 'ticket', 2 FROM texts),
  mentions AS (SELECT uri, id, kind, block_id, pos, k IN ('title', 'heading') OR (doc_type = 'requirement' AND kind = 'requirement') AS defining, body
    FROM (SELECT *, row_number() OVER (PARTITION BY uri, pos, id ORDER BY nth) AS n FROM found) WHERE n = 1),
  defined AS (SELECT DISTINCT uri, id FROM mentions WHERE defining),
  referenced AS (SELECT DISTINCT uri, id FROM mentions EXCEPT SELECT uri, id FROM defined)"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = views.with_views(sql)
        return f

    return put


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return views.documents(spark, sf_dir), views.blocks(spark, sf_dir), views.links(spark, sf_dir)


# ---- the model: texts, sections, serialisation

query("block_text", f"WITH {BODY} SELECT uri, pos, kind, body FROM body")(lambda s, d: views.blocks(s, d).select("uri", "pos", "kind", text.block_text().alias("body")))
query("headings", "SELECT uri, pos, level, text FROM blocks_li WHERE kind = 'heading'")(lambda s, d: views.blocks(s, d).where("kind = 'heading'").select("uri", "pos", "level", "text"))


@query("total_text_length", f"WITH {STATS} SELECT uri, CAST(chars AS BIGINT) AS chars FROM stats")
def total_text_length(s, d):
    docs, blocks, _ = _all(s, d)
    return docs.select("uri").join(enrich.document_stats(enrich.enrich(enrich.facts(blocks))), "uri", "left").select("uri", F.coalesce("text_chars", F.lit(0)).cast("long").alias("chars"))


@query(
    "sections",
    f"""WITH {RICH} SELECT uri, CAST(section_id AS BIGINT) AS section_id, max(CASE WHEN kind = 'heading' THEN body END) AS heading,
    CAST(sum(CASE WHEN kind = 'heading' THEN 0 ELSE length(body) END) AS BIGINT) AS chars FROM rich GROUP BY uri, section_id""",
)
def sections(s, d):
    return enrich.sections(enrich.enrich(enrich.facts(views.blocks(s, d), ("n_chars", "heading_text")))).select("uri", F.col("section_id").cast("long").alias("section_id"), "heading", "chars")


@query("outline", "SELECT uri, string_agg(repeat('  ', level - 1) || '- ' || text, chr(10) ORDER BY pos) AS outline FROM blocks_li WHERE kind = 'heading' GROUP BY uri")
def outline(s, d):
    return enrich.outline(views.blocks(s, d))


MARKDOWN = f"""{BODY}, md AS (SELECT uri, pos, id, kind, CASE kind
    WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'paragraph' THEN text
    WHEN 'list' THEN array_to_string(list_transform(range(1, len(items) + 1), lambda i: repeat('  ', depth) || CASE WHEN ordered THEN CAST(i AS VARCHAR) || '.' ELSE '-' END || ' ' || items[i]), chr(10))
    WHEN 'table' THEN array_to_string(list_concat(list_concat(CASE WHEN coalesce(caption, '') = '' THEN [] ELSE ['표: ' || caption] END,
      ['| ' || array_to_string(CASE WHEN len(headers) > 0 THEN headers ELSE list_transform(rows[1], lambda x: '') END, ' | ') || ' |',
       '| ' || array_to_string(list_transform(CASE WHEN len(headers) > 0 THEN headers ELSE rows[1] END, lambda x: '---'), ' | ') || ' |']),
      list_transform(rows, lambda r: '| ' || array_to_string(r, ' | ') || ' |')), chr(10))
    WHEN 'code' THEN '```' || coalesce(lang, '') || chr(10) || text || chr(10) || '```'
    WHEN 'image' THEN '[이미지: ' || CASE WHEN coalesce(alt, caption, '') = '' THEN 'alt 없음' ELSE coalesce(alt, caption) END || ']' || CASE WHEN coalesce(ocr_text, '') = '' THEN '' ELSE chr(10) || ocr_text END
    WHEN 'callout' THEN '> [' || variant || '] ' || text
    WHEN 'macro' THEN coalesce(rendered_text, '[매크로: ' || name || ' — 내용 추출 불가]')
    ELSE '## 슬라이드 ' || slide_index || CASE WHEN coalesce(notes, '') = '' THEN '' ELSE chr(10) || '발표자 노트: ' || notes END END AS body FROM body)"""


@query("markdown_serialize", f"WITH {MARKDOWN} SELECT uri, string_agg('<!--b:' || id || '--> ' || body, chr(10) || chr(10) ORDER BY pos) AS markdown FROM md GROUP BY uri")
def markdown_serialize(s, d):
    return enrich.markdown(views.blocks(s, d))


@query(
    "path_counters",
    """WITH RECURSIVE h AS (SELECT uri, pos, level, row_number() OVER (PARTITION BY uri ORDER BY pos) AS n FROM blocks_li WHERE kind = 'heading'),
  walk AS (SELECT uri, pos, n, list_transform(range(1, level + 1), lambda i: CASE WHEN i = level THEN 1 ELSE 0 END) AS path FROM h WHERE n = 1
    UNION ALL SELECT h.uri, h.pos, h.n, list_transform(range(1, h.level + 1), lambda i: coalesce(w.path[i], 0) + CASE WHEN i = h.level THEN 1 ELSE 0 END) FROM walk w JOIN h ON h.uri = w.uri AND h.n = w.n + 1)
  SELECT uri, pos, array_to_string(path, '.') AS path FROM walk""",
)
def path_counters(s, d):
    return enrich.heading_paths(views.blocks(s, d)).select("uri", "pos", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


@query(
    "chunk_plan",
    f"""WITH RECURSIVE {MARKDOWN},
  secs AS (SELECT uri, section_id, string_agg('<!--b:' || id || '--> ' || body, chr(10) || chr(10) ORDER BY pos) AS md, count(*) AS n_blocks FROM
    (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY pos) AS section_id FROM md) GROUP BY uri, section_id),
  s AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY section_id) AS n, length(md) AS size FROM secs),
  walk AS (SELECT uri, n, size AS cur, 0 AS k FROM s WHERE n = 1
    UNION ALL SELECT s.uri, s.n, CASE WHEN w.cur + s.size > 1200 THEN s.size ELSE w.cur + s.size END, CASE WHEN w.cur + s.size > 1200 THEN w.k + 1 ELSE w.k END FROM walk w JOIN s ON s.uri = w.uri AND s.n = w.n + 1)
  SELECT w.uri, w.k AS chunk_index, string_agg(s.md, chr(10) || chr(10) ORDER BY s.n) AS markdown, CAST(sum(s.n_blocks) AS BIGINT) AS n_blocks FROM walk w JOIN s ON s.uri = w.uri AND s.n = w.n GROUP BY w.uri, w.k""",
)
def chunk_plan(s, d):
    out = enrich.chunks(views.blocks(s, d), 1200)
    return out.select("uri", "chunk_index", "markdown", F.size("block_ids").cast("long").alias("n_blocks"))


@query(
    "truncate_blocks",
    """SELECT b.uri, count(DISTINCT b.id) AS n_blocks, count(l.link_pos) AS n_links FROM (SELECT * FROM blocks_li WHERE pos < 3) b
  LEFT JOIN links_li l ON l.uri = b.uri AND l.block_id = b.id GROUP BY b.uri""",
)
def truncate_blocks(s, d):
    blocks, links = enrich.truncate(views.blocks(s, d), views.links(s, d), 3)
    n = links.groupBy("uri").agg(F.count("*").alias("n_links"))
    return blocks.groupBy("uri").agg(F.count("*").alias("n_blocks")).join(n, "uri", "left").select("uri", "n_blocks", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query(
    "text_quotes",
    f"""WITH {BODY}, q AS (SELECT uri, pos, CASE WHEN t = '' THEN kind ELSE t END AS q FROM (SELECT uri, pos, kind, trim(regexp_replace(CASE kind WHEN 'image' THEN coalesce(alt, caption, asset_ref) WHEN 'macro' THEN coalesce(rendered_text, name) WHEN 'slide' THEN 'slide' ELSE body END, '\\s+', ' ', 'g')) AS t FROM body))
  SELECT uri, pos, substring(q, 1, 120) AS quote_exact, right(lag(q) OVER w, 30) AS quote_prefix, substring(lead(q) OVER w, 1, 30) AS quote_suffix FROM q WINDOW w AS (PARTITION BY uri ORDER BY pos)""",
)
def text_quotes(s, d):
    return enrich.quotes(views.blocks(s, d))


@query("doc_hash_groups", "SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents")
def doc_hash_groups(s, d):
    """Each document with the first of equal hash: that of equal text, and no other."""
    from pyspark.sql import Window

    src = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("uri"), "text")
    docs = src.select("uri", F.lit("t").alias("title"), F.lit("unknown").alias("doc_type"), F.array(F.lit("b"), F.lit("a")).alias("labels"), F.lit(None).cast("string").alias("owner"))
    blocks = src.select("uri", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("uri", "pos", F.concat(F.lit("b"), (F.col("pos") + 1).cast("string")).alias("id"), F.lit("paragraph").alias("kind"), "text")
    links = src.where("false").select("uri", F.lit(0).alias("link_pos"), *[F.lit("").alias(c) for c in ("text_", "href", "target", "status")]).withColumnRenamed("text_", "text")
    number = F.col("uri").cast("long")
    return enrich.document_hash(docs, blocks, links).select(number.alias("doc_id"), F.min(number).over(Window.partitionBy("document_hash")).alias("first_id"))


# ---- rules


def _one(rule: str):
    def run(s, d):
        ruleset = Ruleset()
        for r, c in ruleset.rules.items():
            c.enabled = r == rule
        out = rules.raw_findings(*_all(s, d), ruleset, NOW)
        return out.select("uri", "block_id", "evidence")

    return run


_FLAT = "flatten(rows)"
_LABELLED = "CASE WHEN unlabelled THEN [] ELSE raw_labels END"
_SQUEEZED = "(SELECT uri, list(regexp_replace(lower(text), '\\s+', '', 'g')) AS heads FROM blocks_li WHERE kind = 'heading' GROUP BY uri)"


def _lacking() -> str:
    out = []
    for doc_type, wanted in fixed.REQUIRED_SECTIONS.items():
        for words in wanted:
            test = " OR ".join(f"contains(h, '{''.join(w.lower().split())}')" for w in words)
            out.append(f"(doc_type = '{doc_type}' AND len(list_filter(coalesce(heads, []), lambda h: {test})) = 0)")
    return " OR ".join(out)


_SETS = {k: ", ".join(f"'{w}'" for w in v) for k, v in (("generic", fixed.GENERIC_TITLES), ("vague", fixed.VAGUE_LINKS), ("macros", fixed.CONTENT_MACROS))}
_BAD_ALT = lambda c: f"(length(trim(coalesce({c}, ''))) < 3 OR regexp_matches(trim(coalesce({c}, '')), '\\.(png|jpe?g|gif|svg|webp|bmp)$', 'i') OR regexp_matches(trim(coalesce({c}, '')), '^(image|img|screenshot|picture|캡처|캡쳐|그림|이미지|스크린샷)[\\s_-]*\\d*$', 'i'))"
_HINT = "'표|차트|그래프|다이어그램|아키텍처|플로우|table|chart|diagram', 'i'"
_MARK = "'\\bTBD\\b|\\bTODO\\b|\\bFIXME\\b|\\bXXX\\b|작성\\s?중|추후\\s?작성|미정|\\?{3,}'"
_MONTHS = f"floor((epoch_ms(TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}') - epoch_ms(try_cast(modified_at AS TIMESTAMP))) / {fixed.MONTH_MS})"

RULE_SQL = {
    "STR001": f"WITH {RICH}, h AS (SELECT *, lag(level) OVER (PARTITION BY uri ORDER BY pos) AS before_level FROM rich WHERE kind = 'heading') SELECT uri, id AS block_id, text AS evidence FROM h WHERE level > before_level + 1",
    "STR002": f"WITH {STATS} SELECT uri, {_NONE} AS block_id, {_NONE} AS evidence FROM stats WHERE has_heading = 0 AND chars > 800",
    "STR003": f"""WITH {RICH}, s AS (SELECT uri, section_id, sum(CASE WHEN kind = 'heading' THEN 0 ELSE length(body) END) AS chars, max(CASE WHEN kind = 'heading' THEN id END) AS hid, max(CASE WHEN kind = 'heading' THEN body END) AS h, arg_min(id, pos) AS first_id FROM rich GROUP BY uri, section_id)
      SELECT uri, coalesce(hid, first_id) AS block_id, h AS evidence FROM s WHERE chars > 1500""",
    "STR004": f"""WITH {RICH} SELECT r.uri, r.id AS block_id, r.asset_ref AS evidence FROM rich r WHERE r.kind = 'image' AND coalesce(r.ocr_text, '') = '' AND (regexp_matches(coalesce(r.before1, ''), {_HINT}) OR regexp_matches(coalesce(r.before2, ''), {_HINT}) OR regexp_matches(coalesce(r.after1, ''), {_HINT}))
      AND NOT EXISTS (SELECT 1 FROM rich t WHERE t.uri = r.uri AND t.section_id = r.section_id AND t.kind = 'table')""",
    "STR005": f"SELECT uri, id AS block_id, coalesce(alt, asset_ref) AS evidence FROM blocks_li WHERE kind = 'image' AND {_BAD_ALT('alt')} AND {_BAD_ALT('caption')}",
    "STR006": "SELECT uri, id AS block_id, substring(text, 1, 60) AS evidence FROM blocks_li WHERE kind = 'code' AND coalesce(lang, '') = '' AND len(string_split(text, chr(10))) >= 3",
    "STR007": f"SELECT uri, block_id, text AS evidence FROM links_li WHERE regexp_replace(lower(trim(text)), '[.!?]+$', '') IN ({_SETS['vague']}) OR regexp_matches(lower(trim(text)), '^https?://')",
    "STR008": f"SELECT uri, id AS block_id, substring(array_to_string({_FLAT}, ' | '), 1, 60) AS evidence FROM blocks_li WHERE kind = 'table' AND (is_layout_table OR (len(coalesce(headers, [])) = 0 AND len({_FLAT}) <= 2))",
    "STR009": "SELECT uri, id AS block_id, substring(array_to_string(rows[1], ' | '), 1, 60) AS evidence FROM blocks_li WHERE kind = 'table' AND NOT is_layout_table AND len(coalesce(headers, [])) = 0 AND len(rows) >= 2",
    "STR010": "SELECT uri, id AS block_id, substring(array_to_string(items, ' '), 1, 60) AS evidence FROM blocks_li WHERE kind = 'list' AND depth > 3",
    "STR011": f"WITH {STATS}, a AS (SELECT uri, arg_min(block_id, link_pos) AS block_id, string_agg(text, ', ' ORDER BY link_pos) AS names FROM links_li WHERE target = 'attachment' GROUP BY uri) SELECT a.uri, a.block_id, substring(a.names, 1, 60) AS evidence FROM a JOIN stats ON stats.uri = a.uri WHERE chars < 200",
    "STR012": f"SELECT uri, id AS block_id, name AS evidence FROM blocks_li WHERE kind = 'macro' AND coalesce(rendered_text, '') = '' AND lower(name) IN ({_SETS['macros']})",
    "STR013": "SELECT uri, id AS block_id, substring(text, 1, 60) AS evidence FROM blocks_li WHERE kind = 'paragraph' AND emphasized_as_heading",
    "STR014": f"WITH {STATS} SELECT d.uri, {_NONE} AS block_id, {_NONE} AS evidence FROM docs_ord d JOIN stats ON stats.uri = d.uri WHERE source_kind = 'pdf' AND n_blocks = 0",
    "META001": f"SELECT uri, {_NONE} AS block_id, title AS evidence FROM docs_ord WHERE lower(trim(title)) IN ({_SETS['generic']}) OR regexp_matches(title, '복사본|사본|백업|copy of|\\bcopy\\b|\\bold\\b|deprecated', 'i') OR length(trim(title)) < 5",
    "META002": f"""WITH {STATS}, f AS (SELECT uri, min(section_id) AS s0 FROM rich GROUP BY uri),
      g AS (SELECT r.uri, max(CASE WHEN r.kind = 'heading' AND r.section_id - f.s0 <= 1 AND regexp_matches(r.body, '요약|개요|한줄|한 줄|정리|배경|목적|tl;?dr|summary|overview|abstract|purpose', 'i') THEN 1 ELSE 0 END) AS good, sum(CASE WHEN r.section_id = 0 THEN length(r.body) ELSE 0 END) AS lead_chars, arg_min(r.id, r.pos) AS first_id FROM rich r JOIN f ON f.uri = r.uri GROUP BY r.uri)
      SELECT g.uri, g.first_id AS block_id, {_NONE} AS evidence FROM g JOIN stats ON stats.uri = g.uri WHERE chars > 1200 AND good = 0 AND lead_chars < 100""",
    "META003": f"SELECT uri, {_NONE} AS block_id, {_NONE} AS evidence FROM docs_ord WHERE len({_LABELLED}) = 0",
    "META004": f"WITH {BODY} SELECT d.uri, {_NONE} AS block_id, {_NONE} AS evidence FROM docs_ord d WHERE coalesce(owner, '') = '' AND NOT EXISTS (SELECT 1 FROM body b WHERE b.uri = d.uri AND b.kind <> 'code' AND regexp_matches(b.body, '(작성자|담당자|책임자|owner|maintainer|responsible|poc)\\s*[:：]\\s*\\S', 'i'))",
    "META005": f"SELECT uri, {_NONE} AS block_id, modified_at AS evidence FROM docs_ord WHERE {_MONTHS} >= 12",
    "META006": "SELECT uri, block_id, href AS evidence FROM links_li WHERE status = 'broken'",
    "META007": f"SELECT d.uri, {_NONE} AS block_id, {_NONE} AS evidence FROM docs_ord d LEFT JOIN {_SQUEEZED} h ON h.uri = d.uri WHERE {_lacking()}",
    "META008": f"""WITH {BODY}, m AS (SELECT *, regexp_extract(body, {_MARK}, 0, 'i') AS hit, strpos(lower(body), lower(regexp_extract(body, {_MARK}, 0, 'i'))) AS spot FROM body WHERE kind <> 'code' AND regexp_matches(body, {_MARK}, 'i'))
      SELECT uri, id AS block_id, substring(body, CAST(greatest(1, spot - 20) AS BIGINT), CAST(spot + 40 - greatest(1, spot - 20) AS BIGINT)) AS evidence FROM m WHERE NOT (kind = 'heading' AND length(trim(body)) = length(hit))""",
}
for _rule, _sql in RULE_SQL.items():
    query(_rule.lower(), _sql)(_one(_rule))

_SEVERITY = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{x[2]}'" for r, x in fixed.RULES.items()) + " END"
_AXIS = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{x[1]}'" for r, x in fixed.RULES.items()) + " END"


def _union(sqls: dict[str, str]) -> str:
    """All rules as one statement: shared expressions are named once."""
    parts = []
    for rule, sql in sqls.items():
        inner = views.with_views(sql)
        parts.append(f"SELECT '{rule}' AS rule_id, * FROM ({inner})")
    return " UNION ALL ".join(parts)


FOUND = f"found AS (SELECT *, {_AXIS} AS axis, {_SEVERITY} AS severity FROM ({_union(RULE_SQL)}))"
SCORED = f"""{FOUND}, by_rule AS (SELECT uri, axis, rule_id, severity, count(*) AS n FROM found GROUP BY ALL),
  cost AS (SELECT uri, axis, sum(least(n, 3) * CASE severity WHEN 'error' THEN 15 WHEN 'warning' THEN 6 ELSE 2 END + greatest(n - 3, 0)) AS p FROM by_rule GROUP BY uri, axis),
  axes AS (SELECT d.uri, CAST(greatest(0, 100 - coalesce(max(CASE WHEN axis = 'structure' THEN p END), 0)) AS INT) AS structure, CAST(greatest(0, 100 - coalesce(max(CASE WHEN axis = 'context' THEN p END), 0)) AS INT) AS context,
    CAST(greatest(0, 100 - coalesce(max(CASE WHEN axis = 'metadata' THEN p END), 0)) AS INT) AS metadata FROM docs_ord d LEFT JOIN cost ON cost.uri = d.uri GROUP BY d.uri)"""


def _found(s, d, ruleset: Ruleset | None = None) -> DataFrame:
    return rules.findings(*_all(s, d), ruleset, NOW)


query("findings_union", f"WITH {FOUND} SELECT uri, rule_id, axis, severity, block_id, evidence FROM found")(lambda s, d: _found(s, d).select("uri", "rule_id", "axis", "severity", "block_id", "evidence"))
_BLOCK_SEQ = "CASE WHEN rule_id IN ('STR007', 'META006') THEN l.link_pos WHEN rule_id IN ('STR011', 'META002') OR f.block_id IS NULL THEN -1 ELSE b.pos END"
query(
    "finding_ids",
    f"""WITH {FOUND}, seq AS (SELECT f.uri, f.rule_id, f.block_id, f.evidence, {_BLOCK_SEQ} AS seq FROM found f LEFT JOIN blocks_li b ON b.uri = f.uri AND b.id = f.block_id
    LEFT JOIN links_li l ON l.uri = f.uri AND l.block_id = f.block_id AND f.rule_id IN ('STR007', 'META006'))
  SELECT uri, rule_id || ':' || coalesce(block_id, '-') || ':' || (row_number() OVER (PARTITION BY uri, rule_id ORDER BY seq, block_id, evidence) - 1) AS id, rule_id FROM seq""",
)(lambda s, d: _found(s, d).select("uri", "id", "rule_id"))
query("score_by_axis", f"WITH {SCORED} SELECT uri, structure, context, metadata FROM axes")(lambda s, d: score.scores(views.documents(s, d), _found(s, d)).select("uri", *fixed.AXES))
query(
    "score_total_grade",
    f"""WITH {SCORED}, t AS (SELECT uri, CAST(floor(structure * 0.35 + context * 0.45 + metadata * 0.20 + 0.5 + 1e-9) AS INT) AS total FROM axes)
  SELECT uri, total, CASE WHEN total >= 90 THEN 'A' WHEN total >= 75 THEN 'B' WHEN total >= 60 THEN 'C' ELSE 'D' END AS grade FROM t""",
)(lambda s, d: score.scores(views.documents(s, d), _found(s, d)).select("uri", "total", "grade"))
query("count_by_severity", f"WITH {FOUND} SELECT uri, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM found GROUP BY uri")(
    lambda s, d: score.count_by_severity(_found(s, d))
)


@query(
    "finding_order",
    f"""WITH {FOUND} SELECT CAST(row_number() OVER (PARTITION BY uri ORDER BY place, sev, rule_id) AS INT) AS nth, uri, rule_id FROM (
    SELECT f.uri, f.rule_id, f.evidence, CASE WHEN f.block_id IS NULL THEN -1 ELSE coalesce(b.pos, 2147483647) END AS place, CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS sev
    FROM found f LEFT JOIN blocks_li b ON b.uri = f.uri AND b.id = f.block_id)""",
)
def finding_order(s, d):
    """All findings with their place in the order of their document's report."""
    return rules.report_places(rules.with_anchors(_found(s, d), _anchored(s, d))).select("nth", "uri", "rule_id")


def _anchored(s, d) -> DataFrame:
    return model.complete(views.blocks(s, d), model.BLOCKS)


@query(
    "finding_order_by_severity",
    f"""WITH {FOUND} SELECT CAST(row_number() OVER (PARTITION BY uri ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, CASE axis WHEN 'structure' THEN 1 WHEN 'context' THEN 2 ELSE 3 END) AS INT) AS nth, uri, severity, axis FROM found""",
)
def finding_order_by_severity(s, d):
    """All findings with their place in a list by severity and axis."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("uri").orderBy(*rules.severity_then_axis()))
    return _found(s, d).select(nth.alias("nth"), "uri", "severity", "axis")


_WHY_CASE = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{w.replace(chr(39), chr(39) * 2)}'" for r, w in fixed.WHY.items()) + " END"
query("finding_reasons", f"WITH {FOUND} SELECT uri, rule_id, {_WHY_CASE} AS why, CASE WHEN f.block_id IS NULL THEN NULL ELSE b.pos END AS pos FROM (SELECT * FROM found) f LEFT JOIN blocks_li b USING (uri) WHERE b.id = f.block_id UNION ALL SELECT uri, rule_id, {_WHY_CASE}, NULL FROM found WHERE block_id IS NULL")(
    lambda s, d: rules.with_anchors(_found(s, d), _anchored(s, d)).select("uri", "rule_id", "why", "pos")
)


@query(
    "ruleset_overrides",
    f"""WITH {STATS} SELECT uri, 'STR002' AS rule_id, 'info' AS severity FROM stats WHERE has_heading = 0 AND chars > 2000
  UNION ALL SELECT uri, 'STR010', 'error' FROM blocks_li WHERE kind = 'list' AND depth > 1
  UNION ALL SELECT uri, 'META003', 'info' FROM docs_ord WHERE doc_type = 'design' AND len({_LABELLED}) = 0""",
)
def ruleset_overrides(s, d):
    """Thresholds, severities, types and switches of a ruleset of one's own."""
    rules_ = {r: {"enabled": False} for r in fixed.RULES if r not in ("STR002", "STR010", "META003")}
    rules_ |= {"STR002": {"severity": "info", "options": {"minChars": 2000}}, "STR010": {"severity": "error", "options": {"maxDepth": 1}}, "META003": {"appliesTo": ["design"]}}
    return _found(s, d, resolve({"id": "own", "name": "own", "version": 1, "rules": rules_})).select("uri", "rule_id", "severity")


_RULE_ROWS = ", ".join(f"('{r}', '{x[0]}', '{x[1]}', '{x[2]}', {str(x[5]).lower()}, {str(x[6]).lower()})" for r, x in fixed.RULES.items())
query("rule_catalog", f"SELECT * FROM (VALUES {_RULE_ROWS}) t(rule_id, name, axis, default_severity, llm, deterministic)")(
    lambda s, d: rule_table(s).select("rule_id", "name", "axis", "default_severity", "llm", "deterministic")
)


@query("rules_evaluated", "SELECT doc_type, count(*) AS n_docs, CAST(max(CASE WHEN doc_type IN ('design', 'meeting-notes', 'requirement') THEN 33 ELSE 32 END) AS INT) AS with_model, 22 AS without FROM docs_ord GROUP BY doc_type")
def rules_evaluated_(s, d):
    n = lambda asked: F.create_map(*[F.lit(x) for t in fixed.DOC_TYPES for x in (t, rules_evaluated(Ruleset(), t, asked))])[F.col("doc_type")]
    docs = views.documents(s, d).groupBy("doc_type").agg(F.count("*").alias("n_docs"))
    return docs.select("doc_type", "n_docs", n(True).alias("with_model"), n(False).alias("without"))


# ---- scalar transforms and joins

query(
    "link_classify",
    "SELECT uri, link_pos, CASE WHEN starts_with(href, '#') THEN 'anchor' WHEN regexp_matches(href, '/download/(attachments|thumbnails)/') THEN 'attachment' WHEN starts_with(href, '/') THEN 'internal' WHEN starts_with(href, 'https://wiki.example') THEN 'internal' ELSE 'external' END AS target FROM links_li",
)(lambda s, d: views.links(s, d).select("uri", "link_pos", text.link_target(F.col("href"), F.lit("https://wiki.example")).alias("target")))
query(
    "normalize_uri",
    "SELECT page_id, CASE WHEN length(u) > 1 THEN regexp_replace(u, '/+$', '') ELSE u END AS uri FROM (SELECT page_id, split_part(split_part(url || repeat('/', CAST(page_id % 4 AS INT)) || CASE WHEN page_id % 5 = 0 THEN '?q=/#f/' ELSE '' END, '#', 1), '?', 1) AS u FROM pages)",
)(
    lambda s, d: table(s, d, "pages")
    .withColumn("url", F.concat("url", F.repeat(F.lit("/"), (F.col("page_id") % 4).cast("int")), F.when(F.col("page_id") % 5 == 0, "?q=/#f/").otherwise("")))
    .select("page_id", text.normal_uri(F.col("url")).alias("uri"))
)


_LABEL_CASE = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.LABEL_DOC_TYPES.items()) + " END"


@query(
    "doctype_from_label",
    f"""SELECT uri, coalesce(arg_min(t, i) FILTER (t IS NOT NULL), 'unknown') AS doc_type, CAST(CASE WHEN count(t) > 0 THEN 0.9 ELSE 0.0 END AS DOUBLE) AS confidence, CASE WHEN count(t) > 0 THEN 'label' ELSE 'llm' END AS origin
  FROM (SELECT uri, i, {_LABEL_CASE} AS t FROM (SELECT uri, i, regexp_replace(lower(trim(labels[i])), '\\s+', '-', 'g') AS x FROM (SELECT uri, labels, unnest(range(1, len(labels) + 1)) AS i FROM (SELECT uri, {_LABELLED} AS labels FROM docs_ord)))
    UNION ALL SELECT uri, 1000, NULL FROM docs_ord) GROUP BY uri""",
)
def doctype_from_label(s, d):
    from ..sources.wiki import detected_type

    return views.documents(s, d).select("uri", detected_type(F.col("labels"), F.lit("{}")).alias("t")).select("uri", "t.doc_type", "t.confidence", "t.origin")


@query("doctype_override", "SELECT uri, CASE WHEN CAST(substring(uri, 5) AS BIGINT) % 3 = 0 THEN 'guide' ELSE doc_type END AS doc_type, CASE WHEN CAST(substring(uri, 5) AS BIGINT) % 3 = 0 THEN 'user' ELSE 'label' END AS origin FROM docs_ord")
def doctype_override(s, d):
    docs = views.documents(s, d).withColumn("doc_type_confidence", F.lit(0.5)).withColumn("doc_type_origin", F.lit("label"))
    over = docs.where(F.substring("uri", 5, 20).cast("long") % 3 == 0).select("uri", F.lit("guide").alias("doc_type"))
    return stores.with_overrides(docs, over).select("uri", "doc_type", F.col("doc_type_origin").alias("origin"))


@query("finding_anchor_join", "SELECT l.uri, l.link_pos, b.pos FROM links_li l LEFT JOIN blocks_li b ON b.uri = l.uri AND b.id = l.block_id WHERE l.status = 'broken'")
def finding_anchor_join(s, d):
    return rules.with_anchors(views.links(s, d).where("status = 'broken'"), _anchored(s, d)).select("uri", "link_pos", "pos")


@query("links_to_check", "SELECT uri, href FROM (SELECT uri, href, row_number() OVER (PARTITION BY uri ORDER BY p) AS n FROM (SELECT uri, href, min(link_pos) AS p FROM links_li WHERE target IN ('internal', 'attachment') GROUP BY uri, href)) WHERE n <= 2")
def links_to_check(s, d):
    return stores.links_to_check(views.links(s, d), 2)


@query("link_status_writeback", "SELECT uri, link_pos, CASE WHEN href = '/display/14/' THEN 'broken' ELSE status END AS status FROM links_li")
def link_status_writeback(s, d):
    links = views.links(s, d)
    checked = links.where("href = '/display/14/'").select("uri", "href", F.lit("broken").alias("status")).distinct()
    return stores.with_link_status(links, checked).select("uri", "link_pos", "status")


query("html_escape", "SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM conversations")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", text.html_escaped(F.col("text")).alias("html"))
)
query("days_ago", "SELECT o_orderkey, CAST(greatest(0, floor((epoch_ms(TIMESTAMP '1998-01-01 00:00:00') - epoch_ms(o_orderdate)) / 86400000)) AS BIGINT) AS days FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", text.days_ago(F.col("o_orderdate").cast("timestamp"), F.lit(NOW)).cast("long").alias("days"))
)
query("column_letters", "SELECT p_partkey, CAST((ascii(chr(65 + CAST(p_partkey % 26 AS INT))) - 64) * 26 + ascii(chr(65 + CAST(p_partkey % 7 AS INT))) - 65 AS INT) AS n FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", text.column_number(F.concat(F.expr("chr(65 + p_partkey % 26)"), F.expr("chr(65 + p_partkey % 7)"))).alias("n"))
)

# ---- traces


def _mentions(s, d) -> DataFrame:
    return trace.mentions(views.documents(s, d), views.blocks(s, d))


query("extract_ids", f"WITH {MENTIONS} SELECT uri, id, kind, block_id, defining, CASE WHEN length(body) <= 400 THEN body ELSE substring(body, 1, 400) || '…' END AS snippet FROM mentions")(
    lambda s, d: _mentions(s, d).select("uri", "id", "kind", "block_id", "defining", "snippet")
)
query("defined_ids", f"WITH {MENTIONS} SELECT uri, id FROM defined")(lambda s, d: trace.defined_ids(_mentions(s, d)))
query("referenced_ids", f"WITH {MENTIONS} SELECT uri, id FROM referenced")(lambda s, d: trace.referenced_ids(_mentions(s, d)))
query(
    "graph",
    f"""WITH {MENTIONS} SELECT m.id, m.kind, coalesce(d.u, '') AS defined_by, coalesce(r.u, '') AS referenced_by FROM (SELECT id, min(kind) AS kind FROM mentions GROUP BY id) m
  LEFT JOIN (SELECT id, string_agg(uri, ',' ORDER BY uri) AS u FROM defined GROUP BY id) d ON d.id = m.id LEFT JOIN (SELECT id, string_agg(uri, ',' ORDER BY uri) AS u FROM referenced GROUP BY id) r ON r.id = m.id""",
)(lambda s, d: trace.graph(_mentions(s, d)).select("id", "kind", F.array_join("defined_by", ",").alias("defined_by"), F.array_join("referenced_by", ",").alias("referenced_by")))


def _t(df: DataFrame) -> DataFrame:
    return df.select("id", "severity", F.array_join("documents", ",").alias("documents"), "subject_id")


TRACE_SQL = {
    "trc001": f"WITH {MENTIONS} SELECT 'TRC001:' || id AS id, 'error' AS severity, string_agg(uri, ',' ORDER BY uri) AS documents, id AS subject_id FROM referenced r WHERE NOT EXISTS (SELECT 1 FROM defined d WHERE d.id = r.id) GROUP BY r.id",
    "trc002": f"WITH {MENTIONS} SELECT 'TRC002:' || uri AS id, 'warning' AS severity, uri AS documents, {_NONE} AS subject_id FROM docs_ord d WHERE doc_type = 'design' AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.uri = d.uri AND m.kind = 'requirement')",
    "trc003": f"""WITH {MENTIONS} SELECT 'TRC003:' || d.id AS id, 'warning' AS severity, string_agg(d.uri, ',' ORDER BY d.uri) AS documents, d.id AS subject_id FROM defined d WHERE d.id IN (SELECT id FROM mentions WHERE kind = 'requirement')
      AND d.id NOT IN (SELECT r.id FROM referenced r WHERE r.uri IN (SELECT uri FROM mentions WHERE kind = 'test')) GROUP BY d.id""",
    "trc004": f"WITH {MENTIONS} SELECT 'TRC004:' || id AS id, 'error' AS severity, string_agg(uri, ',' ORDER BY uri) AS documents, id AS subject_id FROM defined GROUP BY defined.id HAVING count(*) >= 2",
    "trc005": f"""SELECT 'TRC005:' || uri || ':' || target AS id, 'info' AS severity, uri AS documents, {_NONE} AS subject_id FROM (SELECT DISTINCT uri, CASE WHEN length(u) > 1 THEN regexp_replace(u, '/+$', '') ELSE u END AS target FROM (SELECT uri, split_part(split_part(href, '#', 1), '?', 1) AS u FROM links_li WHERE target = 'internal'))
      WHERE target NOT IN (SELECT uri FROM docs_ord)""",
}
query("trc001", TRACE_SQL["trc001"])(lambda s, d: _t(trace.trc001(_mentions(s, d))))
query("trc002", TRACE_SQL["trc002"])(lambda s, d: _t(trace.trc002(views.documents(s, d), _mentions(s, d))))
query("trc003", TRACE_SQL["trc003"])(lambda s, d: _t(trace.trc003(_mentions(s, d))))
query("trc004", TRACE_SQL["trc004"])(lambda s, d: _t(trace.trc004(_mentions(s, d))))
query("trc005", TRACE_SQL["trc005"])(lambda s, d: _t(trace.trc005(views.documents(s, d), views.links(s, d))))
query("trace_findings", " UNION ALL ".join(f"SELECT * FROM ({views.with_views(q)})" for q in TRACE_SQL.values()))(
    lambda s, d: _t(trace.trace_findings(views.documents(s, d), _mentions(s, d), views.links(s, d)))
)
query("trace_summary", f"WITH {MENTIONS} SELECT (SELECT count(DISTINCT uri) FROM docs_ord) AS document_count, (SELECT count(DISTINCT id) FROM mentions) AS id_count")(
    lambda s, d: trace.summary(views.documents(s, d), m := kept(trace.by_document_and_id(_mentions(s, d)), "ids-of-documents"), trace.trc004(m)).select("document_count", "id_count")
)
_PAIRS = f"{MENTIONS}, du AS (SELECT DISTINCT uri, id FROM mentions), pairs AS (SELECT a.uri AS uri_a, b.uri AS uri_b, count(*) AS n_shared FROM du a JOIN du b ON a.id = b.id AND a.uri < b.uri GROUP BY a.uri, b.uri)"
query("shared_id_pairs_considered", f"WITH {_PAIRS} SELECT count(*) AS considered FROM pairs")(lambda s, d: trace.pairs_considered(_mentions(s, d)))
query(
    "shared_id_pairs_topk",
    f"""WITH {_PAIRS}, top AS (SELECT * FROM pairs ORDER BY n_shared DESC, uri_a, uri_b LIMIT 20) SELECT t.uri_a, t.uri_b, t.n_shared, string_agg(a.id, ',' ORDER BY a.id) AS shared_ids
  FROM top t JOIN du a ON a.uri = t.uri_a JOIN du b ON b.uri = t.uri_b AND b.id = a.id GROUP BY t.uri_a, t.uri_b, t.n_shared""",
)(lambda s, d: trace.top_pairs(_mentions(s, d)).select("uri_a", "uri_b", "n_shared", F.array_join("shared_ids", ",").alias("shared_ids")))

# ---- model findings and their test


def _answers(s, d) -> DataFrame:
    """A made-up model's answers: one finding for each paragraph or heading, some of them wrong in known ways."""
    b = views.blocks(s, d).where("kind in ('paragraph', 'heading')").withColumn("m", F.col("pos") + F.length("text"))
    item = F.to_json(
        F.struct(
            F.expr("case m % 7 when 0 then 'STR001' when 1 then 'CTX007' else 'CTX001' end").alias("ruleId"), F.expr("case when m % 5 = 0 then 'b99' else id end").alias("blockId"),
            F.expr("case when m % 3 = 0 then 'nowhere to be found at all' else concat(substring(text, 1, 8), ' ', substring(text, 9, 30)) end").alias("evidence"), F.lit("because").alias("why"),
            F.expr("case when m % 4 = 0 then 0.3D else 0.9D end").alias("confidence"),
        )
    )
    return b.select("uri", item.alias("item"), F.col("pos").alias("seq"))


_ANSWERS = """ans AS (SELECT uri, pos AS seq, CASE m % 7 WHEN 0 THEN 'STR001' WHEN 1 THEN 'CTX007' ELSE 'CTX001' END AS rule_id, CASE WHEN m % 5 = 0 THEN 'b99' ELSE id END AS block_id, m % 3 = 0 AS lost, CASE WHEN m % 4 = 0 THEN 0.3 ELSE 0.9 END AS confidence,
    trim(regexp_replace(substring(text, 1, 8) || ' ' || substring(text, 9, 30), '\\s+', ' ', 'g')) AS needle, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS hay
    FROM (SELECT *, pos + length(text) AS m FROM blocks_li WHERE kind IN ('paragraph', 'heading'))),
  near AS (SELECT *, NOT lost AND (contains(hay, needle) OR (length(hay) <= 2000 AND length(needle) <= length(hay)
    AND len(list_filter(range(0, length(hay) - length(needle) + 1), lambda i: levenshtein(substring(hay, i + 1, length(needle)), needle) <= floor(length(needle) * 0.1 + 1e-9))) > 0)) AS held FROM ans),
  judged AS (SELECT n.*, CASE WHEN rule_id = 'STR001' THEN 'unknown-rule' WHEN rule_id = 'CTX007' AND d.doc_type NOT IN ('design', 'meeting-notes', 'requirement') THEN 'doctype-mismatch' WHEN block_id = 'b99' THEN 'unknown-block'
    WHEN confidence < 0.6 THEN 'low-confidence' WHEN NOT held THEN 'evidence-not-found' END AS reject_reason FROM near n JOIN docs_ord d ON d.uri = n.uri)"""
query("verify_reasons", f"WITH {_ANSWERS} SELECT uri, seq, rule_id, reject_reason FROM judged")(
    lambda s, d: grounding.verify(_answers(s, d).join(views.documents(s, d).select("uri"), "uri", "left_semi"), views.documents(s, d), views.blocks(s, d)).select("uri", "seq", "rule_id", "reject_reason")
)
query("dedup_max_confidence", f"WITH {_ANSWERS} SELECT uri, rule_id, block_id, CAST(max(confidence) AS DOUBLE) AS confidence FROM judged WHERE reject_reason IS NULL GROUP BY uri, rule_id, block_id")(
    lambda s, d: grounding.accepted(grounding.verify(_answers(s, d).join(views.documents(s, d).select("uri"), "uri", "left_semi"), views.documents(s, d), views.blocks(s, d))).select("uri", "rule_id", "block_id", F.col("confidence").cast("double").alias("confidence"))
)
query(
    "evidence_exact",
    """SELECT conv_id, turn, n <> '' AND contains(h, n) AS held
  FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS h, trim(regexp_replace(substring(coalesce(text, ''), 3, 25), '\\s+', ' ', 'g')) AS n FROM conversations)""",
)(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", text.evidence_found(F.substring("text", 3, 25), F.col("text")).alias("held"))
)
_NEEDLE = "trim(regexp_replace(replace(substring(text, 3, 40), 'e', 'o'), '\\s+', ' ', 'g'))"
query(
    "evidence_fuzzy",
    f"""SELECT conv_id, turn, CASE WHEN n = '' THEN false WHEN contains(h, n) THEN true WHEN length(h) > 2000 OR length(n) > length(h) THEN false ELSE
    len(list_filter(range(0, length(h) - length(n) + 1), lambda i: levenshtein(substring(h, i + 1, length(n)), n) <= floor(length(n) * 0.1 + 1e-9))) > 0 END AS held
  FROM (SELECT conv_id, turn, {_NEEDLE} AS n, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS h FROM conversations)""",
)(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", text.evidence_found(F.replace(F.substring("text", 3, 40), F.lit("e"), F.lit("o")), F.col("text")).alias("held")))
query("status_roll_up", "SELECT user_id, CASE WHEN count(*) FILTER (value > 20) = count(*) THEN 'ok' WHEN count(*) FILTER (value > 20) = 0 THEN 'failed' ELSE 'partial' END AS status FROM events GROUP BY user_id")(
    lambda s, d: table(s, d, "events").withColumn("ok", F.col("value") > 20).groupBy("user_id").agg(score.roll_up().alias("status"))
)
_LINES_OF_RULES = "concat_ws(chr(10), " + ", ".join(
    f"'- {r}: {x[0]}'" if x[4] is None else f"CASE WHEN doc_type IN ({', '.join(repr(t) for t in x[4])}) THEN '- {r}: {x[0]}' END" for r, x in fixed.RULES.items() if x[5]
) + ")"
query(
    "chunk_prompts",
    f"""WITH RECURSIVE {MARKDOWN},
  secs AS (SELECT uri, section_id, string_agg('<!--b:' || id || '--> ' || body, chr(10) || chr(10) ORDER BY pos) AS md FROM
    (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY pos) AS section_id FROM md) GROUP BY uri, section_id),
  s AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY section_id) AS n, length(md) AS size FROM secs),
  walk AS (SELECT uri, n, size AS cur, 0 AS k FROM s WHERE n = 1
    UNION ALL SELECT s.uri, s.n, CASE WHEN w.cur + s.size > 1200 THEN s.size ELSE w.cur + s.size END, CASE WHEN w.cur + s.size > 1200 THEN w.k + 1 ELSE w.k END FROM walk w JOIN s ON s.uri = w.uri AND s.n = w.n + 1),
  parts AS (SELECT w.uri, w.k AS chunk_index, string_agg(s.md, chr(10) || chr(10) ORDER BY s.n) AS markdown FROM walk w JOIN s ON s.uri = w.uri AND s.n = w.n GROUP BY w.uri, w.k),
  heads AS (SELECT uri, string_agg(repeat('  ', level - 1) || '- ' || text, chr(10) ORDER BY pos) AS outline FROM blocks_li WHERE kind = 'heading' GROUP BY uri)
  SELECT p.uri, p.chunk_index, 'Judge the document by these rules; quote evidence word for word; answer in JSON.' || chr(10) || {_LINES_OF_RULES} AS system,
    concat_ws(chr(10) || chr(10), 'Title: ' || title, 'Type: ' || doc_type, 'Outline:' || chr(10) || outline, markdown) AS "user"
  FROM parts p JOIN docs_ord d ON d.uri = p.uri LEFT JOIN heads h ON h.uri = p.uri""",
)(lambda s, d: grounding.chunk_prompts(views.documents(s, d), views.blocks(s, d), limit=1200))

# ---- stores


def _reports(s, d) -> DataFrame:
    """Orders as reports: one key for each customer and status."""
    return table(s, d, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_custkey").cast("string").alias("document_hash"), F.col("o_orderstatus").alias("ruleset_id"), F.lit(1).alias("ruleset_version"), F.lit("p1").alias("prompt_version"),
        F.concat(F.lit("doc-"), F.col("o_custkey").cast("string")).alias("document_uri"), F.col("o_orderdate").alias("created_at"),
    )


@query("report_upsert_latest", "SELECT o_custkey AS cust, o_orderstatus AS ruleset_id, max(o_orderdate) AS created_at FROM orders GROUP BY 1, 2")
def report_upsert_latest(s, d):
    r = _reports(s, d)
    old, new = r.where("report_id % 2 = 0"), r.where("report_id % 2 = 1")
    out = stores.upsert(old, new, stores.REPORT_KEY, "created_at", "report_id")
    return out.select(F.col("document_hash").cast("long").alias("cust"), "ruleset_id", "created_at")


@query("cache_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def cache_anti_join(s, d):
    hashes = table(s, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("document_hash"))
    return stores.not_cached(hashes, _reports(s, d), "F", 1, "p1").select("c_custkey")


@query("index_latest_n", "SELECT uri, updated_at FROM (SELECT 'doc-' || o_custkey AS uri, max(o_orderdate) AS updated_at FROM orders GROUP BY 1) ORDER BY updated_at DESC, uri LIMIT 50")
def index_latest_n(s, d):
    index = _reports(s, d).groupBy(F.col("document_uri").alias("uri")).agg(F.max("created_at").alias("updated_at"))
    return trace.newest(index, 50)


@query("reports_newest_by_uri", "SELECT o_orderkey AS report_id FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def reports_newest_by_uri(s, d):
    r = _reports(s, d)
    first = r.agg(F.min(F.col("document_hash").cast("long"))).first()[0]
    return stores.newest_reports(r, f"doc-{first}", 5).select("report_id")


@query("quota_daily", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, count(*) >= 2 AS denied FROM events GROUP BY 1, 2")
def quota_daily(s, d):
    return stores.calls_by_day(table(s, d, "events").select("user_id", "ts", F.lit(1).alias("calls")), 2).withColumn("day", F.col("day").cast("string"))


@query("model_gate", "SELECT doc_id, CASE WHEN n_chars > 10000 THEN 'too-large' WHEN coalesce(calls, 0) >= 100 THEN 'quota' END AS gate FROM documents LEFT JOIN (SELECT user_id, count(*) AS calls FROM events GROUP BY 1) u ON u.user_id = doc_id % 100")
def model_gate(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("uri"), (F.col("doc_id") % 100).alias("user_id"), (F.col("n_chars") * 20).alias("chars"))
    usage = table(s, d, "events").select("user_id", F.lit(1).alias("calls"))
    return stores.model_gate(docs, usage, True, 100).select(F.col("uri").alias("doc_id"), "gate")


# ---- sources: documents' lines, conversations, pages

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query("text_lines_source", f"WITH {_LINES} SELECT doc_id, count(*) AS n_blocks, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines WHERE trim(line) <> '' GROUP BY doc_id")
def text_lines_source(s, d):
    from ..sources.lines import paragraphs

    b = paragraphs(table(s, d, "documents"), "doc_id", "text")
    return b.groupBy(F.col("uri").cast("long").alias("doc_id")).agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(
    "lint_documents",
    f"WITH {_LINES}, t AS (SELECT doc_id, sum(length(line)) AS chars FROM lines WHERE trim(line) <> '' GROUP BY doc_id) SELECT doc_id, (CASE WHEN chars > 800 THEN 1 ELSE 0 END) + (CASE WHEN chars > 1500 THEN 1 ELSE 0 END) AS n FROM t WHERE chars > 800",
)
def lint_documents(s, d):
    """Length rules over the plain documents, each line a paragraph."""
    from ..sources.lines import paragraphs

    src = table(s, d, "documents")
    docs = src.select(F.col("doc_id").cast("string").alias("uri"), F.lit("unknown").alias("doc_type"), F.lit("A plain title").alias("title"), F.lit("docx").alias("source_kind"), F.lit("x").alias("owner"), F.array(F.lit("l")).alias("labels"), F.lit(None).cast("string").alias("modified_at"))
    ruleset = Ruleset()
    for r, c in ruleset.rules.items():
        c.enabled = r in ("STR002", "STR003")
    blocks = paragraphs(src, "doc_id", "text")
    links = views.links(s, d).where("false")
    return rules.raw_findings(docs, blocks, links, ruleset, NOW).groupBy(F.col("uri").cast("long").alias("doc_id")).agg(F.count("*").cast("int").alias("n"))


@query("conversation_callouts", "SELECT CAST(conv_id AS VARCHAR) AS uri, string_agg('<!--b:b' || (turn + 1) || '--> > [' || role || '] ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def conversation_callouts(s, d):
    """Turns as callouts of one document for each conversation, written as markdown."""
    turns = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("uri"), F.col("turn").alias("pos"), F.concat(F.lit("b"), (F.col("turn") + 1).cast("string")).alias("id"), F.lit("callout").alias("kind"), F.col("role").alias("variant"), "text")
    return enrich.markdown(model.complete(turns, model.BLOCKS))


def _plain(c: str) -> str:
    """Markup as text: without tags, entities read, white space squeezed."""
    out = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{to}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


#: The test pages are a list of links, a heading and paragraphs, some of them not closed; other text stands in no block.
_HTML_LINKS = """a AS (SELECT url AS uri, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
  l AS (SELECT uri, unnest(regexp_extract_all(nav, '(?s)<li><a href="([^"]*)">.*?</a></li>', 1)) AS href, unnest(regexp_extract_all(nav, '(?s)<li><a href="[^"]*">(.*?)</a></li>', 1)) AS shown,
    unnest(range(len(regexp_extract_all(nav, '(?s)<li><a href')))) AS n FROM a)"""


@query(
    "html_pages_blocks",
    f"""WITH {_HTML_LINKS},
  rows AS (SELECT uri, 0 AS o, 'list' AS kind, NULL AS level, NULL AS text, string_agg({_plain('shown')}, '|' ORDER BY n) AS items FROM l GROUP BY uri
    UNION ALL SELECT uri, 1, 'heading', 1, {_plain("regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1)")}, NULL FROM a
    UNION ALL SELECT uri, 1 + i, 'paragraph', NULL, {_plain('part')}, NULL FROM (SELECT uri, unnest(string_split(body, '<p>')) AS part, unnest(range(len(string_split(body, '<p>')))) AS i FROM a) WHERE i > 0)
  SELECT uri, CAST(n AS INT) AS pos, 'b' || (n + 1) AS id, kind, CAST(level AS INT) AS level, text, items FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY o) - 1 AS n FROM rows WHERE kind = 'list' OR text <> '')""",
)
def html_pages_blocks(s, d):
    from ..sources.wiki import page_blocks

    return page_blocks(table(s, d, "pages").select(F.col("url").alias("uri"), "html"), "html").select("uri", "pos", "id", "kind", "level", "text", F.array_join("items", "|").alias("items"))


@query(
    "html_pages_links",
    f"""WITH {_HTML_LINKS} SELECT uri, CAST(n AS INT) AS link_pos, 'b1' AS block_id, {_plain('shown')} AS text, {_plain('href')} AS href,
    CASE WHEN starts_with(href, '#') THEN 'anchor' WHEN regexp_matches(href, '/download/(attachments|thumbnails)/') THEN 'attachment' WHEN starts_with(href, '/') THEN 'internal' WHEN starts_with(href, 'https:') THEN 'internal' ELSE 'external' END AS target,
    {_NONE} AS resolved_title, 'unchecked' AS status FROM l""",
)
def html_pages_links(s, d):
    from ..sources.wiki import page_links

    return page_links(table(s, d, "pages").select(F.col("url").alias("uri"), "html"), "html", "https://")


@query(
    "pdf_line_islands",
    f"""WITH RECURSIVE i AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY {views.ORDER}) AS seq, l_suppkey AS x, l_partkey % 3 * 4 AS y, 8 + l_linenumber % 3 AS size FROM lineitem),
  walk AS (SELECT doc, seq, 0 AS line, y, size, x FROM i WHERE seq = 1
    UNION ALL SELECT i.doc, i.seq, w.line + CASE WHEN abs(w.y - i.y) <= w.size * 0.5 THEN 0 ELSE 1 END, CASE WHEN abs(w.y - i.y) <= w.size * 0.5 THEN w.y ELSE i.y END,
      CASE WHEN abs(w.y - i.y) <= w.size * 0.5 THEN greatest(w.size, i.size) ELSE i.size END, i.x FROM walk w JOIN i ON i.doc = w.doc AND i.seq = w.seq + 1)
  SELECT doc, CAST(line AS INT) AS line, count(*) AS n_items, CAST(max(size) AS DOUBLE) AS size, CAST(arg_min(x, seq) AS DOUBLE) AS x FROM walk GROUP BY doc, line""",
)
def pdf_line_islands(s, d):
    """Positioned items of a page as lines."""
    from pyspark.sql import Window

    from ..sources.pdf import lines

    order = [c.strip() for c in views.ORDER.split(",")]
    items = table(s, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("uri"), F.lit(1).alias("page"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("seq"), F.lit("w").alias("str"),
        F.col("l_suppkey").cast("double").alias("x"), (F.col("l_partkey") % 3 * 4).cast("double").alias("y"), F.lit(5.0).alias("w"), (8 + F.col("l_linenumber") % 3).cast("double").alias("size"),
    )
    return lines(items).select(F.col("uri").cast("long").alias("doc"), "line", "n_items", "size", "x")


# ---- reports

_SEVERITY_NAME = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SEVERITY_LABELS.items()) + " END"
_AXIS_NAME = "CASE axis " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.AXIS_LABELS.items()) + " END"


@query(
    "export_summary",
    f"""WITH {SCORED}, t AS (SELECT uri, CAST(floor(structure * 0.35 + context * 0.45 + metadata * 0.20 + 0.5 + 1e-9) AS INT) AS total FROM axes),
  n AS (SELECT uri, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM found GROUP BY uri)
  SELECT uri AS file, uri AS path, total, CASE WHEN total >= 90 THEN 'A' WHEN total >= 75 THEN 'B' WHEN total >= 60 THEN 'C' ELSE 'D' END AS grade, coalesce(error, 0) AS error, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info, '완료' AS state
  FROM t LEFT JOIN n USING (uri)""",
)
def export_summary(s, d):
    from ..sources.exports import summary_rows

    docs, found = views.documents(s, d), _found(s, d)
    return summary_rows(docs, score.scores(docs, found), found)


@query(
    "export_findings",
    f"""WITH {FOUND}, {BODY}, q AS (SELECT uri, id, substring(CASE WHEN t = '' THEN kind ELSE t END, 1, 120) AS q FROM (SELECT uri, id, kind, trim(regexp_replace(CASE kind WHEN 'image' THEN coalesce(alt, caption, asset_ref) WHEN 'macro' THEN coalesce(rendered_text, name) WHEN 'slide' THEN 'slide' ELSE body END, '\\s+', ' ', 'g')) AS t FROM body))
  SELECT f.uri AS file, {_SEVERITY_NAME} AS severity, rule_id, {_AXIS_NAME} AS axis, CASE WHEN f.block_id IS NULL OR q.q IS NULL THEN '문서 전체' ELSE '"' || q.q || '"' END AS place, {_WHY_CASE} AS why
  FROM found f LEFT JOIN q ON q.uri = f.uri AND q.id = f.block_id""",
)
def export_findings(s, d):
    from ..sources.exports import finding_rows
    from ..sources.wiki import with_quotes

    blocks = with_quotes(views.blocks(s, d).withColumn("xpath", F.lit("")))
    return finding_rows(views.documents(s, d), rules.with_anchors(_found(s, d), blocks)).select("file", "severity", "rule_id", "axis", "place", "why")


_TRACE_WHY = {
    "trc001": "'no document in the index defines ' || subject_id", "trc002": "'the document doesn''t say which requirement it answers'", "trc003": "'no document that refers to ' || subject_id || ' names a test'",
    "trc004": "len(string_split(documents, ',')) || ' documents define ' || subject_id || '; which of them holds is open'",
    "trc005": "substring(id, length('TRC005:' || documents || ':') + 1) || ' isn''t in the index: the link is broken, or the document not yet read'",
}
query(
    "export_trace",
    f"""WITH t AS ({' UNION ALL '.join(f"SELECT upper('{k}') AS rule_id, *, {w} AS why FROM ({views.with_views(TRACE_SQL[k])})" for k, w in _TRACE_WHY.items())}),
  named AS (SELECT t.id, string_agg(d.title || ' (' || d.uri || ')', chr(10) ORDER BY d.uri) AS documents FROM (SELECT id, unnest(string_split(documents, ',')) AS uri FROM t) t JOIN docs_ord d USING (uri) GROUP BY t.id)
  SELECT {_SEVERITY_NAME} AS severity, rule_id, coalesce(subject_id, '') AS subject_id, named.documents, why,
    CAST(row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, rule_id, t.id) AS INT) AS nth FROM t JOIN named ON named.id = t.id""",
)(lambda s, d: _export_trace(s, d))


def _export_trace(s, d) -> DataFrame:
    """The trace report with the place of each row."""
    from ..sources.exports import trace_rows

    found = trace.numbered(trace.trace_findings(views.documents(s, d), _mentions(s, d), views.links(s, d)))
    return trace_rows(found, "nth").select("severity", "rule_id", "subject_id", "documents", "why", F.col("nth").cast("int").alias("nth"))


query(
    "anchor_sentence",
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '문서 전체' WHEN 1 THEN p_size || '쪽' WHEN 2 THEN p_size || '번 슬라이드' WHEN 3 THEN p_brand || ' 시트' WHEN 4 THEN p_brand || ' 시트 A1:' || p_size WHEN 5 THEN (p_size + 1) || '번째 문단' ELSE '"' || p_name || '"' END AS place FROM part""",
)(lambda s, d: _anchor_sentences(s, d))


def _anchor_sentences(s, d) -> DataFrame:
    k, fields = F.col("p_partkey") % 7, model.schema(f"a {model.ANCHOR}")["a"].dataType
    kinds = F.when(k == 1, "pdf").when(k == 2, "pptx").when(k.isin(3, 4), "xlsx").when(k == 5, "docx").when(k == 6, "confluence")
    size = F.col("p_size")
    values = {"kind": kinds, "page": size, "slide": size, "sheet": F.col("p_brand"), "range": F.when(k == 4, F.concat(F.lit("A1:"), size.cast("string"))), "paragraph_index": size, "quote_exact": F.col("p_name")}
    anchor = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    return table(s, d, "part").withColumn("anchor", F.when(k != 0, anchor)).select("p_partkey", text.anchor_sentence().alias("place"))


query(
    "anchor_locate",
    f"""WITH {BODY}, t AS (SELECT uri, id, pos, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS q FROM body), a AS (SELECT DISTINCT uri, substring(q, 1, 120) AS quote_exact FROM t WHERE q <> '')
  SELECT a.uri, a.quote_exact, arg_min(t.id, length(t.q) * 100000 + t.pos) AS id FROM a JOIN t ON t.uri = a.uri AND contains(t.q, left(a.quote_exact, 40)) GROUP BY a.uri, a.quote_exact""",
)(lambda s, d: enrich.locate(enrich.beginnings(views.blocks(s, d)), views.blocks(s, d)))
query("truncated_documents", "SELECT uri, max(pos) >= 3 AS truncated FROM blocks_li GROUP BY uri")(lambda s, d: enrich.truncated(views.blocks(s, d), 3))
query(
    "error_kinds",
    """SELECT p_partkey, CASE st WHEN 401 THEN 'unauthorized' WHEN 403 THEN 'forbidden' WHEN 429 THEN 'quota' ELSE 'server' END AS status_kind,
    CASE WHEN st IN (401, 403) OR regexp_matches(msg, 'api key|unauthorized|permission denied', 'i') THEN 'auth' WHEN st = 429 OR regexp_matches(msg, 'rate limit|quota|resource_exhausted', 'i') THEN 'rate-limit'
      WHEN st = 504 OR regexp_matches(msg, 'timeout|timed out|deadline', 'i') THEN 'timeout' ELSE 'unknown' END AS model_kind
  FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 504 WHEN 4 THEN 500 ELSE 200 END AS st,
    CASE p_partkey % 5 WHEN 0 THEN 'API key is wrong' WHEN 1 THEN 'RESOURCE_EXHAUSTED' WHEN 2 THEN 'It timed out' WHEN 3 THEN 'Permission denied' ELSE 'boom' END AS msg FROM part)""",
)(
    lambda s, d: table(s, d, "part")
    .withColumn("st", F.expr("case p_partkey % 6 when 0 then 401 when 1 then 403 when 2 then 429 when 3 then 504 when 4 then 500 else 200 end"))
    .withColumn("msg", F.expr("case p_partkey % 5 when 0 then 'API key is wrong' when 1 then 'RESOURCE_EXHAUSTED' when 2 then 'It timed out' when 3 then 'Permission denied' else 'boom' end"))
    .select("p_partkey", text.status_kind(F.col("st")).alias("status_kind"), text.model_error_kind(F.col("st"), F.col("msg")).alias("model_kind"))
)
query("link_status_of", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'unchecked' WHEN 1 THEN 'broken' WHEN 2 THEN 'broken' ELSE 'ok' END AS status FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", stores.status_of(F.expr("case p_partkey % 5 when 0 then null when 1 then 404 when 2 then 410 when 3 then 401 else 200 end")).alias("status"))
)
query("override_upsert", "SELECT 'doc-' || o_custkey AS uri, max(o_orderdate) AS at, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS doc_type FROM orders GROUP BY o_custkey")(
    lambda s, d: stores.upsert(*_overrides(s, d), ["uri"], "at", "tie").select("uri", "at", "doc_type")
)


def _overrides(s, d) -> tuple[DataFrame, DataFrame]:
    """Type overrides, of which those of a uri's latest day are all among the new ones."""
    o = table(s, d, "orders").select(F.concat(F.lit("doc-"), F.col("o_custkey").cast("string")).alias("uri"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("doc_type"), F.col("o_orderkey").alias("tie"))
    from pyspark.sql import Window

    last = F.max("at").over(Window.partitionBy("uri")) == F.col("at")
    return o.withColumn("l", last).where("not l").drop("l"), o.withColumn("l", last).where("l").drop("l")


query("answer_fences", "SELECT conv_id, turn, coalesce(text, '') AS body, coalesce(text, '') AS joined FROM conversations")(
    lambda s, d: table(s, d, "conversations")
    .withColumn("t", F.coalesce("text", F.lit("")))
    .withColumn("fenced", F.concat(F.lit("  ```json\n"), F.to_json(F.struct("t")), F.lit("\n```\n")))
    .withColumn("parts", F.to_json(F.array(F.struct(F.left("t", F.lit(7)).alias("text")), F.struct(F.substring("t", 8, 1 << 30).alias("text")))))
    .select("conv_id", "turn", F.from_json(grounding.unfenced(F.col("fenced")), "t string")["t"].alias("body"), grounding.answer_text(F.col("parts")).alias("joined"))
)

# ---- sources, prompts and answers over fixtures, against rows written by hand


def _values(columns: str, *rows: tuple, types: str = "") -> str:
    def one(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x)

    casts = dict(t.split(":") for t in types.split()) if types else {}
    picked = ", ".join(f"CAST({c} AS {casts[c]}) AS {c}" if c in casts else c for c in columns.split())
    return f"SELECT {picked} FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({', '.join(columns.split())})"


@query(
    "wiki_blocks",
    _values(
        "uri pos id kind level path body attr depth xpath quote_prefix quote_suffix",
        ("u", 0, "b1", "heading", 1, "1", "Title", None, None, "./h1", None, "Some text"),
        ("u", 1, "b2", "paragraph", None, "1", "Some text", None, None, "./p[1]", "Title", "Mind this"),
        ("u", 2, "b3", "callout", None, "1", "Mind this", "info", None, "", "Some text", "Deep"),
        ("u", 3, "b4", "heading", 3, "1.0.1", "Deep", None, None, "./h3", "Mind this", "Part"),
        ("u", 4, "b5", "heading", 2, "1.1", "Part", None, None, "./h2", "Deep", "Name Value a 1"),
        ("u", 5, "b6", "table", None, "1.1", "Name Value a 1", None, None, "./table", "Part", "See and this site and up"),
        ("u", 6, "b7", "paragraph", None, "1.1", "See and this site and up", None, None, "./p[2]", "Name Value a 1", "one two"),
        ("u", 7, "b8", "list", None, "1.1", "one two", None, 1, "./ul", "See and this site and up", "in"),
        ("u", 8, "b9", "list", None, "1.1", "in", None, 2, "./ul/li[2]/ul", "one two", "A flow"),
        ("u", 9, "b10", "image", None, "1.1", "A flow", "flow.png", None, "", "in", '{"a": "<b>"}'),
        ("u", 10, "b11", "code", None, "1.1", '{"a": "<b>"}', "json", None, "", "A flow", "drawio"),
        ("u", 11, "b12", "macro", None, "1.1", "", "drawio", None, "", '{"a": "<b>"}', None),
        ("html", 0, "b1", "paragraph", None, "", "one", None, None, "./p[1]", None, "twothree"),
        ("html", 1, "b2", "paragraph", None, "", "twothree", None, None, "./p[2]", "one", "q"),
        ("html", 2, "b3", "callout", None, "", "q", "quote", None, "./blockquote", "twothree", None),
        types="level:INT depth:INT",
    ),
)
def wiki_blocks(s, d):
    from ..sources.wiki import page_blocks

    b = page_blocks(fixtures.pages(s))
    attr = F.coalesce("variant", "asset_ref", "lang", "name")
    return b.select("uri", "pos", "id", "kind", "level", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), text.block_text().alias("body"), attr.alias("attr"), "depth", "anchor.xpath", "anchor.quote_prefix", "anchor.quote_suffix")


@query(
    "wiki_links",
    _values(
        "uri link_pos block_id body href target resolved_title status",
        ("u", 0, "b7", "this site", "https://x.example/a", "external", None, "unchecked"),
        ("u", 1, "b7", "up", "#top", "anchor", None, "unchecked"),
        ("u", 2, "b7", "Other page", "/display/S/Other%20page", "internal", "Other page", "unchecked"),
    ),
)
def wiki_links(s, d):
    from ..sources.wiki import page_links

    return page_links(fixtures.pages(s).where("uri = 'u'").distinct(), base_url="https://wiki.example/").withColumnRenamed("text", "body")


@query(
    "wiki_documents",
    _values(
        "uri version modified_at author space title doc_type doc_type_confidence doc_type_origin labels ancestors page_id",
        ("https://wiki.example/pages/viewpage.action?pageId=7", "3", "2026-01-02", "Ann", "S", "Plan", "meeting-notes", 0.9, "label", "x, Meeting  Notes ", "Home", "7"),
        ("https://wiki.example/pages/viewpage.action?pageId=8", "3", None, "Ann", "S", "Steps", "guide", 0.8, "template", "", "Home", "8"),
        ("https://wiki.example/pages/viewpage.action?pageId=9", "3", "2026-01-02", None, "S", "Else", "unknown", 0.0, "llm", "", "Home", "9"),
        types="doc_type_confidence:DOUBLE",
    ),
)
def wiki_documents(s, d):
    from ..sources.wiki import page_documents, page_id

    out = page_documents(fixtures.payloads(s), "https://wiki.example/")
    join = lambda c: F.array_join(c, ",").alias(c)
    return out.select("uri", "version", "modified_at", "author", "space", "title", "doc_type", "doc_type_confidence", "doc_type_origin", join("labels"), join("ancestors"), page_id(F.col("uri")).alias("page_id"))


@query(
    "office_blocks",
    _values(
        "uri pos id kind level path body headers emphasized place",
        ("/d/a.docx", 0, "b1", "heading", 1, "1", "Head", None, None, "1번째 문단"),
        ("/d/a.docx", 1, "b2", "paragraph", None, "1", "Body text", None, None, "2번째 문단"),
        ("/d/a.docx", 2, "b3", "paragraph", None, "1", "Looks like a head", None, True, "3번째 문단"),
        ("/d/a.docx", 3, "b4", "list", None, "1", "one two", None, None, "4번째 문단"),
        ("/d/a.docx", 4, "b5", "table", None, "1", "N V a 1 b 2", "N,V", None, "6번째 문단"),
        ("/d/b.xlsx", 0, "b1", "heading", 1, "1", "First", None, None, "First 시트"),
        ("/d/b.xlsx", 1, "b2", "table", None, "1", "Name Count a 1 b 2", "Name,Count", None, "First 시트 A1:B3"),
        ("/d/c.v2.pptx", 0, "b1", "heading", 1, "1", "First slide", None, None, "1번 슬라이드"),
        ("/d/c.v2.pptx", 1, "b2", "slide", None, "1", "Say this", None, None, "1번 슬라이드"),
        ("/d/c.v2.pptx", 2, "b3", "list", None, "1", "x y", None, None, "1번 슬라이드"),
        ("/d/c.v2.pptx", 3, "b4", "slide", None, "1", "", None, None, "2번 슬라이드"),
        ("/d/c.v2.pptx", 4, "b5", "paragraph", None, "1", "Last", None, None, "2번 슬라이드"),
        types="level:INT headers:VARCHAR emphasized:BOOLEAN",
    ),
)
def office_blocks(s, d):
    from ..sources.office import blocks

    b = blocks(fixtures.parsed_office(s))
    return b.select("uri", "pos", "id", "kind", "level", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), text.block_text().alias("body"), F.when(F.size("headers") > 0, F.array_join("headers", ",")).alias("headers"), F.col("emphasized_as_heading").alias("emphasized"), text.anchor_sentence().alias("place"))


@query(
    "office_documents",
    _values(
        "uri source_kind title author failed",
        ("/d/a.docx", "docx", "From core", "Ann", False), ("/d/b.xlsx", "xlsx", "b", None, False), ("/d/c.v2.pptx", "pptx", "c.v2", None, False), ("/d/bad.docx", "docx", "bad", None, True),
    ),
)
def office_documents(s, d):
    return fixtures.parsed_office(s).select("uri", "source_kind", "title", "author", F.col("error").isNotNull().alias("failed"))


@query(
    "pdf_blocks",
    _values(
        "uri pos id kind level body page x y width size",
        ("u", 0, "b1", "heading", 1, "Big title", 1, 10, 700, 25, 20), ("u", 1, "b2", "paragraph", None, "body one more next", 1, 40, 650, 15, 10), ("u", 2, "b3", "heading", 2, "Sub", 1, 70, 600, 5, 14),
        ("u", 3, "b4", "paragraph", None, "end of it", 1, 80, 580, 5, 10), ("u", 4, "b5", "paragraph", None, "page two", 2, 0, 700, 5, 10), ("v", 0, "b1", "paragraph", None, "plain", 1, 0, 9, 5, 10),
        types="level:INT x:DOUBLE y:DOUBLE width:DOUBLE size:DOUBLE",
    ),
)
def pdf_blocks(s, d):
    from ..sources import pdf

    box = lambda i, c: F.get("anchor.bbox", F.lit(i)).alias(c)
    return pdf.blocks(fixtures.pdf_items(s)).select("uri", "pos", "id", "kind", "level", F.col("text").alias("body"), "anchor.page", box(0, "x"), box(1, "y"), box(2, "width"), box(3, "size"))


@query(
    "ir_json",
    _values(
        "uri part body more",
        ("u", "document", "T", "guide user l"), ("u", "block", "b1 H", "1"), ("u", "block", "b2 x y", "true"), ("u", "link", "b1 /y", "internal ok"), ("bad", "reject", "doc_type", None), ("later", "reject", "schema", None), (None, "reject", "schema", None),
    ),
)
def ir_json(s, d):
    from ..sources.files import split_ir

    docs, blocks, links, rejects = split_ir(fixtures.ir_lines(s))
    row = lambda df, part, body, more: df.select("uri", F.lit(part).alias("part"), body.alias("body"), more.alias("more"))
    out = row(docs, "document", F.col("title"), F.concat_ws(" ", "doc_type", "doc_type_origin", "labels"))
    out = out.unionByName(row(blocks, "block", F.concat_ws(" ", "id", text.block_text()), F.coalesce(F.col("level").cast("string"), F.col("ordered").cast("string"))))
    out = out.unionByName(row(links, "link", F.concat_ws(" ", "block_id", "href"), F.concat_ws(" ", "target", "status")))
    return out.unionByName(row(rejects, "reject", F.col("reject_reason"), F.lit(None).cast("string")))


@query(
    "ruleset_yaml",
    _values("rule_id enabled severity limit_ applies_to", ("STR002", True, "info", 2000, None), ("STR003", False, "warning", 1500, None), ("META003", True, "info", None, "design,guide"), types="limit_:DOUBLE"),
)
def ruleset_yaml(s, d):
    said = "{id: own, name: Own, version: 2, rules: {STR002: {severity: info, options: {minChars: 2000}}, STR003: {enabled: false}, META003: {appliesTo: [design, guide]}}}"
    t = rule_table(s, from_yaml(said)).where(F.col("rule_id").isin("STR002", "STR003", "META003"))
    return t.select("rule_id", "enabled", "severity", F.get(F.map_values("options"), F.lit(0)).alias("limit_"), F.array_join("applies_to", ",").alias("applies_to"))


@query(
    "analysis_end_to_end",
    _values("uri status chunks rejected calls rule_id block_id why", ("long", "ok", 2, 0, 3, None, None, None), ("short", "ok", 1, 1, 1, "CTX001", "b1", "of what?"), ("bad", "failed", 1, 0, 1, None, None, None)),
)
def analysis_end_to_end(s, d):
    """A made-up model's analysis of whole documents: status and calls of each, and what it found."""
    docs, blocks = fixtures.long_corpus(s)
    found, state = grounding.analyze(docs, blocks, fixtures.model_answer, kept, limit=400)
    return state.join(found.select("uri", "rule_id", "block_id", "why"), "uri", "left").select("uri", "status", "chunks", "rejected", "calls", "rule_id", "block_id", "why")


@query(
    "summary_prompts",
    _values("uri body summary", ("long", "<!--b:b1--> # Part\n\n<!--b:b2--> " + "x" * 300 + "\n\n<!--b:b3--> # Next\n\n<!--b:b4--> " + "y" * 300, "It is long.")),
)
def summary_prompts(s, d):
    _, blocks = fixtures.long_corpus(s)
    p = kept(grounding.ask(grounding.summary_prompts(blocks, 400), fixtures.model_answer), "summaries")
    return p.join(grounding.summaries(p), "uri", "left").select("uri", F.col("user").alias("body"), "summary")


@query("type_prompts", _values("uri body doc_type confidence", ("bad", "Title bad\n\nboom", "design", 0.75), types="confidence:DOUBLE"))
def type_prompts(s, d):
    docs, blocks = fixtures.long_corpus(s)
    p = grounding.doc_type_prompts(docs, blocks)
    said = grounding.inferred_types(p.select("uri", F.lit('```json\n{"value": "design", "confidence": 0.75}\n```').alias("answer")))
    return p.join(said, "uri").select("uri", F.col("user").alias("body"), "doc_type", "confidence")


@query(
    "pair_prompts",
    _values(
        "uri_a uri_b body",
        ("w/1", "w/2", "Identifiers: REQ-002, REQ-003\n\n[A] Rules\n- REQ-001 and REQ-002: at most 3 retries.\n- REQ-003 holds\n\n[B] REQ-003 in detail\n- REQ-003 in detail\n- REQ-002 allows 5 retries, REQ-003"),
        ("w/1", "w/3", "Identifiers: REQ-001, REQ-003\n\n[A] Rules\n- REQ-001 and REQ-002: at most 3 retries.\n- REQ-003 holds\n\n[B] TC-101 and TC-102\n- They test REQ-001 and REQ-003"),
        ("w/2", "w/3", "Identifiers: REQ-003\n\n[A] REQ-003 in detail\n- REQ-003 in detail\n- REQ-002 allows 5 retries, REQ-003\n\n[B] TC-101 and TC-102\n- They test REQ-001 and REQ-003"),
    ),
)
def pair_prompts(s, d):
    docs, blocks, _ = fixtures.corpus(s)
    m = kept(trace.mentions(docs, blocks), "mentions")
    pairs = kept(trace.top_pairs(m), "pairs")
    return grounding.pair_prompts(pairs, trace.pair_snippets(m, pairs), docs).select("uri_a", "uri_b", F.col("user").alias("body"))


@query(
    "trace_end_to_end",
    _values(
        "id severity documents titles subject_id source document_count id_count pairs_considered pairs_analyzed",
        ("TRC001:REQ-014", "error", "w/4", "Else", "REQ-014", "rule", 4, 6, 3, 3), ("TRC003:REQ-002", "warning", "w/1", "Rules", "REQ-002", "rule", 4, 6, 3, 3),
        ("TRC004:REQ-003", "error", "w/1,w/2", "Rules,REQ-003 in detail", "REQ-003", "rule", 4, 6, 3, 3), ("TRC005:w/2:w/9", "info", "w/2", "REQ-003 in detail", None, "rule", 4, 6, 3, 3),
        ("TRC006:w/1:w/2:REQ-002", "error", "w/1,w/2", "Rules,REQ-003 in detail", "REQ-002", "llm", 4, 6, 3, 3),
    ),
)
def trace_end_to_end(s, d):
    """Findings across documents, a made-up model's contradictions among them, beside the summary."""
    from ..engine import Engine

    found, one = Engine(s).trace(*fixtures.corpus(s), fixtures.model_answer)
    join = lambda c: F.array_join(c, ",").alias(c)
    counts = one.select("document_count", "id_count", "pairs_considered", "pairs_analyzed")
    return found.select("id", "severity", join("documents"), join("titles"), "subject_id", "source").crossJoin(F.broadcast(counts))  # one row
