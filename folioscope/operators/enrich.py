"""Blocks with what rules need beside them, and folds over a document's blocks.

Blocks are shuffled once, by uri; windows and aggregates by uri after that reuse the partitioning."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import block_markdown, block_text, bound, may_hold


def by_doc():
    return Window.partitionBy("uri").orderBy("pos")


def is_heading() -> Column:
    return F.col("kind") == "heading"


#: What rules and folds need of a block's text t, worked out where the block is read: texts themselves aren't shuffled.
FACTS = {
    "n_chars": lambda t: F.length(t),
    "heading_text": lambda t: F.when(is_heading(), t),
    "heading_key": lambda t: F.when(is_heading(), F.regexp_replace(F.lower("text"), r"(?U)\s+", "")),
    "hints_table": lambda t: may_hold(t, fixed.TABLE_HINT_NEEDS) & t.rlike(fixed.TABLE_HINT),
    "sums_up": lambda t: is_heading() & t.rlike(fixed.SUMMARY_HEADING),
    "owned": lambda t: (F.col("kind") != "code") & may_hold(t, fixed.OWNER_TEXT_NEEDS) & t.rlike(fixed.OWNER_TEXT),
}


def facts(blocks: DataFrame, wanted: Collection[str] = tuple(FACTS), **more: Callable[[Column], Column]) -> DataFrame:
    """Blocks with the ``wanted`` of FACTS, and ``more`` of the kind. A text is made once for all of them."""
    of = {k: f for k, f in FACTS.items() if k in wanted} | more
    return blocks.select("*", F.inline_outer(F.transform(F.array(block_text()), lambda t: F.struct(*[f(t).alias(k) for k, f in of.items()]))))


def enrich(with_facts: DataFrame) -> DataFrame:
    """Blocks with ``facts``: adds section_id, first_section, table_in_section, hinted (by a neighbour), level_before."""
    up_to = by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_doc().rowsBetween(Window.unboundedPreceding, -1)
    out = with_facts.withColumn("section_id", F.sum(is_heading().cast("int")).over(up_to))
    if "hints_table" in out.columns:
        beside = [F.lag("hints_table", 1).over(by_doc()), F.lag("hints_table", 2).over(by_doc()), F.lead("hints_table", 1).over(by_doc())]
        out = out.select("*", *[x.alias(f"hint_{i}") for i, x in enumerate(beside)]).withColumn("hinted", F.coalesce(F.greatest("hint_0", "hint_1", "hint_2"), F.lit(False)))
    out = out.withColumn("level_before", F.last(F.when(is_heading(), F.col("level")), ignorenulls=True).over(before))
    return out.withColumn("first_section", F.min("section_id").over(Window.partitionBy("uri"))).withColumn(
        "table_in_section", F.max((F.col("kind") == "table").cast("int")).over(Window.partitionBy("uri", "section_id"))
    )


def sections(enriched: DataFrame) -> DataFrame:
    """uri, section_id, heading, heading_id, first_id, chars: a heading opens a section and isn't in it; section 0 has no heading."""
    rest = ~is_heading()
    return enriched.groupBy("uri", "section_id").agg(
        F.max("heading_text").alias("heading"),
        F.max(F.when(is_heading(), F.col("id"))).alias("heading_id"),
        F.min_by(F.when(rest, F.col("id")), F.when(rest, F.col("pos"))).alias("first_id"),
        F.coalesce(F.sum(F.when(rest, F.col("n_chars"))), F.lit(0)).cast("long").alias("chars"),
    )


def section_values(enriched: DataFrame) -> DataFrame:
    """Adds the values of ``sections`` to each row, and whether it is the section's first: windows on the blocks' partitioning."""
    w = Window.partitionBy("uri", "section_id")
    rest = ~is_heading()
    return (
        enriched.withColumn("heading", F.max("heading_text").over(w))
        .withColumn("heading_id", F.max(F.when(is_heading(), F.col("id"))).over(w))
        .withColumn("section_first_id", F.min_by(F.when(rest, F.col("id")), F.when(rest, F.col("pos"))).over(w))
        .withColumn("section_chars", F.coalesce(F.sum(F.when(rest, F.col("n_chars"))).over(w), F.lit(0)).cast("long"))
        .withColumn("first_of_section", F.col("pos") == F.min("pos").over(w))
    )


_EARLY = lambda: F.col("section_id") - F.col("first_section") <= 1
#: A document's values, as aggregates over its blocks.
STATS = {
    "n_blocks": lambda: F.count(F.lit(1)),
    "text_chars": lambda: F.coalesce(F.sum(F.when(F.col("kind") != "code", F.col("n_chars"))), F.lit(0)).cast("long"),
    "has_heading": lambda: F.max(is_heading().cast("int")),
    "first_id": lambda: F.min_by("id", "pos"),
    "has_summary": lambda: F.max((_EARLY() & F.col("sums_up")).cast("int")),
    "lead_chars": lambda: F.coalesce(F.sum(F.when(F.col("section_id") == 0, F.col("n_chars"))), F.lit(0)),
    "names_owner": lambda: F.max(F.col("owned").cast("int")),
    "headings": lambda: F.collect_set("heading_key"),
}


def document_stats(enriched: DataFrame) -> DataFrame:
    """One row for each document that has blocks."""
    return enriched.groupBy("uri").agg(*[v().alias(k) for k, v in STATS.items()])


def _ordered(value: Column, pos: str = "pos") -> Column:
    """The values of a group in block order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), value.alias("v")))), lambda x: x["v"])


def outline(blocks: DataFrame) -> DataFrame:
    """uri, outline: a bullet for each heading, indented by level."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), "text")
    return blocks.where(is_heading()).groupBy("uri").agg(F.array_join(_ordered(line), "\n").alias("outline"))


def commented() -> Column:
    return F.concat(F.lit("<!--b:"), "id", F.lit("--> "), block_markdown())


def markdown(blocks: DataFrame) -> DataFrame:
    """uri, markdown: all blocks with their id comments, a blank line between."""
    return blocks.groupBy("uri").agg(F.array_join(_ordered(commented()), "\n\n").alias("markdown"))


def heading_paths(blocks: DataFrame) -> DataFrame:
    """uri, pos, path: running numbers of headings by level; a level that is skipped counts 0."""

    def step(a: Column, x: Column) -> Column:
        level = x["level"]
        kept = F.slice(F.concat(a["path"], F.array_repeat(F.lit(0), 6)), 1, level)
        path = F.transform(kept, lambda v, i: F.when(i == level - 1, v + 1).otherwise(v))
        return F.struct(path.alias("path"), F.concat(a["out"], F.array(F.struct(x["pos"].alias("pos"), path.alias("path")))).alias("out"))

    zero = F.struct(F.array().cast("array<int>").alias("path"), F.array().cast("array<struct<pos:int,path:array<int>>>").alias("out"))
    heads = blocks.where(is_heading()).groupBy("uri").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("level").cast("int").alias("level")))).alias("heads"))
    return heads.select("uri", F.inline(F.aggregate("heads", zero, step)["out"]))


def chunks(blocks: DataFrame, limit: int = fixed.CHUNK_CHARS) -> DataFrame:
    """uri, chunk_index, markdown, block_ids: sections packed in order; a chunk is closed when the next section
    would take it over the limit, and a section is never cut."""
    up_to = by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = blocks.withColumn("section_id", F.sum(is_heading().cast("int")).over(up_to)).withColumn("md", commented())
    parts = marked.groupBy("uri", "section_id").agg(F.array_join(_ordered(F.col("md")), "\n\n").alias("md"), _ordered(F.col("id")).alias("ids"))

    def step(a: Column, x: Column) -> Column:
        size = F.length(x["md"])
        full = (a["n"] > 0) & (a["chars"] + size > limit)
        k = F.when(full, a["k"] + 1).otherwise(a["k"])
        return F.struct(
            k.alias("k"), F.when(full, 1).otherwise(a["n"] + 1).alias("n"), F.when(full, size).otherwise(a["chars"] + size).alias("chars"),
            F.concat(a["out"], F.array(k)).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("out"))
    docs = parts.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("section_id", "md", "ids"))).alias("parts"))
    zipped = docs.select("uri", F.inline(F.arrays_zip("parts", F.aggregate("parts", zero, step)["out"].alias("chunk_index"))))
    zipped = zipped.toDF("uri", "part", "chunk_index")
    return zipped.groupBy("uri", "chunk_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["md"]), "\n\n").alias("markdown"),
        F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])).alias("block_ids"),
    )


def document_hash(documents: DataFrame, blocks: DataFrame, links: DataFrame) -> DataFrame:
    """uri, document_hash: equal for documents of equal title, type, labels, owner, blocks (anchors apart) and links."""
    skip = {"uri", "anchor", "pos"}
    body = blocks.groupBy("uri").agg(_ordered(F.to_json(F.struct(*[c for c in blocks.columns if c not in skip]))).alias("b"))
    lines = links.groupBy("uri").agg(_ordered(F.to_json(F.struct("text", "href", "target", "status")), "link_pos").alias("l"))
    parts = F.to_json(F.struct(F.trim("title").alias("t"), "doc_type", F.sort_array(F.coalesce("labels", F.array().cast("array<string>"))).alias("labels"), "owner", "b", "l"))
    return documents.join(body, "uri", "left").join(lines, "uri", "left").select("uri", F.sha2(parts, 256).alias("document_hash"))


def truncated(blocks: DataFrame, limit: int = fixed.MAX_BLOCKS) -> DataFrame:
    """uri, truncated: whether a document (that has blocks) is cut at the limit."""
    return blocks.groupBy("uri").agg((F.max("pos") >= limit).alias("truncated"))


def truncate(blocks: DataFrame, links: DataFrame, limit: int = fixed.MAX_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """The first blocks of each document, and the links that lead from them."""
    kept = blocks.where(F.col("pos") < limit)
    return kept, links.join(kept.select("uri", F.col("id").alias("block_id")).distinct(), ["uri", "block_id"], "left_semi")


def with_quotes(blocks: DataFrame, *page: str) -> DataFrame:
    """Blocks with quote_exact, quote_prefix, quote_suffix: a block's text as it may be found again, with what stands around it.

    ``page`` names columns that tell pages of one uri apart."""
    from ..functions.text import squeezed

    k = F.col("kind")
    raw = F.when(k == "image", F.coalesce("alt", "caption", "asset_ref")).when(k == "macro", F.coalesce("rendered_text", "name")).when(k == "slide", k).otherwise(block_text())
    # Of a text, squeezed once, only both ends are shuffled.
    q = bound(squeezed(F.coalesce(raw, F.lit(""))), lambda t: F.when(t == "", k).otherwise(t))
    ends = lambda t: F.struct(F.substring(t, 1, fixed.QUOTE_CHARS).alias("q_begins"), F.right(t, F.lit(fixed.CONTEXT_CHARS)).alias("q_ends"))
    named = blocks.select("*", F.inline_outer(F.transform(F.array(q), ends)))
    none = lambda c: F.when(c != "", c)
    around = Window.partitionBy("uri", *page).orderBy("pos")
    return named.select(
        *blocks.columns, F.col("q_begins").alias("quote_exact"),
        none(F.lag("q_ends").over(around)).alias("quote_prefix"),
        none(F.substring(F.lead("q_begins").over(around), 1, fixed.CONTEXT_CHARS)).alias("quote_suffix"),
    )


def quotes(blocks: DataFrame) -> DataFrame:
    """uri, pos, quote_exact, quote_prefix, quote_suffix."""
    return with_quotes(blocks).select("uri", "pos", "quote_exact", "quote_prefix", "quote_suffix")


def beginnings(blocks: DataFrame) -> DataFrame:
    """uri, quote_exact: the beginning of each block's text, if it has one."""
    from ..functions.text import squeezed

    return blocks.select("uri", F.explode_outer(F.array(F.substring(squeezed(block_text()), 1, fixed.QUOTE_CHARS))).alias("quote_exact")).where("quote_exact != ''")


def locate(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """uri, quote_exact, id: the shortest block that holds the quotation's beginning (the first of equal ones)."""
    from ..functions.text import squeezed

    texts = blocks.select("uri", "id", "pos", F.explode_outer(F.array(squeezed(block_text()))).alias("q"))
    hit = anchors.select("uri", "quote_exact").distinct().join(texts, "uri").where(F.contains("q", F.left("quote_exact", F.lit(fixed.NEEDLE_CHARS))))
    return hit.groupBy("uri", "quote_exact").agg(F.min_by("id", F.struct(F.length("q"), "pos")).alias("id"))
