"""PDF text items (uri, page, seq, str, x, y, w, size) as blocks.

No PDF library is at hand: whatever reads the files gives items as a table. Items join a line while
their baseline stays within half the line's largest size, which grows as items join: a fold by page.
An anchor's box is x, baseline, width and size of the first line."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..session import ship

NEAR = 0.5
HEADINGS = ((1.6, 1), (1.35, 2), (1.2, 3))
HEADING_CHARS = 80


def lines(items: DataFrame) -> DataFrame:
    """uri, page, line, text, size (largest of the line), x and y (of its first item), width, n_items.

    Items without text don't count, nor do those of white space that no line is there for. Items are put together as they
    stand: spaces between words are items too."""
    pages = items.where("str != ''").groupBy("uri", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "str", "x", "y", "w", "size"))).alias("items"))

    def step(a, x):
        joins = (a["line"] >= 0) & (F.abs(a["y"] - x["y"]) <= a["size"] * NEAR)
        space = F.trim(F.regexp_replace(x["str"], r"(?U)\s+", " ")) == ""
        line = F.when(joins, a["line"]).when(space, F.lit(None)).otherwise(a["line"] + 1)
        opens = ~joins & ~space
        return F.struct(
            F.coalesce(line, a["line"]).alias("line"), F.when(opens, x["y"]).otherwise(a["y"]).alias("y"),
            F.when(joins, F.greatest(a["size"], x["size"])).when(opens, x["size"]).otherwise(a["size"]).alias("size"), F.concat(a["out"], F.array(line)).alias("out"),
        )

    zero = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("y"), F.lit(0.0).alias("size"), F.array().cast("array<int>").alias("out"))
    each = pages.select("uri", "page", F.inline(F.arrays_zip("items", F.aggregate("items", zero, step)["out"].alias("line")))).toDF("uri", "page", "item", "line")
    text = F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda i: i["str"]), ""), r"(?U)\s+", " "))
    first = F.min_by(F.struct("item.x", "item.y"), "item.seq")
    found = each.where("line is not null").groupBy("uri", "page", "line").agg(text.alias("text"), F.max("item.size").alias("size"), first.alias("at"), F.max(F.col("item.x") + F.col("item.w")).alias("end"), F.count("*").alias("n_items"))
    return found.select("uri", "page", "line", "text", "size", "at.x", "at.y", (F.col("end") - F.col("at.x")).alias("width"), "n_items")


def blocks(items: DataFrame) -> DataFrame:
    """Short lines much larger than the document's median are headings; the rest of a page between them is one paragraph."""
    found = lines(items).where("text != ''")
    body = found.groupBy("uri").agg(F.median("size").alias("body"))
    ratio = F.col("size") / F.col("body")
    level = F.when((F.length("text") >= HEADING_CHARS) | (F.col("body") <= 0), None)
    for least, n in HEADINGS:
        level = level.when(ratio >= least, n)
    marked = found.join(body, "uri").withColumn("level", level)
    order = Window.partitionBy("uri").orderBy("page", "line")
    head = F.col("level").isNotNull()
    new_page = F.coalesce(F.lag("page").over(order) != F.col("page"), F.lit(True))
    fresh = (head | F.lag("level").over(order).isNotNull() | new_page).cast("int")
    grouped = marked.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"]), " ")
    box = F.min_by(F.array("x", "y", "width", "size"), F.struct("page", "line"))
    parts = grouped.groupBy("uri", "part").agg(text.alias("text"), F.max("level").alias("level"), F.min("page").alias("page"), box.alias("bbox"))
    n = F.row_number().over(Window.partitionBy("uri").orderBy("part"))
    fields = model.schema(f"a {model.ANCHOR}")["a"].dataType
    anchor = F.struct(*[{"kind": F.lit("pdf"), "page": F.col("page"), "bbox": F.col("bbox")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    out = parts.withColumn("pos", n - 1).withColumn("id", F.concat(F.lit("b"), n.cast("string"))).withColumn("kind", F.when(F.col("level").isNull(), "paragraph").otherwise("heading")).withColumn("anchor", anchor)
    return model.complete(out, model.BLOCKS)


ITEMS = "uri string, page int, seq int, str string, x double, y double, w double, size double"


def items(files: DataFrame, reader: Callable[[bytes], Iterable[tuple]]) -> tuple[DataFrame, DataFrame]:
    """Items of files (path, content) as ``reader`` gives them, (page, str, x, y, w, size) each, and uri and error of the files that it fails on."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, i, *item, None) for i, item in enumerate(reader(bytes(data)))] or [(path, None, None, None, None, None, None, None, None)]
                except Exception as e:  # one damaged file must not fail the others
                    rows.append((path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["uri", "seq", "page", "str", "x", "y", "w", "size", "error"])
            yield out.astype({"seq": "Int64", "page": "Int64", "x": float, "y": float, "w": float, "size": float})

    rows = files.select("path", "content").mapInPandas(run, "uri string, seq int, page int, str string, x double, y double, w double, size double, error string")
    return rows.where("seq is not null").drop("error"), rows.where("seq is null").select("uri", "error")
