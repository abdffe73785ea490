"""Derived views: document tables made from the relational test tables, in SQL that Spark and DuckDB both run.

Each is one statement; only array literals differ between the two, and ``view_sql`` writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _array(dialect: str, *items: str) -> str:
    return f"array({', '.join(items)})" if dialect == "spark" else f"[{', '.join(items)}]"


def view_sql(name: str, dialect: str) -> str:
    a = lambda *x: _array(dialect, *x)
    if name == "blocks_li":
        return f"""
SELECT concat('doc-', l_orderkey) AS uri, pos, concat('b', pos + 1) AS id, kind,
  CASE WHEN kind = 'heading' THEN CAST(1 + l_suppkey % 5 AS INT) END AS level,
  CASE WHEN kind = 'heading' THEN concat(CASE l_partkey % 9 WHEN 0 THEN 'Overview of REQ-' WHEN 1 THEN 'Steps for TC-' WHEN 2 THEN 'TODO' WHEN 3 THEN 'Decision ' WHEN 4 THEN 'Purpose ' ELSE 'Part ' END,
       CASE WHEN l_partkey % 9 = 2 THEN '' ELSE CAST(l_partkey % 400 AS VARCHAR(20)) END)
    WHEN kind = 'paragraph' THEN concat(CASE l_suppkey % 8 WHEN 0 THEN 'See the table. ' WHEN 1 THEN 'owner: team a. ' WHEN 2 THEN 'TBD: to be written. ' WHEN 3 THEN concat('Needs REQ-', CAST(l_partkey % 400 AS VARCHAR(20)), ' and TC-', CAST(l_suppkey % 50 AS VARCHAR(20)), '. ') ELSE 'Plain text. ' END,
       repeat('Words of a paragraph. ', CAST(l_quantity AS INT) * 2))
    WHEN kind = 'code' THEN concat('line 1', repeat('{chr(10)}line', l_partkey_n % 5), ' TODO')
    WHEN kind = 'callout' THEN concat('Mind AB-', CAST(l_suppkey AS VARCHAR(20)), ' and UTF-8') END AS text,
  CASE WHEN kind = 'paragraph' THEN l_partkey % 7 = 0 END AS emphasized_as_heading,
  CASE WHEN kind = 'list' THEN l_returnflag = 'R' END AS ordered,
  CASE WHEN kind = 'list' THEN {a("concat('first ', l_returnflag)", "concat('REQ-', CAST(l_suppkey AS VARCHAR(20)))", "'third'")} END AS items,
  CASE WHEN kind = 'list' THEN CAST(l_suppkey % 6 AS INT) END AS depth,
  CASE WHEN kind IN ('table', 'image') AND l_partkey % 3 = 0 THEN concat('Caption ', l_returnflag) END AS caption,
  CASE WHEN kind = 'table' AND l_suppkey % 3 = 0 THEN {a("'name'", "'value'")} END AS headers,
  CASE WHEN kind = 'table' THEN CASE l_partkey % 3 WHEN 0 THEN {a(a("'a'", "'1'"), a("'b'", "'2'"))} WHEN 1 THEN {a(a("'only'", "l_returnflag"))} ELSE {a(a("'x'"), a("'y'", "'3'"), a("'z'", "'4'"))} END END AS rows,
  CASE WHEN kind = 'table' THEN l_suppkey % 5 = 0 END AS is_layout_table,
  CASE WHEN kind = 'code' AND l_suppkey % 2 = 0 THEN 'sql' END AS lang,
  CASE WHEN kind = 'image' THEN CASE l_partkey % 5 WHEN 0 THEN 'image 12' WHEN 1 THEN 'shot.png' WHEN 2 THEN 'A diagram of the payment flow' WHEN 3 THEN '' END END AS alt,
  CASE WHEN kind = 'image' AND l_suppkey % 7 = 0 THEN 'words in the image' END AS ocr_text,
  CASE WHEN kind = 'image' THEN concat('asset', CAST(l_partkey AS VARCHAR(20)), '.png') END AS asset_ref,
  CASE WHEN kind = 'callout' THEN 'info' END AS variant,
  CASE WHEN kind = 'macro' THEN CASE l_partkey % 4 WHEN 0 THEN 'ViewPDF' WHEN 1 THEN 'toc' WHEN 2 THEN 'drawio' ELSE 'include' END END AS name,
  CASE WHEN kind = 'macro' AND l_suppkey % 3 = 0 THEN 'rendered words' END AS rendered_text,
  CASE WHEN kind = 'slide' THEN CAST(pos + 1 AS INT) END AS slide_index,
  CASE WHEN kind = 'slide' AND l_partkey % 2 = 0 THEN 'spoken notes' END AS notes
FROM (
  SELECT *, CAST(l_partkey AS INT) AS l_partkey_n, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS INT) AS pos,
    CASE (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 13 WHEN 0 THEN 'heading' WHEN 1 THEN 'heading' WHEN 2 THEN 'heading' WHEN 3 THEN 'paragraph' WHEN 4 THEN 'paragraph' WHEN 5 THEN 'paragraph'
      WHEN 6 THEN 'list' WHEN 7 THEN 'table' WHEN 8 THEN 'code' WHEN 9 THEN 'image' WHEN 10 THEN 'callout' WHEN 11 THEN 'macro' ELSE 'slide' END AS kind
  FROM lineitem)"""
    if name == "docs_ord":
        return f"""
SELECT concat('doc-', o_orderkey) AS uri,
  CASE o_custkey % 5 WHEN 0 THEN 'confluence' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' WHEN 3 THEN 'pptx' ELSE 'xlsx' END AS source_kind,
  CASE o_orderkey % 7 WHEN 0 THEN 'Notes' WHEN 1 THEN 'Copy of plan' WHEN 2 THEN 'abc' WHEN 3 THEN concat('Design of REQ-', CAST(o_custkey % 400 AS VARCHAR(20))) ELSE concat('Plan ', o_orderpriority) END AS title,
  CASE o_orderkey % 8 WHEN 0 THEN 'meeting-notes' WHEN 1 THEN 'requirement' WHEN 2 THEN 'design' WHEN 3 THEN 'guide' WHEN 4 THEN 'api-doc' WHEN 5 THEN 'troubleshooting' WHEN 6 THEN 'reference' ELSE 'unknown' END AS doc_type,
  CASE WHEN o_custkey % 3 = 0 THEN 'someone' END AS owner,
  CASE WHEN o_custkey % 4 <> 0 THEN {a("lower(o_orderstatus)", "' ADR '", "'Meeting  Notes'")} ELSE {a("lower(o_orderpriority)")} END AS raw_labels,
  o_custkey % 4 = 0 AS unlabelled,
  CASE WHEN o_custkey % 6 = 0 THEN 'not a date' WHEN o_custkey % 6 = 1 THEN NULL ELSE substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS modified_at
FROM orders"""
    if name == "links_li":
        return f"""
SELECT concat('doc-', l_orderkey) AS uri, link_pos, concat('b', link_pos + 1) AS block_id,
  CASE l_partkey % 6 WHEN 0 THEN 'Click here.' WHEN 1 THEN 'https://x.example/y' WHEN 2 THEN '여기' WHEN 3 THEN 'more!' ELSE concat('The plan of part ', CAST(l_partkey AS VARCHAR(20))) END AS text,
  CASE l_suppkey % 6 WHEN 0 THEN concat('doc-', CAST(l_orderkey + 1 AS VARCHAR(20)), '/?v=1#top') WHEN 1 THEN concat('/display/', CAST(l_partkey AS VARCHAR(20)), repeat('/', 1 + l_linenumber_n % 3)) WHEN 2 THEN '#part' WHEN 3 THEN concat('/download/attachments/', CAST(l_partkey AS VARCHAR(20)), '.pdf')
    WHEN 4 THEN 'https://wiki.example/pages/1?x=2' ELSE 'https://other.example/' END AS href,
  CASE l_suppkey % 6 WHEN 0 THEN 'internal' WHEN 1 THEN 'internal' WHEN 2 THEN 'anchor' WHEN 3 THEN 'attachment' WHEN 4 THEN 'internal' ELSE 'external' END AS target,
  CASE WHEN l_discount > 0.07 THEN 'broken' WHEN l_discount > 0.03 THEN 'ok' ELSE 'unchecked' END AS status
FROM (SELECT *, CAST(l_linenumber AS INT) AS l_linenumber_n, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS INT) AS link_pos FROM lineitem)"""
    raise KeyError(name)


VIEWS = ("blocks_li", "docs_ord", "links_li")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = view_sql(name, "spark")
    for table in ("lineitem", "orders"):
        sql = sql.replace(f"FROM {table}", f"FROM parquet.`{sf_dir}/{table}.parquet`")
    return spark.sql(sql)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "blocks_li")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = view(spark, sf_dir, "docs_ord")
    return docs.withColumn("labels", F.when(F.col("unlabelled"), F.array().cast("array<string>")).otherwise(F.col("raw_labels")))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "links_li")


def with_views(sql: str) -> str:
    """A statement for the oracle, with the views it names as common table expressions."""
    used = [v for v in VIEWS if v in sql]
    ctes = ",\n".join(f"{v} AS ({view_sql(v, 'duckdb')})" for v in used)
    sql = sql.strip()
    if not used:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{sql[15:]}"
    return f"WITH {ctes},\n{sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {ctes}\n{sql}"
