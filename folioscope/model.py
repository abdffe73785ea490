"""The document model as Spark schemas: documents, blocks, links and what is derived from them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import fixed

ANCHOR = "struct<kind:string,xpath:string,quote_exact:string,quote_prefix:string,quote_suffix:string,slide:int,shape_id:string,paragraph_index:int,sheet:string,range:string,page:int,bbox:array<double>>"
DOCUMENTS = (
    "uri string, source_kind string, version string, modified_at string, author string, space string, title string, doc_type string, "
    "doc_type_confidence double, doc_type_origin string, labels array<string>, ancestors array<string>, owner string, reviewed_at string"
)
BLOCK_FIELDS = (
    "id:string,kind:string,path:array<int>,level:int,text:string,emphasized_as_heading:boolean,ordered:boolean,items:array<string>,depth:int,"
    "caption:string,headers:array<string>,rows:array<array<string>>,is_layout_table:boolean,lang:string,alt:string,ocr_text:string,"
    "asset_ref:string,variant:string,name:string,params:map<string,string>,rendered_text:string,slide_index:int,notes:string"
)
BLOCKS = f"uri string, pos int, anchor {ANCHOR}, " + ", ".join(f.replace(":", " ", 1) for f in re.split(r",(?=[a-z_]+:)(?![^<]*>)", BLOCK_FIELDS))
LINKS = "uri string, link_pos int, block_id string, text string, href string, target string, resolved_title string, status string"


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def complete(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with all columns of a schema, in its order and of its types; those it lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(ddl)])


def validate_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep to the enumerations and ranges, and those that don't, with a reason."""
    c = F.coalesce("doc_type_confidence", F.lit(0.0))
    reason = (
        F.when(F.coalesce("uri", F.lit("")) == "", "uri")
        .when(~F.coalesce(F.col("doc_type").isin(*fixed.DOC_TYPES), F.lit(False)), "doc_type")
        .when(~F.coalesce(F.col("source_kind").isin(*fixed.SOURCE_KINDS), F.lit(False)), "source_kind")
        .when((c < 0) | (c > 1), "doc_type_confidence")
        .when(F.col("title").isNull(), "title")
    )
    marked = documents.withColumn("reject_reason", reason)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")
