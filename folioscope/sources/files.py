"""Folders of files, and documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from . import office, pdf

EXTENSIONS = ("docx", "pptx", "xlsx", "pdf")
MAX_DEPTH = 8
IR = (
    "schemaVersion int, source struct<kind:string,uri:string,version:string,modifiedAt:string,author:string,space:string>, title string, docType struct<value:string,confidence:double,origin:string>, "
    "blocks array<struct<id:string,path:array<int>,kind:string,level:int,text:string,emphasizedAsHeading:boolean,ordered:boolean,items:array<string>,depth:int,caption:string,headers:array<string>,rows:array<array<string>>,"
    "isLayoutTable:boolean,lang:string,alt:string,ocrText:string,assetRef:string,variant:string,name:string,params:map<string,string>,renderedText:string,index:int,notes:string>>, "
    "links array<struct<blockId:string,text:string,href:string,target:string,resolvedTitle:string,status:string>>, metadata struct<labels:array<string>,owner:string,reviewedAt:string,ancestors:array<string>>, _corrupt_record string"
)


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, modified_at, length, content of the known files below ``root`` (up to MAX_DEPTH folders deep), without lock files.

    Content is read only if it is selected; unreadable files are passed over."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    files = reader.load(root)
    name = F.element_at(F.split("path", "/"), -1)
    known = F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*extensions)
    shallow = F.size(F.split(F.regexp_replace("path", "^file:/*", "/"), "/")) - len(("/" + root.removeprefix("file:").strip("/")).split("/")) <= MAX_DEPTH + 1
    return files.where(known & ~F.startswith(name, F.lit("~$")) & shallow).withColumn("modified_at", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """documents, blocks, links and rejected rows of documents in JSON, one a line."""
    raw = spark.read.schema(IR).option("mode", "PERMISSIVE").json(path)
    return split_ir(raw)


def split_ir(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = raw.select(
        "_corrupt_record", F.col("source.uri").alias("uri"), F.col("source.kind").alias("source_kind"), F.col("source.version").alias("version"), F.col("source.modifiedAt").alias("modified_at"),
        F.col("source.author").alias("author"), F.col("source.space").alias("space"), "title", F.col("docType.value").alias("doc_type"), F.col("docType.confidence").alias("doc_type_confidence"),
        F.col("docType.origin").alias("doc_type_origin"), F.coalesce("metadata.labels", F.array().cast("array<string>")).alias("labels"), F.col("metadata.ancestors").alias("ancestors"),
        F.col("metadata.owner").alias("owner"), F.col("metadata.reviewedAt").alias("reviewed_at"), "blocks", "links", "schemaVersion",
    )
    valid, bad = model.validate_documents(docs.where("_corrupt_record is null and coalesce(schemaVersion, 1) = 1"))
    rejects = bad.select("uri", "reject_reason").unionByName(docs.where("_corrupt_record is not null or coalesce(schemaVersion, 1) <> 1").select("uri", F.lit("schema").alias("reject_reason")))
    b = valid.select("uri", F.posexplode("blocks").alias("pos", "b")).select(
        "uri", "pos", "b.*", F.col("b.emphasizedAsHeading").alias("emphasized_as_heading"), F.col("b.isLayoutTable").alias("is_layout_table"), F.col("b.ocrText").alias("ocr_text"),
        F.col("b.assetRef").alias("asset_ref"), F.col("b.renderedText").alias("rendered_text"), F.col("b.index").alias("slide_index"),
    )
    ln = valid.select("uri", F.posexplode("links").alias("link_pos", "l")).select("uri", "link_pos", F.col("l.blockId").alias("block_id"), "l.text", "l.href", "l.target", F.col("l.resolvedTitle").alias("resolved_title"), "l.status")
    return model.complete(valid, model.DOCUMENTS), model.complete(b, model.BLOCKS), model.complete(ln, model.LINKS), rejects


def parse(files: DataFrame, pdf_reader=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, blocks, and uri and error of what can't be read, of files of all known kinds (as ``scan`` gives them).

    ``pdf_reader`` gives the text items of a PDF's bytes (see pdf.items); without one PDF files are errors."""
    office_files = office.parse_files(files)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    of_pdf = files.where(F.lower("path").endswith(".pdf"))
    if pdf_reader is None:
        failed = of_pdf.select(F.col("path").alias("uri"), F.lit("no reader for PDF files").alias("error"))
        none = files.sparkSession.createDataFrame([], pdf.ITEMS)
        found = pdf.blocks(none)
    else:
        items, empty = pdf.items(of_pdf, pdf_reader)
        failed = empty.where("error is not null")
        found = pdf.blocks(items)
    own = [F.col(c).cast("string").alias(c) if c in files.columns else F.lit(None).cast("string").alias(c) for c in ("author", "modified_at")]
    docs = of_pdf.select(F.col("path").alias("uri"), stem.alias("title"), *own).join(failed.select("uri"), "uri", "left_anti")
    docs = docs.select("*", F.lit("pdf").alias("source_kind"), F.lit("unknown").alias("doc_type"), F.lit(0.0).alias("doc_type_confidence"), F.lit("llm").alias("doc_type_origin"), F.array().cast("array<string>").alias("labels"))
    errors = office_files.where("error is not null").select("uri", "error").unionByName(failed)
    return office.documents(office_files).unionByName(model.complete(docs, model.DOCUMENTS)), office.blocks(office_files).unionByName(found), errors
