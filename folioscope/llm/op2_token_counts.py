"""Token counts by a separator scan of flat token files.

A flat token file is nothing but ids, 16 or 32 bits each, documents one after the other, each ended
by an end-of-document id; there is no index. Files are read in blocks that tasks open at their
offsets. In a block one vectorised comparison finds the separators. Blocks are then stitched by a
prefix scan over one small row a block: how many separators, and where the last one was, in all
blocks before. That gives each separator its document's number and length, also for documents that
span blocks. The scan has two levels, blocks within runs of RUN blocks and runs within files, so that
no task takes more than RUN rows of a file at the lower and one row a run at the upper.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, pages_of, shared_dir, text_rows
from .files import open_store, write_whole
from .op5_bpe import _encoder, ranks_of

BLOCK_IDS = 1 << 20
RUN = 1024


def _writer(folder: str, path: str, pattern: str, end_id: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path, pattern)
        doc_ids: list = []

        def write(out) -> None:
            for batch in batches:
                doc_ids.extend(batch["doc_id"])
                for text in batch["text"]:
                    out.write(np.array([*encoder.encode_ordinary(text or ""), end_id], f"<u{width}").tobytes())

        uri = write_whole(folder, "tokens", write)
        for at in range(0, len(doc_ids), 100_000):
            some = doc_ids[at : at + 100_000]
            yield pd.DataFrame({"file": uri, "number": np.arange(at, at + len(some)), "doc_id": pd.array([None if pd.isna(x) else int(x) for x in some], "Int64")})

    return run


def write_flat(docs: DataFrame, path: str, pattern: str, end_id: int) -> DataFrame:
    """Writes flat files without moving a document; returns file, number and doc_id of each document.

    A null text counts as empty: its document is the end id alone. ``end_id`` must be free in the
    vocabulary, so that it can't occur within a text."""
    ranks = ranks_of(path)
    if end_id in ranks.values():
        raise ValueError(f"{end_id} is a token of the vocabulary")
    width = 2 if max(end_id, len(ranks)) < 1 << 16 else 4
    folder = shared_dir(docs.sparkSession, f"flat-u{8 * width}")
    return materialise(text_rows(docs).mapInPandas(_writer(folder, path, pattern, end_id, width), "file string, number bigint, doc_id bigint"), "flat-documents")


def _scan(end_id: int, width: int):
    """ends: where separators stand within the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = []
            for uri, first, count in zip(batch["file"], batch["first"], batch["n"], strict=True):
                store, path = open_store(uri)
                with store.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(int(count) * width, int(first) * width), f"<u{width}")
                ends.append(np.flatnonzero(ids == end_id).astype(np.int32))
            yield batch.assign(ends=ends)

    return run


def _before(rows: DataFrame, keys: list[str], order: str, n: str, last: str) -> DataFrame:
    """With n_before and last_before: the sum of n and the largest last of the key's rows before each."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("n_before", F.coalesce(F.sum(n).over(w), F.lit(0))).withColumn("last_before", F.coalesce(F.max(last).over(w), F.lit(-1)))


def count_tokens(files: DataFrame, end_id: int, width: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """file, number (from 0), n_tokens (without the end id) and ended of every document in the files.

    ``files`` has file and bytes. Ids after a file's last end id are a document that isn't ended;
    an empty file has none. Adjacent end ids enclose an empty document."""
    files = files.select("file", F.expr(f"bytes div {width}").alias("total"))
    blocks = files.where("total > 0").select("file", "total", F.explode(F.expr(f"sequence(0L, total - 1, {block_ids}L)")).alias("first"))
    blocks = blocks.withColumn("n", F.least(F.lit(block_ids).cast("long"), F.col("total") - F.col("first"))).repartition("file", "first")
    # Read twice: by the prefix scan, which takes one small row a block, and by the blocks themselves.
    scanned = materialise(blocks.mapInPandas(_scan(end_id, width), "file string, total bigint, first bigint, n bigint, ends array<int>"), "separators")

    last = F.when(F.size("ends") > 0, F.col("first") + F.element_at("ends", F.size("ends")))
    small = scanned.select("file", "first", F.expr(f"first div {block_ids * RUN}").alias("run"), F.size("ends").cast("long").alias("n_ends"), last.alias("last"))
    runs = _before(small.groupBy("file", "run").agg(F.sum("n_ends").alias("run_ends"), F.max("last").alias("run_last")), ["file"], "run", "run_ends", "run_last")
    runs = runs.select("file", "run", F.col("n_before").alias("run_n"), F.col("last_before").alias("run_at"))
    within = _before(small, ["file", "run"], "first", "n_ends", "last").join(runs, ["file", "run"])
    places = within.select("file", "first", (F.col("n_before") + F.col("run_n")).alias("number"), F.greatest("last_before", "run_at").alias("before"))

    # Separators grow with the documents, so their table is not broadcast, however small its compressed files.
    stitched = scanned.hint("merge").join(places, ["file", "first"])
    since = lambda e, i: F.when(i == 0, F.col("before") - F.col("first")).otherwise(F.get("ends", i - 1).cast("long"))
    ended = stitched.select("file", "number", F.posexplode(F.transform("ends", lambda e, i: e - since(e, i) - 1)).alias("at", "n_tokens")).select(
        "file", (F.col("number") + F.col("at")).cast("long").alias("number"), F.col("n_tokens").cast("long").alias("n_tokens"), F.lit(True).alias("ended")
    )
    open_ = (
        stitched.where(F.col("first") + F.col("n") == F.col("total"))
        .select("file", (F.col("number") + F.size("ends")).cast("long").alias("number"), (F.col("total") - F.greatest("before", last) - 1).alias("n_tokens"), F.lit(False).alias("ended"))
        .where("n_tokens > 0")
    )
    return ended.unionByName(open_)


def count_document_tokens(docs: DataFrame, path: str, pattern: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens of every row of ``docs``, through flat files. Repeated rows and null doc_ids are kept."""
    listed = write_flat(docs, path, pattern, end_id)
    width = 2 if max(end_id, len(ranks_of(path))) < 1 << 16 else 4
    sizes = listed.select("file").distinct().mapInPandas(_sizes, "file string, bytes bigint")
    # Both sides grow with the documents, so neither is broadcast; the hash of a name is quicker to sort by than the name.
    named = lambda df: df.withColumn("name", F.xxhash64("file"))
    counts = named(count_tokens(sizes, end_id, width, BLOCK_IDS))
    return named(listed).hint("merge").join(counts, ["name", "number", "file"]).select("doc_id", "n_tokens")


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for uri in batch["file"]:
            store, path = open_store(uri)
            found.append(store.get_file_info(path).size)
        yield batch.assign(bytes=found)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return count_document_tokens(pages_of(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, len(ranks_of(path)))
