"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Encoding. Texts are cut by the pre-token pattern. Each block of documents (about BLOCK_CHARS of text)
keeps a list of its distinct pre-tokens, the frequent ones first, and for each of its pre-tokens, in
order, the place it has in that list: pre-tokens exploded with positions, the positions packed. The
lists are dealt by the pre-tokens' hash into BUCKETS, and those of all blocks meet in one shuffle over
the corpus; there each distinct pre-token is encoded once, and the ids are joined back to every block
that asked. The documents are then reassembled by position: the task that has a block's ids reads its
positions from the block table, so that texts and positions never move. A frequent pre-token is asked
for once by each block, so no key is hotter than the number of blocks; what moves is packed and compressed.

Decoding. Ids are joined with the table of token bytes (the vocabulary, of bounded and checked size)
and the documents' bytes put together by position.

The block table is written to the shared folder: the shuffle and the reassembly read the same blocks,
also after an executor is lost.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pages_of, text_rows
from .files import open_store

BLOCK_CHARS = 8_000_000
BUCKETS = 1024
MAX_VOCABULARY = 1_000_000

_BLOCKS = "block string, doc_ids array<bigint>, sizes binary, places binary, buckets binary, asked array<struct<bucket:int,sizes:binary,words:binary>>"
_RANKS: dict[str, dict[bytes, int]] = {}
_ENCODERS: dict = {}


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file, read once by each process."""
    if path not in _RANKS:
        with open(path, "rb") as f:
            _RANKS[path] = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if len(_RANKS[path]) > MAX_VOCABULARY:
            raise ValueError(f"{path}: more than {MAX_VOCABULARY} tokens")
    return _RANKS[path]


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        _ENCODERS[path, pattern] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
    return _ENCODERS[path, pattern]


def _one_piece(encoder):
    """Ids of one pre-token, given as bytes. The library's own call for it isn't public; where it is missing or differs, the
    public one is used, whose pattern leaves a pre-token whole."""
    core = getattr(getattr(encoder, "_core_bpe", None), "encode_single_piece", None)
    try:
        if core and all(core(x) == encoder.encode_ordinary(x.decode()) for x in (b"a", b" word", b" tokens")):
            return core
    except Exception:
        pass
    return lambda word: encoder.encode_ordinary(word.decode("utf-8"))


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane (the high planes of small numbers are all zero), compressed."""
    return zstandard.ZstdCompressor(level=3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _join(words: list[bytes]) -> tuple[bytes, bytes]:
    return _pack(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def _blocks(pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        find = regex.compile(pattern).findall

        def cut(index: dict, places: list[np.ndarray], doc_ids: list, name) -> pd.DataFrame:
            words = np.array([w.encode("utf-8") for w in index], object)
            flat = np.concatenate(places) if places else np.empty(0, np.uint32)
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            words = words[order]
            bucket = np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.uint16, len(words))
            by = np.argsort(bucket, kind="stable")
            borders = np.searchsorted(bucket[by], np.arange(BUCKETS + 1))
            asked = []
            for b in np.flatnonzero(np.diff(borders)):
                sizes, packed = _join(words[by[borders[b] : borders[b + 1]]].tolist())
                asked.append({"bucket": int(b), "sizes": sizes, "words": packed})
            if not asked:  # a block of empty texts still has to be answered
                asked = [dict(zip(("bucket", "sizes", "words"), (0, *_join([])), strict=True))]
            return pd.DataFrame(
                {"block": [name.hexdigest()], "doc_ids": [doc_ids], "sizes": [_pack(np.array([len(x) for x in places], np.uint32))], "places": [_pack(rank[flat])], "buckets": [_pack(bucket)], "asked": [asked]}
            )

        index = defaultdict(count().__next__)
        places, doc_ids, chars, name = [], [], 0, hashlib.sha256()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                words = find(text)
                places.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                name.update(f"{doc_id} {len(words)} ".encode() + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield cut(index, places, doc_ids, name)
                    index = defaultdict(count().__next__)
                    places, doc_ids, chars, name = [], [], 0, hashlib.sha256()
        if doc_ids:
            yield cut(index, places, doc_ids, name)

    return run


def _encode_words(path: str, pattern: str):
    """Rows come sorted by bucket: the words of one bucket are kept while its rows last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = _one_piece(_encoder(path, pattern))
        now, known = None, {}
        for batch in batches:
            lengths, ids = [], []
            for bucket, sizes, words in zip(batch["bucket"], batch["sizes"], batch["words"], strict=True):
                if bucket != now:
                    now, known = bucket, {}
                data, at, found = zstandard.ZstdDecompressor().decompress(words), 0, []
                for size in _unpack(sizes).tolist():
                    word = data[at : at + size]
                    at += size
                    got = known.get(word)
                    if got is None:
                        got = known[word] = one(word)
                    found.append(got)
                lengths.append(_pack(np.fromiter(map(len, found), np.uint32, len(found))))
                ids.append(_pack(np.fromiter(chain.from_iterable(found), np.uint32)))
            yield pd.DataFrame({"in_block": batch["in_block"], "path": batch["path"], "bucket": batch["bucket"], "lengths": lengths, "ids": ids})

    return run


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that ``places`` name, one after the other."""
    n = lengths[places]
    total = int(n.sum())
    if not total:
        return flat[:0]
    begin = np.repeat(starts[places] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return flat[begin + np.arange(total)]


def _pieces(values: list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(values), dtype), np.concatenate(([0], np.cumsum(lengths)))[: len(values)].astype(np.int64), lengths


def _stored(path: str, block: str) -> Iterator[dict]:
    """Rows of a block in its file of the block table, each a row group of its own that the file's footer names."""
    from pyarrow import parquet

    wanted = ["doc_ids", "sizes", "places", "buckets"]
    store, at = open_store(path)
    with store.open_input_file(at) as f:
        file = parquet.ParquetFile(f)
        for i in range(file.num_row_groups):
            told = file.metadata.row_group(i).column(0).statistics
            if told is not None and told.has_min_max and not told.min <= block <= told.max:
                continue
            for name, *row in zip(*(file.read_row_group(i, columns=["block", *wanted]).column(c).to_pylist() for c in ("block", *wanted)), strict=True):
                if name == block:
                    yield dict(zip(wanted, row, strict=True))


def _reassemble(table=None):
    """Documents of a block from its answers: for each bucket, the ids of the words that it asked for, in the order of
    asking. With the token-byte table the ids are decoded in the same task."""

    def run(key: tuple, answers: pd.DataFrame) -> pd.DataFrame:
        block, path = key
        answers = answers.drop_duplicates("bucket").sort_values("bucket")  # equal blocks ask alike
        flat = np.concatenate([np.empty(0, np.uint32), *(_unpack(x) for x in answers["ids"])])
        in_order = np.concatenate([np.empty(0, np.int64), *(_unpack(x) for x in answers["lengths"])]).astype(np.int64)
        doc_ids, ids = [], []
        for row in _stored(path, block):
            order = np.argsort(_unpack(row["buckets"]), kind="stable")
            lengths, starts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            lengths[order] = in_order
            starts[order] = np.cumsum(in_order) - in_order
            places, at = _unpack(row["places"]), 0
            for doc_id, size in zip(row["doc_ids"], _unpack(row["sizes"]).tolist(), strict=True):
                doc_ids.append(doc_id)
                ids.append(_gather(flat, starts, lengths, places[at : at + size]).astype("<u4").tobytes())
                at += size
        out = pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "ids": pd.Series(ids, dtype=object)})
        return out if table is None else _decoded(out, table.value)

    return run


def encode(docs: DataFrame, path: str, pattern: str, decode_too: bool = False) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit), one row for each row of ``docs``; with ``decode_too``
    also what ``decode`` adds.

    A null text counts as empty and has no ids. A null doc_id is kept; rows that repeat are encoded
    each; other columns are not read; an empty table gives an empty result."""
    blocks = materialise(text_rows(docs).mapInPandas(_blocks(pattern), _BLOCKS), "bpe-blocks", **{"parquet.block.row.count.limit": "1"})
    asked = blocks.select(F.col("block").alias("in_block"), F.col("_metadata.file_path").alias("path"), F.inline("asked"))
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_encode_words(path, pattern), "in_block string, path string, bucket int, lengths binary, ids binary")
    table = _shared_table(docs.sparkSession, path) if decode_too else None
    return answers.groupBy("in_block", "path").applyInPandas(_reassemble(table), "doc_id bigint, ids binary" + ", n_tokens bigint, decoded binary" * decode_too)


def token_bytes(spark: SparkSession, path: str) -> DataFrame:
    """id and bytes of every token; at most MAX_VOCABULARY rows."""
    table = pd.DataFrame([(i, b) for b, i in ranks_of(path).items()], columns=["id", "bytes"])
    return spark.createDataFrame(table, "id bigint, bytes binary")


def _shared_table(spark: SparkSession, path: str):
    """The token-byte table for a join by id in the tasks: sorted ids, and their bytes as one string with places."""
    table = sorted((i, b) for b, i in ranks_of(path).items())
    flat, starts, lengths = _pieces([b for _, b in table], "u1")
    return spark.sparkContext.broadcast((np.array([i for i, _ in table], np.uint32), flat.tobytes(), starts, lengths))


def _decoded(batch: pd.DataFrame, table: tuple) -> pd.DataFrame:
    known, flat, starts, lengths = table
    flat = np.frombuffer(flat, np.uint8)
    decoded, counts = [], []
    for packed in batch["ids"]:
        ids = np.frombuffer(packed, "<u4")
        at = np.searchsorted(known, ids)
        if len(ids) and (at.max(initial=0) >= len(known) or (known[at] != ids).any()):
            raise ValueError("an id is not in the vocabulary")
        decoded.append(_gather(flat, starts, lengths, at).tobytes())
        counts.append(len(ids))
    return batch.assign(n_tokens=np.array(counts, np.int64), decoded=pd.Series(decoded, index=batch.index, dtype=object))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds n_tokens and decoded (binary) to doc_id and ids.

    The join with the token-byte table is a lookup by id in the broadcast table, whose size is that of the vocabulary."""
    shared = _shared_table(encoded.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _decoded(batch, shared.value)

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id bigint, ids binary, n_tokens bigint, decoded binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves."""
    out = encode(docs, path, pattern, decode_too=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = pages_of(spark, sf_dir, "documents")
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("ids")
