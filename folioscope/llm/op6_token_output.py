"""Token output as sorted-string-table shards.

Documents are dealt by ranges of doc_id and sorted; each task encodes its documents and writes one
shard. A shard is, in this order (all numbers little-endian):

  magic       8 bytes
  blocks      each: zstd of its entries. An entry is: bytes of the key shared with the entry before
              it (u8), bytes of the key that follow (u8), bytes of the value (u32), those bytes of
              the key, the value. A key is 0 (null) or 1, then doc_id as big-endian unsigned 64-bit
              with the sign bit flipped, so that byte order is numeric order. A value is the ids as
              u16 or u32. The first entry of a block shares nothing.
  index       one entry a block: key (9 bytes), offset (u64), stored bytes (u32), plain bytes (u32)
  filter      Bloom filter over the keys, BITS_A_KEY bits a key, HASHES probes
  footer      offset and count of the index, offset and bytes of the filter, documents, ids (6 x u64),
              bytes of an id (u32), crc32 of index and filter (u32), magic (8 bytes)

``Store`` finds a document by the shards' key ranges, filter, binary search in the index, and a scan of
one block.
``read`` streams all shards; places before a document are known from the shards' totals.
"""

from __future__ import annotations

import struct
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pages_of, shared_dir, text_rows
from .files import open_store, write_whole

MAGIC = b"FOLIOSST"
BLOCK_BYTES = 256 * 1024
BITS_A_KEY, HASHES = 10, 7
#: The word caches of a process, kept from task to task, are emptied at these sizes, which bounds their memory and changes no result.
MAX_CACHED_WORDS, MAX_CACHED_BYTES = 2_400_000, 60_000_000
_ENCODERS: dict = {}

#: ASCII signs that no alternative of the pattern treats apart (the apostrophe is one that does).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_FOOTER = struct.Struct("<6QII8s")
_ENTRY = struct.Struct("<BBI")
_INDEX = struct.Struct("<9sQII")
_MANIFEST = "shard string, first_key binary, last_key binary, documents bigint, ids bigint"


class _Words(dict):
    """Ids, as bytes, of words that follow a space; a word not yet known is encoded when it is asked for."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        e = self.encoder
        if word.isalpha() and word.isascii():  # the frequent case, without the ways of the others
            ids = e.pack([t.id for t in e.model.tokenize(e.space + word)])
        else:
            ids = e._ids(" " + word)
        e.cached += len(word) + len(ids)
        self[word] = ids
        return ids


class Encoder:
    """Encodes whole texts as the library does with a tokenizers file of byte-level BPE, a word at a time.

    A space between two characters that are not white space always begins a token, so text may be
    cut there; a piece's ids don't depend on what is around it. Each distinct piece is encoded once
    by the library's model. A text that holds the string of one of the file's added tokens is encoded
    by the library as a whole. Files of another kind are refused."""

    def __init__(self, path: str):
        import json
        import re

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cuts = said["pre_tokenizer"] or {}
        known = (cuts.get("type"), cuts.get("add_prefix_space"), cuts.get("use_regex", True)) == ("ByteLevel", False, True)
        plain = not any(said["model"].get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if said["model"].get("type") != "BPE" or said["normalizer"] or said["truncation"] or said["padding"] or not known or not plain:
            raise ValueError(f"{path}: not byte-level BPE without normaliser and prefix space")
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.added = [x["content"] for x in said["added_tokens"]]
        self.size = self.whole.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        self.chars = self._byte_chars()
        self.mapped = dict(enumerate(self.chars))
        self.space = self.chars[32]
        # The pattern that byte-level BPE of this kind cuts its words by (a fixed value of the format).
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.rare_space = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.clear()

    @staticmethod
    def _byte_chars() -> list[str]:
        """The character that stands for each byte in the vocabulary: itself if printable, else the next from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]

    def clear(self) -> None:
        self.words: dict[str, bytes] = _Words(self)
        self.known: dict[str, bytes] = {}
        self.cached = 0

    def pack(self, ids: list[int]) -> bytes:
        out = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def odd(self, text: str) -> bool:
        """Whether a space may stand at an end of the text or beside other white space."""
        return text[:1] == " " or text[-1:] == " " or any(x in text for x in ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r")) or self.rare_space(text) is not None

    def _ids(self, text: str) -> bytes:
        core = text[1:] if text[:1] == " " else text
        if core.isalpha():
            return self._piece(text)
        # Most other words are letters with marks behind them: two pieces of the pattern.
        word = core.rstrip(_MARKS)
        if word.isalpha():
            cut = len(text) - len(core) + len(word)
            pieces = text[:cut], text[cut:]
        else:
            pieces = self.pieces(text)
        if len(pieces) == 1:
            return self._piece(text)
        out = []
        for piece in pieces:
            ids = self.words.get(piece[1:]) if piece[0] == " " else None
            if ids is None:
                ids = self.known.get(piece)
            if ids is None:
                ids = self.known[piece] = self._piece(piece)
                self.cached += len(piece) + len(ids)
            out.append(ids)
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            mapped = piece.replace(" ", self.space)
        else:
            mapped = piece.encode("utf-8").decode("latin-1").translate(self.mapped)
        return self.pack([t.id for t in self.model.tokenize(mapped)])

    def encode(self, text: str) -> bytes:
        """The ids, ``width`` bytes each, little-endian."""
        if any(x in text for x in self.added):
            return self.pack(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self.words) + len(self.known) > MAX_CACHED_WORDS or self.cached > MAX_CACHED_BYTES:
            self.clear()
        words = iter(self.cut(text) if self.odd(text) else text.split(" "))
        first = next(words)
        return (self._ids(first) if first else b"") + b"".join(map(self.words.__getitem__, words))


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places in the filter of 64-bit keys, by double hashing."""
    with np.errstate(over="ignore"):
        a = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        a ^= a >> np.uint64(29)
        b = (a * np.uint64(0xC4CEB9FE1A85EC53)) | np.uint64(1)
        return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) >> np.uint64(16)) % np.uint64(bits)


def _filter_key(doc_id: int | None) -> int:
    return 0 if doc_id is None else doc_id % (1 << 64)


class ShardWriter:
    """Takes documents in ascending order of their keys."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at, self.index, self.keys = 0, [], []
        self.block, self.block_bytes, self.first, self.last = [], 0, b"", b""
        self.documents = self.ids = 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.put(doc_id, ids.astype(f"<u{self.width}").tobytes())

    def put(self, doc_id: int | None, value: bytes) -> None:
        """The same for ids that are bytes of the right width."""
        key = key_of(doc_id)
        shared = 0
        if self.block:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += [_ENTRY.pack(shared, 9 - shared, len(value)), key[shared:], value]
        self.block_bytes += _ENTRY.size + 9 - shared + len(value)
        self.last = key
        self.keys.append(_filter_key(doc_id))
        self.documents += 1
        self.ids += len(value) // self.width
        if self.block_bytes >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            stored = self.pack.compress(b"".join(self.block))
            self.index.append(_INDEX.pack(self.first, self.at, len(stored), self.block_bytes))
            self._put(stored)
            self.block, self.block_bytes = [], 0

    def close(self) -> None:
        self._flush()
        index_at, index = self.at, b"".join(self.index)
        bits = -(-max(1, len(self.keys)) * BITS_A_KEY // 64) * 64
        filter_ = np.zeros(bits, bool)
        filter_[_probes(np.array(self.keys, np.uint64), bits)] = True
        packed = np.packbits(filter_).tobytes()
        self._put(index)
        self._put(packed)
        self._put(_FOOTER.pack(index_at, len(self.index), index_at + len(index), len(packed), self.documents, self.ids, self.width, zlib.crc32(index + packed), MAGIC))


class Shard:
    """A shard opened for reading; index and filter are kept, blocks are read one at a time."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        index_at, blocks, filter_at, filter_bytes, self.documents, self.ids, self.width, crc, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri}: not a shard")
        index, self.filter = self.file.read_at(filter_at - index_at, index_at), self.file.read_at(filter_bytes, filter_at)
        if zlib.crc32(index + self.filter) != crc:
            raise ValueError(f"{uri}: index or filter is damaged")
        self.index = [_INDEX.unpack_from(index, i * _INDEX.size) for i in range(blocks)]
        self.firsts = [x[0] for x in self.index]
        self.unpack = zstandard.ZstdDecompressor()

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, stored, plain = self.index[i]
        data = self.unpack.decompress(self.file.read_at(stored, at), max_output_size=plain)
        place, key = 0, b""
        while place < len(data):
            shared, more, size = _ENTRY.unpack_from(data, place)
            place += _ENTRY.size
            key = key[:shared] + data[place : place + more]
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, place + more)
            place += more + size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self.block(i):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that identifier."""
        probes = _probes(np.array([_filter_key(doc_id)], np.uint64), len(self.filter) * 8)[0]
        if not all(self.filter[int(p) >> 3] >> (7 - (int(p) & 7)) & 1 for p in probes):
            return []
        key = key_of(doc_id)
        # Equal keys may begin in the block before the first that begins with the key.
        low, high = max(bisect_left(self.firsts, key) - 1, 0), bisect_right(self.firsts, key)
        return [ids for j in range(low, high) for k, ids in self.block(j) if k == key]


def _writer(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        done: dict = {}

        def write(out) -> None:
            shard = ShardWriter(out, encoder.width)
            end = encoder.pack([end_id])
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    i = None if pd.isna(doc_id) else int(doc_id)
                    done.setdefault("first", key_of(i))
                    done["last"] = i
                    shard.put(i, encoder.encode(text or "") + end)
            shard.close()
            done["counts"] = shard.documents, shard.ids

        uri = write_whole(folder, "shard", write)
        documents, ids = done["counts"]
        if documents:
            yield pd.DataFrame({"shard": [uri], "first_key": [done["first"]], "last_key": [key_of(done["last"])], "documents": [documents], "ids": [ids]})

    return run


def write(docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the shards and returns their list: shard, first_key and last_key, documents, ids, start (ids in all shards before it).

    The list has one row a shard and is gathered on the driver; documents never are. Null doc_ids
    come first; rows that share a doc_id are kept and ordered by a hash of their text; a null text counts
    as empty (its only id is ``end_id``). An empty table gives no shard."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-shards")
    rows = text_rows(docs).withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = dealt.mapInPandas(_writer(folder, path, end_id), _MANIFEST).toPandas()
    shards = shards.sort_values(["first_key", "last_key"], kind="stable").reset_index(drop=True)
    shards["start"] = shards["ids"].cumsum() - shards["ids"]
    return spark.createDataFrame(shards, f"{_MANIFEST}, start bigint")


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for uri, start in zip(batch["shard"], batch["start"], strict=True):
            out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for doc_id, ids in Shard(uri):
                for k, v in (("doc_id", doc_id), ("start", start), ("n_tokens", len(ids)), ("ids_crc32", zlib.crc32(ids.astype("<u4").tobytes()))):
                    out[k].append(v)
                start += len(ids)
                if len(out["start"]) >= 10_000:
                    yield pd.DataFrame(out | {"doc_id": pd.array(out["doc_id"], "Int64")})
                    out = {k: [] for k in out}
            yield pd.DataFrame(out | {"doc_id": pd.array(out["doc_id"], "Int64")})


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the shards, one task a shard."""
    n = max(1, shards.count())
    return shards.repartition(n, "shard").mapInPandas(_reader, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


class Store:
    """The shards' list, kept in order of keys, for lookups that open only shards whose range holds the key."""

    def __init__(self, shards: DataFrame):
        rows = sorted(((bytes(r["first_key"]), bytes(r["last_key"]), r["shard"]) for r in shards.collect()), key=lambda x: x[:2])
        self.first, self.last, self.uris = ([x[i] for x in rows] for i in range(3))
        self.open: dict[str, Shard] = {}

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that identifier."""
        key, found = key_of(doc_id), []
        # Ranges don't overlap but at equal keys, so both ends are in order.
        for i in range(bisect_left(self.last, key), bisect_right(self.first, key)):
            uri = self.uris[i]
            if uri not in self.open:
                self.open[uri] = Shard(uri)
            found += self.open[uri].get(doc_id)
        return found


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read(write(pages_of(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
