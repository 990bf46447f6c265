"""Token ids of texts and their ORC files.

Encoding is that of the tokenizers library. Where a vocabulary file has the normalizer and pre-tokenizer below, which
never join what white space separates, ids are looked up by white-space-separated chunk and the library encodes each new chunk once;
the bounded cache changes no result (two generations of chunks: what is used again outlives the change). Texts go
through the library whole with any other file. Null texts have no ids of their own.

Files: rows in ascending doc_id (nulls first, equal ids by a hash of the text), range-partitioned, numbered, with
ids as ORC integer lists (run-length encoded), stripes of `stripe_bytes`, a row index every
`index_rows` rows and Bloom filters on doc_id, so that readers take stripes in parallel and skip by metadata.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, small_batches, stored, texts

VOCABULARY = "word_bpe_49k.json"
SCHEMA = "doc_id long, row long, ids array<int>"
CACHE, SMALL_CACHE = 300_000, 120_000  # chunks of a generation: where a worker does nothing else, and within a pipeline
STRIPE_BYTES, INDEX_ROWS, FILE_BYTES = 8_388_608, 1_000, 268_435_456
#: Latin-1 letters and then marks: two pieces for the pre-tokenizer, the first one lower-cased letter by letter.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")


# The steps before the model for which chunks and plain words give what whole texts give.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Chunks(dict):
    """White-space-separated chunk -> ids as little-endian unsigned 32-bit integers. Plain words go to the library's
    model directly, as its normalizer and pre-tokenizer would hand them on; all else through the whole of it."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.letters = _byte_letters()
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is not None:
            self[chunk] = ids
            return ids
        text = chunk.decode("utf-8")
        if len(chunk) > 64:  # hardly comes again
            return self.encoded(text)
        plain = _PLAIN.fullmatch(text)
        if not plain:
            ids = self.encoded(text)
        elif plain[2]:
            ids = self[plain[1].encode()] + self[plain[2].encode()]
        elif (low := text.lower()) != text:
            ids = self[low.encode()]
        else:
            word = text if chunk.isascii() else "".join(map(self.letters.__getitem__, chunk))
            ids = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        self[chunk] = ids
        return ids

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Encoder:
    """ids(text) -> bytes of little-endian unsigned 32-bit integers, without an end id."""

    def __init__(self, path: str, cache: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.cache = cache
        tokenizer = Tokenizer.from_file(path)
        steps = json.loads(tokenizer.to_str())
        self.by_chunk = (steps["normalizer"], steps["pre_tokenizer"], steps["truncation"], steps["padding"]) == (NORMALIZER, PRE_TOKENIZER, None, None)
        self.chunks = _Chunks(tokenizer)

    def ids(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk:
            return self.chunks.encoded(text.decode("utf-8"))
        if len(self.chunks) > (self.cache or CACHE):
            self.chunks.age()
        return b"".join(map(self.chunks.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str, cache: int | None = None) -> Encoder:
    """One for each Python worker, so that its cache outlives a task."""
    return Encoder(path, cache)


def _path(vocabulary: str) -> str:
    return public_tokenizers.path(vocabulary)


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, row = encoder(path), np.array([end], "<u4").tobytes(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [own.ids(t) + last for t in texts(part.column(1))]
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.record_batch([part.column(0), pa.array(np.arange(row, row + len(ids))), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "row", "ids"])
                row += len(ids)

    return run


def write_orc(docs: DataFrame, path: str, end: int = 1, vocabulary: str = VOCABULARY, stripe_bytes: int = STRIPE_BYTES, index_rows: int = INDEX_ROWS) -> None:
    """One file for each range of doc_id, its number in its name: doc_id, row (place in the file) and ids with the end id. There are as many
    files as the session has shuffle partitions, and more where these would hold more than `FILE_BYTES` of text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ids = docs.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_encode(_path(vocabulary), end), SCHEMA)
    (
        ids.write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows).option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).option("compression", "zstd").orc(path)
    )


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id skip files, stripes and row groups by their statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        crc = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(offsets, offsets[1:])]
        yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), *batch.columns[2:]], names=["doc_id", "n_tokens", "ids_crc32", "file", "row"])


def read_sums(rows: DataFrame) -> DataFrame:
    """Per row of the files: doc_id, start, n_tokens, ids_crc32. A start is the sum of the files before and of the rows before in the file."""
    rows = rows.select("doc_id", "ids", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file"), "row")
    rows, _ = stored(rows.mapInArrow(_sums, "doc_id long, n_tokens long, ids_crc32 long, file int, row long"), "sums")
    own = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    files = files.withColumn("first", F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "first")
    return rows.join(files, "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, end: int = 1, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the ids of all documents and describe them as read back."""
    small_batches(docs.sparkSession)
    path = new_path(docs.sparkSession, "tokens")
    write_orc(docs, path, end, vocabulary)
    return read_sums(read_orc(docs.sparkSession, path))
