"""Token ids in files of byte planes.

Documents are ordered by id over range partitions, encoded, and their ids laid end to
end. Every segment of whole documents is cut into blocks of a fixed number of ids; a
block is transposed into byte planes (all lowest bytes, all second bytes, ...) or bit
planes, and each plane is compressed by itself: the high planes are nearly constant.
A segment is one row of a Parquet table with its chunk index (compressed size of every
plane of every block) and its documents, so any document is found without decoding
the others, and Spark writes, commits and reads the files on any store.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subdrift.llm.common import text_column

END_ID = 1
# The words of a worker's memo; it starts anew beyond.
MEMO_WORDS = 800_000

FILE_SCHEMA = (
    "part int, segment int, n_ids long, doc_ids array<long>, n_tokens array<long>, "
    "block_ids int, kind string, plane_sizes array<int>, planes binary"
)


@dataclass(frozen=True)
class Format:
    """``block_ids`` ids are transposed together (a multiple of 8), a segment is closed at
    ``segment_ids``; ``kind`` is "byte" or "bit"; ``part_bytes`` of text make a partition."""

    block_ids: int = 16_384
    segment_ids: int = 1 << 18
    kind: str = "byte"
    level: int = 3
    part_bytes: int = 16 << 20


def write_tokens(documents: DataFrame, path: str, vocabulary: str, form: Format = Format()) -> None:
    """Encodes ``documents`` (``doc_id``, ``text``) into files under ``path``.

    Ids ascend, null first; rows of equal id stand by text, and each is a document of its
    own. A null or empty text has the end id only. Other columns are ignored; an empty
    table writes an empty file. A single document is never cut over segments.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // form.part_bytes))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda batches: _encode(batches, vocabulary, form), FILE_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32``; ``start``
    counts the ids of all documents before it."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row per file and segment, without the planes.
    before = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("part", "segment", "n_ids").withColumn("_in_part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        files.groupBy("part").agg(F.sum("n_ids").alias("_n")).withColumn("_parts", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    offsets = segments.join(parts, "part").select("part", "segment", (F.col("_in_part") + F.col("_parts")).alias("_offset"))
    decoded = files.mapInArrow(
        _checksums, "part int, segment int, doc_id long, in_segment long, n_tokens long, ids_crc32 long"
    )
    return decoded.join(offsets, ["part", "segment"]).select(
        "doc_id", (F.col("_offset") + F.col("in_segment")).alias("start"), "n_tokens", "ids_crc32"
    )


class Encoder(dict):
    """Ids of words as bytes, filled on demand.

    The tokenizer drops white space and never joins across it, so words are encoded one
    by one and remembered. Plain letters with closing punctuation need no normalising
    but lower case: each part goes straight to the model, once for all words it ends or
    begins; everything else goes through the whole tokenizer.
    """

    # Letters that lower case and NFC leave single, then ASCII punctuation but the apostrophe.
    _PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
    # Separators of str.split() that the tokenizer takes as ordinary characters.
    _ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in shown]
        # The byte-level alphabet: printable bytes stand for themselves, others follow 255.
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, word: str) -> bytes:
        plain = self._PLAIN.fullmatch(word)
        if plain is None:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        else:
            letters, marks = plain[1].lower(), plain[2]
            if word != letters and word != marks:
                self[word] = found = (self[letters] if letters else b"") + (self[marks] if marks else b"")
                return found
            spelt = word if word.isascii() else word.encode().decode("latin1").translate(self.alphabet)
            ids = [t.id for t in self.tokenizer.model.tokenize(spelt)]
        self[word] = found = array("I", ids).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        if self._ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) > MEMO_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


def encoder(vocabulary: str) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    kept = sys.modules.setdefault("_llm_encoders", types.ModuleType("_llm_encoders")).__dict__
    if vocabulary not in kept:
        kept[vocabulary] = Encoder(vocabulary)
    return kept[vocabulary]


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, form: Format) -> Iterator[pa.RecordBatch]:
    encode, part = encoder(vocabulary).encode, TaskContext.get().partitionId()
    end = np.array([END_ID], "<u4").tobytes()
    segment, doc_ids, data, total = 0, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = encode(text) + end
            doc_ids.append(doc_id)
            data.append(ids)
            total += len(ids) // 4
            if total >= form.segment_ids:
                yield _segment(part, segment, doc_ids, data, form)
                segment, doc_ids, data, total = segment + 1, [], [], 0
    if doc_ids:
        yield _segment(part, segment, doc_ids, data, form)


def _segment(part: int, segment: int, doc_ids: list, data: list[bytes], form: Format) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(data), "<u4")
    sizes, planes = pack(ids, form)
    row = [part, segment, len(ids), doc_ids, [len(x) // 4 for x in data], form.block_ids, form.kind, sizes, planes]
    kinds = [
        pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
        pa.int32(), pa.string(), pa.list_(pa.int32()), pa.binary(),
    ]
    names = [field.split()[0] for field in FILE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


def pack(ids: np.ndarray, form: Format) -> tuple[list[int], bytes]:
    """Compressed planes of every block, end to end, and their sizes."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=form.level).compress
    packed = []
    for first in range(0, len(ids), form.block_ids):
        block = np.ascontiguousarray(ids[first : first + form.block_ids], "<u4").view(np.uint8).reshape(-1, 4)
        if form.kind == "bit":
            bits = np.unpackbits(block, axis=1, bitorder="little")
            packed += [compress(np.packbits(bits[:, i], bitorder="little").tobytes()) for i in range(32)]
        else:
            packed += [compress(block[:, i].tobytes()) for i in range(4)]
    return [len(p) for p in packed], b"".join(packed)


def unpack(n_ids: int, block_ids: int, kind: str, sizes: list[int], planes: bytes) -> np.ndarray:
    """The ids of a segment from its planes."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    ends = np.cumsum(sizes)
    plain = [np.frombuffer(expand(planes[e - s : e]), np.uint8) for e, s in zip(ends, sizes)]
    per_block = 32 if kind == "bit" else 4
    blocks = []
    for k in range(0, len(plain), per_block):
        n = min(block_ids, n_ids - k // per_block * block_ids)
        if kind == "bit":
            bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in plain[k : k + 32]], axis=1)
            blocks.append(np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel())
        else:
            blocks.append(np.stack(plain[k : k + 4], axis=1).view("<u4").ravel())
    return np.concatenate(blocks) if blocks else np.zeros(0, "<u4")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["n_ids"], row["block_ids"], row["kind"], row["plane_sizes"], row["planes"])
            raw, counts = memoryview(ids.tobytes()), np.array(row["n_tokens"], np.int64)
            ends = np.cumsum(counts)
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * len(counts), pa.int32()),
                    pa.array([row["segment"]] * len(counts), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - counts),
                    pa.array(counts),
                    pa.array(crc, pa.int64()),
                ],
                names=["part", "segment", "doc_id", "in_segment", "n_tokens", "ids_crc32"],
            )
