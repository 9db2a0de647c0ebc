"""Token ids in length-delimited binary records with masked checksums, and an offset index beside them.

A record is: payload length (8 bytes), masked checksum of these 8 bytes (4), payload, masked checksum of the payload (4), and the
byte 0x0A. The payload is: 1 if the document has an id, else 0 (1 byte), the id (8, signed), the number of token ids (4), and the
ids with the 2 or 4 bytes each that the length implies. All numbers are little-endian. A masked checksum is a CRC-32, rotated right by 15 bits
plus 0xA282EAD8, so that checksums of data that holds checksums stay apart. Files are named in the order of the document ids.
Spark's text writer writes the files (each record as one value, 0x0A as its separator), so its commit protocol keeps them whole when an
executor is lost, and any file system that Spark knows will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweir.llm.tokens import encoder

_MASK = 0xA282EAD8
_HEAD, _BODY = "<QI", "<BqI"
_NARROW = 1 << 16


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, narrow: bool) -> bytes:
    """One record, without the byte that Spark's writer puts after it."""
    body = struct.pack(_BODY, doc_id is not None, doc_id or 0, len(ids)) + ids.astype("<u2" if narrow else "<u4").tobytes()
    length = struct.pack("<Q", len(body))
    return b"".join([length, masked(length).to_bytes(4, "little"), body, masked(body).to_bytes(4, "little")])


def frames(content: memoryview) -> Iterator[tuple[int, int, int | None, int]]:
    """(offset, length, doc_id, number of ids) of each record of a file; a wrong length or checksum raises ValueError."""
    at = 0
    while at < len(content):
        length, check = struct.unpack_from(_HEAD, content, at)
        if masked(bytes(content[at : at + 8])) != check or at + length + 17 > len(content):
            raise ValueError(f"broken record length at byte {at}")
        has_id, doc_id, n = struct.unpack_from(_BODY, content, at + 12)
        yield at, length + 17, doc_id if has_id else None, n
        at += length + 17


def payload_ids(content: memoryview, at: int) -> np.ndarray:
    """The ids of the record at a byte of its file, after a test of its checksum."""
    length, _ = struct.unpack_from(_HEAD, content, at)
    body = content[at + 12 : at + 12 + length]
    if masked(body) != int.from_bytes(content[at + 12 + length : at + 16 + length], "little"):
        raise ValueError(f"broken record at byte {at}")
    n = struct.unpack_from(_BODY, body)[2]
    width = (length - struct.calcsize(_BODY)) // n if n else 2
    return np.frombuffer(body, f"<u{width}", n, struct.calcsize(_BODY))


def write_records(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Write the ids of every whole text, each with `end` after it, in ascending order of `doc_id`, and the index to `path`-index.

    Only (doc_id, text) are read. A null text counts as empty, a null doc_id comes first, rows with the same id are ordered
    by their text, an empty table gives no records. Texts are dealt by ranges of ids before they are encoded.
    """
    narrow = _vocabulary(tokenizer) <= _NARROW

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids, texts = (part.column(i).to_pylist() for i in (0, 1))
                rows = [frame(d, words.encode(t, end), narrow) for d, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value")).write.text(path, lineSep="\n")
    write_index(docs.sparkSession, path)


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, content): `file` is the place of a file in the order of the ids."""
    number = F.regexp_extract("path", "part-(\\d+)[^/]*$", 1).cast("int")
    return spark.read.format("binaryFile").load(path).select("path", number.alias("file"), "content")


def write_index(spark: SparkSession, path: str) -> None:
    """(file, path, offset, length, doc_id, n_tokens, tokens_before): tokens_before counts those of the same file."""
    schema = "file int, path string, offset long, length long, doc_id long, n_tokens long, tokens_before long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, number, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                found = list(frames(memoryview(content.as_buffer())))
                offset, length, doc_id, n = (list(x) for x in zip(*found, strict=True)) if found else ([],) * 4
                before = np.cumsum([0, *n])[:-1]
                same = [[x.as_py()] * len(n) for x in (number, name)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same[0], pa.int32()), pa.array(same[1], pa.string()), *(pa.array(x, pa.int64()) for x in (offset, length, doc_id, n, before))],
                    ["file", "path", "offset", "length", "doc_id", "n_tokens", "tokens_before"],
                )

    files(spark, path).select("path", "file", "content").mapInArrow(scan, schema).write.parquet(f"{path}-index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with `start`, the ids in all records before. Files are few, so their running total is taken in one window."""
    index = spark.read.parquet(f"{path}-index")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("_n")).select(
        "file", (F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_first")
    )
    return index.join(totals, "file").withColumn("start", F.col("_first") + F.col("tokens_before")).drop("_first")


def read_records(spark: SparkSession, path: str, picked: DataFrame | None = None, with_ids: bool = True) -> DataFrame:
    """(file, offset, doc_id, ids_crc32, ids) of all records, or of the index rows in `picked`, such as the next share of a
    shuffled order. `ids_crc32` is of the ids as little-endian unsigned 32-bit integers; without `with_ids` the ids themselves are left out."""
    schema = "file int, offset long, doc_id long, ids_crc32 long" + ", ids array<int>" * with_ids
    content = files(spark, path).withColumn("offsets", F.lit(None).cast("array<bigint>"))
    if picked is not None:
        content = content.drop("offsets").join(picked.groupBy("file").agg(F.collect_list("offset").alias("offsets")), "file")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, offsets in zip(*(batch.column(i) for i in range(3)), strict=True):
                view, wanted = memoryview(data.as_buffer()), offsets.as_py()
                at = [x[0] for x in frames(view)] if wanted is None else wanted
                for part in (at[i : i + 512] for i in range(0, len(at), 512)):
                    doc_ids = [struct.unpack_from(_BODY, view, x + 12) for x in part]
                    ids = [payload_ids(view, x) for x in part]
                    columns = {
                        "file": pa.array([number.as_py()] * len(part), pa.int32()), "offset": pa.array(part, pa.int64()),
                        "doc_id": pa.array([d if has else None for has, d, _ in doc_ids], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    }
                    if with_ids:
                        bounds = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                        columns["ids"] = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(ids).astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(columns)

    return content.select("file", "content", "offsets").mapInArrow(decode, schema)
