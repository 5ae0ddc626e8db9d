"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is one document::

    u32 length | u32 masked crc of those 4 bytes | payload | u32 masked crc of the payload | line feed

and the payload is ``i64 document id | u8 has an id | u8 bytes per token | token ids``, all
little-endian.  The line feed lets Spark's own text writer put records into files on any store
it can reach.  Files hold documents in ascending id order; the number of the part and of the file in it, both in the name, follow that order.
A file has RECORDS records at most. Where one id holds more rows than a file should, its rows are dealt by the first characters of their texts.

Defined results: a null text is empty and has the end id alone; a null id comes first and
stays null; rows with the same id are ordered by text; an empty table writes no file; only
the id and text columns are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .tables import PARTITIONS, batch, pick, pieces_for, shared_dir

FILE_BYTES = 6 << 20  # of input for each part
RECORDS = 100_000  # of a file
LEADING = 16  # characters of a text that deal the rows of one id
END = 2
_HEAD = struct.Struct("<qBB")
_FRAME = pa.schema([("record", pa.binary())])
INDEX = pa.schema([("file", pa.string()), ("position", pa.int64()), ("size", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = _HEAD.pack(doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<I", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)), b"\n"))


def unframe(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids, position past the record); raises on a broken record."""
    length = data[at : at + 4]
    size, crc = struct.unpack_from("<II", data, at)
    payload = data[at + 8 : at + 8 + size]
    end = at + size + 12
    if masked(length) != crc or len(payload) != size or masked(payload) != struct.unpack_from("<I", data, end - 4)[0] or data[end : end + 1] != b"\n":
        raise ValueError(f"broken record at byte {at}")
    doc_id, known, width = _HEAD.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size), end + 1


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the files; documents in id order over files in name order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        width = 2 if max(encoder.size, end + 1) <= 1 << 16 else 4
        for b in batches:
            ids_of = b.column(0).to_pylist()
            for i, j, ids, offs in encoder.encode(b.column(1)):
                yield batch(_FRAME, [frame(ids_of[i + k], np.append(ids[offs[k] : offs[k + 1]], end), width)[:-1] for k in range(j - i)])

    parts, rows = min(PARTITIONS, pieces_for(docs, FILE_BYTES)), pick(docs, doc_id, text)
    order = [F.col("doc_id").asc_nulls_first()]
    # The ranges come from a sample of keys on the driver, where texts have no place, and their first characters only if need be.
    if has_hot_id(rows, parts):
        order.append(F.substring("text", 1, LEADING).asc_nulls_first())
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", RECORDS).text(path)


def has_hot_id(rows: DataFrame, parts: int) -> bool:
    """Does one id (or none) hold more rows than four parts should? Reads ids alone; a superset of all such ids, of bounded size, is counted exactly."""
    if parts < 8:
        return False
    share = max(4 / parts, 1e-4)
    ids = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    some = ids.stat.freqItems(["id"], share).first()[0] or []
    n = ids.count()
    top = ids.where(F.col("id").isin(some)).groupBy("id").count().agg(F.max("count")).first()[0] if some else 0
    return (top or 0) > share * n


def file_order(name: str) -> tuple[int, int]:
    """Number of the part and of the file in it, by which files follow each other; names themselves do so up to 99,999 parts only."""
    found = re.match(r"part-(\d+).*?(?:-c(\d+))?(?:\.[^-]*)?$", name)
    return int(found[1]), int(found[2] or 0)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            name, data = b.column(0)[k].as_py(), b.column(1)[k].as_buffer().to_pybytes()
            at, before, rows = 0, 0, []
            while at < len(data):
                doc_id, ids, end = unframe(data, at)
                rows.append((name, at, end - at, doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at, before = end, before + len(ids)
            yield batch(INDEX, *(list(x) for x in zip(*rows, strict=True))) if rows else batch(INDEX, *[[]] * len(INDEX))


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, read and checked: file, position and size in it, id, tokens before it in the file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(_parse, "file string, position long, size long, doc_id long, before long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, vocabulary: str, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the documents, reads the files back, and returns each one's place among all ids."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    write_tokens(docs, f"{path}/tokens", vocabulary, end, doc_id, text)
    index(spark, f"{path}/tokens").write.parquet(f"{path}/index")
    rows = spark.read.parquet(f"{path}/index")
    # One row for each file: a few bytes for every FILE_BYTES of input.
    files = sorted(((r.file, r.n) for r in rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()), key=lambda x: file_order(x[0]))
    ends = np.cumsum([0, *(n for _, n in files)]).tolist()
    first = spark.createDataFrame([(f, e) for (f, _), e in zip(files, ends, strict=False)] or [("", 0)], "file string, first long")
    return rows.join(F.broadcast(first), "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "position", "size")
