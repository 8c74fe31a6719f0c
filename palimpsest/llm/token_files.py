"""Operator 4, token-ID output: patched frame-of-reference blocks.

File format, version 1 (a Parquet table, so that any store Spark writes to will do and a lost
task leaves no half file). One row is a segment: whole documents in ascending doc_id order,
`SEGMENT_IDS` ids or one document more.

    part int            number of the file in doc_id order      seg int     number in the file
    doc_ids list<long>  the segment's documents                 lengths list<int>  ids of each
    n_ids long          their sum                               starts list<int>   byte at which each block starts
    blocks binary       the blocks, one after another

A block holds BLOCK_IDS ids (the last: the rest). Head, little-endian: minimum u4, ids u4,
exceptions u4, width u1. Then (id - minimum) in `width` bits each, lowest bit first, padded to a
byte; then the exceptions' places (u4) and the bits above the width (u4). The width is what the
PERCENTILE-th part of the block's differences needs; larger ones are the exceptions.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir
from .tokens import encoder

BLOCK_IDS = 4096
PERCENTILE = 0.98
SEGMENT_IDS = 1 << 17
HEAD = struct.Struct("<IIIB")
SCHEMA = "part int, seg int, doc_ids array<long>, lengths array<int>, n_ids long, starts array<int>, blocks binary"


def _bits(values: np.ndarray, width: int) -> bytes:
    """`width` bits of each value, lowest first, padded to a byte. Up to 16 bits eight values fill two 64-bit words."""
    if width > 16:
        lanes = np.unpackbits(values.astype("<u4").view(np.uint8), bitorder="little").reshape(len(values), 32)
        return np.packbits(lanes[:, :width].reshape(-1), bitorder="little").tobytes()
    eights = np.zeros(-(-len(values) // 8) * 8, np.uint64)
    eights[: len(values)] = values
    eights = eights.reshape(-1, 8).T
    words = np.zeros((eights.shape[1], 2), "<u8")
    for i, v in enumerate(eights):
        at = i * width
        if at < 64:
            words[:, 0] |= v << np.uint64(at)
            if at + width > 64:
                words[:, 1] |= v >> np.uint64(64 - at)
        else:
            words[:, 1] |= v << np.uint64(at - 64)
    return np.ascontiguousarray(words.view(np.uint8)[:, :width]).tobytes()[: -(-len(values) * width // 8)]


def _values(packed: np.ndarray, count: int, width: int) -> np.ndarray:
    if width > 16:
        lanes = np.zeros((count, 32), np.uint8)
        lanes[:, :width] = np.unpackbits(packed, count=count * width, bitorder="little").reshape(count, width)
        return np.packbits(lanes, axis=1, bitorder="little").reshape(-1).view("<u4").astype(np.uint32)
    rows = -(-count // 8)
    data = np.zeros((rows, 16), np.uint8)
    padded = np.zeros(rows * width, np.uint8)
    padded[: len(packed)] = packed
    data[:, :width] = padded.reshape(rows, width)
    words, out, mask = data.view("<u8"), np.empty((rows, 8), np.uint32), np.uint64((1 << width) - 1)
    for i in range(8):
        at = i * width
        if at < 64:
            v = words[:, 0] >> np.uint64(at)
            if at + width > 64:
                v = v | words[:, 1] << np.uint64(64 - at)
        else:
            v = words[:, 1] >> np.uint64(at - 64)
        out[:, i] = v & mask
    return out.reshape(-1)[:count]


def encode_blocks(ids: np.ndarray, block_ids: int = BLOCK_IDS, percentile: float = PERCENTILE) -> tuple[bytes, list[int]]:
    """The blocks of ids (unsigned 32-bit) and the byte at which each starts; no ids, no blocks."""
    out, starts, at = [], [], 0
    for begin in range(0, len(ids), block_ids):
        block = ids[begin : begin + block_ids].astype(np.uint32)
        low = int(block.min())
        over = block - np.uint32(low)
        rank = min(len(over) - 1, int(percentile * len(over)))
        width = int(np.partition(over, rank)[rank]).bit_length()
        high = (over.astype(np.uint64) >> np.uint64(width)).astype("<u4")
        places = np.flatnonzero(high).astype("<u4")
        low_bits = (over & np.uint32((1 << width) - 1)) if width < 32 else over
        data = HEAD.pack(low, len(block), len(places), width) + _bits(low_bits, width) + places.tobytes() + high[places].tobytes()
        starts.append(at)
        at += len(data)
        out.append(data)
    return b"".join(out), starts


def decode_block(data: bytes, start: int) -> np.ndarray:
    low, count, exceptions, width = HEAD.unpack_from(data, start)
    at, size = start + HEAD.size, -(-count * width // 8)
    over = _values(np.frombuffer(data, np.uint8, size, at), count, width) if width else np.zeros(count, np.uint32)
    if exceptions:
        places = np.frombuffer(data, "<u4", exceptions, at + size)
        high = np.frombuffer(data, "<u4", exceptions, at + size + 4 * exceptions)
        over[places] |= (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
    return over + np.uint32(low)


def _writer(tokenizer: str, end_id: int, segment_ids: int, added_tokens: bool):
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, seg = encoder(tokenizer, added_tokens=added_tokens).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        ids, kept, size = [], [], 0

        def flush():
            nonlocal seg, ids, kept, size
            blocks, starts = encode_blocks(np.frombuffer(b"".join(ids), "<u4"))
            row = [[part], [seg], [kept], [[len(x) // 4 for x in ids]], [size], [starts], [blocks]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int32()), pa.binary()]
            names = ["part", "seg", "doc_ids", "lengths", "n_ids", "starts", "blocks"]
            seg, ids, kept, size = seg + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(encode(text.as_py() or "") + end)
                kept.append(doc_id)
                size += len(ids[-1]) // 4
                if size >= segment_ids:
                    yield flush()
        if kept:
            yield flush()

    return write


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, added_tokens: bool = False
) -> None:
    """Encode every text (null: empty), append end_id and write the format above, in doc_id order.

    A hash of the text follows the id in the range key, so rows repeated under one id can still
    be split over files. Null ids come first. An empty table writes an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(_writer(tokenizer, end_id, SEGMENT_IDS, added_tokens), SCHEMA).write.option("compression", "lz4").parquet(path)


def _reader(batches):
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            ids = np.concatenate([decode_block(row["blocks"], s) for s in row["starts"]]) if row["starts"] else np.zeros(0, np.uint32)
            data, bounds = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(row["lengths"])])
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seg"]] * n, pa.int32()), pa.array(bounds[:-1], pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                ["part", "seg", "at", "doc_id", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the blocks: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it. Segments are numbered through the files'
    own counts: totals of parts along one window (a row per file), segments within a part.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    counts = files.select("part", "seg", "n_ids")
    before = lambda *p: Window.partitionBy(*p).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before().orderBy("part")), F.lit(0)).alias("part_start")
    )
    segments = counts.select("part", "seg", F.coalesce(F.sum("n_ids").over(before("part").orderBy("seg")), F.lit(0)).alias("seg_start"))
    rows = files.mapInArrow(_reader, "part int, seg int, at long, doc_id long, n_tokens long, ids_crc32 long")
    placed = rows.join(segments.join(parts, "part"), ["part", "seg"])
    return placed.select("doc_id", (F.col("part_start") + F.col("seg_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, added_tokens: bool = False) -> DataFrame:
    """Write the token files and describe each document from what was read back."""
    path = path or f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id, added_tokens=added_tokens)
    return read_token_files(docs.sparkSession, path)
