"""Operator 3, packing along a space-filling curve.

Every document is encoded once; its ids, hashed into a small vector and projected to DIMENSIONS
numbers, give its place on a Hilbert curve. Documents are range-sorted by that key (then by id,
so that a group of equal texts, which share one key, is still split over tasks) and laid end to
end; each task cuts its stretch of the curve into sequences of 4096 ids. What is left at the end
of a stretch is cut into sequences whose lengths are powers of two, so no sequence needs padding.

With a source column the sequences follow operator 7's mixture: its slots are cut into ranges of
RANGE_SLOTS, the ranges come in order, and the curve runs inside each.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing
from .common import materialize, slices
from .tokens import encoder, release

SEQUENCE = 4096
DIMENSIONS = 4
KEY_BITS = 12
BUCKETS = 256
#: Slots of the mixture (of mixing.BLOCK_DOCS documents each) that share one stretch of the curve.
RANGE_SLOTS = 64


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with `bits` bits in each of their dimensions.

    Gray-code form: from the highest bit down, a set bit mirrors the lower bits of the first
    axis, a clear one swaps them with the axis' own; what remains is undone by a running XOR.
    """
    x = points.astype(np.int64).T.copy()
    for q in (1 << np.arange(bits - 1, 0, -1)).tolist():
        for axis in x:
            inside = (axis & q) != 0
            swap = np.where(inside, 0, (x[0] ^ axis) & (q - 1))
            x[0] = np.where(inside, x[0] ^ (q - 1), x[0]) ^ swap
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << np.arange(bits - 1, 0, -1)).tolist():
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> b) & 1)
    return key


def document_point(ids: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The projected hashed vector of a document, as integers of KEY_BITS bits."""
    counts = np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    vector = np.sqrt(counts)
    vector /= max(1e-9, float(np.sqrt((vector * vector).sum())))
    scaled = (vector @ projection + 4.0) / 8.0 * (1 << KEY_BITS)
    return np.clip(scaled, 0, (1 << KEY_BITS) - 1).astype(np.int64)


def _encode(tokenizer: str, end_id: int, added_tokens: bool, keep_tables: bool):
    def encode(batches):
        import pyarrow as pa

        get = encoder(tokenizer, "<u2", added_tokens).encode
        projection = np.random.default_rng(20).standard_normal((BUCKETS, DIMENSIONS))
        end = np.array([end_id], "<u2").tobytes()
        for batch in slices(batches):
            ids = [get(t.as_py() or "") + end for t in batch.column("text")]
            points = np.array([document_point(np.frombuffer(x, "<u2"), projection) for x in ids]).reshape(-1, DIMENSIONS)
            columns = [batch.column("doc_id"), pa.array(hilbert_key(points, KEY_BITS), pa.int64()), pa.array(ids, pa.binary()), batch.column("source")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "ids", "source"])
        if not keep_tables:
            release()

    return encode


def _powers(rest: int) -> list[int]:
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def lay_out(documents, length: int = SEQUENCE):
    """Pieces (doc, start, ids, doc_tokens, sequence, offset) of (doc, ids) pairs laid end to end.

    Sequences are `length` long; the last stretch shorter than that is cut at powers of two.
    """
    held: list[tuple] = []
    size = sequence = 0
    for doc, ids in documents:
        at = 0
        while at < len(ids):
            take = min(length - size, len(ids) - at)
            held.append((doc, at, ids[at : at + take], len(ids)))
            at, size = at + take, size + take
            if size == length:
                offset = 0
                for d, s, x, n in held:
                    yield d, s, x, n, sequence, offset
                    offset += len(x)
                held, size, sequence = [], 0, sequence + 1
    for room in _powers(size):
        offset = 0
        while offset < room:
            d, s, x, n = held.pop(0)
            if len(x) > room - offset:
                held.insert(0, (d, s + room - offset, x[room - offset :], n))
                x = x[: room - offset]
            yield d, s, x, n, sequence, offset
            offset += len(x)
        sequence += 1


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(with_ids: bool, rows: int = 20_000):
    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        names = [*(x.split()[0] for x in _PIECES.split(", ")), *(["ids"] if with_ids else [])]

        def documents():
            for batch in batches:
                for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                    yield doc, np.frombuffer(ids.as_py(), "<u2")

        def flush(out):
            columns = [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out))]
            return pa.RecordBatch.from_arrays(columns, names)

        out = []
        for doc, start, ids, n, sequence, offset in lay_out(documents()):
            data = ids.astype("<u4").tobytes()
            out.append((doc, start, len(ids), zlib.crc32(data), n, base + sequence, offset, *([data] if with_ids else [])))
            if len(out) == rows:
                yield flush(out)
                out = []
        if out:
            yield flush(out)

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    partitions: int | None = None,
    source_col: str | None = None,
    added_tokens: bool = False,
    keep_tables: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids).

    A document is its ids and then end_id; null and empty texts are end_id alone. Every id lies
    in exactly one piece, offsets in a sequence have no gaps, and every sequence is 4096 ids or
    a power of two long. Repeated rows are packed as often as they occur; a null id is carried
    along; an empty table gives no pieces. With source_col, sequence_id follows the mixture. Without
    keep_tables a worker gives up the tokenizer's tables after each task.
    """
    spark = docs.sparkSession
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), source.alias("source"))
    encoded = materialize(rows.mapInArrow(_encode(tokenizer, end_id, added_tokens, keep_tables), "doc_id long, key long, ids binary, source string"), "ids", "zstd")
    n, order = partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), ["key", "doc_id"]
    if source_col:
        mixed = mixing.mix(encoded, extra=["key", "ids"])
        encoded, order = mixed.select("doc_id", "__row.*", F.floor(F.col("slot") / RANGE_SLOTS).alias("range")), ["range", *order]
    curve = encoded.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "key", "ids")
    return curve.mapInArrow(_pack(with_ids), _PIECES + (", ids binary" if with_ids else ""))
