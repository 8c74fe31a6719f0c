"""Contents of any size: digests, checks and writing while their pieces stream by, so that no row holds a content.

A content is a run of rows (chunks or lines) in an order. Its rows come to one task, sorted, in Arrow batches; the
hash of what has passed is carried from batch to batch. A SHA-256 has to be taken in order, so a content
is one task's work, but different contents are different tasks'.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import content_id

#: Bytes of a row that a task gets at once; a longer piece is cut into several, so that a batch of rows stays small.
ROW_BYTES = 1 << 14
#: Bytes of a part that write_parts makes.
PART_BYTES = 32 << 20


def _sorted(rows: DataFrame, keys: list[str], order: str, data: Column, row_bytes: int, stated: Column | None) -> DataFrame:
    """keys.., __pos, __cut, __data (at most row_bytes of it), __stated on the first cut of a piece, by content and in order."""
    whole = rows.select(*keys, F.col(order).cast("long").alias("__pos"), F.coalesce(data, F.lit(b"")).alias("__whole"), (stated if stated is not None else F.lit(None).cast("string")).alias("__stated"))
    last = F.greatest(F.ceil(F.octet_length("__whole") / F.lit(row_bytes)).cast("int") - 1, F.lit(0))
    cut = whole.withColumn("__cut", F.explode(F.sequence(F.lit(0), last)))
    piece = F.when(last == 0, F.col("__whole")).otherwise(F.substring("__whole", F.col("__cut") * row_bytes + 1, F.lit(row_bytes)))
    placed = cut.select(*keys, "__pos", "__cut", piece.alias("__data"), F.when(F.col("__cut") == 0, F.col("__stated")).alias("__stated"))
    return placed.repartition(*keys).sortWithinPartitions(*keys, "__pos", "__cut")


def _schema(rows: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), more])


def _runs(batches, keys: list[str], kinds: list) -> Iterator[tuple]:
    """(key, or None if it is that of the row before; pos; cut; data; stated) of each row; kinds gets the Arrow types of the keys."""
    of = ()
    for batch in batches:
        kinds[:] = [batch.schema.field(k).type for k in keys]
        named = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        for key, *row in zip(named, *(batch.column(c).to_pylist() for c in ("__pos", "__cut", "__data", "__stated"))):
            yield (None if key == of else key), *row
            of = key


class _Content:
    """What is known of the content that streams by."""

    def __init__(self, key):
        import hashlib

        self.key, self.sha, self.length, self.pieces, self.intact, self.gapless = key, hashlib.sha256(), 0, 0, True, True
        self.piece = self.stated = None

    def add(self, pos, cut, data, stated):
        import hashlib

        if cut == 0:
            self.end_piece()
            self.gapless &= pos == self.pieces
            self.pieces += 1
            self.stated, self.piece = stated, hashlib.sha256() if stated is not None else None
        self.sha.update(data)
        self.length += len(data)
        if self.piece is not None:
            self.piece.update(data)

    def end_piece(self):
        if self.piece is not None:
            self.intact &= self.stated == f"sha256:{self.piece.hexdigest()}"
            self.piece = None

    def result(self) -> tuple:
        self.end_piece()
        return (*self.key, f"sha256:{self.sha.hexdigest()}", self.length, self.pieces, self.intact, self.gapless)


def stream_digests(rows: DataFrame, keys: list[str], order: str, data: Column, stated: Column | None = None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Per content (keys..): content_id and byte_length of its pieces in order, their number, whether all have their stated id (intact), and
    whether they are numbered 0, 1, 2, .. (gapless).

    A piece without a stated id counts as intact; null data count as none; two pieces with one number are not gapless.
    Contents without rows are not here. Nothing is held but the hash, so contents may have any size.
    """
    schema = _schema(rows, keys, "content_id string, byte_length long, pieces long, intact boolean, gapless boolean")

    def digest(batches):
        import pyarrow as pa

        held, out, kinds = None, [], []
        names = [*keys, "content_id", "byte_length", "pieces", "intact", "gapless"]

        def batch_of(found):
            types = [*kinds, pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), types)], names)

        for key, *piece in _runs(batches, keys, kinds):
            if key is not None:
                if held:
                    out.append(held.result())
                    if len(out) == 10_000:
                        yield batch_of(out)
                        out = []
                held = _Content(key)
            held.add(*piece)
        if held:
            yield batch_of([*out, held.result()])

    return _sorted(rows, keys, order, data, row_bytes, stated).mapInArrow(digest, schema)


def stream_parts(rows: DataFrame, keys: list[str], order: str, data: Column, stated: Column | None = None, part_bytes: int = PART_BYTES, row_bytes: int = ROW_BYTES) -> DataFrame:
    """The contents again as parts of part_bytes: keys.., part, bytes, and after its last part a row with a null part and the content's
    content_id, byte_length and sound (all pieces intact and gapless).

    The check of a content is known only when it has passed, so who writes the parts looks at the row that closes them.
    """
    schema = _schema(rows, keys, "part long, bytes binary, content_id string, byte_length long, sound boolean")

    def write(batches):
        import pyarrow as pa

        held, buffer, part, kinds = None, bytearray(), 0, []
        names = [*keys, "part", "bytes", "content_id", "byte_length", "sound"]

        def row(*values):
            types = [*kinds, pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, types)], names)

        def closed():
            if buffer:
                yield row(*held.key, part, bytes(buffer), None, None, None)
            *key, id_, length, _, intact, gapless = held.result()
            yield row(*key, None, None, id_, length, intact and gapless)

        for key, *piece in _runs(batches, keys, kinds):
            if key is not None:
                if held:
                    yield from closed()
                held, part = _Content(key), 0
                buffer.clear()
            held.add(*piece)
            buffer += piece[2]
            while len(buffer) >= part_bytes:
                yield row(*held.key, part, bytes(buffer[:part_bytes]), None, None, None)
                del buffer[:part_bytes]
                part += 1
        if held:
            yield from closed()

    return _sorted(rows, keys, order, data, row_bytes, stated).mapInArrow(write, schema)


def publish_contents(rows: DataFrame, keys: list[str], order: str, data: Column, stated: Column | None, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write contents as parts under path/parts and return the verdict on each: keys.., content_id, byte_length, sound.

    Readers take the parts of sound contents only (read_contents).
    """
    spark = rows.sparkSession
    stream_parts(rows, keys, order, data, stated, part_bytes).write.mode("error").parquet(f"{path}/parts")
    return spark.read.parquet(f"{path}/parts").filter("part IS NULL").select(*keys, "content_id", "byte_length", "sound")


def read_contents(spark, path: str, keys: list[str]) -> DataFrame:
    """keys.., part, bytes of the sound contents that publish_contents wrote; parts are in order of their number."""
    rows = spark.read.parquet(f"{path}/parts")
    sound = rows.filter("part IS NULL AND sound").select(*keys)
    return rows.filter("part IS NOT NULL").join(sound, keys, "left_semi").select(*keys, "part", "bytes")


def verify_contents(rows: DataFrame, declared: DataFrame, keys: list[str], order: str, data: Column, stated: Column) -> DataFrame:
    """keys.., rule of contents whose pieces are not what declared (keys.., logical_sha256, byte_length) says.

    no_chunks: none of a content that has bytes; chunk: a piece without its stated id, or a gap; content_hash; content_length. A
    content of no bytes has no pieces, and its id must be that of nothing.
    """
    found = stream_digests(rows, keys, order, data, stated)
    at = declared.join(found.select(*keys, F.col("content_id").alias("__id"), F.col("byte_length").alias("__n"), (F.col("intact") & F.col("gapless")).alias("__sound")), keys, "left")
    rule = (
        F.when(F.col("__id").isNull() & (F.col("byte_length") > 0), "no_chunks")
        .when(~F.coalesce("__sound", F.lit(True)), "chunk")
        .when(F.coalesce("__id", content_id(F.lit(b""))) != F.col("logical_sha256"), "content_hash")
        .when(F.coalesce("__n", F.lit(0)) != F.col("byte_length"), "content_length")
    )
    return at.select(*keys, rule.alias("rule")).filter("rule IS NOT NULL")
