"""Operator 11, WARC: revisit resolution and archives without repeated payloads.

The headers of all records (id, address, SHA-1 and length of the payload, no payload) are grouped by payload
digest. Of the records that share a payload of at least MIN_BYTES the one with the largest id is the original;
the others, and revisit records that came in without a payload, are joined to it and become revisits. A group
is summed up in as many parts as there are shuffle partitions before its parts meet, and the original goes
back the same way, so a payload that a third of all records have is no hot key. Payloads themselves move only
where the revisits are too many to be broadcast: revisit records are written from the headers alone.

An archive is a folder of gzip files of WARC/1.1 records, written by Spark's text writer with the end of a
record as its line separator, so Spark's commit protocol and every store that Spark writes to apply. All
headers are fresh: record ids are made from the record's own data, so a task that runs again writes the same
file. The reader streams lines and cuts records by their stated length; it holds one record.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_dir

MIN_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAME = ["__sha1", "__len", "__check"]
_READ = (
    "record_id string, record_type string, source_id string, url string, date string, refers_to string, refers_to_source string, "
    "payload_bytes long, stated_digest string, payload_digest string, payload binary"
)


def record_headers(records: DataFrame, id_col: str, url_col: str, payload_col: str, date_col: str | None = None, archived: bool = False) -> DataFrame:
    """A row per record, without its payload, written to the shared folder; __row tells repeated rows apart.

    archived: these are rows of read_archives, of which revisits have stated_digest and payload_bytes but no payload.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    told = archived
    full = F.col("record_type").eqNullSafe("response") if told else F.lit(True)
    rows = records.select(
        F.col(id_col).cast("long").alias("__id"),
        F.col(url_col).cast("string").alias("__url"),
        (F.col(date_col).cast("string") if date_col else F.lit(DATE)).alias("__date"),
        full.alias("__full"),
        (F.when(full, F.unhex(F.sha1(payload))).otherwise(F.unhex("stated_digest")) if told else F.unhex(F.sha1(payload))).alias("__sha1"),
        (F.when(full, F.octet_length(payload)).otherwise(F.col("payload_bytes")) if told else F.octet_length(payload)).cast("long").alias("__len"),
        (F.when(full, F.xxhash64(payload)) if told else F.xxhash64(payload)).alias("__check"),
        F.monotonically_increasing_id().alias("__row"),
    )
    return materialize(rows, "warc-headers")


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The revisits among headers: their columns and __to, __to_url, __to_date of the original.

    Originals are full records; ties of the largest id go to the largest address, then to any one row. A null id
    gives way to any other. A record that came in as a revisit and has no original has a null __to.
    """
    parts = int(headers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = headers.withColumn("__part", F.pmod("__row", F.lit(parts)))
    large = dealt.filter(F.col("__full") & (F.col("__len") >= min_bytes))
    best = F.max(F.struct("__id", "__url", "__date", "__row")).alias("__best")
    local = large.groupBy(*_SAME, "__part").agg(best, F.count(F.lit(1)).alias("__n"))
    total = local.groupBy(*_SAME).agg(F.max("__best").alias("__top"), F.sum("__n").alias("__size"))
    shared = materialize(total.filter("__size > 1"), "warc-groups")
    back = local.select(*_SAME, "__part").join(shared, _SAME)
    found = large.join(back, [*_SAME, "__part"]).filter(F.col("__row") != F.col("__top.__row"))
    to = [F.col("__top.__id").alias("__to"), F.col("__top.__url").alias("__to_url"), F.col("__top.__date").alias("__to_date")]
    fresh = found.select(*headers.columns, *to, F.lit(True).alias("__found"))
    came = dealt.filter("NOT __full")
    if not came.limit(1).count():
        return fresh
    # Old revisits know digest and length only; few digests have more than one original, and those differ in __check.
    firsts = large.groupBy("__sha1", "__len", "__part").agg(best).groupBy("__sha1", "__len").agg(F.max("__best").alias("__top"))
    asked = came.select("__sha1", "__len", "__part").distinct().join(firsts, ["__sha1", "__len"])
    old = came.join(asked, ["__sha1", "__len", "__part"], "left")
    return fresh.unionByName(old.select(*headers.columns, *to, F.col("__top").isNotNull().alias("__found")))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-3"), cut[2], F.lit("-a"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, nothing where the value is null; line ends inside a value are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _http(length: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit(END))


def _original_id(id_: Column, digest: Column) -> Column:
    return _uuid(F.lit("response"), id_, F.hex(digest))


def _response(payload: Column) -> Column:
    http = _http(F.col("__len"))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: response\r\n"), _field("WARC-Record-ID", F.col("__record")), _field("WARC-Date", F.col("__date")),
        _field("WARC-Target-URI", F.col("__url")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.lower(F.hex("__sha1")))), _field("X-Source-ID", F.col("__id")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), _field("Content-Length", F.octet_length(http) + F.col("__len")), F.lit("\r\n"), http,
    )
    return F.concat(head.cast("binary"), payload).cast("string")


def _revisit() -> Column:
    http = _http(F.col("__len"))
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: revisit\r\n"), _field("WARC-Record-ID", _uuid(F.lit("revisit"), F.col("__id"), F.hex("__sha1"), F.col("__row"))), _field("WARC-Date", F.col("__date")),
        _field("WARC-Target-URI", F.col("__url")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.lower(F.hex("__sha1")))), _field("X-Source-ID", F.col("__id")),
        F.lit(f"WARC-Profile: {SAME_PAYLOAD}\r\n"), _field("WARC-Refers-To", F.when(F.col("__found"), _original_id(F.col("__to"), F.col("__sha1")))),
        _field("WARC-Refers-To-Target-URI", F.col("__to_url")), _field("WARC-Refers-To-Date", F.col("__to_date")), _field("X-Refers-To-Source-ID", F.col("__to")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), _field("Content-Length", F.octet_length(http)), F.lit("\r\n"), http,
    )


def write_archives(
    records: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, min_bytes: int = MIN_BYTES,
    archived: bool = False,
) -> None:
    """Write records as WARC archives under path; payloads that stand there already become revisits.

    records: an id (whole number), an address, a payload (text or binary; null: empty) and optionally a date. With
    archived=True they are rows of read_archives (id source_id, payload payload): their revisits are resolved again
    and their headers made anew. Repeated rows and ties of an id are records of their own, one of which is the
    original. Null ids and addresses leave their header out. An empty table writes an empty archive. Other columns
    are not read.
    """
    headers = record_headers(records, id_col, url_col, payload_col, date_col, archived)
    revisits = materialize(resolve(headers, min_bytes), "warc-revisits")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    kept = records.filter(F.col("record_type").eqNullSafe("response")) if archived else records
    full = kept.select(
        F.col(id_col).cast("long").alias("__id"), F.col(url_col).cast("string").alias("__url"), (F.col(date_col).cast("string") if date_col else F.lit(DATE)).alias("__date"),
        F.unhex(F.sha1(payload)).alias("__sha1"), F.octet_length(payload).cast("long").alias("__len"), F.xxhash64(payload).alias("__check"), payload.alias("__payload"),
    )
    going = revisits.filter("__full").select(F.col("__id").alias("__i"), F.col("__sha1").alias("__s"), F.col("__len").alias("__l"), F.col("__check").alias("__c")).distinct()
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__sha1") == F.col("__s")) & (F.col("__len") == F.col("__l")) & (F.col("__check") == F.col("__c"))
    left = full.join(going, same, "left_anti")
    # An original with the id of one of its own revisits (repeated rows): its row is made again, once.
    twice = revisits.filter(F.col("__full") & F.col("__id").eqNullSafe(F.col("__to"))).select(F.col("__id").alias("__i"), F.col("__sha1").alias("__s"), F.col("__len").alias("__l"), F.col("__check").alias("__c")).distinct()
    if twice.limit(1).count():
        again = full.join(twice, same, "left_semi").groupBy("__id", *_SAME)
        one = again.agg(F.max(F.struct("__url", "__date")).alias("__at"), F.first("__payload").alias("__payload"))
        left = left.unionByName(one.select("__id", "__at.__url", "__at.__date", *_SAME, "__payload"))
    named = left.withColumn("__record", F.when(F.col("__len") >= min_bytes, _original_id(F.col("__id"), F.col("__sha1"))).otherwise(_uuid(F.lit("small"), F.col("__id"), F.col("__url"), F.hex("__sha1"), F.monotonically_increasing_id())))
    lines = named.select(_response(F.col("__payload")).alias("value")).unionByName(revisits.select(_revisit().alias("value")))
    lines.write.option("lineSep", END).option("compression", "gzip").text(path)


def _parse(payloads: bool):
    import hashlib
    import io
    import re

    head = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
    names = [x.split()[0] for x in _READ.split(", ")]

    def fields(block: bytes) -> dict:
        return {k.strip().lower(): v.strip() for k, v in head.findall(block)}

    def record(top: bytes, block: bytes) -> tuple:
        f = fields(top)
        get = lambda k: f[k].decode("utf-8", "replace") if k in f else None
        kind = get(b"warc-type")
        digest = get(b"warc-payload-digest")
        stated = digest.removeprefix("sha1:") if digest else None
        http, _, payload = block.partition(b"\r\n\r\n")
        length, real = len(payload), hashlib.sha1(payload).hexdigest()
        if kind == "revisit":
            length, real, payload = int(fields(http).get(b"content-length", 0)), stated, None
        return (
            get(b"warc-record-id"), kind, get(b"x-source-id"), get(b"warc-target-uri"), get(b"warc-date"), get(b"warc-refers-to"), get(b"x-refers-to-source-id"),
            length, stated, real, payload if payloads else None,
        )

    def parse(batches):
        import pyarrow as pa

        kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
        of, top, block, need = None, None, None, 0  # file; header so far; block so far; bytes still to come
        out, size = [], 0

        def ended():
            if top or need > 0:
                raise ValueError("an archive ends inside a record")

        for batch in batches:
            files = batch.column("file").to_pylist()
            for file, line in zip(files, batch.column("value").to_pylist()):
                if file != of:
                    ended()
                    of, top, block, need = file, None, None, 0
                line += b"\n"
                while line:
                    if need > 0:
                        part = line[:need]
                        block.write(part)
                        need -= len(part)
                        line = line[len(part) :]
                        if need == 0:
                            out.append(record(bytes(top), block.getvalue()))
                            size += block.tell()
                            top = block = None
                            if len(out) >= 5000 or size > 16 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                                out, size = [], 0
                        continue
                    if top is None:
                        if line.strip():  # else the blank lines between two records
                            if not line.startswith(b"WARC/"):
                                raise ValueError("no record begins here")
                            top = bytearray(line)
                    else:
                        top += line
                        if line == b"\r\n":
                            need, block = int(fields(bytes(top))[b"content-length"]), io.BytesIO()
                            if need == 0:
                                out.append(record(bytes(top), b""))
                                top = block = None
                    line = b""
        ended()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return parse


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of gzip WARC files under path, one row each.

    payload_bytes and payload_digest are those of the bytes read; of a revisit those that its headers state.
    stated_digest is the header's, so a record whose payload was damaged shows two digests. payloads=False leaves payload null.
    A file that breaks off inside a record fails the read.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(_parse(payloads), _READ)


def restored(records: DataFrame) -> DataFrame:
    """records of read_archives with the payload of its original on every revisit that has one there."""
    whole = records.filter("record_type = 'response'")
    originals = whole.select(F.col("record_id").alias("__of"), F.col("payload").alias("__payload"))
    back = records.filter("record_type = 'revisit'").join(originals, F.col("refers_to") == F.col("__of"), "left")
    return whole.unionByName(back.withColumn("payload", F.col("__payload")).select(*records.columns))


def archive_digest(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages as archives in the shared folder, read them back, and return a row per page.

    page_id, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to (page_id of the original, of revisits only).
    """
    path = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes=min_bytes)
    rows = read_archives(pages.sparkSession, path, payloads=False)
    return rows.select(F.col("source_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_source").cast("long").alias("refers_to"))
