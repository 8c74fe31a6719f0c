"""Structured Streaming: ingest of new files, transfer rates, commit replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import unix_millis
from ..operators.chunks import chunk_lines, new_objects
from ..operators.normalize import accepted_lines, normalize_lines
from ..operators.validate import classify_headers
from ..sources.rollouts import split_lines
from ..sources.scratch import rewritten


def transfer_rate(events: DataFrame, seconds: float, remaining: str) -> DataFrame:
    """Bytes per second over the trailing window of each job, and the seconds left, rounded up.

    events: job, ts, bytes and a column of bytes remaining. Less than 0.1 s of window has no rate. Times count in whole
    milliseconds, rounded.
    """
    ms = unix_millis(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("job").orderBy(ms).rangeBetween(-int(seconds * 1000), 0)
    span = (ms - F.min(ms).over(w)) / 1000
    rate = F.when(span >= 0.1, (F.sum("bytes").over(w)) / span)
    rows = events.withColumn("rate", rate)
    return rows.withColumn("eta_seconds", F.when(F.col("rate") > 0, F.ceil(F.col(remaining) / F.col("rate"))))


def transfer_rate_stream(events: DataFrame, seconds: int = 5, late: str = "10 seconds") -> DataFrame:
    """The same on a stream: bytes per job in windows that slide by a second, late events up to the watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy("job", F.window("ts", f"{seconds} seconds", "1 second"))
        .agg((F.sum("bytes") / F.lit(float(seconds))).alias("rate"))
        .select("job", F.col("window.end").alias("at"), "rate")
    )


_RATES = "job {job}, event {event}, ts timestamp, rate double, eta_seconds long"
#: Rows in one value of a job's state, and in one batch of answers, at most.
PART = 10_000


def _rates(window_ms: int):
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Rates(StatefulProcessor):
        """The rows of a job that a later window can still reach; a row goes out once the watermark has passed its millisecond, which others may still come to.

        Rows are appended and read many in a value (ms, bytes, whether bytes are given and remaining as numbers of eight bytes each).
        A batch of rows sets one timer, for its first millisecond; a timer answers all that is due and sets the next.
        """

        def init(self, handle):
            self.handle = handle
            self.parts = handle.getListState("parts", f"numbers binary, events array<{self.event}>, sent boolean")

        def keep(self, numbers, events, sent):
            for i in range(0, len(events), PART):
                self.parts.appendValue((numbers[:, i : i + PART].tobytes(), events[i : i + PART], sent))

        def handleInputRows(self, key, rows, timerValues):
            first = []
            for pdf in rows:
                ms, remaining = pdf["ms"].to_numpy("int64"), pdf["remaining"].to_numpy("float64")
                self.keep(np.stack([ms, pdf["bytes"].to_numpy("int64"), pdf["given"].to_numpy("int64"), remaining.view("int64")]), pdf["event"].tolist(), False)
                first.append(int(ms.min()))
            self.handle.registerTimer(min(first) + 1)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = timerValues.getCurrentWatermarkInMs()
            parts = list(self.parts.get()) if self.parts.exists() else []
            if not parts:
                return
            numbers = np.concatenate([np.frombuffer(p[0], "int64").reshape(4, -1) for p in parts], axis=1)
            order = np.argsort(numbers[0], kind="stable")
            numbers, events = numbers[:, order], pd.Series([e for p in parts for e in p[1]]).iloc[order]
            sent = np.repeat([p[2] for p in parts], [len(p[1]) for p in parts])[order]
            ms = numbers[0]
            old, now = np.searchsorted(ms, passed - window_ms), np.searchsorted(ms, passed)
            if now < len(ms):
                self.handle.registerTimer(int(ms[now]) + 1)
            due = np.flatnonzero(~sent[:now])
            if not len(due):
                return
            self.parts.clear()
            self.keep(numbers[:, old:now], events.iloc[old:now].tolist(), True)
            self.keep(numbers[:, now:], events.iloc[now:].tolist(), False)
            for i in range(0, len(due), PART):
                yield self.answers(key[0], numbers, events, due[i : i + PART])

        def answers(self, job, numbers, events, due):
            ms, size, given, remaining = numbers
            first, last = np.searchsorted(ms, ms[due] - window_ms), np.searchsorted(ms, ms[due], "right")
            low, high = first[0], last[-1]
            size = size[low:high] if np.abs(size[low:high].astype("float64")).sum() < 2.0**62 else size[low:high].astype("object")
            total, some = ((c := np.append(0, np.cumsum(x)))[last - low] - c[first - low] for x in (size, given[low:high]))
            span = (ms[due] - ms[first]) / 1000
            known = (span >= 0.1) & (some > 0)
            rate = np.where(known, total.astype("float64"), np.nan) / np.where(known, span, 1)
            left = remaining.view("float64")[due]
            known = (rate > 0) & ~np.isnan(left)
            left = np.clip(np.ceil(np.where(known, left, 0) / np.where(known, rate, 1)), -(2.0**63), 2.0**63 - 1024).astype("int64")
            return pd.DataFrame({"job": job, "event": events.iloc[due].array, "ts": pd.to_datetime(ms[due], unit="ms", utc=True), "rate": rate, "eta_seconds": pd.arrays.IntegerArray(left, ~known)})

        def close(self):
            pass

    return Rates


def sliding_rate_stream(events: DataFrame, seconds: float, late: str = "10 seconds") -> DataFrame:
    """transfer_rate on a stream, the same numbers for every event: job, event, ts, rate, eta_seconds.

    events: job, event (an id), ts (timestamp), bytes, remaining. An event is answered once the watermark has passed it, so
    events that come later by up to `late` still count in the windows they belong to; those behind the watermark are
    dropped. State holds the events of the last window of each job. The session needs the RocksDB state store.
    """
    kind = lambda c: events.schema[c].dataType.simpleString()
    rows = events.withWatermark("ts", late).select("job", "event", "ts", unix_millis(F.col("ts")).alias("ms"), F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"), F.col("bytes").isNotNull().alias("given"), F.col("remaining").cast("long"))
    processor = _rates(int(seconds * 1000))
    processor.event = kind("event")
    return rows.groupBy("job").transformWithStateInPandas(statefulProcessor=processor(), outputStructType=_RATES.format(job=kind("job"), event=kind("event")), outputMode="Append", timeMode="EventTime")


_OBJECTS = "sha256 string, byte_length long, bytes binary, kind string, bucket string"
#: Leading hex digits of a digest that name a bucket of the store.
BUCKET_DIGITS = 2


def bucket_of(sha256):
    """The bucket of a content id (sha256:<hex>)."""
    return F.substring(sha256, 8, BUCKET_DIGITS)


def ingested(files: DataFrame, chunk_size: int, kept=lambda df, label: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What becomes of files (path, content): their header's verdict (path, kind, thread_id), the normalised lines of those that are sound,
    and the chunks of what is accepted. kept cuts lineage between the steps where they run again and again.
    """
    head = F.substring_index(F.decode("content", "ISO-8859-1"), "\n", 1)
    headers = files.select("path", F.col("path").contains("archived_sessions/").alias("archived"), F.octet_length("content").cast("long").alias("byte_length"), F.encode(F.rtrim(head, F.lit("\r")), "ISO-8859-1").alias("header"))
    found = kept(classify_headers(headers).select("path", "kind", "thread_id"), "headers")
    sound = files.select("path", "content").join(found.filter("kind IS NULL").drop("kind"), "path")
    lines = kept(normalize_lines(split_lines(sound.select(F.col("path").alias("file"), "thread_id", "content"))), "lines")
    pieces = kept(chunk_lines(accepted_lines(lines), ["file", "thread_id"], chunk_size), "pieces")
    return found, lines, pieces


def stored_objects(spark: SparkSession, store: str, kind: str, wanted: DataFrame) -> DataFrame:
    """The stored objects of the kind in the buckets that wanted (sha256) falls in; other buckets are not read."""
    buckets = [r[0] for r in wanted.select(bucket_of("sha256")).distinct().limit(16**BUCKET_DIGITS).collect()]
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/objects/kind={kind}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in fs.listStatus(at)} if fs.exists(at) else set()
    paths = [f"{store}/objects/kind={kind}/bucket={b}" for b in sorted(buckets) if f"bucket={b}" in there]
    if not paths:
        return spark.createDataFrame([], _OBJECTS)
    return spark.read.schema(_OBJECTS).option("basePath", f"{store}/objects").parquet(*paths)


def stream_ingest(spark: SparkSession, source: str, store: str, checkpoint: str, chunk_size: int = 4 << 20, glob: str = "rollout-*.jsonl"):
    """Pick up new files, classify and normalise them, chunk what is sound and append what is not stored yet; returns the started query.

    Under store: objects (chunks by kind and bucket of their digest), manifests (path, thread_id, pos, sha256, byte_length) and
    warnings (path, kind). A batch looks for its chunks only in the buckets they fall in. A store that does not exist yet is begun. A batch that is run again
    after a failure finds its chunks stored and its own folder of manifests and warnings written over.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(source)
    spark.createDataFrame([], _OBJECTS).write.partitionBy("kind", "bucket").mode("append").parquet(f"{store}/objects")

    def append(batch: DataFrame, number: int) -> None:
        found, lines, pieces = ingested(batch.select("path", "content"), chunk_size, rewritten)
        objects = pieces.select(F.lit("chunk").alias("kind"), "sha256", "byte_length", "bytes")
        new = new_objects(stored_objects(spark, store, "chunk", pieces), objects).withColumn("bucket", bucket_of("sha256"))
        new.repartition("bucket").write.partitionBy("kind", "bucket").mode("append").parquet(f"{store}/objects")
        pieces.select(F.col("file").alias("path"), "thread_id", "pos", "sha256", "byte_length").write.mode("overwrite").parquet(f"{store}/manifests/batch={number}")
        noted = found.filter("kind IS NOT NULL").select("path", "kind").unionByName(lines.filter("warning IS NOT NULL").select(F.col("file").alias("path"), F.col("warning").alias("kind")))
        noted.write.mode("overwrite").parquet(f"{store}/warnings/batch={number}")

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Known ids of a namespace that are kept in one value; of more, each stands for itself.
FEW = 1 << 15


def _processor():
    from array import array

    from pyspark.sql.streaming import StatefulProcessor

    class Commits(StatefulProcessor):
        """Head, epoch and known ids of a namespace; the rules of history.replay_commits.

        Up to FEW known ids are read and written as one value per batch, not one by one; what goes beyond moves to a map.
        """

        def init(self, handle):
            self.state = handle.getValueState("head", "head long, epoch long, moved boolean, ids binary, parents binary, first binary")
            self.known = handle.getMapState("known", "id long", "parent long")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            head, epoch, moved, few = None, 0, False, {}
            if self.state.exists():
                head, epoch, moved, ids, parents, first = self.state.get()
                few = {i: None if f else p for i, p, f in zip(array("q", bytes(ids)), array("q", bytes(parents)), bytes(first))}
            none = lambda x: None if x is None or x != x else int(x)
            parts = list(rows)  # Spark does not keep the order of rows in a batch
            batch = (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values("seq")
            for i in range(0, len(batch), PART):
                out = []
                for r in batch[i : i + PART].itertuples(index=False):
                    request, parent, expected = int(r.request_id), none(r.parent), none(r.expected_head)
                    if r.action == "bump":
                        epoch, result = epoch + 1, "bumped"
                    elif r.expected_epoch != epoch:
                        result = "wrong_epoch"
                    elif request == head and (few[head] if head in few else self.known.getValue((head,))[0]) == parent:
                        result = "already_committed"
                    elif request in few or moved and self.known.containsKey((request,)):
                        result = "conflict"
                    elif head != expected:
                        result = "head_mismatch"
                    elif parent != expected:
                        result = "conflict"
                    else:
                        head, result = request, "created"
                        few[request] = parent
                        if len(few) > FEW:
                            for item in few.items():
                                self.known.updateValue(item[:1], item[1:])
                            moved, few = True, {}
                    out.append((key[0], int(r.seq), request, result, epoch))
                yield pd.DataFrame(out, columns=["namespace_id", "seq", "request_id", "outcome", "epoch"])
            self.state.update((head, epoch, moved, array("q", few).tobytes(), array("q", (p or 0 for p in few.values())).tobytes(), bytes(p is None for p in few.values())))

        def close(self):
            pass

    return Commits()


def stream_commits(log: DataFrame) -> DataFrame:
    """replay_commits on a stream, keyed by namespace. Batches must arrive in order of seq per namespace; in a batch any order will do, and a task holds
    the batch's rows of one namespace.

    The session needs the RocksDB state store.
    """
    return log.groupBy("namespace_id").transformWithStateInPandas(
        statefulProcessor=_processor(), outputStructType="namespace_id long, seq long, request_id long, outcome string, epoch long", outputMode="Append", timeMode="None"
    )
