"""Streams give what the batch forms give."""

from palimpsest.operators.history import replay_commits
from palimpsest.streaming import streams as T

from .test_operators import COMMITS, LOG


def test_ingest_appends_each_chunk_once(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    (source / "sessions").mkdir(parents=True)
    head = '{"type":"session_meta","payload":{"id":"%s","cwd":"/w","model_provider":"p"}}\n'
    for name, data in (("rollout-1", head % "a" + "x" * 90), ("rollout-2", head % "a" + "x" * 90 + "y"), ("rollout-3", "{}\n"), ("rollout-4", head % "b" + "not json\r\n")):
        (source / "sessions" / f"{name}.jsonl").write_bytes(data.encode())
        T.stream_ingest(spark, str(source), store, str(tmp_path / "cp"), 64).awaitTermination(120)
    objects = [bytes(r.bytes) for r in spark.read.parquet(f"{store}/objects").collect()]
    assert len(objects) == len(set(objects))
    by_id = {r.sha256: bytes(r.bytes) for r in spark.read.parquet(f"{store}/objects").collect()}
    files = {}
    for r in sorted(spark.read.parquet(f"{store}/manifests").collect(), key=lambda r: (r.path, r.pos)):
        name = r.path.rsplit("/", 1)[-1]
        files[name] = files.get(name, b"") + by_id[r.sha256]
    fixed = '{"payload":{"cwd":"__local_workspace__","id":"%s","model_provider":"__local_provider__"},"type":"session_meta"}\n'
    assert files == {"rollout-1.jsonl": (fixed % "a" + "x" * 90).encode(), "rollout-2.jsonl": (fixed % "a" + "x" * 90 + "y").encode(), "rollout-4.jsonl": (fixed % "b" + "not json\r\n").encode()}
    noted = sorted((r.path.rsplit("/", 1)[-1], r.kind) for r in spark.read.parquet(f"{store}/warnings").collect())
    assert noted == [("rollout-1.jsonl", "invalid_json"), ("rollout-2.jsonl", "invalid_json"), ("rollout-3.jsonl", "missing_session_meta"), ("rollout-4.jsonl", "invalid_json")]


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    store = str(tmp_path / "store")
    ids = [f"sha256:{i:02x}" + "0" * 62 for i in range(256)]
    rows = spark.createDataFrame([(s, 1, bytearray(b"x"), "chunk", s[7:9]) for s in ids], T._OBJECTS)
    rows.repartition("bucket").write.partitionBy("kind", "bucket").parquet(f"{store}/objects")
    wanted = spark.createDataFrame([(ids[3],), (ids[3],), (ids[200],)], "sha256 string")
    have = T.stored_objects(spark, store, "chunk", wanted)
    assert len(have.inputFiles()) == 2 and sorted(r.sha256 for r in have.collect()) == [ids[3], ids[200]]
    assert T.stored_objects(spark, store, "other", wanted).collect() == []


def test_commits(spark, tmp_path):
    log = spark.createDataFrame([c[:-1] for c in COMMITS], LOG)
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = T.stream_commits(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    stream.writeStream.format("memory").queryName("commits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    key = lambda r: r.seq
    assert sorted(spark.table("commits").collect(), key=key) == sorted(replay_commits(log).collect(), key=key)


def test_commits_ask_the_store_once_per_batch(spark, tmp_path):
    """Known ids of a namespace are no calls of their own until there are too many for one value; both forms give the batch result, over several batches."""

    class State(dict):
        calls = 0

        def exists(self):
            return bool(self)

        def get(self):
            State.calls += 1
            return self["value"]

        def update(self, value):
            State.calls += 1
            self["value"] = value

        def containsKey(self, key):
            State.calls += 1
            return key in self

        def getValue(self, key):
            State.calls += 1
            return self[key]

        def updateValue(self, key, value):
            State.calls += 1
            self[key] = value

    class Handle:
        getValueState = getMapState = lambda self, *names: State()

    rows = []
    for i in range(1, 400):
        rows.append((7, 2 * i, i, i - 1 or None, i - 1 or None, 0, "commit"))
        rows.append((7, 2 * i + 1, i if i % 3 else i // 2, i - 1 or None, i - 1 or None, 0, "commit"))
    log = spark.createDataFrame(rows, LOG)
    want = sorted(tuple(r) for r in replay_commits(log).collect())
    pdf = log.toPandas()
    for few, calls in ((T.FEW, 7), (100, 2000)):
        made, State.calls = T._processor(), 0
        made.handleInputRows.__func__.__globals__["FEW"], was = few, T.FEW
        try:
            made.init(Handle())
            got = [tuple(r) for part in (pdf[:300], pdf[300:310], pdf[310:350], pdf[350:]) for out in made.handleInputRows((7,), iter([part]), None) for r in out.itertuples(index=False)]
        finally:
            T.FEW = was
        assert sorted(got) == want and State.calls <= calls


def test_transfer_rate(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00', 100L, 900L), (1, TIMESTAMP '2024-01-01 00:00:02', 100L, 800L), (1, TIMESTAMP '2024-01-01 00:00:09', 100L, 700L) AS t(job, ts, bytes, rest)")
    assert [(r.rate, r.eta_seconds) for r in T.transfer_rate(df, 5, "rest").orderBy("ts").collect()] == [(None, None), (100.0, 8), (None, None)]


def test_transfer_rate_stream(spark, tmp_path):
    """Windows of two seconds that slide by one, against sums of the same windows."""
    import datetime

    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)
    rows = [("a", at(n / 2), 10 * n) for n in range(9)] + [("b", at(3), 7)]
    df = spark.createDataFrame(rows, "job string, ts timestamp, bytes long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", at(500), 0)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark on
    out = T.transfer_rate_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 2, "1 second")
    out.writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    want = {}
    for job, ts, n in rows:
        for end in range(-2, 12):
            if at(end - 2) <= ts < at(end):
                want[job, at(end)] = want.get((job, at(end)), 0) + n / 2
    assert {(r.job, r["at"]): r.rate for r in spark.table("rates").collect() if r.job != "z"} == want


def test_sliding_rate_stream_is_the_batch_rate(spark, tmp_path):
    """Events out of order within the lateness, several at one time, and pauses: every event has the rate that the batch form gives it."""
    import datetime
    import random

    rng = random.Random(2)
    at = lambda ms: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)
    rows, ms = [], 0
    for i in range(120):
        ms += rng.choice([0, 30, 400, 900, 2500])
        rows.append((rng.choice("ab"), i, at(ms), rng.randrange(1000), rng.choice([None, 5000 - i])))
    df = spark.createDataFrame(rows, "job string, event long, ts timestamp, bytes long, remaining long")
    want = {r.event: (r.rate, r.eta_seconds) for r in T.transfer_rate(df, 2, "remaining").collect()}
    order = sorted(rows, key=lambda r: r[2] + datetime.timedelta(milliseconds=rng.randrange(1500)))
    for part in (order[:40], order[40:80], order[80:], [("z", -1, at(10**7), 0, None)]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = T.sliding_rate_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 2, "2 seconds")
    out.writeStream.format("memory").queryName("sliding").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    got = {r.event: (r.rate, r.eta_seconds) for r in spark.table("sliding").collect() if r.job != "z"}
    assert got == want and len(got) == 120


def _micros(n):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=n)


def test_transfer_rate_rounds_to_milliseconds(spark):
    """As epoch_ms of the queries' SQL does: halves up."""
    rows = [(1, _micros(999_600), 100, 0), (1, _micros(1_200_499), 110, 0), (1, _micros(1_300_500), 120, 0)]
    df = spark.createDataFrame(rows, "job long, ts timestamp, bytes long, rest long")
    assert [r.rate for r in T.transfer_rate(df, 5, "rest").orderBy("ts").collect()] == [None, 210 / 0.2, 330 / 0.301]


def test_sliding_rate_stream_waits_for_the_whole_millisecond(spark, tmp_path):
    """A late event in the millisecond that the watermark stands in counts for its peer there, too."""
    rows = [("a", 1, _micros(9_000_600), 5, 0), ("a", 2, _micros(10_000_000), 7, 0), ("z", -1, _micros(12_000_000), 0, 0)]
    late = [("a", 3, _micros(10_000_300), 9, 0)]
    df = spark.createDataFrame(rows + late, "job string, event long, ts timestamp, bytes long, remaining long")
    want = {r.event: r.rate for r in T.transfer_rate(df.filter("event > 0"), 2, "remaining").collect()}
    for part in (rows, [("z", -2, _micros(12_000_000), 0, 0)], late, [("z", -3, _micros(10**9), 0, 0)]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = T.sliding_rate_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 2, "2 seconds")
    out.writeStream.format("memory").queryName("whole_ms").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    assert {r.event: r.rate for r in spark.table("whole_ms").collect() if r.job != "z"} == want
    assert want[2] == want[3] == 21 / 0.999


def test_rates_ask_the_store_a_few_times_per_batch(spark):
    """However many rows a job has: not a timer for each, and the rows of a batch are one value; the numbers are those of the batch form, also where bytes are missing."""
    import datetime
    import random
    from types import SimpleNamespace

    import pandas as pd

    class State(list):
        calls = 0
        appendValue = list.append
        appendList = list.extend

        def __getattribute__(self, name):
            State.calls += name in ("exists", "get", "appendValue", "appendList", "put", "clear")
            return list.__getattribute__(self, name)

        def exists(self):
            return bool(self)

        def get(self):
            return iter(list(self))

        def put(self, values):
            self[:] = values

    class Handle:
        def __init__(self):
            self.timers, self.calls = set(), 0

        def getListState(self, *names):
            return State()

        def registerTimer(self, at):
            self.calls += 1
            self.timers.add(at)

    rng = random.Random(4)
    rows, ms = [], 0
    for i in range(600):
        ms += rng.choice([0, 30, 400, 900, 2500])
        rows.append((7, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms), None if 100 < i < 130 or i % 7 == 0 else rng.randrange(1000), rng.choice([None, 5000 - i])))
    df = spark.createDataFrame(rows, "job long, event long, ts timestamp, bytes long, remaining long")
    want = {r.event: (r.rate, r.eta_seconds) for r in T.transfer_rate(df, 2, "remaining").collect()}
    start = 1704067200000
    at = [start + round((r[2] - rows[0][2]).total_seconds() * 1000) + round((rows[0][2] - datetime.datetime(2024, 1, 1)).total_seconds() * 1000) for r in rows]
    pdf = pd.DataFrame({"ms": at, "bytes": [r[3] or 0 for r in rows], "given": [r[3] is not None for r in rows], "remaining": pd.array([r[4] for r in rows], "Float64").to_numpy("float64", na_value=float("nan")), "event": [r[1] for r in rows]})
    kind = T._rates(2000)
    kind.event = "long"
    made, handle, got = kind(), Handle(), []
    made.init(handle)
    order = pdf.assign(came=pdf["ms"] + [rng.randrange(1500) for _ in rows]).sort_values("came")
    for first, last in ((0, 200), (200, 210), (210, 500), (500, 600), (600, 600)):
        part = order[first:last]
        passed = int(order["ms"][:last].max()) - 1500 if last < 600 or len(part) else 10**15
        if len(part):
            assert not list(made.handleInputRows((7,), iter([part[:150], part[150:]] if len(part) > 150 else [part]), None))
        for due in sorted(t for t in handle.timers if t <= passed):
            handle.timers.discard(due)
            for out in made.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: passed), None):
                got += [(int(e), (None if pd.isna(r) else float(r), None if pd.isna(s) else int(s))) for e, r, s in zip(out["event"], out["rate"], out["eta_seconds"])]
    assert len(got) == 600 and dict(got) == want
    assert handle.calls <= 20 and State.calls <= 60 and None in {rate for rate, _ in want.values()}


def test_sliding_rate_stream_of_large_parts_and_missing_bytes(spark, tmp_path):
    """A job whose rows fill several values and answers, nulls among its bytes, sums beyond 64 bits, another time zone, ids of text."""
    import datetime

    rows = [("a", f"e{i}", _micros(i * 40_000), None if i % 3 == 0 else 2 * i, 10**6) for i in range(250)] + [("b", f"n{i}", _micros(i * 500_000), None, 5) for i in range(4)]
    rows += [("c", f"l{i}", _micros(i * 500_000), 5 * 10**18, None) for i in range(4)]
    df = spark.createDataFrame(rows, "job string, event string, ts timestamp, bytes long, remaining long")
    want = {r.event: (r.ts, r.rate, r.eta_seconds) for r in T.transfer_rate(df.filter("job <> 'c'"), 2, "remaining").collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", "", _micros(10**10), 0, None)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    zone, was = spark.conf.get("spark.sql.session.timeZone"), T.PART
    T.PART = 64
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        out = T.sliding_rate_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, "1 second")
        out.writeStream.format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
        got = {r.event: (r.ts, r.rate, r.eta_seconds) for r in spark.table("parts").collect() if r.job != "z"}
    finally:
        T.PART = was
        spark.conf.set("spark.sql.session.timeZone", zone)
    large = [got.pop(f"l{i}")[1] for i in range(4)]
    assert got == want and large == [None, 10**19 / 0.5, 15 * 10**18 / 1.0, 2 * 10**19 / 1.5]
    assert {want[f"n{i}"][1] for i in range(4)} == {None} and datetime.datetime(2024, 1, 1) == want["e0"][0]


def test_commits_query_has_bumps(spark):
    """Every event is a request, and bumps of the epoch stand between them: later requests are created under the new epoch."""
    from palimpsest.plans.line_queries import t3_stream_commits

    from .test_queries import DATA

    rows = t3_stream_commits(spark, DATA).collect()
    events = {r.event_id for r in spark.read.parquet(f"{DATA}/events.parquet").collect()}
    assert {r.request_id for r in rows if r.outcome != "bumped"} == events
    assert sorted(r.request_id for r in rows if r.outcome == "bumped") == sorted(e for e in events if e % 9 == 5)
    assert len(rows) == len(events) + sum(e % 9 in (0, 5) for e in events)
    assert {r.epoch > 0 for r in rows if r.outcome == "created"} == {False, True} and len({(r.namespace_id, r.seq) for r in rows}) == len(rows)


def test_commits_of_a_batch_in_any_order(spark):
    """A namespace's rows of a batch come in several frames whose order says nothing."""

    class State(dict):
        def exists(self):
            return bool(self)

        def get(self):
            return self["value"]

        def update(self, value):
            self["value"] = value

    class Handle:
        getValueState = getMapState = lambda self, *names: State()

    log = spark.createDataFrame([(7, 2 * i, i, i - 1 or None, i - 1 or None, 0, "commit") for i in range(1, 90)], LOG)
    pdf, made = log.toPandas(), T._processor()
    made.init(Handle())
    got = [tuple(r) for parts in ((pdf[20:40], pdf[:20]), (pdf[70:], pdf[40:60], pdf[60:70])) for out in made.handleInputRows((7,), iter(parts), None) for r in out.itertuples(index=False)]
    assert sorted(got) == sorted(tuple(r) for r in replay_commits(log).collect()) and {r[3] for r in got} == {"created"}


def test_commits_query_in_several_batches(spark, monkeypatch):
    from palimpsest.plans import graph_queries, line_queries

    from .test_queries import DATA

    monkeypatch.setattr(line_queries, "AT_ONCE", 70)
    want = sorted(replay_commits(graph_queries.commit_log(spark, DATA, bumps=True)).collect())
    assert max(r.seq for r in want) > 140 and sorted(line_queries.t3_stream_commits(spark, DATA).collect()) == want
