"""Jobs, the durable queue and streams."""

import json
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shutterlake.jobs import Debounced, Job, JobManager, Progress, SparkJob, Status
from shutterlake.operators import queue
from shutterlake.schemas import schema
from shutterlake.streaming import library


class Waits(Job):
    name = "waits"

    def __init__(self):
        super().__init__()
        self.began, self.go = threading.Event(), threading.Event()

    def work(self):
        self.began.set()
        while not self.go.wait(0.01):
            if self.stopping:
                return


class Other(Waits):
    pass


class Newer(Waits):
    supersedable = True


class Fails(Job):
    def work(self):
        raise ValueError("broken")


def test_status():
    seen = []
    for job, status, kinds in ((Waits(), Status.COMPLETED, ["STARTED", "ENDED"]), (Fails(), Status.FAILED, ["STARTED", "FAILED"])):
        assert job.status == Status.NEVER_RUN
        job.listen = lambda kind, facts: seen.append(kind)
        if isinstance(job, Waits):
            job.go.set()
        assert job.run() == status and seen == kinds
        seen.clear()
    job = Waits()
    job.stop()
    assert job.run() == Status.INTERRUPTED and not job.began.is_set()
    job = Waits()
    job.listen = lambda kind, facts: seen.append(kind)
    threading.Timer(0.05, job.stop).start()
    assert job.run() == Status.INTERRUPTED and seen == ["STARTED", "INTERRUPTED"]


def test_progress_is_throttled():
    job, seen, now = Waits(), [], [0.0]
    job.listen, job.clock = lambda kind, facts: seen.append((facts["done"], facts["text"])), lambda: now[0]
    for k in range(1, 11):
        now[0] += 0.03
        job.progress(k, 10, phase="Hashing", last=k == 10)
    assert seen == [(1, "Hashing: 1/10"), (5, "Hashing: 5/10"), (9, "Hashing: 9/10"), (10, "Hashing: 10/10")]


def test_manager():
    events = Progress()
    manager = JobManager(events)
    first = Waits()
    assert manager.submit(first) == first.id and first.began.wait(5) and manager.current == first.id
    assert manager.submit(Waits()) is None  # one of the class runs
    other = Other()
    assert manager.submit(other) and manager.submit(Other()) is None and manager.waiting == [other.id]
    assert manager.cancel(other.id) and not manager.cancel("unknown")
    last = Newer()
    assert manager.submit(last)
    newer = Newer()
    assert manager.submit(newer) and last.id not in manager.waiting  # the newer one takes the waiting one's place
    first.go.set()
    assert newer.began.wait(5) and other.status == Status.INTERRUPTED and not other.began.is_set()
    newest = Newer()
    assert manager.submit(newest) and newest.began.wait(5) and newer.status == Status.INTERRUPTED  # and stops the running one
    newest.go.set()
    assert manager.drain(5) and manager.current is None
    job = Waits()
    manager.submit(job)
    manager.submit(Other())
    assert job.began.wait(5)
    manager.close()
    assert job.status == Status.INTERRUPTED and manager.waiting == [] and manager.submit(Waits()) is None
    kinds = [events.events.get_nowait()[0] for _ in range(events.events.qsize())]
    assert kinds.count("STARTED") == kinds.count("ENDED") + kinds.count("INTERRUPTED")


def test_a_failed_job_doesn_t_stop_the_manager():
    manager = JobManager()
    failed, next_ = Fails(), Waits()
    next_.go.set()
    manager.submit(failed)
    manager.submit(next_)
    assert manager.drain(5) and (failed.status, next_.status) == (Status.FAILED, Status.COMPLETED)
    manager.close()


def test_spark_job_is_cancelled(spark):
    began = threading.Event()

    def body(job):
        began.set()
        spark.range(8).repartition(2).mapInPandas(lambda it: (time.sleep(60) or p for p in it), "id long").count()

    job = SparkJob(spark, body)
    thread = threading.Thread(target=job.run)
    thread.start()
    began.wait(10)
    time.sleep(2)
    job.stop()
    thread.join(40)
    assert not thread.is_alive() and job.status == Status.INTERRUPTED
    quick = SparkJob(spark, lambda job: spark.range(3).count())
    assert quick.run() == Status.COMPLETED


def test_debounce():
    got, debounced = [], Debounced(0.05)
    for k in range(5):
        debounced.call(lambda k=k: got.append(k))
        time.sleep(0.005)
    time.sleep(0.3)
    assert got == [4]
    debounced.call(lambda: got.append(9))
    debounced.close()
    time.sleep(0.1)
    assert got == [4]


def test_queue(spark):
    now = datetime(2024, 5, 1)
    rows = [(1, "copy", bytearray(b'{"n":1}'), "PENDING", 0, None, now, None), (2, "copy", None, "PENDING", 0, now + timedelta(days=1), now, None), (3, "fail", None, "IN_PROGRESS", 2, now, now, "before"), (4, "who", None, "PENDING", 0, None, now, None), (5, "copy", None, "COMPLETED", 0, None, now, None)]
    actions = spark.createDataFrame(rows, schema("pending_action"))
    more = spark.createDataFrame([(6, 7)], "id long, n int").select("id", F.lit("copy").alias("type"), queue.payload("n").alias("payload"))
    actions = queue.added(actions, more, now)
    done, saved = [], []

    def fail(action):
        raise OSError("disk")

    def save(df):
        saved.append(df.collect())
        return spark.createDataFrame(saved[-1], df.schema)

    out = queue.work(actions, now, {"copy": lambda a: done.append((a["id"], json.loads(a["payload"])["n"])), "fail": fail}, save)
    got = {r["id"]: (r["status"], r["retry_count"], r["last_error"]) for r in out.collect()}
    assert done == [(1, 1), (6, 7)]
    assert got == {1: ("COMPLETED", 0, None), 2: ("PENDING", 0, None), 3: ("PENDING", 3, "disk"), 4: ("FAILED", 0, "No handler for type"), 5: ("COMPLETED", 0, None), 6: ("COMPLETED", 0, None)}
    assert any(r["status"] == "IN_PROGRESS" for step in saved for r in step)


def test_ingest_stream(spark, tmp_path):
    ddl = "path string, size long"
    source, known = str(tmp_path / "in"), [("a", 1)]
    spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], ddl).write.parquet(source)
    got = {}

    def sink(df, number):
        got.setdefault(number, {}).update({r["path"]: r["outcome"] for r in df.collect()})
        known[:] = [(p, s) for p, s in known if p not in got[number]] + [(r["path"], r["size"]) for r in df.collect()]

    def run():
        library.ingest(spark.readStream.schema(ddl).parquet(source), lambda: spark.createDataFrame(known, ddl), sink, str(tmp_path / "cp")).awaitTermination(120)

    run()
    assert got == {0: {"a": "SKIPPED_UNCHANGED", "b": "IMPORTED"}}
    spark.createDataFrame([("b", 3), ("c", 1)], ddl).write.mode("append").parquet(source)
    run()
    assert got[1] == {"b": "UPDATED", "c": "IMPORTED"}
    run()
    assert len(got) == 2  # nothing new, no batch


def test_session_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = [t + timedelta(hours=h) for h in (0, 1, 2, 8, 30, 31)]  # 2 to 8 is exactly the gap
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, x) for x in at] + [(1, t + timedelta(days=9))], "who long, at timestamp_ntz").write.parquet(source)
    stream = library.session_albums(spark.readStream.schema("who long, at timestamp_ntz").parquet(source), ["who"], "at", least=2)
    query = stream.writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["start"], r["n"]) for r in spark.table("sessions_out").collect())
    assert [n for _, n in got] == [4, 2]


def test_assignment_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, None)], "id long, embedding array<double>").write.parquet(source)
    prototypes = spark.createDataFrame([(10, [1.0, 0.0]), (20, [0.0, 1.0])], "cluster_id long, centroid array<double>")
    stream = library.assign(spark.readStream.schema("id long, embedding array<double>").parquet(source), prototypes)
    query = stream.writeStream.format("memory").queryName("assigned_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["id"]: r["cluster_id"] for r in spark.table("assigned_out").collect()} == {1: 10, 2: 20}


@pytest.mark.parametrize("text", ["x", None])
def test_payload(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, t string").withColumn("p", queue.payload("id", "t"))
    assert tuple(df.select(queue.read_payload("p", "id long, t string").alias("r")).select("r.*").first()) == (1, text)
