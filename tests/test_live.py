"""Live states of runs, polling, growing files as sources, time limits of queued tasks."""

import time

import pytest

from tidemark.plans import orchestration
from tidemark.streaming import lines, streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_stalled_resumed(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "run string, n int"
    put = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(src)
    put(("a", 1), ("b", 1))
    m = streams.Monitor(streams.file_stream(spark, src, schema), "run", str(tmp_path / "t"), str(tmp_path / "ck"), after="4 seconds", every="1 second")
    try:
        def wait(want, most=60):
            end = time.time() + most
            while time.time() < end:
                if list((tmp_path / "t").glob("batch=*/_SUCCESS")) and want <= {(r.run, r.state) for r in m.changes().collect()}:
                    return
                time.sleep(0.5)
            raise AssertionError(m.changes().collect())

        wait({("a", "running"), ("b", "running")})
        wait({("a", "stalled"), ("b", "stalled")})
        put(("a", 2), ("a", 3))
        wait({("a", "resumed")})
        assert {(r.run, r.state): r.n_updates for r in m.changes().collect()}[("a", "resumed")] == 3
        assert {r.run for r in m.now("run").collect() if r.state == "stalled"} >= {"b"}
    finally:
        m.stop()


def test_progress_is_logged(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    log = streams.ProgressLog()
    spark.streams.addListener(log)
    try:
        streams.run_available(streams.file_stream(spark, str(tmp_path / "in"), "id long"), streams.append_to(str(tmp_path / "out")), str(tmp_path / "ck"))
        end = time.time() + 20
        while not (sum(x[2] for x in log.lines) and log.ended) and time.time() < end:
            time.sleep(0.2)
        assert sum(x[2] for x in log.lines) == 5 and list(log.ended.values()) == [None]
    finally:
        spark.streams.removeListener(log)


def test_polls_faster_while_busy():
    left, waited = iter([True, True, False, True]), []
    steps = []
    waits = streams.poll(lambda: steps.append(1) or next(left), lambda: len(steps) == 4, wait=waited.append)
    assert waits == waited == [2.0, 2.0, 6.0, 2.0]


def test_growing_lines_are_read_once(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\nhalf")
    (folder / "b.txt").write_text("other\n")

    def step():
        streams.run_available(lines.log_lines(spark, str(folder), ".log"), streams.append_to(str(tmp_path / "out")), str(tmp_path / "ck"))
        return rows(spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).select("at", "value"))

    assert step() == [(0, "one"), (4, "two")]
    with (folder / "a.log").open("a") as f:
        f.write(" line\r\né\n\n")
    (folder / "c.log").write_text("new\n")
    assert step() == step() == [(0, "new"), (0, "one"), (4, "two"), (8, "half line"), (19, "é"), (22, "")]


def test_stretches_share_no_line(tmp_path):
    text = "".join(f"line {i} {'x' * (i % 37)}\n" for i in range(500))
    (tmp_path / "a").write_text(text)
    for most in (1, 7, 100, 10**6):
        r = lines._Reader({"path": str(tmp_path), "maxbytespartition": most})
        got = [line for p in r.partitions({}, r.latestOffset()) for _, _, line in r.read(p)]
        assert got == text.splitlines()


def test_event_payloads_end_at_the_marker(spark, tmp_path):
    folder = tmp_path / "sse"
    folder.mkdir()
    (folder / "x").write_text('data: {"a": 1}\nevent: ping\ndata: {broken\ndata: {"a": 2}\ndata: [DONE]\ndata: {"a": 3}\n')
    (folder / "y").write_text('data: {"b": 1}\ndata: {"b"')
    for extra in ("", ': 2}\ndata: [DONE]\ndata: {"b": 3}\n'):
        with (folder / "y").open("a") as f:
            f.write(extra)
        streams.run_available(lines.event_payloads(spark, str(folder)), streams.append_to(str(tmp_path / "out")), str(tmp_path / "ck"))
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert [r[0] for r in rows(got.select("payload"))] == ['{"a": 1}', '{"a": 2}', '{"b": 1}', '{"b": 2}']


def test_a_hanging_task_ends_and_others_go_on(spark):
    def hang():
        def sleep(batches):
            for b in batches:
                time.sleep(90)
                yield b

        return spark.range(1).mapInPandas(sleep, "id long").count()

    began = time.time()
    out = orchestration.run_queue(spark, {"hangs": hang, "x": lambda: spark.range(5).count(), "y": lambda: spark.range(7).count()}, limits={"hangs": 3, "y": 60})
    assert out == {"hangs": ("timed out", 124), "x": ("done", 5), "y": ("done", 7)}
    assert time.time() - began < 60
    assert orchestration.run_queue(spark, {"p": lambda: 1}, paused=lambda: True) == {"p": ("queued", None)}


@pytest.mark.parametrize("limit", [None, 30])
def test_results_of_tasks_in_time(spark, limit):
    def bad():
        raise ValueError("no")

    out = orchestration.run_queue(spark, {"a": lambda: spark.range(3).count(), "b": bad}, limits=limit and {"a": limit, "b": limit})
    assert out == {"a": ("done", 3), "b": ("failed", "no")}
