import threading
from collections import deque
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
import zstandard

from linescan.functions.layout import Bucket
from linescan.plans.search import search, search_to_files, search_to_http
from linescan.sources.http_lines import LEAST_RATE, Pacer, Settings, delivery_stats, write_http
from linescan.sources.zstd_lines import write_lines
from linescan.streaming import search_stream as streams

from .test_lines import hour_tree


def unpacked(path):
    return zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()


def test_zstd_files(spark, tmp_path):
    lines = spark.createDataFrame([("2025-02-23/14", '{"msg":"hello"}')] * 10 + [("b", "x"), ("c", "y"), ("c", None)], "prefix string, value string")
    write_lines(lines, str(tmp_path))
    assert unpacked(tmp_path / "2025-02-23" / "14.zst") == b'{"msg":"hello"}\n' * 10
    assert unpacked(tmp_path / "c.zst") == b"y\n"
    write_lines(spark.createDataFrame([("c", bytearray(b"\xff\xfe"))] * 100, "prefix string, value binary"), str(tmp_path), level=19)
    assert unpacked(tmp_path / "c.zst") == b"\xff\xfe\n" * 100 and (tmp_path / "c.zst").stat().st_size < 300
    assert unpacked(tmp_path / "b.zst") == b"x\n"
    assert not list(tmp_path.rglob(".*.tmp"))
    with pytest.raises(Exception, match="levels"):
        write_lines(lines, str(tmp_path), level=30)


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            status, headers = self.server.plan.popleft() if self.server.plan else (self.server.then, {})
            self.server.seen.append((status, dict(self.headers), body))
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()

        def log_message(self, *a):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    made.plan, made.seen, made.then = deque(), deque(), 200
    threading.Thread(target=made.serve_forever, daemon=True).start()
    made.url = f"http://127.0.0.1:{made.server_address[1]}/"
    yield made
    made.shutdown()


def received(server):
    return [line for status, _, body in server.seen if status == 200 for line in zstandard.ZstdDecompressor().stream_reader(body).read().split(b"\n")[:-1]]


def fifty(spark):
    return spark.range(50).selectExpr("concat('line ', id) AS value").coalesce(1)


def test_http_throttled_then_delivered(spark, server, tmp_path, monkeypatch):
    monkeypatch.setenv("LINES_TOKEN", "t0ken")
    server.plan.extend([(429, {"Retry-After": "0.05"})] * 3)
    write_http(fifty(spark), server.url, maxRetries=5, statsPath=str(tmp_path), token="t0ken")
    stats = delivery_stats(spark, str(tmp_path)).first()
    assert (stats.lines_sent, stats.lines_dropped) == (50, 0) and len(server.seen) > 3
    assert sorted(received(server)) == sorted(f"line {i}".encode() for i in range(50))
    headers = server.seen[-1][1]
    assert headers["Content-Type"] == "application/x-ndjson" and headers["Content-Encoding"] == "zstd" and headers["Authorization"] == "Bearer t0ken"


def test_http_drops_are_counted(spark, server, tmp_path):
    server.then = 503
    write_http(fifty(spark), server.url, maxRetries=1, statsPath=str(tmp_path))
    stats = delivery_stats(spark, str(tmp_path)).first()
    assert (stats.lines_sent, stats.lines_dropped, len(server.seen)) == (0, 50, 2)
    with pytest.raises(Exception, match="dropped"):
        write_http(fifty(spark), server.url, maxRetries=0, failOnDrop="true")


def test_http_fatal_is_sent_once(spark, server, tmp_path):
    server.then = 403
    with pytest.raises(Exception, match="HTTP 403"):
        write_http(fifty(spark), server.url, maxRetries=5, statsPath=str(tmp_path))
    assert len(server.seen) == 1
    assert delivery_stats(spark, str(tmp_path)).first().lines_dropped == 50


class Clock:
    now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_static_rate():
    clock = Clock()
    pacer = Pacer(Settings("u", max_batch_bytes=500, max_rate=1000.0), clock, clock.sleep)
    for _ in range(5):
        pacer.wait(1000)
    assert clock.now == pytest.approx(4.0)  # the first from the full bucket
    free = Pacer(Settings("u"), clock, clock.sleep)
    free.wait(10**9)
    assert clock.now == pytest.approx(4.0) and not free.lower()


def test_adaptive_rate():
    clock = Clock()
    pacer = Pacer(Settings("u", max_submission_time=4.0), clock, clock.sleep)
    clock.now = 10.0
    pacer.done(100_000_000, 1.0)
    assert pacer.rate is None
    pacer.done(100_000_000, 5.0)
    assert pacer.rate == pytest.approx(20_000_000 * 0.85)
    pacer.done(1, 5.0)  # within the pause
    assert pacer.rate == pytest.approx(20_000_000 * 0.85)
    pacer.done(1, 1.0)
    assert pacer.rate == pytest.approx(20_000_000 * 0.85 + 1_000_000)
    for _ in range(20):
        pacer.done(1, 1.0)
    assert pacer.rate == pacer.ceiling
    for _ in range(60):
        clock.now += 3
        pacer.lower()
    assert pacer.rate == LEAST_RATE


BUCKET = Bucket("b", [("static", "logs"), ("date", "dt=%Y%m%d/hour=%H")], ["service-a"])
RANGE = {"start": datetime(2024, 3, 15, 8), "end": datetime(2024, 3, 15, 9)}


def test_whole_search(spark, tmp_path, server):
    root = hour_tree(tmp_path / "in")
    query = {"roots": {"b": root}, "buckets": [BUCKET], **RANGE, "line_regex": "error", "ignore_case": True}
    found = search(spark, **query).collect()
    assert sorted((r.value, r.prefix, r.dt, r.hour) for r in found) == [(f"a{h} ERROR", f"logs/dt=20240315/hour={h}", "20240315", h) for h in ("08", "09")]
    run = search_to_files(spark, str(tmp_path / "out"), **query).first()
    assert (run.files_searched, run.matches, run.plaintext_bytes, run.pattern) == (2, 2, 20, "error") and run.ratio > 0
    assert unpacked(tmp_path / "out" / "logs" / "dt=20240315" / "hour=09.zst") == b"a09 ERROR\n"
    sent = search_to_http(spark, server.url, str(tmp_path / "stats"), **query).first()
    assert sent.lines_sent == 2 and sorted(received(server)) == [b"a08 ERROR", b"a09 ERROR"]
    with pytest.raises(ValueError, match="No objects"):
        search(spark, **query | {"start": datetime(2020, 1, 1), "end": datetime(2020, 1, 1)})


def test_odd_names(spark, tmp_path):
    folder = tmp_path / "in" / "logs" / "dt=20240315" / "hour=08"
    folder.mkdir(parents=True)
    for name in ("a b+c%20.txt", "x{1,2}[3].txt", "plain.txt"):
        (folder / name).write_text(name + "\n")
    found = search(spark, {"b": str(tmp_path / "in")}, [Bucket("b", BUCKET.path)], RANGE["start"], RANGE["start"]).collect()
    assert {r.value: r.key.rsplit("/", 1)[-1] for r in found} == {n: n for n in ("a b+c%20.txt", "x{1,2}[3].txt", "plain.txt")}


def test_streams(spark, tmp_path, server):
    root = hour_tree(tmp_path / "in") + "/logs"
    rows = streams.ProgressRows()
    spark.streams.addListener(rows)
    found = streams.search_stream(streams.line_stream(spark, root, max_files=2), "ERROR")
    streams.to_files(found, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    written = b"".join(sorted(unpacked(p) for p in (tmp_path / "out").rglob("*.zst")))
    assert written == b"a08 ERROR\na09 ERROR\na10 ERROR\n"
    streams.to_http(found, server.url, str(tmp_path / "c2")).awaitTermination()
    assert sorted(received(server)) == [b"a08 ERROR", b"a09 ERROR", b"a10 ERROR"]
    import time

    for _ in range(50):
        if rows.rows and sum(r.matches or 0 for r in rows.table(spark).collect()) >= 6:
            break
        time.sleep(0.2)
    spark.streams.removeListener(rows)
    assert sum(r.matches or 0 for r in rows.table(spark).collect()) >= 6


def test_one_pass_over_the_text(spark, tmp_path):
    """The lines are read once, files that are not chosen are never opened, and foreign files change no figure."""
    root = hour_tree(tmp_path / "in")
    hour = tmp_path / "in" / "logs" / "dt=20240315" / "hour=08"
    (hour / "service-z.json.gz").write_bytes(b"\x1f\x8b no gzip at all")
    (tmp_path / "in" / "logs" / "dt=20240315" / "hour=11").mkdir()
    (tmp_path / "in" / "logs" / "dt=20240315" / "hour=11" / "service-a.json.gz").write_bytes(b"nor this")
    out = tmp_path / "out"
    out.mkdir()
    (out / "foreign.zst").write_bytes(b"x" * 1000)
    store = spark._jsparkSession.sharedState().statusStore()
    executions = lambda: {e.executionId(): e.physicalPlanDescription() for e in map(store.executionsList().apply, range(store.executionsList().size()))}
    flush = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    flush()
    before = max(executions(), default=-1)
    run = search_to_files(spark, str(out), roots={"b": root}, buckets=[BUCKET], **RANGE, line_regex="error", ignore_case=True).first()
    flush()
    plans = [p for i, p in executions().items() if i > before]  # by id: the store forgets old executions
    assert sum("Scan text" in p for p in plans) == 1
    written = [p for p in out.rglob("*.zst") if p.name != "foreign.zst"]
    assert len(written) == 2 and run.compressed_bytes == sum(p.stat().st_size for p in written)
    assert (run.files_searched, run.matches, run.plaintext_bytes) == (2, 2, 20) and run.ratio == 20 / run.compressed_bytes


def test_overlapping_prefixes(spark, tmp_path):
    root = hour_tree(tmp_path / "in")
    wide = Bucket("b", [("static", "logs"), ("date", "dt=%Y%m%d")])
    both = {"roots": {"b": root}, "start": RANGE["start"], "end": RANGE["end"], "key_regex": "service-a"}
    got = search(spark, buckets=[wide], **both)
    assert sorted(r.value for r in got.collect()) == ["a08 ERROR", "a09 ERROR", "a10 ERROR"] and {r.prefix for r in got.collect()} == {"logs/dt=20240315"}
    assert sorted(r.value for r in search(spark, buckets=[wide], distinct=False, **both).collect()) == sorted(["a08 ERROR", "a09 ERROR", "a10 ERROR"] * 2)


def test_null_prefixes_and_figures_of_the_writer(spark, tmp_path):
    from linescan.sources.zstd_lines import written_files

    rows = [("a/b", f"line {i}é") for i in range(300)] + [(None, "lost"), (None, "found"), ("a/c", "")]
    write_lines(spark.createDataFrame(rows, "prefix string, value string"), str(tmp_path / "out"), stats_path=str(tmp_path / "stats"))
    got = {r.prefix: r for r in written_files(spark, str(tmp_path / "stats")).collect()}
    assert {k: (r.file, r.lines, r.plaintext_bytes) for k, r in got.items()} == {
        "a/b": ("a/b.zst", 300, sum(len(v.encode()) + 1 for _, v in rows[:300])), "__null__": ("__null__.zst", 2, 11), "a/c": ("a/c.zst", 1, 1),
    }
    for r in got.values():
        assert (tmp_path / "out" / r.file).stat().st_size == r.compressed_bytes
    assert sorted(unpacked(tmp_path / "out" / "__null__.zst").split()) == [b"found", b"lost"]


def test_large_prefixes_are_split(spark, tmp_path):
    from linescan.sources.zstd_lines import written_files

    lines = spark.range(200_000).repartition(8).selectExpr("if(id % 10 = 0, 'cold', 'hot') AS prefix", "concat('line ', sha2(cast(id AS string), 256)) AS value")
    for k in (0, 1):
        with_size = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": ["300k", "1g"][k], "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2"}
        for name, value in with_size.items():
            spark.conf.set(name, value)
        write_lines(lines, str(tmp_path / "out"), stats_path=str(tmp_path / f"stats{k}"))
        for name in with_size:
            spark.conf.unset(name)
        rows = written_files(spark, str(tmp_path / f"stats{k}")).collect()
        files = [r for r in rows if r.prefix == "hot"]
        assert (len(files) > 3) if k == 0 else (len(files) == 1)
        assert sum(r.lines for r in rows) == 200_000
        assert {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.zst")} == {r.file for r in rows}  # nothing stays of the first time
        assert sum(unpacked(tmp_path / "out" / r.file).count(b"\n") for r in files) == 180_000


def test_failed_tasks_leave_nothing(spark, tmp_path):
    bad = spark.range(100).selectExpr("'p' AS prefix", "if(id = 99, raise_error('broken'), 'x') AS value")
    bad = bad.unionByName(spark.range(1000).selectExpr("'q' AS prefix", "'y' AS value"))
    with pytest.raises(Exception):
        write_lines(bad, str(tmp_path / "out"))
    from linescan.sources.zstd_lines import Written, WrittenFile, ZstdLinesWriter

    writer = ZstdLinesWriter(str(tmp_path / "out"), 3)
    (tmp_path / "out").mkdir(exist_ok=True)
    (tmp_path / "out" / f".p.{writer.run}.attempt.tmp").write_bytes(b"of a failed attempt")
    (tmp_path / "out" / "kept.zst").write_bytes(b"")
    writer.abort([None])
    assert [p.name for p in (tmp_path / "out").rglob("*") if p.is_file()] == ["kept.zst"]
    (tmp_path / "out" / f".p.{writer.run}.1.tmp").write_bytes(b"one")
    (tmp_path / "out" / f".p.{writer.run}.2.tmp").write_bytes(b"again")
    writer.commit([Written([WrittenFile(str(tmp_path / "out" / f".p.{writer.run}.2.tmp"), "p")])])
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["kept.zst", "p.zst"] and (tmp_path / "out" / "p.zst").read_bytes() == b"again"


def test_first_refusal_stops_all_tasks(spark, server, tmp_path):
    server.then = 403
    lines = spark.range(4000).repartition(40).selectExpr("concat('line ', id) AS value")
    with pytest.raises(Exception, match="HTTP 403"):
        write_http(lines, server.url, maxRetries=5, statsPath=str(tmp_path))
    assert 1 <= len(server.seen) <= 12  # the tasks that ran at that moment, not all 40
    stats = delivery_stats(spark, str(tmp_path)).first()
    assert (stats.lines_sent, stats.lines_dropped) == (0, 4000)


def test_ceiling_before_anything_was_sent():
    clock = Clock()
    pacer = Pacer(Settings("u", max_submission_time=4.0), clock, clock.sleep)
    clock.now = 5.0
    assert pacer.lower() and pacer.ceiling == 10 * LEAST_RATE and pacer.rate == pytest.approx(10 * LEAST_RATE * 0.85)
    for _ in range(100):
        pacer.done(1, 1.0)
    assert pacer.rate == 10 * LEAST_RATE
