"""The delivery log: a row for every try, and what can be read off it."""

import pytest
import zstandard


from linescan.operators import deliveries
from linescan.sources import http_lines
from linescan.sources.http_lines import LOG_SCHEMA, Sender, Settings, delivery_log, delivery_stats, send_all, write_http

from .test_sinks import server  # noqa: F401


def lines(spark, n=50, parts=1):
    return spark.range(n).selectExpr("concat('line ', id) AS value").repartition(parts)


def test_a_row_for_every_try(spark, server, tmp_path):  # noqa: F811
    server.plan.extend([(429, {"Retry-After": "0.05"}), (503, {}), (503, {}), (429, {}), (200, {})])
    write_http(lines(spark), server.url, maxRetries=5, logPath=str(tmp_path / "log"), statsPath=str(tmp_path / "stats"))
    log = delivery_log(spark, str(tmp_path / "log"))
    rows = log.orderBy("try").collect()
    assert [(r["try"], r.status, r.retry_after, r.lines, r.batch) for r in rows] == [(1, 429, 0.05, 50, 1), (2, 503, None, 50, 1), (3, 503, None, 50, 1), (4, 429, None, 50, 1), (5, 200, None, 50, 1)]
    assert len({r.run for r in rows}) == 1 and all(r.plaintext_bytes == sum(len(f"line {i}\n") for i in range(50)) and r.compressed_bytes > 0 for r in rows)
    delays = [(r["try"], r["class"], r.retry, r.delay_ms) for r in deliveries.retry_delays(log).orderBy("try").collect()]
    assert delays == [(1, "throttled", 1, 50.0), (2, "retry", 1, 100.0), (3, "retry", 2, 200.0), (4, "throttled", 2, 200.0)]
    waits = [b.began - a.began - a.took for a, b in zip(rows, rows[1:])]
    assert all(w * 1000 >= d[3] for w, d in zip(waits, delays))
    stats = delivery_stats(spark, str(tmp_path / "stats")).first()
    totals = deliveries.outcome_totals(log).first()
    assert (totals.lines_sent, totals.lines_dropped, totals.tries) == (stats.lines_sent, stats.lines_dropped, 5) == (50, 0, 5)
    assert totals.compressed_bytes_sent == stats.compressed_bytes_sent and totals.batches_sent == 1


def test_dropped_and_refused(spark, server, tmp_path):  # noqa: F811
    write_http(lines(spark), "http://127.0.0.1:9/", maxRetries=1, logPath=str(tmp_path / "log"))
    rows = delivery_log(spark, str(tmp_path / "log")).collect()
    assert [(r.status, r.lines) for r in rows] == [(None, 50)] * 2 and all(r.error for r in rows)
    server.then = 403
    with pytest.raises(Exception, match="HTTP 403"):
        write_http(lines(spark, 400, 8), server.url, maxBatchBytes=1, logPath=str(tmp_path / "refused"))
    tries = delivery_log(spark, str(tmp_path / "refused"))
    assert tries.groupBy("task").count().where("count > 1").count() == 0 and 1 <= tries.count() <= 8
    assert [r.outcome for r in deliveries.batch_outcomes(tries).select("outcome").distinct().collect()] == ["dropped"]
    none = spark.createDataFrame([], LOG_SCHEMA)
    assert deliveries.outcome_totals(none).first().lines_sent == 0 and deliveries.retry_delays(none).count() == 0


def test_a_folder_takes_batches(spark, tmp_path):
    (tmp_path / "to").mkdir()
    write_http(lines(spark, 1000, 3), f"file://{tmp_path}/to", maxBatchBytes=300, logPath=str(tmp_path / "log"), statsPath=str(tmp_path / "stats"))
    files = list((tmp_path / "to").iterdir())
    got = [x for f in files for x in zstandard.ZstdDecompressor().stream_reader(f.open("rb")).read().decode().split("\n")[:-1]]
    assert sorted(got) == sorted(f"line {i}" for i in range(1000)) and all(f.suffix == ".zst" for f in files)
    assert len(files) == delivery_stats(spark, str(tmp_path / "stats")).first().batches_sent == delivery_log(spark, str(tmp_path / "log")).where("status = 201").count() > 6
    with pytest.raises(Exception, match="HTTP 404"):
        write_http(lines(spark), str(tmp_path / "missing"))
    (tmp_path / "file").write_text("")
    assert Sender(Settings(str(tmp_path / "file"), max_retries=0)).send(b"x", 1, 2) is None
    assert http_lines.post(Settings(str(tmp_path / "file")), b"x")[0] is None


def test_logs_are_written_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(http_lines, "LOG_ROWS", 7)
    (tmp_path / "to").mkdir()
    sender = Sender(Settings(str(tmp_path / "to"), log_path=str(tmp_path / "log")))
    for _ in range(20):
        sender.send(b"body", 1, 5)
    sender.write_log()
    assert len(list((tmp_path / "log").iterdir())) == 3
    log = delivery_log(spark, str(tmp_path / "log"))
    assert log.count() == 20 and [r.batch for r in log.select("batch").orderBy("batch").collect()] == list(range(1, 21))


def test_the_rate_is_held(spark):
    rows = [("r", 0, 1, b, 1, 200, None, None, 1, 10, 100, began, 0.0) for b, began in enumerate([0.0, 0.0, 1.0, 2.0], 1)]
    fast = [("r", 1, 2, b, 1, 200, None, None, 1, 10, 100, 0.1 * b, 0.0) for b in range(1, 9)]
    log = spark.createDataFrame(rows + fast, LOG_SCHEMA)
    assert {r.task: r.held for r in deliveries.held_rate(log, 100.0, 200.0).collect()} == {0: True, 1: False}


@pytest.mark.parametrize("limit", [1, 40, 1000, 50_000, 10**9])
def test_batches_of_slices(tmp_path, limit):
    """Whatever is fed at once, a batch closes at the first line that fills it, and no line is lost."""
    import random

    import pyarrow as pa

    rng = random.Random(5)
    values = [rng.randbytes(rng.choice([0, 3, 50, 3000])).replace(b"\n", b"_") for _ in range(400)]
    (tmp_path / "to").mkdir()
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 90] + [None], pa.binary())], ["value"]) for i in range(0, 400, 90)]
    log = str(tmp_path / "log")
    out = send_all(Settings(str(tmp_path / "to"), max_batch_bytes=limit, log_path=log), iter(batches))
    bodies = [f.read_bytes() for f in (tmp_path / "to").iterdir()]
    texts = [zstandard.ZstdDecompressor().stream_reader(b).read() for b in bodies]
    assert sorted(x for t in texts for x in t.split(b"\n")[:-1]) == sorted(values) and all(t.endswith(b"\n") for t in texts)
    assert out.lines_sent == 400 and out.batches_sent == len(bodies) and out.plaintext_bytes_sent == sum(len(v) + 1 for v in values)
    if limit == 1:
        assert len(bodies) == 400
    elif limit < 10**9:
        assert max(map(len, bodies)) <= limit + 3100 and sum(len(b) >= limit for b in bodies) >= len(bodies) - 1
    else:
        assert len(bodies) == 1
