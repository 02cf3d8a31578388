"""Objects are listed by tasks, each folder once, and once for each search."""

import gzip
import os
from datetime import datetime

from pyspark.sql import functions as F

from linescan.functions.hours import hour_grid
from linescan.functions.layout import Bucket
from linescan.operators import catalog as objects
from linescan.plans.search import search, search_to_files, select_objects
from linescan.sources.catalog import list_objects
from linescan.sources.listing import list_under

BUCKET = Bucket("b", [("static", "logs"), ("date", "dt=%Y%m%d/hour=%H")])


def tree(root, hours, days=("20240315",)):
    for d in days:
        for h in hours:
            folder = root / "logs" / f"dt={d}" / f"hour={h}"
            folder.mkdir(parents=True)
            (folder / "a.json").write_text(f"ERROR {d}{h}\nfine\n")
            (folder / "deep").mkdir()
            (folder / "deep" / "b.json.gz").write_bytes(gzip.compress(b"ERROR deep\n"))
            for hidden in ("_SUCCESS", ".part.crc"):
                (folder / hidden).write_text("ERROR not seen\n")
    return str(root)


def logged(log):
    """A way to open file systems that writes down what is listed."""
    log = str(log)

    def opened(path):
        from pyarrow import fs

        from linescan.sources.manifest import file_system

        system, base = file_system(path)

        class Watched:
            def get_file_info(self, selector):
                with open(f"{log}/{os.getpid()}", "a") as f:
                    f.write(selector.base_dir.removeprefix(base) + "\n")
                return system.get_file_info(selector)

        assert fs
        return Watched(), base

    return opened


def test_each_folder_is_listed_once(spark, tmp_path):
    root = tree(tmp_path / "in", [f"{h:02d}" for h in range(24)], ("20240315", "20240316"))
    (tmp_path / "log").mkdir()
    grid = objects.prefix_grid(hour_grid(spark, datetime(2024, 3, 1), datetime(2024, 3, 31, 23)), [BUCKET])
    found = list_under(spark, root, grid.select("prefix").union(grid.select("prefix")), logged(tmp_path / "log"))
    keys = [r.key for r in found.collect()]
    assert len(keys) == len(set(keys)) == 2 * 24 * 2
    listed = [line for f in (tmp_path / "log").iterdir() for line in f.read_text().split("\n") if line]
    days = [p for p in listed if p.count("/") == 2]
    assert len(listed) == len(set(listed)) and len(days) == 31 and len(listed) == 31 + 48
    assert len(list((tmp_path / "log").iterdir())) > 1  # more than one worker


def test_what_is_listed(spark, tmp_path):
    root = tree(tmp_path / "in", ["08", "09", "10"])
    (tmp_path / "in" / "top.txt").write_text("x")
    (tmp_path / "in" / "logs" / "flat-20240315.txt").write_text("abc")
    keys = lambda prefixes: sorted(r.key for r in list_objects(spark, root, "b", prefixes).collect())
    hour = "logs/dt=20240315/hour=08"
    assert keys([hour]) == [f"{hour}/a.json", f"{hour}/deep/b.json.gz"] == keys([f"{hour}/", hour, None, "nowhere/x", "logs/dt=2099"])
    assert len(keys(["logs/dt=20240315/hour=0"])) == 4 and keys([f"{hour}/a"]) == [f"{hour}/a.json"]
    assert keys(["logs/flat"]) == ["logs/flat-20240315.txt"] and keys(["top"]) == ["top.txt"]
    assert len(keys([""])) == 8 == list_objects(spark, root, "b").count() and keys([]) == []
    row = list_objects(spark, f"file://{root}/", "b", ["logs/flat"]).first()
    both = list_objects(spark, root, "b").where("key = 'logs/flat-20240315.txt'").first()
    assert (row.key, row.size) == ("logs/flat-20240315.txt", 3) and abs((row.last_modified - both.last_modified).total_seconds()) < 1


def test_one_catalog_for_a_search(spark, tmp_path):
    """Folders are listed in one job, and objects that come while it runs change no figure."""
    root = tree(tmp_path / "in", ["08", "09", "10"])
    query = {"roots": {"b": root}, "buckets": [BUCKET], "start": datetime(2024, 3, 15, 8), "end": datetime(2024, 3, 15, 9)}
    store = spark._jsparkSession.sharedState().statusStore()
    flush = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executions = lambda: {e.executionId(): e.physicalPlanDescription() for e in map(store.executionsList().apply, range(store.executionsList().size()))}
    flush()
    before = max(executions(), default=-1)
    late = tmp_path / "in" / "logs" / "dt=20240315" / "hour=08" / "late.json"
    chosen = objects.kept(select_objects(spark, **query))
    late.write_text("ERROR late\n" * 100)
    assert chosen.count() == 4
    late.unlink()
    run = search_to_files(spark, str(tmp_path / "out"), line_regex="ERROR", key_regex=r"\.json$", **query).first()
    late.write_text("ERROR late\n" * 100)
    assert (run.files_searched, run.matches, run.lines_read, run.bytes_read) == (2, 2, 4, 2 * (17 + 5))
    flush()
    plans = [p for i, p in executions().items() if i > before]
    assert sum("children(" in p for p in plans) == 2 and sum("below(" in p for p in plans) == 2  # once for each of the two calls


def test_several_buckets_in_one_pass(spark, tmp_path):
    one, two = tree(tmp_path / "one", ["08"]), tree(tmp_path / "two", ["08", "09"])
    buckets = [BUCKET, Bucket("c", BUCKET.path, [r"a\.json$"]), Bucket("none", BUCKET.path)]
    (tmp_path / "empty").mkdir()
    query = {"roots": {"b": one, "c": two, "none": str(tmp_path / "empty")}, "buckets": buckets, "start": datetime(2024, 3, 15, 8), "end": datetime(2024, 3, 15, 9)}
    got = sorted((r.bucket, r.key.rsplit("/", 1)[-1], r.hour, r.value) for r in search(spark, line_regex="ERROR", **query).collect())
    assert got == [("b", "a.json", "08", "ERROR 2024031508"), ("b", "b.json.gz", "08", "ERROR deep"), ("c", "a.json", "08", "ERROR 2024031508"), ("c", "a.json", "09", "ERROR 2024031509")]
    run = search_to_files(spark, str(tmp_path / "out"), **query).first()
    assert (run.files_searched, run.lines_read, run.matches) == (4, 7, 7)
    assert select_objects(spark, **query).groupBy("bucket").agg(F.count("*")).count() == 2
