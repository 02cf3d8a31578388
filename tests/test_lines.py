import gzip

import pytest
import zstandard
from pyspark.sql import functions as F

from linescan.functions import delivery
from linescan.functions.matching import check_pattern, java_pattern, matches, one_pass_form
from linescan.operators import catalog as objects
from linescan.operators.batches import pack_batches
from linescan.plans.search import match_lines
from linescan.sources.catalog import from_inventory, list_objects
from linescan.sources.lines import explode_lines, read_hours, read_lines, read_prefixes, with_source

BODY = b"ERROR one\r\nline two\nbinary \xff\xfe ERROR\n\nlast no newline"
SIZES = [10, 8, 15, 0, 15]


def files(root):
    root.mkdir(parents=True)
    packed = zstandard.ZstdCompressor().compress
    (root / "plain").write_bytes(BODY)
    (root / "a.gz").write_bytes(gzip.compress(BODY))
    (root / "two.gz").write_bytes(gzip.compress(BODY[:20]) + gzip.compress(BODY[20:]))
    (root / "a.zst").write_bytes(packed(BODY))
    (root / "a.zstd").write_bytes(packed(BODY))
    (root / "two.zst").write_bytes(packed(BODY[:20]) + packed(BODY[20:]))
    (root / "empty").write_bytes(b"")


def test_formats(spark, tmp_path):
    root = tmp_path / "mixed"
    files(root)
    lines = with_source(read_lines(spark, str(root)), str(root), "b")
    by = {}
    for r in lines.select("key", "bucket", "size", F.octet_length("value").alias("n")).collect():
        by.setdefault(r.key, []).append(r.n)
        assert r.bucket == "b" and r.size > 0
    assert by == {k: SIZES for k in ("plain", "a.gz", "two.gz", "a.zst", "a.zstd", "two.zst")}
    raw = {bytes(r[0]) for r in match_lines(read_lines(spark, str(root / "plain")), "ERROR$").select(F.col("value").cast("binary")).collect()}
    assert raw == {b"binary \xff\xfe ERROR"}  # a final \r stays, so the first line does not end in ERROR


def test_damage(spark, tmp_path):
    root = tmp_path / "bad"
    root.mkdir()
    import random

    rng = random.Random(1)
    whole = gzip.compress(b"".join(b"%032x\n" % rng.getrandbits(128) for _ in range(20000)))
    (root / "cut.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):
        read_lines(spark, str(root)).count()
    assert 0 < read_lines(spark, str(root), skip_bad=True).count() < 20000


def hour_tree(root):
    for h in ("08", "09", "10"):
        d = root / "logs" / "dt=20240315" / f"hour={h}"
        d.mkdir(parents=True)
        (d / "service-a.json.zst").write_bytes(zstandard.ZstdCompressor().compress(f"a{h} ERROR\n".encode()))
        (d / "service-b.json.gz").write_bytes(gzip.compress(f"b{h}\n".encode()))
    return str(root)


def test_pruning(spark, tmp_path):
    root = hour_tree(tmp_path / "tree")
    some = read_hours(spark, f"{root}/logs", [("20240315", "09"), ("20240315", "10")])
    assert sorted((r.value, r.dt, r.hour) for r in some.collect())[0] == ("a09 ERROR", "20240315", "09")
    assert some.count() == 4
    assert "PartitionFilters: [(concat(dt" in some._jdf.queryExecution().executedPlan().toString()
    gap = read_hours(spark, f"{root}/logs", [("20240315", "08"), ("20240315", "10"), ("20240315", "23")])
    assert {r.hour for r in gap.collect()} == {"08", "10"}
    assert read_hours(spark, f"{root}/logs", []).count() == 0
    prefixed = read_prefixes(spark, root, ["logs/dt=20240315/hour=08", "logs/dt=20240315/hour=23"])
    assert sorted(r.value for r in prefixed.collect()) == ["a08 ERROR", "b08"]


def test_catalog(spark, tmp_path):
    root = hour_tree(tmp_path / "cat")
    found = list_objects(spark, root, "b")
    assert found.count() == 6 and found.columns == ["bucket", "key", "size", "last_modified"]
    schema = found._jdf.queryExecution().executedPlan().toString().rpartition("ReadSchema: ")[2]
    assert "length" in schema and "content" not in schema
    grid = spark.createDataFrame([("b", "logs/dt=20240315/hour=0", "x", "y"), ("b", "logs/dt=20240315", "x", "y"), ("c", "logs", "x", "y")], "bucket string, prefix string, dt string, hour string")
    assert objects.select_prefixes(found, grid).count() == 4 + 6
    assert objects.select_prefixes(found, grid, distinct=True).count() == 6
    assert objects.select_prefixes(found, grid, boundary=True).count() == 6
    tagged = objects.select_prefixes(found, grid, distinct=True)
    assert objects.filter_suffixes(tagged, [r"service-a\.json", "nothing"]).count() == 3
    assert objects.filter_suffixes(tagged, []).count() == 6
    assert objects.filter_keys(found, r"b\.json\.gz$").count() == 3
    with pytest.raises(ValueError, match="No objects found to search"):
        objects.require_objects(found.where("false"))
    many = spark.range(40).select(F.lit("b").alias("bucket"), F.expr("substring('logs/dt=20240315/hour=08/service-a.json', 1, int(id))").alias("prefix"))
    starts = [r.prefix for r in many.collect()]
    expected = sum(r.key.startswith(p) for r in found.collect() for p in starts)
    assert objects.select_prefixes(found, many).count() == expected  # many lengths: the other way
    odd = spark.createDataFrame([("b", None, 1, None)], "bucket string, key string, size long, last_modified timestamp")
    assert from_inventory(odd).count() == 0


def test_matching(spark):
    lines = spark.createDataFrame([("ERROR: bad",), ("Another ERROR",), ("Line 1",), ("This is a TEST line",), ("",), ("Été",), ("foo\r",), ("a\rb",)], "value string")
    found = lambda p, i=False: {r.value for r in match_lines(lines, p, i).collect()}
    assert found("ERROR") == {"ERROR: bad", "Another ERROR"}
    assert found("test") == set() and found("test", True) == {"This is a TEST line"}
    assert found("éTÉ", True) == {"Été"}
    assert len(found(None)) == 8
    assert found("foo$") == set() and found("^a.b$") == {"a\rb"} and found(r"^\w{3}$") == {"Été"}
    with pytest.raises(ValueError, match="Invalid regex pattern"):
        match_lines(lines, "[invalid")
    with pytest.raises(ValueError):
        check_pattern(spark, "(")
    assert lines.where(matches(F.col("value"), None)).count() == 8


def test_one_pass_forms(spark):
    import random

    assert one_pass_form("(the|und).*[0-9]") == "^(?>.*?(the|und)).*[0-9]" and one_pass_form("ab.*c$") == "^(?>.*?ab).*c$"
    for other in ("(the|a).*x", "a.*b|c", "a.*?b", "a.*", "x+.*y", "[ab].*c", "a|b.*c"):
        assert one_pass_form(other) is None, other
    rng = random.Random(0)
    lines = spark.createDataFrame([("".join(rng.choice(["ab", "a", "b", "AB", "c", "1", "\n", "é"]) for _ in range(rng.randint(0, 9))),) for _ in range(3000)], "value string")
    for pattern in ("(ab|ba).*1", "ab.*c$", "a.*b.*1", r"ab.*\d[^c]"):
        for fold in (False, True):
            got = lines.select(matches(F.col("value"), pattern, fold).alias("a"), F.col("value").rlike(java_pattern(pattern, fold)).alias("b")).collect()
            assert all(r.a == r.b for r in got) and any(r.a for r in got)


def test_back_references_are_no_one_pass_forms(spark):
    for pattern in (r"(the|und).*\1", r"(GET|PUT).*x\1", r"(ab|ba).*(?<w>c)\k<w>"):
        assert one_pass_form(pattern) is None, pattern
    assert one_pass_form(r"ab.*(c)\1") == r"^(?>.*?ab).*(c)\1"  # its own group: any first word will do
    texts = ["the und und", "und the und", "the und", "GET PUT xPUT", "GET PUT xDEL", "ab ba cc", "ab c", "THE und UND"]
    lines = spark.createDataFrame([(t,) for t in texts], "value string")
    found = lambda p, i=False: {r.value for r in match_lines(lines, p, i).collect()}
    assert found(r"(the|und).*\1") == {"the und und", "und the und"}
    assert found(r"(the|und).*\1", True) == {"the und und", "und the und", "THE und UND"}
    assert found(r"(GET|PUT).*x\1") == {"GET PUT xPUT"} and found(r"(ab|ba).*(?<w>c)\k<w>") == {"ab ba cc"} == found(r"ab.*(c)\1")


def test_explode_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\n"), (2, "a\n\nb"), (3, ""), (4, None), (5, "\n"), (6, "x\r\ny")], "id int, t string")
    got = sorted((r.id, r.line_no, r.value) for r in explode_lines(docs, "t", "id").collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, ""), (2, 2, "b"), (5, 0, ""), (6, 0, "x\r"), (6, 1, "y")]


def test_batches(spark):
    lines = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), "id", F.repeat(F.lit("x"), F.col("id").cast("int") % 7).alias("value"))
    got = {(r.k, r.id): r.batch_id for r in pack_batches(lines, ["k"], ["id"], 50).collect()}
    before = {"hot": 0, "cold": 0}
    for i in range(1000):
        k = "hot" if i < 900 else "cold"
        assert got[k, i] == before[k] // 50
        before[k] += i % 7 + 1
    with pytest.raises(ValueError):
        pack_batches(lines, [], ["id"], 50)


def test_error_classes(spark):
    texts = [*delivery.FATAL_ERRORS, "x NoSuchBucket y", "SlowDown", "InternalError", "timeout", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string")
    kinds = [r.c for r in df.orderBy("i").select(delivery.classify_error(F.col("m")).alias("c")).collect()]
    assert kinds == ["fatal"] * 15 + ["transient"] * 5
    for status, kind in ((200, "ok"), (429, "throttled"), (403, "fatal"), (500, "retry"), (302, "retry"), (None, "retry")):
        assert delivery.response_class(status) == kind
        assert spark.sql(f"SELECT {'null' if status is None else status} s").select(delivery.classify_response(F.col("s").cast("int"))).first()[0] == kind
    assert delivery.retries_allowed(99) == 10
