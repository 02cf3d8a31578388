"""Queries of the zstd sink when adaptive execution splits their prefixes, as it does with large tables."""

import pytest

from linescan import registry
from linescan.sources.lines import read_lines, with_source
from linescan.sources.manifest import current_files, with_prefix
from linescan.sources.zstd_lines import write_lines

from .conftest import DATA, same_as_sql


@pytest.fixture
def split(spark):
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["c5_with_source", "e4_output_files", "f1_write_lines", "f2_compression_level", "f3_overwrite"])
def test_same_as_sql(spark, duck, split, name):
    same_as_sql(registry.QUERIES[name](spark, DATA), duck, registry.ORACLE_SQL[name])


def test_prefix_of_each_file(spark, split, tmp_path):
    root = str(tmp_path / "out")
    lines = spark.range(20000).selectExpr("IF(id % 10 = 0, 'x-1', 'x') prefix", "sha2(string(id), 256) value").repartition(8)
    write_lines(lines, root, parts=2)
    assert current_files(spark, root).count() > 4  # some are split
    (tmp_path / "out" / "foreign.txt").write_text("f\n")
    found = with_prefix(with_source(read_lines(spark, root), root).groupBy("key").count(), root).groupBy("prefix").sum("count").collect()
    assert {tuple(r) for r in found} == {("x", 18000), ("x-1", 2000), (None, 1)}
