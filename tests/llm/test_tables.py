from pathlib import Path

from linescan.llm.tables import keep, passing, shared_dir


def test_tables_that_pass(spark):
    root = Path(shared_dir(spark).removeprefix("file://")) / "corpus"
    outer = keep(spark.range(3).toDF("a"), "outer")
    with passing(spark) as made:
        inner = keep(outer.selectExpr("a + 1 AS a"), "inner")
        result = keep(inner.selectExpr("a * 2 AS a"), "result")
        own = made.pop()
        assert len(made) == 1 and Path(own.removeprefix("file://")).exists()
    assert not Path(made[0].removeprefix("file://")).exists() and sorted(r.a for r in result.collect()) == [2, 4, 6]
    assert [p for p in root.glob("outer-*")] and outer.count() == 3
