from stratalog import session
from stratalog.sources import durable

from .conftest import rows


def test_settled_tables_go_with_their_scratch(spark):
    keep = session.settle(spark.range(3).toDF("x"), "kept")
    out = session.new_path(spark, "result")
    with session.scratch(spark):
        inner = session.settle(keep.selectExpr("x + 1 AS x"), "inner")
        place = inner.inputFiles()[0].rsplit("/", 1)[0]
        inner.write.parquet(out)
    assert not durable.exists(spark, place) and rows(spark.read.parquet(out)) == [(1,), (2,), (3,)]
    assert rows(keep) == [(0,), (1,), (2,)]
