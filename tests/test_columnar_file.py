from stratalog.session import new_path
from stratalog.sources import columnar_file as CF

from .conftest import rows


def test_row_groups_zones_and_columns(spark):
    path = new_path(spark, "cf")
    df = spark.range(250).selectExpr("id", "concat('n', id) AS name", "IF(id % 10 = 0, NULL, id / 2.0D) AS score").coalesce(1)
    CF.write(df, path, rows_per_group=100, compression="DICTIONARY", dictionary={"score": False}, bloom=["id"])
    zones = CF.zones(spark, path)
    assert sorted((r["row_group"], r["rows"], r["min_value"], r["max_value"]) for r in zones.where("column_name = 'id'").collect()) == [(0, 100, 0, 99), (1, 100, 100, 199), (2, 50, 200, 249)]
    assert rows(CF.aggregate(spark, path, "score")) == [(250, 25, 0.5, 124.5, 14062.5, 62.5)]
    assert {r["row_group"] for r in CF.groups_that_may_contain(spark, path, "id", 150, 220).collect()} == {1, 2}
    assert {r["row_group"] for r in CF.groups_that_may_contain(spark, path, "name", 1, 2).collect()} == {0, 1, 2}
    assert rows(CF.read_column(spark, path, "name", 2)) == sorted((f"n{i}",) for i in range(200, 250))
    assert CF.read_column(spark, path, "id").count() == 250 and CF.read_column(spark, path, "id", 9).count() == 0
