import pytest

from conftest import SF, plain
from foliospark.docs import lookups, queries


@pytest.mark.parametrize("name", queries.QUERIES)
def test_same_as_sql(spark, duck, name):
    frame, other = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    order = [other.columns.index(c) for c in frame.columns]
    assert plain(frame.collect()) == plain([r[i] for i in order] for r in other.fetchall())


def test_volumes_by_their_numbers(spark):
    volumes = ["10", "9", None, "", "9bis", "010", "x", "2"]
    rows = spark.createDataFrame([(i, 1, v) for i, v in enumerate(volumes)], "id int, d int, volume string")
    got = lookups.numbered_references(rows, "d", ["volume", "id"]).orderBy("number").collect()
    assert [r["volume"] for r in got] == [None, "", "x", "2", "9", "9bis", "010", "10"]


def test_documents_are_dealt_by_rows(spark, capsys):
    rows = spark.range(1000).selectExpr("id % 50 AS k")
    assert queries.dealt(rows, "k", 100).rdd.getNumPartitions() == 10 and queries.dealt(rows.limit(0), "k").count() == 0
    for view in queries.DEALT:
        queries._view(spark, SF, view).explain()
        plan = capsys.readouterr().out
        assert plan.count("REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in plan
