import duckdb
import pytest

import __spark_entry__

SCHEMA = "l_orderkey long, l_partkey long, l_quantity double"


def _contributions(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    return sorted(map(tuple, __spark_entry__.queries()["max_contribution"](spark, str(folder)).collect()))


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(1, 1_100_000, 10.0), (1, 50_000, 11.0)], (1, 1_100_000, 11.0)),  # a part key beyond a million outweighs a unit of quantity
        ([(1, 900_000, 10.0), (1, 50_000, 11.0)], (1, 50_000, 11.0)),
        ([(1, 7, 3.0), (1, 9, 3.0), (1, 8, 3.0)], (1, 9, 3.0)),
        ([(1, None, 9.0), (1, 5, 3.0)], (1, 5, 9.0)),  # rows without a part or a quantity contribute nothing
        ([(1, 5, None), (1, 2, 1.0)], (1, 2, 1.0)),
        ([(1, 7, None), (1, 8, None)], (1, None, None)),
        ([(1, 5, float("inf")), (1, 6, 7.0)], (1, 5, float("inf"))),
        ([(None, 1_100_000, 10.0), (None, 50_000, 11.0)], (None, 1_100_000, 11.0)),
    ],
)
def test_max_contribution_equals_its_sql(spark, tmp_path, rows, expected):
    assert _contributions(spark, tmp_path, rows) == [expected]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert db.execute(__spark_entry__.oracle_sql()["max_contribution"]).fetchall() == [expected]


def test_max_contribution_of_equal_scores(spark, tmp_path):
    assert _contributions(spark, tmp_path, [(1, 1_000_001, 1.0), (1, 1, 2.0)]) == [(1, 1_000_001, 2.0)]
