import pytest

from quarry.llm import exact_dedup


@pytest.mark.parametrize("slices", [1, 3])
def test_only_repeats_and_few_others_are_tested(spark, slices):
    df = spark.range(20_000).selectExpr("id as doc_id", "case when id % 10 = 0 then concat('same ', id div 100) else concat('own ', id) end as text")
    found = exact_dedup.decide(df, 1 << 20, slices)
    assert found.filter("group_size = 10").count() == 2000 and found.filter("group_size = 1").count() == 18_000
    assert found.filter("kept").count() == 18_200


def test_rows_that_pass_straight_through(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    digests = df.selectExpr("doc_id", "sha2(text, 256) as sha")
    bits, slices = exact_dedup.filter_size(20_000)
    tested = exact_dedup.maybe_repeated(digests.withColumn("positions", exact_dedup.bit_positions(digests["sha"], bits)), bits)
    assert slices == 1 and tested.filter("maybe").count() < 20_000 * 0.04


def test_filter_size_is_bounded():
    for rows in (0, 1, 10**6, 10**9, 10**11):
        bits, slices = exact_dedup.filter_size(rows)
        assert bits % exact_dedup.BITMAP_BITS == 0 and 0 < bits <= exact_dedup.MOST_BITS and bits * slices >= rows * exact_dedup.BITS_A_ROW
