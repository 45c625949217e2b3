import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefixlake.functions import bits
from prefixlake.operators.ranges import invalid_ranges, ranges_to_prefixes


def test_address_notations_normalize_alike(spark):
    texts = ["02AABBCC0001", "02:aa:bb:cc:00:01", "02-AA-BB-CC-00-01", "02aa.bbcc.0001"]
    df = bits.normalize_mac(spark.createDataFrame([(t,) for t in texts], "raw string"), "raw")
    for row in df.collect():
        assert (row.normalized, row.mac_value, row.is_valid) == ("02AABBCC0001", 0x02AABBCC0001, True)
        assert (row.locally_administered, row.multicast) == (True, False)


@pytest.mark.parametrize("text", [
    "", " 02AABBCC0001", "02AABBCC0001\n", "02:AA-BB:CC:00:01", "02AABBCC000", "02AABBCC00011", "02AABBCC000G",
    "02:AA:BB:CC:00", "02AA.BBCC0001", "0" * 40, None,
])
def test_other_text_is_invalid_and_kept(spark, text):
    row = bits.normalize_mac(spark.createDataFrame([(text,)], "raw string"), "raw").first()
    assert (row.is_valid, row.normalized, row.mac_value) == (False, None, None)


def test_multicast_flag(spark):
    row = bits.normalize_mac(spark.createDataFrame([("01005E000001",)], "raw string"), "raw").first()
    assert (row.locally_administered, row.multicast) == (False, True)


def test_format_prefix_is_left_aligned(spark):
    cases = [(1, 1, "8"), (0x02AABB, 24, "02AABB"), (0x0AA, 9, "550"), (0, 4, "0"), (1, 48, "000000000001"),
             (16, 4, None), (-1, 4, None), (0, 0, None), (0, 49, None)]
    df = spark.createDataFrame([(b, length) for b, length, _ in cases], "bits long, len int")
    found = [row[0] for row in df.select(bits.format_prefix("bits", "len")).collect()]
    assert found == [text for _, _, text in cases]


@pytest.mark.parametrize("text, expected", [
    ("02aabb-24", (0x02AABB, 24, "02AABB-24", True)),
    ("8-1", (1, 1, "8-1", True)),
    ("02AABBC-28", (0x02AABBC, 28, "02AABBC-28", True)),
    ("4-1", (None, None, None, False)),      # a low bit below the prefix is set
    ("02AABB-28", (None, None, None, False)),
    ("02AABB-0", (None, None, None, False)),
    ("0000000000000-49", (None, None, None, False)),
    ("02AABB", (None, None, None, False)),
])
def test_parse_prefix(spark, text, expected):
    row = bits.parse_prefix(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row.prefix_bits, row.prefix_length, row.canonical, row.is_valid) == expected


def test_registry_fixes_the_length(spark):
    df = spark.createDataFrame([("02AABB-24", "ma-l"), ("02AABB-24", "MA-M"), ("02AABB-24", "unknown")], "t string, r string")
    found = bits.parse_prefix(df, "t", registry="r").collect()
    assert [row.is_valid for row in found] == [True, False, False]


def test_prefix_bits_out_of_range(spark):
    df = spark.createDataFrame([(1, 0), (1, 49), (-1, 24), (1 << 48, 24), (0xFFFFFFFFFFFF, 48)], "m long, l int")
    assert [row[0] for row in df.select(bits.prefix_bits("m", "l")).collect()] == [None, None, None, None, 0xFFFFFFFFFFFF]


def test_prefix_keys_are_unique(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 2), (0, 48), ((1 << 48) - 1, 48)], "b long, l int")
    assert df.select(bits.prefix_key("b", "l").alias("k")).distinct().count() == 6


def _cover(start, end):
    """Plain greedy cover, for comparison."""
    out = []
    while start <= end:
        size = start & -start if start else 1 << 48
        while size > end - start + 1:
            size >>= 1
        out.append((start // size, 48 - (size.bit_length() - 1)))
        start += size
    return sorted(out)


def _spark_cover(spark, ranges):
    df = spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(ranges)], "i int, s long, e long")
    found = {i: [] for i in range(len(ranges))}
    for row in ranges_to_prefixes(df, "s", "e").collect():
        found[row.i].append((row.prefix_bits, row.prefix_length))
    return [sorted(found[i]) for i in range(len(ranges))]


def test_range_examples(spark):
    ranges = [(0x01005E900100, 0x01005E9001FF), (0x01005E900100, 0x01005E900102)]
    assert _spark_cover(spark, ranges) == [
        [(0x01005E9001, 40)], sorted([(0x01005E900100 >> 1, 47), (0x01005E900102, 48)])]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**48 - 1), st.integers(0, 2**20)), min_size=1, max_size=60))
def test_ranges_equal_the_greedy_cover(spark, picked):
    ranges = [(start, min(start + width, 2**48 - 1)) for start, width in picked]
    ranges = [r for r in ranges if r != (0, 2**48 - 1)]
    assert _spark_cover(spark, ranges) == [_cover(*r) for r in ranges]


def test_impossible_ranges_are_reported(spark):
    df = spark.createDataFrame([(5, 4), (-1, 3), (0, 2**48), (0, 2**48 - 1), (7, 7)], "s long, e long")
    assert ranges_to_prefixes(df, "s", "e").select("s").distinct().collect()[0][0] == 7
    assert invalid_ranges(df, "s", "e").count() == 4


def test_ranges_need_no_shuffle(spark):
    df = spark.range(10).select("id", F.col("id").alias("e"))
    plan = ranges_to_prefixes(df, "id", "e")._jdf.queryExecution().toString()
    assert "Exchange" not in plan
