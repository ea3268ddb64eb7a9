import pytest

from bytequarry.operators import relational as R


def test_range_lookup(spark):
    ranges = spark.createDataFrame([("a", 0, 10, 20), ("a", 1, 15, 9000), ("a", 2, 5, 5), ("b", 0, 0, 3)], "img string, pos int, lo long, hi long")
    points = spark.createDataFrame([("a", 9), ("a", 10), ("a", 17), ("a", 20), ("a", 8999), ("a", 9000), ("b", 2), ("b", None), ("b", 2), (None, 1)], "img string, v long")
    got = sorted(R.range_lookup(points, ranges, "v", "lo", "hi", "pos", ["img"], 1000).collect(), key=str)
    assert sorted(((r.img, r.v, r.pos) for r in got), key=str) == sorted([("a", 9, None), ("a", 10, 0), ("a", 17, 0), ("a", 20, 1), ("a", 8999, 1), ("a", 9000, None), ("b", 2, 0), ("b", 2, 0), ("b", None, None), (None, 1, None)], key=str)
    with pytest.raises(ValueError, match="both"):
        R.range_lookup(points, ranges.withColumnRenamed("pos", "v"), "v", "lo", "hi", "v", ["img"])


def test_chains_and_cycles(spark):
    edges = spark.createDataFrame([("x", i, i + 1) for i in range(0, 20)] + [("x", 20, None), ("x", 30, 31), ("x", 31, 30), ("y", 1, 99)], "k string, n long, f long")
    got = {(r.k, r.n): r.position for r in R.chain_positions(edges, ["k"], "n", "f").collect()}
    assert got == {("x", i): i for i in range(21)} | {("y", 1): 0}


def test_empty(spark):
    e = spark.createDataFrame([], "k string, p long, v long")
    assert R.first_match(e, ["k"], "p").collect() == [] and R.last_wins(e, ["k"], "p").collect() == []
    assert R.next_distinct(e, ["k"], "v").collect() == [] and R.chain_positions(e, ["k"], "p", "v").collect() == []
    assert R.ordered_concat(e, ["k"], "p", "k", "t").collect() == []
