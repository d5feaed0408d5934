"""The keyed bijection on row numbers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rollcall.functions import shuffle


def plain(x, n, *key):
    a, b = shuffle.halves(n)
    while True:
        left, right = divmod(x, b)
        for i in range(shuffle.ROUNDS):
            h = lambda half: int(hashlib.md5("|".join(map(str, (*key, i, half))).encode()).hexdigest()[:8], 16)
            if i % 2 == 0:
                left = (left + h(right)) % a
            else:
                right = (right + h(left)) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 31, 125, 1000])
def test_bijection(spark, n):
    a, b = shuffle.halves(n)
    assert n <= a * b < n + b
    rows = spark.range(n).select("id", shuffle.shuffled(F.col("id"), n, F.lit(42), F.lit("c")).alias("to")).collect()
    assert {r["id"]: r["to"] for r in rows} == {x: plain(x, n, 42, "c") for x in range(n)}
    assert sorted(r["to"] for r in rows) == list(range(n))


def test_places_are_even(spark):
    """Over many keys every row comes to every place about as often."""
    n, keys = 7, 4200
    rows = spark.range(n).withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(keys))))
    hits = rows.groupBy("id", shuffle.shuffled(F.col("id"), n, F.lit(42), F.col("p")).alias("to")).count().collect()
    assert len(hits) == n * n and all(abs(r["count"] - keys / n) < 6 * (keys / n) ** 0.5 for r in hits)


def test_numbers(spark):
    df = spark.createDataFrame([(f"k{i:03d}", i) for i in range(50)], "k string, v int").repartition(6)
    assert {r["v"]: r["seat"] for r in shuffle.numbered(df, "k").collect()} == {i: i for i in range(50)}
