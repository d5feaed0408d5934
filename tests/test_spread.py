"""The scale helpers against plain Python on skewed inputs."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from rollcall.functions import spread


def skewed(spark, n=3000):
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", 5.0 if i % 3 == 1 else rng.gauss(0, 10), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v double, i bigint").repartition(5)


def test_quantiles_match_numpy(spark):
    rows, df = skewed(spark)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = spread.quantiles(df, ["v", "i"], probs).first()
    for c, vals in (("v", [r[1] for r in rows]), ("i", [r[2] for r in rows])):
        for k, p in enumerate(probs):
            assert abs(got[f"{c}_q{k}"] - np.quantile(vals, p)) < 1e-9
    for r in spread.quantiles(df, ["v"], [0.5], by=["g"]).collect():
        assert abs(r["v_q0"] - np.median([x[1] for x in rows if x[0] == r["g"]])) < 1e-9


def test_running_totals(spark):
    rows, df = skewed(spark)
    got = {r["i"]: r for r in spread.running(df.withColumn("w", F.col("i") % 7), ["g"], ["i"], {"t": "w"}, partitions=6).collect()}
    seen: dict[str, int] = {}
    total: dict[str, int] = {}
    for g, _, i in rows:
        total[g] = total.get(g, 0) + i % 7
    for g, _, i in rows:
        assert got[i]["t_before"] == seen.get(g, 0) and got[i]["t_all"] == total[g]
        seen[g] = seen.get(g, 0) + i % 7


def test_previous_in_key_crosses_slices(spark):
    base = dt.datetime(2024, 1, 1)
    rng = random.Random(3)
    rows = [(i, "hot" if i % 2 else f"k{i % 5}", base + dt.timedelta(minutes=rng.randrange(0, 6000, 10)), i % 11) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, k string, ts timestamp, v bigint")
    got = {r["id"]: r["prev_v"] for r in spread.previous_in_key(df, "k", "ts", "id", ["v"]).collect()}
    last: dict[str, int] = {}
    for i, k, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[i] == last.get(k)
        last[k] = v


def test_broadcast_only_when_checked(spark):
    df = spark.range(100)
    assert "broadcast" in spread.small(df, 100)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in spread.small(df, 99)._jdf.queryExecution().logical().toString().lower()


def test_join_stats_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 4)], "g string, v bigint")
    got = {(r["g"], r["v"]): r["s"] for r in spread.with_group(df, ["g"], F.sum("v").alias("s")).collect()}
    assert got == {("a", 1): 1, (None, 2): 6, (None, 4): 6}
